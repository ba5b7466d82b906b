"""Best-fit packing of documents into sequences by bin completion.

Every document becomes token ids and an end id. Only documents longer than a sequence are cut, into full pieces behind a
first piece that may be shorter, so at most `capacity` different sizes exist. The search runs on how often each size
occurs: a table of at most `capacity` rows, whatever the number of documents. Around the largest size left it enumerates
the fillings that no other filling dominates, of any number of members and least waste first, applies one as often as the
counts allow (on the way back less often), prunes where the waste so far shows that the incumbent can't be beaten, and
falls back on the best packing found after NODES steps, the only limit of the search. Its first packings are best-fit's and
that of a search over a few fillings. The plan is then dealt to the pieces by their number within their size, which is
found in salted parts.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, at_column, byte_class, checkpoint, give_back, map_batches, numbered, positional, slices, span_hashes, utf8

#: Distinct words whose ids a task remembers before it starts anew.
CACHE_WORDS = 2_000_000
#: Search steps after which the best packing found so far is taken.
NODES = 20_000


class ByteBpe:
    """Ids of many texts at once, equal to tokenizers' encode(text, add_special_tokens=False) for a byte-level BPE file.

    Texts of Latin letters are split into words by class of byte, each new word is merged once and its ids are
    remembered; any other text (other scripts, special tokens) goes to the tokenizer as it is. Words are merged by
    tiktoken over the same vocabulary where the file's merges follow its ids, which is checked, and by the file's own
    model otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"] for x in spec["added_tokens"]}
        self.added = [x.encode() for x in added if x]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {x: chr(x) for x in plain} | {x: chr(256 + n) for n, x in enumerate(sorted({*range(256)} - {*plain}))}
        self.merge = self.merger(spec["model"], letters, added)
        self.kind = np.zeros(256, np.uint8)  # 0 other, 1 letter, 2 number, 3 space
        self.kind[byte_class((65, 90), (97, 122), (0x80, 0xFF))] = 1
        self.kind[byte_class((48, 57))] = 2
        self.kind[byte_class((9, 13), (32, 32))] = 3
        self.forget()

    def merger(self, model: dict, letters: dict[int, str], added: set[str]):
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        if [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))):
            import tiktoken

            back = {c: x for x, c in letters.items()}
            ranks = {bytes(map(back.__getitem__, token)): n for token, n in model["vocab"].items() if token not in added}
            return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        own = self.whole.model
        return lambda word: [t.id for t in own.tokenize(word.decode("latin-1").translate(letters))]

    def forget(self) -> None:
        self.keys = np.zeros(0, U64)  # hashes of known words, rising; their ids are flat[begin:begin + size]
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        merged = [self.merge(w) for w in words]
        size = np.fromiter(map(len, merged), np.int64, len(merged))
        ids = np.fromiter((x for m in merged for x in m), np.uint32, int(size.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        begin = self.used + np.concatenate(([0], np.cumsum(size)[:-1]))
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.used += len(ids)

    def plain(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which rows the split by bytes handles: ASCII without separators 1C-1F, and Latin letters of two bytes."""
        bad = byte_class((0x1C, 0x1F), (0xCA, 0xFF), (0xC0, 0xC2))[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            bad[lead[np.isin(data[np.minimum(lead + 1, len(data) - 1)], (0x97, 0xB7))]] = True  # the signs for times and divided by
        total = np.concatenate(([0], np.cumsum(bad)))
        good = total[at[1:]] == total[at[:-1]]
        whole = data.tobytes()
        for token in self.added:
            found = whole.find(token)
            while found >= 0:
                good[np.searchsorted(at, found, "right") - 1] = False
                found = whole.find(token, found + 1)
        return good

    def starts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where words begin: the public byte-level split pattern, by classes of neighbouring bytes."""
        kind, n = self.kind[data], len(data)
        first = np.zeros(n + 1, bool)
        first[at] = True
        begin = np.ones(n, bool)
        begin[1:] = kind[1:] != kind[:-1]
        begin |= first[:-1]
        # the last space of a run goes with what follows it, or stands alone if it is another kind of space
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:-1]) if n > 1 else np.zeros(0, np.int64)
        begin[last] = True
        begin[last[data[last] == 32] + 1] = False
        quote = np.flatnonzero((data[:-1] == 39) & begin[:-1] & ~first[1:-1]) if n > 1 else np.zeros(0, np.int64)
        for ends in ("s", "t", "m", "d", "re", "ve", "ll"):
            fits = quote[quote + len(ends) < n]
            for k, letter in enumerate(ends.encode()):
                fits = fits[(data[fits + 1 + k] == letter) & ~first[fits + 1 + k]]
            begin[fits + 1] = False
            rest = fits + 1 + len(ends)
            begin[rest[rest < n]] = True
        return np.flatnonzero(begin)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the rows' offsets in them."""
        good = self.plain(data, at)
        parts: list[np.ndarray] = []
        sizes = np.zeros(len(at) - 1, np.int64)
        if good.all():
            ids, sizes = self.split(data, at)
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        lengths = np.diff(at)
        keep = np.repeat(good, lengths)
        ids, sizes[good] = self.split(data[keep], np.concatenate(([0], np.cumsum(lengths[good]))))
        used = 0
        for row in range(len(good)):
            if good[row]:
                parts.append(ids[used : used + sizes[row]])
                used += sizes[row]
            else:
                text = data[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace")
                parts.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32))
                sizes[row] = len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate(([0], np.cumsum(sizes)))

    def split(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        begin = self.starts(data, at)
        end = np.append(begin[1:], len(data))
        keys, where, back = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        if new.any():
            raw = data.tobytes()
            self.learn(keys[new], [raw[begin[w] : end[w]] for w in where[new].tolist()])
        entry = np.searchsorted(self.keys, keys)
        size, first = self.size[entry][back], self.begin[entry][back]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[np.searchsorted(begin, at)])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each piece of each document; a null or empty text has the end id alone."""

    def make():
        bpe = ByteBpe(tokenizer)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(1))
            rows: list[int] = []
            out: list[tuple[int, int, int, int]] = []
            for a, b in slices(at):
                ids, to = bpe.encode(data[at[a] : at[b]], at[a : b + 1] - at[a])
                for row, (x, y) in enumerate(zip(to[:-1].tolist(), to[1:].tolist(), strict=True), a):
                    whole = np.append(ids[x:y], np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(whole) % capacity or capacity, len(whole) + 1, capacity)] if len(whole) > capacity else [0, len(whole)]
                    for k, (p, q) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        out.append((k, p, q - p, zlib.crc32(whole[p:q].tobytes())))
            piece, start, length, crc = zip(*out)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return map_batches(positional(docs).select(at_column(docs, id_column).cast("long").alias("doc_id"), at_column(docs, text_column).cast("string").alias("text")), make, PIECES)


@dataclass
class Pattern:
    """A filling: (size, how many of it) pairs, used `times` times."""

    sizes: list[tuple[int, int]]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by total size, and by pieces too large to stand together."""
    size = np.arange(len(counts))
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, capacity // 2 + 1):
        big, middle = counts[capacity - k + 1 :].sum(), counts[capacity // 2 + 1 : capacity - k + 1]
        room = (middle * (capacity - size[capacity // 2 + 1 : capacity - k + 1])).sum()
        rest = (counts[k : capacity // 2 + 1] * size[k : capacity // 2 + 1]).sum()
        best = max(best, int(big + middle.sum() + max(0, -(-(int(rest) - int(room)) // capacity))))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: the largest size that fits goes in, until none does; repeated while counts allow."""
    left, out = counts.copy(), []
    while (big := np.flatnonzero(left)).size:
        need: dict[int, int] = {}
        room = capacity
        while room and (fits := big[: np.searchsorted(big, room, "right")]).size:
            for size in fits[::-1].tolist():
                if left[size] - need.get(size, 0) > 0:
                    n = min(room // size, int(left[size]) - need.get(size, 0))
                    need[size] = need.get(size, 0) + n
                    room -= n * size
                    break
            else:
                break
        times = min(int(left[s]) // n for s, n in need.items())
        for s, n in need.items():
            left[s] -= n * times
        out.append(Pattern(sorted(need.items(), reverse=True), times))
    return out


@lru_cache(maxsize=64)
def reachable(counts: bytes) -> tuple[list[int], list[int]]:
    """Sizes that occur, largest first, and for each place in them the sums up to the room (bits) that the sizes from it on give.

    counts are the bytes of an int64 array by size, up to the room.
    """
    left = np.frombuffer(counts, np.int64)
    room = len(left) - 1
    sizes = np.flatnonzero(left)[::-1].tolist()
    every = (1 << (room + 1)) - 1
    sums = [1]
    for size in sizes[::-1]:
        bits, most, step = sums[-1], min(int(left[size]), room // size), 1
        while most:
            step = min(step, most)
            bits |= (bits << (size * step)) & every
            most -= step
            step *= 2
        sums.append(bits if bits != sums[-1] else sums[-1])  # equal sums share one number
    return sizes, sums[::-1]


def fillings(left: np.ndarray, largest: int, capacity: int) -> Iterator[tuple[int, list[int]]]:
    """Every filling of the room beside the largest size that may be undominated, least waste first, as (waste, sizes).

    A filling of no more tokens than the largest single size is dominated by that size, which therefore comes last; every
    other is given, whatever its number of members, larger sizes first among equal waste. They are found one by one, from
    a table of the sums that the sizes reach; the table is built anew if it is needed after others have taken its place.
    """
    room = capacity - largest
    sizes = np.flatnonzero(left[: room + 1])
    if not room or not sizes.size:
        yield room, []
        return
    single = int(sizes[-1])
    if single < room:
        counts = np.minimum(left[: room + 1], room).tobytes()

        def sets(total: int, first: int) -> Iterator[list[int]]:
            if not total:
                yield []
                return
            order, sums = reachable(counts)
            place = bisect_left(order, -total, lo=first, key=lambda v: -v)
            while place < len(order) and reachable(counts)[1][place] >> total & 1:
                size = order[place]
                for n in range(min(int(left[size]), total // size), 0, -1):
                    if reachable(counts)[1][place + 1] >> (total - n * size) & 1:
                        for tail in sets(total - n * size, place + 1):
                            yield [size] * n + tail
                place += 1

        sums = reachable(counts)[1][0]
        for total in range(room, single, -1):
            if sums >> total & 1:
                for found in sets(total, 0):
                    yield room - total, found
    yield room - single, [single]


def few_fillings(left: np.ndarray, largest: int, capacity: int, most: int = 12) -> list[tuple[int, list[int]]]:
    """Some fillings of the room beside the largest size, least waste first, as (waste, sizes): for incumbents only.

    Of single sizes the largest, of pairs those in which neither member could grow, some larger sets by completing the
    larger sizes by the pair rule. They seldom break up many small sizes, so a first descent along them is often good.
    """
    room = capacity - largest
    sizes = np.flatnonzero(left[: room + 1])
    if not room or not sizes.size:
        return [(room, [])]
    if sizes[-1] == room:
        return [(0, [room])]
    at_most = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
    found: list[tuple[int, list[int]]] = [(room - int(sizes[-1]), [int(sizes[-1])])]

    def pairs(space: int, head: list[int]) -> None:
        a = sizes[np.searchsorted(sizes, space // 2, "right") :]
        a = np.concatenate((sizes[np.searchsorted(sizes, space // 2, "right") - 1 :][:1], a)) if sizes[0] <= space // 2 else a
        a = a[a < space][::-1]
        if not a.size:
            return
        b = at_most[space - a]
        ok = (b > 0) & (b <= a) & ((b != a) | (left[a] > 1))
        a, b = a[ok], b[ok]
        if not a.size:
            return
        grown = np.maximum.accumulate(np.concatenate(([0], b[:-1])))
        free = b > grown  # the staircase: a smaller first member must allow a larger second one
        a, b = a[free], b[free]
        waste = space - a - b
        for k in np.argsort(waste, kind="stable")[:most]:
            sizes_used = [*head, int(a[k]), int(b[k])]
            if all(left[s] >= sizes_used.count(s) for s in set(sizes_used)):
                found.append((int(waste[k]), sizes_used))

    pairs(room, [])
    if min(w for w, _ in found):
        for head in sizes[::-1][:most].tolist():
            if head < room:
                pairs(room - head, [head])
    if min(w for w, _ in found):  # many small sizes: fill greedily from the largest, then finish with a pair
        space, head, take = room, [], left[: room + 1].copy()
        for s in sizes[::-1].tolist():
            while s <= space and take[s]:
                head.append(s)
                take[s] -= 1
                space -= s
        found.append((space, head))
    unique = {tuple(sorted(s, reverse=True)): w for w, s in found}
    return sorted(((w, list(s)) for s, w in unique.items()), key=lambda x: (x[0], len(x[1]), [-v for v in x[1]]))[:most]


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """The packing: best-fit's, improved by a search over a few fillings, then by the one over all, each of `nodes` steps at most."""
    quick = search(counts, capacity, nodes, best_fit(counts, capacity), lambda *a: iter(few_fillings(*a)))
    return search(counts, capacity, nodes, quick, fillings)


def planned(counts: np.ndarray, capacity: int, nodes: int = NODES) -> list[Pattern]:
    """As complete; what the search took of the driver's memory goes back to the system."""
    plan = complete(counts, capacity, nodes)
    reachable.cache_clear()
    give_back()
    return plan


def search(counts: np.ndarray, capacity: int, nodes: int, incumbent: list[Pattern], fillings: Callable[[np.ndarray, int, int], Iterator[tuple[int, list[int]]]]) -> list[Pattern]:
    """Bin completion with branch and bound over counts: the incumbent, or a packing of fewer sequences.

    A filling is tried as often as the counts allow, then the other fillings, then the same one less often; only `nodes`
    limits the search of what `fillings` gives, least waste first.
    """
    bins = sum(p.times for p in incumbent)
    total, least = int((counts * np.arange(len(counts))).sum()), lower_bound(counts, capacity)
    steps = 0
    Again = tuple[int, dict[int, int], int]  # a filling's waste, its counts by size, and how often it is used
    stack: list[tuple[np.ndarray, list[Pattern], int, int, Iterator[tuple[int, list[int]]] | None, Again | None]] = [(counts.copy(), [], 0, 0, None, None)]
    while stack and bins > least and steps < nodes:
        left, plan, used, waste, options, again = stack.pop()
        spare = (bins - 1) * capacity - total - waste  # waste that a better packing may still have
        if again is None:
            present = np.flatnonzero(left)
            if not present.size:
                if used < bins:
                    incumbent, bins = plan, used
                continue
            largest = int(present[-1])
            if options is None:
                beside = left.copy()
                beside[largest] -= 1
                options = fillings(beside, largest, capacity)
                tail = best_fit(left, capacity) if steps % 512 == 511 else None
                if tail is not None and used + sum(p.times for p in tail) < bins:
                    incumbent, bins = plan + tail, used + sum(p.times for p in tail)
            steps += 1
            if (option := next(options, None)) is None or option[0] > spare:
                continue  # fillings after it waste no less
            lost, sizes = option
            need: dict[int, int] = {largest: 1}
            for s in sizes:
                need[s] = need.get(s, 0) + 1
            times = min(int(left[s]) // n for s, n in need.items())
        else:
            lost, need, times = again
            steps += 1
        if lost and lost * times > spare:
            times = int(spare // lost)
        if times < 1:
            continue
        if times > 1:
            stack.append((left, plan, used, waste, None, (lost, need, times - 1)))
        if again is None:
            stack.append((left, plan, used, waste, options, None))
        rest = left.copy()
        for s, n in need.items():
            rest[s] -= n * times
        stack.append((rest, [*plan, Pattern(sorted(need.items(), reverse=True), times)], used + times, waste + lost * times, None, None))
    return incumbent


def pack(rows: DataFrame, capacity: int = 2048, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces (PIECES); rows is read three times, so it should be materialised.

    Sizes lie between 1 and capacity. Pieces of the same size are interchangeable; they are numbered by doc_id, piece and
    checksum, so repeated rows each get a place. An empty table stays empty.
    """
    spark = rows.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        counts[size] = n
    plan = planned(counts, capacity, nodes)
    # by size: the first number that a pattern takes, how many a sequence, first sequence, place in it
    dealt, sequence = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for p in plan:
        offset = 0
        for size, n in p.sizes:
            dealt.append((size, int(taken[size]), n, sequence, offset))
            taken[size] += n * p.times
            offset += size * n
        sequence += p.times
    dealt.sort()
    table = np.array(dealt, np.int64).reshape(-1, 5)  # its size depends on capacity, not on the rows
    bound = spark.sparkContext.broadcast(table)
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def make():
        t = bound.value
        keys = t[:, 0] * (1 << 44) + t[:, 1]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            number = batch.column(5).to_numpy()
            size = batch.column(3).to_numpy()
            hit = t[np.searchsorted(keys, size * (1 << 44) + number, "right") - 1]
            turn, place = np.divmod(number - hit[:, 1], hit[:, 2])
            return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit[:, 3] + turn, pa.int64()), pa.array(hit[:, 4] + place * size, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        return step

    ranked = numbered(rows, "length", ["doc_id", "piece", "start", "ids_crc32"], "_number", salts)
    return map_batches(ranked, make, PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = NODES) -> DataFrame:
    """Documents packed into sequences of at most `capacity` tokens: a row for each piece, with its sequence and place.

    Columns other than doc_id and text are ignored. A null or empty text is its end id; equal rows are separate pieces.
    """
    return pack(checkpoint(pieces(docs, tokenizer, capacity, end_id)), capacity, nodes)
