"""Each operator on awkward rows against a brute-force version: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, a long, shard int"
WORDS = [f"w{k}x" for k in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    words = [r.choice(WORDS) for _ in range(n)]
    return " ".join(w + ("." if k % 7 == 6 else "") for k, w in enumerate(words))


def rows():
    passage = prose(99, 70)
    base = prose(5, 200)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [None, "", " \n\t", "!!!", "one", "two words", prose(1, 120), prose(1, 120), prose(2, 120), base, near, base.upper(), prose(3, 40) + ". " + passage + ". " + prose(4, 30),
             prose(6, 50) + ". " + passage + ". " + prose(7, 20), prose(8, 6000), "é’s ñandú <|endoftext|> 日本語 don't", "a\x00b\x1cc", "x" * 5000]
    out = [(k, t, "en", "s", None, 1, 2, 3) for k, t in enumerate(texts)]
    return [*out, out[6], (None, prose(1, 120), None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "same id, other text " + prose(11, 60), None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from terrasift.llm.packing import best_fit_packing

    tk = Tokenizer.from_file(TOKENIZER)
    want = []
    for d, t, *_ in rows():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = list(range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)) if len(ids) > 2048 else [len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *cuts], cuts))]
    got = best_fit_packing(docs, TOKENIZER).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1
    assert best_fit_packing(none, TOKENIZER).count() == 0


def test_bin_completion_beats_or_equals_best_fit():
    from terrasift.llm.packing import best_fit, complete, lower_bound

    for seed in range(20):
        rng = np.random.default_rng(seed)
        counts = np.bincount(rng.integers(20, 70, 60), minlength=101)
        plan = complete(counts, 100, nodes=3000)
        used = sum(p.times for p in plan)
        assert lower_bound(counts, 100) <= used <= sum(p.times for p in best_fit(counts, 100))
        back = np.zeros(101, np.int64)
        for p in plan:
            assert sum(s * n for s, n in p.sizes) <= 100
            for s, n in p.sizes:
                back[s] += n * p.times
        assert (back == counts).all()


def test_packing_finds_fillings_of_many_members():
    from terrasift.llm.packing import complete, fillings, lower_bound

    counts = np.zeros(2049, np.int64)
    counts[500], counts[387] = 1000, 4000  # 500 + 4 x 387 = 2048
    assert sum(p.times for p in complete(counts, 2048)) == lower_bound(counts, 2048) == 1000
    for seed in range(40):
        r = random.Random(seed)
        left = np.bincount([r.randint(1, 25) for _ in range(r.randint(1, 9))], minlength=41)
        room = r.randint(1, 30)
        sums = {()}
        for s in np.repeat(np.arange(41), left).tolist():
            sums |= {(*x, s) for x in sums if sum(x) + s <= room}
        big = max((sum(x) for x in sums if len(x) == 1), default=0)
        want = sorted((room - sum(x), x) for x in sums if sum(x) > big or x == ((big,) if big else ()))
        got = [(w, tuple(sorted(x))) for w, x in fillings(left, 40 - room, 40)]
        assert sorted(got) == want and [w for w, _ in got] == sorted(w for w, _ in got)


def test_sharding(docs, none, spark):
    from terrasift.llm.sharding import Tree, shard

    tree = Tree.balanced(40)
    got = shard(docs, tree, tree.grown()).collect()
    assert len(got) == len(rows())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in rows())
    places = {}
    for r in got:
        assert r.grown_shard in (r.shard, 40)
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    many = shard(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), tree, tree.grown()).groupBy("shard").count().collect()
    assert len(many) == 40 and max(r["count"] for r in many) < 640
    def draw(key, name, weight):
        return -math.log((int(hashlib.md5(f"{key}/{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / weight

    def plain(key, t):
        r = min(range(len(t.regions)), key=lambda r: draw(key, r, sum(map(sum, t.regions[r]))))
        k = min(range(len(t.regions[r])), key=lambda k: draw(key, f"{r}/{k}", sum(t.regions[r][k])))
        s = min(range(len(t.regions[r][k])), key=lambda s: draw(key, f"{r}/{k}/{s}", t.regions[r][k][s]))
        return sum(len(x) for y in t.regions[:r] for x in y) + sum(map(len, t.regions[r][:k])) + s

    assert all((r.shard, r.grown_shard) == tuple(plain("null" if r.doc_id is None else r.doc_id, t) for t in (tree, tree.grown())) for r in got)
    heavier = Tree((((1.0,), (1.0,)), ((1.0, 3.0),)))
    light = Tree((((1.0,), (1.0,)), ((1.0, 1.0),)))
    ids = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    moved = shard(ids, light, heavier).filter("shard <> grown_shard").collect()
    assert moved and all(r.grown_shard in (2, 3) for r in moved)  # only into the subtree whose weight changed
    assert shard(none, tree).count() == 0


def test_fixity(spark):
    from terrasift.llm.fixity import audit, damaged, digests, leaves, levels, placed, records, replica_root, rotted, written

    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}</p>") for k in range(3000)] + [(None, None, None), (7, None, "twice")], "page_id long, url string, html string")
    stored = records(pages)
    same = audit(stored, stored)
    assert same.count() == 3002 and same.filter("status <> 'intact' OR file_differs OR replica_differs").count() == 0
    places = placed(digests(written(pages), rotted)).persist()
    want = {}
    for r in places.collect():
        k = -1 if r.page_id is None else r.page_id % 101
        if r.file == 0 and r.number in (2, 3):
            want[r.file, r.number] = "moved"
        elif k in (7, 11, 13):
            want[r.file, r.number] = {7: "corrupt", 11: "resized", 13: "missing"}[k]
    want[0, places.filter("file = 0").count()] = "extra"
    got = audit(stored, damaged(places)).collect()
    assert {(r.file, r.number): r.status for r in got if r.status != "intact"} == want and len(got) == 3003
    assert {(r.number, r.moved_to) for r in got if r.status == "moved"} == {(2, 3), (3, 2)}
    assert all(r.replica_differs for r in got) and {r.file for r in got if not r.file_differs} == {r.file for r in got if r.file < 0}
    root = lambda t: replica_root(levels(leaves(t), 3)[-1].select("file", "hash"))
    assert root(stored) == root(records(pages.repartition(7))) != root(damaged(places))
    assert audit(stored.limit(0), stored.limit(0)).count() == 0 and audit(stored, stored.limit(0)).filter("status = 'missing'").count() == 3002


def test_fixity_of_files_with_repeated_ids(spark):
    from terrasift.llm.fixity import audit, damaged, digests, placed, record_bytes, rotted, written

    same = spark.range(5000).select(F.lit(7).cast("long").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("t"), F.col("id") % 4700).alias("html"))
    null = spark.range(5000).select(F.lit(None).cast("long").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html"))
    few = spark.range(3).select((F.col("id") + 6).alias("page_id"), F.lit("u").alias("url"), F.lit("few").alias("html"))
    pages = same.unionByName(null).unionByName(few)
    stored = placed(digests(written(pages), rotted)).persist()
    want = sorted((r.page_id or 0, hashlib.sha256(r.x).hexdigest(), len(r.x)) for r in pages.select("page_id", record_bytes(F.col("page_id"), F.col("url"), F.col("html").cast("binary")).alias("x")).collect())
    files = {}
    for r in stored.collect():
        files.setdefault(r.file, []).append((r.number, r.offset, r.length, r.page_id or 0, r.digest))
    assert sorted(map(len, files.values())) == [5000, 5003] and sorted((r[3], r[4], r[2]) for rs in files.values() for r in rs) == want
    for rs in files.values():
        rs.sort()
        assert [r[0] for r in rs] == list(range(len(rs)))
        assert [r[1] for r in rs] == [0, *np.cumsum([r[2] for r in rs])[:-1].tolist()]
        assert [r[3:] for r in rs] == sorted(r[3:] for r in rs)
    got = audit(stored, damaged(stored, files=1 << 40)).collect()
    extra = sum(r.status == "extra" for r in got)
    assert extra == 1 and len(got) == 10004 and len({(r.file, r.number) for r in got}) == 10004
    assert {r.page_id for r in got if r.status == "corrupt"} == {7}


def test_media(docs, none):
    from terrasift.llm.media import chunked_media, chunks, cuts, wav

    joined = sorted(map(str, chunked_media(docs, most=0).collect()))
    assert joined == sorted(map(str, chunked_media(docs).collect()))  # with every chunk sent through the join, too
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in chunked_media(docs).collect()))
    want = []
    for d, t, *_ in rows():
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((d is None, d or 0, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(p) + 44, hashlib.sha256(wav(p)).hexdigest()))
    assert got == sorted(want)
    assert chunked_media(none).count() == 0
    media = wav(prose(8, 6000).encode())
    assert b"".join(c for _, c in chunks(media)) == media and len(cuts(media)) > 5
    shifted = wav(b"other start " + prose(8, 6000).encode())
    assert len({d for d, _ in chunks(media)} & {d for d, _ in chunks(shifted)}) > len(cuts(media)) // 2


def ngrams(t, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("n", "threshold", "most"), [(3, 90, 256), (5, 80, 4)])
def test_jaccard(spark, docs, none, n, threshold, most):
    from terrasift.llm.jaccard_join import jaccard_join

    rest = (None,) * 6
    extra = [(100 + k, " ".join(prose(500, 150).split()[: 150 - k]), *rest) for k in range(12)]
    extra += [((1 << 62) + 5, prose(77, 90), *rest), ((1 << 63) - 1, prose(77, 90) + " end", *rest), (-7, prose(78, 90), *rest)]
    extra += [(300 + k, " ".join(w if j != (k * 7) % 140 else f"odd{k}" for j, w in enumerate(prose(501, 150).split())), *rest) for k in range(30)]
    frame = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    data = [*rows(), *extra]
    sets = [ngrams(r[1], n) for r in data]
    up = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    least = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            least[up[k]] = min(r[0], least.get(up[k], r[0]))
    want = sorted(((r[0] is None, r[0] or 0, len(sets[k]), str(least.get(up[k]))) for k, r in enumerate(data)))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_shingles, str(r.component_id)) for r in jaccard_join(frame, n, threshold, most=most).collect()))
    assert got == want
    assert jaccard_join(none, n, threshold).count() == 0


def test_jaccard_repeated_rows_of_linked_texts(spark):
    from terrasift.llm.jaccard_join import jaccard_join

    text = prose(600, 150)
    data = [(i, t) for i, t in [(1, text), (2, text.rsplit(" ", 1)[0]), (None, text.rsplit(" ", 2)[0])] for _ in range(3)]
    got = jaccard_join(spark.createDataFrame(data, "doc_id long, text string"), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1)] * 3 + [(1, 1)] * 3 + [(2, 1)] * 3


def test_one_of_each(docs):
    from terrasift.llm.jaccard_join import one_of_each

    out = one_of_each(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sum(t == prose(1, 120) for _, t in kept) == 1 and (9, rows()[9][1]) in kept and 10 not in [d for d, _ in kept]
    assert [d for d, t in kept if not (t or "").strip()] != []
    same = docs.sparkSession.createDataFrame([(5, prose(70, 50)), (5, prose(70, 50) + " x"), (5, prose(71, 50)), (4, prose(72, 50)), (5, prose(72, 50))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == prose(72, 50)) for r in one_of_each(same).collect()) == [(4, True), (5, False), (5, False)]


def test_prefix_tree_is_exact():
    from terrasift.llm.jaccard_join import PrefixTree

    r = random.Random(1)
    for _ in range(60):
        t = r.choice([80, 90])
        bases = [r.sample(range(300), r.randint(4, 40)) for _ in range(4)]
        sets = []
        for _ in range(r.randint(2, 20)):
            s = set(r.choice(bases)) ^ set(r.sample(range(300), r.randint(0, 3)))
            sets.append(np.array(sorted(s or {1})))
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                o = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if 100 * o >= t * (len(sets[i]) + len(sets[j]) - o):
                    a, b = up[i], up[j]
                    up = [b if x == a else x for x in up]
        g = PrefixTree(sets, t).groups()
        assert all((up[i] == up[j]) == (g[i] == g[j]) for i in range(len(sets)) for j in range(i))


def brute_spans(data, least, words):
    token = re.compile(rb"[0-9a-z\x80-\xff]+")
    info, seen = [], {}
    for d, t in data:
        b = (t or "").encode()
        starts = [0] + [i for i in range(1, len(b)) if b[i - 1 : i] == b"\n" or (i >= 2 and b[i - 2] in b".!?" and b[i - 1] in b" \t\n\r\v\f")] if b else []
        cut = []
        for x, y in zip(starts, [*starts[1:], len(b)]):
            if cut and not b[x:y].strip(b" \t\n\r\v\f"):
                cut[-1] += b[x:y]
            else:
                cut.append(b[x:y])
        w = [token.findall(x.lower()) for x in cut]
        spans = set()
        for i in range(len(cut)):
            for j in range(i, len(cut)):
                if sum(map(len, w[i : j + 1])) >= words and j - i + 1 >= least:
                    spans.add((i, j))
                    break
            for j in range(i, -1, -1):
                if sum(map(len, w[j : i + 1])) >= words and i - j + 1 >= least:
                    spans.add((j, i))
                    break
            if len(w[i]) >= 2 * words:
                spans.add((i, i))
        info.append((cut, spans, w))
        for i, j in spans:
            seen.setdefault(tuple(sum(w[i : j + 1], [])), []).append((d, i, j, len(info) - 1))
    gone = [set() for _ in data]
    for places in seen.values():
        first = min(p[:2] for p in places)
        for d, i, j, k in places:
            if (d, i) != first:
                gone[k].update(range(i, j + 1))
    return [(d, b"".join(s for n, s in enumerate(info[k][0]) if n not in gone[k]).decode(), len(gone[k])) for k, (d, _) in enumerate(data)]


def test_spans(spark, docs, none):
    from terrasift.llm.span_dedup import dedup_spans

    own = [r for r in rows() if r[0] is not None and not (r[0] == 3 and r[1] != "!!!")]
    frame = spark.createDataFrame(own, SCHEMA)
    want = sorted(brute_spans([(r[0], r[1]) for r in own], 2, 25))
    for common, often in ((100_000, 1), (0, 32)):  # all broadcast, all joined
        got = sorted((r.doc_id, r.text or "", r.n_removed) for r in dedup_spans(frame, common=common, often=often).collect())
        assert got == want
    assert dedup_spans(frame, words=0).filter("n_removed > 0").count() >= sum(w[2] > 0 for w in want)
    assert next(r for r in got if r[0] == 13)[2] > 3  # the second copy of the passage
    out = dedup_spans(docs)
    assert out.count() == len(rows()) and out.columns[: len(docs.columns)] == docs.columns
    assert dedup_spans(none).count() == 0


def test_decontamination(spark, docs, none):
    from terrasift.llm.decontamination import clean, flagged, proximity, report

    long = rows()[8][1].split()
    items = [(1, " ".join(long[10:30])), (2, "two WORDS"), (3, None), (4, ""), (5, " ".join(long[40:53])), (6, "nowhere to be found at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    want = []
    for d, t, *_ in rows():
        w, hit, names = cut(t), set(), set()
        for i, x in items:
            v = cut(x)
            for s in range(max(1, len(v) - 12)) if v else ():
                win = v[s : s + 13]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit.update(range(k, k + len(win)))
                        names.add(str(i))
        want.append((d is None, d or 0, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for block in (None, 3):
        got = [(r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in flagged(report(docs, bench, block=block)).collect()]
        assert sorted(got) == sorted(want)
    assert clean(docs, bench).columns == docs.columns
    assert clean(docs, bench).count() == sum(not w[-1] for w in want)
    assert report(none, bench).count() == 0 and report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    test = ["alpha", "beta", "gamma", "delta"]
    r = random.Random(8)
    texts = [(k, " ".join(r.choice([*test, "and", "then"]) for _ in range(12))) for k in range(40)] + [(40, "alpha beta and then gamma delta")]
    found = {(x.doc_id, x.start) for x in proximity(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(test))], "item_id long, text string"), rare=4, slop=2).collect()}
    assert found == {(d, s) for d, t in texts for s in range(-9, 16) if all(any(w == x and abs(p - place - s) <= 2 for p, w in enumerate(t.split())) for place, x in enumerate(test))} and (40, 1) in found


def test_any_column_names(spark):
    """Extra columns that clash with results or need quoting."""
    from terrasift.llm import decontamination, jaccard_join, language_id, media, packing, quality, sharding, span_dedup, toxicity

    names = ["doc_id", "text", "a.b", "score", "n_removed", "id", "c0", "key", "n", "_score", "spans"]
    docs = spark.createDataFrame([(1, prose(1, 60), *"abcdefghi"), (2, prose(1, 60), *"abcdefghi"), (3, None, *"abcdefghi")], ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    bench = spark.createDataFrame([(1, prose(1, 60), "x")], "item_id long, text string, `a.b` string")
    scored = quality.score(docs, None)
    assert scored.columns == [n for n in names if n != "score"] + ["score"] and scored.first()["score"] == 0.5
    assert quality.accepted(docs, None, 0.3).columns == names and quality.accepted(docs, None, 0.6).count() == 0
    assert toxicity.score(docs, None, keep=("score", "a.b")).columns == ["doc_id", "a.b", "score", "n_toxic", "spans"]
    assert language_id.predict(docs, language_id.fit(docs.withColumnRenamed("id", "lang")), keep=("score", "a.b")).columns == ["doc_id", "a.b", "lang_pred", "score", "rejected"]
    assert span_dedup.dedup_spans(docs).columns == [n for n in names if n != "n_removed"] + ["n_sentences", "n_removed"]
    assert span_dedup.dedup_spans(docs, counts=False).columns == names
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == names and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    left = decontamination.clean(docs, bench)
    assert left.columns == names and [r.doc_id for r in left.collect()] == [3]
    for table in (packing.pieces(docs, TOKENIZER), media.chunked_media(docs), sharding.shard(docs, sharding.Tree.balanced(4)), jaccard_join.jaccard_join(docs), decontamination.report(docs, bench)):
        assert table.count() == 3


def test_shuffled_ways_equal_broadcast_ones(spark, docs, monkeypatch):
    """With no byte to broadcast, results stay."""
    from terrasift.llm import common, decontamination, jaccard_join

    bench = spark.createDataFrame([(1, " ".join(rows()[8][1].split()[10:80]))], "item_id long, text string")
    run = lambda: (sorted(map(str, jaccard_join.one_of_each(docs).collect())), sorted(map(str, decontamination.clean(docs, bench).collect())), sorted(map(str, decontamination.report(docs, bench).collect())))
    want = run()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert run() == want and len(want[1]) < len(rows())


def test_language(spark, docs, none):
    from terrasift.llm.language_id import fit, predict

    r = random.Random(3)
    langs = {"aa": "ka ro ti mu sen".split(), "bb": "ble tion ou eau ré".split()}
    data = [(k, " ".join("".join(r.choices(langs[n], k=3)) for _ in range(30)), n) for k, n in enumerate(["aa", "bb"] * 150)]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = fit(frame.filter("doc_id < 200"))
    got = predict(frame.filter("doc_id >= 200"), model, keep=("lang",)).collect()
    assert np.mean([x.lang == x.lang_pred for x in got]) > 0.98 and all(0 <= x.score <= 1 for x in got)
    odd = {x.doc_id: x for x in predict(docs.filter("doc_id IS NOT NULL"), model, reject=False).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == odd[2].lang_pred == "und" and odd[4].lang_pred in langs
    far = predict(spark.createDataFrame([(1, "日本語の文章です")], "doc_id long, text string"), model).first()
    assert far.lang_pred == "und" and far.rejected
    assert predict(none, model).count() == 0 and predict(docs, fit(none)).filter("lang_pred <> 'und'").count() == 0


def test_quality_and_toxicity(spark, docs, none):
    from terrasift.llm import quality, toxicity

    r = random.Random(4)
    data, labels = [], []
    for k in range(600):
        w = [r.choice(WORDS) for _ in range(60)]
        toxic, bad = k % 3 == 0, k % 4 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["vilest", "vilescum", "scumbag", "slur"])
        data.append((k, " ".join(w).upper() + "!!" if bad else " ".join(w) + ".", k))
        labels.append((k, int(not bad), int(toxic)))
    frame, marks = spark.createDataFrame(data, "doc_id long, text string, label long"), spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    q = quality.fit(frame, marks.filter("doc_id < 400"))
    got = {x.doc_id: x.score for x in quality.score(frame.filter("doc_id >= 400"), q).collect()}
    assert np.mean([(got[k] >= 0.3) == (k % 4 != 0) for k in got]) > 0.97
    t = toxicity.fit(frame, marks.filter("doc_id < 400"))
    got = {x.doc_id: x for x in toxicity.score(frame.filter("doc_id >= 400"), t).collect()}
    assert np.mean([(x.score >= 0.7) == (k % 3 == 0) for k, x in got.items()]) > 0.97
    hit = next(x for k, x in got.items() if k % 3 == 0 and x.spans)
    text = data[hit.doc_id][1].encode()
    assert re.match(rb"(?i)(vilest|vilescum|scumbag|slur)", text[hit.spans[0].start : hit.spans[0].end])
    for m, model in ((quality, q), (toxicity, t)):
        assert m.score(docs, model).count() == len(rows()) and m.score(none, model).count() == 0
        assert m.fit(none, marks) is None and m.score(docs, None).count() == len(rows())


def test_toxicity_learns_from_every_text_of_a_small_sample(spark, monkeypatch):
    from terrasift.llm import toxicity

    def least(word):
        data = word.encode()
        _, _, _, features, _ = toxicity.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        own = np.unique(features)
        return int(toxicity.mixed(own[own > 0] + np.uint64(99)).min())

    common = min((f"q{k}z" for k in range(3000)), key=least)  # unlike texts with this word share their smallest hash
    r = random.Random(7)
    data = [(k, " ".join([common, *r.sample(WORDS, 30), *(["vilest"] if k % 2 else [])])) for k in range(80)]
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda places_, begin, y, keys: seen.append((len(y), int(y.sum()))))
    toxicity.fit(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, toxic int"))
    assert seen == [(40 * 31 + 40 * 32, 40)]


def test_toxicity_does_not_depend_on_partitions(spark):
    from terrasift.llm import toxicity

    r = random.Random(9)
    data = [(k, " ".join([*r.sample(WORDS, 30), *(["vilest"] if k % 2 else [])])) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, toxic int")
    frame = spark.createDataFrame(data, "doc_id long, text string")
    one, two = (toxicity.fit(f, labels) for f in (frame.repartition(1), frame.repartition(5, "text")))
    assert np.array_equal(one.keys, two.keys) and np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_chain_marginals_by_enumeration():
    from itertools import product

    from terrasift.llm.toxicity import Chains, sigmoid

    rng = np.random.default_rng(5)
    emit, moves = rng.normal(size=6), rng.normal(size=(2, 2))
    begin = np.array([1, 0, 0, 0, 1, 0], bool)
    ahead, after = Chains(begin).forward_backward(emit, moves)
    for lo, hi in ((0, 4), (4, 6)):
        total, hot = 0.0, np.zeros(hi - lo)
        for y in product((0, 1), repeat=hi - lo):
            p = np.exp(sum(emit[lo + k] * v for k, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += p
            hot += p * np.array(y)
        assert np.allclose(sigmoid(ahead + after)[lo:hi], hot / total)


def test_factorisation_identity():
    from terrasift.llm.quality import Model

    rng = np.random.default_rng(6)
    x, v, w = rng.normal(size=(3, 7)), rng.normal(size=(7, 4)), rng.normal(size=7)
    m = Model(0.5, w, v, np.zeros(0), np.ones(0))
    plain = [0.5 + r @ w + sum(r[i] * r[j] * (v[i] @ v[j]) for i in range(7) for j in range(i)) for r in x]
    assert np.allclose(m.logits(x), plain)


def test_pipeline_by_brute_force(spark):
    """Each stage on what the one before it kept, against a plain version of it."""
    import corpus_pipeline as c

    from terrasift.llm import quality
    from terrasift.llm.common import id_remainder

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in c.STAGES] == ["quality", "near_duplicates", "passages", "decontamination", "packing"]
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet").filter(id_remainder("doc_id", 5) != 0))
    kept = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        x = quality.standard(quality.features(raw, np.array([0, len(raw)])), model.mean, model.scale)[0].astype(float)
        pairs = sum(((x @ model.pairs[:, f]) ** 2 - (x**2) @ (model.pairs[:, f] ** 2)) / 2 for f in range(quality.RANK))
        if 1 / (1 + math.exp(-max(-30, min(30, model.bias + x @ model.linear + pairs)))) >= c.LEAST_QUALITY:
            kept.append((r.doc_id, r.text))
    got = c.quality(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in kept)

    sets, up = [ngrams(t, 5) for _, t in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = up[i], up[j]
                up = [b if x == a else x for x in up]
    first = {}
    for k, (d, _) in enumerate(kept):
        first[up[k]] = min(d, first.get(up[k], d))
    kept = [(d, t) for k, (d, t) in enumerate(kept) if not sets[k] or first[up[k]] == d]
    got = c.near_duplicates(spark, got, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(d for d, _ in kept)

    kept = sorted((d, t) for d, t, _ in brute_spans(kept, 2, 25))
    got = c.passages(spark, got, sf)
    assert got.columns == docs.columns and sorted((r.doc_id, r.text or "") for r in got.collect()) == kept

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = {tuple(w[k : k + 13]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in [cut(r.text)] for k in range(max(1, len(w) - 12)) if w}
    sizes, clean = {len(w) for w in windows}, []
    for d, t in kept:
        w, hit = cut(t), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            clean.append(d)
    got = c.decontamination(spark, got, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == clean

    out = c.run(spark, sf)
    packed = out.collect()
    assert {r.doc_id for r in packed} == set(clean) and sorted(map(str, c.packing(spark, got, sf).drop("sequence_id", "offset").collect())) == sorted(map(str, out.drop("sequence_id", "offset").collect()))
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_word_hash_depends_on_the_word_alone():
    from terrasift.llm.common import span_hashes

    data = np.frombuffer(b"short " + b"y" * 300 + b" short", np.uint8)
    h = span_hashes(data, np.array([0, 6, 307]), np.array([5, 306, 312]))
    assert h[0] == h[2] == span_hashes(data, np.array([0]), np.array([5]))[0] != h[1]
