"""What the text operators share: checkpoints, vectorised word hashing over Arrow batches, numbering without hot tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import checkpoint_dir, saved, saved_bytes

U64 = np.uint64
#: Bytes of text that one vectorised step takes at most (a longer text is one step of its own).
SLICE_BYTES = 1 << 20
#: Bytes up to which a side may be broadcast, by its counted rows and the bytes of one; beyond it callers shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes up to which an intermediate table is one partition (`gathered`).
GATHER_BYTES = 4 << 20
#: Bits of a bloom filter of keys: at least 8 for each key, and so many (32 MB) at most.
BLOOM_BITS = 1 << 28


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder, cuts its lineage, and lets Spark drop shuffle files no longer needed.

    The files go when the last DataFrame built on them goes, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    out = saved(df)
    release(df.sparkSession)
    return out


def gathered(df: DataFrame) -> DataFrame:
    """As checkpoint; a table of GATHER_BYTES at most is read as one partition, whatever the number of shuffle partitions.

    What follows on such tables alone is then one task and no shuffle: each task costs the driver memory (what it keeps of
    stages that are done), however few rows it has. Larger tables stay dealt as they are.
    """
    out = saved(df)
    release(df.sparkSession)
    return out.coalesce(1) if saved_bytes(out) <= GATHER_BYTES else out


def release(spark: SparkSession) -> None:
    """Has the driver notice plans that are out of use, so that Spark deletes their shuffle files from the executors."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library can; freed arrays of some KB stay with it otherwise."""
    gc.collect()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def small_enough(df: DataFrame, row_bytes: int) -> bool:
    """Whether df, already materialised and of about so many bytes a row, is small enough to be broadcast."""
    return df.count() * row_bytes <= BROADCAST_BYTES


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str, row_bytes: int = 40) -> DataFrame:
    """Joins with right broadcast if its checked size allows, by a shuffle otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, row_bytes) else right, on, how)


def parted(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be among keys (already materialised), and those whose key isn't; together they are all.

    A bloom filter of BLOOM_BITS at most is broadcast, however many keys there are, so that wide rows need not be
    shuffled only to find that they have no partner. df is read twice and must give the same rows each time.
    """
    bits = 1 << 18
    while bits < min(8 * keys.count(), BLOOM_BITS):
        bits *= 2
    place = F.pmod(F.xxhash64(*on), F.lit(bits)) + 1
    one = keys.select(place.alias("h")).select(F.bitmap_bucket_number("h").alias("_bucket"), F.bitmap_bit_position("h").alias("_bit"))
    table = checkpoint(one.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits")))  # bits / 32768 rows of 4 KB
    at = df.withColumn("_h", place).withColumn("_bucket", F.bitmap_bucket_number("_h")).withColumn("_bit", F.bitmap_bit_position("_h").cast("int"))
    at = at.join(F.broadcast(table), "_bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, _bit div 8 + 1, 1)")), 16, 10).cast("int")
    at = at.withColumn("_maybe", F.coalesce(F.getbit(byte, F.col("_bit") % 8) == 1, F.lit(False)))
    return at.filter("_maybe").select(*df.columns), at.filter("NOT _maybe").select(*df.columns)


def picked(df: DataFrame, keys: DataFrame, on: list[str], row_bytes: int) -> DataFrame:
    """The inner join of df with keys (already materialised): broadcast if small, else behind a bloom filter and a shuffle."""
    if small_enough(keys, row_bytes):
        return df.join(F.broadcast(keys), on)
    return parted(df, keys, on)[0].join(keys, on)


def positional(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by place, so that no name clashes or needs quoting."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def at_column(df: DataFrame, name: str) -> Column:
    """The column of `positional(df)` that df calls name; the first of several."""
    return F.col(f"c{df.columns.index(name)}")


def id_remainder(name: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % by


def numbered(df: DataFrame, group: str, order: Sequence[str], out: str, salts: int) -> DataFrame:
    """Adds a number from 0, without gaps, to the rows of each group; no task holds a whole group.

    Rows are dealt by (group, salt), the salt being a hash of the order columns; each part is numbered by itself and
    then moved up by the counts of the parts before it. df is read twice and must give the same rows each time. A null
    group would be lost: callers pass none.
    """
    salt = F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    df = df.withColumn("_salt", salt)
    counts = df.groupBy(group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each group and salt: bounded by groups times salts, whatever the number of rows
    before = Window.partitionBy(group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(part).cast("long") - 1)
    # both sides are dealt by (group, salt), so the rows don't move again; the counts grow with the salts: no broadcast
    out_rows = ranked.join(starts, [group, "_salt"])
    return out_rows.select(*[c for c in df.columns if c != "_salt"], (F.col("_rank") + F.col("_before")).alias(out))


def numbered_in_order(df: DataFrame, group: str, order: Sequence[str], out: str, add: str | None = None, total: str = "_total") -> DataFrame:
    """Adds to rows their number from 0 in each group by order, and with `add` as `total` the sum of that column before them.

    As a window over each group would, but by ranges of the order, so that no task holds a whole group. Equal rows are told
    apart by where they come from; which of them is first makes no difference. Null groups are a group.
    """
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_tie")
    dealt = checkpoint(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_add", F.col(add) if add else F.lit(0).cast("long")))
    # one row for each group and range
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum("_add").alias("_s"))
    parts = parts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s"))
    within = Window.partitionBy(group, "_part").orderBy(*order, "_tie")
    earlier = F.coalesce(F.sum("_add").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn(out, (F.row_number().over(within) - 1).cast("long")).withColumn(total, earlier)
    ranked = ranked.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn(out, F.col(out) + F.col("_n")).withColumn(total, F.col(total) + F.col("_s"))
    return ranked.select(*df.columns, out, *([total] if add else []))


# --- Arrow batches -------------------------------------------------------------------------------------------------


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow where make() runs once for each task and gives the function for its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows and (out := step(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the rows' offsets in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most so many bytes together; a longer text is alone."""
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end
        row = end


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans, true in the closed ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Bytes of words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, once A-Z are lower case.
LOWER_WORD = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers by place in a word: a multilinear hash modulo 2**64.
PLACES = np.random.default_rng(20240501).integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the rising, disjoint spans of bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(total, dtype=np.int64) - np.repeat(first, lengths)
    values = data[np.repeat(starts, lengths) + place].astype(U64) + U64(1)
    weights = PLACES[place & 63]
    far = np.flatnonzero(place > 63)  # beyond the table, and nowhere else: a word's hash must not depend on its neighbours
    if len(far):
        weights[far] = mixed(weights[far] + (place[far] >> 6).astype(U64)) | U64(1)
    return mixed(np.add.reduceat(values * weights, first) + lengths.astype(U64))


def word_spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that lie one after another, and the index of each row's first word (one more at the end)."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n words in a row and their rows' offsets; a row of fewer words, but not none, has its whole sequence as one."""
    count = np.diff(first)
    sizes = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(int(at[-1]), U64)
    long = count >= n
    if long.any():
        places = np.arange(len(out)) - np.repeat(at[:-1], sizes)
        keep = np.repeat(long, sizes)
        where = (np.repeat(first[:-1], sizes) + places)[keep]
        value = np.full(len(where), n, U64)
        for k in range(n):
            value = mixed(value * U64(0x9FB21C651E98DF25) + words[where + k])
        out[keep] = value
    for row in np.flatnonzero((count > 0) & ~long):
        value = np.full(1, count[row], U64)
        for k in range(first[row], first[row + 1]):
            value = mixed(value * U64(0x9FB21C651E98DF25) + words[k : k + 1])
        out[at[row]] = value[0]
    return out, at


def per_row(values: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield values[a:b]


def list_array(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the values between offsets."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
