"""Merkle fixity audit of WARC records.

Pages become WARC records that lie one after another in files; a record's leaf is the SHA-256 of its place, length and
bytes. Ordered runs of `fanout` leaves make a node, runs of nodes the next level, up to a root for each file and one for
the replica. An audit compares the replicas' roots first; if they differ it goes down from the files' roots, joining only
the children of nodes that differ at the next level, and ends at the records that are damaged, missing, extra or moved.

Digests are taken where the pages are read, so some 100 bytes of each record are moved, never its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, joined, numbered_in_order

#: Ids that share a file; with distinct ids a bound on its records.
FILE_IDS = 1024
#: Records up to which one task numbers a file.
FILE_ROWS = 4096
FANOUT = 16
#: Date of every record, so that the same pages give the same bytes.
DATE = "1970-01-01T00:00:00Z"


def record_bytes(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC/1.1 resource record around a body of bytes."""
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def written(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """page_id, file, record (bytes) of the pages, in no order.

    File f holds ids f * file_ids to (f + 1) * file_ids - 1; null ids are spread over negative files by their content. Null
    urls and bodies are empty, texts of any length are taken whole, other columns are ignored.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    lost = -1 - F.pmod(F.xxhash64("url", "body"), F.lit(1 << 20))
    return rows.select("page_id", F.coalesce(F.floor(F.col("page_id") / F.lit(file_ids)).cast("long"), lost).alias("file"), record_bytes(F.col("page_id"), F.col("url"), F.col("body")).alias("record"))


def digests(rows: DataFrame, damage=None) -> DataFrame:
    """page_id, file, length, digest of written records, and other_length, other_digest of what damage(page_id, record) makes of them."""
    other = damage(F.col("page_id"), F.col("record")) if damage else F.col("record")
    both = rows.select("page_id", "file", "record", other.alias("other"))
    return both.select("page_id", "file", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), F.octet_length("other").cast("long").alias("other_length"), F.sha2("other", 256).alias("other_digest"))


def placed(rows: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """rows (page_id, file, length, digest, ...) with number and offset: records of a file follow one another by id, then digest.

    Equal rows each get a place. A file of more than file_rows records, where ids repeat, is numbered by ranges of its order
    instead of in one task.
    """
    rows = checkpoint(rows)
    large = checkpoint(rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > file_rows).select("file"))
    some = bool(large.head(1))
    order = Window.partitionBy("file").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    small = joined(rows, large, "file", "left_anti", 16) if some else rows
    out = small.withColumn("number", (F.row_number().over(order) - 1).cast("long")).withColumn("offset", before)
    if some:
        out = out.unionByName(numbered_in_order(joined(rows, large, "file", "left_semi", 16), "file", ["page_id", "digest"], "number", add="length", total="offset"))
    return out


def records(pages: DataFrame, file_ids: int = FILE_IDS, file_rows: int = FILE_ROWS) -> DataFrame:
    """page_id, file, number, offset, length, digest: where each page's record stands, and its SHA-256. An empty table has none."""
    return placed(digests(written(pages, file_ids)), file_rows).select("page_id", "file", "number", "offset", "length", "digest")


def leaves(stored: DataFrame) -> DataFrame:
    """file, number, page_id, offset, length, digest and the leaf's hash: of place, length and the record's SHA-256."""
    return stored.select("file", "number", "page_id", "offset", "length", "digest", F.sha2(F.concat_ws(" ", "number", "offset", "length", "digest").cast("binary"), 256).alias("hash"))


def above(level: DataFrame, by: list[str], fanout: int) -> DataFrame:
    """The nodes (by, node, hash) over a level: each joins up to `fanout` hashes, each with its index."""
    up = level.groupBy(*by, F.floor(F.col("node") / F.lit(fanout)).cast("long").alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))
    text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"])), ",")
    return up.select(*by, F.col("up").alias("node"), F.sha2(text.cast("binary"), 256).alias("hash"))


def levels(tree: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, node, hash) from the leaves up to one node a file; each level is written down once."""
    out = [tree.select("file", F.col("number").alias("node"), "hash")]
    for _ in range(height):
        out.append(checkpoint(above(out[-1], ["file"], fanout)))
    return out


def replica_root(files: DataFrame, fanout: int = 1024) -> str:
    """The root over files' roots (file, hash), joined in runs of `fanout` at each of so many levels that 2**63 files fit."""
    level = files.select(F.col("file").alias("node"), "hash")
    for _ in range(7):
        level = above(level, [], fanout)
    return level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ",").cast("binary"), 256)).first()[0]  # two rows at most


def audit(good: DataFrame, other: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Compares two replicas (columns of `records`): a row for each record of either.

    status: intact, moved (its bytes stand at another damaged place of the file, moved_to), missing (from other), extra (in
    other), resized (other length) or corrupt. good_root and other_root are those of its file (null where the replica lacks
    the file), file_differs says whether they do, replica_differs whether the replicas' roots do. Empty replicas give no
    rows; a replica that is empty lacks all. Other columns are ignored.
    """
    a, b = checkpoint(leaves(good)), checkpoint(leaves(other))
    last = a.select("number").unionByName(b.select("number")).agg(F.max("number")).first()[0]
    height = 1
    while fanout**height < (last or 0) + 1:  # one top node for the largest file
        height += 1
    ours, theirs = levels(a, height, fanout), levels(b, height, fanout)
    differs = replica_root(ours[height]) != replica_root(theirs[height])
    wrong = None
    for depth in range(height, -1, -1):
        x, y = ours[depth], theirs[depth].withColumnRenamed("hash", "hash2")
        if not differs:  # equal roots: nothing is looked at below
            x, y = x.limit(0), y.limit(0)
        if wrong is not None:  # only branches below a mismatch
            branch = wrong.select("file", F.col("node").alias("up"))
            up = F.floor(F.col("node") / F.lit(fanout)).cast("long")
            x, y = (z.withColumn("up", up).join(branch, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        wrong = checkpoint(x.join(y, ["file", "node"], "full_outer").filter(~F.col("hash").eqNullSafe(F.col("hash2"))).select("file", "node"))
    bad = wrong.select("file", F.col("node").alias("number"))
    lost = a.join(bad, ["file", "number"], "left_semi").select("file", "number", "digest")
    now = b.join(bad, ["file", "number"], "left_semi").groupBy("file", "digest").agg(F.min("number").alias("moved_to"))
    bad = bad.join(lost.join(now, ["file", "digest"]).filter("moved_to <> number").select("file", "number", "moved_to"), ["file", "number"], "left").withColumn("bad", F.lit(True))
    roots = ours[height].select("file", F.col("hash").alias("good_root")).join(theirs[height].select("file", F.col("hash").alias("other_root")), "file", "full_outer")
    both = a.drop("hash").join(b.select("file", "number", F.col("page_id").alias("page_id2"), F.col("digest").alias("other_digest"), F.col("offset").alias("offset2"), F.col("length").alias("length2")), ["file", "number"], "full_outer")
    both = both.join(bad, ["file", "number"], "left").join(roots, "file", "left")
    status = F.when(F.col("bad").isNull(), "intact").when(F.col("moved_to").isNotNull(), "moved").when(F.col("other_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("length") != F.col("length2"), "resized").otherwise("corrupt")
    mismatch = ~F.col("good_root").eqNullSafe(F.col("other_root"))
    return both.select(F.coalesce("page_id", "page_id2").alias("page_id"), "file", "number", F.coalesce("offset", "offset2").alias("offset"), F.coalesce("length", "length2").alias("length"), "digest", "other_digest", status.alias("status"), "moved_to", mismatch.alias("file_differs"), F.lit(differs).alias("replica_differs"), "good_root", "other_root")


def rotted(page_id: Column, record: Column, every: int = 101) -> Column:
    """Known damage to bytes: the last one changes in records whose id leaves 7 modulo `every`, ten are lost where it leaves 11."""
    k = F.coalesce(F.pmod(page_id, F.lit(every)), F.lit(0))
    part = lambda n: F.substring(record, F.lit(1), F.octet_length(record) - n)
    return F.when(k == 7, F.concat(part(1), F.lit("X").cast("binary"))).when(k == 11, part(10)).otherwise(record)


def damaged(stored: DataFrame, every: int = 101, files: int = 50) -> DataFrame:
    """A replica with known damage, from placed rows with other_length and other_digest: those bytes, without the records whose
    id leaves 13 modulo `every`; in files whose number `files` divides, records 2 and 3 exchanged and one more at the end."""
    marked = F.pmod("file", F.lit(files)) == 0
    swap = stored.filter(marked & F.col("number").isin(2, 3)).groupBy("file").agg(F.min("offset").alias("first"), F.max(F.when(F.col("number") == 3, F.col("other_length"))).alias("by")).filter("by IS NOT NULL")
    rows = stored.join(swap, "file", "left")
    turned = F.col("by").isNotNull() & F.col("number").isin(2, 3)
    place = F.when(turned, 5 - F.col("number")).otherwise(F.col("number"))
    offset = F.when(turned & (F.col("number") == 3), F.col("first")).when(turned, F.col("first") + F.col("by")).otherwise(F.col("offset"))
    rows = rows.filter(F.coalesce(F.pmod("page_id", F.lit(every)), F.lit(0)) != 13)
    rows = rows.select("page_id", "file", place.cast("long").alias("number"), offset.alias("offset"), F.col("other_length").alias("length"), F.col("other_digest").alias("digest"))
    more = stored.filter(marked).groupBy("file").agg((F.max("number") + 1).alias("number"), F.sum("length").alias("offset"))
    more = more.select(F.lit(None).cast("long").alias("page_id"), "file", "number", "offset", F.lit(5).cast("long").alias("length"), F.sha2(F.lit("extra").cast("binary"), 256).alias("digest"))
    return rows.unionByName(more)
