"""Queries over the tables for each operator of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder
    from .language_id import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(id_remainder("doc_id", 5) != 0))
    out = predict(docs.select("doc_id", "text"), model, reject=False)
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import Tree, shard

    tree = Tree.balanced(40)
    return shard(table(spark, sf_dir, "documents"), tree, tree.grown()).withColumn("law", F.lit("key"))


def op4_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, against a replica with known damage: other bytes, lost bytes, lost, exchanged and added records."""
    from .common import checkpoint
    from .fixity import audit, damaged, digests, placed, rotted, written

    stored = checkpoint(placed(digests(written(table(spark, sf_dir, "pages")), rotted)))
    return audit(stored, damaged(stored))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import chunked_media

    return chunked_media(table(spark, sf_dir, "documents"))


def op6_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"), n=3, threshold=90)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder
    from .toxicity import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 3) != 1))
    out = score(docs, model)
    return out.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_toxic", "spans")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without its repeated passages."""
    from .span_dedup import dedup_spans

    return dedup_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import flagged, report

    return flagged(report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("items")


def op10_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import id_remainder
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: Merkle levels by string_agg; statuses come from comparing every place.
OP4_SQL = """
WITH r AS (
  SELECT page_id, page_id // 1024 AS file,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
         || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
         || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head,
         coalesce(html, '') AS body, chr(13) || chr(10) || chr(13) AS tail
  FROM pages),
d AS (SELECT page_id, file, strlen(head || body || tail) + 1 AS length, sha256(head || body || tail || chr(10)) AS digest,
         CASE WHEN page_id % 101 = 11 THEN strlen(head || body || tail) - 9 ELSE strlen(head || body || tail) + 1 END AS length2,
         CASE WHEN page_id % 101 = 11 THEN sha256(CASE WHEN strlen(body) >= 6 THEN decode(encode(head || body)[1:strlen(head || body) - 6]) ELSE substr(head || body || tail || chr(10), 1, length(head || body || tail) - 9) END)
              WHEN page_id % 101 = 7 THEN sha256(head || body || tail || 'X') ELSE sha256(head || body || tail || chr(10)) END AS digest2 FROM r),
n AS (SELECT *, row_number() OVER w - 1 AS number, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id, digest)),
s AS (SELECT file, min("offset") AS first, max(length2) FILTER (number = 3) AS gain FROM n WHERE file % 50 = 0 AND number IN (2, 3) GROUP BY file HAVING max(length2) FILTER (number = 3) IS NOT NULL),
o AS (SELECT page_id, n.file, CASE WHEN gain IS NOT NULL AND number IN (2, 3) THEN 5 - number ELSE number END AS number,
         CASE WHEN gain IS NOT NULL AND number = 3 THEN first WHEN gain IS NOT NULL AND number = 2 THEN first + gain ELSE "offset" END AS "offset", length2 AS length, digest2 AS digest
      FROM n LEFT JOIN s ON n.file = s.file WHERE page_id % 101 <> 13
      UNION ALL SELECT NULL, file, max(number) + 1, sum(length)::BIGINT, 5, sha256('extra') FROM n WHERE file % 50 = 0 GROUP BY file),
k AS (SELECT CASE WHEN max(number) < 16 THEN 1 WHEN max(number) < 256 THEN 2 ELSE 3 END AS height FROM (SELECT number FROM n UNION ALL SELECT number FROM o)),
a0 AS (SELECT 'a' AS side, file, number AS node, sha256(concat_ws(' ', number, "offset", length, digest)) AS h FROM n UNION ALL SELECT 'b', file, number, sha256(concat_ws(' ', number, "offset", length, digest)) FROM o),
a1 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(node || ':' || h, ',' ORDER BY a0.node)) AS h FROM a0 GROUP BY side, file, a0.node // 16),
a2 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(node || ':' || h, ',' ORDER BY a1.node)) AS h FROM a1 GROUP BY side, file, a1.node // 16),
a3 AS (SELECT side, file, node // 16 AS node, sha256(string_agg(node || ':' || h, ',' ORDER BY a2.node)) AS h FROM a2 GROUP BY side, file, a2.node // 16),
top AS (SELECT side, file, h FROM a1, k WHERE height = 1 UNION ALL SELECT side, file, h FROM a2, k WHERE height = 2 UNION ALL SELECT side, file, h FROM a3, k WHERE height = 3),
f AS (SELECT file, max(h) FILTER (side = 'a') AS good_root, max(h) FILTER (side = 'b') AS other_root FROM top GROUP BY file),
j AS (SELECT coalesce(n.page_id, o.page_id) AS page_id, file, number, coalesce(n."offset", o."offset") AS "offset", coalesce(n.length, o.length) AS length, n.length AS l1, o.length AS l2, n.digest AS digest, o.digest AS other_digest,
        n.digest IS DISTINCT FROM o.digest OR n."offset" IS DISTINCT FROM o."offset" OR n.length IS DISTINCT FROM o.length AS bad FROM n FULL JOIN o USING (file, number)),
m AS (SELECT file, other_digest AS digest, min(number) AS moved_to FROM j WHERE bad AND other_digest IS NOT NULL GROUP BY file, other_digest),
x AS (SELECT j.*, CASE WHEN bad AND m.moved_to <> number THEN m.moved_to END AS moved_to FROM j LEFT JOIN m ON j.bad AND j.file = m.file AND j.digest = m.digest)
SELECT page_id, file, number, "offset", length, digest, other_digest,
       CASE WHEN NOT bad THEN 'intact' WHEN moved_to IS NOT NULL THEN 'moved' WHEN other_digest IS NULL THEN 'missing' WHEN digest IS NULL THEN 'extra' WHEN l1 <> l2 THEN 'resized' ELSE 'corrupt' END AS status,
       moved_to, good_root IS DISTINCT FROM other_root AS file_differs, (SELECT bool_or(good_root IS DISTINCT FROM other_root) FROM f) AS replica_differs, good_root, other_root
FROM x JOIN f USING (file)
"""


def _tree_sql() -> str:
    """Draws of every node of the two trees of op3 by its name; the smallest -ln(u) / weight among siblings wins."""
    from .sharding import Tree

    tree = Tree.balanced(40)
    rows, first = [], 0
    for r, region in enumerate(tree.grown().regions):
        total = sum(sum(rack) for rack in region)
        for k, rack in enumerate(region):
            rows += [(r, float(total), k, float(sum(rack)), s, float(w), first + s) for s, w in enumerate(rack)]
            first += len(rack)
    return ", ".join(f"({r}, {a}::DOUBLE, {k}, {b}::DOUBLE, {s}, {c}::DOUBLE, {n})" for r, a, k, b, s, c, n in rows)


#: CRC-32 is folded over the bytes of each text with its public table.
OP3_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
b AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, strlen(text) + 16 AS size, coalesce(doc_id::VARCHAR, 'null') AS key,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT)),
            lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1])::BIGINT), 4294967295) AS text_crc32 FROM b, crc),
n AS (SELECT * FROM (VALUES {nodes}) v(r, rw, k, kw, s, sw, shard)),
u AS (SELECT DISTINCT name FROM (SELECT r::VARCHAR AS name FROM n UNION ALL SELECT r || '/' || k FROM n UNION ALL SELECT r || '/' || k || '/' || s FROM n)),
d AS (SELECT key, name, -ln((('0x' || substr(md5(key || '/' || name), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS e FROM (SELECT DISTINCT key FROM c), u),
p AS (SELECT key, g, arg_min(r, (e / rw, r)) AS r FROM d JOIN (SELECT DISTINCT r, rw, g FROM n, (VALUES (0), (1)) q(g) WHERE g = 1 OR shard < 40) ON name = r::VARCHAR GROUP BY key, g),
q AS (SELECT p.key, g, p.r, arg_min(k, (e / kw, k)) AS k FROM p JOIN (SELECT DISTINCT r, k, kw FROM n) x ON x.r = p.r JOIN d ON d.key = p.key AND d.name = x.r || '/' || x.k GROUP BY p.key, g, p.r),
w AS (SELECT q.key, g, arg_min(shard, (e / sw, s)) AS shard FROM q JOIN n ON n.r = q.r AND n.k = q.k JOIN d ON d.key = q.key AND d.name = n.r || '/' || n.k || '/' || n.s GROUP BY q.key, g),
z AS (SELECT c.*, a.shard AS shard, h.shard AS grown_shard FROM c JOIN w a ON a.key = c.key AND a.g = 0 JOIN w h ON h.key = c.key AND h.g = 1)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM z
"""


#: Words by position and windows as lists, joined on the whole window.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS phrase FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM v),
p AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
m AS (SELECT DISTINCT doc_id, item, i, size FROM p JOIN v USING (size, phrase)),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("\\\\", "\\")


#: Every pair that shares a shingle is counted; components by recursion over the links.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS class FROM s GROUP BY doc_id),
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id FROM k),
r AS (SELECT s.* FROM s JOIN c USING (doc_id) WHERE doc_id = class_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 90 * (a.n + b.n - o)),
e AS (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
t AS (SELECT u, v FROM e UNION SELECT t.u, e.v FROM t JOIN e ON t.v = e.u),
m AS (SELECT u, least(u, min(v)) AS root FROM t GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, coalesce(root, class_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m ON m.u = c.class_id
""".replace("\\\\", "\\")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_hash_tree_sharding": OP3_SQL.replace("{nodes}", _tree_sql()), "op4_merkle_fixity": OP4_SQL, "op6_prefix_tree_join": OP6_SQL, "op9_inverted_index": OP9_SQL}
