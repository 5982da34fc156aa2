"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, text_of, written


def normalised(name: str) -> Column:
    """The text with each run of `[\\x20\\x09-\\x0D]` replaced by one space.

    Single spaces, the usual case, need no replacement, so the pattern leaves them alone.
    """
    return F.regexp_replace(text_of(name), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


#: The filter of digests that stand more than once has 2**BITS bits: 2 MB.
BITS = 24


def _bit(key: str) -> tuple[Column, Column]:
    """Where a digest's bit stands: the number of a bitmap of 32,768 bits, and the place in it."""
    at = F.pmod(F.xxhash64(key), F.lit(1 << BITS))
    return F.floor(at / 32768).cast("long"), at % 32768


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256.

    Only 16-byte digests are shuffled to form groups; a hot group is one row a task after map-side
    aggregation. A second pass groups the texts of rows in groups of two or more by (digest, text), which
    compares their bytes and again sends one row for each distinct text and task; a bitmap of bounded size
    keeps all other texts out of that shuffle. Digests that stand for more than one text (collisions) are split by text.

    Null text counts as empty. Null ids sort after all others. Of rows that repeat with one id,
    exactly one is kept. An empty table gives an empty result; other columns are ignored.
    """
    key, rid, norm = P + "key", P + "rid", P + "norm"
    rows = docs.select(F.col(id_col).alias(P + "id"), normalised(text_col).alias(norm)).withColumn(key, F.unhex(content_hash(F.col(norm))))
    digests = written(rows.select(P + "id", key, F.unhex(F.sha2(norm, 256)).alias(P + "sha"), F.monotonically_increasing_id().alias(rid)), "digests")
    least = F.min(F.struct(F.col(P + "id").isNull().alias("none"), F.col(P + "id").alias("id"), F.col(rid).alias("rid"))).alias(P + "least")
    groups = written(digests.groupBy(key).agg(F.count("*").alias(P + "n"), least).filter(F.col(P + "n") > 1), "groups")

    bucket, bit = _bit(key)
    marks = groups.groupBy(bucket.alias(P + "bucket")).agg(F.bitmap_construct_agg(bit).alias(P + "bits"))
    # 2**BITS bits at most, whatever the input: a row whose bit is not set has no equal. Where keys share a bit, a text
    # takes part for nothing.
    marked = rows.withColumn(P + "at", bucket).join(F.broadcast(marks.withColumnRenamed(P + "bucket", P + "at")), P + "at")
    byte = F.conv(F.hex(F.substring(F.col(P + "bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = marked.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))) > 0)
    variants = marked.groupBy(key, norm).agg(F.count("*").alias(P + "n"))
    collided = written(variants.groupBy(key).agg(F.count("*").alias(P + "v")).filter(F.col(P + "v") > 1), "collided")

    same = digests.join(groups, key, "left")
    out = _result(same, id_col)
    if collided.isEmpty():
        return out
    # Rows of one digest and different bytes: the groups are formed by the text itself.
    texts = docs.select(F.col(id_col).alias(P + "id"), normalised(text_col).alias(norm))
    split = texts.withColumn(key, F.unhex(content_hash(F.col(norm)))).join(collided.select(key), key, "left_semi")
    split = written(split.select("*", F.unhex(F.sha2(norm, 256)).alias(P + "sha"), F.monotonically_increasing_id().alias(rid)), "split")
    own = split.groupBy(key, norm).agg(F.count("*").alias(P + "n"), least)
    clear = _result(same.join(collided.select(key), key, "left_anti"), id_col)
    return clear.unionByName(_result(split.join(own, [key, norm], "left"), id_col))


def _result(joined: DataFrame, id_col: str) -> DataFrame:
    n, least, me = F.col(P + "n"), F.col(P + "least"), F.col(P + "id")
    return joined.select(
        me.alias(id_col),
        F.when(n.isNull(), me).otherwise(least["id"]).alias("keep_id"),
        F.coalesce(n, F.lit(1)).cast("long").alias("group_size"),
        F.when(n.isNull(), F.lit(True)).otherwise(least["rid"] == F.col(P + "rid")).alias("kept"),
        F.lower(F.hex(F.col(P + "sha"))).alias("text_sha256"),
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
