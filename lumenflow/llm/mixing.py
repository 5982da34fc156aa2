"""Mixing sources to target weights with repetition rates and a hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import P, text_of, written

#: Candidate seeds of a source's draw: the one whose words come nearest to the target is used.
SEEDS = 16


def word_count(name: str) -> Column:
    return F.regexp_count(text_of(name), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _draw(id_col: str) -> Column:
    """32 bits of the id's hash."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")


def _copies(whole: Column, bound: Column, draw: Column, seed: Column | int) -> Column:
    turned = (draw + (F.lit(seed) if isinstance(seed, int) else seed).cast("long") * F.lit(2**32 // SEEDS)) % F.lit(2**32)
    return whole + F.when(turned < bound, 1).otherwise(0)


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias(P + "id"), F.col(source_col).alias(P + "source"), word_count(text_col).alias(P + "size"), _draw(id_col).alias(P + "u")), "sizes")


def repetition_rates(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """A row per source: its size, target, whole copies, bound of the draw and chosen seed.

    Targets: `share` of all sizes goes to the sources by weight; a target stops at `most` times its
    source's size and the excess is reshared by weight. In order of size/weight the sources that stop
    form a prefix, so the fill level is a running sum over the one row that each source has.
    """
    source, size, n = P + "source", P + "size", len(weights)
    per = sizes.groupBy(source).agg(F.sum(size).alias(P + "total"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % n + 1).cast("int")).cast("long")
    per = per.withColumn(P + "w", weight).withColumn(P + "cap", F.col(P + "total") * F.lit(float(most)))
    order = Window.orderBy(F.col(P + "cap") / F.col(P + "w"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    all_words, all_weights = F.sum(P + "total").over(everything), F.sum(P + "w").over(everything)
    level = (all_words * F.lit(float(share)) - F.coalesce(F.sum(P + "cap").over(before), F.lit(0.0))) / (all_weights - F.coalesce(F.sum(P + "w").over(before), F.lit(0)))
    per = per.withColumn(P + "level", level).withColumn(P + "stops", F.col(P + "cap") <= F.col(P + "w") * F.col(P + "level"))
    free = F.max(F.when(~F.col(P + "stops"), F.col(P + "level"))).over(everything)
    target = F.when(F.col(P + "stops"), F.col(P + "cap")).otherwise(F.col(P + "w") * free)
    rate = F.when(F.col(P + "total") > 0, F.col(P + "target") / F.col(P + "total")).otherwise(F.lit(0.0))
    per = per.withColumn(P + "target", target).withColumn(P + "whole", F.floor(rate).cast("long"))
    per = per.withColumn(P + "bound", F.floor((rate - F.floor(rate)) * F.lit(float(2**32))).cast("long"))
    per = written(per.select(source, P + "total", P + "target", P + "whole", P + "bound"), "targets")
    # One more aggregate, a row for each source and task: the words that each candidate seed would take.
    both = sizes.join(per.withColumnRenamed(source, P + "s"), F.col(source).eqNullSafe(F.col(P + "s")))
    took = both.groupBy(P + "s").agg(*[F.sum(F.col(size) * _copies(F.col(P + "whole"), F.col(P + "bound"), F.col(P + "u"), k)).alias(f"{P}took{k}") for k in range(SEEDS)])
    took = took.withColumnRenamed(P + "s", P + "s2")
    per = per.join(took, F.col(source).eqNullSafe(F.col(P + "s2")))
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"{P}took{k}") - F.col(P + "target")).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)]))["seed"]
    return written(per.select(source, P + "total", P + "target", P + "whole", P + "bound", best.alias(P + "seed")), "rates")


def _with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """The rates table has a row per source; the optimizer broadcasts it only if its written size is small."""
    rates = rates.withColumnRenamed(P + "source", P + "s")
    joined = rows.join(rates, F.col(P + "source").eqNullSafe(F.col(P + "s")))
    return joined.withColumn(P + "copies", _copies(F.col(P + "whole"), F.col(P + "bound"), F.col(P + "u"), F.col(P + "seed")).cast("int"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """How often each document is taken: id, source, size, source_size, target, copies, taken.

    A null source is a source of its own, last in order; null text has size 0; a source without words takes
    nothing. Rows that repeat an id draw alike; of seeds that come equally near the first is used. Very long texts
    count by their words. An empty table gives an empty result; other columns are ignored.
    """
    sizes = _sizes(docs, id_col, text_col, source_col)
    mixed = _with_copies(sizes, repetition_rates(sizes, **how))
    return mixed.select(
        F.col(P + "id").alias(id_col), F.col(P + "source").alias(source_col), F.col(P + "size").alias("size"), F.col(P + "total").alias("source_size"),
        F.col(P + "target").alias("target"), F.col(P + "copies").alias("copies"), (F.col(P + "size") * F.col(P + "copies")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mixed documents: every row of docs as often as the mix takes it, with all its columns, whatever their names.

    Null, empty and very long texts, null sources, rows that repeat and empty tables are as in mix_plan; a text without
    words is taken as its source's rate says, none at all where its source has no words.
    """
    rates = repetition_rates(_sizes(docs, id_col, text_col, source_col), **how)
    rows = docs.select("*", F.col(source_col).alias(P + "source"), _draw(id_col).alias(P + "u"))
    drawn = _with_copies(rows, rates).filter(F.col(P + "copies") > 0)
    return drawn.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(P + "copies"))).alias(P + "copy")).drop(P + "copy")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS u FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS total, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, total * 2.0::DOUBLE AS cap FROM p),
l AS (SELECT *, ((SELECT sum(total) FROM w)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN cap <= w * level THEN cap ELSE w * (SELECT max(level) FROM l WHERE cap > w * level) END AS target FROM l),
f AS (SELECT *, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate FROM t),
b AS (SELECT *, floor(rate)::BIGINT AS whole, floor((rate - floor(rate)) * 4294967296)::BIGINT AS bound FROM f),
k AS (SELECT b.source AS source, s.seed AS seed, sum(d.size * (whole + CASE WHEN (u + s.seed * 268435456) % 4294967296 < bound THEN 1 ELSE 0 END)) AS took
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source CROSS JOIN (SELECT unnest(range(16)) AS seed) s GROUP BY 1, 2),
c AS (SELECT b.*, (SELECT arg_min(k.seed, abs(k.took - b.target) * 16 + k.seed / 1000.0) FROM k WHERE k.source IS NOT DISTINCT FROM b.source) AS seed FROM b)
SELECT doc_id, size, total AS source_size, target,
       (size * (whole + CASE WHEN (u + seed * 268435456) % 4294967296 < bound THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
