"""Mixing sources to target weights by systematic sampling.

Sources get targets by weight, none above ``cap`` times its size: what is above is shared anew by weight (water filling). Every document of a source has the same expected number of copies, target / source size; in the order of a source's documents the expected copies are summed up, one random offset is added for the source, and a document is taken once for each whole number that its sum passes. The order goes by size, so a source's words come within about one document of its target.

Running sums are made in two levels, so no source is ever in one task: documents fall into buckets (source, class of sizes, salt), buckets are counted and the counts summed up, and ranks are given inside buckets.

Cases: null ids: rows like others. Null text or no words: size 0, taken 0 words (it still has copies). Null source: a source of its own, last in order. Sources without words: target 0, no copies. Repeated rows and ids: rows are sampled one by one; which of two equal rows comes first doesn't matter. Empty table: empty result. Other columns of the input, whatever their names, stay out of the arithmetic and are only passed on by mix().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SALT_BITS = 10
_KEYS = ("_source", "_class", "_salt")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2) -> DataFrame:
    """sizes (_source, source_size) with target: weights repeat over the sources by code point, null last.

    With sources in the order of cap * size / weight, those before some place take their cap; the level of the others is the greatest of (total - caps before) / (weights from here).
    One row a source goes through one task: a source is a collection of documents, of which there may be millions, not a site.
    """
    whole = Window.partitionBy()
    byname = whole.orderBy(F.col("_source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))[F.pmod(F.row_number().over(byname) - 1, F.lit(len(weights)))]
    s = sizes.withColumn("_weight", turn).withColumn("_cap", F.col("source_size") * cap)
    before = whole.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(whole) * F.lit(percent) / F.lit(100.0)
    left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / left
    s = s.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return s.select("_source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")).alias("target"))


def offset(source, seed: str):
    """The random offset of a source, in [0, 1)."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("\0")))), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def plan(rows: DataFrame, counted: DataFrame | None = None, weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: str = "mix:") -> DataFrame:
    """rows (_doc, _source, _size and any more) with source_size, target and _copies; counted, if given, are the same rows without the other columns."""
    bucketed = lambda d: d.withColumns({"_class": common.size_class(F.col("_size")), "_salt": common.salt(F.col("_doc"), SALT_BITS)})
    buckets = bucketed(counted if counted is not None else rows).groupBy(*_KEYS).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    buckets = common.stored(buckets, "mix-buckets")
    goal = targets(buckets.groupBy("_source").agg(F.sum("_words").alias("source_size")), weights, percent, cap)
    earlier = Window.partitionBy("_source").orderBy(F.col("_class").desc(), "_salt").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    b, g = buckets.alias("b"), goal.alias("g")
    buckets = b.join(g, F.col("b._source").eqNullSafe(F.col("g._source"))).select(*(F.col(f"b.{k}").alias(f"_b{k}") for k in _KEYS), "_before", "source_size", "target")
    r = bucketed(rows)
    r = r.join(buckets, F.col("_source").eqNullSafe(F.col("_b_source")) & (F.col("_class") == F.col("_b_class")) & (F.col("_salt") == F.col("_b_salt"))).drop("_b_source", "_b_class", "_b_salt")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*_KEYS).orderBy("_size", "_doc"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = r.withColumns({"_rank": rank, "_each": each, "_offset": offset(F.col("_source"), seed)})
    passed = lambda k: F.floor(F.col("_each") * k + F.col("_offset"))
    return r.withColumn("_copies", (passed(F.col("_rank")) - passed(F.col("_rank") - 1)).cast("int")).drop("_class", "_salt", "_before", "_rank", "_each", "_offset")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: str = "mix:") -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken, with all its columns."""
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), word_count().alias("_size"))
    taken = plan(named, named.drop("_row"), weights, percent, cap, seed).filter("_copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select("_row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words the mix takes of it."""
    docs = common.table(spark, sf_dir, "documents")
    slim = common.stored(docs.select(F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), word_count().alias("_size")), "mix-sizes")
    return plan(slim).select(F.col("_doc").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_copies").cast("int").alias("copies"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), c AS (
  SELECT *, length(bin(size + 1)) * 16 + ((size + 1) >> greatest(length(bin(size + 1)) - 4, 0)) AS class,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT >> 6 AS salt
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER () * 150 / 100.0::DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * weight) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS offs
  FROM l
), r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.offs,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each_,
         row_number() OVER (PARTITION BY c.source ORDER BY class DESC, salt, size, doc_id) AS rank_
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(each_ * rank_ + offs) - floor(each_ * (rank_ - 1) + offs)) * size)::BIGINT AS taken,
       (floor(each_ * rank_ + offs) - floor(each_ * (rank_ - 1) + offs))::INT AS copies
FROM r
"""
