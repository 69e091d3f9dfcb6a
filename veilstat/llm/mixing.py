"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Budgets of sources from sizes(source, size bigint): source, source_size, before, target; one row per source.

    Weights repeat over the sources in code point order (null last). A source gets its weighted part of share * all
    sizes, but at most most * its size; what is cut off goes to the others by weight, again until none is above.
    before: sum of the sizes of all sources that come before. Each round is one distributed sum.
    """
    per = common.materialize(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")).withColumn("one", F.lit(1).cast("long")), "sources")
    order = [F.col("source").isNull(), F.col("source")]
    ranked = common.ordered_before(per, order, ["one", "source_size"], "ranked")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("before_one") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", F.col("before_source_size").alias("before"), w.alias("w"))
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, level = most * F.col("source_size").cast("double"), -1.0
    state = None
    while True:  # each round only adds sources that stop at their cap
        above = cap < F.lit(level) * F.col("w") if state else F.lit(False)
        got = ranked.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        if got == state or not got[1]:
            break
        state, level = got, (total - got[0]) / got[1]
    capped, free = state or (0.0, 1.0)
    part = F.lit(total - capped) * F.col("w") / F.lit(free)
    return ranked.select("source", "source_size", "before", F.least(cap, part).alias("target"))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", carry: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each document: key, size, source_size, target, taken, and the carried columns.

    Documents of a source stand in the order of a hash of their key (reruns agree); whole epochs are taken while the
    budget lasts, and of the last epoch the documents up to the word at which the budget is spent. The global sort
    deals hash-random keys by ranges, so a source with most of the rows still spreads over many tasks. Null and blank
    texts have size 0 and nothing taken; null sources are a source of their own; rows with one key stand next to
    each other, by size and then a hash of what they hold, and are counted one by one.
    """
    common.prepare(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("row") if carry else F.lit(None).cast("int").alias("row"), F.col(key).alias("doc_id"), F.col(source).alias("source"), common.n_words(F.col(text)).alias("size"), F.xxhash64(*(carry or [text])).alias("tie"))
    plain = rows if carry else common.materialize(rows.drop("row"), "sizes")
    goal = common.materialize(targets(plain.select("source", "size"), weights, share, most), "targets")
    n_sources = goal.count()
    rank = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    keyed = plain.withColumn("rank", rank)
    order = [F.col("source").isNull(), F.col("source"), F.col("rank"), F.col("doc_id"), F.col("size"), F.col("tie")]
    placed = common.ordered_before(keyed, order, ["size"], "mixed").drop("rank", "tie")
    goal = goal.select(F.col("source").alias("goal_source"), "source_size", "before", "target")
    out = placed.join(common.small(goal, n_sources), F.col("source").eqNullSafe(F.col("goal_source")))
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long"))
    rest = budget - whole * F.col("source_size") - (F.col("before_size") - F.col("before"))
    taken = whole * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0).cast("long")))
    return out.select("doc_id", *(["row"] if carry else []), "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of docs.

    The document at which a budget ends is taken whole if at least half of its words were in it, else left.
    Documents without words are left.
    """
    got = mix(docs, carry=docs.columns, **options)
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    times = F.when(F.col("size") > 0, copies).otherwise(0)
    return got.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 3 : 1 : 2 over their sources to 150% of all words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, 2e0 * source_size AS cap,
         ([3e0, 1e0, 2e0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS capped,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
         1.5e0 * (SELECT sum(source_size)::DOUBLE FROM s) AS total FROM r
), l AS (
  SELECT capped, free, total FROM c WHERE (total - capped) / free <= cap / w ORDER BY capped LIMIT 1
), t AS (
  SELECT r.source, source_size, least(cap, (total - capped) * w / free) AS target FROM r, l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '') || ':mix'), d.doc_id, d.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + least(size, greatest(budget - (budget // source_size) * source_size - before, 0)) END::BIGINT AS taken
FROM o
"""
