"""Constrained inference on one complete hierarchy: parents and children are made to agree, with least variance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def constrain(est: DataFrame, fanout: int, layers: int, uniform_height: bool = True) -> DataFrame:
    """layer, idx, est with parents equal to the sum of their children; layers count from 0 (below the root).

    Children of idx are idx * fanout ... + fanout - 1. Upwards each parent is averaged with its children's sum, with
    weights of the whole height (uniform_height) or of its own; downwards the difference is shared equally. One table
    per layer, each joined to the next once: nothing is collected.
    """
    levels = [est.where(F.col("layer") == i).select("idx", "est") for i in range(layers)]
    for i in range(layers - 2, -1, -1):
        h = layers + 1 if uniform_height else layers - i
        a = (fanout**h - fanout ** (h - 1)) / (fanout**h - 1)
        b = (fanout ** (h - 1) - 1) / (fanout**h - 1)
        kids = levels[i + 1].groupBy(F.floor(F.col("idx") / fanout).cast("long").alias("idx")).agg(F.sum("est").alias("kids"))
        levels[i] = levels[i].join(kids, "idx").select("idx", (F.lit(a) * F.col("est") + F.lit(b) * F.col("kids")).alias("est"))
    out = [levels[0].select(F.lit(0).alias("layer"), "idx", "est")]
    for i in range(layers - 1):
        parent = out[-1].select(F.col("idx").alias("up"), F.col("est").alias("whole"))
        kids = levels[i + 1].groupBy(F.floor(F.col("idx") / fanout).cast("long").alias("up")).agg(F.sum("est").alias("kids"))
        diff = parent.join(kids, "up").select("up", ((F.col("whole") - F.col("kids")) / fanout).alias("diff"))
        down = levels[i + 1].withColumn("up", F.floor(F.col("idx") / fanout).cast("long")).join(diff, "up")
        out.append(down.select(F.lit(i + 1).alias("layer"), "idx", (F.col("est") + F.col("diff")).alias("est")))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
