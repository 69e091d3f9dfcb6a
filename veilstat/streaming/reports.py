"""Reports that arrive as a stream: randomised row by row, counted per window, calibrated when a window closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstat.functions.mechanisms import Mechanism
from veilstat.operators.aggregate import supports, tidy
from veilstat.operators.randomize import perturb


def windowed_counts(users: DataFrame, key: str, value: str, ts: str, m: Mechanism, width: str, late: str = "0 seconds", slide: str | None = None, salt: str = "r") -> DataFrame:
    """start, v, c, with v = -1 for the number of reports: works on streams and tables alike.

    Late reports are dropped by the watermark; state is one count per window and supported value.
    """
    d = users.withWatermark(ts, late) if users.isStreaming else users
    sent = perturb(d, key, value, m, salt)
    if m.kind == "ue":
        seen = F.array("y")
    elif m.hashes:
        every = F.sequence(F.lit(0).cast("long"), F.lit(m.d - 1).cast("long"))
        seen = F.concat(F.array(F.lit(-1).cast("long")), F.filter(every, lambda v: supports(m, v)))
    else:
        seen = F.array(F.lit(-1).cast("long"), F.col("y"))
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return sent.select(span.alias("w"), F.explode(seen).alias("v")).groupBy("w", "v").agg(F.count("*").alias("c")).select(F.col("w.start").alias("start"), "v", "c")


def calibrated(counts: DataFrame, m: Mechanism) -> DataFrame:
    """start, v, est over the complete domain of each closed window."""
    n = counts.where("v = -1").select("start", F.col("c").alias("n"))
    domain = n.withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m.d - 1).cast("long"))))
    d = domain.join(counts, ["start", "v"], "left")
    return d.select("start", "v", tidy(m.estimate(F.coalesce("c", F.lit(0)), F.col("n"))).alias("est"))


def to_table(counts: DataFrame, m: Mechanism, path: str, checkpoint: str, available_now: bool = True):
    """Writes calibrated windows of a stream as Parquet as they close; returns the streaming query."""

    def sink(batch: DataFrame, _: int) -> None:
        calibrated(batch, m).write.mode("append").parquet(path)

    writer = counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
