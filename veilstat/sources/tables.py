"""User tables: readers, dictionaries, buckets, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from veilstat.functions.rng import cut, u32


def read_csv(spark: SparkSession, path: str, schema: str | StructType, missing: str = "?") -> DataFrame:
    """A CSV file without header, with the names of the schema, surrounding blanks cut and a marker for missing."""
    return spark.read.schema(schema).option("nullValue", missing).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """user, items (sorted, distinct) of a text file with the item numbers of a user on each line; # starts a comment.

    Lines carry no key, so user hashes the line's text and its number among equal lines: it does not move with the
    files' splits or order, and equal lines are users of their own.
    """
    lines = spark.read.text(path).where("value not rlike '^\\\\s*(#|$)'")
    items = F.array_sort(F.array_distinct(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("int"))))
    # equal lines are counted first and told apart by number then, so that no window holds them
    per = lines.groupBy("value").agg(F.count("*").alias("n")).select("value", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    return per.select(F.xxhash64("value", "i").alias("user"), items.alias("items"))


def read_counted(spark: SparkSession, path: str, length: int) -> DataFrame:
    """value (first byte lowest), count of a tab-separated file (gz too) of fixed-length strings; others are skipped."""
    d = spark.read.schema("word string, count long").option("sep", "\t").csv(path)
    return d.where(F.length(F.col("word").cast("binary")) == length).select(pack_bytes("word").alias("value"), "count")


def pack_bytes(word: Column | str) -> Column:
    """A string of up to 7 bytes as a number, the first byte lowest."""
    return F.conv(F.hex(F.reverse(F.col(word) if isinstance(word, str) else word)), 16, 10).cast("long")


def expand(counted: DataFrame, count: str = "count") -> DataFrame:
    """Each row as often as its count says."""
    return counted.where(f"{count} > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col(count)))).drop("_i", count)


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Every row `times` times, numbered by copy."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def without_missing(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def without_null_columns(df: DataFrame) -> DataFrame:
    """Only the columns that hold no null."""
    got = df.agg(*(F.sum(F.col(c).isNull().cast("int")).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if not got[c]))


def replace_labels(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    return df.withColumn(column, F.trim(column)).replace(mapping, subset=[column])


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """code, label: the distinct labels in sorted order. A window over labels, not over rows."""
    labels = df.select(F.trim(F.col(column).cast("string")).alias("label")).where("label is not null").distinct()
    return labels.select((F.row_number().over(Window.orderBy("label")) - 1).cast("long").alias("code"), "label")


def encode(df: DataFrame, column: str, codes: DataFrame, out: str = "code") -> DataFrame:
    """df with the codes of a dictionary(); Spark broadcasts it while it is small."""
    d = codes.select(F.col("code").alias(out), F.col("label").alias("_label"))
    return df.join(d, F.trim(F.col(column).cast("string")) == F.col("_label")).drop("_label")


def bucket(column: str, low: float, step: float, size: int | None = None) -> Column:
    """The equal-width bucket of a number; with a size, values outside go to the first or last."""
    code = F.floor((F.col(column) - F.lit(float(low))) / F.lit(float(step))).cast("long")
    return F.greatest(F.least(code, F.lit(size - 1)), F.lit(0)) if size else code


def random_code(key: str, size: int, salt: str = "x") -> Column:
    """A uniform code in place of a column's own."""
    return u32(key, salt) % size


def sample_share(df: DataFrame, key: str, p: float, salt: str = "sample") -> DataFrame:
    """Rows whose key's draw is below p: a narrow filter."""
    return df.where(u32(key, salt) < cut(p))


def sample_count(df: DataFrame, key: str, n: int, salt: str = "sample") -> DataFrame:
    """The n rows with the smallest draws; a bounded top-n, not a sort of all."""
    return df.withColumn("_u", u32(key, salt)).orderBy("_u", key).limit(n).drop("_u")


def partitioned(df: DataFrame, key: str, groups: int, salt: str = "g") -> DataFrame:
    """gid: the user's group, by hash."""
    return df.withColumn("gid", u32(key, salt) % groups)


def phased(df: DataFrame, key: str, shares: list[float], salt: str = "phase") -> DataFrame:
    """phase: the place of the user's draw among cumulated shares; the last takes the rest."""
    u, total, out = u32(key, salt), 0.0, F.lit(len(shares) - 1)
    bounds = []
    for s in shares[:-1]:
        total += s
        bounds.append(cut(total))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(u < bounds[i], i).otherwise(out)
    return df.withColumn("phase", out)


def uniform_users(spark: SparkSession, n: int, d: int, salt: str = "uniform") -> DataFrame:
    """uid, v: n users with uniform codes in [0, d)."""
    return spark.range(n).select(F.col("id").alias("uid"), (u32("id", salt) % d).alias("v"))


def read_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP source as a stream: uid, v separated by a comma."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    part = F.split("value", ",")
    return lines.select(part[0].alias("uid"), part[1].cast("long").alias("v"), F.current_timestamp().alias("ts"))


def averaged_weights(counts: DataFrame, bins: int) -> DataFrame:
    """measure, bin, weight: the measure's values in near-equal runs, each with the mean over its records.

    counts(measure, n) has one row per value of the measure, which is what the windows run over.
    """
    d = counts.withColumn("bin", F.ntile(bins).over(Window.orderBy("measure")))
    own = Window.partitionBy("bin")
    mean = F.sum(F.col("measure") * F.col("n")).over(own) / F.sum("n").over(own)
    return d.select("measure", "bin", F.coalesce(F.round(mean, 6), F.lit(0.0)).alias("weight"))


def nonzero_weight(measure: Column | str, instead: float) -> Column:
    """A weight with a stand-in for zero."""
    c = F.col(measure) if isinstance(measure, str) else measure
    return F.when(c == 0, F.lit(float(instead))).otherwise(c)
