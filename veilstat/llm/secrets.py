"""Secret scans: three base patterns, and a randomness test battery over long tokens; DataFrame operations only.

Tokens of 20 or more characters get an encoding by their characters (decimal, hex, base32, base64) and three tests of
the hypothesis that their symbols are independent and uniform: chi-squared over equal parts of the alphabet (as many as
the length allows), the number of runs above and below the middle, and the correlation of neighbours. Within each
encoding and band of lengths, the tokens that are not random are told apart at a false-discovery rate of RATE; tokens
that are not rejected are reported as spans of kind random. A token ends at "=" unless only padding follows. Its parts
between slashes, and between slashes, hyphens and underscores, are tested like tokens, each in its own encoding; those
inside a longer span of the same token that is reported are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The base patterns, the group and the least length of it that counts.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]+", 0, 24),
}
KINDS = [*PATTERNS, "random"]
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:=+(?![A-Za-z0-9+/_=-]))?"
#: Where tokens are parted; least length of a token and of a part.
SEPARATORS, LEAST = ("/", "[/_-]"), 20
#: Discoveries that may be false; parts into which -ln p is cut for the distributed step-up rule, and their number.
RATE, PARTS, CELLS = 0.05, 20, 1200
_SPAN = "array<struct<s:bigint,k:int,e:bigint,t:string>>"
#: Matches of hex digits are taken from the text with all shorter runs left out at once; the runs are the same.
_FAST = {"hex": r"(?<![0-9a-f])[0-9a-f]{24,}", "access": r"AKIA[A-Z0-9]{16,}"}


def _spans(text: str, pattern: str, kind: int, group: int, least: int, keep: bool = False) -> Column:
    """Spans (start, kind, end in code points) of all matches whose group has the least length."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    g, m, v = f"split({text}, '{p}', -1)", f"regexp_extract_all({text}, '{p}', 0)", f"regexp_extract_all({text}, '{p}', {group})"
    item = f"named_struct('s', a.at + length(x.g), 'k', {kind}, 'e', a.at + length(x.g) + length(x.m), 't', {'x.m' if keep else 'cast(null as string)'})"
    return F.expr(f"""CASE WHEN {text} RLIKE '{p}' THEN aggregate(
        zip_with(zip_with({g}, {m}, (g, m) -> named_struct('g', g, 'm', m)), {v}, (a, v) -> named_struct('g', a.g, 'm', a.m, 'v', v)),
        named_struct('at', 0L, 'out', cast(array() AS {_SPAN})),
        (a, x) -> named_struct('at', a.at + length(x.g) + coalesce(length(x.m), 0),
            'out', CASE WHEN length(x.v) >= {least} THEN concat(a.out, array({item})) ELSE a.out END),
        a -> a.out) ELSE cast(array() AS {_SPAN}) END""")


def _parts(x: str) -> Column:
    """s, e, token of a token x (a span with its text) and of its parts of the least length."""
    kind = "array<struct<s:bigint,e:bigint,token:string>>"
    of = [
        f"""aggregate(split({x}.t, '{p}', -1), named_struct('at', {x}.s, 'out', cast(array() AS {kind})), (a, w) -> named_struct('at', a.at + length(w) + 1,
        'out', CASE WHEN length(w) >= {LEAST} THEN concat(a.out, array(named_struct('s', a.at, 'e', a.at + length(w), 'token', w))) ELSE a.out END), a -> a.out)"""
        for p in SEPARATORS
    ]
    return F.expr(f"array_distinct(concat(array(named_struct('s', {x}.s, 'e', {x}.e, 'token', {x}.t)), {', '.join(of)}))")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _upper(z: Column) -> Column:
    """P(normal > z), by a rational approximation good to 1e-7."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    tail = F.exp(-z * z / 2) * F.lit(0.3989422804014327) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds encoding, n, p_chi, p_runs, p_serial and p (Bonferroni over the three) to rows with an ASCII token."""
    t = F.regexp_replace(F.col(token), "=+$", "")
    encoding = F.when(t.rlike("^[0-9]*$"), "decimal").when(t.rlike("^([0-9a-f]*|[0-9A-F]*)$"), "hex").when(t.rlike("^[A-Z2-7]*$"), "base32").otherwise("base64")
    alphabet = F.when(F.col("encoding") == "decimal", "0123456789").when(F.col("encoding") == "hex", "0123456789abcdef").when(F.col("encoding") == "base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    alphabet = alphabet.otherwise("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    body = F.when(F.col("encoding") == "hex", F.lower(t)).otherwise(F.translate(t, "-_=", "+/A"))
    d = tokens.withColumn("encoding", encoding).withColumn("body", body).withColumn("alphabet", alphabet)
    d = d.withColumn("v", F.expr("transform(filter(split(body, ''), c -> c <> ''), c -> instr(alphabet, c) - 1)")).withColumn("n", F.size("v")).withColumn("size", F.length("alphabet"))
    d = d.withColumn("bins", F.least("size", F.greatest(F.lit(2), F.floor(F.col("n") / 5).cast("int"))))
    n, df = F.col("n").cast("double"), (F.col("bins") - 1).cast("double")
    squares = F.expr("aggregate(sequence(0, bins - 1), 0D, (a, b) -> a + pow(size(filter(v, x -> x * bins div size = b)), 2) * size / (ceil((b + 1) * size / bins) - ceil(b * size / bins)))")
    x = F.greatest(squares / n - n, F.lit(0.0))
    z = (F.pow(x / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))  # cube root of chi-squared is near normal
    d = d.withColumn("p_chi", _upper(z))
    high = F.expr("size(filter(v, x -> 2 * x >= size))").cast("double")
    turns = F.expr("size(filter(zip_with(slice(v, 1, n - 1), slice(v, 2, n - 1), (a, b) -> (2 * a >= size) <> (2 * b >= size)), x -> x))")
    d = d.withColumn("high", high).withColumn("runs", turns + 1.0)
    both = F.col("high") * (n - F.col("high"))
    mean = 2 * both / n + 1
    var = 2 * both * (2 * both - n) / (n * n * (n - 1))
    d = d.withColumn("p_runs", F.when(var > 0, F.least(F.lit(1.0), 2 * _upper(F.abs(F.col("runs") - mean) / F.sqrt(var)))).otherwise(F.pow(F.lit(0.5), n - 1)))
    mid, spread = (F.col("size") - 1) / 2, (F.col("size") * F.col("size") - 1) / 12
    moves = F.expr("aggregate(zip_with(slice(v, 1, n - 1), slice(v, 2, n - 1), (a, b) -> (a - (size - 1) / 2D) * (b - (size - 1) / 2D)), 0D, (a, x) -> a + x)")
    d = d.withColumn("p_serial", F.least(F.lit(1.0), 2 * _upper(F.abs(moves) / (spread * F.sqrt(n - 1)))))
    worst = F.least("p_chi", "p_runs", "p_serial")
    return d.withColumn("p", F.greatest(F.least(F.lit(1.0), 3 * worst), F.lit(1e-26))).drop("body", "alphabet", "v", "size", "bins", "high", "runs")


def random_tokens(tokens: DataFrame) -> DataFrame:
    """The rows of tested tokens that are not rejected as random, in strata of encoding and doubling length.

    The step-up rule runs on counts of p values in cells of a fixed number per stratum, so it needs no global sort.
    """
    d = tokens.withColumn("band", F.least(F.floor(F.log2(F.col("n") / 20.0 + 1e-9)), F.lit(6)).cast("int"))
    d = d.withColumn("cell", F.least(F.floor(-F.log("p") * PARTS), F.lit(CELLS)).cast("int"))
    strata = ["encoding", "band"]
    cells = d.groupBy(*strata, "cell").agg(F.count("*").alias("c"))
    by = Window.partitionBy(*strata)
    cells = cells.withColumn("k", F.sum("c").over(by.orderBy(F.desc("cell")))).withColumn("m", F.sum("c").over(by))
    ok = F.exp(-F.col("cell") / PARTS) <= RATE * F.col("k") / F.col("m")  # the cell's largest p value
    cut = cells.groupBy(*strata).agg(F.min(F.when(ok, F.col("cell"))).alias("cut"))  # at most 4 x 7 rows
    d = d.join(F.broadcast(cut), strata)
    return d.where(F.col("cut").isNull() | (F.col("cell") < F.col("cut"))).drop("band", "cell", "cut")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row; a null text counts as empty.

    Spans are kind:start:end in code points, by start, then kind. Rows equal in id and text share their random spans,
    which are found over all rows. Random spans that are a base span of the same place are not added.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("th", F.xxhash64("doc_id", "text"))
    found = rows.where(F.col("text").rlike(TOKEN)).select("doc_id", "th", F.explode(_spans("text", TOKEN, 3, 0, LEAST, True)).alias("x"))
    parts = found.select("doc_id", "th", F.col("x.s").alias("whole"), F.explode(_parts("x")).alias("p")).select("doc_id", "th", "whole", "p.*")
    tokens = common.materialize(tested(parts).drop("token"), "tokens")
    own = random_tokens(tokens).groupBy("doc_id", "th", "whole").agg(F.collect_set(F.struct("s", F.lit(3).alias("k"), "e", F.lit(None).cast("string").alias("t"))).alias("own"))
    longest = F.filter("own", lambda x: ~F.exists("own", lambda y: (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])))
    extra = own.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(longest)).alias("extra"))
    extra = extra.select(F.col("doc_id").alias("xd"), F.col("th").alias("xt"), "extra")
    base = [_spans("text", _FAST.get(kind, p), i, group, least).alias(kind) for i, (kind, (p, group, least)) in enumerate(PATTERNS.items())]
    got = rows.select("doc_id", "th", *base)
    got = got.join(extra, F.col("doc_id").eqNullSafe(F.col("xd")) & (F.col("th") == F.col("xt")), "left")
    got = got.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS), F.array_sort(F.concat(*PATTERNS)).alias("base"), F.coalesce("extra", F.expr(f"cast(array() AS {_SPAN})")).alias("extra"))
    fresh = F.filter("extra", lambda x: ~F.exists("base", lambda y: (x["s"] == y["s"]) & (x["e"] == y["e"])))
    return got.select("doc_id", *(f"n_{k}" for k in PATTERNS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("base", fresh))).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
