"""The registered queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.functions import mechanisms as M
from veilstat.operators import aggregate as A
from veilstat.operators import consistency, density, heavy, itemsets, marginals, metrics, postprocess, shuffle
from veilstat.operators.randomize import perturb, square_wave
from veilstat.sources import tables as S
from veilstat.streaming import reports as stream

from . import hio, split
from .hierarchy import Tree, best_fanout, node_table
from .query import Category, Ordinal, bind

EPS = 1.0
ITEM_KEY = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
#: Queries over line items in the language of plans.query, in the shapes that the engine must answer.
BOX_QUERIES = [
    "select sum(line) from t where 5<=qty<=20",
    "select sum(line) from t where 1<=qty<=30 and 2<=disc<=7",
    "select sum(line) from t where 10<=qty<=40 and flag=R",
    "select sum(line) from t where flag=A and status=F",
    "select sum(line) from t where 3<=disc<=9 and flag=N and status=O",
    "select sum(line) from t where 1<=qty<=50",
]
SCHEMA = {"qty": Ordinal(1, 50), "disc": Ordinal(0, 10), "flag": Category(("A", "N", "R")), "status": Category(("F", "O"))}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 100).alias("v"))


def labelled(spark: SparkSession, sf: str, name: str, key: str, column: str) -> DataFrame:
    d = table(spark, sf, name).select(F.col(key).alias("uid"), column)
    return S.encode(d, column, S.dictionary(d, column), "v").select("uid", "v")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """uid, codes of quantity, discount, flag and status, and the line number as public measure."""
    d = table(spark, sf, "lineitem")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    status = F.when(F.col("l_linestatus") == "F", 0).otherwise(1)
    return d.select(F.expr(ITEM_KEY).alias("uid"), (F.col("l_quantity").cast("long") - 1).alias("qty"), F.round(F.col("l_discount") * 100).cast("long").alias("disc"), flag.cast("long").alias("flag"), status.cast("long").alias("status"), F.col("l_linenumber").cast("long").alias("measure"))


def _histogram(m: M.Mechanism, users: Callable) -> Callable:
    return lambda spark, sf: A.histogram(perturb(users(spark, sf), "uid", "v", m), m)


def base(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(M.lh(EPS, 100), orders)(spark, sf)


def _post(f: Callable) -> Callable:
    def run(spark, sf):
        n = table(spark, sf, "orders").count()
        return f(base(spark, sf), n)

    return run


def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    return A.drop_noise(base(spark, sf), M.noise_floor(M.lh(EPS, 100), table(spark, sf, "orders").count()))


def _waves(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_totalprice") / 500000).alias("x"))
    return square_wave(d, "uid", "x", M.SquareWave(EPS))


def sw_hist(spark, sf, bins=16):
    return density.report_bins(_waves(spark, sf), M.SquareWave(EPS), bins)


def sw_matrix(spark, sf):
    return density.matrix(spark, M.SquareWave(EPS), 16, 16).select("j", "i", A.tidy(F.col("p"), 9).alias("p"))


def _em(smooth: bool) -> Callable:
    def run(spark, sf):
        sw = M.SquareWave(EPS)
        got = density.em_steps(sw_hist(spark, sf), density.matrix(spark, sw, 16, 16), 16, 3, smooth)
        return got.select("i", A.tidy(F.col("theta")).alias("theta"))

    return run


def sw_density(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return density.density(d, "o_orderkey", "o_totalprice", EPS, 64, 0.0, 500000.0)


QTY, DISC = Tree("qty", 50, 4), Tree("disc", 11, 4)
FLAG, STATUS = Tree("flag", 3), Tree("status", 2)


def tree_nodes(spark, sf):
    return node_table(spark, [QTY, DISC, FLAG, STATUS])


RANGES = [(0, 50), (4, 20), (9, 40), (0, 1), (13, 14), (1, 49)]


def range_cover(spark, sf):
    rows = [(i, n.layer, n.idx, n.lo, n.hi) for i, (a, b) in enumerate(RANGES) for n in QTY.cover(a, b)]
    return spark.createDataFrame(rows, "query int, layer int, idx int, lo long, hi long")


def fanouts(spark, sf):
    return spark.createDataFrame([(e, best_fanout(e)) for e in (0.5, 1.0, 2.0, 4.0)], "eps double, fanout int")


def _layered(spark, sf):
    """layer, idx, est of a complete binary hierarchy over 16 codes; users parted over its 4 layers below the root."""
    users = table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid"), (F.col("o_custkey") % 16).alias("v"))
    users = S.partitioned(users, "uid", 4, "cig")
    n, out = F.count("*").over(A.whole()), None
    for layer in range(4):
        own = users.where(F.col("gid") == layer).withColumn("v", F.shiftright("v", 3 - layer))
        m = M.grr(EPS, 2 << layer)
        counts = A.support_counts(perturb(own, "uid", "v", m, "ci"), m)
        d = counts.select(F.lit(layer).alias("layer"), F.col("v").alias("idx"), (m.estimate(F.col("c"), F.col("n")) / F.col("n")).alias("share"))
        out = d if out is None else out.unionByName(d)
    n = table(spark, sf, "orders").agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(n)).select("layer", "idx", (F.col("share") * F.col("n")).alias("est"))


def ci_consistency(spark, sf):
    return consistency.constrain(_layered(spark, sf), 2, 4).select("layer", "idx", A.tidy(F.col("est")).alias("est"))


def _queries(trees: list[Tree], which: list[str] = BOX_QUERIES):
    names = {t.attr for t in trees}
    bound = [bind(q, SCHEMA) for q in which]
    return [q for q in bound if set(q.box) <= names]


ALL_TREES = [QTY, DISC, FLAG, STATUS]


def _hio(trees: list[Tree], style: str, eps: float = EPS) -> Callable:
    return lambda spark, sf: hio.answers(items(spark, sf), "uid", _queries(trees), trees, eps, style)


def hio_joint(spark, sf):
    trees = [FLAG, STATUS]
    cells = [(f, s) for f in range(3) for s in range(2)]
    got = hio.joint_cells(hio.separate_reports(items(spark, sf), "uid", trees, 2.0), trees, 2.0, cells)
    return got.select((F.col("cell") / 2).cast("int").alias("flag"), (F.col("cell") % 2).cast("int").alias("status"), "est")


def ce_marginals(spark, sf):
    m = M.adaptive(EPS, 66)
    d = items(spark, sf).withColumn("v", (F.col("disc") * 3 + F.col("flag")) * 2 + F.col("status"))
    return marginals.all_marginals(A.histogram(perturb(d, "uid", "v", m, "ce"), m), ["disc", "flag", "status"], [11, 3, 2])


VIEW_SIZES = {"disc": 11, "flag": 3, "status": 2}
VIEWS = marginals.pairs(["disc", "flag", "status"])


def mg_view_sum(spark, sf):
    d = items(spark, sf)
    counts = marginals.view_counts(d, "uid", VIEWS, VIEW_SIZES, EPS)
    box = {"disc": (2, 8), "flag": (0, 2), "status": (0, 1)}
    return marginals.view_query(counts, VIEWS, VIEW_SIZES, box, EPS).select("view", A.tidy(F.col("share")).alias("share"))


def mg_answer(spark, sf):
    n = table(spark, sf, "lineitem").agg(F.count("*").alias("n"))
    mean = mg_view_sum(spark, sf).agg(F.avg("share").alias("s"))
    return mean.crossJoin(n).select(A.tidy(F.col("s") * F.col("n"), 2).alias("est"))


def exact_box(spark, sf):
    return hio.exact(items(spark, sf), _queries(ALL_TREES))


def weight_bins(spark, sf):
    return S.averaged_weights(items(spark, sf).groupBy("measure").agg(F.count("*").alias("n")), 3)


def hio_lookup(spark, sf):
    """The answers from precomputed cells; the same as asking the reports."""
    trees = [DISC, FLAG, STATUS]
    plan = hio.groups(trees, EPS)
    sent = hio.reports(items(spark, sf), "uid", trees, plan)
    got = hio.lookup(hio.estimate_all(sent, plan), _queries(trees), trees, plan)
    return got.groupBy("query").agg(A.tidy(F.sum(F.col("measure") * F.col("est"))).alias("sum"))


def hio_split(spark, sf):
    """Three attributes in reports of at most two."""
    trees = [DISC, FLAG, STATUS]
    plan = split.groups(trees, 2.0, 2)
    sent = split.reports(items(spark, sf), "uid", trees, plan)
    got = split.estimate(sent, _queries(trees), trees, plan)
    return got.groupBy("query").agg(A.tidy(F.sum(F.col("measure") * F.col("est")), 2).alias("sum"))


def olh_uniform(spark, sf):
    m = M.olh(2.0, 1024)
    return A.histogram(perturb(S.uniform_users(spark, 10_000, 1024), "uid", "v", m), m)


def values(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("uid"), F.floor("value").cast("long").alias("v"))


PEM_EPS, PEM_BITS, PEM_K = 4.0, 9, 8


def pem_round(spark, sf):
    first, t = heavy.rounds(PEM_BITS, PEM_K)
    own = S.partitioned(values(spark, sf), "uid", t, "mg").where("gid = 0")
    return heavy.round_estimate(own, "uid", "v", list(range(1 << first)), first, PEM_EPS, "m0")


def pem_find(spark, sf):
    return heavy.find(values(spark, sf), "uid", "v", PEM_BITS, PEM_K, PEM_EPS)


def pem_hits(spark, sf):
    return heavy.hits(pem_find(spark, sf), heavy.true_top(values(spark, sf), "v", 2 * PEM_K))


def baskets(spark, sf):
    part = table(spark, sf, "part")
    brand = S.encode(part.select("p_partkey", "p_brand"), "p_brand", S.dictionary(part, "p_brand"), "item").select("p_partkey", F.col("item").cast("int").alias("item"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(brand, F.col("l_partkey") == F.col("p_partkey"))
    return d.groupBy(F.col("l_orderkey").alias("uid")).agg(F.array_sort(F.collect_set("item")).alias("items"))


CANDIDATES = list(range(0, 25, 2))
SETS = [(0, 2), (0, 4), (2, 4), (6, 8), (10, 12), (0, 2, 4)]


def svsm_singletons(spark, sf):
    own = itemsets.phases(baskets(spark, sf), "uid").where("phase = 0")
    return itemsets.singletons(own, "uid", "items", 25, 4.0)


def svsm_lengths(spark, sf):
    own = itemsets.phases(baskets(spark, sf), "uid").where("phase = 1")
    return itemsets.lengths(own, "uid", itemsets.candidate_size("items", CANDIDATES), 8, 4.0)


def svsm_padded(spark, sf):
    own = itemsets.phases(baskets(spark, sf), "uid").where("phase = 2")
    return itemsets.padded(own, "uid", "items", CANDIDATES, 3, 4.0)


def svsm_contained(spark, sf):
    """How many baskets hold each set: relational division by array containment, without a join."""
    d = baskets(spark, sf).select(F.explode(itemsets.contained("items", SETS)).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(i, len(x)) for i, x in enumerate(SETS)], "s int, size int").join(d, "s", "left").select("s", "size", F.coalesce("n", F.lit(0)).alias("n"))


def svsm_candidates(spark, sf):
    got = itemsets.candidate_sets({0: 100.0, 1: 90.0, 2: 60.0, 3: 30.0}, 6)
    return spark.createDataFrame([(i + 1, ",".join(map(str, s))) for i, s in enumerate(got)], "rank int, items string")


def svsm_find(spark, sf):
    got = itemsets.find(baskets(spark, sf), "uid", "items", 25, 8, 4.0)
    return got.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "est")


def murs_accounting(spark, sf):
    g = spark.createDataFrame([(e, float(n), float(d), float(r)) for e in (0.5, 1.0, 2.0) for n in (10_000, 1_000_000) for d in (4, 100) for r in (0, 5000)], "e double, n double, d double, r double")
    e, n, d, r, dl = F.col("e"), F.col("n"), F.col("d"), F.col("r"), 1e-9
    cols = {
        "c_grr": shuffle.central_grr(e, dl, n, d), "c_hash": shuffle.central_hash(e, dl, n), "c_fakes": shuffle.central_grr(e, dl, n, d, r),
        "c_alone": F.when(r > 0, shuffle.central_fakes(dl, r, d)), "l_grr": shuffle.local_grr(e, dl, n, d), "l_hash": shuffle.local_hash(e, dl, n),
        "l_grr_fakes": shuffle.local_grr_fakes(e, dl, n, d, r), "l_hash_fakes": shuffle.local_hash_fakes(e, dl, n, r), "var": shuffle.variance(e, n, d, d, r) * 1e6,
    }
    return g.select("e", "n", "d", "r", *(A.tidy(c).alias(k) for k, c in cols.items()))


def murs_grid(spark, sf):
    return shuffle.fake_grid(spark, 0.5, 1e-9, 1_000_000, 100, 50).select(A.tidy(F.col("fakes"), 3).alias("fakes"), A.tidy(F.col("e0")).alias("e0"), A.tidy(F.col("var") * 1e9, 4).alias("var"))


def murs_estimate(spark, sf):
    return shuffle.with_fakes(labelled(spark, sf, "events", "event_id", "event_type"), "uid", "v", 2.0, 5, 1000)


def murs_choice(spark, sf):
    return shuffle.choice(spark, 0.5, 1e-9, 1_000_000, 1000).select("mechanism", "size", A.tidy(F.col("e0")).alias("e0"), A.tidy(F.col("var") * 1e9, 4).alias("var"))


def bucketize(spark, sf):
    d = table(spark, sf, "orders").select(S.bucket("o_totalprice", 0, 50000, 10).alias("bucket"))
    return d.groupBy("bucket").agg(F.count("*").alias("n"))


def dup_rows(spark, sf):
    return S.replicate(table(spark, sf, "nation").select("n_nationkey"), 3).select("n_nationkey", "copy")


def sample_n(spark, sf):
    return S.sample_count(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)


def sample_p(spark, sf):
    return S.sample_share(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.1)


def phase_counts(spark, sf):
    d = itemsets.phases(table(spark, sf, "orders").select(F.col("o_orderkey").alias("uid")), "uid")
    return d.groupBy("phase").agg(F.count("*").alias("n"))


def estimate_error(spark, sf):
    return metrics.histogram_error(base(spark, sf), orders(spark, sf).groupBy("v").agg(F.count("*").alias("c")))


def query_error(spark, sf):
    trees = [FLAG, STATUS]
    asked, d = _queries(trees), items(spark, sf)
    return metrics.query_error(hio.answers(d, "uid", asked, trees, EPS), hio.exact(d, asked), "count", 60_000.0)


def windowed(spark, sf):
    m = M.grr(2.0, 5)
    d = table(spark, sf, "events").select("event_id", "event_type", "ts")
    d = S.encode(d, "event_type", S.dictionary(d, "event_type"), "v")
    got = stream.calibrated(stream.windowed_counts(d, "event_id", "v", "ts", m, "7 days"), m)
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "v", "est")


def encode_dictionary(spark, sf):
    return S.dictionary(table(spark, sf, "part"), "p_brand")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hio_rl": _hio(ALL_TREES, "rl"),
    "grr_histogram": _histogram(M.grr(EPS, 5), lambda s, d: labelled(s, d, "events", "event_id", "event_type")),
    "lh_histogram": base,
    "olh_histogram": _histogram(M.olh(EPS, 100), orders),
    "lh_half_histogram": _histogram(M.lh_half(2.0, 100), orders),
    "olh_uniform": olh_uniform,
    "ue_histogram": _histogram(M.ue(EPS, 5), lambda s, d: labelled(s, d, "orders", "o_orderkey", "o_orderpriority")),
    "adaptive_histogram": _histogram(M.adaptive(EPS, 25), lambda s, d: labelled(s, d, "part", "p_partkey", "p_brand")),
    "fo_variance_filter": noise_filter,
    "fo_top_size": lambda s, d: A.keep_largest(base(s, d), 10),
    "fo_topk_sentinel": lambda s, d: A.mark_largest(base(s, d), 10),
    "post_base_pos": lambda s, d: postprocess.base_pos(base(s, d)),
    "post_norm": _post(postprocess.norm),
    "post_norm_mul": _post(postprocess.norm_mul),
    "post_norm_cut": _post(postprocess.norm_cut),
    "post_norm_sub": _post(postprocess.norm_sub),
    "post_mle_apx": _post(lambda e, n: postprocess.mle_apx(e, n, M.lh(EPS, 100))),
    "post_mle_grr": _post(lambda e, n: postprocess.mle_grr(e, n, M.lh(EPS, 100))),
    "post_power": _post(lambda e, n: postprocess.power(e, n, M.lh(EPS, 100))),
    "sw_reports_hist": sw_hist,
    "sw_matrix": sw_matrix,
    "sw_em": _em(False),
    "sw_ems": _em(True),
    "sw_density": sw_density,
    "tree_nodes": tree_nodes,
    "range_cover": range_cover,
    "best_fanout": fanouts,
    "ci_consistency": ci_consistency,
    "hio_1d": _hio([QTY], "rl"),
    "hio_2d": _hio([QTY, DISC], "rl"),
    "hio_mixed": _hio([DISC, FLAG, STATUS], "rl"),
    "hio_all_layers": _hio([FLAG, STATUS], "al", 4.0),
    "hio_bottom": _hio([FLAG, STATUS], "bl"),
    "hio_sr_joint": hio_joint,
    "hio_lookup": hio_lookup,
    "hio_split": hio_split,
    "ce_marginals": ce_marginals,
    "mg_view_sum": mg_view_sum,
    "mg_answer": mg_answer,
    "exact_box": exact_box,
    "weight_bins": weight_bins,
    "pem_round": pem_round,
    "pem_heavy_hitters": pem_find,
    "pem_hits": pem_hits,
    "svsm_singletons": svsm_singletons,
    "svsm_length_dist": svsm_lengths,
    "svsm_pad_sample": svsm_padded,
    "svsm_contained": svsm_contained,
    "svsm_candidates": svsm_candidates,
    "svsm_itemsets": svsm_find,
    "murs_accounting_grid": murs_accounting,
    "murs_fake_grid": murs_grid,
    "murs_fake_estimate": murs_estimate,
    "murs_choice": murs_choice,
    "encode_dictionary": encode_dictionary,
    "bucketize": bucketize,
    "dup_rows": dup_rows,
    "sample_n": sample_n,
    "sample_p": sample_p,
    "phase_counts": phase_counts,
    "estimate_error": estimate_error,
    "query_error": query_error,
    "windowed_histogram": windowed,
}
