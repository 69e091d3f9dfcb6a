"""Hand-computed cases, invariants and error bounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstat.functions import mechanisms as M
from veilstat.functions.rng import u32
from veilstat.operators import aggregate, consistency, density, heavy, itemsets, marginals, postprocess, shuffle
from veilstat.operators.randomize import combine, perturb
from veilstat.operators.randomize import split as split_codes
from veilstat.plans import hio, split
from veilstat.plans.hierarchy import Tree, best_fanout
from veilstat.plans.query import Category, Ordinal, bind, parse, random_box
from veilstat.sources import tables
from veilstat.streaming import reports

EST = [50.0, 30.0, -10.0, 20.0]


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(map(float, values))), "v long, est double")


def column(df):
    return [r["est"] for r in df.orderBy("v").collect()]


def test_estimates(spark):
    m = M.grr(math.log(3), 4)
    d = spark.createDataFrame([(c,) for c in (40, 30, 20, 10)], "c long")
    got = [round(r[0], 9) for r in d.select(m.estimate(F.col("c"), F.lit(100))).collect()]
    assert got == [70, 40, 10, -20]
    m = M.olh(math.log(3), 4)
    d = spark.createDataFrame([(c,) for c in (45, 30, 25, 20)], "c long")
    assert [round(r[0], 9) for r in d.select(m.estimate(F.col("c"), F.lit(100))).collect()] == [80, 20, 0, -20]


@pytest.mark.parametrize(
    "step, n, want",
    [
        ("base_pos", 80, [50, 30, 0, 20]), ("norm", 80, [47.5, 27.5, -12.5, 17.5]), ("norm_mul", 80, [40, 24, 0, 16]),
        ("norm_cut", 80, [40, 24, 0, 16]), ("norm_sub", 80, [43.333333, 23.333333, 0, 13.333333]),
        ("norm_cut", 60, [37.5, 22.5, 0, 0]), ("norm_sub", 60, [36.666667, 16.666667, 0, 6.666667]),
    ],
)
def test_postprocess(spark, step, n, want):
    assert column(postprocess.postprocess(frame(spark, EST), step, n)) == pytest.approx(want)


def test_postprocess_loops(spark):
    """Closed forms equal the loops they stand for, on random vectors."""
    rng = np.random.default_rng(1)
    for _ in range(6):
        x, n = rng.normal(5, 30, 12).round(3), 60.0
        y = x.copy()
        while abs(y.sum() - n) > 1 or (y < 0).any():
            y[y < 0] = 0
            y[y > 0] += (n - y.sum()) / (y > 0).sum()
        assert column(postprocess.norm_sub(frame(spark, x), n)) == pytest.approx(list(y), abs=1e-5)
        m = M.grr(1.0, 12)
        obs, e = (x * (m.p - m.q) + n * m.q) / n, x / n
        while e.min() < 0:
            pos = e > 0
            e = (obs / obs[pos].sum() * (pos.sum() * m.q + m.p - m.q) - m.q) / (m.p - m.q)
            e[~pos] = 0
        assert column(postprocess.mle_grr(frame(spark, x), n, m)) == pytest.approx(list(e * n), abs=1e-5)


def test_nothing_positive(spark):
    for step in ("norm_mul", "norm_sub"):
        assert column(postprocess.postprocess(frame(spark, [-1, -2, -3]), step, 10)) == [0, 0, 0]


def test_power(spark):
    m = M.grr(2.0, 6)
    got = column(postprocess.power(frame(spark, [400, 90, 30, 10, -5, 2]), 500, m))
    assert all(x >= 0 for x in got) and got[0] > got[1] > got[2]
    assert sum(column(postprocess.power_then_norm_sub(frame(spark, [400, 90, 30, 10, -5, 2]), 500, m))) == pytest.approx(500, abs=1.01)


def test_planner():
    assert [best_fanout(e) for e in (0.5, 1, 2, 4)] == [17, 17, 19, 35]
    t = Tree("x", 8, 2)
    assert {(n.layer, n.idx) for n in t.cover(2, 7)} == {(2, 1), (2, 2), (3, 6)}
    assert heavy.rounds(9, 8) == (4, 6) and heavy.rounds(48, 32) == (6, 43)
    assert M.amplified(1, 64, 4) == (True, pytest.approx(2.063455, abs=1e-6)) and not M.amplified(1, 64, 1)[0]
    assert M.amplified(4, 64, 1) == (True, pytest.approx(4))
    for size in range(1, 40):
        t = Tree("x", size, 3)
        for a in range(size):
            for b in range(a + 1, size + 1, 3):
                cells = sorted(i for n in t.cover(a, b) for i in range(n.lo, n.hi))
                assert cells == list(range(a, b))


def test_square_wave():
    for eps, w, p, q in ((1, 0.512167, 1.136305, 0.418023), (2, 0.258674, 2.538010, 0.343482)):
        s = M.SquareWave(eps)
        assert (s.w, s.p, s.q) == pytest.approx((w, p, q), abs=2e-6) and s.q + s.p * s.w == pytest.approx(1)
        assert density._transition(s, 24, 16).sum(0) == pytest.approx(np.ones(16))
    assert density.em([3, 5, 9, 4, 2, 1], M.SquareWave(1), 6).sum() == pytest.approx(1)
    assert density.em([3, 5, 9, 4, 2, 1], M.SquareWave(1), 6, smooth=True).sum() == pytest.approx(1)


def test_accounting(spark):
    one = spark.range(1)
    c = shuffle.central_grr(F.lit(1.0), 1e-9, F.lit(1e6), F.lit(100.0))
    loc = shuffle.local_grr(F.lit(0.5), 1e-9, F.lit(1e6), F.lit(100.0))
    assert tuple(one.select(c, loc).first()) == pytest.approx((0.174637, 6.599606), abs=1e-6)
    assert one.select(shuffle.local_grr(F.lit(0.001), 1e-9, F.lit(1e3), F.lit(100.0))).first()[0] == -1


@pytest.mark.parametrize("m", [M.grr(1.0, 20), M.lh(1.0, 20), M.olh(1.0, 20), M.lh_half(2.0, 20), M.ue(1.0, 20)], ids=lambda m: m.kind)
def test_unbiased(spark, m):
    n = 20_000
    users = spark.range(n).select("id", (F.col("id") % 400 % 20).alias("v"))
    got = column(aggregate.histogram(perturb(users, "id", "v", m), m))
    sd = math.sqrt(n * max(m.variance, m.q * (1 - m.q) / (m.p - m.q) ** 2) + n)
    assert len(got) == 20 and max(abs(x - n / 20) for x in got) < 6 * sd


def test_nulls_and_empty(spark):
    m = M.grr(1.0, 3)
    users = spark.createDataFrame([(1, None), (2, None)], "id long, v long")
    assert column(aggregate.histogram(perturb(users, "id", "v", m), m)) == [0, 0, 0]
    assert column(aggregate.histogram(perturb(users.limit(0), "id", "v", m), m)) == [0, 0, 0]


def test_joint_identity(spark):
    """The product over attributes equals inclusion and exclusion, on the reports themselves."""
    trees = [Tree("x", 4), Tree("y", 3)]
    users = spark.range(300).select(F.col("id").alias("uid"), (F.col("id") % 4).alias("x"), (F.col("id") % 3).alias("y"), F.lit(1).alias("measure"))
    sent = hio.separate_reports(users, "uid", trees, 4.0)
    pdf = sent.toPandas()
    got = hio.joint_cells(sent, trees, 4.0, [(1, 2)]).first()["est"]
    m1, m2 = M.adaptive(2.0, 4), M.adaptive(2.0, 3)
    a, b = (pdf.y_0 == 1).to_numpy(), (pdf.y_1 == 2).to_numpy()
    n, n1, n2, n12 = len(a), a.sum(), b.sum(), (a & b).sum()
    s1, s2 = (n1 - n * m1.q) / (m1.p - m1.q), (n2 - n * m2.q) / (m2.p - m2.q)
    want = (n12 - s1 * (m1.p - m1.q) * m2.q - s2 * (m2.p - m2.q) * m1.q - n * m1.q * m2.q) / ((m1.p - m1.q) * (m2.p - m2.q))
    assert got == pytest.approx(want, abs=1e-5)


def test_consistency(spark):
    est = spark.createDataFrame([(i, j, float((i + 1) * 7 % 5 + j)) for i in range(3) for j in range(2 << i)], "layer int, idx long, est double")
    got = {(r.layer, r.idx): r.est for r in consistency.constrain(est, 2, 3).collect()}
    for layer in (0, 1):
        for j in range(2 << layer):
            assert got[layer, j] == pytest.approx(got[layer + 1, 2 * j] + got[layer + 1, 2 * j + 1])


def test_query_language():
    assert parse("select count(*) from t") == ("count", "*", [])
    assert parse("select sum(education-num) from foo where 20<=age<=30 and sex=Male") == ("sum", "education-num", [("age", "20", "30"), ("sex", "Male", "Male")])
    schema = {"age": Ordinal(17, 81), "sex": Category(("Male", "Female"))}
    assert bind("select avg(x) from t where 20<=age<=30 and sex=Male", schema).box == {"age": (3, 14), "sex": (1, 2)}
    assert bind("select avg(x) from t where 20<=age<=30", schema, as_index=True).box == {"age": (20, 30)}
    for bad in ("select max(x) from t", "select sum(x) from t where a=1 or b=2 <", "delete"):
        with pytest.raises(ValueError):
            parse(bad)


def test_styles(spark):
    """All styles estimate the exact answers within six standard deviations at a large budget."""
    trees = [Tree("x", 8, 2), Tree("y", 3)]
    users = spark.range(30_000).select(F.col("id").alias("uid"), (F.col("id") % 8).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") % 2).alias("measure"))
    schema = {"x": Ordinal(0, 7), "y": Category(("a", "b", "c"))}
    asked = [bind(q, schema) for q in ("select sum(m) from t where 1<=x<=5", "select sum(m) from t where y=b and 0<=x<=3", "select count(m) from t")]
    truth = {r.query: r for r in hio.exact(users, asked).collect()}
    for style, eps in (("rl", 6.0), ("bl", 6.0), ("al", 40.0)):
        for r in hio.answers(users, "uid", asked, trees, eps, style).collect():
            assert r["count"] == pytest.approx(truth[r.query]["count"], abs=3000), style
            assert r["sum"] == pytest.approx(truth[r.query]["sum"], abs=3000), style


def test_heavy_and_itemsets(spark):
    users = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 77).when(F.col("id") % 4 == 1, 300).otherwise(F.col("id") % 512).alias("v"))
    found = heavy.find(users, "id", "v", 9, 4, 4.0)
    assert {77, 300} <= {r.v for r in found.collect()}
    baskets = spark.range(30_000).select("id", F.when(F.col("id") % 3 < 2, F.array(F.lit(1), F.lit(2), (F.col("id") % 30).cast("int"))).otherwise(F.array((F.col("id") % 30).cast("int"))).alias("items"))
    got = [tuple(r["items"]) for r in itemsets.find(baskets, "id", "items", 30, 4, 4.0).collect()]
    assert (1,) in got and (2,) in got and (1, 2) in got


def test_codes(spark):
    d = spark.range(24).select("id", *(c.alias(n) for c, n in zip(split_codes("id", [2, 3, 4]), "abc")))
    assert d.where(combine(["a", "b", "c"], [2, 3, 4]) != F.col("id")).count() == 0
    joint = spark.range(6).select(F.col("id").alias("v"), F.lit(1.0).alias("est"))
    assert marginals.all_marginals(joint, ["a", "b"], [2, 3]).where("a is null and b is null").first()["est"] == 6


def test_likelihood_takes_all_rounds(spark, monkeypatch):
    """Rounds go on past those planned at once, until nothing is negative."""
    monkeypatch.setattr(postprocess, "ROUNDS", 1)
    rng, m = np.random.default_rng(5), M.lh(1.0, 40)
    x, n = np.where(np.arange(40) < 4, 200.0, 0) + rng.normal(0, 60, 40).round(3), 800.0
    obs, e = (x * (m.p - m.q) + n * m.q) / n, x / n
    a, b, rounds = m.p * (1 - m.p), m.q * (1 - m.q), 0
    while not rounds or e.min() < 0:
        pos = e > 0
        z = (obs[pos].sum() - m.p - (pos.sum() - 1) * m.q) / (a + (pos.sum() - 1) * b)
        e = np.where(pos, (obs - m.q - b * z) / (m.p - m.q + (a - b) * z), 0)
        rounds += 1
    assert rounds > 1 and column(postprocess.mle_apx(frame(spark, x), n, m)) == pytest.approx(list(e * n), abs=1e-5)


def test_hashed_accounting(spark):
    got = spark.range(1).select(shuffle.central_hash(F.lit(2.0), 1e-9, F.lit(1e6))).first()[0]
    assert got == pytest.approx(math.sqrt(4 * 14 * math.log(2e9) / ((1e6 - 1) / (math.exp(2) + round(math.exp(1) + 1) - 1))))


def test_users_of_transactions(spark, tmp_path):
    """Equal lines are users of their own; ids don't move with the order of lines or the number of files."""
    lines = ["1 2", "3", "1 2", "4 5 6"] * 5
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.dat").write_text("\n".join(lines))
    (tmp_path / "b").mkdir()
    for i in range(4):
        (tmp_path / "b" / f"{i}.dat").write_text("\n".join(sorted(lines)[i::4]))
    a, b = ({(r["user"], tuple(r["items"])) for r in tables.read_transactions(spark, str(tmp_path / x)).collect()} for x in "ab")
    assert a == b and len(a) == len({u for u, _ in a}) == 20


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("39, Private, 5\n40, ?, 6\n")
    d = tables.read_csv(spark, str(tmp_path / "a.csv"), "age int, work string, x int")
    assert tables.without_missing(d).count() == 1 and tables.without_null_columns(d).columns == ["age", "x"]
    (tmp_path / "t.dat").write_text("# head\n3 1 2\n\n5 5\n")
    assert sorted(r["items"] for r in tables.read_transactions(spark, str(tmp_path / "t.dat")).collect()) == [[1, 2, 3], [5]]
    import gzip

    with gzip.open(tmp_path / "q.tsv.gz", "wt") as f:
        f.write("ab\t3\nabc\t1\n")
    got = tables.read_counted(spark, str(tmp_path / "q.tsv.gz"), 2)
    assert [tuple(r) for r in got.collect()] == [(0x61 + 0x62 * 256, 3)] and tables.expand(got).count() == 3
    assert tables.replace_labels(spark.createDataFrame([(" <=50K.",)], "l string"), "l", {"<=50K.": "0"}).first()[0] == "0"
    assert spark.range(1000).where(u32("id", "x") >= 2**31).count() == pytest.approx(500, abs=80)


def test_layers_of_encryption(spark):
    d = spark.createDataFrame([("7",), ("9",)], "y string")
    keys = ["0123456789abcdef", "fedcba9876543210"]
    assert sorted(r.y for r in shuffle.opened(shuffle.sealed(d, "y", keys), "y", keys).collect()) == ["7", "9"]
    assert sorted(r.y for r in shuffle.shuffled(d, ["y"], 3).collect()) == ["7", "9"]


def test_stream(spark, tmp_path):
    """A stream gives what the same rows give as a table, for windows that have closed."""
    m = M.grr(2.0, 4)
    d = spark.range(4000).select("id", (F.col("id") % 4).alias("v"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    counts = reports.windowed_counts(s, "id", "v", "ts", m, "6 hours")
    reports.to_table(counts, m, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want = reports.calibrated(reports.windowed_counts(d, "id", "v", "ts", m, "6 hours"), m)
    assert got.count() > 0 and got.exceptAll(want).count() == 0


def test_split_reports(spark):
    """Any number of attributes per report estimates the same boxes; precomputed cells answer like the reports."""
    trees = [Tree("x", 8, 2), Tree("y", 3), Tree("z", 2)]
    users = spark.range(40_000).select(F.col("id").alias("uid"), (F.col("id") % 8).alias("x"), (F.col("id") % 3).alias("y"), (F.col("id") % 5 % 2).alias("z"), F.lit(1).alias("measure"))
    schema = {"x": Ordinal(0, 7), "y": Category(("a", "b", "c")), "z": Category(("p", "q"))}
    asked = [bind(q, schema) for q in ("select sum(m) from t where 1<=x<=5", "select sum(m) from t where y=b and z=q", "select sum(m) from t where 0<=x<=3 and y=a and z=p")]
    truth = {r.query: r["count"] for r in hio.exact(users, asked).collect()}
    for size in (1, 2, 3):
        for style in ("rl", "bl"):
            plan = split.groups(trees, 12.0, size, style)
            got = split.estimate(split.reports(users, "uid", trees, plan), asked, trees, plan, style)
            for r in got.collect():
                assert r.est == pytest.approx(truth[r.query], abs=2500), (size, style)
    assert split.partings(3, 2) == [((0, 1), (2,)), ((0, 2), (1,)), ((0,), (1, 2))]
    plan = hio.groups(trees, 2.0)
    sent = hio.reports(users, "uid", trees, plan)
    a = {r.query: r.est for r in hio.estimate(sent, asked, trees, plan).collect()}
    b = {r.query: r.est for r in hio.lookup(hio.estimate_all(sent, plan), asked, trees, plan).collect()}
    assert a == pytest.approx(b)


def test_small_parts(spark):
    assert random_box({"x": 100, "y": 100}, 0.25, "s")["x"][1] - random_box({"x": 100, "y": 100}, 0.25, "s")["x"][0] == 50
    assert list(random_box({"x": 100, "y": 100}, 0.25, "s", fixed="y")) == ["y"]
    d = spark.createDataFrame([(0, 5), (1, 1), (2, 3)], "measure long, n long")
    assert [r.weight for r in tables.averaged_weights(d, 2).orderBy("measure").collect()] == [round(1 / 6, 6)] * 2 + [2.0]
    assert d.select(tables.nonzero_weight("measure", 5)).first()[0] == 5
    assert tables.uniform_users(spark, 100, 4).agg(F.max("v")).first()[0] < 4
