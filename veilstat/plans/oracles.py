"""DuckDB SQL with the same results as the registered queries, written from the formulas, not from the plans."""

from __future__ import annotations

from math import prod

from veilstat.functions import mechanisms as M
from veilstat.functions.rng import PRIME, cut
from veilstat.operators import heavy, itemsets

from . import catalog as C
from . import hio

EPS = C.EPS


def u(key: str, salt: str) -> str:
    return f"(('0x' || substr(md5(({key})::VARCHAR || ':{salt}'), 1, 8))::BIGINT)"


def d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0"


ORDERS = "SELECT o_orderkey AS uid, o_custkey % 100 AS v FROM orders"
ITEMS = """SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS uid, l_quantity::BIGINT - 1 AS qty,
  round(l_discount * 100)::BIGINT AS disc, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS status, l_linenumber::BIGINT AS measure FROM lineitem"""


def labelled(table: str, key: str, column: str) -> str:
    return f"SELECT {key} AS uid, code AS v FROM {table} JOIN (SELECT {column} AS label, row_number() OVER (ORDER BY {column}) - 1 AS code FROM (SELECT DISTINCT {column} FROM {table})) ON {column} = label"


def flip(x: str, key: str, salt: str, keep: str, size: str) -> str:
    z = f"({u(key, salt + 'z')} % ({size} - 1))"
    return f"CASE WHEN {u(key, salt + 'u')} < {keep} THEN {x} WHEN {z} >= {x} THEN {z} + 1 ELSE {z} END"


def sent(users: str, m: M.Mechanism, salt: str = "r") -> str:
    """Reports of users(uid, v)."""
    if m.kind == "grr":
        return f"SELECT uid, {flip('v', 'uid', salt, str(cut(m.p)), str(m.size))} AS y FROM ({users})"
    a, b = f"({u('uid', salt + 'a')} % {PRIME - 1} + 1)", f"({u('uid', salt + 'b')} % {PRIME})"
    inner = f"SELECT uid, a, b, ((a * v + b) % {PRIME}) % {m.size} AS x FROM (SELECT uid, v, {a} AS a, {b} AS b FROM ({users}))"
    return f"SELECT uid, a, b, {flip('x', 'uid', salt, str(cut(m.p)), str(m.size))} AS y FROM ({inner})"


def est(c: str, n: str, m: M.Mechanism) -> str:
    if m.kind == "olh":
        return f"({m.size} * {c} - {n}) / {d(m.p * m.size - 1)}"
    return f"({c} - {n} * {d(m.q)}) / {d(m.p - m.q)}"


def counts(users: str, m: M.Mechanism, salt: str = "r", domain: str | None = None) -> str:
    """v, c, n over the domain."""
    domain = domain or f"SELECT range AS v FROM range({m.d})"
    if m.kind == "ue":
        bit = f"{u('concat_ws(chr(58), uid, t.v)', salt + 'u')} < CASE WHEN t.v = s.v THEN {cut(m.p)} ELSE {cut(m.q)} END"
        return f"SELECT t.v, count(*) FILTER (WHERE {bit}) AS c, count(*) AS n FROM ({users}) s, ({domain}) t GROUP BY t.v"
    hit = f"((a * t.v + b) % {PRIME}) % {m.size} = y" if m.hashes else "y = t.v"
    return f"SELECT t.v, count(*) FILTER (WHERE {hit}) AS c, count(*) AS n FROM ({sent(users, m, salt)}) s, ({domain}) t GROUP BY t.v"


def hist(users: str, m: M.Mechanism, salt: str = "r") -> str:
    return f"SELECT v, {rnd(est('c', 'n', m))} AS est FROM ({counts(users, m, salt)})"


LH = M.lh(EPS, 100)
BASE = hist(ORDERS, LH)
N = "(SELECT count(*) FROM orders)"
RANKED = f"SELECT *, row_number() OVER (ORDER BY est DESC, v) AS r FROM ({BASE})"

NORM_CUT = f"""WITH b AS (SELECT *, sum(est) OVER (ORDER BY est DESC, v ROWS UNBOUNDED PRECEDING) AS s FROM ({RANKED})),
k AS (SELECT coalesce((SELECT min(r) FROM b WHERE s > {N}), (SELECT max(r) FROM b)) AS k)
SELECT v, {rnd(f"CASE WHEN r <= k THEN est * {N} / (SELECT s FROM b, k WHERE r = k.k) ELSE 0e0 END")} AS est FROM b, k"""

NORM_SUB = f"""WITH b AS (SELECT v, est, greatest(est, 0e0) AS c FROM ({BASE})),
o AS (SELECT *, row_number() OVER (ORDER BY c DESC, v) AS k, sum(c) OVER (ORDER BY c DESC, v ROWS UNBOUNDED PRECEDING) AS s FROM b),
t AS (SELECT sum(c) AS total, count(*) FILTER (WHERE c > 0) AS pos, abs(sum(est) - {N}) <= 1 AND min(est) >= 0 AS done FROM b),
m AS (SELECT (s - {N}) / k AS cut FROM o WHERE c > 0 AND c > (s - {N}) / k ORDER BY k DESC LIMIT 1)
SELECT v, {rnd(f"CASE WHEN done THEN est WHEN c <= 0 THEN 0e0 ELSE greatest(c + CASE WHEN total <= {N} THEN ({N} - total) / pos ELSE -(SELECT cut FROM m) END, 0e0) END")} AS est FROM b, t"""


def mle(first: bool) -> str:
    p, q = LH.p, LH.q
    a, b = p * (1 - p), q * (1 - q)
    out = f"WITH r0 AS (SELECT v, (est * {d(p - q)} + {N}::DOUBLE * {d(q)}) / {N} AS o, est / {N} AS e FROM ({BASE}))"
    for i in range(8):  # more than the test data need; a round that finds no negatives changes nothing
        again = "true" if first and not i else "(min(e) OVER ()) < 0"
        k, s = "(count(*) FILTER (WHERE e > 0) OVER ())", "(sum(o) FILTER (WHERE e > 0) OVER ())"
        if first:
            x = f"(({s} - {d(p)} - ({k} - 1) * {d(q)}) / ({d(a)} + ({k} - 1) * {d(b)}))"
            new = f"(o - {d(q)} - {d(b)} * {x}) / ({d(p - q)} + {d(a - b)} * {x})"
        else:
            new = f"(o / {s} * ({k} * {d(q)} + {d(p - q)}) - {d(q)}) / {d(p - q)}"
        out += f", r{i + 1} AS (SELECT v, o, CASE WHEN NOT ({again}) THEN e WHEN e > 0 THEN {new} ELSE 0e0 END AS e FROM r{i})"
    return out + f" SELECT v, {rnd(f'e * {N}')} AS est FROM r8"


SW = M.SquareWave(EPS)
_w, _p, _q = d(SW.w), d(SW.p), d(SW.q)
WAVES = f"""SELECT CASE WHEN u <= {_q} * s THEN u / {_q} - {_w} / 2 WHEN u <= {_q} * s + {_p} * {_w} THEN (u - {_q} * s) / {_p} + s - {_w} / 2
  ELSE (u - {_q} * s - {_p} * {_w}) / {_q} + s + {_w} / 2 END AS y
FROM (SELECT {u('o_orderkey', 's')} / 4294967296e0 AS u, o_totalprice / 500000 AS s FROM orders)"""
SW_HIST = f"""SELECT j.range AS j, count(y) AS h FROM range(16) j LEFT JOIN ({WAVES}) ON least(floor((y + {d(SW.w / 2)}) / {d((1 + SW.w) / 16)}), 15)::BIGINT = j.range GROUP BY 1"""


def _over(x: str) -> str:
    def f(v):
        return f"(greatest({x} - {v} + {d(SW.w / 2)}, 0e0) ** 2 / 2 - greatest({x} - {v} - {d(SW.w / 2)}, 0e0) ** 2 / 2)"

    return f"({f('i * 0.0625e0')} - {f('(i * 0.0625e0 + 0.0625e0)')})"


_lo = f"({d(-SW.w / 2)} + j * {d((1 + SW.w) / 16)})"
SW_MATRIX = f"SELECT j.range AS j, i.range AS i, {d(SW.q * (1 + SW.w) / 16)} + {d(SW.p - SW.q)} * ({_over(f'({_lo} + {d((1 + SW.w) / 16)})')} - {_over(_lo)}) / 0.0625e0 AS p FROM range(16) j(j), range(16) i(i)".replace("j.range AS j", "j").replace("i.range AS i", "i")


def sw_em(smooth: bool) -> str:
    out = f"WITH m AS ({SW_MATRIX}), h AS ({SW_HIST}), t0 AS (SELECT range AS i, 0.0625e0 AS t FROM range(16))"
    for r in range(3):
        out += f""", z{r} AS (SELECT j, sum(p * t) AS z FROM m JOIN t{r} USING (i) GROUP BY j),
        s{r} AS (SELECT i, any_value(t) * sum(p * h / z) AS t FROM m JOIN t{r} USING (i) JOIN h USING (j) JOIN z{r} USING (j) GROUP BY i),
        n{r} AS (SELECT i, t / (SELECT sum(t) FROM s{r}) AS t FROM s{r})"""
        if smooth:
            out += f""", k{r} AS (SELECT a.i, sum(b.t * (2 - abs(a.i - b.i))) / sum(2 - abs(a.i - b.i)) AS t FROM n{r} a JOIN n{r} b ON abs(a.i - b.i) <= 1 GROUP BY a.i),
            t{r + 1} AS (SELECT i, t / (SELECT sum(t) FROM k{r}) AS t FROM k{r})"""
        else:
            out += f", t{r + 1} AS (SELECT * FROM n{r})"
    return out + f" SELECT i, {rnd('t')} AS theta FROM t3"


TREE = """RECURSIVE t(attr, f, depth, layer, lo, hi, plo, phi) AS (
  SELECT * FROM (VALUES ('qty', 4, 3, 0, 0::BIGINT, 50::BIGINT, -1::BIGINT, -1::BIGINT), ('disc', 4, 2, 0, 0, 11, -1, -1), ('flag', 3, 1, 0, 0, 3, -1, -1), ('status', 2, 1, 0, 0, 2, -1, -1))
  UNION ALL
  SELECT attr, f, depth, layer + 1, lo + floor((hi - lo)::DOUBLE / f * i)::BIGINT, CASE WHEN i = f - 1 THEN hi ELSE lo + floor((hi - lo)::DOUBLE / f * (i + 1))::BIGINT END, lo, hi
  FROM t, range(4) r(i) WHERE layer < depth AND i < f
    AND CASE WHEN i = f - 1 THEN hi ELSE lo + floor((hi - lo)::DOUBLE / f * (i + 1))::BIGINT END > lo + floor((hi - lo)::DOUBLE / f * i)::BIGINT
), nodes AS (SELECT attr, layer, (row_number() OVER (PARTITION BY attr, layer ORDER BY lo) - 1)::INTEGER AS idx, lo, hi, plo, phi FROM t)"""
COVER = f"""WITH {TREE}, q AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in enumerate(C.RANGES))}) x(query, a, b))
SELECT query, layer::INTEGER AS layer, idx, lo, hi FROM nodes JOIN q ON lo >= a AND hi <= b AND NOT (plo >= a AND phi <= b) WHERE attr = 'qty'"""

FANOUT = """WITH g AS (SELECT eps, b, ln(1024) / ln(b) AS h FROM (VALUES (0.5e0), (1e0), (2e0), (4e0)) e(eps), range(2, 1025) r(b)),
x AS (SELECT eps, b, (b - 1) * h * exp(eps / h) / (exp(eps / h) - 1) ** 2 AS err FROM g)
SELECT eps, arg_min(b, err)::INTEGER AS fanout FROM x GROUP BY eps"""


def ci() -> str:
    out = []
    for layer in range(4):
        m = M.grr(EPS, 2 << layer)
        own = f"SELECT o_orderkey AS uid, (o_custkey % 16) >> {3 - layer} AS v FROM orders WHERE {u('o_orderkey', 'cig')} % 4 = {layer}"
        out.append(f"z{layer} AS (SELECT v AS idx, ({est('c', 'n', m)}) / n * {N} AS est FROM ({counts(own, m, 'ci')}))")
    a, b = d((2**5 - 2**4) / (2**5 - 1)), d((2**4 - 1) / (2**5 - 1))
    out.append("y3 AS (SELECT * FROM z3)")
    for i in (2, 1, 0):
        out.append(f"y{i} AS (SELECT z.idx, {a} * any_value(z.est) + {b} * sum(k.est) AS est FROM z{i} z JOIN y{i + 1} k ON k.idx // 2 = z.idx GROUP BY z.idx)")
    out.append("x0 AS (SELECT * FROM y0)")
    for i in (1, 2, 3):
        out.append(f"s{i} AS (SELECT idx // 2 AS up, sum(est) AS kids FROM y{i} GROUP BY 1)")
        out.append(f"x{i} AS (SELECT y.idx, y.est + (x.est - s.kids) / 2 AS est FROM y{i} y JOIN x{i - 1} x ON x.idx = y.idx // 2 JOIN s{i} s ON s.up = y.idx // 2)")
    return "WITH " + ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {i} AS layer, idx, {rnd('est')} AS est FROM x{i}" for i in range(4))


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else d(x) if isinstance(x, float) else str(x) for x in r) + ")" for r in rows) + ")"


def hio_sql(trees, style: str, eps: float = EPS) -> str:
    plan, queries = hio.groups(trees, eps, style), C._queries(trees)
    cfg = [(g.gid, int(g.mechanism.hashes), g.mechanism.size, cut(g.mechanism.p), g.mechanism.p, g.mechanism.q, *g.layers, *(prod(g.sizes[i + 1 :]) for i in range(len(trees)))) for g in plan]
    names = ", ".join([f"l{i}" for i in range(len(trees))] + [f"m{i}" for i in range(len(trees))])
    tn = [(t.attr, n.layer, n.idx, n.lo, n.hi) for t in trees for layer in t.layers for n in layer]
    asked = hio.nodes(queries, trees, plan, style)
    joins = " ".join(f"JOIN tn n{i} ON n{i}.attr = '{t.attr}' AND n{i}.layer = l{i} AND {t.attr} >= n{i}.lo AND {t.attr} < n{i}.hi" for i, t in enumerate(trees))
    code = " + ".join(f"n{i}.idx * m{i}" for i in range(len(trees)))
    pick = "true" if style == "al" else f"gid = {u('uid', 'hg')} % {len(plan)}"
    key = "uid || ':' || gid::VARCHAR"
    n = "any_value(n)"
    return f"""WITH it AS ({ITEMS}), tn(attr, layer, idx, lo, hi) AS {values(tn)}, cfg(gid, lh, size, keep, p, q, {names}) AS {values(cfg)},
asked(query, gid, code) AS {values(asked)},
c AS (SELECT {key} AS k, measure, gid, lh, size, keep, p, q, ({code})::BIGINT AS code FROM it JOIN cfg ON {pick} {joins}),
x AS (SELECT *, {u('k', 'ha')} % {PRIME - 1} + 1 AS a, {u('k', 'hb')} % {PRIME} AS b FROM c),
h AS (SELECT *, CASE WHEN lh = 1 THEN ((a * code + b) % {PRIME}) % size ELSE code END AS v FROM x),
r AS (SELECT measure, gid, lh, size, p, q, a, b, {flip('v', 'k', 'h', 'keep', 'size')} AS y FROM h),
g AS (SELECT gid, measure, count(*) AS ng FROM r GROUP BY 1, 2), nm AS (SELECT measure, count(*) AS n FROM it GROUP BY 1),
e AS (SELECT query, r.measure, r.gid, count(*) FILTER (WHERE CASE WHEN lh = 1 THEN ((a * code + b) % {PRIME}) % size ELSE code END = y) AS c, count(*) AS pairs, any_value(p) AS p, any_value(q) AS q
      FROM r JOIN asked USING (gid) GROUP BY 1, 2, 3),
s AS (SELECT query, measure, (c - pairs * q) / (p - q) * n / ng AS est FROM e JOIN g USING (gid, measure) JOIN nm USING (measure)
      UNION ALL SELECT query, measure, n::DOUBLE FROM asked, nm WHERE gid = -1),
ga AS (SELECT gid, sum(ng)::BIGINT AS ng FROM g GROUP BY 1), na AS (SELECT sum(n)::BIGINT AS n FROM nm),
ea AS (SELECT query, gid, sum(c)::BIGINT AS c, sum(pairs)::BIGINT AS pairs, any_value(p) AS p, any_value(q) AS q FROM e GROUP BY 1, 2),
sa AS (SELECT query, (c - pairs * q) / (p - q) * n / ng AS est FROM ea JOIN ga USING (gid), na UNION ALL SELECT query, n::DOUBLE FROM asked, na WHERE gid = -1),
f AS (SELECT query, sum(est) AS count FROM sa GROUP BY 1), w AS (SELECT query, sum(measure * est) AS sum FROM s GROUP BY 1)
SELECT query, {rnd('count')} AS count, {rnd('sum')} AS sum, {rnd('sum / count')} AS avg FROM f JOIN w USING (query)"""


def joint() -> str:
    fm, sm = M.adaptive(1.0, 3), M.adaptive(1.0, 2)
    f = flip("flag", "uid", "q0", str(cut(fm.p)), str(fm.size))
    s = flip("status", "uid", "q1", str(cut(sm.p)), str(sm.size))
    return f"""WITH r AS (SELECT {f} AS yf, {s} AS ys FROM ({ITEMS}))
SELECT f.v::INTEGER AS flag, s.v::INTEGER AS status, {rnd(f"sum((CASE WHEN yf = f.v THEN {d(1 - fm.q)} ELSE {d(-fm.q)} END) / {d(fm.p - fm.q)} * (CASE WHEN ys = s.v THEN {d(1 - sm.q)} ELSE {d(-sm.q)} END) / {d(sm.p - sm.q)})")} AS est
FROM r, range(3) f(v), range(2) s(v) GROUP BY 1, 2"""


CE = f"""SELECT v // 6 AS disc, (v // 2) % 3 AS flag, v % 2 AS status, est FROM ({hist(f'SELECT uid, (disc * 3 + flag) * 2 + status AS v FROM ({ITEMS})', M.adaptive(EPS, 66), 'ce')})"""
CE = f"SELECT disc, flag, status, {rnd('sum(est)')} AS est FROM ({CE}) GROUP BY CUBE (disc, flag, status)"


def views() -> str:
    m, box, out = M.ue(EPS, 2), {"disc": (2, 8), "flag": (0, 2), "status": (0, 1)}, []
    for i, (a, b) in enumerate(C.VIEWS):
        na, nb = C.VIEW_SIZES[a], C.VIEW_SIZES[b]
        rest = prod((hi - lo) / C.VIEW_SIZES[x] for x, (lo, hi) in box.items() if x not in (a, b))
        own = f"SELECT uid, {a} * {nb} + {b} AS v FROM ({ITEMS}) WHERE {u('uid', 'vg')} % 3 = {i}"
        cells = counts(own, M.ue(EPS, na * nb), "v")
        inside = f"v // {nb} >= {box[a][0]} AND v // {nb} < {box[a][1]} AND v % {nb} >= {box[b][0]} AND v % {nb} < {box[b][1]}"
        out.append(f"SELECT {i}::BIGINT AS view, (sum(c)::DOUBLE / any_value(n) - count(*) * {d(m.q)}) / {d(m.p - m.q)} * {d(rest)} AS share FROM ({cells}) WHERE {inside}")
    return " UNION ALL ".join(out)


def exact() -> str:
    out = []
    for i, q in enumerate(C._queries(C.ALL_TREES)):
        cond = " AND ".join(f"{a} >= {lo} AND {a} < {hi}" for a, (lo, hi) in q.box.items()) or "true"
        out.append(f"SELECT {i} AS query, count(*) FILTER (WHERE {cond}) AS count, (sum(measure) FILTER (WHERE {cond}))::DOUBLE AS sum, count(*) AS n FROM it")
    return f"WITH it AS ({ITEMS}), x AS ({' UNION ALL '.join(out)}) SELECT query, count, sum, {rnd('sum / count')} AS avg, {rnd('count / n')} AS selectivity FROM x"


VALUES = "SELECT event_id AS uid, floor(value)::BIGINT AS v FROM events"


def pem_part(i: int, cand: str, n_cand: int, shift: int, t: int) -> str:
    m = M.lh_half(C.PEM_EPS, n_cand + 1)
    low = f"(v & {(1 << shift) - 1})"
    own = f"SELECT uid, CASE WHEN {low} IN ({cand}) THEN {low} ELSE {1 << shift} END AS v FROM ({VALUES}) WHERE {u('uid', 'mg')} % {t} = {i}"
    return f"SELECT v, c, n, {rnd(est('c', 'n', m))} AS est FROM ({counts(own, m, f'm{i}', cand)})"


def pem() -> str:
    first, t = heavy.rounds(C.PEM_BITS, C.PEM_K)
    out, cand, have, size = [], f"SELECT range AS v FROM range({C.PEM_K})", 3, C.PEM_K
    for i in range(t):
        shift = min(C.PEM_BITS, first + i)
        step = shift - have
        out.append(f"c{i} AS (SELECT DISTINCT (s.range << {have}) + x.v AS v FROM ({cand}) x, range({1 << step}) s)")
        out.append(f"e{i} AS MATERIALIZED ({pem_part(i, f'SELECT v FROM c{i}', size << step, shift, t)} ORDER BY est DESC, v LIMIT {C.PEM_K})")
        cand, have = f"SELECT v FROM e{i}", shift
    return "WITH " + ", ".join(out) + f" SELECT v, {rnd('est * (SELECT count(*) FROM events)::DOUBLE / n')} AS est FROM e{t - 1}"


BRAND = "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS item FROM part"
BASKETS = f"SELECT l_orderkey AS uid, list_sort(list(DISTINCT item)) AS items FROM lineitem JOIN ({BRAND}) ON l_partkey = p_partkey GROUP BY 1"


def phase(key: str) -> str:
    total, out = 0.0, ""
    for i, s in enumerate(itemsets.PHASES[:-1]):
        total += s
        out += f" WHEN {u(key, 'ph')} < {cut(total)} THEN {i}"
    return f"CASE{out} ELSE {len(itemsets.PHASES) - 1} END"


def in_phase(i: int) -> str:
    return f"SELECT * FROM ({BASKETS}) WHERE {phase('uid')} = {i}"


CAND = "[" + ", ".join(map(str, C.CANDIDATES)) + "]"
PADDED = itemsets.mechanism(4.0, len(C.CANDIDATES), 3)
_pad = f"""SELECT uid, CASE WHEN place < len(own) THEN list_position({CAND}, own[place + 1]) - 1 ELSE {len(C.CANDIDATES)} END AS v
FROM (SELECT uid, own, {u('uid', 's3p')} % greatest(len(own), 3) AS place FROM (SELECT uid, list_sort(list_intersect(items, {CAND})) AS own FROM ({in_phase(2)})))"""
SVSM_PAD = f"SELECT {CAND}[v + 1]::INTEGER AS item, {rnd(f'({rnd(est('c', 'n', PADDED))}) * 3')} AS est FROM ({counts(_pad, PADDED, 's3')}) WHERE v < {len(C.CANDIDATES)}"
_len = f"SELECT uid, CASE WHEN n > 8 THEN 0 ELSE n END AS v FROM (SELECT uid, len(list_intersect(items, {CAND})) AS n FROM ({in_phase(1)})) WHERE n > 0"
_one = f"SELECT uid, items[{u('uid', 's1i')} % len(items) + 1] AS v FROM ({in_phase(0)}) WHERE len(items) > 0"
CONTAINED = f"WITH b AS ({BASKETS}) " + " UNION ALL ".join(f"SELECT {i} AS s, {len(s)} AS size, count(*) FILTER (WHERE list_has_all(items, {list(s)})) AS n FROM b" for i, s in enumerate(C.SETS))
#: All subsets of four weighted items by the product of 0.9 * weight / largest.
SETS = """WITH w(i, p) AS (VALUES (0, 0.9e0), (1, 90 * 0.9e0 / 100), (2, 60 * 0.9e0 / 100), (3, 30 * 0.9e0 / 100)),
s AS (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) AS items, product(p) AS p, count(*) AS n FROM range(16) m(m), w WHERE (m.m >> i) & 1 = 1 GROUP BY m.m)
SELECT (row_number() OVER (ORDER BY p DESC))::INTEGER AS rank, items FROM s WHERE n > 1 ORDER BY p DESC LIMIT 6"""

_L = "(14 * ln(2 / 1e-9))"
_VAR = """(n * q * (1 - q) + n / d * (p * (1 - p) - q * (1 - q)) + r * p2 * (1 - p2)) / n / n / (p - q) ** 2"""
MURS = f"""WITH g AS (SELECT e, n, d, r FROM (VALUES (0.5e0), (1e0), (2e0)) a(e), (VALUES (1e4), (1e6)) b(n), (VALUES (4e0), (100e0)) c(d), (VALUES (0e0), (5000e0)) f(r)),
x AS (SELECT *, exp(e) / (exp(e) + d - 1) AS p, 1 / (exp(e) + d - 1) AS q, {_L} AS l, e * e * (n - 1) / {_L} - d + 1 AS a1, e * e / 4 * (n - 1) / {_L} - 1 AS a2,
  (n - 1) / ({_L} / (e * e) - r / d) - (d - 1) AS a3, e * e * (n - 1 + r) / (4 * {_L}) - 1 AS a4 FROM g),
y AS (SELECT *, q + (p - q) / d AS p2, round_even(exp(e / 2) + 1, 0) AS g FROM x)
SELECT e, n, d, r, {rnd('sqrt(l / ((n - 1) / (exp(e) + d - 1)))')} AS c_grr, {rnd('sqrt(4 * l / ((n - 1) / (exp(e) + g - 1)))')} AS c_hash,
  {rnd('sqrt(l / ((n - 1) / (exp(e) + d - 1) + r / d))')} AS c_fakes, CASE WHEN r > 0 THEN {rnd('sqrt(l / (r / d))')} END AS c_alone,
  {rnd('CASE WHEN a1 > 1 THEN ln(a1) ELSE -1e0 END')} AS l_grr, {rnd('CASE WHEN a2 > 1 THEN 2 * ln(a2) ELSE -1e0 END')} AS l_hash,
  {rnd('CASE WHEN a3 > 1 THEN ln(a3) ELSE -1e0 END')} AS l_grr_fakes, {rnd('CASE WHEN a4 > 1 THEN 2 * ln(a4) ELSE -1e0 END')} AS l_hash_fakes, {rnd(f'({_VAR}) * 1e6')} AS var FROM y"""
MURS_GRID = f"""WITH g AS (SELECT 1e3 + i * {d((2e6 - 1000.0) / 49)} AS r FROM range(50) x(i)), t AS (SELECT r, (1e6 - 1) / ({_L} / 0.25e0 - r / 100) - 99 AS t FROM g),
x AS (SELECT r, ln(t) AS e, 1e6 AS n, 1e2 AS d FROM t WHERE t > 1 AND ln(t) > 0), y AS (SELECT *, exp(e) / (exp(e) + 99) AS p, 1 / (exp(e) + 99) AS q FROM x), z AS (SELECT *, q + (p - q) / d AS p2 FROM y)
SELECT {rnd('r', 3)} AS fakes, {rnd('e')} AS e0, {rnd(f'({_VAR}) * 1e9', 4)} AS var FROM z"""
_g5 = M.grr(2.0, 5)
FAKES = f"SELECT v, {rnd(f'({rnd(est('c', 'n', _g5))}) - 200')} AS est FROM ({counts(f'''SELECT 'u' || uid::VARCHAR AS uid, v FROM ({labelled('events', 'event_id', 'event_type')}) UNION ALL SELECT 'f' || i::VARCHAR, {u('i', 'muf')} % 5 FROM range(1000) r(i)''', _g5, 'mu')})"
_events = labelled("events", "event_id", "event_type").replace("SELECT event_id AS uid", "SELECT ts, event_id AS uid")
WINDOWED = f"""WITH r AS (SELECT time_bucket(INTERVAL 7 DAY, ts::TIMESTAMP, TIMESTAMP '1970-01-01') AS w, {flip('v', 'uid', 'r', str(cut(_g5.p)), '5')} AS y FROM ({_events})), n AS (SELECT w, count(*) AS n FROM r GROUP BY 1)
SELECT strftime(n.w, '%Y-%m-%d %H:%M:%S') AS start, d.v, {rnd(est('count(y)', 'any_value(n)', _g5))} AS est FROM n CROSS JOIN range(5) d(v) LEFT JOIN r ON r.w = n.w AND y = d.v GROUP BY n.w, d.v"""

ORACLES = {
    "hio_rl": hio_sql(C.ALL_TREES, "rl"),
    "grr_histogram": hist(labelled("events", "event_id", "event_type"), M.grr(EPS, 5)),
    "lh_histogram": BASE,
    "olh_histogram": hist(ORDERS, M.olh(EPS, 100)),
    "lh_half_histogram": hist(ORDERS, M.lh_half(2.0, 100)),
    "ue_histogram": hist(labelled("orders", "o_orderkey", "o_orderpriority"), M.ue(EPS, 5)),
    "adaptive_histogram": hist(labelled("part", "p_partkey", "p_brand"), M.adaptive(EPS, 25)),
    "fo_variance_filter": f"SELECT v, CASE WHEN est < {d(M.noise_floor(LH, 1))} * sqrt({N}) THEN 0e0 ELSE est END AS est FROM ({BASE})",
    "fo_top_size": f"SELECT v, CASE WHEN r <= 10 THEN greatest(est, 1e0) ELSE 0e0 END AS est FROM ({RANKED})",
    "fo_topk_sentinel": f"SELECT v, CASE WHEN r <= 10 THEN greatest(est, 0e0) ELSE -1e0 END AS est FROM ({RANKED})",
    "post_base_pos": f"SELECT v, greatest(est, 0e0) AS est FROM ({BASE})",
    "post_norm": f"SELECT v, {rnd(f'est + ({N} - sum(est) OVER ()) / 100')} AS est FROM ({BASE})",
    "post_norm_mul": f"SELECT v, {rnd(f'greatest(est, 0e0) * {N} / sum(greatest(est, 0e0)) OVER ()')} AS est FROM ({BASE})",
    "post_norm_cut": NORM_CUT,
    "post_norm_sub": NORM_SUB,
    "post_mle_apx": mle(True),
    "post_mle_grr": mle(False),
    "sw_reports_hist": SW_HIST,
    "sw_matrix": f"SELECT j, i, {rnd('p', 9)} AS p FROM ({SW_MATRIX})",
    "sw_em": sw_em(False),
    "sw_ems": sw_em(True),
    "tree_nodes": f"WITH {TREE} SELECT attr, layer::INTEGER AS layer, idx, lo, hi FROM nodes",
    "range_cover": COVER,
    "best_fanout": FANOUT,
    "ci_consistency": ci(),
    "hio_1d": hio_sql([C.QTY], "rl"),
    "hio_2d": hio_sql([C.QTY, C.DISC], "rl"),
    "hio_mixed": hio_sql([C.DISC, C.FLAG, C.STATUS], "rl"),
    "hio_all_layers": hio_sql([C.FLAG, C.STATUS], "al", 4.0),
    "hio_bottom": hio_sql([C.FLAG, C.STATUS], "bl"),
    "hio_sr_joint": joint(),
    "ce_marginals": CE,
    "mg_view_sum": f"SELECT view, {rnd('share')} AS share FROM ({views()})",
    "mg_answer": f"SELECT {rnd('avg(share) * (SELECT count(*) FROM lineitem)', 2)} AS est FROM (SELECT {rnd('share')} AS share FROM ({views()}))",
    "exact_box": exact(),
    "weight_bins": f"WITH m AS (SELECT l_linenumber::BIGINT AS measure, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, ntile(3) OVER (ORDER BY measure)::INTEGER AS bin FROM m) SELECT measure, bin, {rnd('sum(measure * n) OVER (PARTITION BY bin)::DOUBLE / sum(n) OVER (PARTITION BY bin)')} AS weight FROM t",
    "pem_round": pem_part(0, "SELECT range AS v FROM range(16)", 16, 4, 6),
    "pem_heavy_hitters": pem(),
    "pem_hits": f"WITH f AS ({pem()}), t AS (SELECT v, count(*) AS count FROM ({VALUES}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 16) SELECT count(*) AS n, coalesce(sum(count), 0)::BIGINT AS mass FROM f JOIN t USING (v)".replace("WITH f AS (WITH", "WITH f AS (WITH"),
    "svsm_singletons": hist(_one, M.lh_half(4.0, 25), "s1"),
    "svsm_length_dist": hist(_len, M.lh_half(4.0, 9), "s2"),
    "svsm_pad_sample": SVSM_PAD,
    "svsm_contained": CONTAINED,
    "svsm_candidates": SETS,
    "murs_accounting_grid": MURS,
    "murs_fake_grid": MURS_GRID,
    "murs_fake_estimate": FAKES,
    "encode_dictionary": "SELECT row_number() OVER (ORDER BY p_brand) - 1 AS code, p_brand AS label FROM (SELECT DISTINCT p_brand FROM part)",
    "bucketize": "SELECT least(greatest(floor(o_totalprice / 50000)::BIGINT, 0), 9) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "dup_rows": "SELECT n_nationkey, c::INTEGER AS copy FROM nation, range(1, 4) r(c)",
    "sample_n": f"SELECT o_orderkey FROM orders ORDER BY {u('o_orderkey', 'sample')}, o_orderkey LIMIT 500",
    "sample_p": f"SELECT o_orderkey FROM orders WHERE {u('o_orderkey', 'sample')} < {cut(0.1)}",
    "phase_counts": f"SELECT {phase('o_orderkey')} AS phase, count(*) AS n FROM orders GROUP BY 1",
    "estimate_error": f"WITH t AS (SELECT v, count(*) AS c FROM ({ORDERS}) GROUP BY 1) SELECT {rnd('avg((coalesce(est, 0e0) - coalesce(c, 0)) ** 2)', 3)} AS mse, {rnd('avg(abs(coalesce(est, 0e0) - coalesce(c, 0)))')} AS mae FROM ({BASE}) b FULL JOIN t USING (v)",
    "windowed_histogram": WINDOWED,
    "olh_uniform": hist(f"SELECT i AS uid, {u('i', 'uniform')} % 1024 AS v FROM range(10000) r(i)", M.olh(2.0, 1024)),
    "hio_lookup": f"SELECT query, sum FROM ({hio_sql([C.DISC, C.FLAG, C.STATUS], 'rl')})",
    "query_error": f"""WITH e AS ({hio_sql([C.FLAG, C.STATUS], 'rl')}), t AS (SELECT 0 AS query, count(*) AS t FROM ({ITEMS}) WHERE flag = 0 AND status = 0)
SELECT query, {rnd('(count - t) ** 2', 3)} AS squared, {rnd('abs(count - t) / 60000e0')} AS of_total, {rnd('CASE WHEN t > 0 THEN abs(count - t) / t ELSE 0e0 END')} AS relative FROM e JOIN t USING (query)""",
    "murs_choice": f"""WITH x AS (SELECT 0.5e0 AS ec, 1e6 AS n, 1e3 AS d, 0e0 AS r), t AS (SELECT *, (n - 1) / ({_L} / (ec * ec) - r / d) - (d - 1) AS a, ec * ec * (n - 1 + r) / (4 * {_L}) - 1 AS b FROM x),
m AS (SELECT 'grr' AS mechanism, greatest(CASE WHEN a > 1 THEN ln(a) ELSE -1e0 END, ec) AS e0, CASE WHEN a > 1 THEN ln(a) > 0 ELSE false END AS gain, d AS size, n, r, 1e3 AS full_d FROM t
  UNION ALL SELECT 'olh', greatest(CASE WHEN b > 1 THEN 2 * ln(b) ELSE -1e0 END, ec), coalesce(b > 1, false), NULL, n, r, 1e3 FROM t),
s AS (SELECT mechanism, e0, gain, n, r, coalesce(size, round_even(exp(e0 / 2) + 1, 0)) AS d, full_d FROM m),
p AS (SELECT *, exp(e0) / (exp(e0) + d - 1) AS p, CASE WHEN d = full_d THEN 1 / (exp(e0) + d - 1) ELSE 1 / d END AS q FROM s), z AS (SELECT *, q + (p - q) / d AS p2 FROM p)
SELECT mechanism, d AS size, {rnd('e0')} AS e0, {rnd(f'({_VAR}) * 1e9', 4)} AS var FROM z ORDER BY gain DESC, {_VAR}, mechanism LIMIT 1""",
}
