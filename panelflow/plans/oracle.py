"""DuckDB SQL equivalents of :mod:`panelflow.plans.queries`.

Written independently of the Spark code, as plain window/aggregate SQL
over the driver views (``events``, ``customer``, ``nation``, ``region``,
``supplier``, ``lineitem``).  Doubles are rounded to 6 decimals like the
Spark side; integers are BIGINT.
"""

from __future__ import annotations

from panelflow.sources.tables import SPARSE_CONTEXTS, SPARSE_LABELS, SPARSE_SCALE_A, SPARSE_SCALE_B

A_ITEMS = list(SPARSE_SCALE_A)
B_ITEMS = list(SPARSE_SCALE_B)
ITEMS = A_ITEMS + B_ITEMS
CTX = list(SPARSE_CONTEXTS)
ORDER = "ORDER BY t ASC NULLS LAST, seq ASC"
GROUP = "CASE WHEN user_id % 2 = 1 THEN 'Y' ELSE 'N' END"
KVAL = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"
DAYS = "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']"
WDAY = "(CAST((floor(t / 86400) + 4) % 7 AS BIGINT) + 1)"


def r6(expr: str, alias: str, digits: int = 6) -> str:
    # "+ 0.0" turns a negative zero into 0.0, as on the Spark side
    return f"(round({expr}, {digits}) + 0.0) AS {alias}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


DENSE = f"""dense AS (
  SELECT user_id AS ID, epoch_us(ts) / 1e6 AS t, event_id AS seq, {GROUP} AS ADHD,
         value AS Y1, CAST({KVAL} AS DOUBLE) AS Y2
  FROM events)"""

SPARSE_LONG = f"""sl AS (
  SELECT user_id AS ID, CAST(floor(epoch_us(ts) / 1e6 / 86400) * 86400 AS DOUBLE) AS t,
         event_id AS seq, {GROUP} AS ADHD,
         event_type || '_' || CAST({KVAL} % 2 AS VARCHAR) AS label, value
  FROM events)"""

SPARSE_WIDE = "sw AS (SELECT ID, t, ADHD, min(seq) AS seq, " + ", ".join(
    f"max(CASE WHEN label = '{x}' THEN value END) AS {x}" for x in SPARSE_LABELS) + \
    " FROM sl GROUP BY ID, t, ADHD)"

D1 = f"""d1 AS (
  SELECT *, {DAYS}[{WDAY}] AS day_of_week,
         CASE WHEN {WDAY} IN (1, 7) THEN 1 ELSE 0 END AS weekend,
         row_number() OVER (PARTITION BY ID {ORDER}) AS obs
  FROM sw)"""


def sessions(src: str, name: str, obs: str | None = None, carry: tuple[str, ...] = ()) -> list[str]:
    """Gap sessionisation at 30 h of ``src`` (ID, t, seq) as CTE ``name``."""
    w = f"PARTITION BY ID {ORDER}"
    rn = f", row_number() OVER ({w}) AS {obs}" if obs else ""
    car = "".join(f", first_value({c}) OVER ({w}) AS {c}_first" for c in carry)
    return [
        f"{name}_a AS (SELECT *, lag(t) OVER ({w}) AS _tp, first_value(t) OVER ({w}) AS _t0{rn}{car} FROM {src})",
        f"{name}_b AS (SELECT *, (t - _tp) / 3600.0 AS gap_hours FROM {name}_a)",
        f"{name}_c AS (SELECT *, (gap_hours IS NULL OR gap_hours > 30.0) AS new_session FROM {name}_b)",
        f"{name}_d AS (SELECT *, SUM(CASE WHEN new_session THEN 1 ELSE 0 END) OVER ({w} "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM {name}_c)",
        f"{name}_e AS (SELECT *, first_value(t) OVER (PARTITION BY ID, session {ORDER}) AS _ts FROM {name}_d)",
        f"""{name} AS (SELECT *, (t - _t0) / 3600.0 AS RawHours, (t - _ts) / 3600.0 AS TimeHours,
             CASE WHEN new_session THEN (t - _ts) / 3600.0
                  ELSE (t - _ts) / 3600.0 - (_tp - _ts) / 3600.0 END AS time_interval FROM {name}_e)""",
    ]


ANY_A_B = " OR ".join(f"{c} IS NOT NULL" for c in ITEMS)
SPARSE_BASE = [SPARSE_LONG, SPARSE_WIDE, D1, f"k2 AS (SELECT * FROM d1 WHERE {ANY_A_B})",
               *sessions("k2", "d2", carry=("ADHD",))]

PV = " UNION ALL ".join(
    [f"SELECT ID, 'anti' AS s, {c} AS v FROM d2" for c in A_ITEMS] +
    [f"SELECT ID, 'pro' AS s, {c} AS v FROM d2" for c in B_ITEMS])
PV_CTES = [f"pv AS ({PV})",
           """vf AS (SELECT ID, var_samp(v) FILTER (WHERE s = 'anti') AS var_anti,
                     var_samp(v) FILTER (WHERE s = 'pro') AS var_pro FROM pv GROUP BY ID)""",
           "vf2 AS (SELECT *, (var_anti IS NULL OR var_pro IS NULL) AS flag_any FROM vf)"]


def row_mean(cols: list[str]) -> str:
    total = "0.0"
    for c in cols:
        total = f"({total} + coalesce({c}, 0.0))"
    cnt = "0"
    for c in cols:
        cnt = f"({cnt} + CAST({c} IS NOT NULL AS INTEGER))"
    return f"{total} / NULLIF(CAST({cnt} AS DOUBLE), 0)"


SCORED = PV_CTES + [
    "d4 AS (SELECT d2.* FROM d2 JOIN vf2 USING (ID) WHERE NOT flag_any)",
    f"d5a AS (SELECT *, {row_mean(A_ITEMS)} AS anti_mean, {row_mean(B_ITEMS)} AS pro_mean FROM d4)",
    """d5 AS (SELECT *, (anti_mean - avg(anti_mean) OVER ()) / NULLIF(stddev_samp(anti_mean) OVER (), 0) AS Y1,
                 (pro_mean - avg(pro_mean) OVER ()) / NULLIF(stddev_samp(pro_mean) OVER (), 0) AS Y2 FROM d5a)""",
]
BIN = ", ".join(f"CAST(coalesce({c}, 0.0) != 0.0 AS INTEGER) AS {c}" for c in CTX)
FEATURES = SCORED + [
    f"d6a AS (SELECT * REPLACE ({BIN}), CAST(coalesce(ADHD_first = 'Y', false) AS INTEGER) AS ADHD_numeric FROM d5)",
    "d6 AS (SELECT *, " + ", ".join(f"CAST(ADHD_numeric * {c} AS INTEGER) AS ADHD_x_{c}" for c in CTX) +
    ", CAST(ADHD_numeric * weekend AS INTEGER) AS ADHD_x_weekend FROM d6a)",
]
SERIES = FEATURES + [
    "s7a AS (SELECT *, dense_rank() OVER (ORDER BY ID) AS person_id, count(*) OVER (PARTITION BY ID, session) AS _sn FROM d6)",
    "s7b AS (SELECT * FROM s7a WHERE _sn >= 3)",
    f"""s7c AS (SELECT *, lag(t) OVER w AS _lt, lag(Y1) OVER w AS _l1, lag(Y2) OVER w AS _l2 FROM s7b
                WINDOW w AS (PARTITION BY ID, session {ORDER}))""",
    """s7 AS (SELECT *, person_id * 1000 + session AS ctsem_id, TimeHours AS ctsem_time,
                 session >= 1000 AS series_key_collision FROM s7c
            WHERE NOT (_lt IS NOT NULL AND t = _lt AND Y1 IS NOT DISTINCT FROM _l1 AND Y2 IS NOT DISTINCT FROM _l2))""",
]
SW = f"WINDOW w AS (PARTITION BY ID, session {ORDER})"
VAR1 = SERIES + [
    "c8a AS (SELECT *, avg(Y1) OVER (PARTITION BY ID) AS Y1_pm, avg(Y2) OVER (PARTITION BY ID) AS Y2_pm FROM s7)",
    "c8b AS (SELECT *, Y1 - Y1_pm AS Y1_wc, Y2 - Y2_pm AS Y2_wc FROM c8a)",
    f"""c8c AS (SELECT *, lag(Y1_wc) OVER w AS Y1_lag_wc, lag(Y2_wc) OVER w AS Y2_lag_wc,
                lag(Y1_pm) OVER w AS Y1_pm_lag, lag(Y2_pm) OVER w AS Y2_pm_lag,
                (t - lag(t) OVER w) / 3600.0 AS dt FROM c8b {SW})""",
    """c8 AS (SELECT *, ln(dt) AS log_dt FROM c8c WHERE Y1_lag_wc IS NOT NULL AND Y2_lag_wc IS NOT NULL
              AND dt IS NOT NULL AND dt > 0)""",
]
VAR2 = SERIES + [
    f"""c9a AS (SELECT *, lag(Y1) OVER w AS Y1_lag, lag(Y1, 2) OVER w AS Y1_lag2, lag(Y2) OVER w AS Y2_lag,
                lag(Y2, 2) OVER w AS Y2_lag2, (t - lag(t) OVER w) / 3600.0 AS dt FROM s7 {SW})""",
    """c9 AS (SELECT *, ln(dt) AS log_dt FROM c9a WHERE Y1_lag IS NOT NULL AND Y2_lag IS NOT NULL
              AND Y1_lag2 IS NOT NULL AND Y2_lag2 IS NOT NULL AND Y1 IS NOT NULL AND Y2 IS NOT NULL
              AND dt IS NOT NULL AND dt > 0)""",
]
DT_SERIES = f"dts AS (SELECT *, (t - lag(t) OVER w) / 3600.0 AS dt FROM s7 {SW})"
DENSE_SESS = [DENSE, *sessions("dense", "ds", obs="obs")]
LINE = """li AS (SELECT l_suppkey, l_quantity, l_extendedprice / 1000.0 AS price_k, l_discount, l_tax FROM lineitem)"""
LCOLS = ["l_quantity", "price_k", "l_discount", "l_tax"]
LSCALES = {"size": ["l_quantity", "price_k"], "rate": ["l_discount", "l_tax"]}


def histogram_sql(src: str, value: str, bins: int, by: list[str]) -> str:
    sel_by = "".join(f"{c}, " for c in by)
    same = lambda a, b: " AND ".join(["TRUE", *[f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in by]])
    grp = ("GROUP BY " + ", ".join(by)) if by else ""
    return with_(
        f"hv AS (SELECT {sel_by}{value} AS v FROM {src} WHERE {value} IS NOT NULL)",
        f"""hr AS (SELECT {sel_by}min(v) AS _lo, max(v) AS _hi FROM hv {grp})""",
        f"hr2 AS (SELECT *, CASE WHEN _hi > _lo THEN (_hi - _lo) / {bins - 1} ELSE 0.1 END AS _w FROM hr)",
        f"""hc AS (SELECT {"".join(f"hv.{c}, " for c in by)}CAST(greatest(1, ceil((v - (_lo - _w / 2)) / _w)) AS BIGINT) AS bin, count(*) AS cnt
                   FROM hv JOIN hr2 ON {same("hv", "hr2")} GROUP BY ALL)""",
        f"hg AS (SELECT {sel_by}_lo, _w, CAST(unnest(range(1, {bins + 1})) AS BIGINT) AS bin FROM hr2)",
    ) + f"""SELECT {"".join(f"hg.{c}, " for c in by)}hg.bin, {r6('_lo + (hg.bin - 1) * _w', 'x')}, {r6('_lo + (hg.bin - 1.5) * _w', 'xmin')},
           {r6('_lo + (hg.bin - 0.5) * _w', 'xmax')}, CAST(coalesce(cnt, 0) AS BIGINT) AS count
    FROM hg LEFT JOIN hc ON hg.bin = hc.bin AND {same("hg", "hc")}"""


def solved(src: str, name: str, n: int, rhs: list[str], keep: list[str]) -> list[str]:
    """CTEs that solve an n x n system by elimination: columns a{i}{j} and right sides {r}{i} of ``src`` become solutions {r}{i} in ``name``."""
    cells = [[f"a{i}{j}" for j in range(n)] + [f"{r}{i}" for r in rhs] for i in range(n)]
    out, last = [], src
    for k in range(n):
        pivot = f"a{k}{k}"
        cols = []
        for i in range(n):
            for c, top in zip(cells[i], cells[k], strict=True):
                cols.append(f"{top} / {pivot} AS {c}" if i == k else f"{c} - a{i}{k} * {top} / {pivot} AS {c}")
        step = name if k == n - 1 else f"{name}_{k}"
        out.append(f"{step} AS (SELECT {', '.join([*keep, *cols])} FROM {last})")
        last = step
    return out


def pooled_var_sql(src: str, x: list[str], ys: list[str], key: str) -> tuple[list[str], str]:
    """CTEs and SELECT of a pooled fit with an intercept: estimates, person-clustered errors, residual covariances."""
    t = ["1.0", *x]
    p = len(t)
    one = [f"sum({t[i]} * {t[j]}) AS a{i}{j}" for i in range(p) for j in range(p)]
    one += [f"sum({t[i]} * {y}) AS b{q}_{i}" for q, y in enumerate(ys) for i in range(p)]
    both = [f"sum({u} * {v}) AS c{q}{r}" for q, u in enumerate(ys) for r, v in enumerate(ys) if r >= q]
    unit = [f"{1.0 if i == j else 0.0}::DOUBLE AS e{j}_{i}" for j in range(p) for i in range(p)]
    keep = ["n", *[f"c{q}{r}" for q in range(len(ys)) for r in range(q, len(ys))], *[f"k{q}_{i}" for q in range(len(ys)) for i in range(p)]]
    ctes = [f"vm AS (SELECT {key}, count(*) AS n, {', '.join(one + both)} FROM {src} GROUP BY {key})",
            "vt AS (SELECT CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"sum({c}) AS {c}" for c in
                [f"a{i}{j}" for i in range(p) for j in range(p)] + [f"b{q}_{i}" for q in range(len(ys)) for i in range(p)]
                + [f"c{q}{r}" for q in range(len(ys)) for r in range(q, len(ys))]) + " FROM vm)",
            "vu AS (SELECT *, " + ", ".join([f"b{q}_{i} AS k{q}_{i}" for q in range(len(ys)) for i in range(p)] + unit) + " FROM vt)",
            *solved("vu", "vs", p, [f"b{q}_" for q in range(len(ys))] + [f"e{j}_" for j in range(p)], keep)]
    # scores of each person at the solution
    scores = [f"vm.b{q}_{i} - (" + " + ".join(f"vm.a{i}{j} * vs.b{q}_{j}" for j in range(p)) + f") AS s{q}_{i}" for q in range(len(ys)) for i in range(p)]
    meat = [f"sum(s{q}_{i} * s{q}_{j}) AS m{q}_{i}{j}" for q in range(len(ys)) for i in range(p) for j in range(p)]
    ctes += [f"vp AS (SELECT {', '.join(scores)} FROM vm, vs)", f"vq AS (SELECT {', '.join(meat)} FROM vp)"]
    rows = []
    for q, y in enumerate(ys):
        for i, term in enumerate(["one", *x]):
            var = " + ".join(f"e{j}_{i} * m{q}_{j}{l} * e{l}_{i}" for j in range(p) for l in range(p))
            rows.append(f"SELECT '{y}' AS outcome, '{term}' AS term, {r6(f'b{q}_{i}', 'estimate')}, n, {r6(f'sqrt({var})', 'se_cluster')} FROM vs, vq")
    for q, u in enumerate(ys):
        for r, v in enumerate(ys):
            if r >= q:
                fit = " + ".join(f"k{q}_{i} * b{r}_{i}" for i in range(p))
                rows.append(f"SELECT '{u}', 'cov:{v}', {r6(f'(c{q}{r} - ({fit})) / (n - {p})', 'estimate')}, n, NULL FROM vs")
    return ctes, " UNION ALL ".join(rows)


def components_sql(src: str, sets: dict[str, list[str]], factors: list[str], occasion: int, item: int) -> str:
    """Variance components and reliability by set of items: forms, then the k + 1 equations."""
    k, parts = len(factors), []
    for s, (name, members) in enumerate(sets.items()):
        inn = ", ".join(f"'{c}'" for c in members)
        ctes = [f"r{s} AS (SELECT * FROM {src} WHERE value IS NOT NULL AND item IN ({inn}))",
                f"w{s} AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(value * value) AS t0, sum(value) * sum(value) / count(*) AS tm FROM r{s})"]
        a, rhs = {}, {}
        for i, f in enumerate(factors):
            ctes.append(f"l{s}_{i} AS (SELECT sum(s * s / m) AS t, sum(m * m) AS q, CAST(count(*) AS DOUBLE) AS l FROM "
                        f"(SELECT CAST(count(*) AS DOUBLE) AS m, sum(value) AS s FROM r{s} GROUP BY {f}))")
            for j, g in enumerate(factors):
                if i != j:
                    ctes.append(f"x{s}_{i}{j} AS (SELECT sum(q / m) AS c FROM (SELECT {f}, sum(CAST(m AS DOUBLE) * m) AS q, sum(m) AS m FROM "
                                f"(SELECT {f}, {g}, count(*) AS m FROM r{s} GROUP BY {f}, {g}) GROUP BY {f}))")
        for i in range(k):
            for j in range(k):
                left = "n" if i == j else f"(SELECT c FROM x{s}_{i}{j})"
                a[i, j] = f"{left} - (SELECT q FROM l{s}_{j}) / n"
            a[i, k] = f"(SELECT l FROM l{s}_{i}) - 1"
            rhs[i] = f"(SELECT t FROM l{s}_{i}) - tm"
        for j in range(k):
            a[k, j] = f"n - (SELECT q FROM l{s}_{j}) / n"
        a[k, k], rhs[k] = "n - 1", "t0 - tm"
        ctes.append(f"y{s} AS (SELECT " + ", ".join([f"{e} AS a{i}{j}" for (i, j), e in a.items()] + [f"{e} AS v{i}" for i, e in rhs.items()]) + f" FROM w{s})")
        ctes += solved(f"y{s}", f"z{s}", k + 1, ["v"], [])
        rows = [f"SELECT '{name}' AS items, '{f}' AS part, {r6(f'v{i}', 'value', 2)} FROM z{s}" for i, f in enumerate([*factors, "residual"])]
        rows.append(f"SELECT '{name}', 'reliability', {r6(f'greatest(v{occasion}, 0) / (greatest(v{occasion}, 0) + greatest(v{item}, 0) / {len(members)})', 'value', 2)} FROM z{s}")
        parts.append((ctes, rows))
    return ", ".join(c for ctes, _ in parts for c in ctes) + " " + " UNION ALL ".join(r for _, rows in parts for r in rows)


def local_regression_sql(src: str, x: str, y: str, by: list[str], grid: int = 80, span: float = 0.75, digits: int = 4) -> str:
    """Local quadratic fits by direct sums over all rows and grid points (a small table)."""
    k = ", ".join(by)
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    return with_(
        f"lr AS (SELECT {k}, {x} AS x, {y} AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)",
        f"lq AS (SELECT {k}, min(x) AS x0, max(x) AS x1, count(*) AS n FROM lr GROUP BY {k})",
        f"lg AS (SELECT *, unnest(range(0, {grid})) AS i, (x1 - x0) / {grid - 1} AS step FROM lq)",
        "lh AS (SELECT *, x0 + i * step AS g FROM lg)",
        f"ld AS (SELECT lh.*, lr.x, lr.y, abs(lr.x - g) AS d, row_number() OVER (PARTITION BY {', '.join('lh.' + c for c in by)}, i ORDER BY abs(lr.x - g)) AS rk "
        f"FROM lh JOIN lr USING ({k}))",
        f"lw AS (SELECT {k}, i, any_value(g) AS g, any_value(n) AS n, any_value(x0) AS x0, any_value(step) AS step, max(d) AS h FROM ld "
        f"WHERE rk <= floor(n * {span} + 1e-5) GROUP BY {k}, i)",
        f"le AS (SELECT lw.*, (ld.x - lw.g) / h AS u, power(1 - power(ld.d / h, 3), 3) AS w, ld.y FROM lw JOIN ld USING ({k}, i) WHERE ld.d < h)",
        f"lf AS (SELECT {k}, i, any_value(g) AS g, any_value(h) AS h, any_value(n) AS n, any_value(x0) AS x0, any_value(step) AS step, "
        + ", ".join([f"sum(w * power(u, {j})) AS s{j}, sum(w * w * power(u, {j})) AS b{j}" for j in range(5)]
                    + [f"sum(w * y * power(u, {j})) AS t{j}" for j in range(3)]) + f" FROM le GROUP BY {k}, i)",
        f"li AS (SELECT *, (s2 * s4 - s3 * s3) / {det} AS c00, (s2 * s3 - s1 * s4) / {det} AS c01, (s1 * s3 - s2 * s2) / {det} AS c02, "
        f"(s0 * s4 - s2 * s2) / {det} AS c11, (s1 * s2 - s0 * s3) / {det} AS c12 FROM lf)",
        f"lj AS (SELECT {k}, i, g, h, n, x0, step, c00 * t0 + c01 * t1 + c02 * t2 AS fit, (c01 * t0 + c11 * t1 + c12 * t2) / h AS slope, c00 AS lever, "
        "c00 * c00 * b0 + 2 * c00 * c01 * b1 + (2 * c00 * c02 + c01 * c01) * b2 + 2 * c01 * c02 * b3 + c02 * c02 * b4 AS spread FROM li)",
        f"lk AS (SELECT lr.*, a.fit AS fa, b.fit AS fb, a.slope AS sa, b.slope AS sb, 2 * a.lever - a.spread AS la, 2 * b.lever - b.spread AS lb, a.n, a.step, "
        f"(lr.x - a.g) / a.step AS u FROM lr JOIN lj a USING ({k}) JOIN lj b USING ({k}) "
        f"WHERE a.i = CAST(greatest(0, least(floor((lr.x - a.x0) / a.step), {grid - 2})) AS BIGINT) AND b.i = a.i + 1)",
        f"lv AS (SELECT {k}, sum(power(y - ((1 - u) * (1 - u) * (1 + 2 * u) * fa + u * u * (3 - 2 * u) * fb + u * (1 - u) * (1 - u) * step * sa "
        f"- u * u * (1 - u) * step * sb), 2)) / (any_value(n) - sum((1 - u) * la + u * lb)) AS variance FROM lk GROUP BY {k})",
        f"lz AS (SELECT lj.*, sqrt(variance * spread) AS se FROM lj JOIN lv USING ({k}))",
    ) + f"""SELECT {k}, {r6('g', 'x', digits)}, {r6('fit', 'estimate', digits)}, {r6('se', 'se', digits)}, {r6('fit - 1.96 * se', 'lo', digits)},
        {r6('fit + 1.96 * se', 'hi', digits)}, {r6('h', 'bandwidth', digits)}, n FROM lz"""


DENSE_VAR = DENSE_SESS + [
    """dz AS (SELECT ID, ADHD, t, seq, session, (Y1 - avg(Y1) OVER ()) / stddev_samp(Y1) OVER () AS Y1,
               (Y2 - avg(Y2) OVER ()) / stddev_samp(Y2) OVER () AS Y2 FROM ds)""",
    f"""dv0 AS (SELECT *, lag(Y1) OVER w AS Y1_lag, lag(Y1, 2) OVER w AS Y1_lag2, lag(Y2) OVER w AS Y2_lag,
                lag(Y2, 2) OVER w AS Y2_lag2, (t - lag(t) OVER w) / 3600.0 AS dt FROM dz {SW})""",
    """dv AS (SELECT *, ln(dt) AS log_dt FROM dv0 WHERE Y1 IS NOT NULL AND Y2 IS NOT NULL AND Y1_lag IS NOT NULL
              AND Y1_lag2 IS NOT NULL AND Y2_lag IS NOT NULL AND Y2_lag2 IS NOT NULL AND dt > 0)""",
]
RAW = f"""raw AS (
  SELECT user_id AS ID, {GROUP} AS ADHD, event_id AS seq,
    CASE WHEN event_id % 101 = 0 THEN 'late ' || strftime(ts, '%d.%m.') ELSE strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END AS time_text,
    CASE WHEN event_id % 101 <> 0 THEN CAST(epoch_us(date_trunc('day', ts)) / 1e6 AS DOUBLE) END AS t,
    CASE WHEN event_id % 53 <> 0 THEN 1 END AS SessionNumb,
    event_type || '_' || CAST({KVAL} % 2 AS VARCHAR) AS label,
    CASE WHEN event_id % 7 = 0 THEN '#skipped#' WHEN event_id % 29 = 0 THEN 'often' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS response
  FROM events)"""


def raw_wide(names: dict[str, str]) -> str:
    cells = ", ".join(f"(arg_max({{'v': NULLIF(response, '#skipped#')}}, seq) FILTER (WHERE label = '{v}')).v AS {n}"
                      for v, n in names.items())
    return f"""rw AS (SELECT ID, t, ADHD, SessionNumb, time_text, min(seq) AS seq, {cells}
               FROM raw WHERE SessionNumb IS NOT NULL GROUP BY ID, t, ADHD, SessionNumb, time_text)"""


def bands(src: str, stat: str, scales: dict[str, list[str]]) -> str:
    """Group bands of a per-person item statistic of ``src``."""
    items = [c for cs in scales.values() for c in cs]
    fn = {"var": "var_samp", "mean": "avg"}[stat]
    per = "bi AS (SELECT ID, ADHD, " + ", ".join(f"{fn}({c}) AS {stat}_{c}" for c in items) + f" FROM {src} GROUP BY ID, ADHD)"
    long = "bl AS (" + " UNION ALL ".join(f"SELECT ID, ADHD, '{stat}_{c}' AS variable, {i + 1} AS item_order, '{s}' AS subscale, "
                                          f"{stat}_{c} AS value FROM bi" for s, cs in scales.items() for i, c in
                                          [(items.index(c), c) for c in cs]) + ")"
    return f"""{per}, {long}, bg AS (SELECT CASE WHEN ADHD = 'Y' THEN 'ADHD' ELSE 'Control' END AS group_label, variable, item_order, subscale,
        avg(value) AS m, stddev_samp(value) / sqrt(CAST(count(*) AS DOUBLE)) AS s FROM bl GROUP BY ALL)
        SELECT group_label, variable, CAST(item_order AS BIGINT) AS item_order, subscale, {r6('m', 'mean_val')}, {r6('s', 'se_val')},
        {r6('m - 1.96 * s', 'lo')}, {r6('m + 1.96 * s', 'hi')} FROM bg"""


def _more() -> dict[str, str]:
    q: dict[str, str] = {}
    q["d1_raw_panel"] = with_(RAW, raw_wide({x: x for x in SPARSE_LABELS})) + f"""SELECT ID, {r6('t', 't')}, ADHD,
        CAST(SessionNumb AS BIGINT) AS SessionNumb, time_text, seq, {', '.join(SPARSE_LABELS)},
        CASE WHEN t IS NOT NULL THEN {DAYS}[{WDAY}] END AS day_of_week,
        CAST(CASE WHEN t IS NOT NULL AND {WDAY} IN (1, 7) THEN 1 ELSE 0 END AS BIGINT) AS weekend,
        row_number() OVER (PARTITION BY ID {ORDER}) AS obs FROM rw"""
    q["d1_parse_report"] = with_(RAW) + """SELECT count(*) AS n_rows, count(*) FILTER (response = '#skipped#') AS n_skipped,
        count(*) FILTER (t IS NULL) AS n_bad_time, count(*) FILTER (response = 'often') AS n_bad_value,
        count(*) FILTER (SessionNumb IS NULL) AS n_no_session FROM raw"""
    names = {v: f"item{i + 1}" for i, v in enumerate(ITEMS)}
    some = " OR ".join(f"{n} IS NOT NULL" for n in names.values())
    shown = " UNION ALL ".join(f"SELECT ID, seq, ADHD, RawHours, session, {i + 1}.0 AS item, CAST(CAST({n} IS NOT NULL AS INTEGER) AS DOUBLE) AS responded FROM rs"
                               for i, n in enumerate(names.values()))
    q["d10_raw_pattern"] = with_(RAW, raw_wide(names), f"rk AS (SELECT * FROM rw WHERE {some})", *sessions("rk", "rs"), f"ra AS ({shown})") + \
        f"""SELECT ID, seq, ADHD, {r6('RawHours', 'RawHours')}, CAST(session AS BIGINT) AS session, {r6('CAST(item AS DOUBLE)', 'item')},
        {r6('responded', 'responded')} FROM ra"""
    q["d11_mean_bands"] = with_(*SPARSE_BASE)[:-1] + ", " + bands("d2", "mean", {"Hostile": A_ITEMS, "Prosocial": B_ITEMS})
    points = []
    for stat, fn in (("var", "var_samp"), ("mean", "avg")):
        for i, c in enumerate(ITEMS):
            points.append(f"""SELECT ID, '{stat}_{c}' AS variable, {r6(f'{fn}({c}) + 1e-9', 'value')}, CASE WHEN ADHD = 'Y' THEN 'ADHD' ELSE 'Control' END AS group_label,
                CAST({i + 1} AS BIGINT) AS item_order, 'Item {i + 1}' AS item_label, '{'Hostile' if c in A_ITEMS else 'Prosocial'}' AS subscale FROM d2 GROUP BY ID, ADHD""")
    q["d11_points"] = with_(*SPARSE_BASE) + " UNION ALL ".join(points)
    three = ["click_0", "view_0", "purchase_0"]
    one = lambda step, name, expr, src: f"SELECT '{step}' AS step, '{name}' AS name, CAST({expr} AS BIGINT) AS n FROM {src}"
    lost = " OR ".join(f"{c} IS NULL" for c in three)
    steps = [one("numbers", "n_rows", "count(*)", "rw"), one("filled", "n_rows", "count(*)", "rw"), one("complete", "n_rows", "count(*)", "rn"),
             *[one("numbers", f"bad_{c}", f"count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL)", "rw") for c in SPARSE_LABELS],
             *[one("filled", f"filled_{c}", f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NULL)", "rw") for c in CTX],
             one("complete", "n_dropped", f"count(*) FILTER ({lost})", "rn"),
             *[one("complete", f"missing_{c}", f"count(*) FILTER ({c} IS NULL)", "rn") for c in three],
             one("repeats", "n_rows", "count(*)", "zr"), one("repeats", "n_repeats", "count(*) FILTER (same)", "zr")]
    q["counts_observed"] = with_(
        RAW, raw_wide({x: x for x in SPARSE_LABELS}), "rn AS (SELECT " + ", ".join(f"TRY_CAST({c} AS DOUBLE) AS {c}" for c in three) + " FROM rw)",
        "zd AS (SELECT user_id AS ID, CAST(floor(epoch_us(ts) / 1e6 / 43200) * 43200 AS DOUBLE) AS t, event_id AS seq, floor(value / 100) * 100 AS Y1 FROM events)",
        *sessions("zd", "zs"),
        f"zr AS (SELECT coalesce(t = lag(t) OVER w, false) AND Y1 IS NOT DISTINCT FROM lag(Y1) OVER w AS same FROM zs {SW})",
    ) + " UNION ALL ".join(steps)
    q["s_formats"] = " UNION ALL ".join(f"""SELECT '{fmt}' AS fmt, event_type || '_' || CAST({KVAL} % 2 AS VARCHAR) AS prompt_label, count(*) AS n_rows,
        count(*) AS n_answers, CAST(sum(event_id) AS BIGINT) AS seq_sum, count(*) FILTER (event_id % 53 <> 0) AS n_session,
        max(CASE WHEN event_id % 101 = 0 THEN 'late ' || strftime(ts, '%d.%m.') ELSE strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END) AS last_time
        FROM events GROUP BY ALL""" for fmt in ("csv", "json", "parquet"))
    # closed: the watermark, a gap behind the newest row, has passed the session's last row and its gap
    q["str_sessions"] = with_(DENSE, *sessions("dense", "ss"), "sg AS (SELECT ID, session, count(*) AS n, min(t) AS t0, max(t) AS t1 FROM ss GROUP BY ID, session)") + \
        f"SELECT ID AS user_id, n AS n_obs, {r6('t0', 'first_t')}, {r6('t1', 'last_t')} FROM sg WHERE t1 + 2 * 30 * 3600 <= (SELECT max(t) FROM dense)"
    whole = "wc AS (SELECT * FROM d1 WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in three) + ")"
    q["d11_complete_bands"] = with_(SPARSE_LONG, SPARSE_WIDE, D1, whole)[:-1] + ", " + \
        bands("wc", "var", {"Hostile": ["click_0", "view_0"], "Prosocial": ["purchase_0"]})
    q["d13_complete"] = with_(SPARSE_LONG, SPARSE_WIDE, D1, whole,
                              f"wo AS (SELECT *, row_number() OVER (PARTITION BY ID {ORDER}) AS occasion FROM wc)",
                              "wl AS (" + " UNION ALL ".join(f"SELECT ID, occasion, '{c}' AS item, {c} AS value FROM wo" for c in three) + ")") + \
        f"SELECT ID, occasion, item, {r6('value', 'value')} FROM wl"
    q["k6_min_obs"] = with_(*SPARSE_BASE, "kn AS (SELECT *, count(*) OVER (PARTITION BY ID) AS n_obs FROM d2)") + \
        "SELECT ID, seq, n_obs FROM kn WHERE n_obs >= 25"
    q["k9_zero_repeats"] = with_(
        "zd AS (SELECT user_id AS ID, CAST(floor(epoch_us(ts) / 1e6 / 43200) * 43200 AS DOUBLE) AS t, event_id AS seq, floor(value / 100) * 100 AS Y1 FROM events)",
        *sessions("zd", "zs"), f"zl AS (SELECT *, lag(t) OVER w AS _lt, lag(Y1) OVER w AS _l1 FROM zs {SW})") + \
        f"""SELECT ID, seq, CAST(session AS BIGINT) AS session, {r6('Y1', 'Y1')} FROM zl
        WHERE NOT (_lt IS NOT NULL AND t = _lt AND Y1 IS NOT DISTINCT FROM _l1)"""
    q["o2_context_order"] = with_(*SPARSE_BASE, *FEATURES, "fc AS (SELECT error_0, error_1, count(*) AS n FROM d6 GROUP BY ALL)") + \
        f"""SELECT CAST(error_0 AS BIGINT) AS error_0, CAST(error_1 AS BIGINT) AS error_1, n,
        {r6('round_even(100.0 * n / (SELECT sum(n) FROM fc), 1)', 'pct')}, row_number() OVER (ORDER BY n DESC, error_0, error_1) AS rank FROM fc"""
    q["s_names"] = """SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS "X2nd_name", CAST(n_regionkey AS BIGINT) AS region,
        CAST(0 AS BIGINT) AS flag FROM nation"""
    q["j_null_safe"] = """WITH a AS (SELECT NULLIF(user_id % 10, 0) AS key FROM events),
        b AS (SELECT NULLIF(n_nationkey, 0) AS key, n_name FROM nation WHERE n_nationkey < 10)
        SELECT a.key, n_name, count(*) AS n FROM a JOIN b ON a.key IS NOT DISTINCT FROM b.key GROUP BY ALL"""
    ols = ["""o1 AS (SELECT ID, count(*) AS n, sum(Y1_lag) AS sx, sum(Y1_lag * Y1_lag) AS sxx, sum(Y1) AS sy, sum(Y1_lag * Y1) AS sxy,
                 sum(Y1 * Y1) AS syy FROM dv GROUP BY ID)""",
           """o2 AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(sy) AS sy, sum(sxy) AS sxy, sum(syy) AS syy FROM o1)""",
           """o3 AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1,
                 (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM o2)""",
           """o4 AS (SELECT sum(e0 * e0) AS m00, sum(e0 * e1) AS m01, sum(e1 * e1) AS m11 FROM (
                 SELECT o1.sy - o1.n * b0 - o1.sx * b1 AS e0, o1.sxy - o1.sx * b0 - o1.sxx * b1 AS e1 FROM o1, o3))"""]
    q["m2_var1_se"] = with_(*DENSE_VAR, *ols) + f"""SELECT 'Y1' AS outcome, 'one' AS term, {r6('b0', 'estimate')}, CAST(n AS BIGINT) AS n,
          {r6('sqrt(sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / det', 'se_cluster')} FROM o3, o4
        UNION ALL SELECT 'Y1', 'Y1_lag', {r6('b1', 'estimate')}, CAST(n AS BIGINT),
          {r6('sqrt(sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / det', 'se_cluster')} FROM o3, o4
        UNION ALL SELECT 'Y1', 'cov:Y1', {r6('(syy - b0 * sy - b1 * sxy) / (n - 2)', 'estimate')}, CAST(n AS BIGINT), NULL FROM o3"""
    # one EM step of Y1 ~ 1 + x + (1 + x | person) at b = (0.1, 0.2), s = 0.9, Psi = (0.3, 0.05; 0.05, 0.2)
    em = ["e0 AS (SELECT 0.1::DOUBLE AS b0, 0.2::DOUBLE AS b1, 0.9::DOUBLE AS s, 0.3::DOUBLE AS p11, 0.05::DOUBLE AS p12, 0.2::DOUBLE AS p22)",
          """e1 AS (SELECT o1.*, e0.*, p11 * p22 - p12 * p12 AS dp, sy - n * b0 - sx * b1 AS z0, sxy - sx * b0 - sxx * b1 AS z1,
                 syy - 2 * (b0 * sy + b1 * sxy) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx AS ee FROM o1, e0)""",
          "e2 AS (SELECT *, p22 / dp + n / s AS a11, -p12 / dp + sx / s AS a12, p11 / dp + sxx / s AS a22, z0 / s AS r0, z1 / s AS r1 FROM e1)",
          "e3 AS (SELECT *, a11 * a22 - a12 * a12 AS da FROM e2)",
          "e4 AS (SELECT *, a22 / da AS v11, -a12 / da AS v12, a11 / da AS v22, (a22 * r0 - a12 * r1) / da AS u0, (a11 * r1 - a12 * r0) / da AS u1 FROM e3)",
          """e5 AS (SELECT sum(-0.5 * (n * ln(2 * pi()) + n * ln(s) + ln(dp) + ln(da) + ee / s - r0 * u0 - r1 * u1)) AS loglik,
                 sum(v11 + u0 * u0) AS q11, sum(v12 + u0 * u1) AS q12, sum(v22 + u1 * u1) AS q22, count(*) AS persons, sum(n) AS n,
                 sum(sx) AS sx, sum(sxx) AS sxx, sum(sy - n * u0 - sx * u1) AS g0, sum(sxy - sx * u0 - sxx * u1) AS g1,
                 sum(syy - 2 * (u0 * sy + u1 * sxy) + n * (v11 + u0 * u0) + 2 * sx * (v12 + u0 * u1) + sxx * (v22 + u1 * u1)) AS c FROM e4)""",
          "e6 AS (SELECT *, (sxx * g0 - sx * g1) / (n * sxx - sx * sx) AS b0, (n * g1 - sx * g0) / (n * sxx - sx * sx) AS b1 FROM e5)"]
    q["m3_em_step"] = with_(*DENSE_VAR, ols[0], *em) + f"""SELECT {r6('loglik', 'loglik')}, {r6('b0', 'b0')}, {r6('b1', 'b1')},
        {r6('(c - 2 * (b0 * g0 + b1 * g1) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n', 'sigma')},
        {r6('q11 / persons', 'psi11')}, {r6('q12 / persons', 'psi12')}, {r6('q22 / persons', 'psi22')} FROM e6"""
    # the same with a normal prior of the fixed effects and an inverse-Wishart prior of Psi
    q["m3_map_step"] = with_(
        *DENSE_VAR, ols[0], *em[:-1],
        "pr AS (SELECT 0.05::DOUBLE AS m0, 0.3::DOUBLE AS m1, 4.0::DOUBLE AS l0, 25.0::DOUBLE AS l1, 5.0::DOUBLE AS df, 0.4::DOUBLE AS sc)",
        "f6 AS (SELECT e5.*, pr.*, n / 0.9 + l0 AS h00, sx / 0.9 AS h01, sxx / 0.9 + l1 AS h11, g0 / 0.9 + l0 * m0 AS k0, g1 / 0.9 + l1 * m1 AS k1 FROM e5, pr)",
        "f7 AS (SELECT *, (h11 * k0 - h01 * k1) / (h00 * h11 - h01 * h01) AS b0, (h00 * k1 - h01 * k0) / (h00 * h11 - h01 * h01) AS b1 FROM f6)",
    ) + f"""SELECT {r6("""loglik - 0.5 * (l0 * power(0.1 - m0, 2) + l1 * power(0.2 - m1, 2)) - 0.5 * (df + 3) * ln(0.3 * 0.2 - 0.05 * 0.05)
        - 0.5 * sc * (0.3 + 0.2) / (0.3 * 0.2 - 0.05 * 0.05)""", 'logpost')}, {r6('b0', 'b0')}, {r6('b1', 'b1')},
        {r6('(c - 2 * (b0 * g0 + b1 * g1) + b0 * b0 * n + 2 * b0 * b1 * sx + b1 * b1 * sxx) / n', 'sigma')},
        {r6('(q11 + sc) / (persons + df + 3)', 'psi11')}, {r6('q12 / (persons + df + 3)', 'psi12')}, {r6('(q22 + sc) / (persons + df + 3)', 'psi22')} FROM f7"""
    # each row against the posterior of its person's other rows, their sums taken without it
    q["m4_row_densities"] = with_(
        *DENSE_VAR, ols[0], *em[:3],
        """h1 AS (SELECT dv.ID, dv.seq, Y1_lag AS x, Y1 AS y, e2.b0, e2.b1, s, a11 - 1 / s AS a11, a12 - Y1_lag / s AS a12, a22 - Y1_lag * Y1_lag / s AS a22,
               r0 - (Y1 - b0 - b1 * Y1_lag) / s AS r0, r1 - Y1_lag * (Y1 - b0 - b1 * Y1_lag) / s AS r1 FROM dv JOIN e2 USING (ID))""",
        "h2 AS (SELECT *, a11 * a22 - a12 * a12 AS da FROM h1)",
        """h3 AS (SELECT *, b0 + b1 * x + (a22 * r0 - a12 * r1) / da + x * (a11 * r1 - a12 * r0) / da AS mean,
               s + (a22 - 2 * x * a12 + x * x * a11) / da AS var FROM h2)""",
    ) + f"SELECT ID, seq, {r6('-0.5 * (ln(2 * pi()) + ln(var) + power(y - mean, 2) / var)', 'log_density')} FROM h3"
    x = ["one", "item_no", "hours", "adhd", "hours_x_adhd"]
    val = {"one": "1.0", "responded": "responded", **{c: c for c in x[1:]}}
    pairs = [(a, b) for i, a in enumerate(x) for b in x[i:]] + [(a, "responded") for a in x] + [("responded", "responded")]
    pres = " UNION ALL ".join(f"SELECT ID, ADHD AS grp, RawHours, {i + 1}.0::DOUBLE AS item_no, CAST(CAST({c} IS NOT NULL AS INTEGER) AS DOUBLE) AS responded FROM d2"
                              for i, c in enumerate(ITEMS))
    q["m5_response_moments"] = with_(*SPARSE_BASE, f"rp AS ({pres})",
                                     "rq AS (SELECT *, RawHours / 1000.0 AS hours, CAST(grp = 'Y' AS INTEGER)::DOUBLE AS adhd FROM rp WHERE RawHours IS NOT NULL)",
                                     "rr AS (SELECT *, hours * adhd AS hours_x_adhd FROM rq)") + \
        "SELECT count(*) AS n, " + ", ".join(r6(f"sum({val[a]} * {val[b]})", f"s__{a}__{b}", 3) for a, b in pairs) + " FROM rr"
    # three-way design: group, number of rows, item (the first is the base)
    levels = ITEMS[1:]
    main = {"adhd": {"adhd": "g"}, "n_obs": {"n_obs": "n"}, "item": {f"item{i + 2}": f"CAST(item = '{c}' AS INTEGER)" for i, c in enumerate(levels)}}
    cols: dict[str, str] = {"one": "1.0"}
    for names_ in (["adhd"], ["n_obs"], ["item"], ["adhd", "n_obs"], ["adhd", "item"], ["n_obs", "item"], ["adhd", "n_obs", "item"]):
        part = {"": "1.0"}
        for m in names_:
            part = {f"{a}_x_{b}" if a else b: f"{ea} * {eb}" for a, ea in part.items() for b, eb in main[m].items()}
        cols.update({f"d_{k}": e for k, e in part.items()})
    iv = "iv AS (SELECT ID, ADHD, CAST(ADHD = 'Y' AS INTEGER)::DOUBLE AS g, count(*)::DOUBLE AS n, " + ", ".join(
        f"var_samp({c}) / 1000.0 AS v_{c}" for c in ITEMS) + " FROM d2 GROUP BY ID, ADHD)"
    il = "il AS (" + " UNION ALL ".join(f"SELECT g, n, '{c}' AS item, v_{c} AS v FROM iv WHERE v_{c} IS NOT NULL" for c in ITEMS) + ")"
    q["m8_design_moments"] = with_(*SPARSE_BASE, iv, il) + "SELECT count(*) AS n, " + ", ".join(
        [r6(f"sum(({e}) * ({e}))", f"xx_{c}", 3) for c, e in cols.items()] + [r6(f"sum(({e}) * v)", f"xy_{c}", 3) for c, e in cols.items()]) + " FROM il"
    return q


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["w4_sessionize"] = with_(*DENSE_SESS) + f"""SELECT ID, seq, CAST(obs AS BIGINT) AS obs, CAST(session AS BIGINT) AS session,
        new_session, {r6('gap_hours', 'gap_hours')}, {r6('RawHours', 'RawHours')}, {r6('TimeHours', 'TimeHours')},
        {r6('time_interval', 'time_interval')} FROM ds"""
    q["s5_person_table"] = q["w4_sessionize"]
    q["a1_session_sizes"] = with_(*DENSE_SESS) + \
        "SELECT ID, CAST(session AS BIGINT) AS session, count(*) AS n_obs FROM ds GROUP BY ID, session"
    q["a3_gap_summary"] = with_(*DENSE_SESS) + f"""SELECT {r6('avg(gap_hours)', 'mean_gap')},
        {r6('median(gap_hours)', 'median_gap')}, {r6('max(gap_hours)', 'max_gap')},
        count(*) FILTER (WHERE gap_hours > 30.0) AS n_large FROM ds WHERE gap_hours IS NOT NULL"""
    q["a2_distinct_counts"] = with_(*DENSE_SESS) + \
        "SELECT count(DISTINCT ID) AS n_persons, count(DISTINCT (ID, session)) AS n_sessions FROM ds"
    q["w2_w3_elapsed_step"] = with_(DENSE, f"""e AS (SELECT *, row_number() OVER (PARTITION BY ID {ORDER}) AS rn,
        lag(t) OVER (PARTITION BY ID {ORDER}) AS _tp, first_value(t) OVER (PARTITION BY ID {ORDER}) AS _t0 FROM dense)""") + \
        f"""SELECT ID, seq, {r6('(t - _t0) / 3600.0', 'TimeHours')},
        {r6('CASE WHEN rn = 1 THEN (t - _t0) / 3600.0 - 0.0 ELSE (t - _t0) / 3600.0 - (_tp - _t0) / 3600.0 END', 'time_interval')} FROM e"""
    labels = ", ".join(r6(x, x) for x in SPARSE_LABELS)
    q["r1_pivot_prompts"] = with_(SPARSE_LONG, SPARSE_WIDE, D1) + \
        f"SELECT ID, {r6('t', 't')}, ADHD, seq, {labels}, day_of_week, CAST(weekend AS BIGINT) AS weekend, obs FROM d1"
    q["r1_duplicate_cells"] = with_(SPARSE_LONG, "dc AS (SELECT ID, t, ADHD, label, count(*) AS n FROM sl GROUP BY ALL HAVING count(*) > 1)") + \
        "SELECT count(*) AS n_cells, sum(n) AS n_values FROM dc"
    q["d2_sessionize_panel"] = with_(*SPARSE_BASE) + f"""SELECT ID, seq, obs, CAST(session AS BIGINT) AS session,
        {r6('gap_hours', 'gap_hours')}, {r6('RawHours', 'RawHours')}, {r6('TimeHours', 'TimeHours')},
        {r6('time_interval', 'time_interval')}, ADHD_first, CAST(weekend AS BIGINT) AS weekend, day_of_week FROM d2"""
    persons = ["p AS (SELECT DISTINCT ID, ADHD_first AS ADHD FROM d2)",
               """pc AS (SELECT p.ID, p.ADHD, CAST(coalesce(p.ADHD = 'Y', false) AS BIGINT) AS ADHD_numeric,
                   CAST(c.c_nationkey AS BIGINT) AS c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name
                   FROM p LEFT JOIN (customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)
                   ON p.ID = c.c_custkey)"""]
    q["d3_person_table"] = with_(*SPARSE_BASE, *persons) + \
        f"SELECT ID, ADHD, ADHD_numeric, c_nationkey, {r6('c_acctbal', 'c_acctbal')}, c_mktsegment, n_name FROM pc"
    q["a14_describe_persons"] = with_(
        *SPARSE_BASE, *persons,
        "np AS (SELECT ID, count(*) AS n_prompts FROM d2 GROUP BY ID)",
        "pt AS (SELECT * FROM pc JOIN np USING (ID))",
        """lg AS (SELECT 'c_acctbal' AS vars, CAST(c_acctbal AS DOUBLE) AS x FROM pt
                  UNION ALL SELECT 'ADHD_numeric', CAST(ADHD_numeric AS DOUBLE) FROM pt
                  UNION ALL SELECT 'n_prompts', CAST(n_prompts AS DOUBLE) FROM pt)""",
        "lg2 AS (SELECT * FROM lg WHERE x IS NOT NULL)",
        """f AS (SELECT vars, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, median(x) AS median,
                 min(x) AS mn, max(x) AS mx FROM lg2 GROUP BY vars)""",
        "r AS (SELECT lg2.vars, x, n, mean, median, row_number() OVER (PARTITION BY lg2.vars ORDER BY x) AS rn FROM lg2 JOIN f USING (vars))",
        """s AS (SELECT vars, avg(CASE WHEN rn > floor(n * 0.1) AND rn <= n - floor(n * 0.1) THEN x END) AS trimmed,
                 median(abs(x - median)) AS mad0, avg(power(x - mean, 2)) AS m2, avg(power(x - mean, 3)) AS m3,
                 avg(power(x - mean, 4)) AS m4 FROM r GROUP BY vars)""",
    ) + f"""SELECT vars, n, {r6('mean', 'mean')}, {r6('sd', 'sd')}, {r6('median', 'median')}, {r6('trimmed', 'trimmed')},
        {r6('1.4826 * mad0', 'mad')}, {r6('mn', 'min')}, {r6('mx', 'max')}, {r6('mx - mn', 'range')},
        {r6('(m3 / power(m2, 1.5)) * power((n - 1.0) / n, 1.5)', 'skew')},
        {r6('((m4 / (m2 * m2) - 3.0) + 3.0) * power(1.0 - 1.0 / n, 2) - 3.0', 'kurtosis')},
        {r6('sd / sqrt(n)', 'se')} FROM f JOIN s USING (vars)"""
    q["k8_variance_flags"] = with_(*SPARSE_BASE, *PV_CTES) + \
        f"SELECT ID, {r6('var_anti', 'var_anti', 4)}, {r6('var_pro', 'var_pro', 4)}, flag_any FROM vf2"
    q["d5_score_scales"] = with_(*SPARSE_BASE, *SCORED) + \
        f"SELECT ID, seq, {r6('anti_mean', 'anti_mean')}, {r6('pro_mean', 'pro_mean')}, {r6('Y1', 'Y1')}, {r6('Y2', 'Y2')} FROM d5"
    q["a8_context_freq"] = with_(*SPARSE_BASE, *FEATURES, "fc AS (SELECT error_0, error_1, count(*) AS n FROM d6 GROUP BY ALL)") + \
        "SELECT CAST(error_0 AS BIGINT) AS error_0, CAST(error_1 AS BIGINT) AS error_1, n, " \
        f"{r6('round_even(100.0 * n / (SELECT sum(n) FROM fc), 1)', 'pct')} FROM fc"
    dcols = CTX + [f"ADHD_x_{c}" for c in CTX] + ["weekend", "ADHD_x_weekend"]
    q["a9_describe_groups"] = with_(*SPARSE_BASE, *FEATURES) + \
        "SELECT CAST(ADHD_numeric AS BIGINT) AS ADHD_numeric, count(*) AS n_obs, " + ", ".join(
            r6(f"round_even(100.0 * avg(CAST({c} AS DOUBLE)), 1)", f"pct_{c}") for c in dcols) + \
        " FROM d6 GROUP BY ADHD_numeric"
    scols = CTX + [f"ADHD_x_{c}" for c in CTX] + ["weekend"]
    q["a10_within_sd"] = with_(*SPARSE_BASE, *FEATURES) + "SELECT ID, " + ", ".join(
        r6(f"stddev_samp(CAST({c} AS DOUBLE))", f"{c}_sd") for c in scols) + " FROM d6 GROUP BY ID"
    q["w6_sequential_id"] = with_(*SPARSE_BASE, *FEATURES) + \
        "SELECT ID, CAST(dense_rank() OVER (ORDER BY ID) AS BIGINT) AS person_id FROM (SELECT DISTINCT ID FROM d6)"
    q["d7_build_series"] = with_(*SPARSE_BASE, *SERIES) + f"""SELECT ID, seq, CAST(person_id AS BIGINT) AS person_id,
        CAST(session AS BIGINT) AS session, CAST(ctsem_id AS BIGINT) AS ctsem_id, {r6('ctsem_time', 'ctsem_time')},
        series_key_collision FROM s7"""
    q["k7_run_sizes"] = with_(*SPARSE_BASE) + \
        "SELECT ID, seq, CAST(session AS BIGINT) AS session, count(*) OVER (PARTITION BY ID, session) AS series_n FROM d2"
    q["a13_check_gaps"] = with_(*SPARSE_BASE, *SERIES, DT_SERIES) + \
        f"SELECT ID, CAST(session AS BIGINT) AS session, {r6('max(dt)', 'max_dt')} FROM dts WHERE dt IS NOT NULL GROUP BY ID, session"
    d8cols = ["Y1", "Y2", "Y1_pm", "Y2_pm", "Y1_wc", "Y2_wc", "Y1_lag_wc", "Y2_lag_wc", "Y1_pm_lag",
              "Y2_pm_lag", "dt", "log_dt"]
    q["d8_var_design"] = with_(*SPARSE_BASE, *VAR1) + "SELECT ID, seq, " + ", ".join(r6(c, c) for c in d8cols) + \
        f", {r6('ADHD_numeric * Y1_lag_wc', 'ADHD_x_Y1_lag')}, {r6('ADHD_numeric * Y2_lag_wc', 'ADHD_x_Y2_lag')}" \
        f", {r6('ADHD_numeric * log_dt', 'ADHD_x_log_dt')}" + "".join(
            f", CAST(ADHD_numeric * {c} AS BIGINT) AS ADHD_x_{c}" for c in CTX) + " FROM c8"
    d9cols = ["Y1", "Y2", "Y1_lag", "Y1_lag2", "Y2_lag", "Y2_lag2", "dt", "log_dt"]
    q["d9_var_design_ar2"] = with_(*SPARSE_BASE, *VAR2) + "SELECT ID, seq, " + \
        ", ".join(r6(c, c) for c in d9cols) + " FROM c9"
    terms = ["one", "Y1_lag", "Y2_lag", "log_dt"]
    ys = ["Y1", "Y2"]

    def tv(a):
        return "1.0" if a == "one" else a
    sums = []
    for i, a in enumerate(terms):
        for b in terms[i:]:
            sums.append(r6(f"sum({tv(a)} * {tv(b)})", f"s__{a}__{b}"))
    for a in terms:
        for v in ys:
            sums.append(r6(f"sum({tv(a)} * {v})", f"s__{a}__{v}"))
    for i, u in enumerate(ys):
        for v in ys[i:]:
            sums.append(r6(f"sum({u} * {v})", f"s__{u}__{v}"))
    q["m1_panel_moments"] = with_(*SPARSE_BASE, *VAR2) + "SELECT ID, count(*) AS n, " + ", ".join(sums) + \
        " FROM c9 GROUP BY ID"
    st = """st AS (SELECT count(*) AS n, avg(Y1_lag) AS m1, avg(Y2_lag) AS m2,
              covar_pop(Y1_lag, Y1_lag) AS v11, covar_pop(Y2_lag, Y2_lag) AS v22, covar_pop(Y1_lag, Y2_lag) AS v12,
              avg(Y1) AS my1, avg(Y2) AS my2, covar_pop(Y1_lag, Y1) AS c1y1, covar_pop(Y2_lag, Y1) AS c2y1,
              covar_pop(Y1_lag, Y2) AS c1y2, covar_pop(Y2_lag, Y2) AS c2y2 FROM c9)"""
    bs = """bs AS (SELECT n, m1, m2, my1, my2,
              (v22 * c1y1 - v12 * c2y1) / (v11 * v22 - v12 * v12) AS b11, (v11 * c2y1 - v12 * c1y1) / (v11 * v22 - v12 * v12) AS b21,
              (v22 * c1y2 - v12 * c2y2) / (v11 * v22 - v12 * v12) AS b12, (v11 * c2y2 - v12 * c1y2) / (v11 * v22 - v12 * v12) AS b22
              FROM st)"""
    parts = [("Y1", "one", "my1 - b11 * m1 - b21 * m2"), ("Y1", "Y1_lag", "b11"), ("Y1", "Y2_lag", "b21"),
             ("Y2", "one", "my2 - b12 * m1 - b22 * m2"), ("Y2", "Y1_lag", "b12"), ("Y2", "Y2_lag", "b22")]
    q["m2_var_pooled"] = with_(*SPARSE_BASE, *VAR2, st, bs) + " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, '{t}' AS term, {r6(e, 'estimate')}, n FROM bs" for o, t, e in parts)
    pres = " UNION ALL ".join(
        f"SELECT ID, seq, ADHD, RawHours, session, '{c}' AS item, CAST(CAST({c} IS NOT NULL AS INTEGER) AS DOUBLE) AS responded FROM d2"
        for c in ITEMS)
    q["d10_response_pattern"] = with_(*SPARSE_BASE, f"rp AS ({pres})") + \
        f"SELECT ID, seq, ADHD, {r6('RawHours', 'RawHours')}, CAST(session AS BIGINT) AS session, item, {r6('responded', 'responded')} FROM rp"
    iv = "iv AS (SELECT ID, ADHD, " + ", ".join(f"var_samp({c}) AS var_{c}" for c in ITEMS) + " FROM d2 GROUP BY ID, ADHD)"
    il = "il AS (" + " UNION ALL ".join(f"SELECT ID, ADHD, 'var_{c}' AS variable, var_{c} AS value FROM iv" for c in ITEMS) + ")"
    order = "CASE " + " ".join(f"WHEN variable = 'var_{c}' THEN {i + 1}" for i, c in enumerate(ITEMS)) + " END"
    sub = "CASE WHEN variable IN (" + ", ".join(f"'var_{c}'" for c in A_ITEMS) + ") THEN 'Hostile' WHEN variable IN (" + \
        ", ".join(f"'var_{c}'" for c in B_ITEMS) + ") THEN 'Prosocial' END"
    q["d11_item_variance_bands"] = with_(*SPARSE_BASE, iv, il,
                                         f"""ig AS (SELECT CASE WHEN ADHD = 'Y' THEN 'ADHD' ELSE 'Control' END AS group_label, variable,
                                             CAST({order} AS BIGINT) AS item_order, {sub} AS subscale, avg(value) AS mean_val,
                                             stddev_samp(value) / sqrt(CAST(count(*) AS DOUBLE)) AS se_val FROM il GROUP BY ALL)""") + \
        f"""SELECT group_label, variable, item_order, subscale, {r6('mean_val', 'mean_val')}, {r6('se_val', 'se_val')},
        {r6('mean_val - 1.96 * se_val', 'lo')}, {r6('mean_val + 1.96 * se_val', 'hi')} FROM ig"""
    q["a11_person_summary"] = with_(*SPARSE_BASE, *SERIES) + f"""SELECT ID, count(*) AS n_obs, count(DISTINCT session) AS n_sessions,
        {r6('max(RawHours) - min(RawHours)', 'total_hours')}, CAST(min(ADHD_numeric) AS BIGINT) AS ADHD_numeric,
        {r6('avg(Y1)', 'anti_mean')}, {r6('stddev_samp(Y1)', 'anti_sd')}, {r6('max(Y1) - min(Y1)', 'anti_range')},
        {r6('avg(Y2)', 'pro_mean')}, {r6('stddev_samp(Y2)', 'pro_sd')}, {r6('max(Y2) - min(Y2)', 'pro_range')},
        CASE WHEN min(ADHD_numeric) = 1 THEN 'ADHD' ELSE 'Control' END AS "Group" FROM s7 GROUP BY ID"""
    # person means are taken from all scored rows, before short series go (centring stage "before")
    wp = ["w0 AS (SELECT *, Y1 - avg(Y1) OVER (PARTITION BY ID) AS Y1_wpc, Y2 - avg(Y2) OVER (PARTITION BY ID) AS Y2_wpc FROM d6)",
          "w1 AS (SELECT *, dense_rank() OVER (ORDER BY ID) AS person_id, count(*) OVER (PARTITION BY ID, session) AS _sn FROM w0)",
          "wp AS (SELECT *, person_id * 1000 + session AS ctsem_id FROM w1 WHERE _sn >= 3)"]
    ids = "ID, CASE WHEN ADHD_numeric = 1 THEN 'ADHD' ELSE 'Control' END AS \"Group\", session, ctsem_id, TimeHours AS ctsem_time, seq"
    dist = "dl AS (" + " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS Centering, '{v}' AS Variable, {col} AS Value FROM wp" for c, v, col in [
            ("Grand-mean centred", "Hostile", "Y1"), ("Grand-mean centred", "Prosocial", "Y2"),
            ("Within-person centred", "Hostile", "Y1_wpc"), ("Within-person centred", "Prosocial", "Y2_wpc")]) + ")"
    hist = histogram_sql("dl", "Value", 30, ["Centering", "Variable"])
    q["d12_distribution_hist"] = with_(*SPARSE_BASE, *FEATURES, *wp, dist)[:-1] + ",\n" + hist[len("WITH "):]
    q["d12_trajectories"] = with_(*SPARSE_BASE, *FEATURES, *wp, dist) + f"""SELECT ID, "Group", CAST(session AS BIGINT) AS session,
        CAST(ctsem_id AS BIGINT) AS ctsem_id, {r6('ctsem_time', 'ctsem_time')}, seq, Centering, Variable, {r6('Value', 'Value')} FROM dl"""
    hist2 = histogram_sql("dts", "dt", 50, [])
    q["a16_interval_hist"] = with_(*SPARSE_BASE, *SERIES, DT_SERIES)[:-1] + ",\n" + hist2[len("WITH "):]
    smooth = local_regression_sql("dl", "ctsem_time", "Value", ["Centering", "Variable", '"Group"'])
    q["m9_trajectory_smooth"] = with_(*SPARSE_BASE, *FEATURES, *wp, dist)[:-1] + ",\n" + smooth[len("WITH "):]
    hist3 = histogram_sql("hn", "Y1", 20, ["panel"])
    q["a16_null_panel"] = with_(DENSE, "hn AS (SELECT CASE WHEN seq % 3 <> 0 THEN ADHD END AS panel, Y1 FROM dense)")[:-1] + ",\n" + hist3[len("WITH "):]
    rl = "rl AS (" + " UNION ALL ".join(
        f"SELECT ID, occasion, '{c}' AS item, CAST({c} AS DOUBLE) AS value FROM oc" for c in ITEMS) + ")"
    occ = f"oc AS (SELECT *, row_number() OVER (PARTITION BY ID {ORDER}) AS occasion FROM d2)"
    q["d13_reliability_long"] = with_(*SPARSE_BASE, occ, rl) + \
        f"SELECT ID, CAST(occasion AS BIGINT) AS occasion, item, {r6('value', 'value')} FROM rl"
    facs = ["ID", "occasion", "item"]
    vc = [occ, rl, "rv AS (SELECT * FROM rl WHERE value IS NOT NULL)"]
    sel = [r6("(SELECT sum(value * value) FROM rv)", "T0", 2),
           r6("(SELECT sum(value) * sum(value) / count(*) FROM rv)", "Tmu", 2), "(SELECT count(*) FROM rv) AS N"]
    for f in facs:
        vc.append(f"lv_{f} AS (SELECT {f}, count(*) AS n, sum(value) AS s FROM rv GROUP BY {f})")
        sel.append(r6(f"(SELECT sum(s * s / n) FROM lv_{f})", f"T_{f}", 2))
        sel.append(r6(f"(SELECT sum(CAST(n AS DOUBLE) * n) FROM lv_{f})", f"S_{f}", 2))
        sel.append(f"(SELECT count(*) FROM lv_{f}) AS L_{f}")
    for f in facs:
        for g in facs:
            if f == g:
                continue
            vc.append(f"""cf_{f}_{g} AS (SELECT {f}, sum(CAST(nfg AS DOUBLE) * nfg) AS q, sum(nfg) AS nf
                          FROM (SELECT {f}, {g}, count(*) AS nfg FROM rv GROUP BY {f}, {g}) GROUP BY {f})""")
            sel.append(r6(f"(SELECT sum(q / nf) FROM cf_{f}_{g})", f"C_{f}_{g}", 2))
    q["m7_vc_quadratic_forms"] = with_(*SPARSE_BASE, *vc) + "SELECT " + ", ".join(sel)
    q["m7_components"] = with_(*SPARSE_BASE, occ, rl)[:-1] + ", " + components_sql(
        "rl", {"all": ITEMS, "anti": A_ITEMS, "pro": B_ITEMS}, facs, 1, 2)
    full, shown_full = pooled_var_sql("c9", ["Y1_lag", "Y1_lag2", "Y2_lag", "Y2_lag2"], ["Y1", "Y2"], "ID")
    q["m2_var_full"] = with_(*SPARSE_BASE, *VAR2, *full) + shown_full
    pooled = " UNION ALL ".join(f"SELECT l_suppkey, '{c}' AS item, CAST({c} AS DOUBLE) AS v FROM li" for c in LCOLS)
    aggs = []
    for s, cs in LSCALES.items():
        inn = ", ".join(f"'{c}'" for c in cs)
        aggs += [r6(f"var_samp(v) FILTER (WHERE item IN ({inn}))", f"var_{s}"),
                 r6(f"stddev_samp(v) FILTER (WHERE item IN ({inn}))", f"sd_{s}"),
                 r6(f"avg(v) FILTER (WHERE item IN ({inn}))", f"mean_{s}")]
    q["a5_pooled_stats"] = with_(LINE, f"lp AS ({pooled})") + "SELECT l_suppkey, " + ", ".join(aggs) + \
        " FROM lp GROUP BY l_suppkey"
    st6 = ["count(*) AS n_obs"]
    for fn, pre in (("var_samp", "var"), ("stddev_samp", "sd"), ("avg", "mean")):
        st6 += [r6(f"{fn}({c})", f"{pre}_{c}") for c in LCOLS]
    q["a6_item_stats"] = with_(LINE) + "SELECT l_suppkey, " + ", ".join(st6) + " FROM li GROUP BY l_suppkey"

    def cnt(cols, cond):
        return "(" + " + ".join(f"CAST(coalesce({cond.format(c=c)}, false) AS INTEGER)" for c in cols) + ")"
    vcols = [f"var_{c}" for c in LCOLS]
    sdcols = [f"sd_{c}" for c in LCOLS]
    a7 = [LINE, f"lp AS ({pooled})",
          "i6 AS (SELECT l_suppkey, count(*) AS n_obs, " + ", ".join(
              [f"var_samp({c}) AS var_{c}" for c in LCOLS] + [f"stddev_samp({c}) AS sd_{c}" for c in LCOLS]) +
          " FROM li GROUP BY l_suppkey)",
          "po AS (SELECT l_suppkey, var_samp(v) AS var_overall, stddev_samp(v) AS sd_overall, avg(v) AS mean_overall FROM lp GROUP BY l_suppkey)",
          f"""a7 AS (SELECT *, {cnt(vcols, '({c} = 0 OR {c} IS NULL)')} AS n_zero_var, {cnt(vcols, '{c} < 0.1')} AS n_low_var,
              {cnt(sdcols, '({c} = 0 OR {c} IS NULL)')} AS n_zero_sd, {cnt(sdcols, '{c} < 0.3')} AS n_low_sd
              FROM i6 JOIN po USING (l_suppkey))"""]
    q["a7_item_variability"] = with_(*a7) + f"""SELECT l_suppkey, n_obs, {r6('var_overall', 'var_overall')},
        {r6('sd_overall', 'sd_overall')}, {r6('mean_overall', 'mean_overall')}, CAST(n_zero_var AS BIGINT) AS n_zero_var,
        CAST(n_low_var AS BIGINT) AS n_low_var, CAST(n_zero_sd AS BIGINT) AS n_zero_sd, CAST(n_low_sd AS BIGINT) AS n_low_sd,
        n_zero_var > 0 AS any_zero_var, n_low_var >= 3 AS multiple_low_var, sd_overall < 0.5 AS overall_low_var FROM a7"""
    pairs = [(a, b) for i, a in enumerate(LCOLS) for b in LCOLS[i + 1:]]
    q["a15_correlations"] = with_(LINE) + " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, {r6(f'corr({a}, {b})', 'r')}, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM li" for a, b in pairs)
    means = ", ".join(f"avg({c}) AS mean_{c}" for c in LCOLS)
    ml = " UNION ALL ".join(f"SELECT l_suppkey, s_nationkey, 'mean_{c}' AS variable, mean_{c} AS value FROM mj" for c in LCOLS)
    q["a12_mean_ci"] = with_(LINE, f"mi AS (SELECT l_suppkey, {means} FROM li GROUP BY l_suppkey)",
                             "mj AS (SELECT mi.*, s.s_nationkey FROM mi JOIN supplier s ON mi.l_suppkey = s.s_suppkey)",
                             f"ml AS ({ml})",
                             """mc AS (SELECT s_nationkey, variable, avg(value) AS mean_val,
                                 stddev_samp(value) / sqrt(CAST(count(*) AS DOUBLE)) AS se_val FROM ml GROUP BY ALL)""") + \
        f"""SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, variable, {r6('mean_val', 'mean_val')}, {r6('se_val', 'se_val')},
        {r6('mean_val - 1.96 * se_val', 'lo')}, {r6('mean_val + 1.96 * se_val', 'hi')} FROM mc"""
    pt = """pt AS (SELECT event_id AS seq,
              TRY_CAST(NULLIF(CASE WHEN event_type = 'error' THEN '#skipped#' ELSE json_extract_string(props, '$.k') END, '#skipped#') AS DOUBLE) AS resp_num,
              CAST(epoch_us(date_trunc('second', ts)) AS DOUBLE) / 1e6 AS t FROM events)"""
    q["p_clean_times"] = with_(pt) + f"""SELECT seq, {r6('resp_num', 'resp_num')}, {r6('t', 't')}, CAST({WDAY} AS BIGINT) AS weekday,
        CAST(CASE WHEN {WDAY} IN (1, 7) THEN 1 ELSE 0 END AS BIGINT) AS weekend, {DAYS}[{WDAY}] AS day_of_week FROM pt"""
    pres_a = ", ".join(f"CAST(CAST({c} IS NOT NULL AS INTEGER) AS BIGINT) AS {c}_present" for c in A_ITEMS)
    high = "(0 + " + " + ".join(f"CAST(coalesce({c} > 50, false) AS INTEGER)" for c in A_ITEMS) + ")"
    dayno = "CASE " + " ".join(f"WHEN day_of_week = '{d}' THEN {i + 1}" for i, d in
                               enumerate(["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"])) + " END"
    q["p_row_ops"] = with_(SPARSE_LONG, SPARSE_WIDE, D1, f"""ro AS (SELECT *, CAST(coalesce(ADHD = 'Y', false) AS INTEGER) AS g,
        CAST(coalesce(error_0, 0.0) != 0.0 AS INTEGER) AS err FROM d1)""") + \
        f"""SELECT ID, seq, {pres_a}, {r6(row_mean(A_ITEMS), 'anti_mean')}, CAST({high} AS BIGINT) AS n_high,
        CAST(g AS BIGINT) AS g, CAST(err AS BIGINT) AS err, CAST(g * err AS BIGINT) AS g_x_err,
        CAST(g * weekend AS BIGINT) AS g_x_weekend, CAST({dayno} AS BIGINT) AS day_no,
        {r6('CASE WHEN click_0 > 0 THEN ln(click_0) END', 'log_click')} FROM ro"""
    anyA = " OR ".join(f"{c} IS NOT NULL" for c in A_ITEMS)
    q["k_filters"] = with_(SPARSE_LONG, SPARSE_WIDE, D1,
                           "kf AS (SELECT * FROM d1 WHERE t IS NOT NULL AND NOT coalesce(ID IN (1, 2, 3), false))") + \
        f"""SELECT (SELECT count(*) FROM kf WHERE {anyA}) AS n_any,
        (SELECT count(*) FROM kf WHERE click_0 IS NOT NULL AND view_0 IS NOT NULL) AS n_all,
        (SELECT count(*) FROM kf WHERE day_of_week IN ('Sat', 'Sun')) AS n_weekend"""
    q["j_joins"] = with_(DENSE, "u AS (SELECT ID, count(*) AS n_events FROM dense GROUP BY ID)",
                         """cv AS (SELECT c.c_custkey AS ID, c.c_acctbal, r.r_name FROM customer c
                             JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)""") + \
        f"""SELECT u.ID, u.n_events, {r6('cv.c_acctbal', 'c_acctbal')}, coalesce(cv.r_name, 'none') AS r_name
        FROM u LEFT JOIN cv ON u.ID = cv.ID WHERE u.ID IN (SELECT c_custkey FROM customer)"""
    q["u_union_distinct"] = with_(DENSE) + \
        "SELECT DISTINCT ID, 'Y1' AS variable, CAST(NULL AS VARCHAR) AS ADHD FROM dense UNION SELECT DISTINCT ID, 'Y2', ADHD FROM dense"
    q["a4_quality_report"] = with_(*SPARSE_BASE) + """SELECT count(*) AS n_rows,
        count(*) FILTER (WHERE gap_hours > 30) AS n_large_gap, count(*) FILTER (WHERE click_0 IS NULL) AS n_no_click,
        count(*) FILTER (WHERE weekend = 1) AS n_weekend, count(DISTINCT ID) AS n_persons,
        (SELECT max(c) FROM (SELECT count(*) AS c FROM d2 GROUP BY ID)) AS max_rows_per_person FROM d2"""
    q.update(_more())
    return q


SQL = _sql()
