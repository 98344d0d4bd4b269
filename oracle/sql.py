"""The registered queries as plain SQL over the same tables, for DuckDB.

Written from the definitions, with window joins and self-joins over dense grids; nothing
here follows the Spark plans.
"""

LOOKBACK = 12


def r6(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def with_(parts: list, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


# ------------------------------------------------------------------ panels

BRAND_PRICES = """brand_prices AS (
  SELECT l_shipdate AS ts, p_brand AS asset, l_extendedprice / l_quantity AS price, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

PANELS = {
    "brand_week": "SELECT date_trunc('week', ts)::TIMESTAMP AS ts, asset, round(avg(price) + 1e-10, 6) AS price FROM brand_prices GROUP BY 1, 2",
    "brand_day": "SELECT date_trunc('day', ts)::TIMESTAMP AS ts, asset, round(avg(price) + 1e-10, 6) AS price FROM brand_prices GROUP BY 1, 2",
    "nation_day": """SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, n_name AS asset, round(avg(l_extendedprice / l_quantity) + 1e-10, 6) AS price
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2""",
    "event_6h": """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, event_type AS asset, round(avg(value + 1) + 1e-10, 6) AS price
      FROM events GROUP BY 1, 2""",
}


def panel(name: str, tag: str = "") -> list:
    """CTEs panel, cal, ix and rt of one panel; ``tag`` keeps two panels apart."""
    parts = [BRAND_PRICES] if name.startswith("brand") else []
    return parts + [
        f"panel{tag} AS MATERIALIZED ({PANELS[name]})",
        f"cal{tag} AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos FROM (SELECT DISTINCT ts FROM panel{tag}))",
        f"ix{tag} AS MATERIALIZED (SELECT p.ts, pos, asset, price FROM panel{tag} p JOIN cal{tag} c ON c.ts = p.ts)",
        f"""rt{tag} AS MATERIALIZED (SELECT *, CASE WHEN price > 0 AND prev_price > 0 THEN ln(price / prev_price) ELSE 0 END AS ret
           FROM (SELECT *, lag(pos) OVER w AS prev_pos, lag(price) OVER w AS prev_price FROM ix{tag} WINDOW w AS (PARTITION BY asset ORDER BY pos)))""",
    ]


def rolling(lookback: int = LOOKBACK, tag: str = "") -> str:
    return f"win{tag} AS MATERIALIZED (SELECT pos - {lookback - 1} AS start_pos, pos AS end_pos, ts AS end_ts FROM cal{tag} WHERE pos >= {lookback})"


def window_rows(tag: str = "", members: bool = False) -> str:
    """wr: every window, asset and row k = 1..n with its masked return."""
    assets = f"(SELECT DISTINCT asset FROM ix{tag}) a"
    join = f"JOIN (SELECT DISTINCT end_pos AS e, asset FROM members) a ON a.e = w.end_pos" if members else f"CROSS JOIN {assets}"
    return f"""wr{tag} AS MATERIALIZED (
  SELECT w.start_pos, w.end_pos, a.asset, c.pos - w.start_pos + 1 AS k, w.end_pos - w.start_pos + 1 AS n,
         coalesce(CASE WHEN r.prev_pos >= w.start_pos THEN r.ret END, 0.0) AS r
  FROM (SELECT DISTINCT start_pos, end_pos FROM win{tag}) w {join}
  JOIN cal{tag} c ON c.pos BETWEEN w.start_pos AND w.end_pos
  LEFT JOIN rt{tag} r ON r.asset = a.asset AND r.pos = c.pos)"""


# ------------------------------------------------------------------ correlations

PEARSON = "CASE WHEN min(xv) = max(xv) OR min(yv) = max(yv) THEN 0 ELSE corr(xv, yv) END"
STRICT = "CASE WHEN min(xv) = max(xv) OR min(yv) = max(yv) THEN NULL ELSE corr(xv, yv) END"
WKEY = "start_pos, end_pos"


def same_window(a: str, b: str) -> str:
    return f"{a}.start_pos = {b}.start_pos AND {a}.end_pos = {b}.end_pos"


def lagged(lags: str = "1", value: str = "r", tag: str = "") -> str:
    """al: aligned rows of every ordered pair, x earlier than y."""
    return f"""al{tag} AS (
  SELECT a.start_pos, a.end_pos, l.lag, a.asset AS x, b.asset AS y, a.{value} AS xv, b.{value} AS yv
  FROM wr{tag} a CROSS JOIN (SELECT unnest([{lags}]) AS lag) l
  JOIN wr{tag} b ON {same_window('a', 'b')} AND b.k = a.k + l.lag AND a.asset <> b.asset)"""


def correlations(measure: str = PEARSON, tag: str = "") -> str:
    return f"cc{tag} AS MATERIALIZED (SELECT {WKEY}, lag, x, y, {measure} AS c FROM al{tag} GROUP BY {WKEY}, lag, x, y)"


def edges_at_lag(tag: str = "") -> str:
    return f"""edges{tag} AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, a.x AS asset_i, a.y AS asset_j, coalesce(a.c - b.c, 0) AS value
  FROM cc{tag} a JOIN cc{tag} b ON {same_window('a', 'b')} AND a.x = b.y AND a.y = b.x AND a.lag = b.lag WHERE a.x < a.y)"""


def pearson_edges(name: str = "brand_week", win: str = None, tag: str = "") -> list:
    return panel(name, tag) + [win or rolling(tag=tag), window_rows(tag), lagged(tag=tag), correlations(tag=tag), edges_at_lag(tag)]


EDGE_BODY = f"SELECT {ts('w.end_ts')} AS end_ts, asset_i, asset_j, {r6('value')} AS value FROM edges e JOIN win w ON {same_window('e', 'w')}"

WEEK = pearson_edges()

SQUARED = panel("brand_week") + [
    rolling(), window_rows(), "wq AS (SELECT start_pos, end_pos, asset, k, n, r * r AS r FROM wr)",
    lagged().replace("FROM wr a", "FROM wq a").replace("JOIN wr b", "JOIN wq b"), correlations(), edges_at_lag(),
]

SEGMENTS = """seg AS MATERIALIZED (
  SELECT start_pos, end_pos, asset, 'early' AS side, k AS t, r FROM wr WHERE k <= n - 1
  UNION ALL SELECT start_pos, end_pos, asset, 'late', k - 1, r FROM wr WHERE k >= 2)"""


def segment_pairs(source: str, value: str) -> str:
    return f"""al AS (
  SELECT a.start_pos, a.end_pos, 1 AS lag, a.asset AS x, b.asset AS y, a.{value} AS xv, b.{value} AS yv
  FROM {source} a JOIN {source} b ON {same_window('a', 'b')} AND a.side = 'early' AND b.side = 'late' AND a.t = b.t AND a.asset <> b.asset)"""


SPEARMAN = panel("brand_week") + [
    rolling(), window_rows(), SEGMENTS,
    """ranked AS MATERIALIZED (
  SELECT *, rank() OVER (PARTITION BY start_pos, end_pos, asset, side ORDER BY r)
            + (count(*) OVER (PARTITION BY start_pos, end_pos, asset, side, r) - 1) / 2.0 AS rk FROM seg)""",
    segment_pairs("ranked", "rk"), correlations(STRICT), edges_at_lag(),
]

KENDALL = panel("brand_week") + [
    rolling(), window_rows(), SEGMENTS,
    f"""signs AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, a.asset, a.side, a.t * 1000 + b.t AS t, sign(a.r - b.r)::INTEGER AS s
  FROM seg a JOIN seg b ON {same_window('a', 'b')} AND a.asset = b.asset AND a.side = b.side AND a.t < b.t)""",
    segment_pairs("signs", "s"),
    f"""cc AS MATERIALIZED (SELECT {WKEY}, lag, x, y,
  CASE WHEN sum(xv * xv) > 0 AND sum(yv * yv) > 0 THEN sum(xv * yv) / sqrt(sum(xv * xv)::DOUBLE * sum(yv * yv)::DOUBLE) END AS c
  FROM al GROUP BY {WKEY}, lag, x, y)""",
    edges_at_lag(),
]

DISTANCE = panel("brand_week") + [
    rolling(), window_rows(), SEGMENTS,
    f"""gaps AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, a.asset, a.side, a.t AS ta, b.t AS tb, abs(a.r - b.r) AS d
  FROM seg a JOIN seg b ON {same_window('a', 'b')} AND a.asset = b.asset AND a.side = b.side)""",
    """centred AS MATERIALIZED (
  SELECT start_pos, end_pos, asset, side, ta * 1000 + tb AS t,
         d - avg(d) OVER (PARTITION BY start_pos, end_pos, asset, side, ta) - avg(d) OVER (PARTITION BY start_pos, end_pos, asset, side, tb)
           + avg(d) OVER (PARTITION BY start_pos, end_pos, asset, side) AS v FROM gaps)""",
    segment_pairs("centred", "v"),
    f"""flat AS (SELECT start_pos, end_pos, asset, side, min(r) = max(r) AS constant FROM seg GROUP BY ALL)""",
    f"""raw AS (SELECT {WKEY}, lag, x, y, sum(xv * yv) AS xy, sum(xv * xv) AS xx, sum(yv * yv) AS yy FROM al GROUP BY {WKEY}, lag, x, y)""",
    f"""cc AS MATERIALIZED (SELECT q.start_pos, q.end_pos, lag, x, y,
  CASE WHEN fx.constant OR fy.constant OR xx = 0 OR yy = 0 THEN 0 ELSE sqrt(greatest(xy, 0) / sqrt(xx * yy)) END AS c
  FROM raw q JOIN flat fx ON {same_window('q', 'fx')} AND fx.asset = x AND fx.side = 'early'
  JOIN flat fy ON {same_window('q', 'fy')} AND fy.asset = y AND fy.side = 'late')""",
    edges_at_lag(),
]

MUTUAL = panel("brand_week") + [
    rolling(), window_rows(), SEGMENTS,
    """cuts AS MATERIALIZED (
  SELECT start_pos, end_pos, asset, side, list_sort(list_distinct(quantile_cont(r, [0, 0.25, 0.5, 0.75, 1]))) AS e FROM seg GROUP BY ALL)""",
    """binned AS MATERIALIZED (
  SELECT s.start_pos, s.end_pos, s.asset, s.side, s.t, CASE WHEN len(e) > 1 THEN greatest(len([v for v in e if v < s.r]), 1) END AS bin
  FROM seg s JOIN cuts c ON c.start_pos = s.start_pos AND c.end_pos = s.end_pos AND c.asset = s.asset AND c.side = s.side)""",
    segment_pairs("binned", "bin"),
    f"""cells AS (SELECT {WKEY}, lag, x, y, xv, yv, count(*) AS n FROM al GROUP BY ALL)""",
    f"""shares AS (SELECT *, sum(n) OVER p AS total, sum(n) OVER (PARTITION BY {WKEY}, lag, x, y, xv) AS nx, sum(n) OVER (PARTITION BY {WKEY}, lag, x, y, yv) AS ny
  FROM cells WINDOW p AS (PARTITION BY {WKEY}, lag, x, y))""",
    f"""cc AS MATERIALIZED (SELECT {WKEY}, lag, x, y,
  CASE WHEN bool_or(xv IS NULL OR yv IS NULL) THEN NULL ELSE greatest(sum(n / total * ln(n * total / (nx * ny))), 0) END AS c
  FROM shares GROUP BY {WKEY}, lag, x, y)""",
    edges_at_lag(),
]

MULTI = panel("brand_week") + [rolling(), window_rows(), lagged("1, 2, 3"), correlations()]
SIDES = f"""sides AS (
  SELECT a.start_pos, a.end_pos, a.x AS asset_i, a.y AS asset_j, sum(abs(a.c)) AS sa, sum(abs(b.c)) AS sb, max(abs(a.c)) AS ma, max(abs(b.c)) AS mb
  FROM cc a JOIN cc b ON {same_window('a', 'b')} AND a.x = b.y AND a.y = b.x AND a.lag = b.lag WHERE a.x < a.y GROUP BY ALL)"""
AUC = MULTI + [SIDES, "edges AS (SELECT *, CASE WHEN sa + sb = 0 THEN 0 ELSE sign(sa - sb) * greatest(sa, sb) / (sa + sb) END AS value FROM sides)"]
MAXLAG = MULTI + [SIDES, "edges AS (SELECT *, CASE WHEN ma > mb THEN ma WHEN ma < mb THEN -mb ELSE 0 END AS value FROM sides)"]


def signature(scale: str = "1", half: bool = False) -> list:
    area = f"""edges AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, a.asset AS asset_i, b.asset AS asset_j,
         sum((a.px - a.x0) * b.d - (b.px - b.x0) * a.d) {'/ 2' if half else ''} / (any_value(a.sd) * any_value(b.sd)) AS value
  FROM steps a JOIN steps b ON {same_window('a', 'b')} AND a.k = b.k AND a.asset < b.asset WHERE a.k > 1 GROUP BY ALL)"""
    return panel("brand_week") + [
        rolling(), window_rows(),
        f"""steps AS MATERIALIZED (
  SELECT start_pos, end_pos, asset, k, lag(r) OVER w AS px, r - lag(r) OVER w AS d, first_value(r) OVER w AS x0, {scale} AS sd
  FROM wr WINDOW w AS (PARTITION BY start_pos, end_pos, asset ORDER BY k))""",
        area,
    ]


STD = """coalesce(nullif(stddev_samp(r) OVER (PARTITION BY start_pos, end_pos, asset), 0), 1)"""

# ------------------------------------------------------------------ scores and metrics

CELLS = """cells AS MATERIALIZED (
  SELECT start_pos, end_pos, asset_i AS asset, asset_j AS other, value AS v FROM edges
  UNION ALL SELECT start_pos, end_pos, asset_j, asset_i, -value FROM edges)"""
SCORES = "scores AS MATERIALIZED (SELECT start_pos, end_pos, asset, sum(v) AS s, count(*) + 1 AS n FROM cells GROUP BY ALL)"
METRICS = """prev AS (SELECT start_pos, end_pos, lag(start_pos) OVER o AS ps, lag(end_pos) OVER o AS pe
  FROM (SELECT DISTINCT start_pos, end_pos FROM edges) WINDOW o AS (PARTITION BY {run} ORDER BY end_pos))""".replace("{run}", "end_pos - start_pos"), """size_m AS (
  SELECT start_pos, end_pos, avg(abs(v)) AS mean_abs_matrix, max(abs(v)) AS max_abs_matrix, count(*) AS cells FROM cells GROUP BY ALL)""", """score_m AS (
  SELECT start_pos, end_pos, max(s) - min(s) AS row_sum_range, stddev_pop(s) AS row_sum_std, count(*) AS n_assets, max(s) AS leader_score, min(s) AS laggard_score
  FROM scores GROUP BY ALL)""", """shared AS MATERIALIZED (
  SELECT c.start_pos, c.end_pos, c.asset, c.v, p.v AS pv FROM cells c JOIN prev q ON q.start_pos = c.start_pos AND q.end_pos = c.end_pos
  JOIN cells p ON p.start_pos = q.ps AND p.end_pos = q.pe AND p.asset = c.asset AND p.other = c.other)""", """stab_m AS (
  SELECT start_pos, end_pos, corr(v, pv) AS stability_matrix_corr, count(*) AS shared_cells FROM shared GROUP BY ALL)""", """stab_r AS (
  SELECT start_pos, end_pos, corr(s, ps) AS stability_rowsum_corr
  FROM (SELECT start_pos, end_pos, asset, sum(v) AS s, sum(pv) AS ps FROM shared GROUP BY ALL) GROUP BY ALL)""", """metrics AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, mean_abs_matrix, max_abs_matrix, row_sum_range, row_sum_std, stability_matrix_corr, stability_rowsum_corr, n_assets,
         leader_score, laggard_score, cells, shared_cells
  FROM size_m a JOIN score_m b USING (start_pos, end_pos) LEFT JOIN stab_m c USING (start_pos, end_pos) LEFT JOIN stab_r d USING (start_pos, end_pos))"""
METRIC_CTES = [CELLS, SCORES, *METRICS]
NAMES = ["mean_abs_matrix", "max_abs_matrix", "row_sum_range", "row_sum_std", "stability_matrix_corr", "stability_rowsum_corr", "n_assets"]
METRIC_COLUMNS = ", ".join(f"{r6(n)} AS {n}" if n != "n_assets" else n for n in NAMES)


def summary_of(source: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    parts = []
    for n in NAMES:
        sized, counted = n in NAMES[:4], n == "n_assets"
        parts.append(
            f"SELECT {k}'{n}' AS metric, avg({n}) AS mean, {'NULL' if counted else f'median({n})'} AS median, "
            f"{f'stddev_samp({n})' if sized else 'NULL'} AS std, {f'max({n})' if sized or counted else 'NULL'} AS max, "
            f"{f'min({n})' if counted else 'NULL'} AS min FROM {source} {f'GROUP BY {keys}' if keys else ''}"
        )
    casted = " UNION ALL ".join(parts)
    return f"SELECT {k}metric, mean::DOUBLE AS mean, median::DOUBLE AS median, std::DOUBLE AS std, max::DOUBLE AS max, min::DOUBLE AS min FROM ({casted})"


REGIME = """regime AS MATERIALIZED (
  SELECT a.start_pos, a.end_pos, returns_mean, returns_vol, cross_sectional_vol, dispersion
  FROM (SELECT start_pos, end_pos, avg(r) AS returns_mean, stddev_samp(r) AS returns_vol FROM wr GROUP BY ALL) a
  JOIN (SELECT start_pos, end_pos, avg(s) AS cross_sectional_vol FROM (SELECT start_pos, end_pos, k, stddev_pop(r) AS s FROM wr GROUP BY ALL) GROUP BY ALL) b USING (start_pos, end_pos)
  JOIN (SELECT start_pos, end_pos, avg(s) AS dispersion FROM (SELECT start_pos, end_pos, asset, stddev_pop(r) AS s FROM wr GROUP BY ALL) GROUP BY ALL) c USING (start_pos, end_pos))"""

# ------------------------------------------------------------------ universe

DAY = panel("brand_day")
MONTHLY = """monthly AS MATERIALIZED (
  SELECT month, list(asset ORDER BY revenue DESC, asset) AS symbols FROM (
    SELECT date_trunc('month', l_shipdate)::DATE AS month, p_brand AS asset, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY month)"""
TRIMMED = """trimmed AS MATERIALIZED (
  SELECT month, symbols[1:(least(len(symbols), 15) - least(len(symbols), 15) % 2)::BIGINT] AS symbols FROM monthly WHERE len(symbols) >= 2
  UNION ALL SELECT month, symbols FROM monthly WHERE len(symbols) < 2)"""
DAILY = """daily AS MATERIALIZED (
  SELECT c.ts, c.pos, t.symbols FROM cal c LEFT JOIN trimmed t ON t.month = (date_trunc('month', c.ts) - INTERVAL 1 MONTH)::DATE)"""
LISTED = """listed AS MATERIALIZED (
  SELECT d.ts, d.pos, unnest(symbols) AS asset, generate_subscripts(symbols, 1) AS rank FROM daily d WHERE symbols IS NOT NULL)"""
KEPT = """kept AS MATERIALIZED (
  SELECT l.ts, l.pos, l.asset, l.rank FROM listed l
  LEFT JOIN ix i ON i.asset = l.asset AND i.pos BETWEEN l.pos - 20 AND l.pos - 1
  GROUP BY l.ts, l.pos, l.asset, l.rank HAVING l.pos = 0 OR least(l.pos, 20) - count(i.pos) <= 10)"""
UNIVERSE = """universe AS MATERIALIZED (
  SELECT ts, pos, CASE WHEN pos > 0 AND len(a) > 1 AND len(a) % 2 = 1 THEN a[1:len(a) - 1] ELSE a END AS symbols
  FROM (SELECT ts, pos, list(asset ORDER BY rank) AS a FROM kept GROUP BY ts, pos))"""
UNIVERSE_CTES = DAY + [MONTHLY, TRIMMED, DAILY, LISTED, KEPT, UNIVERSE]
MEMBER_ROWS = "mrows AS MATERIALIZED (SELECT ts, pos, unnest(symbols) AS asset FROM universe)"
GATED = """first_day AS (SELECT min(ts) AS ts FROM universe WHERE len(symbols) > 0),
known AS (SELECT * FROM ix WHERE ts >= (SELECT ts FROM first_day)),
gaps AS (SELECT DISTINCT m.ts, m.pos, m.asset FROM mrows m ANTI JOIN known k ON k.pos = m.pos AND k.asset = m.asset),
filled AS (SELECT g.ts, g.asset, max_by(k.price, k.pos) AS price FROM gaps g JOIN known k ON k.asset = g.asset AND k.pos < g.pos GROUP BY g.ts, g.pos, g.asset)"""

WEEK_W = panel("brand_week", "w")[1:]
ASOF = """asof_u AS MATERIALIZED (
  SELECT w.end_pos, w.end_ts, u.symbols FROM winw w ASOF JOIN universe u ON w.end_ts >= u.ts)"""
MEMBERS = """members AS MATERIALIZED (
  SELECT end_pos, end_ts, asset, rank FROM (SELECT end_pos, end_ts, unnest(symbols) AS asset, generate_subscripts(symbols, 1) AS rank FROM asof_u)
  WHERE asset IN (SELECT asset FROM ixw))"""
UNIVERSE_EDGES = UNIVERSE_CTES + WEEK_W + [
    rolling(tag="w"), ASOF, MEMBERS, window_rows("w", members=True), lagged(tag="w"), correlations(tag="w"), edges_at_lag("w"),
    "edges AS (SELECT * FROM edgesw)",
]

# ------------------------------------------------------------------ runs

RUN_WINDOWS = "win{t} AS MATERIALIZED (SELECT pos - n + 1 AS start_pos, pos AS end_pos, ts AS end_ts FROM cal{t} CROSS JOIN (SELECT unnest([8, 12, 16]) AS n) WHERE pos >= n)"


def tagged_metrics(tag: str) -> list:
    """The metric CTEs of the edges named with ``tag``."""
    parts = []
    for cte in METRIC_CTES:
        head, body = cte.split(" AS ", 1)
        for word in ("edges", "cells", "scores", "prev", "size_m", "score_m", "shared", "stab_m", "stab_r"):
            for before in ("FROM ", "JOIN "):
                body = body.replace(f"{before}{word} ", f"{before}{word}{tag} ").replace(f"{before}{word})", f"{before}{word}{tag})")
                body = body.replace(f"{before}{word}\n", f"{before}{word}{tag}\n")
        parts.append(f"{head}{tag} AS {body}")
    return parts


def run_metrics() -> list:
    """runs: metrics of both panels at lookbacks 8, 12 and 16."""
    parts = []
    for tag, name, scenario in (("w", "brand_week", "weekly"), ("e", "event_6h", "six_hour")):
        parts += pearson_edges(name, RUN_WINDOWS.replace("{t}", tag), tag) + tagged_metrics(tag)
        parts.append(
            f"runs{tag} AS (SELECT '{scenario}' AS scenario, printf('{scenario}_fixed_%02d', m.end_pos - m.start_pos + 1) AS run, w.end_ts, "
            f"{', '.join(NAMES)} FROM metrics{tag} m JOIN win{tag} w ON {same_window('m', 'w')})"
        )
    return parts + ["runs AS MATERIALIZED (SELECT * FROM runsw UNION ALL SELECT * FROM runse)"]


RUNS = run_metrics()
SUMMARIES = RUNS + [f"summaries AS MATERIALIZED ({summary_of('runs', 'scenario, run')})"]
LONG = SUMMARIES + [
    "long AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT scenario, run, metric, '{s}' AS stat, {s} AS value FROM summaries" for s in ("mean", "median", "std", "max", "min")
    ) + ")"
]
MOMENTS = "mom AS (SELECT metric, stat, scenario, count(value) AS n, avg(value) AS m, var_samp(value) AS v, count(*) AS rows FROM long GROUP BY ALL)"
T_STAT = "CASE WHEN a.n >= 2 AND b.n >= 2 AND a.v / a.n + b.v / b.n > 0 THEN (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) END"
T_DF = """CASE WHEN a.n >= 2 AND b.n >= 2 AND a.v / a.n + b.v / b.n > 0
  THEN pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) END"""
PAIR_TESTS = RUNS + [
    "mom AS (" + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, run, count({m}) AS n, avg({m}) AS m, var_samp({m}) AS v FROM runs GROUP BY run"
        for m in ("mean_abs_matrix", "stability_matrix_corr")
    ) + ")",
    f"""tests AS MATERIALIZED (SELECT a.metric, a.run AS run_a, b.run AS run_b, a.n AS n_a, b.n AS n_b, {T_STAT} AS t_stat, {T_DF} AS df,
  (a.m - b.m) / nullif(sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)), 0) AS cohens_d
  FROM mom a JOIN mom b ON a.metric = b.metric AND a.run < b.run WHERE a.n > 5 AND b.n > 5)""",
]
SEED = f"""SELECT scenario, metric, stat, count(*) AS count, avg(value) AS mean, stddev_pop(value) AS std, 1.96 * stddev_pop(value) / sqrt(count(*)) AS ci95
  FROM long GROUP BY ALL"""
RETURNS = RUNS + [
    """ret AS MATERIALIZED (SELECT run, end_ts, mean_abs_matrix / lag(mean_abs_matrix) OVER (PARTITION BY run ORDER BY end_ts) - 1 AS ret FROM runs)""",
    """growth AS (SELECT run, end_ts, ret, product(1 + ret) OVER (PARTITION BY run ORDER BY end_ts) AS cumulative FROM ret WHERE ret IS NOT NULL)""",
    """dd AS MATERIALIZED (SELECT *, cumulative / max(cumulative) OVER (PARTITION BY run ORDER BY end_ts) - 1 AS drawdown FROM growth)""",
]
RUN_MEANS = ", ".join(f"{r6(f'max(CASE WHEN metric = {chr(39)}{n}{chr(39)} THEN mean END)', 5)} AS {n}" for n in NAMES)

# ------------------------------------------------------------------ decisions

DECISION_LOG = """log AS (SELECT pos - 16 AS step, pos, ts, (pos * 7 + 3) % 9 AS action, 8 + (pos * 7 + 3) % 9 AS lookback FROM cal WHERE pos >= 16),
dec AS MATERIALIZED (
  SELECT step + 1 AS seq, step, pos, ts, action, lookback, coalesce(lag(lookback) OVER (ORDER BY step), 12) AS prev_lookback FROM log
  UNION ALL SELECT 0, 0, pos, ts, NULL, 12, 12 FROM log WHERE step = 0)"""
DECISION_WIN = "win AS MATERIALIZED (SELECT DISTINCT greatest(pos - lookback + 1, 0) AS start_pos, pos AS end_pos FROM dec)"
STATES = panel("brand_week") + [DECISION_LOG, DECISION_WIN, window_rows(), lagged(), correlations(), edges_at_lag(), REGIME,
    """cells AS MATERIALIZED (
  SELECT seq, asset_i AS asset, asset_j AS other, value AS v FROM edges e JOIN dec d ON d.pos = e.end_pos AND greatest(d.pos - d.lookback + 1, 0) = e.start_pos
  UNION ALL SELECT seq, asset_j, asset_i, -value FROM edges e JOIN dec d ON d.pos = e.end_pos AND greatest(d.pos - d.lookback + 1, 0) = e.start_pos)""",
    "scores AS MATERIALIZED (SELECT seq, asset, sum(v) AS s FROM cells GROUP BY ALL)",
    """measured AS MATERIALIZED (
  SELECT a.seq, mean_abs, max_abs, row_range, row_std, leader_score, laggard_score, coalesce(sm, 0) AS stability_matrix, coalesce(sr, 0) AS stability_rows
  FROM (SELECT seq, avg(abs(v)) AS mean_abs, max(abs(v)) AS max_abs FROM cells GROUP BY seq) a
  JOIN (SELECT seq, max(s) - min(s) AS row_range, stddev_pop(s) AS row_std, max(s) AS leader_score, min(s) AS laggard_score FROM scores GROUP BY seq) b USING (seq)
  LEFT JOIN (SELECT c.seq, corr(c.v, p.v) AS sm FROM cells c JOIN cells p ON p.seq = c.seq - 1 AND p.asset = c.asset AND p.other = c.other GROUP BY c.seq) m USING (seq)
  LEFT JOIN (SELECT c.seq, corr(c.s, p.s) AS sr FROM scores c JOIN scores p ON p.seq = c.seq - 1 AND p.asset = c.asset GROUP BY c.seq) q USING (seq))""",
    """states AS MATERIALIZED (
  SELECT d.seq, d.step, d.ts, d.action, d.lookback, d.prev_lookback, (d.lookback - 8) / 8.0 AS norm_lookback, m.*  EXCLUDE (seq),
         mean_abs - coalesce(lag(mean_abs) OVER (ORDER BY d.seq), 0) AS delta_mean, g.* EXCLUDE (start_pos, end_pos), leader_score - laggard_score AS spread,
         (d.lookback - d.prev_lookback) / 8.0 AS delta_norm, mean_abs AS ema_mean_abs
  FROM dec d JOIN measured m USING (seq) JOIN regime g ON g.end_pos = d.pos AND g.start_pos = greatest(d.pos - d.lookback + 1, 0))""",
]
FEATURES = ["norm_lookback", "mean_abs", "row_range", "stability_matrix", "stability_rows", "delta_mean", "returns_mean", "returns_vol",
            "cross_sectional_vol", "leader_score", "laggard_score", "spread", "delta_norm", "ema_mean_abs"]
SCORED = STATES + [
    """parts AS MATERIALIZED (SELECT *, 0.5 * mean_abs + 0.5 * row_range AS S, 0.5 * stability_matrix + 0.5 * stability_rows AS C,
  CASE WHEN lookback IN (8, 16) THEN 1.0 ELSE 0 END AS bound, abs(lookback - prev_lookback) AS jump FROM states WHERE seq > 0)""",
    """modern AS (SELECT *, bound + CASE WHEN jump > 10 THEN jump / 10.0 WHEN jump = 0 THEN 0.2 ELSE 0 END AS E,
  returns_mean / greatest(abs(returns_vol), 1e-6) AS Sharpe, abs(lookback - 12) / 8.0 / 0.5 AS LookbackPenalty FROM parts)""",
    """legacy AS MATERIALIZED (SELECT *, bound + CASE WHEN jump > 10 THEN jump / 10.0 WHEN jump = 0 THEN 0.05 ELSE 0 END AS E, abs(delta_mean) AS LookbackPenalty FROM parts)""",
]
LEGACY_REWARD = "S + 0.3 * C - 0.05 * E"

SIGNAL_WIN = "win AS MATERIALIZED (SELECT pos - n + 1 AS start_pos, pos AS end_pos, ts AS end_ts, n AS lookback FROM cal CROSS JOIN (SELECT unnest([8, 10, 12, 14, 16]) AS n) WHERE pos >= 16)"
SIGNALS = pearson_edges(win=SIGNAL_WIN) + [
    f"signals AS MATERIALIZED (SELECT w.end_ts, w.end_pos, w.lookback, avg(abs(value)) AS signal FROM edges e JOIN win w ON {same_window('e', 'w')} GROUP BY ALL)"
]
GREEDY = SIGNALS + [
    """walk AS (
  SELECT 15::BIGINT AS pos, 12::BIGINT AS lookback, NULL::DOUBLE AS signal
  UNION ALL
  SELECT w.pos + 1, b.best.lookback, b.best.signal FROM walk w, LATERAL (
    SELECT first(struct_pack(lookback := s.lookback::BIGINT, signal := s.signal) ORDER BY s.signal DESC, s.lookback) AS best FROM signals s
    WHERE s.end_pos = w.pos + 1 AND s.lookback IN (greatest(w.lookback - 2, 8), w.lookback, least(w.lookback + 2, 16))) b
  WHERE w.pos + 1 <= (SELECT max(end_pos) FROM signals))""",
]

ORDERS = """o AS (SELECT o_orderkey, o_orderdate AS ts, o_orderpriority AS asset, o_totalprice AS price FROM orders)"""
FINDINGS = ORDERS + """, cellsq AS (SELECT ts, asset, count(*) AS n, count(price) AS known FROM o GROUP BY ALL),
found AS (SELECT (SELECT max(n) > 1 FROM cellsq) AS duplicate_index,
  1 - (SELECT sum(known) FROM cellsq) / ((SELECT sum(n) FROM (SELECT max(n) AS n FROM cellsq GROUP BY ts)) * (SELECT count(DISTINCT asset) FROM o)) AS missing_ratio,
  coalesce((SELECT string_agg(asset, ',' ORDER BY asset) FROM (SELECT asset FROM o GROUP BY asset HAVING min(price) = max(price))), '') AS zero_variance_assets,
  NOT (SELECT coalesce(bool_or(ts < p), false) FROM (SELECT ts, lag(ts) OVER (ORDER BY o_orderkey) AS p FROM o)) AS monotonic_index)"""

EMA = WEEK + METRIC_CTES + [
    """raw AS MATERIALIZED (SELECT end_pos - 12 AS seq, mean_abs_matrix AS a, max_abs_matrix AS b, row_sum_range AS c, row_sum_std AS d,
  coalesce(stability_matrix_corr, 0) AS e, coalesce(stability_rowsum_corr, 0) AS f FROM metrics)""",
    """ema AS (SELECT seq, a, b, c, d, e, f FROM raw WHERE seq = 0
  UNION ALL SELECT r.seq, 0.3 * r.a + 0.7 * m.a, 0.3 * r.b + 0.7 * m.b, 0.3 * r.c + 0.7 * m.c, 0.3 * r.d + 0.7 * m.d, 0.3 * r.e + 0.7 * m.e, 0.3 * r.f + 0.7 * m.f
  FROM ema m JOIN raw r ON r.seq = m.seq + 1)""",
]

SNAPSHOT = ", ".join(f"{r6(f'coalesce(max(CASE WHEN other = {chr(39)}Brand#{i}{chr(39)} THEN v END), 0)')} AS \"Brand#{i}\"" for i in range(1, 26))
FEATURE_ROWS = """frows AS MATERIALIZED (
  SELECT start_pos, end_pos, 'sig_o' || o || '_' || asset_i || '_' || asset_j AS feature, value FROM edges CROSS JOIN (SELECT unnest([{orders}]) AS o))"""
SIZES = "sizes AS (SELECT feature, sum(abs(value)) / (SELECT count(*) FROM win) AS mean_abs, max(abs(value)) AS max_abs FROM frows GROUP BY feature)"

# ------------------------------------------------------------------ one matrix over the whole history

SHARED_ROWS = """shared AS MATERIALIZED (SELECT a.asset AS asset_i, b.asset AS asset_j, a.pos, a.price AS x, b.price AS y
  FROM ix a JOIN ix b ON a.pos = b.pos AND a.asset < b.asset)"""


def lead_of(ahead: str, behind: str) -> str:
    return f"CASE WHEN abs({ahead} - {behind}) <= 1e-10 THEN 0 ELSE sign({ahead} - {behind}) * greatest({ahead}, {behind}) END"


def single_matrix(lags: str, value: str, power: str = "{0}", ranked: bool = False) -> str:
    """f: x before y, g: y before x, at each lag in rows that both assets have."""
    over = "PARTITION BY asset_i, asset_j, l ORDER BY"
    rank = lambda c: f"rank() OVER ({over} {c}) + (count(*) OVER (PARTITION BY asset_i, asset_j, l, {c}) - 1) / 2.0 AS {c}"
    columns = ", ".join(rank(c) for c in ("x", "y", "x0", "y0")) if ranked else "x, y, x0, y0"
    return with_(panel("brand_day") + [SHARED_ROWS, f"""lagged AS MATERIALIZED (SELECT asset_i, asset_j, l, x, y, x0, y0 FROM (
  SELECT asset_i, asset_j, l, {power.format("x")} AS x, {power.format("y")} AS y, lag({power.format("x")}, l) OVER w AS x0, lag({power.format("y")}, l) OVER w AS y0
  FROM shared, (SELECT unnest([{lags}]) AS l) WINDOW w AS ({over} pos)) WHERE x0 IS NOT NULL)""",
        f"sides AS (SELECT asset_i, asset_j, l, coalesce(corr(x0, y), 0) AS f, coalesce(corr(y0, x), 0) AS g FROM (SELECT asset_i, asset_j, l, {columns} FROM lagged) GROUP BY asset_i, asset_j, l)"],
        f"""SELECT p.asset_i, p.asset_j, {r6('coalesce(v, 0)')} AS value
  FROM (SELECT x.asset AS asset_i, y.asset AS asset_j FROM (SELECT DISTINCT asset FROM ix) x JOIN (SELECT DISTINCT asset FROM ix) y ON x.asset < y.asset) p
  LEFT JOIN (SELECT asset_i, asset_j, {value} AS v FROM sides GROUP BY asset_i, asset_j) q ON p.asset_i = q.asset_i AND p.asset_j = q.asset_j""")


ORACLE = {
    "bars_weekly": with_(panel("brand_week"), f"SELECT {ts('ts')} AS ts, asset, {r6('price')} AS price FROM panel"),
    "bars_ohlc": with_([BRAND_PRICES], f"""SELECT {ts("date_trunc('week', ts)::TIMESTAMP")} AS ts, asset,
  {r6('first(price ORDER BY ts, l_orderkey, l_linenumber, price) + 1e-10')} AS open, {r6('max(price) + 1e-10')} AS high, {r6('min(price) + 1e-10')} AS low,
  {r6('last(price ORDER BY ts, l_orderkey, l_linenumber, price) + 1e-10')} AS close, {r6('median(price) + 1e-10')} AS median FROM brand_prices GROUP BY 1, 2"""),
    "bars_resampled": with_(panel("nation_day"), " UNION ALL ".join(
        f"SELECT {ts(chr(100) + 'ate_trunc(' + chr(39) + 'month' + chr(39) + ', ts)::TIMESTAMP')} AS ts, asset, {r6(e)} AS price, '{k}' AS kind FROM panel GROUP BY 1, 2"
        for k, e in (("open", "first(price ORDER BY ts)"), ("high", "max(price)"), ("low", "min(price)"), ("close", "last(price ORDER BY ts)")))),
    "panel_usable": with_(panel("brand_day"), """SELECT count(DISTINCT asset) AS asset_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM ix GROUP BY ts)) AS max_observed,
  count(DISTINCT asset) >= 2 AND (SELECT max(n) FROM (SELECT count(*) AS n FROM ix GROUP BY ts)) >= 2 AS usable FROM ix"""),
    "returns": with_(panel("brand_day"), f"SELECT {ts('ts')} AS ts, asset, prev_pos, {r6('ret')} AS ret FROM rt"),
    "limit_days": with_(panel("brand_week"), f"SELECT {ts('ts')} AS ts, asset, {r6('price')} AS price FROM ix WHERE pos < 120"),
    "before_date": with_(panel("nation_day"), f"SELECT {ts('ts')} AS ts, asset, {r6('price')} AS price FROM ix WHERE ts < TIMESTAMP '1998-01-01'"),
    "rolling_windows": with_(panel("brand_week"), f"""SELECT {ts('s.ts')} AS start_ts, {ts('c.ts')} AS end_ts, s.pos AS start_pos, c.pos AS end_pos,
  CASE WHEN c.pos >= 15 THEN c.pos - 3 END AS prev_end_pos FROM cal c JOIN cal s ON s.pos = c.pos - 11 WHERE c.pos >= 12 AND (c.pos - 12) % 3 = 0"""),
    "window_returns": with_(panel("brand_week") + [rolling(), window_rows()], f"SELECT end_pos, asset, k - 1 AS row, {r6('r')} AS ret FROM wr"),
    "universe_prev_month": with_(UNIVERSE_CTES, f"SELECT {ts('ts')} AS ts, array_to_string(symbols, ',') AS symbols FROM daily"),
    "universe_filtered": with_(UNIVERSE_CTES, f"SELECT {ts('ts')} AS ts, array_to_string(symbols, ',') AS symbols FROM universe"),
    "universe_exact": with_(UNIVERSE_CTES, f"""SELECT {ts('c.ts')} AS ts, coalesce(len(symbols), 0)::BIGINT AS n, coalesce(array_to_string(symbols, ','), '') AS symbols
  FROM cal c LEFT JOIN universe u ON u.ts = c.ts"""),
    "gated_ffill": with_(UNIVERSE_CTES + [MEMBER_ROWS, GATED], f"""SELECT {ts('ts')} AS ts, asset, {r6('price')} AS price, false AS filled FROM known
  UNION ALL SELECT {ts('ts')}, asset, {r6('price')}, true FROM filled"""),
    "universe_asof": with_(UNIVERSE_CTES + WEEK_W + [rolling(tag="w"), ASOF, MEMBERS],
        f"SELECT {ts('end_ts')} AS end_ts, string_agg(asset, ',' ORDER BY rank) AS symbols FROM members GROUP BY members.end_ts"),
    "universe_edges": with_(UNIVERSE_EDGES, EDGE_BODY.replace("JOIN win w", "JOIN winw w")),
    "ccf_lag_pearson": with_(WEEK, EDGE_BODY),
    "ccf_lag_sqpearson": with_(SQUARED, EDGE_BODY),
    "ccf_lag_spearman": with_(SPEARMAN, EDGE_BODY),
    "spearman_columns": with_(SPEARMAN, EDGE_BODY),
    "ccf_lag_kendall": with_(KENDALL, EDGE_BODY),
    "ccf_lag_mi": with_(MUTUAL, EDGE_BODY),
    "ccf_lag_dcor": with_(DISTANCE, EDGE_BODY),
    "ccf_auc": with_(AUC, EDGE_BODY),
    "ccf_max_lag": with_(MAXLAG, EDGE_BODY),
    "signature_levy": with_(signature(half=True), EDGE_BODY),
    "signature_by_std": with_(signature(STD), EDGE_BODY),
    "custom_measure": with_(panel("brand_week") + [rolling(), window_rows(), lagged(), correlations("1000 * covar_pop(xv, yv)"), edges_at_lag()], EDGE_BODY),
    "explicit_windows": with_(panel("brand_week") + [
        "asked AS (SELECT DISTINCT date_trunc('month', ts)::TIMESTAMP AS start_ts, (date_trunc('month', ts) + INTERVAL 3 MONTH)::TIMESTAMP AS end_ts FROM cal)",
        "win AS MATERIALIZED (SELECT a.start_ts, a.end_ts, min(pos) AS start_pos, max(pos) AS end_pos FROM asked a JOIN cal c ON c.ts BETWEEN a.start_ts AND a.end_ts GROUP BY ALL)",
        window_rows(), lagged(), correlations(), edges_at_lag()],
        f"SELECT {ts('w.start_ts')} AS start_ts, {ts('w.end_ts')} AS end_ts, asset_i, asset_j, {r6('value')} AS value FROM edges e JOIN win w ON {same_window('e', 'w')}"),
    "single_matrix": single_matrix("1", "sum(f - g)"),
    "single_matrix_auc": single_matrix("1, 2, 3, 4, 5", lead_of("sum(abs(f))", "sum(abs(g))") + " / (sum(abs(f)) + sum(abs(g)))"),
    "single_matrix_max_lag": single_matrix("1, 2, 3, 4, 5", lead_of("max(abs(f))", "max(abs(g))"), power="{0} * {0}"),
    "single_matrix_signature": with_(panel("brand_day") + [SHARED_ROWS], f"""SELECT asset_i, asset_j, {r6("sum((x - fx) * (ny - y) - (y - fy) * (nx - x)) / 2 / any_value(sx) / any_value(sy)")} AS value
  FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy, lead(x) OVER w AS nx, lead(y) OVER w AS ny,
               stddev_samp(x) OVER p AS sx, stddev_samp(y) OVER p AS sy FROM shared
        WINDOW w AS (PARTITION BY asset_i, asset_j ORDER BY pos), p AS (PARTITION BY asset_i, asset_j)) GROUP BY asset_i, asset_j"""),
    "single_matrix_spearman": single_matrix("1", "sum(f - g)", ranked=True),
    "matrix_snapshot": with_(WEEK + [CELLS], f"""SELECT {ts('w.end_ts')} AS end_ts, asset, {SNAPSHOT} FROM cells c JOIN win w ON {same_window('c', 'w')}
  WHERE w.end_pos IN ((SELECT min(end_pos) FROM win), (SELECT max(end_pos) FROM win)) GROUP BY w.end_ts, asset"""),
    "row_scores": with_(WEEK + [CELLS, SCORES], f"SELECT {ts('w.end_ts')} AS end_ts, asset, {r6('s')} AS score FROM scores c JOIN win w ON {same_window('c', 'w')}"),
    "row_scores_mean": with_(WEEK + [CELLS, SCORES], f"SELECT {ts('w.end_ts')} AS end_ts, asset, {r6('s / n')} AS score FROM scores c JOIN win w ON {same_window('c', 'w')}"),
    "roles": with_(WEEK + [CELLS, SCORES, "cutoff AS (SELECT start_pos, end_pos, quantile_cont(s, 0.8) AS hi, quantile_cont(s, 0.2) AS lo FROM scores WHERE s <> 0 GROUP BY ALL)"],
        " UNION ALL ".join(f"SELECT {ts('w.end_ts')} AS end_ts, '{role}' AS role, asset, {r6('s')} AS score FROM scores c JOIN cutoff q ON {same_window('c', 'q')} JOIN win w ON {same_window('c', 'w')} WHERE s <> 0 AND {cond}"
                           for role, cond in (("leader", "s > hi"), ("follower", "s < lo")))),
    "leaders_followers": with_(WEEK + [CELLS, SCORES, "cutoff AS MATERIALIZED (SELECT start_pos, end_pos, quantile_cont(s, 0.5) AS mid FROM scores WHERE s <> 0 GROUP BY start_pos, end_pos)",
        f"placed AS MATERIALIZED (SELECT c.start_pos, c.end_pos, asset, s > mid AS lead, row_number() OVER (PARTITION BY c.start_pos, c.end_pos, s > mid ORDER BY asset) AS rank FROM scores c JOIN cutoff q ON {same_window('c', 'q')} WHERE s <> 0 AND s <> mid)"],
        f"""SELECT {ts('w.end_ts')} AS end_ts, a.rank, a.asset AS leader, b.asset AS follower FROM (SELECT * FROM placed WHERE lead) a
        JOIN (SELECT * FROM placed WHERE NOT lead) b ON a.end_pos = b.end_pos AND a.rank = b.rank JOIN win w ON w.end_pos = a.end_pos"""),
    "metrics_timeseries": with_(WEEK + METRIC_CTES, f"SELECT {ts('end_ts')} AS end_ts, {METRIC_COLUMNS} FROM metrics m JOIN win w ON {same_window('m', 'w')}"),
    "summary": with_(WEEK + METRIC_CTES, "SELECT metric, " + ", ".join(f"{r6(s)} AS {s}" for s in ("mean", "median", "std", "max", "min")) + f" FROM ({summary_of('metrics')})"),
    "regime": with_(panel("brand_week") + [rolling(), window_rows(), REGIME], f"""SELECT {ts('w.end_ts')} AS end_ts, {r6('returns_mean', 8)} AS returns_mean, {r6('returns_vol', 8)} AS returns_vol,
  {r6('cross_sectional_vol', 8)} AS cross_sectional_vol, {r6('dispersion', 8)} AS dispersion FROM regime g JOIN win w ON {same_window('g', 'w')}"""),
    "sig_features": with_(signature() + [CELLS, SCORES], f"""SELECT {ts('w.end_ts')} AS end_ts, {r6('max(s)')} AS leader_score, {r6('min(s)')} AS laggard_score, {r6('max(s) - min(s)')} AS spread,
  {r6('any_value(top)')} AS top_pair FROM scores c JOIN win w ON {same_window('c', 'w')}
  JOIN (SELECT start_pos, end_pos, max(abs(value)) AS top FROM edges GROUP BY ALL) t ON {same_window('c', 't')} GROUP BY w.end_ts"""),
    "ema_metrics": with_(EMA, f"""SELECT {ts('w.end_ts')} AS end_ts, {r6('a')} AS mean_abs, {r6('b')} AS max_abs, {r6('c')} AS row_range, {r6('d')} AS row_std, {r6('e')} AS stability_matrix,
  {r6('f')} AS stability_rows, {r6('coalesce(a - lag(a) OVER (ORDER BY seq), 0)')} AS delta_mean, {r6('a')} AS ema_mean_abs FROM ema JOIN win w ON w.end_pos = seq + 12"""),
    "candidate_signals": with_(SIGNALS, f"SELECT {ts('end_ts')} AS end_ts, lookback::BIGINT AS lookback, {r6('signal')} AS signal FROM signals"),
    "adaptive_lookback": with_(GREEDY, f"SELECT {ts('c.ts')} AS end_ts, lookback, {r6('signal')} AS signal FROM walk w JOIN cal c ON c.pos = w.pos WHERE signal IS NOT NULL"),
    "action_path": with_(panel("brand_week") + ["log AS (SELECT pos AS step, ((pos * 5 + pos // 4) % 3)::BIGINT AS action FROM cal)",
        """walk AS (SELECT -1::BIGINT AS step, NULL::BIGINT AS action, 12::BIGINT AS lookback, NULL::BIGINT AS prev_lookback
  UNION ALL SELECT l.step, l.action, greatest(8, least(16, w.lookback + (l.action - 1) * 2)), w.lookback FROM walk w JOIN log l ON l.step = w.step + 1)"""],
        "SELECT 0::BIGINT AS run, step, action, lookback, prev_lookback FROM walk WHERE step >= 0"),
    "state_vectors": with_(STATES, f"SELECT seq, {ts('ts')} AS ts, lookback, " + ", ".join(f"{r6(f, 5)} AS {f}" for f in FEATURES) + " FROM states"),
    "rewards": with_(SCORED, f"SELECT {ts('ts')} AS ts, lookback, " + ", ".join(f"{r6(c, 5)} AS {c}" for c in ("S", "C", "E", "Sharpe", "LookbackPenalty"))
        + f", {r6('S + 0.3 * C - 0.1 * E + 0.2 * Sharpe - 0.2 * LookbackPenalty', 5)} AS reward FROM modern"),
    "legacy_reward": with_(SCORED, f"SELECT {ts('ts')} AS ts, lookback, " + ", ".join(f"{r6(c, 5)} AS {c}" for c in ("S", "C", "E", "LookbackPenalty"))
        + f", {r6(LEGACY_REWARD, 5)} AS reward FROM legacy"),
    "decision_history": with_(SCORED, f"SELECT {ts('ts')} AS date, lookback, {r6(LEGACY_REWARD, 5)} AS reward, {r6('delta_norm', 5)} AS delta_norm, "
        + ", ".join(f"{r6(c, 5)} AS metric_{c}" for c in ("mean_abs", "max_abs", "row_range", "row_std", "stability_matrix", "stability_rows", "delta_mean", "ema_mean_abs")) + ", "
        + ", ".join(f"{r6(c, 5)} AS regime_{c}" for c in ("returns_mean", "returns_vol", "cross_sectional_vol", "dispersion")) + ", "
        + ", ".join(f"{r6(c, 5)} AS signature_{c}" for c in ("leader_score", "laggard_score", "spread")) + f", {r6('max_abs', 5)} AS signature_top_pair FROM legacy"),
    "features_topk": with_(signature(half=True) + [FEATURE_ROWS.replace("{orders}", "2, 3"), SIZES],
        f"SELECT feature, {r6('mean_abs', 8)} AS mean_abs, {r6('max_abs', 8)} AS max_abs FROM sizes WHERE max_abs >= 0.001 ORDER BY sizes.mean_abs DESC, feature LIMIT 12"),
    "features_selected": with_(signature(half=True) + [FEATURE_ROWS.replace("{orders}", "2"), SIZES, "picked AS (SELECT feature FROM sizes ORDER BY mean_abs DESC, feature LIMIT 6)"],
        f"SELECT {ts('w.end_ts')} AS end_ts, feature, {r6('value', 8)} AS value FROM frows f SEMI JOIN picked p ON p.feature = f.feature JOIN win w ON {same_window('f', 'w')}"),
    "run_summaries": with_(SUMMARIES, "SELECT scenario, run, metric, " + ", ".join(f"{r6(s, 5)} AS {s}" for s in ("mean", "median", "std", "max", "min")) + " FROM summaries"),
    "seed_stats": with_(LONG, f"SELECT scenario, metric, stat, count, {r6('mean', 5)} AS mean, {r6('std', 5)} AS std, {r6('ci95', 5)} AS ci95 FROM ({SEED})"),
    "welch": with_(LONG + [MOMENTS], f"""SELECT a.metric, a.stat AS column, a.scenario AS scenario_a, b.scenario AS scenario_b, {r6('a.m', 4)} AS mean_a, {r6('b.m', 4)} AS mean_b,
  a.rows AS n_a, b.rows AS n_b, {r6(T_STAT, 4)} AS t_stat, {r6(T_DF, 4)} AS df FROM mom a JOIN mom b ON a.metric = b.metric AND a.stat = b.stat AND a.scenario < b.scenario"""),
    "cohens_d": with_(PAIR_TESTS, f"SELECT metric, run_a, run_b, n_a, n_b, {r6('t_stat', 4)} AS t_stat, {r6('df', 4)} AS df, {r6('cohens_d', 4)} AS cohens_d FROM tests"),
    "bh_qvalues": with_(PAIR_TESTS + ["given AS (SELECT metric, run_a, run_b, round(exp(-abs(t_stat) / 4), 4) AS p FROM tests)",
        "ranked AS (SELECT *, p * count(*) OVER (PARTITION BY metric) / row_number() OVER (PARTITION BY metric ORDER BY p, run_a, run_b) AS q0 FROM given)"],
        f"""SELECT metric, run_a, run_b, {r6('p')} AS p, {r6('min(q0) OVER (PARTITION BY metric ORDER BY p, run_a, run_b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS q_value FROM ranked"""),
    "run_pivot": with_(SUMMARIES, f"SELECT run, {RUN_MEANS} FROM summaries GROUP BY run"),
    "comparison_table": with_(SUMMARIES, "SELECT run, mean_abs_matrix, max_abs_matrix, row_sum_range, stability_matrix_corr, stability_rowsum_corr FROM (" + f"SELECT run, {RUN_MEANS} FROM summaries GROUP BY run)"),
    "logged_metrics": with_(SUMMARIES, "SELECT run, metric, count(*) * 5 AS columns, (sum(count(*)) OVER (PARTITION BY run) * 5)::BIGINT AS total FROM summaries GROUP BY run, metric"),
    "kpis": with_(RETURNS, f"""SELECT run, 'mean_abs_matrix_pct_change' AS returns_column, {r6('pow(product(1 + ret), 252.0 / count(*)) - 1', 4)} AS annualized_return,
  {r6('CASE WHEN stddev_samp(ret) > 0 THEN sqrt(252) * avg(ret) / stddev_samp(ret) END', 4)} AS sharpe_ratio, {r6('min(drawdown)', 4)} AS max_drawdown, count(*) AS num_points FROM dd GROUP BY run"""),
    "drawdown": with_(RETURNS, f"SELECT run, {ts('end_ts')} AS end_ts, {r6('ret', 5)} AS ret, {r6('cumulative', 5)} AS cumulative, {r6('drawdown', 5)} AS drawdown FROM dd"),
    "scenario_rank": with_(LONG, f"SELECT scenario, {r6('avg(value)', 5)} AS mean_mean FROM long WHERE metric = 'mean_abs_matrix' AND stat = 'mean' GROUP BY scenario"),
    "best_scenario": with_(LONG, f"""SELECT scenario, {r6('v', 5)} AS score FROM (SELECT scenario, avg(value) AS v FROM long WHERE metric = 'mean_abs_matrix' AND stat = 'mean' GROUP BY scenario)
  ORDER BY v DESC LIMIT 1"""),
    "key_metrics": with_(LONG, f"""SELECT scenario, list_position(['mean_abs_matrix', 'row_sum_std', 'row_sum_range', 'stability_matrix_corr'], metric)::BIGINT AS place, metric,
  {r6('avg(value)', 5)} AS mean, {r6('stddev_pop(value)', 5)} AS std FROM long
  WHERE stat = 'mean' AND metric IN ('mean_abs_matrix', 'row_sum_std', 'row_sum_range', 'stability_matrix_corr') GROUP BY scenario, metric"""),
    "quality": with_([FINDINGS], f"SELECT duplicate_index, {r6('missing_ratio')} AS missing_ratio, zero_variance_assets, monotonic_index FROM found"),
    "issues": with_([FINDINGS], """SELECT 'repeated_timestamp' AS code, NULL::VARCHAR AS asset, NULL::DOUBLE AS amount FROM found WHERE duplicate_index
  UNION ALL SELECT 'missing_share', NULL, round(missing_ratio, 6) FROM found WHERE missing_ratio > 0.01
  UNION ALL SELECT 'constant_asset', o_orderpriority, 0 FROM orders GROUP BY o_orderpriority HAVING min(o_totalprice) = max(o_totalprice)
  UNION ALL SELECT 'unordered_timestamps', NULL, NULL FROM found WHERE NOT monotonic_index"""),
    "manifest": with_(panel("brand_day"), f"""SELECT count(DISTINCT ts) AS row_count, count(DISTINCT asset) AS asset_count, string_agg(DISTINCT asset, ',' ORDER BY asset) AS columns,
  {ts('min(ts)')} AS start, {ts('max(ts)')} AS end, count(DISTINCT ts) * count(DISTINCT asset) - count(*) AS missing_values,
  (SELECT {r6('epoch(d)')} FROM (SELECT ts - lag(ts) OVER (ORDER BY ts) AS d FROM cal) WHERE d IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1) AS step_seconds FROM ix"""),
    "walk_forward": with_(WEEK + METRIC_CTES, " UNION ALL ".join(
        f"SELECT '{n}' AS metric, {r6(f'{n}::DOUBLE')} AS truncated, {r6(f'{n}::DOUBLE')} AS \"full\", 0.0::DOUBLE AS delta FROM metrics WHERE end_pos = 119" for n in NAMES)),
    "stream_bars": f"""SELECT {ts("time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')")} AS ts, event_type AS asset, {r6('avg(value + 1)')} AS price, count(*) AS observations
  FROM events GROUP BY 1, 2""",
}


def _on_universe(strict: bool) -> str:
    parts = UNIVERSE_EDGES + [c for c in METRIC_CTES]
    same = "CASE WHEN shared_cells = cells AND prev_cells = cells THEN {} END"
    columns = ", ".join(
        n if n == "n_assets" else f"{r6(same.format(n) if strict and n.startswith('stability') else n)} AS {n}" for n in NAMES
    )
    source = "(SELECT *, lag(cells) OVER (ORDER BY end_pos) AS prev_cells FROM metrics)"
    return with_(parts, f"SELECT {ts('w.end_ts')} AS end_ts, {columns} FROM {source} m JOIN winw w ON {same_window('m', 'w')}")


CHOSEN = [
    f"chosen AS MATERIALIZED (SELECT e.* FROM edges e JOIN walk w ON w.pos = e.end_pos AND e.end_pos - e.start_pos + 1 = w.lookback WHERE w.signal IS NOT NULL)",
    *[c.replace("FROM edges", "FROM chosen").replace("PARTITION BY end_pos - start_pos ORDER", "ORDER") for c in METRIC_CTES],
]
ORACLE["adaptive_metrics"] = with_(
    GREEDY + CHOSEN,
    f"SELECT {ts('c.ts')} AS end_ts, w.lookback, {r6('w.signal')} AS signal, {METRIC_COLUMNS} FROM metrics m JOIN walk w ON w.pos = m.end_pos JOIN cal c ON c.pos = w.pos",
)
ORACLE["metrics_common"] = _on_universe(False)
ORACLE["metrics_strict"] = _on_universe(True)
ORACLE["features_all"] = with_(signature(half=True) + [FEATURE_ROWS.replace("{orders}", "2")],
    f"SELECT {ts('w.end_ts')} AS end_ts, feature, {r6('value', 8)} AS value FROM frows f JOIN win w ON {same_window('f', 'w')}")
ORACLE["features_pca_invariants"] = with_(signature(half=True) + [FEATURE_ROWS.replace("{orders}", "2"), SIZES, "picked AS MATERIALIZED (SELECT feature FROM sizes ORDER BY mean_abs DESC, feature LIMIT 12)"],
    """SELECT count(DISTINCT end_pos) AS windows, (count(*) FILTER (WHERE stddev_pop > 0))::DOUBLE AS variance, 0.0::DOUBLE AS largest_mean, 0.0::DOUBLE AS largest_cross, 1::BIGINT AS sorted
  FROM (SELECT f.end_pos, stddev_pop(value) OVER (PARTITION BY f.feature) AS stddev_pop FROM frows f SEMI JOIN picked p ON p.feature = f.feature)""")
SEEDED = "run || '_seed' || regexp_extract(run, '([0-9]+)$', 1)"
ORACLE["runs_from_tree"] = with_(SUMMARIES, f"""SELECT {SEEDED} AS run, regexp_extract(run, '([0-9]+)$', 1)::BIGINT AS seed, metric, windows,
  {", ".join(f"{r6(s, 5)} AS {s}" for s in ("mean", "median", "std", "max", "min"))}
  FROM summaries JOIN (SELECT run, count(*) AS windows FROM runs GROUP BY run) USING (run)""")
ORACLE["run_appendix"] = with_(SUMMARIES, """SELECT CASE WHEN scenario = 'weekly' THEN 'weekly' ELSE 'n/a' END AS scenario, (regexp_extract(run, '([0-9]+)$', 1)::INT)::VARCHAR AS seed,
  'n/a' AS created_at, 'n/a' AS config_path, 'n/a' AS data_path, 'n/a' AS python_version, 'n/a' AS platform FROM (SELECT DISTINCT scenario, run FROM summaries)""")
ORACLE["artifact_findings"] = with_(SUMMARIES, f"""SELECT {SEEDED} AS run, CASE scenario WHEN 'weekly' THEN 'WARN' ELSE 'ERROR' END AS level,
  CASE scenario WHEN 'weekly' THEN 'no_value' ELSE 'no_file' END AS code, CASE scenario WHEN 'weekly' THEN 'git_commit' ELSE 'run_metadata.json' END AS subject
  FROM (SELECT DISTINCT scenario, run FROM summaries)""")
EVENT_LOG = [
    "kinds AS MATERIALIZED (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS action FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL))",
    """log AS MATERIALIZED (SELECT user_id AS episode, row_number() OVER w - 1 AS step, ts, coalesce(lag(value) OVER w, 0) AS last_value, coalesce(lag(action) OVER w, -1) AS last_action,
  coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9, 0) AS hours, action, value AS reward, row_number() OVER w = count(*) OVER (PARTITION BY user_id) AS done
  FROM events JOIN kinds USING (event_type) WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
]
ORACLE["episode_log"] = with_(EVENT_LOG, f"""SELECT episode::BIGINT AS episode, step::BIGINT AS step, {ts('ts')} AS ts, {r6('last_value::DOUBLE', 5)} AS last_value, {r6('last_action::DOUBLE', 5)} AS last_action,
  {r6('hours', 5)} AS hours, {r6('step::DOUBLE', 5)} AS steps, action::BIGINT AS action, {r6('reward', 5)} AS reward, done::INTEGER::BIGINT AS done FROM log""")
ORACLE["episode_totals"] = with_(EVENT_LOG, f"SELECT episode::BIGINT AS episode, {r6('sum(reward)', 4)} AS total_reward, count(*) AS steps FROM log GROUP BY episode")
ORACLE["offline_gap"] = with_(EVENT_LOG, f"""SELECT 'reward' AS metric, {r6('m', 4)} AS online_mean, {r6('t', 4)} AS offline_total_reward, {r6('m - t', 4)} AS performance_gap
  FROM (SELECT avg(reward) FILTER (WHERE done) AS m, sum(reward) AS t FROM log)""")
ORACLE["universe_pairs"] = with_(
    UNIVERSE_EDGES + [CELLS, SCORES,
        "cutoff AS MATERIALIZED (SELECT end_pos, quantile_cont(s, 0.5) AS mid FROM scores WHERE s <> 0 GROUP BY end_pos)",
        "listed_at AS MATERIALIZED (SELECT end_pos, asset, min(rank) AS place FROM members GROUP BY end_pos, asset)",
        """placed AS MATERIALIZED (SELECT c.end_pos, c.asset, s > mid AS lead, row_number() OVER (PARTITION BY c.end_pos, s > mid ORDER BY place) AS rank
  FROM scores c JOIN cutoff q ON c.end_pos = q.end_pos JOIN listed_at l ON l.end_pos = c.end_pos AND l.asset = c.asset WHERE s <> 0 AND s <> mid)"""],
    f"""SELECT {ts('w.end_ts')} AS end_ts, a.rank, a.asset AS leader, b.asset AS follower FROM (SELECT * FROM placed WHERE lead) a
  JOIN (SELECT * FROM placed WHERE NOT lead) b ON a.end_pos = b.end_pos AND a.rank = b.rank JOIN winw w ON w.end_pos = a.end_pos""",
)
ORACLE["transitions"] = with_(
    SCORED,
    "SELECT l.step, l.action, " + r6(LEGACY_REWARD.replace("S ", "l.S ").replace("* C", "* l.C").replace("* E", "* l.E"), 4) + " AS reward, l.lookback, "
    + ", ".join(f"{r6(f'p.{f}::FLOAT::DOUBLE', 4)} AS {f}" for f in FEATURES) + " FROM legacy l JOIN states p ON p.seq = l.seq - 1",
)


# ------------------------------------------------------------------ hashed choices


def hashed(*parts: str) -> str:
    """60 bits of the MD5 of the parts, joined by ``|``."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


ORACLE["random_control"] = with_(
    panel("brand_week") + [f"log AS (SELECT pos AS step, ts, {hashed(ts('ts'), '7')} % 9 AS action FROM cal WHERE pos >= 16)"],
    f"""SELECT 0::BIGINT AS run, step, {ts('ts')} AS ts, action, 8 + action AS lookback, coalesce(lag(8 + action) OVER (ORDER BY step), 12) AS prev_lookback FROM log""",
)

BOOT = LONG + [
    f"""ranks AS MATERIALIZED (SELECT scenario, metric, stat, value, row_number() OVER (PARTITION BY scenario, metric, stat ORDER BY {hashed('run')} % 256, run) - 1 AS rk,
  count(*) OVER (PARTITION BY scenario, metric, stat) AS n FROM long WHERE value IS NOT NULL)""",
    f"""drawn AS (SELECT scenario, metric, stat, b, {hashed('scenario', 'metric', 'stat', 'b', 'rk', '0')} % n AS rk
  FROM ranks CROSS JOIN (SELECT unnest(range(1, 2001)) AS b) WHERE n >= 2)""",
    """resampled AS (SELECT scenario, metric, stat, b, avg(value) AS m FROM drawn JOIN ranks USING (scenario, metric, stat, rk) GROUP BY ALL)""",
    """bounds AS (SELECT scenario, metric, stat, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM resampled GROUP BY ALL)""",
    """boot AS MATERIALIZED (SELECT scenario, metric, stat, coalesce(low, m) AS boot_low, coalesce(high, m) AS boot_high
  FROM (SELECT scenario, metric, stat, avg(value) AS m FROM ranks GROUP BY ALL) LEFT JOIN bounds USING (scenario, metric, stat))""",
    f"seeds AS MATERIALIZED (SELECT * FROM ({SEED}) LEFT JOIN boot USING (scenario, metric, stat))",
]


def wide(columns: tuple) -> str:
    return ", ".join(
        f"{r6(f'max(CASE WHEN stat = {chr(39)}{s}{chr(39)} THEN {c} END)', 5)} AS {s}_{c}" for s in ("mean", "median", "std", "max", "min") for c in columns
    )


KEY_NAMES = "('mean_abs_matrix', 'row_sum_std', 'row_sum_range', 'stability_matrix_corr')"
ORACLE["bootstrap_ci"] = with_(BOOT, f"SELECT scenario, metric, stat, {r6('boot_low', 5)} AS boot_low, {r6('boot_high', 5)} AS boot_high FROM boot")
ORACLE["stats_table"] = with_(
    BOOT, f"SELECT scenario, metric, max(count) AS count, {wide(('mean', 'std', 'ci95', 'boot_low', 'boot_high'))} FROM seeds GROUP BY scenario, metric"
)
ORACLE["significance_subset"] = with_(
    BOOT, f"SELECT scenario, metric, {wide(('boot_low', 'boot_high'))}, 'Bootstrap CI at 95%' AS note FROM seeds GROUP BY scenario, metric"
)
ORACLE["interval_lines"] = with_(
    BOOT,
    f"SELECT scenario, metric, printf('bootstrap 95%% CI [%.4f, %.4f]', boot_low, boot_high) AS line FROM boot WHERE stat = 'mean' AND metric IN {KEY_NAMES}",
)
ORACLE["run_overview"] = with_(
    SUMMARIES, "SELECT run, metric, " + ", ".join(f"printf('%.6g', {c}) AS {c}" for c in ("mean", "median", "max", "std")) + " FROM summaries"
)
ORACLE["stream_overview"] = ORACLE["run_overview"]
ORACLE["stream_ema"] = ORACLE["ema_metrics"]

# ------------------------------------------------------------------ tail of the t distribution


def tail(source: str) -> list:
    """``source`` with its two-sided p: with t = sqrt(df) tan(a) the density is cos(a)^(df - 1), summed by Simpson's rule from 0 to a."""
    return [
        f"angled AS MATERIALIZED (SELECT *, atan(abs(t_stat) / sqrt(df)) / 4000 AS h, row_number() OVER () AS test_no FROM {source})",
        """inner_part AS (SELECT test_no, sum(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(k * h), df - 1)) * any_value(h) / 3 AS area
  FROM angled CROSS JOIN (SELECT unnest(range(0, 4001)) AS k) WHERE df IS NOT NULL GROUP BY test_no)""",
        """tailed AS MATERIALIZED (SELECT a.*, 1 - area * 2 / sqrt(pi()) * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) AS p_value
  FROM angled a LEFT JOIN inner_part USING (test_no))""",
    ]


WELCH = LONG + [
    MOMENTS,
    f"""welch AS (SELECT a.metric, a.stat AS column, a.scenario AS scenario_a, b.scenario AS scenario_b, a.m AS mean_a, b.m AS mean_b, a.rows AS n_a, b.rows AS n_b,
  {T_STAT} AS t_stat, {T_DF} AS df FROM mom a JOIN mom b ON a.metric = b.metric AND a.stat = b.stat AND a.scenario < b.scenario)""",
    *tail("welch"),
]
TESTED = PAIR_TESTS + tail("tests") + [
    "steps AS (SELECT *, p_value * count(*) OVER (PARTITION BY metric) / row_number() OVER (PARTITION BY metric ORDER BY p_value, run_a, run_b) AS q0 FROM tailed)",
    """found AS MATERIALIZED (SELECT *, abs(cohens_d) AS abs_d,
  min(q0) OVER (PARTITION BY metric ORDER BY p_value, run_a, run_b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q_value FROM steps)""",
]
ORACLE["welch_p"] = with_(
    WELCH, 'SELECT metric, "column", scenario_a, scenario_b, n_a, n_b, ' + ", ".join(f"{r6(c, 4)} AS {c}" for c in ("mean_a", "mean_b", "t_stat", "df", "p_value")) + " FROM tailed"
)
ORACLE["welch_lines"] = with_(
    WELCH,
    """SELECT metric, "column", printf('Welch test (%s) %s vs %s: p=%.4f', "column", scenario_a, scenario_b, greatest(p_value, 0)) AS line FROM tailed WHERE p_value IS NOT NULL""",
)
PAIR_BODY = "SELECT metric, run_a, run_b, n_a, n_b, " + ", ".join(
    f"{r6(c, 4)} AS {c}" for c in ("t_stat", "df", "p_value", "cohens_d", "q_value", "abs_d")
) + " FROM found"
ORACLE["pair_tests"] = with_(TESTED, PAIR_BODY)
ORACLE["significant_pairs"] = with_(TESTED, PAIR_BODY + " WHERE q_value < 0.05")
RUN_NAMES = sorted(f"{s}_fixed_{n:02d}" for s in ("weekly", "six_hour") for n in (8, 12, 16))
ORACLE["p_matrix"] = with_(
    TESTED
    + ["""both_ways AS (SELECT run_a AS run, run_b AS other, p_value FROM found WHERE metric = 'mean_abs_matrix'
  UNION ALL SELECT run_b, run_a, p_value FROM found WHERE metric = 'mean_abs_matrix')"""],
    "SELECT run, " + ", ".join(f"{r6(f'max(CASE WHEN other = {chr(39)}{n}{chr(39)} THEN p_value END)')} AS {n}" for n in RUN_NAMES) + " FROM both_ways GROUP BY run",
)

# ------------------------------------------------------------------ placebo

PLACEBO = WEEK + METRIC_CTES + [
    f"shuffled AS MATERIALIZED (SELECT ts, row_number() OVER (ORDER BY {hashed(ts('ts'), '7')}, ts) - 1 AS pos FROM cal)",
    """spans AS (SELECT e.pos AS end_pos, s.ts AS start_ts, e.ts AS end_ts FROM shuffled e JOIN shuffled s ON s.pos = e.pos - 11 WHERE e.pos >= 12 AND s.ts <= e.ts)""",
    """dates AS MATERIALIZED (SELECT end_pos, c.ts, row_number() OVER (PARTITION BY end_pos ORDER BY c.pos) AS k, count(*) OVER (PARTITION BY end_pos) AS n
  FROM spans JOIN shuffled c ON c.ts BETWEEN start_ts AND spans.end_ts)""",
    """seen AS (SELECT end_pos, asset, k, CASE WHEN price > 0 AND before > 0 THEN ln(price / before) ELSE 0 END AS ret
  FROM (SELECT d.end_pos, i.asset, d.k, i.price, lag(i.price) OVER (PARTITION BY d.end_pos, i.asset ORDER BY d.k) AS before FROM dates d JOIN ix i ON i.ts = d.ts))""",
    """wrp AS MATERIALIZED (SELECT d.end_pos - 11 AS start_pos, d.end_pos, a.asset, d.k, d.n, coalesce(s.ret, 0.0) AS r
  FROM dates d CROSS JOIN (SELECT DISTINCT asset FROM ix) a LEFT JOIN seen s ON s.end_pos = d.end_pos AND s.asset = a.asset AND s.k = d.k)""",
    lagged(tag="p"), correlations(tag="p"), edges_at_lag("p"), *tagged_metrics("p"),
]
PROBED = ("stability_matrix_corr", "stability_rowsum_corr", "mean_abs_matrix", "row_sum_std")
ORACLE["placebo"] = with_(
    PLACEBO,
    " UNION ALL ".join(
        f"""SELECT '{m}_mean' AS metric, {r6('c')} AS control, {r6('p')} AS placebo, {r6('p - c')} AS delta
  FROM (SELECT avg({m}) FILTER (WHERE isfinite({m})) AS c FROM metrics), (SELECT avg({m}) FILTER (WHERE isfinite({m})) AS p FROM metricsp)"""
        for m in PROBED
    ),
)
