"""SQL of the label, evaluation, risk and cost queries."""

from __future__ import annotations

from strictpast.testbed.oracle import EY, MOM, PARTS, PRICES, oracle

PARTS["listings"] = """
SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 <> 0 THEN DATE '1992-01-01' + CAST(s_suppkey % 400 AS INTEGER) END AS listed,
       CASE WHEN s_suppkey % 5 = 0 THEN DATE '1996-06-28' END AS delisted
FROM supplier
UNION ALL SELECT 'S' || s_suppkey, DATE '1997-01-06', NULL FROM supplier WHERE s_suppkey % 10 = 0"""


def _labels(name: str, horizons: tuple[int, ...], listed: bool) -> None:
    within = """AND EXISTS (SELECT 1 FROM listings l WHERE l.ticker = s.ticker AND (listed IS NULL OR listed <= s.date)
        AND (delisted IS NULL OR label_end < delisted))""" if listed else ""
    spans = " UNION ALL ".join(
        f"""SELECT date, ticker, {h} AS horizon, lead(date, {h}) OVER w AS label_end, lead(adj_close, {h}) OVER w / adj_close - 1 AS r
    FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
        for h in horizons
    )
    PARTS[name] = f"""
SELECT * FROM ({spans}) s WHERE label_end IS NOT NULL {within}"""


_labels("listed_labels", (1, 5, 21), True)
_labels("decay_labels", (1, 2, 3, 5, 7), False)
_labels("month_labels", (21,), False)

oracle(
    "forward_returns",
    f"{PRICES} listings listed_labels",
    """SELECT l.date, ticker, CAST(l.horizon AS INTEGER) AS horizon, label_end, round(r, 9) AS forward_return,
       round(least(greatest(r, lo), hi), 9) AS winsorized_return
FROM listed_labels l JOIN (SELECT date, horizon, quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi
                           FROM listed_labels GROUP BY date, horizon) q ON q.date = l.date AND q.horizon = l.horizon""",
)

_RANGES = """(VALUES (13, 13, 'Energy', 1), (10, 14, 'Materials', 2), (24, 32, 'Materials', 3), (15, 17, 'Industrials', 4),
    (33, 39, 'Industrials', 5), (40, 47, 'Industrials', 6), (50, 59, 'Consumer Discretionary', 7), (20, 21, 'Consumer Staples', 8),
    (54, 54, 'Consumer Staples', 9), (28, 28, 'Health Care', 10), (80, 80, 'Health Care', 11), (60, 67, 'Financials', 12),
    (35, 36, 'Information Technology', 13), (73, 73, 'Information Technology', 14), (48, 48, 'Communication Services', 15),
    (78, 79, 'Communication Services', 16), (49, 49, 'Utilities', 17)) r(low, high, sector, place)"""
oracle(
    "sector_proxy",
    "metadata",
    f"""SELECT ticker, cik, sic_code, coalesce((SELECT sector FROM {_RANGES}
       WHERE length(trim(sic_code)) >= 2 AND TRY_CAST(left(trim(sic_code), 2) AS INTEGER) BETWEEN low AND high
       ORDER BY high - low, place LIMIT 1), 'Unknown') AS sector_proxy
FROM (SELECT ticker, cik, CASE WHEN cik % 50 = 0 THEN NULL WHEN cik % 41 = 0 THEN '7'
             ELSE ' ' || lpad(CAST(cik * 37 % 9000 + 100 AS VARCHAR), 4, '0') END AS sic_code FROM metadata)""",
)

# --- information coefficients -------------------------------------------------------------------

PARTS["factor_values"] = """
SELECT date, ticker, 'mom_12_1' AS factor_name, mom AS v FROM flags
UNION ALL SELECT date, ticker, 'earnings_yield', v FROM ey_clipped"""
PARTS["coefficients"] = """
SELECT factor_name, horizon, date, count(*) AS rows,
       CASE WHEN max(rx) > min(rx) AND max(ry) > min(ry) THEN corr(rx, ry) END AS ic
FROM (SELECT f.factor_name, l.horizon, f.date,
             rank() OVER (PARTITION BY f.factor_name, l.horizon, f.date ORDER BY v)
             + (count(*) OVER (PARTITION BY f.factor_name, l.horizon, f.date, v) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY f.factor_name, l.horizon, f.date ORDER BY r)
             + (count(*) OVER (PARTITION BY f.factor_name, l.horizon, f.date, r) - 1) / 2 AS ry
      FROM factor_values f JOIN decay_labels l ON l.date = f.date AND l.ticker = f.ticker WHERE v IS NOT NULL)
GROUP BY ALL HAVING count(*) >= 3"""
_IC = f"{EY} decay_labels factor_values coefficients"


def _summary(by: str) -> str:
    """Pairs of coefficients up to ``horizon`` apart, weighted; one of a pair of zero is the variance."""
    return f"""
WITH placed AS (
  SELECT *, ic - avg(ic) OVER g AS d, row_number() OVER (PARTITION BY {by} ORDER BY date) AS k
  FROM (SELECT *, CAST(year(date) AS INTEGER) AS run FROM coefficients WHERE ic IS NOT NULL) WINDOW g AS (PARTITION BY {by})),
pairs AS (
  SELECT {", ".join(f"a.{c.strip()}" for c in by.split(","))},
         sum(a.d * b.d * CASE WHEN a.k = b.k THEN 1 ELSE 2 * (1 - (a.k - b.k) / (a.horizon + 1)) END) AS q
  FROM placed a JOIN placed b ON {" AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in by.split(","))} AND b.k BETWEEN a.k - a.horizon AND a.k
  GROUP BY ALL)
SELECT {", ".join(f"p.{c.strip()}" for c in by.split(","))}, count(*) AS dates, avg(ic) AS mean_ic, stddev_samp(ic) AS sd_ic,
       CASE WHEN any_value(q) > 1e-18 AND count(*) > 1 THEN avg(ic) * count(*) / sqrt(any_value(q)) END AS t_hac
FROM placed p JOIN pairs USING ({by}) GROUP BY {by}"""


PARTS["ic_summaries"] = _summary("factor_name, horizon")
PARTS["ic_yearly"] = _summary("run, factor_name, horizon")

oracle(
    "ic_by_date",
    _IC,
    "SELECT factor_name, CAST(horizon AS INTEGER) AS horizon, date, rows, round(ic, 9) AS ic FROM coefficients",
)
oracle(
    "ic_summary",
    f"{_IC} ic_summaries",
    """SELECT factor_name, CAST(horizon AS INTEGER) AS horizon, dates, round(mean_ic, 8) AS mean_ic, round(sd_ic, 8) AS sd_ic,
       round(t_hac, 8) AS t_hac FROM ic_summaries""",
)
oracle(
    "decay_gate",
    f"{_IC} ic_summaries",
    """SELECT *, fades OR flips AS retire FROM (
  SELECT a.factor_name, round(a.t_hac, 8) AS t_near, round(b.t_hac, 8) AS t_middle,
         coalesce(abs(a.t_hac) > 3.0 AND abs(b.t_hac) < 1.5, false) AS fades, coalesce(a.mean_ic * c.mean_ic < 0, false) AS flips
  FROM ic_summaries a LEFT JOIN ic_summaries b ON b.factor_name = a.factor_name AND b.horizon = 3
       LEFT JOIN ic_summaries c ON c.factor_name = a.factor_name AND c.horizon = 5 WHERE a.horizon = 1)""",
)
# The tail of the normal density by Simpson's rule.
PARTS["tested"] = """
SELECT run, factor_name, horizon, t_hac AS t, CASE WHEN t_hac IS NULL THEN NULL ELSE (
         SELECT sum(exp(-0.5 * (abs(t_hac) + i * 0.004) * (abs(t_hac) + i * 0.004)) * CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
         FROM range(0, 3001) s(i)) * 0.004 / 3 * 2 / sqrt(2 * pi()) END AS p
FROM ic_yearly"""
PARTS["adjusted"] = """
SELECT *, CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY run, p IS NULL ORDER BY p DESC)) END AS p_adjusted
FROM (SELECT *, count(p) OVER (PARTITION BY run) * p / count(p) OVER (PARTITION BY run ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM tested)"""
oracle(
    "fdr_gate",
    f"{_IC} ic_yearly tested adjusted",
    """SELECT run, factor_name, CAST(horizon AS INTEGER) AS horizon, round(t, 7) AS t, round(p, 7) AS p, round(p_adjusted, 7) AS p_adjusted,
       coalesce(d, 'held') AS decision,
       coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY factor_name, horizon ORDER BY run ROWS UNBOUNDED PRECEDING), 'held') AS state
FROM (SELECT *, CASE WHEN abs(t) >= 3 AND p_adjusted <= 0.1 THEN 'promoted' WHEN abs(t) < 1.5 THEN 'retired' END AS d FROM adjusted)""",
)

# --- folds ------------------------------------------------------------------------------------

PARTS["numbered"] = "SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS n FROM (SELECT DISTINCT date FROM bars)"
PARTS["folds"] = """
SELECT CAST(n // 252 AS INTEGER) AS fold, min(date) AS test_start, max(date) AS test_end, min(n) AS first_day, max(n) AS last_day,
       CAST(min(n) - 5 AS INTEGER) AS guard_from, CAST(max(n) + 5 AS INTEGER) AS guard_to
FROM numbered WHERE n >= 252 GROUP BY 1"""
PARTS["placed_labels"] = """
SELECT l.date, ticker, horizon, a.n AS a, b.n AS b, CAST(a.n // 252 AS INTEGER) AS block
FROM month_labels l JOIN numbered a ON a.date = l.date JOIN numbered b ON b.date = l.label_end"""
PARTS["fold_roles"] = """
SELECT date, ticker, CAST(horizon AS INTEGER) AS horizon, CASE WHEN block > 0 THEN block END AS test_fold,
       CAST(coalesce(max(fold), block) + 1 AS INTEGER) AS train_from, min(fold) AS purged_from
FROM placed_labels LEFT JOIN folds ON fold > block AND a <= guard_to AND b >= guard_from
GROUP BY date, ticker, horizon, block"""
_FOLDS = f"{PRICES} numbered folds month_labels placed_labels fold_roles"
oracle("cv_folds", f"{PRICES} numbered folds", "SELECT * FROM folds")
oracle("fold_membership", _FOLDS, "SELECT * FROM fold_roles")
# Counted from the definition: a training label's span and the guarded days have no day in common.
oracle(
    "fold_counts",
    _FOLDS,
    """SELECT fold, CAST(horizon AS INTEGER) AS horizon, CAST(sum(CASE WHEN block = fold THEN 1 ELSE 0 END) AS BIGINT) AS test_rows,
       CAST(sum(CASE WHEN block < fold AND NOT touches THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN block < fold AND touches THEN 1 ELSE 0 END) AS BIGINT) AS purged_rows
FROM (SELECT *, a <= guard_to AND b >= guard_from AS touches FROM placed_labels, folds) WHERE block <= fold GROUP BY fold, horizon""",
)

# --- risk model ---------------------------------------------------------------------------------

STYLES = ("size", "momentum", "earnings_yield")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
FACTORS = ("market", *STYLES, *REGIONS)
PARTS["style_rows"] = """
SELECT f.date, f.ticker, adj_close, mcap, CASE WHEN mcap > 0 THEN ln(mcap) END AS size, mom AS momentum, e.v AS earnings_yield, r_name AS sector
FROM flags f JOIN ey_clipped e ON e.date = f.date AND e.ticker = f.ticker
JOIN supplier ON 'S' || s_suppkey = f.ticker JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"""
PARTS["style_clipped"] = "SELECT date, ticker, adj_close, mcap, sector, " + ", ".join(
    f"CASE WHEN {s} IS NOT NULL THEN least(greatest({s}, avg({s}) OVER d - 3 * stddev_pop({s}) OVER d), avg({s}) OVER d + 3 * stddev_pop({s}) OVER d) END AS {s}"
    for s in STYLES
) + " FROM style_rows WINDOW d AS (PARTITION BY date)"
PARTS["style_scores"] = "SELECT date, ticker, adj_close, mcap, sector, " + ", ".join(
    f"coalesce(CASE WHEN stddev_pop({s}) OVER d > 1e-12 * greatest(abs(avg({s}) OVER d), 1e-12) THEN ({s} - avg({s}) OVER d) / stddev_pop({s}) OVER d END, 0.0::DOUBLE) AS {s}"
    for s in STYLES
) + " FROM style_clipped WINDOW d AS (PARTITION BY date)"
PARTS["risk_rows"] = f"""
SELECT date, ticker, adj_close / lag(adj_close) OVER w - 1 AS ret, lag(sector) OVER w AS sector, lag(mcap) OVER w AS mcap,
       {", ".join(f"lag({s}) OVER w AS {s}" for s in STYLES)}
FROM style_scores WINDOW w AS (PARTITION BY ticker ORDER BY date)"""
PARTS["design"] = " UNION ALL ".join(
    f"SELECT date, ticker, ret, sqrt(mcap) AS w, {i} AS i, {x} AS x FROM risk_rows WHERE ret IS NOT NULL AND mcap > 0"
    for i, x in enumerate(["1.0::DOUBLE", *STYLES, *(f"CASE WHEN sector = '{r}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for r in REGIONS)])
)
_P = len(FACTORS)
PARTS["step0"] = f"""
SELECT a.date, a.i, b.i AS j, sum(a.w * a.x * b.x) AS v, sum(a.w * a.x * b.x) AS v0 FROM design a JOIN design b ON b.date = a.date AND b.ticker = a.ticker GROUP BY ALL
UNION ALL SELECT date, i, {_P}, sum(w * x * ret), 0 FROM design GROUP BY ALL"""
for _k in range(_P):
    PARTS[f"step{_k + 1}"] = f"""
SELECT date, i, j, v0, CASE WHEN head > 1e-9 * was THEN CASE WHEN i = {_k} THEN v / head ELSE v - side * across / head END
                            WHEN i = {_k} THEN 0 ELSE v END AS v
FROM (SELECT *, max(CASE WHEN i = {_k} AND j = {_k} THEN v END) OVER (PARTITION BY date) AS head,
             max(CASE WHEN i = {_k} AND j = {_k} THEN v0 END) OVER (PARTITION BY date) AS was,
             max(CASE WHEN j = {_k} THEN v END) OVER (PARTITION BY date, i) AS side,
             max(CASE WHEN i = {_k} THEN v END) OVER (PARTITION BY date, j) AS across FROM step{_k})"""
PARTS["fit_rows"] = "SELECT date, count(*) AS rows, avg(ret) AS plain FROM design WHERE i = 0 GROUP BY date"
PARTS["factor_coefficients"] = f"""
SELECT s.date, s.i, [{", ".join(f"'{f}'" for f in FACTORS)}][s.i + 1] AS factor,
       CASE WHEN rows > {_P} AND max(CASE WHEN j = i THEN v END) > 0.5 THEN max(CASE WHEN j = {_P} THEN v END) END AS value
FROM step{_P} s JOIN fit_rows USING (date) GROUP BY s.date, s.i, rows"""
PARTS["fitted"] = """
SELECT d.date, d.ticker, any_value(d.ret) AS ret, any_value(d.w) AS w, sum(d.x * coalesce(value, 0)) AS fit, count(value) > 0 AS known
FROM (SELECT date, ticker, ret, w, i, x FROM design) d JOIN factor_coefficients c ON c.date = d.date AND c.i = d.i GROUP BY d.date, d.ticker"""
_STEPS = " ".join(f"step{k}" for k in range(_P + 1))
_RISK = f"{EY} style_rows style_clipped style_scores risk_rows design {_STEPS} fit_rows factor_coefficients"
# Residuals exist for every row of a fitted day, those without a usable weight included.
PARTS["leftover"] = f"""
SELECT r.date, r.ticker, CASE WHEN n > 0 THEN ret - fit END AS residual
FROM (SELECT r.date, r.ticker, any_value(r.ret) AS ret, count(c.value) AS n,
             sum(coalesce(c.value, 0) * CASE c.factor WHEN 'market' THEN 1 {" ".join(f"WHEN '{s}' THEN {s}" for s in STYLES)} ELSE CASE WHEN sector = c.factor THEN 1 ELSE 0 END END) AS fit
      FROM risk_rows r JOIN factor_coefficients c ON c.date = r.date GROUP BY r.date, r.ticker) r"""
PARTS["fits"] = """
SELECT f.date, any_value(rows) AS rows,
       CASE WHEN bool_or(known) AND sum(w * (ret - m) ** 2) > 0 THEN 1 - sum(w * (ret - fit) ** 2) / sum(w * (ret - m) ** 2) END AS r2
FROM fitted f JOIN fit_rows r ON r.date = f.date JOIN (SELECT date, sum(w * ret) / sum(w) AS m FROM fitted GROUP BY date) a ON a.date = f.date GROUP BY f.date"""

oracle("risk_regression", _RISK, "SELECT date, factor, round(value, 6) AS value FROM factor_coefficients")
oracle("risk_fit", f"{_RISK} fitted fits", "SELECT date, rows, round(r2, 6) AS r2 FROM fits")
oracle("risk_residuals", f"{_RISK} leftover", "SELECT date, ticker, round(residual, 6) AS residual FROM leftover")
oracle(
    "risk_acceptance",
    f"{_RISK} fitted fits leftover",
    """SELECT round((SELECT avg(r2) FROM fits), 6) AS mean_r2, round(corr(residual, before), 6) AS residual_acf
FROM (SELECT residual, lag(residual) OVER (PARTITION BY ticker ORDER BY date) AS before FROM leftover)""",
)
PARTS["return_days"] = "SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM factor_coefficients)"
PARTS["return_pairs"] = """
SELECT n, a.date, a.factor AS factor_a, b.factor AS factor_b, a.value * b.value AS product
FROM factor_coefficients a JOIN factor_coefficients b ON b.date = a.date AND b.factor >= a.factor AND b.value IS NOT NULL
JOIN return_days d ON d.date = a.date WHERE a.value IS NOT NULL"""
PARTS["pair_names"] = "SELECT DISTINCT factor_a, factor_b FROM return_pairs"
# Day after day: yesterday's sums, faded by one day, plus today's product.
oracle(
    "risk_covariance",
    f"{_RISK} return_days return_pairs pair_names",
    """SELECT p.date, p.factor_a, p.factor_b, round(s / w, 7) AS covariance FROM (
  WITH RECURSIVE faded AS (
    SELECT CAST(-1 AS BIGINT) AS n, factor_a, factor_b, 0.0::DOUBLE AS s, 0.0::DOUBLE AS w FROM pair_names
    UNION ALL
    SELECT f.n + 1, f.factor_a, f.factor_b, f.s * 0.5::DOUBLE ** (1 / 90) + coalesce(p.product, 0),
           f.w * 0.5::DOUBLE ** (1 / 90) + CASE WHEN p.product IS NULL THEN 0 ELSE 1 END
    FROM faded f LEFT JOIN return_pairs p ON p.n = f.n + 1 AND p.factor_a = f.factor_a AND p.factor_b = f.factor_b
    WHERE f.n < (SELECT max(n) FROM return_days))
  SELECT * FROM faded) f JOIN return_pairs p ON p.n = f.n AND p.factor_a = f.factor_a AND p.factor_b = f.factor_b""",
)
oracle(
    "specific_variance",
    f"{_RISK} leftover",
    """SELECT date, ticker, round(sum(residual ** 2 * 2.0::DOUBLE ** (n / 60)) OVER w / sum(2.0::DOUBLE ** (n / 60)) OVER w, 6) AS variance
FROM (SELECT l.*, n FROM leftover l JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM leftover)) USING (date)
      WHERE residual IS NOT NULL) WINDOW w AS (PARTITION BY ticker ORDER BY n ROWS UNBOUNDED PRECEDING)""",
)

# --- costs --------------------------------------------------------------------------------------

PARTS["volumes"] = """
SELECT date, ticker, avg(volume * raw_close) OVER (PARTITION BY ticker ORDER BY date ROWS 20 PRECEDING) AS adv FROM bars"""
# The level at which the capped shares add up to one: of all candidate levels the one that does.
PARTS["levels"] = """
WITH rows AS (
  SELECT m.date, m.ticker, greatest(zscore_value, 0.0::DOUBLE) AS raw, least(0.2::DOUBLE, 0.05::DOUBLE * adv / 19997.0::DOUBLE) AS cap
  FROM mom_12_1 m JOIN volumes v ON v.date = m.date AND v.ticker = m.ticker),
candidates AS (
  SELECT *, (1 - coalesce(sum(cap) OVER before, 0)) / sum(raw) OVER rest AS level FROM rows WHERE raw > 0
  WINDOW before AS (PARTITION BY date ORDER BY cap / raw, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (PARTITION BY date ORDER BY cap / raw, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT r.*, c.level FROM rows r LEFT JOIN (
  SELECT date, arg_min(level, cap / raw) AS level FROM candidates WHERE level <= cap / raw GROUP BY date) c ON c.date = r.date"""
oracle(
    "capped_weights",
    f"{MOM} volumes levels",
    """SELECT date, ticker, round(raw, 8) AS raw, round(cap, 8) AS cap, round(CASE WHEN raw > 0 THEN least(cap, coalesce(level, 1e300) * raw) ELSE 0 END, 8) AS weight
FROM levels""",
)
PARTS["book"] = """
SELECT date, ticker, weight, weight - coalesce(lag(weight) OVER (PARTITION BY ticker ORDER BY date), 0) AS trade, CAST(ticker[2:] AS BIGINT) % 5 = 0 AS known
FROM (SELECT date, ticker, zscore_value / sum(abs(zscore_value)) OVER (PARTITION BY date) AS weight FROM mom_12_1 WHERE zscore_value IS NOT NULL)"""
PARTS["tiers"] = """
SELECT b.date, ticker, mcap >= hi AS large, mcap < lo AS small
FROM bars b JOIN (SELECT date, quantile_cont(mcap, 0.2) AS lo, quantile_cont(mcap, 0.8) AS hi FROM bars GROUP BY date) q ON q.date = b.date"""
oracle(
    "trade_costs",
    f"{MOM} volumes book tiers",
    """SELECT date, ticker, round(trade, 9) AS trade, round(spread, 9) AS spread_cost, round(impact, 9) AS impact_cost, round(borrow, 9) AS borrow_cost,
       round(spread + impact + borrow, 9) AS cost, round(0.0003 * abs(trade), 9) AS flat_cost
FROM (SELECT b.date, b.ticker, trade, abs(trade) * CASE WHEN known THEN 0.001 WHEN large THEN 0.0002 ELSE 0.0005 END AS spread,
             CASE WHEN trade = 0 THEN 0 WHEN adv > 0 THEN 0.1 * (abs(trade) * 19997 / adv) ** 1.5 END AS impact,
             CASE WHEN large THEN 0.0025 WHEN small THEN 0.05 ELSE 0.015 END * greatest(-weight, 0) / 252 AS borrow
      FROM book b JOIN volumes v ON v.date = b.date AND v.ticker = b.ticker JOIN tiers t ON t.date = b.date AND t.ticker = b.ticker)""",
)
