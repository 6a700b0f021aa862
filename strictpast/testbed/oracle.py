"""The testbed queries as plain SQL over the same tables, written independently of the jobs."""

from __future__ import annotations

# Named subqueries; a query lists the ones it needs and they are included in this order.
PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}

PARTS["trade_days"] = """
SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)
                * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS net
FROM lineitem GROUP BY 1, 2"""

PARTS["kept_days"] = """
SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date,
       CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2"""

PARTS["adj_feed"] = """
SELECT 'S' || k AS ticker, date, CAST(net AS DOUBLE) / CAST(qty AS DOUBLE) / 10000.0::DOUBLE AS close
FROM trade_days"""

PARTS["raw_feed"] = """
SELECT 'S' || k AS ticker, date, CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) / 100.0::DOUBLE AS close,
       CAST(qty AS DOUBLE) AS volume
FROM kept_days"""

PARTS["details"] = """
SELECT 'S' || s_suppkey AS ticker,
       CASE n_regionkey WHEN 0 THEN 'NYSE' WHEN 1 THEN 'AMEX' WHEN 2 THEN 'NASDAQ' WHEN 3 THEN NULL
            ELSE 'NYSE' END AS exchange,
       CASE WHEN s_suppkey % 11 = 0 THEN 'PFD' WHEN s_suppkey % 13 = 0 THEN 'OTHER'
            WHEN s_suppkey % 17 = 0 THEN 'OTHER' ELSE 'CS' END AS ticker_type,
       CASE WHEN s_suppkey % 19 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END AS shares_out
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

PARTS["bars"] = """
SELECT date, d.ticker, exchange, ticker_type, ticker_type = 'CS' AS is_common_share,
       CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) / 100.0::DOUBLE AS raw_close,
       CAST(net AS DOUBLE) / CAST(qty AS DOUBLE) / 10000.0::DOUBLE AS adj_close,
       CAST(qty AS DOUBLE) AS volume, shares_out,
       CAST(cents AS DOUBLE) / CAST(qty AS DOUBLE) / 100.0::DOUBLE * shares_out AS mcap
FROM trade_days JOIN details d ON d.ticker = 'S' || k"""

PARTS["flags"] = """
SELECT *,
       CASE WHEN NOT common_share_ok THEN 'share_class_not_common'
            WHEN NOT exchange_ok THEN 'exchange_not_allowed'
            WHEN NOT history_ok THEN 'insufficient_history'
            WHEN NOT price_ok THEN 'price_below_floor' END AS fail_reason
FROM (SELECT *, ticker_type = 'CS' AS common_share_ok,
             coalesce(exchange IN ('NYSE', 'AMEX', 'NASDAQ'), false) AS exchange_ok,
             (SELECT 0) + row_number() OVER w > 252 AS history_ok,
             coalesce(lag(raw_close) OVER w >= 2000.0, false) AS price_ok,
             ln(adj_close) - ln(lag(adj_close) OVER w) AS ret_1d,
             ln(lag(adj_close, 21) OVER w) - ln(lag(adj_close, 252) OVER w) AS mom
      FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))"""


def _factor(name: str, raw: str, raw_values: str, default: str) -> None:
    """The shared factor tail: clip to 1%/99%, standardize, flag."""
    PARTS[f"{raw}_clipped"] = f"""
SELECT r.*, CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END AS w
FROM ({raw_values}) r
LEFT JOIN (SELECT date, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi
           FROM ({raw_values}) WHERE v IS NOT NULL GROUP BY date) b ON b.date = r.date"""
    PARTS[name] = f"""
SELECT c.date, ticker, '{name}' AS factor_name, v AS raw_value, w AS winsorized_value, z AS zscore_value,
       valid AS valid_flag, valid AND eligible AS tradable_flag,
       CASE WHEN reason IS NOT NULL THEN reason WHEN NOT valid THEN '{default}' END AS invalid_reason
FROM (SELECT *, reason IS NULL AND v IS NOT NULL AND w IS NOT NULL AND z IS NOT NULL AS valid
      FROM (SELECT x.*, CASE WHEN s > 0 THEN (w - m) / s END AS z
            FROM {raw}_clipped x
            LEFT JOIN (SELECT date AS d, avg(w) AS m, stddev_pop(w) AS s
                       FROM {raw}_clipped WHERE w IS NOT NULL GROUP BY date) ON d = x.date)) c"""


_factor(
    "mom_12_1",
    "mom",
    "SELECT date, ticker, mom AS v, CAST(NULL AS VARCHAR) AS reason, fail_reason IS NULL AS eligible FROM flags",
    "history_ineligible",
)

PARTS["quarters"] = """
SELECT *, fy * 4 + fq AS o, last_day(make_date(fy, fq * 3, 1)) AS pe
FROM (SELECT l_suppkey AS k, CAST(year(l_shipdate) AS INTEGER) AS fy,
             CAST(quarter(l_shipdate) AS INTEGER) AS fq,
             CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)
                      * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS net,
             CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross,
             CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)
                      * CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS tax
      FROM lineitem GROUP BY 1, 2, 3)"""

PARTS["filings"] = """
SELECT 'S' || k AS ticker, k,
       CASE WHEN k % 23 = 0 THEN NULL WHEN k % 25 = 0 AND fy >= 1998 THEN 200000 + k ELSE 100000 + k END AS cik,
       filing_date, period_end_date, fy AS fiscal_year, fq AS fiscal_quarter, period_kind, revenues, net_income
FROM (
  SELECT k, fy, fq, pe AS period_end_date, pe + CAST(35 + k % 20 AS INTEGER) AS filing_date,
         'quarterly' AS period_kind, gross / 100.0::DOUBLE AS revenues,
         CASE WHEN (k + o) % 17 <> 0 THEN net / 10000.0::DOUBLE END AS net_income
  FROM quarters WHERE (k + o) % 17 <> 0 OR k % 3 = 0
  UNION ALL
  SELECT k, fy, fq, pe, pe + CAST(65 + k % 20 AS INTEGER), 'quarterly', (gross + 10000) / 100.0::DOUBLE,
         CASE WHEN (k + o) % 17 <> 0 THEN (net + 1000000) / 10000.0::DOUBLE END
  FROM quarters WHERE ((k + o) % 17 <> 0 OR k % 3 = 0) AND (k + o) % 7 = 0
  UNION ALL
  SELECT k, fy, NULL, make_date(fy, 12, 31), make_date(fy, 12, 31) + CAST(60 + k % 20 AS INTEGER), 'annual',
         CAST(sum(gross) AS BIGINT) / 100.0::DOUBLE, CAST(sum(net) AS BIGINT) / 10000.0::DOUBLE
  FROM quarters GROUP BY k, fy
  UNION ALL
  SELECT DISTINCT k, fy, NULL::INTEGER, make_date(fy, 12, 31), make_date(fy, 12, 31) + CAST(61 + k % 20 AS INTEGER),
         'trailing_twelve_months', 99999.0::DOUBLE, 99999.0::DOUBLE
  FROM quarters)"""


def _as_of(suffix: str, requests: str, match: str) -> None:
    """Scalar-style as-of answers: every request looks at all it can see."""
    PARTS[f"visible{suffix}"] = f"""
SELECT r.ticker, r.date, f.cik, f.filing_date, f.period_end_date, f.fiscal_year, f.fiscal_quarter,
       f.period_kind, f.revenues, f.net_income
FROM ({requests}) r JOIN filings f ON f.ticker = r.ticker AND f.filing_date < r.date {match}"""
    PARTS[f"answers{suffix}"] = f"""
WITH seen AS (
  SELECT ticker, date, count(DISTINCT cik) AS ids,
         count(*) FILTER (WHERE period_kind = 'quarterly') AS quarterlies, max(filing_date) AS last_filed
  FROM visible{suffix} GROUP BY ticker, date),
versions AS (
  SELECT *, fiscal_year * 4 + fiscal_quarter AS ordinal,
         row_number() OVER (PARTITION BY ticker, date, fiscal_year * 4 + fiscal_quarter
                            ORDER BY filing_date DESC) AS newest
  FROM visible{suffix} WHERE period_kind = 'quarterly'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY ordinal DESC) AS place
  FROM versions WHERE newest = 1),
four AS (
  SELECT ticker, date, count(*) AS n, max(ordinal) - min(ordinal) AS span, min(filing_date) AS oldest,
         sum(net_income) AS ni, count(net_income) AS ni_n, sum(revenues) AS rev, count(revenues) AS rev_n
  FROM ranked WHERE place <= 4 GROUP BY ticker, date)
SELECT r.*, {"ids > 1" if not suffix else "false"} AS ambiguous, last_filed, oldest,
       coalesce(n = 4 AND span = 3, false) AS complete, coalesce(quarterlies, 0) AS quarterlies, ni, ni_n, rev, rev_n
FROM ({requests}) r LEFT JOIN seen USING (ticker, date) LEFT JOIN four USING (ticker, date)"""
    status = """CASE WHEN ambiguous THEN 'ambiguous_cik' WHEN quarterlies = 0 THEN 'missing_fundamentals'
            WHEN NOT complete THEN 'insufficient_quarters' WHEN {n} < 4 THEN 'missing_field_value' END"""
    PARTS[f"ttm{suffix}"] = f"""
SELECT ticker, date{", entity_id" if suffix else ""},
       {status.format(n="ni_n")} AS net_income_status,
       {status.format(n="rev_n")} AS revenues_status,
       CASE WHEN NOT coalesce(ambiguous, false) AND complete AND ni_n = 4 THEN ni END AS net_income_ttm,
       CASE WHEN NOT coalesce(ambiguous, false) AND complete AND rev_n = 4 THEN rev END AS revenues_ttm,
       CASE WHEN NOT coalesce(ambiguous, false) THEN CAST(date_diff('day', last_filed, date) AS INTEGER) END AS latest_lag_days,
       CASE WHEN NOT coalesce(ambiguous, false) AND complete THEN CAST(date_diff('day', oldest, date) AS INTEGER) END AS oldest_lag_days,
       coalesce(ambiguous, false) AS ambiguous, last_filed
FROM answers{suffix}"""


_as_of("", "SELECT ticker, date FROM bars", "")
_as_of(
    "_id",
    "SELECT ticker, date, CAST(100000 + CAST(ticker[2:] AS BIGINT) AS VARCHAR) AS entity_id FROM bars",
    "AND CAST(f.cik AS VARCHAR) = r.entity_id",
)

_factor(
    "earnings_yield",
    "ey",
    """SELECT b.date, b.ticker, CASE WHEN net_income_status IS NULL AND mcap > 0 THEN net_income_ttm / mcap END AS v,
       CASE WHEN net_income_status = 'insufficient_quarters' THEN 'insufficient_quarters'
            WHEN net_income_status IS NOT NULL THEN 'missing_fundamentals'
            WHEN NOT mcap > 0 THEN 'invalid_denominator' END AS reason, b.fail_reason IS NULL AS eligible
FROM flags b JOIN ttm t ON t.ticker = b.ticker AND t.date = b.date""",
    "raw_factor_nan",
)

PARTS["changes"] = """
SELECT CAST(ts AS DATE) AS date, CASE WHEN event_type = 'signup' THEN 'U' || user_id END AS added_ticker,
       CASE WHEN event_type = 'signup' THEN 'User ' || user_id || '/' || (event_id % 3) END AS added_name,
       CASE WHEN event_type = 'error' THEN 'U' || user_id END AS removed_ticker,
       CASE WHEN event_type = 'error' THEN 'User ' || user_id || '/' || (event_id % 3) END AS removed_name,
       event_id AS seq
FROM events WHERE event_id % 97 <> 0"""

PARTS["current_members"] = """
SELECT 'U' || user_id AS ticker, 'Member ' || user_id AS name, 'Sector ' || (user_id % 5) AS wiki_sector,
       'Sub ' || (user_id % 7) AS wiki_sub_industry, CAST(min(ts) AS DATE) AS date_added,
       CASE WHEN user_id % 4 <> 0 THEN user_id END AS cik_code
FROM events WHERE event_type = 'signup' AND user_id % 3 = 0 AND user_id % 31 <> 0 GROUP BY user_id"""

PARTS["walk"] = """
SELECT ticker, date, kind, lag(date) OVER w AS prev_date, lag(kind) OVER w AS prev_kind,
       lead(date) OVER w AS next_date
FROM (SELECT added_ticker AS ticker, date, 0 AS kind FROM changes WHERE added_ticker IS NOT NULL
      UNION ALL SELECT removed_ticker, date, 1 FROM changes WHERE removed_ticker IS NOT NULL)
WINDOW w AS (PARTITION BY ticker ORDER BY date, kind)"""

PARTS["intervals"] = """
SELECT ticker, CASE WHEN prev_kind = 0 THEN prev_date ELSE (SELECT min(date) FROM changes) END AS date_added,
       date AS date_removed
FROM walk WHERE kind = 1 OR prev_kind = 0
UNION ALL SELECT ticker, date_added, NULL FROM current_members"""

PARTS["enriched"] = """
SELECT i.ticker, coalesce(c.name, f.name) AS name, wiki_sector, wiki_sub_industry, i.date_added, i.date_removed,
       cik_code
FROM intervals i LEFT JOIN current_members c ON c.ticker = i.ticker
LEFT JOIN (SELECT ticker, arg_min(name, seq) AS name
           FROM (SELECT added_ticker AS ticker, added_name AS name, seq FROM changes
                 UNION ALL SELECT removed_ticker, removed_name, seq FROM changes)
           WHERE ticker IS NOT NULL GROUP BY ticker) f ON f.ticker = i.ticker"""

PARTS["users"] = "SELECT DISTINCT user_id AS u FROM events"

PARTS["updated"] = """
SELECT ticker, name, wiki_sector, wiki_sub_industry,
       CASE WHEN u % 10 = 1 THEN DATE '2023-12-15' ELSE date_added END AS date_added,
       CASE WHEN u % 10 = 2 THEN DATE '2024-02-15' ELSE date_removed END AS date_removed, cik_code, u
FROM (SELECT *, CAST(ticker[2:] AS BIGINT) AS u FROM enriched)"""

PARTS["membership"] = """
SELECT ticker, name, wiki_sector, wiki_sub_industry, date_added, date_removed, cik_code FROM updated
WHERE NOT (u % 10 = 6 AND date_added = DATE '2024-01-01')
UNION ALL
SELECT 'X' || u, 'Added ' || u, NULL, NULL, DATE '2024-01-03', DATE '2024-01-17', NULL FROM users WHERE u % 10 = 4"""

PARTS["anchor_members"] = """
SELECT DISTINCT ticker FROM membership
WHERE date_added <= DATE '2024-01-12' AND (date_removed IS NULL OR DATE '2024-01-12' < date_removed)"""

PARTS["members"] = """
SELECT DISTINCT d.date, m.ticker
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) d
JOIN membership m ON m.date_added <= d.date AND (m.date_removed IS NULL OR d.date < m.date_removed)"""

PARTS["metadata"] = """
SELECT prefix || k AS ticker, c_name AS name, 'XNYS' AS primary_exchange, 'CS' AS ticker_type,
       CASE WHEN k % 8 <> 5 THEN shifted END AS list_date,
       CASE WHEN k % 4 = 0 THEN shifted + CAST(10 + k % 15 AS INTEGER) END AS delisted_date,
       CAST(1000 + k % 7000 AS VARCHAR) AS sic_code, CASE WHEN k % 6 <> 0 THEN c_mktsegment END AS sic_description,
       300000 + k AS cik
FROM (SELECT c_custkey AS k, c_name, c_mktsegment,
             DATE '2023-12-20' + CAST(date_diff('day', DATE '1995-01-01', first) % 30 AS INTEGER) AS shifted
      FROM customer JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first FROM orders GROUP BY 1)
        ON o_custkey = c_custkey)
JOIN (VALUES ('U'), ('V'), ('W')) p(prefix)
  ON (prefix = 'U' AND k % 9 <> 0) OR (prefix = 'V' AND k % 10 IN (3, 5, 7) AND k % 20 < 10)
     OR (prefix = 'W' AND k % 10 = 5)"""

PARTS["aliases"] = """
SELECT 'U' || c_custkey AS canonical, alias_prefix || (c_custkey + shift) AS alias, f AS effective_from,
       coalesce(t, DATE '2024-01-10' + CAST(c_custkey % 7 AS INTEGER)) AS effective_to
FROM customer JOIN (VALUES
  (10, 3, 'V', 0, NULL::DATE, NULL::DATE), (10, 5, 'W', 0, NULL, DATE '2024-01-08'),
  (10, 5, 'V', 0, DATE '2024-01-08', DATE '2024-01-18'), (10, 7, 'V', 0, DATE '2024-01-05', DATE '2024-01-20'),
  (50, 21, 'U', 1, NULL, DATE '2024-01-15'), (100, 47, 'W', 0, DATE '2024-01-10', DATE '2024-01-12'))
  r(modulus, rest, alias_prefix, shift, f, t) ON c_custkey % modulus = rest"""

PARTS["canonical"] = """
SELECT m.ticker, m.date, coalesce(l.canonical, m.ticker) AS canonical
FROM members m LEFT JOIN (SELECT alias, min(canonical) AS canonical FROM aliases GROUP BY alias) l
  ON l.alias = m.ticker"""

PARTS["traded"] = """
SELECT c.ticker, c.date, c.canonical, count(a.alias) AS matches,
       CASE count(a.alias) WHEN 0 THEN c.canonical WHEN 1 THEN min(a.alias) END AS traded_as
FROM canonical c LEFT JOIN aliases a ON a.canonical = c.canonical
  AND (a.effective_from IS NULL OR a.effective_from <= c.date)
  AND (a.effective_to IS NULL OR c.date < a.effective_to)
GROUP BY c.ticker, c.date, c.canonical"""

PARTS["resolved"] = """
SELECT t.date, t.ticker AS source, traded_as AS resolved,
       CASE WHEN matches > 1 THEN 'alias_overlap:' || t.ticker
            WHEN max(m.ticker) IS NULL THEN 'metadata_missing:' || traded_as
            WHEN NOT coalesce(bool_or((list_date IS NULL OR list_date <= t.date)
                                      AND (delisted_date IS NULL OR t.date < delisted_date)), false)
              THEN 'not_active_on_date:' || traded_as END AS status
FROM traded t LEFT JOIN metadata m ON m.ticker = t.traded_as
GROUP BY t.date, t.ticker, traded_as, matches"""

PARTS["filing_records"] = """
SELECT e.*, k, fy, fq, pe, gross, net, tax, 'S' || k AS requested,
       CASE k % 5 WHEN 1 THEN 'Y' || k ELSE 'S' || k END AS ticker,
       CASE WHEN k % 23 <> 0 THEN 100000 + k END AS cik,
       pe + CAST(35 + k % 20 + shift AS INTEGER) AS filing_date,
       CASE WHEN k % 29 <> 0 THEN pe END AS period_end_date,
       CASE WHEN NOT (fq = 4 AND k % 7 = 0) THEN 'quarterly' END AS period_kind
FROM quarters, (VALUES (1, 'income_statements', 0), (2, 'balance_sheets', 3), (3, 'cash_flow_statements', -2))
  e(feed, endpoint, shift)
WHERE feed = 1 OR (feed = 2 AND (k + o) % 4 <> 0) OR (feed = 3 AND (k + o) % 5 <> 0)"""

PARTS["capped"] = """
SELECT * FROM filing_records
WHERE filing_date >= DATE '1996-01-01' AND (k % 6 <> 0 OR filing_date < DATE '2000-06-30' + 30)"""

_SHA_ORDER = "sha256(o_orderkey || '|' || o_orderstatus || '|' || CAST(round(o_totalprice * 100) AS BIGINT) || '|{salt}')"

PARTS["artifacts"] = f"""
SELECT 'art-' || o_orderkey AS artifact_id, 'cand-' || o_custkey AS candidate_id, o_orderkey,
       CASE WHEN o_orderkey % 2 = 0 THEN 'panel' ELSE 'factor' END AS artifact_type,
       '/artifacts/' || o_orderkey AS path, {_SHA_ORDER.format(salt="")} AS checksum, o_orderdate
FROM orders"""

PARTS["candidates"] = """
SELECT 'cand-' || c_custkey AS candidate_id, c_custkey, 'mom_12_1' AS candidate_name,
       'log(P[t-21] / P[t-252])' AS formula_string, sha256('data ' || c_custkey) AS data_snapshot_id,
       sha256('config ' || (n_regionkey % 3)) AS config_hash, sha256('code ' || n_nationkey)[1:40] AS git_sha,
       n_nationkey
FROM customer JOIN nation ON n_nationkey = c_nationkey"""

PARTS["outcomes"] = """
SELECT c.candidate_id, coalesce(path, '<ledger>') AS path,
       CASE WHEN artifact_id IS NULL THEN 'no_artifacts_recorded' WHEN o_orderkey % 97 = 0 THEN 'file_missing'
            WHEN o_orderkey % 89 = 0 THEN 'checksum_mismatch' ELSE 'verified' END AS outcome
FROM candidates c LEFT JOIN artifacts a USING (candidate_id)"""


def oracle(name: str, parts: str, body: str) -> None:
    wanted = set(parts.split())
    unknown = wanted - set(PARTS)
    if unknown:
        raise KeyError(f"{name}: {sorted(unknown)}")
    ctes = ", ".join(f"{p} AS ({PARTS[p].strip()})" for p in PARTS if p in wanted)
    ORACLE[name] = f"WITH {ctes} {body.strip()}" if ctes else body.strip()


PRICES = "trade_days details bars"
FLAGS = f"{PRICES} flags"
MOM = f"{FLAGS} mom_clipped mom_12_1"
FILED = f"{PRICES} quarters filings visible answers ttm"
EY = f"{FLAGS} {FILED} ey_clipped earnings_yield"
INDEX = "changes current_members walk intervals enriched"
MEMBERS = f"{INDEX} users updated membership"
DAILY = f"{MEMBERS} members"
RESOLVED = f"{DAILY} metadata aliases canonical traded resolved"

BAR_KINDS = {
    "date": "date", "ticker": "text", "exchange": "text", "ticker_type": "text", "is_common_share": "flag",
    "raw_close": "double", "adj_close": "double", "volume": "double", "shares_out": "double", "mcap": "double",
}


def fingerprint_of(kinds: dict[str, str]) -> str:
    """The content fingerprint as an aggregate expression: text of every value with its length,
    MD5 of a row, sums of its pieces, SHA-256 of the sums."""

    def scaled(x: str, k: str) -> str:
        return f"(({x}) * pow(2, floor({k} / 2)) * pow(2, {k} - floor({k} / 2)))"

    def text(name: str, kind: str) -> str:
        if kind != "double":
            return f"CAST({name} AS VARCHAR)"
        size = f"CASE WHEN {name} <> 0 AND isfinite({name}) THEN abs({name}) END"
        rough = f"floor(log2({size}))"
        lifted = scaled(size, f"(52 - {rough})")
        exponent = f"({rough} + CASE WHEN {lifted} >= pow(2, 53) THEN 1 WHEN {lifted} < pow(2, 52) THEN -1 ELSE 0 END)"
        sign = f"CASE WHEN {name} < 0 THEN '-' ELSE '' END"
        exact = f"({sign}) || CAST(CAST({scaled(size, f"(52 - {exponent})")} AS BIGINT) AS VARCHAR) || 'p' || CAST(CAST({exponent} AS BIGINT) AS VARCHAR)"
        return f"coalesce({exact}, CASE WHEN {name} = 0 THEN '0' WHEN isnan({name}) THEN 'nan' WHEN isinf({name}) THEN ({sign}) || 'inf' END)"

    def column(name: str, kind: str) -> str:
        return f"coalesce(strlen({text(name, kind)}) || ':' || {text(name, kind)}, '~')"

    row = "md5(" + " || ".join(column(n, k) for n, k in kinds.items()) + ")"
    sums = " || '|' || ".join(f"coalesce(sum(CAST('0x' || {row}[{i}:{min(i + 4, 32)}] AS BIGINT)), 0)" for i in range(1, 33, 5))
    return f"sha256('{','.join(kinds)}' || '|' || count(*) || '|' || {sums})"


MEMBERSHIP_KINDS = dict.fromkeys(
    ("ticker", "name", "wiki_sector", "wiki_sub_industry", "date_added", "date_removed", "cik_code"), "text"
)
METADATA_KINDS = dict.fromkeys(
    ("ticker", "name", "primary_exchange", "ticker_type", "list_date", "delisted_date", "sic_code", "sic_description", "cik"),
    "text",
)
_ABSENT = ("eps_basic", "eps_diluted", "weighted_avg_shares_basic", "weighted_avg_shares_diluted", "common_equity", "total_assets", "operating_cash_flow")
FILING_KINDS = {
    **dict.fromkeys(("ticker", "cik", "filing_date", "period_end_date", "fiscal_year", "fiscal_quarter", "period_kind"), "text"),
    **dict.fromkeys(("revenues", "net_income", *_ABSENT), "double"),
    "source_endpoints": "text",
}
PARTS["whole_filings"] = f"""
SELECT *, {", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in _ABSENT)}, '[income_statements]' AS source_endpoints FROM filings"""

oracle("read_membership", MEMBERS, f"SELECT {', '.join(MEMBERSHIP_KINDS)} FROM membership")
oracle("read_metadata", "metadata", f"SELECT {', '.join(METADATA_KINDS)} FROM metadata")
oracle("read_aliases", "aliases", "SELECT canonical AS canonical_ticker, alias, effective_from, effective_to FROM aliases")
oracle("read_symbol_list", PRICES, "SELECT DISTINCT ticker FROM bars")
oracle(
    "bar_duplicates",
    PRICES,
    "SELECT date, ticker, CAST(2 AS BIGINT) AS rows FROM bars WHERE CAST(ticker[2:] AS BIGINT) % 50 = 0",
)
oracle("bars_from_feed", "kept_days raw_feed", "SELECT ticker, date, close, volume FROM raw_feed")
oracle(
    "adj_raw_join",
    "trade_days kept_days adj_feed raw_feed",
    """SELECT a.ticker, a.date, a.close AS adj_close, r.close AS raw_close, volume
FROM adj_feed a JOIN raw_feed r ON a.ticker = r.ticker AND a.date = r.date""",
)
oracle(
    "daily_bars",
    "trade_days kept_days adj_feed raw_feed details",
    """SELECT a.date, a.ticker, exchange, ticker_type, ticker_type = 'CS' AS is_common_share, r.close AS raw_close,
       a.close AS adj_close, volume, shares_out, r.close * shares_out AS mcap
FROM adj_feed a JOIN raw_feed r ON a.ticker = r.ticker AND a.date = r.date JOIN details d ON d.ticker = a.ticker
WHERE a.date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
)
oracle(
    "skip_audit",
    "kept_days",
    """SELECT 'S' || c_custkey AS ticker,
       CASE WHEN s_suppkey IS NULL THEN 'meta: not found' ELSE 'aggs: no rows returned' END AS reason
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
WHERE s_suppkey IS NULL OR s_suppkey NOT IN (SELECT k FROM kept_days)
UNION ALL SELECT 'N' || c_custkey, 'aggs: no rows returned' FROM customer""",
)
oracle("ret_1d", FLAGS, "SELECT date, ticker, round(ret_1d, 9) AS ret_1d FROM flags")
oracle(
    "universe_flags",
    FLAGS,
    """SELECT date, ticker, fail_reason IS NULL AS eligible_flag, price_ok, history_ok, exchange_ok, common_share_ok,
       fail_reason FROM flags""",
)
oracle(
    "fail_reason_counts",
    FLAGS,
    "SELECT coalesce(fail_reason, 'eligible') AS fail_reason, count(*) AS rows FROM flags GROUP BY 1",
)
oracle(
    "panel",
    FLAGS,
    """SELECT date, ticker, exchange, ticker_type, is_common_share, raw_close, adj_close, round(ret_1d, 9) AS ret_1d,
       volume, shares_out, mcap, CAST(NULL AS VARCHAR) AS gics_sector, CAST(NULL AS VARCHAR) AS gics_industry,
       fail_reason IS NULL AS eligible_flag FROM flags""",
)
oracle(
    "panel_for_anchor_date",
    f"{FLAGS} {MEMBERS} anchor_members",
    """SELECT date, ticker, fail_reason IS NULL AS eligible_flag FROM flags
WHERE ticker IN (SELECT 'S' || ticker[2:] FROM anchor_members)""",
)
oracle(
    "eligible_per_day",
    FLAGS,
    "SELECT date, count(*) FILTER (WHERE fail_reason IS NULL) AS eligible FROM flags GROUP BY date",
)
oracle(
    "panel_summary",
    PRICES,
    """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date
FROM bars""",
)
oracle("panel_fingerprint", PRICES, f"SELECT {fingerprint_of(BAR_KINDS)} AS fingerprint FROM bars")
oracle(
    "panel_stamped",
    PRICES,
    f"SELECT {fingerprint_of(BAR_KINDS)} AS data_snapshot_id, count(*) AS rows FROM bars",
)
oracle(
    "winsorize",
    PRICES,
    """SELECT b.date, ticker, round(least(greatest(ln(adj_close), lo), hi), 8) AS clipped
FROM bars b JOIN (SELECT date, quantile_cont(ln(adj_close), 0.05) AS lo, quantile_cont(ln(adj_close), 0.95) AS hi
                  FROM bars GROUP BY date) q ON q.date = b.date""",
)
oracle(
    "zscore",
    PRICES,
    """SELECT date, ticker, round(CASE WHEN s > 0 THEN (adj_close - m) / s END, 6) AS z,
       round(CASE WHEN s1 > 0 THEN (adj_close - m) / s1 END, 6) AS z_sample
FROM bars JOIN (SELECT date AS d, avg(adj_close) AS m, stddev_pop(adj_close) AS s, stddev_samp(adj_close) AS s1
                FROM bars GROUP BY date) ON d = date""",
)

_VIEW = """SELECT date, ticker, factor_name, round(raw_value, 8) AS raw_value,
       round(winsorized_value, 8) AS winsorized_value, round(zscore_value, 6) AS zscore_value, valid_flag,
       tradable_flag, invalid_reason FROM {}"""
_REASONS = "SELECT coalesce(invalid_reason, '__valid__') AS invalid_reason, count(*) AS rows FROM {} GROUP BY 1"

oracle("mom_12_1", MOM, _VIEW.format("mom_12_1"))
oracle("mom_reason_counts", MOM, _REASONS.format("mom_12_1"))
oracle(
    "slice_counters",
    MOM,
    """SELECT count(*) AS panel_rows, count(*) FILTER (WHERE valid_flag) AS valid_rows,
       count(*) FILTER (WHERE tradable_flag) AS tradable_rows FROM mom_12_1""",
)
oracle(
    "slice_job",
    MOM,
    """SELECT count(*) AS panel_rows, count(*) FILTER (WHERE valid_flag) AS valid_rows,
       count(*) FILTER (WHERE tradable_flag) AS tradable_rows, CAST(2 AS BIGINT) AS artifacts_verified, true AS all_ok
FROM mom_12_1""",
)
_DAILY_Z = """SELECT date, avg(zscore_value) AS mean, stddev_samp(zscore_value) AS std FROM mom_12_1
WHERE valid_flag GROUP BY date"""
oracle(
    "zscore_sanity",
    MOM,
    f"SELECT round(max(abs(mean)), 6) AS max_abs_mean, round(avg(std), 6) AS mean_std FROM ({_DAILY_Z})",
)
oracle(
    "zscore_by_day",
    MOM,
    f"SELECT date, abs(round(mean, 6)) AS abs_mean, round(std, 6) AS std FROM ({_DAILY_Z})",
)
oracle(
    "last_day_cross_section",
    MOM,
    """SELECT ticker, round(raw_value, 8) AS raw_value, round(winsorized_value, 8) AS winsorized_value,
       round(zscore_value, 6) AS zscore_value FROM mom_12_1
WHERE valid_flag AND date = (SELECT max(date) FROM mom_12_1) ORDER BY zscore_value DESC, ticker""",
)
oracle(
    "ticker_series",
    MOM,
    "SELECT date, round(raw_value, 8) AS raw_value FROM mom_12_1 WHERE valid_flag AND ticker = 'S7' ORDER BY date",
)

oracle(
    "normalize_current",
    "current_members",
    "SELECT ticker, name, wiki_sector, wiki_sub_industry, date_added, cik_code FROM current_members",
)
oracle(
    "undated_current",
    "",
    """SELECT count(DISTINCT user_id) AS undated FROM events
WHERE event_type = 'signup' AND user_id % 3 = 0 AND user_id % 31 = 0""",
)
oracle(
    "normalize_changes",
    "changes",
    "SELECT date, added_ticker, added_name, removed_ticker, removed_name, seq FROM changes",
)
oracle(
    "membership_intervals", "changes current_members walk intervals", "SELECT ticker, date_added, date_removed FROM intervals"
)
oracle(
    "membership_phantoms",
    "changes current_members walk",
    """SELECT ticker, date AS dangling_since FROM walk
WHERE next_date IS NULL AND kind = 0 AND ticker NOT IN (SELECT ticker FROM current_members)""",
)
oracle("interval_enrichment", INDEX, "SELECT * FROM enriched")
oracle(
    "curated_patches",
    MEMBERS,
    """SELECT ticker, CASE WHEN u % 10 = 8 THEN 'Second ' || u ELSE name END AS name,
       CASE WHEN u % 10 = 8 THEN 'Moved again' ELSE wiki_sector END AS wiki_sector, wiki_sub_industry, date_added,
       CASE WHEN u % 10 = 8 THEN DATE '2024-02-21' ELSE date_removed END AS date_removed, cik_code
FROM (SELECT *, CASE WHEN ticker LIKE 'U%' THEN CAST(ticker[2:] AS BIGINT) ELSE 0 END AS u FROM membership)
WHERE u % 10 NOT IN (5, 9)
UNION ALL
SELECT ticker, CASE WHEN date_added = DATE '2024-01-05' THEN 'New ' || u ELSE name END, wiki_sector, wiki_sub_industry, date_added, date_removed,
       CASE WHEN date_added = DATE '2024-01-05' THEN u ELSE cik_code END
FROM (SELECT *, CAST(ticker[2:] AS BIGINT) AS u FROM membership WHERE ticker LIKE 'U%'
      UNION ALL SELECT 'U' || u, NULL, NULL, NULL, DATE '2024-01-05', NULL, NULL, u FROM users) WHERE u % 10 = 9""",
)
oracle(
    "unmatched_patches",
    MEMBERS,
    """SELECT position, op, ticker, CAST(NULL AS DATE) AS date_added, CAST(NULL AS DATE) AS date_removed, field, value FROM (
  SELECT CAST(p.position AS INTEGER) AS position, p.op, p.prefix || u AS ticker, p.field,
         CASE p.position WHEN 11 THEN 'First ' || u WHEN 12 THEN 'Second ' || u ELSE p.value END AS value,
         p.always OR NOT EXISTS (SELECT 1 FROM membership m WHERE m.ticker = p.prefix || u) AS idle
  FROM users JOIN (VALUES (8, 11, 'update', 'U', 'name', NULL, false), (8, 12, 'update', 'U', 'name', NULL, false),
    (8, 13, 'update', 'U', 'wiki_sector', 'Moved', false), (8, 14, 'update', 'U', 'wiki_sector', 'Moved again', false),
    (8, 15, 'update', 'U', 'date_removed', '2024-02-20', false), (8, 16, 'update', 'U', 'date_removed', '2024-02-21', false),
    (8, 42, 'update', 'U', 'no_field', 'x', true), (5, 31, 'delete', 'U', NULL, NULL, false),
    (5, 32, 'update', 'U', 'name', 'too late', true), (7, 41, 'update', 'Q', 'name', 'nobody', true))
    p(rest, position, op, prefix, field, value, always) ON u % 10 = rest) WHERE idle""",
)
oracle(
    "patch_counts",
    MEMBERS,
    """SELECT 'update' AS op, count(*) AS rows FROM updated WHERE u % 10 IN (1, 2)
UNION ALL SELECT 'add', count(*) FROM users WHERE u % 10 = 4
UNION ALL SELECT 'delete', count(*) FROM updated WHERE u % 10 = 6 AND date_added = DATE '2024-01-01'""",
)
oracle("members_on", f"{MEMBERS} anchor_members", "SELECT ticker FROM anchor_members")
oracle("active_on", DAILY, "SELECT date, ticker FROM members")
oracle(
    "membership_window",
    MEMBERS,
    """SELECT DISTINCT CAST(d AS DATE) AS date, ticker
FROM generate_series(DATE '2024-01-01', DATE '2024-02-29', INTERVAL 1 DAY) g(d)
JOIN membership ON date_added <= d AND (date_removed IS NULL OR d < date_removed) WHERE isodow(d) < 6""",
)

PARTS["held"] = """
SELECT CASE WHEN c_custkey % 19 = 0 THEN 'U.' ELSE 'U' END || c_custkey AS "Ticker", c_name AS "Name"
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD' AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0"""
PARTS["difference"] = """
SELECT coalesce(a.ticker, b.ticker) AS ticker, CASE WHEN b.ticker IS NULL THEN 'only_left' ELSE 'only_right' END AS side
FROM anchor_members a FULL OUTER JOIN (SELECT DISTINCT replace("Ticker", '.', '') AS ticker FROM held) b
  ON a.ticker = b.ticker
WHERE a.ticker IS NULL OR b.ticker IS NULL"""
oracle("holdings", "held", 'SELECT "Ticker", "Name" FROM held')
_DIFF = f"{MEMBERS} anchor_members held difference"
oracle("constituent_diff", _DIFF, "SELECT ticker, side FROM difference")
oracle("constituent_tolerance", _DIFF, "SELECT count(*) AS differing, count(*) <= 1 AS ok FROM difference")

oracle(
    "listed_on",
    f"{DAILY} metadata",
    """SELECT r.ticker, r.date, count(m.ticker) > 0 AS known,
       coalesce(bool_or(m.ticker IS NOT NULL AND (list_date IS NULL OR list_date <= r.date)
                        AND (delisted_date IS NULL OR r.date < delisted_date)), false) AS listed
FROM members r LEFT JOIN metadata m ON m.ticker = r.ticker GROUP BY r.ticker, r.date""",
)
oracle(
    "canonicalize",
    f"{DAILY} aliases canonical traded",
    "SELECT ticker, date, canonical, traded_as, matches FROM traded",
)
oracle(
    "historical_symbol",
    f"{DAILY} aliases",
    """SELECT m.ticker, m.date,
       CASE WHEN count(a.alias) > 0 THEN min(a.alias) WHEN max(born) IS NULL OR m.date >= max(born) THEN m.ticker END
         AS symbol
FROM members m LEFT JOIN aliases a ON a.canonical = m.ticker
  AND (a.effective_from IS NULL OR a.effective_from <= m.date)
  AND (a.effective_to IS NULL OR m.date < a.effective_to)
LEFT JOIN (SELECT canonical, min(effective_from) AS born FROM aliases GROUP BY 1) b ON b.canonical = m.ticker
GROUP BY m.ticker, m.date""",
)
oracle("resolve_universe", RESOLVED, "SELECT date, source, resolved, status FROM resolved")
oracle(
    "resolve_drops",
    RESOLVED,
    """SELECT date, count(*) AS requested_count, count(*) FILTER (WHERE status IS NULL) AS tradable_count,
       count(*) FILTER (WHERE status IS NOT NULL) AS dropped_count FROM resolved GROUP BY date""",
)
oracle(
    "alias_collisions",
    RESOLVED,
    """SELECT date, resolved, count(*) AS sources, min(source) AS first_source, max(source) AS last_source
FROM resolved WHERE status IS NULL GROUP BY date, resolved HAVING count(*) > 1""",
)
oracle(
    "alias_overlaps",
    "aliases",
    """SELECT DISTINCT b.canonical AS canonical_ticker, b.f AS interval_from, b.t AS interval_to, CAST(1 AS BIGINT) AS copies
FROM (SELECT canonical, coalesce(effective_from, DATE '0001-01-01') AS f,
             coalesce(effective_to, DATE '9999-12-31') AS t FROM aliases) a
JOIN (SELECT canonical, coalesce(effective_from, DATE '0001-01-01') AS f,
             coalesce(effective_to, DATE '9999-12-31') AS t FROM aliases) b
  ON a.canonical = b.canonical AND (a.f, a.t) < (b.f, b.t) AND b.f < a.t""",
)
oracle(
    "sector_lookup",
    f"{DAILY} metadata",
    """SELECT m.ticker, m.date, sic_description
FROM members m LEFT JOIN metadata d ON d.ticker = m.ticker""",
)
oracle(
    "metadata_upsert",
    "metadata",
    """SELECT ticker, name, primary_exchange, ticker_type,
       CASE WHEN hit THEN DATE '2015-07-01' ELSE list_date END AS list_date,
       CASE WHEN NOT hit THEN delisted_date END AS delisted_date,
       CASE WHEN hit THEN '2650' ELSE sic_code END AS sic_code, sic_description, cik
FROM (SELECT *, ticker[1] = 'U' AND CAST(ticker[2:] AS BIGINT) % 5 = 2 AS hit
      FROM (SELECT * FROM metadata
            UNION ALL
            SELECT 'R' || ticker[2:], CASE WHEN CAST(ticker[2:] AS BIGINT) % 2 = 0 THEN 'Renamed' ELSE name END,
                   primary_exchange, ticker_type, list_date, DATE '2026-01-14', sic_code, sic_description, cik
            FROM metadata WHERE ticker[1] = 'U' AND CAST(ticker[2:] AS BIGINT) % 7 = 3))
UNION ALL
SELECT 'U' || c_custkey, NULL, NULL, NULL, DATE '2015-07-01', NULL, '2650', NULL, NULL FROM customer
WHERE c_custkey % 5 = 2 AND 'U' || c_custkey NOT IN (SELECT ticker FROM metadata)""",
)
PARTS["ever"] = """
SELECT ticker, CASE WHEN NOT bool_or(date_removed IS NULL) THEN max(date_removed) END AS ref_date
FROM membership GROUP BY ticker"""
oracle(
    "project_details",
    f"{MEMBERS} ever",
    """SELECT 'U' || c_custkey AS ticker, c_name AS name, 'XNYS' AS primary_exchange, 'CS' AS ticker_type,
       CASE WHEN c_custkey % 4 <> 1 THEN first END AS list_date,
       coalesce(ref_date, CASE WHEN c_custkey % 4 = 0 THEN last END) AS delisted_date, '1000' AS sic_code,
       c_mktsegment AS sic_description, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS cik
FROM customer
JOIN (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last
      FROM orders GROUP BY 1) ON o_custkey = c_custkey
LEFT JOIN ever ON ever.ticker = 'U' || c_custkey""",
)
oracle(
    "fetch_universe",
    f"{MEMBERS} metadata ever",
    """SELECT e.ticker, lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, ref_date
FROM ever e LEFT JOIN metadata m ON m.ticker = e.ticker""",
)
oracle(
    "first_entities",
    f"{MEMBERS} metadata ever",
    """SELECT e.ticker, cik, ref_date FROM ever e LEFT JOIN metadata m ON m.ticker = e.ticker
ORDER BY e.ticker LIMIT 25""",
)

_RECORDS = "quarters filing_records"
oracle(
    "statement_projection",
    _RECORDS,
    """SELECT requested, ticker, cik, filing_date, period_end_date, fy AS fiscal_year, fq AS fiscal_quarter, period_kind,
       gross / 100.0::DOUBLE AS revenues, net / 10000.0::DOUBLE AS net_income, NULL::DOUBLE AS eps_basic,
       NULL::DOUBLE AS eps_diluted, NULL::DOUBLE AS weighted_avg_shares_basic,
       NULL::DOUBLE AS weighted_avg_shares_diluted, endpoint
FROM filing_records WHERE feed = 1""",
)
oracle(
    "filing_cap",
    f"{_RECORDS} capped",
    """SELECT requested, ticker, filing_date, fy AS fiscal_year, fq AS fiscal_quarter FROM capped WHERE feed = 1""",
)
oracle(
    "statement_merge",
    f"{_RECORDS} capped",
    """SELECT ticker, cik, max(filing_date) AS filing_date, period_end_date, fy AS fiscal_year, fq AS fiscal_quarter,
       period_kind, max(CASE WHEN feed = 1 THEN gross / 100.0::DOUBLE END) AS revenues,
       max(CASE WHEN feed = 1 THEN net / 10000.0::DOUBLE END) AS net_income,
       max(CASE WHEN feed = 2 THEN gross / 200.0::DOUBLE END) AS common_equity,
       max(CASE WHEN feed = 2 THEN gross / 50.0::DOUBLE END) AS total_assets,
       max(CASE WHEN feed = 3 THEN tax / 10000.0::DOUBLE END) AS operating_cash_flow,
       string_agg(endpoint, ',' ORDER BY feed) AS source_endpoints
FROM capped WHERE period_end_date IS NOT NULL AND period_kind IS NOT NULL
GROUP BY requested, ticker, cik, period_end_date, fy, fq, period_kind""",
)
oracle(
    "coverage_failed",
    _RECORDS,
    """SELECT 'S' || c_custkey AS ticker FROM customer
WHERE c_custkey NOT IN (SELECT k FROM filing_records WHERE filing_date >= DATE '1996-01-01')""",
)
oracle(
    "snapshot_facts",
    "quarters filings",
    """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, min(filing_date) AS first_filing,
       max(filing_date) AS last_filing FROM filings""",
)
_BARE = "FROM customer WHERE 'S' || c_custkey NOT IN (SELECT ticker FROM filings)"
_COVERAGE = f"""(SELECT count(*) FROM customer) AS universe_size, (SELECT count(*) {_BARE}) AS coverage_failed,
       (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT 'S' || c_custkey AS t {_BARE} ORDER BY t LIMIT 10)) AS coverage_failed_sample"""
oracle(
    "fundamentals_manifest",
    "quarters filings whole_filings",
    f"""SELECT {fingerprint_of(FILING_KINDS)} AS content_sha, 'fundamentals' AS snapshot, count(*) AS rows, count(DISTINCT ticker) AS tickers,
       min(filing_date) AS first_filing, max(filing_date) AS last_filing, '/snapshots/fundamentals' AS artifact_path, 'c0ffee1' AS code_id,
       {_COVERAGE} FROM whole_filings""",
)
oracle(
    "membership_manifest",
    MEMBERS,
    f"""SELECT {fingerprint_of(MEMBERSHIP_KINDS)} AS content_sha, 'index_membership' AS snapshot, count(*) AS rows, count(*) - count(date_removed) AS current_members,
       count(date_removed) AS historical_removals, (SELECT min(date) FROM changes) AS earliest_change,
       '/snapshots/index_membership' AS artifact_path, 'c0ffee1' AS code_id FROM membership""",
)
oracle(
    "metadata_manifest",
    "metadata",
    f"""SELECT {fingerprint_of(METADATA_KINDS)} AS content_sha, 'ticker_metadata' AS snapshot, count(*) AS rows, count(*) - count(delisted_date) AS current,
       count(delisted_date) AS delisted, '/snapshots/ticker_metadata' AS artifact_path, 'c0ffee1' AS code_id FROM metadata""",
)
oracle(
    "read_fundamentals",
    "quarters filings",
    """SELECT ticker, cik, filing_date, period_end_date, fiscal_year, fiscal_quarter, period_kind, revenues, net_income,
       'income_statements' AS source_endpoints FROM filings""",
)
oracle(
    "published_snapshots",
    f"quarters filings {MEMBERS} metadata",
    f"""SELECT 'index_membership' AS snapshot, count(*) AS rows, count(*) AS stored_rows, 'c0ffee1' AS code_id, 'index_membership' AS folder,
       CAST(NULL AS BIGINT) AS universe_size, CAST(NULL AS BIGINT) AS coverage_failed, CAST(NULL AS VARCHAR) AS coverage_failed_sample
FROM membership WHERE date_removed IS NULL OR date_removed >= date_added
UNION ALL SELECT 'ticker_metadata', count(*), count(*), 'c0ffee1', 'ticker_metadata', NULL, NULL, NULL FROM metadata
WHERE delisted_date IS NULL OR list_date IS NULL OR delisted_date >= list_date
UNION ALL SELECT 'fundamentals', count(*), count(*), 'c0ffee1', 'fundamentals', {_COVERAGE} FROM filings""",
)
oracle(
    "fundamentals_as_of",
    FILED,
    """SELECT t.ticker, t.date, f.cik, f.filing_date, f.period_end_date, f.fiscal_year, f.fiscal_quarter,
       f.period_kind, f.net_income
FROM ttm t LEFT JOIN filings f ON f.ticker = t.ticker AND f.filing_date = t.last_filed AND NOT t.ambiguous""",
)
oracle(
    "ttm_as_of",
    FILED,
    """SELECT ticker, date, round(net_income_ttm, 4) AS net_income_ttm, net_income_status,
       round(revenues_ttm, 4) AS revenues_ttm, revenues_status FROM ttm""",
)
oracle(
    "ttm_status_counts",
    FILED,
    "SELECT coalesce(net_income_status, 'ok') AS status, count(*) AS rows FROM ttm GROUP BY 1",
)
oracle(
    "ttm_by_entity_id",
    f"{PRICES} quarters filings visible_id answers_id ttm_id",
    """SELECT ticker, entity_id, date, round(net_income_ttm, 4) AS net_income_ttm, net_income_status,
       latest_lag_days FROM ttm_id""",
)
oracle("latest_filing_lag", FILED, "SELECT ticker, date, latest_lag_days FROM ttm")
oracle("oldest_component_lag", FILED, "SELECT ticker, date, oldest_lag_days FROM ttm")
oracle(
    "coverage_grid",
    "quarters filings",
    """SELECT CAST(d AS DATE) AS date, t.ticker,
       count(f.ticker) > 0 AND count(DISTINCT f.cik) <= 1 AS has_pit_fundamentals
FROM generate_series(DATE '1998-01-01', DATE '1999-12-31', INTERVAL 1 DAY) g(d)
CROSS JOIN (SELECT DISTINCT ticker FROM filings) t
LEFT JOIN filings f ON f.ticker = t.ticker AND f.filing_date < d GROUP BY d, t.ticker""",
)
oracle("earnings_yield", EY, _VIEW.format("earnings_yield"))
oracle("earnings_yield_reasons", EY, _REASONS.format("earnings_yield"))


def _lags(section: str, column: str) -> str:
    return f"""SELECT '{section}' AS section, item, value FROM (
  SELECT CAST(trunc(quantile_cont({column}, 0.5)) AS BIGINT) AS median,
         CAST(trunc(quantile_cont({column}, 0.9)) AS BIGINT) AS p90,
         CAST(max({column}) AS BIGINT) AS max, count({column}) AS n FROM ttm)
UNPIVOT (value FOR item IN (median, p90, max, n))"""


oracle(
    "filing_lag_stats",
    FILED,
    _lags("latest_filing_lag_days", "latest_lag_days")
    + " UNION ALL "
    + _lags("oldest_ttm_component_lag_days", "oldest_lag_days"),
)


def _rules(table: str, relation: str, rules: dict[str, str]) -> str:
    """One row per rule; a NULL condition counts as broken."""
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule,"
        f" count(*) FILTER (WHERE NOT coalesce({holds}, false)) AS broken_rows, count(*) AS total_rows FROM {relation}"
        for rule, holds in rules.items()
    )


_BAR_RULES = {
    "ticker_length": "length(ticker) BETWEEN 1 AND 16",
    "exchange_known": "exchange IN ('NYSE', 'AMEX', 'NASDAQ')",
    "ticker_type_known": "ticker_type IN ('CS', 'PFD', 'OTHER')",
    "raw_close_positive": "raw_close > 0",
    "adj_close_positive": "adj_close > 0",
    "shares_out_positive": "shares_out > 0",
    "mcap_positive": "mcap > 0",
    "volume_not_negative": "volume >= 0",
    "common_share_matches_type": "is_common_share = (ticker_type = 'CS')",
}
oracle(
    "dq_summary",
    f"{FLAGS} quarters filings {MEMBERS} metadata aliases artifacts candidates",
    " UNION ALL ".join(
        [
            _rules("daily_bars", "bars", _BAR_RULES),
            _rules(
                "universe_flags",
                "flags",
                {
                    "eligible_means_all_rules": "fail_reason IS NOT NULL OR (price_ok AND history_ok AND exchange_ok"
                    " AND common_share_ok)",
                    "reason_iff_not_eligible": "true",
                },
            ),
            _rules(
                "membership",
                "membership",
                {
                    "ticker_present": "ticker IS NOT NULL",
                    "added_present": "date_added IS NOT NULL",
                    "removed_not_before_added": "date_removed IS NULL OR date_removed >= date_added",
                },
            ),
            _rules(
                "metadata",
                "metadata",
                {
                    "ticker_length": "length(ticker) BETWEEN 1 AND 16",
                    "delisted_not_before_listed": "delisted_date IS NULL OR list_date IS NULL"
                    " OR delisted_date >= list_date",
                },
            ),
            _rules(
                "aliases",
                "aliases",
                {
                    "to_not_before_from": "effective_to IS NULL OR effective_from IS NULL"
                    " OR effective_to >= effective_from"
                },
            ),
            _rules(
                "filings",
                "filings",
                {
                    "ticker_present": "ticker IS NOT NULL",
                    "filing_date_present": "filing_date IS NOT NULL",
                    "period_end_date_present": "period_end_date IS NOT NULL",
                    "period_kind_present": "period_kind IS NOT NULL",
                    "filed_not_before_period_end": "filing_date >= period_end_date",
                    "period_kind_known": "period_kind IN ('quarterly', 'annual', 'trailing_twelve_months')",
                    "quarter_matches_kind": "(period_kind = 'quarterly') = (fiscal_quarter IS NOT NULL)",
                },
            ),
            _rules(
                "candidates",
                "candidates",
                {
                    "name_present": "length(candidate_name) >= 1",
                    "formula_present": "length(formula_string) >= 1",
                    "snapshot_present": "length(data_snapshot_id) >= 1",
                    "status_known": "c_custkey % 40 <> 7",
                    "type_known": "true",
                },
            ),
            _rules(
                "artifacts",
                "artifacts",
                {
                    "path_present": "length(path) >= 1",
                    "checksum_hex": "length(checksum) = 64",
                    "type_known": "artifact_type IN ('panel', 'factor')",
                },
            ),
            _rules("experiments", "nation", {"name_present": "length(n_name) >= 1", "config_hash_hex": "true", "code_id_length": "true"}),
            _rules(
                "metrics",
                "customer",
                {"name_present": "c_custkey % 30 <> 1", "horizon_positive": "c_custkey % 4 = 0 OR c_custkey % 25 >= 1"},
            ),
        ]
    ),
)
oracle(
    "dq_violations",
    PRICES,
    "SELECT date, ticker, broken_rules FROM (SELECT date, ticker, concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT coalesce({holds}, false) THEN '{rule}' END" for rule, holds in _BAR_RULES.items())
    + ") AS broken_rules FROM bars) WHERE broken_rules <> ''",
)
oracle(
    "factor_rules",
    MOM,
    " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE NOT coalesce({holds}, false)) AS broken_rows,"
        " count(*) AS total_rows FROM mom_12_1"
        for rule, holds in {
            "valid_iff_finite": "valid_flag = (raw_value IS NOT NULL AND winsorized_value IS NOT NULL"
            " AND zscore_value IS NOT NULL)",
            "tradable_means_valid": "NOT tradable_flag OR valid_flag",
            "valid_iff_no_reason": "valid_flag = (invalid_reason IS NULL)",
            "reason_known": "invalid_reason IS NULL OR invalid_reason = 'history_ineligible'",
        }.items()
    ),
)
oracle(
    "key_duplicates",
    "",
    """SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, count(*) AS rows FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""",
)
oracle(
    "fk_violations",
    "",
    """SELECT 'artifacts' AS table_name, 'art-' || o_orderkey AS row_id, 'cand-' || o_custkey AS parent_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 40 <> 7)
UNION ALL SELECT 'metrics', 'metric-' || c_custkey, 'cand-' || c_custkey FROM customer WHERE c_custkey % 40 = 7
UNION ALL SELECT 'candidates', 'cand-' || c_custkey, 'exp-' || c_nationkey FROM customer WHERE c_nationkey % 6 = 5""",
)
oracle(
    "key_violations",
    "metadata",
    """SELECT ticker, count(*) AS rows FROM (SELECT ticker FROM metadata UNION ALL SELECT ticker FROM metadata WHERE cik % 3 = 0)
GROUP BY ticker HAVING count(*) > 1""",
)
oracle(
    "snapshot_floors",
    "metadata",
    """SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, count(delisted_date) AS delisted,
       count(*) >= 500 AND count(DISTINCT ticker) >= 400 AND count(delisted_date) >= 50 AS ok FROM metadata""",
)
oracle(
    "ledger_provenance",
    "artifacts candidates",
    """SELECT candidate_id, candidate_name, formula_string, data_snapshot_id, config_hash, git_sha, artifact_id,
       artifact_type, path, checksum FROM candidates LEFT JOIN artifacts USING (candidate_id)""",
)
_LEDGER = "artifacts candidates outcomes"
oracle("artifact_verify", _LEDGER, "SELECT candidate_id, path, outcome FROM outcomes")


def _verdict(checked: bool) -> str:
    match = "config_hash = sha256('config 1')" if checked else "false"
    current = "sha256('config 1')" if checked else "'<skipped>'"
    return f"""SELECT *, artifacts_failed = 0 AND artifacts_verified > 0
       AND {"config_hash_match" if checked else "true"} AND git_sha_available AS all_ok
FROM (SELECT candidate_id, count(*) FILTER (WHERE outcome = 'verified') AS artifacts_verified,
             count(*) FILTER (WHERE outcome <> 'verified') AS artifacts_failed,
             count(*) FILTER (WHERE outcome = 'file_missing') AS file_missing,
             count(*) FILTER (WHERE outcome = 'checksum_mismatch') AS checksum_mismatch,
             count(*) FILTER (WHERE outcome = 'no_artifacts_recorded') AS no_artifacts_recorded,
             config_hash AS config_hash_recorded, {current} AS config_hash_current, {str(checked).lower()} AS config_hash_checked,
             {match} AS config_hash_match, git_sha AS git_sha_recorded, n_nationkey % 6 <> 5 AS git_sha_available
      FROM outcomes JOIN candidates USING (candidate_id)
      GROUP BY candidate_id, config_hash, git_sha, n_nationkey)"""


oracle("verify_verdict", _LEDGER, _verdict(True))
oracle("verify_without_config", _LEDGER, _verdict(False))
oracle(
    "recent_ledger_rows",
    "artifacts",
    """SELECT artifact_id, candidate_id, artifact_type, path, checksum FROM artifacts
ORDER BY o_orderdate DESC, artifact_id DESC LIMIT 4""",
)
_DATED = "ticker IN (SELECT 'S' || ticker[2:] FROM anchor_members)"
oracle(
    "dated_slice",
    f"{MOM} {MEMBERS} anchor_members",
    f"""SELECT ticker, count(*) AS rows, count(*) FILTER (WHERE valid) AS valid_rows FROM (
  SELECT ticker, mom IS NOT NULL AND stddev_pop(w) OVER (PARTITION BY date) > 0 AS valid FROM (
    SELECT f.date, f.ticker, mom, CASE WHEN mom IS NOT NULL THEN least(greatest(mom, lo), hi) END AS w FROM flags f LEFT JOIN (
      SELECT date, quantile_cont(mom, 0.01) AS lo, quantile_cont(mom, 0.99) AS hi FROM flags WHERE {_DATED} AND mom IS NOT NULL GROUP BY date) q
    ON q.date = f.date WHERE {_DATED})) GROUP BY ticker""",
)
_FIXED = " ".join(f"WHEN 'S{i + 1}' THEN '{n}'" for i, n in enumerate(("AAPL", "MSFT", "GOOGL", "AMZN", "NVDA", "META", "JPM", "JNJ")))
oracle(
    "fixed_slice",
    FLAGS,
    f"""SELECT CASE ticker {_FIXED} END AS ticker, count(*) AS rows, count(*) FILTER (WHERE valid) AS valid_rows FROM (
  SELECT ticker, mom IS NOT NULL AND stddev_pop(w) OVER (PARTITION BY date) > 0 AS valid FROM (
    SELECT f.date, f.ticker, mom, CASE WHEN mom IS NOT NULL THEN least(greatest(mom, lo), hi) END AS w FROM flags f LEFT JOIN (
      SELECT date, quantile_cont(mom, 0.01) AS lo, quantile_cont(mom, 0.99) AS hi FROM flags
      WHERE mom IS NOT NULL AND ticker IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8') GROUP BY date) q
    ON q.date = f.date WHERE ticker IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6', 'S7', 'S8'))) GROUP BY ticker""",
)
_BOTH = f"{EY} mom_clipped mom_12_1"
oracle(
    "multi_slice",
    _BOTH,
    f"""SELECT *, CAST(2 AS BIGINT) AS artifacts, CAST(2 AS BIGINT) AS paths, CAST(1 AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS experiments
FROM ({_VIEW.format("mom_12_1")} UNION ALL {_VIEW.format("earnings_yield")})""",
)
oracle(
    "factor_notes",
    _BOTH,
    f"""SELECT 'mom_12_1' AS factor_name, 'invalid_reason_counts' AS section, invalid_reason AS item, rows AS value FROM ({_REASONS.format("mom_12_1")})
UNION ALL SELECT 'earnings_yield', 'invalid_reason_counts', invalid_reason, rows FROM ({_REASONS.format("earnings_yield")})
UNION ALL SELECT 'earnings_yield', * FROM ({_lags("latest_filing_lag_days", "latest_lag_days")} UNION ALL {_lags("oldest_ttm_component_lag_days", "oldest_lag_days")})""",
)
oracle(
    "verify_changed_files",
    "",
    """SELECT candidate_name, artifacts_verified, artifacts_failed, file_missing, checksum_mismatch, false AS all_ok
FROM (VALUES ('mom_12_1', 1::BIGINT, 1::BIGINT, 0::BIGINT, 1::BIGINT), ('earnings_yield', 0, 2, 1, 1))
  v(candidate_name, artifacts_verified, artifacts_failed, file_missing, checksum_mismatch)""",
)

# Registers its SQL in PARTS and ORACLE.
from strictpast.testbed import evaluation_oracle  # noqa: E402, F401
