"""Contract-shaped tables derived from the general test tables by fixed rules.

Suppliers play traded tickers (``S<key>``), line items their trades and quarterly results;
users in ``events`` play index members (``U<id>``), customers the listed symbols, orders the
recorded artifacts. Money is summed as whole cents so that every engine gets equal sums.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strictpast.contracts import CANDIDATES, EXPERIMENTS, FUNDAMENTALS, METRICS, conform
from strictpast.plans import membership as idx
from strictpast.plans.bars import stamp_details
from strictpast.plans.ledger import Ledger
from strictpast.plans.panel import UniverseRules
from strictpast.session import stage
from strictpast.sources import index_pages

RULES = UniverseRules(price_floor=2000.0)
FIRST_DAY = date(1995, 1, 1)
LAST_DAY = date(2001, 12, 31)


def sym(prefix: str, key) -> object:
    return F.concat(F.lit(prefix), key.cast("string"))


class Tables:
    """Lazy views over one scale factor's Parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._changes: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- prices -------------------------------------------------------------------

    def trade_days(self, lines: DataFrame | None = None) -> DataFrame:
        """(k, date, cents, qty, net): exact sums per supplier and day."""
        li = self.read("lineitem") if lines is None else lines
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        share = F.lit(100).cast("bigint") - F.rint(F.col("l_discount") * 100).cast("bigint")
        return li.groupBy(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("date")).agg(
            F.sum(cents).alias("cents"),
            F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
            F.sum(cents * share).alias("net"),
        )

    def adjusted_feed(self) -> DataFrame:
        return self.trade_days().select(
            sym("S", F.col("k")).alias("ticker"),
            "date",
            (F.col("net") / F.col("qty") / 10000.0).alias("close"),
            F.col("qty").cast("double").alias("volume"),
        )

    def raw_feed(self) -> DataFrame:
        """Returned lines are not in the raw feed, so some days exist in one feed only."""
        li = self.read("lineitem")
        return self.trade_days(li.where(F.col("l_returnflag") != "R")).select(
            sym("S", F.col("k")).alias("ticker"),
            "date",
            (F.col("cents") / F.col("qty") / 100.0).alias("close"),
            F.col("qty").cast("double").alias("volume"),
        )

    def details(self) -> DataFrame:
        """Ticker details per supplier; every mapped and unmapped code occurs."""
        s, n = self.read("supplier"), self.read("nation")
        k, region = F.col("s_suppkey"), F.col("n_regionkey")
        venue = F.when(region == 1, "XASE").when(region == 2, "XNAS").when(region == 3, "XOTC")
        kind = F.when(k % 11 == 0, "PFD").when(k % 13 == 0, "ZZZ").when(k % 17 == 0, None)
        return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
            sym("S", k).alias("ticker"),
            venue.otherwise("XNYS").alias("primary_exchange"),
            kind.otherwise("CS").alias("type"),
            F.when(k % 19 != 0, F.col("s_acctbal")).alias("weighted_shares_outstanding"),
        )

    def bars(self) -> DataFrame:
        priced = self.trade_days().select(
            sym("S", F.col("k")).alias("ticker"),
            "date",
            (F.col("net") / F.col("qty") / 10000.0).alias("adj_close"),
            (F.col("cents") / F.col("qty") / 100.0).alias("raw_close"),
            F.col("qty").cast("double").alias("volume"),
        )
        return stamp_details(priced, self.details())

    # --- filings ------------------------------------------------------------------

    def quarters(self) -> DataFrame:
        """(k, fy, fq, net, gross, tax, o, pe): results per supplier and calendar quarter."""
        li = self.read("lineitem")
        day = F.to_date("l_shipdate")
        cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
        share = F.lit(100).cast("bigint") - F.rint(F.col("l_discount") * 100).cast("bigint")
        tax = F.rint(F.col("l_tax") * 100).cast("bigint")
        base = li.groupBy(
            F.col("l_suppkey").alias("k"), F.year(day).alias("fy"), F.quarter(day).alias("fq")
        ).agg(
            F.sum(cents * share).alias("net"),
            F.sum(cents).alias("gross"),
            F.sum(cents * tax).alias("tax"),
        )
        return base.withColumns(
            {
                "o": F.col("fy") * 4 + F.col("fq"),
                "pe": F.last_day(F.make_date("fy", F.col("fq") * 3, F.lit(1))),
            }
        )

    @staticmethod
    def _cik(k, fy):
        return F.when(k % 23 == 0, None).when((k % 25 == 0) & (fy >= 1998), k + 200000).otherwise(k + 100000)

    def filings(self) -> DataFrame:
        """Originals, restatements, gaps, missing values, reused ids, and yearly trap rows."""
        # Read twice: the line items behind it are summed once.
        q = stage(self.quarters().drop("tax"), "quarters")
        k, o = F.col("k"), F.col("o")
        hole = (k + o) % 17 == 0
        net = F.when(~hole, F.col("net"))

        def report(delay: int, extra: int) -> object:
            return F.struct(
                F.date_add(F.col("pe"), (k % 20 + 35 + delay).cast("int")).alias("filing_date"),
                ((net + extra * 100) / 10000.0).alias("net_income"),
                ((F.col("gross") + extra) / 100.0).alias("revenues"),
            )

        versions = F.array_compact(
            F.array(report(0, 0), F.when((k + o) % 7 == 0, report(30, 10000)))
        )
        quarterly = q.where(~hole | (k % 3 == 0)).select(
            "k",
            "fy",
            F.col("fq").alias("fiscal_quarter"),
            F.col("pe").alias("period_end_date"),
            F.lit("quarterly").alias("period_kind"),
            F.inline(versions),
        )
        year = q.groupBy("k", "fy").agg(F.sum("net").alias("net"), F.sum("gross").alias("gross"))
        end = F.make_date("fy", F.lit(12), F.lit(31))

        def yearly(kind: str, delay: int, net_income, revenues) -> object:
            return F.struct(
                F.lit(kind).alias("period_kind"),
                F.date_add(end, (k % 20 + delay).cast("int")).alias("filing_date"),
                net_income.alias("net_income"),
                revenues.alias("revenues"),
            )

        traps = F.array(
            yearly("annual", 60, F.col("net") / 10000.0, F.col("gross") / 100.0),
            yearly("trailing_twelve_months", 61, F.lit(99999.0), F.lit(99999.0)),
        )
        annual = year.select("k", "fy", end.alias("period_end_date"), F.inline(traps))
        rows = quarterly.unionByName(annual, allowMissingColumns=True)
        return conform(
            rows.select(
                "*",
                sym("S", k).alias("ticker"),
                self._cik(k, F.col("fy")).alias("cik"),
                F.col("fy").alias("fiscal_year"),
                F.array(F.lit("income_statements")).alias("source_endpoints"),
            ),
            FUNDAMENTALS,
        )

    def stored_filings(self) -> DataFrame:
        """Filings as a stored table, which is how lookups get them."""
        return stage(self.filings(), "filings")

    def statement_feed(self, tag: str) -> DataFrame:
        """Raw records of one statement feed, with every oddity the projection settles."""
        k, o = F.col("k"), F.col("o")
        own = sym("S", k)
        listed = (
            F.when(k % 5 == 0, F.array(sym("X", k), own))
            .when(k % 5 == 1, F.array(sym("Y", k)))
            .when(k % 5 == 2, F.array().cast("array<string>"))
            .when(k % 5 == 4, F.array(own))
        )
        shift = {"income_statements": 0, "balance_sheets": 3, "cash_flow_statements": -2}[tag]
        filed = F.date_add(F.col("pe"), (k % 20 + 35 + shift).cast("int"))
        values = {
            "income_statements": [
                (F.col("gross") / 100.0).alias("revenue"),
                (F.col("net") / 10000.0).alias("net_income_loss_attributable_common_shareholders"),
            ],
            "balance_sheets": [
                (F.col("gross") / 200.0).alias("total_equity_attributable_to_parent"),
                (F.col("gross") / 50.0).alias("total_assets"),
            ],
            "cash_flow_statements": [(F.col("tax") / 10000.0).alias("net_cash_from_operating_activities")],
        }[tag]
        kept = {
            "income_statements": F.lit(True),
            "balance_sheets": (k + o) % 4 != 0,
            "cash_flow_statements": (k + o) % 5 != 0,
        }[tag]
        return self.quarters().where(kept).select(
            own.alias("requested"),
            listed.alias("tickers"),
            F.when(k % 23 == 0, F.lit("")).otherwise(F.format_string("%010d", k + 100000)).alias("cik"),
            F.concat(filed.cast("string"), F.lit("T00:00:00Z")).alias("filing_date"),
            F.when(k % 29 == 0, F.lit("bad")).otherwise(F.col("pe").cast("string")).alias("period_end"),
            F.col("fy").alias("fiscal_year"),
            F.col("fq").alias("fiscal_quarter"),
            F.when((F.col("fq") == 4) & (k % 7 == 0), "weird").otherwise("quarterly").alias("timeframe"),
            *values,
        )

    def filing_universe(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.read("supplier").select(
            sym("S", k).alias("ticker"), F.when(k % 6 == 0, F.lit(date(2000, 6, 30))).alias("ref_date")
        )

    # --- index membership -----------------------------------------------------------

    def days(self) -> DataFrame:
        return self.read("events").select(F.to_date("ts").alias("date")).distinct()

    def users(self) -> DataFrame:
        return self.read("events").select(F.col("user_id").alias("u")).distinct()

    def changes_page(self) -> DataFrame:
        """Change log with a two-level header, padded symbols and unreadable dates."""
        e, u, n = self.read("events"), F.col("user_id"), F.col("event_id")
        day = F.to_date("ts")
        text = F.when(n % 2 == 0, day.cast("string")).otherwise(F.date_format(day, "MMMM d, yyyy"))
        ticker, name = F.concat(F.lit(" U"), u, F.lit(" ")), F.concat(F.lit("User "), u, F.lit("/"), n % 3)

        def side(kind: str, label: str):
            mine = F.col("event_type") == kind
            return F.struct(
                F.when(mine, ticker).alias("Ticker"), F.when(mine, name).alias("Security")
            ).alias(label)

        return e.select(
            F.struct(F.when(n % 97 == 0, "TBD").otherwise(text).alias("Effective Date")).alias("Effective Date"),
            side("signup", "Added"),
            side("error", "Removed"),
            F.col("event_id").alias("seq"),
        )

    def current_page(self) -> DataFrame:
        e, u = self.read("events"), F.col("user_id")
        first = e.where((F.col("event_type") == "signup") & (u % 3 == 0)).groupBy("user_id").agg(
            F.to_date(F.min("ts")).alias("day")
        )
        return first.select(
            F.concat(F.lit(" U"), u).alias("Symbol"),
            F.concat(F.lit("Member "), u).alias("Security"),
            F.concat(F.lit("Sector "), u % 5).alias("GICS Sector"),
            F.concat(F.lit("Sub "), u % 7).alias("GICS Sub-Industry"),
            F.when(u % 31 == 0, "unknown").otherwise(F.col("day").cast("string")).alias("Date added"),
            F.when(u % 4 == 0, "n/a").otherwise(F.format_string("%010d", u)).alias("CIK"),
        )

    def changes(self) -> DataFrame:
        return index_pages.normalize_changes(self.changes_page())

    def stored_changes(self) -> DataFrame:
        """The change log as a stored table: its dates are parsed once for all that reads it."""
        if self._changes is None:
            self._changes = stage(self.changes(), "changes")
        return self._changes

    def current(self) -> DataFrame:
        return index_pages.normalize_current(self.current_page())

    def patches(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        users, u = self.users(), F.col("u")
        none = F.lit(None).cast("date")
        updates = users.where((u % 10).isin(1, 2)).select(
            sym("U", u).alias("ticker"),
            F.when(u % 10 == 1, F.lit(date(2023, 12, 15))).alias("date_added"),
            F.when(u % 10 == 2, F.lit(date(2024, 2, 15))).alias("date_removed"),
        )
        adds = users.where(u % 10 == 4).select(
            sym("X", u).alias("ticker"),
            sym("Added ", u).alias("name"),
            F.lit(date(2024, 1, 3)).alias("date_added"),
            F.lit(date(2024, 1, 17)).alias("date_removed"),
        )
        deletes = users.where(u % 10 == 6).select(
            sym("U", u).alias("ticker"), F.lit(date(2024, 1, 1)).alias("date_added"), none.alias("date_removed")
        )
        return updates, adds, deletes

    def ordered_patches(self) -> DataFrame:
        """Fields set twice in order, rows added and then completed, dropped rows, and patches that meet nothing."""
        u = F.col("u")
        jan = lambda d: F.lit(date(2024, 1, d))

        def patch(test, position, op, ticker, field=None, value=None, added=None):
            return F.when(
                test,
                F.struct(
                    F.lit(position).alias("position"), F.lit(op).alias("op"), ticker.alias("ticker"),
                    (added if added is not None else F.lit(None)).cast("date").alias("date_added"),
                    F.lit(None).cast("date").alias("date_removed"),
                    F.lit(field).cast("string").alias("field"),
                    (value if value is not None else F.lit(None)).cast("string").alias("value"),
                ),
            )

        own, eight, nine = sym("U", u), u % 10 == 8, u % 10 == 9
        rows = F.array(
            patch(eight, 12, "update", own, "name", sym("Second ", u)),
            patch(eight, 11, "update", own, "name", sym("First ", u)),
            patch(eight, 13, "update", own, "wiki_sector", F.lit("Moved")),
            patch(eight, 14, "update", own, "wiki_sector", F.lit("Moved again")),
            patch(eight, 15, "update", own, "date_removed", F.lit("2024-02-20")),
            patch(eight, 16, "update", own, "date_removed", F.lit("2024-02-21")),
            patch(nine, 21, "add", own, added=jan(5)),
            patch(nine, 22, "update", own, "name", sym("New ", u), jan(5)),
            patch(nine, 23, "update", own, "cik_code", u, jan(5)),
            patch(u % 10 == 5, 31, "delete", own),
            patch(u % 10 == 5, 32, "update", own, "name", F.lit("too late")),
            patch(u % 10 == 7, 41, "update", sym("Q", u), "name", F.lit("nobody")),
            patch(eight, 42, "update", own, "no_field", F.lit("x")),
        )
        return self.users().select(F.inline(F.array_compact(rows)))

    def intervals(self) -> DataFrame:
        return idx.membership_intervals(self.current(), self.changes())[0]

    def membership(self) -> DataFrame:
        current, changes = stage(self.current(), "current"), self.stored_changes()
        enriched = idx.enrich_intervals(idx.membership_intervals(current, changes)[0], current, changes)
        return idx.apply_patches(enriched, *self.patches())

    def stored_membership(self) -> DataFrame:
        return stage(self.membership(), "membership")

    # --- securities -------------------------------------------------------------------

    def metadata(self) -> DataFrame:
        c, o, k = self.read("customer"), self.read("orders"), F.col("k")
        first = o.groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("first"))
        shifted = F.date_add(F.lit(date(2023, 12, 20)), F.date_diff("first", F.lit(FIRST_DAY)) % 30)
        base = c.withColumnRenamed("c_custkey", "k").join(first, "k")
        symbols = F.array_compact(
            F.array(
                F.when(k % 9 != 0, sym("U", k)),
                F.when((k % 10).isin(3, 5, 7) & (k % 20 < 10), sym("V", k)),
                F.when(k % 10 == 5, sym("W", k)),
            )
        )
        return base.select(
            F.explode(symbols).alias("ticker"),
            F.col("c_name").alias("name"),
            F.lit("XNYS").alias("primary_exchange"),
            F.lit("CS").alias("ticker_type"),
            F.when(k % 8 != 5, shifted).alias("list_date"),
            F.when(k % 4 == 0, F.date_add(shifted, (k % 15 + 10).cast("int"))).alias("delisted_date"),
            (k % 7000 + 1000).cast("string").alias("sic_code"),
            F.when(k % 6 != 0, F.col("c_mktsegment")).alias("sic_description"),
            (k + 300000).alias("cik"),
        )

    def aliases(self) -> DataFrame:
        """Renames: single, chained, late-starting, colliding, and a few overlapping ones."""
        k = F.col("c_custkey")

        def row(test, prefix_or_symbol, start, end):
            symbol = sym(prefix_or_symbol, k) if isinstance(prefix_or_symbol, str) else prefix_or_symbol
            as_date = lambda d: d if not isinstance(d, (date, type(None))) else F.lit(d).cast("date")
            return F.when(
                test,
                F.struct(
                    symbol.alias("alias"),
                    as_date(start).alias("effective_from"),
                    as_date(end).alias("effective_to"),
                ),
            )

        jan = lambda d: date(2024, 1, d)
        rows = F.array_compact(
            F.array(
                row(k % 10 == 3, "V", None, F.date_add(F.lit(jan(10)), (k % 7).cast("int"))),
                row(k % 10 == 5, "W", None, jan(8)),
                row(k % 10 == 5, "V", jan(8), jan(18)),
                row(k % 10 == 7, "V", jan(5), jan(20)),
                row(k % 50 == 21, sym("U", k + 1), None, jan(15)),
                row(k % 100 == 47, "W", jan(10), jan(12)),
            )
        )
        return self.read("customer").select(
            sym("U", k).alias("canonical_ticker"), F.inline(rows)
        ).withColumn("note", F.lit(""))

    def holdings(self) -> DataFrame:
        k = F.col("c_custkey")
        odd = F.when(k % 13 == 0, sym("U-", k)).when(k % 17 == 0, F.lit("  ")).when(
            k % 19 == 0, F.concat(F.lit("U."), k)
        )
        return self.read("customer").select(
            odd.otherwise(F.concat(F.lit(" U"), k)).alias("Ticker"),
            F.col("c_name").alias("Name"),
            F.lit("n/a").alias("Sector"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "Cash").otherwise("Equity").alias("Asset Class"),
        )

    # --- ledger -------------------------------------------------------------------------

    def _checksum(self, salt: str):
        cents = F.rint(F.col("o_totalprice") * 100).cast("bigint")
        return F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus", cents, F.lit(salt)), 256)

    def ledger(self) -> Ledger:
        n, c, o = self.read("nation"), self.read("customer"), self.read("orders")
        nk, ck = F.col("n_nationkey").cast("bigint"), F.col("c_custkey")
        epoch = F.lit(date(2024, 1, 1))
        experiments = n.select(
            sym("exp-", nk).alias("experiment_id"),
            F.col("n_name").alias("name"),
            F.sha2(F.concat(F.lit("config "), (F.col("n_regionkey") % 3).cast("string")), 256).alias("config_hash"),
            F.substring(F.sha2(F.concat(F.lit("code "), nk), 256), 1, 40).alias("git_sha"),
            F.date_add(epoch, nk.cast("int")).cast("timestamp").alias("created_at"),
        )
        candidates = c.select(
            sym("cand-", ck).alias("candidate_id"),
            sym("exp-", F.col("c_nationkey")).alias("experiment_id"),
            F.lit("mom_12_1").alias("candidate_name"),
            F.lit("deterministic_factor").alias("candidate_type"),
            F.lit("log(P[t-21] / P[t-252])").alias("formula_string"),
            F.sha2(F.concat(F.lit("data "), ck), 256).alias("data_snapshot_id"),
            F.when(ck % 40 == 7, "lost").otherwise("computed").alias("status"),
            F.date_add(epoch, (ck % 300).cast("int")).cast("timestamp").alias("created_at"),
            F.date_add(epoch, (ck % 300).cast("int")).cast("timestamp").alias("updated_at"),
        )
        artifacts = o.select(
            sym("art-", F.col("o_orderkey")).alias("artifact_id"),
            sym("cand-", F.col("o_custkey")).alias("candidate_id"),
            F.when(F.col("o_orderkey") % 2 == 0, "panel").otherwise("factor").alias("artifact_type"),
            F.concat(F.lit("/artifacts/"), F.col("o_orderkey")).alias("path"),
            self._checksum("").alias("checksum"),
            F.to_timestamp(F.to_date("o_orderdate")).alias("created_at"),
        )
        return Ledger(conform(experiments, EXPERIMENTS), conform(candidates, CANDIDATES), artifacts)

    def recomputed(self) -> DataFrame:
        """What storage holds now: every 97th artifact gone, every 89th changed."""
        k = F.col("o_orderkey")
        return self.read("orders").where(k % 97 != 0).select(
            F.concat(F.lit("/artifacts/"), k).alias("path"),
            F.when(k % 89 == 0, self._checksum("x")).otherwise(self._checksum("")).alias("checksum"),
        )

    def metrics(self) -> DataFrame:
        """A metric for each customer's candidate; some names are empty and some horizons are not positive."""
        ck = F.col("c_custkey")
        rows = self.read("customer").select(
            sym("metric-", ck).alias("metric_id"), sym("cand-", ck).alias("candidate_id"),
            F.when(ck % 30 == 1, F.lit("")).otherwise(F.lit("ic")).alias("metric_name"), F.col("c_acctbal").alias("value"),
            F.lit("all").alias("fold"), F.when(ck % 4 != 0, (ck % 25).cast("int")).alias("horizon"),
            F.lit(None).cast("timestamp").alias("created_at"),
        )
        return conform(rows, METRICS)

    def known_code(self) -> DataFrame:
        nk = F.col("n_nationkey")
        return self.read("nation").where(nk % 6 != 5).select(
            F.substring(F.sha2(F.concat(F.lit("code "), nk.cast("bigint")), 256), 1, 40).alias("git_sha")
        )
