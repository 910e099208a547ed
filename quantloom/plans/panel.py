"""Canonical daily tables as deterministic views over the driver's tables.

Prices are damped unit prices, rounded where they are made, so that every
engine computes on from equal numbers.  ``SQL`` holds the same tables as DuckDB
common table expressions.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.columns import rounded, zfill
from quantloom.sources.staging import for_input


def _brand(col: str = "p_brand"):
    return zfill(F.substring(F.col(col), 7, 10), 6)


def _unit(x):
    return rounded(F.lit(100.0) + F.lit(0.01) * x)


class Panel:
    """Lazy canonical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, several: bool = False) -> None:
        """``several``: the query reads the facts more than once, so they are staged."""
        self.spark, self.dir, self.several = spark, sf_dir, several
        self.kept: dict[str, DataFrame] = {}

    def keep(self, name: str, build, make: bool = True) -> DataFrame | None:
        """A derived table that is staged once for every query on this folder's files."""
        if name not in self.kept:
            found = for_input(self.spark, self.dir, name, build, make=make)
            if found is None:
                return None
            self.kept[name] = found
        return self.kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Lineitem with brand; the part side is a dimension that Spark broadcasts below its threshold."""
        part = self.table("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("date", F.to_date("l_shipdate")).withColumn("symbol", _brand())

    @cached_property
    def symbols(self) -> DataFrame:
        from pyspark.sql import Window

        kinds = self.table("part").groupBy(_brand().alias("symbol"), F.col("p_type").alias("sector")).agg(F.count(F.lit(1)).alias("n"))
        best = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("n"), "sector"))
        market = F.when(F.col("symbol").cast("int") % 5 < 3, "MAIN").otherwise("GROWTH")
        return kinds.withColumn("rn", best).where("rn = 1").select("symbol", F.concat(F.lit("Brand "), "symbol").alias("name"), market.alias("market"), "sector")

    @cached_property
    def facts(self) -> DataFrame:
        """Prices, metrics and flows of each (date, symbol) from one pass over the lines: a row a day and symbol.

        Staged for queries that read them more than once; others take what is
        staged already, or aggregate the columns that they need.
        """
        held = self.keep("facts", self._facts, make=self.several)
        return self._facts() if held is None else held

    def _facts(self) -> DataFrame:
        unit = F.col("l_extendedprice") / F.col("l_quantity")
        first = F.min_by(unit, F.col("l_orderkey") * 10 + F.col("l_linenumber"))
        signed = F.col("l_extendedprice") * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
        net = lambda flag, name: rounded(F.sum(F.when(F.col("l_returnflag") == flag, signed).otherwise(0.0)), 2).alias(f"{name}_net_value")
        total, quantity = F.sum("l_extendedprice"), F.sum("l_quantity")
        close = _unit(total / quantity)
        return self.lines.groupBy("date", "symbol").agg(
            _unit(first).alias("open"),
            _unit(F.max(unit)).alias("high"),
            _unit(F.min(unit)).alias("low"),
            close.alias("close"),
            quantity.alias("volume"),
            rounded(total, 2).alias("trading_value"),
            total.alias("total"),
            rounded(F.sum(F.col("p_retailprice") * F.col("l_quantity")), 2).alias("market_cap"),
            rounded(close / F.avg("p_size")).alias("per"),
            rounded(close / F.avg("p_retailprice")).alias("pbr"),
            rounded(F.avg("l_tax")).alias("eps"),
            rounded(F.avg(F.col("l_discount") + F.col("l_tax"))).alias("bps"),
            rounded(F.avg("l_discount")).alias("dividend_yield"),
            net("A", "foreign"),
            net("N", "institution"),
            net("R", "retail"),
        )

    @cached_property
    def prices(self) -> DataFrame:
        return self.facts.select("date", "symbol", "open", "high", "low", "close", "volume", "trading_value")

    @cached_property
    def index(self) -> DataFrame:
        """benchmark (market) and close by date."""
        own = self.facts.join(self.symbols.select("symbol", "market"), "symbol")
        return own.groupBy("date", F.col("market").alias("benchmark")).agg(_unit(F.sum("total") / F.sum("volume")).alias("close"))

    @cached_property
    def metrics(self) -> DataFrame:
        return self.facts.select("date", "symbol", "market_cap", "per", "pbr", "eps", "bps", "dividend_yield")

    @cached_property
    def flows(self) -> DataFrame:
        return self.facts.select("date", "symbol", "foreign_net_value", "institution_net_value", "retail_net_value")

    @cached_property
    def pension(self) -> DataFrame:
        """A fourth investor's flows: the institutions' lines with a discount above 5 %."""
        signed = F.col("l_extendedprice") * F.when(F.col("l_linestatus") == "O", 1.0).otherwise(-1.0)
        return self.lines.where("l_returnflag = 'N' and l_discount > 0.05").groupBy("date", "symbol").agg(rounded(F.sum(signed), 2).alias("pension_net_value"))

    @cached_property
    def reports(self) -> DataFrame:
        from pyspark.sql import Window

        orders = self.table("orders").join(self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        brand = F.col("c_nationkey") % 25 + 1
        now = F.round(F.lit(100.0) + F.col("o_totalprice") % 500 / 10 + 1e-9, 4)
        own = orders.select(
            F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("report_date"), zfill(brand.cast("string"), 6).alias("symbol"),
            F.col("c_mktsegment").alias("broker"), (F.col("c_custkey") % 40).alias("analyst"), now.alias("price"),
            F.round(now * (F.lit(0.8) + F.col("o_orderkey") % 100 / F.lit(200.0)) + 1e-9, 4).alias("target"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Buy").when(F.col("o_orderpriority") != "5-LOW", "Hold").alias("rating"),
        )
        before = F.lag("target").over(Window.partitionBy("symbol", "analyst").orderBy("report_date", "report_id"))
        return own.withColumn("previous_target", before)

    @cached_property
    def posts(self) -> DataFrame:
        ev = self.table("events")
        return ev.select(
            F.col("event_type").alias("channel"), F.col("event_id").alias("message_id"), F.col("ts").alias("ts"), F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"),
            F.round(F.col("value") / 250 - 1 + 1e-9, 4).alias("sentiment"), F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "purchase", 0.6).otherwise(0.3).alias("urgency"),
            F.when(F.col("event_type") == "view", 0.5).otherwise(1.0).alias("source_weight"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("duplicate_key"),
        )

    @cached_property
    def news(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("article_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("pub_date"), "source", "lang", "text", zfill((F.col("doc_id") % 25).cast("string"), 6).alias("symbol"))

    @cached_property
    def world(self) -> DataFrame:
        """Five regions' daily index closes and volumes: trade_date, symbol, close, volume."""
        supplier = self.table("supplier").select("s_suppkey", "s_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        own = self.table("lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
        return own.groupBy(F.to_date("l_shipdate").alias("trade_date"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("symbol")).agg(_unit(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))

    @cached_property
    def snapshots(self) -> DataFrame:
        """Intraday points of the regions: at (the order's number), day, symbol, change_rate; only urgent orders give one."""
        own = self.table("orders").where("o_orderpriority = '1-URGENT'").join(self.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        own = own.join(F.broadcast(self.table("nation").select("n_nationkey", "n_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
        rate = F.round((F.col("o_orderkey") % 1000) / F.lit(10000.0) - 0.05 + 1e-9, 4)
        return own.select(F.col("o_orderkey").alias("at"), F.to_date("o_orderdate").alias("day"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("symbol"), rate.alias("change_rate"))

    @cached_property
    def dated_news(self) -> DataFrame:
        """The articles dealt over the dates of the prices by their number (the table's own dates are of one month)."""
        return self.news.withColumn("day", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("article_id") * 37 % 2500).cast("int")))

    @cached_property
    def dated_posts(self) -> DataFrame:
        """The posts dealt over the dates of the prices by their number; the channel is all the text that they have."""
        return self.posts.withColumn("day", F.date_add(F.lit("1995-01-02").cast("date"), (F.col("message_id") * 37 % 2500).cast("int")))


SQL = r"""
lines AS (SELECT *, CAST(l_shipdate AS DATE) AS date, lpad(substr(p_brand, 7), 6, '0') AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey),
sym AS (SELECT symbol, 'Brand ' || symbol AS name, CASE WHEN CAST(symbol AS INT) % 5 < 3 THEN 'MAIN' ELSE 'GROWTH' END AS market, sector FROM (
  SELECT lpad(substr(p_brand, 7), 6, '0') AS symbol, p_type AS sector, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY p_brand, p_type) WHERE rn = 1),
px AS (SELECT date, symbol, round(100.0::DOUBLE + 0.01::DOUBLE * arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) + 1e-9, 6) AS open,
  round(100.0::DOUBLE + 0.01::DOUBLE * max(l_extendedprice / l_quantity) + 1e-9, 6) AS high, round(100.0::DOUBLE + 0.01::DOUBLE * min(l_extendedprice / l_quantity) + 1e-9, 6) AS low,
  round(100.0::DOUBLE + 0.01::DOUBLE * (sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 6) AS close, sum(l_quantity) AS volume, round(sum(l_extendedprice) + 1e-9, 2) AS trading_value
  FROM lines GROUP BY date, symbol),
idx AS (SELECT date, market AS benchmark, round(100.0::DOUBLE + 0.01::DOUBLE * (sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 6) AS close FROM lines JOIN sym USING (symbol) GROUP BY date, market),
met AS (SELECT date, symbol, round(sum(p_retailprice * l_quantity) + 1e-9, 2) AS market_cap,
  round(round(100.0::DOUBLE + 0.01::DOUBLE * (sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 6) / avg(p_size) + 1e-9, 6) AS per,
  round(round(100.0::DOUBLE + 0.01::DOUBLE * (sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 6) / avg(p_retailprice) + 1e-9, 6) AS pbr,
  round(avg(l_tax) + 1e-9, 6) AS eps, round(avg(l_discount + l_tax) + 1e-9, 6) AS bps, round(avg(l_discount) + 1e-9, 6) AS dividend_yield FROM lines GROUP BY date, symbol),
flow AS (SELECT date, symbol, round(sum(CASE WHEN l_returnflag = 'A' THEN v ELSE 0.0 END) + 1e-9, 2) AS foreign_net_value, round(sum(CASE WHEN l_returnflag = 'N' THEN v ELSE 0.0 END) + 1e-9, 2) AS institution_net_value,
  round(sum(CASE WHEN l_returnflag = 'R' THEN v ELSE 0.0 END) + 1e-9, 2) AS retail_net_value FROM (SELECT *, l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM lines) GROUP BY date, symbol),
pens AS (SELECT date, symbol, round(sum(l_extendedprice * CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) + 1e-9, 2) AS pension_net_value FROM lines WHERE l_returnflag = 'N' AND l_discount > 0.05 GROUP BY date, symbol),
snap AS (SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day, 'R' || n_regionkey AS symbol, round((o_orderkey % 1000) / 10000.0::DOUBLE - 0.05::DOUBLE + 1e-9, 4) AS change_rate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'),
rep AS (SELECT *, lag(target) OVER (PARTITION BY symbol, analyst ORDER BY report_date, report_id) AS previous_target FROM (
  SELECT report_id, report_date, symbol, broker, analyst, price, round(price * (0.8::DOUBLE + report_id % 100 / 200.0::DOUBLE) + 1e-9, 4) AS target, rating FROM (
  SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS report_date, lpad(CAST(c_nationkey % 25 + 1 AS VARCHAR), 6, '0') AS symbol, c_mktsegment AS broker, c_custkey % 40 AS analyst, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Buy' WHEN o_orderpriority <> '5-LOW' THEN 'Hold' END AS rating,
  round(100.0::DOUBLE + o_totalprice % 500 / 10 + 1e-9, 4) AS price FROM orders JOIN customer ON o_custkey = c_custkey))),
posts AS (SELECT event_type AS channel, event_id AS message_id, ts, 'T' || user_id AS ticker, round(value / 250 - 1 + 1e-9, 4) AS sentiment, CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'purchase' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS urgency,
  CASE event_type WHEN 'view' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS source_weight, event_type || ':' || user_id AS duplicate_key FROM events),
news AS (SELECT doc_id AS article_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS pub_date, source, lang, text, lpad(CAST(doc_id % 25 AS VARCHAR), 6, '0') AS symbol FROM documents),
world AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, 'R' || n_regionkey AS symbol, round(100.0::DOUBLE + 0.01::DOUBLE * (sum(l_extendedprice) / sum(l_quantity)) + 1e-9, 6) AS close, sum(l_quantity) AS volume
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
"""


def sql(select: str, *more: str) -> str:
    """A DuckDB query over the canonical tables and further common table expressions."""
    return "WITH " + ",\n".join(x.strip() for x in (SQL, *more)) + "\n" + select.strip()
