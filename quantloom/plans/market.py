"""Queries over signals, links, regimes, outlooks, explanations, serving, universe, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from quantloom.functions import text as T
from quantloom.functions.columns import rounded
from quantloom.operators import market as M
from quantloom.sources import tables as S
from quantloom.sources.staging import shared_dir
from quantloom.streaming import events as E

from .primitives import CDF, SENT
from .registry import query

_AS = "2024-01-15 12:00:00"
_AGE = f"(epoch(TIMESTAMP '{_AS}') - floor(epoch(ts))) / 3600.0"


@query("g02_social_signal", f"""SELECT ticker, n24, n1, round(greatest(-1.0, least(10.0, CASE WHEN nb > 0 THEN (n24 - nb)::DOUBLE / nb ELSE n24 END)) + 1e-9, 6) AS delta, round(w + 1e-9, 6) AS weighted,
round(0.45::DOUBLE * least(1.0, n24 / 20.0) + 0.30::DOUBLE * coalesce(w, 0.5) + 0.15::DOUBLE * coalesce(u, 0.0) + 0.10::DOUBLE * (1 - coalesce(1 - k::DOUBLE / nullif(n24, 0), 0.0)) + 1e-9, 6) AS attention FROM (
SELECT ticker, count(*) FILTER (age < 24) AS n24, count(*) FILTER (age >= 24) AS nb, count(*) FILTER (age < 1) AS n1, sum(source_weight * (0.65::DOUBLE * (sentiment + 1) / 2 + 0.35::DOUBLE * urgency)) FILTER (age < 24) / nullif(sum(source_weight) FILTER (age < 24), 0) AS w,
avg(urgency) FILTER (age < 24) AS u, count(DISTINCT duplicate_key) FILTER (age < 24) AS k FROM (SELECT *, {_AGE} AS age FROM posts) WHERE age >= 0 AND age < 48 GROUP BY ticker)""")
def g02(p):
    return M.social_signal(p.posts, _AS)


@query("g06_news_signal", f"""SELECT scope, pub_date, (sum(n) OVER w)::BIGINT AS n, round(sum(s) OVER w / sum(n) OVER w + 1e-9, 6) AS sentiment, round(sum(neg) OVER w / sum(n) OVER w + 1e-9, 6) AS negative, round(sum(pos) OVER w / sum(n) OVER w + 1e-9, 6) AS positive FROM (
SELECT scope, pub_date, count(*) AS n, sum(u) AS s, count(*) FILTER (u <= 0.45) AS neg, count(*) FILTER (u >= 0.6) AS pos FROM (SELECT unnest(['market', symbol]) AS scope, pub_date, ({SENT} + 1) / 2 AS u FROM news) GROUP BY scope, pub_date)
WINDOW w AS (PARTITION BY scope ORDER BY pub_date RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)""")
def g06(p):
    return M.news_signal(p.news, T.sentiment(F.col("text")))


BARS = """
wb AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS ret1 FROM world),
bars AS (SELECT trade_date, symbol, close, round(ret1 + 1e-9, 6) AS return_1d, round(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 + 1e-9, 6) AS return_5d, round(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY trade_date) - 1 + 1e-9, 6) AS return_20d,
  round(CASE WHEN count(ret1) OVER f >= 5 THEN stddev_samp(ret1) OVER f END + 1e-9, 6) AS volatility_20d FROM wb WINDOW f AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
"""


@query("s20_daily_bars", "SELECT * FROM bars", BARS)
def s20(p):
    return M.daily_bars(p.world)


LINK = """
k0 AS (SELECT date, benchmark, close / lag(close) OVER (PARTITION BY benchmark ORDER BY date) - 1 AS r FROM idx),
k1 AS (SELECT k0.*, q.return_1d AS f, q.trade_date AS matched_at FROM k0 ASOF LEFT JOIN (SELECT trade_date, return_1d FROM bars WHERE symbol = 'R0') q ON k0.date - 1 >= q.trade_date),
k2 AS (SELECT *, CASE WHEN r IS NOT NULL THEN f END AS x, CASE WHEN f IS NOT NULL THEN r END AS y FROM k1),
k3 AS (SELECT date, benchmark, r, f, matched_at, CASE WHEN count(x) OVER w >= 5 THEN corr(x, y) OVER w END AS c, CASE WHEN count(x) OVER w >= 5 THEN covar_pop(x, y) OVER w / nullif(var_pop(x) OVER w, 0) END AS b, CASE WHEN count(x) OVER w >= 5 THEN avg((sign(x) = sign(y))::INT::DOUBLE) OVER w END AS a
  FROM k2 WINDOW w AS (PARTITION BY benchmark ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
link AS (SELECT date, benchmark, matched_at, r, f, c, round(r - f + 1e-9, 6) AS spread, round(c + 1e-9, 5) AS corr, round(b + 1e-9, 4) AS beta, round(a + 1e-9, 6) AS agreement,
  round(0.45::DOUBLE * CASE WHEN f IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + f)) END + 0.25::DOUBLE * CASE WHEN b IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, 0.5 + b / 4)) END + 0.15::DOUBLE * (0.5 + 0.25 * coalesce(c, 0.0)) + 0.15::DOUBLE * coalesce(a, 0.5) + 1e-9, 4) AS impact FROM k3)
"""


@query("g09_g12_overseas_link", "SELECT date, benchmark, matched_at, spread, corr, beta, agreement, impact FROM link", BARS, LINK)
def g09(p):
    return M.overseas_link(p.index, M.daily_bars(p.world).where("symbol = 'R0'"))


@query("g10_causes", "SELECT date, benchmark, array_to_string([x for x in [CASE WHEN impact < 0.45 THEN 'foreign_sell' END, CASE WHEN spread > 0.5 OR spread < -0.5 THEN 'wide_spread' END, CASE WHEN spread < -0.2 THEN 'drop' END, CASE WHEN corr < 0 THEN 'weak_link' END] if x IS NOT NULL], ',') AS causes FROM link", BARS, LINK)
def g10(p):
    own = M.overseas_link(p.index, M.daily_bars(p.world).where("symbol = 'R0'"))
    renamed = own.select("date", "benchmark", "corr", F.when(F.col("impact") < 0.45, -1.0).otherwise(0.0).alias("f"), F.abs("spread").alias("abs_spread"), F.col("spread").alias("r"))
    return renamed.select("date", "benchmark", F.array_join(M.causes(renamed), ",").alias("causes"))


@query("g13_sector_returns", "SELECT date, sector, round(avg(r) + 1e-9, 6) AS sector_return, count(r) AS n FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px) JOIN sym USING (symbol) GROUP BY date, sector")
def g13(p):
    from quantloom.functions.windows import change

    own = p.prices.withColumn("r", change(F.col("close"), 1)).join(p.symbols.select("symbol", "sector"), "symbol")
    return own.groupBy("date", "sector").agg(rounded(F.avg("r")).alias("sector_return"), F.count("r").alias("n"))


_PTS = "least(100, " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in (("r0 <= -0.3", 20), ("r1 <= -0.3", 25), ("r2 <= -0.3", 25), ("r3 <= -0.3", 15), ("r4 <= -0.3", 10), ("v0 >= 0.5", 10))) + ")"


@query("g14_regime", f"""SELECT trade_date, points::BIGINT AS points, CASE WHEN points >= 70 THEN 'panic' WHEN points >= 45 THEN 'risk_off' WHEN points >= 20 THEN 'neutral' ELSE 'risk_on' END AS regime, CASE WHEN points >= 70 THEN 0.5::DOUBLE WHEN points >= 45 THEN 0.3::DOUBLE WHEN points >= 20 THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END AS adjustment
FROM (SELECT trade_date, {_PTS} AS points FROM (SELECT trade_date, {", ".join(f"max(return_1d) FILTER (symbol = 'R{i}') AS r{i}" for i in range(5))}, max(volatility_20d) FILTER (symbol = 'R0') AS v0 FROM bars GROUP BY trade_date))""", BARS)
def g14(p):
    return M.regime(M.daily_bars(p.world))


@query("g15_basis_points", "SELECT trade_date, symbol, round((close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date)) * 100 + 1e-9, 4) AS bp FROM world")
def g15(p):
    return p.world.select("trade_date", "symbol", rounded((F.col("close") - F.lag("close").over(Window.partitionBy("symbol").orderBy("trade_date"))) * 100, 4).alias("bp"))


BREADTH = """
br AS (SELECT date, market, round(avg((r > 0)::INT::DOUBLE) + 1e-9, 6) AS up_share, round(avg((r < -0.02)::INT::DOUBLE) + 1e-9, 6) AS down_share, round(avg(r) + 1e-9, 6) AS mean_return FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px) JOIN sym USING (symbol) GROUP BY date, market),
i0 AS (SELECT date, benchmark AS market, close, close / lag(close) OVER t - 1 AS r1, close / lag(close, 5) OVER t - 1 AS r5, lead(close) OVER t / close - 1 AS nx FROM idx WINDOW t AS (PARTITION BY benchmark ORDER BY date)),
od AS (SELECT date, market, round(r1 + 1e-9, 6) AS return_1d, round(r5 + 1e-9, 6) AS return_5d, round(CASE WHEN count(r1) OVER f >= 5 THEN stddev_samp(r1) OVER f END + 1e-9, 6) AS volatility_20d, round(close / CASE WHEN count(close) OVER f >= 5 THEN avg(close) OVER f END - 1 + 1e-9, 6) AS ma_gap_20d, round(nx + 1e-9, 6) AS label
  FROM i0 WINDOW f AS (PARTITION BY market ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
"""


@query("o03_breadth", "SELECT * FROM br", BREADTH)
def o03(p):
    return M.breadth(p.prices, p.symbols)


@query("o01_o02_outlook_dataset", "SELECT * FROM od LEFT JOIN br USING (date, market)", BREADTH)
def o02(p):
    return M.outlook_dataset(p.index, M.breadth(p.prices, p.symbols))


@query("o05_ridge")
def o05(p):
    return M.ridge(M.outlook_dataset(p.index, M.breadth(p.prices, p.symbols)))




def _cdf(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0 / (1.0 + 0.3275911::DOUBLE * {x}))"
    e = f"(1.0 - {t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * (-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE)))) * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)"


@query("o06_o07_forecast", f"""SELECT date, market, round(1 - {_cdf('(-mu / s)')} + 1e-9, 6) AS p_up, round({_cdf('((-0.02::DOUBLE - mu) / s)')} + 1e-9, 6) AS p_shock, CASE WHEN mu >= 0.005 AND 1 - {_cdf('(-mu / s)')} >= 0.56 THEN 'up' WHEN mu <= -0.005 AND 1 - {_cdf('(-mu / s)')} <= 0.44 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT date, market, 0.65::DOUBLE * return_5d / 5 + 0.35::DOUBLE * (up_share - 0.5) AS mu, greatest(0.006, least(0.5, volatility_20d)) AS s FROM od JOIN br USING (date, market) WHERE return_5d IS NOT NULL AND volatility_20d IS NOT NULL AND up_share IS NOT NULL)""", BREADTH)
def o06(p):
    own = M.outlook_dataset(p.index, M.breadth(p.prices, p.symbols)).where("return_5d is not null and volatility_20d is not null and up_share is not null")
    mu = 0.65 * F.col("return_5d") / 5 + 0.35 * (F.col("up_share") - 0.5)
    up, shock, direction = M.forecast(mu, F.col("volatility_20d"))
    return own.select("date", "market", rounded(up).alias("p_up"), rounded(shock).alias("p_shock"), direction.alias("direction"))


CREDIT = """
cb AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderstatus AS market, round(sum(o_totalprice) + 1e-9, 2) AS balance FROM orders GROUP BY ALL),
cd AS (SELECT *, round(balance - lag(balance, 1) OVER c + 1e-9, 2) AS delta_1, round(balance - lag(balance, 5) OVER c + 1e-9, 2) AS delta_5, round(balance - lag(balance, 20) OVER c + 1e-9, 2) AS delta_20 FROM cb WINDOW c AS (PARTITION BY market ORDER BY date))
"""


def _credit(p):
    return p.table("orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("market")).agg(rounded(F.sum("o_totalprice"), 2).alias("balance"))


@query("s15_credit_deltas", "SELECT * FROM cd", CREDIT)
def s15(p):
    return S.with_deltas(_credit(p), "balance")


@query("o09_credit_pressure", "SELECT date, market, round(delta_5 / nullif(balance - delta_5, 0) + 1e-9, 4) AS pressure FROM cd WHERE delta_5 IS NOT NULL", CREDIT)
def o09(p):
    own = S.with_deltas(_credit(p), "balance").where("delta_5 is not null")
    return own.select("date", "market", rounded(F.try_divide(F.col("delta_5"), F.col("balance") - F.col("delta_5")), 4).alias("pressure"))


MOVES = """
mv AS (SELECT symbol, max(date) AS date, round(max(close) FILTER (b = 1) / nullif(max(close) FILTER (b = 2), 0) - 1 + 1e-9, 6) AS move, round(max(close) FILTER (b = 1) / nullif(max(close) FILTER (b = 22), 0) - 1 + 1e-9, 6) AS move_21 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM px) WHERE b IN (1, 2, 22) GROUP BY symbol),
tl AS (SELECT symbol, round(sum(foreign_net_value) + 1e-9, 2) AS foreign_20, round(sum(retail_net_value) + 1e-9, 2) AS retail_20 FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS b FROM flow) WHERE b <= 20 GROUP BY symbol)
"""


@query("x01_moves", "SELECT * FROM mv", MOVES)
def x01(p):
    return M.moves(p.prices)


@query("x05_market_rows", "SELECT market, round(median(move) + 1e-9, 6) AS median_move, count(*) FILTER (move > 0) AS up, count(*) FILTER (move < 0) AS down FROM mv JOIN sym USING (symbol) GROUP BY market", MOVES)
def x05(p):
    own = M.moves(p.prices).join(p.symbols.select("symbol", "market"), "symbol")
    return own.groupBy("market").agg(rounded(F.median("move")).alias("median_move"), F.count_if(F.col("move") > 0).alias("up"), F.count_if(F.col("move") < 0).alias("down"))


@query("d10_peers", "SELECT vec_id, peer, round(distance + 1e-6, 4) AS distance FROM (SELECT a.vec_id, b.vec_id AS peer, sqrt(list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 for i in range(1, 65)])) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum([(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2 for i in range(1, 65)]), b.vec_id) AS rn FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rn <= 10")
def d10(p):
    from quantloom.operators import neighbours
    from quantloom.sources.staging import staged

    own = p.table("embeddings")
    near = neighbours.nearest(own, own.where("vec_id % 20 = 0").select("vec_id"), 10, keep=staged)
    return near.select("vec_id", "peer", F.round(F.col("distance") + 1e-6, 4).alias("distance"))


@query("u01_universe_refresh", """SELECT symbol, market, coalesce(why, CASE WHEN place <= 8 THEN 'taken' ELSE 'spare' END) AS status, CASE WHEN why IS NULL THEN place END AS place FROM (SELECT *, row_number() OVER (PARTITION BY market, why IS NULL ORDER BY market_cap DESC NULLS LAST, symbol) AS place FROM (
SELECT sym.symbol, market, market_cap, CASE WHEN market_cap IS NULL THEN 'no_market_value' WHEN coalesce(n, 0) < 100 THEN 'short_history' END AS why FROM sym LEFT JOIN (SELECT symbol, arg_max(market_cap, date) AS market_cap FROM met GROUP BY symbol) USING (symbol) LEFT JOIN (SELECT symbol, count(*) AS n FROM px GROUP BY symbol) USING (symbol)))""")
def u01(p):
    return M.refresh_universe(p.symbols, p.metrics, p.prices)


@query("u01_universe_commit", """SELECT symbol, market, rank FROM (SELECT symbol, market, row_number() OVER (PARTITION BY market ORDER BY market_cap DESC, symbol) AS rank FROM sym JOIN (SELECT symbol, arg_max(market_cap, date) AS market_cap FROM met GROUP BY symbol) USING (symbol)
JOIN (SELECT symbol FROM px GROUP BY symbol HAVING count(*) >= 100) USING (symbol) WHERE sector <> 'PROMO' AND market_cap IS NOT NULL) WHERE rank <= 5""")
def u01_commit(p):
    """Published only if every market has its five symbols."""
    from quantloom.operators import universe

    excluded = p.symbols.where("sector = 'PROMO'").select("symbol")
    chosen = universe.choose(p.symbols, p.metrics, p.prices, excluded, per_market=5, least_rows=100)
    return universe.commit(p.spark, _shared(p.spark), chosen, {"MAIN": 5, "GROWTH": 5}).select("symbol", "market", "rank")


@query("s03_upsert", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s03(p):
    old = p.table("customer").select("c_custkey", "c_name", "c_acctbal")
    batch = p.table("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return S.upsert(old, batch, ["c_custkey"], "c_acctbal")


@query("s04_align", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(NULL AS DOUBLE) AS score FROM customer")
def s04(p):
    return S.align(p.table("customer"), StructType().add("c_custkey", LongType()).add("c_name", StringType()).add("score", DoubleType()))


@query("s06_load_symbols", "SELECT date, symbol, close FROM px WHERE symbol IN ('000001', '000007')")
def s06(p):
    return p.prices.where(F.col("symbol").isin("000001", "000007")).select("date", "symbol", "close")


@query("s14_flow_pivot", "SELECT date, symbol, sum(net) FILTER (investor = 'A') AS a, sum(net) FILTER (investor = 'R') AS r FROM (SELECT date, symbol, l_returnflag AS investor, l_quantity AS net FROM lines) GROUP BY date, symbol")
def s14(p):
    long = p.lines.select("date", "symbol", F.col("l_returnflag").alias("investor"), F.col("l_quantity").alias("net"))
    return S.pivot_flows(long, ["A", "R"]).withColumnsRenamed({"A": "a", "R": "r"})


@query("s21_snapshot", f"SELECT event_type, arg_max(value, ts) AS latest FROM events WHERE ts <= TIMESTAMP '{_AS}' GROUP BY event_type")
def s21(p):
    return p.table("events").where(F.col("ts") <= F.lit(_AS).cast("timestamp")).groupBy("event_type").agg(F.max_by("value", "ts").alias("latest"))


@query("s23_high_watermark", f"SELECT event_id, user_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS high FROM events WHERE ts <= TIMESTAMP '{_AS}' GROUP BY user_id) USING (user_id) WHERE high IS NULL OR ts > high")
def s23(p):
    ev = p.table("events").select("event_id", "user_id", "ts")
    return S.watermark_filter(ev, ev.where(F.col("ts") <= F.lit(_AS).cast("timestamp")), "user_id", "ts").select("event_id", "user_id")


def _shared(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("st05_tumbling_stream", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value) + 1e-9, 2) AS total FROM events GROUP BY 1, 2")
def st05(p):
    return E.drain(E.tumbling(E.read_stream(p.spark, p.dir, "events")), _shared(p.spark), ["start", "event_type"])


@query("st01_incremental_pull", "SELECT event_id, user_id, event_type FROM events")
def st01(p):
    """All events, once: nothing was stored before."""
    from quantloom.streaming import store

    return store.pull(E.read_stream(p.spark, p.dir, "events"), _shared(p.spark), entity="user_id", ts="ts", key="event_id").select("event_id", "user_id", "event_type")


@query("st03_daily_store", "SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n, round(sum(value) + 1e-9, 2) AS total FROM events GROUP BY 1, 2")
def st03(p):
    from quantloom.streaming import store

    return store.daily(E.read_stream(p.spark, p.dir, "events"), _shared(p.spark))


@query("st02_sliding_stream", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts) - to_hours(6 * i) for i in range(0, 4)]) AS start FROM events) GROUP BY start")
def st02(p):
    return E.drain(E.sliding(E.read_stream(p.spark, p.dir, "events")), _shared(p.spark), ["start"])


@query("st06_session_windows", "SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g")
def st06(p):
    return E.sessions(p.table("events"))
