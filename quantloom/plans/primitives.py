"""Queries over scalar, text, aggregation, window, set and join primitives."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions import columns as C
from quantloom.functions import text as T
from quantloom.functions import windows as W
from quantloom.operators.features import prepare_prices

from .features import _mean, _rank, _roll
from .registry import query

_S = "(PARTITION BY symbol ORDER BY date)"
R = C.rounded


@query("p01_prepared_prices", "SELECT date, symbol, close, volume FROM px WHERE close > 0")
def p01(p):
    return prepare_prices(p.prices).select("date", "symbol", "close", "volume")


@query("p02_numeric_coercion", "SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9]', '', 'g') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def p02(p):
    return p.table("events").select("event_id", F.regexp_replace("props", "[^0-9]", "").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("p03_safe_divide", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0) + 1e-9, 4) AS ratio FROM lineitem")
def p03(p):
    return p.table("lineitem").select("l_orderkey", "l_linenumber", R(F.try_divide("l_extendedprice", "l_discount"), 4).alias("ratio"))


@query("p04_clip", "SELECT date, symbol, greatest(101.0, least(130.0, close)) AS clipped FROM px")
def p04(p):
    return p.prices.select("date", "symbol", C.clip(F.col("close"), 101, 130).alias("clipped"))


@query("p05_pct_rank", f"SELECT date, symbol, round({_rank('volume')} + 1e-9, 6) AS up, round({_rank('volume', up=False)} + 1e-9, 6) AS down FROM px")
def p05(p):
    return p.prices.select("date", "symbol", R(W.pct_rank(F.col("volume"), "date")).alias("up"), R(W.pct_rank(F.col("volume"), "date", ascending=False)).alias("down"))


@query("p06_min_max_score", "SELECT date, symbol, round(CASE WHEN max(close) OVER w = min(close) OVER w THEN 0.5 ELSE (close - min(close) OVER w) / (max(close) OVER w - min(close) OVER w) END + 1e-9, 6) AS score FROM px WINDOW w AS (PARTITION BY date)")
def p06(p):
    low, high = F.min("close").over(W.by("date")), F.max("close").over(W.by("date"))
    return p.prices.select("date", "symbol", R(F.when(high == low, 0.5).otherwise((F.col("close") - low) / (high - low))).alias("score"))


@query("p07_linear_scale", "SELECT date, symbol, round(greatest(0.0, least(1.0, (close - 100) / 40)) + 1e-9, 6) AS scaled FROM px")
def p07(p):
    return p.prices.select("date", "symbol", R(C.linear_scale(F.col("close"), 100, 140)).alias("scaled"))


@query("p08_row_mean", f"SELECT report_id, round({_mean('target', 'previous_target', 'price')} + 1e-9, 6) AS mean FROM rep")
def p08(p):
    return p.reports.select("report_id", R(C.row_mean(F.col("target"), F.col("previous_target"), F.col("price"))).alias("mean"))


@query("p09_centred_scores", f"SELECT date, symbol, round(coalesce(CASE WHEN r IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + r / 0.2::DOUBLE)) END, 0.5) + 1e-9, 6) AS score FROM (SELECT *, close / lag(close) OVER {_S} - 1 AS r FROM px)")
def p09(p):
    return p.prices.select("date", "symbol", R(C.centred_score(W.change(F.col("close"), 1), 0.1)).alias("score"))


@query("p10_default_fill", "SELECT report_id, coalesce(previous_target, 100.0) AS previous_target, coalesce(broker, 'none') AS broker FROM rep")
def p10(p):
    return p.reports.select("report_id", "previous_target", "broker").fillna({"previous_target": 100.0, "broker": "none"})


@query("p11_is_distinct", "SELECT report_id, target IS DISTINCT FROM previous_target AS changed FROM rep")
def p11(p):
    return p.reports.select("report_id", (~F.col("target").eqNullSafe(F.col("previous_target"))).alias("changed"))


@query("p12_conditional_counts", "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS high, count(*) FILTER (l_linestatus = 'O') AS open, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM lineitem GROUP BY l_returnflag")
def p12(p):
    place = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3)
    return p.table("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount") > 0.05).alias("high"), F.count_if(F.col("l_linestatus") == "O").alias("open")).withColumn("place", place)


@query("p13_keep_last", "SELECT symbol, analyst, report_id, target FROM (SELECT *, row_number() OVER (PARTITION BY symbol, analyst ORDER BY report_date DESC, report_id DESC) AS rn FROM rep) WHERE rn = 1")
def p13(p):
    last = F.row_number().over(Window.partitionBy("symbol", "analyst").orderBy(F.desc("report_date"), F.desc("report_id")))
    return p.reports.withColumn("rn", last).where("rn = 1").select("symbol", "analyst", "report_id", "target")


@query("p14_price_quality", "SELECT count(*) AS n, count(*) - count(DISTINCT (date, symbol)) AS n_repeated, count(*) FILTER (close IS NULL OR close <= 0) AS n_bad_close, count(*) FILTER (volume < 0) AS n_bad_volume, count(*) FILTER (trading_value = 0) * 10 > count(*) AS warns FROM px")
def p14(p):
    one = p.prices.groupBy("date", "symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("close").isNull() | (F.col("close") <= 0)).alias("c"), F.count_if(F.col("volume") < 0).alias("v"), F.count_if(F.col("trading_value") == 0).alias("z"))
    return one.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("n_repeated"), F.sum("c").alias("n_bad_close"), F.sum("v").alias("n_bad_volume"), (F.sum("z") * 10 > F.sum("n")).alias("warns"))


@query("p15_freshness", "SELECT symbol, max(date) AS latest, date_diff('day', max(date), (SELECT max(date) FROM px)) AS behind, date_diff('day', max(date), (SELECT max(date) FROM px)) > 3 AS stale FROM px GROUP BY symbol")
def p15(p):
    newest = p.prices.agg(F.max("date").alias("newest"))
    per = p.prices.groupBy("symbol").agg(F.max("date").alias("latest")).join(F.broadcast(newest))  # one row
    behind = F.datediff("newest", "latest").cast("long")
    return per.select("symbol", "latest", behind.alias("behind"), (behind > 3).alias("stale"))


@query("p16_trading_calendar", "SELECT date, lead(date) OVER (ORDER BY date) AS next_day, max(date) OVER (PARTITION BY date_trunc('week', date)) AS week_end FROM (SELECT DISTINCT date FROM px WHERE isodow(date) < 6)")
def p16(p):
    days = p.prices.select("date").distinct().where(F.weekday("date") < 5)
    return days.select("date", F.lead("date").over(Window.orderBy("date")).alias("next_day"), F.max("date").over(Window.partitionBy(F.trunc("date", "week"))).alias("week_end"))


@query("p17_horizon_maps", "SELECT n_regionkey * 60 + 20 AS days, CASE n_regionkey WHEN 0 THEN '1M' WHEN 1 THEN '3M' WHEN 2 THEN '6M' WHEN 3 THEN '9M' ELSE '12M' END AS horizon, CASE n_regionkey WHEN 0 THEN 21 WHEN 1 THEN 63 WHEN 2 THEN 126 WHEN 3 THEN 189 ELSE 252 END AS horizon_days FROM (SELECT DISTINCT r_regionkey AS n_regionkey FROM region)")
def p17(p):
    days = p.table("region").select((F.col("r_regionkey") * 60 + 20).alias("days"))
    named = days.select("days", C.nearest_horizon(F.col("days")).alias("horizon"))
    return named.select("days", "horizon", C.horizon_days(F.col("horizon")).alias("horizon_days"))


_CDF = "CASE WHEN z >= 0 THEN 0.5 * (1 + e) ELSE 0.5 * (1 - e) END"
CDF = "1.0 - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x)"


@query("p18_norm_cdf", f"SELECT event_id, round({_CDF} + 1e-9, 6) AS p FROM (SELECT *, {CDF} AS e FROM (SELECT *, 1.0 / (1.0 + 0.3275911::DOUBLE * x) AS t FROM (SELECT event_id, value / 100 - 2 AS z, abs(value / 100 - 2) / sqrt(2.0::DOUBLE) AS x FROM events)))")
def p18(p):
    return p.table("events").select("event_id", R(C.norm_cdf(F.col("value") / 100 - 2)).alias("p"))


@query("p19_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',\"type\":\"' || event_type || '\"}' AS doc FROM events")
def p19(p):
    k = F.from_json("props", "k long")["k"]
    return p.table("events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("doc"))


def _has(w: str) -> str:
    return f"contains(lower(coalesce(text, '')), '{w.lower()}')"


def _hits(words) -> str:
    return "list_sort([x for x in [" + ", ".join(f"CASE WHEN {_has(w)} THEN '{w}' END" for w in words) + "] if x IS NOT NULL])"


def _any(words) -> str:
    return "(" + " OR ".join(_has(w) for w in words) + ")"


_ALIASES = {"idiot": "RUDE", "password": "SAFE"}
_STOP = ", ".join(f"'{x}'" for x in T.TICKER_STOP)


@query("t01_tickers", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([x for x in [regexp_replace(y, '^[$#]', '') for y in string_split_regex(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9$#]+', ' ', 'g'), ' ')] if regexp_full_match(x, '[A-Z]{{1,5}}') AND x NOT IN ({_STOP})], [x for x in [{", ".join(f"CASE WHEN {_has(k)} THEN '{v}' END" for k, v in _ALIASES.items())}] if x IS NOT NULL]))), ',') AS tickers FROM documents""")
def t01(p):
    return p.table("documents").select("doc_id", F.array_join(T.tickers(F.col("text"), aliases=_ALIASES, pattern=T.MARKED_TICKER), ",").alias("tickers"))


@query("t02_themes", "SELECT doc_id, array_to_string(list_sort([x for x in [" + ", ".join(f"CASE WHEN {_any(ws)} THEN '{t}' END" for t, ws in T.THEMES.items()) + "] if x IS NOT NULL]), ',') AS themes FROM documents")
def t02(p):
    return p.table("documents").select("doc_id", F.array_join(T.themes(F.col("text")), ",").alias("themes"))


_POS, _NEG = f"len({_hits(T.POSITIVE)})", f"len({_hits(T.NEGATIVE)})"
SENT = f"CASE WHEN {_POS} + {_NEG} > 0 THEN ({_POS} - {_NEG})::DOUBLE / ({_POS} + {_NEG}) ELSE 0.0 END"


@query("t03_t04_sentiment", f"SELECT doc_id, round(s + 1e-9, 6) AS sentiment, round((s + 1) / 2 + 1e-9, 6) AS unit_sentiment FROM (SELECT doc_id, {SENT} AS s FROM documents)")
def t03(p):
    s = T.sentiment(F.col("text"))
    return p.table("documents").select("doc_id", R(s).alias("sentiment"), R(T.unit_sentiment(s)).alias("unit_sentiment"))


URG = "CASE " + " ".join(f"WHEN {_has(w)} THEN {s}::DOUBLE" for w, s in T.URGENT) + " ELSE 0.0 END"


@query("t05_urgency", f"SELECT doc_id, {URG} AS urgency FROM documents")
def t05(p):
    return p.table("documents").select("doc_id", T.urgency(F.col("text")).alias("urgency"))


@query("t06_risk_keywords", f"SELECT doc_id, array_to_string({_hits(T.RISKS)}, ',') AS risks FROM documents")
def t06(p):
    return p.table("documents").select("doc_id", F.array_join(T.hits(F.col("text"), T.RISKS), ",").alias("risks"))


@query("t07_urls", r"SELECT page_id, array_to_string([regexp_replace(u, '[.,]+$', '') for u in regexp_extract_all(url, 'https?://[^\s)>\]]+')], ' ') AS urls FROM pages")
def t07(p):
    return p.table("pages").select("page_id", F.array_join(T.urls(F.col("url")), " ").alias("urls"))


_SQ = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query("t08_excerpt", f"SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(substr(t, 1, 59)) || '...' END AS excerpt FROM (SELECT doc_id, {_SQ} AS t FROM documents)")
def t08(p):
    return p.table("documents").select("doc_id", T.excerpt(F.col("text"), 60).alias("excerpt"))


@query("t09_duplicate_key", r"SELECT conv_id, turn, CASE WHEN regexp_matches(text, 'https?://[^\s)>\]]+') THEN 'url:' || lower(regexp_replace(regexp_extract(text, 'https?://[^\s)>\]]+'), '[.,]+$', '')) ELSE 'text:' || substr(sha256(lower(" + _SQ + ")), 1, 20) END AS key FROM conversations")
def t09(p):
    return p.table("conversations").select("conv_id", "turn", T.duplicate_key(F.col("text")).alias("key"))


_CATS = (("flow", ("secret", "token")), ("macro", ("idiot", "trash")), ("sector", ("copy", "rights")))


@query("t10_category", "SELECT doc_id, CASE " + " ".join(f"WHEN {_any(ws)} THEN '{c}'" for c, ws in _CATS) + " ELSE 'general' END AS category FROM documents")
def t10(p):
    return p.table("documents").select("doc_id", T.first_match(F.col("text"), _CATS, "general").alias("category"))


@query("t11_negative_hits", f"SELECT doc_id, len({_hits(T.NEGATIVE)})::BIGINT AS n_negative, array_to_string({_hits(T.NEGATIVE)}, ',') AS negative FROM documents")
def t11(p):
    found = T.hits(F.col("text"), T.NEGATIVE)
    return p.table("documents").select("doc_id", F.size(found).cast("long").alias("n_negative"), F.array_join(found, ",").alias("negative"))


@query("t12_symbols_by_alias", "SELECT doc_id, symbol FROM (SELECT doc_id, unnest([CASE WHEN contains(lower(text), 'idiot') THEN '000001' END, CASE WHEN contains(lower(text), 'rights') THEN '000002' END]) AS symbol FROM documents) WHERE symbol IS NOT NULL")
def t12(p):
    own = F.array(F.when(T.has(F.col("text"), "idiot"), F.lit("000001")), F.when(T.has(F.col("text"), "rights"), F.lit("000002")))
    return p.table("documents").select("doc_id", F.explode(F.filter(own, lambda x: x.isNotNull())).alias("symbol"))


@query("t13_sector", "SELECT symbol, CASE WHEN contains(lower(sector), 'oil') OR contains(lower(sector), 'gas') OR contains(lower(sector), 'steel') THEN 'energy' WHEN contains(lower(sector), 'copper') OR contains(lower(sector), 'nickel') OR contains(lower(sector), 'tin') OR contains(lower(sector), 'brass') THEN 'metals' ELSE 'broad' END AS sector FROM sym")
def t13(p):
    return p.symbols.select("symbol", T.first_match(F.col("sector"), T.SECTORS, "broad").alias("sector"))


@query("t14_security_type", "SELECT c_custkey, regexp_matches(c_name, '[05]$') AS is_preferred, starts_with(c_name, 'Customer#0000') AS is_early FROM customer")
def t14(p):
    return p.table("customer").select("c_custkey", F.col("c_name").rlike("[05]$").alias("is_preferred"), F.col("c_name").startswith("Customer#0000").alias("is_early"))


@query("t15_pattern_flags", "SELECT doc_id, regexp_matches(text, '(?i)idiot|moron|stupid') AS flagged FROM documents")
def t15(p):
    return p.table("documents").select("doc_id", F.col("text").rlike("(?i)idiot|moron|stupid").alias("flagged"))


@query("j01_inner_join", "SELECT o_orderkey, l_linenumber, o_orderstatus, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j01(p):
    return p.table("orders").join(p.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_orderstatus", "l_quantity")


@query("j02_left_join", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def j02(p):
    nation = p.table("nation").where("n_regionkey = 1")
    return p.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("j03_full_outer", "SELECT coalesce(a.date, b.date) AS date, coalesce(a.symbol, b.symbol) AS symbol, f, r FROM (SELECT date, symbol, foreign_net_value AS f FROM flow WHERE foreign_net_value <> 0) a FULL JOIN (SELECT date, symbol, retail_net_value AS r FROM flow WHERE retail_net_value <> 0) b ON a.date = b.date AND a.symbol = b.symbol")
def j03(p):
    a = p.flows.where("foreign_net_value <> 0").select("date", "symbol", F.col("foreign_net_value").alias("f"))
    b = p.flows.where("retail_net_value <> 0").select("date", "symbol", F.col("retail_net_value").alias("r"))
    return a.join(b, ["date", "symbol"], "full_outer")


@query("j09_semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_open FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def j09(p):
    big = p.table("orders").where("o_totalprice > 400000")
    some = p.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).distinct()
    rest = p.table("customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return rest.join(some, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("has_open"))


@query("j10_insert_missing", "SELECT s_suppkey AS k FROM supplier UNION ALL SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j10(p):
    old = p.table("supplier").select(F.col("s_suppkey").alias("k"))
    return old.unionByName(p.table("customer").select(F.col("c_custkey").alias("k")).join(old, "k", "left_anti"))


@query("j12_update_from", "SELECT s_suppkey, coalesce(c_acctbal, s_acctbal) AS balance FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0")
def j12(p):
    new = p.table("customer").where("c_acctbal > 0").select("c_custkey", "c_acctbal")
    return p.table("supplier").join(new, F.col("s_suppkey") == F.col("c_custkey"), "left").select("s_suppkey", F.coalesce("c_acctbal", "s_acctbal").alias("balance"))


@query("j13_lookup_join", "SELECT px.date, px.symbol, round(px.close / idx.close + 1e-9, 6) AS relative FROM px JOIN sym USING (symbol) JOIN idx ON idx.date = px.date AND benchmark = market")
def j13(p):
    own = p.prices.join(p.symbols, "symbol")
    idx = p.index.select("date", F.col("benchmark").alias("market"), F.col("close").alias("index"))
    return own.join(idx, ["date", "market"]).select("date", "symbol", R(F.col("close") / F.col("index")).alias("relative"))


@query("j15_latest_per_key", "SELECT symbol, date, close FROM px JOIN (SELECT symbol, max(date) AS date FROM px GROUP BY symbol) USING (symbol, date)")
def j15(p):
    return p.prices.withColumn("r", F.rank().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("r = 1").select("symbol", "date", "close")


@query("a01_group_means", "SELECT sector, count(*) AS n, round(avg(close) + 1e-9, 6) AS mean_close, sum(volume) AS volume FROM px JOIN sym USING (symbol) GROUP BY sector")
def a01(p):
    return p.prices.join(p.symbols, "symbol").groupBy("sector").agg(F.count(F.lit(1)).alias("n"), R(F.avg("close")).alias("mean_close"), F.sum("volume").alias("volume"))


@query("a02_null_sum", "SELECT symbol, broker, analyst, round(sum(previous_target) + 1e-9, 4) AS total FROM rep GROUP BY symbol, broker, analyst")
def a02(p):
    return p.reports.groupBy("symbol", "broker", "analyst").agg(R(F.sum("previous_target"), 4).alias("total"))


@query("a03_hit_ratio", "SELECT broker, round(avg((target >= price)::INT::DOUBLE) + 1e-9, 6) AS up, round(avg((target > previous_target)::INT::DOUBLE) + 1e-9, 6) AS raised FROM rep GROUP BY broker")
def a03(p):
    rate = lambda c: R(F.avg(c.cast("double")))
    return p.reports.groupBy("broker").agg(rate(F.col("target") >= F.col("price")).alias("up"), rate(F.col("target") > F.col("previous_target")).alias("raised"))


@query("a04_a05_errors", "SELECT broker, round(sqrt(avg(e * e)) + 1e-9, 6) AS rmse, round(avg(abs(e)) + 1e-9, 6) AS mae, round(avg(e) + 1e-9, 6) AS bias, round(stddev_pop(e) + 1e-9, 6) AS std FROM (SELECT broker, target - price AS e FROM rep) GROUP BY broker")
def a04(p):
    own = p.reports.withColumn("e", F.col("target") - F.col("price"))
    return own.groupBy("broker").agg(R(F.sqrt(F.avg(F.col("e") * F.col("e")))).alias("rmse"), R(F.avg(F.abs("e"))).alias("mae"), R(F.avg("e")).alias("bias"), R(F.stddev_pop("e")).alias("std"))


@query("a06_median_quantiles", "SELECT symbol, round(median(close) + 1e-9, 6) AS median, round(quantile_cont(close, 0.9) + 1e-9, 6) AS p90 FROM px GROUP BY symbol")
def a06(p):
    return p.prices.groupBy("symbol").agg(R(F.median("close")).alias("median"), R(F.percentile("close", 0.9)).alias("p90"))


@query("a07_rank_ic", f"SELECT symbol, round(corr(a, b) + 1e-9, 6) AS rank_ic, count(*) AS n FROM (SELECT symbol, {_rank('close', 'symbol')} AS a, {_rank('volume', 'symbol')} AS b FROM px) GROUP BY symbol HAVING count(*) >= 5")
def a07(p):
    own = p.prices.select("symbol", W.pct_rank(F.col("close"), "symbol").alias("a"), W.pct_rank(F.col("volume"), "symbol").alias("b"))
    return own.groupBy("symbol").agg(R(F.corr("a", "b")).alias("rank_ic"), F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("a08_corr_beta", "SELECT symbol, round(corr(px.close, idx.close) + 1e-9, 6) AS corr, round(covar_pop(px.close, idx.close) / nullif(var_pop(idx.close), 0) + 1e-9, 6) AS beta FROM px JOIN idx ON px.date = idx.date AND benchmark = 'MAIN' GROUP BY symbol")
def a08(p):
    own = p.prices.join(p.index.where("benchmark = 'MAIN'").select("date", F.col("close").alias("i")), "date")
    return own.groupBy("symbol").agg(R(F.corr("close", "i")).alias("corr"), R(F.try_divide(F.covar_pop("close", "i"), F.var_pop("i"))).alias("beta"))


@query("a09_sign_agreement", f"SELECT symbol, round(avg((sign(a) = sign(b))::INT::DOUBLE) + 1e-9, 6) AS agreement FROM (SELECT symbol, close - lag(close) OVER {_S} AS a, volume - lag(volume) OVER {_S} AS b FROM px) GROUP BY symbol")
def a09(p):
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(W.series()))
    own = p.prices.select("symbol", step("close").alias("a"), step("volume").alias("b"))
    return own.groupBy("symbol").agg(R(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("agreement"))


@query("a10_weighted_mean", "SELECT ticker, round(sum(sentiment * source_weight) / sum(source_weight) + 1e-9, 6) AS score FROM posts GROUP BY ticker")
def a10(p):
    return p.posts.groupBy("ticker").agg(R(F.sum(F.col("sentiment") * F.col("source_weight")) / F.sum("source_weight")).alias("score"))


@query("a11_duplicate_score", "SELECT channel, round(1 - count(DISTINCT duplicate_key)::DOUBLE / count(*) + 1e-9, 6) AS duplicate_score FROM posts GROUP BY channel")
def a11(p):
    one = p.posts.groupBy("channel", "duplicate_key").agg(F.count(F.lit(1)).alias("n"))
    return one.groupBy("channel").agg(R(1 - F.count(F.lit(1)) / F.sum("n")).alias("duplicate_score"))


@query("a12_top_values", "SELECT channel, ticker, n, rn::BIGINT AS place FROM (SELECT channel, ticker, count(*) AS n, row_number() OVER (PARTITION BY channel ORDER BY count(*) DESC, ticker) AS rn FROM posts GROUP BY channel, ticker) WHERE rn <= 3")
def a12(p):
    n = p.posts.groupBy("channel", "ticker").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("n"), "ticker"))
    return n.withColumn("place", place.cast("long")).where("place <= 3")


@query("a13_mode", "SELECT symbol, broker AS mode FROM (SELECT symbol, broker, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, broker) AS rn FROM rep GROUP BY symbol, broker) WHERE rn = 1")
def a13(p):
    n = p.reports.groupBy("symbol", "broker").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("symbol").agg(F.min_by("broker", F.struct(-F.col("n"), "broker")).alias("mode"))


@query("a14_value_counts", "SELECT ticker, count(*) FILTER (sentiment > 0) AS up, count(*) FILTER (sentiment <= 0) AS down FROM posts GROUP BY ticker")
def a14(p):
    return p.posts.groupBy("ticker").agg(F.count_if(F.col("sentiment") > 0).alias("up"), F.count_if(F.col("sentiment") <= 0).alias("down"))


@query("a15_having", "SELECT symbol, count(*) AS n FROM px GROUP BY symbol HAVING count(*) >= 300")
def a15(p):
    return p.prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 300")


@query("a16_pivot", "SELECT date, sum(volume) FILTER (symbol = '000001') AS v1, sum(volume) FILTER (symbol = '000002') AS v2 FROM px GROUP BY date")
def a16(p):
    pivot = p.prices.groupBy("date").pivot("symbol", ["000001", "000002"]).agg(F.sum("volume"))
    return pivot.withColumnsRenamed({"000001": "v1", "000002": "v2"})


@query("a17_evidence", "SELECT ticker, string_agg(message_id::VARCHAR, ',' ORDER BY rn) AS evidence FROM (SELECT ticker, message_id, row_number() OVER (PARTITION BY ticker ORDER BY urgency DESC, message_id) AS rn FROM posts) WHERE rn <= 3 GROUP BY ticker")
def a17(p):
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("urgency"), "message_id"))
    top = p.posts.withColumn("rn", place).where("rn <= 3")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col("message_id").cast("string").alias("m")))), lambda x: x["m"])
    return top.groupBy("ticker").agg(F.array_join(ids, ",").alias("evidence"))


@query("w01_lag_lead", f"SELECT date, symbol, lag(close, 5) OVER {_S} AS back, lead(close, 3) OVER {_S} AS ahead FROM px")
def w01(p):
    return p.prices.select("date", "symbol", F.lag("close", 5).over(W.series()).alias("back"), F.lead("close", 3).over(W.series()).alias("ahead"))


@query("w02_w05_rolling", f"SELECT date, symbol, round({_roll('avg', 'close', 10)} + 1e-9, 6) AS mean10, round({_roll('stddev_samp', 'close', 10)} + 1e-9, 5) AS std10, {_roll('max', 'close', 60, 20)} AS max60, {_roll('sum', 'volume', 20, 1)} AS sum20 FROM px")
def w02(p):
    c = F.col("close")
    return p.prices.select("date", "symbol", R(W.rolling(F.avg, c, 10)).alias("mean10"), R(W.rolling(F.stddev_samp, c, 10), 5).alias("std10"), W.rolling(F.max, c, 60, 20).alias("max60"), W.rolling(F.sum, F.col("volume"), 20, 1).alias("sum20"))


@query(
    "w06_w07_equity_drawdown",
    """SELECT benchmark, date, round(ln(e) + 1e-9, 6) AS log_equity, round(e / max(e) OVER t - 1 + 1e-9, 6) AS drawdown
FROM (SELECT benchmark, date, exp(sum(ln(1 + r)) OVER t) AS e FROM (SELECT benchmark, date, coalesce(close / lag(close) OVER t - 1, 0.0) / 10 AS r FROM idx WINDOW t AS (PARTITION BY benchmark ORDER BY date)) WINDOW t AS (PARTITION BY benchmark ORDER BY date))
WINDOW t AS (PARTITION BY benchmark ORDER BY date)""",
)
def w06(p):
    time = Window.partitionBy("benchmark").orderBy("date")
    own = p.index.select("benchmark", "date", (F.coalesce(F.col("close") / F.lag("close").over(time) - 1, F.lit(0.0)) / 10).alias("r"))
    own = own.select("benchmark", "date", W.compounded(F.col("r"), time).alias("e"))
    return own.select("benchmark", "date", R(F.log("e")).alias("log_equity"), R(W.drawdown(F.col("e"), time)).alias("drawdown"))


@query("w08_run_length", f"SELECT date, symbol, CASE WHEN f THEN rn - coalesce(max(CASE WHEN NOT f THEN rn END) OVER {_S}, 0) ELSE 0 END AS run FROM (SELECT date, symbol, coalesce(foreign_net_value > 0, false) AS f, row_number() OVER {_S} AS rn FROM flow)")
def w08(p):
    return p.flows.select("date", "symbol", W.run_length(F.col("foreign_net_value") > 0).cast("long").alias("run"))


@query("w10_first_ranks", "SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS down, row_number() OVER (PARTITION BY date ORDER BY close, symbol) AS up, count(close) OVER (PARTITION BY date) AS n FROM px")
def w10(p):
    return p.prices.select("date", "symbol", W.first_rank(F.col("close"), "date").cast("long").alias("down"), W.first_rank(F.col("close"), "date", ascending=True).cast("long").alias("up"), F.count("close").over(W.by("date")).alias("n"))


@query("w14_period_last", "SELECT DISTINCT max(date) OVER (PARTITION BY date_trunc('month', date)) AS month_end, max(date) OVER (PARTITION BY date_trunc('quarter', date)) AS quarter_end FROM px")
def w14(p):
    last = lambda unit: F.max("date").over(Window.partitionBy(F.trunc("date", unit)))
    return p.prices.select("date").distinct().select(last("month").alias("month_end"), last("quarter").alias("quarter_end")).distinct()


@query("w15_w16_every_nth_tail", f"SELECT date, symbol, close FROM (SELECT *, row_number() OVER {_S} AS rn, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM px) WHERE (rn - 1) % 21 = 0 AND back <= 500")
def w15(p):
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    own = p.prices.withColumn("rn", F.row_number().over(W.series())).withColumn("back", back)
    return own.where("(rn - 1) % 21 = 0 and back <= 500").select("date", "symbol", "close")


@query("w17_calendar_range", "SELECT report_id, count(*) OVER (PARTITION BY symbol ORDER BY report_date RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW) AS n30 FROM rep")
def w17(p):
    day = F.datediff("report_date", F.lit("1970-01-01").cast("date"))
    return p.reports.select("report_id", F.count(F.lit(1)).over(Window.partitionBy("symbol").orderBy(day).rangeBetween(-29, 0)).alias("n30"))


@query("w18_forward_path", "SELECT date, symbol, len(path)::BIGINT AS steps, list_max(path) AS top FROM (SELECT date, symbol, array_agg(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS path FROM px)")
def w18(p):
    path = F.collect_list("close").over(W.series().rowsBetween(0, 5))
    return p.prices.select("date", "symbol", F.size(path).cast("long").alias("steps"), F.array_max(path).alias("top"))


@query("k01_k02_ordered_limit", "SELECT report_id, previous_target FROM rep ORDER BY previous_target DESC NULLS LAST, report_id LIMIT 50")
def k01(p):
    return p.reports.select("report_id", "previous_target").orderBy(F.desc_nulls_last("previous_target"), "report_id").limit(50)


@query("k03_top_per_group", "SELECT date, symbol, close FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rn FROM px) WHERE rn <= 3")
def k03(p):
    return p.prices.withColumn("rn", W.first_rank(F.col("close"), "date")).where("rn <= 3").select("date", "symbol", "close")


@query("k04_top_with_exclusion", "SELECT date, symbol, 'low' AS side FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume, symbol) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS top FROM px) WHERE top > 3) WHERE rn <= 2")
def k04(p):
    top = p.prices.withColumn("rn", W.first_rank(F.col("close"), "date")).where("rn > 3").drop("rn")
    return top.withColumn("rn", W.first_rank(F.col("volume"), "date", ascending=True)).where("rn <= 2").select("date", "symbol", F.lit("low").alias("side"))


@query("k05_union_all", "SELECT 'c' AS kind, c_custkey AS k, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def k05(p):
    c = p.table("customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(p.table("supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance")))


@query("k06_set_difference", "SELECT date, len([x for x in s if NOT list_contains(coalesce(lag_s, []), x)])::BIGINT AS entered FROM (SELECT date, s, lag(s) OVER (ORDER BY date) AS lag_s FROM (SELECT date, list(DISTINCT symbol) AS s FROM px GROUP BY date))")
def k06(p):
    own = p.prices.groupBy("date").agg(F.collect_set("symbol").alias("s"))
    before = F.coalesce(F.lag("s").over(Window.orderBy("date")), F.array().cast("array<string>"))
    return own.select("date", F.size(F.array_except("s", before)).cast("long").alias("entered"))


@query("k07_distinct", "SELECT DISTINCT broker, analyst FROM rep")
def k07(p):
    return p.reports.select("broker", "analyst").distinct()


@query("k08_replicate", "SELECT symbol, horizon FROM sym, (VALUES ('1M'), ('3M'), ('6M')) h(horizon)")
def k08(p):
    return p.symbols.select("symbol", F.explode(F.array(*map(F.lit, ("1M", "3M", "6M")))).alias("horizon"))
