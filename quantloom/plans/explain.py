"""Queries over links abroad, regimes as of a date and explanations of moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions import text as T
from quantloom.functions.columns import rounded
from quantloom.functions.windows import change, rolling
from quantloom.operators import explain as E
from quantloom.operators import links as L
from quantloom.operators import market as M
from quantloom.operators import rules as R
from quantloom.operators.asof import latest_by_day
from quantloom.operators.explain import any_word

from .market import BARS
from .primitives import SENT
from .registry import query
from .rules import _HOLD, _LIMIT, _PART, _SIG, REGIME, _names

#: The regions stand for what the links read; each sector has two of them as proxies.
ROLES = {"lever": "R0", "fund": "R1", "broad": "R2", "growth": "R3", "currency": "R4"}
TECH = ("R2", "R3")
CHIP_SECTOR = "MEDIUM"
# Words of the invented languages of the test tables in place of the subjects that the rules look for.
MACRO = {"macro_chip": ("thnt",), "macro_currency": ("onnt",), "macro_leverage": ("queque",), "macro_selling": ("erti",), "macro_appetite": ("anin",)}
POSTS = {"posts_bad": ("error",), "posts_good": ("purchase",)}
BAD, GOOD = ("thth", "elle"), ("ndly", "ering")


def _proxies(p):
    i = F.dense_rank().over(E.Window.orderBy("sector")) - 1  # a row for each sector
    sectors = p.symbols.select("sector").distinct().withColumn("i", i)
    return sectors.select("sector", F.explode(F.array(F.concat(F.lit("R"), (F.col("i") % 5).cast("string")), F.concat(F.lit("R"), ((F.col("i") + 2) % 5).cast("string")))).alias("symbol"))


def _sectors(p):
    own = p.prices.select("date", "symbol", change(F.col("close"), 1).alias("r")).join(p.symbols.select("symbol", "sector"), "symbol")
    return L.sector_link(own.groupBy("date", "sector").agg(F.avg("r").alias("r")), M.daily_bars(p.world), _proxies(p))


def _score(x: str, span: str) -> str:
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN greatest(0.0, least(1.0, 0.5 + {x} / (2 * {span}::DOUBLE))) END, 0.5)"


SECTOR = f"""
pr AS (SELECT sector, unnest(['R' || (i % 5), 'R' || ((i + 2) % 5)]) AS symbol FROM (SELECT sector, row_number() OVER (ORDER BY sector) - 1 AS i FROM (SELECT DISTINCT sector FROM sym))),
gs AS (SELECT sector, trade_date, avg(return_1d) AS g, avg(return_5d) AS g5 FROM bars JOIN pr USING (symbol) GROUP BY ALL HAVING avg(return_1d) IS NOT NULL),
gz AS (SELECT *, CASE WHEN count(*) OVER w >= 5 AND stddev_pop(g) OVER w > 1e-9 THEN (g - avg(g) OVER w) / stddev_pop(g) OVER w END AS z FROM gs WINDOW w AS (PARTITION BY sector ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
ds AS (SELECT date, sector, avg(r) AS r FROM (SELECT date, symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px) JOIN sym USING (symbol) GROUP BY date, sector),
cm AS (SELECT sector, date, count(*) OVER w AS n, CASE WHEN count(*) OVER w >= 5 AND var_pop(g) OVER w > 1e-12 THEN covar_pop(g, r) OVER w / var_pop(g) OVER w END AS beta,
  CASE WHEN count(*) OVER w >= 5 AND var_pop(g) OVER w > 1e-24 AND var_pop(r) OVER w > 1e-24 THEN covar_pop(g, r) OVER w / sqrt(var_pop(g) OVER w) / sqrt(var_pop(r) OVER w) END AS c, CASE WHEN count(*) OVER w >= 5 THEN avg((sign(g) = sign(r))::INT::DOUBLE) OVER w END AS agree
  FROM ds JOIN gs USING (sector) WHERE trade_date = date AND r IS NOT NULL WINDOW w AS (PARTITION BY sector ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
sl AS (SELECT ds.date, ds.sector, ds.r, gz.trade_date AS abroad_at, g AS sector_return, g5 AS sector_return_5d, z AS zscore, n AS n_common, beta, c AS corr, coalesce(agree, 0.5) AS agreement,
  greatest(0.0, least(1.0, 0.45::DOUBLE * {_score("g", "0.04")} + 0.25::DOUBLE * {_score("z", "3.0")} + 0.15::DOUBLE * (0.5 + 0.25 * greatest(-1.0, least(1.0, coalesce(c, 0.0)))) + 0.15::DOUBLE * coalesce(agree, 0.5))) AS sector_impact
  FROM ds ASOF LEFT JOIN gz ON ds.sector = gz.sector AND ds.date - 1 >= gz.trade_date ASOF LEFT JOIN cm ON ds.sector = cm.sector AND ds.date - 1 >= cm.date)
"""


@query(
    "g12_sector_link",
    "SELECT date, sector, abroad_at, round(sector_return + 1e-9, 6) AS sector_return, round(sector_return_5d + 1e-9, 6) AS sector_return_5d, round(zscore + 1e-9, 4) AS zscore, n_common, round(beta + 1e-9, 4) AS beta, round(corr + 1e-9, 4) AS corr, round(agreement + 1e-9, 6) AS agreement, round(sector_impact + 1e-9, 4) AS impact FROM sl",
    BARS, SECTOR,
)
def g12(p):
    own = _sectors(p)
    return own.select("date", "sector", "abroad_at", rounded(F.col("sector_return")).alias("sector_return"), rounded(F.col("sector_return_5d")).alias("sector_return_5d"), rounded(F.col("zscore"), 4).alias("zscore"), "n_common", *[rounded(F.col(c), 4).alias(c) for c in ("beta", "corr")], rounded(F.col("agreement")).alias("agreement"), rounded(F.col("sector_impact"), 4).alias("impact"))


def _returns(df, key, names):
    own = df.select("date", key, change(F.col("close"), 1, key=key).alias("r"))
    return own.groupBy("date").agg(*[F.max(F.when(F.col(key) == k, F.col("r"))).alias(n) for n, k in names.items()])


STOCKS, INDEXES = {"stock_a": "000001", "stock_b": "000007"}, {"index_a": "MAIN", "index_b": "GROWTH"}
FLOW_SPAN = 200_000.0


def _funds(p):
    nets = p.flows.groupBy("date").agg(*[rounded(F.sum(f"{k}_net_value"), 2).alias(f"{k}_net") for k in ("foreign", "institution", "retail")])
    local = nets.join(_returns(p.index, "benchmark", INDEXES), "date", "left").join(_returns(p.prices, "symbol", STOCKS), "date", "left")
    ratio = F.try_divide(F.col("volume"), rolling(F.avg, F.col("volume"), 20, 5, order="trade_date"))
    bars = p.world.select("trade_date", "symbol", rounded(change(F.col("close"), 1, order="trade_date")).alias("return_1d"), ratio.alias("volume_ratio"))
    snaps = p.snapshots.groupBy("symbol", "day").agg(F.max("at").alias("at"), F.max_by("change_rate", "at").alias("change_rate"))
    return L.fund_link(nets.select("date"), bars, snaps, ROLES, local, flow_span=FLOW_SPAN)


_ROLE = ", ".join(f"max(v) FILTER (symbol = '{s}') AS {r}_return" for r, s in ROLES.items())
FUNDS = f"""
nets AS (SELECT date, round(sum(foreign_net_value) + 1e-9, 2) AS foreign_net, round(sum(institution_net_value) + 1e-9, 2) AS institution_net, round(sum(retail_net_value) + 1e-9, 2) AS retail_net FROM flow GROUP BY date),
ix AS (SELECT date, max(r) FILTER (benchmark = 'MAIN') AS index_a, max(r) FILTER (benchmark = 'GROWTH') AS index_b FROM (SELECT *, close / lag(close) OVER (PARTITION BY benchmark ORDER BY date) - 1 AS r FROM idx) GROUP BY date),
sx AS (SELECT date, max(r) FILTER (symbol = '000001') AS stock_a, max(r) FILTER (symbol = '000007') AS stock_b FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM px) GROUP BY date),
wv AS (SELECT trade_date, symbol, return_1d, volume / nullif(CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END, 0) AS volume_ratio FROM bars JOIN world USING (trade_date, symbol) WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
sn AS (SELECT symbol, day, arg_max(change_rate, seq) AS change_rate FROM snap GROUP BY symbol, day),
asked AS (SELECT date, 'R' || i AS symbol FROM nets, range(5) AS t(i)),
fw AS (SELECT a.date, a.symbol, wv.return_1d, wv.volume_ratio, wv.trade_date, sn.change_rate, sn.day, coalesce(sn.change_rate, wv.return_1d) AS v FROM asked a ASOF LEFT JOIN wv ON a.symbol = wv.symbol AND a.date - 1 >= wv.trade_date ASOF LEFT JOIN sn ON a.symbol = sn.symbol AND a.date >= sn.day),
f1x AS (SELECT date, {_ROLE}, max(volume_ratio) FILTER (symbol = 'R0') AS lever_volume_ratio, max(CASE WHEN change_rate IS NOT NULL THEN day ELSE trade_date END) FILTER (symbol = 'R0') AS signal_date, max(CASE WHEN change_rate IS NOT NULL THEN 'snapshot' WHEN return_1d IS NOT NULL THEN 'bar' END) FILTER (symbol = 'R0') AS signal_source FROM fw GROUP BY date),
fl AS (SELECT *, lever_return - fund_return AS spread, lever_return - 3 * fund_return AS drift, coalesce(least(index_a, index_b) <= -0.02, false) AS shock,
  greatest(0.0, least(1.0, 0.20::DOUBLE * {_score("fund_return", "0.025")} + 0.15::DOUBLE * ({_score("index_a", "0.025")} + {_score("index_b", "0.03")}) / 2 + 0.20::DOUBLE * ({_score("stock_a", "0.03")} + {_score("stock_b", "0.03")}) / 2 + 0.15::DOUBLE * {_score("foreign_net", str(FLOW_SPAN))}
  + 0.10::DOUBLE * {_score("(-currency_return)", "0.01")} + 0.10::DOUBLE * ({_score("broad_return", "0.02")} + {_score("growth_return", "0.025")}) / 2 + 0.10::DOUBLE * 0.5)) AS impact
  FROM f1x LEFT JOIN nets USING (date) LEFT JOIN ix USING (date) LEFT JOIN sx USING (date))
"""
_FUND_COLUMNS = [*[f"{r}_return" for r in ROLES], "lever_volume_ratio", "spread", "drift", "index_a", "index_b", "stock_a", "stock_b"]


@query("g09_fund_link", f"SELECT date, signal_date, signal_source, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in _FUND_COLUMNS)}, foreign_net, institution_net, retail_net, shock, round(impact + 1e-9, 4) AS impact FROM fl", BARS, FUNDS)
def g09(p):
    return _funds(p).select("date", "signal_date", "signal_source", *[rounded(F.col(c)).alias(c) for c in _FUND_COLUMNS], "foreign_net", "institution_net", "retail_net", "shock", rounded(F.col("impact"), 4).alias("impact"))


def _series(p):
    """Bars with the change in basis points, from which the regime's series are taken."""
    step = F.col("close") - F.lag("close").over(E.Window.partitionBy("symbol").orderBy("trade_date"))
    return M.daily_bars(p.world).withColumn("bp", rounded(step * 100, 4))


_WANTED = {**_SIG, "rate_bp": ("R4", "bp")}


def _regimes(p, days):
    return L.regime_by_day(days, _series(p), _WANTED, _LIMIT)


REGIME_ASOF = f"""
rd AS (SELECT DISTINCT date FROM px),
ra AS (SELECT d.date, q.* FROM (SELECT date, 'R' || i AS s FROM rd, range(5) AS t(i)) d ASOF LEFT JOIN q0 q ON d.s = q.symbol AND d.date >= q.trade_date),
rw AS (SELECT date, {", ".join(f"max({c}) FILTER (symbol = '{s}') AS {n}" for n, (s, c) in _WANTED.items())} FROM ra GROUP BY date),
r2 AS (SELECT *, {_PART}, {_names(*[(h, n) for n, h in _HOLD.items()])} AS signals FROM rw),
rg AS (SELECT *, {" + ".join(f"{x}_score" for x in R.PARTS)} AS risk FROM r2),
rr AS (SELECT *, CASE WHEN risk >= 70 THEN 'panic' WHEN risk >= 45 THEN 'risk_off' WHEN risk >= 20 THEN 'neutral' ELSE 'risk_on' END AS regime FROM rg)
"""


@query("g14_regime_by_day", "SELECT date, risk, regime, array_to_string(signals, ',') AS signals FROM rr", BARS, REGIME, REGIME_ASOF)
def g14(p):
    return _regimes(p, p.prices.select("date").distinct()).select("date", "risk", "regime", F.array_join("signals", ",").alias("signals"))


@query(
    "d12_global_adjustment",
    f"SELECT symbol, risk, round(least(0.35::DOUBLE, risk / 100.0 * 0.22::DOUBLE * CASE WHEN sector = '{CHIP_SECTOR}' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) + 1e-9, 6) AS penalty, round(greatest(0.1::DOUBLE, 1 - 0.5::DOUBLE * risk / 100.0) + 1e-9, 6) AS confidence FROM sym, (SELECT risk FROM rr WHERE date = (SELECT max(date) FROM rr))",
    BARS, REGIME, REGIME_ASOF,
)
def d12(p):
    """Every symbol's penalty and confidence under the regime of the latest date."""
    latest = p.prices.agg(F.max("date").alias("date"))
    now = _regimes(p, latest).select("risk")  # one row
    tender = F.when(F.col("sector") == CHIP_SECTOR, 1.15).otherwise(1.0)
    own = p.symbols.join(F.broadcast(now))
    return own.select("symbol", "risk", rounded(F.least(F.lit(0.35), F.col("risk") / 100.0 * 0.22 * tender)).alias("penalty"), rounded(F.greatest(F.lit(0.1), 1 - 0.5 * F.col("risk") / 100.0)).alias("confidence"))


# --- explanations -----------------------------------------------------------------

INVESTORS = ("foreign", "institution", "retail", "pension")


@query(
    "x02_tail_flows",
    f"""SELECT symbol, date, {", ".join(f"round({k}_{n} + 1e-9, 2) AS {k}_{n}" for k in INVESTORS for n in (1, 5, 20))} FROM tf""",
    TAILS := f"""
fp AS (SELECT date, symbol, foreign_net_value AS "foreign", institution_net_value AS institution, retail_net_value AS retail, pension_net_value AS pension FROM flow LEFT JOIN pens USING (date, symbol)),
tf AS (SELECT symbol, date, {", ".join(f"list_sum([x.{k} for x in list_slice(l, -{n}, -1) if x.d >= date - 45]) AS {k}_{n}" for k in ("f", "i", "r", "p") for n in (1, 5, 20))} FROM (
  SELECT symbol, date, list({{'d': date, 'f': "foreign", 'i': institution, 'r': retail, 'p': pension}}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS l FROM fp))
""".replace("AS f_", "AS foreign_").replace("AS i_", "AS institution_").replace("AS r_", "AS retail_").replace("AS p_", "AS pension_"),
)
def x02(p):
    return _tails(p).select("symbol", "date", *[rounded(F.col(f"{k}_{n}"), 2).alias(f"{k}_{n}") for k in INVESTORS for n in (1, 5, 20)])


def _tails(p):
    own = p.flows.join(p.pension, ["date", "symbol"], "left").withColumnsRenamed({f"{k}_net_value": k for k in INVESTORS})
    return E.tail_sums(own, list(INVESTORS))


def _hits(p, days):
    text = F.col("text")
    macro = E.keyword_hits(days, p.dated_news, {n: any_word(text, w) for n, w in MACRO.items()}, on="day", order=[F.desc("article_id")])
    posts = E.keyword_hits(days, p.dated_posts, {n: any_word(F.col("channel"), w) for n, w in POSTS.items()}, on="day", order=[F.desc("source_weight"), F.desc("urgency"), F.desc("message_id")])
    return macro.withColumnRenamed("n", "macro_n").join(posts.withColumnRenamed("n", "posts_n"), "date")


def _context(p):
    """A row for each date: funds, tech series, regime and keywords, as known that day."""
    days = p.prices.select("date").distinct()
    funds = _funds(p).select("date", "lever_return", "fund_return", "currency_return", F.col("impact").alias("fund_impact"))
    tech = latest_by_day(days, M.daily_bars(p.world), {s: (s, "return_1d") for s in TECH}, on="trade_date")
    tech = tech.select("date", F.least(*TECH).alias("tech_low"), F.greatest(*TECH).alias("tech_high"))
    regime = _regimes(p, days).select("date", F.col("risk").cast("double").alias("risk"), "regime", F.size("signals").cast("long").alias("n_signals"), F.array_contains("signals", "currency_fall").alias("signal_currency"))
    return funds.join(tech, "date").join(regime, "date").join(_hits(p, days), "date")


def _moves(p):
    sums = _tails(p).select("symbol", "date", *[F.col(f"{k}_{n}") for k in INVESTORS for n in (1, 5)])
    own = p.prices.select("date", "symbol", change(F.col("close"), 1).alias("move"), change(F.col("close"), 21).alias("ret_21d"))
    own = own.join(p.symbols.select("symbol", "market", "sector"), "symbol").join(sums, ["symbol", "date"], "left")
    text = F.col("text")
    own = E.own_news(own, p.dated_news, on="day", sentiment=T.unit_sentiment(T.sentiment(text)), bad=any_word(text, BAD), good=any_word(text, GOOD))
    return p.keep("moves", lambda: own)  # read for symbols and for markets


def _explained(p):
    moves, context = _moves(p), _context(p)
    nets = [f"{k}_{n}" for k in INVESTORS for n in (1, 5)]
    links = p.keep("sector-links", lambda: _sectors(p).select("date", "sector", "sector_return", "sector_impact"))  # read for symbols and for markets
    symbols = moves.join(links, ["date", "sector"], "left").withColumn("is_chip", F.col("sector") == CHIP_SECTOR)
    symbols = symbols.select(F.lit("symbol").alias("scope"), "date", "symbol", "market", "move", "ret_21d", *nets, "news_n", "news_sentiment", "news_bad", "news_good", "sector_return", "sector_impact", "is_chip")
    counts = moves.groupBy("date", "market").agg(F.count_if(F.col("move") >= E.THRESHOLD).alias("up_count"), F.count_if(F.col("move") <= -E.THRESHOLD).alias("down_count"), *[F.sum(c).alias(c) for c in nets])
    first = F.row_number().over(E.Window.partitionBy("date").orderBy("sector"))
    broad = links.withColumn("i", first).where("i = 1").select("date", "sector_return", "sector_impact")  # the first sector stands for the broad one
    index = p.index.select("date", F.col("benchmark").alias("market"), change(F.col("close"), 1, key="benchmark").alias("move"))
    markets = index.join(counts, ["date", "market"], "left").join(broad, "date", "left").select(F.lit("market").alias("scope"), "date", F.col("market").alias("symbol"), "market", "move", F.col("move").alias("index_return"), "up_count", "down_count", *nets, "sector_return", "sector_impact")
    return E.explained(symbols.unionByName(markets, allowMissingColumns=True).join(context, "date", "left"))


def _words(words, text="text"):
    return "(" + " OR ".join(f"contains(lower(coalesce({text}, '')), '{w}')" for w in words) + ")"


def _window(src: str, order: str, groups: dict, text: str, name: str, count: str) -> str:
    flags = ", ".join(f"{_words(w, text)} AS {n}" for n, w in groups.items())
    return f"""
{name}0 AS (SELECT day, row_number() OVER (ORDER BY day, {order}) AS seq, {flags} FROM {src}),
{name}1 AS (SELECT date, (SELECT max(seq) FROM {name}0 WHERE day <= date) AS upto FROM rd),
{name} AS (SELECT r.date, count(a.seq) AS {count}, {", ".join(f"coalesce(bool_or({n}), false) AS {n}" for n in groups)} FROM {name}1 r LEFT JOIN {name}0 a ON a.day <= r.date AND a.day >= r.date - 14 AND a.seq > r.upto - 40 GROUP BY r.date)"""


_BP = lambda c: f"coalesce(round({c}::DOUBLE * 10000 + 1e-6)::BIGINT::VARCHAR, '-')"
_SHOW = {r.name: f"'{r.kind}[' || " + " || ',' || ".join(_BP(c) for c in r.shows) + " || ']'" for r in E.RULES}
_MADE = ", ".join(f"CASE WHEN {r.when} THEN {{'w': {-r.score}::DOUBLE, 'i': {i}, 'n': '{r.name}', 'e': {_SHOW[r.name]}}} END" for i, r in enumerate(E.RULES))
EXPLAIN = f"""
dn AS (SELECT *, DATE '1995-01-02' + CAST(article_id * 37 % 2500 AS INT) AS day FROM news),
dp AS (SELECT *, DATE '1995-01-02' + CAST(message_id * 37 % 2500 AS INT) AS day FROM posts),
{_window("dn", "article_id", MACRO, "text", "macro", "macro_n")},
{_window("dp", "source_weight, urgency, message_id", POSTS, "channel", "postw", "posts_n")},
sn1 AS (SELECT symbol, day, ({SENT} + 1) / 2 AS s, {_words(BAD)} AS bad, {_words(GOOD)} AS good FROM dn),
mv0 AS (SELECT date, symbol, close / lag(close) OVER s - 1 AS move, close / lag(close, 21) OVER s - 1 AS ret_21d FROM px WINDOW s AS (PARTITION BY symbol ORDER BY date)),
nw AS (SELECT m.date, m.symbol, count(a.s) AS news_n, avg(a.s) AS news_sentiment, coalesce(bool_or(bad), false) AS news_bad, coalesce(bool_or(good), false) AS news_good FROM mv0 m LEFT JOIN sn1 a ON a.symbol = m.symbol AND a.day <= m.date AND a.day >= m.date - 14 GROUP BY m.date, m.symbol),
mv1 AS (SELECT mv0.*, market, sector, sector = '{CHIP_SECTOR}' AS is_chip, tf.* EXCLUDE (symbol, date), news_n, news_sentiment, news_bad, news_good FROM mv0 JOIN sym USING (symbol) LEFT JOIN tf USING (symbol, date) JOIN nw USING (date, symbol)),
nx AS (SELECT date, market, count(*) FILTER (move >= 0.02) AS up_count, count(*) FILTER (move <= -0.02) AS down_count, {", ".join(f"sum({k}_{n}) AS {k}_{n}" for k in INVESTORS for n in (1, 5))} FROM mv1 GROUP BY date, market),
bs AS (SELECT date, sector_return, sector_impact FROM sl QUALIFY row_number() OVER (PARTITION BY date ORDER BY sector) = 1),
tc AS (SELECT date, least(a, b) AS tech_low, greatest(a, b) AS tech_high FROM (SELECT date, max(return_1d) FILTER (symbol = 'R2') AS a, max(return_1d) FILTER (symbol = 'R3') AS b FROM ra GROUP BY date)),
cx AS (SELECT rd.date, lever_return, fund_return, currency_return, fl.impact AS fund_impact, tech_low, tech_high, risk, regime, len(signals) AS n_signals, list_contains(signals, 'currency_fall') AS signal_currency, macro.* EXCLUDE (date), postw.* EXCLUDE (date)
  FROM rd JOIN fl USING (date) JOIN tc USING (date) JOIN rr USING (date) JOIN macro USING (date) JOIN postw USING (date)),
ex0 AS (SELECT 'symbol' AS scope, date, symbol, market, move, NULL::DOUBLE AS index_return, ret_21d, {", ".join(f"{k}_{n}" for k in INVESTORS for n in (1, 5))}, news_n, news_sentiment, news_bad, news_good, sector_return, sector_impact, is_chip, NULL::BIGINT AS up_count, NULL::BIGINT AS down_count FROM mv1 LEFT JOIN sl USING (date, sector)
  UNION ALL SELECT 'market', date, market, market, move, move, NULL, {", ".join(f"{k}_{n}" for k in INVESTORS for n in (1, 5))}, NULL, NULL, NULL, NULL, sector_return, sector_impact, NULL, up_count, down_count FROM (SELECT date, benchmark AS market, close / lag(close) OVER (PARTITION BY benchmark ORDER BY date) - 1 AS move FROM idx) LEFT JOIN nx USING (date, market) LEFT JOIN bs USING (date)),
ex1 AS (SELECT *, CASE WHEN move IS NULL THEN 'UNKNOWN' WHEN move >= 0.02 THEN 'UP' WHEN move <= -0.02 THEN 'DOWN' ELSE 'FLAT' END AS direction, CASE WHEN index_return IS NOT NULL THEN index_return <= -0.02 ELSE coalesce(abs(move) >= 0.02, false) END AS triggered FROM ex0 LEFT JOIN cx USING (date)),
ex2 AS (SELECT *, direction = 'DOWN' AS down, direction = 'UP' AS up, scope = 'market' AS is_market FROM ex1),
ex3 AS (SELECT *, CASE WHEN triggered THEN list_sort([x for x in [{_MADE}] if x IS NOT NULL]) ELSE [] END AS found FROM ex2)
"""


@query(
    "x06_x07_explanations",
    f"""SELECT scope, date, symbol, market, round(move + 1e-9, 6) AS move, direction, triggered, CASE WHEN NOT triggered THEN CASE WHEN move IS NULL THEN 'no_price' WHEN index_return IS NOT NULL THEN 'no_market_shock' ELSE 'no_move' END WHEN len(found) = 0 THEN 'price_alone' ELSE found[1].n END AS "primary",
len(found)::INT AS n_reasons, array_to_string([x.n for x in found], ',') AS reasons, array_to_string(list_concat(['price[' || {_BP("move")} || ']'], CASE WHEN is_market THEN ['breadth[' || {_BP("up_count")} || ',' || {_BP("down_count")} || ']'] ELSE [] END, [x.e for x in list_slice(found, 1, 5)]), ';') AS evidence,
round(CASE WHEN NOT triggered THEN CASE WHEN move IS NULL THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END WHEN len(found) = 0 THEN 0.35::DOUBLE ELSE least(0.95::DOUBLE, 0.42::DOUBLE + 0.12::DOUBLE * len(found) + least(abs(move), 0.08::DOUBLE)) END + 1e-9, 6) AS confidence FROM ex3""",
    BARS, SECTOR, FUNDS, REGIME, REGIME_ASOF, TAILS, EXPLAIN,
)
def x06(p):
    whole = lambda v: F.coalesce(F.round(v["value"] * 10000 + 1e-6).cast("long").cast("string"), F.lit("-"))
    shown = F.transform("evidence", lambda e: F.concat(e["kind"], F.lit("["), F.array_join(F.transform(e["shows"], whole), ","), F.lit("]")))
    return _explained(p).select("scope", "date", "symbol", "market", rounded(F.col("move")).alias("move"), "direction", "triggered", "primary", "n_reasons", F.array_join("reasons", ",").alias("reasons"), F.array_join(shown, ";").alias("evidence"), rounded(F.col("confidence")).alias("confidence"))
