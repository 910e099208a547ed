"""Records inside JSON, XML and feed payloads, as rows with clean text, numbers and dates."""

from __future__ import annotations

import html
import json
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The keys that records are looked for under, in order; markets by the names that sources use; zones and months of mail dates.
HOLDERS = ("items", "item", "data", "records", "result", "response", "body")
MARKETS = {"KOSPI": ("KOSPI", "KS", "STK", "유가증권", "거래소"), "KOSDAQ": ("KOSDAQ", "KQ", "코스닥"), "ALL": ("ALL", "TOTAL", "전체", "합계")}
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
# Names that sources give the columns of credit balances.
CREDIT = {
    "date": ("date", "basDt", "trdDd", "기준일", "일자"), "market": ("market", "mrktCtg", "시장", "시장구분"),
    "balance": ("credit_loan_balance_krw", "crdLoanBal", "loanBalance", "융자잔고", "신용융자잔고", "신용거래융자"),
    "delta_1": ("credit_loan_delta_1d_krw", "crdLoanBalDelta1d", "전일대비", "증감"), "delta_5": ("credit_loan_delta_5d_krw", "crdLoanBalDelta5d"),
    "delta_20": ("credit_loan_delta_20d_krw", "crdLoanBalDelta20d"), "share": ("credit_to_market_cap", "creditToMarketCap", "시총대비"),
}


def _inside(value) -> list[dict]:
    """The records of a parsed payload: of a list its objects, of an object those under the first holder that has some, else itself."""
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if not isinstance(value, dict) or not value:
        return []
    return next((found for key in HOLDERS if (found := _inside(value.get(key)))), [value])


def _elements(text: str, tag: str) -> list[dict]:
    try:
        return [{c.tag: c.text for c in item} for item in ElementTree.fromstring(text).iter(tag)]
    except ElementTree.ParseError:
        return []


def _records(text: str | None, tag: str) -> list[dict[str, str | None]]:
    text = (text or "").strip()
    if text.startswith("<"):
        found = _elements(text, tag)
    else:
        try:
            found = _inside(json.loads(text)) if text else []
        except (ValueError, RecursionError):
            found = []
    plain = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    return [{str(k): plain(v) for k, v in r.items()} for r in found]


def _plain(text: str | None) -> str | None:
    """Without tags, references decoded."""
    return text and html.unescape(re.sub("<[^>]+>", "", text))


def records(payload: Column, tag: str = "item", plain: tuple[str, ...] = ()) -> Column:
    """The records of a JSON or XML payload as maps of texts; nothing of a NULL, empty or broken one.

    Values of the names in ``plain`` come without tags, references decoded: a
    task needs no further Python worker for them.
    """

    @F.pandas_udf("array<map<string,string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{k: _plain(v) if k in plain else v for k, v in r.items()} for r in _records(t, tag)])

    return run(payload)


def first_of(record: Column, names: tuple[str, ...]) -> Column:
    """The value of the first name that the record has."""
    return F.coalesce(*[F.try_element_at(record, F.lit(n)) for n in names])


def number(text: Column) -> Column:
    """A number with commas and a percent sign, or NULL."""
    return F.trim(F.regexp_replace(text, "[,%]", "")).try_cast("double")


def day(text: Column) -> Column:
    """A date written as 20240131, 2024-01-31 or the beginning of a timestamp."""
    plain = F.regexp_replace(F.trim(text), r"^(\d{4})[-./]?(\d{2})[-./]?(\d{2}).*$", "$1-$2-$3")
    return plain.try_cast("date")


def market(text: Column) -> Column:
    name = F.upper(F.trim(text))
    out = F.lit(None).cast("string")
    for known, aliases in MARKETS.items():
        out = F.when(name.isin(*aliases), known).otherwise(out)
    return out


def credit_balances(payloads: DataFrame, *, payload: str = "payload", order: str = "payload_id") -> DataFrame:
    """date, market, balance, deltas and share from payloads; of a date's and market's records the last one counts.

    A delta that no record gives is taken from the balance 1, 5 and 20 rows before.
    """
    from quantloom.sources.tables import with_deltas

    own = payloads.select(F.col(order).alias("o"), F.posexplode(records(F.col(payload))).alias("pos", "r"))
    read = {"date": day(first_of(F.col("r"), CREDIT["date"])), "market": market(first_of(F.col("r"), CREDIT["market"]))}
    read |= {c: number(first_of(F.col("r"), names)) for c, names in CREDIT.items() if c not in read}
    rows = own.select("o", "pos", *[x.alias(c) for c, x in read.items()]).where("date is not null and market is not null")
    last = rows.groupBy("date", "market").agg(F.max(F.struct("o", "pos", *[c for c in read if c not in ("date", "market")])).alias("l"))
    return with_deltas(last.select("date", "market", *[F.col(f"l.{c}").alias(c) for c in read if c not in ("date", "market")]), "balance")


def mail_date(text: Column) -> Column:
    """The UTC time (without zone) of a date such as ``Mon, 02 Jan 2006 15:04:05 +0900``; NULL if it is none, local if it has no zone."""
    pattern = r"^\s*(?:[A-Za-z]{3},?\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{1,2}:\d{2}(?::\d{2})?)\s*([+-]\d{4}|[A-Za-z]{1,3})?\s*(?:\(.*\))?\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.initcap(F.lower(part(2))))
    time = F.when(F.length(part(4)) <= 5, F.concat(part(4), F.lit(":00"))).otherwise(part(4))
    stamp = F.concat_ws(" ", F.concat_ws("-", part(3), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(1), 2, "0")), F.lpad(time, 8, "0"))
    zone = part(5)
    signed = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    named = F.lit(0)
    for name, minutes in ZONES.items():
        named = F.when(F.upper(zone) == name, F.lit(minutes)).otherwise(named)
    offset = F.when(zone.startswith("+"), signed).when(zone.startswith("-"), -signed).otherwise(named)
    at = F.when(month > 0, stamp.try_cast("timestamp_ntz"))
    return (at - F.make_interval(mins=offset)).cast("timestamp_ntz")


def article_id(*parts: Column) -> Column:
    """The hash of the parts, NULL as empty, a bar between them."""
    return F.sha2(F.array_join(F.array(*[F.coalesce(x.cast("string"), F.lit("")) for x in parts]), "|").cast("binary"), 256)


def _iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def feed_entries(feeds: DataFrame, *, most: int = 50, limit: int = 500, trim_titles: bool = True) -> DataFrame:
    """Articles of feeds (feed_id, source, payload): the first ``most`` entries of each, of entries with one link the first.

    An entry's key is its link, or what identifies it; entries without a title
    are left out.  Texts are plain, summaries cut to ``limit`` characters, times UTC.
    Without ``trim_titles`` a title keeps a blank at its ends, as a source wrote it.
    """
    from quantloom.functions import text as T

    own = feeds.select("feed_id", "source", F.posexplode(records(F.col("payload"), plain=("title", "summary", "description", "subtitle"))).alias("pos", "r")).where(F.col("pos") < most)
    field = lambda *names: F.nullif(F.trim(first_of(F.col("r"), names)), F.lit(""))
    title = T.squeezed(field("title")) if trim_titles else F.regexp_replace(F.coalesce(first_of(F.col("r"), ("title",)), F.lit("")), r"\s+", " ")
    guid = field("id", "guid")
    link = F.coalesce(field("link"), F.when(guid.startswith("http"), guid))
    read = own.select(
        "feed_id", "source", "pos", title.alias("title"), T.excerpt(field("summary", "description", "subtitle"), limit).alias("summary"),
        link.alias("link"), guid.alias("guid"), mail_date(field("pubDate", "published", "updated")).alias("pub_date"),
    ).where("trim(title) <> ''")
    keyed = read.withColumn("key", F.lower(F.coalesce("link", "guid", F.concat_ws(":", F.col("feed_id").cast("string"), F.col("pos").cast("string")))))
    first = F.row_number().over(Window.partitionBy("key").orderBy("feed_id", "pos"))
    one = keyed.withColumn("n", first).where("n = 1")
    both = F.concat_ws(" ", "title", F.when(F.col("summary") != "", F.col("summary")))
    return one.select(
        article_id(F.col("source"), F.col("link"), F.col("guid"), F.col("title"), _iso(F.col("pub_date"))).alias("article_id"), "source", "title", "summary", "link", "pub_date",
        T.tickers(both).alias("tickers"), T.themes(both).alias("themes"), T.unit_sentiment(T.sentiment(both)).alias("sentiment"),
    )


def search_articles(results: DataFrame) -> DataFrame:
    """Articles of news searches (symbol, payload with items): plain texts, UTC times, and an id of links and title."""
    from quantloom.functions import text as T

    own = results.select("symbol", F.explode(records(F.col("payload"), plain=("title", "description"))).alias("r"))
    field = lambda name: F.nullif(F.trim(F.try_element_at("r", F.lit(name))), F.lit(""))
    read = own.select("symbol", T.squeezed(field("title")).alias("title"), T.squeezed(field("description")).alias("description"), field("originallink").alias("originallink"), field("link").alias("link"), mail_date(field("pubDate")).alias("pub_date"))
    return read.select(article_id(F.col("symbol"), F.col("originallink"), F.col("link"), F.col("title"), _iso(F.col("pub_date"))).alias("article_id"), *read.columns)
