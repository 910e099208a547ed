"""Text column functions over small, fixed lexicons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lexicons in the invented languages of the test tables, and common English words.
THEMES = {"trade": ("export", "import", "ntion"), "energy": ("oil", "gas", "erener"), "chips": ("chip", "memory", "tion")}
POSITIVE, NEGATIVE = ("rise", "gain", "there", "with", "and"), ("fall", "loss", "idiot", "from", "was")
URGENT = (("breaking", 1.0), ("idiot", 1.0), ("today", 0.6), ("this", 0.6), ("the", 0.3))
RISKS = ("password", "secret", "token", "all rights reserved", "clown", "trash")
SECTORS = (("energy", ("oil", "gas", "STEEL")), ("metals", ("copper", "nickel", "tin", "brass")))
TICKER_STOP = ("A", "I", "THE", "AND", "FOR")
WORD_TICKER = r"(?<![A-Za-z0-9])[$#]?[A-Z]{1,5}(?![A-Za-z0-9])"
#: The same where marks belong to the word: neither ``Y$$`` nor ``##Y`` names one.
MARKED_TICKER = r"(?<![A-Za-z0-9$#])[$#]?[A-Z]{1,5}(?![A-Za-z0-9$#])"


def has(text: Column, word: str) -> Column:
    """ASCII substring, in either case."""
    return F.lower(F.coalesce(text, F.lit(""))).contains(word.lower())


def tickers(text: Column, stop: tuple[str, ...] = TICKER_STOP, aliases: dict[str, str] | None = None, pattern: str = WORD_TICKER) -> Column:
    """Sorted upper-case tokens of up to five letters that stand alone, plus aliases by keyword."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0), lambda x: F.regexp_replace(x, r"^[$#]", ""))
    more = F.filter(F.array(*[F.when(has(text, k), F.lit(v)) for k, v in (aliases or {"\x00": ""}).items()]), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.array_except(found, F.array(*map(F.lit, stop))), more)))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """Words of the lexicon that occur, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(has(text, w), F.lit(w)) for w in words]), lambda x: x.isNotNull()))


def themes(text: Column, lexicon: dict[str, tuple[str, ...]] = THEMES) -> Column:
    from functools import reduce

    any_of = lambda words: reduce(lambda a, b: a | b, [has(text, w) for w in words])
    return F.array_sort(F.filter(F.array(*[F.when(any_of(ws), F.lit(t)) for t, ws in lexicon.items()]), lambda x: x.isNotNull()))


def sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """(positive - negative) over both, counting distinct lexicon words; 0 without any."""
    p, n = F.size(hits(text, positive)), F.size(hits(text, negative))
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def unit_sentiment(s: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s + 1) / 2))


def urgency(text: Column, tiers=URGENT) -> Column:
    """The score of the first word that occurs."""
    out = F.when(F.lit(False), 0.0)
    for word, score in tiers:
        out = out.when(has(text, word), F.lit(score))
    return out.otherwise(0.0)


def urls(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"https?://[^\s)>\]]+"), 0), lambda u: F.regexp_replace(u, r"[.,]+$", ""))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def excerpt(text: Column, limit: int) -> Column:
    """White space collapsed; longer texts are cut to limit - 1 characters and three dots."""
    own = squeezed(text)
    return F.when(F.length(own) <= limit, own).otherwise(F.concat(F.rtrim(F.substring(own, 1, limit - 1)), F.lit("...")))


def duplicate_key(text: Column) -> Column:
    """The first URL, else 20 hex digits of the squeezed, lower-cased text's hash."""
    found = urls(text)
    return F.when(F.size(found) > 0, F.concat(F.lit("url:"), F.lower(F.get(found, F.lit(0))))).otherwise(F.concat(F.lit("text:"), F.substring(F.sha2(F.lower(squeezed(text)).cast("binary"), 256), 1, 20)))


def first_match(text: Column, rules, default: str) -> Column:
    """The name of the first rule any of whose aliases occurs."""
    from functools import reduce

    out = F.when(F.lit(False), F.lit(default))
    for name, words in rules:
        out = out.when(reduce(lambda a, b: a | b, [has(text, w) for w in words]), F.lit(name))
    return out.otherwise(F.lit(default))
