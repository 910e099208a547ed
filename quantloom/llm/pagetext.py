"""HTML extraction by wrapper inference over the pages of a host.

A page is a stream of structural tokens with text slots.  Repeats beside each
other fold into repeated groups; the folded streams of a host are aligned one
after the other, and what does not match becomes an optional group; where
many optional items follow each other, a repeated group of them.  The result
is a union-free regular expression, the host's wrapper; it grows with the
template, not with the pages.  Every page is matched against it, which gives
each text a slot.  A slot whose text is the same on nearly all pages that have
it, in a container where nothing varies, is the template's; all other slots
are text, unless marked as boilerplate.

Hot hosts: equal folded streams of a host count once, wrappers are merged in
rounds of salted groups of bounded size, and slots are counted by their text
first.  Wrappers are joined to the pages by host: Spark broadcasts them if
they are below its threshold and else splits hot hosts.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from difflib import SequenceMatcher
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, stage, unstage

SALTS = 32
#: Streams that a group merges on average, in each round.
FAN = 64
#: A slot is constant if so many different pages have it and this share of them has the same text in it.
CONSTANT_PAGES, CONSTANT_SHARE = 3, 0.9
#: Longest run of tokens that one repeated group has.
GROUP = 8
#: Optional items beside each other that become one repeated group of optional items.
OPTIONAL_RUN = 8

# Tags that cut no block, whose content is no text, and that are never part of an article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title canvas audio video select".split())
# Of those, what leaves no gap in a line; what the page's end closes, and what the next tag closes.
SILENT, TO_THE_END, TO_THE_NEXT = frozenset("script style noscript template".split()), frozenset("script style".split()), frozenset("title textarea".split())
# What may stand in a head, and in a select; anything else ends them.
INSIDE = {"head": frozenset("title meta link base script style noscript template object".split()), "select": frozenset("option optgroup hr script template".split())}
OUTSIDE = frozenset("nav footer aside form button dialog menu input".split())
MAIN = ("article", "main")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words beside which a mark is still one (``site-header``, ``ad-box``); beside any other it is not (``entry-header``).
NEUTRAL = frozenset("site page main global top bottom left right upper lower inner outer primary secondary container wrapper wrap holder box bar block section area region zone list lists link links item items module unit slot panel group row col column content body title text icon button btn the id no js x xs sm md lg".split())
# Words of a class or id that mark menus, headers, sidebars, notices, adverts, forms and comments.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies related recommended recommendations pagination pager toolbar form search".split())
# Tags that only frame others; a slot's container is the nearest tag beyond them.
TEXTUAL = frozenset("p br h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tr td th figure figcaption hr center".split())

# Words of readers' comments, and whose or what they may be about; other marks keep the stricter rule.
COMMENTS = frozenset("comment comments disqus reply replies".split())
WHOSE = frozenset("user users reader readers visitor visitors guest guests member members post posts article story entry blog news thread all new latest".split())
# Tags that end a menu which the page never closes, and those that end other boilerplate of that kind.
AFTER_MENU = frozenset("h1 h2 h3 h4 h5 h6 p div section article main table blockquote pre figure header footer aside".split())
AFTER_OTHERS = frozenset("h1 h2 section article main".split())

# Marks that an article may use for parts of its own.
OWN_PARTS = frozenset("header masthead banner".split())

_ATTRS = r"((?:\"[^\"]*\"|'[^']*'|[^'\">])*)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_ATTRS}>|<[!?][^>]*>|[^<]+|<", re.S)
CLOSING = re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*)")
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z0-9]+")


def host_of(url):
    """The host of a URL column, lower-cased, without user and port; null url: empty."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def _marks(attrs: str) -> str:
    """Class and id words of a tag, in order."""
    return ".".join(WORDS.findall(" ".join(a or b or c for a, b, c in MARKED.findall(attrs)).lower())) if attrs else ""


@remembered(1 << 12)
def marked(attrs: str, within: bool = False) -> bool:
    """Whether a class, id or role consists of marks and neutral words only; ``within`` an article its own parts do not count."""
    for a, b, c in MARKED.findall(attrs):
        for name in (a or b or c).lower().split():
            words = set(WORDS.findall(name))
            if words <= MARKS | NEUTRAL and words & (MARKS - OWN_PARTS if within else MARKS):
                return True
            if words & COMMENTS and words <= MARKS | NEUTRAL | WHOSE:
                return True
    return False


def _pieces(page: str):
    """(kind, tag, attributes or text) of a page's pieces: text, open and close tags, and raw elements as a whole.

    A raw element that the page does not close ends with the page, at the next
    tag, or is its start tag alone; no text is searched for an end twice.
    """
    at, low, missing = 0, None, set()
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if m[2] is None:
            if not m[0].startswith(("<!", "<?")):
                yield "text", "", m[0]
            continue
        tag = m[2].lower()
        if m[1] or tag not in RAW:
            yield "close" if m[1] else "open", tag, m[3]
            continue
        low = page.lower() if low is None else low
        stop = -1 if tag in missing else low.find(f"</{tag}", at)
        if stop >= 0:
            end = page.find(">", stop)
            at = len(page) if end < 0 else end + 1
        else:
            missing.add(tag)
            if tag in TO_THE_END:
                at = len(page)
            elif tag in INSIDE:  # an element like others, which what can't be in it ends
                yield "open", tag, m[3]
                continue
            elif tag in TO_THE_NEXT:
                after = page.find("<", at)
                at = len(page) if after < 0 else after
        yield "raw", tag, ""


class Open(NamedTuple):
    """An open element and what it inherits from those around it."""

    tag: str
    bad: bool
    any_bad: bool
    main: str | None  # the innermost article or main
    holder: str  # the innermost element that does more than frame text
    inner: str | None  # the innermost head or select
    open_bad: str | None  # the innermost boilerplate that the page never closes


def blocks(page: str | None) -> tuple[list[tuple[str, bool, str, int]], list[str]]:
    """Text blocks as (container, inside boilerplate, text, place of its slot's token), and the page's structural tokens."""
    out: list[tuple[str, bool, str, int]] = []
    tokens: list[str] = []
    stack: list[Open] = []
    held: Counter[str] = Counter()  # open elements by tag
    text: list[str] = []
    page = page or ""
    closes = {t.lower() for t in CLOSING.findall(page)}
    top = Open("", False, False, None, "body", None, None)

    def flush():
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if own:
                if not tokens or tokens[-1] != "<#>":
                    tokens.append("<#>")
                inside = top.main and (top.main if top.holder == top.main else f"{top.main}>{top.holder}")
                out.append((inside or top.holder, top.any_bad, own, len(tokens) - 1))

    def pop() -> str:
        nonlocal top
        gone = stack.pop().tag
        held[gone] -= 1
        top = stack[-1] if stack else Open("", False, False, None, "body", None, None)
        return gone

    def leave(tag: str) -> None:
        """Close the innermost element of that tag and all inside it."""
        flush()
        while pop() != tag:
            pass
        tokens.append(f"</{tag}>")

    for kind, tag, rest in _pieces(page):
        if top.inner and (kind == "open" and tag not in INSIDE[top.inner] or kind == "text" and top.inner == "head" and rest.strip()):
            leave(top.inner)
        if kind == "text":
            text.append(rest)
            continue
        if kind == "raw":
            if tag not in SILENT:
                text.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if kind == "close":
            if held[tag]:
                leave(tag)
            continue
        marks = _marks(rest)
        name = f"{tag}.{marks}" if marks else tag
        if tag in VOID or rest.rstrip().endswith("/"):
            continue
        if tag in MAIN and not top.main:
            # boilerplate that the page never closes ends where an article starts
            while top.bad and top.tag not in closes:
                pop()
        if top.open_bad and tag in (AFTER_MENU if top.open_bad in ("nav", "menu", "button") else AFTER_OTHERS):
            leave(top.open_bad)
        if top.tag == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            pop()
            tokens.append(f"</{tag}>")
        within = top.main is not None
        bad = tag in OUTSIDE or tag in INSIDE or (tag == "header" and not within) or (tag not in ("html", "body") and marked(rest, within))
        never = bad and tag not in closes and (tag in OUTSIDE or tag == "header")
        top = Open(tag, bad, top.any_bad or bad, name if tag in MAIN else top.main, top.holder if tag in TEXTUAL else name, tag if tag in INSIDE else top.inner, tag if never else top.open_bad)
        stack.append(top)
        held[tag] += 1
        tokens.append(f"<{name}>")
    flush()
    return out, tokens


#: Elements that may stand alone where others of the host's pages repeat them.
SINGLE = ("p", "li", "tr", "dt", "dd")
_ITEM = re.compile(r"\{[^{}]*\}\*|\([^()]*\)[+?*]|<[^>]*>")


def _grouped(items: list[str]) -> str:
    """Items as one repeated group; a group alone stays as it is."""
    return items[0] if len(items) == 1 and items[0][0] == "(" else "(" + "".join(x[1:-2] if x[0] == "(" else x for x in items) + ")+"


def _fold_once(items: list[str], spans: list[tuple[int, int]]) -> tuple[list[str], list[tuple[int, int]]]:
    """Runs of equal neighbours, of one up to GROUP items, as one group each, from left to right."""
    out, own, i = [], [], 0
    while i < len(items):
        for n in range(1, min(GROUP, (len(items) - i) // 2) + 1):
            unit, j = items[i : i + n], i + n
            while items[j : j + n] == unit:
                j += n
            if j > i + n:
                out.append(_grouped(unit))
                own.append((spans[i][0], spans[j - 1][1]))
                i = j
                break
        else:
            out.append(items[i])
            own.append(spans[i])
            i += 1
    return out, own


def fold_spans(tokens: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Repeats beside each other as one group with a plus; lone paragraphs and list items too.  With the tokens of each item."""
    items, spans, i = [], [], 0
    while i < len(tokens):
        alone = i + 2 < len(tokens) and tokens[i + 1] == "<#>" and tokens[i][1:-1] in SINGLE and tokens[i + 2] == f"</{tokens[i][1:-1]}>"
        items.append(_grouped(tokens[i : i + 3]) if alone else tokens[i])
        spans.append((i, i + 3 if alone else i + 1))
        i = spans[-1][1]
    for _ in range(GROUP):
        before = len(items)
        items, spans = _fold_once(items, spans)
        if len(items) == before:
            break
    return "".join(items), spans


def fold(tokens: list[str]) -> str:
    return fold_spans(tokens)[0]


def _items(wrapper: str) -> list[tuple[str, bool]]:
    """(token, repeated group or group of optional items, optional)"""
    out = []
    for x in _ITEM.findall(wrapper):
        if x[0] == "{":
            out.append((x, True))
        elif x[0] != "(" or x[-1] == "+":
            out.append((x, False))
        elif x[-1] == "*":
            out.append((x[:-1] + "+", True))
        else:
            out += [(t, True) for t in re.findall(r"<[^>]*>", x)]
    return out


def units(group: str) -> frozenset[str]:
    """The items of a repeated group of optional items, ``{a,b}*``: any of them, in any order, any number of times."""
    return frozenset(group[1:-2].split(","))


def _grouped_runs(items: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """Long runs of optional items, and those beside such a group, as one repeated group."""
    out, run = [], []
    for x, optional in [*items, ("", False)]:
        if optional:
            run.append(x)
            continue
        groups = [r for r in run if r[0] == "{"]
        if len(run) >= OPTIONAL_RUN or (groups and len(run) > 1):
            every = frozenset().union(*(units(r) if r[0] == "{" else (r,) for r in run))
            out.append(("{" + ",".join(sorted(every)) + "}*", True))
        else:
            out += [(r, True) for r in run]
        run = []
        out.append((x, optional))
    return out[:-1]


def _written(items: list[tuple[str, bool]]) -> str:
    out, run = [], []
    for x, optional in [*items, ("", False)]:
        if optional and x[0] == "<":
            run.append(x)
            continue
        if run:
            out.append(f"({''.join(run)})?")
            run = []
        out.append(x[:-1] + "*" if optional and x[0] == "(" else x)
    return "".join(out)


def align(a: str, b: str) -> str:
    """The wrapper that covers both: what only one has becomes optional."""
    x, y = _items(a), _items(b)
    name = lambda t: "{" if t[0] == "{" else t
    out = []
    for op, i, j, k, m in SequenceMatcher(None, [name(t) for t, _ in x], [name(t) for t, _ in y], autojunk=False).get_opcodes():
        if op == "equal":
            for (t, p), (u, q) in zip(x[i:j], y[k:m], strict=True):
                out += [(t, True), (u, True)] if t[0] == "{" and t != u else [(t, p or q)]
        else:
            out += [(t, True) for t, _ in x[i:j]] + [(t, True) for t, _ in y[k:m]]
    return _written(_grouped_runs(out))


@remembered(1 << 12)
def places(line: str, wrapper: str) -> list[int] | None:
    """The wrapper's item for each item of a folded stream: the first ones with which all of the wrapper matches; None if it does not."""
    have, items = [x for x, _ in _items(line)], _items(wrapper)
    n, m = len(have), len(items)
    loops = [units(x) if x[0] == "{" else None for x, _ in items]
    ok = [bytearray(m + 1) for _ in range(n + 1)]  # whether the stream from i matches the wrapper from j
    ok[n][m] = 1
    for i in range(n, -1, -1):
        row, x, after = ok[i], have[i] if i < n else None, ok[i + 1] if i < n else None
        for j in range(m - 1, -1, -1):
            item, optional = items[j]
            if loops[j] is not None:
                row[j] = row[j + 1] or bool(after and after[j] and x in loops[j])
            else:
                row[j] = (optional and row[j + 1]) or (x == item and after[j + 1])
    if not ok[0][0]:
        return None
    out, j = [], 0
    for i in range(n):
        while True:
            if loops[j] is not None:
                if have[i] in loops[j] and ok[i + 1][j]:
                    out.append(j)
                    break
            elif items[j][0] == have[i] and ok[i + 1][j + 1]:
                out.append(j)
                j += 1
                break
            j += 1
    return out


def slots(page: str | None, wrapper: str | None) -> list[tuple[str, bool, str, str | None]]:
    """Text blocks as (container, inside boilerplate, text, slot); the slot is the wrapper's item, in groups with the tag before the text."""
    found, tokens = blocks(page)
    line, spans = fold_spans(tokens)
    at = places(line, wrapper) if wrapper is not None and found else None
    if at is None:
        return [(c, bad, t, None) for c, bad, t, _ in found]
    loops = [x[0] == "{" for x, _ in _items(wrapper)]
    out, k = [], 0
    for c, bad, t, place in found:
        while spans[k][1] <= place:
            k += 1
        single = spans[k][1] - spans[k][0] == 1 and not loops[at[k]]
        out.append((c, bad, t, str(at[k]) if single else f"{at[k]}{tokens[place - 1]}"))
    return out


def _in_main(holder: str) -> bool:
    return holder.split(">")[0].split(".")[0] in MAIN


def article(found: list[tuple[str, bool, str, str | None]]) -> list[tuple[str, bool, str, str | None]]:
    """The blocks outside boilerplate; of a page whose article or main elements have any, those of them."""
    own = [x for x in found if not x[1]]
    return [x for x in own if _in_main(x[0])] or own


def _merged(lines: DataFrame, salts: int, fan: int) -> DataFrame:
    """One wrapper for each host, from its distinct streams, in rounds that merge groups of about ``fan``."""

    def merge(key, frame):
        import pandas as pd

        own = sorted(frame["wrapper"].tolist())
        wrapper = own[0]
        for line in own[1:]:
            if "{" in line or places(line, wrapper) is None:  # a stream that the wrapper has already changes nothing
                wrapper = align(wrapper, line)
        return pd.DataFrame([(key[0], wrapper)], columns=["host", "wrapper"])

    most = lambda df: df.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    parts, left = salts, most(lines)
    while left > 1:
        parts = max(parts, -(-left // fan))
        salted = lines.select("host", F.pmod(F.xxhash64("wrapper"), F.lit(parts)).cast("int").alias("salt"), "wrapper")
        merged = stage(salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string").distinct(), "wrappers-merged")
        unstage(lines)
        lines, before, left = merged, left, most(merged)
        parts = 1 if left <= fan or left >= before else -(-left // fan)
    return lines


def wrappers(pages: DataFrame, *, url: str = "url", page: str = "html", salts: int = SALTS, fan: int = FAN) -> DataFrame:
    """host, wrapper, template: the slots of the wrapper whose text is constant.

    Equal pages of a host count once.  ``salts`` is the least number of groups
    in the first round; more are made if the streams of a host need them.
    """
    own = pages.select(host_of(F.col(url)).alias("host"), F.col(page).alias("t"))

    def lines(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(dict.fromkeys((host, fold(blocks(source)[1])) for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
            yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["host", "wrapper"])

    streams = stage(own.mapInArrow(lines, "host string, wrapper string").distinct(), "streams")
    merged = _merged(streams, salts, fan)

    def fills(batches):
        import pyarrow as pa
        import xxhash

        digest = lambda t: xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
        for batch in batches:
            rows = []
            for host, source, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts: dict[tuple[str, str], list[str]] = {}
                for holder, _, text, slot in article(slots(source, wrapper)):
                    if slot is not None:
                        texts.setdefault((holder, slot), []).append(text)
                name = digest(source or "")
                rows += [(host, *place, digest("\n".join(t)), name) for place, t in texts.items()]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["host", "holder", "slot", "fill", "page"])

    filled = own.join(merged, "host").select("host", "t", "wrapper").mapInArrow(fills, "host string, holder string, slot string, fill long, page long").distinct()
    counted = filled.groupBy("host", "holder", "slot", "fill").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "holder", "slot").agg(F.max("n").alias("same"), F.sum("n").alias("all"))
    fixed = (F.col("all") >= CONSTANT_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("all"))
    # beside varying text a line that many pages share may be the article's own
    quiet = counted.groupBy("host", "holder").agg(F.bool_and(fixed).alias("quiet"), F.collect_list(F.when(fixed, F.col("slot"))).alias("slots"))
    constant = quiet.where("quiet or holder = 'body'").groupBy("host").agg(F.flatten(F.collect_list("slots")).alias("template"))
    return merged.join(constant, "host", "left").select("host", "wrapper", F.coalesce("template", F.array().cast("array<string>")).alias("template"))


def main_text(page: str | None, wrapper: str | None, template: list[str] | None) -> str:
    """The page's texts in article slots; those in constant slots stay only if it has no others."""
    own = article(slots(page, wrapper))
    constant = set(template or ())
    return "\n".join([t for _, _, t, slot in own if slot not in constant] or [t for _, _, t, _ in own])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", salts: int = SALTS) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null and empty pages give an empty text; pages without host share one
    wrapper.  Repeated rows repeat their result; an empty table gives an empty
    one.  Other columns are ignored.  Elements that a page leaves open end as
    HTML has it, or before the next part of the page, so no text is lost to
    them.  A host needs CONSTANT_PAGES different pages before a line without
    marks can count as its template's.
    """
    known = stage(wrappers(pages, url=url, page=page, salts=salts), "wrappers")
    kind = pages.schema[page_id].dataType.simpleString()
    own = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(page).alias("t"), host_of(F.col(url)).alias("host"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(*x) for x in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    out = own.join(known, "host", "left").select("id", "url", "t", "wrapper", "template").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", page_id)
