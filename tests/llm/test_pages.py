"""Page text of random templates: constant parts go, varying parts stay, whatever the containers are called."""

import random

import pytest

from quantloom.llm import pagetext

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
say = lambda n: " ".join(rng.choices(WORDS, k=n))


def template(k):
    """A function from a page number to (html, article text)."""
    holder = rng.choice(["article", "main", "div"])
    attrs = rng.choice(["", " class='entry'", " id='form-and-function'", " class='comment-on-law'"]) if holder != "div" else rng.choice([" class='entry-header story'", " id='c7'", " class='text2 advert-free'"])
    head = rng.choice([f"<header><b>{say(3)}</b></header>", f"<div class='site-header'>{say(4)}</div>", f"<div class='z{k}'>{say(4)}</div>"])
    menu = rng.choice(["<nav><ul>{}</ul></nav>", "<div class='main-menu'>{}</div>"])
    foot = rng.choice([f"<footer>{say(5)}</footer>", f"<div class='f{k}'><span>{say(6)}</span></div>"])
    side = rng.choice(["", f"<aside>{say(9)}</aside>", f"<div class='s{k}'><h4>{say(2)}</h4></div>"])

    def page(i):
        title = say(5)
        out, blocks = [f"<div class='entry-header'><h1>{title}</h1></div>" if k % 2 else f"<h1>{title}</h1>"], [title]
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["p", "p", "ul", "section", "blockquote"])
            if kind == "ul":
                items = [say(rng.randint(1, 6)) for _ in range(rng.randint(1, 5))]
                out.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
                blocks += items
            elif kind == "section":
                a, b = say(3), say(12)
                out.append(f"<section class='form-and-function'><h2>{a}</h2><p>{b}</p></section>")
                blocks += [a, b]
            else:
                x, y = say(rng.randint(1, 30)), say(2)
                out.append(f"<{kind}>{x}  <em>{y}</em>\n&amp;</{kind}>")
                blocks.append(f"{x} {y} &")
        ad = f"<div class='ad-box'>{say(6)}</div>" if rng.random() < 0.5 else ""
        links = "".join(f"<li><a href='/{j}'>{w}</a></li>" for j, w in enumerate(rng.choices(WORDS, k=rng.randint(1, 4))))
        html = f"<html><head><title>{title}</title></head><body>{head}{menu.format(links)}{ad}<{holder}{attrs}>{''.join(out)}</{holder}>{side}<form><p>{say(2)}</p></form>{foot}<script>x('<p>')</script></body></html>"
        return html, "\n".join(blocks)

    return page


@pytest.mark.parametrize("salts", [1, 5])
def test_random_templates(spark, salts):
    rows, want = [], {}
    for k in range(16):
        page = template(k)
        for i in range(14):
            html, text = page(i)
            rows.append((k * 100 + i, f"https://t{k}.example.org/{i}", html))
            want[k * 100 + i] = text
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in pagetext.extract(table, salts=salts).collect()}
    assert [(i, want[i][:80], got[i][:80]) for i in want if got[i] != want[i]] == []


@pytest.mark.parametrize(("attrs", "within", "is_marked"), [
    ('class="ad"', False, True), ('class="ad-box left"', False, True), ("id=site-header", False, True), ('class="cookie-notice"', True, True), ('class="entry-header"', False, False),
    ('class="form-and-function"', False, False), ('class="header"', True, False), ('class="header"', False, True), ('class="commentary"', False, False), ('class="comment-list"', True, True), ("", False, False),
])
def test_marks(attrs, within, is_marked):
    assert pagetext.marked(attrs, within) is is_marked


OPEN = {
    "head": ("<html><head><title>T</title><meta charset='x'><body><p>One</p><p>Two</p>", "One\nTwo"),
    "head before text": ("<head><title>T</title>One<p>Two</p>", "One\nTwo"),
    "title": ("<title>T<p>One</p>", "One"),
    "select": ("<p>One</p><select><option>a<option>b<p>Two</p>", "One\nTwo"),
    "select in a line": ("<p>One <select><option>a</select> two</p>", "One two"),
    "nav": ("<body><nav><ul><li><a>x</a><li>y</ul><h1>One</h1><p>Two</p></body>", "One\nTwo"),
    "aside": ("<body><aside><p>x</p><h1>One</h1><p>Two</p></body>", "One\nTwo"),
    "paragraphs and items": ("<div><p>One<p>Two<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl></div>", "One\nTwo\na\nb\nc\nd"),
    "svg": ("<p>One</p><svg><path d='x'/><p>Two</p>", "One\nTwo"),
    "video": ("<p>One</p><video src='x'><p>Two</p>", "One\nTwo"),
    "script in a line": ("<p>One<script>x('<p>')</script> two <!-- c -->three</p>", "One two three"),
    "reader comments": ("<div><p>One</p></div><div class='user-comments'><p>x</p></div><div id='reader-comments'>y</div><section class='post-comments'>z</section>", "One"),
    "titles about comments": ("<div class='comment-on-law'><p>One</p></div><div class='post-header'><h1>Two</h1></div>", "One\nTwo"),
}


@pytest.mark.parametrize("name", OPEN)
def test_open_elements_lose_no_text(name):
    page, want = OPEN[name]
    assert pagetext.main_text(page, None, None) == want


def test_lines_that_pages_share_stay_in_the_article(spark):
    by = "<p class='by'>By Jane Doe</p>"
    pages = [(i, "http://a.example/", f"<div class='menu2'>Site of things</div><article><h1>Same headline</h1>{by}<p>Story {i}</p></article><div class='z'>Bye</div>") for i in range(10)]
    pages += [(100 + i, "http://b.example/", f"<div class='q1'>Site of things</div><div class='story'><h1>Title {i}</h1>{by}<p>Story {i}</p></div><div class='q2'>Bye</div>") for i in range(10)]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Same headline\nBy Jane Doe\nStory {i}" for i in range(10))
    assert all(got[100 + i] == f"Title {i}\nBy Jane Doe\nStory {i}" for i in range(10))


def mixed(i, n=200):
    draw = random.Random(i)
    kinds = [lambda w: f"<p>{w}</p>", lambda w: f"<h2>{w}</h2>", lambda w: f"<ul><li>{w}</li><li>{w}</li></ul>", lambda w: f"<blockquote>{w}</blockquote>", lambda w: f"<table><tr><td>{w}</td></tr></table>", lambda w: f"<section class='s{draw.randint(0, 3)}'><p>{w}</p></section>"]
    return f"<div class='top1'>Site of things</div><div class='story'>{''.join(draw.choice(kinds)(f'w{draw.random()}') for _ in range(n))}</div><div class='end1'>Bye</div>"


def test_wrapper_grows_with_the_template_and_not_with_the_pages(spark):
    import time

    lines = sorted({pagetext.fold(pagetext.blocks(mixed(i))[1]) for i in range(60)})
    wrapper, sizes = lines[0], []
    start = time.perf_counter()
    for line in lines[1:]:
        wrapper = pagetext.align(wrapper, line) if pagetext.places(line, wrapper) is None else wrapper
        sizes.append(len(pagetext._items(wrapper)))
    assert sizes[-1] <= max(sizes[:10]) and sizes[-1] < 400 and len(wrapper) < 20_000
    assert (time.perf_counter() - start) / 60 < 0.05
    assert all(pagetext.places(line, wrapper) is not None for line in lines)
    start = time.perf_counter()
    for line in lines:
        pagetext.places(line + "", wrapper + "")
    assert (time.perf_counter() - start) / 60 < 0.02
    rows = [(i, "http://m.example/", mixed(i, 40)) for i in range(40)]
    got = {r.page_id: r.text for r in pagetext.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), salts=3).collect()}
    for i, _, page in rows:
        assert got[i] == "\n".join(t for c, _, t, _ in pagetext.blocks(page)[0] if c not in ("div.top1", "div.end1"))


def test_hostile_pages_take_linear_time():
    import time

    for page in ["<svg>" * 200_000, "<title>" * 100_000, "<div class='a'>" * 50_000, "<select><option>" * 60_000, "<" * 500_000, "<p>x" * 100_000, "<nav><p>" * 50_000, "<!-- x" * 100_000]:
        start = time.perf_counter()
        pagetext.blocks(page)
        assert time.perf_counter() - start < 4, page[:20]


@pytest.mark.parametrize("name", ["fold", "align"])
def test_the_wrapper_decides(spark, monkeypatch, name):
    """Without folding or aligning, constant parts can't be told from the article."""
    body = lambda i: f"<div class='a'>Site of things</div><div class='b'><p>Story {i}</p>{'<p>more</p>' * (i % 3)}</div>{f"<section><h2>part {i}</h2></section>" if i % 4 == 0 else ""}<div class='c'>Bye</div>"
    table = spark.createDataFrame([(i, "http://w.example.org/", body(i)) for i in range(12)], "page_id long, url string, html string").coalesce(1)
    good = {r.page_id: r.text for r in pagetext.extract(table).collect()}
    assert all(good[i] == "\n".join([f"Story {i}"] + ["more"] * (i % 3) + [f"part {i}"] * (i % 4 == 0)) for i in range(12))
    monkeypatch.setattr(pagetext, name, lambda *given: "")
    bad = {r.page_id: r.text for r in pagetext.extract(table).collect()}
    assert bad != good
