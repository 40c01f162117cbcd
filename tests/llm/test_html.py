import math
import random
import time

from graphloom.llm.html import extract, extract_pages, parse, select


def test_article_without_what_surrounds_it():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=1>Home</a></nav>
    <article><header><h1>Head&amp;line</h1></header><p>One <b>two
    three<br>four<p>Five</p><div class="comments"><p>Reader</p></div><aside>note</aside></article><div class=cookie-notice>x</div><footer>f</footer></body></html>"""
    assert extract(page) == "Head&line\n\nOne two three four\n\nFive"


def test_density_finds_an_unnamed_article():
    links = "".join(f"<li><a href={i}>topic {i}</a>" for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><div><h2>Title</h2><p>{'word ' * 80}</p><p>{'more ' * 60}</p></div></div><form>login <input></form></body>"
    text = extract(page)
    assert text.startswith("Title\n\nword word") and text.endswith("more") and "topic" not in text and "login" not in text


def test_odd_pages():
    assert extract(None) == extract("") == extract("<script>x") == ""
    assert extract("only text") == "only text"
    assert extract("<p>" * 30_000 + "deep") == "deep"
    assert "deep" in extract("<div>" * 5_000 + "deep")


def test_furniture_that_wraps_the_page():
    assert extract("<body><form><h1>Title</h1><p>All the text.</p><input></form></body>") == "Title\n\nAll the text."
    assert extract("<body><form>login <input></form></body>") == ""
    assert extract("<main><nav><ul><li><a href=1>Home</a></ul><p>Never closed.</p></main>") == "Never closed."
    assert extract("<div class='page with-sidebar'><article><p>Text of it.</p></article><div class=sidebar>aside</div></div>") == "Text of it."


def test_names_that_can_be_a_subject():
    page = "<article><h1>A</h1><p>first</p><section class={0} id={0}><h2>On it</h2><p>others did</p></section><div class=ad>buy</div><div class={0}><a href=1>x</a></div></article>"
    for name in ("related-work", "search", "share", "notice", "discussion", "side-effects"):
        assert extract(page.format(name)) == "A\n\nfirst\n\nOn it\n\nothers did"
    for name in ("sidebar", "site-footer", "user-comments", "ad-box"):
        assert extract(page.format(name)) == "A\n\nfirst"


def test_time_is_linear_in_depth():
    start = time.time()
    assert extract("<div>" * 100_000 + "deep") == "deep"
    assert extract("<b>" * 20_000 + "<p>x</p>" * 20_000).count("x") == 20_000
    assert extract("<u><div>" + "<b>" * 20_000 + "x</u>" * 20_000).count("x") == 20_000
    assert extract("<ul><li>" + "<div>" * 20_000 + "<p>x<dd>y" * 5_000).count("x") == 5_000
    assert time.time() - start < 60


def plain_choice(root):
    """The composite text density rule as its definition reads: every count is taken anew from the tree, every pair of nodes compared."""

    def kids(node):
        return [x for x in node.items if not isinstance(x, str)]

    def subtree(node):
        return [node] + [y for x in kids(node) for y in subtree(x)]

    def chars(node):
        return sum(len(" ".join(x.split())) for n in subtree(node) for x in n.items if isinstance(x, str))

    def links(node):
        tops = [n for n in subtree(node) if n.tag == "a"]
        return sum(map(chars, tops)), len(tops) - (node.tag == "a")

    body = next(n for n in subtree(root) if n.tag == "body")

    def density(node):
        c, t = chars(node), max(len(subtree(node)) - 1, 1)
        if not c:
            return 0.0
        lc, lt = links(node)
        if node.tag == "a":
            lt = t
        base = math.log(c / max(c - lc, 1) * lc + links(body)[0] / max(chars(body), 1) * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / base

    def best(node):
        return max(subtree(node), key=lambda n: sum(map(density, kids(n))))

    top = best(body)
    path = [n for n in subtree(body) if top in subtree(n)]
    threshold = min(density(n) for n in path if density(n)) if chars(body) else math.inf
    found = [best(n) for n in subtree(body) if chars(n) and density(n) >= threshold] or [top]
    outer = [n for n in found if not any(n is not m and n in subtree(m) for m in found)]
    return [n for n in subtree(body) if n in outer]


def test_choice_equals_the_rule_on_random_pages():
    dice = random.Random(7)

    def markup(depth):
        if depth == 0 or dice.random() < 0.2:
            return "w" * dice.randrange(1, 60)
        tag = dice.choice(["div", "div", "div", "span", "blockquote"])
        inner = "".join(markup(depth - 1) for _ in range(dice.randrange(1, 4)))
        return f"<{tag}>{inner}</{tag}>" if dice.random() < 0.8 else f"<a href=1>{'l' * dice.randrange(1, 30)}</a>"

    for _ in range(150):
        root = parse(f"<html><body>{''.join(markup(4) for _ in range(4))}</body></html>")
        assert [id(n) for n in select(root)] == [id(n) for n in plain_choice(root)]


def test_rows(spark):
    rows = [(1, "u", "<article><p>x y</p></article>", "clash"), (1, "u", "<article><p>x y</p></article>", "clash"), (None, None, None, None)]
    got = sorted((r.text, r.n_chars) for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    assert got == [("", 0), ("x y", 3), ("x y", 3)]
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
