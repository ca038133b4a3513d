import itertools
import random

import pytest

from segquery.llm import wrapper as W


def text_of(source):
    root = W.parse(source)
    main, never = W.marked(W.finish(root))
    found = W.page_blocks(root, main, never)
    return "\n".join(W.content([(b.text, 0, 0, [], b.main, b.head) for b in found], None, set()))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        ("a<b", "a<b"),
        ("<p>one<p>two&amp;three &eacute;&#x41;&nbsp;x", "one\ntwo&three éA x"),
        ("<html><head><title>T</title><style>x{}</style><script>var a='</p>';</script></head><body><nav>N</nav><article><h1>H</h1><p>a  b\n c</p></article><footer>F", "H\na b c"),
        ("<body><header><h1>Site</h1></header><div class='has-sidebar'><article><header><h1>T</h1></header><p>x<br>y<div class=comments>no</div></article></div><aside>q</aside><form>f</form></body>", "T\nx y"),
        ("<div id=cookie-notice>n</div><div><p>hello <i>w</i>orld</p><ul><li>a<li>b</ul></div><!-- c -->", "hello world\na\nb"),
        ("<main><p>m</p><div role=complementary>no</div></main><p>out", "m"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p title='a > b'>x</p><p class=\"un>y</p>", "x\ny"),
        ("<article>" + "<b>" * 3000 + "deep", "deep"),
    ],
)
def test_texts(source, text):
    assert text_of(source) == text


def brute_stm(a, b):
    if a.key != b.key:
        return 0
    xs, ys = a.elements(), b.elements()
    best = 0
    for m in range(min(len(xs), len(ys)) + 1):
        for p in itertools.combinations(range(len(xs)), m):
            for q in itertools.combinations(range(len(ys)), m):
                s = [brute_stm(xs[i], ys[j]) for i, j in zip(p, q, strict=True)]
                best = max(best, sum(s))
    return 1 + best


def test_tree_matching_against_brute_force():
    r = random.Random(0)

    def tree(depth):
        n = W.Node(r.choice(["div", "span"]), {})
        if depth:
            n.kids = [tree(depth - 1) for _ in range(r.randrange(4))]
        return n

    for _ in range(150):
        a, b = tree(3), tree(3)
        a.key = b.key
        W.finish(a), W.finish(b)
        m = W.Matcher()
        assert m.score(a, b) == brute_stm(a, b)
        pairs = list(m.align(a, b))
        assert len(pairs) == m.score(a, b) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, html string, text string")


def test_template_is_what_stays(spark):
    """Without any telling tag, what is equal on all pages of a host goes and what varies stays."""
    html = "<body><div><p>Welcome to our place</p></div><div><p>{0} first</p><p>{0} second</p></div><div><p>All rights</p></div></body>"
    rows = [(k, f"http://h.example/{k}", html.format(f"story {k}")) for k in range(8)] + [(100 + k, f"http://small.example/{k}", html.format(f"tale {k}")) for k in range(3)]
    got = {r.page_id: r.text for r in W.main_texts(pages(spark, rows)).collect()}
    assert all(got[k] == f"story {k} first\nstory {k} second" for k in range(8))
    assert got[100] == "Welcome to our place\ntale 0 first\ntale 0 second\nAll rights"


def test_every_layout_has_a_template(spark):
    """Two layouts, pages without html and without an id: boilerplate goes from all pages."""
    one = "<body><div><p>Welcome to our place</p></div><div><p>{0} first</p><p>{0} second</p></div></body>"
    two = "<body><section><p>Read this next</p></section><section><p>{0} first</p><p>{0} second</p></section><ul><li>Legal notice</li></ul></body>"
    rows = [(k if k % 5 else None, f"http://h.example/{k}", (one if k % 2 else two).format(f"story {k}")) for k in range(24)]
    rows += [(100 + k, f"http://h.example/e{k}", "" if k % 2 else None) for k in range(40)]
    got = [r.text for r in W.main_texts(pages(spark, rows)).collect()]
    assert sorted(got) == sorted([f"story {k} first\nstory {k} second" for k in range(24)] + [""] * 40)


def test_long_lists_are_matched_exactly(monkeypatch):
    r = random.Random(5)

    def page(n):
        top = W.Node("div", {})
        for _ in range(n):
            x = W.Node(r.choice(["p", "ul"]), {})
            x.kids = [W.Node(r.choice(["b", "i"]), {}) for _ in range(r.randrange(3))]
            top.kids.append(x)
        W.finish(top)
        return top

    for _ in range(30):
        a, b = page(r.randrange(20, 60)), page(r.randrange(20, 60))
        want = W.Matcher().score(a, b)
        monkeypatch.setattr(W, "MAX_CELLS", 10)
        assert W.Matcher().score(a, b) == len(list(W.Matcher().align(a, b))) == want
        monkeypatch.undo()


def test_constant_paragraphs_of_the_article_stay(spark):
    """What is constant between varying paragraphs is text; a branch that is constant as a whole is template."""
    html = "<body><div class=x><h1>Tale {0}</h1><p>It was {0} then.</p><div><p>Read more here</p></div><p>Reporting by staff.</p></div><div>Place {0}</div></body>"
    rows = [(k, f"http://h.example/{k}", html.format(f"number {k}")) for k in range(8)]
    rows += [(100 + k, f"http://a.example/{k}", html.replace("div class=x", "article").replace("staff.</p></div>", "staff.</p></article>").format(f"number {k}")) for k in range(8)]
    got = {r.page_id: r.text for r in W.main_texts(pages(spark, rows)).collect()}
    assert all(got[k + add] == f"Tale number {k}\nIt was number {k} then.\nReporting by staff." for k in range(8) for add in (0, 100))


def test_copies_are_no_template(spark):
    html = "<article><h1>Same</h1><p>Same text</p></article>"
    rows = [(k, "http://h.example/a", html) for k in range(9)]
    assert {r.text for r in W.main_texts(pages(spark, rows)).collect()} == {"Same\nSame text"}


def test_odd_pages(spark):
    rows = [(0, None, "<p>x"), (1, "no url", None), (None, "http://a.example/", ""), (2, "http://u@A.example:80/x", "<p>y</p>" + "<p>z</p>" * 3000), (2, "http://a.example", "<p>y")]
    got = W.main_texts(pages(spark, rows)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id is None or r.page_id == 1} == {""}
    assert W.main_texts(pages(spark, rows).limit(0)).count() == 0


def test_corpus_pages(spark, sf):
    import html
    import re

    src = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in W.main_texts(src).collect()}
    for r in src.collect():
        a = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", a.replace("<br>", " "))]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_wrapper_alone(spark):
    """Without any telling tag, class or id, hosts with enough pages still give the article."""
    import html
    import re

    def blank(x):
        x = re.sub(r"<(/?)(?:article|nav|footer|aside|header|main|form)\b", r"<\1div", x or "")
        return re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", "", x)

    src = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in W.main_texts(pages(spark, [(r.page_id, r.url, blank(r.html)) for r in src])).collect()}
    hosts = [r.url.split("/")[2] for r in src]
    same = []
    for r, host in zip(src, hosts, strict=True):
        if hosts.count(host) < 12:
            continue
        a = r.html[r.html.find("<article>") + 9 :].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", a.replace("<br>", " "))]
        same.append(got[r.page_id] == "\n".join(x for x in parts if x))
    assert len(same) >= 20 and sum(same) >= 0.95 * len(same)


def test_deep_markup(spark):
    """Thousands of nested levels on every page of a host are matched, not an error."""
    html = "<body>" + "<div>" * 5000 + "<p>{0} first</p><p>{0} second</p>" + "</div>" * 5000 + "<ul><li>Legal notice</li></ul></body>"
    rows = [(k, f"http://h.example/{k}", html.format(f"story {k}") + "<i>x</i>" * k) for k in range(8)]
    got = {r.page_id: r.text for r in W.main_texts(pages(spark, rows)).collect()}
    assert all(got[k].startswith(f"story {k} first\nstory {k} second") and "Legal" not in got[k] for k in range(8))


def test_deep_scores_equal_recursive_ones(monkeypatch):
    r = random.Random(7)

    def tree(depth):
        n = W.Node(r.choice(["div", "span"]), {})
        n.kids = [tree(depth - 1) for _ in range(r.randrange(3))] if depth else []
        return n

    for _ in range(60):
        a, b = tree(7), tree(7)
        a.key = b.key
        W.finish(a), W.finish(b)
        want = W.Matcher().score(a, b)
        monkeypatch.setattr(W.Matcher, "LEVELS", 1)
        assert W.Matcher().score(a, b) == len(list(W.Matcher().align(a, b))) == want
        monkeypatch.undo()


def test_the_wrapper_decides_before_tags(spark):
    """A teaser that calls itself an article does not replace the text that varies."""
    html = "<body><div class=body><h1>Tale {0}</h1><p>It was {0} then, and it went on for a while.</p><p>Then {0} came to an end at last.</p></div><div><article><p>See {0}</p></article></div></body>"
    rows = [(k, f"http://h.example/{k}", html.format(f"number {k}")) for k in range(12)]
    got = {r.page_id: r.text for r in W.main_texts(pages(spark, rows)).collect()}
    assert all(got[k] == f"Tale number {k}\nIt was number {k} then, and it went on for a while.\nThen number {k} came to an end at last." for k in range(12))


@pytest.mark.parametrize(("name", "kept"), [("share-price", True), ("ad-hoc", True), ("header-note", True), ("promotional", True), ("comment-list", False), ("ads", False), ("x related-links", False), ("site-footer", False)])
def test_names_that_hold_a_cue(name, kept):
    assert text_of(f"<article><p>a</p><div class='{name}'>b</div></article>") == ("a\nb" if kept else "a")


def test_attributes_without_a_value():
    assert text_of("<div hidden>a</div><div hidden class=x>b</div><div class=y hidden>c</div><p data-x title='hidden'>d") == "d"


@pytest.mark.parametrize("source", ["<a ", '<a "', '<a ">', '</a "', "<!", "<!--", "</", "< "])
def test_broken_markup_costs_in_proportion(source):
    """A megabyte of tags that never end."""
    import time

    t = time.process_time()
    W.parse(source * (1_000_000 // len(source)))
    assert time.process_time() - t < 20
