from __future__ import annotations

import html
import random
import re

import pytest

from grievlake.llm import wrapper_induction as w


def text_of(page):
    return w.extract(page, None)


def texts_by_query(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in w.main_text(pages, w.induce(pages), ["page_id"]).collect()}


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b</p>c", "a b\n\nc"),
    ("<nav>menu</nav><article><h1>T</h1><p>x\n\n y</p></article><footer>f</footer>", "T\n\nx y"),
    ("<div class='side-bar sidebar'>s</div><div id=content>c</div>", "c"),
    ("<article><p>a</p><div class=\"ad\">buy</div><form>f<input></form><p>b<!-- no --></p></article><article class=comment>hi</article>", "a\n\nb"),
    ("<script>var t='</p>';</script><style>p{}</style><p>ok</p><script>never closed", "ok"),
    ("<header>site</header><main><header><h1>Title</h1></header>body</main>", "Title\n\nbody"),
    ("<ul><li>a<li>b</ul>", "a\n\nb"), ("<p>1 < 2 & 3 &lt; 4 &#233; &eacute;</p>", "1 < 2 & 3 < 4 é é"), ("<b>never <i>closed <p>x", "never closed\n\nx"),
    ("</p></div>stray", "stray"), ("<p>no <a href='u'>link</a> lost</p>", "no link lost"), ("<div role=banner>x</div><p>y", "y"),
    ("<a href=\"unclosed><p>x</p>", "<a href=\"unclosed>\n\nx"), ("<![CDATA[x]]><!DOCTYPE html><?php ?><p>y</p>", "y"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<article></article>", ""),
])
def test_blocks(page, text):
    assert text_of(page) == text


def brute_match(a, b):
    """Simple tree matching by plain recursion over all ways to pair children in order."""
    if a[0] != b[0]:
        return 0

    def pairs(x, y):
        if not x or not y:
            return 0
        return max(pairs(x[1:], y), pairs(x, y[1:]), brute_match(x[0], y[0]) + pairs(x[1:], y[1:]))

    return 1 + pairs(a[1], b[1])


def flat(nested):
    tree = w.Tree([], [], [])

    def add(node, parent):
        at = tree.add(node[0], parent)
        for kid in node[1]:
            add(kid, at)

    add(nested, -1)
    return tree


def drawn_tree(draw, depth, most=4):
    return [draw.choice("ab"), [drawn_tree(draw, depth - 1, most) for _ in range(draw.randrange(most))] if depth else []]


def test_matching_against_plain_recursion():
    draw = random.Random(4)
    for _ in range(150):
        a, b = drawn_tree(draw, 3), drawn_tree(draw, 3)
        x, y = flat(a), flat(b)
        found = w.match_trees(x, y)
        assert len(found) == brute_match(a, b)
        assert len({i for i, _ in found}) == len({j for _, j in found}) == len(found)
        for i, j in found:
            assert x.labels[i] == y.labels[j]
            if i:
                assert (x.parents[i], y.parents[j]) in found
        assert w.tree_of(x.skeleton()).skeleton() == x.skeleton()


def test_long_lists_match_in_order(monkeypatch):
    assert w.in_order(list("abcab"), list("bacb")) in ([(0, 1), (2, 2), (4, 3)], [(1, 0), (2, 2), (4, 3)])
    assert w.in_order([], ["a"]) == [] and w.in_order(list("aaa"), list("aa")) == [(0, 0), (1, 1)]
    monkeypatch.setattr(w, "CELLS", 6)
    x, y = flat(["r", [[c, []] for c in "abcabc"]]), flat(["r", [[c, []] for c in "abcxabc"]])
    assert [(x.labels[i], j) for i, j in w.match_trees(x, y)[1:]] == [("a", 1), ("b", 2), ("c", 3), ("a", 5), ("b", 6), ("c", 7)]


def test_a_grown_template_holds_every_page_of_its_sample():
    draw = random.Random(2)
    for _ in range(60):
        sample = [flat(["html", drawn_tree(draw, 3)[1]]) for _ in range(4)]
        grown = w.tree_of(w.template_of([t.skeleton() for t in sample]))
        first = max(sample, key=lambda t: len(t.labels))
        assert len(grown.labels) >= len(first.labels)
    x = flat(["html", [["nav", []], ["p", []], ["footer", []]]])
    w.grow(x, flat(["html", [["nav", []], ["div", [["b", []]]], ["p", []], ["footer", []], ["i", []]]]))
    assert x.skeleton() == "0 html\n1 nav\n1 div\n2 b\n1 p\n1 footer\n1 i"


def site(k, body):
    return f"<div class=top>Site title</div><div><a href=/>Home</a></div><h1>Story {k}</h1><p>{body}</p><p>end {k}</p><div>All rights kept</div>"


def test_constant_nodes_go_and_slots_stay(spark):
    rows = [(k, "http://a.org/x", site(k, f"body {k} " + "word " * k)) for k in range(12)]
    rows += [(50 + k, "http://copies.org/x", site(7, "the same story")) for k in range(9)]
    rows += [(90, "http://single.org", site(1, "alone")), (91, None, site(2, "no host")), (92, "http://a.org", None), (93, "http://a.org", ""), (92, "http://a.org", None)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, node int")
    wrappers = w.induce(pages)
    got = {r.page_id: r.text for r in w.main_text(pages, wrappers, ["page_id", "url"]).collect()}
    for k in range(12):
        assert got[k] == f"Story {k}\n\n" + f"body {k} {'word ' * k}".strip() + f"\n\nend {k}"
    whole = "Site title\n\nHome\n\nStory 7\n\nthe same story\n\nend 7\n\nAll rights kept"
    assert all(got[50 + k] == whole for k in range(9)), "copies of one page say nothing about the template"
    assert got[92] == got[93] == "" and "alone" in got[90] and "no host" in got[91]
    assert len(w.main_text(pages, wrappers, ["page_id"]).collect()) == len(rows)


def test_every_layout_of_a_host_has_its_template(spark):
    first = lambda k: f"<div>Menu A</div><h1>Story {k}</h1><p>body {k}</p><div>Rights A</div>"
    second = lambda k: f"<section><b>Menu B</b><h2>Talk {k}</h2><p>said {k}</p><p>more</p></section><span>Rights B</span>"
    odd = lambda k: f"<div>Menu A</div><h{k % 6 + 1}>Odd {k}</h{k % 6 + 1}><pre>{k}</pre><div>Rights A</div>"
    rows = [(k, None, first(k)) for k in range(5)] + [(10 + k, None, second(k)) for k in range(5)]
    rows += [(20 + k, None, odd(k)) for k in range(2)] + [(30, None, "<p>Not found"), (31, None, "<p>Not found")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.main_text(pages, w.induce(pages), ["page_id"]).collect()}
    for k in range(5):
        assert got[k] == f"Story {k}\n\nbody {k}"
        assert got[10 + k] == f"Talk {k}\n\nsaid {k}\n\nmore"
    assert all(got[20 + k] == f"Odd {k}\n\n{k}" for k in range(2)), "layouts of one page, too"
    assert got[30] == got[31] == "Not found"


def test_alignment_decides_outside_and_inside_articles(spark):
    make = {
        "body.org": lambda k: f"<nav>go {k}</nav><div class=top>Site</div><article><p>teaser {k}</p></article><div id=story>The body of {k}</div>",
        "empty.org": lambda k: f"<div class=top>Site</div><article></article><div id=story>The body of {k}</div><aside>see {k}</aside>",
        "class.org": lambda k: f"<article class='post has-comments share'><h1>Title {k}</h1><p>text {k}</p><div>Thanks</div></article>",
        "two.org": lambda k: f"<article><p>text {k}</p></article><article class=comment>reply {k}</article>",
        "only.org": lambda k: f"<div>Site</div><article class=promotion><p>text {k}</p></article>",
    }
    rows = [(100 * n + k, f"http://{host}/", page(k)) for n, (host, page) in enumerate(make.items()) for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.main_text(pages, w.induce(pages), ["page_id"]).collect()}
    for k in range(5):
        assert got[k] == f"teaser {k}\n\nThe body of {k}"
        assert got[100 + k] == f"The body of {k}"
        assert got[200 + k] == f"Title {k}\n\ntext {k}\n\nThanks", "what articles share is content"
        assert got[300 + k] == got[400 + k] == f"text {k}"
    assert text_of("<article></article><div>body</div>") == "body"


@pytest.mark.parametrize("name", [
    "side-effects", "ad-hoc note", "related-work", "share-price", "price-notice", "social-science", "comment-free", "post share",
])
def test_classes_count_as_whole_words(spark, name):
    rows = [(k, "http://a.org", f"<div class=top>Site</div><article><h1>T {k}</h1><div class='{name}'>said {k}</div></article>") for k in range(10)]
    assert texts_by_query(spark, rows) == {k: f"T {k}\n\nsaid {k}" for k in range(10)}


@pytest.mark.parametrize("wrap", [
    "<div class='content has-sidebar'>{}</div>", "<div class=sidebar><p>see also {k}</p>{}</div>", "<form id=aspnetForm>{}<input></form>",
    "<aside class='widget'>{}</aside>", "<section class=comments><div class=ad>buy {k}</div>{}</section>",
])
def test_names_never_remove_what_an_article_stands_in(spark, wrap):
    article = "<article><p>text {k}</p></article>"
    rows = [(k, "http://a.org", wrap.replace("{}", article).replace("{k}", str(k))) for k in range(10)]
    assert texts_by_query(spark, rows) == {k: f"text {k}" for k in range(10)}


def test_what_articles_share_stays(spark):
    quote = "<blockquote>It was said before</blockquote>"
    make = lambda k: (
        f"<div>Site title</div><main><h1>Daily report</h1><h2>Introduction</h2><p>first {k}</p>{quote}<h2>Results</h2><p>then {k}</p></main><div>Rights</div>"
    )
    want = lambda k: f"Daily report\n\nIntroduction\n\nfirst {k}\n\nIt was said before\n\nResults\n\nthen {k}"
    assert texts_by_query(spark, [(k, "http://a.org", make(k)) for k in range(10)]) == {k: want(k) for k in range(10)}


def test_long_boilerplate_does_not_make_pages_copies(spark):
    terms, about = "These are our terms. " * 20, "About us and what we do. " * 12
    rows = [(k, "http://a.org", f"<div><p>{terms}</p></div><section><p>body {k}</p></section><div><p>{about}</p></div>") for k in range(10)]
    assert texts_by_query(spark, rows) == {k: f"body {k}" for k in range(10)}


def test_aligned_siblings_are_told_apart(spark):
    """Plain elements of one label, some of them missing on some pages: only their order tells which is which."""
    def page(k):
        notice = "<div>We use cookies</div>" if k % 3 else ""
        extra = f"<div>update {k}</div>" if k % 4 == 0 else ""
        return f"<div>Menu</div>{notice}<div><h1>Story {k}</h1><div>body {k}</div>{extra}</div><div>All rights kept</div>"

    want = {k: f"Story {k}\n\nbody {k}" + (f"\n\nupdate {k}" if k % 4 == 0 else "") for k in range(24)}
    assert texts_by_query(spark, [(k, "http://a.org", page(k)) for k in range(24)]) == want


def drawn_site(draw):
    """A site of known slots: a function from a page number to its html and main text."""
    tags = ["div", "section", "header.top", "ul.list", "table.t"]

    def open_close(tag):
        name, _, cls = tag.partition(".")
        return f"<{name}{' class=' + cls if cls else ''}>", f"</{name}>"

    kinds = [(draw.choice(["constant", "slot", "slot", "optional"]), draw.choice(tags[:2]), n) for n in range(draw.randint(3, 7))]
    kinds = [("constant", "div.head", 90), *kinds, ("slot", "section.story", 91), ("constant", "div.foot", 92)]

    def page(k):
        html, texts = "", []
        for kind, tag, n in kinds:
            start, end = open_close(tag if kind != "constant" else tag.split(".")[0] + f".c{'abcdefghij'[n % 10]}")
            if kind == "constant":
                html += f"{start}<p>Standing words {n}</p>{end}"
            elif kind == "slot":
                html += f"{start}<h2>Part {n} of {k}</h2><p>words {k * 7 + n}</p><p>more {k}</p>{end}"
                texts += [f"Part {n} of {k}", f"words {k * 7 + n}", f"more {k}"]
            elif (k + n) % 3:
                html += f"<div class=ad>offer {k} {n}</div>"
        return html, "\n\n".join(texts)

    return page


def test_known_slots_of_drawn_sites(spark):
    draw, rows, want = random.Random(12), [], {}
    for host in range(12):
        page = drawn_site(draw)
        for k in range(12):
            html_, text = page(k)
            rows.append((host * 100 + k, f"https://h{host}.org/{k}", html_))
            want[host * 100 + k] = text
    assert texts_by_query(spark, rows) == want


def test_a_kept_column_may_be_named_like_the_result(spark):
    pages = spark.createDataFrame([(1, None, "<p>a", "x", 2)], "page_id long, url string, html string, text string, host int")
    got = w.main_text(pages, w.induce(pages), ["page_id", "text", "host"])
    assert got.columns == ["page_id", "host", "text"] and [tuple(r) for r in got.collect()] == [(1, 2, "a")]


def test_empty_table_and_long_page(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.main_text(none, w.induce(none), ["page_id"]).count() == 0
    assert len(text_of("<div>" * 300 + "x" * 2_000_000)) == 2_000_000


@pytest.mark.parametrize("tag", ["div", "b", "article"])
def test_deeply_nested_pages_go_through_the_query(spark, tag):
    deep = lambda k: "<h1>Site</h1>" + f"<{tag}>" * 5000 + f"story {k} <p>more {k}"
    pages = spark.createDataFrame([(k, "http://a.org", deep(k)) for k in range(4)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in w.main_text(pages, w.induce(pages), ["page_id"]).collect()}
    assert got == {k: f"story {k}\n\nmore {k}" for k in range(4)}


def test_query_on_given_pages(spark):
    from grievlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = QUERIES["op3_wrapper_induction"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)
