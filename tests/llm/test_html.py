import re

import pytest

from quillon.llm import html_extraction as X
from quillon.llm.html_tree import parse


def match(a, b):
    """Pairs of nodes of a largest top-down, order-keeping matching of two trees of equal labels (simple tree matching)."""
    weight, tables = {}, {}

    def size(x, y):
        if x.label() != y.label():
            return 0
        key = (id(x), id(y))
        if key not in weight:
            n, m = len(x.children), len(y.children)
            t = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(1, n + 1):
                for j in range(1, m + 1):
                    t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + size(x.children[i - 1], y.children[j - 1]))
            weight[key], tables[key] = t[n][m] + 1, t
        return weight[key]

    out = []
    if size(a, b):
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            out.append((x, y))
            t, i, j = tables[id(x), id(y)], len(x.children), len(y.children)
            while i and j:
                if t[i][j] == t[i - 1][j]:
                    i -= 1
                elif t[i][j] == t[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x.children[i], y.children[j]))
    return out


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body>{extra}{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head</h1><p><b>One.<br><p>Two &amp; &lt;b&gt; &#233;&nbsp;x\n\n y</article>", "Head\n\nOne.\n\nTwo & <b> é x y"),
        ("<nav>no</nav><header>no</header><main><p>yes</p><aside>no</aside></main><footer>no</footer>", "yes"),
        ("<article><header><h1>Title</h1></header><p>yes</p><footer>no</footer></article>", "Title\n\nyes"),
        ("<div class='cookie-notice'>no</div><article>yes<form>no<input></form><div class='ad'>no</div> more</article>", "yes\n\nmore"),
        ("<article><p>yes</p><section id=comments><article class=comment><p>no</p></article></section></article>", "yes"),
        ("<div id=content><p>yes</p></div><div id=sidebar>no</div>", "yes"),
        ("<body class='has-sidebar'><div class='content-with-sidebar'><p>a long text that is all there is</p></div>", "a long text that is all there is"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><pre>x\n  y</pre></article>", "a\n\nb\n\nc\n\nd\n\nx y"),
        ("<article>a<!-- no --><span>b</span>c<script>no</script> d</article>", "abc d"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\n\ntwo"),
        ("<p>just <i>text</i>", "just text"),
        ("<div><a href=/a>Home</a> <a href=/b>News</a></div><div class=x7><p>One long line of text.</p><p>Two <a href=/c>more</a> of it.</p></div><div><a href=/d>Old</a></div>", "One long line of text.\n\nTwo more of it."),
        ("<article><p><a href=/x>all a link</a></p></article>", "all a link"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div>yes</article>", "yes"),
        ("<article>5 < 6 &unknown; </article>", "5 < 6 &unknown;"),
    ],
)
def test_main_text(body, text):
    assert X.extract(page(body), {}) == text


def test_deep_and_broken_pages():
    assert X.extract("<div>" * 5000 + "deep", {}) == "deep"
    assert X.extract("", {}) == "" and X.extract("<", {}) == "<" and X.extract("<!-- open", {}) == ""
    assert X.extract("</p></div>plain", {}) == "plain"
    assert X.extract("<article>" + "<b>x</b> " * 20_000 + "</article>", {}).count("x") == 20_000


def test_matching_is_the_largest():
    a, b = parse("<ul><li>1</li><li><b>2</b></li><p>3</p></ul>"), parse("<ul><li><b>x</b></li><p>y</p></ul>")
    assert len(match(a, b)) == 7  # root, ul, li, b, its text, p, its text
    assert match(parse("<a>1</a>").children[0], parse("<b>1</b>").children[0]) == []


def hosted(i, slot):
    return f"<html><body><div class=bar><a href=/>Home</a> of the site</div><div class=slot><p>{slot}</p><p>Second {i} text here.</p><p>Read more at our shop</p></div><div class=low>All rights kept</div></body></html>"


def test_wrapper_tells_template_from_content(spark):
    pages = [hosted(i, f"Page number {i} says something of its own.") for i in range(8)]
    wrapper = X.induce(pages)
    assert wrapper["main"].endswith("div.slot")
    assert X.extract(pages[3], wrapper) == "Page number 3 says something of its own.\n\nSecond 3 text here."
    assert X.induce(pages[:2]) == {} and X.induce(pages[:1] * 9) == {}
    rows = [(i, "http://u@Shop.example.com:80/a?b" if i < 8 else f"odd {i}", p) for i, p in enumerate([*pages, pages[0], None, ""])]
    found = {r["page_id"]: r for r in X.html_extraction(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")).collect()}
    for i in range(8):
        assert found[i]["text"] == f"Page number {i} says something of its own.\n\nSecond {i} text here."
        assert found[i]["n_chars"] == len(found[i]["text"])
    assert found[8]["text"].startswith("Page number 0") and found[8]["text"].endswith("Read more at our shop") and found[9]["text"] == found[10]["text"] == "" and found[9]["n_chars"] == 0


def test_empty_and_null_tables(spark):
    assert X.html_extraction(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert X.html_extraction(spark.createDataFrame([(None, None, None), (1, None, "<p>x"), (1, None, "<p>x")], "page_id long, url string, html string")).count() == 3


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    wanted = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = (" ".join(X.parse(re.sub(r"<(?:br|/?b)>", " ", b)).children[0].text.split()) if re.sub(r"<[^>]*>", "", b).strip() else "" for b in re.split(r"</?(?:h1|p)>", inner))
        wanted[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in X.html_extraction(pages).collect()} == wanted


def sectioned(i, line, slot="div", section="a"):
    return (f"https://one.example.com/{section}/{i}", f"<html><body><{slot} class=slot><p>Page {i} says {i * i} things of its own, at length.</p><p>{line}</p></{slot}></body></html>")


def texts_of(spark, pages):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in X.html_extraction(rows).orderBy("page_id").collect()]


def test_every_page_counts_and_sections_have_templates(spark):
    # the last section is 1 page in 20 of the host, so that a sample of ten would hold none or one of it
    pages = [sectioned(i, f"A line {i} like no other") for i in range(190)] + [sectioned(i, "More of our weather", section="weather") for i in range(190, 200)]
    found = texts_of(spark, pages)
    assert found[3].endswith("A line 3 like no other")
    assert [t for t in found if "weather" in t] == [] and all(f"Page {i} says" in t for i, t in enumerate(found))
    # layouts of a section, too
    pages = [(u, h.replace("class=slot", "class=gallery")) if i % 10 == 0 else (u, h) for i, (u, h) in enumerate(sectioned(i, "All our galleries" if i % 10 == 0 else f"A line {i}") for i in range(100))]
    assert [t for t in texts_of(spark, pages) if "galleries" in t] == []


def test_copies_of_an_article_are_no_section(spark):
    pages = [sectioned(i, f"A line {i}") for i in range(30)] + [(f"https://one.example.com/b/{i}", f"<html><body><div class=slot><p>{'The same long article. ' * 9}</p><p>Seen {i} times</p></div></body></html>") for i in range(6)]
    assert all("The same long article." in t for t in texts_of(spark, pages)[30:])


def test_large_pages_have_wrappers(spark):
    pages = [sectioned(i, "Read more at our shop</p>\n" + "".join(f"<p>Number {i * 1000 + j}</p>\n" for j in range(900)) + "<p>Thanks for reading") for i in range(6)]
    assert sum(1 for _ in parse(pages[0][1]).walk()) > 1500
    wrapper = X.induce([html for _, html in pages])
    assert wrapper["main"].endswith("div.slot")
    for text in [X.extract(pages[1][1], wrapper), *texts_of(spark, pages)]:
        assert "Number " in text and "shop" not in text and "Thanks" not in text


def test_template_lines_with_inline_markup():
    line = "Read <em>more</em> at <a href=/s>our <b>shop</b></a></p><p><span>Thanks</span></p><p><b>Note</b> number"
    pages = [sectioned(i, f"{line} {i}")[1] for i in range(8)]
    text = X.extract(pages[3], X.induce(pages))
    assert text == "Page 3 says 9 things of its own, at length.\n\nNote number 3"


def test_places_hold_all_that_tree_matching_pairs():
    """Texts that simple tree matching pairs between every page and the first, in the same words, are the template."""
    pages = [sectioned(i, f"Read <em>more</em> at our shop</p><p>Line {i}</p><p>Thanks")[1] for i in range(6)]
    first, constant = parse(pages[0]), None
    paths = {id(n): p.rsplit("/", 1)[0] for p, n in first.walk()}
    for other in pages[1:]:
        same = {id(x) for x, y in match(first, parse(other)) if x.tag == "#" and x.text.strip() and x.text == y.text}
        constant = same if constant is None else constant & same
    marks = {X._within(0, X._mark(paths[id(n)], " ".join(n.text.split()))) for _, n in first.walk() if id(n) in constant}
    assert len(marks) == 4 and marks == set(X.induce(pages)["template"])


@pytest.mark.parametrize("piece", ["<a", "<a ", "<a '", "<a b=\"", "<!", "<!--", "</", "</a", "<a '>", "<p ='\"", "<script", "<a b = ", "</x>", "<i>", "<div><p>", "<td><p>", "<a b='x' "])
def test_broken_pages_take_linear_time(piece):
    import time

    began = time.perf_counter()
    parse(piece * (40_000 // len(piece)))
    X.extract(piece * (20_000 // len(piece)), {})
    assert time.perf_counter() - began < 3


def test_deep_pages_of_one_host(spark):
    pages = [(f"https://deep.example.com/{i}", "<div>" * 5000 + f"<p>Text {i} of its own</p><p>Same</p>" + "</div>" * 5000 + "<p>after</p>") for i in range(6)]
    assert [t.split("\n\n")[0] for t in texts_of(spark, pages)] == [f"Text {i} of its own" for i in range(6)]
    assert max(p.count("/") for p, _ in parse("<b>" * 3000 + "x" + "</b>" * 3000 + "<p>y").walk()) <= 514
    assert [n.tag for n in parse("<b>" * 3000 + "x" + "</b>" * 3000 + "<p>y").children] == ["b", "p"]


def test_wrappers_decide_without_articles(spark):
    """Neither article, main nor telling names: the place is the wrapper's, on every page."""

    def bare(i):
        text = " ".join(f"word{i}x{j}" for j in range(40))
        menu = "".join(f"<a href=/{k}>Menu {k}</a> " for k in range(5))
        return (f"https://bare.example.com/{i}", f"<body><div class=q1><div>{menu}</div><div>Welcome to our site</div></div><div class=q2><h2>Title {i}</h2><p>{text}</p><p>More {i}</p></div><div class=q3>By the same people, {i % 3} of them</div></body>")

    pages = [bare(i) for i in range(30)]
    assert texts_of(spark, pages) == [f"Title {i}\n\n" + " ".join(f"word{i}x{j}" for j in range(40)) + f"\n\nMore {i}" for i in range(30)]
    wrapper = X.induce([h for _, h in pages])
    assert wrapper["main"].endswith("div.q") and len(wrapper["template"]) >= 6


def test_wrappers_win_over_misplaced_articles():
    """Teasers marked as articles don't displace the place that holds the host's text."""
    pages = [f"<body><div class=z>{f'Own text {i} at length. ' * 20}</div><article>See page {i}</article></body>" for i in range(8)]
    wrapper = X.induce(pages)
    assert X.extract(pages[2], wrapper).startswith("Own text 2") and X.extract(pages[2], {}) == "See page 2"
