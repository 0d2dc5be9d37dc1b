import random

from tessera.llm import html_extract as X
from tessera.llm.dom import parse

PAGES = "page_id long, url string, html string, text int, removed int"


def text(html):
    return X.main_text(parse(html), set())


def test_marks():
    assert text("<body><nav>menu</nav><article><header><h1>T</h1></header><p>a&nbsp;b<br>c &amp;amp; d<p>e<footer>f</footer><div class='share-box'>s</div>"
                "<section id=comments><article>bad</article></section></article><aside>x</aside></body>") == "T\na b c &amp; d\ne"
    assert text("<body class='has-sidebar'><form><h1>H</h1><p>x</p></form><div class=ad>buy</div>") == "H\nx"
    assert text("<div class=sidebar><article>small</article></div><article><p>main <b>te</b>xt</article>") == "main text"
    assert text("<div id=wrap class='page with-menu'><article>long enough</article></div>") == "long enough"
    assert text("<script>var t='</p>';</script><p title='a>b'>q</p><style>p{}</style>z<!-- c") == "q\nz"
    assert text("") == "" and text("plain &lt;b&gt;") == "plain <b>"
    assert text("<p>unclosed <a href=\"x") == "unclosed"
    assert text("<div>" * 3000 + "deep") == "deep"
    assert text("<table><tr><td>a<td>b</table><ul><li>c<li>d") == "a\nb\nc\nd"


def site(n, rnd):
    word = lambda k: " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 5) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        blocks = [word(4)] + [word(20) for _ in range(rnd.randint(2, 6))]
        want[i] = "\n".join(blocks)
        rows.append((i, f"http://h{i % 2}.com/x", "<body><div class=top><div>Site name</div><div>Home About Contact</div></div><div class=body><h1>"
                     + "</h1>".join([blocks[0], ""]) + "".join(f"<p>{b}</p>" for b in blocks[1:]) + "</div><div class=bottom><p>All rights 2020</p><p>Mail us</p></div></body>", 0, 0))
    return rows, want


def test_style_tree_removes_the_template(spark):
    rows, want = site(40, random.Random(0))
    rows += [(100, None, "<p>x", 0, 0), (101, "http://h0.com/z", None, 0, 0), (102, "http://h0.com/z", "", 0, 0), (None, "http://single.org", "<div>Site name</div>", 0, 0), (103, "nothing", "<p>y", 0, 0)]
    got = {r.page_id: r.text for r in X.extracted(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert {k: got[k] for k in want} == want
    assert (got[100], got[101], got[102], got[None], got[103]) == ("x", "", "", "Site name", "y")
    assert X.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_of_an_article_stay(spark):
    rows = [(i, "http://h.com/x", "<nav>m</nav><article><p>one article</p><p>on many pages</p></article><footer>f</footer>", 0, 0) for i in range(30)]
    assert {r.text for r in X.extracted(spark.createDataFrame(rows, PAGES)).collect()} == {"one article\non many pages"}


def test_rare_and_deep_template_goes(spark):
    """A footer on 4 % of a host's pages, and a menu more than 12 elements deep."""
    rows, n = [], 250
    for i in range(n):
        foot = "<div class=extra><p>Season sale</p></div>" if i < 10 else ""
        rows.append((i, "http://h.com/x", "<div>" * 20 + f"<div><p>Home About</p></div><p>text {i}</p>" + "</div>" * 20 + f"<p>end {i}</p>{foot}", 0, 0))
    got = {r.page_id: r.text for r in X.extracted(spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    assert got == {i: f"text {i}\nend {i}" for i in range(n)}


def test_template_inside_marked_articles_goes(spark):
    rows = [(i, "http://h.com/x", f"<nav>m</nav><article><h1>Title {i}</h1><div class=x><p>Get our app</p></div><p>text {i}</p></article>", 0, 0) for i in range(30)]
    got = {r.page_id: r.text for r in X.extracted(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"Title {i}\ntext {i}" for i in range(30)}
