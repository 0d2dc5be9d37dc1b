from tessera.llm import line_dedup as L

PAGES = "page_id long, url string, html string, host string, often int"


def test_boilerplate_leaves(spark):
    rows = [(i, f"http://user@Site.com:80/p{i}?x", f"<script>a<b</script><nav><a href=x>Home</a> <b>now</b></nav><p>Body {i}</p><p>Body {i}</p><p>rare</p>" if i < 3 else f"<nav>Home now</nav>text {i}", "h", 1) for i in range(10)]
    rows += [(20, "http://other.org", "<nav>Home now</nav>", "h", 1), (21, None, "<nav>Home now</nav>", "h", 1), (22, "http://site.com", None, "h", 1), (None, "not a url", "x<!-- y -->", "h", 1), rows[0]]
    got = {}
    for r in L.line_deduplicated(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, []).append(r)
    assert len(got[0]) == 2 and got[0][0].host == "site.com"
    # "rare" is on 4 of 12 pages (one page twice): more than 0.3
    assert got[0][0].text == "Body 0\nBody 0" and got[0][0].n_lines == 4 and got[0][0].n_dropped == 2
    assert got[5][0].text == "text 5"
    assert got[20][0].text == got[21][0].text == "Home now"
    assert got[22][0].text == "" and got[22][0].n_lines == 0
    assert got[None][0].text == "x" and got[None][0].host is None
    assert L.line_deduplicated(spark.createDataFrame([], PAGES)).count() == 0
