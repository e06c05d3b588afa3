import html
import re

from provlake.llm import templates as tp

SCHEMA = "page_id long, url string, html string"


def plain_article(page):
    """The article of the driver's layout, cut out by hand."""
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


def test_query_gives_the_articles(spark, sf, table):
    pages = {r.page_id: r for r in table("pages").collect()}
    rows = tp.op10_templates(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def shop(i):
    """A host without any markup of roles: only its pages together tell frame and slots apart."""
    return (f"<html><body><div class=x1><p>Welcome to the shop</p><p>Call us now</p></div><div class=x2><h2>Item {i}</h2>"
            f"<p>This thing number {i} is &lt;good&gt; &amp; cheap,\n  really.</p></div><div class=x3><a href=/>All</a> <a href=/b>more things</a></div>"
            "<div class=x4><p>All rights are ours</p></body>")


def test_template_is_deduced_across_pages_of_a_host(spark):
    pages = spark.createDataFrame([(i, f"http://shop.example/{i}", shop(i)) for i in range(6)] + [(9, "http://lone.example", shop(9))], SCHEMA)
    got = {r.page_id: r.text for r in tp.extract(pages).collect()}
    for i in range(6):
        assert got[i] == f"Item {i}\n\nThis thing number {i} is <good> & cheap, really."
    assert got[9].startswith("Welcome to the shop")  # one page has no template


def test_marked_parts():
    page = ("<title>t</title><header>Site</header><nav>menu</nav><div class='cookie-notice'>We use cookies</div><main><article><header><h1>Head&eacute;</h1></header>"
            "<p>One<b> bold</b>&nbsp;two<p>Three<br>four<script>var x='</p>'</script><div id='adBox'>Buy</div><aside>side</aside><ul><li>a<li>b</ul>"
            "<form>name <input></form><div class='comments'><p>first!</p></div><!-- no > --></article></main><div class=sidebar>More</div><footer>f</footer>")
    assert tp.main_text(page, set(), set()) == "Headé\n\nOne bold two\n\nThree four\n\na\n\nb"
    assert tp.main_text("a < b and <b c", set(), set()) == "a < b and <b c" and tp.main_text(None, set(), set()) == ""
    assert tp.main_text("<p>" * 30_000 + "x" + "<div>" * 30_000, set(), set()) == "x"


def test_names_around_and_inside_an_article():
    for wrapper in ("class='layout has-sidebar'", "class=no-sidebar", "class='overflow-hidden'", "class=menu-open", "class='post share'", "id='login-wall'"):
        page = f"<div {wrapper}><article><h1>Head</h1><p>Text</p><div class='share-links'>Share</div></article></div><div class=sidebar-box>More</div>"
        assert tp.main_text(page, set(), set()) == "Head\n\nText", wrapper
    page = "<article><div class='social-history'>One</div><p id='notice-theory'>Two</p><div class='cookie-notice'>Three</div></article>"
    assert tp.main_text(page, set(), set()) == "One\n\nTwo"
    # an article of its own beats those in parts beside it, and comments inside stay out
    page = ("<div class=related><article>Teaser</article></div><main><article>Story</article><div class=comments><article>Me too</article></div></main>"
            "<aside><article>Aside</article></aside>")
    assert tp.main_text(page, set(), set()) == "Story"


def test_common_text_inside_articles(spark):
    body = lambda i, extra="": f"<article><p>Sign up today</p><p>Story {i} {extra}</p><p>Shared passage</p></article>"
    pages = [(i, "http://a.example/", body(i)) for i in range(5)] + [(5, "http://a.example/", body(5).replace("Shared", "Other"))]
    same = [(10 + i, "http://copies.example/", body(1)) for i in range(6)]
    got = {r.page_id: r.text for r in tp.extract(spark.createDataFrame(pages + same, SCHEMA)).collect()}
    assert got[0] == "Story 0\n\nShared passage" and got[10] == "Sign up today\n\nStory 1\n\nShared passage"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "no url", ""), (1, "no url", ""), (2, "", "   "), (3, "http://h", "<" * 1000), (4, "http://h", "é" * 200_000)]
    got = sorted((str(r.page_id), len(r.text)) for r in tp.extract(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 0), ("3", 1000), ("4", 200_000), ("None", 0)]
    assert tp.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_of_two_pages_has_a_template(spark):
    pages = [(i, "http://two.example/", shop(i)) for i in range(2)]
    copies = [(10 + i, f"http://copies{n}.example/", shop(1)) for n in (2, 3) for i in range(n)]
    got = [(r.page_id, r.text) for r in tp.extract(spark.createDataFrame(pages + copies, SCHEMA)).collect()]
    for i, text in got:
        if i < 10:
            assert text == f"Item {i}\n\nThis thing number {i} is <good> & cheap, really."
        else:  # nothing tells frame and slots of copies apart, so no text is lost
            assert text.startswith("Welcome to the shop") and "really." in text
    assert len(got) == 7
