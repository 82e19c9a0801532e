import pytest
from pyspark.sql import functions as F

from tidemill.functions import html, relocation, selectors, text

PAGE = """<!DOCTYPE html><html><head><title>Shop &amp; more</title><script>if (a < b && c) {}</script></head><body>
<div class="content main" id="top" data-n=5><h1>Main</h1><p class="intro">Intro <b>bold</b> tail</p>
<ul class="list"><li>one</li><li class=x>two</li><li class="x y">three<ul><li>deep</li></ul></li></ul>
<a href="/a?x=1&amp;y=2" class="link">Link</a><img src="i.png" alt='say "hi" <now>'><!-- note --></div>
<div class="side"><p>Side</p><br><p>Last one</p></div><table><tr><td>1<td>2<tr><td>3</table></body></html>"""

# what each selector gives, by hand
CASES = {
    "title": ["Shop & more"], ".content h1": ["Main"], "//div[@class='content main']/h1": ["Main"], "#top > p": ["Intro bold tail"], ".list > li": ["one", "two", "three deep"], "a.link::attr(href)": ["/a?x=1&y=2"],
    "//img/@alt": ['say "hi" <now>'], "p.intro::text": ["Intro", "tail"], "//p/text()": ["Intro", "tail", "Side", "Last one"], "b + p": [], "h1 + p": ["Intro bold tail"], "h1 ~ ul > li.x": ["two", "three deep"],
    "p:not(.intro)": ["Side", "Last one"], "li:first-child": ["one", "deep"], "ul > li:last-child": ["three deep", "deep"], "li:nth-child(2)": ["two"], "li:nth-child(odd)": ["one", "three deep", "deep"],
    "li:nth-child(-n+2)": ["one", "two", "deep"], "li:nth-last-child(1)": ["three deep", "deep"], "p:first-of-type": ["Intro bold tail", "Side"], "p:last-of-type": ["Intro bold tail", "Last one"], "p:nth-of-type(2)": ["Last one"],
    "b:only-child": ["bold"], "p:contains('Last')": ["Last one"], "h1, .side p": ["Main", "Side", "Last one"], "[data-n='5'] h1": ["Main"], "li[class~=y]": ["three deep"], "a[href^='/a'][href$='2'][href*='x=1']": ["Link"],
    "a[href='/a?x=1&y=2']": ["Link"], "//a[@href='/a?x=1&y=2']": ["Link"], "(//li)[1]": ["one"], "(//li)[last()]": ["deep"], "(//li)[0]": [], "(//li)[9]": [], "//ul/li[1]": ["one", "deep"], "//li[@class][1]": ["two"], "//li[@class][2]": ["three deep"],
    "//li[position()<3]": ["one", "two", "deep"], "//li[last()]": ["three deep", "deep"], "//li[position()=last()]": ["three deep", "deep"], "//li[contains(@class,'x') and not(contains(@class,'y'))]": ["two"],
    "//li[text()='two']": ["two"], "//li[contains(text(),'e')]": ["one", "three deep", "deep"], "//li[starts-with(.,'th')]": ["three deep"], "//li[ul]": ["three deep"], "//li[ul/li='deep']": ["three deep"], "//li[not(ul)]": ["one", "two", "deep"],
    "//h1/following-sibling::p": ["Intro bold tail"], "//ul/preceding-sibling::h1": ["Main"], "//li[.='deep']/ancestor::li": ["three deep"], "//b/..": ["Intro bold tail"], "//b/parent::p/@class": ["intro"], "//h1/following::p[1]": ["Intro bold tail"],
    "//table/preceding::p": ["Intro bold tail", "Side", "Last one"], "//table/preceding::p[1]": ["Last one"], "//li[.='deep']/ancestor::*[1]": ["deep"], "//p[normalize-space()='Intro bold tail']": ["Intro bold tail"],
    "//li[string-length(.)=3]": ["one", "two"], "//ul[count(li)=3]/li[2]": ["two"], "//div[@data-n>4]/h1": ["Main"], "//div[@data-n=4]/h1": [], "//h1 | //title": ["Shop & more", "Main"], "//td[.='1' or .='3']": ["1", "3"],
    "/html/body/div[2]/p[2]": ["Last one"], "//*[@id='top']/*[1]": ["Main"], "//div//p[@class='intro']//b": ["bold"], "css=h1": ["Main"], "xpath=//h1": ["Main"], "//body/descendant::b": ["bold"], "tr:nth-child(2) td": ["3"],
    "//li[@class='x y' or position()=1]": ["one", "three deep", "deep"], "//a[@href]": ["Link"], "//nothing": [], "*:root > head > title": ["Shop & more"],
}


@pytest.fixture(scope="module")
def page(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain < text"), (5, "</p><li>a<li>b</ul><td>")]
    return html.parse(spark.createDataFrame(rows, "id long, html string").coalesce(1)).cache()


def test_selectors(page):
    """Every axis, condition and function against what is written down."""
    n = F.col("nodes")
    got = page.select("id", *(html.getall(n, s).alias(f"c{i}") for i, s in enumerate(CASES))).collect()
    by = {r["id"]: r for r in got}
    assert {s: by[1][f"c{i}"] for i, s in enumerate(CASES)} == CASES
    assert all(x is None for x in by[2][1:]) and all(x == [] for x in by[3][1:] + by[4][1:])


def test_attributes_and_firsts(page):
    n = F.col("nodes")
    r = page.filter("id = 1").select(
        html.get(n, "li"), html.get(n, "video", "none"), html.attr(n, "img", "ALT"), html.attr(n, "h1", "id", "?"), html.attrs(n, "//li", "class"), html.attrs(n, "div", "id"), html.get(n, "//li[3]/text()")
    ).first()
    assert list(r) == ["one", "none", 'say "hi" <now>', "?", ["x", "x y"], ["top"], "three"]


def test_outer(page):
    """Nested and void elements, escapes, comments and scripts come back as HTML."""
    n = F.col("nodes")
    wanted = {
        "h1": ["<h1>Main</h1>"],
        ".intro": ['<p class="intro">Intro <b>bold</b> tail</p>'],
        "li.y": ['<li class="x y">three<ul><li>deep</li></ul></li>'],
        "a": ['<a href="/a?x=1&amp;y=2" class="link">Link</a>'],
        "img": ['<img src="i.png" alt="say &quot;hi&quot; &lt;now&gt;">'],
        "title": ["<title>Shop &amp; more</title>"],
        "script": ["<script>if (a < b && c) {}</script>"],
        ".side": ['<div class="side"><p>Side</p><br><p>Last one</p></div>'],
        "tr": ["<tr><td>1</td><td>2</td></tr>", "<tr><td>3</td></tr>"],
        "//p/text()": ["Intro ", " tail", "Side", "Last one"],
        "//img/@src": ["i.png"],
        "video": [],
    }
    r = page.filter("id = 1").select(*(html.getall_outer(n, s) for s in wanted), html.get_outer(n, "h1"), html.get_outer(n, "video", "no"), html.get_outer(n, "#top")).first()
    assert dict(zip(wanted, r, strict=False)) == wanted and r[-3:-1] == ("<h1>Main</h1>", "no")
    assert r[-1].startswith('<div class="content main" id="top" data-n="5"><h1>') and r[-1].endswith("<!-- note --></div>")
    assert page.filter("id = 5").select(html.getall_outer(n, "li")).first()[0] == ["<li>a</li>", "<li>b<td></td></li>"]


@pytest.mark.parametrize("bad", ["", "p >", "> p", "p:hover", "p::before", "a[href", "a[href=]", "//", "//a[", "//a[@href='x]", "//a]", "//foo::a", "//a[matches(., 'x')]", "p p)", "li:nth-child(x)", "a & b", "//a[1", "(//a", "{{x}}", "//a//", "p:not(", ".5x."])
def test_not_understood(bad):
    """A selector that the grammar does not cover raises; nothing is skipped."""
    with pytest.raises(ValueError):
        selectors.paths(bad)


def test_one_parse(spark):
    """However many selectors read it, a page is parsed once and stays in its row."""
    pages = html.parse(spark.createDataFrame([(1, PAGE)], "id long, html string"))
    out = pages.select("id", *(html.getall(F.col("nodes"), s).alias(f"c{i}") for i, s in enumerate(["h1", "//li/a", "a::attr(href)"])))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_bound_is_never_below_the_likeness(spark):
    """The bound from lengths holds for all pairs of elements, and the likest element is the one that comparing all gives."""
    other = PAGE.replace("Main", "Main page").replace('class="intro"', 'class="lead" title=t').replace("two", "second").replace("<h1>", '<h1 class="big">')
    rows = html.elements(spark.createDataFrame([(1, PAGE), (2, other)], "id long, html string"), ["id"], "html")
    fp = rows.select(F.col("id").alias("page"), "place", F.struct(*[c for c in rows.columns if c not in ("id", "place")]).alias("fp")).cache()
    saved = fp.filter("page = 1").select(F.col("place").cast("string").alias("identifier"), "fp")
    pairs = saved.select("identifier", F.col("fp").alias("a")).crossJoin(fp.select("page", "place", F.col("fp").alias("b"))).filter("a.tag = b.tag")
    scored = pairs.select("identifier", "page", "place", relocation.at_most(F.col("a"), F.col("b")).alias("most"), relocation.similarity("a", "b").alias("score")).collect()
    assert all(r["most"] >= r["score"] - 1e-6 for r in scored)
    best = {}
    for r in scored:
        best.setdefault((r["identifier"], r["page"]), []).append((r["score"], r["place"]))
    want = {(k, p, round(s, 9)) for k, v in best.items() for s, p in v if s == max(v)[0] and s >= 30}
    assert {((r["identifier"], r["page"]), r["place"], round(r["score"], 9)) for r in relocation.relocate(saved, fp, 30.0).collect()} == want


def test_fingerprints_leave_out(spark):
    r = html.elements(spark.createDataFrame([(1, '<div class="" id="t" style="  " data-val="x" data-reactid="9"></div>')], "id long, html string"), ["id"], "html", "div").first()
    assert r["attributes"] == {"id": "t", "data-val": "x"}


def test_store(spark, tmp_path):
    """First fingerprints stay, domains are apart, a repeated save adds nothing, unknown keys have none."""
    store = relocation.FingerprintStore(f"file://{tmp_path}/prints")
    assert store.read(spark).count() == 0
    empty = ({}, ["div"], None, {}, None, [], [])
    frame = lambda *rows: spark.createDataFrame([(d, i, ("div", text, *empty)) for d, i, text in rows], f"domain string, identifier string, fp struct<{relocation.FINGERPRINT}>")
    store.save(frame(("a.com", "article", "text of A"), ("b.com", "article", "text of B")), 1)
    store.save(frame(("a.com", "article", "changed"), ("a.com", "list", "new")), 2)
    again = store.save(frame(("a.com", "article", "changed"), ("a.com", "list", "new")), 3)
    assert {(r["domain"], r["identifier"]): r["fp"]["text"] for r in again.collect()} == {("a.com", "article"): "text of A", ("b.com", "article"): "text of B", ("a.com", "list"): "new"}
    assert again.filter("domain = 'c.com'").count() == 0


def test_healing(spark, tmp_path):
    """A selector that no longer hits finds what moved, by the fingerprint of the domain's first page, in that domain only."""
    store = relocation.FingerprintStore(f"file://{tmp_path}/prints")
    first = "<body><h1>Shop</h1><div class='price'>12.50 EUR</div><div class='foot'>All rights</div></body>"
    moved = "<body><h1>Shop</h1><section></section><div class='cost'>12.90 EUR</div><div class='foot'>All rights reserved</div></body>"

    def visit(n, pages):
        parsed = html.parse(spark.createDataFrame(pages, "page long, domain string, html string"))
        prints = lambda s: F.inline(F.transform(html.found(F.col("nodes"), s), lambda p: F.struct(p.alias("place"), html.fingerprint(F.col("nodes"), p).alias("fp"))))
        hits, divs = parsed.select("page", prints("div.price")), parsed.select("page", "domain", prints("div"))
        return sorted((r["page"], r["place"], r["healed"]) for r in relocation.heal(parsed.select("page", "domain"), hits, divs, store, n).collect())

    assert visit(1, [(1, "a.com", first), (2, "b.com", moved)]) == [(1, 4, False)]
    assert visit(2, [(1, "a.com", moved), (2, "b.com", moved), (3, "a.com", first), (4, "a.com", None)]) == [(1, 5, True), (3, 4, False)]
    assert visit(3, [(1, "a.com", first)]) == [(1, 4, False)] and store.read(spark).first()["fp"]["text"] == "12.50 EUR"


def test_sql_functions(spark):
    """Nodes as a table function, and functions by name."""
    from tidemill.functions import sql

    assert "html_nodes" in sql.register(spark)
    spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id long, html string").createOrReplaceTempView("shop")
    got = spark.sql("SELECT id, n.* FROM shop, LATERAL html_nodes(html) n").collect()
    want = html.nodes(spark.table("shop"), ["id"], "html").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r["id"] for r in got} == {1, 3}
    assert spark.sql("SELECT decode_html_entities('a &amp; b'), detect_encoding(X'EFBBBF41', CAST(NULL AS STRING))").first()[:] == ("a & b", "utf-8")


def test_cut_references_stay(spark):
    """A reference without its semicolon is text, in nodes and written again; scripts, comments and attributes keep their ampersands."""
    page = '<h1 title="a&ampb&lt;">x &amp; y &am<b>&amp</b> &lt;&#65;&#66 \ufdd0</h1><script>a && b &amp; c</script><!-- & -->'
    n = F.col("nodes")
    got = html.parse(spark.createDataFrame([(page,), ("<p>&copy; &</p>",)], "html string")).select(
        html.get(n, "h1::text").alias("first"), html.get(n, "h1").alias("words"), html.get_outer(n, "h1").alias("outer"), html.get_outer(n, "script").alias("script"),
        html.attr(n, "h1", "title").alias("title"), html.get_outer(n, "p").alias("p"), F.get(F.filter(n, lambda x: x["tag"] == "!--"), F.lit(0))["text"].alias("comment"), html.get(n, "p").alias("copy")
    ).collect()
    assert got[0]["first"] == "x & y &am" and got[0]["words"] == "x & y &am &amp <A&#66 \ufdd0" and got[0]["title"] == "a&ampb<"
    assert got[0]["outer"] == '<h1 title="a&amp;ampb&lt;">x &amp; y &am<b>&amp</b> &lt;A&#66 \ufdd0</h1>' and got[0]["script"] == "<script>a && b &amp; c</script>"
    assert got[0]["comment"] == " & " and got[1]["p"] == "<p>\u00a9 &</p>" and got[1]["copy"] == "\u00a9 &"
    closed = spark.createDataFrame([("&amp;lt; &amp &copy; &ampx; &#38 &#x41;",)], "t string").select(text.decode_closed_entities("t").alias("t")).first()["t"]
    assert closed == "&lt; &amp \u00a9 &ampx; &#38 A"


def test_references_as_written(spark):
    """Texts with their references as the page has them, beside the decoded ones; scripts, attributes and tags are as before."""
    page = "<title>a &quot;b&#34; &amp;lt; &am &copy;</title><p x='&quot;&amp'>&nbsp;<b>&lt;i&gt;</b> c&amp;</p><script>a &amp; b &quot</script><x&amp;y>z</x&amp;y><i>no</i>"
    n = F.col("nodes")
    r = html.parse(spark.createDataFrame([(page,)], "html string")).select(
        html.get(n, "title", written=True), html.get(n, "title"), html.get(n, "p", written=True), html.getall(n, "p::text", written=True), html.attr(n, "p", "x"), html.get(n, "script", written=True),
        html.get_outer(n, "script"), html.get(n, "i", written=True), html.get_outer(n, "title"), F.transform(F.filter(n, lambda x: x["raw"].isNotNull()), lambda x: x["raw"]), F.exists(n, lambda x: x["tag"] == "x&amp;y")
    ).first()
    assert r[0] == "a &quot;b&#34; &amp;lt; &am &copy;" and r[1] == 'a "b" &lt; &am ©' and r[2] == "&nbsp; &lt;i&gt; c&amp;" and r[3] == ["&nbsp;", "c&amp;"]
    assert r[4] == '"&amp' and r[5] == "a &amp; b &quot" and r[6] == "<script>a &amp; b &quot</script>" and r[7] == "no"
    assert r[8] == '<title>a "b" &amp;lt; &am ©</title>' and r[9] == ["a &quot;b&#34; &amp;lt; &am &copy;", "&nbsp;", "&lt;i&gt;", " c&amp;"] and r[10]


def _as_sql(spark, folder, query):
    """Rows of a query and of its SQL over pages whose titles and headings hold many kinds of references."""
    import duckdb

    import __spark_entry__ as entry

    kinds = ["&quot;x&quot; &amp; y", "&amp;quot;", "&lt;b&gt; &#39;c&#x27;", "cut &quo", "&copy; &middot; &amp", "plain", "&nbsp;z"]
    body = '<html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><div class="ad">x</div><article><h1>{0}</h1></article></body></html>'
    spark.createDataFrame([(i, body.format(k)) for i, k in enumerate(kinds)], "page_id long, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    found = con.execute(entry.oracle_sql()[query])
    names = [c[0] for c in found.description]
    return sorted(tuple(r) for r in entry.queries()[query](spark, str(folder)).select(*names).collect()), sorted(found.fetchall())


def test_titles_equal_sql(spark, tmp_path):
    got, want = _as_sql(spark, tmp_path, "html_select")
    assert len(got) == 7 and got == want


def test_headings_equal_sql(spark, tmp_path):
    got, want = _as_sql(spark, tmp_path, "selector_axes")
    assert len(got) == 7 and got == want
