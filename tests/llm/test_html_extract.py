import html as html_module
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, html_extract
from plumbline.llm.html_extract import main_text

PAGES = "page_id long, url string, html string"


def by_template(page):
    """The article of the pages of the test tables, read off their template."""
    body = page.split("<article>", 1)[1].split("</article>")[0]
    parts = [re.sub(r"<[^>]*>?", "", x) for x in re.split(r"</?(?:h1|p)>|</[a-z0-9]*$|<[a-z/0-9]*$", body)]
    return "\n\n".join(x for x in (" ".join(html_module.unescape(p).split()) for p in parts) if x)


def test_documents_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: by_template(r.html) for r in pages.collect()}
    rows = html_extract.extract(pages).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text), r.page_id


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>one <b>two</b>\n three</p><p>four<br>five</article>", "one two three\n\nfour five"),
        ("<nav>menu</nav><main><h1>T</h1><div class='sidebar-left'>no</div><p>a &amp; b &#233; &lt;x&gt; &nbsp;c</p></main><footer>f</footer>", "T\n\na & b é <x> c"),
        ("<body><div id=content><p>text<script>var a='</p>';</script> more</p></div><form><p>q</p></form><!-- <p>gone</p> --></body>", "text more"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul><section class='comments'><p>reader</p></section></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><header><h1>Title</h1></header><p>x</p><aside>y</aside><footer>z</footer></article>", "Title\n\nx"),
        ("<header>site</header><p>x</p><div style='display: none'>h</div><div hidden>i</div><p>y", "x\n\ny"),
        ("<p>cut in a tag <b", "cut in a tag"),
        ("<p>a < b and c > d</p>", "a < b and c > d"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<article><p title='a > b'>kept</p><div class='cookie-notice'>n</div></article>", "kept"),
        ("<article class='post has-sidebar'><p>kept</p></article><article class='comment'><p>reader</p></article>", "kept"),
        ("<title>t</title><textarea>x</textarea>", ""),
        ("<p>pre-­fix 　 wide</p>", "pre-­fix wide"),
        ("", ""),
        ("<article><h2 id='related-work'>R</h2><p id='notice'>a</p><h2 id='legal' class='menu'>L</h2><section id='discussion'><p>b</p></section></article>", "R\n\na\n\nL\n\nb"),
        ("<article><p>one <button>x</button>two <span class='share'>no <b>nor</b></span>three</p></article>", "one two three"),
        ("<article><p>sum <math><mi>x</mi></math> end</p><xmp>a<b>&amp;</xmp></article>", "sum x end\n\na<b>&amp;"),
        ("<article><p>a</p><div id='discussion'><p>reader</p></div><div id='comments'>reader</div></article>", "a"),
        ("<div><p>a <button>l<div>m</div></button> b</p></div>", "a b"),
    ],
)
def test_rules(page, text):
    assert main_text(page) == text


def own(i, name, n=30):
    return " ".join(f"{name}{i}x{j}" for j in range(n))


def site(n, host="s"):
    """Pages without any telling name or element: only the comparison of pages shows their template."""
    rows = []
    for i in range(n):
        rows.append((i, f"http://{host}.example/{i}", f"<body><div class=x1><a>Home</a> <a>About</a></div><div class=x2>Part of {i % 3}</div><div class=x3><p>{own(i, 'a')}</p><p>second {own(i, 'b')}</p></div><div class=x4>All rights<ul><li>one</li><li>two</li></ul></div></body>"))
    return rows


def extracted(spark, rows, **options):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES), **options).collect()}


@pytest.mark.parametrize("n", [40, 6])
def test_style_tree_finds_unmarked_template(spark, n):
    out = extracted(spark, [r if n > 20 else (r[0], r[1], r[2].replace(f"Part of {r[0] % 3}", "Part")) for r in site(n)])
    assert out == {i: f"{own(i, 'a')}\n\nsecond {own(i, 'b')}" for i in range(n)}


def test_without_the_tree_the_template_stays(spark):
    assert all("All rights" in t and "Home" in t for t in extracted(spark, site(40), low=-1.0).values())


def test_the_tree_decides_inside_articles(spark):
    rows = []
    for i in range(12):
        body = f"<h1>T{i}</h1><p>{own(i, 'a')}</p><p>Share this story</p><div class=q><div><p>More like this</p><ul><li>old</li></ul></div></div><h2>Parts</h2><ul><li>salt</li><li>{own(i, 'c', 3)}</li></ul><table><tr><th>size</th><td>{i}</td></tr></table>"
        rows.append((i, f"http://s.example/{i}", f"<body><article>{body}</article></body>"))
    for i, text in extracted(spark, rows).items():
        assert text == "\n\n".join([f"T{i}", own(i, "a"), "Parts", "salt", own(i, "c", 3), "size", str(i)])


def test_only_the_part_of_a_branch_that_is_the_same_everywhere_goes(spark):
    rows = [(i, f"http://s.example/{i}", f"<body><div class=a><p>{own(i, 'a')}</p></div><div class=b><div class=c><span>lead</span></div><div class=d>{own(i, 'd', 2)}</div></div></body>") for i in range(10)]
    for i, text in extracted(spark, rows).items():
        assert text == f"{own(i, 'a')}\n\n{own(i, 'd', 2)}"


def test_noise_against_its_definition():
    node = lambda key, up, depth, **x: {"node": key, "parent": up, "depth": depth, "fixed": False, "pages": 10, "styles": 1, "presentation": 0.0, "texts": 0, "content": 1.0, "loose": 0} | x
    menu, item, body = node(2, 1, 2), node(3, 2, 3, texts=10, content=0.0), node(4, 1, 2, texts=10, content=1.0)
    root = node(1, 0, 1, fixed=True)
    noise = lambda nodes: html_extract.noise(nodes, 0.4)
    assert noise([root, menu, item, body]) == [2]
    assert noise([root, menu | {"loose": 10}, item, body]) == [3]
    assert noise([root, menu, item | {"fixed": True}, body]) == [2]
    assert noise([root, menu | {"styles": 40, "presentation": 0.9}, item, body]) == [3]
    assert noise([root, menu, item]) == [2] and noise([]) == []


def test_a_node_counts_once_a_page(spark):
    rows = [(i, f"http://s.example/{i}", f"<body><div><p>{own(i, 'a')}</p><p><b>x</b></p><p><i>{i}</i></p></div></body>") for i in range(5)]
    pages = spark.createDataFrame(rows, PAGES).select("page_id", F.lit(1).cast("long").alias("host"), "html")
    assert {r.pages for r in html_extract.StyleTree(pages).nodes().collect()} == {5}


def test_copies_under_other_chrome_keep_their_article(spark):
    rows = [(i, f"http://s.example/{i}", f"<nav>menu {i}</nav><div class=ad>buy {i}</div><article><p>the same story</p><div><p>everywhere</p></div></article>") for i in range(20)]
    rows += [(100 + i, f"http://s.example/o{i}", f"<nav>menu</nav><article><p>{own(i, 'z')}</p></article>") for i in range(10)]
    out = extracted(spark, rows)
    assert {out[i] for i in range(20)} == {"the same story\n\neverywhere"} and out[103] == own(3, "z")


def test_results_do_not_depend_on_the_order_of_pages(spark):
    rows = site(12) + [(50 + i, f"http://s.example/c{i}", f"<nav>{i}</nav>{site(1)[0][2]}") for i in range(5)]
    assert extracted(spark, rows) == extracted(spark, rows[::-1])


def test_join_path_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(site(40), PAGES)
    want = sorted(map(tuple, html_extract.extract(df).collect()))
    monkeypatch.setattr(common.lookup, "__defaults__", ("left", 0))
    assert sorted(map(tuple, html_extract.extract(df).collect())) == want


def test_copies_of_an_article_keep_it(spark):
    page = "<nav>m</nav><article><h1>T</h1><p>the same story everywhere</p></article>"
    df = spark.createDataFrame([(i, f"http://s.example/{i}", page) for i in range(30)], PAGES)
    assert {r.text for r in html_extract.extract(df).collect()} == {"T\n\nthe same story everywhere"}


def test_awkward_rows(spark):
    rows = [(1, None, None), (None, "", ""), (2, "no url", "<p>x</p>"), (2, "no url", "<p>x</p>"), (3, "http://[bad", "<p>y</p>"), (4, "HTTP://User@S.Example:80/p", "<p>" + "z " * 200000 + "</p>"), (5, "http://s.example", "<" * 3000 + "p>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("low", F.lit(1)).withColumn("text", F.lit("t"))
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.n_chars) for r in out.collect()), key=repr)
    assert got == sorted([(1, 0), (None, 0), (2, 1), (2, 1), (3, 1), (4, 399999), (5, len(main_text("<" * 3000 + "p>")))], key=repr)
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_copied_pages_keep_lists_tables_and_plain_divs(spark):
    listed = "<html><body><article><h1>T</h1><ul><li>first item</li></ul><table><tr><th>head</th><td>cell</td></tr></table></article></body></html>"
    plain = "<html><body><div class=post><p>story</p>tail</div></body></html>"
    rows = [(i, f"https://a.example/{i}", listed) for i in range(12)] + [(20 + i, f"https://b.example/{i}", plain) for i in range(12)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    alone = html_extract.main_text(listed), html_extract.main_text(plain)
    assert "cell" in alone[0] and "first item" in alone[0] and "story" in alone[1]
    assert out == {i: alone[i >= 20] for i in out} and len(out) == 24
