"""Main text of pages: blocks, damaged markup, templates by entropy, pages of known text."""

import re

import pytest

from glyphmill.llm.queries import op1_style_tree
from glyphmill.llm.style_tree import blocks, importances, main_text, style_nodes


def text_of(page):
    return "\n".join(t for _, t in blocks(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain  words\n here", "plain words here"),
        ("<p>a<p>b<br>c</p>d", "a\nb c\nd"),
        ("<nav>menu</nav><p>x</p><footer>f</footer>", "x"),
        ("<div>out</div><article><h1>T</h1><p><b>x <i>y</b> z</i><p>w</article><p>after", "T\nx y z\nw"),
        ("<article><p>a</p><aside>no</aside><form>no<input></form><p>b</p><section id='comments'><p>no</p></section></article>", "a\nb"),
        ("<article><div class='cookie-notice'>no</div><div class=\"Ad slot\">no</div><div class=adagio>yes</div></article>", "yes"),
        ("<body class='has-sidebar'><script>var t='</p>';<p>no</script><style>p{}</style><p>&lt;b&gt; &amp;amp; &eacute;&#233;&#x20;z&nbsp;</p>", "<b> &amp; éé z\xa0"),
        ("<p>cut off &amp", "cut off &"),
        ("<p>cut <a href='x", "cut"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb\nc\n1\n2\n3"),
        ("<!-- <p>no</p> --><p title='a > b'>yes</p><![CDATA[no]]>", "yes"),
        ("<p>a</span></div>b</p></p>c", "ab\nc"),
        ("5 < 6 and 7 > 2", "5 < 6 and 7 > 2"),
        ("<main><header>no</header><p>yes</p></main>", "yes"),
    ],
)
def test_blocks(page, want):
    assert text_of(page) == want


def test_long_and_hostile_pages_end():
    for page in ("<p " * 20_000, "<p a=\"" * 5_000, "<" * 100_000, "&" * 100_000, "<div>" * 3_000 + "x", "<b>" * 3_000 + "x", "<!--" * 20_000):
        text_of(page)


def test_templates_go_by_entropy(spark):
    rows = [(i, f"https://Site.example/{i}", f"<body><div class=x><p>story {i} tells</p></div><div class=y>Follow our feed</div></body>") for i in range(20)]
    rows += [(100 + i, f"http://small.example/{i}", "<body><div class=y>Follow our feed</div></body>") for i in range(3)]
    rows += [(200, None, "<p>no host"), (201, "nonsense", None), (202, "", ""), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in main_text(pages).collect())
    want = [(i, f"story {i} tells") for i in [0, *range(20)]] + [(100 + i, "Follow our feed") for i in range(3)]
    assert got == sorted([*want, (200, "no host"), (201, ""), (202, "")])
    scored = {(r.host, r.path): r.importance for r in importances(style_nodes(pages)).collect()}
    assert scored["site.example", "/body/div.y"] == 0 and scored["site.example", "/body/div.x"] > 0.9
    assert main_text(pages.limit(0)).count() == 0


def test_query(spark, sf):
    clean = lambda t: "\n".join(x for x in (re.sub(r"[\x20\x09-\x0D]+", " ", y).strip(" ") for y in t.split("\n")) if x)
    texts = {clean(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_style_tree(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        assert r.n_chars == len(r.text)
        assert r.text.partition("\n")[2] in texts
