import random
import re

import pytest
from pyspark.sql import functions as F

from evidra.functions import pages as P
from evidra.plans.registry import QUERIES

MARKDOWN = [
    ("<h1>T <em>a</em></h1><p>One<p>Two <b>bold </b>and <a href='/u'>link</a>", "# T *a*\n\nOne\n\nTwo **bold** and [link](/u)"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></li><li><p>c</p><p>d</p></ul>", "- a\n- b\n  3. x\n  4. y\n- c\n\n  d"),
    ("<ul><li>a<ul><li>b<ul><li>c</ul></ul><li>d</ul>e", "- a\n  - b\n    - c\n- d\n\ne"),
    ("<pre><code class='language-sh'>a  b\n\n  c</code></pre>", "```sh\na  b\n\n  c\n```"),
    ("<table><caption>Cap</caption><tr><th>h|1<th>h2<tr><td>1<td>2<tr><td>3</table>", "Cap\n\n| h\\|1 | h2 |\n| --- | --- |\n| 1 | 2 |\n| 3 |  |"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</td></tr></table>", "| ain ner | b |\n| --- | --- |"),
    ("<blockquote><p>q1</p><blockquote>q2</blockquote></blockquote>end<br>more<hr>x", "> q1\n>\n> > q2\n\nend\nmore\n\n---\n\nx"),
    ("a &amp; b&nbsp;c &lt;d&gt;<img src=i.png alt=pic><img alt=only>", "a & b c <d>![pic](i.png)only"),
    ("<script>x<y</script><style>p{}</style><p>kept<!-- no --></p></div></p></table>", "kept"),
    ("<b></b><a>plain</a><i> </i><code>x*y</code>", "plain `x*y`"),
    ("<p>open <b>bold <i>both", "open **bold *both***"),
    ("<div><div>one</div>two<p>three</div>four", "one\n\ntwo\n\nthree\n\nfour"),
    ("", ""), (None, ""), ("   \n ", ""), ("<p", "<p"), ("<<<>>> 1 < 2", "<<<>>> 1 < 2"),
]


@pytest.mark.parametrize("html, want", MARKDOWN)
def test_markdown(html, want):
    assert P.markdown(html) == want


def test_deep_and_broken_pages():
    assert P.markdown("<div>" * 20_000 + "x") == "x" and P.markdown("</li>" * 1_000 + "<li>" * 1_000 + "y").strip("- \n") == "y"
    assert P.chunks("<ul><li>" * 500 + "z", 10) == [{"path": [], "level": 0, "text": "z", "links": []}]


PAGE = "<body><p>before</p><h1>A</h1><p>intro<p>more<h2>B</h2><div>text <a class='reference external' href='u'>l</a> <a href='v'>m</a></div><ul><li>x<li>y</ul><h3></h3><h2>C</h2><p>" + "z" * 30 + "<h1>D</h1><pre>a\n  b</pre>"


def test_chunks():
    got = [(c["path"], c["level"], c["text"], c["links"]) for c in P.chunks(PAGE, 20, link_class="reference external")]
    assert got == [
        ([], 0, "before", []), (["A"], 1, "A\nintro\nmore", []), (["A", "B"], 2, "B\ntext l m\nx\ny", ["u"]),
        (["A", "C"], 2, "C", []), (["A", "C"], 2, "z" * 20, []), (["A", "C"], 2, "z" * 10, []), (["D"], 1, "D\na\n  b", []),
    ]
    assert [len(c["text"]) for c in P.chunks("<p>" + "w" * 100, 40, 10)] == [40, 40, 40] and P.chunks(PAGE, 20)[2]["links"] == ["u", "v"]
    assert [c["path"] for c in P.chunks("<h4>x</h4>a<h2>y</h2>b", 9, headers=("h2",))] == [[], ["y"]]
    assert P.chunks(None, 5) == [] == P.chunks("<p> </p>", 5)


@pytest.mark.parametrize("seed", range(20))
def test_nothing_is_lost(seed):
    """Whatever the tags and the size, the chunks in order are the page's characters, and no chunk is too long."""
    r = random.Random(seed)
    tags = ["h1", "h2", "h3", "p", "div", "li", "ul", "ol", "td", "tr", "table", "b", "a", "blockquote", "span", "pre"]
    html = "".join(r.choice([f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", "word%d " % i, "x%d" % i, " ", "\n"]) for i in range(120))
    size = r.randint(5, 60)
    got = P.chunks(html, size)
    assert "".join(re.sub(r"\s", "", c["text"]) for c in got) == re.sub(r"<[^>]*>|\s", "", html)
    assert all(len(c["text"]) <= max(size, 8) for c in got)
    assert re.sub(r"[^wordx0-9]", "", re.sub(r"(?m)^ *\d+\. |\n *\d+\. ", "", P.markdown(html)).replace("word", "w")).count("w") == html.count("word")


def test_rows(spark, sf_dir):
    df = spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")
    got = P.page_chunks(df, "page_id", "html", 20).orderBy("chunk").collect()
    assert [r.prev_id for r in got[:2]] == [None, "1::chunk::0000"] and got[-1].next_id is None and got[0].next_id == "1::chunk::0001" and len(got) == 7
    assert df.select(P.to_markdown(F.col("html")).alias("m")).collect()[1].m == ""
    with pytest.raises(ValueError):
        P.page_chunks(df, "page_id", "html", 5, 5)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    made = {r.page_id: r.markdown for r in QUERIES["html_markdown"](spark, sf_dir).collect()}
    assert set(made) == set(pages) and all(P.markdown(h) == made[p] for p, h in pages.items())
    parts = QUERIES["page_chunks"](spark, sf_dir).collect()
    assert {r.page_id for r in parts} == set(pages) and max(len(r.text) for r in parts) <= 500
