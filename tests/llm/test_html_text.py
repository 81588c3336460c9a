import html
import itertools
import math
import random
import re
import time

from evidra.llm.html_text import Node, dom, extract_text, kind_of, labelled_pages, labels_of, main_text, model, op2_html_text


def test_marginals_against_enumeration():
    rng = random.Random(2)
    m = model()
    for _ in range(20):
        nodes = [Node("html", -1)] + [Node(rng.choice(["div", "p", "#", "nav"]), rng.randrange(0, i), ("ad",) * rng.randint(0, 1)) for i in range(1, 8)]
        from evidra.llm.html_text import clues

        own = [1 / (1 + math.exp(-(m.bias + sum(m.weights.get(c, 0.0) for c in clues(x, nodes))))) for x in nodes]
        total, on = 0.0, [0.0] * 8
        for s in itertools.product((0, 1), repeat=8):
            w = math.prod(own[i] if s[i] else 1 - own[i] for i in range(8)) * math.prod(m.edges[kind_of(nodes[i])][2 * s[nodes[i].parent] + s[i]] for i in range(1, 8))
            total += w
            on = [a + w * b for a, b in zip(on, s)]
        assert all(abs(a / total - b) < 1e-9 for a, b in zip(on, m.marginals(nodes)))


def test_held_out_layouts():
    right = every = 0
    for page in labelled_pages(150, seed=99):
        nodes = dom(page, labelled=True)
        for x, y, q in zip(nodes, labels_of(nodes), model().marginals(nodes)):
            if x.tag == "#":
                every += 1
                right += (q >= 0.5) == bool(y)
    print("runs", every, "right", right / every)
    assert right / every > 0.985


def wanted(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    out = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n\n".join(x for x in out if x)


def test_query(spark):
    for sf in ("sf0.001", "sf0.01"):
        pages = {r.page_id: r.html for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
        rows = op2_html_text(spark, f"/root/testdata/{sf}").collect()
        assert len(rows) == len(pages)
        bad = [r.page_id for r in rows if r.text != wanted(pages[r.page_id]) or r.n_chars != len(r.text)]
        assert not bad, bad[:5]


def test_hostile_pages_take_time_in_proportion():
    n = 20_000
    pages = ["<div>" * n + "</p>" * n, "<td>" + "<div>" + "<blockquote>" * n + "<td></td>" * n, "<template>" * n + "x", "<li>" * n, "<p a='>" * n, '<div a=">' * n, "<!-- " * n, "<" * n]
    for page in pages:
        began = time.process_time()
        main_text(page, model())
        assert time.process_time() - began < 12, page[:20]


def test_content_that_is_kept():
    long = "One sentence, of some ten words, that tells about a thing. " * 4
    page = f'<div data-l="x" data-class="ad nav" title="hidden gem"><article><h1>The title</h1><p>{long}</p><figure><img src=x><figcaption>What the picture shows.</figcaption></figure><p>Since <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds, {long}</p><svg class="icon"/><p>After the icon. {long}</p><template><p>{long}</p></article></div>'
    got = main_text(page, model())
    want = ["The title", long.strip(), "What the picture shows.", f"Since a=2 holds, {long.strip()}", f"After the icon. {long.strip()}", long.strip()]
    assert got == "\n\n".join(want)
    x = next(x for x in dom(page) if x.tag == "div")
    assert x.tokens == () and x.label is None


def test_odd_pages(spark):
    m = model()
    assert main_text(None, m) == main_text("", m) == ""
    for page in ("<", "<p", "a < b", "<p>x<div", "</p></div>", "<a href='", "<!-- x", "<script>x", "&amp", "<p>" * 3000 + "x", "<div>" * 3000 + "x", '<p class="' + "x" * 100_000):
        main_text(page, m)
    text = "<article><h1>A title</h1><p>One &lt;b&gt; two,\n three four words of text here.</p><div class='comments'><p>Great post, thanks.</p></div></article><form><p>Sign up here</p></form>"
    assert main_text(text, m) == "A title\n\nOne <b> two, three four words of text here."
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, text, 3), (3, text, 3)], "page_id long, html string, text int")
    got = sorted(extract_text(df).collect(), key=lambda r: r.page_id)
    assert [got[0].text, got[1].text] == ["", ""] and got[2] == got[3]
    assert extract_text(df.limit(0)).count() == 0
