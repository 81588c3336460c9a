import random

import pytest
from pyspark.sql import functions as F

from evidra.functions import urls as U
from evidra.operators import crawl as C
from evidra.operators import positions as P


def queue_crawl(home, links, depth, most):
    """(links met in order, pages visited in order) by a queue."""
    queue, seen, met, visited = [(home, 0)], {home}, [], []
    while queue:
        page, d = queue.pop(0)
        visited.append(page)
        for link in links.get(page, []) or [page]:
            if link not in met:
                met.append(link)
            if (depth is not None and d + 1 > depth) or link in seen:
                continue
            if len(seen) >= most:
                break
            seen.add(link)
            queue.append((link, d + 1))
    return met if home in met else [home, *met], visited


@pytest.mark.parametrize("seed", range(3))
def test_against_a_queue(spark, seed):
    r = random.Random(seed)
    name = lambda i: f"https://a.example/docs/p{i}"
    graph = {name(i): [name(j) for j in dict.fromkeys(r.choices(range(40), k=r.randint(0, 6)))] for i in range(40)}
    links = spark.createDataFrame([(p, i, to) for p, ls in graph.items() for i, to in enumerate(ls)], "page string, pos int, link string")
    cases = [("all", name(0), None, 500), ("near", name(1), 2, 500), ("few", name(0), None, 7), ("none", name(2), 0, 500), ("some", name(3), 3, 12), ("one", name(5), None, 1)]
    sources = spark.createDataFrame(cases, "source string, home string, max_depth int, max_pages int")
    got = C.internal_crawl(links, sources).collect()
    visited, _ = C.crawled(links, sources, U.in_subtree)
    seen = visited.collect()
    for source, home, depth, most in cases:
        met, order = queue_crawl(home, graph, depth, most)
        assert [x.link for x in sorted((x for x in got if x.source == source), key=lambda x: (x.depth, x.parent, x.pos))] == met
        assert [x.url for x in sorted((x for x in seen if x.source == source), key=lambda x: (x.depth, x.place))] == order


def test_registered_sources(spark):
    graph = [("https://b.example/guide", 0, "https://b.example/guide/a"), ("https://b.example/guide", 1, "https://b.example/forum/guide/x"), ("https://b.example/guide", 2, "https://c.example/guide/a"), ("https://b.example/guide", 3, "https://b.example/guide/old/1"), ("https://b.example/guide/a", 0, "https://b.example/guide/b"), ("https://b.example/guide/b", 0, "https://b.example/guide/c")]
    links = spark.createDataFrame(graph, "page string, pos int, link string")
    register = spark.createDataFrame([("s", "https://B.example/guide/", 2, 9, ["b.example"], ["https://b.example/guide"], ["/old/"]), ("t", "https://b.example/other", 2, 9, ["b.example"], ["https://b.example/guide"], None)], "source string, home string, max_depth int, max_pages int, domains array<string>, prefixes array<string>, excluded array<string>")
    got = sorted((r.depth, r.url) for r in C.source_crawl(links, register).collect())
    assert got == [(0, "https://b.example/guide"), (1, "https://b.example/guide/a"), (2, "https://b.example/guide/b")]


def test_urls(spark):
    base = "https://Docs.Example.org/hpc/user/index.html?x=1"
    cases = {"a.html": "https://Docs.Example.org/hpc/user/a.html", "../b/": "https://Docs.Example.org/hpc/b/", "./": "https://Docs.Example.org/hpc/user/", "/c?q=1#f": "https://Docs.Example.org/c?q=1", "//x.org/d": "https://x.org/d", "?y": "https://Docs.Example.org/hpc/user/index.html?y", "mailto:a@b": "mailto:a@b", "#top": "https://Docs.Example.org/hpc/user/index.html?x=1", "../../../e": "https://Docs.Example.org/e", "a/./b/../c": "https://Docs.Example.org/hpc/user/a/c"}
    df = spark.createDataFrame([(k,) for k in cases], "link string")
    got = {r.link: (r.to, r.canon, r.own) for r in df.select("link", U.resolved(F.lit(base), F.col("link")).alias("to"), U.canonical(U.resolved(F.lit(base), F.col("link"))).alias("canon"), U.internal(F.lit(base), U.resolved(F.lit(base), F.col("link"))).alias("own")).collect()}
    assert {k: v[0].split("#")[0] for k, v in got.items()} == cases
    assert got["../b/"][1] == "https://docs.example.org/hpc/b" and got["/c?q=1#f"][1] == "https://docs.example.org/c?q=1" and got["//x.org/d"][1] == "https://x.org/d"
    assert [k for k, v in got.items() if not v[2]] == ["//x.org/d", "mailto:a@b"]
    pages = spark.createDataFrame([("http://e.org/x/", "<a href='y'>1</a><A HREF=/z>2</a><a class=k href=\"http://sub.e.org/w#1\">3</a><a href=\"y#2\">4</a><a href='ftp://e.org'>5</a><a href='http://f.org'>6</a>"), ("http://e.org/none", None)], "url string, html string")
    links = sorted((r.page, r.pos, r.link) for r in C.page_links(pages).collect())
    assert links == [("http://e.org/none", 0, "http://e.org/none"), ("http://e.org/x", 0, "http://e.org/x"), ("http://e.org/x", 1, "http://e.org/x/y"), ("http://e.org/x", 2, "http://e.org/z"), ("http://e.org/x", 3, "http://sub.e.org/w")]


def test_places(spark, tmp_path):
    spark.createDataFrame([(i, f"r{i}") for i in range(300)], "id int, v string").repartition(5, "id").write.json(f"{tmp_path}/a")
    files = sorted((tmp_path / "a").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines()]
    a = P.file_index(spark.read.schema("id int, v string").json(f"{tmp_path}/a"))
    assert [f'{{"id":{r.id},"v":"{r.v}"}}' for r in sorted(a.collect(), key=lambda r: r.place)] == lines
    b = P.row_index(spark.range(300).select((F.col("id") % 7).alias("id")), [-F.col("id")])
    rows = sorted(b.collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(300)) and {r.id for r in rows} == set(range(7))
    got = P.joined_by_place(a, b)
    assert got.columns == ["place", "id", "v", "id_right"] and got.count() == 300
    with pytest.raises(ValueError, match="300 rows and 299"):
        P.joined_by_place(a, b.where("place > 0"))
