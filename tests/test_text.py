import pytest

from evidra.functions.text import chunk_windows, md_sections, sections_of


def test_sections():
    text = "intro\n# A\nbody\r\n## B [¶](#b)\nmore\n```\n# no heading\n```\n### Empty\n## C\nlast\n# D\nend"
    assert sections_of(text) == [([], "intro"), (["A"], "body"), (["A", "B"], "more\n```\n# no heading\n```"), (["A", "C"], "last"), (["D"], "end")]
    assert sections_of("#### deep\nx\n# top\ny") == [(["deep"], "x"), (["top"], "y")]
    assert sections_of(" a   b ") == [([], "a   b")]
    assert sections_of("# only") == [([], "# only")] and sections_of(None) == sections_of("") == [([], "")]
    assert sections_of("```\n# open") == [([], "```\n# open")]


def test_sections_rows(spark):
    df = spark.createDataFrame([(1, "# A\nx\n# B\ny", 0), (2, None, 0), (1, "z", 0)], "doc_id long, text string, section_index int")
    got = md_sections(df.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.section_index, tuple(r.heading_path), r.text) for r in got) == [(1, 0, (), "z"), (1, 0, ("A",), "x"), (1, 1, ("B",), "y"), (2, 0, (), "")]
    assert not md_sections(df.select("doc_id", "text").limit(0)).collect()


def test_windows(spark):
    df = spark.createDataFrame([("g", "one two three four five six seven eight nine ten"), ("e", " "), ("n", None)], "doc_id string, text string")
    got = sorted(chunk_windows(df, 4, 1).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_id for r in got] == [f"g::chunk::000{i}" for i in range(4)]
    assert [r.prev_id for r in got] == [None, *[r.chunk_id for r in got[:-1]]] and [r.next_id for r in got] == [*[r.chunk_id for r in got[1:]], None]
    assert [(r.token_count, r.overlap_tokens) for r in got] == [(4, 0), (4, 1), (4, 1), (1, 1)] and got[3].chunk_text == "ten"
    with pytest.raises(ValueError):
        chunk_windows(df, 4, 4)
