import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evidra.llm.pieces import Model, Stream, decode, encode, encode_pieces, fields, model_path, op6_pieces

PATH = model_path()
DATA = open(PATH, "rb").read()


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


@pytest.fixture(scope="module")
def library():
    """The library over the same pieces, its model type set to unigram."""
    spec = next(v for k, v in fields(DATA) if k == 2)
    assert spec.count(b"\x18\x02") == 1
    new = spec.replace(b"\x18\x02", b"\x18\x01")
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(DATA.replace(b"\x12" + varint(len(spec)) + spec, b"\x12" + varint(len(new)) + new))
    return sp


def ids(text):
    import numpy as np

    return np.frombuffer(encode(PATH, text), "<u4").tolist()


def test_like_the_library(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    words = list(dict.fromkeys(w for t in texts for w in t.split()))[:4000]
    m = Model(DATA)
    total = lambda x: sum(m.score.get(m.text[i], 0) for i in x)
    other = [(w, ids(w), library.encode(w)) for w in words if ids(w) != library.encode(w)]
    # the library adds up 32-bit floats beside this file's score of -1e9, and so loses differences under 64
    assert len(other) <= 0.01 * len(words) and all(0 <= total(a) - total(b) < 64 for _, a, b in other)


def by_search(m, text):
    """Best segmentation over the whole text, without a window."""
    best = [(0.0, ())] + [None] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + m.longest) + 1):
            s = m.score.get(text[i:j], m.worst if j == i + 1 else None)
            if s is not None and (best[j] is None or best[i][0] + s > best[j][0]):
                best[j] = (best[i][0] + s, (*best[i][1], text[i:j]))
    return [x for p in best[-1][1] for x in m.ids_of(p)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="the anioeé 日\n", max_size=120), st.integers(1, 40))
def test_stream_is_the_whole_search(text, step):
    m = Model(DATA)
    text = m.normal(text)
    s = Stream(m)
    got = [i for a in range(0, len(text), step) for i in s.feed(text[a : a + step])] + s.feed("", last=True)
    assert got == by_search(m, text) == [i for w in [text] for i in Stream(m).feed(w, last=True)]


def test_window_stays_small():
    m = Model(DATA)
    rng = random.Random(1)
    s = Stream(m)
    n = len(s.feed("".join(rng.choice("thineaosr") for _ in range(20_000)))) + len(s.feed("", last=True))
    assert n > 2000 and s.window < 40 * m.longest


def test_a_run_of_one_character():
    """Paths of different phase never meet: held whole, in time in proportion to its length."""
    took = []
    for n in (50_000, 1_000_000):
        began = time.process_time()
        got = Stream(Model(DATA)).feed("a" * n, last=True)
        took.append(time.process_time() - began)
        assert Model(DATA).decode(got) == "a" * n
    assert took[1] < 60 and ids("a" * 3000) == by_search(Model(DATA), Model(DATA).normal("a" * 3000))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60).filter(lambda t: "▁" not in t))
def test_round_trip(text):
    assert decode(PATH, encode(PATH, text)) == text


def test_tables(spark, sf_dir):
    rows = op6_pieces(spark, sf_dir).collect()
    assert len(rows) == 200 and all(r.round_trip for r in rows)
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a  b ", 3), (3, "a  b ", 3)], "doc_id long, text string, ids int")
    got = sorted(encode_pieces(df).collect(), key=lambda r: r.doc_id)
    assert [len(r.ids) for r in got[:2]] == [0, 0] and got[2].ids == got[3].ids
    assert encode_pieces(df.limit(0)).count() == 0
