import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidra.llm.packing import _narrow, best_fit_decreasing, encoder, op8_packing, pack_documents, vocabulary

TOK = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", "é", "don't", "12", "!!", " ", "　", "\x1c", "\x85", "<|endoftext|>", "日本"]), max_size=14))
def test_ids_like_the_library(parts):
    text = "".join(parts)
    assert np.frombuffer(encoder("byte_bpe_50k.json")(text), "<u4").tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_vocabulary():
    text = "a <|endoftext|> b<|endoftext|><|endoftext|>\n"
    got = np.frombuffer(encoder("byte_bpe_50k.json")(text), "<u4").tolist()
    assert got == TOK.encode(text, add_special_tokens=False).ids and got.count(50256) == 3
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert vocabulary(P.path("byte_bpe_50k.json"))[0] == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_best_fit_against_search():
    rng = random.Random(5)
    lengths = [rng.randint(1, 64) for _ in range(300)]
    got = best_fit_decreasing(lengths, 64)
    rooms, want = [], {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        fit = [(r, s) for s, r in enumerate(rooms) if r >= lengths[i]]
        if fit:
            r, s = min(fit)
        else:
            rooms.append(64)
            s = len(rooms) - 1
        want[i] = rooms[s]
        rooms[s] -= lengths[i]
    assert [64 - o for _, o in got] == [want[i] for i in range(300)]
    assert max(s for s, _ in got) + 1 == len(rooms)


def check(rows, texts, window=1024):
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(docs) == set(texts)
    for d, pieces in docs.items():
        ids = np.array(TOK.encode(texts[d] or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= window
    return seqs


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seqs = check(op8_packing(spark, sf_dir).collect(), texts)
    used = sum(n for x in seqs.values() for _, n in x)
    assert used / (1024 * len(seqs)) > 0.97


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "two words", 5: "x <|endoftext|>"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, bucket string")
    rows = pack_documents(df).collect()
    check(rows, texts)
    twice = pack_documents(df.unionByName(df).unionByName(df.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert sorted((r.doc_id, r.start, r.length) for r in twice if r.doc_id is not None) == sorted(2 * [(r.doc_id, r.start, r.length) for r in rows])
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 2 * len(rows) + 1
    assert all(len(r.ids) == r.length for r in rows)
    assert pack_documents(df.limit(0)).count() == 0


def test_narrow_ids():
    small, large = np.array([0, 7, 65_535], "<u4").tobytes(), np.array([7, 65_536], "<u4").tobytes()
    assert len(_narrow(small)) == 6 and _narrow(large) == large
