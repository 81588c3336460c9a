import math
import random
import re
from collections import Counter, defaultdict

import pytest

from evidra.llm.perplexity import BINS, NARROWEST, REACH, UNIT, base_counts, half_of, judged, op11_quality_rules, words_of


def base(text):
    """The contract's counts, from strings and sets of places."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def bits(texts, order):
    """Bits of each (text, language) by dictionaries: counts, discounts and back-off as the method is written down."""
    half = {t: half_of(words_of(t[0].encode())) for t in texts}
    raw = defaultdict(Counter)
    padded = {t: bytes(order - 1) + t[0].encode() for t in set(texts)}
    for t in texts:
        p = padded[t]
        raw[t[1], half[t]].update(p[i : i + order] for i in range(len(p) - order + 1))
    levels = {}
    for at, c in raw.items():
        levels[at, order] = c
        for k in range(order - 1, 0, -1):
            levels[at, k] = Counter(g[1:] for g in levels[at, k + 1])

    def probability(at, gram):
        k = len(gram)
        if not k:
            return 1 / 256
        low, c = probability(at, gram[1:]), levels.get((at, k), Counter())
        after = [n for g, n in c.items() if g[:-1] == gram[:-1]]
        if not after:
            return low
        of = [max(1, sum(n == i for n in c.values())) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        d = [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i) for i in (1, 2, 3)]
        less = lambda n: d[min(n, 3) - 1]
        seen = c.get(gram, 0)
        return ((seen - less(seen)) if seen else 0) / sum(after) + sum(map(less, after)) / sum(after) * low

    known = {}
    out = {}
    for t, p in padded.items():
        at = (t[1], 1 - half[t])
        total = 0
        for i in range(len(p) - order + 1):
            g = p[i : i + order]
            if (at, g) not in known:
                known[at, g] = round(-math.log2(probability(at, g)) * UNIT)
            total += known[at, g]
        out[t] = total, len(p) - order + 1
    return out


def verdicts(texts, order):
    """[(base counts, failed, kept)] of rows (text, language)."""
    b = bits(texts, order)
    bins = {t: total * BINS // (n * UNIT) for t, (total, n) in b.items() if n}
    kept = {}
    for lang in {t[1] for t in texts}:
        each = sorted((bins[t], b[t][1]) for t in texts if t[1] == lang and t in bins)
        of = sum(n for _, n in each)
        quarter = lambda i: next(x for j, (x, _) in enumerate(each) if 4 * sum(n for y, n in each if y <= x) >= i * of)  # noqa: B023, E731
        if each:
            q1, q3 = quarter(1), quarter(3)
            reach = REACH * max(q3 - q1, NARROWEST)
            kept |= {t: q1 - reach <= bins[t] <= q3 + reach for t in bins if t[1] == lang}
    out = []
    for t in texts:
        c = base(t[0])
        cost, n = b[t]
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        out.append((*c, failed, not failed and kept.get(t, False), f"{2 ** (cost / n / UNIT):.9f}" if n else None))
    return out


ODD = [None, "", " \n\t", "a b c", "one two three " * 30, "x#y | z\n\nx#y | z\n" * 3 + "é<&>" + "\x0b end", "# " * 60, "word\r\nword\r\nline\x0cline"]


def test_base_counts():
    for t in [t for t in ODD if t is not None] + ["a b \u0085 c\x1c d", "a b c d a b c", "a a a a"]:
        data = t.encode()
        assert base_counts(t, data, words_of(data)) == base(t)


@pytest.mark.parametrize("head", [1 << 22, 40, 0])
def test_against_dictionaries(spark, head):
    """Also with so small an array that a join finds most n-grams, or all."""
    r = random.Random(5)
    prose = [" ".join("".join(r.choice("bdnrt") + r.choice("aou") for _ in range(r.randint(1, 3))) for _ in range(80 + i)) for i in range(20)]
    prose += ["QX!! ZW## " * 3 + " ".join(f"J{i}K%{i * i}" for i in range(70))]
    rows = [(i, t, "x") for i, t in enumerate(prose)] + [(20, prose[0], "x"), (21, prose[1], None), (22, prose[2] + " café", "y")]
    rows += [(30 + i, t, None if i % 2 else "x") for i, t in enumerate(ODD)]
    rows += [rows[3], (None, prose[4], "x")]
    df = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, text string, lang string, bits int, model string")
    got = judged(df, "doc_id", "text", "lang", order=3, head=head).collect()
    want = verdicts([(t or "", lang or "") for _, t, lang in rows], 3)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert sorted(str((r.doc_id, *(r[n] for n in names), r.perplexity and f"{r.perplexity:.9f}")) for r in got) == sorted(str((r[0], *w)) for r, w in zip(rows, want))
    assert {r.kept for r in got if not r.base_failed} == {True, False}


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op11_quality_rules(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        c = base(docs[r.doc_id])
        assert tuple(r[:6]) == (r.doc_id, *c) and r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert r.base_failed or r.kept == (r.least <= r.perplexity < r.most * 2 ** (1 / BINS))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    of = lambda q: [r.kept for r in got if labels.get(r.doc_id) == q and not r.base_failed]
    assert sum(of(1)) >= 0.9 * len(of(1)) and sum(of(0)) <= 0.7 * len(of(0))


def test_empty_table_and_one_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert judged(none, "doc_id", "text", "lang").count() == 0
    one = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(80)), "x")], none.schema)
    (r,) = judged(one, "doc_id", "text", "lang").collect()
    assert r.kept and abs(r.perplexity - 256) < 1e-9
