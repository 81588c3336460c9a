import random

import pytest

from evidra.operators.turns import Budget, fold, pack_turns, words


def msgs(*texts):
    return iter([(str(i), "USER", t) for i, t in enumerate(texts)])


def test_at_most_three_turns_and_context():
    got = list(fold(msgs("start", "a b c", "d", "e", "f g"), Budget(size=60, overlap=2)))
    assert [(c[1], c[3], c[4]) for c in got] == [("initial", None, None), ("conversation", "1", "3"), ("conversation", "4", "4")]
    assert [c[7] for c in got] == [False, False, True] and "[CONTEXT]\ne\n\n" in got[2][2]
    assert [c[8] for c in got] == [None, 0, 1] and [c[9] for c in got] == [1, 2, None]
    assert got[1][5] == ["USER"] * 3 and got[0][5] == ["TICKET_CREATOR"]


def test_long_message_in_parts():
    para = [" ".join(f"w{i}_{j}" for j in range(12)) for i in range(4)]
    got = list(fold(msgs("s", "\n\n".join(para)), Budget(size=25, overlap=0)))
    assert len(got) == 5 and all(c[6] <= 25 for c in got)
    assert "id=1a role=USER part=1/4 original_id=1" in got[1][2]
    assert [p for c in got[1:] for p in para if p in c[2]] == para


def test_message_over_budget_stands_alone():
    got = list(fold(msgs("s", "x " * 90, "y"), Budget(size=30, overlap=0)))
    assert len(got) == 3 and got[1][6] > 30 and got[1][3] == got[1][4] == "1"
    with pytest.raises(ValueError):
        list(fold(msgs("s", "a b c d e"), Budget(size=2)))


def test_no_messages_and_summary():
    (only,) = fold(msgs(None), Budget(), "about")
    assert only[2] == "[TICKET_SUMMARY] about\n\n[INITIAL_DESCRIPTION]\n" and only[8] is only[9] is None


def test_rows_like_the_fold(spark):
    rng = random.Random(3)
    rows = [(k, i, "USER", " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 30))) or None, "x") for k in [*range(40), None] for i in range(rng.randint(1, 12))]
    mixed = rng.sample(rows, len(rows))
    df = spark.createDataFrame(mixed, "conv long, turn int, role string, text string, chunk_text string")
    b = Budget(size=60, overlap=5)
    want = []
    for k in {r[0] for r in rows}:
        want += [(k, *map(str, c)) for c in fold(iter([(str(r[1]), r[2], r[3]) for r in rows if r[0] == k]), b)]
    got = [(r.conv, *map(str, list(r)[1:])) for r in pack_turns(df, "conv", "turn", "role", "text", b).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert not pack_turns(df.limit(0), "conv", "turn", "role", "text", b).collect()
    assert words("a  b\n") == 2
