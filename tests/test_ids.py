"""Numbered ids past their padding."""

from evidra.plans.registry import QUERIES


def test_turn_10000(spark, tmp_path):
    rows = [(7, t, "user", f"t{t}") for t in (0, 1000, 9999, 10000, 10001, 123456)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.message_id for r in QUERIES["message_ids"](spark, str(tmp_path)).collect()}
    assert got == {t: f"7::msg::{t:04d}" for _, t, _, _ in rows}
    (r,) = QUERIES["transcript"](spark, str(tmp_path)).collect()
    assert r.transcript == " ".join(f"<MESSAGE id={t:04d} role=user>{x}</MESSAGE>" for _, t, _, x in rows)


def test_1001_addresses(spark, tmp_path):
    text = " ".join(f"u{i}@example.org" for i in range(1, 1002))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.value: r.alias for r in QUERIES["pii_aliases"](spark, str(tmp_path)).collect()}
    assert got == {f"u{i}@example.org": f"EMAIL_{i:03d}" for i in range(1, 1002)}
