import json

from evidra.sources import files
from evidra.sources.store import Versions
from evidra.streaming import streams as S


def test_feedback_like_batch(spark, tmp_path):
    (tmp_path / "log").mkdir()
    rows = [{"scenario_id": "s", "helpful": "yes", "grounded": "no"}, {"helpful": "no", "grounded": "yes", "failure_type": "f"}, {"scenario_id": "", "helpful": "yes"}]
    (tmp_path / "log" / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "", "{bad", "[1]"]) + "\n")
    got = S.run_to_end(S.feedback_stream(spark, str(tmp_path / "log")), f"file://{tmp_path}/s").collect()
    batch = S.feedback_counts(files.read_feedback(spark, str(tmp_path / "log"), S.FEEDBACK)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch)) == [("ad_hoc", "f", 1, 0, 1), ("ad_hoc", "none", 1, 1, 0), ("s", "none", 1, 1, 0)]


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "id string, v long"
    stores = {n: (f"file://{tmp_path}/{n}", (lambda b, k=k: b.where(f"v >= {k}"))) for n, k in (("all", 0), ("some", 2))}
    run = lambda at: S.ingest(spark.readStream.schema(schema).json(str(folder)), stores, "id", "v", f"file://{tmp_path}/{at}").awaitTermination()
    (folder / "1.json").write_text('{"id": "a", "v": 1}\n{"id": "b", "v": 2}\n')
    run("cp")
    (folder / "2.json").write_text('{"id": "a", "v": 3}\n{"id": "a", "v": 3}\n')
    run("cp")
    read = lambda n: sorted(map(tuple, Versions(spark, f"file://{tmp_path}/{n}").read().collect()))
    assert read("all") == read("some") == [("a", 3), ("b", 2)]
    run("again")  # a lost checkpoint: the same rows once more
    assert read("all") == [("a", 3), ("b", 2)]


def test_no_rows(spark, tmp_path):
    (tmp_path / "log").mkdir()
    assert not S.run_to_end(S.feedback_stream(spark, str(tmp_path / "log")), f"file://{tmp_path}/s").collect()


def test_late_events_are_dropped(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: {(r.window_start[:10], r.event_type): (r.n_events, r.sum_value) for r in S.run_updates(S.event_windows(spark.readStream.schema("ts string, event_type string, value double").json(str(folder))), ["window_start", "event_type"], f"file://{tmp_path}/s").collect()}
    (folder / "1.json").write_text('{"ts": "2024-01-01 10:00:00", "event_type": "a", "value": 1}\n{"ts": "2024-01-10 10:00:00", "event_type": "a", "value": 2}\n')
    assert run() == {("2024-01-01", "a"): (1, 1.0), ("2024-01-10", "a"): (1, 2.0)}
    (folder / "2.json").write_text('{"ts": "2024-01-01 11:00:00", "event_type": "a", "value": 5}\n{"ts": "2024-01-10 09:00:00", "event_type": "a", "value": 3}\n{"ts": "2024-01-10 09:00:00", "event_type": "b", "value": 4}\n')
    assert run() == {("2024-01-01", "a"): (1, 1.0), ("2024-01-10", "a"): (2, 5.0), ("2024-01-10", "b"): (1, 4.0)}
