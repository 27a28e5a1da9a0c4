import json

import pytest
from __spark_entry__ import queries
from pyspark.sql import functions as F

from helpers import LONG, rows, verdict
from labelloom.model import VerdictSchema
from labelloom.operators.intake import auto_recover, first_by, pending, validate_rows
from labelloom.sources.files import verdict_stream
from labelloom.streaming.ingest import absorb_batch, ingest_stream, read_accepted, read_quarantine, read_repeated
from labelloom.streaming.retract import recover

RULES = VerdictSchema(valid_qa=("yes", "no"))
ROW = "task_id string, qa string, reason string, schema_version string"


def test_validate_rows_reasons_and_edges(make):
    data = make(ROW, ("ok", "yes", "x" * 150, "v1"), ("edge", "yes", "x" * 149, "v1"), (None, "yes", LONG, "v1"),
                ("nul", "yes", None, "v1"), ("old", "maybe", "x", "v0"))
    ok, bad = validate_rows(data, RULES, "v1")
    assert rows(ok, "task_id") == [("ok",)]
    assert rows(bad, "task_id", "errors") == [
        ("edge", ["reason length"]), ("nul", ["missing reason"]), ("old", ["schema_version", "qa", "reason length"]),
        (None, ["missing task_id"])]


def test_a_required_field_without_column_is_missing(make):
    rules = VerdictSchema(required_fields=("task_id", "qa", "reason", "text"))
    ok, bad = validate_rows(make(ROW, ("t1", "yes", LONG, "v1")), rules, "v1")
    assert ok.count() == 0 and "text" not in bad.columns
    assert rows(bad, "errors") == [(["missing text"],)]


def test_first_by_keeps_the_first_row(make):
    data = make("k string, o int, v string", ("a", 2, "x"), ("a", 1, "y"), ("b", 5, None))
    assert rows(first_by(data, ["k"], ["o"])) == [("a", 1, "y"), ("b", 5, None)]


def test_first_by_with_map_payload(make):
    data = make("k string, o int, v map<string,string>", ("a", 2, {"x": "1"}), ("a", 1, {"y": "2"}))
    assert rows(first_by(data, ["k"], ["o"])) == [("a", 1, {"y": "2"})]


def test_pending_is_members_without_verdict(make):
    tasks = make("shard_id string, task_id string", ("a", "t1"), ("a", "t2"), ("b", "t1"))
    seen = make("shard_id string, task_id string", ("a", "t1"), ("a", "t1"), ("b", "zz"))
    assert rows(pending(tasks, seen, ["shard_id", "task_id"])) == [("a", "t2"), ("b", "t1")]
    assert rows(pending(tasks, seen.limit(0))) == rows(tasks.select("task_id", "shard_id"))


def test_auto_recover_drops_only_stuck_full_batches(make):
    stories = make("batch_idx bigint, attempts bigint, passes boolean", (1, 1, False), (2, 0, False), (3, 2, True), (4, 1, None))
    tasks = make("batch_idx bigint, task_id string", (1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"), (4, "f"))
    seen = make("task_id string, qa string", *[(t, "yes") for t in "aabcde"])
    kept, reset = auto_recover(stories, tasks, seen)
    assert rows(reset) == [(1,)]
    assert rows(kept, "task_id") == [("c",), ("d",), ("e",)]


# ---- stream ------------------------------------------------------------------


def lines(*records):
    return "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)


@pytest.fixture
def place(tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    return source, str(tmp_path / "sink"), str(tmp_path / "checkpoint")


def run(spark, place, stream_id="s", checkpoint=None):
    source, sink, default = place
    stream = verdict_stream(spark, str(source), RULES)
    ingest_stream(stream, sink, checkpoint or default, stream_id, RULES, "v1").awaitTermination()
    return sink


def test_stream_takes_each_id_once_and_keeps_bad_rows(spark, place):
    source, sink, _ = place
    (source / "f1.jsonl").write_text(lines(
        verdict("t1", reason="first " + LONG), verdict("t1", reason="second " + LONG), "", '{"task_id": "cut', {"__meta__": True},
        verdict(None), verdict(None), verdict("t2", reason=None), verdict("t3", version="v0"), verdict("t4", "maybe"),
        verdict("t5", reason="x" * 149), verdict("t6", reason="x" * 150)))
    run(spark, place)
    (source / "f2.jsonl").write_text(lines(verdict("t1", reason="third " + LONG), verdict("t7"), verdict("t2")))
    run(spark, place)
    got = read_accepted(spark, sink)
    assert rows(got, "task_id", "batch_id") == [("t1", 0), ("t2", 1), ("t6", 0), ("t7", 1)]
    assert got.where("task_id = 't1'").first().reason.startswith("first")
    assert "malformed" not in got.columns
    arrived = got.orderBy("batch_id", "src").collect()
    assert [r.task_id for r in arrived] == ["t1", "t6", "t7", "t2"]
    bad = read_quarantine(spark, sink)
    assert rows(bad, "task_id", "errors") == [
        ("t2", ["missing reason"]), ("t3", ["schema_version"]), ("t4", ["qa"]), ("t5", ["reason length"]),
        (None, ["malformed"]), (None, ["missing task_id"]), (None, ["missing task_id"])]
    assert bad.where("malformed IS NOT NULL").first().malformed == '{"task_id": "cut'
    run(spark, place)
    assert read_accepted(spark, sink).count() == 4 and read_quarantine(spark, sink).count() == 7


def test_second_stream_adds_only_new_ids(spark, place, tmp_path):
    source, sink, _ = place
    (source / "f1.jsonl").write_text(lines(*[verdict(f"t{i}") for i in range(5)]))
    run(spark, place)
    (source / "f2.jsonl").write_text(lines(*[verdict(f"t{i}") for i in range(3, 8)]))
    run(spark, place, "again", str(tmp_path / "other"))
    assert rows(read_accepted(spark, sink), "task_id", "stream_id") == [
        (f"t{i}", "s" if i < 5 else "again") for i in range(8)]


def test_replayed_batch_ends_in_the_same_tables(spark, make, tmp_path):
    sink = str(tmp_path / "sink")
    first = make(ROW, ("t1", "yes", LONG, "v1"), ("t2", "yes", LONG, "v1"))
    second = make(ROW, ("t2", "yes", LONG, "v1"), ("t3", "yes", LONG, "v1"), ("t4", "bad", LONG, "v1"))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        absorb_batch(batch, number, sink, "s", RULES, "v1")
    assert rows(read_accepted(spark, sink), "task_id", "batch_id") == [("t1", 0), ("t2", 0), ("t3", 1)]
    assert read_quarantine(spark, sink).count() == 1


def test_crash_between_the_two_writes_is_healed(spark, place, monkeypatch):
    from labelloom.streaming import ingest

    source, sink, _ = place
    (source / "f1.jsonl").write_text(lines(verdict("t1"), verdict("t2", "maybe")))
    whole = ingest.first_by

    def crash(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ingest, "first_by", crash)
    with pytest.raises(Exception):
        run(spark, place)
    monkeypatch.setattr(ingest, "first_by", whole)
    run(spark, place)
    assert rows(read_accepted(spark, sink), "task_id") == [("t1",)]
    assert read_quarantine(spark, sink).count() == 1


def test_accepted_rows_carry_the_reason_length(spark, make, tmp_path):
    absorb_batch(make(ROW, ("t1", "yes", LONG, "v1")), 0, str(tmp_path / "s"), "s", RULES, "v1")
    assert rows(read_accepted(spark, str(tmp_path / "s")).withColumn("n", F.col("reason_chars")), "n") == [(200,)]


# ---- index, repeats, types ------------------------------------------------------


def take(make, sink, number, *ids, stream="s"):
    absorb_batch(make(ROW, *[(i, "yes", f"{number} " + LONG, "v1") for i in ids]), number, sink, stream, RULES, "v1")


def test_only_parts_that_may_hold_an_id_are_read(spark, make, tmp_path):
    from labelloom.streaming import ids

    sink = str(tmp_path / "sink")
    for number in range(4):
        take(make, sink, number, *[f"{number}-{k}" for k in range(60)])
    asked = make("task_id string", ("2-7",), ("new",))
    parts = ids.parts_that_may_hold(asked, sink, "task_id").collect()
    assert len(parts) < 4 and any(p.batch_id == 2 for p in parts)
    read = ids.ids_of_parts(spark, sink, parts, asked.schema["task_id"])
    buckets = {p.bucket for p in ids._hashed(asked, "task_id").collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read.inputFiles()} <= buckets
    assert rows(ids.known_ids(asked, sink, "task_id", f"{sink}/accepted", "s", 9)) == [("2-7", "s", 2)]
    assert ids.known_ids(asked, sink, "task_id", f"{sink}/accepted", "s", 2) is None  # a part is not compared with itself


def test_no_indexed_id_is_ever_overlooked(spark, make, tmp_path):
    from labelloom.streaming import ids

    sink = str(tmp_path / "sink")
    for number, n in enumerate((1, 3, 500, 64)):
        take(make, sink, number, *[f"{number}-{k}" for k in range(n)])
    every = read_accepted(spark, sink).select("task_id")
    assert ids.known_ids(every, sink, "task_id", f"{sink}/accepted", "other", 0).count() == 568


def test_repeats_are_kept_apart(spark, make, tmp_path):
    sink = str(tmp_path / "sink")
    for _ in range(2):
        take(make, sink, 0, "a", "b", "a")
        take(make, sink, 1, "b", "c", "c", "a")
    assert rows(read_accepted(spark, sink), "task_id", "batch_id") == [("a", 0), ("b", 0), ("c", 1)]
    again = read_repeated(spark, sink)
    assert rows(again, "task_id", "batch_id", "errors") == [("a", 0, ["repeated"]), ("a", 1, ["repeated"]), ("b", 1, ["repeated"]), ("c", 1, ["repeated"])]
    assert rows(again.where("batch_id = 1 AND task_id = 'a'"), "reason") == [("1 " + LONG,)]


def test_ids_of_a_run_that_was_cut_short_do_not_count(spark, make, tmp_path, monkeypatch):
    from labelloom.streaming import ids

    sink = str(tmp_path / "sink")
    take(make, sink, 0, "a")
    whole = ids.add_part

    def cut(*args):
        whole(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(ids, "add_part", cut)
    with pytest.raises(RuntimeError):
        take(make, sink, 1, "b")
    monkeypatch.setattr(ids, "add_part", whole)
    take(make, sink, 0, "b", "c", stream="other")
    assert rows(read_accepted(spark, sink), "task_id", "stream_id") == [("a", "s"), ("b", "other"), ("c", "other")]


def test_whole_rows_are_written_once_and_never_kept_in_memory(spark, make, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    sink, kept, keep = str(tmp_path / "sink"), [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda df, *level: kept.append(df.columns) or keep(df, *level))
    take(make, sink, 0, "a", "b", "a")
    take(make, sink, 1, "b", "c")
    assert kept and not [c for c in kept if "reason" in c]
    assert rows(read_accepted(spark, sink), "task_id", "batch_id", "reason") == [
        ("a", 0, "0 " + LONG), ("b", 0, "0 " + LONG), ("c", 1, "1 " + LONG)]
    assert rows(read_repeated(spark, sink), "task_id", "batch_id") == [("a", 0), ("b", 1)]
    assert not (tmp_path / "sink" / "incoming" / "stream_id=s" / "batch_id=1").exists()


def test_a_sink_without_index_gets_one(spark, make, tmp_path):
    import shutil

    sink = str(tmp_path / "sink")
    take(make, sink, 0, "a", "b")
    shutil.rmtree(f"{sink}/index")
    take(make, sink, 1, "b", "c")
    assert rows(read_accepted(spark, sink), "task_id", "batch_id") == [("a", 0), ("b", 0), ("c", 1)]


def test_a_reason_that_is_no_text_is_missing(spark, place):
    source, sink, _ = place
    number, nested = json.dumps({"text": LONG}), "[" + ", ".join(["1"] * 100) + "]"
    row = '{"task_id": "%s", "qa": "yes", "schema_version": "v1", "reason": %s}'
    (source / "f.jsonl").write_text("\n".join([
        row % ("t1", json.dumps("5" * 200)), row % ("t2", "5" * 200), row % ("t3", number), row % ("t4", nested),
        row % ("t5", json.dumps(nested)), row % ("t6", json.dumps("true " + LONG)), row % ("t7", "true"), row % ("t8", json.dumps(LONG))]) + "\n")
    run(spark, place)
    assert rows(read_accepted(spark, sink), "task_id") == [("t1",), ("t5",), ("t6",), ("t8",)]
    assert rows(read_quarantine(spark, sink), "task_id", "errors") == [(t, ["missing reason"]) for t in ("t2", "t3", "t4", "t7")]


def test_a_numeric_stream_name_stays_text(spark, make, tmp_path):
    sink = str(tmp_path / "sink")
    take(make, sink, 0, "a", stream="0042")
    assert rows(read_accepted(spark, sink), "stream_id", "batch_id") == [("0042", 0)]


# ---- retraction -----------------------------------------------------------------


def test_recovered_batches_are_done_again(spark, make, tmp_path):
    sink = str(tmp_path / "sink")
    take(make, sink, 0, "a", "b", "c")
    take(make, sink, 1, "d", "e")
    stories = make("batch_idx bigint, attempts bigint, passes boolean", (1, 1, False), (2, 0, False), (3, 2, False))
    tasks = make("batch_idx bigint, task_id string", (1, "a"), (1, "d"), (2, "b"), (3, "c"), (3, "zz"))

    def again():
        return rows(recover(read_accepted(spark, sink), sink, stories, tasks))

    assert again() == [(1, 2)]  # batch 2 was not tried, batch 3 is not fully seen
    assert rows(read_accepted(spark, sink), "task_id") == [("b",), ("c",), ("e",)]
    assert rows(pending(tasks, read_accepted(spark, sink)), "task_id") == [("a",), ("d",), ("zz",)]
    assert again() == []
    take(make, sink, 2, "a", "b", "d")
    assert rows(read_accepted(spark, sink), "task_id", "batch_id") == [("a", 2), ("b", 0), ("c", 0), ("d", 2), ("e", 1)]
    take(make, sink, 2, "a", "b", "d")  # a replay after the retraction ends in the same rows
    take(make, sink, 0, "a", stream="later")
    assert rows(read_accepted(spark, sink), "task_id", "stream_id", "batch_id")[0] == ("a", "s", 2)
    assert again() == [(1, 2)]  # taken back a second time, also from the later micro-batch
    take(make, sink, 1, "a", stream="later")
    assert rows(read_accepted(spark, sink).where("task_id = 'a'"), "stream_id", "batch_id") == [("later", 1)]


def test_a_retraction_is_written_whole_or_not_at_all(spark, make, tmp_path, monkeypatch):
    from labelloom.streaming import retract

    sink = str(tmp_path / "sink")
    take(make, sink, 0, "a")
    stories = make("batch_idx bigint, attempts bigint, passes boolean", (1, 1, False))
    tasks = make("batch_idx bigint, task_id string", (1, "a"))

    def cut(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(retract, "swap_in", cut)
    with pytest.raises(RuntimeError):
        recover(read_accepted(spark, sink), sink, stories, tasks)
    assert rows(read_accepted(spark, sink), "task_id") == [("a",)]


def test_stream_of_a_table_in_many_files(spark, tmp_path):
    tables = tmp_path / "tables"
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("w"), (F.col("id") % 50).cast("string")), 100).alias("text"),
        F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.repartition(5).write.parquet(str(tables / "documents.parquet"))
    spark.range(60).selectExpr("id doc_id", "1 quality", "0 toxic").write.parquet(str(tables / "labels.parquet"))
    got = queries()["ingest_stream"](spark, str(tables)).select("seq").collect()
    assert sorted(r.seq for r in got) == list(range(50))
