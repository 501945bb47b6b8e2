"""Long values, many files, odd keys, repeated rows and depth: what once broke or was cut."""

import pytest

from plumbline.errors import Refusal
from plumbline.operators import integrity, text
from plumbline.operators.profile import sampled_datetime_ratio, sampled_unique_ratio
from plumbline.plans.stream_queries import checked_chains, stream_daily_readiness, stream_intake
from plumbline.sources import readers
from plumbline.sources.versions import append_checkpoints

LONG = 1 << 20


def _write(folder, **files):
    folder.mkdir()
    for name, body in files.items():
        (folder / name.replace("_", ".")).write_text(body, encoding="utf-8")
    return str(folder)


def test_long_cells_and_strings(spark, tmp_path):
    cell, escapes = "x" * LONG, '""' * (LONG // 2)
    path = _write(tmp_path / "a", t_csv=f'id,"text"\n1,"{cell}"\n2,"{escapes}"\n')
    budget = readers.Budget(max_field_bytes=4 * LONG)
    rows = readers.read_delimited(spark, path, budget=budget).frame.collect()
    assert sorted(len(r[1]) for r in rows) == [LONG // 2, LONG]
    quoted = "\\n" * (LONG // 2)
    path = _write(tmp_path / "b", t_jsonl=f'{{"a": "{quoted}"}}\n{{"a": "{cell}"}}\n')
    assert readers.read_json_lines(spark, path, budget=budget).frame.count() == 2


def test_every_file_has_the_same_header(spark, tmp_path):
    good = _write(tmp_path / "a", a_csv="id,v\n1,a\n", b_csv="﻿id,v\n2,b\n", c_csv="id,v\n3,c\n")
    assert readers.read_delimited(spark, good).frame.count() == 3
    for n, other in enumerate(("2,b\n", "v,id\n2,b\n")):
        with pytest.raises(Refusal) as error:
            readers.read_delimited(spark, _write(tmp_path / f"bad{n}", a_csv="id,v\n1,a\n", b_csv=other))
        assert error.value.code == "DATA_HEADER_MISMATCH"


def test_headers_far_down_and_long(spark, tmp_path):
    path = _write(tmp_path / "a", t_csv="\n" * 70 + "id,v\n1,a\n")
    assert readers.read_delimited(spark, path).frame.count() == 1
    tall = "line\n" * 100
    table = readers.read_delimited(spark, _write(tmp_path / "b", t_csv=f'id,"{tall}"\n1,a\n'))
    assert table.names == ["id", tall] and table.frame.count() == 1


def test_loose_quotes_are_always_refused(spark, tmp_path):
    with pytest.raises(Refusal) as error:
        readers.read_delimited(spark, _write(tmp_path / "a", t_csv='a,b\n"two\nlines",1\n"x"y,2\n'))
    assert error.value.code == "DATA_PARSE_ERROR"


def test_keys_with_quotes(spark, tmp_path):
    path = _write(tmp_path / "a", t_jsonl='{"a\'b": 1, "c\\"d": 2}\n')
    (row,) = readers.read_json_lines(spark, path).frame.selectExpr("*").collect()
    assert len(row) == 4
    with pytest.raises(Refusal):
        readers.read_json_lines(spark, _write(tmp_path / "b", t_jsonl='{"a\'b\\"c": 1}\n'))


def test_repeated_sequence_keeps_a_right_successor(spark):
    zero = integrity.ZERO_HASH
    rows = [("c", 1, zero, "h1"), ("c", 2, "h1", "h2"), ("c", 2, "h1", "other"), ("c", 3, "h2", "h3"), ("c", 4, "no", "h4")]
    frame = spark.createDataFrame(rows, "chain string, sequence int, previous_event_sha256 string, event_sha256 string")
    assert sorted(map(tuple, integrity.chain_breaks(frame).collect())) == [("c", 2, "SEQUENCE_REPEATED"), ("c", 4, "PREVIOUS_HASH")]


def test_transform_break_across_a_gap(spark):
    steps = spark.createDataFrame([("c", 1, "a", "b"), ("c", 3, "x", "y"), ("c", 4, "y", "z"), ("d", 1, "q", "r")],
                                  "chain string, step_index int, input_sha256 string, output_sha256 string")
    assert [tuple(r) for r in integrity.transform_breaks(steps).collect()] == [("c", 1, "b", "x")]


def test_nodes_above_and_below_a_cycle_are_no_cycle(spark):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e")], "id string, depends_on string")
    assert sorted(map(tuple, integrity.dependency_problems(nodes, edges).collect())) == [
        ("b", "c", "CYCLE_DEPENDENCY"), ("c", "b", "CYCLE_DEPENDENCY")]


def test_deep_lineage(spark):
    edges = spark.createDataFrame([(n, n - 1) for n in range(1, 601)], "id long, parent_id long")
    rows = integrity.lineage_depths(edges).collect()
    assert all(r.settled and r.root_id == 0 and r.depth == r.id for r in rows) and len(rows) == 600


def test_shared_values_are_columns(spark):
    rows = [(1, "a#b", "c"), (2, "a", "b#c"), (3, "a#b", "c"), (4, "a", "b#c"), (5, "a", None)]
    frame = spark.createDataFrame(rows, "id int, artifact_path string, source_locator string")
    got = sorted((r.source, r.target, r.relationship) for r in integrity.lineage_edges(frame).collect())
    assert got == [(1, 3, "duplicate_locator"), (1, 3, "shared_artifact"), (2, 4, "duplicate_locator"), (2, 4, "shared_artifact"), (2, 5, "shared_artifact")]
    assert sum(r.pair_count for r in integrity.shared_lineage_groups(frame).collect()) == 1 + 1 + 1 + 3


def test_two_bodies_in_one_batch_collide(spark):
    schema = "checkpoint_id string, body string"
    with pytest.raises(Refusal) as error:
        append_checkpoints(spark.createDataFrame([], schema), spark.createDataFrame([("k", "a"), ("k", "b")], schema))
    assert error.value.code == "CHECKPOINT_COLLISION"


def test_profiles_look_at_all_rows(spark):
    frame = spark.range(200).selectExpr("id as n", "if(id < 30, 'x', '2024-01-02') as d", "id % 100 as k")
    assert sampled_datetime_ratio(frame, "n", ["d"]).first()["datetime_ratio"] == 0.85
    assert sampled_unique_ratio(frame, "n", ["k"]).first()["unique_ratio"] == 0.5


def test_all_questions_are_returned(spark):
    frame = spark.createDataFrame([("x",)], "q string").select(text.clarification_questions(text.F.col("q")).alias("ids"))
    assert "first-direct-evidence" in frame.first()["ids"]


def test_streams_over_folders_of_part_files(spark, tmp_path):
    spark.range(90).selectExpr("id as doc_id", "concat('t', id % 60) as text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert stream_intake(spark, str(tmp_path)).count() == 60
    days = "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, cast(id % 3 as int))"
    spark.range(90).selectExpr("id as event_id", f"{days} as ts", "id % 40 as user_id", "'click' as event_type", "1.0 as value").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    rows = stream_daily_readiness(spark, str(tmp_path)).collect()
    assert sorted(r.day for r in rows) == ["2024-01-01", "2024-01-02", "2024-01-03"] and sum(r.row_count for r in rows) == 90


def test_breaks_do_not_depend_on_micro_batches(spark, tmp_path):
    sequences = {"whole": range(1, 25), "gap": [n for n in range(1, 25) if n not in (1, 9)], "twice": [*range(1, 13), 5]}
    columns = "chain string, sequence long, previous_event_sha256 string, event_sha256 string, state string"
    parts = {n: [] for n in range(4)}  # each chain lies over all part files, the later events first
    for chain, listed in sequences.items():
        for n in sorted(listed, reverse=True):
            before = "0" * 64 if n == 1 else f"{chain}{n - 1}"
            parts[(25 - n) * 4 // 25].append((chain, n, before, f"{chain}{n}", "s"))
    for rows in parts.values():
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    found = checked_chains(spark, str(tmp_path), files_per_batch=1)
    assert sorted(map(tuple, found.collect())) == [("gap", 2, "SEQUENCE_GAP"), ("gap", 10, "SEQUENCE_GAP"), ("twice", 5, "SEQUENCE_REPEATED")]
