from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import canonical_record
from plumbline.operators import profile
from plumbline.sources import exports, files, readers, receipts, versions


def write(path, text):
    path.write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
    return str(path)


def rows(table):
    return [tuple(r) for r in table.frame.orderBy("ordinal").select(*table.ids).collect()]


def test_duplicate_headers_are_kept(spark, tmp_path):
    t = readers.read_source(spark, write(tmp_path / "a.csv", "id,value,value\n1,=SUM(A1),@literal\n1,=SUM(A1),@literal\n"))
    assert rows(t) == [("1", "=SUM(A1)", "@literal")] * 2
    assert [c[3] for c in t.columns] == [False, True, True] and len(set(t.ids)) == 3
    assert t.header_decision == "EXPLICIT_DUPLICATE_PRESERVED"
    codes = {r["code"] for r in profile.anomalies(t.content(), names=t.names).collect()}
    assert codes == {"DUPLICATE_HEADERS_PRESERVED", "EXACT_DUPLICATE_ROWS", "FORMULA_LIKE_TEXT_PRESERVED", "NO_CANDIDATE_KEY"}


def test_case_collision(spark, tmp_path):
    t = readers.read_source(spark, write(tmp_path / "a.csv", "ID,id\n1,2\n"))
    assert "CASE_COLLISION_HEADERS" in {r["code"] for r in profile.anomalies(t.content(), names=t.names).collect()}


@pytest.mark.parametrize("name,text", [
    ("a.tsv", "id\tvalue\n1\ta\n2\tb\n"), ("a.json", '[{"id":1,"value":"a"},{"id":2,"value":"b"}]'),
    ("a.jsonl", '{"id":1,"value":"a"}\n\n{"id":2,"value":"b"}\n'), ("a.txt", "one\ntwo\n"), ("a.md", "# Heading\nBody\n")])
def test_formats_have_two_records(spark, tmp_path, name, text):
    t = readers.read_source(spark, write(tmp_path / name, text))
    assert t.frame.count() == 2 and [r[0] for r in t.frame.select("ordinal").orderBy("ordinal").collect()][0] in (0,)


@pytest.mark.parametrize("name,text,budget,code", [
    ("a.csv", "a,b\n1\n", {}, "DATA_ROW_WIDTH_MISMATCH"), ("a.csv", "a,b\n1,2,3\n", {}, "DATA_ROW_WIDTH_MISMATCH"),
    ("a.json", '[{"id":1,"id":2}]', {}, "DATA_DUPLICATE_JSON_KEY"), ("a.json", '[{"a":{"b":{"c":1}}}]', {"max_depth": 2}, "DATA_NESTING_BUDGET"),
    ("a.csv", "a\n12345\n", {"max_field_bytes": 4}, "DATA_FIELD_BUDGET"), ("a.json", '[{"a":12345}]', {"max_field_bytes": 4}, "DATA_NUMERIC_TOKEN_BUDGET"),
    ("a.csv", '[{"a":1}]', {}, "DATA_FORMAT_SPOOFED"), ("a.jsonl", '{"a":NaN}\n', {}, "DATA_JSON_CONSTANT_REFUSED"),
    ("a.jsonl", "[1]\n", {}, "DATA_JSONL_SHAPE"), ("a.json", "3", {}, "DATA_JSON_SHAPE"), ("a.json", "{oops", {}, "DATA_PARSE_ERROR"),
    ("a.csv", "a,\n1,2\n", {}, "DATA_EMPTY_HEADER"), ("a.csv", b"a\n\xff\xfe\n", {}, "DATA_ENCODING"), ("a.xyz", "a", {}, "DATA_FORMAT_UNSUPPORTED"),
    ("a.csv", 'a,b\n"x"y,2\n', {}, "DATA_PARSE_ERROR"), ("a.csv", "", {}, "DATA_NO_HEADER")])
def test_refusals(spark, tmp_path, name, text, budget, code):
    with pytest.raises(Refusal) as caught:
        readers.read_source(spark, write(tmp_path / name, text), budget=readers.Budget(**budget))
    assert caught.value.code == code


def test_quotes_newlines_and_order(spark, tmp_path):
    t = readers.read_source(spark, write(tmp_path / "a.csv", '﻿id,note\n1,"a ""b"" c"\n2,"two\nlines"\n3,\n'))
    assert t.names == ["id", "note"]
    assert rows(t) == [("1", 'a "b" c'), ("2", "two\nlines"), ("3", "")]


def test_json_union_keeps_absent_apart(spark, tmp_path):
    t = readers.read_json_lines(spark, write(tmp_path / "a.jsonl", '{"b":null}\n{"a":1.5,"b":"x"}\n'))
    assert t.names == ["a", "b"]
    assert [r[0] for r in t.frame.orderBy("ordinal").select("present_keys").collect()] == [["b"], ["a", "b"]]


def test_canonical_bytes(spark):
    frame = spark.createDataFrame([("é\"\\\n\x1f", 1, 900.0, True, None, 1e16, 1e-5, 123456789.125)], "s string, i int, d double, b boolean, n string, x double, y double, z double")
    assert frame.select(canonical_record(frame)).first()[0] == (
        '{"b":true,"d":900.0,"i":1,"n":null,"s":"é\\"\\\\\\n\\u001f","x":1e+16,"y":1e-05,"z":123456789.125}\n')


def test_annotations(spark):
    columns = [("col-1", "mass"), ("col-2", "id")]
    a = profile.annotations(spark, columns, ["mass=kg", "mass=g"], ["id=specimen identifier"])
    assert a.count() == 3 and profile.annotation_conflicts(a).count() == 1
    for bad in ("mass", "nope=kg"):
        with pytest.raises(Refusal):
            profile.annotations(spark, columns, [bad])


def test_inventory_and_intake(spark, tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    write(root / "a.csv", "x\n1\n")
    write(root / "sub" / "secrets.txt", "s")
    write(root / "b.bin", b"\x00\xff")
    manifest = files.inventory(spark, str(root))
    got = {r["relative_path"]: r for r in manifest.collect()}
    assert set(got) == {"a.csv", "sub/secrets.txt", "b.bin"} and got["a.csv"]["media_type"] == "text/csv" and not got["b.bin"]["is_utf8"]
    facts = files.preflight(manifest, "/home/x/OneDrive/p").first()
    assert (facts["file_count"], facts["sensitive_files"], facts["supported_files"], facts["sync_markers"]) == (3, 1, 2, ["onedrive"])
    empty = spark.createDataFrame([], files.LEDGER_SCHEMA)
    ledger = spark.createDataFrame(files.seal_intake(manifest, empty).collect(), files.LEDGER_SCHEMA)
    assert ledger.count() == 3 and files.seal_intake(manifest, ledger).count() == 0
    assert files.intake_errors(ledger, manifest).count() == 0
    write(root / "a.csv", "x\n2\n")
    changed = files.inventory(spark, str(root))
    assert {r["problem"] for r in files.intake_errors(ledger, changed).collect()} == {"BYTES_CHANGED"}
    with pytest.raises(Refusal) as caught:
        files.seal_intake(changed, ledger)
    assert caught.value.code == "IMPORT_SOURCE_CHANGED"
    assert files.tree_digest(changed).first() != files.tree_digest(manifest.limit(2)).first()


def test_versions(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    a = readers.read_source(spark, write(tmp_path / "a.csv", "id,v\n1,a\n2,b\n"))
    b = readers.read_source(spark, write(tmp_path / "b.csv", "id,v\n2,b\n1,a\n"))
    first = store.publish(a.frame, "CSV", ["s1"])
    assert store.publish(a.frame, "CSV", ["s1"]) == first
    second = store.publish(b.frame, "CSV", ["s1"], parents=[first])
    one, two = store.manifest(first), store.manifest(second)
    assert one["records_sha256"] == two["records_sha256"] and one["order_sha256"] != two["order_sha256"] and first != second
    assert store.publish(a.frame, "CSV", ["s1"], annotations=["v=kg"]) != first
    assert store.verify_lineage(second).count() == 0
    index = store.build_index(first)
    assert versions.index_problems(index, store.load(first)).count() == 0
    wanted = store.load(first).first()["record_sha256"]
    assert store.lookup(first, [wanted]).count() == 1
    path = store._path(first)
    tampered = store.load(first).withColumn(a.ids[1], F.lit("zz")).collect()
    spark.createDataFrame(tampered, store.load(first).schema).write.mode("overwrite").parquet(path)
    assert {"RECORD_HASH", "RECORDS_DIGEST", "PROFILE"} <= {r["problem"] for r in store.verify(first).collect()}
    assert {r["snapshot_id"] for r in store.verify_lineage(second).collect()} == {first}
    for snapshot in ("snap-none", first):
        with pytest.raises(Refusal):
            store.load(snapshot)


def test_two_writers_of_one_version(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    frame = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal long, id string")
    with ThreadPoolExecutor(4) as pool:
        names = set(pool.map(lambda _: store.publish(frame, "CSV", ["s"]), range(4)))
    assert len(names) == 1 and store.manifests().count() == 1
    folders = [p.name for p in (tmp_path / "store" / "records").iterdir()]
    assert len(folders) == 1 and store.load(names.pop()).count() == 2
    empty = store.publish(frame.limit(0), "CSV")
    assert store.verify(empty).count() == 0


def test_reconciled_versions_are_verified_with_their_ledger(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    schema = "ordinal long, id string, v string"
    left = store.publish(spark.createDataFrame([(0, "1", "a"), (1, "2", "b"), (2, "3", "c"), (3, "4", "exact"), (4, "7", "x")], schema), "CSV", ["l"])
    right = store.publish(spark.createDataFrame([(0, "1", "a"), (1, "2", "b2"), (2, "4", "exact"), (3, "6", "new"), (4, "7", "y"), (5, "7", "z")], schema), "CSV", ["r"])
    both = store.reconcile(left, right, ["id"])
    assert store.reconcile(left, right, ["id"]) == both and store.verify(both).count() == 0
    bound = store.manifest(both)
    assert (bound["parents"], bound["sources"], bound["record_count"], bound["key_columns"]) == ([left, right], ["l", "r"], 11, ["id"])
    assert [r["ordinal"] for r in store.load(both).orderBy("ordinal").collect()] == list(range(11))
    path = f"{store.root}/deltas/delta_sha256={bound['delta_sha256']}"
    ledger = spark.createDataFrame(spark.read.parquet(path).collect()[1:], spark.read.parquet(path).schema)
    ledger.write.mode("overwrite").parquet(path)
    assert {r["problem"] for r in store.verify(both).collect()} == {"DELTA_LEDGER"}
    with pytest.raises(Refusal) as caught:
        store.reconcile(left, right, ["none"])
    assert caught.value.code == "DATA_RECONCILIATION_KEY_INVALID"


def test_receipts_and_their_selection(spark, tmp_path):
    store = versions.VersionStore(spark, str(tmp_path / "store"))
    a = readers.read_source(spark, write(tmp_path / "a.csv", "id,v\na,1\nb,2\n"))
    first, plan = store.publish(a.frame, "CSV", ["s1"]), write(tmp_path / "plan.md", "plan")
    assert receipts.status(store, first) == "NONE"
    spec = receipts.declare(store, first, [a.ids[0]], plan=plan)
    receipt = receipts.issue(store, spec)
    assert (receipt["decision"], receipt["passed_check_count"], receipt["required_check_count"]) == ("PASS", 22, 22)
    assert receipts.issue(store, spec)["receipt_sha256"] == receipt["receipt_sha256"] and receipts.receipts(store).count() == 1
    assert receipts.status(store, first) == "PASS"
    # Another receipt becomes the active one; a writer who has not seen it cannot select over it.
    repeated = receipts.issue(store, receipts.declare(store, first, [a.ids[1]]))
    assert receipts.status(store, first, receipt["receipt_sha256"]) == "STALE" and receipts.selection(store)[1] == repeated["receipt_sha256"]
    with pytest.raises(Refusal) as caught:
        receipts.select_receipt(store, receipt["receipt_sha256"], after=1)
    assert caught.value.code == "READINESS_SELECTION_CHANGED"
    receipts.select_receipt(store, receipt["receipt_sha256"])
    second = store.publish(a.frame, "CSV", ["s2"])
    assert receipts.status(store, second) == "STALE"
    write(tmp_path / "plan.md", "another plan")
    assert receipts.status(store, first) == "STALE"
    write(tmp_path / "plan.md", "plan")
    path = tmp_path / "store" / "receipts" / f"{receipt['receipt_sha256']}.json"
    kept = path.read_text()
    path.with_name(f".{path.name}.crc").unlink()  # the local file system keeps a checksum of its own
    path.write_text(kept.replace('"PASS"', '"FAIL"', 1))
    assert receipts.status(store, first) == "TAMPERED"
    path.write_text(kept)
    rows_ = store.load(first).withColumn(a.ids[1], F.lit("9")).collect()
    spark.createDataFrame(rows_, store.load(first).schema).write.mode("overwrite").parquet(store._path(first))
    assert receipts.status(store, first) == "TAMPERED"


def test_checkpoint_rows(spark):
    store = spark.createDataFrame([("gen-1", "a")], "checkpoint_id string, body string")
    assert versions.append_checkpoints(store, spark.createDataFrame([("gen-1", "a"), ("gen-2", "b")], store.schema)).count() == 1
    with pytest.raises(Refusal):
        versions.append_checkpoints(store, spark.createDataFrame([("gen-1", "x")], store.schema))


def test_exports(spark, tmp_path):
    rows_ = spark.createDataFrame([("=1+1", ["a", "b"])], "note string, tags array<string>")
    exports.write_csv(rows_, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()[:] == ("'=1+1", "a; b")
    exports.write_checksums(spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string"), str(tmp_path / "sums"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "sums")).collect()] == ["1  a", "2  b"]
    ledger = spark.createDataFrame([("LEFT", 1)], "side string, ordinal long")
    assert exports.write_delta_ledger(ledger, str(tmp_path / "d")) == exports.write_delta_ledger(ledger, str(tmp_path / "d"))


def test_file_lane(spark, tmp_path):
    from plumbline.operators import readiness

    path = write(tmp_path / "v1.csv", "id,group,value\na,g1,10\nb,g1,20\nc,g2,30\n")
    first = readiness.readiness_decision(readers.file_readiness(spark, path, ["id"])).first()
    assert (first["decision"], first["passed"]) == ("PASS", 22)
    assert readiness.readiness_decision(readers.file_readiness(spark, path, ["group"])).first()["decision"] == "FAIL"
    doubled = write(tmp_path / "d.csv", "id,id\n1,2\n")
    with pytest.raises(Refusal) as caught:
        readers.file_readiness(spark, doubled, ["id"])
    assert caught.value.code == "READINESS_COLUMN_AMBIGUOUS"
    cid = readers.read_source(spark, doubled).ids[1]
    assert readiness.readiness_decision(readers.file_readiness(spark, doubled, [cid])).first()["decision"] == "PASS"


def test_many_files_keep_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name in "abc":
        write(folder / f"{name}.csv", "id\n" + "".join(f"{name}{i:03d}\n" for i in range(40)))
    t = readers.read_delimited(spark, str(folder))
    got = [r[0] for r in t.frame.orderBy("ordinal").select(t.ids[0]).collect()]
    assert got == sorted(got) and len(got) == 120
    assert [r[0] for r in t.frame.select("ordinal").orderBy("ordinal").collect()] == list(range(120))
