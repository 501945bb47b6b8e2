"""Files cut into many small ranges against the standard parsers on the whole file."""

import csv
import io
import json
import random

import pytest

from plumbline.errors import Refusal
from plumbline.sources import readers


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _cell(rng):
    return "".join(rng.choice(['a', 'é', '日', ',', '"', '\n', '\r\n', '\\', ' ', '{', '}', '""', '","', 'x"y', "line\nline\n"]) for _ in range(rng.choice([0, 1, 3, 12, 60])))


def test_quoted_line_breaks_over_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(8)
    (tmp_path / "many").mkdir()
    want = []
    for name in "ab":
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "note", "other"])
        for n in range(150):
            # A field that begins with another character may hold a quote as it is.
            row = [f"{name}{n}", _cell(rng), "long\n" * 700 if n == 75 else _cell(rng)]
            if n % 10 == 3:
                out.write(f'{row[0]},x"y,"z"\n')
                row[1:] = ['x"y', "z"]
            else:
                writer.writerow(row)
            want.append(tuple(row))
        (tmp_path / "many" / f"{name}.csv").write_text(out.getvalue(), encoding="utf-8", newline="")
    assert spark.read.text(str(tmp_path / "many")).rdd.getNumPartitions() >= 16
    table = readers.read_delimited(spark, str(tmp_path / "many"))
    got = table.frame.orderBy("ordinal").collect()
    assert [tuple(r)[:3] for r in got] == want and [r["ordinal"] for r in got] == list(range(len(want)))


def test_json_array_over_many_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    records = [{"id": n, "text": _cell(rng), "deep": {"list": [{"a": _cell(rng)}, [], {}]}} for n in range(200)]
    records[50]["text"] = "} ]\\\"" * 900
    for indent, name in ((None, "a"), (2, "b")):
        (tmp_path / f"{name}.json").write_text("\n " + json.dumps(records, indent=indent, ensure_ascii=indent is None) + "\n", encoding="utf-8")
        table = readers.read_json(spark, str(tmp_path / f"{name}.json"))
        got = table.frame.selectExpr("ordinal", "present_keys", *(f"to_json(`{c}`) as `{n}`" for c, n in zip(table.ids, table.names, strict=True))).orderBy("ordinal").collect()
        assert [r["ordinal"] for r in got] == list(range(200))
        assert [{n: json.loads(r[n]) for n in table.names} for r in got] == records


@pytest.mark.parametrize(("body", "code"), [
    ('[{"a":1},2]', "DATA_JSON_SHAPE"), ('[2,{"a":1}]', "DATA_JSON_SHAPE"), ('[{"a":1} {"a":2}]', "DATA_PARSE_ERROR"), ('[{"a":1}', "DATA_PARSE_ERROR"),
    ('[{"a":1}]]', "DATA_PARSE_ERROR"), ('[{"a":1}] {"b":2}', "DATA_PARSE_ERROR"), ('[{"a":"}', "DATA_PARSE_ERROR"), ("[]", "DATA_JSON_EMPTY_SCHEMA"),
    ('[{"a":1},[{"b":2}]]', "DATA_JSON_SHAPE"), ('[{"a":1,}]', "DATA_PARSE_ERROR"), ('[,{"a":1}]', "DATA_PARSE_ERROR")])
def test_what_stands_between_objects(spark, tmp_path, body, code):
    (tmp_path / "t.json").write_text(body)
    with pytest.raises(Refusal) as caught:
        readers.read_json(spark, str(tmp_path / "t.json"))
    assert caught.value.code == code


def test_unclosed_quotes_and_bad_bytes(spark, tmp_path, small_ranges):
    for n, (body, code) in enumerate([(b"a,b\n" + b"1,2\n" * 600 + b'3,"x\n', "DATA_PARSE_ERROR"), (b"a,b\n" + b"1,2\n" * 600 + b"3,\xff\n", "DATA_ENCODING"),
                                      (b"a,b\n" + b"1,2\n" * 600 + b"3\n", "DATA_ROW_WIDTH_MISMATCH")]):
        (tmp_path / f"{n}.csv").write_bytes(body)
        with pytest.raises(Refusal) as caught:
            readers.read_delimited(spark, str(tmp_path / f"{n}.csv"))
        assert caught.value.code == code
