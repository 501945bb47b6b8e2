"""Queries against their SQL on tables that the given ones do not show: more rows a task, values between the usual ones."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row

from check_oracle import rows_of
from plumbline import session
from plumbline.operators import integrity
from plumbline.operators.delta import delta_ledger
from plumbline.operators.gates import binding_digests
from plumbline.operators.integrity import ZERO_HASH, chain_breaks
from plumbline.operators.ordering import make_sort_spec, rebuilt_digest, runs_digest
from plumbline.operators.readiness import identity_runs, readiness_counts
from plumbline.operators.text import equal_statements, folded, near_duplicates, search
from plumbline.plans import ORACLES, QUERIES
from plumbline.plans.source_queries import customer_rows
from plumbline.session import TASK_ROWS, checkpoint_dir, tasks_for
from plumbline.streaming import streams
from plumbline.streaming.streams import ChainChecker


def same_as_sql(spark, folder, name, **tables):
    """Write the tables, given as SQL, and compare the query with its own SQL over them."""
    con = duckdb.connect()
    for table, sql in tables.items():
        path = f"{folder}/{table}.parquet"
        con.execute(f"copy ({sql}) to '{path}' (format parquet)")
        con.execute(f"create view {table} as select * from '{path}'")
    frame = QUERIES[name](spark, str(folder))
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(ORACLES[name])
    assert mine == rows_of([c[0] for c in result.description], result.fetchall())
    return mine[1]


def test_arrays_are_closed_in_their_own_file(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "json_roundtrip_events", events="""
        select i as event_id, i % 7 as user_id, 'click' as event_type, i / 4 as value, md5(i::varchar) || '"}]' as props from range(100000) t(i)""")
    assert len(rows) == 100000


def test_sample_sizes_between_none_and_one(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, "method_findings", customer="""
        select i as c_custkey, 'Customer#000000001' as c_name, 20::bigint as c_nationkey, i / 4.0::double as c_acctbal, 'AUTOMOBILE' as c_mktsegment
        from range(-4, 5) t(i)""")
    assert len(rows) == 5


def test_near_duplicates_store_no_grams(spark, tmp_path):
    con = duckdb.connect()
    sql = "select i as id, string_agg(md5((i * 97 + j)::varchar), ' ') as t from range(200) t(i), range(100) u(j) group by i"
    con.execute(f"copy ({sql}) to '{tmp_path}/t.parquet' (format parquet)")
    size = 200 * 100 * 33
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    assert near_duplicates(spark.read.parquet(f"{tmp_path}/t.parquet"), "id", "t").count() == 0
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet")) - before < 2.5 * size


def test_equal_statements_fold_each_text_once(spark):
    rows = spark.createDataFrame([(3, " Straße"), (1, "STRASSE"), (2, "other"), (4, " "), (5, None), (6, "strasse")], "id long, t string")
    pairs = equal_statements(rows, "id", "t")
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 3, 1.0), (1, 6, 1.0)]
    plan = pairs._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "MapInArrow" not in plan  # both uses read the stored digests


def test_readiness_shuffles_each_record_a_few_times(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select i as id, md5(i::varchar) as v from range(200000) t(i)) to '{tmp_path}/t.parquet' (format parquet)")
    frame = spark.read.parquet(f"{tmp_path}/t.parquet")
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    counts = readiness_counts(frame, make_sort_spec(frame, ["id"])).first()
    # The runs are stored once, with 32 bytes of hash; a second copy for the rebuild, or hashes as text, would take more.
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet")) - before < 200000 * 80
    assert counts["normalized_sha256"] == counts["rebuilt_sha256"] and counts["distinct_count"] == 200000


def test_a_changed_source_is_not_rebuilt(spark):
    rows = [(n, f"v{n % 50}") for n in range(300)]
    frame = spark.createDataFrame(rows, "id long, v string")
    spec = make_sort_spec(frame, ["id"])
    runs = identity_runs(frame, spec)
    first = runs_digest(runs).first()[0]
    assert rebuilt_digest(frame, spec, runs).first()[0] == first
    for other in (rows[1:], rows[:-1], [*rows, rows[7]], [*rows, (-5, "v")], [*rows[:-1], (299, "w")]):
        assert rebuilt_digest(spark.createDataFrame(other, "id long, v string"), spec, runs).first()[0] != first


def shuffled(spark):
    """Bytes that the session's stages have shuffled until now."""
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.length()))


def test_hashes_are_bytes_while_they_are_shuffled(spark):
    rows = 40000
    parts = spark.range(rows).selectExpr("id div 4 as project_id", "'A' as section", "id as item")
    before = shuffled(spark)
    binding_digests(parts).write.format("noop").mode("overwrite").save()
    assert shuffled(spark) - before < rows * 225
    sides = spark.range(rows).selectExpr("'LEFT' as side", "id as ordinal", "sha2(string(id), 256) as key_sha256", "sha2(string(-id), 256) as source_record_sha256")
    before = shuffled(spark)
    ledger = delta_ledger(sides)
    assert ledger.filter("key_sha256 = sha2(string(ordinal), 256) and source_record_sha256 = sha2(string(-ordinal), 256) and classification = 'ABSENT'").count() == rows
    assert shuffled(spark) - before < rows * 240


def test_chains_with_many_hashes_of_one_sequence(spark):
    rows = [("a", 1, ZERO_HASH, "h1")] + [("a", 2, "h1", f"x{n}") for n in range(5)] + [("a", 3, f"x{n}", f"y{n}") for n in range(5)] + [("a", 3, "x2a", "z"), ("a", 5, "q", "w")]
    events = spark.createDataFrame(rows, "chain string, sequence int, previous_event_sha256 string, event_sha256 string")
    found = sorted((r["sequence"], r["problem"]) for r in chain_breaks(events, tasks=3).collect())
    assert found == [(2, "SEQUENCE_REPEATED"), (3, "PREVIOUS_HASH"), (3, "SEQUENCE_REPEATED"), (5, "SEQUENCE_GAP")]


def test_tasks_grow_with_the_rows(spark):
    assert tasks_for(spark.range(100 * TASK_ROWS)) == 100 and tasks_for(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks of 100 rows, so that small tables take the ways of large ones."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    monkeypatch.setattr(integrity, "TASK_ROWS", 100)


_ORDERS = """select i as o_orderkey, i % 300 as o_custkey, substr('FOP', (i % 3 + 1)::int, 1) as o_orderstatus, i / 4.0 as o_totalprice,
    (i % 5 + 1) || case i % 5 when 0 then '-URGENT' else '-LOW' end as o_orderpriority from range(1500) t(i)"""
# A third of the lines cite one part and one supplier, and every ninth line has one order.
_LINES = """select case when i % 9 = 0 then 7 else i % 1400 end as l_orderkey, case when i % 3 = 0 then 5 else i % 350 end as l_partkey,
    case when i % 3 = 0 then 30 else i % 40 end as l_suppkey, (i % 7)::int as l_linenumber, substr('ANR', (i % 4 % 3 + 1)::int, 1) as l_returnflag,
    'O' as l_linestatus from range(6000) t(i)"""
_PARTS = "select i as p_partkey, (i % 50)::int as p_size, case when i % 2 = 0 then 'PROMO' else 'SMALL' end as p_type from range(400) t(i)"


def test_traces_take_more_tasks_with_more_rows(spark, tmp_path, small_tasks):
    for name, tasks in (("claim_traces", 3 * 60), ("trace_summary", 2 * 60 + 4 * 15)):
        same_as_sql(spark, tmp_path, name, orders=_ORDERS, lineitem=_LINES)
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= tasks


def test_references_take_more_tasks_with_more_rows(spark, tmp_path, small_tasks):
    tables = {"lineitem": _LINES, "nation": "select i as n_nationkey from range(25) t(i)", "customer": "select 2 * i as c_custkey from range(600) t(i)"}
    for name in ("structure_violations", "link_contract", "unknown_references", "duplicate_ids"):
        same_as_sql(spark, tmp_path, name, **tables)
        assert QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() >= 60


def test_claim_evidence_takes_more_tasks_with_more_rows(spark, tmp_path, small_tasks):
    for name in ("claim_evidence_findings", "gate_status"):
        same_as_sql(spark, tmp_path, name, orders=_ORDERS, lineitem=_LINES, part=_PARTS)
    assert QUERIES["claim_evidence_findings"](spark, str(tmp_path)).rdd.getNumPartitions() == 60


class _State:
    """State of one chain in memory, with the number of times that it was asked or changed."""

    def __init__(self):
        self.calls, self.head, self.pages = 0, None, {}

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return _Pages(self)

    def get(self):
        self.calls += 1
        return self.head

    def update(self, value):
        self.calls += 1
        self.head = value


class _Pages:
    def __init__(self, state):
        self.state = state

    def __getattr__(self, name):
        self.state.calls += 1
        pages = self.state.pages
        return {"containsKey": pages.__contains__, "getValue": pages.get, "updateValue": pages.__setitem__, "removeKey": pages.pop, "keys": lambda: list(pages)}[name]


def _chain_run(state, frames):
    checker = ChainChecker()
    checker.init(state)
    rows = [Row(chain="c", sequence=n, previous_event_sha256=b, event_sha256=h, state=s) for f in frames for n, b, h, s in f]
    return [tuple(r) for r in checker.handleInputRows(("c",), iter(rows), None)]


def test_waiting_events_take_few_calls_of_the_state():
    rows = [(n, f"h{n - 1}" if n > 1 else ZERO_HASH, f"h{n}", "s") for n in range(1, 51) if n not in (5, 30)]
    random.Random(1).shuffle(rows)
    state = _State()
    found = _chain_run(state, [rows]) + _chain_run(state, [[(None, None, None, None)]])
    assert found == [("c", 6, "SEQUENCE_GAP"), ("c", 31, "SEQUENCE_GAP")] and not state.pages
    assert state.calls < 20


def test_breaks_do_not_depend_on_frames_or_pages(monkeypatch):
    monkeypatch.setattr(streams, "FRAME", 100)
    lost = {1, 70, 71, 500, 901}
    rows = [(n, "x" if n % 97 == 0 else f"h{n - 1}", f"h{n}", "s") for n in range(1, 1000) if n not in lost]
    wanted = sorted([(n, "SEQUENCE_GAP") for n in (2, 72, 501, 902)] + [(n, "PREVIOUS_HASH") for n in range(97, 1000, 97)])
    random.Random(2).shuffle(rows)
    state, found = _State(), []
    for start in range(0, len(rows), 300):  # three frames a batch
        found += _chain_run(state, [rows[at:at + 100] for at in range(start, start + 300, 100) if rows[at:at + 100]])
    repeated = _chain_run(state, [rows[:3]])
    found += _chain_run(state, [[(None, None, None, None)]])
    assert sorted((n, p) for _, n, p in found) == wanted and not state.pages
    assert sorted(r[1] for r in repeated) == sorted(r[0] for r in rows[:3]) and {r[2] for r in repeated} == {"SEQUENCE_REPEATED"}


def test_search_folds_every_character_without_python_workers(spark):
    texts = ["".join(map(chr, range(at, at + 512))) for at in range(0, 0x110000, 512) if not 0xD800 <= at < 0xE000] + ["", "Stra\u00dfe", "\u0130\u03a3\ufb03 A"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert [r["f"] for r in rows.select("id", folded(rows["t"]).alias("f")).orderBy("id").collect()] == [t.casefold() for t in texts]
    found = search(rows, ["t"], "STRASSE")
    assert [r["t"] for r in found.collect()] == ["Stra\u00dfe"]
    plan = found._jdf.queryExecution().toString()
    assert "EvalPython" not in plan


def test_one_file_of_customers_is_published_on_all_cores(spark, tmp_path):
    duckdb.sql(f"copy (select i as c_custkey from range(50) t(i)) to '{tmp_path}/customer.parquet' (format parquet)")
    rows = customer_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.filter("ordinal = c_custkey").count() == 50
