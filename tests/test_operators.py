import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import record_hashes
from plumbline.functions.lexical import text_type
from plumbline.operators import (
    contracts, delta, digest, evidence, gates, integrity, ordering, projection, readiness, rules, text)


KNOWN = readiness.SourceFacts(verified=True, identity=True)


def statuses(frame, keys, source=KNOWN, **kw):
    spec = ordering.make_sort_spec(frame, keys, **kw)
    return readiness.readiness_checks(frame, spec, source)


def test_what_is_not_known_does_not_pass(spark):
    ok = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, value string")
    got = {r["check_id"] for r in statuses(ok, ["id"], readiness.SourceFacts()).collect() if r["status"] != "PASS"}
    assert got == {"source_identity", "independent_verification"}
    latin = ok.withColumn("value", F.concat("value", F.unhex(F.lit("E9")).cast("string")))
    failed = [r for r in statuses(latin, ["id"]).collect() if r["status"] != "PASS"]
    assert [(r["check_id"], r["evidence"]["invalid_text_rows"]) for r in failed] == [("encoding", "2")]


def test_readiness_fixtures(spark):
    ok = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, value string")
    checks = statuses(ok, ["id"])
    assert [r["check_id"] for r in checks.orderBy("position").collect()] == list(readiness.REQUIRED_CHECKS)
    assert readiness.readiness_decision(checks).first()["passed"] == 22
    readiness.require_ready(checks)
    dup = spark.createDataFrame([("a", "1"), ("a", "2")], ok.schema)
    assert readiness.readiness_decision(statuses(dup, ["id"])).first()["decision"] == "FAIL"
    exact = statuses(dup, ["id"], duplicate_policy="exact")
    assert readiness.readiness_decision(exact).first()["decision"] == "PASS"
    with pytest.raises(Refusal):
        readiness.require_ready(statuses(dup, ["id"]))
    empty = spark.createDataFrame([], ok.schema)
    got = {r["check_id"]: r["status"] for r in statuses(empty, ["id"]).collect()}
    assert got["row_reconciliation"] == "FAIL" and got["duplicate_handling"] == "PASS"
    nulls = spark.createDataFrame([(None, "1"), ("b", "2")], ok.schema)
    assert readiness.readiness_decision(statuses(nulls, ["id"], nulls="nulls_error")).first()["decision"] == "BLOCKED"
    assert readiness.readiness_decision(statuses(nulls, ["id"])).first()["decision"] == "PASS"


def test_sort_spec_refusals(spark):
    f = spark.createDataFrame([("a", "1")], "id string, value string")
    for kw, code in (({"keys": []}, "READINESS_AMBIGUOUS_IDENTITY"), ({"keys": ["id"], "duplicate_policy": "keep_first"}, "READINESS_INVALID_DUPLICATES"),
                     ({"keys": ["id"], "nulls": "x"}, "READINESS_INVALID_NULLS"), ({"keys": ["id"], "tie_break": ["id"]}, "READINESS_DUPLICATE_COLUMN"),
                     ({"keys": ["id"], "exclusions": ["x"]}, "READINESS_UNSUPPORTED_EXCLUSION"), ({"keys": ["nope"]}, "READINESS_COLUMN_AMBIGUOUS"),
                     ({"keys": ["id"], "normalization": ["trim"]}, "READINESS_UNSUPPORTED_NORMALIZATION")):
        with pytest.raises(Refusal) as caught:
            ordering.make_sort_spec(f, **kw)
        assert caught.value.code == code


def test_digests_do_not_depend_on_arrangement(spark):
    f = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 50).cast("string").alias("v"))
    spec = ordering.make_sort_spec(f, ["k"])
    a = digest.multiset_digest(record_hashes(f)).first()
    b = digest.multiset_digest(record_hashes(f.repartition(7, "v"))).first()
    assert a == b and a["row_count"] == 500
    assert ordering.normalised_digest(f, spec).first() == ordering.normalised_digest(f.repartition(5).orderBy(F.desc("v")), spec).first()
    placed = ordering.ordered_runs(f, spec).agg(F.sum("copies"), F.max(F.col("position") + F.col("copies"))).first()
    assert tuple(placed) == (500, 500)
    with pytest.raises(Exception, match="ORDINAL_NOT_UNIQUE"):
        digest.order_digest(spark.createDataFrame([(0, "a"), (0, "b")], "ordinal long, record_sha256 string")).collect()


LEFT = [(0, "1", "a"), (1, "2", "b"), (2, "3", "c"), (3, "4", "exact"), (4, "7", "x")]
RIGHT = [(0, "1", "a"), (1, "2", "b2"), (2, "4", "exact"), (3, "6", "new"), (4, "7", "y"), (5, "7", "z")]
SCHEMA = "ordinal long, id string, value string"


def test_delta_fixture(spark):
    left, right = spark.createDataFrame(LEFT, SCHEMA), spark.createDataFrame(RIGHT, SCHEMA)
    sides = delta.hashed_sides(left, right, ["id"], "ordinal")
    s = delta.delta_summary(sides).first()
    assert (s["exact_duplicate_count"], s["candidate_duplicate_count"], s["conflict_count"], s["preserved_conflict_count"], s["added_count"],
            s["absent_count"], s["modified_count"], s["unchanged_count"], s["unknown_count"]) == (2, 1, 2, 2, 1, 1, 1, 2, 1)
    ledger = delta.delta_ledger(sides)
    assert ledger.count() == 11 and contracts.delta_entry_violations(ledger).count() == 0
    assert delta.reconcile(left, right, ["id"], "ordinal").count() == 11
    back = delta.delta_summary(delta.hashed_sides(right, left, ["id"], "ordinal")).first()
    assert (back["added_count"], back["absent_count"]) == (s["absent_count"], s["added_count"])
    same = delta.delta_summary(delta.hashed_sides(left, left, ["id"], "ordinal")).first()
    assert same["unchanged_count"] == 5 and same["conflict_count"] == 0
    with pytest.raises(Refusal):
        delta.hashed_sides(left, right, ["nope"], "ordinal")


def test_one_sided_duplicates(spark):
    left = spark.createDataFrame([(0, "1", "a")], SCHEMA)
    right = spark.createDataFrame([(0, "2", "x"), (1, "2", "x"), (2, None, "n")], SCHEMA)
    s = delta.delta_summary(delta.hashed_sides(left, right, ["id"], "ordinal")).first()
    assert (s["candidate_duplicate_count"], s["added_count"], s["absent_count"], s["conflict_count"], s["missing_key_rows"], s["unknown_count"]) == (1, 0, 1, 0, 1, 2)


def test_value_types(spark):
    values = {"": "NULL", "+12": "INTEGER", "1.": "NUMBER", ".5e3": "NUMBER", "TRUE": "BOOLEAN", "2024-02-29": "DATETIME", "2023-02-29": "STRING",
              "2024-01-01T10:00:00Z": "DATETIME", "20240101T10": "DATETIME", "2024-W05-1": "DATETIME", "x-y": "STRING", "20240101": "INTEGER"}
    f = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r[0]: r[1] for r in f.select("v", text_type(F.col("v"))).collect()} == values


def test_drift_fixture(spark):
    original = "The treatment may not increase response outside group A."
    later = "The treatment proves response always increases in group A."
    f = spark.createDataFrame([(1, original, later), (2, original, original)], "id int, original string, later string")
    for exact in (True, False):
        got = {r["id"]: r["categories"] for r in text.drift(f, exact=exact).collect()}
        assert set(got[1]) == {"OMISSION", "CONTRADICTION", "OVERSTATEMENT", "UNRESOLVED_AMBIGUITY"} and got[2] == ["PRESERVED_MEANING"]
    wide = spark.createDataFrame([(1, "STRASSE ﬁne", "straße fine")], f.schema)
    assert text.drift(wide).first()["categories"] == ["PRESERVED_MEANING"]


def test_decisions(spark):
    letters = {"We are pleased to inform you that it is accepted.": "accepted", "Please revise and resubmit.": "revise_and_resubmit", "Desk reject.": "desk_rejection",
               "It needs a minor revision.": "minor_revision", "It is under review.": "under_review", "Not accepted.": "accepted", "Withdrawn by the author": "withdrawn", "Hello": "unknown"}
    f = spark.createDataFrame([(k,) for k in letters], "t string").withColumn("d", text.classify_decision(F.col("t")))
    assert {r["t"]: r["d"]["decision_class"] for r in f.collect()} == letters


def test_detector(spark):
    expected = spark.createDataFrame([(f"i{n}",) for n in range(24)], "issue_id string")
    seen = spark.createDataFrame([("d", f"i{n}") for n in range(23)] + [("d", "invented"), ("d", "i0")], "detector string, issue_id string")
    r = evidence.detector_scores(expected, seen).first()
    assert (r["true_positive_count"], r["false_positive_count"], r["false_negative_count"]) == (23, 1, 1)
    assert r["precision"] == pytest.approx(23 / 24) and r["recall"] == pytest.approx(23 / 24) and r["f1"] == pytest.approx(23 / 24)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd efghijklmn") for _ in range(rng.randint(10, 180))) for _ in range(25)]
    texts = list(base)
    for body in base:
        changed = list(body)
        for _ in range(max(1, len(body) // rng.choice((30, 60, 200)))):
            place = rng.randrange(len(changed))
            changed[place:place + 1] = rng.choice((["z"], [], ["q", changed[place]]))
        texts.append("".join(changed))
    texts += ["same boilerplate ending", "Same boilerplate ending", " ", "abc"]
    rows = list(enumerate(texts))
    rows += [(1000 + n, base[3] + " " * (n % 2)) for n in range(40)]  # copies of one text
    got = {r["right_id"]: (r["left_id"], r["ratio"], r["links"]) for r in text.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    first = {}
    for key, body in rows:
        first.setdefault(body.strip().casefold(), key)
    counted = {key: Counter(body[i:i + 3] for i in range(len(body) - 2)) for body, key in first.items() if len(body) >= 3}
    want = {}
    for a, b in itertools.combinations(sorted(counted), 2):
        value = 2 * (counted[a] & counted[b]).total() / (counted[a].total() + counted[b].total())
        if value >= 0.92:
            left, ratio, links = want.get(b, (a, value, 0))
            want[b] = (left, ratio, links + 1)
    assert got == want and len(want) > 3
    copies = text.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").filter("left_id = 3").first()
    assert copies is None or copies["left_copies"] == 41


@pytest.mark.parametrize("lengths", [(60, 75), (900, 1000), (15, 400)])
def test_open_pairs_of_counters_lose_none(monkeypatch, lengths):
    """Matrix products stand in for the differences of most pairs: what they leave open holds every pair that the differences allow."""
    rng = random.Random(8)
    words = [["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(200)] for _ in range(3)]
    texts = []
    for n in range(240):
        body = [rng.choice(words[n % 3]) for _ in range(rng.randint(*lengths))]
        texts += [" ".join(body), " ".join(rng.choice(words[n % 3]) if rng.random() < rng.choice((0.01, 0.03, 0.05)) else w for w in body)]
    texts.sort(key=len)
    n = np.array([len(t) - 2 for t in texts])
    rows = [text.gram_counters(t, 3) for t in texts]
    counters = np.stack([text._summed(r[None], min(map(len, rows)))[0] for r in rows])
    want = {(a, b) for a in range(len(n)) for b in range(a + 1, len(n)) if np.abs(counters[a] - counters[b]).sum(dtype=int) <= 0.08 * (n[a] + n[b]) + 1e-6}
    summed = []
    monkeypatch.setattr(text, "PLAIN", 0)
    monkeypatch.setattr(text, "ROWS", 50)
    monkeypatch.setattr(text.np, "abs", lambda x, of=np.abs: summed.append(len(x)) or of(x))
    for same in (True, False):
        got = [pair for x, y in text.near_counters(n, counters, n, counters, 0.92, same) for pair in zip(x.tolist(), y.tolist(), strict=True)]
        assert len(got) == len(set(got)) and {p for p in got if p[0] < p[1]} == want and len(want) > 50
        assert sum(summed) < 0.3 * len(n) ** 2
    grams = {p: np.unique(text.packed_grams(t, 3), return_counts=True) for p, t in enumerate(texts[:40])}
    left, right = np.repeat(np.arange(40), 40), np.tile(np.arange(40), 40)
    bags = [Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in texts[:40]]
    assert text.shared_grams(left, right, grams).tolist() == [(bags[a] & bags[b]).total() for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def test_near_duplicates_of_named_ids_and_odd_texts(spark):
    body = "the treatment increases response in the group that was observed for a year, and in no other group of the study"
    rows = [("CLM-2", body), ("CLM-1", body + "."), ("CLM-3", body.upper()), (None, body), ("CLM-4", None), ("CLM-5", "ab"), ("CLM-6", "other words " * 20_000), ("CLM-7", "other words " * 20_001)]
    got = text.near_duplicates(spark.createDataFrame(rows, "claim_id string, statement string"), "claim_id", "statement").collect()
    assert sorted((r["left_id"], r["right_id"], r["left_copies"], r["right_copies"], r["links"]) for r in got) == [("CLM-1", "CLM-2", 1, 3, 1), ("CLM-6", "CLM-7", 1, 1, 1)]
    assert text.near_duplicates(spark.createDataFrame([], "claim_id string, statement string"), "claim_id", "statement").count() == 0


def test_secrets_and_placeholders(spark):
    f = spark.createDataFrame([(1, "ok\nsk-abcdefghijklmnop-\nAPI key: abcd1234\nC:\\Users\\me\\x"), (2, "ghp_short")], "id int, t string")
    hits = {(r["line_number"], r["code"]) for r in text.secret_hits(f, "t", ["id"]).collect()}
    assert (3, "KEY_VALUE") in hits and (4, "WINDOWS_USER_PROFILE") in hits and all(n != 1 for n, _ in hits)
    p = spark.createDataFrame([("a", "TODO"), ("b", "MISSING_ATTACHMENT TBD"), ("c", "fine")], "p string, t string")
    assert {r["p"]: r["packet_state"] for r in text.placeholder_states(p, "p", "t").collect()} == {"a": "revision_required", "b": "blocked", "c": "ready"}


def test_review_items(spark):
    letter = "Dear author,\n1. Please add data.\n2) The design is odd\n(3) Why?\n"
    f = spark.createDataFrame([(1, letter), (2, "just one")], "id int, t string")
    got = [(r["id"], r["item_number"], r["classification"], r["priority"], r["action_type"]) for r in text.review_items(f, "t", ["id"]).orderBy("id", "item_number").collect()]
    assert got == [(1, 1, "requested evidence", "high", "add_evidence"), (1, 2, "methodological concern", "high", "add_analysis"),
                   (1, 3, "question", "medium", "respond_text"), (2, 1, "required change", "medium", "edit_manuscript")]


def test_chain_append_then_check(spark):
    batch = spark.createDataFrame([(c, i, f"p{i}") for c in ("a", "b") for i in range(5)], "chain string, batch_order int, payload string")
    none = spark.createDataFrame([], "chain string, sequence long, event_sha256 string")
    chain = integrity.append_chain(none, batch)
    body = ["payload", "previous_event_sha256", "sequence"]
    assert integrity.chain_breaks(chain, body=body).count() == 0
    heads = chain.groupBy("chain").agg(F.max("sequence").alias("sequence"), F.max_by("event_sha256", "sequence").alias("event_sha256"))
    both = chain.unionByName(integrity.append_chain(heads, batch))
    assert integrity.chain_breaks(both, body=body).count() == 0 and both.count() == 20
    broken = both.withColumn("payload", F.when((F.col("chain") == "a") & (F.col("sequence") == 3), "x").otherwise(F.col("payload")))
    assert [(r["chain"], r["sequence"], r["problem"]) for r in integrity.chain_breaks(broken, body=body).collect()] == [("a", 3, "EVENT_HASH")]


def test_graph_and_projection(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d"), ("e", "zz")], "id string, depends_on string")
    got = {(r["id"], r["problem"]) for r in integrity.dependency_problems(nodes, edges).collect()}
    assert {("b", "CYCLE_DEPENDENCY"), ("c", "CYCLE_DEPENDENCY"), ("d", "SELF_DEPENDENCY"), ("e", "UNKNOWN_DEPENDENCY")} <= got
    f = spark.createDataFrame(LEFT, SCHEMA)
    assert projection.bounded_projection(f, ["value"], "ordinal", [1, 3], 5, 1000).count() == 2
    for kw, code in (({"row_limit": 1, "byte_limit": 1000}, "PROJECTION_ROW_LIMIT"), ({"row_limit": 5, "byte_limit": 3}, "PROJECTION_BYTE_LIMIT")):
        with pytest.raises(Refusal) as caught:
            projection.bounded_projection(f, ["value"], "ordinal", [1, 3], **kw)
        assert caught.value.code == code
    with pytest.raises(Refusal):
        projection.bounded_projection(f, ["value"], "ordinal", [99], 5, 1000)


def test_wording_rules(spark):
    lines = {"PLACEHOLDER_LANGUAGE": "TBD later", "VAGUE_EVALUATIVE_TERM": "a robust thing", "UNBOUNDED_CERTAINTY": "it is always so",
             "GLOBAL_NOVELTY_OVERCLAIM": "the world's first", "LOADED_FRAMING": "merely that", "FALSE_DILEMMA": "either we win or we lose, no other way",
             "AD_HOMINEM": "an ignorant critic", "CIRCULAR_SUPPORT": "true because it is true", "ABSENCE_AS_PROOF": "no evidence\nthus means"}
    f = spark.createDataFrame([(k, v) for k, v in lines.items()] + [("none", "a robust thing measured by a scale")], "p string, t string")
    got = {(r["subject"], r["code"]) for r in rules.wording_findings(f, "p", "t", "strict").collect()}
    assert got == {(k, k) for k in lines}
    soft = rules.wording_findings(f, "p", "t", "exploratory").filter("code = 'LOADED_FRAMING'").first()
    assert (soft["severity"], soft["status"]) == ("warning", "WARN")
    with pytest.raises(Refusal):
        rules.wording_findings(f, "p", "t", "other")


def test_every_code_has_a_class(spark):
    from plumbline.operators import rule_tables as R

    assert set(R.FAILURE_STATUS.values()) <= set(R.FAILURE_CLASSES)
    assert {code for _, code in R.CHECK_OWNERS} <= set(R.FAILURE_STATUS) and {gate for gate, _ in R.CHECK_OWNERS} == {1, 2, 3}
    found = spark.createDataFrame([(1, "HYPOTHESIS_UNDERSPECIFIED"), (2, "HYPOTHESIS_UNDERSPECIFIED"), (2, "TOTAL_EVIDENCE_ROLE_CONFLICT")], "gate int, code string")
    assert {(r["gate"], r["check_id"]) for r in gates.owned_findings(found).collect()} == {(1, "question_stated"), (2, "claim_map_complete")}
    f = spark.createDataFrame([("QUESTION_UNDERSPECIFIED",), ("X",)], "code string")
    assert [r["failure_status"] for r in gates.classified(f).orderBy("code").collect()] == ["FAIL_INCOMPLETE", "FAIL_UNSUPPORTED"]


def test_structure_and_reference_findings(spark):
    bad = spark.createDataFrame([("c1", "/claims/id", "DUPLICATE_ID")], "subject string, pointer string, problem string")
    assert rules.structure_findings(bad, "strict").first()["code"] == "SCHEMA_STRUCTURE"
    pairs = spark.createDataFrame([(1, 2, 0.95)], "left_id int, right_id int, ratio double")
    assert rules.duplicate_claim_findings(pairs, "exploratory").first()["status"] == "WARN"
    refs = spark.createDataFrame([("a", 10, 1), ("b", 5, 1)], "relative_path string, size long, gate int")
    assert integrity.reference_budget(refs, 14).count() == 1 and integrity.reference_budget(refs, 15).count() == 0
    assert integrity.repeated_gates(refs).first()["reference_count"] == 2


def test_transition_and_closure(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (9, 8), (8, 9)], "id int, parent_id int")
    got = {r["id"]: (r["root_id"], r["depth"], r["settled"]) for r in integrity.lineage_depths(edges, 16).collect()}
    assert got[3] == (1, 2, True) and got[2] == (1, 1, True) and not got[9][2]
    up = integrity.ancestors(edges, spark.createDataFrame([(3,)], "id int"))
    assert {(r["ancestor_id"], r["depth"]) for r in up.collect()} == {(2, 1), (1, 2)}


def test_receipts_go_stale(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, value string")
    before = readiness.readiness_decision(statuses(f, ["id"])).withColumn("dataset", F.lit("d"))
    changed = spark.createDataFrame([("a", "1"), ("a", "2")], f.schema)
    after = readiness.readiness_decision(statuses(changed, ["id"])).withColumn("dataset", F.lit("d"))
    assert readiness.stale_receipts(before, before).first()["current"] and not readiness.stale_receipts(before, after).first()["current"]
