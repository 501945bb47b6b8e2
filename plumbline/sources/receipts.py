"""Readiness of published versions: declarations bound to a manifest, measured facts, receipts and the active selection."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.operators import readiness
from plumbline.operators.ordering import SortSpec, make_sort_spec
from plumbline.sources.exports import put_if_absent
from plumbline.sources.versions import VersionStore

RECEIPT_SCHEMA = (
    "snapshot_id string, records_sha256 string, order_sha256 string, decision string, required_check_count long, executed_check_count long, "
    "passed_check_count long, failed_check_count long, blocked_check_count long, binding_sha256 string, checks array<struct<check_id:string,status:string>>, "
    "spec string, receipt_sha256 string"
)


def file_sha256(spark: SparkSession, path: str) -> str | None:
    """Digest of one small declared file, None if it is not there."""
    try:
        row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


def _content(store: VersionStore, snapshot: str) -> DataFrame:
    return store.load(snapshot, checked=False).drop("ordinal", "record_sha256")


def declare(store: VersionStore, snapshot: str, keys: Sequence[str], tie_break: Sequence[str] = (), plan: str | None = None, **policy) -> SortSpec:
    """A declaration bound to everything that identifies a published version, and to the plan file as it is now."""
    bound = store.manifest(snapshot)
    digest = file_sha256(store.spark, plan) if plan else None
    if plan and digest is None:
        raise Refusal("READINESS_PLAN_MISSING", plan)
    return make_sort_spec(_content(store, snapshot), list(keys), list(tie_break), plan_path=plan, plan_sha256=digest, **_bindings(bound), **policy)


def _bindings(bound: dict) -> dict:
    return {
        "source_records_sha256": bound["records_sha256"], "source_order_sha256": bound["order_sha256"], "parent_ids": tuple(bound["parents"]), "snapshot_id": bound["snapshot_id"],
        "manifest_sha256": bound["manifest_sha256"], "operation_sha256": bound["operation_sha256"], "sources": tuple(bound["sources"]),
    }


def measured(store: VersionStore, spec: SortSpec) -> readiness.SourceFacts:
    """The facts that the gate cannot take from the table: the version and its ancestors recompute, the manifest is the one
    declared, and the plan file has the declared content."""
    bound = _bindings(store.manifest(spec.snapshot_id))
    current = SortSpec(())
    identity = all(getattr(spec, name) == value for name, value in bound.items()) and spec.versions == current.versions
    return readiness.SourceFacts(
        verified=store.verify_lineage(spec.snapshot_id).isEmpty(), identity=identity,
        plan_sha256=file_sha256(store.spark, spec.plan_path) if spec.plan_path else None)


def published_checks(store: VersionStore, spec: SortSpec) -> DataFrame:
    """The 22 checks of a published version, every one of them measured."""
    return readiness.readiness_checks(_content(store, spec.snapshot_id), spec, measured(store, spec))


def issue(store: VersionStore, spec: SortSpec, select: bool = True) -> dict:
    """Run the gate and append its receipt, named by its own digest; an equal receipt is there already. Optionally make it the active one."""
    checks = published_checks(store, spec).orderBy("position").collect()  # 22 rows
    rows = store.spark.createDataFrame(checks, "position int, check_id string, status string, evidence map<string,string>")
    decided = readiness.readiness_decision(rows).first()
    receipt = {
        "snapshot_id": spec.snapshot_id, "records_sha256": spec.source_records_sha256, "order_sha256": spec.source_order_sha256, "decision": decided["decision"],
        "required_check_count": len(readiness.REQUIRED_CHECKS), "executed_check_count": len(checks), "passed_check_count": decided["passed"],
        "failed_check_count": decided["failed"], "blocked_check_count": decided["blocked"], "binding_sha256": decided["binding_sha256"],
        "checks": [{"check_id": r["check_id"], "status": r["status"]} for r in checks], "spec": json.dumps(dataclasses.asdict(spec), sort_keys=True),
    }
    receipt["receipt_sha256"] = _digest(receipt)
    put_if_absent(store.spark, f"{store.root}/receipts/{receipt['receipt_sha256']}.json", json.dumps(receipt, sort_keys=True) + "\n")
    if select:
        select_receipt(store, receipt["receipt_sha256"])
    return receipt


def _digest(receipt: dict) -> str:
    body = {k: v for k, v in receipt.items() if k != "receipt_sha256"}
    return hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def receipts(store: VersionStore) -> DataFrame:
    """All receipts, and whether each still has the content it is named by."""
    return _read(store, "receipts", RECEIPT_SCHEMA)


def _read(store: VersionStore, folder: str, schema: str) -> DataFrame:
    try:
        return store.spark.read.schema(schema).json(f"{store.root}/{folder}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return store.spark.createDataFrame([], schema)


def selection(store: VersionStore) -> tuple[int, str | None]:
    """Number of the last selection and the receipt that it names."""
    last = _read(store, "selections", "number long, receipt_sha256 string").orderBy(F.col("number").desc()).first()
    return (last["number"], last["receipt_sha256"]) if last else (0, None)


def select_receipt(store: VersionStore, receipt_sha256: str, after: int | None = None) -> int:
    """Make a receipt the active one, if no other was selected since selection ``after`` (by default the present one)."""
    number, active = selection(store)
    if after is None and active == receipt_sha256:
        return number
    wanted = (number if after is None else after) + 1
    text = json.dumps({"number": wanted, "receipt_sha256": receipt_sha256}) + "\n"
    if not put_if_absent(store.spark, f"{store.root}/selections/{wanted:012d}.json", text):
        raise Refusal("READINESS_SELECTION_CHANGED", f"selection {wanted} was made by another writer")
    return wanted


def status(store: VersionStore, snapshot: str, receipt_sha256: str | None = None) -> str:
    """State of a version by the active receipt, or by a given one: NONE, TAMPERED, STALE or the decision.

    A receipt that is not what its name says, or a version that no longer verifies, is TAMPERED; a receipt of another version, one that is not the active
    one, and one whose plan or decision no longer recomputes is STALE.
    """
    _, active = selection(store)
    chosen = receipt_sha256 or active
    if chosen is None:
        return "NONE"
    lines = _text(store, f"receipts/{chosen}.json")
    if lines is None:
        return "NONE"
    try:
        receipt = json.loads(lines)
    except ValueError:
        return "TAMPERED"
    if receipt.get("receipt_sha256") != chosen or _digest(receipt) != chosen:
        return "TAMPERED"
    if receipt["snapshot_id"] != snapshot or chosen != active:
        return "STALE"
    fields = json.loads(receipt["spec"])
    spec = SortSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
    facts = measured(store, spec)
    if not facts.verified:
        return "TAMPERED"
    now = readiness.readiness_decision(readiness.readiness_checks(_content(store, snapshot), spec, facts)).first()
    return receipt["decision"] if now["binding_sha256"] == receipt["binding_sha256"] else "STALE"


def _text(store: VersionStore, name: str) -> str | None:
    try:
        row = store.spark.read.text(f"{store.root}/{name}", wholetext=True).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None
