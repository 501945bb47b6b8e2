"""Manifests, packets, references, chains and dependency graphs.

Chain checks join each row to its predecessor by (chain, sequence - 1). That is an
equi-join, so even one chain holding the whole table is spread over all tasks; a
window per chain would put it in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.errors import Refusal
from plumbline.functions.canon import record_hash
from plumbline.operators.digest import with_positions
from plumbline.session import TASK_ROWS, freeze, tasks_for

ZERO_HASH = "0" * 64

# Suffix to media type.
MEDIA_TYPES = {
    ".json": "application/json",
    ".jsonl": "application/x-ndjson",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".md": "text/markdown",
    ".txt": "text/plain",
    ".py": "text/x-python",
    ".ps1": "text/x-powershell",
    ".pdf": "application/pdf",
    ".svg": "image/svg+xml",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"


def suffix_of(path: Column) -> Column:
    """Lower-case suffix of the last path part; names that only start with a dot have none."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def media_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, suffix_of(path)), F.lit(DEFAULT_MEDIA_TYPE))


def media_family(media: Column) -> Column:
    kind = F.lower(media)
    return (
        F.when(media.isNull(), "BINARY")
        .when(kind.isin("text/csv", "text/tab-separated-values", "application/csv"), "TABLE")
        .when((kind == "application/json") | kind.endswith("+json"), "JSON")
        .when(kind.startswith("text/"), "TEXT").when(kind.startswith("image/"), "IMAGE")
        .when(kind.startswith("audio/"), "AUDIO").when(kind.startswith("video/"), "VIDEO")
        .when(kind.isin("application/octet-stream", "application/zip", "application/gzip"), "BINARY")
        .otherwise("OTHER")
    )


def safe_relative_path(path: Column) -> Column:
    """Relative, forward slashes, no drive, no empty, ``.`` or ``..`` part."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", ".."))
    return F.coalesce(~(bad | path.contains("\\") | path.rlike(r"^[A-Za-z]:") | path.contains("\x00")), F.lit(False))


def manifest_errors(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(code, relative_path) rows for every difference between two file manifests."""
    per_path = recorded.groupBy("relative_path").agg(
        F.count(F.lit(1)).alias("_copies"), F.min_by(F.struct("sha256", "size", "media_type"), F.struct(
            "sha256", "size", "media_type")).alias("_old"))
    now = actual.select("relative_path", F.struct("sha256", "size", "media_type").alias("_new"))
    both = per_path.join(now, "relative_path", "full_outer")
    old, new = F.col("_old"), F.col("_new")
    present = old.isNotNull() & new.isNotNull()
    codes = F.array_compact(F.array(
        F.when(F.col("_copies") > 1, "MANIFEST_DUPLICATE"),
        F.when(old.isNotNull() & ~safe_relative_path(F.col("relative_path")), "MANIFEST_PATH"),
        F.when(new.isNull(), "SOURCE_MISSING"),
        F.when(old.isNull(), "SOURCE_UNEXPECTED"),
        F.when(present & ~old["sha256"].eqNullSafe(new["sha256"]), "SOURCE_DIGEST"),
        F.when(present & ~old["size"].eqNullSafe(new["size"]), "SOURCE_SIZE"),
        F.when(present & ~old["media_type"].eqNullSafe(new["media_type"]), "SOURCE_MEDIA_TYPE"),
    ))
    return both.select(F.explode(codes).alias("code"), "relative_path")


def packet_errors(packet: DataFrame, files: DataFrame, checksums: DataFrame) -> DataFrame:
    """Packet verification: manifest rows against real files and the checksum list."""
    listed = checksums.select("path", F.col("sha256").alias("_listed"))
    real = files.select("path", F.col("sha256").alias("_sha"), F.col("size").alias("_size"))
    joined = packet.join(real, "path", "left").join(listed, "path", "left")
    codes = F.array_compact(F.array(
        F.when(F.col("_sha").isNull(), "FILE_MISSING"),
        F.when(F.col("_sha") != F.col("sha256"), "FILE_HASH"),
        F.when(F.col("_size") != F.col("size"), "FILE_SIZE"),
        F.when(~F.col("_listed").eqNullSafe(F.col("sha256")), "CHECKSUM_LIST"),
    ))
    return joined.select(F.explode(codes).alias("code"), "path")


def packet_id(packet_type: str, files: DataFrame) -> DataFrame:
    """Content-derived packet id from its (path, hash) list, folded order-free."""
    from plumbline.operators.digest import multiset_digest

    entries = files.select(F.sha2(F.concat_ws("  ", "sha256", "path"), 256).alias("record_sha256"))
    return multiset_digest(entries).select(
        F.concat(F.lit(packet_type + "-"), F.substring("records_sha256", 1, 16)).alias("packet_id"),
        F.col("row_count").alias("file_count"))


def reference_states(references: DataFrame, manifest: DataFrame) -> DataFrame:
    """Freshness of bound references: MISSING, STALE_HASH, STALE_SIZE, WRONG_TYPE or CURRENT."""
    now = manifest.select(F.col("relative_path").alias("_path"), F.col("sha256").alias("_sha"),
                          F.col("size").alias("_size"), F.col("media_type").alias("_media"))
    joined = references.join(now, references["relative_path"] == F.col("_path"), "left")
    state = (
        F.when(F.col("_path").isNull(), "MISSING").when(F.col("_sha") != F.col("sha256"), "STALE_HASH")
        .when(F.col("_size") != F.col("size"), "STALE_SIZE").when(F.col("_media") != F.col("media_type"), "WRONG_TYPE")
        .otherwise("CURRENT")
    )
    return joined.select(*references.columns, state.alias("reference_state"))


def reference_budget(references: DataFrame, max_total_bytes: int) -> DataFrame:
    """One row when the bound references together are over the size limit."""
    return references.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes")).filter(
        F.col("total_bytes") > max_total_bytes).withColumn("problem", F.lit("REFERENCE_TOTAL_SIZE"))


def repeated_gates(references: DataFrame) -> DataFrame:
    return references.filter("gate is not null").groupBy("gate").agg(F.count(F.lit(1)).alias("reference_count")).filter(
        "reference_count > 1")


def unknown_references(rows: DataFrame, subject: str, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """(subject, reference) pairs whose target does not exist; array references are exploded.

    Targets go to every task while one task could hold them; beyond that each task holds its share, and the pairs stream past
    it unsorted, so a target that most rows refer to costs no memory. Tasks grow with the rows.
    """
    column, exploded = F.col(reference), rows.schema[reference].dataType.typeName() == "array"
    if exploded:
        column = F.explode(column)
    pairs = rows.select(F.col(subject).alias("subject"), column.alias("reference")).filter("reference is not null")
    tasks, targeted = tasks_for(pairs if exploded else rows), targets.count()
    known = targets.select(F.col(target).alias("reference"))
    if targeted <= TASK_ROWS:
        known = F.broadcast(known.distinct())
    else:
        known = known.repartition(max(tasks, tasks_for(targets, targeted)), "reference").distinct().hint("shuffle_hash")
    missing = pairs.join(known, "reference", "left_anti").select("subject", "reference")
    return missing.repartition(tasks, "subject", "reference").distinct()


def duplicate_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """Ids in more than one row, with their number; as many tasks as the rows need, so that none holds more than its share."""
    ids = rows.select(*columns).repartition(tasks_for(rows), *columns)
    return ids.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def role_index(rows: DataFrame, role: str, identifier: str) -> DataFrame:
    """Index by role as rows: (role, id, rank of the id inside its role, ids in the role).

    A role may hold a third of all ids, so the index is kept as rows sorted by (role, id)
    rather than one array per role; duplicate ids are merged first.
    """
    ids = rows.groupBy(F.col(role).alias("role"), F.col(identifier).alias("id")).agg(F.count(F.lit(1)).alias("copies"))
    sizes = ids.groupBy("role").agg(F.count(F.lit(1)).alias("ids_in_role"))
    return ids.join(sizes, "role").orderBy("role", "id")


# ---- chains -----------------------------------------------------------------------------


def chain_breaks(events: DataFrame, chain: str = "chain", sequence: str = "sequence", first: int = 1,
                 body: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    """Broken rows of hash chains.

    Expects previous_event_sha256 and event_sha256. The first event follows 64 zeros;
    every other event follows the hash of sequence - 1. ``body`` names the hashed
    columns; when given, event_sha256 is recomputed as well.
    """
    # As many tasks as the rows need, so that none sorts more than its share; a caller that knows the number saves the count.
    tasks = tasks or tasks_for(events)
    key, fits = [chain, sequence], F.col("previous_event_sha256")
    hashes = events.select(F.col(chain), (F.col(sequence) + 1).alias(sequence), F.col("event_sha256").alias("_hash"))
    # One row per key, so repeated sequences neither multiply rows nor break a right successor.
    heads = hashes.repartition(tasks, *key).groupBy(*key).agg(
        F.min("_hash").alias("_low"), F.max("_hash").alias("_high"), F.count(F.lit(1)).alias("_copies"), F.lit(True).alias("_before"))
    repeated = heads.filter("_copies > 1").select(chain, (F.col(sequence) - 1).alias(sequence), F.lit("SEQUENCE_REPEATED").alias("problem"))
    joined = events.repartition(tasks, *key).join(heads.hint("merge"), key, "left")
    joined = joined.withColumn("_fits", F.when((fits == F.col("_low")) | (fits == F.col("_high")), F.lit(True)))
    # Only where a sequence has several hashes can another than the least and the greatest be the one that fits.
    odd = F.coalesce((F.col("_low") < fits) & (fits < F.col("_high")), F.lit(False))
    third = [*key, "previous_event_sha256"]
    others = hashes.join(joined.filter(odd).select(*key).distinct(), key, "left_semi").withColumnRenamed("_hash", "previous_event_sha256").distinct().withColumn("_fits", F.lit(True))
    joined = joined.filter(~odd).unionByName(joined.filter(odd).drop("_fits").join(others, third, "left"))
    start = F.col(sequence) == first
    problems = [
        F.when(~start & F.col("_before").isNull(), "SEQUENCE_GAP"),
        F.when(start & ~F.col("previous_event_sha256").eqNullSafe(F.lit(ZERO_HASH)), "START_HASH"),
        F.when(~start & F.col("_before").isNotNull() & F.col("_fits").isNull(), "PREVIOUS_HASH"),
    ]
    if body:
        problems.append(F.when(~F.col("event_sha256").eqNullSafe(record_hash(events, body)), "EVENT_HASH"))
    found = joined.select(chain, sequence, F.explode(F.array_compact(F.array(*problems))).alias("problem"))
    return found.unionByName(repeated)


def append_chain(heads: DataFrame, batch: DataFrame) -> DataFrame:
    """Append events (chain, batch_order, payload) after each chain's head.

    A chain is sequential by definition. Rows are streamed in order through one pass per
    partition that keeps only the running hash and sequence, so memory does not grow with
    the length of a chain; chains run in parallel.
    heads: (chain, sequence, event_sha256); chains without a head start from zeros.
    """
    import hashlib
    import json

    ready = (
        batch.join(heads.select("chain", F.col("sequence").alias("_seq"), F.col("event_sha256").alias("_head")),
                   "chain", "left")
        .select("chain", "batch_order", "payload", F.coalesce("_seq", F.lit(0)).cast("long").alias("_seq"),
                F.coalesce("_head", F.lit(ZERO_HASH)).alias("_head"))
        .repartition("chain").sortWithinPartitions("chain", "batch_order")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, sequence, head = None, 0, ZERO_HASH
        for frame in batches:
            sequences, previous, hashes = [], [], []
            for chain, payload, seq, start in zip(frame["chain"], frame["payload"], frame["_seq"], frame["_head"]):
                if chain != current:
                    current, sequence, head = chain, int(seq), start
                sequence += 1
                body = {"payload": payload, "previous_event_sha256": head, "sequence": sequence}
                text = json.dumps(body, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
                sequences.append(sequence)
                previous.append(head)
                head = hashlib.sha256(text.encode("utf-8")).hexdigest()
                hashes.append(head)
            yield pd.DataFrame({"chain": frame["chain"], "sequence": sequences, "previous_event_sha256": previous,
                                "payload": frame["payload"], "event_sha256": hashes})

    kind = batch.schema["chain"].dataType.simpleString()
    return ready.mapInPandas(
        run, f"chain {kind}, sequence long, previous_event_sha256 string, payload string, event_sha256 string")


def transform_steps(steps: DataFrame) -> DataFrame:
    """Hash every transformation step; a lossy step without a description is refused as a row."""
    refused = F.col("lossy") & (F.coalesce(F.trim("lossiness_description"), F.lit("")) == "")
    kept = steps.withColumn("lossiness_description", F.when(F.col("lossy"), F.col("lossiness_description")))
    return kept.withColumns({
        "step_sha256": record_hash(kept),
        "refusal": F.when(refused, "TRANSFORM_LOSSY_DESCR_MISSING"),
    })


def transform_breaks(steps: DataFrame, chain: str = "chain", index: str = "step_index") -> DataFrame:
    """Steps whose output is not the input of the next step of their chain, whatever numbers are left out between.

    Neighbours are found by positions in one range-partitioned order, so a chain of any length is dealt out.
    """
    placed = with_positions(steps, [F.col(chain), F.col(index)], "_place")
    following = placed.select(F.col(chain), (F.col("_place") - 1).alias("_place"), F.col("input_sha256").alias("next_input_sha256"))
    return placed.join(following, [chain, "_place"]).filter(
        ~F.col("output_sha256").eqNullSafe(F.col("next_input_sha256"))
    ).select(chain, index, F.col("output_sha256").alias("current_output_sha256"), "next_input_sha256")


# ---- state machine ----------------------------------------------------------------------

# Run states with the states they may go to, their outcome and event kind.
_STOPS = ("STALE", "SUPERSEDED", "ABORTED")
TRANSITIONS = {
    "DRAFT": ("SCOPED", "BLOCKED", "FAILED", *_STOPS),
    "SCOPED": ("AUDITED", "BLOCKED", "FAILED", *_STOPS),
    "AUDITED": ("IMPLEMENTING", "BLOCKED", "FAILED", *_STOPS),
    "IMPLEMENTING": ("VERIFYING", "BLOCKED", "FAILED", *_STOPS),
    "VERIFYING": ("IMPLEMENTING", "READY_FOR_INDEPENDENT_VERIFY", "BLOCKED", "FAILED", *_STOPS),
    "READY_FOR_INDEPENDENT_VERIFY": (
        "IMPLEMENTING", "VERIFYING", "COMPLETE", "COMPLETE_WITH_DEFERRED_SOFT_GATES", "BLOCKED", "FAILED", *_STOPS),
    "COMPLETE": ("STALE", "SUPERSEDED"),
    "COMPLETE_WITH_DEFERRED_SOFT_GATES": ("STALE", "SUPERSEDED"),
    "BLOCKED": (
        "DRAFT", "SCOPED", "AUDITED", "IMPLEMENTING", "VERIFYING", "READY_FOR_INDEPENDENT_VERIFY", "FAILED", *_STOPS),
    "FAILED": (),
    "STALE": (),
    "SUPERSEDED": (),
    "ABORTED": (),
}
STATE_OUTCOMES = {
    "DRAFT": "OPEN",
    "SCOPED": "OPEN",
    "AUDITED": "OPEN",
    "IMPLEMENTING": "OPEN",
    "VERIFYING": "OPEN",
    "READY_FOR_INDEPENDENT_VERIFY": "OPEN",
    "COMPLETE": "COMPLETE",
    "COMPLETE_WITH_DEFERRED_SOFT_GATES": "COMPLETE_WITH_DEFERRED_SOFT_GATES",
    "BLOCKED": "BLOCKED",
    "FAILED": "FAILED",
    "STALE": "STALE",
    "SUPERSEDED": "STALE",
    "ABORTED": "ABORTED",
}
EVENT_KINDS = {
    "DRAFT": "RESUME",
    "SCOPED": "SCOPE",
    "AUDITED": "AUDIT",
    "IMPLEMENTING": "IMPLEMENTATION",
    "VERIFYING": "VERIFICATION",
    "READY_FOR_INDEPENDENT_VERIFY": "INDEPENDENT_VERIFICATION",
    "COMPLETE": "CLOSE",
    "COMPLETE_WITH_DEFERRED_SOFT_GATES": "CLOSE",
    "BLOCKED": "BLOCK",
    "FAILED": "FAIL",
    "STALE": "STALE",
    "SUPERSEDED": "SUPERSEDE",
    "ABORTED": "ABORT",
}


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, key)


def state_outcome(state: Column) -> Column:
    return _lookup(STATE_OUTCOMES, state)


def event_kind(state: Column) -> Column:
    return _lookup(EVENT_KINDS, state)


def transition_allowed(before: Column, after: Column) -> Column:
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, targets in TRANSITIONS.items() for b in targets])
    return F.coalesce(F.array_contains(allowed, F.concat_ws(">", before, after)), F.lit(False))


def revision_violations(revisions: DataFrame, frozen: list[str], append_only: list[str] | None = None) -> DataFrame:
    """Violations between each revision and the one before it.

    revisions: run_id, revision, parent_sha256, record_sha256, state, event_kind,
    resume_state (the state a BLOCKED revision came from), created_at, the frozen columns
    and array columns that may only grow.
    """
    carried = ["record_sha256", "state", "created_at", "resume_state", *frozen, *(append_only or [])]
    parent = revisions.select("run_id", (F.col("revision") + 1).alias("revision"),
                              *[F.col(c).alias(f"_p_{c}") for c in carried])
    rows = revisions.join(parent, ["run_id", "revision"], "left")
    child = F.col("revision") > 0
    has = F.col("_p_state").isNotNull()
    blocked = (F.col("_p_state") == "BLOCKED") & ~F.col("state").isin("FAILED", *_STOPS)
    problems = [
        F.when(child & ~has, "LINEAGE_GAP"),
        F.when(child & has & ~F.col("parent_sha256").eqNullSafe(F.col("_p_record_sha256")), "PARENT_HASH"),
        F.when(~child & (F.col("state") != "DRAFT"), "BASELINE_STATE"),
        F.when(child & has & ~transition_allowed(F.col("_p_state"), F.col("state")), "TRANSITION_REFUSED"),
        F.when(child & has & blocked & ~F.col("state").eqNullSafe(F.col("_p_resume_state")), "RESUME_STATE"),
        F.when(child & has & ~F.col("event_kind").eqNullSafe(event_kind(F.col("state"))), "EVENT_KIND"),
        F.when(child & has & (F.col("created_at") < F.col("_p_created_at")), "TIME_DECREASED"),
    ]
    problems += [F.when(child & has & ~F.col(c).eqNullSafe(F.col(f"_p_{c}")), f"FROZEN_{c.upper()}") for c in frozen]
    problems += [
        F.when(child & has & (F.size(F.array_except(f"_p_{c}", c)) > 0), f"REMOVED_{c.upper()}")
        for c in append_only or []
    ]
    return rows.select("run_id", "revision", F.explode(F.array_compact(F.array(*problems))).alias("violation"))


# ---- graphs -----------------------------------------------------------------------------


def dependency_problems(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """UNKNOWN, SELF and CYCLE rows of a dependency graph: nodes(id), edges(id, depends_on).

    Edges are peeled from both ends round by round: those to a node that depends on nothing left, and
    those from a node on which nothing left depends. What stays lies on a cycle or between two of them.
    Only the shrinking rest is carried, and each round is stored. No depth is refused unless asked.
    """
    known = nodes.select(F.col("id").alias("depends_on"))
    unknown = edges.join(known, "depends_on", "left_anti").select(
        "id", "depends_on", F.lit("UNKNOWN_DEPENDENCY").alias("problem"))
    self_loops = edges.filter("id = depends_on").select("id", "depends_on", F.lit("SELF_DEPENDENCY").alias("problem"))
    rest = freeze(edges.filter("id <> depends_on").join(known, "depends_on", "left_semi").distinct())
    left = rest.count()
    rounds = 0
    while left:
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise Refusal("GRAPH_DEPTH_LIMIT", f"more than {max_rounds} dependency levels")
        waiting, needed = rest.select(F.col("id").alias("depends_on")).distinct(), rest.select(F.col("depends_on").alias("id")).distinct()
        smaller = freeze(rest.join(waiting, "depends_on", "left_semi").join(needed, "id", "left_semi").select("id", "depends_on"))
        now = smaller.count()
        rest = smaller
        if now == left:
            break
        left = now
    cycles = rest.select("id", "depends_on", F.lit("CYCLE_DEPENDENCY").alias("problem"))
    return unknown.unionByName(self_loops).unionByName(cycles)


def _lineage_keys(evidence: DataFrame) -> DataFrame:
    """Per evidence row its two sharing keys as columns: the artifact, and the artifact with its locator."""
    art, loc = F.coalesce("artifact_path", F.lit("")), F.coalesce("source_locator", F.lit(""))
    none = F.lit(None).cast("string")
    return evidence.filter(art != "").select("id", F.explode(F.array_compact(F.array(
        F.struct(F.lit("shared_artifact").alias("relationship"), art.alias("artifact"), none.alias("locator")),
        F.when(loc != "", F.struct(F.lit("duplicate_locator").alias("relationship"), art.alias("artifact"), loc.alias("locator"))),
    ))).alias("g")).select("id", "g.*", F.concat_ws("#", "g.artifact", "g.locator").alias("shared_value"))


def _lineage_groups(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("relationship", "artifact", "locator", "shared_value").agg(
        F.count(F.lit(1)).alias("members"), F.min("id").alias("anchor_id")).filter("members > 1")


def shared_lineage_groups(evidence: DataFrame) -> DataFrame:
    """Evidence that shares an artifact, or an artifact and a locator.

    A group of n rows stands for n (n - 1) / 2 shared pairs. The pairs are counted, not
    written out: one artifact may carry a third of all evidence. Groups are those of the two
    columns; ``shared_value`` only shows them.
    """
    return _lineage_groups(_lineage_keys(evidence)).select(
        "relationship", "shared_value", "anchor_id", "members", F.expr("members * (members - 1) div 2").alias("pair_count"))


def lineage_edges(evidence: DataFrame) -> DataFrame:
    """A star per group: every member linked to the group's first id (n - 1 edges keep the
    group connected; the full pair count is in shared_lineage_groups)."""
    keyed = _lineage_keys(evidence)
    groups = _lineage_groups(keyed).select(
        F.col("relationship").alias("_r"), F.col("artifact").alias("_a"), F.col("locator").alias("_l"), "anchor_id")
    same = (F.col("relationship") == F.col("_r")) & (F.col("artifact") == F.col("_a")) & F.col("locator").eqNullSafe(F.col("_l"))
    return keyed.join(groups, same).filter("id <> anchor_id").select(
        F.col("anchor_id").alias("source"), F.col("id").alias("target"), "relationship", "shared_value")


def independence_summary(evidence: DataFrame) -> DataFrame:
    """One row: independent clusters, shared pairs, corroboration type."""
    groups = shared_lineage_groups(evidence).agg(F.coalesce(F.sum("pair_count"), F.lit(0)).alias("n"))
    clusters = evidence.filter("coalesce(artifact_path,'') <> ''").agg(F.count_distinct("artifact_path").alias("n"))
    rows = groups.select(F.lit("pairs").alias("k"), "n").unionByName(clusters.select(F.lit("clusters").alias("k"), "n"))
    one = rows.agg(F.max(F.when(F.col("k") == "clusters", F.col("n"))).alias("independent_cluster_count"),
                   F.max(F.when(F.col("k") == "pairs", F.col("n"))).alias("shared_pair_count"))
    return one.withColumn(
        "corroboration_type",
        F.when(F.col("shared_pair_count") > 0, "repeated_report")
        .when(F.col("independent_cluster_count") >= 2, "independent_replication").otherwise("single_source"))


def ancestors(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(ancestor_id, depth) of the given versions: edges(id, parent_id), starts(id).

    A breadth-first walk that only carries the frontier; versions met before are not
    visited again, so shared ancestors and cycles end the walk.
    """
    seen = freeze(starts.select(F.col("id").alias("ancestor_id"), F.lit(0).alias("depth")).distinct())
    frontier = seen
    depth = 0
    while True:
        depth += 1
        if max_depth is not None and depth > max_depth:
            raise Refusal("LINEAGE_BUDGET", f"more than {max_depth} levels")
        step = (
            frontier.join(edges, frontier["ancestor_id"] == edges["id"]).select(F.col("parent_id").alias("ancestor_id")).distinct()
            .join(seen, "ancestor_id", "left_anti").withColumn("depth", F.lit(depth))
        )
        frontier = freeze(step)
        if frontier.isEmpty():
            return seen.filter("depth > 0")
        seen = freeze(seen.unionByName(frontier))


def lineage_depths(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, root_id, depth, settled) of parent-linked versions with one parent each.

    Pointer jumping: every round doubles the reach of each pointer, so the table keeps one
    row per version and 256 levels need 8 rounds. Without a limit the rounds reach past the number of
    versions, so a row that is not settled sits on a cycle.
    """
    max_depth = edges.count() if max_depth is None else max_depth
    state = edges.select("id", F.col("parent_id").alias("root_id"), F.lit(1).cast("long").alias("depth"), F.lit(False).alias("settled"))
    reach = 1
    while True:
        ahead = state.select(F.col("id").alias("root_id"), F.col("root_id").alias("_far"), F.col("depth").alias("_d"),
                             F.col("settled").alias("_s"))
        joined = state.join(ahead, "root_id", "left")
        top = F.col("_far").isNull()
        state = freeze(joined.select(
            "id", F.coalesce("_far", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            (top | F.col("settled") | F.coalesce("_s", F.lit(False))).alias("settled")))
        reach *= 2
        if reach > max_depth or state.filter("not settled").isEmpty():
            return state
