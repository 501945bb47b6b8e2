"""Three continuous operators.

Event time must be TIMESTAMP: cast TIMESTAMP_NTZ columns first (session time zone UTC).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.operators.integrity import TRANSITIONS, ZERO_HASH


# ---- exactly-once intake ----------------------------------------------------------------


def new_content(arrivals: DataFrame, event_time: str, digest: str, delay: str) -> DataFrame:
    """Drop content already seen inside the watermark, for sources that never deliver later
    than ``delay``: the engine also drops rows that are older than the watermark. Where
    lateness is not bounded, use start_intake, which compares with the ledger only."""
    return arrivals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([digest])


def append_new(ledger_path: str, digest: str):
    """foreachBatch function: append contents the ledger does not hold yet, so a replayed
    batch adds nothing."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        unique = batch.dropDuplicates([digest])
        try:
            known = spark.read.parquet(ledger_path).select(digest).distinct()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None  # first batch: the ledger does not exist yet
        if known is not None:
            unique = unique.join(known, digest, "left_anti")
        unique.write.mode("append").parquet(ledger_path)

    return run


def start_intake(arrivals: DataFrame, digest: str, ledger_path: str, checkpoint: str) -> StreamingQuery:
    """Append every content once, however late it arrives: the ledger is the memory."""
    return (
        arrivals.writeStream.foreachBatch(append_new(ledger_path, digest)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


# ---- chain check ------------------------------------------------------------------------

BREAK_SCHEMA = "chain string, sequence long, problem string"
#: Sequences of one chain that wait together in one value of the state: it is read and written as a whole.
PAGE = 64
#: Rows of one chain that are sorted at a time.
FRAME = 10_000
_WAITING = "sequence array<long>, previous_event_sha256 array<string>, event_sha256 array<string>, state array<string>"


class ChainChecker(StatefulProcessor):
    """Per chain: last hash, sequence and state. Events ahead of their turn wait in state until the
    missing ones come or a row without sequence closes the chain; then the gaps are reported and
    the waiting events are taken up from the lowest one, so none is lost.

    Up to ``FRAME`` rows at a time are taken by sequence, so most find their turn without waiting. Waiting events
    lie in pages of ``PAGE`` sequences, one of which is held at a time, however many there are."""

    def __init__(self, allowed: dict | None = None) -> None:
        self.allowed = allowed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "sequence long, event_sha256 string, state string")
        self.waiting = handle.getMapState("waiting", "page long", _WAITING)

    def _open(self, fresh: bool) -> None:
        # What a chain seen for the first time has stored is known; of others the state is asked.
        self.stored, self.number, self.page, self.changed = set() if fresh else None, None, {}, False

    def _turn(self, number: int) -> dict:
        """The page of that number: {sequence: row}. The one held before is written if it has changed."""
        if number != self.number:
            self._write()
            self.number, self.page, self.changed = number, {}, False
            self.held = number in self.stored if self.stored is not None else self.waiting.containsKey((number,))
            if self.held:
                self.page = {row[0]: row for row in zip(*self.waiting.getValue((number,)), strict=True)}
        return self.page

    def _write(self) -> None:
        if not self.changed:
            return
        if self.page:
            self.waiting.updateValue((self.number,), tuple(list(column) for column in zip(*self.page.values(), strict=True)))
            if self.stored is not None:
                self.stored.add(self.number)
        elif self.held:
            self.waiting.removeKey((self.number,))
            if self.stored is not None:
                self.stored.discard(self.number)
        self.changed = False

    def _take(self, row: tuple, head: tuple, out: list, chain: str, gap: bool) -> tuple:
        sequence, previous, digest, state = row
        if not gap and previous != head[1]:
            out.append((chain, sequence, "PREVIOUS_HASH" if head[0] else "START_HASH"))
        if self.allowed is not None and head[2] is not None and state not in self.allowed.get(head[2], ()):
            out.append((chain, sequence, "TRANSITION_REFUSED"))
        return (sequence, digest, state)

    def _drain(self, head: tuple, out: list, chain: str, closed: bool) -> tuple:
        while head[0] + 1 in self._turn((head[0] + 1) // PAGE):
            head = self._next(head[0] + 1, head, out, chain, False)
        if closed:
            self._write()
            for number in sorted(int(k[0]) for k in self.waiting.keys()) if self.stored is None else sorted(self.stored):
                for sequence in sorted(self._turn(number)):
                    gap = sequence != head[0] + 1
                    if gap:
                        out.append((chain, sequence, "SEQUENCE_GAP"))
                    head = self._next(sequence, head, out, chain, gap)
        self._write()
        return head

    def _next(self, sequence: int, head: tuple, out: list, chain: str, gap: bool) -> tuple:
        self.changed = True
        return self._take(self.page.pop(sequence), head, out, chain, gap)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        chain, out, closed = str(key[0]), [], False
        known = self.head.get()
        head = tuple(known) if known is not None else (0, ZERO_HASH, None)
        self._open(known is None)
        events = ((r["sequence"], r["previous_event_sha256"], r["event_sha256"], r["state"]) for r in rows)
        while came := list(islice(events, FRAME)):
            closed = closed or any(row[0] is None for row in came)
            for row in sorted((row for row in came if row[0] is not None), key=itemgetter(0)):
                sequence = row[0]
                if sequence <= head[0] or sequence in self._turn(sequence // PAGE):
                    out.append((chain, sequence, "SEQUENCE_REPEATED"))
                elif sequence == head[0] + 1:
                    head = self._take(row, head, out, chain, False)
                else:
                    self.page[sequence], self.changed = row, True
            yield from self._told(out)
        head = self._drain(head, out, chain, closed)
        self.head.update(head)
        yield from self._told(out)

    def _told(self, out: list) -> Iterator[Row]:
        yield from (Row(chain=c, sequence=n, problem=p) for c, n, p in out)
        out.clear()

    def close(self) -> None:
        pass


def chain_breaks_stream(events: DataFrame, check_states: bool = False) -> DataFrame:
    """Breaks of hash chains in a stream of (chain, sequence, previous_event_sha256,
    event_sha256, state). Needs the RocksDB state store. A gap is known only at the end of a
    chain: ``closing_rows`` say that it has come. Until then events wait in state, however
    many, so breaks do not depend on how the stream is cut into batches."""
    return events.groupBy("chain").transformWithState(
        statefulProcessor=ChainChecker(dict(TRANSITIONS) if check_states else None),
        outputStructType=BREAK_SCHEMA, outputMode="Append", timeMode="None")


def closing_rows(events: DataFrame) -> DataFrame:
    """One row without sequence per chain: to be put into the stream after its last event."""
    return events.select("chain").distinct().select(
        "chain", *[F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c != "chain"])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


# ---- readiness counts -------------------------------------------------------------------


def daily_key_counts(events: DataFrame, event_time: str, key: str, delay: str | None = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows per (window, key); a key with more than one row is a duplicate, a NULL key is
    missing. Rows past the watermark are dropped by the engine and show in the query
    progress as numRowsDroppedByWatermark. Without a ``delay`` no row is ever late and the
    counts of all windows stay in the state, one per (window, key)."""
    timed = events.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return (
        (timed.withWatermark(event_time, delay) if delay else timed)
        .groupBy(F.window(event_time, window).alias("w"), F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("w.start").alias("window_start"), "key", "rows")
    )


def start_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed counts batch by batch; a replayed batch writes the same rows again."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(written: DataFrame) -> DataFrame:
    """The last count of each (window, key): counts only grow, so it is the largest."""
    return written.groupBy("window_start", "key").agg(F.max("rows").alias("rows"))


def daily_readiness(key_counts: DataFrame) -> DataFrame:
    """Batch roll-up of the streamed counts per window."""
    return key_counts.groupBy("window_start").agg(
        F.sum("rows").alias("row_count"),
        F.count_if((F.col("rows") > 1) & F.col("key").isNotNull()).alias("duplicate_key_count"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("rows"))), F.lit(0)).alias("null_key_rows"))
