"""Streaming forms of the stages that keep state. Each follows event time and gives the
rows its batch twin gives, as long as rows are not later than the watermark."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from changeflow.functions import constants as k
from changeflow.functions.text import micros, severity_rank, trim_ws
from changeflow.operators import change, notify
from changeflow.operators.cluster import WINDOW as CLUSTER_WINDOW
from changeflow.operators.cluster import cluster_step, extract_keywords
from changeflow.operators.suppress import WINDOW as SUPPRESS_WINDOW
from changeflow.operators.suppress import normalize_summary, suppress_run
from changeflow.plans import monitoring
from changeflow.plans.storage import CarryStore

#: Rows that wait are packed by so many, or so many characters of text.
PACK_ROWS, PACK_CHARS = 10_000, 4_000_000

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _use_rocksdb(spark: SparkSession) -> None:
    """Keyed processors need the RocksDB state store, which also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


# ---- order, late rows, and the end of a stream ------------------------------------------------

#: The instant of a closing mark: later than any row.
END = "9999-12-31 00:00:00"


def closing_folder(spark: SparkSession, folder: str) -> str:
    """An empty folder for closing marks; it must be there when the stream begins."""
    spark.createDataFrame([], "event_time timestamp").coalesce(1).write.mode("append").parquet(folder)
    return folder


def close_stream(spark: SparkSession, folder: str) -> None:
    """Say that no more rows will come. The mark's batch moves the watermark, and the batch without rows that follows acts on it."""
    spark.range(1).select(F.lit(END).cast("timestamp").alias("event_time")).coalesce(1).write.mode("append").parquet(folder)


def _marked(rows: DataFrame, closing: str) -> DataFrame:
    """`rows` and the marks in a folder. The folder must be there, if empty, when the stream begins."""
    kinds = {f.name: f.dataType for f in rows.schema}
    marks = rows.sparkSession.readStream.schema("event_time timestamp").option("maxFilesPerTrigger", 1).parquet(closing)
    # Not null where it can be helped: a null among integers would turn a whole batch into floats in Python.
    blank = {c: F.lit("-1" if isinstance(kinds[c], (T.StringType, T.NumericType)) else None).cast(kinds[c]) for c in rows.columns if c not in ("event_time", "t")}
    if "t" in kinds:
        blank["t"] = micros(F.col("event_time"))
    return rows.unionByName(marks.withColumns(blank).select(*rows.columns))


def _timed(rows: DataFrame, watermark: str, closing: str | None) -> DataFrame:
    """`rows` (with event_time) under a watermark; marks written to `closing` move it past every row.

    A mark is a row of no key of its own that waits for good; it only carries its time.
    """
    if closing is not None:
        rows = _marked(rows, closing)
    # Without its event-time column Spark drops no late row; the processors set them aside instead.
    return rows.withWatermark("event_time", watermark).drop("event_time")


class InOrder(StatefulProcessor):
    """Rows of a key in event order, whatever order they come in.

    A row waits until the watermark has passed it; then all that wait are handled in order by
    `settle`. A row that comes after the watermark has passed it is late: it is given out at
    once, marked, and touches no state. State: the rows that wait, packed by micro-batch, and
    what `settle` keeps, as text. `forget` names the instant from which the state is no longer
    needed. A key has one timer at a time.
    """

    def __init__(self, columns: str, order: list[str], outputs: list[str]) -> None:
        self.columns, self.order, self.outputs = columns, order, outputs
        self.names = [c.split()[0] for c in columns.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.codec = pa.Codec("zstd", compression_level=3)
        self.waiting = handle.getListState("waiting", "least bigint, size int, body binary")
        self.kept = handle.getValueState("kept", "body string")
        self.at = self.names.index("t") if "t" in self.names else None
        self.texts = [i for i, c in enumerate(self.columns.split(", ")) if c.endswith(" string")]

    def settle(self, key: tuple, rows: Iterable[dict], state: dict) -> tuple[Iterable[dict], dict]:
        """Output rows for rows in event order, and the state after them."""
        raise NotImplementedError

    def forget(self, state: dict, watermark: int) -> tuple[dict | None, int | None]:
        """The state as far as it is needed at the watermark (microseconds), and when to look again."""
        return state, None

    def late(self, key: tuple, row: dict) -> dict:
        return row

    def _out(self, rows: Iterable[dict], late: bool) -> Iterator[Row]:
        made = Row(*self.outputs, "late")
        return (made(*(r.get(c) for c in self.outputs), late) for r in rows)

    def _packs(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Rows as elements of the state, so that a row costs no call and versions of a text little room."""
        held, size = [], 0
        for row in rows:
            held.append(row)
            size += sum(len(row[i] or "") for i in self.texts)
            if len(held) >= PACK_ROWS or size >= PACK_CHARS:
                yield self._pack(held)
                held, size = [], 0
        if held:
            yield self._pack(held)

    def _pack(self, rows: list[tuple]) -> tuple:
        body = pickle.dumps(list(zip(*rows, strict=True)), 5)
        return min(r[self.at] for r in rows), len(body), self.codec.compress(body, asbytes=True)

    def _unpack(self, pack: tuple) -> Iterator[tuple]:
        return zip(*pickle.loads(self.codec.decompress(bytes(pack[2]), pack[1], asbytes=True)), strict=True)

    def _wake(self, moment: int) -> None:
        """The key's timer, at this moment (milliseconds) or before."""
        timers = list(self.handle.listTimers())
        if not timers or moment < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(moment)

    def _state(self) -> str | None:
        kept = self.kept.get()
        return kept[0] if kept else None

    def _keep(self, before: str | None, state: dict | None) -> None:
        body = json.dumps(state) if state else None
        if body is not None and body != before:
            self.kept.update((body,))
        elif body is None and before is not None:
            self.kept.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, late = timerValues.getCurrentWatermarkInMs(), []

        def fresh() -> Iterator[tuple]:
            for row in rows:
                # By place where the columns lie as named: a name is looked up anew for every value.
                values = tuple(row) if getattr(row, "__fields__", None) == self.names else tuple(row[c] for c in self.names)
                if values[self.at] // 1000 < mark:
                    late.append(values)
                else:
                    yield values

        packs = list(self._packs(fresh()))
        if packs:
            self.waiting.appendList(packs)
            # A row is passed by the watermark a millisecond after its own.
            self._wake(min(p[0] for p in packs) // 1000 + 1)
        yield from self._out([self.late(key, dict(zip(self.names, r, strict=True))) for r in late], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        due, later, ready, left = [], [], [], []
        for pack in self.waiting.get():
            (due if pack[0] // 1000 < mark else later).append(pack)
        for pack in due:
            for row in self._unpack(pack):
                (ready if row[self.at] // 1000 < mark else left).append(row)
        before = self._state()
        state = json.loads(before) if before else {}
        out = []
        if ready:
            places = [self.names.index(c) for c in self.order]
            ready.sort(key=lambda r: [r[i] for i in places])
            out, state = self.settle(key, (dict(zip(self.names, r, strict=True)) for r in ready), state)
        state, look_again = self.forget(state, mark * 1000)
        self._keep(before, state)
        if due:
            later += self._packs(left)
            self.waiting.put(later) if later else self.waiting.clear()
        # The timer that fired is gone after this, and there is no other.
        moments = [p[0] // 1000 + 1 for p in later] + ([look_again // 1000 + 1] if look_again is not None else [])
        if moments:
            self.handle.registerTimer(min(moments))
        yield from self._out(out, False)

    def close(self) -> None:
        pass


def on_time(out: DataFrame) -> DataFrame:
    """What a stage made of the rows that were not late."""
    return out.filter(~F.col("late")).drop("late")


def late_rows(out: DataFrame) -> DataFrame:
    """The side output: rows that came after the watermark had passed them."""
    return out.filter("late").drop("late")


def _ordered(rows: DataFrame, keys: list[str], processor: InOrder, schema: str, watermark: str, closing: str | None) -> DataFrame:
    _use_rocksdb(rows.sparkSession)
    return _timed(rows, watermark, closing).groupBy(*keys).transformWithState(
        statefulProcessor=processor, outputStructType=f"{schema}, late boolean", outputMode="Append", timeMode="EventTime"
    )


def _columns(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "event_time")


# ---- pairs --------------------------------------------------------------------------------


class Pairs(InOrder):
    """State per monitor: the last id, hash, time (and text)."""

    def settle(self, key, rows, state):
        out, last = [], state
        for row in rows:
            out.append({**row, "before_id": last.get("id"), "before_hash": last.get("hash"), "before_t": last.get("t"), "text_before": last.get("text"), "text_after": row.get("extracted_text")})
            last = {"id": row["snapshot_id"], "hash": row["text_hash"], "t": row["t"], "text": row.get("extracted_text")}
        return out, last


#: Monitors share keyed state by so many groups: a call to the state costs more than a row.
GROUPS = 4096


class PairsOfGroup(InOrder):
    """State per group of monitors: the last id, hash and time of each."""

    def settle(self, key, rows, state):
        out, last = [], {monitor: rest for monitor, *rest in state.get("last", [])}
        for row in rows:
            monitor, now = row["monitor_id"], [row["snapshot_id"], row["text_hash"], row["t"]]
            out.append({**row, **dict(zip(("before_id", "before_hash", "before_t"), last.get(monitor, (None, None, None)), strict=True))})
            last[monitor] = now
        return out, {"last": [[monitor, *rest] for monitor, rest in last.items()]}


def stream_pairs(snapshots: DataFrame, with_text: bool = False, watermark: str = "1 day", closing: str | None = None) -> DataFrame:
    """Each snapshot with the one before it in event order, and `late`. State per monitor: the last id, hash, time (and text).

    Without texts the state of a monitor is narrow, and monitors whose ids hash alike keep it together.
    """
    ids, monitor = _id_type(snapshots, "snapshot_id"), _id_type(snapshots, "monitor_id")
    columns = ["monitor_id", "snapshot_id", "text_hash", *(["extracted_text"] if with_text else [])]
    rows = snapshots.select(*columns, micros(F.col("created_at")).alias("t"), F.col("created_at").cast("timestamp").alias("event_time"))
    schema = f"monitor_id {monitor}, snapshot_id {ids}, text_hash string, t bigint, before_id {ids}, before_hash string, before_t bigint"
    outputs = ["monitor_id", "snapshot_id", "text_hash", "t", "before_id", "before_hash", "before_t"]
    if with_text:
        schema, outputs = schema + ", text_before string, text_after string", [*outputs, "text_before", "text_after"]
    elif isinstance(snapshots.schema["monitor_id"].dataType, (T.StringType, T.IntegralType)):
        rows = rows.withColumn("monitors", F.pmod(F.xxhash64("monitor_id"), F.lit(GROUPS)).cast("int"))
        return _ordered(rows, ["monitors"], PairsOfGroup(_columns(rows), ["t", "snapshot_id"], outputs), schema, watermark, closing)
    return _ordered(rows, ["monitor_id"], Pairs(_columns(rows), ["t", "snapshot_id"], outputs), schema, watermark, closing)


def stream_diffs(snapshots: DataFrame, watermark: str = "1 day", closing: str | None = None) -> DataFrame:
    """Diff lines of changed pages as they come in: `diff_snapshots` on top of `stream_pairs`.

    For streams that carry their texts: those wait in the state. Where texts are stored, see `diff_stream`.
    """
    pairs = on_time(stream_pairs(snapshots, True, watermark, closing))
    changed = pairs.filter(F.col("before_id").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("before_hash")))
    named = changed.select(F.col("snapshot_id").alias("diff_id"), "monitor_id", F.timestamp_micros("t").alias("created_at"), "text_before", "text_after")
    return change.diff_snapshots(named)


def diff_stream(snapshots: DataFrame, texts: DataFrame, path: str, checkpoint: str, watermark: str = "1 day", closing: str | None = None, timeout: int | None = None) -> DataFrame:
    """Diff lines of changed pages whose texts are stored: the stream carries ids, hashes and times only.

    `texts` (monitor_id, snapshot_id, extracted_text, created_at) is read once per micro-batch that
    settles a change, between the earliest and the latest version its changes name; the texts of a
    monitor are packed where they lie, move once and are diffed where they meet (`changed_hunks`).
    Every batch has a folder of pairs and one of diffs in hunks, and overwrites them when it is
    repeated; the lines are laid out when they are read.
    """
    spark = snapshots.sparkSession
    kinds = {c: _id_type(snapshots, c) for c in ("snapshot_id", "monitor_id")}
    schema = f"diff_id {kinds['snapshot_id']}, monitor_id {kinds['monitor_id']}, created_at timestamp, hunks {change.HUNKS}"

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = on_time(batch).filter(F.col("before_id").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("before_hash")))
        # Stored first: a batch that is read again would run its keyed state again.
        changed.withColumn("created_at", F.timestamp_micros("t")).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch_id}")
        pairs = batch.sparkSession.read.schema(stored).parquet(f"{path}/pairs/batch={batch_id}")
        first, last = pairs.agg(F.min("before_t"), F.max("t")).first()
        if last is None:
            return
        named = texts.filter(micros(F.col("created_at")).between(first, last))
        diffs = change.changed_hunks(named, change.named_changes(pairs))
        diffs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/diffs/batch={batch_id}")

    pairs = stream_pairs(snapshots, False, watermark, closing)
    stored = T.StructType([*on_time(pairs).schema.fields, T.StructField("created_at", T.TimestampType())])
    _wait(pairs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), path, timeout)
    try:
        diffs = spark.read.schema(schema).parquet(f"{path}/diffs").drop("batch")
    except AnalysisException:  # no change has settled yet
        diffs = spark.createDataFrame([], schema)
    return change.hunk_lines(diffs)


# ---- rows in order for stages that run batch by batch ----------------------------------------


class Gate(InOrder):
    """Gives rows out as they are, once the watermark has passed them."""

    def settle(self, key, rows, state):
        return rows, state


def in_order(rows: DataFrame, key: str, ts: str, row_id: str, watermark: str, closing: str | None = None) -> DataFrame:
    """The rows (and `late`), given out when the watermark has passed them: each micro-batch holds
    rows that are later than those of all batches before it."""
    timed = rows.withColumns({"t": micros(F.col(ts)), "event_time": F.col(ts).cast("timestamp")}).drop(ts)
    given = [f.name for f in timed.schema if f.name not in ("event_time",)]
    schema = ", ".join(f"{c} {_id_type(timed, c)}" for c in given)
    out = _ordered(timed, [key], Gate(_columns(timed), ["t", row_id], given), schema, watermark, closing)
    return out.withColumn(ts, F.timestamp_micros("t").cast(rows.schema[ts].dataType)).select(*rows.columns, "late")


def _stored(batch: DataFrame, path: str) -> DataFrame:
    """The rows of a micro-batch out of a folder that the next one overwrites.

    What reads the batch itself runs its keyed state again, and carries its plan along.
    """
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path)


def watch_stream(snapshots: DataFrame, monitors: DataFrame, model, store: str, checkpoint: str, watermark: str = "1 day", closing: str | None = None, late_path: str | None = None, timeout: int | None = None) -> None:
    """The whole chain as a stream: pairs, diffs, learning, filtering, classification, suppression and clustering.

    Snapshots wait until the watermark has passed them; every micro-batch then goes through
    `watch_next`, which goes on from the store and commits its results there. A batch that was
    committed before a failure is passed over when it is repeated. Late snapshots go to `late_path`.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = _stored(batch, f"{store}/arrived")
        if late_path is not None:
            late_rows(batch).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        settled = on_time(batch)
        if f"batch-{batch_id}" not in CarryStore(batch.sparkSession, store).known and not settled.isEmpty():
            monitoring.watch_next(store, f"batch-{batch_id}", settled, monitors, model)

    ready = in_order(snapshots.select("monitor_id", "snapshot_id", "extracted_text", "created_at"), "monitor_id", "created_at", "snapshot_id", watermark, closing)
    _wait(ready.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), store, timeout)


def learn_stream(observations: DataFrame, store: str, checkpoint: str, watermark: str = "1 day", closing: str | None = None, late_path: str | None = None, timeout: int | None = None) -> None:
    """Pattern states as a stream: observations wait for the watermark, then go through `learn_next` batch by batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = _stored(batch, f"{store}/arrived")
        if late_path is not None:
            late_rows(batch).write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        settled = on_time(batch)
        if f"batch-{batch_id}" not in CarryStore(batch.sparkSession, store).known and not settled.isEmpty():
            monitoring.learn_next(store, f"batch-{batch_id}", settled)

    ready = in_order(observations, "monitor_id", "observed_at", "diff_id", watermark, closing)
    _wait(ready.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), store, timeout)


# ---- suppression ---------------------------------------------------------------------------


def suppression_input(snapshots: DataFrame, candidates: DataFrame, severity_col: str = "severity") -> DataFrame:
    """Snapshots and candidates as one stream of narrow rows; a snapshot sorts before a candidate of its instant."""
    left = snapshots.select(
        "monitor_id", F.lit(0).alias("side"), F.col("snapshot_id").alias("row_id"), micros(F.col("created_at")).alias("t"),
        F.lit(0).alias("rank"), F.col("text_hash").alias("text"), F.col("created_at").cast("timestamp").alias("event_time"),
    )
    right = candidates.select(
        "monitor_id", F.lit(1).alias("side"), F.col("diff_id").alias("row_id"), micros(F.col("created_at")).alias("t"),
        severity_rank(F.col(severity_col)).alias("rank"), normalize_summary(F.col("summary")).alias("text"), F.col("created_at").cast("timestamp").alias("event_time"),
    )
    return left.unionByName(right)


def _flips(hashes: list[str]) -> tuple[bool, int]:
    changes = sum(a != b for a, b in zip(hashes, hashes[1:]))
    return len(hashes) >= k.OSCILLATION_MIN_HASHES and len(set(hashes)) == 2 and changes >= k.OSCILLATION_MIN_FLIPS, changes


class Suppress(InOrder):
    """State per monitor: at most five alerts of the last 24 h and the newest six hashes."""

    def settle(self, key, rows, state):
        alive, hashes, out = state.get("alive", []), state.get("hashes", []), []
        for row in rows:
            if row["side"] == 0:
                if row["text"] is not None:
                    hashes = [*hashes, row["text"]][-k.OSCILLATION_WINDOW :]
                continue
            flip, changes = _flips(hashes)
            outcome, recent = suppress_run([row["t"]], [row["rank"]], [row["text"]], [flip], alive)
            out.append({"monitor_id": row["monitor_id"], "diff_id": row["row_id"], "outcome": outcome[0], "recent": recent[0], "flips": changes, "n_hashes": len(hashes)})
        return out, {"alive": alive, "hashes": hashes}

    def forget(self, state, watermark):
        if not state:
            return state, None
        alive = [a for a in state["alive"] if a[0] >= watermark - SUPPRESS_WINDOW]
        return {**state, "alive": alive}, min(a[0] for a in alive) + SUPPRESS_WINDOW + 1000 if alive else None

    def late(self, key, row):
        return {"monitor_id": row["monitor_id"], "diff_id": row["row_id"] if row["side"] else None}


def stream_suppress(rows: DataFrame, watermark: str = "1 day", closing: str | None = None) -> DataFrame:
    """(monitor_id, diff_id, outcome code, recent, flips, n_hashes, late) from `suppression_input`.

    Alerts leave the state 24 h after they were made, once the watermark says so. A late
    snapshot shows as a late row without a diff.
    """
    ids, monitor = _id_type(rows, "row_id"), _id_type(rows, "monitor_id")
    outputs = ["monitor_id", "diff_id", "outcome", "recent", "flips", "n_hashes"]
    schema = f"monitor_id {monitor}, diff_id {ids}, outcome int, recent int, flips int, n_hashes int"
    return _ordered(rows, ["monitor_id"], Suppress(_columns(rows), ["t", "side", "row_id"], outputs), schema, watermark, closing)


# ---- clustering ------------------------------------------------------------------------------


class Clusters(InOrder):
    """State per (user, competitor): the clusters of the last 48 h."""

    def settle(self, key, rows, state):
        opened = [{**c, "categories": set(c["categories"]), "keywords": set(c["keywords"])} for c in state.get("opened", [])]
        out = []
        for row in rows:
            cluster_id, score = cluster_step(opened, row["alert_id"], row["t"], frozenset(row["categories"]), frozenset(row["keywords"]))
            out.append({"alert_id": row["alert_id"], "cluster_id": cluster_id, "merge_score": score})
        return out, {"opened": [{**c, "categories": sorted(c["categories"]), "keywords": sorted(c["keywords"])} for c in opened]}

    def forget(self, state, watermark):
        opened = [c for c in state.get("opened", []) if c["at"] >= watermark - CLUSTER_WINDOW]
        return ({"opened": opened}, min(c["at"] for c in opened) + CLUSTER_WINDOW + 1000) if opened else (None, None)


def stream_clusters(alerts: DataFrame, watermark: str = "1 hour", closing: str | None = None) -> DataFrame:
    """(alert_id, cluster_id, merge_score, late). State per (user, competitor): the open clusters.

    Keyed state takes the place of a lock; clusters leave it 48 h after their last alert, once
    the watermark says that none can arrive for them. An alert without a competitor is given
    out at once, unclustered.
    """
    ids = _id_type(alerts, "alert_id")
    trimmed = alerts.withColumn("competitor_name", trim_ws(F.coalesce("competitor_name", F.lit(""))))
    rows = trimmed.filter(F.length("competitor_name") > 0).select(
        "user_id", "competitor_name", "alert_id", micros(F.col("created_at")).alias("t"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        extract_keywords(F.col("summary")).alias("keywords"), F.col("created_at").cast("timestamp").alias("event_time"),
    )
    outputs, schema = ["alert_id", "cluster_id", "merge_score"], f"alert_id {ids}, cluster_id {ids}, merge_score double"
    placed = _ordered(rows, ["user_id", "competitor_name"], Clusters(_columns(rows), ["t", "alert_id"], outputs), schema, watermark, closing)
    alone = trimmed.filter(F.length("competitor_name") == 0)
    return placed.unionByName(alone.select("alert_id", F.lit(None).cast(ids).alias("cluster_id"), F.lit(None).cast("double").alias("merge_score"), F.lit(False).alias("late")))


# ---- rate limit, duplicates, digests -----------------------------------------------------------


class Minutes(InOrder):
    """State per client: a count for every minute that is still open. `t` is the end of a row's minute."""

    def _counts(self) -> tuple[str | None, dict[str, int]]:
        body = self._state()
        return body, json.loads(body) if body else {}

    def _rows(self, key: tuple, counts: dict[str, int], late: bool) -> Iterator[Row]:
        return self._out([{"client": key[0], "ended": int(t), "requests": n} for t, n in sorted(counts.items())], late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, late = timerValues.getCurrentWatermarkInMs(), {}
        before, counts = self._counts()
        for row in rows:
            into = late if row["t"] // 1000 <= mark else counts
            into[str(row["t"])] = into.get(str(row["t"]), 0) + 1
        self._keep(before, counts)
        if counts:
            self._wake(min(map(int, counts)) // 1000)  # the end of a minute is no part of it
        yield from self._rows(key, late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        before, counts = self._counts()
        ended = {t: n for t, n in counts.items() if int(t) // 1000 <= mark}
        left = {t: n for t, n in counts.items() if t not in ended}
        self._keep(before, left)
        if left:
            self.handle.registerTimer(min(map(int, left)) // 1000)
        yield from self._rows(key, ended, False)


def stream_rate_limit(log: DataFrame, limit: int = k.REQUESTS_PER_MINUTE, watermark: str = "1 minute", closing: str | None = None) -> DataFrame:
    """Requests and rejections per client and clock minute, and `late`.

    A minute is given out once the watermark has reached its end. Requests of a minute that is
    over by then are late: they are counted in rows of their own.
    """
    client = _id_type(log, "client")
    ended = F.date_trunc("minute", F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 MINUTE")
    limited = log.filter(~F.col("path").startswith("/api/v1/health")).select("client", micros(ended).alias("t"), F.col("ts").cast("timestamp").alias("event_time"))
    out = _ordered(limited, ["client"], Minutes(_columns(limited), ["t"], ["client", "ended", "requests"]), f"client {client}, ended bigint, requests bigint", watermark, closing)
    minute = F.timestamp_micros("ended") - F.expr("INTERVAL 1 MINUTE")
    return out.select("client", minute.alias("minute"), "requests", F.greatest(F.lit(0), F.col("requests") - limit).alias("rejected"), "late")


def stream_dedupe(df: DataFrame, keys: list[str], ts: str, watermark: str = "1 day") -> DataFrame:
    """First row per key among those that arrive within the watermark delay."""
    return df.withColumn("_event_time", F.col(ts).cast("timestamp")).withWatermark("_event_time", watermark).dropDuplicatesWithinWatermark(
        keys
    ).drop("_event_time")


def queue_digests(alerts: DataFrame, settings: DataFrame, queue_path: str, checkpoint: str):
    """Append the digest routes of every micro-batch to a queue table; a repeated batch replaces itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        routes = notify.route_alerts(batch, settings).filter(F.col("route") == "digest")
        routes.write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")

    return (
        alerts.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def due_digests(spark: SparkSession, queue_path: str, monitors: DataFrame, hour: int, sent: DataFrame | None = None) -> DataFrame:
    """Digests of the hour from everything queued and not yet in `sent` (see `consumed_routes`)."""
    queue = spark.read.parquet(queue_path).drop("batch")
    if sent is not None:
        queue = queue.join(sent.select("alert_id", "channel"), ["alert_id", "channel"], "left_anti")
    return notify.build_digests(queue, monitors, hour)


def consumed_routes(spark: SparkSession, queue_path: str, hour: int, sent: DataFrame | None = None) -> DataFrame:
    """(alert_id, channel) that the digests of the hour cover: to be appended to `sent` once those are stored."""
    queue = spark.read.parquet(queue_path)
    used = queue.filter(notify.digest_hour(F.col("digest_hour_utc")) == hour).select("alert_id", "channel").distinct()
    return used if sent is None else used.join(sent.select("alert_id", "channel"), ["alert_id", "channel"], "left_anti")


def send_digests(spark: SparkSession, queue_path: str, sent_path: str, out_path: str, monitors: DataFrame, hour: int) -> None:
    """Store the digests of the hour and mark what they cover as sent, so that no later run sends it again.

    Both are folders of the queue's state at this time: `sent` is written after the digests,
    and a run that failed between the two overwrites its own digests when it is repeated.
    """
    covered = "alert_id, channel"
    kinds = {f.name: f.dataType.simpleString() for f in spark.read.parquet(queue_path).schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in covered.split(", "))
    try:
        sent = spark.read.schema(schema).parquet(sent_path)
        number = len([r for r in spark.read.parquet(sent_path).select("run").distinct().collect()])
    except AnalysisException:
        sent, number = None, 0
    due = due_digests(spark, queue_path, monitors, hour, sent)
    used = consumed_routes(spark, queue_path, hour, sent)
    due.write.mode("overwrite").parquet(f"{out_path}/run={number}")
    used.write.mode("overwrite").parquet(f"{sent_path}/run={number}")


def run_available(stream: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Process what is there into Parquet files, then stop; an error when that takes longer than `timeout` seconds."""
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    _wait(running, path, timeout)


def _wait(running, path: str, timeout: int | None) -> None:
    if not running.awaitTermination(timeout) and timeout is not None:
        running.stop()
        raise TimeoutError(f"the stream was not done after {timeout} s; {path} holds part of its result")
