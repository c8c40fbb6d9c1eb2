"""Streams in several micro-batches give what the batch operators give."""

import json

import pytest
from pyspark.sql import functions as F

from changeflow.operators import change, classify, cluster, reports, suppress
from changeflow.sources import adapters as a
from changeflow.streaming import stages
from tests.conftest import SF


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The events cut into four files in time order, and a reader that takes one file per micro-batch."""
    base = tmp_path_factory.mktemp("feed")
    events = a.table(spark, SF, "events")
    schema = events.schema
    bounds = ["2024-01-01", "2024-01-09", "2024-01-16", "2024-01-24", "2025-01-01"]
    for lo, hi in zip(bounds, bounds[1:]):
        events.filter(f"ts >= '{lo}' AND ts < '{hi}'").coalesce(1).write.mode("append").parquet(str(base / "in"))

    def read(spark, sf, name):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))

    def run(made, name):
        """`made` gets the folder of closing marks; the stream runs, is closed, and runs again."""
        end = stages.closing_folder(spark, str(base / f"{name}-end"))
        stream = made(end)
        stages.run_available(stream, str(base / name), str(base / f"{name}-checkpoint"), 300)
        stages.close_stream(spark, end)
        stages.run_available(stream, str(base / name), str(base / f"{name}-checkpoint"), 300)
        return spark.read.schema(stream.schema).parquet(str(base / name))

    return read, run


def same(left, right):
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_pairs(spark, feed):
    read, run = feed
    got = stages.on_time(run(lambda end: stages.stream_pairs(a.snapshots(spark, SF, read), closing=end), "pairs"))
    same(got.select("snapshot_id", "before_id", "before_hash"), change.pair_snapshots(a.snapshots(spark, SF)).select("snapshot_id", "before_id", "before_hash"))


def test_pairs_with_texts(spark, feed):
    read, run = feed
    texts = a.snapshots(spark, SF, read).withColumn("extracted_text", F.concat("text_hash", F.lit("!")))
    got = stages.on_time(run(lambda end: stages.stream_pairs(texts, True, closing=end), "texts"))
    assert got.filter("text_before <=> concat(before_hash, '!') AND text_after = concat(text_hash, '!')").count() == 1000


def test_suppression(spark, feed):
    read, run = feed

    def made(end):
        asked = classify.alert_candidates(a.analyses(spark, SF, read), "severity")
        return stages.stream_suppress(stages.suppression_input(a.snapshots(spark, SF, read), asked), closing=end)

    got = stages.on_time(run(made, "suppressed")).select("diff_id", suppress.outcome_name(F.col("outcome")).alias("outcome"))
    batch = suppress.suppress_alerts(classify.alert_candidates(a.analyses(spark, SF), "severity"), a.snapshots(spark, SF))
    same(got, batch.select("diff_id", "outcome"))


def test_suppression_forgets_after_a_day():
    fold = stages.Suppress("monitor_id string, side int, row_id int, t bigint, rank int, text string", ["t", "side", "row_id"], [])
    state = {"alive": [[0, 2, "a"], [10, 3, "b"]], "hashes": ["x"]}
    assert fold.forget(state, suppress.WINDOW) == (state, suppress.WINDOW + 1000)
    assert fold.forget(state, suppress.WINDOW + 5)[0] == {"alive": [[10, 3, "b"]], "hashes": ["x"]}
    assert fold.forget(state, suppress.WINDOW + 11) == ({"alive": [], "hashes": ["x"]}, None)


def test_clusters_with_expiring_state(spark, feed):
    read, run = feed
    got = stages.on_time(run(lambda end: stages.stream_clusters(a.alerts(spark, SF, read), closing=end), "clusters"))
    want = cluster.assign_clusters(a.alerts(spark, SF))
    assert want.filter("cluster_id IS NULL").count() > 0
    same(got.select("alert_id", "cluster_id"), want.select("alert_id", "cluster_id"))


def test_rate_limit(spark, feed):
    read, run = feed
    got = stages.on_time(run(lambda end: stages.stream_rate_limit(a.request_log(spark, SF, read), 1, closing=end), "limits"))
    flags = reports.rate_limit_flags(a.request_log(spark, SF), 1)
    totals = flags.groupBy("client", "minute").agg(F.count(F.lit(1)).alias("requests"), F.count_if("rejected").alias("rejected"))
    same(got.select("client", "minute", "requests", "rejected"), totals.select("client", "minute", "requests", "rejected"))


@pytest.fixture(scope="module")
def disorder(spark, tmp_path_factory):
    """The events in six files; a row may come up to six days after its place, and files overlap."""
    base = tmp_path_factory.mktemp("disorder")
    events = a.table(spark, SF, "events")
    schema = events.schema
    delayed = events.withColumn("file", F.least(F.lit(5), F.floor((F.dayofmonth("ts") + F.col("event_id") % 7) / 6)).cast("int"))
    for i in range(6):
        delayed.filter(f"file = {i}").drop("file").coalesce(1).write.mode("append").parquet(str(base / "in"))
    rows = delayed.select("event_id", "user_id", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("t"), "file").collect()

    def read(spark, sf, name):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(base / "in"))

    return base, read, rows


def run_disordered(spark, base, made, name):
    end = stages.closing_folder(spark, str(base / f"{name}-end"))
    stream = made(end)
    stages.run_available(stream, str(base / name), str(base / f"{name}-checkpoint"), 300)
    stages.close_stream(spark, end)
    stages.run_available(stream, str(base / name), str(base / f"{name}-checkpoint"), 300)
    return spark.read.schema(stream.schema).parquet(str(base / name))


def test_disorder_within_the_watermark_changes_nothing(spark, disorder):
    base, read, _ = disorder
    out = run_disordered(spark, base, lambda end: stages.stream_pairs(a.snapshots(spark, SF, read), watermark="12 days", closing=end), "pairs")
    assert stages.late_rows(out).count() == 0
    same(stages.on_time(out).select("snapshot_id", "before_id"), change.pair_snapshots(a.snapshots(spark, SF)).select("snapshot_id", "before_id"))
    out = run_disordered(spark, base, lambda end: stages.stream_clusters(a.alerts(spark, SF, read), "12 days", end), "clusters")
    same(stages.on_time(out).select("alert_id", "cluster_id"), cluster.assign_clusters(a.alerts(spark, SF)).select("alert_id", "cluster_id"))


def test_late_rows_are_set_aside_and_counted(spark, disorder):
    base, read, rows = disorder
    out = run_disordered(spark, base, lambda end: stages.stream_pairs(a.snapshots(spark, SF, read), watermark="2 days", closing=end), "late")
    # A row is late when an earlier file has moved the watermark past it.
    late, newest = set(), 0
    for i in range(6):
        mark = (newest - 2 * 86_400_000_000) // 1000
        late |= {r.event_id for r in rows if r.file == i and newest and r.t // 1000 < mark}
        newest = max([newest, *(r.t for r in rows if r.file == i)])
    assert late and {r.snapshot_id for r in stages.late_rows(out).collect()} == late
    kept = a.snapshots(spark, SF).filter(~F.col("snapshot_id").isin(list(late)))
    same(stages.on_time(out).select("snapshot_id", "before_id"), change.pair_snapshots(kept).select("snapshot_id", "before_id"))


def test_late_requests_are_counted_by_minute(spark, disorder):
    base, read, rows = disorder
    out = run_disordered(spark, base, lambda end: stages.stream_rate_limit(a.request_log(spark, SF, read), 1, "2 days", end), "late-limits")
    asked = {r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").filter("event_type <> 'view'").collect()}
    late, newest, minute = 0, 0, 60_000_000
    for i in range(6):
        mark = (newest - 2 * 86_400_000_000) // 1000
        late += sum(1 for r in rows if r.file == i and newest and r.event_id in asked and (r.t // minute + 1) * minute // 1000 <= mark)
        newest = max([newest, *(r.t for r in rows if r.file == i and r.event_id in asked)])
    assert late and stages.late_rows(out).agg(F.sum("requests")).first()[0] == late
    assert stages.on_time(out).agg(F.sum("requests")).first()[0] == len(asked) - late


def test_diffs_and_learning_as_streams(spark, disorder, tmp_path):
    base, read, _ = disorder
    texts = lambda df: df.withColumn("extracted_text", F.concat_ws("\n", F.lit("same"), "text_hash", F.col("snapshot_id").cast("string")))
    got = run_disordered(spark, base, lambda end: stages.stream_diffs(texts(a.snapshots(spark, SF, read)), "12 days", end), "diffs")
    want = change.diff_snapshots(change.changed_pairs(texts(a.snapshots(spark, SF))))
    columns = ["diff_id", "seq", "op", "text"]
    same(got.select(*columns), want.select(*columns))


def test_diffs_of_stored_texts_leave_the_texts_out_of_the_state(spark, disorder, tmp_path):
    base, read, _ = disorder
    long = F.concat_ws(" ", F.sequence(F.lit(0), F.lit(3000)).cast("array<string>"))
    texts = lambda df: df.withColumn("extracted_text", F.concat_ws("\n", long, "text_hash", F.sha2(F.col("snapshot_id").cast("string"), 512), F.col("snapshot_id").cast("string")))
    stored, end = texts(a.snapshots(spark, SF)), stages.closing_folder(spark, str(tmp_path / "end"))
    run = lambda: stages.diff_stream(a.snapshots(spark, SF, read), stored, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "12 days", end, 300)
    early = run().select("diff_id").distinct().count()
    stages.close_stream(spark, end)
    got, want = run(), change.diff_snapshots(change.changed_pairs(stored))
    columns = ["diff_id", "seq", "op", "text"]
    same(got.select(*columns), want.select(*columns))
    assert 0 < early < want.select("diff_id").distinct().count()
    state = [p.stat().st_size for p in (tmp_path / "checkpoint" / "state").rglob("*") if p.is_file()]
    assert 0 < sum(state) < 14_000_000  # one text is 14,000 characters, and there are a thousand


def test_monitors_share_keyed_state(spark, disorder, tmp_path):
    """A key was a monitor, and the calls to its state cost more than its rows."""
    base, read, _ = disorder
    pairs = stages.stream_pairs(a.snapshots(spark, SF, read).withColumn("monitor_id", F.col("snapshot_id")), closing=stages.closing_folder(spark, str(tmp_path / "end")))
    grouping = [x for x in pairs._jdf.queryExecution().analyzed().toString().split("\n") if "TransformWithState" in x]
    assert grouping and all("monitors#" in x for x in grouping)
    fold = stages.PairsOfGroup("monitor_id bigint, snapshot_id bigint, text_hash string, t bigint, monitors int", ["t", "snapshot_id"], ["snapshot_id", "before_id"])
    rows = [dict(monitor_id=m, snapshot_id=10 * m + i, text_hash=str(i), t=i, monitors=0) for i in range(6) for m in (1, 2)]
    first, state = fold.settle((0,), rows[:5], {})
    rest, state = fold.settle((0,), rows[5:], json.loads(json.dumps(state)))
    assert {r["snapshot_id"]: r["before_id"] for r in [*first, *rest]} == {10 * m + i: 10 * m + i - 1 if i else None for m in (1, 2) for i in range(6)}
    assert sorted(state["last"]) == [[1, 15, "5", 5], [2, 25, "5", 5]]


def test_stored_diffs_stay_in_hunks(spark, disorder, tmp_path):
    """A row per line was stored, with the text of the line, where one row per diff does."""
    base, read, _ = disorder
    stored = a.snapshots(spark, SF).withColumn("extracted_text", F.concat_ws("\n", F.lit("same"), "text_hash"))
    end = stages.closing_folder(spark, str(tmp_path / "end"))
    for _ in range(2):
        got = stages.diff_stream(a.snapshots(spark, SF, read), stored, str(tmp_path / "out"), str(tmp_path / "checkpoint"), "12 days", end, 300)
        stages.close_stream(spark, end)
    diffs = spark.read.parquet(str(tmp_path / "out" / "diffs"))
    assert "hunks" in diffs.columns and diffs.count() == got.select("diff_id").distinct().count() < got.count()


def test_a_micro_batch_is_stored_before_it_is_read(spark, disorder, tmp_path, monkeypatch):
    """What learns from a batch reads files: the keyed state of the stream runs once a batch."""
    base, read, _ = disorder
    read_rows = []
    monkeypatch.setattr(stages.monitoring, "learn_next", lambda store, run, rows: read_rows.append(rows.count() if rows.inputFiles() else 0))
    observed = read(spark, SF, "events").selectExpr(
        "user_id AS monitor_id", "event_type AS pattern", "event_id AS diff_id", "0.9D AS similarity", "CAST(NULL AS STRING) AS blocked_reason", "ts AS observed_at"
    )
    end = stages.closing_folder(spark, str(tmp_path / "end"))
    for _ in range(2):
        stages.learn_stream(observed, str(tmp_path / "store"), str(tmp_path / "checkpoint"), "12 days", end, timeout=300)
        stages.close_stream(spark, end)
    assert len(read_rows) > 1 and 0 not in read_rows and sum(read_rows) == 1000


def test_the_chain_as_a_stream(spark, tmp_path):
    """Snapshots in files by arrival, some of them two days after their time: the stored results are those of one run."""
    from tests import test_incremental as chain

    rows = chain.pages(14, 2)
    arrived = [(*r, (r[3].day + (2 if i % 5 == 0 else 0)) // 13) for i, r in enumerate(rows)]
    for i in sorted({r[4] for r in arrived}):
        spark.createDataFrame([r[:4] for r in arrived if r[4] == i], chain.SNAPSHOTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    snapshots, monitors = spark.createDataFrame(rows, chain.SNAPSHOTS), spark.createDataFrame(chain.MONITORS[:2], chain.MONITOR_SCHEMA)
    stream = spark.readStream.schema(chain.SNAPSHOTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, end = str(tmp_path / "store"), stages.closing_folder(spark, str(tmp_path / "end"))
    for _ in range(2):
        stages.watch_stream(stream, monitors, chain.make_model(), store, str(tmp_path / "checkpoint"), "2 days", end, str(tmp_path / "late"), 900)
        stages.close_stream(spark, end)
    history = stages.CarryStore(spark, store)
    assert len(history.commits) > 1 and spark.read.parquet(str(tmp_path / "late")).count() == 0
    parts = []
    for commit in history.commits:
        parts.append({name: spark.read.parquet(path) for name, path in commit.results.items()})
    chain.check_against_one_run(spark, store, parts, snapshots, monitors)


def test_dedupe(spark, feed):
    read, run = feed
    rows = a.snapshots(spark, SF, read)
    got = run(lambda end: stages.stream_dedupe(rows.union(rows), ["snapshot_id"], "created_at"), "deduped")
    assert got.count() == 1000 == got.select("snapshot_id").distinct().count()


def test_digests(spark, feed, tmp_path):
    from changeflow.operators import notify

    read, _ = feed
    queue = str(tmp_path / "queue")
    alerts, settings, monitors = a.alerts(spark, SF), a.settings(spark, SF), a.monitors(spark, SF)
    stages.queue_digests(a.alerts(spark, SF, read), settings, queue, str(tmp_path / "checkpoint")).awaitTermination(300)
    want = notify.build_digests(notify.route_alerts(alerts, settings), monitors, 9)
    same(stages.due_digests(spark, queue, monitors, 9), want)


def test_a_digest_is_sent_once(spark, tmp_path):
    from changeflow.operators import notify
    from changeflow.plans import queries as q

    routes = q._routes(spark, SF).filter("route = 'digest'")
    routes.write.parquet(str(tmp_path / "queue" / "batch=0"))
    queue, monitors = str(tmp_path / "queue"), a.monitors(spark, SF)
    first = stages.due_digests(spark, queue, monitors, 9)
    assert first.count() > 0
    stages.consumed_routes(spark, queue, 9).write.parquet(str(tmp_path / "sent"))
    sent = spark.read.parquet(str(tmp_path / "sent"))
    assert stages.due_digests(spark, queue, monitors, 9, sent).count() == 0
    assert stages.consumed_routes(spark, queue, 9, sent).count() == 0
    others = {r.h for r in routes.select(notify.digest_hour(F.col("digest_hour_utc")).alias("h")).distinct().collect()} - {9}
    for hour in others:
        assert stages.due_digests(spark, queue, monitors, hour, sent).count() == stages.due_digests(spark, queue, monitors, hour).count()


def test_a_stream_that_takes_too_long_is_an_error(spark, tmp_path):
    slow = a.stream_table(spark, SF, "events")
    with pytest.raises(TimeoutError):
        stages.run_available(slow, str(tmp_path / "out"), str(tmp_path / "checkpoint"), timeout=0.001)


class _Value:
    """A state variable and a handle as the keyed processors see them, and how often each call was made."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], [], []

    def getListState(self, name, schema):
        made = _Value()
        made.get = lambda: iter(made.rows)
        setattr(self, name, made)
        return made

    def getValueState(self, name, schema):
        made = _Value()
        made.get = lambda: made.rows[0] if made.rows else None
        setattr(self, name, made)
        return made

    def appendList(self, rows):
        self.calls.append("append")
        self.rows += rows

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def update(self, row):
        self.calls.append("update")
        self.rows = [row]

    def clear(self):
        self.calls.append("clear")
        self.rows = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


class _Mark:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_rows_wait_in_packs_and_come_out_in_order():
    """A key's rows of a micro-batch are one element of the state; texts that repeat take little room."""
    fold = stages.Pairs("monitor_id bigint, snapshot_id bigint, text_hash string, extracted_text string, t bigint", ["t", "snapshot_id"], ["snapshot_id", "before_id", "text_after", "t"])
    handle = _Value()
    fold.init(handle)
    text = " ".join(str(n * 7919 % 10007) for n in range(2000))
    rows = [{"monitor_id": 1, "snapshot_id": i, "text_hash": str(i), "extracted_text": f"{text}{i}" if i else None, "t": i * 1_000_000} for i in (5, 3, 0, 4, 1, 2)]
    assert list(fold.handleInputRows((1,), rows, _Mark(0))) == []
    assert len(handle.waiting.rows) == 1 and len(handle.waiting.rows[0][2]) < 2 * len(text)
    assert handle.timers == [1]
    handle.timers.clear()
    got = list(fold.handleExpiredTimer((1,), _Mark(3500), None))
    assert [(r.snapshot_id, r.before_id, r.text_after) for r in got] == [(i, i - 1 if i else None, f"{text}{i}" if i else None) for i in range(4)]
    assert handle.timers == [4001]
    late = list(fold.handleInputRows((1,), [{**rows[0], "t": 3_000_000}, {**rows[0], "snapshot_id": 9, "t": 4_500_000}], _Mark(3500)))
    assert [(r.snapshot_id, r.late) for r in late] == [(5, True)] and len(handle.waiting.rows) == 2
    handle.timers.clear()
    assert [(r.snapshot_id, r.before_id) for r in fold.handleExpiredTimer((1,), _Mark(9999), None)] == [(4, 3), (9, 4), (5, 9)]
    assert handle.waiting.rows == [] and handle.timers == []


def test_minutes_write_their_state_only_when_it_changes():
    fold = stages.Minutes("client bigint, t bigint", ["t"], ["client", "ended", "requests"])
    handle = _Value()
    fold.init(handle)
    assert list(fold.handleInputRows((1,), [{"client": 1, "t": t} for t in (120_000_000, 60_000_000, 120_000_000)], _Mark(0))) == []
    assert handle.timers == [60_000]
    late = list(fold.handleInputRows((1,), [{"client": 1, "t": 60_000_000}], _Mark(60_000)))
    assert [(r.ended, r.requests, r.late) for r in late] == [(60_000_000, 1, True)] and handle.kept.calls.count("update") == 1
    handle.timers.clear()
    assert [(r.ended, r.requests) for r in fold.handleExpiredTimer((1,), _Mark(60_000), None)] == [(60_000_000, 1)]
    assert handle.timers == [120_000]
    handle.timers.clear()
    assert [(r.ended, r.requests) for r in fold.handleExpiredTimer((1,), _Mark(10**9), None)] == [(120_000_000, 2)] and handle.kept.rows == []
