"""Snapshot pairs, line diffs, diff statistics and rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changeflow.functions import align, scans

ORDER = ["created_at", "snapshot_id"]


def _narrow(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("monitor_id", "snapshot_id", "text_hash", "created_at")


def _pair_tracks() -> dict[str, scans.Track]:
    return {"prev": scans.before(F.struct("snapshot_id", "text_hash", "created_at"))}


def pair_carry(snapshots: DataFrame, carry: DataFrame | None = None, slices: list[Column] | None = None) -> DataFrame:
    """What `pair_snapshots` of later snapshots goes on from: the last snapshot of every monitor."""
    return scans.carry_of(_narrow(snapshots), ["monitor_id"], ORDER, slices or [scans.by_time("created_at")], carry, **_pair_tracks())


def pair_snapshots(snapshots: DataFrame, slices: list[Column] | None = None, carry: DataFrame | None = None) -> DataFrame:
    """Attach id, hash and time of the previous snapshot of the same monitor.

    Only narrow columns travel; texts are joined later, for changed pairs alone. With `carry`
    (from `pair_carry`) the first new snapshot of a monitor meets the last one of an earlier run.
    """
    seen = scans.scan(_narrow(snapshots), ["monitor_id"], ORDER, slices or [scans.by_time("created_at")], carry, **_pair_tracks())
    prev = F.try_element_at("prev", F.lit(-1))
    return seen.select(
        "monitor_id",
        "snapshot_id",
        "text_hash",
        "created_at",
        prev["snapshot_id"].alias("before_id"),
        prev["text_hash"].alias("before_hash"),
        prev["created_at"].alias("before_at"),
    )


def snapshot_status(pairs: DataFrame, diffs: DataFrame | None = None, analyses: DataFrame | None = None) -> DataFrame:
    """baseline, no_change, diffed or classified for every snapshot.

    `diffs` needs (snapshot_after_id, is_empty_after_filter), `analyses` needs (diff_id)
    where a diff is named after the snapshot it ends in.
    """
    status = (
        F.when(F.col("before_id").isNull(), "baseline")
        .when(F.col("text_hash") == F.col("before_hash"), "no_change")
        .otherwise("diffed")
    )
    out = pairs.withColumn("status", status)
    if diffs is not None:
        emptied = diffs.filter("is_empty_after_filter").select(
            F.col("snapshot_after_id").alias("snapshot_id"), F.lit(True).alias("_emptied")
        )
        out = out.join(emptied, "snapshot_id", "left").withColumn(
            "status", F.when((F.col("status") == "diffed") & F.col("_emptied"), "no_change").otherwise(F.col("status"))
        ).drop("_emptied")
    if analyses is not None:
        done = analyses.select(F.col("diff_id").alias("snapshot_id"), F.lit(True).alias("_done"))
        out = out.join(done, "snapshot_id", "left").withColumn(
            "status", F.when((F.col("status") == "diffed") & F.col("_done"), "classified").otherwise(F.col("status"))
        ).drop("_done")
    return out


#: A monitor with more snapshots than this is not gathered in one task.
GATHERED = 1000
_PACK_BYTES, _BATCH_BYTES = 4_000_000, 16_000_000


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (monitor, id, text) to packs (monitor, ids, sizes, raw, body): the texts of one monitor that lie in one
    batch, compressed together, so that versions of a page cost little more than one of them."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        batch = batch.take(pc.sort_indices(batch.column(0)))
        owners, ids, texts = batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary())
        known = pc.is_valid(texts).to_numpy(zero_copy_only=False)
        filled = pc.fill_null(texts, b"")
        ends = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        body = memoryview(filled.buffers()[2] or b"")
        sizes = np.where(known, np.diff(ends), -1)
        cuts, first = [], 0
        heads = owners.to_pylist()
        for i in range(1, len(heads) + 1):
            if i == len(heads) or heads[i] != heads[first] or ends[i] - ends[first] > _PACK_BYTES:
                cuts.append((first, i))
                first = i
        starts = pa.array([low for low, _ in cuts], pa.int32())
        lists = pa.array([low for low, _ in cuts] + [len(heads)], pa.int32())
        raw = [int(ends[high] - ends[low]) for low, high in cuts]
        packed = [codec.compress(body[ends[low] : ends[high]], asbytes=True) for low, high in cuts]
        yield pa.RecordBatch.from_arrays(
            [
                owners.take(starts), pa.ListArray.from_arrays(lists, ids), pa.ListArray.from_arrays(lists, pa.array(sizes, pa.int64())),
                pa.array(raw, pa.int64()), pa.array(packed, pa.binary()),
            ],
            names=["monitor_id", "ids", "sizes", "raw", "body"],
        )


def _unpack(ids: list, sizes: list, raw: int, body: bytes) -> Iterator[tuple]:
    texts, at = pa.decompress(body, raw, "zstd", asbytes=True) if raw else b"", 0
    for name, size in zip(ids, sizes, strict=True):
        yield name, None if size < 0 else texts[at : at + size].decode()
        at += max(size, 0)


def _meeting(schema: pa.Schema):
    """Rows (monitor, pair.., pack..) sorted by monitor, its pairs first, then its packs: pairs with both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in schema]
        held = 0

        def given():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], names=schema.names)

        def met(pairs: list[tuple], texts: dict) -> Iterator[tuple]:
            for pair in pairs:
                diff, before = pair[0], pair[2]
                if before in texts and diff in texts:
                    yield *pair, texts[before], texts[diff]

        def groups() -> Iterator[tuple]:
            here, pairs, texts = None, [], {}
            for batch in batches:
                for monitor, diff, *noted, ids, sizes, raw, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if monitor != here:
                        yield from met(pairs, texts)
                        here, pairs, texts = monitor, [], {}
                    if body is None:
                        pairs.append((diff, monitor, *noted))
                    elif pairs:
                        texts.update(_unpack(ids, sizes, raw, body))
            yield from met(pairs, texts)

        for row in groups():
            for column, value in zip(out, row, strict=True):
                column.append(value)
            held += len(row[-2] or "") + len(row[-1] or "")
            if held > _BATCH_BYTES or len(out[0]) >= 10_000:
                yield given()
                out, held = [[] for _ in schema], 0
        if out[0]:
            yield given()

    return run


def _texts_by_id(changed: DataFrame, texts: DataFrame) -> DataFrame:
    """The earlier text is fetched first, then the later one, whose id is the diff's: nothing gathers at a monitor."""
    before = texts.select(F.col("snapshot_id").alias("snapshot_before_id"), F.col("extracted_text").alias("text_before"))
    after = texts.select(F.col("snapshot_id").alias("diff_id"), F.col("extracted_text").alias("text_after"))
    return changed.join(before, "snapshot_before_id").join(after, "diff_id").select(*changed.columns, "text_before", "text_after")


_PAIR = ["diff_id", "monitor_id", "snapshot_before_id", "created_at"]


def _texts_by_monitor(changed: DataFrame, texts: DataFrame, context: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts are packed where they lie and move once, to the pairs of their monitor. With `context` the pairs
    are diffed where they meet, so their texts never leave the Python worker."""
    kinds = {f.name: f.dataType.simpleString() for f in changed.schema}
    ids = texts.schema["snapshot_id"].dataType.simpleString()
    packed = texts.mapInArrow(_packs, f"monitor_id {kinds['monitor_id']}, ids array<{ids}>, sizes array<bigint>, raw bigint, body binary")
    columns = [*changed.columns, "ids", "sizes", "raw", "body"]
    rows = changed.unionByName(packed, allowMissingColumns=True).repartition("monitor_id")
    rows = rows.sortWithinPartitions("monitor_id", F.col("raw").asc_nulls_first()).select("monitor_id", *[c for c in columns if c != "monitor_id"])
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in changed.columns), "text_before string, text_after string"])
    meet = _meeting(to_arrow_schema(T.StructType.fromDDL(schema)))
    if context is None:
        return rows.mapInArrow(meet, schema)
    diffed, given = _diffing(kinds, context, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["diff_id", *carry, "text_before", "text_after"]
        return diffed(batch.select(columns) for batch in meet(batches))

    return rows.mapInArrow(run, given)


def named_changes(pairs: DataFrame) -> DataFrame:
    """The pairs whose hash differs, as (diff_id, monitor_id, snapshot_before_id, created_at); the diff is named after the later snapshot."""
    changed = pairs.filter(F.col("before_id").isNotNull() & ~F.col("text_hash").eqNullSafe(F.col("before_hash")))
    return changed.select(F.col("snapshot_id").alias("diff_id"), "monitor_id", F.col("before_id").alias("snapshot_before_id"), "created_at")


def _by_monitor_or_id(snapshots: DataFrame, changed: DataFrame, gathered: int, by_monitor, by_id) -> DataFrame:
    texts = snapshots.filter(F.col("monitor_id").isNotNull()).select("monitor_id", "snapshot_id", "extracted_text")
    busy = texts.groupBy("monitor_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > gathered).select("monitor_id")
    if busy.isEmpty():
        return by_monitor(changed, texts)
    # One row per `gathered` snapshots at most, so it is small beside the texts.
    busy = F.broadcast(busy)
    few = by_monitor(changed.join(busy, "monitor_id", "left_anti").select(*changed.columns), texts.join(busy, "monitor_id", "left_anti"))
    many = by_id(changed.join(busy, "monitor_id", "left_semi").select(*changed.columns), texts.join(busy, "monitor_id", "left_semi"))
    return few.unionByName(many)


def changed_pairs(snapshots: DataFrame, pairs: DataFrame | None = None, gathered: int = GATHERED) -> DataFrame:
    """Both texts of every pair whose hash differs; the diff is named after the later snapshot.

    The texts of a monitor are packed together where they lie, and the packs move once, to the
    monitor's pairs. A monitor with more than `gathered` snapshots is left out of that: its
    texts are fetched by id, so a busy monitor does not meet itself in one task.
    """
    changed = named_changes(pair_snapshots(snapshots) if pairs is None else pairs)
    return _by_monitor_or_id(snapshots, changed, gathered, _texts_by_monitor, _texts_by_id)


def changed_hunks(
    snapshots: DataFrame, changed: DataFrame, context: int = 3, carry: tuple[str, ...] = ("monitor_id", "created_at"), gathered: int = GATHERED
) -> DataFrame:
    """`diff_hunks` of `changed_pairs` in one pass: both texts of a pair are diffed where they meet.

    `changed` is (diff_id, monitor_id, snapshot_before_id, created_at) and whatever else the
    diffs shall carry; columns that are not carried need not be there.
    """
    changed = changed.select(*dict.fromkeys([*_PAIR, *carry]))
    by_monitor = lambda some, texts: _texts_by_monitor(some, texts, context, carry)
    by_id = lambda some, texts: diff_hunks(_texts_by_id(some, texts), context, carry=carry)
    return _by_monitor_or_id(snapshots, changed, gathered, by_monitor, by_id)


def _keep_ends(text: str | None) -> list[str]:
    parts = (text or "").splitlines(keepends=True)
    # A last line without its end would differ from the same line further up.
    if parts and parts[-1].splitlines()[0] == parts[-1]:
        parts[-1] += "\n"
    return parts


def line_diff(before: str | None, after: str | None, context: int = 3):
    """Yield (hunk_no, before_start, after_start, op, text) for one pair of texts."""
    old, new = _keep_ends(before), _keep_ends(after)
    bare_old = [s.splitlines()[0] for s in old]
    bare_new = [s.splitlines()[0] for s in new]
    for hunk, (start_old, start_new, lines) in enumerate(align.hunks(old, new, context)):
        for op, place in lines:
            yield hunk, start_old, start_new, op, bare_new[place] if op == "+" else bare_old[place]


HUNKS = (
    "array<struct<hunk_no: int, before_start: int, after_start: int, lines: array<struct<seq: int, op: string, text: string>>,"
    " blocks: array<struct<at: int, removed: int, added: int>>>>"
)


def _blocks(ops: list[str]) -> list[tuple[int, int, int]]:
    """Stretches of changed lines of a hunk: where they begin, how many lines go and how many come after them."""
    out, i = [], 0
    while i < len(ops):
        at = i
        while i < len(ops) and ops[i] == "-":
            i += 1
        middle = i
        while i < len(ops) and ops[i] == "+":
            i += 1
        if i > at:
            out.append((at, middle - at, i - middle))
        else:
            i += 1
    return out


class _Hunks:
    """Diffs in columns: lines, blocks and hunks one after the other, and where each list begins."""

    def __init__(self) -> None:
        self.seqs, self.ops, self.texts = [], [], []
        self.blocks: list[tuple[int, int, int]] = []
        self.heads: list[tuple[int, int, int]] = []
        self.line_ends, self.block_ends, self.diff_ends = [0], [0], [0]

    def add(self, before: str | None, after: str | None, context: int) -> bool:
        """Whether there is a difference."""
        old, new = (before or "").splitlines(), (after or "").splitlines()
        seq, number = 0, 0
        for start_old, start_new, lines in align.hunks(_keep_ends(before), _keep_ends(after), context):
            ops = [op for op, _ in lines]
            self.ops += ops
            self.texts += [new[at] if op == "+" else old[at] for op, at in lines]
            self.seqs += range(seq, seq + len(lines))
            self.blocks += _blocks(ops)
            self.heads.append((number, start_old, start_new))
            self.line_ends.append(len(self.ops))
            self.block_ends.append(len(self.blocks))
            seq, number = seq + len(lines), number + 1
        if number:
            self.diff_ends.append(len(self.heads))
        return number > 0

    def column(self, kind: pa.DataType) -> pa.Array:
        def lists(ends: list[int], values: pa.Array, of: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, of)

        def structs(columns, of: pa.DataType) -> pa.Array:
            fields = [of.field(i) for i in range(of.num_fields)]
            return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)

        hunk = kind.value_type
        lines, blocks = hunk.field("lines").type, hunk.field("blocks").type
        return lists(
            self.diff_ends,
            structs(
                [
                    *(list(zip(*self.heads, strict=True)) or [[]] * 3),
                    lists(self.line_ends, structs([self.seqs, self.ops, self.texts], lines.value_type), lines),
                    lists(self.block_ends, structs(list(zip(*self.blocks, strict=True)) or [[]] * 3, blocks.value_type), blocks),
                ],
                hunk,
            ),
            kind,
        )


def diff_hunks(
    pairs: DataFrame, context: int = 3, partitions: int | None = None, carry: tuple[str, ...] = ("monitor_id", "created_at")
) -> DataFrame:
    """Line diff of every pair that has one, a row per diff: (diff_id, carry.., hunks).

    Both texts of a pair are one row already, and so is its diff: what is asked of a diff as a
    whole (its statistics, its text, what is left without noise, replaced lines) is computed
    inside the row, and no line has to move. `blocks` names the stretches of changed lines
    between context lines by their place in `lines`.
    """
    spread = pairs.repartition(partitions, "diff_id") if partitions else pairs
    spread = spread.select("diff_id", *carry, "text_before", "text_after")
    return spread.mapInArrow(*_diffing({f.name: f.dataType.simpleString() for f in spread.schema}, context, carry))


def _diffing(types: dict[str, str], context: int, carry: tuple[str, ...]):
    """A function over batches (diff_id, carry.., text_before, text_after), and the schema of the diffs it gives."""
    schema = ", ".join([*(f"{c} {types[c]}" for c in ("diff_id", *carry)), f"hunks {HUNKS}"])
    kind = to_arrow_schema(T.StructType.fromDDL(schema)).field("hunks").type

    def diff_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(i) for i in range(1 + len(carry))]
            before, after = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            take, found = [], _Hunks()

            def flush():
                picks = pa.array(take, pa.int32())
                return pa.RecordBatch.from_arrays([*(key.take(picks) for key in keys), found.column(kind)], names=["diff_id", *carry, "hunks"])

            for i in range(batch.num_rows):
                if found.add(before[i].as_py(), after[i].as_py(), context):
                    take.append(i)
                if len(found.ops) >= 20_000:
                    yield flush()
                    take, found = [], _Hunks()
            if take:
                yield flush()

    return diff_batches, schema


def hunk_lines(diffs: DataFrame) -> DataFrame:
    """One row per line of diffs in hunks: (diff_id, carry.., seq, hunk_no, before_start, after_start, op, text)."""
    carry = [c for c in diffs.columns if c != "hunks"]
    hunks = diffs.select(*carry, F.inline("hunks")).drop("blocks")
    lines = hunks.select(*carry, "hunk_no", "before_start", "after_start", F.inline("lines"))
    return lines.select(*carry, "seq", "hunk_no", "before_start", "after_start", "op", "text")


def all_lines(hunks: Column) -> Column:
    return F.flatten(hunks["lines"])


def diff_snapshots(
    pairs: DataFrame, context: int = 3, partitions: int | None = None, carry: tuple[str, ...] = ("monitor_id", "created_at")
) -> DataFrame:
    """Line diff of every pair, one row per line: (diff_id, carry.., seq, hunk_no, before_start, after_start, op, text)."""
    return hunk_lines(diff_hunks(pairs, context, partitions, carry))


def _range_text(start: Column, length: Column) -> Column:
    """A unified-diff range: the count is left out when it is 1, an empty range names the line before it."""
    begin = F.when(length == 0, start).otherwise(start + 1)
    return F.when(length == 1, begin.cast("string")).otherwise(F.concat_ws(",", begin.cast("string"), length.cast("string")))


def _hunk_header(hunk: Column, lines: Column) -> Column:
    """The header of one hunk of `diff_hunks`."""
    counted = lambda other: F.size(F.filter(lines, lambda s: s["op"] != other))
    return F.concat(
        F.lit("@@ -"), _range_text(hunk["before_start"], counted("+")), F.lit(" +"), _range_text(hunk["after_start"], counted("-")), F.lit(" @@")
    )


def _with_hunk_headers(lines: DataFrame) -> DataFrame:
    """One row per hunk: its header text and its lines in order. A hunk is part of one document."""
    header = F.concat(
        F.lit("@@ -"),
        _range_text(F.col("before_start"), F.col("n_before")),
        F.lit(" +"),
        _range_text(F.col("after_start"), F.col("n_after")),
        F.lit(" @@"),
    )
    return (
        lines.groupBy("diff_id", "hunk_no")
        .agg(
            F.first("before_start").alias("before_start"),
            F.first("after_start").alias("after_start"),
            F.count_if(F.col("op") != "+").alias("n_before"),
            F.count_if(F.col("op") != "-").alias("n_after"),
            F.count_if(F.col("op") == "+").alias("added"),
            F.count_if(F.col("op") == "-").alias("removed"),
            F.sum(F.octet_length("text") + 2).alias("line_bytes"),
        )
        .withColumn("header", header)
    )


FILE_HEADER = ["--- previous", "+++ current"]


def diff_stats(lines: DataFrame) -> DataFrame:
    """lines_added, lines_removed, changed_hunks and the size of the unified text, without rendering it.

    `lines` are rows of lines, or diffs in hunks (`diff_hunks`), which are measured where they are.
    """
    file_bytes = sum(len(h) + 1 for h in FILE_HEADER)
    if "hunks" in lines.columns:
        rows, ops = all_lines(F.col("hunks")), all_lines(F.col("hunks"))["op"]
        size = lambda texts: F.aggregate(texts, F.lit(0).cast("long"), lambda n, x: n + x)
        return lines.select(
            "diff_id",
            F.size(F.filter(ops, lambda op: op == "+")).cast("long").alias("lines_added"),
            F.size(F.filter(ops, lambda op: op == "-")).cast("long").alias("lines_removed"),
            F.size("hunks").cast("long").alias("changed_hunks"),
            (
                size(F.transform(rows["text"], lambda t: F.octet_length(t) + 2))
                + size(F.transform("hunks", lambda h: F.octet_length(_hunk_header(h, h["lines"])) + 1))
                + file_bytes
            ).alias("diff_size_bytes"),
        )
    hunks = _with_hunk_headers(lines)
    return hunks.groupBy("diff_id").agg(
        F.sum("added").alias("lines_added"),
        F.sum("removed").alias("lines_removed"),
        F.count(F.lit(1)).alias("changed_hunks"),
        (F.sum(F.col("line_bytes") + F.octet_length("header") + 1) + file_bytes).alias("diff_size_bytes"),
    )


def mark_identical(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Statistics for every pair, zeros and `is_identical` where the diff is empty."""
    counts = ["lines_added", "lines_removed", "changed_hunks", "diff_size_bytes"]
    return pairs.join(stats, "diff_id", "left").withColumns(
        {"is_identical": F.col("changed_hunks").isNull(), **{c: F.coalesce(F.col(c), F.lit(0)) for c in counts}}
    )


def render_unified(lines: DataFrame, headers: DataFrame | None = None, name: str = "unified_diff", keep_end: bool = True) -> DataFrame:
    """Unified text per diff. `headers` keeps the ranges of the unfiltered diff when `lines` is a filtered one.

    Diffs in hunks (`diff_hunks`) are rendered inside their row.
    """
    top = "\n".join(FILE_HEADER) + "\n"
    if "hunks" in lines.columns:
        body = lambda h: F.concat_ws("\n", _hunk_header(h, h["lines"]), F.transform(h["lines"], lambda s: F.concat(s["op"], s["text"])))
        whole = F.concat(F.lit(top), F.array_join(F.transform("hunks", body), "\n"), F.lit("\n" if keep_end else ""))
        return lines.select("diff_id", whole.alias(name))
    hunks = _with_hunk_headers(lines if headers is None else headers)
    body = lines.select("diff_id", "hunk_no", F.col("seq"), F.concat("op", "text").alias("line"))
    present = lines.select("diff_id", "hunk_no").distinct()
    tops = hunks.join(present, ["diff_id", "hunk_no"], "left_semi").select(
        "diff_id", "hunk_no", F.lit(-1).alias("seq"), F.col("header").alias("line")
    )
    text = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "seq", "line"))), lambda s: s["line"]), "\n"
    )
    return (
        body.unionByName(tops)
        .groupBy("diff_id")
        .agg(F.concat(F.lit(top), text, F.lit("\n" if keep_end else "")).alias(name))
    )


def last_change(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy("monitor_id").agg(F.max("created_at").alias("last_change_at"))
