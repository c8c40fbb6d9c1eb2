"""Quality rules, sharding and packing against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changeflow.llm import packing, quality_rules, sharding
from changeflow.llm.bpe import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_measures(docs, odd):
    more = [(20, "a b c a b c a b"), (21, "x y z w x y z"), (22, "a a a a"), (23, "p\nq\np\n\np ")]
    rows = quality_rules.ledger(docs(odd + more)).collect()
    assert len(rows) == len(odd + more)
    for row in rows:
        assert tuple(row[m] for m in quality_rules.MEASURES[:5]) == plain_measures(row["text"]), row["doc_id"]


def test_base_policy_and_bits(docs):
    good = " ".join(f"word{i}" for i in range(60))
    loop = "one two three four " * 30
    kept = {r["doc_id"]: r for r in quality_rules.ledger(docs([(1, good), (2, loop), (3, "short"), (4, None)])).collect()}
    bit = {name: 1 << i for i, name in enumerate(quality_rules.RULES)}
    assert kept[1]["failed_bits"] == 0
    assert kept[2]["failed_bits"] & quality_rules.BASE.mask == bit["repeated_windows"]
    assert kept[3]["failed_bits"] & bit["few_words"] and kept[4]["failed_bits"] == bit["few_words"]


def test_ablation(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (2,)], "failed_bits int")
    got = {r["rule"]: r for r in quality_rules.ablation(rows, quality_rules.BASE).collect()}
    assert (got["few_words"]["failed"], got["few_words"]["failed_alone"], got["few_words"]["kept_without"]) == (3, 2, 3)
    assert got["repeated_windows"]["failed"] == 2 and got["repeated_windows"]["bits_or"] == 3 and got["repeated_windows"]["bits_and"] == 2


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", 7, 8)], "doc_id long, text string, n_words int, Failed_Bits int")
    kept = quality_rules.quality_stage(spark, df, "")
    assert kept.columns == df.columns and kept.count() == 0
    assert quality_rules.ledger(df).columns[:4] == df.columns


def test_empty_tables(docs):
    empty = docs([])
    assert quality_rules.ledger(empty).count() == 0
    assert sharding.shard_rows(empty).count() == 0
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_rows_law(docs, odd):
    rows = sharding.shard_rows(docs(odd * 9), shards=7, points=16).collect()
    assert len(rows) == 9 * len(odd)
    by = {}
    for row in rows:
        by.setdefault(row["shard"], []).append(row["slot"])
    counts = [len(by.get(s, [])) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd * 9)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want


def test_flow_is_the_ring_walked_one_by_one():
    points = sharding.ring(5, 8)
    counts = [(7 * i) % 11 for i in range(len(points))]
    room = sharding.bounds(sum(counts), 5, 0.0)
    left, want = list(room), {}
    for own in (True, False):  # own arcs first, then what is over walks on
        for arc, n in enumerate(counts):
            for rank in range(n):
                if (arc, rank) in want:
                    continue
                at = arc
                if own and not left[points[at][1]]:
                    continue
                while not left[points[at][1]]:
                    at = (at + 1) % len(points)
                left[points[at][1]] -= 1
                want[arc, rank] = points[at][1]
    got = {(arc, rank): shard for arc, first, after, shard, _ in sharding.flow([s for _, s in points], counts, room) for rank in range(first, after)}
    assert got == want


def test_slack_moves_little():
    """With room to spare, a further shard takes keys mostly into itself."""
    keys = range(4000)

    def placed(shards):
        points = sharding.ring(shards, 64)
        home = {}
        for k in keys:
            at = zlib.crc32(str(k).encode())
            home[k] = next((i for i, (p, _) in enumerate(points) if p >= at), 0)
        counts = Counter(home.values())
        flows = sharding.flow([s for _, s in points], [counts.get(i, 0) for i in range(len(points))], sharding.bounds(len(keys), shards, 0.25))
        ranks, out = Counter(), {}
        for k in keys:
            rank = ranks[home[k]]
            ranks[home[k]] += 1
            out[k] = next(s for arc, a, b, s, _ in flows if arc == home[k] and a <= rank < b)
        return out

    before, after = placed(8), placed(9)
    moved = sum(before[k] != after[k] for k in keys)
    assert moved < 0.3 * len(keys)


def test_pieces_and_offsets(docs, odd):
    rows = packing.pack(docs(odd), tokenizer_path()).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for key, text in odd:
        ids = encode.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 1024):
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + 1024])
            want[key, at, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def plain_packing(lengths, capacity):
    """One pack after the other: the shortest pack that has room for the next length takes it."""
    packs = []
    for length in sorted(lengths, reverse=True):
        best = max((p for p in packs if capacity - sum(p) >= length), key=lambda p: capacity - sum(p), default=None)
        if best is None:
            packs.append([length])
        else:
            best.append(length)
    return packs


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_the_histogram(seed):
    import random

    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 64) for _ in range(400)] + [10] * 150
    histogram = dict(Counter(lengths))
    patterns = packing.pack_patterns(histogram, 64)
    held = Counter()
    for count, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 64
        for n, k in pattern:
            held[n] += k * count
    assert held == Counter(lengths)
    assert sum(c for c, _ in patterns) <= 1.05 * len(plain_packing(lengths, 64)) + 1


def test_ranks(spark):
    df = spark.createDataFrame([(k % 3, i) for i, k in enumerate([0] * 50 + list(range(40)))], "key int, i int")
    rows = packing.ranked(df, "key", ["i"], 4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["key"], []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_oracle_matches(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(quality_rules.ORACLE_OP10)
    names = [d[0] for d in cursor.description]
    got = quality_rules.op10_quality_rules(spark, "/root/testdata/sf0.001").select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(cursor.fetchall())
    assert got.filter(F.col("base_failed") & F.col("kept")).count() == 0
