"""Vector codes and vector links against plain Python over the same rows."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from changeflow.llm import embedding_links, vector_codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def lloyd(rows, positions=8, entries=16, rounds=6):
    """Plain Python integers, one part after the other: codebooks, and (code, error) by row."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // positions)
    parts = []
    for _, vector, _ in kept:
        whole = [math.floor(4096 * float(np.float32(x))) for x in vector] + [0] * (positions * width - len(vector))
        parts.append([whole[p * width : (p + 1) * width] for p in range(positions)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    books = [[parts[i][p] for i in order[:entries]] for p in range(positions)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    own = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(positions):
            members = defaultdict(list)
            for x in parts:
                members[own(x[p], books[p])].append(x[p])
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if members[e] else b for e, b in enumerate(books[p])]
    out = []
    for row, x in zip(kept, parts, strict=True):
        code = [own(x[p], books[p]) for p in range(positions)]
        out.append((row[0], row[2], "".join(f"{c:02x}" for c in code), sum(far(x[p], books[p][c]) for p, c in enumerate(code))))
    return books, out


def odd_vectors(seed=1, n=150, size=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, size))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.1 * rng.standard_normal(size)], i % 3 if i % 7 else None) for i in range(n)]
    rows += [rows[5], rows[5], (900, rows[6][1], 1), (None, rows[7][1], 2), (None, rows[7][1], 2)]
    rows += [(901, None, 1), (902, [0.5] * (size - 1) + [None], 1), (903, [math.nan] * size, 2), (904, [math.inf] + [1.0] * (size - 1), 0), (905, [0.0] * size, 1), (905, [0.0] * size, 1)]
    return rows


def check_codes(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA)
    books, want = lloyd(rows, **how)
    got = vector_codes.fit_codebooks(df, **how)
    assert [[list(map(int, e)) for e in p] for p in got] == books
    coded = vector_codes.encode(df, got).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1]), r[2], r[3])
    assert sorted(map(key, coded)) == sorted(map(key, want))


def test_codes_equal_plain_lloyd(spark):
    check_codes(spark, odd_vectors())


@pytest.mark.parametrize("rounds", [1, 2, 12])
def test_codes_other_parameters(spark, rounds):
    check_codes(spark, odd_vectors(seed=rounds, n=60), positions=4, entries=5, rounds=rounds)


def test_codes_of_odd_tables(spark):
    check_codes(spark, [])
    check_codes(spark, [(1, None, 1), (2, [math.nan], 1)])
    check_codes(spark, [(1, [0.25, -0.3], 1), (2, [], None), (3, [7.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0], 1)])
    check_codes(spark, [(3, [1.0] * 8, None), (3, [-1.0] * 8, None), (1, [1e6] * 8, 0), (2, [-3e5] * 8, 0)])
    check_codes(spark, [(i, [], 1) for i in range(3)])


def test_huge_components_do_not_wrap(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 0), (2, [-1e30] * 8, 0), (3, [1.0] * 8, 0)], SCHEMA)
    books = vector_codes.fit_codebooks(df, entries=1)
    assert books[0, 0, 0] == 4096 // 3
    assert {r.vec_id: r.error for r in vector_codes.encode(df, books).collect()}[1] == 2**63 - 1


def test_distances_exact_in_either_form():
    rng = np.random.default_rng(3)
    for most in (1 << 12, 1 << 24, 1 << 40):
        parts, book = rng.integers(-most, most, (20, 8)), rng.integers(-most, most, (5, 8))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c, strict=True)) for c in book] for x in parts]
        assert vector_codes.distances(parts, book.astype(object)).tolist() == want


def test_moved_parts_only(spark):
    """What a round writes is what changes its owner, and the sums stay those of the residents."""
    rows = [r for r in odd_vectors(n=80) if r[1] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    seen, store = [], vector_codes.cut_lineage

    def watch(table, name):
        out = store(table, name)
        if name.startswith("residents"):
            seen.append([(r.position, r.was, r.entry, r.weight) for r in out.collect()])
        return out

    vector_codes.cut_lineage = watch
    try:
        vector_codes.fit_codebooks(df)
    finally:
        vector_codes.cut_lineage = store
    kept = sum(1 for r in rows if all(x is not None and math.isfinite(x) for x in r[1]))
    assert sum(r[3] for r in seen[0]) == 8 * kept and all(r[1] == -1 for r in seen[0])
    for later in seen[1:]:
        assert all(r[1] != r[2] and r[1] >= 0 for r in later) and sum(r[3] for r in later) < 8 * kept


def test_codes_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    books, want = lloyd(rows)
    digest = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    totals = defaultdict(int)
    for _, label, _, error in want:
        totals[label] += error
    got = vector_codes.op11_vector_codes(spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == sorted((i, c, e, totals[label], digest) for i, label, c, e in want)


def brute_links(rows, threshold=0.93):
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: vector_unit(rows[i][1]) for i in good}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and float(unit[a] @ unit[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], links[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)]


def vector_unit(vector):
    x = np.array(vector, np.float64)
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def same_links(spark, rows, schema=SCHEMA, **how):
    got = embedding_links.linked_vectors(spark.createDataFrame(rows, schema), **how).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_links(rows)))
    return got


def clustered(seed, n, size, spread):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((max(2, n // 12), size))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    made = base[rng.integers(0, len(base), n)] + rng.uniform(0, spread, (n, 1)) * rng.standard_normal((n, size)) / math.sqrt(size)
    return [(int(i), [float(np.float32(x)) for x in v], int(i) % 3) for i, v in zip(rng.permutation(n), made, strict=True)]


@pytest.mark.parametrize(("size", "spread", "slices"), [(64, 0.5, 1 << 21), (64, 0.5, 2048), (100, 0.45, 4096), (5, 0.4, 640), (1, 0.3, 1 << 21)])
def test_links_equal_brute_force(spark, size, spread, slices):
    got = same_links(spark, clustered(size, 400, size, spread), slice_coordinates=slices)
    assert size == 1 or 0 < sum(r.n_links for r in got) < 400 * 399


def test_links_of_odd_rows(spark):
    rows = odd_vectors() + [(910, [1.0], 1), (911, [3.0], 1), (912, [], 1), (913, [1e38] * 16, 2), (914, [1e-38] * 16, 2), (915, [-1.0] * 16, 2)]
    same_links(spark, rows)
    same_links(spark, rows, slice_coordinates=1024)
    assert embedding_links.linked_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    same_links(spark, [(1, None, None), (2, [1.0, 2.0], None)])


def test_links_with_other_columns(spark):
    rows = [(1, "x", [1.0, 0.0], "a", 5), (2, "y", [1.0, 0.01], "a", 6), (3, "z", [1.0, 0.0], None, 7)]
    df = spark.createDataFrame(rows, "vec_id long, member string, embedding array<double>, label string, size int")
    assert sorted(map(tuple, embedding_links.linked_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    renamed = df.withColumnsRenamed({"vec_id": "cell", "embedding": "code"})
    assert sorted(map(tuple, embedding_links.linked_vectors(renamed, id_col="cell", vector="code").collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(64)
    rows = [(i, [float(np.float32(x)) for x in centre + 0.12 * rng.standard_normal(64)], 0) for i in range(1500)]
    rows += [(5000 + i, rows[0][1], 0) for i in range(200)]
    got = embedding_links.linked_vectors(spark.createDataFrame(rows, SCHEMA), slice_coordinates=64 * 300).collect()
    unit = np.array([vector_unit(r[1]) for r in rows])
    want = ((unit @ unit.T) >= 0.93).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in got} == {r[0]: int(w) for r, w in zip(rows, want, strict=True)}
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_estimates_are_unbiased_and_bounded():
    """Over many rotations the mean estimate is the cosine; true pairs fall below the bound never."""
    rng = np.random.default_rng(4)
    x = vector_unit(rng.standard_normal(64))
    side = rng.standard_normal(64)
    side = vector_unit(side - (side @ x) * x)
    for cosine in (0.2, 0.6, 0.93):
        pair = np.array([x, cosine * x + math.sqrt(1 - cosine**2) * side])
        estimates, kept = [], 0
        for seed in range(1500):
            codes = decoded(pair, seed)
            estimates.append(float(codes.estimate(slice(0, 1), slice(1, 2))[0, 0]))
            kept += bool(codes.candidates(slice(0, 1), slice(1, 2), 0.93, 5.0)[0, 0])
        assert abs(np.mean(estimates) - cosine) < 4 * np.std(estimates) / math.sqrt(1500) + 1e-3
        assert kept == 1500 if cosine == 0.93 else kept < (1500 if cosine == 0.6 else 15)


def decoded(pair, seed):
    code, factor, low, step, level = embedding_links.encode(pair, *embedding_links.rotation(pair.shape[1], seed))
    return embedding_links.Codes([c.tobytes() for c in code], factor, low, step, [f.tobytes() for f in level])


def test_unlike_pairs_are_not_computed(spark):
    """Of unlike vectors only a small part is left to exact computation."""
    rng = np.random.default_rng(6)
    unit = np.array([vector_unit(v) for v in rng.standard_normal((1000, 64))])
    mask = decoded(unit, 1).candidates(slice(0, 1000), slice(0, 1000), 0.93, 5.0)
    assert np.triu(mask, 1).sum() < 50


def test_links_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, embedding_links.op13_embedding_links(spark, SF).collect())) == sorted(brute_links(rows))
