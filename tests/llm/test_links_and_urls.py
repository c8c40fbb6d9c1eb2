"""Near copies, url rules and the pipeline against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changeflow.llm import language_id, near_join, quality_rules, url_rules


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_classes(rows):
    texts = sorted({t or "" for _, t in rows})
    sets = {t: plain_sets(t) for t in texts}
    alike = lambda a, b: (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) >= 0.8
    links = {t: [o for o in texts if o != t and alike(t, o)] for t in texts}
    ids = defaultdict(list)
    for key, text in rows:
        ids[text or ""].append(key)
    out = Counter()
    for key, text in rows:
        reach, todo = {text or ""}, [text or ""]
        while todo:
            for other in links[todo.pop()]:
                if other not in reach:
                    reach.add(other)
                    todo.append(other)
        least = min((i for t in reach for i in ids[t] if i is not None), default=None)
        out[key, least, len(links[text or ""]), len(ids[text or ""])] += 1
    return out


def near_copies(seed, n_groups=6, size=12, length=60):
    rnd, rows = random.Random(seed), []
    for _ in range(n_groups):
        words = [f"w{rnd.randrange(500)}" for _ in range(length)]
        for _ in range(rnd.randint(1, size)):
            copy = list(words)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(length)] = f"x{rnd.randrange(500)}"
            rows.append((len(rows) + 1, " ".join(copy)))
    return rows


def test_prefixes_reach_the_recall():
    lengths = near_join.prefix_lengths()
    miss = 1.0
    for x in lengths:
        miss *= 1 - near_join.THRESHOLD**x
    assert 1 - miss >= near_join.TARGET and max(lengths) - min(lengths) <= 1


@pytest.mark.parametrize("cell", [256, 4])
def test_classes(docs, odd, monkeypatch, cell):
    """Also with cells so small that every group is cut into slices."""
    monkeypatch.setattr(near_join, "SLICE", cell)
    rows = odd + [(100 + i, t) for i, t in near_copies(3)]
    got = near_join.near_classes(docs(rows)).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert Counter(map(tuple, got)) == plain_classes(rows)


def test_no_documents(docs):
    assert near_join.near_classes(docs([])).count() == 0


def test_long_chain_is_one_component(spark):
    edges = [(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(60)] + [(b"zz", b"zy")]
    found = {bytes(r["node"]): bytes(r["root"]) for r in near_join.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert all(found[i.to_bytes(2, "big")] == b"\0\0" for i in range(1, 61)) and found[b"zz"] == b"zy"


def test_near_stage_keeps_one(spark, docs, odd):
    rows = odd + [(100 + i, t) for i, t in near_copies(4)]
    table = docs(rows).withColumn("class_id", F.lit("mine")).withColumn("Kept_Id", F.lit(1))
    kept = near_join.near_stage(spark, table, "")
    assert kept.columns == table.columns
    left = [r["doc_id"] for r in kept.collect()]
    assert Counter(left) == Counter({least for _, least, _, _ in plain_classes(rows)})


def test_ids_do_not_make_classes(spark, docs):
    """Several null ids, near copies with null ids only or among others, and one id with two different texts."""
    words = [[f"{k}w{i}" for i in range(60)] for k in range(6)]
    near = [" ".join([*w[:-1], "other"]) for w in words]
    whole = [" ".join(w) for w in words]
    rows = [(None, whole[0]), (None, near[0]), (None, whole[1]), (None, whole[1]), (None, whole[2]), (7, whole[3]), (7, whole[4]), (7, near[4]), (None, whole[5]), (9, near[5])]
    classes = near_join.near_classes(docs(rows))
    assert Counter(map(tuple, classes.select("doc_id", "class_id", "n_links", "n_copies").collect())) == plain_classes(rows)
    assert classes.select("class_key").distinct().count() == 6
    kept = [(r["doc_id"], r["text"]) for r in near_join.near_stage(spark, docs(rows), "").collect()]
    of = {t: k for k in range(6) for t in (whole[k], near[k])}
    assert sorted(of[t] for _, t in kept) == [0, 1, 2, 3, 4, 5]
    assert {of[t]: i for i, t in kept} == {0: None, 1: None, 2: None, 3: 7, 4: 7, 5: 9}


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path):
    fits = [(h + p, v) for h, p, v in url_rules.EXPLICIT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


URLS = [
    None, "", "no scheme", "http://", "https://a.org", "https://A.ORG/x?y=1#z", "http://www.example.org/es/1", "http://example.org/en/12?x", "http://example.org/en/2",
    "http://badexample.org/es/", "ftp://x.com/de/9", "http://com/fr/", "http://y.com/fr", "http://y.net/de/1?http://z.org/", "http://ÄB.com/de/", "http://u@x.com:80/de/", "a://b://c.com/de/",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:4])], "page_id long, url string, host string, verdict string")
    got = url_rules.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 4
    for row in got:
        url = (URLS + URLS[:4])[row["page_id"]]
        host, path = plain_host_path(url)
        rule, verdict = plain_rule(host, path)
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == (verdict or "allow")


def test_mined_rules_block(spark):
    rows, labels = [], []
    for i in range(400):
        spam = i % 4 == 0
        rows.append((i, f"http://{'cheap' if spam else 'fine'}{i % 3}.pills.net/{'buy' if spam else 'read'}/{i}"))
        if i % 2 == 0:
            labels.append((i, 0 if spam else 1, 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    said = spark.createDataFrame([*labels, (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.filter_urls(pages, said).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


def test_index_equals_scan(spark):
    rnd = random.Random(1)
    rows = [([f"t{rnd.randrange(12)}" for _ in range(6)], rnd.choice(["block", "allow"])) for _ in range(300)]
    rows = [(sorted(set(t)), "block" if {"t1", "t2"} <= set(t) or "t5" in t else label) for t, label in rows]
    rules = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.9, 3)
    kept = [set(r["tokens"]) for r in rules.collect()]
    assert {"t5"} in kept and not any({"t5"} < r for r in kept)
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "row long, tokens array<string>")
    got = {r["row"]: r["blocked"] for r in url_rules.judge(urls, rules).collect()}
    assert all(got[i] == any(r <= set(t) for r in kept) for i, (t, _) in enumerate(rows))


def test_no_pages(spark):
    assert url_rules.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against plain Python on its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(step)))
        docs = spark.read.parquet(str(tmp_path / str(step)))
        after = docs.collect()
        if name == "quality rules":
            failed = {r["doc_id"]: r["failed_bits"] for r in quality_rules.ledger(spark.createDataFrame(before, docs.schema)).collect()}
            assert Counter(r["doc_id"] for r in after) == Counter(i for i, bits in failed.items() if not bits)
        if name == "language ID":
            marked = spark.createDataFrame(before, docs.schema).withColumn("teaches", ~language_id._held_out(F.col("doc_id")))
            told = language_id.predict(marked, "teaches", language_id.vocabulary_path()).filter("lang_pred <> 'und' AND score >= 0.5")
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in told.collect())
        if name == "n-gram Jaccard join":
            classes = plain_classes([(r["doc_id"], r["text"]) for r in before])
            assert Counter(r["doc_id"] for r in after) == Counter({least for _, least, _, _ in classes})
        if name == "packing":
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            assert sum(r["length"] for r in after) == sum({r["doc_id"]: r["doc_tokens"] for r in after}.values())
        else:
            assert docs.columns == columns


def test_oracle_matches(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    cursor = con.execute(near_join.ORACLE_OP3)
    names = [d[0] for d in cursor.description]
    got = near_join.op3_near_join(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(names)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(cursor.fetchall())
