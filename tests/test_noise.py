import re

import pytest
from pyspark.sql import functions as F

from changeflow.functions import constants as k
from changeflow.operators import noise

NOISE = [
    "2024-03-15T10:30:00", "2024-03-15 10:30", "1710500000", "1710500000123", "bundle.abc12.js", "chunk-deadbeef", 'csrf_token="abc123"',
    "session_id=xyz-789", "utm_source=google", "fbclid=IwAR0xyz", "gclid=Cj0KC", "ad-slot", "googletag", "© 2024", "Copyright 2024",
    "cookie-consent", "__cf_bm=", "nonce: r4nd0m", "deadbeefcafe.css",
]
REAL = ["Pro plan: $99 per month", "New feature: dashboards", "Updated 2024-03-15 10:30 with lower prices", "Copyright 2024 Acme Incorporated"]
SCHEMA = "diff_id int, monitor_id string, seq int, hunk_no int, before_start int, after_start int, op string, text string"


def frame(spark, rows, diff_id=1, monitor="m"):
    return spark.createDataFrame([(diff_id, monitor, i, h, 0, 0, op, text) for i, (h, op, text) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("text", NOISE)
def test_noise_lines(spark, text):
    assert noise.classify_noise_lines(frame(spark, [(0, "+", text)])).first().is_noise


def test_real_lines_survive(spark):
    marked = noise.classify_noise_lines(frame(spark, [(0, "+", t) for t in REAL])).collect()
    assert not any(r.is_noise for r in marked)


def test_global_patterns_mean_the_same_as_in_python(spark):
    texts = NOISE + REAL + [
        "x 12345678901234567890 y", "ABCDEF0123.woff2?v=1", "deadbeef.jsx and cafebabe99.png", "SESSION-ID : 'é-9' tail", "utm_campaign=été&x=1",
        "© 2024", "٢٠٢٤-٠١-٠٢ ١٠:٣٠", "gOOgle_AD doubleclick", "Nonce=ab cd", "ad_slot adslot ad slot", "",
    ]
    got = [r.residual for r in noise.strip_noise(frame(spark, [(0, "-", t) for t in texts])).orderBy("seq").collect()]
    want = []
    for t in texts:
        for p in k.GLOBAL_NOISE_PATTERNS:
            t = re.sub(p, "", t, flags=re.IGNORECASE)
        want.append(t.strip())
    assert got == want


def test_short_lines_are_noise_only_if_a_pattern_touched_them(spark):
    marked = noise.classify_noise_lines(frame(spark, [(0, "+", "Pro!"), (0, "+", "Pro!!"), (0, " ", "a"), (0, "-", "    "), (0, "-", "-- a real removed line"), (0, "+", "up 2024-03-15 10:30")]))
    assert [r.is_noise for r in marked.orderBy("seq").collect()] == [False, False, False, True, False, True]


def test_monitor_and_learned_patterns_in_order(spark):
    rows = [(0, "+", "visits: 12345"), (0, "+", "Build v12 utm_a=b"), (0, "+", "Build v12 and much more to say"), (0, "-", "plain text")]
    monitors = spark.createDataFrame([("m", [r"VISITS: \d+", "[broken"])], "monitor_id string, noise_patterns array<string>")
    learned = spark.createDataFrame([(1, [r"^Build\s+.+?$", r"^visits:\s+.+?$", r"^.{0,3}$"])], "diff_id int, learned_patterns array<string>")
    marked = noise.classify_noise_lines(noise.attach_patterns(frame(spark, rows), monitors, learned))
    got = {r.text: (r.is_noise, r.hit_patterns) for r in marked.collect()}
    # The monitor pattern came first, so the learned one saw an empty line and is no hit.
    assert got["visits: 12345"] == (True, [])
    assert got["Build v12 utm_a=b"] == (True, [r"^Build\s+.+?$"])
    assert got["plain text"] == (False, [])
    hits = {r.pattern: r["count"] for r in noise.learned_hits(marked).collect()}
    assert hits == {r"^Build\s+.+?$": 2}


def test_learned_pattern_that_leaves_text_is_no_hit(spark):
    learned = spark.createDataFrame([(1, ["word"])], "diff_id int, learned_patterns array<string>")
    marked = noise.classify_noise_lines(noise.attach_patterns(frame(spark, [(0, "+", "a word in a long line")]), None, learned))
    assert marked.first().hit_patterns == [] and not marked.first().is_noise


def test_filter_diffs_drops_empty_hunks(spark):
    rows = [(0, " ", "context"), (0, "-", "2024-01-01 10:00"), (0, "+", "2024-01-02 10:00"), (1, "-", "old price list"), (1, "+", "new price list"), (1, "+", "© 2024"), (1, " ", "tail")]
    only_noise = [(0, "-", "© 2023"), (0, "+", "© 2024")]
    lines = frame(spark, rows).union(frame(spark, only_noise, 2))
    got = {r.diff_id: r for r in noise.filter_diffs(lines, carry=("monitor_id",)).collect()}
    a, b = got[1], got[2]
    assert (a.original_lines, a.noise_lines_removed, a.is_empty_after_filter) == (5, 3, False)
    assert a.filtered_diff == "--- previous\n+++ current\n@@ -1,2 +1,3 @@\n-old price list\n+new price list\n tail"
    assert (b.original_lines, b.noise_lines_removed, b.is_empty_after_filter, b.filtered_diff, b.monitor_id) == (2, 2, True, None, "m")
    kept = noise.drop_empty_hunks(noise.classify_noise_lines(lines))
    assert {(r.diff_id, r.hunk_no) for r in kept.collect()} == {(1, 1)}


def test_patterns_as_of(spark, at):
    state = spark.createDataFrame(
        [
            ("m", "p", at(0), True, at(0)), ("m", "p", at(50), True, at(0)), ("m", "p", at(100), False, at(0)), ("m", "p", at(200), True, at(200)),
            ("m", "q", at(0), True, at(0)), ("n", "p", at(0), True, at(0)),
        ],
        "monitor_id string, pattern string, observed_at timestamp, is_active boolean, promoted_at timestamp",
    )
    decay_hours = 24 * 48.7
    times = {"at_start": 0, "early": 1, "at_end": 100, "gap": 150, "late": 201, "just_alive": decay_hours, "just_gone": 24 * 48.8, "p_gone": 200 + 24 * 48.8}
    diffs = spark.createDataFrame([(name, "m", at(h)) for name, h in times.items()], "diff_id string, monitor_id string, created_at timestamp")
    got = {}
    for r in noise.pattern_lists(noise.patterns_as_of(diffs, state)).collect():
        got[r.diff_id] = r.learned_patterns
    assert got == {"early": ["p", "q"], "at_end": ["p", "q"], "gap": ["q"], "late": ["p", "q"], "just_alive": ["p", "q"], "just_gone": ["p"]}


def test_valid_patterns(spark):
    df = spark.createDataFrame([("global", r"\d+"), ("monitor", "[invalid"), ("learned", r"\d+")], "source string, pattern string")
    assert {(r.source, r.is_valid) for r in noise.valid_patterns(df).collect()} == {("global", True), ("monitor", False), ("learned", True)}


def test_filter_plan_shuffles_once(spark):
    diffs = noise.filter_diffs(frame(spark, [(0, "+", "a line of text")]))
    diffs.collect()
    plan = diffs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "ArrowEvalPython" not in plan
    assert diffs.select(F.col("learned_hits")).schema[0].dataType.simpleString() == "map<string,int>"
