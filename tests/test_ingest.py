import pytest
from pyspark.sql import functions as F

from changeflow.operators import ingest

PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<nav>Menu</nav><h1>Pricing</h1><p>Pro plan:   $99<br>per month</p><!-- hidden --><noscript>Enable it</noscript>
<script>var x = "<p>no</p>";</script><div class="box wide" id="main"><p>Inside &amp; out</p></div><footer>&copy; 2024 Acme</footer></body></html>"""


@pytest.mark.parametrize(
    "html, selector, text",
    [
        (PAGE, None, "Menu\nPricing\nPro plan:   $99\nper month\nInside & out\n© 2024 Acme"),
        (PAGE, ".box", "Inside & out"),
        (PAGE, "div#main.wide p", "Inside & out"),
        (PAGE, "h1", "Pricing"),
        (PAGE, ".absent", "Menu\nPricing\nPro plan:   $99\nper month\nInside & out\n© 2024 Acme"),
        ("<p>One<p>Two <b>bold</span></div>", None, "One\nTwo\nbold"),
        ("<html><head><title>x<body><p>swallowed</p>", None, ""),
        ("<noscript>You need scripts</noscript><div id=root></div>", None, ""),
        ("a<!-- c -->b", None, "a\nb"),
        ("", None, ""),
        (None, None, ""),
    ],
)
def test_visible_text(html, selector, text):
    assert ingest.visible_text(html, selector) == text


def test_extract_and_fingerprint(spark):
    pages = spark.createDataFrame([(1, PAGE, ".box"), (2, PAGE, None)], "id int, raw_html string, sel string")
    out = ingest.fingerprint_text(ingest.extract_page_text(pages, selector_col="sel")).orderBy("id").collect()
    assert out[0].extracted_text == "Inside & out" and out[0].text_length == 12
    assert "Pro plan: $99\nper month" in out[1].extracted_text and len(out[1].text_hash) == 64


def test_page_flags(spark):
    rows = [
        ("a", "<NOSCRIPT>x", "short"),
        ("b", "<div>", "short"),
        ("c", "<noscript>", "y" * 100),
        ("d", "", "Please verify you're human " + "z" * 474),
        ("e", "", "Please verify you're human " + "z" * 473),
    ]
    df = spark.createDataFrame(rows, "id string, raw_html string, extracted_text string")
    js = {r.id: r.needs_rendering for r in ingest.flag_js_pages(df).collect()}
    assert js == {"a": True, "b": False, "c": False, "d": False, "e": False}
    bot = {r.id: r.is_bot_page for r in ingest.flag_bot_pages(df).collect()}
    assert bot == {"a": False, "b": False, "c": False, "d": False, "e": True}


@pytest.mark.parametrize(
    "url, problem",
    [
        ("https://example.com/pricing", None),
        ("http://8.8.8.8:8080/x?y=1", None),
        ("https://user@example.com/a", None),
        ("http://localhost/x", "localhost"),
        ("http://LOCALHOST:3000", "localhost"),
        ("http://127.0.0.1/", "localhost"),
        ("http://[::1]/", "localhost"),
        ("http://0.0.0.0/", "localhost"),
        ("http://10.1.2.3/", "private_or_reserved_address"),
        ("http://172.16.0.1/", "private_or_reserved_address"),
        ("http://172.32.0.1/", None),
        ("http://192.168.1.1/", "private_or_reserved_address"),
        ("http://169.254.169.254/meta", "private_or_reserved_address"),
        ("http://[fe80::1]/", "private_or_reserved_address"),
        ("http://[2606:4700::1111]/", None),
        ("ftp://example.com/", "scheme_not_allowed"),
        ("file:///etc/passwd", "scheme_not_allowed"),
        ("example.com", "scheme_not_allowed"),
        ("https:///path", "no_hostname"),
    ],
)
def test_url_problem(spark, url, problem):
    assert spark.range(1).select(ingest.url_problem(F.lit(url)).alias("p")).first().p == problem


def test_pattern_problems(spark):
    rows = [(r"\d+",), ("[invalid",), ("(a+)+b*",), ("x" * 501,), (r"(?P<n>a)(?P=n)",)]
    got = {r.pattern: r.pattern_problem for r in ingest.pattern_problems(spark.createDataFrame(rows, "pattern string")).collect()}
    assert [got[r[0]] for r in rows] == [None, "pattern_does_not_compile", "nested_quantifiers", "pattern_too_long", None]


def test_validate_monitors(spark, at):
    def row(i, url, user="u", deleted=None, name="n", patterns=(), page="blog"):
        return (f"m{i}", user, f"https://e.com/{url}" if url else "ftp://x", name, page, 6, list(patterns), at(i), deleted)

    rows = [
        row(0, "a"),
        row(1, "a"),  # same live URL
        row(2, "b", deleted=at(0)),
        row(3, "b"),  # free again: the other is deleted
        row(4, None),
        row(5, "c", patterns=["[bad"]),  # refused, so it does not count
        row(6, "c"),
        row(7, "d"),  # the limit of three is used up
        row(8, "a", user="v"),
        row(9, "z", user="v", name=""),
        row(10, "y", user="v", page="unknown"),
    ]
    schema = (
        "monitor_id string, user_id string, url string, name string, page_type string, check_interval_hours int, "
        "noise_patterns array<string>, created_at timestamp, deleted_at timestamp"
    )
    got = {r.monitor_id: r.reason for r in ingest.validate_monitors(spark.createDataFrame(rows, schema), 3).collect()}
    assert got == {
        "m0": None, "m1": "duplicate_url", "m2": "deleted", "m3": None, "m4": "scheme_not_allowed",
        "m5": "pattern_does_not_compile", "m6": None, "m7": "monitor_limit", "m8": None, "m9": "bad_name", "m10": "bad_page_type",
    }


def test_fold_attempts(spark, at):
    log = [(i, "a", at(i), ok, None if ok else "x" * 600) for i, ok in enumerate([True, False, False, True, False, False, False, False, False])]
    log += [(100 + i, "b", at(i), ok, None if ok else "e") for i, ok in enumerate([False, True])]
    df = spark.createDataFrame(log, "attempt_id int, monitor_id string, attempted_at timestamp, ok boolean, error string")
    a, b = ingest.fold_attempts(df).orderBy("monitor_id").collect()
    assert (a.last_status, a.consecutive_failures, a.auto_paused, len(a.last_error)) == ("failed", 5, True, 600)
    assert len(ingest.fold_attempts(df, max_error=500).orderBy("monitor_id").first().last_error) == 500
    assert a.next_check_at == at(14) and a.last_checked_at == at(3)
    assert (b.last_status, b.consecutive_failures, b.auto_paused, b.last_error) == ("success", 0, False, None)


def test_due_and_recent(spark, at):
    rows = [(i, True, at(-i), None, at(-0.25 * i)) for i in range(45)] + [(99, False, at(-1), None, at(-9))]
    df = spark.createDataFrame(rows, "monitor_id int, is_active boolean, next_check_at timestamp, deleted_at timestamp, last_checked_at timestamp")
    now = F.lit(at(-2))
    due = ingest.due_monitors(df, now).orderBy("place").collect()
    assert [r.monitor_id for r in due] == list(range(44, 1, -1))
    assert [r.batch_no for r in due] == [i // 20 for i in range(43)]
    fresh = ingest.skip_recent(df, F.lit(at(0)))
    assert {r.monitor_id for r in fresh.collect()} == set(range(2, 45)) | {99}
    assert ingest.skip_recent(df, now, force=True).count() == 46
