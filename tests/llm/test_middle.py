"""Fill-in-middle against a plain implementation over code points."""

import hashlib
import random
import re

import pytest

from changeflow.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text, percent=50):
    text, h = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    units = UNIT.findall(text)
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


PIECES = ["a", "word", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "\x85", "\xa0", "ß", "日本", "🙂", "　", "é", "<", ">", "<P", "S>", "\x00", "\x7f", "ࠠ", "਍"]


def test_marks_each_byte():
    for value in range(256):
        for place in range(8):
            word = fim.words_of_bytes(b"x" * place + bytes([value]) + b"x" * (7 - place))[:1]
            want = 0x80 << (8 * place) if value == 0x20 or 9 <= value <= 13 else 0
            assert int(fim.blank_marks(word)[0]) == want


def test_equals_plain_on_random_texts():
    rnd = random.Random(12)
    for k in range(3000):
        text = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40)))
        n, form, before, middle, output = fim.transform(str(k), text.encode(), fim=100)
        assert (n, form, before, middle, output.decode()) == plain(k, text, 100)
        assert fim.restore(output, form).decode() == text


def test_every_cut():
    rnd = random.Random(13)
    for size in [*range(0, 40), 200]:
        text = "".join(rnd.choice(PIECES) for _ in range(size))
        units = UNIT.findall(text)
        ends, counts = fim.unit_ends(text.encode())
        for k in range(len(units) + 1):
            assert fim.cut_after(k, ends, counts, len(text.encode())) == len("".join(units[:k]).encode())


def test_long_text():
    text = "ein langes Wörtchen\n" * 700_000
    got = fim.transform("3", text.encode(), fim=100)
    assert got[:4] == plain(3, text, 100)[:4] and got[4].decode() == plain(3, text, 100)[4]
    one = "y" * 11_000_000
    assert fim.transform("1", one.encode(), fim=100)[0] == 1


@pytest.mark.parametrize("percent", [0, 50, 100])
def test_table(spark, docs, odd, percent):
    rows = [*odd, (20, "has <P> in it"), (21, "and <M>"), (22, "<S>"), (23, "<"), (24, "a <P < S> b <"), (None, None)]
    df = fim.fill_in_middle(docs(rows), fim=percent)
    got = fim.restored(df).collect()
    assert len(got) == len(rows)
    want = [plain(i, t, percent) for i, t in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == sorted((i is None, i or 0, *w) for (i, _), w in zip(rows, want, strict=True))
    assert all(r.restored == (r.text or "") for r in got)


def test_empty_and_clashing(spark):
    schema = "n string, doc_id string, Form int, text string, _draw double, output string, prefix_chars int, middle_chars int"
    made = fim.fill_in_middle(spark.createDataFrame([("x", "k1", 3, "one two three", None, "kept", None, 9)], schema))
    assert made.columns == [*schema.replace(" string", "").replace(" int", "").replace(" double", "").split(", "), "_n", "_form", "_prefix_chars", "_middle_chars", "_output"]
    row = made.first()
    assert (row.n, row.Form, row.output, row.middle_chars) == ("x", 3, "kept", 9)
    assert (row["_n"], row["_form"], row["_output"]) == (3, plain("k1", "one two three")[1], plain("k1", "one two three")[4])
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = fim.op12_fill_in_middle(spark, sf).collect()
    assert len(got) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        want = plain(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (*want[:4], sha(want[4]), sha(texts[r.doc_id] or ""))
