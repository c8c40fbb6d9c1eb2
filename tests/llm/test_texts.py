"""Byte pairs, fingerprints, languages, quality scores and context trees against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from changeflow.llm import bpe, context_tree, language_id, quality_model, winnowing
from changeflow.llm.common import id_remainder


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


PARTS = ["the", "in", "g", "an", "er", " ", "  ", "ß", "é", "!", "--", "'s", "'re", "1", "²", "\x1c", "\u3000", "<|endoftext|>", "日", "\n", "\t"]


def test_ids_equal_the_library(merges, library):
    rnd, encoder = random.Random(5), bpe.Encoder(merges)
    for _ in range(150):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 300)))
        ids = np.frombuffer(b"".join(encoder.stream(text)), "<u4").tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want
        decoder = bpe.Decoder(merges.token_bytes)
        assert "".join(decoder.feed(i.to_bytes(4, "little")) for i in ids) + decoder.close() == library.decode(want, skip_special_tokens=False)


def test_transducer_equals_merging(merges):
    rnd = random.Random(6)
    for k in range(20):
        n = rnd.randint(100, 2000)
        piece = "".join(rnd.choice("aeinrst") for _ in range(n)) if k % 2 else rnd.choice("a-= ") * n
        one = bpe.Transducer(merges)
        data = piece.encode()
        assert one.feed(data[: n // 3]) + one.feed(data[n // 3 :]) + one.close() == merges.merge(data)


def test_transducer_forgets(merges):
    one = bpe.Transducer(merges)
    most = 0
    for _ in range(60):
        one.feed(b"thequickbrownfoxjumpsoverthelazydog" * 10)
        most = max(most, len(one.data), len(one.last))
    assert most < 4096


def test_chunks_do_not_show(merges, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 40)
    rnd, encoder = random.Random(7), bpe.Encoder(merges)
    for _ in range(150):
        text = "".join(rnd.choice(PARTS[:11] + ["'s", "'re", "\n"]) for _ in range(200))
        assert [p for ps in encoder.pieces(text) for p in ps] == regex.findall(bpe.PATTERN, text)


def test_invalid_bytes_decode_as_the_library(merges, library):
    rnd = random.Random(8)
    for _ in range(200):
        ids = [rnd.randrange(50256) for _ in range(rnd.randint(1, 30))]
        decoder = bpe.Decoder(merges.token_bytes)
        assert "".join(decoder.feed(i.to_bytes(4, "little")) for i in ids) + decoder.close() == library.decode(ids, skip_special_tokens=False)


def test_round_trip_table(docs, odd, library):
    rows = bpe.round_trip(docs(odd), bpe.tokenizer_path()).collect()
    want = Counter()
    for key, text in odd:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[key, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.round_trip(docs([]), bpe.tokenizer_path()).count() == 0
    ids = bpe.encode(docs(odd), bpe.tokenizer_path())
    assert Counter(r["text"] for r in bpe.decode(ids, bpe.tokenizer_path()).collect()) == Counter(t or "" for _, t in odd)


def plain_winnow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    if not text:
        return []
    gram = min(gram, len(text))
    hashes = [int(winnowing.winnow(text[i : i + gram], gram, 1)[0][0]) for i in range(len(text) - gram + 1)]
    window, out = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = i + max(k for k in range(window) if hashes[i + k] == least)
        if not out or out[-1][1] != at:
            out.append((least, at))
    return out


@pytest.mark.parametrize("text", ["", "a", "abcdefg", "a" * 40, "the quick brown fox jumps over the lazy dog " * 4, "éa" * 50])
def test_winnowing_is_the_definition(text, monkeypatch):
    want = plain_winnow(text)
    for block in (5, 16, 1 << 18):
        monkeypatch.setattr(winnowing, "BLOCK", block)
        hashes, at = winnowing.winnow(text)
        assert list(zip(hashes.tolist(), at.tolist(), strict=True)) == want


def test_shared_passages_share_fingerprints():
    rnd = random.Random(1)
    letters = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    for _ in range(100):
        passage = letters(winnowing.GRAM + winnowing.WINDOW - 1)
        a, b = letters(50) + passage + letters(50), letters(80) + passage + letters(9)
        assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_neighbours(docs, odd):
    rows = winnowing.compare_neighbours(docs([(i, t) for i, t in odd if i not in (4, None)])).collect()
    ordered = sorted([(i, t or "") for i, t in odd if i not in (4, None)], reverse=True)
    got = {r["doc_id"]: r for r in rows}
    for at, (key, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        sets = [{h for h, _ in plain_winnow(x)} for x in (text, edited, following)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key]["near_edited"] == pytest.approx(like(sets[0], sets[1]))
        assert got[key]["near_next"] == pytest.approx(like(sets[0], sets[2]))
    assert winnowing.compare_neighbours(docs(odd)).count() == len(odd)
    assert winnowing.compare_neighbours(docs([])).count() == 0
    assert winnowing.compare_neighbours(docs([(1, "alone in the table")])).first()["near_next"] == 1.0


def test_word_scores_sum_all_segmentations():
    pieces = language_id.Pieces(language_id.vocabulary_path())
    place = {p: i for i, p in enumerate(pieces.pieces)}
    table = np.random.default_rng(0).random((len(pieces.pieces), 3))
    table /= table.sum(axis=0)
    words = [b" hello", b" the", " été".encode(), b"x" * language_id.RUN, b"\0\0ab", b" a"]
    got = language_id.word_scores(pieces, words, table)
    for word, row in zip(words, got, strict=True):
        ahead = [np.ones(3)]
        for end in range(1, len(word) + 1):
            ahead.append(sum((ahead[end - n] * table[place[word[end - n : end]]] for n in range(1, min(language_id.PIECE, end) + 1) if word[end - n : end] in place), np.zeros(3)))
        assert np.allclose(np.log(ahead[-1]), row)


def test_expected_counts_cover_the_words():
    pieces = language_id.Pieces(language_id.vocabulary_path())
    counts = language_id.expected_counts(pieces, [b" hello", b" of", b"z" * 30], np.array([[2.0, 0], [1, 1], [0, 3]]))
    assert np.allclose(counts.T @ pieces.sizes, [6 * 2 + 3, 3 + 90])


@pytest.mark.parametrize("at_once", [1 << 16, 50])
def test_no_piece_and_no_word_is_cut(monkeypatch, at_once):
    """Long pieces and long words, in scripts with and without blanks, against the plain recursion."""
    monkeypatch.setattr(language_id, "_AT_ONCE", at_once)
    pieces = language_id.Pieces(language_id.vocabulary_path())
    place = {p: i for i, p in enumerate(pieces.pieces)}
    assert len(place) == 50_256 and pieces.longest == max(map(len, place)) == language_id.PIECE
    table = np.random.default_rng(1).random((len(place), 2))
    table /= table.sum(axis=0)
    longest = [p for p in pieces.pieces if len(p) > 20]
    words = [" announcement".encode(), " enormément".encode(), (" " + "これは長い文章であり、切れ目がありません。" * 9).encode(), b" " + b"".join(longest), b" " + b"abcdefghij" * 40, b" the"]
    got, flat = language_id.word_scores(pieces, words, table), 1 / len(place)
    for word, row in zip(words, got, strict=True):
        n, ends = len(word), [[b for b in range(a + 1, min(a + 33, len(word)) + 1) if word[a:b] in place] for a in range(len(word))]
        ahead, same, back = [np.full(2, -np.inf) for _ in range(n + 1)], [-np.inf] * (n + 1), [-np.inf] * (n + 1)
        ahead[0], same[0], back[n] = np.zeros(2), 0.0, 0.0
        for a in range(n):
            for b in ends[a]:
                ahead[b] = np.logaddexp(ahead[b], ahead[a] + np.log(table[place[word[a:b]]]))
                same[b] = np.logaddexp(same[b], same[a] + np.log(flat))
        for a in reversed(range(n)):
            for b in ends[a]:
                back[a] = np.logaddexp(back[a], back[b] + np.log(flat))
        want = np.zeros(len(place))
        for a in range(n):
            for b in ends[a]:
                want[place[word[a:b]]] += np.exp(same[a] + np.log(flat) + back[b] - same[n])
        assert np.allclose(ahead[n], row)
        assert np.allclose(language_id.expected_counts(pieces, [word], np.array([[2.0]]))[:, 0], 2 * want)
    assert np.array_equal(language_id.word_scores(pieces, words[::-1], table)[::-1], got)


def test_languages(docs, odd):
    rnd = random.Random(2)
    en, de = ["the", "and", "thing", "with", "nation"], ["der", "und", "nicht", "schön", "über"]
    rows = [(100 + i, " ".join(rnd.choice(en if i % 2 else de) for _ in range(12)), "en" if i % 2 else "de") for i in range(80)]
    marked = docs(rows + odd).withColumn("teaches", id_remainder(F.col("doc_id"), 4) != 2)
    got = language_id.predict(marked, "teaches", language_id.vocabulary_path()).collect()
    assert len(got) == len(rows) + len(odd)
    right = {i: lang for i, _, lang in rows}
    for row in got:
        if row["doc_id"] in right:
            assert row["lang_pred"] == right[row["doc_id"]] and 0 <= row["score"] <= 1
        if row["doc_id"] in (1, 2, 3):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    kept = language_id.keep_known(marked, "teaches", language_id.vocabulary_path())
    assert kept.columns == marked.columns and kept.filter("doc_id IN (1, 2, 3)").count() == 0 and kept.filter("doc_id >= 100").count() == 80
    assert language_id.predict(marked.limit(0), "teaches", language_id.vocabulary_path()).count() == 0
    untaught = docs(odd).withColumn("teaches", F.lit(True))
    assert {r["lang_pred"] for r in language_id.predict(untaught, "teaches", language_id.vocabulary_path()).collect()} == {"und"}


def test_rare_script_does_not_hide_the_language():
    """48 bytes that no language has seen, against tables of many counted pieces."""
    path = language_id.vocabulary_path()
    pieces = language_id.Pieces(path)
    english, german = (language_id.expected_counts(pieces, language_id.words_in(t), np.ones((len(t.split()), 1)))[:, 0] for t in ("the and thing with nation", "der und nicht schön über"))
    table = np.stack([german * (1e8 / german.sum()), english * (1e6 / english.sum())], axis=1)
    table = (table + language_id.SMOOTHING) / (table.sum(axis=0) + language_id.SMOOTHING * len(table))
    words = ["བོད་ཡིག་བོད་ཡི", "ᏣᎳᎩᏣᎳᎩᏣᎳᎩᏣᎳᎩᏣᎳᎩᏣ"]
    assert np.isfinite(language_id.word_scores(pieces, [w.encode() for w in words], table)).all()
    model = SimpleNamespace(value=(["de", "en"], table, np.log([0.5, 0.5])))
    texts = pa.RecordBatch.from_arrays([pa.array([f"{'the nation and the thing ' * 40} {w} with the nation" for w in words])], names=["text"])
    (_, names, scores), *_ = language_id._judge(iter([texts]), "text", path, model)
    assert names == ["en", "en"] and min(scores) > 0.99


def test_held_out_languages(spark):
    found = language_id.op9_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def test_discriminant_is_the_formula():
    rnd = np.random.default_rng(3)
    d = len(quality_model.FEATURES)
    x = [rnd.normal(size=(300, d)), rnd.normal(1.0, 2.0, size=(500, d))]
    own = [np.cov(v.T, bias=True) for v in x]
    both = (300 * own[0] + 500 * own[1]) / 800
    scale = np.sqrt(np.diag(both))
    want = []
    points = rnd.normal(size=(20, d))
    factors, logdets, means = [], [], []
    for k in (0, 1):
        c = (0.98 * own[k] + 0.02 * both) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * np.eye(d) * np.trace(c) / d + 1e-9 * np.eye(d)
        full = c * np.outer(scale, scale)
        z = points - x[k].mean(axis=0)
        want.append(math.log((300, 500)[k] / 800) - 0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(full), z) + np.linalg.slogdet(full)[1]))
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower) / scale[None, :])
        logdets.append(2 * np.log(np.diag(lower)).sum() + 2 * np.log(scale).sum())
        means.append(x[k].mean(axis=0))
    model = quality_model.Discriminant(np.array(means), np.array(factors), np.array(logdets), np.log([300 / 800, 500 / 800]))
    assert np.allclose(model.scores(points), 1 / (1 + np.exp(want[0] - want[1])))


def test_fit_equals_numpy(spark):
    rnd = np.random.default_rng(4)
    d = len(quality_model.FEATURES)
    x = [rnd.normal(size=(40, d)), rnd.normal(1.0, 2.0, size=(60, d))]
    rows = [(k, v.tolist()) for k in (0, 1) for v in x[k]] + [(None, [0.0] * d)]
    model = quality_model.fit(spark.createDataFrame(rows, "label int, features array<double>").repartition(3))
    assert np.allclose(model.means, [v.mean(axis=0) for v in x]) and np.allclose(np.exp(model.shares), [0.4, 0.6])


def test_one_class_and_none(spark):
    schema = "label int, features array<double>"
    zero = [0.0] * len(quality_model.FEATURES)
    assert quality_model.fit(spark.createDataFrame([(1, zero)], schema)).scores(np.zeros((2, len(zero)))).tolist() == [1.0, 1.0]
    assert quality_model.fit(spark.createDataFrame([(0, zero)], schema)).scores(np.zeros((1, len(zero)))).tolist() == [0.0]
    assert quality_model.fit(spark.createDataFrame([], schema)).scores(np.zeros((1, len(zero)))).tolist() == [0.5]


def test_quality_of_odd_rows(docs, odd):
    rows = quality_model.with_features(docs(odd)).collect()
    assert len(rows) == len(odd) and all(np.isfinite(r["features"]).all() for r in rows)


def test_held_out_quality(spark):
    scored = quality_model.op2_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    right = scored.filter("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0]
    assert right > 0.97


def plain_tree(rows, depth):
    train = [context_tree.words_of_text(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    tokens = Counter(w for words in train for w in [*words, b""])
    total = sum(tokens.values())
    seen = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]

    def decisions(words):
        data = b"\n" * depth + b" ".join(words) + b"\n"
        for i in range(depth, len(data)):
            for k in range(8):
                yield [(data[i - d : i], 1 << k | data[i] >> 8 - k) for d in range(depth + 1)], data[i] >> 7 - k & 1

    for words in train:
        for path, bit in decisions(words):
            for d, key in enumerate(path):
                seen[d][key][bit] += 1
    own = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, stop = {}, {}
    for d in range(depth, -1, -1):
        children = defaultdict(float)
        for (context, node), value in weighted.items():
            children[context[1:], node] += value
        weighted = {}
        for key, (a, b) in seen[d].items():
            e, c = own(a, b), children[key]
            weighted[key] = e if d == depth else max(e, c) + math.log1p(math.exp(-abs(e - c))) - math.log(2)
            stop[key] = 1 / (1 + math.exp(max(-700, min(700, c - e))))
    out = []
    for key, text in rows:
        words, score = context_tree.words_of_text(text), 0.0
        for path, bit in decisions(words):
            best, mixed, left = 0.5, 0.0, 1.0
            for d, node in enumerate(path):
                if node not in seen[d]:
                    break
                a, b = seen[d][node]
                one = (b + 0.5) / (a + b + 1)
                best = mixed + left * one
                mixed += left * stop[node] * one
                left *= 1 - stop[node]
            score += math.log10(best if bit else 1 - best)
        words = [*words, b""]
        base = sum(math.log10((tokens[w] + 0.1) / (total + 0.1 * (len(tokens) + 1))) for w in words)
        out.append((key, len(words), sum(tokens[w] > 0 for w in words), total, base, score))
    return out


@pytest.mark.parametrize("depth", [2, context_tree.DEPTH])
def test_context_tree_is_the_recursion(docs, odd, depth):
    rows = [(i, (t or "")[:400]) if t and len(t) > 400 else (i, t) for i, t in odd] + [(30 + i, f"The cat sat on the mat {i} times, and the CAT sat.") for i in range(12)]
    got = context_tree.score_texts(docs(rows), id_remainder(F.col("doc_id"), 10) == 0, depth=depth).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    want = sorted(plain_tree(rows, depth), key=order)
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=order)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_context_tree_without_training(docs):
    assert context_tree.score_texts(docs([]), F.lit(True)).count() == 0
    row = context_tree.score_texts(docs([(1, "ab")]), F.lit(True)).first()
    assert row["score"] == pytest.approx(-24 * math.log10(2)) and row["train_tokens"] == 0 and row["n_known"] == 0


def test_number_signs_are_no_letters(docs):
    """Superscripts, circled and Roman numbers, marks and digits make no word of any language; one letter does."""
    rows = [(i, t, "en" if i % 2 else "de") for i, t in enumerate(["the words of a text", "die Wörter im Text"] * 20)]
    odd = [(100, "² ½"), (101, "①②"), (102, "Ⅷ"), (103, "١٢٣ 4"), (104, "́ _ !"), (105, "² a"), (106, "日"), (107, "ª")]
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs(rows + odd).withColumn("teaches", F.col("doc_id") < 100), "teaches", language_id.vocabulary_path()).collect()}
    assert {got[i] for i in range(100, 105)} == {"und"}
    assert "und" not in {got[i] for i in (105, 106, 107)}


def test_no_rows_no_languages(docs):
    assert language_id.predict(docs([]).withColumn("teaches", F.lit(True)), "teaches", language_id.vocabulary_path()).collect() == []
