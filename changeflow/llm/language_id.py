"""Language identification by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary, of all lengths. A word (between
blanks, in lower case, with a blank before it) has many segmentations into pieces; its
probability in a language is the sum over all of them of the products of piece
probabilities, which a forward pass gives. A text's score is the product over its words.

Learning is one expectation step: from equal probabilities a forward and a backward pass
give the expected count of every piece in every word; counts are added up per language in
the tasks and then by Spark, so at most languages x vocabulary rows reach the driver, the
model's own size. Words are handled once per task, many at a time, as arrays.

Only text and language are learned from, over all rows that are not held out. Words of more
than `RUN` bytes are parted where no piece of the vocabulary lies across, which leaves the sum
as it is; what is still longer is passed over byte by byte in logarithms. Nothing is cut off.

Defined cases: null texts and texts without a letter (Unicode's L; number signs are none) are
`und` with score 0; an empty table gives none; rows without a
language teach nothing; without any language to learn all is `und`; repeated rows repeat;
columns that clash are left alone by the filter and not carried by `predict`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, id_remainder, read

#: Bytes of the vocabulary's longest piece, and of the longest words that are handled as rows of a matrix.
PIECE, RUN, SMOOTHING = 33, 48, 0.1
_GROUPS = (8, 12, 16, 20, 24, 32, RUN)
#: Words handled together: their arrays should fit a core's cache.
_ROWS = 4096
_REMEMBERED, _REMEMBERED_BYTES = 1_000_000, 1 << 26
#: Bytes of a long word whose pieces are looked up together.
_AT_ONCE = 1 << 16
#: Words less probable than this in a language are summed again in logarithms.
LEAST = 1e-250
_LETTER = regex.compile(r"\p{L}")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class Pieces:
    """The vocabulary's pieces in a tree of their bytes, read from the last byte on."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            found = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
        found |= {bytes([b]) for b in range(256)}
        self.pieces = sorted(found)
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.longest = int(self.sizes.max())
        letters = np.frombuffer(b"".join(p.rjust(self.longest, b"\0") for p in self.pieces), np.uint8).reshape(-1, self.longest)
        nodes, self.levels = np.zeros(len(self.pieces), np.int64), []
        for size in range(1, self.longest + 1):
            ids = np.flatnonzero(self.sizes >= size)
            keys, own = np.unique(nodes[ids] << 8 | letters[ids, -size], return_inverse=True)
            bits = 8 * size if size <= 2 else len(keys).bit_length() + 2
            slot = self._slot(keys, size, bits)
            order = np.argsort(slot, kind="stable")
            unique, first, count = np.unique(slot[order], return_index=True, return_counts=True)
            table = np.full(1 << bits, -1, np.int32)
            table[unique] = first
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            nodes[ids] = place[own]
            here = np.flatnonzero(self.sizes == size)
            piece = np.full(len(keys), -1, np.int32)
            piece[nodes[here]] = here
            self.levels.append((table, keys[order], piece, int(count.max()), bits))

    @staticmethod
    def _slot(keys: np.ndarray, size: int, bits: int) -> np.ndarray:
        if size <= 2:
            return keys
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)

    def down(self, nodes: np.ndarray, letters: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child by their letter, and the children; nodes of one slot lie side by side."""
        table, own, _, tries, bits = self.levels[size - 1]
        keys = nodes << 8 | letters
        at = table[self._slot(keys, size, bits)]
        rows = np.flatnonzero(at >= 0)
        at, keys = at[rows].astype(np.int64), keys[rows]
        same = own[at] == keys
        for _ in range(tries - 1):
            off = np.flatnonzero(~same)
            at[off] = np.minimum(at[off] + 1, len(own) - 1)
            same[off] = own[at[off]] == keys[off]
        return rows[same], at[same]

    def ending(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ends, sizes, pieces) of all pieces of one word that end in low + 1 .. high, ends in order."""
        ends = np.arange(low + 1, high + 1)
        nodes, out = np.zeros(len(ends), np.int64), []
        for size in range(1, self.longest + 1):
            inside = ends >= size
            ends, nodes = ends[inside], nodes[inside]
            kept, nodes = self.down(nodes, data[ends - size], size)
            ends = ends[kept]
            if not len(ends):
                break
            found = self.levels[size - 1][2][nodes]
            hits = np.flatnonzero(found >= 0)
            out.append((ends[hits], np.full(len(hits), size), found[hits]))
        ends, sizes, found = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(ends, kind="stable")
        return ends[order], sizes[order], found[order]


def _groups(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, lengths, bytes as a matrix) of words of similar length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for high in _GROUPS:
        at = np.flatnonzero((lengths > low) & (lengths <= high))
        low = high
        for part in range(0, len(at), _ROWS):
            rows = at[part : part + _ROWS]
            joined = b"".join([words[i].ljust(high, b"\0") for i in rows])
            yield rows, lengths[rows], np.frombuffer(joined, np.uint8).reshape(len(rows), high)


def _steps(pieces: Pieces, matrix: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, size, rows, pieces) for every piece that ends at `end`, ends in order."""
    n, wide = matrix.shape
    columns = np.ascontiguousarray(matrix.T).astype(np.int64)
    for end in range(1, wide + 1):
        rows, nodes = np.arange(n), np.zeros(n, np.int64)
        for size in range(1, min(pieces.longest, end) + 1):
            kept, nodes = pieces.down(nodes, columns[end - size][rows], size)
            rows = rows[kept]
            if not len(rows):
                break
            found = pieces.levels[size - 1][2][nodes]
            hits = np.flatnonzero(found >= 0)
            if len(hits):
                yield end, size, rows[hits], found[hits]


def _parts(pieces: Pieces, word: bytes) -> list[bytes]:
    """The word cut wherever no piece of the vocabulary lies across: every segmentation has these cuts."""
    data, crossed = np.frombuffer(word, np.uint8), np.zeros(len(word) + 1, np.int64)
    for low in range(0, len(word), _AT_ONCE):
        ends, sizes, _ = pieces.ending(data, low, min(len(word), low + _AT_ONCE))
        first = max(0, low - pieces.longest)  # where the earliest of these pieces can begin
        here = np.bincount(ends - sizes + 1 - first, minlength=ends[-1] + 1 - first) - np.bincount(ends - first, minlength=ends[-1] + 1 - first)
        crossed[first : first + len(here)] += here
    cuts = np.flatnonzero(np.cumsum(crossed) == 0)
    cuts = [0, *cuts[(cuts > 0) & (cuts < len(word))].tolist(), len(word)]
    return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _parted(pieces: Pieces, words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(parts, words, places): the distinct parts of words over RUN bytes and the other words; which word has which."""
    known = _Known()
    places = [[known[p] for p in _parts(pieces, word)] if len(word) > RUN else [known[word]] for word in words]
    return list(known), np.repeat(np.arange(len(words)), [len(p) for p in places]), np.concatenate([np.array(p) for p in places])


def _long_score(pieces: Pieces, word: bytes, logs: np.ndarray) -> np.ndarray:
    """A word of any length in logarithms; only the sums that a piece can reach back to are held."""
    data, alpha = np.frombuffer(word, np.uint8), np.zeros((1, logs.shape[1]))
    for low in range(0, len(word), _AT_ONCE):
        high = min(len(word), low + _AT_ONCE)
        ends, sizes, found = pieces.ending(data, low, high)
        cuts = np.searchsorted(ends, np.arange(low + 1, high + 2)).tolist()
        shift = len(alpha) - 1 - low
        alpha = np.concatenate([alpha, np.zeros((high - low, logs.shape[1]))])
        begins = ends - sizes + shift
        for end, a, b in zip(range(low + 1, high + 1), cuts[:-1], cuts[1:], strict=True):
            alpha[end + shift] = np.logaddexp.reduce(alpha[begins[a:b]] + logs[found[a:b]], axis=0)
        alpha = alpha[-pieces.longest :]
    return alpha[-1]


def _long_counts(pieces: Pieces, word: bytes) -> np.ndarray:
    """Expected count of each piece in a word of any length, all pieces equally likely before."""
    data, n, flat = np.frombuffer(word, np.uint8), len(word), -np.log(len(pieces.pieces))
    alpha, beta, out = np.zeros(n + 1), np.zeros(n + 1), np.zeros(len(pieces.pieces))
    for low in range(0, n, _AT_ONCE):
        high = min(n, low + _AT_ONCE)
        ends, sizes, _ = pieces.ending(data, low, high)
        cuts, begins = np.searchsorted(ends, np.arange(low + 1, high + 2)).tolist(), ends - sizes
        for end, a, b in zip(range(low + 1, high + 1), cuts[:-1], cuts[1:], strict=True):
            alpha[end] = np.logaddexp.reduce(alpha[begins[a:b]]) + flat
    for low in reversed(range(0, n, _AT_ONCE)):
        high = min(n, low + _AT_ONCE)
        ends, sizes, found = pieces.ending(data, low, min(n, high + pieces.longest))
        begins = ends - sizes
        order = np.argsort(begins, kind="stable")
        order = order[(begins[order] >= low) & (begins[order] < high)]
        begins, ends, found = begins[order], ends[order], found[order]
        cuts = np.searchsorted(begins, np.arange(low, high + 1)).tolist()
        for begin in range(high - 1, low - 1, -1):
            beta[begin] = np.logaddexp.reduce(beta[ends[cuts[begin - low] : cuts[begin - low + 1]]]) + flat
        out += np.bincount(found, np.exp(alpha[begins] + beta[ends] + flat - alpha[n]), len(out))
    return out


def word_scores(pieces: Pieces, words: list[bytes], table: np.ndarray) -> np.ndarray:
    """Natural log of the sum over all segmentations, per word and language."""
    if any(len(word) > RUN for word in words):
        parts, owners, places = _parted(pieces, words)
        longer = [i for i, part in enumerate(parts) if len(part) > RUN]
        each = word_scores(pieces, [b"" if len(part) > RUN else part for part in parts], table)
        for i in longer:
            each[i] = _long_score(pieces, parts[i], np.log(table))
        return np.stack([np.bincount(owners, each[places, k], len(words)) for k in range(table.shape[1])], axis=1)
    out, logs = np.zeros((len(words), table.shape[1])), np.log(table)
    for at, lengths, matrix in _groups(words):
        alpha = np.zeros((matrix.shape[1] + 1, len(at), table.shape[1]))
        alpha[0] = 1
        for end, size, rows, found in _steps(pieces, matrix):
            alpha[end][rows] += alpha[end - size][rows] * table[found]
        last = alpha[lengths, np.arange(len(at))]
        # No alpha is over 1, so what got lost below LEAST on the way is nothing beside a larger end.
        low = np.flatnonzero((last < LEAST).any(axis=1))
        last[low] = 1
        out[at] = np.log(last)
        if len(low):
            out[at[low]] = _log_scores(pieces, lengths[low], matrix[low], logs)
    return out


def _log_scores(pieces: Pieces, lengths: np.ndarray, matrix: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The same sums in logarithms, for words too improbable for a plain product."""
    alpha = np.full((matrix.shape[1] + 1, len(matrix), logs.shape[1]), -np.inf)
    alpha[0] = 0
    for end, size, rows, found in _steps(pieces, matrix):
        alpha[end][rows] = np.logaddexp(alpha[end][rows], alpha[end - size][rows] + logs[found])
    return alpha[lengths, np.arange(len(matrix))]


def expected_counts(pieces: Pieces, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected count of each piece per language, all pieces equally likely before."""
    flat = 1.0 / len(pieces.pieces)
    out = np.zeros((len(pieces.pieces), weights.shape[1]))
    if any(len(word) > RUN for word in words):
        words, owners, places = _parted(pieces, words)
        weights = np.stack([np.bincount(places, weights[owners, k], len(words)) for k in range(weights.shape[1])], axis=1)
        for i, word in enumerate(words):
            if len(word) > RUN:
                out += _long_counts(pieces, word)[:, None] * weights[i]
    for at, lengths, matrix in _groups(words):
        steps = list(_steps(pieces, matrix))
        alpha = np.zeros((matrix.shape[1] + 1, len(at)))
        alpha[0] = 1
        for end, size, rows, _ in steps:
            alpha[end][rows] += alpha[end - size][rows] * flat
        beta = np.zeros_like(alpha)
        beta[lengths, np.arange(len(at))] = 1 / alpha[lengths, np.arange(len(at))]
        shares, places = [], []
        for end, size, rows, _ in reversed(steps):
            back = beta[end][rows] * flat  # nothing comes back from beyond a word's end
            shares.append(alpha[end - size][rows] * back)
            places.append(rows)
            beta[end - size][rows] += back
        if not steps:
            continue
        found, share, place = np.concatenate([s[3] for s in reversed(steps)]), np.concatenate(shares), at[np.concatenate(places)]
        for k in range(weights.shape[1]):
            out[:, k] += np.bincount(found, share * weights[place, k], len(out))
    return out


def words_in(text: str) -> list[bytes]:
    """Words with a blank before them."""
    return [b" " + word for word in text.lower().encode().split()]


class _Known(dict):
    """Word -> its number, in order of first sight."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        self.size += len(word)
        return value

    def full(self) -> bool:
        return len(self) > _REMEMBERED or self.size > _REMEMBERED_BYTES


def _counter(path: str, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, order = Pieces(path), {language: i for i, language in enumerate(languages)}
        total = np.zeros((len(pieces.pieces), len(languages)))
        texts = np.zeros(len(languages), np.int64)
        known, counts = _Known(), []

        def settle() -> None:
            nonlocal total, known, counts
            if known:
                weights = np.zeros((len(known), len(languages)))
                for k in range(len(languages)):
                    own = [ids for language, ids in counts if language == k]
                    if own:
                        weights[:, k] = np.bincount(np.concatenate(own), minlength=len(known))
                total += expected_counts(pieces, list(known), weights)
            known, counts = _Known(), []

        pending = 0
        for batch in batches:
            for text, language in zip(batch.column(0), batch.column(1), strict=True):
                k = order.get(language.as_py())
                found = words_in(text.as_py() or "")
                if k is None or not found:
                    continue
                texts[k] += 1
                counts.append((k, np.fromiter(map(known.__getitem__, found), np.int32, len(found))))
                pending += len(found)
                if pending > 8_000_000 or known.full():
                    settle()
                    pending = 0
        settle()
        rows, columns = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(columns.astype(np.int32)), pa.array(rows.astype(np.int32)), pa.array(total[rows, columns])], names=["language", "piece", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(languages)), pa.int32()), pa.array([-1] * len(languages), pa.int32()), pa.array(texts.astype(np.float64))], names=["language", "piece", "n"])

    return run


def learn(df: DataFrame, teaches: str, path: str, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray | None, np.ndarray | None]:
    """(languages, piece probabilities, log shares of the languages) from the rows where `teaches` holds."""
    rows = df.filter(F.col(f"`{teaches}`") & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    languages = sorted(row["lang"] for row in rows.select("lang").distinct().collect())  # one row per language
    if not languages:
        return [], None, None
    counted = rows.mapInArrow(_counter(path, languages), "language int, piece int, n double").groupBy("language", "piece").agg(F.sum("n").alias("n")).toPandas()  # at most languages x vocabulary
    inside = counted[counted["piece"] >= 0]
    table = np.zeros((len(Pieces(path).pieces), len(languages)))
    table[inside["piece"], inside["language"]] = inside["n"].round(6)
    table = (table + SMOOTHING) / (table.sum(axis=0) + SMOOTHING * len(table))
    share = np.zeros(len(languages))
    texts = counted[counted["piece"] < 0]
    share[texts["language"]] = texts["n"]
    return languages, table, np.log((share + 1) / (share + 1).sum())


def _judge(batches: Iterator[pa.RecordBatch], column: str, path: str, model) -> Iterator[tuple[pa.RecordBatch, list[str], list[float]]]:
    """Each batch with its predicted languages and their posterior probabilities."""
    pieces = Pieces(path)
    languages, table, share = model.value
    known, scores = _Known(), np.zeros((0, len(languages)))
    for batch in batches:
        each: list[np.ndarray | None] = []
        if known.full():
            known, scores = _Known(), scores[:0]
        before = len(known)
        for value in batch.column(batch.schema.get_field_index(column)):
            text = value.as_py() or ""
            if languages and _LETTER.search(text):
                found = words_in(text)
                each.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
            else:
                each.append(None)
        if len(known) > before:
            new = list(known)[before:]
            scores = np.concatenate([scores, word_scores(pieces, new, table)])
        names, values = [], []
        for ids in each:
            if ids is None:
                names.append("und")
                values.append(0.0)
                continue
            total = scores[ids].sum(axis=0) + share
            best = int(total.argmax())
            names.append(languages[best])
            values.append(float(1 / np.exp(total - total[best]).sum()))
        yield batch, names, values


def predict(df: DataFrame, teaches: str, path: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row: the id, `teaches`, the predicted language and its posterior probability."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, teaches, path, text, lang))  # languages x vocabulary numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, values in _judge(batches, text, path, model):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["doc_id", "teaches", "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{teaches}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, teaches boolean, lang_pred string, score double")


def keep_known(df: DataFrame, teaches: str, path: str, least: float = 0.5, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose language is told with a posterior probability of `least` at least."""
    model = df.sparkSession.sparkContext.broadcast(learn(df, teaches, path, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, names, values in _judge(batches, text, path, model):
            yield batch.filter(pa.array([n != "und" and v >= least for n, v in zip(names, values, strict=True)], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _held_out(column: Column) -> Column:
    return id_remainder(column, 4) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("teaches", ~_held_out(F.col("doc_id")))
    found = predict(docs, "teaches", vocabulary_path())
    return found.select("doc_id", (~F.col("teaches")).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; learned from those of them that are not held out."""
    mark = fresh(docs.columns, "teaches")
    marked = docs.withColumn(mark, ~_held_out(F.col("doc_id")))
    return keep_known(marked, mark, vocabulary_path()).drop(mark)
