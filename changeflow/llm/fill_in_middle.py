"""Fill-in-middle: texts cut into prefix, middle and suffix at unit ends, found eight bytes at a time.

A unit is a word with the blanks before it; blanks after the last word are a unit of their own.
So a unit ends at a byte that is no blank while the next one is, and at the end of the text.
The UTF-8 bytes are viewed as 64-bit words; blanks are marked by additions that cannot carry
from byte to byte, a word's ends are its marks against the marks moved down by one byte,
`bitwise_count` gives the ends per word, a search in the running counts finds the word that
holds the k-th end, and clearing lowest marks finds the byte in it. No unit is ever written out.

The place of the cuts and the form depend on the seed and the id alone. `plain` leaves the
text as it is, `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` `<S>`suffix`<P>`prefix`<M>`middle.

Defined cases: a null text counts as empty; an empty text, and one that holds a sentinel, stays
plain; a null id counts as the empty text in the draw; equal rows give equal rows; an empty
table gives none; other columns are carried by `fill_in_middle` (its own get underscores before
their names where these are taken) and left out by the query. Texts are never cut into blocks:
a text of any length takes a few times its bytes in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read

SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_SPACES = np.uint64(0x2020202020202020)
#: Added to seven bits, these reach the eighth from 9 and from 14 on: tab to carriage return lie between.
_FROM_TAB, _PAST_RETURN = np.uint64(0x7777777777777777), np.uint64(0x7272727272727272)


def words_of_bytes(text: bytes) -> np.ndarray:
    """The bytes as little-endian 64-bit words, filled up with spaces, one more word of them at the end."""
    return np.frombuffer(text.ljust(len(text) // 8 * 8 + 16, b" "), np.dtype("<u8"))


def blank_marks(words: np.ndarray) -> np.ndarray:
    """The eighth bit of every byte that is a space or a control from tab to carriage return."""
    low = words & _LOW
    between = (low + _FROM_TAB) & ~(low + _PAST_RETURN) & ~words
    other = words ^ _SPACES
    space = ~(((other & _LOW) + _LOW) | other)
    return (between | space) & _HIGH


def unit_ends(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the bytes that end a word, per 64-bit word, and their running count."""
    blanks = blank_marks(words_of_bytes(text))
    after = (blanks[:-1] >> np.uint64(8)) | (blanks[1:] << np.uint64(56))
    ends = ~blanks[:-1] & _HIGH & after
    return ends, np.cumsum(np.bitwise_count(ends), dtype=np.int64)


def cut_after(k: int, ends: np.ndarray, counts: np.ndarray, size: int) -> int:
    """The number of bytes in the first k units."""
    if k == 0:
        return 0
    if not len(counts) or k > counts[-1]:
        return size
    at = int(np.searchsorted(counts, k))
    word = int(ends[at])
    for _ in range(k - (int(counts[at - 1]) if at else 0) - 1):
        word &= word - 1
    return at * 8 + (word & -word).bit_length() // 8


def code_points(text: bytes) -> int:
    """Code points of valid UTF-8: the bytes that do not continue one."""
    words = np.frombuffer(text.ljust(-(-len(text) // 8) * 8, b"\x80"), np.dtype("<u8"))
    continuing = words & ~(words << np.uint64(1)) & _HIGH
    return 8 * len(words) - int(np.bitwise_count(continuing).sum(dtype=np.int64))


def transform(doc_id: str, text: bytes, seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, bytes]:
    """Units, form, code points of prefix and middle (none if plain), output."""
    ends, counts = unit_ends(text)
    n = (int(counts[-1]) if len(counts) else 0) + (1 if text[-1:] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") else 0)
    draw = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= fim or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (cut_after(k, ends, counts, len(text)) for k in (first, last))
    before, middle, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, output = "spm", b"".join((SUFFIX, after, PREFIX, before, MIDDLE, middle))
    else:
        form, output = "psm", b"".join((PREFIX, before, SUFFIX, after, MIDDLE, middle))
    return n, form, code_points(before), code_points(middle), output


def restore(output: bytes, form: str) -> bytes:
    """The text that `transform` was given. No sentinel can arise across a seam: none begins as one ends."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    first, _, rest = output[len(PREFIX) :].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return first + middle + other if form == "psm" else other + middle + first


def _bytes(cell: pa.Scalar) -> bytes:
    return cell.as_buffer().to_pybytes() if cell.is_valid else b""


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = SEED, fim: int = FIM_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """All columns of `df`, and `n`, `form`, `prefix_chars`, `middle_chars`, `output`."""
    kinds = {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType(), "output": T.StringType()}
    names = {name: fresh(df.columns, name) for name in kinds}
    key, given = fresh(df.columns, "_draw"), df.columns
    width = len(given)
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    at, text_type = given.index(text), df.schema[text].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            rows = [transform(i.as_py() or "", _bytes(t), seed, fim, spm) for i, t in zip(batch.column(width), texts, strict=True)]
            made = []
            for k, kind in enumerate(arrow):
                values = [r[k] for r in rows]
                made.append(pa.array(values, pa.binary()).view(pa.string()) if k == 4 else pa.array(values, kind))
            yield pa.RecordBatch.from_arrays(batch.columns[:width] + made, names=[*given, *names.values()])

    schema = T.StructType([*df.schema.fields, *(T.StructField(names[n], t) for n, t in kinds.items())])
    if not isinstance(text_type, (T.StringType, T.BinaryType)):
        raise TypeError(f"{text} holds no text")
    return df.withColumn(key, F.col(f"`{id_col}`").cast("string")).mapInArrow(run, schema)


def restored(df: DataFrame, output: str = "output", form: str = "form", name: str = "restored") -> DataFrame:
    """All columns of `df`, and the text rebuilt from output and form alone."""
    given = df.columns
    a, b = given.index(output), given.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outputs = batch.column(a).cast(pa.binary())
            texts = [restore(_bytes(o), f.as_py()) for o, f in zip(outputs, batch.column(b), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).view(pa.string())], names=[*given, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256")
    )


ORACLE_OP12 = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM docs),
placed AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM placed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
