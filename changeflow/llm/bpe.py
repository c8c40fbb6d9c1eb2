"""Byte-pair encoding as a streaming transducer, and decoding as an incremental state machine.

A text goes through in chunks; a piece of the pre-tokenizer's pattern is final once three
characters after it are known. Short pieces are merged by rank and remembered in a bounded
table. A piece longer than the table's lookahead goes byte by byte through `Transducer`:
for each prefix it keeps only the last token of the prefix's encoding, which is the one
token that ends there and stands next to its predecessor unchanged when both are encoded
together. Prefixes form a tree; whatever bytes follow, the encoding goes on from one of
the last `lookahead` prefixes, so the tokens that all of those share are stable and leave
at once. The lookahead follows from the merge list: the bytes of its longest token.

Beyond the text itself, memory is bounded by the chunk, the tables and the lookahead.

Defined cases: null and empty texts give no ids; the special token's string inside a text
becomes its id, and the text on either side is encoded by itself; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import read

#: The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for the standard library, on characters where both agree (see _PLAIN).
_FAST = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters outside the set on which the two patterns are known to agree.
_PLAIN = r"[^\t\n\r -~¡-±´-¸º»¿-ÿ]"

CHUNK = 1 << 18
REMEMBERED = 600_000
_NONE = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a tokenizer file, with the lookahead they imply."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        top = max([*vocabulary.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * top
        for text, i in vocabulary.items():
            self.token_bytes[i] = bytes(map(alphabet.__getitem__, text)) if text not in self.special else text.encode()
        for text, i in self.special.items():
            self.token_bytes[i] = text.encode()
        names = {b: c for c, b in alphabet.items()}
        self.single = [vocabulary[names[b]] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocabulary[left] << 20 | vocabulary[right], rank << 20 | vocabulary[left + right])
        #: How many of the last prefixes can still be where an encoding goes on.
        self.lookahead = max(len(b) for i, b in enumerate(self.token_bytes) if i not in set(self.special.values()))
        self._ids = {b: i for i, b in enumerate(self.token_bytes) if b and i not in set(self.special.values())}
        self._whole: dict[int, bool] = {}
        self._beside: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge the lowest-ranked pair, leftmost first, until none is left."""
        single, find = self.single, self.pairs.get
        parts = [single[b] for b in piece]
        values = [find(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while values:
            least = min(values)
            if least == _NONE:
                break
            i = values.index(least)
            token = least & 0xFFFFF
            parts[i] = token
            del parts[i + 1], values[i]
            if i < len(values):
                values[i] = find(token << 20 | parts[i + 1], _NONE)
            if i:
                values[i - 1] = find(parts[i - 1] << 20 | token, _NONE)
        return parts

    def token(self, piece: bytes) -> int | None:
        """The token that `piece` is by itself, if merging leads there."""
        i = self._ids.get(piece)
        if i is None:
            return None
        if i not in self._whole:
            self._whole[i] = self.merge(piece) == [i]
        return i if self._whole[i] else None

    def beside(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = left << 20 | right
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) >= REMEMBERED:
                self._beside.clear()
            known = self._beside[key] = self.merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known


class Transducer:
    """Encodes one piece that arrives in parts; `feed` returns the ids that have become stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.data = bytearray()  # from the last stable position on
        self.start = 0  # the stable position, counted in bytes of the piece
        self.last: dict[int, tuple[int, int]] = {}  # prefix length -> (last token, the prefix before it)

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        for byte in part:
            self.data.append(byte)
            self._extend()
            if len(self.data) % 512 == 0:
                out += self._settle(range(max(self.start, self._end() - self.merges.lookahead + 1), self._end() + 1))
        return out

    def close(self) -> list[int]:
        return self._settle([self._end()]) if self.data else []

    def _end(self) -> int:
        return self.start + len(self.data)

    def _extend(self) -> None:
        end, merges = self._end(), self.merges
        for size in range(min(merges.lookahead, len(self.data)), 0, -1):
            token = merges.token(bytes(self.data[-size:]))
            if token is None:
                continue
            before = self.last.get(end - size)
            if before is None and end - size != self.start:
                continue
            if before is None or merges.beside(before[0], token):
                self.last[end] = (token, end - size)
                return
        raise ValueError("a byte without a token")

    def _settle(self, open_ends) -> list[int]:
        """Emit the path that all open prefixes share."""
        ends = set(open_ends)
        while len(ends) > 1:
            furthest = max(ends)
            ends.remove(furthest)
            ends.add(self.last[furthest][1] if furthest > self.start else furthest)
            if self.start in ends:
                return []
        at = stable = ends.pop()
        out = []
        while at > self.start:
            token, at = self.last[at]
            out.append(token)
        if not out:
            return []
        # The token before the stable position stays, as the neighbour of the next one.
        keep = {stable: (out[0], self.start)}
        self.last = keep | {k: v for k, v in self.last.items() if k > stable}
        del self.data[: stable - self.start]
        self.start = stable
        return out[::-1]


class Encoder(dict):
    """Piece -> its ids as little-endian 32-bit integers; forgets all when full."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self._pattern, self._fast = regex.compile(PATTERN), re.compile(_FAST)
        self._odd = re.compile(_PLAIN)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) > self.merges.lookahead:
            transducer = Transducer(self.merges)
            return np.array(transducer.feed(data) + transducer.close(), dtype="<u4").tobytes()
        packed = b"".join([i.to_bytes(4, "little") for i in self.merges.merge(data)])
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = packed
        return packed

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pattern's pieces, a chunk at a time; what could still change waits for the next chunk."""
        pattern = self._pattern if self._odd.search(text) else self._fast
        at = 0
        while len(text) - at > CHUNK:
            part = text[at : at + CHUNK]
            found = pattern.findall(part)
            end = len(part)
            while found and end > len(part) - 3:
                end -= len(found.pop())
            if not found:  # one run longer than a chunk
                match = pattern.match(text, at)
                found, end = [match[0]], match.end() - at
            yield found
            at += end
        yield pattern.findall(text[at:] if at else text)

    def stream(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text in order, packed, a chunk at a time."""
        if not text:
            return
        special = [s for s in self.merges.special if s in text]
        if special:
            between = regex.split("(" + "|".join(map(regex.escape, special)) + ")", text)
        else:
            between = [text]
        find = self.__getitem__
        for i, part in enumerate(between):
            if i % 2:
                yield self.merges.special[part].to_bytes(4, "little")
            elif part:
                for found in self.pieces(part):
                    yield b"".join(map(find, found))


#: First byte from .. to, then what its second byte may be, and how many bytes follow in all.
_LEADS = ((0xC2, 0xDF, 0x80, 0xBF, 1), (0xE0, 0xE0, 0xA0, 0xBF, 2), (0xE1, 0xEC, 0x80, 0xBF, 2), (0xED, 0xED, 0x80, 0x9F, 2), (0xEE, 0xEF, 0x80, 0xBF, 2), (0xF0, 0xF0, 0x90, 0xBF, 3), (0xF1, 0xF3, 0x80, 0xBF, 3), (0xF4, 0xF4, 0x80, 0x8F, 3))


def waiting(data: bytes) -> int:
    """How many of the last bytes begin a character that later bytes may complete."""
    for back in range(1, min(3, len(data)) + 1):
        lead = data[-back]
        if 0x80 <= lead <= 0xBF:
            continue
        for low, high, second_low, second_high, more in _LEADS:
            if low <= lead <= high:
                return back if back <= more and (back == 1 or second_low <= data[1 - back] <= second_high) else 0
        return 0
    return 0


class Decoder:
    """Ids to text, in parts: a character cut between two parts waits for its other bytes."""

    def __init__(self, token_bytes: list[bytes]):
        self.token_bytes = token_bytes
        self.held = b""

    def feed(self, packed: bytes) -> str:
        find = self.token_bytes.__getitem__
        data = self.held + b"".join(map(find, np.frombuffer(packed, dtype="<u4").tolist()))
        keep = waiting(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path)
        encoder, decoder = Encoder(merges), Decoder(merges.token_bytes)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                for packed in encoder.stream(text.as_py()):
                    n += len(packed) >> 2
                    ids.update(packed)
                    back.update(decoder.feed(packed).encode())
                back.update(decoder.close().encode())
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                text_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, digest of the ids, digest of the text decoded from them."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(_digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the ids of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges(path))
        for batch in batches:
            for key, text_value in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.frombuffer(b"".join(encoder.stream(text_value.as_py())), dtype="<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], batch.column(0).type), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{text}`").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the text of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Merges(path).token_bytes)
        for batch in batches:
            texts = []
            for value in batch.column(1):
                packed = np.array(value.as_py() or [], dtype="<u4").tobytes()
                texts.append("".join([decoder.feed(packed[i : i + 4 * CHUNK]) for i in range(0, len(packed), 4 * CHUNK)]) + decoder.close())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(f"`{id_col}`", f"`{ids}`").mapInArrow(run, f"doc_id {kind}, text string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(read(spark, sf_dir, "documents"), tokenizer_path())
