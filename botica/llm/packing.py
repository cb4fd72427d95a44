"""Packing by power-of-two decomposition.

A tokenised document is cut into pieces whose lengths are powers of two: as many of the
longest as fit, then the binary digits of the rest. Each piece is a sequence of its own
in the bucket of its length, so that no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import dense, numbered, ship_code, widened
from botica.llm.words import as_bytes

# Words whose ids a worker keeps; at this number it starts afresh.
KEPT_WORDS = 1 << 19
# Documents whose pieces are held at once.
ROWS = 1000
_TAIL = b".,;:!?*#$%&|-()\""
_loaded: dict[bytes, WordTokenizer] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte.

    Printable bytes stand for themselves, the others for what follows letter 255.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of texts, as little-endian unsigned 32-bit numbers, by a tokenizer file.

    For byte-level tokenizers that lower-case and never join across white space: each
    stretch between blanks is encoded once and remembered.
    """

    def __init__(self, json: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(json)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.kept: dict[bytes, bytes] = {}

    def _encode(self, stretch: bytes) -> bytes:
        if stretch.isalpha():
            ids = [t.id for t in self.model.tokenize(stretch.decode())]
            return array("I", ids).tobytes()
        text = stretch.decode()
        if text.isalpha() and max(text) <= "\xff":
            # Such letters are composed already and are one word to the tokenizer.
            low = text.lower().encode().decode("latin-1").translate(self.letters)
            return array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        parts = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return array("I", [t.id for part, _ in parts for t in self.model.tokenize(part)]).tobytes()

    def _learn(self, stretch: bytes) -> bytes:
        known = self.kept.get(stretch)
        if known is not None:
            return known
        # Letters and the signs after them are encoded apart by the tokenizer, too.
        core = stretch.rstrip(_TAIL)
        if core and len(core) < len(stretch) and core[-1:].isalpha() and core.decode().isalpha():
            ids = self._learn(core) + self._learn(stretch[len(core) :])
        else:
            ids = self._encode(stretch)
        self.kept[stretch] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        if b"<|" in text:
            # Special tokens may be spelt out; the text is encoded as a whole then.
            return array("I", self.whole.encode(text.decode(), add_special_tokens=False).ids).tobytes()
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        stretches = text.lower().split()
        ids = list(map(self.kept.get, stretches))
        if None in ids:
            for k, known in enumerate(ids):
                if known is None:
                    ids[k] = self._learn(stretches[k])
        return b"".join(ids)


def tokenizer(json: str) -> WordTokenizer:
    """The tokenizer of a file's content; a worker makes it once."""
    key = hashlib.sha256(json.encode()).digest()
    if key not in _loaded:
        _loaded[key] = WordTokenizer(json)
    return _loaded[key]


def cuts(length: int, longest: int) -> list[int]:
    """Where pieces of a document end: whole sequences, then falling powers of two."""
    whole, rest = divmod(length, longest)
    ends = [longest * (k + 1) for k in range(whole)]
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            ends.append((ends[-1] if ends else 0) + (1 << bit))
    return ends


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    end_id: int,
    sequence_length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit numbers (``numpy.frombuffer``).
    ``length`` is the bucket: a power of two up to ``sequence_length``, itself one. A
    piece fills its sequence, from offset 0; sequences count from 0. Every document
    ends with ``end_id``; null and empty texts have only that. Repeated and null ids
    are rows like others. An empty table gives an empty result.
    """
    if sequence_length < 1 or sequence_length & (sequence_length - 1):
        raise ValueError("sequence_length must be a power of two")
    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(shared.value)
        for batch in parts:
            for first in range(0, batch.num_rows, ROWS):
                source, start, ids, total = [], [], [], []
                for k, text in enumerate(as_bytes(batch.column("text").slice(first, ROWS)), first):
                    raw = encoder.encode(text) + end
                    at = 0
                    for stop in cuts(len(raw) // 4, sequence_length):
                        source.append(k)
                        start.append(at)
                        ids.append(raw[4 * at : 4 * stop])
                        total.append(len(raw) // 4)
                        at = stop
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(source, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array(total, pa.int64()),
                    ],
                    ["id", "start", "length", "ids", "doc_tokens"],
                )

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = widened(slim.drop("text"), "start long, length long, ids binary, doc_tokens long")
    packed = dense(numbered(slim.mapInArrow(pieces, schema), "packed"), "row", "sequence_id")
    return packed.drop("row").withColumn("offset", F.lit(0).cast("long"))
