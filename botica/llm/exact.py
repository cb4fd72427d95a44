"""Exact copies by composable polynomial fingerprints.

A fingerprint is a polynomial over the bytes of a text, modulo two primes. Those of
two stretches join by shifting the first by the length of the second, so that chunks
of one text are hashed apart, in any task, and summed. Texts of one length and one
fingerprint are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.staging import beside, numbered, restored, ship_code, widened
from botica.llm.words import as_bytes, release

# Bytes of a chunk: its sum of products stays below 2^64.
CHUNK = 1 << 16
PRIMES = (2147483647, 2147483629)
RADIXES = (1103515245, 1566083941)

_tables: dict[int, np.ndarray] = {}


def _powers(which: int) -> np.ndarray:
    """Falling powers of the radix for one chunk."""
    if which not in _tables:
        power, out = 1, np.empty(CHUNK, dtype=np.uint64)
        for k in range(CHUNK):
            out[CHUNK - 1 - k] = power
            power = power * RADIXES[which] % PRIMES[which]
        _tables[which] = out
    return _tables[which]


def chunk_hash(chunk: bytes, which: int) -> int:
    """The polynomial of one chunk of at most ``CHUNK`` bytes."""
    values = np.frombuffer(chunk, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return int((values * _powers(which)[CHUNK - len(chunk) :]).sum()) % PRIMES[which]


def shifted(value: int, length: int, which: int) -> int:
    """A hash moved in front of ``length`` more bytes; hashes in place add up."""
    return value * pow(RADIXES[which], length, PRIMES[which]) % PRIMES[which]


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the normalised text, and its bytes."""
    for batch in parts:
        texts = as_bytes(batch.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([hashlib.sha256(x.lower()).hexdigest() for x in texts], pa.string()),
                pa.array([len(x) for x in texts], pa.int64()),
            ],
            [*batch.schema.names, "sha256", "n_bytes"],
        )
    release()


def _hash_chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        chunks = [c.lower() for c in as_bytes(batch.column("chunk"))]
        after = batch.column("after").to_pylist()
        hashes = [
            [shifted(chunk_hash(c, w), n, w) for c, n in zip(chunks, after, strict=True)] for w in (0, 1)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array(h, pa.int64()) for h in hashes)], ["row", "h0", "h1"]
        )
    release()


def _lower_chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        at = batch.schema.get_field_index("chunk")
        chunks = pa.array([c.lower() for c in as_bytes(batch.column(at))], pa.binary())
        yield batch.set_column(at, "chunk", chunks)


def _chunks(staged: DataFrame, chunk_bytes: int, *columns: str) -> DataFrame:
    """A row per chunk of the text's bytes; an empty text has one empty chunk."""
    last = F.floor((F.greatest("n_bytes", F.lit(1)) - 1) / chunk_bytes)
    start = F.col("chunk_no") * chunk_bytes
    text = F.coalesce("text", F.lit("")).cast("binary")
    cut = F.substring(text, (start + 1).cast("int"), F.lit(chunk_bytes))
    after = F.greatest(F.col("n_bytes") - start - chunk_bytes, F.lit(0))
    return staged.select(
        *columns, "text", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no")
    ).select(*columns, "chunk_no", cut.alias("chunk"), after.alias("after"))


_KEY = ["n_bytes", "h0", "h1"]


def _staged(docs: DataFrame, id_col: str, text_col: str, keep: bool) -> DataFrame:
    ship_code(docs.sparkSession)
    rest = [beside(docs, text_col)] if keep else []
    slim = docs.select(F.col(id_col).alias("id"), *rest, F.col(text_col).cast("string").alias("text"))
    return numbered(slim.mapInArrow(_digest, widened(slim, "sha256 string, n_bytes long")), "exact-texts")


def _grouped(staged: DataFrame, chunk_bytes: int) -> DataFrame:
    """row, id, sha256, keep_row, keep_id, group_size."""
    if not 0 < chunk_bytes <= CHUNK:
        raise ValueError(f"a chunk has 1 to {CHUNK} bytes")
    hashed = _chunks(staged, chunk_bytes, "row").mapInArrow(_hash_chunks, "row long, h0 long, h1 long")
    prints = hashed.groupBy("row").agg(
        (F.sum("h0") % PRIMES[0]).alias("h0"), (F.sum("h1") % PRIMES[1]).alias("h1")
    )
    rows = numbered(
        staged.select("row", "id", "sha256", "n_bytes").join(prints, "row"), "exact-prints", "print_row"
    ).drop("print_row")
    repeated = rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    suspects = rows.join(repeated, _KEY, "left_semi").select("row", *_KEY)
    # Chunk by chunk, all texts of a fingerprint hold the same bytes or they don't.
    chunks = _chunks(staged.join(suspects.select("row", "h0", "h1"), "row"), chunk_bytes, *_KEY).drop("after")
    compared = (
        chunks.mapInArrow(_lower_chunks, chunks.schema)
        .groupBy(*_KEY, "chunk_no")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .groupBy(*_KEY)
        .agg(F.bool_and(F.col("least") == F.col("most")).alias("same"))
    )
    # Should unequal texts ever share a fingerprint, their digests tell them apart.
    last = [F.max(F.struct("id", "row")).alias("last"), F.count("*").alias("group_size")]
    groups = rows.groupBy(*_KEY).agg(*last)
    differing = compared.where(~F.col("same")).select(*_KEY)
    apart = rows.join(differing, _KEY, "left_semi").groupBy(*_KEY, "sha256").agg(*last)
    apart = apart.withColumnsRenamed({"last": "own_last", "group_size": "own_size"})
    last = F.coalesce("own_last", "last")
    return (
        rows.join(groups, _KEY)
        .join(apart, [*_KEY, "sha256"], "left")
        .select(
            "row",
            "id",
            "sha256",
            last.row.alias("keep_row"),
            last.id.alias("keep_id"),
            F.coalesce("own_size", "group_size").alias("group_size"),
        )
    )


def exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, sha256 of its lower-cased text.

    Texts are equal when they are identical after lower-casing A-Z; null is an empty
    text. Of equal texts the row with the largest id stays; null ids come last, and of
    rows repeated with one id exactly one stays. Other columns are not looked at, and
    an empty table gives an empty result.
    """
    rows = _grouped(_staged(docs, id_col, text_col, False), chunk_bytes)
    return rows.select(
        "id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "sha256"
    )


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK
) -> DataFrame:
    """The documents, all their columns, less those that repeat a kept one's text."""
    staged = _staged(docs, id_col, text_col, True)
    dropped = _grouped(staged, chunk_bytes).where("row != keep_row").select("row")
    kept = staged.select("row", "text", "rest").join(dropped, "row", "left_anti")
    return restored(kept, docs, text_col)
