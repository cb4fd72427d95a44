"""Near copies: a Jaccard join on word n-grams with Bayesian candidate pruning.

Candidates share a band of MinHash values. Their values are compared a few at a time,
and a pair is dropped once the posterior probability that its similarity reaches the
threshold falls below a tolerance. What stays is verified on the n-grams themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.links import by_group, forest, grouped, tiles
from botica.llm.staging import beside, numbered, restored, ship_code, widened, written
from botica.llm.words import as_bytes, batches, many_word_hashes, mix, release, shingles

# MinHash values of a document, and of a band: similar pairs (0.8) miss all bands once
# in 20 million. Values have 16 bits, so that a band is one 64-bit number.
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
# Values compared before a pair's posterior is looked at again.
STEP = 32

_random = np.random.default_rng(19990101)
_FACTORS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(values: np.ndarray) -> np.ndarray:
    """The bands of a text from the hashes of its n-grams (repeats don't matter)."""
    folded = (values >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(folded), 2048):
        part = folded[at : at + 2048]
        hashed = (part[None, :] ^ _SHIFTS[:, None]) * _FACTORS[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2").view("<i8")


def fewest_matches(compared: int, threshold: float, tolerance: float) -> int:
    """Matches among ``compared`` values below which a pair is dropped.

    With any similarity as likely beforehand, the posterior after m matches is a beta
    distribution; its part above the threshold is a sum of binomial terms.
    """
    n, chance = compared + 1, 0.0
    for m in range(compared + 1):
        chance += comb(n, m) * threshold**m * (1 - threshold) ** (n - m)
        if chance >= tolerance:
            return m
    return compared


def prune(bands: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, fewest: list[int]) -> np.ndarray:
    """Which pairs of rows stay; a pair counts in the first band that it shares only."""
    stay = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 1 << 15):
        piece = slice(at, at + (1 << 15))
        one, two = bands[a[piece]], bands[b[piece]]
        same = one == two
        left = np.flatnonzero(same.argmax(axis=1) == band[piece])
        one, two = one.view("<u2")[left], two.view("<u2")[left]
        matches = np.zeros(len(left), dtype=np.int64)
        for k, least in enumerate(fewest):
            part = slice(k * STEP, (k + 1) * STEP)
            matches += (one[:, part] == two[:, part]).sum(axis=1)
            on = matches >= least
            left, one, two, matches = left[on], one[on], two[on], matches[on]
        stay[piece] = False
        stay[at + left] = True
    return stay


def _pairs(starts: np.ndarray, sizes: np.ndarray, block: np.ndarray, only: np.ndarray):
    """Places of all pairs of each group, for one group size after the other.

    Members of one block meet each other where it is the group's only one, else those
    of two blocks meet.
    """
    for size in np.unique(sizes):
        if size < 2:
            continue
        left, right = np.triu_indices(size, 1)
        own = starts[sizes == size]
        step = max(1, (1 << 16) // len(left))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            a, b = (base + left).ravel(), (base + right).ravel()
            meet = only[a] | (block[a] != block[b])
            yield a[meet], b[meet]


def _group_bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])
    return starts, np.diff(np.append(starts, len(values)))


def _measured(width: int):
    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = as_bytes(batch.column("text"))
            for first, last in batches(texts):
                words, counts = many_word_hashes(texts[first:last])
                digests, bands, at = [], [], 0
                for n in counts.tolist():
                    own = words[at : at + n]
                    at += n
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                    bands.append(signature(shingles(own, width, distinct=False)) if n else None)
                rest = [batch.column(k).slice(first, last - first) for k in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    [*batch.schema.names, "digest", "bands"],
                )
        release()

    return measure


def _pruned(threshold: float, tolerance: float):
    steps = range(STEP, HASHES + 1, STEP)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fewest = [fewest_matches(n, threshold, tolerance) for n in steps]
        for part in by_group(parts, "tile"):
            tile, rep, copies, block, band = (
                part.column(c).to_numpy() for c in ("tile", "rep", "copies", "block", "band")
            )
            only = part.column("only").to_numpy(zero_copy_only=False).astype(bool)
            signatures = part.column("bands").combine_chunks()
            signatures = np.ascontiguousarray(signatures.flatten().to_numpy().reshape(-1, BANDS))
            got_a, got_b = [], []
            for a, b in _pairs(*_group_bounds(tile), block, only):
                stay = prune(signatures, a, b, band[a], fewest)
                got_a.append(a[stay])
                got_b.append(b[stay])
            if not got_a or not sum(map(len, got_a)):
                continue
            a, b = np.concatenate(got_a), np.concatenate(got_b)
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            rows = np.unique(np.concatenate([a, b]))
            low, high = np.searchsorted(a, rows), np.searchsorted(a, rows, "right")
            partners = [rep[b[x:y]].astype("<i8").tobytes() for x, y in zip(low, high, strict=True)]
            # One row per document and tile, not per pair.
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile[rows]), pa.array(rep[rows]), pa.array(copies[rows]), pa.array(partners, pa.binary())],
                ["tile", "rep", "copies", "partners"],
            )
        release()

    return compare


def verify(
    sets: list[np.ndarray], reps: np.ndarray, copies: np.ndarray, partners: list[bytes], threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Of one tile's documents: the weight of those each is linked to, and its root."""
    lengths = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    place = {r: k for k, r in enumerate(reps.tolist())}
    has = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=bool)
    weight = np.zeros(len(reps), dtype=np.int64)
    linked_a, linked_b = [], []
    for k, raw in enumerate(partners):
        if not raw:
            continue
        others = np.array([place[r] for r in np.frombuffer(raw, "<i8").tolist()])
        own = ids[starts[k] : starts[k + 1]]
        has[own] = True
        both = np.array([np.count_nonzero(has[ids[starts[o] : starts[o + 1]]]) for o in others])
        has[own] = False
        alike = others[both / (lengths[k] + lengths[others] - both) >= threshold]
        weight[k] += copies[alike].sum()
        weight[alike] += copies[k]
        linked_a.append(np.full(len(alike), k))
        linked_b.append(alike)
    a = np.concatenate(linked_a) if linked_a else np.zeros(0, dtype=np.int64)
    b = np.concatenate(linked_b) if linked_b else a
    return weight, reps[forest(len(reps), a, b)]


def _verified(width: int, threshold: float):
    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(parts, "tile", 512):
            tile, rep, copies = (part.column(c).to_numpy() for c in ("tile", "rep", "copies"))
            partners = part.column("partners").to_pylist()
            words, counts = many_word_hashes(as_bytes(part.column("text").combine_chunks()))
            ends = np.cumsum(counts)
            sets = [shingles(words[e - n : e], width) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            got = []
            for at, n in zip(*(x.tolist() for x in _group_bounds(tile)), strict=True):
                own = slice(at, at + n)
                weight, root = verify(sets[own], rep[own], copies[own], partners[own], threshold)
                linked = weight > 0
                got.append((rep[own][linked], weight[linked], root[linked]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], ["rep", "weight", "root"]
            )
        release()

    return check


def _joined(
    docs: DataFrame, id_col: str, text_col: str, keep: bool, width: int, threshold: float, tolerance: float, block: int
) -> tuple[DataFrame, DataFrame]:
    ship_code(docs.sparkSession)
    rest = [beside(docs, text_col)] if keep else []
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *rest)
    schema = widened(slim, "digest binary, bands array<long>")
    texts = numbered(slim.mapInArrow(_measured(width), schema), "ngram-texts")

    # Texts of the same words are one class, compared by one of them.
    same = texts.where("digest is not null").groupBy("digest")
    same = written(same.agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "ngram-classes")
    rows = texts.select("row", "id", "digest").join(same.select("digest", "rep"), "digest", "left")
    classes = same.join(texts.select(F.col("row").alias("rep"), "bands"), "rep").select("rep", "copies", "bands")
    classes = written(classes, "ngram-bands")
    members = classes.select("rep", F.posexplode("bands").alias("band", "value"))
    members = tiles(members, ["band", "value"], block).join(classes, "rep")
    members = members.select("tile", "rep", "copies", "block", "only", "band", "bands")
    pruned = members.repartition("tile").sortWithinPartitions("tile")
    pruned = pruned.mapInArrow(
        _pruned(threshold, tolerance), "tile long, rep long, copies long, partners binary"
    )
    # Only documents that still have a partner fetch their texts. Both sides grow with
    # the input, so neither is ever broadcast.
    pairs = written(pruned, "ngram-pairs").hint("merge")
    pairs = pairs.join(texts.select(F.col("row").alias("rep"), "text"), "rep")
    found = pairs.repartition("tile").sortWithinPartitions("tile")
    found = found.mapInArrow(_verified(width, threshold), "rep long, weight long, root long")
    return texts, grouped(rows, classes, found)


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-9,
    block: int = 512,
) -> DataFrame:
    """One row per document: id, n_links, component_id, kept.

    Links join documents whose sets of ``width``-word runs have a Jaccard similarity of
    at least ``threshold``; words are parted by ASCII white space, A-Z count as a-z. A
    text of fewer words is one run; one without words, or null, links with nothing.
    ``n_links`` counts all other rows linked directly, copies too. A group is what
    links reach; it is named by its smallest id, whose row is kept (null ids come last;
    of rows repeated with one id exactly one stays). A pair at the threshold is missed
    with a probability of about 5e-8 by its bands and ``tolerance`` by each look at its
    posterior. An empty table gives an empty result.
    """
    found = _joined(docs, id_col, text_col, False, width, threshold, tolerance, block)[1]
    return found.select("id", "n_links", "component_id", "kept")


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-9,
    block: int = 512,
) -> DataFrame:
    """The documents, all their columns, less those of a group other than its kept one."""
    texts, found = _joined(docs, id_col, text_col, True, width, threshold, tolerance, block)
    dropped = found.where(~F.col("kept")).select("row")
    kept = texts.select("row", "text", "rest").join(dropped, "row", "left_anti")
    return restored(kept, docs, text_col)
