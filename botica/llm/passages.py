"""Passages that a document repeats from others, found with suffix arrays.

Texts are kept as bytes in blocks of about a megabyte. Every string of ``width`` bytes
is known by the least hash of the grams in it, so that equal strings have equal keys;
neighbouring strings of one key make one stretch. Keys that several blocks or documents
hold are found first. Only their stretches are brought together, by key, and sorted as
suffixes in two stages; suffixes that share ``width`` bytes are one string, which goes
wherever a document with a smaller id has it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from botica.llm.links import by_group
from botica.llm.staging import numbered, ship_code, written
from botica.llm.suffixes import shared, suffix_array, words
from botica.llm.words import as_bytes, mix, release

# Bytes of text in a block, of text whose stretches meet in one bucket, and of
# stretches that are sorted at once; a document or a key's stretches are never cut.
BLOCK = 1 << 20
BUCKET = 1 << 24
SORTED = 1 << 20
# Strings that are hashed at once.
SPAN = 1 << 20
# A key in more blocks than this, or with more bytes in one block, is split by its strings:
# in most blocks a key has a stretch or a few of some 70 bytes.
HOT_BLOCKS = 1 << 13
HOT_BYTES = 1 << 16
# Places of one stretch in one block that a row holds.
SPOTS = 1 << 16
# Never a byte of UTF-8 text.
BETWEEN = b"\xff"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _packed(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True)


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, size, "zstd", asbytes=True) if size else b""


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A number for each run of ``gram`` (8 to 24) bytes."""
    word = words(raw)
    count = len(raw) - gram + 1
    total = np.zeros(count, dtype=np.uint64)
    for k, at in enumerate(sorted({0, min(8, gram - 8), gram - 8})):
        total += word[at : at + count] * _FACTORS[k]
    return mix(total)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(raw: np.ndarray, lens: np.ndarray, width: int, gram: int):
    """doc, start, stop, key of runs of strings with one key; places are those of ``raw``.

    A run covers the strings that begin from start to before stop.
    """
    ends = np.cumsum(lens)
    got: list[list[np.ndarray]] = [[], [], [], []]
    wide = lens >= width
    first, last = (ends - lens)[wide], ends[wide] - width
    for at in range(0, max(0, len(raw) - width + 1), SPAN):
        key = least(gram_hashes(raw[at : at + SPAN + width - 1], gram), width - gram + 1)
        edge = np.ones(len(key) + 1, dtype=bool)
        edge[1:-1] = key[1:] != key[:-1]
        for places in (first, last + 1):
            inside = places[(places >= at) & (places <= at + len(key))]
            edge[inside - at] = True
        cut = np.flatnonzero(edge)
        start, stop = cut[:-1] + at, cut[1:] + at
        doc = np.searchsorted(ends, start, side="right")
        on = start <= ends[doc] - width
        for have, new in zip(got, (doc[on], start[on], stop[on], key[cut[:-1]][on]), strict=True):
            have.append(new)
    empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
    doc, start, stop, key = (np.concatenate(g) if g else e for g, e in zip(got, empty, strict=True))
    # The least of many hashes is small: keys are spread again, for buckets of one size.
    return doc, start, stop, mix(key)


def _blocked(size: int):
    """Documents as blocks: ids, whether each has one, byte counts, digests, their text compressed."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def out():
            raw = b"".join(texts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([[sha256(t).digest() for t in texts]], pa.list_(pa.binary())),
                    pa.array([len(raw)], pa.int64()),
                    pa.array([_packed(raw)], pa.binary()),
                ],
                ["ids", "lens", "prints", "n_bytes", "packed"],
            )

        for batch in parts:
            for id_, text in zip(batch.column("id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                ids.append(id_)
                texts.append(text)
                held += len(text)
                if held >= size or len(ids) >= size:
                    yield out()
                    ids, texts, held = [], [], 0
        if ids:
            yield out()
        release()

    return work


def _entries(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of blocks, one unpacked at a time."""
    names = [n for n in batch.schema.names if n != "packed"]
    for k in range(batch.num_rows):
        row = {n: batch.column(n)[k].as_py() for n in names}
        row["raw"] = _unpacked(batch.column("packed")[k].as_py(), row["n_bytes"])
        row["lens"] = np.array(row["lens"], dtype=np.int64)
        yield row


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """The bits of a key that name its bucket, and 30 more."""
    return key >> np.uint64(34 - bits)


def _found_in(row: dict, width: int, gram: int):
    """The block's stretches, of documents that have an id."""
    raw = np.frombuffer(row["raw"], dtype=np.uint8)
    doc, start, stop, key = stretches(raw, row["lens"], width, gram)
    named = np.array([i is not None for i in row["ids"]], dtype=bool)[doc]
    return doc[named], start[named], stop[named], key[named]


def _buckets(short: np.ndarray) -> list[tuple[int, int, int]]:
    """bucket, first and last place of each run of one bucket in sorted short keys."""
    bucket = (short >> np.uint64(30)).astype(np.int64)
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _keys(width: int, gram: int, bits: int):
    """For each block and bucket its keys, with two marks: of several documents; of many bytes."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _entries(batch):
                doc, start, stop, key = _found_in(row, width, gram)
                order = np.argsort(_short(key, bits), kind="stable")
                short = _short(key, bits)[order]
                new = np.flatnonzero(np.append(True, short[1:] != short[:-1])) if len(short) else np.zeros(0, np.int64)
                if not len(new):
                    continue
                several = np.minimum.reduceat(doc[order], new) != np.maximum.reduceat(doc[order], new)
                size = (stop - start)[order] + width - 1
                heavy = np.add.reduceat(size, new) > HOT_BYTES
                short = short[new]
                entry = (short & np.uint64((1 << 30) - 1)).astype(np.uint32) << np.uint32(2)
                entry |= several.astype(np.uint32) | (heavy.astype(np.uint32) << np.uint32(1))
                cuts = _buckets(short)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in cuts], pa.int64()),
                        pa.array([row["block"]] * len(cuts), pa.int64()),
                        pa.array([entry[x:y].tobytes() for _, x, y in cuts], pa.binary()),
                    ],
                    ["bucket", "block", "entries"],
                )
        release()

    return work


def _repeated(hot_blocks: int):
    """For each block and bucket which of its keys repeat, and which of these are hot, a bit each.

    No bits stand for keys none of which is hot.
    """

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(parts, "bucket", 4096):
            bucket, block = part.column("bucket").to_numpy(), part.column("block").to_numpy()
            blobs = part.column("entries").to_pylist()
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for first, last in zip(cut, cut[1:], strict=False):
                sizes = np.array([len(b) // 4 for b in blobs[first:last]])
                entry = np.frombuffer(b"".join(blobs[first:last]), dtype=np.uint32)
                order = np.argsort(entry >> np.uint32(2), kind="stable")
                key = entry[order] >> np.uint32(2)
                new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                count = np.diff(np.append(new, len(key)))
                marks = np.bitwise_or.reduceat(entry[order], new)
                again = (count > 1) | ((marks & np.uint32(1)) > 0)
                hot = again & ((count > hot_blocks) | ((marks & np.uint32(2)) > 0))
                both = np.empty((2, len(entry)), dtype=bool)
                both[0, order], both[1, order] = np.repeat(again, count), np.repeat(hot, count)
                out = []
                for k, (end, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True)):
                    own = both[:, end - size : end]
                    if own[0].any():
                        bits = (np.packbits(x).tobytes() if x.any() else b"" for x in own)
                        out.append((int(bucket[first]), int(block[first + k]), *bits))
                if out:
                    columns = zip(*out, strict=True)
                    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "block", "again", "hot"]
                    )
        release()

    return work


def _asked(row: dict, width: int, gram: int, bits: int):
    """The block's stretches whose keys repeat, less those of copies, and which are hot."""
    doc, start, stop, key = _found_in(row, width, gram)
    short = _short(key, bits)
    known = np.unique(short)
    marks = np.zeros((2, len(known)), dtype=bool)
    answers = {a["bucket"]: a for a in row["answers"]}
    for bucket, x, y in _buckets(known):
        if bucket in answers:
            for k, name in enumerate(("again", "hot")):
                bitmap = np.frombuffer(answers[bucket][name], dtype=np.uint8)
                if len(bitmap):
                    marks[k, x:y] = np.unpackbits(bitmap, count=y - x)
    place = np.searchsorted(known, short)
    copies = np.zeros(len(row["ids"]), dtype=bool)
    copies[row["copies"] or []] = True
    on = marks[0][place] & ~copies[doc]
    return doc[on], start[on], stop[on], key[on], marks[1][place][on]


# What a stretch is sent with, column after column: some bits of its key, which part a bucket's
# stretches for sorting, the document's id and place in the block, where the stretch begins in
# it, and its bytes.
_HEADER = (("key", "<u2"), ("id", "<i8"), ("doc", "<u4"), ("start", "<u4"), ("size", "<u4"))


def _cold(width: int, gram: int, bits: int):
    """For each block and bucket the stretches of keys that are not hot, with their bytes."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _entries(batch):
                doc, start, stop, key, hot = _asked(row, width, gram, bits)
                short = _short(key, bits)
                order = np.flatnonzero(~hot)
                # Those of one document stay together, which makes them small.
                order = order[np.argsort(short[order] >> np.uint64(30), kind="stable")]
                if not len(order):
                    continue
                ids = np.array([i or 0 for i in row["ids"]], dtype=np.int64)
                begin = np.cumsum(row["lens"]) - row["lens"]
                head = {
                    "key": (short[order] >> np.uint64(14)) & np.uint64((1 << 16) - 1),
                    "id": ids[doc[order]],
                    "doc": doc[order],
                    "start": start[order] - begin[doc[order]],
                    "size": stop[order] - start[order] + width - 1,
                }
                raw = row["raw"]
                out = []
                for bucket, x, y in _buckets(short[order]):
                    own = order[x:y]
                    ends = (stop[own] + width - 1).tolist()
                    columns = [head[c][x:y].astype(t).tobytes() for c, t in _HEADER]
                    blob = b"".join([*columns, *(raw[a:b] for a, b in zip(start[own].tolist(), ends, strict=True))])
                    out.append((bucket, row["block"], y - x, len(blob), _packed(blob)))
                columns = zip(*out, strict=True)
                types = (*(pa.int64(),) * 4, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["bucket", "block", "many", "n_bytes", "packed"],
                )
        release()

    return work


def smallest_ids(contexts: list[bytes], ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the contexts in a row the smallest id of the string there.

    Contexts are distinct and each has the smallest id that holds it. Returns the ids and
    where each context begins; places where no whole string begins hold no meaning.
    """
    text = np.frombuffer(BETWEEN.join(contexts) + BETWEEN, dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    word = words(text)
    # Suffixes alike for ``width`` bytes must be neighbours.
    order = suffix_array(text, word, width)
    common = shared(word, order, width)
    context = np.repeat(np.arange(len(contexts)), sizes + 1)
    left = (begin + sizes)[context[order]] - order
    same = (common >= width) & (left[:-1] >= width) & (left[1:] >= width)
    first = np.flatnonzero(np.append(True, ~same))
    best = np.minimum.reduceat(ids[context[order]], first)
    out = np.empty(len(text), dtype=np.int64)
    out[order] = np.repeat(best, np.diff(np.append(first, len(order))))
    return out, begin


def _ranges(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths one after another: the run, and the place within it."""
    run = np.repeat(np.arange(len(length)), length)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length)


def _spans(block: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """A row per block: what goes, as triples of document, start and stop."""
    order = np.argsort(block, kind="stable")
    triples = np.stack([doc, start, stop], axis=1).astype("<u4")[order]
    block = block[order]
    cut = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)).tolist() if len(block) else [0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block[cut[:-1]], pa.int64()),
            pa.array([triples[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
        ],
        ["block", "spans"],
    )


def _judged(head: dict[str, np.ndarray], block: np.ndarray, texts: list[bytes], width: int):
    """block, doc, start, stop of what goes, for stretches in order of their keys."""
    key = head["key"]
    cut = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist()
    got = []
    at = 0
    while at < len(cut) - 1:
        # Whole keys, as many as are sorted at once.
        size, end = 0, at
        number: dict[bytes, int] = {}
        which = []
        while end < len(cut) - 1 and (end == at or size < SORTED):
            for text in texts[cut[end] : cut[end + 1]]:
                k = number.setdefault(text, len(number))
                which.append(k)
                if k == len(number) - 1:
                    size += len(text)
            end += 1
        own = slice(cut[at], cut[end])
        at = end
        context = np.array(which, dtype=np.int64)
        ids = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(ids, context, head["id"][own])
        smallest, begin = smallest_ids(list(number), ids, width)
        run, inside = _ranges(head["size"][own] - width + 1)
        goes = smallest[begin[context[run]] + inside] < head["id"][own][run]
        # Neighbouring strings that go make one span.
        new = np.append(True, run[1:] != run[:-1])
        first = goes & (new | ~np.append(True, goes[:-1]))
        last = goes & np.append(new[1:] | ~goes[1:], True)
        who = run[first]
        begins = head["start"][own][who]
        got.append((block[own][who], head["doc"][own][who], begins + inside[first], begins + inside[last] + width))
    return [np.concatenate(c) for c in zip(*got, strict=True)]


def _sorted(width: int):
    """What goes of each block, from the stretches of each bucket."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_group(parts, "bucket", 1024):
            bucket = part.column("bucket").to_numpy()
            cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            for first, last in zip(cut, cut[1:], strict=False):
                heads, blocks, texts = defaultdict(list), [], []
                for row in part.slice(first, last - first).to_pylist():
                    blob = _unpacked(row["packed"], row["n_bytes"])
                    at = 0
                    for column, kind in _HEADER:
                        got = np.frombuffer(blob, kind, row["many"], at)
                        at += got.nbytes
                        heads[column].append(got.astype(np.int64))
                    blocks.append(np.full(row["many"], row["block"], dtype=np.int64))
                    ends = (at + np.cumsum(heads["size"][-1])).tolist()
                    texts += [blob[a:b] for a, b in zip([at, *ends], ends, strict=False)]
                head = {c: np.concatenate(h) for c, h in heads.items()}
                order = np.argsort(head["key"], kind="stable")
                texts = [texts[k] for k in order.tolist()]
                head = {c: h[order] for c, h in head.items()}
                yield _spans(*_judged(head, np.concatenate(blocks)[order], texts, width))
        release()

    return work


_SPOT = np.dtype([("id", "<i8"), ("doc", "<u4"), ("start", "<u4")])


def _hot(width: int, gram: int, bits: int):
    """Each stretch of hot keys once for each block, with its smallest id there and its places."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _entries(batch):
                doc, start, stop, _, hot = _asked(row, width, gram, bits)
                doc, start, stop = doc[hot], start[hot], stop[hot]
                begin = np.cumsum(row["lens"]) - row["lens"]
                spot = np.empty(len(doc), dtype=_SPOT)
                spot["id"] = np.array([i or 0 for i in row["ids"]], dtype=np.int64)[doc]
                spot["doc"], spot["start"] = doc, start - begin[doc]
                raw = row["raw"]
                places = defaultdict(list)
                for k, (a, b) in enumerate(zip(start.tolist(), (stop + width - 1).tolist(), strict=True)):
                    places[raw[a:b]].append(k)
                out = []
                for stretch, ks in places.items():
                    own = spot[ks]
                    least_id = int(own["id"].min())
                    out += [(stretch, row["block"], least_id, own[j : j + SPOTS].tobytes()) for j in range(0, len(own), SPOTS)]
                if not out:
                    continue
                columns = zip(*out, strict=True)
                types = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["stretch", "block", "least", "spots"]
                )
        release()

    return work


def _settled(width: int):
    """What goes of each block, from stretches, their places, and the smallest id of each string in them."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            blobs = batch.column("spots").to_pylist()
            spot = np.frombuffer(b"".join(blobs), dtype=_SPOT)
            row = np.repeat(np.arange(len(blobs)), [len(b) // _SPOT.itemsize for b in blobs])
            firsts = batch.column("firsts")
            sizes = np.diff(firsts.offsets.to_numpy())
            values = firsts.flatten().to_numpy()
            run, inside = _ranges(sizes[row])
            begin = np.cumsum(sizes) - sizes
            on = values[begin[row[run]] + inside] < spot["id"][run]
            run, inside = run[on], inside[on]
            start = spot["start"][run].astype(np.int64) + inside
            block = batch.column("block").to_numpy()[row[run]]
            yield _spans(block, spot["doc"][run].astype(np.int64), start, start + width)

    return work


def _hot_spans(stretches_of: DataFrame, width: int) -> DataFrame:
    """block, spans: what goes of the stretches of hot keys, string by string.

    Equal stretches, and then equal strings in them, are brought down to their smallest
    id by sums in parts, so that no task meets all places of one. A string goes with its
    stretch's number, not with its bytes, which would grow with the square of its length.
    No side of a join goes through the driver: the stored stretches are much alike, and
    what they and their strings take in memory is not known from the size of their files.
    """
    distinct = stretches_of.groupBy("stretch").agg(F.min("least").alias("least"))
    distinct = numbered(distinct, "passage-stretches", "number")
    last = F.octet_length("stretch") - width
    strings = distinct.select("number", "least", "stretch", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    string = F.substring("stretch", F.col("at") + 1, F.lit(width)).alias("string")
    strings = strings.select("number", "least", F.col("at").cast("int").alias("at"), string)
    least_ids = strings.groupBy("string").agg(F.min("least").alias("first"))
    firsts = strings.select("number", "at", "string").hint("merge").join(least_ids, "string").groupBy("number")
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("at", "first")))["first"].alias("firsts"))
    firsts = distinct.select("number", "stretch").hint("merge").join(firsts, "number").select("stretch", "firsts")
    told = stretches_of.hint("merge").join(firsts, "stretch").select("block", "spots", "firsts")
    return told.mapInArrow(_settled(width), "block long, spans binary")


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, lens: np.ndarray):
    """The spans of all documents without overlaps: doc, start, stop; those that touch are one."""
    # One place lies between two documents, so that their spans never touch.
    begin = np.cumsum(lens + 1) - lens - 1
    order = np.argsort(begin[doc] + start, kind="stable")
    doc, low, high = doc[order], (begin[doc] + start)[order], (begin[doc] + stop)[order]
    reach = np.maximum.accumulate(high) if len(high) else high
    first = np.append(True, low[1:] > reach[:-1]) if len(low) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(low) else first
    return doc[first], low[first] - begin[doc[first]], reach[last] - begin[doc[first]]


def _cut(width: int, with_kept: bool):
    """A row per document, from blocks and what goes of them."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in _entries(batch):
                lens = row["lens"]
                triples = np.frombuffer(b"".join(row["spans"] or []), dtype="<u4").reshape(-1, 3).astype(np.int64)
                copies = np.array([k for k in row["copies"] or [] if lens[k] >= width], dtype=np.int64)
                doc = np.concatenate([triples[:, 0], copies])
                start = np.concatenate([triples[:, 1], np.zeros(len(copies), np.int64)])
                stop = np.concatenate([triples[:, 2], lens[copies]])
                doc, start, stop = merged(doc, start, stop, lens)
                begin = (np.cumsum(lens) - lens).tolist()
                cuts: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for d, a, b in zip(doc.tolist(), start.tolist(), stop.tolist(), strict=True):
                    cuts[d].append((a, b))
                removed, digests, texts = [], [], []
                for k, n in enumerate(lens.tolist()):
                    own = cuts.get(k, [])
                    removed.append(sum(b - a for a, b in own))
                    text = None
                    if own or with_kept:
                        edges = [0, *(x for ab in own for x in ab), n]
                        text = b"".join(
                            row["raw"][begin[k] + a : begin[k] + b] for a, b in zip(edges[::2], edges[1::2], strict=True)
                        )
                    digests.append(sha256(text).hexdigest() if own else row["prints"][k].hex())
                    texts.append(text if with_kept else None)
                columns = [
                    pa.array([row["block"]] * len(lens), pa.int64()),
                    pa.array(range(len(lens)), pa.int64()),
                    pa.array(row["ids"], pa.int64()),
                    pa.array(lens, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([len(cuts.get(k, [])) for k in range(len(lens))], pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(
                        [[{"start": a, "stop": b} for a, b in cuts.get(k, [])] for k in range(len(lens))],
                        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
                    ),
                    pa.array(texts, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, _RESULT_NAMES)
        release()

    return work


_RESULT = (
    "block long, at long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
    " spans array<struct<start: long, stop: long>>, kept binary"
)
_RESULT_NAMES = ["block", "at", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 50,
    gram: int = 20,
    block_bytes: int = BLOCK,
    bucket_bytes: int = BUCKET,
    hot_blocks: int = HOT_BLOCKS,
    with_kept: bool = False,
) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte goes if it is covered by a string of ``width`` bytes that also starts in a
    document with a smaller id; all strings are judged on the texts as they are. Null
    texts are empty; texts shorter than ``width`` are left alone. Documents of one id
    take nothing from each other; those without an id neither lose bytes nor cost
    others any. ``spans`` are the maximal stretches that go, in bytes; ``kept``, null
    unless asked for, the remaining bytes, which need not be whole characters. Other
    columns are not looked at; an empty table gives an empty result.
    """
    if not 8 <= gram <= 24 or gram > width:
        raise ValueError("a gram has 8 to 24 bytes and fits into a string")
    spark = docs.sparkSession
    ship_code(spark)
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")
    )
    blocks = slim.mapInArrow(
        _blocked(block_bytes), "ids array<long>, lens array<long>, prints array<binary>, n_bytes long, packed binary"
    )
    blocks = numbered(blocks, "passage-blocks", "block")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(34, max(0, (-(-total // bucket_bytes) - 1).bit_length()))

    # Of equal texts only those with the smallest id can cost others bytes; the rest go whole.
    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "prints")).alias("doc", "e"))
    each = each.select("block", "doc", "e.ids", "e.prints").where("ids is not null")
    firsts = each.groupBy("prints").agg(F.min("ids").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = each.join(firsts, "prints").where("ids > first").groupBy("block").agg(F.collect_list("doc").alias("copies"))

    text = blocks.select("block", "lens", "ids", "n_bytes", "packed")
    keys = text.mapInArrow(_keys(width, gram, bits), "bucket long, block long, entries binary")
    answers = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _repeated(hot_blocks), "bucket long, block long, again binary, hot binary"
    )
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "again", "hot")).alias("answers"))
    asked = written(answers.join(copies, "block", "full"), "passage-answers")

    open_blocks = text.join(asked.where("answers is not null"), "block")
    met = open_blocks.mapInArrow(
        _cold(width, gram, bits), "bucket long, block long, many long, n_bytes long, packed binary"
    )
    spans = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sorted(width), "block long, spans binary")
    with_hot = asked.where(F.exists("answers", lambda a: F.octet_length(a["hot"]) > 0))
    if not with_hot.isEmpty():
        # Only texts of blocks with hot keys are exchanged again; these blocks' numbers go to every task.
        few = text.join(F.broadcast(with_hot.select("block")), "block", "left_semi").join(with_hot, "block")
        hot = few.mapInArrow(_hot(width, gram, bits), "stretch binary, block long, least long, spots binary")
        spans = spans.unionByName(_hot_spans(written(hot, "passage-hot"), width))
    spans = spans.groupBy("block").agg(F.collect_list("spans").alias("spans"))
    spans = written(spans, "passage-spans")
    whole = blocks.join(spans, "block", "left").join(asked.select("block", "copies"), "block", "left")
    return whole.mapInArrow(_cut(width, with_kept), _RESULT).drop("block", "at")
