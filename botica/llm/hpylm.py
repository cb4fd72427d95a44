"""Scores of texts by a hierarchical Pitman-Yor model.

A text is its lower-cased words and an end. The word before is a restaurant; its parent
is one restaurant of words without context, whose parent spells a word byte by byte:
there, each context of up to five bytes of the word is a restaurant, and a context's
parent is the one without its oldest byte. Tables of a restaurant are customers of its
parent, at every step. Words never seen in training are spelt like all others.

Customers are seated by Gibbs sampling, from the longest contexts up. Restaurants are
dealt out by hash of the context, words by hash of the word, spellings by a context's
last two bytes; counts are summed per block of texts before they are sent, and answers
come back in the order of what was asked. Words get numbers first: pairs of words are sent
as numbers, which are shorter than hashes. Blocks of texts are exchanged once, compressed, and read
from there by every step; what is told to them is dealt alike, so that one worker a task reads first
that, then block after block. What is seeded by its own content is seated alike when it is read again. The upper restaurants of the spelling, at most 65,792
numbers, are seated on the driver. Predictive probabilities are averaged over several
seatings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from botica.llm.staging import as_read, ship_code, written
from botica.llm.words import as_bytes, many_word_hashes, mix, release

# Bytes of the longest context; a context and a symbol fit a 64-bit number.
ORDER = 5
END = 10
# Text bytes that are counted and scored as one block.
BLOCK_BYTES = 8 << 20
# Text bytes for each of the parts that contexts, words and spellings are dealt to.
PART_BYTES = 16 << 20
# Discounts by length of context, and the strength of every restaurant.
DISCOUNTS = (0.5, 0.5, 0.6, 0.7, 0.75, 0.8)
STRENGTH = 1.0
WORD_DISCOUNT = 0.75
CONTEXT_DISCOUNT = 0.75
# The probability of each word where nothing was learned, not even to spell.
UNKNOWN = 0.5
# The hash that stands for the end of a text among those of words.
END_WORD = np.uint64(1)


def symbols(text: bytes) -> bytes:
    """The words of a text, lower-cased, a blank after each, and the end."""
    return b" ".join([*text.lower().split(), bytes([END])])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the texts its context and itself as one number, and the texts' sizes.

    The context of a text's first bytes is filled up with ends.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    fill = bytes([END]) * ORDER
    raw = np.frombuffer(b"".join(fill + t for t in texts), dtype=np.uint8)
    keys = np.zeros(len(raw), dtype=np.int64)
    for back in range(ORDER + 1):
        keys[back:] |= raw[: len(raw) - back].astype(np.int64) << (8 * back)
    ends = np.cumsum(sizes + ORDER)
    real = np.ones(len(raw), dtype=bool)
    for k in range(ORDER):
        real[ends - sizes - 1 - k] = False
    return keys[real], sizes


def seat(customers: np.ndarray, opening, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers have been seated one by one.

    ``opening(tables)`` is the weight of opening a table. Late customers, whose chances
    hardly change from one to the next, are seated in runs of a thirty-second of those
    before them.
    """
    tables = np.minimum(customers, 1)
    at = 1
    active = np.flatnonzero(customers > 1)
    while len(active):
        run = max(1, at // 32)
        held = tables[active]
        new = opening(active, held)
        chance = new / (new + np.maximum(at - discount * held, 1e-12))
        if run == 1:
            tables[active] = held + (random.random(len(active)) < chance)
        else:
            tables[active] = held + random.binomial(np.minimum(customers[active] - at, run), chance)
        at += run
        active = active[customers[active] > at]
    return tables


class Subtrees:
    """The restaurants below contexts of two bytes, for a table of contexts and symbols."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.parents, self.rooms = {ORDER: keys}, {}, {}
        for length in range(ORDER, 1, -1):
            own = self.keys[length]
            self.rooms[length] = np.unique(own >> 8, return_inverse=True)[1]
            shorter, self.parents[length] = np.unique(own & ((1 << 8 * length) - 1), return_inverse=True)
            self.keys[length - 1] = shorter
        self.customers = {ORDER: counts}
        self.tables: dict[int, np.ndarray] = {}
        for length in range(ORDER, 1, -1):
            self.tables[length] = np.minimum(self.customers[length], 1)
            self._send_up(length)

    def _send_up(self, length: int) -> None:
        up = np.bincount(self.parents[length], self.tables[length], len(self.keys[length - 1]))
        self.customers[length - 1] = up.astype(np.int64)

    def _in_room(self, length: int, values: np.ndarray) -> np.ndarray:
        room = self.rooms[length]
        return np.bincount(room, values)[room]

    def predictive(self, upper: np.ndarray) -> dict[int, np.ndarray]:
        """Probabilities of each symbol in its context, from the shortest on.

        ``upper`` has those of contexts of one byte, by context and symbol.
        """
        found = {1: upper.ravel()[self.keys[1]]}
        for length in range(2, ORDER + 1):
            c, t, d = self.customers[length], self.tables[length], DISCOUNTS[length]
            back = STRENGTH + d * self._in_room(length, t)
            prior = found[length - 1][self.parents[length]]
            found[length] = (c - d * t + back * prior) / (STRENGTH + self._in_room(length, c))
        return found

    def sweep(self, upper: np.ndarray, random: np.random.Generator) -> None:
        """Seats all customers anew, the longest contexts first.

        Dishes of one restaurant are seated side by side, given the others' tables.
        """
        prior = self.predictive(upper)
        for length in range(ORDER, 1, -1):
            c, t, d = self.customers[length], self.tables[length], DISCOUNTS[length]
            others = STRENGTH + d * (self._in_room(length, t) - t)
            dish = prior[length - 1][self.parents[length]]
            self.tables[length] = seat(
                c, lambda k, n, o=others, p=dish, d=d: (o[k] + d * n) * p[k], d, random
            )
            self._send_up(length)


def seat_upper(customers: np.ndarray, sweeps: int, seed: int) -> np.ndarray:
    """Probabilities of contexts of one byte (256 x 256), from the customers they got.

    Their parent, the empty context, has all bytes equally likely beneath it.
    """
    random = np.random.default_rng(seed)
    d0, d1 = DISCOUNTS[0], DISCOUNTS[1]
    tables = np.minimum(customers, 1)
    root_tables = np.minimum(tables.sum(axis=0), 1)
    for k in range(sweeps + 1):
        c0 = tables.sum(axis=0)
        root = (c0 - d0 * root_tables + (STRENGTH + d0 * root_tables.sum()) / 256) / (STRENGTH + c0.sum())
        back = STRENGTH + d1 * tables.sum(axis=1, keepdims=True)
        upper = (customers - d1 * tables + back * root) / (STRENGTH + customers.sum(axis=1, keepdims=True))
        if k == sweeps:
            return upper
        others = (back - d1 * tables).ravel()
        dish = np.broadcast_to(root, customers.shape).ravel()
        tables = seat(
            customers.ravel(), lambda i, n: (others[i] + d1 * n) * dish[i], d1, random  # noqa: B023
        ).reshape(customers.shape)
        c0, all_root = tables.sum(axis=0), root_tables.sum()
        rest = STRENGTH + d0 * (all_root - root_tables)
        root_tables = seat(c0, lambda i, n: (rest[i] + d0 * n) / 256, d0, random)  # noqa: B023
    raise AssertionError


def _opened(raw: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes with an end after each text's, and how many tokens each text has."""
    words, counts = many_word_hashes(texts)
    return np.insert(words, np.cumsum(counts), END_WORD), counts + 1


def _blocks(id_type: pa.DataType):
    """A task's texts in blocks, a row each; their bytes are compressed."""
    names = ["ids", "held", "sizes", "size", "symbols"]

    def tie(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            values = pa.concat_arrays(ids)
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values),
                pa.array([held], pa.list_(pa.bool_())),
                pa.array([np.array([len(t) for t in texts], dtype="<i8").tobytes()], pa.binary()),
                pa.array([sum(map(len, texts))]),
                pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in parts:
            flags = batch.column("held").to_pylist()
            column, first = batch.column("id").cast(id_type), 0
            for k, text in enumerate(as_bytes(batch.column("text"))):
                texts.append(symbols(text))
                held.append(flags[k])
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    ids.append(column.slice(first, k + 1 - first))
                    yield block()
                    ids, held, texts, size, first = [], [], [], 0, k + 1
            ids.append(column.slice(first))
        if texts:
            yield block()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tie(parts)
        # The worker waits beside those of the next steps.
        release()

    return run


def _same(key: int) -> int:
    return key


def _dealt(pieces: RDD, parts: int) -> RDD:
    """Pieces (part, ...) at their parts; stored once, however often they are read."""
    return pieces.partitionBy(parts, _same)


def _gathered(pieces: RDD, work) -> RDD:
    """``work(key, pieces by kind)`` for every key, in order; a piece is (key, (kind, from, ...))."""

    def run(rows):
        held: dict = {}
        for key, (kind, *rest) in rows:
            held.setdefault(key, {}).setdefault(kind, []).append(rest)
        for key in sorted(held):
            of_key = held.pop(key)
            for kind in of_key:
                of_key[kind].sort(key=lambda piece: piece[0])
            yield from work(key, of_key)
        release()

    return pieces.mapPartitions(run)


def _at_home(key: tuple[int, int], what) -> tuple:
    """A block, or a piece for it, for its partition: those read together are spread over several."""
    return sum(key), (key, what)


def _told(pieces: RDD, blocks: RDD) -> RDD:
    """Each block with its pieces by kind; a piece is (block's key, (kind, from, ...)).

    Both are dealt alike, so that one worker reads them: all pieces of a partition first,
    then its blocks one by one. Every block has a piece.
    """
    dealt = _dealt(pieces.map(lambda piece: _at_home(*piece)), blocks.getNumPartitions())

    def run(rows):
        held: dict = {}
        for _, (key, what) in rows:
            if isinstance(what, dict):
                of_key = held.pop(key)
                for kind in of_key:
                    of_key[kind].sort(key=lambda piece: piece[0])
                yield (key, what), of_key
            else:
                kind, *rest = what
                held.setdefault(key, {}).setdefault(kind, []).append(rest)

    return dealt.union(blocks).mapPartitions(run)


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on, in as few bytes as the largest of each needs, and compressed."""
    own = [c.astype(np.min_scalar_type(int(c.max(initial=0)))) for c in columns]
    head = np.array([[len(c), c.itemsize] for c in own], dtype="<u4").tobytes()
    # The first bytes of all numbers, then the second ones: they are alike.
    body = b"".join([head, *(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in own)])
    return np.array([len(own), len(body)], dtype="<u4").tobytes() + pa.compress(body, "zstd", asbytes=True)


def _unpacked(packed: bytes) -> list[np.ndarray]:
    many, size = np.frombuffer(packed, "<u4", 2).tolist()
    body = pa.decompress(packed[8:], size, "zstd", asbytes=True)
    columns, at = [], 8 * many
    for length, width in np.frombuffer(body, "<u4", 2 * many).reshape(many, 2).tolist():
        planes = np.frombuffer(body, np.uint8, length * width, at).reshape(width, length)
        columns.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += length * width
    return columns


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The steps between neighbours, which are smaller than the numbers."""
    return np.diff(ascending.astype(np.uint64), prepend=np.uint64(0))


def _summed(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=np.uint64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each is, and the place of every value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.append(True, ordered[1:] != ordered[:-1])
    place = np.empty(len(values), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], order[new], place


def _cut(homes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part, and the places of what goes there, in order."""
    order = np.argsort(homes, kind="stable")
    found, first = np.unique(homes[order], return_index=True)
    return zip(found.tolist(), np.split(order, first)[1:], strict=True)


def _home(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(parts)).astype(np.int64)


class Block:
    """A block's words and pairs of words, in the order in which they are asked for."""

    def __init__(self, row: dict):
        whole = pa.decompress(row["symbols"], row["size"], "zstd", asbytes=True)
        self.raw = np.frombuffer(whole, dtype=np.uint8)
        words, self.n_tokens = _words(_opened(whole, row["sizes"]))
        learns = np.repeat(~np.array(row["held"], dtype=bool), self.n_tokens)
        self.words, self.first, self.word_of = _distinct(words)
        self.learned = np.bincount(self.word_of[learns], minlength=len(self.words))
        self._learns = learns

    def pair(self) -> None:
        # The word before a text's first one is the end of the text before.
        end = np.searchsorted(self.words, END_WORD)
        before = np.concatenate([[end], self.word_of[:-1]])
        pairs, self.pair_of = np.unique(before * len(self.words) + self.word_of, return_inverse=True)
        self.pair_learned = np.bincount(self.pair_of[self._learns], minlength=len(pairs))
        self.before, self.word = np.divmod(pairs, len(self.words))

    def spellings(self) -> list[bytes]:
        # A token ends with its blank, or is the end.
        ends = np.flatnonzero((self.raw == 32) | (self.raw == END))
        starts = np.concatenate([[0], ends[:-1] + 1])
        whole = self.raw.tobytes()
        return [whole[a : b + 1] for a, b in zip(starts[self.first].tolist(), ends[self.first].tolist(), strict=True)]

    def to_words(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        return _cut(_home(self.words, parts))

    def to_contexts(self, parts: int) -> Iterator[tuple[int, np.ndarray]]:
        return _cut(_home(self.words, parts)[self.before])

    def numbers(self, pieces: list, parts: int) -> np.ndarray:
        """The numbers of the block's words: a word's place in its part, times the parts, and the part."""
        given, found = dict(pieces), np.zeros(len(self.words), dtype=np.int64)
        for part, at in self.to_words(parts):
            found[at] = _summed(*_unpacked(given[part])).astype(np.int64) * parts + part
        return found


class Contexts:
    """A part's restaurants: the words that follow each word, with their counts."""

    def __init__(self, pieces: list):
        columns = [_unpacked(p[1]) for p in pieces]
        self.senders, self.lengths = [p[0] for p in pieces], [c[1].astype(np.int64) for c in columns]
        contexts = [np.repeat(_summed(c[0]), own) for c, own in zip(columns, self.lengths, strict=True)]
        word, n = (np.concatenate([c[k] for c in columns]) for k in (2, 3))
        self.cuts = np.cumsum([len(c) for c in contexts])[:-1]
        # Sorted by context, then by word.
        words = np.uint64(int(word.max()) + 1)
        pairs, self.place = np.unique(np.concatenate(contexts) * words + word, return_inverse=True)
        before, self.word = (x.astype(np.int64) for x in np.divmod(pairs, words))
        self.room = np.cumsum(np.append(False, before[1:] != before[:-1]))
        self.n = np.bincount(self.place, n, len(pairs)).astype(np.int64)
        self.asked, self.asks = np.unique(self.word[self.n > 0], return_inverse=True)
        self.seed = [len(self.n), int(self.n.sum())]

    def in_room(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.room, values)[self.room]

    def seatings(self, parent: np.ndarray, sweeps: int, seed: int) -> Iterator[np.ndarray]:
        """Tables after each sweep; ``parent`` has the probabilities of the asked words."""
        random, d = np.random.default_rng([seed, *self.seed]), CONTEXT_DISCOUNT
        chance = np.zeros(len(self.n))
        chance[self.n > 0] = parent[self.asks]
        tables = np.minimum(self.n, 1)
        for _ in range(sweeps):
            others = STRENGTH + d * (self.in_room(tables) - tables)
            tables = seat(self.n, lambda k, t, o=others: (o[k] + d * t) * chance[k], d, random)
            yield tables


class Vocabulary:
    """A part's words, as the blocks sent them; each word's number in the part is its place."""

    def __init__(self, pieces: list):
        columns = [_unpacked(p[1]) for p in pieces]
        every = np.concatenate([_summed(c[0]) for c in columns])
        words, self._first, self.place = _distinct(every)
        self.n = np.bincount(self.place, np.concatenate([c[1] for c in columns]), len(words)).astype(np.int64)
        self.cuts = np.cumsum([len(c[0]) for c in columns])[:-1]
        self.senders = [p[0] for p in pieces]
        self._own = [(p[2], c[2]) for p, c in zip(pieces, columns, strict=True)]

    def spellings(self) -> list[bytes]:
        starts = np.concatenate([[0], self.cuts]).astype(np.int64)
        piece = np.searchsorted(starts, self._first, side="right") - 1
        opened = []
        for packed, sizes in self._own:
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            opened.append((pa.decompress(packed, int(ends[-1]), "zstd", asbytes=True), ends))
        found = []
        for k, at in zip(piece.tolist(), (self._first - starts[piece]).tolist(), strict=True):
            raw, ends = opened[k]
            found.append(raw[ends[at] : ends[at + 1]])
        return found


class Words:
    """A part's words: how often learned, spelling, and customers sent by the contexts."""

    def __init__(self, pieces: dict[str, list]):
        [(_, packed, self._spelt)] = pieces["word"]
        n, self._sizes = _unpacked(packed)
        self.n = n.astype(np.int64)
        asks = [(p[0], *_unpacked(p[1])) for p in pieces.get("ask", [])]
        self.asks = [(part, _summed(steps).astype(np.int64)) for part, steps, _ in asks]
        # The latest numbers of tables that the contexts sent, part by part.
        told = {p[0]: _unpacked(p[1])[0] for p in pieces.get("tables", [])}
        sent = told or {part: n for part, _, n in asks}
        self.customers = np.zeros(len(self.n), dtype=np.int64)
        for part, at in self.asks:
            self.customers[at] += sent[part].astype(np.int64)

    def spellings(self) -> list[bytes]:
        sizes = self._sizes.astype("<i8")
        return _opened(pa.decompress(self._spelt, int(sizes.sum()), "zstd", asbytes=True), sizes.tobytes())

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts and bytes of all spellings, where each byte's is, the spellings' sizes."""
        every, sizes = grams(self.spellings())
        keys, place = np.unique(every, return_inverse=True)
        return keys, place, sizes

    def spelt(self, pieces: list, parts: int) -> np.ndarray:
        """Logs of the words' probabilities by their spelling."""
        keys, place, sizes = self.grams()
        values, answers = np.zeros(len(keys)), {p[0]: p[1] for p in pieces}
        for part, at in _cut(_subtree(keys) % parts):
            values[at] = answers[part]
        return np.add.reduceat(values[place], np.cumsum(sizes) - sizes)

    def seatings(self, spelt: np.ndarray, tables: float, sweeps: int, seed: int) -> Iterator[np.ndarray]:
        """Tables after each seating; ``tables`` is the number in the whole restaurant."""
        random = np.random.default_rng([seed, len(self.n), int(self.customers.sum())])
        for _ in range(sweeps):
            new = (STRENGTH + WORD_DISCOUNT * tables) * 10.0**spelt
            yield seat(self.customers, lambda k, t, o=new: o[k], WORD_DISCOUNT, random)


def _subtree(keys: np.ndarray) -> np.ndarray:
    return (keys >> 8) & 0xFFFF


class Spellings:
    """A part's subtrees, for the contexts and bytes that the parts of the words ask for."""

    def __init__(self, pieces: list, weights: list | None = None):
        asked = [(p[0], *_unpacked(p[1])) for p in pieces]
        every = np.concatenate([_summed(steps) for _, steps, _ in asked]).astype(np.int64)
        keys, self.place = np.unique(every, return_inverse=True)
        counts = {p[0]: _unpacked(p[1])[0] for p in weights or ()} or {part: n for part, _, n in asked}
        n = np.bincount(self.place, np.concatenate([counts[part] for part, _, _ in asked]), len(keys)).astype(np.int64)
        self.tree = Subtrees(keys, n)
        self.cuts = np.cumsum([len(steps) for _, steps, _ in asked])[:-1]
        self.senders = [part for part, _, _ in asked]


def _log_sum(a: np.ndarray, b, logs: np.ndarray) -> np.ndarray:
    """log10(a + b * 10 ** logs): the spelling of a long word is less than the least float."""
    with np.errstate(divide="ignore"):
        return np.logaddexp2(np.log2(a), np.log2(b) + logs * np.log2(10)) / np.log2(10)


_RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 10,
    burn_in: int = 2,
    samples: int = 3,
    seed: int = 17,
) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32 of the id as text isn't a multiple of
    ``folds`` (a null id counts as empty text). Tokens are words, parted by ASCII white
    space, A-Z counted as a-z, and one end; null texts have the end alone. ``score`` is
    the model's log10 probability of the text, ``base_score`` that of add-0.1 unigrams,
    to which unseen words are one word; a text's perplexity is 10 to the minus score by
    n_tokens. Repeated ids are rows like others. An empty table gives an empty result;
    where nothing was learned, there is no spelling either and all words are unknown.
    """
    spark = docs.sparkSession
    ship_code(spark)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    slim = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    id_field = slim.schema["id"]
    layout = f"ids array<{dict(slim.dtypes)['id']}>, held array<boolean>, sizes binary, size long, symbols binary"
    # Blocks are known by their places, so a lost one must be tied again from the same rows in the same order.
    stored = slim if as_read(docs) is not None else written(slim, "lm-texts")
    result = T.StructType([T.StructField("id", id_field.dataType), *T.StructType.fromDDL(_RESULT).fields])
    # A blank and an end come after each text.
    total = stored.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 2)).first()[0]
    if total is None:
        return spark.createDataFrame([], result)
    parts = -(-total // PART_BYTES)
    tied = stored.mapInArrow(_blocks(to_arrow_type(id_field.dataType)), layout).rdd
    keyed = tied.mapPartitionsWithIndex(lambda p, rows: (_at_home((p, k), row.asDict()) for k, row in enumerate(rows)))
    texts = _dealt(keyed, tied.getNumPartitions())

    def words_of(rows):
        for _, (key, row) in rows:
            block = Block(row)
            spelt = np.array(block.spellings(), dtype=object)
            for part, at in block.to_words(parts):
                own = spelt[at].tolist()
                sizes = np.array([len(w) for w in own], dtype=np.int64)
                packed = _packed(_steps(block.words[at]), block.learned[at], sizes)
                yield part, ("found", key, packed, pa.compress(b"".join(own), "zstd", asbytes=True))
        release()

    found = _dealt(texts.mapPartitions(words_of), parts)

    def distinct(part, pieces):
        own = Vocabulary(pieces["found"])
        spelt = own.spellings()
        sizes = np.array([len(w) for w in spelt], dtype=np.int64)
        yield part, ("word", part, _packed(own.n, sizes), pa.compress(b"".join(spelt), "zstd", asbytes=True))

    vocabulary = _dealt(_gathered(found, distinct), parts)

    def numbered(part, pieces):
        own = Vocabulary(pieces["found"])
        for key, at in zip(own.senders, np.split(own.place, own.cuts), strict=True):
            yield key, ("number", part, _packed(_steps(at)))

    def pairs_of(rows):
        for (key, row), pieces in rows:
            block = Block(row)
            block.pair()
            number = block.numbers(pieces["number"], parts)
            for part, at in block.to_contexts(parts):
                contexts, lengths = np.unique(block.before[at], return_counts=True)
                columns = _steps(number[contexts] // parts), lengths, number[block.word[at]], block.pair_learned[at]
                yield part, ("pair", key, _packed(*columns))
        release()

    pairs = _dealt(_told(_gathered(found, numbered), texts).mapPartitions(pairs_of), parts)

    def asks(part, pieces):
        rooms = Contexts(pieces["pair"])
        n = np.bincount(rooms.asks, minlength=len(rooms.asked))
        for home, at in _cut(rooms.asked % parts):
            yield home, ("ask", part, _packed(_steps(rooms.asked[at] // parts), n[at]))

    asking = _dealt(_gathered(pairs, asks), parts)

    def spelling(words: RDD, weights, seed: int, asked: RDD | None = None) -> tuple[RDD, RDD]:
        """The words' spellings, given customers of each word, and the grams asked for."""
        again = asked is not None

        def spell(part, pieces):
            own = Words(pieces)
            keys, place, sizes = own.grams()
            n = np.bincount(place, np.repeat(weights(own, pieces), sizes), len(keys)).astype(np.int64)
            for home, at in _cut(_subtree(keys) % parts):
                yield home, ("weights", part, _packed(n[at])) if again else ("gram", part, _packed(_steps(keys[at]), n[at]))

        told = _dealt(_gathered(words, spell), parts)
        asked, told = (asked, asked.union(told)) if again else (told, told)

        def first_customers(part, pieces):
            tree = Spellings(pieces["gram"], pieces.get("weights")).tree
            total = np.bincount(tree.keys[1], tree.customers[1], 1 << 16).astype(np.int64)
            yield np.flatnonzero(total), total[total > 0]

        customers = np.zeros(1 << 16, dtype=np.int64)
        for cells, n in _gathered(told, first_customers).collect():
            customers[cells] += n
        uppers = [seat_upper(customers.reshape(256, 256), burn_in + 1, seed + k) for k in range(samples)]

        def sampled(part, pieces):
            own = Spellings(pieces["gram"], pieces.get("weights"))
            random = np.random.default_rng([seed, part, len(own.place)])
            for _ in range(burn_in):
                own.tree.sweep(uppers[0], random)
            mean = 0.0
            for upper in uppers:
                own.tree.sweep(upper, random)
                mean = mean + own.tree.predictive(upper)[ORDER] / len(uppers)
            for home, values in zip(own.senders, np.split(np.log10(mean)[own.place], own.cuts), strict=True):
                yield home, ("gram", part, values.astype(np.float32))

        def summed(part, pieces):
            yield part, ("spelt", part, Words(pieces).spelt(pieces["gram"], parts))

        answered = vocabulary.union(_dealt(_gathered(told, sampled), parts))
        return _dealt(_gathered(answered, summed), parts), asked

    # First every word has one table in each context, and one of its own.
    words = vocabulary.union(asking)
    spelt, grams_asked = spelling(words, lambda own, _: np.minimum(own.customers, 1), seed)

    def sums(part, pieces):
        own = Words(pieces)
        yield int(own.n.sum()), int((own.n > 0).sum()), int(own.customers.sum())

    n_train, n_distinct, n_customers = map(sum, zip(*_gathered(words, sums).collect(), strict=True))

    def tables_of(words: RDD, seed: int, tables: float) -> float:
        def total(part, pieces):
            own = Words(pieces)
            yield sum(t.sum() for t in own.seatings(pieces["spelt"][0][1], tables, samples, seed)) / samples

        return float(sum(_gathered(words, total).collect()))

    def chances(own: Words, pieces, seed: int, before: float, tables: float, customers: int) -> np.ndarray:
        """Logs of the words' probabilities without context, averaged over seatings."""
        spelt = pieces["spelt"][0][1]
        mean = sum(own.seatings(spelt, before, samples, seed)) / samples
        return _log_sum(own.customers - WORD_DISCOUNT * mean, STRENGTH + WORD_DISCOUNT * tables, spelt) - np.log10(
            STRENGTH + customers
        )

    if n_train:
        words = words.union(spelt)
        tables = tables_of(words, seed, n_distinct)

        def answers(part, pieces):
            own = Words(pieces)
            chance = chances(own, pieces, seed, n_distinct, tables, n_customers)
            for home, at in own.asks:
                yield home, ("parent", part, (10.0 ** chance[at]).astype(np.float32))

        seated = pairs.union(_dealt(_gathered(words, answers), parts))

        def parents(rooms: Contexts, pieces) -> np.ndarray:
            found, given = np.zeros(len(rooms.asked)), {p[0]: p[1] for p in pieces.get("parent", [])}
            for home, at in _cut(rooms.asked % parts):
                found[at] = given[home]
            return found

        def tables_sent(part, pieces):
            rooms = Contexts(pieces["pair"])
            every = list(rooms.seatings(parents(rooms, pieces), burn_in + samples, seed))[burn_in:]
            yield part, ("seated", part, _packed(sum(every)))
            last = every[-1]
            n = np.bincount(rooms.asks, last[rooms.n > 0], len(rooms.asked)).astype(np.int64)
            for home, at in _cut(rooms.asked % parts):
                yield home, ("tables", part, _packed(n[at]))

        told = _dealt(_gathered(seated, tables_sent), parts)
        words = vocabulary.union(asking).union(told)
        n_customers = sum(c for _, _, c in _gathered(words, sums).collect())

        # Each table of a word is a customer of its spelling.
        before = tables
        first = words.union(spelt)
        spelt, _ = spelling(
            first, lambda own, p: list(own.seatings(p["spelt"][0][1], before, samples, seed + 1))[-1], seed + 1, grams_asked
        )
        words = words.union(spelt)
        tables = tables_of(words, seed + 2, before)

        def to_blocks(part, pieces):
            own, asked = Words(pieces), Vocabulary(pieces["found"])
            chance = chances(own, pieces, seed + 2, before, tables, n_customers).astype(np.float32)
            for key, at in zip(asked.senders, np.split(asked.place, asked.cuts), strict=True):
                yield key, ("word", part, _packed(own.n[at]), chance[at])

        def pairs_to_blocks(part, pieces):
            rooms = Contexts(pieces["pair"])
            seated = _unpacked(pieces["seated"][0][1])[0].astype(np.int64)
            of_room = [rooms.in_room(of).astype(np.int64) for of in (rooms.n, seated)]
            # Numbers of customers and tables are mostly small, unlike the chances that follow from them.
            for key, at, lengths in zip(rooms.senders, np.split(rooms.place, rooms.cuts), rooms.lengths, strict=True):
                room = at[np.cumsum(lengths) - lengths]
                yield key, ("pair", part, _packed(rooms.n[at], seated[at], *(of[room] for of in of_room), lengths))

        replies = _gathered(words.union(found), to_blocks).union(_gathered(pairs.union(told), pairs_to_blocks))
    else:

        def unknown(part, pieces):
            own = Vocabulary(pieces["found"])
            none = np.zeros(len(own.place), dtype=np.int64)
            for key, n in zip(own.senders, np.split(none, own.cuts), strict=True):
                yield key, ("word", part, _packed(n), np.full(len(n), np.log10(UNKNOWN)))

        replies = _gathered(found, unknown)

    def scored(rows):
        for (_, row), pieces in rows:
            yield from _scored(row, pieces, parts, samples, n_train, n_distinct)
        release()

    rows = _told(replies, texts).mapPartitions(scored)
    return written(spark.createDataFrame(rows, result, verifySchema=False), "lm-scores")


def _scored(
    row: dict, pieces: dict[str, list], parts: int, samples: int, n_train: int, n_distinct: int
) -> Iterator[tuple]:
    """The results of a block's texts."""
    block = Block(row)
    block.pair()
    counts, parent = np.zeros(len(block.words)), np.zeros(len(block.words))
    given = {p[0]: p[1:] for p in pieces["word"]}
    for part, at in block.to_words(parts):
        n, parent[at] = given[part]
        counts[at] = _unpacked(n)[0]
    chance = parent[block.word]
    given = {p[0]: p[1:] for p in pieces.get("pair", [])}
    if given:
        for part, at in block.to_contexts(parts):
            n, tables, room_n, room_tables, lengths = (c.astype(np.int64) for c in _unpacked(*given[part]))
            total = STRENGTH + room_n
            back = (STRENGTH + CONTEXT_DISCOUNT * (room_tables / samples)) / total
            own = (n - CONTEXT_DISCOUNT * (tables / samples)) / np.repeat(total, lengths)
            chance[at] = _log_sum(own.astype(np.float32), np.repeat(back.astype(np.float32), lengths), chance[at])

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(block.n_tokens)), block.n_tokens), values, len(block.n_tokens))

    base = np.log10(counts + 0.1) - np.log10(n_train + 0.1 * (n_distinct + 1))
    known = per_text((counts > 0)[block.word_of]).astype(np.int64)
    columns = block.n_tokens, known, per_text(base[block.word_of]), per_text(chance[block.pair_of])
    for id_, held, n, k, b, s in zip(row["ids"], row["held"], *(c.tolist() for c in columns), strict=True):
        yield id_, held, n, k, n_train, b, s
