"""Mixing sources to target weights by a low-discrepancy schedule.

Each source is a stream of its documents in a fixed shuffled order, cut into blocks of
equal numbers of words. Golden-ratio points, mapped through the cumulative targets,
give a source to each slot of the mix; the k-th slot of a source takes its k-th block.
A stream that is used up begins again. ``mix`` has the mix itself, in the order of its
slots; documents are given in that order too. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from botica.llm.staging import as_read, numbered, written

WORD = r"[^\x20\x09-\x0D]+"
# Fixed value: 2^32 divided by the golden ratio; multiples of it modulo 2^32 spread evenly.
GOLDEN = 2654435769
_POINTS = 1 << 32
_CELLS = 1 << 12
# Words of a block, at any size of the corpus.
BLOCK_WORDS = 256


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *beside: str) -> DataFrame:
    """Sizes, shuffled order and the columns ``beside``; documents without an id are told apart by their row."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    sized = numbered(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            words.cast("long").alias("size"),
            *beside,
        ),
        "mix-sizes",
    )
    named = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    return sized.withColumn("key", F.md5(named.cast("binary")))


def _named(source: str = "source") -> list:
    """A source as two columns that never are null, to join on."""
    return [F.col(source).isNull().alias("unnamed"), F.coalesce(F.col(source), F.lit("")).alias("name")]


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2
) -> DataFrame:
    """unnamed, name, source_size, target, quota (words to take), lo, hi (its points).

    The targets are the weights' shares of ``percent`` of all words. No target passes
    ``most`` times its source; what is over goes to the others by weight. Sources fill
    up in the order of most words per weight, so the shares follow from sums so far.
    """
    sums = sized.groupBy(*_named()).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("unnamed", "name")
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    weighed = sums.withColumn("weight", weight.cast("long"))
    full = F.col("source_size") * most
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), "unnamed", "name")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    # In hundredths of words: whole numbers, so that every engine agrees.
    left = F.sum("source_size").over(every) * percent - 100 * F.coalesce(F.sum(full).over(before), F.lit(0))
    weighed = weighed.withColumn("left", left).withColumn("weights", F.sum("weight").over(rest))
    fits = full * 100 * F.col("weights") >= F.col("left") * F.col("weight")
    first = F.min(F.when(fits, F.col("place"))).over(every)
    weighed = weighed.withColumn("place", F.row_number().over(by_need)).withColumn("first", first)
    at_first = lambda c: F.max(F.when(F.col("place") == F.col("first"), F.col(c))).over(every)
    share = (F.col("weight") * at_first("left")).cast("double") / (100 * at_first("weights")).cast("double")
    target = F.when(F.col("place") < F.col("first"), full.cast("double")).otherwise(share)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    quota = F.floor(F.col("target") + 0.5).cast("long")
    all_quota = F.greatest(F.sum("quota").over(every), F.lit(1)).cast("double")
    hi = F.floor(F.sum("quota").over(upto).cast("double") / all_quota * F.lit(float(_POINTS)))
    return (
        weighed.withColumn("target", target)
        .withColumn("quota", quota)
        .withColumn("hi", hi.cast("long"))
        .withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long")))
        .select("unnamed", "name", "source_size", "target", "quota", "lo", "hi")
    )


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, unnamed, name, block: the order in which the mix takes the sources' blocks.

    Slots over a source's quota fall away; what the points leave short is taken at
    the end. No two blocks have the same slot.
    """
    spark = targets.sparkSession
    words = targets.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    slots = -(-words // block_words)
    width = _POINTS // _CELLS
    point = (F.col("id") * GOLDEN) % _POINTS
    slot = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point"))
    slot = slot.withColumn("cell", F.floor(F.col("point") / width))
    # Sources and points meet by cell of the line, then by their exact places on it.
    spans = targets.where("hi > lo").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))
    )
    drawn = (
        slot.join(spans, "cell")
        .where("point >= lo and point < hi")
        .select("slot", "unnamed", "name", F.shiftright("slot", 12).alias("chunk"))
    )
    source = ["unnamed", "name"]
    before = Window.partitionBy(*source).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        drawn.groupBy(*source, "chunk")
        .agg(F.count("*").alias("n"))
        .select(*source, "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    place = F.row_number().over(Window.partitionBy(*source, "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("place", place).join(starts, [*source, "chunk"])
    ranked = ranked.select("slot", *source, (F.col("start") + F.col("place")).alias("block"))
    blocks = targets.select(*source, F.ceil(F.col("quota") / block_words).alias("blocks"))
    counted = drawn.groupBy(*source).agg(F.count("*").alias("drawn"))
    closing = (
        blocks.join(counted, source, "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .where("drawn < blocks")
        .withColumn("block", F.explode(F.sequence(F.col("drawn"), F.col("blocks") - 1)))
        .withColumn("slot", F.lit(slots) + F.row_number().over(Window.orderBy("block", *source)) - 1)
        .select(F.col("slot").cast("long"), *source, "block")
    )
    ranked = ranked.join(blocks, source).where("block < blocks")
    return ranked.unionByName(closing, allowMissingColumns=True).select("slot", *source, "block")


def _mix(sized: DataFrame, block_words: int | None, **shares) -> tuple[DataFrame, DataFrame]:
    """(row, slot, block, at, pass, start, words) of all pieces taken, and the targets.

    ``at`` is the piece's first word in its source's stream.
    """
    block_words = block_words or BLOCK_WORDS
    targets = written(source_targets(sized, **shares), "mix-targets")
    source = ["unnamed", "name"]
    # Where a document begins in its source: sums by piece of the order, then within.
    docs = sized.select("row", "id", "size", "key", *_named()).withColumn("piece", F.substring("key", 1, 4))
    by_piece = Window.partitionBy(*source).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        docs.groupBy(*source, "piece")
        .agg(F.sum("size").alias("n"))
        .select(*source, "piece", F.coalesce(F.sum("n").over(by_piece), F.lit(0)).alias("piece_start"))
    )
    within = (
        Window.partitionBy(*source, "piece")
        .orderBy("key", "id", "size", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        docs.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, [*source, "piece"])
        .join(targets.select(*source, "source_size", "quota"), source)
        .where("size > 0")
        .withColumn("begin", F.col("piece_start") + F.col("before"))
    )
    passes = placed.select(
        "row", "size", "quota", *source, F.posexplode(F.array("begin", F.col("begin") + F.col("source_size")))
    ).toDF("row", "size", "quota", *source, "pass", "begin")
    end = F.least(F.col("begin") + F.col("size"), F.col("quota"))
    passes = passes.withColumn("end", end).where("end > begin")
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)
    pieces = passes.withColumn("block", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("block") * block_words, "begin")
    words_here = F.least((F.col("block") + 1) * block_words, "end") - start
    pieces = pieces.select(
        "row",
        *source,
        "block",
        "pass",
        start.alias("at"),
        (start - F.col("begin")).alias("start"),
        words_here.alias("words"),
    )
    mixed = schedule(targets, block_words).join(pieces, [*source, "block"])
    return mixed.drop(*source), targets


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int | None = None,
    **shares,
) -> DataFrame:
    """The mix, a row for each piece of a document: slot, id, source, pass, start, words.

    Pieces are dealt to partitions by ranges and ordered within them, by slot and then
    by their place in the stream; ``pass`` counts the times that the document has been
    taken before, ``start`` its words before the piece. Every run of slots from the first
    on has the sources' words near their shares. Empty tables give an empty result.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    mixed, _ = _mix(sized, block_words, **shares)
    return (
        sized.select("row", "id", "source")
        .join(mixed, "row")
        .repartitionByRange("slot", "at")
        .sortWithinPartitions("slot", "at")
        .select("slot", "id", "source", "pass", "start", "words")
    )


def mixed_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int | None = None,
    **shares,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words, repeats counted).

    Sources in the order of their code points, null last, weigh 5, 2, 1, repeating,
    and share 150 % of all words; see ``source_targets``. A source's taken words are
    its target, rounded. Texts without words, null ones too, have size 0 and give
    nothing; an empty table gives an empty result. Documents of one id are told apart.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    mixed, targets = _mix(sized, block_words, **shares)
    taken = mixed.groupBy("row").agg(F.sum("words").alias("taken"))
    return (
        sized.select("row", "id", "size", *_named())
        .join(taken, "row", "left")
        .join(targets, ["unnamed", "name"])
        .select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    )


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int | None = None,
    plain_files: bool = False,
    **shares,
) -> DataFrame:
    """The documents of the mix, with their columns: a row for each time one is taken.

    They are dealt to partitions by ranges and ordered within them, by the slot and place
    of their first piece: a document over several blocks comes whole at the first of them.
    A document taken in part keeps the words taken, with one blank between them. Texts
    without words, null and empty ones too, are not taken; null sources are one source;
    repeated rows are documents of their own; other columns stay as they are, null or
    not; an empty table gives an empty result.

    With ``plain_files``, ``docs`` that are Parquet files just as they were read are read
    once more instead of being copied. Any other frame is copied first, as its rows could
    differ when it is worked out again.
    """
    documents = as_read(docs) if plain_files else None
    if documents is None:
        copied = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"))
        documents = numbered(copied, "mix-documents", "place")
    field = lambda c: f"document.`{c}`"
    sized = _sized(documents, field(id_col), field(text_col), field(source_col), "place")
    mixed, _ = _mix(sized, block_words, **shares)
    times = mixed.groupBy("row", "pass").agg(
        F.min("start").alias("start"), F.sum("words").alias("words"), F.min(F.struct("at", "slot")).alias("first")
    )
    times = sized.select("row", "place", "size").join(times, "row").drop("row")
    part = F.array_join(
        F.slice(
            F.regexp_extract_all(f"document.`{text_col}`", F.lit(WORD), F.lit(0)),
            (F.col("start") + 1).cast("int"),
            F.col("words").cast("int"),
        ),
        " ",
    )
    text = F.when(F.col("words") == F.col("size"), F.col(field(text_col))).otherwise(part)
    return (
        documents.join(times, "place")
        .repartitionByRange("first.slot", "first.at")
        .sortWithinPartitions("first.slot", "first.at")
        .select(*(text.alias(c) if c == text_col else F.col(field(c)).alias(c) for c in docs.columns))
    )
