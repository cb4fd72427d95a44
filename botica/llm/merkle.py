"""Merkle manifest of a dataset, with leaf places from ranks in bitmaps.

Every row is a leaf. The ids of a group are kept as a bitmap in words of 64 bits, of
which only those with a bit set are stored; tasks make parts of it that are merged by
OR. Directories of popcounts over ever wider stretches of ids tell how many leaves lie
before a word, the word's own bits how many lie before an id: so a leaf's place is
looked up, not sorted for. Leaves then go into arrays by place, and each array is
reduced by ten levels at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from botica.llm.staging import dense, numbered, ship_code, written

# Levels that one array of nodes is reduced by; it has two to this power of slots.
LEVELS = 10
# Bits of an id within a word, then of words within a stretch, of stretches within a
# wider one, and so on; the widest stretch holds all ids but the 16 highest bits.
WORD = 6
STRETCHES = (10, 16, 16)


def field(name: str) -> Column:
    """A value as text: its UTF-8 byte count, a colon and itself; a dash for null."""
    text = F.col(f"`{name}`").cast("string")
    return stated(text)


def stated(text: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _lifted(name: str) -> Column:
    """One more than an integer, also beyond the longest."""
    return F.col(f"`{name}`").cast("decimal(20,0)") + F.lit(1).cast("decimal(20,0)")


def _hash(node: bytes) -> bytes:
    return sha256(node).hexdigest().encode()


def reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of each level, from the given ones up; runs of two become their hash."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([_hash(b"".join(now[k : k + 2])) for k in range(0, len(now), 2)])
    return out


def path(levels: list[list[bytes]], slot: int) -> tuple[bytes, str]:
    """Siblings from a slot up, one after another, and for each level their side: L, R or none (-)."""
    siblings, sides = [], []
    for nodes in levels[:-1]:
        other = slot ^ 1
        if other < len(nodes):
            siblings.append(nodes[other])
            sides.append("R" if other > slot else "L")
        else:
            sides.append("-")
        slot >>= 1
    return b"".join(siblings), "".join(sides)


def folded(node: bytes, siblings: bytes, sides: str) -> bytes:
    """The root that a node and its siblings lead to."""
    at = 0
    for side in sides:
        if side == "-":
            node = _hash(node)
            continue
        other = siblings[at : at + 64]
        at += 64
        node = _hash(node + other if side == "R" else other + node)
    return node


def _shifted(value: int, by: str) -> Column:
    return F.call_function("shiftleft", F.lit(value).cast("long"), F.col(by))


def ranks(rows: DataFrame) -> DataFrame:
    """tree, row, slot: the place of each row among those of its tree, by id, then leaf.

    ``rows`` has tree, row, id (long; null comes first) and leaf. Rows of one id, and
    those without, are few or many: they are numbered by a sort of them alone.
    """
    low = F.col("id").bitwiseAND(F.lit((1 << WORD) - 1)).cast("int")
    word = F.shiftright("id", WORD)
    named = rows.where("id is not null").select("tree", "row", "id", "leaf", word.alias("word"), low.alias("low"))
    words = named.groupBy("tree", "word").agg(
        F.bit_or(_shifted(1, "low")).alias("bits"),
        F.count("*").alias("leaves"),
    )
    words = written(words, "merkle-words")
    unnamed = rows.where("id is null").groupBy("tree").agg(F.count("*").alias("unnamed"))

    # Leaves before each stretch within the next wider one; a window never has more than 2^16 rows.
    level = words.select("tree", F.col("word").alias("s0"), "leaves")
    directories = []
    for k, width in enumerate([*STRETCHES, None]):
        wide = (F.lit(0) if width is None else F.shiftright(f"s{k}", width)).alias(f"s{k + 1}")
        level = level.select("tree", f"s{k}", wide, "leaves")
        before = Window.partitionBy("tree", f"s{k + 1}").orderBy(f"s{k}").rowsBetween(Window.unboundedPreceding, -1)
        directory = level.withColumn(f"before{k}", F.coalesce(F.sum("leaves").over(before), F.lit(0)))
        directories.append(directory.drop("leaves"))
        level = level.groupBy("tree", f"s{k + 1}").agg(F.sum("leaves").alias("leaves"))
    start = words.select("tree", "bits", "leaves", F.col("word").alias("s0"))
    for k, directory in enumerate(directories):
        start = start.join(directory, ["tree", f"s{k}"])
    start = start.join(unnamed, "tree", "left").select(
        "tree",
        F.col("s0").alias("word"),
        "bits",
        # More leaves than ids: some id is there more than once.
        (F.bit_count("bits") != F.col("leaves")).alias("crowded"),
        (sum((F.col(f"before{k}") for k in range(len(directories))), F.coalesce("unnamed", F.lit(0)))).alias("before"),
    )
    start = written(start, "merkle-ranks")
    found = named.join(start, ["tree", "word"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(_shifted(-1, "low"))))
    plain = found.where("not crowded").select("tree", "row", (F.col("before") + below).alias("slot"))

    # The rest: ids before it in its word, and then its turn among the rows of its id.
    same = found.where("crowded").groupBy("tree", "word", "before", "id").agg(F.count("*").alias("copies"))
    earlier = Window.partitionBy("tree", "word").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    same = same.select(
        "tree", "id", (F.col("before") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))).alias("base")
    )
    crowd = found.where("crowded").select("tree", "row", "id", "leaf")
    crowd = crowd.unionByName(rows.where("id is null").select("tree", "row", "id", "leaf"))
    order = ["tree", "id", "leaf", "row"]
    crowd = crowd.repartitionByRange(*order).sortWithinPartitions(*order)
    crowd = written(dense(numbered(crowd, "merkle-crowd", "at"), "at", "turn"), "merkle-turns")
    firsts = crowd.groupBy("tree", "id").agg(F.min("turn").alias("first"))
    turns = crowd.join(
        firsts.withColumnsRenamed({"tree": "t", "id": "i"}), F.col("tree").eqNullSafe(F.col("t")) & F.col("id").eqNullSafe(F.col("i"))
    ).select("tree", "row", "id", (F.col("turn") - F.col("first")).alias("turn"))
    named_turns = turns.where("id is not null").join(same, ["tree", "id"])
    named_turns = named_turns.select("tree", "row", (F.col("base") + F.col("turn")).alias("slot"))
    first_turns = turns.where("id is null").select("tree", "row", F.col("turn").alias("slot"))
    return plain.unionByName(named_turns).unionByName(first_turns)


def arrays(nodes: DataFrame, levels: DataFrame, *carried: str) -> DataFrame:
    """tree, block, levels and an array for each column, in the order of the slots.

    A block has the nodes of 2^LEVELS slots at most, and ``levels`` those that are left
    for it to be reduced by.
    """
    columns = [F.struct("slot", "node", *carried).alias("entry")]
    held = nodes.select("tree", F.shiftright("slot", LEVELS).alias("block"), *columns)
    held = held.groupBy("tree", "block").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return held.join(levels, "tree").select(
        "tree", "block", "levels", *(F.col(f"entries.{c}").alias(c) for c in ("node", *carried))
    )


def _tops(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        nodes = (
            reduced([n.encode() for n in row], min(LEVELS, left))[-1][0].decode()
            for row, left in zip(batch.column("node").to_pylist(), batch.column("levels").to_pylist(), strict=True)
        )
        yield pa.RecordBatch.from_arrays(
            [batch.column("tree"), batch.column("block"), pa.array(nodes, pa.string())], ["tree", "slot", "node"]
        )


def _downward(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths of a block's slots: within it, then the block's own."""
    for batch in parts:
        for row in batch.to_pylist():
            levels = reduced([n.encode() for n in row["node"]], min(LEVELS, row["levels"]))
            first = row["block"] << LEVELS
            paths = [path(levels, k) for k in range(len(row["node"]))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["tree"]] * len(paths), pa.string()),
                    pa.array(range(first, first + len(paths)), pa.int64()),
                    pa.array([s.decode() + row["siblings"] for s, _ in paths], pa.string()),
                    pa.array([s + row["sides"] for _, s in paths], pa.string()),
                ],
                ["tree", "slot", "siblings", "sides"],
            )


def climbed(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From arrays of leaves: tree and root; and tree, block, siblings, sides of each block.

    ``first`` is a written table of ``arrays``. A round reduces what the one before left
    until every tree is one node; then paths are handed down, round by round.
    """
    rounds = [first]
    left = first.select("tree", "levels").distinct()
    most = first.agg(F.max("levels")).first()[0] or 0
    while True:
        now = written(
            rounds[-1].select("tree", "block", "levels", "node").mapInArrow(_tops, "tree string, slot long, node string"),
            "merkle-nodes",
        )
        most -= LEVELS
        if most <= 0:
            break
        left = left.select("tree", F.greatest(F.col("levels") - LEVELS, F.lit(0)).alias("levels"))
        rounds.append(written(arrays(now, left), "merkle-arrays"))
    roots = now.select("tree", F.col("node").alias("root"))
    paths = now.select("tree", "slot", F.lit("").alias("siblings"), F.lit("").alias("sides"))
    for upper in reversed(rounds[1:]):
        here = upper.join(paths.withColumnRenamed("slot", "block"), ["tree", "block"])
        paths = here.select("tree", "block", "levels", "node", "siblings", "sides").mapInArrow(
            _downward, "tree string, slot long, siblings string, sides string"
        )
    return roots, written(paths.withColumnRenamed("slot", "block"), "merkle-paths")


def _leaves(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per leaf: what its path hashes to, and the root it leads to, itself and tampered."""
    for batch in parts:
        for row in batch.to_pylist():
            nodes = [n.encode() for n in row["node"]]
            levels = reduced(nodes, min(LEVELS, row["levels"]))
            upper, sides = row["siblings"].encode(), row["sides"]
            proofs, roots = [], []
            for k, shown in enumerate(row["shown"]):
                own, own_sides = path(levels, k)
                siblings = own + upper
                proofs.append(sha256(siblings).hexdigest())
                roots.append(folded(shown.encode(), siblings, own_sides + sides).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["id"], pa.int64()),
                    pa.array(row["node"], pa.string()),
                    pa.array([row["subroot"]] * len(nodes), pa.string()),
                    pa.array([row["root"]] * len(nodes), pa.string()),
                    pa.array(proofs, pa.string()),
                    pa.array(roots, pa.string()),
                    pa.array([r == row["root"] for r in roots], pa.bool_()),
                ],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )


def _levels(nodes: Column) -> Column:
    """Halvings that leave one of so many nodes."""
    return F.length(F.bin(nodes - 1)).cast("int") * (nodes > 1).cast("int")


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered_col: str = "n_chars",
    tampered: Column | None = None,
) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the ``fields``, each a dash if null, else its byte count, a
    colon and its value. The leaves of a group ascend by id: null ids first, rows of one
    id by leaf (equal leaves are equal rows, whose order nothing shows). Pairs become
    the hash of both digests as text until one is left, the subroot; subroots ordered by
    group (null first, then by UTF-8 bytes) make the root likewise. A proof is a leaf's
    siblings up to the root. ``folded_root`` is recomputed from the leaf, for rows where
    ``tampered`` holds from one whose ``tampered_col`` is larger by one (null stays), and
    the original siblings; null counts as not tampered. Empty texts are leaves like
    others, other columns are not looked at, an empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    if tampered is None:
        tampered = F.lit(False)
    group = F.col(f"`{group_col}`").cast("string")
    leaf = F.sha2(F.concat(*(field(f) for f in fields)), 256)
    other = [stated(_lifted(f).cast("string")) if f == tampered_col else field(f) for f in fields]
    shown = F.when(F.coalesce(tampered, F.lit(False)), F.sha2(F.concat(*other), 256)).otherwise(leaf)
    leaves = numbered(
        docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"),
            F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("tree"),
            leaf.alias("leaf"),
            shown.alias("shown"),
        ),
        "merkle-leaves",
    )
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    sizes = written(sizes.select("tree", _levels(F.col("n")).alias("levels")), "merkle-sizes")
    placed = leaves.drop("tree").join(ranks(leaves), "row")
    placed = placed.select("tree", "slot", F.col("leaf").alias("node"), "id", "shown")
    first = written(arrays(placed, sizes, "id", "shown"), "merkle-arrays")
    subroots, paths = climbed(first)

    # The groups' roots are the leaves of one more tree.
    order = dense(numbered(subroots.orderBy("tree"), "merkle-order", "at"), "at", "slot")
    top = order.select(F.lit("").alias("tree"), "slot", F.col("root").alias("node"), F.col("tree").alias("of"))
    top_levels = order.agg(_levels(F.count("*")).alias("levels")).select(F.lit("").alias("tree"), "levels")
    top = written(arrays(top, top_levels, "of"), "merkle-top")
    root, top_paths = climbed(top)
    above = top.drop("levels").join(top_paths, ["tree", "block"]).join(top_levels, "tree").join(root, "tree")
    above = above.withColumnsRenamed({"siblings": "upper", "sides": "upper_sides"})

    def handed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                levels = reduced([n.encode() for n in row["node"]], min(LEVELS, row["levels"]))
                paths = [path(levels, k) for k in range(len(row["node"]))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["of"], pa.string()),
                        pa.array(row["node"], pa.string()),
                        pa.array([row["root"]] * len(paths), pa.string()),
                        pa.array([s.decode() + row["upper"] for s, _ in paths], pa.string()),
                        pa.array([s + row["upper_sides"] for _, s in paths], pa.string()),
                    ],
                    ["tree", "subroot", "root", "upper", "upper_sides"],
                )

    above = above.mapInArrow(handed, "tree string, subroot string, root string, upper string, upper_sides string")
    above = written(above, "merkle-above")
    whole = first.join(paths, ["tree", "block"]).join(above, "tree")
    whole = whole.withColumns(
        {"siblings": F.concat("siblings", "upper"), "sides": F.concat("sides", "upper_sides")}
    ).drop("upper", "upper_sides", "tree", "block")
    return whole.mapInArrow(
        _leaves,
        "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
