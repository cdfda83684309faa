"""Operator 13: Merkle manifest of a dataset.

Leaves of a tree are numbered in order and cut into aligned blocks of 512, three levels of runs of eight. A block keeps
each of its levels as one hex string: parents are the hashes of its fixed-width substrings, and the siblings of a node
are the two substrings that flank it in its run. The tops of all blocks are the nodes of the next round, until each
tree has one node left; the trees' roots are the nodes of one more tree. Paths come down the same rounds: a node's path
is the flanks in its block and then the path of its block. Everything is DataFrame functions; groups are blocks.

Defined results: null fields are hashed as ``-``, null ids come first and null trees too; rows with equal ids stand in
the order of their leaves, so equal rows may swap; those whose id is null are not tampered with; a single row has an
empty path, its leaf is the root; an empty table gives no rows; texts are hashed whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrain.llm.common import stored

ARITY_BITS = 3
LEVELS = 3
BLOCK_BITS = ARITY_BITS * LEVELS
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """Hex SHA-256 of strings one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that neighbours cannot run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """Position of each row in its ``tree`` by the order, from 0, and the tree's ``size``.

    Rows are sorted by sampled ranges of tree and order, so a tree that holds most rows has many ranges; a range's rows
    of a tree are numbered from the counts of the ranges before it.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    dealt = stored(dealt.withColumn("at", F.monotonically_increasing_id()), "merkle-order").withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("part", "tree").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("part").alias("p"), F.col("tree").alias("t"), F.sum("n").over(Window.partitionBy("tree")).alias("size"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    found = dealt.join(counts, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "p", "t", "shift")


def levels_of(size: Column) -> Column:
    """Levels of runs inside a block of a tree of so many nodes."""
    steps = F.when(size <= 1, 0)
    for level in range(1, LEVELS):
        steps = steps.when(size <= 1 << (ARITY_BITS * level), level)
    return steps.otherwise(LEVELS)


def climb(nodes: DataFrame, payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Stored blocks of each round, lowest first, and the root of each tree (tree, node).

    ``nodes`` has tree, pos, size and node; payload columns stay with their node in the blocks of the first round. One
    number goes to the driver, the size of the largest tree, which tells the number of rounds.
    """
    rounds, most = [], nodes.agg(F.max("size")).first()[0] or 0
    while True:
        slot = F.col("pos").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("slot")
        entries = F.array_sort(F.collect_list(F.struct(slot, "node", *payload))).alias("entries")
        blocks = nodes.groupBy("tree", "size", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(entries)
        blocks = blocks.withColumn("level0", F.array_join(F.transform("entries", lambda e: e["node"]), ""))
        blocks = blocks.withColumn("entries", F.transform("entries", lambda e: F.struct(e["slot"], *[e[c].alias(c) for c in payload])))
        for level in range(LEVELS):
            # a level as bytes is cut at any place without a walk over its characters
            blocks = blocks.withColumn(f"level{level}", F.col(f"level{level}").cast("binary"))
            width = HEX << ARITY_BITS
            runs = F.sequence(F.lit(0), F.ceil(F.octet_length(f"level{level}") / width).cast("int") - 1)
            parents = F.transform(runs, lambda r: F.sha2(F.substring(F.col(f"level{level}"), r * width + 1, F.lit(width)), 256))
            blocks = blocks.withColumn(f"level{level + 1}", F.array_join(parents, ""))
        blocks = blocks.withColumn(f"level{LEVELS}", F.col(f"level{LEVELS}").cast("binary")).withColumn("steps", levels_of(F.col("size")))
        blocks = stored(blocks, "merkle-blocks")
        rounds.append(blocks)
        top = F.element_at(F.array(*[F.col(f"level{i}") for i in range(LEVELS + 1)]), F.col("steps") + 1).cast("string")
        higher = F.shiftright(F.col("size") - 1, BLOCK_BITS) + 1
        nodes, payload = blocks.select("tree", F.col("block").alias("pos"), higher.alias("size"), top.alias("node")), []
        if most <= 1 << BLOCK_BITS:
            return rounds, nodes.select("tree", "node")
        most = ((most - 1) >> BLOCK_BITS) + 1


def flanks(slot: Column) -> Column:
    """The parts of its run left and right of a node, on each level of its block from the lowest on."""
    cuts = []
    for level in range(LEVELS):
        index = F.shiftright(slot, ARITY_BITS * level)
        run = F.shiftleft(F.shiftright(index, ARITY_BITS), ARITY_BITS)
        text = F.col(f"level{level}")
        left = F.substring(text, run * HEX + 1, (index - run) * HEX)
        right = F.substring(text, (index + 1) * HEX + 1, (run + 7 - index) * HEX)
        cuts.append(F.struct(left.cast("string").alias("left"), right.cast("string").alias("right")))
    return F.slice(F.array(*cuts), F.lit(1), F.col("steps"))


def descend(rounds: list[DataFrame], roots: DataFrame, payload: list[str], carried: list[str]) -> DataFrame:
    """Each node of the lowest round with its path up to where ``roots`` (tree, path and carried columns) begin.

    Returns tree, node, the payload, path and the carried columns.
    """
    above = roots.select("tree", F.lit(0).cast("long").alias("pos"), "path", *carried)
    for i, blocks in enumerate(reversed(rounds)):
        kept = payload if i == len(rounds) - 1 else []
        over = above.select(F.col("tree").alias("t"), "pos", F.col("path").alias("upper"), *carried)
        met = blocks.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("pos")))
        entry = F.transform("entries", lambda e: F.struct(
            e["slot"].alias("slot"), F.substring(F.col("level0"), e["slot"] * HEX + 1, F.lit(HEX)).cast("string").alias("node"),
            F.concat(flanks(e["slot"]), F.col("upper")).alias("path"), *[e[c].alias(c) for c in kept],
        ))
        met = met.select("tree", "block", *carried, F.explode(entry).alias("e"))
        pos = F.shiftleft("block", BLOCK_BITS) + F.col("e.slot")
        above = met.select("tree", pos.alias("pos"), "e.node", "e.path", *[F.col(f"e.{c}") for c in kept], *carried)
    return above.drop("pos")


def manifest(
    docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """Leaf, subroot, root, path and the check of each row.

    ``tampered`` tells the rows whose text is then changed (A-Z to lower case); their new leaf, any other row's own
    one, is folded along the row's original path: ``folded_root`` equals ``root`` if nothing changed.
    Rows with a null condition are not changed. Columns: id, leaf, subroot, root, path, folded_root, verified.
    """
    values = {c: F.col(c) for c in fields}
    changed = values | {text_col: lower_ascii(F.col(text_col).cast("string"))}
    leaf, other = (digest(*map(field, v.values())) for v in (values, changed))
    rows = docs.select(
        F.col(tree_col).alias("tree"), F.col(id_col).alias("id"), leaf.alias("node"),
        F.when(F.lit(False) if tampered is None else tampered, other).alias("forged"),
    )
    # stored first, as both the sampling of ranges and the sorting read it
    rounds, subroots = climb(numbered(stored(rows, "merkle-leaves"), "id", "node"), ["id", "forged"])
    trees = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("name"), "node")
    tree_rounds, top = climb(numbered(trees, "name"), ["name"])
    top = top.select("tree", F.col("node").alias("root"), F.array().cast(PATH).alias("path"))
    tops = descend(tree_rounds, top, ["name"], ["root"]).select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "path", "root")
    found = descend(rounds, tops, ["id", "forged"], ["subroot", "root"])
    folded = F.aggregate("path", F.coalesce("forged", "node"), lambda node, cut: digest(cut["left"], node, cut["right"]))
    return found.select(
        F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda cut: F.concat(cut["left"], cut["right"])), "").cast("binary"), 256)
