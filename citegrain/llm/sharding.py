"""Operator 3: sharding by a k-d tree, with DataFrame functions only.

A document is a point of metadata that its text alone decides: bytes, lines and characters per thousand bytes. The
point set is split recursively: in each node along the dimension that is widest against the whole table, at the
median weighted by bytes, until there are as many leaves as shards. Equal texts are the same point and stay together.

A weighted median is found by the cluster: bytes are summed per node and cell of the dimension, and the cell that
crosses the wanted share is cut into cells again until it is light enough; the driver sees at most ``CELLS`` sums
per node. Ties on a dimension are parted by the text's CRC-32 in the lower half of the coordinate. The tree then is
an expression, so no document is shuffled to find its shard. Slots number the rows of a shard block by block.

Defined results: a null text weighs one byte and is the point of the empty text; repeated rows get slots of their
own in one shard; an empty table gives no rows; with fewer distinct texts than shards some shards stay empty; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from citegrain.llm.common import stored

CELLS = 1024
# A cut is good enough when it misses the wanted share by less than this part of a shard.
TOLERANCE = 0.002
ROWS_PER_BLOCK = 20_000
DIMENSIONS = ("d_bytes", "d_lines", "d_density")


@dataclass
class Node:
    """A range of shards; inner nodes are split by ``coordinate < cut``."""

    first: int
    count: int
    dimension: str = ""
    cut: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def leaves(self) -> list["Node"]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def column(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if self.left is None:
            return F.lit(self.first)
        return F.when(F.col(self.dimension) < F.lit(self.cut), self.left.column()).otherwise(self.right.column())


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, size, CRC-32 and coordinates: a dimension's value in the upper half, the CRC in the lower."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_bytes, chars = F.octet_length(text), F.length(text)
    rows = docs.select(
        F.col(id_col).alias("__id"), (n_bytes + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        n_bytes.cast("long").alias("v_bytes"), (chars - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("v_lines"),
        F.coalesce(F.try_divide(1000 * chars.cast("long"), n_bytes), F.lit(1000.0)).cast("long").alias("v_density"),
    )
    high = F.lit(1 << 32)
    return rows.select("__id", "size", "text_crc32", *[(F.col("v" + d[1:]) * high + F.col("text_crc32")).alias(d) for d in DIMENSIONS])


def grow(rows: DataFrame, n_shards: int) -> Node:
    """The tree of ``n_shards`` leaves over points; each round of a level is one aggregation for all its nodes."""
    root = Node(0, n_shards)
    spread = None
    while open_nodes := [n for n in root.leaves() if n.count > 1]:
        bounds = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for f, name in ((F.min, "low"), (F.max, "high"))]
        found = {r["node"]: r for r in rows.groupBy(root.column().alias("node")).agg(F.sum("size").alias("w"), *bounds).collect()}
        if not found:
            return Node(0, 1)
        if spread is None:
            spread = {d: max(1, found[0][f"high_{d}"] - found[0][f"low_{d}"]) for d in DIMENSIONS}
        search = {}
        for node in open_nodes:
            row = found.get(node.first)
            if row is None:
                node.count = 1
                continue
            node.dimension = max(DIMENSIONS, key=lambda d: (row[f"high_{d}"] - row[f"low_{d}"]) / spread[d])
            low, high = row[f"low_{node.dimension}"], row[f"high_{node.dimension}"]
            n_left = node.count // 2
            search[node.first] = [node, low, high, row["w"] * n_left / node.count, 0, row["w"] / node.count * TOLERANCE]
        refine(rows, root, search)
        for node, *_ in search.values():
            n_left = node.count // 2
            node.left, node.right = Node(node.first, n_left), Node(node.first + n_left, node.count - n_left)
    return root


def refine(rows: DataFrame, root: Node, search: dict[int, list]) -> None:
    """Set each node's cut. A search holds node, lowest and highest coordinate, wanted weight, weight below, tolerance."""
    pending = dict(search)
    while pending:
        where = root.column()
        cell = coordinate = None
        for first, (node, low, high, *_rest) in pending.items():
            width = (high - low) // CELLS + 1
            here = (where == first) & F.col(node.dimension).between(low, high)
            value = F.floor((F.col(node.dimension) - F.lit(low)) / F.lit(width)) if width < 2 else F.expr(f"({node.dimension} - {low}L) div {width}L")
            cell = F.when(here, value) if cell is None else cell.when(here, value)
            coordinate = F.when(here, F.lit(first)) if coordinate is None else coordinate.when(here, F.lit(first))
        sums = rows.select(coordinate.alias("node"), cell.cast("long").alias("cell"), "size").where("node is not null")
        cells: dict[int, dict[int, int]] = {}
        for r in sums.groupBy("node", "cell").agg(F.sum("size").alias("w")).collect():
            cells.setdefault(r["node"], {})[r["cell"]] = r["w"]
        for first in list(pending):
            node, low, high, wanted, below, tolerance = pending[first]
            width = (high - low) // CELLS + 1
            weights = cells[first]
            for at in sorted(weights):
                if below + weights[at] >= wanted:
                    break
                below += weights[at]
            start = low + at * width
            stop = min(high, start + width - 1)
            # cut before or after the crossing cell, whichever is nearer
            node.cut = start if wanted - below <= below + weights[at] - wanted else stop + 1
            if min(wanted - below, below + weights[at] - wanted) <= tolerance or start == stop:
                del pending[first]
            else:
                pending[first] = [node, start, stop, wanted, below, tolerance]


def slots(rows: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Gapless numbers from 0 within each shard: numbers within hashed blocks, added to the sizes of earlier blocks."""
    n_blocks = max(1, -(-n_rows // (n_shards * ROWS_PER_BLOCK)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("__id", "text_crc32"), F.lit(n_blocks)))
    counts = rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("__id", "text_crc32", "size")) - 1
    return rows.withColumn("number", number).join(starts, ["shard", "block"]).withColumn("slot", (F.col("first") + F.col("number")).cast("long"))


def shard(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Size, CRC-32, shard and slot of each document; shards hold near equal bytes."""
    rows = stored(points(docs, id_col, text_col), "shard-points")
    tree = grow(rows, n_shards)
    placed = rows.withColumn("shard", tree.column().cast("int"))
    return slots(placed, rows.count(), n_shards).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """Leaves needed so that none exceeds the target by more than the tolerance of its cuts."""
    return max(1, -(-total_bytes // target_bytes))
