"""Shards of near-equal size by k-d tree partitioning.

A node of the tree that stands for k shards is split where its weights divide as floor(k/2) : ceil(k/2), along the metadata
dimension in which it is widest relative to the whole table; a leaf holds one shard's target of bytes.
All nodes of a level are split together.  A weighted median is found by narrowing: rows carry one ordered 64-bit
position per dimension (the value, then a hash of the row's identity), each pass sums the weights of a fixed number of
equal position ranges per node, and only these sums reach the driver.  Equal values are thus divided by the hash, so
a group of copies of any size is split where the cut falls into it, and stays together elsewhere.  Rows that are equal in
everything get a hash of their own place in the table, which is written down before it is used, so that cuts divide them too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.sources.session import through_table

TIE_BITS = 31
RANGES = 1024
TOLERANCE = 2.0**-14
CELL_ROWS = 16384


@dataclass
class Node:
    """`count` shards from `first` on; rows at `position` <= `cut` in `dim` go to the left child."""

    first: int
    count: int
    dim: str | None = None
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def shard_of(node: Node) -> Column:
    """The leaf of a row, named by its first shard, as one expression over the position columns."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(node.dim) <= F.lit(node.cut).cast("long"), shard_of(node.left)).otherwise(shard_of(node.right))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def grow(rows: DataFrame, dims: Sequence[str], weight: str, shards: int) -> Node:
    """The tree over a table with one ordered long per dimension (positions) and a weight."""
    root = Node(0, shards)
    whole: dict[str, int] = {}
    while True:
        open_ = [n for n in _leaves(root) if n.count > 1]
        if not open_:
            return root
        placed = rows.withColumn("_node", shard_of(root))
        ends = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
        found = placed.groupBy("_node").agg(F.sum(weight).alias("total"), *ends).collect()
        sums = {r["_node"]: r for r in found}
        if not whole:
            own = sums.get(0)
            whole = {d: max(own[f"hi_{d}"] - own[f"lo_{d}"], 1) if own else 1 for d in dims}
        low, high, want = {}, {}, {}
        for n in open_:
            r = sums.get(n.first)
            n.dim = max(dims, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d] if r else 0))
            low[n.first], high[n.first] = (r[f"lo_{n.dim}"], r[f"hi_{n.dim}"]) if r else (0, 0)
            want[n.first] = (r["total"] if r else 0) * (n.count // 2) / n.count
        slack = TOLERANCE * sum(r["total"] for r in found) / shards
        below = dict.fromkeys(want, 0)
        active = {n.first for n in open_}
        while active:
            step = {k: (high[k] - low[k]) // RANGES + 1 for k in active}
            ranges = placed.where(F.col("_node").isin(sorted(active)))
            position = _choose({n.first: F.col(n.dim) for n in open_ if n.first in active})
            start, end, width = (_choose({k: F.lit(v[k]).cast("long") for k in active}) for v in (low, high, step))
            ranges = ranges.select("_node", weight, position.alias("_p"), start.alias("_s"), width.alias("_w")).where(
                F.col("_p").between(F.col("_s"), end)
            )
            cells = ranges.groupBy("_node", F.expr("(_p - _s) div _w").alias("cell"))
            by_node: dict[int, list] = {k: [] for k in active}
            for r in cells.agg(F.sum(weight).alias("w")).collect():
                by_node[r["_node"]].append((r["cell"], r["w"]))
            for k in sorted(active):
                base, limit = low[k], high[k]
                chosen = (base, limit, 0)
                for cell, w in sorted(by_node[k]):
                    chosen = (base + cell * step[k], min(base + (cell + 1) * step[k] - 1, limit), w)
                    if below[k] + w >= want[k]:
                        break
                    below[k] += w
                low[k], high[k], inner = chosen
                if inner <= slack or low[k] >= high[k]:
                    active.discard(k)
                    if want[k] - below[k] < inner / 2:
                        high[k] = low[k] - 1
        for n in open_:
            n.cut = high[n.first]
            half = n.count // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.count - half)


def _choose(by_node: dict[int, Column]) -> Column:
    pairs = sorted(by_node.items())
    return reduce(lambda rest, p: F.when(F.col("_node") == p[0], p[1]).otherwise(rest), pairs[:-1][::-1], pairs[-1][1])


def assign(rows: DataFrame, dims: Sequence[str], weight: str, tie: Sequence[str], shards: int) -> DataFrame:
    """`rows` with `shard` and `slot` (gapless from 0 in each shard).

    `dims` are non-negative whole numbers below 2^32.  `tie` names the columns that tell rows apart; rows equal in all of them
    are interchangeable: each takes its own hash, so they are spread over the cells and divided by cuts like any others.  Slots count by cells of bounded size: a shard is cut by the hash of `tie`, cells are
    counted, and a row's slot is its place in the cell behind the rows of the cells before it.
    """
    rows = through_table(rows, "rows")
    same = [F.col(t).eqNullSafe(F.col(f"_t_{t}")) for t in tie]
    again = rows.groupBy(*tie).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    again = again.select(*[F.col(t).alias(f"_t_{t}") for t in tie], "_copies")
    rows_ = rows.withColumn("_place", F.monotonically_increasing_id()).join(again, reduce(Column.__and__, same), "left")
    mark = F.when(F.col("_copies") > 1, F.xxhash64(*tie, "_place")).otherwise(F.xxhash64(*tie))
    places = [
        F.shiftleft(F.coalesce(F.col(d), F.lit(0)).cast("long"), TIE_BITS)
        .bitwiseOR(F.shiftrightunsigned(mark, 64 - TIE_BITS))
        .alias(f"_at_{d}")
        for d in dims
    ]
    spread = through_table(rows_.select(*rows.columns, *places, mark.alias("_mark")), "positions")
    tree = grow(spread, [f"_at_{d}" for d in dims], weight, shards)
    cells = max(1, ceil(spread.count() / (shards * CELL_ROWS)))
    placed = spread.select(
        *rows.columns, "_mark", shard_of(tree).alias("shard"), F.pmod("_mark", F.lit(cells)).alias("_cell")
    )
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_mark", *[F.col(t).asc_nulls_first() for t in tie])
    numbered = placed.withColumn("_within", F.row_number().over(inside) - 1)
    slot = (F.col("_before") + F.col("_within")).cast("long").alias("slot")
    return numbered.join(offsets, ["shard", "_cell"]).select(*rows.columns, "shard", slot)


def shard_documents(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) under the law `bytes`: shard sizes are near equal.

    The size of a row is its UTF-8 bytes plus 8; a null text has no bytes and the checksum of an empty one.  The
    dimensions are size, characters and checksum, so equal texts lie at one point and share a shard unless a
    cut divides their group.  A null id counts as an id of its own; repeated rows all get slots.  An empty table gives an
    empty table, and columns not named are ignored.  `grown_shard` is null: only the law `key` has it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.char_length(text).cast("long").alias("chars"),
    )
    placed = assign(rows, ["size", "chars", "text_crc32"], "size", ["doc_id", "size", "text_crc32"], shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
