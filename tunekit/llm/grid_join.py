"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are rotated onto their leading principal dimensions and sorted by the cells of a grid whose width is the
distance that the cosine threshold allows.  The sorted sequence of every label is cut into blocks; intervals of blocks
form a tree with bounding boxes.  Pairs of intervals are joined recursively from the root, leaving out those whose boxes
are further apart than the grid width (a projection never lengthens a distance, so no link is lost).  Each
pair of blocks that is left is one task: one matrix product, exact cosines in double precision, a count of links per
vector and a spanning forest of them.  Equal vectors of a label are one vector with a multiplicity throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.llm.common import fan_out, merge_labels
from tunekit.llm.components import components
from tunekit.sources.session import through_table

THRESHOLD = 0.93
LEADING = 6
BLOCK = 1024
BRANCHES = 8
STRIPE = 64


def linkable(vector: Column) -> Column:
    """True for vectors without null, infinite or undefined components that are not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def principal(classes: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """The leading principal directions of the unit vectors, by vector length; a d x d moment matrix per partition is sent."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for d, part in frame.groupby("d"):
                x = _unit(np.stack(part["v"].to_numpy()))
                x = np.column_stack((np.ones(len(x)), x))
                sums[d] = sums.get(d, 0) + x.T @ x
        if sums:
            yield pd.DataFrame({"d": list(sums), "m": [m.ravel() for m in sums.values()]})

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"d": [key[0]], "m": [np.sum(np.stack(frame["m"].to_numpy()), axis=0)]})

    parts = classes.select("d", "v").mapInPandas(moments, "d int, m array<double>")
    out = {}
    for row in parts.groupBy("d").applyInPandas(total, "d int, m array<double>").collect():
        m = np.array(row["m"]).reshape(row["d"] + 1, -1)
        mean = m[0, 1:] / m[0, 0]
        _, vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
        out[row["d"]] = vectors[:, ::-1][:, :leading]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def in_blocks(classes: DataFrame, directions: dict[int, np.ndarray], width: float, block: int) -> DataFrame:
    """(block, label, d, lo, hi, ids, sizes, vectors): the classes in grid order, cut into blocks of one label and length."""
    leading = max((m.shape[1] for m in directions.values()), default=1)

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = np.zeros((len(frame), leading))
            for d, rows in frame.groupby("d").indices.items():
                own = _unit(np.stack(frame["v"].to_numpy()[rows])) @ directions[d]
                at[rows, : own.shape[1]] = own
            cells = np.floor(at / width).astype(np.int32)
            yield frame.assign(p=list(at), **{f"c{i}": cells[:, i] for i in range(leading)})

    cells = [f"c{i}" for i in range(leading)]
    kind = classes.schema["label"].dataType.simpleString()
    fields = f"label {kind}, d int, rep long, size long, v array<double>"
    placed = classes.select("label", "d", "rep", "size", "v").mapInPandas(
        project, f"{fields}, p array<double>, {', '.join(f'{c} int' for c in cells)}"
    )
    keys = ["label", "d", *cells]
    ordered = placed.repartitionByRange(fan_out(classes.sparkSession), *keys).sortWithinPartitions(*keys, "rep")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held: list[pd.DataFrame] = []

        def blocks(final: bool) -> Iterator[pd.DataFrame]:
            nonlocal number, held
            frame = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
            held = []
            while len(frame):
                same = (frame["label"] == frame["label"].iloc[0]) & (frame["d"] == frame["d"].iloc[0])
                n = min(block, int(np.argmin(same.to_numpy())) if not same.all() else len(frame))
                if n == len(frame) < block and not final:
                    held = [frame]
                    return
                part, frame = frame.iloc[:n], frame.iloc[n:]
                at, v = np.stack(part["p"].to_numpy()), np.stack(part["v"].to_numpy())
                yield pd.DataFrame(
                    {
                        "block": [number], "label": [part["label"].iloc[0]], "d": [int(part["d"].iloc[0])],
                        "lo": [at.min(axis=0)], "hi": [at.max(axis=0)],
                        "ids": [part["rep"].to_numpy(np.int64).tobytes()],
                        "sizes": [part["size"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()],
                    }
                )
                number += 1

        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= 2 * block:
                yield from blocks(False)
        yield from blocks(True)

    schema = f"block long, label {kind}, d int, lo array<double>, hi array<double>, ids binary, sizes binary, vectors binary"
    return ordered.mapInPandas(cut, schema)


def near_blocks(blocks: DataFrame, width: float, branches: int) -> DataFrame:
    """(a, b): the pairs of blocks whose boxes are at most `width` apart, by joining intervals from the root downwards."""
    order = Window.partitionBy("label", "d").orderBy("block")
    leaves = blocks.select("label", "d", "block", "lo", "hi").withColumn("seq", (F.row_number().over(order) - 1).cast("long"))
    leaves = through_table(leaves, "intervals")
    most = leaves.agg(F.max("seq")).first()[0]
    if most is None:
        return leaves.select(F.col("block").alias("a"), F.col("block").alias("b"))
    levels = 0
    while branches**levels <= most:
        levels += 1
    size = len(leaves.first()["lo"])

    def nodes(level: int, side: str) -> DataFrame:
        node = F.expr(f"seq div {branches**level}L")
        box = [F.min(F.get("lo", i)).alias(f"lo{i}") for i in range(size)] + [F.max(F.get("hi", i)).alias(f"hi{i}") for i in range(size)]
        own = leaves.groupBy("label", "d", node.alias("node")).agg(*box)
        renamed = [F.col(c).alias(f"{c}_{side}") for c in own.columns if c not in ("label", "d")]
        return own.select("label", "d", F.expr(f"node div {branches}L").alias(f"up_{side}"), *renamed)

    pairs = leaves.select("label", "d").distinct().select("label", "d", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in range(levels - 1, -1, -1):
        left, right = nodes(level, "l"), nodes(level, "r")
        gap = sum(
            F.pow(F.greatest(F.lit(0.0), F.col(f"lo{i}_l") - F.col(f"hi{i}_r"), F.col(f"lo{i}_r") - F.col(f"hi{i}_l")), 2)
            for i in range(size)
        )
        pairs = (
            pairs.withColumnsRenamed({"a": "up_l", "b": "up_r"})
            .join(left, ["label", "d", "up_l"])
            .join(right, ["label", "d", "up_r"])
            .where((F.col("node_l") <= F.col("node_r")) & (gap <= width * width * (1 + 1e-9)))
            .select("label", "d", F.col("node_l").alias("a"), F.col("node_r").alias("b"))
        )
    named = leaves.select("label", "d", "seq", "block")
    return (
        pairs.join(named.withColumnsRenamed({"seq": "a", "block": "block_a"}), ["label", "d", "a"])
        .join(named.withColumnsRenamed({"seq": "b", "block": "block_b"}), ["label", "d", "b"])
        .select(F.col("block_a").alias("a"), F.col("block_b").alias("b"))
    )


def compare(left: tuple, right: tuple | None, threshold: float) -> pd.DataFrame:
    """Links between two blocks (ids, sizes, vectors), or inside one: (node, links, root) of the vectors that have any."""
    ids, sizes, x = left
    own = right is None
    other_ids, other_sizes, y = left if own else right
    norm_x, norm_y = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    node = ids if own else np.concatenate((ids, other_ids))
    label, links = np.arange(len(node)), np.zeros(len(node), np.int64)
    shift = 0 if own else len(ids)
    for i in range(0, len(x), STRIPE):
        part = x[i : i + STRIPE]
        near = (part @ y.T) / (norm_x[i : i + STRIPE, None] * norm_y[None, :]) >= threshold
        if own:
            near[np.arange(len(part)), i + np.arange(len(part))] = False
        row, col = np.nonzero(near)
        if len(row):
            links[i : i + len(part)] += near @ other_sizes
            if not own:
                links[shift:] += near.T @ sizes[i : i + STRIPE]
            label = merge_labels(label, i + row, col + shift)
    found = np.flatnonzero(links)
    return pd.DataFrame({"node": node[found], "links": links[found], "root": node[label[found]]})


def links(blocks: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): per pair of blocks, what `compare` finds."""
    ends = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    loaded = ends.join(blocks.select("block", "d", "ids", "sizes", "vectors"), "block")

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        sides = [
            (np.frombuffer(r.ids, np.int64), np.frombuffer(r.sizes, np.int64), np.frombuffer(r.vectors).reshape(-1, r.d))
            for r in frame.sort_values("block").itertuples()
        ]
        return compare(sides[0], sides[1] if len(sides) > 1 else None, threshold)

    parts = fan_out(blocks.sparkSession)
    return loaded.repartition(parts, "a", "b").groupBy("a", "b").applyInPandas(run, "node long, links long, root long")


def near_vectors(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    block: int = BLOCK,
    branches: int = BRANCHES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `rows`.

    Only rows of equal, non-null labels link, by a cosine of `threshold` (above 0) or more in double precision.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing, and so do vectors of different lengths and rows
    with a null id (their component is null, and they are not kept).  Rows with equal ids are one node; repeated rows are
    all returned.  Columns not named are ignored.
    """
    given = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("v"),
    )
    usable = F.coalesce(linkable(F.col("v")), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = (
        given.where(usable)
        .groupBy("label", "v")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
        .withColumn("d", F.size("v"))
    )
    classes = through_table(classes, "classes")
    width = float(np.sqrt(2 - 2 * threshold))
    blocks = through_table(in_blocks(classes, principal(classes, LEADING), width, block), "blocks")
    found = through_table(links(blocks, near_blocks(blocks, width, branches), threshold), "links")
    roots = components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    nodes = classes.select("label", "v", "rep", "size").join(counts.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = nodes.groupBy("root").agg(F.min("rep").alias("component_id"))
    nodes = nodes.join(smallest, "root").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id"
    )
    linked = given.where(usable).join(nodes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
