"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are cut into tiles by population count.  The Hamming distance of two fingerprints is at least
the difference of their population counts, so a tile meets only the tiles within `radius` classes.  Each pair of tiles is
one task: exclusive-or and bit counts in numpy, block by block; within a pair, the counts of the upper halves
skip further rows.  A task returns a spanning forest of the links it found, never the links themselves, so a large
group of near copies costs one row per member and tile pair.  All pairs of the classes in reach are compared: the work
is quadratic in the number of distinct fingerprints by the method's nature, and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.llm.common import fan_out, merge_labels
from tunekit.llm.components import components
from tunekit.sources.session import through_table

BITS = 64
RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
TILE_ROWS = 8192
BLOCK_ROWS = 32
HASH_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint of one text; 0 for a null text or one without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(parts))
    spans = list(zip(starts[: len(parts) - width + 1].tolist(), ends[width - 1 :].tolist()))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), HASH_CHUNK):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans[i : i + HASH_CHUNK]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(spans), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long): one row per row of `docs`; the bits are those of the unsigned value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, fingerprint long")


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> np.ndarray:
    """Class label of every fingerprint of two tiles (`right` None: one tile with itself); links found are merged."""
    own = right is None
    right = left if own else right
    half = np.uint64(32)
    a_count, b_count = np.bitwise_count(left >> half).astype(int), np.bitwise_count(right >> half).astype(int)
    a_order, b_order = np.argsort(a_count, kind="stable"), np.argsort(b_count, kind="stable")
    a_sorted, b_sorted = a_count[a_order], b_count[b_order]
    a, b = left[a_order], right[b_order]
    label = np.arange(len(left) + (0 if own else len(right)))
    shift = 0 if own else len(left)
    for i in range(0, len(a), BLOCK_ROWS):
        j = min(i + BLOCK_ROWS, len(a))
        lo = int(np.searchsorted(b_sorted, a_sorted[i] - radius, "left"))
        hi = int(np.searchsorted(b_sorted, a_sorted[j - 1] + radius, "right"))
        if own:
            lo = max(lo, i)
        if lo >= hi:
            continue
        near = np.bitwise_count(a[i:j, None] ^ b[None, lo:hi]) <= radius
        flat = np.flatnonzero(near)
        if len(flat):
            row, col = np.divmod(flat, hi - lo)
            label = merge_labels(label, a_order[i + row], b_order[lo + col] + shift)
    return label


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): a forest whose components are those of "at most `radius` bits apart" over the column `fingerprint`.

    The column must hold distinct, non-null values.  Tile numbers ascend with the population count, so the partners
    of a tile are one range of tiles; the driver sees the 65 class sizes only.
    """
    spark = distinct.sparkSession
    classed = distinct.select("fingerprint", F.bit_count("fingerprint").cast("int").alias("ones"))
    sizes = {r["ones"]: r["n"] for r in classed.groupBy("ones").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = [ceil(sizes.get(p, 0) / tile_rows) for p in range(BITS + 1)]
    base = [sum(buckets[:p]) for p in range(BITS + 2)]

    def by_class(values: list[int]):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("ones") + 1)

    reach = [(base[max(0, p - radius)], base[min(BITS, p + radius) + 1] - 1) for p in range(BITS + 1)]
    bucket = F.pmod(F.xxhash64("fingerprint"), F.greatest(by_class(buckets), F.lit(1)))
    tiles = (
        classed.withColumn("tile", (by_class(base[:-1]) + bucket).cast("int"))
        .groupBy("tile", "ones")
        .agg(F.collect_list("fingerprint").alias("rows"))
    )
    first, last = by_class([r[0] for r in reach]), by_class([r[1] for r in reach])
    other = F.explode(F.sequence(first, F.greatest(first, last))).alias("other")
    pairs = tiles.select("tile", "rows", other).select(
        F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "rows"
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [np.asarray(r, np.int64).view(np.uint64) for r in pdf.sort_values("tile")["rows"]]
        label = compare(sides[0], sides[1] if len(sides) > 1 else None, radius) if key[0] == key[1] or len(sides) > 1 else None
        if label is None:
            return pd.DataFrame({"a": [], "b": []})
        node = np.concatenate(sides).view(np.int64)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    return pairs.repartition(fan_out(spark), "a", "b").groupBy("a", "b").applyInPandas(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint long, component_id): one row per row of `docs`.

    component_id is the smallest id reachable over links, the row's own included.  A null text counts as empty; texts
    without words have fingerprint 0 and link like any other.  Rows with a null id take part and are never smallest; a
    component of such rows only has a null component_id.  Repeated rows are all returned.  Other columns are ignored.
    """
    prints = through_table(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(distinct.select("fingerprint"), radius, tile_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_print(column: str = "fingerprint"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")
