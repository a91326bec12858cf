"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sources get targets from their weights, filled up to a cap.  The words of a source, its documents in a seeded order, are cut
into blocks of equal length.  As many blocks as all words fill are dealt to the sources by the highest quotients target / (2 j - 1), and a
source's blocks in the same way to its shards, so every shard has an integer quota.  Inside a shard every
block is taken as often as the quota allows for all, and the rest goes to blocks at equal steps from a seeded start.  How much of a document is
taken follows from its place in the order alone, so blocks are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.sources.session import through_table

BLOCK = 16
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARD_DIGITS = 2
SEED = 11


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\x09-\\x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """`rows` with `place`: how many rows of the group stand before each, by `order`, which must tell the rows of a group apart.

    Rows are dealt out in ranges of group and order, so that no group has to be ordered by one task; only the groups' counts per range
    are summed up.  The ranges are written down before they are counted.
    """
    by = [*[F.col(g) for g in group], *order]
    ranges = through_table(rows.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    both = ranges.withColumn("_inside", inside).join(counts, [*group, "_part"])
    return both.select(*rows.columns, (F.col("_start") + F.col("_inside")).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, size, no, target) for a table (source, size): the words each source shall give, all sizes together.

    Sources are numbered by code point, null last, and their weights repeat.  A target is the weight's share of all words, `most` times the
    source's size at most; what sources at that cap leave over is shared again by weight among the others until none is above it.  A
    round settles all sources that a share lifts to their caps and sums up the table of sources; only the sums reach the driver.
    """
    listed = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    rows = placed(sizes.withColumn("all", F.lit(0)), ["all"], [F.col("source").asc_nulls_last()])
    weight = F.get(listed, (F.col("place") % len(weights)).cast("int"))
    rows = rows.select("source", "size", F.col("place").alias("no"), weight.alias("weight"), (F.col("size") * most).alias("cap"))
    rows = through_table(rows, "weights")
    whole = rows.agg(F.sum("size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weights_ = int(whole["words"] or 0), int(whole["weight"] or 0)
    left, open_ = words, weights_

    def wide(column: str) -> Column:
        return F.col(column).cast("decimal(19,0)")

    while True:
        # shares only grow from round to round, so a source at its cap stays there
        full = wide("weight") * F.lit(left).cast("decimal(19,0)") >= wide("cap") * F.lit(max(open_, 1)).cast("decimal(19,0)")
        row = rows.where(full).agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        after = words - int(row["cap"] or 0), weights_ - int(row["weight"] or 0)
        if after == (left, open_):
            break
        left, open_ = after
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(open_, 1)))
    return rows.select("source", "size", "no", F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"))


def apportioned(rows: DataFrame, group: str, item: str, votes: str, seats: str, cap: str) -> DataFrame:
    """`rows` with `quota`: each group's `seats` dealt to its items by the highest quotients votes / (2 j - 1), j = 1, 2, ...

    An item takes `cap` seats at most and items without votes none; a group deals no more seats than its items can take.  Equal
    quotients go to the smaller item.  With k items the divisor votes / (seats - k / 2) gives no item too many seats and the divisor votes
    / (seats + k / 2) gives enough of them, unless caps are met: then the step is doubled until it does.  Only the quotients between the two, some
    two per item, are listed and placed.  Groups and items must not be null.
    """
    able = F.when(F.col(votes) > 0, F.col(cap)).otherwise(F.lit(0)).cast("long")
    rows_ = rows.withColumn("_cap", able)
    sums = rows_.groupBy(group).agg(
        F.sum(votes).cast("double").alias("_votes"),
        F.count(F.lit(1)).alias("_k"),
        F.least(F.max(seats), F.sum("_cap")).alias("_seats"),
    )
    whole = through_table(rows_.join(sums, group), "votes")

    def count_at(seats_: Column) -> Column:
        exact = F.col(votes).cast("double") * seats_ / F.greatest("_votes", F.lit(1e-300))
        return F.least(F.floor(exact + 0.5), F.col("_cap")).cast("long")

    reach = 1
    while True:
        high = count_at(F.col("_seats") + F.col("_k") * (reach / 2.0) + 1)
        if whole.groupBy(group).agg(F.sum(high).alias("h"), F.max("_seats").alias("s")).where("h < s").isEmpty():
            break
        reach *= 2
    low = count_at(F.greatest(F.col("_seats") - F.col("_k") / 2.0 - 1, F.lit(0.0)))
    whole = through_table(whole.withColumn("_low", low).withColumn("_high", high), "bounds")
    listed = whole.where("_high > _low").select(
        group, item, F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"), F.col(votes).cast("double").alias("_v")
    )
    order = [(F.col("_v") / (F.col("_j") * 2 - 1).cast("double")).desc(), F.col(item), F.col("_j")]
    free = whole.groupBy(group).agg((F.max("_seats") - F.sum("_low")).alias("_free"))
    won = placed(listed, [group], order).join(free, group).where("place < _free")
    won = won.groupBy(group, item).agg(F.count(F.lit(1)).alias("_won"))
    quota = F.col("_low") + F.coalesce("_won", F.lit(0).cast("long"))
    return whole.join(won, [group, item], "left").select(*rows.columns, quota.alias("quota"))


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    block: int = BLOCK,
    shard_digits: int = SHARD_DIGITS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document.

    A source's taken words differ from its target by about half a block from the quota, and by up to `most` times what its last block
    lacks.  A document is taken `most` times its size at most.  Documents are ordered by a checksum of seed and id, then by size; rows
    that agree in both are interchangeable, so reruns agree.  A null text has size 0, a null id counts as an empty one, null sources are one
    source, the last; a table without words has targets of 0; an empty table gives an empty one.  Other columns are ignored.  One
    shard of a source may hold 2^31 blocks; beyond that the arithmetic overflows with an error.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        mark.alias("mark"),
    )
    shard = F.conv(F.substring("mark", 1, shard_digits), 16, 10).cast("int")
    rows = through_table(rows.withColumn("shard", shard), "sizes")
    shards = through_table(rows.groupBy("source", "shard").agg(F.sum("size").alias("words")), "shards")
    aims = targets(shards.groupBy("source").agg(F.sum("words").alias("size")), weights, most)
    plan = shard_plan(shards, through_table(aims, "targets"), most, block, seed)
    plan = through_table(plan.select(*[F.col(c).alias(f"_{c}") for c in plan.columns]), "plan")
    whole = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    seen = Window.partitionBy("_no", "shard").orderBy("mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_start") + F.coalesce(F.sum("size").over(seen), F.lit(0).cast("long"))
    located = whole.withColumn("_at", start).withColumn("_end", F.col("_at") + F.col("size"))
    return located.select(
        "doc_id",
        "size",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        (taken_before(F.col("_end"), block) - taken_before(F.col("_at"), block)).alias("taken"),
        "source",
    )


def shard_plan(shards: DataFrame, aims: DataFrame, most: int, block: int, seed: int) -> DataFrame:
    """A row per source and shard with the quota's consequences.

    source, no, size, target, shard; start (words of the source before it), first and n (its first block and how many start in it), every
    (times that all are taken), rest (how many are taken once more), turn (where their equal steps start) and carried (times
    that the block is taken which an earlier shard began).
    """
    words = int(aims.agg(F.sum("size").alias("w")).first()["w"] or 0)
    dealt = aims.select(
        "source", "no", "size", "target",
        F.lit(0).alias("all"),
        F.lit((words + block // 2) // block).cast("long").alias("blocks"),
        (F.ceil(F.col("size") / F.lit(block)) * most).cast("long").alias("most"),
    )
    dealt = apportioned(through_table(dealt, "sources"), "all", "no", "target", "blocks", "most")
    own = dealt.select(F.col("source").alias("_s"), "no", "size", "target", F.col("quota").alias("blocks"))
    rows = shards.join(own, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    before = Window.partitionBy("no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("words").over(before), F.lit(0).cast("long"))
    rows = rows.withColumn("start", start).withColumn("first", _div(F.col("start") + (block - 1), F.lit(block)))
    upto = _div(F.col("start") + F.col("words") + (block - 1), F.lit(block))
    rows = rows.withColumn("n", upto - F.col("first")).withColumn("most", (upto - F.col("first")) * most)
    rows = apportioned(rows, "no", "shard", "n", "blocks", "most")
    n = F.greatest("n", F.lit(1).cast("long"))
    hexed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string")).cast("binary"))
    rows = rows.select(
        "source", "no", "size", "target", "shard", "start", "first", "n",
        _div(F.col("quota"), n).alias("every"),
        (F.col("quota") % n).alias("rest"),
        (F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long") % n).alias("turn"),
    )
    last = F.when(F.col("n") > 0, F.col("every") + _more(F.col("n"), "") - _more(F.col("n") - 1, ""))
    carried = F.coalesce(F.last(last, ignorenulls=True).over(before), F.lit(0).cast("long"))
    return rows.withColumn("carried", carried)


def taken_before(at: Column, block: int) -> Column:
    """Words taken of those of a shard that stand before word `at` of its source; a plan's columns carry a leading underscore."""
    edge = F.col("_first") * block
    whole = _div(at, F.lit(block)) - F.col("_first")
    times = F.col("_every") + _more(whole + 1, "_") - _more(whole, "_")
    full = (F.col("_every") * whole + _more(whole, "_")) * block + (at % block) * times
    return F.when(at <= edge, (at - F.col("_start")) * F.col("_carried")).otherwise(
        (edge - F.col("_start")) * F.col("_carried") + full
    )


def _more(blocks: Column, mark: str) -> Column:
    """How many of a shard's first `blocks` blocks are taken once more: steps of n / rest from `turn` on."""
    n, rest, turn = F.greatest(f"{mark}n", F.lit(1).cast("long")), F.col(f"{mark}rest"), F.col(f"{mark}turn")
    return _div((blocks + turn) * rest, n) - _div(turn * rest, n)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b.cast("long"))
