"""Spelling variants: words one edit apart, found by pivotal grams.

The bigrams of a word are put in a global order, rare ones first, equal ones from the left.  The first three are its prefix; two
disjoint ones of them, the pair with the smallest summed frequency, are its pivots.  One edit spoils one of two disjoint bigrams at
most, so of two near words the one whose prefix ends first has a pivot that the other's prefix holds, if that is filled up with
equal bigrams: an edit makes two new ones at most, so with the first five places of each.

Places are limited by what the edit leaves alone.  If it is right of the first pivot, both words agree up to the end of that
bigram; else it is left of the second, and they agree from there on.  The rest of the word is cut into a few intervals, by the length
of the word that is looked for: with the edit in one of them, the letters before it and those behind it agree.  A row of the index
is therefore a hash of a bigram, its place from the side that agrees, a length, an interval and the letters that agree.  What
meets is verified by edit distance inside the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.llm.common import fan_out, slices
from tunekit.sources.session import through_table

LEAST_LENGTH = 7
LEAST_COUNT = 2
NOISE = 31
RATIO = 10
PIVOTS = 2
HELD = 1 << 17

INDEX = "word string, n long, last int, pivot boolean, key long"


def spoiled(word: bytes, doc_id: str, every: int) -> bytes:
    """The word without one letter where `every` divides the checksum of `<doc_id>:<word>`; letters are Latin-1 bytes."""
    text = word if word.isascii() else word.decode("latin-1").encode()
    h = zlib.crc32(text, zlib.crc32(f"{doc_id}:".encode()))
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(least: int, every: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the words of (doc_id, text) batches, merged until `HELD` words are held."""
    runs = re.compile(rb"[a-z\xC0-\xFF]{%d,}" % least)

    def flush(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, texts = (batch.column(c)[a:b].to_pylist() for c in (0, 1))
                for doc_id, text in zip(ids, texts):
                    # characters beyond Latin-1 become a question mark, which ends a run as they do
                    own = Counter(runs.findall((text or "").encode("latin-1", "replace").lower()))
                    for word, n in own.items():
                        if every:
                            word = spoiled(word, doc_id or "", every)
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= HELD:
                    yield flush(held)
                    held = Counter()
        if held:
            yield flush(held)

    return count


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    noise: int | None = NOISE,
) -> DataFrame:
    """(word, n) of the words of at least `least_length` letters that occur `least_count` times or more.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased.  With `noise` a letter is left out where
    that number divides a checksum of document and word.  A null text has no words, a null id counts as an empty one.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(counted(least_length, noise), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rank, frequency) of every bigram, 256 x 256 by its letters' codes; bigrams that no word has come first.

    There are 90 letters, so at most 8100 rows are gathered however large the vocabulary is.
    """
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c))
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("word"))
    rows = grams.groupBy("word").agg(F.count(F.lit(1)).alias("n")).select(letters.alias("c"), "n").collect()
    frequency = np.zeros((256, 256), np.int64)
    for row in rows:
        frequency[row["c"][0], row["c"][1]] = row["n"]
    rank = np.empty(65536, np.int32)
    rank[np.argsort(frequency.reshape(-1), kind="stable")] = np.arange(65536, dtype=np.int32)
    return rank.reshape(256, 256), frequency


def pivots(places: list[int], weights: list[int], count: int = PIVOTS) -> list[int]:
    """The `count` places at least 2 apart with the smallest summed weight, by dynamic programming over rising places."""
    best: list[tuple[float, tuple[int, ...]]] = [(0, ())] * (len(places) + 1)
    for _ in range(count):
        chosen: list[tuple[float, tuple[int, ...]]] = [(float("inf"), ())]
        for i, (place, weight) in enumerate(zip(places, weights)):
            apart = i
            while apart and places[apart - 1] > place - 2:
                apart -= 1
            cost, taken = best[apart]
            chosen.append(min(chosen[-1], (cost + weight, (*taken, place)), key=lambda x: x[0]))
        best = chosen
    return list(best[-1][1])


def keys_of(word: bytes, at: int, length: int, side: int) -> list[int]:
    """Hashes for the bigram at `at` of a word, if the edit that makes a word of `length` letters is behind that bigram.

    One per interval that may hold the edit: behind the bigram, in the third and in the last quarter of the word.  With it from
    letter a on and before letter b, the first a letters agree, and the last `length` - b - 1.  For what is before a bigram
    the word is turned round (`side` 1).
    """
    cuts = [at + 2, max(at + 2, length // 2), max(at + 2, 3 * length // 4), length + 1]
    out = []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            behind = max(length - b - 1, 0)
            text = b"%d %d %d %d %s %s" % (side, at, length, part, word[:a], word[len(word) - behind :])
            out.append(xxhash.xxh64_intdigest(text) >> 1)
    return out


def index_keys(word: bytes, places: list[int], first: int, second: int) -> tuple[list[int], list[int]]:
    """The keys of a word's pivots, for the three lengths that one edit can give, and of its prefix, for its own length."""
    n, turned = len(word), word[::-1]
    own: list[int] = []
    for length in (n - 1, n, n + 1):
        own += keys_of(word, first, length, 0) + keys_of(turned, n - 2 - second, length, 1)
    sought: list[int] = []
    for p in places:
        sought += keys_of(word, p, n, 0) + keys_of(turned, n - 2 - p, n, 1)
    return own, sought


def first_places(ranks: np.ndarray, places: np.ndarray, most: int = PIVOTS + 3) -> list[int]:
    """The first `most` places of every bigram, from places in order of (rank, place)."""
    heads = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1])))
    ordinal = np.arange(len(ranks)) - np.repeat(heads, np.diff(np.append(heads, len(ranks))))
    return places[ordinal < most].tolist()


def indexed(rank: np.ndarray, frequency: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the index for (word, n) batches."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(0), 1 << 18, 4096):
                part = batch.slice(start, end - start)
                keys: list[int] = []
                last: list[int] = []
                sizes: list[tuple[int, int]] = []
                for word in part.column(0).to_pylist():
                    text = word.encode("latin-1")
                    codes = np.frombuffer(text, np.uint8)
                    ranks = rank[codes[:-1], codes[1:]]
                    last.append(int(np.partition(ranks, PIVOTS)[PIVOTS]))
                    places = np.flatnonzero(ranks <= last[-1])
                    places = places[np.argsort(ranks[places], kind="stable")]
                    prefix = np.sort(places[: PIVOTS + 1])
                    weights = frequency[codes[prefix], codes[prefix + 1]]
                    own, sought = index_keys(text, first_places(ranks[places], places), *pivots(prefix.tolist(), weights.tolist()))
                    keys += own
                    keys += sought
                    sizes.append((len(own), len(sought)))
                each = np.array(sizes, np.int64).reshape(-1, 2)
                of = pa.array(np.repeat(np.arange(len(each)), each.sum(1)))
                pivot = np.repeat(np.tile([True, False], len(each)), each.ravel())
                columns = [part.column(0).take(of), part.column(1).take(of), pa.array(last, pa.int32()).take(of)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(pivot), pa.array(keys, pa.int64())], ["word", "n", "last", "pivot", "key"]
                )

    return index


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), each pair of words one edit apart once; `words` has distinct words of 4 letters or more and their n."""
    rank, frequency = gram_order(words)
    parts = fan_out(words.sparkSession)
    rows = through_table(words.repartition(parts, "word").mapInArrow(indexed(rank, frequency), INDEX), "grams")

    def side(of: DataFrame, name: str) -> DataFrame:
        return of.select("key", F.col("word").alias(name), F.col("n").alias(f"n_{name}"), F.col("last").alias(f"last_{name}"))

    pairs = side(rows.where("pivot"), "a").join(side(rows.where("not pivot"), "b"), "key")
    near = pairs.where("a <> b and last_a <= last_b and abs(length(a) - length(b)) <= 1").where(F.levenshtein("a", "b", 1) == 1)
    first = F.col("a") < F.col("b")

    def ordered(low: str, high: str) -> Column:
        return F.when(first, F.col(low)).otherwise(F.col(high))

    return near.select(
        ordered("a", "b").alias("a"), ordered("n_a", "n_b").alias("n_a"),
        ordered("b", "a").alias("b"), ordered("n_b", "n_a").alias("n_b"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms, for words that have one.

    A form is `RATIO` times as frequent as its word, so chains are short, and every round doubles the steps taken.
    """
    level = through_table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = level.select(F.col("word").alias("root"), F.col("root").alias("up"))
        if level.join(above, "root", "left_semi").isEmpty():
            return level
        level = through_table(level.join(above, "root", "left").select("word", F.coalesce("up", "root").alias("root")), "forms")


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    noise: int | None = NOISE,
    ratio: int = RATIO,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `vocabulary`.

    A word's form is its near word with the largest n (ties: the smallest in code-point order) where that n is at least `ratio`
    times the word's; its root is where following forms ends, itself without a form.  Words of 4 letters or more are
    required, since shorter ones may lack two disjoint bigrams among three.  Nulls and empty texts give no words; repeated rows count
    again; an empty table gives an empty one; other columns are ignored; texts of any length are read whole.
    """
    if least_length < 4 or ratio < 2:
        raise ValueError("least_length must be 4 or more and ratio 2 or more")
    words = through_table(vocabulary(docs, id_col, text_col, least_length, least_count, noise), "vocabulary")
    pairs = near_pairs(words)
    ways = F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("m"), F.col("a").alias("other")),
    )
    per_word = pairs.select(F.explode(ways).alias("w")).groupBy("w.word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct("w.m", "w.other")).alias("best")
    )
    taken = -F.col("best.m") >= F.col("n") * ratio
    found = words.join(per_word, "word", "left").select(
        "word", "n",
        F.when(taken, F.col("best.other")).alias("form"),
        F.when(taken, -F.col("best.m")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    found = through_table(found, "variants")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
