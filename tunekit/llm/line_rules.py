"""Quality rules from line frequencies across documents, in DataFrame operations only.

Lines are normalised (trimmed, lower case, white space runs as one blank) and hashed.  For every host the documents of
distinct text that hold a line are counted, so exact copies of a document count once.  Lines above the limits are taken
out of documents, and documents that lose too many of their words are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.arrays import let
from tunekit.llm.common import SPACES
from tunekit.sources.session import through_table

LEAST_DOCUMENTS = 20
LEAST_SHARE = 0.1
LEAST_WORDS_LEFT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 0.5
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


def words(text: Column) -> Column:
    """The runs of characters other than space and \\x09-\\x0D."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(word_list: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words that occur at least twice in the list, the first occurrence included.

    Windows are hashed (64 bits) with their places and sorted, so the cost is that of a sort; lists in which all
    hashes differ are done before it.
    """

    def body(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - (window - 1))
        hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(window)]))
        return F.when(F.size(w) > window, let(hashes, covered)).otherwise(F.lit(0).cast("long"))

    def covered(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_counted(h))

    def _counted(h: Column) -> Column:
        marked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            own = F.filter(
                F.transform(
                    s,
                    lambda x, k: F.when(
                        (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"]
                    ),
                ),
                lambda i: i.isNotNull(),
            )
            return let(F.sort_array(own), gaps)

        def gaps(p: Column) -> Column:
            reach = F.transform(
                p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))).cast("long")
            )
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(marked, twins)

    return let(word_list, body)


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    held = F.filter(lines, lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(held, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; a null text has no words."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    listed = docs.withColumn("_words", words(body))
    return listed.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length(body) - F.char_length(F.regexp_replace(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        duplicate_lines(F.split(body, "\n")).alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(MOST_REPEATED * 100)),
    )


def line_rows(docs: DataFrame, text: str) -> DataFrame:
    """A row per distinct normalised line with a word: the columns of `docs`, line (hash), line_words and copies of it."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    normal = F.transform(F.split(body, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, SPACES, " "))))
    rows = docs.select(*[c for c in docs.columns if c != text], F.explode(F.filter(normal, lambda x: x != "")).alias("_l"))
    n_words = F.size(F.split("_l", " ")).cast("long")
    return rows.select(*[c for c in rows.columns if c != "_l"], F.xxhash64("_l").alias("line"), n_words.alias("line_words"))


def frequent_lines(once: DataFrame, documents: DataFrame, least: int, share: float) -> DataFrame:
    """(host, line) of the lines in at least `least` distinct texts and `share` of the host's distinct texts.

    `once` has a row per host, text and line, `documents` the host and text of every document.
    """
    sizes = documents.select("host", "body").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    often = once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return often.join(sizes, "host").where(F.col("n") >= F.col("texts") * share).select("host", "line")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    least_share: float = LEAST_SHARE,
    least_words_left: float = LEAST_WORDS_LEFT,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines_removed, words_left.

    Null hosts form one host of their own.  A document is kept unless the base rules fail or less than
    `least_words_left` of its words are outside frequent lines.  Equal rows are judged alike and all returned; rows with a
    null id are judged as well.  Ties do not arise: limits are inclusive.  Columns not named are ignored.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("body"),
        F.col(text_col).alias("text"),
    )
    base = through_table(measures(keyed, "text").drop("text"), "measures")
    # what is lost depends on host and text only, so it is found once per distinct pair
    lines = line_rows(keyed, "text").groupBy("host", "body", "line", "line_words").agg(F.count(F.lit(1)).alias("c"))
    once = through_table(lines, "lines")
    frequent = frequent_lines(once, base, least_documents, least_share)
    copies = base.groupBy("host", "body").agg(F.count(F.lit(1)).alias("copies"))
    lost = (
        once.join(frequent, ["host", "line"])
        .groupBy("host", "body")
        .agg(F.sum(F.col("line_words") * F.col("c")).alias("w"), F.sum("c").alias("k"))
        .join(copies, ["host", "body"])
        .select(
            F.col("host").alias("_h"),
            F.col("body").alias("_b"),
            (F.col("w") / F.col("copies")).cast("long").alias("words_lost"),
            (F.col("k") / F.col("copies")).cast("long").alias("n_lines_removed"),
        )
    )
    joined = base.join(lost, (base["host"] == lost["_h"]) & (base["body"] == lost["_b"]), "left")
    left = F.col("n_words") - F.coalesce("words_lost", F.lit(0))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (left >= F.col("n_words") * least_words_left)).alias("kept"),
        F.coalesce("n_lines_removed", F.lit(0)).cast("long").alias("n_lines_removed"),
        left.cast("long").alias("words_left"),
    )
