"""Personal data in texts, in DataFrame operations only.

Four kinds have patterns and checks of their own (base spans).  They are the seeds of a bootstrapping that finds further
identifiers by their context: words with digits or `@`, runs of numbers joined by blanks and base spans that hold blanks are
the instances; the word before, or the key before `=` or `:`, with the instance's shape is a lexical pattern.  Over the graph of patterns and instances, patterns are scored by the
share of known instances they occur with, instances by a noisy-or of their patterns, for a fixed number of rounds;
instances of high score become spans of that kind wherever they occur.

The regular expressions use possessive loops and start only where a run of their characters starts (or the last match
ended), which gives the same matches in linear time and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunekit.functions.arrays import let
from tunekit.llm.common import joined_spans
from tunekit.sources.session import through_table

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WORD = "[^\\x20\\x09-\\x0D]"
INSTANCE = "(?<!" + WORD + ")[^\\x20\\x09-\\x0D0-9@]*+[0-9@]" + WORD + "*+"
_NUMBER = "[+(]*+[0-9][^\\x20\\x09-\\x0DA-Za-z@]*+(?!" + WORD + ")"
RUN = "(?<!" + WORD + ")(?:[^\\x20\\x09-\\x0D0-9@=:]*+[=:])?+" + _NUMBER + "(?:(?<![,;:!?])\\x20" + _NUMBER + ")++"
KEY = "^([^0-9@=:]*[=:]).+$"
TRIMMED = "[.,;:!?)\\]}\"'>]+$"

ROUNDS = 3
LEAST_SEEDS = 3
PRIOR = 2.0
ACCEPTED = 0.8
LEAST_CHARS = 4
CHUNK = 256

SPAN = "array<struct<start:int,ord:int,kind:string,end:int>>"


def located(text: Column, regex: str, make: Callable[[Column, Column, Column, Column], Column], kind: str, keep) -> Column:
    """`make(start, end, match, text before it)` for every match that `keep(match)` accepts, as an array of type `kind`.

    Offsets count code points: matches and the pieces between them alternate, and their lengths are summed up in one
    pass.  Results are gathered in chunks, so the pass stays linear in the number of matches.
    """

    def scan(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, regex, -1), F.lit(1), F.size(found)).alias("seg"), found.alias("hit"))
        empty = F.array().cast(kind)
        start = F.struct(F.lit(0).alias("at"), empty.alias("some"), F.array().cast(f"array<{kind}>").alias("full"))

        def step(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.char_length(pair["seg"])
            end = begin + F.char_length(pair["hit"])
            row = F.array(make(begin, end, pair["hit"], pair["seg"])).cast(kind)
            some = F.when(keep(pair["hit"]), F.concat(acc["some"], row)).otherwise(acc["some"])
            fill = F.size(acc["some"]) >= CHUNK
            return F.when(
                fill,
                F.struct(
                    end.alias("at"),
                    F.when(keep(pair["hit"]), row).otherwise(empty).alias("some"),
                    F.concat(acc["full"], F.array(acc["some"])).alias("full"),
                ),
            ).otherwise(F.struct(end.alias("at"), some.alias("some"), acc["full"].alias("full")))

        return F.aggregate(pairs, start, step, lambda a: F.flatten(F.concat(a["full"], F.array(a["some"]))))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), scan)


def _rules(text: Column) -> dict[str, tuple[str, Column, Callable[[Column], Column]]]:
    """kind: (expression, whether the text may hold a match, check of a match)."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    return {
        "email": (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")),
        "card": (
            CARD,
            text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
            lambda m: F.char_length(digits(m)).between(12, 19) & F.call_function("luhn_check", digits(m)),
        ),
        "phone": (PHONE, text.contains("+"), lambda m: F.char_length(digits(m)).between(9, 15)),
    }


def base_spans(text: Column) -> Column:
    """Array of (start, ord, kind, end) of the four kinds, each leftmost and non-overlapping; failing matches dropped."""
    rules, arrays = _rules(text), []
    for order, kind in enumerate(KINDS):
        regex, may_hold, keep = rules[kind]

        def make(start, end, hit, seg, order=order, kind=kind):
            return F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"))

        spans = located(text, regex, make, SPAN, keep)
        arrays.append(F.when(may_hold, spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*arrays)


def instances(text: Column) -> Column:
    """Array of (start, end, value, pattern, kind), without a key before and marks behind the value.

    Words with a digit or `@` and longest runs of numbers joined by single blanks have no kind yet; cards and phones that
    hold blanks are instances as a whole, with their kind.
    """
    made = "array<struct<start:int,end:int,value:string,pattern:string,kind:string>>"

    def described(begin: Column, value: Column, context: Column, kind: Column) -> Column:
        shape = F.regexp_replace(F.regexp_replace(value, "[0-9]+", "9"), "[^\\W\\d_]+", "a")
        return F.struct(
            begin.alias("start"),
            (begin + F.char_length(value)).alias("end"),
            value.alias("value"),
            F.sha2(F.concat_ws("\x1f", F.lower(context), shape), 256).alias("pattern"),
            kind.alias("kind"),
        )

    def word_before(seg: Column) -> Column:
        return F.substring_index(F.rtrim(F.translate(seg, "\n\r\t\x0b\x0c", "     ")), " ", -1)

    def make(start: Column, end: Column, hit: Column, seg: Column) -> Column:
        key = F.regexp_extract(hit, KEY, 1)
        bare = F.substr(hit, F.char_length(key) + 1)
        value = F.regexp_replace(bare, TRIMMED, "")
        begin = start + F.char_length(key)
        return described(begin, value, F.when(key != "", key).otherwise(word_before(seg)), F.lit(None).cast("string"))

    long_enough = lambda hit: F.char_length(hit) >= LEAST_CHARS
    arrays = [located(text, INSTANCE, make, made, long_enough)]
    arrays.append(F.when(text.rlike(RUN), located(text, RUN, make, made, long_enough)))
    rules = _rules(text)
    for kind in ("card", "phone"):
        regex, may_hold, keep = rules[kind]

        def whole(start, end, hit, seg, kind=kind):
            return described(start, hit, word_before(seg), F.lit(kind))

        found = located(text, regex, whole, made, lambda hit, keep=keep: hit.contains(" ") & keep(hit))
        arrays.append(F.when(may_hold, found))
    return F.concat(*[F.coalesce(a, F.array().cast(made)) for a in arrays])


def bootstrap(found: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, accepted: float = ACCEPTED) -> DataFrame:
    """(value, kind): instances that context assigns to a kind, from rows (value, pattern, kind); kind is null for the unknown.

    Each (pattern, value) counts once however often it occurs, so copies of a document have no weight.  A pattern needs
    `least_seeds` known values.  A value goes to the kind of the highest score, and of equal ones to the first by name.
    """
    edges = through_table(found.groupBy("pattern", "value").agg(F.max("kind").alias("seed")), "graph")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct()
    known = seeds.select("value", "kind", F.lit(1.0).alias("score"))
    fresh = None
    for _ in range(rounds):
        sums = (
            edges.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("k"))
            .where(F.col("k") >= least_seeds)
        )
        trust = F.least(F.col("s") / (F.col("n") + F.lit(PRIOR)), F.lit(0.999))
        scored = sums.join(sizes, "pattern").select("pattern", "kind", trust.alias("trust"))
        fresh = (
            edges.where("seed is null")
            .join(scored, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("score"))
            .where(F.col("score") >= accepted)
            .groupBy("value")
            .agg(F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind"))).alias("b"))
            .select("value", F.col("b.kind").alias("kind"), F.col("b.score").alias("score"))
        )
        fresh = through_table(fresh.join(seeds.select("value"), "value", "left_anti"), "accepted")
        known = seeds.select("value", "kind", F.lit(1.0).alias("score")).unionByName(fresh)
    return fresh.select("value", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body, base, spans): `base` and all spans of every row, as arrays of (start, ord, kind, end).

    A null text counts as empty.  Repeated rows are all returned, with equal spans; `body` is a hash of the text and tells
    rows of one id apart.  Rows with a null id are searched like others.  Spans that context adds never overlap base
    spans of the row.  Columns not named are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("body"), text.alias("text"))
    spanned = rows.select("doc_id", "body", "text", base_spans(F.col("text")).alias("base"))
    searched = through_table(
        spanned.select(
            "doc_id",
            "body",
            "base",
            F.when(F.col("text").rlike("[0-9@]"), instances(F.col("text"))).alias("found"),
        ),
        "spans",
    )
    # one row per distinct text: copies add nothing to the graph
    single = searched.where(F.size("found") > 0).groupBy("body").agg(F.first("base").alias("base"), F.first("found").alias("found"))
    words = single.select("body", "base", F.explode("found").alias("w")).select(
        "body",
        "w.*",
        F.filter("base", lambda b: (b["start"] < F.col("w.end")) & (b["end"] > F.col("w.start"))).alias("over"),
    )
    inside = F.filter("over", lambda b: (b["start"] >= F.col("start") - 1) & (b["end"] <= F.col("end") + 1))
    words = through_table(
        words.select(
            "body", "start", "end", "value", "pattern",
            F.when(F.col("value").contains(" "), F.col("kind")).otherwise(F.get(inside, 0)["kind"]).alias("kind"),
            (F.size("over") > 0).alias("covered"),
        ),
        "words",
    )
    named = bootstrap(words.where("not covered or kind is not null").select("value", "pattern", "kind"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    added = (
        words.where("not covered")
        .select("body", "start", "end", "value")
        .join(named, "value")
        .groupBy("body")
        .agg(F.collect_set(F.struct("start", order.alias("ord"), "kind", "end")).cast(SPAN).alias("added"))
    )
    empty = F.array().cast(SPAN)
    return searched.join(added, "body", "left").select(
        "doc_id", "body", "base", F.sort_array(F.concat("base", F.coalesce("added", empty))).alias("spans")
    )


def redacted(text: Column, spans: Column) -> Column:
    """`text` with every span replaced by its kind in brackets; of overlapping spans the first by start, then order, names it."""

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(
            last["start"].alias("start"), last["ord"].alias("ord"), last["kind"].alias("kind"),
            F.greatest(last["end"], s["end"]).alias("end"),
        )
        apart = F.concat(acc, F.array(s))
        overlaps = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"])
        return F.when(overlaps, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)).cast(SPAN)).otherwise(apart.cast(SPAN))

    def pieces(m: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
            return F.concat(F.substr(text, before + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

        tail = F.substr(text, F.coalesce(F.try_element_at(m, F.lit(-1))["end"], F.lit(0)) + 1)
        return F.concat(F.array_join(F.transform(m, piece), ""), tail)

    merged = F.aggregate(F.sort_array(spans), F.array().cast(SPAN), merge)
    return F.when(F.size(spans) > 0, let(merged, pieces)).otherwise(text)


def digest_row(found: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of a table from `find`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
