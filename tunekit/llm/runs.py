"""Periodic runs of words, found on a harmonic grid and extended by a recompressed grammar.

A run of period q and length 4 q or more holds four neighbouring multiples of q, so for each q only the multiples of q are looked
at, n ln n places in all, and a place is a candidate if its word stands at the next three multiples too.  How far the text agrees
with itself q words on is asked of a grammar: recompression replaces blocks of one symbol and then pairs of a left and a right
symbol by new symbols, level by level, and equal symbols of a level mean equal texts.  A longest common extension climbs the levels while
the symbols agree and descends where they first differ, for all candidates at once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.llm.common import slices

LEAST_LENGTH = 6
LEAST_REPEATS = 4

COLUMNS = (
    "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


@dataclass
class Level:
    """A text as symbols: their names, where each starts at the level below, and how many words each covers."""

    symbol: np.ndarray
    first: np.ndarray  # index at the level below of every symbol's first child, with the end
    words: np.ndarray
    bounds: np.ndarray  # index of every text's first symbol, with the end


class Grammar:
    """The recompression of concatenated texts and, behind them, of their mirror images; no symbol covers parts of two texts.

    Levels come in twos: blocks, then pairs.  Names are given by sorting the distinct blocks or pairs of a level, so equal symbols of a
    level have equal expansions wherever they stand.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        sizes = np.concatenate([sizes, sizes[::-1]])
        self.starts = np.cumsum(np.append(0, sizes))
        symbol = np.concatenate([words, words[::-1]]).astype(np.int64)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        self.levels = [Level(symbol, np.arange(len(symbol) + 1), np.ones(len(symbol), np.int64), self.starts)]
        while len(self.levels[-1].symbol) > np.count_nonzero(sizes):
            for step in (self._blocks, self._pairs):
                heads, names = step(self.levels[-1].symbol, text_of)
                first = np.append(np.flatnonzero(heads), len(heads))
                words = np.add.reduceat(self.levels[-1].words, first[:-1])
                text_of = text_of[first[:-1]]
                bounds = np.searchsorted(first, self.levels[-1].bounds, "left")
                self.levels.append(Level(names, first, words, bounds))

    @staticmethod
    def _blocks(symbol: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        heads = np.ones(len(symbol), bool)
        heads[1:] = (symbol[1:] != symbol[:-1]) | (text_of[1:] != text_of[:-1])
        at = np.flatnonzero(heads)
        size = np.diff(np.append(at, len(symbol)))
        return heads, np.unique(symbol[at] * (int(size.max()) + 1) + size, return_inverse=True)[1]

    @staticmethod
    def _pairs(symbol: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = right_side(symbol, text_of)
        joined = np.zeros(len(symbol), bool)  # right halves
        joined[1:] = right[symbol[1:]] & ~right[symbol[:-1]] & (text_of[1:] == text_of[:-1])
        at = np.flatnonzero(~joined)
        second = np.zeros(len(at), np.int64)
        behind = np.minimum(at + 1, len(symbol) - 1)
        paired = joined[behind] & (behind > at)
        second[paired] = symbol[behind[paired]] + 1
        names = symbol[at] * (int(symbol.max()) + 2) + second
        return ~joined, np.unique(names, return_inverse=True)[1]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words the texts agree on from the places x and y on (of the concatenated texts), up to the end of a text."""
        matched = np.zeros(len(x), np.int64)
        x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
        fell = np.full(len(x), len(self.levels) - 1)  # level at whose symbols the two differ
        active = np.arange(len(x))
        text_x, text_y = (np.searchsorted(self.starts, v, "right") - 1 for v in (x, y))
        for k in range(len(self.levels)):
            active = self._advance(k, active, x, y, matched, fell, text_x, text_y)
            if k + 1 == len(self.levels) or not len(active):
                break
            head = self.levels[k + 1].first
            x[active] = np.searchsorted(head, x[active], "left")
            y[active] = np.searchsorted(head, y[active], "left")
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(fell >= k)
            if not len(down):
                continue
            head = self.levels[k].first
            x[down], y[down] = head[x[down]], head[y[down]]
            self._walk(k - 1, down, x, y, matched, text_x, text_y)
        return matched

    def _same(self, k, at, x, y, text_x, text_y):
        """Which of the queries `at` have equal symbols at level k, none at the end of its text."""
        symbol, limit = self.levels[k].symbol, self.levels[k].bounds
        inside = (x[at] < limit[text_x[at] + 1]) & (y[at] < limit[text_y[at] + 1])
        top = len(symbol) - 1
        return inside & (symbol[np.minimum(x[at], top)] == symbol[np.minimum(y[at], top)])

    def _advance(self, k, active, x, y, matched, fell, text_x, text_y):
        """Bring queries to heads of level k + 1 while their symbols agree; those that differ stay behind with `fell` = k."""
        same = self._same(k, active, x, y, text_x, text_y)
        fell[active[~same]] = k
        active = active[same]
        if k + 1 == len(self.levels):
            self._walk(k, active, x, y, matched, text_x, text_y)
            fell[active] = k
            return active[:0]
        level, head = self.levels[k], self.levels[k + 1].first
        of_x, of_y = (np.searchsorted(head, v[active], "right") - 1 for v in (x, y))
        rest_x, rest_y = head[of_x + 1] - x[active], head[of_y + 1] - y[active]
        partial = (head[of_x] != x[active]) | (head[of_y] != y[active])
        if k % 2 == 0:  # blocks: the rest of one symbol's repeats
            step = np.where(partial, np.minimum(rest_x, rest_y), 0)
            stuck = partial & (rest_x != rest_y)
        else:  # pairs: one of the two is a right half, and both hold the same right symbol
            step = partial.astype(np.int64)
            stuck = np.zeros(len(active), bool)
        matched[active] += step * level.words[x[active]]
        x[active] += step
        y[active] += step
        fell[active[stuck]] = k
        return active[~stuck]

    def _walk(self, k, at, x, y, matched, text_x, text_y):
        """Step over equal symbols of level k until they differ."""
        level = self.levels[k]
        if k % 2 == 0 and k + 1 < len(self.levels):  # a whole block at once, then the shorter rest
            head = self.levels[k + 1].first
            same = at[self._same(k, at, x, y, text_x, text_y)]
            rest = [head[np.searchsorted(head, v[same], "right")] - v[same] for v in (x, y)]
            step = np.minimum(*rest)
            matched[same] += step * level.words[x[same]]
            x[same] += step
            y[same] += step
            at = same[rest[0] == rest[1]]
        while len(at := at[self._same(k, at, x, y, text_x, text_y)]):
            matched[at] += level.words[x[at]]
            x[at] += 1
            y[at] += 1


def right_side(symbol: np.ndarray, text_of: np.ndarray) -> np.ndarray:
    """Which symbols are right halves of pairs: by one bit of a hash of the name, the side that makes more pairs.

    Names of a level are numbered by content, so the choice depends on the texts alone; all pairs of neighbours fall on (left, right) or
    (right, left) half of the time.  If no pair is made, the two symbols of the first pair of neighbours are parted.
    """
    names = np.arange(int(symbol.max()) + 1, dtype=np.uint64)
    bit = ((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61)) & np.uint64(1)
    right = bit.astype(bool)
    near = text_of[1:] == text_of[:-1]
    a, b = right[symbol[:-1]][near], right[symbol[1:]][near]
    forward, backward = np.count_nonzero(~a & b), np.count_nonzero(a & ~b)
    if not forward and not backward and near.any():
        at = int(np.flatnonzero(near)[0])
        right[:] = False
        right[symbol[at + 1]] = True
        return right
    return right if forward >= backward else ~right


def candidates(
    words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, low: int, repeats: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, period) of the texts' harmonic grids for periods from `low` to below 2 `low`: the places whose word
    stands at the next `repeats` - 1 multiples of the period too.  There are fewer places than words."""
    long = np.flatnonzero(sizes >= repeats * low)
    text, period = np.repeat(long, low), np.tile(np.arange(low, 2 * low), len(long))
    fits = sizes[text] >= repeats * period
    text, period = text[fits], period[fits]
    counts = (sizes[text] - 1 - (repeats - 1) * period) // period + 1
    ordinal = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    text, period = np.repeat(text, counts), np.repeat(period, counts)
    place = starts[text] + ordinal * period
    for turn in range(1, repeats):
        held = words[place] == words[place + turn * period]
        text, place, period = text[held], place[held], period[held]
    return text, place, period


def periodic_runs(texts: list[np.ndarray], least: int = LEAST_LENGTH, repeats: int = LEAST_REPEATS) -> list[np.ndarray]:
    """Per text the (start, length, period) rows of its maximal runs of `least` words and `repeats` periods or more, by start, then
    period.  Texts without a candidate get no grammar; candidates inside a known run whose period divides theirs are that run."""
    out = [np.empty((0, 3), np.int64)] * len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    lows = [1 << k for k in range(64) if repeats << k <= int(sizes.max(initial=0))]
    if not lows:
        return out
    words, starts = np.concatenate(texts), np.cumsum(sizes) - sizes
    needed = np.zeros(len(texts), bool)
    for low in lows:
        needed[candidates(words, starts, sizes, low, repeats)[0]] = True
    chosen = np.flatnonzero(needed)
    if not len(chosen):
        return out
    sizes = sizes[chosen]
    words, starts = np.concatenate([texts[i] for i in chosen]), np.cumsum(sizes) - sizes
    n = len(words)
    grammar = Grammar(words, sizes)
    found: dict[tuple[int, int], int] = {}
    cover, cover_period = np.zeros(n, np.int64), np.ones(n, np.int64)  # end and period of the last run over each word
    for low in lows:
        text, place, period = candidates(words, starts, sizes, low, repeats)
        known = (cover[place] > place + (repeats - 1) * period) & (period % cover_period[place] == 0)
        text, place, period = text[~known], place[~known], period[~known]
        if not len(place):
            continue
        inner = place > starts[text]
        mirrored = 2 * n - place[inner]
        both = grammar.extension(
            np.concatenate([place, mirrored]), np.concatenate([place + period, mirrored - period[inner]])
        )
        ahead, back = both[: len(place)], np.zeros(len(place), np.int64)
        back[inner] = both[len(place) :]
        start, end = place - back, place + period + ahead
        kept = end - start >= np.maximum(least, repeats * period)
        for s, e, p in sorted(set(zip(start[kept].tolist(), end[kept].tolist(), period[kept].tolist()))):
            found[(s, e)] = min(p, found.get((s, e), p))
            longer = cover[s:e] < e
            cover[s:e][longer], cover_period[s:e][longer] = e, found[(s, e)]
    rows = np.array(sorted((s, p, e - s) for (s, e), p in found.items()), np.int64).reshape(-1, 3)[:, [0, 2, 1]]
    cuts = np.searchsorted(rows[:, 0], np.append(starts, n))
    for k, i in enumerate(chosen.tolist()):
        out[i] = rows[cuts[k] : cuts[k + 1]] - np.array([starts[k], 0, 0])
    return out


def planted(doc_id: str, words: list[bytes]) -> list[bytes]:
    """The words with a periodic tail where ten divides the checksum of the document's id."""
    h = zlib.crc32(doc_id.encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of what runs repeat: of every run the first period stays, unless another run drops it."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    dropped = np.cumsum(change[:-1]) > 0
    return [w for w, gone in zip(words, dropped.tolist()) if not gone]


def numbered(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


def described(words: list[bytes], runs: np.ndarray) -> tuple:
    """One document's row, in the order of `COLUMNS`."""
    text = b" ".join(collapsed(words, runs) if len(runs) else words)
    listed = runs.tolist()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in listed)
    best = min(listed, key=lambda r: (-r[1], r[0], r[2])) if listed else None
    digests = hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()
    structs = [{"start": s, "length": m, "period": p} for s, m, p in listed]
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(listed), *head, *digests, structs, text.decode()


def describe(batches: Iterator[pa.RecordBatch], schema: pa.Schema, plant: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            ids, texts = (batch.column(c)[a:b].to_pylist() for c in (0, 1))
            # bytes are split at the same characters: space and \x09-\x0D
            listed = [(text or "").encode().split() for text in texts]
            if plant:
                listed = [planted(doc_id or "", words) for doc_id, words in zip(ids, listed)]
            rows = [described(w, r) for w, r in zip(listed, periodic_runs([numbered(w) for w in listed]))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(2)[a:b], *columns], schema=schema)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests, all runs and the text without repeats.

    A run is a stretch of consecutive words with smallest period q and at least 6 words and 4 q words that no neighbouring
    word extends.  Ties of length go to the smaller start, then period.  A word is dropped if a run holds it behind that run's first
    q words; the rest is joined by blanks.  With `plant` the documents whose id's checksum ten divides get a periodic tail
    first.  Each row is judged by itself: repeated rows alike, null and empty texts without words, a null id as an empty one; long texts
    whole, memory in proportion to the longest; other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    kind = pa.int64() if id_type.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()
    own = F.col(id_col).cast("long" if kind == pa.int64() else "string")
    rows = docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"), own.alias("doc_id"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(run), pa.string()]
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    schema = pa.schema([("doc_id", kind), *zip(names, kinds)])
    return rows.mapInArrow(
        lambda batches: describe(batches, schema, plant), f"doc_id {'long' if kind == pa.int64() else 'string'}, {COLUMNS}"
    )
