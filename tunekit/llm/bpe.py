"""Byte-level BPE, encoded with a rank queue and decoded by table.

The pre-tokens of a batch lie one behind the other in a linked list of parts that no merge crosses.  Possible merges
wait in a queue with one bucket per merge rank, which holds list positions.  A hierarchical bitmap marks the filled
buckets, so two find-first-set steps give the lowest rank.  A bucket is taken as a whole, with numpy; an entry whose
pair has changed since is stale and skipped.  The time is that of the merges made, also in pre-tokens of millions of
bytes, and equal pre-tokens of a batch are encoded once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunekit.llm.common import slices

WORD_BITS = 8
BATCH_BYTES = 8 << 20
MOST_KNOWN = 150_000
MOST_KNOWN_CHARS = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Buckets of list positions by rank; a bitmap of words and one bitmap above it find the lowest filled one."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks >> WORD_BITS) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Add positions under their ranks; negative ranks mean no merge."""
        real = ranks >= 0
        ranks, positions = ranks[real], positions[real]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(ranks)]
        for a, b, rank in zip(bounds, bounds[1:], ranks[bounds[:-1]].tolist()):
            bucket = self.buckets.get(rank)
            if bucket is not None:
                bucket.append(positions[a:b])
                continue
            self.buckets[rank] = [positions[a:b]]
            self.words[rank >> WORD_BITS] |= 1 << (rank & ((1 << WORD_BITS) - 1))
            self.top |= 1 << (rank >> WORD_BITS)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """Empty the lowest bucket: its rank and its positions; None if all are empty."""
        if not self.top:
            return None
        at = (self.top & -self.top).bit_length() - 1
        lowest = self.words[at] & -self.words[at]
        self.words[at] ^= lowest
        if not self.words[at]:
            self.top ^= 1 << at
        rank = at << WORD_BITS | lowest.bit_length() - 1
        parts = self.buckets.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


class Encoder:
    """Encodes many pre-tokens together, for a rank table that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.size = max(ranks.values(), default=-1) + 1
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the rank table must hold every single byte")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two adjacent tokens, -1 if there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of every pre-token as little-endian unsigned 32-bit integers.

        A pre-token that is in the table is one id.  In the others the lowest-ranked pair is merged first, and of equal
        ones the leftmost, until no pair has a rank.
        """
        whole = [self.ranks.get(t) for t in tokens]
        rest = [t for t, rank in zip(tokens, whole) if rank is None]
        merged = iter(self._merge(rest)) if rest else iter(())
        return [next(merged) if rank is None else rank.to_bytes(4, "little") for rank in whole]

    def _merge(self, tokens: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes)
        part = self.byte_ids[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(part)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = -1
        # `n` stands for "no part"; its own pair never merges
        after, part = np.append(after, n), np.append(part, -1)
        rank_at = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(after[:n] < n)
        rank_at[inner] = self.pair_rank(part[inner], part[inner + 1])
        gone = np.zeros(n, bool)
        queue = RankQueue(self.size)
        queue.push(rank_at[inner], inner)
        while (best := queue.pop()) is not None:
            rank, at = best
            at = at[rank_at[at] == rank]
            if len(at) > 1:
                at = np.unique(at)
                at = at[_alternate(after[at[:-1]] == at[1:])]
            elif not len(at):
                continue
            right = after[at]
            behind = after[right]
            gone[right] = True
            rank_at[right] = -1
            part[at] = rank
            after[at] = behind
            real = behind < n
            before[behind[real]] = at[real]
            rank_at[at] = np.where(real, self.pair_rank(part[at], part[behind]), -1)
            front = before[at]
            held = front >= 0
            front = front[held]
            rank_at[front] = self.pair_rank(part[front], part[after[front]])
            changed = np.concatenate((at, front))
            queue.push(rank_at[changed], changed)
        ids = part[:n][~gone].astype("<u4").tobytes()
        counts = np.concatenate(([0], np.cumsum(~gone)))
        stops = (counts[ends] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *stops], stops)]


def _alternate(linked: np.ndarray) -> np.ndarray:
    """Keep the first, third, ... entry of every run of entries that are linked to the next one."""
    place = np.arange(len(linked) + 1)
    heads = np.concatenate(([True], ~linked))
    first = np.maximum.accumulate(np.where(heads, place, 0))
    return (place - first) % 2 == 0


#: A space inside a run of white space, or one that ends such a run at the end of a text.
_SPACE_INSIDE = re.compile(r"\s \s|\s \Z")


class Codec:
    """Encodes batches of whole texts.

    A single space before other characters always starts a new pre-token, and so does a space that starts a run of
    white space.  So texts are cut at spaces and every distinct piece is matched once; texts with other
    spaces are matched as a whole.  What is remembered between batches changes nothing but the time taken.
    """

    def __init__(self, encoder: Encoder, pattern: str) -> None:
        self.encoder = encoder
        self.tokens = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.long: list[str] = []

    def _learn(self, tokens: Iterable[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        self.known.update(zip(new, self.encoder.encode([t.encode() for t in new])))
        self.long += [t for t in new if len(t) > MOST_KNOWN_CHARS]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        whole = [bool(_SPACE_INSIDE.search(t)) for t in texts]
        pieces: set[str] = set()
        tokens: set[str] = set()
        for text, odd in zip(texts, whole):
            if odd:
                tokens.update(self.tokens(text))
            elif text:
                cut = text.find(" ")
                pieces.add(text if cut < 0 else text[:cut])
                if cut >= 0:
                    pieces.update([" " + p for p in text[cut + 1 :].split(" ")])
        pieces.discard("")
        split = {}
        for piece in pieces:
            bare = piece[1:] if piece[0] == " " else piece
            split[piece] = (piece,) if bare.isascii() and bare.isalpha() else self.tokens(piece)
        tokens.update(*split.values())
        self._learn(tokens)
        known = self.known
        ids = {p: known[own[0]] if len(own) == 1 else b"".join([known[t] for t in own]) for p, own in split.items()}
        ids[""] = b""
        out = []
        for text, odd in zip(texts, whole):
            if odd:
                out.append(b"".join([known[t] for t in self.tokens(text)]))
                continue
            cut = text.find(" ")
            if cut < 0:
                out.append(ids[text])
                continue
            out.append(ids[text[:cut]] + b"".join([ids[" " + p] for p in text[cut + 1 :].split(" ")]))
        for token in self.long:
            del known[token]
        self.long = []
        if len(known) > MOST_KNOWN:
            known.clear()
        return out


@lru_cache(maxsize=2)
def queue_codec(path: str, pattern: str) -> Codec:
    return Codec(Encoder(read_ranks(path)), pattern)


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens of a rank file, in the order of their ids, and where each one starts."""
    by_rank = {rank: token for token, rank in read_ranks(path).items()}
    table = [by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)]
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum([0, *map(len, table)])


def decode(ids: np.ndarray, content: np.ndarray, starts: np.ndarray, most: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of `ids`, in parts of `most` ids."""
    for i in range(0, len(ids), most):
        part = ids[i : i + most].astype(np.int64)
        size = starts[part + 1] - starts[part]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(starts[part] - begin, size)
        yield content[at].tobytes()


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): ids as little-endian unsigned 32-bit integers, one row per row of `docs`.

    A null text counts as empty and has no ids.  Ids, nulls included, pass through; repeated rows are all encoded;
    columns not named are ignored.  Every row is encoded on its own, so hot keys and ties do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = queue_codec(path, pattern)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts, BATCH_BYTES, len(texts)):
                ids = codec.encode([t or "" for t in texts[a:b].to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(ids, pa.binary())], names=["doc_id", "ids"]
                )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, content binary): the bytes that the ids stand for; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, starts = token_table(path)
        for batch in batches:
            for a, b in slices(batch.column(1), BATCH_BYTES, batch.num_rows):
                part = batch.slice(a, b - a)
                out = [
                    None if v is None else b"".join(decode(np.frombuffer(v, "<u4"), content, starts))
                    for v in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "content"]
                )

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, content binary")
