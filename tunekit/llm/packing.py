"""Packing of token sequences into windows of fixed capacity by multiway differencing.

Full windows are cut off long documents first.  What is left of every document is cut into pieces of at most
`PIECE` ids, and a group of documents is dealt over k windows by the Karmarkar-Karp method: every piece starts
as a partial partition (one filled window, k - 1 empty ones); the two partitions with the largest imbalances are
merged, the fullest windows of one with the emptiest of the other, until one partition is left.  k is the smallest count
that could hold the ids, and rises by one whenever a window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunekit.llm import bpe

CAPACITY = 2048
PIECE = 256
GROUP_IDS = 1 << 20
END_ID = 1

# Fixed value: the split of byte-level tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Deal items over `windows` windows with near-equal sums; the item numbers of each window.

    A partial partition lists its filled windows, fullest first; the rest are empty.  Ties of imbalance go to the older one.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap = [(-size, i, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(heap)
    while len(heap) > 1:
        _, _, left = heapq.heappop(heap)
        _, _, right = heapq.heappop(heap)
        # window i of one takes window `windows` - 1 - i of the other: from `free` on both may be filled
        free = min(len(left), windows - len(right))
        both = [(a + b, (x, y)) for (a, x), (b, y) in zip(left[free:], right[windows - 1 - free :: -1])]
        parts = left[:free] + right[: windows - len(left)] + both
        parts.sort(key=lambda p: -p[0])
        least = parts[-1][0] if len(parts) == windows else 0
        heapq.heappush(heap, (least - parts[0][0], turn, parts))
        turn += 1
    dealt = [_flat(slot) for _, slot in heap[0][2]] if heap else []
    return dealt + [[] for _ in range(windows - len(dealt))]


def _flat(tree: tuple | int) -> list[int]:
    """The item numbers in nested pairs."""
    out, stack = [], [tree]
    while stack:
        top = stack.pop()
        if isinstance(top, tuple):
            stack.extend(top)
        else:
            out.append(top)
    return out


def balanced(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from the least possible count upwards, in which differencing exceeds no capacity."""
    total = sum(sizes)
    windows = max(1, -(-total // capacity))
    while True:
        dealt = differencing(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        windows += 1


def pack(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE) -> list[list[tuple[int, int, int]]]:
    """Windows of (document number, start, length) that hold every id of documents of these lengths once."""
    full, loose = [], []
    for d, n in enumerate(lengths):
        whole = n // capacity
        full += [[(d, k * capacity, capacity)] for k in range(whole)]
        loose += [(d, s, min(piece, n - s)) for s in range(whole * capacity, n, piece)]
    if not loose:
        return full
    dealt = balanced([p[2] for p in loose], capacity)
    return full + [joined(sorted(loose[i] for i in w)) for w in dealt if w]


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbouring pieces of a document become one."""
    out: list[tuple[int, int, int]] = []
    for d, s, n in pieces:
        if out and out[-1][0] == d and out[-1][1] + out[-1][2] == s:
            out[-1] = (d, out[-1][1], out[-1][2] + n)
        else:
            out.append((d, s, n))
    return out


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str, ranks: str, pattern: str) -> tuple[Tokenizer, tuple[str, ...], tiktoken.Encoding]:
    full = Tokenizer.from_file(vocabulary)
    table = bpe.read_ranks(ranks)
    check_same(json.loads(full.to_str()), full, table, pattern)
    special = tuple(t.content for t in full.get_added_tokens_decoder().values())
    return full, special, tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def check_same(spec: dict, full: Tokenizer, table: dict[bytes, int], pattern: str) -> None:
    """Raise unless the tokenizer is plain byte-level BPE with the vocabulary, the merges and the pattern of the rank file."""
    split = spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex")
    plain = plain and not split.get("add_prefix_space") and pattern == BYTE_LEVEL_PATTERN
    model = spec["model"]
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    letters = {c: b for b, c in byte_letters().items()}
    raw = lambda token: bytes(letters[c] for c in token)
    added = set(full.get_added_tokens_decoder())
    same = plain and {raw(t): i for t, i in model["vocab"].items() if i not in added} == table
    # the rank of a pair is that of its whole, so merges must stand in the order of their results
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    results = [table.get(raw(a) + raw(b), -1) for a, b in pairs] if same else [-1]
    if not same or results[:1] == [-1] or any(a >= b for a, b in zip(results, results[1:])):
        raise ValueError("the tokenizer and the rank file do not give the same ids")


def byte_letters() -> dict[int, str]:
    """The printable letter of every byte in vocabularies of byte-level tokenizers: itself, or one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def token_ids(text: str, vocabulary: str, ranks: str, pattern: str) -> np.ndarray:
    """Ids of the tokenizer in the file `vocabulary`, without special tokens added.

    `ranks` holds the same vocabulary as a rank file (checked once per process), with which the same ids are found several times faster.  Texts that
    hold the string of a special token, which the tokenizer finds in plain text too, go to the tokenizer itself.
    """
    full, special, fast = _tokenizer(vocabulary, ranks, pattern)
    if any(s in text for s in special):
        return np.array(full.encode(text, add_special_tokens=False).ids, "<u4")
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=())).astype("<u4")


def packed(
    docs: DataFrame,
    vocabulary: str,
    ranks: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Rows are packed where they are read, in groups of about `GROUP_IDS` ids, so nothing is shuffled and no key can be hot;
    a sequence id names the partition and the window in it, and a repeated task gives the same ids.  A null text counts
    as empty: such a document is the end id alone.  Repeated rows and null ids are packed like others; columns not named
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = TaskContext.get().partitionId() << 40
        held_ids: list = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal window
            rows: list[tuple] = []
            for pieces in pack([len(x) for x in held], capacity):
                offset = 0
                for d, start, n in pieces:
                    part = held[d][start : start + n]
                    rows.append((held_ids[d], start, n, zlib.crc32(part.tobytes()), len(held[d]), window, offset, part))
                    offset += n
                window += 1
            columns = list(zip(*rows))
            sizes = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
            values = pa.array(np.concatenate(columns[7]).astype(np.int32))
            held_ids.clear()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:7]], pa.ListArray.from_arrays(pa.array(sizes), values)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        waiting = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for name, text in zip(names, texts):
                own = token_ids(text.as_py() or "", vocabulary, ranks, pattern)
                held_ids.append(name)
                held.append(np.append(own, np.uint32(end_id)).astype("<u4"))
                waiting += len(held[-1])
                if waiting >= GROUP_IDS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA)
