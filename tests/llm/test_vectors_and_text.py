"""Operators on vectors, fingerprints, languages and tokens against brute force."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from tunekit.llm import bpe, grid_join, language, packing, simhash
from tunekit.llm.components import components

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = (
    public_tokenizers.path("byte_bpe_50k.json"),
    public_tokenizers.path("byte_bpe_50k.tiktoken"),
    public_tokenizers.PATTERN,
)


class Classes:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    order = list(range(100))
    rng.shuffle(order)
    edges = list(zip(order[:40], order[1:41])) + [(order[50], order[i]) for i in range(51, 70)] + [(5, 5), (None, 3), (1, None)]
    own = Classes(range(100))
    for a, b in edges:
        if a is not None and b is not None:
            own.join(a, b)
    rows = components(spark.createDataFrame(edges + edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in rows}
    assert len(rows) == len(root) == 61
    for x in root:
        for y in root:
            assert (root[x] == root[y]) == (own.find(x) == own.find(y))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = [
    (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1),
    (6, [1.0, None], 1), (7, [float("nan"), 1.0], 1), (8, [1.0, 0.1], None), (9, [1.0, 0.1], 1), (10, [1.0], 1),
    (11, [3.0], 1), (12, [], 1), (None, [1.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [float("inf"), 0.0], 1),
]


def test_grid_join_edge_cases(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as size", "2 as rep")
    got = sorted((tuple(r) for r in grid_join.near_vectors(df).collect()), key=str)
    five = {1, 2, 3, 9}
    expected = []
    for i, _, _ in VECTORS:
        if i in five:
            expected.append((i, 4, 1, i == 1))
        elif i in (10, 11):
            expected.append((i, 1, 10, i == 10))
        else:
            expected.append((i, 0, i, i is not None))
    assert got == sorted(expected, key=str)
    assert grid_join.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "branches"), [(16, 2), (1024, 8)])
def test_grid_join_against_all_pairs(spark, block, branches):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    x = np.vstack((centres[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) * 0.25, np.repeat(centres[:1], 40, axis=0)))
    labels = rng.integers(0, 2, len(x)).tolist()
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(zip(x.tolist(), labels))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(near, False)
    own = Classes(range(len(x)))
    for a, b in np.argwhere(near):
        own.join(int(a), int(b))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in grid_join.near_vectors(df, block=block, branches=branches).collect()}
    assert got == {i: (int(near[i].sum()), own.find(i)) for i in range(len(x))}
    assert near.sum() > 1000


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}É" for i in range(60)]
    texts = []
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(1, 60))
        for _ in range(6):
            own = list(base)
            if rng.random() < 0.6:
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    texts += [None, "", " \x0b", "One two", "one TWO", "x\x1cy"]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as fingerprint", "1 as node")
    prints = {t: plain_fingerprint(t) for _, t in rows}
    ids = [i for i, _ in rows if i is not None]
    own = Classes(ids)
    for i, a in rows:
        for j, b in rows:
            if i is not None and j is not None and (prints[a] ^ prints[b]).bit_count() <= 4:
                own.join(i, j)
    found = simhash.near_duplicates(df, tile_rows=16)
    got = sorted(((r[0], r[1], r[2]) for r in found.select("doc_id", simhash.hex_print(), "component_id").collect()), key=str)
    expected = [(i, f"{prints[t]:016x}", own.find(0 if i is None else i)) for i, t in rows]
    assert got == sorted(expected, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame(
        [(-1, None, "en"), (-2, "", "fr"), (-3, "123 !?", None), (None, "the and of", "en"), (-4, "é" * 200000, None)],
        "doc_id long, text string, lang string",
    )
    rows = docs.select("doc_id", "text", "lang").unionByName(extra).selectExpr("*", "1 as score", "2 as lang_pred")
    got = language.identify(rows).join(docs.select("doc_id", "lang"), "doc_id", "left").collect()
    assert len(got) == 1005
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (-1, -2, -3)] == ["und"] * 3
    assert by_id[None]["lang_pred"] == "en" and not by_id[None]["held_out"] and by_id[-4]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    empty = language.identify(rows.limit(0))
    assert empty.count() == 0
    nothing_learned = language.identify(rows.selectExpr("doc_id", "text", "cast(null as string) as lang").limit(5))
    assert {r["lang_pred"] for r in nothing_learned.collect()} == {"und"}


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_bpe_equals_tiktoken(reference):
    rng = random.Random(2)
    letters = "ab'sétlré  \n\t  \x1c\x1f\x85\x0b12²٣中文😀.,!'ll​"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(20000)]
    texts += ["a" * 3000, "ab" * 5000, " " * 500, "".join(rng.choices("abcdefgh", k=50000)), "the<|endoftext|>end"]
    codec = bpe.queue_codec(RANKS, public_tokenizers.PATTERN)
    expected = [np.array(reference.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert codec.encode(texts) == expected
    assert [codec.encode([t])[0] for t in texts[:50]] == expected[:50]


def test_bpe_round_trip(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (None, "x y")], "doc_id long, text string")
    rows = docs.unionByName(extra).selectExpr("*", "1 as ids", "2 as content")
    out = bpe.decoded(bpe.encoded(rows, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    text = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert len(out) == rows.count()
    for r in out:
        assert bytes(r["content"]) == text[r["doc_id"]].encode()
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text[r["doc_id"]])
    assert bpe.encoded(rows.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_differencing_is_near_equal_and_complete(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 256) for _ in range(rng.randint(1, 400))]
    for windows in (1, 3, 10):
        dealt = packing.differencing(sizes, windows)
        assert sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in dealt]
        assert max(sums) - min(sums) <= max(sizes)
    assert all(sum(sizes[i] for i in w) <= 512 for w in packing.balanced(sizes, 512))


def plain_differencing(sizes, windows):
    """The textbook method: partitions as lists of all their sums, merged fullest with emptiest."""
    parts = [(-size, i, [size] + [0] * (windows - 1)) for i, size in enumerate(sizes)]
    turn = len(parts)
    while len(parts) > 1:
        parts.sort()
        a, b = parts.pop(0), parts.pop(0)
        sums = sorted((x + y for x, y in zip(a[2], reversed(b[2]))), reverse=True)
        parts.append((sums[-1] - sums[0], turn, sums))
        turn += 1
    return parts[0][2]


def test_differencing_is_the_textbook_method():
    rng = random.Random(11)
    assert sorted(sum([10, 2, 1, 1][i] for i in w) for w in packing.differencing([10, 2, 1, 1], 2)) == [4, 10]
    for _ in range(300):
        sizes = [rng.choice([rng.randint(1, 9), rng.randint(1, 256), 256]) for _ in range(rng.randint(1, 60))]
        windows = rng.randint(2, 12)
        dealt = packing.differencing(sizes, windows)
        assert sorted((sum(sizes[i] for i in w) for w in dealt), reverse=True) == plain_differencing(sizes, windows)


def test_a_tokenizer_that_differs_from_the_rank_file_is_refused():
    full = Tokenizer.from_file(BPE[0])
    table = bpe.read_ranks(BPE[1])
    spec = json.loads(full.to_str())
    packing.check_same(spec, full, table, BPE[2])
    swapped = dict(table)
    a, b = list(table)[400:402]
    swapped[a], swapped[b] = table[b], table[a]
    for bad in ((spec | {"normalizer": {"type": "Lowercase"}}, table, BPE[2]), (spec, swapped, BPE[2]), (spec, table, BPE[2] + "|x")):
        with pytest.raises(ValueError):
            packing.check_same(bad[0], full, bad[1], bad[2])


def test_packing_keeps_every_id_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b"), (-4, "ab " * 20000)], "doc_id long, text string")
    rows = docs.unionByName(extra).selectExpr("*", "1 as start", "2 as offset")
    plain = Tokenizer.from_file(BPE[0])
    ids = {r["doc_id"]: plain.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    pieces = sorted((r.asDict() for r in packing.packed(rows, *BPE).collect()), key=lambda r: (r["doc_id"], r["start"]))
    reached = dict.fromkeys(ids, 0)
    windows = {}
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["start"] == reached[r["doc_id"]] and r["doc_tokens"] == len(own)
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        reached[r["doc_id"]] += r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert reached == {k: len(v) for k, v in ids.items()}
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert sum(reached.values()) > 0.98 * 2048 * len(windows)
    assert packing.packed(rows.limit(0), *BPE).count() == 0
