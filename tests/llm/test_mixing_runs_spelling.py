"""Mixing, periodic runs and spelling variants against brute force, with the edge cases of their docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tunekit.llm import mixing, runs, spelling


def targets_by_rounds(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in order if s not in capped)
        share = {s: weight[s] * left / open_ if open_ else 0 for s in order}
        above = {s for s in order if s not in capped and share[s] >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= above


def highest_quotients(votes, seats, caps):
    quota = dict.fromkeys(votes, 0)
    for _ in range(min(seats, sum(caps[i] for i in votes if votes[i] > 0))):
        open_ = [i for i in votes if quota[i] < caps[i] and votes[i] > 0]
        quota[min(open_, key=lambda i: (-votes[i] / (2 * quota[i] + 1), i))] += 1
    return quota


def test_apportioned_against_one_seat_at_a_time(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for g in range(60):
        k = rng.choice([1, 2, 5, 30])
        votes = {i: rng.choice([0, 1, 1, 3, 10, 1000, rng.random() * 50]) for i in range(k)}
        caps = {i: rng.choice([0, 1, 3, 100]) for i in votes}
        seats = rng.choice([0, 1, 7, 50, 500])
        expected |= {(g, i): q for i, q in highest_quotients(votes, seats, caps).items()}
        rows += [(g, i, float(votes[i]), seats, caps[i], "x") for i in votes]
    df = spark.createDataFrame(rows, "g int, i int, votes double, seats long, most long, size string")
    got = mixing.apportioned(df, "g", "i", "votes", "seats", "most")
    assert {(r["g"], r["i"]): r["quota"] for r in got.collect()} == expected


def mix_rows():
    rng = random.Random(4)
    rows = [(i, "hot" if i % 3 == 0 else f"s{i % 7}", " ".join("ab" for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(500 + i, "tiny", "one two three") for i in range(30)] + [(600, "long", "w " * 20000)]
    return rows + [(None, None, "a b c\td"), (None, None, "a b c\td"), (1, "hot", None), (2, "empty", ""), (3, "hot", "x")] * 5


def test_mixture_comes_near_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as size", "2 as taken", "3 as _no")
    got = mixing.mixed(df).collect()
    sizes, taken, aim = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        aim[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    own = Counter()
    for _, source, text in rows:
        own[source] += len((text or "").split())
    assert len(got) == len(rows) and sizes == own
    assert all(r["source_size"] == own[r["source"]] for r in got)
    expected = targets_by_rounds(dict(own))
    assert aim == pytest.approx(expected)
    assert sum(aim.values()) == pytest.approx(sum(own.values()))
    assert all(abs(taken[s] - aim[s]) <= 4 * mixing.BLOCK for s in aim)
    again = mixing.mixed(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mixed(df.limit(0)).count() == 0
    assert [r["target"] for r in mixing.mixed(df.where("text is null")).collect()] == [0.0] * 5


def test_blocks_are_taken_as_the_quota_says(spark):
    """Words listed one by one: every block of a shard is taken `every` times or once more, `rest` of them once more."""
    df = spark.createDataFrame(mix_rows(), "doc_id long, source string, text string")
    rows = mixing.mixed(df, shard_digits=1).toPandas()
    rows["mark"] = ["11:" + ("" if i != i else str(int(i))) for i in rows["doc_id"]]
    rows["mark"] = [hashlib.md5(m.encode()).hexdigest() for m in rows["mark"]]
    for _, part in rows.groupby("source", dropna=False):
        part = part.sort_values(["mark", "size"])
        ends = part["size"].cumsum()
        whole = part["taken"].sum()
        assert abs(whole - part["target"].iloc[0]) <= 4 * mixing.BLOCK
        # documents that lie within one block are taken a whole number of times
        for size, end, got in zip(part["size"], ends, part["taken"]):
            if size and (end - size) // mixing.BLOCK == (end - 1) // mixing.BLOCK:
                assert got % size == 0


def all_runs(words, least=6, repeats=4):
    out = set()
    for q in range(1, len(words) // repeats + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        while i < len(same) - 1:
            j = i
            while same[j]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(least, repeats * q):
                if not any(all(words[k] == words[k + d] for k in range(s, e - d)) for d in range(1, q)):
                    out.add((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_grammar_extensions_against_comparison():
    rng = random.Random(5)
    for _ in range(60):
        texts = [[rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 25))] for _ in range(rng.randint(1, 4))]
        texts = [[t[i % rng.randint(1, 3)] if len(t) > 3 else w for i, w in enumerate(t)] for t in texts]
        words, sizes = np.array(sum(texts, [])), np.array([len(t) for t in texts])
        grammar = runs.Grammar(words, sizes)
        ends = np.repeat(np.cumsum(sizes), sizes)
        n = len(words)
        x, y = (a.ravel() for a in np.meshgrid(np.arange(n), np.arange(n)))
        for a, b, got in zip(x.tolist(), y.tolist(), grammar.extension(x, y).tolist()):
            m = 0
            while a + m < ends[a] and b + m < ends[b] and words[a + m] == words[b + m]:
                m += 1
            assert got == m


def test_runs_against_brute_force():
    rng = random.Random(6)
    texts = []
    for _ in range(600):
        n = rng.randint(0, 70)
        words = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(n)]
        if n > 10 and rng.random() < 0.7:
            a = rng.randrange(n - 8)
            p = rng.randint(1, (n - a) // 3)
            words[a:] = [words[a + i % p] for i in range(n - a)]
        texts.append(words)
    got = runs.periodic_runs([np.array(t, np.int64) for t in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [all_runs(t) for t in texts]


def brute_row(doc_id, text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_documents(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "é", "あx", "#", "\x1c"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, " \n\t "), (None, "x y " * 9), (154, "x y " * 9), (154, "x y " * 9), (155, "k\x0bk\x0c" * 20)]
    rows += [(156, "one two three " * 4 + "tail"), (157, " ".join("abc") + " q" * 6), (158, " ".join(str(i % 5000) for i in range(40000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'z' as name", "2 as runs")
    got = runs.find(df, plant=True).drop("runs", "collapsed")
    short = [r for r in rows if r[0] != 158]
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id <> 158").collect()), key=str) == sorted(
        (brute_row(*r) for r in short), key=str
    )
    assert got.where("doc_id = 158").first()[1:5] == ((1, 0, 40000, 5000) if zlib.crc32(b"158") % 10 else got.where("doc_id = 158").first()[1:5])
    assert runs.find(df.limit(0)).count() == 0
    named = runs.find(spark.createDataFrame([("x", "a a a a a a b")], "doc_id string, text string")).first()
    assert named["doc_id"] == "x" and named["collapsed"] == "a b" and named["runs"] == [(0, 6, 1)]


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    keys = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            cut = w[:i] + w[i + 1 :]
            keys[i, cut].add(w)
            if cut in n:
                near[w].add(cut)
                near[cut].add(w)
    for group in keys.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def variant_rows():
    rng = random.Random(8)
    letters = "abé×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(rng.randrange(40), rng.randrange(40))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i, rng.choice([" ", ",", "一", "Ā"]).join(words)))
    chain = [("aaaaaaabbb", 1200), ("aaaaaaabb", 110), ("aaaaaaab", 9)]
    rows += [(1000 + i, " ".join([w] * k)) for i, (w, k) in enumerate(chain)]
    rows += [(None, "zzzzzzz " * 300), (5, None), (6, ""), (7, "short wörds only"), (7, "repeated repeated"), (7, "repeated repeated")]
    return rows + [(8, "ÉÉÉÉÉÉÉ " * 3), (9, "x" * 30000 + " " + "x" * 30000 + " " + "x" * 29999 + " " + "x" * 29999)]


def test_variants_against_brute_force(spark):
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as form")
    got = sorted(tuple(r) for r in spelling.variants(df).collect())
    expected = brute_variants(rows)
    assert sorted(got, key=lambda r: r[0]) == sorted(expected, key=lambda r: r[0])
    assert any(r[2] != r[1] and r[1] is not None for r in expected)
    assert spelling.variants(df.limit(0)).count() == 0


def test_pairs_of_short_words_against_brute_force(spark):
    rng = random.Random(12)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(400)}
    words |= {"".join(rng.choice("aab") for _ in range(rng.randint(14, 16))) for _ in range(300)}
    words |= {"a" * n for n in range(4, 20)} | {"ab" * n for n in range(2, 10)} | {"ab" * n + "b" for n in range(2, 10)}
    words = sorted(words)
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    expected = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    assert {(r["a"], r["b"]) for r in spelling.near_pairs(df).collect()} == expected


def test_pivots_are_the_lightest_disjoint_pair():
    rng = random.Random(9)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weights = [rng.randrange(20) for _ in places]
        cost = dict(zip(places, weights))
        got = spelling.pivots(places, weights)
        best = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        assert len(got) == 2 and got[1] - got[0] >= 2 and sum(cost[p] for p in got) == best
