"""Operators on documents and archives, and the pipeline, against brute force."""

import base64
import hashlib
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunekit.llm import bwt, line_rules, pii, sharding, suffix_dedup, warc

SPACES = "\x20\x09-\x0d"
PAGES = [(1, "u", "x"), (2, None, None), (3, "a\r\nb", ""), (4, "v", "é" * 100000), (None, "w", "x"), (5, "q", "x"), (5, "q", "x")]


def test_warc_round_trip_at_any_range_size(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as d")
    manifest = warc.write(pages, f"{tmp_path}/a", file_bytes=600)
    whole = sorted((tuple(r) for r in warc.read(manifest).collect()), key=str)
    for size in (5, 64, 1000):
        assert sorted((tuple(r) for r in warc.read(manifest, size).collect()), key=str) == whole
    digest = {h or "": base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for _, _, h in PAGES}
    keeper = {"x": 5, "": 3, "é" * 100000: 4}
    expected = []
    for i, _, h in PAGES:
        h = h or ""
        first = keeper[h] == i
        expected.append((i, "response" if first else "revisit", None if first else keeper[h], len(h.encode()), digest[h]))
    assert sorted(((r[0], r[2], r[3], r[4], r[5]) for r in whole), key=str) == sorted(expected, key=str)
    assert {r[6] and bytes(r[6]).decode() for r in whole if r[0] == 4} == {"é" * 100000}
    apart = warc.read(warc.write(pages, f"{tmp_path}/b", least_bytes=2)).collect()
    assert {r["record_type"] for r in apart} == {"response"}
    assert warc.read(warc.write(pages.limit(0), f"{tmp_path}/c")).count() == 0


def test_warc_reader_ignores_magic_that_starts_no_record():
    import pyarrow as pa

    noise = warc.MAGIC + b"noise" + warc.MAGIC
    data = noise + warc.record(1, "u", b"one", None, False) + noise + warc.record(2, "u", b"two", None, False)
    source = warc.Source(pa.BufferReader(data), len(data))
    assert [r[0] for r in warc.owned(source, 0, len(data))] == [1, 2]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:A\r\nContent-Length: 3\r\n\r\nabc")


def test_shards_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "c" * 300 if i % 3 == 0 else "x" * rng.randint(0, 600)) for i in range(3000)] + [(None, "n"), (5, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as chars", "3 as slot")
    out = sharding.shard_documents(df, 7).collect()
    assert len(out) == len(rows)
    sizes, slots = {}, {}
    for r in out:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(sizes) == list(range(7))
    assert max(sizes.values()) < 1.02 * np.mean(list(sizes.values()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    assert sharding.shard_documents(df.limit(0), 7).count() == 0
    same = spark.createDataFrame([(1, "a")] * 50, "doc_id long, text string")
    assert sharding.shard_documents(same, 4).count() == 50


def test_shards_hold_equal_bytes_when_rows_repeat(spark):
    rng = random.Random(2)
    rows = [(1, "r" * 100)] * 400 + [(10 + i, "t" * 100) for i in range(400)] + [(None, None)] * 300
    rows += [(1000 + i, "é" * rng.randint(0, 200)) for i in range(300)] + [(2000, "long " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, 4).collect()
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(4)]
    assert max(sizes) - min(sizes) <= 20008 and sum(sizes) == sum(len((t or "").encode()) + 8 for _, t in rows)
    expected = sorted((d or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in out) == expected
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    equal = spark.createDataFrame([(1, "r" * 100)] * 400 + [(10 + i, "t" * 100) for i in range(400)], "doc_id long, text string")
    sizes = [r["s"] for r in sharding.shard_documents(equal, 4).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 4 and max(sizes) <= 1.02 * min(sizes)


def plain_removal(rows, width=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for x in {b[i : i + width] for i in range(len(b) - width + 1)} if d is not None else ():
            first[x] = min(first.get(x, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1) if d is not None else ():
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def removal(df):
    columns = ["row.doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    return sorted(((*r[:4], bytes(r[4])) for r in suffix_dedup.removed(df).select(*columns).collect()), key=str)


def test_repeated_strings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bwt, "ROW_BITS", 10)
    rng = random.Random(5)
    passages = ["".join(rng.choices("abc é", k=rng.randint(30, 140))) for _ in range(12)]
    rows = []
    for i in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choices("xyz ", k=20)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([7, None]) if i % 9 == 0 else i, rng.choice([None, ""]) if i % 17 == 0 else "".join(parts)))
    rows += [(500 + i, "a" * (3 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as row", "3 as kept")
    assert removal(df) == plain_removal(rows)
    assert removal(df.limit(0)) == []


def test_repeated_strings_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert removal(df) == plain_removal([tuple(r) for r in df.collect()])


def test_of_equal_texts_one_takes_part(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abc é", k=n))
    texts = [text(300), text(120), text(50), text(20), ""]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(200)]
    rows += [(100 + i, texts[0][: 60 + i] + text(30)) for i in range(10)] + [(-5, texts[1][10:90]), (3, texts[0]), (3, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    minimized = spark.sparkContext.accumulator(0)

    def noted(data, width):
        minimized.add(len(data) >= 50)
        return minimizers(data, width)

    minimizers = suffix_dedup.minimizers
    monkeypatch.setattr(suffix_dedup, "minimizers", noted)
    assert removal(df) == plain_removal(rows)
    # a document is cut into runs when they are counted and when they are sent; copies under larger ids are not
    first = {t: min(i for i, x in rows if x == t and i is not None) for t in texts if len(t.encode()) >= 50}
    own = sum(i is not None and first.get(t, i) == i and len(t.encode()) >= 50 for i, t in rows)
    assert 0 < minimized.value <= 2 * own
    parts = df.selectExpr("doc_id", "cast(text as binary) body", "pmod(doc_id, 3) bucket")
    found = {(r["bucket"], bytes(r["digest"]), r["least"]) for r in suffix_dedup.copied(parts).collect()}
    assert found == {(i % 3, hashlib.sha256(t.encode()).digest(), first[t]) for i, t in rows if i is not None and t in first and i > first[t]}


def test_bins_do_not_hold_every_context_of_a_frequent_phrase(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    phrase, passage = word(45), word(120)
    rows = [(i, word(60) + (phrase if i % 3 else passage) + word(60)) for i in range(3000)]
    rows += [(7000 + i, rows[i][1][20:130]) for i in range(0, 60, 2)] + [(7000, rows[1][1]), (None, rows[5][1]), (9000, phrase * 4)]
    repeated, sizes = bwt.repeated, tmp_path / "sizes"
    sizes.mkdir()

    def noted(strings, windows, width, owners):
        (sizes / f"{hash(strings[0])}-{len(strings)}").touch()
        return repeated(strings, windows, width, owners)

    monkeypatch.setattr(suffix_dedup, "bwt", SimpleNamespace(repeated=noted))  # workers get it with the functions that use it
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", 200, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(df) == plain_removal(rows)
    assert max(int(f.name.rpartition("-")[2]) for f in sizes.iterdir()) < 1000


@pytest.mark.parametrize("seed", range(10))
def test_merged_transforms_give_sorted_intervals(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(bwt, "ROW_BITS", rng.choice([7, 8, 20]))
    width = rng.choice([3, 5, 8])
    strings = list(dict.fromkeys(bytes(rng.choices(b"ab\x00\xfd", k=rng.randint(width, 30))) for _ in range(30)))
    windows = np.array([len(s) - width + 1 for s in strings])
    string, place, interval = bwt.repeated(strings, windows, width)
    found = [strings[a][b : b + width] for a, b in zip(string, place)]
    assert sorted(zip(string.tolist(), place.tolist())) == [(i, p) for i, n in enumerate(windows) for p in range(n)]
    assert found == sorted(found)
    assert all((found[i] == found[i + 1]) == (interval[i] == interval[i + 1]) for i in range(len(found) - 1))


@pytest.mark.parametrize("seed", range(10))
def test_merge_drops_only_intervals_of_one_owner(seed):
    rng = random.Random(seed)
    width = rng.choice([3, 5, 8])
    strings = list(dict.fromkeys(bytes(rng.choices(b"ab", k=rng.randint(width, 40))) for _ in range(40)))
    windows = np.array([len(s) - width + 1 for s in strings])
    owners = np.array([rng.randrange(6) for _ in strings])
    holders = {}
    for s, o in zip(strings, owners.tolist()):
        for p in range(len(s) - width + 1):
            holders.setdefault(s[p : p + width], set()).add(o)
    string, place, interval = bwt.repeated(strings, windows, width, owners)
    found = [strings[a][b : b + width] for a, b in zip(string, place)]
    every = [s[p : p + width] for s in strings for p in range(len(s) - width + 1)]
    assert sorted(found) == found == sorted(w for w in every if len(holders[w]) > 1)
    assert all((found[i] == found[i + 1]) == (interval[i] == interval[i + 1]) for i in range(len(found) - 1))


RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]
            if fine():
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_base_spans_against_brute_force(spark):
    rng = random.Random(6)
    texts = [
        "", None, "é😀 a@b.c%d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 012.3.4.5 000000000000000000000001.2.3.4",
        "4111 1111 1111 1111 4111-1111-1111-1112 +1 (415) 555-0199. +1+2", "x@y@z.com a.b@c.d-e.f..g@h.i",
        "1" * 3000 + " 1.2.3.4", "a" * 3000 + "@", "1 2 3 4 5 6 7 8 9 0 " * 200, "+1(((((9 +123456789 +12 345 6789 0123456",
    ]
    texts += ["".join(rng.choices("ab1234567890.@+- ()%é\n", k=rng.randint(5, 80))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, "a@b.c")], "doc_id long, text string").selectExpr("*", "1 as body", "2 as base")
    found = pii.find(df)
    rows = found.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "a@b.c" if r["doc_id"] is None else texts[r["doc_id"]]
        assert [tuple(s) for s in sorted(r["base"])] == plain_spans(text)
        assert set(r["base"]) <= set(r["spans"])
    digests = {r["doc_id"]: r for r in pii.digest_row(found).collect()}
    own = plain_spans(texts[3])
    assert digests[3]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in own).encode()).hexdigest()
    assert digests[3]["n_card"] == sum(s[2] == "card" for s in own)
    assert pii.find(df.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"report {i}. contact: user{i}@site.example.com today") for i in range(30)]
    rows += [(100, "please contact: user7@localhost now"), (101, "room 12a7 is free"), (102, "by user7@localhost again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df, "doc_id").collect()}
    assert [tuple(s) for s in found[101]["spans"]] == []
    sample = spark.createDataFrame(
        [("p", f"v{i}", "email") for i in range(20)] + [("p", "new", None), ("q", "new", None), ("q", "other", None), ("r", "v1", "email")],
        "pattern string, value string, kind string",
    )
    assert [tuple(r) for r in pii.bootstrap(sample).collect()] == [("new", "email")]


def test_contexts_discover_identifiers_with_blanks(spark):
    def checked(digits):
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))

    def grouped(digits):
        return " ".join(digits[i : i + 4] for i in range(0, 16, 4))

    cards = [grouped(checked(f"4111{i:04d}1111{i:03d}")) for i in range(30)]
    rows = [(i, f"order {i} by card: {cards[i]} today, phone +1 ({100 + i}) 555-77{i:02d}, thanks") for i in range(30)]
    wrong = cards[3][:-1] + str((int(cards[3][-1]) + 1) % 10)
    unseen = [(100, f"paid by card: {wrong}.", wrong, "card"), (101, "her phone +1 (17) 5-77, or not", "+1 (17) 5-77", "phone"), (102, f"size {wrong[:9]} 12", "", "")]
    df = spark.createDataFrame(rows + [u[:2] for u in unseen] + [(103, f"again {wrong}")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    for i, text, value, kind in unseen[:2]:
        at = text.index(value)
        assert found[i]["base"] == [] and [tuple(s) for s in found[i]["spans"]] == [(at, pii.KINDS.index(kind), kind, at + len(value))]
    assert found[102]["spans"] == [] and [s["kind"] for s in found[103]["spans"]] == ["card"]
    assert all([s["kind"] for s in found[i]["spans"]] == ["card", "phone"] for i in range(30))


def test_redaction(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, call +1 415 555 0199 or 1.2.3.4!"), (2, "none"), (3, None)], "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    out = df.select("doc_id", pii.redacted(text, pii.base_spans(text)).alias("t")).collect()
    assert [r["t"] for r in out] == ["é [EMAIL], call [PHONE] or [IP]!", "none", ""]


def plain_measures(text):
    text = text or ""
    words = re.findall(f"[^{SPACES}]+", text)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACES}]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_line_rules_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    body = " ".join(f"word{i}" for i in range(60))
    extra = [(-1, None, None), (-2, "", None), (-3, " \n\n x x x x x x x\nx\nx", "s"), (-4, "a b c a b c d a b", "s"),
             (-5, "q\x0bw e\x1cr z q w e\x1cr z", "s")]
    footer = " ".join(f"foot{i}" for i in range(70))
    for i in range(30):
        extra.append((-100 - i, f"{body} own{i}\n{footer}" if i < 25 else f"{body} own{i}", "busy"))
    extra += [(-200, extra[-1][1], "busy")] * 2
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "1 as host", "2 as body", "3 as line")
    out = line_rules.judge(df, least_documents=20, least_share=0.5).collect()
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    assert len(out) == df.count()
    for r in out:
        measured = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert measured == plain_measures(text[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    by_id = {r["doc_id"]: r for r in out}
    assert all(by_id[-100 - i]["n_lines_removed"] == (1 if i < 25 else 0) for i in range(30))
    assert [by_id[-100 - i]["kept"] for i in (0, 27)] == [False, True] and by_id[-100]["words_left"] == 61
    assert line_rules.judge(df.limit(0)).count() == 0


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    from tunekit.sources.session import through_table

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 34", "en", None, 5), (None, "the of and", "en", None, None)], docs.schema)
    docs = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = through_table(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs
        if name != "packed":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.dtypes == before.dtypes
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    assert ids["language_id"] == {r["doc_id"] for r in before_ids(spark, sf_dir)} | {None}
    from test_vectors_and_text import Classes, plain_fingerprint

    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in kept["language_id"].collect() if r["doc_id"] is not None}
    own = Classes(prints)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                own.join(a, b)
    assert ids["near_duplicates"] - {None} == {i for i in prints if own.find(i) == i}
    rows = [(r["doc_id"], r["text"]) for r in kept["near_duplicates"].collect()]
    left = {d: k.decode("utf-8", "replace") for d, _, _, _, k in plain_removal(rows)}
    text = {r["doc_id"]: r["text"] for r in kept["repeated_passages"].collect()}
    assert text.keys() == left.keys()
    assert all(text[d] == left[d] for d in text if "�" not in left[d])
    for r in kept["personal_data"].collect():
        assert not [s for s in plain_spans(r["text"]) if s[2] == "email"]
    assert ids["packed"] == ids["personal_data"]


def test_personal_data_of_rows_without_an_id_is_redacted(spark):
    import corpus_pipeline

    rows = [(None, "write to a@b.cd", "en", "s", 15), (None, "or e@f.gh now", "en", "s", 13), (None, None, "en", "s", None), (1, "me x@y.zz", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((tuple(r) for r in corpus_pipeline.personal_data(spark, docs, "").select("doc_id", "text").collect()), key=str)
    assert out == sorted([(None, "write to [EMAIL]"), (None, "or [EMAIL] now"), (None, None), (1, "me [EMAIL]")], key=str)


def before_ids(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()


def test_pipeline_keeps_different_texts_of_one_id(spark):
    import corpus_pipeline

    texts = [" ".join(random.Random(i).choices("abcdefghijklmnop", k=60)) for i in range(3)]
    rows = [(1, texts[0], "en", "s", 9), (1, texts[0], "de", "s", 9), (1, texts[1], "en", "s", 9), (2, texts[0], "en", "s", 9), (3, texts[2], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert out == sorted([(1, texts[0], "de", "s", 9), (1, texts[1], "en", "s", 9), (3, texts[2], None, None, None)], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline_does_not_lose_a_corpus_without_labels(spark):
    import corpus_pipeline

    rows = [(1, "some text", None, "s", 9), (2, "12 34", None, "s", 5), (3, None, None, None, None), (4, "é", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [rows[0], rows[3]]
    assert corpus_pipeline.language_id(spark, docs.limit(0), "").count() == 0
