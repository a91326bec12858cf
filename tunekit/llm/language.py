"""Language identification with a string kernel.

The kernel of two texts counts the distinct character n-grams (one to `ORDER` characters, lower-cased) that both
contain, over the geometric mean of their own counts: a blended spectrum of presences.  Nystroem landmarks turn it
into features, and kernel ridge regression is fitted one-versus-rest on a bounded sample of labelled rows.
Since the n-gram keys are exact (21 bits a code point), a decision is a matrix product of presences and weights,
taken for a batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.llm.common import slices

ORDER = 3
BITS = 21
ROWS_PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 40
PARTS = 32
RIDGE = 1e-3
UNKNOWN = "und"
CHUNK = 1 << 20


def grams(text: str) -> np.ndarray:
    """Sorted distinct keys of the n-grams of a text; the whole text counts, in chunks that overlap."""
    found = []
    points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    for i in range(0, max(len(points), 1), CHUNK):
        part = points[i : i + CHUNK + ORDER - 1]
        key = part
        for n in range(ORDER):
            if n:
                key = (key[:-1] << np.uint64(BITS)) | part[n:]
            found.append(np.unique(key))
    return np.unique(np.concatenate(found)) if len(points) > CHUNK else np.concatenate(found)


@dataclass
class Model:
    """Landmark n-grams and their weights per language; empty without labelled rows."""

    keys: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def decide(self, texts: list[str]) -> np.ndarray:
        """Decision values (texts x languages)."""
        present = np.zeros((len(texts), len(self.keys)), np.float32)
        norm = np.ones(len(texts))
        for row, text in enumerate(texts):
            own = grams(text)
            at = np.searchsorted(self.keys, own)
            at[at == len(self.keys)] = 0
            present[row, at[self.keys[at] == own]] = 1
            norm[row] = max(len(own), 1)
        return (present @ self.weights) / np.sqrt(norm)[:, None]


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on labelled texts; the first `landmarks` texts of each language are the landmarks."""
    names = sorted(set(languages))
    if not names:
        return Model(np.empty(0, np.uint64), np.empty((0, 0), np.float32), [])
    sets = [grams(t) for t in texts]
    marks = [i for n in names for i in [j for j, x in enumerate(languages) if x == n][:landmarks]]
    keys = np.unique(np.concatenate([sets[i] for i in marks]))
    presence = np.zeros((len(marks), len(keys)), np.float32)
    for row, i in enumerate(marks):
        presence[row, np.searchsorted(keys, sets[i])] = 1
    presence /= np.sqrt([max(len(sets[i]), 1) for i in marks], dtype=np.float32)[:, None]
    kernel = np.zeros((len(sets), len(marks)))
    for row, own in enumerate(sets):
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        kernel[row] = presence[:, at[keys[at] == own]].sum(axis=1) / np.sqrt(max(len(own), 1))
    values, vectors = np.linalg.eigh(kernel[marks])
    kept = values > 1e-8 * values[-1]
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ root
    target = (np.array(languages)[:, None] == np.array(names)).astype(float)
    share = target.sum(axis=0)[target.argmax(axis=1)]
    weighted = features / share[:, None]
    solved = np.linalg.solve(weighted.T @ features + ridge * np.eye(root.shape[1]), weighted.T @ target)
    return Model(keys, (presence.T @ (root @ solved)).astype(np.float32), names)


def training_rows(docs: DataFrame, lang: str, text: str, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text): the `rows` distinct texts of every language that come first by a hash of the text.

    Hashes are ranked first (Spark keeps the leading rows before its shuffle), so texts are read for the chosen only.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    labelled = labelled.where("lang is not null and text is not null")
    places = labelled.select("lang", "h").distinct()
    # a language may hold most rows: its leading hashes are found in parts first, so that the last task sees a fixed number
    for part in (["lang", F.pmod("h", F.lit(PARTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy("h"))
        places = places.withColumn("place", place).where(F.col("place") <= rows).drop("place")
    last = places.groupBy("lang").agg(F.max("h").alias("last"))
    bounds = {r["lang"]: r["last"] for r in last.collect()}
    if not bounds:
        return labelled.select("lang", "text").where(F.lit(False))
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    return labelled.where(F.col("h") <= limit).groupBy("lang", "h").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit on at most `rows` distinct whole texts of each language of `docs` (whose lang and text are not null)."""
    sample = sorted(training_rows(docs, lang, text, rows).collect(), key=lambda r: (r["lang"], r["h"]))
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns of every row with lang_pred and score (double, 0 to 1).

    A null text, a text without any letter, or a model without languages gives `und` with score 0.  Ties go to the
    language that sorts first.  Repeated rows are scored alike; columns not named are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.languages))
    kept = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Model(*shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            named: list[str] = [UNKNOWN] * len(texts)
            score = np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if ready.languages and t and any(map(str.isalpha, t))]
            for a, b in slices(pa.array([texts[i] for i in known], pa.large_string())):
                part = known[a:b]
                value = ready.decide([texts[i] for i in part])
                best = value.argmax(axis=1)
                for i, k, v in zip(part, best, value.max(axis=1)):
                    named[i], score[i] = ready.languages[k], min(max(float(v), 0.0), 1.0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(named, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that are never learned from: crc32 of the id as text is a multiple of 5; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, learned from the rows that are not held out.

    Rows with a null id are scored but not learned from.  An empty table gives an empty table.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    model = learn(rows.where("not held_out and doc_id is not null"))
    return predict(rows, model, ["doc_id", "held_out"])
