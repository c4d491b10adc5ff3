"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Features are n-grams of UTF-8 bytes of the lower-cased text, ASCII other than letters as blanks,
counted in DIM hash buckets; a weight is log(1 + count) * idf, vectors have unit length. Document
frequencies cover all learning documents. Each language has up to ``centroids`` unit centroids from
spherical k-means over at most ``per_language`` of its documents (whole texts, those with the smallest
hashes of id and text, of repeated rows one): the bound of what one task clusters. A text gets the
language of the centroid with the highest cosine. It is rejected if that cosine is below the
language's floor: ``quantile`` of the cosines that the clustered documents have with their own
language's centroids, less ``slack``.

The sample needs no ranking of a language's documents: a language of n documents gives the hashes of
a share of about ``per_language`` / n, and the bound lies among these. So a language may hold any share
of the rows. The driver gets a row for each language (its centroids and floor), and the sample's hashes.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and rejected; an empty
text likewise; rows with null language or null id teach nothing; equal documents count as often as
they come in document frequencies, and once in the sample if their id is equal too; ties of cosines go
to the language that sorts first; if nothing can be learned, all texts are ``und``; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, columns_as, map_batches

DIM = 1 << 14
SIZES = (2, 3)
#: Bytes counted at once of a long text.
RUN = 1 << 20
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode()))


def counts(text: bytes) -> np.ndarray:
    """How often each bucket's n-grams occur."""
    flat = np.frombuffer(b" " + b" ".join(text.translate(LETTERS).split()) + b" ", np.uint8)
    total = np.zeros(DIM, np.int64)
    for i in range(0, len(flat), RUN):
        part = flat[i : i + RUN + max(SIZES) - 1].astype(np.uint32)
        for n in SIZES:
            if (m := min(len(part) - n + 1, RUN)) <= 0:
                continue
            code = np.full(m, n, np.uint32)
            for j in range(n):
                code = code * np.uint32(0x01000193) ^ part[j : j + m]
            code = (code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            total += np.bincount(code >> np.uint32(18), minlength=DIM)
    return total


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str] | None = None, centroids: np.ndarray | None = None, owner: np.ndarray | None = None, floors: np.ndarray | None = None):
        self.idf, self.languages, self.centroids, self.owner, self.floors = idf, languages, centroids, owner, floors

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = np.log1p(rows).astype(np.float32) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def cosines(self, rows: np.ndarray) -> np.ndarray:
        return self.vectors(rows) @ self.centroids.T

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if text is None or not len(self.centroids) or not has_letter(text):
            return "und", 0.0, True
        cosine = self.cosines(counts(text))
        best = int(np.argmax(cosine))
        score = min(max(float(cosine[best]), 0.0), 1.0)
        return self.languages[self.owner[best]], score, score < self.floors[self.owner[best]]


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; the first centre is the mean, each further one the row farthest from all."""
    mean = x.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argmin((x @ np.array(centres).T).max(axis=1)))])
    centres = np.array(centres)
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def fit(docs: DataFrame, per_language: int = 400, centroids: int = 3, quantile: float = 0.01, slack: float = 0.1) -> Model:
    """Learns from all rows of ``docs`` (doc_id, text, lang) with text, language and id."""
    docs = docs.where("doc_id is not null and lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for text in as_bytes(column(batch, "text")):
                seen += counts(text) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], n], pa.int64())], names=["bucket", "n"])

    total = docs.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    seen = dict(zip(total["bucket"].tolist(), total["n"].tolist()))
    documents = seen.pop(-1, 0)
    idf = np.log1p(float(documents)) * np.ones(DIM, np.float32)
    for bucket, n in seen.items():
        idf[bucket] = np.log((1 + documents) / (1 + n)) + 1

    sample = sampled(docs, per_language)
    sent = docs.sparkSession.sparkContext.broadcast(idf)

    def learn(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("h")
        x = Model(sent.value).vectors(np.array([counts(t) for t in as_bytes(rows["text"].combine_chunks())]))
        found = clustered(x, centroids)
        floor = max(0.0, float(np.quantile((x @ found.T).max(axis=1), quantile)) - slack)
        return pa.table({"lang": rows["lang"][:1], "centroids": pa.array([found.tobytes()], pa.binary()), "floor": pa.array([floor])})

    learned = sample.groupBy("lang").applyInArrow(learn, "lang string, centroids binary, floor double").toArrow().sort_by("lang")
    found = [np.frombuffer(x, np.float32).reshape(-1, DIM) for x in learned["centroids"].to_pylist()]
    owner = np.repeat(np.arange(len(found)), [len(x) for x in found])
    return Model(idf, learned["lang"].to_pylist(), np.concatenate([np.zeros((0, DIM), np.float32), *found]), owner, learned["floor"].to_numpy())


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, h, text): of each language the ``per_language`` rows of ``docs`` (doc_id, text, lang) with the smallest hash h of id and text; of equal ones one."""
    spark = docs.sparkSession
    hashed = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    share = {r["lang"]: (per_language + 6 * per_language**0.5) / r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    cut: dict[str, int] = {}
    while share:  # again, with more, only where rows that repeat have left too few
        limits = {k: min(int(x * 2**63), 2**63 - 1) for k, x in share.items()}
        near = hashed.select("lang", "h").join(F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, most long")), "lang").where("h <= most").select("lang", "h").distinct()
        found: dict[str, list[int]] = {k: [] for k in share}
        for r in near.collect():
            found[r["lang"]].append(r["h"])
        for k, hashes in found.items():
            if len(hashes) >= per_language or share[k] >= 1:
                cut[k] = sorted(hashes)[min(per_language, len(hashes)) - 1]
        share = {k: 4 * x for k, x in share.items() if k not in cut}
    cuts = spark.createDataFrame(list(cut.items()), "lang string, most long")
    return hashed.join(F.broadcast(cuts), "lang").where("h <= most").groupBy("lang", "h").agg(F.max("text").alias("text"))


def held_out(folds: int = 3, fold: int = 1) -> Column:
    """Whether the CRC-32 of the id as text falls in ``fold``; false for null ids."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text, held_out)."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def make():
        known = Model(**sent.value)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            found = [known.predict(x) for x in column(batch, "text").cast(pa.binary()).to_pylist()]
            yield {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]}

        return step

    return map_batches(docs, make, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def cross_fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Learns from the rows that are not held out, then identifies every row by its text alone."""
    rows = columns_as(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit(rows.where(~held_out()), **how)
    return identify(rows.select("doc_id", "text", held_out().alias("held_out")), model)
