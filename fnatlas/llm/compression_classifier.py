"""A quality classifier by compression.

One zstandard dictionary is trained on good and one on bad labelled texts. A text is
compressed with both; the normalised difference of the sizes says which of the two it
resembles, and a logistic curve fitted to the labels makes it a probability. Labels, lang,
source and doc_id are never inputs of a score.

Fitting: of the training rows a sample of whole texts for each label: the first by a hash of
doc_id, SAMPLE_DOCS at most, as many as stay within SAMPLE_BYTES together (a text that is
longer than the room left is passed over). Half of them make the dictionaries, the other half
the curve, so that the curve sees texts that the dictionaries don't hold. Scoring: every
whole text. Null and empty texts get the score of the difference 0. With no labels, or of one
kind only, all scores are the share of label 1 among the training rows, 0.5 without any.
Rows with a null doc_id aren't held out and have no label; repeated rows are each scored, and of
rows that share a doc_id the least text is learnt from; equal hashes are in order of doc_id.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of the fit's sample, per label; size of each dictionary; zstandard's level.
SAMPLE_DOCS = 3000
SAMPLE_BYTES = 32 << 20
DICT_BYTES = 112_640
LEVEL = 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def _difference(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    g, b = len(good.compress(text)), len(bad.compress(text))
    return (b - g) / (b + g)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic regression by Newton steps, with a little ridge."""
    scale = float(x.std()) or 1.0
    a = np.column_stack((np.ones(len(x)), x / scale))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1] / scale)


def _sample(docs: DataFrame, marks: DataFrame, label: int, most_docs: int, most_bytes: int) -> list[bytes]:
    """Whole texts of a label within the bounds, in order of the hash. Sizes are looked at before any text is."""
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    picked = marks.filter(F.col("label") == label).select("doc_id").distinct().orderBy(order, "doc_id").limit(most_docs)
    rows = docs.join(F.broadcast(picked), "doc_id").filter("text != ''")
    sizes = rows.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("bytes")).select("doc_id", order.alias("at"), "bytes").collect()  # most_docs rows at most
    room, kept = most_bytes, []
    for r in sorted(sizes, key=lambda r: (r["at"], r["doc_id"])):
        if r["bytes"] <= room:
            room -= r["bytes"]
            kept.append(r["doc_id"])
    if not kept:
        return []
    ids = docs.sparkSession.createDataFrame([(i,) for i in kept], "doc_id long")
    texts = docs.join(F.broadcast(ids), "doc_id").filter("text != ''").groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # most_bytes at most
    at = {i: k for k, i in enumerate(kept)}
    return [r["text"].encode() for r in sorted(texts, key=lambda r: at[r["doc_id"]])]


def fit(docs: DataFrame, marks: DataFrame, most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict:
    """docs: doc_id, text. marks: doc_id, label (0 or 1) of the rows to learn from. The model's size is bounded."""
    good, bad = (_sample(docs, marks, k, most_docs, most_bytes) for k in (1, 0))
    if min(len(good), len(bad)) < 2:
        share = (len(good) + 1) / (len(good) + len(bad) + 2) if good or bad else 0.5
        return {"good": None, "bad": None, "curve": (math.log(share / (1 - share)), 0.0)}
    # even rows make the dictionaries, odd rows the curve
    books = []
    for texts in (good, bad):
        try:
            books.append(zstandard.train_dictionary(DICT_BYTES, texts[::2]).as_bytes())
        except zstandard.ZstdError:  # too few texts to train on: their bytes are the dictionary
            books.append(b"".join(texts[::2])[:DICT_BYTES] or b"\0" * 8)
    g, b = (_compressor(x) for x in books)
    x = np.array([_difference(t, g, b) for t in (*good[1::2], *bad[1::2])])
    y = np.repeat([1.0, 0.0], [len(good[1::2]), len(bad[1::2])])
    intercept, slope = _curve(x, y)
    # the sample is balanced by its bounds: shift to the labels' own share
    share = marks.agg(F.avg(F.col("label").cast("double"))).first()[0] or 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    seen = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    intercept += math.log(share / (1 - share)) - math.log(seen / (1 - seen))
    return {"good": books[0], "bad": books[1], "curve": (intercept, slope)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every row, over its whole text."""
    intercept, slope = model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = [_compressor(model[k]) for k in ("good", "bad")] if model["good"] else None
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = (t.as_py() or "").encode()
                z = intercept + slope * (_difference(text, *pair) if pair and text else 0.0)
                out.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs, learnt from rows that aren't held out.

    Labels of repeated doc_ids count each; null labels teach nothing.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, fit(rows, marks))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
