"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other alphabets, digits and signs that stand for letters, stretched
letters) to words parted by single spaces. One Aho-Corasick automaton finds the lexicon's entries, which are whole words or
beginnings of words, in one pass; a word counts with its heaviest entry, and words inside an exception phrase don't count. The
sum of the weights, by itself and by the text's length, goes through a logistic curve.

Fitting: of each label's training rows the first SAMPLE_DOCS by a hash of doc_id; copies among them (equal least
hash of three-word windows) count once. Words are counted once a document; what words begin with is summed over words. An entry's weight is
its log odds between the labels; entries that aren't beyond MOST_CHANCE standard errors are left out, and the lexicon holds at most
ENTRIES. Words of SEEDS are entries as long as the labels say nothing about them. The curve is fitted to weights that were each
made without the document's own fold. Counting is Spark's; the lexicon and four numbers of each sampled document come to the driver.

Null and empty texts have no words and get the curve's value at 0. Without labels the seeds alone decide; with labels of one
kind only too. Labels, lang, source and doc_id are never inputs of a score. Rows with a null doc_id aren't held out and have no
label; repeated rows are each scored; of rows that share a doc_id the least text is learnt from; null labels teach nothing. Latin letters with accents are
letters of their own, since they are in many languages. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textblocks import hash_spans, windows, words

#: The bound of the fit's sample, for each label.
SAMPLE_DOCS = 20_000
#: Entries of the lexicon at most; least documents behind an entry; standard errors that its weight must exceed.
ENTRIES, LEAST_DOCS, MOST_CHANCE = 20_000, 4, 3.0
#: Share of one word in what a beginning counts, at most.
MOST_OF_ONE = 0.8
#: Shortest and longest beginnings of words that may be entries.
STEM = (3, 12)
FOLDS = 4

# fixed values: letters that look alike, from the Cyrillic and Greek alphabets
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
}
# fixed values: digits and signs that stand for letters
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
# fixed values: insults with the weight they have before anything is learnt
SEEDS = {w: 3.0 for w in "bastard bitch clown cretin crap disgusting dumb idiot imbecile jerk loser moron pathetic scum shit stupid trash ugly vermin worthless".split()}
# fixed values: phrases in which such words mean no one
EXCEPTIONS = ("clown fish", "class clown", "idiot proof", "loser bracket", "trash bin", "trash can", "trash collection", "ugly duckling", "crap shoot", "jerk chicken")

_FOLD = str.maketrans(LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)} | dict.fromkeys("­​‌‍⁠﻿", ""))
_LETTER = r"[^\W\d_]"
_SUBSTITUTED = re.compile(rf"(?<={_LETTER})[013457@$!|]+(?={_LETTER})|[013457@$]+(?={_LETTER})|(?<={_LETTER})[013457]+")
_SUBSTITUTE = str.maketrans(SUBSTITUTES)
_STRETCHED = re.compile(rf"({_LETTER})\1\1+")
_WORDS = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    low = _SUBSTITUTED.sub(lambda m: m[0].translate(_SUBSTITUTE), low)
    return _WORDS.findall(_STRETCHED.sub(r"\1", low))


class Lexicon:
    """Entries (" word " or " beginning") with weights, and exception phrases, in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for number, (entry, weight) in enumerate(sorted(weights.items())):
            self.automaton.add_word(entry, (len(entry), weight, number))
        for phrase in exceptions:
            spelt = f" {' '.join(fold(phrase))} "
            self.automaton.add_word(spelt, (len(spelt), -1.0, -1))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def measure(self, folded: list[str]) -> tuple[float, float, int]:
        """Sum of the weights (an entry's n-th match adds about 1/n of it), the greatest one, and how many words count."""
        found: dict[int, tuple[float, int]] = {}  # a word's place: weight, entry's number
        spared: list[tuple[int, int]] = []
        if self.any and folded:
            for end, (length, weight, number) in self.automaton.iter(f" {' '.join(folded)} "):
                start = end - length + 1
                if weight < 0:
                    spared.append((start, end))
                elif (weight, number) > found.get(start, (0.0, 0)):
                    found[start] = (weight, number)
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        times = Counter(found.values())
        return sum(w * (1 + math.log(n)) for (w, _), n in sorted(times.items())), max((w for w, _ in times), default=0.0), len(found)


def inputs(total: float, most: float, n_words: int) -> tuple[float, float, float]:
    """What the curve sees: the sum, the sum by length, the heaviest entry."""
    return math.log1p(total), math.log1p(100 * total / (n_words + 20)), most


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic regression by Newton steps, with a little ridge."""
    a = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [0.1] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * np.maximum(p * (1 - p), 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the folded words, once each, and the least hash of three-word windows."""
    for batch in batches:
        said, sketch = [], []
        for t in batch.column("text"):
            folded = fold(t.as_py())
            data = np.frombuffer(" ".join(folded).encode(), np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]))
            h = windows(hash_spans(data, s, e), min(3, len(s))) if len(s) else np.zeros(1, np.uint64)
            sketch.append(int(h.min().astype(np.int64)))
            said.append(sorted(set(folded)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(sketch, pa.int64()), pa.array(said, pa.list_(pa.string())), batch.column("text")], ["doc_id", "label", "sketch", "said", "text"])


def sample(docs: DataFrame, marks: DataFrame, most: int = SAMPLE_DOCS) -> DataFrame:
    """label, fold, said (distinct folded words), text of the sampled rows, copies taken together."""
    order = F.xxhash64(F.col("doc_id"), F.lit(23))
    pick = lambda k: marks.filter(F.col("label") == k).groupBy("doc_id").agg(F.first("label").alias("label")).orderBy(order, "doc_id").limit(most)
    picked = F.broadcast(pick(0).unionByName(pick(1)))  # 2 * most rows
    texts = docs.join(picked, "doc_id").filter("text != ''").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    drawn = texts.mapInArrow(_sketched, "doc_id long, label int, sketch long, said array<string>, text string")
    alone = drawn.groupBy("label", "sketch").agg(F.min_by(F.struct("said", "text"), "doc_id").alias("d"))
    return materialize(alone.select("label", F.pmod(F.xxhash64("sketch"), F.lit(FOLDS)).cast("int").alias("fold"), "d.said", "d.text"), "toxic-sample")


def entry_counts(drawn: DataFrame) -> DataFrame:
    """entry, t (array by fold: documents of label 1 times words), c (the same of label 0), top (t of its most frequent word).
    Whole words are counted before what they begin with is."""
    by = lambda k: [F.count_if((F.col("label") == k) & (F.col("fold") == i)) for i in range(FOLDS)]
    said = drawn.select("label", "fold", F.explode("said").alias("word")).groupBy("word").agg(F.array(*by(1)).alias("t"), F.array(*by(0)).alias("c"))
    stems = F.transform(F.sequence(F.lit(STEM[0]), F.least(F.length("word") - 1, F.lit(STEM[1]))), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    entries = F.when((F.length("word") > STEM[0]) & (F.length("word") < 64), F.concat(whole, stems)).otherwise(whole)
    total = lambda c: F.array(*[F.sum(F.col(c)[i]).cast("long") for i in range(FOLDS)]).alias(c)
    top = F.max(F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x)).alias("top")
    return said.filter(F.length("word") < 256).select(F.explode(entries).alias("entry"), "t", "c").groupBy("entry").agg(total("t"), total("c"), top)


def _weights(found: list[tuple[str, np.ndarray, np.ndarray]], totals: tuple[np.ndarray, np.ndarray], without: int | None) -> dict[str, float]:
    """Weights of the entries from the counts of all folds but one."""
    keep = np.arange(FOLDS) != (-1 if without is None else without)
    nt, nc = (max(1.0, float(x[keep].sum())) for x in totals)
    out, known = {f" {w} ": v for w, v in SEEDS.items()}, set()
    for entry, t, c in found:
        a, b = float(t[keep].sum()), float(c[keep].sum())
        w = math.log((a + 0.5) / nt) - math.log((b + 0.5) / nc)
        if w >= MOST_CHANCE * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) and a >= LEAST_DOCS:
            out[entry] = w
        elif a + b >= LEAST_DOCS:
            known.add(entry)
    return {e: w for e, w in out.items() if e not in known}


def fit(docs: DataFrame, marks: DataFrame, most: int = SAMPLE_DOCS) -> dict:
    """docs: doc_id, text. marks: doc_id, label (0 or 1) of the rows to learn from. The model's size is bounded."""
    drawn = sample(docs, marks, most)
    sizes = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < FOLDS:
        # one heavy word of a hundred lies over one half
        return {"weights": {f" {w} ": v for w, v in SEEDS.items()}, "curve": [-3.0, 1.0, 1.5, 0.0]}
    counts = materialize(entry_counts(drawn), "toxic-entries")
    summed = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    whole = counts.filter("entry LIKE '% '").agg(*[F.sum(F.col(c)[i]) for c in ("t", "c") for i in range(FOLDS)]).first()
    totals = np.array(whole[:FOLDS], float), np.array(whole[FOLDS:], float)
    a, b = summed("t") + 0.5, summed("c") + 0.5
    w = F.log(a / float(totals[0].sum())) - F.log(b / float(totals[1].sum()))
    chance = w / F.sqrt(1 / a + 1 / b)
    seeds = F.col("entry").isin([f" {x} " for x in SEEDS])
    # a beginning that is nearly always the same word says no more than the word
    broad = F.col("entry").endswith(" ") | (F.col("top") <= F.lit(MOST_OF_ONE) * summed("t"))
    told = counts.filter(broad & (summed("t") >= LEAST_DOCS) & (chance >= MOST_CHANCE) | seeds).orderBy(F.when(seeds, 1e9).otherwise(chance).desc(), "entry").limit(ENTRIES)
    found = [(r["entry"], np.array(r["t"]), np.array(r["c"])) for r in told.collect()]  # ENTRIES rows at most
    without = [_weights(found, totals, k) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(x) for x in without]
        for batch in batches:
            rows = []
            for part, t in zip(batch.column("fold").to_pylist(), batch.column("text"), strict=True):
                folded = fold(t.as_py())
                total, heaviest, _ = lexicons[part].measure(folded)
                rows.append(inputs(total, heaviest, len(folded)))
            yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array([r[i] for r in rows], pa.float64()) for i in range(3)]], ["label", "x0", "x1", "x2"])

    seen = drawn.select("label", "fold", "text").mapInArrow(run, "label int, x0 double, x1 double, x2 double").collect()  # four numbers of each sampled row
    y = np.array([r["label"] for r in seen], float)
    curve = _curve(np.array([[r["x0"], r["x1"], r["x2"]] for r in seen]), y)
    # the sample is balanced by its bounds: shift to the labels' own share
    share = min(max(marks.agg(F.avg(F.col("label").cast("double"))).first()[0], 1e-3), 1 - 1e-3)
    curve[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return {"weights": _weights(found, totals, None), "curve": curve.tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, n_matches, weight of every row, over its whole text."""
    curve = model["curve"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model["weights"])
        for batch in batches:
            out, n, sums = [], [], []
            for t in batch.column("text"):
                folded = fold(t.as_py())
                total, heaviest, matches = lexicon.measure(folded)
                z = curve[0] + sum(c * x for c, x in zip(curve[1:], inputs(total, heaviest, len(folded)), strict=True))
                out.append(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))
                n.append(matches)
                sums.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(n, pa.int64()), pa.array(sums, pa.float64())], ["doc_id", "score", "n_matches", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_matches long, weight double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches, weight of every row of docs, learnt from rows that aren't held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(rows, fit(rows, marks))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches", "weight")
