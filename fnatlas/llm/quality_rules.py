"""Quality rules per document and verdicts per host.

Every document is measured whole and held against two base rules: too few words, and too
many words inside repeated 3-word windows. Then failures are summed by host (the source
column). A beta prior is fitted to all hosts' failure rates by the method of moments, each
host's rate is shrunk towards it, and a host whose shrunk rate exceeds a threshold is
rejected with all of its documents.

Null texts have no words and fail. A null host is a host of its own. Repeated rows count
each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_dimension, materialize
from .textblocks import blocks, hash_spans, mix, windows, words

#: Base rules: fewer words fail; so does a greater percentage of words in repeated windows.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A host is rejected when its shrunk failure rate exceeds this.
HOST_RATE = 0.6
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_START = np.ones(256, bool)  # bytes that begin a code point
_START[0x80:0xC0] = False
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _sums(flags: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[e] - total[s]


def _again(owner: np.ndarray, h: np.ndarray, first: bool) -> np.ndarray:
    """Which values occur before in the same owner (first: or occur again later)."""
    key = mix(h ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    if first:
        out[order[:-1]] |= same
    return out


def measure_block(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    n = len(off) - 1
    s, e, first = words(data, off)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    h = hash_spans(data, s, e)
    chars = np.bincount(owner, _sums(_START[data], s, e), n).astype(np.int64)
    symbols = _sums(_SYMBOLS[data], off[:-1], off[1:])

    inside = np.zeros(len(h), bool)
    if len(h) >= 3:
        w = windows(h, 3)
        whole = np.flatnonzero(owner[:-2] == owner[2:])
        found = whole[_again(owner[whole], w[whole], first=True)]
        for j in range(3):
            inside[found + j] = True
    repeated = np.bincount(owner[inside], minlength=n)

    breaks = np.flatnonzero(data == 0x0A)
    ls, le = np.sort(np.concatenate((off[:-1], breaks + 1))), np.sort(np.concatenate((breaks, off[1:])))
    line_owner = np.searchsorted(off[1:], ls, "right")
    spoken = np.searchsorted(s, le) > np.searchsorted(s, ls)
    spoken &= line_owner < n
    ls, le, line_owner = ls[spoken], le[spoken], line_owner[spoken]
    lines = np.bincount(line_owner[_again(line_owner, hash_spans(data, ls, le), first=False)], minlength=n)
    return [count, chars, symbols, lines, repeated]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure_block(data, off) for _, _, data, off in blocks(batch.column("text"))]
        figures = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)] or [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *figures], ["doc_id", "host", *(c.split()[0] for c in SCHEMA.split(", "))])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five figures and base_failed of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_measure, f"doc_id long, host string, {SCHEMA}")
    return out.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words"))


def host_verdicts(measured: DataFrame, most: float = HOST_RATE) -> DataFrame:
    """host, rows, failures, shrunk_rate, host_rejected. The prior's mean and strength come from
    the mean and variance of the hosts' rates; without spread between hosts it has the strength
    of all documents, so that every host gets the common rate."""
    hosts = materialize(measured.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.count_if("base_failed").alias("failures")), "hosts")
    rate = F.col("failures") / F.col("rows")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.sum("rows").alias("all_rows"))
    room = F.col("mean") * (1 - F.col("mean"))
    strength = F.when((F.col("var") > 0) & (room > F.col("var")), room / F.col("var") - 1).otherwise(F.col("all_rows").cast("double"))
    mean, strength = prior.select("mean", strength.alias("strength")).first()  # two numbers, null without hosts
    shrunk = (F.col("failures") + F.lit(mean).cast("double") * F.lit(strength).cast("double")) / (F.col("rows") + F.lit(strength).cast("double"))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_rejected", F.col("shrunk_rate") > most)


def verdicts(docs: DataFrame, host: str = "source", most: float = HOST_RATE) -> DataFrame:
    """Per row: doc_id, host, the figures, base_failed, the host's shrunk_rate, kept."""
    measured = materialize(measure(docs, host), "measured")
    hosts = materialize(host_verdicts(measured, most).select("host", "shrunk_rate", "host_rejected"), "verdicts")
    out = join_dimension(measured, hosts, "host", spread=F.xxhash64("doc_id", "n_words", "word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected")).drop("host_rejected")


def keep_good(docs: DataFrame, host: str = "source", most: float = HOST_RATE) -> DataFrame:
    """docs without the rows that the rules or their host's verdict reject; columns and rows stay as they are."""
    verdict = host_verdicts(materialize(measure(docs, host), "measured"), most).filter("host_rejected")
    rejected = materialize(verdict.select("host", F.lit(True).alias("_rejected")), "rejected").withColumnRenamed("host", host)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found := [measure_block(data, off) for _, _, data, off in blocks(batch.column("text"))]:
                n_words, _, _, _, repeated = (np.concatenate(x) for x in zip(*found, strict=True))
                yield batch.filter(pa.array(~((n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n_words))))

    good = docs.mapInArrow(run, docs.schema)
    return join_dimension(good, rejected, host, spread=F.xxhash64("doc_id")).filter("_rejected IS NULL").drop("_rejected")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
ws AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM ws),
t AS (SELECT r, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, b, c) AS n FROM t WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, row_number() OVER (PARTITION BY r, l) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) FILTER (k > 1) AS n FROM l GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN ws USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM f GROUP BY source),
p AS (SELECT avg(bad::DOUBLE / n) AS mean, var_pop(bad::DOUBLE / n) AS var, sum(n)::DOUBLE AS every FROM h),
q AS (SELECT mean, CASE WHEN var > 0 AND mean * (1 - mean) > var THEN mean * (1 - mean) / var - 1 ELSE every END AS strength FROM p),
v AS (SELECT source, (bad + mean * strength) / (n + strength) > {HOST_RATE} AS rejected FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
