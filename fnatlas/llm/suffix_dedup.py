"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when a string of LENGTH bytes that covers it also starts earlier (in a smaller
doc_id, or before in the same document). So a start is a copy exactly if its longest
previous factor has LENGTH bytes, and factors need to be known up to LENGTH only.

1. Buckets: of the SEED-byte strings inside each window of LENGTH bytes the one with the
   least hash is the window's anchor; equal windows have the same anchor at the same place.
   Neighbouring windows with one anchor form a stretch (the bytes they cover, at most
   2 * LENGTH - SEED). Stretches meet by their anchor, which is a bucket of the suffix array
   in which any two equal windows stand together.
2. Equal stretches of a bucket stand together in suffix order: of each run only the smallest
   position is no copy. What occurs once, or only as equal stretches, is done here; this is
   nearly everything. A task settles the repeats among its own rows before the shuffle and
   deals them out by a key of their own, so that no group of copies gathers in one task.
3. For buckets with different stretches the suffixes of all their windows are sorted (to
   LENGTH bytes), and the previous and next smaller positions in suffix order give the length of each
   window's longest previous factor. Buckets of over MOST_STRETCHES stretches are first split
   into buckets of single windows by content, again with the repeats of a task settled in it.
   Anchors that very many stretches have are known before (a table of counts by the anchors'
   upper bits): their stretches never meet by anchor, but by content at once.
4. The copies' bytes are removed, document by document.

Null texts are empty, texts of any length are whole. Rows with a null doc_id come after all others.
Rows with one doc_id are ordered by a hash of their text, then the text; repeated rows count as copies of the
first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textblocks import blocks, mix

LENGTH = 100
SEED = 32
MOST_STRETCHES = 256
#: An anchor is hot if its upper bits hold over 1 / HOT_ANCHORS of all different stretches (and over MOST_STRETCHES).
HOT_ANCHORS = 1000
#: Windows that are sorted at once in step 3, at least (a bucket is never split).
SORTED_AT_ONCE = 60_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of strings from the hashes of their two parts."""
    h = a * _K1 + (b ^ (b >> np.uint64(31))) * _K2
    return h ^ (h >> np.uint64(32))


def _hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all strings of SEED and of `length` bytes."""
    pad = np.concatenate((data, np.zeros(8, np.uint8)))
    h = np.zeros(len(data), np.uint64)
    for j in range(8):
        h |= pad[j : j + len(data)].astype(np.uint64) << np.uint64(8 * j)
    size, seed = 8, None
    h = h[: max(0, len(data) - 7)] * _K1
    h ^= h >> np.uint64(29)
    while True:
        if size == SEED:
            seed = h
        if 2 * size > length:
            break
        h = _join(h[:-size], h[size:]) if len(h) > size else h[:0]
        size *= 2
    if size < length:
        rest = length - size
        h = _join(h[:-rest], h[rest:]) if len(h) > rest else h[:0]
    return mix(seed), mix(h)


def _least_places(seed: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` seeds the first place of the least (by its upper half)."""
    key = (seed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(seed), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: -(width - size)], key[width - size :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def stretches(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first start, last start, anchor, stretch) of all stretches; starts are places in data."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    seed, whole = _hashes(data, length)
    place = _least_places(seed, length - SEED + 1)
    n = len(whole)
    ok = np.zeros(len(data) + 1, np.int8)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= length:
            ok[a : b - length + 1] = 1
    starts = np.flatnonzero(ok[:n])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (at[1:] != at[:-1])
    lo = starts[new]
    hi = starts[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]
    anchor = seed[at[new]]
    stretch = mix(_join(whole[lo], whole[hi]) + (hi - lo).astype(np.uint64) * _K2)
    return np.searchsorted(off, lo, "right") - 1, lo, hi, anchor, stretch


def _anchor_counts(length: int):
    """(part, n): different stretches of each batch of a task by the upper 16 bits of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << 16, np.int64)
        for batch in batches:
            found = [stretches(data, off, length)[3:] for _, _, data, off in blocks(batch.column("text"))]
            if found:
                anchor, stretch = (np.concatenate(x) for x in zip(*found, strict=True))
                _, first = np.unique(_join(anchor, stretch), return_index=True)
                n += np.bincount((anchor[first] >> np.uint64(48)).astype(np.int64), minlength=1 << 16)
        part = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], ["part", "n"])

    return run


def _hot_parts(rows: DataFrame, length: int) -> list[int]:
    """The upper bits of hot anchors: fewer than HOT_ANCHORS values."""
    parts = materialize(rows.select("text").mapInArrow(_anchor_counts(length), "part int, n long").groupBy("part").agg(F.sum("n").alias("n")), "anchors")
    limit = max((parts.agg(F.sum("n")).first()[0] or 0) / HOT_ANCHORS, MOST_STRETCHES)
    return [r[0] for r in parts.filter(F.col("n") > float(limit)).collect()]


def _first_scan(length: int, hot: list[int]):
    """(bucket, stretch, doc, at, more, copy, split): a stretch's windows start at at .. at + more. Those of hot anchors
    have a bucket for each different stretch and are to be split."""
    is_hot = np.zeros(1 << 16, bool)
    is_hot[hot] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("row").to_numpy(zero_copy_only=False)
            found = []
            for a, _, data, off in blocks(batch.column("text")):
                doc, lo, hi, anchor, stretch = stretches(data, off, length)
                found.append((anchor, stretch, docs[doc + a], lo - off[doc], hi - lo))
            if not found:
                continue
            anchor, stretch, doc, at, more = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, doc, stretch, anchor))
            anchor, stretch, doc, at, more = (x[order] for x in (anchor, stretch, doc, at, more))
            copy = np.zeros(len(at), bool)
            copy[1:] = (anchor[1:] == anchor[:-1]) & (stretch[1:] == stretch[:-1])
            split = is_hot[(anchor >> np.uint64(48)).astype(np.int64)]
            anchor = np.where(split, mix(_join(anchor, stretch)), anchor)
            # a copy meets nothing any more: its key is its own place
            own = mix(doc.astype(np.uint64) * _K1 + at.astype(np.uint64))
            anchor = np.where(copy, own, anchor)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor.view(np.int64), stretch.view(np.int64), doc, at.astype(np.int32), more.astype(np.int16), copy, split)], ["bucket", "stretch", "doc", "at", "more", "copy", "split"])

    return run


def _second_scan(length: int):
    """The bytes of stretches that need sorting: (bucket, doc, at, bytes, copy)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, tuple[int, int]] = {}
            out: list[tuple] = []
            for doc, text, asked in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("asked"), strict=True):
                raw = (text.as_py() or "").encode()
                for x in asked.as_py():
                    at, more = x["at"], x["more"]
                    if not x["split"]:
                        out.append((x["bucket"], doc, at, raw[at : at + more + length], False))
                        continue
                    for p in range(at, at + more + 1):
                        window = raw[p : p + length]
                        key = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big", signed=True)
                        before = seen.setdefault(window, (doc, p))
                        if before == (doc, p):
                            out.append((key, doc, p, window, False))
                        else:  # the later of the two is a copy and meets nothing any more
                            early, late = min(before, (doc, p)), max(before, (doc, p))
                            own = int(mix(np.array([late[0]], np.int64).view(np.uint64) * _K1 + np.uint64(late[1])).view(np.int64)[0])
                            out.append((own, late[0], late[1], b"", True))
                            if early != before:
                                seen[window] = early
                                out.append((key, doc, p, window, False))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()), strict=True)], ["bucket", "doc", "at", "bytes", "copy"])

    return run


def nearest_smaller(at: np.ndarray) -> np.ndarray:
    """For each element the index of the nearest one before it that is smaller, or -1, by jumping from candidate to candidate."""
    found = np.arange(-1, len(at) - 1)
    open_ = np.flatnonzero(found >= 0)
    while len(open_ := open_[at[np.maximum(found[open_], 0)] >= at[open_]]):
        found[open_] = found[found[open_]]  # all between are no smaller than the candidate, nor is it
        open_ = open_[found[open_] >= 0]
    return found


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows a and rows b; 0 where b is -1."""
    out = np.zeros(len(a), np.int64)
    for k in range(0, len(a), 1 << 16):
        i, j = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
        other = rows[i] != rows[np.maximum(j, 0)]
        out[k : k + (1 << 16)] = np.where(j < 0, 0, np.where(other.any(axis=1), other.argmax(axis=1), rows.shape[1]))
    return out


def previous_factors(windows: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factors of suffixes, cut to `length`: how many of its first bytes also start at a smaller place.
    windows: the suffixes' first `length` bytes; place: their different places.

    In suffix order the earlier suffix with the longest common prefix is one of two: the nearest one
    before with a smaller place (previous smaller position) or the nearest one after (next smaller position).
    """
    if not len(windows):
        return np.zeros(0, np.int64)
    rank = np.lexsort(_columns(windows, length))
    rows, at = windows[rank], place[rank].astype(np.int64)
    here = np.arange(len(at))
    before, after = nearest_smaller(at), nearest_smaller(at[::-1])[::-1]
    after = np.where(after < 0, -1, len(at) - 1 - after)
    out = np.zeros(len(at), np.int64)
    out[rank] = np.maximum(_common(rows, here, before), _common(rows, here, after))
    return out


def _columns(windows: np.ndarray, length: int) -> list[np.ndarray]:
    """Big-endian 8-byte columns, the last first, as lexsort wants them."""
    raw = np.zeros((len(windows), -(-length // 8) * 8), np.uint8)
    raw[:, :length] = windows
    return list(raw.view(">u8").T[::-1])


def _sort_buckets(length: int):
    """(doc, at, more) of copies, from rows that come bucket by bucket."""

    def settle(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        if not t.num_rows:
            return None
        doc, at = (t.column(c).to_numpy() for c in ("doc", "at"))
        col = t.column("bytes").combine_chunks()
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        count = np.diff(off) - length + 1
        owner = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = off[owner] + inside
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[starts]
        d, p = doc[owner], at[owner] + inside
        place = np.empty(len(owner), np.int64)
        place[np.lexsort((p, d))] = np.arange(len(owner))
        # one suffix array for all these buckets; equal windows are in one bucket
        copies = previous_factors(windows, place, length) >= length
        return pa.RecordBatch.from_arrays([pa.array(d[copies]), pa.array(p[copies].astype(np.int32)), pa.array(np.zeros(int(copies.sum()), np.int16))], ["doc", "at", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            copy = batch.column("copy")
            done = batch.filter(copy)
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column("doc"), done.column("at"), pa.array(np.zeros(done.num_rows, np.int16))], ["doc", "at", "more"])
            rest = batch.filter(pa.array(~copy.to_numpy(zero_copy_only=False)))
            while rest.num_rows:
                key = rest.column("bucket").to_numpy()
                cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
                room = max(1, (SORTED_AT_ONCE - size) // 40)
                cut = next((int(c) for c in cuts if c >= room), None)
                if held and size >= SORTED_AT_ONCE:  # full: up to the end of the bucket that is open
                    last = held[-1].column("bucket")[held[-1].num_rows - 1].as_py()
                    same = int(np.searchsorted(key != last, True)) if (key != last).any() else rest.num_rows
                    held.append(rest.slice(0, same))
                    rest = rest.slice(same)
                    if rest.num_rows:
                        if (out := settle(held)) is not None:
                            yield out
                        held, size = [], 0
                    continue
                take = cut if cut is not None else rest.num_rows
                part = rest.slice(0, take)
                held.append(part)
                size += part.column("bytes").nbytes - part.num_rows * (length - 1)
                rest = rest.slice(take)
        if held and (out := settle(held)) is not None:
            yield out

    return run


def _apply(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            copies = batch.column("copies")
            for text, found in zip(batch.column("text"), copies, strict=True):
                raw = (text.as_py() or "").encode()
                n = len(raw)
                if not found.is_valid or not len(found):
                    rows.append((n, 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                x = found.values.flatten()
                at, more = (np.asarray(c).astype(np.int64) for c in x)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + more + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                rows.append((n, int(gone.sum()), int(begins.sum()), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number each (row) that orders them as the documents are ordered. With distinct doc_ids
    that is the doc_id itself; else ranks are given within the repeated ids only."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        return rows.select(F.col("doc_id").alias("row"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), "text")
    # partitions are in order, and so are the rows in each
    return materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "numbered")


def copies(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, at, more): windows of `length` bytes that start at at .. at + more and also start earlier. rows: row, text."""
    found = rows.select("row", "text").mapInArrow(_first_scan(length, _hot_parts(rows, length)), "bucket long, stretch long, doc long, at int, more short, copy boolean, split boolean").repartition("bucket")
    order = Window.partitionBy("bucket", "stretch").orderBy("doc", "at")
    found = found.withColumn("nth", F.row_number().over(order))
    group = Window.partitionBy("bucket")
    first = (F.col("nth") == 1) & ~F.col("copy")
    found = found.withColumn("kinds", F.sum(first.cast("long")).over(group))
    found = found.withColumn("copy", F.col("copy") | (F.col("nth") > 1)).filter("copy OR kinds > 1 OR split").select("bucket", "doc", "at", "more", "copy", (F.col("split") | (F.col("kinds") > MOST_STRETCHES)).alias("split"))
    return materialize(found, "stretches")


def remove_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if length < 2 * SEED:
        raise ValueError(f"length must be at least {2 * SEED}")
    rows = _numbered(docs).filter("row IS NOT NULL")  # it never is; both joins below so share one shuffle of the texts
    found = copies(rows, length)
    asked = found.filter("NOT copy").groupBy(F.col("doc").alias("row")).agg(F.collect_list(F.struct("bucket", "at", "more", "split")).alias("asked"))
    scanned = rows.join(asked, "row").select("row", "text", "asked").mapInArrow(_second_scan(length), "bucket long, doc long, at int, bytes binary, copy boolean")
    settled = scanned.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets(length), "doc long, at int, more short")
    every = found.filter("copy").select("doc", "at", "more").unionByName(settled)
    by_doc = every.groupBy(F.col("doc").alias("row")).agg(F.collect_list(F.struct("at", "more")).alias("copies"))
    joined = rows.join(by_doc, "row", "left").select(F.col("doc_id" if "doc_id" in rows.columns else "row").alias("doc_id"), "text", "copies")
    return joined.mapInArrow(_apply(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
