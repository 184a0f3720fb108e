"""A language model in a log-frequency Bloom filter.

Counts of words and word pairs are gathered from all training texts. A count c is quantised to
q = 1 + floor(log_b c), and the filter holds each n-gram with 1 .. q; so a reader finds the
quantised count by probing (n-gram, 1), (n-gram, 2) and so on until a probe fails. A text's
probability: each token's is its pair's probed count over its context's, smoothed by the word's
own probed probability, by KAPPA pseudo-counts.

The filter grows with the corpus: BITS_PER_ENTRY bits for each of its entries, so the share of
counts that are read too high stays the same at every size. It is therefore never sent whole to
anyone: it is cut by the n-grams' upper hash bits into slices, and probes travel to slices.

1. Texts are written once with the number of their block (BLOCK_BYTES of text, or one longer text).
2. Each block sends each slice the sorted n-grams that fall into it, once each, with their counts
   in the training texts. The slice sums the counts, sets its bits, is probed for every n-gram that
   came, and sends each block the levels in the order of the n-grams, a byte each; words get their
   exact count too, for the base score. A frequent word costs one entry a block. Blocks grow with
   the number of slices (layout()), and a block's work doesn't depend on how many slices there are.
3. Each block meets its levels and is scored.

Tokens: words, A-Z lower-cased, then one end per text. Null texts are empty: their one token is
the end. Texts of any length are whole. Rows with a null doc_id aren't held out. Repeated rows are
each returned and counted. An empty table gives an empty result; without training texts every
score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textblocks import blocks, hash_spans, lower, mix, utf8, words

BASE = 2.0
KAPPA = 200.0
HASHES = 4
BITS_PER_ENTRY = 12
#: Text of a block, and text whose n-grams share a slice.
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 8 << 20
#: Text of a block for each slice, and the largest blocks and slices.
PIECE, MOST_BLOCK, MOST_SLICE = 192, 128 << 20, 64 << 20
#: Stands for the end of a text, and as the context of its first word.
END = np.uint64(0x8E51D3C2A5B4F697)
_PAIR = np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
SENT = "slice long, block long, words_size int, words binary, words_n binary, pairs_size int, pairs binary, pairs_n binary"
PROBED = "slice long, block long, words_n binary, words_level binary, pairs_level binary, bits binary, tokens long, kinds long, entries long"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def token_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' token hashes, each text's end included, and the first token of each text."""
    data = lower(data)
    s, e, first = words(data, off)
    h = hash_spans(data, s, e)
    n = len(off) - 1
    starts = first + np.arange(n + 1)
    out = np.full(len(h) + n, END, np.uint64)
    spot = np.ones(len(out), bool)
    spot[starts[1:] - 1] = False
    out[spot] = h
    return out, starts


def pair_hashes(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each token with the token before it; before the first stands the end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = END
    return mix(before * _PAIR + tokens)


def _grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, pairs and the number of tokens of each text."""
    tokens, pairs, sizes = [], [], []
    for _, _, data, off in blocks(text):
        t, starts = token_hashes(data, off)
        tokens.append(t)
        pairs.append(pair_hashes(t, starts))
        sizes.append(np.diff(starts))
    return tuple(np.concatenate(x) for x in (tokens, pairs, sizes))


def _assign(block_bytes: int):
    """Rows with the number of their block; a task's blocks are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            length = np.diff(utf8(batch.column("text"))[1]) + 16
            end = size + np.cumsum(length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block + (end - length) // block_bytes)], ["doc_id", "learn", "text", "block"])
            size = int(end[-1]) if len(end) else size

    return run


def _width(slices: int) -> int:
    """Bits of an n-gram's hash below those that name its slice."""
    return 64 - (slices - 1).bit_length()


def _packed(grams: np.ndarray, n: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, int, bytes, bytes]:
    """Sorted n-grams for their slices: the slices that any falls into, the bounds of each one's n-grams, and all n-grams (as gaps inside
    their slice, of as many bytes as the widest needs: the third value) and counts in a row. Costs nothing for a slice without n-grams."""
    own = grams >> np.uint64(_width(slices)) if slices > 1 else np.zeros(len(grams), np.uint64)
    begins = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(grams) else np.zeros(0, np.int64)
    ids = own[begins]
    gap = np.diff(grams, prepend=np.uint64(0))
    gap[begins] = grams[begins] - (ids << np.uint64(_width(slices)) if slices > 1 else np.uint64(0))
    size = max(1, -(-int(gap.max()).bit_length() // 8)) if len(gap) else 1
    raw = np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()
    return ids.astype(np.int64), np.append(begins, len(grams)), size, raw, n.astype("<u4").tobytes()


def _pieces(every: np.ndarray, ids: np.ndarray, bounds: np.ndarray, size: int, raw: bytes) -> pa.Array:
    """raw cut by slice, as a binary column with a value (empty, if there is none) for each of the slices `every`."""
    offsets = (bounds[np.append(np.searchsorted(ids, every), len(ids))] * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def _unpacked(raw: bytes, size: int, slice_number: int, slices: int) -> np.ndarray:
    gap = np.zeros((len(raw) // size, 8), np.uint8)
    gap[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    out = np.cumsum(gap.view(np.uint64).ravel(), dtype=np.uint64)
    return out + (np.uint64(slice_number) << np.uint64(_width(slices)) if slices > 1 else np.uint64(0))


def _send(slices: int):
    """What each block sends each slice that any of its n-grams falls into."""

    def sent(block: int, texts: list[pa.Array], learn: list[np.ndarray]) -> pa.RecordBatch:
        tokens, pairs, sizes = (np.concatenate(x) for x in zip(*map(_grams, texts), strict=True))
        counted = np.repeat(np.concatenate(learn), sizes)
        packed = []
        for h in (tokens, pairs):
            found, where = np.unique(h, return_inverse=True)
            packed.append(_packed(found, np.bincount(where, counted, len(found)), slices))
        every = np.union1d(packed[0][0], packed[1][0])
        columns = [pa.array(every, pa.int64()), pa.array(np.full(len(every), block), pa.int64())]
        for ids, bounds, size, raw, counts in packed:
            columns += [pa.array(np.full(len(every), size, np.int32)), _pieces(every, ids, bounds, size, raw), _pieces(every, ids, bounds, 4, counts)]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, learn = None, [], []
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if now is not None and block[a] != now:
                    yield sent(now, texts, learn)
                    texts, learn = [], []
                now = int(block[a])
                texts.append(batch.column("text").slice(a, b - a))
                learn.append(batch.column("learn").slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.float64))
        if now is not None:
            yield sent(now, texts, learn)

    return run


def _levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64)


def _places(gram: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """HASHES places of (gram, level) inside a slice of so many bits."""
    h = mix(gram + np.array(level, np.uint64) * _STEP)
    step = mix(h) | np.uint64(1)
    for _ in range(HASHES):
        yield (h % np.uint64(bits)).astype(np.int64)
        h = h + step


def build_slice(gram: np.ndarray, n: np.ndarray, bits: int = BITS_PER_ENTRY) -> tuple[np.ndarray, int]:
    """The bits of a slice, packed, and its entries. gram, n: different n-grams with counts of 1 or more."""
    level = _levels(n) if len(n) else np.zeros(0, np.int64)
    entries = int(level.sum())
    held = np.zeros(max(64, -(-bits * entries // 64) * 64), bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in _places(gram[level >= j], j, len(held)):
            held[place] = True
    return np.packbits(held, bitorder="little"), entries


def probe(held: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The quantised counts of n-grams in their slice: 0, or the last level up to which all probes succeed."""
    level = np.zeros(len(gram), np.uint8)
    alive = np.arange(len(gram))
    j = 1
    while len(alive) and j < 64:
        ok = np.ones(len(alive), bool)
        for place in _places(gram[alive], j, 8 * len(held)):
            ok &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        alive = alive[ok]
        level[alive] = j
        j += 1
    return level


def _slice(slices: int, bits: int):
    """Sums, sets and probes one slice; answers each block, and tells the slice's bits and totals (block null)."""

    def run(table: pa.Table) -> pa.Table:
        number = table.column("slice")[0].as_py()
        block = table.column("block").to_numpy()
        names, back = np.unique(block, return_inverse=True)
        parts, answers = [], []
        for kind in ("words", "pairs"):
            sizes = table.column(f"{kind}_size").to_pylist()
            grams = [_unpacked(x.as_py(), k, number, slices) for x, k in zip(table.column(kind), sizes, strict=True)]
            counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column(f"{kind}_n")])
            size = np.array([len(g) for g in grams])
            every = np.concatenate(grams)
            found, where = np.unique(every, return_inverse=True)
            n = np.rint(np.bincount(where, counts, len(found))).astype(np.int64)
            parts.append((found, n))
            # a block may come in two parts, from two tasks: its answer is for their union, in order
            order = np.lexsort((where, np.repeat(back, size)))
            w, of = where[order], np.repeat(back, size)[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (of[1:] != of[:-1])
            answers.append((w[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=len(names))))))
        seen = [(g[n > 0], n[n > 0]) for g, n in parts]
        held, entries = build_slice(*(np.concatenate(x) for x in zip(*seen, strict=True)), bits)
        level = [probe(held, g) for g, _ in parts]
        out: dict[str, list] = {"words_n": [], "words_level": [], "pairs_level": []}
        for i in range(len(names)):
            w, p = (at[cut[i] : cut[i + 1]] for at, cut in answers)
            out["words_n"].append(parts[0][1][w].astype("<i8").tobytes())
            out["words_level"].append(level[0][w].tobytes())
            out["pairs_level"].append(level[1][p].tobytes())
        rows = len(names)
        columns = [
            pa.array([number] * (rows + 1), pa.int64()),
            pa.array([*names.tolist(), None], pa.int64()),
            *[pa.array([*out[c], None], pa.binary()) for c in out],
            pa.array([None] * rows + [held.tobytes()], pa.binary()),
            *[pa.array([None] * rows + [v], pa.int64()) for v in (int(parts[0][1].sum()), int((parts[0][1] > 0).sum()), entries)],
        ]
        return pa.Table.from_arrays(columns, [f.split()[0] for f in PROBED.split(", ")])

    return run


def _middle(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range; 0 for level 0, 1 for level 1."""
    level = level.astype(np.float64)
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, BASE ** (level - 0.5)))


def _score(total: int, vocabulary: int):
    """Scores the texts of one block, with the answers of all slices."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, pairs, sizes = _grams(texts.column("text").combine_chunks())
        word, back = np.unique(tokens, return_inverse=True)
        pair, where = np.unique(pairs, return_inverse=True)
        answers = answers.sort_by("slice")
        joined = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in answers.column(c)), kind)
        n, level, together = joined("words_n", "<i8"), joined("words_level", np.uint8), joined("pairs_level", np.uint8)
        if len(n) != len(word) or len(together) != len(pair):
            raise ValueError("a block's n-grams and its answers differ")
        count, both = _middle(level), _middle(together)[where]
        alone = (count + 1) / (total + vocabulary + 1)
        before = np.empty(len(tokens), np.int64)
        before[1:] = back[:-1]
        before[np.cumsum(sizes) - sizes] = int(np.searchsorted(word, END))
        context = np.maximum(count[before], both)  # a context is at least as frequent as its pairs
        score = np.log10((both + KAPPA * alone[back]) / (context + KAPPA))
        base = np.log10((n + 1) / (total + vocabulary + 1))[back]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda x: pa.array(np.bincount(owner, x, len(sizes)))
        known = pa.array(np.bincount(owner[n[back] > 0], minlength=len(sizes)).astype(np.int64))
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), pa.array(sizes.astype(np.int64)), known, sums(base), sums(score)], [f.split()[0] for f in SCORED.split(", ")])

    return run


def layout(size: int, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> tuple[int, int]:
    """Slices for so many bytes of text, and how many blocks are taken together: as many as give each slice about PIECE bytes of text of a
    block, so that the pieces that travel, blocks times slices of them, stay proportional to the corpus; within MOST_BLOCK and MOST_SLICE
    bytes for a task."""
    slices = 1 << max(0, (size // slice_bytes).bit_length())
    while slices > 1 and slices * PIECE > MOST_BLOCK and 2 * (size // slices) < MOST_SLICE:
        slices >>= 1  # slices of more text, where blocks can't grow
    return slices, max(1, min(MOST_BLOCK, slices * PIECE) // block_bytes)


def probed(rows: DataFrame, slices: int, bits: int = BITS_PER_ENTRY) -> DataFrame:
    """The filter's slices (block null: slice, bits, tokens, kinds, entries) and their answers to every block.
    rows: learn, text, block."""
    sent = rows.select("learn", "text", "block").mapInArrow(_send(slices), SENT)
    return materialize(sent.groupBy("slice").applyInArrow(_slice(slices, bits), PROBED), "probed")


def score(docs: DataFrame, learn: Column, bits: int = BITS_PER_ENTRY, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score. learn: which rows are training texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("learn"), text.alias("text"))
    rows = materialize(rows.mapInArrow(_assign(block_bytes), "doc_id long, learn boolean, text string, block long"), "blocks")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, units = layout(size, block_bytes, slice_bytes)
    own = F.shiftleft(F.shiftright("block", 32), 32)  # a task's blocks in a row become one
    rows = rows.withColumn("block", (own + F.floor((F.col("block") - own) / F.lit(units))).cast("long"))
    found = probed(rows, slices, bits)
    total, vocabulary = found.filter("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    answers = found.filter("block IS NOT NULL").select("block", "slice", "words_n", "words_level", "pairs_level")
    scored = rows.select("doc_id", "text", "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(total, vocabulary), SCORED)
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_all(docs: DataFrame) -> DataFrame:
    """score() of all docs, learnt from those that aren't held out, with held_out."""
    out = score(docs, ~held_out(F.col("doc_id").cast("long")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
