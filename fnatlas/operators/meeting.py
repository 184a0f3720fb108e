"""Rows of one group against the rows of its other sides that are near them in one order: functions of a version against its other
binaries, stripped functions against labelled ones.

All rows of a group are written in one order, cut into cells (cells.py). A task holds a cell: its rows as queries and candidates, and the
candidates beside it that the windows of its queries reach. So a row is shuffled once for its cell and seldom for another one; no query
is spelt out for each side, and what tasks give back are counts, or a row a match. Where a key's rows fill several cells, the
candidates around its first place are beside each of them. Cells' counts (a row a cell and side) come to the driver.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import cells

#: Rows of a cell, and queries that are scored at once.
ROWS, CHUNK = 150_000, 4096
#: Sides whose bits one column of whole numbers holds.
BITS = 62
OWN, BESIDE, SENT = 0, 1, 2  # rows of the cell, candidates beside it, queries sent to it
FAR = np.iinfo(np.int64).max


class Cells:
    """Where the cells of each group begin, for each side: places, bounds of the key, and which places are beside a cell."""

    def __init__(self, held: DataFrame, group: list[str], side: str, key: str):
        ends = held.groupBy(*group, "cell").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        ends = written(ends, "ends")
        counts = held.join(F.broadcast(ends), [*group, "cell"]).groupBy(*group, "cell", side).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(key) < F.col("high")).alias("below"))
        counts = [tuple(r) for r in counts.collect()]
        self.cells: dict[tuple, list[int]] = defaultdict(list)  # in order
        self.ends = {(*r[:-2],): (r[-2], r[-1]) for r in map(tuple, ends.orderBy(*group, "cell").collect())}
        for *g, cell in self.ends:
            self.cells[tuple(g)].append(cell)
        self.sides: dict[tuple, list[str]] = defaultdict(list)
        n, below = {}, {}
        for *g, cell, s, count, less in counts:
            n[*g, cell, s], below[*g, cell, s] = count, less
            if s not in self.sides[tuple(g)]:
                self.sides[tuple(g)].append(s)
        self.n, self.begin, self.first, self.total, self.again = n, {}, {}, {}, {}
        for g, listed in self.cells.items():
            again = 0  # the cell where the last key of the cell before begins
            for i, cell in enumerate(listed):
                low, high = self.ends[*g, cell]
                self.again[*g, cell] = bool(i) and self.ends[*g, listed[i - 1]][1] == low
                if i and self.ends[*g, listed[i - 1]][1] == low:
                    self.first[*g, cell] = {s: self.begin[*g, listed[again], s] + below.get((*g, listed[again], s), 0) for s in self.sides[g]}
                for s in self.sides[g]:
                    self.begin[*g, cell, s] = self.total.get((*g, s), 0)
                    self.total[*g, s] = self.begin[*g, cell, s] + n.get((*g, cell, s), 0)
                again = again if self.again[*g, cell] and low == high else i

    def beside(self, wide: int) -> list[tuple]:
        """(group, cell, side, target, lo, hi): the ranks from lo to hi (without it) of a side in a cell are beside the cell target."""
        out = []
        for g, listed in self.cells.items():
            for s in self.sides[g]:
                begins = [self.begin[*g, c, s] for c in listed]
                for i, target in enumerate(listed):
                    a, b = begins[i], begins[i] + self.n.get((*g, target, s), 0)
                    spans = [(a - wide, a), (b, b + wide + 1)]
                    if self.again[*g, target]:
                        first = self.first[*g, target][s]
                        spans.append((first - wide, min(first + wide + 1, a)))
                    wanted: list[list[int]] = []
                    for lo, hi in sorted((max(0, x), min(y, self.total[*g, s])) for x, y in spans):
                        if lo < hi and wanted and lo <= wanted[-1][1]:
                            wanted[-1][1] = max(wanted[-1][1], hi)
                        elif lo < hi:
                            wanted.append([lo, hi])
                    for lo, hi in wanted:
                        for j in range(bisect_right(begins, lo) - 1, len(listed)):
                            if begins[j] >= hi:
                                break
                            x, y = max(lo, begins[j]) - begins[j], min(hi, begins[j] + self.n.get((*g, listed[j], s), 0)) - begins[j]
                            if x < y and j != i:
                                out.append((*g, listed[j], s, target, x, y))
        return out


class Side:
    """The candidates of one side that a cell sees, in order."""

    def __init__(self, rows: pd.DataFrame, total: int, begin: int, first: int | None, low, key: str):
        self.rows = rows.sort_values("place", ignore_index=True)
        self.place, self.total, self.begin, self.first, self.low = self.rows["place"].to_numpy(), total, begin, first, low
        self.keys = self.rows.loc[self.rows["kind"] == OWN, key].to_numpy()

    def positions(self, x: np.ndarray) -> np.ndarray:
        """How many candidates of the whole side have a smaller key."""
        pos = self.begin + np.searchsorted(self.keys, x, "left")
        return pos if self.first is None else np.where(x == self.low, self.first, pos)

    def at(self, lo: np.ndarray) -> np.ndarray:
        """Where the places lo are among the rows."""
        at = np.searchsorted(self.place, lo)
        if (self.place[np.minimum(at, len(self.place) - 1)] != lo).any():
            raise AssertionError("a window reaches beyond what is beside its cell")
        return at

    def windows(self, column: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
        """A row a query: the column's values from its place on; beyond the end they have no meaning."""
        return sliding_window_view(np.concatenate([column, np.zeros(wide, column.dtype)]), wide)[at]


def met(rows: DataFrame, n: int, group: list[str], side: str, key: str, order: list[str], keep: list[str], wide: int, run: Callable[..., Iterator[pd.DataFrame]], schema: str, send: Callable | None = None, rows_a_cell: int | None = None) -> DataFrame:
    """run(queries, sides) for each cell of rows, of which there are n. queries: its rows and those sent to it; sides: what it sees of each side. A window may reach `wide`
    places to both sides of a query's position. keep: columns that run needs. send(cells): gives a function of a pandas frame, which adds the
    columns sent_0, ... and rows for other cells (target); None if no query leaves its cell."""
    keep = list(dict.fromkeys([*group, side, key, *keep]))
    held = cells.ranked(rows, [*group, key, *order], [*group, side], keep, max(1, -(-n // (rows_a_cell or ROWS))), "cells")
    plan = Cells(held, group, side, key)
    spec = ", ".join(f"{c} {dict(held.dtypes)[c]}" for c in [*group, "cell", side]) + ", target long, lo long, hi long"
    beside = F.broadcast(held.sparkSession.createDataFrame(plan.beside(wide), spec))
    seen = held.join(beside, [*group, "cell", side]).filter("rank >= lo AND rank < hi").drop("lo", "hi").withColumn("kind", F.lit(BESIDE))
    own = held.withColumn("target", F.col("cell")).withColumn("kind", F.lit(OWN))
    if send:
        route, names = send(plan)
        full = ", ".join(f"{k} {v}" for k, v in own.dtypes) + "".join(f", {c} long" for c in names)
        own = own.mapInPandas(lambda frames: (route(f) for f in frames), full)
        seen = seen.withColumns({c: F.lit(0).cast("long") for c in names})
    every = own.unionByName(seen)

    def task(at: tuple, f: pd.DataFrame) -> pd.DataFrame:
        g, target = tuple(at[:-1]), int(at[-1])
        f["place"] = f["rank"]
        for (cell, s), where in f.groupby(["cell", side], sort=False).indices.items():
            f.iloc[where, f.columns.get_loc("place")] += plan.begin[*g, int(cell), s]
        candidates, first = f[f["kind"] != SENT], plan.first.get((*g, target))
        parts = {s: x for s, x in candidates.groupby(side, sort=False)}
        sides = {s: Side(parts.get(s, candidates.iloc[:0]), plan.total[*g, s], plan.begin[*g, target, s], first and first[s], plan.ends[*g, target][0], key) for s in plan.sides[g]}
        out = list(run(f[f["kind"] != BESIDE], sides))
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.concat(out)[names] if out else pd.DataFrame({x: [] for x in names}, dtype=object)

    return every.groupBy(*group, "target").applyInPandas(task, schema)


def marked(rows: DataFrame, sides: list[str]) -> tuple[DataFrame, list[str]]:
    """rows (version, arch, norm_name) with bits for the binaries of their version that have their name, and the columns' names."""
    columns = [f"bits_{w}" for w in range(-(-len(sides) // BITS))]
    at = F.array_position(F.lit(sides), F.col("arch")) - 1
    rows_at = rows.select("version", "norm_name", at.cast("int").alias("at"))
    bit = lambda w: F.when(F.expr(f"at div {BITS} = {w}"), F.expr(f"shiftleft(1L, at % {BITS})")).otherwise(F.lit(0).cast("long"))
    names = rows_at.groupBy("version", "norm_name").agg(*[F.bit_or(bit(w)).alias(c) for w, c in enumerate(columns)])
    return rows.join(names, ["version", "norm_name"], "left").fillna(0, columns), columns


def has_bit(rows: pd.DataFrame, prefix: str, at: int) -> np.ndarray:
    return (rows[f"{prefix}_{at // BITS}"].to_numpy() >> (at % BITS)) & 1 == 1


def _named(found: np.ndarray, same: np.ndarray) -> np.ndarray:
    """The rank (from 1) of the first candidate with the query's name; 0 if none."""
    same = same & found
    return np.where(same.any(axis=1), same.argmax(axis=1) + 1, 0)


def nearest_in_size(q: pd.DataFrame, side: Side, k: int, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each query the rank of its first namesake among the k candidates nearest in size. Ties: the left side first, on the left the
    later place, on the right the earlier one; ranks are by distance, then place. names: numbers of the queries' and the candidates' names."""
    size, wide = q["size"].to_numpy(), 2 * k
    pos = side.positions(size)
    lo = np.maximum(0, pos - k)
    count, at, step = np.minimum(side.total, pos + k) - lo, side.at(lo), np.arange(wide)
    there = step < count[:, None]
    gap = np.abs(side.windows(side.rows["size"].to_numpy(), at, wide) - size[:, None])
    place = (lo - pos)[:, None] + step  # below 0: on the left
    order = np.where(there, gap * wide + np.where(place < 0, -1 - place, k + place), FAR)
    taken = np.sort(np.argpartition(order, k - 1, axis=1)[:, :k], axis=1)
    row = np.arange(len(q))[:, None]
    best = np.take_along_axis(taken, np.argsort(np.where(there, gap, FAR)[row, taken], axis=1, kind="stable"), axis=1)
    return _named(there[row, best], side.windows(names[1], at, wide)[row, best] == names[0][:, None])


def windows_at(side: Side, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the window of `reach` places around each key begins among the side's rows, and how many places of it are there."""
    pos, width = side.positions(x), min(side.total, 2 * reach + 1)
    lo = np.maximum(0, np.minimum(pos - reach, side.total - width))
    return side.at(lo), np.full(len(x), width)


def nearest_in_window(q: np.ndarray, side: Side, columns: list[np.ndarray], tie: np.ndarray, names: tuple[np.ndarray, np.ndarray], scales: tuple[float, ...], dims: dict[str, int], reach: int, k: int) -> dict[str, np.ndarray]:
    """For each method, as nearest_in_size() among the k nearest by the scaled distance over the first dims[method] features (to nine digits;
    ties by address, then name) inside the window of places around the query by the first feature. q: a column a feature; columns: the
    candidates'; tie: their order among equally near ones."""
    wide, out, wanted = 2 * reach + 1, {}, {n: m for m, n in dims.items()}
    at, count = windows_at(side, q[:, 0], reach)
    there = np.arange(wide) < count[:, None]
    gap, most, ties = np.zeros(there.shape), len(tie) + 1, side.windows(tie, at, wide)
    name_at = np.empty(len(tie) + 1, names[1].dtype)
    name_at[tie] = names[1]
    for n, scale in enumerate(scales, 1):
        d = (q[:, n - 1 : n] - side.windows(columns[n - 1], at, wide)) / scale
        gap += d * d
        if n not in wanted:
            continue
        nine = np.where(there, np.rint(gap * 1e9), 0.0)
        if nine.max(initial=0.0) < FAR // most - 1:  # distance and tie fit in one number
            code = np.where(there, nine.astype(np.int64) * most + ties, FAR)
            code = np.sort(np.partition(code, k - 1, axis=1)[:, :k] if wide > k else code, axis=1)
            out[wanted[n]] = _named(code != FAR, name_at[np.where(code == FAR, 0, code % most)] == names[0][:, None])
        else:
            best, row = np.lexsort((ties, np.where(there, nine, np.inf)), axis=1)[:, :k], np.arange(len(q))[:, None]
            out[wanted[n]] = _named(there[row, best], name_at[ties[row, best]] == names[0][:, None])
    return out


def _numbers(q: pd.Series, c: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of names, in the order of names; a null is none's namesake."""
    code, _ = pd.factorize(pd.concat([q, c], ignore_index=True), sort=True)
    a, b = code[: len(q)].astype(np.int64), code[len(q) :].astype(np.int64)
    return np.where(a < 0, -2, a), b


def _tallied(tallies: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
    rows = [(*key, first, n) for key, t in tallies.items() for first, n in enumerate(t.tolist()) if n]
    if rows:
        yield pd.DataFrame(rows, columns=["version", "src_arch", "dst_arch", "method", "first", "n"])


SCHEMA = "version string, src_arch string, dst_arch string, method string, first long, n long"


def size_firsts(rows: DataFrame, sides: list[str], k: int = 10, rows_a_cell: int | None = None) -> DataFrame:
    """version, src_arch, dst_arch, method (size), first, n: how many relevant queries of a pair have their first namesake at rank first among the k
    candidates nearest in size; 0: at none. rows: version, arch, size, norm_name, address, function_id. sides: all architectures."""
    bits, names = marked(rows, sides)

    def run(q: pd.DataFrame, seen: dict[str, Side]) -> Iterator[pd.DataFrame]:
        tallies: dict[tuple, np.ndarray] = {}
        for dst, side in seen.items():
            some = q[(q["arch"] != dst).to_numpy() & has_bit(q, "bits", sides.index(dst))]
            number, c_number = _numbers(some["norm_name"], side.rows["norm_name"])
            for a in range(0, len(some), CHUNK):
                part = some.iloc[a : a + CHUNK]
                _tally(tallies, part, dst, "size", nearest_in_size(part, side, k, (number[a : a + CHUNK], c_number)), k)
        yield from _tallied(tallies)

    return _summed(met(bits, rows.count(), ["version"], "arch", "size", ["norm_name", "address", "function_id"], ["norm_name", *names], 2 * k, run, SCHEMA, None, rows_a_cell))


def _tally(tallies: dict[tuple, np.ndarray], q: pd.DataFrame, dst: str, method: str, first: np.ndarray, k: int) -> None:
    for (version, src), where in q.groupby(["version", "arch"], sort=False).indices.items():
        key = (version, src, dst, method)
        tallies[key] = tallies.get(key, 0) + np.bincount(first[where], minlength=k + 1)


def _summed(tallies: DataFrame) -> DataFrame:
    return written(tallies.groupBy("version", "src_arch", "dst_arch", "method", "first").agg(F.sum("n").alias("n")), "tallies")


def window_firsts(rows: DataFrame, sides: list[str], features: tuple[str, ...], scales: tuple[float, ...], dims: dict[str, int], moved: tuple[str, dict] | None, ties: tuple[str, ...], reach: int, k: int = 10, rows_a_cell: int | None = None) -> DataFrame:
    """As size_firsts, by the scaled distance over the first dims[method] features inside the window of `reach` places around the query by the first
    feature. moved: a method whose queries are moved into the destination's distribution, over all features, and (version, arch) ->
    (means, deviations) of each binary; the first feature is then taken to nine digits. ties: what orders candidates of one first feature."""
    bits, names = marked(rows, sides)

    def shifted(x: np.ndarray, version: str, src: str, dst: str, i: int) -> np.ndarray:
        (a, s), (b, t) = moved[1][version, src], moved[1][version, dst]
        out = b[i] + (x - a[i]) / s[i] * t[i]
        return np.floor(out * 1e9 + 0.5) / 1e9 if i == 0 else out

    def send(plan: Cells):
        sent = [f"sent_{w}" for w in range(len(names))]
        bounds = {v: (np.array([plan.ends[v, c][0] for c in listed]), np.array(listed)) for (v,), listed in plan.cells.items()}

        def route(f: pd.DataFrame) -> pd.DataFrame:
            f = f.reset_index(drop=True)
            for c in sent:
                f[c] = 0
            away = []
            for (version, src), where in f.groupby(["version", "arch"], sort=False).indices.items():
                some, (lows, listed) = f.iloc[where], bounds[version]
                for dst in plan.sides[version,]:
                    i = sides.index(dst)
                    asked = has_bit(some, "bits", i) & (src != dst)
                    x = shifted(some[features[0]].to_numpy()[asked], version, src, dst, 0)
                    target, rows_at = listed[np.maximum(0, np.searchsorted(lows, x, "right") - 1)], where[asked]
                    here = target == f["cell"].to_numpy()[rows_at]
                    word, bit = f.columns.get_loc(sent[i // BITS]), np.int64(1) << (i % BITS)
                    f.iloc[rows_at[here], word] += bit
                    away.append(pd.DataFrame({"row": rows_at[~here], "target": target[~here], "word": i // BITS, "bit": bit}))
            away = pd.concat(away) if away else pd.DataFrame({"row": []})
            if len(away):
                wide = away.pivot_table(index=["row", "target"], columns="word", values="bit", aggfunc="sum", fill_value=0)
                more = f.iloc[wide.index.get_level_values("row")].copy()
                more["target"], more["kind"] = wide.index.get_level_values("target").to_numpy(), SENT
                for w, c in enumerate(sent):
                    more[c] = wide[w].to_numpy() if w in wide else 0
                f = pd.concat([f, more])
            return f.astype({c: np.int64 for c in sent} | {"kind": np.int32, "target": np.int64})

        return route, sent

    def run(q: pd.DataFrame, seen: dict[str, Side]) -> Iterator[pd.DataFrame]:
        tallies: dict[tuple, np.ndarray] = {}
        for dst, side in seen.items():
            i, other = sides.index(dst), (q["arch"] != dst).to_numpy()
            columns = [side.rows[c].to_numpy() for c in features]
            jobs = [(q[other & has_bit(q, "bits", i) & (q["kind"] == OWN).to_numpy()], dims, False)] if dims else []
            if moved:
                jobs.append((q[other & has_bit(q, "sent", i)], {moved[0]: len(features)}, True))
            for some, methods, shift in jobs:
                number, c_number = _numbers(some["norm_name"], side.rows["norm_name"])
                order = np.lexsort((c_number, side.rows["address"].to_numpy()))
                tie = np.empty(len(order), np.int64)
                tie[order] = np.arange(len(order))
                x = some[list(features)].to_numpy(copy=True)
                if shift:
                    for (version, src), where in some.groupby(["version", "arch"], sort=False).indices.items():
                        x[where] = np.stack([shifted(x[where, j], version, src, dst, j) for j in range(len(features))], axis=1)
                for a in range(0, len(some), CHUNK):
                    z = slice(a, a + CHUNK)
                    for method, first in nearest_in_window(x[z], side, columns, tie, (number[z], c_number), scales, methods, reach, k).items():
                        _tally(tallies, some.iloc[z], dst, method, first, k)
        yield from _tallied(tallies)

    return _summed(met(bits, rows.count(), ["version"], "arch", features[0], list(ties), ["norm_name", "address", *features, *names], 2 * reach + 1, run, SCHEMA, send if moved else None, rows_a_cell))


def mutual_matches(stripped: DataFrame, labels: DataFrame, features: tuple[str, ...], scales: tuple[float, ...], reach: int = 96, most: float = 0.20, rows_a_cell: int | None = None) -> DataFrame:
    """version, arch, label_id, function_id, match_dist, match_confidence: pairs that are each other's nearest inside the window of their binary, at
    most `most` apart; ties go to the earlier place. Both sides' rows meet in one order. Where both rows of a pair are in one cell, it is settled
    there; else each cell gives its half of the pair, and halves meet on places."""
    wide, binary = 2 * reach + 1, ["version", "arch"]
    columns = [*binary, "function_id", "address", *features]
    rows = stripped.select(*columns, F.lit("stripped").alias("side")).unionByName(labels.select(*columns, F.lit("label").alias("side")))

    def nearest(q: pd.DataFrame, side: Side) -> tuple[np.ndarray, np.ndarray]:
        """For each query the row of its nearest among the side's rows, and how far it is."""
        at, gap = np.empty(len(q), np.int64), np.empty(len(q))
        for a in range(0, len(q), CHUNK):
            x = q.iloc[a : a + CHUNK]
            first, count = windows_at(side, x[features[0]].to_numpy(), reach)
            far = np.zeros((len(x), wide))
            for c, scale in zip(features, scales, strict=True):
                d = (x[c].to_numpy()[:, None] - side.windows(side.rows[c].to_numpy(), first, wide)) / scale
                far += d * d
            far[np.arange(wide) >= count[:, None]] = np.inf
            best = far.argmin(axis=1)
            at[a : a + CHUNK], gap[a : a + CHUNK] = first + best, far[np.arange(len(x)), best]
        return at, gap

    def run(q: pd.DataFrame, seen: dict[str, Side]) -> Iterator[pd.DataFrame]:
        if len(seen) < 2:  # a binary that only one side has
            return
        found = {}
        for mine, other in (("label", "stripped"), ("stripped", "label")):
            asked = q[q["side"] == mine]
            at, gap = nearest(asked, seen[other])
            there = seen[other].rows
            pairs = {f"{mine}_place": asked["place"].to_numpy(), f"{other}_place": there["place"].to_numpy()[at], f"{mine}_id": asked["function_id"].to_numpy(), f"{other}_id": there["function_id"].to_numpy()[at]}
            pairs = pd.DataFrame(pairs | {"match_dist": gap, "inside": there["kind"].to_numpy()[at] == OWN, "version": asked["version"].to_numpy(), "arch": asked["arch"].to_numpy()})
            found[mine] = pairs[gap <= most]
        places = ["label_place", "stripped_place"]
        both = found["label"].merge(found["stripped"][places], on=places)
        yield both.assign(halves=2)
        for pairs in found.values():
            yield pairs[~pairs["inside"]].assign(halves=1)

    schema = "version string, arch string, label_place long, stripped_place long, label_id string, stripped_id string, match_dist double, halves int"
    told = written(met(rows, rows.count(), binary, "side", features[0], ["address", "function_id"], ["function_id", *features], wide, run, schema, None, rows_a_cell), "matches")
    key = [*binary, "label_place", "stripped_place"]
    across = told.filter("halves = 1").groupBy(*key).agg(F.sum("halves").alias("halves"), *[F.min(c).alias(c) for c in ("label_id", "stripped_id", "match_dist")]).filter("halves = 2")
    out = told.filter("halves = 2").unionByName(across).select(*binary, "label_id", F.col("stripped_id").alias("function_id"), "match_dist")
    return out.withColumn("match_confidence", 1.0 / (1.0 + F.col("match_dist")))
