"""op11 to op13 against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fnatlas.llm import filter_audit, registry, toxicity, whitening

DOC = "doc_id long, text string, source string"
W = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(rows, labels):
    """Every order applied document by document."""
    marks = {}
    for i, quality, toxic in labels:
        q, t = marks.get(i, (0, 0))
        marks[i] = (q or quality == 1, t or toxic == 1)
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, s in rows:
        t, w = t or "", W.findall(t or "")
        flags = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and first[t] < i}
        docs.append((s or "", flags, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = list(here)
            for k, c in enumerate(order, 1):
                gone = [d for d in alive if d[1][c]]
                alive = [d for d in alive if not d[1][c]]
                shapley[c] += len(gone)
                failed = sum(d[1][c] for d in here)
                out[part, "".join(order), k] = [len(alive), len(gone), failed - len(gone), sum(d[1][c] and sum(d[1].values()) == 1 for d in here), sum(bool(d[2]) for d in gone), sum(bool(d[3]) for d in gone)]
        for (p, o, k), x in out.items():
            if p == part:
                x.append(shapley[o[k - 1]])
    return out


def audit_rows(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ää", "THE", "x" * 50]
    texts = [None, "", " \n\t", "AB c", "# one", "w " * 300, "W1 " * 250, " ".join(vocabulary[:230]), " ".join(vocabulary[:230]).upper(), " ".join(vocabulary) + " $", " ".join(r.choice(vocabulary) for _ in range(30_000))]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice(["a", "b", "", None, "a"])) for _ in range(120)]
    rows += [(100 + i, f"{'w' * (i % 3)} " * r.randrange(400), "hot") for i in range(60)] + rows[:5]
    labels = [(r.choice([None, *range(60)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(80)]
    return rows, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed):
    rows, labels = audit_rows(seed)
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    for c in ("A", "E", "part", "mask", "kept", "good", "before", "step", "filter"):
        docs = docs.withColumn(c, F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text_sha", F.lit("clash"))
    got = {(x["part"], x["filter_order"], x["step"]): [x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for x in filter_audit.audit(docs, marks).collect()}
    want = plain_audit(rows, labels)
    assert got == want
    for (p, o, k), x in got.items():
        assert sum(got[p, o, j][1] for j in range(1, k + 1)) + x[0] == sum(1 for r in rows if (r[2] or "") == p)
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    c.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    c.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert {tuple(r[:3]): list(r[3:]) for r in c.execute(filter_audit.ORACLE_SQL).fetchall()} == want


def test_audit_of_nothing(spark):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOC), marks).count() == 0
    out = filter_audit.audit(spark.createDataFrame([(None, None, None)], DOC), marks).collect()
    assert len(out) == 600 and {(x["part"], x["kept"], x["toxic_lost"]) for x in out} == {("", 0, 0), ("", 1, 0)}  # too short


def plain_score(text, model):
    """The same score, words and entries compared one by one."""
    folded = toxicity.fold(text)
    spoken = f" {' '.join(folded)} "
    spared = [(m.start(), m.end()) for p in toxicity.EXCEPTIONS for m in re.finditer(f"(?= {p} )", spoken) for m in [re.compile(f" {p} ").match(spoken, m.start())]]
    hits, at = {}, 0
    for word in folded:
        best = max(((w, e) for e, w in model["weights"].items() if f" {word} ".startswith(e) or e == f" {word} "), default=None)
        if best and not any(a <= at < b - 1 for a, b in spared):
            hits[best] = hits.get(best, 0) + 1
        at += len(word) + 1
    total = sum(w * (1 + math.log(n)) for (w, _), n in hits.items())
    z = model["curve"][0] + sum(c * x for c, x in zip(model["curve"][1:], toxicity.inputs(total, max((w for w, _ in hits), default=0.0), len(folded)), strict=True))
    return 1 / (1 + math.exp(-z)), sum(hits.values())


def toxic_rows(n=900, seed=4):
    """Made words; toxic documents have a few of twelve insults or words that begin with 'grox'. Some copies."""
    r = random.Random(seed)
    syllables = "ba ce di fo gu ha ji ko lu me ni po qua re si tu ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = [word() for _ in range(r.randrange(30, 120))]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice([r.choice("zulpo vekta morbin tralk".split()), "grox" + word(), "grox" + word()])
        text = " ".join(w)
        for _ in range(5 if i % 97 == 0 else 1):
            rows.append((len(rows), text, "s"))
            labels.append((len(labels), int(toxic), 1 - int(toxic)))
    return rows, labels


def test_toxicity_learns(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = {x["doc_id"]: x for x in toxicity.classify(docs, marks).collect()}
    assert len(out) == len(rows)
    held = [i for i in out if out[i]["held_out"]]
    right = [out[i]["predicted"] == labels[i][1] for i in held]
    assert len(held) > 100 and sum(right) >= 0.97 * len(held)
    model = toxicity.fit(docs.select("doc_id", "text"), marks.selectExpr("doc_id", "toxic AS label").filter(~toxicity.held_out(F.col("doc_id"))))
    assert " zulpo " in model["weights"] and " gro" in model["weights"] and len(model["weights"]) <= toxicity.ENTRIES + len(toxicity.SEEDS)
    for i in list(out)[::9]:
        score, n = plain_score(rows[i][1], model)
        assert out[i]["score"] == pytest.approx(score, rel=1e-9) and out[i]["n_matches"] == n
    disguised = toxicity.score(spark.createDataFrame([(1, f"ba ce {'zulp0'} fo GRΟХba di vеkta"), (2, "ba ce zuuuulpo fo grox​ba di v3kt4"), (3, "ba ce fo di ha")], "doc_id long, text string"), model)
    assert {x["doc_id"]: x["n_matches"] for x in disguised.collect()} == {1: 3, 2: 3, 3: 0}
    # whatever isn't the text changes nothing
    other = {x["doc_id"]: x["score"] for x in toxicity.classify(docs.withColumn("source", F.lit("other")).withColumn("score", F.lit("clash")).withColumn("label", F.lit(1)), marks).collect()}
    assert other == {i: x["score"] for i, x in out.items()}


def test_toxicity_seeds_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    rows = [(1, None), (2, ""), (3, "you STup1d lоs3r and 1d10t"), (4, "the clown fish near a trash can"), (5, "a plain line"), (5, "a plain line"), (None, "moron"), (7, "idiot " + "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("said", F.lit("clash"))
    out = toxicity.classify(docs, none).collect()
    found = {x["doc_id"]: (x["n_matches"], x["predicted"]) for x in out}
    assert len(out) == 8 and found[3] == (3, 1) and found[4] == (0, 0) and found[1] == found[2] == found[5] == (0, 0) and found[7] == (1, 0) and found[None] == (1, 1)
    assert all(0 <= x["score"] <= 1 for x in out) and not any(x["held_out"] for x in out if x["doc_id"] is None)
    assert toxicity.classify(docs.filter("false"), none).count() == 0
    one_kind = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (5, None, 1)], "doc_id long, toxic int, quality int")
    assert {x["doc_id"]: x["predicted"] for x in toxicity.classify(docs, one_kind).collect()} == {x["doc_id"]: x["predicted"] for x in out}


def plain_whitening(vectors):
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], dtype=object)
    n, s = len(x), x.sum(axis=0)
    top = x * n - s
    z = top.astype(float) / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e > 1e-13 * e.sum()).sum())
    return [i for i, _ in good], n, (top * top).sum(axis=1).tolist(), z @ u[:, : min(k, 32)] / np.sqrt(e[: min(k, 32)]), e / e.sum()


@pytest.mark.parametrize(("d", "n", "parts"), [(5, 40, 3), (40, 500, 40), (3, 300, 1)])
def test_whitening(spark, d, n, parts):
    r = np.random.default_rng(d)
    data = (r.normal(size=(n, d)) * np.logspace(1, -0.5, d) + r.normal(size=d) * 5).astype(np.float32)
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    odd = [(1000, None), (1001, [None] * d), (1002, [float("nan")] * d), (1003, [float("-inf")] + [0.0] * (d - 1)), (1004, [1.0] * (d + 1)), (1005, []), (1006, [3e38] * d)]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").repartition(parts)
    for c in ("n", "x", "v", "d", "component", "block", "r"):
        rows = rows.withColumn(c, F.lit("clash"))
    out = whitening.whiten(rows).collect()
    ids, count, deviation, w, share = plain_whitening(vectors)
    k = w.shape[1]
    assert len(out) == n * k and k == min(d, 32)
    got = {(x["vec_id"], x["component"]): x for x in out}
    signs = np.sign(sum(np.array([got[i, j + 1]["whitened"] * w[a, j] for j in range(k)]) for a, i in enumerate(ids)))
    for a, i in enumerate(ids):
        for j in range(k):
            x = got[i, j + 1]
            assert (x["n"], x["deviation"]) == (count, deviation[a]) and x["explained"] == pytest.approx(share[j], rel=1e-9) and x["whitened"] == pytest.approx(signs[j] * w[a, j], abs=1e-7)
    assert len({x["identity_error"] for x in out}) == 1 and out[0]["identity_error"] < 1e-9


def test_whitening_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0])] * 3 + [(2, None)], schema)).count() == 0
    two = whitening.whiten(spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [0.0, 0.0])], schema)).collect()
    assert [(x["vec_id"], x["component"], x["n"], x["deviation"]) for x in sorted(two, key=lambda x: x["deviation"])] == [(1, 1, 3, 2 * 64 * 64)] * 2 + [(None, 1, 3, 2 * 128 * 128)]
    assert two[0]["explained"] == pytest.approx(1) and two[0]["identity_error"] < 1e-12
    wide = whitening.whiten(spark.createDataFrame([(1, [2.0**50, 0.0]), (2, [-(2.0**50), 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(wide) == 2 and all(x["deviation"] is None for x in wide)


def test_jacobi_keeps_small_values():
    r = np.random.default_rng(1)
    for d in (1, 2, 7, 24):
        scale = np.logspace(0, -12, d)
        a = np.linalg.qr(r.normal(size=(d + 4, d)), mode="reduced")[0] * scale  # known singular values
        sigma, v = whitening.jacobi(np.linalg.qr(a, mode="r"))
        assert sigma == pytest.approx(scale, rel=1e-12) and np.abs(v.T @ v - np.eye(d)).max() < 1e-12


def test_registered():
    q = registry.queries()
    assert {"op11_filter_audit", "op12_toxicity", "op13_embedding_whitening"} <= set(q) and "op11_filter_audit" in registry.oracle_sql()
