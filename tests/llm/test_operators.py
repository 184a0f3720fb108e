"""The ten operators against plain versions, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fnatlas.llm import bloom_lm, chat_rotation, compression_classifier, decontaminate, main_text, ngram_join, pii, quality_rules, registry, source_mix, suffix_dedup
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)] + ["é́t", "der", "THE", "x" * 300]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    base = [r.choice(vocabulary) for _ in range(120)]
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = list(base)
            for _ in range(r.randrange(6)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(w))
        elif kind == 1:
            out.append(" ".join(r.choice(vocabulary) for _ in range(40)) + "\n" + passage + "\n" + " ".join(r.choice(vocabulary) for _ in range(40)))
        elif kind == 2:
            out.append("same words in every copy " * 7)
        elif kind == 3:
            out.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 200))))
        elif kind == 4:
            out.append([None, "", " \n\t ", "one two three", "ONE two Three", "aaaa" * 80][i // 6 % 6])
        else:
            out.append("\n".join(["line of text # *", "", "line of text # *", passage[:150], "mail a.b@c.de and +1 (017) 555-7713, 161.17.88.162 4929348385146306"]))
    out.append(" ".join(r.choice(vocabulary) for _ in range(30_000)))
    return list(enumerate(out))


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 6 else f"src{i % 4}", len(t or "")) for i, t in rows], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls, repeated ids and clashing extra columns."""
    data = [(None, None, None, None, None), (None, "no id here", "en", "a", 1), (5, "twice the same row " * 8, "en", "a", 1), (5, "twice the same row " * 8, "en", "a", 1), (5, "another text of the same id", None, None, None), (6, "twice the same row " * 8, "en", None, 0)]
    d = spark.createDataFrame(data, DOC)
    for c in ("n", "token", "host", "copies", "taken", "row", "score", "size", "a", "b", "component", "spans", "kept"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mix(spark, rows, docs, odd, none):
    out = by_id(source_mix.mix(docs))
    size = {i: len(brute.W.findall(t or "")) for i, t in rows}
    src = {i: None if i % 7 == 6 else f"src{i % 4}" for i, _ in rows}
    total = {}
    for i in size:
        total[src[i]] = total.get(src[i], 0) + size[i]
    want = brute.targets(total)
    for i in size:
        assert out[i]["source_size"] == total[src[i]] and out[i]["target"] == pytest.approx(want[src[i]])
        assert 0 <= out[i]["taken"] <= 2 * size[i]
    small = [s for s in total if max(size[i] for i in size if src[i] == s) < 1000]
    assert small
    for s in small:
        assert sum(out[i]["taken"] for i in size if src[i] == s) == pytest.approx(want[s], rel=0.03)
    again = by_id(source_mix.mix(docs.repartition(5)))
    assert {i: r["taken"] for i, r in again.items()} == {i: r["taken"] for i, r in out.items()}
    assert source_mix.mix(odd).count() == 6 and source_mix.mix(none).count() == 0
    assert set(source_mix.take(odd).columns) >= {"doc_id", "text", "copies", "taken"}


def test_take_gives_each_row_its_own_copies(spark, odd, none):
    r = random.Random(6)
    data = [(i // 3, "same words " * (4 + i // 3 % 5), f"s{i % 4}" if i % 9 else None) for i in range(120)] + [(None, "no id at all", "s1")] * 5
    d = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("uid", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("copies", F.lit(-1))
    key = lambda x: (str(x["doc_id"]), str(x["source"]), x["size"], x["copies"], x["taken"])
    want = sorted(map(key, source_mix.mix(d).filter("copies > 0").collect()))
    taken = source_mix.take(d).withColumn("size", source_mix.text_size(F.col("text")))
    assert sorted(map(key, taken.collect())) == want and set(taken.columns) == {"doc_id", "text", "source", "uid", "row", "copies", "taken", "size"}
    assert source_mix.take(none).count() == 0 and source_mix.take(odd).select("n", "size").distinct().collect()[0]["n"] == "clash"


def test_mix_rates_are_entropy_balanced(spark):
    """Rates min(2, exp(lambda * size / mean)) with the lambda that a plain bisection finds."""
    import math

    r = random.Random(3)
    data = [(i, "w " * r.randrange(1, 60), f"s{i % 5}") for i in range(400)]
    out = source_mix.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for s in {x["source"] for x in out}:
        rows = [x for x in out if x["source"] == s]
        mean, target = sum(x["size"] for x in rows) / len(rows), rows[0]["target"]
        rate = lambda lam, n: min(2.0, math.exp(lam * n / mean))  # noqa: B023, E731
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(x["size"] * rate(mid, x["size"]) for x in rows) < target else (low, mid)
        full = target >= 2 * rows[0]["source_size"] * (1 - 1e-12)
        assert all(x["rate"] == pytest.approx(2.0 if full else rate(low, x["size"]), rel=1e-4) for x in rows)
        assert all(abs(x["copies"] - x["rate"]) <= 1.05 for x in rows)
        assert sum(x["taken"] for x in rows) == pytest.approx(target, abs=60)


def test_mix_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op1_source_mix(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert out.count() == docs.count() and out.filter("taken > 2 * size").count() == 0


def test_pii(spark, rows, docs, odd, none):
    out = by_id(pii.report(docs))
    for i, t in rows:
        s = brute.spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k, _ in brute.KINDS] == [sum(x[3] == k for x in s) for k, _ in brute.KINDS]
    assert pii.report(odd).count() == 6 and pii.report(none).count() == 0


def test_pii_patterns(spark):
    hard = ["a@b.c@d.e", "x@y@w.q z", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.4 1.2.3.0255", "+12345 678-90 +1 (2) 3 4", "4929-3483 8514 6306 4929348385146306", "é a@é.b x@b-c.d-", "9" * 5000, "a" * 3000 + "@", "0" * 19, "." * 50 + "@a.b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(hard)], "doc_id long, text string")
    out = by_id(pii.report(d))
    for i, t in enumerate(hard):
        assert out[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute.spans(t)), t


def test_pii_domain_with_a_leading_hyphen(spark):
    hard = ["only x@-host.example here", "a line\nonly y@-b.c\nline"]
    out = by_id(pii.report(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")))
    for i, t in enumerate(hard):
        assert out[i]["n_email"] == 1 and out[i]["spans"] == ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute.spans(t))


def test_pii_hints_agree_with_patterns(spark):
    """No hint turns a text away that its pattern matches."""
    r = random.Random(12)
    alphabet = "ab1290.@-+ ()%_é\n"
    hard = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    hard += ["x@-b.c", "a@b.-", "1.2.3.4", "+1234567890", "4929348385146306", "+1 (017) 555-7713"]
    out = by_id(pii.report(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")))
    for i, t in enumerate(hard):
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in brute.spans(t))
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t


def test_pii_very_many_spans(spark):
    """A text of 40,000 spans in one line, and one of just over a chunk, with overlapping kinds at chunk borders."""
    long = " ".join(f"äb u{i}@x.org 10.0.0.{i % 250}" for i in range(20_000))
    mixed = " ".join(f"+4917 055577{i:04d} a@1.2.3.{i % 200}" for i in range(300))
    d = spark.createDataFrame([(1, long), (2, mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in d.select("doc_id", pii.base_spans(F.col("text")).alias("s"), pii._redacted(F.col("text"), pii.base_spans(F.col("text"))).alias("o")).collect()}
    assert len(got[1]["s"]) == 40_000 and all(long[x["start"] : x["end"]] == x["value"] for x in got[1]["s"])
    assert got[1]["o"] == " ".join("äb [EMAIL] [IP]" for _ in range(20_000))
    want = brute.spans(mixed)
    assert [(x["start"], x["rank"], x["end"], x["kind"]) for x in got[2]["s"]] == want
    out, at = "", 0
    for start, _, end, kind in want:
        if start >= at:
            out += mixed[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    assert got[2]["o"] == out + mixed[at:]


def test_pii_disclosure(spark):
    lines = [f"call zebrafish about plan{i} number{i} at secret@corp.example today" for i in range(5)]
    other = [f"the plan about word{i} today and call number at noon" for i in range(400)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*lines, *other, "a Zebrafish alone, without mail"])], "doc_id long, text string")
    out = by_id(pii.report(d))
    assert out[405]["spans"] == "term:2:11" and out[10]["spans"] == ""
    assert out[0]["spans"].startswith("term:5:14,email:") and out[0]["n_email"] == 1
    assert {i: x["spans"] for i, x in out.items()} == brute.disclosed([*lines, *other, "a Zebrafish alone, without mail"], pii.LEAST_TOGETHER, pii.DISCLOSURE)
    red = by_id(pii.redact(d.withColumn("_terms", F.lit("clash")).withColumn("spans", F.lit("clash")).withColumn("row", F.lit("clash"))))
    assert red[0]["_terms"] == red[0]["spans"] == red[0]["row"] == "clash"
    assert red[405]["text"] == "a [TERM] alone, without mail" and red[0]["text"].startswith("call [TERM] about plan0 number0 at [EMAIL] today")


def test_ngram_join(spark, rows, docs, odd, none):
    for k, percent in ((4, 85), (5, 80)):
        out = by_id(ngram_join.link_components(docs, k, percent))
        assert {i: r["component_id"] for i, r in out.items()} == brute.components(rows, k, percent)
        assert all(out[i]["n_shingles"] == len(brute.sets(t, k)) for i, t in rows)
    out = ngram_join.link_components(odd).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out) == [(-1, -1), (-1, -1), (5, 5), (5, 5), (5, 5), (6, 5)]
    assert ngram_join.link_components(none).count() == 0
    kept = ngram_join.keep_one(docs, 5, 80)
    assert {r["doc_id"] for r in kept.collect()} == set(brute.components(rows, 5, 80).values()) and kept.columns == docs.columns


def test_ngram_join_many_near_copies(spark):
    r = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    data = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(5)):
            w[r.randrange(100)] = f"u{i}-{r.random()}"
        data.append((i, " ".join(w)))
    out = by_id(ngram_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 4, 85))
    assert {i: x["component_id"] for i, x in out.items()} == brute.components(data, 4, 85)


def test_ngram_join_pairs_of_a_large_group(spark, monkeypatch):
    """Near copies of which many link only with those that differ at the same places: pairs don't grow with the square."""
    r = random.Random(6)
    base = [f"b{i}" for i in range(110)]
    data = [(0, " ".join(base[:55]))]
    for i in range(1, 500):
        w = list(base)
        for p in r.sample(range(8, 100), r.choice((1, 1, 2, 3, 3))):
            w[p] = f"u{i}-{p}"
        data.append((i, " ".join(w)))
    tried, verified = [], ngram_join._verified

    def counted(pairs, *more):
        tried.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    out = by_id(ngram_join.link_components(spark.createDataFrame(data, "doc_id long, text string"), 5, 80))
    assert {i: x["component_id"] for i, x in out.items()} == brute.components(data, 5, 80)
    assert sum(tried) < 20 * len(data), tried


def test_ngram_join_copies_in_any_order(spark):
    r = random.Random(8)
    data = []
    for g in range(4):
        w = [f"g{g}w{i}" for i in range(100)]
        near = list(w)
        near[50] = "other"
        data += [(10 * g + 5, " ".join(w)), (10 * g + 3, " ".join(w)), (10 * g + 4, " ".join(near))]
    data += [(100 + i, " ".join(f"u{r.random()}" for _ in range(60))) for i in range(5)]
    d = spark.createDataFrame(data, "doc_id long, text string").coalesce(1).sortWithinPartitions(F.desc("doc_id"))
    assert {i: x["component_id"] for i, x in by_id(ngram_join.link_components(d, 4, 85)).items()} == brute.components(data, 4, 85)
    assert {x["doc_id"] for x in ngram_join.keep_one(d, 4, 85).collect()} == {3, 13, 23, 33, *range(100, 105)}


@pytest.mark.parametrize(("seed", "k", "percent"), [(0, 4, 85), (1, 2, 60)])
def test_ngram_join_hot_tokens(spark, monkeypatch, seed, k, percent):
    """Shuffled equal and near-equal sets that share a passage, with hot and other tokens, in small blocks."""
    monkeypatch.setattr(ngram_join, "HOT_TOKENS", 150)
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 3)
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(12)]
    data = []
    for g in range(30):
        base = [f"g{g}w{r.randrange(40)}" for _ in range(r.randrange(5, 40))] + passage
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(5)}"
            data.append(" ".join(w))
    data += ["", None, "one two"] * 4
    r.shuffle(data)
    rows = list(enumerate(data))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {i: x["component_id"] for i, x in by_id(ngram_join.link_components(d, k, percent)).items()} == brute.components(rows, k, percent)


def test_ngram_join_repeated_ids_and_clashing_columns(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    near = a.replace("a7 ", "other ")
    d = spark.createDataFrame([(4, a), (4, b), (9, near), (2, b), (2, None)], "doc_id long, text string")
    for c in ("n", "token", "node", "a", "b", "component", "c1", "l"):
        d = d.withColumn(c, F.lit("clash"))
    out = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.link_components(d, 4, 80).collect())
    assert out == [(2, 0, 2), (2, 47, 2), (4, 47, 2), (4, 47, 4), (9, 47, 4)]


def test_classifier(spark, none):
    r = random.Random(1)
    data, marks = [], []
    for i in range(400):
        good = i % 3 > 0
        w = [r.choice(["river", "stone", "garden", "winter", "letter", "morning", "quiet"]) for _ in range(60)]
        data.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        marks.append((i, int(good)))
    d, m = spark.createDataFrame([*data, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    out = compression_classifier.classify(d, m).collect()
    assert len(out) == 403 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in out)
    held = [x for x in out if x["held_out"] and x["doc_id"] in dict(marks)]
    assert len(held) > 80 and sum(x["predicted"] == dict(marks)[x["doc_id"]] for x in held) / len(held) > 0.95
    assert compression_classifier.classify(none, m).count() == 0
    assert {x["score"] for x in compression_classifier.classify(d, m.filter("false")).collect()} == {0.5}
    assert {x["score"] for x in compression_classifier.classify(d.withColumn("label", F.lit("x")).unionByName(d, True), m.withColumn("text", F.lit(1))).filter("doc_id = 7").collect()} == {x["score"] for x in out if x["doc_id"] == 7}


def test_classifier_against_a_plain_one(spark):
    """The same sample, dictionaries and curve without Spark; a text that is longer than the bound isn't learnt from."""
    import zlib

    r = random.Random(4)
    data = [(i, " ".join(r.choice(["river", "stone", "garden"] if i % 2 else ["BUY", "now!!", "click"]) for _ in range(r.randrange(5, 300)))) for i in range(300)]
    data[10] = (10, "river " * 40_000)
    marks = [(i, i % 2) for i in range(300)]
    d, m = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    learnt = m.filter(~compression_classifier.held_out(F.col("doc_id"))).withColumnRenamed("quality", "label")
    at = {x["doc_id"]: x["h"] for x in d.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect()}
    texts = dict(data)
    samples = []
    for label in (1, 0):
        ids = sorted((i for i, y in marks if y == label and zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: at[i])[:80]
        room, kept = 20_000, []
        for i in ids:
            if len(texts[i]) <= room:
                room -= len(texts[i])
                kept.append(texts[i].encode())
        samples.append(kept)
    model = compression_classifier.fit(d, learnt, 80, 20_000)
    plain = brute.compression_scores(samples, [t.encode() for _, t in data], compression_classifier.DICT_BYTES, compression_classifier.LEVEL, sum(y for i, y in marks if zlib.crc32(str(i).encode()) % 3 != 1) / sum(zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in marks))
    got = {x["doc_id"]: x["score"] for x in compression_classifier.score(d, model).collect()}
    assert [got[i] for i, _ in data] == pytest.approx(plain, abs=1e-6)


def test_suffix_dedup(spark, rows, docs, odd, none, monkeypatch):
    want = brute.repeats(rows, 100)
    # by anchor; every bucket split into single windows; no anchor met, all by content
    for most, hot in ((256, 2000), (0, 1), (0, 10**9)):
        monkeypatch.setattr(suffix_dedup, "MOST_STRETCHES", most)
        monkeypatch.setattr(suffix_dedup, "HOT_ANCHORS", hot)
        out = by_id(suffix_dedup.remove_copies(docs))
        assert {i: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for i, x in out.items()} == want
    assert suffix_dedup.remove_copies(none).count() == 0
    found = sorted((x["doc_id"] if x["doc_id"] is not None else 99, x["n_bytes"], x["n_removed"]) for x in suffix_dedup.remove_copies(odd).collect())
    assert [f for f in found if f[0] == 6] == [(6, 152, 152)] and len([f for f in found if f[0] == 5 and f[2] == 152]) == 1


def test_previous_factors():
    import numpy as np

    r = np.random.default_rng(0)
    w = r.integers(0, 2, (500, 8)).astype(np.uint8)
    place = r.permutation(500)
    common = lambda a, b: next((k for k in range(8) if a[k] != b[k]), 8)
    want = [max((common(w[i], w[j]) for j in range(500) if place[j] < place[i]), default=0) for i in range(500)]
    assert suffix_dedup.previous_factors(w, place, 8).tolist() == want
    for at in (np.arange(9), np.arange(9)[::-1], r.permutation(200), np.zeros(0, int)):
        assert suffix_dedup.nearest_smaller(at).tolist() == [max((j for j in range(i) if at[j] < at[i]), default=-1) for i in range(len(at))]


def test_quality(spark, rows, docs, odd, none):
    out = by_id(quality_rules.verdicts(docs))
    for i, t in rows:
        f = brute.figures(t)
        x = out[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == f
        assert x["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0]) and not (x["kept"] and x["base_failed"])
    assert quality_rules.verdicts(odd).count() == 6 and quality_rules.verdicts(none).count() == 0
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {i for i, x in out.items() if x["kept"]}
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_host_verdict(spark):
    good, bad = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 1 + " ".join(f"w{i}" for i in range(60)), "too short"
    data = [(i, good, "fine" if i % 2 else "mixed") for i in range(100)] + [(100 + i, bad, "poor") for i in range(90)] + [(190 + i, good, "poor") for i in range(10)]
    out = by_id(quality_rules.verdicts(spark.createDataFrame(data, "doc_id long, text string, source string")))
    assert not out[195]["kept"] and not out[195]["base_failed"] and out[1]["kept"] and out[0]["kept"]


def test_decontaminate(spark, none):
    r = random.Random(2)
    v = [f"word{i}" for i in range(500)]
    items = [(k, " ".join(r.choice(v) for _ in range(30))) for k in range(5)]
    items += [(10, "If Anna has 12 red apples and Anna gives 5 apples to Bert then how many apples does Anna keep today?"), (11, "tiny one"), (12, "four words are enough"), (13, None), (None, "x y z a b c d e f g h i j")]
    clean = [(i, " ".join(r.choice(v) for _ in range(80))) for i in range(20)]
    filler = " ".join(r.choice(v) for _ in range(20))
    leak = [(100 + k, f"{filler} {items[k][1]} {filler}") for k in range(5)]
    same = "so we asked: If Karl has 31 red apples and Karl gives 7 apples to Doris then how many apples does Karl keep today? ok"
    clash = "so we asked: If Karl has 31 red apples and Anna gives 7 apples to Doris then how many apples does Uwe keep today? ok"
    docs = spark.createDataFrame([*clean, *leak, (200, same), (201, clash), (202, "say four words are enough here"), (203, None), (None, items[0][1]), (100, leak[0][1])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {(x["doc_id"], x["item_id"]): x["kind"] for x in decontaminate.leaks(docs, bench).collect()}
    assert out == {**{(100 + k, k): "verbatim" for k in range(5)}, (200, 10): "reparameterised", (202, 12): "verbatim"}
    kept = [x["doc_id"] for x in decontaminate.keep_clean(docs, bench).collect()]
    assert sorted(x for x in kept if x is not None) == [*range(20), 201, 203] and None in kept
    poor = spark.createDataFrame([(1, "who wrote hamlet"), (2, "12 + 30 = 42"), (3, "7 8 9 10 11 12 13 14 15 16"), (4, ""), (1, "who wrote hamlet")], "item_id long, text string")
    asked = spark.createDataFrame([(1, "quiz: Who wrote Hamlet? nobody knows"), (2, "sums: 12 + 30 = 42."), (3, "sums: 13 + 30 = 43."), (4, "who wrote the hamlet"), (5, "count 7 8 9 10 11 12 13 14 15 16 on"), (6, "count 1 2 3 4 5 6 7 8 9 10 11 12")], "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("item_id", F.lit("clash")).withColumn("plain", F.lit(1))
    found = {(x["doc_id"], x["item_id"], x["kind"]) for x in decontaminate.leaks(asked, poor).collect()}
    assert found == {(1, 1, "verbatim"), (2, 2, "verbatim"), (5, 3, "verbatim")}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.filter("false")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_decontaminate_against_a_plain_version(spark, seed):
    r = random.Random(seed)
    words = "a train leaves the old station and travels to town with many boxes while each box holds apples".split()
    units, names = ["km", "hours", "kg", "Minutes"], ["Alice", "Bob", "Carla"]

    def question(n):
        out = []
        for _ in range(n):
            k = r.random()
            out += [str(r.randrange(1, 40))] + ([r.choice(units)] if r.random() < 0.5 else []) if k < 0.2 else [r.choice(names)] if k < 0.3 else [r.choice(words) + r.choice(["", "", "", ",", "."])]
        return out

    items = [(i, " ".join(question(r.choice([1, 2, 3, 5, 7, 9, 15, 30])))) for i in range(30)]
    rows = []
    for d in range(60):
        _, text = r.choice(items)
        t = text.split(" ")
        how = r.randrange(4)
        if how:
            other = {}
            for i, w in enumerate(t):
                if w.isdigit() or w in names:
                    new = str(r.randrange(1, 40)) if w.isdigit() else r.choice(names)
                    t[i] = other.setdefault(w, new) if how == 1 else new if how == 2 else w
        if how == 3 and len(t) > 9:
            t = t[: r.randrange(6, len(t))]
        rows.append((d, " ".join([*question(r.randrange(12)), *t, *question(r.randrange(12))])))
    rows.append((99, " ".join(" ".join(question(50)) for _ in range(600)) + " " + items[5][1]))  # a very long text
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for c in ("window", "tokens", "plain", "size", "shift", "met", "slots", "kind"):
        d, b = d.withColumn(c, F.lit("clash")), b.withColumn(c, F.lit("clash"))
    want = brute.template_leaks(rows, items)
    got = {(x["doc_id"], x["item_id"]): (x["n_windows"], x["item_windows"], x["kind"]) for x in decontaminate.leaks(d, b).collect()}
    assert got == want and {k for _, _, k in want.values()} == {"verbatim", "reparameterised"}
    assert {x["doc_id"] for x in decontaminate.keep_clean(d, b).collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><!-- c --><div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold
    text</b> here, long enough to be read by all.<br>More<p>Second&nbsp;one &copy; é<aside>Side</aside><form><input><label>L</label></form><ul><li>Point one<li>Point two</ul><p>Ok.</article>
    <section class="comments"><p>Reader says hi</p></section><footer>Foot</footer>"""
    plain = "<html><body><div><a href=1>a</a> <a>b</a></div>" + "".join(f"<p>Paragraph {i} has many words and hardly any tags in it.</p>" for i in range(6)) + "<div><a>x</a><a>y</a></div></body></html>"
    d = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", plain), (4, "u", plain), (5, "u", "just text")], "page_id long, url string, html string")
    out = {x["page_id"]: x for x in main_text.extract(d).collect()}
    assert out[1]["text"] == "Head & line First bold text here, long enough to be read by all. More Second one © é Point one Point two Ok."
    assert out[2]["text"] == "" and out[3]["n_chars"] == 0 and out[5]["text"] == "just text"
    assert out[4]["text"] == " ".join(f"Paragraph {i} has many words and hardly any tags in it." for i in range(6))
    assert main_text.extract(d.filter("false")).count() == 0
    assert main_text.main_text("<html><head><title>t</title><body><main><p>open head</p></main>") == "open head"


@pytest.mark.parametrize("markup", ["<![ endif]-->", "<![foo[ x ]>", "<![if !IE>", "<![CDATA[ x >", "<![", "<![>"])
def test_main_text_odd_declarations(markup):
    ends = ">" if ">" not in markup else ""
    assert main_text.main_text(f"<body><article><p>Before it stands a line.</p>{markup}{ends}<p>After it stands another.</p></article>") == "Before it stands a line. After it stands another."


@pytest.mark.parametrize("n", [3, 198, 250, 5000])
def test_main_text_many_open_elements(n):
    menu = "<nav>" + "<span>item" * n + "</nav>"
    assert main_text.main_text(f"<body>{menu}<article><p>The article stands after the menu.</p></article>") == "The article stands after the menu."


def test_chat(spark):
    data = [(1, 0, "ann", "hi"), (1, 1, "bob", "a <|im_end|> b"), (1, 2, "cy", None), (1, 2, "ann", "tie"), (1, None, None, "late"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "user", "x")]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("speaker", F.lit("clash"))
    out = chat_rotation.rotate(d).collect()
    assert len(out) == 4 * 5 + 1 * 2
    ann = "".join(x["segment"] for x in sorted((x for x in out if x["conv_id"] == 1 and x["perspective"] == "ann"), key=lambda x: x["turn_order"]))
    assert ann == "<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\na < |im_end|> b<|im_end|>\n<|im_start|>assistant\ntie<|im_end|>\n<|im_start|>user name=cy\n<|im_end|>\n<|im_start|>user name=unknown\nlate<|im_end|>\n"
    assert all(x["segment"][x["content_start"] : x["content_end"]] + "<|im_end|>\n" == x["segment"][x["content_start"] :] and x["loss_mask"] == (x["speaker"] == x["perspective"]) for x in out)
    assert chat_rotation.rotate(d.filter("false")).count() == 0


def test_chat_far_turns_and_long_conversations(spark):
    turns = [-(1 << 63), -5, 0, 7, (1 << 62) + 1, (1 << 63) - 1]
    data = [(c, t, f"p{(c + k) % 3}", f"text {c} {t}") for c in range(3) for k, t in enumerate(turns)] + [(9, t, f"q{t % 4}", f"x{t}") for t in range(200)]
    d = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    key = lambda x: tuple(x.asDict().values())
    plain, dealt = (sorted(map(str, map(key, chat_rotation.rotate(d, n).collect()))) for n in (1000, 20))  # the second deals conversation 9 out
    assert plain == dealt and len(plain) == 3 * 6 * 3 + 200 * 4
    one = sorted((x["turn_order"], x["turn"]) for x in chat_rotation.rotate(d).filter("conv_id = 1 AND perspective = 'p1'").collect())
    assert [t for _, t in one] == turns


@pytest.mark.parametrize(("bits", "block", "cut"), [(12, 4 << 20, 8 << 20), (1024, 4 << 20, 8 << 20), (1024, 1 << 14, 1 << 13)])
def test_language_model(spark, rows, docs, odd, none, bits, block, cut):
    """The last two have too many bits for a count to be read too high: scores are the plain model's."""
    want, plain = brute.unigram(rows), brute.bigram(rows, bloom_lm.KAPPA)
    out = by_id(bloom_lm.score(docs, ~bloom_lm.held_out(F.col("doc_id")), bits, block, cut))
    assert len(out) == len(rows)
    for i, (_, n, known, total, base) in want.items():
        x = out[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, total)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
        assert x["score"] == pytest.approx(plain[i], rel=1e-9 if bits > 12 else 0.05, abs=1e-9)
    if bits == 12:
        full = by_id(bloom_lm.score_all(docs))
        assert all(full[i]["held_out"] == w[0] and full[i]["score"] == out[i]["score"] for i, w in want.items())
        assert bloom_lm.score_all(odd).count() == 6 and bloom_lm.score_all(none).count() == 0
        assert {x["score"] for x in bloom_lm.score(odd, F.lit(False)).collect()} == {0.0}


def test_bloom_counts():
    import numpy as np

    r = np.random.default_rng(2)
    gram = r.integers(0, 1 << 63, 20_000).astype(np.uint64)
    n = np.where(np.arange(20_000) % 3 == 0, 1, r.integers(1, 5000, 20_000))
    held, entries = bloom_lm.build_slice(gram, n)
    assert entries == sum(int(x).bit_length() for x in n) and 8 * len(held) >= 12 * entries
    level = bloom_lm.probe(held, gram)
    exact = np.array([int(x).bit_length() for x in n])
    assert (level >= exact).all() and (level == exact).mean() > 0.98
    other = r.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
    assert (bloom_lm.probe(held, other) == 0).mean() > 0.98


def test_grams_travel_whole():
    import numpy as np

    r = np.random.default_rng(1)
    for slices in (1, 2, 64, 1 << 20):
        for size in (0, 1, 3, 5000):
            g = np.unique(np.concatenate((r.integers(0, 1 << 63, size).astype(np.uint64) * np.uint64(2), np.array([0, (1 << 64) - 1][:size], np.uint64))))
            ids, bounds, width, raw, counts = bloom_lm._packed(g, np.arange(len(g)), slices)
            every = np.unique(np.concatenate((ids, [0, slices // 2, slices - 1])))
            grams, n = (bloom_lm._pieces(every, ids, bounds, k, x).to_pylist() for k, x in ((width, raw), (4, counts)))
            assert len(ids) <= min(slices, len(g)) and np.concatenate([bloom_lm._unpacked(x, width, int(i), slices) for i, x in zip(every, grams, strict=True)]).tolist() == g.tolist()
            assert np.frombuffer(b"".join(n), "<u4").tolist() == list(range(len(g)))


def test_many_slices_cost_no_more():
    import time

    import numpy as np

    g = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 300_000).astype(np.uint64))

    def seconds(slices):
        best = 9.0
        for _ in range(5):
            start = time.process_time()
            ids, bounds, width, raw, _ = bloom_lm._packed(g, np.ones(len(g)), slices)
            bloom_lm._pieces(ids, ids, bounds, width, raw)
            best = min(best, time.process_time() - start)
        return best

    assert seconds(1 << 20) < 2 * seconds(64) + 0.02
    for size in (0, 10**6, 10**9, 10**12, 10**14):
        slices, units = bloom_lm.layout(size)
        assert units * bloom_lm.BLOCK_BYTES <= bloom_lm.MOST_BLOCK and size / slices <= bloom_lm.MOST_SLICE and (size < 10**13 or size / slices >= bloom_lm.SLICE_BYTES)


def test_one_word_in_every_block(spark, monkeypatch):
    """Small blocks, many slices: the frequent word's slice hears from every block, and scores are the plain model's."""
    rows = [(i, f"the the w{i} x{i % 7} the") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(bloom_lm, "PIECE", 1)
    want, plain = brute.unigram(rows), brute.bigram(rows, bloom_lm.KAPPA)
    out = by_id(bloom_lm.score(d, ~bloom_lm.held_out(F.col("doc_id")), 1024, 64, 128))
    assert len(out) == 400 and all(out[i]["n_known"] == w[2] and out[i]["base_score"] == pytest.approx(w[4], rel=1e-9) and out[i]["score"] == pytest.approx(plain[i], rel=1e-9) for i, w in want.items())

