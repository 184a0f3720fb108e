"""Personal data by patterns and by disclosure, in DataFrame operations only.

Base spans: emails, IP addresses, card and phone numbers, leftmost and non-overlapping
per kind; a match that fails its kind's test is dropped and not tried again.

Information-theoretic sanitisation: the values of base spans are protected entities. Lines are
contexts. Over all lines of all documents the co-occurrence counts give the pointwise mutual
information of a term and an entity; a term that stands with an entity in at least
LEAST_TOGETHER different lines and gives away at least DISCLOSURE of the entity's information
content is disclosing, and every occurrence of it in any document becomes a span of kind term.
Redaction generalises spans to their kind's name.

Patterns use possessive repeats and start where a run starts (or the last match ended), which
finds the same matches as the plain patterns without their backtracking.

Null texts are empty, texts of any length are whole. Rows with a null doc_id and repeated rows are each
returned. An empty table gives an empty result. Other columns are ignored by report() and kept by
redact(), whatever their names. A word that stands in a line twice counts once. Equal texts (by 128 bits of
hashes) are looked up once; values and texts that very many rows share are joined without gathering their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, join_counted, join_dimension, materialize, sha256_hex

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match that passes.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
LEAST_TOGETHER = 3
DISCLOSURE = 0.9
#: Spans that are worked on one after the other.
CHUNK = 256
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substr(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, digit(i) * 2).otherwise(digit(i))
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        trimmed = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(trimmed(p)) < 3) | ((F.length(trimmed(p)) == 3) & (trimmed(p) <= "255")))
    d = _digits(value)
    low, high = (14, 19) if kind == "card" else (10, 15)
    sized = F.length(d).between(low, high)
    return F.when(sized, _luhn(d)).otherwise(False) if kind == "card" else sized


def _in_chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK at most: appending one by one stays inside a chunk, so that a text of very many
    spans costs about as much a span as any other."""
    cut = lambda xs: F.when(F.size(xs) > 0, F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(CHUNK)), lambda i: F.slice(xs, i, F.lit(CHUNK))))
    return F.transform(F.array(items), cut)[0]  # the array is made once, as the outer lambda's variable


def _located(text: Column, pattern: Column, rank: int, kind: str) -> Column:
    """All matches of a pattern as spans. The pieces between matches give their places, first inside a chunk, then in the text."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast(f"array<{SPAN}>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value")).cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span(start, end, x["found"]))).alias("spans"))

    def join(acc: Column, part: Column) -> Column:
        moved = F.transform(part["spans"], lambda s: span(s["start"] + acc["at"], s["end"] + acc["at"], s["value"]))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("found"))
    parts = F.transform(_in_chunks(pairs), lambda c: F.aggregate(c, begin, step))
    return F.coalesce(F.aggregate(parts, begin, join, lambda acc: acc["spans"]), empty)


def _passing(kind: str):
    return lambda s: _passes(kind, s["value"])


def _of(kind: str):
    return lambda s: s["kind"] == kind


def base_spans(text: Column) -> Column:
    """The base spans of a text in order of start, then kind."""
    none = F.array().cast(f"array<{SPAN}>")
    each = []
    for rank, kind in enumerate(KINDS):
        all_matches = _located(text, F.lit(PATTERNS[kind]), rank, kind)
        each.append(F.when(text.rlike(HINTS[kind]), F.filter(all_matches, _passing(kind))).otherwise(none))
    return F.array_sort(F.concat(*each))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _terms(line: Column) -> Column:
    """The different words of a line, lower-cased, without punctuation at their ends; those with digits or @ aren't terms."""
    words = F.transform(F.split(F.lower(line), SPACE), lambda w: F.regexp_replace(w, r"^[\p{Punct}]+|[\p{Punct}]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("[0-9@]")))


def disclosing_terms(docs: DataFrame, found: DataFrame, together: int = LEAST_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """term, entity and their counts for terms that give an entity away. docs: text. found: text, spans (not empty)."""
    lines = found.select(F.explode(F.split("text", "\n")).alias("line")).withColumn("spans", base_spans(F.col("line"))).filter(F.size("spans") > 0)
    entity = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", s["value"]).otherwise(_digits(s["value"])))))
    lines = materialize(lines.select("line", entity.alias("entities")), "lines")
    by_entity = lines.select(F.explode("entities").alias("entity"), F.xxhash64("line").alias("place")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.count_distinct("place").alias("places"))
    repeated = materialize(by_entity.filter(F.col("places") >= together).select("entity", "n_e"), "entities")
    each = lines.select(F.explode("entities").alias("entity"), "line")
    held = join_counted(each, repeated, ["entity"], "n_e", each.count(), "inner")
    pairs = held.select("entity", "n_e", F.xxhash64("line").alias("place"), F.explode(_terms(F.col("line"))).alias("term"))
    pairs = pairs.groupBy("entity", "n_e", "term").agg(F.count(F.lit(1)).alias("n_te"), F.count_distinct("place").alias("places")).filter(F.col("places") >= together)
    pairs = materialize(pairs.drop("places"), "pairs")
    terms = materialize(pairs.select("term").distinct(), "terms")
    n_terms = terms.count()
    if not n_terms:
        return pairs.select("term", "entity", "n_te", "n_e", F.lit(0).cast("long").alias("n_t"), F.lit(0.0).alias("pmi"))
    every = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    words = every.select(F.explode(_terms(F.col("line"))).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        n_t = words.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    else:  # counted before the shuffle, so that frequent words don't gather
        n_t = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term")
    total = docs.agg(F.sum(F.size(F.split("text", "\n")))).first()[0]
    pmi = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    return pairs.join(n_t, "term").withColumn("pmi", pmi).filter(F.col("pmi") >= F.lit(disclosure) * F.log2(F.lit(float(total)) / F.col("n_e"))).select("term", "entity", "n_te", "n_e", "n_t", "pmi")


def _spanned(rows: DataFrame, together: int, disclosure: float) -> DataFrame:
    """rows with base (spans) and spans (base and disclosing terms, in order of start, then kind). rows: text (not null), and
    what else is to be kept, under names that don't begin with an underscore."""
    found = rows.select("text").withColumn("spans", base_spans(F.col("text"))).filter(F.size("spans") > 0)
    flagged = materialize(disclosing_terms(rows.select("text"), found, together, disclosure).select("term").distinct(), "disclosing")
    n = flagged.count()
    base = base_spans(F.col("text"))
    if not n:
        return rows.withColumn("base", base).withColumn("spans", F.col("base"))
    same = [F.xxhash64("text").alias("_s1"), F.xxhash64(F.lit(1), "text").alias("_s2")]
    words = rows.select(*same, F.explode(F.array_distinct(F.flatten(F.transform(F.split("text", "\n"), _terms)))).alias("term"))
    hits = join_dimension(words, flagged, "term", "inner", rows=n, spread=F.col("_s1")).groupBy("_s1", "_s2").agg(F.collect_set("term").alias("_terms"), F.count(F.lit(1)).alias("_copies"))
    hits = materialize(hits.withColumn("_copies", (F.col("_copies") / F.size("_terms")).cast("long")), "hits")
    quoted = F.array_join(F.transform(F.array_sort("_terms"), lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![^\x20\x09-\x0D\p{Punct}])(?:"), quoted, F.lit(r")(?![^\x20\x09-\x0D\p{Punct}])"))
    total = hits.agg(F.sum("_copies")).first()[0]
    out = join_counted(rows.select("*", *same), hits, ["_s1", "_s2"], "_copies", total)
    more = F.when(F.col("_terms").isNotNull(), _located(F.col("text"), pattern, len(KINDS), "term")).otherwise(F.array().cast(f"array<{SPAN}>"))
    return out.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", more))).drop("_s1", "_s2", "_terms", "_copies")


def find(docs: DataFrame, together: int = LEAST_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """Per row: doc_id, base (spans), spans (base and disclosing terms, in order of start, then kind)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _spanned(rows, together, disclosure).select("doc_id", "base", "spans")


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256, spans."""
    out = find(docs)
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, sha256_hex(spans_text(F.col("base"))).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the first one's kind in brackets. A chunk of spans works on its own
    stretch of the text."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def replace(acc: Column, chunk: Column) -> Column:
        last = F.greatest(acc["at"], F.array_max(F.transform(chunk, lambda s: s["end"])))

        def step(inner: Column, s: Column) -> Column:
            start, end = s["start"] - acc["at"], s["end"] - acc["at"]
            gap = F.substr(inner["here"], inner["at"] + 1, start - inner["at"])
            out = F.when(start < inner["at"], inner["out"]).otherwise(F.concat(inner["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.struct(F.greatest(inner["at"], end).alias("at"), out.alias("out"), inner["here"].alias("here"))

        here = F.substr(text, acc["at"] + 1, last - acc["at"])
        done = F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.lit("").alias("out"), here.alias("here")), step, lambda inner: inner["out"])
        return F.struct(last.alias("at"), F.concat(acc["out"], F.array(done)).alias("out"))

    return F.aggregate(_in_chunks(spans), begin, replace, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, together: int = LEAST_TOGETHER, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs with its spans generalised in text, and n_chars (if there) counted anew."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = _spanned(rows, together, disclosure)
    text = F.when(F.size("spans") > 0, _redacted(F.col("text"), F.col("spans"))).otherwise(F.col("row.text"))
    out = out.select("row", text.alias("text"))
    kept = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "n_chars":
            old = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema[c].dataType)).otherwise(old)
        kept.append((F.col("text") if c == "text" else old).alias(c))
    return out.select(*kept)
