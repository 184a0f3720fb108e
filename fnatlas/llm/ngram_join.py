"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches
a threshold. A pair that links shares at least l tokens among the first
(n - needed + l) tokens of both sets under any one order of tokens. Each document
picks its own l: the higher the estimated cost of its candidates (the sum of the
frequencies of its prefix tokens), the longer its prefix, and the more shared tokens a
pair must show before it is verified. A pair is held to the smaller l of its two.

1. Equal sets (by 128 bits of hashes) are one class; one number stands for it.
2. Under the order of hash values, prefixes of all documents for l = SIEVE_SHARED give token
   frequencies. A document without l tokens that another one has too cannot link: it is done.
3. The rest get exact frequencies among themselves, the order rare-first and their own l.
4. Stars: of each prefix token's documents, the one with the fewest tokens of its own is
   paired with the others, a document with the STARS of them that it shares the most prefix
   tokens with; pairs that link become components.
5. Documents that meet a large component are then paired with members of it that differ from its centre
   where they do, a few each, in rounds until none links any more or few pairs are left. In a group of near copies nearly all
   tokens are common; differences tell who is near whom.
6. Pairs of components that are still different and meet at a token from which enough of both sets is left
   are then tried; a pair inside a component can change nothing. So a group of copies costs about its
   own size, and every link that joins components is found.
7. A pair's longer prefixes are compared first; only those that share l tokens there fetch their sets.

Tokens that very many documents have are known before anything gathers by token: a table of
counts by the tokens' upper bits finds them. Their rows are counted by aggregation, and
pairs at any token are made in blocks of documents, one block against one other a task.

Nulls and texts without words have empty sets and link with nothing; they take no part in any
shuffle by set. Texts of any length are whole. Rows with a null doc_id stay, without linking.
Repeated rows are each returned. Rows that share a doc_id share links: each is a row of its own, with
its own set. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, connected_components, join_counted, join_dimension, materialize, without
from .textblocks import blocks, mix, shingle_sets

#: Shared tokens that the first sieve asks for, where a set is large enough.
SIEVE_SHARED = 16
#: The longest prefix asks for so many shared tokens; a candidate cost of 2^j - 1 times COST_UNIT asks for j + 1.
MOST_SHARED = 8
COST_UNIT = 4.0
#: A token is hot if it holds over 1 / HOT_TOKENS of the rows; there are fewer than HOT_TOKENS such tokens.
HOT_TOKENS = 2000
#: Heads of stars that a document is paired with.
STARS = 8
#: A component of more documents is large: others are first held against few of it, by differences.
LARGE = 64
#: Large components that a document is held against so, at a token and in all; and most rounds of it.
LARGER, ROUNDS = 3, 8
#: Documents of one block of a hot token.
BLOCK_DOCS = 500
_SALT = np.uint64(0xA0761D6478BD642F)


def _digest(v: np.ndarray) -> tuple[int, int]:
    if not len(v):
        return 0, 0
    with np.errstate(over="ignore"):
        return int(mix(v).sum(dtype=np.uint64).view(np.int64)), int(mix(v ^ _SALT).sum(dtype=np.uint64).view(np.int64))


def _info(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2 = [], [], []
            for _, _, data, off in blocks(batch.column("text")):
                for v in shingle_sets(data, off, k):
                    x, y = _digest(v)
                    n.append(len(v))
                    c1.append(x)
                    c2.append(y)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], ["doc_id", "n", "c1", "c2"])

    return run


def _least(num: int, n: int) -> int:
    """The overlap that a set of n needs with any other."""
    return -(-num * n // 100)


def _prefixes(k: int, num: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # equal sets in one task give their tokens once
        for batch in batches:
            for _, _, data, off in blocks(batch.column("text")):
                tokens, owners, others, shared = [], [], [], []
                for v in shingle_sets(data, off, k):
                    n = len(v)
                    if not n or (d := _digest(v)) in seen:
                        continue
                    seen.add(d)
                    least = _least(num, n)
                    ask = min(SIEVE_SHARED, least)
                    take = n - least + ask
                    tokens.append(v[:take])
                    owners.append(np.full(take, d[0], np.int64))  # the set's digest: any copy speaks for all
                    others.append(np.full(take, d[1], np.int64))
                    shared.append(np.full(take, ask, np.int8))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([np.concatenate(tokens).view(np.int64)], owners, others, shared)], ["token", "c1", "c2", "ask"])

    return run


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = list(zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist(), batch.column("node").to_pylist(), strict=True))
            for a, _, data, off in blocks(batch.column("text")):
                tokens, owners, sizes = [], [], []
                for i, v in enumerate(shingle_sets(data, off, k), a):
                    if len(v) and _digest(v) == want[i][:2]:
                        tokens.append(v)
                        owners.append(np.full(len(v), want[i][2], np.int64))
                        sizes.append(np.full(len(v), len(v), np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(sizes))], ["token", "node", "n"])

    return run


def _hot_tokens(tokens: DataFrame, total: int, most: int) -> list[int]:
    """The tokens with over total / most rows: fewer than most. tokens: a written table."""
    limit = total / most
    part = F.shiftrightunsigned("token", 48)
    parts = [r[0] for r in tokens.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).collect()]
    inside = tokens.filter(part.isin(parts))  # as few parts as hot tokens can be
    return [r[0] for r in inside.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).collect()]


def _with_df(once: DataFrame, df: dict[int, int]) -> DataFrame:
    """The rows of the tokens of df, with their number."""
    if not df:
        return once.filter("false").withColumn("df", F.lit(0).cast("long"))
    known = F.create_map(*[F.lit(x) for token, n in sorted(df.items()) for x in (token, n)])
    return once.withColumn("df", F.try_element_at(known, F.col("token")).cast("long")).filter("df IS NOT NULL")


def _shared(tokens: DataFrame, owner: list[str], tag: str, most: int) -> DataFrame:
    """The tokens that two owners or more have, with their number (df); repeats of an owner's token go."""
    tokens = materialize(tokens, tag)
    hot = F.col("token").isin(_hot_tokens(tokens, tokens.count(), most))
    who = F.struct(*owner)
    before = F.lag(who).over(Window.partitionBy("token").orderBy(*owner))
    cold = tokens.filter(~hot).repartition("token").withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != who)).drop("before")
    cold = cold.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("df > 1")
    rest = [c for c in tokens.columns if c not in ("token", *owner)]
    once = materialize(tokens.filter(hot).groupBy("token", *owner).agg(*[F.max(c).alias(c) for c in rest]), f"{tag}-hot")
    df = {r["token"]: r["df"] for r in once.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").collect()}  # fewer than most
    return cold.unionByName(_with_df(once, df).select(*tokens.columns, "df"))


def _asked(cost: Column, least: Column) -> Column:
    """How many shared tokens a document's prefix asks for."""
    return F.least(F.lit(MOST_SHARED), least, F.lit(1) + F.floor(F.log2(F.lit(1.0) + cost / F.lit(COST_UNIT)))).cast("int")


def _verified(pairs: DataFrame, nodes: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) that link: first those whose longer prefixes share the smaller l of the two, then those whose
    sets are near enough. Only tokens that two documents have can be in an overlap."""
    token = lambda x: x["token"]
    prefix = nodes.select("node", "l", F.transform(F.slice("found", F.lit(1), F.expr("n - least + l - own")), token).alias("prefix"))
    many = pairs.join(prefix.toDF("a", "l_a", "prefix_a"), "a").join(prefix.toDF("b", "l_b", "prefix_b"), "b")
    many = many.filter("size(array_intersect(prefix_a, prefix_b)) >= least(l_a, l_b)").select("a", "b")
    sets = nodes.select("node", "n", F.transform("found", token).alias("set"))
    both = many.join(sets.toDF("a", "n_a", "set_a"), "a").join(sets.toDF("b", "n_b", "set_b"), "b")
    both = both.withColumn("i", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.expr(f"100 * i >= {num} * (n_a + n_b - i)")).select("a", "b")


def _fits(met: DataFrame, num: int) -> DataFrame:
    """The rows of pairs whose sizes fit and that meet where the needed overlap is still left in both sets. met: a, b, and
    the size n and place pos of both."""
    return met.filter(f"{_sizes_fit(num)} AND least(n_a - pos_a, n_b - pos_b) >= {_needed(num)}")


def _sizes_fit(num: int) -> str:
    return f"100 * least(n_a, n_b) >= {num} * greatest(n_a, n_b)"


def _needed(num: int) -> str:
    """The overlap that sets of n_a and n_b tokens need."""
    return f"(({num} * (n_a + n_b) + {99 + num}) DIV {100 + num})"


def _stars(prefix: DataFrame) -> DataFrame:
    """Each prefix token's documents beside the one with the fewest tokens of its own: first inside blocks of about
    BLOCK_DOCS documents, then the blocks' first ones among themselves."""
    blocks_of = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("df") / F.lit(float(BLOCK_DOCS)))))  # the same documents stand together at tokens of about the same df
    part = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1.0), blocks_of).cast("long")).cast("int")
    first = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "pos"))
    inside = prefix.withColumn("hub", first.over(Window.partitionBy("token", part)))
    heads = inside.filter((F.col("df") > BLOCK_DOCS) & (F.col("hub.node") == F.col("node"))).withColumn("hub", first.over(Window.partitionBy("token")))
    every = inside.unionByName(heads).filter("hub.node != node")
    ends = ["node", F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")]
    return every.select(*ends, F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("hub.n").alias("n_b"), F.col("hub.pos").alias("pos_b"))


def _star_links(prefix: DataFrame, nodes: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) that link, of documents and the STARS heads that they share the most prefix tokens with. Heads are held
    against all of theirs; another document against the first one, and only if it doesn't link against the rest. What is left out
    here joins nothing that pairs of different components wouldn't."""
    met = _fits(_stars(prefix), num).groupBy("node", "a", "b").agg(F.count(F.lit(1)).alias("tokens"))
    best = Window.partitionBy("node").orderBy(F.col("tokens").desc(), "a", "b")
    met = met.withColumn("head", F.when(F.col("a") == F.col("node"), F.col("b")).otherwise(F.col("a"))).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= STARS)
    met = materialize(met.select("node", "head", "a", "b", "k"), "stars-met")
    heads = met.select(F.col("head").alias("node")).distinct().withColumn("is_head", F.lit(True))
    met = met.join(heads, "node", "left")
    now = F.col("is_head").isNotNull() | (F.col("k") == 1)
    links = materialize(_verified(met.filter(now).select("a", "b").distinct(), nodes, num), "stars-first")
    linked = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    rest = met.filter(~now).join(linked, "node", "left_anti").select("a", "b").distinct()
    return links.unionByName(_verified(rest, nodes, num))


def _placed(prefix: DataFrame, near: DataFrame) -> DataFrame:
    """prefix with component and members, the component's number of nodes. near: (node, component) of components of two or more."""
    sized = join_dimension(near, materialize(near.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "members"), "component")
    placed = prefix.join(sized, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return placed.withColumn("members", F.coalesce("members", F.lit(1)))


def _asked_larger(placed: DataFrame, num: int) -> DataFrame:
    """(node, larger, larger_members): documents and the large components, larger than their own, that they meet at most tokens and
    that may hold a document near enough by size and place. placed: as _placed() gives it."""
    mixed = materialize(_mixed(placed).select("token", "node", "n", "pos", "component", "members"), "mixed-tokens")
    larger = mixed.filter(F.col("members") > LARGE).groupBy("token", F.col("component").alias("larger"), F.col("members").alias("larger_members"))
    larger = larger.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("left"))
    largest = Window.partitionBy("token").orderBy(F.col("larger_members").desc(), "larger")
    larger = materialize(larger.withColumn("k", F.row_number().over(largest)).filter(F.col("k") <= LARGER).drop("k"), "larger")
    met = join_dimension(mixed, larger, "token", "inner", spread=F.xxhash64("node"))
    met = met.filter("larger_members > members OR (larger_members = members AND larger < component)")
    met = met.withColumn("n_a", F.col("n")).withColumn("n_b", F.greatest("low", F.expr(f"CAST(({num} * n + 99) DIV 100 AS INT)")))  # the least that any may need
    met = met.filter(f"n_b <= high AND 100 * n_a >= {num} * n_b AND least(n - pos, left) >= {_needed(num)}")
    met = met.groupBy("node", "larger", "larger_members").agg(F.count(F.lit(1)).alias("tokens"))
    most = Window.partitionBy("node").orderBy(F.col("tokens").desc(), F.col("larger_members").desc(), "larger")
    return materialize(met.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= LARGER).select("node", "larger", "larger_members"), "larger-asked")


def _closer_links(asked: DataFrame, near: DataFrame, nodes: DataFrame, num: int, turn: int) -> DataFrame:
    """Pairs (a, b) that link, of documents and members of the components that they are asked with.

    With differences taken from a component's centre, two sets differ by exactly the differences that they don't share. So a
    document is paired with the STARS members that are nearest by the differences at which they stand for the component: at
    each, one of the members with the fewest, another one each turn. What is left out here joins nothing that pairs of
    different components wouldn't."""
    wanted = materialize(asked.select(F.col("larger").alias("component")).distinct(), "larger-wanted")
    inside = join_dimension(near, wanted, "component", "inner").select("node", F.col("component").alias("larger"))
    sets = nodes.select("node", "own", F.transform("found", lambda x: x["token"]).alias("set"))
    centre = inside.join(nodes.select("node", (F.col("own") / F.col("n")).alias("share")), "node").groupBy("larger").agg(F.min(F.struct("share", "node"))["node"].alias("node"))
    centre = materialize(centre.join(sets, "node").select("larger", F.col("set").alias("centre")), "centres")
    both = inside.withColumn("inside", F.lit(True)).unionByName(asked.select("node", "larger", F.lit(False).alias("inside"))).join(sets, "node")
    both = join_dimension(both, centre, "larger", "inner", rows=centre.agg(F.sum(F.size("centre"))).first()[0], spread=F.xxhash64("node"))
    both = both.withColumn("other", F.concat(F.array_except("set", "centre"), F.array_except("centre", "set")))
    apart = both.select("node", "inside", (F.size("other") + F.col("own")).alias("apart"), F.explode("other").alias("token"), "larger")
    apart = materialize(apart.select("node", "inside", "apart", F.struct("larger", "token").alias("at")), "differences")

    first = F.struct(F.floor(F.log2(F.col("apart") + 1)).alias("about"), F.xxhash64("node", F.lit(turn)).alias("draw"), "node", "apart")
    hubs = materialize(apart.filter("inside").groupBy("at").agg(F.min(first).alias("hub")), "difference-hubs")
    tried = join_dimension(apart.filter("NOT inside").select("node", "at"), hubs, "at", "inner", spread=F.xxhash64("node"))
    tried = tried.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    nearest = Window.partitionBy("node").orderBy((2 * F.col("shared") - F.col("hub.apart")).desc(), "hub.node")
    tried = tried.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= STARS)
    pairs = tried.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    return materialize(_verified(pairs, nodes, num), "closer-links")


def _merged(near: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after links (a, b) between nodes have joined components of near."""
    for side in "ab":
        links = links.join(near.toDF(side, f"c_{side}"), side, "left")
    links = links.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    wider = materialize(connected_components(links), "links")
    out = near.join(wider.toDF("component", "wider"), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))
    return out.unionByName(wider.join(near.select("node"), "node", "left_anti"))


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of tokens that documents of different components have, with docs, the documents of a frequent token (else 1).
    placed: token, node, n, pos, df, component; a frequent token's components are compared by aggregation."""
    over = Window.partitionBy("token")
    few = placed.filter(F.col("df") <= BLOCK_DOCS).withColumn("lo", F.min("component").over(over)).withColumn("hi", F.max("component").over(over)).filter("lo != hi").drop("lo", "hi")
    many = placed.filter(F.col("df") > BLOCK_DOCS)
    spans = many.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("docs")).filter("lo != hi").select("token", "docs")
    return few.withColumn("docs", F.lit(1).cast("long")).unionByName(join_dimension(many, materialize(spans, "mixed"), "token", "inner", spread=F.xxhash64("node")))


def _mixed_pairs(placed: DataFrame) -> DataFrame:
    """A row for each token and pair of different components that meet there. placed: as _mixed() gives it. A token's
    documents are dealt into blocks of about BLOCK_DOCS, and each task gets two blocks."""
    parts = F.ceil(F.col("docs") / F.lit(float(BLOCK_DOCS))).cast("int")
    dealt = placed.withColumn("own_part", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    named = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("n", "pos", "component")]
    left = dealt.select("token", F.col("own_part").alias("part_a"), F.col("other_part").alias("part_b"), F.col("node").alias("a"), *named("a"))
    right = dealt.select("token", F.col("other_part").alias("part_a"), F.col("own_part").alias("part_b"), F.col("node").alias("b"), *named("b"))
    return left.join(right, ["token", "part_a", "part_b"]).filter("a < b AND component_a != component_b")


def link_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    docs: doc_id long, text string. words: of a shingle. percent: the least similarity.
    """
    k, num = words, percent
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = materialize(docs.mapInArrow(_info(k), "doc_id long, n long, c1 long, c2 long"), "sets")
    total = info.count()
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    classes = info.filter("n > 0 AND doc_id IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    least_n = F.expr(f"CAST(({num} * n + 99) DIV 100 AS INT)")
    found = _shared(named.mapInArrow(_prefixes(k, num), "token long, c1 long, c2 long, ask byte"), ["c1", "c2"], "sieve", HOT_TOKENS)
    by_class = found.groupBy("c1", "c2", "ask").agg(F.count(F.lit(1)).alias("met")).filter("met >= ask")
    alive = materialize(classes.join(by_class.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi").select("doc_id", "c1", "c2", "node"), "alive")

    tokens = named.join(F.broadcast(alive) if alive.count() <= BROADCAST_ROWS else alive, "doc_id").mapInArrow(_tokens(k), "token long, node long, n int")
    nodes = _shared(tokens, ["node"], "tokens", HOT_TOKENS).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("found"))
    nodes = nodes.withColumn("own", F.col("n") - F.size("found")).withColumn("least", least_n)
    nodes = nodes.filter("n - least + 1 > own")  # else its prefix has no token that another document has
    cost = F.aggregate(F.slice("found", F.lit(1), F.expr("n - least + 1 - own")), F.lit(0.0), lambda s, x: s + x["df"] - F.lit(1.0))
    nodes = materialize(nodes.withColumn("l", _asked(cost, F.col("least"))), "nodes")

    # two linked sets meet at the first token that they share, which stands in both shortest prefixes
    prefix = nodes.select("node", "n", "own", F.posexplode(F.slice("found", F.lit(1), F.expr("n - least + 1 - own"))).alias("at", "x"))
    prefix = materialize(prefix.select(F.col("x.token").alias("token"), F.col("x.df").alias("df"), "node", "n", "own", (F.col("at") + F.col("own")).cast("int").alias("pos")), "prefixes")
    near = materialize(connected_components(_star_links(prefix, nodes, num)), "stars")

    prefix = prefix.drop("own")
    placed, most = materialize(_placed(prefix, near), "placed"), nodes.count()
    for turn in range(ROUNDS):
        asked = _asked_larger(placed, num)
        if (asked.agg(F.sum("larger_members")).first()[0] or 0) <= most:  # what is left isn't more pairs than documents
            break
        if (closer := _closer_links(asked, near, nodes, num, turn)).isEmpty():
            break
        near = materialize(_merged(near, closer), "closer")
        placed = materialize(_placed(prefix, near), "placed")
    rest = _verified(_fits(_mixed_pairs(_mixed(placed)), num).select("a", "b").distinct(), nodes, num)
    comp = _merged(near, rest)
    grouped = classes.join(comp, "node", "left").filter("component IS NOT NULL OR copies > 1").withColumn("component", F.coalesce("component", "node"))
    first = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_by = grouped.join(first, "component").select("c1", "c2", "copies", "component_id")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    out = join_counted(info.filter(linked), materialize(named_by, "components"), ["c1", "c2"], "copies", total)
    out = out.select("doc_id", "n", "component_id").unionByName(info.filter(~linked).select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; rows without a doc_id stay."""
    out = materialize(link_components(docs, words, percent), "groups")
    others = materialize(out.filter("doc_id != component_id").select("doc_id").distinct(), "others")
    kept = without(docs, others)
    repeated = out.filter("doc_id IS NOT NULL AND doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if repeated.isEmpty():
        return kept
    again = repeated.select("doc_id")
    return kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
