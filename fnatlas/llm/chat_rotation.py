"""Chat formatting by perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that participant as the
assistant and all others as named users. The result has a row for each participant and turn, in
place of one string a conversation, so that a conversation of any length stays spread over
tasks: a rendering is its rows in order of turn_order. Each row has the rendered segment, the
span of its content, and the loss mask: 1 for content (and end marker) of the participant's own turns.

A null or blank role is the participant `unknown`, a null text is empty, texts of any length are whole, null turns come
last; rows that share a turn are in order of speaker and the text's sha256, and repeated rows are each rendered.
Rows with a null conv_id form no dialogue and are left out. An empty table gives an empty result. Markers inside a text or role are
broken up, so that a text can't end its own segment. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a long conversation that one task renders for one participant.
HOT_ROWS = 100_000
#: A conversation is long from so many turns on, and from a ten-thousandth of all turns on.
LONG_ROWS = 1000


def rotate(conversations: DataFrame, long_rows: int = LONG_ROWS) -> DataFrame:
    """conv_id, perspective, turn, turn_order, speaker, chat_role, name, segment, content_start, content_end, loss_mask."""
    safe = lambda c: F.regexp_replace(c, r"<\|", "< |")
    speaker = F.coalesce(F.when(F.trim(F.col("role").cast("string")) != "", F.trim(F.col("role").cast("string"))), F.lit("unknown"))
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), safe(speaker).alias("speaker"), safe(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("content"))
    people = materialize(turns.groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("turns")).select("conv_id", F.col("speaker").alias("perspective"), F.col("turns").alias("own_turns")), "participants")
    long_ones = people.groupBy("conv_id").agg(F.sum("own_turns").alias("rows"))
    total = turns.count()
    # conversations with over a ten-thousandth of all turns are few: their participants are broadcast if they are few too
    big = materialize(long_ones.filter(F.col("rows") > F.lit(max(total / 10_000, float(long_rows)))), "long")
    ids = F.broadcast(big.select("conv_id"))
    cast = people.join(ids, "conv_id")
    salts = max(16, (big.agg(F.max("rows")).first()[0] or 0) // HOT_ROWS)  # so that a part of even the longest has about HOT_ROWS turns at most
    salted_cast = cast.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hot = turns.join(ids, "conv_id").withColumn("salt", F.pmod(F.xxhash64("turn", "speaker", "content"), F.lit(salts)).cast("int")).join(salted_cast, ["conv_id", "salt"]).drop("salt")
    rest = turns.join(ids, "conv_id", "left_anti").join(people, "conv_id")
    every = hot.unionByName(rest).drop("own_turns")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(own, F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), F.col("speaker"), F.lit("\n")))
    every = every.withColumn("head", head)
    # all turns from -2^63 are moved to 0 and up, as decimals, which don't overflow
    order = F.coalesce(F.lpad((F.col("turn").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("~"))
    return every.select(
        "conv_id",
        "perspective",
        "turn",
        F.concat_ws("/", order, "speaker", F.sha2(F.col("content"), 256)).alias("turn_order"),
        "speaker",
        F.when(own, "assistant").otherwise("user").alias("chat_role"),
        F.when(~own, F.col("speaker")).alias("name"),
        F.concat("head", "content", F.lit(f"{END}\n")).alias("segment"),
        F.length("head").cast("long").alias("content_start"),
        (F.length("head") + F.length("content")).cast("long").alias("content_end"),
        own.cast("int").alias("loss_mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn,
         replace(CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE trim(role) END, '<|', '< |') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS content
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
r AS (
  SELECT t.*, perspective, speaker = perspective AS own,
         CASE WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS head
  FROM t JOIN p USING (conv_id))
SELECT conv_id, perspective, turn,
       coalesce(lpad(CAST(CAST(turn AS HUGEINT) + 9223372036854775808 AS VARCHAR), 20, '0'), '~') || '/' || speaker || '/' || sha256(content) AS turn_order,
       speaker, CASE WHEN own THEN 'assistant' ELSE 'user' END AS chat_role, CASE WHEN own THEN NULL ELSE speaker END AS name,
       head || content || '<|im_end|>' || chr(10) AS segment,
       CAST(length(head) AS BIGINT) AS content_start, CAST(length(head) + length(content) AS BIGINT) AS content_end, CAST(own AS INTEGER) AS loss_mask
FROM r
"""
