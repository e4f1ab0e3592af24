"""Multi-party dialogues rendered once for every participant.

For each participant the dialogue is written with that speaker as assistant and all others
as named users; the mask tells which characters are the assistant's own words. Dialogues are
cut into segments of ``SEGMENT`` turn numbers, and a segment with more messages than that into
further ones, so that no group grows with the length of a dialogue.

Messages without a dialogue are left out, as are repeated rows (same dialogue, turn, speaker
and text). A null speaker is called ``unknown``, a null text is empty, a null turn comes last;
ties of a turn are ordered by speaker and text. System messages stay what they are for every
participant and are nobody's perspective; a dialogue of system messages only has none. Marks
inside a text are broken up, so that no text can pose as a turn. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm import common

SEGMENT = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def messages(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Each message once, with the segment it is in and its place there.

    The first part of a segment's name is the turn divided by ``segment``; the second counts
    further cuts, which only repeated turn numbers make necessary.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("body")).distinct()
    span = F.coalesce(F.floor(F.col("turn") / F.lit(segment)), F.lit((1 << 62) // segment)).cast("long")
    placed = clean.withColumn("span", span).withColumn("_n", F.row_number().over(
        Window.partitionBy("conv_id", "span").orderBy(F.col("turn").asc_nulls_last(), "speaker", "body")) - 1)
    return placed.withColumn("part", F.floor(F.col("_n") / F.lit(segment))).withColumn("place", (F.col("_n") % segment).cast("int")).drop("_n")


def heading(speaker: Column, perspective: Column) -> Column:
    name = F.replace(F.replace(speaker, F.lit("<|"), F.lit("< |")), F.lit("\n"), F.lit(" "))
    return F.concat(F.lit(OPEN), F.when(speaker == "system", F.lit("system")).when(speaker == perspective, F.lit("assistant"))
                    .otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))


def perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per dialogue, segment and participant: ``rendered`` and ``mask``, the
    character spans (start, end) of the participant's own words in it."""
    placed = messages(turns, segment)
    segments = placed.groupBy("conv_id", "span", "part").agg(
        F.sort_array(F.collect_list(F.struct("place", "speaker", "body"))).alias("said"))
    speakers = placed.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = segments.join(speakers, "conv_id")
    me = F.col("perspective")
    pieces = F.transform("said", lambda m: F.struct(
        heading(m.speaker, me).alias("head"), m.body.alias("body"), (m.speaker == me).alias("own")))
    step = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda done, m: F.struct(
            (done.at + F.length(m.head) + F.length(m.body) + F.lit(len(CLOSE))).alias("at"),
            F.when(m.own, F.concat(done.spans, F.array(F.struct(
                (done.at + F.length(m.head)).alias("start"), (done.at + F.length(m.head) + F.length(m.body)).alias("end")))))
            .otherwise(done.spans).alias("spans")))
    return both.withColumn("pieces", pieces).select(
        "conv_id", "span", "part", "perspective", F.size("said").alias("n_messages"),
        F.array_join(F.transform("pieces", lambda m: F.concat(m.head, m.body, F.lit(CLOSE))), "").alias("rendered"),
        step.spans.alias("mask"))


def op9_chat(spark, sf_dir: str) -> DataFrame:
    """Digest of every rendering; the operator itself returns texts and spans."""
    done = perspectives(common.table(spark, sf_dir, "conversations"))
    return done.select(
        "conv_id", "span", "part", "perspective", "n_messages", F.length("rendered").alias("n_chars"),
        F.sha2("rendered", 256).alias("rendered_sha256"),
        F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m.start, m.end)), ",").alias("mask"))


OP9_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, coalesce(floor(turn / 64.0)::BIGINT, 72057594037927936) AS span FROM said),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, span ORDER BY turn NULLS LAST, speaker, body) - 1 AS n FROM placed),
speakers AS (SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'),
pieces AS (
  SELECT m.conv_id, span, n // 64 AS part, n % 64 AS place, perspective, speaker = perspective AS own, body,
         '<|im_start|>' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant'
           ELSE 'user name=' || replace(replace(speaker, '<|', '< |'), chr(10), ' ') END || chr(10) AS head
  FROM numbered m JOIN speakers s ON m.conv_id = s.conv_id),
ends AS (
  SELECT *, sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, span, part, perspective ORDER BY place) AS stop
  FROM pieces)
SELECT conv_id, span, part, perspective, count(*)::INT AS n_messages, max(stop)::INT AS n_chars,
       sha256(string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY place)) AS rendered_sha256,
       coalesce(string_agg((stop - 11 - length(body))::BIGINT || ':' || (stop - 11)::BIGINT, ',' ORDER BY place) FILTER (WHERE own), '') AS mask
FROM ends GROUP BY conv_id, span, part, perspective
"""
