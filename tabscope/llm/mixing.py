"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block`` documents. With a target weight w, block i of a
source (from 0) may run from slot floor(i / w) on and must run before slot ceil((i + 1) / w);
in every slot the earliest deadline among the released blocks runs. Weights are whole numbers
of ``1 / period``, so the schedule repeats every ``period`` slots and is worked out for one
period, whatever the amount of data. The period grows with the number of sources, so that
weights stay true however many there are. At every slot each source has had its share to within
less than one block, for as long as it lasts; afterwards its slots stay empty.

Target weights are the sources' shares to the power ``flatten``, or those of a table (source,
weight). Every document keeps its row and gets the slot of its block and a place in it. ``in_mix``
tells whether the slot comes before the first one that a source could not fill. Documents of
sources without a positive weight in a given table have no slot and are not in the mixture.

A null source is a source of its own. Within a source documents are in the order of the MD5
of their id and text, so that a block is a mixture; repeated rows share a hash and take
neighbouring places. An empty table gives no rows. Other columns pass through, whatever their
names; ``slot``, ``place`` and ``in_mix`` replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm import common

BLOCK = 8
#: Slots of a period, and how many there are for each source at least if sources are many.
PERIOD, SLOTS_EACH = 1024, 16
#: Target weights are the sources' shares to this power, which lifts small sources.
FLATTEN = 0.7
#: Tables of weights and slots up to this many rows of a few numbers are sent to all tasks.
BROADCAST_ROWS = 1 << 17
CHUNK = 512


def numbered(docs: DataFrame, order: tuple[str, str] | None = None) -> DataFrame:
    """Adds ``_n``, the place in the source. No source is sorted in one task: places are
    counted within 4,096 hash ranges of a source, and each range starts where the totals
    of the earlier ones end. ``order`` names two columns, the range and the place in it, that
    give the order instead."""
    own = docs.select(F.struct("*").alias("_row"))
    text = lambda c: F.coalesce(F.col(f"_row.{c}").cast("string"), F.lit(""))
    if order:
        range_, key = [F.col(f"_row.{c}") for c in order]
    else:
        key = F.md5(F.concat(text("doc_id"), F.lit("/"), text("text")))
        range_ = F.substring(key, 1, 3)
    rows = own.select("_row", text("source").alias("_source"), F.col("_row.source").isNull().alias("_null"), key.alias("_key"), range_.alias("_range"))
    group = ["_source", "_null", "_range"]
    ranges = rows.groupBy(*group).agg(F.count("*").alias("_size"))
    starts = ranges.select(*group, (F.sum("_size").over(
        Window.partitionBy("_source", "_null").orderBy("_range")) - F.col("_size")).alias("_start"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy("_key")) - 1)
    return placed.join(starts, group).withColumn("_n", F.col("_start") + F.col("_at"))


def period_for(sources: int, period: int = PERIOD) -> int:
    """At least ``period``, and the next power of two that gives each source ``SLOTS_EACH`` slots."""
    return max(period, 1 << (sources * SLOTS_EACH - 1).bit_length()) if sources * SLOTS_EACH > period else period


def target_weights(sizes: DataFrame, period: int) -> DataFrame:
    """``_units`` of 1 / period for each source: largest remainders over one unit each. ``sizes``
    has a row per source with its ``_raw`` weight. Sources are numbered (``_who``)."""
    every = Window.partitionBy(F.lit(0))
    raw = sizes.withColumn("_count", F.count("*").over(every))
    raw = raw.withColumn("_share", (F.lit(period) - F.col("_count")) * F.round(F.col("_raw") / F.sum("_raw").over(every), 9))
    raw = raw.withColumn("_floor", F.floor("_share")).withColumn("_spare", F.lit(period) - F.col("_count") - F.sum("_floor").over(every))
    rank = F.row_number().over(every.orderBy((F.col("_share") - F.col("_floor")).desc(), "_source", "_null"))
    return raw.withColumn("_units", (1 + F.col("_floor") + (rank <= F.col("_spare")).cast("int")).cast("int")).withColumn(
        "_who", F.row_number().over(every.orderBy("_source", "_null")) - 1)


def schedule(weights: DataFrame, period: int) -> DataFrame:
    """Which block of which source runs in each slot of a period: ``_who``, ``_index`` (block
    within the period) and ``_slot``. One row per slot.

    Sources with equal weights have equal windows and so run in turn. The state is how many
    blocks have run of each weight, of which there are at most the square root of twice the period.
    """
    classes = weights.groupBy("_units").agg(F.sort_array(F.collect_list("_who")).alias("members")).select(
        F.struct(F.col("_units").alias("units"), "members", F.size("members").alias("size")).alias("c"))
    listed = classes.agg(F.sort_array(F.collect_list("c")).alias("_all"))
    ran = F.array().cast("array<struct<who:int,index:int>>")

    def run(state, slot):
        def next_block(c, k):
            done = F.element_at(state.done, k + 1)
            index = F.floor(done / c["size"]).cast("int")
            return F.struct(
                F.ceil((index + 1) * F.lit(period) / c.units).alias("deadline"),
                F.element_at(c.members, (done % c["size"] + 1).cast("int")).alias("who"), index.alias("index"), k.alias("class"),
                ((done < c.units * c["size"]) & (index * F.lit(period) < (slot + 1) * c.units)).alias("free"))

        best = F.array_min(F.filter(F.transform("_all", next_block), lambda c: c.free))
        return F.struct(
            F.transform(state.done, lambda d, k: F.when(k == best["class"], d + 1).otherwise(d)).alias("done"),
            F.concat(state.ran, F.array(F.struct(best.who.alias("who"), best["index"].alias("index")))).alias("ran"))

    def chunk(state, first):
        begun = F.struct(state.done.alias("done"), ran.alias("ran"))
        part = F.aggregate(F.sequence(first, first + CHUNK - 1), begun, run)
        return F.struct(part.done.alias("done"), F.concat(state.chunks, F.array(part.ran)).alias("chunks"))

    start = F.struct(F.transform("_all", lambda c: F.lit(0)).alias("done"), F.array().cast("array<array<struct<who:int,index:int>>>").alias("chunks"))
    # floor(i * period / units) <= slot, in whole numbers, is i * period < (slot + 1) * units.
    made = listed.select(F.aggregate(F.sequence(F.lit(0), F.lit(period - 1), F.lit(CHUNK)), start, chunk).chunks.alias("_chunks"))
    return made.select(F.posexplode(F.flatten("_chunks")).alias("_slot", "_block")).where("_block.who is not null").select(
        F.col("_block.who").alias("_who"), F.col("_block.index").alias("_index"), "_slot")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, flatten: float = FLATTEN,
          order: tuple[str, str] | None = None) -> DataFrame:
    """The documents with ``slot``, ``place`` and ``in_mix``. ``weights``: source, weight.
    ``order``: two columns by which a source's rows are in order, as in ``numbered``."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null")).agg(
        F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    if weights is None:
        sizes = sizes.withColumn("_raw", F.pow("_blocks", F.lit(flatten)))
    else:
        given = weights.groupBy(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_null")).agg(
            F.sum(F.col("weight").cast("double")).alias("_raw"))
        sizes = sizes.join(given.where("_raw > 0"), ["_source", "_null"])
    sizes = common.staged(sizes, "mixing-sources")
    period = period_for(sizes.count(), period)
    known = common.staged(target_weights(sizes, period).select("_source", "_null", "_blocks", "_units", "_who"), "mixing-weights")
    plan = common.staged(schedule(known, period), "mixing-schedule")
    # The first slot for which a source has no block left: its block number _blocks.
    ends = known.select("_who", (F.col("_blocks") % F.col("_units")).cast("int").alias("_index"), F.floor(F.col("_blocks") / F.col("_units")).alias("_round"))
    horizon = ends.join(plan, ["_who", "_index"]).agg(F.min(F.col("_round") * period + F.col("_slot")).alias("_horizon")).first()[0]
    rows = numbered(docs, order).join(_small(known.select("_source", "_null", "_units", "_who")), ["_source", "_null"], "inner" if weights is None else "left")
    rows = rows.withColumn("_b", F.floor(F.col("_n") / F.lit(block))).withColumn("_index", (F.col("_b") % F.col("_units")).cast("int"))
    rows = rows.join(_small(plan), ["_who", "_index"], "inner" if weights is None else "left")
    slot = F.floor(F.col("_b") / F.col("_units")) * period + F.col("_slot")
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("slot", "place", "in_mix")]
    return rows.select(
        *kept, slot.alias("slot"), F.when(slot.isNotNull(), F.col("_n") % block).cast("int").alias("place"),
        F.coalesce(slot < F.lit(horizon), F.lit(False)).alias("in_mix"))


def in_mixed_order(docs: DataFrame) -> DataFrame:
    """All documents with their own columns, in files and rows that follow the mixture. Reading
    the files does not keep that order by itself; ``as_written`` tells it."""
    return mixed(docs).sort("slot", "place").select(docs.columns)


def as_written(files: DataFrame) -> DataFrame:
    """Rows read from files of ``in_mixed_order``, with the columns ``file`` and ``line``: where
    they stand there. Names of files sort as they were written."""
    name = F.col("_metadata.file_name")
    return files.select("*", F.concat(F.lpad(F.regexp_extract(name, r"part-(\d+)", 1), 12, "0"), name).alias("file"), F.col("_metadata.row_index").alias("line"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(common.documents(spark, sf_dir).select("doc_id", "source", "text")).select(
        "doc_id", "source", "slot", "place", "in_mix")


OP6_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS nul,
         row_number() OVER (PARTITION BY coalesce(source, ''), source IS NULL
           ORDER BY md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, ''))) - 1 AS n
  FROM documents),
sizes AS (SELECT s, nul, ceil(count(*) / 8.0)::BIGINT AS blocks FROM rows GROUP BY s, nul),
shares AS (
  SELECT *, (1024 - count(*) OVER ()) * round(pow(blocks, 0.7) / sum(pow(blocks, 0.7)) OVER (), 9) AS share,
         count(*) OVER () AS sources FROM sizes),
weights AS (
  SELECT s, nul, blocks, 1 + floor(share)::BIGINT + (CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, s, nul)
           <= 1024 - sources - sum(floor(share)) OVER () THEN 1 ELSE 0 END) AS units,
         row_number() OVER (ORDER BY s, nul)::INT AS i FROM shares),
listed AS (SELECT list(units ORDER BY i) AS us FROM weights),
slots AS (
  SELECT -1 AS slot, list_transform(us, lambda x: 0::BIGINT) AS done, us, 0 AS who FROM listed
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, j: d + CASE WHEN j = pick THEN 1 ELSE 0 END), us, pick
  FROM (SELECT slot, done, us,
          list_min(list_filter(list_transform(done, lambda d, j: 
            CASE WHEN d < us[j] AND d * 1024 < (slot + 2) * us[j]
                 THEN ((((d + 1) * 1024 + us[j] - 1) // us[j]) * 100000 + j)::BIGINT END), lambda x: x IS NOT NULL)) % 100000 AS pick
        FROM slots WHERE slot < 1023)),
plan AS (
  SELECT who AS i, slot, row_number() OVER (PARTITION BY who ORDER BY slot) - 1 AS idx FROM slots WHERE slot >= 0),
ended AS (
  SELECT min((blocks // units) * 1024 + slot) AS horizon FROM weights JOIN plan USING (i) WHERE idx = blocks % units),
placed AS (
  SELECT doc_id, source, ((n // 8) // units) * 1024 + slot AS slot, (n % 8)::INT AS place
  FROM rows JOIN weights USING (s, nul) JOIN plan USING (i) WHERE idx = (n // 8) % units)
SELECT doc_id, source, slot, place, slot < horizon AS in_mix FROM placed, ended
"""
