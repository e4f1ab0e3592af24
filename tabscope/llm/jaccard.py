"""Documents linked by the Jaccard similarity of their word 5-grams.

The join is a sparse matrix product, documents by n-grams with its own transpose, worked in
blocks: the blocks are the n-grams of the documents' prefixes, products are added up to
overlap counts per pair, and pairs whose count stays below the bound that both sizes imply are
dropped. What is left is decided by the exact overlap of the whole sets.

- Documents with equal sets are one node, so copies are never paired.
- N-grams are ordered: the ones counted often come last (all documents are counted; the list
  of frequent ones is bounded, and any order gives the same links). With sizes a, b and
  overlap o, 100 o >= 80 (a + b - o) needs o >= m = ceil(4/9 (a + b)), and then the two share
  one of the first a - m + 1 and b - m + 1 n-grams of theirs; as b >= 0.8 a, these are among
  the first a - ceil(0.8 a) + 1. Only products in these bounds are formed.
- Links are first looked for between each node and one hub of its n-gram blocks; the
  components these give need no further pairs inside, nor do blocks of one component. All
  pairs between different components are then tried, a 64th of them first, then an eighth,
  so that most are in one component before their turn comes; no link between components is lost.
- Each set has 512 parity bits, one bit flipped per n-gram. Two sets differ in at least as
  many n-grams as bits differ, and o >= m allows a + b - 2 m; products beyond that are not formed.

Texts are lower-cased (A-Z); documents with fewer than five words have one n-gram, their whole
sequence, and those without words none and no links. Null texts have no words. Repeated rows
are copies. A null id never names a component if another member has an id. Texts of any length are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import mix, shingle_sets

SIZE = 5
#: N-grams in more documents than this come last in the order, up to so many of them.
OFTEN, MOST_FREQUENT = 24, 1 << 17
#: Ids up to this many (4 MB) are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Nodes of a block that are met by one task at once.
BLOCK_NODES = 1024
PARITY = [f"p{k}" for k in range(8)]
FLUSH = 2_000_000


def signature(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set; equal sets have equal ones."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
    sizes = np.diff(bounds).astype(np.uint64)
    return mix(total[bounds[1:]] - total[bounds[:-1]] + mix(sizes)).view(np.int64)


def _sets(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for frame in common.row_batches(frames, "text", 500_000):
        yield frame, *shingle_sets(frame["text"].tolist(), SIZE)


def parity(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """512 bits for each set as eight numbers: whether an odd number of its hashes falls on each."""
    texts = len(bounds) - 1
    cell = np.repeat(np.arange(texts), np.diff(bounds)) * 512 + (hashes & np.uint64(511)).astype(np.int64)
    odd = (np.bincount(cell, minlength=texts * 512) & 1).astype(np.uint8).reshape(texts, 512)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, ``text_hash``, ``n_shingles``, ``node`` (the set's signature) and its parity bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, hashes, bounds in _sets(frames):
            own = pd.DataFrame(parity(hashes, bounds), columns=PARITY, index=frame.index)
            yield frame[["doc_id", "text_hash"]].assign(n_shingles=np.diff(bounds), node=signature(hashes, bounds), **own)

    return docs.mapInPandas(run, "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, " + ", ".join(f"{c} bigint" for c in PARITY))


def one_per_node(members: DataFrame) -> DataFrame:
    """(node, _id, _hash, _rows) and parity bits: the first row of each node, and how often it is there."""
    own = members.groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("_rows"), *[F.first(c).alias(c) for c in PARITY])
    rows = own.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "_rows")).alias("_r"), *[F.first(c).alias(c) for c in PARITY])
    return rows.select("node", F.col("_r.doc_id").alias("_id"), F.col("_r.text_hash").alias("_hash"), F.col("_r._rows").alias("_rows"), *PARITY)


def frequent(docs: DataFrame, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams found in most documents (their leading bits) and in how many, over all
    documents. Each task sends sorted numbers packed by range, each once with its count; a
    range is a small share of all n-grams, as ``spread`` grows with the data."""
    bits = spread.bit_length() - 1

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed(waiting):
            cells, n = np.unique(np.concatenate(waiting) >> np.uint64(40 - bits), return_counts=True)
            edges = np.searchsorted(cells >> np.uint64(24), np.arange(spread + 1, dtype=np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(edges)):
                part = slice(edges[k], edges[k + 1])
                own = (cells[part] & np.uint64(0xFFFFFF)).astype(np.uint32)
                steps = np.diff(own, prepend=own[:1])
                narrow = not (steps > 0xFFFF).any()
                often = np.flatnonzero(n[part] > 1).astype(np.uint32)
                out.append((int(k), int(own[0]), (steps.astype(np.uint16) if narrow else steps).tobytes(), narrow,
                            often.tobytes(), n[part][often].astype(np.uint32).tobytes()))
            return pd.DataFrame(out, columns=["range", "first", "steps", "narrow", "often", "times"])

        waiting, size = [], 0
        for _, hashes, _ in _sets(frames):
            waiting.append(hashes)
            size += len(hashes)
            if size >= FLUSH:
                yield packed(waiting)
                waiting, size = [], 0
        if size:
            yield packed(waiting)

    def count(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        cells, times = [], []
        for first, s, narrow, often, more in zip(frame["first"], frame["steps"], frame["narrow"], frame["often"], frame["times"]):
            cells.append(np.cumsum(np.frombuffer(s, np.uint16 if narrow else np.uint32).astype(np.uint32), dtype=np.uint32) + np.uint32(first))
            n = np.ones(len(cells[-1]), np.int64)
            n[np.frombuffer(often, np.uint32)] = np.frombuffer(more, np.uint32)
            times.append(n)
        values, own = np.unique(np.concatenate(cells), return_inverse=True)
        n = np.bincount(own, np.concatenate(times)).astype(np.int64)
        often = n > OFTEN
        return pd.DataFrame({"cell": values[often].astype(np.int64) | (int(key[0]) << 24), "n": n[often]})

    counted = docs.select("text").mapInPandas(run, "range int, first bigint, steps binary, narrow boolean, often binary, times binary").groupBy(
        "range").applyInPandas(count, "cell bigint, n bigint")
    # At most MOST_FREQUENT rows of two numbers reach the driver.
    top = counted.orderBy(F.desc("n"), "cell").limit(MOST_FREQUENT).toPandas().sort_values("cell")
    return top["cell"].to_numpy(np.uint64), top["n"].to_numpy(np.int64)


def prefixes(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], spread: int) -> DataFrame:
    """(gram, node, size, place): the first n-grams of each set in the common order, packed
    as (gram, node, shape) with size * 2**32 + place as the shape."""
    shared = docs.sparkSession.sparkContext.broadcast(often)
    shift = np.uint64(40 - (spread.bit_length() - 1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, counts = shared.value
        for _, hashes, bounds in _sets(frames):
            sizes = np.diff(bounds)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.zeros(len(hashes), np.int64)
            if len(cells):
                own = hashes >> shift
                at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
                rank = np.where(cells[at] == own, counts[at], 0)
            order = np.lexsort((hashes, rank, doc))
            place = np.arange(len(hashes)) - bounds[:-1][doc]
            taken = order[place < (sizes - -(-4 * sizes // 5) + 1)[doc]]
            node = signature(hashes, bounds)
            # Copies next to each other say the same.
            _, first = np.unique(node, return_index=True)
            once = np.zeros(len(sizes), bool)
            once[first] = True
            taken = taken[once[doc[taken]]]
            rank_in = np.empty(len(hashes), np.int64)
            rank_in[order] = place
            yield pd.DataFrame({"gram": hashes[taken].view(np.int64), "node": node[doc[taken]],
                                "shape": (sizes[doc[taken]] << 32) | rank_in[taken]})

    return docs.select("text").mapInPandas(run, "gram bigint, node bigint, shape bigint")


def shared_prefixes(prefix: DataFrame) -> DataFrame:
    """The prefix n-grams that more than one node has. All steps share one shuffle by n-gram."""
    block = Window.partitionBy("gram")
    once = prefix.repartition("gram").groupBy("gram", "node").agg(F.min("shape").alias("shape"))
    return once.withColumn("_a", F.min("node").over(block)).withColumn("_b", F.max("node").over(block)).where("_a < _b").select(
        "gram", "node", F.shiftright("shape", 32).cast("int").alias("n"),
        F.col("shape").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"))


def least_overlap(a, b):
    return F.ceil(F.lit(4.0) * (a + b) / F.lit(9.0) - F.lit(1e-9))


def in_bounds():
    """Whether the product of an n-gram of a and of b counts: sizes that can be similar enough
    (b >= 0.8 a and the reverse), and enough n-grams left after it in both sets."""
    a, b = F.col("a_n"), F.col("b_n")
    need = least_overlap(a, b)
    return (5 * a >= 4 * b) & (5 * b >= 4 * a) & (a - F.col("a_place") >= need) & (b - F.col("b_place") >= need)


def hub_pairs(blocks: DataFrame) -> DataFrame:
    """For each node the hub it shares most blocks with. ``blocks`` has gram, node, n, place.

    The same nodes are hubs wherever they are, which ties most groups. Hubs only save work:
    what stays apart is tried in full later.
    """
    first = blocks.groupBy("gram").agg(F.min_by(F.struct("node", "n", "place"), F.xxhash64("node")).alias("hub"))
    met = blocks.join(first, "gram").where("node <> hub.node").select(
        F.col("node").alias("a"), F.col("n").alias("a_n"), F.col("place").alias("a_place"),
        F.col("hub.node").alias("b"), F.col("hub.n").alias("b_n"), F.col("hub.place").alias("b_place"))
    pairs = met.where(in_bounds()).groupBy("a", "a_n", "b", "b_n").agg(F.count("*").alias("shared")).where("50 * shared >= a_n")
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("a", "a_n", "b", "b_n")


def open_blocks(blocks: DataFrame, edges: DataFrame, once: DataFrame) -> DataFrame:
    """The blocks that hold nodes of different components, with these and the parity bits.
    ``_parts`` is the number of tasks among which a large block's pairs are dealt."""
    live = common.staged(with_components(blocks, edges), "jaccard-live")
    mixed = live.groupBy("gram").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_nodes")).where("_a < _b")
    mixed = common.staged(mixed.select("gram", F.ceil(F.col("_nodes") / BLOCK_NODES).cast("int").alias("_parts")), "jaccard-mixed")
    left = common.staged(live.join(mixed, "gram"), "jaccard-left")
    wanted = common.staged(left.select("node").distinct().join(once.select("node", *PARITY), "node"), "jaccard-bits")
    return common.staged(left.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS // 8 else wanted, "node"), "jaccard-open")


def open_pairs(blocks: DataFrame, every: int = 1) -> DataFrame:
    """All pairs between different components with a product in the bounds, or one in ``every``
    of them. Of a large block each task has a part of the nodes to meet all others."""
    side = lambda c, x: [F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("place").alias(f"{c}_place"), F.col("component").alias(x),
                         *[F.col(p).alias(f"{c}_{p}") for p in PARITY]]
    left = blocks.select("gram", F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int").alias("_part"), *side("a", "_x"))
    right = blocks.select("gram", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), *side("b", "_y"))
    differ = sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in PARITY), F.lit(0))
    near = differ <= F.col("a_n") + F.col("b_n") - 2 * least_overlap(F.col("a_n"), F.col("b_n"))
    test = (F.col("_x") < F.col("_y")) & in_bounds() & near
    if every > 1:
        test = test & (F.xxhash64("a", "b") % every == 0)
    return left.join(right, ["gram", "_part"]).where(test).select("a", "a_n", "b", "b_n").distinct()


def small(df: DataFrame) -> DataFrame:
    """The table marked for a broadcast if it is staged and has few rows of a few numbers."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def sets_of(docs: DataFrame, once: DataFrame, wanted: DataFrame, share: int) -> DataFrame:
    """(node, grams, n_grams): the sets of the wanted nodes as packed sorted numbers, of which
    only those in the first of ``share`` equal ranges are kept."""
    rows = common.staged(once.join(wanted, "node").select("node", "_id", "_hash", "_rows"), "jaccard-wanted")
    repeated = not rows.where("_rows > 1").isEmpty()
    last = np.uint64((1 << 64) // share - 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, hashes, bounds in _sets(frames):
            kept = [hashes[a : a + np.searchsorted(hashes[a:b], last, side="right")] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pd.DataFrame({"node": frame["node"].to_numpy(), "grams": [k.tobytes() for k in kept], "n_grams": [len(k) for k in kept]})

    chosen = docs.join(small(rows), (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    made = chosen.mapInPandas(run, "node bigint, grams binary, n_grams int")
    return common.staged(made.dropDuplicates(["node"]) if repeated else made, "jaccard-sets")


def overlaps(pairs: Iterator[tuple[bytes, bytes]]) -> list[int]:
    out = []
    for a, b in pairs:
        both = np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
        both.sort()
        out.append(int((both[1:] == both[:-1]).sum()))
    return out


def links(pairs: DataFrame, docs: DataFrame, once: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough, by their whole sets.

    First only a quarter of the n-grams is compared, those in the first range of hashes: what
    they share and all of the rest together bounds the overlap, which rules out most pairs.
    """
    return compared(compared(pairs, docs, once, 4), docs, once, 1).select("a", "b")


def compared(pairs: DataFrame, docs: DataFrame, once: DataFrame, share: int) -> DataFrame:
    """The pairs whose overlap, counted in the first of ``share`` ranges, can still suffice."""
    pairs = common.staged(pairs, "jaccard-pairs")
    sets = sets_of(docs, once, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), share)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1000):
                frame = whole.iloc[at : at + 1000]
                o = np.array(overlaps(zip(frame["a_grams"], frame["b_grams"])), np.int64)
                a, b = frame["a_n"].to_numpy(np.int64), frame["b_n"].to_numpy(np.int64)
                o += np.minimum(a - frame["a_seen"].to_numpy(np.int64), b - frame["b_seen"].to_numpy(np.int64))
                yield frame.loc[100 * o >= 80 * (a + b - o), ["a", "a_n", "b", "b_n"]]

    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("a_grams"), F.col("n_grams").alias("a_seen"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("b_grams"), F.col("n_grams").alias("b_seen"))
    both = left.join(small(pairs), "a").join(right, "b")
    return common.staged(both.mapInPandas(run, "a bigint, a_n int, b bigint, b_n int"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes with an edge: the least node that edges reach.

    Large and small stars in turn: every node's larger neighbours, then its smaller ones, are
    tied to the least, until nothing changes. Work is by joins and minima; no neighbourhood
    is collected.
    """
    at = common.staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        told = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(told) == before:
            break
        before = tuple(told)
        both = at.union(at.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        at = common.staged(near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", "m")).where("u <> v").distinct(), "components")
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).union(at.select("v", "v").distinct()).groupBy("node").agg(
        F.min("component").alias("component"))


def with_components(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    known = small(common.staged(components(edges), "jaccard-components"))
    return blocks.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))


def node_links(docs: DataFrame, once: DataFrame) -> DataFrame:
    """Links that tie together all nodes that any links tie together."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spread = 1 << max(6, math.ceil(math.log2(size / 4e6 + 1)))
    blocks = common.staged(shared_prefixes(prefixes(docs, frequent(docs, spread), spread)), "jaccard-blocks")
    edges = links(hub_pairs(blocks), docs, once)
    # Few of the open pairs tie most members that the hub did not, so that far fewer
    # pairs are left open for the last round, which tries every one.
    for every in (64, 8, 1):
        blocks = open_blocks(blocks.select("gram", "node", "n", "place"), edges, once)
        edges = edges.union(links(open_pairs(blocks, every), docs, once))
    return edges


def tied(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and ``tie``, the same for all rows of a linked group;
    rows without words have none."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    members = common.staged(nodes(rows), "jaccard-nodes")
    once = common.staged(one_per_node(members), "jaccard-once")
    # Staged, so that rows of a node with very many copies can be split among tasks.
    known = small(common.staged(components(node_links(rows, once)), "jaccard-components"))
    return members.join(known, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("tie"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for each row: the least doc_id reachable."""
    rows = common.staged(tied(docs), "jaccard-ties")
    # Only groups of several rows need to be looked up.
    least = rows.where("tie is not null").groupBy("tie").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows")).where("_rows > 1")
    least = small(common.staged(least.drop("_rows"), "jaccard-least"))
    return rows.join(least, "tie", "left").select("doc_id", "n_shingles", F.coalesce("_least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each linked group: the row with the least id and
    text hash stays, ids before none, and of repeated rows one. Rows without words all stay."""
    rows = common.staged(tied(docs).where("tie is not null"), "jaccard-ties")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stays = rows.groupBy("tie").agg(F.count("*").alias("_size"), F.min(order).alias("_first")).where("_size > 1")
    met = rows.join(small(common.staged(stays, "jaccard-stays")), "tie").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
        (~(F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("text_hash") == F.col("_first.text_hash")))).alias("_goes"))
    met = common.staged(met.distinct(), "jaccard-met")
    named = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    beside = F.broadcast(met) if met.count() <= BROADCAST_IDS else met
    left = named.join(beside, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")), "left").where("_goes is null or not _goes")
    # A group's own row may be there several times.
    once = left.where("not _goes").groupBy("_d", "_h").agg(F.first("_row").alias("_row"))
    return left.where("_goes is null").select("_row.*").unionByName(once.select("_row.*"))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    return grouped(common.documents(spark, sf_dir))
