"""Removal of long repeated strings by refining buckets of suffixes.

A byte goes when it is covered by a string of ``length`` bytes that also starts elsewhere.
Suffixes are first put into buckets by one q-gram each: of all q-grams in the first
``length`` bytes the one with the least hash, so equal strings choose alike. Neighbouring
suffixes that choose the same q-gram form a block and share most of their bytes; a block is
one row. Buckets with one row are done. The others are refined by the bucket identifiers of
the bytes at later offsets: first of whole blocks, where equal ones are done together, then of
ever smaller pieces of those that still differ, down to single suffixes. Identifiers are
hashes made of the identifiers of shorter strings (running sums), so that no global numbering
is needed and identifiers once found serve all later rounds. Only representatives of equal
pieces go on, and no bucket is ever gathered: its rows are only counted.

Strings never span documents. Null texts are empty. Repeated rows count as different
documents, so they lose all they share. Texts of any length are taken in overlapping pieces.
Hashes have 64 bits, and two of them have to agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import mix, piece_hash, sums_of

LENGTH, GRAM = 400, 32
#: How many neighbouring suffixes the pieces of each round hold.
WIDTHS = (64, 8, 1)
PIECE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
IDENTITY = ("doc_id", "row_hash")


def least_places(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each full window of hashes the place of the least one, the leftmost of equals.

    Minima from block starts and to block ends, which two together give any window's.
    """
    n = len(hashes)
    marked = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // window) * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = marked
    rows = padded.reshape(-1, window)
    from_start = np.minimum.accumulate(rows, axis=1).ravel()
    to_end = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(to_end[: n - window + 1], from_start[window - 1 : n]) & _PLACE).astype(np.int64)


def pieces_of(texts: list[bytes], length: int, most: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (text, offset, bytes) to work on at once; long texts in pieces that overlap
    so that every string starts in exactly one of them."""
    group, size = [], 0
    for k, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), most):
            piece = text[offset : offset + most + length - 1]
            if group and size + len(piece) > most + length:
                yield group
                group, size = [], 0
            group.append((k, offset, piece))
            size += len(piece)
    if group:
        yield group


def blocks_of(texts: list[bytes], length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    """Blocks of suffixes: text, start, n suffixes, place of the q-gram, bucket, content
    identifier, and how many equal blocks follow one another."""
    for group in pieces_of(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        sums = sums_of(data)
        at = np.arange(len(data) - gram + 1)
        hashes = piece_hash(sums, at, at + gram)
        place = least_places(hashes, length - gram + 1)
        ends = np.cumsum([len(p) for _, _, p in group])
        owner = np.repeat(np.arange(len(group)), [len(p) - length + 1 for _, _, p in group])
        first = ends - np.array([len(p) for _, _, p in group])
        counts = np.bincount(owner, minlength=len(group))
        start = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = place[start]
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
        n = np.diff(np.append(new, len(start)))
        begin, place, owner = start[new], place[new], owner[new]
        lead = place - begin
        content = mix(piece_hash(sums, begin, begin + n - 1 + length)
                      + lead.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        bucket = hashes[place]
        # Periodic text makes equal blocks in a row; they are one row that counts several times.
        same = (content[1:] == content[:-1]) & (bucket[1:] == bucket[:-1]) & (owner[1:] == owner[:-1])
        head = np.flatnonzero(np.concatenate(([True], ~same)))
        times = np.diff(np.append(head, len(begin)))
        keys = np.array([k for k, _, _ in group])
        offsets = np.array([o for _, o, _ in group])
        owner = owner[head]
        yield {"text": keys[owner], "start": begin[head] - first[owner] + offsets[owner], "n": n[head], "lead": lead[head],
               "bucket": bucket[head].view(np.int64), "content": content[head].view(np.int64), "times": times}


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def identified(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; equal rows lose the same bytes."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("doc_id"),
                       F.xxhash64("text").alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"))


def suffix_blocks(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", PIECE):
            for made in blocks_of(_bytes(frame["text"]), length, gram):
                own = made.pop("text")
                yield pd.DataFrame({**{c: frame[c].to_numpy()[own] for c in IDENTITY}, **made})

    return rows.mapInPandas(run, "doc_id bigint, row_hash bigint, start int, n int, lead int, bucket bigint, content bigint, times int")


def refined(pieces: DataFrame) -> DataFrame:
    """Pieces (``bucket``, ``content``, ``times``) that are repeated or not yet decided.

    A content that occurs twice is repeated. A bucket with several contents, one of them
    single, stays open, and of each content in it only one piece goes on (``ahead``).
    """
    named = pieces.withColumn("_id", F.xxhash64(*IDENTITY, "start"))
    contents = named.groupBy("bucket", "content").agg(F.sum("times").alias("total"), F.min("_id").alias("_first"))
    buckets = contents.groupBy("bucket").agg(
        (F.count("*") > 1).alias("_several"), (F.min("total") == 1).alias("_single")).where("_several and _single")
    wanted = contents.join(buckets.select("bucket", F.lit(True).alias("_open")), "bucket", "left").where("total > 1 or _open")
    return named.join(wanted, ["bucket", "content"]).withColumn(
        "ahead", F.coalesce("_open", F.lit(False)) & (F.col("_id") == F.col("_first"))).where("total > 1 or ahead").drop("_id", "_first", "_open")


def cut_out(rows: DataFrame, ahead: DataFrame, length: int) -> DataFrame:
    """The bytes of the pieces that go on: all strings that start in the piece."""
    grouped = ahead.groupBy(*IDENTITY).agg(F.collect_set(F.struct(
        "start", "n", "lead", "bucket", (F.col("total") > 1).cast("int").alias("known"))).alias("_pieces"))
    joined = rows.join(grouped, list(IDENTITY))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", PIECE):
            out = []
            for doc_id, row_hash, text, pieces in zip(frame["doc_id"], frame["row_hash"], frame["text"], frame["_pieces"]):
                data = text.encode("utf-8", "replace")
                for p in pieces:
                    out.append((doc_id, row_hash, p["start"], p["n"], p["lead"], p["bucket"], p["known"],
                                data[p["start"] : p["start"] + p["n"] - 1 + length]))
            yield pd.DataFrame(out, columns=["doc_id", "row_hash", "start", "n", "lead", "bucket", "known", "data"])

    return joined.mapInPandas(run, "doc_id bigint, row_hash bigint, start int, n int, lead int, bucket bigint, known int, data binary")


def smaller(cuts: DataFrame, width: int, length: int) -> DataFrame:
    """Cuts pieces into aligned ones of at most ``width`` suffixes. The new bucket is made of
    the old one and the identifier of the bytes that all suffixes of a full piece share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 512):
                frame = whole.iloc[at : at + 512]
                sizes = frame["n"].to_numpy(np.int64) - 1 + length
                first = np.cumsum(sizes) - sizes
                sums = sums_of(np.frombuffer(b"".join(frame["data"]), np.uint8))
                lead, n = frame["lead"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
                # A suffix's distance d to the q-gram falls from lead to lead - n + 1.
                least, most = lead - n + 1, lead
                phases = most // width - least // width + 1
                row = np.repeat(np.arange(len(frame)), phases)
                phase = np.arange(len(row)) - np.repeat(np.cumsum(phases) - phases, phases) + (least // width)[row]
                low, high = np.maximum(phase * width, least[row]), np.minimum(phase * width + width - 1, most[row])
                start_of = lambda d: first[row] + lead[row] - d
                core = piece_hash(sums, start_of(phase * width), start_of(phase * width + width - 1) + length)
                old = frame["bucket"].to_numpy(np.int64).view(np.uint64)[row]
                bucket = mix(core + old * np.uint64(0x9FB21C651E98DF25) + phase.astype(np.uint64))
                content = mix(piece_hash(sums, start_of(high), start_of(low) + length) + bucket
                              + low.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (high - low).astype(np.uint64))
                yield pd.DataFrame({
                    **{c: frame[c].to_numpy()[row] for c in IDENTITY},
                    "start": frame["start"].to_numpy()[row] + lead[row] - high, "n": high - low + 1, "lead": high,
                    "bucket": bucket.view(np.int64), "content": content.view(np.int64),
                    "times": frame["known"].to_numpy()[row] + 1})

    return cuts.mapInPandas(run, "doc_id bigint, row_hash bigint, start int, n int, lead int, bucket bigint, content bigint, times int")


def cut_again(cuts: DataFrame, ahead: DataFrame, length: int) -> DataFrame:
    """The bytes of smaller pieces, out of those of the pieces they were cut from."""
    inner = ahead.select(*IDENTITY, F.col("start").alias("_start"), F.col("n").alias("_n"), F.col("lead").alias("_lead"),
                         F.col("bucket").alias("_bucket"), (F.col("total") > 1).cast("int").alias("_known"))
    own = cuts.select(*IDENTITY, "start", "n", "data")
    inside = (F.col("_start") >= F.col("start")) & (F.col("_start") + F.col("_n") <= F.col("start") + F.col("n"))
    return inner.join(own, list(IDENTITY)).where(inside).select(
        *IDENTITY, F.col("_start").alias("start"), F.col("_n").alias("n"), F.col("_lead").alias("lead"), F.col("_bucket").alias("bucket"),
        F.col("_known").alias("known"), F.substring("data", F.col("_start") - F.col("start") + 1, F.col("_n") - 1 + length).alias("data"))


def repeated_starts(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(doc_id, row_hash, start, n): runs of n suffixes whose first ``length`` bytes also start elsewhere."""
    blocks = common.staged(suffix_blocks(rows, length, gram), "suffix-blocks")
    state = common.staged(refined(blocks), "suffix-buckets")
    found = state.where("total > 1").select(*IDENTITY, "start", (F.col("n") * F.col("times")).alias("n"))
    cuts = None
    for width in widths:
        ahead = state.where("ahead")
        cuts = common.staged(cut_out(rows, ahead, length) if cuts is None else cut_again(cuts, ahead, length), "suffix-cuts")
        state = common.staged(refined(smaller(cuts, width, length)), "suffix-buckets")
        found = found.unionByName(state.where("total > 1").select(*IDENTITY, "start", "n"))
    return found


def without_spans(data: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> tuple[bytes, int]:
    """What is left after the strings at the runs of starts are taken out, and how many spans that were."""
    if not len(starts):
        return data, 0
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, widths: tuple[int, ...] = WIDTHS, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is kept: bytes, or with ``digest`` their SHA-256."""
    rows = identified(docs)
    runs = repeated_starts(rows, length, gram, widths).groupBy(*IDENTITY).agg(
        F.collect_set(F.struct("start", "n")).alias("_runs"))
    kind = "kept_sha256 string" if digest else "kept binary"
    name = kind.split()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 1_000_000):
            out = []
            for doc_id, text, found in zip(frame["doc_id"], frame["text"], frame["_runs"]):
                data = text.encode("utf-8", "replace")
                found = [] if found is None else found
                kept, spans = without_spans(data, np.array([r["start"] for r in found], np.int64),
                                            np.array([r["n"] for r in found], np.int64), length)
                out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    done = rows.join(runs, list(IDENTITY), "left").select("doc_id", "text", "_runs").mapInPandas(
        run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {kind}")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 62), F.col("doc_id")))


def op1_suffixes(spark, sf_dir: str) -> DataFrame:
    return removed(common.documents(spark, sf_dir), digest=True)
