"""Quartile bucket digests of documents.

Byte triplets are hashed into buckets and counted; each bucket becomes the quartile its
count lies in, two bits each, and the length goes in front as a logarithm. Two digests are
compared by a bounded difference of the quartiles and the length.

Null texts count as empty. Texts of under three bytes have no triplets: all their buckets
are in the lowest quartile. Ties in the order of documents are broken by the text; rows
without an id come last. Whole texts are counted, however long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabscope.llm.common import documents, row_batches

BUCKETS = 256
#: Differences at or beyond which two digests have nothing in common: what digests of
#: independent counts differ by on average, per bucket (quartiles 0-3, far ones weighing more).
UNRELATED = 1.75
LENGTH_STEP = 1.1
_FAR = np.array([0.0, 1.0, 2.0, 6.0])
_SHUFFLED = np.random.Generator(np.random.PCG64(7)).permutation(256).astype(np.uint8)


def counts_of(data: bytes) -> np.ndarray:
    """How many triplets fall in each bucket; triplets are the bytes at 0, 1, 2 and at 0, 1, 3."""
    b = np.frombuffer(data, np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    if len(b) < 3:
        return total
    head = _SHUFFLED[_SHUFFLED[b[:-2]] ^ b[1:-1]]
    total += np.bincount(_SHUFFLED[head ^ b[2:]], minlength=BUCKETS)
    if len(b) > 3:
        total += np.bincount(_SHUFFLED[(head[:-1] ^ 0x55) ^ b[3:]], minlength=BUCKETS)
    return total


def quartiles_of(counts: np.ndarray) -> np.ndarray:
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)


def length_code(n: int) -> int:
    return min(255, round(math.log(n + 1, LENGTH_STEP)))


def fingerprint(data: bytes) -> tuple[str, np.ndarray, int]:
    quartiles, length = quartiles_of(counts_of(data)), length_code(len(data))
    packed = quartiles.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex(), quartiles, length


def unpacked(text: str) -> tuple[np.ndarray, int]:
    data = np.frombuffer(bytes.fromhex(text), np.uint8)
    return ((data[1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(-1), int(data[0])


def likeness(a: np.ndarray, a_length: int, b: np.ndarray, b_length: int) -> float:
    """1 for equal digests, falling to 0 as the difference nears that of unrelated counts."""
    apart = _FAR[np.abs(a.astype(np.int8) - b.astype(np.int8))].mean()
    return max(0.0, 1.0 - apart / UNRELATED - min(1.0, abs(a_length - b_length) / 64))


def compare(first: str, second: str) -> float:
    return likeness(*unpacked(first), *unpacked(second))


def in_order(docs: DataFrame, rows_each: int = 2000, most: int = 4096) -> DataFrame:
    """doc_id and text in spans of ids, each span sorted, with each span's first row also
    sent to the span before it (``_last``), so that every row meets its successor.

    Spans are cut at quantiles of the ids, whatever these are, and hold about ``rows_each`` rows;
    beyond ``most`` spans they grow. The driver learns one row for each span. Rows without an
    id are the last span.
    """
    spark = docs.sparkSession
    n = docs.select("doc_id").count()
    grid = max(1, min(most, n // rows_each))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / grid for k in range(1, grid)], 20 * grid)).first()[0] if grid > 1 else []
    cuts = sorted(set(cuts or []))
    # Nulls are the last span; of the others as many cuts lie below as the span's number.
    number = Bucketizer(splits=[float("-inf"), *sorted({float(c) for c in cuts}), float("inf")], inputCol="_id", outputCol="_span") if cuts else None
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("_id"))
    rows = number.transform(rows) if number else rows.withColumn("_span", F.lit(0.0))
    span = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.col("_span")).cast("int")
    rows = rows.select("doc_id", "text", span.alias("_span"))
    starts = sorted(tuple(r) for r in rows.groupBy("_span").agg(F.min("doc_id")).collect())
    names = [s for s, _ in starts]
    before = dict(zip(names, names[-1:] + names[:-1]))
    told = spark.createDataFrame([(s, least, before[s]) for s, least in starts], "_s int, _least bigint, _before int")
    moved = (
        rows.join(F.broadcast(told), (F.col("_span") == F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_least")))
        .groupBy("doc_id", F.col("_before").alias("_span")).agg(F.min("text").alias("text"))
        .select("doc_id", "text", "_span", F.lit(True).alias("_last"))
    )
    return (
        rows.withColumn("_last", F.lit(False)).unionByName(moved)
        .repartition("_span").sortWithinPartitions("_span", "_last", "doc_id", "text")
        # As text, because pandas would round large numbers beside missing ones.
        .withColumn("doc_id", F.col("doc_id").cast("string"))
    )


EDITED = ("doc_id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def edited_text(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by span; a row is done once its successor is seen."""
    held = None
    for frame in row_batches(frames, "text", 1_000_000):
        out = []
        for doc_id, text, span, last in zip(frame["doc_id"], frame["text"], frame["_span"], frame["_last"]):
            text = text if isinstance(text, str) else ""
            data = text.encode("utf-8", "replace")
            print_, quartiles, length = fingerprint(data)
            if held is not None and held[0] == span:
                _, h_id, h_text, h_print, h_quartiles, h_length = held
                edited = edited_text(h_text, text).encode("utf-8", "replace")
                e_print, e_quartiles, e_length = fingerprint(edited)
                out.append((h_id, len(h_text), hashlib.sha256(edited).hexdigest(), h_print, e_print,
                            likeness(h_quartiles, h_length, e_quartiles, e_length),
                            likeness(h_quartiles, h_length, quartiles, length)))
            held = None if last else (span, doc_id, text, print_, quartiles, length)
        if out:
            done = pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])
            yield done


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's digest beside that of its edited text and of the next document."""
    return compared(in_order(docs))


def compared(ordered: DataFrame) -> DataFrame:
    return ordered.mapInPandas(compare_in_order, EDITED).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` to any table with a text column."""
    kept = docs.drop("fingerprint")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [fingerprint(t.encode("utf-8", "replace") if isinstance(t, str) else b"")[0] for t in frame["text"]]
            yield frame.assign(fingerprint=pd.Series(made, index=frame.index, dtype="object"))

    return kept.mapInPandas(run, StructType([*kept.schema.fields, StructField("fingerprint", StringType())]))


def op10_digest(spark, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir).select("doc_id", "text"))
