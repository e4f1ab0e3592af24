"""Scores of texts by a causal self-attention model on subword ids.

A text is lower-cased (A-Z) and read as words and one end. Every word's subword ids are those
of a public vocabulary for a space and the word, so a space opens each word and the ids give
the words back: the model's probability of a text is that of its ids and the end.

The model sees classes of ids. The most frequent ids are classes of their own; every other id
is in one of a few groups, by the class that most often precedes it, and has its share of the
group by smoothed counts. Counts cover all texts to learn from: pairs of neighbouring ids are
counted by tasks and summed by Spark, and give the classes, the shares and the table of what
follows what. The attention weights are trained in numpy by several trainers at once, each on
windows dealt to it, and averaged after each round. Every window of the texts to learn from is
trained on in one of the rounds, so more text means more windows and more trainers, each
with about ``WINDOW_TOKENS`` tokens a round; sums of weights are formed in groups of 64.

Beside the model's score stands the base: word counts plus one, over all texts to learn
from. Words are compared by 64-bit hashes. Counts of the ``FREQUENT`` most frequent words are sent to
all tasks; all other words, none of them frequent, are looked up by a join.

Null and empty texts are just an end. A null id is the empty string in the fold's checksum.
Repeated rows are texts of their own. Texts of any length are scored whole. Without any text
to learn from, counts are zero and the model untrained. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.attention import Adam, Model, Weights, smoothed, windows
from tabscope.llm.words import mix, words_of

END, IDS = 50256, 50257
#: Classes: the most frequent ids, the end, and groups of the other ids.
HEAD, GROUPS = 511, 64
#: They lie in as many blocks of as many classes.
BLOCKS = 24
SPAN, HEADS, WIDTH = 16, 1, 16
ROUNDS, WINDOW_TOKENS, BATCH = 2, 1 << 20, 256
RATE, DECAY, BACK_OFF = 0.02, 1e-3, 20.0
FREQUENT = 1 << 17
FLUSH, CHARACTERS = 500_000, 500_000
REMEMBERED, LONGEST = 150_000, 4096
FAN_IN = 64


def read_ranks(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


class Subwords:
    """Ids of single words, remembered by hash up to a bound."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("subwords", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.opens = np.zeros(IDS, bool)
        self.opens[[i for t, i in table.items() if t.startswith(b" ")]] = True
        self.known: dict[int, bytes] = {}

    def of(self, word: str) -> bytes:
        # Very long words in pieces, which the library takes in bounded time and depth.
        ids = self.encoding.encode_ordinary(" " + word[:LONGEST])
        for at in range(LONGEST, len(word), LONGEST):
            ids += self.encoding.encode_ordinary(word[at : at + LONGEST])
        return struct.pack(f"{len(ids)}H", *ids)

    def of_all(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word. Words are encoded as one text with a space before each, where
        each starts anew, unless some is long or holds white space of its own."""
        text = (b" " + b" ".join(words)).decode("utf-8")
        if max(map(len, words)) <= LONGEST and len(text.split()) == len(words):
            ids = np.array(self.encoding.encode_ordinary(text), np.uint16)
            edges = np.flatnonzero(self.opens[ids])
            if len(edges) == len(words):
                whole, edges = ids.tobytes(), [*(2 * edges).tolist(), 2 * len(ids)]
                return [whole[a:b] for a, b in zip(edges, edges[1:])]
        return [self.of(w.decode("utf-8")) for w in words]

    def listed(self, words, hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Ids of the words at these places, which have these hashes."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        keys = hashes.tolist()
        out = [self.known.get(h) for h in keys]
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            data = words.data.tobytes()
            made = self.of_all([data[a:b] for a, b in zip(words.start[at[new]].tolist(), words.stop[at[new]].tolist())])
            for k, ids in zip(new, made):
                out[k] = self.known[keys[k]] = ids
        return out


_subwords: dict[bytes, Subwords] = {}


def subwords_of(ranks: bytes) -> Subwords:
    """The vocabulary as this process has it, with the words it knows already."""
    key = hashlib.sha256(ranks).digest()
    if key not in _subwords:
        _subwords[key] = Subwords(ranks)
    return _subwords[key]


def forget_subwords() -> None:
    """Frees the vocabulary in a worker that goes on with other work."""
    _subwords.clear()


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def summed_by(parts: Iterator[tuple[np.ndarray, ...]], most: int = FLUSH) -> Iterator[tuple[np.ndarray, ...]]:
    """Adds up (keys, counts...) over equal keys, as far as a buffer of so many keys goes."""
    waiting: list[tuple[np.ndarray, ...]] = []
    size = 0

    def added():
        keys, own = np.unique(np.concatenate([w[0] for w in waiting]), return_inverse=True)
        return keys, *[np.bincount(own, np.concatenate([w[k] for w in waiting]), minlength=len(keys)).astype(np.int64) for k in range(1, len(waiting[0]))]

    for part in parts:
        waiting.append(part)
        size += len(part[0])
        if size >= most:
            yield added()
            waiting, size = [], 0
    if waiting:
        yield added()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c, n): how often each word is in texts to learn from, and in all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted():
            for frame in frames:
                for part in common.row_batches(iter([frame]), "text", CHARACTERS):
                    words = words_of(part["text"].tolist(), lower=True)
                    keys, own, n = np.unique(words.hashes(), return_inverse=True, return_counts=True)
                    learned = ~part["held_out"].to_numpy(bool)[words.doc]
                    yield keys, np.bincount(own, learned, minlength=len(keys)), n

        for keys, c, n in summed_by(counted()):
            yield pd.DataFrame({"word": keys.view(np.int64), "c": c, "n": n})

    return rows.select("held_out", "text").mapInPandas(run, "word bigint, c bigint, n bigint").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("n").alias("n"))


def encoded(rows: DataFrame, counts: DataFrame, ranks: bytes, most_frequent: int = FREQUENT) -> DataFrame:
    """row, doc_id, held_out, n_tokens, ``ids`` (16-bit numbers), what frequent words and the
    end add to n_known and to the sum of log10(c + 1), and the words to look up."""
    top = counts.orderBy(F.desc("n"), "word").limit(most_frequent).select("word", "c").toPandas()
    order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    ends = rows.where("not held_out").count()
    context = rows.sparkSession.sparkContext
    table = context.broadcast((top["word"].to_numpy(np.int64).view(np.uint64)[order], top["c"].to_numpy(np.int64)[order]))
    shared = context.broadcast(ranks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, (often, counted) = subwords_of(shared.value), table.value
        for part in common.row_batches(frames, "text", CHARACTERS):
            words = words_of(part["text"].tolist(), lower=True)
            texts = len(part)
            keys, at, own = np.unique(words.hashes(), return_index=True, return_inverse=True)
            listed = subwords.listed(words, keys, at)
            sizes = np.fromiter(map(len, listed), np.int64, len(listed)) // 2
            flat = np.frombuffer(b"".join(listed), np.uint16)
            first, each = np.cumsum(sizes) - sizes, sizes[own]
            places = np.repeat(first[own] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            ids = flat[places]
            bounds = np.concatenate(([0], np.cumsum(each)))[words.first]
            here = np.minimum(np.searchsorted(often, keys), max(len(often) - 1, 0))
            found = often[here] == keys if len(often) else np.zeros(len(keys), bool)
            c = np.where(found, counted[here] if len(often) else 0, 0)
            total = np.bincount(words.doc, np.log10(c + 1.0)[own], minlength=texts) + np.log10(ends + 1.0)
            known = np.bincount(words.doc, (c > 0)[own], minlength=texts).astype(np.int64) + (ends > 0)
            rare = ~found[own]
            # Each text's rare words, each once: text and word as one number.
            pair, n = np.unique(words.doc[rare] * len(keys) + own[rare], return_counts=True)
            edges = np.searchsorted(pair, np.arange(texts + 1) * len(keys))
            look = keys[pair % max(len(keys), 1)].view(np.int64)
            yield pd.DataFrame({
                "row": part["row"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "no_id": part["no_id"].to_numpy(), "held_out": part["held_out"].to_numpy(),
                "n_tokens": words.counts + 1, "known": known, "total": total,
                "ids": [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])],
                "words": [look[a:b] for a, b in zip(edges[:-1], edges[1:])], "times": [np.asarray(n[a:b], np.int64) for a, b in zip(edges[:-1], edges[1:])]})

    return rows.mapInPandas(run, "row bigint, doc_id bigint, no_id boolean, held_out boolean, n_tokens bigint, known bigint, total double, ids binary, "
                                 "words array<bigint>, times array<bigint>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(before, id, n): neighbours in the texts to learn from; the end stands before and after each."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def counted():
            for part in common.row_batches(frames, "ids", 1 << 20):
                texts = [np.frombuffer(t, np.uint16) for t in part["ids"]]
                end = np.array([END], np.uint16)
                data = np.concatenate([end, *chain.from_iterable((t, end) for t in texts)]).astype(np.int64)
                keys, n = np.unique(data[:-1] * IDS + data[1:], return_counts=True)
                yield keys, n

        for keys, n in summed_by(counted()):
            yield pd.DataFrame({"before": keys // IDS, "id": keys % IDS, "n": n})

    return rows.where("not held_out").select("ids").mapInPandas(run, "before int, id int, n bigint").groupBy("before", "id").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """``classes`` and ``share`` (log of an id's share of its class) by id; the class of the
    end; the table by neighbouring classes; the attention weights."""

    classes: np.ndarray
    share: np.ndarray
    end: int
    table: np.ndarray
    weights: Weights

    def model(self) -> Model:
        return Model(self.weights, self.table)

    def log10(self, model: Model, texts: list[np.ndarray]) -> np.ndarray:
        """The log10 probability of each text, given its ids."""
        given, wanted, own = windows([self.classes[t] for t in texts], self.end, self.weights.distance.shape[1] // 2)
        total = np.bincount(own, model.log_probabilities(given, wanted).sum(axis=1), minlength=len(texts))
        sizes = [len(t) for t in texts]
        shares = np.bincount(np.repeat(np.arange(len(texts)), sizes), self.share[np.concatenate(texts)] if sum(sizes) else [], minlength=len(texts))
        return (total + shares) / np.log(10.0)


def classes_of(pairs: DataFrame, head: int = HEAD, groups: int = GROUPS, blocks: int = BLOCKS) -> LanguageModel:
    """The counted parts of a model, with fresh weights. The driver learns the counts of at
    most 50,257 ids, what precedes them most, and the pairs of at most ``head`` + 1 + ``groups`` classes."""
    spark = pairs.sparkSession
    n = np.zeros(IDS)
    for r in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():
        n[r.id] = r.n
    order = np.lexsort((np.arange(IDS), -n))
    own = [i for i in order[: head + 1].tolist() if i != END and n[i] > 0][:head]
    end, count = len(own), len(own) + 1 + groups
    classes = np.full(IDS, count - 1)
    classes[own], classes[END] = np.arange(len(own)), end
    # As an Arrow table, which needs no Python workers of another kind that would stay beside those of the tasks.
    mapped = lambda name: F.broadcast(spark.createDataFrame(pa.table({name: np.arange(IDS), f"{name}_class": classes})))
    # What most often precedes an id: that of frequent ids sorts them into blocks, that of the others names a group.
    before = pairs.join(mapped("before"), "before").groupBy("id", "before_class").agg(F.sum("n").alias("n"))
    leads = {r.id: r.c for r in before.groupBy("id").agg(F.max_by("before_class", F.struct("n", "before_class")).alias("c")).collect()}
    weight = np.zeros(count)
    for i, c in leads.items():
        if classes[i] > end:
            weight[c] += n[i]
    rank = {c: k for k, c in enumerate(np.lexsort((np.arange(count), -weight))[: groups - 1].tolist())}
    lead_of = np.full(count, count)
    for i, c in leads.items():
        if classes[i] > end:
            classes[i] = end + 1 + rank.get(c, groups - 1)
        lead_of[classes[i]] = c
    members = -(-count // blocks)
    by_lead = np.lexsort((np.arange(count), lead_of))
    place = np.empty(count, np.int64)
    place[by_lead] = np.arange(count)
    # The groups, in each of which ids have shares.
    mass = np.bincount(classes, n + 1, minlength=count)
    share = np.where(classes > end, np.log((n + 1) / mass[classes]), 0.0)
    filled = np.zeros(blocks * members, bool)
    filled[place[np.unique(classes)]] = True
    classes = place[classes]
    cells = np.zeros((blocks * members, blocks * members))
    for r in pairs.join(mapped("before"), "before").join(mapped("id"), "id").groupBy("before_class", "id_class").agg(F.sum("n").alias("n")).collect():
        cells[r.before_class, r.id_class] = r.n
    return LanguageModel(classes, share, int(place[end]), smoothed(cells, BACK_OFF, filled), Weights.fresh(blocks, members, SPAN, HEADS, WIDTH))


def turns(frames: Iterator[pd.DataFrame], classes: np.ndarray, end: int, span: int, rounds: int) -> Iterator[tuple]:
    """(place, round, given, wanted) of the windows of these texts, each in one of the rounds."""
    for part in common.row_batches(frames, "ids", 1 << 20):
        given, wanted, text = windows([classes[np.frombuffer(t, np.uint16)] for t in part["ids"]], end, span)
        key = mix(mix(part["row"].to_numpy(np.int64).view(np.uint64))[text] + np.arange(len(text), dtype=np.uint64))
        turn = (key % np.uint64(rounds)).astype(np.int64)
        # Windows of one text stand apart in training.
        order = np.argsort(key)
        for r in range(rounds):
            at = order[turn[order] == r]
            if len(at):
                yield int(part["row"].iloc[0]), r, given[at], wanted[at]


def to_learn(rows: DataFrame, trainers: int) -> DataFrame:
    """The texts to learn from as they lie in the files, for so many trainers at most, each a task."""
    return rows.where("not held_out").select("row", "ids").coalesce(trainers)


def dealt(rows: DataFrame, made: LanguageModel, trainers: int, rounds: int) -> DataFrame:
    """(round, trainer, place, given, wanted): the windows that each trainer makes of its texts, to be looked at."""
    shared = rows.sparkSession.sparkContext.broadcast((made.classes, made.end, made.weights.distance.shape[1] // 2, rounds))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = TaskContext.get().partitionId()
        for place, r, given, wanted in turns(frames, *shared.value):
            yield pd.DataFrame({"round": [r], "trainer": [own], "place": [place], "given": [given.astype(np.int16).tobytes()], "wanted": [wanted.astype(np.int16).tobytes()]})

    return to_learn(rows, trainers).mapInPandas(run, "round int, trainer bigint, place bigint, given binary, wanted binary")


def averaged(trained: DataFrame, trainers: int) -> np.ndarray | None:
    """The mean of all trainers' weights by their tokens. Sums are formed ``FAN_IN`` at a time,
    so neither a task nor the driver holds more vectors at once."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("trainer")
        total = sum(np.frombuffer(s, np.float64) for s in frame["sums"])
        return pd.DataFrame({"trainer": [int(frame["trainer"].iloc[0])], "tokens": [int(frame["tokens"].sum())], "sums": [total.tobytes()]})

    while trainers > FAN_IN:
        trained = trained.withColumn("trainer", F.expr(f"trainer div {FAN_IN}")).groupBy("trainer").applyInPandas(add, "trainer bigint, tokens bigint, sums binary")
        trainers = -(-trainers // FAN_IN)
    # Ordered here: a sort by Spark would have all trainers run once more for its bounds.
    rows = sorted(trained.collect(), key=lambda r: r.trainer)
    return sum(np.frombuffer(r.sums, np.float64) for r in rows) / sum(r.tokens for r in rows) if rows else None


def trained(rows: DataFrame, made: LanguageModel, tokens: int, rounds: int = ROUNDS) -> LanguageModel:
    """The model with weights trained on all windows, a part of them in each round.

    A trainer makes the windows from the ids where they lie, so none is stored or shuffled.
    """
    trainers = max(1, round(tokens / rounds / WINDOW_TOKENS))
    texts = to_learn(rows, trainers)
    for r in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((made.weights, made.table, made.classes, made.end))

        def train(frames: Iterator[pd.DataFrame], r: int = r) -> Iterator[pd.DataFrame]:
            forget_subwords()
            weights, table, classes, end = shared.value
            weights = weights.filled(weights.flat().copy())
            learner = Adam(Model(weights, table), RATE, DECAY)
            n, rest = 0, None
            for _, turn, given, wanted in turns(frames, classes, end, weights.distance.shape[1] // 2, rounds):
                if turn != r:
                    continue
                n += int((wanted >= 0).sum())
                if rest is not None:
                    given, wanted = np.concatenate([rest[0], given]), np.concatenate([rest[1], wanted])
                whole = len(given) // BATCH * BATCH
                for at in range(0, whole, BATCH):
                    learner.step(given[at : at + BATCH], wanted[at : at + BATCH])
                rest = given[whole:], wanted[whole:]
            if n:
                if len(rest[0]):
                    learner.step(*rest)
                yield pd.DataFrame({"trainer": [TaskContext.get().partitionId()], "tokens": [n], "sums": [(weights.flat().astype(np.float64) * n).tobytes()]})

        flat = averaged(texts.mapInPandas(train, "trainer bigint, tokens bigint, sums binary"), trainers)
        if flat is not None:
            made.weights = made.weights.filled(flat)
    return made


def scored(rows: DataFrame, made: LanguageModel) -> DataFrame:
    """The encoded rows without ids, with ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast(made)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_subwords()
        made = shared.value
        model = made.model()
        for part in common.row_batches(frames, "ids", 1 << 19):
            yield part.drop(columns="ids").assign(score=made.log10(model, [np.frombuffer(t, np.uint16) for t in part["ids"]]))

    kept = rows.drop("words", "times")
    return kept.mapInPandas(run, common.schema_of(kept.drop("ids"), score="double"))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id"), F.lit(0)).cast("bigint").alias("doc_id"),
        F.col("doc_id").isNull().alias("no_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))


def language_scores(docs: DataFrame, ranks: bytes | None = None, most_frequent: int = FREQUENT, head: int = HEAD, groups: int = GROUPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row."""
    source = numbered(docs)
    counts = common.staged(word_counts(source), "lm-words")
    rows = common.staged(encoded(source, counts, ranks or read_ranks(), most_frequent), "lm-rows")
    facts = rows.agg(F.sum((~F.col("held_out")).cast("bigint")).alias("ends")).first()
    told = counts.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = facts.ends or 0
    n, v = (told.n or 0) + ends, told.v + (ends > 0)
    pairs = common.staged(pair_counts(rows), "lm-pairs")
    tokens = pairs.agg(F.sum("n")).first()[0] or 0
    made = trained(rows, classes_of(pairs, head, groups), tokens)
    # Words that are not among the frequent ones, none of which is in very many texts.
    looked = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    more = looked.join(counts.where("c > 0").select("word", "c"), "word").groupBy("row").agg(
        F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("_total"))
    out = scored(rows, made).join(more, "row", "left")
    none = F.lit(0)
    return out.select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("_known", none)).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("total") + F.coalesce("_total", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), "score")


def op11_lm(spark, sf_dir: str) -> DataFrame:
    return language_scores(common.documents(spark, sf_dir).select("doc_id", "text"))
