"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the possible merges
by rank and place, and entries whose symbols have changed meanwhile are skipped when
they come up. Decoding concatenates the vocabulary's strings.

Null texts count as empty and have no ids. Repeated rows and other columns stay as they
are; the operator's own columns replace columns of the same name. Texts of any length are
taken whole: a word costs n log n of its length, and words are remembered up to a bound.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from tabscope.llm.common import documents, row_batches

#: Fixed: how the byte-level scheme cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with no letter from here on are cut by a pattern with short, written-out ranges.
BEYOND_LATIN = 0x250
REMEMBERED_WORDS = 300_000
LONGEST_REMEMBERED = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, else the next free one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def word_finder():
    """A function from a text to its words.

    ``re`` is several times faster than ``regex`` where character classes are small. It
    lacks Unicode properties, so for Latin texts they are written out.
    """
    any_text = regex.compile(WORD_PATTERN).findall
    latin = "".join(map(chr, range(BEYOND_LATIN)))

    def written_out(kind: str) -> str:
        return "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in regex.findall(kind + "+", latin))

    classes = {k: written_out(k) for k in (r"\p{L}", r"\p{N}", r"\s")}
    pattern = WORD_PATTERN.replace(r"\S", rf"[^{classes[chr(92) + 's']}]")
    pattern = pattern.replace(r"\s+", rf"[{classes[chr(92) + 's']}]+")
    for kind, ranges in classes.items():
        pattern = pattern.replace(rf"{kind}+", f"[{ranges}]+").replace(kind, ranges)
    latin_text = re.compile(pattern).findall
    beyond = re.compile(f"[^\\0-{chr(BEYOND_LATIN - 1)}]").search

    def words(text: str) -> list[str]:
        return latin_text(text) if text.isascii() or not beyond(text) else any_text(text)

    return words


class Vocabulary(dict):
    """Word -> (ids, ids as text). Missing words are encoded, and remembered up to a bound."""

    def __init__(self, description: str):
        super().__init__()
        told = json.loads(description)
        ids = told["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.first = [ids[letter] for letter in letters]
        self.ranks: dict[int, int] = {}  # by both ids in one number
        self.made: list[int] = []  # by rank
        for rank, pair in enumerate(told["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[ids[left] << 24 | ids[right]] = rank
            self.made.append(ids[left + right])
        self.strings = {i: bytes(byte_of[c] for c in word) for word, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.strings.update({i: word.encode() for word, i in self.special.items()})
        self.words = word_finder()
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split if marks else lambda text: [text]

    def __missing__(self, word: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.merged(word.encode("utf-8", "replace")))
        entry = (ids, ",".join(map(str, ids)))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = entry
        return entry

    def merged(self, data: bytes) -> list[int]:
        first, rank_of, made = self.first, self.ranks.get, self.made
        symbols = [first[b] for b in data]
        n = len(symbols)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        # An entry is rank and place in one number: lowest rank first, then leftmost.
        queue = [r << 40 | at for at in range(n - 1) if (r := rank_of(symbols[at] << 24 | symbols[at + 1], -1)) >= 0]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            at, rank = entry & 0xFFFFFFFFFF, entry >> 40
            gone, symbol = after[at], symbols[at]
            if symbol < 0 or gone < 0:
                continue  # swallowed by a neighbour, or now the last one
            now = rank_of(symbol << 24 | symbols[gone], -1)
            if now != rank and (now < 0 or made[now] != made[rank]):
                continue  # one of the two has grown since
            symbols[at], symbols[gone] = made[rank], -1
            right = after[at] = after[gone]
            left = before[at]
            if right >= 0:
                before[right] = at
                if (r := rank_of(made[rank] << 24 | symbols[right], -1)) >= 0:
                    heapq.heappush(queue, r << 40 | at)
            if left >= 0 and (r := rank_of(symbols[left] << 24 | made[rank], -1)) >= 0:
                heapq.heappush(queue, r << 40 | left)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[tuple[tuple[int, ...], str]]:
        """The entries of a text's words, in order."""
        out: list = []
        for piece in self.cut(text):
            if piece in self.special:
                i = self.special[piece]
                out.append(((i,), str(i)))
            elif piece:
                out.extend([self[w] for w in self.words(piece)])
        return out

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


def read_vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public byte-level one with 50,257 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int), and with ``decoded`` the text that they decode to."""
    return _coded(docs, vocabulary, text, ["ids array<int>"] + ["decoded string"] * decoded)


def digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` without shipping the ids."""
    return _coded(docs, vocabulary, text, ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"])


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of each row's ids (null: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(shared.value)
        for frame in frames:
            yield frame.assign(decoded=[known.decode([] if x is None else x) for x in frame[ids]])

    kept = docs.drop("decoded")
    return kept.mapInPandas(run, _schema(kept, ["decoded string"]))


def _schema(df: DataFrame, more: list[str]) -> str:
    return ", ".join([f"`{n.replace('`', '``')}` {t}" for n, t in df.dtypes] + more)


def _coded(docs: DataFrame, vocabulary: str, text: str, more: list[str]) -> DataFrame:
    # The tokenizer's file has a fixed size of a few MB, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    names = [m.split()[0] for m in more]
    kept = docs.drop(*[n for n in names if n != text])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Vocabulary(shared.value)
        for frame in row_batches(frames, text, 1_000_000):
            made: dict[str, list] = {n: [] for n in names}
            for value in frame[text]:
                entries = known.encode(value) if isinstance(value, str) and value else []
                ids = [i for e in entries for i in e[0]]
                back = known.decode(ids)
                for name in names:
                    if name == "ids":
                        made[name].append(ids)
                    elif name == "decoded":
                        made[name].append(back)
                    elif name == "n_tokens":
                        made[name].append(len(ids))
                    elif name == "ids_sha256":
                        made[name].append(hashlib.sha256(",".join([e[1] for e in entries]).encode()).hexdigest())
                    else:
                        made[name].append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
            yield frame.assign(**{n: pd.Series(v, index=frame.index, dtype="int64" if n == "n_tokens" else "object") for n, v in made.items()})

    return kept.mapInPandas(run, _schema(kept, more))


def op5_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(docs, read_vocabulary(path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
