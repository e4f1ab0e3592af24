"""Words and shingles of many texts at once, as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Hashes have 64 bits and are the same on every machine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Letters, digits and all bytes beyond ASCII make terms; the rest stands between them.
_NO_TERM = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(n + n // 4, base, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads all bits of each number over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums_of(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``piece_hash`` takes the hash of any piece of the data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def piece_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


@dataclass
class Words:
    data: np.ndarray  # all texts' bytes, a line feed after each
    bounds: np.ndarray  # where each text starts, and the end
    start: np.ndarray  # of each word
    stop: np.ndarray
    doc: np.ndarray  # which text each word is of
    first: np.ndarray  # index of each text's first word, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return piece_hash(sums_of(self.data), self.start, self.stop)


def words_of(texts: list[str], lower: bool = False, terms: bool = False) -> Words:
    """The words of each text; with ``terms`` punctuation separates as well."""
    encoded = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    bounds = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=bounds[1:])
    data = np.frombuffer(b"".join([e + b"\n" for e in encoded]), np.uint8)
    if lower:
        data = _LOWER[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], (_NO_TERM if terms else _SPACE)[data])).view(np.int8)))
    start, stop = edges[0::2], edges[1::2]
    doc = np.searchsorted(bounds, start, side="right") - 1
    return Words(data, bounds, start, stop, doc, np.searchsorted(start, bounds))


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of ``size`` words inside a text, and its first word."""
    n = len(words.start)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = words.hashes()
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[k : n - size + 1 + k]
    at = np.flatnonzero(words.doc[: n - size + 1] == words.doc[size - 1 :])
    return mix(total[at]), at


def shingle_sets(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after the other, and where
    each text's begin. A text with fewer words has one shingle, all its words; none has none."""
    words = words_of(texts, lower=True)
    hashes, at = window_hashes(words, size)
    docs = words.doc[at] if len(at) else np.zeros(0, np.int64)
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        each = words.hashes()
        whole = []
        for d in short:
            total = np.zeros(1, np.uint64)
            for h in each[words.first[d] : words.first[d + 1]]:
                total = total * np.uint64(0x9FB21C651E98DF25) + h
            whole.append(mix(total + np.uint64(counts[d]))[0])
        hashes = np.concatenate((hashes, np.array(whole, np.uint64)))
        docs = np.concatenate((docs, short))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(len(texts) + 1))


def per_text(words: Words, marked: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    if not len(words.bounds) - 1:
        return np.zeros(0, np.int64)
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return np.diff(total[words.bounds])


def repeat_words(words: Words, size: int = 5) -> np.ndarray:
    """How many words of each text lie in windows that the text has twice or more."""
    hashes, at = window_hashes(words, size)
    texts = len(words.bounds) - 1
    if not len(at):
        return np.zeros(texts, np.int64)
    keys = mix(hashes + words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + size, -1)
    return np.bincount(words.doc[np.cumsum(edge[:-1]) > 0], minlength=texts)


def repeat_lines(text: str) -> int:
    """How many lines with a word equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))
