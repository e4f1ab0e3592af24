"""A causal self-attention model over subword classes, in numpy.

The next subword's class is predicted from the classes before it. ``heads`` attention heads
look at a window: query, key and value of a position are rows of tables by its class, plus a
bias by distance. What they gather, through output matrices, is added to a table of
log probabilities by the current class, taken from counts of neighbours in the whole corpus.

Classes lie in blocks of ``members``. A class's probability is that of its block times that in
its block, each from a softmax of its own, so a position costs blocks + members logits.

Texts are cut into windows of 2 x ``span`` positions that overlap by half. The later half is
scored, so every position is scored once, with ``span`` to 2 x ``span`` positions in view.
Positions before a text and those to come are masked.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

_FAR = np.float32(-1e9)
#: Logits are kept below this, so that single precision cannot overflow.
_MOST = np.float32(60)


@dataclass
class Weights:
    """Tables by class: ``query``, ``key``, ``value`` (class, heads * width); ``distance``
    (heads, 2 * span); ``to_block`` (heads * width, block) and ``to_member`` (block, heads * width, member)."""

    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    distance: np.ndarray
    to_block: np.ndarray
    to_member: np.ndarray

    @classmethod
    def fresh(cls, blocks: int, members: int, span: int, heads: int, width: int, seed: int = 11) -> Weights:
        rng = np.random.default_rng(seed)
        draw = lambda: (rng.standard_normal((blocks * members, heads * width)) * 0.3).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return cls(draw(), draw(), draw(), zero(heads, 2 * span), zero(heads * width, blocks), zero(blocks, heads * width, members))

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Weights:
        """Weights of the same shapes with these numbers."""
        made, at = [], 0
        for p in self.parts():
            made.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Weights(*made)


def windows(texts: list[np.ndarray], end: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (window, 2 * span), targets (window, span) and the text each window is of.

    A text's input begins with ``end`` and its targets end with it. -1 stands beyond a text.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    each = -(-sizes // span)
    room = (each + 1) * span
    first = np.cumsum(room) - room
    given = np.full(int(room.sum()), -1, np.int32)
    wanted = np.full(int(room.sum()), -1, np.int32)
    for t, at in zip(texts, first + span):
        n = len(t)
        given[at], wanted[at + n] = end, end
        given[at + 1 : at + n + 1] = t
        wanted[at : at + n] = t
    text = np.repeat(np.arange(len(texts)), each)
    start = first[text] + (np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each)) * span
    return given[start[:, None] + np.arange(2 * span)], wanted[start[:, None] + span + np.arange(span)], text


class Model:
    def __init__(self, weights: Weights, table: np.ndarray):
        """``table``: log probability of each class after each class; of classes that do not exist, minus infinity."""
        self.w = weights
        self.heads, reach = weights.distance.shape
        self.span = reach // 2
        self.blocks, depth, self.members = weights.to_member.shape
        self.width = depth // self.heads
        after = np.exp(table).reshape(-1, self.blocks, self.members)
        self.block_after = after.sum(axis=2)
        inside = after / np.maximum(self.block_after, 1e-300)[:, :, None]
        self.block_after = self.block_after.astype(np.float32)
        # A row for each class in each block.
        self.member_after = np.ascontiguousarray(inside.transpose(1, 0, 2).astype(np.float32)).reshape(-1, self.members)
        apart = self.span + np.arange(self.span)[:, None] - np.arange(reach)[None, :]
        self.seen, self.apart = apart >= 0, np.maximum(apart, 0)
        self.rows: np.ndarray | None = None

    def _split(self, rows: np.ndarray) -> np.ndarray:
        """(window, position, heads * width) to (window, head, position, width)."""
        b, n, d = rows.shape
        return rows.reshape(b, n, self.heads, d // self.heads).transpose(0, 2, 1, 3)

    def attended(self, given: np.ndarray):
        """What each scored position gathers, and what the gradient needs."""
        known = np.maximum(given, 0)
        q = self._split(self.w.query.take(known[:, self.span :], axis=0))
        k, v = self._split(self.w.key.take(known, axis=0)), self._split(self.w.value.take(known, axis=0))
        scale = np.float32(self.width**-0.5)
        share = np.matmul(q * scale, k.transpose(0, 1, 3, 2))
        share += np.where(self.seen, self.w.distance[:, self.apart], _FAR)
        before = np.flatnonzero(given[:, 0] < 0)
        if len(before):
            share[before] += np.where(given[before] < 0, _FAR, np.float32(0))[:, None, None, :]
        _exp(share)
        total = _line_sums(share)
        got = np.matmul(share, v)
        got /= total
        flat = got.transpose(0, 2, 1, 3).reshape(-1, self.heads * self.width)
        return flat, (known, q, k, v, share, total, scale)

    def _weighed(self, z: np.ndarray, after: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exponentials of logits, in their place. The table's part is a factor of them, so it is
        not added to each logit."""
        _exp(z)
        z *= after.take(rows, axis=0)
        return z

    def _of_blocks(self, flat: np.ndarray, current: np.ndarray) -> np.ndarray:
        return self._weighed(flat @ self.w.to_block, self.block_after, current)

    def _of_members(self, flat: np.ndarray, current: np.ndarray, block: np.ndarray, parts: list[tuple[int, slice]]) -> np.ndarray:
        """The same in the wanted blocks, of rows in the order of blocks."""
        z = np.empty((len(flat), self.members), flat.dtype)
        for b, own in parts:
            np.matmul(flat[own], self.w.to_member[b], out=z[own])
        return self._weighed(z, self.member_after, block * len(self.block_after) + current)

    def _by_block(self, block: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """The places in the order of blocks, and each block's part of them."""
        # Of 16 bits, which sort by counting.
        order = np.argsort(block.astype(np.uint16), kind="stable")
        edges = [0, *np.cumsum(np.bincount(block, minlength=self.blocks)).tolist()]
        return order, [(b, slice(x, y)) for b, (x, y) in enumerate(zip(edges, edges[1:])) if x < y]

    def log_probabilities(self, given: np.ndarray, wanted: np.ndarray, windows_at_once: int = 1024) -> np.ndarray:
        """Natural log probability of each wanted class, 0 beyond texts; same shape as ``wanted``."""
        out = np.zeros(wanted.size)
        for at in range(0, len(given), windows_at_once):
            some = given[at : at + windows_at_once]
            flat = np.concatenate([self.attended(some[lo : lo + 64])[0] for lo in range(0, len(some), 64)])
            current, target = np.maximum(some[:, self.span :], 0).ravel(), wanted[at : at + windows_at_once].ravel()
            real = np.flatnonzero(target >= 0)
            flat, current, target = flat[real], current[real], target[real]
            order, parts = self._by_block(target // self.members)
            flat, current, target = flat.take(order, axis=0), current.take(order), target.take(order)
            block, line = target // self.members, np.arange(len(target))
            z = self._of_blocks(flat, current)
            chosen = z[line, block] / _line_sums(z)[:, 0]
            z = self._of_members(flat, current, block, parts)
            chosen *= z[line, target - block * self.members] / _line_sums(z)[:, 0]
            out[at * self.span + real.take(order)] = np.log(chosen.astype(np.float64))
        return out.reshape(wanted.shape)

    def gradient(self, given: np.ndarray, wanted: np.ndarray) -> tuple[Weights, float]:
        """Of the mean loss over the wanted classes, and that loss."""
        flat, (known, q, k, v, share, total, scale) = self.attended(given)
        target = wanted.ravel()
        real = np.flatnonzero(target >= 0)
        order, parts = self._by_block(target[real] // self.members)
        # All in the order of the wanted blocks.
        real = real.take(order)
        target, seen, current = target.take(real), flat.take(real, axis=0), known[:, self.span :].ravel().take(real)
        block, line = target // self.members, np.arange(len(real))
        each, loss = np.float32(1 / len(real)), 0.0

        def slope(z: np.ndarray, right: np.ndarray) -> np.ndarray:
            nonlocal loss
            z *= each / _line_sums(z)
            chosen = z[line, right]
            loss -= np.log(chosen / each).sum(dtype=np.float64)
            z[line, right] = chosen - each
            return z

        z = slope(self._of_blocks(seen, current), block)
        d_block, d_seen = seen.T @ z, z @ self.w.to_block.T
        z = slope(self._of_members(seen, current, block, parts), target - block * self.members)
        d_member, part = np.zeros_like(self.w.to_member), np.empty_like(d_seen)
        for b, own in parts:
            np.matmul(seen[own].T, z[own], out=d_member[b])
            np.matmul(z[own], self.w.to_member[b].T, out=part[own])
        d_seen += part
        d_flat = np.zeros_like(flat)
        d_flat[real] = d_seen
        # Shares are left as they are before their division by ``total``: what they meet is divided.
        d_got = self._split(d_flat.reshape(len(given), self.span, -1)) / total
        got = self._split(flat.reshape(len(given), self.span, -1))
        d_score = np.matmul(d_got, v.transpose(0, 1, 3, 2))
        d_score -= np.einsum("bhnd,bhnd->bhn", d_got, got)[..., None]
        d_score *= share
        d_distance = np.zeros_like(self.w.distance)
        summed = (np.ones(len(given), d_score.dtype) @ d_score.reshape(len(given), -1)).reshape(d_score.shape[1:])
        for h in range(self.heads):
            d_distance[h] = np.bincount(self.apart.ravel(), (summed[h] * self.seen).ravel(), minlength=2 * self.span)
        # For each position what its class's query, key and value get, and a row of zeros. Positions
        # beyond a text have no share, so their rows are zero. Kept for the next batch: what is not
        # written, queries of earlier halves and the last row, stays zero.
        depth = self.heads * self.width
        if self.rows is None or self.rows.shape[0] != known.size + 1 or self.rows.dtype != d_score.dtype:
            self.rows = np.zeros((known.size + 1, 3 * depth), d_score.dtype)
        rows = self.rows
        of = rows[:-1].reshape(*known.shape, 3 * depth)
        np.matmul(d_score, k, out=self._split(of[:, self.span :, :depth]))
        np.matmul(d_score.transpose(0, 1, 3, 2), q, out=self._split(of[:, :, depth : 2 * depth]))
        np.matmul(share.transpose(0, 1, 3, 2), d_got, out=self._split(of[:, :, 2 * depth :]))
        of_query, of_key, of_value = np.split(_summed(known, rows, len(self.w.key)), 3, axis=1)
        return Weights(of_query * scale, of_key * scale, of_value, d_distance, d_block, d_member), float(loss * each)


def _exp(z: np.ndarray) -> None:
    """Exponentials of bounded logits, in their place."""
    if z.size and not z.max() <= _MOST:
        np.minimum(z, _MOST, out=z)
    np.exp(z, out=z)


def _line_sums(z: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept as one of length 1; a product is faster than short sums."""
    return (z.reshape(-1, z.shape[-1]) @ np.ones(z.shape[-1], z.dtype)).reshape(*z.shape[:-1], 1)


def _summed(classes: np.ndarray, rows: np.ndarray, n: int, width: int = 8) -> np.ndarray:
    """Sums of rows by class. The last row, of zeros, belongs to none.

    A class's rows are laid out in lines of ``width``, the last one filled up with zeros. Lines
    are added up all at once, and then those of each class."""
    # Fewer than 65,536 classes are sorted by counting.
    classes = classes.ravel().astype(np.uint16 if n <= 1 << 16 else np.int64)
    order, counts = np.argsort(classes, kind="stable"), np.bincount(classes, minlength=n)
    lines = -(-counts // width)
    first, begin = np.cumsum(lines) - lines, np.cumsum(counts) - counts
    at = np.full(int(lines.sum()) * width, len(rows) - 1)
    at[np.arange(len(order)) + np.repeat(first * width - begin, counts)] = order
    sums = rows.take(at.reshape(-1, width).T, axis=0).sum(axis=0)
    there = np.flatnonzero(counts)
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[there] = np.add.reduceat(sums, first[there], axis=0)
    return out


class Adam:
    """Steps by gradients, scaled by their running moments."""

    def __init__(self, model: Model, rate: float, decay: float):
        self.model, self.rate, self.decay, self.steps = model, rate, decay, 0
        self.mean, self.square = np.zeros_like(model.w.flat()), np.zeros_like(model.w.flat())

    def step(self, given: np.ndarray, wanted: np.ndarray) -> float:
        slopes, loss = self.model.gradient(given, wanted)
        self.steps += 1
        # All weights as one row of numbers, so that a step is few operations.
        g, m, s = slopes.flat(), self.mean, self.square
        m += np.float32(0.1) * (g - m)
        g *= g
        g -= s
        g *= np.float32(0.01)
        s += g
        rise = np.sqrt(s / np.float32(1 - 0.99**self.steps))
        rise += np.float32(1e-6)
        np.divide(m / np.float32(1 - 0.9**self.steps), rise, out=rise)
        at = 0
        for p in self.model.w.parts():
            p -= np.float32(self.rate) * (rise[at : at + p.size].reshape(p.shape) + np.float32(self.decay) * p)
            at += p.size
        return loss


def smoothed(pairs: np.ndarray, weight: float, real: np.ndarray) -> np.ndarray:
    """Log probability of each class after each class: counts, mixed with ``weight`` counts
    from how often each class occurs at all. That is once more than counted, and never for
    classes that are not ``real``."""
    each = (pairs.sum(axis=0) + 1.0) * real
    each /= each.sum()
    with np.errstate(divide="ignore"):
        return np.log((pairs + weight * each) / (pairs.sum(axis=1, keepdims=True) + weight))
