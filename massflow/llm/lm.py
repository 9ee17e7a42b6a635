"""Language-model scoring by masked pseudo-likelihood.

A small network predicts each token from the two tokens on either side of it; a
text's score is the sum of the log-probabilities of all its tokens given their
neighbours. Everything is gathered over the whole corpus: Spark counts all
words for the vocabulary, and the network is trained in numpy on every token of
every document. A hash of doc_id and text deals the documents into slices of about
``SLICE_TOKENS`` tokens and orders them there; each slice trains from the same
weights, in blocks that only this order fixes, and Spark averages the slices'
weights, as integers, so that neither partitions, batches nor a repeated task
change them. A round takes one half of the documents, the next one the other.

The output layer is two-level: a class of tokens, then the token in its class,
so a token costs two small softmaxes. Both levels grow with the number of
distinct words. A word outside the network's own vocabulary is predicted as its
ending's class, and then as the word in that class, by its share of all the
counted words of the class; so the probabilities of all words sum to one. The
commonest words' counts are sent to the tasks, the others are joined.

Defined results: a null or empty text has no tokens, score 0 and a null mean;
repeated rows score alike; all words that were not counted have together the
share of one more word in their class; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat
from math import isqrt, log, prod
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import bounded_batches, row_id, stored, table

#: The least vocabulary of the network: one boundary, the commonest words, classes of rare words by their ending.
LEAST_SIDE = 32
SIZE = LEAST_SIDE**2
#: As many distinct words have the least vocabulary; beyond, it grows with their number's cube root.
LEAST_WORDS = 1 << 14
SIDE, DIM, HIDDEN = 2, 12, 24
#: Each document is trained on in one of the rounds.
ROUNDS, RATE = 2, 0.15
#: A slice's first batches are small, so that little data gives enough steps; they grow with what it has seen.
FIRST_BATCH, BATCH, BATCH_GROWTH = 64, 4096, 64
#: Inputs of a softmax of no greater size need no shift before their exponentials.
SAFE = 60
#: Nor do rows whose exponentials have no greater sum, and no less than its inverse.
MOST_SUM = 1e26
#: Hidden values are taken in steps of this power of a half when texts are scored.
HIDDEN_BITS = 22
#: What the sums of squared gradients begin with.
LEAST_SQUARE = 1e-6
#: Weights that are summed over slices in a row.
PIECE = 1 << 12
#: Tokens of a slice, and of a block in which the order of training is mixed.
SLICE_TOKENS, BLOCK_TOKENS = 1 << 19, 1 << 16
#: A weight's fraction has as many bits when weights are summed, and a full slice counts as much.
FRACTION, FULL_SLICE = 1 << 24, 1 << 8
#: Most words whose counts are sent to the tasks; those of the others are joined.
HELD_WORDS = 150_000
#: Words that are counted at once, and bytes of whole texts whose words are found at once.
COUNTED, FOUND_BYTES = 1 << 22, 1 << 20
BOUNDARY = 0


def _side(n_words: int) -> int:
    """The network has as many classes, of as many tokens each."""
    return max(LEAST_SIDE, int(LEAST_SIDE * (n_words / LEAST_WORDS) ** (1 / 6)))


def _endings(side: int) -> int:
    return 2 * side - 1


def _shapes(side: int) -> dict[str, tuple[int, ...]]:
    """The last rows of ``c`` and of each class in ``t`` are biases."""
    return {"e": (side * side, DIM), "w": (2 * SIDE, DIM, HIDDEN), "b": (HIDDEN,), "c": (HIDDEN + 1, side), "t": (side, HIDDEN + 1, side)}


def _side_of(weights: int) -> int:
    """The inverse of the sum of all sizes of ``_shapes``."""
    per_token, per_class = DIM + HIDDEN + 1, HIDDEN + 1
    rest = weights - 2 * SIDE * DIM * HIDDEN - HIDDEN
    return (isqrt(per_class**2 + 4 * per_token * rest) - per_class) // (2 * per_token)


@dataclass
class Vocabulary:
    """``words`` are the commonest, commonest first, ties by the word, and ``counts`` how often each
    occurs; the first ``inside`` are the network's own. ``tokens`` is how many there are in all. ``totals`` has how often all other words of the
    corpus occur, by their ending's class; ``complete`` tells whether ``words`` are all words."""

    words: list[bytes]
    counts: list[int]
    side: int
    totals: list[int]
    complete: bool
    tokens: int = 0

    @property
    def inside(self) -> int:
        return min(len(self.words), self.side**2 - 1 - _endings(self.side))


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, n): how often each word occurs in all texts."""

    def counted(words: list[pa.Array]) -> pa.RecordBatch:
        w, n = pa.chunked_array(words, pa.binary()).value_counts().flatten()
        return pa.record_batch({"w": w, "n": n})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        for batch in batches:
            held.extend(words for words, _ in found_words(batch.column("text").to_pylist()))
            if sum(map(len, held)) >= COUNTED:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    bounded_batches(docs.sparkSession)
    found = docs.select("text").mapInArrow(count, "w binary, n long")
    return stored(found.groupBy("w").agg(F.sum("n").alias("n")), "word-counts")


def _ending(word: str, side: int) -> Column:
    """As _ending_of."""
    return F.crc32(F.expr(f"substring({word}, greatest(octet_length({word}) - 2, 1), 3)")) % _endings(side)


def _ending_of(word: bytes, side: int) -> int:
    return crc32(word[-3:]) % _endings(side)


#: What a byte does to a CRC-32.
CRC = np.array([crc32(bytes([k ^ 0xFF])) ^ 0xFF000000 for k in range(256)], dtype=np.uint32)


def _endings_of(words: pa.Array, side: int) -> np.ndarray:
    """As _ending_of, of many words."""
    ends, data = (np.frombuffer(b or b"", dtype=t) for b, t in zip(words.buffers()[1:], (np.int32, np.uint8), strict=True))
    ends = ends[words.offset : words.offset + len(words) + 1]
    sizes, ends = np.diff(ends), ends[1:]
    crc = np.full(len(words), 0xFFFFFFFF, dtype=np.uint32)
    for k in (3, 2, 1):
        some = np.flatnonzero(sizes >= k) if k > 1 or not sizes.all() else slice(None)
        now = crc[some]
        crc[some] = CRC[(now ^ data[ends[some] - k]) & 0xFF] ^ (now >> 8)
    return (~crc % _endings(side)).astype(np.int32)


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """``counts``: those of ``docs``, where they are known."""
    counts = word_counts(docs) if counts is None else counts
    sizes = sorted(((r["n"], r["words"]) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    n_words = sum(k for _, k in sizes)
    side, least, held = _side(n_words), None, 0
    for n, k in sizes:
        if held + k > HELD_WORDS:
            break
        least, held = n, held + k
    rows: list[tuple[int, bytes]] = []
    if held:
        got = counts.where(F.col("n") >= least).select("w", "n").toArrow()
        rows = sorted(zip((-n for n in got["n"].to_pylist()), got["w"].to_pylist(), strict=True))
    found = Vocabulary([w for _, w in rows], [-n for n, _ in rows], side, [0] * _endings(side), held == n_words, sum(n * k for n, k in sizes))
    for r in counts.groupBy(_ending("w", side).alias("c")).agg(F.sum("n").alias("n")).collect():
        found.totals[r["c"]] = r["n"]
    for w, n in zip(found.words[: found.inside], found.counts, strict=False):
        found.totals[_ending_of(w, side)] -= n
    return found


def _bytes(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Tokens:
    """Words to numbers, and to their log-probabilities in their endings' classes."""

    def __init__(self, vocabulary: Vocabulary):
        v, self.side = vocabulary, vocabulary.side
        self.first_ending = self.side**2 - _endings(self.side)
        self.own = pa.array([b"", *v.words[: v.inside]], pa.binary())  # by number, from BOUNDARY on
        self.vocabulary = v
        self.unseen = [-log(n + 1) for n in v.totals] if v.complete else None

    @cached_property
    def held(self) -> tuple[dict[bytes, int], pa.Array, np.ndarray]:
        """The places of all words that have a count here but aren't the network's own; by place the word and its log-probability in its class."""
        v = self.vocabulary
        words = pa.array(v.words[v.inside :], pa.binary())
        endings = _endings_of(words, self.side)
        shares = np.log(np.array(v.counts[v.inside :], dtype=np.float64) / (np.array(v.totals, dtype=np.float64)[endings] + 1))
        return {w: k for k, w in enumerate(v.words[v.inside :])}, words, shares

    @property
    def shares(self) -> dict[bytes, float]:
        """The log-probabilities in their classes of the words that have a count here."""
        return dict(zip(self.held[0], self.held[2].tolist(), strict=True))

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.each([text]))

    def each(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Every text's numbers."""
        for words, counts in found_words(texts):
            yield from np.split(self.numbers(words), np.cumsum(counts)[:-1])

    def numbers(self, words: pa.Array | list[bytes]) -> np.ndarray:
        return self._numbers(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))[0]

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The words' numbers, the places of those that aren't the network's own, and these words."""
        numbers = np.array(pc.index_in(words, value_set=self.own).fill_null(-1))
        other = np.flatnonzero(numbers < 0)
        others = words.take(pa.array(other))
        numbers[other] = self.first_ending + _endings_of(others, self.side)
        return numbers, other, others

    def in_classes(self, words: list[bytes], numbers: np.ndarray) -> tuple[float, list[bytes]]:
        """The summed log-probabilities of words in their endings' classes, and the words that are left to be joined."""
        other = np.flatnonzero(numbers >= self.first_ending)
        sums, rest = self._in_classes(pa.array([words[k] for k in other], pa.binary()), numbers[other], np.zeros(len(other), dtype=np.int64), 1)
        return float(sums[0]), rest[0]

    def _in_classes(self, words: pa.Array, numbers: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, list[list[bytes]]]:
        """As in_classes, for ``n`` texts: ``owner`` tells whose words these are."""
        places, held, shares = self.held
        if len(words) < len(held) // 2:  # a lookup of many words begins with all held ones
            place = np.fromiter(map(places.get, _bytes(words), repeat(-1)), dtype=np.int64, count=len(words))
        else:
            place = np.asarray(pc.index_in(words, value_set=held).fill_null(-1))
        share, missed = np.zeros(len(place)), place < 0
        share[~missed] = shares[place[~missed]]
        rest: list[list[bytes]] = [[] for _ in range(n)]
        if self.unseen is None:
            left = _bytes(words.filter(pa.array(missed)))
            ends = np.cumsum(np.bincount(owner[missed], minlength=n)).tolist()
            rest = [left[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        else:
            share[missed] = np.array(self.unseen)[numbers[missed] - self.first_ending]
        return np.bincount(owner, weights=share, minlength=n).astype(np.float64), rest  # of no words they are integers

    def scored(self, texts: Iterable[str | None]) -> tuple[list[np.ndarray], np.ndarray, list[list[bytes]]]:
        """Every text's numbers, and what in_classes says of its words."""
        texts_numbers, others = [], [(pa.array([], pa.binary()), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64))]
        for words, counts in found_words(texts):
            numbers, other, more = self._numbers(words)
            others.append((more, numbers[other], len(texts_numbers) + np.repeat(np.arange(len(counts)), counts)[other]))
            texts_numbers += np.split(numbers, np.cumsum(counts)[:-1])
        words, numbers, owner = zip(*others, strict=True)
        return texts_numbers, *self._in_classes(pa.concat_arrays(words), np.concatenate(numbers), np.concatenate(owner), len(texts_numbers))


def split(text: str | None) -> list[bytes]:
    """The words between ASCII white space, as WHITE_SPACE splits them."""
    return (text or "").lower().encode().split()


#: The bytes that bytes.split() splits at.
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def found_words(texts: Iterable[str | None]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of one text after another, as split gives them, and how many each text has; by runs of texts."""

    def found() -> tuple[pa.Array, np.ndarray]:
        data = np.frombuffer(b" ".join([b"", *held, b""]), dtype=np.uint8)
        space = _SPACE.take(data)
        edges = np.flatnonzero(space[1:] != space[:-1])  # before each word's first byte, and at its last
        firsts, sizes = edges[::2], np.diff(edges)[::2]
        offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
        np.cumsum(sizes, out=offsets[1:])
        words = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
        ends = np.cumsum([len(t) + 1 for t in held])
        return words, np.diff(np.searchsorted(firsts, ends), prepend=0)

    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").lower().encode())
        size += len(held[-1])
        if size >= FOUND_BYTES:
            yield found()
            held, size = [], 0
    if held:
        yield found()


def start(seed: int = 11, side: int = LEAST_SIDE) -> np.ndarray:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.normal(0, 0.1, s).ravel() for s in _shapes(side).values()]).astype(np.float32)
    p = _parts(flat)
    p["b"][:] = p["c"][-1] = p["t"][:, -1] = 0
    return flat


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _shapes(_side_of(len(flat))).items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with boundaries around each, and the places of their tokens."""
    gap = np.full(SIDE, BOUNDARY, dtype=np.int32)
    ids = np.concatenate([gap] + [x for t in texts for x in (t, gap)])
    return ids, np.flatnonzero(ids)


#: Where a token's neighbours are.
NEIGHBOURS = np.array([k for k in range(-SIDE, SIDE + 1) if k])


def _by_class(y: np.ndarray, side: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order of the tokens ``y`` by their classes, and each class that occurs with its range in that order."""
    of = (y // side).astype(np.uint16)  # sorted by radix
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=side)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if b > a]


def _softmax_loss(fill: Callable[[], object], z: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Into ``z``, which ``fill`` gives a softmax's inputs, the derivative of the mean negative log-probability of column ``of[i]`` in row i."""
    n, ones = len(z), np.ones(z.shape[1], dtype=z.dtype)
    fill()
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
        total = z @ ones
    if n and not (total.min() > MOST_SUM**-1 and total.max() < MOST_SUM):
        fill()
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        total = z @ ones
    total *= n
    z *= (1 / total)[:, None]
    z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + of] -= 1 / n
    return z


def _step(weights: np.ndarray, squares: np.ndarray, g: np.ndarray, spare: np.ndarray) -> None:
    """A step of gradient descent with per-weight rates, in place; ``g`` and ``spare`` are used up."""
    squares += np.multiply(g, g, out=spare)
    g *= RATE
    g /= np.sqrt(squares, out=spare)
    weights -= g


class Rooms:
    """Arrays to be written to, kept by name from call to call: new memory costs more than much of what is computed in it."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype: type | np.dtype) -> np.ndarray:
        size, kept = prod(shape), self.kept.get(name)
        if kept is None or kept.size < size:
            kept = self.kept[name] = np.empty(size, dtype=dtype)
        return kept[:size].reshape(shape)


class Network:
    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p = _parts(self.flat)
        self.side = self.p["c"].shape[1]
        self.gradient = np.zeros_like(self.flat)
        self.gradient_parts = _parts(self.gradient)
        self.room, self.scoring_room = Rooms(), Rooms()

    def log_probs(self, ids: np.ndarray, at: np.ndarray, span: int = 1 << 17, run: int = 1024) -> np.ndarray:
        """The log-probability of the tokens at ``at`` given their neighbours.

        How a product is summed up depends on the rows beside it, and equal tokens are to score
        alike. So products are taken of whole multiples of powers of two, small enough that every sum
        is exact in double precision; all else is done for each row by itself, in single precision.
        """
        side, room, out, single = self.side, self.scoring_room, np.empty(len(at)), np.float32
        e, c, t = (self.p[k].astype(np.float64) for k in "ect")
        folded = [(e @ w).astype(single) for w in self.p["w"].astype(np.float64)]
        folded[0] += self.p["b"].astype(single)
        bound = max(np.abs(c).sum(axis=0).max(), np.abs(t).sum(axis=1).max())
        fraction = 2.0 ** (52 - HIDDEN_BITS - int(np.ceil(np.log2(bound + 1))))
        both = np.concatenate([np.broadcast_to(c, t.shape), t], axis=2)
        np.rint(both * fraction, out=both)
        both /= fraction * 2.0**HIDDEN_BITS
        for i in range(0, len(at), span):
            order, runs = _by_class(ids[at[i : i + span]], side)
            order += i
            some = at[order]
            own = ids[some] % side + side
            lp = np.empty(len(some))
            for k, begin, end in runs:
                for a in range(begin, end, run):
                    b = min(a + run, end)
                    n, place = b - a, some[a:b]
                    x, more = room("x", n, HIDDEN, dtype=single), room("more", n, HIDDEN, dtype=single)
                    folded[0].take(ids[place + NEIGHBOURS[0]], axis=0, out=x, mode="clip")
                    for f, to in zip(folded[1:], NEIGHBOURS[1:], strict=True):
                        x += f.take(ids[place + to], axis=0, out=more, mode="clip")
                    np.tanh(x, out=x)
                    x *= 2.0**HIDDEN_BITS
                    h = room("h", n, HIDDEN + 1, dtype=np.float64)
                    h[:, :HIDDEN] = np.rint(x, out=x)
                    h[:, HIDDEN] = 2.0**HIDDEN_BITS
                    z = room("z", n, 2 * side, dtype=single)
                    z[:] = np.matmul(h, both[k], out=room("exact", n, 2 * side, dtype=np.float64))
                    halves = z.reshape(2 * n, side)
                    if bound > SAFE and (z.max() > SAFE or z.min() < -SAFE):
                        far = np.flatnonzero(np.abs(halves).max(axis=1) > SAFE)
                        halves[far] -= halves[far].max(axis=1, keepdims=True)
                    np.add(z[:, k], z[np.arange(n), own[a:b]], out=lp[a:b], dtype=np.float64)
                    sums = np.einsum("ij->i", np.exp(halves, out=halves)).astype(np.float64).reshape(n, 2)
                    lp[a:b] -= np.log(sums[:, 0] * sums[:, 1])
            out[order] = lp
        return out

    def gradients(self, y: np.ndarray, around: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """(name, gradient) of the mean negative log-probability of the tokens ``y`` with neighbours ``around``; all are parts of ``self.gradient``."""
        p, n, inputs, dtype = self.p, len(y), 2 * SIDE * DIM, self.flat.dtype
        grad = self.gradient_parts
        order, runs = _by_class(y, self.side)
        y, around = y[order], around[order]
        x = p["e"].take(around.ravel(), axis=0, out=self.room("x", n * 2 * SIDE, DIM, dtype=dtype), mode="clip").reshape(n, inputs)
        w = p["w"].reshape(inputs, HIDDEN)
        h = self.room("h", n, HIDDEN + 1, dtype=dtype)  # its last column is 1, for the biases
        inner = np.matmul(x, w, out=self.room("hx", n, HIDDEN, dtype=dtype))
        inner += p["b"]
        h[:, :HIDDEN] = np.tanh(inner, out=inner)
        h[:, HIDDEN] = 1
        z = self.room("z", n, self.side, dtype=dtype)
        _softmax_loss(lambda: np.matmul(h, p["c"], out=z), z, y // self.side)
        dh = np.matmul(z, p["c"].T, out=self.room("dh", n, HIDDEN + 1, dtype=dtype))
        np.matmul(h.T, z, out=grad["c"])
        yield "c", grad["c"]
        more = self.room("more", n, HIDDEN + 1, dtype=dtype)
        rows = [(p["t"][c], grad["t"][c], h[a:b], z[a:b], more[a:b]) for c, a, b in runs]

        def inner_inputs() -> None:
            for t, _, of, to, _ in rows:
                np.dot(of, t, out=to)

        _softmax_loss(inner_inputs, z, y % self.side)
        if len(runs) < self.side:
            grad["t"][:] = 0
        for t, to, of, dz, back in rows:
            np.dot(of.T, dz, out=to)
            np.dot(dz, t.T, out=back)
        yield "t", grad["t"]
        dh += more
        inner *= inner
        np.subtract(1, inner, out=inner)
        d = np.multiply(dh[:, :HIDDEN], inner, out=inner)
        np.matmul(x.T, d, out=grad["w"].reshape(inputs, HIDDEN))
        yield "w", grad["w"]
        np.matmul(np.ones(n, dtype=dtype), d, out=grad["b"])
        yield "b", grad["b"]
        de = self.room("de", DIM, n * 2 * SIDE, dtype=np.float64)
        de[:] = np.matmul(d, w.T, out=x).reshape(-1, DIM).T
        place = around.ravel().astype(np.int64)
        for k, of in enumerate(de):
            grad["e"][:, k] = np.bincount(place, weights=of, minlength=len(grad["e"]))
        yield "e", grad["e"]

    def train(self, ids: np.ndarray, at: np.ndarray, squares: np.ndarray, seen: int = 0) -> None:
        """One pass of stochastic gradient descent with per-weight rates over the tokens at ``at``, in
        that order; ``squares`` is kept between calls, and ``seen`` tokens went before."""
        i = 0
        while i < len(at):
            some = at[i : i + min(BATCH, FIRST_BATCH + (seen + i) // BATCH_GROWTH)]
            i += len(some)
            for _ in self.gradients(ids[some], ids[some[:, None] + NEIGHBOURS]):
                pass
            _step(self.flat, squares, self.gradient, self.room("step", len(squares), dtype=squares.dtype))


class Trainer:
    """Trains one slice from given weights, block by block in the order in which its documents come."""

    def __init__(self, flat: np.ndarray):
        self.net, self.squares = Network(flat), np.full(len(flat), LEAST_SQUARE, dtype=np.float32)
        self.held: list[np.ndarray] = []
        self.n = self.waiting = 0

    def add(self, numbers: np.ndarray) -> None:
        self.held.append(numbers)
        self.waiting += len(numbers)
        if self.waiting >= BLOCK_TOKENS:
            self.block()

    def block(self) -> None:
        if self.waiting:
            ids, at = padded(self.held)
            self.net.train(ids, np.random.default_rng(self.n).permutation(at), self.squares, self.n)
        self.n += self.waiting
        self.held, self.waiting = [], 0

    def result(self) -> tuple[np.ndarray, int]:
        """The weights as integers, times what the slice counts, and that."""
        self.block()
        counts = -(-self.n * FULL_SLICE // SLICE_TOKENS)
        return np.rint(self.net.flat.astype(np.float64) * FRACTION).astype(np.int64) * counts, counts


def in_slices(docs: DataFrame, slices: int) -> DataFrame:
    """(doc_id, text, order, slice) of every row of ``docs``, each in one slice."""
    dealt = docs.select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("order"))
    return dealt.withColumn("slice", F.pmod("order", F.lit(slices)))


def fitted(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """The network's weights after ``rounds`` of training over all of ``docs`` (doc_id, text)."""
    context = docs.sparkSession.sparkContext
    bounded_batches(docs.sparkSession)
    slices = max(1, -(-vocabulary.tokens // (SLICE_TOKENS * rounds)))
    dealt = in_slices(docs, rounds * slices)
    flat = start(side=vocabulary.side)
    for round_ in range(rounds):
        shared = context.broadcast((vocabulary, flat))

        def train(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vocabulary, flat = shared.value
            tokens, total, n, now, trainer = Tokens(vocabulary), np.zeros(len(flat), dtype=np.int64), 0, None, None
            for batch in batches:
                for slice_, numbers in zip(batch["slice"], tokens.each(batch["text"]), strict=True):
                    if slice_ != now:
                        if trainer:
                            more, counts = trainer.result()
                            total, n = total + more, n + counts
                        now, trainer = slice_, Trainer(flat)
                    trainer.add(numbers)
            if trainer:
                more, counts = trainer.result()
                pieces = np.split(total + more, range(PIECE, len(flat), PIECE))
                yield pd.DataFrame({"piece": range(len(pieces)), "weights": pieces, "n": n + counts})

        # equal rows are alike, so (order, doc_id) settles the order of all others
        part = dealt.where(F.col("slice") % rounds == round_).repartition("slice").sortWithinPartitions("slice", "order", "doc_id").select("slice", "text")
        trained = part.mapInPandas(train, "piece int, weights array<long>, n long")

        def summed(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"piece": rows["piece"].iloc[:1], "weights": [np.sum(rows["weights"].tolist(), axis=0)], "n": [rows["n"].sum()]})

        # the driver holds a few numbers for each of the network's weights
        got = trained.groupBy("piece").applyInPandas(summed, trained.schema).where("n > 0").toArrow().sort_by("piece")
        if len(got):
            flat = (got["weights"].combine_chunks().flatten().to_numpy() / got["n"][0].as_py() / FRACTION).astype(np.float32)
        shared.unpersist()
    return flat


def scored(text: Column, shared) -> Column:
    """n_tokens, score (the sum of log-probabilities) and mean_score of whole texts, and in ``rest``
    the words whose log-probabilities in their classes are still to be added."""

    @F.pandas_udf("n_tokens long, score double, mean_score double, rest array<binary>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary, flat = shared.value
        tokens, net = Tokens(vocabulary), Network(flat)
        for batch in batches:
            texts, total, rest = tokens.scored(batch)
            for i in range(0, len(texts), 256):
                some = texts[i : i + 256]
                ids, at = padded(some)
                owner = np.repeat(np.arange(len(some)), [len(t) for t in some])
                total[i : i + 256] += np.bincount(owner, weights=net.log_probs(ids, at), minlength=len(some))
            n = np.array([len(t) for t in texts], dtype=np.int64)
            yield pd.DataFrame({"n_tokens": n, "score": total, "mean_score": np.where(n > 0, total / np.maximum(n, 1), None), "rest": rest}).astype({"mean_score": "float64"})

    return score(text)


def with_rest(scores: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``scores`` (rid, doc_id, n_tokens, score, rest) with the log-probabilities of ``rest`` in their classes."""
    spark = scores.sparkSession
    least = vocabulary.counts[-1] if vocabulary.counts else None
    beyond = counts if least is None else counts.where(F.col("n") < least)
    totals = spark.createDataFrame(list(enumerate(vocabulary.totals)), "c long, total long")
    shares = beyond.withColumn("c", _ending("w", vocabulary.side)).join(F.broadcast(totals), "c").select("w", F.log(F.col("n") / (F.col("total") + 1)).alias("share"))
    terms = scores.select("rid", F.explode("rest").alias("w")).join(shares, "w").groupBy("rid").agg(F.sum("share").alias("more"))
    total = F.col("score") + F.coalesce("more", F.lit(0.0))
    return scores.join(terms, "rid", "left").select("doc_id", "n_tokens", total.alias("score"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_score"))


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score and mean_score of each row of ``docs`` (doc_id, text), by a model of all of them."""
    counts = word_counts(docs)
    found = vocabulary(docs, counts)
    shared = docs.sparkSession.sparkContext.broadcast((found, fitted(docs, found)))
    scored_ = docs.select(row_id().alias("rid"), "doc_id", scored(F.col("text"), shared).alias("s")).select("rid", "doc_id", "s.*")
    if found.complete:
        return scored_.drop("rid", "rest")
    return with_rest(stored(scored_, "scores"), counts, found)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
