"""Benchmark decontamination: SimHash windows the size of the items.

The items fall into size classes. A class slides windows of one width over every
whole document. The width is a little less than what a copy that is still similar
enough keeps in one piece: most of a short item, whose copies can differ at the ends
only, and about half of a longer one, of which one run of words may be replaced.
The stride is so short that a window falls into the kept piece, wherever that
starts; all offsets of the items are indexed. The 64-bit fingerprints are cut
into three blocks; each item fingerprint is entered under every value that
differs from its block in up to ``RADIUS // 3`` bits, so by the pigeonhole
principle all windows within ``RADIUS`` bits are found. A candidate counts if
the exact weighted similarity of its five-word shingles, weighted by how often
they occur, is ``SIMILARITY`` or more; it is measured over spans of the item's size
and over the span of the item's shingles nearby.

A word is what stands between white space, lower-cased, without characters that
are neither letters nor digits. Documents stay where they are: only the items
are sent to the tasks, a pass of at most ``ITEMS_PER_PASS`` items and
``WORDS_PER_PASS`` words (or one longer item) at a time. The passes of a larger
benchmark follow each other over stored documents, each one's few matches are
stored, and tasks hold the index of one pass only.

Defined results: a null or empty text matches nothing; items without words are
left out; an item of fewer than five words has its whole sequence as one shingle;
repeated rows are judged alike; without items every document is kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import ROW, bounded_batches, numbered_rows, stored, table

SHINGLE, SIMILARITY = 5, 0.75
RADIUS = 8
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and width
ITEMS_PER_PASS, WORDS_PER_PASS = 2000, 60_000
#: Narrowest window, ratio of the classes' widths, ratio of a copy's kept piece to its window.
NARROWEST, LADDER, SLACK = 6, 1.25, 1.2
SEGMENT = 1 << 15
WORD_CACHE = 400_000
#: So few shingles are looked up one by one.
FEW = 256


class _Hashes(dict):
    """Pieces of text to hashes of the words in them, taken where they are missing."""

    def __missing__(self, piece: str) -> int:
        word = piece if piece.isalnum() else "".join(filter(str.isalnum, piece))
        h = self[piece] = xxhash.xxh3_64_intdigest(word) | 1 if word else 0
        return h


class Words:
    """Texts to arrays of 64-bit word hashes; 0 stands for no word."""

    def __init__(self) -> None:
        self.known = _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > WORD_CACHE:
            self.known = _Hashes()
        pieces = (text or "").lower().split()
        found = np.fromiter(map(self.known.__getitem__, pieces), dtype=np.uint64, count=len(pieces))
        return found[found != 0]


def shingles(words: np.ndarray) -> Counter:
    """The five-word shingles of a sequence of words and how often each occurs."""
    if len(words) == 0:
        return Counter()
    seq = words.tolist()
    return Counter(tuple(seq[i : i + SHINGLE]) for i in range(max(1, len(seq) - SHINGLE + 1)))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """A hash for each place where a five-word shingle starts."""
    n = max(0, len(words) - SHINGLE + 1)
    h = words[:n].copy()
    for i in range(1, SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return h


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: the sum of the lesser weights over that of the greater."""
    both = sum(min(c, b[s]) for s, c in a.items() if s in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


def running_bits(words: np.ndarray, longest: int) -> np.ndarray:
    """Row i: for each bit, how many of the first i words have it, in a type that holds ``longest``.

    The sums may wrap around; the difference of two rows no further apart than
    ``longest`` doesn't.
    """
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros((64, len(words) + 1), dtype=kind)
    np.cumsum(bits.T, axis=1, dtype=kind, out=total[:, 1:])  # sums run faster along the rows, windows are taken faster from columns
    return np.ascontiguousarray(total.T)


def fingerprints(running: np.ndarray, width: int, stride: int) -> np.ndarray:
    """SimHashes of the windows that start at 0, stride, 2 * stride, ..."""
    having = running[width::stride] - running[: len(running) - width : stride]
    return np.packbits(having > width // 2, axis=1, bitorder="little").view(np.uint64).ravel()


def kept_piece(n: int) -> int:
    """How many adjacent words of an item of ``n`` words a copy with one changed place keeps, if it is similar enough.

    A copy may lack N / 4 of the N shingles. Words left out at an end take one each;
    to leave out or replace a run of k words inside takes k + 4, and leaves the
    longer of two pieces.
    """
    lost = max(0, n - SHINGLE + 1) // 4
    return n - lost if lost < SHINGLE else -(-(n - (lost - SHINGLE + 1)) // 2)


def class_width(n: int) -> int:
    """The width of the windows for items of ``n`` words."""
    width, piece = NARROWEST, kept_piece(n)
    if piece < width * SLACK:
        return piece
    while (wider := int(width * LADDER) + 1) * SLACK <= piece:
        width = wider
    return width


def _masks(width: int, errors: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for e in range(errors + 1) for bits in combinations(range(width), e)], dtype=np.uint64)


class SizeClass:
    """The multi-index of the item windows of one width."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]]):
        self.width = width
        self.stride = min(kept_piece(len(w)) for _, w in items) - width + 1
        prints, owner, offset = [], [], []
        for i, (_, words) in enumerate(items):
            p = fingerprints(running_bits(words, width), width, 1)
            prints.append(p)
            owner += [i] * len(p)
            offset += range(len(p))
        self.prints, self.owner, self.offset = np.concatenate(prints), np.array(owner), np.array(offset)
        self.items = items
        self.blocks = []
        for first, bits in BLOCKS:
            own = self.prints >> np.uint64(first) & np.uint64((1 << bits) - 1)
            near = (own[:, None] ^ _masks(bits, RADIUS // len(BLOCKS))).astype(np.uint32)
            order = np.argsort(near, axis=None, kind="stable")
            present = np.zeros(1 << bits, dtype=bool)
            present[near.ravel()] = True
            values, starts = np.unique(near.ravel()[order], return_index=True)
            self.blocks.append((np.uint64(first), np.uint64((1 << bits) - 1), present, values, np.append(starts, near.size).astype(np.int64), (order // near.shape[1]).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of all pairs within RADIUS bits."""
        windows, found = [], []
        for first, mask, present, values, starts, owners in self.blocks:
            block = (prints >> first & mask).astype(np.uint32)
            hit = np.flatnonzero(present[block])
            place = np.searchsorted(values, block[hit])
            lo = starts[place]
            n = starts[place + 1] - lo
            w = np.repeat(hit, n)
            o = owners[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            ok = np.bitwise_count(prints[w] ^ self.prints[o]) <= RADIUS
            windows.append(w[ok])
            found.append(o[ok])
        pairs = np.unique(np.concatenate(windows) * len(self.prints) + np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Index:
    """The size classes of a set of items, built in a task from the items' words."""

    def __init__(self, items: list[tuple[int, str]]):
        words = Words()
        self.items = [(i, w) for i, text in items if len(w := words(text))]
        self._start()

    def _start(self) -> None:
        self.classes: list[SizeClass] | None = None
        self.words = Words()

    def __getstate__(self) -> dict:
        return {"items": self.items}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def build(self) -> Index:
        if self.classes is None:
            by_width: dict[int, list] = defaultdict(list)
            for item in self.items:
                by_width[class_width(len(item[1]))].append(item)
            self.classes = [SizeClass(w, by_width[w]) for w in sorted(by_width)]
            self.wanted = {i: shingles(w) for i, w in self.items}
            self.sets = {i: frozenset(shingle_hashes(w).tolist()) for i, w in self.items}
            self.hashed = {i: np.unique(shingle_hashes(w)) for i, w in self.items}
            self.longest = max((c.width for c in self.classes), default=1)
            self.room = max((len(w) for _, w in self.items), default=1)  # an item may seem to start before the first word
        return self

    def _candidates(self, words: np.ndarray, doc: np.ndarray) -> dict[tuple[int, int, int], set[int]]:
        """(doc, class, item) of windows within RADIUS of an item's, with where the item would start in ``words``.

        Documents follow each other in ``words``; a segment of them at a time is
        fingerprinted, and segments overlap by the widest window.
        """
        found: dict[tuple[int, int, int], set[int]] = defaultdict(set)
        for at in range(0, len(words), SEGMENT):
            part = words[at : at + SEGMENT + self.longest]
            running = running_bits(part, self.longest)
            for k, c in enumerate(self.classes):
                if len(part) < c.width:
                    continue
                windows, own = c.near(fingerprints(running, c.width, c.stride))
                first = at + windows * c.stride
                inside = doc[first] == doc[first + c.width - 1]
                first, own = first[inside], own[inside]
                start = first - c.offset[own]
                _, one = np.unique((c.owner[own] * (doc[-1] + 1) + doc[first]) * (len(words) + self.room) + start + self.room, return_index=True)
                for d, o, s in zip(doc[first[one]].tolist(), c.owner[own[one]].tolist(), start[one].tolist(), strict=True):
                    found[d, k, o].add(s)
        return found

    def matches(self, texts: list[str | None]) -> list[dict[int, float]]:
        """For each text, the items in it and their similarity."""
        self.build()
        each = [self.words(t) for t in texts]
        sizes = np.array([len(w) for w in each], dtype=np.int64)
        ends = np.cumsum(sizes)
        out: list[dict[int, float]] = [{} for _ in texts]
        if not self.classes or not len(sizes) or not ends[-1]:
            return out
        joined = np.concatenate(each)
        hashes = shingle_hashes(joined)
        for (d, k, o), starts in self._candidates(joined, np.repeat(np.arange(len(texts)), sizes)).items():
            item, words = self.classes[k].items[o]
            begin, end = int(ends[d] - sizes[d]), int(ends[d])
            best = self._best(item, words, each[d], hashes[begin : max(begin, end - SHINGLE + 1)], np.array(sorted(starts)) - begin)
            if best >= SIMILARITY:
                out[d][item] = best
        return out

    def _best(self, item: int, words: np.ndarray, text: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> float:
        """The greatest similarity of the item to spans of ``text`` about its candidates' ``starts``, or 0 if none counts.

        ``hashes`` has one for each shingle of the text.
        """
        n, about, best = len(words), len(words) // 3 + 1, 0.0
        low = max(0, int(starts[0]) - about)
        nearby = hashes[low : max(low, int(starts[-1]) + n + about)]
        if len(nearby) <= FEW:
            own = np.fromiter(map(self.sets[item].__contains__, nearby.tolist()), dtype=bool, count=len(nearby))
        else:
            own = np.isin(nearby, self.hashed[item])
        if n >= SHINGLE and own.sum() < SIMILARITY * (n - SHINGLE + 1):
            return 0.0
        its = np.concatenate([[0], np.cumsum(own)])
        within = lambda a, b: its[np.clip(b - low, 0, len(own))] - its[np.clip(a - low, 0, len(own))]
        if n >= SHINGLE:
            # with too few of the item's shingles nearby, no span here can be similar enough
            starts = starts[within(starts - about, starts + n + about) >= SIMILARITY * (n - SHINGLE + 1)]
        # windows beside each other lead to starts beside each other: the one with the most of the item's shingles stands for them
        for near in np.split(starts, np.flatnonzero(np.diff(starts) > about) + 1) if len(starts) else ():
            start = int(near[within(near, near + n - SHINGLE + 1).argmax()])
            # words added or left out shift the copy's two ends
            tries = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1)]
            spans = {(max(0, start + a), min(len(text), start + n + b)) for a, b in tries}
            first = max(0, start - about - low)
            if len(at := np.flatnonzero(own[first : max(first, start + n + about - low)])):
                spans.add((low + first + int(at[0]), low + first + int(at[-1]) + SHINGLE))
            best = max(best, *(similarity(self.wanted[item], shingles(text[a:b])) for a, b in spans))
        return best


def matched(text: Column, shared) -> Column:
    @F.pandas_udf("array<struct<item_id:long,similarity:double>>")
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in batches:
            found = index.matches(batch.tolist())
            yield pd.Series([[{"item_id": i, "similarity": s} for i, s in sorted(f.items())] for f in found], dtype=object)

    return match(text)


def passes(items: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """The items in lists that a task can hold the index of."""
    some, n = [], 0
    for item, text in items:
        size = len(text.split())
        if some and (len(some) == ITEMS_PER_PASS or n + size > WORDS_PER_PASS):
            yield some
            some, n = [], 0
        some.append((item, text))
        n += size
    if some:
        yield some


def with_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``leaked``, the items (item_id, similarity) that each whole text holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text")
    each = passes((r["item_id"], r["text"]) for r in items.toLocalIterator())
    some, more = next(each, []), next(each, None)
    if more is None:
        return docs.withColumn("leaked", matched(F.col("text"), spark.sparkContext.broadcast(Index(some))))
    whole, found = numbered_rows(docs), []
    while some:
        shared = spark.sparkContext.broadcast(Index(some))
        hits = whole.select(F.col(ROW).alias("rid"), matched(F.col("text"), shared).alias("leaked"))
        found.append(stored(hits.where(F.size("leaked") > 0), "leaks"))
        shared.destroy()
        some, more = more, next(each, None)
    every = reduce(DataFrame.unionByName, found).groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("leaked"))).alias("leaked"))
    none = F.array().cast("array<struct<item_id:bigint,similarity:double>>")
    return whole.join(every.withColumnRenamed("rid", ROW), ROW, "left").withColumn("leaked", F.coalesce("leaked", none)).drop(ROW)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.size("leaked").cast("long").alias("n_items"), F.transform("leaked", lambda x: x["item_id"]).alias("item_ids"), F.array_max(F.transform("leaked", lambda x: x["similarity"])).alias("similarity"), (F.size("leaked") == 0).alias("kept"))


def kept(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return with_matches(docs, benchmark).where(F.size("leaked") == 0).drop("leaked")
