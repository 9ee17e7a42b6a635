"""Quality classifier: supervised subword embeddings.

Hashed words, character n-grams and word repetitions have learned vectors; a
text's vector is their mean, and a softmax over it gives the classes. Training is
stochastic gradient descent in numpy on a bounded, documented sample of labelled
rows. As mean and softmax input are linear, a trained model keeps one number per
bucket for scoring: the difference of the two logits that the bucket adds.

Defined results: null counts as empty; a text without words scores by the bias
alone; without labels every score is 0.5; rows with a null label or id are not
learned from; where a doc_id has both labels, both count, and where it has several
texts, the one that sorts first is learned from; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import bounded_batches, hash_sample, stored, table

#: Labelled rows of each class to learn from, at most.
TRAIN_ROWS = 1500
BUCKETS, DIM, EPOCHS, RATE = 1 << 18, 8, 6, 0.5
GRAM_LENGTHS = (2, 3, 4)
CACHE_ENTRIES = 200_000
#: Longest word that is kept in the cache; the buckets of longer ones are taken anew, PIECE at a time. No word is cut.
CACHED_LENGTH, PIECE = 40, 1 << 16
REPEATED = BUCKETS  # the bucket of a word that repeats the one before it


def buckets_of(word: str) -> Iterator[int]:
    """The buckets of a word, one after another: its own and those of its character n-grams."""
    marked = f"<{word}>"
    yield crc32(marked.encode()) % BUCKETS
    for n in GRAM_LENGTHS:
        for i in range(len(marked) - n + 1):
            yield crc32(marked[i : i + n].encode()) % BUCKETS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a whole text and how often each occurs."""
    words = (text or "").split()
    counts: Counter = Counter()
    for word, c in Counter(words).items():
        for b in buckets_of(word):
            counts[b] += c
    if again := sum(map(str.__eq__, words, words[1:])):
        counts[REPEATED] = again * len(GRAM_LENGTHS) * 4
    ids = np.fromiter(counts.keys(), dtype=np.int32, count=len(counts))
    return ids, np.fromiter(counts.values(), dtype=np.float32, count=len(counts))


def train(rows: list[tuple[int, float, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(label, weight, ids, counts) of texts to the logit difference of each bucket and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    steps, done = max(1, EPOCHS * len(rows)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            label, weight, ids, counts = rows[k]
            share = counts / max(1.0, counts.sum())
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, dtype=np.float32)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            g = (RATE * (1 - done / steps) * weight) * p
            back = out @ g
            out -= np.outer(hidden, g)
            bias -= 0.1 * g
            if len(ids):
                # per bucket a step of its share against the text's largest share, so that rare buckets learn
                vectors[ids] -= np.outer(share / share.max(), back)
            done += 1
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


class Model:
    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias
        self._start()

    def _start(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, 2))

    def __getstate__(self) -> dict:
        return {"logits": self.logits, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def _row(self, word: str) -> int:
        i = len(self.cache)
        b = list(buckets_of(word))
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = self.logits[b].sum(), len(b)
        self.cache[word] = i
        return i

    def _long(self, word: str) -> tuple[float, int]:
        """The sum over a word's buckets and their number, a piece of them at a time."""
        total, n, buckets = 0.0, 0, buckets_of(word)
        while len(piece := np.fromiter(islice(buckets, PIECE), dtype=np.int32)):
            total, n = total + float(self.logits[piece].sum(dtype=np.float64)), n + len(piece)
        return total, n

    def score(self, text: str | None) -> float:
        """The probability of label 1."""
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        get, row = self.cache.get, self._row
        words = (text or "").split()
        index = np.array([i if (i := get(w)) is not None else row(w) for w in words if len(w) <= CACHED_LENGTH], dtype=np.int64)
        total, n = self.rows[index].sum(axis=0)
        if len(index) < len(words):
            for word, c in Counter(w for w in words if len(w) > CACHED_LENGTH).items():
                of_word, k = self._long(word)
                total, n = total + c * of_word, n + c * k
            again = sum(map(str.__eq__, words, words[1:]))
        else:
            again = int((index[1:] == index[:-1]).sum())
        again *= len(GRAM_LENGTHS) * 4
        logit = (total + again * float(self.logits[REPEATED])) / max(1.0, n + again) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``docs`` (doc_id, text) that ``labels`` (doc_id, quality) marks 0 or 1.

    Of each class, the ``train_rows`` rows with the smallest hashes of doc_id are
    taken and weighted by the class's true share.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    known = stored(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    sizes = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    taken = [hash_sample(known.where(F.col("quality") == q), "doc_id", train_rows) for q in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(taken[0].unionByName(taken[1]).distinct()), "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "ids": [a.tobytes() for a, _ in found], "counts": [c.tobytes() for _, c in found]})

    rows = texts.mapInPandas(extract, "doc_id long, quality int, ids binary, counts binary").toPandas()
    if not len(rows):
        return Model(np.zeros(BUCKETS + 1, dtype=np.float32), 0.0)
    rows = rows.sort_values(["doc_id", "quality"], kind="stable")
    share = {q: n / sum(sizes.values()) for q, n in sizes.items()}
    got = rows["quality"].value_counts().to_dict()
    weight = {q: share[q] * len(rows) / got[q] for q in got}
    data = [(int(q), float(np.sqrt(weight[q])), np.frombuffer(i, dtype=np.int32), np.frombuffer(c, dtype=np.float32)) for q, i, c in zip(rows["quality"], rows["ids"], rows["counts"], strict=True)]
    return Model(*train(data))


def scored(text: Column, shared) -> Column:
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for batch in batches:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return score(text)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_score``; learned from the labels of rows that are not held out."""
    bounded_batches(docs.sparkSession)
    model = fit(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("quality_score", scored(F.col("text"), shared))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = with_scores(docs, table(spark, sf_dir, "labels"))
    return s.select("doc_id", held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
