"""Language identification: word first, then ever shorter character n-grams.

A known word adds its log frequency in each language; an unseen word adds the
mean of those of its known n-grams of the greatest length that has any. The
tables are counted by Spark over a bounded sample of labelled rows and bounded
themselves, so they are sent to the tasks whole; a text is scored whole.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing could be learned; ties go to the first language by name; a row
with a null language is not learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from massflow.llm.common import bounded_batches, hash_sample, stored, table

#: Rows to learn from, words and n-grams to keep for each language, longest n-gram.
TRAIN_ROWS, WORDS, GRAMS, LONGEST = 6000, 30_000, 20_000, 5
CACHE_ENTRIES = 400_000
UNKNOWN = "und"

_RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """The maximal runs of letters of a lower-cased text."""
    found = _RUNS.findall(text)
    if not all(map(str.isalpha, found)):  # numbers that are no digits, such as a superscript two
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return found


def grams_of(word: str, n: int) -> list[str]:
    w = f"<{word}>" if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def learn(rows: DataFrame, train_rows: int = TRAIN_ROWS, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """(lang, n, unit, c): counts of the commonest words (n = 0) and n-grams of each language.

    ``rows`` (doc_id, text, lang); those with the smallest hashes of doc_id are taken, ``train_rows`` at most.
    """
    sample = hash_sample(rows.where("lang is not null").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", train_rows).select("text", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter = Counter()
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                counts.update((lang, w) for w in words_of(text.lower()))
            yield pd.DataFrame([(lang, w, c) for (lang, w), c in counts.items()], columns=["lang", "unit", "c"])

    spread = sample.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    counted = stored(spread.mapInPandas(count, "lang string, unit string, c long").groupBy("lang", "unit").agg(F.sum("c").alias("c")), "words")
    every = counted.select("lang", "c", F.lit(0).alias("n"), "unit")
    for n in range(1, LONGEST + 1):
        every = every.unionByName(_grams(counted, n).groupBy("lang", "n", "unit").agg(F.sum("c").alias("c")))
    best = W.Window.partitionBy("lang", "n").orderBy(F.desc("c"), "unit")
    return every.withColumn("place", F.row_number().over(best)).where(F.col("place") <= F.when(F.col("n") == 0, words).otherwise(grams)).drop("place")


def _grams(counted: DataFrame, n: int) -> DataFrame:
    """The n-grams of counted words, as :func:`grams_of` cuts them."""
    marked = F.concat(F.lit("<"), "unit", F.lit(">")) if n > 1 else F.col("unit")
    cut = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substring(marked, i, F.lit(n)))
    return counted.where(F.length(marked) >= n).select("lang", "c", F.lit(n).alias("n"), F.explode(cut).alias("unit"))


class Model:
    """Log frequencies by unit: a row of a matrix with a column for each language."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.tables: list[dict[str, np.ndarray]] = []
        column = {lang: i for i, lang in enumerate(self.langs)}
        for n in range(LONGEST + 1):
            part = counts[counts["n"] == n]
            units = {u: i for i, u in enumerate(dict.fromkeys(part["unit"]))}
            m = np.zeros((len(units), len(self.langs)))
            np.add.at(m, (part["unit"].map(units).to_numpy(dtype=int), part["lang"].map(column).to_numpy(dtype=int)), part["c"].to_numpy(dtype=float))
            logs = np.log(m + 0.5) - np.log(m.sum(0) + 0.5 * len(units)) if len(units) else m
            self.tables.append(dict(zip(units, logs.astype(np.float32), strict=True)))
        self._start()

    def _start(self) -> None:
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1), dtype=np.float32)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "tables": self.tables}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def word(self, word: str) -> np.ndarray:
        """The log frequencies that a word adds."""
        known = self.tables[0].get(word)
        if known is not None:
            return known
        for n in range(LONGEST, 0, -1):
            table = self.tables[n]
            if found := [table[g] for g in grams_of(word, n) if g in table]:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)

    def _row(self, piece: str) -> int:
        """The cache's row of what stands between two white spaces: its words' sum and number."""
        i = len(self.cache)
        if i == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[i] = 0
        for w in words_of(piece):
            self.rows[i, :-1] += self.word(w)
            self.rows[i, -1] += 1
        self.cache[piece] = i
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return UNKNOWN, 0.0
        if len(self.cache) > CACHE_ENTRIES:
            self.cache = {}
        get, row = self.cache.get, self._row
        index = [i if (i := get(p)) is not None else row(p) for p in text.lower().split()]
        total = self.rows[np.array(index, dtype=np.int64)].sum(axis=0, dtype=np.float64) if index else np.zeros(len(self.langs) + 1)
        if not total[-1]:
            return UNKNOWN, 0.0
        odds = np.exp(total[:-1] - total[:-1].max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def predicted(text: Column, shared) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"])

    return predict(text)


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    counts = learn(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang")).toPandas()
    shared = spark.sparkContext.broadcast(Model(counts))
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), predicted(F.col("text"), shared).alias("p")).select("doc_id", "held_out", "p.*")
