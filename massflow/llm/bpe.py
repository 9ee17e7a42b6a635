"""Byte-level BPE encoding and decoding of whole texts.

Two tiers resolve a pre-token: a minimal perfect hash over the vocabulary finds
those that are one token, and the rest are merged over linked bytes: long ones with a
heap, short ones many together, as rows of a table.
Tasks hold the hash, the pair table and a bounded cache of pieces; a text is
never cut, and nothing is shuffled.

Defined results: null counts as empty and gives no ids; special-token strings in
a text are ordinary text; lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import bounded_batches, table

#: Entries after which a task's cache starts anew, and the longest piece it keeps.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 48
#: Most bytes of a word that is merged in a table with others, most words of such a table, and what stands for no rank.
SHORT, WORDS_AT_ONCE, NONE = 32, 1 << 14, (1 << 31) - 1
#: Characters of texts, whole ones, whose words are merged together.
CHARS_AT_ONCE = 1 << 20


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a .tiktoken file in the order of its ranks 0, 1, 2, ..."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return tokens


class PerfectHash:
    """A minimal perfect hash from tokens to ranks: hash, displace, compare.

    Keys fall into buckets; the largest buckets first, each gets the first
    displacement that sends all its keys to free slots; a bucket of one key names
    a free slot outright, as a negative number. There are as many slots as keys,
    and a slot holds the rank of its key, so a foreign key is told by one
    comparison.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.n = tokens, len(tokens)
        self.buckets = max(1, self.n // 2)
        self.displacement = [0] * self.buckets
        self.slot_rank = array("i", [-1]) * self.n
        grouped: dict[int, list[tuple[int, int]]] = {}
        for rank, token in enumerate(tokens):
            h = xxhash.xxh3_64_intdigest(token)
            grouped.setdefault(h % self.buckets, []).append((h, rank))
        free = 0
        for bucket in sorted(grouped, key=lambda b: (-len(grouped[b]), b)):
            members, d = grouped[bucket], 0
            if len(members) == 1:
                while self.slot_rank[free] >= 0:
                    free += 1
                self.displacement[bucket], self.slot_rank[free] = -1 - free, members[0][1]
                continue
            while True:
                slots = {self._slot(h, d) for h, _ in members}
                if len(slots) == len(members) and all(self.slot_rank[s] < 0 for s in slots):
                    break
                d += 1
            self.displacement[bucket] = d
            for h, rank in members:
                self.slot_rank[self._slot(h, d)] = rank

    def _slot(self, h: int, d: int) -> int:
        return (((h ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def get(self, token: bytes) -> int:
        """The rank of ``token``, or -1."""
        h = xxhash.xxh3_64_intdigest(token)
        d = self.displacement[h % self.buckets]
        rank = self.slot_rank[self._slot(h, d) if d >= 0 else -1 - d]
        return rank if self.tokens[rank] == token else -1


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.hash = PerfectHash(tokens)
        self.pattern_text = pattern
        self.byte_rank = [self.hash.get(bytes([b])) for b in range(256)]
        if min(self.byte_rank) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        #: (left rank, right rank) of every split of a token into two tokens, to the token's rank.
        self.pairs: dict[int, int] = {}
        get = self.hash.get
        for rank, token in enumerate(tokens):
            for i in range(1, len(token)):
                left = get(token[:i])
                if left >= 0 and (right := get(token[i:])) >= 0:
                    self.pairs[left << 32 | right] = rank
        # the same as arrays, keys in order and one beyond all, and the pairs of bytes by themselves
        self.byte_ranks = np.array(self.byte_rank, dtype=np.int32)
        self.pair_keys = np.array([*sorted(self.pairs), np.iinfo(np.int64).max])
        self.pair_ranks = np.array([self.pairs[k] for k in self.pair_keys[:-1].tolist()] + [NONE], dtype=np.int32)
        self.byte_pairs = self._ranks_of_pairs(*np.meshgrid(self.byte_ranks, self.byte_ranks, indexing="ij"))
        self._start()

    def _start(self) -> None:
        self.pattern = regex.compile(self.pattern_text)
        self.cache: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "cache")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    def merged(self, word: bytes) -> list[int]:
        """Ranks of ``word``: again and again the lowest-ranked adjacent pair, leftmost first, is merged."""
        byte_rank, pairs = self.byte_rank, self.pairs
        n = len(word)
        if n <= SHORT:
            return array("I", self.merged_many([word])[0]).tolist()
        ids = [byte_rank[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get, pop, push = pairs.get, heapq.heappop, heapq.heappush
        # a rank and a place in one integer: the heap gives the lowest rank, and of equal ones the leftmost
        heap = [r << 40 | i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            left, j = ids[i], after[i]
            if left < 0 or j >= n or get(left << 32 | ids[j]) != rank:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    push(heap, r << 40 | i)
            if (k := before[i]) >= 0 and (r := get(ids[k] << 32 | rank)) is not None:
                push(heap, r << 40 | k)
        return [x for x in ids if x >= 0]

    def merged_many(self, words: list[bytes]) -> list[bytes]:
        """As merged, ids packed, for words of few bytes: those of one length are the rows of a table, and each round merges every row's
        lowest-ranked pair, the leftmost of equal ones."""
        out, by_length = [b""] * len(words), {}
        for i, word in enumerate(words):
            by_length.setdefault(len(word), []).append(i)
        for n, own in by_length.items():
            for k in range(0, len(own) if n else 0, WORDS_AT_ONCE):
                some = own[k : k + WORDS_AT_ONCE]
                ids, counts = self._rows_merged(np.frombuffer(b"".join([words[i] for i in some]), dtype=np.uint8).reshape(-1, n))
                packed, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for i, start, end in zip(some, [0, *ends], ends, strict=False):
                    out[i] = packed[start:end]
        return out

    def _rows_merged(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of bytes, one row after another, and how many each row has."""
        rows, n = chars.shape
        ids = self.byte_ranks[chars]
        ranks = np.full((rows, n), NONE, dtype=np.int32)  # of the pair that begins at a place
        ranks[:, :-1] = self.byte_pairs[chars[:, :-1], chars[:, 1:]]
        after, before = (np.tile(np.arange(k, n + k, dtype=np.int32), rows) for k in (1, -1))
        flat_ids, flat_ranks, row = ids.ravel(), ranks.ravel(), np.arange(rows)
        while True:
            at = (ranks if len(row) == rows else ranks[row]).argmin(axis=1)
            rank = flat_ranks[row * n + at]
            live = rank < NONE
            row, at, rank = row[live], at[live], rank[live]
            if not len(row):
                break
            first = row * n
            i = first + at
            j = first + after[i]
            flat_ids[i], flat_ids[j] = rank, -1
            flat_ranks[i] = flat_ranks[j] = NONE
            after[i] = k = after[j]
            right, left = k < n, before[i] >= 0
            nexts = first[right] + k[right]
            before[nexts] = at[right]
            previous = first[left] + before[i[left]]
            flat_ranks[np.concatenate([i[right], previous])] = self._ranks_of_pairs(np.concatenate([rank[right], flat_ids[previous]]), np.concatenate([flat_ids[nexts], rank[left]]))
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _ranks_of_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def _tokens(self, piece: str) -> list[str]:
        """The pattern's matches in a piece."""
        word = piece[1:] if piece[0] == " " else piece
        # of ASCII letters alone, with a space before them or not, the pattern makes one match, and of a mark after them another
        if word.isascii():
            if word.isalpha():
                return [piece]
            if word[-1:] in _MARKS and word[:-1].isalpha():
                return [piece[:-1], word[-1]]
        return self.pattern.findall(piece)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        """Pieces are looked up in the cache; what it lacks is gathered from all ``texts`` and merged together."""
        get, parted, gaps, lacking = self.cache.get, [], [], {}
        for text in texts:
            pieces = self._pieces(text)
            parts = list(map(get, pieces))
            if None in parts:
                for k, part in enumerate(parts):
                    if part is None:
                        gaps.append((parts, k, piece := pieces[k]))
                        lacking[piece] = None
            parted.append(parts)
        found, short, several = {}, {}, []
        for piece in lacking:
            tokens = self._tokens(piece)
            if tokens != [piece]:
                several.append((piece, tokens))
            for token in tokens:
                if token in found or token in short:
                    continue
                if (packed := get(token)) is None:
                    word = token.encode()
                    if (rank := self.hash.get(word)) >= 0:
                        packed = rank.to_bytes(4, "little")
                    elif len(word) <= SHORT:
                        short[token] = word
                        continue
                    else:
                        packed = array("I", self.merged(word)).tobytes()
                found[token] = packed
        found.update(zip(short, self.merged_many(list(short.values())), strict=True))
        for piece, tokens in several:
            found[piece] = b"".join([found[token] for token in tokens])
        for parts, k, piece in gaps:
            parts[k] = found[piece]
        for piece, packed in found.items():
            self._keep(piece, packed)
        return list(map(b"".join, parted))

    def _keep(self, piece: str, packed: bytes) -> None:
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[piece] = packed

    def _pieces(self, text: str) -> list[str]:
        """Parts of a text that are encoded by themselves.

        A match of the pattern holds a space before other characters only as its
        first character, so a space between two characters that are not white
        space always begins a match.
        """
        plain = not ("  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _RARE.search(text))
        first, *others = text.split(" ") if plain else _ALONE.split(text)
        pieces = [" " + p for p in others]
        return [first, *pieces] if first else pieces

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= CHARS_AT_ONCE:
                out += self._encoded(some)
                some, size = [], 0
        return out + self._encoded(some)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


#: Marks that make a match of the pattern by themselves where they end a piece of letters.
_MARKS = tuple(".,;:!?")
#: White space of either library's reading; a space beside it does not begin a piece.
_WHITE = r"\s\x1c-\x1f\x85\xa0"
_ALONE = re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
#: White space besides the space and the line feed.
_RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def coder(spark: SparkSession, path: str, pattern: str):
    """The coder of a vocabulary file, sent to each executor once.

    Its size is bounded by the vocabulary (50,000 tokens: some 30 MB in a task).
    """
    bounded_batches(spark)
    return spark.sparkContext.broadcast(Bpe(read_ranks(path), pattern))


def encoded(docs: DataFrame, text: str, shared) -> DataFrame:
    """``docs`` with ``ids`` (binary, little-endian u32) of the column ``text``."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = shared.value
        for batch in batches:
            yield pd.Series(bpe.encode_all(batch), dtype=object)

    return docs.withColumn("ids", ids(F.col(text)))


def digests(text: Column, shared) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256 of a text that is encoded and decoded again."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, sha = shared.value, lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for ids in bpe.encode_all(batch):
                rows.append((len(ids) // 4, sha(ids), sha(bpe.decode(ids))))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def token_count(shared) -> Callable[[Column], Column]:
    """The number of tokens of a text, made from its column."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = shared.value
        for batch in batches:
            yield pd.Series([len(p) // 4 for p in bpe.encode_all(batch)], dtype="int64")

    return count


def token_row(text: Column, shared) -> Column:
    """n_tokens, ids_sha256 and the ids themselves of whole texts."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, ids array<int>")
    def row(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        for batch in batches:
            packed = bpe.encode_all(batch)
            yield pd.DataFrame({"n_tokens": [len(p) // 4 for p in packed], "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed], "ids": [np.frombuffer(p, dtype="<i4") for p in packed]})

    return row(text)


def public_coder(spark: SparkSession):
    import public_tokenizers

    return coder(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encoded_documents(docs: DataFrame, shared) -> DataFrame:
    return docs.select("doc_id", digests(F.col("text"), shared).alias("d")).select("doc_id", "d.*")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"), public_coder(spark))
