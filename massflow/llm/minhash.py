"""Near-duplicate detection by a multi-index Hamming join of b-bit MinHash signatures.

A signature has ``CHUNKS * LANES`` slots of 16 bits. Two signatures that differ
in at most ``2 * CHUNKS - 1`` slots differ, by the pigeonhole principle, in at
most one slot of some chunk; so each chunk is indexed once for each slot left
out, and every pair within that distance meets in an index. Candidates that a
parity sketch of their sets doesn't rule out are confirmed on the full shingle
sets.

The parity sketch has a bit for each of 1024 classes of shingles: whether the
set's number in that class is odd. Where two sketches differ tells the size of
the sets' symmetric difference, almost exactly for sets of a few hundred, and a
link bounds that size by a seventh of the two sets' sizes together.

Texts with equal sets are first made one class. Each class is then held against
the nearest of its buckets' first members, which makes most components whole.
What is left works in rounds: a class outside a bucket's main component seeks the
nearest classes of other components there, by the distance of the sketches; what
is confirmed joins components, and what isn't is not tried again. A round compares
the buckets once and lists up to MOST_CANDIDATES of each such class, the next ones four
times as many; of the first lists, the nearest is confirmed first, and then those that are still in
another component. It ends when no list was full. So links and candidates follow the number
of classes and not that of the pairs in a bucket, and no pair of different components is missed.

Defined results: a text without words has an empty set and is linked with
nothing; one with fewer than five words has its whole sequence as one shingle;
repeated doc_ids are rows of their own, a null doc_id is the largest and a
component of null ids alone is null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import ROW, bounded_batches, loose, numbered_rows, row_id, stored, table, without_rows
from massflow.llm.graph import components

SHINGLE = 5
CHUNKS, LANES = 8, 4
SLOTS = CHUNKS * LANES
#: Bits of the parity sketch, and by how many standard deviations a pair may exceed what a link would show.
PARITY, DEVIATIONS = 1024, 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Most ids to broadcast; beyond it texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
WORD_CACHE = 200_000
#: Most seekers, and most members, of a bucket that are compared with each other in one group of rows.
TILE = 512
#: Most candidates of a class that the first round lists, and that any round does; the rest are listed by further rounds.
MOST_CANDIDATES, LONGEST_LIST = 256, 1024

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20240607)
_FACTORS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of 64-bit shingle hashes, with a bounded cache of word hashes."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a whole text, sorted."""
        words = (text or "").encode().lower().split()  # both by ASCII alone
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(words) < SHINGLE:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words = {}
        known, get = self.words, self.words.get
        out = []
        for w in words:
            h = get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        h = np.array(out, dtype=np.uint64)
        n = len(h) - SHINGLE + 1
        s = h[:n].copy()
        for i in range(1, SHINGLE):
            s = s * _MULTIPLIER + h[i : i + n]
        return np.unique(_mixed(s))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits for each slot, from the smallest value of one permutation of the shingles."""
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * _FACTORS + _TERMS
        least = np.minimum(least, part.min(axis=0))
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch of a set."""
    classes = (shingles * _MULTIPLIER >> np.uint64(32)) % np.uint64(PARITY)
    return np.packbits(np.bincount(classes.astype(np.int64), minlength=PARITY) & 1).view(np.int64)


SIGNED = "n long, h0 long, h1 long, chunks array<long>, parity array<long>"


def signed(text: Column) -> Column:
    """Set size, 128-bit hash of the set, signature by chunks and parity sketch."""

    @F.pandas_udf(SIGNED)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            rows = []
            for text in batch:
                s = shingler.hashes(text)
                h = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
                rows.append((len(s), h[0], h[1], signature(s).view(np.int64), parities(s)))
            yield pd.DataFrame(rows, columns=["n", "h0", "h1", "chunks", "parity"])

    return sign(text)


def _differing(a: str, b: str) -> Column:
    """In how many bits two sketches (columns ``{a}parity``, ``{b}parity``) differ."""
    return F.aggregate(F.zip_with(f"{a}parity", f"{b}parity", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _may_link(a: str, b: str) -> Column:
    """Whether two sets (columns ``{a}n``, ``{a}parity``) can be similar enough, from sizes and sketches."""
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    apart = (n + m) * (100 - PERCENT) / (100 + PERCENT)  # of a link, the greatest symmetric difference
    fade = F.exp(-4 * apart / PARITY)
    mean, variance = PARITY / 2 * (1 - F.exp(-2 * apart / PARITY)), PARITY / 4 * (1 - fade) - apart * fade
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (_differing(a, b) <= mean + DEVIATIONS * F.sqrt(F.greatest(variance, F.lit(0e0))) + 2)


def _index_keys() -> Column:
    """Each chunk with each of its slots left out in turn."""
    keep = [~(0xFFFF << 16 * lane) for lane in range(LANES)]
    signed64 = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    return F.array(*(F.xxhash64(F.lit(c * LANES + lane), F.col("chunks")[c].bitwiseAND(F.lit(signed64(keep[lane])))) for c in range(CHUNKS) for lane in range(LANES)))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The ``pairs`` (x, y) of rids whose full sets are similar enough; ``texts`` has (rid, text)."""
    spark = pairs.sparkSession
    ids = stored(pairs.select(F.explode(F.array("x", "y")).alias("rid")), "candidate-ids")
    few = ids.count() <= BROADCAST_IDS
    needed = stored(texts.join(F.broadcast(ids) if few else ids, "rid", "left_semi"), "candidate-texts")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, kept = Shingler(), {}

        def of(rid: int, text: str) -> np.ndarray:
            if rid not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[rid] = shingler.hashes(text)
            return kept[rid]

        for batch in batches:
            out = []
            for x, y, tx, ty in zip(batch["x"], batch["y"], batch["tx"], batch["ty"], strict=True):
                a, b = of(x, tx), shingler.hashes(ty)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    out.append((x, y))
            yield pd.DataFrame(out, columns=["x", "y"], dtype="int64")

    side = lambda c: needed.select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
    met = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "tx", "ty")
    return met.mapInPandas(verify, "x long, y long")


def _members(classes: DataFrame) -> DataFrame:
    """(key, slot, rid, leader) of the index buckets that hold more than one class, with their first member as leader.

    ``slot`` numbers the index: the chunk's number times LANES, and the lane left out.
    """
    rows = classes.select("rid", F.posexplode(_index_keys()).alias("slot", "key"))
    first = rows.groupBy("key").agg(F.min("rid").alias("leader"), F.max("rid").alias("last")).where("leader <> last")
    first = first.select(loose(F.col("key")).alias("k"), "leader")
    return rows.withColumn("k", loose(F.col("key"))).join(first, "k").drop("k")


def _sketches(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("rid").alias(name), *(F.col(c).alias(f"{name}{c}") for c in ("n", "parity")))


def _leader_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Each member with that leader of its buckets whose sketch is nearest, where they can be similar enough."""
    pairs = members.where("rid <> leader").select(F.col("leader").alias("x"), F.col("rid").alias("y")).distinct()
    met = pairs.join(_sketches(classes, "x"), "x").join(_sketches(classes, "y"), "y").where(_may_link("x", "y"))
    return met.groupBy("y").agg(F.min(F.struct(_differing("x", "y").alias("d"), "x")).alias("best")).select("best.x", "y")


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    names = labels.select(F.col("v").alias("rid"), "label")
    return rows.join(names, "rid", "left").withColumn("label", F.coalesce("label", "rid"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``pairs`` (x, y) whose ends are in different components."""
    of = lambda c: labels.select(F.col("v").alias(c), F.col("label").alias(f"{c}l"))
    met = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return met.where(F.coalesce("xl", "x") != F.coalesce("yl", "y")).select("x", "y")


def _mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, slot, rid, anchor) of the buckets with several components; ``anchor`` is a member of the largest one there."""
    parts = _with_labels(members.select("key", "rid"), labels).groupBy("key", "label").agg(F.count("*").alias("n"), F.min("rid").alias("own"))
    found = parts.groupBy("key").agg(F.max(F.struct("n", "own")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    found = found.select(loose(F.col("key")).alias("k"), F.col("most.own").alias("anchor"))
    return members.withColumn("k", loose(F.col("key"))).join(found, "k").select("key", "slot", "rid", "anchor")


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows that come in the order of ``keys``, in parts that end where a group ends, and where the groups of a part begin."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch)
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else batch
        ids = rows[keys].to_numpy()
        starts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        if len(starts):
            yield rows.iloc[: starts[-1]], np.concatenate([[0], starts[:-1]])
            held = [rows.iloc[starts[-1] :]]
    if rest := [h for h in held if len(h)]:
        yield pd.concat(rest, ignore_index=True), np.array([0])


def _most_differing(sizes: np.ndarray) -> np.ndarray:
    """As in _may_link: the most bits in which the sketches of a link differ, for the sum of the sets' sizes."""
    apart = sizes * (100 - PERCENT) / (100 + PERCENT)
    fade = np.exp(-4 * apart / PARITY)
    mean, variance = PARITY / 2 * (1 - np.exp(-2 * apart / PARITY)), PARITY / 4 * (1 - fade) - apart * fade
    return mean + DEVIATIONS * np.sqrt(np.maximum(variance, 0)) + 2


def _first_slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all indexes in which two signatures, row by row, share a bucket, the number of the first.

    They meet in each index of a chunk in which no lane differs, and in one of a
    chunk in which one does.
    """
    lanes = lambda x: np.ascontiguousarray(x).view(np.uint16).reshape(len(x), CHUNKS, LANES)
    differ = lanes(a) != lanes(b)
    many = differ.sum(axis=2)
    chunk, rows = (many <= 1).argmax(axis=1), np.arange(len(a))
    return chunk * LANES + np.where(many[rows, chunk] == 0, 0, differ[rows, chunk].argmax(axis=1))


def _nearest(seek: pd.DataFrame, there: pd.DataFrame, most: int) -> Iterator[tuple[int, int, int]]:
    """(x, y, d): for each row of ``seek`` its nearest rows of ``there``, at most ``most``, beyond its
    cursor (d, y), of other components, with which it may be linked and which it meets in no index before this one; d is the sketches' distance."""
    bits = lambda rows: np.stack(rows["parity"].to_numpy()).view(np.uint64)
    chunks = lambda rows: np.stack(rows["chunks"].to_numpy())
    theirs, slot = chunks(there), int(there["slot"].iloc[0])
    sketch, rid, n, label = bits(there), there["rid"].to_numpy(), there["n"].to_numpy(), there["label"].to_numpy()
    for i in range(0, len(seek), 64):
        some = seek.iloc[i : i + 64]
        x, m = some["rid"].to_numpy(), some["n"].to_numpy()[:, None]
        d = np.bitwise_count(bits(some)[:, None, :] ^ sketch[None]).sum(axis=2, dtype=np.int64)
        past, last = some["d"].to_numpy()[:, None], some["last"].to_numpy()[:, None]
        fits = (d <= _most_differing(n + m)) & (label != some["label"].to_numpy()[:, None]) & ((d > past) | (d == past) & (rid > last))
        fits &= 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        row, column = np.nonzero(fits)
        fits[row, column] = _first_slots(chunks(some)[row], theirs[column]) == slot
        for k in np.flatnonzero(fits.any(axis=1)):
            at = np.flatnonzero(fits[k])
            at = at[np.lexsort((rid[at], d[k, at]))[:most]]
            yield from zip([int(x[k])] * len(at), rid[at].tolist(), d[k, at].tolist(), strict=True)


def _candidates(mixed: DataFrame, labels: DataFrame, cursors: DataFrame | None, classes: DataFrame, most: int) -> DataFrame:
    """(x, near): for each class outside the component of a bucket's anchor, the ``most`` nearest classes
    of other components in its buckets, beyond its cursor, as sorted structs (d, y).

    Large buckets are cut in blocks, and each block of seekers meets each block of
    members in a group of its own, whose size is bounded by TILE.
    """
    rows = _with_labels(mixed, labels)
    rows = rows.join(cursors, "rid", "left") if cursors is not None else rows.withColumns({"d": F.lit(None).cast("long"), "last": F.lit(None).cast("long"), "done": F.lit(None).cast("boolean")})
    rows = stored(rows, "mixed-rows")
    main = rows.where("rid = anchor").select(loose(F.col("key")).alias("k"), F.col("label").alias("main"))
    rows = rows.withColumn("k", loose(F.col("key"))).join(main, "k").withColumn("seeks", (F.col("label") != F.col("main")) & ~F.coalesce("done", F.lit(False)))
    rows = stored(rows.select("key", "slot", "rid", "label", "d", "last", "seeks"), "mixed-seekers")
    blocks = lambda c: F.ceil(c / TILE).cast("int")
    sizes = rows.groupBy("key").agg(blocks(F.count("*")).alias("nd"), blocks(F.sum(F.col("seeks").cast("int"))).alias("nq")).where("nq > 0")
    rows = rows.withColumn("k", loose(F.col("key"))).join(sizes.select(loose(F.col("key")).alias("k"), "nd", "nq"), "k").drop("k")
    rows = rows.join(classes.select("rid", "n", "parity", "chunks"), "rid")
    own = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "rid"), F.col(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    value = [F.coalesce("d", F.lit(-1)).alias("d"), F.coalesce("last", F.lit(-1)).alias("last"), "slot", "rid", "label", "n", "parity", "chunks"]
    seek = rows.where("seeks").select("key", own("nq", 0).alias("q"), others("nd").alias("b"), F.lit(0).alias("role"), *value)
    there = rows.select("key", others("nq").alias("q"), own("nd", 1).alias("b"), F.lit(1).alias("role"), *value)
    tiles = seek.unionByName(there).repartition("key", "q", "b").sortWithinPartitions("key", "q", "b", "role")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_groups(batches, ["key", "q", "b"]):
            out: list[tuple[int, int, int]] = []
            role = rows["role"].to_numpy()
            for a, b in zip(starts, [*starts[1:], len(rows)], strict=True):
                middle = a + int(np.searchsorted(role[a:b], 1))
                if a < middle < b:
                    out += _nearest(rows.iloc[a:middle], rows.iloc[middle:b], most)
            yield pd.DataFrame(out, columns=["x", "y", "d"], dtype="int64")

    found = tiles.mapInPandas(compare, "x long, y long, d long")
    return found.groupBy("x").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "y"))), 1, most).alias("near"))


def class_components(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, label) of the classes that are linked: components of the links between ``classes``."""
    members = stored(_members(classes), "members")
    none = classes.select(F.col("rid").alias("v"), F.col("rid").alias("label")).limit(0)

    def linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """``labels`` with the components of the confirmed ``pairs`` made one."""
        links = stored(confirmed(pairs, texts), "links")
        before = labels.select(F.col("v").alias("x"), F.col("label").alias("y"))
        return labels if links.isEmpty() else stored(components(links.unionByName(before)), "labels")

    pairs = stored(_leader_pairs(members, classes), "pairs")
    labels = none if pairs.isEmpty() else linked(none, pairs)
    mixed, cursors, most = stored(_mixed_buckets(members, labels), "mixed"), None, MOST_CANDIDATES
    while not mixed.isEmpty():
        near = stored(_candidates(mixed, labels, cursors, classes, most), "candidates")
        listed = near.select("x", F.posexplode("near").alias("place", "n")).select("x", "place", "n.y")
        for place in ("place = 0", "place > 0") if cursors is None else ("true",):
            pairs = stored(_apart(listed.where(place), labels).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
            if pairs.isEmpty():
                break
            labels = linked(labels, pairs)
        full = F.size("near") == most
        if near.where(full).isEmpty():
            break
        tried = near.select(F.col("x").alias("rid"), F.element_at("near", -1).alias("l"), (~full).alias("done")).select("rid", "l.d", F.col("l.y").alias("last"), "done")
        # a class that is in the main components of all its buckets, or has found less than it asked for, is done for good
        cursors = mixed.select("rid").distinct().join(tried, "rid", "left").withColumn("done", F.coalesce("done", F.lit(True)))
        cursors = stored(cursors, "cursors")
        most = min(4 * most, LONGEST_LIST)
    return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, rid and
    ``stays``, which is true for one row of each component only."""
    return _judged(stored(docs.select(row_id().alias("rid"), "doc_id", "text"), "numbered"))


def _judged(numbered: DataFrame) -> DataFrame:
    """near_duplicates of a stored table (rid, doc_id, text)."""
    bounded_batches(numbered.sparkSession)
    base = stored(numbered.select("rid", "doc_id", signed(F.col("text")).alias("s")).select("rid", "doc_id", "s.*"), "signatures")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")
    classes = base.where("n > 0").groupBy("h0", "h1", "n").agg(F.min(F.struct(own.alias("own"), "chunks", "parity")).alias("m"))
    classes = stored(classes.select("h0", "h1", "n", F.col("m.own.rid").alias("rid"), F.col("m.own.doc_id").alias("doc_id"), "m.chunks", "m.parity"), "classes")
    labels = class_components(classes.select("rid", "n", "chunks", "parity"), numbered.select("rid", "text"))
    placed = stored(classes.select("h0", "h1", "rid", "doc_id").join(labels.select(F.col("v").alias("rid"), "label"), "rid", "left").withColumn("label", F.coalesce("label", "rid")), "placed")
    smallest = placed.groupBy("label").agg(F.min(own).alias("first")).select(loose(F.col("label")).alias("l"), "first")
    named = placed.join(smallest, loose(F.col("label")) == F.col("l")).select(loose(F.col("h0")).alias("k0"), loose(F.col("h1")).alias("k1"), "first")
    found = base.select("rid", "doc_id", "n", "h0", "h1").join(stored(named, "named"), (loose(F.col("h0")) == F.col("k0")) & (loose(F.col("h1")) == F.col("k1")), "left")
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    stays = (F.col("n") == 0) | (F.col("rid") == F.col("first.rid"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "rid", stays.alias("stays"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest doc_id of each component."""
    whole = numbered_rows(docs)
    return without_rows(whole, _judged(whole.select(F.col(ROW).alias("rid"), "doc_id", "text")).where("not stays"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("rid", "stays")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 5 THEN [array_to_string(a, ' ')]
  ELSE list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""
