"""Prefix trie of conversations, by ROLLUP over positional columns of turn ids.

Every conversation becomes one row for each WIDTH turns: the ids of these turns as
columns, and the node at which the block begins, which stands for all turns before
it. Grouping by that node and ROLLUP over the columns gives all prefixes of a block
at once; a long conversation goes on in further blocks keyed by the node where the
block before ends, and as a node is named by its turns (an XOR of 128-bit hashes of
position and turn id) all blocks are grouped in the same job.

Sums over subtrees are sums over members as well, so they come from a ROLLUP too: a
node belongs to its smallest member, which then owns every node below it on its own
path. A member's words, the words of the nodes that it owns, and whether it owns a leaf
are numbers of its own; for a node with n members, P words before it, smallest member m:

    saved(node) = (sum of words - n * P) - (sum of owned words - owned(m) + words(m) - P)

Every aggregate is combined before the shuffle, so common prefixes and hot
conversations spread out.

Defined results: turns are ordered by turn (null first), ties by role and text; null
role or text is empty; repeated rows are turns of their own; rows with a null conv_id belong to
no conversation; a conversation without turns is a member of the root; an empty table
has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.chat import in_turn_order
from massflow.llm.common import WHITE_SPACE, stored, table
from massflow.llm.ordered import PLACE, folded, ordered, running

#: Turns of a block.
WIDTH = 8
#: Ids that are joined to one piece before a node's digest.
ENDS = 1024
SEEDS = ("a", "b")
NODE = ["depth", "q0", "q1"]


def turn_ids(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, id, words): id is the digest (16 bytes) of role and text."""
    plain = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    words = F.size(F.filter(F.split("text", WHITE_SPACE), lambda w: w != "")).cast("long")
    return plain.withColumns({"id": F.unhex(F.substring(F.sha2(named, 256), 1, 32)), "words": words})


def _mark(pos: Column, turn_id: Column, seed: str) -> Column:
    """What a turn at a place gives to the name of each node from it on; 0 for no turn."""
    return F.when(turn_id.isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), pos.cast("long"), turn_id))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, pos, id, words): each conversation with its first turns replaced, which gives the trie shared prefixes.

    Conversation c begins with the first h turns of conversation c - c % 20 (all, if it has
    fewer; none, if there is none) and goes on after its own first h; h = crc32(c) % 4.
    """
    placed = running(in_turn_order(turns, "conv_id", "id", "words"), ["conv_id"], pos=("sum", F.lit(1)))
    placed = stored(placed.drop(PLACE), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    own = placed.where(F.col("pos") >= h).select("conv_id", F.lit(1).alias("part"), "pos", "id", "words")
    convs = placed.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    heads = placed.where("pos < 3 and conv_id % 20 = 0").select(F.col("conv_id").alias("base"), "pos", "id", "words")
    return own.unionByName(convs.join(heads, "base").where("pos < h").select("conv_id", F.lit(0).alias("part"), "pos", "id", "words"))


def blocks(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, part, pos, id, words) in the order of part and pos: the blocks (conv_id, b, p0, p1, before, t1 ...), and
    per conversation (conv_id, depth, words, q0, q1) the node where it ends. Of ``convs`` those without turns are in both."""
    o = running(ordered(turns, [F.col("conv_id"), F.col("part"), F.col("pos")]).drop("part", "pos"), ["conv_id"], at=("sum", F.lit(1)), before=("sum", F.col("words")))
    marked = running(o, ["conv_id"], p0=("xor", _mark(F.col("at"), F.col("id"), SEEDS[0])), p1=("xor", _mark(F.col("at"), F.col("id"), SEEDS[1])))
    rows = marked.select("conv_id", F.col("at").cast("long").alias("at"), "before", "p0", "p1", F.struct("id", "words").alias("t"))
    none = convs.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1"), F.lit(None).cast("struct<id:binary,words:bigint>").alias("t"))
    rows = stored(rows.unionByName(none), "marked")
    first = (F.col("at") % WIDTH == 0) | (F.col("at") < 0)
    cells = rows.groupBy("conv_id", F.greatest(F.lit(0), F.floor(F.col("at") / WIDTH)).alias("b")).agg(
        *(F.max(F.when(first & (F.col("at") >= 0), F.col(c))).alias(c) for c in ("p0", "p1", "before")), *(F.max(F.when((F.col("at") >= 0) & (F.col("at") % WIDTH == j), F.col("t"))).alias(f"t{j + 1}") for j in range(WIDTH))
    )
    cells = cells.fillna(0, ["p0", "p1", "before"])
    xor = lambda c, seed: F.bit_xor(F.when(F.col("at") >= 0, _mark(F.col("at"), F.col("t.id"), seed)).otherwise(F.lit(0))).alias(c)
    ends = rows.groupBy("conv_id").agg((F.max("at") + 1).alias("depth"), F.coalesce(F.sum("t.words"), F.lit(0)).alias("words"), xor("q0", SEEDS[0]), xor("q1", SEEDS[1]))
    return cells, ends


def _rolled(cells: DataFrame, members: dict[str, str]) -> DataFrame:
    """The trie's nodes by ROLLUP over the blocks' columns: NODE, the parent's name (r0, r1), last (words of the node's own turn),
    before (words of all turns above it) and the aggregates ``members`` (name, SQL) over the node's members."""
    cols = [f"t{j + 1}" for j in range(WIDTH)]
    sums = ", ".join(f"{e} AS {n}" for n, e in members.items())
    rolled = cells.sparkSession.sql(
        f"SELECT b, p0, p1, {', '.join(cols)}, {WIDTH} - bit_count(grouping_id()) AS level, max(before) AS begun, {sums} FROM {{cells}} GROUP BY b, p0, p1, ROLLUP ({', '.join(cols)})", cells=cells
    )
    level, turn = F.col("level"), F.get(F.array(*cols), F.col("level") - 1)
    # a prefix that some members don't reach has no turn at its level; a block's own beginning is the last node of the block before
    nodes = rolled.withColumn("turn", F.when(level > 0, turn)).where("turn IS NOT NULL OR (level = 0 AND b = 0)")
    place = lambda j: F.col("b") * WIDTH + j
    depth, last = place(level).cast("long"), F.coalesce("turn.words", F.lit(0))
    words = sum((F.coalesce(F.col(c)["words"], F.lit(0)) for c in cols), F.col("begun"))
    names = []
    for i, seed in enumerate(SEEDS):
        q = F.col(f"p{i}")
        for j, c in enumerate(cols):
            q = q.bitwiseXOR(_mark(place(j), F.col(c)["id"], seed))
        names += [q.alias(f"q{i}"), q.bitwiseXOR(_mark(depth - 1, F.col("turn.id"), seed)).alias(f"r{i}")]
    return nodes.select(depth.alias("depth"), *names, last.alias("last"), (words - last).alias("before"), *members)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations' turns (conv_id, part, pos, id, words), by (depth, q0, q1), of all ``convs`` (conv_id).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    cells, ends = blocks(turns, convs)
    ends = stored(ends, "ends")
    cells = stored(cells.join(ends.select("conv_id", F.col("depth").alias("length"), "words"), "conv_id"), "blocks")
    owned = _rolled(cells, {"conv_id": "min(conv_id)", "longest": "max(length)"})
    owners = owned.groupBy("conv_id").agg(F.min("before").alias("from"), F.max((F.col("depth") == F.col("longest")).cast("int")).alias("leaf"))
    cells = cells.join(owners, "conv_id", "left").withColumns({"own": F.coalesce(F.col("words") - F.col("from"), F.lit(0)), "leaf": F.coalesce("leaf", F.lit(0))})
    sums = {"n_convs": "count(*)", "least": "min(struct(conv_id, words, own))", "n_leaves": "sum(leaf)", "words": "sum(words)", "own": "sum(own)"}
    nodes = stored(_rolled(cells, sums), "nodes")
    once = F.col("own") - F.col("least.own") + F.col("least.words") - F.col("before")
    nodes = nodes.select(*NODE, "r0", "r1", "least.conv_id", "n_convs", "n_leaves", (F.col("words") - F.col("n_convs") * F.col("before") - once).alias("saved_tokens"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("q0").alias("r0"), F.col("q1").alias("r1"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("r0").alias("q0"), F.col("r1").alias("q1")).agg(F.count("*").alias("n_children"))
    got = nodes.join(above, ["depth", "r0", "r1"], "left").join(children, NODE, "left").join(end_digests(ends), NODE, "left")
    return got.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256: the digest of the ids of the conversations that end there, ascending and joined by commas."""
    o = running(ordered(ends.select(*NODE, "conv_id"), [F.col(c) for c in (*NODE, "conv_id")]), NODE, n=("sum", F.lit(1)))
    pieces = o.groupBy(*NODE, F.floor(F.col("n") / ENDS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ends_sha256"))
    return folded(pieces, NODE, ["piece"], [], ["ends_sha256"], ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_ids(table(spark, sf_dir, "conversations"))
    return trie(rebuilt(turns), turns.select("conv_id").distinct())


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM c)),
r AS (SELECT c.conv_id, 1 AS part, pos, role, text FROM c JOIN k USING (conv_id) WHERE pos >= h
      UNION ALL SELECT k.conv_id, 0, pos, role, text FROM k JOIN c ON c.conv_id = k.conv_id - k.conv_id % 20 WHERE pos < h),
s AS (SELECT k.conv_id, coalesce(any_value(t), []) AS t FROM k LEFT JOIN (
          SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS t FROM r GROUP BY conv_id) x USING (conv_id) GROUP BY 1),
p AS (SELECT conv_id, len(t) AS n, unnest(range(len(t) + 1)) AS depth, t FROM s),
g AS (SELECT depth, t[:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS longest,
             sha256(coalesce(string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
             CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(t[:depth][depth].text, '[^ 	-
]+')) END AS words
      FROM p GROUP BY depth, t[:depth]),
u AS (SELECT a.node, count(*) FILTER (d.longest = d.depth) AS n_leaves, sum((d.n_convs - 1) * d.words) AS saved_tokens,
             count(*) FILTER (d.depth = a.depth + 1) AS n_children
      FROM g d, unnest(range(d.depth + 1)) AS x(depth) JOIN g a ON a.depth = x.depth AND a.node = d.node[:x.depth] GROUP BY a.node)
SELECT g.conv_id, g.depth, b.conv_id AS parent_conv_id, g.n_convs, u.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN u USING (node) LEFT JOIN g b ON b.depth = g.depth - 1 AND b.node = g.node[:b.depth]
"""
