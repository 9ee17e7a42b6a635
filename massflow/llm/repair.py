"""Repair of a conversation's structure by the cheapest edits, chunk by chunk.

A repaired conversation's roles must read ``(s?(ua)+)?`` (system, user, assistant). A
row is kept (0), given another role (3) or deleted (4; a blank or duplicate row must
be), an empty turn is put in (3), and a truncated row that stays adds 3. The cost to
go from a row depends only on which of four states the turns so far have led to
(nothing, after system, after user, after assistant), so it is a vector of four numbers.

Levelled (less their least number) these vectors are few, VECTORS. Long conversations
are cut in chunks of CHUNK rows, and each chunk runs backwards from speculative cost
vectors, all of VECTORS at once, which soon differ by constants only and so become one:
what follows the chunk then no longer matters. Where they don't, a fix-up pass runs
them on through what follows, twice as many chunks each time, until they do or the
conversation ends. A chunk's stitched end vector gives the costs to go at all its
rows. The least audit is traced forwards the same way: from every state that a chunk may
start in, joined with what goes before until only one is left. The last pass writes the edits.
Hence n rows of one conversation take log2(n / CHUNK) passes at most, and usually one.

Defined results: rows are ordered by turn (null first), ties by role and text; a null role
or text is one space; a role's initial is its first character, and other initials than s, u
and a must be rerolled or deleted; repeated rows are duplicates; rows with a null conv_id
form one conversation; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.chat import in_turn_order
from massflow.llm.common import ROW, bounded_batches, numbered_rows, stored, table
from massflow.llm.ordered import PLACE, folded, matched, running

#: Rows of a conversation that are one string of codes.
CHUNK = 4096
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: The state after a user or assistant turn, where it may come, by the state before it: nothing yet, after system, after user, after assistant.
_NEXT = (2, 2, 3, 2)
_ROLES = {2: "user", 3: "assistant"}
Costs = tuple[int, int, int, int]


def _inserted(costs: list[int]) -> Costs:
    """Costs to go where turns may be put in first."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


#: Costs to go after the last row, where a conversation may be empty or end with an assistant.
_END = _inserted([0, 1 << 20, 1 << 20, 0])


def _options(code: str, state: int, after: Costs) -> Iterator[tuple[int, str, int, int]]:
    """(cost to go, letter, own cost, next state) of each edit of a row, by letter. ``code``: the role's initial, a capital if truncated, or ``d`` if it must go."""
    yield DELETE + after[state], "D", DELETE, state
    if code == "d":
        return
    more, to = TRUNCATED * code.isupper(), _NEXT[state]
    if code.lower() == "s" and state == 0:
        yield more + after[1], "K", more, 1
    elif code.lower() == _ROLES[to][0]:
        yield more + after[to], "K", more, to
    yield REROLE + more + after[to], "R", REROLE + more, to


@cache
def _costs(code: str, after: Costs) -> Costs:
    """Costs to go before a row from those after it."""
    return _inserted([min(o[0] for o in _options(code, s, after)) for s in range(4)])


@cache
def _before(code: str, after: Costs) -> Costs:
    """The same, levelled."""
    costs = _costs(code, after)
    return tuple(c - min(costs) for c in costs)


@cache
def _edits(code: str, state: int, after: Costs) -> tuple[str, int, int, tuple]:
    """The cheapest edits at a row, of these the least: letters, cost, state after them, and the turns that they leave ("" for a kept row's own role; None: the row's text)."""
    costs, letters, cost, turns = _costs(code, after), "", 0, []
    while True:
        options = [o for o in _options(code, state, after) if o[0] == costs[state]]
        to = _NEXT[state]
        if INSERT + costs[to] == costs[state] and not (options and options[0][1] == "D"):
            letters, cost, state = letters + "I", cost + INSERT, to
            turns.append((_ROLES[to], False))
            continue
        _, letter, own, state = options[0]
        if letter != "D":
            turns.append((_ROLES[to] if letter == "R" else None, True))
        return letters + letter, cost + own, state, tuple(turns)


def _closing(state: int) -> tuple[str, int, tuple]:
    """The turns put in after the last row."""
    roles = {1: ("user", "assistant"), 2: ("assistant",)}.get(state, ())
    return "I" * len(roles), INSERT * len(roles), tuple((r, False) for r in roles)


def _all_vectors() -> list[Costs]:
    found = [_END]
    for v in found:
        found += [n for n in dict.fromkeys(_before(c, v) for c in "suaxSUAXd") if n not in found]
    return found


#: All levelled costs to go that conversations lead to, the end's first.
VECTORS = _all_vectors()
_PLACE_OF = {v: i for i, v in enumerate(VECTORS)}


def costs_before(codes: str) -> list[int]:
    """For each of VECTORS after a chunk, that before it (places in VECTORS)."""
    now = {i: v for i, v in enumerate(VECTORS)}
    met = {v: [i] for i, v in now.items()}  # which of them have become one
    for k in range(len(codes) - 1, -1, -1):
        if len(met) == 1:
            (v, of), = met.items()
            for c in reversed(codes[: k + 1]):
                v = _before(c, v)
            met = {v: of}
            break
        joined: dict[Costs, list[int]] = {}
        for v, of in met.items():
            joined.setdefault(_before(codes[k], v), []).extend(of)
        met = joined
    where = {i: _PLACE_OF[v] for v, of in met.items() for i in of}
    return [where[i] for i in range(len(VECTORS))]


def _afters(codes: str, end: int) -> list[Costs]:
    """The costs to go after each row of a chunk that has VECTORS[end] after it."""
    v, out = VECTORS[end], []
    for c in reversed(codes):
        out.append(v)
        v = _before(c, v)
    return out[::-1]


def states_after(codes: str, end: int) -> list[int]:
    """For each state before a chunk, that after it."""
    afters, now = _afters(codes, end), [0, 1, 2, 3]
    for c, v in zip(codes, afters, strict=True):
        now = [_edits(c, s, v)[2] for s in now]
    return now


def chunk_edits(codes: str, end: int, state: int, last: bool, places: list[int]) -> tuple[str, int, list[tuple]]:
    """audit, cost and the turns (place of the row whose text they have, new role) of a chunk."""
    letters, cost, turns = [], 0, []
    for c, v, place in zip(codes, _afters(codes, end), places, strict=True):
        more, own, state, left = _edits(c, state, v)
        letters.append(more)
        cost += own
        turns += [(place if of_row else None, role) for role, of_row in left]
    if last:
        more, own, left = _closing(state)
        letters.append(more)
        cost += own
        turns += [(None, role) for role, _ in left]
    return "".join(letters), cost, turns


def faults(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, role, text, ROW), stored, and their faults (conv_id, ROW, pos, turn, initial, fault) in the order of pos; the first fault counts."""
    one = lambda c: F.coalesce(c, F.lit(" "))
    turns = numbered_rows(conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    flags = turns.withColumns({"last": last, "ident": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), "initial": F.rpad(F.substring("role", 1, 1), 1, " ")})
    placed = in_turn_order(flags, "conv_id", "turn", "initial", "last", "ident", ROW)
    firsts = placed.groupBy("conv_id", "ident").agg(F.min(PLACE).alias(PLACE)).select(PLACE, F.lit(True).alias("first"))
    rows = running(placed.drop("ident"), ["conv_id"], pos=("sum", F.lit(1))).join(firsts, PLACE, "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return turns.select("conv_id", "role", "text", ROW), rows.select("conv_id", ROW, "pos", "turn", "initial", fault.alias("fault"))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, codes, places, blank, duplicate, truncated, illegal): the turns of :func:`faults`, ``size`` a row. A chunk's
    first pair of neighbours has the last row of the chunk before it."""
    plain = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)
    own = F.floor(F.col("pos") / size)
    row = F.struct("pos", ROW, code.alias("code"), plain.alias("initial"), "fault")
    both = rows.select("conv_id", row.alias("row"), own.alias("own"), F.explode(F.when(F.col("pos") % size == size - 1, F.array(own, own + 1)).otherwise(F.array(own))).alias("chunk"))
    mine = F.col("own") == F.col("chunk")
    lists = both.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.when(mine, F.col("row")))).alias("rows"), F.max(F.when(~mine, F.col("row.initial"))).alias("ahead")).where(F.size("rows") > 0)
    read = F.concat(F.when(F.col("ahead").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("ahead")), F.transform("rows", lambda r: r["initial"]))
    pairs = F.zip_with(F.slice(read, 1, F.size(read) - 1), F.slice(read, 2, F.size(read)), lambda a, b: F.concat(a, b))
    pairs = F.when(F.size(read) > 1, F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    count = lambda k: F.size(F.filter("rows", lambda r: F.coalesce(r["fault"] == k, F.lit(False)))).cast("long").alias(k)
    return lists.select("conv_id", "chunk", F.array_join(F.transform("rows", lambda r: r["code"]), "").alias("codes"), F.transform("rows", lambda r: r[ROW]).alias("places"),
                        count("blank"), count("duplicate"), count("truncated"), F.coalesce(F.size(pairs), F.lit(0)).cast("long").alias("illegal"))


def _scanned(maps: DataFrame, ahead: int) -> DataFrame:
    """(conv_id, chunk, images): each chunk's map after those of the chunks ahead of it (``ahead`` 1: later ones, -1: earlier ones),
    run on until it leads to one image or no chunk is left. Each pass reaches twice as far."""
    varied = lambda c: F.size(F.array_distinct(c)) > 1
    now, span = stored(maps.withColumn("open", varied("images")), "chunk-maps"), 1
    while not now.where("open").isEmpty():
        other = now.select("conv_id", (F.col("chunk") - ahead * span).alias("chunk"), F.col("images").alias("then"))
        both = matched(now, other, ["conv_id", "chunk"])
        met = F.col("open") & F.col("then").isNotNull()
        images = F.when(met, F.transform("then", lambda r: F.get("images", r))).otherwise(F.col("images"))
        now = stored(both.select("conv_id", "chunk", images.alias("images"), met.alias("met")).select("conv_id", "chunk", "images", (F.col("met") & varied("images")).alias("open")), "chunk-maps")
        span *= 2
    return now.drop("open")


def edits(parts: DataFrame, size: int = CHUNK) -> DataFrame:
    """``parts`` of :func:`chunks` with audit, cost and turns (place, role), by the least of the cheapest edits of each conversation."""
    bounded_batches(parts.sparkSession)
    backward = F.udf(costs_before, "array<int>", useArrow=True)
    forward = F.udf(states_after, "array<int>", useArrow=True)
    trace = F.udf(chunk_edits, "audit string, cost long, turns array<struct<place:bigint,role:string>>", useArrow=True)
    parts = stored(parts, "chunks")
    many = parts.where((F.col("chunk") > 0) | (F.length("codes") == size)).select("conv_id", "chunk", "codes")  # parts of conversations of several chunks
    shift = lambda df, by, name: df.select("conv_id", (F.col("chunk") + by).alias("chunk"), F.get("images", F.lit(0)).alias(name))
    ends = shift(_scanned(many.select("conv_id", "chunk", backward("codes").alias("images")), 1), -1, "end")
    known = stored(matched(many, ends, ["conv_id", "chunk"]).withColumn("last", F.col("end").isNull()).fillna(0, ["end"]), "chunk-ends")
    starts = shift(_scanned(known.select("conv_id", "chunk", forward("codes", "end").alias("images")), -1), 1, "state")
    known = matched(known.drop("codes"), starts, ["conv_id", "chunk"])
    whole = matched(parts, known, ["conv_id", "chunk"]).fillna(0, ["end", "state"]).fillna(True, ["last"])
    return stored(whole.withColumn("e", trace("codes", "end", "state", "last", "places")).select("conv_id", "chunk", "blank", "duplicate", "truncated", "illegal", "e.*"), "edits")


def repaired(turns: DataFrame, edited: DataFrame) -> DataFrame:
    """(conv_id, chunk, i, role, text): the turns that the edits leave or put in, in the order of chunk and i."""
    rows = edited.select("conv_id", "chunk", F.posexplode("turns").alias("i", "turn"))
    # a turn put in meets no row, and has a key of its own so that such turns spread out
    rows = rows.select("conv_id", "chunk", "i", F.coalesce("turn.place", -1 - F.abs(F.xxhash64("conv_id", "chunk", "i") % (1 << 40))).alias(ROW), F.col("turn.role").alias("new"))
    both = rows.join(turns.select(ROW, "role", "text"), ROW, "left")
    return both.select("conv_id", "chunk", "i", F.coalesce("new", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def summary(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256."""
    turns, rows = faults(conversations)
    rows = stored(rows, "faults")
    edited = edits(chunks(rows, size), size)
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    sums = edited.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda r: r["audit"]), "").alias("audit")
    )
    lines = repaired(turns, edited).select("conv_id", "chunk", "i", F.concat_ws(":", "role", "text").alias("repaired_sha256"))
    digests = folded(lines, ["conv_id"], ["chunk", "i"], [], ["repaired_sha256"], "\n")
    return matched(matched(gaps, sums, ["conv_id"]), digests, ["conv_id"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) with faults put in by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes out
    its ``.!?``, 3 repeats it, 4 makes it a user's. Nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "k")
    return rows.withColumn("copy", F.explode(F.when(F.col("k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("k", "copy")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = table(spark, sf_dir, "conversations")
    got = matched(whole.select("conv_id").distinct(), summary(damaged(whole)), ["conv_id"])
    return got.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
n AS (SELECT name, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT)),
          lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS k FROM (SELECT DISTINCT name FROM c)),
d AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM c JOIN n USING (name) WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM d),
f AS (SELECT *, CASE WHEN regexp_matches(text, '[^\x20\x09-\x0D]') THEN CASE WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END ELSE 'blank' END AS fault,
             lag(role[1]) OVER (PARTITION BY conv_id ORDER BY pos) || role[1] AS pair FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
             list({'role': role, 'text': text, 'away': fault IN ('blank', 'duplicate'), 'more': CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'v': [{'c': 0, 'a': '', 'o': ''}]} ORDER BY pos) AS l
      FROM f GROUP BY conv_id),
begun AS (SELECT *, {'role': '', 'text': '', 'away': true, 'more': 0, 'v': [{'c': 0, 'a': '', 'o': ''}, {'c': 1000000, 'a': '', 'o': ''},
                     {'c': 3, 'a': 'I', 'o': chr(10) || 'user:'}, {'c': 6, 'a': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'}]} AS first FROM g),
e AS (SELECT *, list_reduce(list_prepend(first, l), lambda p, r: {'role': r.role, 'text': r.text, 'away': r.away, 'more': r.more, 'v':
    list_transform(list_transform([[
      [{'c': p.v[1].c + 4, 'a': p.v[1].a || 'D', 'o': p.v[1].o}],
      list_concat([{'c': p.v[2].c + 4, 'a': p.v[2].a || 'D', 'o': p.v[2].o}],
        CASE WHEN NOT r.away AND r.role[1] = 's' THEN [{'c': p.v[1].c + r.more, 'a': p.v[1].a || 'K', 'o': p.v[1].o || chr(10) || r.role || ':' || r.text}] ELSE [] END),
      list_concat([{'c': p.v[3].c + 4, 'a': p.v[3].a || 'D', 'o': p.v[3].o}], CASE WHEN r.away THEN [] ELSE
        list_transform([p.v[1], p.v[2], p.v[4]], lambda s: CASE WHEN r.role[1] = 'u' THEN {'c': s.c + r.more, 'a': s.a || 'K', 'o': s.o || chr(10) || r.role || ':' || r.text}
          ELSE {'c': s.c + 3 + r.more, 'a': s.a || 'R', 'o': s.o || chr(10) || 'user:' || r.text} END) END),
      list_concat([{'c': p.v[4].c + 4, 'a': p.v[4].a || 'D', 'o': p.v[4].o}], CASE WHEN r.away THEN [] ELSE
        [CASE WHEN r.role[1] = 'a' THEN {'c': p.v[3].c + r.more, 'a': p.v[3].a || 'K', 'o': p.v[3].o || chr(10) || r.role || ':' || r.text}
          ELSE {'c': p.v[3].c + 3 + r.more, 'a': p.v[3].a || 'R', 'o': p.v[3].o || chr(10) || 'assistant:' || r.text} END] END)]],
      lambda w: [list_min(w[1]), list_min(w[2]), list_min(list_concat(w[3],
        list_transform([list_min(w[1]), list_min(w[2]), list_min(w[4])], lambda s: {'c': s.c + 3, 'a': s.a || 'I', 'o': s.o || chr(10) || 'user:'}))), list_min(w[4])]),
      lambda w: [w[1], w[2], w[3], list_min([w[4], {'c': w[3].c + 3, 'a': w[3].a || 'I', 'o': w[3].o || chr(10) || 'assistant:'}])])[1]}).v AS v FROM begun),
b AS (SELECT *, list_min([v[1], v[4]]) AS best FROM e)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
"""
