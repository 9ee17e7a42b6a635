r"""Chat formatting in windows of a token budget.

A conversation's turns are put in order by turn (null first; ties by role and text)
and rendered by a template. The running sum of the turns' tokens deals them into
spans of whole turns: a span begins in each slot of the sum, a turn that reaches over
a slot's end stays in it if it is short and has a window of its own if not. A window
shows the system turn (a first turn of that role), then the turns of at most HISTORY
tokens before its span, then its span. What an earlier window has shown is repeated
without loss; the loss mask covers the texts of the span's assistant turns.

Template: ``<turn ROLE>\n``, the text, ``\n</turn>\n``. In a text, a run of backslashes
that ends at ``<turn`` or ``</turn`` gets one backslash more, so the template's own marks
are those without one; in a role ``\``, ``<``, ``>`` and line ends become ``\b``, ``\l``,
``\g`` and ``\n``.

Defined results: a null text or role is empty; a null turn goes first; rows with a null
conv_id form one conversation; repeated rows are turns of their own; a turn longer than
the budget is a window by itself, whole, with ``over`` set; a system turn of more than
SYSTEM tokens isn't repeated; an empty table gives no windows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massflow.llm import bpe
from massflow.llm.common import ROW, numbered_rows, table
from massflow.llm.ordered import PLACE, folded, ordered, running

#: Tokens of a window, of the turns that it repeats, and of a system turn that windows repeat.
BUDGET, HISTORY, SYSTEM = 2048, 256, 512

_CONTROL = r"(\\*)(</?turn)"
_ROLE = [("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")]
_TURN = re.compile(r"<turn ([^>]*)>\n(.*?)\n</turn>\n", re.S)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$1$2")


def _role_escaped(role: Column) -> Column:
    for plain, mark in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(mark))
    return role


def parsed(window: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window's text."""
    marks = {m: p for p, m in _ROLE}
    return [(re.sub(r"\\[blgn]", lambda m: marks[m[0]], role), unescaped(text)) for role, text in _TURN.findall(window)]


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\*</?turn)", r"\1", text)


def turn_order() -> list[Column]:
    """conv_id, then turn; ties by role and text. A text's start and digest stand for it, as ranges of tasks are made of these."""
    return [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.sha2(F.concat_ws("\n", "role", "text"), 256)]


def in_turn_order(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of turns (conv_id, turn, role, text) in the turns' order, with PLACE; whole texts aren't dealt out anew."""
    keys = {f"__o{i}": k for i, k in enumerate(turn_order())}
    return ordered(rows.select(*keep, *(k.alias(n) for n, k in keys.items())), [F.col(n) for n in keys]).drop(*keys)


def windows(conversations: DataFrame, tokens: Callable[[Column], Column], budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """(conv_id, window, first_turn, repeated, n_turns, tokens, over, text, loss): the windows of every conversation.

    ``tokens`` makes the number of a text's tokens from its column. ``window`` grows along
    the conversation; ``repeated`` counts the turns shown again, and ``loss`` holds the
    spans (start, end; code points of ``text``) of the targets.
    """
    if not 0 <= history <= (budget - history - system) // 4:
        raise ValueError("history must be a quarter of what the budget leaves for new turns, at most")
    head = F.concat(F.lit("<turn "), _role_escaped(F.col("role")), F.lit(">\n"))
    head_size = F.char_length(head)
    body = F.concat(head, escaped(F.col("text")), F.lit("\n</turn>\n"))
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = numbered_rows(plain.withColumn("tokens", tokens(body).cast("long")))
    turns = in_turn_order(whole, "conv_id", "role", "tokens", ROW)
    turns = running(turns, ["conv_id"], pos=("sum", F.lit(1)))
    kept = (F.col("pos") == 0) & (F.col("role") == "system") & (F.col("tokens") <= system)
    turns = turns.withColumn("kept", kept).withColumn("own", F.when(kept, 0).otherwise(F.col("tokens")))
    turns = running(turns, ["conv_id"], at=("sum", F.col("own")), lead=("max", F.when(F.col("kept"), F.struct("tokens", ROW))))
    turns = turns.withColumn("room", F.lit(budget - history) - F.coalesce("lead.tokens", F.when(F.col("kept"), F.col("tokens")), F.lit(0)))
    # a slot is narrower than the room for new turns by the short turn that may reach over its end
    slot_width = F.col("room") - F.floor(F.col("room") / 4)
    turns = turns.withColumn("slot", F.floor(F.col("at") / slot_width))
    over_end = F.floor((F.col("at") + F.greatest(F.col("own"), F.lit(1)) - 1) / slot_width) > F.col("slot")
    alone = over_end & (F.col("own") > F.floor(F.col("room") / 4)) & (F.col("at") > 0)
    near_end = F.col("at") + history >= (F.col("slot") + 1) * slot_width
    turns = turns.withColumn("window", 2 * F.col("slot") + alone.cast("long"))
    turns = turns.withColumn("in_slot", F.explode(F.when(near_end & ~F.col("kept"), F.array("slot", F.col("slot") + 1)).otherwise(F.array("slot"))))
    # each window past the first shows the system turn: of its rows, those that begin a slot in their task ask for it
    dealt = Window.partitionBy("conv_id", "in_slot", F.shiftright(PLACE, 33)).orderBy(PLACE)
    turns = turns.withColumn("asks", F.when(F.row_number().over(dealt) == 1, F.col("lead")[ROW]))
    turn = F.struct("pos", F.when(F.col("slot") == F.col("in_slot"), F.col("window")).alias("window"), "at", "tokens", "kept").alias("turn")
    rows = turns.select("conv_id", "in_slot", turn, F.explode(F.when(F.col("asks").isNull(), F.array(ROW)).otherwise(F.array(ROW, "asks"))).alias("row"), (F.col(ROW)).alias("own_row"))
    text = whole.select(F.col(ROW).alias("row"), F.struct(head_size.alias("head"), F.char_length(escaped(F.col("text"))).alias("size"), (F.col("role") == "assistant").alias("target"), body.alias("body"), "tokens").alias("text"))
    shown = rows.join(text, "row").withColumn("again", F.col("row") != F.col("own_row"))
    slots = shown.groupBy("conv_id", "in_slot").agg(
        F.array_sort(F.collect_list(F.when(~F.col("again"), F.struct("turn.*", "text.head", "text.size", "text.target", "text.body")))).alias("turns"), F.max(F.when(F.col("again"), F.struct("text.tokens", "text.body"))).alias("system")
    )
    mine = F.filter("turns", lambda t: t["window"].isNotNull())
    spans = slots.select("conv_id", "turns", "system", F.explode(F.array_distinct(F.transform(mine, lambda t: t["window"]))).alias("window"))
    spans = spans.withColumn("new", F.filter("turns", lambda t: t["window"] == F.col("window")))
    start = F.get("new", F.lit(0))
    before = F.filter("turns", lambda t: (t["pos"] < start["pos"]) & (t["at"] >= start["at"] - history) & ~t["kept"])
    lead = F.when(F.col("system").isNotNull() & (start["pos"] > 0), F.array("system")).otherwise(F.expr("cast(array() as array<struct<tokens:bigint,body:string>>)"))
    brief = lambda ts: F.transform(ts, lambda t: F.struct(t["tokens"].alias("tokens"), t["body"].alias("body")))
    shown = spans.select("conv_id", "window", "new", start["pos"].alias("first_turn"), F.concat(lead, brief(before)).alias("again"))
    parts = F.concat("again", brief(F.col("new")))
    shift = F.aggregate("again", F.lit(0).cast("int"), lambda n, t: n + F.char_length(t["body"]))
    ends = F.aggregate(
        "new", F.struct(shift.alias("n"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans")),
        lambda s, t: F.struct(
            (s["n"] + F.char_length(t["body"])).alias("n"),
            F.when(t["target"], F.concat(s["spans"], F.array(F.struct((s["n"] + t["head"]).alias("start"), (s["n"] + t["head"] + t["size"]).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    return shown.select(
        "conv_id", "window", "first_turn", F.size("again").alias("repeated"), F.size("new").alias("n_turns"), total.alias("tokens"), (total > budget).alias("over"),
        F.array_join(F.transform(parts, lambda t: t["body"]), "").alias("text"), ends["spans"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows' texts and masks alone: its turns' number and digest, the number of code points and
    the digest of what the loss is taken of, and the code points of its turns as formatted, each turn once."""

    def parts(text: str, repeated: int, loss: list) -> tuple[int, str, int, str, int]:
        turns = parsed(text)
        targets = [unescaped(text[s["start"] : s["end"]]) for s in loss]
        again = 0
        for k, m in enumerate(_TURN.finditer(text)):
            if k == repeated:
                break
            again = m.end()
        said = "".join(f"{r}\n{t}\n" for r, t in turns[repeated:])
        return len(turns) - repeated, said, sum(map(len, targets)), "".join(targets), len(text) - again

    kind = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = F.udf(parts, kind, useArrow=True)
    rows = formatted.select("conv_id", "window", read("text", "repeated", "loss").alias("r")).select("conv_id", "window", "r.*")
    return folded(rows, ["conv_id"], ["window"], ["n_turns", "loss_chars", "formatted_chars"], ["turns_sha256", "loss_sha256"])


#: A conversation of control strings that the query adds to the table.
PLANTED = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(windows(rows, bpe.token_count(bpe.public_coder(spark))))


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
             6 + length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n')) + 2
             + length(regexp_replace(text, '(\\*)(</?turn)', '\\\1\2', 'g')) + 9 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""
