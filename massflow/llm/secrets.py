"""Secret scans with multipart credential linking.

Three base kinds of span are always reported. Three weak kinds (further access
identifiers, mixed 40-character keys, endpoints) are common in harmless text, so
each is reported only when its complementary parts lie within ``SCOPE`` code
points of it in the same text: an identifier needs a secret, a key needs an
identifier, an endpoint needs both. The parts meet in an interval join on
(document, bin of text), so one long text is spread over many keys. Only
DataFrame operations are used.

Defined results: null counts as empty; a text without spans gives zeros, the
SHA-256 of the empty string and an empty ``spans``; a repeated doc_id gives one
row per row read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import row_id, stored, table

#: Kind, pattern, group whose length counts, least length, role. The first three are the base kinds; fixed values.
KINDS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, "secret"),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "identifier"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, "secret"),
    ("identifier", r"(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{12,}", 0, 16, "identifier"),
    ("key", r"[A-Za-z0-9/+]{40,}", 0, 40, "secret"),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""", 0, 10, "endpoint"),
]
BASE = 3
#: What a key must hold at least one of, each.
KEY_MIX = ["[a-z]", "[A-Z]", "[0-9]"]
NEEDS = {"identifier": ["secret"], "secret": ["identifier"], "endpoint": ["identifier", "secret"]}
SCOPE = 400
BIN = 1024

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _running(steps: Column) -> Column:
    """Start and end of each step (gap, len, ok) when gaps and matches follow each other.

    Two levels of about the square root of their number keep the copying of
    growing arrays small for a text with very many matches.
    """
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(steps))).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, width), lambda i: F.slice(steps, i + 1, width))

    def walk(chunk: Column) -> Column:
        none = F.expr("struct(0 AS at, cast(array() AS array<struct<start:int,end:int,ok:boolean>>) AS found)")
        return F.aggregate(
            chunk,
            none,
            lambda a, s: F.struct(
                (a["at"] + s["gap"] + s["len"]).alias("at"),
                F.concat(a["found"], F.array(F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["len"]).alias("end"), s["ok"].alias("ok")))).alias("found"),
            ),
        )

    def shifted(walked: Column) -> Column:
        offsets = F.aggregate(walked, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w["at"])))
        both = F.transform(F.array(offsets), lambda o: F.flatten(F.transform(walked, lambda w, i: F.transform(w["found"], lambda s: F.struct((s["start"] + o[i]).alias("start"), (s["end"] + o[i]).alias("end"), s["ok"].alias("ok"))))))
        return both[0]

    return F.transform(F.array(F.transform(chunks, walk)), shifted)[0]


def _spans(text: Column, kind: int) -> Column:
    """Code-point spans of one kind: leftmost, without overlap, failing ones dropped.

    What stands between matches and the matches themselves alternate, so their
    lengths give the places.
    """
    name, pattern, group, least, _ = KINDS[kind]
    p = F.lit(pattern)
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, p, 0)
    parts = F.arrays_zip(gaps.alias("g"), matches.alias("m"), F.regexp_extract_all(text, p, group).alias("v"))
    fits = lambda v: reduce(Column.__and__, (v.rlike(x) for x in KEY_MIX)) if name == "key" else F.lit(True)
    steps = F.transform(
        F.filter(parts, lambda x: x["m"].isNotNull()),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), ((F.length(x["v"]) >= least) & fits(x["v"])).alias("ok")),
    )
    found = F.transform(F.array(steps), _running)[0]
    kept = F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))
    return F.when(text.rlike(pattern), kept).otherwise(F.expr(f"cast(array() AS {SPAN})"))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(rid, added): the weak spans whose complementary parts are in scope."""
    roles = F.array(*(F.lit(k[4]) for k in KINDS))
    both = found.where("size(weak) > 0 and size(base) + size(weak) > 1")
    span = lambda c: both.select("rid", F.inline(c)).withColumn("role", roles[F.col("kind")])
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))).alias("bin")
    weak = span("weak").select("*", bins(F.col("start") - scope, F.col("end") + scope))
    parts = span(F.concat("base", "weak")).select(F.col("rid").alias("p_rid"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("role").alias("p_role"), bins(F.col("start"), F.col("end")).alias("p_bin"))
    near = (F.col("rid") == F.col("p_rid")) & (F.col("bin") == F.col("p_bin")) & (F.col("role") != F.col("p_role")) & (F.col("p_start") <= F.col("end") + scope) & (F.col("p_end") >= F.col("start") - scope)
    has = {r: F.max(F.col("p_role") == r).alias(f"has_{r}") for r in ("identifier", "secret")}
    met = weak.join(parts, near).groupBy("rid", "start", "kind", "end", "role").agg(*has.values())
    enough = reduce(Column.__or__, ((F.col("role") == r) & reduce(Column.__and__, (F.col(f"has_{x}") for x in need)) for r, need in NEEDS.items()))
    return met.where(enough).groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the counts, digest and spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [_spans(text, k) for k in range(len(KINDS))]
    found = stored(docs.select(row_id().alias("rid"), "doc_id", F.concat(*kinds[:BASE]).alias("base"), F.concat(*kinds[BASE:]).alias("weak")), "spans")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    added = F.coalesce(F.col("added"), F.expr(f"cast(array() AS {SPAN})"))
    return found.join(_linked(found, scope), "rid", "left").select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", added)).alias("spans"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    def spans(k: int) -> str:
        name, pattern, group, least, _ = KINDS[k]
        q = pattern.replace("'", "''")
        mix = "".join(f" AND regexp_matches(v[i], '{x}')" for x in KEY_MIX) if name == "key" else ""
        return f"""SELECT rid, {k} AS kind, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, string_split_regex(t, '{q}') AS g,
            regexp_extract_all(t, '{q}', 0) AS m, regexp_extract_all(t, '{q}', {group}) AS v FROM d) WHERE len(m) > 0
            QUALIFY length(v[i]) >= {least}{mix}"""

    def one(k: int) -> str:
        inner = spans(k).replace("QUALIFY", ") x WHERE")
        return f"SELECT rid, kind, sum_gap + sum_match - length(m[i]) AS s, sum_gap + sum_match AS e FROM (SELECT *, list_sum(list_transform(g[1:i], lambda z: length(z))) AS sum_gap, list_sum(list_transform(m[1:i], lambda z: length(z))) AS sum_match FROM ({inner}) y"

    every = " UNION ALL ".join(f"SELECT rid, kind, s, e, '{KINDS[k][4]}' AS role FROM ({one(k)}) z{k}" for k in range(len(KINDS)))
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    label = f"{names}[kind + 1] || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS MATERIALIZED (SELECT rid, kind, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e, role FROM ({every}) u),
weak AS (SELECT w.rid, w.kind, w.s, w.e, w.role, bool_or(p.role = 'identifier') AS hi, bool_or(p.role = 'secret') AS hs
  FROM spans w JOIN spans p ON w.rid = p.rid AND w.role <> p.role AND p.s <= w.e + {SCOPE} AND p.e >= w.s - {SCOPE}
  WHERE w.kind >= {BASE} GROUP BY ALL),
shown AS (SELECT rid, kind, s, e FROM spans WHERE kind < {BASE} UNION ALL
  SELECT rid, kind, s, e FROM weak WHERE role = 'identifier' AND hs OR role = 'secret' AND hi OR role = 'endpoint' AND hi AND hs)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg({label}, ',' ORDER BY s, kind, e) FILTER (kind < {BASE}), '')) AS base_sha256,
  coalesce(string_agg({label}, ',' ORDER BY s, kind, e) FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN shown USING (rid) GROUP BY rid, doc_id
"""


ORACLE_SQL = _oracle()
