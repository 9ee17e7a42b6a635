"""The operators on conversations against brute force, with nulls, ties, repeated rows, long and hot conversations and empty tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from massflow.llm import chat, repair, trie
from massflow.llm.ordered import PLACE, folded, ordered, running

TURNS = "conv_id long, turn long, role string, text string, pos int, chunk string, depth int, tokens int"
SPACE = " \t\n\v\f\r"


@pytest.fixture(autouse=True)
def many_tasks(spark):
    """Small tables stay dealt over several tasks, so groups are cut."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def turns(spark, rows):
    """Conversations with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 7, "x", 3, 1) for r in rows], TURNS)


def some_rows(seed, convs=40, null_ids=True):
    r, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(r.choice([1, 2, 3, 4, 6, 9, 17])):
            role = r.choice(["user", "assistant"]) if r.random() < 0.8 else r.choice(["system", "tool", None, "", "a>\\<b\n", "u"])
            text = r.choice(["a.", "b b.", "c", "", " \n", None, "d!", "end </turn> <turn x>", "\\<turn \\\\</turn", "é😀."]) if r.random() < 0.7 else f"w{r.randint(0, 3)} x."
            rows.append((c, None if r.random() < 0.05 else t if r.random() < 0.9 else r.randint(0, 3), role, text))
    rows += [(None, 0, "user", "lost."), (None, 1, "assistant", "found")] if null_ids else []
    return rows + rows[:3]


def in_order(rows):
    """Per conversation its (turn, role, text): null turns first, ties by role and text."""
    plain, out = [(c, t, r or "", x or "") for c, t, r, x in rows], {}
    for c, t, r, x in sorted(plain, key=lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or 0, p[2].encode(), p[3].encode())):
        out.setdefault(c, []).append((t, r, x))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_running_aggregates_of_hot_groups(spark):
    d = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.when(F.col("id") < 2500, 5).otherwise(F.col("id"))).alias("g"), (F.col("id") % 50).alias("o"), F.col("id").alias("v"))
    o = running(ordered(d, [F.col("g"), F.col("o")]), ["g"], n=("sum", F.lit(1)), s=("sum", F.col("v")), x=("xor", F.col("v")), top=("max", F.col("v")))
    assert o.select(F.shiftright(PLACE, 33)).distinct().count() > 2
    seen = {}
    for r in sorted(o.collect(), key=lambda r: r[PLACE]):
        before = seen.setdefault(r["g"], [])
        x = 0
        for v in before:
            x ^= v[1]
        assert (r["n"], r["s"], r["x"], r["top"]) == (len(before), sum(v[1] for v in before), x, max((v[1] for v in before), default=None))
        assert not before or before[-1][0] <= r["o"]
        before.append((r["o"], r["v"]))
    assert sum(map(len, seen.values())) == 3000


def test_folded_digests(spark):
    d = spark.createDataFrame([(1, 2, 5, "b"), (1, 1, 6, "a"), (None, 1, 1, ""), (2, 1, 0, "é")], "g long, i long, n long, t string")
    got = {r["g"]: (r["n"], r["t"]) for r in folded(d, ["g"], ["i"], ["n"], ["t"], ",").collect()}
    assert got == {1: (11, sha("a,b")), None: (1, sha("")), 2: (0, sha("é"))}
    assert folded(d.limit(0), ["g"], ["i"], ["n"], ["t"]).count() == 0


# 11


def words(c):
    return F.size(F.split(c, " "))


def rendered(role, text):
    for plain, mark in [("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("\n", "\\n")]:
        role = role.replace(plain, mark)
    return f"<turn {role}>\n" + re.sub(r"(\\*)(</?turn)", r"\\\1\2", text) + "\n</turn>\n"


def test_formatted_conversations_read_back(spark):
    rows = [*some_rows(1), *[(r[0], r[1], r[2], r[3]) for r in chat.PLANTED]]
    for budget, history, system in ((60, 6, 12), (4000, 200, 500), (24, 0, 0)):
        w = chat.windows(turns(spark, rows), words, budget, history, system)
        got = {r["conv_id"]: r for r in chat.read_back(w).collect()}
        want = in_order(rows)
        assert got.keys() == want.keys()
        for c, ts in want.items():
            said = "".join(x for _, r, x in ts if r == "assistant")
            assert got[c]["n_turns"] == len(ts) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in ts))
            assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))
            assert got[c]["formatted_chars"] == sum(len(rendered(r, x)) for _, r, x in ts)
    assert chat.read_back(chat.windows(turns(spark, []), words)).count() == 0


def test_windows_keep_the_budget_and_repeat_what_goes_before(spark):
    r, rows = random.Random(5), [(1, 0, "system", "be kind")]
    rows += [(1, t, ("user", "assistant")[t % 2], " ".join(["w"] * (400 if t in (50, 51) else r.randint(0, 12)))) for t in range(1, 300)]
    budget, history, system = 100, 15, 20
    whole = [(role, text) for _, _, role, text in rows]
    size = lambda x: len(rendered(*x).split(" "))
    ws = sorted(chat.windows(turns(spark, rows), words, budget, history, system).collect(), key=lambda w: w["window"])
    after = 0
    for k, w in enumerate(ws):
        shown, first, again = chat.parsed(w["text"]), w["first_turn"], w["repeated"]
        assert first == after and shown[again:] == whole[first : first + w["n_turns"]]
        after += w["n_turns"]
        assert w["tokens"] == sum(map(size, shown)) and w["over"] == (w["tokens"] > budget)
        assert not w["over"] or w["n_turns"] == 1
        if k:
            past = first
            while past > 1 and sum(map(size, whole[past - 1 : first])) <= history:
                past -= 1
            assert shown[:again] == [whole[0], *whole[past:first]]
        else:
            assert again == 0
        targets = [chat.unescaped(w["text"][s["start"] : s["end"]]) for s in w["loss"]]
        assert targets == [t for role, t in shown[again:] if role == "assistant"]
    assert after == len(rows) and sum(w["over"] for w in ws) == 2 and len(ws) > 20
    one = chat.windows(turns(spark, [(3, 0, "system", "long " * 90), (3, 1, "user", "w " * 60), (3, 2, "assistant", "w " * 60)]), words, budget, history, system).collect()
    assert all(w["repeated"] == 0 for w in one), "a system turn over its limit is not repeated"
    with pytest.raises(ValueError):
        chat.windows(turns(spark, rows), words, 10, 9, 0)


# 12


def trie_by_hand(rows, rebuild=True):
    orig = {c: [(r, x) for _, r, x in ts] for c, ts in in_order(rows).items() if c is not None}
    seqs = {}
    for c, ts in orig.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(orig.get(c - c % 20, [])[:h] + ts[h:] if rebuild else ts)
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = set()
    for node, ms in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in under if n)
        ends = ",".join(map(str, sorted(c for c in ms if len(seqs[c]) == len(node))))
        out.add((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children), len(leaves), saved, sha(ends)))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_all_prefixes(spark, seed):
    rows = some_rows(seed, 45)
    long = [(c, t, ("user", "assistant")[t % 2], f"turn {t % 5}" if c != 62 or t != 19 else "other") for c in (60, 61, 62) for t in range(30 - c % 2)]
    rows += long + [(21, t, "user", "hi there") for t in range(9)]
    t = trie.turn_ids(turns(spark, rows))
    got = trie.trie(trie.rebuilt(t), t.select("conv_id").distinct()).select(COLUMNS).collect()
    want = trie_by_hand(rows)
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_trie_without_turns_or_conversations(spark):
    t = trie.turn_ids(turns(spark, [(41, 0, "user", "a"), (3, 0, "user", "b")]))  # 41 takes 3 turns of 40, which isn't there
    got = trie.trie(trie.rebuilt(t), t.select("conv_id").distinct()).select(COLUMNS).collect()
    assert set(map(tuple, got)) == trie_by_hand([(41, 0, "user", "a"), (3, 0, "user", "b")])
    none = trie.turn_ids(turns(spark, []))
    assert trie.trie(trie.rebuilt(none), none.select("conv_id").distinct()).count() == 0


# 13


def repair_by_hand(rows):
    """Forward over (cost, audit, turns) of each state, an independent way to the least of the cheapest edits."""
    seen, kinds = set(), []
    for _, r, x in rows:
        bare = x.strip(SPACE)
        kinds.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    to, name = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}

    def put(at, s, v):
        if s not in at or v[:2] < at[s][:2]:
            at[s] = v

    def inserted(at):
        for _ in range(4):
            for s, (c, a, o) in list(at.items()):
                put(at, to[s], (c + 3, a + "I", (*o, (name[to[s]], ""))))
        return at

    now = inserted({0: (0, "", ())})
    for (_, r, x), kind in zip(rows, kinds, strict=True):
        new = {}
        for s, (c, a, o) in now.items():
            put(new, s, (c + 4, a + "D", o))
            if kind not in ("blank", "duplicate"):
                c += 3 * (kind == "truncated")
                if r[:1] == "s" and s == 0:
                    put(new, 1, (c, a + "K", (*o, (r, x))))
                if r[:1] == name[to[s]][0]:
                    put(new, to[s], (c, a + "K", (*o, (r, x))))
                put(new, to[s], (c + 3, a + "R", (*o, (name[to[s]], x))))
        now = inserted(new)
    cost, audit, out = min(now[s] for s in (0, 3) if s in now)
    at, initials = {t for t, _, _ in rows if t is not None}, [r[:1] for _, r, _ in rows]
    gaps = max(at) - min(at) + 1 - len(at) if at else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, sha("\n".join(f"{r}:{x}" for r, x in out))


FAULTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def spaced(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_repairs_are_the_cheapest_and_least(spark, size):
    r = random.Random(size)
    rows = some_rows(9)
    rows += [(200, t, "tool", f"x{t}." if t % 7 else f"x{t}") for t in range(40)]  # costs to go never become one here
    rows += [(201, t, "user", f"x{t}") for t in range(33)] + [(202, t, r.choice(["user", "assistant"]), f"{t % 20}" + r.choice([".", ""])) for t in range(50)]
    got = {g["conv_id"]: tuple(g[c] for c in FAULTS) for g in repair.summary(turns(spark, rows), size).collect()}
    want = {c: repair_by_hand(ts) for c, ts in in_order(spaced(rows)).items()}
    assert got == want
    assert repair.summary(turns(spark, []), size).count() == 0


def test_damage_and_repair_of_whole_tables(spark, tmp_path):
    rows = some_rows(4, 60) + [(300, 11, "user", "x.")]
    turns(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for c, t, r, x in spaced(rows):
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(k, x)
        hurt += [(c, t, "user" if k == 4 else r, x)] * {0: 0, 3: 2}.get(k, 1)
    left = in_order(hurt)
    got = {g["conv_id"]: tuple(g[c] for c in FAULTS) for g in repair.op13(spark, str(tmp_path)).collect()}
    assert got == {c: repair_by_hand(left.get(c, [])) for c in {r[0] for r in rows}}


def test_vectors_of_costs_are_few_and_closed():
    assert repair.VECTORS[0] == (0, 6, 3, 0) and len(repair.VECTORS) < 60
    assert all(repair._before(c, v) in repair.VECTORS for c in "suaxSUAXd" for v in repair.VECTORS)
    assert repair.costs_before("") == list(range(len(repair.VECTORS)))
    assert len(set(repair.costs_before("uauaua"))) == 1, "ordinary turns make all costs one"
