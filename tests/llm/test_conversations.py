"""Structure repair and prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from helpers import words
from pyspark.sql import functions as F

from docspark.llm import repair, trie, turns

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "n", "part", "place", "cum", "mark", "symbol", "letters", "chunk", "d", "rep", "group", "depth", "words"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def scattered(spark):
    """Every range keeps its own partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], md5(r[3])))


def odd_conversations(seed, n=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " \n", "Well!", "So it is.", "a b c d", None, "x" * 3000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "usher"]
    rows = []
    for c in [*range(n), None, -7]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 30])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[t % 2], rng.choice(texts)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t % 50}.") for t in range(400)] + [(501, 1, "user", "Again.")] * 40 + [(502, None, "user", "")] * 3
    return rows


def brute_repair(rows):
    """Counts, cost, audit and repaired rows of one conversation's damaged rows (role and text without nulls)."""
    rows, seen, kinds = in_order(rows), set(), []
    for _, _, role, text in rows:
        blank = not words(text)
        again, cut = not blank and (role, text) in seen, text.rstrip(" \t\n\x0b\x0c\r")[-1:] not in (".", "!", "?")
        seen.add((role, text))
        kinds.append("blank" if blank else "duplicate" if again else "truncated" if cut else "")
    following = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(at, state, inserted=0):
        options = []
        if at == len(rows):
            options += [(0, "")] if state in ("", "a") else []
        else:
            role, more = rows[at][2][:1], 5 * (kinds[at] == "truncated")
            cost, audit = best(at + 1, state)
            options.append((2 + cost, "D" + audit))
            if kinds[at] not in ("blank", "duplicate"):
                if role == following[state] or (role == "s" and state == ""):
                    cost, audit = best(at + 1, role)
                    options.append((more + cost, "K" + audit))
                cost, audit = best(at + 1, following[state])
                options.append((more + 1 + cost, "R" + audit))
        if inserted < 3:
            cost, audit = best(at, following[state], inserted + 1)
            options.append((5 + cost, "I" + audit))
        return min(options, default=(10**9, ""))

    for at in range(len(rows), -1, -1):
        for state in following:
            for inserted in (3, 2, 1, 0):
                best(at, state, inserted)
    cost, audit = best(0, "")
    out, at, state = [], 0, ""
    for letter in audit:
        if letter == "I":
            state = following[state]
            out.append({"u": "user:", "a": "assistant:"}[state])
            continue
        if letter == "K":
            state = rows[at][2][:1]
            out.append(f"{rows[at][2]}:{rows[at][3]}")
        elif letter == "R":
            state = following[state]
            out.append({"u": "user:", "a": "assistant:"}[state] + rows[at][3])
        at += 1
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(c, t, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


@pytest.mark.parametrize("chunk", [repair.CHUNK, 3])
def test_repair(spark, scattered, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = odd_conversations(chunk)
    damaged, want = brute_damage(rows), {}
    for c in {r[0] for r in rows}:
        want[c] = brute_repair([r for r in damaged if r[0] == c])
    df = conversations(spark, rows)
    got = {r[0]: tuple(r)[1:] for r in repair.report(df, repair.damage(df)).collect()}
    assert got == want


def test_every_short_conversation():
    """The cost to go and the least audit, for every sequence of up to four symbols and for long runs."""
    symbols = {"u": ("user", "U."), "U": ("user", "U"), "a": ("assistant", "A."), "A": ("assistant", "A"), "s": ("system", "S."), "S": ("system", "S"), "o": ("x", "O."), "D": ("user", "")}
    rng = random.Random(2)
    cases = ["".join(rng.choice("uUaAsSoD") for _ in range(rng.randint(0, 5))) for _ in range(400)] + ["u" * 70, "uA" * 9 + "a" * 33, "s" * 20 + "D" * 40 + "ua", "o" * 31]
    for case in cases:
        rows = [(1, t, symbols[s][0], symbols[s][1].replace(".", f"{t}.") if s.islower() else symbols[s][1] + (str(t) if s != "D" else "")) for t, s in enumerate(case)]
        letters, more, cost = repair._solved(case, (1,) * len(case), 0, repair.END, True) if case else ([], "", 0)
        assert ("".join(letters) + more, cost) == (brute_repair(rows)[6], brute_repair(rows)[5]), case
        assert not case or repair.advance(repair.runs_of(case), repair.END)[0] == cost
        assert not case or repair.through(repair.transition(repair.runs_of(case)), repair.END)[0] == cost


def test_powers_are_cached():
    repair.power.cache_clear()
    assert repair.advance([("u", 10**15)], repair.END) == repair.advance([("u", 10**15 - 1), ("u", 1)], repair.END)
    assert repair.power.cache_info().currsize < 60


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "Yes."), (2, 5, "system", "Be kind."), (2, 6, "assistant", "cut")]
    got = [tuple(r) for r in repair.Repair(conversations(spark, rows)).steps().collect()]
    assert [r for r in got if r[0] == 1] == [(1, "K", "user", "Hi."), (1, "D", None, None), (1, "R", "assistant", "Yes.")]
    assert [r for r in got if r[0] == 2] == [(2, "D", None, None), (2, "D", None, None)]


def test_no_conversations(spark):
    none = conversations(spark, [])
    assert repair.report(none, repair.damage(none)).count() == 0
    assert trie.nodes(*trie.with_common_heads(trie.sequences(none))).count() == 0


def test_places(spark, scattered):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, t long, w long")
    got = sorted((tuple(r) for r in turns.placed(df, "k", ["t"], "w").collect()), key=str)
    want = []
    for k in (1, 2, None):
        own, total = sorted(r for r in rows if r[0] == k) if k else [r for r in rows if r[0] is None], 0
        for place, r in enumerate(own, 1):
            total += r[2]
            want.append((*r, place, total))
    assert got == sorted(want, key=str)


def brute_rebuilt(rows):
    by = {}
    for c, t, role, text in rows:
        if c is not None:
            by.setdefault(c, []).append((c, t, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in in_order(rs)] for c, rs in by.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 4
    base = lambda c: c - (abs(c) % 20 * (1 if c >= 0 else -1))
    return {c: tuple(own.get(base(c), [])[: head(c)] + ts[head(c) :]) for c, ts in own.items()}


def brute_nodes(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        saved[s] = sum(saved[k] for k in kids.get(s, [])) + ((len(members[s]) - 1) * len(words(s[-1][1])) if s else 0)
    digest = lambda s: hashlib.sha256(",".join(map(str, sorted(c for c in members[s] if len(seqs[c]) == len(s)))).encode()).hexdigest()
    return {(min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), len(kids.get(s, [])), leaves[s], saved[s], digest(s)) for s, cs in members.items()}


def branching(seed, n=50):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -23, None]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            text = rng.choice([None, "", "a b", "c", f"own {c}"]) if rng.random() < 0.2 else f"turn {t} of all"
            rows.append((c, rng.choice([t, t, t, t, None]), rng.choice(["user", "user", None]), text))
    rows += [(c, t, "user", f"long {t}") for c in (300, 320, 340, 365) for t in range(23 + c % 7)] + [(400, 1, "user", "same")] * 5 + [(401, 1, "user", "same")] * 5
    return rows


@pytest.mark.parametrize("slab,block,fan", [(trie.SLAB, trie.BLOCK, trie.FAN), (4, 3, 4)])
def test_trie(spark, scattered, monkeypatch, slab, block, fan):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "FAN", fan)
    rows = branching(slab)
    sequences, convs = trie.with_common_heads(trie.sequences(conversations(spark, rows)))
    got = trie.nodes(sequences, convs, slab).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == brute_nodes(brute_rebuilt(rows))


def test_one_conversation(spark):
    got = trie.nodes(*trie.with_common_heads(trie.sequences(conversations(spark, [(20, 1, "user", "a b"), (20, 2, "user", "a")])))).collect()
    assert {tuple(r) for r in got} == brute_nodes({20: (("user", "a b"), ("user", "a"))})


def test_contracted_lists_stay_short():
    """What a range hands on is one component per depth at most, however many conversations it holds."""
    rng = random.Random(3)
    seqs = sorted(tuple(rng.randrange(3) for _ in range(rng.randint(0, 6))) for _ in range(5000))
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    edges = [(shared(a, b), 0) for a, b in zip(seqs, seqs[1:])]
    left = trie.Chain([[0, c, len(s), 1, 0, 0, 0] for c, s in enumerate(seqs)], edges).contract(trie.Out(), True)
    assert len(left.items) <= 2 * 7 + 1 and sum(i[3] for i in left.items) == 5000
