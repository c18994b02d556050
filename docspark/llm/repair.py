"""Conversation structure repair: the cheapest edits that give roles (s?(ua)+)?, by a run-length DP over min-plus transitions.

Every row is one of few symbols: its role's initial (u, a, s, other) and its fault. Blank and duplicate rows must go; a truncated row costs more when it stays.
Between rows the repaired text so far is in one of four states (nothing, s, u, a), so a row is a 4 x 4 min-plus matrix, and so is any stretch of rows.

1. Rows with equal id, turn, role and text are counted before the shuffle; texts stay where they lie until the last step, which needs an md5 of each only.
2. The counted rows get their places in the conversation (``turns.placed``: a conversation may lie in many ranges) and are cut in chunks of CHUNK.
3. Equal consecutive symbols are runs. The cost to go before a run of n is the cost after it, advanced through the binary powers of the symbol's matrix,
   which are cached. Conversations of several chunks make one matrix per chunk first; a pass over these matrices (not the rows) carries the cost to go
   back and, after every chunk has told where it would lead from each state, the state forward. So one conversation's chunks are solved in parallel.
4. Each chunk unrolls its choices: at every row the least initial among the cheapest edits. Each initial leads to one state only, so this is the least audit.
5. Edits and texts meet sorted by conversation and place, and pass by one row at a time.

Edits: Keep, Rerole (to user or assistant, as the state asks), Delete, Insert (an empty user or assistant row before a row or at the end).

Cases: null ids form one conversation; a null role or text is one space, so a null text is blank; null turns come first; equal turns are ordered by role, then by
the md5 of the text; repeated rows are duplicates; an empty table gives no rows; other columns are not read. Turns whose distance does not fit a long stop the job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.scratch import settle
from docspark.llm.turns import placed

CHUNK = 4096
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
FAR = 1 << 60
# States: 0 nothing yet, 1 after the leading s, 2 after u, 3 after a. An insertion or a changed role is u unless an a is due.
NEXT = (2, 2, 3, 2)
KEEP = {"u": (2, 2, None, 2), "a": (None, None, 3, None), "s": (1, None, None, None), "o": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}
LEGAL = ("su", "ua", "au")
BLANK, CUT = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def _options(symbol: str) -> list[tuple[str, list[tuple[int, int] | None]]]:
    """Edits of a row, in the order of their initials: for each state (cost, next state) or None. Capital letters: truncated. D: must go."""
    delete = ("D", [(DELETE, q) for q in range(4)])
    if symbol == "D":
        return [delete]
    more = TRUNCATED if symbol.isupper() else 0
    keep = ("K", [None if to is None else (more, to) for to in KEEP[symbol.lower()]])
    return [delete, keep, ("R", [(more + REROLE, NEXT[q]) for q in range(4)])]


OPTIONS = {s: _options(s) for s in "uasoUASOD"}


def with_insertions(costs: list[int]) -> Vector:
    """Costs to go once rows may be inserted first: after one, two or three of them nothing new is reached."""
    out = []
    for q in range(4):
        best, at = costs[q], q
        for n in (1, 2, 3):
            at = NEXT[at]
            best = min(best, n * INSERT + costs[at])
        out.append(min(best, FAR))
    return tuple(out)


END = with_insertions([0, FAR, FAR, 0])


def through(matrix: Matrix, after: Vector) -> Vector:
    """Costs to go before a stretch, from those after it."""
    return tuple(min(FAR, *(a + b for a, b in zip(row, after))) for row in matrix)


def product(a: Matrix, b: Matrix) -> Matrix:
    columns = [through(a, column) for column in zip(*b)]
    return tuple(zip(*columns))


@lru_cache(None)
def power(symbol: str, k: int) -> Matrix:
    """The transition of 2 ** k rows with the symbol."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    costs = [[FAR] * 4 for _ in range(4)]
    for _, moves in OPTIONS[symbol]:
        for q, move in enumerate(moves):
            if move:
                costs[q][move[1]] = min(costs[q][move[1]], move[0])
    return tuple(zip(*(with_insertions([costs[q][to] for q in range(4)]) for to in range(4))))


def advance(runs: list[tuple[str, int]], after: Vector) -> Vector:
    """Costs to go before the runs."""
    for symbol, n in reversed(runs):
        k = 0
        while n:
            if n & 1:
                after = through(power(symbol, k), after)
            n, k = n >> 1, k + 1
    return after


IDENTITY: Matrix = tuple(tuple(0 if q == to else FAR for to in range(4)) for q in range(4))


def transition(runs: list[tuple[str, int]]) -> Matrix:
    """The matrix of the runs."""
    return tuple(zip(*(advance(runs, column) for column in zip(*IDENTITY))))


def unroll(runs: list[tuple[str, int]], state: int, after: Vector) -> tuple[list[str], int]:
    """Initials of the edits of every row (insertions stand before it), and the state at the end."""
    ends = [after]
    for run in reversed(runs):
        ends.append(advance([run], ends[-1]))
    out: list[str] = []
    for (symbol, n), end in zip(runs, reversed(ends[:-1])):
        if symbol == "D":  # a row that must go goes at once: D is the least initial and an insertion before it costs the same after it
            out += ["D"] * n
            continue
        costs = [end]
        for _ in range(n):
            costs.append(through(power(symbol, 0), costs[-1]))
        for at in range(n, 0, -1):
            letters = ""
            while True:
                letter, state, stays = _least(symbol, state, costs[at], costs[at - 1])
                letters += letter
                if not stays:
                    break
            out.append(letters)
    return out, state


def _least(symbol: str, state: int, now: Vector, later: Vector) -> tuple[str, int, bool]:
    """The least initial among the cheapest edits, the state it leads to, and whether the row is still to come."""
    for letter, moves in OPTIONS[symbol]:
        if letter == "K" and INSERT + now[NEXT[state]] == now[state]:
            return "I", NEXT[state], True
        move = moves[state]
        if move and move[0] + later[move[1]] == now[state]:
            return letter, move[1], False
    raise AssertionError("no edit reaches the cost to go")


def tail(state: int) -> str:
    """Insertions after the last row."""
    out = ""
    while END[state]:
        out, state = out + "I", NEXT[state]
    return out


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def entry_runs(symbols: str, counts: list[int]) -> list[tuple[str, int]]:
    """Runs of counted rows: what repeats a row must go."""
    if max(counts, default=1) == 1:
        return runs_of(symbols)
    out: list[list] = []
    for symbol, n in zip(symbols, counts):
        for s, k in ((symbol, n),) if symbol == "D" else ((symbol, 1), ("D", n - 1)):
            if k and out and out[-1][0] == s:
                out[-1][1] += k
            elif k:
                out.append([s, k])
    return [(s, k) for s, k in out]


@lru_cache(1 << 14)
def _solved(symbols: str, counts: tuple[int, ...], state: int, after: Vector, last: bool) -> tuple[list[str], str, int]:
    """Letters of every counted row, those after the last row, and the cost."""
    letters, end = unroll(entry_runs(symbols, list(counts)), state, after)
    of_rows, at = [], 0
    for n in counts:
        of_rows.append("".join(letters[at : at + n]))
        at += n
    more = tail(end) if last else ""
    stays = sum(s in "UASO" and not letters.lstrip("I").startswith("D") for s, letters in zip(symbols, of_rows))
    text = "".join(of_rows) + more
    return of_rows, more, TRUNCATED * stays + DELETE * text.count("D") + INSERT * text.count("I") + REROLE * text.count("R")


def illegal_pairs(roles: str, counts: list[int]) -> int:
    """Adjacent initials that may not follow each other; copies of a row never may."""
    return sum(n - 1 for n in counts) + sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))


def _lists(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    for batch in batches:
        yield list(zip(*(batch.column(c).to_pylist() for c in columns)))


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), schema)], names=[n for n, _ in schema])


_LONG, _LONGS, _TEXT = pa.int64(), pa.list_(pa.int64()), pa.string()


def _matrices(batches):
    schema = [("conv", _LONG), ("chunk", _LONG), ("matrix", _LONGS), ("first", _TEXT), ("final", _TEXT)]
    for rows in _lists(batches, "conv", "chunk", "symbols", "roles", "counts"):
        made = [(conv, chunk, [v for row in transition(entry_runs(symbols, counts)) for v in row], roles[0], roles[-1]) for conv, chunk, symbols, roles, counts in rows]
        yield from _batch(made, schema)


def _backward(batches):
    """Chunks come last first; each gets the cost to go after it. The last one has END."""
    schema, key, after = [("conv", _LONG), ("chunk", _LONG), ("after", _LONGS), ("last", pa.bool_()), ("first", _TEXT), ("final", _TEXT)], (), END
    for rows in _lists(batches, "conv", "chunk", "matrix", "first", "final"):
        made = []
        for conv, chunk, numbers, first, final in rows:
            last = key != (conv,)
            key, after = (conv,), END if last else after
            made.append((conv, chunk, list(after), last, first, final))
            after = through(tuple(tuple(numbers[i : i + 4]) for i in range(0, 16, 4)), after)
        yield from _batch(made, schema)


def _leads(batches):
    """Where each chunk leads from every state."""
    schema = [("conv", _LONG), ("chunk", _LONG), ("after", _LONGS), ("last", pa.bool_()), ("first", _TEXT), ("final", _TEXT), ("leads", _LONGS)]
    for rows in _lists(batches, "conv", "chunk", "after", "last", "first", "final", "symbols", "counts"):
        yield from _batch([(*r[:6], [unroll(entry_runs(r[6], r[7]), q, tuple(r[2]))[1] for q in range(4)]) for r in rows], schema)


def _forward(batches):
    """Chunks come in order; each gets the state before it, and whether its first role may not follow the one before."""
    schema, key, state, before = [("conv", _LONG), ("chunk", _LONG), ("after", _LONGS), ("last", pa.bool_()), ("state", _LONG), ("broken", _LONG)], (), 0, ""
    for rows in _lists(batches, "conv", "chunk", "after", "last", "first", "final", "leads"):
        made = []
        for conv, chunk, after, last, first, final, leads in rows:
            if key != (conv,):
                key, state, before = (conv,), 0, ""
            made.append((conv, chunk, after, last, state, int(bool(before) and before + first not in LEGAL)))
            state, before = leads[state], final
        yield from _batch(made, schema)


def _solve(batches):
    schema = [("conv", _LONG), ("chunk", _LONG), ("letters", pa.list_(_TEXT)), ("tail", _TEXT), ("cost", _LONG), ("illegal", _LONG)]
    for rows in _lists(batches, "conv", "chunk", "symbols", "roles", "counts", "after", "last", "state", "broken"):
        made = []
        for conv, chunk, symbols, roles, counts, after, last, state, broken in rows:
            letters, more, cost = _solved(symbols, tuple(counts), state, tuple(after), last)
            made.append((conv, chunk, letters, more, cost, illegal_pairs(roles, counts) + broken))
        yield from _batch(made, schema)


def _solved_chunks(chunks: DataFrame) -> DataFrame:
    """conv, chunk, letters, tail, cost, illegal of all chunks (conv, chunk, symbols, roles, counts)."""
    many = settle(chunks.filter("chunk > 0").select(F.col("conv").alias("long_conv")).distinct())
    same = F.col("conv").eqNullSafe(F.col("long_conv"))
    ends = [F.array(*(F.lit(v).cast("bigint") for v in END)).alias("after"), F.lit(True).alias("last"), F.lit(0).cast("bigint").alias("state"), F.lit(0).cast("bigint").alias("broken")]
    columns = ("conv", "chunk", "symbols", "roles", "counts")
    short = chunks.join(many, same, "left_anti").select(*columns, *ends)
    if not many.isEmpty():
        long = settle(chunks.join(many, same, "left_semi"))
        key, kept = "conv bigint, chunk bigint", "after array<bigint>, last boolean"
        matrices = long.mapInArrow(_matrices, f"{key}, matrix array<bigint>, first string, final string")
        back = matrices.repartition("conv").sortWithinPartitions(F.col("conv"), F.col("chunk").desc()).mapInArrow(_backward, f"{key}, {kept}, first string, final string")
        named = lambda df: df.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), *[c for c in df.columns if c not in ("conv", "chunk")])
        met = F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
        led = long.join(named(settle(back)), met).mapInArrow(_leads, f"{key}, {kept}, first string, final string, leads array<bigint>")
        states = led.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(_forward, f"{key}, {kept}, state bigint, broken bigint")
        short = short.union(long.join(named(settle(states)), met).select(*short.columns))
    return short.mapInArrow(_solve, "conv bigint, chunk bigint, letters array<string>, tail string, cost bigint, illegal bigint")


def _entries(slim: DataFrame) -> DataFrame:
    """Counted rows with their symbol: conv, turn, role, mark, n, initial, symbol, blank."""
    counted = settle(slim.groupBy("conv", "turn", "role", "mark", "blank", "cut").agg(F.count("*").alias("n")))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = counted.groupBy("conv", "role", "mark").agg(F.min(order).alias("least"), F.count("*").alias("times")).filter("times > 1")
    seen = settle(seen.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("m"), "least"))
    met = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("mark") == F.col("m"))
    rows = counted.join(seen, met, "left")
    again = F.col("least").isNotNull() & ~F.col("least.turn").eqNullSafe(F.col("turn"))
    letter = F.substring("role", 1, 1)
    initial = F.when(letter.isin("u", "a", "s"), letter).otherwise(F.lit("o"))
    symbol = F.when(F.col("blank") | again, F.lit("D")).when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    return rows.withColumn("initial", initial).select("conv", "turn", "role", "mark", "n", "blank", "cut", again.alias("again"), "initial", symbol.alias("symbol"))


class Repair:
    """Cheapest repair of all conversations. ``edits``: conv, turn, role, mark, letters of every counted row; ``tails``: conv, letters after the last row."""

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"):
        who, body = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
        self.rows = rows.select(F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), who.alias("role"), body.alias("text"), F.md5(body.cast("binary")).alias("mark"))
        slim = self.rows.select("conv", "turn", "role", "mark", F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(CUT)).alias("cut"))
        self.entries = settle(placed(_entries(slim), "conv", ["turn", "role", "mark"]).withColumn("chunk", F.floor((F.col("place") - 1) / CHUNK)))
        one = F.struct("place", "symbol", "initial", "n")
        held = self.entries.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(one)).alias("e"))
        texts = [F.array_join(F.col("e")[f], "").alias(c) for f, c in (("symbol", "symbols"), ("initial", "roles"))]
        self.solved = settle(_solved_chunks(held.select("conv", "chunk", *texts, F.col("e")["n"].alias("counts"))))
        letters = self.solved.select(F.col("conv").alias("c"), F.col("chunk").alias("k"), F.posexplode("letters").alias("at", "letters"))
        met = F.col("conv").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")) & ((F.col("place") - 1) % CHUNK == F.col("at"))
        self.edits = self.entries.join(letters, met).select("conv", "turn", "role", "mark", "letters")
        self.tails = self.solved.filter("tail <> ''").select("conv", F.col("tail").alias("letters"))

    def counts(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost of every conversation with rows."""
        per_turn = self.entries.groupBy("conv", "turn").agg(
            F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
            F.sum(F.when(~F.col("blank") & ~F.col("again") & F.col("cut"), 1).otherwise(0)).alias("truncated"),
        )
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
        faults = per_turn.groupBy("conv").agg(gaps, *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        costs = self.solved.groupBy(F.col("conv").alias("c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
        return faults.join(costs, F.col("conv").eqNullSafe(F.col("c"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def steps(self) -> DataFrame:
        """conv, letters, role, text in order: an edit with the row it gives, or deletions (role and text null).

        The rows of a conversation lie together and in order in one partition; they pass one by one, so memory follows a row. That order is the
        repaired conversation's own, whoever writes or digests it goes through it in sequence.
        """
        columns = ("conv", "late", "turn", "role", "mark", "kind", "letters", "text")
        no = F.lit(None).cast("string")
        edits = self.edits.select("conv", F.lit(False).alias("late"), "turn", "role", "mark", F.lit(0).alias("kind"), "letters", no.alias("text"))
        tails = self.tails.select("conv", F.lit(True).alias("late"), F.lit(None).cast("bigint").alias("turn"), no.alias("role"), no.alias("mark"), F.lit(0).alias("kind"), "letters", no.alias("text"))
        texts = self.rows.select("conv", F.lit(False).alias("late"), "turn", "role", "mark", F.lit(1).alias("kind"), no.alias("letters"), "text")
        together = edits.union(tails).union(texts).repartition("conv").sortWithinPartitions(*columns[:6])
        return together.mapInArrow(_steps, "conv bigint, letters string, role string, text string")


def _steps(batches):
    schema = [("conv", _LONG), ("letters", _TEXT), ("role", _TEXT), ("text", _TEXT)]
    key, state, due = None, 0, ""
    for rows in _lists(batches, "conv", "role", "kind", "letters", "text"):
        made = []
        for conv, role, kind, letters, text in rows:
            if key != (conv,):
                key, state = (conv,), 0
            if kind == 0:
                due = letters.lstrip("I")
                for _ in range(len(letters) - len(due)):
                    state = NEXT[state]
                    made.append((conv, "I", ROLE[state], ""))
                if due.startswith("D"):
                    made.append((conv, due, None, None))
                    due = ""
            elif due:
                state = NEXT[state] if due[0] == "R" else KEEP[role[0]][state]
                made.append((conv, due[0], ROLE[state] if due[0] == "R" else role, text))
                if due[1:]:
                    made.append((conv, due[1:], None, None))
                due = ""
        yield from _batch(made, schema)


def _digests(batches):
    schema = [("conv", _LONG), ("audit", _TEXT), ("repaired_sha256", _TEXT)]
    key, audit, state, empty = None, [], None, True
    for rows in _lists(batches, "conv", "letters", "role", "text"):
        made = []
        for conv, letters, role, text in rows:
            if key != (conv,):
                if key:
                    made.append((key[0], "".join(audit), state.hexdigest()))
                key, audit, state, empty = (conv,), [], hashlib.sha256(), True
            audit.append(letters)
            if role is not None:
                state.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        yield from _batch(made, schema)
    if key:
        yield from _batch([(key[0], "".join(audit), state.hexdigest())], schema)


def digests(steps: DataFrame) -> DataFrame:
    """conv, audit (all initials in order), repaired_sha256 (``role:text`` of the repaired rows, joined by line feeds) of ``Repair.steps``, read as it lies."""
    return steps.mapInArrow(_digests, "conv bigint, audit string, repaired_sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of conversations with planted faults, chosen by crc32("conv_id:turn") % 20; nulls are one space in the key and in role and text.

    0 drops the row, 1 empties its text, 2 takes its ends of sentences out, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.encode(F.concat(part("conv_id"), F.lit(":"), part("turn")), "UTF-8")) % 20
    text, role = part("text"), part("role")
    changed = rows.select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), fault.alias("fault"),
    ).filter("fault <> 0")
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return changed.select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations``: its faults in ``damaged``, the cost of the repair, its audit and the digest of what it gives."""
    made = Repair(damaged)
    ids = conversations.select("conv_id").distinct()
    counts, found = made.counts(), digests(made.steps()).withColumnRenamed("conv", "d")
    rows = ids.join(counts, F.col("conv_id").eqNullSafe(F.col("conv")), "left").join(found, F.col("conv_id").eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
