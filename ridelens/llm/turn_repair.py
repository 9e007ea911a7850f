"""Conversation structure repair: the cheapest edits that make a conversation well-formed, by a run-length DP.

Well-formed: no turn at all, or an optional system turn and then user and assistant turns in pairs. Edits: keep a turn
(0), give it the role user or assistant (2), delete it (3, needed for blank and repeated turns), insert an empty turn of
user or assistant (2). A truncated turn that stays costs 1 more.

Method
------
Each turn is one of nine symbols (role x truncated or not, or "must go") and a conversation a sequence of runs of equal
symbols. A symbol is a 4 x 4 min-plus matrix over the states of the wanted pattern (start, after system, after user,
after assistant); its powers for 1, 2, 4, ... turns are computed once and kept. A run of n turns is advanced by the powers
in n, from the end of the conversation to its start, which gives the cost still to come at every border of
runs. The audit is unrolled from the start: in a run, halves are entered with the cost to come after them (again by
powers) until single turns are left, and there the first letter in ASCII order that reaches the cheapest cost is taken.
A letter and a state fix the next state, so this is the ASCII-least of the cheapest audits.

A conversation of ordinary length is one group of sorted rows of a task (bounded by ``LONG_ROWS`` and
``LONG_BYTES``). A longer one is cut into parts that are worked on separately: each part's runs give its matrix; the
matrices of a conversation (a row per part) give the cost to come after every part; each part is unrolled for every state
it may be entered in; the states are chained (a row per part again); and the parts' rows are edited beside their piece of the
audit. Copies of a row are one row with a count there, collapsed before the shuffle. Only the digest of the whole
repaired text has to see it in order; its last step reads pieces of text as a stream.

Defined results: null conv_id, turn, role and text are one space where text is needed; a null conv_id is a conversation
of its own; null turns come first; rows of one turn stand in the order of a digest of role and text, so copies are
adjacent; an empty role has no initial, so it can't be kept; a conversation without rows is intact; other columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise
from operator import itemgetter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelens.llm.arrow_rows import in_tasks
from ridelens.llm.common import materialize, table
from ridelens.llm.conversations import LONG_BYTES, LONG_ROWS, row_key, with_parts

BLANKS = " \t\n\x0b\x0c\r"
STOPS = ".!?"
PIECE_BYTES = 1_000_000

# ---- the dynamic program --------------------------------------------------------------------------------------

START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of an inserted or re-roled turn
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# symbols: role class, upper case if the turn is truncated; "-" must go
MUST_GO = "-"
END = (0, 2 * INSERT, INSERT, 0)  # what is still to come at the end, by state


def choices(symbol: str) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of one turn: (letter, cost, next state), letters in ASCII order."""
    out = []
    for q in range(4):
        edits = [("D", DELETE, q)]
        if symbol != MUST_GO:
            more = TRUNCATED if symbol.isupper() else 0
            kept = KEPT.get((q, symbol.lower()))
            edits += [("K", more, kept)] if kept is not None else []
            edits.append(("R", REROLE + more, NEXT[q]))
        out.append(edits)
    return out


CHOICES = {s: choices(s) for s in "xsuaXSUA" + MUST_GO}


def times(a: tuple, b: tuple) -> tuple:
    """Min-plus product of two 4 x 4 matrices (rows of costs)."""
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min(map(sum, zip(row, col, strict=True))) for col in columns) for row in a)


def before(matrix: tuple, later: tuple) -> tuple:
    """Cost to come before what ``matrix`` stands for, from the cost to come after it."""
    return tuple(min(map(sum, zip(row, later, strict=True))) for row in matrix)


def _one(symbol: str) -> tuple:
    step = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        for _, cost, to in CHOICES[symbol][q]:
            step[q][to] = min(step[q][to], cost)
    inserts = [[NEVER] * 4 for _ in range(4)]
    for q in range(4):
        at, cost = q, 0
        while cost < inserts[q][at]:
            inserts[q][at] = cost
            at, cost = NEXT[at], cost + INSERT
    return times(tuple(map(tuple, inserts)), tuple(map(tuple, step)))


@lru_cache(maxsize=None)  # nine symbols, a power per bit of a run's length
def power(symbol: str, bit: int) -> tuple:
    """The matrix of 2**bit turns of ``symbol``, with what is inserted before them."""
    return times(power(symbol, bit - 1), power(symbol, bit - 1)) if bit else _one(symbol)


IDENTITY = tuple(tuple(0 if a == b else NEVER for b in range(4)) for a in range(4))


def run_matrix(symbol: str, n: int) -> tuple:
    out = IDENTITY
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            out = times(out, power(symbol, bit))
    return out


def before_run(symbol: str, n: int, later: tuple) -> tuple:
    for bit in range(n.bit_length()):
        if n >> bit & 1:
            later = before(power(symbol, bit), later)
    return later


def unroll_run(symbol: str, n: int, state: int, later: tuple, out: list[str]) -> int:
    """Append the letters of the cheapest, ASCII-least edits of a run; returns the state after it."""
    if n > 1:
        half = n // 2
        state = unroll_run(symbol, n - half, state, before_run(symbol, half, later), out)
        return unroll_run(symbol, half, state, later, out)
    here = before(power(symbol, 0), later)
    while True:
        options = CHOICES[symbol][state]
        best = options[0]
        if best[1] + later[best[2]] != here[state]:  # not deleted
            if INSERT + here[NEXT[state]] == here[state]:
                out.append("I")
                state = NEXT[state]
                continue
            best = next(o for o in options if o[1] + later[o[2]] == here[state])
        out.append(best[0])
        return best[2]


def unroll(runs: list, state: int, later: tuple, last: bool) -> tuple[str, int, int]:
    """(audit, state after it, cost to come before it) of runs entered in ``state``; ``later``: cost to come after."""
    costs = [later]
    for symbol, n in reversed(runs):
        costs.append(before_run(symbol, n, costs[-1]))
    cost, out = costs[-1][state], []
    for (symbol, n), after in zip(runs, reversed(costs[:-1]), strict=True):
        state = unroll_run(symbol, n, state, after, out)
    while last and END[state]:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state, cost


ROLES = {USER: "user", ASSISTANT: "assistant"}


def edited(audit: str, state: int, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what stands after the edits of ``audit``, entered in ``state``."""
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            yield letter, ROLES[state], ""
            continue
        role, text = next(turns)
        if letter == "K":
            state = KEPT[state, role[:1]]
            yield letter, role, text
        elif letter == "R":
            state = NEXT[state]
            yield letter, ROLES[state], text


# ---- rows -----------------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies) of the contract's damage; a dropped row has no copies."""
    def text_of(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    draw = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    text = text_of(F.col("text"))
    rows = conversations.select(conv.alias("conv"), turn.alias("turn"), text_of(F.col("role")).alias("role"),
                                text.alias("text"), draw.alias("draw"))
    return rows.select(
        "conv", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", STOPS, "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).cast("long").alias("copies"))


def intact(conversations: DataFrame) -> DataFrame:
    """The same columns of ``conversations`` (conv_id, turn, role, text) as they are."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
        F.lit(1).cast("long").alias("copies"))


ROW = ("conv", "turn", "role", "text", "copies", "key", "kind")


def with_kinds(rows: DataFrame) -> DataFrame:
    """Adds key and kind: "b" if blank, else the symbol the row has unless it repeats an earlier one."""
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(bare == "", "b").when(F.substring(bare, -1, 1).isin(*STOPS), kind).otherwise(F.upper(kind))
    return rows.select("conv", "turn", "role", "text", "copies", row_key(F.col("role"), F.col("text")).alias("key"),
                       kind.alias("kind"))


class Tally:
    """Counts and runs of a conversation's (or part's) rows, added in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None
        self.runs: list[list] = []

    def add(self, turn: int | None, initial: str, kind: str, repeated: bool, copies: int) -> None:
        """``copies`` equal rows; ``repeated``: an earlier row is equal in role and text."""
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is None:
            self.first = initial
        else:
            self.illegal += not legal(self.last, initial)
        self.illegal += copies - 1  # two equal initials are never legal
        self.last = initial
        if kind == "b":
            self.blank += copies
            self._run(MUST_GO, copies)
            return
        own = 0 if repeated else 1
        self.duplicate += copies - own
        self.truncated += own and kind.isupper()
        self._run(kind, own)
        self._run(MUST_GO, copies - own)

    def _run(self, symbol: str, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([symbol, n])


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


class Digest:
    """SHA-256 of pieces joined by new lines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, piece: str) -> None:
        self.sha.update(("\n" + piece if self.any else piece).encode())
        self.any = True


SUMMARY = ("conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
TURNS = "conv long, part int, place long, edit string, role string, text string"


def whole_conversations(rows: Iterator[tuple], want_turns: bool) -> Iterator[tuple]:
    """Sorted rows (ROW) of whole conversations -> a SUMMARY row each, or TURNS rows."""
    for conv, group in groupby(rows, itemgetter(0)):
        tally, seen, turns = Tally(), set(), []
        for _, turn, role, text, copies, key, kind in group:
            if not copies:
                continue
            tally.add(turn, role[:1], kind, key in seen, copies)
            if kind != "b":
                seen.add(key)
            turns += [(role, text)] * copies
        audit, _, cost = unroll(tally.runs, START, END, True)
        standing = edited(audit, START, iter(turns))
        if want_turns:
            yield from ((conv, None, k, *t) for k, t in enumerate(standing))
            continue
        digest = Digest()
        for _, role, text in standing:
            digest.add(f"{role}:{text}")
        yield (conv, gaps(tally.low, tally.high, tally.turns), tally.blank, tally.duplicate, tally.truncated,
               tally.illegal, cost, audit, digest.sha.hexdigest())


# ---- long conversations, part by part -------------------------------------------------------------------------

PIECE = ("conv long, part int, blank long, duplicate long, truncated long, illegal long, turns long, low long, "
         "high long, first string, last string, symbols string, counts array<long>, matrix array<long>")


def part_pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (conv, part, turn, initial, kind, repeated, copies) -> a PIECE row per part."""
    for (conv, part), group in groupby(rows, itemgetter(0, 1)):
        t = Tally()
        for _, _, turn, initial, kind, repeated, copies in group:
            t.add(turn, initial, kind, repeated, copies)
        matrix = IDENTITY
        for symbol, n in t.runs:
            matrix = times(matrix, run_matrix(symbol, n))
        yield (conv, part, t.blank, t.duplicate, t.truncated, t.illegal, t.turns, t.low, t.high, t.first, t.last,
               "".join(s for s, _ in t.runs), [n for _, n in t.runs], [min(c, NEVER) for row in matrix for c in row])


def costs_after(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, [(part, matrix)]) -> (conv, part, cost to come after it by state, whether it is the last part)."""
    for conv, parts in rows:
        later, out = END, []
        for p in reversed(parts):
            out.append((conv, p["part"], list(later), len(out) == 0))
            m = p["matrix"]
            later = before(tuple(tuple(m[4 * q:4 * q + 4]) for q in range(4)), later)
        yield from out


def part_audits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, part, symbols, counts, later, last) -> (conv, part, audits, exits, costs), by state of entry."""
    for conv, part, symbols, counts, later, last in rows:
        runs = list(zip(symbols, counts, strict=True))
        ways = [unroll(runs, q, tuple(later), last) for q in range(4)]
        yield conv, part, *(list(x) for x in zip(*ways, strict=True))


def entry_states(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, [(part, exits)]) -> (conv, part, state in which it is entered)."""
    for conv, parts in rows:
        state = START
        for p in parts:
            yield conv, p["part"], state
            state = p["exits"][state]


def totals(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, [pieces], cost, audit, sha) -> a SUMMARY row."""
    for conv, pieces, cost, audit, sha in rows:
        n = {k: sum(p[k] for p in pieces) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
        seen = [p for p in pieces if p["low"] is not None]
        n["turns"] -= sum(a["high"] == b["low"] for a, b in pairwise(seen))
        n["illegal"] += sum(not legal(a["last"], b["first"]) for a, b in pairwise(pieces))
        low, high = (seen[0]["low"], seen[-1]["high"]) if seen else (None, None)
        yield (conv, gaps(low, high, n["turns"]), n["blank"], n["duplicate"], n["truncated"], n["illegal"], cost,
               audit, sha)


def part_turns(rows: Iterator[tuple], want_turns: bool) -> Iterator[tuple]:
    """Sorted (conv, part, head, role, text, copies), a head row (state, audit) first in each part -> TURNS rows, or
    (conv, part, place, piece of the repaired text) with pieces of about PIECE_BYTES."""
    for (conv, part), group in groupby(rows, itemgetter(0, 1)):
        _, _, _, state, audit, _ = next(group)
        turns = ((role, text) for _, _, _, role, text, copies in group for _ in range(copies))
        standing = edited(audit, int(state), turns)
        if want_turns:
            yield from ((conv, part, k, *t) for k, t in enumerate(standing))
            continue
        held, size, place = [], 0, 0
        for _, role, text in standing:
            held.append(f"{role}:{text}")
            size += len(held[-1])
            if size >= PIECE_BYTES:
                yield conv, part, place, "\n".join(held)
                held, size, place = [], 0, place + 1
        if held:
            yield conv, part, place, "\n".join(held)


def text_digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted (conv, part, place, piece) -> (conv, SHA-256); pieces pass as a stream."""
    for conv, group in groupby(rows, itemgetter(0)):
        digest = Digest()
        for *_, piece in group:
            digest.add(piece)
        yield conv, digest.sha.hexdigest()


def by_part(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv", "part").sortWithinPartitions("conv", "part", *order)


def same(left: DataFrame, right: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Join on equal or both null ``keys``."""
    other = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return left.join(other, on, how).drop(*[f"{k}_" for k in keys])


def repair_long(rows: DataFrame, want_turns: bool) -> DataFrame:
    """SUMMARY or TURNS rows of the conversations that are cut into parts; ``rows``: ROW and part."""
    keys = ["conv", "part", "turn", "key", "role", "text", "kind"]
    rows = rows.groupBy(*keys).agg(F.sum("copies").alias("copies"))
    rows = materialize(rows.withColumn("at", F.struct("turn")), "repair-rows")
    present = rows.where("copies > 0")
    again = present.where("kind <> 'b'").groupBy("conv", "key").agg(F.min("at").alias("once"), F.max("at").alias("end"))
    again = again.where(F.col("once") < F.col("end")).drop("end")
    narrow = present.select("conv", "part", "turn", "at", "key", F.substring("role", 1, 1).alias("initial"), "kind",
                            "copies")
    narrow = same(narrow, again, "conv", "key", how="left").withColumn(
        "repeated", F.coalesce(F.col("at") > F.col("once"), F.lit(False)))
    pieces = materialize(in_tasks(by_part(narrow, "turn", "key").select(
        "conv", "part", "turn", "initial", "kind", "repeated", "copies"), part_pieces, PIECE), "repair-pieces")

    def of_conversation(df: DataFrame, *columns: str) -> DataFrame:
        return df.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias("parts"))

    later = in_tasks(of_conversation(pieces, "matrix"), costs_after,
                     "conv long, part int, later array<long>, last boolean")
    audits = materialize(in_tasks(same(pieces.select("conv", "part", "symbols", "counts"), later, "conv", "part"),
                                  part_audits, "conv long, part int, audits array<string>, exits array<int>, "
                                  "costs array<long>"), "repair-audits")
    entries = in_tasks(of_conversation(audits, "exits"), entry_states, "conv long, part int, state int")
    chosen = materialize(same(audits, entries, "conv", "part").select(
        "conv", "part", "state", F.get("audits", "state").alias("audit"), F.get("costs", "state").alias("cost")),
        "repair-chosen")
    heads = chosen.select("conv", "part", F.lit(0).alias("head"), F.col("state").cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"),
                          F.lit(None).cast("long").alias("turn"), F.lit("").alias("key"))
    lines = heads.unionByName(present.select("conv", "part", F.lit(1).alias("head"), "role", "text", "copies", "turn",
                                             "key"))
    lines = by_part(lines, "head", "turn", "key").select("conv", "part", "head", "role", "text", "copies")
    if want_turns:
        return in_tasks(lines, part_turns, TURNS, True)
    text = materialize(in_tasks(lines, part_turns, "conv long, part int, place long, piece string", False),
                       "repair-text")
    digests = in_tasks(text.repartition("conv").sortWithinPartitions("conv", "part", "place"), text_digests,
                       "conv long, sha string")
    letters = chosen.groupBy("conv").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "audit"))), lambda p: p["audit"]), "")
        .alias("audit"), F.min_by("cost", "part").alias("cost"))
    stats = [f.split()[0] for f in PIECE.split(", ")][2:-3]
    empty = F.lit(hashlib.sha256().hexdigest())
    every = same(rows.select("conv").distinct(), of_conversation(pieces, *stats), "conv", how="left")
    every = same(same(every, letters, "conv", how="left"), digests, "conv", how="left")
    return in_tasks(every.select("conv", F.coalesce("parts", F.array()).alias("parts"),
                                 F.coalesce("cost", F.lit(0)).cast("long").alias("cost"),
                                 F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", empty).alias("sha")),
                    totals, SUMMARY)


def repair(rows: DataFrame, want_turns: bool = False, long_rows: int = LONG_ROWS,
           long_bytes: int = LONG_BYTES) -> DataFrame:
    """SUMMARY rows, or TURNS rows, of (conv, turn, role, text, copies)."""
    rows, any_long = with_parts(with_kinds(rows), F.octet_length("text"), long_rows, long_bytes)
    short = rows.where("part IS NULL").repartition("conv").sortWithinPartitions("conv", "turn", "key")
    out = in_tasks(short.select(*ROW), whole_conversations, TURNS if want_turns else SUMMARY, want_turns)
    if not any_long:
        return out
    return out.unionByName(repair_long(rows.where("part IS NOT NULL"), want_turns))


def repair_conversations(conversations: DataFrame, want_turns: bool = False) -> DataFrame:
    """Per conversation its faults, cost, audit and digest, or (``want_turns``) the repaired turns themselves:
    conv_id, part (null in an ordinary conversation), place in it, edit, role, text."""
    return repair(intact(conversations), want_turns).withColumnRenamed("conv", "conv_id")


def op11_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")
