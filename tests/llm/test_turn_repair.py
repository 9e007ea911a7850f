from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridelens.llm import turn_repair as T
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part string, key string, copies string"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, standing turns) by a search over all edits, cheapest and ASCII-least first."""
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        n = NEXT[state]
        heapq.heappush(heap, (cost + 2, audit + "I", i, n, (*out, (NAMES[n], ""))))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = fault == "truncated"
        if role[:1] == n or state == "" and role[:1] == "s":
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, (role, text))))
        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, n, (*out, (NAMES[n], text))))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        draw = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        out += [(conv, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return out


def expected(original, rows):
    """The contract's result for each conversation of ``original``, whose rows after damage are ``rows``."""
    out = []
    for conv in {r[0] for r in original}:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0,
                                hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, standing = cheapest([(r, t, f) for (_, r, t), f in zip(own, faults, strict=True)])
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in standing).encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]),
                          st.sampled_from(["", "", "truncated", "blank"]), st.integers(1, 5)), max_size=6))
def test_run_length_program_equals_a_search(parts):
    rows = [(role, "t", fault) for role, fault, n in parts for _ in range(n)]
    kinds = [r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _, _ in rows]
    symbols = ["-" if f == "blank" else k.upper() if f else k for k, (_, _, f) in zip(kinds, rows, strict=True)]
    runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
    audit, state, cost = T.unroll(runs, T.START, T.END, True)
    want = cheapest(rows)
    assert (cost, audit) == want[:2] and not T.END[state]
    standing = T.edited(audit, T.START, iter([r[:2] for r in rows]))
    assert [x[1:] for x in standing] == want[2]


def test_powers_advance_long_runs():
    for symbol in T.CHOICES:
        slow = T.END
        for _ in range(77):
            slow = T.before(T.power(symbol, 0), slow)
        assert T.before_run(symbol, 77, T.END) == slow == T.before(T.run_matrix(symbol, 77), T.END)
    assert T.before_run("u", 10**12, T.END)[T.START] == 10**12  # every other one becomes an assistant


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, T.op11_turn_repair(spark, SF).collect()), key=str)
    assert got == expected(rows, damage(rows))


EDGES = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "No"),
    (2, None, None, None), (2, None, "user", None), (2, 5, None, "text"), (2, 5, "", "no role."),
    (None, 0, "user", "no id."), (None, None, "assistant", "none"), (3, 7, "system", " \t\n"), (4, 0, "system", "S."),
    (4, 2**60, "user", "far\u0085 "), (4, -5, "Übung", "odd?"), (5, 1, "user", "long. " * 50_000),
    *[(6, t % 3, "user", "same.") for t in range(40)], *[(7, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(30)],
    *[(8, 0, r, "tie.") for r in ("user", "assistant", "system", "x")], (9, None, "a", "b"), (9, None, "a", "b"),
]


@pytest.mark.parametrize("long_rows", [T.LONG_ROWS, 3])
def test_edges_whole_and_in_parts(spark, long_rows):
    df = spark.createDataFrame([r + ("x",) * 4 for r in EDGES], SCHEMA).repartition(3)
    got = sorted(map(tuple, T.repair(T.damaged(df), long_rows=long_rows).collect()), key=str)
    assert got == expected(EDGES, damage(EDGES))
    plain = [tuple(" " if x is None and k > 1 else x for k, x in enumerate(r)) for r in EDGES]
    got = sorted(map(tuple, T.repair(T.intact(df), long_rows=long_rows).collect()), key=str)
    assert got == expected(plain, plain)


def test_long_texts_are_cut_by_bytes(spark):
    df = spark.createDataFrame([r + ("x",) * 4 for r in EDGES], SCHEMA)
    got = sorted(map(tuple, T.repair(T.damaged(df), long_bytes=100).collect()), key=str)
    assert got == expected(EDGES, damage(EDGES))


def test_repaired_turns_hash_to_the_digest(spark):
    df = spark.createDataFrame([r + ("x",) * 4 for r in EDGES], SCHEMA)
    for long_rows in (T.LONG_ROWS, 3):
        turns: dict = {}
        for r in sorted(T.repair(T.intact(df), True, long_rows).collect(), key=lambda r: (r.part or 0, r.place)):
            turns.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
        for r in T.repair_conversations(df).collect():
            assert hashlib.sha256("\n".join(turns.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_a_hot_conversation_is_spread_over_tasks(spark):
    # a third of all rows in one conversation, a third of them equal
    hot = spark.range(3_000).select(F.lit(1).alias("conv_id"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id"))
                                    .alias("turn"), F.lit("user").alias("role"),
                                    F.when(F.col("id") % 3 == 0, "same.").otherwise(F.concat(F.lit("t"), F.col("id")))
                                    .alias("text"))
    rows, any_long = T.with_parts(T.with_kinds(T.intact(hot)), long_rows=100)
    parts = [r["n"] for r in rows.dropDuplicates(["turn", "key"]).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert any_long and len(parts) >= 15 and max(parts) <= 600
    want = expected([(1, 0, "", "")], [(1, r[1], r[2], r[3]) for r in hot.collect()])
    assert [tuple(r) for r in T.repair(T.intact(hot), long_rows=100).collect()] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert T.repair(T.damaged(df)).collect() == [] and T.repair_conversations(df, True).collect() == []
