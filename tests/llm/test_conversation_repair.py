"""Conversation repair against a shortest path over whole conversations, and the scan's cuts against the uncut scan."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from lectern.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int"
GROUPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def slow(turns):
    """(blank, duplicate, truncated, illegal, cost, audit, lines) by Dijkstra over (turn, state), the least (cost, audit) first."""
    seen, facts = set(), []
    for role, text in turns:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        facts.append((blank, not blank and (role, text) in seen, not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)))
        seen.add((role, text))
    pairs = [x[0][:1] + y[0][:1] for x, y in zip(turns, turns[1:])]
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(turns) and state in (0, 3):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for letter, role in (("u", "user"), ("a", "assistant")):
            if state in GROUPS[letter]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, GROUPS[letter][state], (*lines, f"{role}:")))
        if i == len(turns):
            continue
        (role, text), (blank, again, cut) = turns[i], facts[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
        if not blank and not again:
            if state in GROUPS.get(role[:1], {}):
                heapq.heappush(heap, (cost + cut, audit + "K", i + 1, GROUPS[role[:1]][state], (*lines, f"{role}:{text}")))
            for letter, new in (("u", "user"), ("a", "assistant")):
                if state in GROUPS[letter]:
                    heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, GROUPS[letter][state], (*lines, f"{new}:{text}")))
    counts = (sum(f[0] for f in facts), sum(f[1] for f in facts), sum(f[2] and not f[0] and not f[1] for f in facts), sum(p not in ("su", "ua", "au") for p in pairs))
    return (*counts, cost, audit, lines)


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own, role, text = by.setdefault(conv, []), " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        numbers = {r[0] for r in own} - {None}
        *facts, lines = slow([r[1:] for r in own])
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *facts, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, conversations=60):
    rng, rows = random.Random(seed), []
    for conv in [*range(conversations), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 13])):
            for _ in range(rng.choice([1, 1, 1, 1, 2])):
                role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
                rows.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), role, rng.choice(["One.", "two", "Thrée!? \n", "", " \t", None, "yes.", ". x"]), "x", 1))
    return rows


def results(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


@pytest.fixture
def given(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        return results(cr.op12_conversation_repair(spark, str(tmp_path)))

    return run


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_shortest_paths(given, seed):
    rows = made(seed)
    assert given(rows) == expected(rows)


def test_sql_equals_shortest_paths(spark, tmp_path):
    rows = made(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    got = con.sql(cr.OP12_SQL)
    assert {r[got.columns.index("conv_id")]: tuple(r[got.columns.index(c)] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got.fetchall()} == expected(rows)


def test_long_conversation_over_many_partitions(spark, tmp_path):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", f"cut {t}", "ok."]), "x", 1) for t in range(3000)]
    rows += [(7, 3, "user", "copy.", "x", 1)] * 500 + [(8, 1, "user", "Hi.", "x", 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        assert results(cr.op12_conversation_repair(spark, str(tmp_path))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_empty_table(given):
    assert given([]) == {}


def test_products_may_be_grouped_in_any_way():
    rng = random.Random(9)
    turns = [cr.turn_matrix(rng.choice("suax"), rng.random() < 0.3) if rng.random() < 0.8 else cr.deleted(rng.randrange(1, 4)) for _ in range(90)]
    whole = cr.Product()
    for m in turns:
        whole.add(m)
    left = turns[0]
    for m in turns[1:]:
        left = cr.times(left, m)
    right = turns[-1]
    for m in reversed(turns[:-1]):
        right = cr.times(m, right)
    assert whole.value() == left == right
