"""Conversation repair against a uniform-cost search over all edits, and the SQL."""

import hashlib
import heapq
import random
import zlib

import duckdb
import pytest

from hiresift.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\f\r"


def cheapest_by_cost(rows):
    """(cost, edits) by growing cost, then edits; the first accepted is the answer."""
    heap, seen = [(0, "", 0, "")], set()
    while True:
        cost, edits, i, last = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, edits
        if (i, last) in seen:
            continue
        seen.add((i, last))
        speaks = "a" if last == "u" else "u"
        heapq.heappush(heap, (cost + 3, edits + "I", i, speaks))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last))
            if fault in ("", "t"):
                stays = cost + 3 * (fault == "t")
                if initial == speaks or (last == "" and initial == "s"):
                    heapq.heappush(heap, (stays, edits + "K", i + 1, initial))
                heapq.heappush(heap, (stays + 3, edits + "R", i + 1, speaks))


def random_rows(r, n):
    return [(r.choice("ssuuuaaaa x"), r.choice(["", "", "", "", "t", "b", "d"])) for _ in range(n)]


def test_search_equals_uniform_cost():
    r = random.Random(2)
    for _ in range(1500):
        rows = random_rows(r, r.randrange(15))
        assert repair.Search(rows).cheapest() == cheapest_by_cost(rows)


def test_heuristic_is_never_too_high():
    r = random.Random(4)
    for _ in range(500):
        rows = random_rows(r, r.randrange(1, 9))
        search = repair.Search(rows)
        for i in range(len(rows) + 1):
            assert search.at_least(i, repair.START) <= cheapest_by_cost(rows[i:])[0]


@pytest.mark.parametrize("size", [1, 2, 3, 5])
def test_folded_blocks_equal_the_whole(size):
    r = random.Random(size)
    for _ in range(400):
        rows = random_rows(r, r.randrange(1, 14))
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        tables = [repair.block_table(b, k == 0, k == len(cut) - 1) for k, b in enumerate(cut)]
        [(before, after, cost, edits)] = repair.fold(tables)
        assert (before, after, cost, edits) == (repair.START, repair.ACCEPTED, *cheapest_by_cost(rows))


def test_long_and_wrong_throughout():
    for pattern in ("u", "a", "uuaa", "uax", "sua"):
        rows = [(pattern[i % len(pattern)], "") for i in range(64)]
        assert repair.Search(rows).cheapest() == cheapest_by_cost(rows)


# --- tables -------------------------------------------------------------------------------
def brute(rows):
    """The query's rows, in plain Python."""
    by_conv = {}
    for conv, turn, role, text in rows:
        damaged = by_conv.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(kind, text)
        damaged += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, damaged in by_conv.items():
        damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        judged, seen = [], set()
        for _, role, text in damaged:
            end = text.rstrip(BLANKS)[-1:]
            fault = "b" if not end else "d" if (role, text) in seen else "t" if end not in ".!?" else ""
            seen.add((role, text))
            judged.append((role[:1], fault))
        turns = [t for t, _, _ in damaged if t is not None]
        cost, edits = cheapest_by_cost(judged)
        made, i, last = [], 0, ""
        for e in edits:
            speaks = "assistant" if last == "u" else "user"
            if e == "I":
                made.append((speaks, ""))
            else:
                if e != "D":
                    made.append((damaged[i][1] if e == "K" else speaks, damaged[i][2]))
                i += 1
            last = made[-1][0][0] if made else ""
        faults = [f for _, f in judged]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in made).encode()).hexdigest()
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, edits, digest))
    return sorted(out, key=str)


def conversations():
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "cut off", "", "  ", "Ünd.\n", None, "a\x85", "done. \t", ". . ."]
    roles = ["user", "user", "assistant", "assistant", "system", None, "", "tool", "User"]
    rows = [(c, t, roles[t % 2 * 2] if r.random() < 0.8 else r.choice(roles), f"{c} {t}." if r.random() < 0.5 else r.choice(texts)) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, None, "user", "Hi."), (100, None, "assistant", "Ho."), (None, 1, "user", "x."), (None, 2, "assistant", "y."), (101, None, None, None)]
    rows += [(102, 5, "user", "same."), (102, 5, "user", "same."), (102, -(2**62), "assistant", "z."), (102, 2**62, "user", "long. " * 50_000)]
    rows += [(103, t, r.choice(["user", "assistant"]), f"turn {t}" + r.choice([".", ""])) for t in range(700)]  # several blocks
    rows += [(104, 7, "user", "ok.")] * 300  # one turn, all the same
    rows += [(105, t, "system", "s.") for t in range(90)]
    return rows


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = repair.op11_conversation_repair(spark, str(tmp_path))
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert [t for c, t in got.dtypes if c in ("gaps", "blank", "cost")] == ["bigint"] * 3
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    cursor = con.execute(repair.SQL["op11_conversation_repair"])
    assert [c[0] for c in cursor.description] == got.columns
    assert sorted(cursor.fetchall(), key=str) == want


def test_repaired_rows_alternate(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (2, 0, "user", "u."), (3, 0, "assistant", "  ")]
    verdicts, repaired = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    made = {}
    for r in repaired.collect():
        made.setdefault(r.conv, []).append((r.row_no, r.role, r.text))
    assert made == {"=1": [(0, "system", "s."), (1, "user", ""), (2, "assistant", "a.")], "=2": [(0, "user", "u."), (1, "assistant", "")]}
    assert {r.conv: (r.cost, r.audit) for r in verdicts.collect()} == {"=1": (3, "KIK"), "=2": (3, "KI"), "=3": (4, "D")}


def test_nothing_and_clashing_names(spark, tmp_path):
    for name, rows in (("none", []), ("some", [(1, 1, "user", "a.")])):
        df = spark.createDataFrame(rows, SCHEMA)
        for extra in ("conv", "pos", "block", "audit", "digest"):
            df = df.selectExpr("*", f"'x' as {extra}")
        df.write.parquet(str(tmp_path / name / "conversations.parquet"))
        assert sorted(map(tuple, repair.op11_conversation_repair(spark, str(tmp_path / name)).collect())) == brute(rows)
        assert repair.judged(repair.numbered_rows(df)).count() == len(rows)
