"""Conversation repair against a search over all edits of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import repair
from recordloom.llm.queries import ORACLES, QUERIES

SHAPE = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """The least (cost, audit) over all edits whose initials match, and the lines it leaves; at most two insertions in a row."""
    found = faults(rows)
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    best = None
    per_row = []
    for (_, role, text), fault in zip(rows, found):
        own = [("D", 2, None)]
        if fault in ("", "truncated"):
            extra = 5 if fault else 0
            own += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        per_row.append(own)
    for picks in itertools.product(*per_row):
        base = sum(p[1] for p in picks)
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            cost = base + 5 * sum(map(len, inserted))
            if best is not None and cost > best[0]:
                continue
            audit, lines = "", []
            for i, more in enumerate(inserted):
                for x in more:
                    audit += "I"
                    lines.append(({"u": "user", "a": "assistant"}[x], ""))
                if i < len(picks):
                    audit += picks[i][0]
                    if picks[i][2]:
                        lines.append(picks[i][2])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def conversation(rng, n):
    texts = ["a.", "b!", "cut", "", " \t", "a.", "d? \n", " "]
    return [(i * rng.choice([1, 2]), rng.choice(["user", "assistant", "system", "tool", "", "u2"]), rng.choice(texts)) for i in range(n)]


def test_cheapest_edits_against_search(spark):
    rng = random.Random(3)
    cases = {i: conversation(rng, rng.choice([1, 2, 3, 3])) for i in range(60)}
    rows = [(i, t, r, x) for i, own in cases.items() for t, r, x in own]
    frame = spark.createDataFrame(rows, SHAPE)
    small = {r.conv_id: r for r in repair.repair_report(frame).collect()}
    spilled = {r.conv_id: r for r in repair.repair_report(frame, held_rows=2).collect()}
    assert small == spilled and len(small) == 60
    turns = {}
    for r in repair.repaired_turns(frame, held_rows=2).collect():
        turns.setdefault(r.conv_id, []).append((r.seq, r.new_role, r.new_text))
    for i, own in cases.items():
        own = sorted(own)
        got, (cost, audit, lines) = small[i], brute(own)
        assert (got.cost, got.audit) == (cost, audit), (own, got)
        assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        assert [x[1:] for x in sorted(turns.get(i, []))] == lines
        kinds = faults(own)
        assert (got.blank, got.duplicate, got.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        said = [r[:1] for _, r, _ in own]
        assert got.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        assert got.gaps == own[-1][0] - own[0][0] + 1 - len({t for t, _, _ in own})


def test_giant_conversation_streams(spark):
    """One conversation with a third of all rows goes through the spilled path and gives what the held path gives."""
    rows = [(1, i, ("user", "assistant", "tool")[i % 3 if i % 7 else 1], f"t{i % 900}.") for i in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(2, 602) for t in range(10)]
    frame = spark.createDataFrame(rows, SHAPE).repartition(7)
    a = repair.repair_report(frame, held_rows=64).collect()
    b = repair.repair_report(frame).collect()
    assert sorted(a) == sorted(b) and len(a) == 601
    giant = next(r for r in a if r.conv_id == 1)
    assert giant.duplicate == 3000 - len({(r, x) for c, _, r, x in rows if c == 1})
    assert all(r.audit == "K" * 10 and r.cost == 0 for r in a if r.conv_id != 1)


def test_long_texts_are_spilled_by_size(spark, monkeypatch):
    rows = [(5, i, "user" if i % 2 == 0 else "assistant", "x" * 5000 + f"{i}.") for i in range(20)]
    want = repair.repair_report(spark.createDataFrame(rows, SHAPE)).collect()
    assert want[0].audit == "K" * 20
    assert want[0].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows).encode()).hexdigest()


def test_nulls_ties_ids_and_clashing_columns(spark):
    rows = [(None, None, None, None, 1), (None, None, "user", "a.", 2), (None, 3, "assistant", "b.", 3), (None, 3, "assistant", "b.", 3), (7, None, "user", None, 0)]
    frame = spark.createDataFrame(rows, f"{SHAPE}, place int").withColumns({"id": F.lit("x"), "fault": F.lit(9), "said": F.lit("s")})
    got = {r.conv_id: r for r in repair.repair_report(frame).collect()}
    assert got[None].audit == "DKKD" and got[None].blank == 1 and got[None].duplicate == 1 and got[None].gaps == 0 and got[None].illegal == 2
    assert got[7].audit == "D" and got[7].gaps == 0
    named = spark.createDataFrame([("c", 1, "user", "hi."), ("c", 2, "assistant", "yo.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r)[:1] + (r.audit,) for r in repair.repair_report(named).collect()] == [("c", "KK")]
    empty = repair.repair_damaged(frame.limit(0))
    assert empty.count() == 0 and repair.repaired_turns(frame.limit(0)).count() == 0


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "system" if t == 0 else "user" if t % 2 else "assistant", f"q{t}. ok!") for c in range(40) for t in range(6)]
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([*rows, (dropped, 0, "user", "x."), (3, None, None, None)], SHAPE)
    want = []
    for c, t, role, text in [*rows, (dropped, 0, "user", "x."), (3, None, " ", " ")]:
        code = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        want += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    assert sorted(map(str, map(tuple, repair.damaged(frame).collect()))) == sorted(map(str, want))
    got = {r.conv_id: r.asDict() for r in repair.repair_damaged(frame).collect()}
    assert len(got) == 41 and got[dropped] == {"conv_id": dropped, **repair.NO_ROWS}


def test_query_and_sql_agree_on_hard_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(8)
    rows = [(c if c else None, rng.choice([None, t, t]), rng.choice(["user", "assistant", "system", "tool", None]), rng.choice([None, "a.", "b", " ", "c!", "d?"]))
            for c in range(25) for t in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(r) for r in QUERIES["op11_repair_conversations"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["op11_repair_conversations"]).fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))
