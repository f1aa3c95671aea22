"""Conversation repair: the parse against all edits, whole results against SQL, odd rows."""

import hashlib
import random
import re

import duckdb
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import dialogue_repair as dr

COLUMNS = "conv_id long, turn long, role string, text string, cost int, key string"


def cheapest(rows):
    """The least (cost, audit) over all edits with up to three inserts."""
    found = []

    def go(i, roles, cost, audit, inserts):
        if re.fullmatch("s?(ua)*u?", roles) is None:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if inserts < 3:
            for r in "ua":
                go(i, roles + r, cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, kind = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", inserts)
            if kind < dr.BLANK:
                more = 5 * (kind == dr.TRUNCATED)
                if initial in tuple("sua"):
                    go(i + 1, roles + initial, cost + more, audit + "K", inserts)
                for r in "ua":
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return min(found)


@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", "", " "]), st.integers(0, 3)), max_size=5))
def test_cheapest_edits(rows):
    repair = dr.Repair()
    for initial, kind in rows:
        repair.row(initial, kind)
    assert repair.best() == cheapest(rows)


@given(st.integers(0, 6), st.integers(1, 5))
def test_runs_of_deletions(before, n):
    one, many = dr.Repair(), dr.Repair()
    for x in (one, many):
        for i in range(before):
            x.row("uas"[i % 3], 0)
    many.deleted(n)
    for _ in range(n):
        one.row("u", dr.DUPLICATE)
    assert one.best() == many.best()


def test_long_conversations_settle(monkeypatch):
    monkeypatch.setattr(dr, "TAIL", 8)
    rows = [("uauua"[i % 5], i % 7 % 2) for i in range(300)]
    short, whole = dr.Repair(), dr.Repair()
    for r in rows:
        short.row(*r)
        short.settle()
        whole.row(*r)
    assert short.best() == whole.best() and short.done and max(len(a) for _, a, _ in short.tops.values()) < 100


def test_tables_are_deterministic():
    rules, moves, reductions = dr.tables()
    assert len(rules) == len(dr.GRAMMAR) + 1 and all(len(r) == 1 for r in reductions.values())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS)


def made(seed):
    rng, rows = random.Random(seed), []
    texts = ["Hello there.", "Hello there.", "What?", "no end", " ", "", "Bye!\n", None, "Öl.", "a. b"]
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, 1, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(texts)))
    rows += rows[:40]
    rng.shuffle(rows)
    return rows


def test_against_sql(spark):
    df = frame(spark, made(3))
    conversations = df.toPandas()  # noqa: F841 (read by DuckDB)
    con = duckdb.connect()
    con.register("conversations", conversations.astype({"turn": "Int64"}))
    got = dr.repaired_conversations(df).toPandas()
    want = con.execute(dr.ORACLE_SQL).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(object).values.tolist())) == sorted(map(tuple, want.astype(object).values.tolist()))
    assert len(got) == 60 and got.cost.sum() > 0


def test_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (1, 2, "user", "So?"), (1, 3, "assistant", "Yes."), (2, None, "user", "Alone."), (None, 5, "user", "Q?"), (None, 9, "assistant", "A.")]
    report, turns = dr.repaired(frame(spark, rows))
    of = {r.conv_id: r for r in report.collect()}
    assert (of[1].audit, of[1].cost, of[1].duplicate, of[1].illegal, of[1].gaps) == ("RKKDK", 3, 1, 2, 0)
    assert (of[2].audit, of[2].cost, of[2].gaps) == ("D", 2, 0) and of[2].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert of[None].audit == "KK" and of[None].gaps == 3 and of[None].repaired_sha256 == hashlib.sha256("user:Q?\nassistant:A.".encode()).hexdigest()
    kept = sorted((r.position, r.edit, r.role, r.text) for r in turns.where("conv_id = 1").collect())
    assert kept == [(0, "R", "user", "Be kind."), (1, "K", "assistant", "Hi."), (2, "K", "user", "So?"), (3, "K", "assistant", "Yes.")]
    assert of[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in kept).encode()).hexdigest()


def test_inserts_where_deletes_are_dear(spark, monkeypatch):
    monkeypatch.setattr(dr, "INSERT", ("I", 1))
    repair = dr.Repair()
    for initial in "suuaa":
        repair.row(initial, 0)
    assert repair.best() == (2, "KKIKKIK")


def test_shifted_roles(spark):
    rows = [(1, i, r, f"{i}.") for i, r in enumerate(["assistant", "user", "assistant", "user", "assistant", "user"])]
    report, turns = dr.repaired(frame(spark, rows))
    assert report.first().audit == cheapest([(r[2][0], 0) for r in rows])[1]
    assert [r.role for r in turns.orderBy("position").collect()] == ["user", "assistant"] * (turns.count() // 2)


def test_empty_and_dropped(spark):
    assert dr.repaired_conversations(frame(spark, [])).count() == 0
    gone = next(i for i in range(999) if __import__("zlib").crc32(f"7:{i}".encode()) % 20 == 0)
    row = dr.repaired_conversations(frame(spark, [(7, gone, "user", "x.")])).first()
    assert (row.conv_id, row.audit, row.cost, row.gaps, row.repaired_sha256) == (7, "", 0, 0, hashlib.sha256(b"").hexdigest())
