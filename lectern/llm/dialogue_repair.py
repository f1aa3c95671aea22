"""Repair of conversations: a generalised LR parse of role sequences with weighted edits, over a graph-structured stack."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import joined, stored

#: Role sequences: nothing, or a system turn or none and then pairs of user and assistant. Upper case names a part, lower case a role's initial.
GRAMMAR = (("C", ""), ("C", "sT"), ("C", "T"), ("T", "TP"), ("T", "P"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
TRUNCATED_COST = 5
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
INK, ENDED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
END, START = "$", "Z"
#: A stack that costs so much more than the cheapest is out: the cheapest can go on as it would by two inserts and a delete at most.
SPREAD = 2 * INSERT[1] + DELETE[1]
#: Edits that all stacks of a long conversation have in common are set aside when their strings reach this length.
TAIL = 4096


def _follow(rules: list[tuple[str, str]]) -> dict[str, set[str]]:
    """What may follow each part: sets grown until they are closed."""
    first: dict[str, set[str]] = {left: set() for left, _ in rules}
    empty, follow = set(), {left: {END} if left == START else set() for left, _ in rules}
    while True:
        size = sum(map(len, (*first.values(), *follow.values()))) + len(empty)
        for left, right in rules:
            tail, tail_empty = set(follow[left]), True
            for x in reversed(right):
                if x in follow:
                    follow[x] |= tail
                heads, may_be_empty = (first[x], x in empty) if x in first else ({x}, False)
                tail, tail_empty = heads | (tail if may_be_empty else set()), tail_empty and may_be_empty
            if tail_empty:
                empty.add(left)
            for x in right:
                first[left] |= first[x] if x in first else {x}
                if x not in empty:
                    break
        if size == sum(map(len, (*first.values(), *follow.values()))) + len(empty):
            return follow


@cache
def tables(grammar: tuple[tuple[str, str], ...] = GRAMMAR) -> tuple[list[tuple[str, str]], dict[tuple[int, str], int], dict[tuple[int, str], tuple[int, ...]]]:
    """(rules, moves, reductions) of the grammar's LR automaton: moves by state and symbol; rules to reduce by state and next role. Rule 0 accepts."""
    rules = [(START, grammar[0][0]), *grammar]
    follow = _follow(rules)

    def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        while True:
            more = {(i, 0) for r, dot in items for i, (left, _) in enumerate(rules) if rules[r][1][dot : dot + 1] == left} - items
            if not more:
                return frozenset(items)
            items = items | more

    states, moves, reductions = [closed({(0, 0)})], {}, {}
    for at, items in enumerate(states):
        for symbol in sorted({rules[r][1][dot] for r, dot in items if dot < len(rules[r][1])}):
            found = closed({(r, dot + 1) for r, dot in items if rules[r][1][dot : dot + 1] == symbol})
            if found not in states:
                states.append(found)
            moves[at, symbol] = states.index(found)
        for r, dot in sorted(items):
            if dot == len(rules[r][1]):
                for token in follow[rules[r][0]]:
                    reductions[at, token] = (*reductions.get((at, token), ()), r)
    return rules, moves, reductions


@cache
def _ready(node: tuple, token: str) -> tuple[tuple, ...]:
    """The node and what its reductions before token lead to. A node is (state, node below); nodes below are shared."""
    rules, moves, reductions = tables()
    found = [node]
    for now in found:
        for r in reductions.get((now[0], token), ()):
            below = now
            for _ in rules[r][1]:
                below = below[1]
            if r and (made := (moves[below[0], rules[r][0]], below)) not in found:
                found.append(made)
    return tuple(found)


@cache
def _after(node: tuple, token: str) -> tuple[tuple, ...]:
    """The nodes that a shift of token leads to."""
    moves = tables()[1]
    return tuple((moves[now[0], token], now) for now in _ready(node, token) if (now[0], token) in moves)


@cache
def _accepts(node: tuple) -> bool:
    return any(0 in tables()[2].get((now[0], END), ()) for now in _ready(node, END))


class Repair:
    """The cheapest edits of one conversation, row by row.

    tops maps the state on top of a stack to its least (cost, audit) and its node. Stacks with equal tops go on
    alike, so the least of them stands for all; of equal cost it is the one whose edits come first in ASCII.
    """

    def __init__(self) -> None:
        self.done: list[str] = []
        self.tops = self._inserted({0: (0, "", (0, None))})

    @staticmethod
    def _offer(tops: dict, nodes: tuple[tuple, ...], cost: int, audit: str) -> bool:
        better = [n for n in nodes if n[0] not in tops or (cost, audit) < tops[n[0]][:2]]
        tops.update({n[0]: (cost, audit, n) for n in better})
        return bool(better)

    def _inserted(self, tops: dict) -> dict:
        letter, price = INSERT
        while any([self._offer(tops, _after(node, t), cost + price, audit + letter) for cost, audit, node in list(tops.values()) for t in ROLES]):
            pass
        least = min(cost for cost, _, _ in tops.values())
        return {state: top for state, top in tops.items() if top[0] <= least + SPREAD}

    def row(self, initial: str, kind: int) -> None:
        tops: dict = {}
        for cost, audit, node in self.tops.values():
            self._offer(tops, (node,), cost + DELETE[1], audit + DELETE[0])
            if kind in (FINE, TRUNCATED):
                cost += TRUNCATED_COST * (kind == TRUNCATED)
                self._offer(tops, _after(node, initial), cost + KEEP[1], audit + KEEP[0])
                for t in ROLES:
                    self._offer(tops, _after(node, t), cost + REROLE[1], audit + REROLE[0])
        self.tops = self._inserted(tops)

    def deleted(self, n: int) -> None:
        """n more rows that must go."""
        self.tops = self._inserted({s: (cost + n * DELETE[1], audit + n * DELETE[0], node) for s, (cost, audit, node) in self.tops.items()})
        self.settle()

    def settle(self) -> None:
        if max(len(audit) for _, audit, _ in self.tops.values()) > TAIL and (same := commonprefix([audit for _, audit, _ in self.tops.values()])):
            self.done.append(same)
            self.tops = {s: (cost, audit[len(same) :], node) for s, (cost, audit, node) in self.tops.items()}

    def best(self) -> tuple[int, str]:
        cost, audit = min((cost, audit) for cost, audit, node in self.tops.values() if _accepts(node))
        return cost, "".join([*self.done, audit])


def _prepared(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, copies: Column) -> DataFrame:
    """key, conv, known, turn, role, hash, text, kind, n: equal rows once with their number, the fault of the first of them; stored.

    key is a text, that null conversations have too. A row's kind is that of its first copy; further ones are duplicates, or blank too.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    plain = rows.select(key.alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), copies.cast("long").alias("copies"))
    once = plain.groupBy("key", "conv", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("hash", F.md5(F.col("text").cast("binary")))
    once = stored(once.withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn")))
    firsts = once.groupBy("key", "role", "hash").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    found = joined(once.withColumnRenamed("n", "copies"), stored(firsts), ["key", "role", "hash"])
    kind = F.when(~F.col("text").rlike(INK), BLANK).when(~F.col("at").eqNullSafe(F.col("first")), DUPLICATE).when(~F.col("text").rlike(ENDED), TRUNCATED).otherwise(FINE)
    return stored(found.select("key", "conv", "at.known", "turn", "role", "hash", "text", kind.alias("kind"), F.col("copies").alias("n")))


ORDER = ("key", "known", "turn", "role", "hash")


def _parsed(prepared: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation; a task streams its rows in order and holds edits only."""
    columns = "key gaps blank duplicate truncated illegal cost audit".split()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def closed() -> tuple:
            first, last, turns, kinds, illegal, _, repair = state
            cost, audit = repair.best()
            return key, last - first + 1 - turns if turns else 0, kinds[BLANK], kinds[DUPLICATE], kinds[TRUNCATED], illegal, cost, audit

        for batch in batches:
            for now, turn, role, kind, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != key:
                    if state:
                        out.append(closed())
                    key, state = now, [turn, turn, 0, [0, 0, 0, 0], 0, "", Repair()]
                first, last, turns, kinds, illegal, before, repair = state
                if turn is not None and (turns == 0 or turn != last):
                    state[:3] = turn if turns == 0 else first, turn, turns + 1
                initial = role[:1]
                state[4] = illegal + (bool(before) and before[1:] + initial not in LEGAL) + (n - 1) * (initial + initial not in LEGAL)
                state[5] = "." + initial
                kinds[kind] += 1
                kinds[BLANK if kind == BLANK else DUPLICATE] += n - 1
                repair.row(initial, kind)
                if n > 1:
                    repair.deleted(n - 1)
                repair.settle()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], columns)
                out = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in closed()], columns)

    rows = prepared.select(*ORDER, "kind", "n").repartition("key").sortWithinPartitions(*ORDER)
    return rows.select("key", "turn", "role", "kind", "n").mapInArrow(parse, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _replayed(prepared: DataFrame, parsed: DataFrame, columns: list[str], schema: str, begin: Callable, turn: Callable, end: Callable) -> DataFrame:
    """Each conversation's edits and then its rows, streamed in order: begin() makes what turn(state, key, edit, role, text) adds a row to and end(state, key) closes; both may return a row."""
    head = parsed.select("key", F.lit(0).alias("side"), F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("hash"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("n"))
    body = prepared.select("key", F.lit(1).alias("side"), "known", "turn", "role", "hash", "text", "n")
    order = ["key", "side", *ORDER[1:]]
    rows = head.unionByName(body).repartition("key").sortWithinPartitions(*order).select("key", "side", "role", "text", "n")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, edits, at, place, state, out = None, "", 0, 0, None, []

        def emit(row: tuple | None) -> None:
            if row is not None:
                out.append(row)

        def inserts() -> None:
            nonlocal at, place
            while edits[at : at + 1] == INSERT[0]:
                emit(turn(state, key, INSERT[0], "ua"[place % 2], None, ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for now, side, role, text, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if side == 0:
                    if key is not None:
                        emit(end(state, key))
                    key, edits, at, place, state = now, text, 0, 0, begin()
                    inserts()
                    continue
                for _ in range(n):
                    edit, at = edits[at], at + 1
                    if edit == KEEP[0]:
                        emit(turn(state, key, edit, None, role, text))
                        place += role[:1] != "s"
                    elif edit == REROLE[0]:
                        emit(turn(state, key, edit, "ua"[place % 2], None, text))
                        place += 1
                    inserts()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], columns)
                out = []
        if key is not None:
            emit(end(state, key))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], columns)

    return rows.mapInArrow(replay, schema)


def _digested(prepared: DataFrame, parsed: DataFrame) -> DataFrame:
    """key, repaired_sha256: of role:text of the repaired turns, joined by newlines, hashed as they stream by."""

    def turn(state: list, key: str, edit: str, initial: str | None, role: str | None, text: str) -> None:
        state[0].update(f"{state[1]}{ROLES[initial] if role is None else role}:{text}".encode())
        state[1] = "\n"

    return _replayed(prepared, parsed, ["key", "repaired_sha256"], "key string, repaired_sha256 string", lambda: [sha256(), ""], turn, lambda state, key: (key, state[0].hexdigest()))


def _turns(prepared: DataFrame, parsed: DataFrame) -> DataFrame:
    def turn(state: list, key: str, edit: str, initial: str | None, role: str | None, text: str) -> tuple:
        state[0] += 1
        return key, state[0] - 1, edit, ROLES[initial] if role is None else role, text

    return _replayed(prepared, parsed, ["key", "position", "edit", "role", "text"], "key string, position long, edit string, role string, text string", lambda: [0], turn, lambda state, key: None)


def _named(prepared: DataFrame, found: DataFrame, conv_col: str) -> DataFrame:
    names = prepared.groupBy("key").agg(F.first("conv").alias(conv_col))
    return found.join(names, "key").select(conv_col, *[c for c in found.columns if c != "key"])


def repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(report, turns): per conversation its gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256; and its repaired turns (position from 0, edit, role, text).

    A conversation's rows go by turn, nulls first; ties by role, then by the text's MD5. Each row's first fault
    counts: blank; duplicate (role and text seen earlier); truncated (the last character that is not white space
    ends no sentence). illegal counts neighbours whose roles' initials may not follow each other. Edits: keep 0,
    rerole 1, delete 2 (blank and duplicate rows must go), insert an empty turn 5; a truncated row that stays costs 5
    more. audit names the cheapest edits whose roles fit GRAMMAR, of equal ones the first in ASCII.

    Null roles and texts are one space; a role that is no role of the grammar can be changed or deleted, not kept; null
    conversations are one conversation. Equal rows collapse to one with a number before any are ordered (copies: how
    often a row counts). No task holds a conversation's texts: they stream by, twice, in order; what it holds is the edits'
    string. A hash of a whole conversation needs its rows in one stream, so a very long one is read by one task.
    Extra columns are left out; an empty table gives empty ones.
    """
    prepared = _prepared(rows, conv_col, turn_col, role_col, text_col, F.lit(1) if copies is None else copies)
    parsed = stored(_parsed(prepared))
    report = parsed.join(_digested(prepared, parsed), "key")
    return _named(prepared, report, conv_col), _named(prepared, _turns(prepared, parsed), conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """conversations rows with the damage that their number sets (crc32 of `conv_id:turn`, of 20): 0 gone, 1 emptied, 2 without sentence ends, 3 twice (column copies), 4 by a user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    number = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    known = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), number.alias("damage")).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    return known.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("damage") == 3, 2).otherwise(1).alias("copies"))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """conv_id and repaired()'s report of damaged() rows, with every conversation of rows: zeros, no edits and the hash of nothing where no row is left."""
    report, _ = repaired(damaged(rows), copies=F.col("copies"))
    everyone = rows.select(F.col("conv_id").alias("__conv")).distinct()
    found = everyone.join(report, F.col("__conv").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("__conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"))


def _add(x: str, cost: int | str, letter: str) -> str:
    return f"lpad(({x}[1:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {x}[10:] || '{letter}'"


#: The parse as a recursive fold: z (nothing yet), s, u, a hold the cost, nine digits, and the edits of the cheapest way to a last role.
ORACLE_SQL = rf"""
WITH RECURSIVE tbl AS (
  SELECT list(t ORDER BY n) AS t FROM (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS t FROM (SELECT unnest(range(256)) AS n))
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT), lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS d
  FROM conversations, tbl
), m AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE d <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM m
), f AS (
  SELECT *, substring(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE 'f' END AS kind,
         lag(substring(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substring(role, 1, 1) AS pair FROM o
), w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS z, NULL::VARCHAR AS s, '000000005I' AS u, '000000010II' AS a FROM f
  UNION ALL
  SELECT conv_id, i, z, s, u2, least(a, {_add('u2', 5, 'I')}) FROM (
    SELECT *, least(u, {_add('z', 5, 'I')}, {_add('s', 5, 'I')}, {_add('a', 5, 'I')}) AS u2 FROM (
      SELECT f.conv_id, f.i, {_add('w.z', 2, 'D')} AS z, least({_add('w.s', 2, 'D')}, CASE WHEN stays AND ini = 's' THEN {_add('w.z', 'more', 'K')} END) AS s,
        least({_add('w.u', 2, 'D')}, CASE WHEN stays AND ini = 'u' THEN least({_add('w.z', 'more', 'K')}, {_add('w.s', 'more', 'K')}, {_add('w.a', 'more', 'K')}) WHEN stays THEN least({_add('w.z', 'more + 1', 'R')}, {_add('w.s', 'more + 1', 'R')}, {_add('w.a', 'more + 1', 'R')}) END) AS u,
        least({_add('w.a', 2, 'D')}, CASE WHEN stays AND ini = 'a' THEN {_add('w.u', 'more', 'K')} WHEN stays THEN {_add('w.u', 'more + 1', 'R')} END) AS a
      FROM w JOIN (SELECT *, kind IN ('f', 't') AS stays, CASE WHEN kind = 't' THEN 5 ELSE 0 END AS more FROM f) f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1))
), b AS (
  SELECT conv_id, n, gaps, blank, duplicate, truncated, illegal, least(z, a) AS best FROM w JOIN (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((kind = 'b')::INT) AS blank, sum((kind = 'd')::INT) AS duplicate, sum((kind = 't')::INT) AS truncated, sum((coalesce(pair NOT IN ('su', 'ua', 'au'), false))::INT) AS illegal FROM f GROUP BY conv_id
  ) x USING (conv_id) WHERE w.i = n
), e AS (
  SELECT conv_id, p, letter, sum((letter <> 'I')::INT) OVER q AS i, sum((letter <> 'D')::INT) OVER q AS place FROM (SELECT conv_id, unnest(string_split(best[10:], '')) AS letter, unnest(range(length(best) - 9)) AS p FROM b WHERE length(best) > 9) WINDOW q AS (PARTITION BY conv_id ORDER BY p)
), h AS (
  SELECT e.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN role || ':' || text WHEN 'R' THEN turned || ':' || text ELSE turned || ':' END, chr(10) ORDER BY p)) AS digest FROM (
    SELECT *, CASE WHEN (place - max((letter = 'K' AND place = 1 AND ini = 's')::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END AS turned
    FROM (SELECT e.*, f.role, f.text, f.ini FROM e LEFT JOIN f ON e.conv_id = f.conv_id AND e.i = f.i AND letter <> 'I')
  ) e WHERE letter <> 'D' GROUP BY e.conv_id
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(best[1:9]::BIGINT, 0) AS cost, coalesce(best[10:], '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b USING (conv_id) LEFT JOIN h USING (conv_id)
"""
