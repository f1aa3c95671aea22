"""Sharding, positions and mixing."""

import zlib
from fractions import Fraction
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import mixing, positions, sharding

DATA = "/root/testdata/sf0.001"
ROWS = [(1, None, None), (2, "", "a"), (3, "x" * 5000, "a"), (3, "x" * 5000, "a"), (None, "yy", "b"), (6, "é", "b"), (7, "x" * 5000, "c")]


@given(st.lists(st.integers(1, 30), min_size=1, max_size=9), st.integers(1, 4))
def test_smallest_capacity(sizes, shards):
    best = min(max(sum(sizes[a:b]) for a, b in zip((0, *cut), (*cut, len(sizes)), strict=True)) for k in range(min(shards, len(sizes))) for cut in combinations(range(1, len(sizes)), k))
    assert sharding.smallest_capacity(sizes, shards) == best
    cuts = [0, *sharding.minimax_cuts(sizes, shards), len(sizes)]
    assert len(cuts) == shards + 1 and cuts == sorted(cuts) and max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= best


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    of, slots = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    left = [(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows]
    assert sorted(map(repr, left)) == sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got)
    for r in got:
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard and 0 <= r.shard < shards


def test_shards(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sharding.shard_by_bytes(docs, 8).collect()
    check_shards([(r.doc_id, r.text) for r in docs.collect()], got, 8)
    sizes = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sizes) <= 1.2 * sum(sizes) / 8


def test_shard_cases(spark):
    df = spark.createDataFrame([(k, t, s, 1) for k, t, s in ROWS], "doc_id long, text string, source string, shard int")
    check_shards([(k, t) for k, t, _ in ROWS], sharding.shard_by_bytes(df, 16).collect(), 16)
    assert sharding.shard_by_bytes(df.limit(0), 16).count() == 0


def test_positions(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), "id", (F.col("id") % 7).alias("n"))
    rows = positions.numbered(df, ["k"], ["id"], F.lit(5), "n").orderBy("k", "position").collect()
    seen = {}
    for r in rows:
        at, total = seen.get(r.k, (0, 0))
        assert (r.position, r.before) == (at, total)
        seen[r.k] = at + 1, total + r.n


def fluid(blocks, weights, slots):
    """Exact shares of each source after every slot, by filling slot after slot."""
    done, out = {i: Fraction(0) for i in blocks}, []
    for _ in range(slots):
        free = Fraction(1)
        while free:
            left = [i for i in blocks if done[i] < blocks[i]]
            total = sum(weights[i] for i in left)
            step = min(free, min((blocks[i] - done[i]) * total / weights[i] for i in left))
            for i in left:
                done[i] += step * weights[i] / total
            free -= step
        out.append(dict(done))
    return out


@settings(max_examples=60)
@given(st.dictionaries(st.integers(0, 9), st.tuples(st.integers(0, 25), st.floats(1e-9, 50)), min_size=1, max_size=7))
def test_schedule_keeps_within_a_block(sources):
    blocks = {i: n for i, (n, _) in sources.items()}
    exact = {i: Fraction(w) for i, (_, w) in sources.items()}
    done, want = dict.fromkeys(blocks, 0), fluid(blocks, exact, sum(blocks.values()))
    rows = list(mixing.schedule(blocks, {i: w for i, (_, w) in sources.items()}, 7))
    for t, (i, k, phase, release, deadline, slot) in enumerate(rows):
        assert slot == t + 7 and release <= slot < deadline and k == done[i]
        done[i] += 1
        assert all(abs(done[j] - want[t][j]) < 1 for j in blocks) and 0 <= phase < len(blocks)
    assert done == blocks and len(rows) == sum(blocks.values())


def test_many_sources_and_slots():
    """A thousand sources, a million slots: at its own slots, where a source is farthest from its target, it is less than a block from it."""
    weights = {i: (i + 1) ** 0.5 * (1e-9 if i == 5 else 1) for i in range(1000)}
    total = sum(weights.values())
    blocks = {i: max(1, round(1_000_000 * w / total)) for i, w in weights.items()}
    # v, the work for each unit of weight, at which a source ends, and the slots passed by then
    order = sorted(blocks, key=lambda i: blocks[i] / weights[i])
    v = np.array([0.0] + [blocks[i] / weights[i] for i in order])
    left = np.array([total - sum(weights[i] for i in order[:n]) for n in range(len(order))])
    t = np.concatenate([[0.0], np.cumsum(left * np.diff(v))])
    worst = 0.0
    for i, k, _, _, _, slot in mixing.schedule(blocks, weights):
        before, after = np.interp([slot, slot + 1], t, v) * weights[i] if slot % 97 == 0 else (k, k + 1)
        worst = max(worst, min(blocks[i], before) - k, k + 1 - min(blocks[i], after))
    assert slot == sum(blocks.values()) - 1 and worst < 1 + 1e-6


def brute_mix(spark, docs, width):
    """doc_id, source, block, slot, block_row: rows in order of their hash, then the blocks of a plain search for the earliest deadline."""
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("h"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")).collect()
    of = {}
    for r in rows:
        of.setdefault(r.source, []).append(r)
    sizes = {s: sum(r.size for r in own) for s, own in of.items()}
    names = sorted(of, key=lambda s: (-sizes[s], s is not None, s))
    blocks = {i: (sizes[s] - 1) // width + 1 for i, s in enumerate(names)}
    want = fluid(blocks, {i: Fraction(float(sizes[s]) ** 0.5) for i, s in enumerate(names)}, sum(blocks.values()))
    share = lambda i, t: want[t - 1][i] if t else 0
    due = {(i, k): next(t for t in range(1, len(want) + 1) if share(i, t) >= k + 1) for i in blocks for k in range(blocks[i])}
    begin = {(i, k): next(t for t in range(len(want)) if share(i, t + 1) > k) for i in blocks for k in range(blocks[i])}
    slots, open_ = {}, set(due)
    for t in range(len(want)):
        job = min((b for b in open_ if begin[b] <= t), key=lambda b: (due[b], b))
        slots[job] = t
        open_.remove(job)
    out = []
    for i, s in enumerate(names):
        before = 0
        for at, r in enumerate(sorted(of[s], key=lambda r: (r.h, r.doc_id))):
            out.append((r.doc_id, s, before // width, slots[i, before // width], at))
            before += r.size
    return sorted(out, key=repr)


def test_mix_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mixed(docs, block_bytes=4096).select("doc_id", "source", "block", "slot", "block_row").collect()
    assert sorted(map(tuple, got), key=repr) == brute_mix(spark, docs, 4096)


def test_mix_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mixed(docs, block_bytes=4096).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in got)
    owner = {}
    for r in got:
        assert owner.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)


def test_mix_cases(spark):
    df = spark.createDataFrame([(k, t, s, 5) for k, t, s in ROWS], "doc_id long, text string, source string, slot int")
    got = mixing.mixed(df, {"a": 2.0, None: 1.0}, block_bytes=100, keep=("slot",)).collect()
    assert sorted(map(repr, ((r.doc_id, r.source) for r in got))) == sorted(repr((k, s)) for k, _, s in ROWS)
    first = max(r.slot for r in got if r.source in ("a", None))
    assert all(r.slot > first for r in got if r.source in ("b", "c")) and {r.keep_slot for r in got} == {5}
    assert mixing.mixed(df.limit(0)).count() == 0
    many = mixing.mixed(spark.range(300).select("id", F.lit("t").alias("text"), F.col("id").cast("string").alias("source"), F.col("id").alias("doc_id")), block_bytes=4).collect()
    assert sorted(int(r.source) for r in many) == list(range(300)) == sorted(r.doc_id for r in many)


def test_shards_of_the_finest_order(spark, monkeypatch):
    """The capacity is that of single groups, also where the first ranges hold many."""
    import hashlib
    import random

    rng = random.Random(1)
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    monkeypatch.setattr(sharding, "MORE_BITS", 4)
    texts = ["x" * int(rng.paretovariate(0.8)) + str(i % 300) for i in range(400)]
    sizes = {}
    for t in texts:
        key = int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
        sizes[key] = sizes.get(key, 0) + len(t) + 1
    got = sharding.shard_by_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()
    check_shards(list(enumerate(texts)), got, 5)
    assert max(sum(r.size for r in got if r.shard == s) for s in range(5)) == sharding.smallest_capacity([sizes[k] for k in sorted(sizes)], 5)
