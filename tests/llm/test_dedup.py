"""SimHash, components and line deduplication against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from lectern.llm import components, line_dedup, simhash

DATA = "/root/testdata/sf0.001"


def fingerprint(text, k=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@given(st.text(alphabet="aBé \t\n\x0bẞ", max_size=60))
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == fingerprint(text)


def test_block_masks_share_a_block():
    rng = random.Random(1)
    for rows in (2, 1000, 10**6, 10**9, 10**12):
        masks = simhash.block_masks(rows)
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def expected_components(rows):
    prints = [fingerprint(t or "") for _, t in rows]
    array = np.array(prints, np.uint64)
    links = [(i, int(j)) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(array[:i] ^ array[i]) <= 4)]
    least = {}
    roots = grouped(len(rows), links)
    for (key, _), root in zip(rows, roots, strict=True):
        if key is not None:
            least[root] = min(least.get(root, key), key)
    return sorted(((key, f"{p:016x}", least.get(root)) for (key, _), p, root in zip(rows, prints, roots, strict=True)), key=repr)


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == expected_components(rows)


def test_null_and_repeated_ids_link(spark, monkeypatch):
    fps = [(1, 0), (None, 0b1111), (3, 0b11111111), (7, 1 << 40 | 1 << 63), (None, 7 << 20), (5, 1 << 50), (9, 1 << 50), (3, 0xFF << 50), (5, 0xFF << 50), (None, 0xFF << 30), (2, -1)]
    rows = [(k, f - (1 << 64) if f >> 63 == 1 else f) for k, f in fps]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long"))
    unsigned = [f % (1 << 64) for _, f in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (unsigned[i] ^ unsigned[j]).bit_count() <= 4]
    roots = grouped(len(rows), links)
    least = {r: min((k for (k, _), s in zip(rows, roots, strict=True) if s == r and k is not None), default=None) for r in roots}
    want = sorted(((k, f"{u:016x}", least[r]) for (k, _), u, r in zip(rows, unsigned, roots, strict=True)), key=repr)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == want
    assert (3, f"{0b11111111:016x}", 1) in want and (None, f"{0xFF << 30:016x}", None) in want and (5, f"{0xFF << 50:016x}", 3) in want


def test_simhash_cases(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)  # several tiles even here
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (5, "ONE  two"), (None, "one two"), (None, "alone here")]
    base = rng.sample(words, 300)
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(300), i % 5):
            copy[at] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, fingerprint string, fp long")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == expected_components(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*links, (None, 5)], "a long, b long")).collect()}
    roots = grouped(400, links)
    assert got == {n: roots[n] for link in links for n in link}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def row_hashes(key, text):
    """What tells rows of one id apart: XXH64 of id and text, of text and id, each seeded by the one before; nulls are passed over."""
    parts = [None if key is None else key.to_bytes(8, "little", signed=True), None if text is None else text.encode()]
    made = []
    for order in (parts, parts[::-1]):
        seed = 42
        for data in order:
            seed = seed if data is None else xxhash.xxh64_intdigest(data, seed=seed)
        made.append(seed - (1 << 64) if seed >> 63 else seed)
    return tuple(made)


def lines_left(rows):
    """(doc_id, text) after deduplication, by comparing all pairs. Of equal rows the first one keeps its lines."""
    norm = lambda x: x.strip(" \t\x0b\x0c\r").lower()
    place = lambda k, t, i: (k is None, k or 0, *row_hashes(k, t), i)
    seen = sorted({(place(k, t, i), norm(x)) for k, t in rows if t is not None for i, x in enumerate(t.split("\n")) if norm(x)})
    first = {}
    for at, x in seen:
        first.setdefault(x, at)
    texts = list(first)
    grams = [{x[i : i + 7] for i in range(max(1, len(x) - 6))} for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])]
    roots = grouped(len(texts), links)
    kept = {}
    for x, root in zip(texts, roots, strict=True):
        kept[root] = min(kept.get(root, first[x]), first[x])
    of = {x: kept[root] for x, root in zip(texts, roots, strict=True)}
    left, met = [], set()
    for k, t in rows:
        stays = lambda i, x: not norm(x) or ((k, t) not in met and of[norm(x)] == place(k, t, i))  # noqa: E731, B023
        left.append((k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if stays(i, x))))
        met.add((k, t))
    return left


def test_lines_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = dict(lines_left(rows)), {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(want[k] != got[k] for k in want) <= 0.02 * len(want)  # bands find 0.99 of the links at the least similarity


def test_lines_cases(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 4)  # larger bands and several tiles even here
    rng = random.Random(3)
    base = "the quick brown fox jumps over the lazy dog while nobody watches the other side of a very long and quiet road"
    rows = [(1, None), (2, ""), (3, "same line here\n\nsame line here\n"), (4, " Same line here \r\nx\nx\nxy"), (4, " Same line here \r\nx\nx\nxy"), (None, "same line here"), (5, "x"), (6, "日本語の文章です。\n日本語の文章です。")]
    for i in range(40):
        at = rng.randrange(len(base))
        rows.append((10 + i, f"own line {rng.random()} of {i}\n{base[:at]}{chr(97 + i % 26)}{base[at + 1 :]}"))
    df = spark.createDataFrame([(k, t, 7, "c") for k, t in rows], "doc_id long, text string, n_lines int, component string")
    got = line_dedup.deduplicated(df)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(lines_left(rows), key=repr)
    assert {r.n_lines for r in got.where("doc_id = 1").collect()} == {0} and "component" in got.columns
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_lines_written_several_times(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(158))
    rows = [(1, passage * 2), (2, passage * 3), (3, "".join(rng.choice("qrstuvwxyz ") for _ in range(158)))]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_short_lines_lose_no_pair(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        line = "the same start " * (i % 2) + "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(8, 50)))
        for j in range(2):  # of similarity 0.8 or just above
            rows.append((2 * i + j, line + "xyzuvwqrst"[: j * ((len(line) - 6) // 4)] if len(line) < 47 else line[: len(line) - j * 4]))
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    want = lines_left(rows)
    assert sum(t == "" for _, t in want) >= 300
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted(want)


def test_rows_that_share_an_id(spark):
    """Each keeps its own lines: a repeated id hides no line, null ids take part, and of equal rows one keeps its lines."""
    rows = [(0, "the same first line"), (1, "the same first line\nsecond line of the first row"), (1, "a unique line nobody else has\nand one more of them"), (1, None)]
    rows += [(2, "equal rows of one id\n\nhave equal lines"), (2, "equal rows of one id\n\nhave equal lines"), (None, "the same first line\nonly here, without an id"), (None, "only here, without an id")]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert left == sorted(lines_left(rows), key=repr)
    assert (1, "a unique line nobody else has\nand one more of them") in left and (2, "") in left


def test_hot_keys_are_sent_to_their_rows(spark, monkeypatch):
    """With every key hot, and with none, the results are the same."""
    from lectern.llm import scratch

    rows = [(i, t) for i, t in enumerate(["", "", None, "a b c d e", "a b c d e", "x y z w v", "the same line\nthe same line", "the same line"])] + [(None, "a b c d e"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (0, 1, 100):
        monkeypatch.setattr(scratch, "HOT_ROWS", limit)
        assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr) == expected_components(rows)
        assert sorted(((r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect()), key=repr) == sorted(lines_left(rows), key=repr)


def test_stars_need_no_round_of_components(spark, monkeypatch):
    """Links that are stars already are told by one aggregate; a chain takes rounds and ends in the same table."""
    rounds, bent = [], components._stars
    monkeypatch.setattr(components, "_stars", lambda *given: rounds.append(given[1]) or bent(*given))
    stars = spark.createDataFrame([(5, 1), (1, 6), (6, 1), (9, 8), (3, 3), (None, 4)], "a long, b long")
    assert sorted(map(tuple, components.components(stars).collect())) == [(1, 1), (3, 3), (5, 1), (6, 1), (8, 8), (9, 8)] and not rounds
    chain = spark.createDataFrame([(i + 1, i) for i in range(20)] + [(7, 7)], "a long, b long")
    assert sorted(map(tuple, components.components(chain).collect())) == [(i, 0) for i in range(21)] and rounds


def test_sets_are_compared_by_compiled_code(spark):
    """No lambda holds a comparison or a slice of a set, which would be interpreted and copy it; the least similarity counts."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    sets = spark.createDataFrame([(list(range(4)), list(range(5))), (list(range(9)), list(range(1, 10))), (list(range(8)), list(range(1, 9))), (list(range(79)), list(range(100)))], "a array<long>, b array<long>")
    compared = sets.select(line_dedup.similar(sets.a, sets.b).alias("is"))
    assert [r["is"] for r in compared.collect()] == [True, True, False, False] and "lambda" not in plan(compared)
    texts = spark.createDataFrame([(1, "some line of text"), (2, "some line of text "), (3, "another one of it")], "line long, norm string")
    members = spark.createDataFrame([(7, 1, 1), (7, 1, 2), (7, 1, 3)], "key long, least long, line long")
    stars = line_dedup._stars(members, texts, line_dedup.shingles)
    assert [tuple(r) for r in stars.collect()] == [(1, 2)] and not re.search(r"lambdafunction\([^\n]*array_intersect", plan(stars))
    rng = random.Random(6)
    lines = spark.createDataFrame([("".join(rng.choice("abcdefgh ") for _ in range(300)),)], "norm string")
    banded = line_dedup.with_bands(lines, "norm", bytes(1 << 16))
    assert len(set(banded.first()["keys"])) == line_dedup.BANDS and "lambdafunction(xxhash64(slice(" not in plan(banded)
