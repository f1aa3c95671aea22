"""The pipeline's near copies against brute force over five-word shingles."""

import random

import corpus_pipeline
from lectern.llm import near_copies, simhash


def test_stage_finds_copies_at_the_similarity(spark):
    from test_dedup import grouped

    rng = random.Random(6)
    texts = [None, "", "two words", "Two  words", "other"]
    for i in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(30 if i % 2 else 400)]
        texts.append(" ".join(base))
        copy = list(base)
        for at in range(0, len(base), 50) if i % 3 else range(0, len(base), 25):  # 0.8 or so, and below
            copy[at] = "changed"
        texts.append(" ".join(copy))

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}

    sets = [grams(t) for t in texts]
    links = [(j, i) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "two words", "y")], "doc_id long, text string, lang string")
    want = grouped(len(texts), links)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == dict(enumerate(want)) | {None: 2}
    kept = [r.doc_id for r in corpus_pipeline.near_deduplication(spark, docs, "").collect()]
    assert sorted(kept) == sorted({*want}) and len(links) > 30
    assert near_copies.near_copies(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "some text of one row", "a"), (1, "quite another text than that of the row before", "b"), (2, long, "c"), (2, long, "c"), (3, f"{long} more", "d"), (None, "only here without an id", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_deduplication(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.lang for r in kept.collect())) == ["a", "b", "c", "e"]


def test_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """Without shingle keys the fingerprints still link what they are near enough for, equal ones included, and nothing that is not similar."""
    rng = random.Random(7)
    long = [f"w{rng.randrange(5000)}" for _ in range(900)]
    texts = [" ".join(long), " ".join([*long[:-1], "x"]), " ".join([*long[:-1], "y"]), " ".join(reversed(long)), "other text"]
    prints = [near_copies.fingerprint(near_copies.shingle_set(t.encode())) for t in texts]
    assert all((prints[0] ^ p).bit_count() <= simhash.DISTANCE for p in prints[1:3])
    monkeypatch.setattr(near_copies, "keys", lambda held: [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_fingerprint_keys(spark):
    rows = [(10, 0), (11, 0), (12, 0b1111), (13, 0b11111111), (14, -1), (15, -1 << 32), (16, -1), (17, 1 << 40)]
    groups = {}
    for r in near_copies.fingerprint_keys(spark.createDataFrame(rows, "line long, fp long")).collect():
        groups.setdefault(r.key, set()).add(r.line)
    assert sorted(map(sorted, groups.values())) == [[10, 11, 12, 13, 17], [14, 16]]
