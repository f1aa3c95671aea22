"""Benchmark decontamination: words, exact and near matches against brute force, odd rows."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lectern.llm import phrase_index as pi

DOCS, ITEMS = "doc_id long, text string, row string, words int", "item_id long, text string, phrase int"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    count = Counter(w for _, t in docs for w in words(t))
    out = []
    for doc_id, text in docs:
        w, hit, found, near = words(text), set(), set(), set()
        for item_id, other in items:
            b = words(other)
            n = min(len(b), pi.WINDOW)
            name = "" if item_id is None else str(item_id)
            for s in range(len(b) - n + 1) if b else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(name)
            rare = sorted({x for x in b if x in count}, key=lambda x: (count[x], x))[: pi.LISTS]
            if len(rare) > 1 and any(set(rare) <= set(w[p : p + pi.NEAR]) for p in range(len(w))):
                near.add(name)
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return sorted(out, key=repr)


def searched(spark, docs, items):
    got = pi.contaminated(spark.createDataFrame([(*d, "r", 3) for d in docs], DOCS), spark.createDataFrame([(*i, 2) for i in items], ITEMS))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    return sorted(map(tuple, got.collect()), key=repr)


def made():
    rng = random.Random(4)
    common, rare = ["the", "of", "and"], [f"w{i}" for i in range(30)]
    prose = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(i, prose(rng.randint(8, 30))) for i in range(12)]
    items += [(20, items[0][1]), (21, ["the"] * 14), (22, ["w3"]), (23, ["the", "of"]), (24, prose(12) + ["nowhere"] + prose(12)), (0, items[1][1])]
    docs = []
    for i in range(40):
        body = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1]
            start = rng.randint(0, max(0, len(part) - 12))
            at = rng.randint(0, len(body))
            body[at:at] = part[start : start + rng.randint(9, 30)]
        docs.append((i, ", ".join(w.title() if rng.random() < 0.3 else w for w in body)))
    return docs, [(i, " ".join(w)) for i, w in items]


def test_against_brute_force(spark):
    docs, items = made()
    docs += [docs[3], docs[4], (3, "the the the the the the the the the the the"), (None, items[2][1]), (50, None), (51, ""), (52, "..."), (53, "Öl öl " * 6)]
    items += [(None, "Of the w1!"), (30, None), (31, "?"), (32, "Öl öl ÖL"), items[5]]
    want = brute(docs, items)
    assert sum(r[5] for r in want) > 10 and sum(r[6] for r in want) > 10
    assert searched(spark, docs, items) == want


def test_very_common_passage_and_long_text(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(i, f"x{i} {passage} y") for i in range(300)] + [(900, "the " * 50_000 + passage)]
    items = [(i, passage) for i in range(40)] + [(50, "the the the the the the the the the the"), (51, passage[:-4] + " other")]
    got = {r[0]: r for r in searched(spark, docs, items)}
    assert got[5][1:4] == (27, 25, 41) and got[900][1:4] == (50_025, 50_025, 42)
    ids = ",".join(sorted(map(str, [*range(40), 51])))
    assert {r[4] for k, r in got.items() if k < 300} == {hashlib.sha256(ids.encode()).hexdigest()}


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a b")]) == []
    assert searched(spark, [(1, "a b")], []) == brute([(1, "a b")], [])


def test_whole_index(spark):
    tokens = pi.tokenized(spark.createDataFrame([(1, "B a b", "", 0), (2, None, "", 0)], DOCS))
    assert sorted((r.term, r.pos) for r in pi.postings(tokens).collect()) == [("a", 1), ("b", 0), ("b", 2)]
    assert {r.term: r.freq for r in pi.frequencies(tokens, tokens.select(F.explode("words").alias("term")).distinct()).collect()} == {"a": 1, "b": 2}
