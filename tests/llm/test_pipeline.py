"""The pipeline's stages, each held against its own input, and the registered queries."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lectern.llm import queries
from lectern.llm.scratch import stored

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    made = [docs]
    for _, stage in corpus_pipeline.STAGES:
        made.append(stored(stage(spark, made[-1], DATA)))
    return made


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])


def test_language_stage_keeps_long_documents(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    assert {r.doc_id for r in stages[0].where("n_chars > 100").collect()} <= kept


def test_line_stage(stages):
    from test_dedup import lines_left

    want = dict(lines_left([(r.doc_id, r.text) for r in stages[1].collect()]))
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert want.keys() == got.keys() and all(n == len(t) for t, n in got.values())
    assert sum(want[k] != got[k][0] for k in want) <= 0.02 * len(want)


def test_near_duplicate_stage(stages):
    from test_dedup import expected_components

    want = {key for key, _, least in expected_components([(r.doc_id, r.text) for r in stages[2].collect()]) if key == least}
    assert {r.doc_id for r in stages[3].collect()} == want


def test_mixing_stage(stages):
    assert sorted(map(tuple, stages[4].collect())) == sorted(map(tuple, stages[3].collect()))
    sources = [r.source for r in stages[4].collect()]
    assert len(set(sources[:40])) >= 10


def test_packing_stage(stages):
    from test_tokens_and_audio import check_packed

    check_packed([(r.doc_id, r.text) for r in stages[4].collect()], stages[5].collect())


def test_registered():
    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {name[: name.index("_") + 1] for name in queries.QUERIES}
    assert names["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) <= set(names)


def test_sequences_follow_the_mix(spark, tmp_path):
    """Six sources of equal weight, then two: no run of sequences mixes those of the halves."""
    from collections import Counter

    path = str(tmp_path / "mixed")
    rows = [(i, f"word{i % 7} " * (1 + i * 37 % 100), "en", f"s{i % 6 if i < 3000 else 6 + i % 2}", 0) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = corpus_pipeline.sequence_packing(spark, docs, "").collect()
    source, runs = {r[0]: r[3] for r in rows}, {}
    order = {s: n for n, s in enumerate(sorted({r.sequence_id for r in got}))}
    for r in got:
        runs.setdefault(order[r.sequence_id] * 8 // len(order), Counter())[source[r.doc_id]] += r.length
    assert sum(sum(c.values()) for c in runs.values()) == sum({(r.doc_id): r.doc_tokens for r in got}.values())
    for run, count in runs.items():
        assert all(abs(count[f"s{i}"] / count.total() - 1 / 6) < 0.05 for i in range(6)) if run < 3 else True
        assert all(abs(count[f"s{i}"] / count.total() - 1 / 2) < 0.05 for i in (6, 7)) if run > 4 else True
