import random

import pytest
from scholia.llm import decontaminate, pieces, queries, simhash

import corpus_pipeline
from test_first import words

KIND = "doc_id long, text string, lang string, source string, n_chars long, _key string, _tests int, _row long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "k", 1, 2) for i, t in rows], KIND)


def test_every_stage_takes_odd_rows(spark):
    rng = random.Random(3)
    long = words(rng, 400, 3000)
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (4, "unlike text of the same id"), (None, "no id at all here"), (None, None), (5, long + " more"), (6, "x" * 200_000), (7, "intro words " + item + " and more"), (8, "É" * 30)]
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
        got = [(r.doc_id, r.text) for r in out.collect()]
        if name in ("toxicity", "line_dedup"):
            assert len(got) == len(rows)
        if name == "simhash_near_dedup":
            assert sorted(map(repr, got)) == sorted(map(repr, [(1, None), (4, long), (4, "unlike text of the same id"), (None, "no id at all here"), (6, "x" * 200_000), rows[10], (8, "É" * 30)]))
        if name == "benchmark_decontamination":
            assert len(got) == len(rows) - 1 and all(i != 7 for i, _ in got)
        assert stage(spark, odd(spark, []), "/root/testdata/sf0.001").count() == 0
    name, last = corpus_pipeline.STAGES[-1]
    got = last(spark, docs, "")
    assert got.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and got.count() == len(rows)


def test_stages_against_brute_force(spark):
    """The whole pipeline on the small sample: what goes at each stage is judged by plain rules."""
    sf = "/root/testdata/sf0.001"
    docs = queries.load(spark, sf, "documents")
    first, second, third = (f for _, f in corpus_pipeline.STAGES[1:4])
    cut = second(spark, docs, sf).collect()
    sets = {r.doc_id: frozenset(_shingles(r.text)) for r in docs.collect()}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert sorted(r.doc_id for r in cut) == sorted(i for i in root if root[i] == i)
    clean = {r.doc_id for r in third(spark, docs, sf).collect()}
    report = {r.doc_id: r.contaminated for r in decontaminate.contamination(docs, queries.load(spark, sf, "benchmark")).collect()}
    assert clean == {i for i, bad in report.items() if not bad}
    assert first(spark, docs, sf).count() == docs.count()


def _shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}


def test_run_ends_with_pieces(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.round_trip for r in rows)
    kept = {r.doc_id: r.ids for r in rows}
    assert len(kept) == len(rows)


@pytest.mark.parametrize("size", [1, 5])
def test_shingle_hashes_tell_texts_apart(size):
    own = simhash.Shingler(size)
    a, b = own.shingles(b"a b c d e f g"), own.shingles(b"A B  c\nd e f G")
    assert a.tolist() == b.tolist() and len(a) == 8 - size
    assert len(own.shingles(b"")) == 0 and len(own.shingles(b"x y")) == (1 if size == 5 else 2)
    assert own.shingles(b"x y").tolist() != own.shingles(b"y x").tolist()
    assert pieces is not None
