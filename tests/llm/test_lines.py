import random

import pytest
from scholia.llm import lines

from test_first import KIND, table


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    run = "said before one\nsaid before two"
    data = [(1, run), (7, "own a\n" + run), (7, "own b\nown c\nown d\nown e"), (None, run + "\nown f"), (None, "own g\nown h\nown i"), (None, "own j")]
    want = [(1, run), (7, "own a"), (7, data[2][1]), (None, "own f"), (None, data[4][1]), (None, "own j")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in lines.dedup_lines(table(spark, data)).collect()))) == sorted(map(repr, want))
    report = [(r.doc_id, r.n_lines, r.n_removed) for r in lines.line_report(table(spark, data)).collect()]
    assert sorted(map(repr, report)) == sorted(map(repr, [(1, 2, 0), (7, 3, 2), (7, 4, 0), (None, 3, 2), (None, 3, 0), (None, 1, 0)]))


def test_a_later_row_of_an_id_loses_what_an_earlier_one_says(spark):
    run = "twice one\ntwice two"
    got = [r.text for r in lines.dedup_lines(table(spark, [(3, run + "\nx"), (3, run + "\ny"), (4, "z\n" + run)])).collect()]
    assert sum(run in t for t in got) == 1 and sum("x" in t or "y" in t for t in got) == 2


def plain(data, window=2, min_words=25):
    """(doc_id, text left, removed, runs) by a plain reading; ids are distinct, a null one comes last."""
    seen, out = set(), []
    for doc, t in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        rows = (t or "").split("\n")
        kept = [(i, x.strip(" ")) for i, x in enumerate(rows) if x.strip(" ")]
        spans = [([i for i, _ in kept[a : a + window]], ("many", *(x for _, x in kept[a : a + window]))) for a in range(len(kept) - window + 1)]
        spans += [([i], ("one", x)) for i, x in kept if len(x.split()) >= min_words]
        gone = set()
        for where, s in sorted(spans, key=lambda e: e[0][0]):
            if s in seen:
                gone |= set(where)
            seen.add(s)
        left = "\n".join(x for i, x in enumerate(rows) if i not in gone)
        out.append((doc, left if gone or t is not None else None, len(gone), sum(i - 1 not in gone for i in gone)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [f"line {i} says" for i in range(25)] + [" ".join(f"w{i}x{j}" for j in range(26)) for i in range(4)] + ["", "  ", " padded one ", "padded one"]
    data = [(1, None), (2, ""), (3, "\n\n"), (None, "line 1 says\nline 2 says"), (4, "same\n" * 50), (-5, "x" * 5000), (9, " ".join(pool * 30))]
    data += [(1000 - 3 * i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(60)]
    docs = table(spark, data).repartition(5)
    want = plain(data)
    got = lines.dedup_lines(docs).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(repr(r[:2]) for r in want)
    report = [(r.doc_id, r.n_removed, r.n_runs) for r in lines.line_report(docs).collect()]
    assert sorted(map(repr, report)) == sorted(repr((r[0], *r[2:])) for r in want)


def test_empty_tables_and_clashing_columns(spark):
    assert lines.dedup_lines(spark.createDataFrame([], KIND)).count() == 0 and lines.line_report(spark.createDataFrame([], KIND)).count() == 0
    run = "said before one\nsaid before two"
    odd = spark.createDataFrame([(1, run, "a", 1, 2), (2, run + "\nx", "b", 3, 4)], "doc_id long, text string, _key string, _gone int, `a.b` int")
    assert {(r.doc_id, r.text, r[2], r[3], r[4]) for r in lines.dedup_lines(odd).collect()} == {(1, run, "a", 1, 2), (2, "x", "b", 3, 4)}
