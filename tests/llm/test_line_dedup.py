import hashlib
import random

import pytest

from chronoweir.llm import line_dedup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows):
    """(id, lines, dropped, kept text) of rows (id, text)."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(str.maketrans(UPPER, LOWER))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (3, 4), (9, 2)])
def test_equals_brute_force(spark, frame, batches, fanout):
    """Nine batches with two runs a level are compacted up to the third level."""
    rng = random.Random(batches)
    pool = [f"Line number {i} of the pool" + "!" * (i % 3) for i in range(60)] + ["short", "", "ÄÖÜ straße 10", "exactly 10"]
    vary = [str, str.upper, lambda x: f"\t {x}  \r", lambda x: x + "\x0b"]
    rows = []
    for i in rng.sample(range(1000), 200):
        lines = [rng.choice(vary)(rng.choice(pool)) if rng.random() < 0.7 else f"only {rng.random()}" for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(2000, ""), (2001, None), (2002, "\n"), (2003, rows[0][1])]
    docs = frame([(i, t, "en", "s", 0) for i, t in rows]).repartition(5)
    got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.select("doc_id", "_lines.n_lines", "_lines.n_dropped", "_lines.text").collect()) == brute(rows)


def test_rows_of_one_id_are_one_document(frame):
    twice = "this line comes twice\nthis line comes twice"
    docs = frame([(5, twice, "en", "s", 0), (5, twice, "en", "s", 0), (4, "nothing to see", "en", "s", 0)])
    assert {r["_lines"]["n_dropped"] for r in line_dedup.dedup_lines(docs).collect()} == {0}


@pytest.mark.parametrize(("fanout", "levels"), [(2, [1, 0, 1]), (3, [2, 1])])
def test_runs_are_compacted(spark, fanout, levels):
    runs = line_dedup.LineRuns(spark, fanout)
    keys = lambda lo: spark.range(lo, lo + 10).selectExpr("id AS _h1", "-id AS _h2", "id AS _first")
    for k in range(5):
        runs.add(keys(100 * k))
    assert [len(level) for level in runs.levels] == levels
    held = sorted(tuple(r) for run in runs.runs() for r in run.collect())
    assert held == [(i, -i, i) for k in range(5) for i in range(100 * k, 100 * k + 10)]


def test_joins_with_runs_move_and_sort_nothing(spark):
    from chronoweir.llm import common

    runs = line_dedup.LineRuns(spark, 4)
    for k in range(2):
        runs.add(spark.range(100 * k, 100 * k + 50).selectExpr("id AS _h1", "-id AS _h2", "id AS _first").repartition("_h1", "_h2"))
    with common.sorted_buckets(spark):
        a, b = runs.runs()
        for kind in ("left_anti", "left_semi", "full"):
            plan = a.join(b.hint("merge"), ["_h1", "_h2"], kind)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan


def test_a_later_call_knows_the_lines_of_an_earlier_one(spark, frame):
    from chronoweir.llm import common

    root = common.fresh_path(spark, "lines-of-two-calls")
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice([f"a line that many have {rng.randrange(30)}", f"only {rng.random()}"]) for _ in range(4)), "en", "s", 0) for i in range(90)]
    got = []
    for part in (rows[:30], rows[30:60], rows[60:]):
        found = line_dedup.dedup_lines(frame(part), batches=2, root=root)
        got += [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.select("doc_id", "_lines.*").collect()]
    assert sorted(got) == brute([r[:2] for r in rows])


def test_digest(spark, tables):
    at, rows = tables["odd"]
    last = 2**63 - 1  # a null id follows all others
    want = brute([(last if r[0] is None else r[0], r[1]) for r in rows])
    want = sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, n, gone, t in want)
    got = sorted((last if r[0] is None else r[0], *r[1:]) for r in line_dedup.op4_line_dedup(spark, at).collect())
    assert got == want


def test_sweep(spark, frame):
    from pathlib import Path

    from chronoweir.llm import common

    common._WRITTEN.clear()
    rows = [(i, "the same line in all\nown line of %d" % i, "en", "s", 0) for i in range(9)]
    line_dedup.dedup_lines(frame(rows)).collect()
    name = common.bucketed(spark.range(5), "swept", "id").inputFiles()[0]
    places = [Path(p.removeprefix("file://").removeprefix("file:")) for kind, p in common._WRITTEN if kind == "folder"]
    assert places and all(p.exists() for p in places)
    common.sweep(spark)
    assert not any(p.exists() for p in places)
    assert not Path(name.removeprefix("file://").removeprefix("file:")).exists()
