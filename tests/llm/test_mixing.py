import os
import random
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

from chronoweir.llm import catalog, mixing
from conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=key) == sorted(want, key=key)


def level(sizes, weights=(3, 1, 2), percent=150, cap=2):
    """Targets by repeated sharing: sources above their cap stop there, the others share what is left anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()) * percent / 100, set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, frame, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", ""]
    rows = [(i, prose(rng, int(rng.paretovariate(0.9)) % 500), "en", sources[min(int(rng.expovariate(1)), 5)], 0) for i in range(400)]
    sizes, most = defaultdict(int), defaultdict(int)
    for _, text, _, source, _ in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        sizes[source] += n
        most[source] = max(most[source], n)
    want = level(sizes)
    mixed = mixing.mix(frame(rows)).collect()
    copies = defaultdict(int)
    for r in mixed:
        copies[r["doc_id"]] += 1
    taken = defaultdict(int)
    for i, text, _, source, _ in rows:
        assert copies[i] <= 2
        taken[source] += copies[i] * len(text.split())
    for source, target in want.items():
        assert abs(taken[source] - target) <= 2 * most[source]
    again = mixing.mix(frame(rows).repartition(7)).collect()
    key = lambda r: r["doc_id"]
    assert sorted(map(key, mixed)) == sorted(map(key, again))
    sums = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, source_size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(sums).collect()}
    assert got == pytest.approx(want)


def test_systematic_sampling_by_hand(spark, frame):
    """Copies are the whole numbers that offset + expected copies summed up pass, in the order of size."""
    rows = [(i, "w " * n, "en", "s", 0) for i, n in enumerate([7, 5, 5, 3, 2, 1, 0])]
    got = {r["_doc"]: r for r in mixing.plan(frame(rows).selectExpr("doc_id AS _doc", "source AS _source", "CAST(size(split(trim(text), ' ')) AS long) * CAST(text <> '' AS long) AS _size")).collect()}
    total = sum(r["_copies"] for r in got.values())
    assert total in (10, 11)  # 7 documents, 1.5 copies each
    assert all(r["_copies"] in (1, 2) for r in got.values())
    assert all(r["target"] == 34.5 and r["source_size"] == 23 for r in got.values())
