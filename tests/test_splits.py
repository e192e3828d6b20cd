from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from chronoweir.operators import splits
from chronoweir.operators.splits import Folds

DAY = datetime(2024, 1, 1)


def daily(spark, n):
    return spark.createDataFrame([(i, DAY + timedelta(days=i), float(i)) for i in range(n)], "seq long, ts timestamp_ntz, value double")


def at(day):
    return datetime(2024, 1, day)


def values(df):
    return sorted(r["value"] for r in df.collect())


def test_split_with_gap(spark):
    df = daily(spark, 6)
    train, test = splits.temporal_split(df, "ts", at(3), at(5), seq_col="seq")
    assert values(train) == [0.0, 1.0, 2.0] and values(test) == [4.0, 5.0]
    assert values(splits.temporal_split(df, "ts", at(3))[1]) == [3.0, 4.0, 5.0]


def test_errors(spark):
    df = daily(spark, 6)
    with pytest.raises(ValueError, match="Column 'x' not found"):
        splits.temporal_split(df, "x", at(3))
    with pytest.raises(ValueError, match="Test start must be after train end"):
        splits.temporal_split(df, "ts", at(3), at(3))
    with pytest.raises(ValueError, match="Cannot split an empty DataFrame"):
        splits.assert_sorted_by(df.limit(0), "ts", "seq")
    with pytest.raises(ValueError, match="does not cover the requested split"):
        splits.validate_coverage(df, "ts", at(20), at(21))
    with pytest.raises(ValueError, match="does not cover the requested split"):
        splits.validate_coverage(df, "ts", datetime(2023, 1, 1), at(2))
    assert splits.validate_coverage(df, "ts", at(3), at(4), seq_col="seq") is True
    unsorted = spark.createDataFrame([(0, 3), (1, 1), (2, 2)], "seq long, t long")
    with pytest.raises(ValueError, match="sorted ascending"):
        splits.temporal_split(unsorted, "t", 1, 2, seq_col="seq")


def test_ties_at_the_cutoff_and_counts(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "t long")
    train, test = splits.temporal_split(df, "t", 2)
    assert train.count() == 3 and test.count() == 1
    assert splits.count_leq(df, "t", 2) == 3 and splits.count_lt(df, "t", 2) == 1
    strict = splits.sortedness_violations(df.withColumn("seq", F.col("t")), "t", "seq", strict=True).first()[0]
    assert strict == 1


def test_list_splitter_and_validator():
    s = splits.TemporalSplitter()
    days = [DAY + timedelta(days=i) for i in range(10)]
    train, test = s.split(days, at(5), at(6))
    assert sum(train) == 5 and sum(test) == 5
    assert s.validate_feature(at(3))
    with pytest.raises(ValueError, match="TEMPORAL LEAKAGE"):
        s.validate_feature(at(7))
    assert splits.datetime_after(DAY) == DAY + timedelta(microseconds=1)


@pytest.mark.parametrize("rolling", [False, True])
@pytest.mark.parametrize(("n", "train", "test", "step", "cap"), [(8, 4, 2, 2, 2), (20, 5, 3, 2, None), (20, 5, 7, 4, None), (4, 4, 1, 1, None), (9, 2, 1, 5, None)])
def test_folds(spark, n, train, test, step, cap, rolling):
    df = daily(spark, n)
    folds = Folds(train, test, step, cap, rolling)
    want = list(range(train, n - test + 1, step))[: cap or None]
    assert folds.count(n) == len(want)
    rows = folds.assign(df, "ts").collect()
    for f, cut in enumerate(want):
        mine = [r for r in rows if r["fold"] == f]
        assert sorted(r["_i"] for r in mine if not r["is_test"]) == list(range(cut - train if rolling else 0, cut))
        assert sorted(r["_i"] for r in mine if r["is_test"]) == list(range(cut, cut + test))
    assert len({r["fold"] for r in rows}) == len(want)
    stats = folds.statistics(df, "ts").orderBy("fold").collect()
    assert [(r["train_rows"], r["test_rows"], r["gap"]) for r in stats] == [(train if rolling else c, test, 86_400_000_000) for c in want]
    assert [(a.count(), b.count()) for a, b in folds.split(df, "ts")] == [(train if rolling else c, test) for c in want]


def test_fold_sizes_are_checked():
    with pytest.raises(ValueError, match="must be positive"):
        Folds(0, 1)
