"""Summaries by batches against those of all rows at once; commits that repeat or break off."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from verdancy.operators.calendar import seasonal_means, segments, sliding_windows
from verdancy.plans.incremental import SeasonalSummary
from verdancy.sources.commits import Batches

SEASONS = ["annual", "winter_cross", "winter_half_long", "summer", "winter", "winter_short"]


def rows(seed, year):
    r = random.Random(seed)
    return [(k % 3, k % 2, dt.datetime(year, 1, 1) + dt.timedelta(days=r.randrange(365)), r.choice([None, r.random()]), r.random()) for k in range(400)]


def table(spark, data):
    return spark.createDataFrame(data, "row int, col int, ts timestamp_ntz, a double, b double")


def as_dict(df, keys):
    return {tuple(r[k] for k in keys): tuple(r[v] for v in ("a", "b")) for r in df.collect()}


def same(got, expected):
    assert set(got) == set(expected)
    for k, pair in expected.items():
        assert all((x is None and y is None) or x == pytest.approx(y, rel=1e-12) for x, y in zip(got[k], pair, strict=True))


def test_segments_hold_every_day_of_their_seasons():
    found = segments(SEASONS)
    assert all(a < b for a, b, _ in found) and [x[1] for x in found[:-1]] == [x[0] for x in found[1:]]
    assert sum(len(own) for _, _, own in found) > len(SEASONS)


def test_seasons_equal_plain_means(spark):
    data = rows(1, 2001) + rows(2, 2002)
    expected = {}
    from verdancy.operators.calendar import SEASONS as RULES

    for s in SEASONS:
        for row, col, ts, a, b in data:
            for lo, hi, shift in RULES[s]:
                if lo <= ts.month * 100 + ts.day <= hi:
                    expected.setdefault((row, col, s, ts.year + shift), []).append((a, b))
    mean = lambda x: sum(x) / len(x) if x else None
    expected = {k: tuple(mean([p[i] for p in v if p[i] is not None]) for i in (0, 1)) for k, v in expected.items()}
    same(as_dict(seasonal_means(table(spark, data), ["row", "col"], "ts", ["a", "b"], SEASONS), ["row", "col", "season", "season_year"]), expected)


def test_appended_batches_equal_a_rebuild(spark, tmp_path):
    store = SeasonalSummary(spark, str(tmp_path / "s"), ["row", "col"], ["a", "b"], SEASONS)
    assert store.means().collect() == []
    data = {str(y): rows(y, y) for y in range(2001, 2005)}
    for y in ("2001", "2002", "2003"):
        assert store.add(y, table(spark, data[y]), "ts")
    assert store.refresh(2000, 2004) == [2000, 2001, 2002]
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s" / "windows" / "window_start=2000").iterdir()}
    assert store.add("2004", table(spark, data["2004"]), "ts") and not store.add("2004", table(spark, data["2001"]), "ts")
    assert store.refresh(2000, 2004, batches=["2004"]) == [2001, 2002]
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "s" / "windows" / "window_start=2000").iterdir()}
    whole = seasonal_means(table(spark, sum(data.values(), [])), ["row", "col"], "ts", ["a", "b"], SEASONS)
    same(as_dict(store.means(), ["row", "col", "season", "season_year"]), as_dict(whole, ["row", "col", "season", "season_year"]))
    windows = sliding_windows(whole, ["row", "col", "season"], "season_year", ["a", "b"], 2000, 2004)
    same(as_dict(store.windows(), ["row", "col", "season", "window_start"]), as_dict(windows, ["row", "col", "season", "window_start"]))
    assert store.refresh(2000, 2004, batches=["no such batch"]) == []


def test_a_broken_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = Batches(spark, str(tmp_path / "b"), "n int")
    one = spark.createDataFrame([(1,), (2,)], "n int")
    store.put("a/b=c d", one)
    monkeypatch.setattr(Batches, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    for name in ("a/b=c d", "other"):
        with pytest.raises(RuntimeError, match="killed"):
            store.put(name, one.withColumn("n", F.col("n") * 10))
    monkeypatch.undo()
    broken = one.select((F.lit(1) / F.when(F.col("n") < 0, 1).otherwise(F.raise_error(F.lit("lost")).cast("int"))).cast("int").alias("n"))
    with pytest.raises(Exception, match="lost"):
        store.put("a/b=c d", broken)
    assert sorted(r.n for r in store.read().collect()) == [1, 2] and list(store.committed()) == ["a/b=c d"]
    assert not store.put("a/b=c d", one, again=False)
    store.put("a/b=c d", one.limit(1))
    store.put("other", one)
    assert store.read().count() == 3
    with pytest.raises(ValueError, match="name"):
        store.put("", one)
