"""Block-wise ordered helpers and exact quantiles against brute force, with one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltarc.functions import ordered
from voltarc.functions.quantiles import group_quantiles, interpolated


@pytest.fixture(scope="module")
def frame():
    """Key ``a`` holds most rows; order values have gaps; values are often missing."""
    rng = np.random.default_rng(5)
    rows = []
    for key, n in (("a", 300), ("b", 41), ("c", 1)):
        places = np.sort(rng.choice(n * 3, n, replace=False))
        for at in places:
            value = None if rng.random() < 0.6 else float(rng.integers(0, 50))
            rows.append((key, int(at), value))
    return pd.DataFrame(rows, columns=["k", "o", "v"]).sample(frac=1, random_state=1)


@pytest.fixture(scope="module")
def blocks(spark, frame):
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r)
                                for r in frame.itertuples(index=False)],
                               "k string, o int, v double")
    return ordered.number_blocks(df, "o", 7)


def expected(frame):
    return frame.sort_values(["k", "o"]).reset_index(drop=True)


def test_position_counts_rows_across_blocks(blocks, frame):
    got = (ordered.with_position(blocks, ["k"], ["o"], "pos", total="n").toPandas()
           .sort_values(["k", "o"]).reset_index(drop=True))
    want = expected(frame)
    assert (got.pos == want.groupby("k").cumcount()).all()
    assert (got.n == want.groupby("k").o.transform("size")).all()


def test_range_blocks_keep_positions(spark, frame):
    df = spark.createDataFrame(frame[["k", "o"]])
    got = (ordered.with_position(ordered.range_blocks(df, ["k", "o"]), ["k"], ["o"], "pos")
           .toPandas().sort_values(["k", "o"]).reset_index(drop=True))
    assert (got.pos == expected(frame).groupby("k").cumcount()).all()


def test_running_sums(blocks, frame):
    got = (ordered.running_sums(blocks, ["k"], ["o"], {"s": F.col("v"), "n": F.lit(1)})
           .toPandas().sort_values(["k", "o"]).reset_index(drop=True))
    want = expected(frame)
    assert np.allclose(got.s, want.v.fillna(0).groupby(want.k).cumsum())
    assert (got.n == want.groupby("k").cumcount() + 1).all()


def test_nearest_known(blocks, frame):
    got = ordered.nearest_known(blocks, ["k"], "o", "v", "lo", "hi").select(
        "k", "o", F.col("lo.val").alias("lo"), F.col("hi.val").alias("hi"))
    got = got.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    want = expected(frame)
    pd.testing.assert_series_equal(got.lo, want.groupby("k").v.ffill(), check_names=False)
    pd.testing.assert_series_equal(got.hi, want.groupby("k").v.bfill(), check_names=False)


def test_halo_serves_windows_over_block_edges(blocks, frame):
    placed = ordered.with_position(blocks, ["k"], ["o"], "pos")
    halo = ordered.Halo(placed, ["k"], "pos", before=4, after=2, rows=6)
    out = halo.own(halo.rows.withColumns({
        "back": F.sum("o").over(halo.window.rowsBetween(-4, 0)),
        "ahead": F.lead("o", 2).over(halo.window)}))
    got = out.toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    want = expected(frame)
    assert len(got) == len(want)
    back = want.groupby("k").o.rolling(5, min_periods=1).sum().reset_index(drop=True)
    assert np.allclose(got.back, back)
    pd.testing.assert_series_equal(got.ahead, want.groupby("k").o.shift(-2), check_names=False,
                                   check_dtype=False)


@pytest.mark.parametrize("accuracy", [50, 4000])
def test_group_quantiles_are_exact(spark, accuracy):
    rng = np.random.default_rng(7)
    parts = {"hot": np.concatenate([np.full(3000, 1.5), rng.normal(size=3000),
                                    rng.pareto(1.0, 3000) * 1e6]),
             "one": np.array([4.0]), "two": np.array([1.0, 4.0]),
             "ties": rng.integers(0, 3, 500).astype(float)}
    frame = pd.DataFrame([(k, float(x)) for k, xs in parts.items() for x in xs] + [("none", None)],
                         columns=["k", "x"])
    probs = {"p0": 0.0, "p2": 0.02, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    rows = [(k, None if pd.isna(x) else x) for k, x in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r for r in group_quantiles(df, ["k"], "x", probs, accuracy).collect()}
    assert set(got) == set(parts)
    for k, xs in parts.items():
        assert got[k]["n"] == len(xs)
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, p), rel=1e-12)
    everything = group_quantiles(df, [], "x", {"m": 0.5}, accuracy).first()["m"]
    assert everything == pytest.approx(frame.x.median(), rel=1e-12)


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(sorted(map(float, rng.normal(size=2)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "lo double, hi double")
    for p in (0.02, 0.3, 0.5, 0.98):
        got = [r[0] for r in df.select(interpolated(F.col("lo"), F.col("hi"), F.lit(p))).collect()]
        assert got == [np.quantile(r, p) for r in pairs]
