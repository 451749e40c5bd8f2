"""Series expressions against their definitions on hand-written values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelloom import catalog
from kernelloom.functions import series as S
from kernelloom.functions.draws import drawn_number
from kernelloom.operators import augment, decompose, metrics, slicing
from kernelloom.sources.readers import parse_split

NAN = float("nan")


def test_catalog():
    rows = catalog.catalog_rows()
    assert len({r[1] for r in rows if r[0] == "eval"}) == 97 and len({r[1] for r in rows if r[0] == "pretrain"}) == 152
    assert catalog.resolve_config("Energy") == "electricity_H_long" and catalog.resolve_config("x") == "x"
    assert parse_split("train[:7]") == (0, 7) and parse_split("train[3:]") == (3, None) and parse_split("train") == (0, None)


def test_filling(spark):
    rows = [(1, [1.0, 2.0, 5.0, NAN, 9.5, None, 3.0]), (2, [None, 4.0, NAN]), (3, [NAN, None]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = {r.k: r for r in df.select("k", S.clean(F.col("x")).alias("lin"), S.impute(F.col("x"), "ffill").alias("ff"), S.impute(F.col("x"), "zero").alias("z")).collect()}
    assert got[1].lin == [1, 2, 5, 7.25, 9.5, 6.25, 3] and got[2].lin == [4, 4, 4] and got[3].lin == [0, 0] and got[4].lin == [] and got[5].lin is None
    assert got[1].ff == [1, 2, 5, 5, 9.5, 9.5, 3] and got[2].ff == [4, 4, 4] and got[1].z[3] == 0
    long = df.where("k < 4").select("k", F.posexplode("x").alias("t", "v"))
    for name, strategy in (("lin", "linear"), ("ff", "ffill"), ("z", "zero")):
        filled = S.impute_long(long, "k", strategy).orderBy("k", "t").collect()
        assert [r.filled for r in filled if r.k == 1] == got[1][name]
        assert [r.filled for r in filled if r.k == 3] == [0, 0]
    with pytest.raises(ValueError):
        S.impute(F.col("x"), "guess")


def test_scaling(spark):
    long = spark.createDataFrame([(1, v) for v in (1.0, 2.0, 5.0, NAN, 9.5, None, 3.0)] + [(2, NAN)], "k int, v double")
    got = {r.k: (r["loc"], r["scale"]) for r in S.robust_stats_long(long, "k").collect()}
    assert got[1][0] == 3 and got[1][1] == pytest.approx(max(3 / 1.349, 1.4826 * 2, 3.006659275674582)) and got[2] == (0, 1)
    row = spark.createDataFrame([([3.0, 3.0], [1.0, 2.0, 4.0])], "c array<double>, x array<double>").select(*[c.alias(n) for n, c in zip("abcd", (*S.history_stats(F.col("c")), *S.history_stats(F.col("x"))))]).first()
    assert row.b == 1 and row.d == pytest.approx(np.std([1, 2, 4]))


def test_shapes(spark):
    x = F.col("x")
    cols = [S.shift(x, 2, "reflect"), S.shift(x, -1, "edge"), S.shift(x, 1, "wrap"), S.shift_mask(x, 2), S.resample(x, 7), S.smooth(x, 3), S.run_mask(F.array(*map(F.lit, [1.0, 1.0, 0.0, 2.0])), 2), S.crop_or_pad(x, 3), S.crop_or_pad(x, 6), S.crop_or_pad(x, 20)]
    got = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "x array<double>").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    assert got[0] == [3, 2, 1, 2] and got[1] == [2, 3, 4, 4] and got[2] == [4, 1, 2, 3] and got[3] == [0, 0, 1, 2]
    assert got[4] == pytest.approx(np.interp(np.linspace(0, 1, 7), np.linspace(0, 1, 4), [1, 2, 3, 4]))
    assert got[5] == pytest.approx([4 / 3, 2, 3, 11 / 3]) and got[6] == [0, 0, 0, 1] and got[7] == [2, 3, 4]
    assert len(got[8]) == 6 and got[8][2:] == [1, 2, 3, 4] and got[9] is None
    long = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 2, 3, 4])], "k int, t int, v double")
    assert [r.smooth for r in S.smooth_long(long, "k", 3).orderBy("t").collect()] == pytest.approx([4 / 3, 2, 3, 11 / 3])


def test_slices_and_metrics(spark):
    cut = slicing.Cut(20, 60, 120, 12, 40)
    spans = list(cut.spans(357, lambda i: drawn_number(0, i)))
    assert spans and all(60 <= h <= 120 and 12 <= f <= 20 and a + h + f <= 357 for a, h, f in spans)
    assert all(b[0] >= a[0] + a[1] for a, b in zip(spans, spans[1:]))
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 4.0], [0.0, 0.0])], "y array<double>, p array<double>, h array<double>, z array<double>").select(
        metrics.rmse(F.col("y"), F.col("p")), metrics.mase(F.col("y"), F.col("p"), F.col("h")), metrics.relative_rmse(F.col("z"), F.col("p")), metrics.mase(F.col("y"), F.col("p"), F.col("z"))).first()
    assert row[0] == pytest.approx(math.sqrt(2.5)) and row[1] == pytest.approx(1.0) and row[2] == 0 and row[3] == 0


def test_augmentation_grid(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.random(12).tolist(), rng.random(4).tolist()) for i in range(3)], "sample_idx long, history array<double>, future array<double>")
    made = augment.augment(augment.prepare_examples(df), (2, -1), window=3, sigma=0.1)
    rows = made.collect()
    assert len(rows) == 3 * 3 * 2 * 2
    assert all(abs(np.mean(r.history_n)) < 1e-9 and abs(np.std(r.history_n) - 1) < 1e-9 for r in rows)


def test_modes_add_up():
    x = np.sin(np.arange(120) / 3) + np.sin(np.arange(120) / 20)
    assert decompose.emd(x).sum(0) == pytest.approx(x)
    t = decompose.cwt(x, "morlet", 6)
    assert t.modes.sum(0) == pytest.approx(x) and t.coeffs.shape == (6, 120)
    assert len(decompose.cwt(x, top_k=2, n_scales=6).scales) == 2
