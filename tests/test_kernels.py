"""Kernels, solvers and forecasts against dense NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from kernelloom.operators import pairwise, solve, taugamma
from kernelloom.operators.kernels import DTW, NTK, RBF, FeatureMachine, Linear, MaskedRBF, PatchMachine, Wavelet
from kernelloom.operators.solve import conjugate_gradients, fit_dense, predict
from kernelloom.plans import forecast

RNG = np.random.default_rng(5)
X, Y = RNG.normal(size=(30, 24)), RNG.normal(size=(30, 3))


def frame(n=30):
    return pd.DataFrame({"k": range(n), "x": list(X[:n]), "y": list(Y[:n])})


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, X[i].tolist(), Y[i].tolist()) for i in range(30)], "k int, x array<double>, y array<double>").cache()


@pytest.mark.parametrize("kernel", [RBF(3.0), Linear(1.0), NTK(2), MaskedRBF(1.0), DTW(2.0, 4), Wavelet("inner", n_scales=3), PatchMachine(6, lengthscale=2.0)])
def test_properties(kernel):
    g = kernel.matrix(frame(), frame())
    assert g == pytest.approx(g.T)
    if isinstance(kernel, (RBF, NTK, DTW, Wavelet)):
        assert np.diag(g) == pytest.approx(1.0)


def test_masked_equals_plain():
    d, ones = X.shape[1], [np.ones(X.shape[1])] * 30
    masked = MaskedRBF(1.0).matrix(frame().assign(mask=ones), frame().assign(mask=ones))
    assert masked == pytest.approx(RBF(np.sqrt(d)).matrix(frame(), frame()))


def test_dtw():
    a, b = np.array([1.0, 3, 2, 5])[:, None], np.array([1.0, 2, 2.5, 5, 4])[:, None]
    assert pairwise.dtw(a, [b, a])[0] == pytest.approx(1.5) and pairwise.dtw(a, [b, a])[1] == 0
    assert np.isinf(pairwise.dtw(a, [np.zeros((9, 1))], 1)[0])


def test_gram_in_tiles(rows):
    got = RBF(3.0).gram(rows, block=7).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
    assert got == pytest.approx(RBF(3.0).matrix(frame(), frame()))


def test_solvers_agree(rows):
    dense = {r.k: r.alpha for r in fit_dense(rows, RBF(3.0), 0.1).collect()}
    alpha = np.linalg.solve(RBF(3.0).matrix(frame(), frame()) + 0.1 * np.eye(30), Y)
    assert np.array([dense[i] for i in range(30)]) == pytest.approx(alpha)
    loose = {r.k: r.alpha for r in conjugate_gradients(rows, RBF(3.0), 1.0, 1e-6, block=16).collect()}
    assert np.array([loose[i] for i in range(30)]) == pytest.approx(np.linalg.solve(RBF(3.0).matrix(frame(), frame()) + np.eye(30), Y), abs=1e-4)
    # few landmarks, several blocks of both sides: the iteration itself
    some = {r.k: r.alpha for r in conjugate_gradients(rows, RBF(3.0), 0.1, 1e-9, block=7, landmarks=6).collect()}
    assert np.array([some[i] for i in range(30)]) == pytest.approx(alpha, abs=1e-6)
    made = predict(fit_dense(rows, RBF(3.0), 0.1), rows.select("k", "x"), RBF(3.0), block=11)
    assert np.array([r.yhat for r in made.orderBy("k").collect()]) == pytest.approx(RBF(3.0).matrix(frame(), frame()) @ alpha)
    with pytest.raises(ValueError):
        fit_dense(rows, RBF(3.0), 0.1, max_rows=10)


@pytest.mark.parametrize("kernel", [FeatureMachine(2), PatchMachine(6, 3, 2)])
def test_learnt_projections(kernel):
    made = kernel.learnt(frame(), Y, 0.1)
    assert np.linalg.norm(np.array(made.projection)) == pytest.approx(1.0)
    one = FeatureMachine(1).learnt(frame(), Y, 0.1)
    plain = RBF().estimated(frame().iloc[:24])
    g = plain.matrix(frame(), frame())
    w = g.T * np.linalg.solve(g + 0.1 * np.eye(30), Y).sum(1)[None]
    grad = np.array([sum(w[i, j] * (X[j] - X[i]) for j in range(30)) for i in range(30)]) / (2 * plain.lengthscale**2)
    m = grad.T @ grad
    assert np.array(one.projection) == pytest.approx(m / np.linalg.norm(m))


def test_masked_gamma(spark):
    seen = (RNG.random((30, 3)) > 0.3).astype(float)
    seen[:, 2] = 0
    k = np.eye(24) * 2
    df = spark.createDataFrame([(i, X[i].tolist(), Y[i].tolist(), seen[i].tolist()) for i in range(30)], "k int, x array<double>, y array<double>, y_mask array<double>")
    got = np.array([r.yhat for r in taugamma.predict_gamma(df, df.select("k", "x"), k, 0.5, 0.1, fill=7.0).orderBy("k").collect()])
    g = X @ np.linalg.inv(k + 0.5 * np.eye(24)) @ X.T
    for h in range(2):
        s = seen[:, h] > 0
        assert got[:, h] == pytest.approx(g[:, s] @ np.linalg.solve(g[np.ix_(s, s)] + 0.1 * np.eye(s.sum()), Y[s, h]))
    assert got[:, 2] == pytest.approx(7.0)


def test_splits_and_sizes(rows):
    train, test = forecast.split_random(rows, 6, 1)
    assert (train.count(), test.count()) == (24, 6)
    with pytest.raises(ValueError):
        forecast.split_random(rows, 30)
    with pytest.raises(IndexError):
        forecast.split_by_keys(rows, rows.selectExpr("k + 100 AS k"))
    assert forecast.study_sizes(40) == sorted(set(forecast.study_sizes(40))) and forecast.study_sizes(2000)[-1] <= 707


@pytest.mark.parametrize("kernel", [FeatureMachine(2), PatchMachine(6, 3, 2)])
def test_learning_over_tiles_equals_one_task(rows, kernel):
    made = forecast.learn(rows, 30, kernel, 0.1)
    own = frame().sort_values("k", key=lambda k: k)
    sample = {int(k) for k in forecast.drawn(rows, kernel.points)["k"]}
    own = pd.concat([own[own["k"].isin(sample)], own[~own["k"].isin(sample)]], ignore_index=True)
    want = kernel.learnt(own, np.array(own["y"].tolist()), 0.1)
    assert np.array(made.projection) == pytest.approx(np.array(want.projection)) and made.lengthscale == pytest.approx(want.lengthscale)
    # brute force of one round's patch gradients
    one = PatchMachine(6, 3, 1).learnt(frame(), Y, 0.1)
    if isinstance(kernel, PatchMachine):
        p = np.array([[x[u : u + 6] for u in range(0, 19, 3)] for x in X])
        plain = PatchMachine(6, 3, lengthscale=one.lengthscale)
        a = np.linalg.solve(plain.matrix(frame(), frame()) + 0.1 * np.eye(30), Y).sum(1)
        m = np.zeros((6, 6))
        for i in range(30):
            for u in range(p.shape[1]):
                g = sum(a[j] * np.exp(-((p[i, u] - p[j, u]) ** 2).sum() / (2 * one.lengthscale**2)) * (p[j, u] - p[i, u]) for j in range(30))
                m += np.outer(g, g)
        assert np.array(one.projection) == pytest.approx(m / np.linalg.norm(m))


def test_domains_learn_and_mask(spark):
    from kernelloom.operators.augment import prepare_examples

    data = [(i, "ab"[i % 2], X[i].tolist(), Y[i].tolist(), (RNG.random(24) > 0.3).astype(float).tolist()) for i in range(30)]
    made = prepare_examples(spark.createDataFrame(data, "k int, domain string, history array<double>, future array<double>, mask array<double>"))
    train, test = made.where("k < 24"), made.where("k >= 24")
    for kernel in (FeatureMachine(2), MaskedRBF(), RBF()):
        got = {r.k: r for r in forecast.run_all_domains(train, test, kernel, 0.1).collect()}
        for domain in "ab":
            own = forecast.train_eval(train.where(f"domain = '{domain}'"), test.where(f"domain = '{domain}'"), kernel, 0.1)
            for r in own.predictions.collect():
                assert got[r.k].future_pred == pytest.approx(r.future_pred) and got[r.k].n_train == 12 and got[r.k].kernel == type(kernel).__name__
    # a domain whose series differ in length can't be solved, and leaves the other alone
    odd = train.withColumn("x_model", F.when((F.col("domain") == "b") & (F.col("k") < 5), F.array(F.lit(1.0))).otherwise(F.col("x_model")))
    assert {r.domain for r in forecast.run_all_domains(odd, test, RBF(3.0), 0.1).collect()} == {"a"}
    assert forecast.masks_or_zeros(made).columns == made.columns
    assert "mask" not in forecast.masks_or_zeros(made.withColumn("mask", F.when(F.col("k") > 3, F.col("mask")))).columns


def test_unsolved_gradients_raise(rows):
    with pytest.raises(RuntimeError):
        conjugate_gradients(rows, RBF(3.0), 1e-6, 1e-12, rounds=1, landmarks=5)


@pytest.fixture
def sizes(monkeypatch):
    """The planner's sizes of the frames that a solver cuts."""
    own, found = solve.cut, []

    def cut(df):
        made = own(df)
        found.append(made._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return made

    monkeypatch.setattr(solve, "cut", cut)
    return found


def test_rounds_do_not_square_the_planned_size(rows, sizes):
    """The estimate of a round had twice the last one's digits, on the driver."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    conjugate_gradients(rows, RBF(3.0), 0.02, 1e-9, block=16, landmarks=2)
    assert len(sizes) > 8 and max(sizes) < 1 << 200
    assert rows.sparkSession.conf.get("spark.sql.shuffle.partitions") == parts


def test_a_round_is_two_jobs(rows, sizes):
    """A round was six jobs, each planned anew on the driver."""
    spark = rows.sparkSession
    adaptive, broadcast = (spark.conf.get(f"spark.sql.{c}") for c in ("adaptive.enabled", "autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a broadcast is a job
    spark.sparkContext.setJobGroup("rounds", "")
    try:
        conjugate_gradients(rows, RBF(3.0), 0.02, 1e-9, block=16, landmarks=2)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert len(sizes) > 8 and jobs < 3 * len(sizes) + 12
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_learning_by_rounds_equals_dense_solves(rows, sizes, monkeypatch):
    want = forecast.learn(rows, 30, FeatureMachine(1), 0.1)
    monkeypatch.setattr(forecast, "conjugate_gradients", lambda *a: conjugate_gradients(*a, landmarks=2))
    made = forecast.learn(rows, 30, FeatureMachine(1), 0.1, max_rows=5)
    assert np.array(made.projection) == pytest.approx(np.array(want.projection), abs=1e-6)
    assert len(sizes) > 8 and max(sizes) < 1 << 200


def test_rounds_ship_no_projection(rows, monkeypatch):
    """Each round of a solve left a copy of the learnt matrix with the driver."""
    own, shipped = solve.Dealt.sums, []

    def sums(self, vectors, fn, out):
        shipped.append(len(cloudpickle.dumps(fn)))
        return own(self, vectors, fn, out)

    monkeypatch.setattr(solve.Dealt, "sums", sums)
    kernel = FeatureMachine(1).learnt(frame(), Y, 0.1)
    made = conjugate_gradients(rows, kernel, 0.1, landmarks=6).cache()
    assert len(shipped) > 2 and max(shipped) < 24 * 24 * 8 / 2
    g = kernel.matrix(frame(), frame())
    alpha = {r.k: r.alpha for r in made.collect()}
    assert np.array([alpha[i] for i in range(30)]) == pytest.approx(np.linalg.solve(g + 0.1 * np.eye(30), Y), abs=1e-6)
    assert np.array([x for x in made.orderBy("k").toPandas()["x"]]) == pytest.approx(X)
    got = {r.k: r.yhat for r in predict(made, rows.select("k", "x"), kernel, block=11).collect()}
    assert np.array([got[i] for i in range(30)]) == pytest.approx(g @ np.linalg.solve(g + 0.1 * np.eye(30), Y), abs=1e-6)
    values = {(r.i, r.j): r.value for r in kernel.gram(rows.select("k", "x"), block=8).collect()}
    assert np.array([[values[i, j] for j in range(30)] for i in range(30)]) == pytest.approx(g)


def test_sums_over_blocks_of_both_sides(rows):
    """Arrays of any length, in several blocks of either side, and of a dealt frame whose vectors come later."""
    want = np.exp(-pairwise.squared_distances(X, X) / 18)
    part = lambda u, v: RBF(3.0).matrix(u, v) @ pairwise.stack(v["y"])
    for deep in (4, 100):
        made = pairwise.block_sums(rows.select("k", "x"), rows, part, "s", block=7, deep=deep)
        assert np.array([r.s for r in made.orderBy("k").collect()]) == pytest.approx(want @ Y)
        dealt = pairwise.Dealt(rows.select("k", "x"), 30, block=7, deep=deep)
        assert np.array([r.s for r in dealt.sums(rows.select("k", "y"), part, "s").orderBy("k").collect()]) == pytest.approx(want @ Y)
        dealt.drop()
    ragged = pairwise.block_sums(rows.select("k", "x"), rows, lambda u, v: [np.full(k % 3, len(v)) for k in u["k"]], "s", block=7, deep=4)
    assert {r.k: list(r.s) for r in ragged.collect()} == {k: [30.0] * (k % 3) for k in range(30)}


def test_dealt_vectors_are_not_copied_for_each_block(rows):
    """A round's vectors, and all series once, were copied for each of the other side's blocks; each pair was made twice."""
    want = RBF(3.0).matrix(frame(), frame()) @ Y
    dealt = pairwise.Dealt(rows.select("k", "x"), 30, block=7, mirrored=True)
    assert dealt.blocks == 5 and dealt.rows.count() == 5
    assert max(len(p) for p in dealt.rows.select("_b").rdd.glom().collect()) == 1
    for single in (False, True):
        made = dealt.sums(rows.select("k", "y"), lambda u, v, single=single: RBF(3.0).products(u, v, "y", single, 4), "s")
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
        assert np.array([r.s for r in made.orderBy("k").collect()]) == pytest.approx(want, abs=1e-5 if single else 1e-12)
    dealt.drop()


def test_single_precision_is_near_wherever_series_lie():
    for far in (X * 0, X * 0 + 3e3, np.arange(30)[:, None] % 2 * 1e4 + X * 0):
        t = pd.DataFrame({"x": list(X + far), "y": list(Y)})
        for u in (t, t.iloc[:11]):
            for got, want in zip(RBF(3.0).products(u, t, "y", True, 4), RBF(3.0).products(u, t, "y", False, 4)):
                assert got == pytest.approx(want, abs=1e-4)


def test_rounds_in_single_precision_solve_in_double(rows, monkeypatch):
    monkeypatch.setattr(solve, "SINGLE_ROWS", 10)
    made = conjugate_gradients(rows, RBF(3.0), 0.1, 1e-9, block=7, landmarks=6)
    alpha = np.linalg.solve(RBF(3.0).matrix(frame(), frame()) + 0.1 * np.eye(30), Y)
    assert np.array([r.alpha for r in made.orderBy("k").collect()]) == pytest.approx(alpha, abs=1e-7)


def test_gamma_weights_equal_the_dense_form(spark):
    k, x = np.eye(24) + 0.1, X[:20]
    df = spark.createDataFrame([(i, X[i].tolist(), Y[i].tolist()) for i in range(20)], "k int, x array<double>, y array<double>").repartition(5)
    w, bias = taugamma.gamma_weights(df, k, 0.5, 0.1)
    a = np.linalg.inv(k + 0.5 * np.eye(24))
    dense = X @ a @ x.T @ np.linalg.solve(x @ a @ x.T + 0.1 * np.eye(20), Y[:20])
    assert X @ w + bias == pytest.approx(dense, abs=1e-9)
    with pytest.raises(ValueError):
        taugamma.gamma_weights(df.limit(0), k, 0.5, 0.1)


def test_large_domains_equal_dense_ones(spark):
    from kernelloom.operators.augment import prepare_examples

    data = [(i, "abc"[i % 3], X[i].tolist(), Y[i].tolist()) for i in range(30)]
    made = prepare_examples(spark.createDataFrame(data, "k int, domain string, history array<double>, future array<double>"))
    train, test = made.where("k < 24 and (domain <> 'c' or k < 9)"), made.where("k >= 24 and domain <> 'c'")
    small = {r.k: r for r in forecast.run_all_domains(train, test, RBF(), 0.1).collect()}
    sweep = forecast.sweep_domains(train, test, RBF(), 0.1, max_rows=5)
    large = {r.k: r for r in sweep.predictions.collect()}
    assert small.keys() == large.keys() and len(large) == 4
    for k, r in large.items():
        assert r.future_pred == pytest.approx(small[k].future_pred, abs=1e-6) and (r.n_train, r.lengthscale) == (small[k].n_train, pytest.approx(small[k].lengthscale))
    assert [tuple(r) for r in sweep.failed.collect()] == [("c", "no test rows")]
    odd = train.withColumn("x_model", F.when((F.col("domain") == "b") & (F.col("k") < 5), F.array(F.lit(1.0))).otherwise(F.col("x_model")))
    assert "UnequalLengths" in {r.domain: r.reason for r in forecast.sweep_domains(odd, test, RBF(3.0), 0.1).failed.collect()}["b"]


def test_kernels_of_channels(spark):
    """Series of channels, time-major, are compared as what they hold; a fit on them equals plain numpy."""
    deep = [[[float(a), float(b)] for a, b in zip(X[i, :12], X[i, 12:])] for i in range(12)]
    df = spark.createDataFrame([(i, deep[i], Y[i].tolist()) for i in range(12)], "k int, x array<array<double>>, y array<double>")
    flat = np.array(deep).reshape(12, -1)
    g = np.exp(-pairwise.squared_distances(flat, flat) / 18)
    model = fit_dense(df.where("k < 9"), RBF(3.0), 0.1)
    want = g[9:, :9] @ np.linalg.solve(g[:9, :9] + 0.1 * np.eye(9), Y[:9])
    got = predict(model, df.where("k >= 9").select("k", "x"), RBF(3.0)).orderBy("k").collect()
    assert np.array([r.yhat for r in got]) == pytest.approx(want)
    got = DTW(2.0, 3).gram(df.where("k < 4").select("k", "x")).toPandas().pivot(index="i", columns="j", values="value").to_numpy()
    assert got == pytest.approx(got.T) and np.diag(got) == pytest.approx(1.0) and got[0, 1] < 1


def test_banded_warping_against_the_plain_recursion():
    rng = np.random.default_rng(1)
    for n, m, w in ((1, 1, None), (5, 7, None), (7, 5, 2), (6, 6, 0), (9, 4, 3), (4, 9, 5)):
        a, b = rng.normal(size=(n, 2)), rng.normal(size=(m, 2))
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(n):
            for j in range(m):
                if w is None or abs(i - j) <= w:
                    cost[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
        assert pairwise.dtw(a, [b, b[:1]], w)[0] == pytest.approx(np.sqrt(cost[n, m]))


def test_patches_and_wavelets_of_unequal_lengths():
    u, v = [X[0], X[1][:15]], [X[2][:20], X[3], X[4][:9]]
    t = lambda xs: pd.DataFrame({"x": xs})
    got = PatchMachine(6, 2, lengthscale=2.0).matrix(t(u), t(v))
    for i, p in enumerate(u):
        for j, q in enumerate(v):
            n = min((len(p) - 6) // 2, (len(q) - 6) // 2) + 1
            assert got[i, j] == pytest.approx(sum(np.exp(-((p[2 * k : 2 * k + 6] - q[2 * k : 2 * k + 6]) ** 2).sum() / 8) for k in range(n)))
    kernel = Wavelet("inner", n_scales=3, scale_max=2.0)
    got = kernel.matrix(t(u), t(v))
    a, b = kernel._features(t(u)), kernel._features(t(v))
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            n = min(p.shape[1], q.shape[1])
            assert got[i, j] == pytest.approx((p[:, :n] * q[:, :n]).sum() / np.sqrt((p * p).sum() * (q * q).sum()))


def test_splines_modes_and_convolutions():
    from kernelloom.operators import decompose

    rng = np.random.default_rng(2)
    x, taps = rng.normal(size=4000), rng.normal(size=301)
    assert decompose.convolved(x, taps) == pytest.approx(np.convolve(x, taps), abs=1e-9)
    # an independent sifting step: dense spline through the extrema, mirrored once
    y = np.sin(np.arange(300) / 5) + 0.3 * np.sin(np.arange(300)) + np.arange(300) / 100

    def spline(at, v, n):
        h, m = np.diff(at), np.zeros((len(at), len(at)))
        m[0, 0] = m[-1, -1] = 1
        rhs = np.zeros(len(at))
        for i in range(1, len(at) - 1):
            m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
            rhs[i] = 6 * ((v[i + 1] - v[i]) / h[i] - (v[i] - v[i - 1]) / h[i - 1])
        c, out = np.linalg.solve(m, rhs), np.empty(n)
        for t in range(n):
            i = min(max(int(np.searchsorted(at, t, side="right")) - 1, 0), len(h) - 1)
            p, q = t - at[i], at[i + 1] - t
            out[t] = (c[i] * q**3 + c[i + 1] * p**3) / (6 * h[i]) + (v[i] / h[i] - c[i] * h[i] / 6) * q + (v[i + 1] / h[i] - c[i + 1] * h[i] / 6) * p
        return out

    def envelope(s, at):
        n = len(s)
        where = {-at[1]: s[at[1]], -at[0]: s[at[0]]} | {a: s[a] for a in at} | {2 * (n - 1) - at[-2]: s[at[-2]], 2 * (n - 1) - at[-1]: s[at[-1]]}
        keys = sorted(where)
        return spline(np.array(keys, float), np.array([where[k] for k in keys]), n)

    mode = y.copy()
    for _ in range(50):
        high = [i for i in range(1, 299) if mode[i - 1] < mode[i] >= mode[i + 1]]
        low = [i for i in range(1, 299) if mode[i - 1] > mode[i] <= mode[i + 1]]
        if len(high) < 2 or len(low) < 2:
            break
        centre = (envelope(mode, high) + envelope(mode, low)) / 2
        change = (centre**2).sum() / (mode**2).sum()
        mode = mode - centre
        if change < 0.04:
            break
    assert decompose.emd(y)[0] == pytest.approx(mode, abs=1e-9)


def test_time_kernels_with_own_lookbacks(spark):
    x = RNG.normal(size=50)
    bank = spark.createDataFrame([(1, x.tolist()), (2, x[:3].tolist())], "k int, train_filled array<double>")
    taus = spark.createDataFrame([(1, [0, 3, 99])], "k int, taus array<int>")
    got = taugamma.dense(taugamma.time_kernels(bank, 5, taus=taus).where("k = 1"), 5)
    want = np.zeros((5, 5))
    for tau in (0, 3):
        w = x[45 - tau : 50 - tau] * np.exp(-((np.linspace(0, 1, 5) - min(1, tau / 99)) ** 2))
        want += np.outer(w, w) / 2
    assert got == pytest.approx(want) and taugamma.time_kernels(bank, 5).where("k = 2").count() == 0


def test_pair_values_shuffle_rows_not_pairs(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "k long, x array<double>").repartition(5)
    monkeypatch.setattr(pairwise, "PACKED_ROWS", 16)
    fn = lambda u, v: pairwise.stack(u["x"]) @ pairwise.stack(v["x"]).T
    for right in (None, rows.where("k < 50")):
        made = pairwise.pair_values(rows, right, fn, block=4)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "BroadcastNestedLoop" not in plan
        want = [(i, j, i * j + 1.0) for i in range(60) for j in range(60 if right is None else 50)]
        assert sorted(map(tuple, made.collect())) == want
