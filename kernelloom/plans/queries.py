"""The registered queries of the forecasting operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kernelloom import catalog
from kernelloom.functions import series as S
from kernelloom.functions.arrays import tail
from kernelloom.operators import augment, decompose, metrics, pairwise, report, slicing, taugamma
from kernelloom.operators.kernels import DTW, NTK, RBF, FeatureMachine, Linear, MaskedRBF, PatchMachine, Wavelet, group_scales
from kernelloom.operators.solve import conjugate_gradients
from kernelloom.plans import forecast
from kernelloom.sources import readers
from kernelloom.sources.tables import HORIZON, money, nation_month, supplier_week, table, user_events, vectors
from kernelloom.staging import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAMMA, CONTEXT, PLACES = 1e-2, 12, 6
#: Behind the last ordinal of any table.
EVERY = 1 << 62


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _r(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, PLACES) + F.lit(0.0)


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[_r(n).alias(n) for n, t in df.dtypes if n not in keep and t == "double"])


def _long(df: DataFrame, col: str, key: str = "k") -> DataFrame:
    return df.select(key, F.posexplode(col).alias("t", "v")).select(key, F.col("t").cast("long").alias("t"), _r("v").alias("v"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as stored samples: sample_idx, history_value, future_value and labels."""
    x, n = F.col("x"), F.size("x")
    return nation_month(spark, sf).select(F.col("k").cast("long").alias("sample_idx"), "name", "domain", F.slice(x, F.lit(1), n - HORIZON).alias("history_value"), tail(x, HORIZON).alias("future_value"))


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.build_examples(_samples(spark, sf), stop=EVERY, extra_keys=("name", "domain"))
    return augment.prepare_examples(rows.withColumn("k", F.col("sample_idx").cast("int")))


def _split(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    return prepared.where("k % 5 <> 0"), prepared.where("k % 5 = 0")


def _scores(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[_r(c).alias(c) for c in ("rmse", "relative_rmse", "mase")])


# -- catalog, scans --------------------------------------------------------------------------------


#: The data set that each market segment's orders are taken for: aliases, and one plain name.
SEGMENT_DATA = {"AUTOMOBILE": "Traffic", "BUILDING": "Energy", "FURNITURE": "hospital_M_short", "HOUSEHOLD": "Solar", "MACHINERY": "Cloud"}


def _named_orders(spark: SparkSession, sf: str) -> DataFrame:
    """name, config, n_orders, spend: the orders of each data set's market segment, its name resolved."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    names = F.create_map(*[F.lit(x) for kv in SEGMENT_DATA.items() for x in kv])
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy(F.try_element_at(names, F.col("c_mktsegment")).alias("name"))
    return catalog.resolve(rows.agg(F.count("*").alias("n_orders"), _r(money(F.col("o_totalprice"), 1e6)).alias("spend")))


def _catalog_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog, with the orders stored for each configuration; 0 where there are none."""
    stored = _named_orders(spark, sf).groupBy("config").agg(F.sum("n_orders").alias("n_orders"), F.sum("spend").alias("spend"))
    return catalog.catalog(spark).join(stored, "config", "left").fillna({"n_orders": 0, "spend": 0.0})


@query
def catalog_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Domains of the catalog and what is stored for them."""
    rows = _catalog_orders(spark, sf)
    stored = rows.groupBy("source", "domain").agg(F.sum("n_orders").alias("n_orders"), _r(F.sum("spend")).alias("spend"))
    return catalog.by_domain(rows).join(stored, ["source", "domain"])


@query
def catalog_by_freq(spark: SparkSession, sf: str) -> DataFrame:
    """Frequencies of the evaluation configurations and what is stored for them."""
    rows = _catalog_orders(spark, sf)
    stored = rows.where("source = 'eval'").groupBy(catalog.frequency().alias("freq")).agg(F.sum("n_orders").alias("n_orders"), _r(F.sum("spend")).alias("spend"))
    return catalog.by_freq(rows).join(stored, "freq")


@query
def build_examples_stride(spark: SparkSession, sf: str) -> DataFrame:
    rows = readers.build_examples(_samples(spark, sf), 1, 22, 3, extra_keys=("name",))
    return rows.select("sample_idx", "name", F.size("history").cast("long").alias("history_len"), F.size("future").cast("long").alias("future_len"), _r(F.get("history", F.lit(0))).alias("first_value"), _r(F.get("future", F.lit(0))).alias("first_future"))


@query
def nth_series(spark: SparkSession, sf: str) -> DataFrame:
    return readers.nth_series(_samples(spark, sf), 7, "sample_idx").select("sample_idx", "name")


@query
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(readers.dataset_summary(_samples(spark, sf)), "sample_idx", "history_len", "future_len", "history_nans", "future_nans")


@query
def quick_peek(spark: SparkSession, sf: str) -> DataFrame:
    return _long(readers.quick_peek(_samples(spark, sf), 7, True), "history", "sample_idx")


# -- cleaning and scaling --------------------------------------------------------------------------


@query
def clean_interpolate(spark: SparkSession, sf: str) -> DataFrame:
    return S.clean_long(user_events(spark, sf), "k").select("k", F.col("t").cast("long").alias("t"), _r("clean").alias("clean"))


@query
def impute_strategies(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.impute_long(S.impute_long(user_events(spark, sf), "k", "ffill", out="ffill"), "k", "zero", out="zero")
    return rows.select("k", F.col("t").cast("long").alias("t"), _r("ffill").alias("ffill"), _r("zero").alias("zero"), F.col("v").isNotNull().alias("observed"))


@query
def missing_pct(spark: SparkSession, sf: str) -> DataFrame:
    return user_events(spark, sf).groupBy("k").agg(_r(F.avg(F.col("v").isNull().cast("double")) * 100).alias("missing_pct"), F.count("*").alias("n"))


@query
def znorm_history(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_prepared(spark, sf), "history_n")


@query
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.robust_stats_long(user_events(spark, sf), "k"), "k")


@query
def asinh_transform(spark: SparkSession, sf: str) -> DataFrame:
    """Scaled values, and whether the inverse gives the values again."""
    rows = _prepared(spark, sf).withColumn("z", S.transform_with_stats(F.col("history"), F.col("mu"), F.col("sigma")))
    rows = rows.withColumn("back", S.inverse_transform_with_stats(F.col("z"), F.col("mu"), F.col("sigma")))
    return rows.select("k", F.posexplode(F.arrays_zip("z", "back", "history")).alias("t", "e")).select("k", F.col("t").cast("long").alias("t"), _r("e.z").alias("z"), (F.abs(F.col("e.back") - F.col("e.history")) < 1e-9).alias("same"))


@query
def resample_linear(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_prepared(spark, sf).withColumn("v", S.resample(F.col("history"), 40)), "v")


# -- slicing, augmentation, masks ------------------------------------------------------------------


@query
def slice_fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_week(spark, sf).select("k", F.explode(slicing.fixed_slices(S.impute(F.col("x"), "zero"), 60, 20)).alias("c"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rows.select("k", F.col("c.start").cast("long").alias("start"), _r(total(F.col("c.history"))).alias("history_sum"), _r(total(F.col("c.future"))).alias("future_sum"))


@query
def slice_seeded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = supplier_week(spark, sf).select("k", S.impute(F.col("x"), "zero").alias("x"))
    made = slicing.slices(rows, slicing.Cut(20, 60, 120, 12, 40))
    return made.select("k", "chunk", "start", F.size("history").alias("history_len"), F.size("future").alias("future_len"))


@query
def uniform_length_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Histories cropped or padded to 60 steps, futures cropped to 8."""
    return _long(augment.uniform_length(_prepared(spark, sf).select("k", "sample_idx", "history", "future"), 60, 8), "history")


@query
def shifted_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prepared(spark, sf)
    kinds = [F.struct(F.lit(fill).alias("fill"), F.lit(by).alias("by"), S.shift(F.col("history"), by, fill).alias("x")) for fill in ("edge", "reflect", "wrap") for by in (3, -2)]
    return rows.select("k", F.explode(F.array(*kinds)).alias("s")).select("k", "s.fill", F.col("s.by").cast("long").alias("by"), F.posexplode("s.x").alias("t", "v")).select("k", "fill", "by", F.col("t").cast("long").alias("t"), _r("v").alias("v"))


@query
def moving_average_edge(spark: SparkSession, sf: str) -> DataFrame:
    return S.smooth_long(S.clean_long(user_events(spark, sf), "k"), "k", 5, v="clean").select("k", F.col("t").cast("long").alias("t"), _r("smooth").alias("smooth"))


@query
def augment_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = augment.augment(_prepared(spark, sf), (3, -2), "edge", 5)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + F.abs(v))
    return rows.select("k", F.col("shift").cast("long").alias("shift"), "smoothed", _r(total(F.col("history_n"))).alias("history_size"), _r(total(F.col("future_n"))).alias("future_size"))


@query
def jitter_noise(spark: SparkSession, sf: str) -> DataFrame:
    rows = augment.augment(_prepared(spark, sf), (), sigma=0.05, seed=1)
    return _long(rows.where("noisy"), "history_n")


@query
def constant_run_mask(spark: SparkSession, sf: str) -> DataFrame:
    """Masks of event values in steps of fifty, where runs of two or more are constant."""
    rows = user_events(spark, sf).withColumn("v", F.round(F.coalesce("v", F.lit(0.0)) / 50, 0) * 50)
    return S.run_mask_long(rows, "k", 2).select("k", F.col("t").cast("long").alias("t"), "v", "mask")


@query
def mask_shift(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform("history_value", lambda v: F.when(v.isNotNull(), 1.0).otherwise(0.0))
    return _long(_samples(spark, sf).select(F.col("sample_idx").alias("k"), S.shift_mask(mask, 3).alias("m")), "m")


# -- decomposition ---------------------------------------------------------------------------------


def _cwt(spark: SparkSession, sf: str, top_k: int | None = None) -> DataFrame:
    made = decompose.cwt_column(F.col("history"), wavelet="ricker", n_scales=4, lo=1.0, hi=3.0, spacing="linear", top_k=top_k)
    rows = _prepared(spark, sf).select("k", F.explode(made).alias("c"))
    return rows.select("k", _r("c.scale").alias("scale"), _r("c.energy").alias("energy"))


@query
def cwt_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _cwt(spark, sf)


@query
def cwt_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _cwt(spark, sf, 2)


@query
def emd_modes(spark: SparkSession, sf: str) -> DataFrame:
    made = decompose.modes_column(F.col("history_n"), "emd", max_modes=6)
    return _prepared(spark, sf).select("k", F.posexplode(made).alias("t", "modes")).select("k", "t", F.posexplode("modes").alias("mode", "v")).select("k", "t", "mode", _r("v").alias("v"))


# -- pairs and kernels -----------------------------------------------------------------------------


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).select("k", F.col("history_n").alias("x"))


def _landmarks(rows: DataFrame) -> DataFrame:
    """The query set: rows whose id is divisible by 20, against all rows."""
    return rows.where("k % 20 = 0").select("k", "x")


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), _r("value").alias("value"))


@query
def sqdist_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return _pairs(pairwise.pair_values(_landmarks(rows), rows.select("k", "x"), lambda u, v: pairwise.squared_distances(pairwise.stack(u["x"]), pairwise.stack(v["x"]))))


@query
def gram_rbf(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return _pairs(RBF(0.8).gram(_landmarks(rows), rows.select("k", "x")))


@query
def gram_linear(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return _pairs(Linear(0.5).gram(_landmarks(rows), rows.select("k", "x")))


@query
def gram_ntk(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors(spark, sf)
    return _pairs(NTK(2).gram(_landmarks(rows), rows.select("k", "x")))


@query
def gram_self(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings with each other, in several blocks: each pair of blocks is computed once and mirrored."""
    return _pairs(RBF(0.8).gram(vectors(spark, sf).select("k", "x"), block=256))


@query
def gram_dtw_banded(spark: SparkSession, sf: str) -> DataFrame:
    """Nations warped within a band of six months, on two channels: the scaled value and its change."""
    change = F.transform("history_n", lambda v, i: F.when(i > 0, v - F.get("history_n", i - 1)).otherwise(0.0))
    both = F.zip_with("history_n", change, lambda v, d: F.array(v, d))
    return _pairs(DTW(10.0, 6).gram(_prepared(spark, sf).select("k", both.alias("x"))))


@query
def kernel_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's own length scales, for kernels whose parameters aren't set."""
    kernels = {"rbf": RBF(), "masked_rbf": MaskedRBF(), "dtw": DTW(), "patches": PatchMachine(8, 2), "wavelet": Wavelet("coeffs", None, 4, 1.0, 3.0)}
    rows = _prepared(spark, sf).select("domain", "k", F.col("history_n").alias("x"))
    return _rounded(group_scales(rows, kernels, "domain"), "domain", "kernel")


@query
def gram_masked_rbf(spark: SparkSession, sf: str) -> DataFrame:
    """Nations by their observed months; a month without orders takes no part."""
    x, n = F.col("x"), F.size("x")
    rows = nation_month(spark, sf).select("k", S.impute(F.slice(x, F.lit(1), n - HORIZON), "zero").alias("x"))
    return _pairs(MaskedRBF(1.0).gram(rows.withColumn("mask", S.zero_mask(F.col("x")))))


@query
def median_lengthscale(spark: SparkSession, sf: str) -> DataFrame:
    kernel = RBF(points=32).fitted(_nations(spark, sf))
    return spark.createDataFrame([(kernel.lengthscale,)], "lengthscale double").select(_r("lengthscale").alias("lengthscale"))


@query
def gram_dtw(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(DTW(10.0).gram(_nations(spark, sf)))


@query
def gram_wavelet_energy(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(Wavelet("energy", 50.0, 4, 1.0, 3.0).gram(_nations(spark, sf)))


@query
def gram_wavelet_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(Wavelet("inner", None, 4, 1.0, 3.0).gram(_nations(spark, sf)))


@query
def gram_patches(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(PatchMachine(8, 2, lengthscale=3.0).gram(_nations(spark, sf)))


# -- fits, forecasts, scores -----------------------------------------------------------------------


@query
def krr_fit_alpha(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(_prepared(spark, sf))
    model, _ = forecast.fit(forecast.modelled(train), RBF(10.0), GAMMA)
    return _long(model, "alpha")


@query
def krr_conjugate_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """The same system without a dense solve."""
    train, _ = _split(_prepared(spark, sf))
    return _long(conjugate_gradients(forecast.modelled(train), RBF(10.0), GAMMA), "alpha")


@query
def krr_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings' last 16 dimensions from their first 48, solved over tiles."""
    rows = vectors(spark, sf).select("k", F.slice("x", 1, 48).alias("x"), F.slice("x", 49, 16).alias("y"))
    return _long(conjugate_gradients(rows, RBF(0.8), 0.1, 1e-8, landmarks=1024), "alpha")


@query
def krr_rbf_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(forecast.train_eval(*_split(_prepared(spark, sf)), RBF(10.0), GAMMA).predictions, "name", "domain")


@query
def krr_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(forecast.train_eval(*_split(_prepared(spark, sf)), RBF(10.0), GAMMA).summary(), "n_test")


@query
def run_all_domains(spark: SparkSession, sf: str) -> DataFrame:
    """A model a region, tested on the nation of its largest key; keys run through the regions in turn."""
    rows = _prepared(spark, sf)
    return _scores(forecast.run_all_domains(rows.where("k < 20"), rows.where("k >= 20"), RBF(10.0), GAMMA), "name", "domain")


@query
def scaling_study(spark: SparkSession, sf: str) -> DataFrame:
    rows = forecast.scaling_study(*_split(_prepared(spark, sf)), RBF(10.0), GAMMA, [5, 10, 20])
    return _rounded(rows.groupBy("n_train").agg(F.avg("rmse").alias("mean_rmse"), F.avg("mase").alias("mean_mase")).withColumn("n_train", F.col("n_train").cast("long")), "n_train")


@query
def krr_masked_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prepared(spark, sf).withColumn("mask", S.run_mask(F.col("history")))
    return _scores(forecast.train_eval(*_split(rows), MaskedRBF(1.0), GAMMA).predictions, "name")


@query
def rfm_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(forecast.train_eval(*_split(_prepared(spark, sf)), FeatureMachine(2), GAMMA).predictions, "name")


@query
def conv_rfm_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(forecast.train_eval(*_split(_prepared(spark, sf)), PatchMachine(8, 4, 2), GAMMA).predictions, "name")


@query
def rfm_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Learnt features of all suppliers' weeks, forecasts of every fifth."""
    x, n = S.impute(F.col("x"), "zero"), F.size("x")
    rows = supplier_week(spark, sf).select("k", F.slice(x, F.lit(1), n - HORIZON).alias("history"), tail(x, HORIZON).alias("future"))
    return _scores(forecast.train_eval(*_split(augment.prepare_examples(rows)), FeatureMachine(1), GAMMA).predictions, "k")


@query
def modes_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """A fit on channels: each history beside its wavelet modes, time-major."""
    modes = decompose.modes_column(F.col("history_n"), "cwt", include_original=True, wavelet="ricker", n_scales=4, lo=1.0, hi=3.0, spacing="linear")
    return _scores(forecast.train_eval(*_split(_prepared(spark, sf).withColumn("x_model", modes)), RBF(10.0), GAMMA).predictions, "name", "domain")


def _naive(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts that repeat the last value."""
    last = F.array_repeat(F.get("history", F.size("history") - 1), HORIZON)
    return metrics.scored(_prepared(spark, sf).withColumn("future_pred", last))


@query
def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(_naive(spark, sf), "k")


@query
def compare_domains(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(report.box(_naive(spark, sf), "mase", "domain"), "domain", "n")


@query
def domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.summary(_naive(spark, sf), "domain"), "domain", "n_test")


@query
def residual_steps(spark: SparkSession, sf: str) -> DataFrame:
    return report.residuals(_naive(spark, sf)).select("k", F.col("step").cast("long").alias("step"), _r("predicted").alias("predicted"), _r("residual").alias("residual"))


@query
def evaluation_report(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers of an evaluation in one table: summary, split, both histograms, scores."""
    rows = _prepared(spark, sf)
    train, _ = _split(rows)
    made = report.report(_naive(spark, sf).where("k % 5 = 0"), rows, train)
    return made.select("part", "label", F.col("bin").cast("long").alias("bin"), *[_r(c).alias(c) for c in ("lo", "hi")], "n", _r("value").alias("value"))


@query
def chunk_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A running number over all chunks of all suppliers."""
    weeks = supplier_week(spark, sf).select("k", F.explode(slicing.fixed_slices(S.impute(F.col("x"), "zero"), 60, 20)).alias("c"))
    made = slicing.numbered(weeks.select("k", F.col("c.start").cast("long").alias("start")), "k", "start")
    return made.select("k", "start", "sample_idx")


@query
def split_complement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prepared(spark, sf)
    train, test = forecast.split_by_keys(rows, test=rows.where("k % 5 = 0"))
    return report.split_map(rows, train, test)


@query
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prepared(spark, sf)
    return report.split_map(rows, *forecast.split_random(rows, 5, 1))


@query
def histogram_50(spark: SparkSession, sf: str) -> DataFrame:
    return report.histogram(user_events(spark, sf)).select(F.col("bin").cast("long").alias("bin"), _r("lo").alias("lo"), _r("hi").alias("hi"), "n")


@query
def series_plot(spark: SparkSession, sf: str) -> DataFrame:
    return report.series_plot(_prepared(spark, sf), context=24).select("k", F.col("t").cast("long").alias("t"), "part", _r("v").alias("v"))


@query
def resolve_names(spark: SparkSession, sf: str) -> DataFrame:
    """The stored data sets' names, aliases or plain, with their configurations and orders."""
    return _named_orders(spark, sf)


@query
def frequency_match(spark: SparkSession, sf: str) -> DataFrame:
    """Of suppliers taken for monthly, weekly and undated series, those of the nations' frequency."""
    freq = F.when(F.col("k") % 3 == 0, "M").when(F.col("k") % 3 == 1, "W")
    nations = _samples(spark, sf).select(F.lit("M").alias("freq"))
    return catalog.same_frequency(supplier_week(spark, sf).select("k", freq.alias("freq"), F.size("x").cast("long").alias("weeks")), nations)


@query
def load_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a split by their stored ordinal, the range pushed down to the scan."""
    rows = readers.load_rows(spark, f"{sf.rstrip('/')}/customer.parquet", "train[10:500]", 200, ordinal="c_custkey")
    return rows.select("c_custkey", "c_name", "c_nationkey")


@query
def train_future(spark: SparkSession, sf: str) -> DataFrame:
    """Where a nation's validation series goes on behind its training series."""
    rows = nation_month(spark, sf).select(F.col("domain").alias("dataset"), F.col("k").alias("series_index"), S.impute(F.col("x"), "zero").alias("x"))
    train = rows.withColumn("target", F.slice("x", F.lit(1), F.size("x") - HORIZON))
    joined = readers.train_future(train, rows.withColumnRenamed("x", "target"))
    return _long(joined.select(F.col("series_index").alias("k"), "future"), "future")


@query
def uniform_length_pad(spark: SparkSession, sf: str) -> DataFrame:
    """Histories padded in front to 80 steps and futures behind to 20, by pieces of themselves."""
    made = augment.uniform_length(_prepared(spark, sf).select("k", "sample_idx", "history", "future"), 80, 20, min_len=1)
    return _long(made.select("k", F.concat("history", "future").alias("x")), "x")


@query
def length_report(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers kept and dropped by a least number of observed weeks."""
    rows = supplier_week(spark, sf).select(F.col("k").alias("sample_idx"), F.filter("x", lambda v: v.isNotNull()).alias("history"), (F.col("k") % 4).alias("part"))
    return augment.length_report(rows, augment.uniform_length(rows, 290, min_len=290), "part")


@query
def slice_subsets(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of the suppliers' series by subset: one subset is skipped by its prefix, one can't be loaded, and
    of the others the first nine series are cut."""
    series = supplier_week(spark, sf).select("k", S.impute(F.col("x"), "zero").alias("x"))

    def load(name: str) -> DataFrame:
        if name == "absent":
            raise FileNotFoundError(name)
        return series.where(F.col("k") % 3 == int(name[-1]))

    chunks, failed = slicing.slice_subsets(load, ["part0", "absent", "skip1", "part2"], slicing.Cut(20, 60, 120, 12, 40), 5, ("skip",), 9)
    if list(failed) != ["absent"]:
        raise ValueError(failed)
    return slicing.counts(chunks)


@query
def mask_sparsity(spark: SparkSession, sf: str) -> DataFrame:
    """Of each region's histories, whether all have a mask of their constant runs, and how much it hides."""
    zero = S.impute(F.col("history_value"), "zero")
    rows = _samples(spark, sf).withColumn("mask", F.when(F.col("sample_idx") != 7, S.run_mask(zero, 2)))
    return _rounded(forecast.mask_sparsity(rows, "domain"), "domain", "all_masked")


@query
def domain_models(spark: SparkSession, sf: str) -> DataFrame:
    """The models of ``run_all_domains`` and their scores by region, in twelve columns."""
    rows = _prepared(spark, sf)
    scores = forecast.run_all_domains(rows.where("k < 20"), rows.where("k >= 20"), RBF(), GAMMA)
    return _rounded(metrics.model_summary(scores.withColumn("config", F.lit("nation_month")), "domain", "config"), "domain", "config", "kernel", "n_train", "n_test")


@query
def masked_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Regions' models by observed months only: a month without orders takes no part."""
    rows = _prepared(spark, sf).join(_observed(spark, sf), "k")
    return _scores(forecast.run_all_domains(rows.where("k < 20"), rows.where("k >= 20"), MaskedRBF(1.0), GAMMA), "name", "domain")


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    mask = F.transform("history_value", lambda v: F.when(v.isNotNull(), 1.0).otherwise(0.0))
    return _samples(spark, sf).select(F.col("sample_idx").cast("int").alias("k"), mask.alias("mask"))


@query
def learnt_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Regions' models by learnt features."""
    rows = _prepared(spark, sf)
    return _scores(forecast.run_all_domains(rows.where("k < 20"), rows.where("k >= 20"), FeatureMachine(2), GAMMA), "name", "domain")


@query
def pretrain_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Pretraining on chunks of the suppliers' weeks, evaluation on the nations' months."""
    weeks = supplier_week(spark, sf).select("k", F.explode(slicing.fixed_slices(S.impute(F.col("x"), "zero"), 300, HORIZON)).alias("c"))
    chunks = weeks.select(F.col("k").alias("sample_idx"), "c.history", "c.future")
    made = forecast.pretrain_eval(chunks, _prepared(spark, sf).select("sample_idx", "name", "history", "future"), RBF(10.0), GAMMA, 60, HORIZON)
    return _scores(made.predictions, "name")


@query
def gram_wavelet_coeffs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(Wavelet("coeffs", 20.0, 4, 1.0, 3.0).gram(_nations(spark, sf)))


@query
def series_grid(spark: SparkSession, sf: str) -> DataFrame:
    return report.series_grid(_prepared(spark, sf), [3, 7, 11], context=24).select("k", F.col("t").cast("long").alias("t"), "part", _r("v").alias("v"))


@query
def predictions_plot(spark: SparkSession, sf: str) -> DataFrame:
    return report.predictions_plot(_naive(spark, sf), context=24).select("k", "label", F.col("t").cast("long").alias("t"), "part", _r("v").alias("v"))


# -- time kernels ----------------------------------------------------------------------------------


def _bank(spark: SparkSession, sf: str) -> DataFrame:
    x, n = F.col("x"), F.size("x")
    rows = nation_month(spark, sf).select("k", "name", F.slice(x, F.lit(1), n - HORIZON).alias("train"), tail(x, HORIZON).alias("future"))
    return taugamma.prepare_bank(rows, CONTEXT)


@query
def support_bank(spark: SparkSession, sf: str) -> DataFrame:
    """A bank of all nations with one common context, the first of Asia unseen."""
    x, n = F.col("x"), F.size("x")
    at = F.row_number().over(Window.partitionBy("domain").orderBy("k")) - 1
    rows = nation_month(spark, sf).select(F.col("domain").alias("dataset"), at.alias("series_index"), F.slice(x, F.lit(1), n - HORIZON).alias("train"), tail(x, HORIZON).alias("future"))
    bank, context = taugamma.support_bank(rows, 6, power_of_two=True, unseen=("ASIA", 0))
    return _rounded(bank.select("name", "unseen", F.lit(context).cast("long").alias("context"), F.size("context_filled").cast("long").alias("context_length"), F.size("future_filled").cast("long").alias("horizon_length"), "loc", "scale"), "name", "unseen", "context", "context_length", "horizon_length")


@query
def support_bank_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(taugamma.summarize_bank(_bank(spark, sf)), "name", "context_length", "horizon_length")


@query
def tau_array(spark: SparkSession, sf: str) -> DataFrame:
    taus = taugamma.tau_array(F.size("train"), CONTEXT)
    return _bank(spark, sf).select("k", F.posexplode(taus).alias("p", "tau")).select("k", F.col("p").cast("long").alias("p"), F.col("tau").cast("long").alias("tau"))


@query
def baby_kernel(spark: SparkSession, sf: str) -> DataFrame:
    rows = taugamma.time_kernels(_bank(spark, sf), CONTEXT)
    return rows.select("k", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), _r("value").alias("value"))


@query
def baby_kernel_own_taus(spark: SparkSession, sf: str) -> DataFrame:
    """Every third nation with look-backs of its own."""
    bank = cut(_bank(spark, sf))
    own = bank.where("k % 3 = 0").select("k", F.array(F.lit(0), F.lit(3), (F.col("k") + 5).cast("int")).alias("taus"))
    rows = taugamma.time_kernels(bank, CONTEXT, taus=own)
    return rows.select("k", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), _r("value").alias("value"))


@query
def mama_kernel(spark: SparkSession, sf: str) -> DataFrame:
    rows = taugamma.mean_time_kernel(taugamma.time_kernels(_bank(spark, sf), CONTEXT))
    return rows.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), _r("value").alias("value"))


def _gamma(spark: SparkSession, sf: str):
    # both are read several times
    bank = cut(_bank(spark, sf))
    own = cut(taugamma.time_kernels(bank, CONTEXT))
    return bank, own, taugamma.dense(taugamma.mean_time_kernel(own), CONTEXT)


@query
def gamma_gram(spark: SparkSession, sf: str) -> DataFrame:
    bank, _, k = _gamma(spark, sf)
    return _pairs(taugamma.gamma_gram(bank.select("k", F.col("context_filled").alias("x")), None, k, 0.1))


@query
def gamma_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Nations whose key is divisible by five from the others, on the original scale; steps without an
    observed target are left out of the solve."""
    bank, _, k = _gamma(spark, sf)
    rows = bank.select("k", F.col("context_filled").alias("x"), F.col("future_filled").alias("y"), F.transform("future_mask", lambda m: m.cast("double")).alias("y_mask"), "loc", "scale")
    made = taugamma.predict_gamma(rows.where("k % 5 <> 0").drop("loc", "scale"), rows.where("k % 5 = 0").select("k", "x"), k, 0.1, 0.1)
    back = made.join(rows.select("k", "loc", "scale"), "k").withColumn("v", S.inverse_transform_with_stats(F.col("yhat"), F.col("loc"), F.col("scale")))
    return _long(back, "v")


@query
def gamma_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers whose key is divisible by five from all the others, by their weeks."""
    x, n = F.col("x"), F.size("x")
    rows = supplier_week(spark, sf).select("k", F.slice(x, F.lit(1), n - HORIZON).alias("train"), tail(x, HORIZON).alias("future"))
    bank = cut(taugamma.prepare_bank(rows, CONTEXT))
    k = taugamma.dense(taugamma.mean_time_kernel(taugamma.time_kernels(bank, CONTEXT)), CONTEXT)
    rows = bank.select("k", F.col("context_filled").alias("x"), F.col("future_filled").alias("y"), F.transform("future_mask", lambda m: m.cast("double")).alias("y_mask"), "loc", "scale")
    made = taugamma.predict_gamma(rows.where("k % 5 <> 0").drop("loc", "scale"), rows.where("k % 5 = 0").select("k", "x"), k, 0.1, 0.1)
    back = made.join(rows.select("k", "loc", "scale"), "k").withColumn("v", S.inverse_transform_with_stats(F.col("yhat"), F.col("loc"), F.col("scale")))
    return _long(back, "v")


@query
def context_energy(spark: SparkSession, sf: str) -> DataFrame:
    bank, own, k = _gamma(spark, sf)
    return _rounded(taugamma.energy(bank.select("k", F.col("context_filled").alias("v")), own, k, 0.1), "k")


@query
def max_series(spark: SparkSession, sf: str) -> DataFrame:
    """Each region's first three nations."""
    rows = _samples(spark, sf).withColumn("dataset", F.col("domain"))
    return readers.first_series(rows, 3, ordinal="sample_idx").select("domain", "sample_idx", "name")
