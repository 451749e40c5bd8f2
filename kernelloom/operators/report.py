"""What the reports plot, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelloom.catalog import DEFAULTS
from kernelloom.functions.arrays import finite, tail
from kernelloom.staging import cut


def series_plot(df: DataFrame, key: str = "k", context: int = DEFAULTS.history_context_to_plot) -> DataFrame:
    """key, t, part, v: the last ``context`` values of the history at t < 0, the future from t = 0."""
    h = tail(F.col("history"), context)
    past = df.select(key, F.size(h).alias("n"), F.posexplode(h).alias("p", "v")).select(key, (F.col("p") - F.col("n")).alias("t"), F.lit("history").alias("part"), "v")
    return past.unionByName(df.select(key, F.posexplode("future").alias("t", "v")).select(key, "t", F.lit("future").alias("part"), "v"))


def series_grid(df: DataFrame, indices: list[int], key: str = "k", context: int = DEFAULTS.history_context_to_plot) -> DataFrame:
    """``series_plot`` of the given keys; IndexError if one isn't there."""
    rows = df.where(F.col(key).isin(indices))
    if rows.select(key).distinct().count() < len(set(indices)):
        raise IndexError("a series to plot isn't there")
    return series_plot(rows, key, context)


def predictions_plot(predictions: DataFrame, key: str = "k", context: int = 60) -> DataFrame:
    """key, label, t, part, v: the history's tail, the actual and the predicted future; the label has the score."""
    label = F.concat(F.lit("rRMSE "), F.format_number("relative_rmse", 3))
    rows = predictions.withColumn("label", label)
    actual = series_plot(rows, key, context).withColumn("part", F.when(F.col("part") == "future", "actual").otherwise(F.col("part")))
    made = rows.select(key, F.posexplode("future_pred").alias("t", "v")).select(key, "t", F.lit("predicted").alias("part"), "v")
    return actual.unionByName(made).join(rows.select(key, "label"), key).select(key, "label", "t", "part", "v")


def histogram(df: DataFrame, col: str = "v", bins: int = 50) -> DataFrame:
    """bin, lo, hi, n: equal widths between the least and the greatest finite value; the last bin holds
    the greatest.  Empty bins have n = 0."""
    rows = df.where(finite(F.col(col))).select(F.col(col).alias("v"))
    bounds = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo is not null")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = rows.join(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edges = bounds.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return edges.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("w") * F.col("bin")).alias("lo"), (F.col("lo") + F.col("w") * (F.col("bin") + 1)).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def box(df: DataFrame, col: str, *by: str) -> DataFrame:
    """n, lo, q1, median, q3, hi of finite values."""
    q = F.percentile(col, [0.25, 0.5, 0.75])
    out = df.where(finite(F.col(col))).groupBy(*by).agg(F.count("*").alias("n"), F.min(col).alias("lo"), q.alias("q"), F.max(col).alias("hi"))
    return out.select(*by, "n", "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "hi")


def split_map(df: DataFrame, train: DataFrame, test: DataFrame, key: str = "k") -> DataFrame:
    """key, level: 0 in the test set, 0.35 in the training set, 0.85 in neither; the test set wins."""
    marked = df.select(key).join(train.select(key, F.lit(True).alias("_a")), key, "left").join(test.select(key, F.lit(True).alias("_b")), key, "left")
    return marked.select(key, F.when(F.col("_b"), 0.0).when(F.col("_a"), 0.35).otherwise(0.85).alias("level"))


def residuals(predictions: DataFrame, key: str = "k") -> DataFrame:
    """key, step, predicted, residual."""
    zipped = F.arrays_zip(F.col("future").alias("y"), F.col("future_pred").alias("p"))
    return predictions.select(key, F.posexplode(zipped).alias("step", "e")).select(key, "step", F.col("e.p").alias("predicted"), (F.col("e.y") - F.col("e.p")).alias("residual"))


#: Metrics of a prediction, and which of their averages a report gives.
METRICS = ("rmse", "relative_rmse", "mase")


def report(predictions: DataFrame, every: DataFrame, train: DataFrame, key: str = "k", bins: int = 40) -> DataFrame:
    """(part, label, bin, lo, hi, n, value): all numbers of an evaluation report in one table.

    ``summary`` has the mean and median of each metric, ``split`` the number of series by level (as
    ``split_map``), ``residuals`` and ``rmse`` are histograms of ``bins`` equal widths between the least
    and the greatest value, ``scores`` has each series (label: its key) with rmse as lo, relative rmse as hi and mase as value.  Predictions
    are read once for the ranges and once for the rest, whose parts are grouping sets of one aggregate.
    """
    rows = cut(predictions.select(key, *METRICS, F.zip_with("future", "future_pred", lambda y, p: y - p).alias("left")))
    ends = lambda c: (F.min(c), F.max(c))
    r = rows.agg(*ends(F.array_min("left")), *ends(F.array_max("left")), *ends("rmse")).first()
    spans = {"residuals": (r[0], r[3]), "rmse": (r[4], r[5])}

    def place(v: Column, lo: float | None, hi: float | None) -> Column:
        if lo is None or hi <= lo:
            return F.lit(0)
        return F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")

    value = lambda part, label, v, b=None: F.struct(F.lit(part).alias("part"), F.lit(label).alias("label"), (F.lit(None).cast("int") if b is None else b).alias("bin"), v.cast("double").alias("v"))
    own = F.array(*[value("summary", m, F.col(m)) for m in METRICS], value("rmse", "", F.col("rmse"), place(F.col("rmse"), *spans["rmse"])))
    left = F.transform("left", lambda v: value("residuals", "", v, place(v, *spans["residuals"])))
    long = rows.select(F.explode(F.concat(own, left)).alias("e")).select("e.*")
    levels = split_map(every, train, predictions, key).select(F.lit("split").alias("part"), F.col("level").cast("string").alias("label"), F.lit(None).cast("int").alias("bin"), F.lit(1.0).alias("v"))
    # a median only of what has no bins
    sums = long.unionByName(levels).groupBy("part", "label", "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.median(F.when(F.col("part") == "summary", F.col("v"))).alias("median"))
    none = F.lit(None).cast("double")
    averages = sums.where("part = 'summary'").select("part", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{a}_"), "label").alias("label"), F.col(a).alias("value")) for a in ("mean", "median")])).alias("e"), "n")
    out = averages.select("part", "e.label", F.lit(None).cast("int").alias("bin"), none.alias("lo"), none.alias("hi"), "n", "e.value")
    out = out.unionByName(sums.where("part = 'split'").select("part", "label", "bin", none.alias("lo"), none.alias("hi"), "n", none.alias("value")))
    for part, (lo, hi) in spans.items():
        if lo is not None:
            edge = lambda i, lo=lo, hi=hi: F.lit(lo) + F.lit((hi - lo) / bins) * i
            counted = sums.where(F.col("part") == part).select("bin", "n")
            every_bin = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
            full = every_bin.join(counted, "bin", "left")
            out = out.unionByName(full.select(F.lit(part).alias("part"), F.lit("").alias("label"), "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), none.alias("value")))
    name = F.col(key).cast("string")
    scores = rows.select(F.lit("scores").alias("part"), name.alias("label"), F.lit(None).cast("int").alias("bin"), F.col("rmse").alias("lo"), F.col("relative_rmse").alias("hi"), F.lit(1).cast("long").alias("n"), F.col("mase").alias("value"))
    return out.unionByName(scores)
