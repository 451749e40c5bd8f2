"""Scanning series: ranges of rows, the two sample formats, examples, summaries."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from kernelloom.functions.arrays import finite, mean, std_pop
from kernelloom.functions.series import clean, history_stats, scaled


def parse_split(split: str) -> tuple[int, int | None]:
    """(start, stop) of ``train[a:b]``; a missing bound is 0 or None."""
    name, bracket, rest = split.partition("[")
    if not bracket:
        return 0, None
    lo, _, hi = rest.rstrip("]").partition(":")
    return int(lo or 0), int(hi) if hi else None


def row_range(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, ordinal: str = "sample_idx") -> DataFrame:
    """Every ``step``-th row from start to before stop of a stored ordinal; pushed down to the scan."""
    rows = df.where(F.col(ordinal) >= start)
    rows = rows if stop is None else rows.where(F.col(ordinal) < stop)
    return rows if step == 1 else rows.where((F.col(ordinal) - start) % step == 0)


def load_rows(spark: SparkSession, path: str, split: str = "train", n_samples: int | None = None, ordinal: str = "sample_idx") -> DataFrame:
    start, stop = parse_split(split)
    if n_samples:
        stop = start + n_samples if stop is None else min(stop, start + n_samples)
    return row_range(spark.read.parquet(path), start, stop, ordinal=ordinal)


def history_future(df: DataFrame) -> tuple[Column, Column]:
    """(history, future) by format: both columns stored, or a whole ``target`` with an empty future."""
    kinds = dict(df.dtypes)
    for name in {"history_value", "future_value", "target"} & set(df.columns):
        if kinds[name].startswith("array<array") or not kinds[name].startswith("array<"):
            raise TypeError(f"{name} is {kinds[name]}: a series is an array of numbers")
    if {"history_value", "future_value"} <= set(df.columns):
        return F.col("history_value").cast("array<double>"), F.col("future_value").cast("array<double>")
    if "target" in df.columns:
        return F.col("target").cast("array<double>"), F.array().cast("array<double>")
    raise KeyError("samples have history_value and future_value, or target")


def build_examples(df: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, extra_keys: tuple[str, ...] = (), ordinal: str = "sample_idx") -> DataFrame:
    """sample_idx, history, future and extras: cleaned samples of a range of rows.

    ``stop`` is start + 1000 unless given.  Empty histories go and the others keep their ordinal; an extra
    that doesn't exist is a null column.
    """
    history, future = history_future(df)
    rows = row_range(df, start, start + 1000 if stop is None else stop, step, ordinal)
    extras = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in extra_keys]
    return rows.where(F.size(history) > 0).select(F.col(ordinal).alias("sample_idx"), clean(history).alias("history"), clean(future).alias("future"), *extras)


def quick_peek(df: DataFrame, index: int, normalize: bool = False, ordinal: str = "sample_idx") -> DataFrame:
    """One sample, cleaned, if wanted scaled by its history."""
    rows = build_examples(df, index, index + 1, ordinal=ordinal)
    if not normalize:
        return rows
    mu, sigma = history_stats(F.col("history"))
    return rows.withColumns({"mu": mu, "sigma": sigma}).select("sample_idx", scaled(F.col("history"), F.col("mu"), F.col("sigma")).alias("history"), scaled(F.col("future"), F.col("mu"), F.col("sigma")).alias("future"))


def dataset_summary(df: DataFrame, n_samples: int | None = None, max_display: int | None = None, ordinal: str = "sample_idx") -> DataFrame:
    """Lengths, means and deviations of cleaned samples, and their raw counts of missing values.

    ``max_display`` keeps the first rows of the report; without it the report is whole.
    """
    history, future = history_future(df)
    rows = df if n_samples is None else row_range(df, 0, n_samples, ordinal=ordinal)
    rows = rows if max_display is None else row_range(rows, 0, max_display, ordinal=ordinal)
    missing = lambda x: F.size(F.filter(x, lambda v: ~F.coalesce(finite(v), F.lit(False)))).cast("long")
    rows = rows.select(F.col(ordinal).alias("sample_idx"), history.alias("h"), future.alias("f"), missing(history).alias("history_nans"), missing(future).alias("future_nans"))
    rows = rows.withColumns({"h": clean(F.col("h")), "f": clean(F.col("f"))})
    return rows.select(
        "sample_idx", F.size("h").cast("long").alias("history_len"), F.size("f").cast("long").alias("future_len"), mean(F.col("h")).alias("history_mean"), std_pop(F.col("h")).alias("history_std"),
        mean(F.col("f")).alias("future_mean"), std_pop(F.col("f")).alias("future_std"), "history_nans", "future_nans",
    )


def list_subsets(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root``, sorted, without hidden ones; a listing of the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName() for s in found if s.isDirectory() and not s.getPath().getName().startswith("."))


def first_series(df: DataFrame, max_series: int, group: str = "dataset", ordinal: str = "series_index") -> DataFrame:
    """Each dataset's first ``max_series`` series."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(ordinal))).where(F.col("_r") <= max_series).drop("_r")


def nth_series(df: DataFrame, index: int, ordinal: str = "series_index") -> DataFrame:
    """The series of one ordinal; IndexError where there is none."""
    rows = df.where(F.col(ordinal) == index)
    if rows.isEmpty():
        raise IndexError(f"no series {index}")
    return rows


def train_future(train: DataFrame, validation: DataFrame, keys: tuple[str, ...] = ("dataset", "series_index")) -> DataFrame:
    """keys, train, future: the validation series goes on where the training series ends."""
    joined = train.select(*keys, F.col("target").cast("array<double>").alias("train")).join(validation.select(*keys, F.col("target").cast("array<double>").alias("_v")), list(keys))
    return joined.select(*keys, "train", F.slice("_v", F.size("train") + 1, F.greatest(F.size("_v") - F.size("train"), F.lit(0))).alias("future"))


class RangeCache:
    """Ranges of stored rows that a session keeps: a second load of one reads no file.  At most ``most`` are
    kept; the one that wasn't used for longest goes first."""

    def __init__(self, most: int = 16):
        self.most, self.kept = most, OrderedDict()

    def load(self, spark: SparkSession, path: str, split: str = "train", n_samples: int | None = None, ordinal: str = "sample_idx") -> DataFrame:
        """``load_rows``, kept in memory and on disk."""
        key = (path, split, n_samples, ordinal)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        self.kept[key] = load_rows(spark, path, split, n_samples, ordinal).persist(StorageLevel.MEMORY_AND_DISK)
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)[1].unpersist()
        return self.kept[key]

    def clear(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()


class _Batches(InputPartition):
    """Some record batches of a file; ``None``: all, as a stream."""

    def __init__(self, path: str, batches: tuple[int, int] | None):
        self.path, self.batches = path, batches


class ArrowStreamSource(DataSource):
    """``spark.read.format("arrow_series").schema(...)``: Arrow IPC files, opened through Arrow's file systems;
    columns outside the schema aren't read.

    ``paths`` names the files, by commas.  A file with a footer is cut into partitions of ``batches`` record
    batches each (16), one without is a stream and one partition.  ``start`` and ``stop`` are a range of row
    numbers within each file; batches outside it aren't read.  If the schema has a string column ``_error``, a
    file that can't be read to its end gives a row with the reason there, behind the rows that could be read,
    instead of failing the job; ``_file`` is the file's path, ``_row`` the row's number in it.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_series"

    def reader(self, schema: StructType) -> DataSourceReader:
        stop = self.options.get("stop")
        return _ArrowReader(schema, [p for p in self.options.get("paths", "").split(",") if p], int(self.options.get("batches", 16)), int(self.options.get("start", 0)), None if stop is None else int(stop))


class _ArrowReader(DataSourceReader):
    OWN = ("_file", "_row", "_error")

    def __init__(self, schema: StructType, paths: list[str], step: int, start: int, stop: int | None):
        self.names, self.paths, self.step, self.start, self.stop = schema.fieldNames(), paths, step, start, stop

    @staticmethod
    def _opened(path: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
        return store.open_input_file(at)

    def partitions(self) -> list[_Batches]:
        """Footers only are read here."""
        import pyarrow as pa

        out = []
        for path in self.paths:
            try:
                with self._opened(path) as source:
                    n = pa.ipc.open_file(source).num_record_batches
                out += [_Batches(path, (i, min(n, i + self.step))) for i in range(0, n, self.step)]
            except (pa.ArrowInvalid, OSError):
                out.append(_Batches(path, None))
        return out

    def read(self, part: _Batches) -> Iterator[tuple]:
        import pyarrow as pa

        try:
            with self._opened(part.path) as source:
                yield from self._rows(part, source)
        except (pa.ArrowInvalid, OSError, KeyError) as e:
            if "_error" not in self.names:
                raise
            own = {"_file": part.path, "_error": f"{type(e).__name__}: {e}"}
            yield tuple(own.get(n) for n in self.names)

    def _rows(self, part: _Batches, source) -> Iterator[tuple]:
        import pyarrow as pa

        if part.batches is None:
            # a file whose footer is gone is a stream behind its first eight bytes
            source.seek(8 if source.read(6) == b"ARROW1" else 0)
            batches, first = iter(pa.ipc.open_stream(source)), 0
        else:
            reader = pa.ipc.open_file(source)
            batches = (reader.get_batch(i) for i in range(*part.batches))
            first = sum(reader.get_batch(i).num_rows for i in range(part.batches[0])) if self.start or self.stop is not None or "_row" in self.names else 0
        for batch in batches:
            lo, hi = max(0, self.start - first), batch.num_rows if self.stop is None else min(batch.num_rows, self.stop - first)
            if lo < hi:
                some = batch.slice(lo, hi - lo)
                own = {"_file": [part.path] * (hi - lo), "_row": range(first + lo, first + hi), "_error": [None] * (hi - lo)}
                yield from zip(*[own[n] if n in self.OWN else some.column(n).to_pylist() for n in self.names])
            first += batch.num_rows
            if self.stop is not None and first >= self.stop:
                break
