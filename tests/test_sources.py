"""Sources, subsets and feature columns on files and hand-written series."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernelloom.operators import augment, decompose, slicing
from kernelloom.sources import readers


def test_arrow_files_and_subsets(spark, tmp_path):
    table = pa.table({"item_id": ["a", "b", "c"], "target": [[1.0, 2.0], [], [3.0]], "other": [1, 2, 3]})
    for i, opened in enumerate((pa.ipc.new_file, pa.ipc.new_stream)):
        (tmp_path / f"set{i}").mkdir()
        with opened(str(tmp_path / f"set{i}" / "data.arrow"), table.schema) as out:
            out.write_table(table)
    (tmp_path / ".hidden").mkdir()
    assert readers.list_subsets(spark, str(tmp_path)) == ["set0", "set1"]
    spark.dataSource.register(readers.ArrowStreamSource)
    paths = ",".join(str(tmp_path / s / "data.arrow") for s in ("set0", "set1"))
    got = spark.read.format("arrow_series").schema("target array<double>, item_id string").option("paths", paths).load().collect()
    assert sorted((r.item_id, r.target) for r in got) == sorted([("a", [1, 2]), ("b", []), ("c", [3])] * 2)
    with pytest.raises(IndexError):
        readers.nth_series(spark.createDataFrame([(0,)], "series_index int"), 3)


def test_a_failing_subset_leaves_the_others(spark):
    series = spark.createDataFrame([(i, np.arange(300.0).tolist()) for i in range(5)], "k int, x array<double>")

    def load(name):
        if name == "broken":
            return spark.read.parquet("/nowhere")
        return series

    chunks, failed = slicing.slice_subsets(load, ["one", "broken", "old_two", "three"], slicing.Cut(20, 60, 120, 12, 40), skip=("old",), max_series=3)
    assert list(failed) == ["broken"] and {(r.subset, r.k) for r in chunks.select("subset", "k").distinct().collect()} == {(s, k) for s in ("one", "three") for k in range(3)}
    assert slicing.slice_subsets(load, ["broken"], slicing.Cut())[0] is None
    kept = slicing.skip_prefixes(chunks, ("on",))
    assert {r.subset for r in kept.select("subset").distinct().collect()} == {"three"}


def test_feature_columns(spark):
    x = np.sin(np.arange(60) / 3) + np.arange(60) / 20
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    t = decompose.cwt(x, "ricker", 3)
    options = {"include_original": True, "max_modes": 2, "n_scales": 3, "wavelet": "ricker"}
    deep = np.array(df.select(decompose.modes_column(F.col("x"), "cwt", length=70, **options)).first()[0])
    flat = np.array(df.select(decompose.modes_column(F.col("x"), "cwt", length=50, flatten=True, **options)).first()[0])
    want = np.vstack([x[None], t.modes[:2]])
    assert deep.T == pytest.approx(np.pad(want, ((0, 0), (10, 0)), "edge")) and flat == pytest.approx(want[:, -50:].ravel())
    own = df.select(decompose.modes_column(F.col("x"), lambda v: np.stack([v, 2 * v]))).first()[0]
    assert np.array(own).T == pytest.approx(np.stack([x, 2 * x]))
    with pytest.raises(ValueError):
        decompose.cwt(x, "db4")
    assert decompose.emd(x).shape[1] == 60
    rows = augment.prepare_examples(spark.createDataFrame([(x.tolist(), [1.0])], "history array<double>, future array<double>"), augment.with_stats)
    z = (x - x.mean()) / x.std()
    assert rows.first().x_model == pytest.approx([*z, z.mean(), z.std(), z.min(), z.max()])


def test_noise_has_its_deviation(spark):
    df = spark.createDataFrame([(0, np.linspace(0, 10, 4000).tolist()), (1, [2.0] * 4000)], "k int, x array<double>")
    got = df.select("k", "x", augment.noise(F.col("x"), 0.1, F.col("k").cast("string")).alias("y")).collect()
    for r, spread in zip(sorted(got), (0.1 * np.std(np.linspace(0, 10, 4000)), 0.1)):
        d = np.array(r.y) - np.array(r.x)
        assert d.std() == pytest.approx(spread, rel=0.05) and abs(d.mean()) < 0.1 * spread
        assert abs(np.corrcoef(d[1:], d[:-1])[0, 1]) < 0.06 and abs((np.abs(d) < spread).mean() - 0.683) < 0.03


def write_arrow(path, n, opened=pa.ipc.new_file, size=10):
    table = pa.table({"k": list(range(n)), "x": [[float(i + j) for j in range(300)] for i in range(n)]})
    with opened(str(path), table.schema) as out:
        out.write_table(table, max_chunksize=size)


def test_a_broken_file_is_a_row_with_its_reason(spark, tmp_path):
    for name, n in (("whole", 45), ("cut", 45), ("stream", 25)):
        write_arrow(tmp_path / name, n, pa.ipc.new_stream if name == "stream" else pa.ipc.new_file)
    data = (tmp_path / "cut").read_bytes()
    (tmp_path / "cut").write_bytes(data[: len(data) // 2])
    (tmp_path / "nothing").write_bytes(b"no arrow at all")
    spark.dataSource.register(readers.ArrowStreamSource)
    paths = ",".join(str(tmp_path / n) for n in ("whole", "cut", "stream", "nothing", "absent"))
    read = lambda schema, **o: spark.read.format("arrow_series").schema(schema).options(paths=paths, batches=2, **o).load()
    rows = read("k int, x array<double>, _file string, _row long, _error string")
    assert rows.rdd.getNumPartitions() == 3 + 4
    good = rows.where("_error is null").groupBy("_file").count().collect()
    found = {r._file.rsplit("/", 1)[1]: r["count"] for r in good}
    # what stands before the cut can still be read
    assert found["whole"] == 45 and found["stream"] == 25 and 10 <= found["cut"] < 45 and len(found) == 3
    assert {r._row for r in rows.where("_error is null and _file like '%whole'").collect()} == set(range(45))
    chunks, failed = slicing.slice_files(rows, slicing.Cut(20, 60, 120, 12, 40))
    assert {r._file.rsplit("/", 1)[1] for r in failed.collect()} == {"cut", "nothing", "absent"} and all(r.reason for r in failed.collect())
    assert {r.subset.rsplit("/", 1)[1] for r in chunks.select("subset").distinct().collect()} == set(found)
    # a range of rows of each file
    some = read("k int, _file string, _error string", start=7, stop=23).where("_error is null and _file like '%whole'")
    assert sorted(r.k for r in some.collect()) == list(range(7, 23))
    # without a place for the reason the job fails
    with pytest.raises(Exception, match="absent|Arrow|No such"):
        read("k int").collect()


def test_ranges_are_kept_and_the_oldest_goes(spark, sf, tmp_path):
    cache, path = readers.RangeCache(3), f"{sf}/customer.parquet"
    first = cache.load(spark, path, "train[0:10]", ordinal="c_custkey")
    assert cache.load(spark, path, "train[0:10]", ordinal="c_custkey") is first
    stored = str(tmp_path / "rows.parquet")
    spark.range(50).selectExpr("id AS sample_idx").write.parquet(stored)
    kept = cache.load(spark, stored, "train[5:20]")
    assert kept.count() == 15
    for f in (tmp_path / "rows.parquet").glob("*.parquet"):
        f.unlink()
    # read again without its files
    assert cache.load(spark, stored, "train[5:20]").count() == 15
    for n in (1, 2):
        cache.load(spark, path, "train", n, "c_custkey")
    assert len(cache.kept) == 3 and not first.storageLevel.useMemory and kept.storageLevel.useMemory
    cache.clear()
    assert not kept.storageLevel.useMemory


def test_nested_arrays_are_named(spark):
    df = spark.createDataFrame([(0, [[1.0]])], "sample_idx int, target array<array<double>>")
    with pytest.raises(TypeError, match="array of numbers"):
        readers.build_examples(df)
    with pytest.raises(KeyError):
        readers.build_examples(df.select("sample_idx"))


def test_frequencies_match(spark):
    from kernelloom import catalog

    configs = catalog.catalog(spark).where("source = 'eval'").withColumn("f", catalog.frequency())
    assert configs.where("f is null or f <> freq").isEmpty()
    train = spark.createDataFrame([("a", "H"), ("b", "D"), ("c", None)], "item string, freq string")
    assert [r.item for r in catalog.same_frequency(train, spark.createDataFrame([("H",), (None,), ("H",)], "freq string")).collect()] == ["a"]


def test_running_numbers(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k int, start int").repartition(6)
    got = slicing.numbered(df, "k", "start").orderBy("k", "start").collect()
    assert [r.sample_idx for r in got] == list(range(100))
    assert slicing.numbered(df.limit(0), "k", "start").count() == 0
