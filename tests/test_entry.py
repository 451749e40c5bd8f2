"""The entry point's queries agree with their SQL at the smallest size."""

import duckdb
import pytest

import __spark_entry__ as entry
from kernelloom.plans.oracles import ORACLES
from kernelloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FEW = ("dataset_summary", "clean_interpolate", "robust_scale", "augment_grid", "cwt_energy", "gram_ntk", "gram_dtw", "krr_rbf_forecast", "run_all_domains", "gamma_predict", "histogram_50",
       "nth_series", "chunk_numbers", "slice_subsets", "gram_rbf", "gram_patches", "gram_wavelet_inner", "gram_dtw_banded", "kernel_scales", "gamma_suppliers", "krr_conjugate_gradients", "evaluation_report", "modes_forecast", "baby_kernel_own_taus", "series_plot", "load_range",
       "catalog_by_domain", "catalog_by_freq", "resolve_names")


def test_names():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["name", "domain", "rmse", "relative_rmse", "mase"]


@pytest.mark.parametrize("name", FEW)
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) and len(got)
    cols = sorted(got.columns)
    by = [c for c in cols if got[c].dtype.kind != "f"] + [c for c in cols if got[c].dtype.kind == "f"]
    got, want = (d[cols].sort_values(by, ignore_index=True) for d in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            assert got[c].to_numpy() == pytest.approx(want[c].to_numpy(), abs=2e-6, nan_ok=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c
