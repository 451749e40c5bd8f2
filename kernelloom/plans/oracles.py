"""The registered queries as DuckDB SQL."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: Orders of each market segment, under the name and configuration that its data set is taken for.
_NAMED = """named AS (SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Traffic' WHEN 'BUILDING' THEN 'Energy' WHEN 'FURNITURE' THEN 'hospital_M_short' WHEN 'HOUSEHOLD' THEN 'Solar' WHEN 'MACHINERY' THEN 'Cloud' END AS name,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'loop_seattle_H_long' WHEN 'BUILDING' THEN 'electricity_H_long' WHEN 'FURNITURE' THEN 'hospital_M_short' WHEN 'HOUSEHOLD' THEN 'solar_H_long' WHEN 'MACHINERY' THEN 'bitbrains_fast_storage_5T_long' END AS config,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Transport' WHEN 'FURNITURE' THEN 'Healthcare' WHEN 'MACHINERY' THEN 'Web/CloudOps' ELSE 'Energy' END AS domain,
  CASE c_mktsegment WHEN 'FURNITURE' THEN 'M' WHEN 'MACHINERY' THEN '5T' ELSE 'H' END AS freq,
  count(*) AS n_orders, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1e6, 6) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)"""
#: How many configurations each domain and frequency has, and the first and last of them.
ORACLES["catalog_by_domain"] = f"""WITH {_NAMED}, stored AS (SELECT 'eval' AS source, domain, sum(n_orders)::BIGINT AS n_orders, round(sum(spend), 6) AS spend FROM named GROUP BY domain)
SELECT source, domain, n, first_config, last_config, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(spend, 0.0)::DOUBLE AS spend FROM (VALUES
  ('eval', 'Econ/Finance', 10::BIGINT, 'm4_daily_D_short', 'm_dense_H_short'),
  ('eval', 'Energy', 32, 'electricity_15T_long', 'solar_W_short'),
  ('eval', 'Healthcare', 2, 'covid_deaths_D_short', 'hospital_M_short'),
  ('eval', 'Nature', 18, 'jena_weather_10T_long', 'us_births_W_short'),
  ('eval', 'Sales', 4, 'car_parts_M_short', 'restaurant_D_short'),
  ('eval', 'Transport', 11, 'loop_seattle_5T_long', 'sz_taxi_H_short'),
  ('eval', 'Web/CloudOps', 20, 'bitbrains_fast_storage_5T_long', 'bizitobs_service_10S_short'),
  ('pretrain', 'Benchmarks', 14, 'cif_2016_12', 'tourism_yearly'),
  ('pretrain', 'Buildings', 5, 'bdg-2_bear', 'buildings_900k'),
  ('pretrain', 'Climate', 63, 'cmip6_1850', 'era5_2018'),
  ('pretrain', 'Econ/Finance', 5, 'bitcoin_with_missing', 'ideal'),
  ('pretrain', 'Energy', 19, 'australian_electricity_demand', 'wind_power'),
  ('pretrain', 'Healthcare', 4, 'cdc_fluview_ilinet', 'project_tycho'),
  ('pretrain', 'Nature/Weather', 9, 'beijing_air_quality', 'sunspot_with_missing'),
  ('pretrain', 'Other', 4, 'kdd2022', 'temperature_rain_D_short'),
  ('pretrain', 'Sales', 4, 'cockatoo', 'm5'),
  ('pretrain', 'Transport', 18, 'BEIJING_SUBWAY_30MIN', 'vehicle_trips_with_missing'),
  ('pretrain', 'Web/CloudOps', 7, 'alibaba_cluster_trace_2018', 'wiki-rolling_nips')
) AS c(source, domain, n, first_config, last_config) LEFT JOIN stored USING (source, domain)"""
ORACLES["catalog_by_freq"] = f"""WITH {_NAMED}, stored AS (SELECT freq, sum(n_orders)::BIGINT AS n_orders, round(sum(spend), 6) AS spend FROM named GROUP BY freq)
SELECT freq, n, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(spend, 0.0)::DOUBLE AS spend FROM (VALUES ('10S', 6::BIGINT), ('10T', 6), ('15T', 12), ('5T', 12), ('A', 1), ('D', 15), ('H', 31), ('M', 5), ('Q', 1), ('W', 8)) AS c(freq, n) LEFT JOIN stored USING (freq)"""
ORACLES["resolve_names"] = f"""WITH {_NAMED} SELECT name, config, n_orders, spend FROM named"""


def _cleaned(source: str, out: str, rest: str = "") -> str:
    """Long rows (k, t, v) of ``source`` with gaps interpolated; ``g`` is the raw value."""
    return f"""
{out}_g AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS bv, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS bt,
  first_value(v IGNORE NULLS) OVER a AS av, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS aft FROM {source}
  WINDOW b AS (PARTITION BY k ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT k, {rest} t, v AS g, CASE WHEN v IS NOT NULL THEN v WHEN bv IS NULL AND av IS NULL THEN 0 WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv
  ELSE bv + (av - bv) * (t - bt) / (aft - bt) END AS v FROM {out}_g)"""


NL = """
mb AS (SELECT min(year(o_orderdate) * 12 + month(o_orderdate)) AS lo, max(year(o_orderdate) * 12 + month(o_orderdate)) AS hi FROM orders),
ms AS (SELECT c_nationkey AS k, year(o_orderdate) * 12 + month(o_orderdate) - lo AS t, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS v
  FROM orders JOIN customer ON o_custkey = c_custkey, mb GROUP BY 1, 2),
nl AS (SELECT n_nationkey AS k, n_name AS name, r_name AS domain, c.t, c.n, ms.v FROM nation JOIN region ON n_regionkey = r_regionkey,
  (SELECT unnest(range(hi - lo + 1)) AS t, hi - lo + 1 AS n FROM mb) c LEFT JOIN ms ON ms.k = n_nationkey AND ms.t = c.t)"""
#: history and future are cleaned apart
NX = NL + """,
hl AS (SELECT k, name, domain, t, v FROM nl WHERE t < n - 12), fl AS (SELECT k, t, v FROM nl WHERE t >= n - 12),""" + _cleaned("hl", "hc", "name, domain,") + "," + _cleaned("fl", "fc") + """,
ex AS (SELECT h.*, f.f, f.f_nans FROM (SELECT k, name, domain, list(v ORDER BY t) AS h, count(*) - count(g) AS h_nans FROM hc GROUP BY 1, 2, 3) h
  JOIN (SELECT k, list(v ORDER BY t) AS f, count(*) - count(g) AS f_nans FROM fc GROUP BY 1) f USING (k)),
st AS (SELECT *, list_avg(h) AS mu, CASE WHEN list_stddev_pop(h) < 1e-8 THEN 1.0 ELSE list_stddev_pop(h) END AS sd FROM ex),
pr AS (SELECT *, list_transform(h, lambda v: (v - mu) / sd) AS hn, list_transform(f, lambda v: (v - mu) / sd) AS fn FROM st)"""
UE = """
ue AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"""
SW = """
sb AS (SELECT min(CAST(l_shipdate AS DATE)) AS first FROM lineitem),
sc AS (SELECT l_suppkey AS k, (CAST(l_shipdate AS DATE) - first) // 7 AS t, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem, sb GROUP BY 1, 2),
sm AS (SELECT min(t) AS lo, max(t) AS hi FROM sc),
sl AS (SELECT s_suppkey AS k, c.t, coalesce(sc.v, 0.0) AS v FROM supplier, (SELECT unnest(range(lo, hi + 1)) AS t FROM sm) c LEFT JOIN sc ON sc.k = s_suppkey AND sc.t = c.t),
sx AS (SELECT k, list(v ORDER BY t) AS x FROM sl GROUP BY 1)"""


def _r(e: str, name: str) -> str:
    return f"round({e}, 6) + 0.0 AS {name}"


def _long(source: str, x: str, key: str = "k", name: str | None = None, where: str = "true") -> str:
    return f"SELECT {key} AS {name or key}, CAST(i - 1 AS BIGINT) AS t, {_r(f'x[i]', 'v')} FROM (SELECT {key}, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT {key}, {x} AS x FROM {source} WHERE {where}))"


ORACLES["build_examples_stride"] = f"WITH {NX} SELECT CAST(k AS BIGINT) AS sample_idx, name, len(h) AS history_len, len(f) AS future_len, {_r('h[1]', 'first_value')}, {_r('f[1]', 'first_future')} FROM pr WHERE k >= 1 AND k < 22 AND (k - 1) % 3 = 0"
ORACLES["dataset_summary"] = f"""WITH {NX} SELECT CAST(k AS BIGINT) AS sample_idx, len(h) AS history_len, len(f) AS future_len, {_r('list_avg(h)', 'history_mean')}, {_r('list_stddev_pop(h)', 'history_std')},
{_r('list_avg(f)', 'future_mean')}, {_r('list_stddev_pop(f)', 'future_std')}, h_nans AS history_nans, f_nans AS future_nans FROM pr"""
ORACLES["quick_peek"] = f"WITH {NX} " + _long("(SELECT CAST(k AS BIGINT) AS k, hn FROM pr)", "hn", name="sample_idx", where="k = 7")
ORACLES["clean_interpolate"] = f"WITH {UE}, {_cleaned('ue', 'uc')} SELECT k, t, {_r('v', 'clean')} FROM uc"
ORACLES["impute_strategies"] = f"""WITH {UE}, {_cleaned('ue', 'uc')} SELECT k, t, {_r('coalesce(bv, av, 0.0)', 'ffill')}, {_r('coalesce(v, 0.0)', 'zero')}, v IS NOT NULL AS observed FROM uc_g"""
ORACLES["missing_pct"] = f"WITH {UE} SELECT k, {_r('100.0 * (count(*) - count(v)) / count(*)', 'missing_pct')}, count(*) AS n FROM ue GROUP BY 1"
ORACLES["znorm_history"] = f"WITH {NX} " + _long("pr", "hn")
ROBUST = """(SELECT k, coalesce(any_value(loc), 0.0) AS loc, CASE WHEN any_value(loc) IS NULL THEN 1.0 ELSE greatest(CASE WHEN quantile_cont(v, 0.75) > quantile_cont(v, 0.25) THEN (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.349 ELSE 0.0 END,
  1.4826 * median(abs(v - loc)), stddev_pop(v), 1e-6) END AS scale FROM (SELECT k, v, median(v) OVER (PARTITION BY k) AS loc FROM {source}) GROUP BY k)"""
ORACLES["robust_scale"] = f"WITH {UE} SELECT k, {_r('loc', 'loc')}, {_r('scale', 'scale')} FROM " + ROBUST.replace("{source}", "ue")
ORACLES["asinh_transform"] = f"""WITH {NX}, z AS (SELECT k, unnest(range(len(h))) AS t, unnest(h) AS v, mu, sd FROM pr) SELECT k, t, {_r('asinh((v - mu) / greatest(sd, 1e-8))', 'z')}, abs(mu + sd * sinh(asinh((v - mu) / greatest(sd, 1e-8))) - v) < 1e-9 AS same FROM z"""
ORACLES["resample_linear"] = f"""WITH {NX}, g AS (SELECT k, h, len(h) AS n, unnest(range(40)) AS t FROM pr), p AS (SELECT *, t * CAST(n - 1 AS DOUBLE) / 39 AS p FROM g)
SELECT k, t, {_r('h[CAST(floor(p) AS INT) + 1] + (p - floor(p)) * (h[CAST(least(n - 1, floor(p) + 1) AS INT) + 1] - h[CAST(floor(p) AS INT) + 1])', 'v')} FROM p"""
ORACLES["slice_fixed_chunks"] = f"""WITH {SW}, s AS (SELECT k, x, unnest(range(0, len(x) - 79, 60)) AS start FROM sx)
SELECT k, start, {_r('list_sum(x[start + 1:start + 60])', 'history_sum')}, {_r('list_sum(x[start + 61:start + 80])', 'future_sum')} FROM s"""
ORACLES["uniform_length_crop"] = f"WITH {NX} " + _long("pr", "h[len(h) - 59:]", where="len(h) >= 60")
ORACLES["shifted_series"] = f"""WITH {NX}, a AS (SELECT k, h, len(h) AS n FROM pr), s AS (
  SELECT k, 'edge' AS fill, 3 AS "by", list_concat([h[1], h[1], h[1]], h[1:n - 3]) AS x FROM a UNION ALL SELECT k, 'edge', -2, list_concat(h[3:], [h[n], h[n]]) FROM a
  UNION ALL SELECT k, 'reflect', 3, list_concat([h[4], h[3], h[2]], h[1:n - 3]) FROM a UNION ALL SELECT k, 'reflect', -2, list_concat(h[3:], [h[n - 1], h[n - 2]]) FROM a
  UNION ALL SELECT k, 'wrap', 3, list_concat(h[n - 2:], h[1:n - 3]) FROM a UNION ALL SELECT k, 'wrap', -2, list_concat(h[3:], h[1:2]) FROM a)
SELECT k, fill, CAST("by" AS BIGINT) AS "by", t, {_r('v', 'v')} FROM (SELECT k, fill, "by", unnest(range(len(x))) AS t, unnest(x) AS v FROM s)"""
SMOOTH = "list_transform(range(len({x})), lambda i: list_sum(list_transform(range(i - 2, i + 3), lambda j: {x}[CAST(greatest(0, least(len({x}) - 1, j)) AS INT) + 1])) / 5)"
ORACLES["moving_average_edge"] = f"""WITH {UE}, {_cleaned('ue', 'uc')}, w AS (SELECT k, list(v ORDER BY t) AS x FROM uc GROUP BY 1),
s AS (SELECT k, {SMOOTH.format(x='x')} AS x FROM w) SELECT k, t, {_r('v', 'smooth')} FROM (SELECT k, unnest(range(len(x))) AS t, unnest(x) AS v FROM s)"""
ORACLES["augment_grid"] = f"""WITH {NX}, a AS (SELECT k, len(hn) AS n, list_concat(hn, fn) AS w, len(hn) + len(fn) AS m FROM pr),
s AS (SELECT k, n, 0 AS shift, w FROM a UNION ALL SELECT k, n, 3, list_concat([w[1], w[1], w[1]], w[1:m - 3]) FROM a UNION ALL SELECT k, n, -2, list_concat(w[3:], [w[m], w[m]]) FROM a),
b AS (SELECT *, false AS smoothed FROM s UNION ALL SELECT k, n, shift, {SMOOTH.format(x='w')}, true FROM s),
c AS (SELECT *, list_avg(w[1:n]) AS mu, CASE WHEN list_stddev_pop(w[1:n]) < 1e-8 THEN 1.0 ELSE list_stddev_pop(w[1:n]) END AS sd FROM b)
SELECT k, CAST(shift AS BIGINT) AS shift, smoothed, {_r('list_sum(list_transform(w[1:n], lambda v: abs((v - mu) / sd)))', 'history_size')}, {_r('list_sum(list_transform(w[n + 1:], lambda v: abs((v - mu) / sd)))', 'future_size')} FROM c"""
ORACLES["constant_run_mask"] = f"""WITH {UE}, q AS (SELECT k, t, round(coalesce(v, 0.0) / 50, 0) * 50 AS v FROM ue), c AS (SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY k ORDER BY t) THEN 1 ELSE 0 END AS c FROM q),
r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY t) AS r FROM c), n AS (SELECT *, count(*) OVER (PARTITION BY k, r) AS n FROM r)
SELECT k, t, v, CASE WHEN v = 0 OR n >= 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask FROM n"""
ORACLES["mask_shift"] = f"""WITH {NL} SELECT CAST(k AS BIGINT) AS k, t, coalesce(lag(CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END, 3) OVER (PARTITION BY k ORDER BY t), 0.0)::DOUBLE AS v FROM nl WHERE t < n - 12"""

# ricker wavelets of the given scales by convolution
_CWT = """, sc AS (SELECT unnest([{scales}]) AS s),
tp AS (SELECT s, CAST(least(10 * s, {n}) AS INT) AS w FROM sc, (SELECT max(len(h)) AS n FROM pr) z), tq AS (SELECT s, w, unnest(range(-w, w + 1)) AS d FROM tp),
tt AS (SELECT s, d, 2 / (sqrt(3) * pow(pi(), 0.25)) * (1 - pow(d / s, 2)) * exp(-pow(d / s, 2) / 2) / sqrt(s) AS tap FROM tq),
sg AS (SELECT k, unnest(range(len({x}))) AS t, unnest({x}) AS v FROM pr),
co AS (SELECT a.k, tt.s, b.t, sum(a.v * tt.tap) AS c FROM sg a JOIN tt ON true JOIN sg b ON b.k = a.k AND b.t = a.t + tt.d GROUP BY 1, 2, 3),
en AS (SELECT k, s, sum(c * c) AS e FROM co GROUP BY 1, 2)"""


def _cwt(scales: str, x: str) -> str:
    return f"WITH {NX}" + _CWT.replace("{scales}", scales).replace("{x}", x).replace("{n}", "n")


_LINEAR, _GEOM = "1.0::DOUBLE, 5.0::DOUBLE/3, 7.0::DOUBLE/3, 3.0::DOUBLE", "1.0::DOUBLE, pow(3, 1.0::DOUBLE/3), pow(3, 2.0::DOUBLE/3), 3.0::DOUBLE"
ORACLES["cwt_energy"] = _cwt(_LINEAR, "h") + f" SELECT k, {_r('s', 'scale')}, {_r('e', 'energy')} FROM en"
ORACLES["cwt_topk"] = _cwt(_LINEAR, "h") + f" SELECT k, {_r('s', 'scale')}, {_r('e', 'energy')} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY e DESC, s) AS r FROM en) WHERE r <= 2"
ORACLES["gram_wavelet_energy"] = _cwt(_GEOM, "hn") + f" SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_r('exp(-sum(pow(a.e - b.e, 2)) / 5000)', 'value')} FROM en a JOIN en b ON a.s = b.s GROUP BY 1, 2"
ORACLES["gram_wavelet_coeffs"] = _cwt(_GEOM, "hn") + f" SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_r('exp(-sum(pow(a.c - b.c, 2)) / 800)', 'value')} FROM co a JOIN co b ON a.s = b.s AND a.t = b.t GROUP BY 1, 2"
ORACLES["gram_wavelet_inner"] = _cwt(_GEOM, "hn") + f""", ip AS (SELECT a.k AS i, b.k AS j, sum(a.c * b.c) AS p FROM co a JOIN co b ON a.s = b.s AND a.t = b.t GROUP BY 1, 2)
SELECT CAST(p.i AS BIGINT) AS i, CAST(p.j AS BIGINT) AS j, {_r('p.p / sqrt(u.p) / sqrt(v.p)', 'value')} FROM ip p JOIN ip u ON u.i = p.i AND u.j = p.i JOIN ip v ON v.i = p.j AND v.j = p.j"""

EM = """em AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), lm AS (SELECT k, x FROM em WHERE k % 20 = 0)"""
_PAIR = f"WITH {EM} SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {{value}} FROM lm a, em b"
ORACLES["sqdist_landmarks"] = _PAIR.format(value=_r("pow(list_distance(a.x, b.x), 2)", "value"))
ORACLES["gram_rbf"] = _PAIR.format(value=_r("exp(-pow(list_distance(a.x, b.x), 2) / 1.28)", "value"))
ORACLES["gram_linear"] = _PAIR.format(value=_r("list_inner_product(a.x, b.x) + 0.5", "value"))
_NTK = "list_inner_product({0}, {0})"
ORACLES["gram_ntk"] = f"""WITH {EM}, p0 AS (SELECT a.k AS i, b.k AS j, 2 * list_inner_product(a.x, b.x) / len(a.x) AS x, 2 * {_NTK.format('a.x')} / len(a.x) AS s, 2 * {_NTK.format('b.x')} / len(b.x) AS u FROM lm a, em b),
p1 AS (SELECT *, x AS th, greatest(-1, least(1, x / sqrt(s * u))) AS rho FROM p0),
p2 AS (SELECT i, j, s, u, 2 * sqrt(s * u) * (sqrt(1 - rho * rho) + (pi() - acos(rho)) * rho) / (2 * pi()) AS x, th * 2 * (pi() - acos(rho)) / (2 * pi()) AS t0 FROM p1),
p3 AS (SELECT *, x + t0 AS th, greatest(-1, least(1, x / sqrt(s * u))) AS rho FROM p2),
p4 AS (SELECT i, j, s, u, 2 * sqrt(s * u) * (sqrt(1 - rho * rho) + (pi() - acos(rho)) * rho) / (2 * pi()) AS x, th * 2 * (pi() - acos(rho)) / (2 * pi()) AS t0 FROM p3)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('(x + t0) / (3 * sqrt(s * u))', 'value')} FROM p4"""
ORACLES["gram_masked_rbf"] = f"""WITH {NL}, z AS (SELECT k, t, coalesce(v, 0.0) AS v FROM nl WHERE t < n - 12),
d AS (SELECT a.k AS i, b.k AS j, count(*) AS d, sum(CASE WHEN a.v <> 0 AND b.v <> 0 THEN 1 ELSE 0 END) AS r, sum(CASE WHEN a.v <> 0 AND b.v <> 0 THEN pow(a.v - b.v, 2) ELSE 0 END) AS d2 FROM z a JOIN z b ON a.t = b.t GROUP BY 1, 2)
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('CASE WHEN r > 0 THEN exp(-(d2 / (2 * r) + 0.01 * (d - r))) ELSE 0 END', 'value')} FROM d"""
ORACLES["median_lengthscale"] = f"WITH {NX} SELECT {_r('median(list_distance(a.hn, b.hn))', 'lengthscale')} FROM pr a JOIN pr b ON a.k < b.k WHERE list_distance(a.hn, b.hn) > 0"
ORACLES["gram_dtw"] = f"""WITH RECURSIVE {NX}, pp AS (SELECT a.k AS i, b.k AS j, a.hn AS x, b.hn AS y FROM pr a, pr b),
dt(i, j, x, y, s, prev) AS (SELECT i, j, x, y, 0, list_concat([0.0::DOUBLE], list_transform(y, lambda v: 'inf'::DOUBLE)) FROM pp
  UNION ALL SELECT i, j, x, y, s + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [pow(x[s + 1] - y[q], 2), least(prev[q], prev[q + 1])]),
    lambda acc, e: list_append(acc, e[1] + least(e[2], acc[len(acc)])), ['inf'::DOUBLE]) FROM dt WHERE s < len(x))
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r('exp(-prev[len(prev)] / 200)', 'value')} FROM dt WHERE s = len(x)"""
ORACLES["gram_patches"] = f"""WITH {NX}, pa AS (SELECT k, u, hn[u * 2 + 1:u * 2 + 8] AS p FROM (SELECT k, hn, unnest(range((len(hn) - 8) // 2 + 1)) AS u FROM pr))
SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_r('sum(exp(-pow(list_distance(a.p, b.p), 2) / 18))', 'value')} FROM pa a JOIN pa b ON a.u = b.u GROUP BY 1, 2"""


_RBF = "exp(-pow(list_distance(a.hn, b.hn), 2) / 200)"


def _krr(train: str, group: str = "0", kernel: str = _RBF, source: str = NX) -> str:
    """CTEs up to ``al`` (gr, k, hn, ms, alpha): Gauss-Jordan elimination of [G + gamma I | Y] by group."""
    return f"""WITH RECURSIVE {source}, tr AS ({train}), ti AS (SELECT {group} AS gr, row_number() OVER (PARTITION BY {group} ORDER BY k) AS i, * FROM tr),
gm AS (SELECT a.gr, a.i, list({kernel} + CASE WHEN a.i = b.i THEN 0.01 ELSE 0 END ORDER BY b.i) AS r FROM ti a JOIN ti b ON a.gr = b.gr GROUP BY 1, 2),
m0 AS (SELECT gr, list(list_concat(r, fn) ORDER BY i) AS m FROM gm JOIN ti USING (gr, i) GROUP BY 1),
gj(gr, s, m) AS (SELECT gr, 1, m FROM m0 UNION ALL SELECT gr, s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / r[s]) ELSE list_transform(r, lambda v, j: v - r[s] * m[s][j] / m[s][s]) END)
  FROM gj WHERE s <= len(m)),
al AS (SELECT ti.*, m[ti.i][len(m) + 1:] AS alpha FROM gj JOIN ti USING (gr) WHERE s = len(m) + 1)"""


_TRAIN = "SELECT * FROM pr WHERE k % 5 <> 0"
_SCORES = """,
cr AS (SELECT b.gr, a.k, p, sum({kernel} * b.alpha[p]) AS yn FROM te a JOIN (SELECT *, unnest(range(1, 13)) AS p FROM al) b ON {on} GROUP BY 1, 2, 3),
ye AS (SELECT gr, k, list(mu + sd * yn ORDER BY p) AS y FROM cr JOIN pr USING (k) GROUP BY 1, 2),
sr AS (SELECT ye.gr, pr.k, name, domain, sqrt(list_avg(list_transform(list_zip(f, y), lambda e: pow(e[1] - e[2], 2)))) AS rmse, sqrt(list_avg(list_transform(f, lambda v: v * v))) AS size,
  list_avg(list_transform(list_zip(f, y), lambda e: abs(e[1] - e[2]))) AS mae, list_avg(list_transform(range(2, len(h) + 1), lambda i: abs(h[i] - h[i - 1]))) AS step FROM ye JOIN pr USING (k)),
sc AS (SELECT *, CASE WHEN size > 1e-12 THEN rmse / size ELSE 0 END AS relative_rmse, CASE WHEN step > 1e-12 THEN mae / step ELSE 0 END AS mase FROM sr)"""


def _scored(train: str = _TRAIN, group: str = "0", te: str = "SELECT * FROM pr WHERE k % 5 = 0", on: str = "true", kernel: str = _RBF, source: str = NX) -> str:
    return _krr(train, group, kernel, source) + f", te AS ({te})" + _SCORES.replace("{on}", on).replace("{kernel}", kernel)


_S3 = ", ".join(_r(c, c) for c in ("rmse", "relative_rmse", "mase"))
ORACLES["krr_fit_alpha"] = _krr(_TRAIN) + " " + _long("al", "alpha")
ORACLES["krr_conjugate_gradients"] = _krr(_TRAIN) + " " + _long("al", "alpha")
ORACLES["krr_rbf_forecast"] = _scored() + f" SELECT name, domain, {_S3} FROM sc"
_SUMMARY = ", ".join(_r(e, n) for e, n in (("avg(rmse)", "mean_rmse"), ("avg(relative_rmse)", "mean_rel_rmse"), ("median(relative_rmse)", "median_rel_rmse"), ("avg(mase)", "mean_mase"), ("median(mase)", "median_mase")))
ORACLES["krr_summary"] = _scored() + f" SELECT count(*) AS n_test, {_SUMMARY} FROM sc"
ORACLES["run_all_domains"] = _scored("SELECT * FROM pr WHERE k < 20", "domain", "SELECT * FROM pr WHERE k >= 20", "a.domain = b.gr") + f" SELECT name, domain, {_S3} FROM sc"
ORACLES["scaling_study"] = _scored("SELECT * FROM (SELECT pr.*, row_number() OVER (ORDER BY k) AS rk FROM pr WHERE k % 5 <> 0) JOIN (SELECT unnest([5, 10, 20]) AS n) ON rk <= n", "n") + f" SELECT CAST(gr AS BIGINT) AS n_train, {_r('avg(rmse)', 'mean_rmse')}, {_r('avg(mase)', 'mean_mase')} FROM sc GROUP BY 1"

#: Kernels by masks ``ms``: of all pairs of places, those that both sides observe.
_D2 = "list_sum(list_transform(range(1, len(a.hn) + 1), lambda p: a.ms[p] * b.ms[p] * pow(a.hn[p] - b.hn[p], 2)))"
_SEEN = "list_inner_product(a.ms, b.ms)"
_MASKED = f"CASE WHEN {_SEEN} > 0 THEN exp(-({_D2} / (2 * greatest({_SEEN}, 1)) + 0.01 * (len(a.hn) - {_SEEN}))) ELSE 0 END"
_WITH_MASKS = NX.replace("pr AS (SELECT *,", "p0 AS (SELECT *,") + ", ob AS (SELECT k, list(CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY t) AS ms FROM hl GROUP BY 1), pr AS (SELECT p0.*, ms FROM p0 JOIN ob USING (k))"
ORACLES["masked_domains"] = _scored("SELECT * FROM pr WHERE k < 20", "domain", "SELECT * FROM pr WHERE k >= 20", "a.domain = b.gr", _MASKED, _WITH_MASKS) + f" SELECT name, domain, {_S3} FROM sc"
#: zeros and constant runs of five or more of the cleaned history
_RUNS = NX.replace("pr AS (SELECT *,", "p0 AS (SELECT *,") + """, rn AS (SELECT k, t, v, sum(c) OVER (PARTITION BY k ORDER BY t) AS r FROM (SELECT k, t, v, CASE WHEN v <> lag(v) OVER (PARTITION BY k ORDER BY t) THEN 1 ELSE 0 END AS c FROM hc)),
ob AS (SELECT k, list(CASE WHEN v = 0 OR n >= 5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END ORDER BY t) AS ms FROM (SELECT *, count(*) OVER (PARTITION BY k, r) AS n FROM rn) GROUP BY 1), pr AS (SELECT p0.*, ms FROM p0 JOIN ob USING (k))"""
ORACLES["krr_masked_forecast"] = _scored(kernel=_MASKED, source=_RUNS) + f" SELECT name, {_S3} FROM sc"
_MEDIANS = NX.replace("pr AS (SELECT *,", "p0 AS (SELECT *,") + """, md AS (SELECT a.domain, median(list_distance(a.hn, b.hn)) AS ell FROM p0 a JOIN p0 b ON a.domain = b.domain AND a.k < b.k AND a.k < 20 AND b.k < 20 WHERE list_distance(a.hn, b.hn) > 0 GROUP BY 1),
pr AS (SELECT p0.*, ell FROM p0 JOIN md USING (domain))"""
ORACLES["domain_models"] = _scored("SELECT * FROM pr WHERE k < 20", "domain", "SELECT * FROM pr WHERE k >= 20", "a.domain = b.gr", "exp(-pow(list_distance(a.hn, b.hn), 2) / (2 * a.ell * a.ell))", _MEDIANS) + f""" SELECT sc.domain, 'nation_month' AS config, 'RBF' AS kernel,
  any_value(t.n) AS n_train, {_r('any_value(t.ell)', 'lengthscale')}, {_r('0.01', 'gamma')}, count(*) AS n_test, {_SUMMARY} FROM sc JOIN (SELECT domain, count(*) AS n, any_value(ell) AS ell FROM tr GROUP BY 1) t USING (domain) GROUP BY 1"""
#: suppliers' chunks of 300 weeks and 12, their last 60 for training; nations' last 60 months
_PRETRAIN = f"""{NX.replace('st AS (SELECT *,', 's0 AS (SELECT *,').replace('FROM ex),', 'FROM (SELECT k, name, domain, h[len(h) - 59:] AS h, f, h_nans, f_nans FROM ex)),').replace('pr AS (SELECT *,', 'p0 AS (SELECT *,').replace('FROM st)', 'FROM s0)')}, {SW.replace('sc AS', 'wc AS').replace('FROM sc', 'FROM wc').replace('JOIN sc', 'JOIN wc').replace('sc.', 'wc.')},
c0 AS (SELECT k, x, unnest(range(0, len(x) - 311, 300)) AS start FROM sx), c1 AS (SELECT k, x[start + 241:start + 300] AS h, x[start + 301:start + 312] AS f FROM c0),
c2 AS (SELECT *, list_avg(h) AS mu, CASE WHEN list_stddev_pop(h) < 1e-8 THEN 1.0 ELSE list_stddev_pop(h) END AS sd FROM c1),
pt AS (SELECT k, list_transform(h, lambda v: (v - mu) / sd) AS hn, list_transform(f, lambda v: (v - mu) / sd) AS fn FROM c2),
pr AS (SELECT * FROM p0)"""
ORACLES["pretrain_eval"] = _scored("SELECT * FROM pt", te="SELECT * FROM pr", source=_PRETRAIN) + f" SELECT name, {_S3} FROM sc"

NAIVE = NX + """,
nv AS (SELECT k, name, domain, h, f, h[len(h)] AS y FROM pr),
sr AS (SELECT *, sqrt(list_avg(list_transform(f, lambda v: pow(v - y, 2)))) AS rmse, sqrt(list_avg(list_transform(f, lambda v: v * v))) AS size,
  list_avg(list_transform(f, lambda v: abs(v - y))) AS mae, list_avg(list_transform(range(2, len(h) + 1), lambda i: abs(h[i] - h[i - 1]))) AS step FROM nv),
sc AS (SELECT *, CASE WHEN size > 1e-12 THEN rmse / size ELSE 0 END AS relative_rmse, CASE WHEN step > 1e-12 THEN mae / step ELSE 0 END AS mase FROM sr)"""
ORACLES["forecast_metrics"] = f"WITH {NAIVE} SELECT k, {_S3} FROM sc"
ORACLES["domain_summary"] = f"WITH {NAIVE} SELECT domain, count(*) AS n_test, {_SUMMARY} FROM sc GROUP BY 1"
ORACLES["compare_domains"] = f"WITH {NAIVE} SELECT domain, count(*) AS n, {_r('min(mase)', 'lo')}, {_r('quantile_cont(mase, 0.25)', 'q1')}, {_r('median(mase)', 'median')}, {_r('quantile_cont(mase, 0.75)', 'q3')}, {_r('max(mase)', 'hi')} FROM sc GROUP BY 1"
ORACLES["residual_steps"] = f"WITH {NAIVE} SELECT k, step, {_r('y', 'predicted')}, {_r('v - y', 'residual')} FROM (SELECT k, y, unnest(range(len(f))) AS step, unnest(f) AS v FROM nv)"
ORACLES["split_complement"] = "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END AS level FROM nation"
ORACLES["histogram_50"] = f"""WITH {UE}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM ue), c AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM ue, b WHERE v IS NOT NULL GROUP BY 1)
SELECT g.bin, {_r('lo + (hi - lo) / 50 * g.bin', 'lo')}, {_r('lo + (hi - lo) / 50 * (g.bin + 1)', 'hi')}, coalesce(c.n, 0) AS n FROM b, (SELECT unnest(range(50)) AS bin) g LEFT JOIN c ON c.bin = g.bin"""
ORACLES["series_plot"] = f"""WITH {NX} SELECT k, t, part, {_r('v', 'v')} FROM (SELECT k, unnest(range(-24, 0)) AS t, 'history' AS part, unnest(h[len(h) - 23:]) AS v FROM pr UNION ALL SELECT k, unnest(range(len(f))), 'future', unnest(f) FROM pr)"""
ORACLES["max_series"] = "SELECT r_name AS domain, CAST(n_nationkey AS BIGINT) AS sample_idx, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) <= 3"

# -- time kernels: contexts of 12 months --
BANK = NL + """,
tl AS (SELECT k, name, t, v, n - 12 AS n FROM nl WHERE t < n - 12), cx AS (SELECT k, t, v FROM tl WHERE t >= n - 12), fu AS (SELECT k, t, v FROM nl WHERE t >= n - 12),
lo AS """ + ROBUST.replace("{source}", "cx") + """,
tz AS (SELECT tl.k, t, asinh((v - loc) / greatest(scale, 1e-8)) AS v FROM tl JOIN lo USING (k)), cz AS (SELECT cx.k, t, asinh((v - loc) / greatest(scale, 1e-8)) AS v FROM cx JOIN lo USING (k)),
fz AS (SELECT fu.k, t, asinh((v - loc) / greatest(scale, 1e-8)) AS v FROM fu JOIN lo USING (k)),""" + _cleaned("tz", "tf") + "," + _cleaned("cz", "cf") + "," + _cleaned("fz", "ff") + """,
tx AS (SELECT k, list(v ORDER BY t) AS x, count(*) AS n FROM tf GROUP BY 1), xs AS (SELECT k, list(v ORDER BY t) AS x FROM cf GROUP BY 1), ys AS (SELECT k, list(v ORDER BY t) AS y, list(g IS NOT NULL ORDER BY t) AS seen FROM ff GROUP BY 1),
ta AS (SELECT DISTINCT k, n - 12 AS most, CASE WHEN p = 11 THEN n - 12 ELSE CAST(floor(p * (CAST(n - 12 AS DOUBLE) / 11)) AS BIGINT) END AS tau FROM tx, (SELECT unnest(range(12)) AS p) q)"""
BABY = BANK + """,
ch AS (SELECT tx.k, tau, p, x[n - 12 - tau + p + 1] * exp(-pow(p / 11.0::DOUBLE - greatest(0, least(1, tau / CAST(greatest(most, 1) AS DOUBLE))), 2)) AS w FROM tx JOIN ta USING (k), (SELECT unnest(range(12)) AS p) q),
bb AS (SELECT a.k, a.p AS r, b.p AS c, avg(a.w * b.w) AS value FROM ch a JOIN ch b ON a.k = b.k AND a.tau = b.tau GROUP BY 1, 2, 3),
mm AS (SELECT r, c, avg(value) AS value FROM bb GROUP BY 1, 2)"""
_JORDAN = "SELECT {keep}s + 1, list_transform(m, lambda r, i: CASE WHEN i = s THEN list_transform(r, lambda v: v / r[s]) ELSE list_transform(r, lambda v, j: v - r[s] * m[s][j] / m[s][s]) END)"
INVERSE = BABY + """,
i0 AS (SELECT list(list_concat(row, list_transform(range(12), lambda j: CASE WHEN j = r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) ORDER BY r) AS m FROM (SELECT r, list(value + CASE WHEN r = c THEN 0.1 ELSE 0 END ORDER BY c) AS row FROM mm GROUP BY 1)),
ij(s, m) AS (SELECT 1, m FROM i0 UNION ALL """ + _JORDAN.replace("{keep}", "") + """ FROM ij WHERE s <= 12),
iv AS (SELECT list_transform(m, lambda r: r[13:]) AS m FROM ij WHERE s = 13),
ux AS (SELECT k, x, list_transform(m, lambda r: list_inner_product(r, x)) AS u FROM xs, iv)"""
ORACLES["support_bank_summary"] = f"""WITH {BANK} SELECT name, len(xs.x) AS context_length, len(y) AS horizon_length, {_r('(SELECT 100.0 * (count(*) - count(v)) / count(*) FROM cx WHERE cx.k = xs.k)', 'context_missing_pct')},
{_r('100.0 * len(list_filter(seen, lambda b: NOT b)) / len(y)', 'future_missing_pct')}, {_r('loc', 'loc')}, {_r('scale', 'scale')} FROM xs JOIN ys USING (k) JOIN lo USING (k) JOIN (SELECT DISTINCT k, name FROM tl) USING (k)"""
ORACLES["tau_array"] = f"WITH {BANK} SELECT k, row_number() OVER (PARTITION BY k ORDER BY tau) - 1 AS p, tau FROM ta"
ORACLES["baby_kernel"] = f"WITH {BABY} SELECT k, r, c, {_r('value', 'value')} FROM bb"
ORACLES["mama_kernel"] = f"WITH {BABY} SELECT r, c, {_r('value', 'value')} FROM mm"
ORACLES["gamma_gram"] = f"WITH RECURSIVE {INVERSE} SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_r('list_inner_product(a.x, b.u)', 'value')} FROM ux a, ux b"
ORACLES["context_energy"] = f"WITH RECURSIVE {INVERSE} SELECT k, {_r('sum(u[r + 1] * value * u[c + 1])', 'energy')} FROM ux JOIN bb USING (k) GROUP BY 1"
ORACLES["gamma_predict"] = f"""WITH RECURSIVE {INVERSE}, st AS (SELECT unnest(range(1, 13)) AS p),
so AS (SELECT p, k, x, u, y[p] AS y, row_number() OVER (PARTITION BY p ORDER BY k) AS i FROM ux JOIN ys USING (k), st WHERE k % 5 <> 0 AND seen[p]),
sg AS (SELECT a.p, a.i, list(list_inner_product(a.x, b.u) + CASE WHEN a.i = b.i THEN 0.1 ELSE 0 END ORDER BY b.i) AS r FROM so a JOIN so b ON a.p = b.p GROUP BY 1, 2),
s0 AS (SELECT p, list(list_append(r, y) ORDER BY i) AS m FROM sg JOIN so USING (p, i) GROUP BY 1),
sj(p, s, m) AS (SELECT p, 1, m FROM s0 UNION ALL {_JORDAN.replace('{keep}', 'p, ')} FROM sj WHERE s <= len(m)),
sa AS (SELECT p, so.k, so.u, m[so.i][len(m) + 1] AS alpha FROM sj JOIN so USING (p) WHERE s = len(m) + 1),
gp AS (SELECT q.k, st.p, coalesce(sum(list_inner_product(q.x, sa.u) * sa.alpha), 0.0) AS z FROM ux q JOIN st ON q.k % 5 = 0 LEFT JOIN sa ON sa.p = st.p GROUP BY 1, 2)
SELECT k, p - 1 AS t, {_r('loc + scale * sinh(z)', 'v')} FROM gp JOIN lo USING (k)"""

# -- draws by md5, and the smaller reports --


def _draw(*names: str) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(names) + ")), 1, 8))::BIGINT"


ORACLES["split_random"] = f"SELECT k, CASE WHEN r <= 5 THEN 0.0::DOUBLE ELSE 0.35::DOUBLE END AS level FROM (SELECT n_nationkey AS k, row_number() OVER (ORDER BY {_draw('1', 'n_nationkey')}, n_nationkey) AS r FROM nation)"
_UNIFORM = lambda salt: "((" + _draw("concat_ws('|', k, '1 0 False 0')", "i - 1", salt) + " + 0.5) / 4294967296.0::DOUBLE)"
ORACLES["jitter_noise"] = f"""WITH {NX}, a AS (SELECT k, hn, CASE WHEN list_stddev_pop(hn) * 0.05 < 1e-12 THEN 0.05 ELSE list_stddev_pop(hn) * 0.05 END AS s, unnest(range(1, len(hn) + 1)) AS i FROM pr),
b AS (SELECT k, list(hn[i] + s * sqrt(-2 * ln({_UNIFORM('1')})) * cos(6.283185307179586 * {_UNIFORM('2')}) ORDER BY i) AS h FROM a GROUP BY 1),
c AS (SELECT k, h, list_avg(h) AS m, CASE WHEN list_stddev_pop(h) < 1e-8 THEN 1.0 ELSE list_stddev_pop(h) END AS d FROM b)
""" + _long("c", "list_transform(h, lambda v: (v - m) / d)")


def _chunks(source: str, *names: str) -> str:
    """Recursive CTE ``sp`` (k, sub, n, i, pos, h) over ``source`` (k, n, sub): steps of drawn histories from 60 to 120."""
    draw = lambda i, pos: f"60 + {_draw(*names, 'k', i)} % (greatest(60, least(120, n - ({pos}) - 12)) + 1 - 60)"
    return f"""sp(k, sub, n, i, pos, h) AS (SELECT k, sub, n, 0, 0, {draw('0', '0')} FROM {source} WHERE n >= 72
  UNION ALL SELECT k, sub, n, i + 1, pos + h, {draw('i + 1', 'pos + h')} FROM sp WHERE n - (pos + h) >= 72)"""


ORACLES["slice_seeded_chunks"] = f"""WITH RECURSIVE {SW}, so AS (SELECT k, len(x) AS n, '' AS sub FROM sx), {_chunks('so', '0')}
SELECT k, i AS chunk, CAST(pos AS INT) AS start, CAST(h AS INT) AS history_len, CAST(least(20, n - pos - h) AS INT) AS future_len FROM sp"""
ORACLES["slice_subsets"] = f"""WITH RECURSIVE {SW}, so AS (SELECT k, n, sub FROM (SELECT k, len(x) AS n, 'part' || (k % 3) AS sub, row_number() OVER (PARTITION BY k % 3 ORDER BY k) AS r FROM sx WHERE k % 3 IN (0, 2)) WHERE r <= 9), {_chunks('so', '5', 'sub')},
per AS (SELECT sub, k, count(*) AS n FROM sp GROUP BY 1, 2) SELECT coalesce(sub, 'TOTAL') AS subset, count(*) AS n_series, CAST(sum(n) AS BIGINT) AS n_chunks FROM per GROUP BY ROLLUP (sub)"""
_PIECE = lambda x, missing, seed: f"list_transform(range({missing}), lambda j: {x}[CAST((({_draw(f"concat_ws('|', k, '{seed}')", f'len({x})')} % (greatest(len({x}) - ({missing}), 0) + 1)) + j) % len({x}) AS INT) + 1])"
ORACLES["uniform_length_pad"] = f"WITH {NX}, a AS (SELECT k, list_concat({_PIECE('h', '80 - len(h)', 0)}, h) AS h, list_concat(f, {_PIECE('f', '20 - len(f)', 1)}) AS f FROM pr) " + _long("a", "list_concat(h, f)")
ORACLES["length_report"] = f"""WITH {SW}, o AS (SELECT s_suppkey AS k, count(sc.v) AS n FROM supplier LEFT JOIN sc ON sc.k = s_suppkey GROUP BY 1)
SELECT k % 4 AS part, count(*) AS n_before, count(*) FILTER (n >= 290) AS n_kept, count(*) FILTER (n < 290) AS n_dropped FROM o GROUP BY 1"""
ORACLES["load_range"] = "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey >= 10 AND c_custkey < 210"
ORACLES["train_future"] = f"WITH {NL} SELECT k, CAST(t - (n - 12) AS BIGINT) AS t, {_r('coalesce(v, 0.0)', 'v')} FROM nl WHERE t >= n - 12"
ORACLES["mask_sparsity"] = f"""WITH {NL}, z AS (SELECT k, domain, t, coalesce(v, 0.0) AS v FROM nl WHERE t < n - 12),
r AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY t) AS r FROM (SELECT *, CASE WHEN v <> lag(v) OVER (PARTITION BY k ORDER BY t) THEN 1 ELSE 0 END AS c FROM z)),
m AS (SELECT k, domain, CASE WHEN v = 0 OR count(*) OVER (PARTITION BY k, r) >= 2 THEN 0 ELSE 1 END AS m FROM r)
SELECT domain, bool_and(k <> 7) AS all_masked, {_r('1 - avg(m) FILTER (k <> 7)', 'sparsity')} FROM m GROUP BY 1"""
ORACLES["series_grid"] = ORACLES["series_plot"] + " WHERE k IN (3, 7, 11)"
ORACLES["predictions_plot"] = f"""WITH {NAIVE}, la AS (SELECT k, h, f, y, 'rRMSE ' || format('{{:.3f}}', relative_rmse) AS label FROM sc)
SELECT k, label, t, part, {_r('v', 'v')} FROM (SELECT k, label, unnest(range(-24, 0)) AS t, 'history' AS part, unnest(h[len(h) - 23:]) AS v FROM la UNION ALL SELECT k, label, unnest(range(len(f))), 'actual', unnest(f) FROM la
  UNION ALL SELECT k, label, unnest(range(12)), 'predicted', y FROM la)"""
ORACLES["support_bank"] = f"""WITH {NL}, tl AS (SELECT k, name, domain, t, v, n - 12 AS n FROM nl WHERE t < n - 12), cn AS (SELECT CAST(pow(2, floor(log2(max(n) - 6))) AS BIGINT) AS c FROM tl), cx AS (SELECT k, v FROM tl, cn WHERE t >= n - c),
lo AS {ROBUST.replace("{source}", "cx")}, nm AS (SELECT k, domain, row_number() OVER (PARTITION BY domain ORDER BY k) - 1 AS s FROM (SELECT DISTINCT k, domain FROM tl))
SELECT domain || '#series' || s AS name, domain = 'ASIA' AND s = 0 AS unseen, c AS context, c AS context_length, CAST(6 AS BIGINT) AS horizon_length, {_r('loc', 'loc')}, {_r('scale', 'scale')} FROM nm JOIN lo USING (k), cn"""

# -- whole tables: several blocks, bands and channels, solves and forecasts of any size -------------------

ORACLES["gram_self"] = f"WITH {EM} SELECT CAST(a.k AS BIGINT) AS i, CAST(b.k AS BIGINT) AS j, {_r('exp(-pow(list_distance(a.x, b.x), 2) / 1.28)', 'value')} FROM em a, em b"

_CHANGES = "list_concat([0.0::DOUBLE], list_transform(range(2, len({0}) + 1), lambda i: {0}[i] - {0}[i - 1]))"
ORACLES["gram_dtw_banded"] = f"""WITH RECURSIVE {NX}, pp AS (SELECT a.k AS i, b.k AS j, a.hn AS x, b.hn AS y, {_CHANGES.format("a.hn")} AS dx, {_CHANGES.format("b.hn")} AS dy FROM pr a, pr b),
dt(i, j, x, y, dx, dy, s, prev) AS (SELECT i, j, x, y, dx, dy, 0, list_concat([0.0::DOUBLE], list_transform(y, lambda v: 'inf'::DOUBLE)) FROM pp
  UNION ALL SELECT i, j, x, y, dx, dy, s + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [CASE WHEN abs(s + 1 - q) <= 6 THEN pow(x[s + 1] - y[q], 2) + pow(dx[s + 1] - dy[q], 2) ELSE 'inf'::DOUBLE END, least(prev[q], prev[q + 1])]),
    lambda acc, e: list_append(acc, e[1] + least(e[2], acc[len(acc)])), ['inf'::DOUBLE]) FROM dt WHERE s < len(x))
SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, {_r("exp(-prev[len(prev)] / 200)", "value")} FROM dt WHERE s = len(x)"""

ORACLES["kernel_scales"] = f"""WITH RECURSIVE {NX}, pp AS (SELECT a.domain, a.k AS i, b.k AS j, a.hn AS x, b.hn AS y FROM pr a JOIN pr b ON a.domain = b.domain AND a.k < b.k),
dt(domain, x, y, s, prev) AS (SELECT domain, x, y, 0, list_concat([0.0::DOUBLE], list_transform(y, lambda v: 'inf'::DOUBLE)) FROM pp
  UNION ALL SELECT domain, x, y, s + 1, list_reduce(list_transform(range(1, len(y) + 1), lambda q: [pow(x[s + 1] - y[q], 2), least(prev[q], prev[q + 1])]),
    lambda acc, e: list_append(acc, e[1] + least(e[2], acc[len(acc)])), ['inf'::DOUBLE]) FROM dt WHERE s < len(x)),
pd AS (SELECT domain, list_distance(x[u * 2 + 1:u * 2 + 8], y[u * 2 + 1:u * 2 + 8]) AS d FROM (SELECT *, unnest(range((len(x) - 8) // 2 + 1)) AS u FROM pp)),
mk AS (SELECT domain, sqrt(list_sum(list_transform(list_zip(x, y), lambda e: CASE WHEN e[1] <> 0 AND e[2] <> 0 THEN pow(e[1] - e[2], 2) ELSE 0 END))
  / greatest(list_sum(list_transform(list_zip(x, y), lambda e: CASE WHEN e[1] <> 0 AND e[2] <> 0 THEN 1.0::DOUBLE ELSE 0 END)), 1)) AS d FROM pp),
al AS (SELECT domain, 'rbf' AS kernel, list_distance(x, y) AS d FROM pp UNION ALL SELECT domain, 'masked_rbf', d FROM mk
  UNION ALL SELECT domain, 'dtw', sqrt(prev[len(prev)]) FROM dt WHERE s = len(x) UNION ALL SELECT domain, 'patches', d FROM pd)
SELECT domain, kernel, {_r("median(d)", "scale")} FROM al WHERE d > 0 GROUP BY 1, 2"""

# elimination row by row: a step's pivot row goes to all rows, and its column goes
ORACLES["krr_embeddings"] = f"""WITH RECURSIVE en AS (SELECT vec_id AS k, CAST(embedding AS DOUBLE[])[1:48] AS x, CAST(embedding AS DOUBLE[])[49:64] AS y, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
g0 AS (SELECT a.i, list(exp(-pow(list_distance(a.x, b.x), 2) / 1.28) + CASE WHEN a.i = b.i THEN 0.1 ELSE 0 END ORDER BY b.i) AS r FROM en a, en b GROUP BY 1),
el(s, i, r) AS (SELECT CAST(1 AS BIGINT), i, list_concat(r, y) FROM g0 JOIN en USING (i)
  UNION ALL SELECT s + 1, i, CASE WHEN i = s THEN list_transform(p[2:], lambda v: v / p[1]) ELSE list_transform(list_zip(r[2:], p[2:]), lambda e: e[1] - r[1] * e[2] / p[1]) END
  FROM (SELECT *, max(CASE WHEN i = s THEN r END) OVER () AS p FROM el) WHERE len(r) > 16)
SELECT k, CAST(t - 1 AS BIGINT) AS t, {_r("r[t]", "v")} FROM (SELECT k, r, unnest(range(1, 17)) AS t FROM el JOIN en USING (i) WHERE len(r) = 16)"""

_SUPPLIERS = SW.replace("coalesce(sc.v, 0.0) AS v", "sc.v") + ", nl AS (SELECT k, NULL AS name, NULL AS domain, CAST(t - lo AS BIGINT) AS t, CAST(hi - lo + 1 AS BIGINT) AS n, v FROM sl, sm)"
ORACLES["gamma_suppliers"] = ORACLES["gamma_predict"].replace(NL, _SUPPLIERS)

_SCORED_NAIVE = ORACLES["forecast_metrics"].rsplit(" SELECT k, ", 1)[0]
_BINS = """SELECT '{0}' AS part, '' AS label, g.bin, round(lo + (hi - lo) / 40 * g.bin, 6) + 0.0 AS lo, round(lo + (hi - lo) / 40 * (g.bin + 1), 6) + 0.0 AS hi, count(v.v) AS n, NULL AS value
  FROM (SELECT min(v) AS lo, max(v) AS hi FROM {1}) b, (SELECT unnest(range(40)) AS bin) g LEFT JOIN {1} v ON CAST(least(floor((v.v - lo) / ((hi - lo) / 40)), 39) AS BIGINT) = g.bin GROUP BY g.bin, lo, hi"""
ORACLES["evaluation_report"] = f"""{_SCORED_NAIVE}, ts AS (SELECT * FROM sc WHERE k % 5 = 0),
rs AS (SELECT v - y AS v FROM (SELECT y, unnest(f) AS v FROM ts)), rm AS (SELECT rmse AS v FROM ts),
av AS (SELECT m, avg(v) AS a, median(v) AS d, count(*) AS n FROM (SELECT unnest(['rmse', 'relative_rmse', 'mase']) AS m, unnest([rmse, relative_rmse, mase]) AS v FROM ts) GROUP BY 1)
SELECT 'summary' AS part, 'mean_' || m AS label, NULL::BIGINT AS bin, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, n, round(a, 6) + 0.0 AS value FROM av
UNION ALL SELECT 'summary', 'median_' || m, NULL, NULL, NULL, n, round(d, 6) + 0.0 FROM av
UNION ALL SELECT 'split', CASE WHEN n_nationkey % 5 = 0 THEN '0.0' ELSE '0.35' END, NULL, NULL, NULL, count(*), NULL FROM nation GROUP BY 2
UNION ALL {_BINS.format('residuals', 'rs')} UNION ALL {_BINS.format('rmse', 'rm')}
UNION ALL SELECT 'scores', CAST(k AS VARCHAR), NULL, round(rmse, 6) + 0.0, round(relative_rmse, 6) + 0.0, 1, round(mase, 6) + 0.0 FROM ts"""
ORACLES["chunk_numbers"] = f"WITH {SW}, s AS (SELECT k, unnest(range(0, len(x) - 79, 60)) AS start FROM sx) SELECT k, start, row_number() OVER (ORDER BY k, start) - 1 AS sample_idx FROM s"

ORACLES["nth_series"] = "SELECT CAST(n_nationkey AS BIGINT) AS sample_idx, n_name AS name FROM nation WHERE n_nationkey = 7"
_OWN_TAUS = BANK.replace("ta AS (SELECT DISTINCT", "t0 AS (SELECT DISTINCT") + ", ta AS (SELECT * FROM t0 WHERE k % 3 <> 0 UNION ALL SELECT k, k + 5, unnest([0, 3, k + 5]) FROM tx WHERE k % 3 = 0)" + BABY[len(BANK):]
ORACLES["baby_kernel_own_taus"] = f"WITH {_OWN_TAUS} SELECT k, r, c, {_r('value', 'value')} FROM bb"

_MODES = NX.replace("pr AS (SELECT *,", "p0 AS (SELECT *,") + _CWT.replace("{scales}", _LINEAR).replace("{x}", "hn").replace("{n}", "n").replace("FROM pr", "FROM p0").replace(", sc AS", ", sz AS").replace("FROM sc,", "FROM sz,") + """,
wl AS (SELECT k, t, sum(c) AS w FROM co GROUP BY 1, 2),
fe AS (SELECT k, list(v ORDER BY t, ch) AS z FROM (SELECT k, t, 0.0::DOUBLE AS ch, v FROM sg UNION ALL SELECT co.k, co.t, s, c * (sg.v / CASE WHEN abs(w) > 1e-12 THEN w ELSE 1 END)
  FROM co JOIN wl ON wl.k = co.k AND wl.t = co.t JOIN sg ON sg.k = co.k AND sg.t = co.t) GROUP BY 1),
pr AS (SELECT p0.* REPLACE (z AS hn) FROM p0 JOIN fe USING (k))"""
ORACLES["modes_forecast"] = _scored(source=_MODES) + f" SELECT name, domain, {_S3} FROM sc"

ORACLES["kernel_scales"] = ORACLES["kernel_scales"].replace(", pp AS (", _CWT.replace("{scales}", _GEOM).replace("{x}", "hn").replace("{n}", "n") + ", pp AS (", 1).replace(
    "SELECT domain, kernel,", """, wv AS (SELECT p.domain, a.k, b.k AS j, sqrt(sum(pow(a.c - b.c, 2))) AS d FROM co a JOIN co b ON a.s = b.s AND a.t = b.t AND a.k < b.k JOIN pr p ON p.k = a.k JOIN pr q ON q.k = b.k AND q.domain = p.domain GROUP BY 1, 2, 3)
SELECT domain, kernel,""").replace("FROM al WHERE", "FROM (SELECT * FROM al UNION ALL SELECT domain, 'wavelet', d FROM wv) WHERE")
ORACLES["frequency_match"] = f"WITH {SW} SELECT k, 'M' AS freq, len(x) AS weeks FROM sx WHERE k % 3 = 0"
