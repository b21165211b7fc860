"""Queries over series, each with its SQL twin."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.functions import families as fam
from driftcurve.functions.filters import WAVELETS, high_pass, low_pass, usable_levels
from driftcurve.operators import sequences as seq, series as ser, wavelets as wav
from driftcurve.plans import sql
from driftcurve.plans.sql import CURVES, SERIES, r6
from driftcurve.sources.curves import curves, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, twin: str | None = None):
    def put(f):
        QUERIES[name] = f
        if twin:
            SQL[name] = twin
        return f

    return put


def rounded(df: DataFrame, digits: int = 6, exact: tuple[str, ...] = ()) -> DataFrame:
    """Floating columns but `exact` ones rounded as the SQL twins round them."""
    return df.select(*(F.round(F.col(c) + 3e-10, digits).alias(c) if t in ("double", "float") and c not in exact else F.col(c) for c, t in df.dtypes))


def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.with_steps(ser.with_norm(curves(spark, sf_dir)))


@query(
    "scan_range_project",
    "SELECT event_id, user_id, value FROM events WHERE event_id >= 500 AND event_id < (SELECT least(2500, count(*)) FROM events)",
)
def scan_range_project(spark, sf_dir):
    from driftcurve.sources.tables import scan

    return scan(spark, f"{sf_dir}/events.parquet", columns=("event_id", "user_id", "value", "absent"), rows=(500, 2500), index="event_id")


@query(
    "curves_from_events",
    f"WITH {CURVES} SELECT id, any_value(class) AS class, count(*) AS npoints, {r6('arg_min(mjd, pos)', 'mjd_first')}, {r6('arg_max(mjd, pos)', 'mjd_last')}, {r6('arg_min(mag, pos)', 'mag_first')}, {r6('arg_max(mag, pos)', 'mag_last')}, {r6('list(mag ORDER BY pos)[(count(*) - 1) // 2 + 1]', 'mag_middle')} FROM curves GROUP BY id",
)
def curves_from_events(spark, sf_dir):
    nested = ser.implode_series(curves(spark, sf_dir), keep=("class",))
    n = F.size("mag")
    return rounded(
        nested.select(
            "id", "class", n.cast("bigint").alias("npoints"), F.get("mjd", F.lit(0)).alias("mjd_first"), F.get("mjd", n - 1).alias("mjd_last"), F.get("mag", F.lit(0)).alias("mag_first"), F.get("mag", n - 1).alias("mag_last"), F.get("mag", F.floor((n - 1) / 2).cast("int")).alias("mag_middle")
        )
    )


def _stats(x: str, entropy: bool = True):
    def run(spark, sf_dir):
        return rounded(fam.apply(full_series(spark, sf_dir), fam.main_stats(x, entropy=entropy)))

    return run


for _x in ("mag", "magerr", "norm", "velocity", "mjd_diff"):
    query(f"series_main_stats_{_x}", sql.main_stats(_x, _x != "norm"))(_stats(_x, _x != "norm"))


@query(
    "series_short_stats",
    sql.main_stats("mag", ctes="short AS (SELECT l_orderkey AS id, l_quantity AS mag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) - 1 AS pos FROM lineitem)", source="short"),
)
def series_short_stats(spark, sf_dir):
    """Series of 1 to a few points: order lines."""
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").cast("double").alias("mag"), "l_quantity", "l_shipdate", "l_linenumber", "l_partkey")
    lines = lines.withColumn("pos", (F.row_number().over(W.partitionBy("id").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_quantity")) - 1).cast("bigint"))
    return rounded(fam.apply(lines, fam.main_stats("mag")))


@query(
    "series_minmax_zscore",
    f"WITH {CURVES}, s AS (SELECT id, pos, CASE WHEN max(mag) OVER p = min(mag) OVER p THEN 0 ELSE (mag - min(mag) OVER p) / (max(mag) OVER p - min(mag) OVER p) END AS mm, (mag - avg(mag) OVER p) / nullif(stddev_samp(mag) OVER p, 0) AS zs FROM curves WINDOW p AS (PARTITION BY id)) "
    f"SELECT id, pos, {r6('mm', 'minmax')}, {r6('zs', 'zscore')} FROM s",
)
def series_minmax_zscore(spark, sf_dir):
    return rounded(curves(spark, sf_dir).select("id", "pos", ser.rescaled("mag", "minmax").alias("minmax"), ser.rescaled("mag", "zscore").alias("zscore")))


def _legacy_sql() -> str:
    parts, joins, outs = [], [], []
    for x in ("mag", "magerr", "norm"):
        parts.append(f"{x}_e AS (SELECT id, {x} AS x, {x} - avg({x}) OVER (PARTITION BY id) AS e, stddev_pop({x}) OVER (PARTITION BY id) AS sd FROM series)")
        parts.append(f"{x}_l AS (SELECT id, stddev_pop(x) AS std, CASE WHEN sum(e*e) > 0 THEN (sum(e*e*e) / count(*)) / pow(sum(e*e) / count(*), 1.5) END AS skewness, CASE WHEN sum(e*e) > 0 THEN (sum(e*e*e*e) / count(*)) / pow(sum(e*e) / count(*), 2) - 3 END AS kurtosis, avg(CAST(x < -3 * sd AS INTEGER)) AS frac_below_3sigma, max(x) - min(x) AS amplitude_sigma, avg(x) AS mean, median(x) AS median FROM {x}_e GROUP BY id)")
        joins.append(f"{x}_l")
        outs += [r6(f"{x}_l.{k}", f"{x}_{k}") for k in ("std", "skewness", "kurtosis", "frac_below_3sigma", "amplitude_sigma", "mean", "median")]
    return f"WITH {SERIES}, {', '.join(parts)} SELECT mag_l.id, {', '.join(outs)} FROM mag_l JOIN magerr_l USING (id) JOIN norm_l USING (id)"


@query("series_legacy_stats", _legacy_sql())
def series_legacy_stats(spark, sf_dir):
    return rounded(fam.apply(full_series(spark, sf_dir), *(fam.legacy_stats(x) for x in ("mag", "magerr", "norm"))))


@query("series_ts", f"WITH {CURVES} SELECT id, CAST(round(round((max(mjd) - 40587) * 86400000000) / 1000) AS BIGINT) * 1000 AS ts_us FROM curves GROUP BY id")
def series_ts(spark, sf_dir):
    """The last observation's time, back from its MJD, which keeps about a microsecond, and rounded to milliseconds."""
    last = curves(spark, sf_dir).groupBy("id").agg(F.max("mjd").alias("m"))
    return last.select("id", (F.round(F.unix_micros(ser.from_mjd(F.col("m"))) / 1000).cast("bigint") * 1000).alias("ts_us"))


_OUTLIERS = f"""WITH {CURVES}, q AS (SELECT id, quantile_cont(mag, 0.25) AS q1, quantile_cont(mag, 0.75) AS q3 FROM curves GROUP BY id),
o AS (SELECT c.*, (mag < q1 - 3 * (q3 - q1)) OR (mag > q3 + 3 * (q3 - q1)) AS out, lag(mag) OVER w AS before, lead(mag) OVER w AS after FROM curves c JOIN q USING (id) WINDOW w AS (PARTITION BY c.id ORDER BY c.pos)),
n AS (SELECT *, count(*) FILTER (out) OVER (PARTITION BY id) AS outs FROM o)
"""


@query("outlier_clean", _OUTLIERS + f"SELECT id, pos, {r6('CASE WHEN outs = 1 AND out THEN coalesce((before + after) / 2, before, after, mag) ELSE mag END', 'mag')}, outs = 1 AS had_od FROM n")
def outlier_clean(spark, sf_dir):
    return rounded(ser.clean_outlier(curves(spark, sf_dir), k=3.0).select("id", "pos", "mag", "had_od"))


@query("outlier_drop", _OUTLIERS + f"SELECT id, pos, {r6('mag', 'mag')} FROM n WHERE NOT (outs = 1 AND out)")
def outlier_drop(spark, sf_dir):
    return rounded(ser.drop_outlier(curves(spark, sf_dir), k=3.0).select("id", "pos", "mag"))


def _shape(x: str):
    def run(spark, sf_dir):
        return rounded(fam.apply(full_series(spark, sf_dir), fam.shape(x, times="mjd" if x == "norm" else None)))

    return run


for _x in ("norm", "mag", "velocity"):
    query(f"shape_{_x}", sql.shape(_x, _x == "norm"))(_shape(_x))


@query(
    "shape_fractions",
    f"WITH a AS ({sql.shape('norm', True)}), {CURVES}, c AS (SELECT id, count(*) AS npoints FROM curves GROUP BY id) SELECT id, "
    + ", ".join(r6(f"CAST(norm_{v} AS DOUBLE) / npoints", f"norm_{k}") for k, v in fam.FRACTIONS.items())
    + " FROM a JOIN c USING (id)",
)
def shape_fractions(spark, sf_dir):
    whole = fam.apply(full_series(spark, sf_dir), fam.shape("norm"), fam.Family([], [F.count("mag").alias("npoints")]))
    return rounded(fam.with_fractions(whole).select("id", *(f"norm_{k}" for k in fam.FRACTIONS)))


def _split(which: str):
    def run(spark, sf_dir):
        parts = [fam.split_stats(x, side, which, steps=x == "velocity") for x in ("mag", "norm", "velocity") for side in ("to", "from")]
        got = fam.apply(full_series(spark, sf_dir), *parts)
        return rounded(got.withColumns({c: F.round(F.col(c) + 3e-7, 2) for c in got.columns if c.endswith("_energy")}))

    return run


for _w in ("argmin", "argmax"):
    query(f"extremum_{_w}", sql.split(("mag", "norm", "velocity"), _w))(_split(_w))

_SMOOTH = "(coalesce(lag({0}) OVER w, {0}) + {0} + coalesce(lead({0}) OVER w, {0})) / 3"


@query(
    "seq_channels",
    f"""WITH {CURVES}, a AS (SELECT *, avg(mag) OVER p AS mu, stddev_pop(mag) OVER p AS sd, mjd - lag(mjd) OVER w AS dt, mag - lag(mag) OVER w AS dm, first_value(mjd) OVER (PARTITION BY id ORDER BY mag, pos) AS peak, {_SMOOTH.format("mag")} AS m3 FROM curves WINDOW w AS (PARTITION BY id ORDER BY pos), p AS (PARTITION BY id)),
b AS (SELECT *, (mag - m3) * (mag - m3) AS q FROM a), c AS (SELECT *, {_SMOOTH.format("q")} AS q3 FROM b WINDOW w AS (PARTITION BY id ORDER BY pos))
SELECT id, pos, {r6("CASE WHEN sd > 1e-8 THEN (mag - mu) / sd ELSE mag - mu END", "norm")}, coalesce(dm / CASE WHEN abs(dt) < 1e-10 THEN CAST(1e-10 AS DOUBLE) ELSE dt END, 0) AS vel, {r6("log10(pow(10.0, -0.4 * (mag - 27.5)))", "log_flux")},
{r6("log10(pow(10.0, -0.4 * (mag - 27.5)) * magerr * 0.4 * ln(10))", "log_flux_err")}, {r6("1 / greatest(magerr, 1e-6)", "snr")}, {r6("mjd - peak", "t_since_peak")}, {r6("sqrt(greatest(q3, 0))", "local_std")}, {r6("mag - m3", "detrended")} FROM c""",
)
def seq_channels(spark, sf_dir):
    """All channels; the fluxes span many orders of magnitude, so their logarithms are compared.

    Velocities are compared as they are: where time stands still they reach 1e12, whose sixth decimal no engine holds.
    """
    got = seq.with_channels(curves(spark, sf_dir), list(seq.CHANNELS))
    got = got.select("id", "pos", "norm", "vel", F.log10("flux").alias("log_flux"), F.log10("flux_err").alias("log_flux_err"), "snr", "t_since_peak", "local_std", "detrended")
    return rounded(got, exact=("vel",))


_PRE = f"""WITH {CURVES}, a AS (SELECT id, pos, coalesce(mjd - lag(mjd) OVER w, 0) / 10 AS mjd, mag, magerr, avg(mag) OVER p AS m1, stddev_pop(mag) OVER p AS s1, avg(magerr) OVER p AS m2, stddev_pop(magerr) OVER p AS s2 FROM curves WINDOW w AS (PARTITION BY id ORDER BY pos), p AS (PARTITION BY id)),
pre AS (SELECT id, pos, {r6("mjd", "mjd")}, {r6("CASE WHEN s1 > 1e-8 THEN (mag - m1) / s1 ELSE mag - m1 END", "mag")}, {r6("CASE WHEN s2 > 1e-8 THEN (magerr - m2) / s2 ELSE magerr - m2 END", "magerr")} FROM a)
"""


@query("seq_preprocess", _PRE + "SELECT * FROM pre")
def seq_preprocess(spark, sf_dir):
    return rounded(seq.preprocessed(curves(spark, sf_dir)).select("id", "pos", "mjd", "mag", "magerr"))


@query(
    "seq_stack_pad",
    _PRE + f"""SELECT id, count(*) AS length, (SELECT max(n) FROM (SELECT count(*) AS n FROM pre GROUP BY id)) AS padded_length,
{r6("sum(mag * (pos + 1))", "mag_by_place")}, {r6("arg_max(mag, pos)", "last_mag")} FROM pre GROUP BY id""",
)
def seq_stack_pad(spark, sf_dir):
    """Stacked and padded, then read back: lengths, a sum weighted by place, the last true point."""
    rows = rounded(seq.preprocessed(curves(spark, sf_dir)).select("id", "pos", "mjd", "mag", "magerr"))
    got = seq.padded(seq.stacked(rows, ("mjd", "mag", "magerr"), "double"), 3)
    weighted = F.aggregate(F.transform("sequence", lambda v, i: v[1] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(got.select("id", "length", F.size("sequence").cast("bigint").alias("padded_length"), weighted.alias("mag_by_place"), F.get(F.get("sequence", F.col("length").cast("int") - 1), F.lit(1)).alias("last_mag")))


@query(
    "resample_grid",
    f"""WITH {SERIES}, span AS (SELECT id, min(mjd) AS low, max(mjd) AS high FROM series GROUP BY id), pairs AS (SELECT id, mjd AS t0, norm AS x0, lead(mjd) OVER w AS t1, lead(norm) OVER w AS x1 FROM series WINDOW w AS (PARTITION BY id ORDER BY pos)),
grid AS (SELECT id, k, low, high, low + k * ((high - low) / 63) AS t FROM span, range(64) g(k) WHERE high > low)
SELECT g.id, g.k, {r6("any_value(g.t)", "t")}, {r6("max_by(CASE WHEN g.t >= g.high THEN p.x1 ELSE p.x0 + (g.t - p.t0) / (p.t1 - p.t0) * (p.x1 - p.x0) END, p.t0)", "x")} FROM grid g JOIN pairs p ON p.id = g.id AND p.t1 > p.t0 AND ((g.t > p.t0 AND g.t <= p.t1) OR (g.k = 0 AND p.t0 = g.low) OR (g.k = 63 AND p.t1 = g.high)) GROUP BY g.id, g.k""",
)
def resample_grid(spark, sf_dir):
    return rounded(wav.resampled(ser.with_norm(curves(spark, sf_dir))))


def _points(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return rows


def _taps(w: str) -> str:
    pairs = ", ".join(f"({j}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for j, (a, b) in enumerate(zip(low_pass(w), high_pass(w), strict=True)))
    return f"(VALUES {pairs}) f(j, lo, hi)"


def _level_sql(w: str, source: str, n: str = "n") -> str:
    """One level, output by output: tap F - 1 - j meets the signal at 2 k + 2 - F + j, reflected."""
    taps = len(low_pass(w))
    at = f"(((2 * k + 2 - {taps} + ({taps} - 1 - j)) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"""SELECT o.id, o.k AS pos, sum(s.x * o.lo) AS x, sum(s.x * o.hi) AS detail FROM (SELECT id, k, lo, hi, CASE WHEN {at} < {n} THEN {at} ELSE 2 * {n} - 1 - {at} END AS at FROM (SELECT id, count(*) AS n FROM {source} GROUP BY id) c, {_taps(w)}, range(100) g(k) WHERE k < (n + {taps} - 1) // 2) o JOIN {source} s ON s.id = o.id AND s.pos = o.at GROUP BY o.id, o.k"""


_SIGNAL = "signal AS (SELECT vec_id AS id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query("dwt_haar_level1", f"WITH {_SIGNAL}, l AS ({_level_sql('haar', 'signal')}) SELECT id, pos AS k, {r6('x', 'approx')}, {r6('detail', 'detail')} FROM l")
def dwt_haar_level1(spark, sf_dir):
    return rounded(wav.dwt_level(_points(spark, sf_dir), "haar"))


@query(
    "dwt_level1_all",
    f"WITH {_SIGNAL}, " + ", ".join(f"l_{w} AS ({_level_sql(w, 'signal')})" for w in WAVELETS) + " " + " UNION ALL ".join(f"SELECT '{w}' AS wavelet, id, count(*) AS n, {r6('sum(x * x)', 'approx_energy')}, {r6('sum(detail * detail)', 'detail_energy')}, {r6('max(abs(detail))', 'max_detail')} FROM l_{w} GROUP BY id" for w in WAVELETS),
)
def dwt_level1_all(spark, sf_dir):
    got = wav.dwt_levels(_points(spark, sf_dir)).groupBy("wavelet", "id")
    return rounded(got.agg(F.count("*").alias("n"), wav.energy("approx").alias("approx_energy"), wav.energy("detail").alias("detail_energy"), F.max(F.abs("detail")).alias("max_detail")))


#: Filters beside the five fixed ones, computed when they are first asked for.
CUSTOM = ("db2", "db10", "sym8", "coif2")


@query(
    "dwt_level1_custom",
    f"WITH {_SIGNAL}, " + ", ".join(f"l_{w} AS ({_level_sql(w, 'signal')})" for w in CUSTOM) + " " + " UNION ALL ".join(f"SELECT '{w}' AS wavelet, id, count(*) AS n, {r6('sum(x * x)', 'approx_energy')}, {r6('sum(detail * detail)', 'detail_energy')}, {r6('max(abs(detail))', 'max_detail')} FROM l_{w} GROUP BY id" for w in CUSTOM),
)
def dwt_level1_custom(spark, sf_dir):
    got = wav.dwt_levels(_points(spark, sf_dir), CUSTOM).groupBy("wavelet", "id")
    return rounded(got.agg(F.count("*").alias("n"), wav.energy("approx").alias("approx_energy"), wav.energy("detail").alias("detail_energy"), F.max(F.abs("detail")).alias("max_detail")))


def _haar_levels() -> str:
    ctes, unions = [_SIGNAL], []
    source = "signal"
    for k in range(1, 6):
        ctes.append(f"h{k} AS ({_level_sql('haar', source)})")
        source = f"h{k}"
        unions.append(f"SELECT id, {6 - k} AS level, detail AS d FROM h{k}")
    ctes.append("d AS (SELECT *, avg(d) OVER (PARTITION BY id, level) AS mu, median(d) OVER (PARTITION BY id, level) AS mid, stddev_pop(d) OVER (PARTITION BY id, level) AS sd FROM (" + " UNION ALL ".join(unions) + "))")
    return "WITH " + ", ".join(ctes) + f" SELECT id, level, {r6('sum(d * d)', 'energy')}, {r6('avg(d)', 'mean')}, {r6('stddev_pop(d)', 'std')}, {r6('avg(abs(d - mid))', 'mad')}, {r6('avg(CASE WHEN sd > 1e-10 AND abs(d) > 2 * sd THEN 1.0 ELSE 0.0 END)', 'frac_above_2std')} FROM d GROUP BY id, level"


@query("dwt_haar_energy_levels", _haar_levels())
def dwt_haar_energy_levels(spark, sf_dir):
    """Five levels by the kernel, against chained joins in SQL."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    got = wav.wavelet_features(rows, "embedding", None, ("haar",), 5, "")
    keep = ("energy", "mean", "std", "mad", "frac_above_2std")
    level = lambda i: F.struct(F.lit(i).alias("level"), *(F.col(f"wv_haar_d{i}_{k}").alias(k) for k in keep))
    return rounded(got.select("id", F.inline(F.array(*(level(i) for i in range(1, 6))))))


#: Points of the signals in `embeddings`.
SIGNAL_POINTS = 64


def _chain(w: str) -> tuple[list[str], int]:
    """Chained levels of one filter as CTEs: c_w_1, c_w_2 ... and how many there are."""
    n = max(1, min(5, usable_levels(SIGNAL_POINTS, w)))
    return [f"c_{w}_{k} AS ({_level_sql(w, 'signal' if k == 1 else f'c_{w}_{k - 1}')})" for k in range(1, n + 1)], n


def _globals_sql() -> str:
    """The six global statistics of each filter's decomposition."""
    ctes, outs = [_SIGNAL], []
    for w in WAVELETS:
        own, n = _chain(w)
        ctes += own
        levels = " UNION ALL ".join(f"SELECT id, {n + 1 - k} AS level, detail AS d FROM c_{w}_{k}" for k in range(1, n + 1))
        ctes.append(f"e_{w} AS (SELECT id, level, sum(d * d) AS energy, max(abs(d)) AS top FROM ({levels}) GROUP BY id, level)")
        ctes.append(f"a_{w} AS (SELECT id, sum(x * x) AS rough FROM c_{w}_{n} GROUP BY id)")
        ctes.append(f"t_{w} AS (SELECT id, any_value(rough) AS rough, sum(energy) AS detail, max(top) AS top, arg_max(level, (energy, -level)) AS dominant, max(energy) AS most FROM e_{w} JOIN a_{w} USING (id) GROUP BY id)")
        ctes.append(f"p_{w} AS (SELECT id, energy / (rough + detail + 1e-10) AS p FROM e_{w} JOIN t_{w} USING (id))")
        ctes.append(f"h_{w} AS (SELECT id, -sum(CASE WHEN p > 1e-10 THEN p * ln(p + 1e-10) ELSE 0 END) AS entropy FROM p_{w} GROUP BY id)")
        outs.append(
            f"SELECT '{w}' AS wavelet, id, {r6('rough + detail', 'total_energy')}, {r6('detail / (rough + detail + 1e-10)', 'detail_ratio')}, {r6('top', 'max_detail')}, {r6('entropy', 'entropy')}, "
            f"{r6('detail / (rough + 1e-10)', 'detail_approx_ratio')}, CAST(CASE WHEN most > 0 THEN dominant ELSE 0 END AS DOUBLE) AS dominant_level FROM t_{w} JOIN h_{w} USING (id)"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(outs)


@query("dwt_globals", _globals_sql())
def dwt_globals(spark, sf_dir):
    """The global statistics of all filters by the kernel, against chained joins in SQL."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    got = wav.wavelet_features(rows, "embedding", None, WAVELETS, 5, "")
    one = lambda w: F.struct(F.lit(w).alias("wavelet"), *(F.col(f"wv_{w}_{k}").alias(k) for k in wav.GLOBALS))
    out = rounded(got.select("id", F.inline(F.array(*map(one, WAVELETS)))))
    return out.withColumn("dominant_level", F.round("dominant_level", 0))


def _moments_sql() -> str:
    """Relative energy, skewness and kurtosis of each level of each filter."""
    ctes, outs = [_SIGNAL], []
    for w in WAVELETS:
        own, n = _chain(w)
        ctes += own
        levels = " UNION ALL ".join(f"SELECT id, {n + 1 - k} AS level, detail AS d FROM c_{w}_{k}" for k in range(1, n + 1))
        ctes.append(f"d_{w} AS (SELECT *, d - avg(d) OVER (PARTITION BY id, level) AS e FROM ({levels}))")
        ctes.append(f"s_{w} AS (SELECT id, level, sum(d * d) AS energy, avg(e * e) AS v, avg(e * e * e) AS e3, avg(e * e * e * e) AS e4, count(*) AS n FROM d_{w} GROUP BY id, level)")
        ctes.append(f"z_{w} AS (SELECT id, sum(energy) AS detail FROM s_{w} GROUP BY id)")
        ctes.append(f"r_{w} AS (SELECT id, sum(x * x) AS rough FROM c_{w}_{n} GROUP BY id)")
        skew = "CASE WHEN n > 1 AND sqrt(v) > 1e-10 THEN e3 / pow(sqrt(v), 3) ELSE 0 END"
        outs.append(f"SELECT '{w}' AS wavelet, id, level, {r6('energy / (detail + rough + 1e-10)', 'rel_energy')}, {r6(skew, 'skewness')}, {r6('CASE WHEN n > 1 AND v > 1e-10 THEN e4 / (v * v) - 3 ELSE 0 END', 'kurtosis')} FROM s_{w} JOIN z_{w} USING (id) JOIN r_{w} USING (id)")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(outs)


@query("dwt_moments", _moments_sql())
def dwt_moments(spark, sf_dir):
    """Each level's relative energy and moments, all filters, by the kernel."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    got = wav.wavelet_features(rows, "embedding", None, WAVELETS, 5, "")
    level = lambda w, i: F.struct(F.lit(w).alias("wavelet"), F.lit(i).alias("level"), *(F.col(f"wv_{w}_d{i}_{k}").alias(k) for k in ("rel_energy", "skewness", "kurtosis")))
    all_levels = [level(w, i) for w in WAVELETS for i in range(1, _chain(w)[1] + 1)]
    return rounded(got.select("id", F.inline(F.array(*all_levels))))


@query("wavelet_features_all")
def wavelet_features_all(spark, sf_dir):
    """All wavelets on the resampled normalised series: 270 columns at six levels."""
    nested = ser.implode_series(ser.with_norm(curves(spark, sf_dir), "centre"), ("mjd", "norm"))
    return rounded(wav.wavelet_features(nested, levels=6))


@query("extract_all_features")
def extract_all_features(spark, sf_dir):
    from driftcurve.operators.features import extract_all

    return extract_all(curves(spark, sf_dir, spread=True))


def _group_of_all(name: str, twin: str, like: str) -> None:
    """A group of columns of the whole feature table, made with its defaults, against its twin on cleaned series. Only the sink's narrowing is off."""

    @query(name, twin.replace(SERIES, sql.CLEAN_SERIES))
    def run(spark, sf_dir):
        from driftcurve.operators.features import extract_all

        got = extract_all(curves(spark, sf_dir, spread=True), float32=False)
        got = got.select("id", *(c for c in got.columns if re.fullmatch(like, c)))
        return rounded(got.withColumns({c: F.round(F.col(c) + 3e-7, 2) for c in got.columns if c.endswith("_energy")}))


for _x in ("mag", "magerr", "norm", "velocity", "mjd_diff"):
    _group_of_all(f"all_features_{_x}", sql.main_stats(_x, _x != "norm"), f"{_x}_({'|'.join(fam.MAIN)})")

_SHAPE_NAMES = rf"mjd_span|(mag|norm|vel)_(?!to_|from_|wv_|({'|'.join([*fam.MAIN, *fam.FRACTIONS])})$).*"
_SHAPES = [sql.shape("mag"), sql.shape("norm", True), sql.shape("velocity").replace(" AS velocity_", " AS vel_")]
_group_of_all("all_features_shape", "SELECT * FROM " + " JOIN ".join(f"({q}) s{i}" + (" USING (id)" if i else "") for i, q in enumerate(_SHAPES)), _SHAPE_NAMES)
_group_of_all("all_features_split", sql.split(("mag", "norm", "velocity"), "argmin"), "(mag|norm|velocity)_(to|from)_argmin_.*")
_group_of_all("all_features_fractions", SQL["shape_fractions"], "|".join(f"norm_{k}" for k in fam.FRACTIONS))


@query("series_corr", f"WITH {SERIES} SELECT id, {r6('corr(mag, norm)', 'corr_mag_norm')}, {r6('corr(mag, mjd)', 'corr_mag_mjd')} FROM series GROUP BY id")
def series_corr(spark, sf_dir):
    return rounded(ser.with_norm(curves(spark, sf_dir)).groupBy("id").agg(F.corr("mag", "norm").alias("corr_mag_norm"), F.corr("mag", "mjd").alias("corr_mag_mjd")))


def histogram(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins 0 to bins - 1 of equal width from low to high, the last one closed."""
    return F.least(F.floor(F.try_divide(x - low, high - low) * bins), F.lit(bins - 1)).cast("bigint")


@query(
    "series_histogram",
    f"WITH {SERIES}, e AS (SELECT *, min(norm) OVER () AS low, max(norm) OVER () AS high FROM series WHERE norm IS NOT NULL) SELECT CAST(least(floor((norm - low) / (high - low) * 30), 29) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY 1",
)
def series_histogram(spark, sf_dir):
    """Thirty bins over all normalised values; the ends come from an aggregate, not from a sort."""
    s = ser.with_norm(curves(spark, sf_dir)).where("norm IS NOT NULL").select("norm")
    ends = s.agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return s.join(F.broadcast(ends)).groupBy(histogram(F.col("norm"), F.col("low"), F.col("high"), 30).alias("bin")).agg(F.count("*").alias("n"))


@query(
    "series_by_supplier",
    sql.main_stats("mag", False, source="lines", ctes="lines AS (SELECT l_suppkey AS id, l_quantity AS mag, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS pos FROM lineitem)"),
)
def series_by_supplier(spark, sf_dir):
    """Few long series."""
    from pyspark.sql import Window as W

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("double").alias("mag"), "l_quantity", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    lines = lines.withColumn("pos", (F.row_number().over(W.partitionBy("id").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")) - 1).cast("bigint"))
    return rounded(fam.apply(lines, fam.main_stats("mag", entropy=False)))


@query("series_steps", f"WITH {SERIES} SELECT id, pos, {r6('norm', 'norm')}, {r6('mjd_diff', 'mjd_diff')}, {r6('velocity', 'velocity')} FROM series")
def series_steps(spark, sf_dir):
    return rounded(full_series(spark, sf_dir).select("id", "pos", "norm", "mjd_diff", "velocity"))


@query(
    "series_safe_norm",
    f"WITH {CURVES}, z AS (SELECT *, CASE WHEN id % 3 = 0 THEN 0 ELSE magerr END AS e FROM curves), m AS (SELECT id, median(mag) AS mid, median(e) AS err FROM z GROUP BY id) SELECT z.id, z.pos, {r6('CASE WHEN err = 0 THEN mag - mid ELSE (mag - mid) / err END', 'norm')} FROM z JOIN m USING (id)",
)
def series_safe_norm(spark, sf_dir):
    """Series whose errors are all 0 are only centred."""
    s = curves(spark, sf_dir).withColumn("magerr", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("magerr")))
    return rounded(ser.with_norm(s, "centre").select("id", "pos", "norm"))


@query(
    "series_round_trip",
    f"WITH {CURVES} SELECT id, pos, {r6('mjd', 'mjd')}, {r6('mag', 'mag')} FROM curves",
)
def series_round_trip(spark, sf_dir):
    """Long form to arrays and back."""
    return rounded(ser.explode_series(ser.implode_series(curves(spark, sf_dir), ("mjd", "mag"))).select("id", F.col("pos").cast("bigint").alias("pos"), "mjd", "mag"))
