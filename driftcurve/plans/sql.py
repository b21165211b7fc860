"""SQL twins of the series queries, for an independent engine."""

from __future__ import annotations

#: Both sides round alike; the offset moves exact decimal ties, which engines round differently.
TIE = "3e-10"


def r6(x: str, name: str) -> str:
    return f"round(({x}) + {TIE}, 6) AS {name}"


CURVES = """
curves AS (
  SELECT user_id AS id, event_id, epoch_us(ts) / CAST(86400000000 AS DOUBLE) + CAST(40587 AS DOUBLE) AS mjd, value AS mag,
         CAST(0.01 AS DOUBLE) + CAST(0.001 AS DOUBLE) * (event_id % 97) AS magerr, CAST(user_id % 20 = 0 AS INTEGER) AS class,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events
)"""

SERIES = CURVES + """, medians AS (
  SELECT id, median(mag) AS mid, median(magerr) AS err FROM curves GROUP BY id
), series AS (
  SELECT c.*, (c.mag - m.mid) / nullif(m.err, 0) AS norm,
         c.mjd - lag(c.mjd) OVER w AS mjd_diff, (c.mag - lag(c.mag) OVER w) / nullif(c.mjd - lag(c.mjd) OVER w, 0) AS velocity
  FROM curves c JOIN medians m USING (id) WINDOW w AS (PARTITION BY c.id ORDER BY c.pos)
)"""


#: As SERIES, of curves whose only outlier (beyond the quartiles by 40 interquartile ranges) is replaced by its neighbours' mean.
CLEAN_SERIES = (
    CURVES.replace("curves AS", "raw AS", 1)
    + """, quarts AS (
  SELECT id, quantile_cont(mag, 0.25) AS q1, quantile_cont(mag, 0.75) AS q3 FROM raw GROUP BY id
), far AS (
  SELECT r.*, mag < q1 - 40 * (q3 - q1) OR mag > q3 + 40 * (q3 - q1) AS out, lag(mag) OVER w AS before, lead(mag) OVER w AS after
  FROM raw r JOIN quarts USING (id) WINDOW w AS (PARTITION BY r.id ORDER BY r.pos)
), counted AS (
  SELECT *, count(*) FILTER (out) OVER (PARTITION BY id) AS outs FROM far
), curves AS (
  SELECT id, event_id, mjd, CASE WHEN outs = 1 AND out THEN coalesce((before + after) / 2, before, after, mag) ELSE mag END AS mag, magerr, class, pos FROM counted
)"""
    + SERIES[len(CURVES) :]
)


def main_stats(x: str, entropy: bool = True, source: str = "series", ctes: str = SERIES) -> str:
    out = [
        r6("avg(x)", f"{x}_mean"), r6("stddev_samp(x)", f"{x}_std"), r6("min(x)", f"{x}_min"), r6("max(x)", f"{x}_max"), r6("median(x)", f"{x}_median"),
        r6("list_sort(list(x))[CAST(floor((count(*) - 1) * 0.25 + 0.5) AS BIGINT) + 1]", f"{x}_q25"), r6("list_sort(list(x))[CAST(floor((count(*) - 1) * 0.75 + 0.5) AS BIGINT) + 1]", f"{x}_q75"),
        r6("CASE WHEN sum(e*e) > 0 THEN (sum(e*e*e) / count(*)) / pow(sum(e*e) / count(*), 1.5) END", f"{x}_skewness"), r6("CASE WHEN sum(e*e) > 0 THEN (sum(e*e*e*e) / count(*)) / pow(sum(e*e) / count(*), 2) - 3 END", f"{x}_kurtosis"),
        r6("arg_min(x, pos)", f"{x}_first"), r6("arg_max(x, pos)", f"{x}_last"), f"arg_min(pos, (x, pos)) - min(pos) AS {x}_arg_min", f"arg_min(pos, (-x, pos)) - min(pos) AS {x}_arg_max",
        f"count(DISTINCT x) AS {x}_n_unique", f"count(*) FILTER (sign(d) <> sign(pd)) AS {x}_trend_changes",
    ]
    if entropy:
        out.append(r6("CASE WHEN min(x) > 0 THEN ln(sum(x)) - sum(CASE WHEN x > 0 THEN x * ln(x) END) / sum(x) END", f"{x}_entropy"))
    return f"""WITH {ctes}, s AS (SELECT id, pos, {x} AS x FROM {source} WHERE {x} IS NOT NULL),
t AS (SELECT *, x - lag(x) OVER (PARTITION BY id ORDER BY pos) AS d, x - avg(x) OVER (PARTITION BY id) AS e FROM s),
u AS (SELECT *, lag(d) OVER (PARTITION BY id ORDER BY pos) AS pd FROM t)
SELECT id, {", ".join(out)} FROM u GROUP BY id"""


def shape(x: str, times: bool = False) -> str:
    """Runs as islands: points of a run share the number of points so far that break it."""
    b = "x < -2"
    flags = {"below": b, "above": "x > 1", "up": "coalesce(x > prev, false)", "down": "coalesce(x < prev, false)"}
    runs = ",\n".join(f"runs_{k} AS (SELECT id, max(n) AS longest, count(*) AS runs, sum(n) AS total FROM (SELECT id, isle, count(*) AS n FROM (SELECT id, {c} AS yes, count(*) FILTER (NOT ({c})) OVER (PARTITION BY id ORDER BY pos) AS isle FROM t) WHERE yes GROUP BY id, isle) GROUP BY id)" for k, c in flags.items())
    lo = "(arg_min(pos, (x, pos)) - min(pos))"
    n = "count(*)"
    own = f"""SELECT t.id, count(*) FILTER (x < -3) AS n3, {lo} AS lo, {n} AS n, count(*) FILTER (x < prev AND next > x) AS minima, count(*) FILTER (x > prev AND next < x) AS maxima,
 count(*) FILTER (sign(x) * sign(prev) < 0) AS crossings, count(*) FILTER (x < -2 AND coalesce(prev, 0) >= -2 AND coalesce(next, 0) >= -2) AS isolated, count(*) FILTER (x < -2) AS b2, count(*) FILTER (x < -1) AS b1,
 avg(x) - min(x) AS depth, avg(x) FILTER (i < size // 2) - avg(x) FILTER (i >= size - size // 2) AS halves, arg_min(mjd, pos) AS t0, arg_max(mjd, pos) AS t1, arg_min(mjd, (x, pos)) AS tp FROM t GROUP BY t.id"""
    c = lambda k, f="longest": f"coalesce({k}.{f}, 0)"
    one = lambda e: f"greatest({e}, 1)"
    big = lambda e, name: f"CAST({e} AS BIGINT) AS {x}_{name}"
    div = lambda a, d: f"CAST({a} AS DOUBLE) / ({d})"
    out = [
        big("n3", "n_below_3sigma"), big(c("rb"), "max_consecutive_below_2sigma"), r6(div("lo + 1", "n - lo"), f"{x}_rise_decay_idx_ratio"), big("minima", "n_local_minima"), big("crossings", "n_zero_crossings"), r6(div("lo", one("n - 1")), f"{x}_peak_position_ratio"),
        big(c("ra"), "max_consecutive_above_1sigma"), big(c("ru"), "longest_monotonic_increase"), big(c("rd"), "longest_monotonic_decrease"), big("isolated", "n_isolated_below_2sigma"), r6(div("b2", "n"), f"{x}_frac_below_2sigma"), r6(div("b1", "n"), f"{x}_frac_below_1sigma"),
        big("maxima", "n_local_maxima"), r6("depth", f"{x}_peak_depth"), r6("coalesce(halves, 0)", f"{x}_first_second_half_diff"), r6(div("minima + 1", "maxima + 1"), f"{x}_minima_maxima_ratio"), r6(div(f"{c('ru')} + 1", f"{c('rd')} + 1"), f"{x}_monotonic_ratio"),
        big(c("rb", "runs"), "n_runs_below_2sigma"), r6(div(c("rb", "total"), one(c("rb", "runs"))), f"{x}_mean_run_below_2sigma"), big(c("ra", "runs"), "n_runs_above_1sigma"), r6(div(c("ra", "total"), one(c("ra", "runs"))), f"{x}_mean_run_above_1sigma"),
        r6(f"({div(c('rb', 'total') + ' + 1', one(c('rb', 'runs')))}) / ({div(c('ra', 'total') + ' + 1', one(c('ra', 'runs')))})", f"{x}_run_length_ratio"),
    ]
    if times:
        out += [r6("(tp - t0) / (t1 - tp + 1e-10)", f"{x}_rise_decay_time_ratio"), r6("t1 - t0", "mjd_span")]
    return f"""WITH {SERIES}, s AS (SELECT id, pos, mjd, {x} AS x FROM series WHERE {x} IS NOT NULL),
t AS (SELECT *, lag(x) OVER w AS prev, lead(x) OVER w AS next, count(*) OVER (PARTITION BY id) AS size, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY id ORDER BY pos)),
{runs}, own AS ({own})
SELECT own.id, {", ".join(out)} FROM own LEFT JOIN runs_below rb USING (id) LEFT JOIN runs_above ra USING (id) LEFT JOIN runs_up ru USING (id) LEFT JOIN runs_down rd USING (id)"""


def split(columns: tuple[str, ...], which: str) -> str:
    parts, outs = [], []
    for x in columns:
        for side in ("to", "from"):
            p = f"{x}_{side}"
            own = "s.pos - 1" if x == "velocity" else "s.pos"
            start = "greatest(k - 1, 0)" if x == "velocity" else "k"
            cond = f"{own} < k" if side == "to" else f"{own} >= {start}"
            n = f"{p}_{which}"
            parts.append(f"""{p}0 AS (SELECT s.id, s.pos, s.{x} AS x FROM series s JOIN spot USING (id) WHERE {cond} AND s.{x} IS NOT NULL),
{p}1 AS (SELECT *, avg(x) OVER (PARTITION BY id) AS mu, stddev_samp(x) OVER (PARTITION BY id) AS sd FROM {p}0),
{p} AS (SELECT id, count(*) AS len, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, max(x) - min(x) AS range, (arg_max(x, pos) - arg_min(x, pos)) / greatest(count(*), 1) AS slope, median(x) AS median,
 quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg((x-mu)*(x-mu)*(x-mu)) / (max(sd*sd*sd) + 1e-10) AS skewness, avg((x-mu)*(x-mu)*(x-mu)*(x-mu)) / (max(sd*sd*sd*sd) + 1e-10) - 3 AS kurtosis,
 count(*) FILTER (x > mu + 2*sd) AS n_above_2sigma, count(*) FILTER (x < mu - 2*sd) AS n_below_2sigma, count(*) FILTER (x > mu + 3*sd) AS n_above_3sigma, count(*) FILTER (x < mu - 3*sd) AS n_below_3sigma, sum(x*x) AS energy FROM {p}1 GROUP BY id)""")
            outs += [f"coalesce({p}.{k}, 0) AS {n}_{k}" for k in ("len", "n_above_2sigma", "n_below_2sigma", "n_above_3sigma", "n_below_3sigma")]
            outs += [r6(f"{p}.{k}", f"{n}_{k}") for k in ("mean", "std", "min", "max", "range", "slope", "median", "q25", "q75", "iqr", "skewness", "kurtosis")] + [r6(f"round(coalesce({p}.energy, 0) + 3e-7, 2)", f"{n}_energy")]
    key = "(mag, pos)" if which == "argmin" else "(-mag, pos)"
    joins = " ".join(f"LEFT JOIN {x}_{s} USING (id)" for x in columns for s in ("to", "from"))
    return f"WITH {SERIES}, spot AS (SELECT id, arg_min(pos, {key}) AS k FROM series GROUP BY id),\n" + ",\n".join(parts) + f"\nSELECT spot.id, {', '.join(outs)} FROM spot {joins}"
