"""Queries on signals: elementwise functions, filters, spectra, surrogates and warping, with SQL where SQL can say it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import columns, signal
from ..functions.time import DAY, HOUR
from ..operators import filtering, randomize, series, warping
from ..streaming import windows
from .base import ORIGIN, D, T, X, daily, e_sql, epochs, events, table, tagged_sql, trains
from .catalogue import ORACLE_SQL as _SQL
from .catalogue import QUERIES as _ALL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
E, XE, TE = e_sql(), tagged_sql(), tagged_sql("tr", "te")
DAYS = 1 / 86400.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = _ALL[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {X} SELECT unit, t_ns, round(ln(v + 1), 9) AS a, round(sqrt(v), 9) AS b, CAST(floor(v) AS BIGINT) AS c, round(hypot(v, 3.0), 9) AS d, least(greatest(v, 10.0), 90.0) AS e, v > 50 AS f, round(atan2(v, 2.0), 9) AS g FROM (SELECT *, 0 FROM x)".replace("hypot(v, 3.0)", "sqrt(v * v + 9)"))
def numpy_elementwise(spark, sf_dir):
    u, b = columns.unary, columns.binary
    return events(spark, sf_dir).select("unit", "t_ns", F.round(u("log1p", "v"), 9).alias("a"), F.round(u("sqrt", "v"), 9).alias("b"), u("floor", "v").alias("c"), F.round(b("hypot", "v", 3.0), 9).alias("d"), columns.clip("v", 10.0, 90.0).alias("e"), b("greater", "v", 50.0).alias("f"), F.round(b("arctan2", "v", 2.0), 9).alias("g"))


@query(f"WITH {X} SELECT unit, t_ns, round(sum(v) OVER w, 4) AS acc FROM x WINDOW w AS (PARTITION BY unit ORDER BY t_ns)")
def numpy_cumsum(spark, sf_dir):
    return columns.cumulative(events(spark, sf_dir).select("unit", "t_ns", "v"), "cumsum", ["unit"]).select("unit", "t_ns", F.round("acc", 4).alias("acc"))


@query(f"WITH {X} SELECT unit, t_ns, round(dv, 6) AS dv FROM (SELECT unit, t_ns, v - lag(v) OVER (PARTITION BY unit ORDER BY t_ns) AS dv FROM x) WHERE dv IS NOT NULL")
def numpy_diff(spark, sf_dir):
    return columns.diff(events(spark, sf_dir), ["unit"]).select("unit", "t_ns", F.round("dv", 6).alias("dv"))


@query(f"WITH {X} SELECT unit, round(sum(v), 4) AS s, round(avg(v), 6) AS m, round(stddev_pop(v), 6) AS sd, min(v) AS lo, max(v) AS hi, round(median(v), 6) AS med, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v) - min(v), 6) AS ptp FROM x GROUP BY 1")
def numpy_reductions(spark, sf_dir):
    r = columns.reduce
    return events(spark, sf_dir).groupBy("unit").agg(F.round(r("sum", "v"), 4).alias("s"), F.round(r("mean", "v"), 6).alias("m"), F.round(r("std", "v"), 6).alias("sd"), r("min", "v").alias("lo"), r("max", "v").alias("hi"), F.round(r("median", "v"), 6).alias("med"), F.round(columns.percentile("v", 90), 6).alias("p90"), F.round(r("ptp", "v"), 6).alias("ptp"))


@query(f"WITH {X} SELECT unit, t_ns, v FROM x QUALIFY row_number() OVER (PARTITION BY unit ORDER BY v DESC, t_ns) = 1")
def numpy_argmax(spark, sf_dir):
    return columns.argbest(events(spark, sf_dir), ["unit"])


@query(f"WITH {X} SELECT CASE WHEN v < 25 THEN 0 WHEN v < 50 THEN 1 WHEN v < 100 THEN 2 ELSE 3 END AS bin, count(*) AS n FROM x WHERE v BETWEEN 0 AND 200 GROUP BY 1")
def numpy_histogram(spark, sf_dir):
    return columns.histogram(events(spark, sf_dir), [0.0, 25.0, 50.0, 100.0, 200.0])


@query(f"WITH {X} SELECT unit, t_ns, CAST(ntile(4) OVER (PARTITION BY unit ORDER BY t_ns) - 1 AS INT) AS piece FROM x")
def numpy_split(spark, sf_dir):
    return columns.split(events(spark, sf_dir).select("unit", "t_ns"), 4, ["unit"])


@query(f"WITH {X} SELECT t_ns, unit, v FROM x WHERE t_ns <= {ORIGIN + 5 * DAY} UNION ALL SELECT t_ns, unit, v FROM x WHERE t_ns > {ORIGIN + 8 * DAY}")
def numpy_concatenate(spark, sf_dir):
    x = events(spark, sf_dir).select("t_ns", "unit", "v")
    return columns.concatenate([x.where(F.col("t_ns") <= ORIGIN + 5 * DAY), x.where(F.col("t_ns") > ORIGIN + 8 * DAY)])


def _conv_sql(kernel: list[float], source: str = "d") -> str:
    """out[i] = sum_j a[j] x[i + o - j] with o in the middle."""
    k = len(kernel)
    o = (k - 1) // 2
    terms = " + ".join(f"{a!r} * coalesce(lead(v, {o - j}) OVER w, 0)" if o >= j else f"{a!r} * coalesce(lag(v, {j - o}) OVER w, 0)" for j, a in enumerate(kernel))
    return f"SELECT t_ns, {terms} AS v FROM {source} WINDOW w AS (ORDER BY t_ns)"


@query(f"WITH {D} SELECT t_ns, round(v, 9) AS v FROM ({_conv_sql([1 / 7] * 7)})")
def convolve_boxcar(spark, sf_dir):
    return series.convolve(daily(spark, sf_dir), [1 / 7] * 7, ["epoch_id"]).select("t_ns", F.round("v", 9).alias("v"))


@query(f"WITH {D} SELECT t_ns, round(v, 6) AS v FROM ({_conv_sql(series.gaussian_kernel(2.0, 21))})")
def smooth_gaussian(spark, sf_dir):
    return series.smooth(daily(spark, sf_dir), 2 * DAY, DAYS, ["epoch_id"], size_factor=10).select("t_ns", F.round("v", 6).alias("v"))


_LOW = signal.sinc_filter("lowpass", 0.1 * DAYS, DAYS, 0.2).tolist()
_HIGH = signal.sinc_filter("highpass", 0.1 * DAYS, DAYS, 0.2).tolist()
_STOP = signal.sinc_filter("bandstop", (0.05 * DAYS, 0.2 * DAYS), DAYS, 0.2).tolist()
_BAND = signal.sinc_filter("bandpass", (0.05 * DAYS, 0.2 * DAYS), DAYS, 0.2).tolist()


@query(f"WITH {D} SELECT t_ns, round(v, 6) AS v FROM ({_conv_sql(_LOW)})")
def filter_sinc_low(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "lowpass", 0.1 * DAYS, DAYS, ["epoch_id"], "sinc", transition=0.2).select("t_ns", F.round("v", 6).alias("v"))


@query(f"WITH {D} SELECT t_ns, round(v, 6) AS v FROM ({_conv_sql(_BAND)})")
def filter_sinc_band(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "bandpass", (0.05 * DAYS, 0.2 * DAYS), DAYS, ["epoch_id"], "sinc", transition=0.2).select("t_ns", F.round("v", 6).alias("v"))


def _sections_sql(sections: np.ndarray, source: str, down: int = 1, more: str = "") -> str:
    """A filter run in both directions over (t_ns, v), written as recurrences: the ends are continued by their point reflection,
    and every section starts in the state in which it rests at the first value."""
    pad, rest = 3 * (2 * len(sections) + 1), signal.steady_states(sections).tolist()
    ctes = [
        f"s0 AS (SELECT v, row_number() OVER (ORDER BY t_ns) - 1 AS r, count(*) OVER () AS n FROM {source})",
        "fl AS (SELECT max(n) AS n, max(v) FILTER (r = 0) AS a, max(v) FILTER (r = n - 1) AS z FROM s0)",
        f"p0 AS (SELECT r + {pad} AS i, v FROM s0 UNION ALL SELECT {pad} - r, 2 * a - v FROM s0, fl WHERE r BETWEEN 1 AND {pad} UNION ALL SELECT {pad} + 2 * (fl.n - 1) - r, 2 * z - v FROM s0, fl WHERE r BETWEEN fl.n - 1 - {pad} AND fl.n - 2)",
    ]

    def run(name: str, before: str, way: str) -> str:
        """All sections at once over i ascending: y of section k feeds section k + 1 in the same step."""
        rows = f"{name}o AS (SELECT v, row_number() OVER (ORDER BY i {way}) AS i FROM {before})"
        step, start, y, first = [], [], "x.v", f"(SELECT v FROM {name}o WHERE i = 1)"
        outs = []
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
            outs.append(f"({b0!r} * {y} + f.p{k})")
            y = outs[-1]
        # states follow from inputs and outputs of the step
        inputs = ["x.v", *outs[:-1]]
        for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
            step += [f"{b1!r} * {inputs[k]} - {a1!r} * {outs[k]} + f.q{k}", f"{b2!r} * {inputs[k]} - {a2!r} * {outs[k]}"]
            start += [f"{rest[k][0]!r} * {first} AS p{k}", f"{rest[k][1]!r} * {first} AS q{k}"]
        return f"{rows}, {name} AS (SELECT 0::BIGINT AS i, 0.0::DOUBLE AS v, {', '.join(start)} UNION ALL SELECT x.i, {outs[-1]}, {', '.join(step)} FROM {name} f JOIN {name}o x ON x.i = f.i + 1)"

    ctes += [run("fw", "p0", "ASC"), "fwd AS (SELECT * FROM fw WHERE i > 0)", run("bw", "fwd", "DESC")]
    if more:
        filtered = f"bp AS (SELECT s.t_ns, b.v FROM (SELECT t_ns, row_number() OVER (ORDER BY t_ns) - 1 AS r FROM {source}) s, fl JOIN bw b ON b.i = fl.n + {pad} - s.r)"
        return f"WITH RECURSIVE {D}, {', '.join(ctes)}, {filtered}, {more}"
    last = f"SELECT s.t_ns, round(b.v, 6) AS v FROM (SELECT t_ns, row_number() OVER (ORDER BY t_ns) - 1 AS r FROM {source}) s, fl JOIN bw b ON b.i = fl.n + {pad} - s.r WHERE s.r % {down} = 0"
    return f"WITH RECURSIVE {D}, {', '.join(ctes)} {last}"


@query(_sections_sql(signal.butter_sections("lowpass", 0.1 * DAYS, DAYS), "d"))
def filter_butter_low(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "lowpass", 0.1 * DAYS, DAYS, ["epoch_id"]).select("t_ns", F.round("v", 6).alias("v"))


@query(_sections_sql(signal.butter_sections("bandpass", (0.05 * DAYS, 0.2 * DAYS), DAYS), "d"))
def filter_butter_band(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "bandpass", (0.05 * DAYS, 0.2 * DAYS), DAYS, ["epoch_id"]).select("t_ns", F.round("v", 6).alias("v"))


@query("SELECT range * 50.0::DOUBLE / 1024 AS freq, round(1 / sqrt(1 + pow(tan(pi() * range * 50.0::DOUBLE / 1024 / 100) / tan(pi() * 10 / 100), 8)), 9) AS gain FROM range(1024)")
def filter_frequency_response(spark, sf_dir):
    return spark.createDataFrame(signal.frequency_response("lowpass", 10.0, 100.0), "freq double, gain double").select("freq", F.round("gain", 9).alias("gain"))


@query(f"WITH {D} SELECT t_ns, round(v, 6) AS v FROM ({_conv_sql(_HIGH)})")
def filter_sinc_high(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "highpass", 0.1 * DAYS, DAYS, ["epoch_id"], "sinc", transition=0.2).select("t_ns", F.round("v", 6).alias("v"))


@query(f"WITH {D} SELECT t_ns, round(v, 6) AS v FROM ({_conv_sql(_STOP)})")
def filter_sinc_stop(spark, sf_dir):
    return filtering.apply_filter(daily(spark, sf_dir), "bandstop", (0.05 * DAYS, 0.2 * DAYS), DAYS, ["epoch_id"], "sinc", transition=0.2).select("t_ns", F.round("v", 6).alias("v"))


@query(f"WITH {D}, f AS ({_conv_sql(signal.hamming_kernel(9, 0.25).tolist())}) SELECT t_ns, round(v, 6) AS v FROM f QUALIFY (row_number() OVER (ORDER BY t_ns) - 1) % 4 = 0")
def decimate_fir(spark, sf_dir):
    return filtering.decimate(daily(spark, sf_dir), 4, ["epoch_id"], filter_type="fir").select("t_ns", F.round("v", 6).alias("v"))


@query(_sections_sql(signal.chebyshev_sections(8, 0.05, 0.2), "d", 4))
def decimate(spark, sf_dir):
    return filtering.decimate(daily(spark, sf_dir), 4, ["epoch_id"]).select("t_ns", F.round("v", 6).alias("v"))


def _one_span(spark, sf_dir):
    return daily(spark, sf_dir).agg(F.lit(0).alias("epoch_id"), F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("end_ns"))


_BOX = [1 / 9] * 9


@query(
    _sections_sql(
        signal.butter_sections("bandpass", (0.05 * DAYS, 0.2 * DAYS), DAYS),
        "d",
        more=f"pw AS (SELECT t_ns, v AS raw, v * v AS v FROM bp), b1 AS ({_conv_sql(_BOX, 'pw')}), b2 AS ({_conv_sql(_BOX, 'b1')}), m AS (SELECT avg(v) AS a, stddev_pop(v) AS s FROM b2), "
        "z AS (SELECT b2.t_ns, raw, b2.v AS p, (b2.v - a) / s AS z FROM b2 JOIN pw USING (t_ns), m), "
        "k AS (SELECT t_ns, z > 1 AS i, lag(t_ns) OVER w AS tb, lag(z > 1) OVER w AS ib, lead(t_ns) OVER w AS ta FROM z WHERE z < 10 WINDOW w AS (ORDER BY t_ns)), "
        "r AS (SELECT *, sum(CASE WHEN i AND NOT coalesce(ib, false) THEN 1 ELSE 0 END) OVER (ORDER BY t_ns) AS g FROM k), "
        "u AS (SELECT arg_min(coalesce(tb + (t_ns - tb) // 2, t_ns), t_ns) AS s, arg_max(coalesce(t_ns + (ta - t_ns) // 2, t_ns), t_ns) AS e FROM r WHERE i GROUP BY g), "
        f"c AS (SELECT *, CASE WHEN s - lag(e) OVER (ORDER BY s) <= {5 * DAY} THEN 0 ELSE 1 END AS w FROM u WHERE e - s > {5 * DAY} AND e - s < {200 * DAY}), "
        "g AS (SELECT min(s) AS s, max(e) AS e FROM (SELECT *, sum(w) OVER (ORDER BY s) AS g FROM c) GROUP BY g), n AS (SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INT) AS epoch_id, s, e FROM g) "
        "SELECT epoch_id, s AS start_ns, e AS end_ns, round(10 * log10(avg(raw * raw)), 6) AS power, round(max(sqrt(p)), 6) AS amplitude, arg_max(t_ns, {'p': p, 't': -t_ns}) AS peak_ns FROM n LEFT JOIN z ON t_ns BETWEEN s AND e GROUP BY ALL",
    )
)
def oscillatory_events(spark, sf_dir):
    rows = filtering.detect_oscillatory_events(daily(spark, sf_dir).select("t_ns", "v"), _one_span(spark, sf_dir), (0.05 * DAYS, 0.2 * DAYS), DAYS, (1.0, 10.0), (5 * DAY, 200 * DAY), 5 * DAY, window=9)
    return rows.withColumns({"power": F.round("power", 6), "amplitude": F.round("amplitude", 6)})


_N = "n AS (SELECT t_ns, v, row_number() OVER (ORDER BY t_ns) - 1 AS r, count(*) OVER () AS n FROM d)"


@query(
    f"WITH {D}, {_N}, k AS (SELECT unnest(range((max(n) + 1) // 2)) AS k, max(n) AS n FROM n), y AS (SELECT k.k, k.n, sum(v * cos(2 * pi() * ((k.k * r) % k.n) / k.n)) AS re, sum(v * sin(2 * pi() * ((k.k * r) % k.n) / k.n)) AS im FROM k, n GROUP BY ALL) "
    "SELECT CAST(k AS INT) AS k, round(CASE WHEN k > 0 THEN 2 ELSE 1 END * (re * re + im * im) / (n * (SELECT sum(v * v) FROM d)), 6) AS power FROM y"
)
def power_spectrum(spark, sf_dir):
    x = daily(spark, sf_dir)
    total = x.agg(F.sum(F.col("v") * F.col("v")).alias("_s"))
    rows = filtering.power_spectral_density(x, DAYS, ["epoch_id"]).crossJoin(F.broadcast(total))  # one row
    return rows.select("k", F.round(F.col("psd") * DAYS / F.col("_s"), 6).alias("power"))


_S, _STEP = 128, 96


@query(
    f"WITH {D}, {_N}, w AS (SELECT unnest(range((max(n) - {_S}) // {_STEP} + 1)) AS w FROM n), s AS (SELECT w, r - w * {_STEP} AS p, v * (0.54 - 0.46 * cos(2 * pi() * (r - w * {_STEP}) / {_S - 1})) AS v FROM w JOIN n ON r BETWEEN w * {_STEP} AND w * {_STEP} + {_S - 1}), "
    f"k AS (SELECT range AS k FROM range({_S // 2})), y AS (SELECT w, k, sum(v * cos(2 * pi() * k * p / {_S})) AS re, sum(v * sin(2 * pi() * k * p / {_S})) AS im FROM k, s GROUP BY ALL) SELECT CAST(k AS INT) AS k, round(avg(CASE WHEN k > 0 THEN 2 ELSE 1 END * (re * re + im * im) / {_S}), 6) AS psd FROM y GROUP BY k"
)
def mean_psd(spark, sf_dir):
    rows = filtering.mean_power_spectral_density(daily(spark, sf_dir).select("t_ns", "v"), _one_span(spark, sf_dir), DAYS, _S)
    return rows.select("k", F.round(F.col("psd") * DAYS, 6).alias("psd"))


_MORLET = {f: k / (DAYS / f) for f, k in signal.morlet_bank([0.125 * DAYS, 0.25 * DAYS], DAYS).items()}


@query(
    f"WITH {D}, "
    + " , ".join(f"r{i} AS ({_conv_sql(np.real(k).tolist())}), i{i} AS ({_conv_sql(np.imag(k).tolist())})" for i, k in enumerate(_MORLET.values()))
    + " "
    + " UNION ALL ".join(f"SELECT r{i}.t_ns, {0.125 * (i + 1)} :: DOUBLE AS cycles, round(r{i}.v * r{i}.v + i{i}.v * i{i}.v, 5) AS power FROM r{i} JOIN i{i} USING (t_ns)" for i in range(2))
)
def wavelet_power(spark, sf_dir):
    rows = filtering.wavelet_transform(daily(spark, sf_dir), list(_MORLET), DAYS, ["epoch_id"])
    return rows.select("t_ns", F.round(F.col("freq") / DAYS, 6).alias("cycles"), F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 5).alias("power"))


@query(f"WITH {T}, {E}, {TE}, c AS (SELECT unit, epoch_id, CAST(least((t_ns - start_ns) * 5 // (end_ns - start_ns), 4) AS INT) AS bin, count(*) AS n FROM te GROUP BY ALL) SELECT u.unit, e.epoch_id, k.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT unit FROM tr) u CROSS JOIN e CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(5)) k LEFT JOIN c ON c.unit = u.unit AND c.epoch_id = e.epoch_id AND c.bin = k.bin")
def warp_counts(spark, sf_dir):
    return warping.warp_counts(trains(spark, sf_dir), epochs(spark), 5, ["unit"])


@query(
    f"WITH {X}, {E}, {XE}, r AS (SELECT *, row_number() OVER (PARTITION BY epoch_id ORDER BY t_ns) - 1 AS r, count(*) OVER (PARTITION BY epoch_id) AS n, lead(v) OVER (PARTITION BY epoch_id ORDER BY t_ns) AS nx FROM xe), "
    "m AS (SELECT epoch_id, CAST(least((t_ns - start_ns) * 4 // (end_ns - start_ns), 3) AS INT) AS bin, avg(v) AS v FROM r WHERE n > 4 GROUP BY ALL), "
    "p AS (SELECT DISTINCT epoch_id, k.bin, k.bin * (n - 1) / 3.0::DOUBLE AS p FROM r CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(4)) k WHERE n <= 4), "
    "f AS (SELECT p.epoch_id, p.bin, r.v + coalesce((r.nx - r.v) * (p - r.r), 0) AS v FROM p JOIN r ON r.epoch_id = p.epoch_id AND r.r = CAST(floor(p) AS BIGINT)), "
    "a AS (SELECT * FROM m UNION ALL SELECT * FROM f) SELECT e.epoch_id, k.bin, round(a.v, 6) AS v FROM e CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(4)) k LEFT JOIN a ON a.epoch_id = e.epoch_id AND a.bin = k.bin"
)
def warp_signal(spark, sf_dir):
    return warping.warp_signal(events(spark, sf_dir), epochs(spark), 4).withColumn("v", F.round("v", 6))


def _uniform_sql(*keys: str) -> str:
    """The engine's uniform numbers for seed 1."""
    return f"(('0x' || substr(md5(concat_ws(':', '1', {', '.join(keys)})), 1, 13))::BIGINT / {float(1 << 52)!r}::DOUBLE)"


_FIRST, _LAST = ORIGIN, ORIGIN + 59 * 12 * HOUR + 6 * HOUR
_APART = "a AS (SELECT unit, t_ns, row_number() OVER (PARTITION BY unit, t_ns) AS k FROM tr)"


@query(
    f"WITH {T}, {E}, s AS (SELECT unit, t_ns + {HOUR} + CAST(floor({_uniform_sql('unit')} * {19 * HOUR}) AS BIGINT) AS t FROM tr), w AS (SELECT unit, {_FIRST} + ((t - {_FIRST}) % {_LAST - _FIRST} + {_LAST - _FIRST}) % {_LAST - _FIRST} AS t_ns FROM s) "
    "SELECT unit, t_ns FROM w SEMI JOIN e ON w.t_ns BETWEEN e.start_ns AND e.end_ns"
)
def shift_timestamps(spark, sf_dir):
    return randomize.shift_timestamps(trains(spark, sf_dir).select("unit", "t_ns"), epochs(spark), HOUR, 20 * HOUR, "wrap", seed=1)


@query(
    f"WITH {T}, r AS (SELECT unit, t_ns, row_number() OVER w AS r, t_ns - lag(t_ns) OVER w AS d, min(t_ns) OVER (PARTITION BY unit) AS t0 FROM tr WINDOW w AS (PARTITION BY unit ORDER BY t_ns)), "
    f"k AS (SELECT *, CASE WHEN d IS NULL THEN -1 ELSE {_uniform_sql('unit', 'r')} END AS k FROM r) SELECT unit, CAST(t0 + sum(coalesce(d, 0)) OVER (PARTITION BY unit ORDER BY k, r) AS BIGINT) AS t_ns FROM k"
)
def shuffle_intervals(spark, sf_dir):
    return randomize.shuffle_intervals(trains(spark, sf_dir).select("unit", "t_ns"), seed=1)


@query(f"WITH {T}, {_APART} SELECT unit, t_ns + CAST(floor((2 * {_uniform_sql('unit', 't_ns', 'k')} - 1) * {HOUR}) AS BIGINT) AS t_ns FROM a")
def jitter_timestamps(spark, sf_dir):
    return randomize.jitter_timestamps(trains(spark, sf_dir).select("unit", "t_ns"), HOUR, seed=1)


@query(f"WITH {T}, {_APART} SELECT unit, {ORIGIN} + CAST(floor({_uniform_sql('unit', 't_ns', 'k')} * {30 * DAY}) AS BIGINT) AS t_ns FROM a")
def resample_timestamps(spark, sf_dir):
    return randomize.resample_timestamps(trains(spark, sf_dir).select("unit", "t_ns"), ORIGIN, ORIGIN + 30 * DAY, seed=1)


@query("SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """The streaming count in its batch form: the same plan, for which the watermark does nothing."""
    rows = windows.count_stream(table(spark, sf_dir, "events"), "ts", 3600, ["event_type"])
    return rows.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query(f"WITH {X}, s AS (SELECT unit, t_ns, sum(w) OVER (PARTITION BY unit ORDER BY t_ns) AS g FROM (SELECT unit, t_ns, CASE WHEN t_ns - lag(t_ns) OVER (PARTITION BY unit ORDER BY t_ns) <= {6 * HOUR} THEN 0 ELSE 1 END AS w FROM x)) SELECT unit, min(t_ns) // 1000 AS start_us, max(t_ns) // 1000 AS end_us, count(*) AS n FROM s GROUP BY unit, g")
def stream_support(spark, sf_dir):
    rows = windows.support_stream(table(spark, sf_dir, "events").withColumnRenamed("user_id", "unit"), "ts", 6 * 3600, ["unit"])
    return rows.select("unit", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")
