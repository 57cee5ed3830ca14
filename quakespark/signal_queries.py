"""Queries of the signal operators over the embedding vectors as traces, and SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import table
from quakespark.functions import signal as sg
from quakespark.operators import traces as tr

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Traces: the vectors, with an onset at sample 40 where they become 20 times larger.
_TR = "t as (select vec_id, i, cast(embedding[i + 1] as double) * case when i >= 40 then 20 else 1 end as x, len(embedding) as n from (select vec_id, embedding, unnest(range(len(embedding))) as i from embeddings))"


def traces(spark: SparkSession, sf_dir: str, onset: int = 40) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = F.transform("embedding", lambda v, i: v.cast("double") * F.when(i >= onset, 20.0).otherwise(1.0))
    return e.select("vec_id", x.alias("samples"), F.lit(100.0).alias("rate"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.samples_table(traces(spark, sf_dir), "vec_id", "samples")


@query("with " + _TR + "select vec_id, count(*) as n, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as rms, round(max(abs(x)), 6) as max_abs, round(regr_slope(x, i), 6) as trend from t group by vec_id")
def g1_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tr.moments(_rows(spark, sf_dir), "vec_id")
    return m.withColumns({c: F.round(c, 6) for c in ("mean", "rms", "max_abs", "trend")})


@query(
    "with " + _TR + """,
f as (select vec_id, regr_slope(x, i) as b, regr_intercept(x, i) as a from t group by vec_id)
select vec_id, cast(i as int) as i, round(x - a - b * i, 6) as y from t join f using (vec_id)
"""
)
def g1_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tr.apply(traces(spark, sf_dir), lambda x, r: sg.detrend(sg.demean(x)))
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("y"))


@query("with " + _TR + "select vec_id, cast(i as int) as i, round(x * case when i < 6 then 0.5 * (1 - cos(pi() * i / 6)) when i >= 58 then 0.5 * (1 - cos(pi() * (63 - i) / 6)) else 1 end, 6) as y from t")
def g1_taper(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tr.apply(traces(spark, sf_dir), lambda x, r: sg.taper(x, 0.1))
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("y"))


_AIC = _TR + """,
s as (select *, sum(x) over u as s1, sum(x * x) over u as s2, sum(x) over w as t1, sum(x * x) over w as t2 from t
  window u as (partition by vec_id order by i rows between unbounded preceding and 1 preceding), w as (partition by vec_id)),
a as (select vec_id, i, i * ln(greatest(s2 / i - power(s1 / i, 2), 1e-30)) + (n - i - 1) * ln(greatest((t2 - s2) / (n - i) - power((t1 - s1) / (n - i), 2), 1e-30)) as aic from s where i >= 1 and i < n - 1)
"""


@query("with " + _AIC + "select vec_id, cast(min_by(i, (round(aic, 9), i)) as int) as onset from a group by vec_id")
def w8_aic_onset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.aic_onsets(_rows(spark, sf_dir), "vec_id")


@query("with " + _AIC + "select vec_id, cast(min_by(i, (round(aic, 9), i)) as int) as onset from a group by vec_id")
def g14_aic_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same onsets by the kernel that the picker uses."""

    d = tr.apply(traces(spark, sf_dir), lambda x, r: np.array([sg.aic_onset(x)], float))
    return d.select("vec_id", F.col("samples")[0].cast("int").alias("onset"))


@query(
    "with recursive " + _TR + """,
e as (select vec_id, i, x * x as e, avg(x * x) over (partition by vec_id) as e0 from t),
r(vec_id, i, s, l) as (
  select vec_id, cast(0 as bigint), e0 + (e - e0) / 50.0, e0 + (e - e0) / 500.0 from e where i = 0
  union all
  select e.vec_id, e.i, r.s + (e.e - r.s) / 50.0, r.l + (e.e - r.l) / 500.0 from r join e on e.vec_id = r.vec_id and e.i = r.i + 1)
select vec_id, cast(i as int) as i, round(s / l, 6) as ratio from r
"""
)
def g12_sta_lta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive averages; traces are shorter than the first second, so all of it starts them."""
    d = tr.apply(traces(spark, sf_dir), lambda x, r: sg.sta_lta(x, r))
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("ratio"))


@query(
    "with " + _TR + """,
q as (select vec_id, i, round(x, 0) as x from t),
r as (select *, max(abs(x)) over (partition by vec_id) as top, case when x = lag(x) over (partition by vec_id order by i) then 0 else 1 end as new from q),
g as (select *, sum(new) over (partition by vec_id order by i rows unbounded preceding) as run from r),
h as (select vec_id, run, count(*) as n, first(x) as x, first(top) as top from g group by all)
select vec_id, max(n) as longest, count(*) filter (where abs(x) >= top and n >= 3) as plateaus from h group by vec_id
"""
)
def w10_constant_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.constant_runs(_rows(spark, sf_dir).withColumn("x", F.round("x", 0)), "vec_id")


@query(
    "with " + _TR + """,
x as (select vec_id, i, x / case when i >= 40 then 20 else 1 end + case when i = 10 then 100 else 0 end as x from t),
d as (select *, lag(x) over w as a, lead(x) over w as b from x window w as (partition by vec_id order by i)),
m as (select vec_id, greatest(1e-12, list_sort(list(abs(x - a)))[count(x - a) // 2 + 1]) as mad from d where a is not null group by vec_id)
select vec_id, count(*) filter (where sign(x - a) = sign(x - b) and least(abs(x - a), abs(x - b)) > 25 * mad and abs(b - a) < 5 * mad) as spikes from d join m using (vec_id) group by vec_id
"""
)
def w11_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir).withColumn("x", F.col("x") / F.when(F.col("i") >= 40, 20.0).otherwise(1.0) + F.when(F.col("i") == 10, 100.0).otherwise(0.0))
    return tr.spike_counts(r, "vec_id")


@query(
    """
with s as (select user_id % 20 as ch, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id % 20 order by ts, event_id) as r from events),
d as (select ch, t - lag(t + 60) over (partition by ch order by r) as gap from s)
select ch, round(sum(greatest(gap, 0)), 3) as gaps, round(sum(greatest(-gap, 0)), 3) as overlaps from d group by ch
"""
)
def w12_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overlaps between successive minutes of a channel."""
    s = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("ch"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_id", "ts")
    gap = F.col("t") - F.lag(F.col("t") + 60).over(Window.partitionBy("ch").orderBy("ts", "event_id"))
    d = s.select("ch", gap.alias("gap"))
    return d.groupBy("ch").agg(F.round(F.sum(F.greatest("gap", F.lit(0.0))), 3).alias("gaps"), F.round(F.sum(F.greatest(-F.col("gap"), F.lit(0.0))), 3).alias("overlaps"))


@query("with " + _TR + "select vec_id, cast(i as int) as i, round(-x * cos(radians(30.0)) - y * sin(radians(30.0)), 6) as radial, round(x * sin(radians(30.0)) - y * cos(radians(30.0)), 6) as transverse from (select vec_id, i, x, n, lag(x, 1, 0) over (partition by vec_id order by i) as y from t)")
def g5_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radial and transverse of two aligned horizontals (a trace and itself a sample later)."""
    r = _rows(spark, sf_dir).withColumn("y", F.lag("x", 1, 0.0).over(Window.partitionBy("vec_id").orderBy("i")))
    a = F.radians(F.lit(30.0))
    return r.select("vec_id", "i", F.round(-F.col("x") * F.cos(a) - F.col("y") * F.sin(a), 6).alias("radial"), F.round(F.col("x") * F.sin(a) - F.col("y") * F.cos(a), 6).alias("transverse"))


@query(
    """
with p as (select a.vec_id, list_cosine_similarity(cast(a.embedding[5:60] as double[]), cast(b.embedding[5:60] as double[])) as cc from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)
select vec_id, round(cc, 6) as cc from p
"""
)
def g18_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised correlation of neighbouring traces at lag 0."""
    t = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 5, 56), lambda v: v.cast("double")).alias("a"))
    o = t.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    s = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    return t.join(o, "vec_id").select("vec_id", F.round(s("a", "b") / F.sqrt(s("a", "a") * s("b", "b")), 6).alias("cc"))


@query("with " + _TR + ", s as (select vec_id, sqrt(sum(x * x)) as norm, n from t group by vec_id, n) select vec_id, round(norm, 6) as norm from s")
def g8_parseval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm of each trace from its spectrum."""

    def norm(x: np.ndarray, rate: float) -> np.ndarray:
        f = np.fft.rfft(x)
        p = np.abs(f) ** 2
        return np.array([np.sqrt((p[0] + 2 * p[1:-1].sum() + p[-1]) / len(x))])

    return tr.apply(traces(spark, sf_dir), norm).select("vec_id", F.round(F.col("samples")[0], 6).alias("norm"))


@query()
def g2_filtered_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of each trace after a processing chain: detrend, taper, zero-phase band-pass, notch."""
    c = tr.chain(traces(spark, sf_dir), [{"kind": "detrend"}, {"kind": "taper"}, {"kind": "filter", "low_hz": 2.0, "high_hz": 20.0}, {"kind": "notch", "hz": 30.0}])
    return c.select("vec_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v), 6).alias("energy"))


@query()
def g9_multitaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multitaper spectrum of each trace, its largest amplitude and where."""

    def top(x: np.ndarray, rate: float) -> np.ndarray:
        f, a = sg.multitaper_spectrum(x, rate)
        return np.array([f[np.argmax(a)], a.max()])

    s = tr.apply(traces(spark, sf_dir), top)
    return s.select("vec_id", F.round(F.col("samples")[0], 6).alias("hz"), F.round(F.col("samples")[1], 9).alias("amplitude"))


def _kernel(spark: SparkSession, sf_dir: str, rate: float, kernel, columns: list[str]) -> DataFrame:
    """Numbers that a kernel gives for each trace at a rate, one column each; traces for which it gives none are left out."""
    d = tr.apply(traces(spark, sf_dir).withColumn("rate", F.lit(rate)), kernel).where(F.size("samples") > 0)
    return d.select("vec_id", *[F.round(F.col("samples")[i], 6).alias(c) if c in ("snr", "uncertainty", "ratio") else F.col("samples")[i].cast("int").alias(c) for i, c in enumerate(columns)])


# 6 samples a second: averages of 3 and 30 samples, no trigger before sample 30, windows of 18 samples around sample 40.
_PICK = "with recursive " + _TR + """,
e as (select vec_id, i, x, x * x as e, avg(x * x) filter (where i < 6) over (partition by vec_id) as e0 from t),
r(vec_id, i, s, l) as (
  select vec_id, cast(0 as bigint), e0 + (e - e0) / 3.0, e0 + (e - e0) / 30.0 from e where i = 0
  union all
  select e.vec_id, e.i, r.s + (e.e - r.s) / 3.0, r.l + (e.e - r.l) / 30.0 from r join e on e.vec_id = r.vec_id and e.i = r.i + 1),
c as (select vec_id, i, s / l as cf from r),
w as (select *, lag(cf) over (partition by vec_id order by i) as before, max(cf) over (partition by vec_id order by i rows between current row and 5 following) as peak from c),
u as (select *, max(peak) over (partition by vec_id) as strongest from w where cf >= 3.5 and before < 3.5 and i between 30 and 58),
g as (select vec_id, min_by(i, (abs(i - 40), i)) as trigger from u where peak >= 0.5 * strongest group by vec_id),
y as (select vec_id, trigger, greatest(0, trigger - 12) as a, least(63, trigger + 3) as b from g),
q as (select y.vec_id, trigger, a, i - a as k, b - a + 1 as m, x from y join t on t.vec_id = y.vec_id and i between a and b),
p as (select *, sum(x) over o as s1, sum(x * x) over o as s2, sum(x) over v as t1, sum(x * x) over v as t2 from q
  window o as (partition by vec_id order by k rows between unbounded preceding and 1 preceding), v as (partition by vec_id)),
f as (
  select vec_id, any_value(trigger) as trigger,
    any_value(a) + min_by(k, (round(k * ln(greatest(s2 / k - power(s1 / k, 2), 1e-30)) + (m - k - 1) * ln(greatest((t2 - s2) / (m - k) - power((t1 - s1) / (m - k), 2), 1e-30)), 9), k)) as onset
  from p where k >= 1 and k < m - 1 group by vec_id),
n as (
  select f.vec_id, trigger, onset, max(abs(x)) filter (where i >= onset) / sqrt(avg(x * x) filter (where i < onset)) as snr,
    count(*) filter (where i < onset) as before, count(*) filter (where i >= onset) as after
  from f join t on t.vec_id = f.vec_id and i >= onset - 12 and i < onset + 6 group by all),
k as (select *, case when snr >= 20 then 0 when snr >= 10 then 1 when snr >= 5 then 2 else 3 end as quality from n where before >= 5 and after >= 5 and snr >= 3)
select vec_id, cast(trigger as int) as trigger_index, cast(onset as int) as onset_index, round(snr, 6) as snr, quality,
  round(greatest(2 / 6.0, case quality when 0 then 0.03 when 1 then 0.06 when 2 then 0.12 else 0.25 end * 1.5), 6) as uncertainty from k
"""


@query(_PICK)
def g14_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S picks by trigger, AIC onset, signal-to-noise ratio and class, on unfiltered traces."""
    names = ["trigger_index", "onset_index", "snr", "quality", "uncertainty"]

    def kernel(x: np.ndarray, rate: float) -> np.ndarray:
        r = sg.pick_phase(x, rate, 40, int(3 * rate), phase="S")
        return np.array([r[c] for c in names] if r else [], float)

    return _kernel(spark, sf_dir, 6.0, kernel, names)


@query(
    "with " + _TR + """,
n as (select vec_id, max(abs(x)) filter (where i >= 40) / sqrt(avg(x * x) filter (where i < 40)) as snr from t where i >= 20 and i < 50 group by vec_id)
select vec_id, round(snr, 6) as snr, case when snr >= 20 then 0 when snr >= 10 then 1 when snr >= 5 then 2 else 3 end as quality from n
"""
)
def g13_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-to-noise ratio at sample 40 with 10 samples a second, and its class."""

    def kernel(x: np.ndarray, rate: float) -> np.ndarray:
        snr = sg.onset_snr(x, 40, rate)
        return np.array([snr, sg.snr_quality(snr)])

    return _kernel(spark, sf_dir, 10.0, kernel, ["snr", "quality"])


# 16 samples a second, pick at sample 40 with an uncertainty of 0.15 s: noise from 8 to 35 (not included), search from 38 to 44, swing of 3 samples.
@query(
    "with " + _TR + """,
m as (select vec_id, avg(x) as mean, stddev_pop(x) as sd from t where i >= 8 and i < 36 group by vec_id),
y as (select t.vec_id, i, x - mean as y, sd from t join m using (vec_id) where i between 38 and 44),
f as (select vec_id, min(i) as k, any_value(sd) as sd from y where abs(y) >= 4 * sd group by vec_id),
s as (select y.vec_id, i, k, f.sd, y * sign(first(y) over (partition by y.vec_id order by i)) as v, sign(first(y) over (partition by y.vec_id order by i)) as up
  from y join f using (vec_id) where i between k and k + 3),
r as (select *, min(v) over (partition by vec_id order by i rows unbounded preceding) as least from s)
select vec_id, cast(-max(up) as int) as polarity, round(max(v) / max(sd), 6) as ratio from r where least > 0 group by vec_id
"""
)
def g15_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First motion of a channel that is positive down."""

    def kernel(x: np.ndarray, rate: float) -> np.ndarray:
        p, ratio = sg.polarity(x, 40, rate, uncertainty_s=0.15, dip=90.0)
        return np.array([p, ratio] if p else [])

    return _kernel(spark, sf_dir, 16.0, kernel, ["polarity", "ratio"])


_LANCZOS = "case when abs(d) < 1e-12 then 1 when abs(d) >= 8 then 0 else 8 * sin(pi() * d) * sin(pi() * d / 8) / (pi() * pi() * d * d) end"


@query(
    "with " + _TR + """,
o as (select unnest(range(158)) as j),
w as (select vec_id, j, x, """ + _LANCZOS + """ as w from (select vec_id, j, x, j * 100 / 250.0 - i as d from t cross join o))
select vec_id, cast(j as int) as i, round(sum(w * x) / sum(w), 6) as y from w group by vec_id, j
"""
)
def g4_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces at 2.5 times their rate."""
    d = tr.chain(traces(spark, sf_dir), [{"kind": "resample", "rate_hz": 250.0}])
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("y"))


@query(
    "with recursive " + _TR + """,
k as (select sin(2 * pi() * 30 / 100.0) / 60 as a, cos(2 * pi() * 30 / 100.0) as c),
r(vec_id, i, y, z1, z2) as (
  select vec_id, cast(0 as bigint), x / (1 + a), -2 * c / (1 + a) * x + 2 * c / (1 + a) * x / (1 + a), x / (1 + a) - (1 - a) / (1 + a) * x / (1 + a) from t, k where i = 0
  union all
  select t.vec_id, t.i, t.x / (1 + a) + z1, -2 * c / (1 + a) * t.x + 2 * c / (1 + a) * (t.x / (1 + a) + z1) + z2, t.x / (1 + a) - (1 - a) / (1 + a) * (t.x / (1 + a) + z1)
  from r join t on t.vec_id = r.vec_id and t.i = r.i + 1, k)
select vec_id, cast(i as int) as i, round(y, 6) as y from r
"""
)
def g3_notch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notch at 30 Hz, sample by sample."""
    d = tr.chain(traces(spark, sf_dir), [{"kind": "notch", "hz": 30.0}])
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("y"))


@query("select cast(i as int) as i, cast(j as int) as j, case when i = j then 1.0 else 0.0 end as product, true as concentrated from (select unnest(range(4)) as i), (select unnest(range(4)) as j)")
def g9_tapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar products of the tapers that the multitaper spectrum of the traces uses, and whether the energy of each lies in its band."""
    n = traces(spark, sf_dir).select(F.size("samples")).first()[0]
    v, r = sg.slepian(n, 2.5, 4)
    p = v @ v.T
    return spark.createDataFrame([(i, j, abs(round(float(p[i, j]), 6)), bool(r[i] > 0.9)) for i in range(4) for j in range(4)], "i int, j int, product double, concentrated boolean")


@query(
    "with recursive " + _TR + """,
c as (select tan(pi() * 10 / 100) as k, sqrt(2) as q), d as (select k * k / (1 + q * k + k * k) as b, 2 * (k * k - 1) / (1 + q * k + k * k) as a1, (1 - q * k + k * k) / (1 + q * k + k * k) as a2 from c),
r(vec_id, i, y, z1, z2) as (
  select vec_id, cast(0 as bigint), b * x, 2 * b * x - a1 * b * x, b * x - a2 * b * x from t, d where i = 0
  union all
  select t.vec_id, t.i, b * t.x + z1, 2 * b * t.x - a1 * (b * t.x + z1) + z2, b * t.x - a2 * (b * t.x + z1) from r join t on t.vec_id = r.vec_id and t.i = r.i + 1, d)
select vec_id, cast(i as int) as i, round(y, 6) as y from r
"""
)
def g2_lowpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A causal low-pass of order 2 at 10 Hz, sample by sample."""
    d = tr.chain(traces(spark, sf_dir), [{"kind": "filter", "high_hz": 10.0, "order": 2, "zero_phase": False}])
    return tr.samples_table(d, "vec_id", "samples").select("vec_id", "i", F.round("x", 6).alias("y"))
