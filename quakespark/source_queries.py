"""Queries of the source and choice operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakespark.common import first_delivery, table
from quakespark.functions import mechanism as m
from quakespark.operators import source as src
from quakespark.operators import stats
from quakespark.plans.attenuation import resolve_corners

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Mechanisms from parts, as SQL and as DataFrame.
_MEC = "me as (select p_partkey as id, cast((p_partkey * 37) % 360 as double) as strike, cast(10 + (p_partkey * 13) % 80 as double) as dip, cast((p_partkey * 29) % 360 - 180 as double) as rake, 1.0 + (p_partkey % 3) as weight from part)"
_VEC = _MEC + """,
ve as (select *, -sin(radians(dip)) * sin(radians(strike)) as nn, sin(radians(dip)) * cos(radians(strike)) as ne, -cos(radians(dip)) as nd,
  cos(radians(rake)) * cos(radians(strike)) + cos(radians(dip)) * sin(radians(rake)) * sin(radians(strike)) as un,
  cos(radians(rake)) * sin(radians(strike)) - cos(radians(dip)) * sin(radians(rake)) * cos(radians(strike)) as ue,
  -sin(radians(dip)) * sin(radians(rake)) as ud from me)"""


def mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k.alias("id"), ((k * 37) % 360).cast("double").alias("strike"), (10 + (k * 13) % 80).cast("double").alias("dip"), ((k * 29) % 360 - 180).cast("double").alias("rake"), (1.0 + k % 3).alias("weight"))
    return p.withColumn("n", m.normal(F.col("strike"), F.col("dip"))).withColumn("u", m.slip(F.col("strike"), F.col("dip"), F.col("rake")))


@query("with " + _VEC + "select id, round(2 * nn * un, 6) as mnn, round(2 * ne * ue, 6) as mee, round(2 * nd * ud, 6) as mdd, round(nn * ue + ne * un, 6) as mne, round(nn * ud + nd * un, 6) as mnd, round(ne * ud + nd * ue, 6) as med from ve")
def f11_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = mechanisms(spark, sf_dir).withColumn("t", m.tensor(F.col("n"), F.col("u")))
    return t.select("id", *[F.round(f"t.{c}", 6).alias(f"m{c}") for c in ("nn", "ee", "dd", "ne", "nd", "ed")])


@query(
    "with " + _VEC + """
select id, round(degrees(asin(least(1.0, abs(nd + ud) / sqrt(2.0)))), 5) as t_plunge, round(degrees(asin(least(1.0, abs(nd - ud) / sqrt(2.0)))), 5) as p_plunge,
  round(degrees(asin(least(1.0, abs(nn * ue - ne * un)))), 5) as b_plunge,
  case when power(nd + ud, 2) / 2 > 0.59 then 'Thrust' when power(nd - ud, 2) / 2 > 0.75 then 'Normal' when power(nn * ue - ne * un, 2) > 0.75 then 'Strike-slip' else 'Oblique' end as style from ve
"""
)
def f12_axes_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mechanisms(spark, sf_dir)
    p, t, b = m.axes(F.col("n"), F.col("u"))
    a = lambda v: F.round(m.axis_angles(v)["plunge"], 5)
    return d.select("id", a(t).alias("t_plunge"), a(p).alias("p_plunge"), a(b).alias("b_plunge"), m.faulting_style(F.col("n"), F.col("u")).alias("style"))


@query("with " + _MEC + "select id, true as same from me")
def f12_auxiliary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The auxiliary plane's auxiliary plane is the plane itself: the double couples differ by no rotation."""
    d = mechanisms(spark, sf_dir).withColumn("x", m.auxiliary_plane(F.col("strike"), F.col("dip"), F.col("rake")))
    n2, u2 = m.normal(F.col("x.strike"), F.col("x.dip")), m.slip(F.col("x.strike"), F.col("x.dip"), F.col("x.rake"))
    return d.select("id", (m.kagan_angle(F.col("n"), F.col("u"), n2, u2) < 1e-4).alias("same"))


@query(
    "with " + _VEC + """,
ax as (select id, (nn + un) / sqrt(2.0) as t1, (ne + ue) / sqrt(2.0) as t2, (nd + ud) / sqrt(2.0) as t3, (nn - un) / sqrt(2.0) as p1, (ne - ue) / sqrt(2.0) as p2, (nd - ud) / sqrt(2.0) as p3 from ve),
ab as (select *, t2 * p3 - t3 * p2 as b1, t3 * p1 - t1 * p3 as b2, t1 * p2 - t2 * p1 as b3 from ax),
q as (select a.id, a.t1 * b.t1 + a.t2 * b.t2 + a.t3 * b.t3 as t, a.b1 * b.b1 + a.b2 * b.b2 + a.b3 * b.b3 as b, a.p1 * b.p1 + a.p2 * b.p2 + a.p3 * b.p3 as p from ab a join ab b on b.id = a.id + 1)
select id, round(least(degrees(acos(greatest(-1.0, least(1.0, (t + b + p - 1) / 2)))), degrees(acos(greatest(-1.0, least(1.0, (t - b - p - 1) / 2)))),
  degrees(acos(greatest(-1.0, least(1.0, (-t + b - p - 1) / 2)))), degrees(acos(greatest(-1.0, least(1.0, (-t - b + p - 1) / 2))))), 5) as kagan from q
"""
)
def f14_kagan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mechanisms(spark, sf_dir)
    o = d.select((F.col("id") - 1).alias("id"), F.col("n").alias("n2"), F.col("u").alias("u2"))
    return d.join(o, "id").select("id", F.round(m.kagan_angle(F.col("n"), F.col("u"), F.col("n2"), F.col("u2")), 5).alias("kagan"))


@query(
    "with " + _VEC + """,
pl as (select id, degrees(asin(least(1.0, abs(nd - ud) / sqrt(2.0)))) as p1, degrees(asin(least(1.0, abs(nn * ue - ne * un)))) as p2, degrees(asin(least(1.0, abs(nd + ud) / sqrt(2.0)))) as p3, nn, ne, un, ue from ve)
select id, case when p1 >= 52 and p3 <= 35 then 'NF' when p1 >= 40 and p1 < 52 and p3 <= 20 then 'NS' when (p1 < 40 and p3 <= 20 and p2 >= 45) or (p1 <= 20 and p3 < 40 and p2 >= 45) then 'SS'
  when p1 <= 20 and p3 >= 40 and p3 < 52 then 'TS' when p1 <= 35 and p3 >= 52 then 'TF' else 'U' end as regime,
  round(sin(atan2(-2 * (nn * ue + ne * un), -(2 * nn * un) + 2 * ne * ue)), 5) as sin2, round(cos(atan2(-2 * (nn * ue + ne * un), -(2 * nn * un) + 2 * ne * ue)), 5) as cos2 from pl
"""
)
def f15_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime and direction of compression, each mechanism's axes taken as those of the stress."""
    d = mechanisms(spark, sf_dir)
    p, t, b = (m.axis_angles(v)["plunge"] for v in m.axes(F.col("n"), F.col("u")))
    e = m.tensor(F.col("n"), F.col("u"))
    twice = F.radians(2 * m.shmax_azimuth(-e["ee"], -e["nn"], -e["ne"]))  # 0 and 180 degrees are one direction
    return d.select("id", m.stress_regime(p, b, t).alias("regime"), F.round(F.sin(twice), 5).alias("sin2"), F.round(F.cos(twice), 5).alias("cos2"))


@query(
    """
with x as (select distinct rid, magnitude as mag from quakes where magnitude is not null and not isnan(magnitude)),
f as (select rid, greatest(0.3, 0.37 * 3500 * cbrt(16 * 0.1 * 1e6 / (7 * power(10.0, 1.5 * mag + 9.1)))) as a, least(40.0, 0.37 * 3500 * cbrt(16 * 100.0 * 1e6 / (7 * power(10.0, 1.5 * mag + 9.1)))) as b,
  0.37 * 3500 * cbrt(16 * 100.0 * 1e6 / (7 * power(10.0, 1.5 * mag + 9.1))) as top from x)
select rid, round(case when b > a * 1.05 then a else 0.3 end, 6) as low, round(case when b > a * 1.05 then b when top < 0.3 then 0.45 else 40.0 end, 6) as high from f
"""
)
def f16_corner_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").where("magnitude is not null and not isnan(magnitude)").select("rid", "magnitude").distinct()
    c = m.corner_range(F.col("magnitude"))
    return q.select("rid", F.round(c["low"], 6).alias("low"), F.round(c["high"], 6).alias("high"))


@query(
    """
select event_id, round(case when f <= 1 or f >= 20 then 0 when f < 2 then 0.5 * (1 - cos(pi() * (f - 1) / 1.0)) when f > 15 then 0.5 * (1 + cos(pi() * (f - 15) / 5.0)) else 1 end, 6) as taper,
  round(case when abs((value - 30) / 25) < 1 then power(1 - power(abs((value - 30) / 25), 3), 3) else 0 end, 6) as weight
from (select event_id, value, cast(event_id % 250 as double) / 10 as f from events)
"""
)
def f17_tapers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = (F.col("event_id") % 250).cast("double") / 10
    return table(spark, sf_dir, "events").select("event_id", F.round(m.cosine_prefilter(f, 1, 2, 15, 20), 6).alias("taper"), F.round(m.tricube(F.col("value") - 30, 25.0), 6).alias("weight"))


@query(
    "with " + _MEC + """,
g as (select *, radians(strike) as s, radians(dip) as d, radians(rake) as r from me),
v as (select id, cos(s) * sin(d) as n1, -sin(s) * sin(d) as n2, cos(d) as n3, cos(r) * sin(s) - sin(r) * cos(s) * cos(d) as v1, cos(r) * cos(s) + sin(r) * sin(s) * cos(d) as v2, sin(r) * sin(d) as v3 from g),
t as (select *, 3 * n1 + 0.5 * n2 - 0.2 * n3 as t1, 0.5 * n1 - 1.5 * n2 + 0.7 * n3 as t2, -0.2 * n1 + 0.7 * n2 + 0.4 * n3 as t3 from v)
select id, round(t1 * v1 + t2 * v2 + t3 * v3, 6) as shear, round(t1 * n1 + t2 * n2 + t3 * n3, 6) as unclamping, round(t1 * v1 + t2 * v2 + t3 * v3 + 0.4 * (t1 * n1 + t2 * n2 + t3 * n3), 6) as coulomb from t
"""
)
def f20_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(*[F.lit(float(v)).alias(k) for k, v in dict(ee=3, nn=-1.5, uu=0.4, en=0.5, eu=-0.2, nu=0.7).items()])
    shear, open_ = m.resolve_stress(s, F.col("strike"), F.col("dip"), F.col("rake"))
    d = mechanisms(spark, sf_dir)
    return d.select("id", F.round(shear, 6).alias("shear"), F.round(open_, 6).alias("unclamping"), F.round(shear + 0.4 * open_, 6).alias("coulomb"))


_POL = "po as (select p_partkey // 50 as event, p_partkey as station, cast((p_partkey * 37) % 360 as double) + 0.137 as azimuth, cast(20 + (p_partkey * 17) % 140 as double) + 0.071 as takeoff, case when p_partkey % 3 = 0 then -1 else 1 end as polarity, case when p_partkey % 4 = 0 then 0.5 else 1.0 end as weight from part)"


def polarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(F.floor(k / 50).alias("event"), k.alias("station"), (((k * 37) % 360).cast("double") + 0.137).alias("azimuth"), ((20 + (k * 17) % 140).cast("double") + 0.071).alias("takeoff"), F.when(k % 3 == 0, -1).otherwise(1).alias("polarity"), F.when(k % 4 == 0, 0).otherwise(1).alias("manual"), k.alias("ordinal"))
    return src.first_readings(p, order="ordinal")


_MISFIT = _POL + """,
gr as (select cast(s as double) as strike, cast(d as double) as dip, cast(r as double) as rake from (select unnest(range(0, 360, 30)) as s), (select unnest(range(30, 91, 30)) as d), (select unnest(range(-180, 180, 30)) as r)),
gv as (select *, -sin(radians(dip)) * sin(radians(strike)) as nn, sin(radians(dip)) * cos(radians(strike)) as ne, -cos(radians(dip)) as nd,
  cos(radians(rake)) * cos(radians(strike)) + cos(radians(dip)) * sin(radians(rake)) * sin(radians(strike)) as un,
  cos(radians(rake)) * sin(radians(strike)) - cos(radians(dip)) * sin(radians(rake)) * cos(radians(strike)) as ue, -sin(radians(dip)) * sin(radians(rake)) as ud from gr),
pv as (select *, sin(radians(takeoff)) * cos(radians(azimuth)) as gn, sin(radians(takeoff)) * sin(radians(azimuth)) as ge, cos(radians(takeoff)) as gd from po),
am as (select event, strike, dip, rake, polarity, weight, 2 * (nn * gn + ne * ge + nd * gd) * (un * gn + ue * ge + ud * gd) as amp from pv, gv),
mi as (select event, strike, dip, rake, sum(case when sign(amp) <> polarity then weight else 0 end) / sum(weight) as misfit, count(*) as n from am group by all)
"""


@query("with " + _MISFIT + "select event, strike, dip, rake, round(misfit, 6) as misfit, n from mi")
def n25_first_motion_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misfit of every mechanism of a grid (30 degrees) for every event."""
    return src.polarity_misfit(polarities(spark, sf_dir), 30.0).select("event", "strike", "dip", "rake", F.round("misfit", 6).alias("misfit"), "n")


@query(
    "with " + _MISFIT + """,
b as (select *, min(misfit) over (partition by event) as least from mi)
select event, strike, dip, rake from b where misfit <= least + greatest(1.0, sqrt(n * 0.1 * 0.9)) / n + 1e-12
"""
)
def n25_acceptable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.acceptable_mechanisms(src.polarity_misfit(polarities(spark, sf_dir), 30.0)).select("event", "strike", "dip", "rake")


@query("with " + _MEC + "select id from me where dip > 0 and dip <= 90 and weight > 0 and id % 5 in (0, 1)")
def pr9_valid_mechanisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mechanisms with a whole second plane or none; of five parts two are left with none of it, one with a part of it."""
    k = F.col("id") % 5
    d = mechanisms(spark, sf_dir).select("id", "weight", F.col("dip").alias("dip1"), F.when(k == 0, F.col("strike")).alias("strike2"), F.when(k.isin(0, 2), F.col("dip")).alias("dip2"), F.when(k.isin(0, 3, 4), F.col("rake")).alias("rake2"))
    return src.valid_mechanisms(d).select("id")


def _normal_sql() -> str:
    basis = [("nn", "0", "-nd"), ("ne", "nn", "0"), ("nd", "0", "nn"), ("0", "ne", "-nd"), ("0", "nd", "ne")]
    n, u = ("nn", "ne", "nd"), ("un", "ue", "ud")
    cols = [[f"({t[k]} - ({t[0]} * nn + {t[1]} * ne + {t[2]} * nd) * {n[k]})" for k in range(3)] for t in basis]
    out = [f"round(sum(weight * ({' + '.join(f'{cols[i][k]} * {cols[j][k]}' for k in range(3))})), 6) as a{i}{j}" for i in range(5) for j in range(i, 5)]
    out += [f"round(sum(weight * ({' + '.join(f'{cols[i][k]} * {u[k]}' for k in range(3))})), 6) as b{i}" for i in range(5)]
    return "with " + _VEC + " select " + ", ".join(out) + " from ve"


@query(_normal_sql())
def a14_stress_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.stress_normal_equations(mechanisms(spark, sf_dir).select("strike", "dip", "rake", "weight"))
    return e.select(*[F.round(c, 6).alias(c) for c in e.columns])


_PLACES = "pl as (select p_partkey as id, cast((p_partkey * 7) % 1000 as double) / 10 as x, cast((p_partkey * 11) % 1000 as double) / 10 as y, cast((p_partkey * 3) % 200 as double) / 10 as z from part), nd as (select cast(i as bigint) as node, cast(i % 10 * 10 as double) as x, cast(i // 10 % 10 * 10 as double) as y, cast(i // 100 * 10 as double) as z from range(200) t(i))"


@query(
    "with " + _PLACES + """,
w as (select node, id, exp(-4.5 * ((pl.x - nd.x) ** 2 / 625.0 + (pl.y - nd.y) ** 2 / 625.0 + (pl.z - nd.z) ** 2 / 81.0)) as weight from nd, pl where (pl.x - nd.x) ** 2 / 625.0 + (pl.y - nd.y) ** 2 / 625.0 + (pl.z - nd.z) ** 2 / 81.0 <= 1)
select node, count(*) as n, round(power(sum(weight), 2) / sum(weight * weight), 6) as effective_n from w group by node
"""
)
def j16_stress_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    mec = table(spark, sf_dir, "part").select(k.alias("id"), (((k * 7) % 1000).cast("double") / 10).alias("x"), (((k * 11) % 1000).cast("double") / 10).alias("y"), (((k * 3) % 200).cast("double") / 10).alias("z"))
    i = F.col("id")
    nodes = spark.range(200).select(i.alias("node"), (i % 10 * 10).cast("double").alias("x"), (F.floor(i / 10) % 10 * 10).cast("double").alias("y"), (F.floor(i / 100) * 10).cast("double").alias("z"))
    w = src.weighted_neighbours(nodes, mec, radius_km=25.0, half_height_km=9.0)
    e = src.effective_count(w, "node").join(w.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node")
    return e.select("node", "n", F.round("effective_n", 6).alias("effective_n"))


_CURVE = "cu as (select s_suppkey % 5 as smoothing, s_suppkey as damping, 10.0 + s_suppkey * s_suppkey * 0.01 as residual, 5.0 + 100.0 / (1 + s_suppkey) as model from supplier)"


@query(
    "with " + _CURVE + """,
l as (select *, ln(residual) as x, ln(model) as y from cu),
s as (select *, (x - min(x) over w) / (max(x) over w - min(x) over w) as xs, (y - min(y) over w) / (max(y) over w - min(y) over w) as ys from l window w as (partition by smoothing)),
e as (select *, first(xs) over o as ax, first(ys) over o as ay, last(xs) over o as bx, last(ys) over o as by_ from s window o as (partition by smoothing order by damping rows between unbounded preceding and unbounded following)),
d as (select *, abs((bx - ax) * (ay - ys) - (ax - xs) * (by_ - ay)) / sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) as dist from e)
select smoothing, max(damping) as damping from (select *, max(dist) over (partition by smoothing) as best from d) where dist >= best - 1e-12 group by smoothing
"""
)
def w15_curve_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier").select((k % 5).alias("smoothing"), k.alias("damping"), (10.0 + k * k * 0.01).alias("residual"), (5.0 + 100.0 / (1 + k)).alias("model"))
    return src.curve_corner(c, ["smoothing"], "damping", "residual", "model").select("smoothing", "damping")


@query(
    """
with e as (select distinct rid as event, magnitude, (rid * 7919) % 100 < 20 + 15 * magnitude as resolved from quakes where magnitude is not null and not isnan(magnitude)),
k as (select greatest(5, count(*) // 6) as k, count(*) as n from e),
r as (select *, row_number() over (order by magnitude, event) as r from e),
f as (select a.event, a.magnitude, avg(cast(b.resolved as int)) as fraction from r a, k, r b where b.r between a.r and a.r + k.k - 1 and a.r <= k.n - k.k + 1 group by a.event, a.magnitude)
select event, magnitude, round(fraction, 6) as fraction from f
"""
)
def w7_magnitude_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "quakes").where("magnitude is not null and not isnan(magnitude)")
    e = q.select(F.col("rid").alias("event"), "magnitude", ((F.col("rid") * 7919) % 100 < 20 + 15 * F.col("magnitude")).alias("resolved")).distinct()
    return src.magnitude_windows(e).withColumn("fraction", F.round("fraction", 6))


_SPEC = "sp as (select fit_id, k, freq[k] as f, signal[k] as s, noise[k] as z, used[k] as used, len(freq) as n from (select distinct fit_id, freq, signal, noise, used, unnest(range(1, len(freq) + 1)) as k from spectrum_fits))"


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fit_id, k, f, s, z, used): samples of the spectra, once a fit."""
    t = table(spark, sf_dir, "spectrum_fits").select("fit_id", "freq", "signal", "noise", "used").dropDuplicates(["fit_id"])
    z = t.select("fit_id", F.size("freq").alias("n"), F.posexplode(F.arrays_zip("freq", "signal", "noise", "used")).alias("k", "v"))
    return z.select("fit_id", (F.col("k") + 1).cast("long").alias("k"), F.col("v.freq").alias("f"), F.col("v.signal").alias("s"), F.col("v.noise").alias("z"), F.col("v.used").alias("used"), "n")


@query(
    "with " + _SPEC + """,
o as (select *, coalesce(s / z >= 3, false) as ok from sp),
l as (select *, coalesce(ok = lag(ok) over (partition by fit_id order by k), false) as same from o),
r as (select *, sum(case when same then 0 else 1 end) over (partition by fit_id order by k rows unbounded preceding) as run from l),
g as (select fit_id, run, min(k) as first, max(k) as last, count(*) as n from r where ok group by all)
select fit_id, first, last, n from g qualify row_number() over (partition by fit_id order by n desc, run) = 1
"""
)
def w13_longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest unbroken band of a spectrum above three times the noise."""
    return src.longest_run_above(spectra(spark, sf_dir), "fit_id", "k", F.col("s") / F.col("z") >= 3)


@query(
    "with " + _SPEC + """,
g as (select fit_id, k, f, sum((ln(s) + ln(1 + (f2 / f) ** 2) - 1) ** 2) as rss, any_value(n) as n from (select a.fit_id, a.k, a.f, b.s, b.f as f2, a.n from sp a join sp b on a.fit_id = b.fit_id where b.s > 0) group by all),
b as (select *, min_by(k, (rss, k)) over (partition by fit_id) as best, min(rss) over (partition by fit_id) as least from g),
i as (select *, rss <= least * (1 + 3.84 / greatest(1, n - 2)) as inside from b),
l as (select *, coalesce(inside = lag(inside) over (partition by fit_id order by k), false) as same from i),
r as (select *, sum(case when same then 0 else 1 end) over (partition by fit_id order by k rows unbounded preceding) as run from l)
select fit_id, any_value(best) as best, min(k) as low, max(k) as high from r group by fit_id, run having min(k) <= any_value(best) and max(k) >= any_value(best)
"""
)
def w14_corner_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner frequencies, out of each spectrum's own, that fit about as well as the best."""
    s = spectra(spark, sf_dir)
    o = s.where("s > 0").select("fit_id", F.col("s").alias("s2"), F.col("f").alias("f2"))
    g = s.select("fit_id", "k", "f", "n").join(o, "fit_id").groupBy("fit_id", "k", "f", "n").agg(F.sum(F.pow(F.ln("s2") + F.ln(1 + F.pow(F.col("f2") / F.col("f"), 2)) - 1, 2)).alias("rss"))
    return src.corner_interval(g, "fit_id", "k", "rss", 2, "n")


@query("with " + _SPEC + "select fit_id, round(corr(f, ln(s)), 6) as r, corr(f, ln(s)) < -0.5 as decays from sp where s > 0 group by fit_id")
def a28_spectral_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spectra(spark, sf_dir).where("s > 0").groupBy("fit_id").agg(F.corr("f", F.ln("s")).alias("r"))
    return g.select("fit_id", F.round("r", 6).alias("r"), (F.col("r") < -0.5).alias("decays"))


@query("with " + _SPEC + "select fit_id, cast(floor(6 * log2(f)) as bigint) as bin, round(sqrt(avg(s * s)), 9) as amplitude, count(*) as n from sp where s is not null and not isnan(s) group by all")
def a23_octave_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power averages of spectra in sixths of an octave."""
    s = spectra(spark, sf_dir).where("s is not null and not isnan(s)")
    return s.groupBy("fit_id", F.floor(6 * F.log2("f")).alias("bin")).agg(F.round(F.sqrt(F.avg(F.col("s") * F.col("s"))), 9).alias("amplitude"), F.count(F.lit(1)).alias("n"))


@query(
    """
with s as (
  select fit_id, event_id, corner_hz, tstar_error, list_max(freq) as top from spectrum_fits where fit_id is not null and len(freq) > 0
  qualify row_number() over (partition by fit_id order by measured_at nulls last) = 1),
m as (select event_id, list_sort(list(top))[count(*) // 2 + 1] as top from s group by event_id),
r as (select fit_id, coalesce(not isnan(corner_hz) and corner_hz <= m.top / 3, false) as resolved, tstar_error from s join m on s.event_id is not distinct from m.event_id)
select fit_id, resolved, not resolved as disabled, round(sqrt(tstar_error ** 2 + (0.5 * tstar_error) ** 2), 9) as error from r
"""
)
def pr12_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved corners of each event's spectra; half of each uncertainty stands for the change across the corner's interval."""
    s = table(spark, sf_dir, "spectrum_fits").where(F.size("freq") > 0)
    s = first_delivery(s, "fit_id", "measured_at", ["event_id", "corner_hz", "tstar_error", "freq"])
    s = s.select("fit_id", "event_id", "corner_hz", "tstar_error", F.array_max("freq").alias("fit_max_hz"), (0.5 * F.col("tstar_error")).alias("corner_trade_off"))
    r = resolve_corners(s, ["event_id"], exclude=True)
    return r.select("fit_id", F.col("corner_resolved").alias("resolved"), "disabled", F.round("tstar_error", 9).alias("error"))
