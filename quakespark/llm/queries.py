"""Queries of the training-data operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.common import Scratch, first_delivery, table
from quakespark.llm.components import connected_groups
from quakespark.llm.encodings import find_garbled
from quakespark.llm.leakage import find_leaks, remove_leaked
from quakespark.llm.nearest_time import match_nearest
from quakespark.llm.percentiles import count_ladder, exact_percentiles, ladder_percentiles, merge_ladders
from quakespark.llm.tokenizer import BYTE_BPE_50K, decode_texts, encode_texts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# 1. Nearest time

#: Phase labels that are read as P or S.
PHASES = {"P": "P", "Pg": "P", "Pn": "P", "Pb": "P", "S": "S", "Sg": "S", "Sn": "S", "Sb": "S"}
TOLERANCE_S = {"P": 0.4, "S": 0.8}
DISABLED = 1 << 15


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    auto = table(spark, sf_dir, "auto_picks").select("auto_id", F.upper("station").alias("station"), labels[F.col("phase")].alias("phase"), "time")
    # `distinct` of a few hundred channels; Catalyst broadcasts it while its size is below the session's threshold.
    stations = table(spark, sf_dir, "channels").select("cid", F.upper(F.concat_ws(".", "network", "station")).alias("station")).distinct()
    kind = F.col("flags").bitwiseAND(15)
    picks = table(spark, sf_dir, "picks").where((kind <= 1) & (F.col("flags").bitwiseAND(DISABLED) == 0) & F.col("time").isNotNull() & F.col("cid").isNotNull())
    picks = picks.select("pick_id", "cid", F.when(kind == 0, "P").otherwise("S").alias("phase"), "time").join(stations, "cid")
    tolerance = F.when(F.col("phase") == "P", TOLERANCE_S["P"]).otherwise(TOLERANCE_S["S"])
    return match_nearest(auto, picks, by=["station", "phase"], time="time", ids=("auto_id", "pick_id"), tolerance_s=tolerance, max_tolerance_s=max(TOLERANCE_S.values()))


@query(
    """
with a as (
  select distinct auto_id, upper(station) as st, left(phase, 1) as ph, time from auto_picks
  where time is not null and phase in ('P', 'Pg', 'Pn', 'Pb', 'S', 'Sg', 'Sn', 'Sb')),
c as (select distinct cid, upper(network || '.' || station) as st from channels),
p as (
  select distinct pick_id, c.st, case when flags & 15 = 0 then 'P' else 'S' end as ph, time
  from picks join c using (cid) where flags & 15 <= 1 and flags & 32768 = 0 and time is not null),
near as (
  select a.auto_id, p.pick_id, abs(epoch_us(p.time) - epoch_us(a.time)) as gap, a.ph
  from a join p on a.st = p.st and a.ph = p.ph and p.time between a.time - interval 800 milliseconds and a.time + interval 800 milliseconds)
select auto_id, min_by(pick_id, gap) as pick_id from near
where gap <= case when ph = 'P' then 400000 else 800000 end group by auto_id
"""
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir).select("auto_id", "pick_id")


# 3. Percentiles

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: Values that stand for "not measured".
NO_RESIDUAL = [99.99, 9999.0, -999.0, -999000.0]
NO_TSTAR = [99.0, -1.0, -999.0]


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First deliveries of measured residuals, as a table of (station, phase, day, residual)."""
    r = F.col("residual")
    picks = first_delivery(table(spark, sf_dir, "picks"), "pick_id", "loaded_at", ["cid", "flags", "time", "residual"])
    picks = picks.where(r.isNotNull() & ~F.isnan(r) & (F.abs(r) != float("inf")) & ~r.isin(NO_RESIDUAL))
    stations = table(spark, sf_dir, "channels").select("cid", F.upper(F.concat_ws(".", "network", "station")).alias("station")).distinct()
    phase = F.element_at(F.array(F.lit("P"), F.lit("S"), F.lit("later")), (F.least(F.col("flags").bitwiseAND(15), F.lit(2)) + 1).cast("int"))
    return Scratch(spark, "residuals").keep(
        picks.join(stations, "cid", "left").select(F.coalesce("station", F.lit("unknown")).alias("station"), phase.alias("phase"), F.coalesce(F.date_format("time", "yyyy-MM-dd"), F.lit("unknown")).alias("day"), "residual")
    )


#: The parts whose ladders are stored, and the groups that are made of them.
PARTS = ["station", "phase", "day"]
GROUPINGS = [["station"], ["phase"], ["day"], PARTS]


_RESIDUALS = """
with s as (select distinct cid, upper(network || '.' || station) as station from channels),
p as (
  select cid, flags, time, residual from picks where pick_id is not null
  qualify row_number() over (partition by pick_id order by loaded_at nulls last) = 1),
r as (
  select coalesce(station, 'unknown') as station, case least(flags & 15, 2) when 0 then 'P' when 1 then 'S' else 'later' end as phase,
    coalesce(strftime(time, '%Y-%m-%d'), 'unknown') as day, residual
  from p left join s using (cid) where residual is not null and isfinite(residual) and residual not in (99.99, 9999, -999, -999000)),
"""
_GROUPS = """
g as (
  select 'station' as group_kind, station as group_value, residual from r union all
  select 'phase', phase, residual from r union all
  select 'day', day, residual from r union all
  select 'station,phase,day', station || ' ' || phase || ' ' || day, residual from r),
q as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as percentile),
n as (
  select group_kind, group_value, residual, row_number() over w - 1 as k, count(*) over (partition by group_kind, group_value) as n
  from g window w as (partition by group_kind, group_value order by residual))
"""
_INTERPOLATED = """
select group_kind, group_value, cast(percentile as double) as percentile, n,
  round(max(case when k = floor(percentile * (n - 1)) then residual end)
    + (max(case when k = ceil(percentile * (n - 1)) then residual end) - max(case when k = floor(percentile * (n - 1)) then residual end))
    * (max(percentile) * (n - 1) - floor(max(percentile) * (n - 1))), 9) as value
from n, (select cast(percentile as double) as percentile from q)
where k between floor(percentile * (n - 1)) and ceil(percentile * (n - 1))
group by group_kind, group_value, percentile, n
"""


@query(_RESIDUALS + _GROUPS + _INTERPOLATED)
def p3_residual_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of each part (station, phase, day), and of each station, phase and day from the counts of the parts."""
    out = exact_percentiles(_residuals(spark, sf_dir), PARTS, "residual", PERCENTILES, groupings=GROUPINGS)
    return out.select(F.col("grouping").alias("group_kind"), F.concat_ws(" ", *PARTS).alias("group_value"), "percentile", "n", F.round("value", 9).alias("value"))


@query(
    """
with t as (
  select upper(station_id) as station, tstar from spectrum_fits where fit_id is not null
  qualify row_number() over (partition by fit_id order by measured_at nulls last) = 1),
q as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as percentile),
n as (
  select 'station' as group_kind, station as group_value, tstar as residual, row_number() over (partition by station order by tstar) - 1 as k,
    count(*) over (partition by station) as n
  from t where tstar is not null and isfinite(tstar) and tstar not in (99, -1, -999))
"""
    + _INTERPOLATED
)
def p3_tstar_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tstar")
    fits = first_delivery(table(spark, sf_dir, "spectrum_fits"), "fit_id", "measured_at", ["station_id", "tstar"])
    fits = fits.where(t.isNotNull() & ~F.isnan(t) & ~t.isin(NO_TSTAR)).select(F.lit("station").alias("group_kind"), F.upper("station_id").alias("group_value"), "tstar")
    return exact_percentiles(Scratch(spark, "tstar").keep(fits), ["group_kind", "group_value"], "tstar", PERCENTILES).withColumn("value", F.round("value", 9))


@query(
    _RESIDUALS
    + """
g as (select 'station,phase' as group_kind, station || ' ' || phase as group_value, residual from r),
q as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as percentile),
n as (
  select group_kind, group_value, residual, row_number() over w - 1 as k, count(*) over (partition by group_kind, group_value) as n
  from g window w as (partition by group_kind, group_value order by residual)),
x as ("""
    + _INTERPOLATED
    + """)
select group_value, percentile, n, value as exact_value, true as within_error from x
"""
)
def p3_merged_daily_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per station and phase from the stored ladders of single days: whether each lies within its stated error of the exact one."""
    rows, by = _residuals(spark, sf_dir), ["station", "phase"]
    daily = Scratch(spark, "ladders").keep(count_ladder(rows, PARTS, "residual"))
    merged = ladder_percentiles(merge_ladders(daily, by), by, PERCENTILES)
    exact = exact_percentiles(rows, by, "residual", PERCENTILES).withColumnRenamed("value", "exact_value").drop("n")
    # Half a unit of the last place of the interpolation is allowed on top.
    inside = F.abs(F.col("value") - F.col("exact_value")) <= F.col("error") + 1e-12 * (1 + F.abs("exact_value"))
    return merged.join(exact, [*by, "percentile"]).select(F.concat_ws(" ", *by).alias("group_value"), "percentile", "n", F.round("exact_value", 9).alias("exact_value"), inside.alias("within_error"))


# 4. Groups

MIN_CC = 0.7


@query(
    """
with recursive e as (
  select distinct trim(event_a, ' ') as u, trim(event_b, ' ') as w from dt_cc where cc between 0.7 and 1 and trim(event_a, ' ') <> trim(event_b, ' ')),
b as (select u, w from e union select w, u from e),
walk(event_id, other) as (
  select u, u from b
  union
  select walk.event_id, b.w from walk join b on b.u = walk.other)
select event_id, min(other) as group_id from walk group by event_id
"""
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "dt_cc").where(F.col("cc").between(MIN_CC, 1.0)).select(F.trim("event_a").alias("a"), F.trim("event_b").alias("b"))
    return connected_groups(links, "a", "b", id_column="event_id", group_column="group_id")


# 7. Encoding


@query()
def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", path=BYTE_BPE_50K)


@query(
    """
select doc_id, cast(octet_length(encode(coalesce(text, ''))) as bigint) as n_bytes, true as same from documents
"""
)
def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding gives each text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode_texts(encode_texts(docs, "doc_id", "text"), "doc_id", "ids", text="decoded")
    return docs.join(back, "doc_id").select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"), (F.col("text") == F.col("decoded")).alias("same"))


# 8. Leaks

MIN_WORDS = 12


_LEAKS = r"""
with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') as w from eval_items where item_text is not null),
dg as (select doc_id, array_to_string(list_slice(w, k, k + 11), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
ig as (select item_id, array_to_string(list_slice(w, k, k + 11), ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
l as (select distinct doc_id, item_id from dg join ig using (g))
"""


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), doc_id="doc_id", text="text", item_id="item_id", item_text="item_text", min_words=MIN_WORDS)


@query(_LEAKS + "select doc_id, item_id from l")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


@query(_LEAKS + "select doc_id, md5(coalesce(text, '')) as digest from documents where doc_id not in (select doc_id from l)")
def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the documents that hold a passage."""
    docs = table(spark, sf_dir, "documents")
    return remove_leaked(docs, _leaks(spark, sf_dir), "doc_id").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


# 9. Garbled text


@query()
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id").distinct()


@query()
def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored texts, and the encodings that they were written in and read as."""
    return find_garbled(table(spark, sf_dir, "documents"), "doc_id", "text")
