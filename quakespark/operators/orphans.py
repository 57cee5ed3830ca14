"""References to records that do not exist, are deleted, or arrive later than the referring record.

Parents are range-partitioned by key and stored as sorted arrays, one row a range, with the first delivery and deletion of each key.
References are sent to the range of their key, a hot range to several tasks that share one stored row, and probed batch by batch by
vectorised binary search; only misses leave the probe and are added up.

Scale. What reaches the driver is the smallest key of each range (one for `target_rows` parents) and the ranges with more than
`target_rows` references. References are shuffled once, with key, record id and time only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quakespark.common import Scratch, micros, shuffle_partitions, spread

_NEVER = np.iinfo(np.int64).max


def _states(keys: np.ndarray, at: np.ndarray, known: np.ndarray, first: np.ndarray, deleted: np.ndarray) -> np.ndarray:
    """0 no case, 1 missing, 2 deleted, 3 late, of each key that is not null; `known` is sorted, `first` and `deleted` belong to it."""
    if not len(known):
        return np.ones(len(keys), np.int8)
    k = np.searchsorted(known, keys)
    k[k == len(known)] = 0
    return np.where(known[k] != keys, 1, np.where(deleted[k], 2, np.where(first[k] > at, 3, 0))).astype(np.int8)


_STATES = np.array(["", "missing", "deleted", "late"], dtype=object)


def parent_states(parents: DataFrame, key: str, loaded_at: str, deleted_at: str) -> DataFrame:
    """One row a key: (key, first, deleted). A key deleted in any of its rows is deleted. Null keys do not count."""
    return parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.coalesce(F.min(micros(loaded_at)), F.lit(int(_NEVER))).alias("first"), F.max(F.col(deleted_at).isNotNull()).alias("deleted")
    )


def stored_ranges(known: DataFrame, ranges: int) -> DataFrame:
    """Parent states as sorted arrays, one row for each of about `ranges` key ranges: (low, keys, first, deleted)."""
    kind = known.schema["key"].dataType.simpleString()

    def pack(batches):
        parts = [b for b in batches if len(b)]
        if parts:
            b = pd.concat(parts)
            yield pd.DataFrame({"low": b["key"].iloc[:1], "keys": [b["key"].to_numpy()], "first": [b["first"].to_numpy()], "deleted": [b["deleted"].to_numpy()]})

    sorted_ = known.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    return sorted_.mapInPandas(pack, f"low {kind}, keys array<{kind}>, first array<bigint>, deleted array<boolean>")


def orphan_references(
    references: DataFrame, parents: DataFrame, *, record_id: str, key: str, loaded_at: str, parent_key: str, parent_loaded_at: str, parent_deleted_at: str, target_rows: int = 500_000
) -> DataFrame:
    """(record_id, ref_state, first_loaded_at): one row a record whose reference is 'missing', 'deleted' or 'late'.

    The key is looked up as it is (fold case before). 'missing': no parent row has it; else 'deleted': deleted_at is set there; else
    'late': the key's first delivery is later than the record's. Null references and null record ids are no case. A record
    delivered several times counts once, by its first delivery; a null loaded_at counts as the latest possible. Empty references
    give an empty result, empty parents make every reference 'missing'. Other columns are ignored, whatever their names.
    """
    spark = references.sparkSession
    known = parent_states(parents, parent_key, parent_loaded_at, parent_deleted_at)
    refs = references.where(F.col(key).isNotNull() & F.col(record_id).isNotNull()).select(
        F.col(key).alias("key"), F.col(record_id).cast("string").alias("record"), F.coalesce(micros(loaded_at), F.lit(int(_NEVER))).alias("at")
    )
    text = dict(known.dtypes)["key"] == "string"
    if not text:
        known, refs = known.withColumn("key", F.col("key").cast("long")), refs.withColumn("key", F.col("key").cast("long"))
    n = parents.count()
    stored = Scratch(spark, "parents").keep(stored_ranges(known, max(1, min(n, max(shuffle_partitions(spark), -(-n // target_rows))))))
    lows = sorted(r["low"] for r in stored.select("low").collect())
    shared = spark.sparkContext.broadcast(np.array(lows, dtype=object if text else np.int64))

    def place(keys: pd.Series) -> np.ndarray:
        code, distinct = pd.factorize(keys)
        distinct = np.asarray(distinct, dtype=object if text else np.int64)
        return np.maximum(np.searchsorted(shared.value, distinct, "right") - 1, 0)[code] if len(distinct) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(place(keys).astype("int32"))

    full = refs.groupBy(range_of("key").alias("range")).count().where(F.col("count") > 2 * target_rows).collect()  # at most one row for 2 x target_rows references
    times = np.ones(max(1, len(lows)), np.int64)
    times[[r["range"] for r in full]] = [-(-r["count"] // target_rows) for r in full]
    copies = spark.sparkContext.broadcast(times)

    @F.pandas_udf("range int, salt int")
    def task_of(keys: pd.Series, mixed: pd.Series) -> pd.DataFrame:
        r = place(keys)
        return pd.DataFrame({"range": r.astype("int32"), "salt": (mixed.to_numpy(np.int64) % copies.value[r]).astype("int32")})

    @F.pandas_udf("array<int>")
    def salts_of(r: pd.Series) -> pd.Series:
        return pd.Series([np.arange(copies.value[i], dtype="int32") for i in r])

    refs = refs.withColumn("task", task_of("key", F.xxhash64("record"))).select("task.*", "key", "record", "at")
    # New names: a co-group's two sides must not share columns.
    ranges = stored.withColumn("stored_range", range_of("low")).withColumn("stored_salt", F.explode(salts_of("stored_range"))).drop("low")
    out = to_arrow_schema(spark.createDataFrame([], "record string, state string, at long").schema)

    def probe(b: pa.Table, p: pa.Table) -> pa.Table:
        if not b.num_rows:
            return out.empty_table()
        plain = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        if p.num_rows:
            array = lambda c, kind: p[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            known_ = array("keys", object if text else np.int64), array("first", np.int64), array("deleted", bool)
        else:
            known_ = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        at = plain(b, "at").astype(np.int64)
        if text:  # a key is searched once for all its references
            code = b["key"].combine_chunks().dictionary_encode()
            distinct, back = code.dictionary.to_numpy(zero_copy_only=False), code.indices.to_numpy()
            where = np.searchsorted(known_[0], distinct) if len(known_[0]) else np.zeros(len(distinct), np.int64)
            # Positions stand for keys: those that are not there lie between two of them.
            where[where == len(known_[0])] = 0
            there = known_[0][where] == distinct if len(known_[0]) else np.zeros(len(distinct), bool)
            s = _states(np.where(there, where, -1)[back], at, np.arange(len(known_[0])), *known_[1:])
        else:
            s = _states(plain(b, "key").astype(np.int64), at, *known_)
        hit = pa.array(np.flatnonzero(s))
        return pa.table([b["record"].combine_chunks().take(hit), pa.array(_STATES[s[s > 0]], pa.string()), pa.array(at[s > 0])], schema=out)

    left, right = spread(refs, "range", "salt"), spread(ranges, "stored_range", "stored_salt")
    found = left.groupBy("range", "salt").cogroup(right.groupBy("stored_range", "stored_salt")).applyInArrow(probe, "record string, state string, at long")
    # Only misses are shuffled. A later delivery can only lose lateness, so the first delivery of a record is among its misses.
    first = found.groupBy("record").agg(F.min(F.struct("at", "state")).alias("m"))
    return first.select("record", F.col("m.state").alias("ref_state"), F.when(F.col("m.at") < int(_NEVER), F.timestamp_micros("m.at")).alias("first_loaded_at"))


def count_by_month(orphans: DataFrame) -> DataFrame:
    """Misses per field, state and month of first delivery."""
    return orphans.groupBy("ref_field", "ref_state", "load_month").agg(F.count(F.lit(1)).alias("records"))
