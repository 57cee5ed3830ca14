"""miniSEED 2.4: records decoded with numpy in tasks, and written again."""

from __future__ import annotations

import datetime as dt
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakespark.operators.traces import stitch

_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def steim(data: bytes, samples: int, version: int, big: bool) -> np.ndarray:
    """Differences of Steim frames, summed up from the first sample."""
    words = np.frombuffer(data[: len(data) // 64 * 64], ">u4" if big else "<u4").astype(np.uint32).reshape(-1, 16)
    if not len(words):
        return np.zeros(0, np.int32)
    first = int(words[0, 1].astype(np.int32))

    def bits(w: int, size: int, n: int) -> list[int]:
        out = []
        for k in range(n):
            v = (w >> (size * (n - 1 - k))) & ((1 << size) - 1)
            out.append(v - (1 << size) if v >> (size - 1) else v)
        return out

    d: list[int] = []
    for f, frame in enumerate(words):
        head = int(frame[0])
        for k in range(1, 16):
            code = (head >> (30 - 2 * k)) & 3
            if code == 0 or (f == 0 and k <= 2):
                continue
            w = int(frame[k])
            if code == 1:
                d += bits(w, 8, 4)
            elif version == 1:
                d += bits(w, 16, 2) if code == 2 else bits(w, 32, 1)
            else:
                sub = w >> 30
                size, n = {(2, 1): (30, 1), (2, 2): (15, 2), (2, 3): (10, 3), (3, 0): (6, 5), (3, 1): (5, 6), (3, 2): (4, 7)}[code, sub]
                d += bits(w & 0x3FFFFFFF, size, n)
        if len(d) >= samples:
            break
    x = np.array(d[:samples], np.int64)
    if len(x):
        x[0] = first
    return np.cumsum(x).astype(np.int32)


def steim1_frames(x: np.ndarray) -> bytes:
    """Steim-1 frames of integers: each word holds four, two or one difference."""
    x = np.asarray(x, np.int64)
    d = np.diff(x, prepend=x[0])
    words: list[tuple[int, int]] = []
    i = 0
    while i < len(d):
        if i + 4 <= len(d) and np.all(np.abs(d[i : i + 4]) < 128):
            words.append((1, int.from_bytes(d[i : i + 4].astype(">i1").tobytes(), "big")))
            i += 4
        elif i + 2 <= len(d) and np.all(np.abs(d[i : i + 2]) < 32768):
            words.append((2, int.from_bytes(d[i : i + 2].astype(">i2").tobytes(), "big")))
            i += 2
        else:
            words.append((3, int(d[i]) & 0xFFFFFFFF))
            i += 1
    out, at, first = b"", 0, True
    while at < len(words) or first:
        room = 13 if first else 15
        part = words[at : at + room]
        at += len(part)
        head, body = 0, []
        if first:
            body = [int(x[0]) & 0xFFFFFFFF, int(x[-1]) & 0xFFFFFFFF]
        start = 3 if first else 1
        for k, (c, w) in enumerate(part):
            head |= c << (30 - 2 * (start + k))
            body.append(w)
        frame = [head, *body]
        out += struct.pack(">16I", *frame, *[0] * (16 - len(frame)))
        first = False
    return out


def parse(data: bytes) -> list[dict]:
    """Records of a file: network, station, location, channel, start (s), rate, samples. Damaged bytes are skipped to the next 256."""
    out, at = [], 0
    while at + 48 <= len(data):
        h = data[at : at + 48]
        if not (h[:6].strip().isdigit() and h[6:7] in b"DRQM"):
            at += 256
            continue
        big = 1900 <= struct.unpack(">H", h[20:22])[0] <= 2100
        e = ">" if big else "<"
        year, day, hour, minute, second, _, frac = struct.unpack(e + "HHBBBBH", h[20:30])
        n, factor, mult = struct.unpack(e + "Hhh", h[30:36])
        flags, _, _, blockettes = h[36], h[37], h[38], h[39]
        correction, begin, b = struct.unpack(e + "iHH", h[40:48])
        encoding, length, micro, rate = 11, 512, 0, None
        order = big
        for _ in range(blockettes):
            if not b or at + b + 8 > len(data):
                break
            kind, nxt = struct.unpack(e + "HH", data[at + b : at + b + 4])
            if kind == 1000:
                encoding, o, size = data[at + b + 4], data[at + b + 5], data[at + b + 6]
                length, order = 1 << size, o == 1
            elif kind == 1001:
                micro = struct.unpack("b", data[at + b + 5 : at + b + 6])[0]
            elif kind == 100:
                rate = struct.unpack(e + "f", data[at + b + 4 : at + b + 8])[0]
            b = nxt
        if rate is None:
            rate = (factor if factor > 0 else -1 / factor if factor else 0) * (mult if mult > 0 else -1 / mult if mult else 1)
        t = (dt.datetime(year, 1, 1, tzinfo=dt.timezone.utc) - _EPOCH).total_seconds() + (day - 1) * 86400 + hour * 3600 + minute * 60 + second + frac * 1e-4 + micro * 1e-6
        if not flags & 2:
            t += correction * 1e-4
        body = data[at + begin : at + length]
        o = ">" if order else "<"
        kinds = {1: "i2", 3: "i4", 4: "f4", 5: "f8"}
        x = None
        if encoding in kinds:
            x = np.frombuffer(body[: n * np.dtype(kinds[encoding]).itemsize], o + kinds[encoding])
        elif encoding in (10, 11):
            x = steim(body, n, encoding - 9, order)
        if x is not None and n and rate:
            out.append({"network": h[18:20].decode().strip(), "station": h[8:13].decode().strip(), "location": h[13:15].decode().strip(), "channel": h[15:18].decode().strip(), "start": t, "rate": float(rate), "samples": x.astype(np.float32)})
        at += max(length, 256)
    return out


def record(network: str, station: str, location: str, channel: str, start: float, rate: float, x: np.ndarray, number: int, *, size: int = 512, integers: bool = False) -> bytes:
    """One record of FLOAT32, or of Steim-1 integers."""
    t = _EPOCH + dt.timedelta(microseconds=round(start * 1e6 / 100) * 100)
    body = steim1_frames(x) if integers else np.asarray(x, ">f4").tobytes()
    if len(body) > size - 64:
        raise ValueError("too many samples for a record")
    factor, mult = (round(rate), 1) if rate >= 1 and abs(rate - round(rate)) < 1e-6 else (round(rate * 1000), -1000) if rate >= 1 else (-round(1 / rate), 1)
    h = f"{number % 1_000_000:06d}D ".encode() + f"{station:<5}{location:<2}{channel:<3}{network:<2}".encode()
    h += struct.pack(">HHBBBBH", t.year, t.timetuple().tm_yday, t.hour, t.minute, t.second, 0, t.microsecond // 100) + struct.pack(">Hhh", len(x), factor, mult) + bytes([0, 0, 0, 1]) + struct.pack(">iHH", 0, 64, 48)
    h += struct.pack(">HHBBBB", 1000, 0, 10 if integers else 4, 1, size.bit_length() - 1, 0) + bytes(8)
    return (h + body).ljust(size, b"\0")


def encode(network: str, station: str, location: str, channel: str, start: float, rate: float, x: np.ndarray, *, size: int = 512) -> bytes:
    """A trace as FLOAT32 records."""
    room = (size - 64) // 4
    return b"".join(record(network, station, location, channel, start + i / rate, rate, x[i : i + room], i // room + 1, size=size) for i in range(0, len(x), room))


RECORD = "network string, station string, location string, channel string, start double, rate double, samples array<float>"


def read_miniseed(spark: SparkSession, path: str, *, join: bool = True) -> DataFrame:
    """Segments of all files at a path: records decoded in tasks, then joined per channel where they are contiguous."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            for c in b["content"]:
                yield pd.DataFrame(parse(c), columns=names)

    d = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, RECORD)
    return stitch(d, by=["network", "station", "location", "channel"]) if join else d


def write_miniseed(traces: DataFrame, folder: str, *, size: int = 512) -> DataFrame:
    """A file a trace in a folder that the executors share; gives (path, bytes). Run it with an action."""

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            out = []
            for r in b.itertuples():
                data = encode(r.network, r.station, r.location, r.channel, r.start, r.rate, np.asarray(r.samples, float), size=size)
                path = os.path.join(folder, f"{r.network}.{r.station}.{r.location}.{r.channel}.{int(r.start * 1000)}.mseed")
                with open(path + ".part", "wb") as f:
                    f.write(data)
                os.replace(path + ".part", path)  # a task that runs twice writes the same file
                out.append((path, len(data)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return traces.select("network", "station", "location", "channel", "start", "rate", "samples").mapInPandas(run, "path string, bytes long")


def cut_events(segments: DataFrame, events: DataFrame, *, before_s: float = 30.0, after_s: float = 120.0) -> DataFrame:
    """The longest segment of each channel inside each event's window, of one instrument a station: with a vertical, velocity (H) before
    acceleration (N), the highest rate. An interval join by ranges of an hour, then two rankings."""
    from pyspark.sql import Window

    from quakespark.operators.catalog import overlapping

    s = segments.withColumn("s1", F.col("start") + F.size("samples") / F.col("rate")).withColumn("one", F.lit(1))
    e = events.select(F.col("id").alias("event"), (F.unix_micros("origin_time") / 1e6).alias("t0")).withColumns({"w0": F.col("t0") - before_s, "w1": F.col("t0") + after_s, "one": F.lit(1)})
    j = overlapping(e, s, on=["one"], a_span=("w0", "w1"), b_span=("start", "s1"), width=3600.0).drop("one")
    k0 = F.greatest(F.lit(0.0), F.ceil((F.col("w0") - F.col("start")) * F.col("rate"))).cast("int")
    k1 = F.least(F.size("samples"), F.floor((F.col("w1") - F.col("start")) * F.col("rate")) + 1).cast("int")
    j = j.withColumns({"k0": k0, "n": k1 - k0}).where("n > 0")
    w = Window.partitionBy("event", "network", "station", "location", "channel").orderBy(F.desc("n"), "start")
    j = j.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    group = F.substring("channel", 1, 2)
    g = Window.partitionBy("event", "network", "station", "location", group)
    j = j.withColumns({"_z": F.max(F.col("channel").endswith("Z").cast("int")).over(g), "_v": F.when(F.substring("channel", 2, 1) == "H", 0).when(F.substring("channel", 2, 1) == "N", 2).otherwise(1), "_g": F.concat("location", group)})
    best = Window.partitionBy("event", "network", "station").orderBy(F.desc("_z"), "_v", F.desc("rate"), "_g")
    j = j.withColumn("_best", F.first("_g").over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where(F.col("_g") == F.col("_best"))
    return j.select("event", "network", "station", "location", "channel", (F.col("start") + F.col("k0") / F.col("rate")).alias("start"), "rate", F.slice("samples", F.col("k0") + 1, F.col("n")).alias("samples"))
