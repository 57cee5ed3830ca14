"""One-dimensional velocity models: nodes (depth, vp, vs); a depth that occurs twice is a discontinuity."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ak135 to 660 km (Kennett, Engdahl and Buland 1995): depth in km, vp and vs in km/s.
AK135 = [
    (0.0, 5.8, 3.46), (20.0, 5.8, 3.46), (20.0, 6.5, 3.85), (35.0, 6.5, 3.85), (35.0, 8.04, 4.48), (77.5, 8.045, 4.49), (120.0, 8.05, 4.5), (165.0, 8.175, 4.509), (210.0, 8.3, 4.518), (210.0, 8.3, 4.523),
    (260.0, 8.4825, 4.609), (310.0, 8.665, 4.696), (360.0, 8.8475, 4.783), (410.0, 9.03, 4.87), (410.0, 9.36, 5.08), (460.0, 9.528, 5.186), (510.0, 9.696, 5.292), (560.0, 9.864, 5.398), (610.0, 10.032, 5.504), (660.0, 10.2, 5.61),
]
#: PREM's crust and lid as layers (Dziewonski and Anderson 1981).
PREM = [(0.0, 5.8, 3.2), (15.0, 5.8, 3.2), (15.0, 6.8, 3.9), (24.4, 6.8, 3.9), (24.4, 8.1106, 4.4909), (80.0, 8.0762, 4.4703), (220.0, 7.9897, 4.4189)]


@dataclass
class Model1D:
    name: str
    nodes: list[tuple[float, float, float]]
    reference: str = ""
    box: tuple[float, float, float, float] | None = None  # min_lon, max_lon, min_lat, max_lat
    priority: int = 0
    scope: str = "global"
    metadata: dict = field(default_factory=dict)

    def at(self, depth, phase: str = "P") -> np.ndarray:
        """Velocities at depths: linear between nodes, the lower side at a discontinuity, constant beyond the ends."""
        n = np.array(self.nodes)
        z, v = n[:, 0], n[:, 1 if phase == "P" else 2]
        d = np.asarray(depth, float)
        i = np.clip(np.searchsorted(z, d, "right"), 1, len(z) - 1)
        h = z[i] - z[i - 1]
        f = np.where(h > 0, np.clip((d - z[i - 1]) / np.where(h > 0, h, 1), 0, 1), 1.0)
        out = v[i - 1] + f * (v[i] - v[i - 1])
        return np.where(d <= z[0], v[0], np.where(d >= z[-1], v[-1], out))

    def velocity(self, depth: Column, phase: str = "P") -> Column:
        """The same as a Column: the segment is found by a filter over the model's few nodes."""
        k = 1 if phase == "P" else 2
        seg = [(a[0], b[0], a[k], b[k]) for a, b in zip(self.nodes, self.nodes[1:]) if b[0] > a[0]]
        s = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for a, b, u, v in seg])
        hit = F.filter(s, lambda x: (depth >= x["a"]) & (depth < x["b"]))
        h = F.try_element_at(hit, F.lit(1))
        inside = h["u"] + (depth - h["a"]) / (h["b"] - h["a"]) * (h["v"] - h["u"])
        return F.when(depth < self.nodes[0][0], float(self.nodes[0][k])).otherwise(F.coalesce(inside, F.lit(float(self.nodes[-1][k]))))

    def with_ratio(self, vp_vs: float) -> Model1D:
        return Model1D(self.name, [(z, p, p / vp_vs) for z, p, _ in self.nodes], self.reference)

    def continued(self, below: Model1D) -> Model1D:
        """This model, and another one below its last node."""
        end = self.nodes[-1][0]
        return Model1D(self.name, [*self.nodes, (end, float(below.at(end, "P")), float(below.at(end, "S"))), *[n for n in below.nodes if n[0] > end]], self.reference)

    def to_text(self) -> str:
        return "".join(f"{z:g} {p:g} {s:g}\n" for z, p, s in self.nodes)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "reference": self.reference, "nodes": self.nodes})

    @classmethod
    def parse(cls, text: str, name: str = "model") -> Model1D:
        """From JSON, or from lines `depth vp [vs]`; without vs, Vp/Vs is the square root of 3."""
        if text.lstrip().startswith("{"):
            d = json.loads(text)
            return cls(d.get("name", name), [tuple(float(v) for v in n) for n in d["nodes"]], d.get("reference", ""))
        nodes = []
        for number, line in enumerate(text.splitlines(), 1):
            t = line.split("#")[0].replace(",", " ").split()
            if not t:
                continue
            try:
                v = [float(x) for x in t[:3]]
            except ValueError as e:
                raise ValueError(f"line {number}: {e}") from None
            nodes.append((v[0], v[1], v[2] if len(v) > 2 else v[1] / 3**0.5))
        if len(nodes) < 2 or any(b[0] < a[0] for a, b in zip(nodes, nodes[1:])):
            raise ValueError("a model has two nodes or more, in order of depth")
        return cls(name, nodes)

    @classmethod
    def layers(cls, name: str, tops: list[float], vp: list[float], vs: list[float], bottom: float) -> Model1D:
        ends = [*tops[1:], bottom]
        return cls(name, [(z, p, s) for a, b, p, s in zip(tops, ends, vp, vs) for z in (a, b)])

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *map(float, n)) for i, n in enumerate(self.nodes)], "ordinal int, depth_km double, vp double, vs double")


LIBRARY = {m.name: m for m in (Model1D("ak135", AK135, "Kennett, Engdahl and Buland 1995"), Model1D("prem", PREM, "Dziewonski and Anderson 1981"))}


def choose(models: list[Model1D], min_lon: float, max_lon: float, min_lat: float, max_lat: float) -> list[Model1D]:
    """Models whose box holds an area's middle: local before regional before global, then by priority, then the smaller box."""
    lon, lat = (min_lon + max_lon) / 2, (min_lat + max_lat) / 2
    rank = {"local": 0, "regional": 1, "global": 2}
    size = lambda m: (m.box[1] - m.box[0]) * (m.box[3] - m.box[2]) if m.box else 360.0 * 180.0
    fit = [m for m in models if m.box is None or (m.box[0] <= lon <= m.box[1] and m.box[2] <= lat <= m.box[3])]
    return sorted(fit, key=lambda m: (rank.get(m.scope, 2), -m.priority, size(m), m.name))
