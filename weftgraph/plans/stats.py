"""Edge statistics that order joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_statistics(edges: DataFrame) -> DataFrame:
    """label, edges, mean_out, mean_in: edges per distinct source and per distinct target."""
    return edges.groupBy("label").agg(
        F.count(F.lit(1)).alias("edges"),
        (F.count(F.lit(1)) / F.count_distinct("src")).alias("mean_out"),
        (F.count(F.lit(1)) / F.count_distinct("dst")).alias("mean_in"),
    )


@dataclass
class Degrees:
    """Mean degree, and vertices reached, by (direction, label); one number if nothing is known."""

    mean: dict[tuple[str, int], float] = field(default_factory=dict)
    edges: dict[int, float] = field(default_factory=dict)

    @classmethod
    def of(cls, edges: DataFrame) -> Degrees:
        """From one aggregate over the edges: a row per edge label reaches the driver."""
        rows = edge_statistics(edges).collect()
        mean = {("out", r["label"]): r["mean_out"] for r in rows} | {("in", r["label"]): r["mean_in"] for r in rows}
        return cls(mean, {r["label"]: float(r["edges"]) for r in rows})

    def cost(self, direction: str, label: int) -> float:
        return self.mean.get((direction, label), 1.0)

    def chance(self, direction: str, label: int) -> float:
        """Share of the vertices at the other end that a vertex is linked to: how many rows a further link keeps."""
        other = "in" if direction == "out" else "out"
        reached = self.edges.get(label, 0.0) / max(1.0, self.mean.get((other, label), 1.0))
        return min(1.0, self.cost(direction, label) / reached) if reached else 0.5
