"""Radial-basis features: N x M vectors become N x K closeness values to K cluster centres."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunekit.functions.arrays import lit_array, squared_distance
from tunekit.operators.columns import feature_names, name_features
from tunekit.operators.prep.base import Fitted, Prep, quoted


def distance_to(x: Column, centre: Column, mode: str = "sq") -> Column:
    """Squared distance (`sq`), or distance (`l2`)."""
    d2 = squared_distance(x, centre)
    return F.sqrt(d2) if mode == "l2" else d2


def cluster_radii(df: DataFrame, dist: str, ratio: float, cluster: str = "cluster", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., cluster, radius): `ratio` times the largest member distance, from a partial maximum.

    A radius of 0 is replaced by the smallest positive one; when all are 0 by 1.
    """
    raw = df.groupBy(*keys, cluster).agg((F.max(dist) * F.lit(float(ratio))).alias("raw"))
    positive = F.when(F.col("raw") > 0, F.col("raw"))
    # over the clusters of one model: as many rows as it has centres
    least = F.min(positive).over(Window.partitionBy(*(keys or [F.lit(0)])))
    return raw.select(*keys, cluster, F.coalesce(positive, least, F.lit(1.0)).alias("radius"))


def rbf_values(x: Column, centres: Sequence[Sequence[float]], radii: Sequence[float], mode: str = "sq") -> list[Column]:
    """exp(-d^2 / (2 r^2)) per centre, as a projection with the centres inlined."""
    out = []
    for centre, r in zip(centres, radii):
        d = distance_to(x, lit_array(centre), mode)
        out.append(F.exp(-(d * d) / F.lit(2.0 * float(r) * float(r))))
    return out


def centre_table(centres: Sequence[Sequence[float]], radii: Sequence[float]) -> str:
    """All centres, each with twice its squared radius, as the text of one SQL value of type array<struct<c, w>>."""
    rows = ",".join(json.dumps({"c": [float(v) for v in c], "w": 2.0 * float(r) * float(r)}) for c, r in zip(centres, radii))
    return f"from_json('[{rows}]', 'array<struct<c:array<double>,w:double>>')"


def rbf_rule(x: str, table: str, mode: str = "sq") -> str:
    """SQL for the values of all centres in one expression, whatever their number; the table of centres is one constant."""
    d2 = f"aggregate(zip_with({x}, s.c, (a, b) -> (a - b) * (a - b)), 0.0D, (acc, v) -> acc + v)"
    d = d2 if mode == "sq" else f"sqrt({d2})"
    return f"transform({table}, s -> exp(-pow({d}, 2) / s.w))"


class FittedRbf(Fitted):
    def __init__(self, constants, centres, radii, mode: str):
        super().__init__([str(i) for i in range(len(centres))], constants)
        self.centres, self.radii, self.mode = centres, radii, mode

    def _transform(self, dataset: DataFrame) -> DataFrame:
        values = F.expr(rbf_rule("_x", centre_table(self.centres, self.radii), self.mode))
        rest = [c for c in dataset.columns if c != "features"]
        unpacked = dataset.select(*rest, vector_to_array("features").alias("_x"))
        return unpacked.select(*rest, name_features(array_to_vector(values), self.names))

    def prelude(self, inputs: Sequence[str]) -> str:
        x = ", ".join(f"CAST({quoted(c)} AS DOUBLE)" for c in inputs)
        return rbf_rule(f"array({x})", centre_table(self.centres, self.radii), self.mode)

    def cells(self, inputs: Sequence[str], place: str | None = None) -> list[str]:
        whole = self.prelude(inputs) if place is None else quoted(place)
        return [f"element_at({whole}, {i + 1})" for i in range(len(self.centres))]


class RadialBasis(Prep):
    """KMeans on the training rows, then a Gaussian of the distance to each centre.

    `mode="sq"` puts the squared distance where a distance is usual, in the radius as well.
    """

    def __init__(self, k: int = 10, max_iter: int = 20, ratio: float = 0.2, mode: str = "sq", seed: int = 7, **kw):
        super().__init__(**kw)
        self.k, self.max_iter, self.ratio, self.mode, self.seed = int(k), int(max_iter), ratio, mode, seed

    def fit_rows(self, df: DataFrame) -> Fitted:
        names = feature_names(df)
        model = KMeans(k=self.k, maxIter=self.max_iter, seed=self.seed, featuresCol="features", predictionCol="cluster").fit(df)
        centres = [[float(v) for v in c] for c in model.clusterCenters()]
        x, at = vector_to_array(F.col("features")), F.col("cluster")
        own = F.get(F.expr(centre_table(centres, [1.0] * len(centres))), at)["c"]
        members = model.transform(df.select("features")).select("cluster", distance_to(x, own, self.mode).alias("dist"))
        found = {r["cluster"]: r["radius"] for r in cluster_radii(members, "dist", self.ratio).collect()}
        least = min(found.values())
        radii = [found.get(i, least) for i in range(len(centres))]  # a centre without members
        constants = [(f"centre_{i}", "radius", r) for i, r in enumerate(radii)]
        constants += [
            (f"centre_{i}", n if j < len(names) else str(j), v)
            for i, c in enumerate(centres)
            for j, (n, v) in enumerate(zip(names or [str(q) for q in range(len(c))], c))
        ]
        return FittedRbf(constants, centres, radii, self.mode)

    def identity(self, df: DataFrame) -> Fitted:
        return Fitted(feature_names(df), [], enabled=False)
