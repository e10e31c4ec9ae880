"""Fitting of vector artifacts: axes, calibrations and regions.

Means over any number of exemplars are Spark aggregates; only vectors of the
model's dimension, the covariance of a region and the scores of a calibration
(a double for each reference text) come to the driver.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.functions.vector import literal, normalize, project, unit, with_vectors


@dataclass(frozen=True)
class Axis:
    name: str
    direction: list[float]
    model: str
    dim: int
    calibration: list[float] = field(default_factory=list)
    kind: str = "axis"


@dataclass(frozen=True)
class Region:
    name: str
    center: list[float]
    basis: list[list[float]]
    scales: list[float]
    residual_scale: float
    tau: float
    model: str
    dim: int
    kind: str = "region"


def centroids(vectors: DataFrame, by: str | None = None, column: str = "embedding") -> DataFrame:
    """(by, pos, value): mean of each component, as rows; partial sums are made before the shuffle."""
    keys = [by] if by else []
    parts = vectors.select(*keys, F.posexplode(F.col(column).cast("array<double>")).alias("pos", "x"))
    return parts.groupBy(*keys, "pos").agg(F.avg("x").alias("value"))


def centroid(vectors: DataFrame, column: str = "embedding") -> np.ndarray:
    rows = centroids(vectors, column=column).orderBy("pos").collect()  # one row for each dimension
    if not rows:
        raise ValueError("no exemplars")
    return np.array([r["value"] for r in rows])


def fit_axis(name: str, positive: DataFrame, negative: DataFrame, model: str, column: str = "embedding") -> Axis:
    """Direction from the mean of one set to that of another; exemplars aren't normalised first."""
    a, b = centroid(positive, column), centroid(negative, column)
    if np.allclose(a, b):
        raise ValueError("the sets coincide")
    return Axis(name, unit(a - b).tolist(), model, len(a))


def calibrate(axis: Axis, reference: DataFrame, column: str = "embedding") -> Axis:
    """Adds the ascending scores of all reference texts; the artifact holds each of them, so they come to the driver."""
    scores = reference.select(project(F.col(column), literal(axis.direction)).alias("s")).where("s is not null")
    points = np.sort(scores.toArrow().column("s").to_numpy())
    if len(points) < 2:
        raise ValueError("a calibration needs two scores")
    return Axis(axis.name, axis.direction, axis.model, axis.dim, points.tolist())


def _products(batches):
    """The sum of a partition's outer products, as (i, j, s)."""
    total = None
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            rows = flat.reshape(batch.num_rows, -1)
            total = rows.T @ rows if total is None else total + rows.T @ rows
    if total is not None:
        i, j = np.indices(total.shape, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.reshape(-1)), pa.array(j.reshape(-1)), pa.array(total.reshape(-1))], names=["i", "j", "s"])


def exemplars(texts: DataFrame, vectors: DataFrame, text: str = "text", strategy=None) -> DataFrame:
    """(text, embedding): the vectors of exemplar texts, found by (canonical) text; a text without one is an error that names it."""
    return with_vectors(texts.select(F.col(text)), text, vectors, strategy, "embedding")


def fit_axis_texts(name: str, positive: DataFrame, negative: DataFrame, vectors: DataFrame, model: str, strategy=None) -> Axis:
    return fit_axis(name, exemplars(positive, vectors, strategy=strategy), exemplars(negative, vectors, strategy=strategy), model)


def fit_region_texts(name: str, cloud: DataFrame, vectors: DataFrame, rank: int, coverage: float, model: str, strategy=None) -> Region:
    return fit_region(name, exemplars(cloud, vectors, strategy=strategy), rank, coverage, model)


def fit_region(name: str, cloud: DataFrame, rank: int, coverage: float, model: str, column: str = "embedding") -> Region:
    """Centre, principal directions with their spread, rest spread, and the depth that covers the given share (nearest rank)."""
    if rank < 1 or not 0 < coverage <= 1:
        raise ValueError("rank must be 1 or more and coverage in (0, 1]")
    unit_rows = cloud.select(normalize(F.col(column)).alias("v"))
    if not unit_rows.where("v is null").isEmpty():
        raise ValueError("a vector without direction")
    n = unit_rows.count()
    if n < 3:
        raise ValueError("a region needs three vectors")
    center = centroid(unit_rows, "v")
    dim = len(center)
    shifted = unit_rows.select(F.zip_with("v", literal(center), lambda x, c: x - c).alias("d"))
    sums = shifted.mapInArrow(_products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # dim * dim rows
    cov = np.zeros((dim, dim))
    for r in sums:
        cov[r["i"], r["j"]] = r["s"] / n
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(rank, dim)]
    keep = [i for i in order if values[i] > 1e-12]
    if not keep:
        raise ValueError("the cloud has no spread")
    basis, scales = directions[:, keep].T, np.sqrt(values[keep])
    rest = math.sqrt(max(float(np.trace(cov) - values[keep].sum()), 0.0))
    region = Region(name, center.tolist(), basis.tolist(), scales.tolist(), max(rest, 1e-6), 1.0, model, dim)
    from rulegrain.functions.vector import depth

    at = min(n, max(1, math.ceil(n * coverage)))
    depths = cloud.select(depth(F.col(column), region).alias("d"))
    tau = depths.agg(F.expr(f"percentile_disc({at / n}D) within group (order by d)")).first()[0]
    return Region(**{**asdict(region), "tau": float(tau)})


class Artifacts(dict):
    """Axes and regions by name, as one JSON document."""

    def add(self, artifact) -> None:
        if artifact.name in self:
            raise ValueError(f"duplicate artifact {artifact.name}")
        self[artifact.name] = artifact

    def upsert(self, artifact) -> None:
        self[artifact.name] = artifact

    def dumps(self) -> str:
        return json.dumps([asdict(a) for a in self.values()])

    @classmethod
    def loads(cls, text: str) -> Artifacts:
        out = cls()
        for x in json.loads(text):
            out.add((Axis if x["kind"] == "axis" else Region)(**x))
        return out
