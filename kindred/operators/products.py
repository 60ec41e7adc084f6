"""Figures of pairs of entities that each have many arrays of numbers, as products of matrices of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.constants import EARTH_METRES
from kindred.sources.storage import spread_join

#: Numbers of one side of a product, and its rows that are compared at once.
NUMBERS, STRIP = 1 << 19, 1024


def compare_entities(pairs: DataFrame, rows: DataFrame, measure: Callable[[np.ndarray, np.ndarray], tuple], result: str) -> DataFrame:
    """``measure`` of every two matrices of both entities of a pair: entity_id_1, entity_id_2 and the columns of ``result``.

    ``rows`` has different arrays ``x`` (entity_id, x). Those of an entity and a
    length are cut into matrices of at most about :data:`NUMBERS` by a hash;
    every two matrices of equal length are one row of the result, dealt to tasks
    one by one, so no task holds more than two of them at a time. Pairs without
    such matrices have no row.
    """
    kind = rows.schema["entity_id"].dataType.simpleString()
    sized = rows.select("entity_id", "x", F.size("x").alias("width")).where("width > 0")
    cuts = sized.groupBy("entity_id", "width").agg(F.ceil(F.count("*") * F.greatest("width", F.lit(64)) / NUMBERS).cast("int").alias("cuts"))
    dealt = spread_join(sized, cuts, ["entity_id", "width"]).withColumn("part", F.pmod(F.xxhash64("x"), "cuts").cast("int"))
    whole = dealt.groupBy("entity_id", "width", "part").agg(F.flatten(F.collect_list("x")).alias("x"))
    side = lambda i: cuts.select(F.col("entity_id").alias(f"entity_id_{i}"), "width", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias(f"part_{i}"))
    wanted = pairs.select("entity_id_1", "entity_id_2").distinct().join(side(1), "entity_id_1").join(side(2), ["entity_id_2", "width"])
    keys = ["entity_id_1", "entity_id_2", "width", "part_1", "part_2"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as few bytes may be much work
    sent = lambda i: wanted.join(whole.select(F.col("entity_id").alias(f"entity_id_{i}"), "width", F.col("part").alias(f"part_{i}"), F.col("x").alias(f"x_{i}")), [f"entity_id_{i}", "width", f"part_{i}"]).select(*keys, f"x_{i}").repartition(n, *keys)
    names = [c.split()[0] for c in result.split(", ")]

    def run(batches):
        matrix = lambda column, i, width: column[i].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        for b in batches:
            widths = b["width"].to_pylist()
            found = [measure(matrix(b["x_1"], i, w), matrix(b["x_2"], i, w)) for i, w in enumerate(widths)]
            yield pa.RecordBatch.from_arrays([b["entity_id_1"], b["entity_id_2"], *[pa.array([f[k] for f in found], pa.float64()) for k in range(len(names))]], names=["entity_id_1", "entity_id_2", *names])

    return sent(1).join(sent(2), keys).mapInArrow(run, f"entity_id_1 {kind}, entity_id_2 {kind}, {result}")


def largest_cosine(x: np.ndarray, y: np.ndarray) -> tuple[float]:
    """Largest cosine of a row of ``x`` with one of ``y``; zero vectors have cosine 0 with everything."""
    x, y = ((m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1.0, n)) for m in (x, y))
    return (float(np.max([np.max(x[i : i + STRIP] @ y[j : j + STRIP].T) for i in range(0, len(x), STRIP) for j in range(0, len(y), STRIP)])),)


def _near_strips(x: np.ndarray, y: np.ndarray, metres: float):
    """Rows of both, in strips, with the distances of their places (first two columns, degrees); strips too far apart by latitude are left out."""
    x, y = x[np.argsort(x[:, 0])], y[np.argsort(y[:, 0])]
    gap = math.degrees(metres / EARTH_METRES) * 1.0001
    for i in range(0, len(x), STRIP):
        for j in range(0, len(y), STRIP):
            p, q = x[i : i + STRIP], y[j : j + STRIP]
            if p[0, 0] - q[-1, 0] > gap or q[0, 0] - p[-1, 0] > gap:
                continue
            (a, s), (b, t) = np.radians(p[:, :2]).T, np.radians(q[:, :2]).T
            h = np.sin((b[None, :] - a[:, None]) / 2) ** 2 + np.cos(a)[:, None] * np.cos(b)[None, :] * np.sin((t[None, :] - s[:, None]) / 2) ** 2
            yield p, q, 2 * EARTH_METRES * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def nearest(metres: float):
    """Smallest distance of two places, infinite beyond ``metres`` at the least by latitude."""
    return lambda x, y: (min((float(np.fmin.reduce(d, axis=None)) for _, _, d in _near_strips(x, y, metres)), default=math.inf),)


def near_sums(metres: float):
    """Sum of dot products of vectors (columns from the fourth on) times proximity, and the number of pairs; the third column is how many vectors a row sums up."""

    def measure(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        total = 0.0
        for p, q, d in _near_strips(x, y, metres):
            total += float(np.sum(np.where(d <= metres, 1 - d / metres, 0.0) * (p[:, 3:] @ q[:, 3:].T)))
        return total, float(x[:, 2].sum() * y[:, 2].sum())

    return measure
