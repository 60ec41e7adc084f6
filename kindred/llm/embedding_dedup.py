"""Near-duplicate vectors: spherical k-means cells and blocked cosine products.

Vectors are compared within a label only. A label's unit vectors are dealt to
the cells of centroids fitted on a bounded sample. Each vector lives in its
nearest cell and visits every other cell that could hold a partner of it: for
centroids c (home) and d, a partner that lives with d lies on d's side of the
hyperplane halfway between them, and no partner is at a larger angle than a
link allows. So vectors visit a cell only from within the link's angle of that
hyperplane, and no link is lost. Copies of one vector are compared once.

How much that prunes is up to the vectors: clustered ones visit few cells,
random ones of many dimensions nearly all, and are then compared with their
whole label, in blocks.

Cells are cut into blocks: a block of a cell's residents meets every block of
its residents and visitors in a task of its own, as a product of matrices of
bounded size. It gives the residents' counts of links and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.components import components
from kindred.sources.storage import materialize, spread_join

THRESHOLD = 0.93
#: Vectors aimed at in a cell, and in a block. Where cells prune little a vector travels to about n / BLOCK_ROWS tasks of its label,
#: so blocks are as large as a task can well hold: 8 MB of 64 numbers, and a few seconds of products.
CELL_ROWS = 16_384
BLOCK_ROWS = 16_384
#: Numbers of a block's vectors at most (8 MB): blocks of longer vectors have fewer rows.
BLOCK_NUMBERS = 1 << 20
#: Numbers of all labels' centroids together, at most about (32 MB); cells grow beyond that and are still compared whole, in blocks.
CENTROID_NUMBERS = 4 << 20
#: Cosines with centroids held at once.
COSINES = 4 << 20
#: Vectors of a label that its centroids are fitted on, at most about.
SAMPLE_ROWS = 20_000
STEPS = 8
#: Rows of a product held at once.
STRIP = 256


def kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors by cosine, unit length."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        home = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            own = x[home == j].sum(axis=0)
            size = np.linalg.norm(own)
            if size > 1e-9:
                c[j] = own / size
    return c


def visits(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homes of unit vectors, and rows and cells of the visits that no link may miss.

    The sine of the angle between a vector and the hyperplane halfway between
    its centroid and another is their difference of cosines over the centroids'
    distance; a partner on the other side is further than that angle.
    """
    reach = math.sqrt(max(0.0, 1 - max(threshold, 0.0) ** 2)) + 1e-9
    homes, rows, cells = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)]
    step = max(1, COSINES // len(c))
    for k in range(0, len(x), step):
        cos = x[k : k + step] @ c.T
        at, home = np.arange(len(cos)), cos.argmax(axis=1)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
        near = cos[at, home][:, None] - cos <= reach * apart + 1e-12
        near[at, home] = False
        row, cell = np.nonzero(near)
        homes.append(home)
        rows.append(row + k)
        cells.append(cell)
    return np.concatenate(homes), np.concatenate(rows), np.concatenate(cells)


def _units(column: pa.Array | pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, "f8") for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(rows: np.ndarray, cols: np.ndarray, parent: list[int]) -> list[tuple[int, int]]:
    """Those of the links that join trees of the forest in ``parent``."""

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(rows.tolist(), cols.tolist()):
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _centroids(classes: DataFrame, cell_rows: int) -> dict[str, np.ndarray]:
    """Centroids of the groups that need several cells; their size is bounded by :data:`CENTROID_NUMBERS`."""
    total, numbers = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cell_rows = max(cell_rows, math.ceil(total * numbers / CENTROID_NUMBERS))
    large = classes.groupBy("grp").count().where(F.col("count") > cell_rows).withColumnRenamed("count", "n")
    drawn = spread_join(classes.select("key", "grp", "v"), large, ["grp"]).where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) * F.col("n") < F.lit((1 << 30) * SAMPLE_ROWS))

    def fit(frame):
        c = kmeans(_units(frame["v"]), math.ceil(int(frame["n"].iloc[0]) / cell_rows))
        return pd.DataFrame({"grp": [frame["grp"].iloc[0]], "c": [c.tobytes()], "dims": [c.shape[1]]})

    found = drawn.groupBy("grp").applyInPandas(fit, "grp string, c binary, dims int").collect()
    return {r.grp: np.frombuffer(bytes(r.c), "f8").reshape(-1, r.dims) for r in found}


def _placed(classes: DataFrame, centers: dict[str, np.ndarray], threshold: float) -> DataFrame:
    """Residents and visitors of every cell."""

    def place(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for grp, part in frame.groupby("grp"):
                x = _units(part["v"])
                home, row, cell = visits(x, centers[grp], threshold) if grp in centers else (np.zeros(len(x), int), np.empty(0, int), np.empty(0, int))
                who = np.r_[np.arange(len(x)), row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * len(who)), pa.array(np.r_[home, cell].astype("i4")), pa.array(np.arange(len(who)) < len(x)), pa.array(part["key"].to_numpy()[who]), pa.array(part["copies"].to_numpy()[who]), pa.array([x[i].tobytes() for i in who], pa.binary())],
                    ["grp", "cell", "home", "key", "copies", "u"],
                )

    return classes.select("grp", "v", "key", "copies").mapInArrow(place, "grp string, cell int, home boolean, key string, copies long, u binary")


def _compared(placed: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Rows (a, b, n): n links of a resident, or a link of a and b that a forest needs."""
    held = F.least(F.lit(block_rows), F.greatest(F.lit(1), F.floor(BLOCK_NUMBERS / F.substring_index("grp", "/", -1).cast("int"))))
    blocks = lambda n: F.ceil(n / held).cast("int")
    sizes = placed.groupBy("grp", "cell").agg(F.sum(F.col("home").cast("int")).alias("own"), F.count("*").alias("all")).where("own > 0")
    sizes = sizes.select("grp", "cell", blocks(F.col("own")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    dealt = spread_join(placed, sizes, ["grp", "cell"]).withColumn("h", F.hash("key"))
    meet = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("i"), F.pmod("h", "rights").alias("j"), F.lit(False).alias("left")))
    stand = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.pmod("h", "lefts").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    tasks = dealt.select("grp", "cell", "key", "copies", "u", F.explode(F.when(F.col("home"), F.concat(meet, stand)).otherwise(meet)).alias("t")).select("grp", "cell", "t.*", "key", "copies", "u")

    def compare(frame):
        x = np.frombuffer(b"".join(frame["u"]), "f8").reshape(len(frame), -1)
        keys, copies, left = frame["key"].to_numpy(), frame["copies"].to_numpy(), frame["left"].to_numpy()
        a, b = np.flatnonzero(left), np.flatnonzero(~left)
        place = {k: i for i, k in reversed(list(enumerate(keys)))}  # a vector may stand on both sides
        node = np.array([place[k] for k in keys])
        parent, links, counts = list(range(len(x))), [], np.zeros(len(a), dtype=np.int64)
        for k in range(0, len(a), STRIP):
            hit = x[a[k : k + STRIP]] @ x[b].T >= threshold
            hit &= node[a[k : k + STRIP]][:, None] != node[b][None]
            counts[k : k + STRIP] = hit @ copies[b]
            r, c = np.nonzero(hit)
            links += _forest(node[a[k + r]], node[b[c]], parent)
        some = np.flatnonzero(counts)
        return pd.DataFrame({"a": [*keys[a[some]], *(keys[i] for i, _ in links)], "b": [*[None] * len(some), *(keys[j] for _, j in links)], "n": [*counts[some], *[0] * len(links)]}).astype({"a": object, "b": object, "n": "int64"})

    return tasks.groupBy("grp", "cell", "i", "j").applyInPandas(compare, "a string, b string, n long")


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine, in double
    precision, is at least ``threshold``; components follow links of links.
    Vectors that are null, empty, zero, hold a null or non-finite component or
    have a null label link with nothing and are their own component; vectors of
    different length don't link. Rows without an id count as partners; their
    component is the smallest id they reach (null if there is none) and they
    are not kept. Repeated rows are vectors that link with each other, and all
    rows of the kept id are kept. Other columns are not read. No rows: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    finite = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(math.inf)), F.lit(False)))
    sound = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda e: e != 0), F.lit(False))
    # equal vectors of a label have equal keys and are one class
    key = F.concat(F.hex(F.xxhash64("label", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "v", "label")))
    rows = materialize(rows.withColumn("key", F.when(sound, key)).withColumn("grp", F.concat("label", F.lit("/"), F.size("v").cast("string"))), "vectors")
    keyed = rows.where("key is not null")
    classes = materialize(keyed.groupBy("key").agg(F.first("grp").alias("grp"), F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count("*").alias("copies")), "vector-classes")
    placed = materialize(_placed(classes, _centroids(classes, cell_rows), threshold), "cells")
    found = materialize(_compared(placed, threshold, block_rows), "links")
    roots = materialize(components(found.where("b is not null").select("a", "b")), "roots")
    least = classes.join(roots, classes.key == roots.node).groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = spread_join(roots, least, ["root"]).select(F.col("node").alias("key"), "least_id")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    named = materialize(classes.drop("v", "grp").join(linked, "key", "left").join(counts, "key", "left").select("key", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id")), "named")
    out = spread_join(keyed.select("vec_id", "key"), named, ["key"]).select("vec_id", "n_links", "component_id")
    out = out.union(rows.where("key is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
