"""Candidate pairs by shared keys, and the set operations around them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.sources.storage import materialize, spread_join

#: Members of a block that are held at a time, about.
PACK = 2048


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def not_blank(value: Column) -> Column:
    return value.isNotNull() & ~value.rlike(r"^\s*$")


def one_payload(rows: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row a key: the smallest payload, whatever the order of rows."""
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_p"))
    return picked.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in payload])


def block_sizes(rows: DataFrame, key: str) -> DataFrame:
    """Members of each block; pre-aggregated before the shuffle."""
    return rows.groupBy(key).agg(F.count("*").alias("block_size"))


def shared_rows(rows: DataFrame, key: str) -> DataFrame:
    """Rows of blocks of more than one member, with their block's size."""
    return spread_join(rows, block_sizes(rows, key).where("block_size > 1"), [key])


def blocked_pairs(rows: DataFrame, key: str, entity: str, payload: Sequence[str] = (), loose: Sequence[str] = ()) -> DataFrame:
    """All pairs of entities that share a key: entity_id_1 < entity_id_2, the key and both payloads (``_1``, ``_2``).

    ``loose`` is a payload whose ``_1`` and ``_2`` are in no fixed order, for
    what is the same either way; ordering them costs more than most scores.

    ``rows`` has one row a key and entity. Members of a block are cut into packs
    of about :data:`PACK` by a hash. Every two packs are joined by a key of
    their own and dealt to tasks by number: a task holds one pack at a time, a
    block of any size is spread over all tasks, and no pair is shuffled.
    """
    kept = shared_rows(rows, key).withColumn("_packs", F.ceil(F.col("block_size") / PACK).cast("int")).withColumn("_p", F.pmod(F.xxhash64(entity), "_packs").cast("int"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number, as few bytes may be many pairs
    keys = ["_h", "_key", "_i", "_j"]

    def side(own: str, other: str, others: Column, i: int) -> DataFrame:
        met = kept.select(F.col(key).alias("_key"), F.col("_p").alias(own), F.explode(others).alias(other), F.col(entity).alias(f"_e{i}"), *[F.col(c).alias(f"_{i}_{c}") for c in payload], *[F.col(c).alias(f"{c}_{i}") for c in loose])
        return met.withColumn("_h", F.xxhash64("_key", "_i", "_j")).repartition(n, *keys)

    a, b = side("_i", "_j", F.sequence("_p", F.col("_packs") - 1), 1), side("_j", "_i", F.sequence(F.lit(0), "_p"), 2)
    swap = F.col("_e1") > F.col("_e2")
    met = a.hint("merge").join(b, keys).where((F.col("_e1") < F.col("_e2")) | ((F.col("_i") < F.col("_j")) & swap))
    ends = lambda c: (F.when(swap, F.col(f"_2_{c}")).otherwise(F.col(f"_1_{c}")), F.when(swap, F.col(f"_1_{c}")).otherwise(F.col(f"_2_{c}")))
    return met.select(F.col("_key").alias(key), F.least("_e1", "_e2").alias("entity_id_1"), F.greatest("_e1", "_e2").alias("entity_id_2"), *[x.alias(f"{c}_{i}") for c in payload for i, x in enumerate(ends(c), 1)], *[f"{c}_{i}" for c in loose for i in "12"])


def flagged_rows(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """Rows of shared blocks, ``_many`` where their entity is in several; kept in the shared folder, as every later step reads them again."""
    kept = shared_rows(materialize(rows, "keys"), key).drop("block_size")
    return materialize(spread_join(kept, kept.groupBy(entity).agg((F.count("*") > 1).alias("_many")), [entity]), "blocks")


def best_blocked_pairs(rows: DataFrame, key: str, entity: str, payload: Sequence[str], scored: Callable[[DataFrame], DataFrame], loose: Sequence[str] = ()) -> DataFrame:
    """One row a pair of :func:`blocked_pairs`, after ``scored`` gave it a ``score``: the best score, then the smallest key.

    Two entities can only meet twice if both have several keys that others have
    too. Only pairs of these are ranked; all others stay where they are made.
    """
    flagged = flagged_rows(rows, key, entity)
    once = scored(blocked_pairs(flagged, key, entity, payload, [*loose, "_many"]).where(~(F.col("_many_1") & F.col("_many_2"))).drop("_many_1", "_many_2"))
    if flagged.where("_many").isEmpty():
        return once
    again = best_pairs(scored(blocked_pairs(flagged.where("_many").drop("_many"), key, entity, payload, loose)), "score", key)
    return once.unionByName(again)


def packed_join(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: str, by: Sequence[str]) -> DataFrame:
    """Inner join in which the rows of a key meet in lots of about :data:`PACK` by :data:`PACK` units of weight, dealt to tasks by number.

    ``weight`` and ``by``, what rows of a key differ in, are columns of both
    sides, named with ``_1`` and ``_2``.
    """
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = lambda rows, weight, name: rows.groupBy(*keys).agg(F.ceil(F.sum(weight) / PACK).cast("int").alias(name))
    cuts = parts(a, f"{weight}_1", "_n1").join(parts(b, f"{weight}_2", "_n2"), [*keys])
    place = lambda x, own, other, i, j: spread_join(x, cuts, [*keys]).withColumn(own, F.pmod(F.xxhash64(*[f"{c}_{i}" for c in by]), f"_n{i}").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"_n{j}") - 1))).drop("_n1", "_n2", f"{weight}_{i}")
    dealt = [*keys, "_i", "_j"]
    met = [x.withColumn("_h", F.xxhash64(*dealt)).repartition(n, "_h", *dealt) for x in (place(a, "_i", "_j", 1, 2), place(b, "_j", "_i", 2, 1))]
    return met[0].join(met[1], ["_h", *dealt]).drop("_h", "_i", "_j")


def packed_members(rows: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """The entities of each key as arrays ``members`` of about :data:`PACK` at most, numbered by ``pack``."""
    cut = spread_join(rows, rows.groupBy(*keys).agg(F.ceil(F.count("*") / PACK).cast("int").alias("_n")), [*keys]).withColumn("pack", F.pmod(F.xxhash64(entity), "_n"))
    return cut.groupBy(*keys, "pack").agg(F.collect_list(entity).alias("members"))


def block_members(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """Blocks without their pairs: key, entity, the block's smallest entity and its size."""
    stats = rows.groupBy(key).agg(F.min(entity).alias("representative"), F.count("*").alias("block_size")).where("block_size > 1")
    return rows.select(key, entity).join(stats, key)


def exclude_existing(pairs: DataFrame, existing: DataFrame, method: str | None = None) -> DataFrame:
    """Pairs that an earlier run hasn't made (by ``method``, if given); stored pairs may be in either order."""
    if method is not None:
        existing = existing.where(F.col("method_type") == method)
    old = existing.select(F.least("entity_id_1", "entity_id_2").alias("entity_id_1"), F.greatest("entity_id_1", "entity_id_2").alias("entity_id_2")).distinct()
    return pairs.join(old, ["entity_id_1", "entity_id_2"], "left_anti")


def best_pairs(pairs: DataFrame, score: str, key: str) -> DataFrame:
    """One row a pair, though several keys made it: the best score, then the smallest key."""
    w = Window.partitionBy("entity_id_1", "entity_id_2").orderBy(F.col(score).desc(), F.col(key))
    return pairs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def canonical(pairs: DataFrame, a: str, b: str, payload: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Pairs with the smaller id first, payload columns swapped along; self pairs go."""
    swap = F.col(a) > F.col(b)
    return pairs.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("entity_id_1"),
        F.greatest(a, b).alias("entity_id_2"),
        *[x for p, q in payload for x in (F.when(swap, F.col(q)).otherwise(F.col(p)).alias(p), F.when(swap, F.col(p)).otherwise(F.col(q)).alias(q))],
    )


def both_sides(pairs: DataFrame, *carry: str) -> DataFrame:
    """A row for each end of a pair."""
    return pairs.select(*carry, F.explode(F.array("entity_id_1", "entity_id_2")).alias("entity_id"))


def valid_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of which both ends are in ``entities`` (column ``entity_id``)."""
    ids = entities.select("entity_id").distinct()
    return pairs.join(ids.withColumnRenamed("entity_id", "entity_id_1"), "entity_id_1", "left_semi").join(ids.withColumnRenamed("entity_id", "entity_id_2"), "entity_id_2", "left_semi").select(pairs.columns)
