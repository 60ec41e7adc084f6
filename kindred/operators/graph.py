"""The graph of pairs, its communities, and clusters of entities."""

from __future__ import annotations

import random
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions import constants as K
from kindred.operators.blocking import both_sides
from kindred.operators.components import components
from kindred.sources.io import stable_id

#: Runs of community detection, each with its own order of nodes, of which the best is taken.
STARTS = 4


def noisy_or(weights: Column) -> Column:
    """One less the product of what each weight leaves open; weights are taken between 0 and 1, in sorted order."""
    return 1 - F.aggregate(F.array_sort(F.transform(weights, lambda w: F.greatest(F.least(F.coalesce(w, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))), F.lit(1.0), lambda p, w: p * (1 - w))


def pair_graph(pairs: DataFrame) -> DataFrame:
    """Links of pairs that share an entity: source_id < target_id, weight, shared (entity and its part of the weight).

    ``pairs``: id, entity_id_1, entity_id_2, confidence_score (null counts 0). An
    entity's part is the mean of both confidences; parts combine as noisy-or.
    Links of weight 0 are left out.
    """
    ends = both_sides(pairs, "id", "confidence_score").withColumn("c", F.coalesce("confidence_score", F.lit(0.0)))
    a = ends.select(F.col("entity_id").alias("a"), F.col("id").alias("source_id"), F.col("c").alias("c1"))
    b = ends.select(F.col("entity_id").alias("b"), F.col("id").alias("target_id"), F.col("c").alias("c2"))
    met = a.join(b, (F.col("a") == F.col("b")) & (F.col("source_id") < F.col("target_id"))).select("source_id", "target_id", F.col("a").alias("entity_id"), ((F.col("c1") + F.col("c2")) / 2).alias("w_z"))
    links = met.groupBy("source_id", "target_id").agg(F.array_sort(F.collect_list(F.struct("entity_id", "w_z"))).alias("shared"))
    return links.withColumn("weight", noisy_or(F.transform("shared", lambda s: s["w_z"]))).where("weight > 0").select("source_id", "target_id", "weight", "shared")


def formation_edges(links: DataFrame, run: str) -> DataFrame:
    return links.select(F.lit(run).alias("pipeline_run_id"), F.col("source_id").alias("source_group_id"), F.col("target_id").alias("target_group_id"), F.col("weight").alias("calculated_edge_weight"), F.to_json("shared").alias("contributing_shared_entities"))


class _Level:
    """One level of aggregation: neighbours with weights, weights inside nodes, and sums that modularity needs."""

    def __init__(self, graph: list[dict[int, float]], loops: list[float], resolution: float):
        self.graph, self.loops = graph, loops
        self.strength = [sum(g.values()) + 2 * loops[i] for i, g in enumerate(graph)]
        self.total = sum(self.strength)
        self.scale = resolution / self.total if self.total else 0.0

    def move(self, home: list[int], order: list[int]) -> list[int]:
        """Move nodes to the neighbouring community of the largest gain until none gains."""
        home, mass = home[:], [0.0] * len(home)
        for i, h in enumerate(home):
            mass[h] += self.strength[i]
        waiting = deque(order)
        queued = [True] * len(home)
        while waiting:
            i = waiting.popleft()
            queued[i] = False
            near: dict[int, float] = {home[i]: 0.0}
            for j, w in self.graph[i].items():
                near[home[j]] = near.get(home[j], 0.0) + w
            own, k = home[i], self.strength[i] * self.scale
            mass[own] -= self.strength[i]
            best, most = own, near[own] - k * mass[own]
            for c in sorted(near):
                if near[c] - k * mass[c] > most + 1e-12:
                    best, most = c, near[c] - k * mass[c]
            mass[best] += self.strength[i]
            if best != own:
                home[i] = best
                for j in self.graph[i]:
                    if home[j] != best and not queued[j]:
                        queued[j] = True
                        waiting.append(j)
        return home

    def refine(self, home: list[int], order: list[int]) -> list[int]:
        """Parts of communities: single nodes merge, inside their community, with the part of the largest gain.

        Only nodes and parts that are well connected to the rest of their
        community take part, so every part is connected.
        """
        n = len(home)
        whole = [0.0] * n
        for i, h in enumerate(home):
            whole[h] += self.strength[i]
        part, mass, size = list(range(n)), self.strength[:], [1] * n
        cut = [sum(w for j, w in g.items() if home[j] == home[i]) for i, g in enumerate(self.graph)]
        bound = lambda m, h: self.scale * m * (whole[h] - m) - 1e-12
        for i in order:
            if size[part[i]] != 1 or part[i] != i or cut[i] < bound(mass[i], home[i]):
                continue
            near: dict[int, float] = {}
            for j, w in self.graph[i].items():
                if home[j] == home[i]:
                    near[part[j]] = near.get(part[j], 0.0) + w
            best, most = i, 1e-12
            for c in sorted(near):
                gain = near[c] - self.scale * self.strength[i] * mass[c]
                if c != i and gain > most and cut[c] >= bound(mass[c], home[i]):
                    best, most = c, gain
            if best != i:
                part[i] = best
                cut[best] += cut[i] - 2 * near[best]
                mass[best] += mass[i]
                size[best] += 1
                size[i] = 0
        return part

    def quality(self, home: list[int]) -> float:
        """Modularity of a partition, but for a constant factor."""
        mass = [0.0] * len(home)
        inside = 0.0
        for i, h in enumerate(home):
            mass[h] += self.strength[i]
            inside += 2 * self.loops[i] + sum(w for j, w in self.graph[i].items() if home[j] == h)
        return inside - self.scale * sum(m * m for m in mass)

    def merged(self, part: list[int], resolution: float) -> tuple[_Level, list[int]]:
        """The graph of parts, and each node's place in it."""
        number = {p: k for k, p in enumerate(dict.fromkeys(part))}
        at = [number[p] for p in part]
        graph: list[dict[int, float]] = [{} for _ in number]
        loops = [0.0] * len(number)
        for i, g in enumerate(self.graph):
            loops[at[i]] += self.loops[i]
            for j, w in g.items():
                if at[i] == at[j]:
                    loops[at[i]] += w / 2
                else:
                    graph[at[i]][at[j]] = graph[at[i]].get(at[j], 0.0) + w
        return _Level(graph, loops, resolution), at


def _leiden(level: _Level, order: list[int], resolution: float, rounds: int) -> list[int]:
    """Communities of a level's nodes; ``order`` is the order in which they are visited first."""
    place, home = list(range(len(order))), list(range(len(order)))  # of nodes in the level, and of the level's nodes
    for _ in range(rounds):
        home = level.move(home, order)
        above, up = level.merged(level.refine(home, order), resolution)
        if len(above.graph) == len(level.graph):
            break
        named: dict[int, int] = {}  # communities, by their first part
        start = [0] * len(above.graph)
        for i, k in enumerate(up):
            start[k] = named.setdefault(home[i], k)
        level, home, place, order = above, start, [up[k] for k in place], list(range(len(above.graph)))
    return [home[k] for k in place]


def communities_of(nodes: list, links: list[tuple], resolution: float = K.LEIDEN_RESOLUTION, rounds: int = 10) -> dict:
    """Communities of one component by modularity: local moves, refinement inside communities, aggregation of the refined parts.

    The best of :data:`STARTS` runs with different, fixed orders of nodes, so
    that equal input has equal results. ``links``: (source, target, weight). Every community is connected. Returns each node's
    community, named by its smallest node.
    """
    order = sorted(nodes)
    at = {v: i for i, v in enumerate(order)}
    graph: list[dict[int, float]] = [{} for _ in order]
    loops = [0.0] * len(order)
    for s, t, w in links:
        i, j = at[s], at[t]
        if i == j:
            loops[i] += w
        else:
            graph[i][j] = graph[i].get(j, 0.0) + w
            graph[j][i] = graph[j].get(i, 0.0) + w
    base = _Level(graph, loops, resolution)
    label = max((_leiden(base, random.Random(k).sample(range(len(order)), len(order)) if k else list(range(len(order))), resolution, rounds) for k in range(STARTS)), key=base.quality)
    out: dict = {}
    for i, v in enumerate(order):  # in order, so that the first node met is the smallest; what isn't connected is apart
        if v in out:
            continue
        out[v], stack = v, [i]
        while stack:
            k = stack.pop()
            for j in graph[k]:
                if order[j] not in out and label[j] == label[i]:
                    out[order[j]] = v
                    stack.append(j)
    return out


def communities(links: DataFrame, method: str = "leiden", resolution: float = K.LEIDEN_RESOLUTION) -> DataFrame:
    """Community of every linked pair: id, community.

    ``components`` takes connected components. ``leiden`` splits each component
    further, all its links kept, in a task of its own, whose memory grows with
    the component.
    """
    whole = components(links.select("source_id", "target_id")).withColumnRenamed("root", "component")
    if method == "components":
        return whole.select(F.col("node").alias("id"), F.col("component").alias("community"))
    left = links.select("source_id", "target_id", "weight")

    def split_up(frame: pd.DataFrame) -> pd.DataFrame:
        found = communities_of(sorted({*frame["source_id"], *frame["target_id"]}), list(zip(frame["source_id"], frame["target_id"], frame["weight"])), resolution)
        return pd.DataFrame({"id": list(found), "community": list(found.values())}, dtype=object)

    kind = links.schema["source_id"].dataType.simpleString()
    return left.join(whole.withColumnRenamed("node", "source_id"), "source_id").groupBy("component").applyInPandas(split_up, f"id {kind}, community {kind}")


def clusters(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Cluster records of communities: id, name, description, entity_count, group_count; pairs without links are their own."""
    placed = pairs.join(found, "id", "left").withColumn("community", F.coalesce("community", "id"))
    counts = both_sides(placed, "community", "id").groupBy("community").agg(F.count_distinct("entity_id").alias("entity_count"), F.count_distinct("id").alias("group_count")).where("entity_count >= 2")
    return counts.select(
        stable_id(F.lit("cluster"), F.col("community")).alias("id"), "community", F.concat(F.lit("LeidenCluster-"), F.substring(stable_id(F.lit("cluster"), F.col("community")), 1, 8)).alias("name"),
        F.format_string("Cluster of %d entities from %d pairs", "entity_count", "group_count").alias("description"), "entity_count", "group_count",
    )


def assign_clusters(pairs: DataFrame, found: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with ``group_cluster_id`` set where it was null."""
    of = pairs.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community")).join(records.select("community", F.col("id").alias("_cluster")), "community").select("id", "_cluster")
    return pairs.join(of, "id", "left").withColumn("group_cluster_id", F.coalesce("group_cluster_id", "_cluster")).select(pairs.columns)


def sized_coherence(pairs: DataFrame, most: int = 20) -> DataFrame:
    """Pairs of each cluster and their mean confidence, of at most ``most`` chosen by a hash. Only clusters of more pairs are sorted."""
    rows = pairs.where("group_cluster_id is not null").select(F.col("group_cluster_id").alias("id"), F.col("id").alias("_pair"), F.coalesce("confidence_score", "pre_rl_confidence_score", F.lit(0.0)).alias("_c"))
    rows = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")  # both uses below share it, and no task has more clusters than its share
    means = rows.groupBy("id").agg(F.count("*").alias("pairs"), F.avg("_c").alias("average_coherence_score"))
    many = means.where(F.col("pairs") > most).select("id", "pairs")
    w = Window.partitionBy("id").orderBy(F.xxhash64("_pair"), "_pair")
    drawn = rows.join(many.hint("shuffle_hash"), "id").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    return means.where(F.col("pairs") <= most).unionByName(drawn.groupBy("id", "pairs").agg(F.avg("_c").alias("average_coherence_score")))


def coherence_scores(pairs: DataFrame, most: int = 20) -> DataFrame:
    """Mean confidence of each cluster's pairs, of at most ``most`` chosen by a hash; where it is low, a split is suggested."""
    return sized_coherence(pairs, most).drop("pairs").withColumn("suggest_split", F.col("average_coherence_score") < K.VERIFICATION_COHERENCE)


def sampled_entity_pairs(members: DataFrame, entities: int = 10, most: int = 20) -> DataFrame:
    """Pairs of entities for a cluster's review (cluster_id, entity_id): of ten entities by a hash, at most twenty pairs."""
    w = Window.partitionBy("cluster_id").orderBy(F.xxhash64("entity_id"), "entity_id")
    few = members.distinct().withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= entities).drop("_rank")
    a, b = few.select("cluster_id", F.col("entity_id").alias("entity_id_1")), few.select("cluster_id", F.col("entity_id").alias("entity_id_2"))
    v = Window.partitionBy("cluster_id").orderBy(F.xxhash64("entity_id_1", "entity_id_2"), "entity_id_1", "entity_id_2")
    return a.join(b, "cluster_id").where("entity_id_1 < entity_id_2").withColumn("_rank", F.row_number().over(v)).where(F.col("_rank") <= most).drop("_rank")


def simulate_split(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Whether taking the links in ``removed`` (cluster_id, entity_id_1, entity_id_2) out leaves a cluster in parts.

    Returns cluster_id, can_split, parts for every cluster with a removed link.
    """
    keys = ["cluster_id", "entity_id_1", "entity_id_2"]
    touched = edges.join(removed.select("cluster_id").distinct(), "cluster_id", "left_semi")
    rest = touched.join(removed.select(keys), keys, "left_anti")
    node = lambda c: F.struct("cluster_id", F.col(c).alias("entity_id"))
    roots = components(rest.select(node("entity_id_1").alias("a"), node("entity_id_2").alias("b")))
    members = both_sides(touched, "cluster_id").distinct()
    placed = members.join(roots.select("node.cluster_id", "node.entity_id", F.col("root.entity_id").alias("part")), ["cluster_id", "entity_id"], "left").withColumn("part", F.coalesce("part", "entity_id"))
    return placed.groupBy("cluster_id").agg(F.count_distinct("part").alias("parts")).select("cluster_id", (F.col("parts") > 1).alias("can_split"), "parts")


def blended_confidence(plain: Column, tuned: Column, weight: Column) -> Column:
    """Both confidences by weight; a missing one is taken from the other, then 0."""
    return (1 - weight) * F.coalesce(plain, tuned, F.lit(0.0)) + weight * F.coalesce(tuned, plain, F.lit(0.0))


def visualization_edges(pairs: DataFrame, weight: DataFrame, run: str) -> DataFrame:
    """Edges between entities of a cluster, from all methods that tie them in any cluster.

    ``weight`` has one row, ``rl_weight``. Edge weights combine the methods'
    blended confidences as noisy-or.
    """
    members = both_sides(pairs.where("group_cluster_id is not null"), "group_cluster_id").distinct()
    scored = pairs.crossJoin(F.broadcast(weight)).withColumn("b", blended_confidence(F.col("pre_rl_confidence_score"), F.col("confidence_score"), F.col("rl_weight")))
    ties = scored.groupBy("entity_id_1", "entity_id_2").agg(F.array_sort(F.collect_list(F.struct("method_type", "b"))).alias("ties"))
    one = members.select(F.col("group_cluster_id").alias("cluster_id"), F.col("entity_id").alias("entity_id_1"))
    two = members.select(F.col("group_cluster_id").alias("cluster_id"), F.col("entity_id").alias("entity_id_2"))
    inside = ties.join(one, "entity_id_1").join(two, ["cluster_id", "entity_id_2"])
    return inside.select(stable_id(F.lit(run), F.col("cluster_id"), F.col("entity_id_1"), F.col("entity_id_2")).alias("id"), "cluster_id", "entity_id_1", "entity_id_2", noisy_or(F.transform("ties", lambda t: t["b"])).alias("edge_weight"), F.to_json("ties").alias("details"), F.lit(run).alias("pipeline_run_id"))


def node_degrees(edges: DataFrame) -> DataFrame:
    return both_sides(edges, "cluster_id").groupBy("cluster_id", "entity_id").agg(F.count("*").alias("degree"))


def most_connected(edges: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy(F.col("degree").desc(), "entity_id")
    return node_degrees(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def weakest_edges(edges: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("cluster_id").orderBy("edge_weight", "entity_id_1", "entity_id_2")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
