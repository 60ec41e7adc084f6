"""URL filters as a sort-merge range join.

A rule is a host and a path: it fits urls of its host and of all subdomains
whose path starts with the rule's. Written with its labels reversed, each
closed by a dot, a host is a prefix of its subdomains, so a rule's host covers
one interval of the sorted keys and intervals of different hosts are nested or
apart. A sweep over sorted urls keeps the stack of hosts whose interval is open;
each entry has its host's rules by path, sorted, with a link from every path to
the longest one that is a prefix of it. The longest rule wins.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.texts import LOWER, UPPER

#: Rules of up to so many bytes are sent to every task; longer lists are dealt by range.
LOCAL_RULE_BYTES = 32 << 20
#: Urls looked at to choose the ranges.
RANGE_SAMPLE = 20_000
DEFAULT_VERDICT = "allow"
ADDED = ("host", "path", "rule", "verdict")


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: then up to ``?``, ``#`` or the end.

    Both are empty for a null url and for one without ``://``.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


class Sweep:
    """The open hosts at the present place of the sorted keys."""

    def __init__(self):
        self.stack: list[tuple[str, list[str], list[int], list[tuple[str, str]]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, rules: Iterable[tuple[str, str, str]]) -> None:
        """Open a host's interval; ``rules`` are (path, rule, verdict), sorted by path."""
        self._close(key)
        paths: list[str] = []
        above: list[int] = []
        values: list[tuple[str, str]] = []
        nested: list[int] = []  # the same sweep over the paths
        for path, rule, verdict in rules:
            while nested and not path.startswith(paths[nested[-1]]):
                nested.pop()
            above.append(nested[-1] if nested else -1)
            nested.append(len(paths))
            paths.append(path)
            values.append((rule, verdict))
        self.stack.append((key, paths, above, values))

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict of the longest rule that fits; of equally long ones, the one with the longer host."""
        self._close(key)
        best: tuple[str | None, str | None] = (None, None)
        for _, paths, above, values in reversed(self.stack):
            i = bisect_right(paths, path) - 1
            while i >= 0 and not path.startswith(paths[i]):
                i = above[i]
            if i >= 0 and (best[0] is None or len(values[i][0]) > len(best[0])):
                best = values[i]
        return best


def sorted_rules(rules: Iterable[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Rules (host, path, verdict) as (key, [(path, rule, verdict)]) in order; of repeated rules block wins, then the smallest verdict."""
    chosen: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        if host is None:
            continue
        at = (host.translate(str.maketrans(UPPER, LOWER)), path or "")
        both = [v for v in (verdict, chosen.get(at)) if v is not None]
        chosen[at] = "block" if "block" in both else min(both, default=None)
    by: dict[str, list[tuple[str, str, str]]] = {}
    for (host, path), verdict in chosen.items():
        by.setdefault(reversed_host(host), []).append((path, host + path, verdict))
    return [(k, sorted(v)) for k, v in sorted(by.items())]


def _sweep(batches: Iterable[pa.RecordBatch], rules: Iterator[tuple[str, list]], names: list[str], default: str) -> Iterator[pa.RecordBatch]:
    """Merge sorted urls with sorted rules."""
    sweep, rules = Sweep(), iter(rules)
    coming = next(rules, None)
    for batch in batches:
        rule, verdict = [], []
        for key, path in zip(batch.column("_key").to_pylist(), batch.column("path").to_pylist()):
            while coming and coming[0] <= key:
                sweep.open(*coming)
                coming = next(rules, None)
            r, v = sweep.find(key, path)
            rule.append(r)
            verdict.append(v or default)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [*names, "rule", "verdict"])


def _kept(keep: list[str]) -> list[str]:
    return [k for k in keep if k.lower() not in ADDED]


def _keyed(urls: DataFrame, keep: list[str], url_col: str) -> DataFrame:
    """Kept columns under names of our own, host, path and the sort key."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    kept = urls.select(*[F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)], host.alias("host"), path.alias("path"))
    return kept.withColumn("_key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))


def filter_urls(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, keep: list[str], url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Judge every row's url: columns ``keep``, host, path, rule, verdict.

    ``rules`` are (host, path, verdict), as a list or as a DataFrame of such
    columns. Rules of up to :data:`LOCAL_RULE_BYTES` are broadcast and merged
    with every partition of urls, which are sorted where they are, without a
    shuffle. More are dealt by ranges of keys along with the urls
    (:func:`filter_urls_by_range`), with the same result.

    Null urls and urls without ``://`` have empty host and path, which no rule
    fits, and get the ``default``, as do urls whose rule has no verdict. Rules
    without a host are left out, a null path fits all paths; of rules that
    contradict each other block wins, then the smallest verdict. Repeated urls
    are judged each. Columns not in ``keep`` are dropped, whatever their names;
    a column of ``keep`` that has the name of one of those added is replaced by
    it. No rows: no rows.
    """
    spark = urls.sparkSession
    size = lambda *words: sum(len((w or "").encode()) for w in words) + 64
    if isinstance(rules, DataFrame):
        width = sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in rules.columns[:2]) + 64
        if (rules.agg(F.sum(width)).first()[0] or 0) > LOCAL_RULE_BYTES:
            return filter_urls_by_range(urls, rules, keep, url_col, default)
        rules = [tuple(r) for r in rules.collect()]
    elif sum(size(*r[:2]) for r in rules) > LOCAL_RULE_BYTES:
        return filter_urls_by_range(urls, spark.createDataFrame(rules, "host string, path string, verdict string"), keep, url_col, default)
    ready = spark.sparkContext.broadcast(sorted_rules(rules))
    keep = _kept(keep)
    keyed = _keyed(urls, keep, url_col)
    names = [c for c in keyed.columns if c != "_key"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema if f.name != "_key") + ", rule string, verdict string"
    return keyed.sortWithinPartitions("_key").mapInArrow(lambda batches: _sweep(batches, iter(ready.value), names, default), schema).toDF(*keep, *ADDED)


def filter_urls_by_range(urls: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", default: str = DEFAULT_VERDICT, ranges: int | None = None) -> DataFrame:
    """The same for rule lists of any size: both sides are dealt by ranges of keys.

    Range bounds come from a bounded sample of the urls' keys and affect only
    the balance. A rule's host goes to every range that its interval meets, and
    to every part of a range whose urls are many. Nulls, repeated rows, names
    and empty tables are as in :func:`filter_urls`; without rules every url
    gets the ``default``.
    """
    spark = urls.sparkSession
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = _kept(keep)
    keyed = _keyed(urls, keep, url_col)
    total = keyed.count()
    drawn = keyed.select("_key").sample(min(1.0, RANGE_SAMPLE / max(total, 1)), seed=11).limit(2 * RANGE_SAMPLE)
    keys = sorted(r[0] for r in drawn.collect())
    hits = [keys[len(keys) * i // count] for i in range(1, count)] if keys else []
    bounds = sorted(set(hits))
    # a range that one key fills alone is split in as many parts as bounds fell on it
    parts = [1, *(hits.count(b) for b in bounds)]
    cuts = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<string>")
    place = lambda c: F.size(F.filter(cuts, lambda b: b <= c))
    many = F.element_at(F.array(*map(F.lit, parts)), F.col("_range") + 1)
    names = [c for c in keyed.columns if c != "_key"]
    host, path, verdict = rules.columns
    clean = rules.where(F.col(host).isNotNull()).groupBy(F.translate(F.col(host), UPPER, LOWER).alias("host"), F.coalesce(F.col(path), F.lit("")).alias("path")).agg(F.min(F.when(F.col(verdict) == "block", 0).otherwise(1)).alias("b"), F.min(verdict).alias("v"))
    clean = clean.select("host", "path", F.when(F.col("b") == 0, "block").otherwise(F.col("v")).alias("verdict")).withColumn("_key", F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(".")))
    spread = clean.withColumn("_range", F.explode(F.sequence(place(F.col("_key")), place(F.concat("_key", F.lit(chr(0x10FFFF))))))).withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
    left = spread.select("_range", "_part", "_key", F.lit(0).alias("_kind"), F.col("path").alias("_path"), F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_verdict"), *[F.lit(None).cast(keyed.schema[n].dataType).alias(n) for n in names])
    right = keyed.withColumn("_range", place(F.col("_key"))).withColumn("_part", F.pmod(F.xxhash64("_key", *names), many).cast("int"))
    right = right.select("_range", "_part", "_key", F.lit(1).alias("_kind"), "path", F.lit(None).cast("string"), F.lit(None).cast("string"), *names)
    both = left.union(right).repartition(count, "_range", "_part").sortWithinPartitions("_range", "_part", "_key", "_kind", "_path")

    def run(batches):
        sweep, at, waiting, here = Sweep(), None, None, None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            take, rule, judged = [], [], []
            for i, (rng, part, key, kind, path_, rule_, verdict_) in enumerate(zip(*cols)):
                if (rng, part) != at:
                    sweep, at, waiting = Sweep(), (rng, part), None
                if kind == 0:
                    if waiting is None or here != key:
                        if waiting:
                            sweep.open(here, waiting)
                        waiting, here = [], key
                    waiting.append((path_, rule_, verdict_))
                    continue
                if waiting:
                    sweep.open(here, waiting)
                    waiting = None
                r, v = sweep.find(key, path_)
                take.append(i)
                rule.append(r)
                judged.append(v or default)
            if take:
                part = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(rule, pa.string()), pa.array(judged, pa.string())], [*names, "rule", "verdict"])

    schema = ", ".join(f"`{n}` {keyed.schema[n].dataType.simpleString()}" for n in names) + ", rule string, verdict string"
    return both.mapInArrow(run, schema).toDF(*keep, *ADDED)
