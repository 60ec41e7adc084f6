"""Reading and writing tables; every sink is a set operation whose repetition changes nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A table by name: over JDBC if ``root`` is a ``jdbc:`` address, else Parquet under the folder."""
    if root.startswith("jdbc:"):
        found = spark.read.format("jdbc").options(url=root, dbtable=name, **(options or {})).load()
    else:
        found = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
    return found.select(*columns) if columns else found


def jdbc_partitions(column: str, lower: int, upper: int, tasks: int) -> dict[str, str]:
    """Options that let a JDBC table be read by ranges of a key, one connection a task."""
    return {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(tasks)}


def stable_id(*parts: Column) -> Column:
    """An id that depends on its parts alone, so that repeated runs write the same rows."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def new_rows(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert that ignores conflicts: rows whose key is neither in ``existing`` nor twice in ``rows``."""
    return rows.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def merge(existing: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Upsert: rows of ``changes`` replace those of the same key; columns in ``keep`` stay as they were where the key existed."""
    columns = existing.columns
    if keep:
        old = existing.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_had"))
        changes = changes.join(old, list(keys), "left").select(*[F.when(F.col("_had"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in columns])
    return existing.join(changes.select(*keys), list(keys), "left_anti").select(columns).unionByName(changes.select(columns))


def set_where(existing: DataFrame, values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Update by key: ``columns`` take the new value where there is one that isn't null."""
    new = values.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return existing.join(new, list(keys), "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def overwrite_run(rows: DataFrame, path: str, partition: str = "pipeline_run_id") -> None:
    """Delete a run's rows and insert them anew: only the partitions that ``rows`` has are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def oldest(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """A queue's next ``n`` rows."""
    return rows.orderBy(*order).limit(n)


def page(rows: DataFrame, order: Sequence[str], number: int, size: int = 20) -> DataFrame:
    """A page of a listing, the first being number 1."""
    return rows.orderBy(*order).offset(max(0, number - 1) * size).limit(size)


def checked(value: Column, allowed: Sequence[str], what: str) -> Column:
    """A trimmed value of an enumeration; anything else ends the query."""
    v = F.trim(value)
    return F.when(v.isNull() | v.isin(*allowed), v).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), v)))


def or_default(value: Column, allowed: Sequence[str], default: str) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise(default)


def same_id(a: Column, b: Column) -> Column:
    """Ids of fixed width compare without their padding."""
    return F.trim(a) == F.trim(b)


def tagged(kind: str, values: Column) -> Column:
    """A tagged JSON value: ``{"type": kind, "values": {...}}``."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), values.alias("values")))


def tag_of(value: Column) -> Column:
    return F.get_json_object(value, "$.type")


def save_model(spark: SparkSession, model: DataFrame, models: DataFrame, model_type: str) -> DataFrame:
    """Rows to append for a new version of a model held as a small table: parameters as JSON, the last id kept."""
    last = models.where(F.col("model_type") == model_type).agg(F.max_by("id", "version").alias("id"), F.max("version").alias("version"))
    packed = model.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*model.columns)))).alias("parameters"))
    return packed.crossJoin(last).select(F.coalesce("id", F.sha2(F.lit(model_type), 256)).alias("id"), F.lit(model_type).alias("model_type"), "parameters", F.lit(None).cast("string").alias("metrics"), (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"))


def load_model(models: DataFrame, model_type: str, schema: str) -> DataFrame:
    """The latest version's rows; none if the model was never saved."""
    newest = models.where(F.col("model_type") == model_type).agg(F.max_by("parameters", "version").alias("p"))
    return newest.select(F.explode(F.from_json("p", f"array<struct<{schema}>>")).alias("r")).select("r.*")
