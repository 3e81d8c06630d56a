"""State changes: each takes a table and a change and gives the next table; a writer swaps snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def apply_columns(table: DataFrame, change: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Set columns by key where the change has a row; a change of an unknown key fails the whole batch."""
    lost = change.join(table.select(key), key, "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"the change names a {key} that the table lacks")
    new = change.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = table.join(new, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def hydrate(table: DataFrame, extracted: DataFrame, key: str = "id", least: int = 600) -> DataFrame:
    """Replace thin bodies by extracted texts of ``least`` characters or more."""
    new = extracted.select(key, F.col("main_text").alias("_text"))
    use = (F.length("main_text") < least) & (F.length("_text") >= least)
    return table.join(new, key, "left").withColumn("main_text", F.when(use, F.col("_text")).otherwise(F.col("main_text"))).drop("_text")


def replace_groups(old: DataFrame, new: DataFrame, members: str = "id", group: str = "cluster_id") -> DataFrame:
    """Membership after old groups that share a member with a new one are swapped for the new ones."""
    touched = old.join(new.select(members), members, "left_semi").select(group).distinct()
    kept = old.join(touched, group, "left_anti")
    return kept.select(members, group).unionByName(new.select(members, group))


def delete_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def clear_reference(table: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """Null a foreign key whose target is gone."""
    lost = gone.select(F.col(column).alias("_gone")).distinct()
    joined = table.join(lost, F.col(column) == F.col("_gone"), "left")
    return joined.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def prune(table: DataFrame, protected: DataFrame, key: str, old: Column) -> DataFrame:
    """Drop old rows, but none whose key is protected."""
    doomed = table.where(old).select(key).join(protected.select(key), key, "left_anti").distinct()
    return table.join(doomed, key, "left_anti")


def upsert(table: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """The change's rows, and the table's others."""
    return table.join(change.select(key), key, "left_anti").unionByName(change)


COMMITS = "version string, mode string, at timestamp"


def write_snapshot(df: DataFrame, root: str, mode: str = "overwrite") -> str:
    """Write rows beside the old ones, then commit them with one row of a log; readers see a table with or without them whole.

    A writer that fails leaves no commit, so the table is as before. Commits add to each other: two appends at once both count,
    and an overwrite hides what was committed before it.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    version, rows = staged(df, root)
    commit_snapshot(rows, root, version, mode)
    return version


def staged(df: DataFrame, root: str) -> tuple[str, DataFrame]:
    """Rows written beside the old ones without a commit: the version to commit, and the rows as written."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    return version, df.sparkSession.read.schema(df.schema).parquet(f"{root}/{version}")


def commit_snapshot(df: DataFrame, root: str, version: str, mode: str = "overwrite") -> None:
    """Commit a staged version; ``df`` names the session."""
    commit = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.lit(mode).alias("mode"), F.current_timestamp().alias("at"))
    commit.coalesce(1).write.mode("append").json(f"{root}/commits")


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the last overwrite and of all appends since, by the commits' times."""
    commits = spark.read.schema(COMMITS).json(f"{root}/commits").orderBy("at", "version").collect()
    since = max((k for k, c in enumerate(commits) if c["mode"] == "overwrite"), default=0)
    return spark.read.parquet(*[f"{root}/{c['version']}" for c in commits[since:]])
