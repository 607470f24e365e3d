"""Reading and writing tables: SQL files, snapshots, samples of the change log."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that name a node; a backup leaves them out.
NODE_COLUMNS = ("site_id", "actor_id")


def sql_files(paths: list[str]) -> list[str]:
    """The texts of .sql files, from files and folders, in order of their names."""
    found: list[Path] = []
    for p in map(Path, paths):
        if p.is_dir():
            found.extend(sorted(x for x in p.iterdir() if x.suffix == ".sql"))
        elif p.suffix == ".sql":
            found.append(p)
        else:
            raise ValueError(f"not a .sql file: {p}")
    return [p.read_text() for p in found]


def backup(tables: dict[str, DataFrame], folder: str, strip_identity: bool = True) -> None:
    """Each table as Parquet below the folder, without the columns that name this node."""
    for name, df in tables.items():
        kept = df.drop(*NODE_COLUMNS) if strip_identity else df
        kept.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")


def restore(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def changes_scan(changes: DataFrame, site_id: int, db_version: int) -> DataFrame:
    """The changes of one version in order. The filters reach the scan."""
    return changes.where((F.col("site_id") == site_id) & (F.col("db_version") == db_version)).orderBy("seq")


def latest_versions(changes: DataFrame, n: int) -> DataFrame:
    """The latest n versions by time: (site_id, db_version, ts)."""
    versions = changes.groupBy("site_id", "db_version").agg(F.max("ts").alias("ts"))
    return versions.orderBy(F.desc("ts"), F.desc("site_id"), F.desc("db_version")).limit(n)
