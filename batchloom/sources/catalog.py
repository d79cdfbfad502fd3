"""Catalog reads: table scans by name and metadata look-ups."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(*parts: str) -> str:
    """A multi-part identifier with each part backtick-quoted."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def scan(spark: SparkSession, table: str) -> DataFrame:
    """Scan a table by its two- or three-part name; its location comes from the catalog."""
    return spark.table(table)


def probe(spark: SparkSession, table: str) -> DataFrame:
    """Resolve a table and its schema without reading a row."""
    return spark.table(table).limit(0)


@dataclass(frozen=True)
class ResolvedTable:
    name: str
    schema: T.StructType
    location: str


def table_metadata(spark: SparkSession, table: str) -> dict:
    described = spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t) AS JSON", args={"t": table})
    return json.loads(described.first()[0])


def table_schema(spark: SparkSession, table: str) -> T.StructType:
    """The table's columns with their full types, however wide or nested."""
    return spark.table(table).schema


def table_location(spark: SparkSession, table: str) -> str:
    """Storage location held in the catalog.

    It is read from the metadata field, so a column named ``location`` cannot be mistaken
    for it.
    """
    location = table_metadata(spark, table).get("location")
    if not location:
        raise RuntimeError(f"the catalog holds no location for {table}")
    return location


def resolve_tables(spark: SparkSession, tables: Iterable[str]) -> dict[str, ResolvedTable]:
    """Resolve every table before work begins; fails on the first that does not."""
    return {
        name: ResolvedTable(name, table_schema(spark, name), table_location(spark, name))
        for name in tables
    }


def list_tables(spark: SparkSession, database: str) -> DataFrame:
    """Tables of a database; any character may occur in its name."""
    return spark.sql(f"SHOW TABLES IN {quoted(database)}")


def database_exists(spark: SparkSession, database: str) -> bool:
    return spark.catalog.databaseExists(quoted(database))


def namespace(spark: SparkSession) -> DataFrame:
    """Current catalog and database."""
    return spark.range(1).select(
        F.current_catalog().alias("catalog"), F.current_database().alias("database")
    )


def use_namespace(
    spark: SparkSession, database: str | None = None, catalog: str | None = None
) -> None:
    """Set the session's current catalog and database."""
    if catalog is not None:
        spark.catalog.setCurrentCatalog(catalog)
    if database is not None:
        spark.catalog.setCurrentDatabase(database)


def drop_database(spark: SparkSession, database: str) -> None:
    """Forget a scratch database and its tables. Files of external tables stay in the shared
    folder, whose cleaning is the cluster's matter."""
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(database)} CASCADE")
