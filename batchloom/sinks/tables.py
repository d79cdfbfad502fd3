"""Table sinks: create external tables and append batches to them.

Readers and writers name only the table; where its files lie is the catalog's matter. The
format is a parameter. Parquet needs no extra jar but has no commit log: one writer per
table at a time. A batch whose write died may leave part of its rows under its own batch id; in
a table partitioned by batch, ``replace_batch`` writes it anew in their place. A format with a
commit log (``delta``) leaves none where its jar is installed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.operators.aggregate import by_revenue
from batchloom.operators.checks import CheckFailed, SchemaMismatch, expect_schema
from batchloom.operators.enrich import current_batch, tag_batch
from batchloom.sources.catalog import quoted, table_metadata, table_schema

DEFAULT_FORMAT = "parquet"


def type_names(schema: T.StructType) -> dict[str, str]:
    return {field.name: field.dataType.simpleString() for field in schema.fields}


def partitions_last(schema: T.StructType, partitioned_by: Sequence[str]) -> T.StructType:
    """The column order of a partitioned table: catalogs list partition columns last."""
    rest = [field for field in schema.fields if field.name not in partitioned_by]
    return T.StructType([*rest, *(schema[name] for name in partitioned_by)])


def new_batch_id() -> str:
    return str(uuid.uuid4())


def ensure_database(spark: SparkSession, database: str, location: str) -> None:
    """Create a database with a location unless it exists."""
    spark.sql(
        f"CREATE DATABASE IF NOT EXISTS {quoted(database)} LOCATION :location",
        args={"location": location},
    )


def ensure_table(
    spark: SparkSession,
    table: str,
    schema: T.StructType,
    location: str,
    fmt: str = DEFAULT_FORMAT,
    partitioned_by: Sequence[str] = (),
    bloom_filters: Mapping[str, int] | None = None,
) -> None:
    """Create an external table unless it exists; an existing table is left as it is.

    ``bloom_filters`` names columns, with how many different values a row group may hold, for
    which Parquet files get a filter: an equality on such a column skips row groups that have
    the value within their range but not among their values. It is meant for ``batch_id`` in a
    flat table whose files hold rows of many batches.

    ``IF NOT EXISTS`` alone would hide a differing schema, so the table's columns are
    compared with ``schema`` afterwards. ``partitioned_by=["batch_id"]`` lets a reader of
    one batch open only that batch's files; leave it out when batches are many and small.
    """
    layout = f"PARTITIONED BY ({', '.join(map(quoted, partitioned_by))})" if partitioned_by else ""
    options = _bloom_options(schema, bloom_filters or {})
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS IDENTIFIER(:t) ({schema.toDDL()}) "
        f"USING {quoted(fmt)} {options} {layout} LOCATION :location",
        args={"t": table, "location": location},
    )
    actual, wanted = type_names(table_schema(spark, table)), type_names(schema)
    if actual != wanted:
        raise SchemaMismatch(f"{table} exists with columns {actual}, expected {wanted}")


def _bloom_options(schema: T.StructType, columns: Mapping[str, int]) -> str:
    settings = []
    for name, values in columns.items():
        if name not in schema.names or values <= 0:
            raise ValueError(f"no bloom filter for {values} values of {name}")
        settings += [("enabled", name, "true"), ("expected.ndv", name, str(values))]
    listed = (
        f"{_literal(f'parquet.bloom.filter.{key}#{name}')} {_literal(value)}"
        for key, name, value in settings
    )
    return f"OPTIONS ({', '.join(listed)})" if settings else ""


def _fitting(df: DataFrame, table: str) -> DataFrame:
    """The rows in the table's column order; names and types must equal the table's."""
    target = table_schema(df.sparkSession, table)
    expect_schema(df, type_names(target))
    extra = sorted(set(df.columns) - set(target.names))
    if extra:
        raise SchemaMismatch(f"{table} has no column {', '.join(extra)}")
    return df.select(*[F.col(quoted(name)) for name in target.names])


def append(df: DataFrame, table: str) -> None:
    """Append by column name; names and types must equal the table's.

    The check comes first because an implicit cast can lose data without an error.
    """
    rows = _fitting(df, table)
    metadata = table_metadata(df.sparkSession, table)
    if metadata.get("partition_columns"):
        rows.write.insertInto(table)
    else:
        rows.write.format(metadata["provider"]).mode("append").saveAsTable(table)


def append_batch(df: DataFrame, table: str, batch_id: str | None = None) -> str:
    """Tag rows with a batch id, append them and return the id.

    Without ``batch_id`` each call takes a fresh one. A given id must be new: a batch that
    the table already holds is refused before a row is written. ``replace_batch`` writes over
    what an append that died has left.
    """
    if batch_id is not None:
        expect_new_batch(df.sparkSession, table, batch_id)
    batch_id = batch_id or new_batch_id()
    append(tag_batch(df, batch_id), table)
    return batch_id


def replace_batch(df: DataFrame, table: str, batch_id: str) -> str:
    """Write a batch in place of whatever the table holds under its id.

    For an append that died half way: running it again under the same id leaves the batch once
    and whole. The table must be partitioned by ``batch_id`` alone; the statement names the one
    partition that it overwrites, so rows of other batches are not touched. A rerun that dies,
    too, can be run again.
    """
    if table_metadata(df.sparkSession, table).get("partition_columns") != ["batch_id"]:
        raise ValueError(f"{table} is not partitioned by batch_id; take a new batch id")
    rows = _fitting(tag_batch(df, batch_id), table).drop("batch_id")
    df.sparkSession.sql(
        f"INSERT OVERWRITE IDENTIFIER(:t) PARTITION (batch_id = {_literal(batch_id)}) "
        "SELECT * FROM {rows}",
        args={"t": table},
        rows=rows,
    )
    return batch_id


def expect_new_batch(spark: SparkSession, table: str, batch_id: str) -> None:
    """Raise if the table holds rows of the batch."""
    if not read_batch(spark, table, batch_id).isEmpty():
        raise CheckFailed(f"{table} already holds batch {batch_id}")


def insert_values(spark: SparkSession, table: str, rows: Sequence[Sequence[Any]]) -> None:
    """``INSERT INTO ... VALUES``: literals by position, stored by the SQL assignment rules.

    For a handful of rows. Values are bound as parameters, so a date, a timestamp, an infinity
    or a NaN arrives as it is; a decimal literal goes into a DOUBLE column. A datetime without a
    zone is a wall-clock time.
    """
    bound: dict[str, Any] = {}

    def marker(value: Any) -> str:
        """The expression that stands for a value; what it is made of is bound."""
        if isinstance(value, (list, tuple)):
            return f"array({', '.join(map(marker, value))})"
        if isinstance(value, dict):
            return f"map({', '.join(marker(x) for pair in value.items() for x in pair)})"
        name = f"v{len(bound)}"
        if not isinstance(value, date):
            bound[name] = value
            return f":{name}"
        # As text, since a datetime would go through this machine's time zone.
        bound[name] = value.isoformat()
        kind = "timestamp_ntz" if isinstance(value, datetime) else "date"
        if isinstance(value, datetime) and value.tzinfo is not None:
            kind = "timestamp"
        return f"CAST(:{name} AS {kind})"

    values = ", ".join(f"({', '.join(map(marker, row))})" for row in rows)
    spark.sql(f"INSERT INTO IDENTIFIER(:t) VALUES {values}", args={"t": table} | bound)


def _literal(text: str) -> str:
    """The SQL literal of a text, for places that take no parameter."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def insert_select(df: DataFrame, table: str) -> None:
    """``INSERT INTO ... SELECT``: columns are matched by position, types by the SQL rules."""
    df.sparkSession.sql(
        "INSERT INTO IDENTIFIER(:t) SELECT * FROM {rows}", args={"t": table}, rows=df
    )


def read_batch(spark: SparkSession, table: str, batch_id: str) -> DataFrame:
    return current_batch(spark.table(table), batch_id)


def write_summary(summary: DataFrame, table: str) -> None:
    append(summary, table)


def read_summary(spark: SparkSession, table: str, batch_id: str) -> DataFrame:
    """The saved summary of one batch, highest revenue first."""
    return by_revenue(read_batch(spark, table, batch_id), "category")
