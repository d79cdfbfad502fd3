"""Table schemas. Every column is nullable; no table declares keys."""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SALES = _schema(
    batch_id=T.StringType(),
    product_id=T.LongType(),
    category=T.StringType(),
    quantity=T.IntegerType(),
    unit_price=T.DoubleType(),
)

EVENTS = _schema(
    batch_id=T.StringType(),
    event_id=T.LongType(),
    category=T.StringType(),
    quantity=T.IntegerType(),
    unit_price=T.DoubleType(),
)

SUMMARY = _schema(
    batch_id=T.StringType(),
    category=T.StringType(),
    event_count=T.LongType(),
    total_quantity=T.LongType(),
    revenue=T.DoubleType(),
)

STATUS = _schema(
    run_id=T.StringType(),
    poll_ts=T.TimestampNTZType(),
    worker=T.StringType(),
    phase=T.StringType(),
)

LOG = _schema(
    source=T.StringType(),
    ts=T.TimestampNTZType(),
    line=T.StringType(),
)

OBJECT_EVENT = _schema(
    object=T.StringType(),
    last_ts=T.TimestampNTZType(),
    type=T.StringType(),
    reason=T.StringType(),
    message=T.StringType(),
)
