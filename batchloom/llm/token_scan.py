"""Token counts by a separator scan over flat token files.

A flat file holds the token ids of many documents as little-endian integers of ``WIDTH`` bytes,
each document closed by the end-of-document id, and nothing else: no index, no lengths. To
count, files are cut into blocks at any whole id. Each block is searched for the end id as an
array; it hands in the lengths of the documents that lie inside, and what stands before its
first and after its last end. A prefix scan over the blocks of a file numbers the documents
and carries open lengths from block to block, so a document may span any number of blocks.

``write`` makes such files with Spark's text writer, whose line separator is the end id. Their
documents stand in the order of the rows. A task writes as many files as it needs for none to
hold more than ``FILE_BYTES`` and one further document, so neither a partition nor a document
decides what a task must hold of a file. ``order`` gives the ids of the rows in the same order.
The rows must therefore be read in a repeatable order, as a scan of files is. ``counted`` makes
sure of it: it has the tokens of each document found turned back into a number of bytes, and
compares that with the bytes of the row's text, row by row.

Edge cases: a null or empty text is a document of no tokens. An end id after the last document
is required of whole files; tokens after the last end are not a document and are reported by
``open_tokens``. Text that spells special tokens is ordinary text. Repeated rows and null ids count each, and
ties cannot occur. An empty table gives no file and no row. A very long text is encoded whole. Only ``doc_id`` and ``text`` are read, so other columns
never clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from batchloom.llm.common import staged
from batchloom.plans.staging import scratch_location
from batchloom.sources.catalog import quoted

#: Where the public tokenizers' files are.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary cuts text before merging; a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The first free id of the vocabulary ends a document.
END = 50_256
WIDTH = 2
BLOCK = 1 << 20
FILE_BYTES = 16 << 20
DIFFER = "the rows and the flat files differ at part %d, place %d"
BLOCKS = (
    "part int, file int, number int, first long, ends long, last long, first_bytes long, "
    "last_bytes long, inside array<struct<n_tokens:long,n_bytes:long>>"
)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_lengths(merges: dict[bytes, int]) -> np.ndarray:
    """How many bytes of text each id stands for; the end id for none."""
    lengths = np.zeros(1 << (8 * WIDTH), np.int64)
    lengths[list(merges.values())] = list(map(len, merges))
    lengths[END] = 0
    return lengths


def _encode(merges: dict[bytes, int], pattern: str, file_bytes: int) -> Callable:
    """What goes into each file: the ids of as many documents as it takes, ends between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        end = END.to_bytes(WIDTH, "little")
        held, size = [], 0
        for batch in batches:
            for text in batch.column("text"):
                ids = np.array(encoding.encode_ordinary(text.as_py() or ""), f"<u{WIDTH}").tobytes()
                held.append(ids)
                size += len(ids) + WIDTH
                if size >= file_bytes:
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([end.join(held)], pa.binary())})
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"ids": pa.array([end.join(held)], pa.binary())})

    return run


def write(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, file_bytes: int = FILE_BYTES
) -> None:
    """Write the texts of ``docs`` as flat token files below ``path``."""
    merges = ranks(vocabulary)
    flat = docs.select("text").mapInArrow(_encode(merges, SPLIT, file_bytes), "ids binary")
    end = END.to_bytes(WIDTH, "little").decode("latin-1")
    # The text writer passes bytes through as they are and puts the separator after each row.
    raw = flat.select(F.col("ids").cast("string").alias("value")).write
    # A row is a file.
    raw.option("lineSep", end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def order(docs: DataFrame) -> DataFrame:
    """``part, place, doc_id`` of each row: its partition and its place there, from 0; and
    ``size`` if the rows have it."""
    place = F.monotonically_increasing_id()
    return docs.select(
        F.shiftright(place, 33).cast("int").alias("part"),
        place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        *(F.col(quoted(c)) for c in docs.columns if c in ("doc_id", "size")),
    )


def _scan(lengths: np.ndarray) -> Callable:
    """Of each block: tokens before the first end, ends, tokens after the last, and each
    document inside; of all these the bytes as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in batch.column("block"):
                ids = np.frombuffer(block.as_buffer(), f"<u{WIDTH}")
                at = np.flatnonzero(ids == END)
                sums = np.concatenate([[0], np.cumsum(lengths[ids])])
                one, two = (at[0], at[-1] + 1) if len(at) else (len(ids), 0)
                inside = zip((np.diff(at) - 1).tolist(), np.diff(sums[at]).tolist())
                rows.append({
                    "first": int(one), "ends": len(at), "last": int(len(ids) - two) if len(at) else 0,
                    "first_bytes": int(sums[one]), "last_bytes": int(sums[-1] - sums[two]) if len(at) else 0,
                    "inside": [{"n_tokens": n, "n_bytes": m} for n, m in inside],
                })
            found = pa.RecordBatch.from_pylist(rows, _FOUND)
            keys = ["part", "file", "number"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keys), *found.columns], [*keys, *_FOUND.names]
            )

    return run


_DOCUMENT = pa.struct([("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_FOUND = pa.schema([
    *((name, pa.int64()) for name in ("first", "ends", "last", "first_bytes", "last_bytes")),
    ("inside", pa.list_(_DOCUMENT)),
])


def blocks(
    spark: SparkSession, path: str, block: int = BLOCK, lengths: np.ndarray | None = None
) -> DataFrame:
    """What the blocks of the flat files hold; ``block`` is in bytes, a multiple of the width.

    A file's name tells its part and, behind ``-c``, which of the part's files it is. ``lengths``
    are the bytes that each id stands for; without them documents have none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part = F.regexp_extract("path", r"/part-([0-9]+)[^/]*$", 1).cast("int")
    file = F.regexp_extract("path", r"-c([0-9]+)[^/]*$", 1)
    file = F.when(file == "", 0).otherwise(file.try_cast("int"))
    files = files.where("length > 0").select(part.alias("part"), file.alias("file"), "length", "content")
    starts = F.sequence(F.lit(0), ((F.col("length") - 1) / block).cast("int"))
    # The outer form: a plain one would cut the content twice, once for a filter before it.
    cut = F.transform(starts, lambda i: F.substring(F.col("content"), i * block + 1, F.lit(block)))
    pieces = files.select("part", "file", F.posexplode_outer(cut).alias("number", "block"))
    none = np.zeros(1 << (8 * WIDTH), np.int64)
    return staged(pieces.mapInArrow(_scan(none if lengths is None else lengths), BLOCKS))


def scan(found: DataFrame) -> DataFrame:
    """``part, place, n_tokens, n_bytes`` of each document, stitched from the ``blocks``."""
    file = ["part", "file"]
    line = Window.partitionBy(*file).orderBy("number")
    # Prefix scans: documents in files and blocks before this one, blocks with an end up to it.
    sizes = found.groupBy(*file).agg(F.sum("ends").alias("docs"))
    files = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*file, F.coalesce(F.sum("docs").over(files), F.lit(0)).alias("earlier"))
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    at = found.withColumn("ended", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))
    at = at.withColumn("run", F.sum((F.col("ends") > 0).cast("long")).over(line))
    # A run starts with a block's last tokens and goes on through blocks without an end.
    some = F.col("ends") > 0
    carried = at.groupBy(*file, (F.col("run") + 1).alias("run")).agg(
        F.sum(F.when(some, F.col("last")).otherwise(F.col("first"))).alias("carried"),
        F.sum(F.when(some, F.col("last_bytes")).otherwise(F.col("first_bytes"))).alias("carried_bytes"),
    )
    whole = at.where(some).join(carried, [*file, "run"], "left").join(sizes, file)
    head = F.struct(
        (F.col("first") + F.coalesce("carried", F.lit(0))).alias("n_tokens"),
        (F.col("first_bytes") + F.coalesce("carried_bytes", F.lit(0))).alias("n_bytes"),
    )
    documents = whole.select(
        "part", (F.col("earlier") + F.col("ended")).alias("place"),
        F.posexplode(F.concat(F.array(head), "inside")).alias("i", "x"),
    )
    return documents.select("part", (F.col("place") + F.col("i")).alias("place"), "x.n_tokens", "x.n_bytes")


def open_tokens(found: DataFrame) -> DataFrame:
    """``part, n_tokens``: tokens after the last end, of the files that have any."""
    file = ["part", "file"]
    last_end = found.where("ends > 0").groupBy(*file).agg(F.max("number").alias("at"))
    tail = found.join(last_end, file, "left").where("at is null or number >= at")
    size = F.when(F.col("number") == F.col("at"), F.col("last")).otherwise(F.col("first"))
    return tail.groupBy("part").agg(F.sum(size).alias("n_tokens")).where("n_tokens > 0")


def counted(docs: DataFrame, vocabulary: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of each row, counted in flat files written below ``path``.

    Fails if a document found there is not the row's by its number of bytes, or either is
    without the other.
    """
    spark = docs.sparkSession
    path = path or scratch_location(spark, "tokens")
    write(docs, path, vocabulary)
    lengths = scan(blocks(spark, path, lengths=byte_lengths(ranks(vocabulary))))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    rows = order(docs.select("doc_id", size)).withColumn("here", F.lit(True))
    paired = rows.join(lengths, ["part", "place"], "full")
    fits = F.col("here") & (F.col("size") == F.col("n_bytes"))
    wrong = F.raise_error(F.format_string(DIFFER, "part", "place"))
    counts = F.when(F.coalesce(fits, F.lit(False)), F.col("n_tokens")).otherwise(wrong.cast("long"))
    return paired.select("doc_id", counts.alias("n_tokens"))
