"""What the operators share: columns, words, the shared folder and tables written there."""

import re
import tempfile
from functools import reduce
from pathlib import Path
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallymark.functions import quoted

_FALLBACK = []
# What an Arrow batch holds at most where workers are to stay small: rows, and bytes.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
# Lets a worker give freed memory back to the system; else what its largest batch took stays.
_GIVE_BACK = {
    "MALLOC_TRIM_THRESHOLD_": str(4 << 20),
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_ARENA_MAX": "2",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def on_workers(spark: SparkSession) -> None:
    """Let the Python workers import this package, from wherever the driver loaded it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(":") if path]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])


def on_small_workers(spark: SparkSession) -> None:
    """As ``on_workers``, for long texts: small Arrow batches, and freed memory is given back.

    By default a batch holds 10,000 rows, often a whole partition of texts, both in the executor
    and in the worker. Lower settings of the session, and any of the environment, stay.
    """
    on_workers(spark)
    environment = spark.sparkContext.environment
    for name, value in _GIVE_BACK.items():
        environment.setdefault(name, value)
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        # A size with a larger unit than bytes is the session's own choice.
        now = spark.conf.get(name).lower().removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def shared_folder(spark: SparkSession) -> str:
    """Return the folder that all executors share, ``spark.checkpoint.dir``.

    Where the session names none, as in a test on one machine, a temporary folder stands in;
    on a cluster that would not be shared, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _FALLBACK:
            _FALLBACK.append(Path(tempfile.mkdtemp(prefix="tallymark-")).as_uri())
        folder = _FALLBACK[0]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Return a path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder and return it as read from there.

    This cuts the lineage, outlives lost executors, and gives the planner the true size, so
    that a join broadcasts it only under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def all_of(*conditions: Column) -> Column:
    """Return the conjunction of the conditions."""
    return reduce(lambda left, right: left & right, conditions)


def others(frame: DataFrame, added: tuple[str, ...]) -> list[Column]:
    """Return the columns of ``frame`` but for those whose names are added, in any case."""
    return [F.col(quoted(name)) for name in frame.columns if name.lower() not in added]


def plain_names(frame: DataFrame) -> list[str]:
    """Return names for the columns of ``frame`` that Python functions can be given.

    All but ``text`` are numbered, for those functions take no name with a dot or a backtick.
    """
    return [
        "text" if name.lower() == "text" else f"_{at}" for at, name in enumerate(frame.columns)
    ]


def encoded(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Return a text column as UTF-8, with nulls as empty texts."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [text or b"" for text in column.cast(kind).to_pylist()]


def in_parts(batches, rows: int = 1000):
    """Yield the batches in parts of up to ``rows`` rows, to bound what is made of one at once."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """Return 0, 1, ... within each run of the given lengths, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths)


def sorted_groups(batches, names: tuple[str, ...], most: int, most_bytes: int | None = None):
    """Yield tables of whole groups of equal ``names`` from batches sorted by these columns.

    A table holds about ``most`` rows, or about ``most_bytes`` bytes if these are fewer rows, or
    one group if that is larger.
    """
    held, rows, size = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < most and (most_bytes is None or size < most_bytes):
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = table.num_rows - 1
        same = np.ones(table.num_rows, dtype=bool)
        for name in names:
            values = table[name].to_numpy()
            same &= values == values[last]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def text_length(text: str = "text") -> Column:
    """Return the code points of a text as the documents table counts them."""
    return F.length(text).cast("long")
