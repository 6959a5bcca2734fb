"""Token ids as length-delimited binary records, with a separate index for shuffled reads.

A data file is a sequence of frames, all numbers little-endian:

    length    unsigned 64 bits, of the payload
    check     unsigned 32 bits, masked checksum of the eight length bytes
    payload   doc_id (signed 64 bits), 1 if there is a doc_id (8 bits),
              bytes per id (8 bits, 2 or 4), the ids
    check     unsigned 32 bits, masked checksum of the payload

The index beside it holds the place of each frame, and of the end, as unsigned 64-bit numbers.
A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so that a checksum
of data that holds checksums stays sound. Files are numbered in ascending order of doc_id.
"""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallymark.llm.common import stored
from tallymark.llm.tokens import encoder

_MASK = 0xA282EAD8
_FRAME = struct.Struct("<QI")
_HEAD = struct.Struct("<qBB")
_CHECK = struct.Struct("<I")
# The bytes of a record besides its ids.
_FIXED_BYTES = _FRAME.size + _HEAD.size + _CHECK.size
_TEXTS_AT_ONCE = 256

MANIFEST_SCHEMA = "file int, path string, n_records long, n_tokens long, n_bytes long"
RECORD_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"
_RECORDS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def masked(data: bytes) -> int:
    """Return the masked checksum of ``data``."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """Return the record of one document; ``ids`` are unsigned 32-bit numbers."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _HEAD.pack(doc_id or 0, doc_id is not None, width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, _CHECK.pack(masked(length)), payload, _CHECK.pack(masked(payload)))
    )


def unframe(data: bytes) -> tuple[int | None, bytes]:
    """Return the doc_id and the unsigned 32-bit ids of a record, or fail on a wrong checksum."""
    length, check = _FRAME.unpack_from(data)
    payload = data[_FRAME.size : _FRAME.size + length]
    (payload_check,) = _CHECK.unpack_from(data, _FRAME.size + length)
    if check != masked(data[:8]) or payload_check != masked(payload):
        raise ValueError("a record's checksum is wrong")
    doc_id, has_id, width = _HEAD.unpack_from(payload)
    ids = payload[_HEAD.size :]
    if width == 2:
        ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
    return doc_id if has_id else None, ids


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> DataFrame:
    """Encode ``doc_id`` and ``text`` of ``docs`` to record files in the folder ``path``.

    Returns the manifest, one row per file, which is itself stored. The folder is a URI that
    ``pyarrow.fs`` opens from every executor. Each task writes under a name of its own attempt
    and then moves the files to their final names, so that a task that is run again, or twice
    at once, leaves whole files with the same content.

    Rows with the same ``doc_id`` may go to different files, in an order fixed by their texts,
    so that no one id has to fit in a task. A null ``doc_id`` comes first; a null or empty text
    is the end id alone. An empty table gives an empty manifest.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def written(batches):
        task = TaskContext.get()
        coder = encoder(tokenizer_path)
        width = 2 if max(end_id, coder.tokenizer.get_vocab_size() - 1) < 1 << 16 else 4
        store, folder = fs.FileSystem.from_uri(path)
        final = f"{folder}/part-{task.partitionId():06d}"
        own = f"{folder}/.attempt-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=True)
        offsets, tokens, at = [], 0, 0
        with store.open_output_stream(f"{own}.rec") as out:
            for batch in batches:
                for first in range(0, batch.num_rows, _TEXTS_AT_ONCE):
                    rows = batch.slice(first, _TEXTS_AT_ONCE).to_pydict()
                    done = coder.encode([text or "" for text in rows["text"]])
                    for doc_id, ids in zip(rows["doc_id"], done, strict=True):
                        record = frame(doc_id, ids + end, width)
                        out.write(record)
                        offsets.append(at)
                        at += len(record)
                        tokens += len(ids) // 4 + 1
        with store.open_output_stream(f"{own}.idx") as out:
            out.write(np.array([*offsets, at], dtype="<u8").tobytes())
        for kind in ("rec", "idx"):
            if offsets:
                store.move(f"{own}.{kind}", f"{final}.{kind}")
            else:
                store.delete_file(f"{own}.{kind}")
        if offsets:
            row = [task.partitionId(), final.rpartition("/")[2], len(offsets), tokens, at]
            names = ["file", "path", "n_records", "n_tokens", "n_bytes"]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    chosen = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    ties = F.xxhash64("text")
    ordered = chosen.repartitionByRange(F.col("doc_id").asc_nulls_first(), ties)
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), ties, "text")
    return stored(ordered.mapInArrow(written, MANIFEST_SCHEMA), "records-manifest")


def read_records(manifest: DataFrame, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """Return the records of the files of a manifest, checked, one row each.

    ``start`` is the number of ids in all records before this one. With ``shuffle_seed`` the
    records of each file come in a random order, by seeks through the index.
    """

    def read(batches):
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                yield from of_file(store, f"{folder}/{row['path']}", row)

    def of_file(store, name, row):
        with store.open_input_file(f"{name}.idx") as index:
            places = np.frombuffer(index.read(), "<u8").astype(np.int64)
        with store.open_input_file(f"{name}.rec") as data:
            sizes = np.diff(places)
            narrow = row["n_records"] * _FIXED_BYTES + row["n_tokens"] * 2
            width = 2 if row["n_bytes"] == narrow else 4
            counts = (sizes - _FIXED_BYTES) // width
            starts = row["before"] + np.cumsum(counts) - counts
            order = list(range(len(sizes)))
            if shuffle_seed is not None:
                random.Random(f"{shuffle_seed}:{row['file']}").shuffle(order)
            for first in range(0, len(order), _TEXTS_AT_ONCE):
                part, ids, doc_ids = order[first : first + _TEXTS_AT_ONCE], [], []
                for at in part:
                    data.seek(int(places[at]))
                    doc_id, found = unframe(data.read(int(sizes[at])))
                    doc_ids.append(doc_id)
                    ids.append(found)
                columns = [doc_ids, starts[part], counts[part], ids]
                columns = [
                    pa.array(c, kind.type) for c, kind in zip(columns, _RECORDS, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=_RECORDS)

    # One row per file, so the running total over files is small.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    # A given number of partitions stays as it is; else the small table would become one.
    spread = files.repartitionByRange(max(1, manifest.count()), "file")
    return spread.mapInArrow(read, RECORD_SCHEMA)
