"""Near copies: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

They are found by SimHash: fingerprints of the sets, in shards with a BK-tree each. Pairs within
the radius are then checked on the sets.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import quoted
from tallymark.llm import text_hashes
from tallymark.llm.common import encoded, in_parts, stored
from tallymark.llm.similar_sets import chosen_sets, linked
from tallymark.llm.simhash import set_fingerprint

SHINGLE_WORDS = 5
PERCENT = 80
# Fingerprints of sets of a similarity of 0.8 differ in 10 of 64 bits, and in over 28 for 1 of
# 100 million pairs of large sets, 1 of a million of the smallest (4 shingles of 5).
RADIUS = 28
BANDS = 24
BAND_HASHES = 4
_SHINGLES_AT_ONCE = 4096
_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, BANDS * BAND_HASHES, dtype=np.uint32) * 2 + 1


def content_of(text: str = "text") -> Column:
    """Return the hash that stands for a text; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def with_class(docs: DataFrame, copies: DataFrame, name: str) -> DataFrame:
    """Add the root of each text in the result of ``near_copies``, or else its own content.

    A column ``name`` of ``docs`` is replaced, all others are kept, whatever their names.
    """
    own = [one for one in docs.columns if one.lower() != name.lower()]
    taken = {one.lower() for one in docs.columns}
    content, root = (_free(one, taken) for one in ("_of_content", "_root"))
    joined = docs.withColumn(name, content_of())
    joined = joined.join(copies.toDF(content, root), F.col(name) == F.col(content), "left")
    found = F.coalesce(F.col(root), F.col(name)).alias(name)
    return joined.select(*(F.col(quoted(one)) for one in own), found)


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name += "_"
    return name


def shingle_hashes(text: bytes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Return the sorted 64-bit hashes of the runs of ``size`` words, A-Z in lower case.

    Words are runs of anything but ASCII white space; a text of fewer words is one shingle.
    """
    hashes = text_hashes.shingle_hashes(text, size)
    return hashes if len(hashes) else np.zeros(1, dtype=np.uint64)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """Return the least of a set's hashes under each factor."""
    low = hashes.astype(np.uint32)
    least = np.full(len(_FACTORS), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), _SHINGLES_AT_ONCE):
        some = np.multiply.outer(_FACTORS, low[at : at + _SHINGLES_AT_ONCE])
        np.minimum(least, some.min(axis=1), out=least)
    return least


def band_keys(hashes: np.ndarray) -> list[int]:
    """Return a key for each band of the MinHashes, as signed longs.

    Two sets of similarity s share a band's key with a chance of s to the power of
    ``BAND_HASHES``: at 0.8, all ``BANDS`` differ for 3 of a million pairs.
    """
    bands = min_hashes(hashes).reshape(BANDS, BAND_HASHES)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), at) for at, band in enumerate(bands)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def near_copies(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id") -> DataFrame:
    """Return ``content`` and ``root`` of all contents that are near copies of a lesser one.

    Contents are the hashes of ``content_of``. Each set of 5-word shingles has a SimHash
    fingerprint; texts that share a MinHash band are a shard. The BK-tree of a shard is searched
    for all pairs of fingerprints within ``RADIUS`` bits, and those pairs are linked whose sets
    of 64-bit hashes have a Jaccard similarity of at least ``percent``; see ``linked`` for the
    cost of large families. ``root`` is the least content that links reach, over any steps. At a
    similarity of 0.8 about 3 of a million pairs share no shard.

    Null and empty texts are one content; texts without words are near copies of each other.
    Whole texts are read, however long; sets go to the tasks that compare them only where they
    share a band with another. Copies count once: a task keeps one row for each content, and
    ``key`` names the row whose text is taken, so that copies do not meet in one task. Rows with
    a null key or a repeated one are like all others. Other columns of ``docs`` are not looked
    at, whatever their names. An empty table gives no rows.
    """

    def banded(batches):
        for batch in in_parts(batches):
            keys = [band_keys(shingle_hashes(text)) for text in encoded(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(keys, pa.list_(pa.int64()))],
                names=["content", "keys"],
            )

    texts = docs.select(
        F.col(quoted(key)).alias("row"),
        content_of().alias("content"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    keys = texts.select("content", "text").mapInArrow(banded, "content long, keys array<long>")
    keys = keys.dropDuplicates(["content"]).select(
        F.explode("keys").alias("key"), F.col("content").alias("node"), F.lit(True).alias("own")
    )
    buckets = stored(keys, "near-copy-bands")
    several = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    several = stored(several.where("low < high").select("key"), "near-copy-shared-bands")
    buckets = stored(buckets.join(several, "key", "left_semi"), "near-copy-buckets")
    shared = buckets.select(F.col("node").alias("content")).distinct()
    rows = texts.groupBy("content").agg(F.min("row").alias("row"))
    wanted = stored(rows.join(shared, "content"), "near-copy-rows")
    sets = chosen_sets(texts, wanted, shingle_hashes, set_fingerprint).select(
        "*", F.lit(None).cast("int").alias("needs"), F.lit(None).cast("binary").alias("prefix")
    )
    roots = linked(buckets, stored(sets, "near-copy-sets"), percent, RADIUS)
    return roots.toDF("content", "root")
