"""N-gram Jaccard join by adaptive multi-match prefixes.

The shingles of all documents have one order, rare ones first. Two sets that overlap enough share
a shingle within short prefixes of both; within prefixes that are longer by l - 1, they share l.
Each document takes the length at which the lists of its prefix's shingles, and the candidates
left to check after so many matches, are estimated to cost least.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import encoded, in_parts, stored
from tallymark.llm.near_copies import content_of
from tallymark.llm.similar_sets import chosen_sets, linked
from tallymark.llm.text_hashes import shingle_hashes

SHINGLE_WORDS = 4
PERCENT = 85
MOST_MATCHES = 8
# What checking a candidate costs, in entries of a shingle's list.
CHECK_COST = 8.0
# One of so many shingles, a power of 2, is counted. All others come last in the order.
COUNTED_OF = 4


def probing_length(size, matches, percent: int = PERCENT):
    """Return the prefix that shares ``matches`` shingles with any similar set not larger."""
    return np.minimum(size, size - -(-percent * size // 100) + matches)


def indexed_length(size, matches, percent: int = PERCENT):
    """Return the prefix that shares ``matches`` shingles with any similar set not smaller."""
    return np.minimum(size, size - -(-2 * percent * size // (100 + percent)) + matches)


def split_set(hashes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Return the shingles that are counted, and as many others as its longest prefix may need."""
    counted = hashes < np.uint64((1 << 64) // COUNTED_OF) if COUNTED_OF > 1 else hashes == hashes
    first = hashes[counted]
    lacking = probing_length(len(hashes), MOST_MATCHES, percent) - len(first)
    return first, hashes[~counted][: max(0, int(lacking))]


def adapted_prefix(size: int, costs: np.ndarray, percent: int = PERCENT) -> int:
    """Return the number of matches to require, given the lengths of the shingles' lists in order.

    The estimate for l matches is the sum of the lists of the longer prefix, each entry of which
    is read, plus an l-th of it in candidates, each of which is checked.
    """
    matches = np.arange(1, min(MOST_MATCHES, -(-percent * size // 100)) + 1)
    read = np.append(0, np.cumsum(costs))[probing_length(size, matches, percent)]
    return int(matches[np.argmin(read + CHECK_COST * read / matches)])


def _prefixes(framed: DataFrame, percent: int) -> DataFrame:
    """Return ``node``, ``needs``, ``n_own`` and ``keys`` of the documents with shared shingles.

    ``keys`` are the shingles of the prefix that other documents may have, in order; the first
    ``n_own`` of them lie in the shorter prefix for sets that are not smaller.
    """

    def adapted(batches):
        for batch in in_parts(batches):
            rows = []
            columns = ("content", "size", "counted", "others", "shared", "n")
            for node, size, counted, others, shared, n in zip(
                *(batch.column(name).to_pylist() for name in columns), strict=True
            ):
                counted = np.array(counted, dtype=np.int64).view(np.uint64)
                lists = np.ones(len(counted), dtype=np.int64)
                shared = np.array(shared or [], dtype=np.int64).view(np.uint64)
                lists[np.searchsorted(counted, shared)] = n or []
                # Rare ones first, by powers of 2, then by hash: the same order for all.
                order = np.argsort(np.frexp(lists)[1], kind="stable")
                others = np.array(others, dtype=np.int64).view(np.uint64)
                ordered = np.concatenate([counted[order], others])
                lists = np.concatenate([lists[order], np.ones(len(others), dtype=np.int64)])
                needs = adapted_prefix(size, lists - 1, percent)
                length = int(probing_length(size, needs, percent))
                common = np.ones(length, dtype=bool)
                common[: len(counted)] = lists[: min(length, len(counted))] > 1
                places = np.flatnonzero(common)
                if len(places):
                    own = int(np.searchsorted(places, indexed_length(size, needs, percent)))
                    rows.append((node, needs, own, ordered[places].view(np.int64)))
            columns = zip(*rows, strict=True) if rows else ([] for _ in range(4))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)],
                names=["node", "needs", "n_own", "keys"],
            )

    return framed.mapInArrow(adapted, "node long, needs int, n_own int, keys array<long>")


def _frames(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Return ``content``, the ``size`` of its set, and its ``counted`` and ``others``."""

    def framed(batches):
        for batch in in_parts(batches):
            sizes, parts = [], ([], [])
            for text in encoded(batch, "text"):
                hashes = shingle_hashes(text, size)
                sizes.append(len(hashes))
                for part, chosen in zip(parts, split_set(hashes, percent), strict=True):
                    part.append(chosen.view(np.int64))
            lists = [pa.array(part, pa.list_(pa.int64())) for part in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), pa.array(sizes, pa.int32()), *lists],
                names=["content", "size", "counted", "others"],
            )

    kinds = "content long, size int, counted array<long>, others array<long>"
    return texts.select("content", "text").mapInArrow(framed, kinds)


def jaccard_join(
    docs: DataFrame, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """Return ``doc_id``, ``content``, ``n_shingles`` and ``component_id`` for every row of ``docs``.

    Two documents link when their sets of shingles have a Jaccard similarity of at least
    ``percent``; ``component_id`` is the least ``doc_id`` that links reach, over any steps. Sets
    are compared by 64-bit hashes of the shingles, texts told apart by a 64-bit hash. No link
    between components is lost, and links inside one are not looked for.

    One of ``COUNTED_OF`` shingles is counted over all texts, and the order of the shingles puts
    rare ones of these first. A document whose prefix holds only shingles of its own has no
    partner and goes no further. All others send their prefix's shingles as keys of buckets.

    Null and empty texts, and those without words, have no shingles and link with nothing, copies
    included. Whole texts are read, however long. Repeated rows are returned as often, and linked.
    A row with a null ``doc_id`` is linked too; its component is the least id that is not null,
    or null if there is none. Other columns are not looked at. An empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("row"),
        content_of().alias("content"),
        F.col("text").cast("string").alias("text"),
    )
    named = stored(texts.select(F.col("row").alias("doc_id"), "content"), "join-contents")
    least = named.groupBy("content").agg(F.min("doc_id").alias("least_id"))
    least = stored(least, "join-least-ids")
    frames = _frames(texts, shingle_words, percent).where("size > 0")
    frames = stored(frames.dropDuplicates(["content"]), "shingle-frames")
    each = frames.select("content", F.explode("counted").alias("shingle"))
    lists = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    lists = stored(lists, "shared-shingles")
    known = each.join(lists, "shingle").groupBy("content")
    known = known.agg(F.collect_list(F.struct("shingle", "n")).alias("known"))
    known = known.select(
        "content", F.col("known.shingle").alias("shared"), F.col("known.n").alias("n")
    )
    prefixes = stored(_prefixes(frames.join(known, "content", "left"), percent), "prefixes")
    keys = prefixes.select("node", "n_own", F.posexplode("keys").alias("at", "key"))
    buckets = stored(
        keys.select("key", "node", (F.col("at") < F.col("n_own")).alias("own")), "prefix-buckets"
    )
    wanted = prefixes.select(F.col("node").alias("content")).join(least, "content")
    wanted = stored(wanted.withColumnRenamed("least_id", "row"), "wanted-texts")
    sets = chosen_sets(texts, wanted, lambda text: shingle_hashes(text, shingle_words))
    sets = sets.join(prefixes.select("node", "needs", F.col("keys").alias("prefix")), "node")
    roots = linked(buckets, stored(_with_bytes(sets), "shingle-sets"), percent)
    nodes = frames.select("content", "size").join(least, "content")
    nodes = nodes.join(roots, F.col("content") == F.col("node"), "left")
    nodes = nodes.select("content", "size", "least_id", F.coalesce("root", "content").alias("root"))
    nodes = stored(nodes, "join-nodes")
    ids = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = nodes.join(stored(ids, "join-components"), "root")
    classes = stored(classes.select("content", "size", "component_id"), "join-classes")
    joined = named.join(classes, "content", "left")
    return joined.select(
        "doc_id",
        "content",
        F.coalesce("size", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias(
            "component_id"
        ),
    )


def _with_bytes(sets: DataFrame) -> DataFrame:
    """Turn the ``prefix`` of each set into bytes, as ``hashes`` are."""

    def packed(batches):
        for batch in in_parts(batches):
            lists = [np.array(one, np.int64).tobytes() for one in batch.column("prefix").to_pylist()]
            at = batch.schema.get_field_index("prefix")
            yield batch.set_column(at, "prefix", pa.array(lists, pa.binary()))

    kinds = "node long, size int, hashes binary, needs int, prefix binary"
    return sets.select("node", "size", "hashes", "needs", "prefix").mapInArrow(packed, kinds)
