"""SimHash near-duplicates: fingerprints of word shingles, joined by sharded BK-trees."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.bk_tree import build, least_labels, links
from tallymark.llm.common import encoded, sorted_groups, stored
from tallymark.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
HASH_SEED = 42
BITS = 64
SHARD_PRINTS = 512
SLICE_PRINTS = 50_000
_SHINGLES_AT_ONCE = 65_536
_ROWS_AT_ONCE = 200_000
_PAIRS_AT_ONCE = 2_000_000


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Return the SimHash of UTF-8 text, an unsigned 64-bit number.

    A-Z are lower-cased; words are runs of anything but ASCII white space; each shingle of
    consecutive words counts as often as it occurs; a text of fewer words is one shingle. A bit
    is set if it is set in over half the shingles' XXH64. A text without words has 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(word) + 1 for word in words])
    begins = [0, *ends[:-shingle_words].tolist()]
    ends = (ends[min(shingle_words, len(words)) - 1 :] - 1).tolist()

    def hashed():
        for at in range(0, len(ends), _SHINGLES_AT_ONCE):
            some = slice(at, at + _SHINGLES_AT_ONCE)
            pairs = zip(begins[some], ends[some], strict=True)
            yield np.array([digest(line[a:b], HASH_SEED) for a, b in pairs], dtype="<u8")

    return majority(hashed(), len(ends))


def majority(parts, n_hashes: int) -> int:
    """Return the number whose bits are set in over half of the hashes, which come in parts."""
    counts = np.zeros(BITS, dtype=np.int64)
    for hashes in parts:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > n_hashes, bitorder="little")
    return int(ones.view("<u8")[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """Return the SimHash of a set of 64-bit hashes, each of which counts once."""
    cuts = range(0, len(hashes), _SHINGLES_AT_ONCE)
    return majority((hashes[at : at + _SHINGLES_AT_ONCE] for at in cuts), len(hashes))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Return ``doc_id``, ``content`` and ``print`` for every row.

    ``content`` is a hash of the text, and ``print`` the fingerprint as a signed long. Null and
    empty texts have the fingerprint 0.
    """

    def printed(batches):
        for batch in batches:
            prints = [fingerprint(text, shingle_words) for text in encoded(batch, "text")]
            column = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), column],
                names=["doc_id", "content", "print"],
            )

    chosen = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id",
        "CAST(text AS STRING) AS text",
        "xxhash64(text) AS content",
    )
    return chosen.mapInArrow(printed, "doc_id long, content long, print long")


def shard_masks(n_prints: int, radius: int) -> list[int]:
    """Return bit masks such that prints within the radius agree under at least one of them.

    Of ``radius + agree`` blocks of bits, ``radius`` differing bits leave ``agree`` untouched.
    More blocks that must agree give more masks of more bits, so smaller shards; as many are
    taken as keep an even shard at ``SHARD_PRINTS``. Any choice finds the same links.
    """
    for agree in range(1, BITS - radius + 1):
        blocks = np.array_split(np.arange(BITS), radius + agree)
        masks = [
            sum(1 << int(bit) for block in chosen for bit in block)
            for chosen in combinations(blocks, agree)
        ]
        if n_prints >> min(mask.bit_count() for mask in masks) < SHARD_PRINTS or agree == 4:
            return masks


def near_links(prints: DataFrame, radius: int = RADIUS, slice_prints: int = SLICE_PRINTS):
    """Return edges that join all distinct ``print`` values within ``radius`` bits.

    Prints meet in the shards of ``shard_masks``; each shard is one BK-tree. A shard of n prints,
    more than ``slice_prints``, is cut into k = ceil(n / ``slice_prints``) slices with a tree each;
    every two slices meet in one task, which searches the tree of one for the prints of the
    other. So no task holds more than two slices, and each print of such a shard is sent k
    times. A task returns a spanning forest of the links it found, not the pairs.
    """
    masks = [int(np.uint64(mask).astype(np.int64)) for mask in shard_masks(prints.count(), radius)]
    shards = F.explode(
        F.array(
            *(
                F.struct(F.lit(at).alias("mask"), F.col("print").bitwiseAND(mask).alias("part"))
                for at, mask in enumerate(masks)
            )
        )
    )
    placed = prints.select("print", shards.alias("shard")).select("shard.*", "print")
    large = placed.groupBy("mask", "part").count().where(F.col("count") > slice_prints)
    large = stored(
        large.select("mask", "part", F.ceil(F.col("count") / slice_prints).alias("slices")),
        "large-shards",
    )
    slices = F.coalesce(F.col("slices"), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("print"), F.col("slices")).cast("int")
    placed = (
        placed.join(large, ["mask", "part"], "left")
        .withColumn("slices", slices)
        .withColumn("slice", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .withColumns({"low": F.least("slice", "with"), "high": F.greatest("slice", "with")})
        .select("mask", "part", "low", "high", "slice", "print")
    )
    names = ("mask", "part", "low", "high")

    def linked(batches):
        for table in sorted_groups(batches, names, _ROWS_AT_ONCE):
            columns = [table[name].to_numpy() for name in names]
            new = np.zeros(table.num_rows, dtype=bool)
            for values in columns:
                new[1:] |= values[1:] != values[:-1]
            group = np.cumsum(new)
            signed = table["print"].to_numpy()
            low, high, own = (table[name].to_numpy() for name in ("low", "high", "slice"))
            forest = build(group, signed.view(np.uint64), own == low)
            queries = np.flatnonzero((own == high) & (forest.root >= 0))
            # As many queries at once as keep the pairs of query and node in bounds.
            cost = np.cumsum(np.bincount(group)[group[queries]]) // _PAIRS_AT_ONCE
            left, right = [], []
            for block in np.split(queries, np.flatnonzero(np.diff(cost)) + 1):
                if len(block):
                    found = links(forest, block, radius)
                    left.append(found[0])
                    right.append(found[1])
            if not left:
                continue
            values, node = np.unique(signed, return_inverse=True)
            left, right = node[np.concatenate(left)], node[np.concatenate(right)]
            label = least_labels(len(values), left, right)
            joined = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[joined]), pa.array(values[label[joined]])], names=["a", "b"]
            )

    spread = placed.repartition(*names).sortWithinPartitions(*names, "print")
    return spread.mapInArrow(linked, "a long, b long")


def near_duplicates(
    docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """Return ``doc_id``, ``content``, ``print`` and ``component_id`` for every row of ``docs``.

    ``content`` is the hash of the text, to find the row again where a ``doc_id`` repeats. Rows
    whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    least ``doc_id`` that links reach, also over several steps. Copies share a fingerprint and
    are one node of the graph, however many they are. No link between fingerprints is lost.

    Texts without words, null ones too, have the fingerprint 0 and are linked like any others.
    A row with a null ``doc_id`` is linked too; its group's id is the least that is not null,
    or null if there is none. Repeated rows are returned as often. An empty table gives no rows.
    """
    docs_prints = stored(fingerprints(docs, shingle_words), "fingerprints")
    prints = stored(
        docs_prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "distinct-prints"
    )
    roots = components(near_links(prints, radius))
    nodes = prints.join(roots, prints["print"] == roots["node"], "left")
    nodes = nodes.select("print", "least_id", F.coalesce("root", "print").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    least = stored(least, "component-ids")
    classes = stored(nodes.join(least, "root").select("print", "component_id"), "print-classes")
    joined = docs_prints.join(classes, "print")
    return joined.select("doc_id", "content", "print", "component_id")
