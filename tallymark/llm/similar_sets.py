"""Links sets of hashes by their Jaccard similarity, given the buckets in which similar sets meet."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.bk_tree import build, heads, links
from tallymark.llm.common import encoded, in_parts, runs_of, sorted_groups, stored
from tallymark.llm.components import components

# A task compares two blocks of about so many bytes of hashes at once.
BLOCK_BYTES = 8_000_000
# What all tasks get to pass over texts that are not wanted: so many bits, whatever the input.
FILTER_BITS = 1 << 24
# What a task holds besides a group: rows and bytes of smaller groups, hashes and pairs of prints.
_ROWS_AT_ONCE = 2_000
_BYTES_AT_ONCE = 8_000_000
_HASHES_AT_ONCE = 250_000
_PAIRS_AT_ONCE = 250_000


def similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Return whether two sorted sets have at least this Jaccard similarity, in percent."""
    if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return (100 + percent) * both >= percent * (len(left) + len(right))


class Overlaps:
    """Counts what sets have in common; hashes of one set only are left out first."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        every.sort()
        again = every[1:][every[1:] == every[:-1]]
        shared = again[heads(again)]
        del every, again
        # Set by set, for the places of all hashes at once take several times the hashes.
        codes = [np.empty(0, np.int32)]
        for one in sets:
            place = np.searchsorted(shared, one)
            found = np.searchsorted(shared, one, side="right") > place
            codes.append(place[found].astype(np.int32))
        self.size = np.array([len(one) for one in codes[1:]], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.codes = np.concatenate(codes)
        self.marked = np.zeros(len(shared), dtype=bool)

    def of(self, at: int, others: np.ndarray) -> np.ndarray:
        """Return how many hashes the set ``at`` shares with each of the others."""
        own = self.codes[self.begin[at] : self.begin[at] + self.size[at]]
        self.marked[own] = True
        out = np.zeros(len(others), dtype=np.int64)
        parts = np.cumsum(self.size[others]) // _HASHES_AT_ONCE
        for some in np.split(np.arange(len(others)), np.flatnonzero(np.diff(parts)) + 1):
            sizes = self.size[others[some]]
            places = np.repeat(self.begin[others[some]], sizes) + runs_of(sizes)
            found = np.append(0, np.cumsum(self.marked[self.codes[places]]))
            ends = np.cumsum(sizes)
            out[some] = found[ends] - found[ends - sizes]
        self.marked[own] = False
        return out


def near_prints(prints: np.ndarray, radius: int):
    """Yield for each fingerprint which of all lie within the radius, found in one BK-tree."""
    distinct, at = np.unique(prints, return_inverse=True)
    forest = build(np.zeros(len(distinct), dtype=np.int64), distinct)
    step = max(1, _PAIRS_AT_ONCE // len(distinct))
    for begin in range(0, len(prints), step):
        queries, row = np.unique(at[begin : begin + step], return_inverse=True)
        left, right = links(forest, queries, radius, every=True)
        near = np.zeros((len(queries), len(distinct)), dtype=bool)
        near[np.searchsorted(queries, left), right] = True
        near[np.arange(len(queries)), queries] = True
        for one in row:
            yield near[one][at]


def block_links(
    sets, root, percent: int, block=None, prefixes=None, needs=None, prints=None, radius=None
):
    """Return pairs of places that join all similar sets among ``sets``, given their ``root``.

    Sets of one root are joined already. If ``block`` is given, only sets of different blocks are
    compared. With ``prefixes``, two sets are compared only if these share at least the lesser
    of the two ``needs``; with ``prints``, only if a search of their BK-tree finds these within
    the ``radius``. Each set is compared with all that are not joined with it by then.
    """
    sizes = np.array([len(one) for one in sets], dtype=np.int64)
    label = np.unique(root, return_inverse=True)[1]
    whole = Overlaps(sets)
    ahead = None if prefixes is None else Overlaps(prefixes)
    within = None if prints is None or not len(sets) else near_prints(prints, radius)
    pairs = []
    for at in range(len(sets) - 1):
        later = slice(at + 1, None)
        fits = label[later] != label[at]
        if block is not None:
            fits &= block[later] != block[at]
        if within is not None:
            fits &= next(within)[later]
        least, most = (f(sizes[later], sizes[at]) for f in (np.minimum, np.maximum))
        fits &= 100 * least >= percent * most
        others = np.flatnonzero(fits) + at + 1
        if ahead is not None and len(others):
            others = others[ahead.of(at, others) >= np.minimum(needs[others], needs[at])]
        if not len(others):
            continue
        both = whole.of(at, others)
        near = (100 + percent) * both >= percent * (sizes[others] + sizes[at])
        for other in others[near].tolist():
            if label[other] != label[at]:
                pairs.append((at, other))
                label[label == label[other]] = label[at]
    return pairs


def _from_bytes(column) -> list[np.ndarray]:
    return [np.frombuffer(one, dtype=np.uint64) for one in column.to_pylist()]


def _filter_words(wanted: DataFrame) -> np.ndarray:
    """Return a bit for each remainder of the wanted contents, in words of 32 bits."""
    bit = F.pmod("content", F.lit(FILTER_BITS)).cast("int")
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return out


def _marked(contents: np.ndarray, words: np.ndarray) -> np.ndarray:
    bit = np.mod(contents, 32 * len(words))
    return (words[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 > 0


def maybe_in(wanted: DataFrame, content: str = "content") -> Column:
    """Return whether a content may be one of the wanted: true for all that are, and some others.

    The filter of ``FILTER_BITS`` bits goes to all tasks; only the column goes to Python.
    """
    words = wanted.sparkSession.sparkContext.broadcast(_filter_words(wanted))

    # Not a pandas UDF: a worker that never imports pandas takes 26 MB less.
    @F.arrow_udf("boolean")
    def marked(contents: pa.Array) -> pa.Array:
        return pa.array(_marked(contents.to_numpy(zero_copy_only=False), words.value))

    return marked(content)


def chosen_sets(texts: DataFrame, wanted: DataFrame, hashed, printed=None) -> DataFrame:
    """Return ``node``, ``size`` and ``hashes``, what ``hashed`` gives for each wanted text.

    ``print`` is what ``printed`` gives for the hashes, an unsigned number, or else null.
    ``texts`` has ``row``, ``content`` and ``text``; ``wanted``, which is stored, the ``content``
    and ``row`` of one row for each text. Texts stay where they are. Most that are not wanted are
    passed over by a filter of ``FILTER_BITS`` bits, which goes to all tasks; the sets of the
    others are joined with the wanted rows, so that nothing depends on how full the filter is.
    Rows move by content and row, so that copies do not meet in one task.
    """
    words = texts.sparkSession.sparkContext.broadcast(_filter_words(wanted))

    def emitted(batches):
        for batch in in_parts(batches):
            kept = batch.filter(pa.array(_marked(batch.column("content").to_numpy(), words.value)))
            sets = [hashed(text) for text in encoded(kept, "text")]
            prints = pa.nulls(len(sets), pa.int64())
            if printed is not None:
                prints = pa.array(np.array([*map(printed, sets)], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    kept.column("row"),
                    kept.column("content"),
                    pa.array([len(one) for one in sets], pa.int32()),
                    pa.array([one.tobytes() for one in sets], pa.binary()),
                    prints,
                ],
                names=["row", "node", "size", "hashes", "print"],
            )

    kind = texts.schema["row"].dataType.simpleString()
    sets = texts.select("row", "content", "text").mapInArrow(
        emitted, f"row {kind}, node long, size int, hashes binary, print long"
    )
    wanted = wanted.select(F.col("content").alias("of_content"), F.col("row").alias("of_row"))
    same = (F.col("node") == F.col("of_content")) & F.col("row").eqNullSafe(F.col("of_row"))
    sets = sets.join(wanted, same, "left_semi").dropDuplicates(["node", "row"])
    return sets.select("node", "size", "hashes", "print")


def _within(pairs: DataFrame, sets: DataFrame, percent: int, radius: int | None) -> DataFrame:
    """Return the pairs ``a``, ``b`` whose fingerprints and sizes allow a link.

    A pivot is the root of the tree of its bucket: these are the distances from the root.
    """
    if radius is None:
        return pairs
    for name in ("a", "b"):
        side = sets.select("node", "size", "print").toDF(name, f"size_{name}", f"print_{name}")
        pairs = pairs.join(side, name)
    sizes = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    near = F.bit_count(F.col("print_a").bitwiseXOR(F.col("print_b"))) <= radius
    return pairs.where(near & (100 * sizes[0] >= percent * sizes[1])).select("a", "b")


def linked(
    buckets: DataFrame, sets: DataFrame, percent: int, radius: int | None = None
) -> DataFrame:
    """Return ``node`` and ``root`` of all nodes that links join with a lesser one.

    ``buckets`` has ``key``, ``node`` and ``own``, and is stored; ``sets`` has the ``hashes`` of
    each node that shares a bucket, as bytes of sorted 64-bit numbers, their number ``size``,
    and a ``prefix`` and what it ``needs``, or nulls. Linked are two nodes of one bucket, one of
    them its ``own``, whose sets have a Jaccard similarity of at least ``percent``, and whose
    prefixes share at least the lesser of their needs. ``root`` is the least node of all that
    links reach, over any steps; links within what is joined already are not looked for.
    With a ``radius``, ``sets`` has a ``print`` too, and linked are only nodes whose fingerprints
    differ in at most so many bits.

    The nodes of each bucket are first compared with its least one, the pivot, so that a group
    of near copies costs one comparison for each. The nodes of buckets that then hold several
    components are gathered by pivot, once each, and compared in tasks. What a task holds is
    bounded: a group of b bytes is cut into k = ceil(b / ``BLOCK_BYTES``) blocks, and each of
    its nodes is sent k times, to be compared with each block.
    """

    def checked(batches):
        for batch in in_parts(batches):
            both = zip(*(_from_bytes(batch.column(name)) for name in ("left", "right")), strict=True)
            near = pa.array([similar(a, b, percent) for a, b in both], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    def compared(batches):
        names = ("pivot", "low", "high")
        for table in sorted_groups(batches, names, _ROWS_AT_ONCE, _BYTES_AT_ONCE):
            pivot, low, high, block, root = (
                table[name].to_numpy() for name in (*names, "block", "root")
            )
            begins = np.flatnonzero(heads(pivot) | heads(low) | heads(high)).tolist()
            left, right = [], []
            for begin, end in zip(begins, [*begins[1:], len(pivot)], strict=True):
                some = table.slice(begin, end - begin)
                sets = _from_bytes(some["hashes"])
                prefixes = needs = None
                if some["prefix"].null_count == 0:
                    prefixes, needs = _from_bytes(some["prefix"]), some["needs"].to_numpy()
                prints = some["print"].to_numpy().view(np.uint64) if radius is not None else None
                across = block[begin:end] if low[begin] != high[begin] else None
                own = root[begin:end]
                for a, b in block_links(
                    sets, own, percent, across, prefixes, needs, prints, radius
                ):
                    left.append(begin + a)
                    right.append(begin + b)
            # Roots are joined, for each node is joined with its own.
            yield pa.RecordBatch.from_arrays(
                [pa.array(root[left]), pa.array(root[right])], names=["a", "b"]
            )

    # What a join meets is stored first, so that Spark can split a key that very many rows share.
    filled = buckets.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot"), F.max("own").alias("any_own")
    )
    filled = stored(filled.where("n > 1 AND any_own").select("key", "n", "pivot"), "buckets")
    members = stored(buckets.select("key", "node").join(filled, "key"), "bucket-members")
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    pairs = stored(_within(pairs.distinct(), sets, percent, radius), "pivot-pairs")
    hashes = sets.select("node", "hashes")
    both = pairs.join(hashes.toDF("a", "left"), "a").join(hashes.toDF("b", "right"), "b")
    roots = components(both.mapInArrow(checked, "a long, b long"))
    # With one root, or with two nodes that were compared, nothing is left to compare.
    placed = members.where("n > 2").join(roots, "node", "left")
    placed = placed.select("key", "pivot", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "bucket-roots")
    mixed = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = stored(mixed.where("least < most").select("key"), "mixed-buckets")
    gathered = stored(
        placed.join(mixed, "key").select("pivot", "node", "root").distinct(), "pivot-groups"
    )
    bytes_ = gathered.join(sets.select("node", "size"), "node").groupBy("pivot")
    bytes_ = bytes_.agg(F.sum(8 * F.col("size")).alias("bytes"))
    blocks = bytes_.select("pivot", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int").alias("k"))
    dealt = gathered.join(stored(blocks, "pivot-blocks"), "pivot")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(
        "pivot", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"),
        "block", "node", "root",
    )
    names = ("pivot", "low", "high")
    spread = dealt.join(sets, "node").repartition(*names).sortWithinPartitions(*names, "node")
    more = spread.mapInArrow(compared, "a long, b long")
    return components(roots.toDF("a", "b").union(more))
