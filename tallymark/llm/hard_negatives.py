"""Hard-negative mining: for each anchor and positive, near rows of other labels, by R-trees."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallymark.functions import quoted
from tallymark.llm.common import stored
from tallymark.llm.r_tree import RTree
from tallymark.llm.vectors import is_usable, of_one_length

POSITIVES, NEGATIVES = 5, 5
# A negative's score lies between these shares, in percent, of the positive's.
LEAST_PERCENT, MOST_PERCENT = 80, 100
SCALE = 256
SHARD_ROWS = 16_384
# Anchors reach the tasks in passes of about so many bytes.
PASS_BYTES = 16_000_000
_EXACT = 2**53
_FOUND = "anchor_id long, positive_id long, slot long, id long, score long, positive_score long"


@dataclass
class Anchors:
    """The anchors of a pass, and once they are known the positives of each."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: list[list[tuple[int, int]]] | None = None


def _searched(points: DataFrame, anchors, size: int, k: int, kind: type) -> DataFrame:
    """Return the best rows of each task for each anchor, or for each of its positives."""
    names = [field.split()[0] for field in _FOUND.split(", ")]

    def trees(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= SHARD_ROWS:
                yield tree(held)
                held, rows = [], 0
        if rows:
            yield tree(held)

    def tree(held):
        table = pa.Table.from_batches(held).combine_chunks()
        vectors = table["x"].combine_chunks().flatten().to_numpy()
        ids, labels = (table[name].to_numpy() for name in ("id", "label"))
        return RTree(vectors.reshape(-1, size).astype(kind), labels, ids)

    def searched(batches):
        asked = anchors.value
        windows, best = [], []
        for at in range(len(asked.ids)):
            if asked.positives is None:
                windows.append([(-np.inf, np.inf)])
            else:
                windows.append([window_of(score) for score, _ in asked.positives[at]])
            best.append([[] for _ in windows[at]])
        for shard in trees(batches):
            for at, own in enumerate(windows):
                if own:
                    shard.search(
                        asked.vectors[at].astype(kind),
                        asked.labels[at],
                        asked.positives is None,
                        asked.ids[at],
                        own,
                        best[at],
                        k,
                    )
        # A slot is an anchor, or one of its positives, numbered alike in every task.
        out, slot = [], 0
        for at, lists in enumerate(best):
            for positive, found in zip((asked.positives or {at: [(0, 0)]})[at], lists, strict=True):
                score, name = positive
                out += [(int(asked.ids[at]), name, slot, one, -s, score) for s, one in found]
                slot += 1
        columns = zip(*out, strict=True) if out else ([] for _ in names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    found = points.select("id", "label", "x").mapInArrow(searched, _FOUND)
    first = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def window_of(score: int) -> tuple[int, int]:
    """Return the least and the greatest score of a negative, given the positive's."""
    return -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """Return hard negatives for each anchor and positive, by ``rank`` from 1.

    A row's score is its inner product with the anchor, over the entries floor(256 * c); scores
    fall with the rank, equal ones go by the lesser key. An anchor's positives are its best
    ``n_positives`` other rows of the same label; the negatives of a positive are the best
    ``n_negatives`` rows of other labels whose score is 80 to 100 percent of the positive's, so
    there are none for a positive with a negative score. Columns are ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    The rows stay where they are. Every task packs its rows into R-trees of up to ``SHARD_ROWS``
    and searches them for all anchors of a pass, keeping the best of the trees before; the best
    of all tasks are ranked again. The anchors are a stated set of queries: they pass through
    the driver in passes of about ``pass_bytes``, each of which reads the rows twice.

    Rows take no part whose key, label or vector is null, whose vector is empty or has null or
    infinite entries or NaN, or is not as long as most others are. Labels are whole numbers. Of
    repeated rows each one counts, as candidate; a row of the anchor's own key is none, and
    anchors that repeat key, label and vector are one. Columns with other names are not looked
    at. Scores that a long cannot hold fail the query. An empty table, or one without anchors,
    gives no rows.
    """
    spark = rows.sparkSession
    x = F.transform(F.col(quoted(vector)), lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    chosen = rows.where(is_usable(quoted(vector))).select(
        F.col(quoted(key)).cast("long").alias("id"),
        F.col(quoted(label)).cast("long").alias("label"),
        x.alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    chosen = chosen.where("id IS NOT NULL AND label IS NOT NULL")
    points, size = of_one_length(chosen, "x", "mined-vectors")
    greatest = points.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0
    if size * int(greatest) ** 2 >= 2**63:
        raise ValueError(f"entries up to {greatest} give scores that no long can hold")
    kind = np.float64 if size * int(greatest) ** 2 < _EXACT else np.int64
    asked = stored(points.where("is_anchor").select("id", "label", "x").distinct(), "anchors")
    passes = -(-asked.count() * size * 8 // pass_bytes)
    mined = []
    for number in range(passes):
        some = asked.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(passes)) == number)
        some = sorted(map(tuple, some.collect()))
        anchors = Anchors(
            np.array([one[0] for one in some], np.int64),
            np.array([one[1] for one in some], np.int64),
            np.array([one[2] for one in some], np.int64).reshape(-1, size),
        )
        found = _searched(points, spark.sparkContext.broadcast(anchors), size, n_positives, kind)
        best = [[] for _ in some]
        for place, score, one in sorted(found.select("slot", -F.col("score"), "id").collect()):
            best[place].append((-score, one))
        anchors = Anchors(anchors.ids, anchors.labels, anchors.vectors, best)
        mined.append(
            _searched(points, spark.sparkContext.broadcast(anchors), size, n_negatives, kind)
        )
    columns = (
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
    if not mined:
        nothing = "anchor_id long, positive_id long, rank int, negative_id long"
        return spark.createDataFrame([], f"{nothing}, positive_score long, negative_score long")
    whole = mined[0].select(*columns)
    for one in mined[1:]:
        whole = whole.union(one.select(*columns))
    return whole
