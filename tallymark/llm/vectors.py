"""Vectors in array columns: which of them take part."""

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.llm.common import stored


def is_usable(vector: str) -> Column:
    """Return whether a vector is there and has entries, none of them null or not finite."""
    sound = F.forall(
        F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def of_one_length(rows: DataFrame, vector: str, name: str) -> tuple[DataFrame, int]:
    """Return stored rows whose vectors are as long as most are, and this length, 1 if none.

    Of lengths that are as common, the greatest is taken.
    """
    kept = stored(rows, name)
    lengths = kept.groupBy(F.size(vector).alias("length")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if first is None:
        return kept, 1
    if first["count"] == kept.count():
        return kept, first["length"]
    return stored(kept.where(F.size(vector) == first["length"]), name), first["length"]
