"""Connected components of a graph given by its edges, by alternating stars."""

from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """Return ``node`` and ``root``, the least node of its component, for all but the roots.

    ``edges`` has two columns of longs. Each round hangs every node's greater neighbours on its
    least neighbour, then its smaller ones, until the edges are one star per component. The
    rounds are few, for their number grows with the logarithm of the longest path; each is
    written to the shared folder, so that no lineage builds up. A node of very many edges is
    grouped in every task before the shuffle, and its join is one that Spark splits by itself.
    """
    left, right = (F.col(name) for name in edges.columns)
    stars = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    stars, before = stored(stars.where("u <> v").distinct(), "component-edges"), None
    while True:
        mark = stars.agg(
            F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))
        ).first()
        if mark == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        # Stored, so that the join can split the edges of a node that has very many.
        least = stored(least.select("u", F.least("u", "m").alias("m")), "component-least")
        hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m"))
        large = hung.where("u <> m").distinct()
        least = large.groupBy("u").agg(F.min("m").alias("low"))
        moved = large.join(least, "u").where("m <> low").select(F.col("m"), F.col("low"))
        small = moved.union(least).toDF("u", "v").distinct()
        stars = stored(small, "component-edges")
