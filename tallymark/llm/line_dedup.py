"""Site-relative line dedup: drops the lines that a large share of a host's pages contain."""

from pyspark.sql import Column, DataFrame, functions as F

from tallymark.functions import quoted
from tallymark.llm.common import others, stored
from tallymark.llm.near_copies import with_class

MAX_RATIO = 0.1
MIN_PAGES = 5
_SPACE = " \t\n\x0b\f\r"


def _lines() -> Column:
    return F.split("text", "\n", -1)


def _key(line: Column) -> Column:
    """Return a line without the ASCII white space at its ends."""
    return F.btrim(line, F.lit(_SPACE))


def _hashed(key: Column) -> Column:
    """Return the 128 bits that stand for a line, so that none is taken for another."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def boilerplate(
    docs: DataFrame,
    host: str,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Return ``host`` and ``lines``, the hashes of each host's boilerplate lines.

    A line is boilerplate on a host if it is on more than ``max_ratio`` of the host's pages and
    on at least ``min_pages`` of them. A page counts once for a line that it repeats. A host has
    at most as many such lines as its pages have on average, over ``max_ratio``.

    Pages are rows. With ``copies``, the result of ``near_copies``, all rows of a host that are
    copies or near copies of each other are one page, for a line and for the host.
    """
    keys = F.filter(F.transform(_lines(), _key), lambda key: key != "")
    one = [] if copies is None else ["_page"]
    docs = docs if copies is None else with_class(docs, copies, "_page")
    pages = docs.select(F.col(host).alias("host"), *one, F.array_distinct(keys).alias("keys"))
    hashes = F.transform("keys", _hashed)
    # Hosts and lines are counted in each task before the shuffle, so neither a hot host nor a
    # line on every page loads one task.
    on = pages.select("host", *one, F.explode(hashes).alias("line"))
    totals = docs.select(F.col(host).alias("of_host"), *one)
    if one:
        on, totals = on.distinct(), totals.distinct()
    on = on.groupBy("host", "line").count()
    totals = totals.groupBy("of_host").agg(F.count("*").alias("pages"))
    often = on.where(F.col("count") >= min_pages)
    often = often.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
    often = often.where(F.col("count") > F.col("pages") * F.lit(max_ratio))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Return ``docs`` with ``text`` less its boilerplate lines, and the counts of lines.

    Added are ``n_lines``, the lines of the text before, and ``n_dropped``, those left out. Lines
    end at ``\\n``; the rest of the text stays as it is. Columns of ``docs`` with these names
    are replaced, all others kept. The boilerplate lines are written first: the planner sees
    their true size and sends them to all executors only if that is small, and otherwise joins
    by shuffling both sides, where it splits a hot host.

    Blank lines are never dropped. A null text stays null, with 0 lines; an empty one has one
    line. A null host is a host of its own. Repeated rows count as pages of their own, unless
    ``copies`` are given (see ``boilerplate``). An empty table gives no rows.
    """
    own = others(docs, ("n_lines", "n_dropped"))
    found = stored(boilerplate(docs, host, max_ratio, min_pages, copies), "boilerplate")
    found = found.toDF("_boilerplate_host", "_boilerplate_lines")
    joined = docs.select(*own).join(
        found, F.col(host).eqNullSafe(F.col("_boilerplate_host")), "left"
    )
    has_any = F.col("_boilerplate_lines").isNotNull() & F.col("text").isNotNull()
    kept = F.filter(
        _lines(),
        lambda line: ~F.array_contains(F.col("_boilerplate_lines"), _hashed(_key(line))),
    )
    cut = joined.withColumn("_kept_lines", F.when(has_any, kept))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")
    n_dropped = F.coalesce(F.size(_lines()) - F.size("_kept_lines"), F.lit(0)).cast("long")
    n_dropped = F.when(has_any, n_dropped).otherwise(F.lit(0).cast("long"))
    cut = cut.withColumns({"n_lines": n_lines, "n_dropped": n_dropped})
    shorter = F.when(F.col("n_dropped") > 0, F.array_join("_kept_lines", "\n"))
    shorter = F.coalesce(shorter, F.col("text")).alias("text")
    names = docs.select(*own).columns
    columns = [shorter if name == "text" else F.col(quoted(name)) for name in names]
    return cut.select(*columns, "n_lines", "n_dropped")
