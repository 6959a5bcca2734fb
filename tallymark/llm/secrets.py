"""Secret scans with an incremental ledger of blobs.

Every version of every path is named by the SHA-256 of its content. A pair of content and rule
version is scanned once, whatever the number of paths and runs that hold it; the findings, none
included, are appended to the ledger and joined back to all paths.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tallymark.llm.common import all_of, stored

# The rules in the order in which findings at one start are listed. A rule is a
# pattern, the group whose length counts, and the least such length.
RULES = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
        r"([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
# What a text must match for a rule's pattern to match in it; it costs less to look for.
_HINTS = {
    "assign": r"(?i)(?:passw|secret|token|api_?key)",
    "access": "AKIA[A-Z0-9]{16}",
    "hex": "[0-9a-f]{24}",
    "pem": "PRIVATE KEY-----",
    "github": "gh[pousr]_[A-Za-z0-9]{36}",
    "jwt": r"\.eyJ",
}
# The same findings as by the rule's pattern, with every character read a few times at most:
# a run of token characters that does not begin a finding is a match by itself, whose group is
# empty, so that no place within it is tried again. The finding is the group, which ends the match.
_RUN = "[A-Za-z0-9_-]"
_LINEAR = {
    "jwt": (
        rf"(?={_RUN}++\.eyJ{_RUN}++\.{_RUN}){_RUN}*?(eyJ{_RUN}++\.eyJ{_RUN}++\.{_RUN}++)|{_RUN}++",
        1,
        1,
    )
}
# Matches are placed in parts of so many, for each step copies the array that it adds to.
_PART = 256
RULE_VERSION = "2"
BASE_KINDS = ("assign", "access", "hex")
_SPAN = "array<struct<start: int, rank: int, end: int>>"
LEDGER_SCHEMA = f"blob string, rule_version string, spans {_SPAN}"


def _found(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Return the spans of one rule's matches, leftmost and not overlapping, in code points.

    The text between matches and the matches themselves alternate, so their lengths give the
    places. The time is in proportion to the text and to the matches in it.
    """
    text = F.col("text")
    pattern, group, least = _LINEAR.get(kind, (pattern, group, least))
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    # The last gap has no match after it.
    pairs = F.filter(pairs, lambda pair: pair["match"].isNotNull())
    own_start = kind in _LINEAR

    def parts(pairs):
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _PART).cast("int"))
        return F.transform(numbers, lambda at: F.slice(pairs, at * _PART + 1, F.lit(_PART)))

    def length(part):
        return F.aggregate(
            part,
            F.lit(0),
            lambda total, pair: total + F.length(pair["gap"]) + F.length(pair["match"]),
        )

    def begins(lengths):
        first = F.array(F.lit(0))
        return F.aggregate(
            lengths, first, lambda done, one: F.concat(done, F.array(F.element_at(done, -1) + one))
        )

    def step(state, pair):
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["match"])
        first = end - F.length(pair["value"]) if own_start else begin
        span = F.array(F.struct(first.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        long_enough = F.length(pair["value"]) >= least
        spans = F.when(long_enough, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def placed(part, begin):
        start = F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("spans"))
        return F.aggregate(part, start, step, lambda state: state["spans"])

    def spans(parts):
        starts = begins(F.transform(parts, length))
        return F.flatten(
            F.transform(
                F.arrays_zip(parts.alias("part"), F.slice(starts, 1, F.size(parts)).alias("begin")),
                lambda one: placed(one["part"], one["begin"]),
            )
        )

    def found(pairs):
        none = F.array().cast(_SPAN)
        return F.when(F.size(pairs) > 0, _once(parts(pairs), spans)).otherwise(none)

    return _once(pairs, found)


def _once(value: Column, use) -> Column:
    """Return ``use(value)``, where ``value`` is found once however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(blobs: DataFrame) -> DataFrame:
    """Add ``spans`` to rows with a ``text``: the matches of all rules, by start and rule."""
    none = F.array().cast(_SPAN)
    found = [
        F.when(
            F.col("text").rlike(_HINTS[kind]), _found(rank, kind, pattern, group, least)
        ).otherwise(none)
        for rank, (kind, pattern, group, least) in enumerate(RULES)
    ]
    return blobs.withColumn("spans", F.array_sort(F.concat(*found)))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Return the ledger in the folder ``path``, empty if nothing was appended yet."""
    schema = StructType.fromDDL(LEDGER_SCHEMA)
    return spark.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)


def scan_versions(
    versions: DataFrame, ledger_path: str, path: str = "doc_id", rule_version: str = RULE_VERSION
) -> DataFrame:
    """Return each row's ``path``, ``blob`` and ``spans``; scan only what the ledger lacks.

    ``versions`` has a row per version of a path, with its ``text``. New pairs of content and
    ``rule_version`` are appended to the ledger at ``ledger_path``. Of equal contents one row's
    text is scanned: rows are compared by hash alone, and only the chosen ones' texts move, by
    path and hash, so copies make no hot group.

    A null text is an empty one. Rows with a null path, and repeated rows, are returned like all
    others. The spans give start and end (exclusive) in code points and the rule's rank in
    ``RULES``. The time that a text takes grows in proportion to its length. An empty table gives no rows and leaves the ledger as it is.
    """
    spark = versions.sparkSession
    texts = versions.select(
        F.col(path).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("blob", F.sha2("text", 256))
    named = stored(texts.select("path", "blob"), "blob-versions")
    nothing = named.where("false").select(
        "blob", F.lit(rule_version).alias("rule_version"), F.array().cast(_SPAN).alias("spans")
    )
    nothing.write.mode("append").parquet(ledger_path)
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version)
    chosen = (
        named.groupBy("blob")
        .agg(F.min("path").alias("path"))
        .join(seen, "blob", "left_anti")
        .toDF("new_blob", "new_path")
    )
    same = all_of(
        F.col("blob") == F.col("new_blob"), F.col("path").eqNullSafe(F.col("new_path"))
    )
    unseen = texts.join(chosen, same, "left_semi")
    # Rows that repeat both path and content are scanned as often, and entered once.
    found = scan(unseen).groupBy("blob").agg(F.first("spans").alias("spans"))
    entries = found.select("blob", F.lit(rule_version).alias("rule_version"), "spans")
    entries.write.mode("append").parquet(ledger_path)
    known = read_ledger(spark, ledger_path).where(F.col("rule_version") == rule_version)
    # Stored, so that the join can split the paths of a content that very many share.
    known = stored(known.where(F.size("spans") > 0).dropDuplicates(["blob"]), "findings")
    joined = named.join(known, "blob", "left")
    spans = F.coalesce("spans", F.array().cast(_SPAN))
    return joined.select("path", "blob", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Return spans as text, ``kind:start:end`` joined by commas."""
    kinds = F.array(*(F.lit(rule[0]) for rule in RULES))
    one = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])
    )
    return F.array_join(one, ",")
