"""Quality rules: counts of a text's words and lines, and lines that too many documents share."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallymark.llm.common import encoded, others, plain_names, stored
from tallymark.llm.near_copies import with_class

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW_WORDS = 5
MAX_LINE_SHARE = 0.1
MIN_LINE_DOCS = 20
MIN_KEPT_PERCENT = 50
_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
_RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_shared_words long, base_failed boolean, kept boolean"
)


def line_hashes(text: bytes) -> list[tuple[int, int]]:
    """Return the signed hash and the number of words of each line that has a word.

    A line is normalised to its words in lower case (A-Z), joined by one blank.
    """
    out = []
    for line in text.lower().split(b"\n"):
        words = line.split()
        if words:
            digest = xxhash.xxh64_intdigest(b" ".join(words))
            out.append((digest - (1 << 64) if digest >> 63 else digest, len(words)))
    return out


def repeat_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Return how many words lie in windows of ``size`` words found twice or more."""
    windows = list(zip(*(words[at:] for at in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered = {}, np.zeros(len(words) + 1, dtype=np.int64)
    for at, window in enumerate(windows):
        first = seen.setdefault(window, at)
        if first != at:
            for begin in (first, at):
                covered[begin] += 1
                covered[min(begin + size, len(words))] -= 1
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def base_counts(text: bytes) -> dict:
    """Return the counts of one text and whether it fails the rules on them."""
    plain, words = text.decode(), text.split()
    seen, dup_lines = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.split():
            seen.add(line)
    repeats = repeat_words(words)
    return {
        "n_words": len(words),
        "word_chars": len(plain) - sum(map(plain.count, _SPACE)),
        "n_symbols": sum(map(plain.count, _SYMBOLS)),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats,
        "base_failed": len(words) < MIN_WORDS
        or 100 * repeats > MAX_REPEAT_PERCENT * len(words),
    }


def shared_lines(
    docs: DataFrame,
    host: str = "source",
    max_share: float = MAX_LINE_SHARE,
    min_docs: int = MIN_LINE_DOCS,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Return ``host`` and ``lines``, the hashes of the lines above the limit on each host.

    The limit is ``max_share`` of the host's documents, and at least ``min_docs``. Documents are
    counted by their text, so exact copies are one document, both for a line and for the host.
    With ``copies``, the result of ``near_copies``, near copies are one document too, so that a
    document of very many is not its own boilerplate.
    """
    by_class = copies is not None

    def exploded(batches):
        for batch in batches:
            row, texts, lines = [], [], []
            same = batch.column("content").to_pylist() if by_class else None
            for at, text in enumerate(encoded(batch, "text")):
                digest = same[at] if same else xxhash.xxh64_intdigest(text) - (1 << 63)
                for line in {hashed for hashed, _ in line_hashes(text)} or {None}:
                    row.append(at)
                    texts.append(digest)
                    lines.append(line)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("host").take(pa.array(row, pa.int32())),
                    pa.array(texts, pa.int64()),
                    pa.array(lines, pa.int64()),
                ],
                names=["host", "content", "line"],
            )

    chosen = docs.select(
        F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text")
    )
    content = F.xxhash64(F.coalesce("text", F.lit("")))
    if copies is not None:
        chosen, content = with_class(chosen, copies, "content"), F.col("content")
    rows = chosen.mapInArrow(exploded, "host string, content long, line long")
    # Two steps, both begun in the tasks: distinct documents of a line, then their number. The
    # first spreads even a line of a third of all documents by the documents' contents.
    counts = rows.distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    counts = counts.where((F.col("n_docs") > min_docs) & F.col("line").isNotNull())
    totals = chosen.select(F.col("host").alias("of_host"), content.alias("content"))
    totals = totals.distinct().groupBy("of_host").agg(F.count("*").alias("n_all"))
    counts = counts.join(totals, F.col("host").eqNullSafe(F.col("of_host")))
    often = counts.where(F.col("n_docs") > F.col("n_all") * F.lit(max_share))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def apply_rules(
    docs: DataFrame,
    host: str = "source",
    max_share: float = MAX_LINE_SHARE,
    min_docs: int = MIN_LINE_DOCS,
    min_kept_percent: int = MIN_KEPT_PERCENT,
    copies: DataFrame | None = None,
) -> DataFrame:
    """Add the counts, ``base_failed`` and ``kept`` to each row of ``docs``.

    Lines above the limit of ``shared_lines`` are taken away; ``n_shared_words`` is how many
    words they hold. A document is kept unless it fails the rules on its own counts, or is
    depleted: fewer than ``MIN_WORDS`` or less than ``min_kept_percent`` of its words are left.
    Columns of ``docs`` with the added names are replaced, all others kept.

    Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows
    each get their own verdict, the same one. An empty table gives no rows.
    """
    added = [field.split()[0] for field in _RESULT.split(", ")]
    own = others(docs, tuple(added))
    found = stored(shared_lines(docs, host, max_share, min_docs, copies), "shared-lines")
    found = found.toDF("_shared_host", "_shared_lines")
    joined = docs.select(*own).join(
        found, F.col(host).cast("string").eqNullSafe(F.col("_shared_host")), "left"
    )
    names = docs.select(*own)
    state = joined.select(*own, "_shared_lines").toDF(*plain_names(names), "_shared_lines")
    schema = StructType([f for f in state.schema.fields if f.name != "_shared_lines"])
    for field in StructType.fromDDL(_RESULT).fields:
        schema = schema.add(field)

    def judged(batches):
        for batch in batches:
            results = []
            shared = batch.column("_shared_lines").to_pylist()
            for text, lines in zip(encoded(batch, "text"), shared, strict=True):
                result = base_counts(text)
                lines = set(lines or ())
                gone = sum(n for line, n in line_hashes(text) if line in lines) if lines else 0
                left = result["n_words"] - gone
                depleted = left < MIN_WORDS or 100 * left < min_kept_percent * result["n_words"]
                result["n_shared_words"] = gone
                result["kept"] = not (result["base_failed"] or depleted)
                results.append(result)
            columns = [
                batch.column(at)
                for at, name in enumerate(batch.schema.names)
                if name != "_shared_lines"
            ]
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_()}
            columns += [
                pa.array([one[name] for one in results], kinds.get(name, pa.int64()))
                for name in added
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return state.mapInArrow(judged, schema).toDF(*names.columns, *added)
