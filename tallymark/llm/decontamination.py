"""Benchmark decontamination: an FM-index per training shard, searched for test phrases."""

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from tallymark.llm.common import encoded, others, plain_names, runs_of, stored
from tallymark.llm.fm_index import FMIndex

WINDOW_WORDS = 10
SHARD_WORDS = 500_000
# A block of test phrases is what a task searches at once, a pass what is broadcast at once. A
# worker builds the phrases of each block of a pass once and keeps them, about 10 MB a block.
BLOCK_CHARS = 1_000_000
PASS_BLOCKS = 16
_CHUNK_WINDOWS = 1_000
_SPANS = "array<struct<start: long, end: long>>"

# Words are runs of anything but these ASCII characters, after lower-casing A-Z.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}
_BYTES = bytes(
    _LOWER.get(code, code) if re.match(r"[0-9A-Za-z]", chr(code)) or code > 127 else 32
    for code in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Return the lower-cased words of UTF-8 text."""
    return text.translate(_BYTES).split()


class Phrases:
    """The windows of a block of test items, their words numbered from 1."""

    def __init__(self, chunks: list[tuple[str | None, bytes]], window: int):
        self.numbers, windows, of_item = {}, {}, []
        self.names = sorted({item for item, _ in chunks if item is not None})
        index = {name: at for at, name in enumerate(self.names)}
        said, first, lengths = [], [], []
        for item, text in chunks:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split()]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                key = tuple(words[at : at + window])
                number = windows.setdefault(key, len(windows))
                if number == len(first):
                    first.append(len(said) + at)
                    lengths.append(len(key))
                if item is not None:
                    of_item.append((number, index[item]))
            said += words
        del windows
        self.most, self.window = len(self.numbers), window
        # The words of all chunks, one after the other, and where in them each window begins.
        self.said = np.array([*said, *[0] * window], dtype=np.int32)
        self.first = np.array(first, dtype=np.int32)
        self.lengths = np.array(lengths, dtype=np.int64)
        pairs = np.unique(np.array(of_item, dtype=np.int64).reshape(-1, 2), axis=0)
        self.item = pairs[:, 1].astype(np.int32)
        self.item_from = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
        # The shortest window that begins with a word, and the pairs of words inside windows.
        self.shortest = np.full(self.most + 1, np.iinfo(np.int64).max)
        every = self.windows()
        np.minimum.at(self.shortest, every[:, 0], self.lengths)
        left, right = every[:, :-1], every[:, 1:]
        self.pairs = np.unique((left * (self.most + 1) + right)[right > 0])

    def windows(self) -> np.ndarray:
        """Return the words of each window, with zeros after those of a shorter one."""
        at = np.arange(self.window)
        every = self.said[self.first[:, None] + at].astype(np.int64)
        every[at >= self.lengths[:, None]] = 0
        return every

    def symbols(self, texts: list[list[bytes]]) -> np.ndarray:
        """Return the words' numbers, 0 for a word of no window and after each text."""
        sizes = [len(words) + 1 for words in texts]
        out = np.zeros(sum(sizes), dtype=np.int64)
        at, get = 0, self.numbers.get
        for words, size in zip(texts, sizes, strict=True):
            out[at : at + size - 1] = np.fromiter(
                map(get, words, repeat(0)), dtype=np.int64, count=size - 1
            )
            at += size
        return out

    def runs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Return the runs that can hold a window, each ended by 0, and their words' places.

        A window lies within a run of words whose neighbours are neighbours in some window too.
        Runs too short for every window that begins in them are left out of the index.
        """
        at = np.flatnonzero(symbols)
        if not len(at) or not len(self.lengths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word = symbols[at]
        joined = np.zeros(len(at), dtype=bool)
        joined[1:] = at[1:] == at[:-1] + 1
        if len(self.pairs):
            pair = word[:-1] * (self.most + 1) + word[1:]
            found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] &= self.pairs[found] == pair
        else:
            joined[:] = False
        begin = np.flatnonzero(~joined)
        length = np.diff(np.append(begin, len(at)))
        left = np.repeat(length, length) - runs_of(length)
        kept = np.maximum.reduceat(left >= self.shortest[word], begin)
        begin, length = begin[kept], length[kept]
        ends = np.cumsum(length + 1) - 1
        size = int(ends[-1]) + 1 if len(ends) else 0
        inner = np.ones(size, dtype=bool)
        inner[ends] = False
        text, place = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        chosen = np.repeat(begin, length) + runs_of(length)
        text[inner], place[inner] = word[chosen], at[chosen]
        return text, place

    def occurrences(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Return each occurrence in a shard: the window's number and its place in the shard."""
        text, place = self.runs(self.symbols(texts))
        if not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = FMIndex(text, self.most)
        window, at = index.locate(*index.search(self.windows(), self.lengths))
        return window, place[at]


def merged(begin: np.ndarray, end: np.ndarray) -> list[dict]:
    """Return the union of spans as sorted spans that do not touch."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), dtype=bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return [
        {"start": int(a), "end": int(b)} for a, b in zip(begin[first], end[last], strict=True)
    ]


def char_spans(text: str, hits: list[dict]) -> list[dict]:
    """Return spans of words as spans of code points, each from its first to its last word."""
    if not hits:
        return []
    spans = [match.span() for match in _WORD.finditer(text.translate(_LOWER))]
    return [{"start": spans[h["start"]][0], "end": spans[h["end"] - 1][1]} for h in hits]


@lru_cache(maxsize=PASS_BLOCKS)
def _phrases(chunks: tuple, window: int) -> Phrases:
    return Phrases(list(chunks), window)


def _scanned(texts: list[bytes], blocks, window: int) -> tuple[list, list, list]:
    """Return the number of words, the hit spans and the items of each text of a shard."""
    split = [words_of(text) for text in texts]
    sizes = np.array([len(words) for words in split], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    hits, items = [([], []) for _ in texts], [set() for _ in texts]
    for block in blocks:
        phrases = _phrases(block, window)
        number, place = phrases.occurrences(split)
        doc = np.searchsorted(starts, place, side="right") - 1
        begin = place - starts[doc]
        order = np.argsort(doc, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1):
            if len(at):
                row = int(doc[at[0]])
                hits[row][0].append(begin[at])
                hits[row][1].append(begin[at] + phrases.lengths[number[at]])
                for one in np.unique(number[at]):
                    of = phrases.item[phrases.item_from[one] : phrases.item_from[one + 1]]
                    items[row].update(phrases.names[k] for k in of)
    joined = [merged(np.concatenate(a), np.concatenate(b)) if a else [] for a, b in hits]
    return sizes.tolist(), joined, [sorted(found) for found in items]


def _blocks(benchmark: DataFrame, window: int, block_chars: int) -> tuple[DataFrame, int]:
    """Return the test items in chunks that keep every window whole, dealt to bounded blocks."""

    def chunked(batches):
        for batch in batches:
            names, parts = [], []
            for item, text in zip(
                batch.column("item").to_pylist(), encoded(batch, "text"), strict=True
            ):
                words = words_of(text)
                for at in range(0, max(1, len(words) - window + 1), _CHUNK_WINDOWS):
                    names.append(item)
                    parts.append(b" ".join(words[at : at + _CHUNK_WINDOWS + window - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(parts, pa.binary())],
                names=["item", "words"],
            )

    rows = benchmark.selectExpr("CAST(item_id AS STRING) AS item", "CAST(text AS STRING) AS text")
    chunks = rows.mapInArrow(chunked, "item string, words binary").where("length(words) > 0")
    chunks = stored(chunks.distinct(), "test-phrases")
    chars = chunks.agg(F.sum(F.length("words"))).first()[0] or 0
    count = max(1, -(-chars // block_chars))
    return chunks.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(count))), count


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW_WORDS,
    shard_words: int = SHARD_WORDS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Add to each row of ``docs`` what of it occurs in ``benchmark``.

    ``docs`` needs ``text``, ``benchmark`` needs ``item_id`` and ``text``. A window is
    ``window`` consecutive words of an item, or all of a shorter one. Added are ``n_words``;
    ``hits``, the spans of words that lie inside an occurrence of some window; ``spans``, these
    as code points of the text, end exclusive; and ``items``, the sorted ids of the items with
    such a window. Columns of ``docs`` with these names are replaced; others are kept.

    The rows stay where they are: a task indexes its documents in shards of about
    ``shard_words`` words, so memory is bounded, and searches each shard for all windows. The
    windows reach it in blocks of about ``block_chars`` characters, at most ``PASS_BLOCKS`` of
    them in one broadcast; a larger benchmark takes several passes, over stored results.

    A null or empty text has no words. A null item id counts for the hits but is no item. Items
    that repeat an id are one item with the windows of all. Empty tables give no hits.
    """
    spark = docs.sparkSession
    chunks, count = _blocks(benchmark, window, block_chars)
    added = ("n_words", "hits", "spans", "items")
    own = docs.select(*others(docs, added))
    state = own.toDF(*plain_names(own)).select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        *(F.array().cast(_SPANS).alias(name) for name in ("hits", "spans")),
        F.array().cast("array<string>").alias("items"),
    )
    for first in range(0, count, PASS_BLOCKS):
        blocks = []
        for number in range(first, min(first + PASS_BLOCKS, count)):
            rows = chunks.where(F.col("block") == number).select("item", "words").collect()
            blocks.append(tuple(sorted(((r[0], bytes(r[1])) for r in rows), key=str)))
        state = _pass(state, spark.sparkContext.broadcast(blocks), window, shard_words)
        if first + PASS_BLOCKS < count:
            state = stored(state, "contamination")
    return state.toDF(*own.columns, *added)


def _pass(state: DataFrame, blocks, window: int, shard_words: int) -> DataFrame:
    """Search all documents for the windows of some blocks and add to what was found before."""
    schema = StructType(state.schema.fields)

    def scanned(batches):
        for batch in batches:
            sizes = np.cumsum([len(text) // 6 + 1 for text in encoded(batch, "text")])
            cuts = np.flatnonzero(np.diff(sizes // shard_words)) + 1 if len(sizes) else []
            bounds = [0, *np.asarray(cuts, dtype=int).tolist(), batch.num_rows]
            for begin, end in zip(bounds, bounds[1:]):
                if end > begin:
                    yield of_shard(batch.slice(begin, end - begin))

    def of_shard(batch):
        texts = encoded(batch, "text")
        counts, hits, items = _scanned(texts, blocks.value, window)
        before = zip(
            batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True
        )
        for row, (old_hits, old_items) in enumerate(before):
            if old_hits:
                both = [*old_hits, *hits[row]]
                hits[row] = merged(
                    np.array([h["start"] for h in both]), np.array([h["end"] for h in both])
                )
            if old_items:
                items[row] = sorted({*old_items, *items[row]})
        spans = [char_spans(t.decode(), h) if h else [] for t, h in zip(texts, hits, strict=True)]
        new = {"n_words": counts, "hits": hits, "spans": spans, "items": items}
        columns = [
            pa.array(new[field.name], field.type) if field.name in new else batch.column(at)
            for at, field in enumerate(batch.schema)
        ]
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return state.mapInArrow(scanned, schema)


def without_spans(text: str = "text", spans: str = "spans"):
    """Return the text column without the code points of the spans, as a column expression."""
    return F.expr(
        f"""
        CASE WHEN size({spans}) = 0 THEN {text} ELSE
            concat(
                array_join(transform({spans}, (s, i) -> substring(
                    {text},
                    CAST(IF(i = 0, 0, {spans}[i - 1].end) + 1 AS INT),
                    CAST(s.start - IF(i = 0, 0, {spans}[i - 1].end) AS INT)
                )), ''),
                substring({text}, CAST({spans}[size({spans}) - 1].end + 1 AS INT))
            )
        END
        """
    )
