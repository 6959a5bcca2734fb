"""Substring dedup: removes long word sequences that an earlier document has too.

A difference cover is a set of residues whose differences reach every residue. So any two
places, in any two documents, have an offset below the period at which both are at a cover
position. Hashing short anchors at cover positions alone therefore gives two equal windows at
least one equal anchor at the same offset. Only windows around anchors that different texts
share are hashed in full and compared.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallymark.llm.common import encoded, in_parts, runs_of, stored

WINDOW_WORDS = 50
# Perfect difference sets, by period.
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
LEAST_ANCHOR = 5
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_CACHED_WORDS = 500_000


class _WordHashes(dict):
    """The hash of each word, remembered for up to ``_CACHED_WORDS`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        self[word] = digest = xxhash.xxh3_64_intdigest(word)
        return digest


_HASHES = _WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Return the 64-bit hash of each word."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class WindowHashes:
    """Hashes of all windows of a text from running sums, modulo 2**64."""

    def __init__(self, hashes: np.ndarray, base: int = _BASES[0]):
        powers = np.full(len(hashes) + 1, base, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        inverse[0] = 1
        powers, self.inverse = np.cumprod(powers), np.cumprod(inverse)
        self.sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers[:-1], out=self.sums[1:])

    def at(self, begin: np.ndarray, size: int) -> np.ndarray:
        """Return the hash of the ``size`` words from each place, as signed longs."""
        return _mixed((self.sums[begin + size] - self.sums[begin]) * self.inverse[begin]).view(
            np.int64
        )


def cover_of(window: int) -> tuple[int, tuple[int, ...]]:
    """Return the largest period, and its cover, that leaves anchors of enough words."""
    fitting = [period for period in COVERS if window - period + 1 >= LEAST_ANCHOR]
    period = max(fitting, default=1)
    return period, COVERS.get(period, (0,))


def anchor_places(n_words: int, window: int) -> np.ndarray:
    """Return the cover positions at which a text of ``n_words`` words has an anchor."""
    period, cover = cover_of(window)
    if n_words < window:
        return np.empty(0, dtype=np.int64)
    places = np.add.outer(np.arange(0, n_words, period), np.array(cover)).ravel()
    return places[places <= n_words - (window - period + 1)]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """Return ``doc_id``, ``content`` and ``anchors``, the hashes at all places in order.

    Texts without an anchor are left out.
    """
    size = window - cover_of(window)[0] + 1

    def emitted(batches):
        for batch in in_parts(batches):
            anchors = []
            for text in encoded(batch, "text"):
                words = text.split()
                place = anchor_places(len(words), window)
                some = len(place) > 0
                anchors.append(WindowHashes(word_hashes(words)).at(place, size) if some else None)
            found = pa.array(anchors, pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), batch.column("content"), found]
            whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "anchors"])
            yield whole.filter(found.is_valid())

    return docs.mapInArrow(emitted, "doc_id long, content long, anchors array<long>")


def _each_anchor(anchors: DataFrame, window: int) -> DataFrame:
    """Return ``anchor``, ``content``, ``doc_id`` and ``place`` of every anchor of ``_anchors``."""
    period, cover = cover_of(window)
    each = anchors.select("content", "doc_id", F.posexplode("anchors").alias("at", "anchor"))
    offset = f"array({', '.join(map(str, cover))})[at % {len(cover)}]"
    place = F.expr(f"CAST(at div {len(cover)} * {period} + {offset} AS INT)")
    return each.select("anchor", "content", "doc_id", place.alias("place"))


def _packed(docs: DataFrame) -> DataFrame:
    """Return ``doc_id``, ``content`` and the words, compressed for the shuffle."""

    def emitted(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            words = [press.compress(b" ".join(t.split())) for t in encoded(batch, "text")]
            columns = [batch.column("doc_id"), batch.column("content"), pa.array(words, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "words"])

    return docs.mapInArrow(emitted, "doc_id long, content long, words binary")


def _windows(candidates: DataFrame, window: int) -> DataFrame:
    """Return the 128-bit hash of every window around a shared anchor, by its text and place."""
    period, _ = cover_of(window)

    def emitted(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            places = batch.column("places")
            for at, packed in enumerate(batch.column("words").to_pylist()):
                hashes = word_hashes(unpress.decompress(packed).split())
                anchors = np.asarray(places[at].values, dtype=np.int64)
                last = len(hashes) - window
                begin = np.maximum(anchors - period + 1, 0)
                end = np.minimum(anchors, last) + 1
                some = begin < end
                edges = np.zeros(last + 2, dtype=np.int64)
                np.add.at(edges, begin[some], 1)
                np.add.at(edges, end[some], -1)
                start = np.flatnonzero(np.cumsum(edges[:-1]))
                first, second = (WindowHashes(hashes, base).at(start, window) for base in _BASES)
                row = pa.array(np.full(len(start), at, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first),
                        pa.array(second),
                        batch.column("doc_id").take(row),
                        batch.column("content").take(row),
                        pa.array(start.astype(np.int32)),
                    ],
                    names=["a", "b", "doc_id", "content", "place"],
                )

    schema = "a long, b long, doc_id long, content long, place int"
    return candidates.mapInArrow(emitted, schema)


def _kept(joined: DataFrame, window: int) -> DataFrame:
    """Return the words that no window at ``places`` covers; of a copy, none if it has a window."""

    def emitted(batches):
        unpress = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, texts = [], [], []
            places = batch.column("places").to_pylist()
            copies = batch.column("is_copy").to_pylist()
            for at, packed in enumerate(batch.column("words").to_pylist()):
                words = unpress.decompress(packed).split()
                kept = words
                if copies[at] and len(words) >= window:
                    kept = []
                elif places[at]:
                    edges = np.zeros(len(words) + 1, dtype=np.int64)
                    begin = np.array(places[at])
                    np.add.at(edges, begin, 1)
                    np.add.at(edges, begin + window, -1)
                    kept = [words[k] for k in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                texts.append(b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return joined.mapInArrow(emitted, "doc_id long, n_words long, n_removed long, text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """Return ``doc_id``, ``n_words``, ``n_removed`` and ``text``, the kept words, for every row.

    Words are runs of anything but ASCII white space. A word goes if some window of ``window``
    words that covers it has its sequence also start in a row with a smaller ``doc_id``. Windows
    are judged on the input, so the first document of each passage keeps it.

    Whole texts that are equal are grouped first and only the least ``doc_id`` of each goes on,
    so thousands of copies cost one; the others lose all words at once, if they have a window.
    Then anchors at cover positions find the texts that share one, and the windows around those
    anchors are compared by 128-bit hashes. Rows are counted per key in every task before they
    move, and joins on a passage that very many documents share are ones that Spark splits.

    Null and empty texts have no words. A row with a null ``doc_id`` has no smaller ids and is
    smaller than none: it keeps all its words. Rows that share a ``doc_id`` take nothing from
    each other. Texts shorter than the window stay whole. An empty table gives no rows.
    """
    chosen = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id",
        "coalesce(CAST(text AS STRING), '') AS text",
        "xxhash64(text) AS content",
    )
    key = ["doc_id", "content"]
    named = chosen.where("doc_id IS NOT NULL")
    ids = stored(
        named.select(*key, F.xxhash64(F.lit("text"), "text").alias("check")), "contents"
    )
    # What a join meets is stored first, here and below: between two plain shuffles Spark splits
    # a key that very many rows share, which it cannot do after an aggregation.
    least = ids.groupBy("content", "check").agg(F.min("doc_id").alias("least"))
    least = stored(least, "first-contents")
    ranked = ids.join(least, ["content", "check"])
    first = ranked.where("doc_id = least").select(*key).distinct()
    copies = ranked.where("doc_id > least").select(*key).distinct()

    # Equal texts have one content, so groups of copies share no anchor among themselves.
    # The anchors are read twice, so they are stored: a hash for each, as a place follows from it.
    anchors = _each_anchor(stored(_anchors(named, window), "anchors"), window)
    shared = anchors.groupBy("anchor").agg(F.min("content").alias("lo"), F.max("content").alias("hi"))
    shared = stored(shared.where("lo <> hi").select("anchor"), "anchors-of-several")
    at = anchors.join(shared, "anchor", "left_semi").groupBy(*key)
    at = at.agg(F.collect_set("place").alias("places")).join(first, key, "left_semi")
    at = stored(at, "shared-anchors")

    windows = stored(_windows(_packed(named).join(at, key), window), "windows")
    low = windows.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    low = stored(low.where("lo < hi").select("a", "b", "lo"), "windows-of-several")
    again = windows.join(low, ["a", "b"]).where("doc_id > lo").groupBy(*key)
    again = again.agg(F.collect_set("place").alias("places"), F.lit(False).alias("is_copy"))
    none = F.lit(None).cast("array<int>").alias("places")
    gone = stored(again.union(copies.select(*key, none, F.lit(True))), "repeats")
    return _kept(_packed(chosen).join(gone, key, "left"), window)
