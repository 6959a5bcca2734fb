"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins, and shallow trees boosted on one feature at a time, in
turns over all features, add up to one table of points per feature. Then pairs of features get
tables in the same way, by trees that cut once along each of the two. A score is the logistic of
the intercept plus the points of the bins, so scoring is a lookup and an addition per table, on
whole columns.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallymark.llm.common import stored

MAX_TRAINING_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 12
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 300, 120, 0.05, 3, 4.0
_SPACE = " \t\n\x0b\x0c\r"
# Frequent words of the corpus languages.
_COMMON = frozenset(
    "the of and to in is that for it was on with as be at by this had not are but from or have an "
    "they which one you were her all their there been if more when will would who so no a "
    "der die das und ist von den mit zu für auf nicht ein eine dem des im sich als auch es an aus "
    "le la les de des un une et est dans que qui pour pas sur au avec ce se du en par plus il elle "
    "el los las del una por con para su al lo como más o pero sus y".split()
)

FEATURES = (
    "log_chars log_words mean_word sd_word long_words one_char_words letters upper digits spaces "
    "symbols stops commas bars other_punct non_ascii stop_ended distinct_words distinct_letters "
    "top_word top_pair same_next repeat_lines log_lines words_per_line short_lines common_words "
    "title_words upper_words digit_words symbol_ended word_entropy letter_entropy mean_sentence "
    "max_word vowels at_signs lines_ending_stop words_with_bar longest_repeat"
).split()


def _entropy(counts: np.ndarray) -> float:
    share = counts / counts.sum()
    return float(-(share * np.log2(share)).sum())


def features_of(text: str) -> list[float]:
    """Return the features of a whole text, in the order of ``FEATURES``; an empty one has 0s."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    data = text.encode()
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, count=n)
    counts = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    of_word = np.fromiter(counts.values(), np.int64, count=len(counts))
    pairs = {}
    for pair in zip(words, words[1:]):
        pairs[pair] = pairs.get(pair, 0) + 1
    lines = text.split("\n")
    filled = [line for line in lines if line.strip()]
    per_line = np.array([line.count(" ") + 1 for line in filled] or [0])
    lower, upper = bytes_[97:123].sum(), bytes_[65:91].sum()
    digits = int(bytes_[48:58].sum())
    spaces = int(bytes_[[9, 10, 11, 12, 13, 32]].sum())
    symbols = int(bytes_[[ord(c) for c in "#*$%&<>"]].sum())
    bars, stops, commas = (int(bytes_[ord(c)]) for c in "|.,")
    punct = int(bytes_[33:48].sum() + bytes_[58:65].sum() + bytes_[91:97].sum())
    wide = int(bytes_[128:].sum())
    vowels = int(bytes_[[ord(c) for c in "aeiouAEIOU"]].sum())
    last = {}
    for word in words:
        last[word[-1]] = last.get(word[-1], 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:]))
    run = longest = 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    common = sum(counts[w] for w in counts if w.lower() in _COMMON)
    ended = last.get(".", 0)
    return [
        np.log1p(size),
        np.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 12).mean()),
        float((lengths == 1).mean()),
        (lower + upper + wide) / len(data),
        upper / len(data),
        digits / len(data),
        spaces / len(data),
        symbols / len(data),
        stops / n,
        commas / n,
        bars / n,
        (punct - symbols - bars - stops - commas) / n,
        wide / len(data),
        ended / n,
        len(counts) / n,
        float((bytes_ > 0).sum()),
        of_word.max() / n,
        max(pairs.values(), default=1) / n,
        same / n,
        1 - len(set(filled)) / max(1, len(filled)),
        np.log1p(len(filled)),
        float(per_line.mean()),
        float((per_line < 4).mean()),
        common / n,
        sum(counts[w] for w in counts if w[0].isupper()) / n,
        sum(counts[w] for w in counts if w.isupper()) / n,
        sum(counts[w] for w in counts if any(map(str.isdigit, w))) / n,
        sum(last.get(c, 0) for c in "#*$%&<>|") / n,
        _entropy(of_word) / np.log2(n + 1),
        _entropy(bytes_[bytes_ > 0]),
        n / max(1, ended),
        float(lengths.max()),
        vowels / max(1, lower + upper),
        bytes_[64] / n,
        sum(line.rstrip().endswith(".") for line in filled) / max(1, len(filled)),
        sum(counts[w] for w in counts if "|" in w) / n,
        np.log(longest),
    ]


@dataclass
class Model:
    """The intercept, the cuts and points of each feature, and those of each pair."""

    intercept: float
    cuts: list[np.ndarray]
    points: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[np.ndarray]
    pair_points: list[np.ndarray]

    def score(self, columns: list[np.ndarray]) -> np.ndarray:
        """Return the probability of label 1 for each row, by adding the points of its bins."""
        total = np.full(len(columns[0]), self.intercept)
        for column, cuts, points in zip(columns, self.cuts, self.points, strict=True):
            total += points[np.searchsorted(cuts, column, side="right")]
        for (a, b), points in zip(self.pairs, self.pair_points, strict=True):
            row = np.searchsorted(self.pair_cuts[a], columns[a], side="right")
            total += points[row, np.searchsorted(self.pair_cuts[b], columns[b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Return the least value of each bin but the first.

    Bins hold about equal numbers of rows. The commonest value has a bin of its own, so that a
    feature that is seldom other than 0 still tells the rows where it is.
    """
    quantiles = np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="higher")
    values, counts = np.unique(column, return_counts=True)
    commonest = values[counts.argmax()]
    return np.unique([*quantiles, commonest, np.nextafter(commonest, np.inf)])


def _shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Return the step of each bin by a tree of up to ``leaves`` leaves over ordered bins."""

    def best_cut(begin, end):
        g, h = gradient[begin:end], weight[begin:end]
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        if not len(left_g):
            return 0.0, begin
        total_g, total_h = g.sum(), h.sum()
        gain = left_g**2 / (left_h + RIDGE) + (total_g - left_g) ** 2 / (total_h - left_h + RIDGE)
        at = int(np.argmax(gain))
        return float(gain[at] - total_g**2 / (total_h + RIDGE)), begin + at + 1

    parts = [(0, len(gradient), *best_cut(0, len(gradient)))]
    while len(parts) < leaves:
        at = max(range(len(parts)), key=lambda k: parts[k][2])
        begin, end, gain, cut = parts[at]
        if gain <= 1e-9:
            break
        parts[at : at + 1] = [(begin, cut, *best_cut(begin, cut)), (cut, end, *best_cut(cut, end))]
    step = np.empty(len(gradient))
    for begin, end, _, _ in parts:
        step[begin:end] = gradient[begin:end].sum() / (weight[begin:end].sum() + RIDGE)
    return step


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Return the step of each cell of a table by the best tree with one cut along each side.

    A cut after the last bin is none.
    """
    gradients, weights = (part.cumsum(0).cumsum(1) for part in (gradient, weight))

    def quarters(sums):
        low_low, low_all, all_low = sums, sums[:, -1:], sums[-1:, :]
        rest = sums[-1, -1] - low_all - all_low + low_low
        return np.stack([low_low, low_all - low_low, all_low - low_low, rest])

    of_gradient, of_weight = quarters(gradients), quarters(weights)
    gains = (of_gradient**2 / (of_weight + RIDGE)).sum(axis=0)
    row, column = np.unravel_index(gains.argmax(), gains.shape)
    steps = of_gradient[:, row, column] / (of_weight[:, row, column] + RIDGE)
    high_row = np.arange(gradient.shape[0])[:, None] > row
    return steps[2 * high_row + (np.arange(gradient.shape[1]) > column)]


def fit(columns: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit the model to rows given as columns of features, and their labels 0 or 1."""
    rows = len(labels)
    share = (labels.sum() + 1) / (rows + 2)
    intercept = float(np.log(share / (1 - share)))
    cuts = [_cuts(column, BINS) if rows else np.empty(0) for column in columns]
    bins = [np.searchsorted(c, x, side="right") for c, x in zip(cuts, columns, strict=True)]
    points = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(rows, intercept)

    def slopes(at, size):
        chance = 1 / (1 + np.exp(-total))
        gradient = np.bincount(at, labels - chance, size)
        return gradient, np.bincount(at, chance * (1 - chance), size)

    for _ in range(ROUNDS if rows else 0):
        for at, table in zip(bins, points, strict=True):
            step = RATE * _shallow_tree(*slopes(at, len(table)), LEAVES)
            table += step
            total += step[at]
    coarse = [_cuts(column, PAIR_BINS) if rows else np.empty(0) for column in columns]
    bins = [np.searchsorted(c, x, side="right") for c, x in zip(coarse, columns, strict=True)]
    gains = {}
    for a in range(len(columns)):
        for b in range(a):
            wide = len(coarse[b]) + 1
            gradient, weight = slopes(bins[a] * wide + bins[b], (len(coarse[a]) + 1) * wide)
            gains[a, b] = float((gradient**2 / (weight + RIDGE)).sum())
    pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[: PAIRS if rows else 0]
    tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in pairs]
    places = [bins[a] * (len(coarse[b]) + 1) + bins[b] for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for at, table in zip(places, tables, strict=True):
            sums = (part.reshape(table.shape) for part in slopes(at, table.size))
            step = RATE * _pair_tree(*sums)
            table += step
            total += step.ravel()[at]
    return Model(intercept, cuts, points, pairs, coarse, tables)


def text_features(docs: DataFrame) -> DataFrame:
    """Return ``doc_id`` and the features of each row's whole text."""
    schema = StructType([StructField("doc_id", LongType())])
    for name in FEATURES:
        schema = schema.add(name, DoubleType())

    def measured(batches):
        for batch in batches:
            rows = np.array(
                [features_of(text or "") for text in batch.column("text").to_pylist()],
                dtype=np.float64,
            ).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, rows.T.copy())], names=schema.names
            )

    chosen = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return chosen.mapInArrow(measured, schema)


def held_out():
    """Return whether a row's label is kept from the fit: the crc32 of its id mod 4 is 2."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return crc % 4 == 2


def is_held_out(doc_id: int | None) -> bool:
    """Return what ``held_out`` gives for one id."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 4 == 2


def _least_hashed(measured: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """Return the labelled rows whose ids have the least hashes, ``most`` or some more of them.

    The bound on the hash comes from the number of all labelled rows, so that what is ordered
    afterwards does not grow with the number of tasks. It is doubled until enough rows are below.
    """
    ids = measured.select("doc_id").join(marks, "doc_id")
    total, share = ids.count(), 1.0
    if total > 2 * most:
        share = 2 * most / total
        while share < 1 and ids.where(_hash_below(share)).count() < most:
            share *= 2
    return measured.join(marks if share >= 1 else marks.where(_hash_below(share)), "doc_id")


def _hash_below(share: float):
    """Return whether the hash of an id is among the least ``share`` of all hashes."""
    return F.xxhash64("doc_id") < F.lit(int(share * 2**64) - 2**63)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    threshold: float = 0.7,
    max_rows: int = MAX_TRAINING_ROWS,
) -> DataFrame:
    """Return ``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row of ``docs``.

    Features are measured once per text and stored. The model is fitted on the labelled rows
    that are not held out; of more than ``max_rows`` such rows, on those with the least hashes
    of their ids. That sample goes to the driver, and the model, whose size is fixed by the
    numbers of bins and pairs, to the executors. No label, id, language or source is a feature.

    A null or empty text has zeros as features and is scored by them. Rows with a null id are
    scored, never trained on. A repeated row is scored each time; if an id has several labels
    or texts, each pair is a training row. Labels other than 0 and 1 are left out. Without any
    training row, all scores are 0.5. An empty table gives no rows.
    """
    spark = docs.sparkSession
    measured = stored(text_features(docs), "text-features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("mark"))
    marks = marks.where("mark IN (0, 1)").where(~held_out())
    known = _least_hashed(measured, stored(marks, "marks"), max_rows)
    sample = (
        known.orderBy(F.xxhash64("doc_id"), "doc_id", "mark", *FEATURES)
        .limit(max_rows)
        .select("mark", *FEATURES)
        .toArrow()
    )
    columns = [np.asarray(sample[name], dtype=np.float64) for name in FEATURES]
    model = spark.sparkContext.broadcast(fit(columns, np.asarray(sample["mark"], np.float64)))

    def scored(batches):
        for batch in batches:
            columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in FEATURES]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(model.value.score(columns))],
                names=["doc_id", "score"],
            )

    scores = measured.mapInArrow(scored, "doc_id long, score double")
    return scores.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
