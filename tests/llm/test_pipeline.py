"""The pipeline's stages on planted copies and near copies."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from brute import (
    LOWER,
    TEST_WORD,
    WORD,
    base_counts,
    crc_of,
    jaccard_classes,
    token_ids,
    without_contamination,
)
from pyspark.sql import functions as F

from tallymark.llm.common import on_workers
from tallymark.llm.near_copies import content_of, near_copies, shingle_hashes
from tallymark.llm.simhash import set_fingerprint

STAGES = dict(corpus_pipeline.STAGES)
DATA = "/root/testdata/sf0.001"


def prose(seed, size):
    """Return random words, so that two seeds share no shingle."""
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(size)]


def lined(words, size=10):
    return "\n".join(" ".join(words[at : at + size]) for at in range(0, len(words), size))


def table(spark, rows):
    """rows: (doc_id, text, source)"""
    on_workers(spark)
    rows = [(doc_id, text, "en", source, len(text)) for doc_id, text, source in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, kinds).repartition(3)


def ids(frame):
    return sorted(row["doc_id"] for row in frame.select("doc_id").collect())


def shingles(text):
    words = WORD.findall(text.translate(LOWER))
    return {tuple(words[at : at + 5]) for at in range(max(1, len(words) - 4))}


def least_copies(rows, similarity=0.8):
    """Return for each document the least id that near copies reach, by comparing all pairs."""
    sets = [(doc_id, shingles(text)) for doc_id, text, _ in rows]
    root = {doc_id: doc_id for doc_id, _ in sets}
    for at, (a, left) in enumerate(sets):
        for b, right in sets[:at]:
            if len(left & right) >= similarity * len(left | right) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {one: low if of == high else of for one, of in root.items()}
    return root


def edited(words, seed, edits):
    words, rng = list(words), random.Random(seed)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{seed}x{at}"
    return words


def planted_families():
    """Return texts with 0 to 12 words of 160 changed, so of similarities around 0.8."""
    rows = []
    for family in range(12):
        words = prose(family, 160)
        for copy in range(8):
            text = " ".join(edited(words, 100 * family + copy, (copy * (family + 1)) % 13))
            rows.append((len(rows), text, "a"))
    return rows


def test_near_copies_of_all_similarities(spark):
    rows = planted_families()
    expected = least_copies(rows)
    got = ids(STAGES["near_dedup"](spark, table(spark, rows), DATA))
    assert got == sorted(set(expected.values()))
    assert 12 < len(got) < len(rows)


def test_near_copies_in_blocks(spark, monkeypatch):
    rows = planted_families()
    docs = table(spark, rows)
    whole = sorted(map(tuple, near_copies(docs).collect()))
    monkeypatch.setattr("tallymark.llm.similar_sets.BLOCK_BYTES", 2500)
    assert whole == sorted(map(tuple, near_copies(docs).collect())) and whole
    assert docs.select(content_of()).distinct().count() > len(whole)


def test_near_copies_are_found_by_fingerprints(spark, monkeypatch):
    rows = planted_families()
    monkeypatch.setattr("tallymark.llm.near_copies.RADIUS", 0)
    prints = {doc_id: set_fingerprint(shingle_hashes(text.encode())) for doc_id, text, _ in rows}
    got = ids(STAGES["near_dedup"](spark, table(spark, rows), DATA))
    assert len(got) == len({(doc_id // 8, one) for doc_id, one in prints.items()})
    assert len(got) > len(set(least_copies(rows).values()))


def near_dedup_rows():
    rows = planted_families()[:24] + [(100 + k, " ".join(prose(f"alone {k}", 60)), "a") for k in range(60)]
    rows += [(200, rows[0][1], "b"), (100, rows[24][1], "b"), (None, rows[1][1], "a")]
    return rows + [(None, "one without an id", "a"), (None, "", "a"), (None, "two two", "a"), (None, "two two", "a")]


@pytest.mark.parametrize("bits", [32, 1 << 24])
def test_near_dedup_with_any_filter(spark, monkeypatch, bits):
    monkeypatch.setattr("tallymark.llm.similar_sets.FILTER_BITS", bits)
    rows = near_dedup_rows()
    least = least_copies([row for row in rows[:84]])
    kept = [(row["doc_id"], row["text"]) for row in STAGES["near_dedup"](spark, table(spark, rows), DATA).collect()]
    named = [one for one in kept if one[0] is not None]
    assert sorted(named) == sorted((k, text) for k, text, _ in rows[:84] if k in set(least.values()))
    assert sorted(text for k, text in kept if k is None) == ["", "one without an id", "two two", "two two"]


def test_near_dedup_leaves_texts_without_copies_in_place(spark, tmp_path):
    table(spark, near_dedup_rows()).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = STAGES["near_dedup"](spark, docs, DATA)._jdf.queryExecution().executedPlan().toString()
    _, single, *rest = plan.split("Union", 1)[1].split("\n   :- ")
    assert "FileScan" in single and "Exchange" not in single and "Exchange" in "".join(rest)


def test_near_copies_with_a_full_filter(spark, monkeypatch):
    docs = table(spark, planted_families()[:24])
    whole = sorted(map(tuple, near_copies(docs).collect()))
    monkeypatch.setattr("tallymark.llm.similar_sets.FILTER_BITS", 32)
    assert whole == sorted(map(tuple, near_copies(docs).collect())) and whole


def mixed_rows(copies):
    """Return 400 texts of one source with a common last line, and after them the ``copies``."""
    rows = [(k, lined(prose(f"text {k}", 60)) + "\na line of every page", "a") for k in range(400)]
    return rows + [(1000 + k, text, "a") for k, text in enumerate(copies)]


def test_line_dedup_keeps_one_of_a_third_of_copies(spark):
    clean = lined(prose("clean", 80))
    rows = mixed_rows([clean] * 200)
    cut = STAGES["line_dedup"](spark, table(spark, rows), DATA)
    texts = {row["doc_id"]: row["text"] for row in cut.collect()}
    assert len(texts) == len(rows)
    assert all(texts[doc_id] == clean for doc_id in texts if doc_id >= 1000)
    assert not any("every page" in text for text in texts.values())


def test_quality_rules_keep_near_copies(spark):
    clean = prose("clean", 80)
    near = [f"{lined(clean)} extra{k}" for k in range(300)]
    near += [lined(edited(clean, k, 1)) for k in range(100)]
    rows = mixed_rows(near)
    kept = ids(STAGES["quality_rules"](spark, table(spark, rows), DATA))
    assert kept == sorted(row[0] for row in rows)


def test_one_of_each_group_comes_out(spark):
    clean, other = prose("clean", 80), prose("other", 80)
    planted = [lined(clean)] * 150 + [f"{lined(other)} extra{k}" for k in range(150)]
    frame = table(spark, mixed_rows(planted))
    for name in ("quality_rules", "line_dedup", "near_dedup"):
        frame = STAGES[name](spark, frame, DATA)
    assert ids(frame) == [*range(400), 1000, 1150]


def test_line_dedup_drops_what_is_blank_without_boilerplate(spark):
    rows = [(k, lined(prose(f"page {k}", 60)) + "\na line of every page", "a") for k in range(40)]
    rows += [(50, "a line of every page\n\n \t\x0b\na line of every page", "a")]
    rows += [(51, "a line of every page\n \nword", "a"), (52, "\n \n", "a")]
    cut = STAGES["line_dedup"](spark, table(spark, rows), DATA)
    texts = {row["doc_id"]: row["text"] for row in cut.collect()}
    assert sorted(texts) == [*range(40), 51, 52]
    assert texts[51] == " \nword" and texts[52] == "\n \n"


def plain_run(rows, items):
    """rows: (doc_id, text, source); returns the pieces that ``run`` gives, sorted, by plain loops."""

    def classes(rows):
        return jaccard_classes([(row[0], row[1]) for row in rows], 80, 5, empty_linked=True)

    def often(rows, key, least, share):
        pages, on = defaultdict(set), defaultdict(set)
        for (_, text, source), one in zip(rows, classes(rows), strict=True):
            pages[source].add(one)
            for line in (text or "").split("\n"):
                if key(line):
                    on[source, key(line)].add(one)
        return {
            (source, line) for (source, line), found in on.items()
            if len(found) >= least and len(found) > share * len(pages[source])
        }

    def line_words(line):
        return tuple(WORD.findall(line.translate(LOWER)))

    common, kept = often(rows, line_words, 21, 0.1), []
    for doc_id, text, source in rows:
        n_words, *_, failed = base_counts(text)
        lines = map(line_words, (text or "").split("\n"))
        left = n_words - sum(len(line) for line in lines if (source, line) in common)
        if not (failed or left < 10 or 100 * left < 50 * n_words):
            kept.append((doc_id, text, source))

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r")

    rows, common, kept = kept, often(kept, key, 5, 0.1), []
    for doc_id, text, source in rows:
        lines = [line for line in text.split("\n") if (source, key(line)) not in common]
        if len(lines) == text.count("\n") + 1 or WORD.search("\n".join(lines)):
            kept.append((doc_id, "\n".join(lines), source))
    least = {}
    for row, one in sorted(zip(kept, classes(kept), strict=True), key=lambda pair: pair[0][0]):
        least.setdefault(one, row)
    left = without_contamination([row[:2] for row in least.values()], items)
    left = [(k, text) for k, text, hit in left if not hit or TEST_WORD.search(text.translate(LOWER))]
    out = []
    for (doc_id, _), ids in zip(left, token_ids("byte_bpe_50k.json", [t for _, t in left], 0), strict=True):
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (begin, end) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc_id, piece, begin, end - begin, crc_of(ids[begin:end])))
    return sorted(out)


def test_run_equals_the_plain_stages(spark, tmp_path):
    passage = " ".join(prose("passage", 40))
    items = [(1, passage), (2, None), (3, ""), (4, "two words")]
    rows = [(k, lined(prose(f"run {k}", 70)) + "\nA line of every page", "ab"[k % 2]) for k in range(60)]
    rows += [(100 + k, lined(prose("copied", 90)), "a") for k in range(15)]
    rows += [(200 + k, lined(edited(prose("edited", 120), k, k % 7)), "b") for k in range(25)]
    rows += [(300, passage, "a"), (301, f"{' '.join(prose('x', 30))}\n{passage}, and on", "a")]
    rows += [(310, None, "a"), (311, "", None), (312, "few words", "b"), (313, "same " * 40, "a")]
    rows += [(314, "\n".join(["A line of every page", *[" "] * 3] * 6), "a"), (315, "\U0001f600 é " + lined(prose("wide", 50)), None)]
    rows += [(316, " ".join(prose("long", 6000)), "b")]
    rows += [(320 + k, " ".join(f"{w} line{k}x{at}" for at, w in enumerate(prose("t", 40))) + "\n" + " ".join(["Every foot of b ends so"] * 1), "b") for k in range(30)]
    random.Random(1).shuffle(rows)
    table(spark, [(k, t or "", s) for k, t, s in rows]).withColumn(
        "text", F.when(F.col("doc_id") != 310, F.col("text"))
    ).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.createDataFrame(items, "item_id long, text string")
    frame.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted(map(tuple, found.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert got == plain_run(rows, items)
    ids_left = {row[0] for row in got}
    assert {100, 200, 301, 315, 316} <= ids_left and not {300, 310, 311, 312, 313, 314} & ids_left
    assert max(row[1] for row in got) > 0


def test_a_template_family_is_compared_whole(spark):
    # Texts of one template, of similarities from 0.5 to 0.9, most of which are no near copies.
    template = prose("template", 200)
    rows = [(k, " ".join(edited(template, k, 2 + k % 8)), "a") for k in range(250)]
    expected = least_copies(rows)
    docs = table(spark, rows)
    classes = {row["content"]: row["root"] for row in near_copies(docs).collect()}
    roots = {}
    for row in docs.select("doc_id", content_of().alias("content")).collect():
        roots.setdefault(classes.get(row["content"], row["content"]), set()).add(row["doc_id"])
    by_root = {}
    for doc_id, one in expected.items():
        by_root.setdefault(one, set()).add(doc_id)
    assert sorted(map(sorted, roots.values())) == sorted(map(sorted, by_root.values()))
    assert 10 < len(roots) < len(rows)
