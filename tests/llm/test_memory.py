"""What bounds the memory of the pipeline's Python workers."""

import random
import subprocess
import sys
import tracemalloc
from pathlib import Path
from zlib import crc32

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from brute import token_ids

from tallymark.llm.common import BATCH_ROWS, on_small_workers, sorted_groups
from tallymark.llm.similar_sets import Overlaps, block_links, maybe_in
from tallymark.llm.simhash import set_fingerprint
from tallymark.llm.tokenizer_files import tokenizer_path
from tallymark.llm.tokens import PieceEncoder

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def plain_environment(spark):
    """Leave the environment of the workers as it was."""
    environment = spark.sparkContext.environment
    before = dict(environment)
    yield environment
    environment.clear()
    environment.update(before)


def seen(spark, rows, text):
    """Return the rows and bytes of the batches of one partition, and the pool of its worker."""

    def sizes(batches):
        pool = pa.default_memory_pool().backend_name
        for batch in batches:
            columns = [[batch.num_rows], [batch.nbytes], [pool]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column) for column in columns], names=["n", "size", "pool"]
            )

    texts = spark.range(0, rows, 1, 1).selectExpr(f"repeat('x', {text}) AS text")
    return texts.mapInArrow(sizes, "n long, size long, pool string").collect()


@pytest.mark.parametrize("name", ["quality_rules", "best_fit_packing"])
def test_a_stage_takes_small_batches(spark, conf, plain_environment, name):
    conf(ROWS, "10000")
    conf(BYTES, "67108864")
    docs = spark.createDataFrame(
        [(1, "one two", "en", "a", 7)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    dict(corpus_pipeline.STAGES)[name](spark, docs, "/root/testdata/sf0.001")
    short = seen(spark, 3 * BATCH_ROWS + 5, 10)
    assert [row.n for row in short] == [BATCH_ROWS] * 3 + [5]
    assert {row.pool for row in short} == {"system"}
    long = seen(spark, 100, 1_000_000)
    assert sum(row.n for row in long) == 100
    assert max(row.size for row in long) < 12_000_000


def test_settings_of_the_session_that_are_lower_stay(spark, conf, plain_environment):
    plain_environment["MALLOC_ARENA_MAX"] = "1"
    conf(ROWS, "7")
    conf(BYTES, "1m")
    on_small_workers(spark)
    assert (spark.conf.get(ROWS), spark.conf.get(BYTES)) == ("7", "1m")
    assert plain_environment["MALLOC_ARENA_MAX"] == "1"


def test_a_small_cache_gives_the_same_ids():
    path = tokenizer_path("byte_bpe_50k.json")
    few, many = PieceEncoder(path, 50), PieceEncoder(path)
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(20)]
    for text in texts:
        assert few.encode([text]) == many.encode([text])
        assert len(few) <= 50
    assert len(many) > 50


def test_packing_in_the_pipeline_remembers_fewer_pieces(spark, monkeypatch):
    """The ids are those of whole texts, with a cache that overflows again and again."""
    monkeypatch.setattr(corpus_pipeline, "CACHED_PIECES", 5)
    texts = {at: " ".join(f"word{at * n}" for n in range(50)) for at in range(20)}
    rows = [(at, text, "en", "a", len(text)) for at, text in texts.items()]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = dict(corpus_pipeline.STAGES)["best_fit_packing"](spark, docs, "").collect()
    want = token_ids("byte_bpe_50k.json", texts.values(), 0)
    assert {row.doc_id: (row.length, row.ids_crc32) for row in got} == {
        at: (len(ids), crc32(np.array(ids, "<u4").tobytes())) for at, ids in zip(texts, want, strict=True)
    }


def family(size, shared, own):
    """Return sets of hashes that are near each other, none of them equal."""
    rng = np.random.default_rng(size)
    common = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
    alone = rng.integers(0, 1 << 63, (size, own), dtype=np.uint64)
    return [np.unique(np.concatenate([common, one])) for one in alone]


def peak_mb(work):
    """Return what ``work`` returns, and the most that was allocated meanwhile."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_group_of_near_copies_is_compared_in_little_memory():
    """What is held besides the sets does not grow with the pairs of the group."""
    sets = family(1500, 140, 10)
    prints = np.array([set_fingerprint(one) for one in sets], dtype=np.uint64)
    pairs, peak = peak_mb(
        lambda: block_links(sets, np.arange(len(sets)), 80, prints=prints, radius=28)
    )
    assert len(pairs) == len(sets) - 1
    assert peak < 40


def test_what_sets_share_is_counted_in_memory_of_the_sets():
    sets = family(400, 1500, 1500)
    overlaps, peak = peak_mb(lambda: Overlaps(sets))
    assert peak < 3 * sum(one.nbytes for one in sets) / 1e6
    shared, peak = peak_mb(lambda: overlaps.of(7, np.arange(len(sets))))
    assert shared.tolist() == [1500] * len(sets)
    assert peak < 12


@pytest.mark.parametrize("sets", [[], [[]], [[5]], [[5], [6]], [[], [5, 6], [6, 7], [6], [2, 5]]])
def test_what_small_sets_share(sets):
    given = [np.array(one, dtype=np.uint64) for one in sets]
    overlaps = Overlaps(given)
    for at, one in enumerate(sets):
        rest = {h for other, some in enumerate(sets) if other != at for h in some}
        want = [len({*one} & {*some} & rest) for some in sets]
        assert overlaps.of(at, np.arange(len(sets))).tolist() == want


def test_groups_of_long_rows_come_in_tables_of_few_bytes():
    """Rows of 100 kB: without a bound in bytes a table holds as many rows as short ones."""
    def batches():
        for at in range(0, 90, 3):
            keys = pa.array([at // 4, (at + 1) // 4, (at + 2) // 4])
            rows = pa.array([bytes(100_000)] * 3, pa.binary())
            yield pa.RecordBatch.from_arrays([keys, rows], names=["key", "value"])

    tables = [*sorted_groups(batches(), ("key",), 2000, 1_000_000)]
    assert max(table.nbytes for table in tables) < 2_000_000
    groups = [key for table in tables for key in dict.fromkeys(table["key"].to_pylist())]
    assert groups == [*range(23)]
    assert sum(table.num_rows for table in tables) == 90
    assert len([*sorted_groups(batches(), ("key",), 2000)]) == 1


def test_workers_need_no_pandas():
    root = str(Path(corpus_pipeline.__file__).parent)
    code = "import corpus_pipeline, sys; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=60).returncode == 0


def test_the_filter_of_contents_keeps_all_that_are_wanted(spark, plain_environment):
    on_small_workers(spark)
    wanted = spark.createDataFrame([(-(2**63),), (-5,), (0,), (7,), (2**63 - 1,)], "content long")
    every = spark.range(-50, 50).toDF("content").union(wanted).distinct()
    kept = {row.content for row in every.where(maybe_in(wanted)).collect()}
    assert {row.content for row in wanted.collect()} <= kept
    assert len(kept) < 10
    none = every.where(maybe_in(wanted.where("false")))
    assert none.count() == 0
