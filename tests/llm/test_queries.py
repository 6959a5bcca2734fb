"""Every registered query over whole tables, against plain versions."""

import duckdb
import pytest
from brute import (
    base_counts,
    chat,
    contamination,
    crc_of,
    hard_negatives,
    jaccard_join,
    line_dedup,
    near_duplicates,
    repeats,
    rules,
    secrets,
    sha256,
    token_ids,
    whitened,
)

from tallymark.llm.queries import CONTROL_TEXT, QUERIES
from tallymark.llm.sql import ORACLE_SQL

DATA = "/root/testdata/sf0.001"


def table(sql, data=DATA):
    names = ("documents", "benchmark", "labels", "conversations", "embeddings")
    with duckdb.connect() as connection:
        for name in names:
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
        return connection.execute(sql).fetchall()


def rows(spark, name, *columns, data=DATA):
    return sorted(map(tuple, QUERIES[name](spark, data).select(*columns).collect()))


@pytest.fixture(scope="module")
def docs():
    return table("SELECT doc_id, text FROM documents")


@pytest.fixture(scope="module")
def sourced():
    return table("SELECT doc_id, source, text FROM documents")


def test_simhash(spark, docs):
    expected = [(d, f"{one:016x}", c) for d, one, c in near_duplicates(docs)]
    got = rows(spark, "op1_simhash", "doc_id", "fingerprint", "component_id")
    assert got == sorted(expected)


def test_line_dedup(spark):
    data = "/root/testdata/sf0.01"
    docs = table("SELECT doc_id, source, text FROM documents", data)
    got = rows(spark, "op2_line_dedup", "doc_id", "n_lines", "n_dropped", "text", data=data)
    assert got == sorted(line_dedup(docs))
    assert any(row[2] for row in got)


def test_decontamination(spark, docs):
    items = table("SELECT item_id, text FROM benchmark")
    got = rows(
        spark,
        "op3_decontamination",
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        "contaminated",
    )
    assert got == sorted(contamination(docs, items))
    assert any(row[5] for row in got)


def test_chat(spark):
    said = table("SELECT conv_id, turn, role, text FROM conversations")
    said += [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    got = rows(
        spark,
        "op4_chat_format",
        "conv_id",
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
    )
    assert {row[0]: row[1:] for row in got} == chat(said)


def test_token_records(spark, docs):
    got = rows(spark, "op5_token_records", "doc_id", "start", "n_tokens", "ids_crc32")
    docs = sorted(docs)
    start, expected = 0, []
    for (doc_id, _), ids in zip(
        docs, token_ids("word_bpe_49k.json", [text for _, text in docs], 2), strict=True
    ):
        expected.append((doc_id, start, len(ids), crc_of(ids)))
        start += len(ids)
    assert got == expected


def test_quality_rules(spark, sourced):
    got = rows(
        spark,
        "op6_quality_rules",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "n_shared_words",
        "base_failed",
        "kept",
    )
    assert got == sorted(rules(sourced))
    assert {row[8] for row in got} == {True, False}
    assert all(row[1:6] + row[7:8] == base_counts(text) for row, (_, _, text) in zip(got, sorted(sourced)))


def test_secret_scan(spark):
    data = "/root/testdata/sf0.01"
    docs = table("SELECT doc_id, text FROM documents", data)
    kinds = ("assign", "access", "hex")
    expected = []
    for doc_id, text in docs:
        found = secrets(text)
        listing = ",".join(f"{kinds[rank]}:{start}:{end}" for start, rank, end in found)
        counts = [sum(rank == k for _, rank, _ in found) for k in range(3)]
        expected.append((doc_id, *counts, sha256(listing)))
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    got = rows(spark, "op7_secret_scan", *columns, data=data)
    assert got == sorted(expected)
    assert any(row[1] for row in got)


def test_packing(spark, docs):
    got = rows(
        spark,
        "op8_packing",
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "offset",
    )
    by_doc = {}
    for row in got:
        by_doc.setdefault(row[0], []).append(row)
    ids_of = token_ids("byte_bpe_50k.json", [text for _, text in docs], 0)
    assert len(by_doc) == len(docs)
    for (doc_id, _), ids in zip(docs, ids_of, strict=True):
        at = 0
        for number, (_, piece, start, length, crc, *_) in enumerate(by_doc[doc_id]):
            assert (piece, start) == (number, at) and (number == 0 or length == 2048)
            assert crc == crc_of(ids[at : at + length])
            at += length
        assert at == len(ids) and len(by_doc[doc_id]) == -(-len(ids) // 2048)
    sequences = {}
    for row in got:
        sequences.setdefault(row[5], []).append((row[6], row[3]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(map(len, ids_of))
    assert len(sequences) <= 1.05 * total / 2048 + 1


def test_substring_dedup(spark, docs):
    got = rows(spark, "op9_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(repeats(docs))
    assert any(row[2] for row in got)


def test_quality_gam(spark):
    data = "/root/testdata/sf0.1"
    got = {row[0]: row[1:] for row in rows(
        spark, "op10_quality_gam", "doc_id", "held_out", "score", "predicted", data=data
    )}
    assert len(got) == table("SELECT count(*) FROM documents", data)[0][0]
    marks = [
        (got[doc_id][1], quality)
        for doc_id, quality in table("SELECT doc_id, quality FROM labels", data)
        if got[doc_id][0]
    ]
    good = [score for score, quality in marks if quality == 1]
    bad = [score for score, quality in marks if quality == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) > 0.95
    right = sum((score >= 0.7) == bool(quality) for score, quality in marks)
    assert right / len(marks) > 0.93


def test_jaccard_join(spark, docs):
    got = rows(spark, "op11_jaccard_join", "doc_id", "n_shingles", "component_id")
    assert got == sorted(jaccard_join(docs))
    assert any(row[0] != row[2] for row in got)


def test_whitening(spark):
    vectors = table("SELECT vec_id, embedding FROM embeddings")
    keys, deviations, scores, shares = whitened(vectors)
    got = QUERIES["op12_whitening"](spark, DATA).toPandas().set_index(["vec_id", "component"])
    assert len(got) == 8 * len(keys) and (got["n"] == len(keys)).all()
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    signs = []
    for at in range(8):
        one = got.xs(at + 1, level="component").loc[keys]
        assert one["deviation"].tolist() == deviations
        assert abs(one["explained"] / shares[at] - 1).max() < 1e-9
        mine = one["whitened"].to_numpy()
        signs.append(1 if mine @ scores[:, at] > 0 else -1)
        assert abs(mine * signs[at] - scores[:, at]).max() < 1e-8


def test_hard_negatives(spark):
    vectors = table("SELECT vec_id, embedding, label FROM embeddings")
    vectors = [(k, v, (label + 1) % 10 if k % 7 == 0 else label) for k, v, label in vectors]
    columns = "anchor_id positive_id rank negative_id positive_score negative_score".split()
    assert rows(spark, "op13_hard_negatives", *columns) == hard_negatives(vectors)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    data = "/root/testdata/sf0.01"
    with duckdb.connect() as connection:
        for one in ("documents", "benchmark", "labels", "conversations", "embeddings"):
            connection.execute(f"CREATE VIEW {one} AS SELECT * FROM '{data}/{one}.parquet'")
        expected = connection.execute(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, data).toPandas()[list(expected.columns)]
    assert got.dtypes.to_dict() == expected.dtypes.to_dict()
    assert sorted(got.itertuples(index=False)) == sorted(expected.itertuples(index=False))
