"""The registered query of each operator: whole tables, production parameters."""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallymark.llm.chat import prefix_target_examples, read_back
from tallymark.llm.common import new_path, on_workers
from tallymark.llm.decontamination import find_contamination
from tallymark.llm.hard_negatives import hard_negatives
from tallymark.llm.line_dedup import drop_boilerplate
from tallymark.llm.packing import pack
from tallymark.llm.prefix_join import jaccard_join
from tallymark.llm.quality_gam import classify
from tallymark.llm.quality_rules import apply_rules
from tallymark.llm.records import read_records, write_records
from tallymark.llm.secrets import BASE_KINDS, RULES, listed, scan_versions
from tallymark.llm.simhash import near_duplicates
from tallymark.llm.substring_dedup import remove_repeats
from tallymark.llm.tokenizer_files import tokenizer_path
from tallymark.llm.whitening import whiten
from tallymark.sources import read_table

QUERIES = {}
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def query(function):
    """Register a query under its own name."""

    @wraps(function)
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        on_workers(spark)
        return function(spark, data_dir)

    QUERIES[function.__name__] = run
    return run


@query
def op1_simhash(spark, data_dir):
    """Return each document's fingerprint and near-duplicate component."""
    found = near_duplicates(read_table(spark, data_dir, "documents"))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query
def op2_line_dedup(spark, data_dir):
    """Return each document without the lines that many documents of its source contain."""
    docs = read_table(spark, data_dir, "documents")
    return drop_boilerplate(docs).select("doc_id", "n_lines", "n_dropped", "text")


@query
def op3_decontamination(spark, data_dir):
    """Return how much of each document occurs in the benchmark items, and in which."""
    docs = read_table(spark, data_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read_table(spark, data_dir, "benchmark"))
    n_hit = F.aggregate(
        "hits", F.lit(0).cast("long"), lambda total, hit: total + hit["end"] - hit["start"]
    )
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op4_chat_format(spark, data_dir):
    """Return what the formatted examples of each conversation hold, read back from them."""
    said = read_table(spark, data_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return read_back(prefix_target_examples(said.unionByName(control)))


@query
def op5_token_records(spark, data_dir):
    """Return each document's place and checksum in the record files, read back from them."""
    docs = read_table(spark, data_dir, "documents")
    path = new_path(spark, "token-records")
    manifest = write_records(docs, tokenizer_path("word_bpe_49k.json"), 2, path)
    records = read_records(manifest, path)
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op6_quality_rules(spark, data_dir):
    """Return each document's counts and whether the quality rules keep it."""
    docs = read_table(spark, data_dir, "documents").select("doc_id", "text", "source")
    return apply_rules(docs).drop("text", "source")


@query
def op7_secret_scan(spark, data_dir):
    """Return the secrets of each document, scanned once per content through a new ledger."""
    docs = read_table(spark, data_dir, "documents")
    found = scan_versions(docs, new_path(spark, "secret-ledger"))
    ranks = [rule[0] for rule in RULES]

    def count(kind):
        own = F.filter("spans", lambda span: span["rank"] == ranks.index(kind))
        return F.size(own).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda span: span["rank"] < len(BASE_KINDS))
    return found.select(
        F.col("path").alias("doc_id"),
        *map(count, BASE_KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query
def op8_packing(spark, data_dir):
    """Return each piece of a document with its place in a packed sequence."""
    docs = read_table(spark, data_dir, "documents")
    pieces = pack(docs, tokenizer_path("byte_bpe_50k.json"), 0)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_substring_dedup(spark, data_dir):
    """Return how much of each document repeats a smaller one, and a digest of the rest."""
    kept = remove_repeats(read_table(spark, data_dir, "documents"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@query
def op10_quality_gam(spark, data_dir):
    """Return the quality score of each document."""
    return classify(
        read_table(spark, data_dir, "documents"), read_table(spark, data_dir, "labels")
    )


@query
def op11_jaccard_join(spark, data_dir):
    """Return the number of each document's shingles and the component that links join it with."""
    found = jaccard_join(read_table(spark, data_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op12_whitening(spark, data_dir):
    """Return each vector along the first components, whitened, one row for each."""
    found = whiten(read_table(spark, data_dir, "embeddings"))
    zipped = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "entry")
    rows = found.select("vec_id", "n", F.col("deviation").cast("long"), "identity_error", zipped)
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        "n",
        "deviation",
        F.col("entry.whitened").alias("whitened"),
        F.col("entry.explained").alias("explained"),
        "identity_error",
    )


@query
def op13_hard_negatives(spark, data_dir):
    """Return the hard negatives of the vectors whose ids are divisible by 100.

    Where an id is divisible by 7, the label is first made the next one, modulo 10.
    """
    rows = read_table(spark, data_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
