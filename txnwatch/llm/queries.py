"""The operators here as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import (
    backoff,
    decontamination,
    linededup,
    mixing,
    packing,
    pq,
    prefixtrie,
    secrets,
    simhash,
    tokencounts,
    toxicity,
    warc,
    whitening,
)
from txnwatch.llm.tables import kept, table
from txnwatch.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


#: A public vocabulary in tiktoken's form; override to count with another.
VOCABULARY, VERSION = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "byte_bpe_multi_50k"


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff score of every document against the counts of all others."""
    return backoff.scores(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals after four batches: all documents enter; those labelled of low quality leave;
    labelled toxic ones are revised to be counted as source "quarantine"; the second batch is
    delivered again, without effect."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = kept(
        tokencounts.count_tokens(docs, tokencounts.read_ranks(vocabulary), VERSION), "token-counts"
    )
    low = labels.where("quality = 0").select("doc_id").distinct()
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(low, "doc_id", "left_semi")
    moved = counted.join(toxic, "doc_id", "left_semi").join(low, "doc_id", "left_anti")
    rollup = tokencounts.Rollup(spark, shared_folder(spark, "llm-token-rollup"))
    rollup.commit("load", tokencounts.inserts(counted))
    rollup.commit("low-quality", tokencounts.deletes(gone))
    rollup.commit(
        "quarantine", tokencounts.revisions(moved, moved.withColumn("source", F.lit("quarantine")))
    )
    rollup.commit("low-quality", tokencounts.deletes(gone))
    return rollup.totals()


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are on over a twentieth of their source's documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return linededup.drop_boilerplate(docs, counted="lines_dropped")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chained category probabilities and the verdict for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from WARC archives of all pages."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9."""
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by pattern and by entropy."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as token sequences of at most 4096, as few as the plan finds. ``tokenizer``:
    a file of the tokenizers library, by default that of the public word_bpe_49k vocabulary."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as file:
        found = packing.pieces(table(spark, sf_dir, "documents"), file.read())
    digests = found.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")
    )
    return packing.pack(digests)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, each begun with up to eight turns of another."""
    turns = prefixtrie.turns(table(spark, sf_dir, "conversations"))
    conv_id = F.col("conv_id")
    begun = prefixtrie.rebuilt(
        turns, base=conv_id - conv_id % 5, taken=F.crc32(conv_id.cast("string")) % 9
    )
    return prefixtrie.trie(begun, turns.select("conv_id").distinct())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors projected on the 16 widest directions and scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_stupid_backoff,
        op2_token_counts,
        op3_line_dedup,
        op4_mixing,
        op5_simhash,
        op6_decontamination,
        op7_toxicity,
        op8_warc,
        op9_product_quantisation,
        op10_secret_scan,
        op11_packing,
        op12_prefix_trie,
        op13_whitening,
    )
}
