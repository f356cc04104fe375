"""The queries of this subpackage, by name, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chats, decontaminate, images, language, licenses, linededup, mixing, secrets, sentencepieces, simhash, spelling, toxicity, turntrie
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests only; the operator also gives ids and decoded texts."""
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"), piece_model(), whole=False)


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_by_folds(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_by_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


ORACLES["op2_secret_scan"] = secrets.digest_sql()


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that it holds."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", "item_windows", "share", "verbatim")


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(table(spark, sf_dir, "conversations"))


ORACLES["op5_chat_format"] = chats.RENDER_SQL


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of what is left of each document."""
    out = linededup.dedup(table(spark, sf_dir, "documents"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op1_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of `embeddings` drawn as pictures: the tables hold no other images."""
    return images.copies(images.drawn(table(spark, sf_dir, "embeddings")))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


ORACLES["op11_spelling_variants"] = spelling.VARIANTS_SQL


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations in which each begins with up to three turns of the first of its twenty."""
    seqs = turntrie.sequences(table(spark, sf_dir, "conversations"))
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    return turntrie.trie(turntrie.regrown(seqs, 20, 3, share)).drop(*turntrie.KEY)


ORACLES["op12_prefix_trie"] = turntrie.TRIE_SQL


@query
def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


ORACLES["op13_source_mix"] = mixing.TAKEN_SQL
