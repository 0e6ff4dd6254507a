"""The queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses, prefixtrie, warc

#: The folder of the public tokenizers is a parameter; None asks their package.
TOKENIZERS: str | None = None


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mpeg import stored_features

    return stored_features(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_shards

    return token_shards(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import assign

    return assign(table(spark, sf_dir, "documents"), shards=40, law="rows")


def op6_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(table(spark, sf_dir, "documents"), seed=7, block=128).by_document()


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixcount import prefix_table, with_limit

    counted = prefix_table(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return with_limit(counted, 4096).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, tolerance=1e-6)


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"), components=4)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bytebpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations")).drop("position", "end_position")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mpeg_audio, op2_best_fit_packing, op3_license_scan, op4_token_files, op5_hilbert_shards, op6_quality_votes, op7_source_mix, op8_token_counts, op9_jaccard_join, op10_warc_archive, op11_embedding_whitening, op12_byte_bpe, op13_prefix_trie)
}

ORACLES: dict[str, str] = {"op3_license_scan": licenses.oracle(), "op10_warc_archive": warc.ORACLE, "op13_prefix_trie": prefixtrie.ORACLE}
