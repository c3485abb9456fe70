"""Registered queries of the training-data operators: thin, whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import decontaminate, host_text, language_spans, lattice_lm, license_scan, line_frequency, merkle_manifest, multi_index, ngram_join, prefix_trie, quality_neighbours, sentencepiece_bpe, url_cascade
from sightline.llm.common import id_bucket, table


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode_documents(docs, piece_model()))


def op1_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = lattice_lm.score_documents(docs, lattice_lm.pieces_of(piece_model()), id_bucket(F.col("doc_id"), 10) != 0, F.col("lang"))
    return scored.select("doc_id", (~F.col("is_train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multi_index.nearest(vectors, F.col("vec_id") % 50 == 0)


#: Rules by host and path that are fixed for the registered query.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op3_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_host_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return host_text.extract_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = language_spans.learn(docs.where(~held_out))
    return language_spans.label_spans(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = ngram_join.join_documents(docs)
    return joined.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_frequency.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(id_bucket(F.col("doc_id"), 4) != 2)
    model = quality_neighbours.fit(docs, labels)
    return quality_neighbours.score_documents(docs, model).select(
        "doc_id",
        (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.scan_documents(docs, table(spark, sf_dir, "benchmark")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_documents(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.share_heads(turns), ("origin", "pos"), members=turns.select("conv").distinct())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    tampered = [(F.col("n_chars").cast("decimal(20,0)") + 1) if c == "n_chars" else F.col(c) for c in docs.columns]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle_manifest.leaf_hash(tampered))
    built = merkle_manifest.manifest(docs, "doc_id", "lang", {"leaf": merkle_manifest.leaf_hash(fields), "changed": changed})
    return merkle_manifest.verify(built, "leaf", "changed").withColumnRenamed("key", "doc_id").drop("grp")


QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_multi_index": op2_multi_index,
    "op3_url_cascade": op3_url_cascade,
    "op4_host_text": op4_host_text,
    "op5_language": op5_language,
    "op6_ngram_join": op6_ngram_join,
    "op7_line_dedup": op7_line_dedup,
    "op9_quality": op9_quality,
    "op8_decontaminate": op8_decontaminate,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_license_scan": op11_license_scan,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_cascade": url_cascade.oracle_sql(URL_RULES),
    "op6_ngram_join": ngram_join.oracle_sql(),
    "op7_line_dedup": line_frequency.oracle_sql(),
    "op8_decontaminate": decontaminate.oracle_sql(),
    "op12_prefix_trie": prefix_trie.oracle_sql(),
    "op13_merkle_manifest": merkle_manifest.oracle_sql(),
}
