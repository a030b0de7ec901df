"""The operators' registered queries: name -> function, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphmill.llm import bpe, decontam, langid, licences, maxscore, merkle, minhash, periodic, secrets, simhash, token_files, urlfilter, warc

#: The public vocabulary file of these queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


#: The vocabulary's end of text, which fits two bytes.
SEPARATOR = 50256


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.document_tokens(table(spark, sf_dir, "documents"), VOCABULARY, SEPARATOR)


RULES = [
    urlfilter.Rule.parse("allow", "org/"),
    urlfilter.Rule.parse("block", "example.org/es/"),
    urlfilter.Rule.parse("block", "example.org/en/1"),
    urlfilter.Rule.parse("allow", "com/fr/"),
    urlfilter.Rule.parse("block", "com/de/"),
]


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.top_k(vectors, vectors.where("id % 50 = 0"), 5)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.digest(secrets.scan(docs, secrets.fit(docs)))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.Manifest(table(spark, sf_dir, "documents")).audit()


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find_runs(table(spark, sf_dir, "documents"), planted=True))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_langid": op4_langid,
    "op5_token_counts": op5_token_counts,
    "op6_urlfilter": op6_urlfilter,
    "op7_minhash": op7_minhash,
    "op8_licences": op8_licences,
    "op9_maxscore": op9_maxscore,
    "op10_secrets": op10_secrets,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_runs": op13_runs,
}
ORACLE_SQL: dict[str, str] = {
    "op12_merkle": merkle.audit_sql(),
    "op9_maxscore": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
