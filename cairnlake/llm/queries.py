"""The registered queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm import ann, bpe_trie, chat, html_extract, langid, licenses, packing, periodic, piece_bpe, simhash, substring, turns, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_with_folds(_table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.digest_columns(substring.remove_repeats(docs))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digest_columns(bpe_trie.encode(_table(spark, sf_dir, "documents")))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edits(_table(spark, sf_dir, "documents")).drop("prints")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.digest_columns(piece_bpe.decode(piece_bpe.encode(_table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.audits(turns.repaired_parts(turns.damaged(_table(spark, sf_dir, "conversations")), copies_col="copies"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest_columns(periodic.find_runs(_table(spark, sf_dir, "documents"), edit=periodic.periodic_tails))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_ann": op2_ann,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_licenses": op6_licenses,
    "op7_chat_format": op7_chat_format,
    "op8_bpe": op8_bpe,
    "op9_winnowing": op9_winnowing,
    "op10_simhash": op10_simhash,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic": op13_periodic,
    "pipeline": pipeline,
}

SQL = {
    "op6_licenses": licenses.brute_force_sql(),
    "op4_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT doc_id, p, array_to_string(words[p:p + 34], ' ') AS seq
            FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35)
        ), r AS (
            SELECT s.doc_id, s.p FROM s JOIN (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1) USING (seq)
        ), c AS (
            SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id
        ), k AS (
            SELECT doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (doc_id)
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
               sha256(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i]), ' ')) AS kept_sha256
        FROM k
    """,
}
