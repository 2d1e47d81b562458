"""The registered queries opN_<name> of this subpackage, and their SQL where SQL can state them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .common import spread, table
from .decontamination import find_leaks
from .exact_dedup import exact_dedup
from .html_text import extract_text
from .language import identify_language, train_language, train_rows
from .line_dedup import line_dedup
from .pieces import encode_pieces
from .pitman_yor import score_texts
from .quality import score_quality, train_quality
from .runs import find_runs, repeat_tails
from .simhash import simhash_components
from .substring_dedup import substring_dedup
from .whitening import whiten_embeddings

#: A public SentencePiece model; the operators take the path as a parameter.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = train_language(train_rows(docs))
    found = identify_language(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), PIECE_MODEL).select("doc_id", "n_tokens", "round_trip", "ids")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    known = table(spark, sf_dir, "labels").filter(fold != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    model = train_quality(docs.filter(fold != 0).select(F.col("doc_id").alias("id"), "text"), known)
    score = F.col("quality_score")
    return score_quality(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("held_out", held_out)
    return score_texts(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten_embeddings(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "both"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "both.whitened", "both.explained", "identity_error")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(repeat_tails(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    # runs come by start, then period, so the first of the greatest exponent is the one wanted
    best = F.expr("aggregate(slice(runs, 2, size(runs)), get(runs, 0), (a, b) -> if(b.length * a.period > a.length * b.period, b, a))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_benchmark_decontamination, op3_chat_formatting, op4_exact_dedup, op5_substring_dedup, op6_language_id, op7_line_dedup, op8_html_extraction, op9_sentencepiece, op10_quality_classifier, op11_lm_scoring, op12_embedding_whitening, op13_periodic_runs)}

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op3_chat_formatting": """
        WITH t AS (
            SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
                   string_agg(coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') || chr(2), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix,
                   string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '') OVER (w ROWS UNBOUNDED PRECEDING) AS rendered
            FROM conversations
            WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
        ),
        whole AS (SELECT min(conv_id) AS conv_id, place, prefix, any_value(rendered) AS rendered FROM t WHERE place = turns GROUP BY place, prefix)
        SELECT conv_id, place AS n_turns, rendered FROM whole
        WHERE (place, prefix) NOT IN (SELECT (place, prefix) FROM t WHERE place < turns)
    """,
    "op4_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(translate(coalesce(text, ''), {_BLANKS}, '')) AS text_sha256 FROM documents
        ),
        g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op7_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
        ),
        k AS (SELECT doc_id, pos, line, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER}) AS key FROM l),
        g AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
        m AS (SELECT k.*, coalesce(k.doc_id <> g.first_id, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
}
