"""The registered queries of this subpackage: thin digests of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read_table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wu_manber import contamination_verdict, find_contamination

    found = contamination_verdict(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_keys", ","), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated"), "cover")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rule_ensemble import score_quality

    held = crc_mod("doc_id", 3) == 1
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .recurrent_lm import score_documents

    held = crc_mod("doc_id", 7) == 2
    out = score_documents(read_table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import encode_documents

    out = encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.coalesce(F.element_at("ends", -1), F.lit(0)).alias("n_source_bytes"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    docs = read_table(spark, sf_dir, "documents")
    # documents are files of their source, a directory a language and a hundred numbers
    path = F.concat_ws("/", "source", "lang", (F.col("doc_id") / 100).cast("long").cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(docs.withColumn("path", path), all_words=True).withColumn("cosine", F.round("cosine", 6))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .risk_rules import apply_rules

    out = apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_repair import repair_conversations

    out = repair_conversations(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "position", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), F.array_join("closing", ",").alias("closing"), "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    out = jaccard_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_languages, learn_dictionaries

    docs = read_table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 4) == 2
    found = identify_languages(docs, learn_dictionaries(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wordpiece_counts import count_tokens, piece_vocabulary

    return count_tokens(read_table(spark, sf_dir, "documents"), piece_vocabulary(tokenizer_path()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality_classifier, op3_lm_scores, op4_sentencepiece, op5_license_scan, op6_quality_rules, op7_chat_repair, op8_jaccard_join, op9_language_id, op10_token_counts)}


_LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_OP1 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
i AS (SELECT row_number() OVER () iid, coalesce(CAST(item_id AS VARCHAR),'') k, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL) t),
iw AS (SELECT DISTINCT iid, k, least(len(w),8) n, array_to_string(w[p:p+least(len(w),8)-1],' ') g FROM (SELECT iid, k, w, unnest(range(1, greatest(len(w)-7,1)+1)) p FROM i WHERE len(w)>0) t),
sizes AS (SELECT iid, count(*) windows FROM iw GROUP BY iid),
dw AS (SELECT rid, p, n, array_to_string(w[p:p+n-1],' ') g FROM (SELECT rid, w, n, unnest(range(1, len(w)-n+2)) p FROM d, (SELECT DISTINCT n FROM iw) lens WHERE len(w)>=n) t),
h AS (SELECT rid, p, n, iid, k, g FROM dw JOIN iw USING (n, g)),
hits AS (SELECT rid, count(DISTINCT q) n_hit FROM (SELECT rid, unnest(range(p, p+n)) q FROM (SELECT DISTINCT rid, p, n FROM h) t) t GROUP BY rid),
cov AS (SELECT rid, max(CAST(c AS DOUBLE)/windows) cover FROM (SELECT rid, iid, count(DISTINCT g) c FROM h GROUP BY rid, iid) t JOIN sizes USING (iid) GROUP BY rid),
ks AS (SELECT rid, count(*) n_items, string_agg(k, ',' ORDER BY k) ks FROM (SELECT DISTINCT rid, k FROM h) t GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit,0) AS BIGINT) n_hit, CAST(coalesce(n_items,0) AS BIGINT) n_items, sha256(coalesce(ks,'')) items_sha256, coalesce(n_items,0)>=2 contaminated, CAST(coalesce(cover,0) AS DOUBLE) cover
FROM d LEFT JOIN hits USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN ks USING (rid)"""
_OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT rid, list_sort(list(DISTINCT array_to_string(w[p:p+3],' '))) s FROM (SELECT rid, w, unnest(range(1, greatest(len(w)-3,1)+1)) p FROM d WHERE len(w)>0) t GROUP BY rid),
cls AS (SELECT s, min(doc_id) least_id, row_number() OVER () cid FROM s JOIN d USING (rid) GROUP BY s),
e AS (SELECT cid, len(s) n, unnest(s) h FROM cls),
links AS (SELECT a.cid a, b.cid b FROM e a JOIN e b ON a.h=b.h AND a.cid<b.cid WHERE 100*least(a.n,b.n)>=85*greatest(a.n,b.n) GROUP BY a.cid, b.cid, a.n, b.n HAVING 100*count(*)>=85*(a.n+b.n-count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT cid a, cid b FROM cls UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b=both_ways.a),
comp AS (SELECT reach.a cid, min(least_id) component_id FROM reach JOIN cls ON cls.cid=reach.b GROUP BY reach.a)
SELECT doc_id, CAST(coalesce(len(s.s),0) AS BIGINT) n_shingles, coalesce(component_id, doc_id) component_id FROM d LEFT JOIN s USING (rid) LEFT JOIN cls ON cls.s=s.s LEFT JOIN comp USING (cid)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op8_jaccard_join": _OP8}
