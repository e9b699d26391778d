"""The queries of this subpackage, by name, and their SQL where SQL can express them.

Each query is a thin wrapper: it reads its whole tables, calls its operator
with production parameters and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coastline.llm import decontaminate, fingerprints, html_extract, langid, licenses, lines, minhash, mixing, oracles, periods, pii, suffixes, tokens, trie
from coastline.llm.common import WORD, cut

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("partner").alias("partner_id"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), with_text=False)
    return out.select(
        "doc_id", F.col("decon_words").alias("n_words"), F.col("decon_hits").alias("n_hit"), F.col("decon_n_items").alias("n_items"),
        F.sha2(F.array_join("decon_items", ","), 256).alias("items_sha256"), (F.col("decon_hits") > 0).alias("contaminated"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kind("pii_base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.written(F.col("pii_base")), 256).alias("base_sha256"), pii.written(F.col("pii_all")).alias("spans"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.fingerprints(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.text_of(own).alias("fingerprint"), fingerprints.text_of(edited).alias("edited_fingerprint"),
        fingerprints.likeness(own, edited).alias("near_edited"), fingerprints.likeness(own, following).alias("near_next"),
        fingerprints.containment(edited, own).alias("held_edited"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    parser = langid.learn(docs.where(~F.coalesce(held_out(), F.lit(True))))
    out = langid.identify(docs.select("doc_id", "text"), parser, with_text=False)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("license_ids").cast("long").alias("n_sentences"), F.array_join("licenses", ",").alias("licenses"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(trie.steps(_table(spark, sf_dir, "conversations")))
    ids = cut(rows.select("conv").distinct())
    return trie.trie(trie.rebuilt(rows, ids, 100, F.crc32(F.col("conv").cast("string")) % 6, 5), ids).drop("prefix")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_frequent_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_n").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2("lines_text", 256).alias("kept_sha256"))


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by the checksum of its id, repeats its words from some word on with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    cutting = docs.select("doc_id", "text", h.alias("h"), words.alias("words")).withColumns({"a": a, "p": p})
    changed = F.array_join(F.transform("words", lambda _, i: F.get("words", source(i))), " ")
    return cutting.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeating(_table(spark, sf_dir, "documents"))
    out = periods.find_runs(docs, with_text=False)
    runs = F.col("period_runs")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("top", F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("least"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0)))
    length = -F.col("top.least")
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("-1000 * top.least div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("period_text", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_minhash_dedup, op3_token_counts, op4_pii, op5_suffix_dedup, op6_decontamination, op7_fingerprints, op8_html_extraction, op9_language_id, op10_license_scan, op11_prefix_trie, op12_line_dedup, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
