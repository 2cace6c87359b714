"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, decontaminate, packing, perplexity, repair, runs, simhash, spotsigs, suffixes, template, urlfilter, warc
from .common import held_out, table

#: (host, path, verdict) of the rules that op3 judges by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = template.main_text(table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", "\n\n")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), "found_by")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without repeated 100-byte strings."""
    found = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    records = warc.read(spark, warc.archive(table(spark, sf_dir, "pages")))
    response = F.col("warc_type") == "response"
    return records.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        "refers_to",
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    found = spotsigs.compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def spotsigs_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document's fingerprint, and its number of near ones, by the join that is pruned by set length and rare signatures."""
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from a model that never saw the held-out ones."""
    docs = table(spark, sf_dir, "documents")
    found = classify.predict_language(docs.select("doc_id", "text"), classify.train_language(docs), reject_below=0.0)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, from a model that never saw the held-out ones' labels."""
    docs = table(spark, sf_dir, "documents")
    model = classify.train_quality(docs, table(spark, sf_dir, "labels"))
    scored = classify.score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= classify.QUALITY_CUT).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    pieces = packing.with_checksums(packing.pack(table(spark, sf_dir, "documents"), tokenizer_definition()))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document's words, a tenth of the documents having a periodic end put in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", runs.with_periods(F.col("text"), F.col("doc_id")).alias("text"))
    longest = runs.longest(F.col("runs"))
    found = runs.periodic_runs(docs).select("doc_id", "runs", "collapsed", longest.alias("run"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("run.start").alias("start"),
        (-F.col("run.l")).alias("length"),
        F.col("run.period").alias("period"),
        F.floor(-1000 * F.col("run.l") / F.col("run.period")).cast("long").alias("exponent_milli"),
        runs.digest_of(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether the rules and its perplexity let it stay."""
    found = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    stats = [f.name for f in perplexity.STATS]
    return found.select("doc_id", *stats, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity"), "lower", "upper")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged before."""
    turns, copies = repair.damaged(table(spark, sf_dir, "conversations"))
    found = repair.audits(turns, copies)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def tokenizer_definition(path: str | None = None) -> str:
    """The text of a tokenizers file, read on the driver; by default the public one of 49,408 ids."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_fingerprints": op6_fingerprints,
    "spotsigs_near_classes": spotsigs_near_classes,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_rules": op12_quality_rules,
    "op13_conversation_repair": op13_conversation_repair,
}
