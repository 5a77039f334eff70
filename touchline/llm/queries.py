"""Registered queries of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import assignments, chat, jaccard, language, main_text, order_minhash, packing, periodic, ranked, substring, toxicity, warc, winnow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: vocabulary file of the packing query
VOCABULARY = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("op1_ngram_jaccard_join")
def op1(spark, d):
    return jaccard.jaccard_components(table(spark, d, "documents"))


@query("op2_substring_dedup")
def op2(spark, d):
    out = substring.deduplicated(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op3_warc_archive")
def op3(spark, d):
    return warc.parsed(warc.Archive(spark).write(table(spark, d, "pages")).read())


@query("op4_chat_formatting")
def op4(spark, d):
    said = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -7L AS conv_id, col1 AS turn, col2 AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant')")
    chats = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.formatted(chats).withColumn("turns", chat.parsed(F.col("formatted"))).withColumn("learned", chat.learned())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
                      F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op5_html_extraction")
def op5(spark, d):
    return main_text.extract(table(spark, d, "pages"), ["page_id", "url"])


@query("op6_toxicity")
def op6(spark, d):
    held = language.held_out(F.col("doc_id"))
    out = toxicity.score(table(spark, d, "documents"), table(spark, d, "labels").filter(~held))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op7_benchmark_decontamination")
def op7(spark, d):
    out = winnow.decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), winnow.contaminated().alias("contaminated"))


@query("op8_order_minhash")
def op8(spark, d):
    out = order_minhash.fingerprints(table(spark, d, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op9_packing")
def op9(spark, d):
    docs = table(spark, d, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path(VOCABULARY)))


@query("op10_language_id")
def op10(spark, d):
    docs = table(spark, d, "documents")
    train = docs.filter(~language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    model = language.fit(train, language.known_labels(train))
    return language.predict(docs, model, ["doc_id"]).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op11_ranked_search", ranked.ORACLE)
def op11(spark, d):
    return ranked.search(table(spark, d, "documents"), table(spark, d, "benchmark"))


def rewritten(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The query's texts: of ids whose crc32 leaves 0 modulo 10 the words from one on repeat; a null id leaves its text as it is."""
    pieces = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(p):
        n = F.size(p).cast("long")
        a = g % n
        period = 1 + F.floor((n - a) / (3 + g % 8))
        source = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(p, F.when(i < a, i).otherwise(a + (i - a) % period).cast("int")))
        return F.when(n > 0, F.array_join(source, " ")).otherwise(F.col(text))

    # the array is made once: a lambda over it binds it
    whole = F.get(F.transform(F.array(pieces), repeated), 0)
    return F.when(h % 10 == 0, whole).otherwise(F.col(text))


def _text(span, *names: str) -> Column:
    return F.concat_ws(",", *(span[n] for n in names))


@query("op12_periodic_runs")
def op12(spark, d):
    docs = table(spark, d, "documents").select("doc_id", rewritten().alias("text"))
    # greatest length, then smallest start and period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    out = periodic.periodic_runs(docs).withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_text(r, "start", "length", "period"), F.lit("\n"))), "")
    length = -F.col("best.less")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
                      F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_secret_scan")
def op13(spark, d):
    out = assignments.scan(table(spark, d, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return out.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
