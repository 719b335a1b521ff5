"""The quality gate: thresholds, the choice between native and recognised text, and the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..config import Gate
from ..functions.scripts import looks_sane
from ..functions.text import similarity_ratio, strip


def resolve_language(rows: DataFrame, language: str = "language", fallback: str = "ocr_lang") -> DataFrame:
    """Profile of a language or alias; unknown ones take the fallback's, then English. The profile
    table is fixed, so it is broadcast."""
    spark = rows.sparkSession
    names = {**{n: n for n in config.LANGUAGES}, **config.ALIASES}
    table = spark.createDataFrame([(a, n, *config.LANGUAGES[n]) for a, n in names.items()], "alias string, profile string, tesseract string, paddle string, sarvam string, preset string")
    plain = lambda c: F.lower(strip(F.col(c)))
    side = lambda tag: F.broadcast(table.select([F.col(c).alias(f"{tag}_{c}") for c in table.columns]))
    joined = rows.join(side("a"), plain(language) == F.col("a_alias"), "left").join(side("b"), plain(fallback) == F.col("b_alias"), "left")
    english = dict(zip(("profile", "tesseract", "paddle", "sarvam", "preset"), ("english", *config.LANGUAGES["english"])))
    known = F.when(F.col("a_alias").isNotNull(), "a").when(F.col("b_alias").isNotNull(), "b")
    pick = lambda c: F.when(known == "a", F.col(f"a_{c}")).when(known == "b", F.col(f"b_{c}")).otherwise(F.lit(english[c]))
    return joined.withColumns({c: pick(c) for c in english}).drop(*[f"{t}_{c}" for t in "ab" for c in table.columns])


def thresholds(layout: Column, gate: Gate) -> dict[str, Column]:
    """The gate's thresholds relaxed by layout; a null layout is text."""
    kind = F.coalesce(layout, F.lit("text"))

    def relaxed(at: int, base: float, ease) -> Column:
        out = F.lit(base)
        for name, values in config.LAYOUTS.items():
            if values[at] is not None:
                out = F.when(kind == name, F.lit(ease(base, values[at]))).otherwise(out)
        return out

    return {"max_low_conf_ratio": relaxed(0, gate.max_low_conf_ratio, max), "min_pass_similarity": relaxed(1, gate.min_pass_similarity, min),
            "min_native_similarity": relaxed(2, gate.min_native_similarity, min), "min_avg_confidence": relaxed(3, gate.min_avg_confidence, min)}


def needs_ocr(char_count: Column, force: Column) -> Column:
    return force | (char_count < config.NATIVE_MIN_CHARS)


def page_quality(pages: DataFrame, gate: Gate | None = None, engine: str = "tesseract", regional: bool = False, force_ocr: bool = False) -> DataFrame:
    """The verdict of every page, as one projection.

    ``pages``: doc_id, page_number, native_text, ocr_text (null: the page wasn't recognised),
    avg_confidence (of confident tokens), low_conf_ratio, pass_similarity, layout. Metrics without
    evidence are null, and null is not 0.
    """
    gate = gate or Gate()
    native, ocr = F.coalesce("native_text", F.lit("")), F.coalesce("ocr_text", F.lit(""))
    has_native, has_ocr = strip(native) != "", strip(ocr) != ""
    never_native = regional or force_ocr
    df = pages.withColumn("native_similarity", similarity_ratio(F.when((native != "") & (ocr != ""), native), F.when((native != "") & (ocr != ""), ocr)))
    accuracy = F.coalesce(F.col("native_similarity"), F.col("avg_confidence") / 100)
    trusts = F.coalesce(accuracy >= gate.decision_accuracy, F.lit(False))
    fallback = F.lit("ocr") if never_native else F.when(has_native, "native").otherwise("ocr")
    df = df.withColumns({"accuracy_score": accuracy, "_decision": F.when(trusts, "B").otherwise("A"), "_source": F.when(trusts, "ocr").otherwise(fallback)})
    t = thresholds(F.col("layout"), gate)
    sufficient = (F.length(strip(native)) >= config.NATIVE_MIN_CHARS) & looks_sane(native, F.lit(regional))
    failure = F.col("avg_confidence").isNull()
    low, sim = config.UNRELIABLE
    unreliable = F.coalesce((F.col("low_conf_ratio") > low) & (F.col("pass_similarity") < sim), F.lit(False))
    poor = failure | unreliable
    if never_native:
        kind = F.when(poor, "figure").otherwise("text")
    else:
        kind = (F.when((F.col("_source") == "native") & sufficient, "native_sufficient").when(poor & sufficient, "native_fallback")
                .when(poor, "figure").otherwise("text"))
    external = F.lit(engine == "sarvam") & has_ocr
    df = df.withColumn("page_type", F.when(external, "sarvam").otherwise(kind))
    df = df.withColumn("selected_source", F.when(F.col("page_type") == "sarvam", "ocr").when(F.col("page_type") == "native_fallback", "native").otherwise(F.col("_source")))
    df = df.withColumn("decision", F.when(F.col("page_type") == "sarvam", "B").when(F.col("page_type") == "native_fallback", "A").otherwise(F.col("_decision")))
    below = lambda c, least: F.coalesce(F.col(c) < least, F.lit(True))
    native_gate = F.lit(not never_native) & F.coalesce((t["min_native_similarity"] > 0) & (F.col("native_similarity") < t["min_native_similarity"]), F.lit(False))
    if gate.skip_native_gate:
        native_gate = native_gate & (F.col("selected_source") != "native")
    gates = {"avg_confidence": below("avg_confidence", t["min_avg_confidence"]), "low_conf_ratio": F.coalesce(F.col("low_conf_ratio") > t["max_low_conf_ratio"], F.lit(True)),
             "dual_pass_similarity": below("pass_similarity", t["min_pass_similarity"]), "native_similarity": native_gate}
    failed = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in gates.items()]), lambda g: g.isNotNull())
    df = df.withColumn("failed_gates", F.when(F.col("page_type") == "text", failed).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("status", F.when(F.size("failed_gates") == 0, "approved").otherwise("needs_review"))
    hide = lambda c: F.when(F.col("page_type") != "sarvam", F.col(c)).alias(c)
    return df.select("doc_id", "page_number", "status", "layout", "page_type", hide("avg_confidence"), hide("low_conf_ratio"), hide("pass_similarity"), "native_similarity",
                     "failed_gates", hide("accuracy_score"), "decision", "selected_source", "native_text", "ocr_text")


def doc_status(quality: DataFrame) -> DataFrame:
    """A document is approved if all its pages are."""
    good = F.col("status") == "approved"
    return quality.groupBy("doc_id").agg(F.count("*").alias("pages_total"), F.count_if(good).alias("approved_count"), F.count_if(~good).alias("needs_review_count"),
                                         F.when(F.every(good), "approved").otherwise("needs_review").alias("status"))


def assemble_pages(quality: DataFrame) -> DataFrame:
    """Each page's text and source. Recognised text counts where it was chosen, or where there is no native text."""
    chosen = (F.col("selected_source") == "ocr") & F.col("ocr_text").isNotNull()
    return quality.select("doc_id", "page_number", F.when(chosen, "ocr").otherwise("native").alias("source"),
                          F.when(chosen, F.col("ocr_text")).otherwise(F.coalesce("native_text", F.lit(""))).alias("text"))


def assemble_documents(pages: DataFrame, native_engine: str = "pymupdf", ocr_engine: str = "tesseract", force_ocr: bool = False) -> DataFrame:
    """Method, engine and full text of each document; without any text an error. A document's pages
    are joined in page order."""
    parts = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("page_number", "text"))))
    any_ocr, any_native = F.max((F.col("source") == "ocr").cast("int")) == 1, F.max((F.col("source") == "native").cast("int")) == 1
    out = pages.groupBy("doc_id").agg(F.count("*").alias("pages_total"), strip(F.array_join(F.transform(parts, lambda p: p["text"]), "\n")).alias("full_text"),
                                      any_ocr.alias("_ocr"), any_native.alias("_native"))
    method = F.when(F.col("_ocr") & F.col("_native"), "hybrid").when(F.col("_ocr"), "ocr").otherwise("native")
    engine = (F.when(method == "native", native_engine).when((method == "ocr") & F.lit(force_ocr), ocr_engine).otherwise(f"{native_engine}+{ocr_engine}"))
    return out.withColumns({"method": method, "engine": engine, "error": F.when(F.col("full_text") == "", "EmptyContentError")}).drop("_ocr", "_native")


def guard_max_pages(documents: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Documents of at most ``most`` pages, and the error rows of the others."""
    over = F.col("pages_total") > most
    return documents.where(~over), documents.where(over).select("doc_id", "pages_total", F.lit("MaxPagesExceededError").alias("error"))


def gate_table(spark: SparkSession) -> DataFrame:
    """All merged thresholds: strict and target 90, default and regional preset, by layout."""
    rows = [(str(t), p, lay) for t in (None, 90) for p in config.PRESETS for lay in (None, *config.LAYOUTS)]
    out = None
    for target in (None, 90):
        for preset in config.PRESETS:
            part = spark.createDataFrame([(t, p, lay) for t, p, lay in rows if t == str(target) and p == preset], "target string, preset string, layout string")
            part = part.withColumns(thresholds(F.col("layout"), config.gate(target, preset)))
            out = part if out is None else out.unionByName(part)
    return out
