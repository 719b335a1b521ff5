"""Recognised tokens: which are kept, what they say about a page, and which candidate reading wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import HIGH_CONFIDENCE, LAYOUT_PASSES, OCR_STRATEGIES, RETRY_DPI, RETRY_OSD, RETRY_THRESHOLD, SCORE_MIN_CONFIDENCE
from ..functions.text import similarity_ratio, strip

PAGE = ["doc_id", "page_number"]


def keep_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with a text and a confidence that is a number of 0 at least."""
    conf = F.col("confidence").try_cast("double")
    return tokens.withColumn("confidence", conf).where((strip(F.col("text")) != "") & (F.col("confidence") >= 0))


def page_confidence(pages: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per page: tokens, raw mean, mean of the confident ones, how many are not, and their share.
    Pages without tokens stay, with nulls."""
    high = F.col("confidence") >= HIGH_CONFIDENCE
    found = tokens.groupBy(*PAGE).agg(
        F.count("confidence").alias("total_tokens"), F.avg("confidence").alias("raw_avg_confidence"), F.avg(F.when(high, F.col("confidence"))).alias("avg_confidence"),
        F.count_if(~high).alias("low_conf_tokens"), F.sum(F.when(high, F.col("confidence"))).alias("high_sum"), F.count_if(high).alias("high_tokens"))
    out = pages.select(*PAGE).join(found, PAGE, "left").fillna(0, ["total_tokens", "low_conf_tokens", "high_tokens"])
    return out.withColumn("low_conf_ratio", F.try_divide(F.col("low_conf_tokens").cast("double"), F.col("total_tokens").cast("double")))


def page_confidence_in_place(pages: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``page_confidence`` of pages that carry their tokens in an array of (text, confidence), beside the
    pages' own columns: no token leaves its row, so nothing is shuffled."""
    named = F.filter(tokens, lambda t: strip(t["text"]) != "")
    usable = F.filter(F.transform(named, lambda t: t["confidence"].try_cast("double")), lambda c: c >= 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + c)
    df = pages.withColumn("_all", F.coalesce(usable, F.array().cast("array<double>"))).withColumn("_high", F.filter("_all", lambda c: c >= HIGH_CONFIDENCE))
    n, high = F.size("_all").cast("long"), F.size("_high").cast("long")
    df = df.withColumns({"total_tokens": n, "raw_avg_confidence": F.try_divide(total("_all"), n.cast("double")), "low_conf_tokens": n - high,
                         "high_sum": F.when(high > 0, total("_high")), "high_tokens": high}).drop("_all", "_high")
    return df.withColumns({"avg_confidence": F.try_divide(F.col("high_sum"), F.col("high_tokens").cast("double")),
                           "low_conf_ratio": F.try_divide(F.col("low_conf_tokens").cast("double"), F.col("total_tokens").cast("double"))})


def doc_stats(confidence: DataFrame) -> DataFrame:
    """Per document: tokens, and the mean of all its confident tokens pooled."""
    pooled = F.try_divide(F.sum("high_sum"), F.sum("high_tokens").cast("double"))
    return confidence.groupBy("doc_id").agg(F.sum("total_tokens").alias("total_tokens"), pooled.alias("avg_confidence"))


def candidate_scores(tokens: DataFrame) -> DataFrame:
    """Per candidate reading: the mean of its usable confidences (0 without any) and its tokens."""
    good = F.col("confidence") >= SCORE_MIN_CONFIDENCE
    return tokens.groupBy(*PAGE, "pass_id").agg(F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("score"), F.count("*").alias("n_tokens"))


def consensus(candidates: DataFrame) -> DataFrame:
    """Each candidate's mean similarity to the page's other candidates, itself the reference; 1 if it
    can't be compared. The few candidates of a page make the only pairs."""
    other = candidates.select(*PAGE, F.col("pass_id").alias("_o"), F.col("text").alias("_t"))
    pairs = candidates.join(other, PAGE).where("pass_id <> _o")
    means = pairs.withColumn("s", similarity_ratio(F.col("text"), F.col("_t"))).groupBy(*PAGE, "pass_id").agg(F.avg("s").alias("consensus"))
    return candidates.join(means, [*PAGE, "pass_id"], "left").withColumn("consensus", F.coalesce("consensus", F.lit(1.0)))


def best_candidate(scored: DataFrame, fix_empty: bool = False) -> DataFrame:
    """The candidate of the highest (consensus, score, tokens); the first pass wins ties. With
    ``fix_empty`` a candidate without text comes last instead of winning by its lack of evidence."""
    rank = [F.col("consensus"), F.col("score"), F.col("n_tokens"), -F.col("pass_id")]
    if fix_empty:
        rank.insert(0, (strip(F.col("text")) != "").cast("int"))
    best = F.max_by(F.struct("pass_id", "text", "consensus", "score", "n_tokens"), F.struct(*rank))
    return scored.groupBy(*PAGE).agg(best.alias("b")).select(*PAGE, "b.*")


def quality_retry(current: DataFrame, retries: DataFrame) -> DataFrame:
    """A page's retry replaces it if its score isn't lower; attempts count either way."""
    new = retries.select(*PAGE, F.col("text").alias("_text"), F.col("score").alias("_score"))
    better = F.col("_score").isNotNull() & (F.col("_score") >= F.col("score"))
    return (current.join(new, PAGE, "left")
            .withColumns({"text": F.when(better, F.col("_text")).otherwise(F.col("text")), "attempts": F.col("attempts") + F.col("_score").isNotNull().cast("int"),
                          "replaced": F.coalesce(better, F.lit(False)), "score": F.when(better, F.col("_score")).otherwise(F.col("score"))}).drop("_text", "_score"))


def progressive_retry(results: list[DataFrame]) -> DataFrame:
    """Results of passes over the same pages, first to last: a later text replaces an earlier one unless it is blank."""
    out = results[0]
    for later in results[1:]:
        new = later.select(*PAGE, F.col("text").alias("_text"))
        out = out.join(new, PAGE, "left").withColumn("text", F.when(strip(F.coalesce("_text", F.lit(""))) != "", F.col("_text")).otherwise(F.col("text"))).drop("_text")
    return out


def chunk_pages(pages: DataFrame, size: int) -> DataFrame:
    """Chunks of ``size`` pages of each document, in page order."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    return pages.withColumn("chunk", F.floor((order - 1) / size).cast("long"))


def polygon_box(polygon: Column) -> Column:
    """The bounding box of an array of points (x, y), in whole pixels."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (F.array_max(xs) - x).cast("int").alias("w"), (F.array_max(ys) - y).cast("int").alias("h"))


def recognition_passes(pages: DataFrame) -> DataFrame:
    """Every pass over a page: the page modes and strategies of its layout, strategies outermost."""
    rows = [(layout, s, psm) for layout, (modes, names) in LAYOUT_PASSES.items() for s in names for psm in modes]
    order: dict[str, int] = {}
    numbered = []
    for layout, s, psm in rows:
        numbered.append((layout, order.setdefault(layout, 0), s, psm, *OCR_STRATEGIES[s][:2]))
        order[layout] += 1
    table = pages.sparkSession.createDataFrame(numbered, "layout string, pass_id int, strategy string, psm int, threshold int, median_size int")
    return pages.join(F.broadcast(table), "layout")  # a fixed table


def retry_parameters(attempt: int) -> dict:
    """Resolution, threshold and rotation of a retry."""
    k = attempt % 2
    return {"name": f"retry-{attempt + 1}", "dpi": RETRY_DPI[k], "threshold": RETRY_THRESHOLD[k], "use_osd": RETRY_OSD[k], "median_size": 5, "unsharp": (2, 200, 3), "autocontrast_cutoff": 2}


def training_pairs(images: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with the text of the same stem, and the images that have none."""
    stem = lambda c: F.regexp_replace(F.substring_index(c, "/", -1), r"\.[^.]+$", "")
    i, t = images.withColumn("stem", stem("path")), texts.select(stem("path").alias("stem"), "text")
    return i.join(t, "stem"), i.join(t, "stem", "left_anti")
