"""What reading a recording would cost: tokens and money per run and price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import image_tokens, mmss, text_tokens
from tracewright.operators.chunks import FRAMES_PER_CALL, ocr_text

# Tokens of a chunk's header, of a reading, of both kinds of reply, the share of the price for text read
# from the cache and for text written to it, the size taken for frames without one, and the transcript length from
# which merging takes two calls.
HEADER, READING, CHUNK_REPLY, MERGE_REPLY, CACHED_SHARE, CACHING_SHARE = 120, 1200, 1500, 4000, 0.10, 1.25
WIDTH, HEIGHT, LONG_TRANSCRIPT = 1280, 720, 150_000


def tokens(moments: DataFrame, transcripts: DataFrame, read_prompt: int, merge_prompt: int, size: int = FRAMES_PER_CALL) -> DataFrame:
    """Per run: calls, images and tokens. Moments are ``(run_id, start, text, width, height, crop_width, crop_height,
    ocr)``; transcripts ``(run_id, transcript)``. The first call pays for the prompt, later ones take it from the cache."""
    place = F.floor((F.row_number().over(Window.partitionBy("run_id").orderBy("start")) - 1) / size)
    has_size = (F.col("width") > 0) & (F.col("height") > 0)
    crop = F.coalesce(F.col("crop_width") > 0, F.lit(False))
    words = F.when(F.coalesce("text", F.lit("")) == "", "(nothing said)").otherwise(F.col("text"))
    ocr = F.when(F.trim("ocr") != "", text_tokens(ocr_text(F.col("ocr"))) + 12).otherwise(0)
    frame = moments.withColumn("chunk", place).select(
        "run_id", "chunk", crop.cast("int").alias("crops"), (~F.coalesce(has_size, F.lit(False))).cast("int").alias("assumed"),
        (F.when(has_size, image_tokens(F.col("width"), F.col("height"))).otherwise(image_tokens(F.lit(WIDTH), F.lit(HEIGHT))) + F.when(crop, image_tokens(F.col("crop_width"), F.col("crop_height"))).otherwise(0)).alias("image"),
        (text_tokens(words) + 12 + F.when(crop, 30).otherwise(0) + ocr).alias("text"),
    )
    chunk = frame.groupBy("run_id", "chunk").agg(F.count("*").alias("frames"), F.sum("crops").alias("crops"), F.sum("assumed").alias("assumed"), F.sum("image").alias("image"), F.sum("text").alias("text"))
    run = chunk.groupBy("run_id").agg(
        F.count("*").alias("chunks"), F.sum(F.col("frames") + F.col("crops")).alias("images"), F.sum("assumed").alias("assumed_sizes"), F.sum("image").alias("image_tokens"),
        F.sum(F.col("text") + HEADER + F.when(F.col("chunk") == 0, read_prompt).otherwise(0)).alias("text_tokens"),
        F.sum(F.when(F.col("chunk") > 0, read_prompt).otherwise(0)).alias("cached_tokens"),
    )
    run = run.join(transcripts.select("run_id", "transcript"), "run_id", "left").withColumn("transcript", F.coalesce("transcript", F.lit("(no transcript)")))
    merges = F.when(F.length("transcript") <= LONG_TRANSCRIPT, 1).otherwise(2)
    one = text_tokens(F.col("transcript")) + READING * F.col("chunks") + 60
    return run.select(
        "run_id", (F.col("chunks") + merges).alias("calls"), "images", "assumed_sizes", "image_tokens", (F.col("text_tokens") + merges * one + merge_prompt).alias("text_tokens"),
        (F.col("cached_tokens") + (merges - 1) * merge_prompt).alias("cached_tokens"), (CHUNK_REPLY * F.col("chunks") + MERGE_REPLY * merges).alias("output_tokens"),
    )


def priced(estimates: DataFrame, prices: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """A row for each run and price: ``prices`` is ``(model, input, output)`` in money per million tokens, a short list."""
    out = estimates.crossJoin(prices)  # prices are some rows; Spark broadcasts them by their size
    read = ((F.col("image_tokens") + F.col("text_tokens")) * F.col("input") + F.col("cached_tokens") * F.col("input") * CACHED_SHARE) / 1_000_000
    out = out.withColumn("input_cost", read).withColumn("output_cost", F.col("output_tokens") * F.col("output") / 1_000_000)
    out = out.withColumn("total_cost", F.col("input_cost") + F.col("output_cost")).drop("input", "output")
    if durations is not None:
        out = out.join(durations.select("run_id", "duration"), "run_id", "left")
        out = out.withColumn("cost_per_hour", F.when(F.col("duration") > 0, F.col("total_cost") / (F.col("duration") / 3600)))
    return out


def usage_cents(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` (``model``, counters) with ``cents``; null where the price isn't known. Counters that are null or aren't
    there count as none. ``prices`` is a short list."""
    out = usage.join(prices, "model", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in usage.columns else F.lit(0)
    read = n("input_tokens") + n("cache_read_input_tokens") * CACHED_SHARE + n("cache_creation_input_tokens") * CACHING_SHARE
    spent = read * F.col("input") + n("output_tokens") * F.col("output")
    return out.withColumn("cents", spent / 1_000_000 * 100).drop("input", "output")


# How amounts are written, and the sentences of the reports.
def short(tokens: Column) -> Column:
    """850 as it is, 1.2k, 118k."""
    thousands = tokens / 1000
    many = F.concat(F.bround(thousands).cast("bigint").cast("string"), F.lit("k"))
    return F.when(tokens >= 10_000, many).when(tokens >= 1_000, F.format_string("%.1fk", F.bround(thousands, 1))).otherwise(tokens.cast("string"))


def money(amount: Column) -> Column:
    return F.when(amount >= 0.10, F.format_string("$%.2f", F.bround(amount, 2))).otherwise(F.format_string("$%.3f", F.bround(amount, 3)))


ROUGH = "Estimates are rough; the real usage is printed after the run. Prices checked on "


def estimate_report(priced_rows: DataFrame, checked_on: str) -> DataFrame:
    """``run_id, model, report``: what a run would cost at a price, in lines of text. With ``duration`` and
    ``cost_per_hour``, what an hour would."""
    about = lambda c: F.concat(F.lit("\u2248 "), short(F.col(c)), F.lit(" tokens"))
    head = F.concat(
        F.lit("Estimated cost on "), "model", F.lit(": "), money(F.col("total_cost")), F.lit(" ("), F.col("calls").cast("string"), F.lit(" model calls; "), F.col("images").cast("string"), F.lit(" images "),
        about("image_tokens"), F.lit(", text "), about("text_tokens"), F.lit(", cached "), about("cached_tokens"), F.lit(", output "), about("output_tokens"), F.lit(")."),
    )
    hour = F.lit(None).cast("string")
    if "cost_per_hour" in priced_rows.columns:
        hour = F.concat(F.lit("That is about "), money(F.col("cost_per_hour")), F.lit(" per hour of recording (this one is "), mmss(F.col("duration")), F.lit(" long)."))
    return priced_rows.select("run_id", "model", F.concat_ws("\n", head, hour, F.lit(f"{ROUGH}{checked_on}.")).alias("report"))


def price_comparison(priced_rows: DataFrame, checked_on: str) -> DataFrame:
    """``run_id, report``: the counts once, then a line for each price, the cheapest first."""
    w = Window.partitionBy("run_id")
    width = F.max(F.length("model")).over(w)
    hour = F.when(F.col("cost_per_hour").isNotNull(), F.concat(F.lit("  ("), money(F.col("cost_per_hour")), F.lit(" per hour of recording)"))).otherwise("") if "cost_per_hour" in priced_rows.columns else F.lit("")
    line = F.concat(F.lit("  "), F.rpad("model", width, " "), F.lit("  "), F.lpad(money(F.col("total_cost")), 8, " "), hour)
    about = lambda c: F.concat(F.lit("\u2248 "), short(F.col(c)), F.lit(" tokens"))
    head = F.concat(
        F.lit("Estimated cost of the same run on each model ("), F.col("calls").cast("string"), F.lit(" model calls; "), F.col("images").cast("string"), F.lit(" images "),
        about("image_tokens"), F.lit(", text "), about("text_tokens"), F.lit(", output "), about("output_tokens"), F.lit("):"),
    )
    rows = priced_rows.select("run_id", "total_cost", "model", line.alias("line"), head.alias("head"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("total_cost", "model", "line"))), lambda x: x.line)
    per = rows.groupBy("run_id").agg(F.min("head").alias("head"), lines.alias("lines"))
    return per.select("run_id", F.concat_ws("\n", "head", F.array_join("lines", "\n"), F.lit(f"{ROUGH}{checked_on}.")).alias("report"))
