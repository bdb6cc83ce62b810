"""Scoring an analysis against an answer key, and traceability.

Answer key: ``(category, pos, groups, screen_groups)``; every group must be matched, ``a|b`` is a choice; fields may
also ask for a screen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import matches_all
from tracewright.operators.gaps import Tables, lookup_fallback

CATEGORIES = ("screens", "fields", "actions", "requirements", "questions")


def items(t: Tables) -> DataFrame:
    """``run_id, category, pos, text, screen``: what an answer key is held against."""
    both = lambda *c: F.concat_ws(" ", *(F.when(F.col(x) != "", F.col(x)) for x in c))
    none = F.lit(None).cast("string")
    f = lookup_fallback(t["fields"], t["screens"], "screen_id", "id", "name", "_screen")
    known = t["screens"].select("run_id", F.col("id").alias("screen_id")).distinct().withColumn("_known", F.lit(True))
    f = f.join(known, ["run_id", "screen_id"], "left").withColumn("_screen", F.when(F.col("_known"), F.col("_screen")).otherwise(""))
    parts = [
        t["screens"].select("run_id", F.lit("screens").alias("category"), "pos", F.col("name").alias("text"), none.alias("screen")),
        f.select("run_id", F.lit("fields"), "pos", "label", "_screen"),
        t["actions"].select("run_id", F.lit("actions"), "pos", "description", none),
        t["requirements"].select("run_id", F.lit("requirements"), "pos", both("statement", "rationale", "source_quote"), none),
        t["questions"].select("run_id", F.lit("questions"), "pos", both("question", "why_it_matters", "context_quote"), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def candidates(item_rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Pairs ``run_id, category, spec_pos, item_pos`` that match: within a category, by expressions alone."""
    e = expected.select("category", F.col("pos").alias("spec_pos"), "groups", "screen_groups")
    joined = item_rows.withColumnRenamed("pos", "item_pos").join(e, "category")
    screen = F.col("screen_groups").isNull() | (F.size("screen_groups") == 0) | matches_all(F.col("screen"), F.col("screen_groups"))
    return joined.where(matches_all(F.col("text"), F.col("groups")) & screen).select("run_id", "category", "spec_pos", "item_pos")


def assigned(pairs: DataFrame) -> DataFrame:
    """One to one: each expectation in turn takes the first item that is left. Only candidate pairs come together, by
    run and category."""

    def run(rows):
        rows = rows.sort_values(["spec_pos", "item_pos"])
        used, done, keep = set(), set(), []
        for spec, item in zip(rows["spec_pos"], rows["item_pos"], strict=True):
            take = spec not in done and item not in used
            keep.append(take)
            if take:
                used.add(item)
                done.add(spec)
        return rows[keep]

    return pairs.groupBy("run_id", "category").applyInPandas(run, pairs.schema)


def score(t: Tables, expected: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, category, expected, found, recall, extras``; recall is 0 where nothing is expected."""
    rows = items(t)
    hits = assigned(candidates(rows, expected)).groupBy("run_id", "category").agg(F.count("*").alias("found"))
    have = rows.groupBy("run_id", "category").agg(F.count("*").alias("have"))
    want = expected.groupBy("category").agg(F.count("*").alias("expected"))
    names = runs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    grid = runs.select("run_id").crossJoin(F.broadcast(names))  # five rows a run
    out = grid.join(want, "category", "left").join(have, ["run_id", "category"], "left").join(hits, ["run_id", "category"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = out.select("run_id", "category", zero("expected"), zero("found"), zero("have"))
    recall = F.coalesce(F.try_divide(F.col("found"), F.col("expected")), F.lit(0.0))
    return out.select("run_id", "category", "expected", "found", recall.alias("recall"), (F.col("have") - F.col("found")).alias("extras"))


def overall(scores: DataFrame) -> DataFrame:
    """The mean recall over categories of which something is expected; 0 without any."""
    mean = F.coalesce(F.avg(F.when(F.col("expected") > 0, F.col("recall"))), F.lit(0.0))
    return scores.groupBy("run_id").agg(mean.alias("overall_recall"))


def missed(t: Tables, expected: DataFrame, runs: DataFrame) -> DataFrame:
    """The expectations that nothing was found for."""
    hits = assigned(candidates(items(t), expected)).select("run_id", "category", F.col("spec_pos").alias("pos"))
    return runs.select("run_id").crossJoin(expected).join(hits, ["run_id", "category", "pos"], "left_anti")


def report(scores: DataFrame, missing: DataFrame, traces: DataFrame, writing: DataFrame) -> DataFrame:
    """``run_id, report``: a table of categories, what was missed, traceability and writing, as text. Out of ``score``,
    ``missed``, ``traceability`` and ``lint.writing_summary``; runs without rows in the last have no warnings."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    row = F.format_string("%-14s%10d%8d%8.2f%8d", "category", "expected", "found", F.bround("recall", 2), "extras")
    listed = lambda *key: F.transform(F.sort_array(F.collect_list(F.struct(*key, "line"))), lambda x: x.line)
    table = scores.withColumn("line", row).groupBy("run_id").agg(listed(rank.alias("r")).alias("rows"))
    spec = F.when(F.size("groups") == 1, F.col("groups")[0]).otherwise(F.concat(F.lit('["'), F.array_join("groups", '", "'), F.lit('"]')))
    gone = missing.withColumn("line", F.concat(F.lit("  "), "category", F.lit(": "), spec)).groupBy("run_id").agg(listed(rank.alias("r"), F.col("pos")).alias("gone"))
    out = table.join(gone, "run_id", "left").join(traces, "run_id", "left").join(writing, "run_id", "left").join(overall(scores), "run_id")
    n = lambda label, c: F.concat(F.lit(f"  {label}: "), F.coalesce(F.col(c), F.lit(0)).cast("string"))
    rules = F.when(F.size("rules_seen") > 0, F.array_join("rules_seen", ", ")).otherwise("(none)")
    text = F.concat_ws(
        "\n", F.format_string("%-14s%10s%8s%8s%8s", *map(F.lit, ("Category", "Expected", "Found", "Recall", "Extras"))), F.array_join("rows", "\n"),
        F.lit("Missed:"), F.coalesce(F.array_join("gone", "\n"), F.lit("  (none)")),
        F.lit("Traceability:"), n("requirements without source quote", "requirements_without_source_quote"), n("acceptance criteria with unknown requirement", "criteria_with_unknown_requirement"), n("negative keyframe indexes", "negative_keyframe_indexes"),
        F.lit("Writing:"), n("requirements with warnings", "requirements_with_warnings"), n("acceptance criteria with warnings", "criteria_with_warnings"), F.concat(F.lit("  rules seen: "), rules),
        F.format_string("Overall recall: %.2f", F.bround("overall_recall", 2)),
    )
    return out.select("run_id", text.alias("report"))


def traceability(t: Tables, runs: DataFrame) -> DataFrame:
    """Per run: requirements without a quote, criteria of unknown requirements, references to frames before the first."""
    r = t["requirements"].groupBy("run_id").agg(F.sum((F.trim(F.coalesce("source_quote", F.lit(""))) == "").cast("int")).alias("requirements_without_source_quote"))
    known = t["requirements"].select("run_id", F.col("id").alias("requirement_id")).distinct()
    c = t["criteria"].join(known, ["run_id", "requirement_id"], "left_anti").groupBy("run_id").agg(F.count("*").alias("criteria_with_unknown_requirement"))
    frames = t["screens"].select("run_id", F.explode("keyframe_indexes").alias("k"))
    for name in ("fields", "actions", "journey", "requirements", "criteria", "questions"):
        frames = frames.union(t[name].select("run_id", "keyframe_index"))
    n = frames.where("k < 0").groupBy("run_id").agg(F.count("*").alias("negative_keyframe_indexes"))
    out = runs.select("run_id").join(r, "run_id", "left").join(c, "run_id", "left").join(n, "run_id", "left")
    return out.select("run_id", *(F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in out.columns[1:]))
