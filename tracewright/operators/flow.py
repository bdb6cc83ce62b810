"""Screen flow: which screens lead where, by actions and by the journey."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.gaps import Tables


def nodes(t: Tables) -> DataFrame:
    """``run_id, id, label, order, n_fields, n_actions``: screens in the order in which the journey reached them, those
    never visited after, in list order."""
    by_step = F.struct("order", "pos")
    visit = t["journey"].groupBy("run_id", F.col("screen_id").alias("id")).agg(F.min(by_step).alias("visit"))
    count = lambda name, n: t[name].groupBy("run_id", F.col("screen_id").alias("id")).agg(F.count("*").alias(n))
    rows = t["screens"].select("run_id", "id", F.col("name").alias("label"), "pos").join(visit, ["run_id", "id"], "left")
    rows = rows.join(count("fields", "n_fields"), ["run_id", "id"], "left").join(count("actions", "n_actions"), ["run_id", "id"], "left")
    order = Window.partitionBy("run_id").orderBy(F.col("visit").isNull(), "visit", "pos")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select("run_id", "id", "label", F.row_number().over(order).alias("order"), zero("n_fields"), zero("n_actions"))


def steps(journey: DataFrame, by: tuple[str, ...] = ("run_id",), order: tuple[str, ...] = ("order", "pos"), place: str = "screen_id") -> DataFrame:
    """``by, from_id, to_id, pos``: consecutive steps to another place."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = journey.select(*by, F.col(place).alias("from_id"), F.lead(place).over(w).alias("to_id"), F.row_number().over(w).alias("pos"))
    return moved.where("to_id is not null and from_id <> to_id")


def edges(t: Tables) -> DataFrame:
    """``run_id, from_id, to_id, label, kind, pos``: actions that lead to a known screen, each once, and the journey's
    moves between known screens that no action makes in that direction. ``pos`` is their order on the page."""
    a = t["actions"].where("leads_to_screen_id <> ''").select("run_id", F.col("screen_id").alias("from_id"), F.col("leads_to_screen_id").alias("to_id"), F.trim("description").alias("label"), F.lit("action").alias("kind"), "pos")
    known = t["screens"].select("run_id", "id").distinct()

    def between(df: DataFrame) -> DataFrame:
        for c in ("from_id", "to_id"):
            df = df.join(known.withColumnRenamed("id", c), ["run_id", c], "left_semi")
        return df.where("from_id <> to_id")

    a = between(a)
    moved = between(steps(t["journey"])).join(a.select("run_id", "from_id", "to_id").distinct(), ["run_id", "from_id", "to_id"], "left_anti")
    rows = a.unionByName(moved.select("run_id", "from_id", "to_id", F.lit("").alias("label"), F.lit("journey").alias("kind"), "pos"))
    once = rows.groupBy("run_id", "from_id", "to_id", "label", "kind").agg(F.min("pos").alias("first"))
    number = nodes(t).select("run_id", "id", "order")
    for c in ("from_id", "to_id"):
        once = once.join(number.select("run_id", F.col("id").alias(c), F.col("order").alias(f"_{c}")), ["run_id", c])
    order = Window.partitionBy("run_id").orderBy("_from_id", F.col("kind") != "action", "_to_id", "first")
    return once.select("run_id", "from_id", "to_id", "label", "kind", (F.row_number().over(order) - 1).alias("pos"))


def layout(nodes_: DataFrame, width: int = 180, height: int = 56, gap_x: int = 60, gap_y: int = 24, per_row: int = 5, one_row: int = 6) -> DataFrame:
    """``nodes`` with ``x, y``: one row up to ``one_row`` screens, else rows of ``per_row`` that run to and fro."""
    n = F.count("*").over(Window.partitionBy("run_id"))
    i, size = F.col("order") - 1, F.when(n <= one_row, one_row).otherwise(per_row)
    row, at = F.floor(i / size), i % size
    col = F.when(row % 2 == 0, at).otherwise(size - 1 - at)
    return nodes_.withColumn("x", (col * (width + gap_x)).cast("int")).withColumn("y", (row * (height + gap_y)).cast("int"))
