"""What changed between two analyses: equal items first, the likeliest rewordings next, the rest added or removed.

Items are ``(pair_id, kind, side, id, pos, text)`` with side ``a`` or ``b``.
"""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import frame_label, norm
from tracewright.operators.gaps import Tables

#: Least similarity of two items to be called one item reworded.
REWORDED = 0.5
KINDS = {"screen": ("screens", "name"), "field": ("fields", "label"), "action": ("actions", "description"), "requirement": ("requirements", "statement"), "question": ("questions", "question")}


def items(t: Tables, side: str, pair_id: str = "pair") -> DataFrame:
    out = None
    for kind, (name, text) in KINDS.items():
        own = kind != "screen"
        at = F.col("timestamp") if own else F.col("first_seen")
        frame = F.col("keyframe_index") if own else F.try_element_at("keyframe_indexes", F.lit(1))
        rows = t[name].select(F.lit(pair_id).alias("pair_id"), F.lit(kind).alias("kind"), F.lit(side).alias("side"), "id", "pos", F.col(text).alias("text"), frame_label(frame, at).alias("frame"))
        out = rows if out is None else out.union(rows)
    return out


def _last_of_id(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("pair_id", "kind", "side", "id")
    first = rows.withColumn("_first", F.min("pos").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("pos"))))
    return first.where("_n = 1").withColumn("pos", F.col("_first")).drop("_n", "_first")


def unmatched(rows: DataFrame) -> DataFrame:
    """Items without an equal on the other side: the n-th of a text here is paired with the n-th there, by counts, so
    a text of many rows is no larger a join than another."""
    keyed = rows.withColumn("_key", norm(F.col("text")))
    nth = F.row_number().over(Window.partitionBy("pair_id", "kind", "side", "_key").orderBy("pos"))
    counts = keyed.groupBy("pair_id", "kind", "_key").agg(F.count(F.when(F.col("side") == "a", 1)).alias("_a"), F.count(F.when(F.col("side") == "b", 1)).alias("_b"))
    joined = keyed.withColumn("_n", nth).join(counts, ["pair_id", "kind", "_key"])
    return joined.where(F.col("_n") > F.least("_a", "_b")).drop("_n", "_a", "_b")


def pairing(a: list[tuple[str, str]], b: list[tuple[str, str]], least: float = REWORDED) -> list[tuple[str, str]]:
    """The most similar pairs first, each item once; equals in the order of a, then of b."""
    ratios = []
    for i, (_, x) in enumerate(a):
        for j, (_, y) in enumerate(b):
            m = difflib.SequenceMatcher(None, x, y)
            if m.real_quick_ratio() >= least and m.quick_ratio() >= least and (r := m.ratio()) >= least:
                ratios.append((-r, i, j))
    free_a, free_b, out = set(range(len(a))), set(range(len(b))), []
    for _, i, j in sorted(ratios):
        if i in free_a and j in free_b:
            free_a.remove(i)
            free_b.remove(j)
            out.append((a[i][0], b[j][0]))
    return out


def compare(rows: DataFrame) -> DataFrame:
    """``pair_id, kind, change, id_a, text_a, frame_a, id_b, text_b, frame_b, pos``; change is added, removed or changed.

    Similarity is looked at for what is left after the equal items alone, within a pair of analyses and a kind."""
    rest = unmatched(_last_of_id(rows))

    def run(group):
        import pandas as pd

        group = group.sort_values("pos")
        side = {s: list(zip(g["id"], g["_key"], strict=True)) for s, g in group.groupby("side")}
        pairs = pairing(side.get("a", []), side.get("b", []))
        partner = dict(pairs)
        of = {(r.side, r.id): r for r in group.itertuples()}
        out = []
        for i, r in enumerate(of[("a", x)] for x, _ in pairs):
            q = of[("b", partner[r.id])]
            out.append(("changed", r.id, r.text, r.frame, q.id, q.text, q.frame, i))
        done = {("a", x) for x, _ in pairs} | {("b", y) for _, y in pairs}
        for (s, i), r in of.items():
            if (s, i) not in done:
                out.append(("removed", r.id, r.text, r.frame, None, None, None, r.pos) if s == "a" else ("added", None, None, None, r.id, r.text, r.frame, r.pos))
        df = pd.DataFrame(out, columns=["change", "id_a", "text_a", "frame_a", "id_b", "text_b", "frame_b", "pos"])
        df.insert(0, "kind", group["kind"].iloc[0])
        df.insert(0, "pair_id", group["pair_id"].iloc[0])
        return df

    schema = "pair_id string, kind string, change string, id_a string, text_a string, frame_a string, id_b string, text_b string, frame_b string, pos int"
    return rest.groupBy("pair_id", "kind").applyInPandas(run, schema)
