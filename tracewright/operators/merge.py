"""Entity resolution across runs: offsets, prefixes, folding, numbering anew with references repaired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import norm
from tracewright.operators.gaps import Tables


def first_wins(rows: DataFrame, key: Sequence[Column | str], order: Sequence[Column | str], id_col: str = "id") -> DataFrame:
    """``rows`` with ``kept_id``, the id of the first row of the same key: rows that keep their own id are kept, the
    others are folded into it."""
    return rows.withColumn("kept_id", F.first(id_col).over(Window.partitionBy(*key).orderBy(*order)))


def fold(rows: DataFrame, key: Sequence[str], order: str, minimum: Sequence[str] = (), unions: Sequence[str] = ()) -> DataFrame:
    """A row per key: the first one's columns, the least of some, and the sorted union of array columns."""
    same = [c for c in rows.columns if c not in (*key, *minimum, *unions)]
    return rows.groupBy(*key).agg(
        *(F.min_by(c, order).alias(c) for c in same), *(F.min(c).alias(c) for c in minimum), *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in unions)
    )


def offsets(runs: DataFrame, sums: Sequence[str], order: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """``runs`` with ``<c>_offset``: the sum of ``c`` over the runs before. Runs are rows of a list that a person made,
    so one window over them is small; ``by`` splits independent lists."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("*", *(F.coalesce(F.sum(c).over(w), F.lit(0)).cast(runs.schema[c].dataType).alias(f"{c}_offset") for c in sums))


def prefix(position: Column) -> Column:
    """A-, B-, ... Z-, AA-, AB-, ..."""
    letter = lambda n: F.char((n + 65).cast("bigint"))
    return F.concat(F.when(position >= 26, letter(F.floor(position / 26) - 1)).otherwise(""), letter(position % 26), F.lit("-"))


REFERENCES = {
    "screens": (), "fields": ("screen_id",), "actions": ("screen_id", "leads_to_screen_id"), "journey": ("screen_id",), "requirements": ("screen_id",),
    "criteria": ("requirement_id",), "questions": ("screen_id",),
}


def rebase(t: Tables, runs: DataFrame, merged: str = "merged") -> Tables:
    """One run out of several: ``runs`` has ``run_id, position, frames, duration``. Ids get their run's prefix, frames
    and times move by what came before, and ``pos`` goes on from run to run."""
    at = offsets(runs, ["frames", "duration"]).select("run_id", "position", "frames_offset", "duration_offset", prefix(F.col("position")).alias("_p"))
    out = {}
    for name, rows in t.items():
        df = rows.join(at, "run_id")
        given = lambda c: F.when(F.col(c) != "", F.concat("_p", c))
        for c in ("id", *REFERENCES.get(name, ())):
            if c in rows.columns:
                df = df.withColumn(c, given(c))
        for c in ("field_ids", "action_ids", "blocks_requirement_ids"):
            if c in rows.columns:
                df = df.withColumn(c, F.transform(c, lambda x: F.concat("_p", x)))
        for c in ("timestamp", "first_seen"):
            if c in rows.columns:
                df = df.withColumn(c, F.col(c) + F.col("duration_offset"))
        if "keyframe_index" in rows.columns:
            df = df.withColumn("keyframe_index", (F.col("keyframe_index") + F.col("frames_offset")).cast("int"))
        if "keyframe_indexes" in rows.columns:
            df = df.withColumn("keyframe_indexes", F.transform("keyframe_indexes", lambda i: (i + F.col("frames_offset")).cast("int")))
        pos = F.row_number().over(Window.partitionBy(F.lit(merged)).orderBy("position", "pos")) - 1
        out[name] = df.withColumn("pos", pos).withColumn("run_id", F.lit(merged)).select(rows.columns)
    return out


def _repointed(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` by ``mapping`` (``run_id, old, new``), where it has an entry."""
    m = mapping.select("run_id", F.col("old").alias(column), "new")
    return rows.join(m, ["run_id", column], "left").withColumn(column, F.coalesce("new", column)).drop("new").select(rows.columns)


def _mapped_lists(rows: DataFrame, mapping: DataFrame, column: str, drop_unknown: bool = False, distinct: bool = False) -> DataFrame:
    """An array column by ``mapping``, in its order."""
    items = rows.select("run_id", "pos", F.posexplode(column).alias("_n", "old")).join(mapping.select("run_id", "old", "new"), ["run_id", "old"], "left")
    items = items.where("new is not null") if drop_unknown else items.withColumn("new", F.coalesce("new", "old"))
    item = F.transform(F.sort_array(F.collect_list(F.struct("_n", "new"))), lambda x: x.new)
    per = items.groupBy("run_id", "pos").agg((F.array_distinct(item) if distinct else item).alias("_list"))
    joined = rows.join(per, ["run_id", "pos"], "left")
    return joined.withColumn(column, F.coalesce("_list", F.array().cast("array<string>"))).select(rows.columns)


def fold_entities(t: Tables) -> Tables:
    """Screens of one name, fields of one screen and label, requirements of one statement, questions of one wording and
    actors of one name become the first of them; whatever pointed at the others points at it, before it is folded
    itself. Actions, journey and criteria stay as they are."""
    t = dict(t)

    def folded(name: str, key: list[Column]) -> tuple[DataFrame, DataFrame]:
        marked = first_wins(t[name], ["run_id", *key], ["pos"])
        mapping = marked.where("id <> kept_id").groupBy("run_id", F.col("id").alias("old")).agg(F.min("kept_id").alias("new"))
        first = F.row_number().over(Window.partitionBy("run_id", *key).orderBy("pos"))
        kept = t[name].withColumn("_n", first).where("_n = 1").drop("_n")
        return kept, mapping

    s = t["screens"].withColumn("_key", norm(F.col("name")))
    _, screen_map = folded("screens", [norm(F.col("name"))])
    lists = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", c))), lambda x: x[c]))).alias(c)
    t["screens"] = s.groupBy("run_id", "_key").agg(
        F.min("pos").alias("pos"), *(F.min_by(c, "pos").alias(c) for c in ("id", "name", "purpose")), F.min("first_seen").alias("first_seen"),
        F.when(F.count("*") > 1, F.array_sort(F.array_distinct(F.flatten(F.collect_list("keyframe_indexes"))))).otherwise(F.first("keyframe_indexes")).alias("keyframe_indexes"),
        lists("field_ids"), lists("action_ids"),
    ).select(t["screens"].columns)
    for name in ("fields", "actions", "journey", "requirements", "questions"):
        for c in REFERENCES[name]:
            t[name] = _repointed(t[name], screen_map, c)
    t["fields"], field_map = folded("fields", [F.col("screen_id"), norm(F.col("label"))])
    t["screens"] = _mapped_lists(t["screens"], field_map, "field_ids", distinct=True)
    t["requirements"], requirement_map = folded("requirements", [norm(F.col("statement"))])
    t["criteria"] = _repointed(t["criteria"], requirement_map, "requirement_id")
    t["questions"] = _mapped_lists(t["questions"], requirement_map, "blocks_requirement_ids")
    t["questions"], _ = folded("questions", [norm(F.col("question"))])
    first = F.row_number().over(Window.partitionBy("run_id", norm(F.col("actor"))).orderBy("pos"))
    t["actors"] = t["actors"].withColumn("_n", first).where("_n = 1").drop("_n")
    return t


#: Entity, letters in front, digits.
NUMBERS = {"screens": ("S", 2), "fields": ("F", 3), "actions": ("A", 3), "requirements": ("R", 3), "questions": ("Q", 3), "criteria": ("AC", 3)}


def new_ids(rows: DataFrame, letters: str, digits: int, by: Sequence[str] = ("run_id",), order: str = "pos") -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("new", F.concat(F.lit(letters), F.lpad(n.cast("string"), F.greatest(F.lit(digits), F.length(n.cast("string"))), F.lit("0"))))


def renumber(t: Tables) -> Tables:
    """Ids without gaps in list order, and every reference repaired: of an id that occurs twice the last number counts;
    an optional reference to nothing becomes null, a required one stays, criteria of no requirement go, and so do
    blocked requirements that don't exist. Lists of screens come from the fields and actions, journeys count from 1."""
    t, maps = dict(t), {}
    for name in ("screens", "fields", "actions", "requirements", "questions"):
        rows = new_ids(t[name], *NUMBERS[name])
        maps[name] = rows.groupBy("run_id", F.col("id").alias("old")).agg(F.max_by("new", "pos").alias("new"))
        t[name] = _repointed(t[name], maps[name], "id")
    for name in ("fields", "actions", "journey"):
        t[name] = _repointed(t[name], maps["screens"], "screen_id")
    for name, c in (("actions", "leads_to_screen_id"), ("requirements", "screen_id"), ("questions", "screen_id")):
        m = maps["screens"].select("run_id", F.col("old").alias(c), "new")
        t[name] = t[name].join(m, ["run_id", c], "left").withColumn(c, F.col("new")).select(t[name].columns)
    t["questions"] = _mapped_lists(t["questions"], maps["requirements"], "blocks_requirement_ids", drop_unknown=True)
    known = maps["requirements"].select("run_id", F.col("old").alias("requirement_id"), "new")
    c = t["criteria"].join(known, ["run_id", "requirement_id"]).withColumn("requirement_id", F.col("new")).select(t["criteria"].columns)
    t["criteria"] = new_ids(c, *NUMBERS["criteria"]).withColumn("id", F.col("new")).drop("new").select(t["criteria"].columns)
    for name, c in (("fields", "field_ids"), ("actions", "action_ids")):
        ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x.id).alias("_ids")
        per = t[name].groupBy("run_id", F.col("screen_id").alias("id")).agg(ids)
        t["screens"] = t["screens"].join(per, ["run_id", "id"], "left").withColumn(c, F.coalesce("_ids", F.array().cast("array<string>"))).select(t["screens"].columns)
    w = Window.partitionBy("run_id").orderBy("pos")
    t["journey"] = t["journey"].withColumn("order", F.row_number().over(w)).select(t["journey"].columns)
    return t


def merge(t: Tables, runs: DataFrame, merged: str = "merged") -> Tables:
    return renumber(fold_entities(rebase(t, runs, merged)))


def summed_usage(analyses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counters added up, the models named once each in the order of ``position``."""
    u = analyses.where("usage is not null").select(*by, "position", "usage.*")
    names = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("position", "model"))), lambda x: x.model)), " + ")
    counters = ("calls", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")
    return u.groupBy(*by).agg(names.alias("model"), *(F.sum(c).alias(c) for c in counters))


def merge_recordings(r: dict[str, DataFrame], runs: DataFrame, merged: str = "merged") -> dict[str, DataFrame]:
    """Key frames, segments and moments of several runs one after the other."""
    at = offsets(runs, ["frames", "duration"]).select("run_id", "position", "frames_offset", "duration_offset")
    out = {}
    order = Window.partitionBy(F.lit(merged)).orderBy("position", "pos")
    later = lambda c: F.col(c) + F.col("duration_offset")

    def moved(s: Column) -> Column:
        words = F.transform(s.words, lambda w: F.struct((w.start + F.col("duration_offset")).alias("start"), (w.end + F.col("duration_offset")).alias("end"), w.text.alias("text")))
        return F.struct((s.start + F.col("duration_offset")).alias("start"), (s.end + F.col("duration_offset")).alias("end"), s.text.alias("text"), s.speaker.alias("speaker"), words.alias("words"))

    for name, rows in r.items():
        if name == "runs":
            continue
        df = rows.join(at, "run_id")
        for c in ("timestamp", "start", "end"):
            if c in rows.columns:
                df = df.withColumn(c, later(c))
        for c in ("index", "keyframe_index"):
            if c in rows.columns:
                df = df.withColumn(c, (F.col(c) + F.col("frames_offset")).cast("int"))
        if "words" in rows.columns:
            df = df.withColumn("words", F.transform("words", lambda w: F.struct((w.start + F.col("duration_offset")).alias("start"), (w.end + F.col("duration_offset")).alias("end"), w.text.alias("text"))))
        if "segments" in rows.columns:
            df = df.withColumn("segments", F.transform("segments", moved))
        out[name] = df.withColumn("pos", F.row_number().over(order) - 1).withColumn("run_id", F.lit(merged)).select(rows.columns)
    out["runs"] = runs.agg(F.lit(merged).alias("run_id"), F.sum("duration").alias("duration"))
    return out


#: What a merge is counted by, and what that is called.
COUNTED = [("screens", "screens"), ("fields", "fields"), ("actions", "actions"), ("journey", "journey steps"), ("requirements", "requirements"), ("criteria", "acceptance criteria"), ("questions", "questions")]


def report(before: Tables, after: Tables, runs: DataFrame) -> str:
    """What each run (``run_id, position``) brought in and what is left after duplicates were folded, in lines of text."""
    counts = None
    for part, t in (("in", before), ("kept", after)):
        for name, label in COUNTED:
            rows = t[name].groupBy("run_id").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "run_id", F.lit(label).alias("label"), "n")
            counts = rows if counts is None else counts.unionByName(rows)
    n = {(x.part, x.run_id, x.label): x.n for x in counts.collect()}  # some numbers a run
    names = [x.run_id for x in runs.orderBy("position").select("run_id").collect()]
    lines = [f"Merged {len(names)} runs."]
    lines += [f"  {r}: " + ", ".join(f"{n.get(('in', r, label), 0)} {label}" for _, label in COUNTED) for r in names]
    lines.append("After merging duplicates:")
    for _, label in COUNTED:
        came, kept = (sum(v for (p, _, x), v in n.items() if p == part and x == label) for part in ("in", "kept"))
        folded = f" ({came - kept} folded into an earlier one)" if came > kept else ""
        lines.append(f"  {label}: {came} came in, {kept} kept{folded}")
    return "\n".join(lines)
