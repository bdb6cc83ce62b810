"""Coverage checks: anti joins that say what an analysis does not cover yet.

Each check takes the entity tables and gives ``run_id, kind, item_id, item_name, detail, timestamp, keyframe_index,
severity``. All joins are on ``run_id``; mentions are looked for within a run only, by the first word of a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import mention_grams, mention_key, mention_keys, mentions, natural_key

# The kinds in their order, their plurals, the kinds of requirement that need no screen, and the verbs
# that move to another screen.
KINDS = [
    ("screen without requirements", "screens without requirements"),
    ("screen without fields", "screens without fields"),
    ("field never mentioned", "fields never mentioned"),
    ("requirement without criteria", "requirements without criteria"),
    ("requirement without screen", "requirements without screen"),
    ("action leading nowhere", "actions leading nowhere"),
    ("journey step not in a requirement", "journey steps not in a requirement"),
    ("low-confidence requirement", "low-confidence requirements"),
    ("question with no screen", "questions with no screen"),
    ("actor never named in a requirement", "actors never named in a requirement"),
]
ANYWHERE = ("workflow", "non-functional", "reporting")
NAVIGATION = (
    r"(?iU)\b(?:press(?:es)?|click(?:s)?|tap(?:s)?|open(?:s)?|go(?:es)? to|navigat(?:es)? to|switch(?:es)? to|return(?:s)? to|go(?:es)? back|"
    r"select(?:s)?\s+(?:the\s+|a\s+)?(?:[\w-]+\s+){0,3}tab)\b"
)

Tables = dict[str, DataFrame]


def lookup_fallback(rows: DataFrame, names: DataFrame, key: str, id_col: str, name_col: str, out: str, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """``rows`` with the name that ``key`` stands for; the key itself where nothing is known, '' for null. Of several
    names of an id the last counts, as ``pos`` has it."""
    named = names.groupBy(*by, F.col(id_col).alias("_id")).agg(F.max_by(name_col, "pos" if "pos" in names.columns else id_col).alias("_name"))
    on = [rows[k] == named[k] for k in by] + [rows[key] == named["_id"]]
    joined = rows.join(named, on, "left").select(*(rows[c] for c in rows.columns), F.coalesce("_name", rows[key].cast("string"), F.lit("")).alias(out))
    return joined


def mentioned(terms: DataFrame, term: str, texts: DataFrame, text: str, by: tuple[str, ...] = ("run_id",), plural: Column | None = None) -> DataFrame:
    """Rows of ``terms`` and ``texts`` (other names than those of ``by`` apart) of which the text mentions the term.

    Terms meet texts by their first three words: a text is joined with the first words of its run's terms, as one row,
    and from where it holds one on its next words are looked up, so that many terms may start with the same word.
    ``plural``: whether a plural counts."""
    t = terms.withColumn("_key", mention_key(F.col(term)))
    firsts = t.groupBy(*by).agg(F.collect_set(F.substring_index("_key", " ", 1)).alias("_firsts"))
    x = texts.join(firsts, list(by)).withColumn("_hit", F.array_intersect(mention_keys(F.col(text)), F.col("_firsts")))
    x = x.where(F.size("_hit") > 0).select(*texts.columns, F.explode(mention_grams(F.col(text), F.col("_hit"))).alias("_key"))
    said = mentions(F.col(term), F.col(text))
    if plural is not None:
        said = F.when(plural, said).otherwise(mentions(F.col(term), F.col(text), plural=False))
    return t.join(x, [*by, "_key"]).where(said).drop("_key")


def covered_screens(t: Tables) -> DataFrame:
    """``run_id, id`` of screens that a requirement points at or names: the equality first, the costlier mention for
    what is left."""
    by_id = t["requirements"].where("screen_id <> ''").select("run_id", F.col("screen_id").alias("id")).distinct()
    left = t["screens"].select("run_id", "id", "name").join(by_id, ["run_id", "id"], "left_anti")
    said = t["requirements"].select("run_id", "statement").distinct()
    named = mentioned(left, "name", said, "statement").select("run_id", "id")
    return by_id.unionByName(named).distinct()


def unmentioned(terms: DataFrame, term: str, texts: DataFrame, text: str, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Rows of ``terms`` that no text of their run mentions."""
    pattern = terms.select(*by, F.col(term).alias("_t")).distinct()
    hit = mentioned(pattern, "_t", texts.select(*by, F.col(text).alias("_x")).distinct(), "_x", by).select(*by, "_t").distinct()
    on = [terms[k] == hit[k] for k in by] + [terms[term] == hit["_t"]]
    return terms.join(hit, on, "left_anti")


def _gap(kind: str, item_id: Column, name: Column, detail: Column, at: Column, frame: Column, severity: Column | str = "warn") -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [F.col("run_id"), F.lit(kind).alias("kind"), item_id.alias("item_id"), name.alias("item_name"), detail.alias("detail"), at.alias("timestamp"), frame.alias("keyframe_index"), severity.alias("severity")]


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


_c = F.col


def _first_frame() -> Column:
    return F.coalesce(F.try_element_at("keyframe_indexes", F.lit(1)), F.lit(0))


def _own_time() -> tuple[Column, Column]:
    return F.col("timestamp"), F.col("keyframe_index")


def screens_without_requirements(t: Tables) -> DataFrame:
    rows = t["screens"].join(covered_screens(t), ["run_id", "id"], "left_anti")
    return rows.select(*_gap(KINDS[0][0], _c("id"), _c("name"), _said('No requirement points at the "', _c("name"), '" screen; ask the expert what the system must do here.'), _c("first_seen"), _first_frame()))


def screens_without_fields(t: Tables) -> DataFrame:
    have = t["fields"].select("run_id", _c("screen_id").alias("id")).unionByName(t["screens"].where(F.size("field_ids") > 0).select("run_id", "id")).distinct()
    rows = t["screens"].join(have, ["run_id", "id"], "left_anti")
    return rows.select(*_gap(KINDS[1][0], _c("id"), _c("name"), _said('No data field was recorded on the "', _c("name"), '" screen; ask what is typed or shown here.'), _c("first_seen"), _first_frame()))


def fields_never_mentioned(t: Tables) -> DataFrame:
    r, c = t["requirements"], t["criteria"]
    texts = r.select("run_id", _c("statement").alias("text")).unionByName(r.select("run_id", _c("rationale").alias("text"))).unionByName(c.select("run_id", F.concat_ws(" ", "given", "when", "then").alias("text")))
    rows = lookup_fallback(unmentioned(t["fields"], "label", texts.where("text <> ''"), "text"), t["screens"], "screen_id", "id", "name", "screen")
    detail = _said('The field "', _c("label"), '" on the ', _c("screen"), " screen is not named in any requirement or criterion; ask whether it matters and what rule applies to it.")
    return rows.select(*_gap(KINDS[2][0], _c("id"), _c("label"), detail, *_own_time()))


def requirements_without_criteria(t: Tables) -> DataFrame:
    have = t["criteria"].select("run_id", _c("requirement_id").alias("id")).distinct()
    rows = t["requirements"].join(have, ["run_id", "id"], "left_anti")
    return rows.select(*_gap(KINDS[3][0], _c("id"), _c("statement"), _said(_c("id"), " has no acceptance criteria; ask how the expert would know this is done right."), *_own_time()))


def requirements_without_screen(t: Tables) -> DataFrame:
    rows = t["requirements"].where("coalesce(screen_id, '') = ''")
    severity = F.when(_c("kind").isin(*ANYWHERE), "info").otherwise("warn")
    return rows.select(*_gap(KINDS[4][0], _c("id"), _c("statement"), _said(_c("id"), " is not tied to a screen; ask where in the system it applies."), *_own_time(), severity))


def actions_leading_nowhere(t: Tables) -> DataFrame:
    rows = lookup_fallback(t["actions"].where("coalesce(leads_to_screen_id, '') = ''").where(_c("description").rlike(NAVIGATION)), t["screens"], "screen_id", "id", "name", "screen")
    detail = _said('"', _c("description"), '" on the ', _c("screen"), " screen has no next screen recorded; ask what appears after it.")
    return rows.select(*_gap(KINDS[5][0], _c("id"), _c("description"), detail, *_own_time()))


def journey_steps_not_in_a_requirement(t: Tables) -> DataFrame:
    covered = covered_screens(t).withColumnRenamed("id", "screen_id")
    rows = lookup_fallback(t["journey"].join(covered, ["run_id", "screen_id"], "left_anti"), t["screens"], "screen_id", "id", "name", "screen")
    step = _c("order").cast("string")
    detail = _said("Step ", step, " on the ", _c("screen"), ' screen ("', _c("description"), '") has no requirement behind it; ask what the system must do at this step.')
    return rows.select(*_gap(KINDS[6][0], _said("J", step), _said("Step ", step, ": ", _c("screen")), detail, *_own_time()))


def low_confidence_requirements(t: Tables) -> DataFrame:
    detail = _said(_c("id"), " was inferred from the screen rather than said by the expert; confirm it with them.")
    return t["requirements"].where("confidence = 'low'").select(*_gap(KINDS[7][0], _c("id"), _c("statement"), detail, *_own_time(), "info"))


def questions_with_no_screen(t: Tables) -> DataFrame:
    detail = _said(_c("id"), " is not tied to a screen; note where it came up before asking it.")
    return t["questions"].where("coalesce(screen_id, '') = ''").select(*_gap(KINDS[8][0], _c("id"), _c("question"), detail, *_own_time(), "info"))


def actors_never_named(t: Tables) -> DataFrame:
    rows = unmentioned(t["actors"], "actor", t["requirements"].where("statement <> ''"), "statement")
    key = lambda c: F.lower(F.trim(c))
    steps = t["journey"].where("actor <> ''").groupBy("run_id", key(_c("actor")).alias("_key")).agg(F.min(F.struct("timestamp", "keyframe_index")).alias("_step"))
    first = t["screens"].groupBy("run_id").agg(F.min(F.struct("first_seen", "pos", _first_frame().alias("kf"))).alias("_screen"))
    rows = rows.withColumn("_key", key(_c("actor"))).join(steps, ["run_id", "_key"], "left").join(first, "run_id", "left")
    at, frame = F.coalesce("_step.timestamp", "_screen.first_seen", F.lit(0.0)), F.coalesce("_step.keyframe_index", "_screen.kf", F.lit(0))
    detail = _said('"', _c("actor"), '" is listed as an actor but no requirement names them; ask what they need from the system.')
    return rows.select(*_gap(KINDS[9][0], _c("actor"), _c("actor"), detail, at, frame, "info"))


CHECKS = [
    screens_without_requirements, screens_without_fields, fields_never_mentioned, requirements_without_criteria, requirements_without_screen,
    actions_leading_nowhere, journey_steps_not_in_a_requirement, low_confidence_requirements, questions_with_no_screen, actors_never_named,
]


def kind_rank(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for i, (k, _) in reversed(list(enumerate(KINDS))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def find_gaps(t: Tables) -> DataFrame:
    """All checks, with ``pos``: warnings first, then by kind, then ids in natural order."""
    rows = None
    for check in CHECKS:
        rows = check(t) if rows is None else rows.unionByName(check(t))
    order = Window.partitionBy("run_id").orderBy(F.col("severity") != "warn", kind_rank(_c("kind")), natural_key(_c("item_id")))
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def count_by_kind(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("run_id", "severity", "kind").agg(F.count("*").alias("n"))


def summary(gaps: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, summary``: one sentence for each run on what is to be closed."""
    counts = count_by_kind(gaps)
    phrase = F.concat(_c("n").cast("string"), F.lit(" "), F.when(_c("n") == 1, _c("kind")).otherwise(_plural(_c("kind"))))
    item = F.when(_c("severity") == "warn", F.struct(kind_rank(_c("kind")).alias("r"), phrase.alias("p")))
    per = counts.groupBy("run_id").agg(
        F.sum(F.when(_c("severity") == "warn", _c("n")).otherwise(0)).alias("holes"), F.sum(F.when(_c("severity") == "info", _c("n")).otherwise(0)).alias("notes"), F.sort_array(F.collect_list(item)).alias("items")
    )
    s = lambda n: F.when(n == 1, "").otherwise("s")
    head = F.when(_c("holes") > 0, F.concat(_c("holes").cast("string"), F.lit(" gap"), s(_c("holes")), F.lit(" to close: "), F.array_join(F.transform("items", lambda i: i.p), ", "))).otherwise("No gaps to close")
    tail = F.when(_c("notes") > 0, F.concat(F.lit("; "), _c("notes").cast("string"), F.lit(" note"), s(_c("notes")))).otherwise("")
    return runs.select("run_id").join(per, "run_id", "left").select("run_id", F.when(_c("holes").isNull(), "No gaps found.").otherwise(F.concat(head, tail, F.lit("."))).alias("summary"))


def _plural(kind: Column) -> Column:
    out = kind
    for k, many in KINDS:
        out = F.when(kind == k, many).otherwise(out)
    return out
