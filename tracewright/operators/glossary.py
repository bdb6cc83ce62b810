"""Glossary: the terms an analysis relies on, where they are used, and where names disagree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import fold, mentions, singular
from tracewright.operators.gaps import Tables, lookup_fallback, mentioned

# The kinds in order, verbs and types of controls, status words, and limits of the comparison by letters.
KINDS = ["role", "screen", "field", "action", "status value", "other"]
VERBS = "presses press clicks click selects select opens open taps tap chooses choose picks pick".split()
TYPES = "button link menu tab option icon".split()
STATUS = (
    "Pending Approved Rejected Verified Unverified Active Inactive Draft Submitted Completed Complete Cancelled Archived Declined Failed Passed Accepted Closed Suspended Expired"
).split()
LEAST_LETTERS, MOST_EDITS = 6, 2
AS_A = r"(?iU)^\s*as\s+an?\s+(.+?)\s*,"


def role_in(statement: Column) -> Column:
    """The role of ``As a <role>, ...``; null without one."""
    role = F.trim(F.regexp_extract(statement, AS_A, 1))
    return F.when(role != "", role)


def control_name(description: Column) -> Column:
    """What is quoted, else what follows a verb of using a control, cut at the next clause and without the control's
    type; null unless it starts with a capital."""
    text = F.regexp_replace(F.trim(description), r"[.;,]+$", "")
    quoted = F.trim(F.regexp_extract(text, "[\"“”']([^\"“”']{2,})[\"“”']", 1))
    after = F.regexp_extract(text, r"(?iU)\b(?:" + "|".join(VERBS) + r")\s+(?:the\s+|on\s+)?(.+)$", 1)
    name = F.regexp_replace(after, r"(?iU)\s+(?:to|from|which|that|so|then|and then|in order)\b.*$", "")
    name = F.regexp_replace(F.regexp_replace(F.trim(name), r"[.;,]+$", ""), r"(?iU)\s+(?:" + "|".join(TYPES) + r")\s*$", "")
    name = F.trim(name)
    return F.when(quoted != "", quoted).when(name.rlike(r"^\p{Lu}"), name)


def status_words(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?<![\w-]){w}(?![\w-])"), F.lit(w)) for w in STATUS)))


def corpus(t: Tables) -> DataFrame:
    """``run_id, part, pos, id, text``: all rows a term may be used in, in the order of the sheets."""
    both = lambda *c: F.concat_ws(" ", *(F.when(F.col(x) != "", F.col(x)) for x in c))
    parts = [
        ("screens", F.col("purpose")), ("actions", F.col("description")), ("requirements", both("statement", "rationale", "source_quote")),
        ("criteria", F.concat_ws(" ", "given", "when", "then")), ("questions", F.col("question")),
    ]
    out = None
    for i, (name, text) in enumerate(parts):
        rows = t[name].select("run_id", F.lit(i).alias("part"), "pos", "id", text.alias("text"))
        out = rows if out is None else out.unionByName(rows)
    return out


def used_in(terms: DataFrame, texts: DataFrame) -> DataFrame:
    """``run_id, term, plural, used_in``: ids of the rows that mention each term, once each, in order."""
    pairs = mentioned(terms.select("run_id", "term", "plural").distinct(), "term", texts, "text", plural=F.col("plural"))
    ids = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("part", "pos", "id"))), lambda x: x.id))
    return pairs.groupBy("run_id", "term", "plural").agg(ids.alias("used_in"))


def screen_phrase(names: Column) -> Column:
    n = F.size(names)
    many = F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(names, -1), F.lit(" screens"))
    return F.when(n == 0, "").when(n == 1, F.concat(F.element_at(names, 1), F.lit(" screen"))).otherwise(many)


def _entry(kind: str, term: Column, at: Column, frame: Column, where: Column, plural: bool = True) -> list[Column]:
    return [F.col("run_id"), F.lit(kind).alias("kind"), F.col("pos"), term.alias("term"), at.alias("first_seen"), frame.alias("keyframe_index"), where.alias("where"), F.lit(plural).alias("plural")]


def _first_frame(t: Tables) -> DataFrame:
    kf = F.coalesce(F.try_element_at("keyframe_indexes", F.lit(1)), F.lit(0))
    return t["screens"].groupBy("run_id").agg(F.min(F.struct("first_seen", "pos", kf.alias("kf"))).alias("_first"))


def roles(t: Tables) -> DataFrame:
    """Actors, first seen at their first step, else where a row names them first, else at the first screen; then roles
    that only statements name."""
    key = lambda c: fold(F.col(c))
    once = F.row_number().over(Window.partitionBy("run_id", "_key").orderBy("pos"))
    actors = t["actors"].withColumn("_key", key("actor")).withColumn("_n", once).where("_n = 1").drop("_n")
    steps = t["journey"].where("actor <> ''").groupBy("run_id", key("actor").alias("_key")).agg(F.min(F.struct("timestamp", "keyframe_index")).alias("_step"))
    r, c, q = t["requirements"], t["criteria"], t["questions"]
    own = ("run_id", "timestamp", "keyframe_index")
    texts = r.select(*own, F.col("statement").alias("text")).union(r.select(*own, "source_quote")).union(c.select(*own, "given")).union(c.select(*own, "when")).union(c.select(*own, "then")).union(q.select(*own, "question"))
    named = mentioned(actors.select("run_id", "_key", "actor").withColumnRenamed("_key", "_of"), "actor", texts, "text").withColumnRenamed("_of", "_key").groupBy("run_id", "_key").agg(F.min(F.struct("timestamp", "keyframe_index")).alias("_named"))
    a = actors.join(steps, ["run_id", "_key"], "left").join(named, ["run_id", "_key"], "left").join(_first_frame(t), "run_id", "left")
    at = F.coalesce("_step.timestamp", "_named.timestamp", "_first.first_seen", F.lit(0.0))
    frame = F.coalesce("_step.keyframe_index", "_named.keyframe_index", "_first.kf", F.lit(0))
    listed = a.select(*_entry("role", F.col("actor"), at, frame, F.lit("listed as an actor")))
    said = r.withColumn("role", role_in(F.col("statement"))).where("role is not null").withColumn("_key", key("role")).join(actors.select("run_id", "_key"), ["run_id", "_key"], "left_anti")
    said = said.withColumn("_n", once).where("_n = 1")
    return listed.unionByName(said.select(*_entry("role", F.col("role"), F.col("timestamp"), F.col("keyframe_index"), F.concat(F.lit("in requirement "), "id"))))


def screens(t: Tables) -> DataFrame:
    kf = F.coalesce(F.try_element_at("keyframe_indexes", F.lit(1)), F.lit(0))
    return t["screens"].select(*_entry("screen", F.col("name"), F.col("first_seen"), kf, F.concat(F.lit("screen "), "id")))


def _by_name(rows: DataFrame, name: Column, extra: Column) -> DataFrame:
    """Rows grouped by name in any case: spelling, time and frame of the earliest, screens in order."""
    names = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "screen"))), lambda x: x.screen))
    first = F.min(F.struct("timestamp", "pos", "keyframe_index", name.alias("term"), extra.alias("extra"))).alias("f")
    return rows.groupBy("run_id", F.lower(name).alias("_key")).agg(first, names.alias("screens"), F.min("pos").alias("pos"))


def fields(t: Tables) -> DataFrame:
    rows = lookup_fallback(t["fields"], t["screens"], "screen_id", "id", "name", "screen")
    g = _by_name(rows, F.trim("label"), F.lit(None).cast("string"))
    return g.select(*_entry("field", F.col("f.term"), F.col("f.timestamp"), F.col("f.keyframe_index"), screen_phrase(F.col("screens"))))


def actions(t: Tables) -> DataFrame:
    rows = lookup_fallback(t["actions"], t["screens"], "screen_id", "id", "name", "screen").withColumn("_name", control_name(F.col("description"))).where("_name is not null")
    g = _by_name(rows, F.col("_name"), F.col("control"))
    control = F.trim(F.when(F.col("f.extra") != "", F.col("f.extra")).otherwise("control"))
    return g.select(*_entry("action", F.col("f.term"), F.col("f.timestamp"), F.col("f.keyframe_index"), F.concat(control, F.lit(" on "), screen_phrase(F.col("screens"))), plural=False))


def status_values(t: Tables) -> DataFrame:
    """Values of status fields, then status words of statements and criteria, by time; a word is left out where it, or
    a value that mentions it, is listed already: what is listed decides what follows, so a run's few candidates are
    gone through in order, in one expression."""
    f = lookup_fallback(t["fields"], t["screens"], "screen_id", "id", "name", "screen").where("example_value <> ''")
    f = f.where(F.contains(F.lower("label"), F.lit("status")) | F.contains(F.lower("field_type"), F.lit("status")))
    where = F.concat(F.lit('value of the "'), "label", F.lit('" field on '), "screen", F.lit(" screen"))
    cols = ("run_id", "part", "timestamp", "list", "pos", "word", "term", "keyframe_index", "where")
    rows = f.select("run_id", F.lit(0).alias("part"), "timestamp", F.lit(0).alias("list"), "pos", F.lit(0).alias("word"), F.trim("example_value").alias("term"), "keyframe_index", where.alias("where"))
    for i, (name, text) in enumerate((("requirements", F.col("statement")), ("criteria", F.concat_ws(" ", "given", "when", "then")))):
        said = t[name].select("run_id", "timestamp", "pos", "keyframe_index", F.concat(F.lit("in "), "id").alias("where"), F.posexplode(status_words(text)).alias("word", "term"))
        rows = rows.unionByName(said.withColumn("part", F.lit(1)).withColumn("list", F.lit(i)).select(*cols))
    item = F.struct("part", "timestamp", "list", "pos", "word", "term", "keyframe_index", "where")
    per = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("x"))
    known = lambda kept, c: F.exists(kept, lambda k: (fold(k.term) == fold(c.term)) | mentions(c.term, k.term))
    kept = F.aggregate("x", F.expr("slice(x, 1, 0)"), lambda a, c: F.when(known(a, c), a).otherwise(F.concat(a, F.array(c))))
    out = per.select("run_id", F.posexplode(kept).alias("pos", "k"))
    return out.select(*_entry("status value", F.col("k.term"), F.col("k.timestamp"), F.col("k.keyframe_index"), F.col("k.where")))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def build(t: Tables) -> DataFrame:
    """``run_id, pos, term, kind, first_seen, keyframe_index, where, used_in``, by kind and then by term."""
    rows = roles(t)
    for part in (screens, fields, actions, status_values):
        rows = rows.unionByName(part(t))
    rows = rows.join(used_in(rows, corpus(t)), ["run_id", "term", "plural"], "left").withColumn("used_in", F.coalesce("used_in", F.array().cast("array<string>")))
    order = Window.partitionBy("run_id").orderBy(kind_rank(F.col("kind")), F.lower("term"), "pos")
    return rows.withColumn("pos", F.row_number().over(order) - 1).select("run_id", "pos", "term", "kind", "first_seen", "keyframe_index", "where", "used_in")


def how_they_differ(a: Column, b: Column, same_kind: Column) -> Column:
    fa, fb = fold(a), fold(b)
    close = F.when(same_kind & (F.least(F.length(fa), F.length(fb)) >= LEAST_LETTERS), F.levenshtein(fa, fb, MOST_EDITS) >= 0).otherwise(F.lit(False))
    return (
        F.when(F.lower(a) == F.lower(b), "capitals").when(fa == fb, "spacing").when(singular(fa) == singular(fb), "plural").when(close, "letters")
    )


#: How a finding says it.
DIFFER = {"capitals": "differ only in capital letters", "spacing": "differ only by a space or hyphen", "plural": "differ only by a plural ending", "letters": "are one or two letters apart"}


def _thirds(word: Column, length: Column, shift: Column | None = None) -> Column:
    """The thirds of a word of ``length`` letters, each named by that length and its number; with ``shift``, what stands
    where the thirds would, so many letters on, and nothing where that is outside of the word."""

    def third(i: Column) -> Column:
        start, end = F.floor(length * i / 3).cast("int"), F.floor(length * (i + 1) / 3).cast("int")
        at = start if shift is None else start + shift
        inside = (at >= 0) & (at + end - start <= F.length(word))
        return F.when(inside, F.concat_ws("/", length.cast("string"), i.cast("string"), F.substring(word, at + 1, end - start)))

    return F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(2)), third))


def likeness_keys(term: Column, kind: Column) -> tuple[Column, Column]:
    """What a term is known by, and what it looks for: of terms that differ in little, each looks for something that the
    other is known by. That is the folded singular; and, for the comparison by letters within a kind, a third of the
    folded term: two edits leave one third of a word as it is, moved by two letters at most."""
    f = fold(term)
    n = F.length(f)
    near = lambda keys: F.when(n >= LEAST_LETTERS, F.transform(keys, lambda k: F.concat(kind, F.lit("/"), k))).otherwise(F.array().cast("array<string>"))
    moves = F.sequence(F.lit(-MOST_EDITS), F.lit(MOST_EDITS))
    sought = F.flatten(F.transform(moves, lambda d: F.flatten(F.transform(moves, lambda s: _thirds(f, n + d, s)))))
    same = F.array(F.concat(F.lit("="), singular(f)))
    return F.concat(same, near(_thirds(f, n))), F.concat(same, near(F.array_distinct(sought)))


def near_duplicates(entries: DataFrame) -> DataFrame:
    """Pairs of a run's terms (``a``, ``b`` by ``pos``) that differ in little, with ``reason``. Roles that only a
    statement names have a check of their own. Terms meet by ``likeness_keys``; no two others are looked at."""
    known, sought = likeness_keys(F.col("term"), F.col("kind"))
    x = entries.select("run_id", "pos", F.explode(known).alias("key")).alias("x")
    y = entries.select("run_id", "pos", F.explode(sought).alias("key")).alias("y")
    met = x.join(y, (F.col("x.run_id") == F.col("y.run_id")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.pos") != F.col("y.pos")))
    met = met.select(F.col("x.run_id").alias("_run"), F.least("x.pos", "y.pos").alias("_a"), F.greatest("x.pos", "y.pos").alias("_b")).distinct()
    pairs = met.join(entries.alias("a"), (F.col("a.run_id") == F.col("_run")) & (F.col("a.pos") == F.col("_a")))
    pairs = pairs.join(entries.alias("b"), (F.col("b.run_id") == F.col("_run")) & (F.col("b.pos") == F.col("_b")) & (F.col("a.term") != F.col("b.term"))).drop("_run", "_a", "_b")
    said = lambda e: (F.col(f"{e}.kind") == "role") & F.col(f"{e}.where").startswith("in requirement")
    pairs = pairs.where(~((F.col("a.kind") == "role") & (F.col("b.kind") == "role") & (said("a") | said("b"))))
    return pairs.withColumn("reason", how_they_differ(F.col("a.term"), F.col("b.term"), F.col("a.kind") == F.col("b.kind"))).where("reason is not null")


def _described(e: str) -> Column:
    return F.concat(F.lit('"'), F.col(f"{e}.term"), F.lit('" ('), F.col(f"{e}.kind"), F.lit(", "), F.col(f"{e}.where"), F.lit(")"))


def findings(entries: DataFrame, t: Tables) -> DataFrame:
    """``run_id, part, first, second, finding, terms, kind``: near-duplicates, fields on several screens, and roles that
    are no actors."""
    says = F.lit(None).cast("string")
    for k, v in DIFFER.items():
        says = F.when(F.col("reason") == k, v).otherwise(says)
    near = near_duplicates(entries).select(F.col("a.run_id").alias("run_id"), F.lit(0).alias("part"), F.col("a.pos").alias("first"), F.col("b.pos").alias("second"), F.concat(_described("a"), F.lit(" and "), _described("b"), F.lit(" "), says, F.lit(", so pick one spelling and use it everywhere.")).alias("finding"), F.array(fold(F.col("a.term")), fold(F.col("b.term"))).alias("keys"), F.lit(None).cast("string").alias("kind"))
    rows = lookup_fallback(t["fields"], t["screens"], "screen_id", "id", "name", "screen").withColumn("_key", fold(F.col("label")))
    w = Window.partitionBy("run_id", "_key").orderBy("pos")
    rows = rows.withColumn("_label", F.first("label").over(w)).withColumn("_said", F.when(F.col("label") != F.col("_label"), F.concat("screen", F.lit(' as "'), "label", F.lit('"'))).otherwise(F.col("screen")))
    on = rows.groupBy("run_id", "_key", "_label").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "_said"))), lambda x: x._said)).alias("s"), F.min("pos").alias("first")).where(F.size("s") > 1)
    several = on.select("run_id", F.lit(1).alias("part"), "first", F.lit(0).alias("second"), F.concat(F.lit('Info: the field "'), "_label", F.lit('" appears on '), F.size("s").cast("string"), F.lit(" screens ("), F.array_join("s", ", "), F.lit("), so check it means the same thing on each.")).alias("finding"), F.array("_key").alias("keys"), F.lit("field").alias("kind"))
    actors = t["actors"].groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "actor"))), lambda x: x.actor).alias("actors"))
    said = t["requirements"].withColumn("role", role_in(F.col("statement"))).where("role is not null").join(actors, "run_id", "left").withColumn("actors", F.coalesce("actors", F.array().cast("array<string>")))
    said = said.where(~F.exists("actors", lambda a: fold(a) == fold(F.col("role"))))
    alike = F.filter("actors", lambda a: how_they_differ(F.col("role"), a, F.lit(True)).isNotNull())
    inside = F.filter("actors", lambda a: F.contains(fold(F.col("role")), fold(a)) | F.contains(fold(a), fold(F.col("role"))))
    closest = F.coalesce(F.try_element_at(alike, F.lit(1)), F.try_element_at(inside, F.lit(1)))
    hint = F.when(closest.isNotNull(), F.concat(F.lit(' The closest listed actor is "'), closest, F.lit('".'))).otherwise("")
    listed = F.when(F.size("actors") > 0, F.array_join("actors", ", ")).otherwise("none listed")
    roles_ = said.select("run_id", F.lit(2).alias("part"), F.col("pos").alias("first"), F.lit(0).alias("second"), F.concat(F.lit('"'), "role", F.lit('" is used as a role in '), "id", F.lit(" but is not in the actors list ("), listed, F.lit("), so add it or use the listed name."), hint).alias("finding"), F.array(fold(F.col("role"))).alias("keys"), F.lit("role").alias("kind"))
    return near.unionByName(several).unionByName(roles_)


def with_findings(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with ``notes``: the findings that concern each, once each, in order."""
    f = found.select("run_id", "part", "first", "second", "finding", F.explode("keys").alias("_key"), F.col("kind").alias("_kind"))
    joined = entries.withColumn("_key", fold(F.col("term"))).join(f, ["run_id", "_key"], "left")
    mine = F.when(F.col("_kind").isNull(), F.col("pos").isin(F.col("first"), F.col("second"))).otherwise(F.col("kind") == F.col("_kind"))
    item = F.when(mine, F.struct("part", "first", "second", "finding"))
    notes = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.finding)), " ")
    return joined.groupBy(*[c for c in entries.columns]).agg(notes.alias("notes"))
