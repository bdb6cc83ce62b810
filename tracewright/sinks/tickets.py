"""Requirements and questions as tickets for two trackers: tables first, one CSV file each at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import cut, html, mmss, slug
from tracewright.operators.gaps import Tables, lookup_fallback

# Columns, priorities.
JIRA = ["Issue Type", "Summary", "Description", "Priority", "Labels", "Issue ID", "Parent ID"]
AZURE = ["Work Item Type", "Title", "Description", "Acceptance Criteria", "Priority", "Tags"]
JIRA_PRIORITY = {"must": "Highest", "should": "High", "could": "Medium"}
AZURE_PRIORITY = {"must": "1", "should": "2"}


def criteria_by_requirement(t: Tables) -> DataFrame:
    """``run_id, id, criteria``: each requirement's criteria in their order."""
    item = F.struct("pos", "given", "when", "then")
    return t["criteria"].groupBy("run_id", F.col("requirement_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("criteria"))


def _labels(prefix: str, *parts: Column) -> Column:
    slugs = F.array(F.lit(prefix), *(slug(F.coalesce(p, F.lit(""))) for p in parts))
    return F.array_distinct(F.filter(slugs, lambda s: s != ""))


def _choice(column: str, options: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in options.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _prepared(t: Tables, keyframes: DataFrame) -> tuple[DataFrame, DataFrame]:
    file = keyframes.select("run_id", F.col("index").alias("keyframe_index"), F.element_at(F.split("path", "/"), -1).alias("_file"))
    out = []
    for name in ("requirements", "questions"):
        rows = lookup_fallback(t[name], t["screens"], "screen_id", "id", "name", "screen").join(file, ["run_id", "keyframe_index"], "left")
        out.append(rows.withColumn("frame", F.coalesce("_file", F.concat(F.lit("frame "), F.col("keyframe_index").cast("string")))))
    r = out[0].join(criteria_by_requirement(t), ["run_id", "id"], "left")
    r = r.withColumn("criteria", F.coalesce("criteria", F.array().cast(r.schema["criteria"].dataType)))
    return r, out[1]


def _said(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _if(column: str, value: Column) -> Column:
    return F.when(F.col(column) != "", value)


def jira(t: Tables, keyframes: DataFrame, prefix: str = "walkthrough") -> DataFrame:
    """A story for each requirement, a task for each question, with ``run_id, part, pos`` for their order."""
    r, q = _prepared(t, keyframes)
    lines = F.transform("criteria", lambda c: _said("* *Given* ", c.given, " *When* ", c["when"], " *Then* ", c["then"]))
    body = F.concat_ws(
        "\n", _if("rationale", F.concat("rationale", F.lit("\n"))), F.lit("h3. Acceptance criteria"), F.when(F.size("criteria") > 0, F.array_join(lines, "\n")).otherwise("* None yet."),
        F.lit("\nh3. Source"), _said('The expert said: "', F.col("source_quote"), '"'), _said("Time: ", mmss(F.col("timestamp"))), _said("Frame: ", F.col("frame")),
    )
    story = [F.lit("Story"), cut(F.col("statement")), body, _choice("priority", JIRA_PRIORITY, "Medium"), F.array_join(_labels(prefix, F.col("kind"), F.col("screen")), " "), F.col("id"), F.lit("")]
    asked = F.concat_ws("\n", _said("Why it matters: ", F.col("why_it_matters")), _if("context_quote", _said('What was said: "', F.col("context_quote"), '"')), _said("Time: ", mmss(F.col("timestamp"))), _said("Frame: ", F.col("frame")))
    task = [F.lit("Task"), cut(_said("Question: ", F.col("question"))), asked, F.lit("Medium"), F.array_join(_labels(prefix, F.lit("question"), F.col("category"), F.col("screen")), " "), F.col("id"), F.lit("")]
    return _rows(r, story, 0, JIRA).unionByName(_rows(q, task, 1, JIRA))


def azure(t: Tables, keyframes: DataFrame, prefix: str = "walkthrough") -> DataFrame:
    r, q = _prepared(t, keyframes)
    p = lambda *x: _said("<p>", html(_said(*x), quotes=False), "</p>")
    items = F.transform("criteria", lambda c: _said("<li><b>Given</b> ", html(c.given, False), " <b>When</b> ", html(c["when"], False), " <b>Then</b> ", html(c["then"], False), "</li>"))
    listed = F.when(F.size("criteria") > 0, _said("<ul>", F.array_join(items, ""), "</ul>")).otherwise("<p>None yet.</p>")
    when = p("Time ", mmss(F.col("timestamp")), ", frame ", F.col("frame"))
    body = F.concat_ws("", _if("rationale", p(F.col("rationale"))), p('The expert said: "', F.col("source_quote"), '"'), when)
    story = [F.lit("User Story"), cut(F.col("statement")), body, listed, _choice("priority", AZURE_PRIORITY, "3"), F.array_join(_labels(prefix, F.col("kind"), F.col("screen")), "; ")]
    asked = F.concat_ws("", p("Why it matters: ", F.col("why_it_matters")), _if("context_quote", p('What was said: "', F.col("context_quote"), '"')), when)
    issue = [F.lit("Issue"), cut(_said("Question: ", F.col("question"))), asked, F.lit(""), F.lit("3"), F.array_join(_labels(prefix, F.lit("question"), F.col("category"), F.col("screen")), "; ")]
    return _rows(r, story, 0, AZURE).unionByName(_rows(q, issue, 1, AZURE))


def _rows(df: DataFrame, columns: list[Column], part: int, names: list[str]) -> DataFrame:
    return df.select("run_id", F.lit(part).alias("part"), "pos", *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def write_csv(tickets: DataFrame, path: str) -> None:
    """One file with a header, all fields quoted, in order; a run's tickets are a page, not a table."""
    names = [c for c in tickets.columns if c not in ("run_id", "part", "pos")]
    rows = tickets.orderBy("run_id", "part", "pos").select(*names).coalesce(1)
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)
