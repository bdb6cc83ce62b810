"""Reports of one run as Markdown, HTML, wiki pages, Mermaid, SVG and a workbook.

Only here are rows collected: a page is read by a person, and so is as long as a page can be.
"""

from __future__ import annotations

import zipfile
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.text import frame_label, mmss, table_cell, yes_no
from tracewright.operators import feedback, flow, gaps, glossary, lint
from tracewright.operators.gaps import Tables

Sheet = tuple[str, list[str], list[list]]


def of_run(t: Tables, run_id: str) -> Tables:
    return {k: v.where(F.col("run_id") == run_id) for k, v in t.items()}


def _sheet(name: str, headers: list[str], rows: DataFrame, order: str = "pos") -> Sheet:
    cols = [c for c in rows.columns if c != order]
    return name, headers, [["" if v is None else v for v in r] for r in rows.orderBy(order).select(*cols).collect()]


def sheets(t: Tables, keyframes: DataFrame | None = None, segments: DataFrame | None = None, hits: DataFrame | None = None) -> list[Sheet]:
    """Everything of one run as sheets of plain rows."""
    at = [mmss(F.col("timestamp")).alias("time"), frame_label(F.col("keyframe_index"), F.col("timestamp")).alias("frame")]
    named = lambda df: gaps.lookup_fallback(df, t["screens"], "screen_id", "id", "name", "screen")
    linted = lint.lint(t["requirements"], t["criteria"]).select("run_id", "target", "id", lint.findings_text(F.col("findings")).alias("findings"))
    note = lambda name, target: t[name].join(linted.where(F.col("target") == target).drop("target"), ["run_id", "id"], "left")
    found = gaps.find_gaps(t)
    entries = glossary.build(t)
    entries = glossary.with_findings(entries, glossary.findings(entries, t))
    asked = named(feedback.ask_first(t["questions"]))
    out = [
        _sheet("Summary", ["Item", "Value"], summary_rows(t, found)),
        _sheet("Journey", ["Step", "Screen", "What happens", "Who", "Time", "Frame"], named(t["journey"]).select("pos", "order", "screen", "description", "actor", *at)),
        _sheet("Screens", ["Id", "Name", "Purpose", "First seen"], t["screens"].select("pos", "id", "name", "purpose", mmss(F.col("first_seen")).alias("t"))),
        _sheet("Data Fields", ["Id", "Screen", "Label", "Type", "Required", "Example", "Source", "Notes", "Time", "Frame"], named(t["fields"]).select("pos", "id", "screen", "label", "field_type", yes_no(F.col("required")).alias("r"), "example_value", "source", "notes", *at)),
        _sheet("Actions", ["Id", "Screen", "Action", "Control", "Leads to", "Time", "Frame"], named(t["actions"]).select("pos", "id", "screen", "description", "control", "leads_to_screen_id", *at)),
        _sheet("Requirements", ["Id", "Statement", "Rationale", "Quote", "Kind", "Priority", "Confidence", "Writing", "Time", "Frame"], note("requirements", "requirement").select("pos", "id", "statement", "rationale", "source_quote", "kind", "priority", "confidence", "findings", *at)),
        _sheet("Acceptance Criteria", ["Id", "Requirement", "Given", "When", "Then", "Writing", "Time", "Frame"], note("criteria", "criterion").select("pos", "id", "requirement_id", "given", "when", "then", "findings", *at)),
        _sheet("SME Questions", ["Id", "Question", "Why it matters", "Screen", "Category", "Blocks", "Answer", "Status", "Time", "Frame"], asked.select("rank", "id", "question", "why_it_matters", "screen", "category", F.array_join("blocks_requirement_ids", ", ").alias("b"), "answer", "status", *at), "rank"),
        _sheet("Glossary", ["Term", "Kind", "Where", "First seen", "Frame", "Used in", "Definition", "Notes"], entries.select("pos", "term", "kind", "where", mmss(F.col("first_seen")).alias("t"), "keyframe_index", F.array_join("used_in", ", ").alias("u"), F.lit("").alias("d"), "notes")),
        _sheet("Gaps", ["What is missing", "Item", "Name", "Detail", "Time", "Frame", "Severity"], found.select("pos", "kind", "item_id", "item_name", "detail", mmss(F.col("timestamp")).alias("t"), "keyframe_index", "severity")),
    ]
    if segments is not None:
        out.append(_sheet("Transcript", ["Start", "Speaker", "Text"], segments.select("pos", mmss(F.col("start")).alias("t"), "speaker", "text")))
    if hits is not None:
        rows = hits.select(F.struct("part", "pos", "n").alias("o"), "kind", "value_masked", "source", F.when(F.col("timestamp").isNotNull(), mmss(F.col("timestamp"))).alias("t"), "keyframe_index", "context")
        out.append(_sheet("Personal Data", ["Kind", "Value (masked)", "Where", "Time", "Frame", "Context"], rows, "o"))
    return out


def summary_rows(t: Tables, found: DataFrame) -> DataFrame:
    """``pos, item, value``: what there is, counted."""
    runs = t["screens"].select("run_id").distinct()
    rows = None
    for i, (item, name) in enumerate((("Screens", "screens"), ("Data fields", "fields"), ("Actions", "actions"), ("Journey steps", "journey"), ("Requirements", "requirements"), ("Acceptance criteria", "criteria"), ("Questions", "questions"), ("Actors", "actors"))):
        n = t[name].agg(F.lit(i).alias("pos"), F.lit(item).alias("item"), F.count("*").cast("string").alias("value"))
        rows = n if rows is None else rows.unionByName(n)
    gap = gaps.summary(found, runs).select(F.lit(8).alias("pos"), F.lit("Gaps").alias("item"), F.col("summary").alias("value"))
    writing = lint.writing_summary(lint.lint(t["requirements"], t["criteria"])).select(F.lit(9).alias("pos"), F.lit("Writing").alias("item"), F.col("summary").alias("value"))
    return rows.unionByName(gap).unionByName(writing)


def _md(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown(title: str, pages: list[Sheet]) -> str:
    lines = [f"# {title}", ""]
    for name, headers, rows in pages:
        lines += [f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
            lines += ["| " + " | ".join(map(_md, r)) + " |" for r in rows]
        else:
            lines.append("None.")
        lines.append("")
    return "\n".join(lines)


def _table(headers: list[str], rows: list[list]) -> str:
    head = "".join(f"<th>{escape(h)}</th>" for h in headers)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tbody><tr>{head}</tr>{body}</tbody></table>"


def wiki(pages: list[Sheet]) -> str:
    """XHTML for wiki pages: headings and tables."""
    return "".join(f"<h2>{escape(n)}</h2>" + (_table(h, r) if r else "<p>None.</p>") for n, h, r in pages)


def wiki_page(title: str, pages: list[Sheet], target: str = "confluence") -> str:
    """The wiki body as a document to import: for one wiki XHTML with its namespace, for the other (``sharepoint``) plain."""
    namespace = {"confluence": ' xmlns="http://www.w3.org/1999/xhtml"', "sharepoint": ""}[target]
    head = f'<meta charset="utf-8" />\n<title>{escape(title)}</title>'
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE html>\n<html{namespace} lang="en">\n<head>\n{head}\n</head>\n<body>\n<h1>{escape(title)}</h1>\n{wiki(pages)}</body>\n</html>\n'


def html_page(title: str, pages: list[Sheet], flow_svg: str = "") -> str:
    """One file, with a box that filters the rows of all tables."""
    script = "document.getElementById('q').oninput=e=>{for(const r of document.querySelectorAll('tr:not(:first-child)'))r.hidden=!r.textContent.toLowerCase().includes(e.target.value.toLowerCase())}"
    style = "body{font:15px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:4px 8px;text-align:left;vertical-align:top}"
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><style>{style}</style><h1>{escape(title)}</h1><input id='q' placeholder='Filter'>{flow_svg}{wiki(pages)}<script>{script}</script>"


def _mermaid(label: str) -> str:
    return "".join(f"#{ord(c)};" if c in "\"'[](){}<>|#;&" else " " if c == "\n" else c for c in label)


def mermaid(t: Tables) -> str:
    ids = {n.id: f"n{n.order}" for n in flow.nodes(t).collect()}
    lines = ["flowchart LR"] + [f'    n{n.order}["{_mermaid(n.label)}"]' for n in flow.nodes(t).orderBy("order").collect()]
    for e in flow.edges(t).orderBy("pos").collect():
        arrow = "-->" if e.kind == "action" else "-.->"
        lines.append(f"    {ids[e.from_id]} {arrow}" + (f'|"{_mermaid(e.label)}"|' if e.label else "") + f" {ids[e.to_id]}")
    return "\n".join(lines)


def svg(t: Tables, width: int = 180, height: int = 56) -> str:
    at = {n.id: n for n in flow.layout(flow.nodes(t), width, height).collect()}
    size = max((n.x for n in at.values()), default=0) + width, max((n.y for n in at.values()), default=0) + height
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}">']
    for e in flow.edges(t).orderBy("pos").collect():
        a, b = at[e.from_id], at[e.to_id]
        dash = "" if e.kind == "action" else ' stroke-dasharray="4"'
        out.append(f'<line x1="{a.x + width // 2}" y1="{a.y + height // 2}" x2="{b.x + width // 2}" y2="{b.y + height // 2}" stroke="#888"{dash}/>')
    for n in at.values():
        out.append(f'<rect x="{n.x}" y="{n.y}" width="{width}" height="{height}" fill="#fff" stroke="#333"/><text x="{n.x + 8}" y="{n.y + 24}">{escape(n.label)}</text>')
        out.append(f'<text x="{n.x + 8}" y="{n.y + 44}" font-size="11">{n.n_fields} fields, {n.n_actions} actions</text>')
    return "".join([*out, "</svg>"])


def live_questions(questions: DataFrame, duration: float) -> str:
    """Questions while a call goes on: what blocks most first, then the newest; their status doesn't matter."""
    blocked = F.size(F.coalesce("blocks_requirement_ids", F.array().cast("array<string>")))
    rows = questions.orderBy(blocked.desc(), F.desc("timestamp"), "id").collect()
    clock = f"{int(duration) // 60:02d}:{int(duration) % 60:02d}"
    lines = ["# Questions to ask", "", f"Updated at {clock}. {len(rows)} question{'' if len(rows) == 1 else 's'}, most blocking first, then newest.", ""]
    for q in rows:
        blocks = f" (blocks {', '.join(q.blocks_requirement_ids)})" if q.blocks_requirement_ids else ""
        lines += [f"## {q.id} at {int(q.timestamp) // 60:02d}:{int(q.timestamp) % 60:02d}", "", q.question.strip() + blocks, "", f"Why it matters: {(q.why_it_matters or '').strip()}", ""]
    return "\n".join(lines if rows else [*lines, "Nothing to ask yet."]).rstrip() + "\n"


def comparison(changes: DataFrame, before: str = "before", after: str = "after") -> str:
    lines = [f"# {before} and {after}", ""]
    for change, said in (("removed", f"Only in {before}"), ("added", f"Only in {after}"), ("changed", "Reworded")):
        rows = changes.where(F.col("change") == change).orderBy("kind", "pos").collect()
        lines += [f"## {said} ({len(rows)})", ""]
        for r in rows:
            both = f"{r.id_a} {r.text_a} -> {r.id_b} {r.text_b}" if change == "changed" else f"{r.id_a or r.id_b} {r.text_a or r.text_b}"
            where = r.frame_a or r.frame_b
            lines.append(f"- {r.kind}: {both}" + (f" ({where})" if where else ""))
        lines.append("")
    return "\n".join(lines)


def comparison_html(changes: DataFrame, before: str = "before", after: str = "after") -> str:
    """The comparison as one page: what was removed, added and reworded, by kind."""
    rows = changes.orderBy("kind", "pos").collect()
    parts = [f"<!doctype html><meta charset='utf-8'><title>{escape(before)} and {escape(after)}</title><h1>{escape(before)} and {escape(after)}</h1>"]
    for change, said, none in (("removed", f"Only in {before}", "Nothing was removed."), ("added", f"Only in {after}", "Nothing was added."), ("changed", "Changed", "Nothing changed.")):
        mine = [r for r in rows if r.change == change]
        parts.append(f"<section><h2>{escape(said)}</h2>" + ("" if mine else f'<p class="muted">{none}</p>'))
        for kind in dict.fromkeys(r.kind for r in mine):
            parts.append(f"<h3>{escape(kind)}</h3><ul>")
            for r in (r for r in mine if r.kind == kind):
                sides = [(i, x, f) for i, x, f in ((r.id_a, r.text_a, r.frame_a), (r.id_b, r.text_b, r.frame_b)) if i is not None]
                text = " &rarr; ".join(f'<span class="id">{escape(i)}</span> {escape(x or "")}' + (f' <span class="when">{escape(f)}</span>' if f else "") for i, x, f in sides)
                parts.append(f"<li>{text}</li>")
            parts.append("</ul>")
        parts.append("</section>")
    return "".join(parts)


def glossary_markdown(entries: DataFrame) -> str:
    cell = lambda c: table_cell(c.cast("string"))
    rows = entries.orderBy("pos").select(cell(F.col("term")), "kind", cell(F.col("where")), mmss(F.col("first_seen")), F.array_join("used_in", ", ")).collect()
    return "\n".join(["## Glossary", "", "| Term | Kind | Where | First seen | Used in |", "|---|---|---|---|---|", *("| " + " | ".join(r) + " |" for r in rows)])


def workbook(pages: list[Sheet], path: str) -> None:
    """An .xlsx file of plain sheets, written with the standard library."""
    def column(i: int) -> str:
        return (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)

    def cell(r: int, c: int, v) -> str:
        ref = f"{column(c)}{r}"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{ref}"><v>{v}</v></c>'
        text = "".join(x for x in str(v) if x in "\t\n" or x >= " ")[:32767]
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text, quote=False)}</t></is></c>'

    main, rels = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}worksheet+xml"/>' for i in range(1, len(pages) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rels}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _, _) in enumerate(pages, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rels}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{rels}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(pages) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (_, headers, rows) in enumerate(pages, 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate([headers, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def export(t: Tables, title: str, out_dir: str, **more: DataFrame) -> dict[str, Path]:
    """All renderings of one run in a folder."""
    folder = Path(out_dir)
    folder.mkdir(parents=True, exist_ok=True)
    pages = sheets(t, **more)
    files = {"report.md": markdown(title, pages), "report.html": html_page(title, pages, svg(t)), "wiki.xhtml": wiki(pages), "flow.mmd": mermaid(t)}
    out = {}
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
        out[name] = folder / name
    workbook(pages, str(folder / "analysis.xlsx"))
    return out | {"analysis.xlsx": folder / "analysis.xlsx"}
