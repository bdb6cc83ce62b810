"""Schemas of the stored documents, and the entity tables that they are taken apart into.

An entity table has ``run_id`` and ``pos``, the place in its list, because list order means something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "array<struct<start:double,`end`:double,text:string>>"
SEGMENT = f"struct<start:double,`end`:double,text:string,speaker:string,words:{WORDS}>"
REGION = "struct<x:int,y:int,w:int,h:int,fraction:double>"
RECORDING = (
    "run_id string, source string, duration double, transcript_source string, "
    f"keyframes array<struct<index:int,timestamp:double,path:string,phash:string,width:int,height:int,change_from_previous:{REGION}>>, "
    f"segments array<{SEGMENT}>, moments array<struct<keyframe_index:int,start:double,`end`:double,segments:array<{SEGMENT}>>>"
)
ENTITIES = {
    "screens": "id:string,name:string,purpose:string,keyframe_indexes:array<int>,first_seen:double,field_ids:array<string>,action_ids:array<string>",
    "fields": "id:string,screen_id:string,label:string,field_type:string,required:boolean,example_value:string,source:string,timestamp:double,keyframe_index:int,notes:string",
    "actions": "id:string,screen_id:string,description:string,control:string,leads_to_screen_id:string,timestamp:double,keyframe_index:int",
    "journey": "`order`:int,screen_id:string,description:string,actor:string,timestamp:double,keyframe_index:int",
    "requirements": "id:string,statement:string,rationale:string,source_quote:string,timestamp:double,keyframe_index:int,screen_id:string,kind:string,priority:string,confidence:string",
    "acceptance_criteria": "id:string,requirement_id:string,given:string,`when`:string,`then`:string,timestamp:double,keyframe_index:int",
    "questions": "id:string,question:string,why_it_matters:string,context_quote:string,timestamp:double,keyframe_index:int,screen_id:string,category:string,"
    "blocks_requirement_ids:array<string>,answer:string,status:string",
}
USAGE = "struct<model:string,calls:int,input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>"
ANALYSIS = "run_id string, title string, summary string, actors array<string>, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in ENTITIES.items()) + f", usage {USAGE}"
#: Closed sets; a value outside them makes a document invalid.
CHOICES = {
    ("fields", "source"): ("spoken", "shown", "both", "observed", "inferred"),
    ("requirements", "confidence"): ("high", "medium", "low"),
    ("requirements", "priority"): ("must", "should", "could", "unknown"),
}


def entities(analyses: DataFrame) -> dict[str, DataFrame]:
    """One table per entity out of stored analyses, ``actors`` among them."""
    out = {}
    for name in ENTITIES:
        rows = analyses.select("run_id", F.posexplode(name).alias("pos", "x"))
        out[name] = rows.select("run_id", "pos", "x.*")
    out["criteria"] = out.pop("acceptance_criteria")
    out["actors"] = analyses.select("run_id", F.posexplode("actors").alias("pos", "actor"))
    return out


def recording_tables(recordings: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for name in ("keyframes", "segments", "moments"):
        rows = recordings.select("run_id", F.posexplode(name).alias("pos", "x"))
        out[name] = rows.select("run_id", "pos", "x.*")
    out["runs"] = recordings.select("run_id", "source", "duration", "transcript_source")
    return out


def assemble(tables: dict[str, DataFrame], heads: DataFrame) -> DataFrame:
    """Stored analyses again: ``heads`` has ``run_id, title, summary, usage``."""
    out = heads
    for name, fields in ENTITIES.items():
        t = tables["criteria" if name == "acceptance_criteria" else name]
        cols = [c.split(":")[0].strip("`") for c in _split(fields)]
        item = F.struct("pos", F.struct(*(F.col(f"`{c}`") for c in cols)).alias("x"))
        nested = t.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda i: i.x).alias(name))
        out = out.join(nested, "run_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    actors = tables["actors"].groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "actor"))), lambda i: i.actor).alias("actors"))
    out = out.join(actors, "run_id", "left").withColumn("actors", F.coalesce("actors", F.array().cast("array<string>")))
    return out.select("run_id", "title", "summary", "actors", *ENTITIES, "usage")


def _split(fields: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(fields[start:i])
            start = i + 1
    return [*parts, fields[start:]]
