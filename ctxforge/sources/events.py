"""Tool events as JSON lines, batch or stream, and the request log as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "tool_name string, tool_input map<string,string>, tool_response string, prompt string"
REQUEST = "session_id long, event_id long, tool string, ts timestamp, original long, saved long"
REGISTRY = "version int, projects array<struct<id:string,name:string,path:string,port:int,language:string,registered_at:string,last_seen_at:string,session_count:int,total_saved:bigint>>"


def parse_events(lines: DataFrame) -> DataFrame:
    """lines (value) -> events; a line that is no JSON object has null fields. tool_response keeps its JSON."""
    parsed = F.from_json("value", "tool_name string, tool_input map<string,string>, prompt string")
    quoted = F.get_json_object("value", "$.tool_response")
    raw = F.when(F.ltrim(quoted).rlike(r"^[\[{]"), quoted).otherwise(F.regexp_extract(F.to_json(F.struct(quoted.alias("v"))), r"^\{\"v\":([\s\S]*)\}$", 1))
    return lines.select(parsed.alias("e"), F.when(quoted.isNotNull(), raw).alias("tool_response")).select("e.tool_name", "e.tool_input", "tool_response", "e.prompt")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.readStream.text(path))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(REQUEST).json(path)


def ingest_requests(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Append the requests that arrive as JSON files to a Parquet folder, each once; gives the running query. Started again
    with the same checkpoint, it goes on where it stopped."""
    return stream_requests(spark, source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a registry file; a corrupt file has none."""
    return spark.read.schema(REGISTRY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).select(F.explode("projects").alias("p")).select("p.*")


#: Projects of one registry file.
FILE_PROJECTS = 1000


def write_registry(projects: DataFrame, path: str) -> None:
    """To a new folder, which the caller swaps in: one file for a thousand projects or so, each a registry of its own."""
    files = max(1, -(-projects.count() // FILE_PROJECTS))
    dealt = projects.groupBy(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file")).agg(F.collect_list(F.struct(*projects.columns)).alias("projects"))
    dealt.select(F.lit(1).alias("version"), "projects").write.option("maxRecordsPerFile", 1).mode("errorifexists").json(path)


def all_projects(projects: DataFrame) -> DataFrame:
    """Latest seen first."""
    return projects.orderBy(F.desc("last_seen_at"), "id")


def get_project(projects: DataFrame, id_: str) -> DataFrame:
    return projects.where(F.col("id") == id_)


def remove_projects(projects: DataFrame, ids: DataFrame) -> DataFrame:
    return projects.join(ids.select("id").distinct(), "id", "left_anti")


def add_savings(projects: DataFrame, savings: DataFrame) -> DataFrame:
    """savings (id, saved, seen_at) added to the projects that are registered; others are dropped."""
    sums = savings.groupBy("id").agg(F.sum("saved").alias("_saved"), F.max("seen_at").alias("_seen"))
    both = projects.join(sums, "id", "left").withColumns({"total_saved": F.col("total_saved") + F.coalesce("_saved", F.lit(0)), "last_seen_at": F.coalesce("_seen", "last_seen_at")})
    return both.select(*projects.columns)
