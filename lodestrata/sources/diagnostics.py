"""Output of compilers and linters in one shape: tool, path, line, col, severity, code, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["source", "tool", "path", "line", "col", "severity", "code", "message"]


def _out(df: DataFrame, tool: str | Column, path: Column, line: Column, col: Column, severity: Column, code: Column, message: Column) -> DataFrame:
    return df.select("source", (F.lit(tool) if isinstance(tool, str) else tool).alias("tool"), path.alias("path"), line.cast("int").alias("line"), col.cast("int").alias("col"), severity.alias("severity"), code.alias("code"), message.alias("message"))


def cargo(outputs: DataFrame) -> DataFrame:
    """Lines of JSON messages; the primary span gives the place."""
    shape = "struct<reason:string,message:struct<level:string,message:string,code:struct<code:string>,spans:array<struct<file_name:string,line_start:int,column_start:int,is_primary:boolean>>>>"
    m = outputs.select("source", F.explode(F.split("text", r"\r?\n")).alias("l")).where("l like '{%'").select("source", F.from_json("l", shape).alias("m")).where("m.reason = 'compiler-message'")
    span = F.coalesce(F.try_element_at(F.filter("m.message.spans", lambda x: x["is_primary"]), F.lit(1)), F.try_element_at(F.col("m.message.spans"), F.lit(1)))
    rows = m.withColumn("s", span).where("s is not null")
    return _out(rows, "cargo", F.col("s.file_name"), F.col("s.line_start"), F.col("s.column_start"), F.col("m.message.level"), F.col("m.message.code.code"), F.col("m.message.message"))


def eslint(outputs: DataFrame) -> DataFrame:
    shape = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,column:int>>>>"
    f = outputs.select("source", F.explode(F.from_json("text", shape)).alias("f")).select("source", "f.filePath", F.explode("f.messages").alias("m"))
    return _out(f, "eslint", F.col("filePath"), F.col("m.line"), F.col("m.column"), F.when(F.col("m.severity") == 2, "error").otherwise("warning"), F.col("m.ruleId"), F.col("m.message"))


def ruff(outputs: DataFrame) -> DataFrame:
    shape = "array<struct<filename:string,code:string,message:string,location:struct<row:int,column:int>>>"
    m = outputs.select("source", F.explode(F.from_json("text", shape)).alias("m"))
    return _out(m, "ruff", F.col("m.filename"), F.col("m.location.row"), F.col("m.location.column"), F.lit("warning"), F.col("m.code"), F.col("m.message"))


def _lines(outputs: DataFrame, tool: str, pattern: str, groups: tuple[int, int, int, int, int, int]) -> DataFrame:
    rows = outputs.select("source", F.explode(F.split("text", r"\r?\n")).alias("l")).where(F.col("l").rlike(pattern))
    g = [F.regexp_extract("l", pattern, k) if k else F.lit(None).cast("string") for k in groups]
    return _out(rows, tool, g[0], g[1], g[2], g[3], F.when(g[4] != "", g[4]), g[5])


def tsc(outputs: DataFrame) -> DataFrame:
    return _lines(outputs, "tsc", r"^(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$", (1, 2, 3, 4, 5, 6))


def gcc(outputs: DataFrame) -> DataFrame:
    return _lines(outputs, "gcc", r"^([^:\s][^:]*):(\d+):(\d+): (?:fatal )?(error|warning|note): (.*?)(?: \[(-W[^\]]+)\])?$", (1, 2, 3, 4, 6, 5))


def sarif(outputs: DataFrame) -> DataFrame:
    place = "array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>"
    shape = f"struct<runs:array<struct<tool:struct<driver:struct<name:string>>,results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:{place}>>>>>"
    r = outputs.select("source", F.explode(F.from_json("text", shape)["runs"]).alias("r")).select("source", F.col("r.tool.driver.name").alias("t"), F.explode("r.results").alias("m"))
    rows = r.withColumn("p", F.try_element_at(F.col("m.locations"), F.lit(1))["physicalLocation"])
    return _out(rows, F.coalesce("t", F.lit("sarif")), F.col("p.artifactLocation.uri"), F.col("p.region.startLine"), F.col("p.region.startColumn"), F.coalesce("m.level", F.lit("warning")), F.col("m.ruleId"), F.col("m.message.text"))


def all_tools(outputs: DataFrame) -> DataFrame:
    """Diagnostics of outputs (source, tool, text)."""
    readers = {"cargo": cargo, "eslint": eslint, "ruff": ruff, "tsc": tsc, "gcc": gcc, "sarif": sarif}
    out = None
    for name, read in readers.items():
        part = read(outputs.where(F.col("tool") == name).drop("tool"))
        out = part if out is None else out.unionByName(part)
    return out
