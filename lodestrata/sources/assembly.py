"""Assembly sources: labels with their code, and what stands before the first one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What opens a section and no label, and with what a comment begins.
SECTION_WORDS = ["section", "segment", ".section", ".text", ".data", ".bss"]
COMMENT_SIGNS = ";#@"
_LABEL = r"^([A-Za-z_][A-Za-z0-9_@$.]*):(:?)"


def _comment(line: Column) -> Column:
    return F.trim(line).rlike(f"^[{COMMENT_SIGNS}]")


def read_assembly(files: DataFrame) -> DataFrame:
    """(path, position, label, exported, doc, text) of files (path, content): row 0 without a label is what stands before the first label.

    A label stands at the first place of its line; its text goes down to the next
    one; its comment is the last run of comment lines before it, over blank lines.
    """
    lines = files.where("length(content) > 0").select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "line"))
    name = F.regexp_extract("line", _LABEL, 1)
    marked = lines.withColumn("label", F.when((name != "") & ~F.lower(name).isin(*SECTION_WORDS), name)).withColumn("exported", F.regexp_extract("line", _LABEL, 2) == ":")
    file = Window.partitionBy("path").orderBy("n")
    placed = marked.withColumn("position", F.count("label").over(file))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    bodies = placed.groupBy("path", "position").agg(F.max("label").alias("label"), F.max(F.col("label").isNotNull() & F.col("exported")).alias("exported"), text.alias("text"))
    # the comment right before label p ends the part p - 1
    ends = placed.withColumn("sign", F.when(F.trim("line") == "", "blank").when(_comment(F.col("line")) & F.col("label").isNull(), "comment").otherwise("code"))
    back = Window.partitionBy("path", "position").orderBy(F.desc("n"))
    code = ends.withColumn("codes", F.count(F.when(F.col("sign") == "code", 1)).over(back)).withColumn("seen", F.count(F.when(F.col("sign") == "comment", 1)).over(back)).where("codes = 0")
    run = code.withColumn("gap", F.count(F.when((F.col("sign") == "blank") & (F.col("seen") > 0), 1)).over(back)).where("gap = 0 and sign = 'comment'")
    plain = F.ltrim(F.substring(F.trim("line"), 2, 1_000_000))
    docs = run.groupBy("path", (F.col("position") + 1).alias("position")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", plain.alias("line")))), lambda x: x["line"]), "\n").alias("doc"))
    return bodies.join(docs, ["path", "position"], "left").select("path", "position", "label", F.coalesce("exported", F.lit(False)).alias("exported"), F.when(F.col("position") > 0, F.col("doc")).alias("doc"), "text")
