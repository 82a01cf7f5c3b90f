"""Point lookups, listings, tables of contents and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S

# The language of an extension.
LANGUAGES = {"py": "python", "rs": "rust", "ts": "typescript", "js": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "json": "json", "toml": "toml", "md": "markdown"}


def language(path: str) -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])[ext], F.lit("other"))


def toc(sections: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """Sections in document order with their words and, given claims (section_id), their number; exact duplicates once."""
    s = sections.dropDuplicates(["id"])
    if claims is not None:
        n = claims.groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("claims"))
        return toc(sections).join(n, "id", "left").withColumn("claims", F.coalesce("claims", F.lit(0)))
    return s.select("document_id", "position", "id", "depth", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " > ").alias("heading"), F.when(F.col("text").isNull(), 0).otherwise(S.word_count(F.col("text"))).alias("words"))


def next_sections(sections: DataFrame) -> DataFrame:
    """(id, next_id) within a document by position."""
    s = sections.dropDuplicates(["id"])
    return s.select("id", F.lead("id").over(Window.partitionBy("document_id").orderBy("position", "id")).alias("next_id"))


def definitions(symbols: DataFrame, files: DataFrame, around: int = 3) -> DataFrame:
    """(id, heading, source): a symbol with its lines and some around them; null source where the file is gone."""
    s = symbols.dropDuplicates(["id"])
    j = s.join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    first = F.greatest(F.col("line_start") - around, F.lit(1))
    lines = F.slice(F.split("content", "\n"), first, F.greatest(F.col("line_end") + around - first + 1, F.lit(0)))
    heading = F.concat_ws(" > ", F.array_join(F.split("module_path", "::"), " > "), "name")
    return j.select("id", heading.alias("heading"), F.array_join(lines, "\n").alias("source"))


def symbol_at(occurrences: DataFrame, positions: DataFrame) -> DataFrame:
    """(pos_id, symbol_id) of the occurrence that holds a line and column; the end is exclusive."""
    o = occurrences.select(F.col("file_path").alias("f"), F.col("line").alias("l"), F.col("col").alias("c"), F.length("name").alias("len"), "symbol_id")
    return positions.join(o, (F.col("file_path") == F.col("f")) & (F.col("line") == F.col("l")) & (F.col("col") >= F.col("c")) & (F.col("col") < F.col("c") + F.col("len"))).select("pos_id", "symbol_id")


def language_stats(files: DataFrame) -> DataFrame:
    """(root_id, language, files)."""
    return files.groupBy("root_id", language("path").alias("language")).agg(F.count("*").alias("files"))


def corpus_stats(documents: DataFrame, sections: DataFrame, symbols: DataFrame) -> DataFrame:
    d = documents.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    s = sections.agg(F.countDistinct("id").alias("sections"))
    y = symbols.agg(F.countDistinct("id").alias("symbols"))
    return d.crossJoin(s).crossJoin(y)  # one row each


def resolve_content(sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """(resolution, content_id, text) of sections, summaries and both forms of symbols."""
    s, y = sections.dropDuplicates(["id"]), symbols.dropDuplicates(["id"])
    return (
        s.select(F.lit("section").alias("resolution"), F.col("id").alias("content_id"), "text")
        .unionByName(s.where("summary is not null").select(F.lit("summary").alias("resolution"), F.col("id").alias("content_id"), F.col("summary").alias("text")))
        .unionByName(y.select(F.lit("symbol-stub").alias("resolution"), F.col("id").alias("content_id"), F.concat_ws("\n", "signature", "doc_comment").alias("text")))
        .unionByName(y.select(F.lit("symbol-full").alias("resolution"), F.col("id").alias("content_id"), F.concat_ws("\n", F.format_string("%s:%d-%d", "file_path", "line_start", "line_end"), "signature").alias("text")))
    )


def document_list(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(source_path, title, root_id, sections): documents with how many sections they have."""
    n = sections.select("id", "document_id").distinct().groupBy(F.col("document_id").alias("source_path")).agg(F.count("*").alias("sections"))
    return documents.join(n, "source_path", "left").select("source_path", "title", "root_id", F.coalesce("sections", F.lit(0)).alias("sections"))


def absolute_paths(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, absolute): a path under a known root (root_id, folder) in its folder; absolute paths and those of unknown roots as they are."""
    r = roots.select(F.col("root_id").alias("_root"), "folder")
    first = F.substring_index("path", "/", 1)
    j = files.select("path").join(r, ~F.col("path").startswith("/") & (first == F.col("_root")), "left")
    rest = F.expr("substring(path, length(_root) + 2)")
    return j.select("path", F.when(F.col("folder").isNotNull(), F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), rest)).otherwise(F.col("path")).alias("absolute"))
