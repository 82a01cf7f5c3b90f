"""Sitemaps, link lists and the page cache; pages themselves come from tables, nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.scalar import normalize_url


def sitemap_entries(maps: DataFrame) -> DataFrame:
    """(source, kind, position, url, lastmod) of sitemaps (source, xml), url sets and indexes alike."""
    plain = F.regexp_replace("xml", r"<!--[\s\S]*?-->|<\?[\s\S]*?\?>", "")
    block = F.regexp_extract_all(plain, F.lit(r"(?s)<(?:\w+:)?(?:url|sitemap)>(.*?)</(?:\w+:)?(?:url|sitemap)>"), 1)
    kind = F.when(plain.rlike(r"<(\w+:)?sitemapindex"), "index").otherwise("urlset")
    rows = maps.select("source", kind.alias("kind"), F.posexplode(block).alias("position", "entry"))
    text = lambda tag: F.trim(F.regexp_extract("entry", rf"(?s)<(?:\w+:)?{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:\w+:)?{tag}>", 1))
    url = F.replace(text("loc"), F.lit("&amp;"), F.lit("&"))
    return rows.select("source", "kind", "position", url.alias("url"), F.when(text("lastmod") != "", text("lastmod")).alias("lastmod")).where("url <> ''")


def select_pages(entries: DataFrame, prefix: str | None = None, max_pages: int = 50) -> DataFrame:
    """Entries whose path begins with a prefix, the first of each source in document order."""
    path = F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/"))
    kept = entries.where(path.startswith(prefix)) if prefix else entries
    return kept.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("position"))).where(F.col("r") <= max_pages).drop("r")


def link_lists(texts: DataFrame) -> DataFrame:
    """(source, title, description, section, optional, position, name, url, note) of link lists (source, text) in Markdown.

    The first ``# `` line is the title, quoted lines after it the description,
    ``## `` lines open sections, ``- [name](url): note`` lines are links.
    """
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    order = Window.partitionBy("source").orderBy("n")
    up = order.rowsBetween(Window.unboundedPreceding, 0)
    titled = lines.withColumn("title", F.first(F.when(F.col("line").startswith("# "), F.trim(F.expr("substring(line, 3)"))), ignorenulls=True).over(up)).where("title is not null")
    placed = titled.withColumn("section", F.last(F.when(F.col("line").startswith("## "), F.trim(F.expr("substring(line, 4)"))), ignorenulls=True).over(up))
    quoted = placed.where(F.col("section").isNull() & F.col("line").startswith(">")).groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.trim(F.expr("substring(line, 2)")).alias("t")))), lambda x: x["t"]), " ").alias("description"))
    link = r"^\s*[-*]\s+\[([^\]]*)\]\(([^)\s]+)\)(?:\s*:\s*(.*))?$"
    links = placed.where(F.col("section").isNotNull() & F.col("line").rlike(link))
    note = F.regexp_extract("line", link, 3)
    out = links.select("source", "title", "section", (F.lower("section") == "optional").alias("optional"), F.col("n").alias("position"), F.regexp_extract("line", link, 1).alias("name"), F.regexp_extract("line", link, 2).alias("url"), F.when(note != "", note).alias("note"))
    return out.join(quoted, "source", "left")


def resolve_url(base: Column, link: Column) -> Column:
    """An absolute address for a link on a page."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "/")
    joined = F.when(link.rlike(r"^[a-z][a-z0-9+.\-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), link)).when(link.startswith("/"), F.concat(root, link)).when(link.startswith("#"), base).otherwise(F.concat(folder, F.regexp_replace(link, r"^\./", "")))
    return normalize_url(joined)


def page_cache(pages: DataFrame) -> DataFrame:
    """Pages (url, content, etag, last_modified) under the hash of their normalised address; the last row of one address by last_modified counts."""
    n = pages.withColumn("url", normalize_url(F.col("url"))).where("url is not null")
    newest = n.groupBy("url").agg(F.max(F.struct("last_modified", "content", "etag")).alias("p"))
    return newest.select(F.sha2("url", 256).alias("key"), "url", "p.content", "p.etag", "p.last_modified", F.sha2("p.content", 256).alias("content_hash"))


def refresh_plan(cached: DataFrame, now: DataFrame) -> DataFrame:
    """(url, action): keep, update, add or drop, by etag, date and hash."""
    j = cached.select("url", "etag", "last_modified", "content_hash").join(now.select("url", F.col("etag").alias("e2"), F.col("last_modified").alias("l2"), F.col("content_hash").alias("h2"), F.lit(True).alias("there")), "url", "full_outer")
    same = F.coalesce(F.col("etag") == F.col("e2"), F.col("last_modified") == F.col("l2"), F.lit(False)) | F.coalesce(F.col("content_hash") == F.col("h2"), F.lit(False))
    return j.select("url", F.when(F.col("there").isNull(), "drop").when(F.col("content_hash").isNull(), "add").when(same, "keep").otherwise("update").alias("action"))
