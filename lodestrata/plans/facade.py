"""One object over a corpus's tables, with a method for each read."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import graph, incremental, lookup, retrieval, sessions, text
from lodestrata.session import table
from lodestrata.sources import code


class Corpus:
    """Tables of a data folder; every method gives a DataFrame that is computed when it is read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @property
    def sections(self) -> DataFrame:
        return self.table("sections").dropDuplicates(["id"])

    @property
    def all_symbols(self) -> DataFrame:
        return self.table("symbols").dropDuplicates(["id"])

    def survey(self, queries: DataFrame, k: int = 10, exclude: DataFrame | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
        """Symbols for queries (query_id, query) by their terms; ``exclude``: query_id, id."""
        docs = self.all_symbols.select(F.col("id").alias("doc_id"), "name", F.col("doc_comment").alias("doc"), F.col("signature").alias("sig"), F.lit("").alias("body"))
        index = retrieval.postings(docs)
        found = retrieval.sparse_search(index, retrieval.query_terms(queries, index), 3 * max(k, 10)).select("query_id", F.col("doc_id").alias("id"), "score")
        if exclude is not None:
            found = retrieval.excluding(found, exclude, 3 * max(k, 10))[0].drop("rank")
        return retrieval.merge_corpora(found.withColumn("corpus_id", F.regexp_extract("id", "^sym-([^/]*)/", 1)), boosts or {}, k)

    def read(self, ids: DataFrame) -> DataFrame:
        n = text.claims(self.sections).groupBy("section_id").agg(F.count("*").alias("claims_available"))
        return self.sections.join(ids, "id", "left_semi").join(n, F.col("id") == F.col("section_id"), "left").drop("section_id")

    def extract_claims(self, ids: DataFrame) -> DataFrame:
        return text.claims(self.sections.join(ids, "id", "left_semi"))

    def related(self, claims: DataFrame, types: list[str] | None = None) -> DataFrame:
        out = text.relations(claims)
        return out.where(F.col("relation_type").isin(*types)) if types else out

    def compress(self, ids: DataFrame, k: int = 2) -> DataFrame:
        """The stored summary, else the best sentences; only where that is shorter."""
        s = self.sections.join(ids, "id", "left_semi")
        made = text.summaries(s.where("text is not null"), k).withColumnRenamed("summary", "made")
        return s.join(made, "id", "left").select("id", F.coalesce("summary", "made").alias("compressed"), "text").where("length(compressed) < length(text)").drop("text")

    def toc(self, document_id: str | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        t = lookup.toc(self.table("sections"))
        t = t.where(F.col("document_id") == document_id) if document_id else t
        return t.orderBy("document_id", "position").offset(offset).limit(limit)

    def symbols(self, query: str | None = None, kind: str | None = None, module: str | None = None, visibility: str | None = None) -> DataFrame:
        s = self.all_symbols
        if query:
            hit = graph.search_symbols(s, self.spark.createDataFrame([("q", query)], "query_id string, query string"))
            s = s.join(hit.select("id"), "id", "left_semi")
        s = s.where(F.lower(F.trim("kind")) == kind.lower()) if kind else s
        s = graph.in_module(s, module) if module else s
        s = s.where(F.col("visibility") == visibility) if visibility is not None else s
        return s.orderBy("file_path", "line_start", "id")

    def definition(self, ids: DataFrame) -> DataFrame:
        return lookup.definitions(self.all_symbols.join(ids, "id", "left_semi"), self.table("source_files"))

    def references(self, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
        r = graph.references(self.all_symbols, self.table("symbol_refs"), kinds)
        side = ids.select(F.col("id").alias("_id"))
        return r.join(side, F.col("_id") == F.col("from_symbol_id"), "left_semi").unionByName(r.join(side, F.col("_id") == F.col("to_symbol_id"), "left_semi")).distinct()

    def impact(self, ids: DataFrame, incoming: bool = True, depth: int = 10) -> DataFrame:
        return graph.impact(graph.call_edges(self.table("symbol_refs")), ids, incoming, depth)

    def dead_code(self, min_lines: int = 1, limit: int = 50) -> DataFrame:
        return graph.dead_code(self.all_symbols, self.table("symbol_refs"), min_lines).orderBy("file_path", "line_start", "id").limit(limit)

    def freshness(self) -> DataFrame:
        return incremental.freshness(self.table("source_files"), self.table("file_hashes"))

    def usage(self, deliveries: DataFrame, capacity: int) -> DataFrame:
        return sessions.usage(deliveries, capacity)

    def bridges(self, query: str | None = None, kind: str | None = None, language: str | None = None, file_path: str | None = None) -> DataFrame:
        """Links between the endpoints that are read from the source files."""
        read = code.read_endpoints(self.table("source_files")).dropDuplicates()
        ends = read.select(F.sha2(F.concat_ws("\u0001", "kind", "role", "path", "line", "binding_key"), 256).alias("id"), "kind", "role", "binding_key", F.lit(1.0).alias("confidence"), F.col("path").alias("file_path"), F.regexp_extract("binding_key", r"(\w+)$", 1).alias("symbol_name"), lookup.language("path").alias("language"), "line").dropDuplicates(["id"])
        side = lambda role: ends.where(F.col("role") == role).select("id", "kind", "binding_key", "confidence")
        details = graph.link_details(graph.bridge_links(side("export"), side("import")), ends.drop("kind", "role", "confidence"), self.all_symbols)
        return graph.filter_links(details, query, kind, language, file_path)

    def smells(self, vectors: DataFrame | None = None, only: list[str] | None = None, **least: float) -> DataFrame:
        """(principle, subject): what the detectors of architecture smells find.

        ``only`` names some of them; the least values go by the names of the
        detectors' parameters (min_cosine, min_overlap, min_files, min_packages,
        max_overlap, min_methods, share, min_edges).  Without vectors (id, vector)
        redundancy isn't looked for, and cohesion goes by callees alone.
        """
        y, r = self.all_symbols, self.table("symbol_refs")
        take = lambda *names: {n: least[n] for n in names if n in least}
        methods = graph.methods_of(y, ["struct", "impl", "class", "trait", "interface"])
        traits = y.where(F.lower(F.trim("kind")).isin("trait", "interface")).select(F.col("id").alias("container"))
        own = methods.join(traits, "container", "left_semi").select(F.col("container").alias("interface"), F.col("id").alias("method"))
        implements = r.where("ref_kind = 'implements'").select(F.col("to_symbol_id").alias("interface"), F.col("from_symbol_id").alias("implementor")).distinct()
        calls = graph.call_edges(r).select(F.col("src").alias("implementor"), F.col("dst").alias("method"))
        used = implements.join(own, "interface").join(calls, ["implementor", "method"], "left_semi").unionByName(implements.withColumn("method", F.lit(None).cast("string")))
        found = {
            "shotgun surgery": lambda: graph.shotgun(y, r, **take("min_files", "min_packages", "max_overlap")).select(F.col("name").alias("subject")),
            "concrete dependency": lambda: graph.concrete_dependencies(y, r).select(F.col("from_symbol_id").alias("subject")),
            "cyclic packages": lambda: graph.package_cycles(graph.package_edges(y, r, ["uses", "imports"]), **take("min_edges")).select(F.col("package").alias("subject")),
            "low cohesion": lambda: graph.low_cohesion(methods, graph.call_edges(r), vectors, **take("min_methods")).select(F.col("container").alias("subject")),
            "fat interface": lambda: graph.fat_interfaces(own, used, **take("share")).select(F.col("interface").alias("subject")),
            "redundancy": lambda: graph.redundancy(y, r, vectors, **take("min_cosine", "min_overlap")).select(F.col("cluster").alias("subject")),
            "dead code": lambda: graph.dead_code(y, r).select(F.col("id").alias("subject")),
        }
        names = [n for n in found if (only is None or n in only) and (vectors is not None or n != "redundancy")]
        parts = [found[n]().select(F.lit(n).alias("principle"), "subject").distinct() for n in names]
        return functools.reduce(DataFrame.unionByName, parts)
