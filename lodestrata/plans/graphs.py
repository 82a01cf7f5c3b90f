"""Queries over the symbol graph: references, impact, dead code, bridges, packages, smells."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators import graph as G
from lodestrata.operators import incremental as I
from lodestrata.plans.lookups import ARITY, SYMBOLS, TEST_PATH
from lodestrata.session import table
from lodestrata.sources import code


def _t(s, d):
    return table(s, d, "symbols"), table(s, d, "symbol_refs")


def references(s, d):
    return G.references(*_t(s, d)).select("from_symbol_id", "to_symbol_id", "ref_kind", "from_name", "to_name", "from_file", "to_file")


def reference_counts(s, d):
    y, r = _t(s, d)
    return G.references(y, r).groupBy("to_symbol_id").agg(F.count("*").alias("refs"), F.countDistinct("from_file").alias("files"))


def pending_refs(s, d):
    """References whose target isn't known."""
    y, r = _t(s, d)
    return r.dropDuplicates().join(y.select(F.col("id").alias("to_symbol_id")), "to_symbol_id", "left_anti").select("from_symbol_id", "to_symbol_id", "ref_kind")


def dead_code(s, d):
    return G.dead_code(*_t(s, d), min_lines=3).select("id", "file_path", "line_start")


QUERY_WORDS = [("q1", "ring shard"), ("q2", "compactVector"), ("q3", "seal_heading"), ("q4", "HTTPServer"), ("q5", "zzz session"), ("q6", "x")]


def symbol_search(s, d):
    q = s.createDataFrame(QUERY_WORDS, "query_id string, query string")
    return G.search_symbols(table(s, d, "symbols").dropDuplicates(["id"]), q)


def _roots(s, d):
    ids = table(s, d, "id_map").where("int_id % 100 = 0 and vector_id like 'symbol-%'").select(F.regexp_replace("vector_id", "^[a-z-]+::", "").alias("id"))
    return ids.distinct()


def impact(s, d):
    """Callers of the stated query set, up to depth ten."""
    return G.impact(G.call_edges(table(s, d, "symbol_refs")), _roots(s, d))


def impact_outgoing(s, d):
    return G.impact(G.call_edges(table(s, d, "symbol_refs")), _roots(s, d), incoming=False, depth=3)


def impact_risk(s, d):
    y, r = _t(s, d)
    return G.impact_summary(G.impact(G.call_edges(r), _roots(s, d), depth=3), y)


def transitive_callers(s, d):
    return G.transitive_callers(G.call_edges(table(s, d, "symbol_refs")), _roots(s, d))


def diff_impact(s, d):
    """Symbols outside stale files' symbols that these are called by, by least depth; whole files count as changed."""
    y, r = _t(s, d)
    stale = I.freshness(table(s, d, "source_files"), table(s, d, "file_hashes")).where("state = 'stale'").select(F.col("path").alias("file_path"), F.lit(1).alias("lo"), F.lit(2**31 - 1).alias("hi"))
    return G.diff_impact(G.call_edges(r), G.overlapping(y, stale))


def enclosing_symbols(s, d):
    """The innermost symbol around the first line of each symbol."""
    y = table(s, d, "symbols").dropDuplicates(["id"])
    return G.enclosing(y, y.select(F.col("id").alias("pos_id"), "file_path", F.col("line_start").alias("line")))


def _endpoints(s, d, endings):
    y = table(s, d, "symbols").dropDuplicates(["id"]).where("lower(trim(kind)) in ('function', 'method')")
    named = y.where(F.regexp_extract("file_path", r"\.([a-z]+)$", 1).isin(*endings)).groupBy("name").agg(F.min("id").alias("id"))
    return named.select("id", F.lit("call").alias("kind"), F.col("name").alias("binding_key"), F.lit(1.0).alias("confidence"))


EXPORTS, IMPORTS = ["rs", "py"], ["ts", "js", "java"]


def bridge_links(s, d):
    """Rust and Python functions called by their names in TypeScript, JavaScript and Java."""
    return G.bridge_links(_endpoints(s, d, EXPORTS), _endpoints(s, d, IMPORTS))


def _details(s, d):
    y = table(s, d, "symbols").dropDuplicates(["id"])
    places = y.select("id", "file_path", F.col("name").alias("binding_key"), F.col("name").alias("symbol_name"), F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("language"), F.col("line_start").alias("line"))
    return G.link_details(bridge_links(s, d), places, y)


def bridge_details(s, d):
    return _details(s, d)


def bridge_filtered(s, d):
    """Links that have to do with rings, with TypeScript on either side."""
    return G.filter_links(_details(s, d), query="SE", language="TS").select("kind", "export_id", "import_id", "confidence")


def bridge_nodes(s, d):
    return G.bridge_graph(_details(s, d))[0]


def bridge_references(s, d):
    """References, with links of endpoints as references of kind bridge."""
    y, r = _t(s, d)
    return G.references_over_bridges(y, r, _details(s, d)).groupBy("ref_kind").agg(F.count("*").alias("refs"), F.countDistinct("to_symbol_id").alias("targets"))


def endpoint_links(s, d):
    """Links between the endpoints that are read from the source files themselves."""
    e = code.read_endpoints(table(s, d, "source_files")).withColumn("id", F.sha2(F.concat_ws("\u0001", "kind", "role", "path", "line", "binding_key"), 256)).dropDuplicates(["id"])
    side = lambda role: e.where(F.col("role") == role).select("id", "kind", "binding_key", F.lit(1.0).alias("confidence"))
    return G.bridge_links(side("export"), side("import")).groupBy("kind").agg(F.count("*").alias("links"))


def site_representatives(s, d):
    """Three places of each function name, in the order of files, and how many more there are."""
    y = table(s, d, "symbols").dropDuplicates(["id"]).where("lower(trim(kind)) in ('function', 'method')")
    return G.representatives(G.one_site_a_file(y, ["name"]), ["name"], ["file_path", "id"], 3)


def package_edges(s, d):
    return G.package_edges(*_t(s, d), kinds=["uses", "imports"])


def package_cycles(s, d):
    e = G.package_edges(*_t(s, d), kinds=["uses", "imports"])
    return G.package_cycles(e, 2)


def shotgun(s, d):
    return G.shotgun(*_t(s, d), min_files=2).withColumn("avg_jaccard", F.round("avg_jaccard", 6))


def _stubs(s, d):
    """Vectors of symbols (id, vector) of the index's length; of several the least array."""
    v = table(s, d, "vectors").join(F.broadcast(table(s, d, "hnsw_config").select("dimension").limit(1)), F.size("vector") == F.col("dimension"))  # one row
    good = v.where("resolution = 'symbol-full'").where(~S.degenerate(S.as_double(F.col("vector"))))
    return good.groupBy(F.col("content_id").alias("id")).agg(F.min("vector").alias("vector"))


def low_cohesion(s, d):
    """Files as containers of their functions, which belong together by callees or alike vectors."""
    y, r = _t(s, d)
    m = y.dropDuplicates(["id"]).where("lower(trim(kind)) in ('function', 'method')").select(F.col("file_path").alias("container"), "id")
    return G.low_cohesion(m, G.call_edges(r, ["calls"]), _stubs(s, d))


def fat_interfaces(s, d):
    """Packages as interfaces of their files' functions, files as implementors of those that they call."""
    y, r = _t(s, d)
    f = y.dropDuplicates(["id"]).where("lower(trim(kind)) in ('function', 'method')")
    methods = f.select(G.package_of(F.col("file_path")).alias("interface"), F.col("id").alias("method"))
    used = G.references(y, r, ["calls"]).select(G.package_of(F.col("to_file")).alias("interface"), F.col("from_file").alias("implementor"), F.col("to_symbol_id").alias("method"))
    return G.fat_interfaces(methods, used)


def concrete_dependencies(s, d):
    return G.concrete_dependencies(*_t(s, d))


def call_components(s, d):
    """Connected components of the implements graph."""
    e = table(s, d, "symbol_refs").where("ref_kind = 'implements' and from_symbol_id <> to_symbol_id").select(F.col("from_symbol_id").alias("a"), F.col("to_symbol_id").alias("b"))
    return G.components(e)


def redundancy(s, d):
    """Functions alike in vector and targets; the least values are lower than the default, which these data never reach."""
    y, r = _t(s, d)
    out = G.redundancy(y, r, _stubs(s, d), min_cosine=0.3, min_overlap=0.1)
    return out.withColumn("avg_cosine", F.round("avg_cosine", 5)).withColumn("avg_jaccard", F.round("avg_jaccard", 5))


def resolved_references(s, d):
    """The target names of calls resolved anew from the caller's file."""
    y, r = _t(s, d)
    j = G.references(y, r, ["calls"]).select(F.concat_ws(">", "from_symbol_id", "to_symbol_id").alias("ref_id"), F.col("from_file").alias("file_path"), F.col("to_name").alias("name")).distinct()
    return G.resolve_references(j, y)


def impact_tests(s, d):
    """Tests that the stated symbols reach by their callers."""
    y, r = _t(s, d)
    return G.impact_listing(G.impact(G.call_edges(r), _roots(s, d), depth=3), y, tests_only=True).select("root", "id", "depth", "file_path")


def impact_report(s, d):
    y, r = _t(s, d)
    return G.impact_report(G.call_edges(r), _roots(s, d), 20, 100)


def container_methods(s, d):
    """Methods of classes and interfaces by their module paths."""
    return G.methods_of(table(s, d, "symbols"), ["struct", "class", "interface", "trait", "impl", "function"])


def implementor_references(s, d):
    return G.through_implementors(table(s, d, "symbol_refs"))


def occurrence_symbols(s, d):
    """Symbols by the occurrences that resolve to them."""
    o = code.read_occurrences(table(s, d, "source_files"))
    return G.resolve_occurrences(o, table(s, d, "symbols")).groupBy("symbol_id").agg(F.count("*").alias("occurrences"))


QUERIES = {
    f.__name__: f
    for f in (
        impact_tests, impact_report, container_methods, implementor_references, occurrence_symbols, references, reference_counts, pending_refs, dead_code, symbol_search, impact, impact_outgoing, impact_risk, transitive_callers, diff_impact, enclosing_symbols, bridge_links,
        bridge_details, bridge_filtered, bridge_nodes, bridge_references, endpoint_links, site_representatives, package_edges, package_cycles, shotgun, low_cohesion, fat_interfaces, concrete_dependencies, call_components, redundancy, resolved_references,
    )
}

_REF = f"""S AS {SYMBOLS}, R AS (SELECT DISTINCT from_symbol_id, to_symbol_id, ref_kind FROM symbol_refs),
 J AS (SELECT R.*, a.name AS from_name, a.file_path AS from_file, b.name AS to_name, b.file_path AS to_file FROM R JOIN S a ON a.id = from_symbol_id JOIN S b ON b.id = to_symbol_id)"""
_ROOTS = "roots AS (SELECT DISTINCT regexp_replace(vector_id, '^[a-z-]+::', '') AS id FROM id_map WHERE int_id % 100 = 0 AND vector_id LIKE 'symbol-%')"
_CALLS = "e AS (SELECT DISTINCT from_symbol_id AS src, to_symbol_id AS dst FROM symbol_refs WHERE ref_kind = 'calls' AND from_symbol_id <> to_symbol_id)"
_BFS = "b AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, {next}, depth + 1 FROM b JOIN e ON e.{at} = b.id WHERE depth < {n}), m AS (SELECT root, id, min(depth) AS depth FROM b GROUP BY 1, 2)"
_PKG = "string_split({0}, '/')[1]"
_FUN = "lower(trim(kind)) IN ('function', 'method')"
_TOKENS = r"list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace(query, '\s+', '_', 'g'), '(\p{Lu})', '_\1', 'g'), '_'), lambda t: lower(t)), lambda t: length(t) >= 2)))"
_EDGES = f"p AS (SELECT {_PKG.format('from_file')} AS from_pkg, {_PKG.format('to_file')} AS to_pkg FROM J WHERE ref_kind IN ('uses', 'imports') AND from_name <> to_name AND NOT {TEST_PATH.replace('lower(p)', 'lower(from_file)')} AND NOT {TEST_PATH.replace('lower(p)', 'lower(to_file)')}), pe AS (SELECT from_pkg, to_pkg, count(*) AS edges FROM p WHERE from_pkg <> to_pkg GROUP BY 1, 2)"
_SNAKE = r"CASE WHEN contains({0}, '_') THEN {0} ELSE lower(regexp_replace({0}, '(\p{{Ll}})(\p{{Lu}})', '\1_\2', 'g')) END"

_REF_ONLY = _REF
_END = "lower(regexp_extract({0}, '\\.([A-Za-z0-9]+)$', 1))"
_FAMILY = "CASE " + " ".join(f"WHEN {_END} IN ({', '.join(repr(e) for e in ends.split())}) THEN '{k}'" for k, ends in S.FAMILIES.items()) + f" ELSE {_END} END"
_BRIDGE = f"""S AS {SYMBOLS}, xx AS (SELECT name AS k, min(id) AS id FROM S WHERE {_FUN} AND regexp_extract(file_path, '\\.([a-z]+)$', 1) IN ('rs', 'py') GROUP BY 1), yy AS (SELECT name AS k, min(id) AS id FROM S WHERE {_FUN} AND regexp_extract(file_path, '\\.([a-z]+)$', 1) IN ('ts', 'js', 'java') GROUP BY 1),
 bl AS (SELECT 'call' AS kind, xx.id AS export_id, yy.id AS import_id, 1.0::DOUBLE AS confidence FROM xx JOIN yy ON xx.k = yy.k UNION ALL SELECT 'call', xx.id, yy.id, 0.9::DOUBLE FROM xx JOIN yy ON {_SNAKE.format('xx.k')} = {_SNAKE.format('yy.k')} AND xx.k <> yy.k WHERE xx.k NOT IN (SELECT k FROM yy) AND yy.k NOT IN (SELECT k FROM xx)),
 ep AS (SELECT a.id, a.file_path, a.name AS binding_key, a.name AS symbol_name, regexp_extract(a.file_path, '\\.([a-z]+)$', 1) AS language, a.line_start AS line, min(b.id) AS symbol_id FROM S a LEFT JOIN S b ON b.file_path = a.file_path AND b.name = a.name AND a.line_start BETWEEN b.line_start AND b.line_end GROUP BY ALL),
 bd AS (SELECT kind, confidence, {", ".join(f"{q}.{c} AS {e}_{c}" for q, e in (("ex", "export"), ("im", "import")) for c in ("id", "file_path", "binding_key", "symbol_name", "language", "line", "symbol_id"))} FROM bl JOIN ep ex ON ex.id = bl.export_id JOIN ep im ON im.id = bl.import_id)"""
_TARGETS = "tg AS (SELECT from_symbol_id AS id, list(DISTINCT to_symbol_id) AS t FROM symbol_refs WHERE ref_kind IN ('calls', 'uses', 'imports') GROUP BY 1)"
_JACCARD = "CASE WHEN len(a.t) + len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE ELSE 0.0 END"
_STUBS = """sv AS (SELECT content_id AS id, min(vector)::DOUBLE[] AS v FROM vectors, hnsw_config WHERE resolution = 'symbol-full' AND len(vector) = dimension AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
 AND list_sum(list_transform(vector, lambda x: x::DOUBLE * x)) >= 1e-12 GROUP BY 1)"""

ORACLE = {
    "implementor_references": """WITH i AS (SELECT DISTINCT from_symbol_id AS impl, to_symbol_id AS trait FROM symbol_refs WHERE ref_kind = 'implements' AND from_symbol_id <> to_symbol_id)
        SELECT DISTINCT trait, r.from_symbol_id FROM symbol_refs r JOIN i ON i.impl = r.to_symbol_id WHERE r.ref_kind IN ('calls', 'uses') AND (trait, r.from_symbol_id) NOT IN (SELECT (to_symbol_id, from_symbol_id) FROM symbol_refs)""",
    "references": f"WITH {_REF} SELECT from_symbol_id, to_symbol_id, ref_kind, from_name, to_name, from_file, to_file FROM J",
    "reference_counts": f"WITH {_REF} SELECT to_symbol_id, count(*) AS refs, count(DISTINCT from_file) AS files FROM J GROUP BY 1",
    "pending_refs": "SELECT DISTINCT from_symbol_id, to_symbol_id, ref_kind FROM symbol_refs WHERE to_symbol_id NOT IN (SELECT id FROM symbols)",
    "dead_code": f"""SELECT id, file_path, line_start FROM {SYMBOLS} s WHERE NOT starts_with(coalesce(visibility, ''), 'pub') AND name NOT IN ('main', '_main', '_start') AND line_end - line_start + 1 >= 3
        AND NOT EXISTS (SELECT 1 FROM symbol_refs r WHERE r.from_symbol_id = s.id OR r.to_symbol_id = s.id)""",
    "symbol_search": "WITH q(query_id, query) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUERY_WORDS) + f"""), t AS (SELECT query_id, {_TOKENS} AS ts FROM q),
        c AS (SELECT query_id, id, len(list_filter(ts, lambda x: contains(lower(name), x))) AS n, len(ts) AS k FROM t, {SYMBOLS} s WHERE len(ts) > 0), h AS (SELECT *, max(CASE WHEN n = k THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS f FROM c WHERE n > 0)
        SELECT DISTINCT query_id, id FROM h WHERE n = k OR f = 0""",
    "impact": f"WITH RECURSIVE {_ROOTS}, {_CALLS}, {_BFS.format(next='src', at='dst', n=10)} SELECT root, id, depth FROM m WHERE depth > 0",
    "impact_outgoing": f"WITH RECURSIVE {_ROOTS}, {_CALLS}, {_BFS.format(next='dst', at='src', n=3)} SELECT root, id, depth FROM m WHERE depth > 0",
    "impact_risk": f"""WITH RECURSIVE {_ROOTS}, {_CALLS}, {_BFS.format(next='src', at='dst', n=3)}, x AS (SELECT root, count(DISTINCT s.id) AS symbols, count(DISTINCT file_path) AS files, count(DISTINCT CASE WHEN {TEST_PATH.replace('lower(p)', 'lower(file_path)')} THEN file_path END) AS tests
        FROM m JOIN {SYMBOLS} s ON s.id = m.id WHERE depth > 0 GROUP BY 1)
        SELECT *, CASE WHEN symbols + 2 * files + 3 * tests > 50 OR files > 10 THEN 'high' WHEN symbols + 2 * files + 3 * tests > 15 OR files > 3 THEN 'medium' ELSE 'low' END AS risk FROM x""",
    "transitive_callers": f"""WITH RECURSIVE {_ROOTS}, {_CALLS}, b AS (SELECT id AS root, id, 0 AS depth FROM roots UNION SELECT root, src, depth + 1 FROM b JOIN e ON e.dst = b.id WHERE depth < 10)
        SELECT root AS id, count(DISTINCT id) AS callers FROM b WHERE depth > 0 GROUP BY 1""",
    "diff_impact": f"""WITH RECURSIVE h AS (SELECT path, arg_max(content_hash, {{'m': coalesce(mtime_ns, -1), 'e': extractor_version, 'r': resolver_version, 'c': content_hash}}) AS content_hash FROM file_hashes GROUP BY 1),
        st AS (SELECT f.path FROM source_files f JOIN h ON h.path = f.path WHERE sha256(f.content) <> h.content_hash), roots AS (SELECT DISTINCT s.id FROM {SYMBOLS} s JOIN st ON st.path = s.file_path WHERE 1 <= line_end),
        {_CALLS}, b AS (SELECT id, 0 AS depth FROM roots UNION SELECT src, depth + 1 FROM b JOIN e ON e.dst = b.id WHERE depth < 10) SELECT id, min(depth) AS depth FROM b GROUP BY 1 HAVING min(depth) > 0""",
    "enclosing_symbols": f"""WITH S AS {SYMBOLS} SELECT a.id AS pos_id, arg_min(b.id, {{'n': b.line_end - b.line_start, 'i': b.id}}) AS symbol_id FROM S a JOIN S b ON a.file_path = b.file_path AND a.line_start BETWEEN b.line_start AND b.line_end GROUP BY 1""",
    "bridge_links": f"""WITH S AS {SYMBOLS}, x AS (SELECT name AS k, min(id) AS id FROM S WHERE {_FUN} AND regexp_extract(file_path, '\\.([a-z]+)$', 1) IN ('rs', 'py') GROUP BY 1), y AS (SELECT name AS k, min(id) AS id FROM S WHERE {_FUN} AND regexp_extract(file_path, '\\.([a-z]+)$', 1) IN ('ts', 'js', 'java') GROUP BY 1)
        SELECT 'call' AS kind, x.id AS export_id, y.id AS import_id, 1.0::DOUBLE AS confidence FROM x JOIN y ON x.k = y.k
        UNION ALL SELECT 'call', x.id, y.id, 0.9::DOUBLE FROM x JOIN y ON {_SNAKE.format('x.k')} = {_SNAKE.format('y.k')} AND x.k <> y.k WHERE x.k NOT IN (SELECT k FROM y) AND y.k NOT IN (SELECT k FROM x)""",
    "package_edges": f"WITH {_REF}, {_EDGES} SELECT from_pkg, to_pkg, edges FROM pe",
    "package_cycles": f"""WITH RECURSIVE {_REF}, {_EDGES}, st AS (SELECT from_pkg AS a, to_pkg AS b FROM pe WHERE edges >= 2), rc AS (SELECT a, b FROM st UNION SELECT rc.a, st.b FROM rc JOIN st ON rc.b = st.a),
        mu AS (SELECT x.a AS package, x.b AS other FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a) SELECT package, least(package, min(other)) AS cycle FROM mu GROUP BY package HAVING count(DISTINCT other) >= 2""",
    "bridge_details": f"WITH {_BRIDGE} SELECT * FROM bd",
    "bridge_filtered": f"""WITH {_BRIDGE} SELECT kind, export_id, import_id, confidence FROM bd WHERE (contains(lower(export_binding_key), 'se') OR contains(lower(import_binding_key), 'se') OR contains(lower(export_symbol_name), 'se') OR contains(lower(import_symbol_name), 'se'))
        AND (lower(export_language) = 'ts' OR lower(import_language) = 'ts')""",
    "bridge_nodes": f"WITH {_BRIDGE} SELECT DISTINCT export_id AS id, 'export' AS role, export_file_path AS file_path, export_symbol_name AS label, export_language AS language FROM bd UNION SELECT import_id, 'import', import_file_path, import_symbol_name, import_language FROM bd",
    "bridge_references": f"""WITH {_REF_ONLY}, {_BRIDGE.replace('S AS ' + SYMBOLS + ', ', '', 1)}, al AS (SELECT from_symbol_id, to_symbol_id, ref_kind FROM J UNION SELECT import_symbol_id, export_symbol_id, 'bridge' FROM bd WHERE import_symbol_id IS NOT NULL AND export_symbol_id IS NOT NULL)
        SELECT ref_kind, count(*) AS refs, count(DISTINCT to_symbol_id) AS targets FROM al GROUP BY 1""",
    "site_representatives": f"""WITH x AS (SELECT name, id, file_path, row_number() OVER (PARTITION BY name, file_path ORDER BY line_start, id) AS q FROM {SYMBOLS} WHERE {_FUN}), y AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY file_path, id) AS r FROM x WHERE q = 1)
        SELECT name, list(id ORDER BY r) FILTER (r <= 3) AS kept, greatest(0, count(*) - 3) AS omitted FROM y GROUP BY 1""",
    "shotgun": f"""WITH x AS (SELECT *, lower(trim(kind)) AS k FROM {SYMBOLS} WHERE {_FUN} AND name NOT IN ({", ".join(f"'{n}'" for n in S.CONVENTIONAL_NAMES)})), si AS (SELECT name, k, id, file_path FROM x QUALIFY row_number() OVER (PARTITION BY name, k, file_path ORDER BY line_start, id) = 1),
        w AS (SELECT name, k, count(*) AS files, count(DISTINCT {_PKG.format('file_path')}) AS packages FROM si GROUP BY 1, 2 HAVING files >= 2 AND packages >= 2), {_TARGETS},
        o AS (SELECT si.name, si.k, si.id, coalesce(t, []) AS t FROM si JOIN w USING (name, k) LEFT JOIN tg ON tg.id = si.id),
        pr AS (SELECT a.name, a.k, {_JACCARD} AS jac FROM o a JOIN o b ON a.name = b.name AND a.k = b.k AND a.id < b.id), av AS (SELECT name, k, avg(jac) AS aj FROM pr GROUP BY 1, 2)
        SELECT w.name, w.k AS kind, files, packages, round(aj, 6) AS avg_jaccard FROM w JOIN av USING (name, k) WHERE aj <= 0.5""",
    "low_cohesion": f"""WITH RECURSIVE {_STUBS}, m AS (SELECT file_path AS c, id FROM {SYMBOLS} WHERE {_FUN}), mn AS (SELECT c, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 4), mm AS (SELECT m.* FROM m JOIN mn USING (c)),
        ca AS (SELECT DISTINCT from_symbol_id AS id, to_symbol_id AS dst FROM symbol_refs WHERE ref_kind = 'calls' AND from_symbol_id <> to_symbol_id),
        ed AS (SELECT a.c, a.id AS x, b.id AS y FROM mm a JOIN mm b ON a.c = b.c AND a.id <> b.id JOIN ca p ON p.id = a.id JOIN ca q ON q.id = b.id AND q.dst = p.dst
          UNION SELECT a.c, a.id, b.id FROM mm a JOIN mm b ON a.c = b.c AND a.id <> b.id JOIN sv u ON u.id = a.id JOIN sv v ON v.id = b.id WHERE list_cosine_similarity(u.v, v.v) >= 0.7),
        rc AS (SELECT c, id AS x, id AS y FROM mm UNION SELECT rc.c, rc.x, ed.y FROM rc JOIN ed ON ed.c = rc.c AND ed.x = rc.y), co AS (SELECT c, x, min(y) AS k FROM rc GROUP BY 1, 2), sz AS (SELECT c, k, count(*) AS n FROM co GROUP BY 1, 2 HAVING count(*) >= 2)
        SELECT c AS container, mn.n AS methods, count(*) AS parts FROM sz JOIN mn USING (c) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "redundancy": f"""WITH RECURSIVE {_STUBS}, {_TARGETS}, f AS (SELECT x.id, lower(trim(kind)) AS k, {ARITY} AS ar, file_path, line_end - line_start AS n, sv.v, coalesce(t, []) AS t FROM {SYMBOLS} x JOIN sv ON sv.id = x.id LEFT JOIN tg ON tg.id = x.id WHERE {_FUN}),
        pr AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS cos, {_JACCARD} AS jac FROM f a JOIN f b ON a.k = b.k AND a.ar = b.ar AND a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.3 AND {_JACCARD} >= 0.1),
        ed AS (SELECT x, y FROM pr UNION SELECT y, x FROM pr), rc AS (SELECT x, x AS y FROM ed UNION SELECT rc.x, ed.y FROM rc JOIN ed ON ed.x = rc.y), co AS (SELECT x AS id, min(y) AS cluster FROM rc GROUP BY 1),
        fa AS (SELECT cluster, count(*) AS members, arg_min(id, {{'n': -n, 'f': file_path, 'i': id}}) AS canonical, count(DISTINCT file_path) > 1 AS cross_module FROM co JOIN f USING (id) GROUP BY 1),
        av AS (SELECT cluster, avg(cos) AS c, avg(jac) AS j FROM pr JOIN co ON co.id = pr.x GROUP BY 1)
        SELECT id, cluster, members, canonical, round(c, 5) AS avg_cosine, round(j, 5) AS avg_jaccard, cross_module FROM co JOIN fa USING (cluster) JOIN av USING (cluster)""",
    "fat_interfaces": f"""WITH {_REF}, im AS (SELECT {_PKG.format('file_path')} AS interface, id AS method FROM S WHERE {_FUN}), sz AS (SELECT interface, count(*) AS methods FROM im GROUP BY 1 HAVING count(*) >= 6),
        us AS (SELECT DISTINCT {_PKG.format('to_file')} AS interface, from_file AS implementor, to_symbol_id AS method FROM J WHERE ref_kind = 'calls'), ov AS (SELECT interface, implementor, count(*) AS n FROM us JOIN im USING (interface, method) GROUP BY 1, 2),
        ev AS (SELECT DISTINCT interface, implementor FROM us), z AS (SELECT interface, methods, count(*) AS implementors, sum(CASE WHEN coalesce(n, 0) <= floor(0.33::DOUBLE * methods) THEN 1 ELSE 0 END)::BIGINT AS under_using FROM ev LEFT JOIN ov USING (interface, implementor) JOIN sz USING (interface) GROUP BY 1, 2)
        SELECT * FROM z WHERE 2 * under_using >= implementors""",
    "concrete_dependencies": f"""WITH {_REF}, ac AS (SELECT DISTINCT from_symbol_id, to_symbol_id FROM J WHERE ref_kind = 'uses' AND {_PKG.format('from_file')} <> {_PKG.format('to_file')} AND from_symbol_id IN (SELECT id FROM S WHERE {_FUN})),
        tr AS (SELECT DISTINCT from_symbol_id AS t, to_symbol_id AS trait FROM R WHERE ref_kind = 'implements'), ha AS (SELECT ac.*, trait FROM ac JOIN tr ON tr.t = ac.to_symbol_id)
        SELECT DISTINCT from_symbol_id, to_symbol_id FROM ha WHERE (from_symbol_id, to_symbol_id) NOT IN (SELECT (h.from_symbol_id, h.to_symbol_id) FROM ha h JOIN R ON R.from_symbol_id = h.from_symbol_id AND R.to_symbol_id = h.trait)""",
    "call_components": """WITH RECURSIVE g AS (SELECT from_symbol_id AS a, to_symbol_id AS b FROM symbol_refs WHERE ref_kind = 'implements' AND from_symbol_id <> to_symbol_id), u AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
        c AS (SELECT a AS node, a AS r FROM u UNION SELECT c.node, u.b FROM c JOIN u ON u.a = c.r) SELECT node, min(r) AS component FROM c GROUP BY 1""",
    "resolved_references": f"""WITH {_REF}, q AS (SELECT DISTINCT concat_ws('>', from_symbol_id, to_symbol_id) AS ref_id, from_file, to_name FROM J WHERE ref_kind = 'calls')
        SELECT ref_id, arg_min(S.id, {{'b': {_PKG.format('from_file')} <> {_PKG.format('file_path')}, 'c': from_file = file_path, 'i': S.id}}) AS symbol_id FROM q JOIN S ON S.name = to_name AND {_FAMILY.format('from_file')} = {_FAMILY.format('file_path')}
        WHERE lower(trim(kind)) IN ({", ".join(f"'{k}'" for k in G.TARGET_SYMBOLS)}) GROUP BY 1""",
    "impact_tests": f"WITH RECURSIVE {_ROOTS}, {_CALLS}, {_BFS.format(next='src', at='dst', n=3)} SELECT root, m.id, depth, file_path FROM m JOIN {SYMBOLS} s ON s.id = m.id WHERE depth > 0 AND {TEST_PATH.replace('lower(p)', 'lower(file_path)')}",
    "impact_report": f"""WITH RECURSIVE {_ROOTS}, sd AS (SELECT id FROM roots ORDER BY id LIMIT 20), {_CALLS}, b AS (SELECT id, 0 AS depth FROM sd UNION SELECT src, depth + 1 FROM b JOIN e ON e.dst = b.id WHERE depth < 10), m AS (SELECT id, min(depth) AS depth FROM b GROUP BY 1 HAVING min(depth) > 0)
        SELECT id, depth, greatest(0, (SELECT count(*) FROM roots) - 20)::INT AS seeds_omitted, greatest(0, (SELECT count(*) FROM m) - 100)::INT AS omitted FROM m ORDER BY depth, id LIMIT 100""",
    "container_methods": f"""WITH S AS {SYMBOLS}, h AS (SELECT file_path, CASE WHEN coalesce(module_path, '') = '' THEN name ELSE module_path || '::' || name END AS p, arg_min(id, {{'l': line_start, 'i': id}}) AS container FROM S WHERE lower(trim(kind)) IN ('struct', 'class', 'interface', 'trait', 'impl', 'function') GROUP BY 1, 2)
        SELECT container, id FROM S JOIN h ON h.file_path = S.file_path AND h.p = S.module_path WHERE {_FUN}""",
}
