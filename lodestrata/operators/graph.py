"""Symbols, references, impact, dead code, bridges, packages and architecture smells."""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions import scalar as S
from lodestrata.session import settle, wide

MAX_DEPTH = 10
#: Rows of a bucket that are compared at once.
BLOCK = 4096


def search_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id): names with all tokens of a query; where none has all, names with any.

    ``queries``: query_id, query.  A name that holds a token holds its first two
    letters, so names and tokens meet in a join on pairs of letters; neither side
    is broadcast by order or multiplied with the other.
    """
    tokens = queries.select("query_id", S.name_tokens(F.col("query")).alias("tokens")).where(F.size("tokens") > 0)
    asked = tokens.select("query_id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).withColumn("gram", F.substring("token", 1, 2))
    low = symbols.select("id", F.lower(F.col("name")).alias("low")).where("length(low) > 1")
    grams = low.select("id", "low", F.explode(F.expr("array_distinct(transform(sequence(1, length(low) - 1), i -> substring(low, i, 2)))")).alias("gram"))
    hits = grams.join(asked, "gram").where(F.col("low").contains(F.col("token"))).groupBy("query_id", "id", "n").agg(F.countDistinct("token").alias("held"))
    full = F.col("held") == F.col("n")
    return hits.withColumn("any_full", F.max(full).over(Window.partitionBy("query_id"))).where(full | ~F.col("any_full")).select("query_id", "id").distinct()


def in_module(symbols: DataFrame, module: str) -> DataFrame:
    return symbols.where((F.col("module_path") == module) | F.col("module_path").startswith(module + "::") | F.col("file_path").contains(module))


def references(symbols: DataFrame, refs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """References with both ends resolved; exact duplicates once."""
    r = refs.dropDuplicates() if kinds is None else refs.where(F.col("ref_kind").isin(*kinds)).dropDuplicates()
    s = symbols.dropDuplicates(["id"]).select("id", "name", "file_path")
    a = s.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("from_name"), F.col("file_path").alias("from_file"))
    b = s.select(F.col("id").alias("to_symbol_id"), F.col("name").alias("to_name"), F.col("file_path").alias("to_file"))
    return r.join(b, "to_symbol_id").join(a, "from_symbol_id")


def call_edges(refs: DataFrame, kinds: list[str] = ["calls"]) -> DataFrame:  # noqa: B006
    return refs.where(F.col("ref_kind").isin(*kinds)).select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst")).where("src <> dst").distinct()


def impact(edges: DataFrame, roots: DataFrame, incoming: bool = True, depth: int = MAX_DEPTH) -> DataFrame:
    """(root, id, depth): what is reached from each root within the depth, roots themselves left out; with a column ``root`` several ids are one root.

    A frontier join a round; the reached rows are written to the shared
    checkpoint folder every round, so plans stay short and lost executors do no harm.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    step = edges.select(F.col("dst").alias("at"), F.col("src").alias("next")) if incoming else edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    step = settle(step)
    frontier = settle(roots.select((F.col("root") if "root" in roots.columns else F.col("id")).alias("root"), F.col("id").alias("id")).distinct())
    seen = frontier
    out = None
    for d in range(1, depth + 1):
        near = frontier.join(step, frontier["id"] == step["at"]).select("root", F.col("next").alias("id")).distinct()
        frontier = settle(near.join(seen, ["root", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        part = frontier.withColumn("depth", F.lit(d))
        out = part if out is None else out.unionByName(part)
        seen = seen.unionByName(frontier)
    return out if out is not None else frontier.withColumn("depth", F.lit(0)).limit(0)


def diff_impact(edges: DataFrame, changed: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, depth): what calls the changed symbols, by least depth, these themselves left out; all are one root, so a symbol is reached once."""
    return impact(edges, changed.select(F.lit("changed").alias("root"), "id"), True, depth).select("id", "depth")


def transitive_callers(edges: DataFrame, roots: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(id, callers): distinct symbols on paths into each root within the depth; on a cycle the root counts itself."""
    step = settle(edges.select(F.col("dst").alias("at"), F.col("src").alias("next")))
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("id")).distinct()
    frontier, seen = settle(start), None
    for _ in range(depth):
        near = frontier.join(step, frontier["id"] == step["at"]).select("root", F.col("next").alias("id")).distinct()
        fresh = near if seen is None else near.join(seen, ["root", "id"], "left_anti")
        frontier = settle(fresh)
        if frontier.isEmpty():
            break
        seen = frontier if seen is None else seen.unionByName(frontier)
    if seen is None:
        return start.select(F.col("root").alias("id"), F.lit(0).cast("long").alias("callers")).limit(0)
    return seen.groupBy(F.col("root").alias("id")).agg(F.count("*").alias("callers"))


def dead_code(symbols: DataFrame, refs: DataFrame, min_lines: int = 1) -> DataFrame:
    """Symbols that aren't public, no entry point, long enough, and without a reference in either direction."""
    used = refs.select(F.col("from_symbol_id").alias("id")).unionByName(refs.select(F.col("to_symbol_id").alias("id"))).distinct()
    s = symbols.dropDuplicates(["id"]).where(~F.coalesce("visibility", F.lit("")).startswith("pub") & ~F.col("name").isin(*S.ENTRY_POINTS) & (F.col("line_end") - F.col("line_start") + 1 >= min_lines))
    return s.join(used, "id", "left_anti")


def overlapping(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """Symbols whose lines overlap a changed range (file_path, lo, hi) of their file."""
    s, r = symbols.dropDuplicates(["id"]).alias("s"), ranges.alias("r")
    return s.join(r, (F.col("s.file_path") == F.col("r.file_path")) & (F.col("s.line_start") <= F.col("r.hi")) & (F.col("r.lo") <= F.col("s.line_end")), "left_semi")


def enclosing(symbols: DataFrame, positions: DataFrame) -> DataFrame:
    """(pos_id, symbol_id): the smallest symbol whose lines hold a position (pos_id, file_path, line); ties by id."""
    s = symbols.dropDuplicates(["id"]).select("id", F.col("file_path").alias("f"), "line_start", "line_end")
    j = positions.join(s, (F.col("file_path") == F.col("f")) & F.col("line").between(F.col("line_start"), F.col("line_end")))
    return j.groupBy("pos_id").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "id"))["id"].alias("symbol_id"))


def impact_summary(reached: DataFrame, symbols: DataFrame) -> DataFrame:
    """(root, symbols, files, tests, risk)."""
    s = symbols.dropDuplicates(["id"]).select("id", "file_path")
    j = reached.join(s, "id")
    out = j.groupBy("root").agg(F.countDistinct("id").alias("symbols"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(S.is_test_path(F.col("file_path")), F.col("file_path"))).alias("tests"))
    return out.withColumn("risk", S.risk(F.col("symbols"), F.col("files"), F.col("tests")))


def bridge_links(exports: DataFrame, imports: DataFrame) -> DataFrame:
    """(kind, export_id, import_id, confidence): exact keys first; endpoints left over by key in snake case, at most 0.9.

    Endpoints: id, kind, binding_key, confidence.
    """
    e = exports.select(F.col("id").alias("export_id"), "kind", F.col("binding_key").alias("ek"), F.col("confidence").alias("ec"))
    i = imports.select(F.col("id").alias("import_id"), F.col("kind").alias("ik"), F.col("binding_key").alias("mk"), F.col("confidence").alias("ic"))
    exact = e.join(i, (F.col("kind") == F.col("ik")) & (F.col("ek") == F.col("mk"))).select("kind", "export_id", "import_id", F.least("ec", "ic").alias("confidence"))
    e2 = e.join(i, (F.col("kind") == F.col("ik")) & (F.col("ek") == F.col("mk")), "left_anti").withColumn("n", S.binding_key(F.col("ek")))
    i2 = i.join(e, (F.col("kind") == F.col("ik")) & (F.col("ek") == F.col("mk")), "left_anti").withColumn("m", S.binding_key(F.col("mk")))
    loose = e2.join(i2, (F.col("kind") == F.col("ik")) & (F.col("n") == F.col("m")) & (F.col("ek") != F.col("mk"))).select("kind", "export_id", "import_id", F.least("ec", "ic", F.lit(0.9)).alias("confidence"))
    return exact.unionByName(loose)


def corpus_root(symbols: DataFrame) -> str:
    """The leading path segments that all files share, with a closing slash; empty if there are none.

    What the least and the greatest path share, all share; so one row is read.
    """
    ends = symbols.where("file_path is not null").agg(F.min(F.split("file_path", "/")).alias("a"), F.max(F.split("file_path", "/")).alias("b")).collect()[0]
    shared = [x for x, _ in itertools.takewhile(lambda e: e[0] == e[1], zip(ends.a or [], ends.b or []))]
    return "/".join(shared) + "/" if any(shared) else ""


def package_of(path: Column, root: str = "") -> Column:
    """The first segment after the root that all files share."""
    rest = F.when(path.startswith(root), F.substring(path, len(root) + 1, 1_000_000)).otherwise(path) if root else path
    return F.coalesce(F.try_element_at(F.filter(F.split(rest, "/"), lambda x: x != ""), F.lit(1)), F.lit(""))


def package_edges(symbols: DataFrame, refs: DataFrame, kinds: list[str]) -> DataFrame:
    """(from_pkg, to_pkg, edges) between packages; tests and twins of one name are left out."""
    root = corpus_root(symbols)
    r = references(symbols, refs, kinds).where(~S.is_test_path(F.col("from_file")) & ~S.is_test_path(F.col("to_file")) & (F.col("from_name") != F.col("to_name")))
    p = r.select(package_of(F.col("from_file"), root).alias("from_pkg"), package_of(F.col("to_file"), root).alias("to_pkg")).where("from_pkg <> to_pkg")
    return p.groupBy("from_pkg", "to_pkg").agg(F.count("*").alias("edges"))


def package_cycles(edges: DataFrame, min_edges: int = 2) -> DataFrame:
    """(package, cycle): packages that reach each other over edges of the least weight; the cycle is named by its least member.

    The closure is over packages, not symbols: edges are aggregated first.
    """
    step = settle(edges.where(F.col("edges") >= min_edges).select(F.col("from_pkg").alias("a"), F.col("to_pkg").alias("b")).distinct())
    reach, n = step, step.count()
    while True:
        near = reach.select(F.col("a").alias("x"), F.col("b").alias("y")).join(step.select(F.col("a").alias("y"), F.col("b").alias("z")), "y").select(F.col("x").alias("a"), F.col("z").alias("b"))
        reach = settle(reach.select("a", "b").union(near).distinct())
        now = reach.count()
        if now == n:
            break
        n = now
    mutual = reach.alias("x").join(reach.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select(F.col("x.a").alias("package"), F.col("x.b").alias("other"))
    return mutual.groupBy("package").agg(F.min("other").alias("least"), F.countDistinct("other").alias("n")).where("n >= 2").select("package", F.least("package", "least").alias("cycle"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node of each connected component, by label propagation with pointer jumping; lineage is cut every round."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("component").alias("least"))
        lower = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("least", "component")).alias("component"), F.col("component").alias("old"))
        jumped = lower.alias("l").join(labels.select(F.col("node").alias("n"), F.col("component").alias("c")), F.col("l.component") == F.col("n"), "left").select("node", F.least("l.component", F.coalesce("c", "l.component")).alias("component"), "old")
        new = settle(jumped)
        if new.where("component <> old").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def neighbour_sets(refs: DataFrame, kinds: list[str]) -> DataFrame:
    """(id, targets): distinct targets of a symbol."""
    return refs.where(F.col("ref_kind").isin(*kinds)).groupBy(F.col("from_symbol_id").alias("id")).agg(F.array_sort(F.collect_set("to_symbol_id")).alias("targets"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def _alike_edges(part: pd.DataFrame, min_cosine: float, min_overlap: float) -> pd.DataFrame:
    """Edges (a, b) that connect what is alike among the rows (id, v, targets): a spanning forest of the alike pairs.

    Searched breadth first: a matrix product compares part of the front with all rows not yet reached.
    """
    part = part.sort_values("id")  # the same forest whenever it is computed
    unit = np.stack(part["v"].to_numpy()).astype(np.float64)
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    ids, targets = part["id"].to_numpy(), [set(t) for t in part["targets"]] if min_overlap > 0 else []
    left, front, edges = np.arange(len(ids)), [], []
    while len(left):
        if not front:
            front, left = [left[:1]], left[1:]
        now = front.pop()
        if len(now) > 256:
            front.append(now[256:])
            now = now[:256]
        alike = unit[now] @ unit[left].T >= min_cosine
        if min_overlap > 0:
            for f, u in zip(*np.nonzero(alike)):
                x, y = targets[now[f]], targets[left[u]]
                alike[f, u] = bool(x or y) and len(x & y) / len(x | y) >= min_overlap
        reached = alike.any(axis=0)
        if reached.any():
            edges.append((ids[now[alike.argmax(axis=0)[reached]]], ids[left[reached]]))
            front.append(left[reached])
            left = left[~reached]
    a, b = (np.concatenate(x) for x in zip(*edges)) if edges else ([], [])
    return pd.DataFrame({"a": a, "b": b}, dtype=object)


def _in_blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, id, …) with the pair of blocks (i, j) in which they are compared and their own block ``p``; no pair of blocks holds more than about two blocks."""
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    same = functools.reduce(lambda x, y: x & y, [rows[k].eqNullSafe(size[k]) for k in keys])
    held = rows.join(size.withColumn("_blocks", F.ceil(F.col("_n") / BLOCK).cast("int")), same).drop(*[size[k] for k in keys])
    placed = held.withColumn("p", F.expr("cast(pmod(xxhash64(id), _blocks) as int)")).withColumn("_q", F.explode(F.expr("sequence(0, _blocks - 1)")))
    return placed.withColumn("i", F.least("p", "_q")).withColumn("j", F.greatest("p", "_q")).drop("_n", "_blocks", "_q")


def alike_edges(rows: DataFrame, keys: list[str], min_cosine: float, min_overlap: float = 0.0) -> DataFrame:
    """(a, b): a forest that connects what is alike within the keys, of rows (keys, id, v, targets); the least cosine is above 0."""
    sized = rows.withColumn("_width", F.size("v"))
    pairs = _in_blocks(sized.select(*keys, "_width", "id", "v", "targets"), [*keys, "_width"])
    return wide(pairs, *keys, "_width", "i", "j").groupBy(*keys, "_width", "i", "j").applyInPandas(lambda part: _alike_edges(part, min_cosine, min_overlap), "a string, b string").where("a <> b")


def _pair_sums(part: pd.DataFrame, min_cosine: float | None, min_overlap: float) -> tuple[int, float, float]:
    """(pairs, sum of cosines, sum of overlaps) of the pairs of a block, or across two, that reach both least values."""
    first = int(part["p"].min())
    left, right = np.flatnonzero(part["p"] == first), np.flatnonzero(part["p"] != first) if part["p"].nunique() > 1 else np.flatnonzero(part["p"] == first)
    place: dict[str, int] = {}
    entries = [(k, place.setdefault(t, len(place))) for k, targets in enumerate(part["targets"]) for t in set(targets)]
    sizes = np.bincount([k for k, _ in entries], minlength=len(part)) if entries else np.zeros(len(part))
    columns: dict[int, list[int]] = {}
    for k, t in entries:
        columns.setdefault(t, []).append(k)
    unit = None
    if min_cosine is not None:
        unit = np.stack(part["v"].to_numpy()).astype(np.float64)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, length, out=np.zeros_like(unit), where=length > 0)
    n, cosines, overlaps = 0, 0.0, 0.0
    where_right = np.full(len(part), -1)
    where_right[right] = np.arange(len(right))
    by_row: dict[int, list[int]] = {}
    for k, t in entries:
        by_row.setdefault(k, []).append(t)
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        shared = np.zeros((len(rows), len(right)))
        for r, k in enumerate(rows):
            for t in by_row.get(int(k), ()):
                other = where_right[columns[t]]
                shared[r, other[other >= 0]] += 1
        union = sizes[rows][:, None] + sizes[right][None, :] - shared
        overlap = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
        good = overlap >= min_overlap
        if right is left or np.array_equal(left, right):
            good &= right[None, :] > rows[:, None]
        if unit is not None:
            cosine = unit[rows] @ unit[right].T
            good &= cosine >= min_cosine
            cosines += float(cosine[good].sum())
        n += int(good.sum())
        overlaps += float(overlap[good].sum())
    return n, cosines, overlaps


def pair_sums(rows: DataFrame, keys: list[str], min_cosine: float | None = None, min_overlap: float = 0.0) -> DataFrame:
    """(keys, pairs, cosines, overlaps): how many pairs of rows (keys, id, v, targets) reach the least values, and their sums; pairs themselves aren't emitted."""
    names = [*keys, "pairs", "cosines", "overlaps"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*(part[k].iloc[0] for k in keys), *_pair_sums(part.sort_values("id").reset_index(drop=True), min_cosine, min_overlap))], columns=names)

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    blocks = wide(_in_blocks(rows, keys), *keys, "i", "j").groupBy(*keys, "i", "j").applyInPandas(run, f"{kinds}, pairs long, cosines double, overlaps double")
    return blocks.groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.sum("cosines").alias("cosines"), F.sum("overlaps").alias("overlaps"))


#: The kinds of references that make a symbol's targets.
TARGET_KINDS = ["calls", "uses", "imports"]


def redundancy(symbols: DataFrame, refs: DataFrame, vectors: DataFrame, min_cosine: float = 0.86, min_overlap: float = 0.4, max_pairs: int | None = None) -> DataFrame:
    """(id, cluster, members, canonical, avg_cosine, avg_jaccard, cross_module) of functions that do the same: alike vectors and alike targets within one (kind, arity).

    Buckets are compared whole, in pairs of blocks of at most about BLOCK rows; the
    averages are over all alike pairs of a cluster.  The canonical member has the
    most lines, then the least file and id.  With ``max_pairs``, a bucket with more
    pairs is skipped, as the reference does.
    """
    s = symbols.dropDuplicates(["id"]).select("id", F.lower(F.trim("kind")).alias("kind"), S.arity(F.col("signature")).alias("arity"), "file_path", (F.col("line_end") - F.col("line_start")).alias("lines")).where("kind in ('function', 'method')")
    v = s.join(vectors.select("id", S.as_double(F.col("vector")).alias("v")).where("size(v) > 0"), "id").join(neighbour_sets(refs, TARGET_KINDS), "id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    if max_pairs is not None:
        small = v.groupBy("kind", "arity").agg(F.count("*").alias("n")).where(F.expr(f"n * (n - 1) / 2 <= {max_pairs}"))
        v = v.join(F.broadcast(small.drop("n")), ["kind", "arity"], "left_semi")  # one row a kind and arity: at most a dozen
    v = settle(v)
    clusters = settle(components(settle(alike_edges(v, ["kind", "arity"], min_cosine, min_overlap))).withColumnsRenamed({"node": "id", "component": "cluster"}))
    members = v.join(clusters, "id")
    facts = members.groupBy("cluster").agg(F.count("*").alias("members"), F.min(F.struct((-F.col("lines")).alias("n"), "file_path", "id"))["id"].alias("canonical"), (F.countDistinct("file_path") > 1).alias("cross_module"))
    sums = pair_sums(members.select("cluster", "id", "v", "targets"), ["cluster"], min_cosine, min_overlap)
    averages = sums.select("cluster", (F.col("cosines") / F.greatest("pairs", F.lit(1))).alias("avg_cosine"), (F.col("overlaps") / F.greatest("pairs", F.lit(1))).alias("avg_jaccard"))
    return clusters.join(facts, "cluster").join(averages, "cluster").select("id", "cluster", "members", "canonical", "avg_cosine", "avg_jaccard", "cross_module")


def one_site_a_file(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Of the symbols with the same keys in a file the one with the least first line, ties by id."""
    first = Window.partitionBy(*keys, "file_path").orderBy("line_start", "id")
    return symbols.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def shotgun(symbols: DataFrame, refs: DataFrame, min_files: int = 3, min_packages: int = 2, max_overlap: float = 0.5) -> DataFrame:
    """(name, kind, files, packages, avg_jaccard): one function name in many files and packages whose targets mostly differ; conventional names are left out."""
    root = corpus_root(symbols)
    s = symbols.dropDuplicates(["id"]).withColumn("kind", F.lower(F.trim("kind"))).where(F.col("kind").isin("function", "method") & ~F.col("name").isin(*S.CONVENTIONAL_NAMES))
    sites = one_site_a_file(s.select("id", "name", "kind", "file_path", "line_start"), ["name", "kind"]).withColumn("package", package_of(F.col("file_path"), root))
    many = sites.groupBy("name", "kind").agg(F.count("*").alias("files"), F.countDistinct(F.when(F.col("package") != "", F.col("package"))).alias("packages")).where((F.col("files") >= min_files) & (F.col("packages") >= min_packages))
    own = sites.join(many, ["name", "kind"]).join(neighbour_sets(refs, TARGET_KINDS), "id", "left").select("name", "kind", "id", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
    sums = pair_sums(own, ["name", "kind"]).select("name", "kind", (F.col("overlaps") / F.col("pairs")).alias("avg_jaccard"))
    return many.join(sums, ["name", "kind"]).where(F.col("avg_jaccard") <= max_overlap)


def low_cohesion(methods: DataFrame, calls: DataFrame, vectors: DataFrame | None = None, min_methods: int = 4, min_cosine: float = 0.7) -> DataFrame:
    """(container, methods, parts): containers whose methods fall into two or more parts of two or more that share no callee and have no alike vectors.

    ``methods``: container, id; ``vectors``: id, vector.  Methods are joined to
    their callees, not to each other, so a popular callee costs its callers, not
    their pairs.
    """
    many = methods.groupBy("container").agg(F.countDistinct("id").alias("methods")).where(F.col("methods") >= min_methods)
    m = settle(methods.join(many.select("container"), "container").distinct())
    key = lambda c: F.concat_ws("\u0001", "container", c)
    e = m.join(calls.select(F.col("src").alias("id"), "dst"), "id").select(key("id").alias("a"), F.concat_ws("\u0001", "container", F.lit(""), "dst").alias("b")).distinct()
    if vectors is not None:
        v = m.join(vectors.select("id", S.as_double(F.col("vector")).alias("v")).where("size(v) > 0"), "id").select("container", key("id").alias("id"), "v", F.array().cast("array<string>").alias("targets"))
        e = e.unionByName(alike_edges(v, ["container"], min_cosine))
    parts = components(settle(e)).where(~F.col("node").contains("\u0001\u0001")).select(F.split("node", "\u0001")[0].alias("container"), "component")
    sized = parts.groupBy("container", "component").agg(F.count("*").alias("n")).where("n >= 2").groupBy("container").agg(F.count("*").alias("parts")).where("parts >= 2")
    return sized.join(many, "container").select("container", "methods", "parts")


def representatives(items: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """(keys, kept, omitted): the first items (id) of each group and how many are left out; 0 keeps all."""
    ranked = items.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = F.array_sort(F.collect_list(F.when(F.lit(most == 0) | (F.col("_r") <= most), F.struct("_r", "id"))))
    return ranked.groupBy(*keys).agg(F.transform(kept, lambda x: x["id"]).alias("kept"), F.count("*").alias("_n")).withColumn("omitted", F.col("_n") - F.size("kept")).drop("_n")


def fat_interfaces(interface_methods: DataFrame, used: DataFrame, min_methods: int = 6, share: float = 0.33) -> DataFrame:
    """(interface, methods, implementors, under_using): at least half the implementors use no more than a third of the methods.

    ``interface_methods``: interface, method.  ``used``: interface, implementor, method.
    """
    size = interface_methods.distinct().groupBy("interface").agg(F.count("*").alias("methods")).where(F.col("methods") >= min_methods)
    overlap = used.distinct().join(interface_methods.distinct(), ["interface", "method"], "left_semi").groupBy("interface", "implementor").agg(F.count("*").alias("n"))
    every = used.select("interface", "implementor").distinct().join(overlap, ["interface", "implementor"], "left").join(size, "interface")
    out = every.groupBy("interface", "methods").agg(F.count("*").alias("implementors"), F.sum((F.coalesce("n", F.lit(0)) <= F.floor(F.lit(share) * F.col("methods"))).cast("int")).alias("under_using"))
    return out.where("2 * under_using >= implementors")


def concrete_dependencies(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id): functions that use a concrete type of another package whose trait they don't reference."""
    root = corpus_root(symbols)
    r = references(symbols, refs, ["uses"])
    s = symbols.dropDuplicates(["id"]).select(F.col("id").alias("from_symbol_id"), F.lower(F.trim("kind")).alias("kind")).where("kind in ('function', 'method')")
    across = r.where(package_of(F.col("from_file"), root) != package_of(F.col("to_file"), root)).join(s.select("from_symbol_id"), "from_symbol_id", "left_semi").select("from_symbol_id", "to_symbol_id").distinct()
    traits = refs.where("ref_kind = 'implements'").select(F.col("from_symbol_id").alias("to_symbol_id"), F.col("to_symbol_id").alias("trait")).distinct()
    known = refs.select("from_symbol_id", F.col("to_symbol_id").alias("trait")).distinct()
    has = across.join(traits, "to_symbol_id")
    through = has.join(known, ["from_symbol_id", "trait"], "left_semi").select("from_symbol_id", "to_symbol_id")
    return has.select("from_symbol_id", "to_symbol_id").distinct().join(through, ["from_symbol_id", "to_symbol_id"], "left_anti")


#: The kinds of symbols to which a reference by name can resolve.
TARGET_SYMBOLS = ["struct", "enum", "trait", "function", "type", "const", "static", "module", "class", "interface", "constant"]


def resolve_references(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref_id, symbol_id) of raw references (ref_id, file_path, name and, where they name one, package).

    Candidates have the name, a kind that can be meant and a language of the same
    family.  Of several those of the package that is named come first, then those
    of the file's own package, then those of other files, then the least id.
    """
    root = corpus_root(symbols)
    named = raw if "package" in raw.columns else raw.withColumn("package", F.lit(None).cast("string"))
    s = symbols.dropDuplicates(["id"]).where(F.lower(F.trim("kind")).isin(*TARGET_SYMBOLS)).select("id", "name", F.col("file_path").alias("f"), S.language_family(F.col("file_path")).alias("family"), package_of(F.col("file_path"), root).alias("pkg"))
    j = named.withColumn("family", S.language_family(F.col("file_path"))).join(s, ["name", "family"])
    order = F.struct((~F.coalesce(F.col("package") == F.col("pkg"), F.lit(False))).alias("a"), (package_of(F.col("file_path"), root) != F.col("pkg")).alias("b"), (F.col("file_path") == F.col("f")).alias("c"), "id")
    return j.groupBy("ref_id").agg(F.min(order)["id"].alias("symbol_id"))


def impact_listing(reached: DataFrame, symbols: DataFrame, tests_only: bool = False) -> DataFrame:
    """Reached symbols (root, id, depth) with their names and files, by depth, file and line; with ``tests_only`` those in tests."""
    s = symbols.dropDuplicates(["id"]).select("id", "name", "file_path", "line_start")
    out = reached.join(s, "id")
    out = out.where(S.is_test_path(F.col("file_path"))) if tests_only else out
    return out.select("root", "depth", "id", "name", "file_path", "line_start").orderBy("root", "depth", "file_path", "line_start", "id")


def impact_report(edges: DataFrame, changed: DataFrame, most_seeds: int = 200, most: int = 500) -> DataFrame:
    """(id, depth, seeds_omitted, omitted): a report on the first so many changed symbols and the nearest so many that they reach, and how many are left out of each."""
    n = changed.select("id").distinct().count()
    reached = settle(diff_impact(edges, changed.select("id").distinct().orderBy("id").limit(most_seeds)))
    total = reached.count()
    return reached.orderBy("depth", "id").limit(most).withColumn("seeds_omitted", F.lit(max(0, n - most_seeds))).withColumn("omitted", F.lit(max(0, total - most)))


def methods_of(symbols: DataFrame, kinds: list[str] = ["struct", "impl", "class"]) -> DataFrame:  # noqa: B006
    """(container, id): the symbols whose module path is a container's qualified path in the same file; of containers with one path in a file the first stands for all."""
    s = symbols.dropDuplicates(["id"]).withColumn("kind", F.lower(F.trim("kind")))
    held = s.where(F.col("kind").isin(*kinds)).withColumn("path", F.when(F.coalesce("module_path", F.lit("")) == "", F.col("name")).otherwise(F.concat_ws("::", "module_path", "name")))
    first = held.groupBy("file_path", "path").agg(F.min(F.struct("line_start", "id"))["id"].alias("container"))
    m = s.where(F.col("kind").isin("function", "method")).select("id", "file_path", F.col("module_path").alias("path"))
    return m.join(first, ["file_path", "path"]).select("container", "id")


def through_implementors(refs: DataFrame, kinds: list[str] = ["calls", "uses"]) -> DataFrame:  # noqa: B006
    """(trait, from_symbol_id): references to implementors of a trait that don't reference the trait itself."""
    implements = refs.where("ref_kind = 'implements'").select(F.col("from_symbol_id").alias("impl"), F.col("to_symbol_id").alias("trait")).where("impl <> trait").distinct()
    used = refs.where(F.col("ref_kind").isin(*kinds)).select("from_symbol_id", F.col("to_symbol_id").alias("impl")).distinct()
    found = used.join(implements, "impl").select("trait", "from_symbol_id").distinct()
    direct = refs.select(F.col("to_symbol_id").alias("trait"), "from_symbol_id").distinct()
    return found.join(direct, ["trait", "from_symbol_id"], "left_anti")


def resolve_occurrences(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Occurrences (path, name, …) with the symbol of their own file, else the one symbol of that name anywhere, else none."""
    s = symbols.dropDuplicates(["id"])
    own = s.groupBy(F.col("file_path").alias("path"), "name").agg(F.min("id").alias("own_id"))
    one = s.groupBy("name").agg(F.min("id").alias("only_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return occurrences.join(own, ["path", "name"], "left").join(one, "name", "left").withColumn("symbol_id", F.coalesce("own_id", "only_id")).drop("own_id", "only_id").where("symbol_id is not null")


def semantic_links(exports: DataFrame, imports: DataFrame, min_cosine: float = 0.85) -> DataFrame:
    """(kind, export_id, import_id, confidence) of endpoints (id, kind, vector) that no key links, by name vectors.

    Endpoints left over by the key links are few; they are compared within their kind.
    """
    e = exports.select(F.col("id").alias("export_id"), "kind", S.as_double(F.col("vector")).alias("u"))
    i = imports.select(F.col("id").alias("import_id"), "kind", S.as_double(F.col("vector")).alias("v"))
    return e.join(i, "kind").where(S.cosine(F.col("u"), F.col("v")) >= min_cosine).select("kind", "export_id", "import_id", F.lit(0.7).alias("confidence"))


def link_details(links: DataFrame, endpoints: DataFrame, symbols: DataFrame) -> DataFrame:
    """Links (kind, export_id, import_id, confidence) with both endpoints and, of each, the symbol of its name that encloses its line; the least id of several.

    Endpoints: id, file_path, binding_key, symbol_name, language, line.
    """
    s = symbols.dropDuplicates(["id"]).select(F.col("id").alias("symbol_id"), F.col("file_path").alias("_f"), F.col("name").alias("_n"), "line_start", "line_end")
    inside = (F.col("file_path") == F.col("_f")) & (F.col("symbol_name") == F.col("_n")) & F.col("line").between(F.col("line_start"), F.col("line_end"))
    named = endpoints.join(s, inside, "left").groupBy(*[F.col(c) for c in ("id", "file_path", "binding_key", "symbol_name", "language", "line")]).agg(F.min("symbol_id").alias("symbol_id"))
    side = lambda end: named.select(*[F.col(c).alias(f"{end}_{c}") for c in named.columns])
    return links.join(side("export"), "export_id").join(side("import"), "import_id")


def filter_links(details: DataFrame, query: str | None = None, kind: str | None = None, language: str | None = None, file_path: str | None = None) -> DataFrame:
    """Links in which a key or symbol name contains the query, without case; a language or file may be that of either side."""
    either = lambda c: [F.col(f"export_{c}"), F.col(f"import_{c}")]
    out = details
    if query is not None:
        found = [F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in either("binding_key") + either("symbol_name")]
        out = out.where(functools.reduce(lambda a, b: a | b, found))
    out = out.where(F.col("kind") == kind) if kind is not None else out
    if language is not None:
        a, b = either("language")
        out = out.where((F.lower(a) == language.lower()) | (F.lower(b) == language.lower()))
    if file_path is not None:
        a, b = either("file_path")
        out = out.where((a == file_path) | (b == file_path))
    return out


def bridge_graph(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of links: one node an endpoint, one edge a link."""
    side = lambda end, role: details.select(F.col(f"{end}_id").alias("id"), F.lit(role).alias("role"), F.col(f"{end}_file_path").alias("file_path"), F.col(f"{end}_symbol_name").alias("label"), F.col(f"{end}_language").alias("language"))
    return side("export", "export").unionByName(side("import", "import")).distinct(), details.select(F.col("export_id").alias("source"), F.col("import_id").alias("target"), "kind", "confidence").distinct()


def references_over_bridges(symbols: DataFrame, refs: DataFrame, details: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id, ref_kind): the references, and the links whose ends are known symbols as references of kind bridge."""
    links = details.where("export_symbol_id is not null and import_symbol_id is not null").select(F.col("import_symbol_id").alias("from_symbol_id"), F.col("export_symbol_id").alias("to_symbol_id"), F.lit("bridge").alias("ref_kind"))
    return references(symbols, refs).select("from_symbol_id", "to_symbol_id", "ref_kind").unionByName(links).distinct()
