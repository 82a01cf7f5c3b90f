import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


@pytest.fixture(scope="module")
def wild(spark):
    rng = random.Random(4)
    return sorted({(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(90)})


def test_impact_against_search(spark, wild):
    pairs = [(a, b) for a, b in wild if a != b]
    got = {(r.root, r.id): r.depth for r in G.impact(edges(spark, pairs), spark.createDataFrame([("n1",), ("n2",)], "id string"), depth=4).collect()}
    want = {}
    for root in ("n1", "n2"):
        seen, front = {root}, {root}
        for d in range(1, 5):
            front = {a for a, b in pairs if b in front} - seen
            seen |= front
            want |= {(root, x): d for x in front}
    assert got == want


def test_cycle_counts_itself(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("c", "a")])
    got = {r.id: r.callers for r in G.transitive_callers(e, spark.createDataFrame([("a",), ("c",)], "id string")).collect()}
    assert got == {"a": 3}
    assert G.impact(e, spark.createDataFrame([("c",)], "id string")).count() == 0


def test_components(spark, wild):
    got = {r.node: r.component for r in G.components(spark.createDataFrame(wild, "a string, b string")).collect()}
    parent = {x: x for p in wild for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in wild:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    for x in parent:
        assert (got[x] == got[find(x)]) and got[x] == min(y for y in parent if find(y) == find(x))


def test_long_chain(spark):
    pairs = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(200)]
    assert {r.component for r in G.components(spark.createDataFrame(pairs, "a string, b string")).collect()} == {"n0000"}


def test_bridges(spark):
    shape = "id string, kind string, binding_key string, confidence double"
    e = spark.createDataFrame([("e1", "k", "load_file", 1.0), ("e2", "k", "other_one", 0.8), ("e3", "x", "load_file", 1.0), ("e4", "k", None, 1.0)], shape)
    i = spark.createDataFrame([("i1", "k", "load_file", 1.0), ("i2", "k", "otherOne", 1.0), ("i3", "k", "loadFile", 1.0)], shape)
    assert {(r.export_id, r.import_id, r.confidence) for r in G.bridge_links(e, i).collect()} == {("e1", "i1", 1.0), ("e2", "i2", 0.8)}


def test_cohesion(spark):
    m = spark.createDataFrame([("A", x) for x in "abcd"] + [("B", x) for x in "efgh"] + [("C", "i")], "container string, id string")
    calls = edges(spark, [("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "x"), ("f", "x"), ("g", "x"), ("h", "x")])
    assert [tuple(r) for r in G.low_cohesion(m, calls).collect()] == [("A", 4, 2)]


def test_enclosing(spark):
    s = spark.createDataFrame([("o", "f", 1, 10), ("i", "f", 2, 5), ("z", "g", 1, 9)], "id string, file_path string, line_start int, line_end int")
    p = spark.createDataFrame([("p", "f", 3), ("q", "f", 7), ("r", "f", 20)], "pos_id string, file_path string, line int")
    assert {r.pos_id: r.symbol_id for r in G.enclosing(s, p).collect()} == {"p": "i", "q": "o"}


def test_redundancy_skips_large_buckets(spark):
    s = spark.createDataFrame([(f"s{k}", "function", "def f(a)") for k in range(30)], "id string, kind string, signature string").withColumns({"file_path": F.lit("p"), "name": F.lit("n"), "line_start": F.lit(1), "line_end": F.lit(9)})
    v = spark.createDataFrame([(f"s{k}", [1.0, 0.001 * k]) for k in range(30)], "id string, vector array<double>")
    r = spark.createDataFrame([], "from_symbol_id string, to_symbol_id string, ref_kind string")
    assert G.redundancy(s, r, v, min_overlap=0.0).select("cluster").distinct().count() == 1
    assert G.redundancy(s, r, v, min_overlap=0.0, max_pairs=100).count() == 0


def test_occurrences_and_semantics(spark):
    o = spark.createDataFrame([("f", "a", 1), ("g", "a", 2), ("g", "b", 3), ("g", "c", 4), ("g", None, 5)], "path string, name string, line int")
    s = spark.createDataFrame([("1", "f", "a"), ("2", "h", "a"), ("3", "h", "b")], "id string, file_path string, name string")
    assert {(r.path, r.name): r.symbol_id for r in G.resolve_occurrences(o, s).collect()} == {("f", "a"): "1", ("g", "b"): "3"}
    e = spark.createDataFrame([("x", "k", [1.0, 0.0]), ("y", "k", None)], "id string, kind string, vector array<double>")
    i = spark.createDataFrame([("p", "k", [0.9, 0.1]), ("q", "k", [0.0, 1.0]), ("r", "z", [1.0, 0.0])], "id string, kind string, vector array<double>")
    assert [(r.export_id, r.import_id) for r in G.semantic_links(e, i).collect()] == [("x", "p")]


@pytest.mark.parametrize("min_overlap", [0.0, 0.5])
def test_redundancy_of_large_buckets(spark, monkeypatch, min_overlap):
    monkeypatch.setattr(G, "BLOCK", 150)
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(250)]
    vectors = [(f"s{k:03d}", [x + 0.02 * rng.gauss(0, 1) for x in base[k % 250]]) for k in range(500)]
    symbols = spark.createDataFrame([(i, "function", "def f(a, b)", "f") for i, _ in vectors], "id string, kind string, signature string, name string").withColumns({"file_path": F.col("id"), "line_start": F.lit(1), "line_end": F.lit(9)})
    refs = [(i, t, "calls") for k, (i, _) in enumerate(vectors) for t in ("x", "y" if k < 250 or k % 2 else "z", "u" if k % 3 else "w")]
    out = G.redundancy(symbols, spark.createDataFrame(refs, "from_symbol_id string, to_symbol_id string, ref_kind string"), spark.createDataFrame(vectors, "id string, vector array<float>"), 0.9, min_overlap)
    targets = {}
    for i, t, _ in refs:
        targets.setdefault(i, set()).add(t)
    cosine = lambda u, v: sum(a * b for a, b in zip(u, v)) / (sum(a * a for a in u) * sum(b * b for b in v)) ** 0.5
    alike = [(a, b) for n, (a, u) in enumerate(vectors) for b, v in vectors[n + 1 :] if cosine(u, v) >= 0.9 and len(targets[a] & targets[b]) >= min_overlap * len(targets[a] | targets[b])]
    want = {r.node: r.component for r in G.components(spark.createDataFrame(alike, "a string, b string")).collect()}
    rows = out.collect()
    by = {}
    for a, b in alike:
        by.setdefault(want[a], []).append(cosine(dict(vectors)[a], dict(vectors)[b]))
    assert all(abs(r.avg_cosine - sum(by[r.cluster]) / len(by[r.cluster])) < 1e-5 and r.canonical == min(i for i, c in want.items() if c == r.cluster) and r.cross_module for r in rows)
    assert {r.id: r.cluster for r in rows} == want and (len(want) == 500 if not min_overlap else 100 < len(want) < 500)
