import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators import cells, embedding, graph, incremental, lookup, retrieval, sessions, text
from lodestrata.sources import assembly, frameworks, git, vectors


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_package_root(spark):
    s = frame(spark, [("ws/core/a.rs",), ("ws/api/b.rs",), ("ws/core/c.rs",)], "file_path string")
    assert graph.corpus_root(s) == "ws/" and graph.corpus_root(s.limit(0)) == "" and graph.corpus_root(frame(spark, [("a/x",), ("b/x",)], "file_path string")) == ""
    assert [r[0] for r in s.select(graph.package_of(F.col("file_path"), "ws/")).collect()] == ["core", "api", "core"]


def test_shotgun_needs_different_insides(spark):
    kinds = "id string, name string, kind string, file_path string, line_start int, line_end int"
    s = frame(spark, [(f"{n}{k}", n, "Function ", f"p{k}/f.rs", 1, 9) for n in ("same", "split", "new") for k in range(3)] + [("same9", "same", "function", "p0/f.rs", 50, 60), ("t", "same", "struct", "p7/f.rs", 1, 2)], kinds)
    r = frame(spark, [(f"same{k}", "x", "calls") for k in range(3)] + [(f"split{k}", f"y{k}", "uses") for k in range(3)], "from_symbol_id string, to_symbol_id string, ref_kind string")
    assert [(x.name, x.kind, x.files, x.packages, x.avg_jaccard) for x in graph.shotgun(s, r).collect()] == [("split", "function", 3, 3, 0.0)]
    assert graph.shotgun(s.limit(0), r).count() == 0


def test_pair_sums_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [("k", f"i{n}", rng.normal(size=4).tolist(), [f"t{x}" for x in rng.integers(0, 6, 3)]) for n in range(40)]
    df = frame(spark, rows, "k string, id string, v array<double>, targets array<string>")
    unit = {r[1]: np.array(r[2]) / np.linalg.norm(r[2]) for r in rows}
    sets = {r[1]: set(r[3]) for r in rows}
    n = c = o = 0
    for a in unit:
        for b in unit:
            cos, jac = float(unit[a] @ unit[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a < b and cos >= 0.1 and jac >= 0.2:
                n, c, o = n + 1, c + cos, o + jac
    for block in (4096, 7):
        monkeypatch.setattr(graph, "BLOCK", block)
        r = graph.pair_sums(df, ["k"], 0.1, 0.2).first()
        assert r.pairs == n and abs(r.cosines - c) < 1e-9 and abs(r.overlaps - o) < 1e-9


def test_low_cohesion_by_vectors(spark):
    m = frame(spark, [("A", f"m{k}") for k in range(4)], "container string, id string")
    calls = frame(spark, [("m0", "x"), ("m1", "x"), ("m2", "y"), ("m3", "y")], "src string, dst string")
    v = frame(spark, [("m1", [1.0, 0.0]), ("m2", [1.0, 0.1]), ("m3", [0.0, 1.0])], "id string, vector array<double>")
    assert graph.low_cohesion(m, calls).count() == 1 and graph.low_cohesion(m, calls, v).count() == 0


def test_representatives(spark):
    df = frame(spark, [("a", "1"), ("a", "2"), ("a", "3"), ("b", "9")], "g string, id string")
    assert {r.g: (r.kept, r.omitted) for r in graph.representatives(df, ["g"], ["id"], 2).collect()} == {"a": (["1", "2"], 1), "b": (["9"], 0)}
    assert {r.g: (r.kept, r.omitted) for r in graph.representatives(df, ["g"], ["id"], 0).collect()} == {"a": (["1", "2", "3"], 0), "b": (["9"], 0)}


def test_roles_and_names(spark):
    df = frame(spark, [("Some words.\nMore\n  pub fn f() {\n}\n",), ("only prose",), ("",), (None,)], "t string")
    got = [r.r for r in df.select(S.roles(F.col("t")).alias("r")).collect()]
    assert (got[0].doc, got[0].sig, got[0].body) == ("Some words. More", "  pub fn f() {", "} ") and (got[1].doc, got[1].sig, got[1].body) == ("only prose", "", "") and got[2].sig == ""
    names = frame(spark, [("section::a.rs#m::f",), ("symbol-stub::sym-x::Y",), (None,)], "v string").select(S.name_from_id(F.col("v")).alias("n")).collect()
    assert [r.n for r in names] == ["m f", "Y", None]
    r = frame(spark, [("load_file_x", "abstract_class_thing", "nothing")], "a string, b string, c string").select(S.snake_to_camel(F.col("a")).alias("a"), S.item_kind(F.col("b")).alias("b"), S.item_kind(F.col("c")).alias("c"), S.item_kind(F.lit("union_specifier")).alias("d")).first()
    assert tuple(r) == ("loadFileX", "struct", None, "struct")


def test_questions(spark):
    r = frame(spark, [("How does the FFI load_file method work?",)], "q string").select(S.symbol_hints(F.col("q")).alias("h"), S.bridge_relevant(F.col("q")).alias("b"), S.covered(F.col("q"), F.array(F.lit("LOADS: load_file"))).alias("c"), S.covered(F.lit("a b"), F.array().cast("array<string>")).alias("n")).first()
    assert (r.h, r.b, r.c, r.n) == (["FFI", "load_file", "work"], True, True, False)
    acts = frame(spark, [(0.9, "claim", "a.md#x:c3"), (0.9, "symbol-stub", "s"), (0.4, "section", "t"), (0.5, "summary", "u")], "s double, r string, i string").select(S.next_action(F.col("s"), F.col("r"), F.col("i")).alias("a")).collect()
    assert [tuple(x.a) if x.a else None for x in acts] == [("read", "a.md#x"), ("definition", "s"), None, ("read", "u")]
    q = frame(spark, [("q", "where budgets live"), ("q", "what sessions hold"), ("r", "empty one")], "query_id string, question string")
    kept = frame(spark, [("q", "the BUDGETS are here", 1)], "query_id string, text string, question int")
    assert {(x.query_id, x.question) for x in retrieval.uncovered(q, kept.drop("question")).collect()} == {("q", "what sessions hold"), ("r", "empty one")}


def test_rerank_and_chain(spark):
    c = frame(spark, [("q", "a", 1.0), ("q", "b", 0.5), ("q", "c", 0.0), ("p", "a", 2.0)], "query_id string, id string, score double")
    s = frame(spark, [("q", "a", 0.0), ("q", "b", 10.0)], "query_id string, id string, rerank double")
    got = {(r.query_id, r.id): (r.score, r.rank) for r in retrieval.rerank(c, s, 2).collect()}
    assert got == {("q", "b"): (0.9, 1), ("q", "a"): (0.2, 2), ("p", "a"): (0.5, 1)}
    texts = frame(spark, [("a", "[section not found: a]"), ("b", "words"), ("c", None)], "id string, text string")
    lists = c.select("query_id", "id", F.lit(1).alias("rank"))
    assert [(r.query_id, r.id) for r in retrieval.survey(lists, lists, texts, None, 5).collect()] == [("q", "b")]
    assert retrieval.rerank(c.limit(0), s, 2).count() == 0
    both = retrieval.second_round(frame(spark, [("q", "a", 4.0), ("q", "b", 2.0)], "query_id string, id string, score double"), frame(spark, [("q", "b", 5.0), ("q", "c", 1.0)], "query_id string, id string, score double"))
    assert {(r.id, r.score) for r in both.collect()} == {("a", 4.0), ("b", 5.0)}


def test_cells_recall(spark, data):
    p = spark.read.parquet(f"{data}/embeddings.parquet".replace("sf0.001", "sf0.1")).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = p.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    centres = cells.fit_cells(p, 32)
    index = cells.index_cells(p, centres)
    exact = {(r.query_id, r.id) for r in retrieval.knn_exact(p, q, 10).collect()}
    got = {(r.query_id, r.id) for r in cells.search_cells(index, centres, q, 10, 22).collect()}
    assert len(got & exact) >= 0.9 * len(exact)
    gone = p.where("id % 2 = 1")
    kept = cells.search_cells(index, centres, q, 10, 22, gone).collect()
    assert len(kept) == 10 * q.count() and all(r.id % 2 == 0 for r in kept)
    assert cells.search_cells(index, centres, q.limit(0), 10, 4).count() == 0 and cells.fit_cells(p.limit(0), 4).size == 0


def test_embedders(spark):
    own = embedding.create_embedder(dimension=4)
    want = np.array([ord("a") + ord("e"), ord("b"), ord("c"), ord("d")]) / 255
    assert np.allclose(own.embed(["abcde", ""]), [want / np.linalg.norm(want), np.zeros(4)])
    df = frame(spark, [(1, "abcde"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.vector and [round(x, 6) for x in r.vector] for r in embedding.embed(df, embedder=own).collect()}[2] is None
    mixed = frame(spark, [(1, "Plain words only."), (2, "fn main() {\n    let x = 1;\n}\n"), (3, None)], "id int, text string")
    sizes = {r.id: r.vector and len(r.vector) for r in embedding.embed_by_kind(mixed, embedding.ByteEmbedder(8), embedding.ByteEmbedder(16)).collect()}
    assert sizes == {1: 16, 2: 8, 3: None}
    assert [len(b) for b in embedding.batched(list("x" * 130))] == [64, 64, 2]
    t, c, m = frame(spark, [(1, "h"), (2, "g"), (3, "z")], "id int, hash string"), frame(spark, [("h", [1.0])], "hash string, vector array<double>"), frame(spark, [("g", [2.0]), ("h", [9.0])], "hash string, vector array<double>")
    assert {(r.id, r.vector[0]) for r in embedding.union_back(t, c, m).collect()} == {(1, 1.0), (2, 2.0)}
    res = frame(spark, [("q", "a", "ring buffer"), ("q", "b", None)], "query_id string, id string, text string")
    assert {r.id: r.rerank for r in embedding.rerank_scores(res, frame(spark, [("q", "ring queue")], "query_id string, query string")).collect()} == {"a": 0.5, "b": 0.0}


def test_incremental_additions(spark):
    files = frame(spark, [("a", "1", 5), ("b", "2", 6), ("c", "3", None)], "path string, content string, mtime_ns long")
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    stored = frame(spark, [("a", "stale-but-same-time", 5, 4, 2), ("b", h("other"), 7, 4, 2), ("c", h("3"), 1, 4, 1)], "path string, content_hash string, mtime_ns long, extractor_version long, resolver_version long")
    assert {r.path: r.action for r in incremental.changes(files, stored, 4, 2).collect()} == {"a": "skip", "b": "reindex", "c": "resolve"}
    moved = incremental.rebinds(frame(spark, [("new/x", "same"), ("kept", "k")], "path string, content string"), frame(spark, [("old/x", h("same"), 1, 1, 1), ("kept", h("k"), 1, 1, 1)], "path string, content_hash string, mtime_ns long, extractor_version long, resolver_version long"))
    assert [tuple(r) for r in moved.collect()] == [("old/x", "new/x")]
    rows = frame(spark, [("old/x", "id1"), ("kept", "id2")], "file_path string, id string")
    assert {tuple(r) for r in incremental.rebound(rows, moved, "file_path").collect()} == {("new/x", "id1"), ("kept", "id2")}
    cache, src, cur = frame(spark, [("q", "A"), ("r", "B")], "query_hash string, answer string"), frame(spark, [("q", "s", "1"), ("r", "s", "0")], "query_hash string, section_id string, section_hash string"), frame(spark, [("s", "1")], "id string, hash string")
    assert [r.query_hash for r in incremental.kept_answers(cache, src, cur).collect()] == ["q"]


def test_absolute_paths_and_lists(spark):
    f, r = frame(spark, [("root/a/b.rs",), ("/abs/x",), ("other/y",), (None,)], "path string"), frame(spark, [("root", "/c/d/")], "root_id string, folder string")
    assert {x.path: x.absolute for x in lookup.absolute_paths(f, r).collect()} == {"root/a/b.rs": "/c/d/a/b.rs", "/abs/x": "/abs/x", "other/y": "other/y", None: None}


def test_assembly(spark):
    code = "; top note\nINCLUDE \"x\"\n\n; starts up\n; twice\n\nMain::\n  ld a, 1\n.local:\n  ret\nsection: x\nLoop: ; inline\n  jr Loop\n"
    got = {r.position: r for r in assembly.read_assembly(frame(spark, [("a.asm", code), ("b.asm", None), ("c.asm", "nop\n")], "path string, content string")).where("path = 'a.asm'").collect()}
    assert (got[1].label, got[1].exported, got[1].doc) == ("Main", True, "starts up\ntwice") and got[1].text.startswith("Main::") and ".local:" in got[1].text and "section: x" in got[1].text
    assert (got[2].label, got[2].exported, got[2].doc) == ("Loop", False, None) and got[0].label is None


def test_frameworks(spark):
    rows = [("r", "r/Cargo.toml", '[dependencies]\naxum = "0.7"\n'), ("r", "r/src/a.c", ""), ("r", "r/go.mod", None), ("q", "q/package.json", '{"electron-builder": 1}'), ("p", "p/x.proto", "")]
    assert {tuple(r) for r in frameworks.detect_bridges(frame(spark, rows, "root_id string, path string, content string")).collect()} == {("r", "http_route"), ("r", "ffi"), ("r", "cgo"), ("p", "grpc")}


def test_vector_blobs(spark):
    df = frame(spark, [("a", [1.0, -2.5]), ("b", []), ("c", None)], "id string, vector array<float>")
    blobs = df.select("id", vectors.to_blob(F.col("vector")).alias("blob"))
    assert bytes(blobs.where("id = 'a'").first().blob) == np.array([1.0, -2.5], dtype="<f4").tobytes()
    new = vectors.store_vectors(blobs, frame(spark, [("a", [3.0]), ("d", [4.0])], "id string, vector array<float>"))
    assert {r.id: r.vector for r in vectors.load_vectors(new).collect()} == {"a": [3.0], "b": [], "c": None, "d": [4.0]}


def test_clones(spark):
    cached = frame(spark, [("u", "main", "1"), ("v", "main", "2"), ("w", None, "3")], "repo_url string, branch string, sha string")
    heads = frame(spark, [("u", "main", "1"), ("v", "main", "9"), ("w", None, None), ("x", "main", "4")], "repo_url string, branch string, head string")
    assert {r.repo_url: r.state for r in git.staleness(cached, heads).collect()} == {"u": "current", "v": "stale", "w": "unknown", "x": "new"}


def test_compression_ways(spark):
    sections = frame(spark, [("a", "Alpha one is here now. Beta two budget grows. Gamma three stays. Delta four leaves."), ("b", "One."), ("c", None)], "id string, text string")
    assert [tuple(r) for r in text.salient_summaries(sections, ["budget"], 2).collect()] == [("a", "Beta two budget grows. Alpha one is here now.")]
    code = "/// Adds up.\n/// Twice.\npub fn add(a: i64) -> i64 {\n    a + 1\n}\n\nfn other() {}\n"
    got = {r.id: (r.method, r.compressed) for r in text.compressed_by_kind(sections.unionByName(frame(spark, [("x/y.rs#f", code), ("a#h:c1", "A claim.")], "id string, text string")), 1).collect()}
    assert got["x/y.rs#f"] == ("code_summary", "/// Adds up.\n/// Twice.\npub fn add(a: i64) -> i64 {") and "a#h:c1" not in got and got["a"][0] == "extractive"
    made = {r.id: (r.method, r.compressed) for r in text.abstractive(sections, lambda ts: ["short" if "Alpha" in t else None for t in ts], 1).collect()}
    assert made == {"a": ("abstractive", "short")} and text.abstractive(sections, None, 1).count() == 1
    assert text.term_index(frame(spark, [("k", "Budget budget of sessions"), ("e", "")], "claim_id string, text string")).count() == 2


def test_prefetch_and_co_access(spark):
    acc = frame(spark, [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "a")], "session_id string, turn int, section_id string")
    rel = frame(spark, [("a", "b", 2.0), ("a", "c", 1.0), ("b", "a", 5.0), ("a", "a", 9.0)], "section_id string, candidate string, score double")
    got = {(r.session_id, r.turn, r.candidate) for r in sessions.prefetch_related(acc, rel, "topical", 1).collect()}
    assert got == {("s", 1, "b"), ("t", 1, "b")}
    new, old = frame(spark, [("s", "c"), ("s", "c"), ("s", "d")], "session_id string, section_id string"), frame(spark, [("s", "a"), ("t", "b")], "session_id string, section_id string")
    assert {(r.a, r.b) for r in sessions.co_access_incremental(new, old).collect()} == {("c", "d"), ("a", "c"), ("a", "d")}
    assert sessions.co_access_incremental(new.limit(0), old).count() == 0


def test_coalesced_streams(spark):
    rows = [("d", k, f"s{k}", 1 if k < 4 else 2, "few words here" if k != 2 else "many " * 60, ["H"] if k == 1 else None) for k in range(6)]
    df = frame(spark, rows, "document_id string, position int, id string, depth int, text string, heading_path array<string>")
    got = [(r.group, r.first_position, r.n_sections) for r in text.coalesced(df).orderBy("group").collect()]
    assert got == [(0, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 2)]
    assert text.coalesced(df.limit(0)).count() == 0
