import itertools
import json
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import scalar as S
from lodestrata.operators import delta, incremental, retrieval, sessions
from lodestrata.streaming import ledger


def evicted(rows, capacity, policy):
    """By the rule alone: what comes goes to the end of a list; while the list is too heavy, one leaves."""
    line, out, access = [], [], {}
    for content, tokens, turn, rating in rows:
        line = [e for e in line if e[0] != content] + [(content, tokens)]
        if content in access:
            s, d, last = access[content]
            r = 1 / (1 + (turn - last) / (9 * max(s, 0.1)))
            if rating == "again":
                d, s = min(1.0, d + 0.2), max(0.1, s * 0.5)
            else:
                d = max(0.0, d - 0.1) if rating == "easy" else d
                s *= max(1.01, 1 + math.exp(0.1) * max(1.0, 11 - 10 * d) * s**-0.2 * (math.exp(0.05 * (1 - r)) - 1))
            access[content] = (s, d, turn)
        else:
            access[content] = (1.0, 0.3, turn)
        while sum(n for _, n in line) > capacity and line:
            if policy == "fsrs":
                recall = [1.0 if c == content else 1 / (1 + (turn - access[c][2]) / (9 * max(access[c][0], 0.1))) for c, _ in line]
                at = recall.index(min(recall))
            else:
                at = 0
            out.append((line.pop(at)[0], turn))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.integers(1, 70), st.sampled_from(["again", "good", "easy"])), min_size=1, max_size=30))
def test_windows(spark, steps):
    rows = [(c, n, t, r) for t, (c, n, r) in enumerate(steps, 1)]
    df = spark.createDataFrame([("s", *r, 1) for r in rows] + [("other", "a", 5, 1, "good", 1)], "session_id string, content_id string, tokens int, turn long, rating string, used int")
    for policy in ("fifo", "lru", "fsrs"):
        assert [(r.content_id, r.evicted_turn) for r in sessions.window_simulation(df, 100, policy).where("session_id = 's'").collect()] == evicted(rows, 100, policy)


def test_window_edges(spark):
    df = spark.createDataFrame([("s", "a", 300, 1), ("s", "b", 10, 2), ("s", "b", 10, 3), ("s", "c", 95, 4)], "session_id string, content_id string, tokens int, turn long")
    assert [(r.content_id, r.evicted_turn) for r in sessions.window_simulation(df, 100, "fifo").collect()] == [("a", 1), ("b", 4)]  # the fresh one too, if it alone is too large
    assert sessions.window_simulation(df.limit(0), 100).count() == 0


def test_priority_cache(spark):
    rows = [("s", 1, "put", "a", "sequential", 0.5), ("s", 2, "put", "b", "sequential", 0.9), ("s", 3, "get", "a", "sequential", 0.0), ("s", 4, "get", "a", "sequential", 0.0), ("s", 5, "put", "c", "sequential", 0.9), ("s", 6, "get", "b", "x", 0.0), ("s", 7, "get", "a", "x", 0.0), ("s", 8, "get", "c", "x", 0.0)]
    df = spark.createDataFrame(rows, "session_id string, turn long, op string, key string, strategy string, confidence double")
    r = sessions.priority_cache(df, 2).collect()
    assert [tuple(x) for x in r] == [("s", 8, 4, 1, 1)]  # b leaves: 0.9 * 0.95^3 against 0.5 * 0.95^4 * (1 + log2 3)
    assert [tuple(x)[2:] for x in sessions.priority_cache(df, 0).collect()] == [(0, 5, 0)] and sessions.priority_cache(df.limit(0), 2).count() == 0


def test_ledger_stream_equals_batch(spark, tmp_path):
    rows = [("u", "c", 1, "h"), ("u", "c", 2, "h"), ("u", "c", 3, "g"), ("v", "c", 1, "h"), ("u", "d", 4, "x")]
    df = spark.createDataFrame(rows, "session_id string, content_id string, turn long, content_hash string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ledger.actions(stream).writeStream.format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("ledger").collect()}
    assert got == {tuple(r) for r in sessions.read_protocol(df).select("session_id", "content_id", "turn", "action").collect()}


def test_deltas(spark):
    assert delta.line_delta("a\nb\nc", "a\nx\nc") == [("context", "a"), ("removed", "b"), ("added", "x"), ("context", "c")]
    assert delta.line_delta("", "") == [] and delta.line_delta("", "x") == [("added", "x")] and delta.line_delta("x", "") == [("removed", "x")]
    df = spark.createDataFrame([(1, "a\nb", "b"), (2, None, "z")], "id long, old string, new string")
    assert [(r.id, r.op, r.line) for r in delta.deltas(df).orderBy("id", "n").collect()] == [(1, "removed", "a"), (1, "context", "b"), (2, "added", "z")]
    assert delta.line_delta("a", "a\na") == [("added", "a"), ("context", "a")]  # an added line of equal ones comes first
    big = {"rows": [{"t": "One short sentence. " * 300, "k": n} for n in range(50)], "n": 1, "text": "A first one about budgets. Another about sessions! " * 200}
    small = delta.condense(big, 2000)
    assert delta.count_tokens(json.dumps(small)) <= 2000 and small["n"] == 1 and small["_condensed"]["omitted_elements"] and small["_condensed"]["reduced_fields"]
    assert delta.condense({"a": 1}) == {"a": 1} and delta.shorten("word " * 500, 20).endswith("…")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_delta_is_longest_and_whole(x, y):
    out = delta.line_delta("\n".join(x), "\n".join(y))
    assert [v for op, v in out if op != "added"] == x and [v for op, v in out if op != "removed"] == y
    best = max(n for n in range(min(len(x), len(y)) + 1) if {c for c in itertools.combinations(x, n)} & {c for c in itertools.combinations(y, n)})
    assert sum(op == "context" for op, _ in out) == best


def test_answers_and_sweep(spark):
    src = spark.createDataFrame([("q", "a", "1"), ("q", "b", "2"), ("r", "a", "0"), ("s", "gone", "9")], "query_hash string, section_id string, section_hash string")
    cur = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, hash string")
    assert {r.query_hash: r.valid for r in incremental.valid_answers(src, cur).collect()} == {"q": True, "r": False, "s": True}
    stored = spark.createDataFrame([("x",), ("y",)], "path string")
    assert [r.path for r in incremental.sweep(stored, stored.where("path = 'x'")).collect()] == ["y"]
    assert incremental.sweep(stored, stored.limit(0)).count() == 0


def test_knn_edges(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.id, r.distance) for r in retrieval.knn_exact(p, q, 2).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    assert retrieval.knn_exact(p, q.limit(0), 2).count() == 0 and retrieval.knn_exact(p.limit(0), q, 2).count() == 0


def test_scalars(spark):
    df = spark.createDataFrame([("HTTPServer load_file", "GET", "/A/b/", "https://x.y/docs#z", "fn f(a: i64, b: (i64, i64)) -> i64")], "q string, m string, p string, u string, s string")
    r = df.select(S.name_tokens(F.col("q")).alias("t"), S.http_route(F.col("m"), F.col("p")).alias("h"), S.normalize_url(F.col("u")).alias("u"), S.arity(F.col("s")).alias("a"), S.slugify(F.lit(" A b--C! ")).alias("g"), S.analyze(F.lit("loadFile load_x a")).alias("z")).first()
    assert (r.t, r.h, r.u, r.a, r.g, r.z) == (["file", "load", "server"], "GET /a/b", "https://x.y/docs/", 2, "a-b-c", ["loadfile", "load", "file", "load_x", "load"])


def test_grounding(spark):
    a = spark.createDataFrame([("a", "uses v1.2.3 and 42 and 77"), ("b", "none"), ("c", None)], "answer_id string, text string")
    s = spark.createDataFrame([("a", "version v1.2.3"), ("a", "has 42")], "answer_id string, text string")
    assert {r.answer_id: r.unsupported for r in retrieval.grounded(a, s).collect()}["a"] == ["77"]
