from lodestrata.operators import text as T


def test_relations_against_loops(spark):
    rows = [
        ("c1", "d", "s1", 0, "The Parser uses 3 workers and stores Shards on disk."), ("c2", "d", "s2", 1, "The Parser never stores Shards."), ("c3", "d", "s3", 2, "A Parser update replaced the old Shards."),
        ("c4", "d", "s1", 3, "Parser Shards again."), ("c5", "e", "s9", 0, "The Parser uses Shards."), ("c6", "d", "s4", 4, None), ("c7", "d", "s5", 5, ""),
    ]
    df = spark.createDataFrame(rows, "claim_id string, document_id string, section_id string, ord int, text string")
    got = {(r.source_claim_id, r.target_claim_id): (r.relation_type, round(r.confidence, 4)) for r in T.relations(df).collect()}
    assert set(got) == {("c1", "c2"), ("c1", "c3"), ("c2", "c3"), ("c2", "c4"), ("c3", "c4")}
    assert got[("c1", "c2")][0] == "contradicts" and got[("c1", "c3")][0] == "updates"
    both = T.related(T.relations(df), spark.createDataFrame([("c2",)], "claim_id string")).collect()
    assert {(r.other_id, r.relation_type) for r in both} == {("c1", "contradicts"), ("c3", got[("c2", "c3")][0]), ("c4", got[("c2", "c4")][0])}
    assert T.relations(df.limit(0)).count() == 0


def test_claims(spark):
    df = spark.createDataFrame([("s", "Dr. Velm uses 3 tools. It works. Is it 4 now? The Engine stores data here."), ("n", None), ("e", "")], "id string, text string")
    assert [(r.claim_id, r.text) for r in T.claims(df).orderBy("claim_id").collect()] == [("s:c0", "Dr. Velm uses 3 tools."), ("s:c1", "The Engine stores data here.")]


def test_coalesce(spark):
    small, big = "few words", "word " * 60
    rows = [("a", "d", ["A"], 1, small, 0), ("b", "d", ["B"], 1, small, 1), ("c", "d", ["C"], 1, big, 2), ("e", "d", ["E"], 1, small, 3), ("f", "d", ["F"], 2, small, 4), ("g", "x", None, 0, None, 0)]
    df = spark.createDataFrame(rows, "id string, document_id string, heading_path array<string>, depth int, text string, position int")
    got = {(r.document_id, r.group): (r.first_position, r.n_sections) for r in T.coalesced(df).collect()}
    assert got == {("d", 0): (0, 2), ("d", 1): (2, 1), ("d", 2): (3, 1), ("d", 3): (4, 1), ("x", 0): (0, 1)}


def test_summary_keeps_order(spark):
    df = spark.createDataFrame([("a", "Alpha beta gamma. The the. Delta epsilon zeta eta. One more thing here. Last line now."), ("b", "Only one."), ("c", None)], "id string, text string")
    got = {r.id: r.summary for r in T.summaries(df, 2).collect()}
    assert got["b"] == "Only one." and "c" not in got and len(got["a"].split(". ")) == 2
