from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import chunking as K


def rebuilt(text, pieces):
    return "".join(text[a + o : b] for a, b, o in pieces)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "## Sub\n", "word word. ", "A sentence here. ", "- item\n", "\n", "\n\n", "| a | b |\n", "```\n", "x = 1\n", "字。", "z" * 60]), max_size=80).map("".join), st.integers(60, 300))
def test_round_trip(text, limit):
    pieces = K.cut(text, limit, 20)
    assert rebuilt(text, pieces) == text
    assert all(b - a <= limit for a, b, _ in pieces) and all(o <= 20 for *_, o in pieces)
    if len(text) > limit:
        assert len(pieces) > 1


def test_natural_cuts():
    text = "\n\n".join(f"Paragraph {n} has some words. It goes on." for n in range(40))
    for a, b, o in K.cut(text, 300, 50)[1:]:
        assert text[: a + o].endswith("\n\n")


def test_no_boundary():
    assert [b - a for a, b, o in K.cut("x" * 1000, 300, 0)] == [300, 300, 300, 100]


def test_sections(spark):
    long = "One sentence here. " * 200
    rows = [("a", "d", ["H"], 1, long, None, 0), ("a", "d", ["H"], 1, long, None, 0), ("b", "d", None, 0, None, None, 1), ("c", "d", [], 0, "", None, 2), ("e", None, ["x" * 3000], 1, long, None, None), ("f", "d", ["H"], 1, "y" * 1998, None, 3), ("g", "d", ["H"], 1, "y" * 1999, None, 3)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, document_id string, heading_path array<string>, depth int, text string, summary string, position int, piece string")
    out = K.section_pieces(df).collect()
    assert {r.section_id for r in out} == {"a", "b", "c", "e", "f", "g"}
    for r in out:
        assert len(r.heading) + (1 if r.heading else 0) + len(r.text) <= 2000
    a = sorted((r for r in out if r.section_id == "a"), key=lambda r: r.piece)
    assert len(a) == a[0].n_pieces and "".join(r.text[r.overlap_chars :] for r in a) == long
    assert {r.section_id for r in K.oversized_sections(df).collect()} == {"a", "e", "g"}
    e = sorted((r for r in out if r.section_id == "e"), key=lambda r: r.piece)
    assert "".join(r.text[r.overlap_chars :] for r in e) == "x" * 3000 + "\n" + long


def test_long_heading_stays_whole(spark):
    df = spark.createDataFrame([("a", "d", ["h" * 1500, "last"], 1, "One sentence here. " * 60, None, 0), ("b", "d", ["h" * 1990], 1, "y" * 20, None, 0)], "id string, document_id string, heading_path array<string>, depth int, text string, summary string, position int")
    out = K.section_pieces(df).collect()
    a = [r for r in out if r.section_id == "a"]
    assert {r.heading for r in a} == {"h" * 1500 + " > last"} and all(len(r.heading) + 1 + len(r.text) <= 2000 for r in a)
    assert sorted(len(r.text) for r in out if r.section_id == "b") and sum(r.section_id == "b" for r in out) == 2
    assert {r.section_id for r in K.oversized_sections(df).collect()} == {"a", "b"}
    assert K.section_pieces(df.limit(0)).count() == 0
