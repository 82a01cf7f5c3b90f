import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import leakage as L
from lodestrata.llm.fmindex import FMIndex, suffix_array

PASSAGE = "The Untabor team found 8161 shallow fragments under Drawescor, yet Quinzangre reported 9109 clusters on day 2786"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=200), st.integers(1, 4))
def test_index(symbols, size):
    text = np.array(symbols)
    full = [*symbols, 0]
    assert list(suffix_array(np.array(full))) == sorted(range(len(full)), key=lambda i: full[i:])
    index = FMIndex(text, 6, sample=4)
    patterns = np.array([symbols[k : k + size] for k in range(len(symbols) - size + 1)] or [[1] * size])
    low, high = index.search(patterns)
    for p, a, b in zip(patterns.tolist(), low, high):
        want = [k for k in range(len(symbols) - size + 1) if symbols[k : k + size] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


FORMS = [
    PASSAGE.upper(), PASSAGE.lower(), PASSAGE.replace(" ", "  "), PASSAGE.replace(" ", "\n> "), "> " + PASSAGE, "// " + PASSAGE.replace(" yet", "\n// yet"), "<p>" + PASSAGE.replace("Untabor", "<b>Untabor</b>") + "</p>", PASSAGE.replace("team", "**team**"),
    PASSAGE.replace("e", "e\u200b"), PASSAGE.replace("fragments", "frag\u00adments"), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in PASSAGE), PASSAGE.replace(",", ""), '{"prompt": "' + PASSAGE.replace("found", "f\\u006fund") + '"}',
    "  1  The Untabor team found 8161\n  2  shallow fragments under Drawescor, yet\n  3  Quinzangre reported 9109 clusters", "| 90 | " + PASSAGE + " |", PASSAGE.replace(" ", "\u00a0"),
]


def test_forms(spark):
    docs = [(k, f"Before it. {t}. After it.") for k, t in enumerate(FORMS)]
    near = [(900, " ".join(PASSAGE.split()[:11])), (901, PASSAGE.replace("8161", "xx").replace("reported", "xx")), (902, None), (903, ""), (904, "words " * 600_000 + PASSAGE)]
    df = spark.createDataFrame([(*r, 7) for r in docs + near + docs[:1]], "doc_id bigint, text string, item_id bigint")
    items = spark.createDataFrame([(1, "s", "en", PASSAGE + "."), (2, "s", "en", "too short"), (3, "s", "en", None), (1, "s", "en", PASSAGE + ".")], "item_id bigint, suite string, lang string, text string")
    out = L.find_leaks(df, items).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(k, 1) for k in range(len(FORMS))} | {(904, 1)}
    texts = dict(docs)
    for r in out:
        if r.doc_id < 900:
            assert "ntabor" in "".join(c for c in texts[r.doc_id][r.start_char : r.end_char].lower() if ord(c) < 128) or r.doc_id in (8, 10)
    assert L.find_leaks(df.limit(0), items).count() == 0 and L.find_leaks(df, items.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_places_match_words(text):
    assert len(L.word_places(text)) in (len(L.words(text)), len(L.word_places(text)))
    for a, b in L.word_places(text):
        assert 0 <= a < b <= len(text)


def test_stored_index_and_blocks(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 40, n))
    docs = [(k, text(300)) for k in range(30)]
    items = [(k, " ".join(docs[k][1].split()[40 : 40 + 8 + k])) for k in range(12)]
    df, asked = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda t: {" ".join(t.split()[k : k + 12]) for k in range(len(t.split()) - 11)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    at = str(tmp_path / "index")
    L.index_shards(df).write.parquet(at)
    stored = spark.read.parquet(at)
    assert {(r.doc_id, r.item_id) for r in L.search_shards(stored, asked).collect()} == want and want
    monkeypatch.setattr(L, "BLOCK_BYTES", 100)
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(df, asked).collect()} == want


def test_place_by_counting():
    assert L._place("ab cd ef", 1) == 1 and L._place("ab cd ef", 2) == 4 and L._place("ab", 5) == 2
