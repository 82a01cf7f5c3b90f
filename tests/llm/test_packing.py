import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_uses_every_item_once(lengths):
    plan = P.plan(Counter(lengths), 64)
    used = Counter()
    for times, lengths_of_one in plan:
        assert sum(lengths_of_one) <= 64
        for x in lengths_of_one:
            used[x] += times
    assert used == Counter(lengths)


def test_plan_is_tight():
    rng = random.Random(3)
    counts = Counter(min(4096, max(5, int(rng.lognormvariate(5.2, 0.8)))) for _ in range(20_000))
    n = sum(t for t, _ in P.plan(counts))
    assert n <= -(-sum(x * c for x, c in counts.items()) // 4096) + 2


def test_exact_combinations_first():
    assert sorted(P.plan(Counter({60: 2, 40: 2, 100: 1}), 100)) == [(1, (100,)), (2, (60, 40))]


def test_pack(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 10_000), (5, "same"), (5, "same"), (None, "x")] + [(100 + k, "the same text again") for k in range(40)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, container string")
    out = P.pack(df, capacity=512).collect()
    total, places = Counter(), Counter()
    for r in out:
        total[r.container] += r.n_tokens
        places[(r.container, r.position)] += 1
    assert max(total.values()) <= 512 and set(places.values()) == {1} and sorted(total) == list(range(len(total)))
    long = sorted((r for r in out if r.doc_id == 4), key=lambda r: r.piece)
    assert len(long) == long[0].n_pieces and long[0].start_char == 0 and long[-1].end_char == 50_000 and all(a.end_char == b.start_char for a, b in zip(long, long[1:]))
    assert Counter(r.doc_id for r in out if r.doc_id != 4) == Counter([1, 5, 5, None] + [100 + k for k in range(40)])
    assert P.pack(df.limit(0), capacity=512).count() == 0
    assert [r.doc_id for r in P.oversized(df, capacity=512).collect()] == [4]


def test_pieces_keep_characters(spark):
    with open(f"{P.TOKENIZER_DIR}/{P.TOKENIZER}", "rb") as f:
        encoder = P._encoder(f.read())
    text = "索引は件の節🙂 " * 400
    pieces = P._pieces(encoder, text, 100)
    assert "".join(text[a:b] for a, b, _ in pieces) == text and all(n <= 100 for *_, n in pieces)
