import numpy as np

from lodestrata.llm import knn as K


def brute(ids, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= least}
    return out


def planted(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    return np.concatenate([base + 0.25 * rng.normal(size=base.shape) for _ in range(4)]).astype(np.float32)


def points(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in row]) for i, row in enumerate(x)], "id bigint, vector array<float>")


def found(df):
    return {tuple(sorted((r.id, r.neighbour))) for r in df.collect()}


def test_recall(spark):
    x = planted(800, 48, 1)
    want = brute(list(range(len(x))), x.astype(np.float64), 5, 0.85)
    got = found(K.neighbours(points(spark, x), 48))
    assert len(want) > 500 and len(want & got) >= 0.97 * len(want) and got <= want


def test_crowded_cells_lose_nothing(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=32) + 0.05 * rng.normal(size=(300, 32))).astype(np.float32)
    want = brute(list(range(300)), x.astype(np.float64), 5, 0.85)
    assert found(K.neighbours(points(spark, x), 32, cell_cap=20)) == want


def test_copies(spark):
    x = np.tile(np.arange(1, 17, dtype=np.float32), (50, 1))
    out = K.neighbours(points(spark, x), 16).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert len(by) == 50
    for i, near in by.items():
        assert [n for _, n in sorted(near)] == [j for j in range(6) if j != i][:5]


def test_live(spark):
    v = spark.createDataFrame(
        [("s", "a", [1.0, 0.0]), ("s", "a", [1.0, 0.0]), ("s", "b", [1.0, 0.01]), ("s", "c", None), ("s", "d", []), ("s", "e", [0.0, 0.0]), ("s", "f", [float("nan"), 1.0]), ("s", "g", [float("inf"), 1.0]), ("s", "h", [1.0]), ("s", "i", [1.0, None]), ("s", "j", [1.0, 0.02])],
        "resolution string, content_id string, vector array<float>",
    ).selectExpr("*", "1 as id", "'x' as class")
    m = spark.createDataFrame([(f"s::{c}", i, c == "j") for i, c in enumerate("abcdefghij")] + [(None, 99, False), ("s::z", None, False)], "vector_id string, int_id bigint, deleted boolean")
    c = spark.createDataFrame([(2,)], "dimension int")
    assert [tuple(r) for r in K.found_pairs(v, m, c).collect()] == [(0, 1)]
    assert K.found_pairs(v.limit(0), m, c).count() == 0
    assert K.found_pairs(v, m, c.limit(0)).count() == 0


def test_probing_order():
    sets = K.probing_sequence(8, 12)
    assert sets[0] == (0,) and len(set(sets)) == 12
    assert all(15 - a not in s for s in sets for a in s)


def test_crowded_direction_goes_to_the_least_ids(spark):
    rng = np.random.default_rng(3)
    one = rng.normal(size=32)
    x = (one * rng.uniform(0.1, 10, size=(400, 1))).astype(np.float32)
    by = {}
    for r in K.neighbours(points(spark, x, 1000), 32, cell_cap=20).collect():
        by.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert len(by) == 400
    for i, near in by.items():
        assert [n for _, n in sorted(near)] == [j for j in range(1000, 1006) if j != i][:5]


def test_whole_lists_of_unrelated_vectors(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([planted(80, 32, 5), rng.normal(size=(60, 32))]).astype(np.float32)
    x = np.concatenate([x, x[:2], 2 * x[100:102]])
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    got = {}
    for r in K.neighbours(points(spark, x), 32, whole=True).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    for i in range(len(x)):
        assert [n for _, n in sorted(got[i])] == sorted((j for j in range(len(x)) if j != i), key=lambda j: (-s[i, j], j))[:5]
