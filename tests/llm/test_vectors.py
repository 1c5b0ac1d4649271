import numpy as np

from wayfarer.llm import vectors

from . import cases as K

SCHEMA = "vec_id long, embedding array<float>, label long, rep long, n string"


def brute(rows):
    joined, links = K.Sets(), {}
    good = [(i, np.array(v, np.float64), y) for i, v, y in rows if v is not None and len(v) and y is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    for i, *_ in rows:
        links[i] = 0
    for a, (i, x, y) in enumerate(good):
        for j, z, w in good[:a]:
            if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.98:
                joined.join(i, j)
                links[i] += 1
                links[j] += 1
    return {i: (links[i], joined.find(i), joined.find(i) == i) for i, *_ in rows}


def found(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "x") for i, v, y in rows], SCHEMA).repartition(3)


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(9, 16))
    rows = []
    for i in range(150):
        v = centre[rng.integers(9)] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(3))))
    rows += [(200 + k, rows[3][1], rows[3][2]) for k in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [None] + [1.0] * 15, 1), (304, rows[0][1], None), (305, [float("inf")] + [1.0] * 15, 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [], 1), (309, [-0.0, 1.0], 2), (310, [0.0, 1.0], 2)]
    assert found(vectors.near_duplicates(frame(spark, rows), tile=16)) == brute(rows)


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert found(vectors.near_duplicates(table)) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 24)) * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = vectors.quantise(x)
    exact = x @ x.T
    for threshold in (0.3, 0.9, 0.98):
        kept = np.zeros(exact.shape, bool)
        kept[vectors.candidates(q, q, threshold)] = True
        assert kept[exact >= threshold].all()


def test_empty(spark):
    assert vectors.near_duplicates(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0


def test_null_ids_and_large_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1.01e200], 1), (3, [1e-200, 1e-200], 1), (4, [1e200, -1e200], 1)]
    table = spark.createDataFrame([*rows, (None, [1e200, 1e200], 1), (None, None, None)], "vec_id long, embedding array<double>, label long")
    got = vectors.near_duplicates(table).collect()
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None}
    assert by == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True)}
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None] == [(0, None, False)] * 2
