import pytest

from wayfarer.llm import jaccard

from . import cases as K


def brute(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = K.words(text)
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    joined = K.Sets()
    ids = [i for i in sets if sets[i]]
    for i in ids:
        for j in ids:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                joined.join(i, j)
    return {i: (len(s), joined.find(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_equals_all_pairs(spark):
    for seed in (1, 2):
        rows = K.awkward_rows(seed, 90)
        assert found(jaccard.similar(K.documents(spark, rows))) == brute(rows)


def test_small_blocks_and_crowded_keys(spark, monkeypatch):
    """Many keys beyond a block, and frequent shingles dealt over partitions."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "BUFFER", 50)
    monkeypatch.setattr(jaccard, "CELLS_LEAST", 1 << 15)
    rows = K.awkward_rows(3, 120)
    assert found(jaccard.similar(K.documents(spark, rows))) == brute(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(jaccard.similar(docs)) == brute(rows)


def test_nulls_repeats_and_empty(spark):
    assert jaccard.similar(K.empty(spark)).count() == 0
    rows = [(None, "a b c d e f", None, None), (7, "a b c d e f", None, None), (7, "a b c d e f", None, None), (9, "a b c d e f", None, None)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.similar(K.documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, None), (7, 7), (7, 7), (9, 7)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_bound_of_bitmaps_never_drops_a_pair(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(80)]
    n = np.array([len(s) for s in sets])
    bits = np.stack([np.frombuffer(jaccard.bitmap(s, 256), np.uint8) for s in sets])
    a, b = jaccard.tree_pairs(np.zeros(80, np.int64), np.zeros(80, np.int64), np.arange(80), np.arange(80), n, bits, percent)
    kept = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    for i in range(80):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            assert o * 100 < (n[i] + n[j] - o) * percent or (j, i) in kept


def test_forests_join_what_their_pairs_join():
    """One forest has a tree for each component; many have every pair."""
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, (2, 90))
    x, y = x[x != y], y[x != y]
    one = jaccard.forests(x, y, np.arange(len(x)), 40, 1)
    a, b = K.Sets(), K.Sets()
    for i in range(len(x)):
        a.join(int(x[i]), int(y[i]))
    for i in one:
        assert b.find(int(x[i])) != b.find(int(y[i]))
        b.join(int(x[i]), int(y[i]))
    assert all(a.find(i) == b.find(i) for i in range(40))
    assert sorted(jaccard.forests(x, y, np.arange(len(x)), 40, 90)) == list(range(len(x)))


def test_rounds_of_single_forests(spark, monkeypatch):
    """Many near misses beside few forests a round: every pair is decided in the end."""
    monkeypatch.setattr(jaccard, "FORESTS", 1)
    rows = K.awkward_rows(5, 100)
    assert found(jaccard.similar(K.documents(spark, rows))) == brute(rows)


def test_clashing_first_hashes(spark, monkeypatch):
    """Unlike sets with one first hash stay apart."""
    import numpy as np

    plain = jaccard._set_keys
    monkeypatch.setattr(jaccard, "_set_keys", lambda v, at: ((plain(v, at)[0] % 7).astype(np.int64), plain(v, at)[1]))
    values = np.arange(60, dtype=np.uint64)
    at = np.arange(0, 61, 3)
    first, second = jaccard.class_names(values, at, np.zeros(0, np.int64))
    apart, _ = jaccard.class_names(values, at, np.unique(first))
    assert len(set(first)) < 8 and len(set(apart)) == 20 == len(set(second))
