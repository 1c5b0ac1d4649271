import hashlib

import numpy as np
import pytest

from wayfarer.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label long, code string, n string"


def brute(rows, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    width = -(-max(len(r[1]) for r in kept) // 4)
    whole = {id(r): np.array([*np.floor(1024 * np.array(r[1], np.float64)), *[0] * (4 * width - len(r[1]))], np.int64) for r in kept}
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.floor(1024 * np.array(r[1], np.float64)).tolist()))
    x = np.array([whole[id(r)] for r in kept]).reshape(len(kept), 4, width)
    books = x[:entries].copy()
    near = lambda: np.stack([((x[:, p, None] - books[None, :, p]) ** 2).sum(2).argmin(1) for p in range(4)], 1)
    for _ in range(rounds):
        code = near()
        for p in range(4):
            for k in range(len(books)):
                mine = x[code[:, p] == k, p]
                if len(mine):
                    books[k, p] = mine.sum(0) // len(mine)
    code = near()
    error = sum(((x[:, p] - books[code[:, p], p]) ** 2).sum(1) for p in range(4))
    label = {}
    for r, e in zip(kept, error.tolist(), strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for p in range(4) for e in books[:, p] for v in e.tolist()).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{c:02x}" for c in cs), e, label[r[2]], sha) for r, cs, e in zip(kept, code.tolist(), error.tolist(), strict=True)], key=str)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "x") for i, v, y in rows], SCHEMA).repartition(3)


def some(seed, n, dim, spread=1.0, clusters=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dim))
    return [(int(i) * 3, [float(np.float32(c)) for c in centre[rng.integers(clusters)] + spread * rng.normal(size=dim)], [None, 1, 2][int(rng.integers(3))]) for i in rng.permutation(n)]


def test_equals_plain_lloyd(spark):
    rows = some(1, 700, 16)
    rows += [(5000 + k, rows[3][1], 1) for k in range(40)]  # copies
    rows += [(9000, None, 1), (9001, [float("nan")] * 16, 1), (9002, [None] + [1.0] * 15, 1), (9003, [float("inf")] + [1.0] * 15, 1), (9004, [0.0] * 16, 7), (9005, [-0.0] * 16, None), (None, [0.5] * 16, 1), (1, [0.25] * 16, 2), (1, [0.125] * 16, 2)]
    assert found(codebooks.codes(frame(spark, rows))) == brute(rows)


def test_few_entries_ties_and_small_blocks(spark, monkeypatch):
    """Whole numbers near zero: many equal distances and entries that go unused."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 8) / 1024).tolist(), i % 2) for i in range(300)]
    for entries in (1, 2, 7, 256):
        assert found(codebooks.codes(frame(spark, rows), entries=entries)) == brute(rows, entries)


def test_lengths_that_differ(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [0.5] * 5, None), (4, [-1.0], 2)]
    assert found(codebooks.codes(frame(spark, rows))) == brute(rows)


def test_bounds_spare_comparisons(spark):
    """Clustered vectors settle: later rounds compare a part of them, and the result is the plain one."""
    rows = some(3, 3000, 16, 0.02, 40)
    fit = codebooks.fit(frame(spark, rows), entries=40, rounds=6)
    assert fit.scanned[0] == 12_000 and fit.scanned[-1] < 6000 and sum(fit.scanned[1:]) < 0.7 * 6 * 12_000
    assert found(codebooks.codes(frame(spark, rows), entries=40, rounds=6)) == brute(rows, 40, 6)


def test_heaps_pop_what_drift_has_passed():
    rng = np.random.default_rng(4)
    code, key = rng.integers(0, 5, 400), rng.random(400) * 10
    heaps = codebooks.Heaps.made(code, key, 6)
    for _ in range(5):
        drift = rng.random(6) * 4
        rows, left = heaps.pop(drift)
        assert sorted(rows.tolist()) == np.flatnonzero(key <= drift[code] + codebooks.SLACK).tolist()
        code[rows], key[rows] = rng.integers(0, 5, len(rows)), rng.random(len(rows)) * 10
        heaps = heaps.pushed(left, code[rows], key[rows], rows)
        assert sorted(heaps.row.tolist()) == list(range(400))
        for e in range(6):
            h = heaps.key[heaps.at[e] : heaps.at[e + 1]]
            assert all(h[(i - 1) // 2] <= h[i] for i in range(1, len(h)))
            assert (code[heaps.row[heaps.at[e] : heaps.at[e + 1]]] == e).all()


def test_large_components(spark):
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.random.default_rng(5).integers(-16_000, 16_000, (60, 8)))]
    assert found(codebooks.codes(frame(spark, rows), entries=9)) == brute(rows, 9)
    with pytest.raises(ValueError):
        codebooks.codes(frame(spark, [(1, [1e30] * 4, 1)]))


def test_empty(spark):
    assert found(codebooks.codes(frame(spark, []))) == []
    assert found(codebooks.codes(frame(spark, [(1, None, 1)]))) == []
