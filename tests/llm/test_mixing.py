from collections import Counter

from wayfarer.llm import mixing

from . import cases as K


def targets(sizes: dict) -> dict:
    """Shares by weight, those above their cap taken out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), {s for s in order if sizes[s]}, dict.fromkeys(order, 0.0)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def check(rows, got):
    size = {i: len(K.words(t)) for i, t, *_ in rows}
    source = {i: s for i, _, _, s in rows}
    total = Counter()
    for i, n in size.items():
        total[source[i]] += n
    want = targets(total)
    taken = Counter()
    for r in got:
        i = r["doc_id"]
        assert r["size"] == size[i] and r["source_size"] == total[source[i]] and abs(r["target"] - want[source[i]]) < 1e-6 * max(1, want[source[i]])
        assert 0 <= r["taken"] <= 2 * size[i] and (not size[i] or r["taken"] % size[i] == 0)
        taken[source[i]] += r["taken"]
    assert len(got) == len(rows)
    for s, t in want.items():
        sums = 1  # bits: the sums that some choice of takes reaches
        for i, n in size.items():
            if source[i] == s:
                sums |= sums << n | sums << 2 * n
        best = min(abs(k - t) for k in range(max(0, int(t) - 5000), int(t) + 5000) if sums >> k & 1)
        assert abs(taken[s] - t) <= best + 0.01 * t, (s, taken[s], t, best)
    return taken


def test_targets_and_takes(spark):
    rows = [r for r in K.awkward_rows(4, 400) if r[0] != 8]
    docs = K.documents(spark, rows)
    got = mixing.mixture(docs).collect()
    check(rows, got)
    again = mixing.mixture(docs.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, r["source"]) for r in docs.collect()]
    check(rows, mixing.mixture(docs).collect())


def test_rows_of_the_mix(spark):
    """The shards hold every take once, whatever their number."""
    rows = [r for r in K.awkward_rows(6, 300) if r[0] != 8]
    docs = K.documents(spark, rows)
    for shards in (1, 8):
        mixed = mixing.mix(docs, shards=shards)
        assert mixed.columns == docs.columns
        times = Counter(r["doc_id"] for r in mixed.collect())
        for r in mixing.mixture(docs, shards=shards).where("size > 0").collect():
            assert times[r["doc_id"]] * r["size"] == r["taken"]


def test_many_sources_and_empty(spark):
    assert mixing.mixture(K.empty(spark)).count() == 0
    rows = [(i, "w " * (i % 7), None, f"s{i % 23}" if i % 29 else None) for i in range(600)]
    check(rows, mixing.mixture(K.documents(spark, rows)).collect())
    blank = [(1, None, None, "a"), (2, "", None, None)]
    assert [r["taken"] for r in mixing.mixture(K.documents(spark, blank)).collect()] == [0, 0]


def test_hypergeometric_draws(spark):
    """Mean and bounds of the split's draws."""
    u = "(cast(id as double) + 0.5D) / 2000D"
    rows = spark.range(2000).selectExpr(mixing._hypergeometric("100D", "30D", "40D", u) + " as x").collect()
    xs = [r["x"] for r in rows]
    assert min(xs) >= 0 and max(xs) <= 30 and abs(sum(xs) / len(xs) - 12) < 0.05


def test_long_documents(spark):
    """Documents of a source's size order: other blocks fill what they would leave."""
    cases = [K.awkward_rows(4, 400)]
    for first in (0, 10_000, 20_000):
        rows = [(first + i, "w " * (20 + i % 21), None, "a") for i in range(2000)] + [(first + 5000 + i, "w " * 30_000, None, "a") for i in range(2)]
        cases.append(rows + [(first + 6000 + i, "w " * 40, None, "bbc"[i % 3]) for i in range(1500)])
    for rows in cases:
        size, source = {i: len(K.words(t)) for i, t, *_ in rows}, {i: s for i, _, _, s in rows}
        taken, target, sums = Counter(), {}, Counter()
        for r in mixing.mixture(K.documents(spark, rows)).collect():
            s, n = source[r["doc_id"]], size[r["doc_id"]]
            taken[s] += r["taken"]
            target[s] = r["target"]
            sums[s] = (bits := sums[s] or 1) | bits << n | bits << 2 * n
        for s, t in target.items():
            best = next(d for d in range(200_000) if any(k >= 0 and sums[s] >> k & 1 for k in (round(t) - d, round(t) + d)))
            assert abs(taken[s] - t) <= best + 1 + 0.01 * t, (s, taken[s], t, best)
