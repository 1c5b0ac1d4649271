import math
from collections import Counter

import numpy as np

from wayfarer.llm import common, scoring

from . import cases as K

END = None


def brute(rows):
    tokens = {i: [*K.words(t), END] for i, t, *_ in rows}
    count = Counter(w for i, ts in tokens.items() if K.remainder(i, 7) != 2 for w in ts)
    n, v = sum(count.values()), len(count)
    return {i: (K.remainder(i, 7) == 2, len(ts), sum(count[w] > 0 for w in ts), n, sum(math.log10((count[w] + 1) / (n + (v + 1))) for w in ts)) for i, ts in tokens.items()}


def check(rows, got):
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        held, size, known, n, base = want[r["doc_id"]]
        assert abs(r["base_score"] - base) < 1e-9 * max(1, abs(base)), r
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, size, known, n)
        assert math.isfinite(r["score"]) and r["score"] <= 1e-9


def test_base_counts(spark):
    rows = K.awkward_rows(10, 150)
    check(rows, scoring.lm_score(K.documents(spark, rows)).collect())


def test_small_heads(spark):
    """Most words beyond the broadcast ones: their counts still arrive."""
    rows = K.awkward_rows(11, 80)
    docs = K.documents(spark, rows).select("doc_id", "text", (common.crc_mod(7) == 2).alias("held_out"))
    model = scoring.BackoffModel(heads=20, arcs=15).fit(docs.where("not held_out"))
    check(rows, model.score(docs).collect())


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = scoring.lm_score(docs).collect()
    check(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_each_history_sums_to_one(spark):
    """Probabilities of all words after a history, unknown ones as one, add up to one: each is what the traversal adds for the word."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 12, 60)) for _ in range(40)]
    rows = [(i, t, None, "s") for i, t in enumerate(texts * 3)]  # so often that the automaton holds all 2-grams
    m = scoring.BackoffModel().fit(K.documents(spark, rows).select("text"))
    words = m.model.lexicon.word
    assert len(words) == 13  # with the end
    for history in ([0], [3], [0, 5], [7, 2], [11, 11]):
        total = 0.0
        for w in [*words, np.uint64(3)]:
            tok = np.append(words[history], w).astype(np.uint64)
            _, _, _, model, away, _ = m.model.traverse(tok, np.array([0, len(tok)]))
            _, _, _, before, _, _ = m.model.traverse(tok[:-1], np.array([0, len(tok) - 1]))
            unknown = 0 if w in words else math.log10(1 / m.norm)
            total += 10 ** (model[0] - before[0] + unknown)
        assert abs(total - 1) < 1e-6


def test_empty_and_untrained(spark):
    assert scoring.lm_score(K.empty(spark)).count() == 0
    held = next(i for i in range(100) if K.remainder(i, 7) == 2)
    (r,) = scoring.lm_score(K.documents(spark, [(held, "a b", None, "s")])).collect()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)


def backoff(rows):
    """Scores by dictionaries: 2-grams of all training words that occur twice."""
    sents = {i: [*K.words(t), END] for i, t, *_ in rows}
    train = [s for i, s in sents.items() if K.remainder(i, 7) != 2]
    one, two = (Counter(tuple(s[i : i + k]) for s in train for i in range(len(s) - k + 1)) for k in (1, 2))
    norm = sum(one.values()) + len(one) + 1
    uni = lambda w: (one[(w,)] + 1) / norm
    arcs = {g: (n - 0.6) / one[g[:1]] for g, n in two.items() if n >= 2}
    left, lower = Counter(), Counter()
    for g, p in arcs.items():
        left[g[0]] += p
        lower[g[0]] += uni(g[1])
    fail = {u: max(1 - left[u], 1e-9) / max(1 - lower[u], 1e-9) for u in left}

    def prob(s, k):
        if k == 0:
            return uni(s[0])
        return arcs.get((s[k - 1], s[k])) or fail.get(s[k - 1], 1.0) * uni(s[k])

    return {i: sum(math.log10(prob(s, k)) for k in range(len(s))) for i, s in sents.items()}


def test_arcs_of_all_words(spark):
    """Few broadcast words and n-grams: those of all other words still enter the model."""
    rng = np.random.default_rng(5)
    rows = [r for r in K.awkward_rows(12, 90) if r[0] != 8]
    rows += [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 60, 80)), None, "s") for i in range(60)]
    docs = K.documents(spark, rows).select("doc_id", "text", (common.crc_mod(7) == 2).alias("held_out"))
    want = backoff(rows)
    for bounds in ({"heads": 5, "arcs": 5}, {"heads": 200, "arcs": 50}, {"heads": 0, "arcs": 0}, {}):
        model = scoring.BackoffModel(**bounds).fit(docs.where("not held_out"))
        for r in model.score(docs).collect():
            assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 * max(1, abs(want[r["doc_id"]])), r
