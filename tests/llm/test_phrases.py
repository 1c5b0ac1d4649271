import collections
import random
import re

import numpy as np

from wayfarer.llm import phrases
from wayfarer.llm.phrases import Trie

from . import cases as K


def brute(rows, least, top, share=100):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(5, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    held = collections.Counter()
    for (lang, p), a in found.items():
        for i in range(len(p)):
            for j in range(i + 2, len(p) + 1):
                if j - i < len(p):
                    held[lang, p[i:j]] = max(held[lang, p[i:j]], a)
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * held[lang, p] >= share * a:
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, m, -s) for lang, rows in out.items() for i, (s, a, p, left, right, m) in enumerate(sorted(rows)[:top]))


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def talk(seed=1, many=120):
    """Few words, so that phrases repeat; pieces, languages, nulls and capitals."""
    rng = random.Random(seed)
    rows = [(0, None, "aa", None), (1, "", None, None), (2, " .,\t", "bb", None), (3, "A b. A b", "und", None), (4, "é中 a\x1fb \x00", "aa", None)]
    for i in range(5, many):
        words = [rng.choice(["a", "B", "c", "dd", "E", "the", "The", "of the", "é", "new york city", "one two three four five six"]) + rng.choice(["", "", "", ".", ",", "\n", "!", " "]) for _ in range(rng.randrange(1, 60))]
        rows.append((i, " ".join(words), rng.choice(["aa", "aa", "bb", None]), None))
    rows.append((900, "the end of all " * 20_000, "bb", None))  # one long text, one frequent phrase
    rows += [(901, rows[7][1], "aa", None)] * 3
    return rows


def test_equals_counting_every_phrase(spark):
    rows = talk()
    for least, top in ((5, 40), (2, 5000)):
        want = brute(rows, least, top)
        assert len(want) > 60 and found(phrases.collocations(K.documents(spark, rows), least, top)) == want


def test_many_shards_and_ranges(spark):
    """Limits cut through nodes of every level; shards end within texts' languages."""
    rows = talk(2)
    assert found(phrases.collocations(K.documents(spark, rows), 3, 3000, shard=300, range_bytes=1500)) == brute(rows, 3, 3000)


def test_a_hash_that_clashes_is_replaced(spark, monkeypatch):
    rows = talk(3, 60)
    real = phrases.Scan.__init__

    def coarse(self, raw, off, seed):
        real(self, raw, off, seed)
        if seed < 2:  # two bits of the hash
            self.hash = self.hash & np.uint64(3 << 60) | np.uint64(1)

    segments, sampled = phrases._segments, phrases._sampled

    def patched(make):
        def outer(*args):
            run = make(*args)

            def inner(batches):
                phrases.Scan.__init__ = coarse
                try:
                    yield from run(batches)
                finally:
                    phrases.Scan.__init__ = real

            return inner

        return outer

    monkeypatch.setattr(phrases, "_segments", patched(segments))
    monkeypatch.setattr(phrases, "_sampled", patched(sampled))
    assert found(phrases.collocations(K.documents(spark, rows), 3, 3000)) == brute(rows, 3, 3000)


def test_awkward_documents_and_an_empty_table(spark):
    rows = K.awkward_rows(4, 80) + [(None, "a b c d e f", None, None)] * 3
    assert found(phrases.collocations(K.documents(spark, rows), 3, 2000)) == brute(rows, 3, 2000)
    assert found(phrases.collocations(K.empty(spark))) == []


def test_scores_beyond_64_bits(spark):
    """Weighing is exact where products pass 64 bits."""
    a, left, right, n = 10**11 + 3, 3 * 10**11 + 7, 2 * 10**11 + 1, 10**13 + 19
    row = spark.createDataFrame([(a, left, right, n)], "a long, l long, r long, n long")
    assert row.selectExpr(f"{phrases.SCORE} AS s").first()["s"] == 1000 * a * n // (left * right)


def test_merging_serialised_tries_counts_all():
    rng = np.random.default_rng(1)
    tries, total = [], collections.Counter()
    for _ in range(7):
        hashes = rng.choice(rng.integers(1, 2**63, 9, dtype=np.uint64), 400)
        piece = np.sort(rng.integers(0, 60, 400))
        seq = phrases.sequences(hashes, piece, 4)
        tries.append(Trie.from_bytes(Trie.counted(seq).to_bytes()))
        for column in seq.T.tolist():
            for d in range(1, 5):
                if column[d - 1]:
                    total[tuple(column[:d])] += 1
    trie = Trie.merged(tries)
    got = {tuple(p): int(c) for d, (_, _, count) in enumerate(trie.levels) for p, c in zip(trie.paths(d, np.arange(len(count))).T.tolist(), count, strict=True)}
    assert got == dict(total)
