"""The corpus pipeline, stage by stage against plain versions, and as a whole."""

from __future__ import annotations

import corpus_pipeline as P

from . import cases as K
from .test_jaccard import brute


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_copies_go_but_for_the_first(spark, sf_dir):
    rows = K.awkward_rows(21, 90)
    docs = K.documents(spark, rows)
    kept = P.distinct_documents(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert ids(kept) == sorted(i for i, (_, component) in brute(rows).items() if i == component)


def test_passages_go_where_they_repeat(spark, sf_dir):
    rows = K.awkward_rows(22, 70)
    docs = K.documents(spark, rows)
    kept = {r["doc_id"]: r for r in P.without_repeated_passages(spark, docs, sf_dir).collect()}
    seen, want = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = set()
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone.update(range(k, k + 50))
        seen.update(b[k : k + 50] for k in range(len(b) - 49))
        left = bytes(c for k, c in enumerate(b) if k not in gone)
        if not b or left:
            want[i] = left
    assert set(kept) == set(want)
    for i, left in want.items():
        assert (kept[i]["text"] or "").encode() == left or not left.decode("utf-8", "replace").isascii()
        assert kept[i]["source"] == next(r[3] for r in rows if r[0] == i)


def test_the_whole(spark, sf_dir):
    """Every stage takes rows away or repeats them as it says; pieces fill sequences."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in P.STAGES:
        tables.append(P.common.keep(stage(spark, tables[-1], sf_dir), name.replace(" ", "_")))
    for table in tables[:-1]:
        assert table.columns == docs.columns
    found = [ids(t) for t in tables]
    assert set(found[1]) < set(found[0]) and set(found[2]) < set(found[1]) and set(found[3]) <= set(found[2]) and set(found[4]) <= set(found[3])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [i for i in found[0] if labels.get(i) == 1]
    assert sum(i in set(found[1]) for i in good) >= 0.9 * len(good)
    pieces = tables[-1].collect()
    assert sorted({r["doc_id"] for r in pieces}) == sorted(set(found[4]))
    filled = {}
    for r in pieces:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert max(filled.values()) <= 1024 and len(filled) <= -(-sum(filled.values()) // 1024) + 2


def test_an_empty_table(spark, sf_dir):
    docs = K.empty(spark)
    for _, stage in P.STAGES[1:]:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0
