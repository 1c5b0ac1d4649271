import hashlib

from wayfarer.llm import repeats

from . import cases as K


def brute(rows, least=50):
    first = {}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        for i in range(len(b) - least + 1):
            s = b[i : i + least]
            first[s] = min(first.get(s, doc_id), doc_id)
    out = {}
    for doc_id, text, *_ in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if first[b[i : i + least]] < doc_id:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = K.awkward_rows(seed, 80)
        assert found(repeats.repeats(K.documents(spark, rows))) == brute(rows)


def test_crowded_anchors_and_small_buffers(spark, monkeypatch):
    """Anchors resolved string by string, contexts in many suffix arrays, buffers that end anywhere."""
    monkeypatch.setattr(repeats, "CROWD", 3)
    monkeypatch.setattr(repeats, "BLOCK", 4)
    monkeypatch.setattr(repeats, "BUFFER", 40)
    rows = K.awkward_rows(5, 70)
    passage = "the very same passage that a great many of the documents of this table share with each other "
    rows += [(1000 + i, f"{'ab' * (i % 7)} {passage}{'yz' * (i % 5)} {i}", None, "s") for i in range(60)]
    assert found(repeats.repeats(K.documents(spark, rows))) == brute(rows)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(repeats.repeats(docs)) == brute(rows)


def test_periodic_text_and_empty(spark):
    assert repeats.repeats(K.empty(spark)).count() == 0
    rows = [(i, "ab" * (20 + i), None, "s") for i in range(12)] + [(50, "x" * 400, None, "s"), (51, "x" * 49, None, "s"), (52, "x" * 50, None, "s")]
    assert found(repeats.repeats(K.documents(spark, rows))) == brute(rows)


def test_texts_without_their_repeats(spark):
    long = "a passage of far more than fifty bytes that stands in two documents "
    rows = [(1, f"first {long}end", "aa", "s"), (2, f"second {long}end", "aa", "s"), (3, None, "aa", "s")]
    out = {r["doc_id"]: r for r in repeats.without_repeats(K.documents(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[2]["text"] == "second" and out[3]["text"] is None
    assert out[2]["score"] == "x"


def test_rows_without_id_or_with_one_id(spark):
    long = "a passage of far more than fifty bytes that stands in two documents "
    rows = [(None, long, None, "s"), (4, long, None, "s"), (4, long + "!", None, "s"), (5, long, None, "s")]
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.repeats(K.documents(spark, rows)).collect()}
    n = len(long)
    assert got == {(None, n): 0, (4, n): 0, (4, n + 1): 0, (5, n): n}
