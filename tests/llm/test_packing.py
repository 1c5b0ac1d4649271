import zlib

import numpy as np
import pytest

from wayfarer.llm import packing

from . import cases as K


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return t


def check(rows, got, tokenizer):
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(ids)
    for i, pieces in by.items():
        pieces.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(pieces):
            part = ids[i][at : at + r["length"]]
            assert (r["piece"], r["start"], len(part)) == (k, at, r["length"]) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids[i]) and (len(pieces) == 1 or at > 1024)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 1024
    total = sum(map(len, ids.values()))
    return len(places), -(-total // 1024)


def test_pieces_and_places(spark, tokenizer):
    rows = K.awkward_rows(7, 120)
    rows += [(500, "I'll <|endoftext|> it's  \n\n x y don't'S", None, "s"), (501, "word " * 1022, None, "s"), (502, "word " * 1023, None, "s"), (503, "͸  \U0001f469‍\U0001f680 กำ", None, "s")]
    used, least = check(rows, packing.pack(K.documents(spark, rows)).collect(), tokenizer)
    assert used <= least * 1.02 + 1


def test_whole_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    used, least = check(rows, packing.pack(docs).collect(), tokenizer)
    assert used <= least + 1


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 300).tolist()
    people = []
    for _ in range(2):
        p = packing.Packing(lengths, 1024)
        p.insert(rng.permutation(300).tolist())
        people.append(p)
    child = packing.crossover(*people, rng)
    packing.mutate(child, rng)
    assert sorted(x for b in child.bins for x in b) == list(range(300))
    assert all(sum(lengths[x] for x in b) + f == 1024 and f >= 0 for b, f in zip(child.bins, child.free, strict=True))


def test_empty(spark):
    assert packing.pack(K.empty(spark)).count() == 0
