import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs

from wayfarer.llm import common, tokenfiles

from . import cases as K


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.tokenizer_path())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=700), st.data())
def test_elias_fano_gives_back_every_number(values, data):
    values = np.array(sorted(values), np.uint64)
    code = tokenfiles.EliasFano.from_bytes(tokenfiles.EliasFano.of(values).to_bytes())
    assert len(code) == len(values) and (code.slice(0, len(values)) == values).all()
    if len(values):
        i = data.draw(st.integers(0, len(values) - 1))
        j = data.draw(st.integers(i, len(values)))
        assert code.select(i) == int(values[i]) and (code.slice(i, j) == values[i:j]).all()
        assert code.first_from(int(values[i])) == int(np.searchsorted(values, values[i]))


def test_elias_fano_is_small():
    n = 100_000
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, n)).astype(np.uint64)
    bits = 8 * len(tokenfiles.EliasFano.of(values).to_bytes()) / n
    assert bits < 2.2 + np.log2(int(values[-1]) / n)


def awkward():
    rows = K.awkward_rows(7, 100)
    odd = ["x<|endoftext|>y 's a's <|startoftext|>", "é é e ́à  b　c d İ Σας ΑΣ", "a\x0b\x0cb\u0085c \x1cd", "‍​ 12³ ½", "ﬁ ẞ ǅ ͅ ̈́", "x" * 5000, "word " * 300_000, "\x00 a"]
    rows += [(500 + i, t, None, "s") for i, t in enumerate(odd)]
    return rows + [(None, "no id", None, "s"), (None, None, None, "s"), (-5, "less than nothing", None, "s"), (-(2**63), "least", None, "s"), (2**63 - 1, "most", None, "s"), (700, "b a", None, "s"), (700, None, None, "s"), (700, "a b", None, "s")]


def expected(rows, tokenizer):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for doc_id, text, *_ in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_equals_the_tokenizer(spark, tokenizer, monkeypatch):
    rows = awkward()
    assert found(tokenfiles.token_files(K.documents(spark, rows))) == expected(rows, tokenizer)


def test_files_ranges_and_lookups(spark, tokenizer):
    """Small files and ranges: the same documents, each once; documents by number and by id."""
    rows = [r for r in K.awkward_rows(9, 80) if r[0] != 8]
    folder = f"{common.shared_dir(spark)}/ids-test"
    tokenfiles.write_ids(K.documents(spark, rows), folder, file_ids=500)
    listed = tokenfiles.listed(folder)
    assert len(listed) > 3
    spark.dataSource.register(tokenfiles.IdSource)
    for step in (7, 400, 1 << 20):
        back = spark.read.format("wayfarer_ids").option("path", folder).option("rangeIds", str(step)).load()
        assert found(back) == expected(rows, tokenizer)
    ids = {r["doc_id"]: r["ids"] for r in tokenfiles.read_ids(spark, folder, ids=True).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all(ids[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items())
    files, root = fs.FileSystem.from_uri(folder)
    file = tokenfiles.IdFile(files, f"{root}/{listed[1]['name']}")
    for k, doc_id in enumerate(file.doc_ids(0, file.docs).to_pylist()):
        assert file.document(k).tolist() == ids[doc_id] and file.find(doc_id) == k
    assert file.find(10**9) is None and file.find(-1) is None


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(tokenfiles, "REMEMBERED", 5000)
    monkeypatch.setattr(tokenfiles, "STRETCH", 64)
    encoder = tokenfiles.WordEncoder(tokenfiles.tokenizer_path())
    for _, text, *_ in awkward():
        if text and len(text) < 20_000:
            got = np.frombuffer(b"".join(encoder.encode(text.encode())), "<u2").tolist()
            assert got == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty(spark):
    assert tokenfiles.token_files(K.empty(spark)).collect() == []
