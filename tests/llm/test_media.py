import hashlib
import zlib

import pytest

from wayfarer.llm import common, media

from . import cases as K


def test_round_trip(spark):
    rows = K.awkward_rows(8, 60) + [(None, "no id", None, "s"), (700, "x" * 64, None, "s"), (701, "x" * 64, None, "t")]
    got = media.media(K.documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, text, *_ in rows:
        b = (text or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        image = media.encode_image(p)
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest()) and media.decode_image(image) == p
    assert by[700][1:] == by[701][1:]


def test_ranges_cover_each_member_once(spark):
    """Members are read once, however ranges cut the archives."""
    docs = K.documents(spark, K.awkward_rows(9, 80))
    folder = f"{common.shared_dir(spark)}/media-test"
    media.store(docs, folder)
    spark.dataSource.register(media.ArchiveSource)
    for step in (64, 1000, 1 << 20):
        back = spark.read.format("wayfarer_archive").option("path", folder).option("rangeBytes", str(step)).load()
        assert sorted(r["doc_id"] for r in back.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_damage_is_found():
    image = bytearray(media.encode_image(b"a" * 128))
    image[60] ^= 1
    with pytest.raises((OSError, zlib.error)):
        media.decode_image(bytes(image))


def test_member_is_retried(monkeypatch, tmp_path):
    """A read that fails goes again by its offset."""
    image = media.encode_image(b"b" * 64)
    head = media._HEAD.pack(media._MARK, False, 5, 64, len(image))
    (tmp_path / "a.bin").write_bytes(head + image)
    files, root = media._place(str(tmp_path))
    reader = media._Reader({"path": str(tmp_path)})
    tries = []

    class Flaky:
        def open_input_file(self, path):
            tries.append(path)
            if len(tries) < 3:
                raise OSError("not now")
            return files.open_input_file(path)

    reader.file = None
    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    got = reader._member(Flaky(), f"{root}/a.bin", 0, len(head) + len(image))
    assert got["payload"] == b"b" * 64 and got["doc_id"] == 5 and len(tries) == 3


def test_empty(spark):
    assert media.media(K.empty(spark)).count() == 0
