"""Token ids in binary files, with document boundaries in Elias-Fano form.

Write: documents are dealt out by ranges of their id and sorted within each, so
that the files, taken by partition and number, hold all documents in ascending
order.  A task encodes a document's words one stretch after the other, appends
the end id and streams the ids to a file of bounded size; a task reports the
files that it finished, and what a lost or repeated attempt leaves behind is in
no report and is never read.

A file is::

    8 bytes   mark
    ids       one after the other, 2 bytes each where the vocabulary allows, else 4
    starts    Elias-Fano code of where each document begins, and of the end
    names     Elias-Fano code of the document ids less the smallest
    57 bytes  footer: counts, places, smallest document id, documents without id

The Elias-Fano code of n ascending numbers up to m takes n * (2 + log2(m / n))
bits: low bits packed, high bits in unary.  Every 256th one bit's place is kept,
so that ``select`` looks at a few bytes and no table of 64-bit offsets exists.

Read: ``spark.read.format("wayfarer_ids")`` plans ranges of ids over the files of
the report, whose counts say how many ids stand before each file; a partition
takes the documents that begin in its range, found by ``select``.

The tokenizer drops white space, and neither its normal forms nor its pieces
reach across ASCII white space, so a text's ids are those of its words one after
the other; each distinct word is encoded once and remembered, up to a bound.

Defined results: null and empty texts have the end id only; rows without an id
come last; rows of one id stand in the order of their texts, null first; an
empty table gives no rows.  Extra columns aren't carried along.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C

END = 2
#: Bytes of text for a partition, about; ids and documents after which a file ends; ids that one read task takes; ids of a batch.
TEXT_BYTES, FILE_IDS, FILE_DOCS, RANGE_IDS, BATCH_IDS = 48 << 20, 1 << 25, 1 << 20, 1 << 22, 1 << 20
#: Bytes of text that are encoded at once; bytes of words that a task remembers, with what they take besides.
STRETCH, REMEMBERED, BESIDES = 1 << 19, 128 << 20, 220
#: A one bit's place is kept for each so many.
SAMPLE = 256
_MARK = b"WFIDS\x00\x01\n"
_FOOT = struct.Struct("<8sBqqqqqq")  # mark, bytes an id, ids, documents, of these without id, smallest id, place of starts, place of names


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# -- Elias-Fano ------------------------------------------------------------


class EliasFano:
    """Ascending numbers below 2**64, equal ones allowed."""

    _HEAD = struct.Struct("<qBqqq")  # numbers, low bits, bytes of low, high and samples

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = min(63, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(place[-1]) // 8 + 1 if n else 0, np.uint8)
        np.bitwise_or.at(high, place >> 3, (1 << (place & 7)).astype(np.uint8))
        return cls(n, bits, _packed(values, bits), high, place[::SAMPLE].astype(np.uint32 if len(high) < 1 << 29 else np.uint64))

    def __len__(self) -> int:
        return self.n

    def slice(self, i: int, j: int) -> np.ndarray:
        """Numbers i to j - 1."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = i // SAMPLE, (j - 1) // SAMPLE + 1
        begin = int(self.samples[first])
        end = int(self.samples[last]) // 8 + 1 if last < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : end], bitorder="little")) + begin // 8 * 8
        ones = ones[np.searchsorted(ones, begin) :][i - first * SAMPLE : j - first * SAMPLE]
        top = (ones - np.arange(i, j)).astype(np.uint64)
        return (top << np.uint64(self.low_bits)) | _unpacked(self.low, self.low_bits, i, j)

    def select(self, i: int) -> int:
        return int(self.slice(i, i + 1)[0])

    def first_from(self, x: int) -> int:
        """How many numbers are smaller than ``x``."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self.select(m) < x else (a, m)
        return a

    def to_bytes(self) -> bytes:
        low, high, samples = self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()
        return self._HEAD.pack(self.n, self.low_bits, len(low), len(high), len(samples)) + low + high + samples

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b, c = cls._HEAD.unpack_from(data)
        at = cls._HEAD.size
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        kind = np.dtype(np.uint32 if b < 1 << 29 else np.uint64)
        return cls(n, bits, low, high, np.frombuffer(data, kind, c // kind.itemsize, at + a + b))


def _packed(values: np.ndarray, bits: int, step: int = 1 << 16) -> np.ndarray:
    """The lowest ``bits`` bits of each number, one after the other."""
    parts = []
    for i in range(0, len(values) if bits else 0, step):  # a step's bits fill whole bytes
        x = values[i : i + step]
        parts.append(np.packbits(((x[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little"))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def _unpacked(low: np.ndarray, bits: int, i: int, j: int) -> np.ndarray:
    if not bits:
        return np.zeros(j - i, np.uint64)
    a, b = i * bits, j * bits
    flat = np.unpackbits(low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
    return (flat.reshape(j - i, bits).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


# -- tokens ----------------------------------------------------------------

_BLANK = re.compile(rb"[ \t-\r]")


#: What may stand behind a word of letters and is a piece of its own; an apostrophe might begin a contraction.
_TAILS = b"""!"#$%&()*+,-./:;=>?@[\\]^_`{}~"""


class WordEncoder:
    """Ids of texts as little-endian numbers of ``width`` bytes, word by word.

    A word of letters is one piece for the tokenizer and its last id, and no other, ends a piece; so many new ones are
    encoded in one call and told apart by their ids.  Signs behind it are a piece that is looked up by itself.
    """

    def __init__(self, path: str):
        # tasks are what runs side by side; threads of the library beside them cost more than they bring
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if len(vocabulary) <= 1 << 16 else 4
        #: Whether an id ends a piece.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.held = 0

    def ids(self, *numbers: int) -> bytes:
        return np.array(numbers, f"<u{self.width}").tobytes()

    def encode(self, text: bytes) -> Iterator[bytes]:
        """Ids of the stretches of a text, which end at white space."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > STRETCH:
                blank = _BLANK.search(text, at + STRETCH)
                end = blank.start() if blank else end
            words = text[at:end].split()
            found = list(map(self.known.get, words))
            if None in found:
                self._learn({w for w, ids in zip(words, found, strict=True) if ids is None})
                known = self.known
                found = [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            yield b"".join(found)
            at = end

    def _one(self, word: bytes) -> bytes:
        return self.ids(*self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        if self.held > REMEMBERED:  # words that are frequent were met early
            known = self.known = dict(itertools.islice(known.items(), len(known) // 4))
            self.letters = dict(itertools.islice(self.letters.items(), len(self.letters) // 4))
            self.held //= 4
        split, fresh = [], set()
        for word in new:
            core = word.rstrip(_TAILS)
            text = core.decode("ascii") if core.isalpha() else _plain(core)
            if text:
                text = text.lower()
                split.append((word, text, word[len(core) :]))
                if text not in self.letters:
                    fresh.add(text)
            else:
                known[word] = self._one(word)
        self._learn_letters(list(fresh))
        for word, text, tail in split:
            ids = self.letters[text]
            if tail:
                if tail not in known:
                    known[tail] = self._one(tail)
                ids += known[tail]
            known[word] = ids
        self.held += 2 * sum(map(len, new)) + BESIDES * (len(new) + len(fresh))

    def _learn_letters(self, texts: list[str]) -> None:
        for k in range(0, len(texts), 4096):
            some = texts[k : k + 4096]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = (np.flatnonzero(self.ends[found]) + 1) * self.width
            data, begin = found.tobytes(), 0
            for text, end in zip(some, ends.tolist(), strict=True):
                self.letters[text] = data[begin:end]
                begin = end


def _plain(core: bytes) -> str | None:
    """A word of letters of the first 256 code points, whose classes and cases no version of Unicode changes."""
    text = core.decode("utf-8", "replace")
    return text if text.isalpha() and max(text) < "\u0100" else None


# -- writing ---------------------------------------------------------------


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer:
    """One file being written."""

    def __init__(self, folder: str, width: int):
        self.name = f"t{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
        files, root = _place(folder)
        self.out = files.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(_MARK)
        self.width, self.size = width, 0
        self.starts: list[int] = []
        self.names: list[int] = []

    def write(self, ids: bytes) -> None:
        self.out.write(ids)
        self.size += len(ids) // self.width

    def close(self) -> tuple[str, int, int]:
        starts = EliasFano.of(np.array([*self.starts, self.size], np.uint64)).to_bytes()
        least = self.names[0] if self.names else 0
        names = EliasFano.of(np.array([x - least for x in self.names], np.uint64)).to_bytes()
        at = len(_MARK) + self.size * self.width
        self.out.write(starts)
        self.out.write(names)
        self.out.write(_FOOT.pack(_MARK, self.width, self.size, len(self.starts), len(self.starts) - len(self.names), least, at, at + len(starts)))
        self.out.close()
        return self.name, len(self.starts), self.size


_REPORT = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end: int = END, file_ids: int = FILE_IDS) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to files in ``folder``, a URI, in ascending order of ids."""
    path = path or tokenizer_path()
    files, root = _place(folder)
    files.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = WordEncoder(path), TaskContext.get().partitionId()
        stop, done, out = tokens.ids(end), [], None
        for batch in batches:
            raw, off = C.flatten(batch.column("text"))
            data = memoryview(raw)
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                out = out or _Writer(folder, tokens.width)
                out.starts.append(out.size)
                if doc_id is not None:
                    out.names.append(doc_id)
                for ids in tokens.encode(data[off[i] : off[i + 1]].tobytes()):
                    out.write(ids)
                out.write(stop)
                if out.size >= file_ids or len(out.starts) >= FILE_DOCS:
                    done.append(out.close())
                    out = None
        if out:
            done.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(done), pa.int64()), pa.array(range(len(done)), pa.int64()), *(pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64())))], schema=_REPORT)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    parts = C.parts_for(C.text_size(rows)[1], TEXT_BYTES)
    dealt = rows.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    C.small_batches(dealt).mapInArrow(C.trimmed(write), "part long, number long, name string, docs long, ids long").write.json(f"{folder}/report")


# -- reading ---------------------------------------------------------------


class IdFile:
    """One file, opened: documents by their number or id."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        foot = self.file.read_at(_FOOT.size, size - _FOOT.size)
        mark, self.width, self.ids, self.docs, self.unnamed, self.least, a, b = _FOOT.unpack(foot)
        if mark != _MARK:
            raise OSError(f"{path} is no file of ids")
        self.starts = EliasFano.from_bytes(self.file.read_at(b - a, a))
        self.names = EliasFano.from_bytes(self.file.read_at(size - _FOOT.size - b, b))

    def doc_ids(self, i: int, j: int) -> pa.Array:
        """Ids of documents i to j - 1, null for those without."""
        named = len(self.names)
        known = self.names.slice(min(i, named), min(j, named)).view(np.int64) + self.least  # wraps where the range passes 2**63
        return pa.concat_arrays([pa.array(known, pa.int64()), pa.nulls(j - i - len(known), pa.int64())])

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        return np.frombuffer(self.file.read_at((b - a) * self.width, len(_MARK) + a * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        a, b = self.starts.slice(k, k + 2).tolist()
        return self.tokens(a, b)

    def find(self, doc_id: int) -> int | None:
        """Number of the first document with this id."""
        k = self.names.first_from(max(0, doc_id - self.least))
        return k if k < len(self.names) and doc_id >= self.least and self.names.select(k) == doc_id - self.least else None

    def close(self) -> None:
        self.file.close()


def listed(folder: str) -> list[dict]:
    """The files of the report in order, with the ids that stand before each: a line for each file, not for each document."""
    files, root = _place(folder)
    rows = []
    for info in files.get_file_info(fs.FileSelector(f"{root}/report")):
        if info.base_name.startswith("part-"):
            with files.open_input_stream(info.path) as f:
                rows += [json.loads(line) for line in f.read().decode().splitlines()]
    rows.sort(key=lambda r: (r["part"], r["number"]))
    before = 0
    for r in rows:
        r["before"] = before
        before += r["ids"]
    return rows


class _Range(InputPartition):
    def __init__(self, name: str, before: int, start: int, end: int):
        self.name, self.before, self.start, self.end = name, before, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.whole = options["path"], options.get("ids", "false") == "true"
        self.step = int(options.get("rangeIds", RANGE_IDS))

    def partitions(self) -> list[_Range]:
        out = [_Range(r["name"], r["before"], a, min(a + self.step, r["ids"])) for r in listed(self.folder) for a in range(0, r["ids"], self.step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        files, root = _place(self.folder)
        file = IdFile(files, f"{root}/{partition.name}")
        # the last start is the end of all; a document's start is smaller
        i, j = (min(file.starts.first_from(x), file.docs) for x in (partition.start, partition.end))
        while i < j:
            some = file.starts.slice(i, min(j, i + 4096) + 1).astype(np.int64)
            n = max(1, int(np.searchsorted(some, some[0] + BATCH_IDS, "right")) - 1)
            at = some[: min(n, len(some) - 1) + 1]
            n = len(at) - 1
            ids = file.tokens(int(at[0]), int(at[-1])).astype("<u4")
            data, place = memoryview(ids.tobytes()), (at - at[0]) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
            columns = [file.doc_ids(i, i + n), pa.array(at[:-1] + partition.before), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if self.whole:
                columns.append(C.list_array(ids.astype(np.int32), at - at[0]))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
            i += n
        file.close()


class IdSource(DataSource):
    """Documents of files of ids: options path (the folder), ids (true: with an array of the ids) and rangeIds."""

    @classmethod
    def name(cls) -> str:
        return "wayfarer_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if self.options.get("ids", "false") == "true" else "")

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_ids(spark: SparkSession, folder: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if asked for, ``ids`` of every document in the folder's files."""
    spark.dataSource.register(IdSource)
    return spark.read.format("wayfarer_ids").option("path", folder).option("ids", str(ids).lower()).load()


def token_files(docs: DataFrame) -> DataFrame:
    """Writes every text's ids and describes each document as the files have it."""
    spark = docs.sparkSession
    folder = f"{C.shared_dir(spark)}/ids/{uuid.uuid4().hex}"
    write_ids(docs, folder)
    return read_ids(spark, folder)
