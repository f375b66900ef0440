"""Token ids of documents in binary shard files with Elias-Fano encoded boundaries.

A shard file holds documents in ascending id order: one array of token ids after the other, then the
documents' boundaries and ids as Elias-Fano sequences, whose select structure returns any offset without a table
of 64-bit numbers.  Layout, little endian:

    8 bytes   magic
    ids       n_ids numbers of ``width`` bytes
    sequence  boundaries: n_docs + 1 numbers
    sequence  document ids minus the smallest one, without the null ids, which come first
    footer    see FOOTER
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webposture.llm.text import chunks
from webposture.session import materialize, shared_dir

MAGIC = b"IDSHARD1"
#: width, null ids, least id, n_docs, n_ids, bytes of boundaries, bytes of ids' sequence
FOOTER = struct.Struct("<qqqqqqq")
#: Ids after which a task begins another shard file.
SHARD_IDS = 1 << 24
#: Ones between two samples of the select structure.
SAMPLE = 256
#: Different words whose ids a worker remembers.
MEMO_WORDS = 1_500_000


class EliasFano:
    """A sequence of non-decreasing numbers: low bits packed, high bits in unary, every 256th one sampled."""

    HEAD = struct.Struct("<qqqq")  # numbers, low bits, bytes of low bits, bytes of high bits

    def __init__(self, buffer) -> None:
        n, self.low_bits, low, high = self.HEAD.unpack_from(buffer)
        self.n, at = n, self.HEAD.size
        self.low = np.frombuffer(buffer, np.uint8, low, at)
        self.high = np.frombuffer(buffer, np.uint8, high, at + low)
        self.samples = np.frombuffer(buffer, np.uint32, -(-n // SAMPLE), at + low + high)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little")
        samples = ones[::SAMPLE].astype(np.uint32)
        # Aligned, so that the samples can be read in place.
        low, high = (np.pad(x, (0, -len(x) % 4)) for x in (low, high))
        return cls.HEAD.pack(n, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes() + samples.tobytes()

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << k
        return out

    def select(self, i: int) -> int:
        """The number at ``i``: from the nearest sample, bits are counted up to its one."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        bits = np.unpackbits(self.high[at >> 3 :][: 8 + 64 * left], bitorder="little")[at & 7 :]
        while (found := np.flatnonzero(bits)).size <= left:  # numbers far apart
            bits = np.unpackbits(self.high[at >> 3 :][: 2 * len(bits)], bitorder="little")[at & 7 :]
        high = at + int(found[left]) - i
        return (high << self.low_bits) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return ((ones - i) << self.low_bits) | self._low(i)


def open_place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder that all executors reach, by URI."""
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Streams documents in id order to one file; it appears under its name when it is complete."""

    def __init__(self, uri: str, name: str, width: int) -> None:
        self.fs, self.folder = open_place(uri)
        self.name, self.width = name, width
        self.lengths: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.n_ids = 0
        self.fs.create_dir(self.folder, recursive=True)
        self.part = f"{self.folder}/.{name}.{uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC)

    def add(self, doc_ids: list[int | None], tokens: np.ndarray, lengths: np.ndarray) -> None:
        if len(tokens) and int(tokens.max()) >> 8 * self.width:
            raise ValueError(f"id {int(tokens.max())} takes more than {self.width} bytes")
        self.out.write(tokens.astype(f"<u{self.width}").tobytes())
        self.ids.extend(doc_ids)
        self.lengths.append(lengths)
        self.n_ids += len(tokens)

    def close(self) -> dict:
        known = np.array([i for i in self.ids if i is not None], np.int64)
        least = int(known[0]) if len(known) else 0
        spread = known.view(np.uint64) - np.uint64(least & (2**64 - 1))
        bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(np.concatenate(self.lengths))]))
        ids = EliasFano.encode(spread)
        footer = FOOTER.pack(self.width, len(self.ids) - len(known), least, len(self.ids), self.n_ids, len(bounds), len(ids))
        self.out.write(bounds + ids + footer)
        self.out.close()
        self.fs.move(self.part, f"{self.folder}/{self.name}")
        return {"name": self.name, "n_docs": len(self.ids), "n_ids": self.n_ids}


class ShardReader:
    def __init__(self, uri: str, name: str) -> None:
        filesystem, folder = open_place(uri)
        self.file = filesystem.open_input_file(f"{folder}/{name}")
        size = self.file.size()
        self.width, self.nulls, self.least, self.n_docs, self.n_ids, bounds, ids = FOOTER.unpack(
            self.file.read_at(FOOTER.size, size - FOOTER.size)
        )
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is not a shard file")
        at = size - FOOTER.size - bounds - ids
        self.bounds = EliasFano(self.file.read_at(bounds, at))
        self.sequence = EliasFano(self.file.read_at(ids, at + bounds))

    def doc_ids(self) -> list[int | None]:
        known = self.sequence.all().view(np.uint64) + np.uint64(self.least & (2**64 - 1))
        return [None] * self.nulls + known.view(np.int64).tolist()

    def tokens(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the document at ``i``, found by two selects."""
        return self.tokens(self.bounds.select(i), self.bounds.select(i + 1))


#: Words that the tokenizer encodes at once.
LEARN_WORDS = 4096
#: Text in which a token that reaches over white space, or depends on it, would show.
PROBE = "The quick  brown\tfox\n\n jumps over 12 dogs.\r\nÉtait-ce de la , l' eau ? of the \x0b in to\x0ca x "


class WordEncoder:
    """Encodes texts word by word with a tokenizer whose tokens never reach over ASCII white space, whole with any other.

    Equal words have equal ids, so each is encoded once and the ids of a text are put together from those of
    its words.  Which of the two kinds a tokenizer is shows in ``PROBE``, whose ids must be those of its words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = self.tokenizer.encode_batch_fast(PROBE.split(), add_special_tokens=False)
        self.by_word = self._whole(PROBE) == [i for e in parts for i in e.ids]
        self.forget()

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        # Hashes in order, and which of the remembered words each is.
        self.keys, self.number = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.tokens = np.empty(1 << 16, np.uint32)
        self.bounds = np.zeros(1 << 16, np.int64)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words with these hashes, which are in order."""
        ids = []
        # The library's results are large objects: only some are held at once.
        for k in range(0, len(words), LEARN_WORDS):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + LEARN_WORDS], add_special_tokens=False)]
        n, flat = len(self.keys), np.fromiter(chain.from_iterable(ids), np.uint32)
        ends = self.bounds[n] + np.cumsum(np.fromiter(map(len, ids), np.int64))
        if len(self.bounds) < n + len(ids) + 1:
            self.bounds = np.resize(self.bounds, max(2 * len(self.bounds), n + len(ids) + 1))
        if len(self.tokens) < ends[-1]:
            self.tokens = np.resize(self.tokens, max(2 * len(self.tokens), int(ends[-1])))
        self.tokens[self.bounds[n] : ends[-1]] = flat
        self.bounds[n + 1 : n + 1 + len(ids)] = ends
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.number = np.insert(self.number, at, np.arange(n, n + len(ids)))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of documents: index of the first, all their ids, ids of each document."""
        if not self.by_word:
            for first, text in enumerate(column.to_pylist()):
                ids = np.array(self._whole(text or ""), np.uint32)
                yield first, ids, np.array([len(ids)])
            return
        for words in chunks(column):
            keys, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            if len(self.keys) > MEMO_WORDS:
                self.forget()
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = at < len(self.keys)
            known[inside] = self.keys[at[inside]] == keys[inside]
            if not known.all():
                self.learn(keys[~known], words.strings(first[~known]))
                at = np.searchsorted(self.keys, keys)
            number = self.number[at][inverse]
            start = self.bounds[number]
            length = self.bounds[number + 1] - start
            total = np.concatenate([[0], np.cumsum(length)])
            tokens = self.tokens[np.repeat(start - total[:-1], length) + np.arange(total[-1])]
            yield words.first, tokens, np.diff(total[words.offsets])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_shards(
    docs: DataFrame, tokenizer: str | Callable[[], str], folder: str, end_id: int, width: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents, each with ``end_id`` behind, and return the manifest.

    ``tokenizer``: path of a tokenizers file on the executors, or a function that returns it there.
    ``folder``: URI of a folder that all executors reach.  ``width``: bytes of an id.  The manifest has a row per
    file: name, part, piece, n_docs, n_ids; files in order of (part, piece) are in ascending id order, null ids
    first; rows with the same id are in order of their texts.  A null text is the empty one.  A task that runs again
    writes the same files under the same names.  No documents, no files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer if isinstance(tokenizer, str) else tokenizer()).encode
        part, rows, writer = TaskContext.get().partitionId(), [], None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, tokens, lengths in encode(batch.column(1)):
                if writer is None:
                    writer = ShardWriter(folder, f"part-{part:06d}-{len(rows):06d}.ids", width)
                ends = np.cumsum(lengths)
                tokens = np.insert(tokens, ends, end_id)
                writer.add(ids[first : first + len(lengths)], tokens, lengths + 1)
                if writer.n_ids >= SHARD_IDS:
                    rows.append(writer.close() | {"part": part, "piece": len(rows)})
                    writer = None
        if writer:
            rows.append(writer.close() | {"part": part, "piece": len(rows)})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("name", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = texts.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(ordered.mapInArrow(write, "name string, part int, piece int, n_docs long, n_ids long"))


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the crc32 of the ids as little-endian
    unsigned 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = ShardReader(folder, name)
                bounds, ids = shard.bounds.all(), shard.doc_ids()
                for a in range(0, shard.n_docs, 4096):
                    at = bounds[a : a + 4097]
                    crcs, done = [], 0
                    while done < len(at) - 1:  # some MB at once, or one long document
                        to = max(done + 1, int(np.searchsorted(at, at[done] + (1 << 21), "right")) - 1)
                        tokens = shard.tokens(int(at[done]), int(at[to])).astype("<u4")
                        crcs += [zlib.crc32(tokens[at[i] - at[done] : at[i + 1] - at[done]]) for i in range(done, to)]
                        done = to
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[a : a + len(crcs)], pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One row per file, so one task can sum them up.
    earlier = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("name", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    return placed.repartition("name").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    """A new folder for shard files in the shared folder, as a URI or an absolute path."""
    return f"{shared_dir(spark)}/shards/{uuid4().hex}"


def token_offsets(docs: DataFrame, tokenizer: str | Callable[[], str], end_id: int = 2, **options) -> DataFrame:
    """Write the documents' ids to shard files and return what the files hold of each document.

    One row per row of ``docs``: doc_id, start, n_tokens, ids_crc32, in the order that ``write_shards`` states.  Null and empty texts have
    the end id alone.  An id that takes more bytes than the files give it is an error.  Other columns are not read; no documents, no rows.
    """
    folder = new_folder(docs.sparkSession)
    return read_shards(write_shards(docs, tokenizer, folder, end_id, **options), folder)
