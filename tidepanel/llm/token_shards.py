"""Token ids in binary shards: documents compressed one by one with a shared zstandard dictionary.

A folder of shards has a dictionary file, named by its SHA-256, a manifest and one file for each range of ids. A shard starts
with ``MAGIC`` and the dictionary's hash; then come the documents' frames, each the little-endian id array of one document
(two bytes an id where the vocabulary allows it, else four) compressed by itself with the dictionary; then the index, an
Arrow table of (id, n_tokens, offset, size), and its length. So one short document is read by its index row and one range of
bytes, without its neighbours.

The dictionary is trained on the serialized id arrays of a bounded sample of documents. It only serves compression: whatever
the sample, every id comes back. Shards are written by tasks under names of their own and are valid only once the manifest,
written last, lists them, so a task that is lost or runs twice leaves nothing that is read.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import os
import re
import string
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tidepanel.llm.common import SPACES, on_exit, row_runs, shared_dir, table, utf8

VOCABULARY = os.environ.get("TIDEPANEL_BYTE_BPE", "/opt/tokenizers/byte_bpe_50k.json")
END_ID = 2
MAGIC = b"TIDEZ001"
DICTIONARY_BYTES = 1 << 16
#: The dictionary learns from so many documents at most, and from so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS = 2_000, 8_192
#: A shard has documents of about so many characters.
SHARD_LETTERS, LEAST_SHARDS = 1 << 26, 16
#: Words whose ids a worker keeps, about 250 bytes each.
KEPT_WORDS = 400_000
#: Distinct words are handed to the tokenizer in texts of so many words.
_JOINED = 4_096
_CHUNK = 1 << 22
#: Kinds of bytes; those from ``_PLAIN`` on are visible.
_OTHER, _WIDE, _SPACE, _PLAIN, _LETTER, _MARK = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x80:] = _WIDE
_KIND[list(SPACES)] = _SPACE
_KIND[0x21:0x7F] = _PLAIN
_KIND[list(string.ascii_letters.encode())] = _LETTER
_KIND[list(string.punctuation.encode())] = _MARK
_TAIL = struct.Struct("<Q8s")


class WordIds:
    """Encodes whole texts with a byte-level tokenizer of the tokenizers library, each distinct word once.

    The pattern by which such a tokenizer cuts a text never joins a character that isn't white space to white space after it.
    A text may thus be cut before each white space that follows a visible character, and its parts encoded apart: their ids
    in a row are those of the text. The same holds between a letter and a punctuation mark after it. Texts are cut at ASCII
    white space and marks only, and not after characters that could be white space themselves.
    """

    def __init__(self, path: str = VOCABULARY, kept: int = KEPT_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel part
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        if said["pre_tokenizer"]["type"] != "ByteLevel" or said["pre_tokenizer"]["add_prefix_space"] or said["normalizer"] is not None:
            raise ValueError("only byte-level vocabularies that keep texts as they are can be used")
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        # one character of a byte-level token stands for one byte
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.kept, self.known, self.before = kept, {}, {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Words that begin with white space and end without it are encoded in a row, and told apart by their bytes."""
        apart = [w for w in words if w[0] > 0x20 or w[-1] <= 0x20 or (w[-1] >= 0x80 and w.decode()[-1].isspace())]
        alone = set(apart)
        for word, ids in zip(apart, self._ids([w.decode() for w in apart]), strict=True):
            self.known[word] = ids.tobytes()
        rest = [w for w in words if w not in alone]
        rows = [rest[i : i + _JOINED] for i in range(0, len(rest), _JOINED)]
        for row, ids in zip(rows, self._ids([b"".join(r).decode() for r in rows]), strict=True):
            ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(w) for w in row])) + 1
            raw, at = ids.tobytes(), 0
            for word, end in zip(row, ends.tolist(), strict=True):
                self.known[word] = raw[4 * at : 4 * end]
                at = end

    def _raw(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes. Words are kept in two generations: those met again outlive those met once."""
        new, old = self.known, self.before
        self._learn([w for w in words if w not in new and w not in old])
        found = []
        for w in words:
            ids = new.get(w)
            if ids is None:
                ids = new[w] = old.pop(w)
            found.append(ids)
        if len(new) > self.kept // 2:
            self.known, self.before = {}, new
        return found

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows [lo, hi): their ids in a row and the offsets of each row in them. Null is empty."""
        data, at = utf8(column)
        for lo, hi in row_runs(at, _CHUNK):
            rows = at[lo : hi + 1] - at[lo]
            starts = _cuts(data[at[lo] : at[hi]], rows)
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, rows[-1])), pa.py_buffer(np.ascontiguousarray(data[at[lo] : at[hi]]))]).dictionary_encode()
            ids, ends = _taken(self._raw(words.dictionary.to_pylist()), words.indices.to_numpy(zero_copy_only=False))
            yield lo, hi, ids, ends[np.searchsorted(starts, rows)]


def _cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where words begin, and each text that isn't empty."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    # the last byte of a letter: not of a character whose first byte is C2 or E1 to E3, which may be white space
    visible = kind >= _PLAIN
    wide = np.flatnonzero(kind == _WIDE)
    lead = np.maximum(data[np.maximum(wide - 1, 0)] == 0xC2, (data[np.maximum(wide - 2, 0)] >= 0xE1) & (data[np.maximum(wide - 2, 0)] <= 0xE3))
    visible[wide[~lead]] = True
    cut[1:] = ((kind[1:] == _SPACE) & visible[:-1]) | ((kind[1:] == _MARK) & (kind[:-1] == _LETTER))
    cut[rows[:-1][np.diff(rows) > 0]] = True
    return np.flatnonzero(cut)


def _taken(raw: list[bytes], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words ``of`` in a row, and where each word's begin."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    flat, n = np.frombuffer(b"".join(raw), np.uint32), sizes[of]
    ends = np.concatenate(([0], np.cumsum(n)))
    if not len(of):
        return flat, ends
    # each place is one after that before it, but for the first of each word
    step = np.ones(ends[-1], np.int64)
    firsts = (np.cumsum(sizes) - sizes)[of]
    step[ends[:-1]] = np.diff(firsts + n - 1, prepend=0) - n + 1
    step[0] = firsts[0]
    return flat[np.cumsum(step)], ends


_encoders: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    """One encoder for each vocabulary of a Python worker, so that tasks of one worker share the words they know."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


def _documents(batch: pa.RecordBatch, encoder: WordIds, end_id: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each row."""
    for lo, hi, ids, at in encoder.encode(batch.column("text")):
        for i in range(hi - lo):
            yield lo + i, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))


def train_dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary for id arrays like those of ``docs``, at most ``DICTIONARY_BYTES``; empty where the texts are too
    few or too short to train one. It learns from ``SAMPLE_DOCS`` documents at most, those with the least hashes."""
    chance = F.xxhash64(F.col(id_col), F.col(text_col))
    sample = docs.select(chance.alias("chance"), F.substring(text_col, 1, SAMPLE_CHARS).alias("text")).orderBy("chance").limit(SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = _encoder(vocabulary)
        samples = [ids.astype(_width(encoder.size, end_id)).tobytes() for b in batches for _, ids in _documents(b, encoder, end_id)]
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
        except zstandard.ZstdError:  # too little to learn from
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    # the limit leaves one partition
    return bytes(max((r["dictionary"] for r in sample.mapInArrow(run, "dictionary binary").collect()), key=len, default=b""))


def _width(size: int, end_id: int) -> str:
    return "<u2" if max(size - 1, end_id) < 1 << 16 else "<u4"


def compressed(docs: DataFrame, dictionary: bytes, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Rows (id, n_tokens, frame), one for each row of ``docs``: its ids and the end id, serialized and compressed."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder = _encoder(vocabulary)
        width = _width(encoder.size, end_id)
        writer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids_of, counts, frames = batch.column("id"), [], []
            for row, ids in _documents(batch, encoder, end_id):
                counts.append(len(ids))
                frames.append(writer.compress(ids.astype(width).tobytes()))
                if len(frames) == 1_000 or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids_of.slice(row + 1 - len(frames), len(frames)), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["id", "n_tokens", "frame"])
                    counts, frames = [], []

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, frame binary")


def _opened(path: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def _put(path: str, name: str, content: bytes) -> None:
    fs, at = _opened(path)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{name}.part") as f:
        f.write(content)
    fs.move(f"{at}/{name}.part", f"{at}/{name}")


def _get(path: str, name: str) -> bytes:
    fs, at = _opened(path)
    with fs.open_input_stream(f"{at}/{name}") as f:
        return f.read()


class _Written(WriterCommitMessage):
    def __init__(self, shard: dict):
        self.shard = shard


class _ShardWriter(DataSourceArrowWriter):
    """Each partition, in its order, becomes one shard."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.hash, self.width, self.schema = options["path"], options["dictionary"], options["width"], schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, at = _opened(self.path)
        name, offset, index, tokens = f"shard-{uuid.uuid4().hex}.tz", len(MAGIC) + 32, [], 0
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                out = fs.open_output_stream(f"{at}/{name}")
                out.write(MAGIC + bytes.fromhex(self.hash))
            frames = batch.column("frame").to_pylist()
            sizes = np.fromiter(map(len, frames), np.int64, len(frames))
            out.write(b"".join(frames))
            index.append(pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_tokens"), pa.array(offset + np.cumsum(sizes) - sizes), pa.array(sizes)], ["id", "n_tokens", "offset", "size"]))
            offset += int(sizes.sum())
            tokens += int(np.sum(batch.column("n_tokens").to_numpy(zero_copy_only=False)))
        if out is None:
            return _Written({})
        said = pa.Table.from_batches(index)
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, said.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(said)
        out.write(sink.getvalue())
        out.write(_TAIL.pack(sink.tell(), MAGIC))
        out.close()
        ids = said.column("id")
        return _Written({"name": name, "part": TaskContext.get().partitionId(), "docs": said.num_rows, "tokens": tokens, "bytes": offset + sink.tell() + _TAIL.size, "first": ids[0].as_py(), "last": ids[-1].as_py()})

    def commit(self, messages: list) -> None:
        shards, start = sorted((m.shard for m in messages if m and m.shard), key=lambda s: s["part"]), 0
        for s in shards:
            s["start"] = start
            start += s["tokens"]
        schema = from_arrow_schema(to_arrow_schema(StructType([self.schema["id"]])))
        _put(self.path, "manifest.json", json.dumps({"dictionary": self.hash, "width": self.width, "tokens": start, "id": schema[0].dataType.simpleString(), "shards": shards}).encode())

    def abort(self, messages: list) -> None:
        fs, at = _opened(self.path)
        for m in messages:
            if m and m.shard:
                fs.delete_file(f"{at}/{m.shard['name']}")


class Shard:
    """One shard, opened for its documents."""

    def __init__(self, path: str, name: str, manifest: dict):
        import zstandard

        fs, at = _opened(path)
        self.file, self.width = fs.open_input_file(f"{at}/{name}"), manifest["width"]
        size = self.file.size()
        length, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        head = self.file.read_at(len(MAGIC) + 32, 0)
        if magic != MAGIC or head[: len(MAGIC)] != MAGIC or head[len(MAGIC) :].hex() != manifest["dictionary"]:
            raise ValueError(f"{name} is not a shard of this dictionary")
        self.index = pa.ipc.open_stream(self.file.read_at(length, size - _TAIL.size - length)).read_all().combine_chunks()
        dictionary = _get(path, f"dictionary-{manifest['dictionary']}.zdict")
        if hashlib.sha256(dictionary).hexdigest() != manifest["dictionary"]:
            raise ValueError("the dictionary has changed")
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def frames(self, lo: int, hi: int) -> list[np.ndarray]:
        """The ids of the documents in rows [lo, hi) of the index, by one read."""
        offset, size = (self.index.column(c).to_numpy()[lo:hi] for c in ("offset", "size"))
        raw = self.file.read_at(int(offset[-1] + size[-1] - offset[0]), int(offset[0]))
        return [np.frombuffer(self.reader.decompress(raw[a - offset[0] : a - offset[0] + n]), self.width).astype("<u4") for a, n in zip(offset.tolist(), size.tolist(), strict=True)]


class _ShardPart(InputPartition):
    def __init__(self, shard: dict):
        self.shard = shard


class _ShardReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_ShardPart(s) for s in json.loads(_get(self.path, "manifest.json"))["shards"]] or [_ShardPart({})]

    def read(self, partition: _ShardPart) -> Iterator[pa.RecordBatch]:
        if not partition.shard:
            return
        shard, start = Shard(self.path, partition.shard["name"], json.loads(_get(self.path, "manifest.json"))), partition.shard["start"]
        counts = shard.index.column("n_tokens").to_numpy()
        upto = np.concatenate(([0], np.cumsum(counts)))
        for lo, hi in row_runs(upto, 1 << 20):
            ids = pa.array([x.tobytes() for x in shard.frames(lo, hi)], pa.binary())
            yield pa.RecordBatch.from_arrays([shard.index.column("id").slice(lo, hi - lo).combine_chunks(), pa.array(start + upto[lo:hi]), pa.array(counts[lo:hi]), ids], ["id", "start", "n_tokens", "ids"])


class TokenShards(DataSource):
    """``spark.read.format("token_shards").load(folder)``: rows (id, start, n_tokens, ids), where ids are little-endian unsigned
    32-bit integers and start counts the ids of all documents before."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return f"id {json.loads(_get(self.options['path'], 'manifest.json'))['id']}, start long, n_tokens long, ids binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ShardReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _ShardWriter(self.options, schema)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> dict:
    """Write the ids of every row of ``docs`` into ``path``, in ascending order of id, and return the manifest.

    ``path`` is a new folder that all machines share (a URI that pyarrow opens; a path without a scheme is a local one).
    Null texts are empty: the end id alone. Very long texts are encoded whole. Null ids come first; rows that repeat an id
    stand together in the order they were read. Equal texts have equal ids. An empty table gives a manifest without shards;
    other columns are not read, so their names can't clash. Each shard is one task's range of ids, sorted, encoded and written
    there; a frequent id is cut between shards by the rows' numbers.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, id_col, text_col, vocabulary, end_id)
    named = hashlib.sha256(dictionary).hexdigest()
    _put(path, f"dictionary-{named}.zdict", dictionary)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("seq"))
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-letters // SHARD_LETTERS))
    ranged = rows.repartitionByRange(shards, F.asc_nulls_first("id"), "seq").sortWithinPartitions(F.asc_nulls_first("id"), "seq").drop("seq")
    ordered = compressed(ranged, dictionary, "id", "text", vocabulary, end_id)
    spark.dataSource.register(TokenShards)
    ordered.write.format("token_shards").mode("append").options(path=path, dictionary=named, width=_width(_encoder(vocabulary).size, end_id)).save()
    return json.loads(_get(path, "manifest.json"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows (id, start, n_tokens, ids) of a folder of shards, one task for each shard."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").load(path)


def read_document(path: str, id_: object) -> list[list[int]]:
    """The ids of all documents with an id: the manifest tells the shards, the index the frames. Null ids are not searched."""
    manifest, found = json.loads(_get(path, "manifest.json")), []
    for s in manifest["shards"]:
        if s["last"] is None or s["last"] < id_ or (s["first"] is not None and s["first"] > id_):
            continue
        shard = Shard(path, s["name"], manifest)
        ids = shard.index.column("id").to_pylist()
        nulls = shard.index.column("id").null_count  # these come first
        lo, hi = bisect.bisect_left(ids, id_, nulls), bisect.bisect_right(ids, id_, nulls)
        if lo < hi:
            found += [x.tolist() for x in shard.frames(lo, hi)]
    return found


def op12_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, from shards written of all documents and read back; nulls, long texts, ties and repeats as in
    ``write_shards``."""
    path = f"{shared_dir(spark)}/token-shards-{uuid.uuid4().hex}"
    on_exit(spark, path)
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
