"""SentencePiece encoding and decoding: shared-prefix Viterbi over the sorted distinct marked words of a batch.

Spaces become the mark U+2581 and the text gets one in front, as the model's normaliser asks. No piece has a mark after
another character, so a text falls into marked words (marks, then other characters) that are segmented by themselves. The
distinct words of a batch are sorted, which is a depth-first walk of their trie: the forward scores of a common prefix stay
on the stack and only the rest of each word is computed. At each end position the pieces that end there are found by walking
back in a trie of reversed pieces. Characters without a piece fall back to their bytes.

The best path is the one with the highest sum of piece scores (of equal sums the one whose last piece is longest). For a
model of the merge kind these are the vocabulary's ranks, so the path is the best under its scores, not its merge order.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import table

MARK = "▁"
MODEL = os.environ.get("TIDEPANEL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Words whose ids a task keeps; beyond it starts afresh. About 200 bytes each.
KEPT_WORDS = 500_000
_UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}*[^{MARK}]*")
_NORMAL, _USER, _BYTE = 1, 4, 6


class Pieces:
    """A vocabulary with a trie of its reversed pieces."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.name != "identity" or not model.normalizer_spec.escape_whitespaces or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that keep texts as they are can be used")
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.text = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        plain = [i for i, k in enumerate(kinds) if k in (_NORMAL, _USER)]
        if any(MARK in self.text[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece goes on after a mark, so words can't be segmented alone")
        self.bytes_of = {int(self.text[i][1:-1], 16): i for i, k in enumerate(kinds) if k == _BYTE}
        self.byte = {i: b for b, i in self.bytes_of.items()}
        self.unknown = kinds.index(2)
        self.special = {i for i, k in enumerate(kinds) if k == 3}
        self.least = min(model.pieces[i].score for i in plain)
        # each node: [next characters, score and id of the piece that is spelled backwards up to here, or None]
        self.root: list = [{}, None]
        for i in plain:
            node = self.root
            for c in reversed(self.text[i]):
                node = node[0].setdefault(c, [{}, None])
            node[1] = (model.pieces[i].score, i)

    def _fallback(self, char: str) -> list[int]:
        if not self.bytes_of:
            return [self.unknown]
        return [self.bytes_of[b] for b in char.encode("utf-8", "replace")]

    def segment(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids. Words in sorted order share the scores of their common prefixes."""
        score, back = [0.0], [(0, -1)]  # for each prefix of the last word: best score, and (start, id) of its last piece
        last, root, unknown = "", self.root[0], self.least - _UNKNOWN_PENALTY
        for word in words:
            same = min(len(os.path.commonprefix((last, word))), len(score) - 1)
            del score[same + 1 :], back[same + 1 :]
            for end in range(same, len(word)):
                best, at, piece = score[end] + unknown, end, -1
                node, start = root.get(word[end]), end
                while node is not None:
                    own = node[1]
                    if own is not None and (value := score[start] + own[0]) >= best:
                        best, at, piece = value, start, own[1]
                    start -= 1
                    if start < 0:
                        break
                    node = node[0].get(word[start])
                score.append(best)
                back.append((at, piece))
            last = word
            ids: list[int] = []
            end = len(word)
            while end:
                at, piece = back[end]
                ids += [piece] if piece >= 0 else reversed(self._fallback(word[at:end]))
                end = at
            ids.reverse()
            yield word, ids

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        if not text:
            return []
        return [w for w in _WORD.findall(self.prefix + text.replace(" ", MARK)) if w]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes are joined to characters, marks become spaces, the mark put in front goes."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte:
                pending.append(self.byte[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if i not in self.special:
                out.append(self.text[i])
        out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")


class Encoder:
    """Encodes batches of texts and keeps the ids of words it has met."""

    def __init__(self, pieces: Pieces, kept: int = KEPT_WORDS):
        self.pieces, self.kept, self.known = pieces, kept, {}

    def encode(self, texts: list[str | None]) -> Iterator[list[list[int]]]:
        """For each text the ids of its words, in order."""
        split = [self.pieces.words(t or "") for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > self.kept:
            self.known = {}
            new = {w for words in split for w in words}
        self.known.update(self.pieces.segment(sorted(new)))
        for words in split:
            yield [self.known[w] for w in words]


#: Texts of about so many characters are encoded together.
_GROUP_CHARS = 1 << 20


def _groups(column: pa.Array) -> Iterator[list[str | None]]:
    group, size = [], 0
    for value in column:
        text = value.as_py()
        group.append(text)
        size += len(text or "") + 1
        if size >= _GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _flat(words: list[list[int]]) -> list[int]:
    return [i for ids in words for i in ids]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Rows (id, ids), one for each row of ``docs``; null and empty texts have no ids.

    Very long texts are encoded whole. Ids may be null or repeat; equal texts have equal ids, and of paths with equal scores
    the one whose last piece is longest is taken. An empty table gives no rows; other columns are not read, so their names
    can't clash. ``model`` is a path that every executor can read.
    """
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Pieces(model))
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text")):
                ids = pa.array([_flat(x) for x in encoder.encode(group)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(group)), ids], ["id", "ids"])
                at += len(group)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (id, text) from rows (id, ids). Null ids give null. A text that has U+2581 itself comes back with spaces there."""
    kind = dict(encoded.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [None if (ids := x.as_py()) is None else pieces.decode(ids) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


_DIGEST = "n_words long, n_pieces long, n_bytes_pieces long, ids_sha256 string, decoded_sha256 string, exact boolean"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """For each row the number of marked words and pieces, digests of the ids (32-bit little-endian) and of the text that
    they decode to, and whether it is the text. Null is taken as empty."""
    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from array import array

        pieces = Pieces(model)
        encoder, said = Encoder(pieces), {}
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        for batch in batches:
            at = 0
            for group in _groups(batch.column("text")):
                rows = []
                for text, words in zip(group, encoder.encode(group), strict=True):
                    ids = array("i", _flat(words))
                    back = pieces.decode(ids)
                    plain = (text or "").replace(MARK, " ")
                    rows.append((len(words), len(ids), sum(map(pieces.byte.__contains__, ids)), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == plain))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(group)), *map(pa.array, columns)], ["id", *names])
                at += len(group)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {_DIGEST}")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to; nulls, long texts, ties and repeats as in ``encode``."""
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
