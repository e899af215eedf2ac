"""Language identification by the nearest of several centroids per language.

A text is lower-cased, its ASCII non-letters become spaces, and its byte n-grams (one to three) are hashed to ``DIMENSIONS``
counts. Counts are damped, weighted by inverse document frequency and scaled to length one. Spherical k-means makes up to
``CLUSTERS`` centroids per language. A text gets the language of the centroid with the highest cosine; it is rejected if
that cosine is under the language's floor: a share of a low quantile of the cosines that its texts have with centroids of
others of its texts, lower for texts of few different n-grams. Texts without letters take no part in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import seeds, table

DIMENSIONS, CLUSTERS = 8192, 4
#: At most about so many texts of each language fit its centroids; document frequencies count all training texts.
FIT_TEXTS = 2000
#: So many languages are sent to tasks at once (128 KB each, 64 MB in all); more are tried in further passes over the texts.
SENT_LANGUAGES = 512
UNKNOWN = "und"
#: The floor is this share of this quantile, in full for texts of so many different n-grams (about 32 letters).
FLOOR_SHARE, FLOOR_QUANTILE, FLOOR_GRAMS = 0.4, 0.01, 80

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))
_SLOTS = (seeds(256 * 3, 6) >> np.uint64(32)).astype(np.uint32).reshape(3, 256)
_CHUNK_ROWS, _CHUNK_CHARS = 256, 1 << 20


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed n-gram counts, a row for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        row = np.zeros(DIMENSIONS, np.int64)
        for j in range(0, len(text), _CHUNK_CHARS):  # a very long text is counted in pieces
            piece = f" {text[max(0, j - 2) : j + _CHUNK_CHARS].lower()} ".encode("utf-8", "replace").translate(_LETTERS)
            data = np.frombuffer(piece, np.uint8)
            space = data == 0x20
            pair = space[:-1] & space[1:]
            blank = (space, pair, pair[:-1] | pair[1:])  # n-grams with two spaces in a row say nothing
            slot = np.zeros(len(data), np.uint32)
            for n in range(3):
                slot = slot[: len(data) - n] * np.uint32(31) + _SLOTS[n][data[n:]]
                row += np.bincount(slot[~blank[n]] >> np.uint32(19), minlength=DIMENSIONS)
        out[i] = np.minimum(row, 65535)
    return out


def _weighted(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each task: how many of its texts hold each slot, and at the end how many texts there are."""
    total = np.zeros(DIMENSIONS + 1, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, _CHUNK_ROWS):
            texts = batch.column("text").slice(lo, _CHUNK_ROWS).to_pylist()
            total[:-1] += (counts(texts) > 0).sum(axis=0)
            total[-1] += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["held"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _CHUNK_ROWS):
            part = batch.slice(lo, _CHUNK_ROWS)
            rows = [x.tobytes() for x in counts(part.column("text").to_pylist()).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array(rows, pa.binary())], ["lang", "rank", "row"])


def _clustered(x: np.ndarray, clusters: int) -> np.ndarray:
    """Centres of spherical k-means."""
    centre = x.mean(axis=0, keepdims=True)
    centre /= max(np.linalg.norm(centre), 1e-12)
    while len(centre) < min(clusters, len(x)):  # the text farthest from all so far starts the next cluster
        centre = np.vstack((centre, x[[int((x @ centre.T).max(axis=1).argmin())]]))
    for _ in range(15):
        own = (x @ centre.T).argmax(axis=1)
        sums = np.vstack([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(sums, centre, atol=1e-6):
            break
        centre = sums
    return centre


def _centroids(clusters: int, idf: np.ndarray):
    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "row"])
        x = _weighted(np.frombuffer(b"".join(frame["row"]), np.uint16).reshape(len(frame), -1).astype(np.float32), idf)
        # each half of the texts against centres of the other half, as a text has cosine 1 with a centre of its own
        halves = (x[0::2], x[1::2]) if len(x) > 1 else ()
        near = [(a @ _clustered(b, clusters).T).max(axis=1) for a, b in (halves, halves[::-1])] if halves else [np.zeros(1)]
        floor = FLOOR_SHARE * max(0.0, float(np.quantile(np.concatenate(near), FLOOR_QUANTILE)))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in _clustered(x, clusters)], "floor": floor})

    return fit


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    centres: np.ndarray
    idf: np.ndarray
    #: One for each centre.
    floors: np.ndarray

    def parts(self, most: int) -> list[LanguageModel]:
        """The model in runs of at most ``most`` languages."""
        names = sorted(set(self.languages))
        cuts = [np.flatnonzero(np.isin(self.languages, names[i : i + most])) for i in range(0, len(names), most)]
        return [LanguageModel([self.languages[k] for k in at], self.centres[at], self.idf, self.floors[at]) for at in cuts] or [self]

    def rejects(self, best: int, score: float, grams: int) -> bool:
        return score < self.floors[best] * min(1.0, (grams / FLOOR_GRAMS) ** 0.5)


def fit_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", clusters: int = CLUSTERS, fit_texts: int = FIT_TEXTS, least: float = 0.06) -> LanguageModel:
    """Learn centroids from the rows of ``docs`` with a language and a text that has a letter.

    Inverse document frequencies count all these rows. Centroids are fitted on about ``fit_texts`` rows per language, chosen
    by a hash of the id. Without such rows the model has no language and predicts ``und``. ``least`` bounds the rejection
    floors from below.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    held = np.zeros(DIMENSIONS + 1)
    for slot, n in known.select("text").mapInArrow(_frequencies, "held array<long>").select(F.posexplode("held")).groupBy("pos").agg(F.sum("col")).collect():
        held[slot] = n
    idf = np.log((held[-1] + 1) / (held[:-1] + 1)).astype(np.float32) + np.float32(1)
    if not sizes:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(0))
    share = spark.createDataFrame([(k, min(1.0, fit_texts / n)) for k, n in sizes.items()], "lang string, share double")
    rank = F.xxhash64(F.col("id").cast("string"))
    drawn = known.select("text", "lang", rank.alias("rank")).join(F.broadcast(share), "lang").where(F.pmod("rank", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    rows = drawn.select("text", "lang", "rank").mapInArrow(_counted, "lang string, rank long, row binary").groupBy("lang").applyInPandas(_centroids(clusters, idf), "lang string, centre binary, floor double")
    found = sorted(rows.collect(), key=lambda r: (r["lang"], r["centre"]))
    if not found:
        return LanguageModel([], np.zeros((0, DIMENSIONS), np.float32), idf, np.zeros(0))
    centres = np.frombuffer(b"".join(r["centre"] for r in found), np.float32).reshape(len(found), -1)
    return LanguageModel([r["lang"] for r in found], centres, idf, np.array([max(least, r["floor"]) for r in found]))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", most: int = SENT_LANGUAGES) -> DataFrame:
    """``docs`` with the columns lang_pred, score (cosine, 0 to 1) and rejected.

    A null or empty text, or one without letters, is ``und`` with score 0 and rejected. Very long texts are counted whole.
    ``lang_pred`` names the nearest language even where the distance rejects it. Ties go to the language that sorts first.
    Columns of these names are replaced, all others pass through; repeated rows and ids stay, and an empty table gives no
    rows. Models of more than ``most`` languages are tried in parts, one pass each, with the best so far beside the text.
    """
    fields = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    others = [c for c in docs.columns if c not in fields]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").alias("text"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    kind = packed.schema["rest"].dataType.simpleString()
    told = ", ".join(f"{k} {v}" for k, v in fields.items())

    def scan(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = sent.value
            for batch in batches:
                best = [batch.column(c).to_pylist() for c in fields]
                for lo in range(0, batch.num_rows, _CHUNK_ROWS):
                    texts = batch.column("text").slice(lo, _CHUNK_ROWS).to_pylist()
                    held = counts(texts)
                    grams = np.count_nonzero(held, axis=1)
                    near = _weighted(held, m.idf) @ m.centres.T
                    for i, (text, own, n) in enumerate(zip(texts, near, grams, strict=True), lo):
                        at = int(own.argmax())
                        score = min(1.0, max(0.0, round(float(own[at]), 6)))
                        if _has_letter(text) and (best[0][i] == UNKNOWN or score > best[1][i]):
                            best[0][i], best[1][i], best[2][i] = m.languages[at], score, m.rejects(at, score, int(n))
                through = ["rest"] if last else ["rest", "text"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in through), *(pa.array(x, t) for x, t in zip(best, (pa.string(), pa.float64(), pa.bool_()), strict=True))], [*through, *fields])

        return run

    parts = model.parts(most) if model.languages else []
    for k, part in enumerate(parts, 1):
        last = k == len(parts)
        packed = packed.mapInArrow(scan(docs.sparkSession.sparkContext.broadcast(part), last), f"rest {kind}, {'' if last else 'text string, '}{told}")
    return packed.select(*(F.col(f"rest.`{c}`").alias(c) for c in others), *fields)


def held_out(id_col: str = "doc_id"):
    """The test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_on_fold(docs: DataFrame) -> LanguageModel:
    return fit_languages(docs.where(F.col("doc_id").isNotNull() & ~held_out()))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, and whether its distance rejects it; nulls, long texts and repeats as in
    ``predict_languages``."""
    docs = table(spark, sf_dir, "documents")
    model = fit_on_fold(docs)
    return predict_languages(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
