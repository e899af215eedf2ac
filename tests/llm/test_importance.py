"""Importance resampling against a plain loop, n-grams of several words, and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tidepanel.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, id string, weight int, seq int, part int, rank string, n int, bucket string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, "z") for i, t in rows], SCHEMA)


def grams(text, most):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)], len(words)


def plain(rows, target, most, buckets, least, percent, seed):
    def crc(g):
        return zlib.crc32(g.encode()) % buckets

    s, t = Counter(crc(g) for _, x in rows for g in grams(x, most)[0]), Counter(crc(g) for x in target for g in grams(x, most)[0])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, x in rows:
        own, n = grams(x, most)
        weight = sum(math.floor(1000 * math.log(float(t[b] + 1) * float(all_s) / (float(s[b] + 1) * float(all_t)))) for b in map(crc, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    ready = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(ready[: percent * len(ready) // 100]):
        r[5] = k + 1
    return sorted(map(repr, map(tuple, out)))


def rows_of(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in table], [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect()]


@pytest.mark.parametrize(("most", "buckets", "least", "percent"), [(1, 10_000, 20, 10), (2, 97, 5, 60), (3, 10_000, 0, 100)])
def test_against_loop(spark, most, buckets, least, percent):
    rows, target = rows_of(spark)
    found = importance.resample(docs(spark, rows), docs(spark, list(enumerate(target))), most=most, buckets=buckets, least_words=least, percent=percent, seed=7)
    assert sorted(map(repr, map(tuple, found.collect()))) == plain(rows, target, most, buckets, least, percent, 7)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " .,- "), (None, "no id"), (5, "one two three"), (5, "one two three"), (6, "word " * 40000), (7, "x" * 200000), (8, "-Étion dans ÇOUELLE 你好 A9z\x00b"), (9, "one")]
    found = importance.resample(docs(spark, rows), docs(spark, [(1, "one"), (2, None)]), most=2, least_words=1, percent=100)
    assert sorted(map(repr, map(tuple, found.collect()))) == plain(rows, ["one", None], 2, importance.BUCKETS, 1, 100, importance.SEED)
    empty = docs(spark, [])
    assert importance.resample(empty, empty).count() == 0
    alone = importance.resample(docs(spark, rows), empty, least_words=1)
    assert sorted(map(repr, map(tuple, alone.collect()))) == plain(rows, [], 1, importance.BUCKETS, 1, 10, importance.SEED)


def test_ties_go_to_smaller_ids(spark):
    """Repeated rows have equal scores, each its own rank."""
    found = importance.resample(docs(spark, [(4, "a b c")] * 50 + [(5, "a b d")] * 50), docs(spark, [(1, "a")]), least_words=1, percent=100)
    ranks = sorted((r["rank"], r["score"], r["id"]) for r in found.collect())
    assert [r[0] for r in ranks] == list(range(1, 101)) and [-r[1] for r in ranks] == sorted(-r[1] for r in ranks)


def test_places_of_grams():
    found = importance.Grams(pa.array(["a b a b", "", "..", "b", "c a b"]), 3)
    assert found.n_words.tolist() == [4, 0, 0, 1, 3]
    for n, (codes, rows, spelt) in enumerate(found.parts, 1):
        words = spelt.to_pylist()
        got = [[words[c] for c in codes[rows[i] : rows[i + 1]]] for i in range(5)]
        assert got == [[" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] for w in (["a", "b", "a", "b"], [], [], ["b"], ["c", "a", "b"])]
