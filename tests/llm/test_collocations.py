"""Collocations against plain counting, routes by several words, the quicksort by itself, and odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidepanel.llm import collocations as col

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, level string, words string, task int, a string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1, "y", "z", 2, "w") for i, (t, g) in enumerate(rows)], SCHEMA)


def plain(rows, most=3, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + s]) for s in range(1, most + 1) for i in range(len(w) - s + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inside = Counter()
    for p, a in found.items():
        for s in range(2, len(p) - 1):
            for i in range(1, len(p) - s + 1):
                q = (p[0], *p[i : i + s])
                inside[q] = max(inside[q], a)
    out = []
    for lang in n:
        own = []
        for p, a in found.items():
            if p[0] == lang and (not inside[p] or 100 * inside[p] < share * a):
                cuts = [(1_000_000 * a * a // (f[p[: k + 1]] * f[(lang, *p[k + 1 :])]), k, f[p[: k + 1]], f[(lang, *p[k + 1 :])]) for k in range(1, len(p) - 1)]
                score, _, left, right = min(cuts)
                own.append((-score, -a, " ".join(p[1:]).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


def odd_rows():
    return [(None, "en"), ("", None), (" .,;\n", "en"), ("one", None), ("a b c. " * 20000, "en"), ("x" * 200000, "fr"), ("A\tb  c\x0bd é É\x00 e", None)] + [("same text here, Same text", None)] * 30 + [("New York is big", "en und")] * 12


@pytest.mark.parametrize(("most", "least", "share", "top"), [(3, 10, 50, 2000), (2, 5, 50, 40), (4, 3, 80, 2000)])
def test_against_counting(spark, most, least, share, top):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", "lang").collect()]
    found = col.collocations(docs(spark, rows), most=most, least=least, share=share, top=top)
    assert sorted(map(tuple, found.collect())) == plain(rows, most, least, share, top)


@pytest.mark.parametrize("load", [4, 200, 2000])
def test_hot_words_are_routed_by_more_words(spark, load, monkeypatch):
    """With small tasks, most leading words and pairs are hot; counts are whole all the same."""
    monkeypatch.setattr(col, "TASK_SUFFIXES", load)
    rng = random.Random(load)
    rows = [(" ".join(rng.choice(("the", "the", "of", "end.", f"w{rng.randrange(30)}")) for _ in range(60)), rng.choice(("en", "fr"))) for _ in range(60)]
    assert sorted(map(tuple, col.collocations(docs(spark, rows)).collect())) == plain(rows)


def test_odd_rows(spark):
    rows = odd_rows()
    assert sorted(map(tuple, col.collocations(docs(spark, rows)).collect())) == plain(rows)
    assert col.collocations(docs(spark, [])).count() == 0 and col.collocations(docs(spark, [(None, None)])).count() == 0


def test_ties_and_cuts(spark):
    """Equal scores go by count, then bytes; of equal cuts the first counts; a pair inside a frequent triple goes."""
    rows = [("b a. é z. B A", "en")] * 10 + [("p q r", "en")] * 10 + [("k l", "en")] * 40
    found = [tuple(r) for r in col.collocations(docs(spark, rows)).orderBy("rank").collect()]
    assert [r[2] for r in found] == ["k l", "b a", "p q r", "é z"] and sorted(found) == plain(rows)


def test_quicksort_counts():
    rng = np.random.default_rng(2)
    columns = rng.integers(0, 6, (3, 4000))
    columns[1, rng.random(4000) < 0.1] = -1
    columns[2, columns[1] < 0] = -1
    count = rng.integers(1, 4, 4000)
    for least, level in ((1, 1), (30, 1), (60, 3)):
        want = Counter()
        for i in range(4000):
            for k in range(1, 4):
                if columns[k - 1, i] >= 0:
                    want[tuple(columns[:k, i].tolist())] += int(count[i])
        found = {}
        for words, ptr, total in col.equal_parts(columns, count, least, level):
            for p, t in zip(ptr.tolist(), total.tolist(), strict=True):
                found[tuple(columns[:words, p].tolist())] = t
        assert found == {p: n for p, n in want.items() if n >= least or len(p) < level}
    assert list(col.equal_parts(np.zeros((3, 0), np.int64), np.zeros(0, np.int64), 1, 1)) == []
