"""Token shards against whole-text encoding by the library, access by id, and odd rows."""

from __future__ import annotations

import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidepanel.llm import token_shards as shards

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, n_tokens int, frame int, start string, ids int, seq int, chance int"


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(shards.VOCABULARY)
    tokenizer.encode_special_tokens = True
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, shards.END_ID]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", 3, 4, 5) for i, t in rows], SCHEMA)


def odd_rows():
    return [(3, None), (1, ""), (None, "no id"), (2, "  \n\t "), (5, "one two"), (5, "one two"), (5, "other"), (7, "word " * 30000), (8, "x" * 200000), (9, "a <|endoftext|> b"), (-4, "é ç  naïve  x　 y 你好 \U0001f600 z")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_whole_table(spark, whole):
    rows = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    want, at = [], 0
    for i, text in rows:
        ids = whole(text)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, shards.op12_token_shards(spark, SF).collect())) == want


def test_words_apart_give_the_text(whole):
    rng, encoder = random.Random(3), shards.WordIds()
    parts = ["a", "B9", " ", "  ", "\n", "\r\n", "\t", "é", "è ", " ", " ", "　", "\u0085", "'s", "...", "<|endoftext|>", "你好", "\x00", "\x0b", " ", "\U0001f600", "don't", "12 34"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(3000)]
    found = []
    for lo, hi, ids, at in encoder.encode(pa.array(texts)):
        found += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert found == [whole(t)[:-1] for t in texts]


def test_odd_rows_and_access(spark, whole, tmp_path):
    rows = odd_rows()
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    manifest = shards.write_shards(docs(spark, rows), path)
    found = shards.read_shards(spark, path).collect()
    back = sorted((r["id"] is not None, r["id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in found)
    assert back == sorted((i is not None, i or 0, whole(t)) for i, t in rows)
    # starts follow one another in ascending order of id, null first
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"])
        at += r["n_tokens"]
    order = [r["id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == [None, *sorted(i for i, _ in rows if i is not None)] and manifest["tokens"] == at
    assert shards.read_document(path, 7) == [whole("word " * 30000)] and shards.read_document(path, 6) == []
    assert sorted(shards.read_document(path, 5)) == sorted(map(whole, ("one two", "one two", "other")))


def test_dictionary_is_shared_and_checked(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    manifest = shards.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), path)
    dictionary = shards._get(path, f"dictionary-{manifest['dictionary']}.zdict")
    assert 0 < len(dictionary) <= shards.DICTIONARY_BYTES
    assert shards.train_dictionary(spark.read.parquet(f"{SF}/documents.parquet")) == dictionary
    with pytest.raises(ValueError, match="not a shard"):
        shards.Shard(path, manifest["shards"][0]["name"], manifest | {"dictionary": "00" * 32})


def test_empty_table_and_hot_id(spark, whole, tmp_path):
    path = f"file://{tmp_path}/e"
    assert shards.write_shards(docs(spark, []), path)["shards"] == [] and shards.read_shards(spark, path).count() == 0
    path = f"file://{tmp_path}/h"
    manifest = shards.write_shards(docs(spark, [(1, "same text")] * 400 + [(i, "t") for i in range(2, 20)]), path)
    assert max(s["docs"] for s in manifest["shards"]) < 300 and len(shards.read_document(path, 1)) == 400
    assert {tuple(x) for x in shards.read_document(path, 1)} == {tuple(whole("same text"))}
