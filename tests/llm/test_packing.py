"""Packing against plain encoding: every id in exactly one piece, no gaps, little padding."""

import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fathomry.llm import packing

SF = "/root/testdata/sf0.001"
CODER = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
ODD = [None, "", " ", "a", "  two  spaces ", "don't STOP!! it's 3.14,", "é ́x é z", "İstanbul ΣΑΣ ß", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "\x00\x1c\t\n\r a b　c", "x" * 5000, "'s 't ' s", "\U0001f600‍", "ab. cd, ef; gh: ij! kl? mn.. op"]


def plain(text):
    return [*CODER.encode(text or "", add_special_tokens=False).ids, 1]


def check(found, rows):
    """rows: (doc_id, text), ids distinct. Gives the padded places."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert len(documents) == len(rows)
    for doc, text in rows:
        ids, at = plain(text), 0
        for r in sorted(documents[doc], key=lambda r: r["start"]):
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part.tobytes()), (doc, text)
            at += r["length"]
        assert at == len(ids)
    return padding


def test_words_equal_plain_encoding(monkeypatch):
    words = packing.Words(public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "'", "s", "1", "2", ".", "!?", "é", "é", "́", "İ", " ", "<|endoftext|>", "日本", "‍", "word", "Longer", "\t", "\x1d", "Ä", "ß", "ÿ", "µ", "ª", "×", "'LL", "''", "<|"]
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    texts = [*ODD[1:], *("".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000))]
    for part in (9, 1 << 30):
        monkeypatch.setattr(packing, "PART", part)
        for at in range(0, len(texts), 50):
            some = texts[at : at + 50]
            for text, ids in zip(some, words.ids(some), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == plain(text)[:-1], repr(text)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check(packing.op12_pack(spark, SF).collect(), rows) == 0


@pytest.mark.parametrize("parts", [1, 3, 30, 100])
def test_rounds_of_merging(spark, parts, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 3)
    rng = random.Random(parts)
    texts = [*ODD, *(" ".join(rng.choices(["one", "Two", "three.", "4", "fünf"], k=rng.randrange(3000))) for _ in range(60)), "long " * 30_000]
    rows = [(i if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, part int, ids binary").repartition(parts)
    assert check(packing.packed(df).collect(), rows) == 0


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "same text")] * 500 + [(1, None)] * 20, "doc_id long, text string")
    found = packing.packed(df).collect()
    assert sum(r["length"] for r in found) == 500 * 3 + 20 and sum(r["start"] == 0 for r in found) == 520
    assert packing.packed(df.limit(0)).count() == 0
    assert packing.packed(df).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").columns == packing.packed(df).columns
