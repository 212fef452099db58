"""Alignment against whole texts encoded at once and cuts found by sets."""

import base64
import hashlib
import os
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fathomry.llm import cross_tokenizers as C

SF = "/root/testdata/sf0.001"
CODERS = C.Coders(public_tokenizers.path(C.A_FILE), public_tokenizers.path(C.B_FILE))
ODD = [None, "", " ", "a", "  two  spaces  here ", "a\n b \n c\n\nd\t e", " lead and trail \n", "don't it's <|endoftext|> <s> </s> <unk> <0x41>", "▁ piece", "x▁y z", "日本語 テキスト テキスト", "é é ﬁ", "nul \x00 \x1c x \x85 y z 　 w", "\U0001f600‍ ok �", "zz " * 700, "no" * 3000]


def by_hand(text):
    """None, or the groups as lists of ids of A and of B."""
    raw = (" " + (text or "")).encode()
    if not text:
        return None
    sides = []
    for ids, known in ((CODERS.a.encode(" " + text, add_special_tokens=False).ids, CODERS.a_bytes), (CODERS.b.encode(text), CODERS.b_bytes)):
        ends, at = [], 0
        for i in ids:
            at += len(known[i])
            ends.append((at, i))
        if b"".join(known[i] for i in ids) != raw:
            return None
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append([[i for e, i in s if low < e <= cut] for s in sides])
        low = cut
    return groups


def check(found, rows):
    want = {}
    count = Counter()
    for k, (_, text) in enumerate(rows):
        want[k] = by_hand(text)
        count.update((g[0][-1], g[1][-1]) for g in want[k] or [])
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    expected = []
    for k, (doc, _) in enumerate(rows):
        groups = want[k] or []
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join("|".join(",".join(map(str, s)) for s in g) for g in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        expected.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), digest, sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links)))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(C.op11_align(spark, SF).collect(), rows)


def test_odd_and_long_texts(spark, monkeypatch, tmp_path):
    for name, value in (("PART", 50), ("SEGMENT", 200), ("ENCODED", 60)):
        monkeypatch.setattr(C, name, value)
    rng = random.Random(2)
    bits = ["a", "the", "Word", " ", "  ", "\n", ".", "é", "日本", " ", "123", "'s", "\t", "ing", "\U0001f600"]
    texts = [*ODD, *("".join(rng.choices(bits, k=rng.randrange(60))) for _ in range(300)), " ".join(rng.choices(["some", "words", "again"], k=4000)), "the end", "the end"]
    rows = [(i or None, t) for i, t in enumerate(texts)]
    rows += [(5, "same id"), (5, "other text")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, code int, codes string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(C.op11_align(spark, str(tmp_path)).collect(), rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert C.op11_align(spark, f"{tmp_path}/none").count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).select(F.lit(7).alias("doc_id"), F.expr("cast(unhex('61ff62') as string)").alias("text"))
    rows = C.aligned(df)
    assert [tuple(r)[:6] for r in rows.collect()] == [(7, 0, 0, 0, 0, "")]
    assert [tuple(r) for r in C.scored(rows, C.link_counts(rows)).collect()] == [(7, 0, 0, 0, 0, "", 0, 0)]


def test_why_chunks_and_the_lookup_are_sound():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert all(CODERS.a_bytes[int(i)] == base64.b64decode(raw) for raw, i in map(bytes.split, f))
    pieces = [CODERS.b.id_to_piece(i) for i in range(CODERS.b.vocab_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]
    assert C.possible_links(CODERS) < 1_000_000
