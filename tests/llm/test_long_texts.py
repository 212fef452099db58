"""Long texts, hot buckets and mostly empty languages."""

import resource
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fathomry.llm import decontaminate, language_id, passage_quality, pii, secret_scan


def model(seed=2):
    rng = np.random.default_rng(seed)
    q, h, g = passage_quality.WIDTH, passage_quality.HIDDEN, passage_quality.GATE
    shapes = {"W": (q, h), "b": (h,), "V": (h, g), "v": (g,), "U": (h, g), "u": (g,), "a": (g,), "c": (h,), "d": (1,)}
    return passage_quality.Model(np.zeros(q), np.ones(q), {k: rng.normal(size=s) for k, s in shapes.items()})


def test_quality_in_parts_equals_quality_at_once():
    rng = np.random.default_rng(4)
    words = ["a", "word", "word", "Longer12", "é", "日本", "!!", "x" * 90]
    m = model()
    for n in (0, 1, 31, 32, 33, 64, 65, 1000):
        text = " \n"[n % 2] * (n % 3) + "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(n))
        data = np.frombuffer(text.encode(), np.uint8)
        x, bags = passage_quality.passages(data, np.array([0, len(data)]))
        p, a = m.score(x, bags)
        for at_once in (40, 333, 5000, 10**7) if len(data) else ():
            parts = list(passage_quality.passages_of(data, at_once))
            assert np.array_equal(np.concatenate([np.zeros((0, passage_quality.WIDTH), np.float32), *parts]), x), (n, at_once)
            found, k, top = m.score_long(iter(parts))
            assert np.isclose(found, p[0]) and k == bags[0] and (top is None if not k else a[top] == a.max())


def test_memory_and_time_of_one_long_text():
    """50 MB in one row: little more memory than the text takes, and time in proportion."""
    text = ("some words of a long text, number 12\n" * 1_400_000)[:50_000_000]
    column = pa.array([text])
    took = []
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for n in (12_500_000, 50_000_000):
        began = time.time()
        p, bags, _ = passage_quality.scored(model(), pa.array([text[:n]]))
        took.append(time.time() - began)
        assert 0 <= p[0] <= 1 and bags[0] == -(-len(text[:n].split()) // 32)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 900 and took[1] < 8 * took[0] + 2
    assert passage_quality.scored(None, column)[1][0] == bags[0]


def test_long_texts_in_the_scans(spark):
    prose = "the quick brown fox jumps over one lazy dog again " * 100_000  # 5 MB
    text = f"{prose}password=abcdef12 {prose}a@b.co"
    df = spark.createDataFrame([(1, text, "en"), (2, "", "en")], "doc_id long, text string, lang string")
    assert secret_scan.scan_secrets(df).orderBy("doc_id").first()["spans"][0]["start"] == len(prose)
    spans = pii.scan_pii(df).orderBy("doc_id").first()["spans"]
    assert (spans[-1]["kind"], spans[-1]["start"]) == ("email", 2 * len(prose) + 18)
    small = language_id.predict(df, {"en": b"the quick brown fox", "xx": b"zz yy ww vv uu tt"}).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in small] == ["en", "und"]
    bench = spark.createDataFrame([(1, "lazy dog again password abcdef12 the quick brown")], "item_id long, text string")
    hit = decontaminate.search(df, bench).orderBy("doc_id").first()
    assert hit["n_words"] == 2_000_000 + 5 and hit["hits"] == [999_997, 1_000_005]


def test_windows_that_end_alike():
    """A bucket of many windows: as fast as one of few."""
    took = []
    for n in (500, 50_000):
        tables = decontaminate.searchers([(i, f"w{i} a b c d e f g h i j of the".encode()) for i in range(n)])
        text = b" ".join(f"x{i} of the".encode() for i in range(60_000)) + b" w7 a b c d e f g h i j of the"
        began = time.time()
        words, hits, items = decontaminate.find_hits(text, tables)
        took.append(time.time() - began)
        assert (words, hits, items) == (180_013, [180_000, 180_013], [7])
    assert took[1] < 5 * took[0] + 1


def test_languages_with_few_texts(spark, monkeypatch):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("text number "), "id")).alias("text"), F.lit("xx").alias("lang"))
    rows = rows.unionByName(spark.range(30_000, 30_050).select(F.col("id").alias("doc_id"), F.concat(F.lit("other "), "id").alias("text"), F.lit("yy").alias("lang")))
    found = language_id.train(rows)
    assert len(found["xx"].split(b"\n")) == language_id.DOCS and len(found["yy"].split(b"\n")) == 50
    monkeypatch.setattr(language_id, "LANGUAGES", 1)
    assert set(language_id.train(rows)) == {"xx"}
