"""The contract's plain rules against the queries, on whole tables; fits against plain versions; the pipeline against brute force."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from fathomry.llm import common, jaccard_join, language_id, nearest, passage_quality, pii, secret_scan, toxic_spans, url_filter
from test_operators import DOC, KEY, PROSE, TOKEN, docs

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_secrets(text):
    kinds = {
        "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    }
    found = [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(kinds).index(s[0])))


def plain_pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text or "", re.ASCII) if ok(m)]


def noise(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_base_spans_on_noise():
    for t in noise(["password", "TOKEN", "api", "_key", "Secret", "=", ":", " ", "'", '"', "abc", "x9/", "AKIA", "ABCD1234", "0a", "ff", "é", "ſ", "K"], 3000, 1):
        assert [s for s in secret_scan.find_spans(t) if s[0] in secret_scan.BASE] == plain_secrets(t), t
    for t in noise(["a", "B.", "@", "x.y", "-", "+", "1", "23", ".", "255", " ", "(", ")", "4418452524842581", "0", "é", "+1 "], 3000, 2):
        assert [s[:3] for s in pii.find_spans(t) if s[3]] == plain_pii(t), t


@tables
def test_base_columns_of_whole_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = secret_scan.op1_secrets(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_secrets(texts[r["doc_id"]])
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == digest(want) and {f"{k}:{a}:{b}" for k, a, b in want} <= {*r["spans"].split(",")}
    for r in pii.op6_pii(spark, SF).collect():
        want = plain_pii(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone"))
        assert r["base_sha256"] == digest(want) and len(r["spans"].split(",")) == len(r["scores"].split(","))


def tlv(tag, body):
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def test_keys_where_they_lie():
    raw = base64.b64encode(KEY).decode()
    lines = re.findall(".{1,64}", raw)
    pem = "\n".join(["-----BEGIN RSA PRIVATE KEY-----", *lines, "-----END RSA PRIVATE KEY-----"])
    sealed = tlv(0x30, tlv(0x30, tlv(0x06, b"\x2a\x86\x48") + tlv(0x30, tlv(0x04, b"salt"))) + tlv(0x04, b"c" * 64))
    cases = {
        "pem": pem,
        "escaped": '{"key": "' + pem.replace("\n", "\\n") + '"}',
        "base64 of pem": "data: " + base64.b64encode(pem.encode()).decode() + " end",
        "twice": base64.b64encode(base64.b64encode(pem.encode())).decode(),
        "bare": "key " + raw + " end",
        "wrapped": "key:\n" + "\n".join(lines) + "\nend of it",
        "sealed": "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + base64.b64encode(sealed).decode() + "\n-----END ENCRYPTED PRIVATE KEY-----",
        "base64 of bare": base64.b64encode(raw.encode()).decode(),
        "hex of pem": pem.encode().hex(),
        "hex": "x " + KEY.hex().upper() + " y",
        "base64 of token": base64.b64encode(TOKEN.encode()).decode(),
    }
    for name, text in cases.items():
        spans = [s for s in secret_scan.find_spans(text) if s[0] == "key"]
        assert len(spans) == 1, (name, spans)
    wrapped = cases["wrapped"]
    (_, a, b), = [s for s in secret_scan.find_spans(wrapped) if s[0] == "key"]
    assert re.sub(r"\s", "", wrapped[a:b]) == raw
    cipher = base64.b64encode(bytes(range(64))).decode()
    head = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{cipher}\n-----END RSA PRIVATE KEY-----"
    assert [s[0] for s in secret_scan.find_spans(head)].count("key") == 1
    for text in (pem.replace("M", "N", 1), raw[:-8], base64.b64encode(b"just words " * 20).decode(), "-----BEGIN PRIVATE KEY-----" * 50, head.replace("DEK-Info", "Other")):
        assert not [s for s in secret_scan.find_spans(text) if s[0] == "key"]
    began = time.time()
    for text in ("M" * 1_000_000, "-----BEGIN PRIVATE KEY-----\n" * 40_000, "TUlJ" * 250_000, "MIIE\\n" * 200_000, "eyJ." * 250_000):
        secret_scan.find_spans(text)
    assert time.time() - began < 20


def test_accounts_and_numbers():
    for account in ("RO49AAAA1B31007593840000", "SK3112000000198742637541", "TR330006100519786457841326", "BR1800360305000010009795493C1", "MT84MALT011000012345MTLCAST001S", "DE89370400440532013000"):
        assert [s[0] for s in pii.find_spans(f"bank {account}.")].count("iban") == 1, account
        assert not [s for s in pii.find_spans(f"bank {account[:-1]}{'0' if account[-1] != '0' else '1'}.") if s[0] == "iban"]
    began = time.time()
    assert len([s for s in pii.find_spans("call 212-555-0143 " * 55_000) if s[0] == "phone"]) == 55_000
    pii.find_spans("1 " * 500_000 + "phone")
    assert time.time() - began < 20


def test_marginals_equal_enumeration_of_all_paths():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 8):
        evidence, step = rng.normal(size=(1, n)) * 2, rng.normal(size=(2, 2))
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = math.exp(sum(e for e, y in zip(evidence[0], path, strict=True) if y) + sum(step[a, b] for a, b in itertools.pairwise(path)))
        total = sum(weight.values())
        want = [sum(w for p, w in weight.items() if p[k]) / total for k in range(n)]
        odds, fwd, bwd = toxic_spans.marginals(evidence, np.ones((1, n), bool), step)
        assert np.allclose(1 / (1 + np.exp(-odds[0])), want)
        if n > 1:
            pairs = toxic_spans.expected_pairs(evidence, fwd, bwd, step)
            for k in range(n - 1):
                both = [sum(w for p, w in weight.items() if p[k : k + 2] == (a, b)) / total for a in (0, 1) for b in (0, 1)]
                assert np.allclose(pairs[:, k, 0], both)


def plain_attention(w, passages):
    """The score of one bag, in plain Python."""
    mul = lambda x, m, b: [sum(xi * m[i][j] for i, xi in enumerate(x)) + b[j] for j in range(len(b))]
    sig = lambda v: 1 / (1 + math.exp(-v))
    hidden = [[math.tanh(v) for v in mul(x, w["W"], w["b"])] for x in passages]
    raw = [sum(a * math.tanh(t) * sig(u) for a, t, u in zip(w["a"], mul(h, w["V"], w["v"]), mul(h, w["U"], w["u"]), strict=True)) for h in hidden]
    share = [math.exp(r - max(raw)) for r in raw]
    z = [sum(s * h[i] for s, h in zip(share, hidden, strict=True)) / sum(share) for i in range(len(w["c"]))] if passages else [0.0] * len(w["c"])
    return sig(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])


def quality_by_hand(model, text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    x, _ = passage_quality.passages(data, np.array([0, len(data)]))
    return plain_attention({k: v.tolist() for k, v in model.weights.items()}, ((x - model.mean) / model.spread).tolist())


def test_passage_vectors_by_hand():
    text = "Abc abd!  abc\nabc 12 é " + "w x " * 40
    data = np.frombuffer(text.encode(), np.uint8)
    x, bags = passage_quality.passages(data, np.array([0, len(data)]))
    words = text.split()
    assert bags.tolist() == [-(-len(words) // passage_quality.PASSAGE)] and x.shape[1] == passage_quality.WIDTH
    gram = lambda t: ((t[0] * 2654435761 + t[1] * 2246822519 + t[2] * 3266489917) % 2**32 >> 13) % passage_quality.GRAMS
    counts = np.zeros(passage_quality.GRAMS)
    for word in words[: passage_quality.PASSAGE]:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode())
        for i in range(len(raw) - 2):
            counts[gram(raw[i : i + 3])] += 1
    assert np.allclose(x[0, passage_quality.CLASSES : passage_quality.CLASSES + passage_quality.GRAMS], np.sqrt(counts / counts.sum()), atol=1e-6)
    assert np.isclose(x[0, -1], 1.0) and np.isclose(x[-1, -1], (len(words) - 64) / 32)


def test_attention_equals_a_plain_version(spark):
    bad = [p + " " + " ".join(w.upper() + "!!" for w in PROSE[1].split()) for p in PROSE]
    df = docs(spark, [x for pair in zip(PROSE * 8, bad * 8, strict=True) for x in pair] + [None, "", "  ", "word"]).withColumns({"score": F.lit("clash"), "y": F.lit(1)})
    model = passage_quality.train(df, df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in passage_quality.score(df, model).collect():
        assert r["score"] == pytest.approx(quality_by_hand(model, texts[r["doc_id"]]), abs=1e-6)
    # Gradients against differences.
    rng = np.random.default_rng(1)
    w = {k: rng.normal(size=v.shape) * 0.3 for k, v in model.weights.items()}
    x, bags, y = rng.normal(size=(9, passage_quality.WIDTH)), np.array([3, 1, 5]), np.array([0.0, 1.0, 1.0])
    loss = lambda: -np.mean(y * np.log(p := passage_quality.forward(w, x, bags)[0]) + (1 - y) * np.log(1 - p))
    grad = passage_quality.gradients(w, x, bags, y)
    for k in w:
        at = tuple(rng.integers(n) for n in w[k].shape)
        w[k][at] += 1e-5
        up = loss()
        w[k][at] -= 2e-5
        assert grad[k][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
        w[k][at] += 1e-5


def test_languages_equal_compression_by_hand(spark):
    make = lambda stem: [" ".join(f"{stem}{(i * j) % 53}" for j in range(50)) for i in range(1, 30)]
    rows = [(i * 2 + k, t, lang) for k, (lang, stem) in enumerate((("xx", "foo"), ("yy", "bar"))) for i, t in enumerate(make(stem))]
    df = spark.createDataFrame([*rows, (999, "foo1 bar1", None)], "doc_id long, text string, lang string").withColumns({"lang_pred": F.lit(1), "accepted": F.lit(2)})
    model = language_id.train(df)
    for r in language_id.predict(df, model).collect():
        raw = next(t for i, t, *_ in [*rows, (999, "foo1 bar1")] if i == r["doc_id"]).lower().encode()
        sizes = {}
        for lang, words in model.items():
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(raw[i : i + language_id.PIECE])) for i in range(0, len(raw), language_id.PIECE))
        low, high = sorted(sizes.values())
        assert r["lang_pred"] == min(sizes, key=lambda k: (sizes[k], k)) and r["accepted"] == ((high - low) / low >= language_id.MARGIN)
    assert not language_id.Sizer({"xx": model["xx"], "zz": model["xx"]}).predict("foo1 foo2")[2]  # no margin at all
    assert language_id.Sizer({"xx": model["xx"]}).predict("foo1") == ("xx", 1.0, True)
    assert language_id.train(df.limit(0)) == {} and language_id.predict(df.limit(0), {}).count() == 0


@tables
def test_languages_held_out(spark):
    found = language_id.op4_language(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert found and np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in found)


def test_fits_are_bounded_in_rows_and_bytes(spark):
    """One id in very many rows, and one huge text."""
    many = spark.range(100_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3000).alias("text"))
    huge = spark.createDataFrame([(2, "x " * 25_000_000), (3, "small"), (3, "small")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    rows = common.labelled_texts(many.unionByName(huge), labels, "quality", 50).collect()
    assert len(rows) <= 50 and all(len(r["text"]) < 100 for r in rows)
    rows = common.labelled_texts(huge, labels, "quality", 50).collect()
    assert [(r["doc_id"], r["y"], r["text"]) for r in rows] == [(3, 1, "small")]
    assert sum(len(r["text"]) for r in common.labelled_texts(many, labels, "quality", 5000, 1000).collect()) <= 1000
    lang = many.withColumn("lang", F.lit("xx"))
    assert len(language_id.train(lang, 20)["xx"].split(b"\n")) <= 40


def test_a_hot_url_is_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 500)
    same = spark.createDataFrame([(None, "http://a.com/x")] * 6000 + [(i, f"http://b{i}.org/") for i in range(2000)], "page_id long, url string")
    urls = url_filter.parsed(same)
    borders = url_filter.cuts(urls)
    assert 8 <= len(borders) <= 16 and sum(k == borders[0][0] for k, _ in borders) >= 8
    monkeypatch.setattr(url_filter, "RANGES", 3)
    assert len(url_filter.cuts(urls)) == 2
    rules = spark.createDataFrame([("block", "a.com", "/x")], "verdict string, host string, path string")
    assert url_filter.judge(same, rules).where("verdict = 'block'").count() == 6000


def test_empty_tables_and_clashing_columns(spark):
    clash = {k: F.lit(5) for k in ("h", "n", "y", "key", "score", "spans", "hits", "items", "__hits", "kind", "list", "parts", "size", "sig")}
    some = docs(spark, [PROSE[0], None, "", "password=abcdef a@b.co"]).withColumns(clash)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    from fathomry.llm import decontaminate, mix_sources

    for df in (some, some.limit(0)):
        n = df.count()
        quality, toxic = passage_quality.train(df, labels), toxic_spans.train(df, labels)
        assert passage_quality.score(df, quality).count() == n and toxic_spans.score(df, toxic).count() == n
        assert passage_quality.keep_good(df, None).columns == df.columns and passage_quality.keep_good(df, quality).count() <= n
        assert secret_scan.scan_secrets(df).count() == n and pii.scan_pii(df).count() == n
        assert secret_scan.redact_secrets(df).columns == df.columns
        assert language_id.predict(df, language_id.train(df)).count() == n
        for b in (bench, bench.limit(0)):
            assert decontaminate.search(df, b).count() == n and decontaminate.keep_clean(df, b).columns == df.columns
        assert jaccard_join.link(df).count() == n and jaccard_join.keep_one(df).columns == df.columns
        assert mix_sources.mix(df).count() == n and mix_sources.mixed_rows(df).columns == [*df.columns, "copy_no"]
    pages = spark.createDataFrame([(1, "http://a.com/x", 2)], "page_id long, url string, pid int")
    rules = spark.createDataFrame([("block", "a.com", "/")], "verdict string, host string, path string")
    for p, r in itertools.product((pages, pages.limit(0)), (rules, rules.limit(0))):
        assert url_filter.judge(p, r).count() == p.count()
    vectors = spark.createDataFrame([(100, [1.0, 2.0], 3)], "vec_id long, embedding array<double>, rank int")
    assert nearest.search(nearest.usable(vectors), nearest.usable(vectors)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    df = docs(spark, [long, long + " more", long[:100] + " token=abcdefgh", None])
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.link(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert passage_quality.score(df, passage_quality.train(df, labels)).where("doc_id < 3").agg(F.min("n_passages")).first()[0] == 12_500
    assert toxic_spans.score(df, toxic_spans.train(df, labels)).count() == 4


# The pipeline -------------------------------------------------------------------------------------------------------


def plain_mix(rows):
    """rows: list of dicts. Each row as often as the mix takes it, by sorting hashes."""
    key = lambda r: (r["source"] is None, r["source"] or "")
    size = lambda r: len((r["text"] or "").encode().split())
    mark = lambda r: int(hashlib.md5(f"{'-' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest()[:15], 16)
    sources = sorted({key(r) for r in rows})
    sizes = {s: sum(size(r) for r in rows if key(r) == s) for s in sources}
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    budget, targets, open_ = 1.5 * sum(sizes.values()), {}, set(sources)
    while open_:
        share = {s: budget * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2 * sizes[s]
            budget -= 2 * sizes[s]
        open_ -= over
    out = []
    for s in sources:
        own = [r for r in rows if key(r) == s]
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, bound, total = targets[s] - whole * sizes[s], None, 0
        groups = {}
        for r in own:
            groups[mark(r)] = groups.get(mark(r), 0) + size(r)
        for h in sorted(groups):
            if total + groups[h] > rest:
                bound = h + (total + groups[h] - rest < rest - total)
                break
            total += groups[h]
        for r in own:
            more = rest > 0 and (bound is None or mark(r) < bound)
            out += [(r["doc_id"], r["text"], n) for n in range(1, whole + more + 1)]
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    prose = [" ".join(rng.choice(("river", "stone", "garden", "window", "letter", "morning")) + str(rng.randrange(400)) for _ in range(70)) for _ in range(60)]
    junk = [" ".join("BUY!!" + str(rng.randrange(50)) + "$$$" for _ in range(60)) for _ in range(30)]
    item = " ".join(f"item{i}" for i in range(20))
    texts = [*prose, *junk, *[p + " tail" for p in prose[:8]], prose[9] + " " + item, item, f"{' '.join(reversed(prose[10].split()))} password=hunter2222 AKIA{'B' * 16} {TOKEN}", None, "", " ", None]
    rows = [(i + 1, t, ("web", "book", "news", None)[i % 4], 7) for i, t in enumerate(texts)]
    rows += [rows[3], (3, prose[40] + " extra", "web", 7), (3, " ".join(reversed(prose[41].split())), "book", 7), (None, prose[12], "web", 7), (None, prose[12], "web", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no int").withColumn("n_chars", F.length("text"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i + 1, int(i < 60)) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "text", "source", "n_chars", "copy_no"]
    got = sorted(((r["doc_id"], r["text"], r["copy_no"]) for r in found.collect()), key=repr)

    model = passage_quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [{"doc_id": i, "text": t, "source": s} for i, t, s, _ in rows if quality_by_hand(model, t) >= passage_quality.THRESHOLD]
    assert 60 < len(left) < len(rows) - 20

    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(r["text"]) for r in left], list(range(len(left)))
    for _ in left:
        for i, j in itertools.combinations(range(len(left)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    mark = lambda r: hashlib.md5(f"{'-' if r['doc_id'] is None else '=' + str(r['doc_id'])}\n{'-' if r['text'] is None else '=' + r['text']}".encode()).digest()
    groups = {}
    for i, r in enumerate(left):
        groups.setdefault(root[i] if sets[i] else ("alone", r["doc_id"], r["text"]), []).append(r)
    left = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, mark(r))) for g in groups.values()]

    def clean(text):
        w, b = re.findall("[0-9a-z]+", (text or "").lower()), item.split()
        hit = {i + k for i in range(len(w) - 12) for j in range(len(b) - 12) if w[i : i + 13] == b[j : j + 13] for k in range(13)}
        return not hit or 20 * len(hit) < len(w)

    left = [r for r in left if clean(r["text"])]
    for r in left:
        if r["text"]:
            spans = [s[1:] for s in plain_secrets(r["text"])] + [m.span() for m in re.finditer(re.escape(TOKEN), r["text"])]
            cover = {i for a, b in spans for i in range(a, b)}
            r["text"] = "".join("" if i in cover and i - 1 in cover else "[SECRET]" if i in cover else c for i, c in enumerate(r["text"]))
    assert got == sorted(plain_mix(left), key=repr)
    assert any("[SECRET]" in (t or "") for _, t, _ in got)
