"""Each operator against a plain version, on small rows with nulls, empty texts, repeats and clashing columns."""

import base64
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomry.llm import common, decontaminate, jaccard_join, language_id, mix_sources, nearest, passage_quality, pii, secret_scan, toxic_spans, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = [" ".join(f"w{(i * 7 + j * (i % 5 + 1)) % 97}" for j in range(60 + i)) for i in range(8)]


def docs(spark, texts, first=1):
    return spark.createDataFrame([(first + i, t, "en", f"s{i % 3}" if i % 4 else None, len(t) if t else 0) for i, t in enumerate(texts)], DOC)


def der(*fields):
    out = b"".join(fields)
    return bytes([0x30]) + (bytes([len(out)]) if len(out) < 128 else b"\x82" + len(out).to_bytes(2, "big")) + out


def number(raw):
    return b"\x02" + (bytes([len(raw)]) if len(raw) < 128 else b"\x82" + len(raw).to_bytes(2, "big")) + raw


KEY = der(number(b"\x00"), *(number(bytes([3]) * n) for n in (129, 3, 128, 64, 64, 64, 64, 64)))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"HS256","typ":"JWT"}', b'{"sub":"1"}', b"signature-bytes"))


def test_secrets():
    text = f'é password="hunter22" Token : abc AKIA{"A" * 16} {"0a" * 12} {TOKEN} {base64.b64encode(KEY).decode()} end'
    spans = secret_scan.find_spans(text)
    assert [k for k, _, _ in spans] == ["assign", "access", "hex", "jwt", "key"]
    plain = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
    for t in [text, "pAsSwD='aaaaaa' secretsecret=x123456 api_key=..------ apikey:zzzzzz", "ſecret=abcdefgh toKen=abcdef", "password=secret=abcdef"]:
        assert [s for s in secret_scan.find_spans(t) if s[0] == "assign"] == [("assign", m.start(), m.end()) for m in plain.finditer(t) if len(m[2]) >= 6]
    assert secret_scan.is_key(KEY) and not secret_scan.is_key(KEY[:-1]) and not secret_scan.is_key(KEY + b"x")
    assert secret_scan.find_spans(None) == [] and secret_scan.mask("a password=abcdef b", [("assign", 2, 17)]) == "a [SECRET] b"
    assert len(secret_scan.find_spans("token=" + "a" * 300_000)) == 2


def test_redaction_keeps_rows_and_columns(spark):
    df = docs(spark, ["x password=abcdefg y", None, "", "clean"]).withColumn("start", F.lit(1))
    rows = secret_scan.redact_secrets(df).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["x [SECRET] y", None, "", "clean"] and rows[0]["n_chars"] == 12 and rows[3]["start"] == 1
    assert secret_scan.redact_secrets(df.limit(0)).count() == 0


def test_pii():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for t in ["a@b.c@d.e x@y é.z@q.com..", "@@a@b.co a@b@c.d", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 0001.2.3.255 12.1.2.3.4"]:
        found = pii.find_spans(t)
        assert [s[1:3] for s in found if s[0] == "email"] == [m.span() for m in email.finditer(t)]
        assert [s[1:3] for s in found if s[0] == "ip"] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    found = pii.find_spans("card 4418452524842581 call +1 (784) 555-8120, iban DE89 3704 0044 0532 0130 00 amex 378282246310005 card")
    assert [(s[0], s[3]) for s in found] == [("card", True), ("card", False), ("phone", True), ("iban", False)]
    assert pii.find_spans(None) == [] and len(pii.find_spans("1" * 200_000)) == 0 and len(pii.find_spans("a" * 200_000 + "@b.c")) == 1


@pytest.mark.parametrize("most", [10_000, 3])
def test_decontamination(spark, most):
    items = [" ".join(f"k{i}_{j}".replace("_", "z") for j in range(n)) for i, n in enumerate((20, 13, 5, 1, 0))]
    bench = spark.createDataFrame([*enumerate([*items, items[0]]), (None, "only three words")], "item_id long, text string")
    texts = [f"{PROSE[0]} {items[0].upper()}", f"a, {items[2]}! b", items[3], None, "", f"{PROSE[1] * 9} {' '.join(items[0].split()[:12])}", "x only three words y", "x only three words y"]
    rows = decontaminate.verdicts(decontaminate.search(docs(spark, texts), bench, most)).orderBy("doc_id").collect()

    def plain(text):
        words, hit, found = decontaminate.words_of(text.encode() if text else None), set(), set()
        for item, t in [*enumerate([*items, items[0]]), (None, "only three words")]:
            for w in decontaminate.windows_of(decontaminate.words_of(t.encode())):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        found |= {item} - {None}
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()

    assert [tuple(r)[1:5] for r in rows] == [plain(t) for t in texts]
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs(spark, texts), bench, most).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["contaminated"]}


def test_mixing(spark):
    texts = [" ".join(["w"] * (i % 7)) for i in range(200)]
    rows = mix_sources.mix(docs(spark, texts)).collect()
    assert len(rows) == 200 and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(t) - target) <= 6 for (_, target), t in by.items())
    assert sum(t for _, t in by) == pytest.approx(1.5 * sum(s for s, _ in by))
    assert sorted(map(tuple, mix_sources.mix(docs(spark, texts)).collect())) == sorted(map(tuple, rows))
    assert mix_sources.mix(docs(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    assert mix_sources.mixed_rows(docs(spark, texts).limit(0)).count() == 0
    clash = docs(spark, texts).withColumns({k: F.lit(9) for k in ("copy_no", "__skey", "__n", "size", "h")})
    mixed = mix_sources.mixed_rows(clash)
    assert mixed.columns == [c for c in clash.columns if c != "copy_no"] + ["copy_no"]
    taken = {r["doc_id"]: r["taken"] for r in rows}
    assert sorted(r["doc_id"] for r in mixed.collect() if r["text"]) == sorted(d for d, n in taken.items() for _ in range(n and n // max(1, (d - 1) % 7)))


def test_urls(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", 40)
    rules = [("allow", "com", "/"), ("block", "a.com", "/x/"), ("allow", "b.a.com", "/x/"), ("block", "a.com", "/x/y"), ("block", "org", "/"), ("allow", "q.org", "/p")]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in ("a.com", "B.a.COM", "c.b.a.com", "xa.com", "q.org", "net", "com", "z.q.org:80") for p in ("", "/", "/x/", "/x/yz?a://b", "/p#f", "?x")]
    rows = [*enumerate([*urls, None, "none", *(["http://a.com/x/"] * 50)])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    for i, url in rows:
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = ("", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, best[2], best[3])


@pytest.mark.parametrize(("part", "cluster"), [(8_192, 2_000_000), (3, 400)])
def test_links(spark, monkeypatch, part, cluster):
    """In one part and in many: blocks of over 3 nodes and clusters of over 400 shingles are dealt into parts."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "CLUSTER", cluster)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1000 if part > 3 else 20)
    base = PROSE[7].split() * 3
    edited = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(0, 150, 9)]
    texts = [*PROSE, PROSE[0].upper(), PROSE[0] + "\t", *edited, "one two", "One  two", "one", None, "", " \n", *edited[:2]]
    rows = jaccard_join.link(docs(spark, texts)).orderBy("doc_id").collect()

    def shingles(t):
        w = t.encode().lower().split() if t else []
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert [(r["n_shingles"], r["component_id"]) for r in rows] == [(len(s), root[i] + 1) for i, s in enumerate(sets)]
    kept = jaccard_join.keep_one(docs(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({root[i] + 1 for i in range(len(texts))})


def test_keep_one_with_repeats_nulls_and_clashing_names(spark):
    rows = [(1, PROSE[0]), (1, PROSE[0]), (2, PROSE[0]), (None, PROSE[1]), (None, PROSE[1]), (3, PROSE[2]), (4, None), (4, None), (5, ""), (6, PROSE[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(7) for k in ("maybe", "key", "gone", "n", "sig", "root")})
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted((i or 0, t or "") for i, t in {*rows} - {(2, PROSE[0])})


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = PROSE[0], PROSE[1]
    df = spark.createDataFrame([(1, a, 1), (2, a, 2), (2, b, 3), (3, "x y", 4), (5, a, 5), (5, b, 6), (9, b, 7)], "doc_id long, text string, copy_no int")
    assert sorted((r["doc_id"], r["text"]) for r in jaccard_join.keep_one(df).collect()) == [(1, a), (2, b), (3, "x y")]
    # One row that is a third of the table, and one key with as many unlike texts.
    rows = [(7, a)] * 300 + [(8, f"{a} {i} {i + 1}") for i in range(3)] + [(8, f"t{i} u{i}") for i in range(300)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 301 and sum(r["doc_id"] == 7 for r in kept) == 1
    assert jaccard_join.keep_one(df.limit(0)).count() == 0 and jaccard_join.link(df.limit(0)).count() == 0


def test_screen_never_misses(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("key"))
    seen = common.screened(spark.range(3000).withColumn("own", F.col("id").cast("string")), "own", keys).collect()
    assert len(seen) == 3000 and all(r["__maybe"] for r in seen if r["id"] % 3 == 0)
    assert sum(r["__maybe"] for r in seen if r["id"] % 3) < 100
    assert not any(r["__maybe"] for r in common.screened(spark.range(9).withColumn("own", F.lit(None).cast("string")), "own", keys.limit(0)).collect())


def test_tree_bound_never_misses():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in rng.integers(1, 400, 60)]
    sets += [np.unique(np.r_[s[: int(len(s) * 0.95)], rng.integers(0, 1 << 62, 2).astype(np.uint64)]) for s in sets]
    counts, sizes = jaccard_join.folded([jaccard_join.counts_of(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard_join.Tree(sizes, counts)
    for i, s in enumerate(sets):
        want = {j for j, t in enumerate(sets) if 100 * (both := len(np.intersect1d(s, t))) >= 80 * (len(s) + len(t) - both)}
        assert want <= set(tree.search(len(s), counts[i]).tolist())


def test_nearest(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    points = np.concatenate([centres[rng.integers(12, size=1500)] + 0.3 * rng.normal(size=(1500, 8)), np.ones((60, 8))])
    rows = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)] + [(2000, None, 1), (2001, [0.0] * 8, 1), (2002, [float("nan")] * 8, 1), (2003, [None] * 8, 1), (2004, [1.0], 1)]
    vectors = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"))
    got = nearest.search(vectors, vectors.where("vec_id % 50 = 0")).collect()
    hit = total = 0
    for q in range(0, len(points), 50):
        d = np.sqrt(((points - points[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(points)), d))[:10]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(r["score"] == pytest.approx(d[r["vec_id"]]) for r in mine)
        hit, total = hit + len(set(want.tolist()) & {r["vec_id"] for r in mine}), total + 10
    assert hit / total >= 0.9
    assert nearest.search(vectors.limit(0), vectors.limit(0)).count() == 0


def test_quality_learns_from_marked_passages(spark):
    clean, bad = PROSE, [p + " " + " ".join(w.upper() + "!!" for w in PROSE[1].split()) for p in PROSE]
    df = docs(spark, [x for pair in zip(clean * 12, bad * 12, strict=True) for x in pair] + [None, "", "  "])
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    found = passage_quality.score(df, passage_quality.train(df, labels)).collect()
    right = [(r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in found if r["n_passages"]]
    assert np.mean(right) > 0.95 and sum(r["n_passages"] == 0 for r in found) == 3
    assert {r["score"] for r in passage_quality.score(df, passage_quality.train(df, labels.limit(0))).collect()} == {0.0}


def test_toxic_spans(spark):
    words = [f"tox{i}" for i in range(4)]
    rng = np.random.default_rng(2)
    prose = [" ".join(f"w{j}" for j in rng.integers(0, 3000, 40)) for _ in range(400)]
    texts = [f"{prose[i]} r{i} {words[i % 4] if i % 3 == 0 else 'plain'} é end{i}" for i in range(400)]
    df = docs(spark, [*texts, None, ""], 0)
    labels = df.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).where("doc_id < 400")
    found = {r["doc_id"]: r for r in toxic_spans.score(df, toxic_spans.train(df, labels)).collect()}
    assert np.mean([(found[i]["score"] >= 0.5) == (i % 3 == 0) for i in range(400)]) > 0.97
    s = found[3]["spans"][0]
    assert texts[3][s["start"] : s["end"]] == "tox3" and found[400]["spans"] == []


def test_languages(spark):
    make = lambda stem: [" ".join(f"{stem}{(i * j) % 53}" for j in range(50)) for i in range(1, 30)]
    rows = [(i, t, lang) for lang, stem in (("xx", "foo"), ("yy", "bar")) for i, t in enumerate(make(stem))]
    df = spark.createDataFrame([*rows, (99, None, "xx"), (100, "12 34", "yy")], "doc_id long, text string, lang string")
    model = language_id.train(df)
    found = language_id.predict(df.withColumn("score", F.lit("clash")), model).join(df, "doc_id").collect()
    assert all(r["lang_pred"] in ("xx", "yy", "und") for r in found)
    sizer = language_id.Sizer(model)
    assert all(sizer.predict(t)[0] == lang for _, t, lang in rows) and sizer.predict(None)[0] == sizer.predict("1 2")[0] == "und"
    assert language_id.Sizer({}).predict("text") == ("und", 0.0, False)


def test_entry_names():
    import corpus_pipeline
    from fathomry.llm import catalogue

    assert [n for n in range(1, 11) if not any(k.startswith(f"op{n}_") for k in catalogue.queries())] == []
    assert len(corpus_pipeline.STAGES) == 5 and json.dumps([n for n, _ in corpus_pipeline.STAGES])
