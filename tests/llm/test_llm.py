"""Each operator on awkward rows, against brute force or a round trip."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contractlake.llm import (
    archive, boosting, components, exact_dedup, fuse, inner_products, language_id, language_model, mixing, near_dedup, sentence_pieces, sketch,
    token_ids, toxicity, wavelet,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"
LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, "The cat sat on the mat today", "en", "a"), (2, "the CAT sat on the mat today", "en", "a"), (3, None, None, None), (4, "", "en", "b"),
    (5, "The cat sat on the mat today", "de", "b"), (5, "The cat sat on the mat today", "de", "b"), (6, LONG, "en", "a"), (7, LONG + " tail", "en", None),
    (8, "one two", None, "é"), (9, " \t\n", "fr", "b"), (10, "Ünï 中文 😀 İ it's", "fr", "b"), (None, "no id here at all", "en", "a"), (11, "x" * 5000, "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).withColumn("size", F.lit("clash")).withColumn("kept", F.lit(1)).withColumn("fp", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def test_mixing(docs, no_docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(no_docs).count() == 0
    sizes = collections.Counter()
    for _, t, _, s in ROWS:
        sizes[s] += len(words(t))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share >= 2 * sizes[s]}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else weight[s] * share
            left -= target[s]
        free -= over or set(free)
    by_id = {(i, s) for i, _, _, s in ROWS}
    source = dict(by_id)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and math.isclose(r["target"], target[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(len(r["passes"]) for r in got)


def test_schedules_invert(spark):
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 2.0), (0.4, 0.5), (1.0, 1.5))])
    df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("k", knots).withColumn("a", mixing.integrate(F.col("k")))
    t = np.array([r["t"] for r in df.select(mixing.invert(F.col("k"), F.col("a"), F.col("u")).alias("t")).collect()])
    grid = np.linspace(0, 1, 20001)
    w = np.interp(grid, [0, 0.4, 1], [2, 0.5, 1.5])
    area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2) / 20000])
    assert np.allclose(np.interp(t, grid, area / area[-1]), np.linspace(0, 1, 101), atol=1e-6)


def test_archive_round_trip(spark, tmp_path):
    big, huge = "<p>" + "é" * 80, "<p>" + "long " * 400_000
    rows = [(20, "h", huge), (21, "h", huge), (22, "h", None), (3, "http://a", big), (1, "http://b", big), (2, None, None), (7, "http://c", ""), (8, "u\r\nv", "small"), (9, "u", "small"), (1, "http://b", big), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "w")
    table = archive.write_archive(pages, path)
    got = archive.read_archive(spark, path, table=table).collect()
    assert sorted(map(str, got)) == sorted(map(str, archive.read_archive(spark, path).collect()))
    assert len(got) == len(rows) and all(r["verified"] for r in got)
    for r in got:
        raw = dict((i, h) for i, _, h in rows)[r["page_id"]] or ""
        body = bytes(r["record"]).split(b"\r\n\r\n", 1)[1][:-4].decode()
        assert body == ("" if r["record_type"] == "revisit" else raw) and r["payload_digest"] == hashlib.sha256(raw.encode()).hexdigest()
        first = {big: 1, huge: 20}.get(raw)
        again = first is not None and r["page_id"] != first
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if again else ("response", None))
    assert spark.read.parquet(path + "/payloads").count() == 4
    archive.export_warc(spark, path, str(tmp_path / "out"))
    blobs = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    assert sorted(archive.parse_warc(blobs)) == sorted((bytes(r["record"]).split(b"\r\n\r\n", 1)[0].decode(), bytes(r["record"]).split(b"\r\n\r\n", 1)[1][:-4]) for r in got)
    assert archive.read_warc(spark, str(tmp_path / "out")).count() == len(rows)
    archive.write_archive(pages.limit(0), str(tmp_path / "none"))
    assert archive.read_archive(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_fuse_filters(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    f = fuse.build(keys)
    assert fuse.contains(f, keys).all()
    assert fuse.contains(f, rng.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64)).mean() < 1e-3


def test_exact_dedup(docs, no_docs):
    got = exact_dedup.dedup(docs).collect()
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[(t or "").translate(LOWER)].append(i)
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        key = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in groups[t])
        ids = [i for i in groups[key] if i is not None]
        assert r["group_size"] == len(groups[key]) and r["keep_id"] == (max(ids) if ids else None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    kept = exact_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(no_docs).count() == 0 and exact_dedup.keep_documents(no_docs).count() == 0


def test_digests_that_lie_are_caught(spark):
    a, b = spark.createDataFrame([(1, "one")], "doc_id long, text string"), spark.createDataFrame([(2, "two")], "doc_id long, text string")
    lie = lambda df: exact_dedup.digests(df).withColumn("n_bytes", F.lit(3).cast("long"))
    same = lie(a).select("doc_id", "sha", "n_bytes")
    snapshot = exact_dedup.build_snapshot(same, a, 1)
    assert exact_dedup.classes(lie(b), b, snapshot).count() == 2
    assert exact_dedup.classes(lie(a), a, snapshot).first()["n_rows"] == 2


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("small", [32, 3])
def test_near_dedup(spark, docs, no_docs, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = np.random.default_rng(5)
    rows = [(i, t) for i, t, *_ in ROWS]
    base = [f"v{k}" for k in rng.integers(0, 500, 120)]
    for i in range(60):
        own = list(base)
        for k in rng.integers(0, 120, int(rng.integers(1, 9))):
            own[k] = f"n{rng.integers(0, 10**6)}"
        rows.append((100 + i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit(0))
    sets, root = brute_components([t for _, t in rows])
    members = collections.defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        members[r].append(i)
    want = collections.Counter()
    for (i, _), s, r in zip(rows, sets, root, strict=True):
        ids = [x for x in members[r] if x is not None]
        c = i if not s else (min(ids) if ids else None)
        want[(i, len(s), c, i == c)] += 1
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == want
    assert near_dedup.near_duplicates(no_docs).count() == 0
    kept = near_dedup.keep_documents(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, c, k in want if k}


def test_block_products_match_sets():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 25)) for _ in range(9)]
    got = near_dedup.shared_counts(sets[:4], sets[4:], chunk=7)
    assert [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]] == got.astype(int).tolist()


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:3000])
    ra, rb, rab = sketch.registers([a, b, np.union1d(a, b)])
    assert (sketch.merge(ra, rb) == rab).all()
    assert abs(sketch.similarity(ra[None], rb[None], np.array([2000.0]), np.array([2500.0]))[0] - 0.5) < 0.15
    assert (sketch.word_hashes(b"A b\tc") == sketch.word_hashes(b"a  B\x0bc ")).all()
    long = b" ".join(b"w%d" % i for i in range(90_000))
    assert len(np.unique(sketch.word_hashes(long))) == 90_000 and len(sketch.word_hashes(b"x" * 600_000)) == 1


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("x", "y"), ("x", "x")], "u string, v string")
    got = {r["u"]: r["root"] for r in components.components(links).collect()}
    assert got == {**{f"{i:03d}": "000" for i in range(n + 1)}, "x": "x", "y": "x"}


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 200, 5000).astype(np.uint16)
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 8).to_bytes())
    assert (m.decode() == ids).all() and (m.access(np.arange(5000)) == ids).all()
    for t in (0, 7, 199, 250, 300):
        where = np.flatnonzero(ids == t)
        assert (m.positions(t) == where).all() and m.rank(t) == len(where) and m.rank(t, 1234) == (where < 1234).sum()
        assert [m.select(t, k) for k in range(3)] == [*where[:3].tolist(), -1, -1, -1][:3]
    assert len(wavelet.WaveletMatrix.build(ids[:0], 8).decode()) == 0


def test_token_shards(spark, docs, no_docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    out = str(tmp_path / "shards")
    token_ids.write_shards(docs, path, out, shard_tokens=64)
    t = Tokenizer.from_file(path)
    start, want = 0, []
    encoded = [(i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in ROWS]
    for i, ids in sorted(encoded, key=lambda p: (p[0] is not None, p[0] or 0, len(p[1]))):
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_ids.read_documents(spark, out, path).collect()), key=lambda r: r[1]) == want
    whole = np.concatenate([ids for _, ids in sorted(encoded, key=lambda p: (p[0] is not None, p[0] or 0, len(p[1])))])
    cat = t.encode("cat", add_special_tokens=False).ids[0]
    assert sorted(r["position"] for r in token_ids.occurrences(spark, out, cat).collect()) == np.flatnonzero(whole == cat).tolist()
    assert {r["token"]: r["n"] for r in token_ids.counts(spark, out, [cat, 2]).collect()} == {cat: (whole == cat).sum(), 2: len(ROWS)}
    token_ids.write_shards(no_docs, path, str(tmp_path / "none"))
    assert token_ids.read_documents(spark, str(tmp_path / "none"), path).count() == 0


def test_sentence_pieces(docs, no_docs):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentence_pieces.encode_documents(docs, path, block_bytes=3000)
    want = sorted((str(i), m.encode(t or "")) for i, t, *_ in ROWS)
    rows = got.collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == want and all(r["round_trip"] for r in rows)
    texts = sorted(t or "" for _, t, *_ in ROWS)
    assert sorted(r["decoded"] for r in sentence_pieces.decode(got, path).collect()) == texts
    assert sentence_pieces.encode_documents(no_docs, path).count() == 0


def test_viterbi_of_a_unigram_model(spark):
    pieces = sentence_pieces.Pieces("", False, ["▁", "a", "b", "ab", "▁a", "bb"], [0, 1, 2, 3, 4, 5], [-3.0, -2.0, -2.5, -1.0, -2.2, -4.0], [], None, 9)
    ids = {r["word"]: r["ids"] for r in sentence_pieces.encode_words(spark.createDataFrame([("▁ab", 1), ("▁abb", 1), ("▁c", 1)], "word string, part int"), pieces).collect()}
    assert ids == {"▁ab": [0, 3], "▁abb": [4, 5], "▁c": [0, 9]}


def test_language_model(spark, docs, no_docs):
    got = {(r["doc_id"], r["n_words"]): r["log_score"] for r in language_model.score_documents(docs).collect()}
    assert language_model.score_documents(docs).count() == len(ROWS) and language_model.score_documents(no_docs).count() == 0
    seqs = [(i, ["<s>", *words(t), "</s>"] if words(t) else []) for i, t, *_ in ROWS]
    one, two, n = collections.Counter(), collections.Counter(), 0
    for _, s in seqs:
        one.update(s)
        two.update(zip(s, s[1:], strict=False))
        n += max(len(s) - 1, 0)
    for i, s in seqs:
        want = sum(math.log(two[v, w] / one[v]) if two[v, w] >= 2 else math.log(0.4 * one[w] / n) for v, w in zip(s, s[1:], strict=False)) if s else None
        found = got[i, max(len(s) - 1, 0)]
        assert (found is None and want is None) or math.isclose(found, want)


def test_frequent_words_and_bigrams_change_no_score(spark, docs, monkeypatch):
    before = sorted(map(str, language_model.score_documents(docs).select("doc_id", F.round("log_score", 6)).collect()))
    monkeypatch.setattr(language_model, "HOT_WORDS", 5)
    monkeypatch.setattr(language_model, "AT_ONCE", 100)
    assert sorted(map(str, language_model.score_documents(docs).select("doc_id", F.round("log_score", 6)).collect())) == before


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2050, [float("inf")] * 6), (None, rows[0][1]), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("q", F.lit(1))
    ok = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    old = inner_products.BLOCK
    try:
        for inner_products.BLOCK in (37, old):
            assert set(map(tuple, inner_products.top_k(df.select("vec_id", "embedding")).collect())) == want
    finally:
        inner_products.BLOCK = old
    assert inner_products.top_k(df.limit(0)).count() == 0


def test_boosting_and_calibration():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    trees = boosting.fit(x[:600], y[:600])
    s = boosting.raw_scores(trees, x[600:])
    assert ((s > 0) == y[600:]).mean() > 0.95 and len(boosting.raw_scores(trees, x[:0])) == 0
    at, p = boosting.isotonic(s, y[600:])
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_toxicity(spark, docs, no_docs):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = [f"w{k}" for k in rng.integers(0, 400, 40)]
        if bad:
            text[int(rng.integers(0, 40))] = ["grobian", "Grobians", "lump"][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_documents(df, lab).filter("held_out").join(lab.filter("toxic is not null"), "doc_id").collect()
    assert len(got) > 150 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    odd = toxicity.score_documents(docs.select("doc_id", "text"), lab.limit(0))
    assert odd.count() == len(ROWS) and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(no_docs, lab).count() == 0
    assert toxicity.reject(docs, lab.limit(0)).columns == docs.columns


def test_language_id(spark, no_docs):
    rng = np.random.default_rng(8)
    parts = {"aa": ["ba", "bo", "bi", "lo"], "bb": ["ke", "ku", "tse", "zu"], "cc": ["ñu", "ró", "sé", "mi"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(20)), lang) for i in range(600) for lang in [["aa", "bb", "cc"][i % 3]]]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 + 3 = %", "bb"), (1003, "babo " * 30_000, None), (None, "bobiba lobabo", "aa")]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(got[i]["lang_pred"], lang) for i, t, lang in rows[:600] if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(no_docs).count() == 0
    alone = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.predict(alone).first()["lang_pred"] == "und"


def test_pipeline(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
        if k < 3:
            assert docs.count() == docs.join(before.select("doc_id"), "doc_id", "left_semi").count() <= before.count()
    assert seen[1] >= 0.7 * seen[0] and docs.filter("not round_trip").count() == 0
