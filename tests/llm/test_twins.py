"""Plain-Python twins of the two classifiers, and what must not reach their scores."""

import math
import zlib

import numpy as np

from contractlake.llm import boosting, language_id, toxicity


def grams_by_loop(raw: bytes) -> list[int]:
    text = b" " + b" ".join(x for x in raw.translate(language_id._LOWER).split(b" ") if x) + b" "
    out = []
    for i in range(len(text) - 2):
        out.append(int.from_bytes(text[i : i + 3], "little") * int(language_id.GRAM_3) % 2**32 >> 17)
    for i in range(len(text) - 3):
        four = int.from_bytes(text[i : i + 4], "little")
        out.append((four ^ four >> 15) * int(language_id.GRAM_4) % 2**32 >> 17)
    return out if len(text) > 2 else []


def test_language_twin():
    rng = np.random.default_rng(1)
    model = language_id.Model(["a", "b", "c"], rng.normal(size=(language_id.BUCKETS, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32), 1.7, 0.5)
    for text in ("Hello  World", "\tÜber\n中文 x", "a", "it's 12%", "longer text of many words " * 50):
        grams = grams_by_loop(text.encode())
        z = [1.7 * (sum(float(model.logits[g, k]) for g in grams) / len(grams) + float(model.bias[k])) for k in range(3)]
        top = max(z)
        p = [math.exp(x - top) for x in z]
        got = language_id.classify(model, text)
        assert got[0] == "abc"[p.index(max(p))] and math.isclose(got[1], max(p) / sum(p), rel_tol=1e-5)
    tied = language_id.Model(["a", "b"], np.zeros((language_id.BUCKETS, 2), np.float32), np.zeros(2, np.float32), 1.0, 0.0)
    assert language_id.classify(tied, "xyz") == ("a", 0.5)  # ties go to the first language


def score_by_loop(trees, knots, x):
    total = trees.base
    for feature, limit, leaf in zip(trees.feature.tolist(), trees.limit.tolist(), trees.leaf.tolist()):
        at = 0
        while at < len(feature):
            at = 2 * at + (2 if x[feature[at]] > limit[at] else 1)
        total += leaf[at - len(feature)]
    at, p = knots[0].tolist(), knots[1].tolist()
    if total <= at[0]:
        return p[0]
    for i in range(1, len(at)):
        if total <= at[i]:
            return p[i - 1] + (p[i] - p[i - 1]) * (total - at[i - 1]) / (at[i] - at[i - 1])
    return p[-1]


def test_toxicity_twin():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0.4).astype(float)
    trees = boosting.fit(x, y, rounds=20)
    knots = boosting.isotonic(boosting.raw_scores(trees, x), y)
    got = np.interp(boosting.raw_scores(trees, x), *knots)
    assert np.allclose(got, [score_by_loop(trees, knots, r) for r in x.tolist()])
    assert (np.diff(knots[1]) >= 0).all()


def test_features_twin():
    one = toxicity.Featurizer({b"grob": 2.0, b"lump*": 3.0})
    text = "You GROB lumpen, YOU!! are x1y du g.r.o.b fine?"
    words = ["you", "grob", "lumpen", "you", "are", "x", "y", "du", "g", "r", "o", "b", "fine"]
    f = one(text.encode())
    hits = {"grob": 2.0, "lumpen": 3.0}
    you = [i for i, w in enumerate(words) if w in ("you", "du")]
    near = sum(min(abs(i - j) for j in you) <= toxicity.NEAR for i, w in enumerate(words) if w in hits)
    assert np.allclose(f[:8], [math.log1p(13), 2, math.log1p(2), 2 / 13, 5 / 13, 5.0, 3.0, 2])
    assert np.allclose(f[11:14], [3 / 13, near, near / 13]) and np.allclose(f[16:18], [2 / 13, 1 / 13])
    assert len(one(b"")) == toxicity.N_FEATURES and not any(one(b""))


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_held_out_labels_source_and_order_change_no_score(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 60, 20)) + (" grobian" if i % 5 == 0 else ""), ["aa", "bb"][i % 2], f"s{i % 3}") for i in range(240)]
    schema = "doc_id long, text string, lang string, source string, score string, held_out int"
    one = spark.createDataFrame([(*r, "clash", 1) for r in rows], schema)
    changed = [(i, t, "zz" if held(i, 3, 1) else lang, "other", "x", 2) for i, t, lang, _ in reversed(rows)]
    two = spark.createDataFrame(changed, schema).repartition(5)
    assert sorted(map(str, language_id.predict(one).collect())) == sorted(map(str, language_id.predict(two).collect()))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, int(i % 5 != 0) if held(i, 4, 2) else int(i % 5 == 0)) for i, *_ in reversed(rows)], "doc_id long, toxic int")
    assert sorted(map(str, toxicity.score_documents(one, labels).collect())) == sorted(map(str, toxicity.score_documents(two, turned).collect()))
    twice = toxicity.score_documents(one.union(one), labels)
    assert twice.count() == 480 and twice.groupBy("doc_id").agg({"score": "min"}).count() == 240
