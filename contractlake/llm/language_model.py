"""Stupid-backoff scores (Brants et al., 2007) of documents under the bigrams of the corpus itself.

S(w | v) = c(v w) / c(v) if c(v w) >= `MIN_COUNT`, else `BACKOFF` * c(w) / N. Words are runs of
characters other than ASCII blanks, A-Z lower-cased; each document starts with a start sign and
ends with an end sign, which count as words. N counts words and end signs.

Counts cover all documents. Words are counted first; the most frequent ones (a documented number)
get short codes that every task knows. Bigrams are exploded to tables partitioned by hash: a bigram
of two frequent words is five bytes, others are two word hashes, partitioned by the first word if
that is rare, so that its own count is at hand there. A partition counts its bigrams and scores
them in one go; rare words that need backing off are joined with the word counts; all is summed by
document. Bigrams that are very frequent in a sample are counted with the words, and scored where
they stand, so that none of them gathers in one partition; which ones these are changes no score.
The frequent words are those at or above a count that a histogram of the counts names, so no more
than their documented number ever leaves the tasks.

Null texts and texts without words have no score and count 0 words. Repeated rows count as often
as they occur, and each gets its text's score. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contractlake.llm import sketch
from contractlake.llm.common import stage

MIN_COUNT, BACKOFF = 2, 0.4
#: Words with short codes (18 bits, 0 and 1 are the signs); positions a partition is sized for; positions handled at once.
HOT_WORDS, PER_PARTITION, AT_ONCE = (1 << 18) - 2, 4_000_000, 1 << 19
#: Documents (about) in which very frequent bigrams are looked for, and how many are kept; steps of the histogram an octave.
SAMPLE_DOCS, HOT_BIGRAMS, STEPS = 400, 512, 16
_START, _END, _RARE = np.uint64(0), np.uint64(1), np.uint64(1 << 63)
_MUL_V, _MUL_W = sketch.WEIGHTS[2], sketch.WEIGHTS[3]


def _pair_hash(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sketch._mixed(v * _MUL_V + w * _MUL_W)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _framed(raw: bytes) -> np.ndarray:
    """Hashes of the words between the signs; empty if there are no words. Word hashes have the top bit set, signs have not."""
    words = sketch.word_hashes(raw)
    return np.concatenate([[_START], words | _RARE, [_END]]) if len(words) else np.zeros(0, np.uint64)


def _found(sorted_keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x stands among the keys, and whether it is one."""
    if not len(sorted_keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return at, sorted_keys[at] == x


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def row_key(docs: DataFrame) -> tuple[Column, int]:
    """(a 64-bit key that different rows of (doc_id, text) never share and equal rows do, number of rows).

    Rows that share a hash, as a second hash shows, take that of another seed, and all is looked at again. Of n rows
    about n^2 / 2^65 do (three of 10^10), so the list of their hashes in the driver stays short.
    """
    key, seed = _hash(0), 0
    while True:
        seen = docs.select(key.alias("fp"), _hash(-1).alias("other")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"), (F.min("other") != F.max("other")).alias("clash"))
        found = seen.agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("clash"), F.col("fp"))).alias("shared")).first()
        if not found["shared"]:
            return key, found["n"] or 0
        seed += 1
        key = F.when(key.isin(found["shared"]), _hash(seed)).otherwise(key)


def _texts(docs: DataFrame, key: Column | None = None) -> DataFrame:
    return docs.select((F.lit(0) if key is None else key).cast("long").alias("fp"), F.col("text").cast("binary").alias("raw"))


def count_table(docs: DataFrame, pairs: np.ndarray | None) -> DataFrame:
    """key, pair, n: occurrences of each word (signs included), and of the bigrams among the hashes `pairs` (None: all bigrams)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list[np.ndarray], pair: bool) -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(np.full(len(keys), pair)), pa.array(n)], names=["key", "pair", "n"])

        words, bigrams, size = [], [], 0
        for batch in batches:
            for x in batch.column(1):
                seq = _framed(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64)
                if not len(seq):
                    continue
                words.append(seq)
                hashes = _pair_hash(seq[:-1], seq[1:])
                bigrams.append(hashes if pairs is None else hashes[_found(pairs, hashes)[1]])
                size += len(seq)
                if size > 4 * AT_ONCE:
                    yield rows(words, False)
                    yield rows(bigrams, True)
                    words, bigrams, size = [], [], 0
        yield rows(words, False)
        yield rows(bigrams, True)

    return _texts(docs).mapInArrow(count, "key long, pair boolean, n long").groupBy("key", "pair").agg(F.sum("n").alias("n"))


def _exploded(docs: DataFrame, key: Column, hot: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, total: float, parts: int) -> DataFrame:
    """part, fps, n_a, n_b, a, b, sums, known: bigrams of a batch of documents that belong to one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(seqs: list[np.ndarray], fps: list[int]) -> Iterator[pa.RecordBatch]:
            own = np.repeat(np.arange(len(seqs)), [len(s) - 1 for s in seqs])
            v, w = np.concatenate([s[:-1] for s in seqs]), np.concatenate([s[1:] for s in seqs])
            fp = np.array(fps, np.int64)
            sums, known = np.zeros(len(fp)), np.zeros(len(fp), np.int64)

            def coded(x: np.ndarray) -> np.ndarray:
                at, is_hot = _found(hot, x)
                return np.where(x < _RARE, x, np.where(is_hot, (at + 2).astype(np.uint64), x))

            cv, cw = coded(v), coded(w)
            at, often = _found(pairs, _pair_hash(v, w))
            often &= (cv < _RARE) & (cw < _RARE)
            if often.any():
                n = pair_counts[at[often]]
                context, word = counts[cv[often].astype(np.int64)], counts[cw[often].astype(np.int64)]
                s = np.where(n >= MIN_COUNT, np.log(n / context), np.log(BACKOFF * word / total))
                sums += np.bincount(own[often], s, len(fp))
                known += np.bincount(own[often], minlength=len(fp))
                cv, cw, own = cv[~often], cw[~often], own[~often]
            short = (cv < _RARE) & (cw < _RARE)
            code = np.where(short, cv << np.uint64(18) | cw, np.uint64(0))
            mixed = np.where(short, sketch._mixed(code), np.where(cv < _RARE, _pair_hash(cv, cw), sketch._mixed(cv)))
            part = (mixed >> np.uint64(20)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            part, own, short, code, cv, cw = (x[order] for x in (part, own, short, code, cv, cw))
            present, starts = np.unique(part, return_index=True)
            if not len(present):
                present, starts = np.zeros(1, np.uint64), np.zeros(1, np.int64)
            cut = np.append(starts, len(part))
            out = []
            for turn, p in enumerate(present.tolist()):  # the first row holds all documents and what is known of them
                k = slice(cut[turn], cut[turn + 1])
                o, is_a = own[k], short[k]
                ids = np.unique(o) if turn else np.arange(len(fp))
                n_a, n_b = (np.bincount(o[m], minlength=len(fp))[ids].astype("<u4") for m in (is_a, ~is_a))
                a = code[k][is_a].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                b = np.stack([cv[k][~is_a], cw[k][~is_a]], axis=1).astype("<u8").tobytes()
                extra = (sums.tobytes(), known.tobytes()) if not turn else (b"", b"")
                out.append((p, fp[ids].tobytes(), n_a.tobytes(), n_b.tobytes(), a, b, *extra))
            names = ["part", "fps", "n_a", "n_b", "a", "b", "sums", "known"]
            kinds = [pa.int32(), *[pa.binary()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        seqs, fps, size = [], [], 0
        for batch in batches:
            for fp, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seq = _framed(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64)
                for i in range(0, len(seq) - 1, AT_ONCE):  # a very long text in stretches that share one word
                    seqs.append(seq[i : i + AT_ONCE + 1])
                    fps.append(fp)
                    size += len(seqs[-1])
                    if size >= AT_ONCE:
                        yield from flush(seqs, fps)
                        seqs, fps, size = [], [], 0
        if seqs:
            yield from flush(seqs, fps)

    return _texts(docs, key).mapInArrow(run, "part int, fps binary, n_a binary, n_b binary, a binary, b binary, sums binary, known binary")


def _partial(rows: DataFrame, counts: np.ndarray, total: float) -> DataFrame:
    """fp, score, n, word: sums of each partition by document; with `word` set, a rare word whose count is still to be added."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        join = lambda name, kind: np.frombuffer(b"".join(group[name]), kind)
        fps, n_a, n_b = join("fps", "<i8"), join("n_a", "<u4"), join("n_b", "<u4")
        score, n = np.zeros(len(fps)), (n_a + n_b).astype(np.int64)
        at = 0
        for fp_bytes, sums, known in zip(group["fps"], group["sums"], group["known"], strict=True):
            if sums:
                k = slice(at, at + len(sums) // 8)
                score[k] += np.frombuffer(sums)
                n[k] += np.frombuffer(known, np.int64)
            at += len(fp_bytes) // 8
        five = np.frombuffer(b"".join(group["a"]), np.uint8).reshape(-1, 5)
        code = np.zeros((len(five), 8), np.uint8)
        code[:, :5] = five
        code = code.view("<u8").ravel()
        if len(code):
            keys, inverse, c = np.unique(code, return_inverse=True, return_counts=True)
            v, w = (keys >> np.uint64(18)).astype(np.int64), (keys & np.uint64(2**18 - 1)).astype(np.int64)
            s = np.where(c >= MIN_COUNT, np.log(c / counts[v]), np.log(BACKOFF * counts[w] / total))[inverse]
            score += np.bincount(np.repeat(np.arange(len(fps)), n_a), s, len(fps))
        words = np.zeros(0, np.uint64)
        owners = np.zeros(0, np.int64)
        both = np.frombuffer(b"".join(group["b"]), "<u8").reshape(-1, 2)
        if len(both):
            v, w = both[:, 0], both[:, 1]
            own = np.repeat(np.arange(len(fps)), n_b)
            _, inverse, c = np.unique(_pair_hash(v, w), return_inverse=True, return_counts=True)
            seen = c[inverse]
            context = np.zeros(len(v))
            rare_v = v >= _RARE
            context[~rare_v] = counts[v[~rare_v].astype(np.int64)]
            if rare_v.any():
                _, inv, c = np.unique(v[rare_v], return_inverse=True, return_counts=True)
                context[rare_v] = c[inv]  # every occurrence of a rare first word is here
            rare_w = w >= _RARE
            known = np.ones(len(w))
            known[~rare_w] = counts[w[~rare_w].astype(np.int64)]
            s = np.where(seen >= MIN_COUNT, np.log(seen / context), np.log(BACKOFF * known / total))
            score += np.bincount(own, s, len(fps))
            ask = rare_w & (seen < MIN_COUNT)
            words, owners = w[ask], fps[own[ask]]
        out = pd.DataFrame({"fp": fps, "score": score, "n": n}).groupby("fp", as_index=False, sort=False).sum()
        out["word"] = pd.array([pd.NA] * len(out), "Int64")
        more = pd.DataFrame({"fp": owners, "score": 0.0, "n": 0, "word": pd.array(_signed(words.copy()), "Int64")})
        return pd.concat([out, more]) if len(more) else out

    return rows.groupBy("part").applyInPandas(run, "fp long, score double, n long, word long")


def least_count(words: DataFrame, most: int) -> int:
    """The least count, by steps of a histogram, that at most `most` of the rows (n) reach; the driver sees one row a step."""
    step = F.floor(F.log2(F.col("n").cast("double")) * STEPS).cast("int").alias("step")
    left = most
    for r in words.groupBy(step).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"), F.max("n").alias("greatest")).orderBy(F.desc("step")).collect():
        left -= r["rows"]
        if left < 0:
            return r["greatest"] + 1
    return 1


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words (with the end sign), log_score, mean_log_score for every row of `docs` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    key, n_rows = row_key(docs)
    sample = docs.sample(min(1.0, SAMPLE_DOCS / max(n_rows, 1)), seed=5)
    often = count_table(sample, None).filter("pair and n >= 20").orderBy(F.desc("n"), "key").limit(HOT_BIGRAMS).select("key")
    pairs = np.sort(np.array([r["key"] for r in often.collect()], np.int64).view(np.uint64))
    table = stage(count_table(docs, pairs), "lm-counts")
    total = table.filter(f"not pair and key <> {int(_START)}").agg(F.sum("n")).first()[0] or 0
    words = table.filter("not pair and key < 0")
    frequent = words.filter(F.col("n") >= least_count(words, HOT_WORDS)).select("key", "n").toPandas()
    keys = frequent["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    hot = keys[order]
    ends = table.filter(f"not pair and key = {int(_END)}").agg(F.sum("n")).first()[0] or 0
    counts = np.concatenate([[float(ends), float(ends)], frequent["n"].to_numpy(float)[order]])
    known = {r["key"]: r["n"] for r in table.filter("pair").collect()}  # at most HOT_BIGRAMS rows
    pair_counts = np.array([known.get(int(k), 0) for k in _signed(pairs)], float)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2, -(-int(total) // PER_PARTITION), 1)
    rows = _exploded(docs, key, hot, counts, pairs, pair_counts, float(total or 1), parts)
    partial = _partial(rows, counts, float(total or 1))
    words = table.filter("not pair").select(F.col("key").alias("known_word"), F.col("n").alias("known_n"))
    # Rows without a word take their own key, which spreads them; only rows with one may match.
    asked = partial.withColumn("spread", F.coalesce("word", "fp"))
    joined = asked.join(words, (F.col("spread") == F.col("known_word")) & F.col("word").isNotNull(), "left")
    added = F.col("score") + F.when(F.col("word").isNotNull(), F.log(F.col("known_n").cast("double"))).otherwise(0.0)
    scores = joined.groupBy("fp").agg(F.sum(added).alias("total"), F.sum("n").alias("words"))
    keyed = docs.select("doc_id", key.alias("row_fp"))
    times = keyed.groupBy("doc_id", "row_fp").agg(F.count(F.lit(1)).alias("times"))
    out = times.join(scores, F.col("row_fp") == F.col("fp"), "left")
    share = out.select(
        F.explode(F.expr("array_repeat(doc_id, cast(times as int))")).alias("doc_id"),
        F.coalesce((F.col("words") / F.col("times")).cast("long"), F.lit(0)).alias("n_words"),
        (F.col("total") / F.col("times")).alias("log_score"),
    )
    return share.withColumn("mean_log_score", F.try_divide("log_score", "n_words"))
