"""Phrase collocations: phrases of two to four words that occur together far oftener than apart.

Texts are lower-cased (A-Z), split into pieces at `.,;:!?` and line ends, pieces into words at blanks and
tabs. Words that reach `LEAST` occurrences are ranked by frequency within their language. Ranks are cut into
bands of about equal mass, so that each pair of bands, a tile, gets about as many pairs of adjacent words. A
task counts the pairs of a stretch of text by tile and sends each tile's cells on, packed; a tile's cells are
summed by direct address (numpy bincount) where the tile has few cells, else as sorted coordinates (COO). Pairs
that reach `LEAST` are ranked in turn, and two of them that overlap in a word make three words, two of
those four: the same count, level by level.

At most `RANKED` units of a level have ranks, the most frequent ones: those tables are sent to every task. Where
there are more frequent ones, pairs with an unranked unit are counted by their hashes as sorted coordinates that
Spark sums, so no pair is lost. Word hashes are checked against the words; if two frequent words ever shared
one, the next of `POWERS` is taken. Two-, three- and four-word units are compared by both halves, of ranked ones.

Null languages count as `und`, null texts as empty; repeated rows count as often as they occur. Words and phrases
below `LEAST` never score. Empty tables, and tables without frequent pairs, give empty results. Ties in score and
frequency are ordered by the phrase. Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contractlake.llm.common import stage
from contractlake.llm.language_model import least_count

#: Occurrences a phrase needs, words it may have, rows reported a language; share (percent) of a longer phrase that absorbs a shorter one.
LEAST, WORDS, TOP, ABSORBED = 30, 4, 2_000, 80
#: Units of a level with ranks; pairs a tile is sized for; cells up to which a tile is counted by direct address.
RANKED, PER_TILE, DENSE = 1 << 19, 2_000_000, 1 << 21
#: Bytes of text that are tokenised at once; pairs, and distinct words, that a task gathers before it sends them on.
STRETCH, GATHERED, GATHERED_WORDS = 1 << 20, 500_000, 100_000
#: Odd multipliers of the word hash, tried in turn, and of the hash of two neighbours.
POWERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_SPAN = 1 << 18
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + b"\n" * 10)


class Ranks(NamedTuple):
    """Ranked units of a level, by ascending key: halves (equal to the key for words), rank, band and language's first tile.

    `by_rank`: keys by language and rank; `starts`: where a language's ranks begin there; `cuts`: of each language the first rank of each band and
    the number of ranks; `whole`: no frequent unit is without a rank.
    """

    keys: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray
    band: np.ndarray
    lang: np.ndarray
    by_rank: np.ndarray
    starts: np.ndarray
    cuts: list[np.ndarray]
    langs: list[str]
    whole: bool


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The key of two overlapping or neighbouring units."""
    return _mixed(left * MIX[2] + right * MIX[3])


def _tables(power: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(_SPAN + 2, base & (2**64 - 1), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(power), powers(pow(power, -1, 2**64))


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a translated text, and the number of the piece that each is in."""
    codes = np.frombuffer(b"\n" + text + b"\n", np.uint8)
    inside = (codes != 32) & (codes != 10)
    edge = np.flatnonzero(np.diff(inside.view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.cumsum(codes == 10, dtype=np.int32)[starts]


def word_keys(text: bytes, starts: np.ndarray, ends: np.ndarray, lang: str, power: int) -> np.ndarray:
    """A 64-bit key of each word in its language."""
    up, down = _tables(power)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    out = np.zeros(len(starts), np.uint64)
    codes, i = np.frombuffer(text, np.uint8), 0
    while i < len(starts):  # as many words as lie in one span of the text
        j = int(np.searchsorted(ends, starts[i] + _SPAN, "right"))
        if j <= i:  # a word longer than a span
            out[i] = int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]], digest_size=8).digest(), "little")
            i += 1
            continue
        first, part = starts[i], codes[starts[i] : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return _mixed(out ^ salt)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language, translated and joined by line ends, a stretch at a time."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.setdefault(lang, []).append(raw)
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] >= STRETCH:
                yield lang, b"\n".join(held.pop(lang)).translate(_TABLE)
                del sizes[lang]
            elif len(held) > 64:  # many languages: none is kept waiting
                for k, parts in held.items():
                    yield k, b"\n".join(parts).translate(_TABLE)
                held, sizes = {}, {}
    for lang, parts in held.items():
        yield lang, b"\n".join(parts).translate(_TABLE)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw"))


def word_counts(docs: DataFrame, power: int) -> DataFrame:
    """lang, key, word, n of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, list]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                for at in range(0, len(found), 100_000):
                    some = list(islice(found.items(), at, at + 100_000))
                    keys = np.array([k for k, _ in some], np.uint64).view(np.int64)
                    columns = [pa.array([lang] * len(some)), pa.array(keys), pa.array([x[0] for _, x in some], pa.binary()), pa.array([x[1] for _, x in some], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "key", "word", "n"])
            held.clear()

        for lang, text in _stretches(batches):
            starts, ends, _ = split_words(text)
            keys, first, n = np.unique(word_keys(text, starts, ends, lang, power), return_index=True, return_counts=True)
            found = held.setdefault(lang, {})
            before = len(found)
            for key, s, e, k in zip(keys.tolist(), starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                if (x := found.get(key)) is None:
                    found[key] = [text[s:e], k]
                else:
                    x[1] += k
            size += len(found) - before
            if size >= GATHERED_WORDS:
                yield from flush()
                size = 0
        yield from flush()

    counted = _rows(docs).mapInArrow(count, "lang string, key long, word binary, n long")
    return counted.groupBy("lang", "key", "word").agg(F.sum("n").alias("n"))


def rank(units: DataFrame, most: int) -> Ranks:
    """The ranks of the most frequent rows (lang, key, left, right, n), at most `most` of them: their number bounds what the driver and the tasks hold."""
    least = least_count(units, most)
    # Collected as Arrow columns: as Python rows, half a million of them take several hundred bytes each.
    rows = units.filter(F.col("n") >= least).select("lang", "key", "left", "right", "n").toArrow()
    named = rows.column("lang").combine_chunks().dictionary_encode()
    langs = sorted(named.dictionary.to_pylist())
    place = np.array([langs.index(x) for x in named.dictionary.to_pylist()], np.int32)
    codes = place[named.indices.to_numpy(zero_copy_only=False)]
    n, keys, left, right = (rows.column(c).to_numpy() for c in ("n", "key", "left", "right"))
    del rows, named
    order = np.lexsort((keys, -n, codes))
    codes, n = codes[order], n[order]
    keys, left, right = (x[order].view(np.uint64) for x in (keys, left, right))
    cuts, starts, bands, ranks = [], [0], [], []
    for first, last in zip(np.searchsorted(codes, np.arange(len(langs))), np.searchsorted(codes, np.arange(len(langs)), "right"), strict=True):
        m = n[first:last].astype(float)
        g = max(1, int(np.ceil(np.sqrt(m.sum() / PER_TILE))))
        band = np.minimum((np.cumsum(m) - m) / m.sum() * g, g - 1).astype(np.int32)
        band = np.unique(band, return_inverse=True)[1].astype(np.int32)  # a word heavier than a band leaves some empty
        cuts.append(np.append(np.flatnonzero(np.diff(band, prepend=-1)), len(m)))
        starts.append(starts[-1] + len(m))
        bands.append(band)
        ranks.append(np.arange(len(m), dtype=np.int64))
    order = np.argsort(keys, kind="stable")
    flat = lambda parts, kind: np.concatenate(parts)[order] if parts else np.zeros(0, kind)
    return Ranks(
        keys[order], left[order], right[order], flat(ranks, np.int64), flat(bands, np.int32), codes[order],
        keys, np.array(starts), cuts, langs, least == 1 or units.filter(F.col("n") < least).isEmpty(),
    )


def _find(ranks: Ranks, keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Where each unit stands among the ranked ones; -1 if it does not."""
    if not len(ranks.keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(ranks.keys, keys), len(ranks.keys) - 1)
    return np.where((ranks.keys[at] == keys) & (ranks.left[at] == left) & (ranks.right[at] == right), at, -1)


def _units(text: bytes, lang: str, level: int, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and halves of the units of `level` words at each word, and whether one more word follows in the piece."""
    starts, ends, piece = split_words(text)
    keys = word_keys(text, starts, ends, lang, power)
    left = right = keys
    for _ in range(level - 1):
        left, right = keys[:-1], keys[1:]
        keys = joined(left, right)
    n = len(starts)
    follows = np.zeros(len(keys), bool)
    if n > level:
        follows[: n - level] = piece[: n - level] == piece[level:]
    return keys, left, right, follows


def _code_kind(cells: int) -> str:
    return "<u4" if cells <= 1 << 32 else "<i8"


def _tile(ranks: Ranks, bases: np.ndarray, tile: int) -> tuple[int, int, int, int, int]:
    """Language of a tile, first ranks and widths of its bands."""
    lang = int(np.searchsorted(bases, tile, "right")) - 1
    cuts = ranks.cuts[lang]
    i, j = divmod(tile - int(bases[lang]), len(cuts) - 1)
    return lang, int(cuts[i]), int(cuts[i + 1] - cuts[i]), int(cuts[j]), int(cuts[j + 1] - cuts[j])


def _bases(ranks: Ranks) -> np.ndarray:
    """Number of the first tile of each language."""
    return np.cumsum([0, *((len(c) - 1) ** 2 for c in ranks.cuts)]).astype(np.int64)


def pair_counts(docs: DataFrame, level: int, ranks: Ranks, power: int) -> DataFrame:
    """lang, key, left, right, n: frequent units of `level` + 1 words, as pairs of overlapping units of `level` words."""
    named = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = {"lang": pa.string(), "tile": pa.int64(), "codes": pa.binary(), "counts": pa.binary(), "left": pa.int64(), "right": pa.int64(), "n": pa.int64()}
    batch_of = lambda columns: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, fields.values(), strict=True)], names=list(fields))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = named.value
        bases, bands = _bases(ranks), np.array([len(c) - 1 for c in ranks.cuts])

        def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
            """One row a tile: its cells and their counts, packed."""
            tile = bases[ranks.lang[a]] + ranks.band[a].astype(np.int64) * bands[ranks.lang[a]] + ranks.band[b]
            order = np.argsort(tile, kind="stable")
            a, b, tile = a[order], b[order], tile[order]
            present, starts = np.unique(tile, return_index=True)
            out = []
            for t, s, e in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(tile)], strict=True):
                k, first, height, other, width = _tile(ranks, bases, t)
                codes, n = np.unique((ranks.rank[a[s:e]] - first) * width + ranks.rank[b[s:e]] - other, return_counts=True)
                packed = codes.astype(_code_kind(height * width)).tobytes()
                out.append((ranks.langs[k], t, packed, b"" if n.max() == 1 else n.astype("<u4").tobytes(), None, None, None))
                if len(out) >= 20_000:
                    yield batch_of(zip(*out, strict=True))
                    out = []
            if out:
                yield batch_of(zip(*out, strict=True))

        def coordinates(lang: str, both: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Pairs with an unranked unit, sorted, with their counts."""
            pairs, n = np.unique(both, axis=0, return_counts=True)
            pairs = pairs.view(np.int64)
            for i in range(0, len(pairs), 100_000):
                left, right = pairs[i : i + 100_000].T
                none = [None] * len(left)
                yield batch_of([[lang] * len(left), none, none, none, left, right, n[i : i + 100_000]])

        firsts, seconds, size = [], [], 0
        for lang, text in _stretches(batches):
            keys, left, right, follows = _units(text, lang, level, power)
            if len(keys) < 2:
                continue
            at, here = _find(ranks, keys, left, right), np.flatnonzero(follows[:-1])
            a, b = at[here], at[here + 1]
            both = (a >= 0) & (b >= 0)
            firsts.append(a[both].astype(np.int32))
            seconds.append(b[both].astype(np.int32))
            size += int(both.sum())
            if not ranks.whole and not both.all():
                rest = here[~both]
                yield from coordinates(lang, np.stack([keys[rest], keys[rest + 1]], axis=1))
            if size >= GATHERED:
                yield from tiles(np.concatenate(firsts), np.concatenate(seconds))
                firsts, seconds, size = [], [], 0
        if size:
            yield from tiles(np.concatenate(firsts), np.concatenate(seconds))

    def add(group: pd.DataFrame) -> pd.DataFrame:
        ranks = named.value
        lang, first, height, other, width = _tile(ranks, _bases(ranks), int(group["tile"].iloc[0]))
        kind = _code_kind(height * width)
        codes = np.frombuffer(b"".join(group["codes"]), kind).astype(np.int64)
        size = 4 if kind == "<u4" else 8
        n = np.concatenate([np.frombuffer(m, "<u4").astype(float) if m else np.ones(len(c) // size) for c, m in zip(group["codes"], group["counts"], strict=True)])
        if height * width <= DENSE:
            total = np.bincount(codes, n, height * width)
            found = np.flatnonzero(total >= LEAST)
            total = total[found]
        else:
            found, cell = np.unique(codes, return_inverse=True)
            total = np.bincount(cell, n)
            found, total = found[total >= LEAST], total[total >= LEAST]
        keys = ranks.by_rank[ranks.starts[lang] :].view(np.int64)
        return pd.DataFrame({"lang": ranks.langs[lang], "left": keys[first + found // width], "right": keys[other + found % width], "n": total.astype(np.int64)})

    sent = _rows(docs).mapInArrow(count, "lang string, tile long, codes binary, counts binary, left long, right long, n long")
    if not ranks.whole:
        sent = stage(sent, "phrase-cells")
    out = sent.filter("tile is not null").select("tile", "codes", "counts").groupBy("tile").applyInPandas(add, "lang string, left long, right long, n long")
    if not ranks.whole:
        rest = sent.filter("tile is null").groupBy("lang", "left", "right").agg(F.sum("n").alias("n"))
        out = out.unionByName(rest.filter(F.col("n") >= LEAST))

    @F.pandas_udf("long")
    def key_of(left: pd.Series, right: pd.Series) -> pd.Series:
        both = (x.to_numpy(np.int64).view(np.uint64) for x in (left, right))
        return pd.Series(joined(*both).view(np.int64))

    out = stage(out.select("lang", key_of("left", "right").alias("key"), "left", "right", "n"), f"phrases-{level + 1}")
    named.destroy()
    return out


def _shared_key(words: DataFrame) -> bool:
    """Whether a frequent word shares its key with another word."""
    by_key = words.groupBy("key").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n"))
    return not by_key.filter((F.col("words") > 1) & (F.col("n") >= LEAST)).isEmpty()


def phrase_levels(docs: DataFrame, ranked: int = RANKED) -> tuple[DataFrame, list[DataFrame]]:
    """All words (lang, key, word, n), and for two to four words the frequent units (lang, key, left, right, n)."""
    for power in POWERS:
        words = stage(word_counts(docs, power), "phrase-words")
        if not _shared_key(words):
            break
    else:
        raise ValueError("frequent words share their hash under every multiplier: add one to POWERS")
    units, levels = words.filter(F.col("n") >= LEAST).select("lang", "key", F.col("key").alias("left"), F.col("key").alias("right"), "n"), []
    for level in range(1, WORDS):
        units = pair_counts(docs, level, rank(units, ranked), power)
        levels.append(units)
    return words, levels


def _scored(df: DataFrame, size: int, longer: list[tuple[DataFrame, str]]) -> DataFrame:
    """lang, phrase, a, l, r, score of the units that no longer one absorbs; `longer`: tables with the key of a unit inside, and that key's column.

    Products of counts are decimals: they may pass 64 bits.
    """
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"(cast(a as decimal(20, 0)) * cast(2000000 as decimal(7, 0))) div (cast(l{k} as decimal(20, 0)) + cast(r{k} as decimal(20, 0)))")
    cuts = [F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    lowest = F.array_min(F.array(*cuts))
    out = df.select("lang", "key", F.concat_ws(" ", *(f"w{i}" for i in range(1, size + 1))).alias("phrase"), "a", lowest.alias("cut"))
    if longer:
        most = reduce(DataFrame.unionAll, [x.select(F.col(c).alias("key"), "a") for x, c in longer]).groupBy("key").agg(F.max("a").alias("longest"))
        out = out.join(most, "key", "left").filter(F.col("longest").isNull() | (wide("longest") * 100 < wide("a") * ABSORBED))
    return out.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, ranked: int = RANKED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first `TOP` phrases of each language of `docs` (lang, text)."""
    words, (pairs, threes, fours) = phrase_levels(docs.select("lang", "text"), ranked)
    frequent = words.filter(F.col("n") >= LEAST).select("key", F.col("word").cast("string").alias("word"), "n")
    side = lambda df, name, **columns: df.select(F.col("key").alias(name), *(F.col(c).alias(x) for x, c in columns.items()))
    units = lambda df: df.select("lang", "key", "left", "right", F.col("n").alias("a"))
    two = units(pairs).join(side(frequent, "left", w1="word", l1="n"), "left").join(side(frequent, "right", w2="word", r1="n"), "right")
    two = stage(two, "phrases-of-two")
    three = units(threes).join(side(two, "left", w1="w1", w2="w2", l1="l1", l2="a"), "left").join(side(two, "right", w3="w2", r1="a", r2="r1"), "right")
    three = stage(three, "phrases-of-three")
    four = (
        units(fours).join(side(three, "left", w1="w1", w2="w2", w3="w3", l1="l1", l2="l2", l3="a", p1="left", p2="right"), "left")
        .join(side(three, "right", w4="w3", r1="a", r2="r1", r3="r2", p3="right"), "right")
    )
    four = stage(four, "phrases-of-four")
    # The most frequent longer phrase around each unit. Keys of two- and of three-word units never meet in one join.
    around_two = [(three, "left"), (three, "right"), (four, "p1"), (four, "p2"), (four, "p3")]
    parts = [_scored(two, 2, around_two), _scored(three, 3, [(four, "left"), (four, "right")]), _scored(four, 4, [])]
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
