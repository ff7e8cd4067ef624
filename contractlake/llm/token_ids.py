"""Token ids in binary shards: each shard is a wavelet matrix with the list of its documents.

Texts are encoded whole by a public tokenizer and an end id is appended to each document. Shards
hold the documents in ascending doc_id order (null first; equal ids by length, then by content).
A shard is one row of compressed Parquet, written by Spark's committer, so a lost executor leaves
no half file; documents never cross shards, and a very long one fills several blocks of its own.

Null texts are empty: they hold the end id only. Repeated rows are kept. Empty tables give no shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tokens after which a shard ends, at the next document's start; tokens of a block at most.
SHARD_TOKENS, BLOCK_TOKENS = 1 << 20, 1 << 21
#: Distinct words that a worker remembers before it starts afresh; bytes of text split at once, which a single word may exceed.
CACHE_WORDS, PIECE_BYTES = 900_000, 1 << 23
SHARD_SCHEMA = "part int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, blocks array<binary>"

_blank = re.compile(rb"[ \t\n\r\x0b\x0c]")
_BLANKS = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Lower-case letters of ASCII and of the block after it; words of ASCII, without the apostrophe, and letters of that block.
_parts = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[^a-z\u00df-\u00f6\u00f8-\u00ff]+")
_letters = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
_western = re.compile("[\\x00-\\x26\\x28-\\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Encodes words, split at ASCII blanks, and remembers them: the tokenizer drops blanks, so no token crosses one.

    Words are found, and their distinct ones told, by array operations over some megabytes of texts.
    The tokenizer lower-cases, so words are kept with A-Z lowered. It also parts letters from ASCII
    characters that are none, but for the apostrophe; new words of ASCII characters and western letters
    are encoded by those parts, and runs of letters by its model alone, which sees their bytes as
    characters of its own. The constructor tries all this on samples; what fails goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.width = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2" if self.width <= 16 else "<u4")
        self.words: dict[bytes, bytes] = {}
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.lowers = ids("ABCab") == ids("abcab") and ids("ÀÖØÞ") == ids("àöøþ")
        self.parts = self.lowers and ids("ab.1é") == ids("ab") + ids(".") + ids("1") + ids("é")
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: "".join(x for x, _ in as_bytes.pre_tokenize_str(c)) for c in map(chr, range(0xDF, 0x100))})
        self.direct = True
        tried = ("abcab", "ab", "the", "zxqjk" * 9, "internationalisation", "a", "é", "ñandú", "straße", "œuvre"[1:], "þÿøåãç")
        self.direct = self.parts and [self._alone(w) for w in tried] == [ids(w) for w in tried]
        if ids("a b") != ids("a") + ids("b"):
            raise ValueError("only tokenizers that drop blanks are built")

    def _alone(self, letters: str) -> list[int]:
        return [x.id for x in self.tokenizer.model.tokenize(letters.translate(self.letters))]

    def _learn(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 512):
            group = words[i : i + 512]
            texts = [w.decode("utf-8", "replace") for w in group]
            starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
            got = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            cuts = np.searchsorted(np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0], [*starts, 1 << 60]).tolist()
            raw, n = np.array(got.ids, self.kind).tobytes(), self.kind.itemsize
            for word, a, b in zip(group, cuts[:-1], cuts[1:], strict=True):
                self.words[word] = raw[a * n : b * n]

    def _meet(self, new: set[bytes]) -> None:
        """Learns words; those that are parts of others are learnt with them."""
        if not self.direct:
            return self._learn(list(new))
        split, whole, runs = {}, [], set()
        for word in new:
            text = word.decode("utf-8", "replace")
            if _letters(text):
                runs.add(text)
            elif _western(text) and "<|" not in text:
                parts = split[word] = _parts.findall(text.lower())
                runs.update(parts)
            else:
                whole.append(word)
        known, tokens, letters = self.words, self.tokenizer.model.tokenize, self.letters
        names, found, counts, other = [], [], [], []
        for run in runs:
            name = run.encode()
            if name in known:
                continue
            if _letters(run):
                got = tokens(run if len(run) == len(name) else run.translate(letters))
                names.append(name)
                counts.append(len(got))
                found += [x.id for x in got]
            else:
                other.append(name)
        raw, ends = np.array(found, self.kind).tobytes(), (np.cumsum(counts, dtype=np.int64) * self.kind.itemsize).tolist()
        known.update(zip(names, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        self._learn(other + whole)
        known.update([(w, b"".join([known[x.encode()] for x in parts])) for w, parts in split.items()])

    def _stretch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, which end at blanks, and their number in each."""
        data = b" ".join([*pieces, b""])
        blank = _BLANKS[np.frombuffer(data, np.uint8)]
        starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        if not len(starts):
            return np.zeros(0, self.kind), np.zeros(len(pieces), np.int64)
        edges = np.append(starts, len(data)).astype(np.int32)
        coded = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        words = [w.rstrip() for w in coded.dictionary.to_pylist()]
        new = {w for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = set(words)
        if new:
            self._meet(new)
        found = [self.words[w] for w in words]
        flat, sizes = np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        places, index = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        n = sizes[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(places[index] - (ends - n), n) + np.arange(ends[-1])]
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in pieces)]))
        return ids, np.diff(np.append(0, ends)[first])

    def encode(self, texts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number in each."""
        parts, owners, counts, pieces, held, size, n = [np.zeros(0, self.kind)], [], [], [], [], 0, 0

        def close() -> None:
            nonlocal pieces, held, size
            ids, found = self._stretch(pieces)
            parts.append(ids)
            owners.extend(held)
            counts.append(found)
            pieces, held, size = [], [], 0

        for text in texts:
            if self.lowers and b"<|" not in text:
                text = text.lower()
            at = 0
            while len(text) - at > PIECE_BYTES and (cut := _blank.search(text, at + PIECE_BYTES)):
                pieces.append(text[at : cut.start()])
                held.append(n)
                at = cut.start()
                close()
            pieces.append(text[at:] if at else text)
            held.append(n)
            size += len(text) - at
            n += 1
            if size >= PIECE_BYTES:
                close()
        close()
        return np.concatenate(parts), np.bincount(np.array(owners, np.int64), np.concatenate(counts), n).astype(np.int64)


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most `parts` - 1 ids that part the documents evenly, from a sketch of the ids alone."""
    if parts < 2:
        return []
    found = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in found})


def tokenise(docs: DataFrame, tokenizer: str, *, end_id: int = 2, cuts: list[int] | None = None) -> DataFrame:
    """doc_id, part (its range among `cuts`), n_tokens, ids (little-endian, two bytes each if the vocabulary allows, else four)."""
    edges = np.array(cuts or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            got, n = enc.encode(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1))
            got, n = np.insert(got, np.cumsum(n), end_id), n + 1
            edge = pa.array(np.cumsum(np.append(0, n)) * enc.kind.itemsize, pa.int64())
            got = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, edge.buffers()[1], pa.py_buffer(got.tobytes())]).cast(pa.binary())
            part = np.searchsorted(edges, np.array([-(1 << 63) if x is None else x for x in ids.to_pylist()], np.int64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(part), pa.array(n, pa.int64()), got], names=["doc_id", "part", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, part int, n_tokens bigint, ids binary")


def write_shards(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes `docs` (doc_id, text) and writes the shards to `path`."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = tokenise(docs, tokenizer, end_id=end_id, cuts=bounds(docs, parts))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from contractlake.llm.wavelet import WaveletMatrix

        enc = encoder(tokenizer)
        start, part, size = 0, None, 0
        held: list[tuple[int, bytes]] = []

        def close() -> Iterator[pd.DataFrame]:
            nonlocal held, size, start
            if held:
                all_ids = np.frombuffer(b"".join(x for _, x in held), enc.kind)
                blocks = [WaveletMatrix.build(all_ids[i : i + BLOCK_TOKENS], enc.width).to_bytes() for i in range(0, len(all_ids), BLOCK_TOKENS)]
                row = (part, start, len(all_ids), [i for i, _ in held], [len(x) // enc.kind.itemsize for _, x in held], blocks)
                yield pd.DataFrame([row], columns=["part", "start", "n_tokens", "doc_ids", "lengths", "blocks"])
                start += len(all_ids)
            held, size = [], 0

        for batch in batches:
            for p, doc_id, n, ids in zip(batch["part"], batch["doc_id"], batch["n_tokens"], batch["ids"], strict=True):
                if p != part or size >= shard_tokens:
                    yield from close()
                    if p != part:
                        start, part = 0, p
                held.append((None if pd.isna(doc_id) else int(doc_id), ids))
                size += n
        yield from close()

    ordered = tokens.repartition(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    ordered.mapInPandas(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def shard_table(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `base`: all ids in the parts before theirs."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a part, at most as many as the writer had partitions.
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return shards.join(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "part")


def read_documents(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from contractlake.llm.wavelet import WaveletMatrix

        for batch in batches:
            for row in batch.itertuples(index=False):
                blocks = (WaveletMatrix.from_bytes(b).decode() for b in row.blocks)
                rows, start, left = [], int(row.base + row.start), np.zeros(0, np.uint32)
                for doc_id, n in zip(row.doc_ids, row.lengths, strict=True):
                    crc, need = 0, int(n)
                    while need:
                        if not len(left):
                            left = next(blocks).astype("<u4")
                        crc = zlib.crc32(left[:need].tobytes(), crc)
                        used = min(need, len(left))
                        left, need = left[used:], need - used
                    rows.append((None if pd.isna(doc_id) else int(doc_id), start, int(n), crc))
                    start += int(n)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    return shard_table(spark, path).mapInPandas(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """Global positions of one id, looked up in the planes without decoding the shards."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from contractlake.llm.wavelet import WaveletMatrix

        for batch in batches:
            for row in batch.itertuples(index=False):
                at = int(row.base + row.start)
                for block in row.blocks:
                    m = WaveletMatrix.from_bytes(block)
                    yield pd.DataFrame({"position": m.positions(token) + at})
                    at += m.n

    return shard_table(spark, path).mapInPandas(find, "position bigint")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """How often each of the given ids occurs, by rank on the planes, summed over shards."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from contractlake.llm.wavelet import WaveletMatrix

        for batch in batches:
            for blocks in batch["blocks"]:
                ms = [WaveletMatrix.from_bytes(b) for b in blocks]
                yield pd.DataFrame({"token": tokens, "n": [sum(m.rank(t) for m in ms) for t in tokens]})

    rows = spark.read.schema(SHARD_SCHEMA).parquet(path).select("blocks").mapInPandas(count, "token bigint, n bigint")
    return rows.groupBy("token").agg(F.sum("n").alias("n"))
