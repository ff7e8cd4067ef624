"""SentencePiece encoding and decoding over a relational lattice of fragments.

A text is normalised as the model asks (a leading blank; the sign U+2581 and the blank are one
character, here the blank). It is cut wherever its two neighbouring characters stand side by side in
no piece: no piece can cross such a border, so fragments are encoded one by one, each distinct one once:

1. one pass cuts the texts. The texts of a task form blocks of bounded size; a block numbers its
   distinct fragments, and its texts are kept as these numbers in a table bucketed by block;
2. the distinct fragments' substrings of bounded length are exploded and equi-joined with the piece
   table, whose size the model fixes; the matches are the edges of the fragment's lattice, grouped by it;
3. a Spark higher-order aggregate folds the lattice: Viterbi for unigram models; for BPE models the
   merges in the model's order, since Viterbi over their scores gives other pieces than the model;
4. each block gets the ids of its own fragments back by a join and writes its texts in ids, beside the
   bucketed table, which is not shuffled. No dictionary of the corpus is ever held by a task or the driver.

Under BPE, fragments of more than `WINDOW` characters are cut into overlapping windows, which are
encoded as fragments are. Two windows are joined at a piece that both hold at the same place: pieces
are the model's if any two neighbours are, so the result is exact. Where no piece is common, the
model's own library encodes that fragment.

Characters without a piece become byte pieces, or the unknown piece if the model has no bytes.
Null and empty texts have no ids. Null and repeated ids and repeated rows are encoded row by row.
Of very long texts a task holds the text and its numbers, but cuts it in stretches. Other columns than
doc_id and text are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contractlake.llm.common import bucketed, setting, stage

BLANK, SIGN = " ", "\u2581"
#: Longest fragment that a BPE fold takes; from one window to the next.
WINDOW, STEP = 56, 28
#: Bytes of text whose fragments are numbered together; bytes that are cut at once; bytes of a fragment that are hashed.
BLOCK_BYTES, STRETCH, _HASHED = 1 << 25, 1 << 20, 64
#: Texts that a task takes over at once.
BATCH_ROWS = 1_000
#: Partitions of the distinct fragments, in multiples of the shuffle partitions; fragments that a task groups in memory before it sorts.
PARTS_TIMES, GROUPED = 8, 20_000
_STRIDE, _NEVER = 64, 1e300


class Pieces(NamedTuple):
    """A model's pieces: text, id and score of the plain ones; byte ids start at `first_byte` (None: no bytes)."""

    path: str
    bpe: bool
    texts: list[str]
    ids: list[int]
    scores: list[float]
    all_texts: list[bytes]
    first_byte: int | None
    unknown: int


def load(path: str) -> Pieces:
    """Reads a model file with the library's own reader."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
    spec = model.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
        raise ValueError("only models without text normalisation, with a leading blank, are built")
    plain = [(p.piece.replace(SIGN, BLANK), i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
    bytes_at = [i for i, p in enumerate(model.pieces) if p.type == 6]
    raw = [
        bytes([i - bytes_at[0]]) if p.type == 6 else (b"" if p.type == 3 else p.piece.replace(SIGN, BLANK).encode()) for i, p in enumerate(model.pieces)
    ]
    texts, ids, scores = map(list, zip(*plain, strict=True))
    return Pieces(path, model.trainer_spec.model_type == 2, texts, ids, scores, raw, bytes_at[0] if bytes_at else None, model.trainer_spec.unk_id)


class Borders:
    """Where texts may be cut: between characters that stand side by side in no piece."""

    def __init__(self, pieces: Pieces):
        joined = [t for t in pieces.texts if len(t) > 1]
        self.chars = sorted(set("".join(joined)))
        number = {c: i + 1 for i, c in enumerate(self.chars)}
        self.inside = np.zeros((len(self.chars) + 1, len(self.chars) + 1), bool)
        for t in joined:
            row = [number[c] for c in t]
            self.inside[row[:-1], row[1:]] = True
        self.window = WINDOW if pieces.bpe else None
        self.classes: np.ndarray | None = None

    def cut(self, text: bytes, heads: np.ndarray) -> tuple[list[pa.Array], np.ndarray, list[tuple[int, int]]]:
        """Fragments of texts that lie side by side in `text` and begin at `heads`: the fragments, the byte at which
        each begins, and (place among them, number) of runs of windows that stand for one long fragment."""
        if self.classes is None:
            self.classes = np.zeros(0x110000, np.uint16)
            self.classes[[ord(c) for c in self.chars]] = np.arange(1, len(self.chars) + 1)
        found, begins, runs, total = [], [], [], 0
        at, stretch = 0, STRETCH
        while at < len(text):
            end = min(len(text), at + stretch)
            while end < len(text) and text[end] & 0xC0 == 0x80:
                end += 1
            chars = text[at:end].decode("utf-8", "replace")
            codes = np.frombuffer(chars.encode("utf-32-le"), "<u4")
            kinds = self.classes[codes]
            border = np.ones(len(codes), bool)
            border[1:] = ~self.inside[kinds[:-1], kinds[1:]]
            if len(codes) == end - at:
                place = np.arange(len(codes) + 1)
            else:
                place = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
            border[np.searchsorted(place[:-1], heads[(heads >= at) & (heads < end)] - at)] = True
            starts = np.flatnonzero(border)
            if end < len(text):
                if len(starts) == 1:  # no border in sight
                    stretch *= 2
                    continue
                starts, stop = starts[:-1], starts[-1]
            else:
                stop = len(codes)
            edges = np.append(starts, stop)
            where = place[edges]
            rows = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where.astype(np.int32)), pa.py_buffer(text[at : at + where[-1]]))
            begin, sizes = where[:-1] + at, np.diff(edges)
            if self.window and sizes.max() > self.window:
                parts, begun, last = [], [], 0
                for j in np.flatnonzero(sizes > self.window).tolist():
                    word = chars[edges[j] : edges[j + 1]]
                    windows = [word[k : k + self.window] for k in range(0, len(word) - self.window + STEP, STEP)]
                    parts += [rows.slice(last, j - last), pa.array(windows, pa.string())]
                    begun += [begin[last:j], np.full(len(windows), begin[j])]
                    runs.append((total + sum(map(len, begun[:-1])), len(windows)))
                    last = j + 1
                rows, begin = pa.concat_arrays([*parts, rows.slice(last)]), np.concatenate([*begun, begin[last:]])
            found.append(rows)
            begins.append(begin)
            total += len(rows)
            at, stretch = at + int(where[-1]), STRETCH
        return found, np.concatenate(begins) if begins else np.zeros(0, np.int64), runs


#: Fragments of a block that three bytes number.
NARROW = 1 << 24


class _Block:
    """Texts of a task whose fragments are numbered together."""

    def __init__(self, borders: Borders):
        self.borders = borders
        self.ids, self.crcs, self.counts, self.runs = [], [], [], []
        self.fragments: list[pa.Array] = []
        self.waiting: list[bytes] = []
        self.size = self.held = 0

    def add(self, doc_id, raw: bytes) -> None:
        text = b" " + raw.replace(SIGN.encode(), b" ") if raw else b""
        self.ids.append(doc_id)
        self.crcs.append(zlib.crc32(text))
        self.waiting.append(text)
        self.size += len(text)
        self.held += len(text)
        if self.held >= STRETCH:
            self.cut()

    def cut(self) -> None:
        heads = np.cumsum([0, *map(len, self.waiting)])
        found, begins, runs = self.borders.cut(b"".join(self.waiting), np.unique(heads[:-1]))
        first = np.searchsorted(begins, heads)
        self.counts += np.diff(first).tolist()
        mine = [[] for _ in self.waiting]
        for place, n in runs:
            i = int(np.searchsorted(first, place, "right")) - 1
            mine[i] += [place - int(first[i]), n]
        self.runs += mine
        self.fragments += found
        self.waiting, self.held = [], 0

    def rows(self, block: int, kind: pa.DataType, parts: int) -> Iterator[pa.RecordBatch]:
        """The block's texts, its order of fragments, and its fragments by part."""
        self.cut()
        coded = pa.chunked_array(self.fragments, pa.string()).dictionary_encode()
        self.fragments = []
        words = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())
        chunks = [c.indices.to_numpy() for c in coded.chunks]
        seen = np.zeros(len(words), np.int64)
        for chunk in chunks:
            seen += np.bincount(chunk, minlength=len(words))
        # Frequent fragments get small numbers, whose bytes compress well.
        rank = np.empty(len(words), np.uint32)
        rank[np.argsort(-seen, kind="stable")] = np.arange(len(words), dtype=np.uint32)
        # The third plane is two bytes wide where a block has more fragments than three bytes number.
        total, width = sum(map(len, chunks)), 1 if len(words) <= NARROW else 2
        planes, at = [np.empty((total, w), np.uint8) for w in (1, 1, width)], 0
        for chunk in chunks:
            four = rank[chunk].view(np.uint8).reshape(-1, 4)
            for k, plane in enumerate(planes):
                plane[at : at + len(chunk)] = four[:, k : k + plane.shape[1]]
            at += len(chunk)
        del coded, chunks
        edges = np.cumsum([0, *self.counts])
        n = len(self.ids)
        low, middle, high = (pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((edges * x.shape[1]).astype(np.int32)), pa.py_buffer(x)]) for x in planes)
        found = {
            "block": pa.array(np.full(n, block)), "doc_id": pa.array(self.ids, kind), "crc": pa.array(self.crcs, pa.int64()),
            "low": low, "middle": middle, "high": high, "runs": pa.array(self.runs, pa.list_(pa.int32())),
        }
        yield _numbered(n, kind, found)
        part = _hashes(words) % parts
        order = np.argsort(part, kind="stable")
        yield _numbered(1, kind, {"block": pa.array([block]), "numbers": pa.array([rank[order].tobytes()], pa.binary())})
        present, first = np.unique(part[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), words.take(pa.array(order)))
        yield _numbered(len(present), kind, {"block": pa.array(np.full(len(present), block)), "part": pa.array(present, pa.int32()), "words": lists})


_COLUMNS = "block long, doc_id {}, crc long, low binary, middle binary, high binary, runs array<int>, numbers binary, part int, words array<string>"
_KINDS = {
    "block": pa.int64(), "doc_id": None, "crc": pa.int64(), "low": pa.binary(), "middle": pa.binary(), "high": pa.binary(),
    "runs": pa.list_(pa.int32()), "numbers": pa.binary(), "part": pa.int32(), "words": pa.list_(pa.string()),
}


def _numbered(n: int, kind: pa.DataType, found: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([found[c] if c in found else pa.nulls(n, t or kind) for c, t in _KINDS.items()], names=list(_KINDS))


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's size and first bytes."""
    data, edges = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
    starts, sizes = edges[:-1], np.diff(edges)
    out = sizes.astype(np.uint64)
    for k in range(min(_HASHED, int(sizes.max(initial=0)))):
        rows = np.flatnonzero(sizes > k)
        out[rows] = out[rows] * np.uint64(0x9E3779B97F4A7C15) + data[starts[rows] + k]
    return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)


def number_fragments(docs: DataFrame, pieces: Pieces, parts: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Three kinds of rows: a text (block, doc_id, crc of the normalised text; low, middle, high: bytes of the numbers of its fragments;
    runs of windows), the fragments of a block by part, which a hash of the fragment gives (block, part, words), and the block's numbers
    of all its fragments in the order of those (block, numbers)."""
    borders = Borders(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        held, kind = None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = held or _Block(borders)
                held.add(doc_id, text.as_buffer().to_pybytes() if text.is_valid else b"")
                if held.size >= block_bytes:
                    yield from held.rows(number, kind, parts)
                    number, held = number + 1, None
        if held:
            yield from held.rows(number, kind, parts)
            held = None
        pa.default_memory_pool().release_unused()  # the worker is idle in the stages that follow

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, _COLUMNS.format(kind))


def lattice(words: DataFrame, pieces: Pieces, longest: int, *carried: str) -> DataFrame:
    """part, word, size, edges (map of start * 64 + length to cost and id) and the columns carried of `words` (part, word), which differ."""
    spark = words.sparkSession
    known = spark.createDataFrame(pd.DataFrame({"piece": pieces.texts, "id": np.array(pieces.ids, np.int32), "cost": -np.array(pieces.scores)}))
    starts = words.select("part", "word", *carried, F.length("word").alias("size"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("size") - F.col("s") + 1))).alias("l"))
    # The piece table has one row a piece of the model, whatever the texts are.
    edges = spans.withColumn("piece", F.expr("substring(word, s, l)")).join(F.broadcast(known), "piece", "left")
    edges = edges.filter("id is not null or l = 1")
    edge = F.struct((F.col("s") * _STRIDE + F.col("l")).alias("key"), F.struct("cost", "id").alias("value"))
    return edges.groupBy("part", "word").agg(F.max("size").alias("size"), *[F.max(c).alias(c) for c in carried], F.map_from_entries(F.collect_list(edge)).alias("edges"))


def _bind(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _edge(start: Column, end: Column) -> Column:
    return F.try_element_at(F.col("edges"), start * _STRIDE + (end - start))


def merged() -> Column:
    """Boundaries of the pieces of a word under BPE: again and again the best adjacent pair, leftmost first, becomes one."""

    def step(state: Column, _: Column) -> Column:
        b = state["b"]
        pair = lambda k: F.struct(F.coalesce(_edge(b[k], b[k + 2])["cost"], F.lit(_NEVER)).alias("c"), k.alias("k"))
        best = F.array_min(F.transform(F.sequence(F.lit(0), F.size(b) - 3), pair))
        after = lambda z: F.when(z["c"] >= _NEVER, F.struct(b.alias("b"), F.lit(True).alias("done"))).otherwise(
            F.struct(F.filter(b, lambda _, i: i != z["k"] + 1).alias("b"), F.lit(False).alias("done"))
        )
        return F.when(state["done"] | (F.size(b) < 3), F.struct(b.alias("b"), F.lit(True).alias("done"))).otherwise(_bind(best, after))

    start = F.struct(F.sequence(F.lit(1), F.col("size") + 1).alias("b"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.col("size")), start, step, lambda s: s["b"])


def _left(x: Column, k: Column) -> Column:
    return F.call_function("shiftleft", x, k.cast("int"))


def _right(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k.cast("int"))


def merged_once(slow: Column) -> Column:
    """The same boundaries in one fold over the edges, best first; words whose merges go back to a better edge take `slow`.

    The state holds the boundaries as bits. An edge is merged if both its ends and one boundary
    between them stand. A merge may open an edge that was passed before; then the fold does not
    decide.
    """
    one = F.lit(1).cast("long")
    bit = lambda k: _left(one, k)
    below = lambda k: bit(k) - 1
    start, end = (lambda e: e["s"] - 1), (lambda e: e["s"] - 1 + e["l"])
    top = lambda x: F.floor(F.log2(x.cast("double") + 0.5)).cast("int")
    edges = F.filter(F.map_entries("edges"), lambda e: (e["key"] % _STRIDE > 1) & e["value"]["id"].isNotNull())
    edges = F.transform(edges, lambda e: F.struct(e["value"]["cost"].alias("c"), F.floor(e["key"] / _STRIDE).cast("int").alias("s"), (e["key"] % _STRIDE).alias("l")))
    cost = lambda a, b: F.try_element_at(F.col("edges"), (a + 1) * _STRIDE + (b - a))["cost"]

    def step(state: Column, e: Column) -> Column:
        mask = state["mask"]
        inner = _right(mask, start(e)).bitwiseAND(below(e["l"] + 1))
        ready = (F.bit_count(inner) == 3) & (inner.bitwiseAND(one) == 1) & (_right(inner, e["l"]) == 1)
        left, right = mask.bitwiseAND(below(start(e))), _right(mask, end(e) + 1)
        before = F.when(left > 0, cost(top(left), end(e)) <= e["c"])
        after = F.when(right > 0, cost(start(e), end(e) + 1 + top(right.bitwiseAND(-right))) < e["c"])
        gone = mask.bitwiseAND(_left(below(e["l"] - 1), start(e) + 1))
        went = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
        return F.when(state["back"] | ~ready, state).otherwise(F.struct((mask - gone).alias("mask"), went.alias("back")))

    first = F.struct(below(F.col("size") + 1).alias("mask"), F.lit(False).alias("back"))
    end_state = F.aggregate(F.array_sort(edges), first, step)
    spread = lambda z: F.filter(F.sequence(F.lit(1), F.col("size") + 1), lambda k: _right(z["mask"], k - 1).bitwiseAND(one) == 1)
    return _bind(end_state, lambda z: F.when(z["back"], slow).otherwise(spread(z)))


def viterbi(longest: int, unknown_cost: float) -> Column:
    """Boundaries of the cheapest path through the lattice, for unigram models; ties go to the longer last piece."""
    node = lambda cost, back: F.struct(cost.alias("cost"), back.alias("back"))

    def step(done: Column, end: Column) -> Column:
        def reach(l: Column) -> Column:  # noqa: E741
            start = end + 1 - l
            cost = F.coalesce(_edge(start, end + 1)["cost"], F.when(l == 1, F.lit(unknown_cost)).otherwise(F.lit(_NEVER)))
            return node(done[start - 1]["cost"] + cost, start)

        return F.concat(done, F.array(F.array_min(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), end)), reach))))

    path = F.aggregate(F.sequence(F.lit(1), F.col("size")), F.array(node(F.lit(0.0), F.lit(0))), step)
    back = lambda nodes: F.aggregate(
        F.sequence(F.lit(1), F.col("size")), F.array(F.col("size") + 1),
        lambda b, _: F.when(b[0] == 1, b).otherwise(F.concat(F.array(nodes[b[0] - 1]["back"]), b)),
    )
    return _bind(path, back)


def encode_words(words: DataFrame, pieces: Pieces, *carried: str) -> DataFrame:
    """part, word, ids and the columns carried for each of `words` (part, word), which differ; under BPE they have `WINDOW` characters at most."""
    longest = max(map(len, pieces.texts))
    if longest >= _STRIDE:
        raise ValueError(f"pieces of {_STRIDE} characters or more are not built")
    folded = lattice(words, pieces, longest, *carried)
    bounds = merged_once(merged()) if pieces.bpe else viterbi(longest, -min(pieces.scores) + 10)
    folded = folded.select("part", "word", *carried, "edges", bounds.alias("b"))

    def ids_of(k: Column) -> Column:
        start, end = F.col("b")[k], F.col("b")[k + 1]
        char = F.hex(F.col("word").substr(start, F.lit(1)).cast("binary"))
        as_bytes = F.transform(
            F.sequence(F.lit(0), (F.length(char) / 2).cast("int") - 1),
            lambda i: F.conv(char.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int") + (pieces.first_byte or 0),
        )
        absent = as_bytes if pieces.first_byte is not None else F.array(F.lit(pieces.unknown))
        found = _edge(start, end)["id"]
        return F.when(found.isNotNull(), F.array(found)).otherwise(absent)

    return folded.select("part", "word", *carried, F.flatten(F.transform(F.sequence(F.lit(0), F.size("b") - 2), ids_of)).alias("ids"))


def _placed(ids: np.ndarray, begin: int, texts: list[bytes]) -> list[tuple[int, int, int]]:
    out = []
    for i in ids.tolist():
        out.append((begin, begin + len(texts[i]), i))
        begin = out[-1][1]
    return out


def join_windows(windows: list[np.ndarray], texts: list[bytes], model: str) -> np.ndarray:
    """Ids of a long fragment from those of its windows: at a piece that both hold, one window gives way to the next."""
    out, begin = _placed(windows[0], 0, texts), 0
    last = b"".join(map(texts.__getitem__, windows[0].tolist()))
    whole, fits = last, True
    for ids in windows[1:]:
        begin += len(last.decode()[:STEP].encode())
        last = b"".join(map(texts.__getitem__, ids.tolist()))
        whole = whole[:begin] + last
        if not fits:
            continue
        mine = _placed(ids, begin, texts)
        place = {x: k for k, x in enumerate(mine)}
        keep = len(out)
        while keep and out[keep - 1] not in place and out[keep - 1][1] > begin:
            keep -= 1
        if keep and out[keep - 1] in place:
            out[keep:] = mine[place[out[keep - 1]] + 1 :]
        else:
            fits = False
    if fits:
        return np.array([i for _, _, i in out], np.int32)
    import sentencepiece

    # The library puts a blank before a text: it is the fragment's own if it begins with one, else a line feed shields it.
    library, text = sentencepiece.SentencePieceProcessor(model_file=model), whole.decode()
    if text.startswith(BLANK):
        return np.array(library.encode(text[1:]), np.int32)
    shield = library.encode("\n")
    return np.array(library.encode("\n" + text)[len(shield) :], np.int32)


def translate(pieces: Pieces):
    """A function of a block's texts and of its fragments' ids that writes the texts in ids, decodes and compares them."""
    texts, model = pieces.all_texts, pieces.path

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("part")
        orders = rows.filter(rows.column("numbers").is_valid()).column("numbers")
        number = np.frombuffer(orders[0].as_buffer() if len(orders) else b"", "<u4")
        n, flat = _flat(known.column("sizes")), _flat(known.column("ids"))
        if len(n) != len(number):
            raise RuntimeError("a block's fragments and their ids do not agree")
        sizes, starts = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        sizes[number], starts[number] = n, np.cumsum(n) - n

        def ids_of(numbers: np.ndarray) -> np.ndarray:
            n = sizes[numbers]
            ends = np.cumsum(n)
            return flat[np.repeat(starts[numbers] - (ends - n), n) + np.arange(ends[-1])] if len(n) else np.zeros(0, np.int32)

        rows = rows.filter(rows.column("numbers").is_null())
        out, count, crc, same = [], [], [], []
        columns = (rows.column(c) for c in ("low", "middle", "high"))
        for low, middle, high, runs, own in zip(*columns, rows.column("runs").to_pylist(), rows.column("crc").to_pylist(), strict=True):
            numbers = numbers_of(*(x.as_py() for x in (low, middle, high)))
            if runs:
                parts, last = [], 0
                for place, k in zip(runs[::2], runs[1::2], strict=True):
                    windows = [ids_of(numbers[w : w + 1]) for w in range(place, place + k)]
                    parts += [ids_of(numbers[last:place]), join_windows(windows, texts, model)]
                    last = place + k
                ids = np.concatenate([*parts, ids_of(numbers[last:])])
            else:
                ids = ids_of(numbers)
            ids = ids.astype("<i4")
            out.append(ids)
            count.append(len(ids))
            crc.append(zlib.crc32(ids))
            same.append(zlib.crc32(b"".join(map(texts.__getitem__, ids.tolist()))) == own)
        edges = pa.array(np.cumsum([0, *count]), pa.int32())
        written = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
        return pa.table({
            "doc_id": rows.column("doc_id"), "ids": written, "n_pieces": pa.array(count, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
            "round_trip": pa.array(same, pa.bool_()),
        })

    return run


def numbers_of(low: bytes, middle: bytes, high: bytes) -> np.ndarray:
    """Numbers of the fragments of a text from their bytes; the third plane has one or two bytes a fragment."""
    last = np.frombuffer(high, np.uint8 if len(high) == len(low) else "<u2").astype(np.int64)
    return np.frombuffer(low, np.uint8).astype(np.int64) | np.frombuffer(middle, np.uint8).astype(np.int64) << 8 | last << 16


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *(c.flatten().to_numpy() for c in lists.chunks)])


def encode_documents(docs: DataFrame, model: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 (of the ids as little-endian 32-bit numbers), round_trip for each row of `docs` (doc_id, text).

    round_trip: the decoded ids give the normalised text back.
    """
    docs, pieces, spark = docs.select("doc_id", "text"), load(model), docs.sparkSession
    parts = PARTS_TIMES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        table = bucketed(number_fragments(docs, pieces, parts, block_bytes), "pieces", "block", min(parts // 2, 50_000))
    lists = table.filter("words is not null and block is not null and part is not null").select("block", "part", "words").repartition(parts, "part")
    each = lists.select("block", "part", F.posexplode("words").alias("k", "word"))
    distinct = each.groupBy("part", "word").agg(F.min("block").alias("first_block"))
    # A word is in one part only: what is dealt by part need not be dealt by word again. No block comes before the word's first:
    # with that column, both uses of the dealt lists are alike, and Spark deals them once.
    # Edges arrive fragment by fragment and their lists are short: grouping them by hash beats sorting all edges.
    with (
        setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPED)),
        setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"),
    ):
        found = each.join(encode_words(distinct, pieces, "first_block"), ["part", "word"]).filter("block >= first_block")
        inner = F.array_sort(F.collect_list(F.struct("k", "ids")))
        known = found.groupBy("block", "part").agg(inner.alias("x"))
        known = known.select("block", "part", F.transform("x", lambda x: F.size(x["ids"])).alias("sizes"), F.flatten(F.col("x.ids")).alias("ids"))
        known = stage(known, "piece-ids")
    kind = dict(docs.dtypes)["doc_id"]
    texts = table.filter("words is null").select("block", "doc_id", "crc", "low", "middle", "high", "runs", "numbers")
    schema = f"doc_id {kind}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean"
    return texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(translate(pieces), schema)


def decode(rows: DataFrame, model: str) -> DataFrame:
    """All columns of `rows` and `decoded`, the text of its column `ids` (null: empty)."""
    texts = load(model).all_texts

    @F.pandas_udf("string")
    def text_of(parts: pd.Series) -> pd.Series:
        join = lambda ids: b"".join(map(texts.__getitem__, ids)).decode("utf-8", "replace")[1:]
        return pd.Series([join(x) if x is not None and len(x) else "" for x in parts], dtype=object)

    return rows.withColumn("decoded", text_of("ids"))


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """piece, id, score of a model's plain pieces."""
    p = load(model)
    return spark.createDataFrame(pd.DataFrame({"piece": p.texts, "id": p.ids, "score": p.scores}))
