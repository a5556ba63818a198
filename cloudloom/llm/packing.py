"""Best-fit packing by vector capacities, planned on the histogram of piece lengths.

A document's ids (tokenizer ids, then an end id) are one piece, or consecutive pieces of ``capacity`` ids if there are
more. A piece is the vector (tokens, one document, tokens squared: its attention cost); a sequence has a capacity in each
component. Pieces are placed in order of falling length: of the open sequences that can take a piece in every component,
the rule picks one:

* ``norm``: the least weighted norm of what would be left, relative to the capacities;
* ``dot``: the largest weighted dot product of the piece and what is left.

A piece's vector follows from its length, so equal lengths are placed together: the plan works on at most ``capacity``
lengths and on groups of sequences with equal rooms. Pieces that no open sequence takes open new ones, filled with as
many of their length as every capacity allows; a plan made piece by piece does the same wherever tokens bind, and may
choose other sequences where another capacity does. Only the histogram (at most ``capacity`` rows) reaches the driver; a
piece finds its place from its rank among the pieces of its length. Ranks are counted in groups of about SALT_ROWS pieces
of a length, so a length that a third of all pieces share is spread too.

Words are tokenised once and kept by hash in each worker, which is right (but for words that
share a 64-bit hash) for tokenizers that lower-case and that split at
white space and between letters and punctuation: a comma or full stop after an ASCII letter is a word of its own, and
words without "<", which can hold no special token, are kept by their lower-case form. Edge cases. Null or empty text: the end id alone. Repeated rows and doc_ids are packed as rows of their
own, null doc_ids too. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import written

SALT_ROWS = 1 << 16
#: Words whose ids a worker keeps; it starts afresh beyond.
KEPT_WORDS = 800_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts, from the ids of their white-space separated words."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.seps = kernel.separators("space")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.store, self.at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]

    @staticmethod
    def _part(words: kernel.Words) -> None:
        """Makes a comma or full stop that ends a word, after an ASCII letter, a word of its own."""
        data, starts, ends = words.data, words.starts, words.ends
        last, before = data[ends - 1], data[np.maximum(ends - 2, 0)] | 0x20
        tail = ((last == ord(",")) | (last == ord("."))) & (ends - starts > 1) & (before >= ord("a")) & (before <= ord("z"))
        shift = np.concatenate(([0], np.cumsum(tail)))
        place = np.arange(len(starts)) + shift[:-1]
        new_starts, new_ends = (np.empty(len(starts) + shift[-1], np.int64) for _ in range(2))
        new_starts[place], new_ends[place] = starts, ends - tail
        new_starts[place[tail] + 1], new_ends[place[tail] + 1] = ends[tail] - 1, ends[tail]
        words.starts, words.ends, words.first = new_starts, new_ends, words.first + shift[words.first]

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [e.ids for e in encoded]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.store.append(np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())))
        self.at.append(self.at[-1][-1] + np.cumsum(lens))
        self.known.update(zip(hashes, range(len(self.known), len(self.known) + len(hashes)), strict=True))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and end)."""
        words = kernel.Words(data, offsets, self.seps)
        self._part(words)
        hashes = words.hashes(lower=True)
        marks = np.concatenate(([0], np.cumsum(data == ord("<"))))
        if marks[-1]:
            special = marks[words.ends] > marks[words.starts]
            hashes[special] = kernel.mix(words.hashes(lower=False)[special])
        coded = pa.array(hashes).dictionary_encode()
        unique, inverse = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        index = np.empty(len(unique), np.int64)
        index[inverse] = np.arange(len(inverse))  # any place of a word will do
        if len(self.known) > KEPT_WORDS:
            self._forget()
        keys, raw = unique.tolist(), data.tobytes()
        if new := [k for k, key in enumerate(keys) if key not in self.known]:
            spans = zip(words.starts[index[new]].tolist(), words.ends[index[new]].tolist(), strict=True)
            self._learn([keys[k] for k in new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            self.store, self.at = [np.concatenate(self.store)], [np.concatenate(self.at)]
        store, at = self.store[0], self.at[0]
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]
        starts, lens = at[entry], at[entry + 1] - at[entry]
        ends = np.concatenate(([0], np.cumsum(lens)))
        where = np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lens)
        return store[where], ends[words.first]


def piece_rows(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, data, offsets in kernel.chunks(batch):
                tokens, bounds = encoder.ids(data, offsets)
                tokens = tokens.astype("<u4")
                out: list[tuple] = []
                for doc, a, b in zip(ids[rows], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(tokens[a:b], np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        part = own[k : k + capacity]
                        out.append((doc, k // capacity, k, len(part), zlib.crc32(part.tobytes())))
                doc, piece, start, length, crc = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(lengths: np.ndarray, counts: np.ndarray, capacities: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> tuple[np.ndarray, int]:
    """Placements (length, first rank, how many, first sequence, offset), one piece in each sequence; sequences used.

    Pieces of a length take their placements in rank order, sequences of a placement are consecutive numbers.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    cap = np.array(capacities, np.float64)
    room, groups, where = np.zeros((64, 3), np.int64), [], {}  # rooms of sequence groups; their runs of numbers
    made: list[tuple[int, int, int, int, int]] = []
    used, size = 0, np.zeros(64, np.int64)

    def put(left: tuple[int, int, int], runs: list[tuple[int, int]]) -> None:
        nonlocal room, size
        if left not in where:
            if len(groups) == len(room):
                room, size = np.concatenate((room, np.zeros_like(room))), np.concatenate((size, np.zeros_like(size)))
            where[left] = len(groups)
            room[len(groups)] = left
            groups.append([])
        k = where[left]
        groups[k] += runs
        size[k] += sum(n for _, n in runs)

    order = np.argsort(-lengths)
    for length, count in zip(lengths[order].tolist(), counts[order].tolist(), strict=True):
        item, rank = np.array((length, 1, length * length), np.int64), 0
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while count:
            k = len(groups)
            fits = np.flatnonzero((size[:k] > 0) & (room[:k] >= item).all(axis=1))
            if len(fits):
                left = (room[fits] - item) / cap
                if rule == "norm":
                    best = fits[np.argmin((np.array(weights) * left * left).sum(axis=1))]
                else:
                    best = fits[np.argmax((np.array(weights) * (item / cap) * (room[fits] / cap)).sum(axis=1))]
                after, taken = tuple((room[best] - item).tolist()), []
                offset = int(cap[0]) - int(room[best][0])
                while count and groups[best]:
                    at, n = groups[best].pop()
                    m = min(n, count)
                    made.append((length, rank, m, at, offset))
                    taken.append((at, m))
                    rank, count, size[best] = rank + m, count - m, size[best] - m
                    if m < n:
                        groups[best].append((at + m, n - m))
                put(after, taken)
                continue
            each = int(min(capacities[0] // length, capacities[1], capacities[2] // (length * length)))
            for bins, per in ((count // each, each), (1, count % each)):
                if bins and per:
                    for j in range(per):
                        made.append((length, rank, bins, used, j * length))
                        rank += bins
                    put(tuple((np.array(capacities) - per * item).tolist()), [(used, bins)])
                    used += bins
            count = 0
    return np.array(made, np.int64).reshape(-1, 5), used


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """pieces with rank, from 0 among the pieces of the same length, of which there are up to most; uid is a stored number
    of the row."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(max(64, most // SALT_ROWS))))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    counts = counts.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    return salted.withColumn("own", own).join(counts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own")).drop("salt", "own", "before", "uid")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, max_docs: int = 4096, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of each document."""
    limits = (capacity, max_docs, max_attention or capacity * capacity)
    pieces = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(piece_rows(tokenizer_path, capacity, end_id), PIECES)
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    hist = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    placed, _ = plan(np.array([r["length"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), limits, weights, rule)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    shared = pieces.sparkSession.sparkContext.broadcast(placed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            row = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            columns = [*batch.columns[:5], pa.array(table[row, 3] + rank - table[row, 1]), pa.array(table[row, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked(pieces, max((r["n"] for r in hist), default=0)).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
