"""N-grams of a corpus as rows, counted by hash and joined back to the text blocks that hold them.

* blocks: runs of documents of up to BLOCK_BYTES of text, written once to the shared folder; a longer text is a block of
  its own. Documents are recognised by their place in a block, so repeated and null ids need nothing more.
* n-gram rows (block, h, c): each distinct n-gram of a block once, with its count there. That is the map-side combine.
* counts: the n-gram rows are hash-partitioned and sorted by n-gram; a window sums each n-gram's rows and sets the total
  beside each of them. That is the count table joined back to the n-grams, for one shuffle of narrow rows.
* replies (block, h, total): only of n-grams that other blocks hold too; of all others a block knows the total itself.
* bulk_totals do the same with the n-grams of a block and a range of hashes in one row, counted by a sort in each range.

Rows are in proportion to the text. An n-gram that every document holds has one row a block, and the window
spills what it holds of one n-gram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import written

BLOCK_BYTES = 16 << 20
#: The n-gram rows are made and counted in so many parts by hash, one after the other, for less disk at once.
PARTS = 2
BLOCKS = "block long, n_words long, n_bytes long, ids binary, nulls binary, offsets binary, text binary"
GRAMS = "block long, h long, c int"
BULK = "bucket long, block long, h binary, c binary"
TOTALS = "block long, ord int, bucket long, n long, size long, totals binary"


def batch_of(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _to_blocks(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Input columns doc_id, text and uid, a number of the row that is unique."""
    seps, held, size = kernel.separators("space"), [], 0

    def made() -> pa.RecordBatch:
        uid = int(held[0][0])
        ids, nulls, lens, data = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
        n_words = sum(x[5] for x in held)
        offsets = np.concatenate(([0], np.cumsum(lens)))
        text = pa.compress(data.tobytes(), codec="zstd", asbytes=True)
        return batch_of(BLOCKS, [uid], [n_words], [len(data)], [ids.tobytes()], [nulls.tobytes()], [offsets.tobytes()], [text])

    for batch in batches:
        ids, uid = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
        nulls, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        for rows, data, offsets in kernel.chunks(batch):
            if held and size + len(data) > block_bytes:
                yield made()
                held, size = [], 0
            held.append((uid[rows.start], ids[rows], nulls[rows], np.diff(offsets), data, len(kernel.Words(data, offsets, seps).starts)))
            size += len(data)
    if held:
        yield made()


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """BLOCKS of the columns doc_id and text, written."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("uid"))
    return written(rows.mapInArrow(lambda batches: _to_blocks(batches, block_bytes), BLOCKS), "blocks")


def texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a block's texts."""
    data = np.frombuffer(pa.decompress(row["text"], row["n_bytes"], codec="zstd", asbytes=True), np.uint8)
    return data, np.frombuffer(row["offsets"], np.int64)


def doc_ids(row: dict) -> pa.Array:
    return pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))


def block_words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of a block's words, where each text's words begin and the last one's end)."""
    data, offsets = texts(row)
    seps, hashes, firsts, at, n = kernel.separators("space"), [], [np.zeros(1, np.int64)], 0, 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + kernel.CHUNK_BYTES, "right")) - 1)
        words = kernel.Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], seps)
        hashes.append(words.hashes(lower=True))
        firsts.append(words.first[1:] + n)
        n, at = n + len(hashes[-1]), to
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(firsts)


def grams_ending(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram that ends at each word, which words have one within their text)."""
    full = np.zeros(len(h), np.uint64)
    if n == 1:
        full = h
    else:
        full[n - 1 :] = kernel.ngrams(h, n)
    return full, np.arange(len(h)) - np.repeat(first[:-1], np.diff(first)) >= n - 1


def gram_rows(blocked: DataFrame, grams_of: Callable[[dict], np.ndarray], of: int = 0, parts: int = 1) -> DataFrame:
    """GRAMS of each block, or those of one part of the hashes; grams_of gives a block's n-grams, each as often as it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = grams_of(row)
                if parts > 1:
                    grams = grams[(grams >> np.uint64(32)) % np.uint64(parts) == of]
                unique, count = np.unique(grams, return_counts=True)
                for k in range(0, len(unique), 1 << 16):
                    part = slice(k, k + (1 << 16))
                    yield batch_of(GRAMS, np.full(len(unique[part]), row["block"]), unique[part].view(np.int64), count[part].astype(np.int32))

    return blocked.mapInArrow(run, GRAMS)


def replies(grams: DataFrame) -> DataFrame:
    """(block, h, total) of the n-grams that several blocks hold."""
    counted = grams.withColumn("total", F.sum("c").over(Window.partitionBy("h")))
    return counted.where(F.col("total") > F.col("c")).select("block", "h", "total")


def written_replies(blocked: DataFrame, grams_of: Callable[[dict], np.ndarray], name: str) -> list[DataFrame]:
    """replies() of the n-grams of all blocks, a written table for each part of the hashes."""
    return [written(replies(gram_rows(blocked, grams_of, k, PARTS)), f"{name}-{k}") for k in range(PARTS)]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in the least bytes that hold the largest of them; unpacked() needs to know how many they are."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(x.max(initial=0)) <= np.iinfo(k).max)
    return x.astype(kind).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def bulk_totals(blocked: DataFrame, n: int, buckets: int, name: str) -> DataFrame:
    """(block, ord, bucket, totals), written: the totals of a block's distinct n-grams of n words, in the order of their hashes,
    by range of hashes. A block's n-grams of a range are one row of the shuffle, so each costs the bytes of its hash and its
    count, and no row; what goes back is the totals alone."""
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                full, has = grams_ending(*block_words(row), n)
                unique, count = np.unique(full[has], return_counts=True)
                cuts = np.concatenate(([0], np.searchsorted(unique, edges), [len(unique)]))
                own = np.flatnonzero(np.diff(cuts))
                parts = [slice(cuts[k], cuts[k + 1]) for k in own]
                yield batch_of(BULK, own, np.full(len(own), row["block"]), [unique[x].tobytes() for x in parts], [packed(count[x]) for x in parts])

    def counted(rows: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in rows.column("h").to_pylist()]
        count = np.concatenate([unpacked(x, len(h)) for x, h in zip(rows.column("c").to_pylist(), hashes, strict=True)])
        h = np.concatenate(hashes)
        order = np.argsort(h)
        ordered = h[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        total = np.empty(len(h), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], starts), np.diff(np.append(starts, len(h))))
        ends = np.cumsum([len(x) for x in hashes]).tolist()
        raw = [packed(total[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        made = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
        sizes, lens = [len(x) for x in raw], [len(x) for x in hashes]
        return pa.Table.from_batches([batch_of(TOTALS, rows.column("block").combine_chunks(), np.full(len(lens), n), rows.column("bucket").combine_chunks(), lens, sizes, made)])

    return written(blocked.mapInArrow(grams, BULK).groupBy("bucket").applyInArrow(counted, TOTALS), name)


def unpacked_totals(rows: list[dict]) -> np.ndarray:
    """The totals of a block's distinct n-grams of one size, in the order of their hashes, from its rows of bulk_totals()."""
    ordered = sorted(rows, key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(pa.decompress(r["totals"], r["size"], codec="zstd", asbytes=True), r["n"]) for r in ordered)])


def totals(unique: np.ndarray, count: np.ndarray, reply: pa.Table) -> np.ndarray:
    """Totals of a block's distinct n-grams, which are sorted, from its own counts and the replies to it."""
    out = count.astype(np.int64)
    out[np.searchsorted(unique, reply.column("h").to_numpy().view(np.uint64))] = reply.column("total").to_numpy()
    return out
