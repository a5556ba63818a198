"""Repeated passages by sparse suffix arrays: minimiser suffixes, sorted, compared with neighbours; the rest by hash.

1. In every run of ``min_words - K + 1`` consecutive K-word grams of a text, the gram with the least hash is retained
   (the first of equals). The choice depends on content alone, so each window of ``min_words`` words has one gram that is
   its own, and all copies of the window have the same one at the same place.
2. The retained suffixes carry 32-bit hashes of the words around their gram, as far as a window of ``min_words`` words
   through the gram can reach, and which windows are the gram's own. Suffixes of a document that are equal in all this,
   as in a run of one word, are one row with many places.
3. The rows are range-sorted by gram and words to the right; those that may repeat are written and range-sorted by gram
   and words to the left. A gram that very many documents share is split over partitions by what surrounds it.
4. Each suffix is compared with the nearest suffix of another document on either side of it. A window that one of the
   two shares is found. The most words that they share in the sorted direction bound what any other document shares, so
   a window beyond that bound cannot repeat; a gram that one document alone holds ends here. At the ends of a partition
   the bound is not known, and none is set.
5. Windows that are neither found nor ruled out are left open. All windows of their grams are joined with them and
   grouped by hash, and the open ones that several documents hold are found as well. So no repeat is missed, whatever
   the number of partitions.
6. Found windows are united to spans of each document.

So a passage costs rows in proportion to its copies; there are no pairs of documents. Words are white-space separated,
A-Z lower-cased; repeats within one document alone do not count.

Edge cases. Null, empty and short texts have no spans and no row in the result. Rows that share a doc_id count as one
document. Null doc_ids count as one document and are returned as null. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .shared import written

K = 12
#: places are the gram's positions, 32 bits each.
ANCHOR = "key long, doc_id long, places binary, rightward binary, leftward binary, least int, most int"
#: may and found are bit rows: the own windows that start a words before the gram, for a = 0..min_words - K.
ROW = "key long, doc_id long, places binary, rightward binary, leftward binary, may binary, found binary"
#: A span, or with h an open window: lo..hi of doc_id, its gram and the hash of the words around it.
SPAN = "doc_id long, lo int, hi int, key long, h long"
WINDOW = "key long, h long, doc_id long"
NONE = np.iinfo(np.int64).min  # stands for a null doc_id in the workers


def retained(words: kernel.Words, h: np.ndarray, min_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, positions of retained grams in the words of all texts, their hashes, least and most words before them in their own windows)."""
    grams, width = kernel.ngrams(h, K), min_words - K + 1
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a >= min_words:
            own = grams[a : b - K + 1]
            picks = np.lib.stride_tricks.sliding_window_view(own, width).argmin(axis=1) + np.arange(len(own) - width + 1)
            first = np.flatnonzero(np.concatenate(([True], picks[1:] != picks[:-1])))
            last = np.append(first[1:], len(picks)) - 1
            picks = picks[first]
            yield i, picks + a, own[picks], picks - last, picks - first


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _hashed(batches: Iterator[pa.RecordBatch]):
    seps = kernel.separators("space")
    for batch in batches:
        ids = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)
        for rows, data, offsets in kernel.chunks(batch):
            words = kernel.Words(data, offsets, seps)
            yield ids[rows], words, words.hashes(lower=True)


def suffixes(min_words: int):
    """The retained suffixes with the words around their gram; leftward is read from the gram outwards."""
    reach = min_words - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, words, h in _hashed(batches):
            short, rows, places = (h >> np.uint64(32)).astype(">u4"), [], []
            for i, at, keys, least, most in retained(words, h, min_words):
                a, b = int(words.first[i]), int(words.first[i + 1])
                back, seen = short[a:b][::-1], {}
                for p, *own in zip(at.tolist(), keys.view(np.int64).tolist(), least.tolist(), most.tolist(), strict=True):
                    row = (own[0], ids[i], short[p + K : min(p + K + reach, b)].tobytes(), back[b - p : b - p + reach].tobytes(), *own[1:])
                    if row in seen:
                        places[seen[row]].append(p - a)
                    else:
                        seen[row] = len(rows)
                        rows.append(row)
                        places.append([p - a])
            for k in range(0, len(rows), 20_000):
                key, doc, right, left, least, most = zip(*rows[k : k + 20_000], strict=True)
                yield _batch(ANCHOR, key, doc, [np.array(x, np.int32).tobytes() for x in places[k : k + 20_000]], right, left, least, most)

    return run


def _context(column: pa.Array, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x reach words, zero beyond each row's own; how many are its own)."""
    blobs = column.to_pylist()
    full = b"".join(x.ljust(4 * reach, b"\0") for x in blobs)
    return np.frombuffer(full, np.uint32).reshape(len(blobs), reach), np.array([len(x) // 4 for x in blobs])


def _common(words: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words rows i and j have in common, from the first on."""
    differ = words[i] != words[j]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1])
    return np.minimum(first, np.minimum(own[i], own[j]))


def _bits(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of flags from rows of bits."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=width).view(bool)


def _packed(flags: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.packbits(flags, axis=1)], pa.binary())


def compared(rows: pa.Table, min_words: int, chain: str, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """(which own windows of the sorted rows another document may hold, which it surely does), by the nearest rows of
    another document; first and last say that the first and the last run of rows of a document have no bound."""
    reach, n = min_words - K, len(rows)
    key, doc = rows.column("key").to_numpy(), rows.column("doc_id").to_numpy()
    right, n_right = _context(rows.column("rightward"), reach)
    left, n_left = _context(rows.column("leftward"), reach)
    a = np.arange(reach + 1)
    if chain == "rightward":
        may = (a >= rows.column("least").to_numpy()[:, None]) & (a <= rows.column("most").to_numpy()[:, None])
        found = np.zeros_like(may)
    else:
        may, found = _bits(rows.column("may"), reach + 1), _bits(rows.column("found"), reach + 1)
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])))
    run = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), n)
    row, bound, shared = np.arange(n), np.full(n, -1), np.zeros_like(may)
    for other in (starts[run] - 1, starts[run + 1]):
        ok = (other >= 0) & (other < n)
        i, j = row[ok], other[ok]
        same = key[i] == key[j]
        i, j = i[same], j[same]
        to_left, to_right = _common(left, n_left, i, j), _common(right, n_right, i, j)
        shared[i] |= (a <= to_left[:, None]) & (reach - a <= to_right[:, None])
        bound[i] = np.maximum(bound[i], to_right if chain == "rightward" else to_left)
    if first:
        bound[run == 0] = reach
    if last:
        bound[run == run[-1]] = reach
    found |= shared & may
    return may & ((reach - a if chain == "rightward" else a) <= bound[:, None]), found


def _hashes(rows: pa.Table, wanted: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, words before the gram, hash of the words around it) of the wanted windows."""
    reach = min_words - K
    factors = np.random.default_rng(20240301).integers(0, 1 << 63, 2 * reach + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    sums = []
    for column, f in (("leftward", factors[:reach]), ("rightward", factors[reach : 2 * reach])):
        words = _context(rows.column(column), reach)[0].astype(np.uint64)
        sums.append(np.concatenate((np.zeros((len(rows), 1), np.uint64), np.cumsum(kernel.mix(words + np.uint64(1)) * f, axis=1, dtype=np.uint64)), axis=1))
    i, a = np.nonzero(wanted)
    return i, a, kernel.mix(sums[0][i, a] + sums[1][i, reach - a] + a.astype(np.uint64) * factors[-1]).view(np.int64)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    made = [pa.array(c, kinds[x.split()[1]]) for c, x in zip(columns, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(made, names=_names(schema))


def _rows(rows: pa.Table, may: np.ndarray, found: np.ndarray, min_words: int) -> Iterator[pa.RecordBatch]:
    """The rows with a window that may repeat."""
    some = may.any(axis=1)
    columns = [rows.column(c).combine_chunks().filter(pa.array(some)) for c in ("key", "doc_id", "places", "rightward", "leftward")]
    yield _batch(ROW, *columns, _packed(may[some]), _packed(found[some]))


def _spans(rows: pa.Table, may: np.ndarray, found: np.ndarray, min_words: int) -> Iterator[pa.RecordBatch]:
    """Runs of found windows as spans, and the open windows, at every place of their rows."""
    key, doc = (rows.column(c).to_numpy() for c in ("key", "doc_id"))
    blobs = rows.column("places").to_pylist()
    many, every = np.array([len(x) // 4 for x in blobs]), np.frombuffer(b"".join(blobs), np.int32)
    begin = np.cumsum(many) - many

    def placed(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of i, position) of each place of the rows i."""
        which = np.repeat(np.arange(len(i)), many[i])
        own = np.arange(len(which)) - np.repeat(np.cumsum(many[i]) - many[i], many[i])
        return which, every[begin[i][which] + own]

    step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    (i, least), (_, end) = np.nonzero(step == 1), np.nonzero(step == -1)
    which, pos = placed(i)
    yield _batch(SPAN, doc[i[which]], pos - end[which] + 1, pos - least[which] + min_words, key[i[which]], pa.nulls(len(pos), pa.int64()))
    left = may & ~found
    some = left.any(axis=1)
    if some.any():
        i, a, h = _hashes(rows.filter(pa.array(some)), left[some], min_words)
        i = np.flatnonzero(some)[i]
        which, pos = placed(i)
        yield _batch(SPAN, doc[i[which]], pos - a[which], pos - a[which] + min_words, key[i[which]], h[which])


def compare(min_words: int, chain: str):
    """Rows sorted by right context: those that may repeat. Rows sorted by left context: spans and open windows."""
    made = _rows if chain == "rightward" else _spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, skip = None, True, 0
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            if held is not None:  # the last run of rows of one document and gram, and the row before it, meet the new rows
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            key, doc = table.column("key").to_numpy(), table.column("doc_id").to_numpy()
            change = np.flatnonzero((key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
            to = int(change[-1]) + 1 if len(change) else 0  # the last run waits for what follows it
            if to > skip:
                may, found = compared(table, min_words, chain, first, False)
                yield from made(table.slice(skip, to - skip), may[skip:to], found[skip:to], min_words)
                first, held, skip = False, table.slice(to - 1), 1
            else:
                held = table
        if held is not None:
            may, found = compared(held, min_words, chain, first, True)
            yield from made(held.slice(skip), may[skip:], found[skip:], min_words)

    return run


def windows(min_words: int):
    """The windows, by gram and hash, of rows sorted by right context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_batches([batch])
                i, _, h = _hashes(rows, _bits(rows.column("may"), min_words - K + 1), min_words)
                yield _batch(WINDOW, rows.column("key").to_numpy()[i], h, rows.column("doc_id").to_numpy()[i])

    return run


def united(spans: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word): overlapping and touching spans (doc_id, lo, hi) of each document as one."""
    ordered = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reached = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("lo") <= reached, 0).otherwise(1)).withColumn("run", F.sum("new").over(ordered))
    return marked.groupBy("doc_id", "run").agg(F.min("lo").cast("long").alias("start_word"), F.max("hi").cast("long").alias("end_word")).drop("run")


def repeated_spans(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, start_word, end_word) of each span whose every part lies in a passage that another document repeats."""
    if min_words < K:
        raise ValueError(f"min_words must be at least {K}")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = docs.mapInArrow(suffixes(min_words), ANCHOR)
    for chain, other, schema in (("rightward", "leftward", ROW), ("leftward", "rightward", SPAN)):
        by = ["key", chain, "doc_id", other]
        ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
        before, rows = rows, written(ordered.mapInArrow(compare(min_words, chain), schema), chain)
    left = rows.where(F.col("h").isNotNull())
    wanted = written(left.select("key", "h").distinct(), "open")
    held = before.join(wanted.select("key"), "key", "left_semi").mapInArrow(windows(min_words), WINDOW).join(wanted, ["key", "h"], "left_semi")
    held = held.groupBy("key", "h").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("key", "h")
    left = left.join(written(held, "held"), ["key", "h"], "left_semi")
    found = rows.where(F.col("h").isNull()).select("doc_id", "lo", "hi").unionByName(left.select("doc_id", "lo", "hi"))
    found = found.groupBy("doc_id", "lo").agg(F.max("hi").alias("hi"))
    return united(found).withColumn("doc_id", F.when(F.col("doc_id") != NONE, F.col("doc_id")))
