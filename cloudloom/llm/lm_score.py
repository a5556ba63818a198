"""Stupid-backoff language-model scores: n-gram count tables by hash, joined to exploded n-grams, summed per document.

The score of word i is log(c(w[i-n+1..i]) / c(w[i-n+1..i-1])) for the longest n up to ``order`` whose n-gram occurs
at least ``min_count`` times in all documents, with log(alpha) added for each order that was skipped; words alone have
c(w) / N, N the words of all documents. A document's score is the sum over its words.

The documents scored are those counted, so a count of one is the place that is scored itself: ``min_count`` is 2, or what
nothing else has would be sure. Every order has its own n-gram rows and counts, kept in bulk by block and range of hashes
(see ngram_rows.bulk_totals). A block then meets the totals of its n-grams of all orders, and each document's places are summed.

Words are white-space separated, A-Z lower-cased. Edge cases. Null or empty text: no words, log_score 0, mean null.
Repeated rows and doc_ids are documents of their own. Null doc_ids are kept. An empty table gives an empty result. Extra
columns are ignored. N-grams are 64-bit hashes: of n different ones, about n^2 / 2^65 pairs are counted together.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_rows import batch_of, block_words, blocks, bulk_totals, doc_ids, grams_ending, unpacked_totals

#: Smaller than those of other operators: a task holds a block with the counts of each of its words.
BLOCK_BYTES = 8 << 20
SCORES = "doc_id long, n_words long, n_backoff long, log_score double"
#: Words of all documents to each range of hashes that n-grams are counted in; as many n-grams of an order at most.
BUCKET_WORDS = 1 << 21


def grams_of_order(n: int):
    """A block's n-grams of n words, each as often as it occurs."""

    def grams(row: dict) -> np.ndarray:
        full, has = grams_ending(*block_words(row), n)
        return full[has]

    return grams


def word_scores(counts: list[np.ndarray], place: np.ndarray, total: int, alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, orders skipped) of each word; counts[n - 1] are those of the n-grams that end there, place the words before."""
    best = np.minimum(place, len(counts) - 1)  # the highest order that fits, from 0
    score, level = np.log(np.maximum(counts[0], 1) / max(total, 1)), np.zeros(len(place), np.int64)
    for n in range(1, len(counts)):
        context = np.concatenate(([1], counts[n - 1][:-1]))[: len(place)]
        ok = (counts[n] >= min_count) & (best >= n)
        score, level = np.where(ok, np.log(np.maximum(counts[n], 1) / np.maximum(context, 1)), score), np.where(ok, n, level)
    return score + math.log(alpha) * (best - level), best - level


def scorer(order: int, total: int, alpha: float, min_count: int):
    def run(block: pa.Table, reply: pa.Table) -> pa.Table:
        replied, out = reply.to_pylist(), []
        for row in block.to_pylist():
            h, first = block_words(row)
            counts = []
            for n in range(1, order + 1):
                full, has = grams_ending(h, first, n)
                inverse = np.unique(full[has], return_inverse=True)[1]
                every = np.zeros(len(h), np.int64)
                every[has] = unpacked_totals([r for r in replied if r["ord"] == n])[inverse]
                counts.append(every)
            place = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            score, skipped = word_scores(counts, place, total, alpha, min_count)
            sums = [float(score[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
            backs = np.concatenate(([0], np.cumsum(skipped > 0)))
            out.append(batch_of(SCORES, doc_ids(row), np.diff(first), backs[first[1:]] - backs[first[:-1]], sums))
        return pa.Table.from_batches(out or [batch_of(SCORES, [], [], [], [])])

    return run


def scored(docs: DataFrame, order: int = 3, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, n_words, n_backoff, log_score, mean_score) of each row of docs; n_backoff counts words that skip an order."""
    blocked = blocks(docs, BLOCK_BYTES)
    total = blocked.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    # one order after the other, for less disk at once
    parts = [bulk_totals(blocked, n, max(16, total // BUCKET_WORDS), f"totals{n}") for n in range(order, 0, -1)]
    replied = functools.reduce(DataFrame.unionByName, parts)
    found = blocked.groupBy("block").cogroup(replied.groupBy("block")).applyInArrow(scorer(order, total, alpha, min_count), SCORES)
    return found.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
