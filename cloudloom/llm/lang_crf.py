"""Language identification of words by a linear-chain conditional random field.

Each word of a text is labelled with a language. Features of a word, hashed into weight tables: character n-grams
(bigrams and trigrams of its bytes, with the word's edges), affixes (first and last three bytes with an edge, first and
last four), and the word itself, with weights only for words of the lexicon, the frequent words of the training sample.
A learned transition matrix links neighbouring words; forward-backward gives each word's posterior. A text's language
is the one with the largest mean posterior over all its words, which is also the score.

Training. A document's words all carry its language. The sample is the ``train_docs`` documents of each language with
the least hash of their text, among those of up to ``train_bytes`` bytes; where these are too few, the rest are passages of
at most ``train_bytes`` bytes of longer ones, from their first letter on. Every non-null lang is learned. Code-switched sequences are made by joining runs
of words of different documents, so that transitions are learned from switches; weights and transitions maximise the
conditional likelihood, with an L2 penalty, by full-batch steps of adaptive size. From SEQUENCE_LANGUAGES languages
on, sequences grow with the languages, so that each keeps its share of words.

Edge cases. Null text and text without a letter: ``und`` with score 0. Documents with null lang are not learned from.
With no document to learn from, every text is ``und``. Null and repeated doc_ids: each row is predicted by itself.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel

UNKNOWN = "und"
SEQUENCE_LANGUAGES = 64
GRAM_BITS, WORD_BITS = 16, 16
RESULT = "doc_id long, lang_pred string, score double, n_words long"


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # [2^GRAM_BITS, languages]: byte bigrams and trigrams
    words: np.ndarray  # [3 * 2^WORD_BITS, languages]: lexicon, first and last four bytes
    moves: np.ndarray  # [languages, languages]: transition scores
    starts: np.ndarray


def _slots(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - bits)).astype(np.int64)


def features(words: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram slots in order, where each word's begin, their end, word-level slots [words, 3])."""
    data = words.data.astype(np.uint32)
    data[kernel.separators("word")[words.data]] = 0x20
    padded = np.concatenate((np.full(4, 0x20, np.uint32), data, np.full(4, 0x20, np.uint32)))
    at = 4 + np.arange(len(data) + 1)
    two = padded[at] | padded[at - 1] << np.uint32(8)
    three = two | padded[at - 2] << np.uint32(16)
    # texts follow each other without a gap: the byte after a word at the end of its text counts as an edge
    ends = words.ends
    grams = np.stack((_slots(two, GRAM_BITS), _slots(three | np.uint32(1 << 24), GRAM_BITS)), axis=1)
    edge2 = padded[ends + 3] << np.uint32(8) | np.uint32(0x20)
    before = np.where(ends - words.starts > 1, padded[ends + 2], np.uint32(0x20))
    tail = np.stack((_slots(edge2, GRAM_BITS), _slots(edge2 | before << np.uint32(16) | np.uint32(1 << 24), GRAM_BITS)), axis=1)
    head2 = padded[words.starts + 4] | np.uint32(0x20 << 8)
    head = np.stack((_slots(head2, GRAM_BITS), _slots(head2 | np.uint32(0x20 << 16 | 1 << 24), GRAM_BITS)), axis=1)
    second = words.starts[ends - words.starts > 1] + 1
    grams[second, 1] = _slots(two[second] | np.uint32(0x20 << 16 | 1 << 24), GRAM_BITS)
    grams[words.starts] = head
    # one gram row for each byte of a word and one for its end
    lens = ends - words.starts + 1
    begin = np.cumsum(lens) - lens
    source = np.arange(int(lens.sum())) + np.repeat(words.starts - begin, lens)
    last = begin + lens - 1
    source[last] = 0
    rows = grams[source]
    rows[last] = tail
    h = words.hashes(lower=False)
    size, shift = 1 << WORD_BITS, np.uint64(64 - WORD_BITS)
    span = np.minimum(ends - words.starts, 4)
    affix = np.zeros((2, len(ends)), np.uint64)
    for k in range(4):
        inside = k < span
        affix[0] = affix[0] * np.uint64(257) + np.where(inside, padded[words.starts + 4 + np.minimum(k, span - 1)], 0).astype(np.uint64)
        affix[1] = affix[1] * np.uint64(257) + np.where(inside, padded[ends + 3 - np.minimum(k, span - 1)], 0).astype(np.uint64)
    affix = (kernel.mix(affix.reshape(-1)) >> shift).astype(np.int64).reshape(2, -1)
    level = np.stack(((h >> shift).astype(np.int64), size + affix[0], 2 * size + affix[1]), axis=1)
    return rows, begin, begin + lens, level


def word_scores(words: kernel.Words, model: Model) -> np.ndarray:
    """[words, languages]: the sum of each word's feature weights."""
    if not len(words.starts):
        return np.zeros((0, len(model.languages)), np.float32)
    rows, begin, _, level = features(words)
    grams = model.grams[rows[:, 0]] + model.grams[rows[:, 1]]
    return np.add.reduceat(grams, begin, axis=0) + model.words[level].sum(axis=1)


def posteriors(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray, want_moves: bool = False):
    """Forward-backward over sequences first[i]..first[i + 1] of scores: posterior of each word, log likelihood terms, and
    the expected moves. Sequences advance together, longest first, so a step costs one small matrix product."""
    n, k = scores.shape
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    longest = int(lens.max()) if len(lens) else 0
    active = np.searchsorted(-lens[order], -np.arange(longest), "left")  # sequences longer than t
    base = np.concatenate(([0], np.cumsum(active)))
    seq = np.repeat(np.arange(len(lens)), lens)
    packed = base[np.arange(n) - first[seq]] + rank[seq]
    shifted = scores - scores.max(axis=1, keepdims=True)
    e = np.empty((n, k))
    e[packed] = np.exp(shifted)
    t = np.exp(moves - moves.max())
    alpha, norm = np.empty((n, k)), np.empty(n)
    for i in range(longest):
        a, b = base[i], base[i + 1]
        x = (np.exp(starts - starts.max()) if i == 0 else alpha[base[i - 1] : base[i - 1] + b - a] @ t) * e[a:b]
        s = x.sum(axis=1)
        alpha[a:b], norm[a:b] = x / s[:, None], s
    gamma, expected = alpha, np.zeros((k, k))
    beta = np.ones((0, k))
    for i in range(longest - 1, 0, -1):
        a, b = base[i], base[i + 1]
        full = np.ones((b - a, k))
        full[: len(beta)] = beta
        weighed = full * e[a:b] / norm[a:b, None]
        before = slice(base[i - 1], base[i - 1] + b - a)
        if want_moves:
            expected += t * (alpha[before].T @ weighed)
        gamma[a:b] *= full
        beta = weighed @ t.T
    if longest:
        gamma[: len(beta)] *= beta
    out = gamma[packed]
    return out / out.sum(axis=1, keepdims=True), expected


def train(texts: list[str], langs: list[str], steps: int = 60, run_words: int = 12, length: int = 64, sequences: int = 1500, lexicon: int = 2000, penalty: float = 0.02) -> Model | None:
    """The model of a sample of texts with languages."""
    languages = sorted(set(langs))
    texts_low = pc.utf8_lower(pa.array(texts, pa.string()))
    data, offsets = kernel.texts_of(texts_low)
    words = kernel.Words(data, offsets, kernel.separators("word"))
    k, n = len(languages), len(words.starts)
    if not n:
        return None
    sequences = max(sequences, sequences * k // SEQUENCE_LANGUAGES)
    rng = np.random.default_rng(7)
    of_doc = np.repeat([languages.index(x) for x in langs], np.diff(words.first))
    # code-switched sequences: runs of random length from random places, languages equally often
    places = [np.flatnonzero(of_doc == y) for y in range(k)]
    places = [p for p in places if len(p)]
    picks = []
    for _ in range(sequences):
        own: list[np.ndarray] = []
        while sum(map(len, own)) < length:
            p = places[rng.integers(len(places))]
            at, run = rng.integers(len(p)), rng.geometric(1 / run_words)
            own.append(p[at : at + run])
        picks.append(np.concatenate(own)[:length])
    seq = np.concatenate(picks)
    labels, first = of_doc[seq], np.arange(sequences + 1) * length
    h = words.hashes(lower=False)
    unique, index, inverse = np.unique(h, return_index=True, return_inverse=True)
    used = np.unique(inverse[seq], return_inverse=True)
    word_of = used[1]
    rows, begin, end, level = features(words)
    chosen = index[used[0]]
    frequent = np.isin(used[0], np.argsort(-np.bincount(inverse))[:lexicon])
    grams_of = np.concatenate([rows[begin[i] : end[i]].reshape(-1) for i in chosen])
    gram_word = np.repeat(np.arange(len(chosen)), 2 * (end - begin)[chosen])
    level = level[chosen]
    model = Model(languages, np.zeros((1 << GRAM_BITS, k)), np.zeros((3 << WORD_BITS, k)), np.zeros((k, k)), np.zeros(k))
    truth = np.eye(k)[labels]
    inner = np.arange(len(seq)) % length > 0
    began = truth[~inner].sum(axis=0)
    moved = np.zeros((k, k))
    np.add.at(moved, (labels[:-1][inner[1:]], labels[1:][inner[1:]]), 1)
    speed = [np.full_like(w, 1e-6) for w in (model.grams, model.words, model.moves, model.starts)]
    cuts = np.flatnonzero(np.diff(gram_word, prepend=-1))
    for _ in range(steps):
        per_word = np.add.reduceat(model.grams[grams_of], cuts, axis=0) + model.words[level[:, 1:]].sum(axis=1)
        per_word[frequent] += model.words[level[frequent, 0]]
        gamma, expected = posteriors(per_word[word_of], first, model.moves, model.starts, want_moves=True)
        miss = truth - gamma
        by_word = np.stack([np.bincount(word_of, miss[:, y], len(chosen)) for y in range(k)], axis=1)
        spread = by_word[gram_word]
        d_grams = np.stack([np.bincount(grams_of, spread[:, y], 1 << GRAM_BITS) for y in range(k)], axis=1)
        d_words = np.zeros_like(model.words)
        for c in range(3):
            rowset = frequent if c == 0 else slice(None)
            np.add.at(d_words, level[rowset, c], by_word[rowset])
        for w, d, s in zip((model.grams, model.words, model.moves, model.starts), (d_grams, d_words, moved - expected, began - gamma[~inner].sum(axis=0)), speed, strict=True):
            d = d - penalty * w
            s += d * d
            w += 0.3 * d / np.sqrt(s)
    lexical = np.zeros(1 << WORD_BITS, bool)
    lexical[level[frequent, 0]] = True
    model.words[: 1 << WORD_BITS][~lexical] = 0
    return Model(languages, model.grams.astype(np.float32), model.words.astype(np.float32), model.moves, model.starts)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    seen = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def labeller(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seps = shared.value, kernel.separators("word")
        for batch in batches:
            ids = batch.column(0)
            lowered = pa.RecordBatch.from_arrays([ids, pc.utf8_lower(batch.column(1))], names=["doc_id", "text"])
            for rows, data, offsets in kernel.chunks(lowered, size=1 << 20):
                words = kernel.Words(data, offsets, seps)
                has, n = _has_letter(data, offsets), np.diff(words.first)
                langs, score = np.full(len(n), UNKNOWN, object), np.zeros(len(n))
                if model is not None and len(words.starts):
                    gamma, _ = posteriors(word_scores(words, model).astype(np.float64), words.first, model.moves, model.starts)
                    sums = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma, axis=0)))
                    mean = (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(n, 1)[:, None]
                    ok = has & (n > 0)
                    langs[ok] = np.array(model.languages, object)[mean.argmax(axis=1)[ok]]
                    score[ok] = np.clip(mean.max(axis=1)[ok], 0, 1)
                columns = [ids[rows], pa.array(langs.tolist(), pa.string()), pa.array(score), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "n_words"])

    return run


def sample(docs: DataFrame, train_docs: int, train_bytes: int) -> list:
    """At most train_docs rows (text, lang) of each language, of at most train_bytes bytes; longer texts where short ones are too few."""
    full = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("long", (F.octet_length("text") > train_bytes).cast("int"))
    sizes = full.groupBy("lang").agg(F.sum(1 - F.col("long")).alias("n"), F.sum("long").alias("n_long"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    # twice the share that is needed reaches the ranking, whatever the size of the input
    share = F.least(F.lit(1.0), 2.0 * train_docs / F.when(F.col("long") == 0, F.col("n")).otherwise(F.col("n_long")) + 1e-9)
    near = full.join(F.broadcast(sizes), "lang")  # a row a language, as the model has
    near = near.where(((F.col("long") == 0) | (F.col("n") < train_docs)) & (h < share * float(1 << 40)))
    passage = F.regexp_extract("text", r"\p{L}[\s\S]{0,%d}" % max(0, train_bytes // 4 - 1), 0)
    near = near.select(F.when(F.col("long") == 0, F.col("text")).otherwise(passage).alias("text"), "lang", "n", "long", h.alias("h"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text")))
    rows = ranked.where(F.col("rank") <= train_docs).collect()
    return sorted(rows, key=lambda r: (-r["n"], r["lang"], r["rank"]))


def predict(docs: DataFrame, learn: Column, train_docs: int = 150, train_bytes: int = 20_000) -> DataFrame:
    """(doc_id, lang_pred, score, n_words) of each row; learn says which rows may be learned from."""
    rows = sample(docs.where(learn).select("doc_id", "text", "lang"), train_docs, train_bytes)
    model = train([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(labeller(shared), RESULT)
