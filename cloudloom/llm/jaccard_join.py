"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

Two texts link when den * |A & B| >= num * |A | B|, A and B their sets of distinct word shingles.

1. Every shingle's documents are counted over the whole corpus (ngram_rows): exact counts, by hash partitions that grow
   with the input. Shingles of one document can be in no overlap; they rank first and need no row.
2. Texts with equal sets form a class; classes are joined, not texts, so copies cost one row each.
3. Shingles are ordered rare first, ties by hash. The first n - ceil(num/den * n) + 1 shingles of each class, its prefix,
   become rows (token, class). Lists of one class leave at once.
4. Lists of up to SHORT classes give all their pairs that pass the length and positional filters. The two filters bound
   the size of a class's partners from both sides, so a longer list is dealt out by size: a class is at home in the list
   of its own size's step (STEP), and visits those of larger ones up to its bound; classes that no other is near enough
   in size for leave. A list still longer than SHORT is worked through in rounds: a few of its classes, those of the
   smallest connected groups and then with the least shingles before the common one, so with the least changes, are
   compared with every other class that is not yet known to be connected with them, and are then done. Each round takes
   twice as many, from PIVOTS[0] to PIVOTS[1]. A list is closed once all its classes are connected. So a group of near
   copies costs rows in proportion to its size.
5. Lists still open after ROUNDS rounds are split: two sets whose first common token is t share a second one among the
   first n - ceil(num/den * n) + 1 shingles, and one more, that follow. Lists by such pairs of tokens are worked through
   as before, now until all are closed. No list ever gives all its pairs, and no pair is left out unless both sides are
   connected already.
6. Each pair is verified once: by the suffix filter (the bound on the overlap from counts by hash range, which every
   class carries as BUCKETS bytes), and, for the few pairs that pass it, by the exact intersection of their sets, of
   which only shingles of several documents are kept. Components of the verified links follow.

A text with fewer words than ``size`` has its whole sequence as one shingle; a text without words, or null, has none
and links with nothing. Rows that share a doc_id are apart, but meet through it in component_id only if they link.
Null doc_ids link like others and are never a component's smallest id; a component of null ids has a null id. Extra
columns are ignored. An empty table gives an empty result. Shingles are 64-bit hashes, classes have 128 bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .components import components, near_labels
from .ngram_rows import block_words, blocks, doc_ids, totals, written_replies
from .shared import written

SHORT = 16
ROUNDS = 2
STEP = 1.03
PIVOTS = (32, 1024)
BUCKETS = 64
PROFILE = "doc_id long, n int, cid binary, sig binary, shared binary, prefix array<struct<token:bigint,pos:int>>"


def shingle_sets(row: dict, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    h, first = block_words(row)
    grams = kernel.ngrams(h, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            yield kernel.ngrams(h[a:b], b - a) if b > a else h[:0]


def signature(shingles: np.ndarray) -> bytes:
    """Counts by hash range, 255 meaning that many or more."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=BUCKETS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def needed(n: int, num: int, den: int) -> int:
    """The least overlap of a set of n shingles with any set it links with."""
    return (num * n + den - 1) // den


def profiles(size: int, num: int, den: int):
    """PROFILE of a block's texts; sig, shared and prefix, up to the shingle after it, of the first text of each class that
    has a prefix token of several documents."""
    tokens = pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(block: pa.Table, reply: pa.Table) -> pa.Table:
        tables = []
        for row in block.to_pylist():
            sets = list(shingle_sets(row, size))
            unique, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            total, at, seen, out = totals(unique, count, reply)[inverse], 0, set(), []
            places, held, ends = [], [], [0]
            for s in sets:
                n, t = len(s), total[at : at + len(s)]
                at += n
                cid, several = hashlib.blake2b(s.tobytes(), digest_size=16).digest(), t > 1
                prefix = n - needed(n, num, den) + 1
                if cid in seen or not n or n - several.sum() >= prefix:
                    out.append((n, cid, None, None))
                    ends.append(None)
                    continue
                seen.add(cid)
                own, alone = s[several], n - int(several.sum())
                first = np.lexsort((own, t[several]))[: prefix + 1 - alone]
                held.append(own[first].view(np.int64))
                places.append(np.arange(alone, alone + len(first), dtype=np.int32))
                ends.append(len(first))
                out.append((n, cid, signature(own), own.tobytes()))
            made = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in ((held, pa.int64()), (places, pa.int32()))], names=["token", "pos"])
            offsets = np.cumsum([e or 0 for e in ends])
            prefixes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made, mask=pa.array([e is None for e in ends[1:]]))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            tables.append(pa.table([doc_ids(row), *columns, prefixes.cast(tokens)], names=["doc_id", "n", "cid", "sig", "shared", "prefix"]))
        return pa.concat_tables(tables) if tables else pa.schema([("doc_id", pa.int64()), *zip(("n", "cid", "sig", "shared"), kinds, strict=True), ("prefix", tokens)]).empty_table()

    return run


def suffix_filter(num: int, den: int):
    """Pairs (a, b) of the columns a, b, m, n, x, y whose sizes m, n and counts x, y by hash range allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS) for k in (4, 5))
            least = np.minimum(x, y)
            bound = np.where((least == 255).any(axis=1), np.minimum(m, n), least.sum(axis=1, dtype=np.int64))
            yield batch.select([0, 1, 2, 3]).filter(pa.array((num + den) * bound >= num * (m + n)))

    return run


def verifier(num: int, den: int):
    """Pairs (a, b) of the columns a, b, m, n, x, y whose shared shingles x, y make a link of sets of m and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, n = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            same, left, right = np.zeros(len(batch), np.int64), batch.column(4), batch.column(5)
            for i in range(len(batch)):
                both = np.sort(np.concatenate((np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64))))
                same[i] = (both[1:] == both[:-1]).sum()
            yield batch.select([0, 1]).filter(pa.array((num + den) * same >= num * (m + n)))

    return run


def _may_link(x: str, y: str, num: int, den: int) -> str:
    """Length filter and positional filter, for a shingle at pos of two classes whose columns have the prefixes x and y."""
    return (
        f"{den}L * least({x}n, {y}n) >= {num}L * greatest({x}n, {y}n) AND "
        f"{num + den}L * least({x}n - {x}pos, {y}n - {y}pos) >= {num}L * ({x}n + {y}n)"
    )


class Join:
    """The work on one table of classes: (cid, n, sig, shared, prefix), written."""

    def __init__(self, classes: DataFrame, num: int, den: int):
        self.classes, self.num, self.den = classes, num, den
        self.links: DataFrame | None = None
        self.label: DataFrame | None = None

    def short_pairs(self, sized: DataFrame) -> DataFrame:
        lists = sized.where(F.col("size") <= SHORT).groupBy("token").agg(F.collect_list(F.struct("cid", "n", "pos")).alias("l"))
        inner = f"transform(filter(slice(l, i + 2, {SHORT}), y -> {_may_link('x.', 'y.', self.num, self.den)}), y -> struct(least(x.cid, y.cid) AS a, greatest(x.cid, y.cid) AS b))"
        return lists.select(F.explode(F.expr(f"flatten(transform(l, (x, i) -> {inner}))")).alias("p")).select("p.*")

    def by_size(self, sized: DataFrame) -> DataFrame:
        """Entries of long lists in the lists of their sizes: token is that list, of the one that whole was."""
        step = lambda n: f"cast(floor(ln(greatest({n}, 1)) / ln({STEP}D)) as int)"
        bound = f"least(({self.num + self.den}L * (n - pos)) div {self.num} - n, ({self.den}L * n) div {self.num})"
        rows = sized.where(F.col("size") > SHORT).select(F.col("token").alias("whole"), "cid", "n", "pos", F.expr(bound).alias("top"))
        rows = rows.withColumn("own", F.expr(step("n"))).withColumn("g", F.expr(f"explode(sequence(own, greatest(own, {step('top')})))"))
        rows = rows.select(F.xxhash64("whole", "g").alias("token"), "whole", "cid", "n", "pos", "top", (F.col("g") == F.col("own")).alias("home"))
        lists = rows.groupBy("token").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max(F.when(F.col("home"), F.col("top"))).alias("most"))
        lists = written(lists.where("size > 1 AND most >= least").select("token", "size", "least"), "lists")
        return written(rows.join(lists, "token").withColumn("home", F.expr("home AND top >= least")), "bysize")

    def opened(self, rest: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
        """(entries of lists that are not closed, with label; classes p_cid of the lists that the others are to meet)."""
        if self.label is None:
            known = rest.withColumn("label", F.col("cid"))
        else:
            known = rest.join(self.label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        groups = known.groupBy("token", "label").agg(F.count("*").alias("size"), F.min(F.struct("pos", "cid", "n")).alias("m"), F.min("n").alias("least"), F.min(F.when(F.col("home"), F.col("n"))).alias("host"))
        salted = groups.groupBy("token", F.pmod(F.xxhash64("label"), F.lit(pivots)).alias("salt")).agg(
            F.count("*").alias("labels"), F.min("least").alias("least"), F.min("host").alias("host"), F.min(F.struct("size", "m.pos", "m.cid", "m.n", "label")).alias("p")
        )
        salted = written(salted, "pivots")
        lists = salted.groupBy("token").agg(F.sum("labels").alias("labels"), F.min("least").alias("least"), F.min("host").alias("host"))
        lists = lists.where("labels > 1 AND host IS NOT NULL").select("token", "least", "host")
        known = known.join(lists, "token").withColumn("home", F.expr("home AND top >= least"))
        return written(known.where("home OR top >= host"), "open"), salted.select("token", *(F.col(f"p.{c}").alias(f"p_{c}") for c in ("cid", "n", "pos", "label")))

    def verify(self, pairs: DataFrame) -> None:
        """Adds the pairs (a, b) that link to links, and renews label."""
        side = lambda k, *names: self.classes.select(F.col("cid").alias(k), *(F.col(c).alias(x) for c, x in names))
        pairs = written(pairs.distinct(), "pairs")
        if self.links is not None and pairs.isEmpty():
            return
        near = pairs.join(side("a", ("n", "m"), ("sig", "x")), "a").join(side("b", ("n", "n"), ("sig", "y")), "b")
        near = written(near.select("a", "b", "m", "n", "x", "y").mapInArrow(suffix_filter(self.num, self.den), "a binary, b binary, m int, n int"), "near", pairs)
        both = near.join(side("a", ("shared", "x")), "a").join(side("b", ("shared", "y")), "b").select("a", "b", "m", "n", "x", "y")
        links = written(both.mapInArrow(verifier(self.num, self.den), "a binary, b binary"), "links", near)
        if self.links is None or not links.isEmpty():
            self.links = links if self.links is None else self.links.unionByName(links)
            self.label = written(near_labels(self.links), "labels")

    def work(self, entries: DataFrame, most: int | None) -> DataFrame:
        """Works through the lists of entries (token, cid, n, pos), the longest in up to most rounds; gives the entries of
        those that stay open."""
        lists = written(entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"), "lists")
        sized = written(entries.join(lists, "token"), "entries")
        parts = self.by_size(sized)
        pairs: DataFrame | None = self.short_pairs(sized).unionByName(self.short_pairs(parts))
        columns = ["token", "whole", "cid", "n", "pos", "top", "home"]
        pivots, done = PIVOTS[0], 0
        known, chosen = self.opened(parts.where(F.col("size") > SHORT).select(*columns), pivots)
        while True:
            go_on = (most is None or done < most) and not known.isEmpty()
            if go_on:
                near = known.join(chosen, "token").where(f"label <> p_label AND {_may_link('', 'p_', self.num, self.den)}")
                near = near.select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b"))
                pairs = near if pairs is None else pairs.unionByName(near)
            if pairs is not None:
                self.verify(pairs)
            if not go_on:
                return known.select(F.col("whole").alias("token"), "cid", "n", "pos").distinct()
            left = known.join(chosen.select("token", F.col("p_cid").alias("cid")), ["token", "cid"], "left_anti").select(*columns)
            pivots, pairs, done = min(2 * pivots, PIVOTS[1]), None, done + 1
            known, chosen = self.opened(left, pivots)

    def split(self, rest: DataFrame) -> DataFrame:
        """Entries of open lists by their token and one that follows; pos counts as if the first were beside it."""
        many = rest.join(self.classes.select("cid", "prefix"), "cid")
        after = many.select("token", "cid", "n", "pos", F.explode(F.filter("prefix", lambda x: x["pos"] > F.col("pos"))).alias("u"))
        after = after.select(F.xxhash64("token", "u.token").alias("token"), "cid", "n", (F.col("u.pos") - 1).alias("pos"))
        alone = rest.where(f"{self.num}L * n <= {self.den}L").select(F.xxhash64("token", F.lit(0)).alias("token"), "cid", "n", "pos")
        return after.unionByName(alone)


def linked(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; component_id is the smallest doc_id reachable by links."""
    blocked = blocks(docs)
    parts = written_replies(blocked, lambda row: np.concatenate([np.zeros(0, np.uint64), *shingle_sets(row, size)]), "replies")
    replied = functools.reduce(DataFrame.unionByName, parts)
    made = blocked.groupBy("block").cogroup(replied.groupBy("block")).applyInArrow(profiles(size, num, den), PROFILE)
    profile = written(made, "profiles", blocked, *parts)
    classes = written(profile.where(F.col("prefix").isNotNull()).dropDuplicates(["cid"]).drop("doc_id"), "classes")
    join = Join(classes, num, den)
    prefix_length = f"n - (({num}L * n + {den - 1}) div {den}) + 1"
    entries = classes.select("cid", "n", F.explode(F.filter("prefix", lambda x: x["pos"] < F.expr(prefix_length))).alias("p"))
    rest = join.work(entries.select("p.token", "cid", "n", "p.pos"), ROUNDS)
    if not rest.isEmpty():
        join.work(join.split(rest), None)
    # a class is known by its smallest doc_id from here on, so that a component's label has it
    who = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"))).alias("w")
    named = profile.where("n > 0").groupBy("cid").agg(who).select("cid", F.struct("w.no", "w.id", "cid").alias("node"))
    named = written(named, "named")
    end = lambda k, name: named.select(F.col("cid").alias(k), F.col("node").alias(name))
    links = written(join.links.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")), "links")
    found = named.join(components(links), "node", "left").select("cid", F.coalesce("label", "node").alias("label"))
    found = written(found.select("cid", F.when(~F.col("label.no"), F.col("label.id")).alias("component_id")), "components")
    rows = profile.select("doc_id", "n", "cid").join(found, "cid", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs of each group linked directly or not: that of the smallest doc_id, nulls last, and of equal ones any.

    Rows without words link with nothing: one row of each doc_id stays, and all with a null one.
    """
    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")  # so that no name clashes
    rows = written(docs.select(own, F.monotonically_increasing_id().alias("row")), "rows")  # written, so that the numbers stand
    found = linked(rows.select(F.col("row").alias("doc_id"), "own.text"), size, num, den).withColumnRenamed("doc_id", "row")
    found = found.join(rows.select("row", F.col("own.doc_id").cast("long").alias("id")), "row")
    wordless = F.col("n_shingles") == 0
    group = (F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("id")), F.when(wordless & F.col("id").isNull(), F.col("row")))
    first = F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("row")
    found = written(found.select("row", "id", *(g.alias(f"g{k}") for k, g in enumerate(group))), "groups")
    gone = found.select("row").join(found.groupBy("g0", "g1", "g2").agg(first).select("row"), "row", "left_anti")
    return rows.join(gone, "row", "left_anti").select(*(F.col("own")[c].alias(c) for c in docs.columns))
