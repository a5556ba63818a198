"""Quality rules: Jensen-Shannon distance of character-class and common-word histograms to language references.

Base counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed is decided by the first
and the last. The method compares two histograms of a text with the references of its language, which are the summed
histograms of all documents of that language:

* character classes (CLASSES and the rest), if the text has at least ``min_chars`` characters;
* common words (COMMON_WORDS and the rest), if the text has at least ``min_words`` words. The limit is ``word_limit`` and
  what sampling adds to the distance of a clean text of n words, which falls with the root of n.

Too short a text is not compared (the minimum-length guard). A text is kept if it passed the base rule and neither
distance, from 0 to 1, is over its limit.

Only DataFrame functions run here: every step is an expression on the row, but for the references (one partial
aggregate by language) and their join, which Spark broadcasts if they are small.

Edge cases. Null text: no words, base_failed. Null lang: compared with the reference of all
documents. Repeated rows and doc_ids: each row is judged by itself. An empty table gives an empty
table. Input columns pass through; result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_SPACE, SPACE, written

# Frequent words of the languages, as they are written in lower case.
COMMON_WORDS = """
the of and to in is that for it with as was on be by this are from or an
le la les de des et un une que qui dans pour sur pas au aux du par avec
der die das und den von zu mit sich auf für ist im dem nicht ein eine als
el los del en y se las por con no su al lo como una
""".split()
#: Characters outside a class are kept out; the pattern is what is deleted before counting.
CLASSES = {
    "upper": "[^A-Z]+",
    "digit": "[^0-9]+",
    "symbol": "[^#*$%&|<>]+",
    "punct": r"[^!\x22\x27(),\x2D./:;?@\x5B\x5C\x5D^_\x60{}~+=]+",
    "space": r"[^\x20\x09-\x0D]+",
    "wide": r"[\x00-\x7F]+",
}

BLANKS = " \t\n\x0b\x0c\r"


def with_words(docs: DataFrame) -> DataFrame:
    """__t: the text without blanks at its ends, which change no count but that of blanks; __w: its words."""
    df = docs.withColumn("__x", F.coalesce(F.col("text"), F.lit(""))).withColumn("__t", F.btrim("__x", F.lit(BLANKS)))
    return df.withColumn("__w", F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", SPACE + "+", -1)))


def with_histograms(df: DataFrame) -> DataFrame:
    """__c: counts of CLASSES in order, and of all other characters; __h: (word, count) of the common words that occur;
    __m: how many words are common."""
    for name, pattern in CLASSES.items():
        df = df.withColumn(f"__{name}", F.length(F.regexp_replace("__x", pattern, "")).cast("long"))
    named = [F.col(f"__{name}") for name in CLASSES]
    df = df.withColumn("__chars", F.length("__x").cast("long"))
    df = df.withColumn("__c", F.array(*named, F.col("__chars") - sum(named, F.lit(0)))).drop(*[f"__{name}" for name in CLASSES])
    common = F.filter(F.transform("__w", F.lower), lambda x: x.isin(COMMON_WORDS))
    df = df.withColumn("__s", F.sort_array(common)).withColumn("__m", F.size("__s"))
    df = df.withColumn("__b", F.expr("filter(sequence(1, greatest(__m, 1)), i -> i <= __m AND (i = 1 OR __s[i - 1] <> __s[greatest(i - 2, 0)]))"))
    at = "transform(__b, (x, i) -> struct(__s[x - 1] AS w, CAST(CASE WHEN i + 1 < size(__b) THEN __b[least(i + 1, size(__b) - 1)] ELSE __m + 1 END - x AS BIGINT) AS n))"
    return df.withColumn("__h", F.expr(at)).drop("__s", "__b")


def histogram_sums(measured: DataFrame) -> DataFrame:
    """(lang, k, v): words (k = #words), characters by class (#0 ...) and common words, in one aggregate."""
    cell = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("long").alias("v"))
    fixed = [cell("#words", F.col("n_words")), *[cell(f"#{i}", F.col("__c")[i]) for i in range(len(CLASSES) + 1)]]
    words = F.transform("__h", lambda x: F.struct(x["w"].alias("k"), x["n"].alias("v")))
    cells = measured.select(F.col("__lang").alias("lang"), F.explode(F.concat(F.array(*fixed), words)).alias("x"))
    return cells.groupBy("lang", F.col("x.k").alias("k")).agg(F.sum("x.v").alias("v"))


def references(measured: DataFrame) -> DataFrame:
    """(lang, classes, words): shares by class and by common word of each language; lang null is all documents."""
    sums = written(histogram_sums(measured), "histograms")  # a few hundred rows by language
    by_key = lambda df: df.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    own = by_key(sums.where(F.col("lang").isNotNull()).groupBy("lang"))
    everything = by_key(sums.groupBy("k").agg(F.sum("v").alias("v"))).select(F.lit(None).cast("string").alias("lang"), "m")
    refs = own.unionByName(everything)
    amount = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0).cast("long"))
    counts = F.array(*[amount(f"#{i}") for i in range(len(CLASSES) + 1)])
    refs = refs.withColumn("cs", counts).withColumn("n", F.greatest(amount("#words"), F.lit(1)))
    refs = refs.withColumn("whole", F.greatest(F.aggregate("cs", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1)))
    words = F.transform_values(F.map_filter("m", lambda k, v: ~k.startswith("#")), lambda k, v: v / F.col("n"))
    return written(refs.select("lang", F.transform("cs", lambda x: x / F.col("whole")).alias("classes"), words.alias("words")), "references")


def _term(p: Column, q: Column) -> Column:
    """Half of p log2(p/m) + q log2(q/m), m their mean; 0 log 0 is 0."""
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (half(p) + half(q)) / 2


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.least(F.greatest(divergence, F.lit(0.0)), F.lit(1.0)))


RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
VERDICTS = ["char_js", "word_js", "kept"]


def measures(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns carry of docs as __own, so that no name clashes, RESULTS and the histograms of each row."""
    df = docs.select(F.struct(*(F.col(c) for c in carry)).alias("__own"), "text", F.col("lang").alias("__lang"))
    df = with_histograms(with_words(df))
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.col("__chars") - F.col("__c")[list(CLASSES).index("space")])
    df = df.withColumn("n_symbols", F.col("__c")[list(CLASSES).index("symbol")])
    df = df.withColumn("__lines", F.filter(F.split("__x", "\n", -1), lambda x: x.rlike(NOT_SPACE)))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    # 3-word windows: positions of equal windows are found by sorting (hash, start); a text without any skips the sort
    df = df.withColumn("__g", F.expr("transform(CASE WHEN size(__w) >= 3 THEN sequence(0, size(__w) - 3) ELSE array() END, i -> xxhash64(__w[i], __w[i + 1], __w[i + 2]))"))
    pairs = "sort_array(transform(__g, (x, i) -> struct(x AS h, i AS i)))"
    df = df.withColumn("__o", F.expr(f"CASE WHEN size(array_distinct(__g)) < size(__g) THEN {pairs} ELSE array() END"))
    twice = "filter(__o, (x, k) -> (k > 0 AND __o[greatest(k - 1, 0)].h = x.h) OR (k + 1 < size(__o) AND __o[least(k + 1, size(__o) - 1)].h = x.h))"
    df = df.withColumn("__r", F.expr(f"sort_array(transform({twice}, x -> x.i))"))
    cover = "aggregate(transform(__r, (x, k) -> CASE WHEN k = 0 THEN 3 ELSE least(3, x - __r[greatest(k - 1, 0)]) END), 0L, (a, x) -> a + x)"
    df = df.withColumn("n_repeat_words", F.expr(cover).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.select("__own", *RESULTS, "__lang", "__chars", "__c", "__h", "__m")


def judged(
    docs: DataFrame, carry: list[str] | None = None, char_limit: float = 0.25, word_limit: float = 0.14, word_noise: float = 1.75, min_chars: int = 200, min_words: int = 50
) -> DataFrame:
    """The columns carry of docs (all, if None), RESULTS and VERDICTS. The measures are taken once and written to the
    shared folder: the references are summed from them, and the verdicts drawn from both."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULTS + VERDICTS]
    df = written(measures(docs, carry), "measures")
    refs = references(df)
    ref = refs.select(F.col("lang").alias("__l"), F.col("classes").alias("__qc"), F.col("words").alias("__qw"))
    df = df.join(ref.where(F.col("__l").isNotNull()), F.col("__lang") == F.col("__l"), "left")
    rest = ref.where(F.col("__l").isNull()).select(F.col("__qc").alias("__ac"), F.col("__qw").alias("__aw"))
    df = df.crossJoin(F.broadcast(rest))  # one row
    df = df.withColumn("__qc", F.coalesce("__qc", "__ac")).withColumn("__qw", F.coalesce("__qw", "__aw"))
    chars = F.greatest("__chars", F.lit(1))
    by_class = F.zip_with("__c", "__qc", lambda c, q: _term(c / chars, q))
    df = df.withColumn("char_js", _distance(F.aggregate(by_class, F.lit(0.0), lambda a, x: a + x)))
    n = F.greatest("n_words", F.lit(1))
    q_of = lambda x: F.coalesce(F.try_element_at(F.col("__qw"), x["w"]), F.lit(0.0))
    seen = F.aggregate("__h", F.lit(0.0), lambda a, x: a + _term(x["n"] / n, q_of(x)))
    q_seen = F.aggregate("__h", F.lit(0.0), lambda a, x: a + q_of(x))
    q_all = F.aggregate(F.map_values("__qw"), F.lit(0.0), lambda a, x: a + x)
    other = _term((n - F.col("__m")) / n, F.lit(1.0) - q_all)
    df = df.withColumn("word_js", _distance(seen + (q_all - q_seen) / 2 + other))
    chars_ok = (F.col("__chars") < min_chars) | (F.col("char_js") <= char_limit)
    words_ok = (F.col("n_words") < min_words) | (F.col("word_js") <= word_limit + word_noise / F.sqrt("n_words"))
    df = df.withColumn("kept", ~F.col("base_failed") & chars_ok & words_ok)
    return df.select(*(F.col("__own")[c].alias(c) for c in carry), *RESULTS, *VERDICTS)
