"""Each operator against its plain version, and on hard inputs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import chat, decontaminate, jaccard_join, kernel, lang_crf, license_scan, line_dedup, lm_score, packing, quality, suffix_dedup
from cloudloom.llm.shared import public_tokenizer

from . import brute

TOKENIZER = public_tokenizer("word_bpe_49k.json")
LONG = " ".join(f"w{i % 4001}x{i % 13}" for i in range(60_000))
#: Nulls, empty and very long texts, ties, repeated rows.
HARD = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, LONG), (6, "a b c d e f g"), (6, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (7, "É è ñ 12 3"), (8, "one\nTwo three four five\n one \ntwo three four five ")]


def frame(spark, rows, extra=True):
    """(doc_id, text, lang) and columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, None if k % 3 == 0 else "en" if k % 3 == 1 else "fr") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string")
    if extra:
        df = df.withColumns({c: F.lit(7) for c in ("n_words", "h", "token", "cid", "label", "kept", "n_lines", "id", "uid", "rank", "block", "score", "item", "row", "own", "lines", "gone", "__drop", "__id", "__w", "__x", "__t", "__c", "__h", "__m", "__kept", "__lang", "__row")})
    return df


OPERATORS = {
    "crf": lambda d: lang_crf.predict(d, F.lit(True), train_docs=5),
    "quality": lambda d: quality.judged(d, carry=["doc_id", "text"]),
    "license": lambda d: license_scan.scanned(d),
    "contained": lambda d: decontaminate.contained(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "lm": lambda d: lm_score.scored(d),
    "lines": lambda d: line_dedup.dedup_lines(d),
    "jaccard": lambda d: jaccard_join.linked(d),
    "pack": lambda d: packing.pack(d, TOKENIZER),
    "suffix": lambda d: suffix_dedup.repeated_spans(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hard_and_empty_tables(spark, name):
    df = frame(spark, HARD)
    rows = OPERATORS[name](df).collect()
    assert OPERATORS[name](df.limit(0)).collect() == []
    ids = sorted((r["doc_id"] for r in rows), key=str)
    if name not in ("contained", "suffix", "pack"):
        assert ids == sorted((i for i, _ in HARD), key=str)
    if name == "jaccard":
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
        assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: got[4], 5: (got[4][0], 4), 6: (3, 6), 7: (1, 7), 8: got[8]} and got[4][1] == 4
        assert {(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None} == {(3, 6), (0, None)}
    if name == "suffix":
        assert {(r["doc_id"], r["start_word"], r["end_word"]) for r in rows} == {(4, 0, 60_000), (5, 0, 60_000)}
    if name == "contained":
        pairs = {(r["doc_id"], r["item_id"]) for r in rows}
        assert {(4, 5), (5, 4), (6, None), (None, 6), (6, 6)} <= pairs and not pairs & {(4, 6), (6, 4), (1, 1)}
    if name == "crf":
        assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= r["score"] <= 1 for r in rows)
    if name == "pack":
        assert sum(r["length"] for r in rows if r["doc_id"] == 1) == 1 and sum(1 for r in rows if r["doc_id"] == 6) == 2
    if name == "quality":
        assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 6))
    if name == "lm":
        assert [(r["n_words"], r["mean_score"]) for r in rows if r["doc_id"] == 1] == [(0, None)]


def random_texts(seed, n, base=0, words=40):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(words))) for _ in range(n)]
    core = [rng.choice(vocab) + str(rng.randrange(9)) for _ in range(60)]
    for _ in range(base):  # near copies, with one to four changed words
        own = list(core)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(10_000)}"
        texts.append(" ".join(own))
    texts += texts[:: max(1, n // 5)]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join(spark, size, num):
    docs = random_texts(size, 60, base=70)
    rows = jaccard_join.linked(frame(spark, docs), size, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.jaccard_components(docs, size, num, 100)


@pytest.mark.parametrize(("short", "rounds", "size", "num"), [(2, 0, 3, 90), (2, 0, 2, 60), (3, 1, 1, 50)])
def test_jaccard_join_splits_lists_that_stay_open(spark, monkeypatch, short, rounds, size, num):
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    docs = random_texts(size + 20, 40, base=30, words=8) + [(1000 + i, f"v{i % 3}") for i in range(5)]
    rows = jaccard_join.linked(frame(spark, docs), size, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute.jaccard_components(docs, size, num, 100)


def test_word_hashes_have_no_structure():
    flip, text = str.maketrans("ab", "ba"), "a"
    while len(text) < 1024:
        text += text.translate(flip)  # the Thue-Morse word, which collides with its complement modulo 2^64
    words = [text, text.translate(flip), "ab", "aB", "abcdefgh", "abcdefghi", "abcdefgh\0", "x" * 127, "x" * 128, "x" * 129, "x" * 5000]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    found = kernel.Words(data, np.array([0, len(data)]), kernel.separators("space"))
    assert len(set(found.hashes(lower=False).tolist())) == len(words) and len(set(found.hashes(lower=True).tolist())) == len(words) - 1


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = ["The quick brown fox", " the QUICK brown fox\t", "short", "", "Ünique line É here", "another long line of text"] + [f"line number {i} of many" for i in range(12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(40)]
    want = brute.line_dedup(docs)
    for r in line_dedup.dedup_lines(frame(spark, docs)).collect():
        n, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["n_dropped"], r["text"]) == (n, n - len(kept), "\n".join(kept))
    three = line_dedup.dedup_lines(frame(spark, [(1, "same long line"), (2, "same long line"), (3, "x")]), min_docs=3)
    assert sum(r["n_dropped"] for r in three.collect()) == 0


def test_containment(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randrange(50)))) for k in range(25)] + [(100, "q7"), (101, "q7 q8"), (102, "Q1 q1 q1 q1")]
    docs = []
    for d in range(40):
        words = [f"q{rng.randrange(400)}" for _ in range(rng.randrange(200))]
        passage = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            passage[rng.randrange(len(passage))] = "changed"
        at = rng.randrange(len(words) + 1)
        docs.append((d, " ".join(words[:at] + [p.upper() for p in passage] + words[at:])))
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.contained(frame(spark, docs), table).collect()
    bad = {d for d, _ in brute.contained(docs, items)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(frame(spark, docs), table).collect()) == [d for d, _ in docs if d not in bad]
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in rows} == brute.contained(docs, items)


def test_candidates_of_containment_are_found_once(spark):
    docs = frame(spark, [(1, "a b c d e f g"), (2, "x")])
    out = decontaminate.contained(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))
    # both uses read the written candidates, so no text is hashed again by the result's own plan
    assert any("/candidates-" in f for f in out.inputFiles())
    assert sorted((r["doc_id"], r["item_id"]) for r in out.collect()) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("order", [2, 3])
def test_stupid_backoff(spark, order):
    docs = random_texts(8, 40)
    want = brute.backoff(docs, order)
    for r in lm_score.scored(frame(spark, docs), order).collect():
        n, skipped, s = want[r["doc_id"]]
        assert (r["n_words"], r["n_backoff"]) == (n, skipped) and math.isclose(r["log_score"], s, rel_tol=1e-9, abs_tol=1e-9)


def test_one_row_of_each_group(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a), (5, a), (7, a + " end"), (None, b), (None, b + " end"), (None, c), (3, c), (9, d), (9, "other words here and there"), (8, d), (1, ""), (1, ""), (2, None), (None, ""), (None, " ")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_of_each(frame(spark, rows).repartition(3)).select("doc_id", "text").collect()]
    nulls = [t for i, t in kept if i is None]
    assert sorted((i, t or "") for i, t in kept if i is not None) == sorted([(5, a), (3, c), (8, d), (9, "other words here and there"), (1, ""), (2, "")])
    assert sorted(nulls)[:2] == ["", " "] and len(nulls) == 3 and nulls[[len(t) > 1 for t in nulls].index(True)] in (b, b + " end")


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage = [[f"p{k}x{rng.randrange(50)}" for _ in range(n)] for k, n in enumerate((50, 51, 90, 49, 200))]
    docs = []
    for d in range(60):
        words = [f"u{rng.randrange(100_000)}" for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passage)
        docs.append((d, " ".join(words)))
    got = {}
    for r in suffix_dedup.repeated_spans(frame(spark, docs)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == brute.repeated(docs, 50)


def test_repeated_passages_behind_nearer_neighbours(spark):
    """Pairs share a passage, and other texts share more of it to one side of a gram than the partner to the other."""
    rng = random.Random(17)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    docs = []
    for _ in range(20):
        passage = fresh(56)
        parts = [passage] * 2 + [passage[:n] if k % 2 else passage[-n:] for k, n in enumerate(rng.choices(range(35, 50), k=20))]
        docs += [" ".join(fresh(rng.randrange(5, 40)) + part + fresh(rng.randrange(5, 40))) for part in parts]
    for _ in range(6):  # near copies with words exchanged
        text = fresh(300)
        docs += [" ".join(w if rng.random() > 0.015 else fresh(1)[0] for w in text) for _ in range(25)]
    rng.shuffle(docs)
    docs = list(enumerate(docs))
    got = {}
    for r in suffix_dedup.repeated_spans(frame(spark, docs)).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    assert got == brute.repeated(docs, 50)


@pytest.mark.parametrize("partitions", [1, 8, 64])
def test_repeated_passages_whatever_the_partitions(spark, partitions):
    """One document with 60 copies of a passage and one with one; texts between two that share a passage; a run of a word."""
    rng = random.Random(23)
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    passage, shared = fresh(60), fresh(60)
    docs = [[w for _ in range(60) for w in passage + fresh(3)], fresh(9) + passage]
    docs += [fresh(4) + shared[:50] + fresh(4), shared[:50], shared[25:] + fresh(9), fresh(9) + shared[:25] + fresh(9), shared[20:45], ["one"] * 900, ["one"] * 400 + ["end"]]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {}
        for r in suffix_dedup.repeated_spans(frame(spark, docs)).collect():
            got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute.repeated(docs, 50) and len(got) == 6
    ones = list(suffix_dedup.suffixes(50)(iter([pa.record_batch([pa.array([1]), pa.array(["one " * 20_000])], names=["doc_id", "text"])])))
    assert sum(map(len, ones)) < 100


def test_licenses(spark):
    rng = random.Random(2)
    pool = ["MIT License", "mit", "license", "the Apache License", "general public", "General Public License v3", "foo", "Permission is hereby granted", "\n", "É"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(30)))) for i in range(60)]
    for r in license_scan.scanned(frame(spark, docs)).collect():
        w = brute.plain_words(dict(docs)[r["doc_id"]])
        places = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        want = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want


def test_license_matching_statistics():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES, 0.8)
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        words[len(words) // 2] += " "
        _, _, spans = scanner.scan(("intro words " + text.upper() + " outro").encode())
        assert (name, 2, 2 + len(brute.plain_words(text)), 1.0) in [(a, b, c, round(s, 6)) for a, b, c, s in spans], name
    grant = license_scan.TEMPLATES["mit-grant"].replace("publish", "something else entirely")
    assert [s[0] for s in scanner.scan(grant.encode())[2]] == ["mit-grant"]
    assert scanner.scan(b"permission is hereby granted to nobody")[2] == []


def test_license_templates_do_not_hide_each_other():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, license_scan.PHRASES, 0.8)
    text = "Licensed under the Apache License, Version 2.0. The source is elsewhere"
    assert [s[:3] for s in scanner.scan(text.encode())[2]] == [("apache-2.0-notice", 0, 8)]
    rng = random.Random(5)
    nested = license_scan.TEMPLATES | {f"part{k}": " ".join(brute.plain_words(t)[a : a + n]) for k, (t, a, n) in enumerate((rng.choice(list(license_scan.TEMPLATES.values())), rng.randrange(8), rng.randrange(4, 20)) for _ in range(15))}
    nested = {k: v for k, v in nested.items() if len(v.split()) >= 4} | {"twice": "one two three four five one two three four six"}
    scanner = license_scan.Scanner(nested, {}, 0.8)
    alone = [license_scan.Scanner({k: v}, {}, 0.8) for k, v in nested.items()]
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(1, 6)):
            own = brute.plain_words(rng.choice(list(nested.values())))
            a = rng.randrange(len(own)) if rng.random() < 0.5 else 0
            words += own[a : a + rng.randrange(3, 40)] + rng.choice([[], ["the"], ["xyz"]])
        text = " ".join(words).encode()
        assert sorted(scanner.scan(text)[2]) == sorted(s for x in alone for s in x.scan(text)[2])


def test_chat_collapse(spark):
    rng = random.Random(4)
    talks = []
    for _ in range(25):
        full = [(rng.choice(("user", "assistant")), rng.choice("abc")) for _ in range(rng.randrange(1, 6))]
        talks += [full[: rng.randrange(1, len(full) + 1)] for _ in range(3)] + [full]
    rows = [(c, t, r, x) for c, turns in enumerate(talks) for t, (r, x) in enumerate(turns)]
    rows += rows[:7] + [(None, 0, None, "x"), (500, None, "user", None)]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))).collect()
    kept = {}
    for c, turns in enumerate(talks):
        if not any(len(o) > len(turns) and o[: len(turns)] == turns for o in talks):
            kept.setdefault(tuple(turns), c)
    assert {r["conv_id"] for r in got} == set(kept.values()) | {None, 500}
    one = next(r for r in got if r["conv_id"] in kept.values())
    assert one["chat"] == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in talks[one["conv_id"]])
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_long_conversation_spans_blocks(spark):
    turns = [(1, t, "user", f"m{t}") for t in range(600)] + [(2, t, "user", f"m{t}") for t in range(300)] + [(3, t, "user", f"m{t + (t == 299)}") for t in range(300)]
    got = chat.render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r["conv_id"], r["n_turns"]) for r in got) == [(1, 600), (3, 300)]


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    scores, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 4, 4, 5, 9])
    got, expected = lang_crf.posteriors(scores, first, moves, np.zeros(3), want_moves=True)
    import itertools

    want, pairs = np.zeros((9, 3)), np.zeros((3, 3))
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = list(itertools.product(range(3), repeat=b - a)) if b > a else []
        weight = np.array([np.exp(sum(scores[a + i, y] for i, y in enumerate(p)) + sum(moves[x, y] for x, y in zip(p, p[1:], strict=False))) for p in paths])
        for p, w in zip(paths, weight / weight.sum() if len(weight) else [], strict=True):
            for i, y in enumerate(p):
                want[a + i, y] += w
            for x, y in zip(p, p[1:], strict=False):
                pairs[x, y] += w
    assert np.allclose(got, want) and np.allclose(expected, pairs)


def test_crf_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = lang_crf.predict(docs, ~held).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id").where("held")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = docs.where("lang in ('en', 'de') and n_chars > 500").select("text", "lang").limit(80).collect()
    model = lang_crf.train([r["text"] for r in rows], [r["lang"] for r in rows], steps=30)
    assert model.moves.trace() > model.moves.sum() - model.moves.trace()  # staying is likelier than switching
    en, de = (next(r["text"] for r in reversed(rows) if r["lang"] == x).split()[:30] for x in ("en", "de"))
    data, offsets = np.frombuffer(" ".join(en + de).lower().encode(), np.uint8), None
    offsets = np.array([0, len(data)])
    words = kernel.Words(data, offsets, kernel.separators("word"))
    gamma, _ = lang_crf.posteriors(lang_crf.word_scores(words, model).astype(float), words.first, model.moves, model.starts)
    best = np.array(model.languages)[gamma.argmax(axis=1)]
    assert (best[:25] == "en").mean() > 0.8 and (best[-25:] == "de").mean() > 0.8


def test_crf_learns_every_language(spark):
    rng = random.Random(3)
    rows = [(i, f"w{i % 70}a b c {i}", f"l{i % 70:02}") for i in range(210)]
    word = lambda c: "".join(rng.choice(c) for _ in range(5))
    talk = lambda c, n: " ".join(word(c) for _ in range(n))
    rows += [(1000 + i, "12 " * 3000 + talk("xyzvw", 500), "long") for i in range(5)]
    rows += [(2000 + i, talk("mnopq", 40) if i < 2 else talk("mnopq", 500), "both") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lang_crf.sample(docs, 4, 1000)
    assert {r["lang"] for r in got} == {r[2] for r in rows} and all(0 < len(r["text"].encode()) <= 1000 for r in got)
    assert sum(r["lang"] == "long" for r in got) == 4 and all(r["text"][0] in "xyzvw" for r in got if r["lang"] == "long")
    both = [r["text"] for r in got if r["lang"] == "both"]
    assert len(both) == 4 and {r[1] for r in rows if r[0] in (2000, 2001)} < set(both)
    out = lang_crf.predict(docs.where("doc_id >= 1000"), F.lit(True), 4, 1000).collect()
    assert all(r["lang_pred"] == ("long" if r["doc_id"] < 2000 else "both") for r in out)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_plan(rule):
    rng = np.random.default_rng(1)
    for caps in ((64, 5, 64 * 64), (64, 64, 1500), (64, 64, 64 * 64)):
        lengths = np.arange(1, 30)
        counts = rng.integers(1, 20, len(lengths))
        made, used = packing.plan(lengths, counts, caps, rule=rule)
        held = {}
        for length, _, n, first, offset in made.tolist():
            for s in range(first, first + n):
                held.setdefault(s, []).append((offset, length))
        assert len(held) == used and sum(map(len, held.values())) == counts.sum()
        for own in held.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= caps[0] and len(own) <= caps[1] and sum(n * n for _, n in own) <= caps[2]
    with pytest.raises(ValueError):
        packing.plan(np.array([70]), np.array([1]), (64, 5, 4096))


def test_packing_is_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = [(1, "Hello, World's <|endoftext|> it's"), (2, None), (3, "é É x y é 123 \U0001f600!"), (4, " ".join(f"word{i}" for i in range(3000))), (5, "ΑΣ ς <|STARTOFTEXT|>")]
    rows = packing.pack(frame(spark, docs), TOKENIZER, capacity=100).collect()
    for i, t in docs:
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i)
        assert got == brute.pieces(t, tokenizer, 100, 1)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 100) + 1


def test_quality_against_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    want = brute.quality(docs, set(quality.COMMON_WORDS), quality.CLASSES)
    rows = quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string"), carry=["doc_id"]).collect()
    assert {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in rows} == want


def test_parts_of_the_hashes_give_every_reply_once(spark):
    from cloudloom.llm import lm_score, ngram_rows

    docs = spark.createDataFrame([(i, f"a b c d w{i % 3} a b") for i in range(12)], "doc_id long, text string").repartition(4)
    blocked = ngram_rows.blocks(docs, 1)
    tidy = lambda dfs: sorted(tuple(r) for df in dfs for r in df.collect())
    parts = ngram_rows.written_replies(blocked, lm_score.grams_of_order(2), "parts")
    assert len(parts) == ngram_rows.PARTS > 1 and all(p.count() for p in parts)
    assert tidy(parts) == tidy([ngram_rows.replies(ngram_rows.gram_rows(blocked, lm_score.grams_of_order(2)))])


def test_bulk_totals_count_ngrams_in_few_rows(spark):
    from cloudloom.llm import lm_score, ngram_rows

    docs = frame(spark, [(d, " ".join(f"w{(d * k) % 7}" for k in range(20)) + " z" * 300 * (d == 3)) for d in range(12)])
    blocked = ngram_rows.blocks(docs, 1)
    own = {r["block"]: np.unique(lm_score.grams_of_order(2)(r.asDict()), return_counts=True) for r in blocked.collect()}
    want = {}
    for h, count in own.values():
        for x, c in zip(h.tolist(), count.tolist(), strict=True):
            want[x] = want.get(x, 0) + c
    rows = [r.asDict() for r in ngram_rows.bulk_totals(blocked, 2, 4, "bulk").collect()]
    assert len(rows) <= 4 * len(own) and max(want.values()) > 255
    for block, (h, _) in own.items():
        assert ngram_rows.unpacked_totals([r for r in rows if r["block"] == block]).tolist() == [want[x] for x in h.tolist()]
