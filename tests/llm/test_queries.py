"""The registered queries against DuckDB, and the pipeline against its plain version, on a small table."""

import glob
import os

import pytest

import corpus_pipeline
from cloudloom.llm.oracle import ORACLE
from cloudloom.llm.quality import CLASSES, COMMON_WORDS
from cloudloom.llm.queries import QUERIES
from cloudloom.llm.shared import public_tokenizer

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE)
def test_against_duckdb(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    tidy = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert tidy(df.select(*columns).collect()) == tidy(want.select(*columns).fetchall())


def test_ten_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = brute.quality(docs, set(COMMON_WORDS), CLASSES)
    left = [(i, t) for i, t, _ in docs if kept[i][2]]
    left = [(i, "\n".join(lines)) for i, (_, lines) in brute.line_dedup(left).items()]
    parts = brute.jaccard_components(left, 5, 80, 100)
    left = [(i, t) for i, t in left if parts[i][1] == i]
    bad = {d for d, _ in brute.contained(left, items)}
    tokenizer = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    want = sorted((i, *p) for i, t in left if i not in bad for p in brute.pieces(t, tokenizer, 4096, 1))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len(corpus_pipeline.STAGES) == 5 and len(want) < len(docs)
