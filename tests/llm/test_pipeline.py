import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from lodestar.llm import queries as Q
from lodestar.llm import token_packing as P
from lodestar.llm.oracles import ORACLES
from tests.conftest import DATA
from tests.llm.test_jaccard import brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = []
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept.append(docs.collect())
    told, apart, clean, mixed = kept
    assert {r.doc_id for r in told} == {d for d, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")}
    groups = brute([(r.doc_id, r.text) for r in told])
    assert sorted(r.doc_id for r in apart) == sorted(d for d, _, c in groups if d == c)
    leaks = {r.doc_id for r in Q.queries()["op4_decontaminate"](spark, DATA).collect()}
    assert leaks and {r.doc_id for r in clean} == {r.doc_id for r in apart} - leaks
    size = {r.doc_id: len(WORD.findall(r.text)) for r in clean}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert all(n <= 2 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) / sum(size.values()) - 1.5) < 0.03
    packed = C.STAGES[-1][1](spark, docs, DATA).collect()
    ids = sum(r.n_tokens for r in packed)
    encode = P._encoding(P.vocabulary_path()).encode_ordinary
    assert ids == sum(len(encode(r.text)) + 1 for r in mixed)
    assert {d for r in packed for d in r.doc_ids} == {r.doc_id for r in mixed}


def test_run_gives_the_same_packed_documents_twice(spark):
    key = lambda rows: Counter(d for r in rows for d, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:]) for _ in range(b - a))
    one, two = C.run(spark, DATA).collect(), C.run(spark, DATA).collect()
    assert key(one) == key(two) and all(np.frombuffer(r.ids, "<i4").size == P.LENGTH for r in one)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_all_are_registered(spark):
    import __spark_entry__ as E

    names = set(E.queries())
    assert set(Q.queries()) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))
