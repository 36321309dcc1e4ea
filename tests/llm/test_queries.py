"""Queries of this subpackage over the test tables: against SQL, or against a plain computation."""

import pyarrow.parquet as pq
import pytest

from spotloom.llm import canonical, leaks, queries


@pytest.fixture(scope="module")
def documents(sf):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_gives_the_same_rows(spark, sf, oracle, name):
    oracle.check(queries.QUERIES[name](spark, sf), queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_queries_without_sql_run(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).columns


def test_ids_are_those_of_the_public_tokenizer(spark, sf, documents):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p7_ids(spark, sf).collect()}
    assert got == {k: t.encode(v or "", add_special_tokens=False).ids for k, v in documents.items()}


def test_leaks_against_all_windows(spark, sf, documents):
    items = pq.read_table(f"{sf}/eval_items.parquet").to_pylist()
    n = leaks.WORDS
    at = {}
    for r in items:
        w = leaks.words_of(r["text"] or "")
        for i in range(len(w) - n + 1):
            at.setdefault(tuple(w[i : i + n]), set()).add(r["item_id"])
    want = set()
    for d, text in documents.items():
        w = leaks.words_of(text or "")
        want |= {(d, i) for k in range(len(w) - n + 1) for i in at.get(tuple(w[k : k + n]), ())}
    assert {tuple(r) for r in queries.p8_found(spark, sf).collect()} == want and want


def test_alike_texts_against_all_pairs(spark, sf, documents):
    forms = {}
    for d, text in documents.items():
        if text is not None and canonical.read_signs(text).strip():
            forms.setdefault(canonical.read_signs(text), []).append(d)
    want = {(min(a, b), max(a, b)) for v in forms.values() for i, a in enumerate(v) for b in v[i + 1 :] if documents[a] != documents[b]}
    assert {tuple(r) for r in queries.p9_found(spark, sf).collect()} == want
