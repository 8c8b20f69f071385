from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
from corpora import table
from test_llm_bpe import PATH  # noqa: F401
from test_llm_line_dedup import plain as kept_lines
from test_llm_ngram_join import plain as groups

from levyframe.llm.byte_bpe import decode
from levyframe.storage import stage

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = table(spark)
    columns = docs.columns
    tables = [docs]
    for name, function in corpus_pipeline.STAGES:
        tables.append(stage(function(spark, tables[-1], FOLDER), name.split()[0]))
    start, clean, lines, one, mixed, coded = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    assert 0.6 * len(start) < len(clean) <= len(start) and all(r in start for r in clean)

    kept = kept_lines({r["doc_id"]: r["text"] for r in clean})
    texts = {r["doc_id"]: r["text"] for r in clean}
    stay = {d: t for d, t in kept.items() if t == texts[d] or any(x.strip() for x in t.split("\n"))}
    assert {r["doc_id"]: r["text"] for r in lines} == stay
    assert all(r["n_chars"] == len(r["text"]) for r in lines)

    found = groups([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in one} == {d for d, _, c in found if d == c}

    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in one} and max(times.values()) <= 3
    assert len(coded) == len(mixed)
    data = decode(tables[-1], PATH, public_tokenizers.PATTERN).collect()
    assert Counter(bytes(r.data).decode() for r in data) == Counter(r["text"] for r in mixed)


def test_empty_table(spark):
    docs = table(spark).limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, FOLDER)
    assert docs.count() == 0


def test_no_oracle_is_claimed():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_queries_of_sql_agree_with_it(spark):
    from test_queries import FOLDER as folder
    from test_queries import compare, connect

    from levyframe.llm.oracles import LLM_ORACLES
    from levyframe.llm.queries import LLM_QUERIES

    connection = connect(folder)
    for name in LLM_ORACLES:
        assert compare(LLM_QUERIES[name](spark, folder), connection, name) is None


def test_encoders_get_fewer_texts_at_once(spark):
    docs = table(spark)
    size = lambda: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    corpus_pipeline.drop_toxic(spark, docs, FOLDER)
    most = size()
    corpus_pipeline.encode(spark, docs, FOLDER)
    assert size() < most
