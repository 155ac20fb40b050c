import pytest
from check import compare, duck

import __spark_entry__ as entry
import corpus_pipeline
from kurzwerk.llm import queries as Q


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in Q.registered()) == list(range(1, 14))
    assert set(Q.registered()) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(Q.statements()))
def test_query_equals_sql(spark, sf, name):
    got, want, *_ = compare(spark, duck(sf), sf, Q.registered()[name], Q.statements()[name])
    assert got == want


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    from test_decontaminate import brute as leaks
    from test_near_dedup import brute as classes
    from test_quality import brute as rules
    from test_suffix_dedup import brute as repeats

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = [(d, t) for d, t in docs if rules(t)["kept"]]
    label = classes([t for _, t in docs])
    docs = [x for i, x in enumerate(docs) if label[i] == i]
    figures = {r[0]: r for r in repeats(docs, 400)}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    # Texts that lost nothing go through the leak search as they are.
    whole = [(d, t) for d, t in docs if not figures[d][2]]
    dirty = {whole[i][0] for i, _ in leaks([t for _, t in whole], items)}
    assert {d for d, _ in whole if d in got} == {d for d, _ in whole} - dirty
    gone = {d for d, t in docs if figures[d][2] == figures[d][1]}
    assert not gone & set(got) and set(got) <= {d for d, _ in docs}
    assert all(r.n_tokens > 0 for r in got.values())
