import pytest

from tessera.plans import catalog
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_approximate_search_finds_most(spark):
    from tessera.operators import search
    from tessera.plans.views import view

    rows = view(spark, "/root/testdata/sf0.01", "v_vec").cache()
    indexed = search.hyperplane_index(rows).cache()
    hit = total = 0
    for r in rows.filter("id % 50 = 0").collect():
        exact = {x.id for x in search.top_k(rows, r.embedding, 10).collect()}
        hit += len(exact & {x.id for x in search.approximate_top_k(indexed, r.embedding, 10).collect()})
        total += len(exact)
    assert hit >= 0.9 * total


def test_approximate_search_of_many_rows_on_the_largest_table(spark):
    from tessera.operators import search
    from tessera.plans.views import view

    sf = "/root/testdata/sf0.1"
    rows = view(spark, sf, "v_vec").cache()
    queries = rows.filter("id % 20 = 0").selectExpr("id query_id", "embedding")
    exact = {(r.query_id, r.id) for r in search.top_k_each(rows, queries, 10).collect()}
    got = catalog.QUERIES["ann_topk_lsh"](spark, sf).collect()
    assert {r.query_id for r in got} == {r.query_id for r in queries.collect()}
    recall = len(exact & {(r.query_id, r.id) for r in got}) / len(exact)
    print(f"recall {recall:.4f} of {len(exact)}")
    assert recall >= 0.9
    indexed = search.hyperplane_index(rows)
    for r in queries.orderBy("query_id").limit(3).collect():
        one = [(x.id, x.score) for x in search.approximate_top_k(indexed, r.embedding, 10).collect()]
        assert one == [(x.id, x.score) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == r.query_id]


def test_entry_without_the_llm_subpackage():
    import subprocess
    import sys

    code = "import sys\nfor m in ('tessera.llm', 'corpus_pipeline'): sys.modules[m] = None\nimport __spark_entry__ as e\nassert 'vector_topk' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert done.returncode == 0, done.stderr
