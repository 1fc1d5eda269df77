"""The quantised index: recall against exact search, what it reads, exact scores, filters, updates and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, vectorindex
from tessera.plans.views import view

SF = "/root/testdata/sf0.1"


def scans(df):
    """{table: rows read} of the index's tables in a plan that has run."""
    out, todo = {}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            root = node.relation().location().rootPaths().toString()
            table = "codes" if "/codes" in root else "vectors"
            out[table] = out.get(table, 0) + node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return vectorindex.VectorIndex.build(view(spark, SF, "v_vec"), str(tmp_path_factory.mktemp("index")), ("label",), page_rows=2)


def test_recall_of_every_twentieth_row_against_all(spark, index):
    rows = view(spark, SF, "v_vec")
    queries = rows.filter("id % 20 = 0").selectExpr("id query_id", "embedding")
    exact, got = search.top_k_each(rows, queries, 10).cache(), index.search(queries, 10).cache()
    assert got.count() == 10 * queries.count()
    share = vectorindex.recall(got, exact)
    print(f"recall {share:.4f}")
    assert share >= 0.9
    # Scores are exact: where an id is found, its score is that of the exact search.
    assert got.join(exact, ["query_id", "id"]).filter(got["score"] != exact["score"]).count() == 0


def test_a_search_reads_under_a_fifth_of_the_vectors_bytes(spark, index):
    n = view(spark, SF, "v_vec").count()
    rows = {r.id: r.embedding for r in view(spark, SF, "v_vec").filter("id % 400 = 0").collect()}
    for vector in rows.values():
        found = index.search_one(vector, 10)
        assert len(found.collect()) == 10
        codes = spark.read.parquet(f"{index.folder}/codes")
        size = codes.select(F.max(F.length("code"))).first()[0]
        read = size * codes.count() + 4 * index.dim * scans(found)["vectors"]
        print(f"{read / (4 * index.dim * n):.3f} of the bytes")
        assert read < 0.2 * 4 * index.dim * n


def test_filters_come_before_the_candidates(spark, index):
    rows = view(spark, SF, "v_vec")
    vector = rows.filter("id = 3").first().embedding
    got = index.search_one(vector, 10, where=F.col("label") == 7).collect()
    exact = search.top_k(rows, vector, 10, F.col("label") == 7).collect()
    assert len({r.id for r in got} & {r.id for r in exact}) >= 8 and len(got) == 10
    assert {r.id: r.score for r in exact if r.id in {x.id for x in got}} == {r.id: r.score for r in got if r.id in {x.id for x in exact}}


def clustered(spark, n=3000, dim=10, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((30, dim)) * 5)[rng.integers(0, 30, n)] + rng.standard_normal((n, dim))
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "id long, embedding array<float>")


def test_few_cells_are_read_where_vectors_have_groups(spark, tmp_path):
    rows = clustered(spark)
    index = vectorindex.VectorIndex.build(rows, str(tmp_path), cells=30)
    queries = rows.filter("id % 20 = 0").selectExpr("id query_id", "embedding")
    got = index.search(queries, 5, probes=4)
    assert vectorindex.recall(got, search.top_k_each(rows, queries, 5)) >= 0.95
    one = index.candidates(queries.limit(1), 5, probes=4)
    assert one.select("cell").distinct().count() <= 4


def test_lots_blocks_and_additions(spark, tmp_path, monkeypatch):
    rows = clustered(spark, 600)
    index = vectorindex.VectorIndex.build(rows.filter("id < 400"), str(tmp_path), cells=4)
    index.add(rows.filter("id >= 400"))
    queries = rows.filter("id % 20 = 0").selectExpr("id query_id", "embedding")
    whole = sorted(tuple(r) for r in index.search(queries, 5).collect())
    monkeypatch.setattr(vectorindex, "LOT_ROWS", 50)
    monkeypatch.setattr(vectorindex, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(vectorindex, "HELD", 100)
    assert sorted(tuple(r) for r in index.search(queries, 5).collect()) == whole
    assert vectorindex.recall(index.search(queries, 5), search.top_k_each(rows, queries, 5)) >= 0.95


def test_edges(spark, tmp_path):
    schema = "id long, embedding array<float>"
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], schema)
    index = vectorindex.VectorIndex.build(few, str(tmp_path))
    assert [(r.id, r.score) for r in index.search_one([1.0, 0.0], 10).orderBy("rank").collect()] == [(1, 1.0), (2, 1.0), (4, round(1 / 3, 9))]
    with pytest.raises(ValueError, match="lengths"):
        vectorindex.VectorIndex.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema), str(tmp_path))
    none = vectorindex.VectorIndex.build(few.limit(0), str(tmp_path))
    assert none.dim == 0 and none.search_one([1.0, 0.0]).count() == 0
    assert none.search(few.selectExpr("id query_id", "embedding")).count() == 0


def test_an_index_learns_how_many_candidates_it_needs(spark, tmp_path):
    import numpy as np

    from tessera.operators import search

    x = np.random.default_rng(5).standard_normal((6000, 64))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<float>").repartition(4).cache()
    index = vectorindex.VectorIndex.build(rows, str(tmp_path))
    assert index.refine > vectorindex.REFINE
    asked = rows.filter("id % 100 = 0").selectExpr("id query_id", "embedding")
    assert vectorindex.recall(index.search(asked, 10), search.top_k_each(rows, asked, 10)) >= 0.9
