import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starling import errors
from starling.functions.distance import distance, distance_matrix, parse_metric
from starling.functions.quantize import dequantize, parameters, quantize, train
from starling.operators import ann, search

KIND = "id string, vector array<float>, metadata string"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], m) for i, v, m in rows], KIND)


def random_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(f"v{i}", rng.normal(size=dim).astype("float32").tolist(), None) for i in range(n)]


@pytest.mark.parametrize("metric, a, b, want", [("cosine", [1, 0], [2, 0], 0), ("cosine", [1, 0], [-1, 0], 2), ("cosine", [0, 0], [1, 0], 1), ("l2", [0, 0], [3, 4], 25), ("dot", [1, 2, 3], [4, 5, 6], -32)])
def test_distances(spark, metric, a, b, want):
    arr = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert spark.range(1).select(distance(metric, arr(a), arr(b))).first()[0] == pytest.approx(want)
    assert distance_matrix(metric, np.array([a]), np.array([b]))[0, 0] == pytest.approx(want)


def test_metric_names():
    assert parse_metric("l2") == "euclidean"
    for bad in ("COSINE", "", None):
        with pytest.raises(errors.InvalidMetric):
            parse_metric(bad)


def test_top_k_edges(spark):
    rows = frame(spark, [(f"{i}", [1, 0], None) for i in range(10)])
    assert [r["id"] for r in search.search(rows, [1, 0], 5).collect()] == ["0", "1", "2", "3", "4"]
    assert search.search(rows, [1, 0], 0).count() == 0 and search.search(rows, [1, 0], 99).count() == 10
    with pytest.raises(errors.InvalidVector):
        search.search(rows, [float("nan"), 0])


def test_max_distance_comes_after_k(spark):
    rows = frame(spark, [("a", [0.9, 0], None), ("b", [0.5, 0], None), ("c", [-1, 0], None)])
    near = lambda d, k=3: [r["id"] for r in search.search(rows, [1, 0], k, "l2", max_distance=d).collect()]
    assert near(0.3) == ["a", "b"] and near(0.005) == [] and near(9, 1) == ["a"]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot"])
def test_join_agrees_with_single_queries(spark, metric):
    rows = frame(spark, random_rows(200, 8, 1))
    asked = rows.limit(7).select(F.col("id").alias("query_id"), "vector")
    joined = {}
    for r in search.search_many(rows, asked, 4, metric).collect():
        joined.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q in asked.collect():
        want = [r["id"] for r in search.search(rows, q["vector"], 4, metric).collect()]
        assert [i for _, i in sorted(joined[q["query_id"]])] == want


def test_join_of_nothing(spark):
    rows = frame(spark, random_rows(5, 2, 1))
    none = rows.limit(0).select(F.col("id").alias("query_id"), "vector")
    assert search.search_many(rows, none, 3).count() == 0
    assert search.search_many(rows.limit(0), rows.select(F.col("id").alias("query_id"), "vector"), 3).count() == 0


@pytest.mark.parametrize("block", [4096, 50])
def test_equal_vectors_and_many_queries(spark, monkeypatch, block):
    """Shipped queries and cells give the same: k rows of equal vectors by id, and all within a distance."""
    monkeypatch.setattr(search, "QUERY_BLOCK", block)
    monkeypatch.setattr(search, "CELL_ROWS", 100)
    monkeypatch.setattr(search, "HELD", 3000)
    rows = frame(spark, [(f"{i:04d}", [1, 1], f"m{i}") for i in range(600)] + [("z", [1, 0], None)]).repartition(3)
    asked = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(120)] + [(120, [1.0, 0.0]), (121, None)], "query_id long, vector array<double>")
    found = {}
    for r in search.search_many(rows, asked, 3, "l2").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["id"], r["metadata"]))
    assert found.pop(120) == [("z", None), ("0000", "m0"), ("0001", "m1")]
    assert len(found) == 120 and all(f == [("0000", "m0"), ("0001", "m1"), ("0002", "m2")] for f in found.values())
    assert search.range_join(rows, asked, 0.0, "l2").count() == 120 * 600 + 1


def test_best_rows_of_a_task():
    rng = np.random.default_rng(3)
    d, ids = rng.integers(0, 30, (20, 400)).astype(float), rng.permutation(400)
    best = search._Best(20, 7)
    for at in range(0, 400, 25):
        part = ids[at : at + 25].argsort() + at
        i, j = search.nearest(7)(d[:, part])
        best.add(i, j, d[:, part][i, j], pa.table({"id": ids[part]}))
    out = pa.Table.from_batches(best.batches(pa.array(range(20)))).to_pylist()
    want = [(q, int(ids[x]), d[q, x]) for q in range(20) for x in np.lexsort((ids, d[q]))[:7]]
    assert [(r["query_id"], r["id"], r["distance"]) for r in out] == want


def test_range_join_and_duplicates(spark):
    rows = frame(spark, [("a", [1, 0], None), ("b", [1, 0.01], None), ("c", [0, 1], None)])
    pairs = {(r[0], r[1]) for r in search.duplicate_pairs(rows, 0.1).collect()}
    assert pairs == {("a", "b"), ("b", "a")}
    assert search.greedy_groups(search.duplicate_pairs(rows, 0.1)) == [["a", "b"]]
    assert search.range_join(rows, rows.select(F.col("id").alias("query_id"), "vector"), 0.1).count() == 5


def test_sq8(spark):
    rows = frame(spark, [("a", [0, 10, 1], None), ("b", [1, 100, 1], None), ("c", [0.4, 55, 1], None)])
    low, scale = parameters(train(rows))
    assert low == [0, 10, 1] and scale[2] == 1
    codes = {r[0]: r[1] for r in rows.select("id", quantize("vector", low, scale)).collect()}
    assert codes["a"] == [0, 0, 0] and codes["b"] == [255, 255, 0]
    back = {r[0]: r[1] for r in rows.select("id", dequantize(quantize("vector", low, scale), low, scale)).collect()}
    assert abs(back["c"][0] - 0.4) < 0.01 and abs(back["c"][1] - 55) < 0.4


def _recall(found, truth):
    return search.recall(found, truth).agg(F.avg("recall")).first()[0]


def test_ann_recall(spark):
    rows = frame(spark, random_rows(3000, 16, 4)).cache()
    asked = rows.limit(50).select(F.col("id").alias("query_id"), "vector")
    truth = search.search_many(rows, asked, 10, "euclidean", with_metadata=False)
    index = ann.build_ivf(rows, "euclidean", n_lists=30)
    assert _recall(index.search_many(asked, 10, effort=1500), truth) > 0.9
    q = asked.first()
    assert index.search(q["vector"], 1).first()["id"] == q["query_id"]
    one = search.search(rows, q["vector"], 10, "euclidean").select(F.lit(q["query_id"]).alias("query_id"), "id")
    two = ann.two_stage_search(rows, q["vector"], 10, "euclidean").select(F.lit(q["query_id"]).alias("query_id"), "id")
    assert _recall(two, one) > 0.85


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot_product"])
def test_ann_recall_by_default(spark, metric):
    rows = frame(spark, random_rows(3000, 16, 4)).cache()
    asked = frame(spark, random_rows(60, 16, 77)).select(F.col("id").alias("query_id"), "vector")
    index = ann.build_ivf(rows, metric)
    for k in (10, 40):
        truth = search.search_many(rows, asked, k, metric, with_metadata=False)
        assert _recall(index.search_many(asked, k), truth) >= 0.9


def test_effort():
    assert ann.default_effort(10) == 200 and ann.default_effort(400) == 600
    assert ann.use_exact(1000, 64) and not ann.use_exact(10_000_000, 1)


def test_cells_of_the_index(spark, monkeypatch):
    """Lists of more rows, and more queries, than a cell holds give what one cell gives."""
    rows = frame(spark, random_rows(600, 16, 17)).cache()
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    index = ann.build_ivf(rows, "cosine", n_lists=8)
    plain = sorted(map(tuple, index.search_many(asked, 10).select("query_id", "rank", "id").collect()))
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    monkeypatch.setattr(ann, "CELL_QUERIES", 250)
    assert sorted(map(tuple, index.search_many(asked, 10).select("query_id", "rank", "id").collect())) == plain
    assert index.search_many(asked, 0).count() == 0 and index.search_many(asked.limit(0), 10).count() == 0
