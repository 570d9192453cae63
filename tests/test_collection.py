import json
import random
import re

import pytest

from starling import errors
from starling.functions.filters import metadata_filter
from starling.sources.collection import Client, Collection
from starling.sources.json_io import read_document
from starling.sources.oplog import LOG, RECORD, fold
from starling.streaming.changelog import read_changes, upsert_stream


@pytest.fixture
def made(spark, tmp_path):
    return Collection.create(spark, f"file://{tmp_path}/c", 2, "l2")


def test_life(spark, made):
    made.add_many(["a", "b", "c"], [[1, 0], [0.9, 0], [0.8, 0]], [{"cat": "sci"}, {"cat": "art"}, {"cat": "sci"}])
    assert len(made) == 3 and "a" in made and made.count({"cat": "sci"}) == 2
    with pytest.raises(errors.DuplicateId):
        made.add("a", [1, 1])
    with pytest.raises(errors.DuplicateId):
        made.add_many(["x", "x"], [[1, 1], [1, 1]])
    with pytest.raises(errors.DimensionMismatch):
        made.add("x", [1, 1, 1])
    with pytest.raises(errors.NotFound):
        made.update("x", metadata=None)
    with pytest.raises(ValueError):
        made.add_many(["x"], [[1, 1]], [])
    assert [r["id"] for r in made.search([1, 0], 2, where_filter={"cat": "sci"}).collect()] == ["a", "c"]
    made.update("a", vector=[5, 5])
    assert made.get("a") == ([5, 5], {"cat": "sci"})
    made.update("a", metadata=None)
    assert made.get("a") == ([5, 5], None)
    made.upsert_many(["a", "d", "d"], [[1, 1], [2, 2], [3, 3]])
    assert made.get("d")[0] == [3, 3] and len(made) == 4
    assert made.delete_many(["a", "c", "nobody"]) == 2 and not made.delete("a")
    assert made.stats()["total_slots"] == 4
    made.compact()
    assert made.stats()["total_slots"] == 2 and sorted(r["id"] for r in made.ids().collect()) == ["b", "d"]
    again = Collection.open(spark, made.path)
    assert sorted(r["id"] for r in again.ids().collect()) == ["b", "d"] and again.metric == "euclidean"
    rows = again.search_many([[0, 0], [3, 3]], 1).orderBy("query_id").collect()
    assert [r["id"] for r in rows] == ["b", "d"]


def test_log_is_replayed_without_snapshot(spark, made):
    made.add("a", [1, 1])
    assert Collection.open(spark, made.path).get("a")[0] == [1, 1]


def test_quantized_search(made):
    made.enable_quantized_search()
    assert not made.is_quantized()
    made.add_many([f"{i}" for i in range(20)], [[i, 1] for i in range(20)])
    made.enable_quantized_search()
    assert made.is_quantized() and [r["id"] for r in made.search([7, 1], 1).collect()] == ["7"]
    assert made.quantized_records().count() == 20
    made.disable_quantized_search()
    assert not made.is_quantized()


def test_stored_codes(spark, made):
    made.add_many([f"{i}" for i in range(30)], [[i, i * i] for i in range(30)])
    made.enable_quantized_search()
    made.upsert("5", [700, 700])
    again = Collection.open(spark, made.path)
    assert {"codes", "norm"} <= set(again._stored().columns) and again._sq8() == ([0, 0], [29 / 255, 841 / 255])
    codes = {r["id"]: r["codes"] for r in again.quantized_records().collect()}
    assert codes["29"] == [255, 255] and codes["0"] == [0, 0] and codes["5"] == [255, 212]
    assert [r["id"] for r in again.search([700, 700], 1).collect()] == ["5"]
    made.save()
    assert Collection.open(spark, made.path)._sq8()[1] == [700 / 255, 841 / 255]


def test_stored_index(spark, made, monkeypatch):
    made.build_index()
    assert made.stats()["index_lists"] == 0
    rng = random.Random(3)
    point = lambda i: [rng.random() + 4 * (i % 5), rng.random()]
    made.add_many([f"{i:03d}" for i in range(200)], [point(i) for i in range(200)], [{"n": i} for i in range(200)])
    made.build_index(10)
    made.upsert_many(["000", "new"], [[100, 100], [100, 101]])
    made.update("001", vector=[100, 102])
    made.delete("002")
    again = Collection.open(spark, made.path)
    assert again.stats()["index_lists"] == 10
    for c in (again, made):
        q = [100, 100]
        assert [r["id"] for r in c.search(q, 3, exact=False).collect()] == ["000", "new", "001"]
        assert [r["id"] for r in c.search_many([q, [0, 0]], 3, exact=False).where("query_id = 0").orderBy("rank").collect()] == ["000", "new", "001"]
        assert [r["id"] for r in c.search(q, 9, exact=False, where_filter={"n": {"$lt": 4}}).collect()] == ["001", "003"]
        assert not c.search([2, 0], 300, exact=False).where("id = '002'").count() and c.search([2, 0], 300, exact=False).count() == 200
        made.save()
        made = Collection.open(spark, made.path)
    assert not made._uses_index(None)
    monkeypatch.setattr("starling.operators.ann.EXACT_BELOW", 10)
    assert made._uses_index(None) and made.search([100, 100], 1).first()["id"] == "000"
    made.add_many([f"x{i}" for i in range(300)], [point(i) for i in range(300)])
    made.save()
    assert made.manifest["index"]["rows"] == 500 == made.manifest["index"]["fitted"]
    made.drop_index()
    assert made.manifest["index"] is None and len(made) == 500


def test_two_writers_and_readers(spark, made):
    made.add("a", [1, 1])
    made.save()
    other, reader = Collection.open(spark, made.path), Collection.open(spark, made.path).records()
    made.add("b", [2, 2])
    with pytest.raises(errors.Conflict):
        other.add("c", [3, 3])
    made.save()
    assert reader.count() == 1 and sorted(r["id"] for r in Collection.open(spark, made.path).ids().collect()) == ["a", "b"]
    for i in range(12):
        made.upsert("a", [i, i])
    assert Collection.open(spark, made.path).get("a")[0] == [11, 11] and len([n for n in made.files.names() if n.startswith("manifest")]) <= 8


def test_upsert_of_repeats(spark, made):
    rows = spark.createDataFrame([("a", [1.0, 1.0], "1", 5), ("a", [2.0, 2.0], "2", 3), ("a", [0.0, 0.0], "3", 5)], "id string, vector array<double>, metadata string, n int")
    made.upsert_many(rows)
    assert made.get("a") == ([2, 2], 2)
    made.upsert_many(rows, order_col="n")
    assert made.get("a") == ([1, 1], 1)


def test_import_of_files(spark, made, tmp_path):
    made.add_many(["a", "b"], [[1, 0], [0.5, 2]], [{"x": 1}, None])
    (tmp_path / "d.json").write_text(made.export_json(pretty=True))
    copy = Collection.import_file(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/d.json")
    assert copy.get("a") == ([1, 0], {"x": 1}) and copy.get("b") == ([0.5, 2], None) and copy.metric == "euclidean"
    made.export_jsonl(f"file://{tmp_path}/lines")
    empty = Collection.in_memory(spark, 2)
    empty.import_jsonl(f"file://{tmp_path}/lines")
    assert empty.get("a") == ([1, 0], {"x": 1}) and len(empty) == 2
    empty.drop()
    (tmp_path / "no.json").write_text("{}")
    with pytest.raises(errors.CorruptData):
        Collection.import_file(spark, f"file://{tmp_path}/other", f"file://{tmp_path}/no.json")


def test_json(spark, made, tmp_path):
    made.add_many(["a", "b"], [[1, 0], [0.5, 2]], [{"x": 1}, None])
    text = made.export_json(pretty=True)
    assert json.loads(text)["vectors"][1] == {"id": "b", "vector": [0.5, 2.0]}
    copy = Collection.import_json(spark, f"file://{tmp_path}/copy", text)
    assert copy.get("a") == ([1, 0], {"x": 1})
    assert made.import_json_into('{"version":1,"dim":2,"metric":"dot","vectors":[{"id":"a","vector":[9,9]}]}') == 1
    assert made.get("a") == ([9, 9], None)
    with pytest.raises(errors.DimensionMismatch):
        made.import_json_into('{"version":1,"dim":3,"metric":"dot","vectors":[]}')
    with pytest.raises(errors.CorruptData):
        made.import_json_into("{}")
    (tmp_path / "d.json").write_text(text)
    assert {(r["id"], r["metadata"]) for r in read_document(spark, f"file://{tmp_path}/d.json").collect()} == {("a", '{"x":1}'), ("b", None)}
    made.export_jsonl(f"file://{tmp_path}/lines")
    assert spark.read.text(f"file://{tmp_path}/lines").count() == 2


def test_client(spark, tmp_path):
    client = Client(spark, f"file://{tmp_path}/root")
    client.create_collection("one", 2)
    assert client.list_collections() == ["one"]
    with pytest.raises(errors.CollectionExists):
        client.create_collection("one", 2)
    assert client.get_or_create_collection("one", 7).dim == 2
    assert client.delete_collection("one") and not client.delete_collection("one")
    with pytest.raises(errors.DatabaseNotFound):
        client.get_collection("one")
    for bad in ("", "../evil", "a/b", "..", "has space"):
        with pytest.raises(errors.InvalidCollectionName):
            client.create_collection(bad, 2)


def test_fold_agrees_with_a_dictionary(spark):
    rng = random.Random(5)
    start = {f"i{k}": ([float(k)], f"{k}") for k in range(0, 40, 2)}
    state, ops = dict(start), []
    for seq in range(400):
        i, op = f"i{rng.randrange(40)}", rng.choice("AADU")
        v = [rng.random()] if op == "A" or rng.random() < 0.5 else None
        v = [float(int(v[0] * 64))] if v else None
        m, sets = rng.choice([None, "x", "y"]), op == "A" or rng.random() < 0.5
        if op == "D":
            v, m, sets = None, None, False
        ops.append((i, seq, op, v, m, sets))
        if op == "A":
            state[i] = (v, m)
        elif op == "D":
            state.pop(i, None)
        elif i in state:
            old = state[i]
            state[i] = (v if v is not None else old[0], m if sets else old[1])
    rows = fold(spark.createDataFrame([(i, *x) for i, x in start.items()], RECORD), spark.createDataFrame(ops, LOG)).collect()
    assert {r["id"]: (list(r["vector"]), r["metadata"]) for r in rows} == state


def test_stream(spark, made, tmp_path):
    made.add("a", [1, 1])
    source = spark.createDataFrame([("b", [2.0, 2.0], None), ("a", [3.0, 3.0], "{}")], RECORD)
    source.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")
    upsert_stream(stream, made, f"file://{tmp_path}/ck").awaitTermination()
    assert made.get("a")[0] == [3, 3] and len(made) == 2
    q = read_changes(spark, made.path + "/log-*").writeStream.format("memory").queryName("changes").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from changes").count() == 3


def test_promoted_fields(spark, tmp_path):
    rows = [(str(i), [float(i), 1.0], json.dumps({"lang": ["de", "en", "fr"][i % 3], "n": i})) for i in range(60)]
    made = Collection.create(spark, f"file://{tmp_path}/p", 2, "l2", fields=["lang", "n"])
    made.add_many(spark.createDataFrame(rows, "id string, vector array<float>, metadata string"))
    plain = lambda where: sorted(r["id"] for r in made.records().where(metadata_filter(where)).collect())
    kept = lambda where: sorted(r["id"] for r in made.records(where).collect())
    cases = [{"lang": "de"}, {"lang": {"$in": ["en", "xx"]}}, {"n": {"$gt": 50}}, {"n": 7}, {"lang": "fr", "n": {"$lte": 9}}, {"lang": {"$ne": "de"}}, {"other": 1}]
    made.save()
    made.update("1", metadata={"lang": "de", "n": 1000})  # the snapshot says en
    made.upsert("0", [0.0, 1.0], {"lang": "en", "n": -1})
    made.delete("3")
    for where in cases:
        assert kept(where) == plain(where), where
        assert made.count(where) == len(plain(where))
    assert "1" in kept({"lang": "de"}) and not {"0", "3"} & set(kept({"lang": "de"}))
    made.save()
    made.enable_quantized_search()
    reopened = Collection.open(spark, made.path)
    assert reopened.fields == ["lang", "n"] and reopened.stats()["fields"] == ["lang", "n"]
    for where in cases:
        assert kept(where) == plain(where), where
        want = sorted(r["id"] for r in reopened.search([0.0, 1.0], 100, where_filter=where, exact=True).collect())
        assert want == plain(where) == sorted(r["id"] for r in reopened.search([0.0, 1.0], 100, where_filter=where).collect())
    plan = reopened.records({"lang": "de", "n": {"$gt": 5}})._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "text_0" in pushed and "number_1" in pushed
    made = reopened
    made.promote("n")
    assert kept({"lang": "de"}) == plain({"lang": "de"}) and made.fields == ["n"]
    made.promote()
    assert kept({"n": {"$gt": 50}}) == plain({"n": {"$gt": 50}})
