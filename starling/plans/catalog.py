"""The queries of the library's own operators, each with the SQL that gives the same rows.

Records are the embeddings: id is vec_id as text, and the metadata of a record is a
JSON object of its label and its document's lang, source and n_chars, or null
without a document. Distances are rounded to six places.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starling.functions import filters as flt
from starling.functions.distance import distance, norm
from starling.functions.quantize import dequantize, parameters, quantize, train
from starling.operators import ann, search as searching
from starling.sources.collection import Client, Collection
from starling.sources.files import shared_dir
from starling.sources.http import Api
from starling.sources.oplog import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

R = """WITH r AS (
    SELECT vec_id, vec_id::VARCHAR AS id, embedding::DOUBLE[] AS v, label::BIGINT AS label, doc_id IS NOT NULL AS has, lang, source, n_chars
    FROM embeddings LEFT JOIN documents ON doc_id = vec_id)"""
SQL_DISTANCE = {"cosine": "list_cosine_distance({0}, {1})", "euclidean": "pow(list_distance({0}, {1}), 2)", "dot_product": "list_negative_inner_product({0}, {1})"}
NAMES = {"cosine": "cosine", "euclidean": "l2sq", "dot_product": "dot"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without their documents: only the columns of embeddings are read."""
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("metadata"), "vec_id", "label")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = _table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    metadata = F.when(F.col("doc_id").isNotNull(), F.to_json(F.struct(F.col("label").cast("long").alias("label"), "lang", "source", "n_chars")))
    return joined.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), metadata.alias("metadata"), "vec_id")


def _fresh(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, metric: str = "cosine") -> Collection:
    """A new collection of rows, if given, with vectors as long as the table's."""
    made = Collection.in_memory(spark, len(_vector_of(spark, sf_dir, 3)), metric)
    if rows is not None:
        made.add_many(rows.select("id", "vector", "metadata"))
    return made


_KEPT: dict[tuple[str, str], Collection] = {}


def _kept(spark: SparkSession, sf_dir: str) -> Collection:
    """The collection of all records, saved once in a session for the queries that only read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = _fresh(spark, sf_dir, records(spark, sf_dir))
        _KEPT[key].save()
    return Collection.open(spark, _KEPT[key].path)


def _total() -> Column:
    return F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total")


def _places(c: Column | str) -> Column:
    return (F.round(c, 6) + F.lit(0.0)).alias("distance")


def _sql_places(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def _add_metrics() -> None:
    for metric, short in NAMES.items():
        d = SQL_DISTANCE[metric]

        def one(spark, sf_dir, metric=metric):
            found = searching.search(vectors(spark, sf_dir), _vector_of(spark, sf_dir, 3), 10, metric)
            return found.select("id", _places("distance"))

        query(f"knn_{short}", f"""{R}, d AS (SELECT r.id, {d.format('r.v', 'q.v')} AS d FROM r, (SELECT v FROM r WHERE vec_id = 3) q)
            SELECT id, {_sql_places('d')} AS distance FROM d ORDER BY d, id LIMIT 10""")(one)

        def many(spark, sf_dir, metric=metric):
            rows = vectors(spark, sf_dir)
            asked = rows.select(F.col("id").alias("query_id"), "vector")
            return searching.search_many(rows, asked, 10, metric, with_metadata=False).select("query_id", "rank", "id", _places("distance"))

        query(f"knn_join_{short}", f"""{R}, d AS (SELECT q.id AS query_id, r.id, {d.format('r.v', 'q.v')} AS d FROM r, r q),
            k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM d)
            SELECT query_id, rank, id, {_sql_places('d')} AS distance FROM k WHERE rank <= 10""")(many)

        def pairs(spark, sf_dir, metric=metric):
            rows = vectors(spark, sf_dir)
            a, b = rows.select("vec_id", F.col("vector").alias("a")), rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("b"))
            return a.join(b, "vec_id").select("vec_id", _places(distance(metric, "a", "b")))

        query(f"distance_{short}", f"{R} SELECT a.vec_id, {_sql_places(d.format('a.v', 'b.v'))} AS distance FROM r a JOIN r b ON b.vec_id = a.vec_id + 1")(pairs)


_add_metrics()


@query("vector_norm", f"{R} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM r")
def vector_norm(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", F.round(norm("vector"), 6).alias("norm"))


@query("knn_max_distance", f"""{R}, d AS (SELECT r.id, list_cosine_distance(r.v, q.v) AS d FROM r, (SELECT v FROM r WHERE vec_id = 3) q),
    k AS (SELECT * FROM d ORDER BY d, id LIMIT 10) SELECT id, round(d, 6) + 0.0 AS distance FROM k WHERE d <= 0.65""")
def knn_max_distance(spark, sf_dir):
    return searching.search(vectors(spark, sf_dir), _vector_of(spark, sf_dir, 3), 10, "cosine", max_distance=0.65).select("id", _places("distance"))


@query("knn_join_max_distance", f"""{R}, d AS (SELECT q.id AS query_id, r.id, list_cosine_distance(r.v, q.v) AS d FROM r, r q),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM d)
    SELECT query_id, rank, id, round(d, 6) + 0.0 AS distance FROM k WHERE rank <= 5 AND d <= 0.7""")
def knn_join_max_distance(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    return searching.search_many(rows, asked, 5, "cosine", max_distance=0.7, with_metadata=False).select("query_id", "rank", "id", _places("distance"))


@query("range_join", f"{R} SELECT q.id AS query_id, r.id, round(list_cosine_distance(r.v, q.v), 6) + 0.0 AS distance FROM r, r q WHERE list_cosine_distance(r.v, q.v) <= 0.7")
def range_join(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    found = searching.range_join(rows, rows.select(F.col("id").alias("query_id"), "vector"), 0.7)
    return found.select("query_id", "id", _places("distance"))


@query("dedup_pairs", f"""{R}, d AS (SELECT q.id AS query_id, r.id, list_cosine_distance(r.v, q.v) AS d FROM r, r q),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM d)
    SELECT query_id, id, round(d, 6) + 0.0 AS distance FROM k WHERE rank <= 5 AND d < 0.6 AND query_id <> id""")
def dedup_pairs(spark, sf_dir):
    return searching.duplicate_pairs(vectors(spark, sf_dir), 0.6, 5).select("query_id", "id", _places("distance"))


#: name: (filter, the same in SQL over r)
FILTERS = {
    "eq": ({"lang": "en"}, "has AND lang = 'en'"),
    "eq_int": ({"label": 3}, "has AND label = 3"),
    "eq_float": ({"label": 3.0}, "false"),
    "ne": ({"lang": {"$ne": "en"}}, "has AND lang <> 'en'"),
    "in": ({"lang": {"$in": ["de", "fr"]}}, "has AND lang IN ('de', 'fr')"),
    "gt": ({"label": {"$gt": 6}}, "has AND label > 6"),
    "gte": ({"label": {"$gte": 6}}, "has AND label >= 6"),
    "lt": ({"n_chars": {"$lt": 900}}, "has AND n_chars < 900"),
    "lte": ({"label": {"$lte": 2.5}}, "has AND label <= 2.5"),
    "range": ({"n_chars": {"$gte": 1000, "$lt": 2000}}, "has AND n_chars >= 1000 AND n_chars < 2000"),
    "and": ({"lang": "en", "label": {"$gt": 4}}, "has AND lang = 'en' AND label > 4"),
    "or": (flt.Or((flt.Eq("lang", "es"), flt.Gt("label", 7))), "has AND (lang = 'es' OR label > 7)"),
    "not_a_number": ({"lang": {"$gt": 1}}, "false"),
    "absent": ({"colour": {"$ne": "red"}}, "has"),
    "empty": ({}, "false"),
}
for _name, (_filter, _sql) in FILTERS.items():
    query(f"filter_{_name}", f"{R} SELECT id FROM r WHERE {_sql}")(lambda spark, sf_dir, f=_filter: records(spark, sf_dir).where(flt.metadata_filter(f)).select("id"))


@query("filter_typed", "SELECT doc_id FROM documents WHERE lang IN ('de', 'es') AND n_chars >= 500 AND source <> 'src0'")
def filter_typed(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    fields = flt.TypedFields({c: F.col(c) for c in ("lang", "source", "n_chars")})
    return docs.where(flt.typed_condition({"lang": {"$in": ["de", "es"]}, "n_chars": {"$gte": 500}, "source": {"$ne": "src0"}}, fields)).select("doc_id")


@query("filter_promoted", f"{R} SELECT id FROM r WHERE has AND lang IN ('de', 'es') AND n_chars >= 500")
def filter_promoted(spark, sf_dir):
    """A filter over fields that a snapshot holds as columns."""
    made = _fresh(spark, sf_dir, records(spark, sf_dir))
    made.promote("lang", "n_chars")
    return made.records({"lang": {"$in": ["de", "es"]}, "n_chars": {"$gte": 500}}).select("id")


for _name, _filter, _sql in (
    ("gt", {"k": {"$gt": 50}}, "json_extract(props, '$.k')::DOUBLE > 50"),
    ("eq", {"k": 7}, "json_extract(props, '$.k')::BIGINT = 7"),
    ("in", {"k": {"$in": [1, 2, 3]}}, "json_extract(props, '$.k')::BIGINT IN (1, 2, 3)"),
    ("missing", {"other": 1}, "false"),
):
    query(f"filter_json_{_name}", f"SELECT event_id FROM events WHERE {_sql}")(
        lambda spark, sf_dir, f=_filter: _table(spark, sf_dir, "events").where(flt.metadata_filter(f, "props")).select("event_id")
    )


@query("filter_ne_missing_metadata", "SELECT d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality <> 1")
def filter_ne_missing_metadata(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l"), F.to_json(F.struct("quality", "toxic")).alias("metadata"))
    docs = _table(spark, sf_dir, "documents").select("doc_id").join(labels, F.col("doc_id") == F.col("l"), "left")
    return docs.where(flt.metadata_filter({"quality": {"$ne": 1}})).select("doc_id")


@query("knn_filtered", f"""{R}, d AS (SELECT r.id, list_cosine_distance(r.v, q.v) AS d FROM r, (SELECT v FROM r WHERE vec_id = 3) q WHERE has AND lang = 'en')
    SELECT id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d, id LIMIT 10""")
def knn_filtered(spark, sf_dir):
    return searching.search(records(spark, sf_dir), _vector_of(spark, sf_dir, 3), 10, where={"lang": "en"}).select("id", _places("distance"))


@query("knn_join_filtered", f"""{R}, d AS (SELECT q.id AS query_id, r.id, list_cosine_distance(r.v, q.v) AS d FROM r, r q WHERE r.has AND r.label < 5),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id)::INTEGER AS rank FROM d)
    SELECT query_id, rank, id, round(d, 6) + 0.0 AS distance FROM k WHERE rank <= 5""")
def knn_join_filtered(spark, sf_dir):
    rows = records(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    return searching.search_many(rows, asked, 5, where={"label": {"$lt": 5}}, with_metadata=False).select("query_id", "rank", "id", _places("distance"))


@query("count_all", "SELECT count(*) AS n FROM embeddings")
def count_all(spark, sf_dir):
    return spark.createDataFrame([(len(_kept(spark, sf_dir)),)], "n long")


@query("count_filtered", f"{R} SELECT count(*) AS n FROM r WHERE has AND lang = 'en'")
def count_filtered(spark, sf_dir):
    return spark.createDataFrame([(_kept(spark, sf_dir).count({"lang": "en"}),)], "n long")


@query("count_and_mixed", f"{R} SELECT count(*) AS n FROM r WHERE has AND lang = 'en' AND n_chars > 1500")
def count_and_mixed(spark, sf_dir):
    return spark.createDataFrame([(_kept(spark, sf_dir).count({"lang": "en", "n_chars": {"$gt": 1500}}),)], "n long")


@query("get_by_id", f"{R} SELECT id, label, lang, source, n_chars, round(list_sum(v), 6) AS total FROM r WHERE vec_id = 17")
def get_by_id(spark, sf_dir):
    vector, m = _kept(spark, sf_dir).get("17")
    row = ("17", m["label"], m["lang"], m["source"], m["n_chars"], round(sum(vector), 6))
    return spark.createDataFrame([row], "id string, label long, lang string, source string, n_chars long, total double")


@query("contains_many", f"{R} SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id::VARCHAR IN (SELECT id FROM r)")
def contains_many(spark, sf_dir):
    return _kept(spark, sf_dir).contains_many(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id")))


@query("ids", f"{R} SELECT id FROM r")
def ids(spark, sf_dir):
    return _kept(spark, sf_dir).ids()


SQ8 = """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    p AS (SELECT pos, min(x) AS low, CASE WHEN max(x) = min(x) THEN 1.0 ELSE (max(x) - min(x)) / 255 END AS scale FROM e GROUP BY pos),
    c AS (SELECT vec_id, pos, x, floor(least(greatest((x - low) / scale, 0), 255) + 0.5) AS code, low, scale FROM e JOIN p USING (pos))"""


@query("sq8_params", f"{SQ8} SELECT pos::INTEGER AS pos, round(low, 6) AS low, round(scale, 9) AS scale FROM p")
def sq8_params(spark, sf_dir):
    return train(vectors(spark, sf_dir)).select("pos", F.round("low", 6).alias("low"), F.round("scale", 9).alias("scale"))


@query("sq8_codes", f"{SQ8} SELECT vec_id, pos::INTEGER AS pos, code::INTEGER AS code FROM c")
def sq8_codes(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rows.select("vec_id", F.posexplode(quantize("vector", *parameters(train(rows)))).alias("pos", "code")).withColumn("code", F.col("code").cast("int"))


@query("sq8_reconstruct_error", f"{SQ8} SELECT vec_id, round(max(abs(code * scale + low - x)), 6) AS error FROM c GROUP BY vec_id")
def sq8_reconstruct_error(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    low, scale = parameters(train(rows))
    back = dequantize(quantize("vector", low, scale), low, scale)
    return rows.select("vec_id", F.round(F.array_max(F.zip_with(back, F.col("vector").cast("array<double>"), lambda a, b: F.abs(a - b))), 6).alias("error"))


@query("sq8_two_stage_topk", f"""{SQ8}, b AS (SELECT vec_id, list(code * scale + low ORDER BY pos) AS w, list(x ORDER BY pos) AS v FROM c GROUP BY vec_id),
    q AS (SELECT v FROM b WHERE vec_id = 3), s AS (SELECT b.vec_id::VARCHAR AS id, b.v FROM b, q ORDER BY list_cosine_distance(b.w, q.v), b.vec_id::VARCHAR LIMIT 200),
    d AS (SELECT id, list_cosine_distance(s.v, q.v) AS d FROM s, q) SELECT id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d, id LIMIT 10""")
def sq8_two_stage_topk(spark, sf_dir):
    return ann.two_stage_search(vectors(spark, sf_dir), _vector_of(spark, sf_dir, 3), 10, effort=200).select("id", _places("distance"))


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A snapshot of the even vectors and a log that adds, deletes, updates and adds again by the id's remainders."""
    rows = vectors(spark, sf_dir).drop("metadata")
    snapshot = rows.where("vec_id % 2 = 0").select("id", "vector", F.lit('{"v":0}').alias("metadata"))
    op = lambda when, seq, kind, metadata, sets: rows.where(when).select("id", F.lit(seq).cast("long").alias("seq"), F.lit(kind).alias("op"), (F.col("vector") if kind == "A" else F.lit(None).cast("array<float>")).alias("vector"), F.lit(metadata).cast("string").alias("metadata"), F.lit(sets).alias("sets_metadata"))
    steps = [op("vec_id % 3 = 0", 0, "A", '{"v":1}', True), op("vec_id % 5 = 0", 1, "D", None, False), op("vec_id % 7 = 0", 2, "U", '{"v":2}', True), op("vec_id % 11 = 0", 3, "U", None, True), op("vec_id % 10 = 0", 4, "A", '{"v":3}', True), op("vec_id % 20 = 0", 5, "U", '{"v":4}', True), op("vec_id % 13 = 0", 6, "U", None, False)]
    log = steps[0]
    for more in steps[1:]:
        log = log.unionByName(more)
    return snapshot, log


@query("oplog_fold", """SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 20 = 0 THEN '{"v":4}' WHEN vec_id % 10 = 0 THEN '{"v":3}' WHEN vec_id % 11 = 0 THEN NULL
    WHEN vec_id % 7 = 0 THEN '{"v":2}' WHEN vec_id % 3 = 0 THEN '{"v":1}' ELSE '{"v":0}' END AS metadata, round(list_sum(embedding::DOUBLE[]), 6) AS total
    FROM embeddings WHERE vec_id % 10 = 0 OR ((vec_id % 2 = 0 OR vec_id % 3 = 0) AND vec_id % 5 <> 0)""")
def oplog_fold(spark, sf_dir):
    total = F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6)
    return fold(*_changes(spark, sf_dir)).select("id", "metadata", total.alias("total"))


@query("update_partial", "SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 4 = 0 THEN NULL ELSE label::VARCHAR END AS metadata FROM embeddings")
def update_partial(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    log = rows.where("vec_id % 4 = 0").select("id", F.lit(0).cast("long").alias("seq"), F.lit("U").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(True).alias("sets_metadata"))
    return fold(rows.select("id", "vector", F.col("label").cast("string").alias("metadata")), log).select("id", "metadata")


@query("upsert_latest", "SELECT user_id::VARCHAR AS id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.array(F.lit(0.0)).alias("vector"), F.col("event_type").alias("metadata"), "event_id")
    made = Collection.in_memory(spark, 1)
    made.upsert_many(events, order_col="event_id")
    return made.records().select("id", F.col("metadata").alias("event_type"))


@query("delete_anti", "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def delete_anti(spark, sf_dir):
    made = _fresh(spark, sf_dir, vectors(spark, sf_dir))
    made.delete_many(_table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id")))
    return made.ids()


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.from_json("metadata", "label long, lang string").alias("m"), _total()).select("id", "m.*", "total")


FIELDS = f"{R} SELECT id, CASE WHEN has THEN label END AS label, lang, round(list_sum(v), 5) AS total FROM r"


@query("import_export_roundtrip", FIELDS)
def import_export_roundtrip(spark, sf_dir):
    """Each record through lines of JSON into another collection."""
    made, path = _fresh(spark, sf_dir), f"{shared_dir(spark)}/lines-{uuid.uuid4().hex[:12]}"
    _kept(spark, sf_dir).export_jsonl(path)
    made.import_jsonl(path)
    return _fields(made.records())


@query("json_document_roundtrip", FIELDS)
def json_document_roundtrip(spark, sf_dir):
    """The collection as one document in a file, read into a new collection."""
    kept, name = _kept(spark, sf_dir), f"document-{uuid.uuid4().hex[:8]}.json"
    kept.files.write_new(name, kept.export_json())
    made = Collection.import_file(spark, f"{shared_dir(spark)}/copy-{uuid.uuid4().hex[:12]}", f"{kept.path}/{name}")
    return _fields(made.records())


LIFE = """SELECT vec_id::VARCHAR AS id, CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id = 7 THEN '{"v":2}' WHEN vec_id % 3 = 0 THEN '{"v":1}' ELSE '{"label":' || label || '}' END AS metadata,
    round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE vec_id % 10 = 0 OR ((vec_id % 4 <> 0 OR vec_id % 3 = 0) AND vec_id % 5 <> 0)"""


def _lived(spark: SparkSession, sf_dir: str) -> Collection:
    """Adds, upserts, deletes, updates, compacts, upserts again, each for ids of some remainders."""
    rows = vectors(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("label")))
    made = _fresh(spark, sf_dir, rows.where("vec_id % 4 <> 0"))
    made.upsert_many(rows.where("vec_id % 3 = 0").select("id", "vector", F.lit('{"v":1}').alias("metadata")))
    made.delete_many(rows.where("vec_id % 5 = 0").select("id"))
    made.update("7", metadata='{"v":2}')
    made.compact()
    made.upsert_many(rows.where("vec_id % 10 = 0").select("id", "vector"))
    return made


@query("collection_life", LIFE)
def collection_life(spark, sf_dir):
    return _lived(spark, sf_dir).records().select("id", "metadata", _total())


@query("collection_reopened", LIFE)
def collection_reopened(spark, sf_dir):
    """The same from a snapshot, with an index and codes, opened again."""
    made = _lived(spark, sf_dir)
    made.save()
    made.build_index()
    made.enable_quantized_search()
    return Collection.open(spark, made.path).records().select("id", "metadata", _total())


@query("index_recall", "SELECT count(*) AS n, true AS reached FROM embeddings")
def index_recall(spark, sf_dir):
    """Whether the mean recall at 10 of a stored index, of a fifth of whose rows only the log knows, is 0.9 or more with every vector as a query."""
    rows = vectors(spark, sf_dir)
    made = _fresh(spark, sf_dir, rows.where("vec_id % 5 <> 0"))
    made.build_index()
    made.add_many(rows.where("vec_id % 5 = 0").select("id", "vector", "metadata"))
    opened, asked = Collection.open(spark, made.path), rows.select(F.col("id").alias("query_id"), "vector")
    found = opened.search_many(asked, 10, exact=False)
    each = searching.recall(found, opened.search_many(asked, 10, exact=True))
    return each.agg(F.count(F.lit(1)).alias("n"), (F.avg("recall") >= ann.RECALL).alias("reached"))


@query("index_complete", f"""{R}, d AS (SELECT r.id, list_cosine_distance(r.v, q.v) AS d FROM r, (SELECT v FROM r WHERE vec_id = 3) q WHERE has AND lang = 'en')
    SELECT id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d, id LIMIT 1000000""")
def index_complete(spark, sf_dir):
    """A filtered search through an index for more rows than there are: all that match."""
    made = _fresh(spark, sf_dir, records(spark, sf_dir))
    made.build_index()
    return made.search(_vector_of(spark, sf_dir, 3), 1_000_000, where_filter={"lang": "en"}, exact=False).select("id", _places("distance"))


@query("sq8_stored_topk", ORACLES["sq8_two_stage_topk"])
def sq8_stored_topk(spark, sf_dir):
    """Two stages over the codes of a snapshot that was opened again."""
    made = _fresh(spark, sf_dir, vectors(spark, sf_dir))
    made.enable_quantized_search()
    return Collection.open(spark, made.path).search(_vector_of(spark, sf_dir, 3), 10, ef_search=200).select("id", _places("distance"))


@query("http_search", ORACLES["knn_filtered"])
def http_search(spark, sf_dir):
    """The filtered search as the server's route answers it."""
    kept = _kept(spark, sf_dir)
    root, name = kept.path.rsplit("/", 1)
    body = {"vector": _vector_of(spark, sf_dir, 3), "k": 10, "filter": {"lang": "en"}}
    _, found = Api(Client(spark, root)).handle("POST", f"/collections/{name}/search", json.dumps(body).encode())
    return spark.createDataFrame([(r["id"], r["distance"]) for r in found], "id string, distance double").select("id", _places("distance"))


@query("stats_basic", "SELECT count(*) AS num_vectors, sum(len(embedding) * 4)::BIGINT AS vector_bytes, max(len(embedding))::INTEGER AS dim FROM embeddings")
def stats_basic(spark, sf_dir):
    stats = _kept(spark, sf_dir).stats()
    return spark.createDataFrame([(stats["num_vectors"], stats["vector_bytes"], stats["dim"])], "num_vectors long, vector_bytes long, dim int")


@query("recall_ivf")
def recall_ivf(spark, sf_dir):
    """Recall at 10 of the inverted-file index, for every vector as a query: query_id, recall."""
    rows = vectors(spark, sf_dir)
    asked = rows.select(F.col("id").alias("query_id"), "vector")
    found = ann.build_ivf(rows, "cosine", seed=0).search_many(asked, 10)
    return searching.recall(found, searching.search_many(rows, asked, 10, with_metadata=False))
