"""Collections of records on shared storage, and a client for several of them.

A collection is a folder: manifest-<version>.json, of which the last counts, names
the snapshot (a Parquet folder), the log segments after it and, if there is an index,
its table of centroids. Every change writes a new segment and then the next manifest,
so readers see all of a change or nothing, and a writer that lost a race gets a
Conflict. What a snapshot replaces is deleted when the next one is written.

A snapshot is sorted by id, or laid out by list where the collection has an index; it
holds norms, eight-bit codes where quantized search is on, and columns of their own
for the metadata fields that the collection names: filters on those reach the scan.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starling import errors
from starling.functions.distance import check_vector, norm, parse_metric
from starling.functions.filters import implied, metadata_filter, promoted
from starling.functions.quantize import parameters, quantize, train
from starling.operators import ann, search as searching
from starling.sources.files import Files, shared_dir
from starling.sources.json_io import read_document, read_head, read_lines, records_to_json, rows_of_document
from starling.sources.oplog import LOG, RECORD, fold

#: update() leaves a field alone that it isn't given.
KEEP = object()
#: Segments after which a change folds the log into a new snapshot.
FOLD_AFTER = 64
#: Manifests that are left behind the last one, for readers that are about to open one.
MANIFESTS = 8
#: Vectors' bytes in a file of a snapshot, about.
FILE_BYTES = 128 << 20
#: An index is made anew when the collection has grown by this factor.
GROWN = 2


def _json(metadata) -> str | None:
    return None if metadata is None else metadata if isinstance(metadata, str) else json.dumps(metadata)


def _manifest_name(version: int) -> str:
    return f"manifest-{version:012d}.json"


def _last_manifest(files: Files) -> str | None:
    return max((n for n in files.names() if re.fullmatch(r"manifest-\d{12}\.json", n)), default=None)


class Collection:
    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest, self.files = spark, path.rstrip("/"), manifest, Files(spark, path)

    # Opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, dim: int, metric: str = "cosine", quantized: bool = False, fields=()) -> Collection:
        """`fields` are metadata keys that snapshots hold as columns."""
        if dim < 1:
            raise errors.InvalidVector("dim must be at least 1")
        metric = parse_metric(metric)
        files = Files(spark, path)
        if _last_manifest(files):
            raise errors.CollectionExists(path)
        files.make()
        made = cls(spark, path, {"version": 0, "dim": dim, "metric": metric, "quantized": quantized, "fields": list(dict.fromkeys(fields)), "sq8": None, "index": None, "snapshot": None, "segments": [], "next_seq": 0, "deleted": 0, "old": []})
        made._commit()
        return made

    @classmethod
    def in_memory(cls, spark: SparkSession, dim: int, metric: str = "cosine", quantized: bool = False) -> Collection:
        """A collection without a name, below the folder that executors share; drop() ends it."""
        return cls.create(spark, f"{shared_dir(spark)}/collection-{uuid.uuid4().hex[:12]}", dim, metric, quantized)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Collection:
        files = Files(spark, path)
        name = _last_manifest(files)
        if not name:
            raise errors.DatabaseNotFound(path)
        try:
            return cls(spark, path, files.read_json(name))
        except ValueError as e:
            raise errors.CorruptData(f"{path}/{name}: {e}") from e

    def drop(self) -> None:
        self.files.delete()

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, dim: int, metric: str = "cosine", quantized: bool = False) -> Collection:
        """An existing collection keeps its own dimension and metric."""
        return cls.open(spark, path) if _last_manifest(Files(spark, path)) else cls.create(spark, path, dim, metric, quantized)

    def _commit(self, **changes) -> None:
        after = self.manifest | changes | {"version": self.manifest["version"] + 1}
        if not self.files.write_new(_manifest_name(after["version"]), json.dumps(after)):
            raise errors.Conflict(f"{self.path} was changed by another writer; open it again")
        self.manifest = after
        self.files.delete(_manifest_name(after["version"] - MANIFESTS))

    # State

    @property
    def dim(self) -> int:
        return self.manifest["dim"]

    @property
    def metric(self) -> str:
        return self.manifest["metric"]

    @property
    def fields(self) -> list[str]:
        return self.manifest.get("fields", [])

    def _stored(self) -> DataFrame:
        """The snapshot with all its columns: id, vector, metadata, norm and, where it has them, fields, codes and list_id."""
        schema = f"{RECORD}, norm double" + "".join(f", text_{n} string, number_{n} double" for n in range(len(self.fields))) + (", codes array<smallint>" if self.manifest["sq8"] else "") + (", list_id int" if self.manifest["index"] else "")
        name = self.manifest["snapshot"]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], schema)

    def _snapshot(self) -> DataFrame:
        return self._stored().select("id", "vector", "metadata")

    def _pruned(self, where) -> DataFrame:
        """_stored() without rows that a filter, if given, drops by promoted fields."""
        condition = None if where is None or isinstance(where, Column) else implied(where, self.fields)
        return self._stored() if condition is None else self._stored().where(condition)

    def _with(self, column: str, of_vector, where=None) -> DataFrame:
        """Live records with a column that the snapshot has; of_vector computes it for those that the log touched.

        With a filter, at least those that it keeps."""
        stored = self._pruned(where).select("id", "vector", "metadata", column)
        if not self.manifest["segments"]:
            return stored
        touched, changed = self._touched()
        return stored.join(touched, "id", "left_anti").unionByName(changed.withColumn(column, of_vector(F.col("vector"))))

    def _touched(self) -> tuple[DataFrame, DataFrame]:
        """Ids that the log names, and those of them that live, as they are now."""
        touched = self.log().select("id").distinct()
        return touched, fold(self._snapshot().join(touched, "id", "left_semi"), self.log())

    def log(self) -> DataFrame:
        segments = self.manifest["segments"]
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/{s}" for s in segments]) if segments else self.spark.createDataFrame([], LOG)

    def records(self, where=None) -> DataFrame:
        """Live records, with a filter those that it keeps."""
        if where is None:
            return fold(self._snapshot(), self.log()) if self.manifest["segments"] else self._snapshot()
        rows = self._pruned(where).select("id", "vector", "metadata")
        if self.manifest["segments"]:
            touched, changed = self._touched()
            rows = rows.join(touched, "id", "left_anti").unionByName(changed)
        return rows.where(where if isinstance(where, Column) else metadata_filter(where))

    # Reading

    def get(self, id: str) -> tuple[list[float], object]:
        row = self.records().where(F.col("id") == id).first()
        if row is None:
            raise errors.NotFound(id)
        return list(row["vector"]), None if row["metadata"] is None else json.loads(row["metadata"])

    def contains(self, id: str) -> bool:
        return not self.records().where(F.col("id") == id).isEmpty()

    def contains_many(self, ids: DataFrame) -> DataFrame:
        """Those of ids (a column id) that the collection holds."""
        return ids.join(self.records().select("id"), "id", "left_semi")

    def ids(self) -> DataFrame:
        return self.records().select("id")

    def count(self, where=None) -> int:
        return self.records(where).count()

    def __len__(self) -> int:
        return self.count()

    def is_empty(self) -> bool:
        return self.records().isEmpty()

    def __contains__(self, id: str) -> bool:
        return self.contains(id)

    def search(self, vector, k: int = 10, ef_search: int | None = None, where_filter=None, max_distance: float | None = None, exact: bool | None = None) -> DataFrame:
        """id, distance, metadata.

        In two stages where quantized search is on. Else through the index, if there is
        one and ann.use_exact doesn't call the collection small enough to scan; `exact`
        decides that for one search."""
        vector = check_vector(vector, self.dim)
        if self.manifest["quantized"] and not exact:
            return ann.two_stage_search(self._coded(where_filter), vector, k, self.metric, ef_search, where_filter, max_distance, self._sq8())
        if self._uses_index(exact):
            return self.opened_index().search(vector, k, ef_search, None if where_filter is None else metadata_filter(where_filter), max_distance)
        return searching.search(self.records(where_filter), vector, k, self.metric, None, max_distance)

    def search_many(self, vectors, k: int = 10, ef_search: int | None = None, where_filter=None, max_distance: float | None = None, exact: bool | None = None) -> DataFrame:
        """query_id (place in vectors, from 0), rank, id, distance, metadata; vectors may be a DataFrame (query_id, vector).

        Through the index as search, but not with a filter."""
        if not isinstance(vectors, DataFrame):
            rows = [(i, check_vector(v, self.dim)) for i, v in enumerate(vectors)]
            vectors = self.spark.createDataFrame(rows, "query_id long, vector array<double>")
        if where_filter is not None or not self._uses_index(exact):
            return searching.search_many(self.records(where_filter), vectors, k, self.metric, None, max_distance)
        found = self.opened_index().search_many(vectors, k, ef_search)
        if max_distance is not None:
            found = found.where(F.col("distance") <= max_distance)
        return found.join(self.records().select("id", "metadata"), "id").select("query_id", "rank", "id", "distance", "metadata")

    # Index

    def _uses_index(self, exact: bool | None) -> bool:
        index = self.manifest["index"]
        return bool(index) and (not ann.use_exact(index["rows"], self.dim) if exact is None else not exact)

    def build_index(self, n_lists: int | None = None, seed: int = 0) -> None:
        """Lays the snapshot out by the lists of an inverted file, and measures how many lists to probe.

        From then on every save keeps it up to date, and searches see what the log holds."""
        if not self.is_empty():
            self._fold(centroids=ann.fit(self.records(), self.metric, n_lists, seed))

    def drop_index(self) -> None:
        if self.manifest["index"]:
            self._fold(keep_index=False)

    def opened_index(self) -> ann.IvfIndex:
        """The stored index over live records, those that the log holds included."""
        stored = self.manifest["index"]
        if not stored:
            raise errors.NotFound("index")
        index = ann.IvfIndex.load(f"{self.path}/{stored['table']}", self._stored(), self.metric, stored["needed"])
        if not self.manifest["segments"]:
            return index
        return ann.over_lists(self._with("list_id", ann.list_of(index.centroids, self.metric)), index.centroids, self.metric, index.needed)

    # Writing

    def _batch(self, ids, vectors, metadatas) -> DataFrame:
        ids, vectors = list(ids), list(vectors)
        metadatas = [None] * len(ids) if metadatas is None else list(metadatas)
        if not len(ids) == len(vectors) == len(metadatas):
            raise ValueError("ids, vectors and metadatas must be equally many")
        rows = [(i, check_vector(v, self.dim), _json(m)) for i, v, m in zip(ids, vectors, metadatas)]
        return self.spark.createDataFrame(rows, RECORD)

    def _checked(self, batch: DataFrame) -> DataFrame:
        """A DataFrame batch after one pass that looks for wrong dimensions and non-finite components."""
        batch = batch.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), (F.col("metadata").cast("string") if "metadata" in batch.columns else F.lit(None).cast("string")).alias("metadata"))
        bad = F.col("id").isNull() | F.col("vector").isNull() | (F.size("vector") != self.dim) | ~F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        row = batch.where(bad).select(F.size("vector").alias("n")).first()
        if row is not None:
            raise errors.DimensionMismatch(self.dim, row["n"]) if row["n"] not in (self.dim, -1) else errors.InvalidVector("a row has no id, or no vector of finite components")
        return batch

    def _append(self, ops: DataFrame, **changes) -> None:
        name = f"log-{self.manifest['next_seq']:012d}-{uuid.uuid4().hex[:8]}"
        ops.select("id", F.lit(self.manifest["next_seq"]).cast("long").alias("seq"), "op", "vector", "metadata", "sets_metadata").write.parquet(f"{self.path}/{name}")
        self._commit(segments=[*self.manifest["segments"], name], next_seq=self.manifest["next_seq"] + 1, **changes)
        if len(self.manifest["segments"]) >= FOLD_AFTER:
            self.save()

    def _adds(self, batch: DataFrame) -> DataFrame:
        return batch.select("id", F.lit("A").alias("op"), "vector", "metadata", F.lit(True).alias("sets_metadata"))

    def _deletes(self, ids: DataFrame) -> DataFrame:
        return ids.select("id", F.lit("D").alias("op"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("metadata"), F.lit(False).alias("sets_metadata"))

    def add(self, id: str, vector, metadata=None) -> None:
        self.add_many([id], [vector], [metadata])

    def add_many(self, ids, vectors=None, metadatas=None) -> None:
        """All or nothing; ids may be a DataFrame (id, vector[, metadata]). An id that exists, or comes twice, is an error."""
        batch = self._checked(ids) if isinstance(ids, DataFrame) else self._batch(ids, vectors, metadatas)
        twice = batch.groupBy("id").count().where("count > 1").select("id").first()
        twice = twice or batch.join(self.records().select("id"), "id", "left_semi").select("id").first()
        if twice:
            raise errors.DuplicateId(twice["id"])
        self._append(self._adds(batch))

    def add_flat(self, ids, flat, metadatas=None) -> None:
        """Vectors one after the other in a flat sequence, such as a float32 array."""
        ids, flat = list(ids), list(flat)
        if len(flat) != len(ids) * self.dim:
            raise errors.DimensionMismatch(len(ids) * self.dim, len(flat))
        self.add_many(ids, [flat[k : k + self.dim] for k in range(0, len(flat), self.dim)], metadatas)

    def upsert(self, id: str, vector, metadata=None) -> None:
        self.upsert_many([id], [vector], [metadata])

    def upsert_many(self, ids, vectors=None, metadatas=None, order_col: str | None = None) -> None:
        """Replaces vector and metadata of ids that exist.

        Of an id that comes twice in lists the last counts. In a DataFrame it is the one
        with the greatest order_col, and of those, or without it, the greatest vector and metadata."""
        if isinstance(ids, DataFrame):
            rows = ids.withColumn("metadata", F.col("metadata").cast("string") if "metadata" in ids.columns else F.lit(None).cast("string"))
            order = [F.col(order_col).alias("by")] if order_col else []
            last = F.max_by(F.struct("vector", "metadata"), F.struct(*order, "vector", "metadata")).alias("last")
            batch = self._checked(rows.groupBy("id").agg(last).select("id", "last.*"))
        else:
            ids, vectors = list(ids), list(vectors)
            metadatas = [None] * len(ids) if metadatas is None else list(metadatas)
            if not len(ids) == len(vectors) == len(metadatas):
                raise ValueError("ids, vectors and metadatas must be equally many")
            last = {i: (v, m) for i, v, m in zip(ids, vectors, metadatas)}
            batch = self._batch(last, [v for v, _ in last.values()], [m for _, m in last.values()])
        self._append(self._adds(batch))

    def update(self, id: str, vector=KEEP, metadata=KEEP) -> None:
        """Changes what is given; metadata=None clears it."""
        if not self.contains(id):
            raise errors.NotFound(id)
        row = (id, "U", None if vector is KEEP else check_vector(vector, self.dim), None if metadata is KEEP else _json(metadata), metadata is not KEEP)
        self._append(self.spark.createDataFrame([row], "id string, op string, vector array<float>, metadata string, sets_metadata boolean"))

    def delete(self, id: str) -> bool:
        return self.delete_many([id]) == 1

    def delete_many(self, ids) -> int:
        """How many of the ids, a list or a DataFrame, were there; unknown ones are ignored."""
        asked = ids.select("id") if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id string")
        there = self.records().select("id").join(asked.distinct(), "id", "left_semi")
        n = there.count()
        if n:
            self._append(self._deletes(there), deleted=self.manifest["deleted"] + n)
        return n

    # Upkeep

    def save(self) -> None:
        """Folds the log into a new snapshot, with codes and lists brought up to date."""
        if self.manifest["segments"] or not self.manifest["snapshot"]:
            self._fold()

    def _files_of(self, n: int) -> int:
        """Files of a snapshot: of FILE_BYTES of vectors, but enough for all cores to search where rows are not too few."""
        cores = self.spark.sparkContext.defaultParallelism
        return max(1, -(-n * self.dim * 4 // FILE_BYTES), min(cores, n // 1000))

    def _fold(self, centroids=None, keep_index: bool = True, **changes) -> None:
        refit, index = centroids is not None, self.manifest["index"] if keep_index else None
        rows, quantized = self.records(), changes.get("quantized", self.manifest["quantized"])
        if index and centroids is None:
            refit = rows.count() > GROWN * index["fitted"]
            centroids = ann.fit(rows, self.metric) if refit else self.opened_index().centroids
        tag = f"{self.manifest['next_seq']:012d}-{uuid.uuid4().hex[:8]}"
        fields = changes.get("fields", self.fields)
        out = rows.withColumn("norm", norm("vector")).withColumns(promoted("metadata", fields))
        blooms = {f"parquet.bloom.filter.enabled#text_{n}": "true" for n in range(len(fields))}  # for equality with rare values
        low, scale = parameters(train(rows)) if quantized else ([], [])
        changes["sq8"] = {"low": low, "scale": scale} if low else None
        if low:
            out = out.withColumn("codes", quantize("vector", low, scale))
        old = [*self.manifest["segments"], self.manifest["snapshot"], self.manifest["index"] and self.manifest["index"]["table"]]
        if centroids is None or not len(centroids):
            out.repartitionByRange(self._files_of(rows.count()), "id").sortWithinPartitions("id").write.options(**blooms).parquet(f"{self.path}/snapshot-{tag}")
            changes["index"] = None
        else:
            lists = out.withColumn("list_id", ann.list_of(centroids, self.metric)("vector"))
            ann.by_list(lists).write.options(**blooms).partitionBy("list_id").parquet(f"{self.path}/snapshot-{tag}")
            made = ann.over_lists(self.spark.read.schema(lists.schema).parquet(f"{self.path}/snapshot-{tag}"), centroids, self.metric)
            made.save(f"{self.path}/index-{tag}")
            n = sum(made.sizes.values())
            changes["index"] = {"table": f"index-{tag}", "needed": made.needed, "rows": n, "fitted": n if refit else index["fitted"], "lists": len(made.sizes)}
        behind = self.manifest["old"]
        self._commit(snapshot=f"snapshot-{tag}", segments=[], old=[name for name in old if name], **changes)
        for name in behind:
            self.files.delete(name)

    def compact(self) -> None:
        """Forgets deleted slots; does nothing if there are none."""
        if self.manifest["deleted"]:
            self.save()
            self._commit(deleted=0)

    def close(self) -> None:
        self.save()

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.save()

    def promote(self, *fields: str) -> None:
        """Gives these metadata fields, and no others, columns of their own in the snapshot."""
        self._fold(fields=list(dict.fromkeys(fields)))

    def enable_quantized_search(self) -> None:
        """Trains on live records and stores codes with the snapshot; does nothing without records."""
        if not self.is_empty():
            self._fold(quantized=True)

    def disable_quantized_search(self) -> None:
        if self.manifest["quantized"]:
            self._fold(quantized=False)

    def is_quantized(self) -> bool:
        return self.manifest["quantized"]

    def _sq8(self) -> tuple[list[float], list[float]] | None:
        stored = self.manifest["sq8"]
        return (stored["low"], stored["scale"]) if stored else None

    def _coded(self, where=None) -> DataFrame:
        """Records with their codes, if any are stored; those that the log touched are coded by the stored parameters. With a filter, at least those that it keeps."""
        sq8 = self._sq8()
        return self._with("codes", lambda v: quantize(v, *sq8), where) if sq8 else self.records(where)

    def quantized_records(self) -> DataFrame:
        """id and the eight-bit codes of each vector, as stored, or trained on live records where none are."""
        rows = self._coded()
        return rows.select("id", "codes") if self._sq8() else rows.select("id", quantize("vector", *parameters(train(rows))).alias("codes"))

    def stats(self) -> dict:
        live, size = self.records().agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector") * 4), F.lit(0))).first()
        index = self.manifest["index"]
        return {"index_lists": index["lists"] if index else 0, "index_rows": index["rows"] if index else 0, "num_vectors": live, "num_deleted": self.manifest["deleted"], "total_slots": live + self.manifest["deleted"], "dim": self.dim, "metric": self.metric, "vector_bytes": size, "quantized": self.manifest["quantized"], "fields": self.fields, "log_segments": len(self.manifest["segments"])}

    # Exchange

    def export_json(self, pretty: bool = False) -> str:
        """The whole collection as one document: for collections that fit on the driver; export_jsonl is for the others."""
        return records_to_json(self.records(), self.dim, self.metric, pretty)

    def export_jsonl(self, path: str) -> None:
        """A JSON object per record and line, written by the tasks."""
        rows = self.records().select("id", "vector", F.try_parse_json("metadata").alias("metadata"))
        rows.select(F.to_json(F.struct("id", "vector", "metadata")).alias("value")).write.text(path)

    @classmethod
    def import_file(cls, spark: SparkSession, path: str, file: str) -> Collection:
        """A new collection of the document in a file, which one task reads; import_jsonl is for large ones."""
        head = read_head(spark, file)
        made = cls.create(spark, path, head["dim"], head["metric"])
        made.add_many(read_document(spark, file))
        return made

    def import_jsonl(self, path: str) -> None:
        """Upserts the records of files with an object per line, read by the tasks."""
        self.upsert_many(read_lines(self.spark, path))

    @classmethod
    def import_json(cls, spark: SparkSession, path: str, document: str) -> Collection:
        head, ids, vectors, metadatas = rows_of_document(document)
        made = cls.create(spark, path, head["dim"], head["metric"])
        made.add_many(ids, vectors, metadatas)
        return made

    def import_json_into(self, document: str) -> int:
        """Upserts the document's records; its dimension must be the collection's, its metric is ignored."""
        head, ids, vectors, metadatas = rows_of_document(document)
        if head["dim"] != self.dim:
            raise errors.DimensionMismatch(self.dim, head["dim"])
        self.upsert_many(ids, vectors, metadatas)
        return len(ids)


class Client:
    """Named collections below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)
        self.files.make()

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", name) or ".." in name:
            raise errors.InvalidCollectionName(f"{name!r}: use letters, digits, '_', '-' and '.'")
        return f"{self.root}/{name}"

    def create_collection(self, name: str, dim: int, metric: str = "cosine", quantized: bool = False, fields=()) -> Collection:
        return Collection.create(self.spark, self._path(name), dim, metric, quantized, fields)

    def get_collection(self, name: str) -> Collection:
        return Collection.open(self.spark, self._path(name))

    def get_or_create_collection(self, name: str, dim: int, metric: str = "cosine", quantized: bool = False) -> Collection:
        return Collection.open_or_create(self.spark, self._path(name), dim, metric, quantized)

    def delete_collection(self, name: str) -> bool:
        self._path(name)
        return bool(_last_manifest(Files(self.spark, self._path(name)))) and self.files.delete(name)

    def list_collections(self) -> list[str]:
        return [n for n in self.files.names() if _last_manifest(Files(self.spark, f"{self.root}/{n}"))]
