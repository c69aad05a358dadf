"""Stored tables with versions: a change is whole or not there at all.

New files are written beside the old ones. A small JSON manifest for each version says
which folders make up which table; it appears by one rename, so a reader finds the old
version or the new one, never parts of both. A job that dies leaves folders that no
manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 256
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another job published the same version first; read again and repeat."""


def bucket(doc: Column, buckets: int) -> Column:
    """The bucket of a document; a null id has one too."""
    return F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")


class Store:
    """Tables below ``path``, a folder that all machines share.

    A plain table is a list of folders. A table by documents is dealt into a fixed number
    of buckets by a hash of ``doc_id``, so documents can be replaced without reading the
    rest, and the number of folders does not grow with that of documents.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest published version, 0 if there is none."""
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version; rows published later are not in it."""
        about = self.manifest(version)[name]
        return self._load(about, about["folders"])

    def _load(self, about: dict, folders) -> DataFrame:
        schema = T.StructType.fromJson(about["schema"])
        folders = sorted(set(folders))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def publish(self, tables: dict[str, DataFrame], by_document: tuple[str, ...] = (), buckets: int = BUCKETS) -> int:
        """Replace these tables by new ones, all in one version; other tables stay."""
        before = self.version()
        found = self.manifest(before)
        for name, df in tables.items():
            found[name] = self._written_buckets(name, df, buckets) if name in by_document else {"schema": df.schema.jsonValue(), "folders": [self._written(name, df)]}
        return self._commit(found, before)

    def replace(self, name: str, rows: DataFrame, docs: DataFrame) -> int:
        """Replace all rows of the documents in ``docs(doc_id)`` by those of them in ``rows``.

        Only buckets that hold one of them are read and written. Rows of other documents
        in ``rows`` are ignored; a document without new rows is gone.
        """
        before = self.version()
        found = self.manifest(before)
        about = found[name]
        buckets = about["buckets"]
        ids = docs.select("doc_id").distinct()
        touched = [r[0] for r in ids.select(bucket(F.col("doc_id"), buckets)).distinct().collect()]  # at most one row a bucket
        old = self._load(about, [about["folder_of"][str(b)] for b in touched if str(b) in about["folder_of"]])
        schema = T.StructType.fromJson(about["schema"])
        wanted = ids.withColumnRenamed("doc_id", "_doc")
        same = F.col("doc_id").eqNullSafe(F.col("_doc"))
        new = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).join(wanted, same, "left_semi")
        part = self._written_buckets(name, old.join(wanted, same, "left_anti").unionByName(new), buckets)
        kept = {b: f for b, f in about["folder_of"].items() if int(b) not in set(touched)}
        about["folder_of"] = {**kept, **part["folder_of"]}
        about["folders"] = list(about["folder_of"].values())
        return self._commit(found, before)

    def append_new(self, name: str, rows: DataFrame, key: str) -> int:
        """Add the rows whose ``key`` the table does not hold yet, each key once.

        Repeating the call, or running it again after a failure, adds nothing twice. If
        another job published in between, ``Conflict`` is raised and nothing is added.
        """
        before = self.version()
        found = self.manifest(before)
        once = rows.dropDuplicates([key]).where(F.col(key).isNotNull())
        about = found.setdefault(name, {"schema": once.schema.jsonValue(), "folders": []})
        if about["folders"]:
            once = once.join(self._load(about, about["folders"]).select(key), key, "left_anti").select(*rows.columns)
        about["folders"] = [*about["folders"], self._written(name, once)]
        return self._commit(found, before)

    def _written(self, name: str, df: DataFrame) -> str:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _written_buckets(self, name: str, df: DataFrame, buckets: int) -> dict:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        # Buckets are cut further by rows: a document with a third of all rows is many tasks and files.
        dealt = df.withColumn(_BUCKET, bucket(F.col("doc_id"), buckets))
        rows = F.xxhash64(*[f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()])  # maps have no hash
        dealt.repartitionByRange(F.col(_BUCKET), rows).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        there = [f.getPath().getName() for f in self._fs.listStatus(self._at(f"{self.path}/{folder}")) if f.isDirectory()]
        folder_of = {n.split("=")[1]: f"{folder}/{n}" for n in there if n.startswith(f"{_BUCKET}=")}
        return {"schema": df.schema.jsonValue(), "buckets": buckets, "folder_of": folder_of, "folders": list(folder_of.values())}

    def _commit(self, manifest: dict, before: int) -> int:
        """The manifest under the next number.

        Where a rename refuses a target that exists, as on HDFS, one of several jobs wins; on
        a local disk only jobs that follow each other are kept apart.
        """
        target, draft = self._at(f"{self.path}/versions/{before + 1:012d}.json"), self._at(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            raise Conflict(f"version {before + 1} of {self.path} was published by another job")
        return before + 1

