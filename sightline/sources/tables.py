"""Stored tables with inserts, updates and deletes.

Rows are dealt over buckets by their key, and a version of a table is a list of one folder per bucket. A change rewrites the
buckets that its keys fall in, as new folders, and then commits by creating the next version's file, which exactly one of two
writers can; the other one sees what has changed meanwhile and tries again. Readers see whole versions: what a writer left
before it could commit is in none. Changes return the rows that they inserted, updated or deleted.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sightline.operators.devices import partial_update
from sightline.session import delete, materialize

#: How often a change is tried when others commit first.
TRIES = 20


class Conflict(RuntimeError):
    """Others have committed each time before this change could."""


class StoredTable:
    """Rows of a schema with a unique key below a path that all machines share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 32):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def version(self) -> int:
        """The number of the newest version; 0 before the first."""
        fs, where = self._fs("versions")
        found = fs.listStatus(where) if fs.exists(where) else ()
        return max((int(f.getPath().getName().split(".")[0]) for f in found), default=0)

    def _folders(self, version: int) -> dict[int, str]:
        if not version:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{version:012}.json", wholetext=True).first()[0]
        return {int(b): f for b, f in json.loads(text).items()}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*(f"{self.path}/{f}" for f in folders.values())) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._folders(self.version() if version is None else version))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _commit(self, version: int, folders: dict[int, str]) -> bool:
        """Give the version a file, unless another writer has: a whole file gets its name at once or not at all."""
        fs, draft = self._fs(f"drafts/{uuid.uuid4().hex}")
        _, final = self._fs(f"versions/{version:012}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(folders), "utf-8"))
        out.close()
        fs.mkdirs(final.getParent())
        try:
            if fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            else:
                jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
                only_new = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                only_new[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, only_new)
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.toString():
                return False
            raise
        finally:
            fs.delete(draft, False)
        return True

    def _change(self, keys: DataFrame, make: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """make(rows of the touched buckets) gives the rows that these then have, and those to return."""
        for _ in range(TRIES):
            base = self.version()
            before = self._folders(base)
            touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # as many as there are buckets
            after, back = make(self._read({b: f for b, f in before.items() if b in touched}))
            back = materialize(back, "returned")
            name = f"data/{uuid.uuid4().hex}"
            written = after.withColumn("bucket", self._bucket()).repartition("bucket")
            written.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/{name}")
            filled = {r[0] for r in rows.select("bucket").distinct().collect()}
            folders = {b: f for b, f in before.items() if b not in touched} | {b: f"{name}/bucket={b}" for b in filled}
            if self._commit(base + 1, folders):
                return back
            delete(self.spark, f"{self.path}/{name}")
        raise Conflict(f"{self.path}: not committed in {TRIES} tries")

    def insert(self, rows: DataFrame) -> DataFrame:
        """Insert rows whose key is not there yet (of several with one key the least); returns those inserted."""
        own = rows.select(*self.schema.names)
        one = own.groupBy(self.key).agg(F.min(F.struct(*own.columns)).alias("r")).select("r.*")

        def make(now: DataFrame) -> tuple[DataFrame, DataFrame]:
            new = one.join(now.select(self.key), self.key, "left_anti").select(*self.schema.names)
            return now.unionByName(new), new

        return self._change(own, make)

    def update(self, changes: DataFrame) -> DataFrame:
        """Set what changes (the key and some columns, a row per key) gives, but for nulls and empty values; returns the rows
        that it has a key of, as they then are."""

        def make(now: DataFrame) -> tuple[DataFrame, DataFrame]:
            after = partial_update(now, changes, self.key).select(*self.schema.names)
            return after, after.join(changes.select(self.key), self.key, "left_semi")

        return self._change(changes, make)

    def remove(self, asked: DataFrame) -> DataFrame:
        """Delete the rows that asked (the key, and columns that must be equal too, such as an owner) fits; returns them."""
        on = [c for c in asked.columns if c in self.schema.names]

        def make(now: DataFrame) -> tuple[DataFrame, DataFrame]:
            which = asked.select(*on).distinct()
            return now.join(which, on, "left_anti").select(*self.schema.names), now.join(which, on, "left_semi").select(*self.schema.names)

        return self._change(asked, make)

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the newest versions don't hold; no writer may be at work."""
        newest = self.version()
        held = {f.rpartition("/")[0] for v in range(max(1, newest - keep + 1), newest + 1) for f in self._folders(v).values()}
        fs, where = self._fs("data")
        for f in fs.listStatus(where) if fs.exists(where) else ():
            if f"data/{f.getPath().getName()}" not in held:
                delete(self.spark, f.getPath().toString())
