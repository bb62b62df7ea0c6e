"""Tables of versioned buckets: a commit replaces or extends some buckets for all readers at once, or changes nothing.

Rows lie in ``data/<version>/_bucket=<n>``, by a hash of their key. A manifest names the folders of each bucket; a commit writes new folders
beside the old ones and then the next manifest, as one mark. Files that a manifest names are never changed, so a reader that has
begun goes on with its own version, and a writer that dies leaves the table as it was.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pageflow.sources.ledger import Ledger, delete


class Conflict(RuntimeError):
    """Another writer has changed the same buckets meanwhile."""


class Table:
    """A table in ``folder``. All its writers must name the same ``keys`` and number of ``buckets``; the number is kept from the first commit on."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), list(keys)
        self.ledger = Ledger(spark, f"{self.folder}/manifest")
        self.buckets = self.manifest().get("of", buckets)

    def manifest(self) -> dict:
        """What the table is made of: number, schema, buckets (number -> folders below the table's), and tags."""
        names = self.ledger.names()
        return self.ledger.get(names[-1]) if names else {"number": 0, "schema": None, "buckets": {}, "tags": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, only: set[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows, or those of some buckets; None if nothing was ever committed."""
        known = manifest or self.manifest()
        if known["schema"] is None:
            return None
        schema = StructType.fromJson(known["schema"])
        paths = [f"{self.folder}/{path}" for b, folders in known["buckets"].items() if only is None or int(b) in only for path in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, new: DataFrame) -> set[int]:
        """Numbers of the buckets that rows fall into: a row a bucket comes to the driver at most."""
        return {r[0] for r in new.select(self.bucket().alias("b")).distinct().collect()}

    def commit(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None, tags: dict | None = None, attempts: int = 3) -> int:
        """Put ``new`` into the table; the number of the manifest that has it.

        ``merge(old, new)`` gives the rows of the touched buckets from what they hold and from ``new``; without it rows of ``new`` replace
        those of equal keys. Only buckets that ``new`` has keys in are read and written. If another writer commits first, this one is
        done again on what that one left. ``tags`` are kept in the manifest until a later commit replaces them.
        """
        merge = merge or self._replaced

        def change(known: dict, new: DataFrame) -> tuple[dict, DataFrame | None]:
            touched = self.touched(new)
            old = self.read(touched, known)
            rows = new if old is None else merge(old.select(*new.columns), new)
            return {str(b): [] for b in touched}, rows if touched else None

        return self._put(change, new, tags, attempts)

    def append(self, new: DataFrame, tags: dict | None = None, most: int = 16, attempts: int = 3) -> int:
        """Add rows without reading any; the number of the manifest that has them. A bucket of more than ``most`` folders is put together into one."""

        def change(known: dict, new: DataFrame) -> tuple[dict, DataFrame | None]:
            touched = self.touched(new)
            held = {str(b): known["buckets"].get(str(b), []) for b in touched}
            full = {int(b) for b, folders in held.items() if len(folders) >= most}
            rows = new if not full else new.unionByName(self.read(full, known).select(*new.columns))
            return {b: [] if int(b) in full else folders for b, folders in held.items()}, rows if touched else None

        return self._put(change, new, tags, attempts)

    def _put(self, change: Callable[[dict, DataFrame], tuple[dict, DataFrame | None]], new: DataFrame, tags: dict | None, attempts: int) -> int:
        """Write the rows of a change, then the manifest in which each changed bucket has its folders that stay and the new one.

        ``new`` is computed once and kept meanwhile: its buckets and its rows must be of one run, and it may be dear.
        """
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        new.write.parquet(staged)
        try:
            rows = self.spark.read.schema(new.schema).parquet(staged)
            for _ in range(attempts):
                known = self.manifest()
                stay, made = change(known, rows)
                version = f"data/{uuid.uuid4().hex}"
                if made is not None:
                    made.withColumn("_bucket", self.bucket()).write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
                after = {
                    "number": known["number"] + 1, "of": self.buckets, "keys": self.keys, "schema": new.schema.jsonValue(), "at": time.time(),
                    "buckets": known["buckets"] | {b: [*folders, f"{version}/_bucket={b}"] for b, folders in stay.items()}, "tags": known["tags"] | (tags or {}),
                }
                if self.ledger.put(f"{after['number']:012}.json", after):
                    return after["number"]
                delete(self.spark, f"{self.folder}/{version}")
        finally:
            delete(self.spark, staged)
        raise Conflict(f"{self.folder}: others have committed first {attempts} times")

    def _replaced(self, old: DataFrame, new: DataFrame) -> DataFrame:
        given = new.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)]).distinct()
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.keys)])
        return old.join(given, same, "left_anti").unionByName(new)

    def vacuum(self, keep: int = 2) -> int:
        """Remove manifests before the last ``keep``, and data that none of those names; the number of data folders removed.

        Not while a writer is at work: what it has written isn't named yet. Readers of older versions lose their files.
        """
        names = self.ledger.names()
        for name in names[:-keep]:
            delete(self.spark, f"{self.ledger.folder}/{name}")
        named = {path for name in names[-keep:] for folders in self.ledger.get(name)["buckets"].values() for path in folders}
        data, gone = Ledger(self.spark, f"{self.folder}/data"), 0
        for version in data.names():
            if not any(path.startswith(f"data/{version}/") for path in named):
                delete(self.spark, f"{self.folder}/data/{version}")
                gone += 1
        return gone
