"""Stored tables that change key by key.

A snapshot is a folder with one or more Parquet tables that share a key.  A change replaces, in all
tables at once, every row of the keys it names.  Changes are small tables beside a base that is cut
into buckets of the key; ``compact`` folds them into the buckets they touch and leaves the other
buckets where they are.  A manifest says which folders count.  It appears under its own number by one
rename after all data are written, so a lost driver or executor leaves the state before the change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"
VERSION = "_version"


class Snapshot:
    """The tables below ``path``; readers and the one writer each make their own object.

    ``buckets`` counts only when the folder is new, later objects take the recorded number.  Rows whose
    key is null belong to no key: they are added and never replaced.  Writers must not overlap; of two
    that do, the later one fails at its rename.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._buckets = buckets

    # --- reading -------------------------------------------------------------------------------------

    def manifest(self) -> dict:
        """The newest state: version, bucket folders of each table, open changes, last batch of each writer."""
        numbers = [int(name) for name in self._names("manifests") if name.isdigit()]
        if not numbers:
            return {"version": 0, "key": self.key, "buckets": self._buckets, "schemas": {}, "base": {}, "changes": [], "applied": {}}
        files, path = self._files(f"manifests/{max(numbers):012d}")
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str) -> DataFrame:
        """Current rows of one table: its base without the changed keys, and each key's newest change."""
        state = self.manifest()
        return self._merged(state, name, sorted(state["base"][name].values()))

    def _merged(self, state: dict, name: str, base_folders: Sequence[str], buckets: Collection[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schemas"][name])
        base = self._rows(schema, base_folders)
        if not state["changes"]:
            return base
        key_field = next(f for f in schema.fields if f.name == self.key)
        marked = StructType([*schema.fields]).add(VERSION, "long")
        keys = self._rows(StructType([key_field]).add(VERSION, "long"), [c["keys"] for c in state["changes"]])
        changed = keys.groupBy(self.key).agg(F.max(VERSION).alias(VERSION))
        folders = [c["tables"][name] for c in state["changes"] if name in c["tables"]]
        if buckets is not None:
            folders = [f"{f}/{BUCKET}={b}" for f in folders for b in self._buckets_of(f) if b in buckets]
        rows = self._rows(marked, folders)
        newest = rows.join(changed, [self.key, VERSION], "left_semi").unionByName(rows.filter(F.col(self.key).isNull()))
        return base.join(changed, self.key, "left_anti").unionByName(newest.drop(VERSION)).select(*schema.names)

    def _rows(self, schema: StructType, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        # Folders are given one by one, so bucket folders are no partition column here.
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    # --- writing -------------------------------------------------------------------------------------

    def begin(self, writer: str | None = None, batch: int | None = None) -> Change | None:
        """A change to fill and commit; None if this writer's batch (or a later one) was committed before."""
        state = self.manifest()
        if writer is not None and batch is not None and state["applied"].get(writer, -1) >= batch:
            return None
        return Change(self, state, writer, batch)

    def replace(self, rows: Mapping[str, DataFrame], keys: DataFrame | None = None, writer: str | None = None, batch: int | None = None) -> bool:
        """Replace all rows of ``keys`` (default: the keys of ``rows``) by ``rows``; False for a batch known already."""
        change = self.begin(writer, batch)
        if change is None:
            return False
        stored = [change.put(name, table) for name, table in rows.items()]
        change.commit([*[s.select(self.key) for s in stored], *([] if keys is None else [keys.select(self.key)])])
        return True

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of ``keys`` from every table."""
        self.replace({}, keys)

    def replace_by(self, column: str, rows: Mapping[str, DataFrame], named: str) -> None:
        """Replace everything stored under the values of ``column`` that come in anew.

        Table ``named`` holds ``column``; rows of all tables go whose key has, in it, one of the incoming
        values.  Incoming keys are replaced as well.
        """
        incoming = rows[named].filter(F.col(column).isNotNull()).select(column).distinct()
        if named in self.manifest()["base"]:
            self.replace(rows, self.table(named).join(incoming, column, "left_semi").select(self.key))
        else:
            self.replace(rows)

    def compact(self, after: int = 1) -> bool:
        """Fold the open changes into the base if there are at least ``after``.

        Only buckets with a changed key are read and written again.  If just one change is open, all its
        rows count, so what it holds for buckets without a base (all of a first load) becomes their base
        as it is.  The rebalance hint lets the optimizer cut a bucket with a very large key into several
        files.
        """
        state = self.manifest()
        if not state["changes"] or len(state["changes"]) < after:
            return False
        touched = {b for c in state["changes"] for b in [*self._buckets_of(c["keys"]), *[x for t in c["tables"].values() for x in self._buckets_of(t)]]}
        folder = f"data/{uuid.uuid4().hex}"
        base = {}
        for name, old in state["base"].items():
            kept = {b: f for b, f in old.items() if b not in touched}
            if len(state["changes"]) == 1 and (only := state["changes"][0]["tables"].get(name)):
                kept |= {b: f"{only}/{BUCKET}={b}" for b in self._buckets_of(only) if b not in old}
            again = touched - set(kept)
            if again:
                merged = self._merged(state, name, [f for b, f in sorted(old.items()) if b in again], again)
                self._write(merged, f"{folder}/{name}", state["buckets"])
                kept |= {b: f"{folder}/{name}/{BUCKET}={b}" for b in self._buckets_of(f"{folder}/{name}")}
            base[name] = kept
        self._publish({**state, "version": state["version"] + 1, "base": base, "changes": []})
        return True

    def expire(self, keep: int = 2) -> list[str]:
        """Delete manifests before the last ``keep`` and data folders that none of those names.

        For the writer, between its changes: data of a change that is not committed yet would go as well.
        """
        numbers = sorted(int(n) for n in self._names("manifests") if n.isdigit())
        for number in numbers[:-keep]:
            files, path = self._files(f"manifests/{number:012d}")
            files.delete(path, False)
        text = ""
        for number in numbers[-keep:]:
            files, path = self._files(f"manifests/{number:012d}")
            stream = files.open(path)
            text += self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
        gone = [name for name in self._names("data") if f"data/{name}/" not in text]
        for name in gone:
            files, path = self._files(f"data/{name}")
            files.delete(path, True)
        return gone

    # --- folders -------------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> None:
        placed = rows.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int"))
        placed.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{folder}")

    def _publish(self, state: dict) -> None:
        """Make ``state`` the newest one: written aside, then renamed to its number."""
        files, target = self._files(f"manifests/{state['version']:012d}")
        _, aside = self._files(f"manifests/.{uuid.uuid4().hex}")
        files.mkdirs(target.getParent())
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if files.exists(target) or not files.rename(aside, target):
            raise RuntimeError(f"another writer has made version {state['version']} of {self.path}")

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        files, path = self._files(folder)
        return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []

    def _buckets_of(self, folder: str) -> list[str]:
        return [n.split("=", 1)[1] for n in self._names(folder) if n.startswith(f"{BUCKET}=")]


class Change:
    """One change on its way: tables are put, then committed together."""

    def __init__(self, snapshot: Snapshot, state: dict, writer: str | None, batch: int | None) -> None:
        self.snapshot, self.state, self.writer, self.batch = snapshot, state, writer, batch
        self.version = state["version"] + 1
        self.folder = f"data/{uuid.uuid4().hex}"
        self.schemas: dict[str, StructType] = {}

    def stage(self, rows: DataFrame) -> DataFrame:
        """Write rows that several tables of the change are made of, and read them back; they are no table."""
        path = f"{self.snapshot.path}/{self.folder}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.snapshot.spark.read.schema(rows.schema).parquet(path)

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        """Write the change's rows of one table and read them back; nobody else sees them before the commit."""
        known = self.state["schemas"].get(name)
        if known is not None:
            schema = StructType.fromJson(known)
            if set(schema.names) != set(rows.columns):
                raise ValueError(f"columns of {name} are {schema.names}, not {rows.columns}")
            rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            schema = StructType.fromJson(json.loads(rows.schema.json()))
        self.schemas[name] = schema
        self.snapshot._write(rows.withColumn(VERSION, F.lit(self.version).cast("long")), f"{self.folder}/{name}", self.state["buckets"])
        return self.snapshot._rows(schema, [f"{self.folder}/{name}"])

    def commit(self, keys: Sequence[DataFrame]) -> None:
        """Publish the change; every row stored so far under one of ``keys`` gives way."""
        state, snapshot = self.state, self.snapshot
        change = {"tables": {name: f"{self.folder}/{name}" for name in self.schemas}, "keys": f"{self.folder}/changed-keys"}
        every = keys[0]
        for more in keys[1:]:
            every = every.unionByName(more)
        distinct = every.filter(F.col(snapshot.key).isNotNull()).distinct().withColumn(VERSION, F.lit(self.version).cast("long"))
        snapshot._write(distinct, change["keys"], state["buckets"])
        applied = dict(state["applied"])
        if self.writer is not None and self.batch is not None:
            applied[self.writer] = self.batch
        snapshot._publish(
            {
                **state,
                "version": self.version,
                "schemas": state["schemas"] | {name: json.loads(s.json()) for name, s in self.schemas.items()},
                "base": {name: {} for name in self.schemas} | state["base"],
                "changes": [*state["changes"], change],
                "applied": applied,
            }
        )
