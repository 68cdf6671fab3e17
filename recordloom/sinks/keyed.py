"""A stored table with a key: a write replaces only the files that hold its keys, and shows by one rename.

The table is a folder of Parquet files and a folder of versions.  A version is a small text that names the live files, one entry a
file, and what the flows that feed the table have committed; a reader takes the newest.  A write puts new files beside the live ones and
then renames a new version into place.  A write that dies before that has changed nothing, and one that comes second finds its version
taken.  Rows never pass through the driver; file names do, as they do for any scan.
"""

from __future__ import annotations

import json
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordloom.operators.conflicts import POLICIES, KeyConflict, check_columns, conflicting_keys, merge_frames, rows_to_append
from recordloom.session import scratch

#: Compaction joins files below a quarter of this size to files of about it.
FILE_BYTES = 128 << 20


class ConcurrentWrite(RuntimeError):
    """Another write has taken the version that this one was to become."""


class Store:
    """The few file operations, by Hadoop's file systems: any path Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self._conf)

    def names(self, folder: str) -> dict[str, int]:
        """Files of a folder with their sizes; hidden ones and folders are left out."""
        path = self._path(folder)
        if not self._fs(path).exists(path):
            return {}
        found = self._fs(path).listStatus(path)
        return {s.getPath().getName(): s.getLen() for s in found if s.isFile() and s.getPath().getName()[0] not in "._"}

    def text(self, name: str) -> str | None:
        path = self._path(name)
        if not self._fs(path).exists(path):
            return None
        stream = self._fs(path).open(path)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Make a file with this text appear whole, unless there is one of that name."""
        draft, path = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"), self._path(name)
        stream = self._fs(draft).create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        fs = self._jvm.org.apache.hadoop.fs
        try:
            # Without the overwrite option a rename onto an existing file fails.
            options = SparkContext._gateway.new_array(fs.Options.Rename, 0)
            fs.FileContext.getFileContext(path.toUri(), self._conf).rename(draft, path, options)
            return True
        except Exception as e:
            self._fs(draft).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def remove(self, name: str) -> None:
        path = self._path(name)
        self._fs(path).delete(path, True)


class KeyedTable:
    """The table below ``path``; see the module."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.store = Store(spark, self.path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> KeyedTable:
        """The table at ``path``, made empty if there is none."""
        table = cls(spark, path, keys)
        if not table.store.names("_versions"):
            table._publish({"version": 0, "schema": schema.jsonValue(), "files": {}, "streams": {}, "sources": []})
        return table

    def state(self) -> dict:
        """The newest version: number, schema, ``files`` (name to folder and bytes), and what flows have committed."""
        versions = [int(n.partition(".")[0]) for n in self.store.names("_versions")]
        if not versions:
            raise FileNotFoundError(f"no keyed table at {self.path}")
        return json.loads(self.store.text(f"_versions/{max(versions):012d}.json"))

    def _publish(self, state: dict) -> None:
        if not self.store.publish(f"_versions/{state['version']:012d}.json", json.dumps(state)):
            raise ConcurrentWrite(f"version {state['version']} of {self.path} is taken")

    def _frame(self, state: dict, names: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        files = state["files"]
        chosen = [f"{self.path}/{files[n][0]}/{n}" for n in (files if names is None else names)]
        return self.spark.read.schema(schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The rows of the newest version; later writes do not change this frame."""
        return self._frame(self.state())

    def _touched(self, state: dict, incoming: DataFrame) -> list[str]:
        """Names of the live files that hold a key of ``incoming``: key columns only, within the range of the first key."""
        if not state["files"]:
            return []
        first = F.col(f"`{self.keys[0]}`")
        low, high = incoming.agg(F.min(first), F.max(first)).head()
        if low is None:
            return []
        keys = [F.col(f"`{k}`") for k in self.keys]
        stored = self._frame(state).select(*keys, F.col("_metadata.file_name").alias("_file")).filter(first.between(F.lit(low), F.lit(high)))
        hits = stored.join(incoming.select(*keys), self.keys, "left_semi")
        return [r["_file"] for r in hits.select("_file").distinct().collect()]

    def _put(self, rows: DataFrame) -> dict[str, list]:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return {name: [folder, size] for name, size in self.store.names(folder).items()}

    def write(self, incoming: DataFrame, policy: str, seq: str, presence: str | None = None, commit: dict | None = None,
              stored: bool = False) -> dict:
        """Apply ``incoming`` under a conflict policy; ``{version, rewritten, kept, added}`` in files.

        ``seq``, ``presence`` and the policies are those of ``merge_frames``.  The incoming rows are computed once; ``stored`` says that
        they are a plain scan of files that stay as they are, and are read from there instead of being written again.  Files without one of
        their keys stay as they are: ``update`` and ``overwrite`` rewrite the others, ``skip`` and ``error`` only add.  ``commit``
        (stream, batch, sources) is recorded in the same version, so data and cursor appear together.
        """
        if policy not in POLICIES:
            raise ValueError(f"unknown policy: {policy}")
        state = self.state()
        check_columns(self._frame(state, []), incoming, seq, presence)
        staged = incoming
        if not stored:
            path = scratch(self.spark, "incoming")
            incoming.write.parquet(path)
            staged = self.spark.read.schema(incoming.schema).parquet(path)
        touched = self._touched(state, staged)
        target = self._frame(state, touched)
        plain = staged.drop(*[c for c in (seq, presence) if c and c not in target.columns])
        gone: list[str] = []
        if policy == "error":
            clash = conflicting_keys(target, plain, self.keys).head()
            if clash is not None:
                raise KeyConflict(f"duplicate key: {', '.join(f'{k}={clash[k]}' for k in self.keys)}")
            rows = self._frame(state, []).unionByName(plain, allowMissingColumns=True)
        elif policy == "skip":
            fresh = rows_to_append(target, staged.drop(*[c for c in (presence,) if c and c not in target.columns]), self.keys, seq)
            rows = self._frame(state, []).unionByName(fresh, allowMissingColumns=True)
        else:
            rows, gone = merge_frames(target, staged, self.keys, policy, seq, presence), touched
        added = self._put(rows)
        return self._swap(state, gone, added, commit)

    def _swap(self, state: dict, gone: list[str], added: dict[str, list], commit: dict | None = None) -> dict:
        kept = {n: f for n, f in state["files"].items() if n not in set(gone)}
        new = {**state, "version": state["version"] + 1, "files": {**kept, **added}}
        if commit:
            new["streams"] = {**state["streams"], commit["stream"]: commit["batch"]}
            new["sources"] = [*state["sources"], commit["sources"]]
            sums = state.get("progress", {})
            new["progress"] = {**sums, **{k: sums.get(k, 0) + v for k, v in commit.get("progress", {}).items()}}
        self._publish(new)
        return {"version": new["version"], "rewritten": len(gone), "kept": len(kept), "added": len(added)}

    def committed(self, stream: str) -> int:
        """The last batch of a stream whose rows are in the table, -1 for none."""
        return self.state()["streams"].get(stream, -1)

    def progress(self) -> dict:
        """Sums over all committed batches of what their commits counted."""
        return self.state().get("progress", {})

    def put_sources(self, files: DataFrame) -> str:
        """Write the names of source files, for a commit to refer to."""
        folder = f"_sources/{uuid.uuid4().hex}"
        files.select("file").write.parquet(f"{self.path}/{folder}")
        return folder

    def sources(self) -> DataFrame:
        """``(file)``: the source files whose rows are in the table, by whatever stream."""
        folders = [f"{self.path}/{s}" for s in self.state()["sources"]]
        return self.spark.read.schema("file string").parquet(*folders) if folders else self.spark.createDataFrame([], "file string")

    def compact(self, file_bytes: int = FILE_BYTES) -> dict:
        """Join small files to files of about ``file_bytes``; the rows stay the same."""
        state = self.state()
        small = [n for n, (_, size) in state["files"].items() if 4 * size < file_bytes]
        if len(small) < 2:
            return {"version": state["version"], "rewritten": 0, "kept": len(state["files"]), "added": 0}
        parts = -(-sum(state["files"][n][1] for n in small) // file_bytes)
        return self._swap(state, small, self._put(self._frame(state, small).coalesce(max(1, parts))))

    def vacuum(self, keep: int = 2) -> int:
        """Delete files that none of the last ``keep`` versions names, and older versions; only while nothing is written."""
        versions = sorted(self.store.names("_versions"))
        live = set()
        for name in versions[-keep:]:
            state = json.loads(self.store.text(f"_versions/{name}"))
            live |= {f"{folder}/{n}" for n, (folder, _) in state["files"].items()}
        gone = 0
        root = self.store._path("data")
        fs = self.store._fs(root)
        for folder in fs.listStatus(root) if fs.exists(root) else []:
            name = folder.getPath().getName()
            files = [f"data/{name}/{f}" for f in self.store.names(f"data/{name}")]
            dead = [f for f in files if f not in live]
            gone += len(dead)
            for f in dead if len(dead) < len(files) else [f"data/{name}"]:
                self.store.remove(f)
        for name in versions[:-keep]:
            self.store.remove(f"_versions/{name}")
        return gone
