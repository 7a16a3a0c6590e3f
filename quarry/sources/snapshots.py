"""Tables that are published together: a version names the folders of all its tables.

A write makes new folders and never touches old ones; then one small file, the pointer of
the next version, is put in place by a rename that fails if that version exists. Readers
take the last pointer, so they see all tables of a version or none, a job that dies
between two tables leaves the old version as it was, and of two writers that started
from one version the second gets `Conflict`. Pointers hold schemas, so that an empty
table can be read, and notes, which pass from version to version.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, types as T


class Conflict(RuntimeError):
    """Another writer published first."""


class Snapshots:
    """Versions of a set of tables below one folder; any file system that Spark can use."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("versions").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        fs, at = self._files(), self._path("versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def pointer(self, version: int | None = None) -> dict:
        """What a version (the last by default) holds: tables with schema and folders, and notes."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "tables": {}, "notes": {}}
        stream = self._files().open(self._path(f"versions/{version:012}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self.pointer(version)["tables"])

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version; KeyError if the version has none of that name."""
        return self.frame(self.pointer(version)["tables"][name])

    def frame(self, table: dict) -> DataFrame:
        """The table of an entry of a pointer."""
        schema = T.StructType.fromJson(table["schema"])
        if not table["folders"]:
            return self.spark.createDataFrame([], schema)
        base = table["folders"][0].rpartition("/")[0]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/{base}").parquet(*(f"{self.root}/{f}" for f in table["folders"]))
        return rows.select(*schema.names)  # without the column that tells folders apart

    def publish(self, tables: dict[str, DataFrame], append: tuple[str, ...] = (), dropped: tuple[str, ...] = (), partition_by: dict[str, str] | None = None, notes: dict | None = None, base: dict | None = None, behind: dict[str, list[str]] | None = None, options: dict[str, str] | None = None) -> int:
        """Write tables and make them the next version, together with all that is not named; returns its number.

        Tables replace those of their name, those in ``append`` are added to them, and the
        folders in ``behind`` stay behind a replacing table. ``base`` is the pointer that the
        tables were derived from, by default the last one. ``options`` are those of the Parquet writer.
        """
        base = base or self.pointer()
        new = {k: v for k, v in base["tables"].items() if k not in dropped}
        for name, df in tables.items():
            folder = f"data/{name}/write={uuid.uuid4().hex}"
            by = (partition_by or {}).get(name)
            writer = df.write.options(**(options or {}))
            (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{folder}")
            schema = json.loads(T.StructType(sorted((T.StructField(f.name, f.dataType) for f in df.schema), key=lambda f: f.name == by)).json())
            held = new[name]["folders"] if name in append and name in new else []
            new[name] = {"schema": schema, "folders": [*held, folder, *(behind or {}).get(name, [])]}
        version = base["version"] + 1
        self._put(version, {"version": version, "tables": new, "notes": base["notes"] | (notes or {})})
        return version

    def _put(self, version: int, pointer: dict) -> None:
        jvm, fs = self.spark.sparkContext._jvm, self._files()
        fs.mkdirs(self._path("versions"))
        draft, final = self._path(f"versions/.{uuid.uuid4().hex}"), self._path(f"versions/{version:012}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, final, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(final):
                raise Conflict(f"version {version} is there already") from None
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Delete pointers but the last ``keep`` and all folders that none of these names; returns the number of folders deleted.

        Only while nobody writes: the folders of a version that is being written have no pointer yet.
        """
        kept = self.versions()[-keep:]
        named = {f for v in kept for t in self.pointer(v)["tables"].values() for f in t["folders"]}
        fs, gone = self._files(), 0
        for v in self.versions()[: -len(kept)] if kept else []:
            fs.delete(self._path(f"versions/{v:012}.json"), False)
        if fs.exists(self._path("data")):
            for table in fs.listStatus(self._path("data")):
                for folder in fs.listStatus(table.getPath()):
                    if f"data/{table.getPath().getName()}/{folder.getPath().getName()}" not in named:
                        fs.delete(folder.getPath(), True)
                        gone += 1
        return gone
