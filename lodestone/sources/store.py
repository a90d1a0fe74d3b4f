"""A store of versioned Parquet tables, a manifest, and the configuration."""

from __future__ import annotations

import atexit
import json
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA, CHUNKING = "3", "1"
#: A table of so many bytes at most, by its rows, is broadcast.
BROADCAST_BYTES, KEY_BYTES = 48 << 20, 200


class Conflict(RuntimeError):
    """Another writer has made the next manifest; nothing of one's own appears. After refresh() the change can be made again."""


@dataclass
class Config:
    """Search and index settings; unknown keys of a file are ignored, and an unreadable file gives the defaults."""

    model: str = "balanced"
    languages: tuple[str, ...] = ()
    rerank: bool = True
    max_results: int = 10
    graph: bool = True
    skip_generated: bool = True

    @classmethod
    def load(cls, text: str | None) -> "Config":
        try:
            found = json.loads(text or "{}")
        except ValueError:
            found = {}
        names = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if k == "languages" else v for k, v in found.items() if k in names})

    def save(self) -> str:
        return json.dumps(asdict(self))

    def put(self, key: str, value: str) -> "Config":
        """A copy with a setting from text; a wrong key or value raises ValueError."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if key not in kinds:
            raise ValueError(f"no setting {key}")
        if key == "model" and value not in ("light", "balanced", "max"):
            raise ValueError(f"no model {value}")
        if kinds[key] is bool and value not in ("true", "false"):
            raise ValueError(f"{key} is true or false")
        new = value == "true" if kinds[key] is bool else int(value) if kinds[key] is int else tuple(filter(None, value.split(","))) if kinds[key] is tuple else value
        return Config(**(asdict(self) | {key: new}))


_made: list[tuple["weakref.ref[SparkSession]", str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; in local mode, where that is unset, below a temporary
    one. It is deleted when the driver ends."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lodestone-shared-")
        sc.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


@atexit.register
def _drop_shared() -> None:
    for ref, path in _made:
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            pass
    _made.clear()


class Store:
    """Tables under root/<name>/v<n>. A manifest names the current version of each; every change is a new manifest with the next
    number, which appears by one renaming, and none is changed or deleted while it is current: readers see whole versions.
    The versions of the last KEPT manifests stay for readers that hold them.

    The manifest is written by the driver through Spark's file system, so root may be any path that Spark reads and writes."""

    KEPT = 3

    def __init__(self, spark: SparkSession, root: str, model: str = "balanced"):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest, self._known = self._read(), {}
        self._left: list[str] = []

    def _numbers(self) -> list[int]:
        """The numbers of the manifests that there are, in order."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def _load(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest-{number:08d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _read(self) -> dict:
        numbers = self._numbers()
        return self._load(numbers[-1]) if numbers else {"number": 0, "schema": SCHEMA, "model": self.model, "chunking": CHUNKING, "tables": {}}

    def _flip(self, manifest: dict) -> None:
        """Make manifest the current one. It is written under another name and then takes its number, which only one writer can."""
        name = f"{self.root}/manifest-{manifest['number']:08d}.json"
        new, path = self._path(f"{name}.{uuid.uuid4().hex}"), self._path(name)
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            taken = not self._take(new, path)
        finally:
            self._fs.delete(new, False)
        if taken:
            raise Conflict(f"{path.toString()} was written by another run")
        self.manifest = manifest
        self._clean()

    def _take(self, new, path) -> bool:
        """Give the file its name unless there is one of that name: a hard link on a local disk, which its rename would replace; elsewhere
        the rename without overwriting that file systems promise to do at once."""
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                at = lambda p: jvm.java.nio.file.Paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(at(path), at(new))
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, path, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _folders(self, manifest: dict) -> set[str]:
        """The folders below root that a manifest names."""
        own = {f"{name}/v{version}" for name, version in manifest["tables"].items()}
        return own | {f"{name}/v{s['version']}" for s in manifest.get("segments", []) for name in (*s["rows"], *(f"{g}-gone" for g in s["gone"]))}

    def _clean(self) -> None:
        numbers = self._numbers()
        kept = set().union(*[self._folders(self._load(n)) for n in numbers[-self.KEPT :]])
        for n in numbers[: -self.KEPT]:
            for folder in self._folders(self._load(n)) - kept:
                self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            self._fs.delete(self._path(f"{self.root}/manifest-{n:08d}.json"), False)

    def refresh(self) -> "Store":
        """See what other runs have written."""
        self.manifest = self._read()
        return self

    def needs_rebuild(self) -> bool:
        m = self.manifest
        return (m["schema"], m["model"], m["chunking"]) != (SCHEMA, self.model, CHUNKING)

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"] or name in self.manifest.get("schemas", {}) or name == "totals" and bool(self.manifest.get("segments"))

    def read(self, name: str) -> DataFrame:
        """A table as it is: the current version, or what is live in its segments."""
        if name in self.manifest.get("schemas", {}):
            from .segments import Segments

            return Segments(self).read(name)
        if name == "totals" and self.manifest.get("segments"):
            n, words = (sum(s["numbers"].get(k, 0) for s in self.manifest["segments"]) for k in ("n", "words"))
            return self.spark.createDataFrame([(n, words / n if n else 0.0)], "n long, avgdl double")
        path = f"{self.root}/{name}/v{self.manifest['tables'][name]}"
        if path not in self._known:  # a version's columns are found once
            self._known = {p: s for p, s in self._known.items() if not p.startswith(f"{self.root}/{name}/")} | {path: self.spark.read.parquet(path).schema}
        return self.spark.read.schema(self._known[path]).parquet(path)

    def count(self, name: str) -> int:
        return self.read(name).count()

    def write(self, **tables: DataFrame) -> None:
        """New versions of the tables, which appear together."""
        number = self.manifest["number"] + 1
        version = f"{number}-{uuid.uuid4().hex[:8]}"  # no other run writes there
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/v{version}")
        self.commit(number, tables=self.manifest["tables"] | dict.fromkeys(tables, version))

    def commit(self, number: int, **changes) -> None:
        """The manifest of that number: the one before with some entries changed."""
        self._flip(self.manifest | {"number": number, "schema": SCHEMA, "model": self.model, "chunking": CHUNKING} | changes)

    def forget(self, name: str) -> None:
        """A version of the store without the table."""
        self.commit(self.manifest["number"] + 1, tables={n: v for n, v in self.manifest["tables"].items() if n != name})

    @contextmanager
    def written(self, df: DataFrame) -> Iterator[DataFrame]:
        """df as a table of its own below root, which is deleted at the end."""
        path = f"{self.root}/passing-{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        except BaseException:
            self._left.append(path)
            raise
        finally:
            self._fs.delete(self._path(path), True)

    def clear_left(self, seconds: float) -> None:
        """Delete again, after a while, what failed work left: tasks of cancelled jobs may write on for a moment."""

        def clear() -> None:
            while self._left:
                self._fs.delete(self._path(self._left.pop()), True)

        timer = threading.Timer(seconds, clear)
        timer.daemon = True
        timer.start()

    def drop(self, folder: str) -> None:
        """Delete a folder below root that no manifest names."""
        self._left.append(f"{self.root}/{folder}")
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def delete(self, name: str, key: str, values: list) -> None:
        """A new version of the table without the rows whose key is among a few values."""
        self.write(**{name: self.read(name).filter(~F.col(key).isin(values) | F.col(key).isNull())})

    def compact(self, name: str, files: int) -> None:
        self.write(**{name: self.read(name).repartition(files)})
