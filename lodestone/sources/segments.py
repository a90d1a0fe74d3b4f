"""Tables in immutable segments: a change is written as a segment of its own, and older ones are left alone.

A segment holds rows that came and, for each table with a key, the keys that went: these hide rows of older segments, never of its
own. A reader puts the segments together and leaves out what is hidden. Tables of sums have a key too, but what goes is a negative
row, and readers add up. Plain numbers of a segment add up in the manifest. When segments are many, the youngest ones that are
small beside those before them are merged, so a row is written again about as often as the index doubles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .store import BROADCAST_BYTES, KEY_BYTES, Store

#: More segments than this are merged; a segment of more than RATIO times the rows of all younger ones is left alone.
MOST, RATIO = 8, 2
#: Tables of a segment that are written at a time.
SIDE_BY_SIDE = 8
SEG, DEAD = "_seg", "_dead"
Layout = Callable[[DataFrame], DataFrame]


class Segments:
    """keys: tables and the columns by which their rows go; sums: tables and their (key, number). layout: how a table's rows lie in a segment."""

    def __init__(self, store: Store, keys: dict[str, str] | None = None, sums: dict[str, tuple[str, str]] | None = None, layout: dict[str, Layout] | None = None):
        self.store, self.spark = store, store.spark
        m = store.manifest
        self.keys, self.sums = keys or m.get("keys", {}), sums or {k: tuple(v) for k, v in m.get("sums", {}).items()}
        self.layout = layout or {}

    @property
    def all(self) -> list[dict]:
        return self.store.manifest.get("segments", [])

    def number(self, name: str) -> int:
        return sum(s["numbers"].get(name, 0) for s in self.all)

    def rows(self, name: str) -> int:
        """The rows of a table, with those that are hidden."""
        return sum(s["rows"].get(name, 0) for s in self.all)

    def _path(self, name: str, segment: dict) -> str:
        return f"{self.store.root}/{name}/v{segment['version']}"

    def _open(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows of a table in some segments, hidden ones too, with their segment's number."""
        schema = StructType.fromJson(self.store.manifest["schemas"][name]).add(SEG, "integer")
        paths = [self._path(name, s) for s in segments if s["rows"].get(name)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, name: str, segments: list[dict]) -> DataFrame:
        """key, the youngest segment that hides it."""
        key = self.keys[name]
        kind = StructType.fromJson(self.store.manifest["schemas"][name])[key].dataType
        paths = [self._path(f"{name}-gone", s) for s in segments if s["gone"].get(name)]
        return self.spark.read.schema(StructType().add(key, kind).add(SEG, "integer")).parquet(*paths).groupBy(key).agg(F.max(SEG).alias(DEAD))

    def _live(self, name: str, segments: list[dict]) -> DataFrame:
        """The rows of some segments that are not hidden, with their segment's number."""
        hides = [s for s in self.all if s["gone"].get(name)]
        youngest = max((s["seg"] for s in hides), default=0)
        old, young = [s for s in segments if s["seg"] < youngest], [s for s in segments if s["seg"] >= youngest]
        out = self._open(name, young)
        if any(s["rows"].get(name) for s in old):
            gone = self._gone(name, hides)
            if sum(s["gone"][name] for s in hides) * KEY_BYTES <= BROADCAST_BYTES:
                gone = F.broadcast(gone)
            kept = self._open(name, old).join(gone, self.keys[name], "left").filter(f"{DEAD} IS NULL OR {SEG} >= {DEAD}").select(*out.columns)
            out = kept.unionByName(out) if young else kept
        return out

    def read(self, name: str) -> DataFrame:
        """The table as it is now. A filter on any column reaches the scans of all segments."""
        if name in self.sums:
            key, number = self.sums[name]
            return self._open(name, self.all).groupBy(key).agg(F.sum(number).alias(number)).filter(F.col(number) != 0)
        return self._live(name, self.all).drop(SEG)

    def append(self, new: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None, numbers: dict[str, int] | None = None, whole: bool = False) -> None:
        """A segment with these rows, which hides these keys in older ones; it appears at once. whole: nothing older counts any more."""
        older = [] if whole else self.all
        seg = max((s["seg"] for s in older), default=0) + 1
        new = self._laid(new)
        schemas = {n: df.schema.jsonValue() for n, df in new.items()}
        if not whole:
            schemas = self.store.manifest.get("schemas", {}) | {n: x for n, x in schemas.items() if n not in self.store.manifest.get("schemas", {})}
        made = self._write(seg, new, {} if whole else gone or {})
        made["numbers"] = {k: int(v) for k, v in (numbers or {}).items()}
        self._commit([*older, made], [made], schemas)

    def _laid(self, new: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The tables as they lie in a segment; a layout may take another form of the rows than it gives."""
        return {n: self.layout[n](df) if n in self.layout else df for n, df in new.items()}

    def _write(self, seg: int, new: dict[str, DataFrame], gone: dict[str, DataFrame]) -> dict:
        """The tables of one segment, written side by side; their rows are counted as they are written."""
        made = {"seg": seg, "version": f"{self.store.manifest['number'] + 1}-{uuid.uuid4().hex[:8]}", "rows": {}, "gone": {}, "numbers": {}}

        def put(of: str, name: str, df: DataFrame) -> None:
            seen = Observation()
            path = self._path(name if of == "rows" else f"{name}-gone", made)
            df.withColumn(SEG, F.lit(seg)).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
            made[of][name] = seen.get["n"]

        jobs = [("rows", n, df) for n, df in new.items()] + [("gone", n, df.select(self.keys[n]).distinct()) for n, df in gone.items()]
        try:
            with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
                list(pool.map(inheritable_thread_target(self.spark)(lambda job: put(*job)), jobs))
        except Exception:
            for of, name, _ in jobs:
                self.store.drop(f"{name if of == 'rows' else f'{name}-gone'}/v{made['version']}")
            raise
        return made

    def _commit(self, segments: list[dict], made: list[dict], schemas: dict) -> None:
        try:
            self.store.commit(self.store.manifest["number"] + 1, segments=segments, schemas=schemas, keys=self.keys, sums=self.sums)
        except Exception:
            for s in made:
                for folder in (*s["rows"], *(f"{g}-gone" for g in s["gone"])):
                    self.store.drop(f"{folder}/v{s['version']}")
            raise

    @staticmethod
    def _size(s: dict) -> int:
        return sum(s["rows"].values()) + sum(s["gone"].values())

    def compact(self, most: int = MOST) -> None:
        """Merge the youngest segments if there are more than `most`: all that are not much larger than what is younger, and as many as
        leave half of `most`, so that a merge does not follow every change."""
        found = self.all
        if len(found) <= most:
            return
        at, held = len(found) - 1, self._size(found[-1])
        while at > 0 and (self._size(found[at - 1]) <= RATIO * held or at > most // 2):
            at -= 1
            held += self._size(found[at])
        old, merged = found[:at], found[at:]
        new = {}
        for name in self.store.manifest["schemas"]:
            if name in self.sums:
                key, number = self.sums[name]
                rows = self._open(name, merged).groupBy(key).agg(F.sum(number).alias(number))
                new[name] = rows if old else rows.filter(F.col(number) != 0)
            else:
                new[name] = self._live(name, merged).drop(SEG)
        gone = {n: self._gone(n, hides).drop(DEAD) for n in self.keys if old and (hides := [s for s in merged if s["gone"].get(n)])}
        made = self._write(merged[-1]["seg"], self._laid(new), gone)
        made["numbers"] = {k: sum(s["numbers"].get(k, 0) for s in merged) for k in {k for s in merged for k in s["numbers"]}}
        self._commit([*old, made], [made], self.store.manifest["schemas"])
