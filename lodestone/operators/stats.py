"""Counts and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def status(chunks: DataFrame) -> DataFrame:
    """n_chunks, n_files, n_languages."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file").alias("n_files"), F.count_distinct("language").alias("n_languages"))


def by_file(chunks: DataFrame) -> DataFrame:
    """file, n, language, first_id: language and id of the file's first chunk; also its imports and exports, if chunks have them."""
    more = [F.min_by(c, "id").alias(c) for c in ("imports", "exports") if c in chunks.columns]
    return chunks.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min_by("language", "id").alias("language"), F.min("id").alias("first_id"), *more)


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def models(spark: SparkSession) -> DataFrame:
    from .vector import TIERS

    return spark.createDataFrame(list(TIERS), "tier string, dimension int, size_mb int")


Check = tuple[str, str, str]  # name, status, message


def checks(spark: SparkSession, root: str, store, config_text: str | None = None) -> list[Check]:
    """Whether a workspace can be read, and whether each table of its index can and is as large as the others say."""
    from ..sources.store import Config

    def tried(name: str, look: Callable[[], str], worst: str = "error") -> Check:
        try:
            return name, "ok", look()
        except Exception as e:  # noqa: BLE001  a fault is what a check reports
            return name, worst, f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"

    def workspace() -> str:
        return f"{spark.read.format('binaryFile').option('recursiveFileLookup', True).load(root).limit(1).count()} file or more"

    def settings() -> str:
        return f"model {Config(**json.loads(config_text or '{}')).model}"

    def version() -> str:
        if store.needs_rebuild():
            raise ValueError("settings differ from those of the index; it will be made anew")
        return f"manifest {store.manifest['number']}"

    def vectors() -> str:
        a, b = store.count("vectors"), store.count("chunks")
        if a != b:
            raise ValueError(f"{a} vectors of {b} chunks")
        return f"{a} vectors"

    out = [
        tried("workspace", workspace),
        ("index folder", *(("ok", store.root) if store.manifest["number"] else ("warn", "not indexed yet"))),
        tried("configuration", settings),
        tried("version", version, "warn"),
    ]
    if store.manifest["number"]:
        out += [
            tried("chunks", lambda: "{} chunks of {} files in {} languages".format(*status(store.read("chunks")).first())),
            tried("files", lambda: f"{store.count('file_state')} files"),
            tried("keyword index", lambda: f"{store.count('terms')} terms, {store.read('totals').first().n} rows"),
            tried("vectors", vectors),
            tried("graph", lambda: "{} nodes, {} edge ends".format(store.count("graph_nodes"), store.count("graph_edges"))),
            tried("orphans", lambda: f"{store.read('postings').join(store.read('chunks'), 'id', 'left_anti').count()} postings without a chunk"),
        ]
    out.append(("embedding model", "warn", f"{store.model}: no model file, hashed stems stand in"))
    return out


def doctor(spark: SparkSession, found: list[Check]) -> DataFrame:
    """name, status, message."""
    return spark.createDataFrame(found, "name string, status string, message string")


def summary(report: DataFrame) -> DataFrame:
    """status, n."""
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
