"""Cascade deletion of documents (M7, M8): rows of dependent tables, files, and last the registry; repeatable at any point.

The order makes it repeatable. First a manifest names the documents and their files, as a written table. Then dependent tables
lose their rows, each in one version; then files go, deepest folders first; the registry loses its rows last. A job that failed
anywhere is run again: the registry still has the documents, tables without their rows stay as they are, and files that are gone
count as missing.

Files lie under guarded roots: a path that isn't below one of them, by its parts, is refused and nothing of it is touched.
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.io import allowed
from lodestone.sources.stored import kept
from lodestone.sources.versions import VersionedTable


def remove_local(path: str) -> bool:
    """Removes a file or an empty folder; False where there is none."""
    path = re.sub("^file:(//)?", "", path)
    try:
        os.rmdir(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
    except FileNotFoundError:
        return False
    return True


def remove_files(files: DataFrame, roots: list[str], remove: Callable[[str], bool] = remove_local) -> DataFrame:
    """(path, result): deleted, missing, refused or failed. ``files`` (path); a folder goes where what it holds is gone.

    Files of one depth go in one job, the deepest first; paths are told apart by their normal form. Null paths are left out."""
    normal = F.udf(lambda p: p and posixpath.normpath(p), "string")
    rows = files.where("path IS NOT NULL").select(normal(F.col("path")).alias("path")).distinct().withColumn("depth", F.size(F.split("path", "/")))
    rows = kept(rows, "deletion-files")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            results = []
            for path in f.path:
                try:
                    results.append("refused" if not allowed(path, roots) or path in map(posixpath.normpath, roots) else "deleted" if remove(path) else "missing")
                except OSError:
                    results.append("failed")
            yield pd.DataFrame({"path": f.path, "result": results})

    out = None
    for depth in sorted((r[0] for r in rows.select("depth").distinct().collect()), reverse=True):  # as many as paths have depths
        step = kept(rows.where(F.col("depth") == depth).select("path").mapInPandas(run, "path string, result string"), "deletion-step")
        out = step if out is None else out.unionByName(step)
    return out if out is not None else rows.select("path", F.lit("").alias("result"))


def delete_documents(keys: DataFrame, dependents: list[VersionedTable], registry: VersionedTable, files: DataFrame, roots: list[str], remove: Callable[[str], bool] = remove_local) -> DataFrame:
    """Deletes the documents of ``keys`` (content_hash) and returns what became of their ``files`` (content_hash, path).

    The registry keeps a document while one of its files failed, so that the next run takes it up again."""
    keys = kept(keys.where("content_hash IS NOT NULL").select("content_hash").distinct(), "deletion-keys")
    owned = kept(files.join(keys, "content_hash", "left_semi").select("content_hash", "path"), "deletion-manifest")
    for table in dependents:
        if not table.of(keys).isEmpty():
            table.delete(keys)
    results = remove_files(owned.select("path"), roots, remove)
    normal = F.udf(lambda p: p and posixpath.normpath(p), "string")
    stuck = owned.withColumn("path", normal("path")).join(results.where("result = 'failed'"), "path").select("content_hash").distinct()
    done = kept(keys.join(stuck, "content_hash", "left_anti"), "deletion-done")
    if not registry.of(done).isEmpty():
        registry.delete(done)
    return results
