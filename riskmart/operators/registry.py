"""Model registry (S-OUT-3/4): sealed versions, one of them active, damaged ones refused.

A version is a folder of model files below the models folder. *Sealing* writes a manifest of its files (path, length,
sha256, found by Spark's own binary reader, so any store will do) beside the versions; *verifying* compares. The active
version is the last entry of a log that grows by one folder per activation, each written at once: a reader sees the
entry before or the new one, never half of one.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class DamagedModel(RuntimeError):
    """Files of a version are missing, new or changed since it was sealed."""


def read_text(spark: SparkSession, path: str) -> str | None:
    """Contents of a one-row text folder; None where there is none."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row[0] if row else None


def write_text(spark: SparkSession, text: str, path: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def files_of(spark: SparkSession, base: str) -> dict[str, list]:
    """{path below ``base``: [length, sha256]} of the files of a version (Spark's own marker files don't count)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
             .select("path", "length", F.sha2("content", 256).alias("sha256")).collect())        # one short row per file
    mark = f"/{base.rstrip('/').rsplit('/', 1)[-1]}/"
    return {r.path.rsplit(mark, 1)[-1]: [r.length, r.sha256] for r in files}


def seal(spark: SparkSession, out_dir: str, version: str) -> None:
    text = json.dumps(files_of(spark, f"{out_dir.rstrip('/')}/{version}"), sort_keys=True)
    write_text(spark, text, f"{out_dir.rstrip('/')}/manifests/{version}")


def verify(spark: SparkSession, out_dir: str, version: str) -> None:
    """Raise :class:`DamagedModel` unless the version's files are those that were sealed. A version without a manifest (written
    by an older release) passes."""
    text = read_text(spark, f"{out_dir.rstrip('/')}/manifests/{version}")
    if text is None:
        return
    want, have = json.loads(text), files_of(spark, f"{out_dir.rstrip('/')}/{version}")
    wrong = [f"{k}: {'missing' if k not in have else 'not in the manifest' if k not in want else 'changed'}"
             for k in sorted({*want, *have}) if want.get(k) != have.get(k)]
    if wrong:
        raise DamagedModel(f"model {version} in {out_dir}: " + "; ".join(wrong[:10]))


def _log(spark: SparkSession, out_dir: str) -> list[str]:
    names, n = [], 0
    while (text := read_text(spark, f"{out_dir.rstrip('/')}/active/{n}")) is not None:
        names.append(text.strip())
        n += 1
    return names


def activate(spark: SparkSession, out_dir: str, version: str) -> None:
    """Make a version the active one. It must be there and unharmed."""
    if read_text(spark, f"{out_dir.rstrip('/')}/{version}/metadata") is None:
        raise FileNotFoundError(f"no model {version} in {out_dir}")
    verify(spark, out_dir, version)
    write_text(spark, version, f"{out_dir.rstrip('/')}/active/{len(_log(spark, out_dir))}", mode="error")


def active_version(spark: SparkSession, out_dir: str) -> str | None:
    return (_log(spark, out_dir) or [None])[-1]
