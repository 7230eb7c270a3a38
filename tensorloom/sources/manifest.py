"""Saved runs that are whole or not there: versions of a manifest that counts every table's files, their lengths and their digests.

A run's tables are written first, into a folder of their own. Its manifest is then put under the next free number by a
rename that never overwrites: of two writers at once one gets the number and the other takes the next. A reader goes
through the versions from the newest, and passes over runs that lack a file or hold one of another length or content, so
what it returns is one whole run.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "manifest"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests, newest first: one for each saved run."""
    fs, at = _fs(spark, f"{root}/{FOLDER}")
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted((int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit()), reverse=True)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, digest) of the data files under path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("digest"))


def _summary(files: DataFrame) -> tuple[int, int, str]:
    """Files, bytes and a digest of digests() that merges in any order, so that no task holds all files' names."""
    n, length, a, b = files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("file", "length", "digest")), F.bit_xor(F.xxhash64("digest", "file"))).first()
    return n, length or 0, f"{a or 0}:{b or 0}"


def summary(spark: SparkSession, path: str) -> tuple[int, int, str]:
    """How many data files lie under path, their bytes, and their digest; none where there is no such folder."""
    fs, at = _fs(spark, path)
    return _summary(digests(spark, path)) if fs.exists(at) else (0, 0, "0:0")


def unchanged(spark: SparkSession, path: str, want: tuple[int, int, str], check: bool = True) -> bool:
    """Whether summary() is what it was; without check, only how many files there are and their bytes."""
    fs, at = _fs(spark, path)
    sizes = [f.getLen() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")] if fs.exists(at) else []
    if (len(sizes), sum(sizes)) != tuple(want[:2]):
        return False
    if not check or not sizes:
        return True
    try:
        return _summary(digests(spark, path))[2] == want[2]
    except Py4JJavaError as e:
        if _refused(e):
            return False
        raise


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], **about) -> int:
    """Write the tables of a run and then its manifest, and return the manifest's number. Until that is there the run is not visible.

    about is kept with the manifest and can be asked for when loading: numbers, texts and truth values.
    """
    run = uuid.uuid4().hex
    parts = {}
    for name, df in tables.items():
        path = f"{root}/data/{run}/{name}"
        df.write.parquet(path)
        n, length, digest = summary(spark, path)
        parts[name] = {"files": n, "length": length, "digest": digest, "schema": json.loads(df.schema.json())}
    body = json.dumps({"run": run, "tables": parts, "about": about}, sort_keys=True)
    return _publish(spark, root, json.dumps({"body": body, "digest": hashlib.sha256(body.encode()).hexdigest()}))


def _publish(spark: SparkSession, root: str, text: str) -> int:
    """Put a manifest under the next free number, without ever replacing one."""
    fs, folder = _fs(spark, f"{root}/{FOLDER}")
    fs.mkdirs(folder)
    _, draft = _fs(spark, f"{root}/{FOLDER}/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    n = max(_versions(spark, root), default=0) + 1
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    while True:
        _, place = _fs(spark, f"{root}/{FOLDER}/{n:08d}.json")
        try:
            context.rename(draft, place, options)
            return n
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            n += 1


def _refused(e: Py4JJavaError) -> bool:
    """Whether a store would not read a file: it is gone, or the store's own checksums don't fit. A lost executor is no such case."""
    return any(k in str(e) for k in ("ChecksumException", "FileNotFoundException", "FILE_NOT_EXIST"))


def _manifest(spark: SparkSession, root: str, n: int) -> dict | None:
    """A manifest, or None if it is broken."""
    try:
        text = spark.read.text(f"{root}/{FOLDER}/{n:08d}.json", wholetext=True).first()[0]
        outer = json.loads(text)
        if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["digest"]:
            return None
        return json.loads(outer["body"])
    except (ValueError, KeyError, TypeError):
        return None
    except Py4JJavaError as e:
        if _refused(e):
            return None
        raise


def load_latest(spark: SparkSession, root: str, name: str, check: bool = True, **about) -> DataFrame:
    """A table of the newest run that has it, matches about and is whole; FileNotFoundError if there is none.

    check reads all files of the table once more for their content; without it lengths decide.
    """
    for n in _versions(spark, root):
        found = _manifest(spark, root, n)
        if found is None or name not in found["tables"] or any(found["about"].get(k) != v for k, v in about.items()):
            continue
        want = found["tables"][name]
        if unchanged(spark, f"{root}/data/{found['run']}/{name}", (want["files"], want["length"], want["digest"]), check):
            return spark.read.schema(T.StructType.fromJson(found["tables"][name]["schema"])).parquet(f"{root}/data/{found['run']}/{name}")
    raise FileNotFoundError(f"no whole run with {about} in {root}")


def drop(spark: SparkSession, root: str, n: int) -> None:
    """Delete the tables of a run; its manifest stays, so that its number is not given again, and readers pass over it."""
    found = _manifest(spark, root, n)
    if found is not None:
        fs, at = _fs(spark, f"{root}/data/{found['run']}")
        fs.delete(at, True)
