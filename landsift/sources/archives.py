"""Inventory of PDFs inside ZIP archives."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landsift.functions import text as T

# Nesting depth, the part of a name that opens nested archives, manifest version.
MAX_DEPTH = 2
NESTED_SCOPE = "tekstualni_del"
MANIFEST_VERSION = 2
CHUNK = 1024 * 1024
# Rows that go out together.
ROWS_OUT = 1000
INVENTORY = "archive string, source_name string, member_name string, size_bytes bigint, sha256 string, rejected_reason string"


@dataclass(frozen=True)
class Limits:
    pdf_bytes: int = 500_000_000
    archive_bytes: int = 500_000_000


class Rejected(Exception):
    """An archive over a limit, or broken; none of its files count."""


def _digest(stream, limit: int) -> tuple[int, str]:
    size, sha = 0, hashlib.sha256()
    while block := stream.read(CHUNK):
        size += len(block)
        if size > limit:
            raise Rejected("pdf_too_large")
        sha.update(block)
    return size, sha.hexdigest()


def _inventory(data: bytes, limits: Limits) -> list[tuple[str, str, int, str]]:
    """Files of one archive in member order, nested archives in their place."""
    found, total = [], 0
    try:
        todo = [(zipfile.ZipFile(io.BytesIO(data)), "", False, 0)]
        walk = [(todo[0], iter(todo[0][0].infolist()))]
        while walk:
            (archive, prefix, scope, depth), members = walk[-1]
            member = next(members, None)
            if member is None:
                walk.pop()
                continue
            name = member.filename.casefold()
            if name.endswith(".pdf"):
                total += member.file_size
                if member.file_size > limits.pdf_bytes:
                    raise Rejected("pdf_too_large")
                if total > 2 * limits.archive_bytes:
                    raise Rejected("archive_too_large")
                with archive.open(member) as stream:
                    found.append((prefix + member.filename, member.filename, *_digest(stream, limits.pdf_bytes)))
            elif name.endswith(".zip") and depth < MAX_DEPTH and (scope or NESTED_SCOPE in name):
                if member.file_size > limits.archive_bytes:
                    raise Rejected("nested_too_large")
                with archive.open(member) as stream:
                    inner = stream.read(limits.archive_bytes + 1)
                if len(inner) > limits.archive_bytes:
                    raise Rejected("nested_too_large")
                nested = zipfile.ZipFile(io.BytesIO(inner))
                walk.append(((nested, f"{prefix}{member.filename}::", True, depth + 1), iter(nested.infolist())))
    except zipfile.BadZipFile:
        raise Rejected("bad_archive") from None
    return found


def _expand(batches: Iterator[pd.DataFrame], limits: Limits) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in INVENTORY.split(", ")]
    rows = []
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                rows += [(path, *item, None) for item in _inventory(bytes(content), limits)]
            except Rejected as reason:
                rows.append((path, None, None, None, None, str(reason)))
            if len(rows) >= ROWS_OUT:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def expand_archives(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per PDF of each archive, or one row with the reason it was rejected.

    ``archives``: ``path, content`` as ``binaryFile`` gives them; each task holds one
    archive at a time, and the rows of many go out together."""

    out = archives.select("path", "content").mapInPandas(lambda batches: _expand(batches, limits), INVENTORY)
    return out.withColumn("local_name", T.safe_filename(F.col("member_name"), F.col("sha256"))).drop("member_name")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)


def valid_manifests(manifests: DataFrame, listed: DataFrame, files: DataFrame) -> DataFrame:
    """Acts whose manifest has the current version and whose listed files all exist.

    ``manifests``: ``act_id, version``; ``listed`` and ``files``: ``act_id, local_name``."""
    missing = listed.join(files, ["act_id", "local_name"], "left_anti").select("act_id")
    return manifests.filter(F.col("version") == MANIFEST_VERSION).join(missing, "act_id", "left_anti")
