"""Saving packages: drift check, rebuilt package, validation, backup, atomic replacement."""

from __future__ import annotations

import hashlib
import io
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumite.errors import SourceChangedError, ValidationError
from vellumite.sources.docx import MAIN_PART, Unreadable, check_xml, main_part

DECLARATION = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


@dataclass(frozen=True)
class SaveResult:
    path: str
    backup_path: str | None
    sha256: str
    size: int


@dataclass(frozen=True)
class Fingerprint:
    sha256: str
    size: int
    mtime_ns: int

    @classmethod
    def of(cls, path: Path) -> Fingerprint:
        content, stat = path.read_bytes(), path.stat()
        return cls(hashlib.sha256(content).hexdigest(), len(content), stat.st_mtime_ns)


def check_drift(path: Path, known: Fingerprint) -> None:
    try:
        same = Fingerprint.of(path) == known
    except OSError:
        same = False
    if not same:
        raise SourceChangedError(source_path=str(path))


def rebuilt(package: bytes, main: bytes) -> bytes:
    """The package with another main part: the same entries in the same order, with their metadata."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(out, "w") as new:
        new.comment = old.comment
        for entry in old.infolist():
            new.writestr(entry, DECLARATION + main if entry.filename == MAIN_PART else old.read(entry), entry.compress_type)
    check_package(out.getvalue())
    return out.getvalue()


def check_package(package: bytes) -> None:
    checks = ("zip_integrity", "main_part", "main_xml")
    step = 0
    try:
        with zipfile.ZipFile(io.BytesIO(package)) as z:
            if z.testzip():
                raise Unreadable("damaged entry")
        step = 1
        main = main_part(package)
        step = 2
        check_xml(main)
    except (zipfile.BadZipFile, Unreadable) as e:
        raise ValidationError(stage="save", checks=checks, failed_check=checks[step], cause=e) from e


def write(package: bytes, dest: Path, backup: bool = True) -> SaveResult:
    """Puts a package in place at once; the one before it is kept beside it as ``.bak``."""
    if not dest.parent.is_dir():
        raise FileNotFoundError(dest.parent)
    staged, kept = dest.with_name(f".{dest.name}.{uuid.uuid4().hex}.tmp"), None
    try:
        staged.write_bytes(package)
        if backup and dest.exists():
            kept = dest.with_name(dest.name + ".bak")
            copy = dest.with_name(f".{dest.name}.{uuid.uuid4().hex}.bak")
            shutil.copy2(dest, copy)
            os.replace(copy, kept)
        os.replace(staged, dest)
    finally:
        staged.unlink(missing_ok=True)
    return SaveResult(str(dest), str(kept) if kept else None, hashlib.sha256(package).hexdigest(), len(package))


def save_packages(edited: DataFrame, folder: str) -> DataFrame:
    """Writes packages (path, content, error: see plans.package) into a folder that all executors reach as a path; one row for each: path, dest, sha256, size, error.

    A task that runs again writes the same bytes to the same place, through a name of its own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, error in batch.itertuples(index=False):
                dest = Path(folder, path.rpartition("/")[2])
                try:
                    done = write(content, dest) if error is None else None
                except OSError as e:
                    done, error = None, str(e)
                out.append((path, str(dest), done and done.sha256, done and done.size, error))
            yield pd.DataFrame(out, columns=["path", "dest", "sha256", "size", "error"]).astype({"size": "Int64"})

    return edited.select("path", "content", "error.reason").mapInPandas(run, "path string, dest string, sha256 string, size long, error string")


def drifted(known: DataFrame, files: DataFrame) -> DataFrame:
    """Paths of ``known`` (path, source) that are gone or whose bytes differ now."""
    now = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))
    was = known.select("path", F.col("source.sha256").alias("was"), F.col("source.size").alias("was_size")).distinct()
    both = was.join(now, "path", "left")
    return both.where(F.col("sha256").isNull() | (F.col("sha256") != F.col("was")) | (F.col("size") != F.col("was_size"))).select("path", F.lit("source_changed").alias("error"))
