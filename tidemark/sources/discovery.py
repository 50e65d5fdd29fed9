"""Which files a path stands for, and how many bytes they have."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

#: Fixed: kinds of sources and the suffix that a folder is searched for; text has none.
SUFFIXES = {"evtx": ".evtx", "journald": ".journal", "text": None}
#: Fixed folder names of unified-log diagnostics; two of them mark one.
DIAGNOSTICS = ("persist", "special", "signpost", "highvolume", "timesync")
#: Files that Spark's writers leave in a folder, in the order of their rows.
_PART = re.compile(r"part-\d{5,}-.*")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _is_folder(spark: SparkSession, path: str) -> bool:
    files, p = _files(spark, path)
    return files.exists(p) and files.getFileStatus(p).isDirectory()


def _below(spark: SparkSession, path: str) -> Iterator:
    """The status of every file below a folder, at all depths."""
    files, p = _files(spark, path)
    found = files.listFiles(p, True)
    while found.hasNext():
        yield found.next()


def kind_of(spark: SparkSession, path: str) -> str:
    """The default kind of a path; the analyst may choose another."""
    if _is_folder(spark, path):
        return "aul"
    return next((k for k, s in SUFFIXES.items() if s and path.lower().endswith(s)), "text")


def parts_of(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """A log in parts: the part files of a folder with their sizes, in order; empty for anything else."""
    if not _is_folder(spark, path):
        return []
    files, p = _files(spark, path)
    found = ((f.getPath().getName(), f.getLen()) for f in files.listStatus(p) if f.isFile())
    # numbers beyond 99,999 have more digits
    return sorted(((f"{path.rstrip('/')}/{n}", size) for n, size in found if _PART.fullmatch(n)), key=lambda f: (int(f[0].rsplit("/part-", 1)[1].split("-")[0]), f[0]))


def source_files(spark: SparkSession, kind: str, path: str, suffix: str | None = None) -> list[str]:
    """A single file or a unified-log folder is itself; any other folder, in any store that Spark reads, is searched at all depths, sorted.

    A folder with several part files, as Spark writes one log in parts, stands for them.
    """
    if kind == "aul" or not _is_folder(spark, path):
        return [path]
    wanted, scheme = suffix or SUFFIXES.get(kind), "://" in path or path.startswith("file:")
    found = (f.getPath() for f in _below(spark, path))
    names = (str(p.toString()) if scheme else str(p.toUri().getPath()) for p in found)
    names = sorted(f for f in names if wanted is None or f.lower().endswith(wanted))
    parts: dict[str, int] = {}
    for folder, name in (f.rsplit("/", 1) for f in names):
        parts[folder] = parts.get(folder, 0) + bool(_PART.fullmatch(name))
    return sorted({folder if parts[folder] > 1 and _PART.fullmatch(name) else f"{folder}/{name}" for folder, name in (f.rsplit("/", 1) for f in names)})


def byte_size(spark: SparkSession, path: str) -> int:
    """Of a file, of the parts of a log, or of the trace files below a folder."""
    if _is_folder(spark, path):
        parts = parts_of(spark, path)
        return sum(n for _, n in parts) if parts else sum(f.getLen() for f in _below(spark, path) if f.getPath().getName().lower().endswith(".tracev3"))
    files, p = _files(spark, path)
    return files.getFileStatus(p).getLen()


def _child(folder: Path, name: str) -> Path | None:
    return next((p for p in sorted(folder.iterdir()) if p.is_dir() and p.name.lower() == name), None) if folder.is_dir() else None


def _names(folder: Path) -> set[str]:
    return {p.name.lower() for p in folder.iterdir()} if folder.is_dir() else set()


def _is_diagnostics(folder: Path) -> bool:
    return len(_names(folder) & set(DIAGNOSTICS)) >= 2


@dataclass(frozen=True)
class AulLayout:
    """A bundle, or a diagnostics folder and the folder of its strings."""

    diagnostics: Path
    strings: Path | None = None


def aul_layout(path: str | Path) -> AulLayout:
    """Flat bundle; diagnostics folder with its sibling of strings; parent of both; else a bundle."""
    folder = Path(path)
    names = _names(folder)
    if _is_diagnostics(folder):
        if "dsc" in names or any(len(n) == 2 and all(c in "0123456789abcdef" for c in n) for n in names):
            return AulLayout(folder)
        strings = _child(folder.parent, "uuidtext")
        if strings is None:
            raise FileNotFoundError(f"{folder} is a diagnostics folder, but there is no uuidtext folder beside it")
        return AulLayout(folder, strings)
    diagnostics, strings = _child(folder, "diagnostics"), _child(folder, "uuidtext")
    return AulLayout(diagnostics, strings) if diagnostics and strings else AulLayout(folder)
