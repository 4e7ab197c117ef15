"""Which files of a store are current: one small manifest a commit, swapped at the end.

Cells and axes of a store lie in folders that carry a version. A commit adds folders and then
names all that are current in a new manifest; a reader takes the newest manifest and sees a
whole state, the one before until the very end. What the last two manifests do not name is removed
after a commit, so that a cube opened before it can still be read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

FOLDER = "_manifest"
VERSION = "version"
# Key of a cube without time, or of one that was stored as a whole.
WHOLE = "whole"


@dataclass(frozen=True)
class Manifest:
    """A state of a store.

    number    of the commit
    schema    of the cells, as JSON; None if the cells are not this library's
    cells     version of the cells by year, or of all of them under WHOLE
    axes      version of the axes likewise
    index     version of the axis positions, which are along all years
    dims      per dimension its field, as JSON, and the number of its positions
    partials  version of the sums and counts by month, by year; see `store.open_means`
    requests  what was asked for, by year or under WHOLE
    reports   cells, missing values and extents of each version of cells that is there
    """

    number: int = 0
    schema: str | None = None
    cells: Mapping[str, str] = field(default_factory=dict)
    axes: Mapping[str, str] = field(default_factory=dict)
    index: str | None = None
    dims: Mapping[str, dict] = field(default_factory=dict)
    partials: Mapping[str, str] = field(default_factory=dict)
    requests: Mapping[str, str] = field(default_factory=dict)
    reports: Mapping[str, dict] = field(default_factory=dict)


def new_version() -> str:
    return f"v{uuid.uuid4().hex[:16]}"


def folders(path: str, versions: Mapping[str, str]) -> list[str]:
    """Where the named versions lie below `path`."""
    return [f"{path}/{VERSION}={v}" if key == WHOLE else f"{path}/year={key}/{VERSION}={v}" for key, v in versions.items()]


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The newest manifest of a store, None if there is none."""
    found = _listed(spark, path)
    return _read(spark, f"{path}/{FOLDER}/{found[-1]:08d}.json") if found else None


def stores(spark: SparkSession, path: str) -> dict[str, Manifest]:
    """The folders right below `path` that hold a store, with their manifests."""
    found = _file_system(spark, path).globStatus(_paths(spark)(f"{path}/*/{FOLDER}")) or ()
    names = [f.getPath().getParent().getName() for f in found]
    kept = {f"{path}/{n}": current(spark, f"{path}/{n}") for n in names}
    return {folder: manifest for folder, manifest in kept.items() if manifest}


def commit(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Make a state the current one, if none was made meanwhile; then clear away older ones."""
    target, fs, new_path = f"{path}/{FOLDER}/{manifest.number:08d}.json", _file_system(spark, path), _paths(spark)
    draft = f"{path}/{FOLDER}/.{uuid.uuid4().hex}"
    out = fs.create(new_path(draft), True)
    out.write(json.dumps(asdict(manifest)).encode())
    out.close()
    # Renaming does not replace what is there: of two writers one fails.
    if fs.exists(new_path(target)) or not fs.rename(new_path(draft), new_path(target)):
        fs.delete(new_path(draft), False)
        raise RuntimeError(f"{path} was changed by someone else at the same time")
    _clear(spark, path)


def written_keys(spark: SparkSession, path: str, version: str) -> list[str]:
    """The years for which a version has cells; WHOLE if it is not by year."""
    fs, new_path = _file_system(spark, path), _paths(spark)
    if fs.exists(new_path(f"{path}/{VERSION}={version}")):
        return [WHOLE]
    found = fs.globStatus(new_path(f"{path}/year=*/{VERSION}={version}")) or ()
    return sorted(f.getPath().getParent().getName().removeprefix("year=") for f in found)


def _clear(spark: SparkSession, path: str) -> None:
    """Drop manifests before the last two, and the folders that only they name. What a
    store that broke off has left is named by none and stays."""
    numbers = _listed(spark, path)
    old, kept = ([_read(spark, f"{path}/{FOLDER}/{n:08d}.json") for n in part] for part in (numbers[:-2], numbers[-2:]))
    fs, new_path = _file_system(spark, path), _paths(spark)
    named = {f for m in kept for f in _folders(path, m)}
    for m in old:
        for folder in set(_folders(path, m)) - named:
            for found in fs.globStatus(new_path(folder)) or ():
                fs.delete(found.getPath(), True)
        fs.delete(new_path(f"{path}/{FOLDER}/{m.number:08d}.json"), False)


def _folders(path: str, m: Manifest) -> list[str]:
    """All folders of a state, those of the axes as patterns."""
    index = [f"{path}/_index/*/{VERSION}={m.index}"] if m.index else []
    return [*folders(path, m.cells), *folders(f"{path}/_axes/*", m.axes), *folders(f"{path}/_partials", m.partials), *index]


def existing(spark: SparkSession, path: str, versions: Mapping[str, str]) -> list[str]:
    """Of `folders(path, versions)` those that are there."""
    fs, new_path = _file_system(spark, path), _paths(spark)
    found = {f.getPath().toUri().getPath() for pattern in (f"{VERSION}=*", f"year=*/{VERSION}=*")
             for f in fs.globStatus(new_path(f"{path}/{pattern}")) or ()}
    return [f for f in folders(path, versions) if new_path(f).toUri().getPath() in found]


def _listed(spark: SparkSession, path: str) -> list[int]:
    found = _file_system(spark, path).globStatus(_paths(spark)(f"{path}/{FOLDER}/*.json")) or ()
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)


def _read(spark: SparkSession, file: str) -> Manifest:
    fs, new_path = _file_system(spark, file), _paths(spark)
    stream = fs.open(new_path(file))
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return Manifest(**json.loads(text))


def _paths(spark: SparkSession):
    return spark._jvm.org.apache.hadoop.fs.Path


def _file_system(spark: SparkSession, path: str):
    return _paths(spark)(path).getFileSystem(spark._jsc.hadoopConfiguration())
