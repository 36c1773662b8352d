"""Where a repository comes from, and a data source that lists and reads its files.

``spark.read.format("repo_walk").load(root)`` lists every entry (also names with a leading dot or
underscore, which Spark's file sources leave out), says why an entry is skipped, and reads the text of
the others on the executors.  The driver lists the upper folders only, until there are enough of them; executors list what is
below.  Filters on ``extension`` (equal, in) and ``file_path`` (equal, in, begins with) reach the source where
``spark.sql.python.filterPushdown.enabled`` and the option ``pushFilters`` are true: what they leave out is not opened, and folders outside a prefix are not listed.

``spark.readStream.format("repo_walk").load(root)`` reads each file again when it has changed: the offset is a modification time.
"""

from __future__ import annotations

import os
import re
import shutil
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .. import model

SCHEMA = "file_path string, absolute_path string, extension string, language string, size long, skip_reason string, source string, error string"
_GITHUB = re.compile(r"^https://github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?/?$")


@dataclass(frozen=True)
class Repository:
    root: str
    source: str  # local or git
    commit: str | None


def parse_repo(value: str) -> tuple[str, str]:
    """("git", clone URL) or ("local", path); other remotes raise."""
    if "://" in value or value.startswith("git@"):
        found = _GITHUB.match(value)
        if not found:
            raise ValueError(f"unsupported repo source: {value}")
        return "git", f"https://github.com/{found[1]}/{found[2]}.git"
    return "local", value


def run_git(arguments: list[str], cwd: str | None = None) -> str:
    return subprocess.run(["git", *arguments], cwd=cwd, check=True, capture_output=True, text=True).stdout.strip()


def acquire(value: str, cache_dir: str = "tmp", refresh: bool = False, git: Callable[..., str] = run_git) -> Repository:
    """Use a local folder in place; clone a remote once (shallow) and fetch again only on refresh."""
    kind, where = parse_repo(value)
    root = os.path.abspath(where)
    if kind == "git":
        root = os.path.join(cache_dir, where.rsplit("/", 1)[1].removesuffix(".git"))
        if not os.path.isdir(root):
            git(["clone", "--depth", "1", where, root])
        elif refresh:
            git(["fetch", "--depth", "1", "origin"], root)
            git(["reset", "--hard", "FETCH_HEAD"], root)
    elif not os.path.isdir(root):
        raise ValueError(f"no such folder: {value}")
    try:
        commit = git(["rev-parse", "HEAD"], root)
    except (OSError, subprocess.CalledProcessError):
        commit = None
    return Repository(root, kind, commit)


def extension_of(name: str) -> str:
    return os.path.splitext(name)[1].lower()


def name_rule(name: str) -> str | None:
    """The skip rules that a file's name decides."""
    if name in model.LOCKFILES:
        return "lockfile"
    if name.endswith(".min.js"):
        return "minified"
    return "binary-extension" if extension_of(name) in model.BINARY_EXTENSIONS else None


def skip_reason(name: Column, size: Column, head: Column, symlink: Column | None = None, directory: Column | None = None) -> Column:
    """The same rules as an expression, first match wins; ``head`` holds the first bytes of the file."""
    extension = F.lower(F.regexp_extract(name, r"^.+(\.[^.]*)$", 1))
    link, folder = (c if c is not None else F.lit(False) for c in (symlink, directory))
    return (
        F.when(link, "symlink")
        .when(folder & name.isin(*model.IGNORED_DIRECTORIES), "ignored-dir")
        .when(name.isin(*model.LOCKFILES), "lockfile")
        .when(name.endswith(".min.js"), "minified")
        .when(extension.isin(*model.BINARY_EXTENSIONS), "binary-extension")
        .when(size > model.MAX_FILE_BYTES, "too-large")
        .when(F.contains(F.substring(head, 1, model.NUL_PROBE_BYTES), F.lit(b"\x00")), "binary-content")
    )


def _listed(folder: str, prefix: str) -> Iterator[tuple[str, str, str | None, bool]]:
    """(relative path, absolute path, reason known from the listing, whether it is a folder to list) of one folder, in order of name."""
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        path = f"{prefix}{entry.name}"
        if entry.is_symlink():
            yield path, entry.path, "symlink", False
        elif entry.is_dir():
            ignored = entry.name in model.IGNORED_DIRECTORIES
            yield path, entry.path, "ignored-dir" if ignored else None, not ignored
        elif entry.is_file():
            yield path, entry.path, name_rule(entry.name), False


def entries(folder: str, prefix: str = "", wanted: Callable[[str], bool] = lambda path: True) -> Iterator[tuple[str, str, str | None]]:
    """(relative path, absolute path, reason known from the listing), in order of path; ``wanted`` folders only."""
    for path, absolute, reason, below in _listed(folder, prefix):
        if not below:
            yield path, absolute, reason
        elif wanted(f"{path}/"):
            yield from entries(absolute, f"{path}/", wanted)


class _Part(InputPartition):
    """Entries that the driver listed, and folders that the executor has to list."""

    def __init__(self, rows: list[tuple[str, str, str | None]], folders: list[tuple[str, str]]):
        self.rows, self.folders = rows, folders


class Wanted:
    """What of the pushed filters the source decides itself."""

    def __init__(self) -> None:
        self.extensions: set[str] | None = None
        self.paths: set[str] | None = None
        self.prefixes: list[str] = []

    def take(self, f: Filter) -> bool:
        """Whether the filter is the source's business from now on."""
        column = getattr(f, "attribute", ())
        if isinstance(f, (EqualTo, In)) and column in (("extension",), ("file_path",)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            name = "extensions" if column == ("extension",) else "paths"
            held = getattr(self, name)
            setattr(self, name, values if held is None else held & values)
            return True
        if isinstance(f, StringStartsWith) and column == ("file_path",):
            self.prefixes.append(f.value)
            return True
        return False

    def file(self, path: str) -> bool:
        return (self.extensions is None or extension_of(path.rsplit("/", 1)[-1]) in self.extensions) and (self.paths is None or path in self.paths) and all(path.startswith(x) for x in self.prefixes)

    def folder(self, path: str) -> bool:
        """``path`` ends in a slash."""
        return all(path.startswith(x) or x.startswith(path) for x in self.prefixes) and (self.paths is None or any(x.startswith(path) for x in self.paths))


def _row(path: str, absolute: str, reason: str | None) -> tuple:
    extension = extension_of(path.rsplit("/", 1)[-1])
    language = model.LANGUAGES.get(extension, "unknown")
    size = source = error = None
    if reason is None:
        try:
            size = os.path.getsize(absolute)
            if size > model.MAX_FILE_BYTES:
                reason = "too-large"
            else:
                with open(absolute, "rb") as file:
                    data = file.read()
                if b"\0" in data[: model.NUL_PROBE_BYTES]:
                    reason = "binary-content"
                else:
                    source = data.decode("utf-8", "replace").removeprefix("\ufeff")
        except OSError as problem:
            error = str(problem)
    return path, absolute, extension, language, size, reason, source, error


class _Reader(DataSourceReader):
    def __init__(self, root: str, per_task: int, folders: int):
        self.root, self.per_task, self.folders, self.wanted = root, per_task, folders, Wanted()

    def partitions(self) -> list[InputPartition]:
        """Folders level by level, until a level has enough of them."""
        files: list[tuple[str, str, str | None]] = []
        level = [("", self.root)]
        while level and len(level) < self.folders:
            deeper = []
            for prefix, absolute in level:
                for path, below, reason, is_folder in _listed(absolute, prefix):
                    if is_folder and self.wanted.folder(f"{path}/"):
                        deeper.append((f"{path}/", below))
                    elif not is_folder and self.wanted.file(path):
                        files.append((path, below, reason))
            level = deeper
        parts = [_Part(files[k : k + self.per_task], []) for k in range(0, len(files), self.per_task)]
        return parts + [_Part([], [one]) for one in level] or [_Part([], [])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for row in partition.rows:
            yield _row(*row)
        for prefix, absolute in partition.folders:
            for path, below, reason in entries(absolute, prefix, self.wanted.folder):
                if self.wanted.file(path):
                    yield _row(path, below, reason)


class _FilteredReader(_Reader):
    """Spark allows a reader to take filters only where the setting for it is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.wanted.take(f))


class _Changes(DataSourceStreamReader):
    """Files whose modification time lies after the last offset; deleted files are not told."""

    def __init__(self, root: str, per_task: int):
        self.root, self.per_task = root, per_task

    def _times(self) -> Iterator[tuple[int, tuple[str, str, str | None]]]:
        for row in entries(self.root):
            try:
                yield os.lstat(row[1]).st_mtime_ns, row
            except OSError:  # gone since it was listed
                continue

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        return {"changed": max((t for t, _ in self._times()), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [row for t, row in self._times() if start["changed"] < t <= end["changed"]]
        return [_Part(rows[k : k + self.per_task], []) for k in range(0, len(rows), self.per_task)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return (_row(*row) for row in partition.rows)

    def commit(self, end: dict) -> None:
        pass


class RepoWalk(DataSource):
    """Options: path (the root folder), filesPerTask, foldersListed (folders that the driver lists at most, about), pushFilters."""

    @classmethod
    def name(cls) -> str:
        return "repo_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteredReader if self.options.get("pushFilters", "false") == "true" else _Reader
        return kind(self.options["path"], int(self.options.get("filesPerTask", 128)), int(self.options.get("foldersListed", 64)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Changes(self.options["path"], int(self.options.get("filesPerTask", 128)))


def ship(spark: SparkSession, root: str, shared: str) -> str:
    """Where executors can open the files: the folder itself on a local master, else a copy in ``shared``.

    The shared folder has to be mounted (file://), as files are opened by path.
    """
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return root
    if not shared.startswith("file://"):
        raise ValueError(f"the files of a repository cannot be opened in {shared}: set spark.checkpoint.dir to a mounted folder")
    return shutil.copytree(root, shared.removeprefix("file://"), symlinks=True, ignore=shutil.ignore_patterns(*model.IGNORED_DIRECTORIES))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """All entries; filters reach the source where the session's settings allow it."""
    spark.dataSource.register(RepoWalk)
    return spark.read.format("repo_walk").option("pushFilters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load(root)
