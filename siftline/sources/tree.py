"""Corpora from a tree of files, on a file system that driver and executors share.

listing() gives the files to index, by ignore files, names, sizes, links and their first bytes: the driver
walks the upper folders only, tasks walk the folders below. contents() reads the files of a listing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Names pruned at any depth, extensions taken for binary, names of ignore files, limits.
PRUNED = ("node_modules", "_build", "deps", ".elixir_ls", ".idea", ".vscode", "target", "vendor", "dist", "build", "out")
BINARY_EXTENSIONS = tuple(
    "png jpg jpeg gif bmp ico svg woff woff2 ttf eot mp3 mp4 avi mov pdf zip tar gz bz2 xz 7z rar exe dll so dylib "
    "o a beam class jar war pyc pyo DS_Store lock node wasm bin obj db sqlite sqlite3 log".split()
)
IGNORE_FILES = (".gitignore", ".ignore", ".siftlineignore")
MAX_FILE_SIZE = 1 << 20
SNIFF = 512


@dataclass(frozen=True)
class ScanOptions:
    max_file_size: int = MAX_FILE_SIZE
    follow_symlinks: bool = False


@lru_cache(maxsize=4096)
def _glob(pattern: str) -> re.Pattern:
    """A glob of an ignore file: * and ? stop at slashes, ** crosses them."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out + r"\Z", re.S)


@dataclass(frozen=True)
class IgnoreRule:
    base: str  # folder of the ignore file
    glob: str
    negated: bool
    folders_only: bool
    anchored: bool

    def fits(self, path: str, folder: bool) -> bool:
        if self.folders_only and not folder:
            return False
        rest = os.path.relpath(path, self.base)
        if rest == ".." or rest.startswith("../"):
            return False
        return bool(_glob(self.glob).match(rest if self.anchored else os.path.basename(rest)))


def read_rules(path: str, base: str | None = None) -> list[IgnoreRule]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            lines = f.read().split("\n")
    except OSError:
        return []
    out = []
    for line in lines:
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        body = line[1:] if negated else line
        only = body.endswith("/")
        body = body.rstrip("/")
        if body:
            out.append(IgnoreRule(base or os.path.dirname(path), body.removeprefix("/"), negated, only, "/" in body))
    return out


def _ignored(path: str, folder: bool, levels: Sequence[Sequence[IgnoreRule]]) -> bool:
    """The nearest level that says something decides; in it the last rule that fits."""
    for rules in reversed(levels):
        for rule in reversed(rules):
            if rule.fits(path, folder):
                return not rule.negated
    return False


def _folder_rules(folder: str) -> list[IgnoreRule]:
    return [r for name in IGNORE_FILES for r in read_rules(os.path.join(folder, name))]


def is_hidden(name: str) -> bool:
    return name.startswith(".")


def extension(name: str) -> str:
    stem, dot, ext = name.rpartition(".")
    return ext if dot and stem else ""


def display_root(root: str) -> str:
    return os.path.realpath(root) if os.path.exists(root) else root


_BINARY = {e.lower() for e in BINARY_EXTENSIONS}


def _config_excludes(path: str) -> str | None:
    """core.excludesFile of a git configuration file."""
    section, out = "", None
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                line = line.strip()
                if line.startswith("["):
                    section = line.strip("[]").strip().lower()
                elif section == "core" and line.partition("=")[0].strip().lower() == "excludesfile":
                    out = line.partition("=")[2].strip().strip('"')
    except OSError:
        pass
    return out


def _outer_rules(root: str) -> list[list[IgnoreRule]]:
    """Rules from outside the tree, weakest first: the user's, the repository's own file, and those of the folders above."""
    home = os.path.expanduser("~")
    xdg = os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config")
    named = _config_excludes(os.path.join(home, ".gitconfig")) or _config_excludes(os.path.join(xdg, "git", "config"))
    users = os.path.join(home, named[2:]) if named and named.startswith("~/") else named or os.path.join(xdg, "git", "ignore")
    parents = [os.path.dirname(root)]
    while os.path.dirname(parents[-1]) != parents[-1]:
        parents.append(os.path.dirname(parents[-1]))
    repository = next((p for p in (root, *parents) if os.path.exists(os.path.join(p, ".git"))), root)
    own = read_rules(os.path.join(repository, ".git/info/exclude"), repository)
    return [read_rules(users, repository), own, *(_folder_rules(p) for p in reversed(parents))]


@dataclass(frozen=True)
class Folder:
    """A folder to walk: the rules of the folders above, and their identities, by which loops of links are told."""

    path: str
    levels: tuple[tuple[IgnoreRule, ...], ...]
    above: frozenset


File = tuple[str, int, int]


def _fits(path: str, name: str, stat: os.stat_result, options: ScanOptions) -> bool:
    return extension(name).lower() not in _BINARY and 0 < stat.st_size <= options.max_file_size and not _binary(path)


def _binary(path: str) -> bool:
    try:
        with open(path, "rb") as f:
            return b"\0" in f.read(SNIFF)
    except OSError:
        return True


def _list(folder: Folder, options: ScanOptions) -> tuple[list[File], list[Folder]]:
    """(files to index, folders to walk) of one folder, by name."""
    try:
        entries = sorted(os.scandir(folder.path), key=lambda e: e.name)
    except OSError:
        return [], []
    levels = (*folder.levels, tuple(_folder_rules(folder.path)))
    files, folders = [], []
    for e in entries:
        try:
            if is_hidden(e.name) or e.name in PRUNED or (e.is_symlink() and not options.follow_symlinks):
                continue
            is_dir = e.is_dir()
            if _ignored(e.path, is_dir, levels):
                continue
            stat = e.stat()
            if is_dir:
                if (stat.st_dev, stat.st_ino) not in folder.above:
                    folders.append(Folder(e.path, levels, folder.above | {(stat.st_dev, stat.st_ino)}))
            elif e.is_file() and _fits(e.path, e.name, stat, options):
                files.append((e.path, max(0, int(stat.st_mtime)), stat.st_size))
        except OSError:
            continue
    return files, folders


def walk(folders: list[Folder], options: ScanOptions) -> Iterator[File]:
    """The files of folders and of all below."""
    todo = folders[::-1]
    while todo:
        files, below = _list(todo.pop(), options)
        yield from files
        todo += below[::-1]


def _root(root: str, options: ScanOptions) -> tuple[list[File], list[Folder]]:
    root = display_root(root)
    if os.path.isfile(root):
        name, stat = os.path.basename(root), os.stat(root)
        fits = not is_hidden(name) and _fits(root, name, stat, options)
        return ([(root, max(0, int(stat.st_mtime)), stat.st_size)] if fits else []), []
    if not os.path.isdir(root):
        return [], []
    stat = os.stat(root)
    return [], [Folder(root, tuple(map(tuple, _outer_rules(root))), frozenset([(stat.st_dev, stat.st_ino)]))]


def scan(root: str, options: ScanOptions = ScanOptions()) -> list[File]:
    """(path, mtime, size) of the files to index, by path, listed here and now."""
    files, folders = _root(root, options)
    return sorted([*files, *walk(folders, options)], key=lambda x: os.fsencode(x[0]))


def read_file(path: str) -> bytes | None:
    """Content, or None for what is gone, unreadable or binary."""
    try:
        with open(path, "rb") as f:
            content = f.read()
    except OSError:
        return None
    return None if b"\0" in content[:SNIFF] else content


LISTING, SCHEMA = "path string, mtime long, size long", "path string, mtime long, size long, content binary"
#: The driver walks folders until so many are left, which are the tasks; it hands out files in groups of so many.
TASKS, FILES_PER_TASK = 256, 2_000
#: Contents leave a task in batches of about so many bytes.
BATCH_BYTES = 16 << 20


@dataclass
class TreePartition(InputPartition):
    files: list[File]
    folders: list[Folder]


class TreeReader(DataSourceReader):
    def __init__(self, root: str, options: ScanOptions) -> None:
        self.root, self.options = root, options

    def partitions(self) -> list[TreePartition]:
        files, folders = _root(self.root, self.options)
        while folders and len(folders) < TASKS:  # a level at a time
            below = []
            for f in folders:
                own, under = _list(f, self.options)
                files += own
                below += under
            folders = below
        out = [TreePartition(files[k : k + FILES_PER_TASK], []) for k in range(0, len(files), FILES_PER_TASK)]
        return out + [TreePartition([], [f]) for f in folders] or [TreePartition([], [])]

    def read(self, partition: TreePartition) -> Iterator[tuple]:
        yield from partition.files
        yield from walk(partition.folders, self.options)


class TreeDataSource(DataSource):
    """spark.read.format("siftline_tree").option("max_file_size", ...).option("follow_symlinks", ...).load(root): a listing."""

    @classmethod
    def name(cls) -> str:
        return "siftline_tree"

    def schema(self) -> StructType | str:
        return LISTING

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        follow = str(o.get("follow_symlinks", "false")).lower() == "true"
        return TreeReader(o["path"], ScanOptions(int(o.get("max_file_size", MAX_FILE_SIZE)), follow))


def listing(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """(path, mtime, size) of a tree's files."""
    spark.dataSource.register(TreeDataSource)
    return (
        spark.read.format("siftline_tree")
        .option("max_file_size", options.max_file_size)
        .option("follow_symlinks", str(options.follow_symlinks).lower())
        .load(display_root(root))
    )


def contents(files: DataFrame) -> DataFrame:
    """corpus(path, mtime, size, content) of listed files; those that are gone or turned binary are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = read_file(row[0])
                if content is not None:
                    rows.append((*row, content))
                    size += len(content)
                if size > BATCH_BYTES:
                    yield made(rows)
                    rows, size = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "mtime", "size", "content"])

    return files.select("path", "mtime", "size").mapInArrow(run, SCHEMA)


def tree_corpus(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """corpus(path, mtime, size, content) of a tree."""
    return contents(listing(spark, root, options))


def text_of(content) -> F.Column:
    """Valid UTF-8 of raw bytes; what is invalid becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))
