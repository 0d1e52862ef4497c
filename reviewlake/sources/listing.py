"""File listings: a directory tree through ``binaryFile``, commits of git repositories through a data source of its own."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Settings under which git runs nothing that a repository brings along.
HARDENED = ["-c", "core.hooksPath=/dev/null", "-c", "protocol.ext.allow=never"]
# git's own format language: kind, name, size and path, in records that end with a NUL.
_RECORD = "%(objecttype) %(objectname) %(objectsize) %(path)"


def _tree(spark: SparkSession, root: str) -> DataFrame:
    base = root.rstrip("/")
    relative = F.regexp_replace("path", f"^(file:)?/*{re.escape(base.lstrip('/'))}/", "")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).withColumn("path", relative)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes`` of every file under a folder; contents are not read."""
    return _tree(spark, root).select("path", F.col("length").alias("size_bytes"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """As ``list_tree``, with ``content`` decoded; join it to a filtered listing so that excluded files stay unread."""
    return _tree(spark, root).select("path", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))


def git(repository: str | None, *args: str, given: bytes | None = None) -> bytes:
    at = [] if repository is None else ["-c", f"safe.directory={os.path.abspath(repository)}", "-C", repository]
    return subprocess.run(["git", *HARDENED, *at, *args], input=given, check=True, capture_output=True, timeout=600).stdout


def slug(url: str) -> str:
    """A folder name for a url: its last segment in safe characters and a part of its hash."""
    name = re.sub(r"\.git$", "", url.rstrip("/").rpartition("/")[2])
    return f"{re.sub(r'[^0-9A-Za-z_-]', '_', name)[:40]}-{hashlib.sha256(url.encode()).hexdigest()[:16]}.git"


def cached_clone(url: str, root: str) -> str:
    """The folder of a bare clone without file contents, made once under ``root``, which the executors must share.

    It is made beside its place and renamed, so that jobs that race for it find it whole or not at all.
    """
    place = os.path.join(root, slug(url))
    if not os.path.isdir(place):
        os.makedirs(root, exist_ok=True)
        own = f"{place}.{os.getpid()}"
        git(None, "clone", "--quiet", "--bare", "--filter=blob:none", "--no-tags", "--", url, own)
        try:
            os.rename(own, place)
        except OSError:
            if not os.path.isdir(place):
                raise
    return place


def entries(records: bytes) -> list[tuple[str, str, int]]:
    """(path, blob, size) of records in ``_RECORD``'s format; submodules are no files.  Bytes of a path that are no UTF-8 are
    kept as escapes."""
    split = (r.split(b" ", 3) for r in records.split(b"\0") if r.startswith(b"blob "))
    return [(path.decode("utf-8", "backslashreplace"), blob.decode(), int(size) if size.isdigit() else 0) for _, blob, size, path in split]


def contents(repository: str, blobs: list[str]) -> Iterator[bytes]:
    """The contents of blobs in their order, by one process that is asked for all of them."""
    out, at = git(repository, "cat-file", "--batch", given="\n".join(blobs).encode() + b"\n") if blobs else b"", 0
    for _ in blobs:
        head = out.index(b"\n", at)
        size = int(out[at:head].split()[2])
        yield out[head + 1 : head + 1 + size]
        at = head + size + 2


class _Slice(InputPartition):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    """The commit is listed once, on the driver; a partition is a slice of the listing of about ``slice_bytes`` of content."""

    def __init__(self, options):
        self.commit, self.content = options.get("commit", "HEAD"), options.get("content", "false") == "true"
        self.slice_files, self.slice_bytes = int(options.get("slice_files", "5000")), int(options.get("slice_bytes", str(32 << 20)))
        self.repository = cached_clone(options["url"], options["cache"]) if "url" in options else options["path"]

    def partitions(self):
        slices: list[list] = [[]]
        held = 0
        for f in entries(git(self.repository, "ls-tree", "-r", "-z", f"--format={_RECORD}", self.commit)):
            if len(slices[-1]) >= self.slice_files or self.content and slices[-1] and held + f[2] > self.slice_bytes:
                slices.append([])
                held = 0
            slices[-1].append(f)
            held += f[2]
        return [_Slice(s) for s in slices]

    def read(self, partition):
        if not self.content:
            yield from ((*f, None) for f in partition.files)
            return
        for f, data in zip(partition.files, contents(self.repository, [blob for _, blob, _ in partition.files])):
            yield (*f, data.decode("utf-8", "replace"))


class GitSource(DataSource):
    """``spark.read.format("git").option("commit", sha).load(repository)``: the files of one commit of a repository.

    Options: ``commit`` (HEAD); ``content`` ("true" to read texts); ``url`` and ``cache`` instead of a path, to read from a
    clone kept in a shared folder; ``slice_files`` and ``slice_bytes``, what a partition holds.  Register with ``register``.
    """

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "path string, blob_sha string, size_bytes bigint, content string"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitSource)


def root_ignore_rules(files: DataFrame) -> list[str]:
    """The lines of the ``.gitignore`` at the root of a listing with contents: one small file, read to the driver."""
    row = files.filter("path = '.gitignore'").select("content").first()
    return (row["content"] or "").splitlines() if row else []
