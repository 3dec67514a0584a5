"""Git history as a data source: commits and per-file changes, read with the git command.

``spark.read.format("git_history").option("path", repo).option("table", "commits" | "file_changes").load()``. The driver lists
the hashes of the commits once; each partition reads the messages or the changes of a run of them with a few git processes, so a
long history is spread over executors, which need to see the repository (a shared folder).
"""

from __future__ import annotations

import datetime as dt
import re
import subprocess
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from coderill.schemas import SCHEMAS

COMMITS_A_PARTITION = 2000
_HEADER = re.compile(rb"[0-9a-f]{40,64}")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)")
_PLAIN = {b"a": b"\a", b"b": b"\b", b"t": b"\t", b"n": b"\n", b"v": b"\v", b"f": b"\f", b"r": b"\r"}


def _command(repo: str, *args: str) -> list[str]:
    return ["git", "-c", "core.quotePath=false", "-C", repo, *args]


def git(repo: str, *args: str) -> bytes:
    return subprocess.run(_command(repo, *args), capture_output=True, check=True).stdout


@contextmanager
def _fed(repo: str, lines: list[str], *args: str):
    """The output, as a stream, of a git command that reads ``lines``."""
    with tempfile.TemporaryFile() as said:
        said.write("".join(x + "\n" for x in lines).encode())
        said.seek(0)
        with subprocess.Popen(_command(repo, *args), stdin=said, stdout=subprocess.PIPE) as run:
            yield run.stdout
        if run.returncode:
            raise subprocess.CalledProcessError(run.returncode, run.args)


def discover(folder: str) -> list[str]:
    """The folder itself and its direct children that hold a ``.git``, in order; none where the folder is missing."""
    root = Path(folder)
    if not root.is_dir():
        return []
    return [str(p) for p in [root, *sorted(x for x in root.iterdir() if x.is_dir())] if (p / ".git").exists()]


def repo_name(path: str) -> str:
    return Path(path).resolve().name


def commit_hashes(repo: str) -> list[str]:
    """All commits on any ref, newest first."""
    return git(repo, "rev-list", "--all").decode().split()


def commits_of(repo: str, hashes: list[str]) -> Iterator[tuple[str, str, str, int, str, list[str]]]:
    """(hash, author name, email, seconds, message, parents) of each, in the order given."""
    with _fed(repo, hashes, "log", "--no-walk=unsorted", "--stdin", "--format=%H%x00%an%x00%ae%x00%ct%x00%P%x00%B%x01") as out:
        rest = b""
        while piece := out.read(1 << 20):
            *whole, rest = (rest + piece).split(b"\x01")
            for block in whole:
                h, name, email, seconds, parents, message = block.decode("utf-8", "replace").lstrip("\n").split("\x00", 5)
                yield h, name, email, int(seconds), message.strip("\n"), parents.split()


def git_lines(repo: str, hashes: list[str]) -> list[str]:
    """Each commit and its parents, in the order given."""
    with _fed(repo, hashes, "log", "--no-walk=unsorted", "--stdin", "--format=%H %P") as out:
        return out.read().decode().splitlines()


def kind_of(status: str) -> str:
    """The type of a change from git's letter: anything but added, deleted, renamed and copied is a modification."""
    return status[:1] if status[:1] in ("A", "D", "R", "C") else "M"


def signed(lines: list[bytes], sign: bytes) -> int:
    """Lines of a patch that begin with ``sign`` and are no file header."""
    return sum(x.startswith(sign) and not x.startswith(sign * 3) for x in lines)


def pieces(content: bytes) -> int:
    """Pieces between the line breaks of a text; 0 for what is no UTF-8."""
    try:
        return len(content.decode().split("\n"))
    except UnicodeDecodeError:
        return 0


def _name(raw: bytes) -> str:
    """A path as git prints it: quoted where it holds signs that need it."""
    if raw.startswith(b'"'):
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8)]) if len(m[1]) == 3 else _PLAIN.get(m[1], m[1]), raw[1:-1])
    return raw.decode("utf-8", "replace")


def _root_changes(repo: str, commit: str) -> Iterator[tuple[str, int, int, str, str | None]]:
    """All files of a commit without parents, as added; one process reads all of them."""
    blobs = []
    for line in git(repo, "ls-tree", "-r", "-z", commit).split(b"\0"):
        if line:
            meta, path = line.split(b"\t", 1)
            kind, sha = meta.split()[1:3]
            if kind == b"blob":
                blobs.append((sha.decode(), path.decode("utf-8", "replace")))
    with _fed(repo, [sha for sha, _ in blobs], "cat-file", "--batch") as out:
        for _, path in blobs:
            size = int(out.readline().split()[2])
            content = out.read(size)
            out.read(1)
            yield path, pieces(content), 0, "A", None


def changes_of(repo: str, commits: list[tuple[str, list[str]]]) -> Iterator[tuple[str, tuple[str, int, int, str, str | None]]]:
    """(commit, (path, lines added, lines deleted, type, old path)) of (commit, parents), against the first parent.

    Of a commit without parents every text counts the pieces between line breaks, and other content 0. Otherwise lines of the
    patch count that begin with a sign which isn't part of a file header. All other commits are read by one process.
    """
    for h, parents in commits:
        if not parents:
            yield from ((h, c) for c in _root_changes(repo, h))
    with _fed(repo, [f"{h} {p[0]}" for h, p in commits if p], "diff-tree", "--stdin", "-r", "-M", "--raw", "-p", "--no-color") as out:
        commit, files, at, patch = "", [], -1, []

        def close() -> None:
            if at >= 0:
                files[at]["plus"] += signed(patch, b"+")
                files[at]["minus"] += signed(patch, b"-")
            patch.clear()

        for raw in chain(out, [b"0" * 40]):
            line = raw.rstrip(b"\n")
            if _HEADER.fullmatch(line):
                close()
                yield from ((commit, (f["path"], f["plus"], f["minus"], f["kind"], f["old"])) for f in files)
                commit, files, at = line.decode(), [], -1
            elif line.startswith(b":"):
                status, *names = line.split(b"\t")
                letter = status.split()[-1].decode()
                # a change of a file's sort has two patches, a deletion and an addition
                files.append({"path": _name(names[-1]), "kind": kind_of(letter), "old": _name(names[0]) if letter[0] == "R" else None, "plus": 0, "minus": 0, "patches": 1 + (letter[0] == "T")})
            elif line.startswith(b"diff --git "):
                close()
                if at < 0 or not files[at]["patches"]:
                    at += 1
                files[at]["patches"] -= 1
            else:
                patch.append(line)


class _Run(InputPartition):
    def __init__(self, first: int, commits: list[str]):
        super().__init__(None)
        self.first, self.commits = first, commits


class GitReader(DataSourceReader):
    def __init__(self, repo: str, table: str):
        self.repo, self.table = repo, table

    def partitions(self) -> list[InputPartition]:
        # ids follow the order of the scan
        found = commit_hashes(self.repo)
        return [_Run(k + 1, found[k : k + COMMITS_A_PARTITION]) for k in range(0, len(found), COMMITS_A_PARTITION)] or [_Run(1, [])]

    def read(self, partition: _Run) -> Iterator[tuple]:
        ids = {h: i for i, h in enumerate(partition.commits, partition.first)}
        if not ids:
            return
        if self.table == "commits":
            for h, name, email, seconds, message, _ in commits_of(self.repo, partition.commits):
                yield ids[h], h, name, email, dt.datetime.fromtimestamp(seconds, dt.timezone.utc), message
        else:
            seen: dict[str, int] = {}
            parents = [line.split() for line in git_lines(self.repo, partition.commits)]
            for h, (path, plus, minus, kind, old) in changes_of(self.repo, [(x[0], x[1:]) for x in parents]):
                k = seen.get(h, 0)
                seen[h] = k + 1
                yield (ids[h] << 20) + k, ids[h], path, plus, minus, kind, old


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> StructType:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema: StructType) -> GitReader:
        return GitReader(self.options["path"], self.options.get("table", "commits"))


def read(spark: SparkSession, repo: str, table: str = "commits") -> DataFrame:
    from coderill.sources.tree import workers_see_package

    workers_see_package(spark)
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("path", repo).option("table", table).load()
