"""A growing git log as a stream: a Python data source whose offset is the newest commit that was read.

The log is the text of `git log --numstat` in the block format of texts.git_log, newest commit first, in a file that
driver and executors can open, replaced by a longer one as history grows:

    spark.dataSource.register(GitLogSource)
    spark.readStream.format("git_log").option("path", path).load()

A batch reads the commits above the last offset. If the log doesn't have that commit any more, as after a rewrite
of history, it is read from its beginning. Batches are cut into partitions of COMMITS commits, by their places
in the file, so that a first read of a long history is spread over tasks; the driver looks at separators only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from graphmill.sources.texts import COMMIT, GIT_LOG, git_log

#: Commits of one partition.
COMMITS = 5000


@dataclass
class Stretch(InputPartition):
    """Bytes of the log."""

    begin: int
    end: int


def commits_at(path: str) -> Iterator[tuple[int, str]]:
    """Place and sha of each commit, from the newest on."""
    mark = COMMIT.encode()
    with open(path, "rb") as f:
        at = 0
        while line := f.readline():
            if line.rstrip(b"\n") == mark:
                sha = f.readline()
                yield at, sha.strip().decode()
                at += len(sha)
            at += len(line)


def stretches(path: str, after: str | None, last: str | None, commits: int) -> list[Stretch]:
    """Partitions of the commits from `last` (null: the newest) down to `after`, which is left out; all of them if
    the log has no `after`."""
    import os

    starts: list[int] = []
    known = None
    inside = last is None
    for at, sha in commits_at(path):
        inside = inside or sha == last
        if sha == after:
            known = at
            break
        if inside:
            starts.append(at)
    end = os.path.getsize(path) if known is None else known
    cuts = [*starts[::commits], end]
    return [Stretch(a, b) for a, b in zip(cuts, cuts[1:]) if a < b] if starts else []


def read_stretch(path: str, part: Stretch) -> Iterator[tuple]:
    with open(path, "rb") as f:
        f.seek(part.begin)
        text = f.read(part.end - part.begin).decode("utf-8", "replace")
    for c in git_log(text):
        files = [(f["file_path"], f["change_type"], f["insertions"], f["deletions"]) for f in c["files"]]
        yield c["sha"], c["author"], c["author_email"], c["timestamp"], c["message"], c["parents"], files


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, commits: int) -> None:
        self.path, self.commits = path, commits

    def initialOffset(self) -> dict:  # noqa: N802
        return {"commit": None}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"commit": next((sha for _, sha in commits_at(self.path)), None)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        if end["commit"] is None or start["commit"] == end["commit"]:
            return []
        return stretches(self.path, start["commit"], end["commit"], self.commits)

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return read_stretch(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class _Batch(DataSourceReader):
    def __init__(self, path: str, commits: int, after: str | None) -> None:
        self.path, self.commits, self.after = path, commits, after

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, self.after, None, self.commits) or [Stretch(0, 0)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return read_stretch(self.path, partition)


class GitLogSource(DataSource):
    """Options: path; commits (of a partition); after (batch reads: the newest commit that is known)."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return GIT_LOG

    def _commits(self) -> int:
        return int(self.options.get("commits", COMMITS))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], self._commits(), self.options.get("after"))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options["path"], self._commits())
