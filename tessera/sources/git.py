"""Git as a source: changed files, log and line authors, through the git program on the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(repository: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", repository, *args], capture_output=True, text=True, timeout=120, check=False)
    return done.stdout.splitlines() if done.returncode == 0 else []


def changed_files(spark: SparkSession, repository: str, ref: str = "HEAD", suffix: str = ".java") -> DataFrame:
    """path of files that differ from a commit, untracked ones included; none outside a repository."""
    names = {*_git(repository, "diff", "--name-only", ref), *_git(repository, "ls-files", "--others", "--exclude-standard")}
    return spark.createDataFrame([(n,) for n in sorted(names) if n.endswith(suffix)], "path string")


def log(spark: SparkSession, repository: str, path: str) -> DataFrame:
    """commit, author, at and message of each commit that touched a file."""
    rows = [tuple(line.split("\x1f", 3)) for line in _git(repository, "log", "--follow", "--format=%H%x1f%an%x1f%aI%x1f%s", "--", path)]
    return spark.createDataFrame(rows, "commit string, author string, at string, message string").selectExpr("commit", "author", "to_timestamp(at) AS at", "message")


def blame(spark: SparkSession, repository: str, path: str) -> DataFrame:
    """line_no, author and at of each line of a file."""
    rows, author, at = [], "", 0
    for line in _git(repository, "blame", "--line-porcelain", "--", path):
        if line.startswith("author "):
            author = line[7:]
        elif line.startswith("author-time "):
            at = int(line[12:])
        elif line.startswith("\t"):
            rows.append((len(rows) + 1, author, at))
    return spark.createDataFrame(rows, "line_no int, author string, at long").selectExpr("line_no", "author", "timestamp_seconds(at) AS at")
