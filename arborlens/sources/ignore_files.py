"""Ignore rules of every repository as a table."""

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from arborlens.sources.corpus import local_path

# ---- fixed values: rule files of a repository, in reading order --------------
RULE_FILES = (".gitignore", ".git/info/exclude")


def rule_lines(roots: DataFrame) -> DataFrame:
    """Lines ``(repo_id, ord, pattern)`` of the rule files below ``(repo_id, root)``.

    Files that are missing or cannot be read give no lines.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for repo, root in zip(batch["repo_id"], batch["root"]):
                place = 0
                for name in RULE_FILES:
                    try:
                        with open(os.path.join(local_path(root), name), encoding="utf-8") as handle:
                            lines = handle.read().split("\n")
                    except (OSError, UnicodeDecodeError):
                        continue
                    if lines and lines[-1] == "":
                        lines.pop()
                    for line in lines:
                        out.append((repo, place, line))
                        place += 1
            yield pd.DataFrame(out, columns=["repo_id", "ord", "pattern"])

    return roots.select("repo_id", "root").mapInPandas(read, "repo_id string, ord int, pattern string")
