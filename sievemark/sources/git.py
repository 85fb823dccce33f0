"""Trees of a local git repository as source tables.

The driver lists a tree; executors read blobs through ``git cat-file`` and check their object hashes.  The repository
must lie where executors can read it.
"""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..errors import EvidenceError
from .workspace import SOURCE_BYTES

_TREE = "path string, mode string, blob string, size long"


def _git(repo: str, *args: str) -> bytes:
    try:
        return subprocess.run(["git", "-c", "core.quotePath=false", "-C", repo, *args], check=True, capture_output=True, timeout=60).stdout
    except FileNotFoundError:
        raise EvidenceError("git is not installed", "E_GIT") from None
    except subprocess.CalledProcessError as e:
        raise EvidenceError(f"git failed: {e.stderr.decode(errors='replace').strip()}", "E_GIT") from None


def commit_of(repo: str, revision: str) -> str:
    if revision.startswith("-"):
        raise EvidenceError("a revision does not begin with a dash", "E_GIT_REVISION")
    return _git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


def list_tree(repo: str, revision: str = "HEAD") -> list[tuple]:
    """(path, mode, blob, size) of the regular files of a commit; symbolic links and submodules have no text."""
    out = []
    for entry in _git(repo, "ls-tree", "-r", "-z", "-l", commit_of(repo, revision)).split(b"\0"):
        if entry:
            meta, path = entry.split(b"\t", 1)
            mode, kind, blob, size = meta.decode().split()
            if kind == "blob" and mode != "120000":
                out.append((path.decode(errors="replace"), mode, blob, int(size)))
    return sorted(out)


def worktree_names(repo: str) -> list[str]:
    """Tracked and new files of the work tree that are not ignored."""
    names = _git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split(b"\0")
    return sorted({n.decode(errors="replace") for n in names if n})


def read_tree(spark: SparkSession, repo: str, revision: str = "HEAD", source_bytes: int = SOURCE_BYTES) -> DataFrame:
    """``path, mode, blob, size, text`` of a commit; text is null for binary, large or malformed blobs."""
    tree = spark.createDataFrame(list_tree(repo, revision), _TREE)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            wanted = part["blob"].where(part["size"] <= source_bytes)
            some = list(dict.fromkeys(wanted.dropna()))
            done = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="".join(b + "\n" for b in some).encode(), capture_output=True, check=True, timeout=300)
            texts, at, data = {}, 0, done.stdout
            for blob in some:
                end = data.index(b"\n", at)
                size = int(data[at:end].split()[2])
                body = data[end + 1 : end + 1 + size]
                at = end + 2 + size
                if len(blob) == 40 and hashlib.sha1(b"blob %d\0" % size + body).hexdigest() != blob:
                    raise ValueError(f"blob {blob} does not have its hash")
                try:
                    texts[blob] = None if b"\0" in body else body.decode()
                except UnicodeDecodeError:
                    texts[blob] = None
            yield part.assign(text=[texts.get(b) for b in wanted])

    return tree.mapInPandas(read, _TREE + ", text string")
