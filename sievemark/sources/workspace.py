"""A directory as a source table.

The driver lists metadata only; executors read contents by path, so the folder must be one they share.  Spark's own
file listing leaves out hidden files, which belong to a workspace.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvidenceError
from ..functions.paths import glob_regex

SOURCE_BYTES = 5 << 20
MAX_FILES = 50_000
# Folders that are never read unless they are the root itself, wherever they lie; then folders and files
# of the home folder, and folders of the system.
PROTECTED = (".ssh", ".gnupg", ".aws", ".azure", ".kube", ".docker", ".password-store")
PROTECTED_AT_HOME = (
    ".config/gcloud", ".config/gh", ".local/share/keyrings", ".netrc", ".npmrc", ".pypirc", ".git-credentials", ".mozilla/firefox",
    ".config/google-chrome", ".config/chromium", ".config/microsoft-edge", ".config/BraveSoftware/Brave-Browser",
)
PROTECTED_SYSTEM = ("/proc", "/sys", "/dev")
META = "path string, abs_path string, size long, mtime_ms double, ctime_ms double, inode long, device long, ignored boolean"


@dataclass
class Listing:
    rows: list[tuple]
    partial: bool = False
    reasons: list[str] = field(default_factory=list)


def protected(path: Path) -> bool:
    """Whether a path lies in a place of credentials or of the system."""
    places = [Path.home() / p for p in PROTECTED_AT_HOME] + [Path(p) for p in PROTECTED_SYSTEM]
    return bool(set(path.parts) & set(PROTECTED)) or any(path.is_relative_to(p) for p in places)


def admitted_root(root: str, cwd: str | None = None) -> Path:
    """The real path of a root; outside the working folder, system and credential folders are refused."""
    cwd_path, path = Path(cwd or os.getcwd()).resolve(), Path(root).resolve()
    if ".git" in path.parts:
        raise EvidenceError("the .git folder is not searched", "E_PATH_POLICY")
    if not path.is_relative_to(cwd_path) and protected(path):
        raise EvidenceError(f"{root} is protected", "E_PATH_POLICY")
    if not path.exists():
        raise EvidenceError(f"there is no {root}", "E_PATH_NOT_FOUND")
    return path


def _rules(folder: Path) -> list[tuple[str, bool, bool]]:
    """(regular expression over paths relative to the folder, folders only, re-included) of its ignore files."""
    import re

    out = []
    for name in (".gitignore", ".ignore"):
        f = folder / name
        if f.is_file():
            for line in f.read_text(errors="replace").splitlines():
                line = line.rstrip()
                if line and not line.startswith("#"):
                    body = line.lstrip("!")
                    pattern = glob_regex(body.rstrip("/")) if "/" not in body.rstrip("/") or body.startswith("/") else glob_regex("/" + body.rstrip("/"))
                    out.append((re.compile(pattern), body.endswith("/"), line.startswith("!")))
    return out


def list_workspace(root: str, cwd: str | None = None, max_files: int = MAX_FILES) -> Listing:
    """Metadata of all files below a root, sorted by path, with those that ignore files exclude marked."""
    base = admitted_root(root, cwd)
    out = Listing([])
    rules: list[tuple[str, list]] = []

    def ignored(relative: str, folder: bool) -> bool:
        state = False
        for prefix, some in rules:
            if relative.startswith(prefix):
                rest = relative[len(prefix) :]
                for pattern, only_folders, back in some:
                    hit = pattern.match(rest) is not None
                    if hit and only_folders and not folder and not any(pattern.match("/".join(rest.split("/")[:k])) for k in range(1, rest.count("/") + 1)):
                        hit = False
                    state = (not back) if hit else state
        return state

    def walk(folder: Path, prefix: str):
        rules.append((prefix, _rules(folder)))
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            out.partial = True
            out.reasons.append(f"{prefix or '.'} can't be read: {e.strerror}")
            return
        for e in entries:
            relative = prefix + e.name
            if e.name == ".git" or not e.name.isprintable():
                continue
            try:
                e.name.encode()
                if e.is_dir(follow_symlinks=False):
                    walk(Path(e.path), relative + "/")
                elif e.is_file(follow_symlinks=False):
                    if len(out.rows) >= max_files:
                        if not out.partial:
                            out.reasons.append(f"more than {max_files} files")
                        out.partial = True
                        return
                    s = e.stat(follow_symlinks=False)
                    out.rows.append((relative, e.path, s.st_size, s.st_mtime_ns / 1e6, s.st_ctime_ns / 1e6, s.st_ino, s.st_dev, ignored(relative, False)))
            except (OSError, UnicodeEncodeError) as error:
                out.partial = True
                out.reasons.append(f"{prefix}: {error}")

    if base.is_file():
        s = base.stat()
        out.rows.append((base.name, str(base), s.st_size, s.st_mtime_ns / 1e6, s.st_ctime_ns / 1e6, s.st_ino, s.st_dev, False))
    else:
        walk(base, "")
    out.rows.sort()
    return out


def read_workspace(spark: SparkSession, root: str, cwd: str | None = None, max_files: int = MAX_FILES, source_bytes: int = SOURCE_BYTES) -> tuple[DataFrame, Listing]:
    """``path, size, mtime_ms, ctime_ms, inode, device, ignored, status, reason, content_hash, text`` of a folder.

    A file is read between two looks at its metadata; one that changed meanwhile is unavailable.  Text is null where
    the content is binary, not UTF-8, too large or unreadable, and the reason says which.
    """
    listing = list_workspace(root, cwd, max_files)
    meta = spark.createDataFrame(listing.rows, META)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [_content(p, s, source_bytes) for p, s in zip(part["abs_path"], part["size"])]
            yield pd.concat([part.reset_index(drop=True), pd.DataFrame(rows, columns=["status", "reason", "content_hash", "text"])], axis=1)

    return meta.mapInPandas(read, META + ", status string, reason string, content_hash string, text string"), listing


def _content(path: str, size: int, source_bytes: int) -> tuple:
    try:
        if size > source_bytes:
            return "unavailable", f"larger than {source_bytes} bytes", None, None
        with open(path, "rb") as f:
            before = os.fstat(f.fileno())
            data = f.read(source_bytes + 1)
        after = os.stat(path)
    except OSError as e:
        return "unavailable", e.strerror, None, None
    if (before.st_size, before.st_mtime_ns, before.st_ino) != (after.st_size, after.st_mtime_ns, after.st_ino) or len(data) != after.st_size:
        return "unavailable", "changed while it was read", None, None
    digest = hashlib.sha256(data).hexdigest()
    if data.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "unavailable", "UTF-16", digest, None
    if b"\0" in data:
        return "binary", "has a NUL", digest, None
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return "unavailable", "not UTF-8", digest, None
    return ("admitted" if text.strip() else "empty"), None, digest, text


def same_revision(a: str = "a", b: str = "b"):
    """Whether two metadata structs are of one revision; an unknown change time matches any."""
    A, B = F.col(a), F.col(b)
    ctime = A["ctime_ms"].isNull() | B["ctime_ms"].isNull() | (A["ctime_ms"] == B["ctime_ms"])
    return (A["size"] == B["size"]) & (A["mtime_ms"] == B["mtime_ms"]) & ctime & A["inode"].eqNullSafe(B["inode"]) & A["device"].eqNullSafe(B["device"])
