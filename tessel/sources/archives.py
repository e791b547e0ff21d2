"""Archives of source trees: members as rows, safe extraction, and the interface of a remote archive."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from io import BytesIO
from typing import Protocol
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessel.operators.scanning import enters, reads


class RemoteArchive(Protocol):
    """Where an archive of a repository can be fetched."""

    def check(self, owner: str, repo: str) -> None:
        """Raise if the repository cannot be read with the given credentials."""

    def fetch(self, owner: str, repo: str, ref: str | None, target: str) -> None:
        """Write the archive of ``ref``, or of the default branch, to ``target``."""


def _get(url: str, headers: dict[str, str]) -> tuple[int, bytes]:
    """Status and body of a web address."""
    try:
        with urlopen(Request(url, headers=headers), timeout=120) as answer:
            return answer.status, answer.read()
    except HTTPError as e:
        return e.code, e.read()


class HostedArchive:
    """Archives of repositories on a code host, by ``get(url, headers) -> (status, body)``.

    ``target`` of ``fetch`` is written by the driver and must lie where all executors see it.
    """

    def __init__(self, base: str, token: str | None = None, get: Callable[[str, dict[str, str]], tuple[int, bytes]] = _get):
        self.base, self.get = base.rstrip("/"), get
        self.headers = {"Authorization": f"Bearer {token}"} if token else {}

    def _asked(self, url: str) -> bytes:
        status, body = self.get(url, self.headers)
        if status in (401, 403, 404):
            raise PermissionError(f"no access ({status}): {url}")
        if not 200 <= status < 300:
            raise OSError(f"the host answered {status}: {url}")
        return body

    def check(self, owner: str, repo: str) -> None:
        self._asked(f"{self.base}/repos/{owner}/{repo}")

    def fetch(self, owner: str, repo: str, ref: str | None, target: str) -> None:
        body = self._asked(archive_url(self.base, owner, repo, ref))
        with open(target, "wb") as f:
            f.write(body)


def archive_url(base: str, owner: str, repo: str, ref: str | None = None) -> str:
    """Address of a repository's zip archive; without a ref, of the default branch."""
    return f"{base.rstrip('/')}/repos/{owner}/{repo}/zipball" + (f"/{ref}" if ref else "")


def members(data: bytes, include_dotfiles: bool = False) -> Iterator[tuple[str, bytes]]:
    """``(rel_path, content)`` of the files worth reading; a single top folder is taken off the paths.

    A member whose path leads out of the archive makes the whole archive unsafe.
    """
    with zipfile.ZipFile(BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        for i in infos:
            if i.filename.startswith("/") or ".." in i.filename.replace("\\", "/").split("/"):
                raise ValueError(f"unsafe path in archive: {i.filename}")
        tops = {i.filename.split("/", 1)[0] for i in infos}
        nested = len(tops) == 1 and all("/" in i.filename for i in infos)
        for i in infos:
            rel = i.filename.split("/", 1)[1] if nested else i.filename
            *folders, name = rel.split("/")
            if all(enters(f, include_dotfiles) for f in folders) and reads(name, i.file_size, include_dotfiles):
                yield rel, z.read(i)


def read_archives(spark: SparkSession, path: str, include_dotfiles: bool = False) -> DataFrame:
    """The files inside zip archives as ``(path, rel_path, length, content)``; one archive is one row of a narrow map.

    Nothing is unpacked to disk, so no folder has to be shared. ``path`` may be a file, a folder or a pattern.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for rel, content in members(data.as_py(), include_dotfiles):
                    cols = [[f"{source}/{rel}"], [rel], [len(content)], [content]]
                    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "rel_path", "length", "content"])

    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    return archives.mapInArrow(run, "path string, rel_path string, length bigint, content binary")


def extract(archive: str, staging: str) -> str:
    """Unzip into a fresh folder below ``staging`` and return its root; members that would leave it are refused.

    A fresh folder for each run keeps files of an earlier upload out. ``staging`` must be shared by whoever reads it.
    """
    target = tempfile.mkdtemp(prefix="tree-", dir=staging)
    real = os.path.realpath(target)
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():
            place = os.path.realpath(os.path.join(real, member))
            if os.path.commonpath([real, place]) != real:
                raise ValueError(f"unsafe path in archive: {member}")
        z.extractall(target)
    return collapse_root(target)


def collapse_root(folder: str) -> str:
    """The only entry of a folder if that is a folder, else the folder itself; one level."""
    entries = os.listdir(folder)
    inner = os.path.join(folder, entries[0]) if len(entries) == 1 else folder
    return inner if os.path.isdir(inner) else folder
