"""Storage behind a small interface: folders of this machine, and file systems that Spark's JVM reaches."""

from __future__ import annotations

import io
import os
import uuid
from abc import ABC, abstractmethod
from typing import BinaryIO

from pyspark.sql import SparkSession

from siltstone.session import local_path
from siltstone.table.errors import AmbiguousCommitError, CommitConflict


class Storage(ABC):
    """Files below one root; paths are relative to it, and none leads outside (``ValueError``)."""

    @abstractmethod
    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        """A file's bytes, or ``length`` of them from ``offset``; ``FileNotFoundError`` if there is no such file."""

    @abstractmethod
    def write(self, path: str, content: bytes, sync: bool = True) -> None:
        """Write or replace a file, all or nothing; with ``sync`` it is on disk afterwards."""

    @abstractmethod
    def create(self, path: str, content: bytes) -> None:
        """Write a file that must not exist; :class:`CommitConflict` if it does, :class:`AmbiguousCommitError` if it can't be told who wrote it."""

    @abstractmethod
    def names(self, path: str = "") -> list[str]:
        """The names of the files of a folder; a folder that does not exist has none."""

    @abstractmethod
    def folders(self, path: str = "") -> list[str]:
        """The names of the folders in a folder; none if it does not exist."""

    @abstractmethod
    def list(self, path: str = "") -> list[str]:
        """The paths of all files below a folder; a folder that does not exist has none."""

    @abstractmethod
    def delete(self, path: str) -> bool:
        """Remove a file, or a folder with all below it; False if it wasn't there."""

    @abstractmethod
    def move(self, path: str, to: str) -> None:
        """Give a file another name, replacing what has it."""

    @abstractmethod
    def info(self, path: str) -> tuple[int, float] | None:
        """Size and time of last change of a file; None if there is no such file."""

    @abstractmethod
    def uri(self, path: str = "") -> str:
        """The path as Spark takes it."""

    def open(self, path: str) -> BinaryIO:
        """A seekable reader that fetches only the ranges that are read."""
        return io.BufferedReader(_Ranged(self, path))

    def exists(self, path: str) -> bool:
        return self.info(path) is not None

    def drop_empty(self, path: str, keep: set[str]) -> None:
        """Remove empty folders below a folder, where there are such things, but those in ``keep``."""


class _Ranged(io.RawIOBase):
    """A file of a storage, read range by range."""

    def __init__(self, storage: Storage, path: str):
        found = storage.info(path)
        if found is None:
            raise FileNotFoundError(path)
        self.storage, self.path, self.size, self.at = storage, path, found[0], 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, target) -> int:
        n = max(0, min(len(target), self.size - self.at))
        if n:
            target[:n] = self.storage.read(self.path, self.at, n)
            self.at += n
        return n


def safe_join(root: str, relative: str) -> str:
    """The place of a relative path below ``root``; ``ValueError`` if it would be outside, links followed."""
    return _inside(os.path.realpath(local_path(root)), relative)


def _inside(base: str, relative: str) -> str:
    full = os.path.realpath(os.path.join(base, relative.lstrip("/")))
    if full != base and not full.startswith(base.rstrip("/") + "/"):
        raise ValueError(f"path traversal: {relative!r} is outside the table")
    return full


class LocalStorage(Storage):
    """A folder of this machine or of a mounted file system with hard links."""

    def __init__(self, root: str):
        self.root = os.path.abspath(local_path(root))
        self._base = os.path.realpath(self.root)

    def _at(self, path: str) -> str:
        return _inside(self._base, path)

    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        with open(self._at(path), "rb") as f:
            f.seek(offset)
            return f.read(-1 if length is None else length)

    def open(self, path: str) -> BinaryIO:
        return open(self._at(path), "rb")

    def _temporary(self, path: str, content: bytes, sync: bool = True) -> tuple[str, str]:
        final = self._at(path)
        temporary = os.path.join(os.path.dirname(final), f".{uuid.uuid4().hex}.tmp")
        try:
            f = open(temporary, "wb")
        except FileNotFoundError:
            os.makedirs(os.path.dirname(final), exist_ok=True)
            f = open(temporary, "wb")
        with f:
            f.write(content)
            if sync:
                f.flush()
                os.fsync(f.fileno())
        return final, temporary

    def write(self, path: str, content: bytes, sync: bool = True) -> None:
        final, temporary = self._temporary(path, content, sync)
        os.replace(temporary, final)

    def create(self, path: str, content: bytes) -> None:
        """The content is synced under another name and linked to its own: the link fails if that is taken, and nothing torn is ever seen."""
        final, temporary = self._temporary(path, content)
        try:
            os.link(temporary, final)
        except FileExistsError:
            raise CommitConflict(f"{path} exists") from None
        except OSError as e:
            if os.path.exists(final) and os.path.samefile(temporary, final):
                raise AmbiguousCommitError(f"{path}: {e}") from e
            raise
        finally:
            if os.path.exists(temporary):
                os.unlink(temporary)
        try:
            handle = os.open(os.path.dirname(final), os.O_RDONLY)
            os.fsync(handle)
            os.close(handle)
        except OSError:
            pass  # published already; a failing sync must not undo it

    def names(self, path: str = "") -> list[str]:
        try:
            return [e.name for e in os.scandir(self._at(path)) if e.is_file()]
        except FileNotFoundError:
            return []

    def folders(self, path: str = "") -> list[str]:
        try:
            return [e.name for e in os.scandir(self._at(path)) if e.is_dir()]
        except FileNotFoundError:
            return []

    def list(self, path: str = "") -> list[str]:
        return sorted(os.path.relpath(os.path.join(at, n), self._base) for at, _, names in os.walk(self._at(path)) for n in names)

    def delete(self, path: str) -> bool:
        at = self._at(path)
        if os.path.isdir(at):
            for name in os.listdir(at):
                self.delete(os.path.join(path, name))
            os.rmdir(at)
            return True
        try:
            os.unlink(at)
        except FileNotFoundError:
            return False
        return True

    def move(self, path: str, to: str) -> None:
        os.replace(self._at(path), self._at(to))

    def drop_empty(self, path: str, keep: set[str]) -> None:
        for at, folders, names in os.walk(self._at(path), topdown=False):
            if not folders and not names and os.path.relpath(at, self._base) not in {path, *keep}:
                try:
                    os.rmdir(at)
                except OSError:
                    pass

    def info(self, path: str) -> tuple[int, float] | None:
        at = self._at(path)
        return (os.path.getsize(at), os.path.getmtime(at)) if os.path.isfile(at) else None

    def uri(self, path: str = "") -> str:
        return f"file://{self._at(path)}"


class HadoopStorage(Storage):
    """What the Hadoop file systems of Spark's JVM reach, from the driver.

    New files are written under another name and renamed. Schemes whose rename fails atomically if the name is taken can hold
    commits (:data:`EXCLUSIVE_RENAME`); on others, object stores among them, :meth:`create` raises ``NotImplementedError``.
    """

    #: Schemes whose rename never replaces a file. ``file`` is there for trials on one machine by one writer.
    EXCLUSIVE_RENAME = ("hdfs", "viewfs", "abfs", "abfss", "file")

    def __init__(self, spark: SparkSession, uri: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = uri.rstrip("/")
        top = self._path(self.root)
        self._fs = top.getFileSystem(conf)  # raises for a scheme nothing is known of
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(top.toUri(), conf) if self.scheme in self.EXCLUSIVE_RENAME else None
        self._base = self._fs.makeQualified(top).toUri().getPath()

    @property
    def scheme(self) -> str:
        return self.root.split(":", 1)[0]

    def _at(self, path: str):
        parts = [p for p in path.split("/") if p]
        if ".." in parts:
            raise ValueError(f"path traversal: {path!r}")
        return self._path("/".join([self.root, *parts]))

    def read(self, path: str, offset: int = 0, length: int | None = None) -> bytes:
        found = self.info(path)
        if found is None:
            raise FileNotFoundError(path)
        n = max(0, min(found[0] - offset, found[0] if length is None else length))
        if not n:
            return b""
        stream = self._fs.open(self._at(path))
        try:
            stream.seek(offset)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def _temporary(self, path: str, content: bytes):
        final = self._at(path)
        self._fs.mkdirs(final.getParent())
        temporary = self._path(final.getParent(), f".{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, True)
        stream.write(bytearray(content))
        if hasattr(stream, "hsync"):
            stream.hsync()
        stream.close()
        return final, temporary

    def write(self, path: str, content: bytes, sync: bool = True) -> None:
        final, temporary = self._temporary(path, content)
        self._replace(temporary, final)

    def _replace(self, one, final) -> None:
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(one, final):
            raise OSError(f"could not rename {one}")

    def move(self, path: str, to: str) -> None:
        self._replace(self._at(path), self._at(to))

    def create(self, path: str, content: bytes) -> None:
        if self._files is None:
            raise NotImplementedError(f"{self.scheme} has no exclusive rename; keep tables and state where files can be created exclusively")
        final, temporary = self._temporary(path, content)
        kinds = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self._jvm.java.lang.reflect.Array.newInstance(kinds, 0)
        try:
            self._files.rename(temporary, final, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"{path} exists") from None
            if not self._fs.exists(temporary):
                raise AmbiguousCommitError(f"{path}: {e}") from e
            raise
        finally:
            self._fs.delete(temporary, False)

    def _statuses(self, path: str) -> list:
        try:
            return list(self._fs.listStatus(self._at(path)))
        except Exception as e:
            if "FileNotFound" in str(e):
                return []
            raise

    def names(self, path: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._statuses(path) if s.isFile()]

    def folders(self, path: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._statuses(path) if not s.isFile()]

    def list(self, path: str = "") -> list[str]:
        out, folders = [], [path]
        while folders:
            for s in self._statuses(folders.pop()):
                below = s.getPath().toUri().getPath()[len(self._base.rstrip("/")) + 1 :]
                (out if s.isFile() else folders).append(below)
        return sorted(out)

    def delete(self, path: str) -> bool:
        return self._fs.delete(self._at(path), True)

    def info(self, path: str) -> tuple[int, float] | None:
        at = self._at(path)
        if not self._fs.exists(at):
            return None
        s = self._fs.getFileStatus(at)
        return (s.getLen(), s.getModificationTime() / 1000) if s.isFile() else None

    def uri(self, path: str = "") -> str:
        return "/".join([self.root, *[p for p in path.split("/") if p]])


def open_storage(uri: str, spark: SparkSession | None = None) -> Storage:
    """Storage by the URI's scheme: none or ``file`` is local, others go through the JVM of ``spark`` (``ValueError`` without one)."""
    uri = str(uri)
    if uri.startswith("file:") or "://" not in uri:
        return LocalStorage(uri)
    if spark is None:
        raise ValueError(f"{uri} can be reached through a Spark session only")
    return HadoopStorage(spark, uri)
