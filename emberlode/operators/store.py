"""Versions of an index in a folder that driver and executors share.

Data goes into folders of new names that are never changed. A version is one small
JSON file that names the folders which count; it comes into being by a single atomic
step that fails if the number is taken. So a reader sees one version whole, a writer
that dies leaves folders that no version names, and of two writers one gets a Conflict.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the base version was read."""


#: What a version holds before the first.
EMPTY = {"version": 0, "files": None, "segments": [], "gone": [], "stats": {"docs": 0, "terms": 0}}


class Store:
    """An index folder: its versions, new folders, the writer's lock and the removal of old folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)
        self._made: list[str] = []

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def new(self, kind: str) -> str:
        """A name that no other folder has; discard() removes it unless a version names it by then."""
        self._made.append(f"{kind}-{uuid.uuid4().hex}")
        return self._made[-1]

    def discard(self) -> None:
        """Remove the new folders that no version names, in the end or when a build fails."""
        used = set().union(*[self.folders(self.read(v)) for v in self.versions()])
        for name in set(self._made) - used:
            self.delete(name)
        self._made = []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def _local(self) -> bool:
        return self._fs.getUri().getScheme() == "file"

    def _publish(self, name: str, data: bytes) -> bool:
        """Create a file with all of its content at once; False if there is one of that name."""
        target, temporary = self._path(name), f".{uuid.uuid4().hex}"
        self._fs.mkdirs(target.getParent())
        if self._local():  # a hard link is made or fails; a rename would replace
            into = target.toUri().getPath()
            made = os.path.join(os.path.dirname(into), temporary)
            with open(made, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(made, into)
            except FileExistsError:
                return False
            finally:
                os.unlink(made)
            return True
        made = self._jvm.org.apache.hadoop.fs.Path(target.getParent(), temporary)
        out = self._fs.create(made, True)
        out.write(bytearray(data))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(made, target, how)
        except Py4JJavaError as e:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self.exists("versions"):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def read(self, version: int | None = None) -> dict:
        """The newest version, or one of those kept; before the first, an empty one."""
        known = self.versions()
        if version is None and not known:
            return json.loads(json.dumps(EMPTY))
        return json.loads(self._read(f"versions/{known[-1] if version is None else version:012d}.json"))

    def commit(self, base: dict, **changes: object) -> dict:
        """The version after base, with changes; Conflict if there is one already."""
        made = base | changes | {"version": base["version"] + 1, "at_ms": int(time.time() * 1000)}
        if not self._publish(f"versions/{made['version']:012d}.json", json.dumps(made).encode()):
            raise Conflict(f"version {made['version']} of {self.root} is another writer's")
        return made

    @staticmethod
    def folders(version: dict) -> set[str]:
        return {x for x in [version["files"], *[s["name"] for s in version["segments"]], *[g["name"] for g in version["gone"]]] if x}

    def whole(self, version: dict) -> bool:
        """All that a version names is there."""
        return all(self.exists(x) for x in self.folders(version))

    def clean(self, keep: int = 2, orphan_s: float = 86400) -> list[str]:
        """Remove versions but the last keep, what they alone name, and old folders that none names; returns these.

        A folder without a version may be a living writer's, so it must be orphan_s old.
        """
        known = self.versions()
        old, kept = known[:-keep], known[-keep:]
        used = set().union(*[self.folders(self.read(v)) for v in kept]) if kept else set()
        gone = set().union(*[self.folders(self.read(v)) for v in old]) - used if old else set()
        for s in self._fs.listStatus(self._path("")) if self.exists("") else []:
            name = s.getPath().getName()
            if s.isDirectory() and re.fullmatch(r"[a-z]+-[0-9a-f]{32}", name) and name not in used and s.getModificationTime() < (time.time() - orphan_s) * 1000:
                gone.add(name)
        for name in sorted(gone):
            self.delete(name)
        for v in old:
            self.delete(f"versions/{v:012d}.json")
        return sorted(gone)

    @contextmanager
    def lock(self, tries: int = 5, wait: float = 0.1) -> Iterator[None]:
        """Held while one writer builds; taken over from a process of this machine that is dead."""
        mine = json.dumps({"id": uuid.uuid4().hex, "host": socket.gethostname(), "pid": os.getpid(), "at": time.time()}).encode()
        for i in range(tries):
            if self._publish("LOCK", mine):
                break
            if self._dead():
                self.delete("LOCK")
                continue
            time.sleep(wait * (i + 1))
        else:
            raise TimeoutError(f"{self.root} is held by another writer")
        try:
            yield
        finally:
            if self._owner() == mine:
                self.delete("LOCK")

    def _owner(self) -> bytes:
        try:
            return self._read("LOCK")
        except Py4JJavaError:
            return b""

    def _dead(self) -> bool:
        try:
            owner = json.loads(self._owner())
            if owner["host"] != socket.gethostname():
                return False
            os.kill(int(owner["pid"]), 0)
            return False
        except PermissionError:
            return False
        except (OSError, ValueError, KeyError):
            return True
