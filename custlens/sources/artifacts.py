"""Artifacts: named results that sessions share, each built once.

An artifact lies in a folder named by what it depends on.  Whoever needs a missing one takes its lease
(a file, renewed while its owner lives; a lease that is not renewed for ``STALE_SECONDS`` is free again),
builds it in a folder of its own, and publishes it by renaming a pointer file into place; others wait
and read it.  A session that is ended leaves its published artifacts, and what a builder keeps in
``progress``, to the next one.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession

RENEW_SECONDS = 5
STALE_SECONDS = 30
POLL_SECONDS = 0.3


class Artifacts:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def folder(self, name: str, key: object) -> str:
        digest = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:16]
        return f"{self.base}/{name}-{digest}"

    def find(self, folder: str) -> str | None:
        """Where the published copy lies."""
        text = self._text(f"{folder}/current")
        return f"{folder}/{text.strip()}" if text else None

    def get(self, name: str, key: object, build: Callable[[str], None]) -> str:
        """The artifact's path; ``build(path)`` writes it if nobody has."""
        folder = self.folder(name, key)
        while True:
            found = self.find(folder)
            if found:
                return found
            with self._lease(folder) as mine:
                if mine:
                    found = self.find(folder)
                    if not found:
                        attempt = f"attempt-{uuid.uuid4().hex[:12]}"
                        build(f"{folder}/{attempt}")
                        self._place(f"{folder}/current", attempt)
                    continue
            time.sleep(POLL_SECONDS)

    def all_of(self, wanted: dict[str, object], group: str, build: Callable[[Callable[[str, Callable[[str], None]], None]], None]) -> dict[str, str]:
        """Several artifacts that one job builds: ``build(publish)`` calls ``publish(name, write)`` for each.

        If all are there, nothing is built; the lease is that of the group."""
        folders = {n: self.folder(n, k) for n, k in wanted.items()}

        def publish(name, write):
            if not self.find(folders[name]):
                attempt = f"attempt-{uuid.uuid4().hex[:12]}"
                write(f"{folders[name]}/{attempt}")
                self._place(f"{folders[name]}/current", attempt)

        while True:
            found = {n: self.find(f) for n, f in folders.items()}
            if all(found.values()):
                return found
            with self._lease(self.folder(group, wanted)) as mine:
                if mine:
                    if not all(self.find(f) for f in folders.values()):
                        build(publish)
                    continue
            time.sleep(POLL_SECONDS)

    # a builder's own notes: the latest one counts

    def keep(self, folder: str, n: int, value: object) -> None:
        self._place(f"{folder}/progress-{n:06d}", json.dumps(value))

    def kept(self, folder: str):
        fs, path = self._fs(folder)
        if not fs.exists(path):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(path))
        names = [n for n in names if n.startswith("progress-")]
        return json.loads(self._text(f"{folder}/{names[-1]}")) if names else None

    # files

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except TypeError:   # a Hadoop without shaded commons-io
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, path: str, text: str, overwrite: bool = True) -> bool:
        fs, p = self._fs(path)
        try:
            out = fs.create(p, overwrite)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _place(self, path: str, text: str) -> None:
        """Written aside and renamed, so that readers see the whole text or nothing."""
        aside = f"{path}.{uuid.uuid4().hex[:8]}"
        self._write(aside, text)
        fs, p = self._fs(path)
        if not fs.rename(self._fs(aside)[1], p):   # somebody was first; both are whole
            fs.delete(self._fs(aside)[1], False)

    @contextmanager
    def _lease(self, folder: str):
        path = f"{folder}/lease"
        fs, p = self._fs(path)
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > STALE_SECONDS:
            fs.delete(p, False)
        if not self._write(path, uuid.uuid4().hex, overwrite=False):
            yield False
            return
        over = threading.Event()

        def renew():
            while not over.wait(RENEW_SECONDS):
                fs.setTimes(p, int(time.time() * 1000), -1)

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield True
        finally:
            over.set()
            thread.join()
            fs.delete(p, False)
