"""Datagrams that outlive their receiver: tasks listen, one socket each, and spool what comes to the shared folder; streams read the spool.

A spool file appears under its name when it is whole, and never changes. A stream over the spool therefore has offsets that can be
read again after any failure, and no datagram passes through the driver.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP = "_stop"


class Receiver:
    """Listens on ports, a task each, until stop(). A task that is lost is begun anew by Spark on another executor; what it had not yet
    spooled, `flush_s` seconds at most, is lost, as datagrams are. The tasks hold their cores while they listen.

    Files hold a line (port, number within its task's run, text) a datagram, as JSON; line breaks in a datagram are kept.
    """

    def __init__(self, spark: SparkSession, ports: list[int], folder: str, host: str = "0.0.0.0", flush_s: float = 0.5, most: int = 10_000):
        self.spark, self.ports, self.folder, self.host, self.flush_s, self.most = spark, ports, folder.rstrip("/"), host, flush_s, most
        self.thread = threading.Thread(target=self._listen, daemon=True)

    def start(self) -> Receiver:
        self._files().mkdir(self.folder, recursive=True)
        self.thread.start()
        return self

    def stop(self, wait_s: float = 30.0) -> None:
        """Tasks spool what they have and end."""
        files = self._files()
        files.touch(f"{self.folder}/{STOP}")
        self.thread.join(wait_s)

    def _files(self) -> _Store:
        return _Store(self.folder)

    def _listen(self) -> None:
        folder, host, flush_s, most = self.folder, self.host, self.flush_s, self.most

        def listen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import json
            import socket

            files = _Store(folder)
            for port in [int(p) for pdf in batches for p in pdf["port"]]:
                run, number, lines, stop = uuid.uuid4().hex, 0, [], False
                with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
                    s.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
                    s.bind((host, port))
                    s.settimeout(flush_s / 4)
                    flushed = time.monotonic()
                    while not stop:
                        try:
                            data = s.recv(65_535)
                            lines.append(json.dumps({"port": port, "packet": number, "value": data.decode("utf-8", "replace")}))
                            number += 1
                        except TimeoutError:
                            pass
                        if len(lines) >= most or time.monotonic() - flushed > flush_s:
                            stop = files.exists(f"{folder}/{STOP}")
                            if lines:
                                files.put(f"{folder}/{port}-{time.time_ns():020d}-{run}.json", "\n".join(lines) + "\n")
                                lines = []
                            flushed = time.monotonic()
                yield pd.DataFrame({"port": [port], "packets": [number]})

        rows = self.spark.createDataFrame([(p,) for p in self.ports], "port int").repartitionByRange(len(self.ports), "port")
        rows.mapInPandas(listen, "port int, packets long").write.format("noop").mode("overwrite").save()


class _Store:
    """The few operations on files that the spool needs, for any file system that Arrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.uri = folder

    def _at(self, path: str) -> str:
        return self.base + path[len(self.uri) :]

    def mkdir(self, path: str, recursive: bool) -> None:
        self.fs.create_dir(self._at(path), recursive=recursive)

    def touch(self, path: str) -> None:
        with self.fs.open_output_stream(self._at(path)):
            pass

    def exists(self, path: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(self._at(path)).type != fs.FileType.NotFound

    def put(self, path: str, text: str) -> None:
        """Write under a name that readers pass over, then give it its own."""
        at = self._at(path)
        head, _, name = at.rpartition("/")
        with self.fs.open_output_stream(f"{head}/_{name}") as f:
            f.write(text.encode())
        self.fs.move(f"{head}/_{name}", at)


def packets(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """The stream of a spool: (port, packet, value, file). The same files always make the same batches again."""
    stream = spark.readStream.schema("port int, packet long, value string").option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", "*.json").json(folder)
    return stream.withColumn("file", F.col("_metadata.file_name"))
