"""Samples sent as JSON datagrams: parsing, and a streaming source that listens on a port."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from .logs import SAMPLE


def samples(packets: DataFrame, column: str = "value") -> DataFrame:
    """packets with the fields of a sample in place of `column`; broken datagrams and those that lack a field are dropped."""
    names = [x.split()[0] for x in SAMPLE.split(", ")]
    d = packets.withColumn("__s", F.from_json(F.trim(column), SAMPLE))
    return d.select(*[c for c in packets.columns if c != column], *[F.col(f"__s.{n}").alias(n) for n in names]).dropna(subset=names)


class UdpJson(DataSource):
    """format("udp_json"): a row per datagram, (packet, value). Options host, port, and max_packets of a batch.

    Datagrams that were taken from the socket are kept until their batch is committed, so a batch can be run again.
    """

    @classmethod
    def name(cls) -> str:
        return "udp_json"

    def schema(self) -> str:
        return "packet long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self._most = int(options.get("max_packets", "10000"))
        self._kept: dict[int, str] = {}
        self._address = options.get("host", "127.0.0.1"), int(options["port"])
        self._socket: socket.socket | None = None  # bound when a batch first asks: planning makes readers too

    def initialOffset(self) -> dict:
        return {"packet": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        at = start["packet"]
        if self._socket is None:
            self._socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self._socket.bind(self._address)
            self._socket.setblocking(False)
        while len(self._kept) < self._most:
            try:
                data = self._socket.recv(65_535)
            except BlockingIOError:
                break
            self._kept[at] = data.decode("utf-8", "replace")
            at += 1
        return self.readBetweenOffsets(start, {"packet": at}), {"packet": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(k, self._kept[k]) for k in range(start["packet"], end["packet"]) if k in self._kept])

    def commit(self, end: dict) -> None:
        for k in [k for k in self._kept if k < end["packet"]]:
            del self._kept[k]
