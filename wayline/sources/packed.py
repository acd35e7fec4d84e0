"""A cropped road graph as compact bytes, for search on a device.

Little-endian: origin (two float64), number of nodes (uint32), east and north of each node (float32), number of edges (uint32), and each edge's
nodes (uint32) and cost (float32). Tasks pack stretches of nodes and edges; a sink writes each stretch to a file whose name tells its place,
so the files in order of name are the export.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STRETCH = 1 << 16
EDGE = np.dtype([("a", "<u4"), ("b", "<u4"), ("cost", "<f4")])


def pack(nodes: DataFrame, edges: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """(place, bytes): stretches of the export, in order of place. nodes: (idx from 0 without gaps, x, y); edges: (a, b, cost) by those numbers."""

    def of_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame([(1 + int(pdf["idx"].iloc[0]) // STRETCH, pdf[["x", "y"]].to_numpy("<f4").tobytes())], columns=["place", "bytes"])

    def of_edges(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b", "cost"])
        out = np.zeros(len(pdf), EDGE)
        for c in EDGE.names:
            out[c] = pdf[c].to_numpy()
        return pd.DataFrame([((1 << 41) + int(pdf["a"].iloc[0]) // STRETCH, out.tobytes())], columns=["place", "bytes"])

    n, e = nodes.count(), edges.count()
    if max(n, e) >= 1 << 32:
        raise ValueError("the format counts up to 2^32 nodes and edges")
    spark = nodes.sparkSession
    heads = spark.createDataFrame([(0, bytearray(struct.pack("<ddI", lat0, lon0, n))), (1 << 40, bytearray(struct.pack("<I", e)))], "place long, bytes binary")
    body = nodes.groupBy(F.floor(F.col("idx") / STRETCH)).applyInPandas(lambda pdf: of_nodes(pdf), "place long, bytes binary")
    return heads.unionByName(body).unionByName(edges.groupBy(F.floor(F.col("a") / STRETCH)).applyInPandas(lambda pdf: of_edges(pdf), "place long, bytes binary"))


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        done = []
        for r in rows:  # a file under a name of its own until all tasks have ended: attempts that are lost leave nothing that counts
            name = f"_{self.run}-{uuid.uuid4().hex}"
            with open(f"{self.folder}/{name}", "wb") as f:
                f.write(r["bytes"])
            done.append((name, f"{r['place']:016d}.bin"))
        m = WriterCommitMessage()
        m.files = done
        return m

    def commit(self, messages: list) -> None:
        for m in messages:
            for name, last in m.files if m else []:
                os.replace(f"{self.folder}/{name}", f"{self.folder}/{last}")

    def abort(self, messages: list) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if name.startswith(f"_{self.run}"):
                os.remove(f"{self.folder}/{name}")


class PackedSink(DataSource):
    """Stretches (place, bytes) as files of a folder that all executors see under one path."""

    @classmethod
    def name(cls) -> str:
        return "packed"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].removeprefix("file://"))


def save_packed(stretches: DataFrame, folder: str) -> None:
    stretches.sparkSession.dataSource.register(PackedSink)
    stretches.write.format("packed").mode("append").save(folder)


def load_packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (idx, x, y), edges (a, b, cost)) of the files that save_packed() wrote."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    files = files.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("place"), "content")

    def of_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for place, data in zip(pdf["place"], pdf["content"]):
                xy = np.frombuffer(data, "<f4").reshape(-1, 2).astype(float)
                yield pd.DataFrame({"idx": (place - 1) * STRETCH + np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1]})

    def of_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                e = np.frombuffer(data, EDGE)
                yield pd.DataFrame({"a": e["a"].astype(np.int64), "b": e["b"].astype(np.int64), "cost": e["cost"].astype(float)})

    return files.where(f"place > 0 and place < {1 << 40}").mapInPandas(of_nodes, "idx long, x double, y double"), files.where(f"place > {1 << 40}").mapInPandas(of_edges, "a long, b long, cost double")
