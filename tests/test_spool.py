"""Datagrams of several ports, spooled by tasks: a query that dies between a batch and its commit loses and repeats nothing."""

import json
import socket
import time

import pytest
from pyspark.sql import functions as F

from wayline.sources import spool, udp


def free_port():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def test_a_query_that_dies_before_its_commit(spark, tmp_path):
    ports, folder = [free_port(), free_port()], f"file://{tmp_path}/spool"
    receiver = spool.Receiver(spark, ports, folder, "127.0.0.1", flush_s=0.3).start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            deadline, seen = time.time() + 60, set()
            while time.time() < deadline and len(seen) < 2:  # until both listen
                for p in ports:
                    s.sendto(b'{"hello":1}', ("127.0.0.1", p))
                time.sleep(0.3)
                seen = {f.name.split("-")[0] for f in (tmp_path / "spool").glob("[0-9]*.json")}
            for k in range(60):
                body = {"timestamp": float(k), "ax": 1.0, "ay": 0.0, "az": 9.8, "gx": 0.0, "gy": 0.0, "gz": 0.5}
                s.sendto(json.dumps(body).encode() if k % 10 else b'{"timestamp":\n1', ("127.0.0.1", ports[k % 2]))
                time.sleep(0.02)
        time.sleep(1.5)
    finally:
        receiver.stop()
    assert not receiver.thread.is_alive() and not list((tmp_path / "spool").glob("_*.json"))
    done, fail = {}, {"at": 1}

    def put(batch, number):
        done[number] = sorted((r.port, r.timestamp) for r in batch.collect())  # a batch that runs again takes its own place
        if number == fail["at"]:
            raise RuntimeError("dies here")

    def run():
        rows = udp.samples(spool.packets(spark, folder, per_batch=1).select("port", "value"))
        q = rows.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="dies here"):
        run()
    first = dict(done)
    fail["at"] = -1
    run()
    assert done[1] == first[1] and len(done) > 2
    got = sorted(x for rows in done.values() for x in rows)
    assert got == sorted((ports[k % 2], float(k)) for k in range(60) if k % 10)
    assert spark.read.json(folder.replace("file://", "")).where(F.col("value").contains("\n")).count() == 6
