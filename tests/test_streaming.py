import time

import pytest

from tidemark.plans.mq import MessageQueue
from tidemark.plans.store import Store
from tidemark.sources.versions import VersionSource
from tidemark.streaming.leases import EVENTS, lease_stream, writer


def test_versions_stream(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    spark.dataSource.register(VersionSource)
    stream = spark.readStream.format("tidemark_versions").load(store.path)
    q = stream.writeStream.format("memory").queryName("versions").start()
    try:
        for i in range(2):
            with store.write() as t:
                t.put(b"k%d" % i, b"v")
            q.processAllAvailable()
        rows = spark.sql("select version, entries, get(wrote, 0).key as k from versions order by 1").collect()
        assert [(r.version, r.entries) for r in rows] == [(0, 0), (1, 1), (2, 2)] and bytes(rows[2].k) == b"k1"
    finally:
        q.stop()


def test_leases(spark, tmp_path):
    src = tmp_path / "events"
    write = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(src))
    far, soon = int(time.time() * 1000) + 3_600_000, int(time.time() * 1000) - 1000
    write([(1, "lease", 11, far), (2, "lease", 12, soon), (3, "lease", 13, far)])
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(str(src))
    stream = lease_stream(events).writeStream.format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "cp"))
    q = stream.trigger(processingTime="200 milliseconds").start()  # timers keep batches coming: wait for results, not for the end

    def until(wanted):
        end = time.time() + 60
        while time.time() < end and q.isActive:
            got = {(r.seq, r.outcome) for r in spark.sql("select * from leases").collect()}
            if wanted <= got:
                return True
            time.sleep(0.3)
        return False

    try:
        assert until({(2, "due")})
        write([(1, "ack", 11, 0), (3, "ack", 99, 0)])
        assert until({(1, "settled"), (3, "stale")})
        write([(3, "nack", 13, 0)])
        assert until({(3, "returned")})
    finally:
        q.stop()


@pytest.mark.parametrize("limit", [None, 1 << 20])
def test_stream_into_queue_once(spark, tmp_path, limit):
    mq = MessageQueue(Store.open(spark, str(tmp_path / "s")), "q")
    send = writer(mq, ["correlation_id"], limit)
    batch = spark.createDataFrame([(b"a", "1", None), (b"b", "2", None)], "body binary, correlation_id string, blob_key string")
    send(batch, 0), send(batch, 0)
    assert mq.counts()["ready"] == 2
