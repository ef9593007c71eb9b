import pytest

from tidemark.errors import StoreError
from tidemark.plans.mq import MessageQueue
from tidemark.plans.store import Store

MS = 1_000_000


@pytest.fixture
def mq(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        yield MessageQueue(s, "jobs", lease_ns=300 * MS, ttl_ns=0, max_deliveries=3)


def test_fifo_ack_and_no_commit_when_empty(mq):
    assert mq.send_many([b"body:%03d" % i for i in range(20)]) == list(range(1, 21))
    assert mq.peek().seq == 1
    got = mq.receive(5, now_ns=10)
    assert [m.seq for m in got] == [1, 2, 3, 4, 5] and got[0].body == b"body:000" and len({m.receipt.token for m in got}) == 5
    assert mq.ack([m.receipt for m in got]) == 5
    assert mq.counts() == {"ready": 15, "leased": 0, "dead": 0}
    assert mq.ack([got[0].receipt]) == 0  # stale
    rest = mq.receive(100, now_ns=20)
    mq.ack([m.receipt for m in rest])
    before = mq.store.version
    assert mq.receive(1) == [] and mq.store.version == before


def test_redelivery_and_death(mq):
    mq.send_many([b"x", b"y"])
    for n in (1, 2, 3):
        m = mq.receive(1, now_ns=n)[0]
        assert (m.seq, m.deliveries) == (1, n)
        mq.nack([m.receipt])
    assert [m.seq for m in mq.receive(1, now_ns=9)] == [2]
    assert [(r.seq, r.dead_reason) for r in mq.dead_letters().collect()] == [(1, "too many deliveries")]
    assert mq.purge() == 1 and mq.counts()["dead"] == 0


def test_ttl_lease_and_reject(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    mq = MessageQueue(s, "ttl", lease_ns=300 * MS, ttl_ns=300 * MS)
    mq.send_many([b"old"], now_ns=0)
    mq.send_many([b"new"], now_ns=200 * MS)
    got = mq.receive(1, now_ns=400 * MS)
    assert [m.seq for m in got] == [2] and [r.dead_reason for r in mq.dead_letters().collect()] == ["expired"]
    assert mq.sweep(now_ns=600 * MS) == 0 and mq.sweep(now_ns=700 * MS) == 1
    again = mq.receive(1, now_ns=300 * MS)[0]
    assert again.deliveries == 2 and again.receipt.token != got[0].receipt.token
    mq.nack([again.receipt], dead=True)
    assert sorted(r.dead_reason for r in mq.dead_letters().collect()) == ["expired", "rejected"]


def test_ack_shares_a_transaction(mq):
    mq.send_many([b"x"])
    m = mq.receive(1)[0]
    with mq.store.write() as t:
        t.put(b"result", b"done")
        mq.ack([m.receipt], t)
    assert mq.store.snapshot().get(b"result") == b"done" and mq.counts()["leased"] == 0
    with pytest.raises(StoreError, match="BadTransaction"), mq.store.write() as t:
        t.put(b"result", b"twice")
        mq.ack([m.receipt], t)
    assert mq.store.snapshot().get(b"result") == b"done"


def test_wait_and_options(mq):
    assert mq.wait(0.05) == []
    for bad in ({"name": "a/b"}, {"name": ""}, {"name": "q", "lease_ns": 0}, {"name": "q", "max_deliveries": 0}):
        with pytest.raises(StoreError, match="InvalidArgument"):
            MessageQueue(mq.store, **bad)


def test_large_bodies_go_to_the_archive(spark, tmp_path):
    from tidemark.sources.blobs import BlobStorage

    store = Store.open(spark, str(tmp_path / "s"))
    blobs = BlobStorage(store, str(tmp_path / "a.tar"))
    mq = MessageQueue(store, "big", blobs=blobs, blob_threshold=100)
    mq.send_many([b"small", b"x" * 500])
    got = mq.receive(2)
    assert [m.body for m in got] == [b"small", b"x" * 500] and blobs.index().count() == 1


def test_tokens_are_not_given_twice_after_an_abort(mq):
    mq.send_many([b"x"])
    with pytest.raises(ZeroDivisionError), mq.store.write() as t:
        lost = mq.receive(1, t)[0]
        1 / 0
    again = mq.receive(1)[0]
    assert again.receipt.token > lost.receipt.token
    assert mq.ack([lost.receipt]) == 0 and mq.counts()["leased"] == 1  # the dropped delivery settles nothing
    assert mq.ack([again.receipt]) == 1


def test_receipts_are_of_one_queue(mq):
    other = MessageQueue(mq.store, "other")
    mq.send_many([b"x"]), other.send_many([b"y"])
    mine, foreign = mq.receive(1)[0].receipt, other.receive(1)[0].receipt
    assert (mine.seq, mine.token) == (foreign.seq, foreign.token)
    for call in (lambda: mq.ack([foreign]), lambda: mq.nack([foreign])):
        with pytest.raises(StoreError, match="BadTransaction"):
            call()
    assert mq.counts()["leased"] == 1 and MessageQueue(mq.store, "jobs").ack([mine]) == 1


def test_nothing_stays_pinned(mq):
    mq.send_many([b"x", b"y"])
    mq.peek(), mq.counts(), mq.dead_letters().count(), mq.wait(0.01), mq.sweep(), mq.purge()
    assert mq.store.pins() == {}


def test_writer_shares_commits(mq):
    from tidemark.plans.mq import QueueWriter

    w = QueueWriter(mq, most=16, linger=0.3, max_bytes=100)
    before = mq.store.version
    numbers = [w.submit(b"m%02d" % i) for i in range(16)]
    assert sorted(n.result(60) for n in numbers) == list(range(1, 17)) and mq.store.version == before + 1
    with pytest.raises(StoreError, match="Busy"):
        w.submit(b"x" * 101)
    last = w.submit(b"end")
    w.close()
    assert last.result(0) == 17
    with pytest.raises(StoreError, match="BadTransaction"):
        w.submit(b"late")
