import tarfile

import pytest

from tidemark.errors import StoreError
from tidemark.functions.digest import streamed, xxh3_hex
from tidemark.plans.store import Store
from tidemark.sources import tar
from tidemark.sources.blobs import BlobStorage


def payload(seed):
    return bytes(97 + (seed * 7919 + i * 31) % 26 for i in range(seed * 37 % 1500))


@pytest.fixture
def blobs(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "s"))
    b = BlobStorage(store, str(tmp_path / "a.tar"))
    b.put_many([(b"k%03d" % i, f"{i:08d}.bin", payload(i)) for i in range(20)])
    return b


def test_golden_digests():
    # fixed values: XXH3-64 with seed 0
    assert xxh3_hex(b"") == "2d06800538d394c2"
    assert xxh3_hex(b"a") == "e6c632b61e964e1f"
    assert xxh3_hex(b"abc") == "78af5f94892f3950"
    assert f"{streamed([b'a', b'', b'bc']):016x}" == "78af5f94892f3950"


def test_put_find_erase_verify(blobs):
    assert blobs.get(b"k007") == payload(7)
    assert [None if x is None else x["size"] for x in blobs.find_many([b"k003", b"no", b"k001", b"k003"])] == [len(payload(3)), None, len(payload(1)), len(payload(3))]
    assert blobs.verify().where("not ok").count() == 0
    assert blobs.erase(b"k003") and not blobs.erase(b"k003") and not blobs.contains(b"k003")
    assert blobs.list().count() == 20  # the member stays
    assert blobs.for_each_key(lambda k: k != b"k004") == 4
    e = blobs.at(b"k005")
    with open(blobs.archive, "r+b") as f:
        f.seek(e["offset"])
        f.write(b"!")
    assert [bytes(r.key) for r in blobs.verify().where("not ok").collect()] == [b"k005"]


def test_other_tools_read_the_archive(blobs):
    blobs.finalize()
    with tarfile.open(blobs.archive) as t:
        assert [m.name for m in t] == [f"{i:08d}.bin" for i in range(20)]
        assert t.extractfile("00000009.bin").read() == payload(9)
    blobs.put(b"more", "more.bin", b"x")
    assert blobs.list().count() == 21


def test_catch_up_rebuild_and_repair(spark, blobs):
    end = blobs._end()
    with open(blobs.archive, "r+b") as f:
        f.seek(end)
        f.write(tar.header("late.bin", 3) + b"abc".ljust(512, b"\0") + b"torn tail")
    again = BlobStorage(blobs.store, blobs.archive)
    assert again.catch_up() == 1 and again.get(b"late.bin") == b"abc" and again.find(b"late.bin")["known"] is False
    again.put(b"x", "00000001.bin", b"newer")
    assert again.rebuild_index() == 21 and again.get(b"00000001.bin") == b"newer"
    assert again.rebuild_index(lambda names: names.str[:7].str.encode("utf-8")) == 3
    with open(blobs.archive, "r+b") as f:
        f.truncate(1024)
    with pytest.raises(StoreError, match="Corrupted"):
        BlobStorage(blobs.store, blobs.archive)


def test_source_and_distributed_writer(spark, tmp_path):
    df = spark.range(30).selectExpr("concat('m', id) as name", "cast(repeat('x', cast(id * 40 as int)) as binary) as payload").repartition(3)
    rows = tar.write_archives(df, str(tmp_path / "out")).collect()
    assert len(rows) == 30
    back = tar.members(spark, str(tmp_path / "out"))
    assert {(r.name, r.size, r.offset) for r in back.collect()} == {(r.name, r.size, r.offset) for r in rows}
    assert back.where("length(payload) <> size").count() == 0
    with pytest.raises(StoreError):
        tar.header("x" * 101, 1)
    damaged = bytearray(tar.header("a", 1))
    damaged[0] ^= 1
    assert tar.parse(bytes(damaged)) is None and tar.parse(bytes(512)) is None


def test_rebuild_is_one_commit_and_nothing_stays_pinned(blobs, monkeypatch):
    before = blobs.store.version
    assert blobs.rebuild_index() == 20 and blobs.store.version == before + 1

    def fails(*args, **more):
        raise RuntimeError

    monkeypatch.setattr(type(blobs.store), "publish", fails)
    with pytest.raises(RuntimeError):
        blobs.rebuild_index(lambda names: names.str[:1].str.encode("utf-8"))
    monkeypatch.undo()
    assert blobs.index().count() == 20  # a failure leaves the old index
    blobs.get(b"00000003.bin"), blobs.find_many([b"x"]), blobs.verify().count(), blobs.for_each_key(lambda k: True)
    assert blobs.store.pins() == {}


def test_large_archives_are_split_at_headers(spark, blobs):
    inner = tar.header("inside.bin", 3) + b"abc".ljust(512, b"\0")  # a payload that looks like a member
    blobs.put(b"tar", "nested.tar", inner)
    whole = tar.members(spark, blobs.archive)
    split = tar.members(spark, blobs.archive, split=2000)
    assert split.rdd.getNumPartitions() > 5 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(repr, split.collect())) == sorted(map(repr, whole.collect())) and split.where("name = 'inside.bin'").count() == 0
