from tidemark.cli import run
from tidemark.functions.text import human_bytes, show
from tidemark.plans.store import Store


def test_commands(spark, tmp_path, capsys):
    path, dst = str(tmp_path / "s"), str(tmp_path / "d")
    with Store.open(spark, path) as s:
        with s.write() as t:
            t.put_many([(b"user:%d" % i, b"\x00\x01") for i in range(5)])
            t.db("z"), t.db("a"), t.put(b"x", b"y", "a")
        with s.read() as r:
            s.copy_snapshot(r, str(tmp_path / "r"))
    assert run(spark, ["dump", "-p", "user:", "-n", "2", path]) == 0
    assert capsys.readouterr().out.splitlines() == ["user:0 = 0001", "user:1 = 0001"]
    assert run(spark, ["dump", "-k", "--hex", "-d", "a", path]) == 0 and capsys.readouterr().out.strip() == b"x".hex()
    assert run(spark, ["list", path]) == 0 and capsys.readouterr().out.split() == ["a", "z"]
    assert run(spark, ["check", path]) == 0 and run(spark, ["stats", path]) == 0
    assert run(spark, ["compact", path, dst]) == 0 and run(spark, ["compact", path, dst]) == 2
    assert run(spark, ["ship", path, str(tmp_path / "r"), str(tmp_path / "b")]) == 3
    with Store.open(spark, path) as s, s.write() as t:
        t.put(b"new", b"1")
    assert run(spark, ["ship", path, str(tmp_path / "r"), str(tmp_path / "b")]) == 0
    assert run(spark, ["apply", str(tmp_path / "r"), str(tmp_path / "b")]) == 0
    assert run(spark, ["checkpoint", str(tmp_path / "r")]) == 0
    assert run(spark, ["nonsense"]) == 1 and run(spark, ["check", str(tmp_path / "none")]) == 2


def test_rendering():
    assert show(b"ab\\\n") == "ab\\x5c\\x0a" and show(bytes(range(8))) == "0001020304050607" and show(b"") == ""
    assert human_bytes(512) == "512 B" and human_bytes(1536) == "1.5 KiB"
