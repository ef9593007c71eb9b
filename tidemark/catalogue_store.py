"""Queries that run through an open store: written, committed, reopened and read back, over whole tables.

Each query gets a folder of its own below the shared folder. What it returns is read from the store (or the queue,
archive or replica) after the operations, never restated from the tables.
"""

from __future__ import annotations

import contextlib
import io
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import catalogue as tables
from tidemark import cli
from tidemark.errors import StoreError
from tidemark.functions.order import REVERSE, U64, big_endian, composite, integer_of, little_endian, separator_of, text_part
from tidemark.functions.text import human
from tidemark.plans import inspect, replicate
from tidemark.plans.indexed import Indexed
from tidemark.plans.mq import MessageQueue
from tidemark.plans.optimistic import OptimisticTxn, commit_group, conflicts_of, optimistic
from tidemark.plans.store import Store
from tidemark.session import materialize, new_folder
from tidemark.sources import tar
from tidemark.sources.blobs import BlobStorage
from tidemark.streaming.leases import writer

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Rows of a file, so that stores of the small tables have several.
ROWS = 4000


def query(sql: str):
    def enter(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder = new_folder(spark, f.__name__).removeprefix("file://")
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), folder)

        Q[f.__name__], SQL[f.__name__] = run, sql
        return f

    return enter


def _key(n) -> bytes:
    return int(n).to_bytes(8, "big")


def _bytes(c):
    return F.encode(c.cast("string"), "UTF-8")


def _number(c):
    return F.conv(F.hex(c), 16, 10).cast("long")


def _read(df: DataFrame) -> DataFrame:
    """Entries with numbers as keys and text as values."""
    return df.select(_number("key").alias("k"), F.decode("value", "UTF-8").alias("v"))


def _entries(t, name: str, key: str, value) -> DataFrame:
    return t(name).select(F.col(key).alias("seq"), big_endian(F.col(key)).alias("key"), _bytes(value).alias("value"))


def _orders(t) -> DataFrame:
    return _entries(t, "orders", "o_orderkey", F.concat_ws("|", "o_custkey", "o_orderstatus"))


ORDERS = "SELECT o_orderkey AS k, concat(o_custkey, '|', o_orderstatus) AS v FROM orders"


def _loaded(spark, t, folder: str, **options) -> Store:
    store = Store.open(spark, f"{folder}/s", **({"rows_per_file": ROWS} | options))
    with store.write() as w:
        w.append(_orders(t))
    return store


def _upsert(rows: DataFrame, op: str = "upsert") -> DataFrame:
    return rows.withColumn("op", F.lit(op)).select("seq", "op", "key", "value")


def _new_status(t) -> DataFrame:
    """New values of the orders that are pending."""
    rows = t("orders").where("o_orderstatus = 'P'")
    return rows.select(F.col("o_orderkey").alias("seq"), big_endian(F.col("o_orderkey")).alias("key"), _bytes(F.lit("done")).alias("value"))


CHANGED = "SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'done' ELSE concat(o_custkey, '|', o_orderstatus) END AS v FROM orders"


# --- reading -----------------------------------------------------------------------------------------------------------
@query(ORDERS)
def store_scan(spark, t, folder):
    """Bulk load, close, open again, scan."""
    _loaded(spark, t, folder).close()
    with Store.open(spark, f"{folder}/s", create_if_missing=False) as store:
        return _read(store.snapshot().all())


@query(f"SELECT * FROM ({ORDERS}) WHERE k >= 100 AND k < 5000 UNION ALL SELECT * FROM ({ORDERS}) WHERE k >= 9000 UNION ALL SELECT * FROM ({ORDERS}) WHERE k < 70")
def store_ranges(spark, t, folder):
    s = _loaded(spark, t, folder).snapshot()
    return _read(s.between(_key(100), _key(5000)).union(s.from_(_key(9000))).union(s.upto(_key(70))))


@query(f"""WITH p AS (SELECT i::BIGINT AS pos, (i * 7919 % 30000)::BIGINT AS k FROM range(0, 200) AS r(i))
    SELECT p.pos, p.k, o.v, o.k IS NOT NULL AS found FROM p LEFT JOIN ({ORDERS}) o ON o.k = p.k""")
def store_find_many(spark, t, folder):
    """One batch of 200 keys; single look-ups agree with it."""
    s = _loaded(spark, t, folder).snapshot()
    keys = [i * 7919 % 30000 for i in range(200)]
    found = s.find_many([_key(k) for k in keys])
    assert [s.get(_key(k)) for k in keys[:3]] == found[:3] and s.contains(_key(keys[0])) == (found[0] is not None)
    return spark.createDataFrame([(i, k, None if v is None else v.decode(), v is not None) for i, (k, v) in enumerate(zip(keys, found))], "pos long, k long, v string, found boolean")


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders) SELECT * FROM (
    SELECT 'first' AS what, min(k) AS n FROM s UNION ALL SELECT 'last', max(k) FROM s UNION ALL SELECT 'seek', min(k) FROM s WHERE k >= 250
    UNION ALL SELECT 'skip', (SELECT k FROM s ORDER BY k LIMIT 1 OFFSET 777) UNION ALL SELECT 'count', count(*) FROM s
    UNION ALL SELECT 'rank', count(*) FROM s WHERE k < 600 UNION ALL SELECT 'range', count(*) FROM s WHERE k >= 250 AND k < 9000
    UNION ALL SELECT 'none', 0 UNION ALL SELECT 'open', count(*) FROM s WHERE k >= 300)""")
def store_positions(spark, t, folder):
    """Positions and counts, most of them from the manifest."""
    s = _loaded(spark, t, folder).snapshot()
    one = lambda what, df: df.select(F.lit(what).alias("what"), _number("key").alias("n"))
    rows = one("first", s.first()).union(one("last", s.last())).union(one("seek", s.seek(_key(250)))).union(one("skip", s.skip(777)))
    counted = [("count", s.count()), ("rank", s.rank(_key(600))), ("range", s.count_range(_key(250), _key(9000))), ("none", s.count_range(_key(9), _key(3))), ("open", s.count_range(_key(300), b""))]
    return rows.union(spark.createDataFrame(counted, "what string, n long"))


@query("SELECT c_name AS key, 'main' AS tree FROM customer WHERE starts_with(c_name, 'Customer#0000001') UNION ALL SELECT DISTINCT regexp_extract(url, '://([^/?#]+)', 1), 'hosts' FROM pages WHERE suffix(regexp_extract(url, '://([^/?#]+)', 1), '.example.com')")
def store_prefix(spark, t, folder):
    """A prefix in byte order, a suffix in reversed order."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    names = t("customer").select(F.col("c_custkey").alias("seq"), _bytes(F.col("c_name")).alias("key"), F.encode(F.lit(""), "UTF-8").alias("value"))
    hosts = t("pages").select(F.col("page_id").alias("seq"), _bytes(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("key"), F.encode(F.lit(""), "UTF-8").alias("value"))
    with store.write() as w:
        w.db("hosts", REVERSE)
        w.append(names), w.stage(_upsert(hosts.where(F.octet_length("key") > 0)), "hosts")
    s = store.snapshot()
    text = F.decode("key", "UTF-8").alias("key")
    return s.prefix(b"Customer#0000001").select(text, F.lit("main").alias("tree")).union(s.prefix(b".example.com", "hosts").select(text, F.lit("hosts").alias("tree")))


@query("SELECT o_orderkey AS k, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS place FROM orders")
def store_integer_keys(spark, t, folder):
    """Little-endian integers in their numeric order."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    rows = t("orders").select(F.col("o_orderkey").alias("seq"), F.lit("upsert").alias("op"), little_endian(F.col("o_orderkey")).alias("key"), F.encode(F.lit(""), "UTF-8").alias("value"))
    with store.write() as w:
        w.db("n", U64), w.stage(rows, "n")
    from tidemark.operators.position import ranks

    found = ranks(store.snapshot().entries("n").select("okey", "key"), "okey")
    return found.select(integer_of(F.col("key")).cast("long").alias("k"), F.col("rank").alias("place"))


# --- writing -----------------------------------------------------------------------------------------------------------
@query(CHANGED)
def store_upsert(spark, t, folder):
    store = _loaded(spark, t, folder)
    with store.write() as w:
        w.stage(_upsert(_new_status(t)))
    assert inspect.check(store) == []
    return _read(store.snapshot().all())


@query("SELECT o_orderkey AS k, concat(o_custkey, '|', o_orderstatus) AS v FROM orders WHERE o_orderstatus <> 'P'")
def store_erase(spark, t, folder):
    store = _loaded(spark, t, folder)
    with store.write() as w:
        w.stage(_upsert(_new_status(t), "erase"))
    return _read(store.snapshot().all())


@query(f"{tables.FOLD} SELECT k, v FROM s WHERE present AND i = (SELECT max(i) FROM s t WHERE t.k = s.k)")
def store_op_batch(spark, t, folder):
    """All four kinds of operations in order, in one commit."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=500)
    base = tables._ops_base(t).select(F.col("k").alias("seq"), big_endian(F.col("k")).alias("key"), _bytes(F.col("v")).alias("value"))
    ops = tables._ops(t).select("seq", "op", big_endian(F.col("k")).alias("key"), _bytes(F.col("v")).alias("value"))
    with store.write() as w:
        w.append(base)
    with store.write() as w:
        w.stage(ops)
    return _read(store.snapshot().all())


@query("SELECT n_nationkey AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS done FROM nation")
def store_outcomes(spark, t, folder):
    """What each unique insert of a nation's region says."""
    store = Store.open(spark, f"{folder}/s")
    rows = t("nation").orderBy("n_nationkey").collect()  # a table of fixed size
    with store.write() as w:
        said = w.put_many([(_key(r.n_regionkey), r.n_name.encode()) for r in rows], mode="insert_unique")
    return spark.createDataFrame([(r.n_nationkey, x) for r, x in zip(rows, said)], "nation int, done boolean")


@query("SELECT lang, CASE WHEN max(strlen(text)) > 996 OR min(strlen(text)) < 1 THEN 'InvalidArgument' ELSE 'Ok' END AS said FROM documents GROUP BY lang")
def store_limits(spark, t, folder):
    """Texts as keys: a batch with one that is empty or too long breaks its transaction."""
    store, out = Store.open(spark, f"{folder}/s"), []
    docs = t("documents").select("lang", F.col("doc_id").alias("seq"), F.lit("upsert").alias("op"), _bytes(F.col("text")).alias("key"), _bytes(F.col("source")).alias("value"))
    for (lang,) in docs.select("lang").distinct().collect():
        said = "Ok"
        try:
            with store.write() as w:
                w.stage(docs.where(F.col("lang") == lang).drop("lang"))
        except StoreError as e:
            said = e.code.value
        out.append((lang, said))
    return spark.createDataFrame(out, "lang string, said string")


@query("SELECT o_orderstatus AS db, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE count(*) END AS entries FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def store_databases(spark, t, folder):
    """A database for each status, of which one is dropped and one cleared."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    with store.write() as w:
        for status in "FOP":
            w.db(status)
            w.append(_entries(lambda n, s=status: t(n).where(F.col("o_orderstatus") == s), "orders", "o_orderkey", F.col("o_custkey")), status)
    with store.write() as w:
        w.drop("P"), w.clear("F")
    with store.read() as s:
        return spark.createDataFrame([(db, s.count(db)) for db in s.dbs()], "db string, entries long")


@query("SELECT p_partkey, p_name FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY round(p_retailprice * 100), p_partkey")
def store_indexed(spark, t, folder):
    """A tree and its secondary index, changed in one commit each: all parts, then half of them erased and written again."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    row = F.from_json(F.decode(F.col("value"), "UTF-8"), "p_name string, p_type string, price long")
    index = Indexed("parts", "by_price", lambda k, v: composite(text_part(row["p_type"]), big_endian(row["price"], 4), k))
    price = F.round(F.col("p_retailprice") * 100).cast("long").alias("price")
    rows = t("part").select("p_size", big_endian(F.col("p_partkey")).alias("key"), _bytes(F.to_json(F.struct("p_name", "p_type", price))).alias("value"))
    with store.write() as w:
        index.create(w)
        index.upsert(w, rows.select("key", "value"))
    some = rows.where("p_size > 25")
    with store.write() as w:
        index.erase(w, some.select("key"))
    with store.write() as w:
        index.upsert(w, some.select("key", "value"))
    kind = t("part").agg(F.min("p_type")).first()[0] or ""
    s = store.snapshot()
    assert s.count("parts") == s.count("by_price")
    return index.lookup(s, kind.encode() + b"\0").select(_number("key").alias("p_partkey"), row["p_name"].alias("p_name"))


# --- versions -------------------------------------------------------------------------------------------------------------
@query(f"SELECT 'old' AS at, * FROM ({ORDERS}) UNION ALL SELECT 'new', * FROM ({CHANGED})")
def store_snapshots(spark, t, folder):
    """A snapshot is not touched by a later commit."""
    store = _loaded(spark, t, folder)
    old = store.snapshot()
    with store.write() as w:
        w.stage(_upsert(_new_status(t)))
    return _read(old.all()).withColumn("at", F.lit("old")).union(_read(store.snapshot().all()).withColumn("at", F.lit("new")))


@query(ORDERS)
def store_recover(spark, t, folder):
    """A newest version that is damaged is passed over."""
    store = _loaded(spark, t, folder)
    with store.write() as w:
        w.stage(_upsert(_new_status(t)))
    newest = max(os.listdir(f"{store.path}/manifests"))
    with open(f"{store.path}/manifests/{newest}", "r+") as f:
        f.truncate(100)
    again = Store.open(spark, store.path)
    assert again.rolled_back == 2
    return _read(again.snapshot().all())


@query(ORDERS)
def store_rollback(spark, t, folder):
    store = _loaded(spark, t, folder)
    with contextlib.suppress(KeyError), store.write() as w:
        w.stage(_upsert(_new_status(t)))
        raise KeyError
    return _read(store.snapshot().all())


@query(f"""SELECT 'inside' AS at, count(*) AS n, count(*) FILTER (WHERE v = 'done') AS done FROM ({CHANGED}) WHERE v = 'done' OR NOT v LIKE '%F'
    UNION ALL SELECT 'after', count(*), count(*) FILTER (WHERE v = 'done') FROM ({CHANGED})""")
def store_nested(spark, t, folder):
    """A nested transaction that is kept, and one that is dropped; both read what was staged before."""
    store = _loaded(spark, t, folder)
    total = lambda view, at: _read(view.entries(None)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == "done").alias("done")).select(F.lit(at).alias("at"), "n", "done")
    full = _entries(lambda n: t(n).where("o_orderstatus = 'F'"), "orders", "o_orderkey", F.lit(""))
    with store.write() as w:
        with w.nested():
            w.stage(_upsert(_new_status(t)))
        with contextlib.suppress(KeyError), w.nested():
            w.stage(_upsert(full, "erase"))
            inside, _ = materialize(total(w, "inside"), "inside")
            raise KeyError
    return inside.union(total(store.snapshot(), "after"))


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS entries FROM events GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT user_id) FROM events")
def store_unsynced(spark, t, folder):
    """Commits that wait for a sync are seen here at once, and by others after the store is closed."""
    store = Store.open(spark, f"{folder}/s", sync="none")
    kinds = sorted(r[0] for r in t("events").select("event_type").distinct().collect())
    for kind in kinds:
        users = t("events").where(F.col("event_type") == kind).select("user_id").distinct()
        rows = users.select(F.col("user_id").alias("seq"), F.lit("upsert").alias("op"), big_endian(F.col("user_id")).alias("key"), _bytes(F.lit(kind)).alias("value"))
        with store.write() as w:
            w.stage(rows), w.db(kind), w.stage(rows, kind)
    assert Store.open(spark, store.path).snapshot().dbs() == [] and store.snapshot().dbs() == kinds
    store.close()
    with Store.open(spark, store.path).read() as s:
        return spark.createDataFrame([(k, s.count(k)) for k in kinds] + [("all", s.count())], "kind string, entries long")


@query(f"SELECT * FROM ({CHANGED}) WHERE NOT v LIKE '%F'")
def store_compact(spark, t, folder):
    """Change and erase, compact into a new store, check it, scan it."""
    store = _loaded(spark, t, folder)
    full = _entries(lambda n: t(n).where("o_orderstatus = 'F'"), "orders", "o_orderkey", F.lit(""))
    with store.write() as w:
        w.stage(_upsert(_new_status(t))), w.stage(_upsert(full, "erase"))
    new = store.compact(f"{folder}/dense")
    assert inspect.check(new) == [] and new.store_id != store.store_id
    return _read(new.snapshot().all())


@query(f"SELECT * FROM ({ORDERS}) WHERE v LIKE '%O'")
def store_shrink(spark, t, folder):
    """Erase most entries, merge the files that are left underfull, delete what no version needs."""
    store = _loaded(spark, t, folder, rows_per_file=100)
    rows = _entries(lambda n: t(n).where("o_orderstatus <> 'O'"), "orders", "o_orderkey", F.lit(""))
    with store.write() as w:
        w.stage(_upsert(rows, "erase"))
    before = inspect.stats(store)
    freed = store.shrink()
    after = inspect.stats(store)
    assert freed > 0 and after["files"] <= before["files"] and after["reclaimable_bytes"] == 0 and inspect.check(store) == []
    return _read(store.snapshot().all())


@query(ORDERS)
def store_copy(spark, t, folder):
    """The copy of an old snapshot, taken after a later commit."""
    store = _loaded(spark, t, folder)
    with store.read() as old:
        with store.write() as w:
            w.stage(_upsert(_new_status(t)))
        store.copy_snapshot(old, f"{folder}/copy")
    copy = Store.open(spark, f"{folder}/copy")
    assert copy.checkpoint() == replicate.checkpoint_of(copy.path) and copy.version == store.version - 1
    return _read(copy.snapshot().all())


@query("SELECT o_orderstatus AS tree, 'bytes' AS \"order\", count(*) AS entries, (sum(strlen(o_orderkey::VARCHAR)))::BIGINT AS digits FROM orders GROUP BY 1")
def store_trees(spark, t, folder):
    """Trees as the manifest lists them, with a sum over the entries of each from the files that it lists."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    with store.write() as w:
        for status in "FOP":
            w.db(status)
            w.append(_entries(lambda n, s=status: t(n).where(F.col("o_orderstatus") == s), "orders", "o_orderkey", F.col("o_orderkey")), status)
    s = store.snapshot()
    sums = [(db, s.entries(db).agg(F.sum(F.octet_length("value"))).first()[0]) for db in s.dbs()]
    listed = inspect.trees(store).where("tree <> ''").select("tree", "order", "entries")
    assert inspect.row_groups(store).agg(F.sum("rows")).first()[0] == listed.agg(F.sum("entries")).first()[0]
    return listed.join(spark.createDataFrame(sums, "tree string, digits long"), "tree")


@query("""WITH k AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS v FROM (SELECT DISTINCT event_type FROM events)),
    n AS (SELECT user_id, min(v) AS v FROM events JOIN k USING (event_type) GROUP BY 1)
    SELECT v::BIGINT AS version, (SELECT count(*) FROM n WHERE n.v <= k.v) AS entries FROM k UNION ALL SELECT 0, 0""")
def store_versions(spark, t, folder):
    """Versions that are kept, with the entries of each: a commit for each kind of event."""
    return inspect.metas(_by_kind(spark, t, folder)).where("whole").select("version", "entries")


def _by_kind(spark, t, folder) -> Store:
    store = Store.open(spark, f"{folder}/s")
    for kind in sorted(r[0] for r in t("events").select("event_type").distinct().collect()):
        users = t("events").where(F.col("event_type") == kind).select("user_id").distinct()
        with store.write() as w:
            w.stage(users.select(F.col("user_id").alias("seq"), F.lit("upsert").alias("op"), big_endian(F.col("user_id")).alias("key"), _bytes(F.lit(kind)).alias("value")))
    return store


# --- optimistic transactions ------------------------------------------------------------------------------------------------
@query("""WITH k AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS v FROM (SELECT DISTINCT event_type FROM events)),
    w AS (SELECT DISTINCT v, user_id FROM events JOIN k USING (event_type))
    SELECT DISTINCT event_id AS txn FROM events e JOIN w ON w.v > e.event_id % 6 AND (e.value < 2 OR w.user_id = e.user_id)""")
def store_conflicts(spark, t, folder):
    """Reads of users, or of all, against what later commits wrote."""
    store = _by_kind(spark, t, folder)
    i = F.col("event_id")
    touched = t("events").select(i.alias("txn"), (i % 6).alias("snapshot"), F.lit("").alias("db"), F.when(F.col("value") >= 2, big_endian(F.col("user_id"))).alias("key"))
    return conflicts_of(store, touched)


@query("SELECT n_nationkey AS nation, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) = 1 AS won FROM nation")
def store_optimistic(spark, t, folder):
    """A transaction for each nation that reads and writes its region, committed as a group: the first of a region wins."""
    store = Store.open(spark, f"{folder}/s")
    rows = t("nation").orderBy("n_nationkey").collect()  # a table of fixed size
    txns = [OptimisticTxn(store) for _ in rows]
    for r, x in zip(rows, txns):
        assert x.get(_key(r.n_regionkey)) is None
        x.put(_key(r.n_regionkey), r.n_name.encode())
    versions = commit_group(store, txns)
    assert store.version == 1 and [r.n_name.encode() for r, v in zip(rows, versions) if v > 0 and r.n_regionkey == 0] == [store.snapshot().get(_key(0))]
    return spark.createDataFrame([(r.n_nationkey, v > 0) for r, v in zip(rows, versions)], "nation int, won boolean")


@query(f"SELECT * FROM ({ORDERS}) WHERE k >= 100 AND k < 400 AND k <> 150 UNION ALL SELECT 150, 'mine' WHERE EXISTS (SELECT 1 FROM orders) ")
def store_optimistic_scan(spark, t, folder):
    """A range under a transaction's own writes, retried once because another commit came between."""
    store, tries = _loaded(spark, t, folder), []

    def body(x: OptimisticTxn):
        tries.append(1)
        x.put(_key(150), b"mine")
        found, _ = materialize(_read(x.scan(None, _key(100), _key(400))), "seen")
        if len(tries) == 1:
            with store.write() as w:
                w.put(_key(10**9), b"between")
        return found

    found = optimistic(store, body)
    assert len(tries) == 2 and store.snapshot().get(_key(150)) == b"mine"
    return found


# --- queue --------------------------------------------------------------------------------------------------------------------
@query("""WITH q AS (SELECT doc_id, toxic, row_number() OVER (ORDER BY doc_id) AS seq FROM labels)
    SELECT seq, CASE WHEN seq > 60 THEN 'ready' WHEN seq <= 40 AND toxic = 1 THEN 'dead' ELSE 'ready' END AS state,
      CASE WHEN seq <= 60 THEN 1 ELSE 0 END::INT AS deliveries, doc_id::VARCHAR AS body, CASE WHEN seq <= 40 AND toxic = 1 THEN 'rejected' END AS dead_reason
    FROM q WHERE NOT (seq <= 40 AND toxic = 0)""")
def mq_cycle(spark, t, folder):
    """All labels sent; 60 received: of the first 40 the clean ones settled and the toxic ones rejected, the rest run out of time."""
    store = Store.open(spark, f"{folder}/s")
    mq = MessageQueue(store, "labels", lease_ns=1000)
    rows = t("labels").select("doc_id", _bytes(F.col("doc_id")).alias("body"), F.col("toxic").cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("blob_key"))
    mq.send(rows, ["doc_id"], now_ns=5)
    got = mq.receive(60, now_ns=10)
    mq.ack([m.receipt for m in got[:40] if m.correlation_id == "0"])
    bad = [m.receipt for m in got[:40] if m.correlation_id == "1"]
    if bad:
        mq.nack(bad, dead=True, now_ns=20)
    assert mq.sweep(now_ns=1009) == 0 and mq.sweep(now_ns=1010) == max(0, len(got) - 40)
    assert mq.store.pins() == {} and mq.peek() is not None
    return mq.state(store.snapshot()).select("seq", "state", "deliveries", F.decode("body", "UTF-8").alias("body"), "dead_reason")


@query("SELECT count(*)::BIGINT AS ready FROM labels WHERE quality IS NOT NULL")
def mq_stream_once(spark, t, folder):
    """A micro-batch that is run again sends nothing."""
    mq = MessageQueue(Store.open(spark, f"{folder}/s"), "labels")
    send = writer(mq, ["correlation_id"])
    batch = t("labels").where("quality is not null").select(_bytes(F.col("quality")).alias("body"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("correlation_id"), F.lit(None).cast("string").alias("blob_key"))
    send(batch, 0), send(batch, 0)
    return spark.createDataFrame([(mq.counts()["ready"],)], "ready long")


# --- archives -------------------------------------------------------------------------------------------------------------------
def _archive(t, folder: str) -> str:
    """All documents in one archive, in the order of doc_id."""
    docs = t("documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("."), "source").alias("name"), _bytes(F.col("text")).alias("payload"))
    return tar.write_archives(docs.repartitionByRange(1, "name").sortWithinPartitions("name"), f"{folder}/tar").first().archive


NAMED = "SELECT doc_id, concat(lpad(doc_id::VARCHAR, 12, '0'), '.', source) AS name, source, text FROM documents"


@query(f'SELECT n.name, strlen(n.text)::BIGINT AS size, l."offset", md5(n.text) AS digest FROM ({NAMED}) n JOIN ({tables.LAYOUT}) l ON l.doc_id = n.doc_id')
def tar_read(spark, t, folder):
    """Members as the data source reads them back, the archive cut into several partitions."""
    path = _archive(t, folder)
    return tar.members(spark, path, split=1 << 20).select("name", "size", "offset", F.md5("payload").alias("digest"))


@query(f'SELECT n.name AS key, strlen(n.text)::BIGINT AS size, l."offset", false AS known FROM ({NAMED}) n JOIN ({tables.LAYOUT}) l ON l.doc_id = n.doc_id')
def blob_adopt(spark, t, folder):
    """An archive that another writer made, brought into an index."""
    blobs = BlobStorage(Store.open(spark, f"{folder}/s"), _archive(t, folder))
    assert blobs.catch_up() == blobs.list().count() and blobs.catch_up() == 0 and blobs.verify().where("not ok").isEmpty()
    return blobs.index().select(F.decode("key", "UTF-8").alias("key"), "size", "offset", "known")


@query(f'SELECT source AS key, "offset" FROM (SELECT n.source, l."offset", row_number() OVER (PARTITION BY n.source ORDER BY l."offset" DESC) AS k FROM ({NAMED}) n JOIN ({tables.LAYOUT}) l ON l.doc_id = n.doc_id) WHERE k = 1')
def blob_reindex(spark, t, folder):
    """The index rebuilt under other keys: of equal ones the later member counts."""
    blobs = BlobStorage(Store.open(spark, f"{folder}/s"), _archive(t, folder))
    blobs.catch_up()
    blobs.rebuild_index(lambda names: names.str[13:].str.encode("utf-8"))
    return blobs.index().select(F.decode("key", "UTF-8").alias("key"), "offset")


@query("SELECT r_name AS key, repeat(r_name, 100) AS payload, true AS known FROM region WHERE r_regionkey <> 2")
def blob_put(spark, t, folder):
    """Payloads appended and indexed, one erased from the index alone, the archive closed as other tools expect."""
    blobs = BlobStorage(Store.open(spark, f"{folder}/s"), f"{folder}/a.tar")
    rows = t("region").orderBy("r_regionkey").collect()  # a table of fixed size
    blobs.put_many([(r.r_name.encode(), f"{r.r_regionkey}.txt", r.r_name.encode() * 100) for r in rows])
    assert all(blobs.erase(r.r_name.encode()) for r in rows if r.r_regionkey == 2)
    blobs.finalize()
    assert blobs.list().count() == len(rows) and os.path.getsize(blobs.archive) % tar.RECORD == 0 and blobs.verify().where("not ok").isEmpty()
    found = blobs.index().select("key", "known").collect()
    return spark.createDataFrame([(bytes(r.key).decode(), blobs.get(bytes(r.key)).decode(), r.known) for r in found], "key string, payload string, known boolean")


# --- replication, command line -----------------------------------------------------------------------------------------------------
@query(CHANGED)
def ship_apply(spark, t, folder):
    """A replica brought to the primary's state by a bundle."""
    store = _loaded(spark, t, folder)
    with store.read() as s:
        store.copy_snapshot(s, f"{folder}/replica")
    base = replicate.checkpoint_of(f"{folder}/replica")
    assert replicate.extract(store, base, f"{folder}/bundle") == replicate.UP_TO_DATE
    with store.write() as w:
        w.stage(_upsert(_new_status(t)))
    assert replicate.extract(store, base, f"{folder}/bundle") == replicate.OK and replicate.available(store) == (0, 2)
    assert replicate.inspect_bundle(f"{folder}/bundle")["base"] == base
    said = [replicate.apply_bundle(f"{folder}/replica", f"{folder}/bundle") for _ in range(2)]
    assert said == [replicate.OK, replicate.UP_TO_DATE] and replicate.prune(store, 2) == 2
    replica = Store.open(spark, f"{folder}/replica")
    assert replica.checkpoint() == store.checkpoint()
    return _read(replica.snapshot().all())


@query("SELECT concat(c_name, ' = ', c_mktsegment) AS line FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def cli_dump(spark, t, folder):
    """What the command line prints of a prefix."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    with store.write() as w:
        w.append(t("customer").select(F.col("c_custkey").alias("seq"), _bytes(F.col("c_name")).alias("key"), _bytes(F.col("c_mktsegment")).alias("value")))
    printed = io.StringIO()
    with contextlib.redirect_stdout(printed):
        assert cli.run(spark, ["dump", store.path, "-p", "Customer#0000001"]) == cli.FINE
        assert cli.run(spark, ["check", store.path]) == cli.FINE
    return spark.createDataFrame([(x,) for x in printed.getvalue().splitlines()[:-1]], "line string")


# --- queue and transactions together, limits of waiting -----------------------------------------------------------------------------
@query("SELECT page_id, md5(html) AS digest, strlen(html) >= 2000 AS outside FROM pages")
def mq_large_bodies(spark, t, folder):
    """Pages as messages: bodies of 2000 bytes and more lie in an archive; all are whole."""
    store = Store.open(spark, f"{folder}/s")
    blobs = BlobStorage(store, f"{folder}/a.tar")
    mq = MessageQueue(store, "texts", blobs=blobs, blob_threshold=2000)
    rows = t("pages").select("page_id", _bytes(F.col("html")).alias("body")).orderBy("page_id").collect()  # bodies are sent from here
    mq.send_many([bytes(r.body) for r in rows])
    assert blobs.index().count() == sum(len(r.body) >= 2000 for r in rows)
    state = mq.state(store.snapshot()).select("seq", "body", "blob_key")
    kept = state.join(blobs.index().select(F.decode("key", "UTF-8").alias("blob_key"), "offset", "size"), "blob_key", "left")
    payloads = tar.members(spark, blobs.archive).select("offset", "payload")
    whole = kept.join(payloads, "offset", "left").select("seq", F.md5(F.coalesce("body", "payload")).alias("digest"), F.col("blob_key").isNotNull().alias("outside"))
    ids = spark.createDataFrame([(k, r.page_id) for k, r in enumerate(rows, 1)], "seq long, page_id long")
    return ids.join(whole, "seq").select("page_id", "digest", "outside")


@query("SELECT 'done' AS what, count(*) AS n FROM (SELECT 1 FROM labels LIMIT 30) UNION ALL SELECT 'left', greatest(count(*) - 30, 0) FROM labels UNION ALL SELECT 'refused', 1 UNION ALL SELECT 'empty', 0")
def mq_in_transactions(spark, t, folder):
    """Settling shares a commit with the work; a stale receipt drops both; an empty queue makes no version."""
    store = Store.open(spark, f"{folder}/s")
    mq = MessageQueue(store, "labels")
    mq.send(t("labels").select("doc_id", _bytes(F.col("doc_id")).alias("body"), F.lit(None).cast("string").alias("correlation_id"), F.lit(None).cast("string").alias("blob_key")), ["doc_id"])
    got = mq.receive(30)
    with store.write() as w:
        w.stage(w._ops([("upsert", b"done:" + m.body, b"") for m in got]))
        mq.ack([m.receipt for m in got], w)
    refused = 0
    try:
        with store.write() as w:
            w.put(b"done:never", b"")
            mq.ack([got[0].receipt], w)
    except StoreError:
        refused = 1
    with store.read() as s:
        done = s.prefix(b"done:").count()
    other = MessageQueue(store, "empty")
    before = store.version
    assert other.receive(5) == [] and other.wait(0.05) == [] and other.sweep() == 0
    return spark.createDataFrame([("done", done), ("left", mq.counts()["ready"]), ("refused", refused), ("empty", store.version - before)], "what string, n long")


@query("SELECT 'Busy' AS said, count(*) AS entries FROM orders UNION ALL SELECT 'ReadOnly', count(*) FROM orders UNION ALL SELECT 'NotFound', count(*) FROM orders UNION ALL SELECT 'KeyExists', count(*) FROM orders UNION ALL SELECT 'MapFull', count(*) FROM orders")
def store_refusals(spark, t, folder):
    """What each attempt that must fail says, and the entries that are there after it."""
    store = _loaded(spark, t, folder)
    reader = Store.open(spark, store.path, read_only=True)
    small = Store.open(spark, store.path, max_size=10)

    def busy():
        with store.writer(), Store.open(spark, store.path).write(timeout=0.05):
            pass

    def write_to(s):
        with s.write() as w:
            w.put(b"other", b"x")

    def reserve():
        with store.write() as w:
            w.reserve(_key(t("orders").agg(F.min("o_orderkey")).first()[0]), b"x", mode="insert_unique")

    out = []
    for attempt in (busy, lambda: write_to(reader), lambda: store.snapshot().at(b"nothing"), reserve, lambda: write_to(small)):
        try:
            attempt()
            said = "Ok"
        except StoreError as e:
            said = e.code.value
        with Store.open(spark, store.path).read() as s:
            out.append((said, s.count()))
    return spark.createDataFrame(out, "said string, entries long")


@query("""WITH n AS (SELECT event_type AS kind, event_id, count(*) OVER (PARTITION BY event_type) AS all_of FROM events)
    SELECT kind, all_of::BIGINT AS entries, sum(event_id)::BIGINT AS ids FROM n GROUP BY 1, 2""")
def store_concurrent(spark, t, folder):
    """Writers of several threads, one for each kind of event: their commits follow each other, none is lost."""
    import threading

    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    kinds = sorted(r[0] for r in t("events").select("event_type").distinct().collect())

    def load(kind):
        with store.write() as w:
            w.db(kind)
            w.append(_entries(lambda n: t(n).where(F.col("event_type") == kind), "events", "event_id", F.col("event_type")), kind)

    seen = store.version
    threads = [threading.Thread(target=load, args=(k,)) for k in kinds]
    [x.start() for x in threads]
    assert not kinds or store.wait_for_commit(seen, 120) > seen
    [x.join() for x in threads]
    assert store.version == len(kinds) and inspect.check(store) == []
    s = store.snapshot()
    out = [(k, s.count(k), s.entries(k).agg(F.sum(_number("key"))).first()[0]) for k in kinds]
    return spark.createDataFrame(out, "kind string, entries long, ids long")


@query("""WITH s AS (SELECT c_name AS b, lag(c_name) OVER (ORDER BY c_name) AS a FROM customer),
    c AS (SELECT a, b, (SELECT min(i) FROM range(1, 40) AS r(i) WHERE substr(a, i, 1) <> substr(b, i, 1)) AS i FROM s WHERE a IS NOT NULL)
    SELECT b AS key, substr(b, 1, i) AS separator FROM c""")
def store_separators(spark, t, folder):
    """The shortest bytes between each key and the one before it."""
    store = Store.open(spark, f"{folder}/s", rows_per_file=ROWS)
    with store.write() as w:
        w.append(t("customer").select(F.col("c_custkey").alias("seq"), _bytes(F.col("c_name")).alias("key"), F.encode(F.lit(""), "UTF-8").alias("value")))
    from tidemark.operators.position import neighbours

    rows = neighbours(store.snapshot().entries(None).select("key"), "key").where("prev is not null")
    return rows.select(F.decode("key", "UTF-8").alias("key"), F.decode(separator_of(F.col("prev"), F.col("key")), "UTF-8").alias("separator"))


@query("SELECT 3 AS versions, count(*) AS entries, count(*) FILTER (WHERE o_orderstatus = 'P') AS retired, 1 AS readers, true AS listed FROM orders")
def store_stats(spark, t, folder):
    """Figures of a store with a reader on an old version: what is kept, pinned and free."""
    store = _loaded(spark, t, folder)
    old = store.snapshot()
    with store.write() as w:
        w.stage(_upsert(_new_status(t)))
    stats, free = inspect.stats(store), inspect.free_list(store)
    assert stats["reader_lag"] == 1 and free.isEmpty() and inspect.readers(store).collect()[0].readers == 1
    retired = old.entries(None).exceptAll(store.snapshot().entries(None)).count()
    names = {r.path for r in inspect.files(store).select("path").collect()}
    digests = {r.path: r.digest for r in inspect.file_digests(spark, store.path, sorted(names)).collect()}
    listed = all(digests[f.path] == f.digest for f in store.manifest.main.files) and inspect.file_map(store).agg(F.sum("n")).first()[0] == len(names)
    return spark.createDataFrame([(stats["versions"], stats["entries"], retired, stats["readers"], listed)], "versions int, entries long, retired long, readers int, listed boolean")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%.1f MiB', n / 1048576.0) END AS size FROM (SELECT doc_id, strlen(text) * 100 AS n FROM documents)")
def human_sizes(spark, t, folder):
    return t("documents").select("doc_id", human(F.octet_length("text") * 100).alias("size"))
