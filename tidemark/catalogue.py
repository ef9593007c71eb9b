"""Queries over the driver's tables, one for each operation of the engine, and their SQL.

Each query is the operation itself over whole tables; constants stand for the arguments a user would pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import order as ord_
from tidemark.functions import text as text_
from tidemark.functions.digest import xxh3_64
from tidemark.operators import access, mutate, position, queue, relate, shapes

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def enter(f):
        Q[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return enter


def _orders(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice")


ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


# --- points, ranges, prefixes ---------------------------------------------------------------------------------------
@query(f"{ORDERS} WHERE o_orderkey = 42")
def kv_get(t):
    return access.get(_orders(t), "o_orderkey", 42)


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderkey = 42")
def kv_contains(t):
    orders = _orders(t)
    return orders.sparkSession.createDataFrame([(access.contains(orders, "o_orderkey", 42),)], "found boolean")


@query(f"{ORDERS} ORDER BY o_orderkey")
def kv_scan(t):
    return access.scan(_orders(t), "o_orderkey")


@query(f"{ORDERS} ORDER BY o_orderkey DESC")
def kv_scan_reverse(t):
    return access.scan(_orders(t), "o_orderkey", descending=True)


@query(f"{ORDERS} WHERE o_orderkey >= 100 AND o_orderkey < 200")
def kv_between(t):
    return access.between(_orders(t), "o_orderkey", 100, 200)


@query(f"{ORDERS} WHERE o_orderkey >= 1400")
def kv_from(t):
    return access.from_(_orders(t), "o_orderkey", 1400)


@query(f"{ORDERS} WHERE o_orderkey < 70")
def kv_upto(t):
    return access.upto(_orders(t), "o_orderkey", 70)


@query("SELECT c_name, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def kv_prefix(t):
    return access.prefix(t("customer").select("c_name", "c_custkey"), "c_name", "Customer#0000001")


@query("SELECT hex(encode(c_name)) AS key, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#0000001')")
def kv_prefix_bytes(t):
    rows = t("customer").select(F.encode("c_name", "UTF-8").alias("key"), "c_custkey")
    return access.prefix(rows, "key", b"Customer#0000001").select(F.hex("key").alias("key"), "c_custkey")


@query("SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS pages FROM pages WHERE suffix(regexp_extract(url, '://([^/?#]+)', 1), '.example.com') GROUP BY 1")
def kv_suffix_reverse(t):
    hosts = t("pages").select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return access.suffix(hosts, "host", ".example.com").groupBy("host").agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT c_name, (row_number() OVER (ORDER BY reverse(c_name)) - 1)::BIGINT AS rank FROM customer")
def kv_reverse_order(t):
    rows = t("customer").select("c_name", ord_.encode(F.encode("c_name", "UTF-8"), ord_.REVERSE).alias("okey"))
    return position.ranks(rows, "okey").select("c_name", "rank")


@query("SELECT c_name FROM customer WHERE starts_with(c_name, 'Customer#00000') ORDER BY c_name LIMIT 25")
def kv_visit(t):
    return access.visit(t("customer"), "c_name", "Customer#00000", 25)


@query("SELECT o_orderkey FROM orders")
def kv_keys(t):
    return access.keys_only(t("orders"), "o_orderkey")


@query("SELECT doc_id, starts_with(text, 'The') AS starts, suffix(text, '.') AS ends, substr(text, 5, 10) AS part FROM documents")
def kv_slices(t):
    raw = F.encode("text", "UTF-8")
    return t("documents").select("doc_id", access.starts_with(raw, b"The").alias("starts"), access.ends_with(raw, b".").alias("ends"), access.subspan(F.col("text"), 4, 10).alias("part"))


@query(
    """WITH p AS (SELECT i::BIGINT AS pos, ((i * 7919) % 1500)::BIGINT AS doc_id FROM range(0, 200) AS r(i))
    SELECT p.pos, p.doc_id, d.lang, d.n_chars, d.doc_id IS NOT NULL AS found FROM p LEFT JOIN documents d ON d.doc_id = p.doc_id"""
)
def kv_find_many(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    probes = docs.sparkSession.range(200).select(F.col("id").alias("pos"), (F.col("id") * 7919 % 1500).alias("doc_id"))
    return access.find_many(docs, "doc_id", probes).select("pos", "doc_id", "lang", "n_chars", "found")


# --- positions --------------------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1")
def kv_first(t):
    return position.first(t("events").select("event_id", "user_id", "event_type"), "event_id")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1")
def kv_last(t):
    return position.last(t("events").select("event_id", "user_id", "event_type"), "event_id")


@query("SELECT c_name, c_custkey FROM customer WHERE c_name >= 'Customer#0000000755' ORDER BY c_name LIMIT 1")
def kv_seek(t):
    return position.seek(t("customer").select("c_name", "c_custkey"), "c_name", "Customer#0000000755")


@query(
    """WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), p AS (SELECT (i * 37)::BIGINT AS probe FROM range(0, 900) AS r(i))
    SELECT probe, (SELECT min(k) FROM k WHERE k >= probe) AS found FROM p"""
)
def kv_seek_many(t):
    keys = t("lineitem").select("l_orderkey").distinct()
    probes = keys.sparkSession.range(900).select((F.col("id") * 37).alias("probe"))
    return position.seek_many(keys, "l_orderkey", probes, "probe")


@query("SELECT o_orderkey, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def kv_next_prev(t):
    return position.neighbours(t("orders").select("o_orderkey"), "o_orderkey")


@query(f"{ORDERS} WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 20")
def kv_page_after(t):
    return position.page_after(_orders(t), "o_orderkey", 500, 20)


@query(f"{ORDERS} ORDER BY o_orderkey LIMIT 1 OFFSET 777")
def kv_skip(t):
    return position.skip(_orders(t), "o_orderkey", 777)


@query("SELECT count(*) AS rank FROM orders WHERE o_orderkey < 777")
def kv_rank(t):
    return position.rank(t("orders"), "o_orderkey", 777)


@query("SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1)::BIGINT AS rank FROM customer")
def kv_ranks(t):
    return position.ranks(t("customer").select("c_name"), "c_name")


@query("SELECT count(*) AS entries FROM orders")
def kv_count(t):
    return position.count(t("orders"))


@query("SELECT count(*) AS entries FROM orders WHERE o_orderkey >= 250 AND o_orderkey < 1250")
def kv_count_range(t):
    return position.count_range(t("orders"), "o_orderkey", 250, 1250)


@query(
    """WITH r AS (SELECT i AS id, ((i * 331) % 1500)::BIGINT AS lo, CASE WHEN i % 5 = 0 THEN NULL ELSE ((i * 733) % 1500)::BIGINT END AS hi FROM range(0, 60) AS r(i))
    SELECT id, lo, hi, (SELECT count(*) FROM orders WHERE o_orderkey >= lo AND (hi IS NULL OR o_orderkey < hi)) AS entries FROM r"""
)
def kv_count_ranges(t):
    orders = t("orders")
    i = F.col("id")
    ranges = orders.sparkSession.range(60).select("id", (i * 331 % 1500).alias("lo"), F.when(i % 5 != 0, i * 733 % 1500).alias("hi"))
    return position.count_ranges(orders.withColumn("k", F.col("o_orderkey")), "k", ranges)


@query("SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
def kv_min_max(t):
    return position.bounds(t("orders"), "o_orderkey")


@query("SELECT hex(unhex(lpad(hex(o_orderkey), 16, '0'))) AS okey, o_orderkey FROM orders")
def kv_integer_keys(t):
    little = ord_.little_endian(F.col("o_orderkey"))
    return t("orders").select(F.hex(ord_.encode(little, ord_.U64)).alias("okey"), ord_.integer_of(little).cast("long").alias("o_orderkey"))


# --- mutations ----------------------------------------------------------------------------------------------------------
BATCH = "SELECT l_orderkey AS k, count(*)::BIGINT AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1"
BASE = "SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderstatus <> 'O'"


def _batch(t):
    return t("lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))


def _base(t):
    return t("orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))


@query(f"SELECT coalesce(b.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE b.v END AS v FROM ({BASE}) b FULL JOIN ({BATCH}) n ON b.k = n.k")
def kv_upsert(t):
    return mutate.upsert(_base(t), _batch(t), "k")


@query(f"WITH b AS ({BASE}), n AS ({BATCH}) SELECT k, v FROM b UNION ALL SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM b)")
def kv_insert_unique(t):
    return mutate.insert_unique(_base(t), _batch(t), "k")[0]


@query(f"WITH b AS ({BASE}), n AS ({BATCH}) SELECT k, v FROM n WHERE k IN (SELECT k FROM b)")
def kv_insert_refused(t):
    return mutate.insert_unique(_base(t), _batch(t), "k")[1]


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality::BIGINT ELSE d.n_chars END AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def kv_update_only(t):
    base = t("documents").select("doc_id", F.col("n_chars").alias("v"))
    return mutate.update_only(base, t("labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id")[0]


@query(f"WITH b AS ({BASE}), n AS ({BATCH}) SELECT k, v FROM n WHERE k NOT IN (SELECT k FROM b)")
def kv_update_refused(t):
    return mutate.update_only(_base(t), _batch(t), "k")[1]


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def kv_erase(t):
    return mutate.erase(t("documents").select("doc_id", "lang"), t("labels"), "doc_id")[0]


@query("SELECT doc_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def kv_erased(t):
    return mutate.erase(t("documents"), t("labels"), "doc_id")[1]


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P')")
def kv_erase_iterating(t):
    return mutate.erase_where(t("orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P").select("o_orderkey")


@query("SELECT coalesce(sum(CASE WHEN k <= p THEN 1 ELSE 0 END), 0)::BIGINT AS violations FROM (SELECT user_id AS k, lag(user_id) OVER (ORDER BY event_id) AS p FROM events)")
def kv_append_check(t):
    return mutate.append_violations(t("events"), "user_id", "event_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def kv_lww(t):
    return mutate.last_writers(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


OPS = """SELECT event_id AS seq, user_id AS k, props AS v,
    CASE event_type WHEN 'purchase' THEN 'upsert' WHEN 'signup' THEN 'insert_unique' WHEN 'click' THEN 'update_only' WHEN 'view' THEN 'update_only' ELSE 'erase' END AS op FROM events"""
OPS_BASE = "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _ops(t):
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "upsert").when(kind == "signup", "insert_unique").when(kind.isin("click", "view"), "update_only").otherwise("erase")
    return t("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("k"), F.col("props").alias("v"), op.alias("op"))


def _ops_base(t):
    return t("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))


FOLD = f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq) AS i FROM ({OPS})),
b AS ({OPS_BASE}),
s AS (SELECT k0.k, 0::BIGINT AS i, b.k IS NOT NULL AS present, b.v AS v, NULL::BIGINT AS seq, NULL::BOOLEAN AS done
      FROM (SELECT k FROM o UNION SELECT k FROM b) k0 LEFT JOIN b ON b.k = k0.k
      UNION ALL
      SELECT s.k, o.i, CASE o.op WHEN 'upsert' THEN true WHEN 'erase' THEN false WHEN 'insert_unique' THEN true ELSE s.present END,
             CASE WHEN o.op = 'upsert' OR (o.op = 'insert_unique' AND NOT s.present) OR (o.op = 'update_only' AND s.present) THEN o.v WHEN o.op = 'erase' THEN NULL ELSE s.v END,
             o.seq, CASE o.op WHEN 'upsert' THEN true WHEN 'insert_unique' THEN NOT s.present ELSE s.present END
      FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1)
"""


@query(f"{FOLD} SELECT k, v FROM s WHERE present AND i = (SELECT max(i) FROM s t WHERE t.k = s.k)")
def kv_op_fold(t):
    return mutate.fold(_ops_base(t), _ops(t), "k", "v")


@query(f"{FOLD} SELECT seq, k, done FROM s WHERE seq IS NOT NULL")
def kv_op_outcomes(t):
    return mutate.outcomes(_ops_base(t), _ops(t), "k").select("seq", "k", "done")


@query(
    """WITH b AS (SELECT event_id AS k, event_type AS v FROM events WHERE event_type <> 'signup'),
    w AS (SELECT event_id AS k, props AS v, event_type = 'error' AS gone FROM events WHERE event_type IN ('signup', 'error', 'click'))
    SELECT coalesce(b.k, w.k) AS k, CASE WHEN w.k IS NOT NULL THEN w.v ELSE b.v END AS v FROM b FULL JOIN w ON b.k = w.k WHERE w.k IS NULL OR NOT w.gone"""
)
def kv_overlay_scan(t):
    events, kind = t("events"), F.col("event_type")
    base = events.where(kind != "signup").select(F.col("event_id").alias("k"), kind.alias("v"))
    writes = events.where(kind.isin("signup", "error", "click")).select(F.col("event_id").alias("k"), F.col("props").alias("v"), (kind == "error").alias("gone"))
    return relate.overlay(base, writes, "k", "gone")


LAYERS = "SELECT user_id AS k, event_id AS seq, event_type AS v, (event_id % 3)::BIGINT AS layer, CASE WHEN event_id % 3 = 2 THEN 'abort' ELSE 'commit' END AS outcome FROM events"


@query(f"SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY layer DESC, seq DESC) AS r FROM ({LAYERS}) WHERE outcome <> 'abort') WHERE r = 1")
def kv_nested_fold(t):
    i = F.col("event_id")
    rows = t("events").select(F.col("user_id").alias("k"), i.alias("seq"), F.col("event_type").alias("v"), (i % 3).alias("layer"), F.when(i % 3 == 2, "abort").otherwise("commit").alias("outcome"))
    return mutate.layered_fold(rows, "k", "layer", "seq", "outcome").select("k", "seq", "v")


LWW = "SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events{}) WHERE r = 1"


@query(f"({LWW.format('')}) EXCEPT ALL ({LWW.format(' WHERE event_id <= (SELECT max(event_id) // 2 FROM events)')})")
def kv_snapshot_diff(t):
    """The last state against that of the version in the middle."""
    events = t("events")
    at = lambda rows: mutate.last_writers(rows, "user_id", "event_id").select("user_id", "event_type")
    middle = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    return relate.snapshot_diff(at(events.where(F.col("event_id") <= middle)), at(events))


# --- secondary index, joins ---------------------------------------------------------------------------------------------
@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_type = (SELECT min(p_type) FROM part) ORDER BY round(p_retailprice * 100), p_partkey")
def idx_category_price(t):
    part = t("part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    price = F.round(F.col("p_retailprice") * 100).cast("long")
    index = mutate.index_of(part, ord_.composite(ord_.text_part(F.col("p_type")), ord_.big_endian(price, 4), ord_.big_endian(F.col("p_partkey"))), "p_partkey")
    kind = part.agg(F.min("p_type")).first()[0] or ""
    return relate.by_index(access.prefix(index, "entry", kind.encode() + b"\0"), part, "p_partkey", "entry").select("p_partkey", "p_name", "p_retailprice")


@query("SELECT hex(encode(p_type)) || '00' || lpad(hex(round(p_retailprice * 100)::BIGINT), 8, '0') || lpad(hex(p_partkey), 16, '0') AS entry, p_partkey FROM part")
def idx_entries(t):
    price = F.round(F.col("p_retailprice") * 100).cast("long")
    entry = ord_.composite(ord_.text_part(F.col("p_type")), ord_.big_endian(price, 4), ord_.big_endian(F.col("p_partkey")))
    return mutate.index_of(t("part"), entry, "p_partkey").select(F.hex("entry").alias("entry"), "p_partkey")


# views and clicks are reads, all other events are commits; a database is a share of the users; a low value makes a read a
# scan or a commit a cleared database, the earliest signup is a commit of unknown keys
TOUCHED = "SELECT event_id AS txn, event_id - 40 AS snapshot, user_id % 7 AS db, CASE WHEN value < 2 THEN NULL ELSE user_id END AS key FROM events WHERE event_type IN ('view', 'click')"
LOG = """SELECT event_id AS commit_txn, user_id % 7 AS db, CASE WHEN value < 0.2 THEN NULL ELSE user_id END AS key,
    event_type = 'signup' AND event_id = (SELECT min(event_id) FROM events WHERE event_type = 'signup') AS unknown FROM events WHERE event_type NOT IN ('view', 'click')"""


def _occ(t):
    e, i, db = t("events"), F.col("event_id"), (F.col("user_id") % 7).alias("db")
    reads = F.col("event_type").isin("view", "click")
    touched = e.where(reads).select(i.alias("txn"), (i - 40).alias("snapshot"), db, F.when(F.col("value") >= 2, F.col("user_id")).alias("key"))
    first = e.where("event_type = 'signup'").agg(F.min("event_id")).first()[0]
    log = e.where(~reads).select(i.alias("commit_txn"), db, F.when(F.col("value") >= 0.2, F.col("user_id")).alias("key"), F.coalesce(i == F.lit(first), F.lit(False)).alias("unknown"))
    return touched, log


@query(
    f"""WITH r AS ({TOUCHED}), w AS ({LOG}) SELECT DISTINCT txn FROM r JOIN w ON commit_txn > snapshot
    AND (unknown OR (r.db = w.db AND (r.key = w.key OR r.key IS NULL OR w.key IS NULL)))"""
)
def occ_conflicts(t):
    return relate.conflicts(*_occ(t))


@query(f"WITH r AS ({TOUCHED}), w AS ({LOG}) SELECT DISTINCT txn FROM r JOIN w ON commit_txn > snapshot AND NOT unknown AND r.key IS NULL AND r.db = w.db")
def occ_scan_conflicts(t):
    touched, log = _occ(t)
    return relate.conflicts(touched.where("key is null"), log.where("not unknown"))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def kv_differences(t):
    return relate.differences(t("documents"), t("labels"), "doc_id")


@query("SELECT DISTINCT user_id AS k FROM events UNION SELECT DISTINCT c_custkey FROM customer")
def kv_keys_union(t):
    return relate.keys_union(t("events").select(F.col("user_id").alias("k")), t("customer").select("c_custkey"))


# --- queue --------------------------------------------------------------------------------------------------------------
NOW = 1_000_000
STATE = """SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'leased' WHEN 'error' THEN 'dead' ELSE 'ready' END AS state, (user_id % 6)::INT AS deliveries,
    CASE WHEN event_type = 'signup' THEN 999000 + user_id % 2 * 2000 ELSE 0 END AS expires_ns, CASE WHEN event_type = 'click' THEN 999500 + event_id % 900 ELSE 0 END AS lease_deadline_ns,
    CASE WHEN event_type = 'click' THEN event_id * 2 ELSE 0 END AS token FROM events"""


def _state(t):
    i = F.col("event_id")
    zero, user, kind = F.lit(0).cast("long"), F.col("user_id"), F.col("event_type")
    leased = kind == "click"
    return t("events").select(
        i.alias("seq"), F.when(leased, "leased").when(kind == "error", "dead").otherwise("ready").alias("state"), zero.alias("enqueued_ns"),
        F.when(kind == "signup", 999000 + user % 2 * 2000).otherwise(zero).alias("expires_ns"), (user % 6).cast("int").alias("deliveries"), F.lit(None).cast("string").alias("correlation_id"),
        F.encode("props", "UTF-8").alias("body"), F.lit(None).cast("string").alias("blob_key"), F.when(leased, 999500 + i % 900).otherwise(zero).alias("lease_deadline_ns"),
        F.when(leased, i * 2).otherwise(zero).alias("token"), F.lit(None).cast("string").alias("dead_reason"), zero.alias("dead_ns"),
    )


RECEIVE = f"""WITH r AS (SELECT *, expires_ns > 0 AND expires_ns <= {NOW} AS gone, deliveries + 1 > 5 AS spent FROM ({STATE}) WHERE state = 'ready'),
k AS (SELECT *, sum(CASE WHEN gone OR spent THEN 0 ELSE 1 END) OVER (ORDER BY seq) AS n FROM r)"""


@query(
    f"""{RECEIVE} SELECT seq, CASE WHEN gone OR spent THEN 'dead' ELSE 'leased' END AS state, (CASE WHEN gone OR spent THEN deliveries ELSE deliveries + 1 END)::INT AS deliveries,
    CASE WHEN gone OR spent THEN 0 ELSE {NOW} + 500 END::BIGINT AS lease_deadline_ns, (CASE WHEN gone OR spent THEN 0 ELSE 6 + n END)::BIGINT AS token,
    CASE WHEN gone THEN 'expired' WHEN spent THEN 'too many deliveries' END AS dead_reason FROM k WHERE (gone OR spent) AND n < 100 OR NOT (gone OR spent) AND n <= 100"""
)
def mq_receive_batch(t):
    return queue.receive(_state(t), NOW, 100, 5, lease_ns=500, next_token=7).select("seq", "state", "deliveries", "lease_deadline_ns", "token", "dead_reason")


@query(
    f"""{RECEIVE}, d AS (SELECT seq, CASE WHEN gone OR spent THEN 'dead' ELSE 'leased' END AS state FROM k WHERE (gone OR spent) AND n < 100 OR NOT (gone OR spent) AND n <= 100)
    SELECT s.seq, coalesce(d.state, s.state) AS state FROM ({STATE}) s LEFT JOIN d ON d.seq = s.seq"""
)
def mq_after_receive(t):
    state = _state(t)
    return queue.apply(state, queue.receive(state, NOW, 100, 5, lease_ns=500, next_token=7)).select("seq", "state")


@query(f"SELECT seq, body FROM (SELECT event_id AS seq, props AS body FROM events) WHERE seq = (SELECT min(seq) FROM ({STATE}) WHERE state = 'ready')")
def mq_peek(t):
    return queue.peek(_state(t)).select("seq", F.decode("body", "UTF-8").alias("body"))


RECEIPTS = "SELECT event_id AS seq, event_id * 2 + CASE WHEN value < 5 THEN 1 ELSE 0 END AS token FROM events WHERE event_type <> 'view'"


def _receipts(t):
    i = F.col("event_id")
    return t("events").where("event_type <> 'view'").select(i.alias("seq"), (i * 2 + F.when(F.col("value") < 5, 1).otherwise(0)).alias("token"))


@query(f"SELECT seq, state FROM ({STATE}) s WHERE NOT EXISTS (SELECT 1 FROM ({RECEIPTS}) r WHERE r.seq = s.seq AND r.token = s.token AND s.state = 'leased')")
def mq_ack(t):
    return queue.ack(_state(t), _receipts(t))[0].select("seq", "state")


@query(f"SELECT s.seq, CASE WHEN r.seq IS NOT NULL THEN 'ready' ELSE s.state END AS state, deliveries, CASE WHEN r.seq IS NOT NULL THEN 0 ELSE s.token END AS token FROM ({STATE}) s LEFT JOIN ({RECEIPTS}) r ON r.seq = s.seq AND r.token = s.token AND s.state = 'leased'")
def mq_nack(t):
    return queue.nack(_state(t), _receipts(t), False, NOW).select("seq", "state", "deliveries", "token")


@query(f"SELECT s.seq, CASE WHEN r.seq IS NOT NULL THEN 'rejected' END AS dead_reason, CASE WHEN r.seq IS NOT NULL THEN {NOW} ELSE 0 END::BIGINT AS dead_ns FROM ({STATE}) s LEFT JOIN ({RECEIPTS}) r ON r.seq = s.seq AND r.token = s.token AND s.state = 'leased'")
def mq_nack_dead(t):
    return queue.nack(_state(t), _receipts(t), True, NOW).select("seq", "dead_reason", "dead_ns")


DUE = f"SELECT seq FROM ({STATE}) WHERE state = 'leased' AND lease_deadline_ns <= {NOW} ORDER BY seq LIMIT 256"


@query(DUE)
def mq_due(t):
    return queue.due(_state(t), NOW).select("seq")


@query(f"SELECT seq, CASE WHEN seq IN ({DUE}) THEN 'ready' ELSE state END AS state FROM ({STATE})")
def mq_sweep(t):
    return queue.sweep(_state(t), NOW).select("seq", "state")


@query(f"SELECT seq FROM ({STATE}) WHERE state = 'dead' ORDER BY seq LIMIT 10")
def mq_dead(t):
    return queue.dead_letters(_state(t), 10).select("seq")


@query(f"SELECT count(*) AS purged FROM ({STATE}) WHERE state = 'dead'")
def mq_purge(t):
    return queue.purge(_state(t))[1]


@query(f"SELECT state, count(*) AS n FROM ({STATE}) GROUP BY state")
def mq_counts(t):
    return queue.counts(_state(t))


@query(f"SELECT seq FROM ({STATE}) WHERE state = 'ready' AND expires_ns > 0 AND expires_ns <= {NOW}")
def mq_ttl(t):
    return _state(t).where((F.col("state") == "ready") & queue.is_expired(NOW)).select("seq")


@query(f"SELECT (max(token) + 1)::BIGINT AS next_token FROM ({STATE})")
def mq_next_token(t):
    return queue.next_token(_state(t))


@query("SELECT (100 + row_number() OVER (ORDER BY doc_id))::BIGINT AS seq, doc_id, 5000000::BIGINT AS expires_ns FROM documents")
def mq_send(t):
    rows = t("documents").select("doc_id", F.col("doc_id").cast("string").alias("correlation_id"), F.encode("text", "UTF-8").alias("body"), F.lit(None).cast("string").alias("blob_key"))
    return queue.send(rows, 101, NOW, 4_000_000, ["doc_id"]).select("seq", F.col("correlation_id").cast("long").alias("doc_id"), "expires_ns")


# --- archives, replication, integrity -------------------------------------------------------------------------------------
LAYOUT = """SELECT doc_id, strlen(text)::BIGINT AS size, (512 + coalesce(sum(512 + ceil(strlen(text) / 512.0) * 512) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM documents"""


def _layout(t):
    members = t("documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return shapes.archive_layout(members, "doc_id", "size")


@query(LAYOUT)
def tar_layout(t):
    return _layout(t)


@query(
    f"""WITH l AS (SELECT d.source, l."offset" AS a, l."offset" + l.size AS b FROM ({LAYOUT}) l JOIN documents d ON d.doc_id = l.doc_id),
    m AS (SELECT *, max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM l),
    n AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 4096 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY a, b) AS run FROM m)
    SELECT source, min(a) AS lo, max(b) AS hi, count(*) AS n FROM n GROUP BY source, run"""
)
def tar_prefetch_runs(t):
    spans = _layout(t).join(t("documents").select("doc_id", "source"), "doc_id")
    return shapes.merged_spans(spans.select("source", F.col("offset").alias("a"), (F.col("offset") + F.col("size")).alias("b")), "source", "a", "b")


@query(f'SELECT doc_id, "offset" FROM ({LAYOUT}) WHERE "offset" >= (SELECT max("offset") // 2 FROM ({LAYOUT}))')
def blob_catchup(t):
    """Members past a mark in the middle of the archive."""
    layout = _layout(t)
    mark = (layout.agg(F.max("offset")).first()[0] or 0) // 2
    return layout.where(F.col("offset") >= mark).select("doc_id", "offset")


@query(f'SELECT source, doc_id, "offset" FROM (SELECT d.source, l.*, row_number() OVER (PARTITION BY d.source ORDER BY "offset" DESC) AS k FROM ({LAYOUT}) l JOIN documents d ON d.doc_id = l.doc_id) WHERE k = 1')
def blob_rebuild(t):
    rows = _layout(t).join(t("documents").select("doc_id", "source"), "doc_id").select("source", "doc_id", "offset")
    return mutate.last_writers(rows, "source", "offset")


@query("SELECT user_id AS page, max(event_id) AS txn FROM events GROUP BY 1")
def ship_coalesce(t):
    return shapes.newest_of(t("events").select(F.col("user_id").alias("page"), F.col("event_id").alias("txn")), "page", "txn")


SEGMENTS = "SELECT DISTINCT event_type AS store, (event_id // 10 * 10)::BIGINT AS a, (event_id // 10 * 10 + 9)::BIGINT AS b FROM events"


@query(
    f"""WITH s AS ({SEGMENTS}), l AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY store ORDER BY a) IS NULL OR a = lag(b) OVER (PARTITION BY store ORDER BY a) + 1 THEN 0 ELSE 1 END AS broken FROM s),
    k AS (SELECT *, coalesce(sum(broken) OVER (PARTITION BY store ORDER BY a DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM l)
    SELECT store, min(a) AS oldest, max(b) AS newest, count(*) AS n FROM k WHERE after = 0 GROUP BY store"""
)
def ship_contiguous(t):
    tens = F.floor(F.col("event_id") / 10)
    rows = t("events").select(F.col("event_type").alias("store"), (tens * 10).alias("a"), (tens * 10 + 9).alias("b"))
    return shapes.contiguous_tail(rows.distinct(), "store", "a", "b")


@query(
    """WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM l)
    SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, event_type, run"""
)
def map_runs(t):
    return shapes.runs(t("events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("SELECT coalesce(sum(CASE WHEN k <= p THEN 1 ELSE 0 END), 0)::BIGINT AS bad FROM (SELECT o_custkey AS k, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders)")
def integrity_order(t):
    return shapes.disorder(t("orders"), "o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def integrity_unique(t):
    return shapes.duplicates(t("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT source, count(*) AS entries, sum(strlen(text))::BIGINT AS bytes, (sum(strlen(text)) // count(*))::BIGINT AS bytes_per_entry FROM documents GROUP BY source")
def tree_stats(t):
    return shapes.tree_stats(t("documents"), F.octet_length("text"), "source")


@query("SELECT (event_id // 100)::BIGINT AS snapshot, count(*) AS readers FROM events GROUP BY 1")
def reader_histogram(t):
    return shapes.histogram(t("events").select(F.floor(F.col("event_id") / 100).alias("snapshot")), "snapshot")


@query("SELECT doc_id, lpad(format('{:o}', strlen(text)), 11, '0') AS size_field, strlen(text)::BIGINT AS size FROM documents")
def tar_size_fields(t):
    field = text_.octal(F.octet_length("text"))
    return t("documents").select("doc_id", field.alias("size_field"), text_.from_octal(field).alias("size"))


@query("SELECT doc_id, (length(regexp_replace(text, '[^\\x20-\\x7e]', '', 'g')) * 4 >= 3 * strlen(text)) AS as_text FROM documents")
def dump_mode(t):
    raw = F.encode("text", "UTF-8")
    return t("documents").select("doc_id", (text_.printable_share(raw) >= 0.75).alias("as_text"))


@query("SELECT event_id, (epoch_us(ts) * 1000)::BIGINT AS ns FROM events")
def event_nanos(t):
    return t("events").select("event_id", text_.nanos_of(F.col("ts")).alias("ns"))


#: XXH3-64 digests (seed 0) of the names of regions and nations.
GOLDEN = """VALUES
    ('AFRICA', '5aa141d88ace4f0c'), ('AMERICA', 'fcb5914837539001'), ('ASIA', '206960ac7dc20633'),
    ('EUROPE', '35367df723e3fdea'), ('MIDDLE EAST', '8fa89239b4f6b131'), ('NATION_0', 'cc857cb1532169dc'),
    ('NATION_1', '1c2df1eac0d6a519'), ('NATION_2', '06442d49d096c85d'), ('NATION_3', '326b5fc8619a6b1e'),
    ('NATION_4', '8fc65d7675f49ea6'), ('NATION_5', '5c9407d8a1a34364'), ('NATION_6', 'baa45b30886090c9'),
    ('NATION_7', '044325dcf3509f94'), ('NATION_8', 'ba86d849180f4b92'), ('NATION_9', '1a77d53b8dabf5ff'),
    ('NATION_10', 'bb63fe14789461b5'), ('NATION_11', '9920f5ffbb64e9f9'), ('NATION_12', 'e3b5055974b48692'),
    ('NATION_13', '6670f8f664b71382'), ('NATION_14', '0f8d78a1b5938026'), ('NATION_15', '10d40cf644ee55aa'),
    ('NATION_16', '4dbe5810be4d1325'), ('NATION_17', '9fa231e43c494811'), ('NATION_18', 'f0a06f6f9c599363'),
    ('NATION_19', '6016450b317b19f0'), ('NATION_20', '8c93b002de2f39e2'), ('NATION_21', '28db555f1fa1b732'),
    ('NATION_22', '8754b54accb77758'), ('NATION_23', '6fa2ed6de12c94c8'), ('NATION_24', '3a14cf709f45d10e')"""


@query(f"""WITH g(name, digest) AS ({GOLDEN}), n AS (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation)
    SELECT n.name, g.digest FROM n LEFT JOIN g ON g.name = n.name""")
def xxh3_verify(t):
    """Digests against fixed ones."""
    names = t("region").select(F.col("r_name").alias("name")).union(t("nation").select("n_name"))
    return names.select("name", F.lower(F.lpad(F.conv(xxh3_64("name").cast("string"), 10, 16), 16, "0")).alias("digest"))


@query()
def xxh3_digest(t):
    return t("documents").select("doc_id", xxh3_64("text").alias("digest"))
