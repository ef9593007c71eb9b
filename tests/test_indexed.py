from pyspark.sql import functions as F

from tidemark.functions import order
from tidemark.plans import inspect
from tidemark.plans.indexed import Indexed
from tidemark.plans.store import Store


def entry(key, value):
    """category \\0 price (4 bytes) id (8 bytes); values are ``price|name|category``."""
    fields = F.split(F.decode(value, "UTF-8"), r"\|")
    return order.composite(order.text_part(fields[2]), order.big_endian(fields[0].cast("long"), 4), key)


def test_catalogue(spark, tmp_path):
    store, table = Store.open(spark, str(tmp_path / "s")), Indexed("products", "by_category", entry)
    products = {1: (1999, "lamp", "light"), 2: (250, "bulb", "light"), 3: (9900, "desk", "desk"), 4: (12000, "table", "desk"), 5: (800, "torch", "light")}
    frame = lambda rows: spark.createDataFrame([(i.to_bytes(8, "big"), "|".join(map(str, r)).encode()) for i, r in rows.items()], "key binary, value binary")
    with store.write() as t:
        table.create(t)
        table.upsert(t, frame(products))
    found = lambda category: [int.from_bytes(r.key, "big") for r in table.lookup(store.snapshot(), category.encode() + b"\0").collect()]
    assert found("light") == [2, 5, 1] and found("desk") == [3, 4] and found("des") == []
    with store.write() as t:  # the price changes, the old entry goes
        table.upsert(t, frame({1: (100, "lamp", "light"), 6: (5, "chair", "desk")}))
        table.erase(t, frame({3: products[3]}))
    assert found("light") == [1, 2, 5] and found("desk") == [6, 4]
    assert store.snapshot().count("by_category") == store.snapshot().count("products") == 5 and inspect.check(store) == []
