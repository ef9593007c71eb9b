"""A third of all rows on one key: the executed plans split it."""

import pytest

from tidemark.llm import components, edit_embedding, warc
from tidemark.session import new_folder

LOW = {
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_of_a_hub(spark, low):
    links = spark.range(60_000).selectExpr("id + 1 as a", "if(id % 3 = 0, 0, id) as b").where("a > b")
    assert "skew=true" in executed(components._large_star(links, []))


def test_documents_of_one_fingerprint(spark, low):
    from pyspark.sql import functions as F

    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("0" * 128)).otherwise(F.repeat(F.sha2(F.col("id").cast("string"), 256), 2)).alias("fingerprint"))
    out = edit_embedding.with_near_copies(rows)
    assert "skew=true" in executed(out) and out.where("doc_id % 3 = 0 and near_id <> 0").isEmpty()


def test_pages_of_one_payload(spark, low):
    pages = spark.range(6_000).selectExpr("id as page_id", "'http://a' as url", "if(id % 3 = 0, repeat('x', 1500), repeat(sha2(string(id), 256), 25)) as html")
    assert "skew=true" in executed(warc._planned(pages))
    found = spark.range(60_000).selectExpr("if(id % 3 = 1, 'revisit', 'response') as kind", "concat('r', id) as record_id", "id as page_id", "if(id % 3 = 1, 'r0', null) as refers_to", "2000L as payload_bytes", "sha1(string(id)) as payload_digest", "cast(null as binary) as payload")
    resolved = warc.resolve(found)
    assert "skew=true" in executed(resolved) and resolved.where("record_type = 'revisit' and refers_to <> 0").isEmpty()


def test_a_folder_is_needed_on_a_cluster(spark, monkeypatch):
    """Without a shared folder a cluster is refused; here the folder that is set is used."""
    from tidemark import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session())
    assert new_folder(spark, "x").startswith("file:")
