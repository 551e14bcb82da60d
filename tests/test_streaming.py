"""The row-local pipeline on a stream."""

from weirgate.schema import META
from weirgate.streaming.stream import curate_stream


def test_stream_drops_exact_duplicates(spark, tmp_path):
    schema = f"record_id long, source string, messages array<struct<role:string,content:string>>, meta {META.simpleString()}, issues array<struct<stage:string,code:string,level:string,message:string>>, created_at timestamp"
    turns = lambda q: [("user", q), ("assistant", "请按时服药，注意休息，定期复查。")]
    rows = [(i, "s", turns(q), None, None, None) for i, q in enumerate(["电话13812345678，HR 90 正常吗？", "电话13912345678，HR 90 正常吗？", "短", "另一个问题，血糖偏高怎么办？"])]
    df = spark.createDataFrame(rows, schema).selectExpr("* except (created_at)", "timestamp'2026-01-01 00:00:00' as created_at")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = curate_stream(stream, "medical", "medical_qa")
    query = out.writeStream.format("memory").queryName("curated").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = [r.messages[0].content for r in spark.table("curated").orderBy("record_id").collect()]
    assert len(got) == 3  # the short question is long enough with its answer
    assert sum(g.startswith("电话[手机号],心率 90") for g in got) == 1
