import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.invoice import extract_invoices
from docloom.operators.lines import index_lines, with_zones
from docloom.operators.templates import TEMPLATE_SCHEMA, learn, lookup, merge_fields, quality, signatures
from docloom.plans.render import invoices
from docloom.session import checkpointed
from docloom.sources import files
from docloom.streaming.ingest import arriving, extract_each_batch, learn_each_batch, windowed_counts

SF = "/root/testdata/sf0.001"


def test_uploads_are_accepted_rejected_and_read(spark, tmp_path):
    for name, raw in (("a.txt", b"page one\fpage two"), ("b.pdf", b"%PDF"), ("c.exe", b"x"), ("d.png", b""), ("e.JPG", b"x")):
        (tmp_path / name).write_bytes(raw)
    uploads = files.read_uploads(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in files.rejected(uploads).collect()}
    assert errors == {"c.exe": "Unsupported file type"}

    def broken(raw):
        raise ValueError("no page")

    pages = files.recognize(uploads, {"image": broken}).collect()
    got = {(r.path.rsplit("/", 1)[1], r.page_no): (r.text, r.error) for r in pages}
    assert got == {("a.txt", 1): ("page one", None), ("a.txt", 2): ("page two", None), ("b.pdf", None): (None, "no engine for pdf"), ("e.JPG", None): (None, "ValueError: no page")}


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_page_tables(spark, tmp_path, format):
    df = spark.createDataFrame([(1, 1, "s", "a\nb"), (2, 1, None, "c")], "doc_id long, page_no int, source string, text string")
    df.write.format(format).option("header", "true").option("multiLine", "true").save(str(tmp_path / "x"))
    assert sorted((r.doc_id, r.text) for r in files.read_pages(spark, str(tmp_path / "x"), format).collect()) == [(1, "a\nb"), (2, "c")]


def test_envelopes_leave_nulls_out(spark):
    df = spark.createDataFrame([("f", "v", None, None), ("g", None, None, "bad")], "name string, a string, b string, error string")
    rows = {r.file_name: json.loads(r.response) for r in files.envelope(df, "name", F.lit("2025-01-01"), ["a", "b"]).collect()}
    assert rows["f"] == {"success": True, "timestamp": "2025-01-01", "file_name": "f", "data": {"a": "v"}}
    assert rows["g"] == {"success": False, "timestamp": "2025-01-01", "file_name": "g", "error": "bad"}


def test_templates_are_learnt_looked_up_and_stored(spark, tmp_path):
    docs = checkpointed(invoices(spark, SF).where("doc_id < 60"))
    signed = signatures(with_zones(index_lines(docs)))
    records = quality(extract_invoices(docs, F.lit("2025-01-01").cast("date"))).join(signed, "doc_id")
    empty = spark.createDataFrame([], TEMPLATE_SCHEMA)
    store = learn(empty, records)
    assert store.count() == records.select("vendor_name").distinct().count()
    assert sorted(map(str, learn(store, records).collect())) == sorted(map(str, store.collect()))
    files.write_templates(store, str(tmp_path / "t"))
    again = spark.read.schema(TEMPLATE_SCHEMA).json(str(tmp_path / "t"))
    found = lookup(signed, again).collect()
    assert all(r.template_id for r in found) and {r.match for r in found} <= {"exact", "layout"}
    old = again.withColumn("version", F.lit(2))
    assert all(r.template_id is None for r in lookup(signed, old).collect())


def test_template_values_win_where_valid(spark):
    generic = spark.createDataFrame([(1, "g", "h"), (2, None, "h")], "doc_id long, a string, b string")
    templated = spark.createDataFrame([(1, "t", None), (2, "bad", "t")], "doc_id long, a string, b string")
    rows = {r.doc_id: r for r in merge_fields(generic, templated, {"a": F.col("t_a") != "bad", "b": F.lit(True)}).collect()}
    assert (rows[1].a, rows[1].a_method, rows[1].b, rows[1].b_method) == ("t", "template", "h", "generic")
    assert (rows[2].a, rows[2].a_method, rows[2].b) == (None, None, "t")


def test_streams(spark, tmp_path):
    schema = "doc_id long, text string"
    invoices(spark, SF).limit(30).coalesce(3).write.parquet(str(tmp_path / "in"))
    source = arriving(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    as_of = F.lit("2025-01-01").cast("date")
    query = extract_each_batch(source, lambda b: extract_invoices(b, as_of).select("doc_id", "invoice_number"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.where("invoice_number is not null").count() == spark.read.parquet(str(tmp_path / "in")).count()

    def records(batch):
        return quality(extract_invoices(batch, as_of)).join(signatures(with_zones(index_lines(batch))), "doc_id")

    query = learn_each_batch(arriving(spark, str(tmp_path / "in"), schema), records, str(tmp_path / "store"), str(tmp_path / "cp2"), TEMPLATE_SCHEMA)
    query.awaitTermination()
    assert spark.read.schema(TEMPLATE_SCHEMA).parquet(str(tmp_path / "store" / "v=0")).count() > 0


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(arriving(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long, event_type string, value double, props string"), F.col("event_type"))
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select sum(n) from counted").first()[0] == events.count()
