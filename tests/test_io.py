import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.sources import files as FI
from quillspark.sources import sinks as SI
from quillspark.streaming import folds as ST


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"a.txt": b"hello", "sub/b.pdf": b"%PDF-1.7 x", "c.png": b"%PDF-1.4", "d.csv": b"\xff\xfea\x00", "big.bin": b"x" * 2000, "e.txt": b"\x80\x81"}
    for n, b in contents.items():
        (tmp_path / n).write_bytes(b)
    rows = {r.path.rsplit("/", 1)[1]: r for r in FI.scan_files(spark, str(tmp_path), most_bytes=1000).withColumn("text", FI.decoded("content")).collect()}
    assert rows["a.txt"].detected == "text/plain" and rows["a.txt"].text == "hello" and not rows["a.txt"].conflict
    assert rows["b.pdf"].detected == "application/pdf" and not rows["b.pdf"].conflict and rows["c.png"].conflict
    assert rows["d.csv"].text == "a" and rows["e.txt"].text is None and rows["e.txt"].conflict
    assert rows["big.bin"].content is None and rows["big.bin"].size == 2000
    assert spark.range(1).select(FI.media_type(F.lit(" Text/CSV ; charset=x"))).first()[0] == "text/csv"


def test_registry(spark, tmp_path):
    doc = {"document_id": "d1", "title": "T", "jurisdictions": ["EU"], "published_on": "2024-01-02", "last_checked_at": "2024-02-01T00:00:00Z", "other": 1}
    (tmp_path / "g.json").write_text(json.dumps({"documents": [doc], "relations": [{"source_document_id": "d1", "target_document_id": "d0", "relation_type": "amends", "effective_from": "2024-01-01"}]}, indent=1))
    tables = FI.guidance_registry(spark, str(tmp_path / "g.json"))
    assert str(tables["documents"].first().published_on) == "2024-01-02" and tables["relations"].first().relation_type == "amends"


def test_recorded_pages(spark, tmp_path):
    for p in (1, 2):
        (tmp_path / f"page{p}.json").write_text(json.dumps({"page": p, "items": [{"source_id": f"s{p}{i}", "title": "t"} for i in range(3)]}))
    spark.dataSource.register(FI.RecordedPages)
    df = spark.read.format("recorded_pages").option("path", str(tmp_path)).load()
    assert [r.source_id for r in df.orderBy("page", "position").collect()] == ["s10", "s11", "s12", "s20", "s21", "s22"]


def test_puts(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, p string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("c", "1"), ("d", "1"), ("d", "2"), ("e", None)], "id string, p string")
    fresh, conflicts = SI.new_objects(stored, new, ["id"], "p")
    assert sorted(r.id for r in fresh.collect()) == ["c", "e"] and sorted(r.id for r in conflicts.collect()) == ["b", "d"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1), (None, 2)], "a string, n int")
    SI.export_csv(df, str(tmp_path / "c"))
    assert sorted(r.a or "" for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["", "'=x"]
    SI.export_json(df, str(tmp_path / "j"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    with pytest.raises(Exception, match="exists"):
        SI.export_json(df, str(tmp_path / "j"))


def test_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    SI.write_snapshot({"t": spark.range(100).withColumn("v", F.col("id") * 2), "u": spark.range(0)}, path)
    assert {r.table: r.ok for r in SI.verify_snapshot(spark, path).collect()} == {"t": True, "u": True}
    spark.range(3).write.mode("overwrite").parquet(f"{path}/u")
    assert {r.table: r.ok for r in SI.verify_snapshot(spark, path).collect()} == {"t": True, "u": False}
    spark.range(0).write.mode("overwrite").parquet(f"{path}/u")
    spark.range(0).withColumn("v", F.col("id") * 2).write.mode("overwrite").parquet(f"{path}/t")
    assert {r.table: r.ok for r in SI.verify_snapshot(spark, path).collect()} == {"t": False, "u": True}
    spark.range(99).withColumn("v", F.col("id") * 2).write.mode("overwrite").parquet(f"{path}/t")
    assert not SI.verify_snapshot(spark, path).where("table = 't'").first().ok


def test_streams(spark, tmp_path):
    src, state, mark = (str(tmp_path / n) for n in ("src", "state", "mark"))
    rows = lambda *r: spark.createDataFrame(r, "k string, seq bigint, v string, at timestamp").coalesce(1)
    t = datetime(2024, 1, 1)
    rows(("a", 1, "x", t), ("b", 5, "y", t)).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema("k string, seq bigint, v string, at timestamp").parquet(src)
    ST.keep_latest(read(), ["k"], "seq", ["v"], state, mark).awaitTermination()
    rows(("a", 3, "z", t), ("b", 4, "late", t)).write.mode("append").parquet(src)
    ST.keep_latest(read(), ["k"], "seq", ["v"], state, mark).awaitTermination()
    assert sorted((r.k, r.seq, r.v) for r in ST.read_latest(spark, state).collect()) == [("a", 3, "z"), ("b", 5, "y")]
    first = ST.first_contents(read(), "k", "at", "1 day").writeStream.format("memory").queryName("firsts").option("checkpointLocation", mark + "2").trigger(availableNow=True).start()
    first.awaitTermination()
    assert sorted(r.k for r in spark.table("firsts").collect()) == ["a", "b"]
    counts = ST.counts_by_window(read(), "at", "1 hour", "1 minute", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", mark + "3").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert sorted((r.k, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 2)]


def test_quoted_rows(spark):
    texts = ['a;b;c\n1;"x\ny";3\n\n4;5', "", None, 'p,q\n"1","2,5"', "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", FI.quoted_rows("t").alias("r")).orderBy("i")
    got = [None if r.r is None else [tuple(x) for x in r.r] for r in df.collect()]
    assert got == [[(1, 1, 1, ["a", "b", "c"]), (2, 2, 3, ["1", "x\ny", "3"]), (3, 5, 5, ["4", "5", ""])], [], None, [(1, 1, 1, ["p", "q"]), (2, 2, 2, ["1", "2,5"])], [(1, 1, 1, ["one"])]]


def test_abstracts(spark):
    xml = '<A><Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText Label="RESULT">y</AbstractText></Abstract></A>'
    rows = FI.abstract_sections(spark.createDataFrame([(1, xml), (2, None), (3, "no xml")], "k int, x string"), "k", "x").collect()
    assert [(r.k, r.position, r.label, r.text) for r in rows] == [(1, 0, "AIM", "x"), (1, 1, "RESULT", "y")]


def test_guidance_tables(spark, tmp_path):
    doc = {"document_id": "d1", "title": "T", "status_changed_on": "2024-03-01", "provenance": {"canonical_url": "https://x.example", "retrieved_at": "2024-02-01T00:00:00Z"}}
    rec = {"recommendation_id": "r1", "document_id": "d1", "direction": "for", "applies_from": "2024-01-01", "jurisdictions": ["EU"]}
    (tmp_path / "g.json").write_text(json.dumps({"documents": [doc], "recommendations": [rec, rec]}, indent=1))
    tables = FI.guidance_tables(spark, str(tmp_path / "g.json"))
    assert tables["documents"].first().provenance.canonical_url == "https://x.example" and str(tables["documents"].first().status_changed_on) == "2024-03-01"
    assert tables["recommendations"].count() == 2 and str(tables["recommendations"].first().applies_from) == "2024-01-01" and tables["relations"].count() == 0


def test_source_catalogue(spark, tmp_path):
    good = {"source_id": "a", "canonical_hosts": ["a.example"], "domains": ["all"], "jurisdictions": ["GLOBAL"], "review_interval_days": 30}
    (tmp_path / "c.json").write_text(json.dumps({"sources": [good, {**good, "source_id": "b", "domains": ["x", "x"]}, {**good, "source_id": "c", "canonical_hosts": []}, {**good, "source_id": "c", "review_interval_days": 0}]}))
    got = sorted((r.source_id, tuple(r.rules)) for r in FI.source_catalogue(spark, str(tmp_path / "c.json")).collect())
    assert got == [("a", ()), ("b", ("domains",)), ("c", ("hosts", "id_twice")), ("c", ("id_twice", "review_interval"))]


def test_recorded_page_files(spark, tmp_path):
    for p in (1, 2):
        (tmp_path / f"page{p}.json").write_text(json.dumps({"page": p, "items": [{"source_id": f"s{p}{i}"} for i in range(2)]}))
    got = FI.recorded_pages(spark, str(tmp_path)).orderBy("page", "position").collect()
    assert [(r.page, r.position, r.source_id) for r in got] == [(1, 0, "s10"), (1, 1, "s11"), (2, 0, "s20"), (2, 1, "s21")]


def test_checkpoints_need_a_shared_folder():
    """Off a local master nothing falls back on a folder of one machine."""
    from types import SimpleNamespace as Fake

    from quillspark.session import ensure_checkpoint_dir

    jsc = Fake(sc=lambda: Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False)))
    spark = Fake(sparkContext=Fake(_jsc=jsc, master="spark://x:7077", getConf=lambda: {}))
    with pytest.raises(ValueError, match="shared"):
        ensure_checkpoint_dir(spark)
