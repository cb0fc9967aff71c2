import zipfile

from pyspark.sql import functions as F

from strataform.plans import import_flow
from strataform.sources import documents, tables
from strataform.streaming import status_log


def test_docx(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>Dal</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>1 cup </w:t></w:r><w:r><w:t>lentils</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    rows = documents.docx_lines(tables.objects(spark, str(tmp_path), "*.docx")).orderBy("pos").collect()
    assert [(r["text"], r["tag"], r["bold"], r["list_type"]) for r in rows] == [("Dal", "h1", True, None), ("1 cup lentils", "li", False, "list")]


def test_reviewed(spark):
    good = "Plain Dal\nIngredients\n1 cup lentils\n2 cups water\n1 tsp salt\nMethod\nBoil the lentils in water with the salt until they are soft."
    df = spark.createDataFrame([(1, good), (2, "just\nsome text"), (3, None)], "id int, text string")
    rows = {r["id"]: r for r in import_flow.reviewed(df, "id").collect()}
    assert rows[1]["good"] and rows[1]["score"] == 100 and not rows[1]["rescued"]
    assert rows[2]["rescued"] and rows[2]["unassigned"] == ["just", "some text"] and not rows[2]["good"]
    assert rows[3]["rescued"] and not rows[3]["good"]


def test_titles(spark):
    df = spark.createDataFrame([("Red Dal", "Boil", "a.pdf"), ("%% 12 //", "Boil", "red_dal (1).pdf"), ("x", "दाल", "dal.pdf")], "t string, x string, f string")
    got = [r[0] for r in df.select(import_flow.title_for(F.col("t"), F.col("x"), F.col("f"))).collect()]
    assert got == ["Red Dal", "red dal", "dal (Hindi)"]


def test_blocked(spark):
    df = spark.createDataFrame([("Please solve the CAPTCHA " + "x" * 300,), ("recipe " * 60,), (None,)], "x string")
    assert [r[0] for r in df.select(import_flow.blocked_page(F.col("x"))).collect()] == [True, False, True]


def test_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.union(events.limit(5)).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = status_log.status_counts(status_log.distinct_events(stream, "60 days"), late=None).writeStream.format("memory").queryName("counts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    flat = events.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").count()
    assert spark.table("counts").join(flat, ["start", "event_type"]).where("n <> count").count() == 0
