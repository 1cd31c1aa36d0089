"""The page of the report."""

from pyspark.sql import functions as F

from tonelake.operators import report


def test_page_has_all_rows(spark, tmp_path):
    days = spark.range(1200).select(F.date_add(F.lit("1998-01-01").cast("date"), F.col("id").cast("int")).alias("day"), (F.col("id") % 7).alias("n_items"))
    report.write_page({"index": days.orderBy("day"), "channels": spark.range(501)}, [str(tmp_path / "a" / "r.html"), str(tmp_path / "b.html")])
    page = (tmp_path / "a" / "r.html").read_text()
    shown = [x.split("</td>")[0] for x in page.split("<h2>channels")[0].split("<tr><td>")[1:]]
    assert shown == [str(r.day) for r in days.orderBy("day").collect()]
    assert page.count("<tr><td>") == 1701 and page == (tmp_path / "b.html").read_text()
