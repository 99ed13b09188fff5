"""The limit of the URL filter follows the share of bad pages: a planted host is blocked by the query itself."""

import random

from pyspark.sql import functions as F

from cohortlens.llm import urls

GOOD = "<html><body><p>" + "plain words of a page that says something else here {} " * 8 + "</p></body></html>"


def planted(spark, tmp_path, often):
    r = random.Random(4)
    rows = []
    for k in range(1500):
        host = f"h{k % 40}.site{k % 10}.org" if k >= 60 else "spam.other.info"
        bad = r.random() < (often if k < 60 else 0.03)
        rows.append((k, f"http://{host}/p/{k}", "<p>x</p>" if bad else GOOD.replace("{}", str(k))))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return urls.op7_url_filter(spark, str(tmp_path)).where("rule is null").groupBy("host").agg(F.min("verdict").alias("a"), F.max("verdict").alias("b")).collect()


def test_a_planted_host_is_blocked_by_the_query(spark, tmp_path):
    got = {r["host"]: (r["a"], r["b"]) for r in planted(spark, tmp_path, 0.4)}
    assert got.pop("spam.other.info") == ("block", "block")
    assert len(got) == 40 and set(got.values()) == {("allow", "allow")}


def test_hosts_that_are_as_bad_as_all_are_allowed(spark, tmp_path):
    assert {(r["a"], r["b"]) for r in planted(spark, tmp_path, 0.03)} == {("allow", "allow")}


def test_the_limit_is_at_most_one_half_and_can_be_given(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", int(k % 2 or k % 3 == 0)) for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    said = lambda **how: {r["host"]: r["verdict"] for r in urls.judge_urls(pages, outcome=F.col("label"), **how).collect()}
    assert said() == {"h1.org": "block", "h0.org": "allow"}  # two thirds of all are bad
    assert said(limit=0.2) == {"h1.org": "block", "h0.org": "block"} and said(limit=0.999) == {"h1.org": "allow", "h0.org": "allow"}
