"""Queries over pages decode what their SQL decodes, on pages that the given tables of small scale do not have."""

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidewell.functions import markup
from tidewell.jobs import queries as q

PAGES = [
    "<p>this and&amp</p><p>that &amp;lt; &amp;amp; &lt;b&gt; more than thirty characters</p>",
    "<li>&copy &copy; &eacute; &#233; &#xE9; &#91;edit&#93; &notin; &nbsp;x&apos;</li>",
    "<p>For &amp&lt; a<sup>1\r2</sup>b <!-- a\nb --> &quot;c&quot; and thirty characters more</p>",
    "",
]


@pytest.mark.parametrize("name", ["html_strip", "html_items", "html_description"])
def test_references_as_in_sql(spark, tmp_path, name):
    for t in oracle.TABLES:
        if t != "pages":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(PAGES)], "page_id long, url string, html string")
    pages.toPandas().to_parquet(tmp_path / "pages.parquet")
    assert oracle.of_spark(q.QUERIES[name](spark, str(tmp_path))) == oracle.of_sql(q.SQL[name], str(tmp_path))


def test_library_still_decodes_all(spark):
    assert spark.range(1).select(markup.stripped(F.lit("a&amp &eacute; &#233;")).alias("t")).first()["t"] == "a& é é"
