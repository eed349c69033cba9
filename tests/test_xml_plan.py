"""Documents are put together without a job of the driver's and whatever order their rows come in."""

import pytest
from pyspark.sql import DataFrame

from lectern.sources import xml as X


def test_assembled_asks_the_driver_nothing(spark, monkeypatch):
    xml = '<a x="1">t<b>u</b>v<c><b /></c>w</a>'
    rows = X.elements(spark.createDataFrame([(1, xml), (2, "<a />")], "id long, xml string"), "id", "xml")
    with monkeypatch.context() as m:
        m.setattr(type(rows), "first", lambda self: pytest.fail("a job while the plan is made"))
        found: DataFrame = X.assembled(rows.select("*").repartition(3))
    assert {(r.id, r.path): r.xml for r in found.collect()} == {(1, "/a[0]"): xml, (2, "/a[0]"): "<a />"}


def test_documents_are_dealt_by_number(spark):
    """few bytes of lines are many documents, whose elements one task would take long for."""
    from lectern.plans.revisions import order_xml

    assert order_xml(spark, "/root/testdata/sf0.001", "old").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_digests_of_short_texts_are_those_of_the_plain_form():
    """a plain line takes a shorter way to its digest."""
    import hashlib
    import unicodedata

    from lectern.functions.layout import plain
    from lectern.sources.xml import digest

    for text in ("", " A  b-c ", "A\tB\x0bC\x1cd", "ﬁ–x", "co-\nop", "a.\nb", "a- \n b"):
        if text.isascii() and "\n" not in text:
            assert plain(text) == " ".join(unicodedata.normalize("NFKC", text).split())
        assert digest(text) == digest.__wrapped__(text) == hashlib.md5(plain(text).lower().encode()).hexdigest()
