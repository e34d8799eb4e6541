"""Queries that go over the subject and its release many times join orders and lines once."""
from veiltab.catalog.audits import pair
from veiltab.catalog.matching import blocked, encoded
from veiltab.plans.views import release, subject, subject_and_release
from pyspark.sql import functions as F


def test_written_views_hold_the_rows_of_the_views(spark, sf):
    people, released = subject_and_release(spark, sf)
    for written, view in ((people, subject(spark, sf)), (released, release(spark, sf))):
        assert written.columns == view.columns
        assert written.select("segment", *written.columns[:2], "n_items").exceptAll(view.select("segment", *view.columns[:2], "n_items")).isEmpty()
        assert written.count() == view.count()


def test_vectors_are_made_from_written_views(spark, sf):
    p = pair(spark, sf)
    for df in (*encoded(spark, sf), *blocked(spark, sf, lambda a, c: F.col("segment")), p.population, p.release):
        assert not [f for f in df.inputFiles() if "lineitem" in f]
