"""Tags that differ in case only, in scripts beyond ASCII."""

from pyspark.sql import functions as F

from quillgraph.operators import links

from .test_plans import plan


def frame(spark, *tags):
    return spark.createDataFrame(list(enumerate(tags)), "id int, tag string")


def test_tagged_in_any_script(spark):
    tags = frame(spark, "École", "ÉCOLE", "ecole", "Привет", "ПРИВЕТ", None, "กข")
    items = spark.range(9).select(F.col("id").cast("int").alias("id"))
    found = lambda wanted: sorted(r.id for r in links.tagged(items, tags, "id", wanted).collect())
    assert (found("école"), found("привеТ"), found("กข"), found("x")) == ([0, 1], [3, 4], [6], [])


def test_pairs_and_clashes(spark):
    a, b = frame(spark, "Ü", "ü", "Éa", None, "z", "z"), frame(spark, "ü", "ÉA", "Z", "y", None)
    assert sorted(tuple(r) for r in links.same_tags(a, b, "tag").collect()) == [("z", "Z"), ("Éa", "ÉA"), ("Ü", "ü"), ("ü", "ü")]
    assert [tuple(r) for r in links.clashing_tags(a, "tag").collect()] == [("Ü", 2)]
    text = plan(links.same_tags(a, b, "tag"))
    assert "EvalPython" not in text and "NestedLoop" not in text and "Cartesian" not in text
