"""Seeding sites as one procedure: pages of goals under each home page, their revisions, the homes' bodies, and what was done."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..sources.tables import written
from . import bodies, changes, tree


@dataclass(frozen=True)
class Seeded:
    """What seeding leaves: all pages, all revisions, and one row of goals_created, goals_updated and home_seeded."""

    pages: DataFrame
    revisions: DataFrame
    stats: DataFrame


def _raised(message: Column | str, kind: str) -> Column:
    return F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast(kind)


def _homes(pages: DataFrame, homes: DataFrame, force: bool) -> DataFrame:
    """home_path, home_id and due of each home; a path without page or with a page of another type is an error when this runs."""
    page = pages.select(F.col("path").alias("home_path"), F.col("page_id").alias("home_id"), "content_type", "show_subpages", "description", bodies.needs_reseed(F.col("body")).alias("reseed"))
    rows = homes.select(F.col("path").alias("home_path")).distinct().join(page, "home_path", "left")
    wrong = _raised(F.concat(F.lit("no web page at "), F.col("home_path")), "boolean")
    due = F.when(F.coalesce(F.col("content_type") == "webpage", F.lit(False)), changes.home_due(force, F.col("reseed"), F.col("show_subpages"), F.col("description"))).otherwise(wrong)
    return rows.select("home_path", "home_id", due.alias("due"))


def _planned(pages: DataFrame, goals: DataFrame, force: bool) -> DataFrame:
    """Each goal with its action, and the path and id of its page; created ones have the next ids, by home and order, and no path yet."""
    child = pages.withColumn("home_path", tree.parent_path(F.col("path"))).join(goals.select("home_path", "slug"), ["home_path", "slug"], "left_semi")
    first = F.min_by(F.struct("path", "page_id", "content_type", "description", bodies.needs_reseed(F.col("body")).alias("reseed")), "path").alias("have")
    rows = goals.join(child.groupBy("home_path", "slug").agg(first), ["home_path", "slug"], "left")
    action = changes.seed_action(F.col("have").isNotNull(), F.col("have.content_type") == "webpage", force, F.col("have.reseed"), F.col("have.description"))
    rows = rows.withColumn("action", action)
    created = F.when(F.col("action") == "created", 1).otherwise(0)
    nth = F.sum(created).over(Window.partitionBy("home_path").orderBy("order", "slug"))  # of the home's created ones
    counts = rows.groupBy("home_path").agg(F.sum(created).alias("_new"))
    before = Window.orderBy("home_path").rowsBetween(Window.unboundedPreceding, -1)  # a row per home
    counts = counts.select("home_path", F.coalesce(F.sum("_new").over(before), F.lit(0)).alias("_before"))
    last = pages.agg(F.coalesce(F.max("page_id"), F.lit(0))).scalar()
    rows = rows.withColumn("_nth", nth).join(counts, "home_path")
    page_id = F.when(F.col("action") == "created", last + F.col("_before") + F.col("_nth")).otherwise(F.col("have.page_id"))
    return rows.select(*goals.columns, "action", F.col("have.path").alias("path"), page_id.alias("page_id"))


def seed_sites(
    pages: DataFrame, revisions: DataFrame, homes: DataFrame, goals: DataFrame, head: Sequence[Column], home_description: str,
    goal_template: str, home_template: str, goals_title: str = "Goals", force: bool = False,
) -> Seeded:
    """Seeds the goals of each home, and the homes themselves.

    pages: page_id, path, depth, numchild, slug, title, content_type, template, body (array of type and
    value), description, show_subpages, and others, which stay and are null in new pages.  revisions: page_id, number, body.
    homes: path.  goals: home_path, order, slug, number, title, abstract, paragraphs, link_label, description;
    one row per home and slug.  head: the markup of a home's first three blocks.

    A goal whose slug no child of the home has becomes its last child.  One that is there, by the first path, is
    updated when forced, or when its body is old or its description blank; one of another type
    is left alone.  New and updated pages get a revision.  A home is seeded when forced, or when its body
    is old, its description blank, or subpages are shown: with cards that link to its goals' pages, in their
    order, and a revision.  It is an error, when the query runs, if a home is no web
    page, or one that is due has a goal without web page.  A second run changes nothing.

    What is to be done is a row per goal and home, written to the shared folder; pages and revisions
    are joined with it by path and id.
    """
    spark = pages.sparkSession
    todo = written(_planned(pages, goals, force), "seed-goals")
    linked = F.when(F.col("action") == "skipped", _raised(F.concat(F.lit("no web page for goal "), F.col("slug")), "bigint")).otherwise(F.col("page_id"))
    card = F.struct("order", "slug", markup.card(F.col("number"), F.col("title"), F.col("abstract"), linked, F.col("link_label")).alias("card"))
    due = _homes(pages, homes, force).where("due")
    cards = todo.join(due.select("home_path"), "home_path", "left_semi").groupBy("home_path").agg(F.transform(F.sort_array(F.collect_list(card)), lambda x: x["card"]).alias("cards"))
    no_cards = F.filter("cards", lambda _: F.lit(False))
    cards = due.join(cards, "home_path", "left").withColumn("cards", F.coalesce("cards", no_cards, F.array().cast(cards.schema["cards"].dataType)))
    home = written(cards.select(F.col("home_path").alias("path"), F.col("home_id").alias("page_id"), markup.home_body(*head, F.col("cards"), goals_title).alias("body")), "seed-homes")

    html = F.array(markup.html_block(markup.goal_html(F.col("title"), F.col("paragraphs"))))
    of_goals = todo.where("action IN ('created', 'updated')").withColumns({"body": html, "template": F.lit(goal_template)})
    to_set = of_goals.where("action = 'updated'").select("path", "body", "template", "description", F.lit(None).cast("boolean").alias("show_subpages"))
    to_set = to_set.unionByName(home.select("path", "body", F.lit(home_template).alias("template"), F.lit(home_description).alias("description"), F.lit(False).alias("show_subpages")))
    fields = ("body", "template", "description", "show_subpages")
    new_values = to_set.select("path", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_set"))
    after = pages.join(new_values, "path", "left")
    after = after.withColumns({c: F.when(F.col("_set") & (F.col(f"_{c}").isNotNull()), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields}).select(*pages.columns)

    made = {"page_id": F.col("page_id"), "slug": F.col("slug"), "title": F.col("title"), "content_type": F.lit("webpage"), "template": F.col("template"), "body": F.col("body"), "description": F.col("description"), "show_subpages": F.lit(False)}
    rest = [c for c in pages.columns if c not in made and c not in ("path", "depth", "numchild")]
    created = of_goals.where("action = 'created'").select(
        F.col("home_path").alias("parent_path"), F.struct("order", "slug").alias("order"), *[v.cast(pages.schema[c].dataType).alias(c) for c, v in made.items()], *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in rest])
    after = tree.add_children(after, created)

    shown = of_goals.select("page_id", "body").unionByName(home.select("page_id", "body"))
    stats = changes.counters(todo.select("action"), ["created", "updated"]).toDF("goals_created", "goals_updated").withColumn("home_seeded", home.agg(F.count("*")).scalar())
    return Seeded(after, changes.published(revisions, shown, "page_id", "number"), stats)
