"""References at any depth, and the whole seed with a second run."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillgraph.operators import references, seeding
from quillgraph.plans import catalogue

from .test_plans import plan

BLOCKS = "array<struct<type:string,value:string>>"
PAGES = f"page_id long, path string, depth int, numchild int, slug string, title string, content_type string, template string, body {BLOCKS}, description string, show_subpages boolean, opacity double"
GOALS = "home_path string, `order` int, slug string, number string, title string, abstract string, paragraphs array<string>, link_label string, description string"


def walk(value, path=(), field=None):
    """References of a JSON value, by recursion."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from walk(v, (*path, k), (value["type"] if isinstance(value.get("type"), str) else "value") if k == "value" else k)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            yield from walk(v, (*path, str(k)), field)
    elif field in references.FIELDS and value is not None:
        try:
            yield ".".join(path), field, references.FIELDS[field], int(value)
        except ValueError:
            pass


def deep(n, value):
    return value if n == 0 else [{"type": "row", "value": {"content": [{"type": "column", "value": deep(n - 1, value)}]}}]


BODIES = [
    None, "", "not json", "[]", "{}", "3", "null", '[{"type": "page_link", "value": null}]',
    json.dumps([{"type": "page_link", "value": 5}, {"type": "html", "value": 6}, {"type": "image", "value": "7"}, {"type": "carousel", "value": "x"}]),
    json.dumps([{"type": "cardgrid", "value": {"fluid": True, "content": [{"type": "card", "value": {"image": 3, "links": [{"type": "Links", "value": {"page_link": 4, "doc_link": None, "other_link": ""}}]}}]}}]),
    json.dumps({"page": [1, 2, [3, {"image": [9, {"collection": 8}]}]], "value": {"page": {"page": 11}}, "type": 5, "é.ü": {"indexed_by": 2**40}}),
    *[json.dumps(deep(n, [{"type": "x", "value": {"page_link": n}}])) for n in range(1, 9)],
]


@pytest.mark.parametrize("levels", [1, 3, 4, 50])
def test_nested_references(spark, levels):
    pages = spark.createDataFrame(list(enumerate(BODIES)) + [(9, BODIES[8])], "page long, body string")
    got = references.nested_references(pages, "page", "body", levels=levels)
    rows = sorted((r.page, r.path, r.field, r.kind, r.target) for r in got.collect())
    want = []
    for k, body in [*enumerate(BODIES), (9, BODIES[8])]:
        try:
            want += [(k, *r) for r in walk(json.loads(body or ""))]
        except ValueError:
            pass
    assert rows == sorted(want) and len(rows) > 20
    assert references.nested_references(pages.where("false"), "page", "body").count() == 0


def test_orphans(spark):
    refs = references.nested_references(spark.createDataFrame([(1, BODIES[9])], "page long, body string"), "page", "body")
    there = spark.createDataFrame([(4,)], "id int")
    assert [(r.field, r.target) for r in references.orphaned(refs, {"page": there, "image": there}).collect()] == [("image", 3)]
    assert references.orphaned(refs, {"page": there}).count() == 0


def page(page_id, path, slug, kind="webpage", body=(("html", "kept"),), description="said", shown=False, numchild=0):
    return (page_id, path, len(path) // 4, numchild, slug, slug, kind, "old", None if body is None else [tuple(b) for b in body], description, shown, 0.4)


def goal(k, slug, home="00010001"):
    return (home, k, slug, str(k), f"Title {slug}", f"About <{slug}>", ["one & two", "three"], "More", f"described {slug}")


SITE = [
    page(1, "0001", "root", "root", None, numchild=1), page(2, "00010001", "home", body=(), description=None, shown=True, numchild=3),
    page(3, "000100010001", "old", body=[("section", "x")]), page(4, "000100010002", "blank", description=" \n"), page(7, "00010001000Z", "fine"),
    page(8, "000100010001000A", "new"),  # a slug of a goal, but not a child of the home
]


def frames(spark, pages=SITE, revisions=((3, 4),), homes=("00010001",)):
    return (
        spark.createDataFrame(pages, PAGES), spark.createDataFrame([(p, n, [("html", "r")]) for p, n in revisions], f"page_id long, number long, body {BLOCKS}"),
        spark.createDataFrame([(h,) for h in homes], "path string"),
    )


def run(pages, revisions, homes, goals, force=False):
    return seeding.seed_sites(pages, revisions, homes, goals, [F.lit("hero"), F.lit("mission"), F.lit("principle")], "home said", "goal.html", "home.html", force=force)


def stats(seeded):
    return seeded.stats.first().asDict()


def by_slug(df):
    return {(r.slug, r.path[:8]): r.asDict(True) for r in df.collect() if r.slug != "new" or r.page_id != 8}


def test_seed_and_second_run(spark):
    goals = spark.createDataFrame([goal(1, "new"), goal(2, "old"), goal(3, "fine"), goal(4, "blank"), goal(5, "newer")], GOALS)
    first = run(*frames(spark), goals)
    assert stats(first) == {"goals_created": 2, "goals_updated": 2, "home_seeded": 1}
    got = {r.page_id: r.asDict(True) for r in first.pages.collect()}
    assert len(got) == len(SITE) + 2
    home = got[2]
    assert [b["type"] for b in home["body"]] == ["html", "html", "html", "html", "cardgrid"]
    assert (home["description"], home["template"], home["show_subpages"], home["numchild"], home["opacity"]) == ("home said", "home.html", False, 5, 0.4)
    made = {r["slug"]: r for r in got.values() if r["page_id"] > 8}
    assert {s: (r["page_id"], r["path"], r["depth"], r["opacity"]) for s, r in made.items()} == {"new": (9, "000100010010", 3, None), "newer": (10, "000100010011", 3, None)}
    assert {"new", "old", "fine", "blank", "newer"} <= {r["slug"] for r in got.values() if r["path"][:8] == "00010001"}
    cards = json.loads(home["body"][4]["value"])["content"]
    assert [c["links"][0]["page_link"] for c in cards] == [9, 3, 7, 4, 10] and cards[0]["description"] == "<p>About &lt;new&gt;</p>"
    assert "<p>one &amp; two</p>" in got[3]["body"][0]["value"] and got[7]["body"] == [{"type": "html", "value": "kept"}] and got[4]["description"] == "described blank"
    assert sorted((r.page_id, r.number) for r in first.revisions.collect()) == [(2, 1), (3, 4), (3, 5), (4, 1), (9, 1), (10, 1)]

    again = run(first.pages, first.revisions, frames(spark)[2], goals)
    assert stats(again) == {"goals_created": 0, "goals_updated": 0, "home_seeded": 0}
    assert sorted(map(str, again.pages.collect())) == sorted(map(str, first.pages.collect()))
    assert again.revisions.count() == first.revisions.count()
    forced = run(first.pages, first.revisions, frames(spark)[2], goals, force=True)
    assert stats(forced) == {"goals_created": 0, "goals_updated": 5, "home_seeded": 1}
    assert {r.page_id: r.n for r in forced.revisions.groupBy("page_id").agg(F.max("number").alias("n")).collect()} == {2: 2, 3: 6, 4: 2, 7: 1, 9: 2, 10: 2}


def test_several_homes(spark):
    site = [page(1, "0001", "root", "root", None, numchild=2), page(2, "00010001", "a", body=[]), page(3, "00010002", "b", shown=True), page(4, "00010003", "c")]
    goals = spark.createDataFrame([goal(k, s, h) for h in ("00010001", "00010002") for k, s in enumerate(["x", "y"])], GOALS)
    done = run(*frames(spark, site, (), ("00010001", "00010002", "00010003")), goals)
    assert stats(done) == {"goals_created": 4, "goals_updated": 0, "home_seeded": 2}
    assert {(r.page_id, r.path) for r in done.pages.where("page_id > 4").collect()} == {(5, "000100010001"), (6, "000100010002"), (7, "000100020001"), (8, "000100020002")}
    none = run(*frames(spark, site, (), ("00010001",)), goals.where("false"))
    assert stats(none) == {"goals_created": 0, "goals_updated": 0, "home_seeded": 1}
    assert json.loads(none.pages.where("page_id = 2").first().body[4].value)["content"] == []


def test_pages_of_other_types(spark):
    article = page(5, "000100010003", "art", "article")
    goals = spark.createDataFrame([goal(1, "art")], GOALS)
    quiet = [page(2, "00010001", "home"), article]
    left = run(*frames(spark, quiet, ()), goals)
    assert stats(left) == {"goals_created": 0, "goals_updated": 0, "home_seeded": 0}
    assert sorted(map(str, left.pages.collect())) == sorted(map(str, frames(spark, quiet)[0].collect()))
    with pytest.raises(PySparkException, match="no web page for goal art"):
        run(*frames(spark, [page(2, "00010001", "home", shown=True), article], ()), goals).pages.collect()
    for site in ([page(2, "00010001", "home", "article")], [page(1, "0001", "root")]):
        with pytest.raises(PySparkException, match="no web page at 00010001"):
            stats(run(*frames(spark, site, ()), goals))


def test_parts_of_a_block_go_on_without_it(spark):
    """A list of n cards isn't copied n times: what is opened is no column of what it holds."""
    rows = spark.createDataFrame([(1, BODIES[8])], "id long, body string")
    empty = {"path": F.lit(None).cast("string"), "field": F.lit(None).cast("string"), "target": F.lit(None).cast("bigint"), "open": F.lit(True), "value": F.try_parse_json("body")}
    text = plan(references._deeper(rows.select("id", *[v.alias(k) for k, v in empty.items()]), references.FIELDS))
    carried = re.findall(r"Arguments: variant_explode\(.*?\), \[(.*?)\]", text)
    assert carried and all("_type" in c and "value" not in c for c in carried)


@pytest.mark.parametrize("levels", [1, 2])
def test_texts_that_look_open(spark, levels):
    bodies = [{"page": ["{}", "[1]", "{", " 7 ", {}, [], True, 2.0, None, [[]], {"page": {"content": [5]}}], "image": '{"page": 1}'}]
    got = references.nested_references(spark.createDataFrame([(1, json.dumps(bodies))], "page long, body string"), "page", "body", levels=levels)
    assert sorted((r.path, r.kind, r.target) for r in got.collect()) == [("0.page.10.page.content.0", "snippet", 5), ("0.page.3", "page", 7), ("0.page.6", "page", 1), ("0.page.7", "page", 2)]


def test_orders_meet_once_and_without_cards(spark, sf):
    """One list of plain rows per customer is moved; cards are made of it behind the shuffle."""
    text = plan(catalogue._nested_bodies(spark, sf))
    lists = {x for x in re.findall(r"partial_collect_list\((.*?)\)", text)}
    assert len(lists) == 1 and "card" not in lists.pop()
