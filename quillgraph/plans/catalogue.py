"""Queries over the driver's tables by name, with DuckDB SQL for the same rows.

The tables hold no pages, so each query applies an operator to what is most like
its rows: region, nation and customer are a tree of three levels; orders are the
dated children of customers; events are revisions or switches of users;
conversations are bodies of blocks; documents and labels are rows and their seed.
"""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calendar, markup, motion, text
from ..operators import alignment, bodies, changes, integrity, links, listing, ranked, references, search, seeding, tree
from ..sources import backups, imports, registry
from ..sources.tables import shared_path, table, written
from ..streaming import events as stream
from ..streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _long(name: str):
    return F.col(name).cast("long").alias(name)


# -- listings and order --------------------------------------------------------

_NEWEST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC)"


@query(f"SELECT o_custkey, o_orderkey, o_orderdate, place FROM (SELECT o_custkey, o_orderkey, o_orderdate, {_NEWEST} AS place FROM orders) WHERE place <= 3")
def r_latest_children(spark, sf):
    """The newest three orders of each customer."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return listing.top_per_parent(rows, "o_custkey", listing.newest_first("o_orderdate", "o_orderkey"))


@query(f"SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, {_NEWEST} AS place FROM orders WHERE (o_custkey % 2 = 0 AND o_orderstatus = 'O') OR (o_custkey % 2 = 1 AND o_orderstatus = 'F'))")
def r_index_listing(spark, sf):
    """Every index page (customer) lists one type (status), newest first."""
    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("content_type"), "o_orderdate", "o_orderkey")
    index = rows.select("o_custkey").distinct().withColumn("listed_type", F.when(F.col("o_custkey") % 2 == 0, "O").otherwise("F"))
    return listing.index_listing(rows, index, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ASC NULLS LAST, l_partkey) - 1 AS counter0, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ASC NULLS LAST, l_partkey) - 1) * 80 + 120 AS delay FROM lineitem")
def r_ordinal_stagger(spark, sf):
    """Places of ordered children, and their staggered delays."""
    rows = listing.with_place(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "counter0", motion.stagger(F.col("counter0"), 120, 80).cast("long").alias("delay"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def r_first_or_none(spark, sf):
    """The oldest open order."""
    return listing.first_or_none(table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def r_exactly_one(spark, sf):
    """The order with the largest key, which must be one row."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey").alias("o_orderkey"))
    return listing.exactly_one(orders.join(F.broadcast(last), "o_orderkey")).select("o_orderkey", "o_totalprice")


# -- tree ----------------------------------------------------------------------


def _tree(spark, sf) -> DataFrame:
    """region / nation / customer as paths of 4, 8 and 16 characters."""
    step = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    region = table(spark, sf, "region").select(step("r_regionkey", 4).alias("path"), F.lit(4).alias("step"), F.lit("region").alias("content_type"))
    nations = table(spark, sf, "nation").select(F.concat(step("n_regionkey", 4), step("n_nationkey", 4)).alias("path"), "n_nationkey")
    nation = nations.select("path", F.lit(4).alias("step"), F.lit("nation").alias("content_type"))
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(nations, "n_nationkey")
    customer = customer.select(F.concat("path", step("c_custkey", 8)).alias("path"), F.lit(8).alias("step"), F.lit("customer").alias("content_type"))
    return region.unionByName(nation).unionByName(customer)


_TREE = """WITH nodes AS (
  SELECT lpad(r_regionkey::VARCHAR, 4, '0') AS path, 4 AS step, 'region' AS content_type FROM region
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 4, '0') || lpad(n_nationkey::VARCHAR, 4, '0'), 4, 'nation' FROM nation
  UNION ALL SELECT lpad(n_regionkey::VARCHAR, 4, '0') || lpad(n_nationkey::VARCHAR, 4, '0') || lpad(c_custkey::VARCHAR, 8, '0'), 8, 'customer'
    FROM customer JOIN nation ON c_nationkey = n_nationkey) """


@query(_TREE + "SELECT p.path AS parent_path, c.path AS child_path FROM nodes c JOIN nodes p ON starts_with(c.path, p.path) AND length(c.path) = length(p.path) + c.step")
def r_tree_children(spark, sf):
    nodes = _tree(spark, sf)
    return tree.children(nodes, nodes, "step")


@query(_TREE + "SELECT p.path AS ancestor_path, c.path FROM nodes c JOIN nodes p ON starts_with(c.path, p.path) AND c.path <> p.path")
def r_tree_descendants(spark, sf):
    nodes = _tree(spark, sf)
    return tree.descendants(nodes, nodes, (4, 8, 16))


@query("SELECT n_nationkey, count(c_custkey) AS numchild FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def r_child_count(spark, sf):
    return tree.child_counts(table(spark, sf, "nation"), table(spark, sf, "customer"), "n_nationkey", "c_nationkey")


def _lines(spark, sf) -> DataFrame:
    """Orders and their lines as a tree: paths of 8 and 12 characters."""
    step = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    orders = table(spark, sf, "orders").select(step("o_orderkey", 8).alias("path"), F.col("o_orderstatus").alias("content_type"))
    return orders.unionByName(table(spark, sf, "lineitem").select(F.concat(step("l_orderkey", 8), step("l_linenumber", 4)).alias("path"), F.col("l_returnflag").alias("content_type")))


@query("SELECT lpad(o_orderkey::VARCHAR, 8, '0') || lpad((1 + coalesce(n, 0))::VARCHAR, 4, '0') AS path, 2 AS depth, 'page ' || o_orderkey AS title FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def r_add_children(spark, sf):
    """A new line under every order, as its last child."""
    nodes = _lines(spark, sf).select("path", F.when(F.length("path") == 8, 1).otherwise(2).alias("depth"), F.lit(0).alias("numchild"), F.lit(None).cast("string").alias("title"))
    new = table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("parent_path"), F.lit(1).alias("order"), F.concat(F.lit("page "), F.col("o_orderkey").cast("string")).alias("title"))
    return tree.add_children(nodes, new).where("title IS NOT NULL").select("path", "depth", "title")


@query("SELECT lpad(l_orderkey::VARCHAR, 8, '0') || lpad(l_linenumber::VARCHAR, 4, '0') AS path, l_returnflag AS content_type, o_orderstatus AS parent_type FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND coalesce(o_orderstatus, '') <> 'F'")
def r_type_violations(spark, sf):
    """Returned lines may only lie under finished orders."""
    return tree.type_violations(_lines(spark, sf), {"R": ["F"]})


# -- joins ---------------------------------------------------------------------


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def r_specific_join(spark, sf):
    nation = links.specific(table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey")
    return links.specific(table(spark, sf, "customer"), nation, "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name", "r_name")


@query("SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS has_rich FROM nation")
def r_exists_flag(spark, sf):
    return links.with_flag(table(spark, sf, "nation").select("n_nationkey"), table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey")), "n_nationkey", "has_rich")


@query("SELECT p_partkey, p_brand, CASE p_type WHEN '' THEN 'none' ELSE p_type END AS p_type, upper(p_brand) AS label FROM part")
def r_lookup(spark, sf):
    """A dictionary lookup in which a missing entry would be an error, and a default for empty text."""
    parts = table(spark, sf, "part")
    labels = parts.select("p_brand").distinct().withColumn("label", F.upper("p_brand"))
    return links.looked_up(parts, labels, "p_brand").select("p_partkey", "p_brand", text.or_default(F.col("p_type"), "none").alias("p_type"), "label")


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey")
def r_set_null(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return links.set_null(rows, table(spark, sf, "customer").where("c_acctbal < 0"), "o_custkey", "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def r_cascade(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return links.cascade(rows, table(spark, sf, "customer").where("c_acctbal < 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)")
def r_orphans(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return links.orphans(rows, table(spark, sf, "part").where("p_size < 45"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT a.doc_id AS page, a.lang AS from_locale, b.doc_id AS translation, b.lang AS to_locale FROM documents a JOIN documents b ON a.doc_id // 4 = b.doc_id // 4 AND a.lang <> b.lang")
def r_translations(spark, sf):
    pages = table(spark, sf, "documents").select(F.expr("doc_id div 4").alias("translation_key"), F.col("lang").alias("locale"), F.col("doc_id").alias("page_id"))
    return links.translations(pages)


@query("SELECT page_id, coalesce('/moved/' || p_partkey, '404') AS target FROM pages LEFT JOIN part ON p_partkey = page_id AND p_size > 25")
def r_redirects(spark, sf):
    moved = table(spark, sf, "part").where("p_size > 25").select(F.col("p_partkey").cast("string").alias("old_path"), F.concat(F.lit("/moved/"), F.col("p_partkey").cast("string")).alias("new_path"))
    requests = table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"))
    return links.redirected(requests, moved).select("page_id", "target")


@query("SELECT o_orderkey, array_to_string(list(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR ORDER BY l_linenumber, l_partkey), ', ') AS items FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def r_nested_children(spark, sf):
    """Ordered children as an array of each parent, then as text."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    got = links.nested(lines, "l_orderkey", "l_linenumber", ["l_linenumber", "l_partkey"])
    each = F.transform("items", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string")))
    return got.select(F.col("l_orderkey").alias("o_orderkey"), F.array_join(each, ", ").alias("items"))


@query("SELECT o_custkey, min(o_orderpriority) FILTER (o_orderstatus = 'F') AS F, min(o_orderpriority) FILTER (o_orderstatus = 'O') AS O, min(o_orderpriority) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_custkey")
def r_side_by_side(spark, sf):
    return links.side_by_side(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", ["F", "O", "P"])


_CONTENTS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, lead(doc_id) OVER (PARTITION BY left(text, 40) ORDER BY doc_id) AS other, string_split_regex(text, '[.\\n]+') AS p FROM documents),
pairs AS (SELECT a.doc_id, a.other, a.p AS l, b.p AS r FROM d a JOIN d b ON b.doc_id = a.other),
l AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS place FROM pairs),
r AS (SELECT doc_id, unnest(r) AS text, unnest(range(len(r))) AS place FROM pairs),
once AS (
  SELECT x.doc_id, x.place AS a, y.place AS b FROM (SELECT doc_id, text, any_value(place) AS place FROM l GROUP BY ALL HAVING count(*) = 1) x
  JOIN (SELECT doc_id, text, any_value(place) AS place FROM r GROUP BY ALL HAVING count(*) = 1) y USING (doc_id, text)),
seq AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM once GROUP BY doc_id),
len_(doc_id, a, b, lens) AS (
  SELECT doc_id, a, b, []::BIGINT[] FROM seq
  UNION ALL
  SELECT doc_id, a, b, list_append(lens, 1 + coalesce(list_max(list_filter(lens, lambda x, j: b[j] < b[len(lens) + 1])), 0)) FROM len_ WHERE len(lens) < len(b)),
full_ AS (SELECT * FROM len_ WHERE len(lens) = len(b)),
back(doc_id, a, b, lens, i) AS (
  SELECT doc_id, a, b, lens, len(lens) - list_position(list_reverse(lens), list_max(lens)) + 1 FROM full_
  UNION ALL
  SELECT doc_id, a, b, lens, list_max(list_filter(range(1, i), lambda j: lens[j] = lens[i] - 1)) FROM back WHERE lens[i] > 1),
kept AS (SELECT doc_id, a[i] AS a, b[i] AS b FROM back),
ln AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY place) - (gap > 0)::INT AS nth FROM (SELECT l.doc_id, place, count(k.a) OVER (PARTITION BY l.doc_id ORDER BY place) AS gap FROM l LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.a = place)),
rn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY place) - (gap > 0)::INT AS nth FROM (SELECT r.doc_id, place, count(k.b) OVER (PARTITION BY r.doc_id ORDER BY place) AS gap FROM r LEFT JOIN kept k ON k.doc_id = r.doc_id AND k.b = place))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY gap, nth) AS line, ln.place AS left_place, rn.place AS right_place,
  CASE WHEN rn.place IS NULL THEN 'left' WHEN ln.place IS NULL THEN 'right' WHEN nth = 0 THEN 'anchor' ELSE 'filled' END AS how
FROM ln FULL JOIN rn USING (doc_id, gap, nth)
"""


@query(_CONTENTS_SQL)
def r_master_contents(spark, sf):
    """Sentences of each document beside those of the next one that begins alike."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    alike = Window.partitionBy(F.left("text", F.lit(40))).orderBy("doc_id")
    works = documents.select("doc_id", F.lag("doc_id").over(alike).alias("earlier"), F.lead("doc_id").over(alike).alias("later"))
    passages = documents.select("doc_id", F.posexplode(F.split("text", "[.\\n]+")).alias("place", "text"))
    left = passages.join(works.where("later IS NOT NULL").select("doc_id"), "doc_id")
    right = passages.join(works.where("earlier IS NOT NULL").select("doc_id", "earlier"), "doc_id").select(F.col("earlier").alias("doc_id"), "place", "text")
    return alignment.aligned(left, right, ["doc_id"], "place", "text")



# -- bodies --------------------------------------------------------------------


def _bodies(spark, sf) -> DataFrame:
    """Conversations as bodies: an array of blocks with the role as type."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("type"), F.col("text").alias("value"))
    return links.nested(rows, "conv_id", "turn", ["type", "value"], "body")


@query("SELECT conv_id, bool_or(role = 'system') AS reseed FROM conversations GROUP BY conv_id")
def r_needs_reseed(spark, sf):
    kind = F.when(F.col("role") == "system", "section").otherwise("html")  # what system turns stand for
    rows = table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("type"), F.col("text").alias("value"))
    return links.nested(rows, "conv_id", "turn", ["type", "value"], "body").select("conv_id", bodies.needs_reseed(F.col("body")).alias("reseed"))


@query("SELECT conv_id, turn, role, CASE role WHEN 'assistant' THEN replace(text, 'a', '@') ELSE text END AS text FROM conversations")
def r_swap_blocks(spark, sf):
    """Blocks of one type are given another value; order and the other blocks stay."""
    got = _bodies(spark, sf).withColumn("body", bodies.swapped(F.col("body"), "assistant", lambda v: F.replace(v, F.lit("a"), F.lit("@"))))
    rows = got.select("conv_id", F.posexplode("body").alias("turn", "b"))
    return rows.select("conv_id", _long("turn"), F.col("b.type").alias("role"), F.col("b.value").alias("text"))


@query("SELECT conv_id, count(*) AS blocks, min_by(role, turn) AS first_type, max_by(role, turn) AS last_type, max(role) FILTER (turn = 5) AS sixth_type FROM conversations GROUP BY conv_id")
def r_block_positions(spark, sf):
    body = F.col("body")
    at = lambda k: bodies.block_at(body, k)["type"]
    return _bodies(spark, sf).select("conv_id", F.size(body).cast("long").alias("blocks"), at(0).alias("first_type"), at(-1).alias("last_type"), at(5).alias("sixth_type"))


@query("SELECT conv_id, 2 * count(*) + 1 AS blocks, max_by(role, turn) AS last_type FROM conversations GROUP BY conv_id")
def r_appended(spark, sf):
    """Each body with a block and itself behind it."""
    extra = F.array(F.struct(F.lit("html").alias("type"), F.lit("end").alias("value")))
    got = _bodies(spark, sf).select("conv_id", bodies.appended(F.col("body"), extra, F.col("body")).alias("body"))
    return got.select("conv_id", F.size("body").cast("long").alias("blocks"), bodies.block_at(F.col("body"), -1)["type"].alias("last_type"))


@query("SELECT conv_id, turn AS place, role AS type, length(text) AS chars FROM conversations")
def r_variant_blocks(spark, sf):
    """Bodies as JSON text, opened as variants."""
    raw = _bodies(spark, sf).select("conv_id", F.to_json("body").alias("raw"))
    rows = bodies.opened_up(raw, "conv_id", "raw")
    return rows.select("conv_id", "place", "type", F.length(F.try_variant_get("value", "$.value", "string")).cast("long").alias("chars"))


@query("SELECT event_id, event_type, (props::JSON->>'k')::BIGINT AS target, c_name FROM events LEFT JOIN customer ON c_custkey = (props::JSON->>'k')::BIGINT")
def r_block_references(spark, sf):
    """References inside JSON values, resolved where their target exists."""
    body = F.array(F.struct(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("value")))
    refs = bodies.references(table(spark, sf, "events").select("event_id", body.alias("body")), "body", "event_id")
    return refs.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("target"), "c_name"), "target", "left").select("event_id", F.col("type").alias("event_type"), "target", "c_name")


def _nested_bodies(spark, sf) -> DataFrame:
    """Customers as pages whose bodies hold a card per order: finished ones in a grid, open ones in a column of a row, pending ones two rows deep."""
    link = lambda x: F.struct(F.lit("Links").alias("type"), F.struct(x["o_orderkey"].alias("page_link"), F.when(x["o_orderkey"] % 7 == 0, F.col("o_custkey")).alias("doc_link"), F.lit("").alias("other_link")).alias("value"))
    card = lambda x: F.struct(F.lit("card").alias("type"), F.struct(x["o_orderpriority"].alias("title"), F.array(link(x)).alias("links")).alias("value"))
    cards = lambda status: F.transform(F.filter("orders", lambda x: x["o_orderstatus"] == status), card)
    holder = lambda kind, inside: F.struct(F.lit(kind).alias("type"), F.struct(inside.alias("content")).alias("value"))
    # orders meet as plain rows; cards are made of them afterwards
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"))).alias("orders"))
    rows = rows.select("o_custkey", cards("F").alias("f"), cards("O").alias("o"), cards("P").alias("p"))
    row = lambda inside: holder("row", F.array(holder("column", inside)))
    blocks = (holder("cardgrid", F.col("f")), row(F.col("o")), row(F.array(row(F.col("p")))), F.struct(F.lit("reusable_content").alias("type"), F.struct(F.col("o_custkey").alias("content")).alias("value")), F.struct(F.lit("carousel").alias("type"), F.col("o_custkey").alias("value")))
    return rows.select("o_custkey", F.concat(F.lit("["), F.concat_ws(",", *[F.to_json(b) for b in blocks]), F.lit("]")).alias("body"))


_NESTED_SQL = """
WITH RECURSIVE cards AS (
  SELECT o_custkey, o_orderstatus, to_json(list(json_object('type', 'card', 'value', json_object('title', o_orderpriority, 'links', json_array(json_object('type', 'Links', 'value',
    json_object('page_link', o_orderkey, 'doc_link', CASE WHEN o_orderkey % 7 = 0 THEN o_custkey END, 'other_link', ''))))) ORDER BY o_orderkey)) AS cards FROM orders GROUP BY o_custkey, o_orderstatus),
bodies AS (
  SELECT o_custkey, json_array(json_object('type', 'cardgrid', 'value', json_object('content', coalesce(any_value(cards) FILTER (o_orderstatus = 'F'), '[]'::JSON))),
    json_object('type', 'row', 'value', json_object('content', json_array(json_object('type', 'column', 'value', json_object('content', coalesce(any_value(cards) FILTER (o_orderstatus = 'O'), '[]'::JSON)))))),
    json_object('type', 'row', 'value', json_object('content', json_array(json_object('type', 'column', 'value', json_object('content', json_array(
      json_object('type', 'row', 'value', json_object('content', json_array(json_object('type', 'column', 'value', json_object('content', coalesce(any_value(cards) FILTER (o_orderstatus = 'P'), '[]'::JSON)))))))))))),
    json_object('type', 'reusable_content', 'value', json_object('content', o_custkey)), json_object('type', 'carousel', 'value', o_custkey)) AS body FROM cards GROUP BY o_custkey),
walk(o_custkey, path, field, value) AS (
  SELECT o_custkey, '', NULL::VARCHAR, body FROM bodies
  UNION ALL
  SELECT w.o_custkey, w.path || CASE WHEN w.path = '' THEN '' ELSE '.' END || e.key, CASE WHEN e.key = 'value' THEN w.value->>'type' WHEN json_type(w.value) = 'ARRAY' THEN w.field ELSE e.key END, e.value
  FROM walk w, json_each(w.value) e WHERE json_type(w.value) IN ('ARRAY', 'OBJECT')),
refs AS (
  SELECT o_custkey, path, field, CASE field WHEN 'page_link' THEN 'page' WHEN 'doc_link' THEN 'document' ELSE 'snippet' END AS kind, value::BIGINT AS target
  FROM walk WHERE field IN ('page_link', 'doc_link', 'content', 'carousel') AND json_type(value) IN ('UBIGINT', 'BIGINT'))
"""


@query(_NESTED_SQL + "SELECT * FROM refs")
def r_nested_references(spark, sf):
    """References at any depth of bodies."""
    return references.nested_references(_nested_bodies(spark, sf), "o_custkey", "body")


@query(_NESTED_SQL + "SELECT * FROM refs r WHERE kind = 'page' AND NOT EXISTS (FROM orders o WHERE o.o_orderkey = r.target AND o_totalprice < 100000) OR kind = 'document' AND NOT EXISTS (FROM part WHERE p_partkey = r.target)")
def r_orphaned_references(spark, sf):
    """References inside bodies to orders that count as deleted, or to parts that aren't there."""
    refs = references.nested_references(_nested_bodies(spark, sf), "o_custkey", "body")
    there = table(spark, sf, "orders").where("o_totalprice < 100000").select(F.col("o_orderkey").alias("id"))
    return references.orphaned(refs, {"page": there, "document": table(spark, sf, "part").select(F.col("p_partkey").alias("id"))})


# -- changes -------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'created' WHEN toxic = 1 THEN 'skipped' WHEN quality = 0 OR trim(lang) = '' THEN 'updated' ELSE 'unchanged' END AS action FROM documents LEFT JOIN labels l USING (doc_id)")
def r_upsert_actions(spark, sf):
    """Documents as seed, labelled ones as what exists: toxic ones are of another type, poor ones due."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    rows = docs.join(table(spark, sf, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    action = changes.seed_action(F.col("there").isNotNull(), F.col("toxic") == 0, False, F.col("quality") == 0, F.col("lang"))
    return rows.select("doc_id", action.alias("action"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS created, count(*) FILTER (quality = 0 AND toxic = 0) AS updated, count(*) FILTER (quality = 1 AND toxic = 0) AS unchanged, count(*) FILTER (toxic = 1) AS skipped FROM documents LEFT JOIN labels l USING (doc_id)")
def r_seed_counters(spark, sf):
    return changes.counters(r_upsert_actions(spark, sf), ["created", "updated", "unchanged", "skipped"])


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL OR (quality = 0 AND toxic = 0) THEN upper(lang) ELSE lang END AS description FROM documents LEFT JOIN labels l USING (doc_id)")
def r_seeded(spark, sf):
    """All rows after seeding."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    existing = docs.join(labels, "doc_id").select("doc_id", F.when(F.col("toxic") == 0, "webpage").otherwise("form").alias("content_type"), (F.col("quality") == 0).alias("needs_reseed"), F.col("lang").alias("description"))
    seed = docs.select("doc_id", F.upper("lang").alias("description"))
    return changes.seeded(existing, seed, "doc_id", ["description"])[0].select("doc_id", "description")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def r_get_or_create_anti(spark, sf):
    """Customers that a load of those with open orders would create."""
    have = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return changes.get_or_create(have, table(spark, sf, "customer").select("c_custkey"), "c_custkey")[1].where("created").select("c_custkey")


@query("SELECT user_id, count(*) AS revisions, arg_max(event_type, n) AS event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events UNION ALL SELECT user_id, 'published', count(*) + 1 FROM events GROUP BY user_id) GROUP BY user_id")
def r_published(spark, sf):
    """Events as numbered revisions of users, and one more of each user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    old = table(spark, sf, "events").select("user_id", "event_type", place.alias("n"))
    new = old.select("user_id").distinct().withColumn("event_type", F.lit("published"))
    got = changes.published(old, new, "user_id", "n")
    return got.groupBy("user_id").agg(F.count("*").alias("revisions"), F.max_by("event_type", "n").alias("event_type"))


@query("SELECT count(*) FILTER (l.doc_id IS NULL) > 0 AS created FROM documents LEFT JOIN labels l USING (doc_id)")
def r_seeded_any(spark, sf):
    """Whether a seed made any row."""
    return changes.any_counted(r_seed_counters(spark, sf), "created")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def r_latest_revision(spark, sf):
    return changes.current(table(spark, sf, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE NOT coalesce(c_mktsegment = 'BUILDING', false)")
def r_update_and_delete(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    rows = changes.without(rows, F.col("c_mktsegment") == "BUILDING")
    return changes.updated(rows, F.col("c_acctbal") < 0, c_mktsegment=F.lit("OVERDRAWN")).select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_nationkey = 3 AS seeded, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_nationkey = 3 THEN 'new' WHEN c_nationkey = 3 THEN ' ' ELSE c_name END AS description FROM customer")
def r_home_seed(spark, sf):
    """Customers as home pages: an old body, shown subpages or a blank description are reasons to seed them."""
    home = table(spark, sf, "customer").select(
        "c_custkey", F.lit("webpage").alias("content_type"), (F.col("c_mktsegment") == "BUILDING").alias("needs_reseed"), (F.col("c_acctbal") < 0).alias("show_subpages"),
        F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")).alias("description"), F.lit("old").alias("body"),
    )
    got = changes.home_seeded(home, F.lit("built"), "new")
    return got.select("c_custkey", (F.col("home_seeded") == 1).alias("seeded"), "description")


@query("SELECT CASE WHEN count(*) > 0 THEN 'created: ' || string_agg(n_name, ', ' ORDER BY n_name) ELSE 'nothing to create' END AS message, count(*) AS created FROM nation WHERE n_regionkey > 1")
def r_bootstrap(spark, sf):
    """A load of all nations where those of two regions are there."""
    nations = table(spark, sf, "nation").select("n_name", "n_regionkey")
    return changes.bootstrap(nations.where("n_regionkey <= 1"), nations, "n_name")[1]


@query("SELECT c_custkey, c_acctbal + CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END AS balance, c_nationkey < 12 AS moved FROM customer")
def r_migrated(spark, sf):
    """Two steps in order, of which the first was applied before."""
    steps = [
        ("0001", lambda rows: rows.withColumn("c_acctbal", F.lit(0.0))),
        ("0002", lambda rows: rows.withColumn("moved", F.col("c_nationkey") < 12)),
        ("0003", lambda rows: rows.withColumn("c_acctbal", F.col("c_acctbal") + F.when(F.col("moved"), 1).otherwise(0))),
    ]
    rows = changes.migrated(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), steps, ["0001"])[0]
    return rows.select("c_custkey", F.col("c_acctbal").alias("balance"), "moved")


@query("SELECT count(*) AS there, 0::BIGINT AS left_over, count(*) FILTER (c_acctbal < 0) AS loaded FROM customer")
def r_emptied(spark, sf):
    """A stored table that is emptied and loaded again: its rows before, after the deletion and after the load."""
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    rows = written(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "emptied")
    left = written(changes.emptied(rows), "emptied")
    loaded = written(left.unionByName(rows.where("c_acctbal < 0")), "emptied")
    return count(rows, "there").select("there", count(left, "left_over").scalar().alias("left_over"), count(loaded, "loaded").scalar().alias("loaded"))

_SEED_SQL = """
WITH b36 AS (SELECT '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS d),
base AS (
  SELECT r_regionkey::BIGINT AS page_id, NULL AS parent, r_regionkey + 1 AS nth, 1 AS depth, r_name AS slug, 'site' AS content_type, NULL AS body, r_name AS description, false AS shown FROM region
  UNION ALL SELECT 100 + n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 2, n_name, 'webpage', 'html:kept', n_name, n_nationkey % 3 = 0 FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 3, 'c' || c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'article' ELSE 'webpage' END,
    CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'section:old' ELSE 'html:kept' END, CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE c_name END, false FROM customer),
goals AS (
  SELECT 100 + s_nationkey AS home, s_suppkey AS o, 's' || s_suppkey AS slug, s_suppkey::VARCHAR AS number, s_name AS title, 'of ' || s_nationkey AS abstract, 'R&D <' || s_suppkey || '>' AS second FROM supplier
  UNION ALL SELECT 100 + c_nationkey, 1000000000 + c_custkey, 'c' || c_custkey, c_custkey::VARCHAR, c_name, c_mktsegment, 'R&D <' || c_custkey || '>' FROM customer WHERE c_acctbal < 0 AND (c_custkey % 11 <> 0 OR c_nationkey % 3 <> 0)),
planned AS (
  SELECT g.*, b.page_id AS old_id, CASE WHEN b.page_id IS NULL THEN 'created' WHEN b.content_type <> 'webpage' THEN 'skipped' WHEN b.body IN ('', 'section:old') OR trim(b.description) = '' THEN 'updated' ELSE 'unchanged' END AS action
  FROM goals g LEFT JOIN base b ON b.parent = g.home AND b.slug = g.slug AND b.depth = 3),
todo AS (
  SELECT *, CASE WHEN action = 'created' THEN (SELECT max(page_id) FROM base) + sum((action = 'created')::INT) OVER (ORDER BY n_regionkey, n_nth, o, slug) ELSE old_id END AS page_id,
    (SELECT count(*) FROM base WHERE parent = home AND depth = 3) + sum((action = 'created')::INT) OVER (PARTITION BY home ORDER BY o, slug) AS nth
  FROM planned JOIN (SELECT 100 + n_nationkey AS home, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n_nth FROM nation) USING (home)),
escaped AS (SELECT x, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS y FROM (SELECT DISTINCT unnest([title, second, abstract]) AS x FROM goals)),
told AS (SELECT t.*, a.y AS title_, b.y AS second_, c.y AS abstract_ FROM todo t JOIN escaped a ON a.x = t.title JOIN escaped b ON b.x = t.second JOIN escaped c ON c.x = t.abstract),
goal_body AS (SELECT page_id, home, o, slug, nth, action, title, 'html:<div class="goal-detail">' || chr(10) || '  <h1 class="goal-detail-title">' || title_ || '</h1>' || chr(10) || '  <div class="goal-detail-body">' || chr(10)
  || '    <p>' || title_ || '</p>' || chr(10) || '    <p>' || second_ || '</p>' || chr(10) || '  </div>' || chr(10) || '</div>' AS body FROM told),
home_body AS (
  SELECT b.page_id, 'html:hero|html:mission|html:principle|html:<div class="home-section home-section--goals">' || chr(10) || '  <h2 class="home-section-title">Goals</h2>' || chr(10) || '</div>|cardgrid:'
    || json_object('settings', json_object('custom_template', '', 'custom_css_class', 'home-goals', 'custom_id', ''), 'fluid', true, 'content', coalesce(to_json(list(json_object(
      'settings', json_object('custom_template', '', 'custom_css_class', 'home-goal-card', 'custom_id', ''), 'image', NULL, 'title', t.title, 'subtitle', t.number, 'description', '<p>' || t.abstract_ || '</p>',
      'links', json_array(json_object('settings', json_object('custom_template', '', 'custom_css_class', '', 'custom_id', '', 'ga_tracking_event_category', '', 'ga_tracking_event_label', ''),
        'page_link', t.page_id::BIGINT, 'doc_link', NULL, 'other_link', '', 'button_title', 'More', 'button_style', 'btn-link', 'button_size', ''))) ORDER BY t.o, t.slug) FILTER (t.page_id IS NOT NULL)), '[]'::JSON))::VARCHAR AS body
  FROM base b LEFT JOIN told t ON t.home = b.page_id WHERE b.depth = 2 AND b.shown GROUP BY b.page_id),
step AS (SELECT n, d[n // 46656 % 36 + 1] || d[n // 1296 % 36 + 1] || d[n // 36 % 36 + 1] || d[n % 36 + 1] AS s FROM range(1, (SELECT max(nth)::BIGINT + 1 FROM (SELECT nth FROM base UNION ALL SELECT nth FROM todo))) AS x(n), b36),
"""


def _site(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, homes and goals: regions are sites, nations homes, customers pages; goals are suppliers, which have no page yet, and customers in debt."""

    def page(name, key, parent, slug, kind, body, description, shown, depth, page_id):
        nth = F.row_number().over(Window.partitionBy(parent).orderBy(key)) if parent else F.col(key) + 1
        return table(spark, sf, name).select(
            "*", page_id.cast("long").alias("page_id"), tree.step_text(nth).alias("_step"), F.lit(depth).alias("depth"), slug.alias("slug"), slug.alias("title"), kind.alias("content_type"),
            F.lit("old").alias("template"), body.alias("body"), description.alias("description"), shown.alias("show_subpages"),
        )

    block = lambda kind, value: F.array(F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value")))
    blocks, c = "array<struct<type:string,value:string>>", F.col("c_custkey")
    body = F.when(c % 3 == 0, F.array().cast(blocks)).when(c % 3 == 1, block("section", "old")).otherwise(block("html", "kept"))
    regions = page("region", "r_regionkey", None, F.col("r_name"), F.lit("site"), F.lit(None).cast(blocks), F.col("r_name"), F.lit(False), 1, F.col("r_regionkey")).withColumn("path", F.col("_step"))
    nations = page("nation", "n_nationkey", "n_regionkey", F.col("n_name"), F.lit("webpage"), block("html", "kept"), F.col("n_name"), F.col("n_nationkey") % 3 == 0, 2, F.col("n_nationkey") + 100)
    nations = nations.join(regions.select(F.col("r_regionkey").alias("n_regionkey"), F.col("path").alias("_up")), "n_regionkey").withColumn("path", F.concat("_up", "_step"))
    homes = nations.select("path", "n_nationkey")
    customers = page("customer", "c_custkey", "c_nationkey", F.concat(F.lit("c"), c), F.when(c % 11 == 0, "article").otherwise("webpage"), body, F.when(c % 5 == 0, "  ").otherwise(F.col("c_name")), F.lit(False), 3, c + 1000)
    customers = customers.join(homes.select(F.col("n_nationkey").alias("c_nationkey"), F.col("path").alias("_up")), "c_nationkey").withColumn("path", F.concat("_up", "_step"))
    columns = ["page_id", "path", "depth", "slug", "title", "content_type", "template", "body", "description", "show_subpages"]
    pages = regions.select(columns).unionByName(nations.select(columns)).unionByName(customers.select(columns))
    counts = pages.groupBy(tree.parent_path(F.col("path")).alias("path")).agg(F.count("*").alias("numchild"))
    pages = pages.join(counts, "path", "left").withColumn("numchild", F.coalesce("numchild", F.lit(0)).cast("long"))

    def goal(rows, nation, order, key, prefix, title, abstract):
        rows = rows.join(homes.select(F.col("n_nationkey").alias(nation), F.col("path").alias("home_path")), nation)
        number = F.col(key).cast("string")
        return rows.select(
            "home_path", order.cast("long").alias("order"), F.concat(F.lit(prefix), number).alias("slug"), number.alias("number"), F.col(title).alias("title"), abstract.alias("abstract"),
            F.array(F.col(title), F.concat(F.lit("R&D <"), number, F.lit(">"))).alias("paragraphs"), F.lit("More").alias("link_label"), F.concat(F.lit("About "), F.col(title)).alias("description"),
        )

    owing = table(spark, sf, "customer").where((F.col("c_acctbal") < 0) & ((c % 11 != 0) | (F.col("c_nationkey") % 3 != 0)))
    goals = goal(table(spark, sf, "supplier"), "s_nationkey", F.col("s_suppkey"), "s_suppkey", "s", "s_name", F.concat(F.lit("of "), F.col("s_nationkey").cast("string")))
    return pages, homes.select("path"), goals.unionByName(goal(owing, "c_nationkey", c + 1_000_000_000, "c_custkey", "c", "c_name", F.col("c_mktsegment")))


def _seeded(spark, sf) -> seeding.Seeded:
    pages, homes, goals = _site(spark, sf)
    revisions = pages.where("page_id % 2 = 0").select("page_id", F.lit(1).cast("long").alias("number"), "body")
    return seeding.seed_sites(pages, revisions, homes, goals, [F.lit("hero"), F.lit("mission"), F.lit("principle")], "all goals", "goal.html", "home.html")


def _body_text(body):
    return F.md5(F.array_join(F.transform(body, lambda b: F.concat(b["type"], F.lit(":"), b["value"])), "|"))


@query(_SEED_SQL + """nodes AS (
  SELECT b.page_id, b.parent, b.nth, b.depth, b.slug, b.slug AS title, b.content_type, coalesce(g.body, h.body, b.body) AS body, CASE WHEN h.body IS NOT NULL THEN 'home.html' WHEN g.body IS NOT NULL THEN 'goal.html' ELSE 'old' END AS template,
    CASE WHEN h.body IS NOT NULL THEN 'all goals' WHEN g.body IS NOT NULL THEN 'About ' || g.title ELSE b.description END AS description, b.shown AND h.body IS NULL AS show_subpages
  FROM base b LEFT JOIN home_body h USING (page_id) LEFT JOIN (FROM goal_body WHERE action = 'updated') g USING (page_id)
  UNION ALL SELECT page_id::BIGINT, home, nth::BIGINT, 3, slug, title, 'webpage', body, 'goal.html', 'About ' || title, false FROM goal_body WHERE action = 'created'),
p AS (SELECT n.*, s FROM nodes n JOIN step ON step.n = n.nth)
SELECT p.page_id, coalesce(up2.s, '') || coalesce(up.s, '') || p.s AS path, p.depth, p.slug, p.title, p.content_type, p.template, md5(p.body) AS body, p.description, p.show_subpages,
  (SELECT count(*) FROM nodes c WHERE c.parent = p.page_id AND c.depth = p.depth + 1) AS numchild
FROM p LEFT JOIN p up ON up.page_id = p.parent AND up.depth = p.depth - 1 LEFT JOIN p up2 ON up2.page_id = up.parent AND up2.depth = p.depth - 2""")
def r_seed_pages(spark, sf):
    """All pages after the homes of all nations have been seeded."""
    return _seeded(spark, sf).pages.withColumn("body", _body_text(F.col("body")))


@query(_SEED_SQL + """shown AS (SELECT page_id, body FROM goal_body WHERE action IN ('created', 'updated') UNION ALL SELECT page_id, body FROM home_body)
SELECT page_id, 1::BIGINT AS number, md5(body) AS body FROM base WHERE page_id % 2 = 0
UNION ALL SELECT page_id::BIGINT, CASE WHEN page_id % 2 = 0 AND page_id IN (SELECT page_id FROM base) THEN 2 ELSE 1 END, md5(body) FROM shown""")
def r_seed_revisions(spark, sf):
    """Revisions of the pages that seeding made or changed, behind those there were."""
    return _seeded(spark, sf).revisions.withColumn("body", _body_text(F.col("body")))


@query(_SEED_SQL + "nothing AS (SELECT 1) SELECT count(*) FILTER (action = 'created') AS goals_created, count(*) FILTER (action = 'updated') AS goals_updated, (SELECT count(*) FROM home_body) AS home_seeded FROM todo")
def r_seed_stats(spark, sf):
    """How many goals were created and updated, and how many homes seeded."""
    return _seeded(spark, sf).stats


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders),
d AS (SELECT '2024-01-01' AS day, * FROM a WHERE o_orderstatus <> 'P' UNION ALL SELECT '2024-01-02', o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END, o_totalprice FROM a
  UNION ALL SELECT '2024-01-04', o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END, o_totalprice FROM a WHERE o_custkey % 10 > 0)
SELECT *, CASE day WHEN '2024-01-01' THEN (SELECT count(*) FROM a WHERE o_orderstatus <> 'P') WHEN '2024-01-02' THEN (SELECT count(*) FROM a WHERE o_orderstatus = 'P') ELSE (SELECT count(*) FROM a WHERE o_custkey % 10 = 0) END AS written FROM d""")
def r_restored_days(spark, sf):
    """Orders restored to three of four days of backups, with the rows that each day wrote: all, new ones, and those that were gone; on the third day nothing changed."""
    folder = shared_path(spark, "backups")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    done = orders.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    days = {"2024-01-01": orders.where("o_orderstatus <> 'P'"), "2024-01-02": done, "2024-01-03": done, "2024-01-04": done.where("o_custkey % 10 > 0")}
    for day, rows in days.items():
        backups.back_up(rows, folder, day, ["o_orderkey"])
    out = None
    for day in ("2024-01-01", "2024-01-02", "2024-01-04"):
        wrote = spark.read.parquet(f"{folder}/day={day}").agg(F.count("*")).scalar()
        rows = backups.restored(spark, folder, day, ["o_orderkey"]).select(F.lit(day).alias("day"), "*", wrote.alias("written"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH n AS (SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'n_regionkey: no region 3' END AS reason FROM nation),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 97 = 5 THEN 'no row' WHEN reason IS NOT NULL THEN 'c_nationkey: no nation ' || c_nationkey || ', it was set aside' END AS reason FROM customer JOIN n ON n_nationkey = c_nationkey),
o AS (SELECT o_orderkey, CASE WHEN reason IS NOT NULL THEN 'o_custkey: no customer ' || o_custkey || ', it was set aside' END AS reason FROM orders LEFT JOIN c ON c_custkey = o_custkey)
SELECT 'nation' AS name, n_nationkey::BIGINT AS id, reason FROM n WHERE reason IS NOT NULL UNION ALL SELECT 'customer', c_custkey, reason FROM c WHERE reason IS NOT NULL UNION ALL SELECT 'orders', o_orderkey, reason FROM o WHERE reason IS NOT NULL""")
def r_catalogue_import(spark, sf):
    """What an import of regions, nations, customers and orders from CSV sets aside when a region is missing and some lines of customers are broken."""
    folder = shared_path(spark, "catalogue")
    broken = F.when(F.col("c_custkey") % 97 == 5, "?").otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey")
    files = {
        "region": table(spark, sf, "region").where("r_regionkey <> 3").select("r_regionkey", "r_name"), "nation": table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"),
        "customer": table(spark, sf, "customer").select("c_custkey", broken, "c_name"), "orders": table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"),
    }
    kinds = {
        "region": ("r_regionkey int, r_name string", "r_regionkey", {}), "nation": ("n_nationkey int, n_regionkey int, n_name string", "n_nationkey", {"n_regionkey": "region"}),
        "customer": ("c_custkey long, c_nationkey int, c_name string", "c_custkey", {"c_nationkey": "nation"}), "orders": ("o_orderkey long, o_custkey long, o_orderstatus string", "o_orderkey", {"o_custkey": "customer"}),
    }
    for name, rows in files.items():
        rows.write.option("header", True).csv(f"{folder}/{name}")
    got = imports.import_tables(spark, [imports.Table(name, f"{folder}/{name}", *kinds[name]) for name in reversed(kinds)])
    out = None
    for name, (_, key, _) in kinds.items():
        aside = got[name].aside.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("id"), "reason")
        out = aside if out is None else out.unionByName(aside)
    return out


@query("""WITH p AS (SELECT DISTINCT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) + 1 AS page FROM events),
b AS (SELECT *, coalesce(lag(page) OVER (PARTITION BY user_id ORDER BY page), 0) AS before FROM p)
SELECT user_id, before + 1 AS first, page - 1 AS last FROM b WHERE page > before + 1""")
def r_missing_pages(spark, sf):
    """Ranges of days without events of a user, as pages that are missing from a book."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return registry.missing_pages(table(spark, sf, "events").select("user_id", day.alias("page")), "user_id", "page")


@query("""WITH p AS (SELECT user_id, date_diff('day', TIMESTAMP '2024-01-01', ts) + 1 AS page, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, page - row_number() OVER (PARTITION BY user_id ORDER BY page) AS run FROM p)
SELECT user_id, min(page) AS first, max(page) AS last, sum(n)::BIGINT AS scans FROM r GROUP BY user_id, run""")
def r_page_runs(spark, sf):
    """Runs of days with events of a user."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1
    return registry.page_runs(table(spark, sf, "events").select("user_id", day.alias("page")), "user_id", "page")


# -- sets ----------------------------------------------------------------------


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS ok FROM orders GROUP BY o_custkey")
def r_issubset(spark, sf):
    """Whether {F, O} is among each customer's statuses."""
    have = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("have"))
    return have.select("o_custkey", integrity.has_all(F.col("have"), ["F", "O"]).alias("ok"))


@query("SELECT lang, list_sort(list(DISTINCT source)) = list_sort(list(DISTINCT source) FILTER (doc_id % 2 = 0)) AS same FROM documents GROUP BY lang")
def r_set_equality(spark, sf):
    even = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    got = table(spark, sf, "documents").groupBy("lang").agg(F.collect_set("source").alias("a"), F.collect_set(even).alias("b"))
    return got.select("lang", integrity.same_members(F.col("a"), F.col("b")).alias("same"))


# -- scalar functions ----------------------------------------------------------


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def r_html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_escape(F.col("html"))).alias("digest"))


@query("SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: w[1:1]), '') AS initials FROM documents")
def r_acronym(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.initials(F.col("text")).alias("initials"))


@query("""WITH e AS (SELECT event_id, value * 10 AS y, 1000.0 AS h FROM events), g AS (SELECT event_id, y, k AS layer, y / (h / 4) AS t FROM e, range(4) r(k))
SELECT event_id, layer, CASE WHEN t <= 0 THEN (CASE layer WHEN 0 THEN 0.4 ELSE 0 END) WHEN t >= 3 THEN (CASE layer WHEN 3 THEN 0.4 ELSE 0 END)
  WHEN layer = floor(t) THEN (1.0::DOUBLE - (t - floor(t))) * 0.4::DOUBLE WHEN layer = floor(t) + 1 THEN (t - floor(t)) * 0.4::DOUBLE ELSE 0 END::DOUBLE AS opacity FROM g""")
def r_crossfade(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") * 10).alias("y"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(4)])).alias("layer"))
    return rows.select("event_id", "layer", motion.crossfade(F.col("y"), F.lit(1000.0), F.lit(4), F.col("layer"), 0.4).alias("opacity"))


@query("SELECT page_id, coalesce(nullif(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '^/(fr|de)(/|$)', 1), ''), 'en') AS language FROM pages")
def r_locale_prefix(spark, sf):
    """The language prefix of each page's path."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", text.language_of_path(path, ("fr", "de")).alias("language"))


@query("SELECT p_partkey, 'archive/' || p_brand || '/' || CASE WHEN length(p_partkey::VARCHAR) < 3 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END || '.jpg' AS path, p_brand AS book, p_partkey AS page FROM part")
def r_scan_path(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", text.scan_path(F.col("p_brand"), F.col("p_partkey")).alias("path"))
    parts = text.scan_parts(F.col("path"))
    return rows.select("p_partkey", "path", parts["book"].alias("book"), parts["page"].alias("page"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END, ''), 'Button') AS label FROM documents")
def r_default(spark, sf):
    some = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return table(spark, sf, "documents").select("doc_id", text.or_default(some, "Button").alias("label"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value * 1000 WHEN 2 THEN 250 WHEN 3 THEN 250 ELSE CASE WHEN value = 0 THEN 250 ELSE value END END::DOUBLE AS ms FROM (SELECT event_id, (event_id % 900)::DOUBLE AS value FROM events)")
def r_duration_parse(spark, sf):
    """CSS times built from event ids: ms, s, blank, no number, bare number."""
    number = (F.col("event_id") % 900).cast("string")
    kind = F.col("event_id") % 5
    raw = F.when(kind == 0, F.concat(number, F.lit("ms"))).when(kind == 1, F.concat(F.lit(" "), number, F.lit("s "))).when(kind == 2, " ").when(kind == 3, "auto").otherwise(number)
    return table(spark, sf, "events").select("event_id", text.duration_ms(raw, 250).alias("ms"))


@query("SELECT doc_id, doc_id % 2 = 0 AS blank, doc_id % 4 IN (0, 1) AS flag, 2 + (doc_id % 3 > 0)::BIGINT AS parts, (doc_id / 4)::DOUBLE AS number FROM documents")
def r_parsing(spark, sf):
    """Blank test, flags, comma lists and tolerant numbers over texts made from ids."""
    k = F.col("doc_id")
    blank = F.when(k % 4 == 0, "").when(k % 4 == 2, " \n\t").otherwise("x")
    flag = F.element_at(F.array(F.lit("True"), F.lit("1"), F.lit("t"), F.lit("no")), (k % 4 + 1).cast("int"))
    items = F.concat(F.lit(" a ,, b "), F.when(k % 3 > 0, ", c").otherwise(", "))
    number = F.concat(F.lit(" "), (k / 4).cast("string"), F.lit("px"))
    return table(spark, sf, "documents").select("doc_id", text.is_blank(blank).alias("blank"), text.as_flag(flag).alias("flag"), F.size(text.comma_list(items)).cast("long").alias("parts"), text.float_or(number, 0.2).alias("number"))


@query("SELECT o_orderkey, (date_trunc('month', o_orderdate) + to_months(k::INT) + to_days((day(o_orderdate) - 1)::INT))::DATE AS occurs FROM orders, range(7) r(k) WHERE day(o_orderdate) = 31 AND month((date_trunc('month', o_orderdate) + to_months(k::INT) + to_days(30))::DATE) = month(date_trunc('month', o_orderdate) + to_months(k::INT)) AND (date_trunc('month', o_orderdate) + to_months(k::INT) + to_days(30))::DATE <= (o_orderdate + INTERVAL 180 DAY)::DATE")
def r_recur_monthly(spark, sf):
    """Monthly recurrence of orders of a 31st for 180 days: months without a 31st are skipped."""
    rows = table(spark, sf, "orders").where(F.dayofmonth("o_orderdate") == 31)
    rows = rows.select("o_orderkey", F.to_date("o_orderdate").alias("start"), F.lit("monthly").alias("repeat"), F.date_add(F.to_date("o_orderdate"), 180).alias("repeat_until"))
    return calendar.occurrences(rows).select("o_orderkey", "occurs")


_RECUR_SQL = (
    "WITH e AS (SELECT o_orderkey, o_orderkey % 4 AS rule, o_orderdate::DATE AS b FROM orders), "
    "m AS (SELECT o_orderkey, b, (b + CASE rule WHEN 2 THEN to_months(k::INT) ELSE to_years(k::INT) END)::DATE AS occurs FROM e, range(240) r(k) WHERE rule > 1), "
    "o AS (SELECT o_orderkey, b + k::INT AS occurs FROM e, range(1101) r(k) WHERE rule = 0 UNION ALL SELECT o_orderkey, b + 7 * k::INT FROM e, range(1029) r(k) WHERE rule = 1 "
    "UNION ALL SELECT o_orderkey, occurs FROM m WHERE day(occurs) = day(b) AND occurs <= b + 7200) "
)


def _recurring(spark, sf) -> DataFrame:
    """Orders as events that recur daily for 1100 days, or weekly, monthly or yearly for 7200."""
    kind, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    rule = F.element_at(F.array(*[F.lit(r) for r in calendar.RULES]), (kind + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", day.alias("start"), rule.alias("repeat"), F.date_add(day, F.when(kind == 0, 1100).otherwise(7200)).alias("repeat_until"))


@query(_RECUR_SQL + "SELECT o_orderkey, count(*) AS n, max(occurs) AS last, sum(occurs - DATE '1970-01-01')::BIGINT AS days FROM o GROUP BY o_orderkey")
def r_recur_all(spark, sf):
    """Daily, weekly, monthly and yearly recurrences of all orders, for 1100 days (daily) or 7200: number, last date and sum of dates of each."""
    return calendar.occurrence_totals(_recurring(spark, sf)).select("o_orderkey", "n", "last", "days")


@query(_RECUR_SQL + "SELECT o_orderkey, occurs FROM o WHERE occurs BETWEEN DATE '1998-02-01' AND DATE '1998-03-01'")
def r_calendar_month(spark, sf):
    """A month's view, with the day behind it, of the recurrences of all orders."""
    low, high = F.lit("1998-02-01").cast("date"), F.lit("1998-03-01").cast("date")
    return calendar.occurrences_between(_recurring(spark, sf), low, high).select("o_orderkey", "occurs")


@query(_RECUR_SQL + "SELECT r.o_orderkey, view, count(occurs) AS n, max(occurs) AS last, coalesce(sum(occurs - DATE '1970-01-01'), 0)::BIGINT AS days FROM (SELECT o_orderkey, unnest([1995, 2000]) AS view FROM orders) r LEFT JOIN o ON o.o_orderkey = r.o_orderkey AND year(occurs) = view GROUP BY ALL")
def r_calendar_years(spark, sf):
    """How often each order's recurrence falls in two years, the last time, and the sum of days."""
    rows = _recurring(spark, sf).withColumn("view", F.explode(F.array(F.lit(1995), F.lit(2000))))
    return calendar.occurrence_totals(rows, F.make_date("view", F.lit(1), F.lit(1)), F.make_date("view", F.lit(12), F.lit(31))).select("o_orderkey", "view", "n", "last", "days")


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1")
def r_calendar_buckets(spark, sf):
    return table(spark, sf, "events").groupBy(calendar.bucket(F.col("ts"), "week").cast("timestamp_ntz").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_orderdate <= TIMESTAMP '1996-06-01') AND (o_orderstatus = 'F' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-06-01')")
def r_live_window(spark, sf):
    day = F.lit("1996-06-01").cast("timestamp_ntz")
    golive = F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))
    expire = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return table(spark, sf, "orders").where(calendar.is_live(day, golive, expire)).select("o_orderkey")


@query("SELECT p_partkey, replace(lower(p_name), ' ', '_') AS field, p_brand || '.' || md5(p_name)[1:12] || '.css' AS hashed, p_size % 3 = 0 AS thai, CASE p_size % 5 WHEN 0 THEN 'fill' WHEN 1 THEN 'max' WHEN 2 THEN 'width' WHEN 3 THEN 'height' ELSE 'scale' END AS operation, CASE WHEN p_size % 5 <> 3 THEN p_size END::INT AS width, CASE p_size % 5 WHEN 2 THEN NULL WHEN 3 THEN p_size WHEN 4 THEN p_size ELSE 90 END::INT AS height, CASE WHEN p_size % 2 = 0 THEN 'webp' END AS format FROM part")
def r_names(spark, sf):
    """Names of fields and files, and image specifications, made from parts."""
    size = F.col("p_size")
    operation = F.element_at(F.array(*[F.lit(x) for x in ("fill", "max", "width", "height", "scale")]), (size % 5 + 1).cast("int"))
    spec = F.concat(operation, F.lit("-"), size.cast("string"), F.when(size % 5 < 2, "x90").otherwise(""), F.when(size % 2 == 0, " format-webp").otherwise(""))
    title = F.when(size % 3 == 0, F.concat("p_name", F.lit(" ก"))).otherwise(F.col("p_name"))
    rows = table(spark, sf, "part").select(
        "p_partkey", text.field_name(F.col("p_name")).alias("field"), text.hashed_name(F.concat("p_brand", F.lit(".css")), F.col("p_name")).alias("hashed"),
        text.has_thai(title).alias("thai"), text.rendition(spec).alias("r"),
    )
    return rows.select("p_partkey", "field", "hashed", "thai", "r.operation", "r.width", "r.height", "r.format")


@query("SELECT doc_id, 3 + (doc_id % 2 = 0)::INT + 2 * (doc_id % 5 = 0)::INT AS choices, contains(lower(source), '1') AS has_one, least(1.0, greatest(0.25, (doc_id % 10) / 4.0))::DOUBLE AS amount, ((doc_id % 10) // 4)::VARCHAR || CASE doc_id % 10 % 4 WHEN 0 THEN '' WHEN 1 THEN '.25' WHEN 2 THEN '.5' ELSE '.75' END AS style, doc_id % 10 > 0 AS given FROM documents")
def r_choices(spark, sf):
    """Choice lists, substring tests, clamped numbers and their texts, guards."""
    place = F.col("doc_id") % 10
    return table(spark, sf, "documents").select(
        "doc_id", F.size(text.choice_list(F.concat(F.lit("a, "), "lang", F.lit("\r\n\nb,"), F.when(F.col("doc_id") % 2 == 0, " c ").otherwise(" "), F.when(F.col("doc_id") % 5 == 0, ",d\n e").otherwise(",")))).alias("choices"), text.has_part(F.lower("source"), "1").alias("has_one"),
        motion.clamped(place / 4, 0.25, 1.0).alias("amount"), motion.opacity_style(place / 4).alias("style"), text.is_given(place).alias("given"),
    )


@query("SELECT conv_id, turn, role, CASE role WHEN 'user' THEN 'asked' ELSE text END AS text FROM conversations")
def r_merged(spark, sf):
    """Fields of a struct replaced by given ones."""
    block = F.struct("role", "text")
    new = F.when(F.col("role") == "user", bodies.merged(block, text=F.lit("asked"))).otherwise(block)
    return table(spark, sf, "conversations").select("conv_id", "turn", new.alias("b")).select("conv_id", "turn", "b.role", "b.text")


@query("""SELECT p_partkey, md5('<div class="goal-detail">' || chr(10) || '  <h1 class="goal-detail-title">' || p_name || '</h1>' || chr(10) || '  <div class="goal-detail-body">' || chr(10)
  || array_to_string(list_transform(string_split(p_type, ' '), lambda p: '    <p>' || p || '</p>'), chr(10)) || chr(10) || '  </div>' || chr(10) || '</div>') AS goal,
  md5('<div class="home-section">' || chr(10) || '  <h2 class="home-section-title">Mission</h2>' || chr(10) || '  <p class="home-principle">' || p_name || '</p>' || chr(10) || '</div>') AS section,
  '<p>' || p_type || '</p>' AS card,
  md5('<span class="acronym-letter">' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1:1] || '</span>' || w[2:]), ' <span class="acronym-letter">')) AS acronym,
  md5('<p class="home-principle">' || p_name || chr(10) || '      <span class="home-cases-toggle"') AS lead FROM part""")
def r_body_builders(spark, sf):
    """Bodies built from parts: a goal's page, a section of a home page, a card."""
    name, kind = F.col("p_name"), F.col("p_type")
    card = markup.card(F.col("p_size").cast("string"), name, kind, F.col("p_partkey"), F.lit("Read more"))
    cases = F.array(F.struct(F.col("p_brand").alias("mark"), kind.alias("body")))
    return table(spark, sf, "part").select(
        "p_partkey", F.md5(markup.goal_html(name, F.split(kind, " "))).alias("goal"), F.md5(markup.section_html("Mission", name)).alias("section"), card["description"].alias("card"),
        F.md5(F.regexp_extract(markup.hero_html(F.col("p_brand"), F.lit("T"), name), r'--acronym">(.*)</p>', 1)).alias("acronym"), F.md5(F.regexp_extract(markup.principle_html("P", name, cases), r'(?s)(<p class="home-principle">.*toggle")', 1)).alias("lead"),
    )


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = lower((SELECT min(p_brand) FROM part))")
def r_tagged(spark, sf):
    """Parts with a tag, whatever its case."""
    parts = table(spark, sf, "part")
    brand = parts.agg(F.min("p_brand")).first()[0]
    return links.tagged(parts.select("p_partkey"), parts.select("p_partkey", F.upper("p_brand").alias("tag")), "p_partkey", brand.swapcase())


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de')")
def r_classified(spark, sf):
    """Documents that a list filtered by a classifier shows."""
    terms = table(spark, sf, "documents").select("doc_id", F.lit("language").alias("classifier"), F.col("lang").alias("term"))
    return links.with_terms(table(spark, sf, "documents").select("doc_id"), terms, "doc_id", "language", ["en", "de"])


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building' WHEN 'MACHINERY' THEN 'machinery' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def r_translated_labels(spark, sf):
    """Labels in another language where there is a translation."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    some = rows.select(F.col("c_mktsegment").alias("message")).distinct().where("message IN ('BUILDING', 'MACHINERY')")
    labels = some.select("message", F.lit("xx").alias("language"), F.lower("message").alias("translation"))
    return links.translated(rows, labels, "c_mktsegment", "xx")


@query("""WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand || ' é') WHEN p_partkey % 3 = 1 THEN p_brand || ' É' ELSE p_brand || ' e' END AS tag FROM part)
SELECT min(tag) AS tag, count(*) AS writings FROM t GROUP BY lower(tag) HAVING count(*) > 1""")
def r_clashing_tags(spark, sf):
    """Brands as tags, with letters beyond ASCII, that are written in several ways."""
    k, brand = F.col("p_partkey") % 3, F.col("p_brand")
    tag = F.when(k == 0, F.upper(F.concat(brand, F.lit(" é")))).when(k == 1, F.concat(brand, F.lit(" É"))).otherwise(F.concat(brand, F.lit(" e")))
    return links.clashing_tags(table(spark, sf, "part").select(tag.alias("tag")), "tag")


# -- search and reports --------------------------------------------------------


@query("WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents) SELECT doc_id, count(DISTINCT term) AS matched, count(*) AS score FROM t WHERE term IN ('the', 'und', 'pas') GROUP BY doc_id")
def r_token_tf(spark, sf):
    return search.search_texts(table(spark, sf, "documents"), "doc_id", "text", ["The", "und", "pas"])


@query("WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+')) AS term FROM part) SELECT term, p_partkey, count(*) AS tf FROM t WHERE term <> '' GROUP BY term, p_partkey")
def r_postings(spark, sf):
    """The inverted index itself."""
    return search.postings(table(spark, sf, "part"), "p_partkey", "p_name")


def _bm25_sql(table_: str, key: str, text: str, terms: str, k: int) -> str:
    """BM25 of all documents, by its formula."""
    return f"""
WITH t AS (SELECT {key} AS key, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS terms FROM {table_}),
n AS (SELECT count(*)::DOUBLE AS n, greatest(1.0, sum(len(terms)) / count(*)::DOUBLE) AS mean FROM t),
tf AS (SELECT key, len(terms)::DOUBLE AS length, term, count(*)::DOUBLE AS tf FROM (SELECT key, terms, unnest(terms) AS term FROM t) WHERE term IN ({terms}) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
parts AS (SELECT key, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9)::DECIMAL(18, 9) AS part FROM tf JOIN df USING (term), n),
scored AS (SELECT key, count(*) AS matched, sum(part)::DOUBLE AS score FROM parts GROUP BY key)
SELECT row_number() OVER (ORDER BY score DESC, key) AS place, key, matched, score FROM scored QUALIFY place <= {k}"""


@query(_bm25_sql("documents", "doc_id", "text", "'the', 'und', 'pas', 'nicht', 'tion'", 100))
def r_ranked_search(spark, sf):
    """The hundred best documents for a question, from a stored index."""
    folder = shared_path(spark, "index")
    ranked.write_index(table(spark, sf, "documents"), "doc_id", "text", folder)
    return ranked.search_index(spark, folder, ["The", "und", "pas", "nicht", "tion"], 100)


@query("SELECT 'domain' AS rule, o_orderkey AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL SELECT 'range', l_orderkey * 10 + l_linenumber FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.09 UNION ALL SELECT 'length', doc_id FROM documents WHERE length(text) > 5000")
def r_integrity(spark, sf):
    domain = integrity.outside_domain(table(spark, sf, "orders"), "o_orderstatus", ["F", "O"]).select(F.lit("domain").alias("rule"), F.col("o_orderkey").alias("id"))
    span = integrity.outside_range(table(spark, sf, "lineitem"), "l_discount", 0, 0.09).select(F.lit("range").alias("rule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    size = integrity.too_long(table(spark, sf, "documents"), "text", 5000).select(F.lit("length").alias("rule"), F.col("doc_id").alias("id"))
    return domain.unionByName(span).unionByName(size)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def r_repeated_keys(spark, sf):
    return integrity.repeated(table(spark, sf, "events"), "user_id", "event_type")


# -- streams -------------------------------------------------------------------


def _folder(spark) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="spark-stream-", dir="/tmp")


def _events(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return stream.event_stream(spark, sf, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, count(*) AS switches, count(*) % 2 = 1 AS is_open FROM events GROUP BY user_id")
def r_stream_toggle(spark, sf):
    """Whether each user's switch is open after all events."""
    return stream.drained(stream.toggled(_events(spark, sf), "user_id"), _folder(spark), "complete")


@query("SELECT DISTINCT user_id FROM events")
def r_stream_seen(spark, sf):
    return stream.drained(stream.seen_keys(_events(spark, sf), "user_id"), _folder(spark))


@query("SELECT DISTINCT event_type, user_id FROM events")
def r_stream_once(spark, sf):
    """Each user's first event of a type, while the watermark holds it back."""
    rows = _events(spark, sf).select("ts", "event_type", "user_id")
    return stream.drained(stream.once_only(rows, ["event_type", "user_id"], "3650 days"), _folder(spark)).select("event_type", "user_id")


@query("SELECT event_id, greatest(0.0, least(value * 10 + 100, 460.0) - value * 10) / 100 AS share FROM events WHERE greatest(0.0, least(value * 10 + 100, 460.0) - value * 10) / 100 >= 0.12")
def r_stream_revealed(spark, sf):
    """Events as items of height 100 in a view of 500, of which enough is in sight above its margin."""
    share = stream.share_in_sight(F.col("value") * 10, F.lit(100.0), F.lit(500.0)).alias("share")
    return stream.drained(stream.revealed(_events(spark, sf).select("event_id", share), "share"), _folder(spark)).select("event_id", "share")


@query("WITH f AS (SELECT date_trunc('day', ts)::TIMESTAMP AS frame, event_type, count(*) AS n, arg_max(value, (ts, value)) AS last FROM events GROUP BY 1, 2) SELECT * FROM f WHERE frame < (SELECT date_trunc('day', max(ts)) FROM events)")
def r_stream_coalesced(spark, sf):
    """Daily frames that have ended, by event type."""
    got = stream.coalesced(_events(spark, sf), "event_type", "1 day", "0 seconds", "value")
    return stream.drained(got, _folder(spark)).withColumn("frame", F.col("frame").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w < INTERVAL 6 HOUR) IS NOT TRUE AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS opened, (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS closed, count(*) AS switches, count(*) % 2 = 1 AS left_open FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 7 HOUR <= (SELECT max(ts) FROM events)""")
def r_stream_switches(spark, sf):
    """Each use of a user's switch, which closes by itself after six hours; events may be an hour late."""
    uses = keyed.idle_switches(_events(spark, sf).select("ts", "user_id"), "user_id", dt.timedelta(hours=6), "1 hour")
    got = keyed.run_into(uses, shared_path(spark, "switches"), "uses")
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("opened", "closed")})


# -- beyond the reference ------------------------------------------------------


@query("SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR) IS NOT TRUE AS new FROM (SELECT event_id, user_id, ts FROM events)) ")
def e_sessions(spark, sf):
    """Sessions of users: a gap of over an hour begins a new one. An extension."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL 1 HOUR")
    return rows.withColumn("_new", F.when(gap, 0).otherwise(1)).select("event_id", "user_id", F.sum("_new").over(w).alias("session"))
