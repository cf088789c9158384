"""JSON-LD as a relation of nodes, and what the nodes say about a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.markup import rows_of
from sitegrain.operators.structure import ld_blocks
from sitegrain.rules import score as rules

_EVERY = "array<struct<path: string, ord: array<int>, depth: int, reachable: boolean, node: variant>>"


def _nested(node: Column) -> Column:
    return F.schema_of_variant(node).startswith("OBJECT") | F.schema_of_variant(node).startswith("ARRAY")


def _all_values(root: Column, text: Column) -> Column:
    """The objects and arrays of a parsed block, level by level, as an array of rows.

    A level needs an opening bracket, so their number in the text bounds the levels and nothing is left out. Once a
    level is empty the rest of the steps do nothing.
    """

    def row(parent: Column, name: Column, i: Column, reachable: Column, node: Column) -> Column:
        return F.struct(
            F.concat(parent["path"], name).alias("path"),
            F.array_append(parent["ord"], i).alias("ord"),
            (parent["depth"] + 1).alias("depth"),
            (parent["reachable"] & reachable).alias("reachable"),
            node.alias("node"),
        )

    def field(parent: Column, e: Column, i: Column) -> Column:
        speaks = F.when(e["key"] == "@graph", F.schema_of_variant(e["value"]).startswith("ARRAY")).otherwise(e["key"] == "mainEntity")
        return row(parent, F.concat(F.lit("."), e["key"]), i, speaks, e["value"])

    def item(parent: Column, v: Column, i: Column) -> Column:
        return row(parent, F.concat(F.lit("["), i.cast("string"), F.lit("]")), i, _is_object(v), v)

    def children(parent: Column) -> Column:
        fields = F.map_entries(F.try_variant_get(parent["node"], "$", "map<string, variant>"))
        items = F.try_variant_get(parent["node"], "$", "array<variant>")
        found = F.coalesce(
            F.transform(fields, lambda e, i: field(parent, e, i)).cast(_EVERY),
            F.transform(items, lambda v, i: item(parent, v, i)).cast(_EVERY),
            F.array().cast(_EVERY),
        )
        return F.filter(found, lambda r: _nested(r["node"]))

    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["last"], children))
        grown = F.struct(below.alias("last"), F.concat(state["every"], below).alias("every"))
        return F.when(F.size(state["last"]) == 0, state).otherwise(grown)

    top = F.struct(F.lit("$").alias("path"), F.array(F.lit(0)).alias("ord"), F.lit(0).alias("depth"), F.lit(True).alias("reachable"), root.alias("node"))
    roots = F.filter(F.array(top).cast(_EVERY), lambda r: _nested(r["node"]))
    levels = F.regexp_count(text, F.lit("[{\\[]"))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(roots.alias("last"), roots.alias("every")), step, lambda state: state["every"])


def _walk(pages: DataFrame) -> DataFrame:
    tagged = pages.filter(F.contains("html", F.lit("ld+json")))
    texts = rows_of(tagged, ld_blocks(F.col("html")), "page_id", pos="block", item="text")
    blocks = texts.withColumn("root", F.try_parse_json("text")).filter("root IS NOT NULL")
    rows = rows_of(blocks, _all_values(F.col("root"), F.col("text")), "page_id", "block")
    return rows.select("page_id", "block", "item.*").filter(_is_object(F.col("node")))


def _text(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _types(node: Column) -> Column:
    several = F.try_variant_get(node, "$['@type']", "array<string>")
    one = F.filter(F.array(_text(node, "$['@type']")), lambda t: t.isNotNull())
    return F.filter(F.transform(F.coalesce(several, one), lambda t: F.trim(t)), lambda t: t != "")


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """Every JSON object in a page's JSON-LD blocks: (page_id, block, path, depth, reachable, types, node).

    Blocks that do not parse are skipped. ``reachable`` marks the nodes that speak for the page itself: the root, the
    items of its @graph and its mainEntity. The walk stays inside the row and goes as deep as the values do.
    """
    return _walk(pages).select(
        "page_id", "block", "path", "ord", "depth", "reachable", _types(F.col("node")).alias("types"), "node"
    )


def _is_object(node: Column) -> Column:
    return F.schema_of_variant(node).startswith("OBJECT")


def _page_nodes(html: Column) -> Column:
    """The nodes that speak for the page (root, @graph items, mainEntity), in document order, as an array of variants.

    The walk goes down level by level inside the row. A level needs a "@graph" or "mainEntity" key, so the number of
    those keys in the page bounds the levels and nothing is left out.
    """
    level = "array<struct<at: array<int>, node: variant>>"
    levels = F.regexp_count(html, F.lit('"(?:@graph|mainEntity)"'))

    def listed(value: Column) -> Column:
        several = F.try_variant_get(value, "$", "array<variant>")
        return F.when(several.isNotNull(), several).when(value.isNotNull(), F.array(value)).otherwise(F.array().cast("array<variant>"))

    def placed(parent: Column, nodes: Column, branch: int) -> Column:
        rows = F.transform(
            nodes, lambda n, i: F.struct(F.concat(parent, F.array(F.lit(branch), i)).alias("at"), n.alias("node"))
        )
        return F.filter(rows, lambda r: _is_object(r["node"]))

    def children(row: Column) -> Column:
        graph = F.try_variant_get(row["node"], "$['@graph']", "array<variant>")
        main = F.try_variant_get(row["node"], "$.mainEntity", "variant")
        return F.concat(
            placed(row["at"], F.coalesce(graph, F.array().cast("array<variant>")), 0), placed(row["at"], listed(main), 1)
        )

    def step(state: Column, _: Column) -> Column:
        below = F.flatten(F.transform(state["last"], children))
        return F.struct(below.alias("last"), F.concat(state["every"], below).alias("every"))

    blocks = F.filter(F.transform(ld_blocks(html), lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    roots = F.flatten(F.transform(blocks, lambda v, i: placed(F.array(i), listed(v), 0))).cast(level)
    start = F.struct(roots.alias("last"), roots.alias("every"))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    walked = F.aggregate(steps, start, step, lambda state: state["every"])
    return F.transform(_in_order(walked), lambda r: r["node"])


def _in_order(rows: Column) -> Column:
    """Rows by their place. A parent's place is a prefix of its children's, so this is document order."""
    return F.array_sort(
        rows,
        lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0),
    )


def _typed_facts(node: Column) -> Column:
    """One struct per @type of a node with what that type says."""
    types = _types(node)
    offers = F.try_variant_get(node, "$.offers", "variant")
    shape = F.schema_of_variant(offers)
    offered = offers.isNull() | shape.startswith("OBJECT") | (shape.startswith("ARRAY") & (shape != "ARRAY<VOID>"))
    price = F.coalesce(F.nullif(_text(node, "$.offers.price"), F.lit("")), F.nullif(_text(node, "$.offers.lowPrice"), F.lit("")))
    currency = F.coalesce(_text(node, "$.offers.priceCurrency"), F.lit(""))
    name = F.coalesce(_text(node, "$.name"), F.lit(""))
    has_rating = F.try_variant_get(node, "$.aggregateRating", "variant").isNotNull()
    own_rating = _text(node, "$.aggregateRating.ratingValue").try_cast("double")

    def facts(label: Column) -> Column:
        kind = F.lower(label)
        product, service = kind.isin(rules.LD_PRODUCT), kind.isin(rules.LD_SERVICE)
        local, local_service = kind.isin(rules.LD_LOCAL), kind.isin(rules.LD_LOCAL_SERVICE)
        named = kind.isin(rules.LD_ORGANIZATION + rules.LD_LOCAL_SERVICE + rules.LD_SOFTWARE)
        rating = F.when(kind == "aggregaterating", _text(node, "$.ratingValue").try_cast("double"))
        fields = {
            "type": label,
            "product": product,
            "product_name": F.when(product & (name != ""), name),
            "offer": (product & offered) | (kind == "offer"),
            "price": F.when(product & price.isNotNull(), F.trim(F.concat_ws(" ", price, currency))).when(
                kind == "offer", F.nullif(_text(node, "$.price"), F.lit(""))
            ),
            "currency": F.when(product & price.isNotNull(), currency),
            "organization": F.when(named, name),
            "local_type": F.when(local | local_service, label),
            "address": F.when(local, F.coalesce(_text(node, "$.address.streetAddress"), F.lit(""))),
            "service": service,
            "service_business": service | local_service,
            "service_name": F.when(service & (name != ""), name),
            "software": kind.isin(rules.LD_SOFTWARE),
            "blog": kind.isin(rules.LD_BLOG),
            "store": kind.isin(rules.LD_STORE),
            "review": kind.isin(rules.LD_REVIEW) | has_rating,
            # an aggregateRating inside a node is read after the node's own types, so it wins
            "rating": F.coalesce(own_rating, rating),
        }
        return F.struct(*[value.alias(key) for key, value in fields.items()])

    untyped = F.filter(F.array(F.lit("")), lambda _: has_rating & (F.size(types) == 0))
    return F.transform(F.concat(types, untyped), facts)


def with_schema_facts(pages: DataFrame) -> DataFrame:
    """Adds ``facts``: what a page's JSON-LD says, as one struct; null without any type. Narrow, nothing is exploded."""
    has_blocks = F.contains("html", F.lit("ld+json"))
    rows = F.flatten(F.transform(_page_nodes(F.col("html")), _typed_facts))
    staged = pages.withColumn("_rows", F.when(has_blocks, rows))
    r = F.col("_rows")

    def any_of(field: str) -> Column:
        return F.exists(r, lambda x: x[field])

    def seen(field: str) -> Column:
        values = F.filter(F.transform(r, lambda x: x[field]), lambda v: v.isNotNull() & (v != ""))
        return F.array_distinct(values)

    def last(field: str) -> Column:
        return F.try_element_at(F.filter(F.transform(r, lambda x: x[field]), lambda v: v.isNotNull()), F.lit(-1))

    is_local = F.exists(r, lambda x: x["local_type"].isNotNull())
    fields = {
        "types": seen("type"),
        "types_lower": F.transform(seen("type"), lambda t: F.lower(t)),
        "has_products": any_of("product"),
        "product_count": F.size(F.filter(r, lambda x: x["product"])),
        "product_names": seen("product_name"),
        "has_offers": any_of("offer"),
        "price_range": last("price"),
        "currency": last("currency"),
        "organization_name": last("organization"),
        "business_type": last("local_type"),
        "address": last("address"),
        "is_local_business": is_local,
        "has_services": any_of("service"),
        "is_service_business": any_of("service_business"),
        "service_types": seen("service_name"),
        "is_software": any_of("software"),
        "is_blog": any_of("blog"),
        "has_reviews": any_of("review"),
        "aggregate_rating": last("rating"),
        "is_ecommerce": any_of("product") | any_of("offer") | any_of("store"),
    }
    facts = F.struct(*[value.alias(key) for key, value in fields.items()])
    typed = F.exists(r, lambda x: x["type"] != "")
    return staged.withColumn("facts", F.when(typed, facts)).drop("_rows")


def schema_facts(pages: DataFrame) -> DataFrame:
    """One row per page with JSON-LD types: types, names, price, rating and the site type flags they imply."""
    return with_schema_facts(pages).filter("facts IS NOT NULL").select("page_id", "facts.*")


def schema_score(business_type: Column, facts: str = "facts") -> Column:
    """Points that the facts struct in column ``facts`` adds for a business type."""

    def points(conditions) -> Column:
        return reduce(lambda a, b: a + b, [F.when(F.expr(c.format(f=facts)), p).otherwise(0) for c, p in conditions])

    kind = F.lower(business_type)
    own = F.lit(0)
    for kinds, conditions in rules.LD_WEIGHTS:
        own = F.when(kind.isin(kinds), points(conditions)).otherwise(own)
    return own + points(rules.LD_WEIGHTS_ALL)
