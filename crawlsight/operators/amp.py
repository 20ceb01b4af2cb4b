"""Rules of AMP pages as a table, judged by joins over the element table.

A documented subset of the public AMP HTML specification, not a validator: mandatory elements of
the document and its head, elements and attributes that are not allowed, and required parents and
ancestors. A rule of the table reads:

* ``required``: the page has an element ``tag`` whose ``attribute`` matches, under a parent ``scope``;
* ``forbidden``: it has no element ``tag`` (any, if empty) with a matching attribute, unless inside ``scope``;
* ``once``: it has at most one element ``tag`` with a matching attribute;
* ``parent``: each such element stands directly in one of ``scope``;
* ``inside``: each such element stands somewhere in ``scope``.

A missing pattern asks for the attribute alone, a missing attribute for the element alone.
Elements of a page meet only the elements of the same page that a rule names as its scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.elements import element_table

RULE = "rule string, kind string, tag string, attribute string, pattern string, scope string"
#: Fixed values from the public AMP HTML specification.
RULES = [
    ("html-amp", "required", "html", "amp|⚡", None, None),
    ("charset", "required", "meta", "charset", "(?i)^utf-8$", "head"),
    ("viewport", "required", "meta", "name", "(?i)^viewport$", "head"),
    ("runtime", "required", "script", "src", r"^https://cdn\.ampproject\.org/v0\.(js|mjs)$", "head"),
    ("canonical", "required", "link", "rel", r"(?i)\bcanonical\b", "head"),
    ("boilerplate", "required", "style", "amp-boilerplate", None, "head"),
    ("no-base", "forbidden", "base", None, None, None),
    ("no-img", "forbidden", "img", None, None, "noscript"),
    ("no-video", "forbidden", "video", None, None, "noscript"),
    ("no-audio", "forbidden", "audio", None, None, "noscript"),
    ("no-iframe", "forbidden", "iframe", None, None, "noscript"),
    ("no-frame", "forbidden", "frame", None, None, None),
    ("no-frameset", "forbidden", "frameset", None, None, None),
    ("no-object", "forbidden", "object", None, None, None),
    ("no-embed", "forbidden", "embed", None, None, None),
    ("no-applet", "forbidden", "applet", None, None, None),
    ("no-own-script", "forbidden", "script", "", r"^(?!.*\btype=application/(ld\+)?json\b)(?!.*\bsrc=https://cdn\.ampproject\.org/).*$", None),
    ("no-handler", "forbidden", "", "", r"(^|;)on[a-z]+=", None),
    ("no-script-link", "forbidden", "a", "href", r"(?i)^\s*javascript:", None),
    ("one-own-style", "once", "style", "amp-custom", None, None),
    ("one-canonical", "once", "link", "rel", r"(?i)\bcanonical\b", None),
    ("own-style-in-head", "parent", "style", "amp-custom", None, "head"),
    ("source-in-media", "parent", "source", None, None, "amp-video|amp-audio|video|audio"),
    ("sidebar-in-body", "parent", "amp-sidebar", None, None, "body"),
    ("option-in-select", "inside", "option", None, None, "select|datalist"),
    ("field-in-form", "inside", "fieldset", None, None, "form"),
]


def rule_table(spark: SparkSession, rules: list[tuple] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def broken_rules(pages: DataFrame, key: str = "url", rules: list[tuple] = RULES) -> DataFrame:
    """(key, rule, places) of rules that pages (key, html) break, and in how many places; a missing element is one."""
    spark = pages.sparkSession
    table = F.broadcast(rule_table(spark, rules))  # as many rows as there are rules
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    tree = element_table(pages, key).withColumn("listed", listed)
    value = F.when(F.col("attribute") == "", F.col("listed")).otherwise(
        F.try_element_at(F.map_values(F.map_filter("attributes", lambda k, _: F.array_contains(F.split("attribute", "[|]"), k))), F.lit(1))
    )
    matching = F.col("attribute").isNull() | (value.isNotNull() & (F.col("pattern").isNull() | F.regexp_like(value, F.col("pattern"))))
    named = tree.select(key, "enter", F.col("tag").alias("name"), "attributes", "listed", "parent")
    hits = named.join(table, (F.col("tag") == "") | (F.col("tag") == F.col("name"))).where(matching)
    hits = hits.select(key, "enter", "parent", "rule", "kind", "scope")
    # The elements that rules name as scopes, which meet the hits of their page by interval.
    scopes = sorted({s for r in rules if r[5] for s in r[5].split("|")})
    holders = tree.where(F.col("tag").isin(*scopes)).select(F.col(key).alias("page"), F.col("enter").alias("from"), F.col("leave").alias("until"), F.col("tag").alias("holder"))
    in_scope = F.array_contains(F.split("scope", "[|]"), F.col("holder"))
    direct = F.col("parent") == F.col("from")
    around = (F.col("enter") > F.col("from")) & (F.col("enter") < F.col("until"))
    near = F.when(F.col("kind").isin("required", "parent"), direct).otherwise(around)
    scoped = hits.where("scope IS NOT NULL").join(holders, (F.col(key) == F.col("page")) & in_scope & near, "left_semi")
    told = hits.join(scoped.select(key, "enter", "rule", F.lit(True).alias("held")), [key, "enter", "rule"], "left")
    held = F.coalesce("held", F.lit(False)) | F.col("scope").isNull()
    counts = told.groupBy(key, "rule").agg(F.count_if(held).alias("held"), F.count("*").alias("found"))
    judged = pages.select(key).join(table.select("rule", "kind", "scope")).join(counts, [key, "rule"], "left")
    found, held = F.coalesce("found", F.lit(0)), F.coalesce("held", F.lit(0))
    places = (
        F.when(F.col("kind") == "required", F.when(held == 0, 1).otherwise(0))
        .when(F.col("kind") == "once", F.greatest(found - 1, F.lit(0)))
        .when((F.col("kind") == "forbidden") & F.col("scope").isNull(), found)
        .when(F.col("kind") == "forbidden", found - held)
        .otherwise(found - held)
    )
    return judged.select(key, "rule", places.cast("long").alias("places")).where("places > 0")
