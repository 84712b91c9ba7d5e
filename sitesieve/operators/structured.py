"""Structured data and links of pages as tables: JSON-LD as VARIANT, microdata types, alternates, and table functions on html."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesieve.functions.markup import facts_of

#: Characters of a broken block that are kept.
ERROR = 300


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def jsonld_blocks(facts: DataFrame) -> DataFrame:
    """Blocks of JSON-LD of page facts (site, url, jsonld): site, url, n (of the script), part, pos, block, types.

    A script is an object, a list whose objects are its items, or an object with an ``@graph`` list whose objects are; such an
    object is kept without its graph as ``envelope`` if that leaves more than one key. A script that is no JSON is an ``error``
    with its first characters. Blocks are JSON text with keys in order; ``types`` are those of ``@type``, as a list.
    """
    spark = facts.sparkSession
    raw = facts.select("site", "url", F.posexplode("jsonld").alias("n", "raw")).withColumn("v", F.try_parse_json("raw"))
    graph = F.variant_get("v", '$["@graph"]', "variant")
    is_list, is_object = _is(F.col("v"), "ARRAY"), _is(F.col("v"), "OBJECT")
    has_graph = is_object & F.coalesce(_is(graph, "ARRAY"), F.lit(False))
    read = raw.filter("v is not null").select("site", "url", "n", "v", has_graph.alias("graph"), F.when(is_list, F.col("v")).when(has_graph, graph).alias("list"), is_object.alias("object"))
    items = read.filter("list is not null").lateralJoin(spark.tvf.variant_explode(F.col("list").outer())).filter(_is(F.col("value"), "OBJECT"))
    fields = F.map_filter(F.variant_get("v", "$", "map<string,variant>"), lambda k, _: k != "@graph")
    quoted = lambda k: F.to_json(F.array(k))  # noqa: E731  a list of one
    pair = lambda m, k: F.concat(F.substring(quoted(k), F.lit(2), F.length(quoted(k)) - 2), F.lit(":"), F.to_json(m[k]))
    # of its own script alone: pages may share a url
    envelope = read.filter("graph").select("site", "url", "n", fields.alias("fields")).filter("size(fields) > 1")
    pairs = F.transform(F.array_sort(F.map_keys("fields")), lambda k: pair(F.col("fields"), k))
    text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    part = lambda df, name, block, pos=F.lit(0): df.select("site", "url", "n", F.lit(name).alias("part"), pos.cast("int").alias("pos"), block.alias("block"))
    found = (
        part(raw.filter("v is null"), "error", F.substring("raw", 1, ERROR))
        .unionByName(part(read.filter("object and not graph"), "object", F.to_json("v")))
        .unionByName(part(items, "item", F.to_json("value"), F.col("pos")))
        .unionByName(part(envelope, "envelope", text))
    )
    kind = F.get_json_object("block", "$.@type")
    types = F.when(F.col("part") == "error", F.array().cast("array<string>")).when(kind.startswith("["), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)).otherwise(F.array().cast("array<string>"))
    return found.withColumn("types", types)


def microdata_types(facts: DataFrame) -> DataFrame:
    return facts.select("site", "url", F.posexplode("microdata").alias("pos", "type"))


def alternates(facts: DataFrame) -> DataFrame:
    return facts.select("site", "url", F.posexplode("hreflang").alias("pos", "h")).select("site", "url", "pos", "h.code", "h.href")


@F.udtf(returnType="pos int, raw string, anchor string, rel string")
class LinksOf:
    """Table function: the links of one html text in page order, as they are written."""

    def eval(self, html: str) -> Iterator[tuple]:
        for pos, (raw, anchor, rel) in enumerate(facts_of(html)["anchors"]):
            yield pos, raw, anchor, rel


@F.udtf(returnType="n int, raw string")
class JsonldOf:
    """Table function: the JSON-LD scripts of one html text."""

    def eval(self, html: str) -> Iterator[tuple]:
        yield from enumerate(facts_of(html)["jsonld"])
