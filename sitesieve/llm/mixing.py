"""Mixing sources to target weights by hierarchical budgets.

The token budget goes down a tree of domains, languages and sources by weight. A node never gets more than its
documents can give in ``max_epochs`` epochs; what it can't take goes to its siblings by their weights, and only
what all of them can't take goes back to the parent's siblings. A leaf takes whole seeded epochs and then a prefix
of one more, in that epoch's own order, up to its budget in tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitesieve.llm.common import WORD, materialise

SEED, MAX_EPOCHS = 4, 4
#: Hexadecimal digits of the order key that a leaf is cut by, so that no leaf is ordered by one task.
SLICE = 3
_BIG = "decimal(38,0)"


def _level(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Give each parent's ``budget`` to its children: columns weight and capacity -> share.

    Children in the order of capacity over weight: one that can't take its share by weight of what is left gets its
    capacity, the first that can and all after it get their share. Whole tokens, rounded down.
    """
    ratio = F.col("capacity").cast("double") / F.col("weight")
    order = Window.partitionBy(*parent).orderBy(ratio, name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    left = F.col("budget").cast(_BIG) - F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast(_BIG)
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = nodes.withColumns({"left": left, "rest": rest, "place": F.row_number().over(order)})
    enough = F.col("capacity").cast(_BIG) * F.col("rest") <= F.col("left") * F.col("weight")
    ranked = ranked.withColumn("open", F.min(F.when(~enough, F.col("place"))).over(whole))
    first = lambda c: F.max(F.when(F.col("place") == F.col("open"), F.col(c))).over(whole)
    ranked = ranked.withColumns({"open_left": first("left"), "open_rest": first("rest")})
    share = F.when(F.col("open").isNull() | (F.col("place") < F.col("open")), F.col("capacity")).otherwise(
        F.least("capacity", F.expr("cast(greatest(open_left, cast(0 as decimal(38,0))) as decimal(28,0)) * weight div open_rest"))
    )
    return ranked.withColumn("share", share.cast("bigint")).drop("left", "rest", "place", "open", "open_left", "open_rest")


def budgets(leaves: DataFrame, budget: int | Column, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Budget of each leaf. ``leaves``: domain, lang, source, tokens, and the weights w_domain, w_lang, w_source (whole numbers, at least 1)."""
    caps = leaves.withColumn("capacity", (F.col("tokens") * max_epochs).cast("bigint"))
    keys = ["domain", "lang", "source"]
    langs = caps.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("w_lang").alias("weight"), F.max("w_domain").alias("w_domain"))
    domains = langs.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("w_domain").alias("weight"))
    top = _level(domains.withColumns({"budget": F.lit(budget), "root": F.lit(0)}), ["root"], "domain").select("domain", F.col("share").alias("budget"))
    middle = _level(langs.drop("w_domain").join(top, "domain"), ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    last = _level(caps.withColumn("weight", F.col("w_source")).join(middle, ["domain", "lang"]), ["domain", "lang"], "source")
    return last.select(*keys, "tokens", F.col("share").alias("budget"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document stands in an epoch of its leaf: an MD5 that SQL can repeat."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit(""))))


#: Leaves that are sent to every executor at most; more are joined by a shuffle.
BROADCAST_LEAVES = 50_000
_LEAF = ["_domain", "_lang", "_source"]


def _small(leaves: DataFrame, many: bool) -> DataFrame:
    return leaves if many else F.broadcast(leaves)


def mix(
    docs: DataFrame,
    domain: Column,
    weights: tuple[Column, Column, Column],
    budget_share: tuple[int, int] = (1, 1),
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    text: str = "text",
    details: bool = True,
) -> DataFrame:
    """The chosen rows, each once for every epoch that takes it: the columns of ``docs`` and, with ``details``, _domain,
    _lang, _source, _epoch, _tokens, _budget (of the leaf), which take the place of columns of these names.

    ``weights`` are whole numbers for domain, language and source, made of the columns domain, lang and source. The
    budget is the share ``budget_share`` (numerator, denominator) of all tokens, which are words between white space.
    Null languages and sources form leaves of their own ('?'); null texts have no tokens. Documents without tokens
    come with every whole epoch and with the part of an epoch that reaches them. Rows with the same doc_id stand at
    the same place and are taken or left together. An empty table gives no rows. Further columns are carried along.
    """
    unknown = F.lit("?")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        F.coalesce(domain.cast("string"), unknown).alias("_domain"),
        F.coalesce(F.col("lang").cast("string"), unknown).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), unknown).alias("_source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("_tokens"),
    )
    thin = materialise(rows.select(*_LEAF, F.col("_row.doc_id").cast("string").alias("_doc"), "_tokens"), "leaves")
    by = {"w_domain": weights[0], "w_lang": weights[1], "w_source": weights[2]}
    leaves = (
        thin.groupBy(*_LEAF).agg(F.sum("_tokens").alias("tokens"))
        .select(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "tokens")
        .withColumns({k: F.greatest(F.lit(1), F.coalesce(w, F.lit(1))).cast("bigint") for k, w in by.items()})
        .checkpoint()
    )
    sums = leaves.agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).first()
    many = sums.n > BROADCAST_LEAVES
    given = budgets(leaves, (sums.tokens or 0) * budget_share[0] // budget_share[1], max_epochs).select(
        F.col("domain").alias("_domain"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("budget").alias("_budget"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("int").alias("_whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).cast("bigint").alias("_rest"),
    ).checkpoint()

    # The prefix of the last epoch, a slice of the order keys at a time: sums tell the slice in which a leaf's budget
    # ends, and only that slice's rows are put in order. The texts stay where they are.
    key = order_key(seed, F.col("_whole"), F.col("_doc"))
    partial = thin.join(_small(given.filter("_rest > 0"), many), _LEAF).withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, SLICE))
    slices = partial.groupBy(*_LEAF, "_rest", "_slice").agg(F.sum("_tokens").alias("_inside"))
    upto = F.sum("_inside").over(Window.partitionBy(*_LEAF).orderBy("_slice"))
    ends = slices.withColumn("_ahead", upto - F.col("_inside")).filter("_ahead <= _rest and _rest < _ahead + _inside").select(*_LEAF, "_slice", "_ahead").checkpoint()
    in_order = Window.partitionBy(*_LEAF, "_slice").orderBy("_key", "_doc").rangeBetween(Window.unboundedPreceding, 0)
    last = (
        partial.join(_small(ends, many), [*_LEAF, "_slice"])
        .withColumn("_sum", F.col("_ahead") + F.sum("_tokens").over(in_order))
        .groupBy(*_LEAF, F.col("_slice").alias("_end"))
        .agg(F.max(F.when(F.col("_sum") <= F.col("_rest"), F.struct("_key", F.coalesce("_doc", F.lit("")).alias("_doc")))).alias("_last"))
    )
    plan = given.join(last, _LEAF, "left").checkpoint()
    own_key = order_key(seed, F.col("_whole"), F.col("_row.doc_id"))
    place = F.struct(own_key.alias("_key"), F.coalesce(F.col("_row.doc_id").cast("string"), F.lit("")).alias("_doc"))
    in_part = F.coalesce((F.substring(own_key, 1, SLICE) < F.col("_end")) | (place <= F.col("_last")), F.lit(False))
    epochs = F.filter(F.sequence(F.lit(0), F.col("_whole")), lambda e: (e < F.col("_whole")) | F.col("_part"))
    chosen = rows.join(_small(plan, many), _LEAF).withColumn("_part", in_part).withColumn("_epoch", F.explode(epochs))
    if not details:
        return chosen.select("_row.*")
    more = [*_LEAF, "_epoch", "_tokens", "_budget"]
    return chosen.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in more), *more)
