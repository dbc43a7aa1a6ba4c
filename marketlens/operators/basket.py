"""Market baskets, frequent itemsets, association rules and their revenue."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import CATEGORY, CUSTOMER, ORDER, PAYMENT, from_cents, money_sum, money_total
from ..functions.skew import skew_join
from ..functions.staging import materialize
from .cltv import SEGMENT

_SEP = "\u001f"
#: Itemsets longer than this are an error, as each of k items has 2^k - 2 splits.
LONGEST_SPLIT = 24
#: Triples of wider baskets are left to FP-growth.
MOST_TRIPLES = 200


def baskets(fact: DataFrame) -> DataFrame:
    """One row per order and customer: its set of categories and its revenue in cents.

    Missing categories are no item. Sets are built on the map side too, so an
    order of any length arrives as at most one row per task and category.
    """
    known = fact.where(F.col(ORDER).isNotNull() & F.col(CUSTOMER).isNotNull())
    aggs = [F.array_sort(F.collect_set(CATEGORY)).alias("items")]
    if PAYMENT in fact.columns:
        aggs.append(money_total(fact).alias("revenue_cents"))
    return known.groupBy(ORDER, CUSTOMER).agg(*aggs)


def segment_baskets(b: DataFrame, cltv: DataFrame, segment: str | None = None) -> DataFrame:
    """Baskets with the customer's value segment, or those of one segment."""
    labels = cltv.where(F.col(SEGMENT).isNotNull()).select(CUSTOMER, SEGMENT)
    if segment is not None:
        labels = labels.where(F.col(SEGMENT) == segment)
    return skew_join(b, labels, CUSTOMER)


def multi_item(b: DataFrame) -> DataFrame:
    return b.where(F.size("items") > 1)


def clean_items(b: DataFrame) -> DataFrame:
    """Trimmed lower-case items without repeats, in order."""
    tidy = F.transform(F.filter("items", lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))
    return b.withColumn("items", F.array_sort(F.array_distinct(tidy)))


def _enough(rows: DataFrame, least: int, *cols: str) -> DataFrame:
    """The combinations of ``cols`` that at least so many baskets hold, written."""
    counts = rows.groupBy(*cols).agg(F.sum("n").alias("freq"))
    return materialize(counts.where(F.col("freq") >= least), "itemsets")


def _next(rows: DataFrame, out: str) -> DataFrame:
    """A row for every item of ``rest``; the items behind it are the new ``rest``."""
    others = [c for c in rows.columns if c != "rest"]
    each = rows.select(*others, "rest", F.posexplode("rest").alias("_at", out))
    return each.select(*others, out, F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest"))


def _longer(b: DataFrame, found: DataFrame, size: int, least: int) -> DataFrame | None:
    """Itemsets of more than ``size`` items by FP-growth, ``found`` being those of ``size``; none if there can be none.

    An item of such an itemset stands in ``size`` of those found at least, so
    baskets are cut to such items and those with too few of them left go.
    """
    items = found.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
    kept = F.array_intersect("items", items.agg(F.collect_list("item")).scalar())
    rows = materialize(b.select(kept.alias("items")).where(F.size("items") > size), "long_baskets")
    n = rows.count()
    if n < least:
        return None
    # the conditional trees are grown per partition: no fewer than there are cores
    spark = b.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, numPartitions=parts).fit(rows)
    return model.freqItemsets.where(F.size("items") > size).select(F.array_sort("items").alias("items"), "freq")


def frequent_itemsets(b: DataFrame, min_support: float = 0.001) -> DataFrame:
    """Itemsets in at least ``min_support`` of the baskets.

    Items, pairs and triples are counted over distinct baskets: an item is only
    put to a frequent one, a third only where all three pairs are frequent.
    Counts are added up on the map side, so no tree of the baskets is built.
    FP-growth finds what is longer, and triples as well where baskets are so
    wide that they hold more than ``MOST_TRIPLES`` on average.
    """
    known = b.select(F.array_sort(F.array_distinct(F.array_compact("items"))).alias("items")).where(F.col("items").isNotNull())
    folded = materialize(known.groupBy("items").agg(F.count(F.lit(1)).alias("n")), "patterns")
    w = F.size("items").cast("double")
    sums = folded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.avg(w * (w - 1) * (w - 2) / 6).alias("triples")).first()
    # a hair below, so that a support that meets the limit is not lost to rounding
    least = max(1, ceil(min_support * (1 - 1e-9) * sums["n"]))

    one = _next(folded.select("n", F.col("items").alias("rest")), "a")
    singles = _enough(one, least, "a")
    common = singles.select("a")
    two = _next(one.join(common, "a", "left_semi"), "b").join(common.withColumnRenamed("a", "b"), "b", "left_semi")
    pairs = _enough(two, least, "a", "b")
    sets = [singles.select(F.array("a").alias("items"), "freq"), pairs.select(F.array("a", "b").alias("items"), "freq")]
    if (sums["triples"] or 0) <= MOST_TRIPLES:
        linked = pairs.select("a", "b")
        three = _next(two.join(linked, ["a", "b"], "left_semi"), "c")
        for x in ("a", "b"):
            three = three.join(linked.select(F.col("a").alias(x), F.col("b").alias("c")), [x, "c"], "left_semi")
        sets.append(_enough(three, least, "a", "b", "c").select(F.array("a", "b", "c").alias("items"), "freq"))
    longer = _longer(known, sets[-1], len(sets), least)
    return reduce(DataFrame.unionByName, [*sets, longer] if longer is not None else sets)


def _key(items: Column | str) -> Column:
    return F.concat_ws(_SEP, items)


def _masks(items: str) -> Column:
    """A bit pattern for every split of the items into two parts that are not empty."""
    too_long = F.raise_error(F.lit(f"an itemset of more than {LONGEST_SPLIT} items has too many splits: raise the support"))
    splits = F.expr(f"sequence(1L, shiftleft(1L, size({items})) - 2L)")
    return F.when(F.size(items) <= LONGEST_SPLIT, splits).otherwise(too_long)


def association_rules(itemsets: DataFrame, n_baskets: int, min_lift: float = 1.0) -> DataFrame:
    """Every split of every itemset into antecedent and consequent.

    An itemset of more than ``LONGEST_SPLIT`` items raises an error. Two equi-joins look up the supports of both sides. ``itemsets`` is read
    three times and should be a written table.
    """
    n = F.lit(float(n_baskets))
    by_key = itemsets.select(_key("items").alias("k"), F.col("freq").alias("f"))
    splits = (
        itemsets.where(F.size("items") > 1)
        .withColumn("mask", F.explode(_masks("items")))
        .select(
            F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1L) = 1L)").alias("antecedents"),
            F.expr("filter(items, (x, i) -> (shiftright(mask, i) & 1L) = 0L)").alias("consequents"),
            "freq",
        )
    )
    left = by_key.select(F.col("k").alias("ka"), F.col("f").alias("fa"))
    right = by_key.select(F.col("k").alias("kc"), F.col("f").alias("fc"))
    rules = splits.join(left, _key("antecedents") == F.col("ka")).join(right, _key("consequents") == F.col("kc"))
    rules = rules.select(
        "antecedents",
        "consequents",
        rule_label("antecedents", "consequents").alias("rule"),
        (F.col("fa") / n).alias("antecedent_support"),
        (F.col("fc") / n).alias("consequent_support"),
        (F.col("freq") / n).alias("support"),
        (F.col("freq") / F.col("fa")).alias("confidence"),
    )
    rules = rules.withColumn("lift", F.col("confidence") / F.col("consequent_support"))
    return rules.where(F.col("lift") >= min_lift)


def rule_label(antecedents: Column | str, consequents: Column | str) -> Column:
    return F.concat(F.concat_ws(", ", antecedents), F.lit(" → "), F.concat_ws(", ", consequents))


def order_revenue(fact: DataFrame) -> DataFrame:
    known = fact.where(F.col(ORDER).isNotNull())
    return known.groupBy(ORDER).agg(money_sum(fact).alias("order_revenue"))


def _by_rarity(sets: DataFrame, b: DataFrame) -> DataFrame:
    """set_items and ``path``: the items from the rarest in the baskets on; sets with an item that no basket has go."""
    popularity = b.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    members = sets.select("set_items").distinct().withColumn("item", F.explode("set_items"))
    ranked = members.join(popularity, "item").groupBy("set_items").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("found"))
    whole = ranked.where(F.size("found") == F.size("set_items"))
    return whole.select("set_items", F.transform("found", lambda x: x["item"]).alias("path"))


def prefix_tree(paths: DataFrame) -> DataFrame:
    """One row per beginning of a path: ``node``, the items that lead on, and the set that ends there, if any."""
    lengths = F.explode(F.sequence(F.lit(1), F.size("path"))).alias("length")
    steps = paths.select("set_items", "path", lengths)
    node = _key(F.slice("path", F.lit(1), F.col("length")))
    ends = F.when(F.col("length") == F.size("path"), F.col("set_items"))
    return steps.groupBy(node.alias("node")).agg(
        F.array_compact(F.collect_set(F.get("path", F.col("length")))).alias("next"), F.first(ends, ignorenulls=True).alias("set_items")
    )


def containment_join(sets: DataFrame, b: DataFrame) -> DataFrame:
    """Pair every set (``set_items``) with the baskets (``items``) that hold all of it.

    The sets stand in a prefix tree over their items in order of rarity. Baskets
    go down level by level, each with the nodes whose whole path it holds, so a
    set is met only by baskets that hold its beginning: no cross join, and no
    pair is made twice.
    """
    paths = materialize(_by_rarity(sets, b), "paths")
    tree = materialize(prefix_tree(paths), "prefix_tree")
    levels = paths.agg(F.max(F.size("path"))).first()[0] or 1
    at = b.withColumn("node", F.explode("items")).join(tree, "node")
    found = None
    for level in range(1, levels + 1):
        if level < levels:
            at = materialize(at, "prefix_holders")
        here = at.where(F.col("set_items").isNotNull()).select(*b.columns, "set_items")
        found = here if found is None else found.unionByName(here)
        on = F.explode(F.array_intersect("next", "items")).alias("item")
        at = at.select(*b.columns, F.col("node").alias("path"), on)
        at = at.select(*b.columns, F.concat_ws(_SEP, "path", "item").alias("node")).join(tree, "node")
    return found


def basket_patterns(b: DataFrame) -> DataFrame:
    """Equal baskets folded into one row with their number and revenue.

    Orders repeat few combinations of categories, so what follows depends on
    the combinations, not on the orders.
    """
    return b.groupBy("items").agg(F.count(F.lit(1)).alias("baskets"), F.sum("revenue_cents").alias("revenue_cents"))


def rule_revenue(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Add the revenue of all baskets that hold the rule's antecedent.

    ``rules`` and ``patterns`` are read twice and should be written tables.
    """
    # single items are added up without a join: a popular one stands in most patterns
    single = patterns.select(F.explode("items").alias("item"), "revenue_cents").groupBy(F.array("item").alias("set_items"))
    sets = rules.where(F.size("antecedents") > 1).select(F.col("antecedents").alias("set_items"))
    several = containment_join(sets, patterns).groupBy("set_items")
    cents = F.sum("revenue_cents").alias("cents")
    found = single.agg(cents).unionByName(several.agg(cents)).select("set_items", from_cents(F.col("cents")).alias("r"))
    joined = rules.join(found, F.col("antecedents") == F.col("set_items"), "left").drop("set_items")
    return joined.withColumn("estimated_revenue", F.coalesce("r", F.lit(0.0))).drop("r")


def top_bundles(rules: DataFrame, n: int = 10) -> DataFrame:
    return rules.orderBy(F.desc("estimated_revenue"), F.desc("lift"), "rule").limit(n)


def rule_points(rules: DataFrame) -> DataFrame:
    return rules.select("rule", "support", "confidence", "lift")


def dead_ends(b: DataFrame, rules: DataFrame) -> DataFrame:
    """Items that no rule leads to."""
    items = b.select(F.explode("items").alias("item")).distinct()
    led_to = rules.select(F.explode("consequents").alias("item")).distinct()
    return items.join(led_to, "item", "left_anti")


def rule_edges(rules: DataFrame) -> DataFrame:
    """Directed edges antecedent to consequent, weighted by lift."""
    return rules.select(
        F.concat_ws(", ", "antecedents").alias("src"), F.concat_ws(", ", "consequents").alias("dst"), F.col("lift").alias("weight")
    )


def rule_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the rule graph with the number of edges out and in."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("e")
    ).select("e.*")
    counts = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return counts.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def filter_rules(rules: DataFrame, confidence: float = 0.1, lift: float = 1.2, support: float = 0.01) -> DataFrame:
    return rules.where((F.col("confidence") >= confidence) & (F.col("lift") >= lift) & (F.col("support") >= support))


def uplift(rules: DataFrame) -> DataFrame:
    """Revenue that the rule's lift promises on top, largest first."""
    gain = F.col("estimated_revenue") * (F.col("lift") - 1)
    return rules.withColumn("predicted_uplift_revenue", gain).orderBy(F.desc("predicted_uplift_revenue"), "rule")
