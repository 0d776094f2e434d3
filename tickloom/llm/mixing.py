"""Mixing of sources to target weights along a tree of domain, language and source.

A budget of tokens flows from the root down: every node shares its budget among its children in
proportion to their weights, up to what each subtree can supply. What a child cannot supply goes to its
siblings first and, since a node never gets more than its own subtree supplies, to the siblings of an
ancestor only when they are exhausted. Each leaf then takes whole seeded epochs of its documents and a
token-prefix of the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tables import BROADCAST_IDS, forget, written

NONE = "(none)"
#: First hex digits of the shuffle key; a leaf's documents fall into 4096 such buckets.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text, runs without white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", "")).cast("long")


def _shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, weight, supply, parent_budget) with a budget by water-filling.

    Children in order of supply per weight: one is exhausted if the level that the rest could share is no lower than its
    own, so running sums of supplies and weights decide for all children of a parent at once.
    """
    window = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
    ordered = window.orderBy(F.col("ratio").asc_nulls_last(), F.col(name))
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rest = ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumn("ratio", ratio)
    nodes = nodes.withColumn("left_over", F.col("parent_budget") - F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("supply"))).over(before), F.lit(0)))
    nodes = nodes.withColumn("level", F.when(F.col("weight") > 0, F.col("left_over") / F.sum("weight").over(rest)))
    full = F.coalesce(F.col("ratio") <= F.col("level"), F.lit(False))
    nodes = nodes.withColumn("full", full)
    shared = F.max(F.when(~F.col("full"), F.col("level"))).over(window)  # that of the first one not exhausted
    budget = F.when(F.col("full"), F.col("supply").cast("double")).otherwise(F.coalesce(F.col("weight") * shared, F.lit(0.0)))
    return nodes.withColumn("budget", F.least(F.greatest(budget, F.lit(0.0)), F.col("supply").cast("double"))).drop("ratio", "left_over", "level", "full", "parent_budget")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], budget_share: float, max_epochs: int) -> DataFrame:
    """leaves (levels..., tokens) with a token budget each.

    weights: for each level, the weight of each value among its siblings; values that are not named weigh 1.
    budget_share: the whole budget as a share of all tokens. A leaf supplies max_epochs times its tokens.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    whole = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget_share)).alias("parent_budget"))
    out = None
    for k, name in enumerate(levels):
        own = leaves.groupBy(*levels[: k + 1]).agg(F.sum("supply").alias("supply"))
        given = weights.get(name, {})
        weight = F.coalesce(F.create_map(*(F.lit(x) for pair in given.items() for x in pair))[F.col(name)].cast("double"), F.lit(1.0)) if given else F.lit(1.0)
        own = own.withColumn("weight", weight)
        own = own.crossJoin(F.broadcast(whole)) if k == 0 else own.join(out.select(*levels[:k], F.col("budget").alias("parent_budget")), levels[:k])
        out = _shared_out(own, levels[:k], name)
    return out.select(*levels, "weight", "supply", F.round("budget", 6).alias("budget"))


def mix(
    docs: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", budget_share: float = 0.5, max_epochs: int = 3, seed: str = "mix-1"
) -> DataFrame:
    """docs with the columns n_tokens and epoch: the rows that the budget buys, once for each epoch they are in.

    Tokens are words of the whole text. In epoch e a leaf's documents stand in the order of
    md5(seed:e:id), ties by id; the last epoch takes the longest prefix within what is left of the leaf's
    budget, so a leaf never exceeds it. Null levels form a leaf of their own, `(none)`. Texts without
    words cost nothing and go with every full epoch and prefix that reaches them. Rows with a null id
    stand in the order of their texts. Repeated rows stand together and are cut together, before the first of them that
    does not fit. An empty table gives no rows. Columns of docs named n_tokens or epoch are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch")]
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))))
    paths = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)) for c in levels]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), key.alias("key"), *(p.alias(f"level_{k}") for k, p in enumerate(paths)), word_count(F.col(text_col).cast("string")).alias("n_tokens"))
    path = [f"level_{k}" for k in range(len(levels))]
    sized = written(marked.select("key", "n_tokens", *path), "sized")
    leaves = written(sized.groupBy(*path).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    budgets = leaf_budgets(leaves, path, {f"level_{k}": weights.get(c, {}) for k, c in enumerate(levels)}, budget_share, max_epochs)
    plan = budgets.join(leaves, path).select(*path, "tokens", F.floor("budget").alias("budget"))
    plan = plan.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    plan = written(plan.select(*path, "full", "rest"), "plan")
    few = plan.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # one row a leaf
    hinted = F.broadcast(plan) if few else plan

    # where the prefix ends: first the bucket of the shuffle order, then the rows of that bucket alone
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("full").cast("string"), F.col("key")).cast("binary"))
    placed = sized.join(hinted, path).withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    buckets = placed.groupBy(*path, "bucket").agg(F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest"))
    running = F.sum("tokens").over(Window.partitionBy(*path).orderBy("bucket"))
    ends = buckets.withColumn("after", running).where("after > rest").groupBy(*path).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("after") + F.col("tokens")).alias("room")), "bucket").alias("end"))
    ends = written(ends.select(*path, F.col("end.bucket").alias("end_bucket"), F.col("end.room").alias("room")), "ends")
    hinted_ends = F.broadcast(ends) if few else ends
    edge = placed.join(hinted_ends, path).where("bucket = end_bucket")
    upto = F.sum("n_tokens").over(Window.partitionBy(*path).orderBy("order", "key"))
    stop = edge.withColumn("upto", upto).where("upto > room").groupBy(*path).agg(F.min(F.struct("order", "key")).alias("stop"))
    stop = written(plan.join(ends, path, "left").join(stop, path, "left").select(*path, "full", "stop"), "stops")
    forget(sized, leaves, plan, ends)

    own = marked.join(F.broadcast(stop) if few else stop, path).withColumn("order", order)
    in_prefix = F.col("stop").isNull() | (F.struct("order", "key") < F.col("stop"))
    copies = (F.col("full") + F.when(in_prefix, 1).otherwise(0)).cast("int")
    taken = own.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return taken.select("row.*", "n_tokens", "epoch")
