"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree (domain, language, source): a node's token budget is divided among its children by weight. A child that cannot
fill its part, even by repeating its documents for the allowed epochs, leaves the shortage to its siblings; only what these cannot
take either goes to the siblings of their parent, and so on. Each leaf then takes whole epochs, and of one more, in that epoch's
seeded order, the longest prefix of documents that fits its budget. What a prefix leaves unused is less than its next document; it
goes the same way: siblings whose next document fits what they leave together take it, then those of the parent's siblings.

The tree is a table throughout, one row per leaf; each level is one window over its nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenframe.llm.frames import TEXT_ROWS, Scratch

#: Leaves that are sent to every task for the joins with the documents; of more, the joins shuffle.
MOST_SENT = 50_000
#: Documents of one bucket of a leaf's order, about.
BUCKET_ROWS = 1_000


def word_count(text_col: str = "text") -> Column:
    """Words of a text; 0 for a null. A stand-in for its tokens, in proportion."""
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _names(depth: int) -> list[str]:
    return [f"l{i}" for i in range(depth)]


def _right(frame: DataFrame, depth: int) -> DataFrame:
    """The frame with its path columns under other names, for a join."""
    return frame.withColumnsRenamed({n: f"r{n}" for n in _names(depth)})


def _same(depth: int) -> Column:
    """Join condition on the path's first levels, null or not."""
    return reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"r{n}")) for n in _names(depth)))


def _weighted(nodes: DataFrame, weights: dict[tuple, float], depth: int, default: float) -> DataFrame:
    """The nodes of a level with their weight relative to their siblings."""
    text = lambda v: None if v is None else str(v)
    named = [(*map(text, path), float(w)) for path, w in weights.items() if len(path) == depth]
    if not named:
        return nodes.withColumn("weight", F.lit(float(default)))
    known = nodes.sparkSession.createDataFrame(named, ", ".join(f"r{n} string" for n in _names(depth)) + ", given double")
    return nodes.join(known, _same(depth), "left").select(*nodes.columns, F.coalesce("given", F.lit(float(default))).alias("weight"))


def _share_out(children: DataFrame, depth: int) -> DataFrame:
    """Divide each parent's `amount` among its children by weight where no part exceeds its room: `amount` becomes the child's. What a
    full part leaves goes to the others by weight; if all are full, less than the amount is given. Weight 0 gets nothing.

    In the order of room by weight the full parts come first: each is full if its share of what the ones before leave covers its room.
    """
    part = W.partitionBy(*_names(depth - 1))
    order = part.orderBy("ratio", f"l{depth - 1}")
    open_ = F.col("weight") > 0
    rows = children.withColumn("w", F.when(open_, F.col("weight")).otherwise(0.0)).withColumn("r", F.when(open_, F.col("room")).otherwise(0.0))
    rows = rows.withColumn("ratio", F.when(open_, F.col("r") / F.col("w")).otherwise(float("inf")))
    before = F.coalesce(F.sum("r").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", F.when(open_, F.greatest(F.col("amount") - before, F.lit(0.0)) / F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))))
    rows = rows.withColumn("full", F.coalesce(F.col("r") <= F.col("level") * F.col("w"), F.lit(False))).withColumn("place", F.row_number().over(order))
    first = F.min(F.when(open_ & ~F.col("full"), F.struct("place", "level"))).over(part)
    given = F.when(~open_, 0.0).when(F.col("full"), F.col("r")).otherwise(first["level"] * F.col("w"))
    return rows.withColumn("given", given).drop("amount", "w", "r", "ratio", "level", "full", "place").withColumnRenamed("given", "amount")


def budgets(leaves: DataFrame, weights: dict[tuple, float], total: float | None, epochs: int, depth: int, share: float = 1.0, default: float = 1.0) -> DataFrame:
    """The leaves (l0, l1, ... and n, their tokens) with `budget`. weights: by path of a leaf or inner node, relative to its siblings;
    paths that are not named have the default weight. total: tokens to take; by default `share` times those of all leaves."""
    levels = {depth: _weighted(leaves.withColumn("room", F.col("n") * F.lit(float(epochs))), weights, depth, default)}
    usable = F.when(F.col("weight") > 0, F.col("room")).otherwise(0.0)  # a node of weight 0 has no room, nor its ancestors from it
    for d in range(depth - 1, 0, -1):
        levels[d] = _weighted(levels[d + 1].groupBy(*_names(d)).agg(F.sum(usable).alias("room"), F.sum("n").alias("n")), weights, d, default)
    every = W.partitionBy()  # the root's children
    wanted = F.sum("n").over(every) * F.lit(float(share)) if total is None else F.lit(float(total))
    shared = _share_out(levels[1].withColumn("amount", F.least(wanted, F.sum(usable).over(every))), 1)
    for d in range(2, depth + 1):
        above = _right(shared.select(*_names(d - 1), "amount"), d - 1)
        shared = _share_out(levels[d].join(above, _same(d - 1)).select(*levels[d].columns, "amount"), d)
    return shared.withColumn("budget", F.floor(F.col("amount") + 1e-6)).drop("amount", "room", "weight")


def _extend(ends: DataFrame, depth: int) -> DataFrame:
    """Which leaves take the document after their prefix: `more`. ends: l0, ..., unused (of the budget) and next (tokens of that
    document). From the lowest level up, the smallest next documents that fit what the leaves below a node leave unused together."""
    rows = ends.withColumn("left", F.col("unused")).withColumn("more", F.lit(False))
    for d in range(depth - 1, -1, -1):
        part = W.partitionBy(*_names(d))
        order = part.orderBy("more", "next", *[F.col(n).asc_nulls_first() for n in _names(depth)])
        upto = F.sum(F.when(~F.col("more"), F.col("next"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        rows = rows.withColumn("upto", upto).withColumn("pool", F.sum("left").over(part)).withColumn("place", F.row_number().over(order))
        rows = rows.withColumn("takes", ~F.col("more") & (F.col("upto") <= F.col("pool")))
        spent = F.coalesce(F.max(F.when(F.col("takes"), F.col("upto"))).over(part), F.lit(0))
        rows = rows.withColumn("spent", spent)
        rows = rows.withColumn("left", F.when(F.col("place") == 1, F.col("pool") - F.col("spent")).otherwise(F.lit(0))).withColumn("more", F.col("more") | F.col("takes"))
    return rows.drop("left", "upto", "pool", "place", "takes", "spent", "unused", "next")


class Mix:
    """How often each document of a table is taken."""

    def __init__(
        self,
        docs: DataFrame,
        levels: dict[str, Column],
        weights: dict[tuple, float],
        total: float | None = None,
        epochs: int = 4,
        seed: int = 0,
        id_col: str = "doc_id",
        text_col: str = "text",
        tokens: Column | None = None,
        share: float = 1.0,
    ):
        """levels: the tree's levels from the top, by name; a null value is a child of its own. total: tokens to take; by default
        `share` times those that there are. tokens: a document's tokens (a null counts as 0); by default its words.

        Each document's tokens are counted once, into a narrow table; the order within an epoch is that of a hash of seed, epoch, id
        and text. Rows that agree in both are one block, taken or left together. A null id is an id, a null text has no tokens (a
        document without tokens is taken as often as its place in the order says, at no cost). A leaf takes whole documents; leaves
        that share a parent never take more than their budgets together, but one of them may take part of what another leaves. An
        empty table gives no rows. Columns of the documents may have any names.
        """
        self.docs, self.seed = docs, seed
        scratch = Scratch(docs.sparkSession, "mixing")
        self.path = F.to_json(F.struct(*[c.cast("string").alias(n) for n, c in levels.items()]), {"ignoreNullFields": "false"})
        self.key = F.struct(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{text_col}`")).alias("t"))
        self.count = word_count(text_col) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
        self.narrow = scratch.save(docs.select(self.path.alias("__path"), self.count.alias("__tokens"), self.key.alias("__row")), "narrow", docs.count(), TEXT_ROWS)
        depth = len(levels)
        kind = StructType([StructField(n, StringType()) for n in levels])
        leaves = self.narrow.groupBy("__path").agg(F.sum("__tokens").alias("n"), F.count("*").alias("rows"))
        place = F.from_json("__path", kind)
        leaves = scratch.save(leaves.select(*[place[n].alias(f"l{i}") for i, n in enumerate(levels)], "__path", "n", "rows"), "leaves", self.narrow.count())
        leaf = budgets(leaves, weights, total, epochs, depth, share)
        whole = F.when(F.col("n") > 0, F.least(F.lit(epochs), F.floor(F.col("budget") / F.col("n")))).otherwise(0).cast("long")
        leaf = leaf.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("n")).withColumn("buckets", F.greatest(F.lit(1), F.floor(F.col("rows") / BUCKET_ROWS)))
        leaf = scratch.save(leaf.select(*_names(depth), "__path", "whole", "rest", "buckets"), "budgets", leaves.count())
        size = leaf.count()
        self.few = size <= MOST_SENT
        # The prefix ends in one bucket of hashes per leaf: the sums of the buckets tell which, and only its rows are put in order.
        placed = self.narrow.join(self._sent(leaf.select("__path", "whole", "rest", "buckets").where("rest > 0")), "__path").select("__path", "rest", "__tokens", self._order(F.col("__row")).alias("h"), "buckets")
        placed = placed.withColumn("bucket", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets")))
        sums = placed.groupBy("__path", "rest", "bucket").agg(F.sum("__tokens").alias("n"))
        upto = F.sum("n").over(W.partitionBy("__path").orderBy("bucket"))
        ends = sums.withColumn("upto", upto).where("upto > rest").groupBy("__path").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("e")).select("__path", "e.bucket", "e.before")
        near = placed.join(self._sent(ends), ["__path", "bucket"]).groupBy("__path", "rest", "before", "h").agg(F.sum("__tokens").alias("n"))
        run = F.col("before") + F.sum("n").over(W.partitionBy("__path").orderBy("h"))
        # The first hash that no longer fits; documents before it are the prefix. A leaf with a rest has one: the rest is less than all.
        last = near.withColumn("run", run).where("run > rest").groupBy("__path").agg(F.min(F.struct("h", "n", (F.col("rest") - F.col("run") + F.col("n")).alias("unused"))).alias("e"))
        last = scratch.save(last.select("__path", F.col("e.h").alias("stop"), F.col("e.n").alias("next"), "e.unused"), "ends", size)
        more = _extend(leaf.join(last, "__path").select(*_names(depth), "__path", "stop", "next", "unused"), depth).select("__path", "stop", "more")
        self.rule = scratch.save(leaf.join(more, "__path", "left").select("__path", "whole", "stop", "more"), "rule", size)

    def _sent(self, leaves: DataFrame) -> DataFrame:
        return F.broadcast(leaves) if self.few else leaves

    def _order(self, row: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), F.col("whole"), row)

    def _taken(self, row: Column) -> Column:
        order = self._order(row)
        return (F.col("whole") + F.when((order < F.col("stop")) | F.col("more") & (order == F.col("stop")), 1).otherwise(0)).cast("int")

    def report(self) -> DataFrame:
        """Per document, from the narrow table: id, path (the values of levels), tokens and epochs (0: not taken)."""
        return self.narrow.join(self._sent(self.rule), "__path").select(F.col("__row.i").alias("id"), F.col("__path").alias("path"), F.col("__tokens").alias("tokens"), self._taken(F.col("__row")).alias("epochs"))

    def rows(self) -> DataFrame:
        """All columns of the documents, and __path, __tokens and __epochs. Documents do not move for it; their tokens are counted again
        only if __tokens is used."""
        names = {f"__c{i}": c for i, c in enumerate(self.docs.columns)}
        keyed = self.docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], self.path.alias("__path"), self.count.alias("__tokens"), self.key.alias("__row"))
        joined = keyed.join(self._sent(self.rule), "__path").select(*names, "__path", "__tokens", self._taken(F.col("__row")).alias("__epochs"))
        return joined.withColumnsRenamed(names)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float], **options) -> DataFrame:
    """All columns of docs, and __path, __tokens and __epochs: see Mix."""
    return Mix(docs, levels, weights, **options).rows()


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document as often as it is taken."""
    rows = mixed.where("__epochs > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), "__epochs")))
    return rows.select(*[f"`{c}`" for c in columns])
