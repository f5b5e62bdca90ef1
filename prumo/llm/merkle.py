"""A Merkle manifest of a table: a hash per row, a tree per group, a tree over the groups, and a proof per row.

Rows are numbered within their group, and the base-8 digits of the number say where a row hangs. A block of 8^DIGITS
consecutive rows is rolled up by grouping one digit away after the other, children nested in their parent as structs,
so a block ends as one row with its digest and all that hangs below. The blocks' digests are the leaves of the next
pass, until one node is left per group; the groups' nodes form one more tree in the same way. On the way back
each block row gets the path above it, and transforms and explodes hand it down to the leaves: no join, and no row
ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prumo.llm.common import named
from prumo.session import materialize

BITS = 3  # of a digit: 8 children make a node
FAN = 1 << BITS
DIGITS = 3  # digits grouped away in one pass
STEP = "array<struct<before:string,after:string>>"


def digest_of(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of values, each `-` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    parts = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame) -> DataFrame:
    """(grp, key, digest, …) plus `rank` from 0 in the order of (key, digest) within a group, nulls first, and `n`, its rows.

    Rows are sorted in ranges of (grp, key, digest); a range's first number follows from the counts of those before it.
    """
    order = ["grp", "key", "digest"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits number the range, the lower ones the row in it.
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), "merkle-ranges")
    spans = placed.groupBy("grp", F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("grp").alias("_grp"),
        F.col("_range"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    same = (F.shiftright("_at", 33) == F.col("_range")) & F.col("grp").eqNullSafe(F.col("_grp"))
    return placed.join(spans, same).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_grp", "_range", "_shift")


def _rolled(nodes: DataFrame) -> DataFrame:
    """(grp, rank, n, digest, held) → a row per block: (grp, rank of the block, n, digest, held), its nodes nested in `held`.

    The rows of a block meet once; grouping away one digit after the other needs no further shuffle. A tree of n
    nodes has another level above 8^level of them.
    """
    digits = [F.shiftright("rank", BITS * k).bitwiseAND(FAN - 1).alias(f"d{k}") for k in range(DIGITS)]
    block = F.shiftright("rank", BITS * DIGITS).alias("block")
    rolled = nodes.select("grp", block, "n", "digest", "held", *digits).repartition("grp", "block")
    for level in range(DIGITS):
        keys = ["grp", "block", "n", *[f"d{k}" for k in range(level + 1, DIGITS)]]
        kid = F.struct(F.col(f"d{level}").alias("at"), "digest", "held")
        rolled = rolled.groupBy(*keys).agg(F.sort_array(F.collect_list(kid)).alias("held"))
        joint = F.sha2(F.array_join("held.digest", ""), 256)
        rolled = rolled.withColumn("digest", F.when(F.col("n") > FAN**level, joint).otherwise(F.col("held.digest")[0]))
    return rolled.withColumnRenamed("block", "rank")


def _spread(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, rank, digest, held, path, subroot, root) of the nodes in `blocks`, given (grp, rank, path, subroot, root) of the
    blocks themselves.

    A block and what stands above it meet by grouping. `path` lists, from the node upwards, the digests before and
    after it among the children of its parent, a struct per level.
    """
    nest = F.struct("n", "held").alias("nest")
    head = F.struct("path", "subroot", "root").alias("head")
    none = {"nest": blocks.select(nest).schema["nest"].dataType, "head": above.select(head).schema["head"].dataType}
    rows = blocks.select("grp", "rank", nest, F.lit(None).cast(none["head"]).alias("head")).unionByName(
        above.select("grp", "rank", F.lit(None).cast(none["nest"]).alias("nest"), head)
    )
    met = rows.groupBy("grp", "rank").agg(F.collect_list("nest")[0].alias("nest"), F.collect_list("head")[0].alias("head"))
    down = met.select("grp", "rank", "nest.*", "head.*")
    for level in reversed(range(DIGITS)):
        digests = F.col("held")["digest"]
        beside = F.transform(
            "held",
            lambda kid, i: F.struct(
                kid["at"].alias("at"),
                kid["digest"].alias("digest"),
                kid["held"].alias("below"),
                F.array_join(F.slice(digests, F.lit(1), i), "").alias("before"),
                F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("after"),
            ),
        )
        step = F.when(F.col("n") > FAN**level, F.array(F.struct("before", "after"))).otherwise(F.array().cast(STEP))
        down = down.select("grp", "rank", "n", "path", "subroot", "root", F.inline(beside)).select(
            "grp",
            (F.col("rank") * FAN + F.col("at")).alias("rank"),
            "n",
            F.concat(step, "path").alias("path"),
            "subroot",
            "root",
            "digest",
            F.col("below").alias("held"),
        )
    return down.drop("n")


def _above(blocks: DataFrame, top: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(grp, rank, path, subroot, root) of block rows: by further passes while a group has several, then by `top`."""
    size = FAN**DIGITS
    nodes = blocks.select("grp", "rank", F.ceil(F.col("n") / size).alias("n"), "digest", F.lit(None).cast("int").alias("held"))
    if nodes.filter("n > 1").isEmpty():
        return top(nodes)
    rolled = materialize(_rolled(nodes), "merkle-nodes")
    return _spread(rolled, _above(rolled, top)).select("grp", "rank", "path", "subroot", "root")


def _root(nodes: DataFrame) -> DataFrame:
    return nodes.select("grp", "rank", F.array().cast(STEP).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))


def _over_groups(nodes: DataFrame) -> DataFrame:
    """The tree over the groups' own roots, in the order of the groups, null first."""
    leaves = numbered(nodes.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "digest"))
    rolled = materialize(_rolled(leaves.select("grp", "rank", "n", "digest", F.struct("key").alias("held"))), "merkle-groups")
    spread = _spread(rolled, _above(rolled, _root))
    zero = F.lit(0).cast("long").alias("rank")
    return spread.select(F.col("held.key").alias("grp"), zero, "path", F.col("digest").alias("subroot"), "root")


def manifest(rows: DataFrame, fields: Sequence[str], group: str, key: str, carried: dict[str, Column] | None = None) -> DataFrame:
    """A row per row of `rows`: grp, rank, leaf, path, subroot, root, and the columns `carried`.

    A leaf is the digest of the columns `fields`. Within a value of `group` (null is one, too) leaves stand by `key`, nulls first,
    equal keys by leaf; every 8 consecutive nodes, at the end fewer, make the next level, until one is left, the
    subroot. The subroots in the order of the groups' UTF-8 bytes, null first, make `root` in the same way. Equal rows are
    leaves of their own; empty and very long values are hashed whole; an empty table gives no row. Rows keep
    only digests and `carried` after the hash, so extra columns of any name do no harm.
    """
    leaves = rows.select(
        named(group).alias("grp"),
        named(key).alias("key"),
        digest_of([named(f) for f in fields]).alias("digest"),
        F.struct(named(key).alias("key"), *[c.alias(name) for name, c in (carried or {}).items()]).alias("carried"),
    )
    placed = numbered(leaves).select("grp", "rank", "n", "digest", F.col("carried").alias("held"))
    blocks = materialize(_rolled(placed), "merkle-blocks")
    spread = _spread(blocks, _above(blocks, _over_groups))
    return spread.select("grp", "rank", F.col("digest").alias("leaf"), "path", "subroot", "root", "held.*")


def siblings_of(path: Column) -> Column:
    """The digests of a path's siblings, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give: the manifest's root, if the row is what it was."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))
