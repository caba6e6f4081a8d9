"""Merkle manifest of a table by slot pivots.

Every row is a leaf. Leaves of one group (``source``) form a tree of fixed
fanout, and the roots of the groups form a tree above them. A level is one
aggregate: the children of a parent spread into ``fanout`` columns ``c0, c1,
...`` by conditional aggregates over their slot (position modulo fanout). The
columns joined are what the parent's digest is taken of, and all of them but
the own one are a child's siblings, so no level is ever joined with itself.

1. Positions in a group come from one range shuffle of digests by (group, key)
   and the row counts of its pieces, so that a group holding a third of all
   rows is many tasks. Texts are read once and never move.
2. Levels are built bottom up and written; each has a third of the rows of the
   one below. A parent has at most ``fanout`` children, so no key is hot.
3. Paths go top down: a pivot row meets the path of its parent, and its slots
   become rows with the siblings to their left and right put before it. The
   lowest pivot also holds the rows' own values, so leaves meet their paths
   without a join of their own.
4. The path of a row gives its proof, and folding any leaf digest over it gives
   the root that this leaf would belong to.

The driver reads two numbers (the largest group, the number of groups) and one
digest (the root).

Cases: a null group is a group of its own and comes first; null keys come
first in their group; equal keys are ordered by digest, so equal rows can be
swapped without changing any result; null or empty texts are fields like
others; a lone leaf is its group's root and has no siblings there; an empty
table gives no rows; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlake.llm.common import materialise, narrow
from fleetlake.operators.position import BLOCK, ROW, number_rows, positions_from_numbered

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value, so that joined fields cannot be confused."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def _joined(columns: Sequence[str]) -> Column:
    """Digests side by side; slots that have no child are null and add nothing."""
    return F.concat_ws("", *columns) if columns else F.lit("")


def _slots(fanout: int) -> list[str]:
    return [f"c{j}" for j in range(fanout)]


def _positions(leaves: DataFrame, key: str, group: str) -> DataFrame:
    """``tree`` (one number a group, ascending with it), ``pos`` in it and its size ``n``, for every leaf."""
    order = [F.col(group).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("digest")]
    # written first: the range shuffle looks at its input twice, which shall not be the texts
    numbered = materialise(number_rows(materialise(leaves, "merkle-digests"), order), "merkle-leaves")
    # a group is a stretch of neighbouring blocks: one row for each block and group in it
    piece = numbered.groupBy(BLOCK, group).agg(F.min(ROW).alias("lo"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy(group)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.select(
        F.col(BLOCK).alias("in_block"),
        F.col(group).alias("in_group"),
        "lo",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"),
        F.sum("rows").over(whole).alias("n"),
        F.min("lo").over(whole).alias("tree"),
    )
    return numbered.join(piece, (F.col(BLOCK) == F.col("in_block")) & F.col(group).eqNullSafe(F.col("in_group"))).select(
        "tree", (F.col(ROW) - F.col("lo") + F.col("first")).alias("pos"), "n", "digest", "own"
    )


def pivot(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents of the nodes of trees that have several left: their children's digests and values by slot."""
    slot = F.pmod("pos", F.lit(fanout))
    values = [c for c in ("digest", "own") if c in nodes.columns]
    spread = [
        F.max(F.when(slot == j, F.col(c))).alias(f"{'c' if c == 'digest' else 'own'}{j}")
        for c in values
        for j in range(fanout)
    ]
    return (
        nodes.filter("n > 1")
        .groupBy("tree", F.expr(f"pos div {fanout}").alias("pos"))
        .agg(F.expr(f"(max(n) + {fanout - 1}) div {fanout}").alias("n"), *spread)
        .withColumn("digest", F.sha2(_joined(_slots(fanout)), 256))
    )


def _levels(leaves: DataFrame, fanout: int, tag: str) -> list[DataFrame]:
    """The written pivots of every level, lowest first."""
    left = leaves.agg(F.max("n")).first()[0] or 0  # one number
    out, nodes = [], leaves
    while left > 1:
        nodes = materialise(pivot(nodes, fanout), f"{tag}-{len(out)}")
        out.append(nodes)
        nodes = nodes.select("tree", "pos", "n", "digest")
        left = -(-left // fanout)
    return out


def _roots(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    found = leaves.filter("n = 1").select("tree", "digest")
    for level in levels:
        found = found.unionByName(level.filter("n = 1").select("tree", "digest"))
    return found


def _paths(
    leaves: DataFrame, levels: list[DataFrame], crown: Callable[[DataFrame], DataFrame], extra: Sequence[str], fanout: int
) -> DataFrame:
    """``own``, ``digest``, ``path`` and ``extra`` of every leaf; ``crown`` gives roots their ``path`` and ``extra``."""
    names = _slots(fanout)
    known = None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        met = crown(level.filter("n = 1"))
        if known is not None:
            met = met.unionByName(level.filter("n > 1").join(known, ["tree", "pos"]))
        child = [
            F.struct(
                (F.col("pos") * fanout + j).alias("pos"),
                F.col(names[j]).alias("digest"),
                F.struct(_joined(names[:j]).alias("left"), _joined(names[j + 1 :]).alias("right")).alias("step"),
                *([F.col(f"own{j}").alias("own")] if depth == 0 else []),
            )
            for j in range(fanout)
        ]
        rows = met.select("tree", "path", *extra, F.explode(F.array(*child)).alias("x")).filter("x.digest IS NOT NULL")
        path = F.concat(F.array("x.step"), "path").alias("path")
        wanted = ["x.own", "x.digest"] if depth == 0 else ["tree", "x.pos"]
        known = rows.select(*wanted, path, *extra)
    lone = crown(leaves.filter("n = 1")).select("own", "digest", "path", *extra)
    return lone if known is None else lone.unionByName(known)


def fold(leaf: Column, path: Column) -> Column:
    """The root over ``path`` if ``leaf`` stood at its foot."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The proof: sibling digests level by level upwards, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    altered: Column | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """``key``, ``leaf``, ``subroot``, ``root``, ``path`` and ``altered`` of every row.

    ``path`` lists (left, right) siblings from the leaf up to the root.
    ``altered``, a column over the rows of ``docs``, travels with its row; it
    is meant for the digest of a changed row, to be folded over the path.
    """
    own = F.struct(F.col(f"`{key}`").alias("key"), (F.lit(None).cast("string") if altered is None else altered).alias("altered"))
    rows = narrow(docs, *dict.fromkeys([*fields, key, group])).select(
        F.col(f"`{key}`").alias("k"),
        F.col(f"`{group}`").alias("g"),
        row_digest([F.col(f"`{c}`") for c in fields]).alias("digest"),
        own.alias("own"),
    )
    leaves = _positions(rows, "k", "g")
    levels = _levels(leaves, fanout, "merkle-group")

    # the tree above: its leaves are the groups' roots in the order of the groups
    numbered = materialise(
        number_rows(_roots(leaves, levels).select(F.col("tree").alias("own"), "digest"), [F.col("own")]), "merkle-roots"
    )
    groups = numbered.count()
    upper = positions_from_numbered(numbered, "pos").withColumns({"tree": F.lit(0), "n": F.lit(groups)})
    above = _levels(upper, fanout, "merkle-top")
    found = _roots(upper, above).select("digest").first()  # one digest
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    tops = _paths(upper, above, lambda root: root.withColumn("path", nothing), [], fanout).select(
        F.col("own").alias("tree"), F.col("digest").alias("subroot"), "path"
    )
    return _paths(leaves, levels, lambda roots: roots.join(tops, "tree"), ["subroot"], fanout).select(
        F.col("own.key").alias(key),
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(found["digest"] if found else None).cast("string").alias("root"),
        "path",
        F.col("own.altered").alias("altered"),
    )
