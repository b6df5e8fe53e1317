"""A Merkle manifest of a dataset: every row a leaf, a tree per group, one root, and a proof per row.

Trees are tables. A parent is a row whose children stand in `fanout` columns, spread there by conditional aggregates (the slot
pivot). Concatenating the columns gives the parent's digest; leaving out a child's own column gives its siblings. Going down
again, a parent's row is turned back into its children, each of which takes the siblings of its run along, so leaves meet
their proofs without a look-up per leaf and level.

All digests are lowercase hex SHA-256.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficloom.plans.ordered import positions, running_totals
from trafficloom.plans.pinning import pin

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as the digest takes it: `-` for null, else its length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def lowered(text: str) -> Column:
    """A-Z of a text column in lower case, everything else as it is."""
    return F.translate(F.col(text), _UPPER, _LOWER)


def _slots(fanout: int) -> list[str]:
    return [f"_s{k}" for k in range(fanout)]


def _pivot(nodes: DataFrame, fanout: int, value: str) -> DataFrame:
    """One row per run of `fanout` nodes of a tree: (_tree, _at, _s0, _s1, ..), absent nodes null."""
    at = F.col("_at")
    spread = [
        F.first(F.when(F.pmod(at, F.lit(fanout)) == k, F.col(value)), ignorenulls=True).alias(name)
        for k, name in enumerate(_slots(fanout))
    ]
    return nodes.groupBy("_tree", F.floor(at / fanout).alias("_at")).agg(*spread)


def _alone() -> Column:
    """The run is a tree's only node, which is then its root and has no parent."""
    return (F.col("_at") == 0) & F.col("_s1").isNull()


@dataclass(frozen=True)
class _Tree:
    """Pivoted levels from the leaves up, and the root digest of every tree."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int

    def down(self, above: DataFrame) -> DataFrame:
        """(_tree, _child, _at, _path and the columns of `above`) for every leaf.

        `above` has for every tree the path from its root on. The last level's children are handed out as they stand
        in the slots; every level is met once, by (tree, position), so no tree is met on one key.
        """
        names = [c for c in above.columns if c not in ("_tree", "_path")]
        up, slots = None, _slots(self.fanout)
        for level in reversed(self.levels):
            lone = level.where(_alone()).join(above, "_tree").select(
                "_tree", F.lit(0).cast("long").alias("_at"), F.col("_s0").alias("_child"), "_path", *names
            )
            if up is None:
                up = lone
                continue
            known = level.where(~_alone()).join(up.drop("_child"), ["_tree", "_at"])
            texts = [F.coalesce(self._digest_of(level, s), F.lit("")) for s in slots]
            children = F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.col(s).alias("child"),
                        F.struct(
                            F.concat(F.lit(""), *texts[:k]).alias("left"), F.concat(F.lit(""), *texts[k + 1 :]).alias("right")
                        ).alias("step"),
                    )
                    for k, s in enumerate(slots)
                ]
            )
            below = known.select("_tree", "_at", "_path", *names, F.explode(children).alias("_c")).where("_c.child IS NOT NULL")
            up = below.select(
                "_tree",
                (F.col("_at") * self.fanout + F.col("_c.k")).alias("_at"),
                F.col("_c.child").alias("_child"),
                F.concat(F.array("_c.step"), "_path").alias("_path"),
                *names,
            ).unionByName(lone)
        return up

    @staticmethod
    def _digest_of(level: DataFrame, slot: str) -> Column:
        return F.col(slot) if dict(level.dtypes)[slot] == "string" else F.col(f"{slot}._digest")


def _grow(leaves: DataFrame, fanout: int) -> _Tree:
    """Trees over leaves (_tree, _at, _row), `_row._digest` being the leaf; one job per level, each an eighth of the one below."""
    levels, roots, nodes, value = [], None, leaves, "_row"
    while True:
        level = pin(_pivot(nodes, fanout, value))
        levels.append(level)
        first = F.col("_s0._digest" if value == "_row" else "_s0")
        done = level.where(_alone()).select("_tree", first.alias("_digest"))
        roots = done if roots is None else roots.unionByName(done)
        if level.where(~_alone()).isEmpty():
            return _Tree(levels, roots, fanout)
        parts = [F.coalesce(_Tree._digest_of(level, s), F.lit("")) for s in _slots(fanout)]
        nodes = level.where(~_alone()).select("_tree", "_at", digest(*parts).alias("_digest"))
        value = "_digest"


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: Sequence[str] = FIELDS,
    carry: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, path and what `carry` names), one row per row of `docs`.

    A leaf is the digest of the `fields`. Rows of a group (null is a group of its own, apart from the empty text) go by id, nulls
    first, ties by leaf, so repeated rows are repeated leaves. While a tree has several nodes, every `fanout` consecutive
    ones become their digest; what remains is the group's subroot, and the subroots, by group, grow into the root alike.
    `path` lists, from the leaf up, what stands left and right of it in its run. Any integer, text or null is allowed in
    the fields; columns of other names, even those used here, don't matter. An empty table has an empty manifest.
    """
    carried = dict(carry or {})
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(
        group.alias("_tree"),
        F.col(id_col).cast("long").alias("_id"),
        digest(*[field(F.col(c)) for c in fields]).alias("_digest"),
        F.struct(F.lit(0).alias("_"), *[e.alias(c) for c, e in carried.items()]).alias("_more"),
    )
    order = [F.col("_id").asc_nulls_first(), F.col("_digest")]
    placed = running_totals(rows, ["_tree"], order, {"_at": F.lit(1).cast("long")}).select(
        "_tree", (F.col("_at") - 1).alias("_at"), F.struct("_digest", "_id", "_more").alias("_row")
    )
    trees = _grow(placed, fanout)
    tops = pin(
        positions(trees.roots.withColumnRenamed("_tree", "_of"), [F.col("_of")], "_at").select(
            F.lit("").alias("_tree"), "_at", F.struct("_digest", "_of").alias("_row")
        )
    )
    top = _grow(tops, fanout)
    whole = top.roots.select("_tree", F.col("_digest").alias("_root"), F.array().cast(_NO_PATH).alias("_path"))
    above = top.down(whole).select(F.col("_child._of").alias("_tree"), F.col("_child._digest").alias("_subroot"), "_root", "_path")
    return trees.down(pin(above)).select(
        F.col("_child._id").alias("doc_id"),
        F.col("_child._digest").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.col("_path").alias("path"),
        *[F.col(f"_child._more.{c}").alias(c) for c in carried],
    )


def siblings(path: Column) -> Column:
    """The digests of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has by its path."""
    return F.aggregate(path, leaf, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]), 256))


def verified(docs: DataFrame, tampered: Column, changed: Mapping[str, Column], fanout: int = FANOUT) -> DataFrame:
    """Manifest and proof of every row, and whether the row still has the root after the `tampered` ones were changed.

    `changed` gives the altered fields. A null `tampered` means no; a change that leaves a row as it was is no tampering.
    """
    leaf = digest(*[field(changed.get(c, F.col(c))) for c in FIELDS])
    found = manifest(docs, carry={"now": F.when(tampered, leaf)}, fanout=fanout)
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        folded(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
