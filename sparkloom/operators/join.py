"""Inner equi-joins along a tree of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PredicateError
from ..plans.predicate import Where


@dataclass
class JoinNode:
    """A table in the tree.

    ``alias`` names it (a table may occur twice), ``columns`` are those wanted of it,
    ``edges`` lead from own columns to (child column, child).
    """

    rows: DataFrame
    alias: str
    columns: Sequence[str] = ()
    where: Where = field(default_factory=Where)
    edges: list[tuple[str, str, JoinNode]] = field(default_factory=list)

    def join(self, local: str, remote: str, child: JoinNode) -> JoinNode:
        self.edges.append((local, remote, child))
        return self

    def aliases(self) -> list[str]:
        return [self.alias, *[a for _, _, child in self.edges for a in child.aliases()]]


def _side(node: JoinNode, key: str | None) -> DataFrame:
    """Filtered and pruned rows of a node, columns named ``alias_column``."""
    condition = node.where.to_column()
    rows = node.rows if condition is None else node.rows.where(condition)
    needed = list(dict.fromkeys([*([key] if key else []), *node.columns, *[local for local, _, _ in node.edges]]))
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise PredicateError(f"{node.alias} has no column {missing}")
    return rows.select(*[F.col(c).alias(f"{node.alias}_{c}") for c in needed])


def join_tree(root: JoinNode, missing_key: str = "drop") -> DataFrame:
    """All combinations of rows along the tree, columns named ``alias_column``.

    A root row without a partner, or with a null key, is dropped;
    ``missing_key="keep"`` keeps those of null keys with nulls for that branch.  The
    joins carry no hints: Spark broadcasts a side by its size and shuffles otherwise.
    """
    names = root.aliases()
    if len(set(names)) != len(names):
        raise PredicateError(f"aliases must differ: {names}")

    def build(node: JoinNode, key: str | None, keep: bool) -> DataFrame:
        out = _side(node, key)
        for local, remote, child in node.edges:
            left, right = F.col(f"{node.alias}_{local}"), F.col(f"{child.alias}_{remote}")
            joined = out.join(build(child, remote, False), left == right, "left" if keep else "inner")
            out = joined.where(left.isNull() | right.isNotNull()) if keep else joined
        return out

    def wanted(node: JoinNode, key: str | None) -> list[str]:
        own = [f"{node.alias}_{c}" for c in dict.fromkeys([*([key] if key else []), *node.columns, *[e[0] for e in node.edges]])]
        return own + [c for _, remote, child in node.edges for c in wanted(child, remote)]

    return build(root, None, missing_key == "keep").select(*wanted(root, None))


def restrict_to(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among those that an index found."""
    return rows.join(keys.select(on), on, "left_semi")


def not_present(ids: DataFrame, index: DataFrame, on: str) -> DataFrame:
    """Ids that the index doesn't have."""
    return ids.join(index.select(on), on, "left_anti")
