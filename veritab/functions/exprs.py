"""Candidate expressions as Catalyst columns.

A candidate is a nested tuple: ``("num", v)``, ``("var", name)``,
``("neg", a)``, ``("inv", a)``, ``("pow", a, k)``, ``("func", name, a)``,
``("add", a, b, ..)``, ``("mul", a, b, ..)``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOMAIN_EPS = 1e-9
_UNARY = {"abs": F.abs, "log": F.ln, "sqrt": F.sqrt, "exp": F.exp}


@dataclass(frozen=True)
class Candidate:
    """One candidate: its id and its expression tree."""

    cand_id: str
    ast: tuple

    def variables(self) -> list[str]:
        return sorted(_fold(self.ast, lambda n: {n[1]} if n[0] == "var" else set(), set.union))

    def nodes(self) -> int:
        return _fold(self.ast, lambda n: 1, lambda a, b: a + b)

    def depth(self) -> int:
        return _depth(self.ast)

    def conditions(self) -> int:
        return len(_conditions(self.ast, DOMAIN_EPS))

    def json(self) -> str:
        return json.dumps(self.ast, separators=(",", ":"))


def _children(node: tuple) -> tuple:
    return tuple(c for c in node[1:] if isinstance(c, tuple))


def _fold(node: tuple, leaf, merge):
    return reduce(merge, (_fold(c, leaf, merge) for c in _children(node)), leaf(node))


def _depth(node: tuple) -> int:
    return 1 + max((_depth(c) for c in _children(node)), default=0)


def to_column(node: tuple) -> Column:
    """Value column; undefined points give null or a non-finite number."""
    kind = node[0]
    if kind == "num":
        return F.lit(float(node[1]))
    if kind == "var":
        return F.col(node[1]).cast("double")
    if kind == "func":
        return _UNARY[node[1]](to_column(node[2]))
    args = [to_column(c) for c in _children(node)]
    if kind == "neg":
        return -args[0]
    if kind == "inv":
        return F.try_divide(F.lit(1.0), args[0])
    if kind == "pow":
        return F.pow(args[0], F.lit(float(node[2])))
    if kind == "add":
        return reduce(lambda a, b: a + b, args)
    if kind == "mul":
        return reduce(lambda a, b: a * b, args)
    raise ValueError(f"unknown expression kind {kind!r}")


def _conditions(node: tuple, eps: float) -> list[Column]:
    own: list[Column] = []
    if node[0] == "inv" or (node[0] == "pow" and node[2] < 0):
        own.append(F.abs(to_column(node[1])) > eps)
    elif node[0] == "func" and node[1] == "sqrt":
        own.append(to_column(node[2]) >= 0)
    elif node[0] == "func" and node[1] == "log":
        own.append(to_column(node[2]) > 0)
    return reduce(list.__add__, (_conditions(c, eps) for c in _children(node)), own)


def domain_column(cand: Candidate, eps: float = DOMAIN_EPS) -> Column:
    """True where every division, root and logarithm of the candidate is defined."""
    checks = _conditions(cand.ast, eps)
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False)) if checks else F.lit(True)


def is_finite(col: Column) -> Column:
    return F.coalesce(~F.isnan(col) & (F.abs(col) < float("inf")), F.lit(False))


def explode_candidates(df: DataFrame, cands: list[Candidate], eps: float = DOMAIN_EPS, batch: int = 50) -> DataFrame:
    """One row per (row, candidate) with ``cand``, ``in_domain`` and ``z``.

    ``z`` is null outside the domain and where the value is not finite. Batches
    keep the generated method of one projection below the JVM size limit.
    """
    parts = []
    for i in range(0, len(cands), batch):
        structs = []
        for c in cands[i:i + batch]:
            ok, value = domain_column(c, eps), to_column(c.ast)
            structs.append(F.struct(
                F.lit(c.cand_id).alias("cand"), ok.alias("in_domain"),
                F.when(ok & is_finite(value), value).alias("z"),
            ))
        parts.append(df.select("*", F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def candidate_table(spark, cands: list[Candidate]) -> DataFrame:
    """Metadata of the candidates (small by construction: one row per spec entry)."""
    return spark.createDataFrame(
        [(c.cand_id, c.json(), c.nodes(), c.depth(), c.conditions()) for c in cands],
        "cand string, expression string, nodes int, depth int, conditions int",
    )
