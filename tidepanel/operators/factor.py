"""Factors as Python objects that become columns, many in one plan.

A window can't be applied to a window in one projection, so an expression is cut into layers: each layer adds the columns
whose inputs the layers before have made. Equal parts of several factors are made once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import crosssection as cs
from tidepanel.functions import scalar as sc
from tidepanel.functions import timeseries as ts
from tidepanel.operators.asof import label_panel


@dataclass(frozen=True)
class Node:
    """An operator applied to parts; ``lookback`` is how many sessions before the present one it reads."""

    name: str
    parts: tuple[Any, ...]
    build: Callable[..., Column] = field(compare=False, hash=False)
    windowed: bool = False
    own_lookback: int = 0

    @property
    def lookback(self) -> int:
        return self.own_lookback + max((p.lookback for p in self.parts if isinstance(p, Node)), default=0)

    @property
    def depth(self) -> int:
        """How many windows are applied one on another."""
        return self.windowed + max((p.depth for p in self.parts if isinstance(p, Node)), default=0)

    def _with(self, name: str, other: Any, build: Callable[..., Column], flip: bool = False) -> Node:
        return Node(name, (other, self) if flip else (self, other), build)

    def __add__(self, other): return self._with("add", other, lambda a, b: a + b)
    def __radd__(self, other): return self._with("add", other, lambda a, b: a + b, True)
    def __sub__(self, other): return self._with("sub", other, lambda a, b: a - b)
    def __rsub__(self, other): return self._with("sub", other, lambda a, b: a - b, True)
    def __mul__(self, other): return self._with("mul", other, lambda a, b: a * b)
    def __rmul__(self, other): return self._with("mul", other, lambda a, b: a * b, True)
    def __truediv__(self, other): return self._with("div", other, sc.divide)
    def __rtruediv__(self, other): return self._with("div", other, sc.divide, True)
    def __neg__(self): return Node("neg", (self,), lambda a: -a)


def col(name: str) -> Node:
    """A field of the panel."""
    return Node("col", (name,), lambda n: n)


OPERATORS: dict[str, tuple[Callable[..., Column], Callable[[tuple], int]]] = {}


def register_operator(name: str, build: Callable[..., Column], lookback: Callable[[tuple], int] = lambda args: 0) -> Callable[..., Node]:
    """A windowed operator: ``build(Column..., numbers...)`` and how far back it reads given its arguments."""
    OPERATORS[name] = (build, lookback)
    return lambda *args: Node(name, args, build, True, lookback(args))


def _last(args: tuple) -> int:
    return int(args[-1]) - 1


ts_delay = register_operator("ts_delay", ts.ts_delay, lambda a: int(a[-1]))
ts_delta = register_operator("ts_delta", ts.ts_delta, lambda a: int(a[-1]))
ts_mean, ts_std_dev, ts_sum = (register_operator(n, getattr(ts, n), _last) for n in ("ts_mean", "ts_std_dev", "ts_sum"))
ts_corr, ts_covariance = (register_operator(n, getattr(ts, n), _last) for n in ("ts_corr", "ts_covariance"))
ts_arg_min, ts_arg_max, ts_scale, ts_rank = (register_operator(n, getattr(ts, n), _last) for n in ("ts_arg_min", "ts_arg_max", "ts_scale", "ts_rank"))
ts_zscore, ts_min, ts_max = (register_operator(n, getattr(ts, n), _last) for n in ("ts_zscore", "ts_min", "ts_max"))
linear_decay = register_operator("linear_decay", ts.linear_decay, _last)
rank = register_operator("rank", cs.rank)


def apply(name: str, build: Callable[..., Column], *args: Any) -> Node:
    """A scalar function of nodes."""
    return Node(name, args, build)


@dataclass(frozen=True)
class Factor:
    """``delay`` shifts every input, ``decay`` smooths the value, ``neutralization`` (a label, or MARKET) takes means off."""

    name: str
    expression: Node
    delay: int = 0
    decay: int = 0
    neutralization: str | None = None

    @property
    def warmup(self) -> int:
        return self.delay + self.expression.lookback + max(0, self.decay - 1)


def fields_of(node: Node) -> set[str]:
    """Fields of the panel that an expression reads."""
    return {node.parts[0]} if node.name == "col" else {f for p in node.parts if isinstance(p, Node) for f in fields_of(p)}


def evaluate(panel: DataFrame, factors: list[Factor], labels: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (session, security_id, columns of the panel to ``keep``, a column for each factor) over a dense panel.

    All factors share one shuffle by security; neutralisation and ranks add one by session. ``labels`` is the label history
    (security_id, effective_at, available_at and labels), needed where a factor neutralises by a label.
    """
    made: dict[Node, str] = {}
    out = panel
    for delay, name in sorted({(f.delay, n) for f in factors for n in fields_of(f.expression)}):
        out = out.withColumn(f"__{name}_{delay}", ts.ts_delay(F.col(name), delay) if delay else F.col(name))

    def moved(node: Any, delay: int) -> Any:
        """The node over inputs that are shifted by ``delay``."""
        if not isinstance(node, Node):
            return node
        if node.name == "col":
            return Node("col", (f"__{node.parts[0]}_{delay}",), node.build)
        return Node(node.name, tuple(moved(p, delay) for p in node.parts), node.build, node.windowed, node.own_lookback)

    def column(node: Any) -> Any:
        if not isinstance(node, Node):
            return node
        if node in made:
            return F.col(made[node])
        if node.name == "col":
            return F.col(node.parts[0])
        return node.build(*map(column, node.parts))

    trees = {f.name: moved(f.expression, f.delay) for f in factors}
    layers: dict[int, list[Node]] = {}

    def gather(node: Any) -> None:
        if isinstance(node, Node):
            for p in node.parts:
                gather(p)
            if node.windowed and node not in layers.setdefault(node.depth, []):
                layers[node.depth].append(node)

    for tree in trees.values():
        gather(tree)
    for depth in sorted(layers):
        names = {f"__n{len(made) + i}": node for i, node in enumerate(layers[depth])}
        out = out.withColumns({k: column(node) for k, node in names.items()})
        made |= {node: k for k, node in names.items()}
    out = out.select("session", "security_id", *keep, *(column(trees[f.name]).alias(f.name) for f in factors))
    smooth = {f.name: ts.linear_decay(F.col(f.name), f.decay) for f in factors if f.decay > 1}
    if smooth:
        out = out.withColumns(smooth)
    by = sorted({f.neutralization for f in factors if f.neutralization and f.neutralization != "MARKET"})
    if by:
        out = label_panel(out, labels, by)
    neutral = {f.name: cs.group_neutralize(F.col(f.name), F.lit(1) if f.neutralization == "MARKET" else F.col(f.neutralization)) for f in factors if f.neutralization}
    if neutral:
        out = out.withColumns(neutral)
    return out.select("session", "security_id", *keep, *(f.name for f in factors))


def long_form(wide: DataFrame, factors: list[Factor], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (session, security_id, columns to ``keep``, factor_id, value), so that one sort ranks all factors."""
    return wide.unpivot(["session", "security_id", *keep], [f.name for f in factors], "factor_id", "value")
