"""Sums of products over tables that share variables: variables are summed out along a join tree, before every join.

A factor is a relation over variables with a value. Its variables that no other factor has and that the result doesn't
keep are summed out at once; a factor whose other variables all lie in a second one is an ear, and becomes a message: one
row for each value of what they share, multiplied into the second. On acyclic networks no intermediate then has more rows
than its inputs. Where no ear is left the network has a cycle, and the two factors whose join the statistics expect to be
smallest are joined.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .skew import lookup

#: Factors of more rows than this have their hot keys looked for before a join.
SPLIT_ROWS = 1_000_000


@dataclass
class Factor:
    """rows with one column for each variable and a value. Rows with a null variable meet no other factor's."""

    name: str
    rows: DataFrame
    variables: tuple[str, ...]
    value: str = "re"


@dataclass
class Semiring:
    """How values of the same key are added, and those of different factors multiplied."""

    plus: Callable[[Column], Column] = F.sum
    times: Callable[[Column, Column], Column] = lambda a, b: a * b


SUM, MAX, MIN_SUM = Semiring(), Semiring(F.max), Semiring(F.min, lambda a, b: a + b)


@dataclass
class _Node:
    name: str
    rows: DataFrame
    variables: frozenset[str]
    size: float
    distinct: dict[str, float] = field(default_factory=dict)
    #: Whether rows with the same variables have been added up.
    unique: bool = False

    def keys(self, on: frozenset[str]) -> float:
        """How many values of `on` there are at most."""
        out = 1.0
        for v in on:
            out *= max(self.distinct.get(v, self.size), 1.0)
        return min(out, self.size)


@dataclass
class Step:
    """What was done: sum, absorb, merge or reduce; the rows of its inputs and of its result can be counted."""

    kind: str
    name: str
    inputs: list[DataFrame]
    result: DataFrame


def _measured(f: Factor) -> _Node:
    rows = f.rows.select(*f.variables, F.col(f.value).alias("re"))
    got = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.approx_count_distinct(v).alias(v) for v in f.variables]).first()
    return _Node(f.name, rows, frozenset(f.variables), float(got["_n"]), {v: float(got[v]) for v in f.variables})


def _expected(a: _Node, b: _Node) -> float:
    size = a.size * b.size
    for v in a.variables & b.variables:
        size /= max(a.distinct[v], b.distinct[v], 1.0)
    return size


def _private(node: _Node, nodes: list[_Node], free: frozenset[str]) -> frozenset[str]:
    """Variables of a node that have to stay: free ones, and those that others have."""
    others = frozenset().union(*[x.variables for x in nodes if x is not node])
    return node.variables & (others | free)


def _summed(node: _Node, keep: frozenset[str], ring: Semiring, steps: list[Step]) -> _Node:
    on = sorted(keep)
    rows = node.rows.groupBy(*on).agg(ring.plus(F.col("re")).alias("re"))
    steps.append(Step("sum", node.name, [node.rows], rows))
    return _Node(node.name, rows, keep, node.keys(keep), {v: d for v, d in node.distinct.items() if v in keep}, True)


def _reduced(leaf: _Node, parent: _Node, on: frozenset[str], steps: list[Step]) -> _Node:
    """leaf without rows that parent has no key for, if that leaves less than half of its keys."""
    share = parent.keys(on) / max(leaf.keys(on), 1.0)
    if share >= 0.5 or leaf.size <= 1:
        return leaf
    rows = leaf.rows.join(parent.rows.select(*sorted(on)).distinct(), sorted(on), "left_semi")
    steps.append(Step("reduce", f"{leaf.name} by {parent.name}", [leaf.rows], rows))
    return _Node(leaf.name, rows, leaf.variables, leaf.size * share, {v: min(d, d * share if v in on else d, max(leaf.size * share, 1.0)) for v, d in leaf.distinct.items()})


def _times(rows: DataFrame, other: DataFrame, on: list[str], ring: Semiring, unique: bool, size: float) -> DataFrame:
    right = other.withColumnRenamed("re", "_re")
    if not on:
        raise ValueError("no variable in common")
    joined = lookup(rows, right, on) if unique and size > SPLIT_ROWS else rows.join(right, on)
    return joined.withColumn("re", ring.times(F.col("re"), F.col("_re"))).drop("_re")


def sum_product(factors: list[Factor], free: tuple[str, ...] = (), ring: Semiring = SUM, steps: list[Step] | None = None) -> DataFrame:
    """(free..., re): the sum over all other variables of the product of the factors.

    Order, ears and joins are chosen from each factor's row count and approximate distinct counts, one row a factor on the
    driver; the result does not depend on them. A semi-join goes before where a factor's neighbour has under half of its
    keys. Factors without a variable in common multiply. Rows that occur twice count twice. An empty factor gives no
    rows, and so does a value that is null everywhere; single null values are left out. steps, if given, is filled with what was done.
    """
    if len({f.name for f in factors}) < len(factors):
        raise ValueError("factors need names of their own")
    unknown = set(free) - {v for f in factors for v in f.variables}
    if unknown:
        raise ValueError(f"no factor has {sorted(unknown)}")
    steps = [] if steps is None else steps
    kept = frozenset(free)
    nodes = [_measured(f) for f in factors]
    # Keys travel from small factors to large ones before anything is summed, each factor after those that narrow it.
    todo, done = set(range(len(nodes))), set()
    while todo:
        i = min(todo, key=lambda k: nodes[k].size)
        todo.remove(i)
        for k, other in enumerate(nodes):
            if k != i and (i, k) not in done and (on := nodes[i].variables & other.variables):
                nodes[k] = _reduced(other, nodes[i], on, steps)
                if nodes[k] is not other:
                    todo.add(k)
                    done |= {(i, k), (k, i)}
                    if other.size > SPLIT_ROWS:
                        nodes[k].rows = table(nodes[k].rows)
    while True:
        for k, node in enumerate(nodes):
            keep = _private(node, nodes, kept)
            if keep != node.variables:
                nodes[k] = _summed(node, keep, ring, steps)
        if len(nodes) == 1:
            break
        ears = [(leaf.size, parent.size, i, j) for i, leaf in enumerate(nodes) for j, parent in enumerate(nodes) if i != j and leaf.variables and leaf.variables <= parent.variables]
        pairs = [(_expected(a, b), 0.0, i, j) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if i < j and a.variables & b.variables]
        if ears:
            _, _, i, j = min(ears)
            leaf, parent = nodes[i], nodes[j]
            message = leaf if leaf.unique else _summed(leaf, leaf.variables, ring, steps)
            rows = _times(parent.rows, message.rows, sorted(leaf.variables), ring, True, parent.size)
            steps.append(Step("absorb", f"{leaf.name} into {parent.name}", [parent.rows, message.rows], rows))
            made = _Node(parent.name, rows, parent.variables, parent.size, parent.distinct, parent.unique)
        elif pairs:
            size, _, i, j = min(pairs)
            a, b = nodes[i], nodes[j]
            rows = _times(a.rows, b.rows, sorted(a.variables & b.variables), ring, False, a.size)
            steps.append(Step("merge", f"{a.name} with {b.name}", [a.rows, b.rows], rows))
            made = _Node(f"{a.name}*{b.name}", rows, a.variables | b.variables, size, {v: min(a.distinct.get(v, float("inf")), b.distinct.get(v, float("inf"))) for v in a.variables | b.variables})
        else:
            # Nothing in common: a part without variables is one number.
            i = next((k for k, x in enumerate(nodes) if not x.variables), None)
            if i is None:
                raise ValueError("free variables of parts that share nothing would pair all their rows")
            j = next(k for k in range(len(nodes)) if k != i)
            number = nodes[i].rows.first()["re"]
            rest = nodes[j].rows.where(F.lit(number is not None)).withColumn("re", ring.times(F.col("re"), F.lit(number)))
            made = _Node(nodes[j].name, rest, nodes[j].variables, nodes[j].size, nodes[j].distinct, nodes[j].unique)
        nodes = [x for k, x in enumerate(nodes) if k not in (i, j)] + [made]
    last = nodes[0]
    out = last if last.unique else _summed(last, kept, ring, steps)
    return out.rows.where("re IS NOT NULL").select(*free, "re")
