"""Composed queries: terms, synonyms, phrases, windows, conditions and weights, nested as one likes, as one scan of the texts.

A node that can be counted is an expression of its places in a row's tokens; conditions and scores are expressions of these nodes'
counts. All counts of all queries are made inside the row, of one tokenisation, and written with the document's length; their
frequencies are sums over that narrow table, and scores expressions of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, parted
from ..functions.text import tokens as token_array
from .index import cut
from .search import dirichlet, jelinek_mercer, ranked


@dataclass(frozen=True)
class Node:
    def counted(self) -> Iterator[Node]:
        """The nodes below, or this one, whose counts this one is made of."""
        for c in getattr(self, "children", ()):
            yield from c.counted()


class Places(Node):
    """A node with places in a text. They are told from the tokens that it is made of alone: term and at, in order."""

    def counted(self) -> Iterator[Node]:
        yield self

    def width(self) -> int:
        return 1

    def terms(self) -> set[str]:
        return {t for c in getattr(self, "children", ()) for t in c.terms()}

    def places(self, t: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Term(Places):
    term: str

    def terms(self) -> set[str]:
        return {self.term}

    def places(self, t: Column) -> Column:
        return F.transform(F.filter(t, lambda x: x["term"] == self.term), lambda x: x["at"])


@dataclass(frozen=True)
class Synonym(Places):
    """Any of the children, which are equally wide; a place counts once."""

    children: tuple[Places, ...]

    def width(self) -> int:
        widths = {c.width() for c in self.children}
        if len(widths) != 1:
            raise ValueError("synonyms must be equally wide")
        return widths.pop()

    def places(self, t: Column) -> Column:
        self.width()
        return F.array_sort(F.array_distinct(F.concat(*[c.places(t) for c in self.children])))


def _followed(found: Column, places: Column, offset: int) -> Column:
    """Those found that have one of the places so far behind them, in time that grows with their number."""
    return F.array_intersect(found, F.transform(places, lambda p: p - offset))


@dataclass(frozen=True)
class Phrase(Places):
    """The children one behind the other."""

    children: tuple[Places, ...]

    def width(self) -> int:
        return sum(c.width() for c in self.children)

    def places(self, t: Column) -> Column:
        first, *rest = self.children
        found, offset = first.places(t), first.width()
        for c in rest:
            found, offset = _followed(found, c.places(t), offset), offset + c.width()
        return found


@dataclass(frozen=True)
class Near(Places):
    """Places of any child from which on all children begin within size places."""

    children: tuple[Places, ...]
    size: int = 8

    def places(self, t: Column) -> Column:
        own = F.transform(F.array(*[c.places(t) for c in self.children]), lambda x: x)
        here = lambda p, x: F.exists(x, lambda q: (q >= p) & (q < p + self.size))
        return let(own, lambda all_: F.filter(F.array_sort(F.array_distinct(F.flatten(all_))), lambda p: F.forall(all_, lambda x: here(p, x))))


@dataclass(frozen=True)
class All(Node):
    """A condition: every child holds. A node with places holds where it has any."""

    children: tuple[Node, ...]


@dataclass(frozen=True)
class Any(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Combine(Node):
    """A score: the weighted mean of the children's scores; a node with places is scored by its count, smoothed with its own frequency. Weights sum to more than 0."""

    weights: tuple[float, ...]
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Require(Node):
    """The score of the second child, for documents where the first holds."""

    children: tuple[Node, Node]


def _holds(node: Node, tf: dict[Node, Column]) -> Column:
    if node in tf:
        return tf[node] > 0
    if isinstance(node, Require):
        return _holds(node.children[0], tf) & _holds(node.children[1], tf)
    below = [_holds(c, tf) for c in node.children]
    return reduce(lambda a, b: a & b if isinstance(node, All) else a | b, below)


def _score(node: Node, tf: dict[Node, Column], cf: dict[Node, int], length: Column, coll: int, smoothing: str) -> Column:
    if node in tf:
        model = jelinek_mercer if smoothing in ("jm", "linear") else dirichlet
        # a node that stands nowhere says nothing under linear smoothing
        return model(tf[node], length, F.lit(cf[node]), F.lit(coll)) if cf[node] or model is dirichlet else F.lit(0.0)
    if isinstance(node, Require):
        return _score(node.children[1], tf, cf, length, coll, smoothing)
    if not isinstance(node, Combine):
        raise TypeError(f"{type(node).__name__} is a condition and has no score")
    parts = [w * _score(c, tf, cf, length, coll, smoothing) for w, c in zip(node.weights, node.children, strict=True)]
    return reduce(lambda a, b: a + b, parts) / sum(node.weights)


def counts(docs: DataFrame, queries: dict[str, Node], key: str = "doc_id", text: str = "text", terms: str | None = None) -> tuple[DataFrame, list[Node]]:
    """doc_id, len, tf (a count for each node that the queries are made of) of every document, and these nodes: one scan.

    terms names a column of spaced tokens that is read instead of the text. The tokens are looked through once, for those of any node.
    """
    units = list(dict.fromkeys(u for q in queries.values() for u in q.counted()))
    asked = sorted({t for u in units for t in u.terms()})
    own = lambda t: F.array_compact(F.transform(t, lambda x, i: F.when(x.isin(asked), F.struct(x.alias("term"), i.alias("at")))))
    tf = lambda t: let(own(t), lambda o: F.array(*[F.size(u.places(o)).cast("long") for u in units]))
    made = let(token_array(F.col(text)) if terms is None else parted(F.col(terms)), lambda t: F.struct(F.size(t).cast("long").alias("len"), tf(t).alias("tf")))
    # made by a generator, so that the tokens aren't made again for each member
    return docs.select(F.col(key).alias("doc_id"), F.inline(F.array(made))), units


def run(docs: DataFrame, queries: dict[str, Node], k: int | None = 10, smoothing: str = "dirichlet", within: DataFrame | None = None, key: str = "doc_id", text: str = "text", terms: str | None = None) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each query, of those where it holds; a score holds where any of its nodes does.
    Documents without an id aren't ranked, but count in the frequencies.

    within (doc_id) leaves other documents out of the ranking, but not of the frequencies. terms names a column of spaced tokens that is read instead of the text.
    """
    rows, units = counts(docs, queries, key, text, terms)
    rows = cut(rows)
    sums = rows.agg(F.sum("len").alias("coll"), *[F.sum(F.get("tf", F.lit(i))).alias(f"cf{i}") for i in range(len(units))]).first()
    tf, cf = {u: F.get("tf", F.lit(i)) for i, u in enumerate(units)}, {u: sums[f"cf{i}"] or 0 for i, u in enumerate(units)}
    one = lambda q, node: F.when(_holds(node, tf), F.struct(F.lit(q).alias("qid"), F.round(_score(node, tf, cf, F.col("len"), sums["coll"] or 0, smoothing), 6).alias("score")))
    found = F.array_compact(F.array(*[one(q, node) for q, node in queries.items()]))
    rows = rows if within is None else rows.join(within.select("doc_id").distinct(), "doc_id", "left_semi")
    return ranked(rows.filter(F.col("doc_id").isNotNull() & F.exists("tf", lambda x: x > 0)).select("doc_id", F.inline(found)).select("qid", "doc_id", "score"), k)
