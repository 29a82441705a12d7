"""Rewrites that Catalyst can't do: it doesn't push past model stages.

``push_filters`` moves each filter below joins on whose side all its fields are,
and below operators that don't make its fields. ``orders`` gives the legal orders
of a run of filters and one-to-one maps, for the search to cost. ``push_limits`` spares
the calls for rows that a limit drops.
"""

from __future__ import annotations

from itertools import permutations

from .logical import Node

_MOVES = ("filter", "sem_filter", "map", "sem_map")
FILTERS = ("filter", "sem_filter")


def push_filters(node: Node) -> Node:
    """Filters with stated fields go to the side of a join that has them, and below what doesn't make them."""
    children = tuple(push_filters(c) for c in node.children)
    node = node.over(*children) if children != node.children else node
    if node.kind not in FILTERS or not node.depends_on:
        return node
    below = node.children[0]
    need = set(node.depends_on)
    if below.kind in ("join", "sem_join"):
        left, right = below.children
        how = below["how"]
        if need <= set(left.schema.names) and how in ("inner", "left"):
            return below.over(push_filters(node.over(left)), right)
        if need <= set(right.schema.names) - (set(left.schema.names) - set(below.get("on", ()))) and how in ("inner", "right"):
            return below.over(left, push_filters(node.over(right)))
    if below.kind in ("map", "sem_map", "flat_map", "sem_flat_map", "topk") and not need & set(below.generated):
        return below.over(push_filters(node.over(below.children[0])))
    if below.kind == "distinct" and need <= set(below.get("cols", ())):
        return below.over(push_filters(node.over(below.children[0])))
    return node


def push_limits(node: Node) -> Node:
    """A limit goes below verbs that give one row for one; below those that give one or more it stands as well."""
    children = tuple(push_limits(c) for c in node.children)
    node = node.over(*children) if children != node.children else node
    if node.kind != "limit":
        return node
    below = node.children[0]
    if below.kind in ("map", "sem_map", "topk", "project"):
        return below.over(push_limits(node.over(below.children[0])))
    if below.kind in ("flat_map", "sem_flat_map") and below.children[0].kind != "limit":
        return node.over(below.over(push_limits(node.over(below.children[0]))))
    return node


def movable_run(node: Node) -> tuple[list[Node], Node]:
    """The run of filters and one-to-one maps at the top of a plan, bottom first, and what is below."""
    run = []
    while node.kind in _MOVES:
        run.append(node)
        node = node.children[0]
    return run[::-1], node


def legal(op: Node, done: frozenset[int], run: list[Node], base: Node) -> bool:
    """Whether the fields of ``op`` are there once the ``done`` operators of the run have run."""
    have = set(base.schema.names).union(*(run[i].generated for i in done)) if done else set(base.schema.names)
    return op.reads() <= have


def orders(run: list[Node], base: Node) -> list[list[int]]:
    """All legal orders of a short run; for tests and small plans."""
    out = []
    for p in permutations(range(len(run))):
        if all(legal(run[i], frozenset(p[:k]), run, base) for k, i in enumerate(p)):
            out.append(list(p))
    return out
