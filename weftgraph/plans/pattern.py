"""Query patterns: small labelled directed graphs, built and kept on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

#: Edge labels that are undirected in the text corpus (person-knows-person).
SYMMETRIC_LABELS = frozenset({12})


class EdgeType(NamedTuple):
    src_label: int
    dst_label: int
    edge_label: int


class PatternEdge(NamedTuple):
    src: int
    dst: int
    label: int


@dataclass
class Pattern:
    """Vertices are 0..n-1 with a label each; a repeated edge is ignored, several labels on a pair are not."""

    name: str
    labels: list[int] = field(default_factory=list)
    edges: list[PatternEdge] = field(default_factory=list)
    symmetric: frozenset[int] = SYMMETRIC_LABELS

    @classmethod
    def of(cls, name: str, labels: list[int], edges: list[tuple[int, int, int]], symmetric: frozenset[int] = SYMMETRIC_LABELS) -> Pattern:
        p = cls(name, symmetric=symmetric)
        for x in labels:
            p.add_vertex(x)
        for e in edges:
            p.add_edge(*e)
        return p

    def add_vertex(self, label: int) -> int:
        self.labels.append(label)
        return len(self.labels) - 1

    def add_edge(self, src: int, dst: int, label: int) -> None:
        for v in (src, dst):
            if not 0 <= v < len(self.labels):
                raise ValueError(f"{self.name}: edge names the unknown vertex {v}")
        edge = PatternEdge(src, dst, label)
        same = {edge, PatternEdge(dst, src, label)} if label in self.symmetric else {edge}
        if not same & set(self.edges):
            self.edges.append(edge)

    def edge_type(self, e: PatternEdge) -> EdgeType:
        return EdgeType(self.labels[e.src], self.labels[e.dst], e.label)

    def out_edges(self, v: int) -> list[PatternEdge]:
        return [e for e in self.edges if e.src == v or (e.label in self.symmetric and e.dst == v)]

    def in_edges(self, v: int) -> list[PatternEdge]:
        return [e for e in self.edges if e.dst == v or (e.label in self.symmetric and e.src == v)]

    def degree(self, v: int) -> int:
        return sum((e.src == v) + (e.dst == v) for e in self.edges)

    def edge_labels(self, a: int, b: int) -> list[int]:
        """Labels of the edges from a to b; empty if there is none."""
        return [e.label for e in self.edges if (e.src, e.dst) == (a, b) or (e.label in self.symmetric and (e.dst, e.src) == (a, b))]

    def check(self) -> None:
        """Raises unless the pattern has an edge and is connected."""
        seen, todo = {self.edges[0].src} if self.edges else set(), [self.edges[0].src] if self.edges else []
        while todo:
            v = todo.pop()
            for e in self.edges:
                for a, b in ((e.src, e.dst), (e.dst, e.src)):
                    if a == v and b not in seen:
                        seen.add(b)
                        todo.append(b)
        if not self.edges or len(seen) != len(self.labels):
            raise ValueError(f"{self.name}: a pattern needs an edge and must be connected")


def edge_types(patterns: list[Pattern]) -> list[EdgeType]:
    """Distinct edge types of all patterns, ordered."""
    return sorted({p.edge_type(e) for p in patterns for e in p.edges})


def instances(patterns: list[Pattern]) -> dict[EdgeType, list[tuple[int, int, int]]]:
    """Occurrences (query, source vertex, target vertex) of each edge type; symmetric edges in both orientations."""
    out: dict[EdgeType, list[tuple[int, int, int]]] = {t: [] for t in edge_types(patterns)}
    for q, p in enumerate(patterns):
        for e in p.edges:
            out[p.edge_type(e)].append((q, e.src, e.dst))
            if e.label in p.symmetric:
                out.setdefault(EdgeType(p.labels[e.dst], p.labels[e.src], e.label), []).append((q, e.dst, e.src))
    return out
