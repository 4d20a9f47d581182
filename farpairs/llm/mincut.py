"""Minimum cut between two terminals, for graphs of a page's size; used inside Spark tasks."""

from __future__ import annotations

from collections import deque


class Cut:
    """An s-t network whose nodes have costs for either label and smoothness edges between them."""

    def __init__(self, nodes: int):
        self.s, self.t = nodes, nodes + 1
        self.near: list[list[int]] = [[] for _ in range(nodes + 2)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.near[a].append(len(self.to))
        self.near[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def costs(self, node: int, if_out: float, if_in: float) -> None:
        """What the cut pays where ``node`` is on the sink's side, or on the source's."""
        both = min(if_out, if_in)
        if if_out > both:
            self.edge(self.s, node, if_out - both)
        elif if_in > both:
            self.edge(node, self.t, if_in - both)

    def _levels(self) -> list[int]:
        level = [-1] * len(self.near)
        level[self.s] = 0
        queue = deque([self.s])
        while queue:
            a = queue.popleft()
            for e in self.near[a]:
                b = self.to[e]
                if self.room[e] > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self) -> list[bool]:
        """Nodes that the source still reaches when the flow is largest: the smallest minimum cut."""
        while True:
            level = self._levels()
            if level[self.t] < 0:
                return [x >= 0 for x in level[:-2]]
            at = [0] * len(self.near)
            path: list[int] = []
            a = self.s
            while True:
                if a == self.t:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                edges = self.near[a]
                while at[a] < len(edges) and not (self.room[edges[at[a]]] > 1e-9 and level[self.to[edges[at[a]]]] == level[a] + 1):
                    at[a] += 1
                if at[a] < len(edges):
                    path.append(edges[at[a]])
                    a = self.to[path[-1]]
                elif path:
                    level[a] = -1
                    a = self.to[path.pop() ^ 1]
                else:
                    break
