"""Parsing with derivatives: a grammar is a set of hash-consed nodes, reading a token replaces the node by its derivative.

Derivatives are memoised by node and token kind, so that files of a language share them and reading a known token in a known
state is one look-up. The empty node after a token marks that token as wrong; a node that is not nullable at the end of the
input means that the text stops too early.
"""

EMPTY, EPS = 0, 1


class Grammar:
    """Nodes of one grammar. Rules must not be left-recursive."""

    def __init__(self, limit: int = 400_000) -> None:
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.ids: dict[tuple, int] = {n: i for i, n in enumerate(self.nodes)}
        self.rules: dict[str, int] = {}
        self.memo: list[dict[str, int]] = [{}, {}]
        self.null: dict[int, bool] = {EMPTY: False, EPS: True}
        self.base = 0
        self.limit = limit

    def _node(self, n: tuple) -> int:
        i = self.ids.get(n)
        if i is None:
            i = self.ids[n] = len(self.nodes)
            self.nodes.append(n)
            self.memo.append({})
        return i

    def tok(self, *kinds: str) -> int:
        return self.alt(*[self._node(("t", k)) for k in kinds])

    def ref(self, name: str) -> int:
        return self._node(("r", name))

    def rule(self, name: str, node: int) -> int:
        self.rules[name] = node
        return self.ref(name)

    def seq(self, *parts: int | str) -> int:
        out = EPS
        for p in reversed([self.tok(p) if isinstance(p, str) else p for p in parts]):
            out = self._seq(p, out)
        return out

    def _seq(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        n = self.nodes[a]
        return self._seq(n[1], self._seq(n[2], b)) if n[0] == "s" else self._node(("s", a, b))

    def alt(self, *parts: int | str) -> int:
        flat: set[int] = set()
        for p in parts:
            p = self.tok(p) if isinstance(p, str) else p
            n = self.nodes[p]
            flat |= n[1] if n[0] == "|" else {p}
        flat.discard(EMPTY)
        if len(flat) < 2:
            return flat.pop() if flat else EMPTY
        return self._node(("|", frozenset(flat)))

    def star(self, *parts: int | str) -> int:
        a = self.seq(*parts)
        return a if a in (EMPTY, EPS) or self.nodes[a][0] == "*" else self._node(("*", a))

    def plus(self, *parts: int | str) -> int:
        return self.seq(self.seq(*parts), self.star(*parts))

    def opt(self, *parts: int | str) -> int:
        return self.alt(EPS, self.seq(*parts))

    def nullable(self, i: int) -> bool:
        got = self.null.get(i)
        if got is None:
            n = self.nodes[i]
            self.null[i] = False  # while a rule looks at itself
            kind = n[0]
            got = kind == "*" or kind == "s" and self.nullable(n[1]) and self.nullable(n[2]) or kind == "|" and any(self.nullable(x) for x in n[1]) or kind == "r" and self.nullable(self.rules[n[1]])
            self.null[i] = got
        return got

    def step(self, i: int, k: str) -> int:
        """The derivative of node ``i`` by a token of kind ``k``."""
        memo = self.memo[i]
        got = memo.get(k)
        if got is not None:
            return got
        n = self.nodes[i]
        kind = n[0]
        if kind == "t":
            got = EPS if n[1] == k else EMPTY
        elif kind == "s":
            got = self._seq(self.step(n[1], k), n[2])
            if self.nullable(n[1]):
                got = self.alt(got, self.step(n[2], k))
        elif kind == "|":
            got = self.alt(*[self.step(x, k) for x in n[1]])
        elif kind == "*":
            got = self._seq(self.step(n[1], k), i)
        elif kind == "r":
            got = self.step(self.rules[n[1]], k)
        else:
            got = EMPTY
        memo[k] = got
        return got

    def close(self) -> "Grammar":
        """Ends the definition: what is added from here on is derived and may be forgotten."""
        self.base = len(self.nodes)
        return self

    def parse(self, start: int, kinds: list[str]) -> int:
        """-1 if the kinds are a sentence of ``start``, else the index of the first wrong one, or their number if more is missing."""
        if len(self.nodes) > self.limit:  # bounded memory: forget derived nodes between texts
            for n in self.nodes[self.base :]:
                del self.ids[n]
            del self.nodes[self.base :], self.memo[self.base :]
            self.memo[:] = [{} for _ in self.nodes]
            self.null = {i: v for i, v in self.null.items() if i < self.base}
        memo, state = self.memo, start
        for at, k in enumerate(kinds):
            new = memo[state].get(k)
            state = self.step(state, k) if new is None else new
            if state == EMPTY:
                return at
        return -1 if self.nullable(state) else len(kinds)
