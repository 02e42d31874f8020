"""Syntax tree: nodes with a kind and fields; expressions remember their source text for implicit column names."""

from __future__ import annotations

from collections.abc import Iterator


class GraphQueryError(ValueError):
    """A query that cannot run: its message names the phase (SyntaxError, SemanticError, RuntimeError) first."""


def syntax(message: str) -> GraphQueryError:
    return GraphQueryError(f"SyntaxError: {message}")


def semantic(message: str) -> GraphQueryError:
    return GraphQueryError(f"SemanticError: {message}")


class N:
    """N("prop", base=..., key=...): fields are attributes; text is the source it was read from."""

    def __init__(self, kind: str, **fields):
        self.kind, self.text = kind, ""
        self.__dict__.update(fields)

    def members(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("kind", "text")}

    def children(self) -> Iterator[N]:
        for v in self.members().values():
            yield from _nodes(v)

    def walk(self) -> Iterator[N]:
        yield self
        for c in self.children():
            yield from c.walk()

    def identity(self):
        """Equal for equal expressions, however they were spaced."""
        return (self.kind, tuple((k, _key(v)) for k, v in sorted(self.members().items())))

    def replaced(self, f) -> N:
        """A copy in which f(node), where not None, takes the place of a node and all below it."""
        if (new := f(self)) is not None:
            return new
        out = N(self.kind, **{k: _replaced(v, f) for k, v in self.members().items()})
        out.text = self.text
        return out

    def __repr__(self) -> str:
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.members().items())})"


def _nodes(v) -> Iterator[N]:
    if isinstance(v, N):
        yield v
    elif isinstance(v, (list, tuple)):
        for x in v:
            yield from _nodes(x)
    elif isinstance(v, dict):
        for x in v.values():
            yield from _nodes(x)


def _key(v):
    if isinstance(v, N):
        return v.identity()
    if isinstance(v, (list, tuple)):
        return tuple(_key(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _key(x)) for k, x in sorted(v.items()))
    return (type(v).__name__, v)


def _replaced(v, f):
    if isinstance(v, N):
        return v.replaced(f)
    if isinstance(v, list):
        return [_replaced(x, f) for x in v]
    if isinstance(v, tuple):
        return tuple(_replaced(x, f) for x in v)
    if isinstance(v, dict):
        return {k: _replaced(x, f) for k, x in v.items()}
    return v
