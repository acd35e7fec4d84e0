"""Column expressions written before there is a session: calls and operators are recorded, and made when a query runs."""

from __future__ import annotations

import operator
from types import ModuleType
from typing import Any


def make(x: Any) -> Any:
    """The real value of a recorded one."""
    if isinstance(x, Deferred):
        return x._run()
    if isinstance(x, (list, tuple)):
        return type(x)(map(make, x))
    if callable(x) and getattr(x, "__name__", "") == "<lambda>":
        return (lambda a: make(x(a))) if x.__code__.co_argcount == 1 else (lambda a, b: make(x(a, b)))
    return x


class Deferred:
    def __init__(self, run):
        self._run = run

    def __getattr__(self, name: str) -> Deferred:
        return Deferred(lambda: getattr(make(self), name))

    def __call__(self, *a: Any, **b: Any) -> Deferred:
        return Deferred(lambda: make(self)(*map(make, a), **{k: make(v) for k, v in b.items()}))

    def __getitem__(self, k: Any) -> Deferred:
        return Deferred(lambda: make(self)[make(k)])


def _binary(f):
    return lambda a, b: Deferred(lambda: f(make(a), make(b))), lambda a, b: Deferred(lambda: f(make(b), make(a)))


for _name in ("add", "sub", "mul", "truediv", "mod", "pow", "and_", "or_", "lt", "le", "gt", "ge", "eq", "ne"):
    _there, _back = _binary(getattr(operator, _name))
    setattr(Deferred, f"__{_name.rstrip('_')}__", _there)
    if _name not in ("lt", "le", "gt", "ge", "eq", "ne"):
        setattr(Deferred, f"__r{_name.rstrip('_')}__", _back)
for _name in ("neg", "invert"):
    setattr(Deferred, f"__{_name}__", lambda a, f=getattr(operator, _name): Deferred(lambda: f(make(a))))


class Later:
    """A module whose functions are recorded; its constants are given as they are."""

    def __init__(self, module: ModuleType):
        self._module = module

    def __getattr__(self, name: str) -> Any:
        x = getattr(self._module, name)
        return Deferred(lambda: x) if callable(x) else x
