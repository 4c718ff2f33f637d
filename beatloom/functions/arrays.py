"""Linear-time work on sorted arrays, as SQL text.

Nested lambdas are long; as text they reach the planner in one call. Every function takes and gives
expressions as text; ``expr`` turns one into a column.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

BLOCK = 256
_NUMBERS = count()


def var() -> str:
    """A lambda variable of its own."""
    return f"v{next(_NUMBERS)}_"


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    v = var()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def each(xs: str, body: Callable[[str, str], str]) -> str:
    """``body`` of every element and its position."""
    x, i = var(), var()
    return f"transform({xs}, ({x}, {i}) -> {body(x, i)})"


def only(xs: str, test: Callable[[str], str]) -> str:
    """The elements that pass a test."""
    x = var()
    return f"filter({xs}, {x} -> {test(x)})"


def numbers(n: str) -> str:
    """0 to n - 1; empty when n is 0."""
    return only(f"sequence(0, cast({n} as int))", lambda i: f"{i} < {n}")


def drop(xs: str, n: str) -> str:
    """The array without its first n elements."""
    return f"slice({xs}, cast({n} as int) + 1, cast(greatest(size({xs}) - {n}, 0) as int))"


def scan(xs: str, start: str, step: Callable[[str, str], tuple[str, str]], state: str, out: str) -> str:
    """Struct (state, out) of a running state: ``step(state, x)`` gives the next state and what x turns into.

    ``state`` and ``out`` are SQL types. Outputs are gathered in blocks, so that the copies made on the way
    stay small beside the work itself.
    """
    a, x, acc, part, end = (var() for _ in range(5))
    after, made = step(f"{a}.state", x)
    one = f"named_struct('state', cast({after} as {state}), 'out', concat({a}.out, array(cast({made} as {out}))))"
    block = f"aggregate({part}, named_struct('state', {acc}.state, 'out', cast(array() as array<{out}>)), ({a}, {x}) -> {one})"
    joined = let(block, lambda d: f"named_struct('state', {d}.state, 'out', concat({acc}.out, array({d}.out)))")
    parts = let(xs, lambda s: each(numbers(f"ceil(size({s}) / {BLOCK})"), lambda i, _: f"slice({s}, {i} * {BLOCK} + 1, {BLOCK})"))
    first = f"named_struct('state', cast({start} as {state}), 'out', cast(array() as array<array<{out}>>))"
    return f"aggregate({parts}, {first}, ({acc}, {part}) -> {joined}, {end} -> named_struct('state', {end}.state, 'out', flatten({end}.out)))"


def ranks(values: str, probes: str) -> str:
    """How many of the sorted values lie before each probe, by one sort of both.

    ``probes`` are sorted structs (v, o): values below v count where o is -1, values up to v where it is 1.
    """
    own = each(values, lambda v, _: f"named_struct('v', {v}, 'o', 0, 'i', -1)")
    asked = each(probes, lambda p, i: f"named_struct('v', {p}.v, 'o', {p}.o, 'i', {i})")
    placed = each(f"sort_array(concat({own}, {asked}))", lambda x, at: f"named_struct('i', {x}.i, 'n', {at} - {x}.i)")
    return each(only(placed, lambda x: f"{x}.i >= 0"), lambda x, _: f"{x}.n")


def next_beyond(t: str, tolerance: float) -> str:
    """For each sorted time the position of the first one more than the tolerance after it, else the size.

    A sum that was rounded up must not count itself: its difference then exceeds the tolerance.
    """
    reach = lambda x: f"({x} + {tolerance!r}D)"
    return ranks(t, each(t, lambda x, _: f"named_struct('v', {reach(x)}, 'o', if({reach(x)} - {x} > {tolerance!r}D, -1, 1))"))


def is_spaced(t: str, tolerance: float) -> str:
    """No two neighbours lie within the tolerance."""
    a, b = var(), var()
    # the longer array pads with null, which the minimum skips
    return f"coalesce(array_min(zip_with(slice({t}, 2, greatest(size({t}) - 1, 0)), {t}, ({a}, {b}) -> {a} - {b})) > {tolerance!r}D, true)"


def _rounds(t: str) -> str:
    return f"sequence(1, cast(ceil(log2(size({t}) + 1.0D)) as int))"


def keep_spaced(t: str, tolerance: float, skip: str = "0") -> str:
    """Sorted times, each more than the tolerance after the last one kept; the first ``skip`` are left out.

    Spaced arrays, the usual case, only pass a check. In others each time points to the next one beyond the
    tolerance, and pointer doubling collects what can be reached from the first.
    """

    def reached(r: str) -> str:
        acc, round_, end = var(), var(), var()
        start = f"named_struct('jump', concat({next_beyond(r, tolerance)}, array(size({r}))), 'kept', array(0))"
        jump = each(f"{acc}.jump", lambda j, _: f"get({acc}.jump, {j})")
        kept = f"array_union({acc}.kept, {each(f'{acc}.kept', lambda i, _: f'get({acc}.jump, {i})')})"
        done = each(f"sort_array({only(f'{end}.kept', lambda i: f'{i} < size({r})')})", lambda i, _: f"get({r}, {i})")
        return f"aggregate({_rounds(r)}, {start}, ({acc}, {round_}) -> named_struct('jump', {jump}, 'kept', {kept}), {end} -> {done})"

    rest = let(t, lambda a: drop(a, skip)) if skip != "0" else t
    return let(rest, lambda r: f"if({is_spaced(r, tolerance)}, {r}, {reached(r)})")


def exits(t: str, tolerance: float, most: str) -> str:
    """Structs (last, n) for 0 to ``most`` times left out in front: the last time kept, and how many.

    Pointer doubling finds them for every start at once.
    """
    kind = "array<struct<last:double,n:bigint>>"

    def plain(a: str) -> str:
        ways = each(numbers(f"{most} + 1"), lambda k, _: f"named_struct('last', if({k} < size({a}), get({a}, size({a}) - 1), null), 'n', size({a}) - {k})")
        return f"cast({ways} as {kind})"

    def doubled(a: str) -> str:
        n, acc, round_, end = f"size({a})", var(), var(), var()
        start = f"named_struct('jump', concat({next_beyond(a, tolerance)}, array({n})), 'n', {each(numbers(f'{n} + 1'), lambda i, _: f'if({i} < {n}, 1L, 0L)')}, 'last', {numbers(f'{n} + 1')})"
        to = lambda i: f"get({acc}.jump, {i})"
        step = (
            f"named_struct('jump', {each(f'{acc}.jump', lambda j, _: to(j))}, 'n', {each(f'{acc}.n', lambda c, i: f'{c} + get({acc}.n, {to(i)})')}, "
            f"'last', {each(f'{acc}.last', lambda l, i: f'if({to(i)} < {n}, get({acc}.last, {to(i)}), {l})')})"
        )
        ways = each(numbers(f"{most} + 1"), lambda k, _: f"named_struct('last', if({k} < {n}, get({a}, get({end}.last, {k})), null), 'n', get({end}.n, {k}))")
        return f"aggregate({_rounds(a)}, {start}, ({acc}, {round_}) -> {step}, {end} -> cast({ways} as {kind}))"

    return let(t, lambda a: f"if({is_spaced(a, tolerance)}, {plain(a)}, {doubled(a)})")
