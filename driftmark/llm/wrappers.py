"""Union-free regular expressions for the token streams of a host's pages (problem 2).

Pages of one host are aligned one after another; a page that the wrapper accepts leaves it as it is.
Where they differ, a repetition of a neighbouring group on either side becomes a repeated group, and what
is no repetition becomes optional; differing text is a text slot. There is no alternation anywhere.

A wrapper is a tuple of nodes: a label, ("?", nodes) for an optional or ("+", nodes) for a repeated group.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

Node = str | tuple
Wrapper = tuple


def _base(node: Node) -> Node:
    """What a node is compared by: an optional or repeated group of x is like x."""
    while isinstance(node, tuple) and len(node[1]) == 1:
        node = node[1][0]
    return node


def fold_repeats(nodes: Iterable[Node]) -> Wrapper:
    """Immediate repetitions of groups of any number of nodes become repeated groups, shortest first."""
    out = list(nodes)
    period = 1
    while 2 * period <= len(out):
        # same[i]: how many nodes from i on equal those a period later.
        same = [0] * (len(out) + 1)
        for i in range(len(out) - period - 1, -1, -1):
            same[i] = same[i + 1] + 1 if out[i] == out[i + period] else 0
        i, new = 0, []
        while i < len(out):
            n = same[i] // period
            if n:
                new.append(_repeated(out[i:i + period]))
                i += (n + 1) * period
            else:
                new.append(out[i])
                i += 1
        out = new
        period += 1
    return tuple(out)


def _repeated(group: list[Node]) -> Node:
    return group[0] if len(group) == 1 and isinstance(group[0], tuple) and group[0][0] == "+" else ("+", tuple(group))


def _merge_node(a: Node, b: Node) -> Node:
    """The node that accepts what either accepts, both having one base."""
    optional = repeated = False
    for n in (a, b):
        while isinstance(n, tuple) and len(n[1]) == 1:
            optional, repeated = optional or n[0] == "?", repeated or n[0] == "+"
            n = n[1][0]
    node = _base(a)
    node = _repeated([node]) if repeated else node
    return ("?", (node,)) if optional else node


def _is_optional(n: Node) -> bool:
    return isinstance(n, tuple) and n[0] == "?"


def _optional(nodes: list[Node]) -> list[Node]:
    """Each node of a mismatch as an optional one."""
    return [n if _is_optional(n) else ("?", (n,)) for n in nodes]


def _group(n: Node) -> Wrapper:
    """The nodes of a repeated group of several, optional or not; none for other nodes."""
    n = _base(n)
    return n[1] if isinstance(n, tuple) else ()


def _with_group(n: Node, copies: list[Node]) -> Node:
    """The repeated group n that accepts copies of it, too."""
    group = list(_group(n))
    for at in range(0, len(copies), len(group)):
        group = [_merge_node(x, y) for x, y in zip(group, copies[at:at + len(group)])]
    return ("?", (("+", tuple(group)),)) if _is_optional(n) else ("+", tuple(group))


def _copies(a: Wrapper, b: Wrapper) -> list[tuple[int, int, int]]:
    """(i, j, n): b holds the group that a[i] repeats, n nodes of it from j on, copy after copy; all numbers of copies."""
    out = []
    plain = [None if _is_optional(x) else _base(x) for x in b]
    for i, node in enumerate(a):
        group = [_base(x) for x in _group(node)]
        for j in range(len(b) - len(group) + 1 if group else 0):
            n = len(group)
            while plain[j + n - len(group):j + n] == group:
                out.append((i, j, n))
                n += len(group)
    return out


def _fold_into(kept: list[Node], rest: list[Node], left: bool) -> bool:
    """Takes a repetition of the group that ``kept`` ends with (left; else begins with) off the near end of ``rest``, if there is one."""
    near = kept[-1] if left and kept else kept[0] if kept else None
    for k in range(1, len(rest) + 1):
        part = rest[:k] if left else rest[-k:]
        if k > 1 and any(map(_is_optional, part)):
            continue
        keys = [_base(x) for x in part]
        if near is not None and len(_group(near)) == k > 1 and keys == [_base(x) for x in _group(near)]:
            at, new = (slice(-1, None) if left else slice(0, 1)), _with_group(near, part)
        elif k <= len(kept) and keys == [_base(x) for x in (kept[-k:] if left else kept[:k])]:
            at = slice(-k, None) if left else slice(0, k)
            if k == 1:
                x = _repeated([_base(near)])
                new = ("?", (x,)) if _is_optional(near) else x
            else:
                new = ("+", tuple(_merge_node(x, y) for x, y in zip(kept[at], part)))
        else:
            continue
        kept[at] = [new]
        rest[:] = rest[k:] if left else rest[:-k]
        return True
    return False


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """The wrapper of what ``a`` and ``b`` accept: a longest common subsequence stays, in which a repeated group stands for its copies.

    Of the rest, a repetition of the group before or after it is folded into that group; what is left turns optional.
    """
    if a == b:
        return a
    if not a or not b:
        return tuple(_optional(list(a or b)))
    code: dict = {}
    ka, kb = ([code.setdefault(_base(x), len(code)) for x in w] for w in (a, b))
    n, m = len(a), len(b)
    jumps: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for i, j, c in _copies(a, b):
        jumps.setdefault(i, {}).setdefault(j, []).append((1, c))
    for j, i, c in _copies(b, a):
        jumps.setdefault(i, {}).setdefault(j, []).append((c, 1))
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, k, jump = best[i], best[i + 1], ka[i], jumps.get(i)
        weight, after = max(1, len(_group(a[i]))), 0
        for j in range(m - 1, -1, -1):
            x = below[j]
            if x > after:
                after = x
            if k == kb[j] and below[j + 1] + weight > after:
                after = below[j + 1] + weight
            if jump and j in jump:
                after = max(after, *(best[i + p][j + q] + max(p, q) for p, q in jump[j]))
            row[j] = after
    # Matched stretches, each after what only a and only b have before it.
    parts: list[tuple[list[Node], list[Node], list[Node]]] = [([], [], [])]
    i = j = 0
    while i < n or j < m:
        here = best[i][j]
        step = None
        if i < n and j < m:
            if ka[i] == kb[j] and here == best[i + 1][j + 1] + max(1, len(_group(a[i]))):
                step = 1, 1
            else:
                step = next(((p, q) for p, q in jumps.get(i, {}).get(j, ()) if here == best[i + p][j + q] + max(p, q)), None)
        if step:
            p, q = step
            if p == q == 1:
                new = _merge_node(a[i], b[j])
            else:
                new = _with_group(a[i], list(b[j:j + q])) if p == 1 else _with_group(b[j], list(a[i:i + p]))
            parts[-1][2].append(new)
            i, j = i + p, j + q
            continue
        if parts[-1][2]:
            parts.append(([], [], []))
        if i < n and (j == m or best[i + 1][j] >= best[i][j + 1]):
            parts[-1][0].append(a[i])
            i += 1
        else:
            parts[-1][1].append(b[j])
            j += 1
    out: list[Node] = []
    for only_a, only_b, both in parts:
        for rest in (only_a, only_b):
            while _fold_into(out, rest, True):
                pass
            while _fold_into(both, rest, False):
                pass
        out += _optional(only_a) + _optional(only_b) + both
    return tuple(out)


def page(stream: str) -> Wrapper:
    return fold_repeats(stream.split())


def add(wrapper: Wrapper | None, stream: str) -> Wrapper:
    """The wrapper that accepts one page more."""
    if wrapper is None:
        return page(stream)
    return wrapper if accepts(wrapper, stream) else align(wrapper, page(stream))


def infer(wrappers: Iterable[Wrapper]) -> Wrapper:
    out: Wrapper | None = None
    for w in wrappers:
        out = w if out is None else align(out, w)
    return out or ()


def accepts(wrapper: Wrapper, stream: str | list[str]) -> bool:
    """Whether the stream is in the language of the wrapper; all ways at once, without backtracking."""
    labels = stream.split() if isinstance(stream, str) else stream
    places: dict[str, int] = {}
    for i, x in enumerate(labels):
        places[x] = places.get(x, 0) | 1 << i

    def run(nodes: Wrapper, at: int) -> int:
        """The places, as bits, reached from those of ``at``."""
        for n in nodes:
            if not at:
                return at
            if isinstance(n, str):
                at = (at & places.get(n, 0)) << 1
            elif n[0] == "?":
                at |= run(n[1], at)
            else:
                reached, new = 0, at
                while new:
                    new = run(n[1], new) & ~reached
                    reached |= new
                at = reached
        return at

    return bool(run(wrapper, 1) >> len(labels) & 1)


def show(wrapper: Wrapper) -> str:
    return " ".join(n if isinstance(n, str) else f"({show(n[1])}){n[0]}" for n in wrapper)


def dumps(wrapper: Wrapper) -> str:
    return json.dumps(wrapper)


def loads(text: str) -> Wrapper:
    def tup(x):
        return x if isinstance(x, str) else tuple(map(tup, x))

    return tup(json.loads(text))
