"""Vectorised structural index over many JSON texts at once.

One pass of NumPy operations over the concatenated bytes finds the quotes that
are not escaped, the bytes outside strings, the brackets, colons and commas
there, and the depth of each by prefix sums.  Ordering those marks by text,
depth and place puts the marks of one container side by side, from which every
member's key and value span falls out without a parser loop.  The same spans
tell whether a text is well formed: separators, keys and escapes by their
neighbours, numbers by one automaton that steps through all of them together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

OBJECT, ARRAY, STRING, SCALAR = 1, 2, 3, 4
_MARKS = np.zeros(256, np.int8)
for _c, _v in zip(b"{[}]:,", (1, 2, 3, 4, 5, 6)):
    _MARKS[_c] = _v
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
#: Scalars that are words.
_WORDS = (b"true", b"false", b"null", b"NaN", b"Infinity", b"-Infinity")
#: The automaton of numbers: states by classes (other, 0, 1-9, minus, plus, dot, e); 9 is failure.
_CLASS = np.zeros(256, np.int8)
_CLASS[list(b"123456789")] = 2
for _c, _v in zip(b"0-+.eE", (1, 3, 4, 5, 6, 6)):
    _CLASS[_c] = _v
_STEP = np.full((10, 7), 9, np.int8)
for _state, _to in {0: {1: 2, 2: 3, 3: 1}, 1: {1: 2, 2: 3}, 2: {5: 4, 6: 6}, 3: {1: 3, 2: 3, 5: 4, 6: 6}, 4: {1: 5, 2: 5}, 5: {1: 5, 2: 5, 6: 6}, 6: {1: 8, 2: 8, 3: 7, 4: 7}, 7: {1: 8, 2: 8}, 8: {1: 8, 2: 8}}.items():
    for _k, _next in _to.items():
        _STEP[_state, _k] = _next
_DONE = np.isin(np.arange(10), (2, 3, 5, 8))


@dataclass
class Nodes:
    """All values of the texts, parents before children.

    ``parent`` is -1 for the root of a text; ``key0``/``key1`` bound the key
    without its quotes (-1 for elements and roots); ``index`` is the place in
    an array (-1 otherwise); ``start``/``end`` bound the value itself.
    """

    data: np.ndarray
    text: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    key0: np.ndarray
    key1: np.ndarray
    index: np.ndarray
    kind: np.ndarray
    start: np.ndarray
    end: np.ndarray
    valid: np.ndarray  # of each text, whether it is one well-formed object or array

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def key_is(self, name: str) -> np.ndarray:
        """Which nodes stand under the key ``name``; the last of equal keys of one object counts."""
        want = np.frombuffer(name.encode(), np.uint8)
        hit = np.zeros(len(self.text), bool)
        at = np.flatnonzero((self.key0 >= 0) & (self.key1 - self.key0 == len(want)))
        if len(at):
            hit[at] = (self.data[self.key0[at][:, None] + np.arange(len(want))] == want).all(1)
        return self._last(hit)

    def _last(self, hit: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(hit)
        order = np.lexsort((self.start[at], self.parent[at]))
        at = at[order]
        keep = np.ones(len(at), bool)
        keep[:-1] = self.parent[at][1:] != self.parent[at][:-1]
        out = np.zeros(len(hit), bool)
        out[at[keep]] = True
        return out


def _empty(data: np.ndarray, n: int) -> Nodes:
    z = np.zeros(0, np.int64)
    return Nodes(data, z, z, z, z, z, z, z, z, z, np.zeros(n, bool))


def _scalars_ok(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the spans are numbers or one of the words."""
    size = end - start
    ok = np.zeros(len(start), bool)
    for word in _WORDS:
        at = np.flatnonzero(size == len(word))
        if len(at):
            ok[at] |= (data[start[at][:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(1)
    state = np.zeros(len(start), np.int8)
    going, place = np.flatnonzero(~ok), 0
    while len(going):
        state[going] = _STEP[state[going], _CLASS[data[start[going] + place]]]
        place += 1
        going = going[(state[going] != 9) & (size[going] > place)]
    return ok | _DONE[state]


def _quoted(quotes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which spans from first to last (inclusive) are one string."""
    at = np.searchsorted(quotes, first)
    inside = at + 1 < len(quotes)
    at = np.where(inside, at, 0)
    return inside & (quotes[at] == first) & (quotes[np.minimum(at + 1, len(quotes) - 1)] == last) if len(quotes) else np.zeros(len(first), bool)


def _bad_strings(data: np.ndarray, offsets: np.ndarray, quotes: np.ndarray, first_quote: np.ndarray) -> np.ndarray:
    """The texts with a control character in a string, a wrong escape or bytes that are no UTF-8."""
    n = len(offsets) - 1
    bad = np.zeros(n, bool)
    control = np.flatnonzero(data < 32)
    of = np.searchsorted(offsets, control, "right") - 1
    bad[of[((np.searchsorted(quotes, control) - first_quote[of]) & 1) == 1]] = True
    slash = np.flatnonzero(data == 92)
    if len(slash):
        of = np.searchsorted(offsets, slash, "right") - 1
        fresh = np.ones(len(slash), bool)
        fresh[1:] = (np.diff(slash) != 1) | (np.diff(of) != 0)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(slash)), 0))
        lead = (np.arange(len(slash)) - run) % 2 == 0  # the others are escaped themselves
        at, of = slash[lead], of[lead]
        end = offsets[of + 1]
        after = data[np.minimum(at + 1, len(data) - 1)]
        wrong = (at + 1 >= end) | ~_ESCAPED[after]
        u = np.flatnonzero(~wrong & (after == 117))
        if len(u):
            digits = at[u][:, None] + np.arange(2, 6)
            wrong[u] = (digits[:, -1] >= end[u]) | ~_HEX[data[np.minimum(digits, len(data) - 1)]].all(1)
        bad[of[wrong]] = True
    if (data >= 128).any():
        try:
            data.tobytes().decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            for i in range(n):
                try:
                    data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                except UnicodeDecodeError:
                    bad[i] = True
    return bad


def index(data: np.ndarray, offsets: np.ndarray) -> Nodes:
    """The nodes of the texts ``data[offsets[i]:offsets[i+1]]`` whose outermost value is an object or array.

    Texts whose quotes or brackets don't pair are left out; of the others
    ``valid`` tells which are well formed in every part.
    """
    offsets = np.asarray(offsets, np.int64)
    n = len(offsets) - 1
    if n == 0 or len(data) == 0:
        return _empty(data, n)
    # quote bitmap without the escaped ones
    quotes = np.flatnonzero(data == 34)
    q_text = np.searchsorted(offsets, quotes, "right") - 1
    maybe = np.flatnonzero((quotes > offsets[q_text]) & (data[np.maximum(quotes - 1, 0)] == 92))
    if len(maybe):
        slash = data == 92
        solid = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        run = quotes[maybe] - 1 - np.maximum(solid[quotes[maybe] - 1], offsets[q_text[maybe]] - 1)
        drop = np.zeros(len(quotes), bool)
        drop[maybe[run % 2 == 1]] = True
        quotes, q_text = quotes[~drop], q_text[~drop]
    first_quote = np.searchsorted(quotes, offsets)
    odd_quotes = (np.diff(first_quote) & 1).astype(bool)
    # bracket and delimiter bitmap outside strings
    marks = np.flatnonzero(_MARKS[data])
    m_text = np.searchsorted(offsets, marks, "right") - 1
    outside = ((np.searchsorted(quotes, marks) - first_quote[m_text]) & 1) == 0
    marks, m_text = marks[outside], m_text[outside]
    kind = _MARKS[data[marks]]
    opens, closes = kind <= 2, (kind == 3) | (kind == 4)
    # depth by prefix sums, from 0 at the start of each text
    step = opens.astype(np.int64) - closes
    total = np.cumsum(step)
    first_mark = np.searchsorted(marks, offsets)
    base = np.concatenate(([0], total))[first_mark]
    inner = total - base[m_text] + closes  # the depth inside the container that the mark belongs to
    bad = odd_quotes.copy()
    bad |= base[1:] != base[:-1]
    if len(marks):
        np.logical_or.at(bad, m_text[inner <= 0], True)
    # white space is looked up by rank among the other bytes
    solid_at = np.flatnonzero(~_SPACE[data])
    lo = np.searchsorted(solid_at, offsets[:-1])
    hi = np.searchsorted(solid_at, offsets[1:])
    has = hi > lo
    head = np.where(has, solid_at[np.minimum(lo, max(len(solid_at) - 1, 0))] if len(solid_at) else 0, 0)
    tail = np.where(has, solid_at[np.maximum(hi - 1, 0)] if len(solid_at) else 0, 0)
    good = has & ~bad & ((data[head] == 123) | (data[head] == 91)) & ((data[tail] == 125) | (data[tail] == 93))
    keep = good[m_text] if len(marks) else np.zeros(0, bool)
    marks, m_text, kind, inner = marks[keep], m_text[keep], kind[keep], inner[keep]
    if not len(marks):
        return _empty(data, n)
    order = np.lexsort((marks, inner, m_text))
    marks, m_text, kind, inner = marks[order], m_text[order], kind[order], inner[order]
    opens, closes = kind <= 2, (kind == 3) | (kind == 4)
    container = np.cumsum(opens) - 1
    open_at = np.flatnonzero(opens)
    close_at = np.flatnonzero(closes)
    if len(open_at) != len(close_at):  # brackets of one kind closed by the other keep the counts equal
        return _empty(data, n)
    # members: from each opener or comma to the next comma or closer
    starter = np.flatnonzero(opens | (kind == 6))
    follow = starter + 1
    colon = kind[np.minimum(follow, len(kind) - 1)] == 5
    ender = np.minimum(follow + colon, len(kind) - 1)
    v0 = np.where(colon, marks[np.minimum(follow, len(kind) - 1)], marks[starter]) + 1
    v1 = marks[ender]
    a = np.searchsorted(solid_at, v0)
    b = np.searchsorted(solid_at, v1)
    full = b > a
    wrong = _bad_strings(data, offsets, quotes, first_quote)
    seg_object = kind[open_at[container[starter]]] == 1
    nothing = opens[starter] & closes[np.minimum(follow, len(kind) - 1)] & ~full
    wrong[m_text[starter[((seg_object != colon) | ~full | (kind[ender] == 5) | opens[ender]) & ~nothing]]] = True
    wrong[m_text[open_at[kind[close_at] != kind[open_at] + 2]]] = True
    starter, colon, follow, a, b = starter[full], colon[full], follow[full], a[full], b[full]
    start, end = solid_at[a], solid_at[b - 1] + 1
    k0 = np.full(len(starter), -1, np.int64)
    k1 = k0.copy()
    if colon.any():
        c = np.flatnonzero(colon)
        ka = np.searchsorted(solid_at, marks[starter[c]] + 1)
        kb = np.searchsorted(solid_at, marks[follow[c]])
        ok = kb > ka
        k0[c[ok]] = solid_at[ka[ok]] + 1
        k1[c[ok]] = solid_at[kb[ok] - 1]
        wrong[m_text[starter[c[~ok]]]] = True
        c = c[ok]
        wrong[m_text[starter[c[~_quoted(quotes, k0[c] - 1, k1[c])]]]] = True
    in_object = kind[open_at[container[starter]]] == 1
    place = np.where(in_object, -1, starter - open_at[container[starter]])
    # roots come first, then the members
    root_text = np.flatnonzero(good)
    all_start = np.concatenate((head[root_text], start))
    node_of_open = np.full(len(data) + 1, -1, np.int64)
    node_of_open[all_start] = np.arange(len(all_start))
    owner = node_of_open[marks[open_at]]
    all_end = np.concatenate((tail[root_text] + 1, end))
    wrong[m_text[open_at[(owner < 0) | (all_end[owner] != marks[close_at] + 1)]]] = True
    parent = np.concatenate((np.full(len(root_text), -1), owner[container[starter]]))
    depth = np.concatenate((np.zeros(len(root_text), np.int64), inner[starter]))
    byte = data[all_start]
    what = np.full(len(all_start), SCALAR, np.int64)
    what[byte == 123], what[byte == 91], what[byte == 34] = OBJECT, ARRAY, STRING
    text = np.concatenate((root_text, m_text[starter]))
    at = np.flatnonzero(what == STRING)
    wrong[text[at[~_quoted(quotes, all_start[at], all_end[at] - 1)]]] = True
    at = np.flatnonzero(what == SCALAR)
    wrong[text[at[~_scalars_ok(data, all_start[at], all_end[at])]]] = True
    return Nodes(
        data,
        text,
        parent,
        depth,
        np.concatenate((np.full(len(root_text), -1), k0)),
        np.concatenate((np.full(len(root_text), -1), k1)),
        np.concatenate((np.full(len(root_text), -1), place)),
        what,
        all_start,
        all_end,
        good & ~wrong,
    )
