"""Definitions in source texts of languages with braces, found without a parser.

Comments, strings and templates are blanked first, so that what is left of
braces, parentheses and words is structure.  Which words open a definition is
data (``RULES``); where it ends follows from the matching brace.  A definition
inside another one belongs to it, but a class with members gives way to them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_REGEX = r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*|(?<=return)[ \t]+/(?![*/])(?:\\.|[^/\\\n])+/[a-z]*"
_SCAN = {
    "script": re.compile(rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|{_REGEX}|[`{{}}]", re.S),
    "go": re.compile(rf"{_LINE}|{_BLOCK}|{_DOUBLE}|{_SINGLE}|`[^`]*`?", re.S),
    "java": re.compile(rf'{_LINE}|{_BLOCK}|"""(?:\\.|.)*?"""|{_DOUBLE}|{_SINGLE}', re.S),
}
_TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)

#: The definitions of each language that are chunks, and those that give way to their members.
RULES = {
    "typescript": ("function_declaration", "class_declaration", "interface_declaration", "method_definition", "lexical_declaration"),
    "tsx": ("function_declaration", "class_declaration", "interface_declaration", "method_definition", "lexical_declaration"),
    "javascript": ("function_declaration", "class_declaration", "method_definition", "lexical_declaration"),
    "jsx": ("function_declaration", "class_declaration", "method_definition", "lexical_declaration"),
    "python": ("function_definition", "class_definition"),
    "go": ("function_declaration", "method_declaration", "type_declaration"),
    "java": ("class_declaration", "interface_declaration", "enum_declaration", "method_declaration", "constructor_declaration"),
}
CONTAINERS = ("class_declaration", "class_definition")


@dataclass(frozen=True)
class Definition:
    start: int
    end: int  # exclusive, as offsets
    node: str
    name: str | None


def blank(text: str, family: str) -> tuple[str, list[tuple[int, int]]]:
    """The text with comments, strings and templates as spaces (line feeds stay), and the spans of its comments."""
    out, comments, at = [], [], 0
    depths: list[int] = []  # open braces within each ${ of a template

    def hide(a: int, b: int) -> None:
        out.append("".join("\n" if c == "\n" else " " for c in text[a:b]))

    def template(i: int) -> int:
        """Hide a template from i on, up to its end or the next ${."""
        j = _TEMPLATE.match(text, i).end()
        if text.startswith("${", j):
            hide(i, j + 2)
            depths.append(0)
            return j + 2
        j = min(j + 1, len(text))
        hide(i, j)
        return j

    scan = _SCAN[family]
    while at < len(text):
        found = scan.search(text, at)
        if found is None:
            break
        a, b, what = found.start(), found.end(), found[0]
        out.append(text[at:a])
        at = b
        if what == "`" and family == "script":
            out.append(" ")
            at = template(b)
        elif what == "{":
            if depths:
                depths[-1] += 1
            out.append(what)
        elif what == "}":
            if depths and depths[-1] == 0:
                depths.pop()
                out.append(" ")
                at = template(b)
            else:
                if depths:
                    depths[-1] -= 1
                out.append(what)
        else:
            if what.startswith(("//", "/*")):
                comments.append((a, b))
            hide(a, b)
    out.append(text[at:])
    return "".join(out), comments


def matches(bare: str) -> dict[int, int]:
    """The place of the closing one of each bracket; what never closes reaches to the end."""
    pairs, stack = {}, []
    ends = {"}": "{", ")": "(", "]": "["}
    for m in re.finditer(r"[{}()\[\]]", bare):
        c = m[0]
        if c in "{([":
            stack.append((c, m.start()))
        elif stack:
            for k in range(len(stack) - 1, max(len(stack) - 4, -1), -1):  # a few that never close are passed over
                if stack[k][0] == ends[c]:
                    pairs[stack[k][1]] = m.start()
                    del stack[k:]
                    break
    for _, at in stack:
        pairs[at] = len(bare) - 1
    return pairs


_IDENT = r"[A-Za-z_$][\w$]*"
_NO_DECLARATION = re.compile(r"(?:[=(,:?&|+\[!<>*/%^~-]|\b(?:return|typeof|new|await|yield|void|in|of|case|extends|throw))\s*\Z")
_KEYWORDS = frozenset("if for while switch catch function return with do else try typeof new await yield import super throw assert synchronized".split())
_FUNCTION = re.compile(rf"(?<![\w$.])function\s+({_IDENT})\s*(?=[(<])")
_TYPE = re.compile(rf"(?<![\w$.@])(abstract\s+class|class|interface|enum)\s+({_IDENT})")
_METHOD = re.compile(rf"(?<![\w$.#])((?:(?:public|private|protected|static|async|readonly|override|get|set|accessor)\s+)*\*?\s*(#?{_IDENT}|\[[^\]\n]*\])\s*\??(?:<[^<>(){{}}]*>)?\s*)\(")
_CONST = re.compile(rf"(?<![\w$.])(?:const|let)\s+({_IDENT})\s*(?::[^=;]*?(?:=>[^=;]*?)?)?=(?![=>])\s*")
_ARROW_END = re.compile(r"\s*[;\n]|\s*\Z")


def _skip_space(bare: str, at: int) -> int:
    while at < len(bare) and bare[at].isspace():
        at += 1
    return at


def _back(bare: str, at: int) -> int:
    """The place behind the last character before ``at`` that isn't white space."""
    while at > 0 and bare[at - 1].isspace():
        at -= 1
    return at


def _before(bare: str, at: int) -> str:
    """The last character before ``at`` that isn't white space, '' if there is none."""
    at = _back(bare, at)
    return bare[at - 1] if at else ""


def _innermost(bare: str, pairs: dict[int, int]) -> tuple[list[int], list[int]]:
    """Places in order and, from each on, the innermost open brace (-1 outside of all)."""
    ends = {b for a, b in pairs.items() if bare[a] == "{"}
    stack, places, blocks = [-1], [0], [-1]
    for m in re.finditer(r"[{}]", bare):
        at = m.start()
        if at in pairs:
            stack.append(at)
        elif at in ends and len(stack) > 1:
            stack.pop()
        else:
            continue
        places.append(at + 1)
        blocks.append(stack[-1])
    return places, blocks


def _body(bare: str, pairs: dict[int, int], paren: int) -> int | None:
    """The brace that opens the body behind a parameter list; None if there is none."""
    close = pairs.get(paren)
    if close is None:
        return None
    at = _skip_space(bare, close + 1)
    if bare[at : at + 1] == ":":  # a type follows, which may hold braces of its own
        at += 1
        while at < len(bare):
            c = bare[at]
            if c == "{":
                after = _skip_space(bare, pairs.get(at, at) + 1)
                if _before(bare, at) in (":", "|", "&", "<", ",") or bare[after : after + 1] == "{":
                    at = pairs.get(at, len(bare)) + 1
                    continue
                return at
            if c in "([":
                at = pairs.get(at, len(bare)) + 1
                continue
            if c in ";}" or c == "=" and bare[at + 1 : at + 2] != ">":
                return None
            at += 1
        return None
    return at if bare[at : at + 1] == "{" else None


def _statement_end(bare: str, pairs: dict[int, int], at: int) -> int:
    """Behind the expression that begins at ``at``: its semicolon, or the line feed where it can end."""
    while at < len(bare):
        c = bare[at]
        if c in "{([":
            at = pairs.get(at, len(bare) - 1) + 1
            continue
        if c == ";":
            return at + 1
        if c in "})]":
            return at
        if c == "\n":
            after = _skip_space(bare, at)
            prior = _before(bare, at)
            if (not prior or prior not in "=+-*/&|?:,.<>(") and (after == len(bare) or bare[after] not in ".?:&|+-*/,)=<>"):
                return at
            at = after
            continue
        at += 1
    return len(bare)


def _function_value(bare: str, pairs: dict[int, int], at: int) -> int | None:
    """The end of the function that begins at ``at``; None if it is something else."""
    at0 = at
    if re.compile(r"async\b").match(bare, at):
        at = _skip_space(bare, at + 5)
    m = re.compile(rf"function\b\s*\*?\s*(?:{_IDENT})?\s*(?:<[^<>(){{}}]*>)?\s*\(").match(bare, at)
    if m:
        body = _body(bare, pairs, m.end() - 1)
        return None if body is None else pairs.get(body, len(bare) - 1) + 1
    m = re.compile(r"<[^(){}]*?>\s*(?=\()").match(bare, at)
    if m:
        at = m.end()
    if bare[at : at + 1] == "(" and at in pairs:
        rest = pairs[at] + 1
        m = re.compile(r"\s*(?::(?:[^=;]|=(?!>))*?)?=>").match(bare, rest)
    else:
        m = re.compile(rf"{_IDENT}\s*=>").match(bare, at)
    if not m or at0 == m.end():
        return None
    at = _skip_space(bare, m.end())
    if bare[at : at + 1] == "{":
        return pairs.get(at, len(bare) - 1) + 1
    return _statement_end(bare, pairs, at)


def _script(bare: str, pairs: dict[int, int], typed: bool):
    declared = lambda at: not _NO_DECLARATION.search(bare[max(0, at - 200) : at])
    for m in _FUNCTION.finditer(bare):
        start = m.start()
        before = re.search(r"\basync\s*\Z", bare[max(0, start - 20) : start])
        start -= len(before[0]) if before else 0
        paren = bare.find("(", m.end())
        body = _body(bare, pairs, paren) if paren >= 0 and declared(start) else None
        if body is not None:
            yield Definition(start, pairs.get(body, len(bare) - 1) + 1, "function_declaration", m[1])
    for m in _TYPE.finditer(bare):
        kind = m[1].split()[-1]
        body = bare.find("{", m.end())
        if m[1] in ("class", "interface") and (kind == "class" or typed) and body >= 0 and declared(m.start()) and not re.search(r"[;()=]", bare[m.end() : body].replace("=>", "")) and not (kind == "class" and re.search(r"\babstract\s*\Z", bare[max(0, m.start() - 20) : m.start()])):
            yield Definition(m.start(), pairs.get(body, len(bare) - 1) + 1, f"{kind}_declaration", m[2])
    for m in _METHOD.finditer(bare):
        start = m.start() + len(m[1]) - len(m[1].lstrip())
        ahead = bare[max(0, start - 200) : start]
        if m[2] in _KEYWORDS or re.search(r"\b(?:new|function|return)\s*\*?\s*\Z", ahead):
            continue
        prior = ahead.rstrip()[-1:]
        if prior in ("{", "}", ";", ",") or prior and ahead.rstrip(" \t").endswith("\n"):
            body = _body(bare, pairs, m.end() - 1)
            if body is not None:
                yield Definition(start, pairs.get(body, len(bare) - 1) + 1, "method_definition", m[2])
    for m in _CONST.finditer(bare):
        end = _function_value(bare, pairs, m.end())
        if end is not None:
            tail = _ARROW_END.match(bare, end)
            yield Definition(m.start(), end + 1 if tail and bare[end : end + 1] == ";" else end, "lexical_declaration", m[1])


_GO_FUNC = re.compile(r"^func\s+([A-Za-z_]\w*)\s*(?=[(\[])|^func\s*\([^)\n]*\)\s*([A-Za-z_]\w*)\s*(?=\()", re.M)
_GO_TYPE = re.compile(r"^[ \t]*type\s+(?:([A-Za-z_]\w*)|\()", re.M)


def _go(bare: str, pairs: dict[int, int]):
    for m in _GO_FUNC.finditer(bare):
        at = m.end()
        if bare[at : at + 1] == "[":
            at = _skip_space(bare, pairs.get(at, at) + 1)
        at = pairs.get(at, at) + 1
        end = None
        while at < len(bare) and bare[at] != "\n":
            if bare[at] == "{":
                held = re.search(r"(?:interface|struct)\s*\Z", bare[max(0, at - 20) : at])
                if not held:
                    end = pairs.get(at, len(bare) - 1) + 1
                    break
            at = pairs.get(at, at) + 1 if bare[at] in "{([" else at + 1
        yield Definition(m.start(), end if end is not None else at, "function_declaration" if m[1] else "method_declaration", m[1] or m[2])
    for m in _GO_TYPE.finditer(bare):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        if m[1] is None:
            end = pairs.get(m.end() - 1, len(bare) - 1) + 1
            first = re.compile(r"\s*([A-Za-z_]\w*)").match(bare, m.end())
            yield Definition(start, end, "type_declaration", first[1] if first else None)
        else:
            yield Definition(start, _statement_end(bare, pairs, m.end()), "type_declaration", m[1])


_JAVA_NAME = re.compile(r"(?<![\w$@.])([A-Za-z_$][\w$]*)\s*\(")


def _java(bare: str, pairs: dict[int, int]):
    bodies: dict[int, tuple[str, str]] = {}

    def statement(at: int) -> int:
        """The first place of the declaration that ``at`` stands in: behind the last ; { or } that isn't part of an annotation."""
        depth, i = 0, at - 1
        while i >= 0:
            c = bare[i]
            if c == ")":
                depth += 1
            elif c == "(":
                depth -= 1
            elif depth <= 0 and c in ";{}":
                break
            i -= 1
        return _skip_space(bare, i + 1)

    types = []
    for m in re.finditer(r"(?<![\w$.])(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)", bare):
        body = bare.find("{", m.end())
        if body < 0 or re.search(r"[;=]", bare[m.end() : body]):
            continue
        annotation = m[1] == "@interface" or bare[m.start() - 1 : m.start()] == "@"
        bodies[body] = (m[1], m[2])
        if m[1] in ("class", "interface", "enum") and not annotation:
            types.append(Definition(statement(m.start()), pairs.get(body, len(bare) - 1) + 1, f"{m[1]}_declaration", m[2]))
    yield from types
    places, blocks = _innermost(bare, pairs)
    for m in _JAVA_NAME.finditer(bare):
        paren = m.end() - 1
        kind, owner = bodies.get(blocks[bisect_right(places, m.start()) - 1], ("", ""))
        if kind in ("", "@interface") or m[1] in _KEYWORDS:
            continue
        start = statement(m.start())
        header = re.sub(r"@[\w.$]+\s*(?:\([^()]*\))?", " ", bare[start : m.start()])
        if "=" in header or "(" in header or start > m.start():
            continue
        at = _skip_space(bare, pairs.get(paren, len(bare)) + 1)
        thrown = re.compile(r"throws\b[\w\s,.$]+").match(bare, at)
        at = _skip_space(bare, thrown.end()) if thrown else at
        at = _skip_space(bare, at + 2) if bare.startswith("[]", at) else at
        default = re.compile(r"default\b[^;{}]*").match(bare, at)
        at = default.end() if default else at
        if bare[at : at + 1] == "{":
            end = pairs.get(at, len(bare) - 1) + 1
        elif bare[at : at + 1] == ";":
            end = at + 1
        else:
            continue
        while "<" in header and (fewer := re.sub(r"<[^<>]*>", " ", header)) != header:
            header = fewer
        words = re.sub(r"\b(?:public|private|protected|static|final|abstract|native|synchronized|default|strictfp)\b", " ", header).split()
        if words:
            yield Definition(start, end, "method_declaration", m[1])
        elif bare[at] == "{" and m[1] == owner:
            yield Definition(start, end, "constructor_declaration", m[1])


def definitions(text: str, language: str) -> tuple[list[Definition], list[tuple[int, int]]]:
    """The definitions that become chunks, in order, and the spans of the comments; outer ones without those inside, classes with members replaced by them."""
    family = {"go": "go", "java": "java"}.get(language, "script")
    bare, comments = blank(text, family)
    pairs = matches(bare)
    found = {"go": _go, "java": _java}[language](bare, pairs) if family != "script" else _script(bare, pairs, language in ("typescript", "tsx"))
    allowed = RULES[language]
    by_place = sorted({d for d in found if d.node in allowed}, key=lambda d: (d.start, -d.end, d.node))
    out: list[Definition] = []
    reach = -1
    for i, d in enumerate(by_place):
        if d.start < reach:
            continue
        inside = i + 1 < len(by_place) and by_place[i + 1].start < d.end
        if d.node in CONTAINERS and inside:
            continue
        out.append(d)
        reach = d.end
    return out, comments
