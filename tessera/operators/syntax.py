"""Definitions in source text of languages with braces, and in Python that doesn't parse.

One pass over a text's tokens finds the outermost statements with their extent; the word that a statement begins with
says what it defines. Strings, templates, comments, regular expressions and character literals are skipped as wholes, and
a text that ends in mid-statement gives what it holds, so broken source is split as far as it goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Node:
    """A definition: kind is the syntax node's type; ``body`` is where its members stand."""

    kind: str
    start: int
    end: int
    name: str | None = None
    body: tuple[int, int] | None = None
    members: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class Grammar:
    """Patterns at the start of a statement: (kind, pattern with a group ``name`` where it has one, whether it ends with its braces)."""

    skipped: re.Pattern
    statements: tuple[tuple[str, re.Pattern, bool], ...]
    #: Kinds whose members are chunks of their own, and what members look like.
    containers: tuple[str, ...] = ()
    members: tuple[tuple[str, re.Pattern, bool], ...] = ()
    #: Whether a line end ends a statement that could be whole, and whether /.../ is a value.
    lines_end: bool = True
    regexes: bool = False


_JS_SKIPPED = re.compile(
    r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*+(?:"|$)|'(?:[^'\\\n]|\\.)*+(?:'|$)|`(?:[^`\\]|\\.)*+(?:`|\Z)""",
    re.DOTALL | re.MULTILINE,
)
#: A regular expression, where a value may stand.
_JS_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_BEFORE_VALUE = frozenset("=(,:;!&|?{}[") | {"", "return", "typeof", "case"}
_C_SKIPPED = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*+(?:"|\Z)|`[^`]*+(?:`|\Z)|'(?:[^'\\\n]|\\[^\n]+?)'""", re.DOTALL)
_JS_NAME = r"(?P<name>[\w$]+)"
_JS_FUNCTION = rf"(?:async\s+)?function\b(?!\s*\*)\s*{_JS_NAME}?"
_JS_CLASS = rf"class\b(?:\s+(?!extends\b|implements\b){_JS_NAME})?"


def _js(typed: bool) -> Grammar:
    made = lambda kind, pattern, braces: (kind, re.compile(pattern), braces)
    return Grammar(
        _JS_SKIPPED,
        (
            made("export_statement", rf"export\b\s*(?:default\b\s*)?{_JS_FUNCTION}", True),
            made("export_statement", rf"export\b\s*(?:default\b\s*)?(?:abstract\s+)?{_JS_CLASS}", True),
            made("export_statement", r"export\b", False),
            made("function_declaration", _JS_FUNCTION, True),
            made("class_declaration", _JS_CLASS, True),
            made("lexical_declaration", r"(?:const|let)\b(?!\s+enum\b)", False),
        ),
        ("class_declaration",),
        (
            made("method_definition", r"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<name>#?[\w$]+|\[[^\]]*\])\s*(?:<[^>(]*>\s*)?\([^)]*\)[^;{}=]*(?=\{)", True),
            *([made("public_field_definition", r"(?:(?:public|private|protected|static|readonly|declare|override)\s+)*(?P<name>#?[\w$]+)\s*[?!]?\s*(?::|=|;)", False)] if typed else []),
        ),
        regexes=True,
    )


_RUST_SKIPPED = re.compile(rf"(?P<attribute>#!?\[[^\]]*\])|{_C_SKIPPED.pattern}", re.DOTALL)
_PUB = r"(?:pub(?:\s*\([^)]*\))?\s+)?"
_RUST_FN = (
    "function_item",
    re.compile(rf'{_PUB}(?:(?:const|async|unsafe|extern(?:\s+"[^"]*")?)\s+)*fn\s+(?P<name>\w+)'),
    True,
)
# The kinds of node that each language's chunks are made of.
GRAMMARS: dict[str, Grammar] = {
    "javascript": _js(False),
    "typescript": _js(True),
    "tsx": _js(True),
    "go": Grammar(
        _C_SKIPPED,
        (
            ("method_declaration", re.compile(r"func\s*\([^)]*\)\s*\w+"), True),
            ("function_declaration", re.compile(r"func\s+(?P<name>\w+)"), True),
            ("type_declaration", re.compile(r"type\b"), False),
        ),
    ),
    "rust": Grammar(
        _RUST_SKIPPED,
        (
            _RUST_FN,
            ("impl_item", re.compile(r"(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[\w:<>,' ]+\s+for\s+)?(?P<name>\w+)"), True),
            ("struct_item", re.compile(rf"{_PUB}struct\s+(?P<name>\w+)"), True),
            ("enum_item", re.compile(rf"{_PUB}enum\s+(?P<name>\w+)"), True),
        ),
        ("impl_item",),
        (_RUST_FN,),
        False,
    ),
}
_EXPORTED_CLASS = re.compile(rf"export\s+(?:default\s+)?(?:abstract\s+)?{_JS_CLASS}")
_SPACE = re.compile(r"\s*")
_WORD = re.compile(r"[\w$]+|\s+|.", re.DOTALL)
_OPEN, _CLOSE = "([{", ")]}"
#: A statement goes on after a line that ends in, or before one that begins with, one of these.
_GOES_ON = frozenset("=+-*/%&|^<>?:,.([{!~")


def _statements(text: str, grammar: Grammar, kinds, start: int, end: int) -> list[Node]:
    """The outermost statements of ``kinds`` between two places."""
    out: list[Node] = []
    at, depth, fresh, last, word = start, 0, True, "", ""
    current: tuple[str, str | None, bool, int] | None = None
    body: tuple[int, int] | None = None

    def close(to: int) -> None:
        nonlocal current, body
        if current is not None:
            kind, name, _, first = current
            out.append(Node(kind, first, to, name, body))
        current = body = None

    while at < end:
        skipped = grammar.skipped.match(text, at, end)
        if not skipped and grammar.regexes and text[at] == "/" and (last in _BEFORE_VALUE or word in _BEFORE_VALUE - {""}):
            skipped = _JS_REGEX.match(text, at, end)
        if skipped and skipped.end() > at:
            if not skipped.group().startswith(("//", "/*", "#[", "#![")):
                last, fresh, word = "x", False, ""
            at = skipped.end()
            continue
        c = text[at]
        if c.isspace():
            if c == "\n" and depth == 0 and grammar.lines_end:
                following = _SPACE.match(text, at).end()
                if last and last not in _GOES_ON and (following >= end or text[following] not in "=+*%&|^<>?:,.({"):
                    if current is None or not current[2]:
                        close(at)
                        fresh = True
            at += 1
            continue
        if depth == 0 and fresh and current is None:
            found = next(((kind, m, braces) for kind, p, braces in kinds if (m := p.match(text, at, end))), None)
            if found:
                kind, m, braces = found
                current = (kind, m.groupdict().get("name"), braces, at)
                last, fresh, at = "x", False, max(m.end(), at + 1)
                continue
        if c in _OPEN:
            if c == "{" and depth == 0 and current is not None and current[2]:
                body = (at + 1, end)
            depth += 1
        elif c in _CLOSE:
            depth = max(0, depth - 1)
            if depth == 0 and c == "}":
                if current is not None and current[2]:
                    body = (body[0], at) if body else None
                    close(at + 1)
                if current is None:
                    fresh, last, at = True, "", at + 1
                    continue
        elif c == ";" and depth == 0:
            close(at + 1)
            fresh, last, at = True, "", at + 1
            continue
        else:
            token = _WORD.match(text, at, end)
            word, fresh, at = token.group(), False, token.end()
            last = word[-1]
            continue
        last, word, fresh, at = c, "", False, at + 1
    close(end)
    for node in out:
        tail = text[node.start : node.end]
        node.end -= len(tail) - len(tail.rstrip())
    return out


def definitions(text: str, language: str) -> list[Node]:
    """Outermost definitions, those of containers with their members."""
    grammar = GRAMMARS[language]
    out = _statements(text, grammar, grammar.statements, 0, len(text))
    for node in out:
        inside = node.kind in grammar.containers or node.kind == "export_statement" and _EXPORTED_CLASS.match(text, node.start, node.end)
        if inside and node.body:
            node.members = _statements(text, grammar, grammar.members, *node.body)
    return out


_PY_HEAD = re.compile(r"(?:async[ \t]+def|def|class)[ \t]+(\w+)|@", re.ASCII)


def python_blocks(text: str) -> list[Node]:
    """Outermost definitions of Python source by indentation alone, for source that doesn't parse."""
    lines, starts, at = text.split("\n"), [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    out: list[Node] = []

    def blocks(first: int, last: int, indent: int) -> list[Node]:
        found, i = [], first
        while i < last:
            line = lines[i]
            m = _PY_HEAD.match(line, indent) if not line[:indent].strip() and len(line) > indent and not line[indent].isspace() else None
            if not m:
                i += 1
                continue
            begin, decorated = i, line[indent] == "@"
            while i < last and (lines[i][indent : indent + 1] == "@" or not lines[i].strip()):
                i += 1
            head = _PY_HEAD.match(lines[i], indent) if i < last else None
            if not head or not head.group(1):
                continue
            j = i + 1
            while j < last and (not lines[j].strip() or lines[j][: indent + 1].isspace() or lines[j].lstrip()[:1] in ")]}"):
                j += 1
            while j > i + 1 and not lines[j - 1].strip():
                j -= 1
            kind = "decorated_definition" if decorated else "class_definition" if lines[i][indent:].startswith("class") else "function_definition"
            node = Node(kind, starts[begin] + indent, starts[j - 1] + len(lines[j - 1]), head.group(1), (i + 1, j))
            if lines[i][indent:].startswith("class"):
                inner = next((len(x) - len(x.lstrip()) for x in lines[i + 1 : j] if x.strip()), 0)
                node.members = blocks(i + 1, j, inner) if inner > indent else []
            found.append(node)
            i = j
        return found

    out = blocks(0, len(lines), 0)
    return out
