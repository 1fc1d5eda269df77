"""Splitting source text into chunks: character windows, syntax, size and token caps, assembly."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..shared import pieces
from . import syntax

WINDOW, OVERLAP, CAP, LEAST_LINES = 2500, 300, 5000, 3


@dataclass(frozen=True)
class Chunk:
    content: str
    start_line: int
    end_line: int
    chunk_type: str = "text"
    name: str | None = None
    parent_name: str | None = None


def windows(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """(start, end) of windows: an end moves back behind the last line break, if that is beyond the start, and the
    next window then begins there; otherwise it begins ``overlap`` before the end."""
    overlap, at = min(overlap, size - 1), 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            yield at, len(text)
            return
        cut = text.rfind("\n", at + 1, end)
        end = cut + 1 if cut > 0 else end
        yield at, end
        at = end if cut > 0 else max(0, end - overlap)


def split_text(text: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[Chunk]:
    """Chunks of the windows that are not blank, with their lines from 1."""
    out, line, at = [], 1, 0
    if not text.strip():
        return out
    for start, end in windows(text, size, overlap):
        line += text.count("\n", at, start) if start >= at else -text.count("\n", start, at)
        at = start
        if text[start:end].strip():
            out.append(Chunk(text[start:end], line, line + text.count("\n", start, end - 1)))
    return out


def split_python(source: str) -> list[Chunk]:
    """Chunks of top-level functions and classes, of a class's longer methods instead of the class, and of what is
    between. Source that doesn't parse is split by indentation."""
    if not source.strip():
        return []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return split_nodes(source, syntax.python_blocks(source))
    data = source.encode()
    lines = [0]
    for piece in data.split(b"\n")[:-1]:
        lines.append(lines[-1] + len(piece) + 1)

    def span(node: ast.AST) -> tuple[int, int, int, int]:
        first = min([node, *node.decorator_list], key=lambda x: (x.lineno, x.col_offset))
        start = lines[first.lineno - 1] + first.col_offset - (1 if first is not node else 0)
        while first is not node and data[start : start + 1] != b"@":
            start -= 1
        return start, lines[node.end_lineno - 1] + node.end_col_offset, data.count(b"\n", 0, start) + 1, node.end_lineno

    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    label = lambda n: "definition" if n.decorator_list else "class" if isinstance(n, ast.ClassDef) else "function"
    out, done = [], 0
    for node in (n for n in tree.body if isinstance(n, kinds)):
        start, end, first, last = span(node)
        gap = data[done:start].decode("utf-8", "replace")
        if gap.strip():
            out.append(Chunk(gap, data.count(b"\n", 0, done) + 1, first, "module_header"))
        nested = []
        if isinstance(node, ast.ClassDef):
            head = source.split("\n")[node.lineno - 1].strip()
            for inner in (n for n in node.body if isinstance(n, kinds[:2]) or isinstance(n, kinds) and n.decorator_list):
                a, b, f, e = span(inner)
                text = data[a:b].decode("utf-8", "replace")
                if text.count("\n") + 1 >= LEAST_LINES:
                    nested.append(Chunk(f"{head}\n    {text}", f, e, label(inner), inner.name, node.name))
        out += nested or [Chunk(data[start:end].decode("utf-8", "replace"), first, last, label(node), node.name)]
        done = end
    tail = data[done:].decode("utf-8", "replace")
    if out and tail.strip():
        out.append(Chunk(tail, data.count(b"\n", 0, done) + 1, source.count("\n") + 1, "module_body"))
    if not out:
        out = [Chunk(source, 1, source.count("\n") + 1, "module_body")]
    return out


def node_label(kind: str) -> str:
    """The label of a syntax node's type: the first of these words that it has."""
    labels = (("class", "class"), ("function", "function"), ("method", "function"), ("impl", "impl"), ("struct", "struct"), ("enum", "enum"), ("type", "type"), ("export", "export"), ("lexical", "variable"))
    return next((label for word, label in labels if word in kind), "definition")


def split_nodes(source: str, nodes: list[syntax.Node]) -> list[Chunk]:
    """Chunks of definitions and of what is between; longer members of a container stand for it, each under its first line."""
    if not source.strip():
        return []
    line = lambda at: source.count("\n", 0, at) + 1
    out, done = [], 0
    for n in nodes:
        if source[done : n.start].strip():
            out.append(Chunk(source[done : n.start], line(done), line(n.start), "module_header"))
        head = source[n.start : n.end].split("\n", 1)[0]
        inner = [(m, source[m.start : m.end]) for m in n.members]
        nested = [Chunk(f"{head}\n    {text}", line(m.start), line(m.end), node_label(m.kind), m.name, n.name) for m, text in inner if text.count("\n") + 1 >= LEAST_LINES]
        out += nested or [Chunk(source[n.start : n.end], line(n.start), line(n.end), node_label(n.kind), n.name)]
        done = n.end
    if source[done:].strip():
        out.append(Chunk(source[done:], line(done), line(len(source)), "module_body"))
    return out


def _by(language: str) -> Callable[[str], list[Chunk]]:
    return lambda source: split_nodes(source, syntax.definitions(source, language))


#: Languages split by syntax; others are split by windows.
PARSERS: dict[str, Callable[[str], list[Chunk]]] = {"python": split_python, **{x: _by(x) for x in syntax.GRAMMARS}}


def supported_languages() -> list[str]:
    return sorted(PARSERS)


def capped(chunk: Chunk, cap: int = CAP, tokens: Callable[[str], int] | None = None, most: int | None = None) -> list[Chunk]:
    """Pieces of a chunk within ``cap`` characters (0: any) and ``most`` tokens, halved at the line break nearest the middle."""
    out, left = [], [chunk]
    while left:
        c = left.pop()
        text = c.content
        if len(text) < 2 or not (0 < cap < len(text) or tokens and most and tokens(text) > most):
            out.append(c)
            continue
        middle = len(text) // 2
        ends = [i + 1 for i in (text.rfind("\n", 0, middle), text.find("\n", middle)) if i >= 0]
        at = min(ends, key=lambda e: (abs(e - 1 - middle), e), default=middle)
        at = at if 0 < at < len(text) else middle
        line = min(c.end_line, c.start_line + text.count("\n", 0, at))
        left += [replace(c, content=text[at:], start_line=line), replace(c, content=text[:at], end_line=line)]
    return out


def split_source(text: str, language: str, size: int = WINDOW, overlap: int = OVERLAP, cap: int = CAP, tokens: Callable[[str], int] | None = None, most: int | None = None) -> list[Chunk]:
    parsed = PARSERS[language](text) if language in PARSERS else []
    return [p for c in parsed or split_text(text, size, overlap) for p in capped(c, cap, tokens, most)]


CHUNKS = "start_line int, end_line int, chunk_type string, name string, parent_name string, piece int, content string"
_NAMES, _KINDS = [x.split()[0] for x in CHUNKS.split(", ")], [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]


def columns_of(chunks: list[tuple[int, Chunk]]) -> dict[str, pa.Array]:
    """The columns of numbered chunks."""
    rows = [(c.start_line, c.end_line, c.chunk_type, c.name, c.parent_name, k, c.content) for k, c in chunks]
    return {n: pa.array(v, t) for n, v, t in zip(_NAMES, list(zip(*rows, strict=True)) or [[]] * len(_KINDS), _KINDS, strict=True)}


def chunked(df: DataFrame, keys: list[str], text: str, split: Callable[[dict], list[Chunk]], read: list[str] | None = None) -> DataFrame:
    """The chunks of every row of ``df`` with its ``keys``: a map, without any shuffle. ``split`` gets the row's text and ``read``.

    A batch is taken in slices of bounded bytes.
    """
    read = read or []

    def run(batches):
        for batch in batches:
            for part in pieces(batch, text):
                at, found = [], []
                for i, row in enumerate(part.select(list(dict.fromkeys([text, *read]))).to_pylist()):
                    for numbered in enumerate(split(row) if row[text] is not None else []):
                        at.append(i)
                        found.append(numbered)
                index = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_pydict({k: part.column(k).take(index) for k in keys} | columns_of(found))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*dict.fromkeys([*keys, text, *read])).mapInArrow(run, f"{schema}, {CHUNKS}")


def text_chunks(df: DataFrame, keys: list[str], text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    return chunked(df, keys, text, lambda row: split_text(row[text], size, overlap))


def cap_chunks(df: DataFrame, keys: list[str], text: str = "text", cap: int = CAP, tokens: Callable[[str], int] | None = None, most: int | None = None) -> DataFrame:
    """Whole texts as one chunk each, cut to ``cap`` characters and ``most`` tokens."""
    whole = lambda t: Chunk(t, 1, t.count("\n") + 1)
    return chunked(df, keys, text, lambda row: capped(whole(row[text]), cap, tokens, most))


def source_chunks(files: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, cap: int = CAP, tokens: Callable[[str], int] | None = None, most: int | None = None) -> DataFrame:
    """Chunks of files (project, file_path, language, text), split by syntax where there is a parser, and within both caps.

    ``tokens`` counts a text's tokens; it is sent to executors. Without it, or without ``most``, characters alone count.
    """
    return chunked(files, ["project", "file_path", "language"], "text", lambda row: split_source(row["text"], row["language"], size, overlap, cap, tokens, most), ["language"])


def documents(chunks: DataFrame) -> DataFrame:
    """Chunks as stored: the text under a line that names its place. The id has the piece too, so that the pieces of one long line differ."""
    stored = X.stored_text(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("content"))
    key = F.concat_ws(":", "project", "file_path", F.concat_ws("-", "start_line", "end_line"), F.col("piece").cast("string"))
    return chunks.withColumn("content", stored).withColumn("id", F.md5(key))
