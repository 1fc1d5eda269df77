from hypothesis import given
from hypothesis import strategies as st

from tessera.operators.chunking import Chunk, capped, source_chunks, split_python, split_source, split_text

SOURCE = '''"""Doc."""
import os

LIMIT = 3


def greet(name):
    """Say hello."""
    return f"hello {name}"


class Greeter:
    """A greeter."""

    def hello(self):
        x = 1
        return x

    def short(self): return 1


@property
def wrapped(self):
    return 1


if __name__ == "__main__":
    greet("x")
'''


def test_windows_overlap_and_snap():
    assert [c.content for c in split_text("abcdefghij", 5, 2)] == ["abcde", "defgh", "ghij"]
    assert [c.content for c in split_text("First line.\nSecond line.", 15, 0)] == ["First line.\n", "Second line."]
    assert [(c.start_line, c.end_line) for c in split_text("First line.\nSecond line.", 15, 0)] == [(1, 1), (2, 2)]
    assert split_text(" \n ") == []
    assert len(split_text("a\n" + "x" * 50000)) < 60


@given(st.text("ab\n ", max_size=300), st.integers(1, 40), st.integers(0, 60))
def test_windows_end_and_lines(text, size, overlap):
    for c in split_text(text, size, overlap):
        assert 0 < len(c.content) <= size
        assert c.content in text
        assert c.end_line - c.start_line == c.content[:-1].count("\n")


def test_cap():
    whole = Chunk("x" * 50000, 1, 1)
    pieces = capped(whole, 5000)
    assert all(len(p.content) <= 5000 for p in pieces) and "".join(p.content for p in pieces) == whole.content
    assert capped(whole, 0) == [whole]
    first, second = capped(Chunk("a" * 2990 + "\n" + "b" * 3009, 1, 2), 5000)
    assert first.content.endswith("\n") and (first.start_line, first.end_line, second.start_line) == (1, 2, 2)
    assert all(len(p.content.split()) <= 3 for p in capped(Chunk("a b c d e f g", 1, 1), 0, lambda t: len(t.split()), 3))


def test_python_syntax():
    chunks = split_python(SOURCE)
    by_name = {c.name: c for c in chunks if c.name}
    assert (by_name["greet"].start_line, by_name["greet"].end_line, by_name["greet"].chunk_type) == (7, 9, "function")
    assert by_name["hello"].parent_name == "Greeter" and by_name["hello"].content.startswith("class Greeter:\n    def hello")
    assert "Greeter" not in by_name and "short" not in by_name
    assert by_name["wrapped"].chunk_type == "definition" and by_name["wrapped"].content.startswith("@property")
    assert [c.chunk_type for c in chunks if not c.name] == ["module_header", "module_body"]
    assert [c.content for c in split_python("def (")] == ["def ("] and split_python("") == []
    assert [c.chunk_type for c in split_source("def (", "python")] == ["module_body"]
    assert [c.name for c in split_python("class A:\n    def b(self): pass\n")] == ["A"]


def test_source_chunks_in_spark(spark):
    rows = spark.createDataFrame([("p", "a.py", "python", SOURCE), ("p", "b.md", "markdown", "# t\n"), ("p", "c.md", "markdown", None)], "project string, file_path string, language string, text string")
    got = source_chunks(rows).collect()
    assert {r.file_path for r in got} == {"a.py", "b.md"} and "greet" in {r.name for r in got}
