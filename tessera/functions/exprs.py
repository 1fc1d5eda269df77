"""Column expressions of the engine: globs, vector scores, phrase tokens, names, paths, states. All run in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are indexed and the language each stands for.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".go": "go", ".rs": "rust", ".md": "markdown", ".yaml": "yaml", ".yml": "yaml",
    ".json": "json", ".toml": "toml", ".txt": "text", ".sh": "shell", ".bash": "shell", ".css": "css", ".html": "html", ".sql": "sql", ".dockerfile": "dockerfile",
}


# -- globs (shell patterns whose * also crosses "/", anchored, case-sensitive)


def glob_regex(pattern: Column) -> Column:
    """A regular expression equal to a shell pattern: *, ?, [seq], [!seq]; an unclosed bracket is a plain character."""
    tokens = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[!?+\]?+[^\]]*+\]|.)"), F.lit(0))

    def one(token: Column) -> Column:
        body = token.substr(F.lit(2), F.length(token) - 2)
        negated = body.startswith("!")
        inner = F.when(negated, body.substr(F.lit(2), F.length(body))).otherwise(body)
        escaped = F.regexp_replace(inner, r"([\\\[\]^&~|])", r"\\$1")
        backwards = F.exists(F.regexp_extract_all(inner, F.lit(r"(?s)([^-]-[^-])"), F.lit(0)), lambda r: r.substr(1, 1) > r.substr(3, 1))
        bracket = F.when(backwards, F.when(negated, F.lit(".")).otherwise(F.lit("(?!)"))).otherwise(F.concat(F.lit("["), F.when(negated, F.lit("^")).otherwise(F.lit("")), escaped, F.lit("]")))
        plain = F.regexp_replace(token, r"([^A-Za-z0-9_/ -])", r"\\$1")
        return F.when(token == "*", F.lit(".*")).when(token == "?", F.lit(".")).when(F.length(token) > 1, bracket).otherwise(plain)

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(tokens, one), ""), F.lit(r"\z"))


def glob_match(path: Column, pattern: Column) -> Column:
    return F.regexp_like(path, glob_regex(pattern))


def globs_overlap(a: Column, b: Column) -> Column:
    """Whether either pattern, read as a name, matches the other."""
    return glob_match(a, b) | glob_match(b, a)


# -- vectors


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in doubles, added from the first element to the last."""
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + distance)


def mean_vector(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half away from zero as SQL engines on C do it: scaled, rounded, scaled back; a negative that rounds to zero stays -0.0."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled)
    near = F.when(scaled < 2.0**52, whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(scaled)
    return F.signum(x) * (near / 10.0**digits)


# -- text


def phrase_text(*columns: Column) -> Column:
    """Lower-cased words of letters and digits, each between single spaces, so a phrase is a substring."""
    words = [F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for c in columns]
    return F.concat_ws(" | ", *[F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" ")) for w in words])


def has_phrase(indexed: Column, query: str) -> Column:
    """Whether phrase_text holds the query's words in a row; a query without words matches nothing."""
    words = F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return (F.size(words) > 0) & F.contains(indexed, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")))


@functools.cache
def _marked_letters() -> tuple[str, str]:
    """Letters that are another with combining marks, up to the Latin and Greek extensions, and those others."""
    letters = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in letters if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def without_marks(text: Column) -> Column:
    """Letters with diacritics as the plain letters, combining marks left out."""
    marked, plain = _marked_letters()
    return F.translate(F.regexp_replace(text, r"[\u0300-\u036F]", ""), marked, plain)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def shown_summary(summary: Column, content: Column) -> Column:
    return F.coalesce(F.nullif(summary, F.lit("")), F.substring(content, 1, 200))


def shortened_path(path: Column, longest: int = 40) -> Column:
    return F.when(F.length(path) > longest, F.concat(F.lit("..."), F.right(path, F.lit(longest - 3)))).otherwise(path)


def shown_time(at: Column) -> Column:
    """A time to the second, as text."""
    return F.substring(at.cast("string"), 1, 19)


def shown_text(text: Column, longest: int = 60) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, longest)


def merge_author(branch: Column) -> Column:
    return F.concat(F.lit("merge:"), branch)


def merge_id(branch: Column, token: Column) -> Column:
    """An id for what a merge tells: the branch and the first eight characters of a token."""
    return F.concat(F.lit("merge-"), branch, F.lit("-"), F.substring(token, 1, 8))


def patterns_json(patterns: Column) -> Column:
    return F.to_json(patterns)


def patterns_of(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def line_range(text: Column) -> Column:
    """(first, last) of "a-b"; nulls unless there are exactly two numbers."""
    parts = F.split(text, "-")
    number = lambda i: F.when(F.size(parts) == 2, F.get(parts, F.lit(i)).try_cast("int"))
    return F.struct(number(0).alias("first"), number(1).alias("last"))


def joined_keywords(keywords: Column) -> Column:
    return F.nullif(F.array_join(keywords, ","), F.lit(""))


# -- names and paths


def branch_key(branch: Column) -> Column:
    return F.regexp_replace(F.replace(branch, F.lit("/"), F.lit("--")), r"[^a-zA-Z0-9_-]", "")


def base_collection(project: Column) -> Column:
    return F.concat(F.lit("code_"), project)


def overlay_collection(project: Column, branch: Column) -> Column:
    return F.concat(base_collection(project), F.lit("__"), branch_key(branch))


def stored_text(path: Column, first: Column, last: Column, content: Column) -> Column:
    return F.concat(F.lit("# "), path, F.lit(" (L"), first.cast("string"), F.lit("-L"), last.cast("string"), F.lit(")\n"), content)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The lower-cased last suffix with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1)))


def top_folder(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def language_of(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("unknown"))


def chunk_label(node_type: Column) -> Column:
    """The label of a syntax node's type: the first of these words that it has."""
    out = F.when(node_type.contains("class"), "class").when(node_type.contains("function") | node_type.contains("method"), "function")
    for word, label in (("impl", "impl"), ("struct", "struct"), ("enum", "enum"), ("type", "type"), ("export", "export"), ("lexical", "variable")):
        out = out.when(node_type.contains(word), label)
    return out.otherwise("definition")


# -- time


def before(now: Column, minutes: int) -> Column:
    return now - F.make_dt_interval(mins=F.lit(minutes))


def session_state(last: Column, now: Column, status: Column) -> Column:
    """disconnected over 5 minutes ago, idle over 2 if it was active, null (gone) over a day ago."""
    return F.when(last < before(now, 24 * 60), F.lit(None)).when(last < before(now, 5), F.lit("disconnected")).when((last < before(now, 2)) & (status == "active"), F.lit("idle")).otherwise(status)
