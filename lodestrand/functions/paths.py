"""Column expressions on portable relative paths. Separator '/', byte order, null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_PATH_BYTES, MAX_COMPONENT_BYTES = 4096, 255

# Names that some file systems reserve, and characters they refuse.
RESERVED = ("CON", "PRN", "AUX", "NUL", "CLOCK$", "CONIN$", "CONOUT$")
NUMBERED = ("COM", "LPT")
NUMERALS = "123456789¹²³"
REFUSED = r'[<>:"|?*\x00-\x1f\x7f-\x9f]'


def components(path: Column) -> Column:
    return F.split(path, "/")


def depth(path: Column) -> Column:
    return F.size(components(path))


def parent(path: Column) -> Column:
    """null for a path of one component."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(file_name: Column) -> Column:
    """The name before its last dot; a leading dot begins no extension."""
    return F.when(F.instr(F.substring(file_name, 2, 1_000_000), ".") > 0, F.regexp_replace(file_name, r"\.[^.]*$", "")).otherwise(file_name)


def extension(file_name: Column) -> Column:
    """With its dot, or empty."""
    return F.when(F.instr(F.substring(file_name, 2, 1_000_000), ".") > 0, F.regexp_extract(file_name, r"(\.[^.]*)$", 1)).otherwise(F.lit(""))


def ancestors(path: Column, proper: bool = False) -> Column:
    """All prefixes at component borders, shortest first; the path itself unless proper."""
    parts = components(path)
    last = F.size(parts) - (1 if proper else 0)
    of = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(of)


def under(path: Column, prefix: Column) -> Column:
    """The path is the prefix or lies below it; a sibling that merely begins alike doesn't."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/"))) | (prefix == "")


def overlap(a: Column, b: Column) -> Column:
    return under(a, b) | under(b, a)


def path_issue(path: Column) -> Column:
    """The first rule a path breaks, null if none: empty, too_long, not_relative, component, component_too_long, reserved."""
    parts = components(path)
    bad = F.exists(parts, lambda c: (c == "") | (c == ".") | (c == "..") | F.endswith(c, F.lit(".")) | F.endswith(c, F.lit(" ")) | c.rlike(REFUSED))
    long = F.exists(parts, lambda c: F.octet_length(c) > MAX_COMPONENT_BYTES)
    base = lambda c: F.upper(F.rtrim(F.split_part(c, F.lit("."), F.lit(1))))
    numbered = rf"^({'|'.join(NUMBERED)})[{NUMERALS}]$"
    reserved = F.exists(parts, lambda c: base(c).isin(*RESERVED) | base(c).rlike(numbered))
    return (
        F.when(path == "", "empty")
        .when(F.octet_length(path) > MAX_PATH_BYTES, "too_long")
        .when(F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")), "not_relative")
        .when(bad, "component")
        .when(long, "component_too_long")
        .when(reserved, "reserved")
    )


def truncate_utf8(text: Column, budget: Column) -> Column:
    """The longest prefix of at most so many bytes that cuts no character."""
    raw = F.encode(text, "UTF-8")
    # a character's later bytes are 80-BF: step back from one, at most three times
    border = lambda n: ~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")
    steps = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)), lambda k: F.greatest(budget - k, F.lit(0)))
    kept = F.element_at(F.filter(steps, border), 1)
    return F.when(F.octet_length(text) <= budget, text).otherwise(F.decode(F.substring(raw, F.lit(1), kept), "UTF-8"))


def conflict_path(path: Column, token: Column) -> Column:
    """A sibling's name for a preserved copy: stem, '.conflict-' and token, extension, within the byte limits."""
    file_name, above = name(path), parent(path)
    suffix = F.concat(F.lit(".conflict-"), token)
    room = F.least(F.lit(MAX_PATH_BYTES) - F.coalesce(F.octet_length(above) + 1, F.lit(0)), F.lit(MAX_COMPONENT_BYTES))
    ext = F.when(F.octet_length(suffix) + F.octet_length(extension(file_name)) < room, extension(file_name)).otherwise(F.lit(""))
    kept = truncate_utf8(stem(file_name), (room - F.octet_length(suffix) - F.octet_length(ext)).cast("int"))
    return F.concat(F.when(above.isNotNull(), F.concat(above, F.lit("/"))).otherwise(F.lit("")), kept, suffix, ext)
