"""Visually identical text with different characters, brought to one form.

A compiled longest-match transducer. Its input symbols are grapheme clusters, each with the invisible characters
and stray marks that follow it. Its table is made once on the driver, over all of Unicode, and checked whole before it is
used: width and compatibility forms, composition, invisible characters, kinds of blank, and letters of other scripts with a
Latin letter's shape. These are the table below and, beyond it, the published list of confusable characters that
Spark's own ICU library holds, as far as it keeps the rules: a letter's case, accents and digits stay what they are,
two letters of one script stay apart, and a letter without case isn't taken for one of I and l. A text is walked once; each
cluster is looked up whole, or else spelled by the longest entries in it and remembered. An ASCII text is its own form.

The checks: every target is a fixed point, no source has two targets, no printable ASCII character is changed,
no letter of a list changes its case or becomes a digit, and nothing but invisible characters vanishes.

Letter case, accents, blanks as such and digits that resemble letters are kept apart. So are letters of one script:
the Latin alpha and script g are letters of their own, as a and g are.

Defined results: null text gives null, empty text an empty one; a text of invisible characters only gives
an empty form. Unpaired or unassigned characters are kept.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..runtime import materialise

# Letters of other scripts with the shape of a Latin letter.
LOOKALIKES = (
    ("ABCEHIJKMOPSTXYZ", "АВСЕНІЈКМОРЅТХҮΖ"),  # Cyrillic, Greek Zeta
    ("ABEHIKMNOPTXY", "ΑΒΕΗΙΚΜΝΟΡΤΧΥ"),  # Greek
    ("acdehijopqsuwxyv", "асԁеһіјорԛѕսԝхуѵ"),  # Cyrillic, Armenian Seh
    ("GQWY", "ԌԚԜУ"),  # Cyrillic Komi Sje, Qa, We, U
    ("ouvp", "ουνρ"),  # Greek small
    ("cCj", "ϲϹϳ"),  # Greek lunate sigma, yot
    ("oghnqO", "օցհոզՕ"),  # Armenian
    ("l", "ӏ"),  # Cyrillic palochka
)

#: Invisible besides the format characters: fixed values of Default_Ignorable_Code_Point outside category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"

_VARIATION = r"︀-️\U000e0100-\U000e01ef"
_HIDDEN = rf"[\p{{Cf}}{INVISIBLE}{_VARIATION}]"
#: Jamo compose across clusters once their halfwidth and compatibility forms are undone, so a run of them is one symbol.
_JAMO = "[\u1100-\u11ff\u3131-\u318e\ua960-\ua97c\ud7b0-\ud7fb\uffa1-\uffdc]"
_MARK = "[\\p{M}\uff9e\uff9f]"  # the halfwidth sound marks become combining ones
_CLUSTER = regex.compile(rf"(?:{_JAMO}(?:{_HIDDEN}*{_JAMO})*{_MARK}*|\X)(?:{_HIDDEN}+{_MARK}*)*")
_IS_HIDDEN = regex.compile(_HIDDEN)
_BLANK = regex.compile(r"[\p{Zs}\t]")
_LATIN = regex.compile(r"\p{Latin}")
_LISTED = regex.compile(r"[\p{L}--\p{Latin}--\p{Han}--\p{Hangul}]", regex.V1)


class Conflict(ValueError):
    """The mapping isn't a function onto fixed points."""


@cache
def letters() -> dict[str, str]:
    """The table above, look-alike to Latin, checked."""
    table: dict[str, str] = {}
    for latin, others in LOOKALIKES:
        if len(latin) != len(others):
            raise Conflict(f"uneven row: {latin}")
        for to, source in zip(latin, others, strict=True):
            if table.setdefault(source, to) != to:
                raise Conflict(f"{source!r} has two targets")
            if source.isascii() or not to.isascii():
                raise Conflict(f"{source!r} to {to!r} leaves or enters ASCII")
    if hit := [t for t in table.values() if t in table]:
        raise Conflict(f"targets that are mapped further: {hit}")
    return table


def _script(ch: str) -> str:
    """The first word of a letter's name, which is its script's."""
    return unicodedata.name(ch, "?").split()[0]


def admitted(skeletons: dict[str, str]) -> dict[str, str]:
    """Of a list of letters with the forms they are confused with, what keeps the rules: letter to ASCII letter of its shape.

    skeletons also holds the ASCII letters' own forms, by which a form is told to be theirs.
    """
    shapes: dict[str, list[str]] = {}
    for ch, form in skeletons.items():
        if ch.isascii() and ch.isalpha():
            shapes.setdefault(form, []).append(ch)
    taken = {(_script(source), to) for source, to in letters().items()}
    found: dict[str, str] = {}
    by_place: dict[tuple[str, str], list[str]] = {}
    for ch, form in skeletons.items():
        if ch.isascii() or form not in shapes or ch in letters() or not _LISTED.match(ch) or unicodedata.normalize("NFKD", ch) != ch:
            continue
        cased = ch.lower() != ch.upper()
        fits = [a for a in shapes[form] if not cased or a.isupper() == ch.isupper()]
        if len(fits) == 1:
            found[ch] = fits[0]
            by_place.setdefault((_script(ch), fits[0]), []).append(ch)
    for place, sources in by_place.items():
        if len(sources) > 1 or place in taken:  # letters of one script differ to whoever reads it
            for ch in sources:
                del found[ch]
    return found


_published: dict[str, str] = {}


def published(spark: SparkSession) -> dict[str, str]:
    """The part of the published list of confusables that keeps the rules, from the ICU library beside Spark."""
    if not _published:
        asked = [chr(c) for c in range(33, 127)] + [ch for c in range(0x80, sys.maxunicode + 1) if _LISTED.match(ch := chr(c))]
        checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        forms = checker.getSkeleton("\n".join(asked)).split("\n")
        if len(forms) != len(asked):
            raise Conflict("the published list isn't a list of single letters")
        _published.update(admitted(dict(zip(asked, forms, strict=True))))
    return _published


def _target(ch: str, table: dict[str, str]) -> str:
    """One character's target, decomposed."""
    if _IS_HIDDEN.match(ch):
        return ""
    if ch in table:  # before compatibility forms, which would read a lunate sigma as a sigma
        return table[ch]
    out = (table.get(d, " " if _BLANK.match(d) else d) for d in unicodedata.normalize("NFKD", ch) if not _IS_HIDDEN.match(d))
    return unicodedata.normalize("NFD", "".join(out))


def _mapped_ranges() -> Iterator[str]:
    """All characters but Hangul syllables, which are composed by rule, and ideographs and private ones, which are fixed."""
    for a, b in ((0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x17000), (0x18D80, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000)):
        yield from map(chr, range(a, b))


def compiled(more: dict[str, str] | None = None) -> dict[str, str]:
    """Every character of Unicode, and every composed one's parts, that isn't its own target, with its target; checked."""
    listed = (more or {}) | letters()
    table: dict[str, str] = {}
    for ch in _mapped_ranges():
        if (to := unicodedata.normalize("NFC", _target(ch, listed))) != ch:
            table[ch] = to
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1:
            table[parts] = unicodedata.normalize("NFC", "".join(_target(p, listed) for p in parts))
    _check(table, listed)
    return table


def _check(table: dict[str, str], listed: dict[str, str]) -> None:
    spelled = Transducer(table)
    for ch in map(chr, range(0x20, 0x7F)):
        if ch in table:
            raise Conflict(f"ASCII {ch!r} is changed")
    for source, to in table.items():
        if spelled.spell(to) != to:
            raise Conflict(f"{source!r} isn't brought to a fixed point")
        if not to and not all(map(_IS_HIDDEN.match, source)):
            raise Conflict(f"{source!r} vanishes")
    for source, to in listed.items():
        if not to.isalpha() or not source.isalpha() or (source.lower() != source.upper() and source.isupper() != to.isupper()):
            raise Conflict(f"{source!r} to {to!r} isn't a letter to a letter of its case")


class Transducer:
    """Walks texts by a compiled table."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.longest = max(map(len, table), default=1)
        self.known: dict[str, str] = {}

    def spell(self, cluster: str) -> str:
        """A cluster's target by the longest entries in it."""
        table, out, i, n = self.table, [], 0, len(cluster)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (to := table.get(cluster[i:j])) is not None:
                    out.append(to)
                    i = j
                    break
            else:
                out.append(cluster[i])
                i += 1
        return unicodedata.normalize("NFC", "".join(out))

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text if text is None or "\t" not in text else text.replace("\t", " ")
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for cluster in _CLUSTER.findall(text):
            to = known.get(cluster)
            if to is None:
                to = self.table.get(cluster)
                known[cluster] = to = self.spell(cluster) if to is None else to
            out.append(to)
        return "".join(out)


_tables: dict[str, object] = {}
_transducers: dict[int, Transducer] = {}


def visual_form(spark: SparkSession, text: str) -> Column:
    """A text column's form. The table, some 20,000 entries whatever the data, is compiled once a session and shared."""
    app = spark.sparkContext.applicationId
    if app not in _tables:
        _tables.clear()
        _tables[app] = spark.sparkContext.broadcast(compiled(published(spark)))
    shared = _tables[app]

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        table = shared.value
        if id(table) not in _transducers:
            _transducers.clear()
            _transducers[id(table)] = Transducer(table)
        form = _transducers[id(table)]
        return pd.Series([form(t) for t in texts], dtype=object)

    return run(text)


def _formed(paths: DataFrame) -> DataFrame:
    """(folder, path, form) of the distinct named paths, stored, so that texts are read and walked once however often this is."""
    named = paths.where(F.col("folder").isNotNull() & F.col("path").isNotNull()).select("folder", "path").distinct()
    return materialise(named.select("folder", "path", visual_form(paths.sparkSession, "path").alias("form")), "forms")


def lookalike_pairs(paths: DataFrame) -> DataFrame:
    """(folder, path_a, path_b), path_a < path_b in byte order, of all different paths of a folder with one visual form.

    paths: (folder, path), repeated rows welcome. Null folder or path: no pair. Only forms that several paths share
    are joined, on (folder, form), so the work is the size of the result.
    """
    formed = _formed(paths)
    # a form is met again only if some path isn't equal to its form, so the members of each form are gathered by a count first
    grouped = formed.groupBy("folder", "form").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.count("*").alias("n")).where("n > 1")
    two = grouped.where("n = 2").select("folder", F.col("first").alias("path_a"), F.col("last").alias("path_b"))
    many = formed.join(grouped.where("n > 2").select("folder", "form"), ["folder", "form"], "left_semi")
    a = many.select("folder", "form", F.col("path").alias("path_a"))
    b = many.select("folder", "form", F.col("path").alias("path_b"))
    return two.unionByName(a.join(b, ["folder", "form"]).where("path_a < path_b").select("folder", "path_a", "path_b"))


def lookalike_classes(paths: DataFrame) -> DataFrame:
    """(folder, path, form, n_links): every path with its class, the visual form, and how many other paths of its folder share it."""
    formed = _formed(paths)
    sizes = formed.groupBy("folder", "form").agg((F.count("*") - 1).alias("n_links"))
    return formed.join(sizes, ["folder", "form"]).select("folder", "path", "form", "n_links")
