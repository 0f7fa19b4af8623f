"""Sentence boundaries across languages and scripts.

Candidates are all end marks of the spoken text (see ``subtitles``), with the closing quotation mark behind
them; marks within a quotation are none. Each candidate is classified by a maximum-entropy model: neighbouring
tokens, case, length, digits, script, kind of break, quotation and verbs of speech. A full stop whose blank was
lost, as in "the net.Lunfa left", is a candidate too; one within a number, between dotted letters (p.m., Ph.D.)
or in an advert's address is none. Two families of features
are fitted together, one with letter case and one without, the latter for texts all in capitals or small
letters. The training rows are the corpus's own reliable boundaries: candidates whose surroundings settle
them, as a small letter behind the mark in a text of mixed case, an initial before a name, a question mark
before a capital; what they don't settle is left to the model. About ``SAMPLE`` texts, chosen by the hash of their
id, each of at most ``SAMPLE_CHARS`` characters, give training rows; every text is then split.

Where speech has no marks (Thai, bare Chinese and Japanese) and where a speaker or an advert begins or ends,
the text itself stops a sentence; there the model isn't asked.

Defined results: null, empty and blank texts, and texts without spoken words, give no row. A last sentence
without an end mark ends with its last character. Repeated rows give repeated rows. Very long texts are
read once, quotations of any length, gaps of any width and single misread places among them. If no row is reliable (tiny tables), the built-in prior decides: a mark ends a sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .subtitles import CUE, LINE, STOP, Spoken, addresses

#: Texts that give training rows, and how long they may be.
SAMPLE, SAMPLE_CHARS = 1500, 30_000

# Abbreviations before a name, and before a number or name part; verbs that lead out of a quotation.
_TITLES = set(
    "mr mrs ms dr prof st sgt capt lt hr fr sr sra srta dra dña dn mm mme mlle mgr rev hon gen col maj sen gov frl им ул проф тов κ κα κος δρ καθ د م أ डॉ श्री रु ดร".split()
)
#: Before an ordinal number of a date.
_ORDINAL = set("am dem den vom zum beim im der die das bis seit ab".split())
_DATED = set("januar februar märz april mai juni juli august september oktober november dezember jh jahrhundert".split())
_COUNTED = set("no nr n.º n.o nº n.� p pp pág p�g pag vol fig cf s см стр кв гл т рис βλ σελ ca approx jan feb mar apr jun jul aug sep sept oct nov dec rs".split())
_VERBS = (
    "asked|said|shouted|cried|whispered|replied|fragte|sagte|rief|flüsterte|preguntó|dijo|gritó|susurró|demanda|demande|dit|cria|murmura|"
    "спросил|сказал|крикнул|прошептал|ответил|ρώτησε|είπε|φώναξε|سأل|قال|صاح|همس|पूछा|कहा|चिल्लाया|चिल्लाई|问道|说道|喊道|叫道|低声说"
)

_EVENT = re.compile("((?:\\.(?!(?<=[0-9]\\.)[0-9])|[!?…。！？｡．؟।॥;])(?:[.!?…。！？｡؟]|[\xa0\u202f ](?=[!?]))*)|([\"“”„«»「」『』])|(\x1d)")
_CLOSERS = {"“": "”\"", "„": "“”\"", "«": "»", "「": "」", "『": "』", '"': '"”'}
_BLANKS = " \t\r\n\x1e\xa0  　"
_GAP = re.compile(r"\s*")
_DOTTED = regex.compile(r"\p{L}\.")
#: What may stand before and behind a full stop without a blank.
_BEFORE = regex.compile(r"(?:[\p{L}\p{M}\p{N}]{1,3}|[)\]”»\"'’%€°])$")
_BEHIND = regex.compile(r"[“„«「『¿¡(]*(\p{L}[\p{L}\p{M}]*|\p{N}+)(\.?)")
_NINES = str.maketrans("012345678", "999999999")
_OPENING = regex.compile(r"([\"“”„«»「『¿¡(…'‘ ]*)([\p{L}\p{N}\p{M}_�]*(?:-\p{L}+)*)")
_WORD = re.compile(r"[^\W_]")
_CJK_WORD = re.compile("[\u0e01-\u0e5b\u3041-\u30ff\u3400-\u9fff]")
_GREEK = regex.compile(r"\p{Greek}")
_SPEECH = regex.compile(rf"[\s\x1e]*(?:[^.!?。！？।؟;\"“«「\x1d]{{0,60}}?(?<!\p{{L}}))?(?:{_VERBS})", regex.I)
_SAYS = regex.compile(rf"[\s\x1e]*(?:{_VERBS})(?!\p{{L}})", regex.I)
_SPEECH_CJK = regex.compile(r"[\s\x1e]*(?:と|[^.!?。！？।؟;\"“«「\x1d]*?(?:问道|说道|喊道|叫道|问|说|喊)[\s\x1e]*[。！？｡])")
_SPEECH_HINDI = regex.compile(r"[^.!?।\"“\x1d]*(?:\.[^.!?।\"“\x1d]*)?ने[\s\x1e]+(?:पूछा|कहा)")
_WIDE = set("。！？｡．")
_UNCASED = regex.compile(r"[\p{Lo}]")


def _quotes(text: str) -> tuple[list, list[tuple[int, int]]]:
    """Events of a text, and the spans of its quotations."""
    events = list(_EVENT.finditer(text))
    spans: list[tuple[int, int]] = []
    opened, closers = -1, ""
    for m in events:
        kind = m.lastindex
        if kind == 3:
            opened = -1
        elif kind == 2:
            q, i = m.group(), m.start()
            if opened >= 0 and q in closers:
                if q == '"' and i + 1 < len(text) and text[i + 1].isalnum() and text[i - 1] in _BLANKS:
                    opened = i  # opens again: the earlier one was a stray
                    continue
                spans.append((opened, i + 1))
                opened = -1
            elif q in _CLOSERS and (opened < 0 or q != '"'):
                if q == '"' and (i + 1 >= len(text) or text[i + 1] in _BLANKS or text[i + 1] in ".,!?"):
                    continue
                opened, closers = i, _CLOSERS[q]
    return events, spans


def _shape(word: str) -> str:
    if not word:
        return "-"
    c = word[0]
    if c.isdigit():
        return "z" if any(x.isalpha() for x in word) else "9"
    if c == "l" and (len(word) == 1 or word[1] in "bcdfghjkmnpqrstvwxz"):
        return "A"  # a capital I misread
    if c == "I" and len(word) > 1 and word[1] in "aeiou":
        return "a"  # a small l misread
    if c.isupper():
        return "A"
    return "a" if c.islower() else "o"


def _blank_lost(text: str, i: int, end: int) -> bool:
    """Whether the full stop at i, with no blank behind it, may end a sentence: not in 3.5, p.m., n.º, Ph.D. or c.-à-d."""
    before, behind = _BEFORE.search(text[max(0, i - 3) : i]), _BEHIND.match(text, end)
    if not before or not behind:
        return False
    run, (word, dot) = before.group(), behind.groups()
    if word[0].isnumeric():
        return len(run) == 3 and not any(map(str.isnumeric, run))
    if len(run) == 1 and run.isalpha():
        return len(word) > 1 and not dot
    return len(word) > 1 or not (run[-1].isnumeric() or (dot and len(run) < 3))


def contexts(spoken: Spoken) -> tuple[list[tuple[int, tuple]], list[int]]:
    """The text's candidates, each with all that its class may depend on, and its stops."""
    text, mixed = spoken.text, spoken.case == "mixed"
    events, spans = _quotes(text)
    hidden = addresses(text, spoken.adverts) if spoken.adverts else ()
    found: list[tuple[int, tuple]] = []
    stops: list[int] = []
    k = h = 0
    n_spans, n_hidden, size = len(spans), len(hidden), len(text)
    for e in events:
        kind = e.lastindex
        i = e.start()
        if kind == 3:
            stops.append(i)
            continue
        if kind == 2:
            continue
        mark, end, quoted = e.group(), e.end(), ""
        while k < n_spans and spans[k][1] <= i:
            k += 1
        while h < n_hidden and hidden[h][1] <= i:
            h += 1
        if h < n_hidden and hidden[h][0] <= i and end <= hidden[h][1]:
            continue
        if k < n_spans and spans[k][0] <= i:
            opened, close = spans[k][0], spans[k][1] - 1
            if text[end:close].strip(_BLANKS):
                continue
            end = close + 1
            quoted = "q"
            if _SAYS.match(text, end) or _SPEECH_CJK.match(text, end) or _SPEECH_HINDI.match(text, end):
                quoted = "qv"
            elif _SPEECH.match(text, end):
                quoted = "qw"  # a verb of speech later on
            if opened and text[opened - 1] in _BLANKS:
                ahead = text[max(0, opened - 8) : opened].rstrip(_BLANKS)[-1:]
                if ahead and ahead not in ".!?…。！？｡؟।;\x1d\"”»」":
                    quoted += "l"  # words lead into the quotation
        elif end < size and text[end] in "”»」』�\"" and not text[end + 1 : end + 2].isalnum():
            end += 1  # closes what was never opened
        if mark == "." and not quoted and end < size and not text[end].isspace() and not _blank_lost(text, i, end):
            continue
        left = text[i - 28 if i > 28 else 0 : i].split()
        next_word = _GAP.match(text, end).end()
        gap, rest = text[end:next_word], text[next_word : next_word + 40]
        if STOP in gap:
            continue  # the stop ends it
        ahead = rest.split(None, 2)
        follow = ahead[0][:14] if ahead else ""
        if len(ahead) > 1 and not any(map(str.isalnum, follow)):
            follow += " " + ahead[1][:14]
        br = "c" if CUE in gap else "l" if LINE in gap else "s" if gap else "0"
        prev = left[-1] if left else ""
        if len(prev) > 4 and prev.isalpha():
            found.append((end, (prev, "", mark, br, follow, quoted, mixed)))  # behind a whole word, what stands before it says little
        else:
            if not prev.isalpha():
                prev = prev.translate(_NINES)
            if follow[:1].isdigit():
                follow = follow.translate(_NINES)
            found.append((end, (prev, left[-2].translate(_NINES) if len(left) > 1 else "", mark, br, follow, quoted, mixed)))
    return found, stops


def describe(context: tuple, family: str) -> tuple[list[str], int | None] | None:
    """Features of the family with case ("C") or without ("P"), and the label where the surroundings settle it; None if no candidate."""
    prev, prev2, mark, br, follow, quoted, mixed = context
    opening, word = _OPENING.match(follow).groups()
    wide = mark[-1] in _WIDE
    if mark[0] == ";" and not _GREEK.search(prev):
        return None
    ahead = follow[:1]
    if ahead and ahead in ",;:،、，—–" and not (wide and ahead == "—"):
        return None
    if br == "0" and mark != "." and not wide and not quoted and word[:1].isdigit():
        return None
    if wide or (word and _UNCASED.match(word) and not word[0].isdigit() and len(word) > 4 and not word.isascii() and _CJK_WORD.match(word)):
        word = word[:3]
    prev = prev.strip("\"“”„«»「」『』¿¡()'‘’-")
    low, low2, nlow = prev.lower(), prev2.lower()[-8:], word.lower()[:12]
    kind = "..." if "..." in mark or "…" in mark else mark[-1]
    digit = prev[-1:].isdigit()
    size = str(min(len(prev), 5))
    # z. B., J. R.: another dotted letter follows; but not behind a dotted pair, as in p. m.
    short = len(word) == 1 and word.isalpha() and follow.endswith(word + ".") and not (_DOTTED.fullmatch(prev2) or prev2[-1:].isdigit() or "." in prev)
    lone = len(low) == 1 or (len(low) > 1 and low[-2] in ".-" and low[-1:].isalpha())
    ab = "t" if low in _TITLES else "n" if low in _COUNTED else "i" if lone and not digit else "d" if digit else "w"
    ns = _shape(word) if word else "-"
    unit = digit and prev.isdigit() and nlow in _DATED
    plain_next = "9" if ns == "9" else "o" if ns == "o" else "q" if opening else "-" if not word else "x"
    x, q6 = family, low[-6:]
    features = [
        x + "b", f"{x}m{kind}", f"{x}p{low[-10:]}", f"{x}n{nlow}", f"{x}mn{kind}{nlow}", f"{x}mp{kind}{low[-10:]}", f"{x}a{ab}{kind}", f"{x}an{ab}{plain_next}", f"{x}s{size}{kind}",
        f"{x}pn{q6}|{nlow}", f"{x}pp{low2}|{q6}", f"{x}br{br}", f"{x}o{opening[:1]}{kind}", f"{x}q{quoted}{kind}", f"{x}q{quoted}|{nlow}", f"{x}u{unit}{nlow in _DATED}", f"{x}h{short}{ab}{kind}", f"{x}o{prev2.lower() in _ORDINAL}{ab}",
    ]
    if x == "C":
        ps = _shape(prev)
        features += [f"S{ns}{kind}", f"S{ns}{ab}{ps}{size}", f"S{ns}p{low[-10:]}", f"S{ns}q{quoted}", f"So{ns}{opening[:1]}", f"S{ns}{ps}pp{low2}", f"Su{ns}{unit}"]
    return features, _reliable(kind, prev, prev2, ab, ns, quoted, opening, unit, short) if mixed or ns == "o" else None


def _reliable(kind: str, prev: str, prev2: str, ab: str, ns: str, quoted: str, opening: str, unit: bool, short: bool) -> int | None:
    """1 or 0 where the surroundings settle it, else None."""
    if ns == "a" and not opening:
        return 0
    if quoted:
        if ns == "o":
            return 0 if "v" in quoted else None if "l" in quoted else 1
        return 1 if ns == "A" or opening else None
    if kind in "?!。！？｡؟।;":
        return 1 if ns in "Ao9" or opening else None
    if kind == "...":
        return 1 if ns == "A" or opening else None
    if ab == "t" or unit:
        return 0
    if ab == "n":
        return 0 if ns == "9" else None
    if ab == "i":
        if ns == "9":
            return None
        if short:  # z. B., J. R.
            return 0
        return 0 if prev[-1:].isupper() else 1 if ns == "A" and prev[-1:].islower() else 0 if ns == "o" else None
    if ab == "d" and prev.isdigit() and len(prev) < 3 and ns == "A" and prev2.lower() in _ORDINAL:
        return None  # a number, or an ordinal before a noun
    return 1 if ns in "Ao" or opening else None


def fit(rows: list[tuple[list[str], int, int]], rounds: int = 80, l2: float = 0.5) -> dict[str, float]:
    """Weights of a maximum-entropy model of two classes over (features, class, how often); features seen once are left to the others."""
    seen: Counter[str] = Counter()
    for features, _, n in rows:
        for f in features:
            seen[f] += n
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    if not index:
        return {}
    get = index.get
    lists = [[i for f in features if (i := get(f)) is not None] for features, _, _ in rows]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
    of = np.array([i for x in lists for i in x])
    y = np.array([label for _, label, _ in rows], dtype=float)
    times = np.array([n for _, _, n in rows], dtype=float)
    w, grad2 = np.zeros(len(index)), np.full(len(index), 1e-6)
    for _ in range(rounds):  # adaptive gradient steps over all rows
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[of], len(rows)), -30, 30)))
        g = np.bincount(of, ((p - y) * times)[at], len(index)) + l2 * w
        grad2 += g * g
        w -= 0.7 * g / np.sqrt(grad2)
    return {f: float(w[i]) for f, i in index.items()}


#: Contexts whose class a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000


class Splitter:
    """A model with the classes of the contexts it has met."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[tuple, bool] = {}

    def _class_of(self, context: tuple) -> bool:
        described = describe(context, "C" if context[6] else "P")
        if described is None:
            return False
        if not self.weights:
            return True
        get = self.weights.get
        return sum([get(f, 0.0) for f in described[0]]) > 0

    def ends(self, stored: str) -> list[int]:
        """end_char of each sentence."""
        spoken = Spoken(stored)
        text = spoken.text
        found, stops = contexts(spoken)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        cuts = [(s, True) for s in stops]
        for end, context in found:
            good = known.get(context)
            if good is None:
                good = known[context] = self._class_of(context)
            if good:
                cuts.append((end, False))
        cuts.sort()
        out, begin = [], 0
        for cut, stop in cuts:
            part = text[begin:cut]
            if stop:
                part = part.rstrip(_BLANKS)
            if part[-2:-1].isalnum() or _WORD.search(part):
                out.append(spoken.end_of(begin + len(part)))
                begin = cut
            elif stop:
                begin = cut
        return out


_splitters: dict[int, Splitter] = {}


def _splitter(weights: dict[str, float]) -> Splitter:
    """The worker's splitter for this model, with all it has met in earlier tasks."""
    known = _splitters.get(id(weights))
    if known is None or known.weights is not weights:
        _splitters.clear()
        known = _splitters[id(weights)] = Splitter(weights)
    return known


def _titles(met: Counter) -> set[str]:
    """Short words whose full stop is never followed by a word that begins sentences: abbreviations before a name."""
    begins: Counter[str] = Counter()
    behind: dict[str, Counter[str]] = {}
    for (prev, _, mark, _, follow, quoted, mixed), n in met.items():
        if not mixed:
            continue
        word = follow.split(" ")[0]
        if mark[-1] in "?!" and not quoted:
            begins[word.lower()] += n
        elif mark == "." and not quoted and prev[:1].isalpha() and len(prev) < 6 and word[:1].isupper():
            behind.setdefault(prev.lower(), Counter())[word.lower()] += n
    known = {w for w, n in begins.items() if n > 1}
    return {w for w, after in behind.items() if after.total() >= 3 and len(after) <= max(2, after.total() // 3) and not known & after.keys()}


def learn(texts: list[str]) -> dict[str, float]:
    """The model of the reliable candidates of these texts."""
    met = Counter(context for t in texts for _, context in contexts(Spoken(t))[0])
    titles = _titles(met)
    rows = []
    for context, n in met.items():
        for family in "CP":
            described = describe(context, family)
            if described is not None and described[1] is not None:
                label = described[1]
                if context[0].lower() in titles and context[2] == "." and not context[5]:
                    label = 0
                rows.append((described[0], label, n))
    return fit(rows)


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> dict[str, float]:
    """Fit on about ``sample`` texts, those whose hashed id lies below a bound set by the number of rows; never more than twice as many."""
    total = documents.count()
    share = min(1 << 31, -(-sample * (1 << 31) // max(total, 1)))
    usable = documents.where((F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share) & F.length(text).between(1, SAMPLE_CHARS))
    return learn(sorted(r[0] for r in usable.select(text).limit(2 * sample).collect()))


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """(key, end_char long), one row per sentence."""
    model = train(documents, key, text) if weights is None else weights
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as the sample makes it, not the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(shared.value)
        for batch in batches:
            found = [splitter.ends(t) if t else [] for t in batch.column(1).to_pylist()]
            counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
            flat = np.fromiter((e for es in found for e in es), dtype=np.int64, count=int(counts.sum()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(flat)], names=[key, "end_char"])

    return spread(documents.select(key, text)).mapInArrow(run, f"{key} {dict(documents.dtypes)[key]}, end_char long")
