"""The spoken text of a subtitle file, with the way back to its characters.

Cue numbers, time lines, tags, speaker labels, dashes, sound descriptions and sung lines are left out.
What is left is one string in which ``LINE`` and ``CUE`` stand for breaks that speech runs across, and
``STOP`` for places that no sentence crosses: where another speaker begins and at both ends of an advert.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import regex

LINE, CUE, STOP = "\n", "\x1e", "\x1d"

#: A time line, with the cue's number if that stands alone on the line before.
_TIME = re.compile(r"^(?:[ \t\ufeff]*\d+[ \t\r]*\n)?[ \t\ufeff]*\d+:\d+:\d+[^\n]{0,8}-->[^\n]*", re.M)
_TAG = r"<[^<>\n]*>|\{[^{}\n]*\}"
_ADDRESS_DOT = r"(?:\[dot\]|\(dot\))"
_SOUND = rf"(?!{_ADDRESS_DOT})(?:\[[^\[\]]*\]|\([^()]*\)|（[^（）]*）|［[^［］]*］|【[^【】]*】|〔[^〔〕]*〕|\*[^*\n]*\*)"
_OUT = regex.compile(rf"{_TAG}|{_SOUND}", regex.I)
_QUICK = re.compile(r"[<{\[(（［【〔*♪♫]")
_NOTE = regex.compile(r"[♪♫]")
_DASH = regex.compile(r"[\s﻿]*[-‐‑–]+(?=[\s\p{L}\p{N}\"“”„«»「『¿¡…]|$)\s*")
#: Another speaker within a line, and a dash that no words follow.
_TURN = re.compile(r"(?<=[.!?…。！？؟।\"”»」])[^\S\n]+[-‐‑–](?:[^\S\n]+|$)")
_LONE_DASH = re.compile(r"[^\S\n][-‐‑–][^\S\n]*$")
_LABEL = regex.compile(r"\s*(?:\p{Lu}[\p{L}'’]*\.?|\p{Lu}\.)(?: (?:\p{Lu}[\p{L}'’]*\.?|\d+)){0,2} ?:(?=\s|$)")

# Reserved and common endings of host names, and how credits begin.
_HOSTS = "invalid|test|example|localhost|com|net|org|info|tv"
_CREDITS = "subt|sous-titr|untertitel|субтитр|υπότιτλ|υποτιτλ|字幕|ترجمة|उपशीर्षक|คำบรรยาย|sync and |synced by|encoded by|ripped by|translated by|-= ?\\S"
#: An address by its form: behind a protocol, www or an at sign, with its dots spelled out, or with blanks around several dots.
_LABELS = r"[\p{L}\p{N}_-]+"
_SPELLED, _SPACED = rf"(?:\s?{_ADDRESS_DOT}\s?)", r"(?-i:(?<![\p{L}\p{N}_-])[a-z0-9_-]+(?: \. [a-z0-9_-]+){2,}(?![\p{L}\p{N}_-]))"
_BY_FORM = rf"(?:https?://|\bw ?w ?w ?\. ?|@){_LABELS}(?:(?:\.| \. |{_SPELLED}){_LABELS})*|{_LABELS}(?:{_SPELLED}{_LABELS})+|{_SPACED}"
_ADVERT = regex.compile(rf"[\p{{L}}\p{{N}}_-](?: ?\. ?|{_SPELLED})(?:{_HOSTS})\b|\bw ?w ?w ?\.|https?:|@{_LABELS}\.|{_LABELS}{_SPELLED}{_LABELS}|{_SPACED}|^[\s﻿-]*(?:{_CREDITS})", regex.I)
#: One of these is in every advert, in small letters.
_HOST_HINT = re.compile(rf"\. ?(?:{_HOSTS})")
_HINTS = ["dot]", "dot)", " . ", "www", "w w w", "http", "@", *(c.replace("\\S", "").rstrip("? ") for c in _CREDITS.split("|"))]
_ADDRESS = regex.compile(rf"(?:\bw ?w ?w ?\. ?)?[\p{{L}}\p{{N}}_@-]+(?:(?: ?\. ?|{_SPELLED}){_LABELS})*(?: ?\. ?|{_SPELLED})(?:{_HOSTS})\b|{_BY_FORM}", regex.I)

_THAI = re.compile("[\u0e01-\u0e5b]")
_CJK = re.compile("[\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
_CJK_MARK = re.compile("[。！？｡．]|(?<=[\u3041-\u30ff\u3400-\u9fff])[!?.]")
_FREE_BLANK = regex.compile(r"(?<![\p{Nd}\p{Latin}\s])[^\S\n]+(?![\p{Nd}\p{Latin}\s])")

_UTF8_LEAD = "ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóô"


def _continuations() -> dict[str, int]:
    """Characters that a byte 0x80-0xBF becomes when read as Windows-1252."""
    out = {}
    for b in range(0x80, 0xC0):
        out[chr(b)] = b
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            continue
    return out


_CONT = _continuations()
_TAIL = "".join(map(regex.escape, _CONT))
_MISREAD = regex.compile(rf"[Â-ß][{_TAIL}]|[à-ï][{_TAIL}]{{2}}|[ð-ô][{_TAIL}]{{3}}")
_MAYBE_MISREAD = re.compile(f"[\u00c2-\u00f4][{_TAIL}]")
_HIGH = re.compile("[À-ÿ]{4,}")  # no language writes so many of these letters together
_HIGH_LETTER = re.compile("[À-ÿ¨¸]")
_KOI = re.compile(r"[а-яё][А-ЯЁ]{2,}")
_CYRILLIC = re.compile("[А-яЁё]")


def _misread_by(runs: re.Pattern, letters: re.Pattern, text: str) -> bool:
    """Whether the telling runs hold at least a twentieth of these letters; a right text has next to none."""
    told = sum(len(r) for r in runs.findall(text))
    return told > 0 and told * 20 >= len(letters.findall(text))


def repair(text: str) -> tuple[str, list[int] | None]:
    """Undo a wrong encoding; with each character's end in the given text, or None if nothing was changed."""
    ends = None
    for _ in range(3):
        if not _MAYBE_MISREAD.search(text):
            break
        found = _MISREAD.findall(text)
        if not found or len(found) * 4 < sum(text.count(c) for c in _UTF8_LEAD):
            break
        out, back, at = [], [], 0
        for m in _MISREAD.finditer(text):
            group = m.group()
            try:
                ch = bytes([group[0].encode("latin-1")[0], *(_CONT[c] for c in group[1:])]).decode("utf-8")
            except (UnicodeDecodeError, UnicodeEncodeError):
                continue
            out.append(text[at : m.start()])
            back.extend(range(at + 1, m.start() + 1))
            out.append(ch)
            back.append(m.end())
            at = m.end()
        out.append(text[at:])
        back.extend(range(at + 1, len(text) + 1))
        text = "".join(out)
        ends = back if ends is None else [ends[b - 1] for b in back]
    if _misread_by(_HIGH, _HIGH_LETTER, text):  # Windows-1251 read as Windows-1252
        text = _HIGH_LETTER.sub(lambda m: m.group().encode("cp1252").decode("cp1251"), text)
    if _misread_by(_KOI, _CYRILLIC, text):  # KOI8-R read as Windows-1251 turns the case around
        turned = []
        for c in text:
            try:
                turned.append(c.encode("cp1251").decode("koi8-r") if c > "\x7f" else c)
            except (UnicodeDecodeError, UnicodeEncodeError):
                turned.append(c)
        text = "".join(turned)
    return text, ends


class Spoken:
    """text: the spoken string. end_of(i): the stored text's length up to the spoken character before i."""

    __slots__ = ("text", "at", "to", "ends", "case", "adverts")

    def __init__(self, stored: str):
        whole, self.ends = repair(stored) if not stored.isascii() else (stored, None)
        out: list[str] = []
        self.at: list[int] = []
        self.to: list[int] = []
        self.adverts: list[tuple[int, int]] = []
        size, first = 0, 0
        ascii_only = whole.isascii()
        bare = not ascii_only and _CJK.search(whole) is not None and not _CJK_MARK.search(whole)
        thai = not ascii_only and _THAI.search(whole) is not None
        by_lines = bare or thai
        hinted = _hinted(whole)
        signs = [m.start() for m in _QUICK.finditer(whole)]
        nth_hint = nth_sign = 0
        at, to = self.at, self.to

        for start, end in _cues(whole):
            cue = whole[start:end]
            while nth_sign < len(signs) and signs[nth_sign] < start:
                nth_sign += 1
            holes = _holes(cue) if nth_sign < len(signs) and signs[nth_sign] < end else ()
            while nth_hint < len(hinted) and hinted[nth_hint] < start:
                nth_hint += 1
            advert = nth_hint < len(hinted) and hinted[nth_hint] < end and _ADVERT.search(_plain(cue, holes)) is not None
            if advert:
                out.append(STOP)
                size += 1
                first = size
            pos = nth = 0
            for line in cue.split("\n"):
                stop = pos + len(line)
                dashes = " -" in line or " –" in line
                if holes or by_lines or dashes or not line or not line[0].isalnum() or (":" in line and not advert):
                    lo, turn = self._head(cue, pos, stop, holes, None if advert else _LABEL)
                    if turn and lo < stop:  # a dash before a sound is nobody's
                        out.append(STOP)
                        size += 1
                    free = by_lines and not advert and (_THAI if thai else _CJK).search(cue, lo, stop) is not None
                    while lo < stop:
                        while nth < len(holes) and holes[nth][1] <= lo:
                            nth += 1
                        hole = holes[nth] if nth < len(holes) else (stop, stop)
                        hi = min(stop, hole[0])
                        if hi > lo:
                            if free:
                                for m in _FREE_BLANK.finditer(cue, lo, hi):
                                    at.append(size)
                                    to.append(start + lo)
                                    out.append(cue[lo : m.start()])
                                    out.append(STOP)
                                    size += m.start() - lo + 1
                                    lo = m.end()
                            if dashes and not advert:
                                for m in _TURN.finditer(cue, lo, hi):
                                    at.append(size)
                                    to.append(start + lo)
                                    out.append(cue[lo : m.start()])
                                    out.append(STOP)
                                    size += m.start() - lo + 1
                                    lo = m.end()
                            kept = hi
                            if dashes and hi == hole[0] < stop and (m := _LONE_DASH.search(cue, lo, hi)):
                                kept = m.start()  # a dash before a sound
                            at.append(size)
                            to.append(start + lo)
                            out.append(cue[lo:kept])
                            size += kept - lo
                        lo = hi
                        if hole[0] <= lo < hole[1]:
                            lo = min(hole[1], stop)
                            out.append(" ")
                            size += 1
                    out.append(STOP if free else LINE)
                else:
                    at.append(size)
                    to.append(start + pos)
                    out.append(line)
                    out.append(LINE)
                    size += stop - pos
                size += 1
                pos = stop + 1
            if advert:
                self.adverts.append((first, size))
            out.append(STOP if advert else CUE)
            size += 1
        out.append(STOP)
        self.text = "".join(out)
        speech, at_end = [], 0
        for a, b in self.adverts:
            speech.append(self.text[at_end:a])
            at_end = b
        speech.append(self.text[at_end:])
        self.case = _case("".join(speech))

    @staticmethod
    def _head(cue: str, lo: int, stop: int, holes, label_of) -> tuple[int, bool]:
        """Where a line's words begin behind tags, sounds, a dash and a label, and whether a speaker begins there."""
        turn = False
        nth = 0
        while lo < stop:
            while nth < len(holes) and holes[nth][1] <= lo:
                nth += 1
            if nth < len(holes) and holes[nth][0] <= lo:
                lo = min(holes[nth][1], stop)
            elif cue[lo].isspace() or cue[lo] == "\ufeff":
                lo += 1
            elif cue[lo] in "-‐‑–" and not turn and (m := _DASH.match(cue, lo, stop)):
                lo, turn = m.end(), True
            elif label_of is not None and (m := label_of.match(cue, lo, stop)):
                return m.end(), True
            else:
                break
        return lo, turn

    def end_of(self, i: int) -> int:
        k = bisect_right(self.at, i - 1) - 1
        end = self.to[k] + i - self.at[k]
        return end if self.ends is None else self.ends[end - 1]


def _case(text: str) -> str:
    """"upper", "lower" or "mixed", by all letters of the text."""
    counts = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"))
    upper = lower = 0
    for code in counts.nonzero()[0].tolist():
        c = chr(code)
        upper += int(counts[code]) if c != c.lower() else 0
        lower += int(counts[code]) if c != c.upper() else 0
    if upper > 4 * lower:
        return "upper"
    return "lower" if upper * 100 < lower else "mixed"


def _hinted(text: str) -> list[int]:
    """Where an advert may be."""
    small = text.lower()
    if len(small) != len(text):
        small = "".join(low if len(low := c.lower()) == 1 else c for c in text)  # place for place
    out = [m.start() for m in _HOST_HINT.finditer(small)]
    for hint in _HINTS:
        p = small.find(hint)
        while p >= 0:
            out.append(p)
            p = small.find(hint, p + 1)
    out.sort()
    return out


def _cues(text: str) -> list[tuple[int, int]]:
    """Where each cue's text lies."""
    times = [m.span() for m in _TIME.finditer(text)]
    if not times:
        return [(m.start(), m.end()) for m in regex.finditer(r"\S(?:[^\n]|\n(?!\s*\n))*", text)]
    out = []
    start = 0
    for stop, after in [*times, (len(text), len(text))]:
        if stop > start:
            size = len(text[start:stop].rstrip())
            if size:
                out.append((start, start + size))
        start = after + 1
    return out


def _holes(cue: str) -> list[tuple[int, int]]:
    """Spans of tags, sounds and sung lines, sorted and joined."""
    spans = [m.span() for m in _OUT.finditer(cue)]
    if _NOTE.search(cue):
        pos = 0
        for line in cue.split("\n"):
            notes = [m.start() for m in _NOTE.finditer(line)]
            if notes:
                bare = _OUT.sub("", line).strip(" \r-")
                head, tail = bare[:1] in "♪♫", bare[-1:] in "♪♫"
                lo = 0 if head else notes[0]
                hi = len(line) if tail or len(notes) == 1 else notes[-1] + 1
                spans.append((pos + (0 if tail and len(notes) == 1 else lo), pos + hi))
            pos += len(line) + 1
    spans.sort()
    joined: list[tuple[int, int]] = []
    for a, b in spans:
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def _plain(cue: str, holes: list[tuple[int, int]]) -> str:
    if not holes:
        return cue
    out, at = [], 0
    for a, b in holes:
        out.append(cue[at:a])
        at = b
    out.append(cue[at:])
    return "".join(out)


def addresses(text: str, adverts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of addresses within adverts: their dots end nothing."""
    return [m.span() for a, b in adverts for m in _ADDRESS.finditer(text, a, b)]
