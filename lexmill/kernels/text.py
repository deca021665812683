"""Text kernels without Spark: UTF-8, longest-prefix rules, normalising with alignment, word splitting, piece shapes."""

from __future__ import annotations

import codecs
import csv
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

import regex

from ..spec import BOUNDARY, RARE, SPACE, NormalizerSpec, TrainerSpec, need

codecs.register_error("one_by_one", lambda e: ("�", e.start + 1))
MOST_SHARED = 32


def decode(raw: bytes) -> str:
    """UTF-8 text; each byte that isn't part of a valid character becomes U+FFFD."""
    return raw.decode("utf-8", "one_by_one")


def is_valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def byte_offsets(text: str) -> list[int]:
    """The byte offset of each character and of the end."""
    out, n = [0], 0
    for c in text:
        n += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        out.append(n)
    return out


def to_char_offsets(text: str, offsets: Iterable[int]) -> list[int]:
    """Character offsets of byte offsets; one inside a character counts for its beginning."""
    from bisect import bisect_right

    at = byte_offsets(text)
    return [bisect_right(at, n) - 1 for n in offsets]


def alternatives(strings: Iterable[str]) -> re.Pattern | None:
    """A pattern of the strings, the longest first."""
    found = sorted(set(filter(None, strings)), key=lambda s: (-len(s), s))
    return re.compile("|".join(map(re.escape, found)), re.S) if found else None


class PrefixMatcher:
    """Longest match out of a dictionary; without one, the next character."""

    def __init__(self, strings: Iterable[str]):
        self.pattern = alternatives(strings)

    def prefix(self, text: str) -> tuple[str, bool]:
        m = self.pattern.match(text) if self.pattern else None
        return (m[0], True) if m else (text[:1], False)

    def split(self, text: str) -> list[tuple[str, bool]]:
        """text in matches and single characters."""
        out, at = [], 0
        if self.pattern:
            for m in self.pattern.finditer(text):
                out += [(c, False) for c in text[at : m.start()]]
                out.append((m[0], True))
                at = m.end()
        return out + [(c, False) for c in text[at:]]

    def replace(self, text: str, by: str) -> str:
        return self.pattern.sub(lambda _: by, text) if self.pattern else text


# --- rules -----------------------------------------------------------------------------------

# Code points that count as blanks in the nmt rules, and those that are dropped.
NMT_BLANKS = (0x0009, 0x000A, 0x000C, 0x000D, 0x1680, 0x200B, 0x200C, 0x200E, 0x200F, 0x2028, 0x2029, 0x2581, 0xFEFF, 0xFFFD)
NMT_DROPPED = (*range(0x01, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, 0x8F, 0x9F)
NMT_KEPT = (0xFF5E,)


def assigned() -> Iterable[str]:
    return (chr(n) for n in range(1, sys.maxunicode + 1) if not 0xD800 <= n <= 0xDFFF)


@cache
def form_rules(form: str) -> dict[str, str]:
    """The rules of a normal form: every character it changes, and every decomposed spelling of one."""
    out: dict[str, str] = {}
    for c in assigned():
        if c.isascii() or "가" <= c <= "힣" or not (unicodedata.decomposition(c) or unicodedata.normalize(form, c) != c):
            continue
        target = unicodedata.normalize(form, c)
        for source in {c, unicodedata.normalize("NFD", c), unicodedata.normalize("NFKD", c) if "K" in form else c}:
            new = unicodedata.normalize(form, source)
            if new != source:
                out[source] = new if source != c else target
    if "K" in form:
        # Half- and full-width spellings of a letter and its mark compose as well.
        wide: dict[str, list[str]] = {}
        for c in map(chr, range(0xFF00, 0xFFF0)):
            wide.setdefault(unicodedata.normalize("NFKD", c), []).append(c)
        for c in assigned():
            parts = unicodedata.normalize("NFD", c)
            if len(parts) == 2 and not "가" <= c <= "힣" and (parts[0] in wide or parts[1] in wide):
                for a in [parts[0], *wide.get(parts[0], ())]:
                    for b in [parts[1], *wide.get(parts[1], ())]:
                        if (new := unicodedata.normalize(form, a + b)) != a + b:
                            out[a + b] = new
    return out


def simple_fold(text: str) -> str:
    """Case folding of one character to one."""
    return "".join(f if len(f := c.casefold()) == 1 else low if len(low := c.lower()) == 1 else c for c in text)


@cache
def named_rules(name: str) -> dict[str, str]:
    """Rules by name: identity, nfc, nfd, nfkc, nfkd, nmt_nfkc, and their forms ending in _cf."""
    if name == "identity":
        return {}
    base = name.removesuffix("_cf")
    need(base in ("nfc", "nfd", "nfkc", "nfkd", "nmt_nfkc"), f"unknown rules {name!r}")
    out = dict(form_rules(base.removeprefix("nmt_").upper()))
    if base.startswith("nmt_"):
        out |= {chr(n): " " for n in NMT_BLANKS} | {chr(n): "" for n in NMT_DROPPED}
        for n in NMT_KEPT:
            out.pop(chr(n), None)
    if name.endswith("_cf"):
        out = {s: simple_fold(t) for s, t in out.items()}
        for c in assigned():
            if c not in out and (f := simple_fold(c)) != c:
                out[c] = f
    return out


def checked_rules(rules: dict[str, str]) -> dict[str, str]:
    for source, target in rules.items():
        need(source, "a rule without source")
        need(source != target, f"rule {source!r} changes nothing")
    longest = sorted(rules)
    for i, source in enumerate(longest):
        shared = sum(source.startswith(source[:n]) and source[:n] in rules for n in range(1, len(source)))
        need(shared < MOST_SHARED, f"too many rules begin {source!r}")
    return rules


def without_redundant(rules: dict[str, str]) -> dict[str, str]:
    """rules without those of several characters that the rest yields too."""
    out = dict(rules)
    for source in sorted(rules, key=len):
        if len(source) > 1:
            rest = {s: t for s, t in out.items() if len(s) < len(source)}
            if Rules(rest).apply(source) == rules[source]:
                del out[source]
    return out


def read_rules(lines: Iterable[str]) -> dict[str, str]:
    """Rules of lines of hexadecimal code points: sources, TAB, targets, and maybe a TAB and a comment."""
    out = {}
    for line in lines:
        if not line.strip():
            continue
        fields = line.rstrip("\r\n").split("\t")
        need(len(fields) >= 1 and fields[0].strip(), f"a rule without source: {line!r}")
        points = [["".join(chr(int(x.upper().removeprefix("U+"), 16)) for x in f.split())] for f in fields[:2]]
        out[points[0][0]] = points[1][0] if len(points) > 1 else ""
    return out


def write_rules(rules: dict[str, str]) -> list[str]:
    spelled = lambda s: " ".join(f"{ord(c):X}" for c in s)
    return [f"{spelled(s)}\t{spelled(t)}\t# {s} => {t}" for s, t in sorted(rules.items())]


def csv_fields(line: str) -> list[str]:
    return next(csv.reader([line]), [""])


class Rules:
    """Longest-match rules over a text."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules
        first: dict[str, list[str]] = {}
        for s in rules:
            first.setdefault(s[0], []).append(s)
        self.several = {c: sorted(ss, key=len, reverse=True) for c, ss in first.items() if any(len(s) > 1 for s in ss)}
        self.used = frozenset(first)
        self.letters = None if len(first) > 4000 else re.compile("[" + "".join(map(re.escape, sorted(first))) + "]") if first else None

    def touches(self, text: str) -> bool:
        if not self.rules:
            return False
        return bool(self.letters.search(text)) if self.letters else not self.used.isdisjoint(text)

    def at(self, text: str, i: int) -> tuple[int, str]:
        """How much of text from i the longest rule takes, and what it becomes."""
        c = text[i]
        for s in self.several.get(c, ()):
            if text.startswith(s, i):
                return len(s), self.rules[s]
        return 1, self.rules.get(c, c)

    def apply(self, text: str) -> str:
        if not self.touches(text):
            return text
        out, i = [], 0
        while i < len(text):
            n, t = self.at(text, i)
            out.append(t)
            i += n
        return "".join(out)


class Normalizer:
    """Brings text to its normal form.

    Text of blanks only becomes empty, without a dummy blank; user-defined symbols (the longest
    first) pass unchanged.
    """

    def __init__(self, spec: NormalizerSpec = NormalizerSpec(), symbols: Iterable[str] = ()):
        self.spec = spec
        self.rules = Rules(checked_rules(dict(spec.rules)) if spec.rules is not None else named_rules(spec.name))
        self.symbols = alternatives(symbols)

    def mapped(self, text: str) -> str:
        if not self.symbols:
            return self.rules.apply(text)
        out, at = [], 0
        for m in self.symbols.finditer(text):
            out += [self.rules.apply(text[at : m.start()]), m[0]]
            at = m.end()
        return "".join(out) + self.rules.apply(text[at:])

    def __call__(self, text: str) -> str:
        text, s = self.mapped(text), self.spec
        if s.remove_extra_whitespaces:
            text = text.strip(" ")
            if "  " in text:
                text = re.sub(" +", " ", text)
        if not text:
            return ""
        if s.add_dummy_prefix:
            text = text + " " if s.suffix else " " + text
        return text.replace(" ", SPACE) if s.escape_whitespaces else text

    def aligned(self, text: str) -> tuple[str, list[int]]:
        """The normal form, and for each of its bytes and its end the byte offset in text it comes from."""
        s, at = self.spec, byte_offsets(text)
        parts: list[tuple[str, int]] = []  # a character of the normal form and where it comes from
        i = 0
        while i < len(text):
            m = self.symbols.match(text, i) if self.symbols else None
            n, target = (len(m[0]), m[0]) if m else self.rules.at(text, i)
            parts += [(c, at[i]) for c in target]
            i += n
        end = at[-1]
        if s.remove_extra_whitespaces:
            while parts and parts[0][0] == " ":
                parts.pop(0)
            while parts and parts[-1][0] == " ":
                end = parts.pop()[1]
            parts = [p for k, p in enumerate(parts) if p[0] != " " or parts[k - 1][0] != " "]
        if not parts:
            return "", [end]
        if s.add_dummy_prefix:
            parts = [*parts, (" ", end)] if s.suffix else [(" ", parts[0][1]), *parts]
        out, origin = [], []
        for c, begin in parts:
            c = SPACE if c == " " and s.escape_whitespaces else c
            out.append(c)
            origin += [begin] * len(c.encode("utf-8", "surrogatepass"))
        return "".join(out), [*origin, end]


# --- words and shapes -------------------------------------------------------------------------


def split_words(text: str, suffix: bool = False, whitespace_only: bool = False, interval: bool = False, barline: bool = False) -> list[str]:
    """Words of an escaped text: each begins with the space sign, or ends with it.

    interval and barline split only before a space sign with a digit from 1 or a slash, or a bar, after it.
    """
    if not text:
        return []
    if interval or barline:
        after = ("/1-9" if interval else "") + ("|" if barline else "")
        return [w for w in re.split(f"(?={SPACE}[{re.escape(after) if not interval else after}])", text) if w]
    if suffix:
        return [w for w in re.split(f"(?<={SPACE})(?!{SPACE})" if whitespace_only else f"(?<={SPACE})", text) if w]
    return [w for w in re.split(f"(?<!{SPACE})(?={SPACE})" if whitespace_only else f"(?={SPACE})", text) if w]


@cache
def script(c: str) -> str:
    """The script of a character; kana and their length mark count as Han, as pieces may mix them."""
    if c == "ー":
        return "Han"
    for name in SCRIPTS:
        if _script(name).match(c):
            return "Han" if name in ("Hiragana", "Katakana") else name
    return "Common"


# Names of scripts in the Unicode character database, the most frequent ones first.
SCRIPTS = """Latin Cyrillic Greek Han Hiragana Katakana Thai Devanagari Arabic Hebrew Hangul Common Inherited Armenian Georgian Bengali Tamil Telugu Kannada
Malayalam Gujarati Gurmukhi Oriya Sinhala Khmer Lao Myanmar Tibetan Ethiopic Mongolian Cherokee Bopomofo Yi Syriac Thaana Coptic
Adlam Ahom Anatolian_Hieroglyphs Avestan Balinese Bamum Bassa_Vah Batak Bhaiksuki Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Caucasian_Albanian
Chakma Cham Chorasmian Cuneiform Cypriot Cypro_Minoan Deseret Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Glagolitic Gothic Grantha
Gunjala_Gondi Hanifi_Rohingya Hanunoo Hatran Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi Kawi Kayah_Li Kharoshthi
Khitan_Small_Script Khojki Khudawadi Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Mahajani Makasar Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin
Meetei_Mayek Mende_Kikakui Meroitic_Cursive Meroitic_Hieroglyphs Miao Modi Mro Multani Nabataean Nag_Mundari Nandinagari New_Tai_Lue Newa Nko Nushu
Nyiakeng_Puachue_Hmong Ogham Ol_Chiki Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Old_Uyghur
Osage Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting
Sogdian Sora_Sompeng Soyombo Sundanese Syloti_Nagri Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tangsa Tangut Tifinagh Tirhuta Toto Ugaritic Vai
Vithkuqi Wancho Warang_Citi Yezidi Zanabazar_Square""".split()


@cache
def _script(name: str):
    return regex.compile(rf"\p{{Script={name}}}")


DIGIT = re.compile("[0-9０-９]")


def valid_piece(piece: str, spec: TrainerSpec = TrainerSpec()) -> bool:
    """Whether a string may be a learnt piece under the options."""
    if not piece or len(piece) > spec.max_piece_length or any(c in piece for c in (RARE, "\0", BOUNDARY, " ")):
        return False
    n = len(piece)
    blank_only = spec.allow_whitespace_only and not piece.strip(SPACE)
    if SPACE in piece and not blank_only:
        if spec.whitespace_as_suffix:
            own = piece[:-1] if spec.split_by_whitespace else piece[:1]
        else:
            own = piece[1:] if spec.split_by_whitespace else piece[-1:] if n > 1 else ""
        if SPACE in own and not (not spec.split_by_whitespace and n == 1):
            return False
    last = None
    for c in piece:
        digit = DIGIT.match(c) is not None
        if spec.split_digits and digit and n > 1:
            return False
        if not spec.split_by_script or c == SPACE:
            continue
        if digit and not spec.split_by_number:
            continue
        now = script(c)
        now = last if now == "Inherited" and last else "Digit" if digit and spec.split_by_number else now
        if last is not None and now != last:
            return False
        last = now
    return True
