"""Problem 9: sentence units across languages and scripts.

The sentence-break rules of Unicode give the places where a sentence may end in any script: after
its marks (those that always end one, and the full stops that may) and what closes behind them,
format characters and combining marks apart, unless a number, a small letter, a mark or a sign of
continuation follows. On top of them: abbreviations of the text's language, initials, numbers and
names with points don't end a sentence unless it ends there too; quotations and brackets are
followed to their closing, and a sentence that goes on behind them isn't cut; lines are units in
lists, headings and Thai, and elsewhere a line break is a blank.

The languages of an abbreviation are those that the function words around it and of its paragraph
speak for, and the declared one; where none is known, all languages of the script count.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = "doc_id bigint, unit_no int, begin_char int, end_char int"

# Fixed values, by language: abbreviations, without their points, that a sentence goes on after.
GOES_ON = {
    "en": "dr drs mr mrs ms mx prof sr rev gov sgt capt lt vs cf viz e.g i.e ed eds b.c a.d",
    "de": "dr prof hr fr frau herr vgl bzw z.b z.t d.h u.a s.o s.u o.ä evtl ggf inkl exkl zzgl sog v.chr n.chr hrsg ed",
    "fr": "m mm mme mmes mlle mgr dr pr prof cf p.ex éd av ed",
    "es": "sr sra srta dr dra d prof véase cf p.ej ed eds a.c",
    "pt": "sr sra srta dr dra prof profa cf p.ex ed eds a.c",
    "ru": "см ср т.е т.к т.н н.э им проф акад доц напр",
    "hi": "डॉ श्री प्रो कु ई.पू",
    "th": "พ.ศ ค.ศ ร.ศ จ.ศ ดร นพ พญ ผศ รศ น.ส",
}
# Abbreviations before a number; a capital letter after them begins a sentence.
NUMBERED = {
    "en": "no nos nr num fig figs tab sec sect chap ch cap art abs vol vols pp pg eq approx ca circa ver vers max min",
    "de": "nr nrn num fig abb abs tab kap bd bde jh art vol eq ca circa ver vers max min",
    "fr": "no nos num fig figs tab sec chap ch art vol vols p pp eq env approx ver vers max min",
    "es": "núm num no fig figs tab sec cap caps pág págs pag pp art vol vols aprox ver vers max min",
    "pt": "núm num no fig figs tab sec cap caps pág págs pag pp art vol vols aprox ver vers max min",
    "ru": "рис гл табл стр ок тыс млн млрд",
    "hi": "पृ सं क्र",
}
# Abbreviations that stand inside a sentence or at its end.
MAY_END = {
    "en": "etc p.m a.m u.s u.k e.u d.c ph.d b.a m.a jr bros inc ltd co corp mb gb kb",
    "de": "usw etc mb gb kb co",
    "fr": "etc mo go ko",
    "es": "etc p.m a.m mb gb kb u.s e.u",
    "pt": "etc p.m a.m d.c mb gb kb",
    "ru": "др т.д т.п г гг в вв мб гб кб",
}
# Second words of abbreviations, which are words of their own elsewhere.
AFTER_FIRST = {"ex": "p", "ej": "p", "д": "т", "п": "т"}
# Frequent function words, which tell the language and, with a capital letter, begin a sentence.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as this they he she we but not are by from their then there when what which after before his her its if no so you at an",
    "de": "der die das und ist nicht ein eine zu den mit von für auf dem des im sich auch es er sie wir aber dann danach wenn als nach vor bei so was wer dies diese dieser jede jedes",
    "fr": "le la les des et est dans une un que qui pour pas sur au du ce cette il elle ils nous mais puis après avant avec sans ne se par plus en où",
    "es": "el la los las de y es en una un que para no por con se su lo al del este esta él ella ellos pero luego después antes sin más como cuando si",
    "pt": "o a os as de e é em uma um que para não por com se seu ao do da no na este esta ele ela eles mas depois antes sem mais como quando já",
    "ru": "и в не на что он она они это как но потом по из с к у за от для мы вы я его её их был была было если когда так после все затем а",
}

# Months that follow the point of a day's number.
MONTHS = set("januar jänner februar feber märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())
#: What goes on after a Japanese quotation or bracket.
PARTICLES = "と、っ，"
#: The language of scripts that one language of the lists is written in.
SCRIPTS = {"ru": r"[Ѐ-ӿ]", "hi": r"[ऀ-ॿ]", "th": r"[฀-๿]"}
LATIN = ("en", "de", "fr", "es", "pt")

BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
ENTRY = re.compile(r"[^\S\n]*(?:- |\d+\. )")
THAI = re.compile(r"[฀-๿]")
THAI_BLANK = re.compile(r"(?<=[฀-๿])[^\S\n]+(?=[฀-๿])")
THAI_SHORT = re.compile(r"(?:[พครจ]\.ศ|น\.ส|[กม]\.[คพมยส])\Z")
LINE_END = re.compile(r"[^\S\n]*\n\s*")
LETTER, WORD = re.compile(r"\w"), re.compile(r"\w+")
#: What may stand around words without belonging to them: invisible characters and emphasis.
UNSEEN = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff*_"
SKIP = re.compile(rf"[{UNSEEN} \t\n\r\xa0\u2002-\u200a\u202f\u3000]*")
TOKEN_EDGE = re.compile(r"[\s“„«\"(\[（「『»”:;,，、。！？]")


@cache
def characters() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@cache
def having(value: str) -> frozenset[str]:
    """All characters with a value of the sentence-break property."""
    return frozenset(regex.findall(rf"\p{{SB={value}}}", characters()))


def _class(chars) -> str:
    codes, out, i = sorted(map(ord, chars)), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def closing() -> tuple[str, str]:
    """Opening and closing signs: the property joins them, the general category tells them apart."""
    close = having("Close")
    return "".join(sorted(c for c in close if unicodedata.category(c) in ("Ps", "Pi") and c != "”")), "".join(sorted(c for c in close if unicodedata.category(c) in ("Pe", "Pf")))


@cache
def continuing() -> frozenset[str]:
    """Signs that a sentence goes on with."""
    return having("SContinue") | frozenset(";；")


@cache
def marks() -> tuple[re.Pattern, frozenset[str], frozenset[str]]:
    """The pattern of a possible end, the marks that always end, and the full stops.

    The pattern takes marks, then what closes behind them, in French after a blank.
    """
    always, stops = having("STerm"), having("ATerm")
    opening, close = closing()
    a, s, both = _class(always), _class(stops), _class(always | stops | frozenset("…⋯"))
    # Marks and format characters that belong to the one before (the rules' Extend and Format) are passed over.
    apart = _class(c for c in having("Extend") | having("Format") if c < "\u0300" or "\u0300" <= c <= "\u036f" or "\u200b" <= c <= "\u206f" or c in "\ufeff\ufe0e\ufe0f")
    closers = rf"[\"'‘’{_class(close)}*_]"
    ahead = rf"[{a}…⋯]|[{s}](?=[{both}]|{closers}*(?:\s|\Z|[{_class(opening)}]|[{apart}]))"
    return re.compile(rf"(?:{ahead})[{both}]*(?:{closers}|“(?=[\s,.]|\Z)|[ \xa0\u202f](?=»)|[{apart}])*"), always, stops


MATCH = dict(zip("「『（([【《〈‹〔｢«", "」』）)]】》〉›〕｣»"))
OPENED = {v: k for k, v in MATCH.items()} | {"”": "“„"}
BRACKET = re.compile("[" + re.escape("“”„\"" + "".join(MATCH) + "".join(MATCH.values())) + "]")


def enclosed(text: str) -> list[tuple[int, int]]:
    """Begin and end of each quotation and bracket that is opened and closed in the paragraph, outermost only, in order."""
    stack: list[tuple[str, int]] = []
    waiting: Counter[str] = Counter()
    spans: list[tuple[int, int]] = []

    def close(kinds: str, at: int) -> None:
        if not any(waiting[k] for k in kinds):
            return
        while True:
            kind, begin = stack.pop()
            waiting[kind] -= 1
            if kind in kinds:
                break
        while spans and spans[-1][0] > begin:
            spans.pop()
        spans.append((begin, at))

    for m in BRACKET.finditer(text):
        c, at = m[0], m.start()
        if c == "“" and waiting["„"]:
            close("„", at)
        elif c == '"' and waiting['"']:
            close('"', at)
        elif c in OPENED:
            close(OPENED[c], at)
        else:
            stack.append((c, at))
            waiting[c] += 1
    return spans


@cache
def listed(kind: str, langs: tuple[str, ...]) -> frozenset[str]:
    lists = {"goes on": GOES_ON, "numbered": NUMBERED, "may end": MAY_END, "function": FUNCTION_WORDS}[kind]
    return frozenset(w for k in langs for w in lists.get(k, "").split())


@cache
def languages_of() -> dict[str, tuple[str, ...]]:
    """The Latin languages of each function word."""
    out: dict[str, tuple[str, ...]] = {}
    for lang in LATIN:
        for w in FUNCTION_WORDS[lang].split():
            out[w] = (*out.get(w, ()), lang)
    return out


def spoken(text: str, begin: int, end: int) -> frozenset[str]:
    """The languages that the function words of a part of the text speak for."""
    known, hits = languages_of(), Counter()
    for w in WORD.findall(text[begin:end].casefold()):
        hits.update(known.get(w, ()))
    best = max(hits.values(), default=0)
    return frozenset(k for k, n in hits.items() if 2 * n >= best)


class Language:
    """The languages at a place of a text."""

    def __init__(self, text: str, declared: str | None):
        self.text, self.declared = text, frozenset({declared} & set(LATIN))
        self.known: dict[tuple[int, int], frozenset[str]] = {}

    def spoken(self, begin: int, end: int) -> frozenset[str]:
        if (begin, end) not in self.known:
            self.known[begin, end] = spoken(self.text, begin, end)
        return self.known[begin, end]

    def at(self, token: str, place: int, begin: int, end: int) -> tuple[str, ...]:
        """Those that may be meant by a word of the paragraph begin-end: of the words around it, of the paragraph, the declared one; all of the script if there is none."""
        for lang, letters in SCRIPTS.items():
            if re.search(letters, token):
                return (lang,)
        if not re.search("[A-Za-zÀ-ɏ]", token):
            return ()
        block = place - place % AROUND  # neighbours share what is counted
        near = self.spoken(max(begin, block - AROUND), min(end, block + 2 * AROUND))
        return tuple(sorted(near | self.spoken(begin, end) | self.declared)) or LATIN


#: Characters on each side of a block of as many whose function words tell its language.
AROUND = 100


def begins(text: str, at: int, langs: tuple[str, ...]) -> bool:
    """Whether a function word with a capital letter begins there, and no abbreviation or initial."""
    m = WORD.match(text, at)
    return bool(m) and m[0][0].isupper() and m[0].casefold() in listed("function", langs) and not text.startswith(".", m.end())


def token_before(text: str, at: int) -> int:
    """Where the word before a stop begins."""
    size = 40
    while True:
        low = max(0, at - size)
        edges = [m.end() for m in TOKEN_EDGE.finditer(text, low, at)]
        if edges or not low:
            return edges[-1] if edges else 0
        size *= 4


def stop_ends(text: str, at: int, after: int, begin: int, end: int, language: Language) -> bool:
    """Whether the full stop at ``at`` ends a sentence of the paragraph begin-end; after: where its closing signs and blanks end."""
    if after >= end:
        return True
    start = max(begin, token_before(text, at))
    token = unicodedata.normalize("NFKC", text[start:at]).strip("\u200b\u200c\u200d\u200e\u200f\u2060\ufeff*_\xad'’¿¡-–—")
    if token.startswith("<"):
        token = re.sub(r"<[^>]*>", "", token)
    low = token.casefold()
    nxt = text[after]
    lower = nxt.islower() or nxt in continuing()
    if not low:
        return not lower
    if token.isdigit():
        word = WORD.match(text, after, end)
        return not (word and word[0].casefold() in MONTHS and len(token) <= 2)
    langs = language.at(token, at, begin, end)
    first = AFTER_FIRST.get(low)
    pair = first is not None and re.search(rf"(?<!\w){first}\.\s*\Z", text[max(begin, start - 12) : start].casefold()) is not None
    # One letter is a unit only in small letters and behind a number; else it is an initial or a place.
    unit = len(low) > 1 or (token == low and re.search(r"\d\s*\Z", text[max(begin, start - 4) : start]) is not None)
    if unit and low in listed("may end", langs) or (pair and langs == ("ru",)):
        if lower or nxt.isdigit():
            return False
        word = WORD.match(text, after, end)
        shout = nxt.isupper() and token.isupper() and word is not None and len(word[0]) > 1 and word[0].isupper()
        return not (shout and low in ("p.m", "a.m"))
    if low in listed("goes on", langs) or pair or THAI_SHORT.search(low):
        # A word that is also an abbreviation ends a sentence before one that begins another.
        return low.isalpha() and begins(text, after, langs) and not lower
    if low in listed("numbered", langs):
        return not lower and not nxt.isdigit()
    if len(token) == 1 and token.isalpha() and unicodedata.category(token) != "Lo":
        return begins(text, after, langs)
    return not ("." in token and re.fullmatch(r"(?:\w\w?\.)+\w\w?", token) and not token[0].isdigit())


def ends(text: str, begin: int, end: int, language: Language) -> list[int]:
    """Where units end in the paragraph from begin to end (offsets behind their closing signs), but for its own end."""
    pattern, always, _ = marks()
    opening = closing()[0]
    joiners = continuing()
    spans: list[tuple[int, int]] | None = None
    starts: list[int] = []

    def within(at: int) -> tuple[int, int] | None:
        nonlocal spans, starts
        if spans is None:
            spans = [(a + begin, b + begin) for a, b in enclosed(text[begin:end])]
            starts = [a for a, _ in spans]
        k = bisect_left(starts, at) - 1
        return spans[k] if k >= 0 and at < spans[k][1] else None

    out: list[int] = []
    for m in pattern.finditer(text, begin, end):
        at, stop = m.start(), m.end()
        while stop > at and text[stop - 1] in UNSEEN:
            stop -= 1
        following = m.end()
        after = SKIP.match(text, following, end).end()
        raw = text[following] if following < end else ""
        nxt = text[after] if after < end else ""
        first = FIRST.match(m[0])[0]
        around = within(at)
        hard = any(c in always for c in first)
        dots = not hard and (len(first) > 1 or first[0] in "…⋯")
        if around:
            closed = around[1]
            if closed >= following:
                continue  # the quotation or bracket goes on
            if not nxt:
                out.append(stop)
                continue
            if nxt.islower() or nxt in joiners:
                continue
            if text[closed] in "」』）" and nxt in PARTICLES and not raw.isspace():
                continue
            if not hard and not dots and not stop_ends(text, at, after, begin, end, language):
                continue
            out.append(stop)
        elif dots:
            if not nxt or (raw.isspace() and (nxt.isupper() or nxt in opening or nxt in "¿¡")):
                out.append(stop)
        elif hard:
            if nxt and nxt in joiners and not (nxt in "-–—" and raw == "\n"):
                continue
            if first[-1] in "!?" and raw and not raw.isspace() and raw.isalnum() and not cjk(raw) and not cjk(text[at - 1 : at]):
                continue
            out.append(stop)
        elif not (raw and raw in joiners) and stop_ends(text, at, after, begin, end, language):
            out.append(stop)
    if THAI.search(text, begin, end):
        for m in THAI_BLANK.finditer(text, begin, end):
            if not within(m.start()):
                out.append(m.start())
        thai, last = [], 0
        known = sorted(set(out))
        for m in LINE_END.finditer(text, begin, end):
            while last < len(known) and known[last] <= m.start():
                last += 1
            since = max([known[last - 1] if last else begin, *thai[-1:]])
            ahead = LETTER.search(text, m.end(), end)
            if THAI.search(text, since, m.start()) or (ahead and THAI.match(ahead[0])):
                thai.append(m.start())
        out += thai
    return sorted(set(out))


FIRST = re.compile(r"[^\"'’”»」』）)\]】》〉›〕｣“\s]+")


def cjk(c: str) -> bool:
    return bool(c) and ("぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or "ｦ" <= c <= "ﾟ")


def units(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of each sentence unit, without the blanks around it. lang: the declared language, if any."""
    out: list[tuple[int, int]] = []
    language = Language(text, lang)

    def add(begin: int, end: int) -> None:
        piece = text[begin:end]
        n = len(piece.rstrip())
        if n:
            out.append((begin + len(piece) - len(piece.lstrip()), begin + n))

    def paragraph(begin: int, end: int) -> None:
        last = begin
        for e in ends(text, begin, end, language):
            add(last, e)
            last = e
        add(last, end)

    at = 0
    for gap in [*BLANK_LINE.finditer(text), None]:
        stop = gap.start() if gap else len(text)
        begin = line = at
        while line < stop:
            eol = text.find("\n", line, stop)
            eol = stop if eol < 0 else eol
            if ENTRY.match(text, line, eol):
                if begin < line:
                    paragraph(begin, line)
                add(line, eol)
                begin = eol + 1
            line = eol + 1
        if begin < stop:
            paragraph(begin, stop)
        at = gap.end() if gap else stop
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(doc, n, *u) for doc, text, lang in zip(*(c.to_pylist() for c in b.columns)) if text for n, u in enumerate(units(text, lang))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "unit_no", "begin_char", "end_char"])


def sentences(docs: DataFrame) -> DataFrame:
    """``doc_id, unit_no, begin_char, end_char`` of every sentence unit; offsets are code points, ends exclusive.

    docs: ``doc_id BIGINT, text STRING`` and, where it is there, ``lang STRING`` (null and wrong
    ones do little harm); other columns are ignored. A null, empty or blank text has no unit;
    repeated documents are split each.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(_units, UNITS)
