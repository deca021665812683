"""Problem 1: text that was decoded with the wrong character encoding.

Round-trip repair: a stretch is encoded again under the encoding it was probably read with and
decoded strictly as the encoding it was written in; that is repeated for nested layers, and a
repair is accepted when the garbling cost of the text drops. The cost counts what correctly
decoded text doesn't hold in any script: control characters, signs inside words, capitals after
small letters, words whose accented letters no one alphabet has, isolated letters that are no
word, Cyrillic with inverted case, uncommon ideographs side by side. A screen finds the few texts
with any of these.

The less a round trip can fail, the more it must show. UTF-8 fails on nearly all other bytes, so
its result need only be of one script. Other encodings of several bytes must give common letters
of one script besides. Between single-byte encodings nothing fails: there the text itself must
hold a sign or a capital between small letters, which no language has, and all such places of the
stretch must be gone afterwards.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPAIRS = "item_kind string, item_id bigint, garbled boolean, recovered boolean, encodings string, text string"
#: Encodings UTF-8 is read with by mistake, one byte a character.
READ_AS = ("cp1252", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "cp1254", "cp1253", "cp874")
#: Encodings of several bytes that UTF-8 is read with by mistake.
READ_AS_WIDE = ("gb18030", "cp932", "big5", "cp949")
#: Encodings whose bytes are read as Latin-1 or its Windows form by mistake.
WRITTEN_AS = ("gb18030", "euc_jp", "cp932", "cp874", "cp1251", "koi8_r", "big5", "cp949", "cp866", "iso8859_5")
CYRILLIC = ("koi8_r", "cp1251", "cp866", "iso8859_5", "mac_cyrillic")
#: Pairs (read as, written as) for single letters inside words of the Latin script.
SINGLE = (("latin-1", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("cp1257", "cp1252"), ("cp1255", "cp1252"), ("koi8_r", "cp1252"))

# Frequencies of the Russian letters in running text, in thousandths.
RUSSIAN = dict(zip("оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё", (110, 85, 80, 74, 67, 63, 55, 47, 45, 44, 35, 32, 30, 28, 26, 20, 19, 17, 17, 17, 16, 14, 12, 10, 9, 7, 6, 5, 4, 3, 3, 1, 1)))
WESTERN = "ÀÁÂÃÄÇÈÉÊËÍÎÏÑÓÔÕÖÙÚÛÜŒÆàáâãäçèéêëíîïñóôõöùúûüœæßŸÿ"
#: Signs that stand in clean text.
PLAIN_SIGNS = "‐‑‒–—―‘’‚“”„†•…‰‹›«»¿¡·°ºª§№€£©®™×−→¶′″ʼ"


# The letters beyond ASCII of alphabets of the Latin script, with those of their common loan words.
ALPHABETS = {
    "azerbaijani": "çəğıöşü", "basque": "çñü", "breton": "âêîôûàèéùñüö", "catalan": "àçéèíïóòúü", "croatian, bosnian, serbian, slovene": "čćđšžáéíóöüäàèìòùâêîôûȁȅȉȍȕ",
    "czech": "áčďéěíňóřšťúůýžöüäôľĺŕ", "danish, norwegian": "æøåéèêóòôàâáäöü", "dutch": "áàâäéèêëíïóòôöúùûüĳç", "esperanto": "ĉĝĥĵŝŭ", "estonian": "äöõüšžå",
    "faroese": "áðíóúýæø", "finnish": "äöåšžéü", "french": "àâæçéèêëîïôœùûüÿñ", "german": "äöüßéèàâêôç", "guarani": "ãẽĩõũỹñáéíóúý", "hawaiian, maori": "āēīōū", "hungarian": "áéíóöőúüűäë",
    "icelandic": "áðéíóúýþæö", "indic transcription": "āīūēōñśṃṁṅṭḍṇṣṛṝḷḥṟṉẏäöü", "irish": "áéíóúċḃḋḟġṁṗṡṫ", "italian": "àèéìíîïòóùúû", "kashubian": "ąãéëłńòóôùż", "kurdish": "çêîşûüöğı",
    "latvian": "āčēģīķļņōŗšūžéöü", "lithuanian": "ąčęėįšųūžàáãéèìíñòóõùúýỹ", "luxembourgish": "äëéöüâêîôûßèàç", "maltese": "ċġħżàèìòù", "pinyin": "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜüńňǹ",
    "polish": "ąćęłńóśźżéöüäçèàáëôšžč", "portuguese": "ãáàâçéêíõóôúüèñ", "romanian": "ăâîșțşţéàáäöüè", "sami": "áčđŋšŧžäöåæøâǩǧǥʒõ", "slovak": "áäčďéíĺľňóôŕšťúýžöüěřů", "sorbian": "čćěłńóřšžźŕ", "spanish": "áéíñóúüïçàèòãâêôõ",
    "swedish": "åäöéàáüèêëæø", "albanian": "çëáéíóúâêîô", "turkish": "çğıöşüâîûéáèêôäß", "turkmen": "äçňöşüýž", "vietnamese": "àáâãèéêìíòóôõùúýăđĩũơư", "welsh": "âêîôûŵŷäëïöüẅÿáéíóúýàèìòù", "wolof": "àãéëñóŋ", "yoruba, igbo": "áàéèẹíìóòọṣúùńǹāēīōūịụṅ",
}


def _class(chars) -> str:
    codes, out, i = sorted({ord(c) for c in chars}), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\u{codes[i]:04x}" + (f"-\\u{codes[j]:04x}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def table(encoding: str) -> dict[int, str]:
    """The character of each byte from 0x80; a byte without one is read as the control character of its number."""
    out = {}
    for n in range(0x80, 0x100):
        try:
            out[n] = bytes([n]).decode(encoding)
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


@cache
def back(encoding: str) -> dict[str, int]:
    """The byte of each character; control characters stand for their own byte where the encoding has none."""
    own = {c: n for n, c in table(encoding).items()}
    return {chr(n): n for n in range(0x80, 0xA0)} | {chr(n): n for n in range(0x80)} | own


@cache
def common_han() -> frozenset[str]:
    """The ideographs of the first levels of the Chinese and the Japanese national character sets."""
    cells = [bytes([a, b]) for a in range(0xB0, 0xD8) for b in range(0xA1, 0xFF)]
    kanji = [bytes([a, b]) for a in range(0xB0, 0xD0) for b in range(0xA1, 0xFF)]
    return frozenset("".join(x.decode("gb2312", "ignore") for x in cells) + "".join(x.decode("euc_jp", "ignore") for x in kanji))


@cache
def patterns() -> dict[str, re.Pattern]:
    han = "".join(c for n in [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)] if (c := chr(n)) not in common_han())
    latin = "A-Za-zÀ-ÖØ-öø-ÿŒœŸ"
    small = "a-zß-öø-ÿ"
    signs = "".join(
        chr(n) for n in [*range(0xA1, 0x100), *range(0x2B0, 0x2E0), 0x192, *range(0x2010, 0x2600)]
        if unicodedata.category(chr(n))[0] in "SPN" and n != 0x2581 or n in (0xAA, 0xBA, 0x192, 0x207F, 0x2C6, 0x2C7)
    )
    odd = _class(c for c in signs if c not in PLAIN_SIGNS)
    inner = _class(c for c in signs if c not in "’‘‐‑·-–—'′ʼ/…")
    letters = [chr(n) for n in [*range(0x370, 0x400), *range(0x402, 0x40F), *range(0x452, 0x460), 0x490, 0x491, *range(0x5D0, 0x5EB)]]
    strange = _class(c for c in letters if c not in "ЅІЈѕіј" + LOOKALIKE_GREEK)
    upper = _class(c for c in map(chr, range(0x100, 0x180)) if c.isupper())
    foreign = "\u3105-\u312f\u3200-\u32ff\ue000-\uf8ff"
    hangul, ideographs = "\uac00-\ud7a3", "\u3400-\u4dbf\u4e00-\u9fff"
    after_uppercase = _class(c for c in table("cp1252").values() if c not in WESTERN + "’”»…–—“‘«" and ord(c) > 0x9F and not c.isalpha()) + "ªºƒ"
    out = {
        "control": "[\x80-\x9f]",
        "lost": "�",
        "sign": f"[{odd}](?:(?<=[{latin}а-яА-ЯёЁ{odd}].)|(?=[{latin}]))",
        "inner": f"[{inner}](?<=[A-Z{small}].)(?=[{small}])",
        "pair": f"[{after_uppercase}](?:(?<=[ÂÃÐÑ].)|(?<![\xa0\xad])(?<=[ÅÄâãäåæçèéàïðñ].))",
        "capital": f"[À-ÖØ-ÞŒŠŽŸ{upper}](?<=[{small}].)",
        "accents": "[À-ÖØ-öø-ÿ¡-¿]{4,}",
        "alone": r"[ùûôòÿÖ](?<=\s.)(?=\s+\w{2})",
        "strange": f"[{strange}](?:(?<=[{latin}].)|(?=[{latin}]))",
        "dashes": "(?:[–—][^\x00-\x7f\\s‐-―]){3}",
        "foreign": f"[{foreign}]|[{hangul}](?:(?<=[{ideographs}].)|(?=[{ideographs}]))",
        "private": "[\ue000-\uf8ff]",
        "cyrillic": "[А-ЯЁ]{3,}",
        "han": f"(?:[{_class(han)}][^\n]{{0,3}}?){{6}}",
        "ideograph": f"[{_class(han)}]",
    }
    return {k: re.compile(v) for k, v in out.items()}


LOOKALIKE_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"
WEIGHTS = {"control": 2.0, "sign": 1.0, "inner": 1.5, "pair": 1.0, "capital": 1.0, "accents": 2.0, "alone": 1.0, "strange": 1.0, "dashes": 3.0, "foreign": 0.5}


SCREENS = ("control", "lost", "sign", "inner", "pair", "capital", "accents", "alone", "strange", "dashes", "foreign", "cyrillic", "han")


def suspicious(text: str) -> bool:
    """Whether a text has any sign of garbling. Each pattern begins with one class of characters, which is found fast."""
    p = patterns()
    return any(p[k].search(text) for k in SCREENS) or misfits(text) > 0


EXTENDED = re.compile("[\u0100-\u017f]")
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*[\u0100-\u017f][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]*")


@cache
def alphabets() -> tuple[frozenset[str], ...]:
    return tuple(frozenset(x) for x in ALPHABETS.values())


@lru_cache(1 << 16)
def misfit(word: str) -> int:
    """The letters from U+0100 of a word whose accented letters are not all of one alphabet, else 0."""
    own = {c for c in word.lower() if "\u00df" <= c <= "\u017f"}
    return 0 if any(own <= a for a in alphabets()) else len(EXTENDED.findall(word))


def misfits(text: str) -> int:
    return sum(misfit(m[0]) for m in WORD.finditer(text)) if EXTENDED.search(text) else 0


def unlike_russian(text: str) -> tuple[float, int]:
    """The mean negative log frequency of the letters as Russian ones, and how many letters there are."""
    letters = [c for c in text.casefold() if "а" <= c <= "ё"]
    return sum(-math.log(RUSSIAN.get(c, 0.5) / 1000) for c in letters) / max(1, len(letters)), len(letters)


def odd_cyrillic(text: str) -> float:
    """How much more the Cyrillic letters of a stretch cost than running Russian would."""
    mean, n = unlike_russian(text)
    return max(0.0, (mean - 3.15) * n) if n >= LEAST_CYRILLIC else 0.0


#: Letters from which on a stretch of Cyrillic can be judged, and the mean that running Russian doesn't exceed (it has 3.1).
LEAST_CYRILLIC, RUNNING = 6, 3.4


def rare_ideographs(text: str) -> float:
    """How many more uncommon ideographs than 0.3 of all stand side by side, over all places; what stands elsewhere in the text doesn't count."""
    places = [m.start() for m in patterns()["ideograph"].finditer(text)]
    if len(places) <= 3:
        return 0.0
    total = now = peak = 0.0
    count, last = 0, places[0]
    for at in places:
        between = text[last + 1 : at]
        now -= 0.3 * sum("㐀" <= c <= "鿿" for c in between)
        if now <= 0 or len(between) > APART or "\n" in between:
            total, now, peak, count = total + peak, 0.0, 0.0, 0
        now, count, last = now + 0.7, count + 1, at
        if count > 3:
            peak = max(peak, now)
    return total + peak


def cost(text: str) -> float:
    """The garbling cost: 0 for clean text."""
    p = patterns()
    total = sum(w * len(p[k].findall(text)) for k, w in WEIGHTS.items())
    for m in p["accents"].finditer(text):
        total += len(m[0]) / 2
    total += rare_ideographs(text) + misfits(text)
    if p["cyrillic"].search(text):
        total += sum(odd_cyrillic(s[0]) for s in CYRILLIC_STRETCH.finditer(text))
    return total


#: Characters between uncommon ideographs beyond which they aren't side by side.
APART = 12
CYRILLIC_STRETCH = re.compile(r"[А-Яа-яЁёЂ-Џђ-џҐґ][А-Яа-яЁёЂ-Џђ-џҐґ \-,]*")
HIGH = re.compile(r"[\x80-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™](?:[\x21-\xffŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]| (?=[\x80-\xff]))*")


@cache
def utf8_as(encoding: str) -> re.Pattern:
    """Characters that UTF-8 sequences of several bytes turn into under the encoding."""
    t = table(encoding)
    one = lambda a, b: "[" + _class(t[n] for n in range(a, b)) + "]"
    c = "[" + _class([*(t[n] for n in range(0x80, 0xC0)), *map(chr, range(0x80, 0xA0))]) + "]"
    return re.compile(f"(?:{one(0xC2, 0xE0)}{c}|{one(0xE0, 0xF0)}{c}{{2}}|{one(0xF0, 0xF5)}{c}{{3}})+")


def encoded(text: str, encoding: str) -> bytes | None:
    b = back(encoding)
    try:
        return bytes(b[c] for c in text)
    except KeyError:
        return None


#: Letters that may stand side by side though their scripts have different names.
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "BOPOMOFO": "CJK", "HANGUL": "CJK"}


@lru_cache(1 << 16)
def script(c: str) -> str:
    """The script of a letter or mark, '' for other characters, '?' where nothing is assigned."""
    kind = unicodedata.category(c)
    if kind in ("Cn", "Co", "Cs"):
        return "?"
    if kind[0] not in "LM" or not unicodedata.name(c, "") or "\uff00" <= c <= "\uffef":
        return ""
    name = unicodedata.name(c).split()[0]
    return "" if name in ("COMBINING", "MODIFIER", "VARIATION", "FEMININE", "MASCULINE", "MICRO") else TOGETHER.get(name, name)


@cache
def plain_result() -> re.Pattern:
    """What a few bytes may decode to: letters of the Latin alphabets and of scripts met often, and what another layer of garbling consists of."""
    tables = [c for e in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250") for c in table(e).values()]
    own = [c for a in ALPHABETS.values() for c in a + a.upper() if "\x7f" < c < "\u0180"]
    ranges = [*range(0x80, 0x100), *range(0x410, 0x450), 0x401, 0x451, *range(0x900, 0x980), *range(0xE01, 0xE5C), *range(0x2010, 0x2040), *range(0x3000, 0x3100), *range(0xFF01, 0xFFA0), 0x2116, 0x2212, 0x2581, 0x200B, 0xFEFF]
    return re.compile("[" + _class([*tables, *own, *map(chr, ranges), *map(chr, range(0x4E00, 0xA000))]) + "\\x00-\\x7f]*")


def scripts_of(text: str) -> set[str]:
    return {script(c) for c in set(text) if c > "\x9f"} - {""}


def one_script(text: str) -> bool:
    """Whether a decoded stretch may stand: plain_result, or a word of one script, without unassigned characters."""
    if plain_result().fullmatch(text):
        return True
    found = scripts_of(text)
    return len(found) == 1 and not found & {"?", "LATIN"} and sum(script(c) in found for c in text) >= LEAST_WORD


#: Letters of a script outside plain_result that a stretch must have to be taken for it.
LEAST_WORD = 4
#: The share of a text's characters from the upper half of an encoding that are whole UTF-8 sequences, if it was read with it.
WHOLE = 0.8


def utf8_again(text: str, encoding: str) -> str:
    """text with its UTF-8 sequences that were read as the encoding decoded."""
    found, letters, used = [], Counter(), 0
    for m in utf8_as(encoding).finditer(text):
        try:
            new = encoded(m[0], encoding).decode("utf-8")
        except UnicodeDecodeError:
            continue
        found.append((m.start(), m.end(), new))
        letters.update(script(c) for c in new if c > "\x9f")
        used += len(m[0])
    if not found:
        return text
    del letters[""]
    other = letters.keys() - {"LATIN"}
    own = upper_half(encoding)
    # One script from nearly all characters that can be bytes: no chance does that.
    whole = len(other) <= 1 and "?" not in other and letters.total() >= LEAST_WORD and used >= WHOLE * sum(c in own for c in text)
    # A few plain Cyrillic letters are evidence only beside others.
    weak = encoding in CYRILLIC and not any(b - a > 3 or not all("А" <= c <= "ё" for c in text[a:b]) for a, b, _ in found)
    out, last = [], 0
    for a, b, new in found:
        if whole or (not weak and one_script(new)):
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]])


@cache
def upper_half(encoding: str) -> frozenset[str]:
    return frozenset([*table(encoding).values(), *map(chr, range(0x80, 0xA0))])


def utf8_inside(text: str, encoding: str) -> str:
    """text with its stretches decoded that are whole characters both as read and in UTF-8; what stands around them stays."""
    raw, bounds, unread = bytearray(), {0: 0}, b"\xff"  # no byte of UTF-8
    for n, c in enumerate(text, 1):
        try:
            raw += c.encode(encoding)
        except UnicodeEncodeError:
            raw += unread
        bounds[len(raw)] = n
    out, done = [], 0
    for m in UTF8_WIDE.finditer(raw):
        begin = m.start()
        while begin < m.end() and begin not in bounds:
            begin += 3 if raw[begin] >= 0x80 else 1
        end, units, best = begin, 0, None
        while end < m.end():
            wide = raw[end] >= 0x80
            end += 3 if wide else 1
            units += wide
            if wide and units > 1 and end in bounds:
                best = end
        if best is None or bounds[begin] < done:
            continue
        new = raw[begin:best].decode("utf-8", "replace")
        if plausible(new) and one_script(new):
            out += [text[done : bounds[begin]], new]
            done = bounds[best]
    return "".join([*out, text[done:]])


#: UTF-8 of kana, ideographs and their punctuation, with ASCII between.
UTF8_WIDE = re.compile(rb"[\xe2-\xe9\xef][\x80-\xbf]{2}(?:[\xe2-\xe9\xef][\x80-\xbf]{2}|[\x00-\x7f])*")


def utf8_again_wide(text: str, encoding: str) -> str:
    """The same for encodings of several bytes; what was lost between stays as it is."""

    def fix(m: re.Match) -> str:
        try:
            raw = m[0].encode(encoding)
        except UnicodeEncodeError:
            return utf8_inside(m[0], encoding)
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            # A stretch cut or damaged at its ends is taken from its longest whole part.
            for begin in range(min(3, len(raw))):
                for end in range(len(raw), max(begin, len(raw) - 3), -1):
                    try:  # bytes that are left over are lost
                        return LOST * (begin > 0) + raw[begin:end].decode("utf-8") + LOST * (end < len(raw))
                    except UnicodeDecodeError:
                        continue
            return utf8_inside(m[0], encoding)

    return WIDE.sub(fix, text)


LOST = "\ufffd"
WIDE = re.compile(r"[^\x00-\xff‘’“”—–…]{2,}[^\n。]*?(?=[\n。�]|\Z)|[^\x00-\xff]{2,}")


def legacy_again(text: str, read: str, written: str) -> str:
    """Stretches of Latin-1 signs decoded as the encoding they were written in."""

    def fix(m: re.Match) -> str:
        for piece, rest in ((m[0], ""), (m[0].rstrip(ASCII_END), m[0][len(m[0].rstrip(ASCII_END)) :])):
            raw = encoded(piece, read)
            if raw is None:
                continue
            try:
                new = raw.decode(written)
            except UnicodeDecodeError:
                continue
            kana = sum("ぁ" <= c <= "ヿ" for c in new) * 10 > len(new)
            if written in ONE_BYTE and not ENOUGH.search(new):
                continue
            if written in ONE_BYTE and BESIDE_ASCII.search(text[max(0, m.start() - 1) : m.start()] + new + rest + text[m.end() : m.end() + 1]):
                continue
            if plausible(new) and kana == (written in ("euc_jp", "cp932")):
                return new + rest
        return m[0]

    return HIGH.sub(fix, text)


#: Encodings in which any byte is a character; their letters don't stand beside Latin ones.
ONE_BYTE = ("cp874", "cp1251", "koi8_r", "cp866", "iso8859_5")
ENOUGH = re.compile(r"(?:[^\W\x00-\xff][^\w\x00-\xff]*){%d}" % LEAST_WORD)
BESIDE_ASCII = re.compile(r"(?<=[A-Za-z])[^\W\x00-\xff]|[^\W\x00-\xff](?=[A-Za-z])")


def plausible(text: str) -> bool:
    """Whether most letters of a decoded stretch are common ones of one script or two."""
    letters = [c for c in text if ord(c) > 0x7F and c.isalpha()]
    odd = sum(c in "ｦｧｨｩｪｫｬｭｮｯｰ" or "ｱ" <= c <= "ﾟ" or "가" <= c <= "힣" or "" <= c <= "" or ("㐀" <= c <= "鿿" and c not in common_han()) for c in letters)
    kinds = {("han" if "\u3040" <= c <= "\u9fff" else "thai" if "\u0e00" <= c <= "\u0e7f" else "cyrillic" if "Ѐ" <= c <= "ԯ" else "other") for c in letters}
    return bool(letters) and odd <= 0.3 * len(letters) and len(kinds) == 1 and "other" not in kinds


ASCII_END = "".join(map(chr, range(0x21, 0x7F)))


@cache
def run_of(encoding: str) -> re.Pattern:
    own = "[" + _class(upper_half(encoding)) + "]"
    return re.compile(f"{own}(?:[ \\-,.0-9]*{own})*")


def cyrillic_again(text: str, read: str, written: str) -> str:
    """Runs decoded that become running Russian; short ones only beside a longer one."""

    def decoded(old: str) -> str | None:
        mean, n = unlike_russian(old)
        if n >= len(old.replace(" ", "")) / 2 and n < LEAST_CYRILLIC:
            return None
        raw = encoded(old, read)
        try:
            new = raw.decode(written) if raw else ""
        except UnicodeDecodeError:
            return None
        if unlike_russian(new)[0] > mean - BETTER and n >= LEAST_CYRILLIC:
            return None
        mean, n = unlike_russian(new)
        high = sum(c > "\x7f" for c in new)
        return new if n >= LEAST_CYRILLIC and n >= RUSSIAN_SHARE * high and mean < RUNNING and len(CAPITAL_INSIDE.findall(new)) * 9 < n else None

    runs = [(m.start(), m.end(), decoded(m[0])) for m in run_of(read).finditer(text)]
    if not any(new and unlike_russian(new)[1] >= SURE_CYRILLIC for _, _, new in runs):
        return text
    out, last = [], 0
    for a, b, new in runs:
        if new:
            out += [text[last:a], new]
            last = b
    return "".join([*out, text[last:]])


#: Letters of a run that is evidence by itself, the share of Russian letters among its characters beyond ASCII, and how much lower its mean must get.
SURE_CYRILLIC, RUSSIAN_SHARE, BETTER = 12, 0.85, 0.2
CAPITAL_INSIDE = re.compile("(?<=[а-яё])[А-ЯЁ]")


@cache
def single_map(read: str, written: str) -> dict[str, str]:
    """Characters that single bytes of one Latin encoding turn into under the other, with what was meant."""
    out = {}
    for n, c in table(read).items():
        try:
            meant = bytes([n]).decode(written)
        except UnicodeDecodeError:
            continue
        if meant != c and (meant in WESTERN or meant in "–—‘’“”„…«»¿¡" or read == "latin-1"):
            out[c] = meant
    return out


@cache
def certain() -> re.Pattern:
    """A control character, or a sign, foreign letter or capital between letters of one word where no language has that."""
    p = patterns()
    first = lambda k: p[k].pattern.split("](", 1)[0] + "]"
    capital, strange, sign = first("capital"), first("strange"), first("inner")[:-1] + "ﬁﬂ]"
    small, letter = "a-zß-öø-ÿ", "A-Za-zÀ-ÖØ-öø-ÿ"
    two, one = f"(?<=[{small}]{{2}}.)(?=[{small}])", f"(?<=[{small}].)(?=[{small}]{{2}})"
    return re.compile(
        f"[\x80-\x9f]|[\u2320-\u25ff](?<=[{letter}].)(?=[{letter}])|{strange}(?<=[{small}].)(?={strange}[{small}])|(?:{capital}|{strange})(?:{two}|{one})|{strange}(?<=[{letter}].)(?=[{small}]{{3}})|{capital}(?<=[{small}].)(?={sign}[{small}])"
        f"|{sign}(?:{two}|(?<=[{letter}].)(?=[{small}]{{2}})|(?<=[{letter}].)(?={sign}[{letter}]))"
    )


@cache
def shouted() -> tuple[re.Pattern, re.Pattern]:
    """A sign between capitals, or a lonely letter that is no word in a line of ASCII."""
    sign = patterns()["inner"].pattern.split("](", 1)[0] + "]"
    return re.compile(f"{sign}(?<=[A-Z].)(?={sign}?[A-Z])"), re.compile(r"(?m)^[\x00-\x7f]*\s[ùû]\s[\x00-\x7f]*$")


def single_again(text: str, read: str, written: str) -> str:
    """Signs and letters exchanged one by one, from the first that is out of place to the last, where one is so for certain and none stays."""
    p = patterns()
    places = [m.start() for k in ("sign", "inner", "capital", "strange", "alone", "control") for m in p[k].finditer(text)]
    capitals, lonely = shouted()
    if not places or not (certain().search(text) or len(p["alone"].findall(text)) > 1 or len(capitals.findall(text)) > 1 or lonely.search(text)):
        return text
    begin, end = text.rfind(" ", 0, min(places)) + 1, text.find(" ", max(places))
    end = len(text) if end < 0 else end
    table = single_map(read, written)
    # The rest of a line belongs to it if its only foreign characters are such that the line's language hasn't.
    head, tail = text.rfind("\n", 0, begin) + 1, text.find("\n", end)
    tail = len(text) if tail < 0 else tail
    odd = lambda part: all(c.isascii() or (c in table and c not in WESTERN and c not in PLAIN_SIGNS) for c in part)
    begin, end = head if odd(text[head:begin]) else begin, tail if odd(text[end:tail]) else end
    new = "".join(table.get(c, c) for c in text[begin:end])
    sure = [table.get(text[m.start()], "") for x in (certain(), capitals) for m in x.finditer(text, begin, end) if text[m.start()] > "\x9f"]
    if not all(c and (c.isalpha() or c == "’") for c in sure):
        return text
    return text if certain().search(new) else text[:begin] + new + text[end:]


def as_utf8(text: str):
    """(name, repaired text) of every round trip to UTF-8 that changes the text."""
    for e in READ_AS:
        new = utf8_again(text, e)
        if new != text:
            yield f"utf-8 as {e}", new
    if patterns()["ideograph"].search(text):
        for e in READ_AS_WIDE:
            new = utf8_again_wide(text, e)
            if new != text:
                yield f"utf-8 as {e}", new


def as_legacy(text: str):
    """The same to other encodings."""
    if re.search(r"[\x80-\xff]{2}", text):
        for e in WRITTEN_AS:
            for read in ("cp1252", "latin-1"):
                new = legacy_again(text, read, e)
                if new != text:
                    yield f"{e} as {read}", new
    if patterns()["cyrillic"].search(text) or re.search("[Ђ-Џђ-џ─-▟]", text):
        for read in CYRILLIC:
            for written in CYRILLIC:
                if read != written:
                    new = cyrillic_again(text, read, written)
                    if new != text:
                        yield f"{written} as {read}", new


def as_single(text: str):
    """The same of single letters and signs out of place."""
    for read, written in SINGLE:
        new = single_again(text, read, written)
        if new != text:
            yield f"{written} as {read}", new


def repaired(text: str) -> tuple[str, list[str], float, float]:
    """The repaired text, the layers undone, and the cost before and after.

    What a repair of the whole text leaves is judged by lines, then by sentences, each by its own
    cost: a stretch that is repaired alone is so in a text of any length.
    """
    new, names, first, now = undone(text)
    for parts in (LINES, SENTENCES):
        if now <= 0:
            break
        out = []
        for piece in parts.split(new):
            got = undone(piece) if piece != new and not piece.isascii() and suspicious(piece) else (piece, [])
            if len(MIXED.findall(got[0])) > len(MIXED.findall(piece)):
                got = piece, []
            out.append(got[0])
            names += [n for n in got[1] if n not in names]
        if (whole := "".join(out)) != new:
            new, now = whole, cost(whole)
    return new, names, first, now


LINES, SENTENCES = re.compile(r"(?<=\n)"), re.compile(r"(?<=[\n。！？])|(?<=[.!?])(?=\s)")

#: Cyrillic next to letters of other scripts but the Latin of ASCII.
MIXED = re.compile(r"[Ѐ-ԯ](?=[^\W\x00-\x7fЀ-ԯ])|(?<=[^\W\x00-\x7fЀ-ԯ])[Ѐ-ԯ]")


def undone(text: str) -> tuple[str, list[str], float, float]:
    """The same judged by the cost of the text as one."""
    first = now = cost(text)
    names: list[str] = []
    while now > 0:  # each layer lowers the cost
        # A strict decoding as UTF-8 is the best evidence there is, one letter for another the least;
        # but bytes of other encodings hold a few UTF-8 sequences by chance.
        best = None
        for kind in (as_utf8, as_legacy, as_single):
            found = min(((cost(new), n, name, new) for n, (name, new) in enumerate(kind(text))), default=None)
            if found is None or found[0] > now - DROP or found[0] > now * MOST_LEFT[kind.__name__]:
                continue
            if best is None or (best[0] > now * FEW and found[0] < now * (1 - FEW)):
                best = found
            if best[0] <= now * FEW:
                break
        if best is None:
            break
        now, text = best[0], best[3]
        names.append(best[2])
    return text, names, first, now


#: A repair must lower the cost by so much, and leave at most this share of it (a layer of several leaves more).
DROP, MOST_LEFT = 0.9, {"as_utf8": 0.95, "as_legacy": 0.75, "as_single": 0.75}
FEW = 0.8


DISGUISED = re.compile("[аеорсухіѕј](?:(?<=[A-Za-z].)|(?=[A-Za-z]))")
GREEK_DISGUISE = str.maketrans("αβεζηικμνορτυχ", "abezniknnoptyx")


def judged(text: str | None) -> tuple[bool, bool | None, str | None, str | None]:
    """garbled, recovered, encodings, text of one string."""
    if not text or text.isascii() or not suspicious(text):
        return False, None, None, text
    # Text disguised with look-alike letters may hold small Greek ones too; they are no garbling.
    probe = text.translate(GREEK_DISGUISE) if DISGUISED.search(text) else text
    new, names, before, after = repaired(probe)
    if not names:
        new = text
    if not patterns()["han"].search(new):  # a few uncommon names are no garbling
        after -= rare_ideographs(new)
    controls = patterns()["control"].search(text) is not None
    lost = LOST in text or LOST in new
    garbled = bool(names) or lost or controls
    # A strict decoding as UTF-8 is whole if none of its signs is left; scripts may have a cost of their own.
    whole = after < 1 or bool(names) and names[-1].startswith("utf-8") and not leftover(new)
    return garbled, (not lost and bool(names) and whole) if garbled else None, " > ".join(names) or None, new


def leftover(text: str) -> bool:
    """Whether anything that UTF-8 turns into when misread is left."""
    p = patterns()
    return any(p[k].search(text) for k in ("control", "pair", "accents", "dashes", "private")) or certain().search(text) is not None or misfits(text) > 0 or rare_ideographs(text) > 0


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [judged(t) for t in b.column(2).to_pylist()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.bool_(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[f.split()[0] for f in REPAIRS.split(", ")])


def repaired_texts(df: DataFrame) -> DataFrame:
    """``item_kind, item_id, garbled, recovered, encodings, text`` of every row.

    df: ``item_kind STRING, item_id BIGINT, text STRING``; other columns are ignored. ``text`` is
    repaired where that is possible and as it was elsewhere. ``encodings`` names the layers undone.
    A null or empty text isn't garbled; repeated rows stay repeated.
    """
    return df.select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), "text").mapInArrow(_judged, REPAIRS)
