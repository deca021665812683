"""Problem 5: one form for strings that look the same.

A transducer over grapheme clusters (a character with the marks that follow it) rewrites a text in
one pass: at each cluster that isn't plain the longest entry of a precomputed mapping applies. The
mapping holds single characters and clusters of several: it is made by rule from the Unicode
tables for widths, compatibility forms, ligatures, composition and blanks, drops invisible
characters, and turns look-alike letters of other scripts into Latin ones. All entries are checked
for conflicts before use: each must be final, keep case, accents, digits and punctuation apart,
never turn a visible sign into a blank, and agree with what its parts give.

Clusters longer than any entry (several marks in any order, strewn with invisible characters) can
be any number; they are rewritten by the rule that the mapping is made from.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

# Fixed values, by script: letters that look like a Latin letter, each above its double.
DOUBLES = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝӏ" "АВЕКМНОРСТХІЈЅҮԌԚԜӀ", "aeopcyxijshdqwl" "ABEKMHOPCTXIJSYGQWI"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ" "αονρυϲϳ", "ABEZHIKMNOPTYXCJ" "aovpucj"),
    "Armenian": ("օոսհցԼՕՏ", "ounhgLOS"),
    "Latin": ("ɑɡ", "ag"),
    "Coptic": ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ" "ⲟⲣⲥ", "ABEHIKMNOPCTYX" "opc"),
    "Cherokee": ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),
    "Lisu": ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
}
LOOKALIKES = {a: b for one, other in DOUBLES.values() for a, b in zip(one, other, strict=True)}
#: Marks that join the character before them: combining marks, kana sound marks, Hangul vowels and finals.
JOINING = "゙゚ﾞﾟ"
HANGUL = range(0x1160, 0x1200)
#: Code points with a form of their own can only stand here (beyond lie plain ideographs and private use).
CODES = [*range(0x80, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
#: Clusters kept in memory by a worker; more are worked out again each time.
CACHE = 200_000
FORMS = "field string, key bigint, text string, form string"


def dropped(c: str) -> bool:
    """Whether a character can't be seen: format characters and variation selectors."""
    return unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in "͏ᅟᅠㅤﾠ឴឵"


def by_rule(cluster: str) -> str:
    """The form of a cluster from the Unicode tables."""
    out = []
    for c in cluster:
        if dropped(c):
            continue
        if unicodedata.category(c) == "Zs":
            out.append(" ")
            continue
        d = unicodedata.normalize("NFKD", c)
        out.append(unicodedata.normalize("NFD", c) if d.startswith(" ") else d)
    spread = unicodedata.normalize("NFD", "".join(out))
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in spread))


@cache
def singles() -> dict[str, str]:
    """Every single character that changes, with its form."""
    out = {}
    for c in map(chr, CODES):
        if c in LOOKALIKES or unicodedata.decomposition(c) or unicodedata.category(c) == "Zs" or dropped(c):
            form = by_rule(c)
            if form != c:
                out[c] = form
    return out


def sequences() -> Iterator[str]:
    """Clusters of several characters that are one when composed: those of the tables, and with every other form of their first character."""
    first: dict[str, list[str]] = {}
    for c, form in singles().items():
        if len(form) == 1 and not unicodedata.combining(c):
            first.setdefault(form, []).append(c)
    for c in map(chr, CODES):
        if unicodedata.decomposition(c)[:1] not in ("", "<"):
            parts = unicodedata.normalize("NFD", c)
            if len(parts) > 1 and not unicodedata.combining(parts[0]):
                tails = {parts[1:], "".join(sorted(parts[1:])), "".join(sorted(parts[1:], reverse=True))}
                yield from (head + tail for head in (parts[0], *first.get(parts[0], ())) for tail in tails)
                # A letter that already holds one of its marks, with the others behind.
                for k in range(1, len(parts) - 1):
                    for left in (parts[1 : k + 1], parts[len(parts) - k :]):
                        head = unicodedata.normalize("NFC", parts[0] + left)
                        rest = "".join(m for m in parts[1:] if m not in left)
                        if len(head) == 1 and rest:
                            yield head + rest
    leads, vowels, finals = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)
    for lead in leads:
        for vowel in vowels:
            yield chr(lead) + chr(vowel)
            for final in finals:
                yield chr(lead) + chr(vowel) + chr(final)
                yield unicodedata.normalize("NFC", chr(lead) + chr(vowel)) + chr(final)


@cache
def mapping() -> dict[str, str]:
    """The entries of the transducer: single characters and clusters, with their forms. Checked for conflicts."""
    table = dict(singles())
    for cluster in sequences():
        form = by_rule(cluster)
        if form != cluster:
            table[cluster] = form
    return {c: form for c, form in table.items() if not conflict(c, form)}


@cache
def longest() -> int:
    return max(map(len, mapping()))


def conflict(c: str, form: str) -> bool:
    """Whether an entry would unite what must stay apart, isn't final, or disagrees with what its parts give."""
    if form and by_rule(form) != form:
        return True
    if len(c) > 1:
        if not form.strip() or any(conflict(x, by_rule(x)) for x in c if x in singles()):
            return True
        return any(by_rule(by_rule(c[:k]) + c[k:]) != form for k in range(1, len(c)))
    kind = unicodedata.category(c)
    if kind != "Zs" and form and not form.strip():
        return True
    if len(form) == 1 and kind in ("Lu", "Ll") and unicodedata.category(form) in ("Lu", "Ll") and kind != unicodedata.category(form):
        return True
    digit = unicodedata.digit(c, None)
    return digit is not None and kind == "Nd" and unicodedata.digit(form, digit) != digit


def _class(chars: list[int]) -> str:
    """A character class in ranges."""
    out, i = [], 0
    while i < len(chars):
        j = i
        while j + 1 < len(chars) and chars[j + 1] == chars[j] + 1:
            j += 1
        out.append(f"\\U{chars[i]:08x}" + (f"-\\U{chars[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(out)


ASTRAL = "\\U00010000-\\U0010ffff"
BEYOND = re.compile(f"[{ASTRAL}]")


@cache
def clusters() -> tuple[re.Pattern, re.Pattern]:
    """Match the clusters that may change: in texts of 16-bit characters, and in others.

    They hold a character that changes, a mark that joins with others or can't be seen, or
    several marks, whose order may vary. A plain character with one plain mark stays as it is.
    """
    marks = {n for n in CODES if unicodedata.category(chr(n)) in ("Mn", "Mc", "Me") or chr(n) in JOINING or n in HANGUL or dropped(chr(n))}
    joining = {n for n in marks if chr(n) in mapping() or chr(n) in JOINING or n in HANGUL}
    for c in map(chr, CODES):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<":
            joining.add(int(parts[1], 16))
    # Within 16 bits a class is a table; characters beyond are few and all looked up.
    marks, joining = ({n for n in x if n < 0x10000} for x in (marks, joining))
    special = sorted(n for n in {ord(c) for c in singles() if c in mapping()} - marks if n < 0x10000)
    m, j = _class(sorted(marks)), _class(sorted(joining & marks))
    return (
        re.compile(f"[{_class(special)}][{m}]*|[^{m}\\x00-\\x1f](?:[{j}][{m}]*|[{m}]{{2,}})|[{m}]+"),
        # Beyond 16 bits there are marks too, which join with what stands before.
        re.compile(f"[^{m}\\x00-\\x1f]?[{m}]*[{ASTRAL}][{m}{ASTRAL}]*|[{_class(special)}][{m}]*|[^{m}\\x00-\\x1f](?:[{j}][{m}]*|[{m}]{{2,}})|[{m}]+"),
    )


def rewritten(cluster: str) -> str:
    """The form of a cluster: entries by the longest match, where nothing but invisible characters is left between them."""
    table, most = mapping(), longest()
    if len(cluster) <= most and (form := table.get(cluster)) is not None:
        return form
    if len(cluster) == 1:
        return cluster
    # What can't be seen belongs to no entry; without it the cluster may be one.
    seen = "".join(c for c in cluster if table.get(c) != "")
    if seen != cluster and len(seen) <= most and (not seen or seen in table or len(seen) == 1):
        return table.get(seen, seen)
    return by_rule(cluster)


_known: dict[str, str] = {}


def _form(m: re.Match) -> str:
    cluster = m[0]
    form = _known.get(cluster)
    if form is None:
        form = rewritten(cluster)
        if len(_known) < CACHE:
            _known[cluster] = form
    return form


def canonical(text: str) -> str:
    """The one form of all strings that look like text."""
    return text if text.isascii() else clusters()[BEYOND.search(text) is not None].sub(_form, text)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [None if t is None else canonical(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("field"), b.column("key"), b.column("text"), pa.array(out, pa.string())], names=["field", "key", "text", "form"])


def canonical_forms(df: DataFrame) -> DataFrame:
    """``field, key, text, form`` for every row; a null text has a null form, the empty one an empty form.

    df: ``field STRING, key BIGINT, text STRING``; other columns are ignored. Rows may repeat.
    Case, accents, digits and punctuation are kept, as is the number of blanks.
    """
    return df.select("field", F.col("key").cast("bigint").alias("key"), "text").mapInArrow(_forms, FORMS)


#: So many rows of one string are one part when pairs are made, and so many shares its rows are spread over before that.
PART, SHARES = 20_000, 8
GROUP, STRING = ["field", "f1", "f2"], ["field", "s1", "s2"]


def hashed(forms: DataFrame) -> DataFrame:
    """``field, key`` and the 128-bit hashes of form and text of every different row, written once."""
    two = lambda c, out: [F.xxhash64(c).alias(f"{out}1"), F.xxhash64(F.lit(1), c).alias(f"{out}2")]
    rows = forms.filter("key is not null and text is not null").select("field", "key", *two("form", "f"), *two("text", "s")).distinct()
    return cut(rows)


def strings_of(rows: DataFrame) -> DataFrame:
    """The different strings of forms that have several, with their rows ``n``, and rows ``total``, strings ``m`` and least key of the form."""
    strings = rows.groupBy(*GROUP, "s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"))
    forms = strings.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m"), F.min("least").alias("class_key")).filter("m > 1")
    return strings.join(forms, GROUP).drop("least")


def members_of(rows: DataFrame, strings: DataFrame) -> DataFrame:
    """The rows of the strings. A string may hold a third of all rows: its rows are spread over shares, and the string is repeated for each."""
    spread_rows = rows.select("field", "key", "s1", "s2").withColumn("share", F.pmod(F.xxhash64(F.lit(2), "key"), F.lit(SHARES)).cast("int"))
    shares = strings.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return spread_rows.join(shares, [*STRING, "share"]).drop("share")


def lookalike_classes(forms: DataFrame) -> DataFrame:
    """``field, key, class_key, links`` of every row whose form has several texts.

    ``class_key`` is the least key of the class, ``links`` the number of its rows with another
    text. Copies aren't expanded into pairs. A key with several texts has a row for each. Rows
    with a null key or text are in no class; an empty table gives none.
    """
    rows = hashed(forms)
    return members_of(rows, strings_of(rows)).select("field", "key", "class_key", (F.col("total") - F.col("n")).alias("links"))


def lookalike_pairs(forms: DataFrame) -> DataFrame:
    """``field, key_a, key_b`` of rows whose texts differ but have the same form; key_a < key_b.

    All pairs between the rows of ``lookalike_classes``, for those who need them. They are made
    between distinct strings of a form, and only then between their rows, so copies of one string
    are never compared with each other; a string with many rows is taken in parts. Rows with a
    null key or text have no partner.
    """
    rows = hashed(forms)
    strings = strings_of(rows).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    a = strings.select(*GROUP, F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("parts").alias("a_parts"))
    b = strings.select(*GROUP, F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("parts").alias("b_parts"))
    pairs = a.join(b, GROUP).filter("a1 < b1 or (a1 = b1 and a2 < b2)").drop("f1", "f2")
    pairs = pairs.withColumn("a_part", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1))).withColumn("b_part", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1)))
    members = members_of(rows, strings.select(*STRING, "parts")).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    of = lambda x: members.select("field", F.col("s1").alias(f"{x}1"), F.col("s2").alias(f"{x}2"), F.col("part").alias(f"{x}_part"), F.col("key").alias(f"key_{x}"))
    pairs = pairs.join(of("a"), ["field", "a1", "a2", "a_part"]).join(of("b"), ["field", "b1", "b2", "b_part"])
    return pairs.filter("key_a <> key_b").select("field", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
