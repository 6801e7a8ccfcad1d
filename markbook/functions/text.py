"""Column expressions over text cells. All of them are null-safe and stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)^\s+|\s+$"


def text(c: Column) -> Column:
    """``c`` as a string, null as blank."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at the ends, tabs and no-break spaces included."""
    return F.regexp_replace(text(c), SPACES, "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank(c: Column) -> Column:
    return strip(c) == ""


def clean_cell(c: Column) -> Column:
    """Trimmed text without one trailing ``.0``; null as blank."""
    return F.regexp_replace(strip(c), r"\.0$", "")


def clean_key(c: Column) -> Column:
    """Lookup key: trimmed, upper case, a number written as a decimal is its whole part, else cut at the first dot."""
    s = strip(F.translate(text(c), " ", " "))
    number = F.when(s.rlike(r"^[+-]?[0-9]+\.0*$"), F.try_to_number(F.regexp_extract(s, r"^([+-]?[0-9]+)", 1), F.lit("S" + "9" * 38)))
    scientific = F.when(s.rlike(r"^[0-9]+\.[0-9]+[eE]\+?[0-9]+$"), s.try_cast("double").cast("decimal(38,0)").cast("string"))
    whole = F.when(s.contains("."), F.coalesce(scientific, number.cast("string"), F.split_part(s, F.lit("."), F.lit(1)))).otherwise(s)
    return F.upper(F.trim(whole))


def canonical_subject(c: Column) -> Column:
    """Upper case, without the language marks and trailing numerals I to III, single spaces."""
    s = F.replace(F.replace(F.upper(text(c)), F.lit(" IN ENGLISH"), F.lit("")), F.lit(" ENGLISH"), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(strip(s), r"(\s+(I|II|III))+$", ""), r"\s+", " "))


def short_year(c: Column) -> Column:
    """``2024-2025`` as ``24-25``; other text as it is."""
    s = strip(c)
    return F.when(s.rlike(r"^\d{4}\s*-\s*\d{4}$"), F.concat(F.substring(s, 3, 2), F.lit("-"), F.right(s, F.lit(2)))).otherwise(s)


def first_year(c: Column) -> Column:
    """The first run of four digits, else the trimmed text."""
    return F.coalesce(F.nullif(F.regexp_extract(text(c), r"(\d{4})", 1), F.lit("")), strip(c))


def batch_text(c: Column, years: int) -> Column:
    """``start - end`` of the batch that an academic year ends, ``years`` long; blank without two years."""
    end = F.regexp_extract(text(c), r"\d{4}\D+(\d{2,4})", 1)
    whole = F.when(F.length(end) == 2, F.concat(F.substring(F.regexp_extract(text(c), r"(\d{4})", 1), 1, 2), end)).otherwise(end)
    n = whole.try_cast("int")
    return F.coalesce(F.concat_ws(" - ", (n - years).cast("string"), F.when(n.isNotNull(), n.cast("string"))), F.lit(""))


# Word families of the faculties, in order of precedence.
FACULTIES = (
    ("Commerce & Management", r"(?i)\b(commerce|accounting|management|finance|financial|marketing|business|economics|b\.?com|m\.?com)\b"),
    ("Science & Technology", r"(?i)\b(science|artificial|intelligent|biochemistry|data|technology|b\.?sc\.?|m\.?sc\.?)\b"),
    ("Humanities", r"(?i)\b(arts|entertainment|media|multimedia|film|television|advertising|b\.?a\.?|m\.?a\.?)\b"),
)


def case_of(c: Column, rules: Sequence[tuple[str, str]], other: Column | None = None) -> Column:
    """The name of the first rule (name, pattern) that ``c`` matches."""
    out = None
    for name, pattern in rules:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(F.lit("") if other is None else other)


def faculty(c: Column) -> Column:
    """X8."""
    return case_of(strip(c), FACULTIES)


def course_length(c: Column) -> Column:
    """Two years for masters, three for bachelors, else blank."""
    return case_of(strip(c), (("Two Year Degree Course", r"(?i)\bMASTERS?\b|^M"), ("Three Year Degree Course", r"(?i)\bBACHELORS?\b|^B")))


def gender_code(c: Column) -> Column:
    """1 and 2; unknown text passes through, null is blank."""
    s = F.lower(strip(c))
    return F.when(s.isin("male", "m", "1"), "1").when(s.isin("female", "f", "2"), "2").otherwise(text(c))


# Digits.
LATIN_DIGITS, DEVANAGARI_DIGITS = "0123456789", "०१२३४५६७८९"


def devanagari_digits(c: Column) -> Column:
    """X11."""
    return F.translate(strip(c), LATIN_DIGITS, DEVANAGARI_DIGITS)


def class_text(c: Column) -> Column:
    """``'B+' Grade`` of a class with or without the word and quotes."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"(?i)\bgrade\b", ""), r"^[ '\"]+|[ '\"]+$", "")
    return F.when(s == "", "").otherwise(F.concat(F.lit("'"), s, F.lit("' Grade")))


def initials(c: Column, stop: str = "COLLEGE|OF|COMMERCE|ECONOMICS|ARTS|SCIENCE", most: int = 5, else_most: int = 10) -> Column:
    """Initials of the words that aren't stop words; the head of the name if fewer than two are left."""
    words = F.regexp_extract_all(F.regexp_replace(F.upper(text(c)), stop, ""), F.lit("([A-Z0-9]+)"), 1)
    short = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(short) > 1, F.substring(short, 1, most)).otherwise(F.substring(text(c), 1, else_most))


def abbreviation(c: Column, known: Sequence[tuple[str, str]]) -> Column:
    """The first (short name, keyword pattern) found in a name, else its initials."""
    return case_of(F.upper(text(c)), known, initials(c)) if known else initials(c)


def before_marker(c: Column, marker: str, default: str = "") -> Column:
    """Text before ``marker`` (any case) in a file name, without trailing ``-_()``."""
    name = F.regexp_replace(text(c), r"^.*/", "")
    head = F.regexp_replace(strip(F.element_at(F.split(name, f"(?i){marker}"), 1)), r"[\-_()]+$", "")
    return F.when(strip(head) == "", F.lit(default)).otherwise(strip(head))


def exam_type(c: Column, mark: str = "re-exam", yes: str = "Re-Exam", no: str = "Regular") -> Column:
    """X16."""
    return F.when(F.lower(text(c)).contains(mark), yes).otherwise(no)


def extended(c: Column) -> Column:
    """Yes if an older deadline is given."""
    return F.when(strip(c).isin("-", "nan", "None", "NaT", ""), "No").otherwise("Yes")


def shown_number(c: Column) -> Column:
    """Number without a needless ``.0``; other text as it is, null as blank."""
    s = F.regexp_replace(strip(c), r"^\+\s*", "")
    return F.when(s.rlike(r"^[+-]?[0-9]+\.[0-9]*0*$") & s.rlike(r"\."), F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", "")).otherwise(s)


def sheet_name(c: Column, most: int = 31) -> Column:
    """Without bracketed parts and forbidden characters, ``Semester`` shortened, cut to ``most``."""
    s = F.regexp_replace(F.regexp_replace(text(c), r"\[[^\]]*\]", ""), r"[\\/*?:\[\]]", "")
    return strip(F.substring(strip(F.regexp_replace(F.regexp_replace(s, r"(?i)\bSemester\b", "Sem"), r"\s+", " ")), 1, most))


def score_label(score: Column, attendance: Column) -> Column:
    """What an ``AB`` score stands for."""
    absent = F.upper(strip(score)) == "AB"
    return F.when(absent & (F.upper(strip(attendance)) == "UFM"), "UFM").when(absent, "ABSENT").otherwise(text(score))


def degap(c: Column) -> Column:
    """Letter-spaced digits put together."""
    return F.regexp_replace(text(c), r"(?U)\s+", "")


def without_marks(c: Column) -> Column:
    """Without ``$ ~ #``."""
    return strip(F.translate(text(c), "$~#", ""))


def has_mark(c: Column) -> Column:
    return F.when(text(c).contains("$"), "Yes").otherwise("No")


def without_rules(c: Column) -> Column:
    """Runs of ``-``, ``_`` and ``=`` removed, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"-{3,}|_{3,}|={3,}", " "), r"\s+", " "))


def joined(parts: Sequence[Column], sep: str = " | ", drop: Sequence[str] = ("", "NAN", "NONE", "NA")) -> Column:
    """The parts that say something."""
    return F.array_join(F.filter(F.array(*(strip(p) for p in parts)), lambda p: ~F.upper(p).isin(*drop)), sep)


def group_label(columns: Sequence[str]) -> Column:
    """``column:value | ...`` of a duplicate group."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{c}:"), text(F.col(c))) for c in columns))


def paper_line(subject: Column, semester: Column, sep: str = " | ") -> Column:
    """What a paper is, as one line."""
    return F.array_join(F.filter(F.array(strip(subject), F.when(blank(semester), "").otherwise(F.concat(F.lit("Semester "), strip(semester)))), lambda x: x != ""), sep)


def file_name(subject: Column, semester: Column, suffix: str = ".xlsx") -> Column:
    """A file name for a paper: forbidden characters out, white space as ``_``."""
    return F.concat(F.regexp_replace(strip(F.regexp_replace(paper_line(subject, semester, " "), r"[\\/*?:\"<>|\[\]]", " ")), r"\s+", "_"), F.lit(suffix))


def month_text(c: Column) -> Column:
    """Comma to space, ``nan`` to blank."""
    s = strip(F.regexp_replace(F.replace(text(c), F.lit(","), F.lit(" ")), r"\s+", " "))
    return F.when(F.lower(s) == "nan", "").otherwise(s)


# Letters of the offline transliteration (vowel: sign after a consonant, letter alone).
CONSONANTS = {
    "kh": "ख", "gh": "घ", "chh": "छ", "ch": "च", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श", "ng": "ङ", "ny": "ञ",
    "k": "क", "g": "ग", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "f": "फ", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व",
    "w": "व", "s": "स", "h": "ह", "z": "ज़", "x": "क्स", "q": "क", "c": "क",
}
VOWELS = {"aa": ("ा", "आ"), "ee": ("ी", "ई"), "oo": ("ू", "ऊ"), "ai": ("ै", "ऐ"), "au": ("ौ", "औ"), "a": ("", "अ"), "i": ("ि", "इ"), "u": ("ु", "उ"), "e": ("े", "ए"), "o": ("ो", "ओ")}
VIRAMA = "्"


PIECE = "|".join([*sorted(CONSONANTS, key=len, reverse=True), *sorted(VOWELS, key=len, reverse=True)])


# A letter of A-Z a-z for each piece, so that a text of such words is spelt as a whole; ALONE and END are marks before a vowel and after a word.
ALONE, END = "X", "V"
_LONG = sorted((p for p in (*CONSONANTS, *VOWELS) if len(p) > 1), key=lambda p: (-len(p), not any(q != p and len(q) > 1 and q[0] == p[-1] for q in (*CONSONANTS, *VOWELS)), p))  # of two that overlap, that which starts first goes first
CODES = {p: p for p in (*CONSONANTS, *VOWELS) if len(p) == 1} | dict(zip(_LONG, (x for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if x not in ALONE + END)))


def _translated(s: Column, pairs: dict[str, str]) -> Column:
    """``s`` with each letter replaced by its text: those of one code point or none in one pass."""
    for k, v in pairs.items():
        if len(v) > 1:
            s = F.replace(s, F.lit(k), F.lit(v))
    one, none = [k for k, v in pairs.items() if len(v) == 1], [k for k, v in pairs.items() if not v]
    return F.translate(s, "".join([*one, *none]), "".join(pairs[k] for k in one))


def _coded(s: Column) -> Column:
    """``s`` with the letter of each piece, longest first."""
    s = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for p in _LONG:
        s = F.replace(s, F.lit(p), F.lit(CODES[p]))
    return s


def _spelt(s: Column) -> Column:
    """Words of nothing but letters of pieces in Devanagari; words without any stay.

    A transducer whose only state is whether the piece before was a consonant: marks are put where a vowel follows no consonant
    and where a consonant ends a word, and all letters are replaced.
    """
    consonants, vowels = ("".join(CODES[p] for p in x) for x in (CONSONANTS, VOWELS))
    s = F.regexp_replace(s, f"(?<![{consonants}])(?=[{vowels}])", ALONE)
    s = F.regexp_replace(s, f"(?<=[{consonants}])(?![A-Za-z])", END)
    for p, (_, alone) in VOWELS.items():
        s = F.replace(s, F.lit(ALONE + CODES[p]), F.lit(alone))
    return _translated(s, {CODES[p]: x for p, x in CONSONANTS.items()} | {CODES[p]: sign for p, (sign, _) in VOWELS.items()} | {END: VIRAMA})


def devanagari(word: Column) -> Column:
    """Latin letters to Devanagari, longest piece first; a consonant at the end is without its vowel."""
    return _spelt(F.regexp_replace(_coded(F.lower(word)), "[^A-Za-z]", ""))


def transliterate(name: Column) -> Column:
    """Every word of a name; a word without letters stays, one with letters is nothing but these."""
    words = F.regexp_replace(strip(name), r"\s+", " ")
    letters = F.regexp_replace(words, "(?<=[A-Za-z])[^A-Za-z ]+|(?<![^A-Za-z ])[^A-Za-z ]++(?=[A-Za-z])", "")
    return F.when(name.isNotNull(), _spelt(_coded(letters)))


def devanagari_word(word: str) -> str:
    """``devanagari`` of one word on the driver."""
    out, opened = "", False
    for m in re.finditer(PIECE, word.lower()):
        out += CONSONANTS.get(m[0]) or VOWELS[m[0]][0 if opened else 1]
        opened = m[0] in CONSONANTS
    return out + VIRAMA * opened
