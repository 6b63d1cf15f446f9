"""Transcript text as Column functions: normalisation, names, quoting, formats."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English numbers and ordinals.
SMALL = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth"]
# Abbreviations that are spoken in full.
ABBREVIATIONS = {"Dr": "Doctor", "Mr": "Mister", "Mrs": "Missus", "Ms": "Miss", "Prof": "Professor"}
# Arabic numbers, masculine.
AR_ZERO = "صفر"
AR_ONES = ["واحد", "اثنان", "ثلاثة", "أربعة", "خمسة", "ستة", "سبعة", "ثمانية", "تسعة"]
AR_TEENS = ["عشرة", "أحد عشر", "اثنا عشر", "ثلاثة عشر", "أربعة عشر", "خمسة عشر", "ستة عشر", "سبعة عشر", "ثمانية عشر", "تسعة عشر"]
AR_TENS = ["عشرون", "ثلاثون", "أربعون", "خمسون", "ستون", "سبعون", "ثمانون", "تسعون"]
AR_HUNDREDS = ["مئة", "مئتان", "ثلاثمئة", "أربعمئة", "خمسمئة", "ستمئة", "سبعمئة", "ثمانمئة", "تسعمئة"]
AR_THOUSAND, AR_TWO_THOUSAND, AR_THOUSANDS = "ألف", "ألفان", "آلاف"
AR_AND = " و"
# Marks without sound (harakat, Quranic marks, tatweel) and the digits of two scripts.
AR_MARKS = r"[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۨ-ۭـ]"
AR_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
# Short language codes and the locale each stands for.
LOCALES = {
    "en": "en-US", "es": "es-ES", "de": "de-DE", "fr": "fr-FR", "it": "it-IT", "pt": "pt-PT", "ru": "ru-RU", "ja": "ja-JP", "ko": "ko-KR", "zh": "zh-CN",
    "hi": "hi-IN", "ar": "ar-SA", "vi": "vi-VN", "he": "he-IL", "nl": "nl-NL", "cs": "cs-CZ", "da": "da-DK", "pl": "pl-PL", "no": "nb-NO", "sv": "sv-SE",
    "th": "th-TH", "tr": "tr-TR", "bg": "bg-BG", "el": "el-GR", "et": "et-EE", "fi": "fi-FI", "hr": "hr-HR", "hu": "hu-HU", "lt": "lt-LT", "lv": "lv-LV",
    "ro": "ro-RO", "sk": "sk-SK", "uk": "uk-UA", "mt": "mt-MT", "sl": "sl-SI",
}

MOST_SPELLED = 9999


def _pick(words: list[str], index: Column) -> Column:
    """The index-th word, counted from 0."""
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def int_words(n: Column) -> Column:
    """English words of an integer from 0 to 9999."""
    small = lambda x: F.when(x < 20, _pick(SMALL, x)).otherwise(F.concat(_pick(TENS, F.floor(x / 10) - 2), F.when(x % 10 > 0, F.concat(F.lit("-"), _pick(SMALL, x % 10))).otherwise("")))
    thousands, hundreds, rest = F.floor(n / 1000), F.floor(n / 100) % 10, n % 100
    parts = [
        F.when(thousands > 0, F.concat(_pick(SMALL, thousands), F.lit(" thousand"))),
        F.when(hundreds > 0, F.concat(_pick(SMALL, hundreds), F.lit(" hundred"))),
        F.when((rest > 0) | (n == 0), small(rest)),
    ]
    return F.concat_ws(" ", *parts)


def ar_int_words(n: Column) -> Column:
    """Arabic words of an integer from 0 to 9999; groups joined by the conjunction."""
    thousands, hundreds, rest = F.floor(n / 1000), F.floor(n / 100) % 10, n % 100
    unit, ten = rest % 10, F.floor(rest / 10)
    below = F.when(rest < 10, _pick(AR_ONES, rest - 1)).when(rest < 20, _pick(AR_TEENS, rest - 10)).when(unit == 0, _pick(AR_TENS, ten - 2)).otherwise(F.concat(_pick(AR_ONES, unit - 1), F.lit(AR_AND), _pick(AR_TENS, ten - 2)))
    thousand = F.when(thousands == 1, AR_THOUSAND).when(thousands == 2, AR_TWO_THOUSAND).otherwise(F.concat(_pick(AR_ONES, thousands - 1), F.lit(f" {AR_THOUSANDS}")))
    return F.when(n == 0, AR_ZERO).otherwise(F.concat_ws(AR_AND, F.when(thousands > 0, thousand), F.when(hundreds > 0, _pick(AR_HUNDREDS, hundreds - 1)), F.when(rest > 0, below)))


def replace_each(text: Column, pattern: str, spoken: Callable[[Column], Column]) -> Column:
    """Replace every match by a function of it; a null result leaves the match."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(spoken(b), b, F.lit("")))), "")


def ascii_digits(text: Column) -> Column:
    """Arabic-Indic and Persian digits as 0-9."""
    return F.translate(text, AR_DIGITS, "01234567890123456789")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def one_line(text: Column) -> Column:
    """A transcript on one physical line; null is empty."""
    return collapsed(F.coalesce(text, F.lit("")))


def _number(digits: Column) -> Column:
    return ascii_digits(digits).try_cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spoken(match: Column, in_words: Callable[[Column], Column]) -> Column:
    """A run of digits in words; null above the greatest number that is spelled."""
    return bound(_number(match), lambda n: F.when(n <= MOST_SPELLED, in_words(n)))


def normalize_en(text: Column) -> Column:
    """English transcript as it is read aloud: abbreviations, ordinals to the 20th, integers to 9999, white space.

    Texts without a digit and without an abbreviation take a short way.
    """
    s = F.coalesce(text, F.lit(""))
    short_forms = "|".join(ABBREVIATIONS)
    plain = ~s.rlike(rf"(?U)\d|\b(?:{short_forms})\.")
    for short, full in ABBREVIATIONS.items():
        s = F.regexp_replace(s, rf"(?U)\b{short}\.", full)
    ordinal = lambda m: _pick(ORDINALS, _number(F.regexp_extract(m, r"^(?U)(\d+)", 1)) - 1)
    s = replace_each(s, r"(?U)\b\d{1,2}(?:st|nd|rd|th)\b", ordinal)
    s = replace_each(s, r"(?U)\b\d+\b", lambda m: _spoken(m, int_words))
    return F.when(plain, one_line(text)).otherwise(collapsed(s))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def normalize_ar(text: Column, arabic: Column | None = None) -> Column:
    """Arabic transcript as it is read aloud. Letters are kept; marks go, digits and integers are unified and spelled.

    Composition has no built-in; where `arabic` says which rows count, only their texts leave the JVM.
    """
    s = F.coalesce(text, F.lit(""))
    composed = nfc(s if arabic is None else F.when(arabic, s))
    s = F.regexp_replace(composed, AR_MARKS, "")
    s = replace_each(ascii_digits(s), r"(?U)\b\d+\b", lambda m: _spoken(m, ar_int_words))
    return collapsed(s)


def is_blank(text: Column, arabic: Column) -> Column:
    """Whether nothing is left of a transcript when it is normalised: white space, and in Arabic marks without sound."""
    s = F.coalesce(text, F.lit(""))
    return ~F.when(arabic, F.regexp_replace(s, AR_MARKS, "")).otherwise(s).rlike(r"(?U)\S")


def is_arabic(language: Column) -> Column:
    """A tag of the Arabic family; null is not."""
    return F.coalesce(F.trim(language).rlike("(?i)^ar(?:$|[-_])"), F.lit(False))


def strip_tags(text: Column) -> Column:
    """Without the language tags a recogniser puts after utterances (fixed value: the tag's form)."""
    return F.trim(F.regexp_replace(text, r"\s*<[a-z]{2}-[A-Z]{2}>\s*", " "))


def locale(language: Column) -> Column:
    """The locale a recogniser wants for a language value; ``auto`` if unknown."""
    lang = F.trim(language)
    known = F.create_map(*[F.lit(x) for pair in LOCALES.items() for x in pair])
    return F.when(F.coalesce(language, F.lit("")).isin("") | (F.lower(language) == "auto"), "auto").when(lang.contains("-"), lang).otherwise(F.coalesce(F.try_element_at(known, F.lower(lang)), F.lit("auto")))


def safe_file_name(name: Column, most: int = 200) -> Column:
    """A name without characters that file systems refuse."""
    cleaned = F.left(F.replace(F.regexp_replace(name, r'[<>:"/\\|?*\u0000-\u001F]', ""), F.lit(" "), F.lit("_")), F.lit(most))
    return F.when(F.coalesce(cleaned, F.lit("")) == "", "unnamed_file").otherwise(cleaned)


def milli_seconds(us: Column, point: str = ".") -> Column:
    """Seconds with three places, from integer microseconds (halves up)."""
    ms = F.floor((us + 500) / 1000)
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit(point), F.lpad((ms % 1000).cast("string"), 3, "0"))


def segment_name(index: Column, s_us: Column, e_us: Column) -> Column:
    """Base name of a slice before it is verified."""
    return F.concat(F.lit("solo_temp_verif_"), F.format_string("%04d", index.cast("long")), F.lit("_"), milli_seconds(s_us, "p"), F.lit("s_to_"), milli_seconds(e_us, "p"), F.lit("s"))


def final_name(base: Column, target: Column, score: Column | None = None) -> Column:
    """Name of a verified slice; with a score, of a rejected one."""
    name = F.replace(base, F.lit("solo_temp_verif"), F.concat(target, F.lit("_solo_final")))
    return name if score is None else F.concat(name, F.lit("_score_"), F.format_string("%.3f", score))


def times_of_name(name: Column) -> tuple[Column, Column]:
    """Start and end in microseconds from a slice's name (fixed value: its form); 0 if it has none."""
    at = lambda i: F.coalesce((F.replace(F.regexp_extract(name, r"(\d+p\d+)s_to_(\d+p\d+)s", i), F.lit("p"), F.lit(".")).try_cast("decimal(18,6)") * 1_000_000).cast("long"), F.lit(0).cast("long"))
    return at(1), at(2)


def csv_field(text: Column, sep: str = "|") -> Column:
    """A field quoted only if it holds the separator, a quote or a line end."""
    return F.when(text.rlike(rf'[{sep}"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def clock(us: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds are cut, hours are not wrapped."""
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    s = F.floor(us / 1_000_000)
    return F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), F.lpad((F.floor(us / 1000) % 1000).cast("string"), 3, "0"))


def size_label(n: Column) -> Column:
    """Bytes as KB, MB or GB."""
    return F.when(n > 1 << 30, F.concat(F.format_string("%.1f", n / float(1 << 30)), F.lit(" GB"))).when(n > 1 << 20, F.concat(F.format_string("%.1f", n / float(1 << 20)), F.lit(" MB"))).otherwise(F.concat(F.greatest(F.lit(1), F.round(n / 1024.0)).cast("long").cast("string"), F.lit(" KB")))


def log_class(line: Column, start: str = "Initializing pipeline") -> Column:
    """Kind of a log line: banner before error before warning; `start` is what a run's first line says."""
    return F.when(line.contains("== STAGE") | line.contains(start), "banner").when(line.rlike("(?i)traceback|error|critical|failed"), "err").when(line.rlike("(?i)warn"), "warn").otherwise("plain")


def stage_of(line: Column) -> Column:
    """Stage number of a banner; null for other lines."""
    found = F.regexp_extract(line, r"== STAGE (\d+(?:\.\d+)?)[ab]?:", 1)
    return F.when(found != "", found)


#: Names of terminal styles and of terminal colours.
STYLES = {"blink", "bold", "dim", "italic", "reverse", "strike", "under"}
COLOURS = {"black", "blue", "cyan", "green", "grey", "magenta", "red", "white", "yellow"}


def _opens_tag(said: Column, closes_here: Column) -> Column:
    """Whether what stands behind a bracket makes a tag: by its first word, or as the bare end tag."""
    name = F.lower(F.when(F.startswith(said, F.lit("/")), F.substring(said, 2, 1 << 30)).otherwise(said))
    named = F.exists(F.array(*[F.lit(n) for n in sorted(STYLES | COLOURS)]), lambda n: F.startswith(name, n))
    colour = F.startswith(name, F.lit("#")) & F.substring(name, 2, 6).rlike("^[0-9a-f]{6}$")
    background = F.startswith(name, F.lit("on")) & (F.length(name) > 2) & (F.trim(F.translate(F.substring(name, 3, 1), "\t\n\r\f\v\u00a0", "      ")) == "")
    return named | colour | background | ((said == "/") & closes_here)


def rich_stripped(line: Column) -> Column:
    """Without terminal mark-up: tags in square brackets that begin with a style, a colour, ``#rrggbb`` or ``on``, and the bare end tag.

    A name may go on (a number, more letters), and an end tag has a slash before it.
    A line is read up to each closing bracket; the first bracket before it that
    opens a tag takes all up to it.
    """
    parts = F.split(line, r"\]", -1)

    def shown(part: Column, i: Column) -> Column:
        pieces = F.split(part, r"\[", -1)
        opens = F.transform(pieces, lambda p, k: (k > 0) & _opens_tag(p, k == F.size(pieces) - 1))
        at = F.array_position(opens, F.lit(True)).cast("int")
        kept = F.when(at > 0, F.array_join(F.slice(pieces, 1, at - 1), "[")).otherwise(F.concat(part, F.lit("]")))
        return F.when(i == F.size(parts) - 1, part).otherwise(kept)

    return F.array_join(F.transform(parts, shown), "")


def clip_file_name(index: Column, s_us: Column, e_us: Column) -> Column:
    """Name of a reference clip: number and bounds in seconds with one place."""
    tenth = lambda us: F.format_string("%.1f", us / 1_000_000)
    return F.concat(F.lit("ref_"), F.format_string("%03d", index.cast("long")), F.lit("_"), tenth(s_us), F.lit("s-"), tenth(e_us), F.lit("s.wav"))


def length_label(seconds: Column) -> Column:
    """m:ss, or hours and minutes from an hour on; seconds are rounded by themselves, so 59.6 is 0:60."""
    minutes, rest = F.floor(seconds / 60), F.floor(seconds % 60 + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(minutes >= 60, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), two(minutes % 60), F.lit("m"))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(rest)))


def clock_label(ms: Column) -> Column:
    """mm:ss with hours before it where there are any."""
    s = F.floor(ms / 1000)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"))).otherwise(""), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def job_key(path: Column, references: Column, target: Column) -> Column:
    """16 hex digits that name a job: its input, the set of references and the target, case ignored."""
    refs = F.array_join(F.array_sort(F.transform(references, F.lower)), "|")
    return F.left(F.sha1(F.concat(F.lower(path), F.char(F.lit(0)), refs, F.char(F.lit(0)), F.lower(F.trim(target)))), F.lit(16))
