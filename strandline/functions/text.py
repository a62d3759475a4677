"""Text functions. A script profile lets Indic and Latin text share one code path."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Script:
    """letter: characters of a key letter; initial: those of a corpus word's first character; word: those of
    folded words; fold and canon: pairs of strings for translate()."""

    name: str
    letter: str
    initial: str
    word: str
    fold: tuple[str, str] = ("", "")
    canon: tuple[str, str] = ("", "")
    lower: bool = False


def _block(first: int) -> str:
    return "".join(map(chr, range(first, first + 128)))


# Letters of the Gurmukhi block, the Devanagari block folded onto it, and the vowel carriers.
INDIC = Script(
    "indic",
    letter="ਅ-ਹੜੴ",
    initial="਀-੿",
    word="਀-੿",
    fold=(_block(0x0900), _block(0x0A00)),
    canon=("ਆਇਈਏਐਉਊਔ", "ਅੲੲੲੲੳੳੳ"),
)
LATIN = Script("latin", letter="a-zà-ÿ", initial="a-zà-ÿ", word="a-zà-ÿ", lower=True)

#: White space of any script, as characters of a class.
SPACE = r"\s\x85\p{Z}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """Words between any white space; none of an empty text."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def _folded(text: Column, script: Script) -> Column:
    text = F.lower(text) if script.lower else text
    return F.translate(text, *script.fold) if script.fold[0] else text


def _canon(letter: Column, script: Script) -> Column:
    return F.translate(letter, *script.canon) if script.canon[0] else letter


def first_letters(text: Column, script: Script = LATIN) -> Column:
    """Key of a query: each word's first letter, folded and in its canonical form; words without one are left out."""
    first = f"(?:^|[{SPACE}])[^{SPACE}{script.letter}]*+([{script.letter}])"
    return _canon(F.array_join(F.regexp_extract_all(_folded(text, script), F.lit(first), F.lit(1)), ""), script)


def first_letters_corpus(text: Column, script: Script = LATIN) -> Column:
    """Key of a corpus line: only a word's first character counts, and it is not folded."""
    text = F.lower(text) if script.lower else text
    first = f"(?:^|[{SPACE}])([{script.initial}])"
    return _canon(F.array_join(F.regexp_extract_all(text, F.lit(first), F.lit(1)), ""), script)


# Key letters of the Gurmukhi block and the Latin letters that stand for them.
ROMAN = ("ਅੲੳਸਹਕਖਗਘਙਚਛਜਝਞਟਠਡਢਣਤਥਦਧਨਪਫਬਭਮਯਰਲਵੜੴ", "aiushkkgggccjjjttddnttddnppbbmyrlvro")


def roman_letters(key: Column) -> Column:
    """A key in Latin letters, for searches by romanised or English first letters; both are compared in lower case."""
    return F.lower(F.translate(key, *ROMAN))


def script_fold(text: Column, script: Script = INDIC) -> Column:
    """Text of one script with single spaces; all other characters separate."""
    return F.trim(F.regexp_replace(_folded(text, script), f"[^{script.word}]+", " "))


def long_words(text: Column, script: Script = LATIN) -> Column:
    """Folded words of two or more characters."""
    return F.filter(F.split(script_fold(text, script), " "), lambda w: F.char_length(w) >= 2)


#: A transcript has at most so many phrases.
PHRASES = 4


def phrases(text: Column, start_mode: bool = False, script: Script = LATIN) -> Column:
    """Search phrases of a transcript, in order and without repeats."""
    w = long_words(text, script)
    n = F.size(w)
    join = lambda start, count: F.array_join(F.slice(w, start, count), " ")
    none = F.lit(None).cast("string")
    middle = none if start_mode else F.when(n >= 8, join(F.floor(n / 2).cast("int") - 1, F.lit(4)))
    return F.array_distinct(
        F.array_compact(
            F.array(
                F.when(n >= 2, join(F.lit(1), F.lit(6 if start_mode else 10))),
                F.when(n >= 4, join(F.lit(1), F.lit(4))),
                F.when(n >= 4, join(n - 3, F.lit(4))),
                middle,
            )
        )
    )


def dedup_words(text: Column) -> Column:
    """Words without immediate repeats."""
    # The words are named outside the lambda: inside, they would be made anew for every word.
    w = words(text)
    before = F.concat(F.array(F.lit(None).cast("string")), w)
    kept = F.zip_with(w, F.slice(before, 1, F.size(w)), lambda x, last: F.when(last.isNull() | (x != last), x))
    return F.array_join(F.array_compact(kept), " ")


# What marks a transcript segment as garbage, in Java's syntax.
GARBAGE = (
    r"(?d)^[.\s,،؟!]+$",
    r"[一-鿿]",
    r"[぀-ヿ]",
    r"[가-힯]",
    r"(?iu)subscribe|like|comment|video",
    r"(?iu)thank you for watching",
    r"ॐ",
    r"(?iu)^(music|tabla|harmonium|dhol)",
    r"^[^\p{L}\p{N}_]+$",
)
# The scripts whose characters count, as ranges.
VALID = "਀-੿ऀ-ॿ؀-ۿA-z"


def repeats_prefix(text: Column) -> Column:
    """The text begins with 1 to 10 characters of one line three times over."""
    return text.rlike(r"(?d)^(.{1,10})\1\1")


def is_valid(text: Column) -> Column:
    """Not garbage: long enough, no garbage pattern, two characters of a known script."""
    text = strip(text)
    good = (F.char_length(text) >= 2) & ~repeats_prefix(text)
    for pattern in GARBAGE:
        good = good & ~text.rlike(pattern)
    return good & (F.char_length(F.regexp_replace(text, f"[^{VALID}]", "")) >= 2)


def segment_concat(segments: Column) -> Column:
    """Text of the valid segments in time order, of an array of (start, end, text)."""
    kept = F.filter(F.array_sort(segments), lambda s: is_valid(s["text"]))
    return F.array_join(F.transform(kept, lambda s: s["text"]), " ")


def script_label(text: Column) -> Column:
    """The script of the first character that decides."""
    first = F.regexp_extract(text, r"[਀-੿ऀ-ॿ؀-ۿA-Za-z]", 0)
    return (
        F.when(first.rlike(r"[਀-੿]"), "gurmukhi")
        .when(first.rlike(r"[ऀ-ॿ]"), "devanagari")
        .when(first.rlike(r"[؀-ۿ]"), "arabic")
        .when(first.rlike(r"[A-Za-z]"), "latin")
        .otherwise("unknown")
    )


def has_gurmukhi(text: Column) -> Column:
    return text.rlike(r"[਀-੿]")


def has_devanagari(text: Column) -> Column:
    return text.rlike(r"[ऀ-ॿ]")


def word_overlap(a: Column, b: Column, script: Script = LATIN) -> Column:
    """Number of distinct folded words in common."""
    return F.size(F.array_intersect(long_words(a, script), long_words(b, script)))
