"""Text expressions: pure Column functions, evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that mean "missing".
MISSING = ("", "-", "—", "暂无", "N/A", "NA", "None", "null", "nan")
# one range is asked of every character, the three only of those within it
CJK = "[\\x{3400}-\\x{faff}&&[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]]"


#: Characters with the property White_Space.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def single(chars: str) -> str:
    """Characters for a class of a pattern, one by one: those below U+0100 are one look into a table, where each range would be a test of its own."""
    return "".join(rf"\x{{{ord(c):x}}}" for c in chars)


PLAIN = [chr(i) for i in range(0x80)]
#: What bare texts leave out.
NOT_BARE = "[^" + single("".join(c for c in PLAIN if c.isalnum())) + r"\x{4e00}-\x{9fff}]+"
STOPS, PLAIN_STOPS = "。！？；…", "!?;\n"
# a piece between sentence ends from its first character that is not blank; ASCII runs apart from the rest, for which more is to be tested
_WITHIN = "".join(c for c in PLAIN if c not in PLAIN_STOPS)
_BEGIN = f"(?:[{single(''.join(c for c in _WITHIN if c not in BLANKS))}]|[^\\x00-\\x7f{single(STOPS + BLANKS)}])"
SENTENCE = f"{_BEGIN}(?:[{single(_WITHIN)}]+|[^\\x00-\\x7f{single(STOPS)}])*+"


def clean(c: Column) -> Column:
    """Null to empty; Unicode blanks trimmed on both ends."""
    return F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANKS))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def normalize_blanks(c: Column) -> Column:
    return F.regexp_replace(clean(c), r"(?U)\s+", " ")


def contains_cjk(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(CJK)


def is_missing(c: Column) -> Column:
    text = clean(c)
    return text.isin(*MISSING) | F.lower(text).isin("none", "null", "nan")


def bare(c: Column) -> Column:
    """Lower case; only CJK ideographs, ASCII letters and digits stay."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), NOT_BARE, ""))


def char_ngrams(c: Column, n: int = 2) -> Column:
    """Distinct character n-grams of the bare text; at most n characters give one gram, none give none."""
    return bound(bare(c), lambda b: ngrams_in_bare(b, n))


def ngrams_in_bare(b: Column, n: int = 2) -> Column:
    """The same of bare text. A look ahead finds the grams at all places in one pass; bare characters are one unit of a pattern each."""
    many = F.array_distinct(F.regexp_extract_all(b, F.lit(f"(?=(.{{{n}}}))"), F.lit(1)))
    return F.when(F.length(b) == 0, F.array().cast("array<string>")).when(F.length(b) <= n, F.array(b)).otherwise(many)


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Jaccard index of two sets of strings; `empty` when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def contains(text: Column, phrase: Column) -> Column:
    """1 if the bare phrase is in the bare text, else 0; empty sides give 0."""
    return contains_bare(bare(text), bare(phrase))


def contains_bare(t: Column, p: Column) -> Column:
    return ((F.position(p, t) > 0) & (t != "") & (p != "")).cast("int")


def bare_words(keywords: tuple[str, ...]) -> list[str]:
    bares = [re.sub(r"[^一-鿿A-Za-z0-9]+", "", k).lower() for k in keywords]
    return [k for k in bares if k]


def any_in_bare(t: Column, keywords: tuple[str, ...]) -> Column:
    return t.rlike("|".join(map(re.escape, bare_words(keywords))) or "(?!)").cast("int")


def contains_any(text: Column, keywords: tuple[str, ...]) -> Column:
    return any_in_bare(bare(text), keywords)


def count_in_bare(t: Column, keywords: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [((F.length(t) - F.length(F.replace(t, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in bare_words(keywords)], F.lit(0))


def count_any(text: Column, keywords: tuple[str, ...]) -> Column:
    """Sum over keywords of their non-overlapping occurrences in the bare text."""
    return bound(bare(text), lambda t: count_in_bare(t, keywords))


def sentences_in(t: Column) -> Column:
    """Of trimmed text: pieces between sentence ends that are not blank; at least 1 for text that is not empty."""
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.regexp_count(t, F.lit(SENTENCE))))


def sentence_count(c: Column) -> Column:
    """Non-blank pieces between sentence ends; at least 1 for text that is not empty."""
    return bound(clean(c), sentences_in)


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def category_pieces(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"[/>｜|·\s]+"), lambda x: F.length(bare(x)) >= 2)


def question_stem(c: Column) -> Column:
    """Lower case, numbers as <num>, other signs as single blanks."""
    numbers = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[0-9]+(\.[0-9]+)?", "<num>")
    return F.trim(F.regexp_replace(F.regexp_replace(numbers, r"[^a-z0-9<>]+", " "), " +", " "))


def token_set(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.coalesce(c, F.lit("")), " ")), lambda x: x != "")


def mentions(c: Column, markers: tuple[str, ...], words: tuple[str, ...]) -> Column:
    """Any marker as a substring, or any word on word boundaries, whatever the case."""
    parts = [re.escape(m) for m in markers] + ([rf"\b(?:{'|'.join(map(re.escape, words))})\b"] if words else [])
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(parts))


def slug(c: Column) -> Column:
    return F.translate(c, "/: ", "___")


def safe_segment(c: Column) -> Column:
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w-]", "")
    return F.when(kept == "", "unknown").otherwise(kept)


def tagged_answer(c: Column) -> Column:
    """Text between answer tags, else the whole text; trimmed."""
    text = F.coalesce(c, F.lit(""))
    inside = F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)
    return clean(F.when(text.rlike(r"(?is)<answer>.*?</answer>"), inside).otherwise(text))


def ensure_prefix(c: Column, prefix: str, attributed: str) -> Column:
    """The prefix goes before texts that are not attributed; a doubled prefix before attributed text goes."""
    text = F.regexp_replace(clean(c), rf"(?i)^(?:{re.escape(prefix)}\s*)+(?={attributed})", "")
    return F.when(text == "", text).when(text.rlike(f"(?i)^(?:{re.escape(prefix)}|{attributed})"), text).otherwise(F.concat(F.lit(prefix + " "), text))


def missing_tokens(source: Column, target: Column, pattern: str = r"[A-Z][A-Z0-9]+") -> Column:
    """Sorted tokens of the source that the target lacks."""
    return F.array_sort(F.array_except(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), F.regexp_extract_all(target, F.lit(pattern), F.lit(0))))


def numeric_tokens(c: Column, pattern: str = r"(?<![A-Za-z])\d+(?:[.,]\d+)?") -> Column:
    """Distinct numbers of a text in one form: without commas, whole ones as integers, others with six significant digits."""

    def token(x: Column) -> Column:
        n = F.replace(x, F.lit(","), F.lit("")).cast("double")
        digits = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(n))))
        return F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise((F.round(n * digits) / digits).cast("string"))

    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)), token))


def same_numbers(a: Column, b: Column) -> Column:
    """The multisets of numbers in two texts are equal."""
    numbers = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    return numbers(a) == numbers(b)
