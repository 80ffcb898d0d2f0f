"""Search keys, number grounding and other text expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks in romanised names, by base letter.
MARKED = {
    "a": "āáàâäãå", "e": "ēéèêë", "i": "īíìîï", "o": "ōóòôöõ", "u": "ūúùûü", "c": "ç", "d": "ḍ", "h": "ḥ",
    "l": "ḷ", "m": "ṃṁ", "n": "ñṅṇ", "r": "ṛṝ", "s": "śṣš", "t": "ṭ", "z": "ž",
}
#: Composed Devanagari letters and their plain ones, and the marks that keys drop or fold.
NUKTA_LETTERS = {"क़": "क", "ख़": "ख", "ग़": "ग", "ज़": "ज", "ड़": "ड", "ढ़": "ढ", "फ़": "फ", "य़": "य"}
NUKTA, ANUSVARA, CHANDRABINDU = "़", "ं", "ँ"
DEVANAGARI = r"\p{IsDevanagari}"
#: Rough Latin for Devanagari letters, without the inherent vowel.
LATIN = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "ळ": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h", "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u",
    "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o", "ा": "a", "ि": "i", "ी": "i", "ु": "u",
    "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ॉ": "o", "ं": "n", "ँ": "n",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
DIGITS = ("०१२३४५६७८९", "0123456789")
#: Numbers in prose, grouped in either style; and as JSON writes them.
GROUPED = r"(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})+,\d{3}|\d+)(?:\.\d+)?"
PLAIN = r"\d+(?:\.\d+)?"
EMERGENCY = ("112", "1077")
EXACT, PREFIX, SUBSTRING, NONE = range(4)
PLACE_SIZES = ("city", "town", "suburb", "village", "hamlet")
MIN_SKELETON, MIN_BARE = 3, 2


def latin_key(name: Column) -> Column:
    """Search key of a Latin name: marks folded, doubled letters single, w as v, ph as f."""
    pairs = [(mark, base) for base, marks in MARKED.items() for mark in marks] + [("w", "v")]
    key = F.translate(F.lower(name), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    key = F.regexp_replace(key, "[^a-z0-9]", "")
    # runs of three or more are matched first and kept, so what is left are pairs; e and o have pairs of their own
    key = F.regexp_replace(key, r"(([a-z])\2{2,})|(([a-df-np-z])\4)", "$1$4")
    key = F.regexp_replace(F.regexp_replace(key, "(?<!e)ee(?!e)", "i"), "(?<!o)oo(?!o)", "u")
    return F.replace(key, F.lit("ph"), F.lit("f"))


def bare_key(key: Column) -> Column:
    return F.translate(key, "a", "")


def skeleton(key: Column) -> Column:
    return F.translate(key, "aeiouyh", "")


def hindi_key(name: Column) -> Column:
    """Search key of a Devanagari name; other scripts and nuktas go."""
    folded = F.translate(name, "".join(NUKTA_LETTERS) + CHANDRABINDU + NUKTA, "".join(NUKTA_LETTERS.values()) + ANUSVARA)
    return F.regexp_replace(folded, f"[^{DEVANAGARI}]", "")


def transliterate(name: Column) -> Column:
    """Devanagari in rough Latin letters; anything else is skipped."""
    plain = F.translate(name, "".join(NUKTA_LETTERS), "".join(NUKTA_LETTERS.values()))
    table = F.create_map(*[F.lit(x) for kv in LATIN.items() for x in kv])
    letters = F.transform(F.split(plain, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("")))
    return F.array_join(letters, "")


def has_devanagari(text: Column) -> Column:
    return text.rlike(DEVANAGARI)


def match_tier(key: Column, query: Column) -> Column:
    """0 exact, 1 prefix, 2 substring, 3 none; empty or null keys never match."""
    empty = (F.coalesce(query, F.lit("")) == "") | (F.coalesce(key, F.lit("")) == "")
    return F.when(empty, NONE).when(key == query, EXACT).when(F.startswith(key, query), PREFIX).when(F.contains(key, query), SUBSTRING).otherwise(NONE)


def place_size(kind: Column) -> Column:
    """Rank of a settlement kind, larger places first, unknown kinds last."""
    out = F.when(kind == PLACE_SIZES[0], 0)
    for rank, name in enumerate(PLACE_SIZES[1:], 1):
        out = out.when(kind == name, rank)
    return out.otherwise(len(PLACE_SIZES))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *DIGITS)


def numbers_in(text: Column, pattern: str = GROUPED) -> Column:
    """Numbers as written, Devanagari digits as ASCII."""
    return F.regexp_extract_all(ascii_digits(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))


def canonical_number(n: Column) -> Column:
    """No commas, no leading zeros, no trailing decimal zeros."""
    n = F.replace(n, F.lit(","), F.lit(""))
    n = F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return F.regexp_replace(n, r"\.$", "")


def allowed_numbers(source: Column) -> Column:
    """Numbers an answer may hold: both readings of the source, whole parts, emergency numbers."""
    both = F.transform(F.concat(numbers_in(source, PLAIN), numbers_in(source, GROUPED)), canonical_number)
    whole = F.transform(both, lambda n: F.substring_index(n, ".", 1))
    return F.array_distinct(F.concat(F.array(*map(F.lit, EMERGENCY)), both, whole))


def unsupported_numbers(answer: Column, allowed: Column) -> Column:
    """Numbers of an answer that are not allowed, in order, each once.

    A grouped number also passes if each of its comma parts is allowed.
    """

    def bad(n: Column) -> Column:
        parts = F.transform(F.split(n, ","), canonical_number)
        listed = (F.size(parts) > 1) & (F.size(F.array_except(parts, allowed)) == 0)
        return ~(F.array_contains(allowed, canonical_number(n)) | listed)

    return F.array_distinct(F.filter(numbers_in(answer), bad))


#: Words after which a lake's own name stands.
LAKE_WORDS = ("lake", "झील", "tal", "ताल", "tso", "dal")


def fold_name(name: Column) -> Column:
    return F.translate(F.lower(name), " -_.,'’", "")


def stem_name(folded: Column) -> Column:
    """Drop a closing word for lake where at least four bytes are left."""
    out = F.when(F.lit(False), folded)
    for word in LAKE_WORDS:
        rest = F.regexp_replace(folded, f"{word}$", "")
        out = out.when(F.endswith(folded, F.lit(word)) & (F.octet_length(rest) >= 4), rest)
    return out.otherwise(folded)


def mask_phone(phone: Column) -> Column:
    """The country code and two digits, and the last two."""
    stars = F.repeat(F.lit("*"), F.length(phone) - 7)
    return F.when(F.length(phone) < 7, F.lit("***")).otherwise(F.concat(F.left(phone, F.lit(5)), stars, F.right(phone, F.lit(2))))


def arrival_words(minutes: Column) -> Column:
    """Whole minutes, never rounded up; unknown is "soon"."""
    return F.when(minutes.isNull(), F.lit("soon")).otherwise(F.concat(F.floor(minutes).cast("string"), F.lit(" min")))


def first_text(*choices: Column) -> Column:
    """The first of the choices that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in choices])


def search_keys(name: Column, name_hi: Column | None = None) -> Column:
    """The four keys of a place as a struct."""
    latin = latin_key(name)
    hindi = hindi_key(F.coalesce(name_hi, F.lit(""))) if name_hi is not None else F.lit("")
    return F.struct(latin.alias("latin"), hindi.alias("hindi"), bare_key(latin).alias("bare"), skeleton(latin).alias("skeleton"))
