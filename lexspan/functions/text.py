"""String expressions shared by search, audits, set building and scoring."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that are left out before a query is compared with a text.
STOPWORDS = (
    "a an the of to in on at for from by with and or but not no is are was were be been "
    "being it its that this these those you your they them their he she his her i we our "
    "when where why how what who which as if then than so very much many most more some "
    "any all only just about into out up down over under after before until while do does "
    "did done have has had get gets got make makes made you're dont don't never ever also "
    "something someone anything nothing things thing way place person people know knows"
).split()

# Part-of-speech names as printed.
POS_NAMES = {"noun": "n.", "verb": "v.", "adj": "adj.", "adv": "adv."}

# Fixed values: (suffix, letters to strip, letters to add), tried in this order.
DERIVATIONS = [
    ("er", 2, ""),
    ("er", 3, "e"),
    ("ing", 3, ""),
    ("ion", 3, "e"),
    ("tion", 4, "te"),
    ("ment", 4, ""),
    ("ance", 4, ""),
    ("al", 2, ""),
]

MAX_QUERY_CHARS = 500

# White space as a browser sees it: ASCII, no-break, zero-width mark and the Unicode spaces.
_RARE_SPACES = "\u00a0\ufeff\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
SPACES = " \t\n\x0b\f\r" + _RARE_SPACES


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def norm(text: Column) -> Column:
    return F.lower(strip(text))


slug = norm


def content_tokens(query: Column) -> Column:
    """Runs of at least three letters that are no stopwords."""
    runs = F.regexp_extract_all(F.lower(query), F.lit("[a-z]{3,}"), F.lit(0))
    return F.filter(runs, lambda t: ~t.isin(STOPWORDS))


def _stems(tokens: Column) -> Column:
    return F.transform(F.filter(tokens, lambda t: F.length(t) >= 4), lambda t: F.substring(t, 1, 4))


def word_stems(word: Column) -> Column:
    """First four letters of each run of at least four letters."""
    return F.transform(
        F.regexp_extract_all(F.lower(word), F.lit("[a-z]{4,}"), F.lit(0)), lambda t: F.substring(t, 1, 4))


def query_stems(query: Column) -> Column:
    """First four letters of each content token; compute once per query, not per hit."""
    return F.array_distinct(_stems(content_tokens(query)))


def echoes_stems(word: Column, stems: Column) -> Column:
    return F.arrays_overlap(word_stems(word), stems)


def echoes(word: Column, query: Column) -> Column:
    """Does any token of the word share its first four letters with a content token?"""
    return echoes_stems(word, query_stems(query))


def padded_phrase(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(kept, " +", " ")), F.lit(" "))


def contains_phrase(query: Column, target: Column) -> Column:
    return F.contains(padded_phrase(query), padded_phrase(target))


def lexical_overlap(query: Column, target: Column) -> Column:
    """How much of the target the query gives away: head_noun, stem_shared or none."""
    padded = padded_phrase(query)
    parts = F.split(F.trim(padded_phrase(target)), " ")
    head = (F.size(parts) > 1) & F.exists(
        parts,
        lambda p: (F.length(p) >= 3) & F.contains(padded, F.concat(F.lit(" "), p, F.lit(" "))),
    )
    return (
        F.when(head, "head_noun").when(echoes(target, query), "stem_shared").otherwise("none")
    )


def word_count(text: Column) -> Column:
    plain = strip(F.translate(text, _RARE_SPACES, " " * len(_RARE_SPACES)))
    # An empty text splits into one empty piece.
    return F.size(F.split(plain, r"\s+")) - (plain == "").cast("int")


# Query length classes by word count.
LENGTHS = ["<=8 words", "9-12 words", "13-16 words", "17+ words"]


def length_bucket(query: Column) -> Column:
    """Class of at most 8, 12, 16 or more words. A lookup by count, so the count is taken once."""
    by_count = [LENGTHS[(n > 8) + (n > 12) + (n > 16)] for n in range(18)]
    return F.element_at(F.array(*[F.lit(label) for label in by_count]), F.least(word_count(query), F.lit(17)) + 1)


def token_class(target: Column) -> Column:
    return F.when(target.rlike("[ _-]"), "multi").otherwise("single")


def split_csv(cell: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), strip), lambda t: t != "")


def reachable_flag(cell: Column) -> Column:
    return ~F.coalesce(strip(cell), F.lit("")).rlike("(?i)^(false|0|no)$")


def mentions_word(text: Column, word: Column) -> Column:
    """Whole-word, case-insensitive mention; the word is taken literally."""
    literal = F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(F.lit(r"(?i)(?<!\w)(?=\w)\Q"), literal, F.lit(r"\E(?<=\w)(?!\w)"))
    return F.regexp_like(text, pattern)


def usable_definition(word: Column, definition: Column) -> Column:
    return (definition != "") & (word_count(definition) >= 3) & ~mentions_word(definition, word)


def junk(word: Column) -> Column:
    """A lemma that cannot be an answer: capitalised, with a digit, or with odd characters."""
    return word.rlike("^[A-Z]") | word.rlike("[0-9]") | word.rlike("[^A-Za-z0-9 _'-]")


def categories(word: Column, collides: Column) -> dict[str, Column]:
    """Vocabulary categories by name. `collides`: another spelling has the same lower case."""
    return {
        "multiword": word.rlike("[ _]"),
        "capitalised": word.rlike("^[A-Z]"),
        "digit": word.rlike("[0-9]"),
        "hyphen": F.contains(word, F.lit("-")),
        "apostrophe": F.contains(word, F.lit("'")),
        "other_punct": word.rlike("[^A-Za-z0-9 _'-]"),
        "case_collision": collides,
        "clean_single": word.rlike("^[a-z]+$"),
    }


def url_component(text: Column) -> Column:
    """Percent-encoding of a URL component; form encoding differs in these few characters."""
    encoded = F.url_encode(text)
    for form, plain in [
        ("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"),
    ]:
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def pos_of_key(sense_key: Column) -> Column:
    return F.substring_index(sense_key, ":", 1)


def pos_name(sense_key: Column) -> Column:
    pos = pos_of_key(sense_key)
    out = F.when(pos == "noun", POS_NAMES["noun"])
    for key in ("verb", "adj", "adv"):
        out = out.when(pos == key, POS_NAMES[key])
    return out.otherwise(pos)


def row_id(prefix: str, number: Column) -> Column:
    """`authored-0001`; longer numbers keep all their digits."""
    digits = number.cast("string")
    padded = F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))
    return F.concat(F.lit(f"{prefix}-"), padded)


def hash_order(seed: str, word: Column) -> Column:
    """Reproducible pseudo-random order, the same under any partitioning."""
    return F.md5(F.concat(F.lit(seed), word)) if seed else F.md5(word)


def request_rejection(query: Column) -> Column:
    """Reason a lookup is refused, null when it is fine."""
    # The two messages.
    return (
        F.when(query.isNull() | (query == ""), "query is required and must be a string")
        .when(F.length(query) > MAX_QUERY_CHARS, "query too long (max 500 characters)")
    )
