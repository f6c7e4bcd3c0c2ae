"""Column functions on text: all built-in expressions, so that they stay in the JVM and push down with their projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that a normalized name writes plainly (maqaf, colon, gershayim, geresh), and what stands for them.
NAME_MARKS, NAME_PLAIN = "־:״׳", "- \"'"
# Entities, in the order in which they are decoded (so &amp;lt; ends as <).
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", ""), ("&#10;", "\n"))
# Fixed value: tags whose end is a line break.
BLOCK_TAGS = "p|div|li|h[1-6]|tr|br"
# Fixed value: a date at the begin of a text with a year from 1900 to 2039 and a possible month and day.
ISO_DATE = r"^(19[0-9]{2}|20[0-3][0-9])-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"


def norm_name(c: Column) -> Column:
    """One canonical form of a name; null stays null."""
    return F.trim(F.regexp_replace(F.translate(c, NAME_MARKS, NAME_PLAIN), r"[\s\x{00A0}]+", " "))


def base_title(c: Column) -> Column:
    """What stands before the first ' - '."""
    return F.trim(F.split_part(c, F.lit(" - "), F.lit(1)))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cs: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cs])


def content_hash(c: Column, strip: bool = False, digits: int = 64) -> Column:
    """SHA-256 in hex; strip removes white space at both ends first."""
    text = F.regexp_replace(c, r"^\s+|\s+$", "") if strip else c
    return F.substring(F.sha2(text, 256), 1, digits)


def tokens(c: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: t != "")


def ellipsis(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def full_text_note(c: Column) -> Column:
    return F.concat(F.lit("Available ("), F.format_number(F.length(c), 0), F.lit(" characters)"))


def first_line(c: Column) -> Column:
    return F.split_part(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(1))


def header_and_body(c: Column) -> Column:
    """struct<header, body>: parted at the first blank line; without one the whole text is the body."""
    parts = F.split(c, "\n\n", 2)
    return F.struct(F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).alias("header"), F.element_at(parts, -1).alias("body"))


def html_to_text(c: Column) -> Column:
    """Line breaks at block ends, tags gone, common entities decoded in their order, other entities gone, white space folded."""
    tags = F.regexp_replace(F.regexp_replace(c, rf"(?i)</(?:{BLOCK_TAGS})\s*>|<br\s*/?\s*>", "\n"), "<[^>]+>", "")
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, tags)
    blanks = F.translate(F.regexp_replace(plain, r"&#?\w+;", ""), "\t", " ")
    # what repeats a blank or begins a line goes; then what follows two line ends
    folded = F.regexp_replace(F.regexp_replace(blanks, r"(?<=[\n ]) +", ""), r"(?<=\n\n)\n+", "")
    return F.coalesce(F.regexp_replace(folded, r"^\s+|\s+$", ""), F.lit(""))


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def is_plausible_date(c: Column) -> Column:
    return F.rlike(c, F.lit(ISO_DATE))


def publish_date(c: Column) -> Column:
    """DD.MM.YYYY or YYYY-MM-DD... as a date; anything else, and impossible days, null."""
    dotted = F.when(F.rlike(c, F.lit(r"^\d{2}\.\d{2}\.\d{4}$")), F.try_to_date(c, "dd.MM.yyyy"))
    return F.coalesce(dotted, F.when(F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")))


def display_time(c: Column) -> Column:
    """ISO time as DD/MM/YYYY HH:MM; what cannot be read passes through."""
    return F.coalesce(F.date_format(F.try_to_timestamp(F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")), "dd/MM/yyyy HH:mm"), c)


def labelled_value(c: Column, labels: tuple[str, ...], value: str = r"[^\n]+") -> Column:
    """First non-blank line that stands under one of the labels ('label:' on a line of its own)."""
    found = F.regexp_extract_all(c, F.lit(rf"(?m)^(?:{'|'.join(labels)}):\n({value})"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))


def source_id(kind: Column, url: Column, path: Column) -> Column:
    """Readable label of where a document comes from."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    wiki = F.split_part(F.substring_index(F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "/+$", ""), "/", -1), F.lit("#"), F.lit(1))
    return F.when(kind == "wikitext", wiki).when(kind.isin("lexicon", "bk_csv"), kind).when(blank_to_null(path).isNotNull(), stem).otherwise("unknown")


def safe_file_name(c: Column, most_bytes: int = 180) -> Column:
    """Unsafe characters and runs of blanks become one underscore, none at the ends; a name over most_bytes of UTF-8 is cut at a
    whole character and ends in the first eight digits of its SHA-1."""
    clean = F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*_\s]+', "_"), "^_|_$", "")

    def fitted(name: Column) -> Column:
        # UTF-8 bytes of a character by its range; the longest beginning that fits is found by running sums
        width = lambda ch: F.octet_length(ch)
        chars = F.split(name, "")
        kept = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda a, ch: F.struct((a["n"] + width(ch)).alias("n"), (a["k"] + F.when(a["n"] + width(ch) <= most_bytes, 1).otherwise(0)).alias("k")), lambda a: a["k"])
        return F.concat(F.regexp_replace(F.substr(name, F.lit(1), kept), "_+$", ""), F.lit("_"), F.substring(F.sha1(name), 1, 8))

    return F.get(F.transform(F.array(clean), lambda n: F.when(F.octet_length(n) > most_bytes, fitted(n)).otherwise(n)), F.lit(0))


def page_name(c: Column) -> Column:
    """Base name of a path without one leading underscore."""
    return F.regexp_replace(F.substring_index(c, "/", -1), "^_", "")


def title_of_url(c: Column) -> Column:
    return F.replace(F.url_decode(F.replace(F.substring_index(c, "/", -1), F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" "))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of lower-case words, each padded with two blanks before and one behind."""
    grams = F.transform(tokens(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays of distinct values; of two empty ones, 0."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def script_share(c: Column, letters: str) -> Column:
    """Share of code points that fall into a regular-expression class, such as \\u0590-\\u05FF."""
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, f"[^{letters}]", "")), F.length(c)), F.lit(0.0))


def reverse_words(c: Column, letters: str) -> Column:
    """Each line's words that hold such letters are spelt backwards; lines under 30 % of them stay."""

    def line(x: Column) -> Column:
        words = F.transform(F.split(x, " "), lambda w: F.when(F.rlike(w, F.lit(f"[{letters}]")), F.reverse(w)).otherwise(w))
        return F.when(script_share(x, letters) < 0.3, x).otherwise(F.array_join(words, " "))

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def is_visual_order(c: Column, letters: str, final_letters: str, least: int = 10) -> Column:
    """Whether text is stored backwards: of its first 200 words in the script (at least ten), two begin with a final letter form."""
    words = F.slice(F.filter(F.transform(F.split(c, r"\s+"), lambda w: F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")), lambda w: F.rlike(w, F.lit(f"[{letters}]"))), 1, 200)
    return (F.size(words) >= least) & (F.size(F.filter(words, lambda w: F.rlike(w, F.lit(f"^[{final_letters}]")))) >= 2)


def scrub_urls(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def title_class(c: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], other: str = "other") -> Column:
    """Class of the first prefix table entry that a title begins with."""
    out = F.lit(other)
    for name, prefixes in reversed(classes):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(c, F.lit(p))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def error_kind(c: Column) -> Column:
    """Daily quota, rate limit or other failure, by what an error message says."""
    low = F.lower(c)
    daily = F.rlike(low, F.lit(r"per day|daily limit|\brpd\b"))
    return F.when(daily, "daily_quota").when(F.rlike(low, F.lit(r"rate limit|\brpm\b")), "rate_limit").otherwise("other")
