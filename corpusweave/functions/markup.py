"""Column functions for references, links, names and lists in scraped records: built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusweave.functions.text import first_filled

# Law names in text, each with its key; and the section reference.
LAW_PATTERNS = (
    ("takanon", r"תקנון\s+הכנסת"),
    ("ethics", r"כללי\s+אתיקה(?:\s+לחברי\s+הכנסת)?"),
    ("yesod", r"חוק[־\-]יסוד\s*:\s*הכנסת"),
    ("parshanut", r"חוק\s+הפרשנות"),
    ("chok_knesset", r"חוק\s+הכנסת"),
)
SECTION = r"סעיף\s+(\d+[א-ת]?)"
# Name of a download without one (a neutral default), and fixed values: its suffix and its longest length.
DOCUMENT_NAME, DOCUMENT_SUFFIX, DOCUMENT_LENGTH = "document.docx", ".docx", 100
# Fixed value: brackets and their mirror images.
BRACKETS = ("()[]{}", ")(][}{")


def _or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def law_section(c: Column, urls: dict[str, str], patterns=LAW_PATTERNS, section: str = SECTION, anchor: str = "סעיף_") -> Column:
    """URL of the section that a text refers to: the law named first in it, and its first section; null without both.

    Combining marks are left out of sight. urls gives each law's page.
    """
    clean = F.regexp_replace(c, r"\p{Mn}", "")
    found = [F.struct(F.regexp_instr(clean, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(urls[key]).alias("url")) for i, (key, p) in enumerate(patterns) if key in urls]
    first = F.array_min(F.filter(F.array(*found), lambda f: f["at"] > 0))
    return F.concat(first["url"], F.lit("#" + anchor), _or_null(F.regexp_extract(clean, section, 1)))


def document_name(c: Column, default: str = DOCUMENT_NAME) -> Column:
    """Control characters and slashes gone, a default for nothing, one suffix, a hundred characters at most."""
    name = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f/\\]", ""))
    full = F.when(F.endswith(F.lower(name), F.lit(DOCUMENT_SUFFIX)), name).otherwise(F.concat(name, F.lit(DOCUMENT_SUFFIX)))
    cut = F.concat(F.substring(full, 1, DOCUMENT_LENGTH - len(DOCUMENT_SUFFIX)), F.lit(DOCUMENT_SUFFIX))
    return F.when(name == "", default).when(F.length(full) > DOCUMENT_LENGTH, cut).otherwise(full)


def absolute_links(c: Column, page: str, host: str) -> Column:
    """Markdown links with the page before bare fragments, the host before /wiki/ paths, and web addresses percent-decoded."""
    t = F.regexp_replace(c, r"\]\((?=#[^) ])", f"]({page}")
    t = F.regexp_replace(t, r"\]\(/wiki/", f"]({host}/wiki/")
    # text and addresses by turns: the text before each address, and the address
    parts = F.split(t, r"(?<=\]\()(?=https?://[^) ])")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(_percent_decoded(F.regexp_extract(p, r"^[^) ]+", 0)), F.regexp_replace(p, r"^[^) ]+", ""))))
    return F.array_join(decoded, "")


def _percent_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def unwrapped(c: Column) -> Column:
    """Objects of a model's JSON answer, as an array of JSON texts: an object with one key whose value is a list of objects gives
    these, a list its elements, anything else itself."""
    keys = F.json_object_keys(c)
    inner = F.get(F.map_values(F.from_json(c, "map<string, string>")), F.lit(0))
    one = (F.size(keys) == 1) & F.rlike(inner, F.lit(r"^\s*\[\s*\{"))
    shown = lambda x: F.from_json(x, "array<string>")
    return F.when(F.startswith(F.ltrim(c), F.lit("[")), shown(c)).when(one, shown(inner)).otherwise(F.array(c))


def attachment_urls(c: Column) -> Column:
    """Web addresses of a list parted by commas or line ends; null gives none."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,\n]"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.startswith(p, F.lit("http")))


def mirrored(c: Column) -> Column:
    return F.translate(c, *BRACKETS)


def reversed_lines(c: Column) -> Column:
    """Each line spelt backwards, lines in place."""
    return F.array_join(F.transform(F.split(c, "\n"), F.reverse), "\n")


def int_setting(c: Column, default: int, least: int = 1, most: int | None = None) -> Column:
    """struct<value, warned>: a whole number within bounds; what is no number gives the default, and is told of like a clamped one."""
    n = F.try_to_number(F.trim(c), F.lit("S999999999")).cast("int")
    held = F.greatest(n, F.lit(least)) if most is None else F.least(F.greatest(n, F.lit(least)), F.lit(most))
    return F.struct(F.when(n.isNull(), F.lit(default)).otherwise(held).alias("value"), (c.isNotNull() & (n.isNull() | (held != n))).alias("warned"))


def lock_key(c: Column) -> Column:
    """CRC-32 of a label: a number for a lock."""
    return F.crc32(c.cast("binary"))


def source_url(meta: Column, *keys: str, links: str = "ReferenceLinks") -> Column:
    """The first filled of some keys of JSON metadata, else the first of its links, else empty."""
    return F.coalesce(first_filled(*[F.get_json_object(meta, f"$.{k}") for k in keys], F.get_json_object(meta, f"$.{links}[0]")), F.lit(""))


def tag_title(item: Column, group: str, key: str) -> Column:
    """tags.group.key[0].title of a JSON item; empty wherever the way breaks off."""
    return F.coalesce(F.get_json_object(item, f"$.tags['{group}']['{key}'][0].title"), F.lit(""))


def number_after(c: Column, mark: str, until: str = ",") -> Column:
    """What stands between a mark and the next separator; empty without the mark."""
    return F.when(F.contains(c, F.lit(mark)), F.trim(F.split_part(F.get(F.split(c, mark, -1), F.lit(1)), F.lit(until), F.lit(1)))).otherwise("")


def greatest_listed(c: Column) -> Column:
    """The greatest of whole numbers parted by commas; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.filter(F.split(c, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).cast("int"))), F.lit(0))


def list_preview(items: Column, most: int = 3, total: Column | None = None) -> Column:
    """The first items, and how many more there are (of total, if the list was cut before)."""
    n = F.size(items) if total is None else total
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(n > most, F.concat(F.lit(" (+"), (n - most).cast("string"), F.lit(" more)"))).otherwise(""))


def page_links(parsed: Column) -> Column:
    """Titles of links of a saved wiki parse answer: pages of the main namespace that exist."""
    links = F.from_json(parsed, "parse struct<links: array<struct<ns: int, exists: string, `*`: string>>>")["parse"]["links"]
    return F.transform(F.filter(links, lambda x: (x["ns"] == 0) & x["exists"].isNotNull()), lambda x: x["*"])


def search_document(content: Column, file_name: Column, metadata: Column) -> Column:
    """Document of a field-weighted index: metadata under extracted_data, the title from the file's stem."""
    title = F.regexp_replace(F.substring_index(file_name, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.struct(content.alias("content"), F.struct(title.alias("title"), F.struct(metadata.alias("extracted_data")).alias("metadata")).alias("metadata"))
