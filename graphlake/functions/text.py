"""Text scalars as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: a line that heads a section, case-insensitively; the numeral's letters match in any case, so "part did it" does too
HEADING = r"(?iU)^(CHAPTER|PART|SECTION|BOOK)\s+[IVXLCDM\d]+\.?\s*[:.\-]?\s*(.*)$"
# fixed value: a line in capitals
CAPITALS = r"^[A-Z][A-Z0-9 ,'\-:]{3,70}$"
# fixed values: banners around the body of a public-domain e-book
_START = r"(?is)^.*?\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*"
_END = r"(?is)\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK.*$"
# fixed value: the pieces of an identifier in mixed case
_CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z0-9]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_boilerplate(c: Column) -> Column:
    """The body after the first start banner and before the end banner that follows."""
    return strip(F.regexp_replace(F.regexp_replace(c, _START, ""), _END, ""))


def normalize_newlines(c: Column) -> Column:
    """LF line ends, and no more than one blank line in a row."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def clean_text(c: Column) -> Column:
    return normalize_newlines(strip_boilerplate(c))


def is_heading(line: Column) -> Column:
    s = strip(line)
    words = F.size(F.split(s, r"(?U)\s+"))
    return (F.length(s) > 0) & (F.length(s) <= 90) & (s.rlike(HEADING) | (s.rlike(CAPITALS) & (words <= 12)))


def words(c: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def paragraphs(c: Column) -> Column:
    """Parts between blank lines that are not blank themselves."""
    return F.filter(F.split(c, r"\n\s*\n"), lambda p: strip(p) != "")


def truncated_label(c: Column, limit: int = 80) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def slugify(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, limit)


def split_identifier(c: Column) -> Column:
    """Lower-case parts of an identifier, at underscores, other marks and changes of case."""
    # the pieces' pattern never runs over a mark, as it has letters and digits only; where it has none (other alphabets) nothing is said
    return F.transform(F.regexp_extract_all(c, F.lit(_CAMEL), F.lit(0)), F.lower)


def code_fences_stripped(c: Column) -> Column:
    """A reply without the fence lines around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


# fixed values: what a node's page shows elsewhere
CORE_KEYS = ["id", "label", "text", "description", "_labels", "created_by", "topic"]


def shown_metadata(c: Column, hidden: list[str] = CORE_KEYS) -> Column:
    """A map without the keys that are shown elsewhere."""
    return F.map_filter(c, lambda k, v: ~k.isin(hidden))


def explained(explanation: Column, weight: Column) -> Column:
    """An explanation with its weight in two decimals; null where one of them is missing.

    The decimals are those of the weight's exact binary value, where the JVM would round its shortest decimal form.
    """

    @F.pandas_udf("string")
    def decimals(w: pd.Series) -> pd.Series:
        return w.map(lambda x: f"{x:.2f}", na_action="ignore")

    return F.when(explanation != "", F.concat(explanation, F.lit(" (weight "), decimals(weight), F.lit(")")))


def flattened_metadata(c: Column) -> Column:
    return F.transform_keys(c, lambda k, v: F.concat(F.lit("meta_"), k))


def first_text(*columns: Column) -> Column:
    """The first that is not null or empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def relation_note(rel_type: Column, explanation: Column) -> Column:
    return F.concat(rel_type, F.lit(" (via "), F.substring(F.coalesce(explanation, F.lit("")), 1, 120), F.lit(")"))


def context_block(node_id: Column, label: Column, text: Column, extra: Column) -> Column:
    note = F.when(extra != "", F.concat(F.lit(" - "), extra)).otherwise("")
    return F.concat(F.lit("["), node_id, F.lit("] "), F.coalesce(label, F.lit("")), note, F.lit("\n"), F.substring(text, 1, 700))


def tokens(c: Column, stop_words: list[str] | None = None, bigrams: bool = True) -> Column:
    """Terms of the vector space: lower-case tokens of two or more letters, digits or underscores, without stop words, then pairs of neighbours."""
    # the pattern itself passes over stop words: a filter over arrays would compare every token with the whole list
    part = r"[\p{L}\p{N}_]"
    # grouped by first letter, so a token is held against few of them
    by_letter = {w[0]: [x[1:] for x in stop_words if x[0] == w[0]] for w in stop_words or []}
    listed = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in by_letter.items())
    stops = f"(?!(?:{listed})(?!{part}))" if stop_words else ""
    single = F.regexp_extract_all(F.lower(c), F.lit(f"(?<!{part}){stops}{TOKEN}"), F.lit(0))
    if not bigrams:
        return single
    after = F.slice(single, 2, F.greatest(F.size(single) - 1, F.lit(0)))
    first = F.slice(single, 1, F.greatest(F.size(single) - 1, F.lit(0)))
    return F.concat(single, F.zip_with(first, after, lambda a, b: F.concat(a, F.lit(" "), b)))


# fixed values: what stands before each fact of a card, and before the source
_CARD = {"signature": "signature: ", "base_classes": "inherits from: ", "path": "in file: ", "decorators": "decorators: ", "docstring": "", "calls_raw": "calls: "}
_CODE = "\n\ncode:\n"


def embedding_card(s: dict[str, Column], calls: int = 20) -> Column:
    """What is embedded for a code symbol: its kind and name, a line for each fact it has, its source."""
    listed = lambda c: F.nullif(F.array_join(c, ", "), F.lit(""))
    facts = {
        "signature": F.when(s["signature"] != "", F.concat(s["name"], s["signature"])),
        "base_classes": listed(s["base_classes"]),
        "path": s["path"],
        "decorators": listed(s["decorators"]),
        "docstring": F.nullif(s["docstring"], F.lit("")),
        "calls_raw": listed(F.slice(F.array_sort(F.array_distinct(s["calls_raw"])), 1, calls)),
    }
    first = F.concat_ws(": ", s["kind"], s["qualified_name"])
    # concat_ws passes over facts that are null
    return F.concat(F.concat_ws("\n", first, *[F.concat(F.lit(label), facts[name]) for name, label in _CARD.items()]), F.lit(_CODE), F.coalesce(s["text"], F.lit("")))


def sparse_card(s: dict[str, Column]) -> Column:
    """The card and the identifier parts of name, callees and bases."""
    callees = F.flatten(F.transform(s["calls_raw"], lambda x: split_identifier(F.element_at(F.split(x, r"\."), -1))))
    bases = F.flatten(F.transform(s["base_classes"], split_identifier))
    return F.concat(embedding_card(s), F.lit("\n"), F.array_join(F.concat(split_identifier(s["name"]), callees, bases), " "))


def point_id(c: Column) -> Column:
    """Version 5 UUID of the node id in the URL namespace."""
    name = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(F.lit("node:"), c), "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.conv(F.substring(name, 17, 1), 16, 10).cast("int") % 4 + 1)
    return F.concat(F.substring(name, 1, 8), F.lit("-"), F.substring(name, 9, 4), F.lit("-5"), F.substring(name, 14, 3), F.lit("-"), variant, F.substring(name, 18, 3), F.lit("-"), F.substring(name, 21, 12))
