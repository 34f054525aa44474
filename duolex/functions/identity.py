"""Identities, names, labels and keys as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_quotes, squeezed, stripped

#: Blocks with precomposed Latin letters, ligatures and wide forms, whose decompositions make the translation tables.
_LATIN = (range(0xA0, 0x250), range(0xFB00, 0xFB07), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFF10, 0xFF5B))
# Names that stand for nobody.
PLACEHOLDERS = ("april general field", "democratic primary field", "district democratic field", "none listed")
# Categories of official texts and their groups.
OFFICIAL_GROUPS = {"dsa_national": "dsa", "dsa_state_local": "dsa", "dnc_national": "democratic", "state_democratic_party": "democratic"}


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters with a one-character decomposition (two strings), and those with a longer one."""
    one, longer = {}, {}
    for code in (c for block in _LATIN for c in block):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if bare and bare != chr(code):
            (one if len(bare) == 1 else longer)[chr(code)] = bare
    return "".join(one), "".join(one.values()), longer


_FROM, _TO, _LONGER = _decomposed()
_SPECIAL = f"[{_FROM}{''.join(_LONGER)}\u0300-\u036f]"


def accentless(text: Column) -> Column:
    """Compatibility decomposition of Latin letters without combining marks; a text without any special letter is left at once, one of ASCII without a look at the long class of those."""
    plain = F.regexp_replace(F.translate(text, _FROM, _TO), "[\u0300-\u036f]+", "")
    for letter, bare in _LONGER.items():
        plain = F.replace(plain, F.lit(letter), F.lit(bare))
    return F.when(text.rlike(r"[^\x00-\x7F]") & text.rlike(_SPECIAL), plain).otherwise(text)


def identity(text: Column) -> Column:
    """Accents off, lower case, everything but letters and digits of ASCII as single spaces."""
    return F.trim(F.regexp_replace(F.replace(F.lower(accentless(text)), F.lit("ß"), F.lit("ss")), "[^a-z0-9]+", " "))


def text_identity(text: Column) -> Column:
    """Decomposed, plain quotes and dashes, single spaces, lower case; marks of letters that have no table here stay."""
    return F.lower(squeezed(plain_quotes(accentless(text))))


def labels(cell: Column) -> Column:
    """The distinct non-blank labels of a pipe list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), r"\|"), stripped), lambda x: x != "")))


def names(cell: Column) -> Column:
    """The names of a list with semicolons or pipes, in order, without those that stand for nobody."""
    parts = F.transform(F.split(F.coalesce(cell, F.lit("")), "[;|]"), stripped)
    return F.filter(parts, lambda x: (x != "") & ~F.lower(squeezed(x)).isin([*PLACEHOLDERS]))


# What may follow a name.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def name_tokens(name: Column) -> Column:
    """A name's words: accents, brackets with what is in them, quotes and what may follow a name off, lower case."""
    low = F.regexp_replace(F.lower(accentless(name)), r"\([^)]*\)|[\"“”‘’]", " ")
    plain = F.regexp_replace(F.regexp_replace(low, rf"\b({'|'.join(SUFFIXES)})\b", " "), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def name_key(name: Column) -> Column:
    """What two names of one person share: the given name, or initials written together, and the last one; a single word itself; NULL without words."""

    def key(words: Column) -> Column:
        last, given = F.element_at(words, -1), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
        first = F.when(F.forall(given, lambda w: F.length(w) == 1), F.array_join(given, "")).otherwise(words[0])
        return F.when(F.size(words) == 1, words[0]).when(F.size(words) > 1, F.concat_ws(" ", first, last))

    return F.transform(F.array(name_tokens(name)), key)[0]


def first_url(cell: Column) -> Column:
    return stripped(F.substring_index(cell, ";", 1))


def official_group(categories: Column, strict: bool = True) -> Column:
    """The one group of a pipe list of categories; unknown or mixed ones are an error, or NULL if not strict."""
    table = F.create_map(*(F.lit(x) for pair in OFFICIAL_GROUPS.items() for x in pair))
    groups = F.array_distinct(F.transform(labels(categories), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("?"))))
    good = (F.size(groups) == 1) & (groups[0] != "?")
    bad = F.raise_error(F.concat(F.lit("unsupported or mixed categories: "), F.coalesce(categories, F.lit("")))) if strict else F.lit(None).cast("string")
    return F.when(good, groups[0]).otherwise(bad)


def seeded_key(seed: int, value: Column) -> Column:
    """Sixteen hexadecimal digits that order rows at random, the same for a seed. They sort as the numbers do that they write."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value.cast("string")), 256), 1, 16)


def canonical_json(**fields: Column) -> Column:
    """The fields as compact JSON with sorted keys; null fields are written."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def canonical_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def pretty(label: Column) -> Column:
    """Underscores to spaces, capitals first."""
    return F.initcap(F.replace(label, F.lit("_"), F.lit(" ")))


def wrapped(text: str, width: int, lines: int = 4) -> list[str]:
    """Lines of whole words up to width; what doesn't fit in the last one is an ellipsis. For charts, on the driver."""
    import textwrap

    made = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
    return made if len(made) <= lines else [*made[: lines - 1], made[lines - 1].rstrip(".,;:") + "…"]


def tint(color: str, amount: float) -> str:
    """The colour mixed with white."""
    mixed = (round(c + (255 - c) * amount) for c in bytes.fromhex(color.lstrip("#")))
    return "#" + bytes(mixed).hex().upper()
