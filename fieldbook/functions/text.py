"""Text cells to values: everything is a built-in expression from Column to Column."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order decides which key wins when a location contains several.
STATE_KEYS = [
    "HI", "CA", "FL", "TX", "AZ", "CT", "TN", "MN", "MS", "NV", "NC", "PR", "MX", "Bermuda", "Scotland",
    "ON", "Japan", "GA", "OH", "KY", "SC", "CO", "MI", "IL", "NY",
]

# The keys of each region.
REGIONS = {
    "West": ["CA", "HI", "WA", "OR", "NV", "AZ", "CO", "ID", "MT", "NM", "UT", "AK"],
    "Midwest": ["IL", "IN", "IA", "MI", "MN", "MO", "NE", "OH", "WI"],
    "South": ["FL", "GA", "KY", "NC", "SC", "TN", "TX", "AL", "MS", "LA", "AR"],
    "Northeast": ["NY", "NJ", "PA", "CT", "RI", "MA", "VT", "NH", "ME"],
    "International": ["MX", "Bermuda", "Japan", "Scotland", "Canada", "ON"],
    "Other": ["PR"],
}

# Every character that counts as white space.
_WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def unescape(text: Column) -> Column:
    """Decode ``&name;``, ``&#233;`` and ``&#xE9;``; one pass, so ``&amp;lt;`` becomes ``&lt;``."""
    names = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def decoded(piece: Column) -> Column:
        # A piece is what follows one "&": entity, semicolon, rest.
        entity = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]*|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", 1)
        rest = F.substring(piece, F.length(entity) + 2, F.length(piece))
        code = F.when(entity.rlike("^#[xX]"), F.conv(F.substring(entity, F.lit(3), F.length(entity)), 16, 16)).when(
            entity.startswith("#"), F.conv(F.substring(entity, F.lit(2), F.length(entity)), 10, 16)
        )
        char = F.when(code.isNotNull(), F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(
            F.try_element_at(names, entity)
        )
        return F.when((entity == "") | char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    pieces = F.split(text, "&")
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(F.instr(text, "&") == 0, text).otherwise(F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, "")))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->|<[^>]*>", "")


def tidy(text: Column) -> Column:
    """Entities decoded, then any white space trimmed from both ends."""
    return F.btrim(unescape(text), F.lit(_WHITE))


def cell_text(html: Column) -> Column:
    """Visible text of a fragment."""
    return tidy(strip_tags(html))


def cell_texts(fragments: Column) -> Column:
    """Visible text of each fragment of an array; two steps, so that tags are searched once per fragment."""
    return F.transform(F.transform(fragments, strip_tags), tidy)


def capture(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return _null_if_empty(F.regexp_extract(text, pattern, group))


def number(text: Column) -> Column:
    """Lenient number: null for anything that is not plainly one (``E``, ``--``, ``1d``, ``NaN``)."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def to_par(text: Column, even_par_zero: bool = False) -> Column:
    """Score against par; ``E`` is null, or 0 on request."""
    return F.when(F.trim(text) == "E", F.lit(0.0)).otherwise(number(text)) if even_par_zero else number(text)


def currency(text: Column) -> Column:
    return number(F.regexp_replace(text, r"[$,]", ""))


def finish_position(text: Column, missed: float = -1.0) -> Column:
    """``T12`` -> 12; a dash or an empty cell is a missed cut; other text is null (see ``rejected_position``)."""
    bare = F.replace(text, F.lit("T"), F.lit(""))
    return F.when(bare.isin("-", ""), F.lit(missed)).otherwise(number(bare))


def rejected_position(text: Column) -> Column:
    """True where a position is given but cannot be read, to be counted by the caller."""
    return text.isNotNull() & finish_position(text).isNull()


def range_end_date(text: Column, year: Column) -> Column:
    """Last day of ``Jan 2 - 5`` / ``Feb 29 - Mar 3`` / ``17-Dec`` in the given season year; else null."""
    parts = F.split(text, "-")
    start, end = F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))
    season = year.cast("string")
    own_month = F.size(F.split(end, r"\s+")) == 2
    month_day = F.when(own_month, end).otherwise(F.concat_ws(" ", F.get(F.split(start, r"\s+"), F.lit(0)), end))
    ranged = F.try_to_date(F.concat_ws(" ", season, month_day), "yyyy MMM d")
    single = F.try_to_date(F.concat_ws("-", text, season), "d-MMM-yyyy")
    return F.when(text.contains("-"), F.when(end.rlike(r"\d"), ranged).otherwise(single))


def long_range_end_date(text: Column) -> Column:
    """Last day of ``January 16 - 19, 2025`` / ``April 30 - May 3, 2025`` (or a year in the first half only)."""
    halves = F.split(text, " - ")
    first, last = F.trim(F.get(halves, F.lit(0))), F.trim(F.element_at(halves, -1))
    year = F.coalesce(capture(last, r"(\d{4})\s*$"), capture(first, r"(\d{4})\s*$"))
    month = F.coalesce(capture(last, r"^([A-Za-z]+)"), capture(first, r"^([A-Za-z]+)"))
    day = capture(last, r"^(?:[A-Za-z]+\s+)?(\d{1,2})(?!\d)")
    return F.try_to_date(F.concat(month, F.lit(" "), day, F.lit(", "), year), "MMMM d, yyyy")


def state_of(location: Column) -> Column:
    """First key of the ordered list that the location contains, case-sensitive; else null."""
    return F.coalesce(*[F.when(location.contains(k), F.lit(k)) for k in STATE_KEYS])


def region_of(state: Column, regions: dict[str, list[str]] = REGIONS) -> Column:
    chain = F
    for region, keys in regions.items():
        chain = chain.when(state.isin(keys), F.lit(region))
    return chain.otherwise(F.lit("Unknown"))


def join_key(*parts: Column, sep: str = "_") -> Column:
    """Concatenated key; null if any part is null."""
    spaced = [x for p in parts for x in (F.lit(sep), p.cast("string"))][1:]
    return F.concat(*spaced)


def fixed_point(value: Column, places: int = 2) -> Column:
    """``%.2f`` text; null stays null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value.cast("double")))


def dnf_label(value: Column, code: float = 100.0) -> Column:
    """Text of a finish, with the missed-cut code shown as DNF."""
    return F.when(value == code, F.lit("DNF")).otherwise(value.cast("string"))
