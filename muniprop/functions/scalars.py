"""Scalar Column functions (normalisers, parsers, formatters).

All helpers take and return ``Column`` objects built from ``pyspark.sql.functions``; nothing
here runs Python per row. Plain expressions are compiled by whole-stage codegen; the few
higher-order functions (``transform``/``filter``/``aggregate`` over short lists) are
evaluated inside the JVM without generated code.

Missing markers differ by function on purpose (they follow the source semantics):
``present_text`` (addresses / keys, case-sensitive markers), ``missing_label`` (hierarchy
and category columns, case-insensitive markers incl. ``none``/``null``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muniprop.functions import dims

# FIXED VALUES: placeholder texts, map search prefix, problem-status tokens.
ADDRESS_MISSING_MARKERS = ("", "-", "nan", "<na>")
LABEL_MISSING_MARKERS = ("", "-", "nan", "<na>", "none", "null")
MAPS_SEARCH_PREFIX = "https://www.google.com/maps/search/?api=1&query="
_PREFIX_RE = MAPS_SEARCH_PREFIX.replace(".", "\\.").replace("?", "\\?")
PROBLEM_STATUS_TOKENS = ("riving", "brenning", "kondemn", "ikke godkjent")
UNKNOWN_KOMMUNE_LABEL = "Ukjent Kommune"
MISSING = "MISSING"
SUBUNIT_PATTERN = r"^(.+?)\s*\[(.+),\s*(\d+(?:\.\d+)?)\]$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- generic text helpers


# Everything that counts as white space in Unicode text, with the ASCII separators 1C-1F: sheets
# hold non-breaking blanks.
WHITESPACE = "".join(
    map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE) + "]"
# The same for text without other characters, where short classes do (several times faster).
ASCII_WHITESPACE = "".join(c for c in WHITESPACE if c < "\x80")
ASCII_WS_CLASS = r"[\t-\r\x1c-\x20]"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def trim_ws(c: Column | str) -> Column:
    """Strip leading/trailing whitespace of any kind (``trim`` only strips spaces)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def collapse_ws(c: Column | str, source: Column | None = None) -> Column:
    """Collapse whitespace runs to one space and strip the ends. ``source`` is the text that ``c`` is
    made of, where that is cheaper to look at."""
    v = col(c)
    # After the replacement only plain spaces are left at the ends.
    plain = F.trim(F.regexp_replace(v, ASCII_WS_CLASS + "+", " "))
    return F.when(is_ascii(v if source is None else source), plain).otherwise(F.trim(F.regexp_replace(v, WS_CLASS + "+", " ")))


def duck_round(c: Column | str, digits: int = 2) -> Column:
    """Round half away from zero on the binary value (``round(x * 10^d) / 10^d``)."""
    scale = float(10**digits)
    return F.round(col(c) * F.lit(scale), 0) / F.lit(scale)


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    """``round(100 * part / nullif(whole, 0), d)`` in double arithmetic."""
    return duck_round(F.lit(100.0) * col(part).cast("double") / F.nullif(col(whole).cast("double"), F.lit(0.0)), digits)


def tolerant_double(c: Column | str) -> Column:
    """Trimmed text -> double; unparsable, NaN and infinities -> null."""
    return finite(trim_ws(col(c).cast("string")).try_cast("double"))


def finite(v: Column) -> Column:
    """A double, null for NaN and infinities."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(v)


# ---------------------------------------------------------------- F01 .. F03 name keys


def kommune_key(c: Column | str) -> Column:
    """SQL-form municipality key; removes ' Kommune' / ' kommune' anywhere."""
    return F.lower(F.trim(F.replace(F.replace(col(c), F.lit(" Kommune"), F.lit("")), F.lit(" kommune"), F.lit(""))))


def kommune_label(c: Column | str) -> Column:
    """Display label, always ending in 'Kommune'."""
    name = collapse_ws(col(c))
    return (
        F.when(name.isNull() | (name == ""), F.lit(UNKNOWN_KOMMUNE_LABEL))
        .when(F.lower(name).endswith(" kommune"), name)
        .otherwise(F.concat(name, F.lit(" Kommune")))
    )


def selected_key(c: Column | str) -> Column:
    """Python-form key; collapse whitespace, lower, drop one trailing ' kommune'."""
    v = F.lower(collapse_ws(F.coalesce(col(c).cast("string"), F.lit(""))))
    return F.regexp_replace(v, " kommune$", "")


def name_norm(c: Column | str) -> Column:
    """F02b / F03: '_' -> space, collapse whitespace, lower."""
    return F.lower(collapse_ws(F.replace(col(c), F.lit("_"), F.lit(" ")), col(c)))


# ---------------------------------------------------------------- F04 .. F07 parsing


def present_text(c: Column | str) -> Column:
    """Not null and stripped text not '', '-', 'nan', '<na>' (case-sensitive)."""
    v = trim_ws(col(c).cast("string"))
    return col(c).isNotNull() & ~v.isin(*ADDRESS_MISSING_MARKERS)


def list_value_missing(c: Column | str) -> Column:
    """Ownership-list missing markers: null, '', '-', 'nan' / '<na>' in any case."""
    return col(c).isNull() | F.lower(trim_ws(col(c))).isin("", "-", "nan", "<na>")


def missing_label(c: Column | str) -> Column:
    """F07b/c: null or lower-stripped text in '', '-', 'nan', '<na>', 'none', 'null'."""
    return col(c).isNull() | F.lower(trim_ws(col(c).cast("string"))).isin(*LABEL_MISSING_MARKERS)


def split_list(c: Column | str) -> Column:
    """split on ';' or ',', strip parts, drop empty parts; missing -> empty array."""
    v = col(c)
    pieces = F.split(F.translate(v, ",", ";"), ";")
    plain = F.transform(pieces, lambda x: F.btrim(x, F.lit(ASCII_WHITESPACE)))
    parts = F.when(is_ascii(v), plain).otherwise(F.transform(pieces, lambda x: F.btrim(x, F.lit(WHITESPACE))))
    return F.when(list_value_missing(c), F.array().cast("array<string>")).otherwise(
        F.filter(parts, lambda x: x != "")
    )


def code_ids(c: Column | str) -> Column:
    """every digit run as a number (empty array when none); a run of more than 38 digits is null."""
    return F.transform(
        F.coalesce(F.regexp_extract_all(col(c), F.lit(r"(\d+)"), 1), F.array().cast("array<string>")),
        lambda x: x.try_cast("decimal(38,0)"),
    )


def holds_code_zero(c: Column | str) -> Column:
    """Whether 0 is among the ``code_ids``, without making them."""
    return col(c).rlike(r"(?<!\d)0+(?!\d)")


def parse_percent(c: Column | str) -> Column:
    """first signed decimal number in the text; none (as in every missing marker) -> null."""
    return F.nullif(F.regexp_extract(col(c), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


# ---------------------------------------------------------------- F08 .. F15 addresses & keys


def postal_text(c: Column | str) -> Column:
    """postal code as written (leading zero kept); missing -> ''."""
    return F.when(present_text(c), trim_ws(col(c))).otherwise(F.lit(""))


def postal_int(c: Column | str) -> Column:
    """postal code through an integer ('0150' -> '150'); unparsable -> stripped text."""
    d = tolerant_double(c)
    return (
        F.when(col(c).isNull(), F.lit(""))
        .when(d.isNotNull(), F.coalesce(_whole_text(d), trim_ws(col(c))))
        .otherwise(trim_ws(col(c)))
    )


def _whole_text(d: Column) -> Column:
    """A double cut to a whole number, as text; null beyond 38 digits."""
    return F.when(F.abs(d) < F.lit(9e15), d.try_cast("bigint").cast("string")).otherwise(
        d.try_cast("decimal(38,0)").cast("string")
    )


def house_number(c: Column | str) -> Column:
    """a whole number, also as a float or as text ('12.0') -> integer text; other text
    ('12B') as written; null, NaN and blanks -> ''."""
    return house_text(trim_ws(col(c).cast("string")))


def house_text(v: Column) -> Column:
    """F10 of a trimmed text. It is looked at several times: a column is best."""
    whole = v.try_cast("decimal(38,0)")  # of a large double, written as 1.5E7
    large = F.when(whole.cast("double") == v.try_cast("double"), whole.cast("string"))
    return (
        F.when(v.isNull() | (v == "NaN"), F.lit(""))
        .when(v.rlike(r"^-?[0-9]+\.0+$"), F.substring_index(v, ".", 1))
        .when(v.rlike(r"^-?[0-9.]+E[0-9]+$"), F.coalesce(large, v))
        .otherwise(v)
    )


def address(name: Column | str, number: Column | str) -> Column:
    """'name number' if both, the name alone if no number, else ''."""
    return address_text(col(name), house_number(number))


def address_text(n: Column, k: Column) -> Column:
    """F11 from the name and the house number's text."""
    return (
        F.when(n.isNotNull() & (k != ""), F.concat(n, F.lit(" "), k))
        .when(n.isNotNull(), n)
        .otherwise(F.lit(""))
    )


def full_address(name: Column | str, number: Column | str, postal: Column | str, place: Column | str) -> Column:
    """'name[ number][, postal][ place]'; '' when the name is missing."""
    town = F.when(present_text(place), trim_ws(col(place)))
    return F.when(present_text(name), full_address_text(trim_ws(col(name)), house_number(number), postal_text(postal), town)).otherwise(F.lit(""))


def full_address_text(name: Column, number: Column, post: Column, town: Column) -> Column:
    """F12 from its parts, trimmed: a name, the texts of number and postal code, a place or null."""
    street = F.when(number != "", F.concat(name, F.lit(" "), number)).otherwise(name)
    with_post = F.when(post != "", F.concat(street, F.lit(", "), post)).otherwise(street)
    return F.when(town.isNotNull(), F.concat(with_post, F.lit(" "), town)).otherwise(with_post)


def cadastre_key(knr: Column | str, gnr: Column | str, bnr: Column | str) -> Column:
    """'knr-gnr-bnr' from three integers; '' when any part is missing."""
    parts = [col(knr), col(gnr), col(bnr)]
    ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(ok, F.concat_ws("-", *[p.cast("bigint").cast("string") for p in parts])).otherwise(F.lit(""))


def short_property_id(c: Column | str) -> Column:
    """'knr-gnr-bnr-fnr-snr' -> 'knr-gnr-bnr'; fewer parts unchanged; missing -> ''."""
    parts = F.split(col(c), "-")
    return (
        F.when(col(c).isNull() | (col(c) == ""), F.lit(""))
        .when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "-"))
        .otherwise(col(c))
    )


def valid_key(c: Column | str) -> Column:
    """key present and not '' / '-' after stripping."""
    v = trim_ws(col(c).cast("string"))
    return col(c).isNotNull() & (v != "") & (v != "-")


# ---------------------------------------------------------------- F16 .. F23 codes


def tolerant_int(c: Column | str) -> Column:
    """F16: null/blank/unparsable -> null; otherwise int(float(x)), truncating toward zero. Values
    beyond 64 bits are null (no code, flag or count is that large)."""
    return tolerant_double(c).try_cast("bigint")


def age_band(tek: Column | str) -> Column:
    """regulation -> age band; 'Pre-1949', '' and null land in 'Unknown'."""
    t = col(tek)
    return (
        F.when(t.isin("TEK17", "TEK10"), F.lit("2010+"))
        .when(t.isin("TEK07", "TEK97"), F.lit("1997-2009"))
        .when(t.startswith("BF"), F.lit("Pre-1997"))
        .otherwise(F.lit("Unknown"))
    )


AGE_BAND_ORDER = {"Pre-1997": 1, "1997-2009": 2, "2010+": 3}


def age_band_order(band: Column | str) -> Column:
    b = col(band)
    out = F.lit(4)
    for name, rank in reversed(list(AGE_BAND_ORDER.items())):
        out = F.when(b == name, F.lit(rank)).otherwise(out)
    return out


def regulation_date(c: Column | str) -> Column:
    """Date of the first 10 characters in strict yyyy-MM-dd form; anything else -> null."""
    head = F.substring(col(c), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def regulation_index(d: Column | str) -> Column:
    """0 for no date, 1.. for the regulations newest first, len+1 for the fallback."""
    out = F.lit(len(dims.REGULATIONS) + 1)
    for i, (_, start, _, _) in reversed(list(enumerate(dims.REGULATIONS, start=1))):
        out = F.when(col(d) >= F.lit(start), F.lit(i)).otherwise(out)
    return F.when(col(d).isNull(), F.lit(0)).otherwise(out)


def regulation_texts(index: Column | str) -> tuple[Column, Column, Column]:
    """(standard, in-force text, period text) of a regulation index; 0 -> three ''."""
    table = [("", "", "")] + [(n, f, p) for n, _, f, p in dims.REGULATIONS] + [dims.REGULATION_FALLBACK]
    return tuple(
        F.element_at(F.array(*[F.lit(row[k]) for row in table]), col(index) + 1) for k in range(3)
    )


def regulation(c: Column | str) -> tuple[Column, Column, Column]:
    """(standard, in-force text, period text) by date; blank/invalid -> three ''.

    Single-column form; ``add_regulation`` stages the date and index as columns so the date is
    parsed once per row."""
    return regulation_texts(regulation_index(regulation_date(c)))


def category_norm(c: Column | str) -> Column:
    """missing label -> 'Annet', otherwise the stripped text."""
    return F.when(missing_label(c), F.lit(dims.CATEGORY_FALLBACK)).otherwise(trim_ws(col(c).cast("string")))


def type_name(l1: Column | str, l2: Column | str, l3: Column | str) -> Column:
    """most specific non-empty level."""
    return F.coalesce(F.nullif(col(l3), F.lit("")), F.nullif(col(l2), F.lit("")), F.coalesce(col(l1), F.lit("")))


def status_name_expr(c: Column | str) -> Column:
    """F20 as a literal-free CASE over the 19 status ids (null / unknown -> '')."""
    out = F.lit("")
    v = col(c)
    for k, name in sorted(dims.BUILDING_STATUS.items(), reverse=True):
        out = F.when(v == F.lit(k), F.lit(name)).otherwise(out)
    return F.when(v.isNull(), F.lit("")).otherwise(out)


def ownership_type_name(c: Column | str) -> Column:
    """null -> '', known id -> name, otherwise 'Unknown (id)'."""
    v = col(c)
    out = F.concat(F.lit("Unknown ("), v.cast("string"), F.lit(")"))
    for k, name in sorted(dims.OWNERSHIP_TYPES.items(), reverse=True):
        out = F.when(v == F.lit(k), F.lit(name)).otherwise(out)
    return F.when(v.isNull(), F.lit("")).otherwise(out)


def problem_status(c: Column | str) -> Column:
    """Status mentions demolition, burning, condemnation or non-approval."""
    v = F.lower(F.coalesce(col(c), F.lit("")))
    out = F.lit(False)
    for token in PROBLEM_STATUS_TOKENS:
        out = out | v.contains(token)
    return out


# ---------------------------------------------------------------- F25 .. F29 URLs, files, sub-units


def percent_encode(c: Column | str) -> Column:
    """Percent-encode like a URL path quote: space -> %20, keep letters, digits, '_.-~/'."""
    e = F.url_encode(col(c))
    e = F.replace(e, F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    e = F.replace(e, F.lit("%7E"), F.lit("~"))
    return F.replace(e, F.lit("%2F"), F.lit("/"))


def _maps_url(parts: list[Column]) -> Column:
    """Join non-empty parts by spaces; '' when there is no part (each part evaluated once)."""
    joined = F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")
    url = F.concat(F.lit(MAPS_SEARCH_PREFIX), percent_encode(joined))
    return F.regexp_replace(url, "^" + _PREFIX_RE + "$", "")  # bare prefix: no parts


def _norm_str(c: Column | str) -> Column:
    return F.coalesce(trim_ws(col(c).cast("string")), F.lit(""))


def map_url(adresse: Column | str, name: Column | str, number: Column | str, postal: Column | str, place: Column | str) -> Column:
    """map search link from the cadastre address fields."""
    a = _norm_str(adresse)
    street = trim_ws(F.concat(_norm_str(name), F.lit(" "), house_number(number)))
    first = F.when(a != "", a).otherwise(street)
    return _maps_url([first, postal_int(postal), _norm_str(place)])


def user_map_url(street: Column | str, postcode: Column | str, city: Column | str) -> Column:
    """map search link from a user address."""
    return _maps_url([_norm_str(street), postal_int(postcode), _norm_str(city)])


def file_segment(c: Column | str) -> Column:
    """leading '_' segment of a file name without its extension."""
    stem = F.regexp_replace(col(c), r"\.[^.]*$", "")
    return F.when(col(c).isNull() | (col(c) == ""), F.lit("")).otherwise(F.substring_index(stem, "_", 1))


def parse_subunits(c: Column | str, address_col: Column | None = None) -> Column:
    """'name [industry, code]; name2' -> array<struct<name, industry, code, address>>."""
    v = col(c)
    stripped = trim_ws(v)
    missing = v.isNull() | stripped.isin("", "-") | F.lower(stripped).isin("nan", "<na>")
    addr = address_col if address_col is not None else F.lit(None).cast("string")
    parts = F.filter(F.transform(F.split(v, ";"), lambda x: trim_ws(x)), lambda x: x != "")

    def entry(p: Column) -> Column:
        hit = p.rlike(SUBUNIT_PATTERN)
        return F.struct(
            F.when(hit, trim_ws(F.regexp_extract(p, SUBUNIT_PATTERN, 1))).otherwise(p).alias("name"),
            F.when(hit, trim_ws(F.regexp_extract(p, SUBUNIT_PATTERN, 2))).otherwise(F.lit("")).alias("industry"),
            F.when(hit, trim_ws(F.regexp_extract(p, SUBUNIT_PATTERN, 3))).otherwise(F.lit("")).alias("code"),
            addr.alias("address"),
        )

    empty = F.array().cast("array<struct<name:string,industry:string,code:string,address:string>>")
    return F.when(missing, empty).otherwise(F.transform(parts, entry))


def render_subunits(entries: Column | str) -> Column:
    """'name [industry, code]' (when both present) joined by '; '."""
    return F.array_join(
        F.transform(
            col(entries),
            lambda e: F.when(
                (F.coalesce(e["industry"], F.lit("")) != "") & (F.coalesce(e["code"], F.lit("")) != ""),
                F.concat(e["name"], F.lit(" ["), e["industry"], F.lit(", "), e["code"], F.lit("]")),
            ).otherwise(e["name"]),
        ),
        "; ",
    )
