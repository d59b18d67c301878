"""Text, dates, signatures and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_NAME = "Untitled project"
#: All white space, as a class of a regular expression, and not blanks alone.
SPACES = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def strip(c: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def format_distance(m: Column) -> Column:
    """Kilometres with two decimals from 1000 m on, else whole metres, half up."""
    return F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).otherwise(F.concat(F.floor(m + 0.5).cast("string"), F.lit(" m")))


def format_fixed(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def format_stamp(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy, h:mm a")


def plural(n: Column, label: str) -> Column:
    """"2 crossings", "1 crossing", and nothing for zero."""
    return F.when(n == 0, "").otherwise(F.concat(n.cast("string"), F.lit(f" {label}"), F.when(n == 1, "").otherwise("s")))


def name_or_default(name: Column, default: str = DEFAULT_NAME) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(default))


def json_kind(c: Column) -> Column:
    """object, array, string, number, boolean or null: what a text of one JSON value is; null where it is none.

    Parsers stop after a value, so the text is read as the only member of an
    array and of an object: text that follows breaks one of them at least.
    """
    one = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    read = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), "v string, bad string", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "bad"})
    alone = read.isNotNull() & read["bad"].isNull()
    start = F.substring(F.regexp_replace(c, "^[ \\t\\n\\r]+", ""), 1, 1)
    kind = F.when(start == "{", "object").when(start == "[", "array").when(start == '"', "string").when(start == "n", "null").when(start.isin("t", "f"), "boolean").otherwise("number")
    return F.when(F.coalesce(one, F.lit(False)) & alone, kind)


def is_truthy(v: Column) -> Column:
    """Does a variant hold something: not null, false, zero or an empty text?"""
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "VOID", False).when(kind == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
        .when(kind == "STRING", F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) != "").when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(F.coalesce((number != 0) & ~F.isnan(number), F.lit(False)))
    )


def signature(*cols: Column) -> Column:
    """Digest of the content of columns, by which changes are noticed."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def new_id(*keys: Column) -> Column:
    """A random identifier, or one that follows from ``keys``."""
    if not keys:
        return F.uuid() if hasattr(F, "uuid") else F.expr("uuid()")
    return F.substring(F.sha2(F.concat_ws("|", *[k.cast("string") for k in keys]), 256), 1, 32)
