"""Content-derived ids: SHA-256 of canonical JSON (sorted keys, no blanks)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clocks import utc_text


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON of the fields with sorted keys; nulls are written as null."""
    row = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.to_json(row, {"ignoreNullFields": "false"})


def content_id(prefix: str, fields: dict[str, Column]) -> Column:
    """prefix_ + the SHA-256 of the identity fields. The same fields give the same id in any run."""
    return F.concat(F.lit(f"{prefix}_"), F.sha2(canonical_json(fields).cast("binary"), 256))


def list_id(prefix: str, items: list[Column]) -> Column:
    """prefix_ + the SHA-256 of a JSON array of strings, in which nulls are null."""
    parts = [F.coalesce(F.concat(F.lit('"'), x, F.lit('"')), F.lit("null")) for x in items]
    text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.concat(F.lit(f"{prefix}_"), F.sha2(text.cast("binary"), 256))


#: Significant digits that a double may need; 15 are always exact.
DIGITS = (15, 16, 17)


def number_text(x: Column) -> Column:
    """The shortest decimal that reads back as x, as canonical JSON writes it: 0.1, 100.0, -0.0, 1e+16, 1.5e-07.

    The JVM's own text may have a digit too many, so its digits are rounded to 15, 16
    and 17 places and the first that reads back is taken. Plain notation from 1e-4 up
    to below 1e16. Not for subnormal numbers; null stays null.
    """
    # between 2^53 and 2^63 the JVM's digits may be off by more; as whole numbers they are exact
    exact = F.when((F.abs(x) >= float(1 << 53)) & (F.abs(x) < float(1 << 63)), F.abs(x).cast("long").cast("string"))
    as_whole = F.concat(F.substring(exact, 1, 1), F.lit("."), F.substring(exact, 2, 20), F.lit("E"), (F.length(exact) - 1).cast("string"))
    text = _let(F.coalesce(as_whole, F.abs(x).cast("string")), lambda own: _let(_parsed(own), lambda d: _let(_shortest(d, F.abs(x)), _written)))
    return F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), F.when(x == 0, "0.0").otherwise(text))


def _let(value: Column, of) -> Column:
    """of(value), with value worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _parsed(own: Column) -> Column:
    """struct(digits, power) of a positive number's text: its digits without zeros around them, and the power of ten of the first."""
    head, shift = F.split_part(own, F.lit("E"), F.lit(1)), F.coalesce(F.nullif(F.split_part(own, F.lit("E"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))
    digits = F.replace(head, F.lit("."), F.lit(""))
    bare = F.ltrim(digits, F.lit("0"))
    return F.struct(F.rtrim(bare, F.lit("0")).alias("digits"), (F.instr(head, ".") - 2 + shift - (F.length(digits) - F.length(bare))).alias("power"))


def _shortest(d: Column, value: Column) -> Column:
    """The first of the roundings to DIGITS places that reads back as value."""

    def rounded(k: int) -> Column:
        up = F.substring(d["digits"], k + 1, 1) >= "5"
        whole = (F.substring(d["digits"], 1, k).cast("decimal(20,0)") + up.cast("int")).cast("string")
        carried = F.struct(F.rtrim(whole, F.lit("0")).alias("digits"), (d["power"] + (F.length(whole) > k).cast("int")).alias("power"))
        return F.when(F.length(d["digits"]) <= k, d).otherwise(carried)

    def reads_back(c: Column) -> Column:
        return F.concat(F.substring(c["digits"], 1, 1), F.lit("."), F.substring(c["digits"], 2, 20), F.lit("0E"), c["power"].cast("string")).cast("double") == value

    return F.coalesce(F.get(F.filter(F.array(*[rounded(k) for k in DIGITS]), reads_back), F.lit(0)), d)


def _written(c: Column) -> Column:
    """Plain or scientific notation of struct(digits, power)."""
    d, p = c["digits"], c["power"]
    tail, size = F.substring(d, 2, 20), F.abs(p).cast("string")
    scientific = F.concat(F.substring(d, 1, 1), F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(""), F.lit("e"), F.when(p < 0, "-").otherwise("+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -p - 1), d)
    whole = F.concat(F.rpad(d, p + 1, F.lit("0")), F.lit(".0"))
    mixed = F.concat(F.substring(d, F.lit(1), p + 1), F.lit("."), F.substring(d, p + 2, F.lit(20)))
    return F.when((p < -4) | (p >= 16), scientific).when(p < 0, small).when(F.length(d) <= p + 1, whole).otherwise(mixed)


def _or_null(x: Column, text: Column) -> Column:
    return F.when(x.isNull(), "null").otherwise(text)


def number(x: Column) -> Column:
    return _or_null(x, number_text(x.cast("double")))


def whole(x: Column) -> Column:
    return _or_null(x, x.cast("long").cast("string"))


def word(x: Column) -> Column:
    """A JSON string with its escapes."""
    quoted = F.to_json(F.array(x))
    return _or_null(x, F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def instant(x: Column) -> Column:
    return _or_null(x, F.concat(F.lit('"'), utc_text(x), F.lit('"')))


def mark(x: Column) -> Column:
    return _or_null(x, x.cast("string"))


def listing(*texts: Column) -> Column:
    """A JSON list of texts that are JSON already."""
    return F.concat(F.lit("["), F.concat_ws(",", *texts), F.lit("]"))


def listing_of(values: Column, text) -> Column:
    """A JSON list of an array's entries, each made by text()."""
    return _or_null(values, F.concat(F.lit("["), F.array_join(F.transform(values, text), ","), F.lit("]")))


def identity(prefix: str, fields: dict[str, Column]) -> Column:
    """prefix_ + the SHA-256 of the canonical JSON object of fields, whose values are JSON texts (number, whole, word, instant, mark, listing)."""
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit(f"{prefix}_"), F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).cast("binary"), 256))
