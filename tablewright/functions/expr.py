"""Row-level column expressions. None of them needs an aggregate."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def half_up(c: Column, digits: int) -> Column:
    """Round half up on the decimal value, so that binary noise cannot flip a tie.

    Values too large for the decimal (and NaN) are rounded as doubles.
    """
    exact = F.round(c.try_cast("decimal(28,10)"), digits).cast("double")
    return F.coalesce(exact, F.round(c, digits))


def money(c: Column) -> Column:
    """The decimal part of a number, for sums that do not depend on the order of addition.

    What it leaves out, digits beyond the tenth, numbers that are too large, NaN, is in
    :func:`money_rest`; for amounts of money that is 0.
    """
    return c.try_cast("decimal(28,10)")


def money_rest(c: Column) -> Column:
    exact, number = money(c), c.cast("double")
    return F.when(exact.isNull(), number).otherwise(number - exact.cast("double"))


def money_sum(c: Column) -> Column:
    """The sum of all numbers; NaN stays NaN, as it does in the mean."""
    return F.coalesce(F.sum(money(c)), F.lit(0)).cast("double") + F.sum(money_rest(c))


def rounded_sum(c: Column, digits: int = 2) -> Column:
    """The sum, rounded before it becomes a double where the decimal part is all of it."""
    rest = F.sum(money_rest(c))
    return F.when(rest == 0, F.round(F.sum(money(c)), digits).cast("double")).otherwise(F.round(money_sum(c), digits))


def money_avg(c: Column) -> Column:
    return F.try_divide(money_sum(c), F.count(c))


#: all characters with the Unicode property White_Space
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space; the built-in ``trim`` removes blanks unless it is told more.

    Texts that begin and end with a visible ASCII character, nearly all, are not searched for it;
    comparing bytes shows that without a copy of the text.
    """
    text = c.cast("string")
    last = F.right(text, F.lit(1))
    bare = (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(bare, c).otherwise(F.trim(c, F.lit(BLANKS)))


def _is_listed(trimmed: Column) -> Column:
    """Whether it is a placeholder text; lower case is never shorter, so long texts need none."""
    short = F.char_length(trimmed) <= max(map(len, fixed.PLACEHOLDERS))
    return short & F.lower(trimmed).isin(fixed.PLACEHOLDERS)


def is_placeholder(c: Column) -> Column:
    """True for null and for the placeholder texts."""
    return c.isNull() | _is_listed(trim_all(c.cast("string")))


def null_placeholder(c: Column) -> Column:
    """Trimmed text, or null for a placeholder."""
    trimmed = trim_all(c)
    return F.when(_is_listed(trimmed), F.lit(None)).otherwise(trimmed)


def without_zero_fraction(c: Column) -> Column:
    """Texts without ``.0``, nearly all, are not searched by the pattern."""
    text = c.cast("string")
    return F.when(F.contains(text, F.lit(".0")), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def title_case(c: Column) -> Column:
    """Upper case after every non-letter (``mid-market`` gives ``Mid-Market``), lower case elsewhere."""
    pieces = F.split(F.lower(c), r"(?<=[^\p{L}])")
    raised = F.transform(pieces, lambda p: F.concat(F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p))))
    return F.array_join(raised, "")


def layout_shape(layout: str) -> str | None:
    """A pattern that every text of the layout matches; None for layouts with parts other than dates and times of day."""
    out = []
    for part in re.finditer(r"'([^']*)'|([A-Za-z])\2*|(.)", layout):
        literal, letter, other = part.groups()
        width = len(part.group())
        if not letter:
            out.append(re.escape(other or literal))
        elif letter == "M" and width > 2:  # a month by name
            out.append(r"\D+")
        elif letter == "y" and width == 4:
            out.append(r"[+-]?\d{4,19}")
        elif letter in "MdHms" and width <= 2:
            out.append(r"\d{2}" if width == 2 else r"\d{1,19}")
        else:
            return None
    return "^" + "".join(out) + "$"


def _by_shape(text: Column, layouts: list[str], parse) -> Column:
    """The first layout that fits; one whose shape differs from the text's is not tried, as a failed parse costs most."""
    tried = []
    for layout in layouts:
        shape, found = layout_shape(layout), parse(text, layout)
        tried.append(found if shape is None else F.when(text.rlike(shape), found))
    return F.coalesce(*tried)


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """First layout that fits, year-first layouts before day-first ones; null when none fits."""
    return _by_shape(trim_all(c.cast("string")), formats or fixed.DATE_FORMATS, F.try_to_date)


def parse_datetime(c: Column, formats: list[str] | None = None) -> Column:
    """Like :func:`parse_date` but the time of day is kept."""
    return _by_shape(
        trim_all(c.cast("string")), formats or fixed.DATE_FORMATS, lambda text, layout: F.try_to_timestamp(text, F.lit(layout))
    )


def to_number(c: Column) -> Column:
    """Digits, dots and minus signs of the text as a double; null when they form no number."""
    return F.regexp_replace(c.cast("string"), r"[^\d.\-]", "").try_cast("double")


def quantity(c: Column) -> Column:
    """Absolute value, at least 1, missing counts as 1."""
    return F.greatest(F.coalesce(F.abs(to_number(c)), F.lit(1.0)), F.lit(1.0))


def price(c: Column) -> Column:
    return F.abs(to_number(c))


def discount(c: Column) -> Column:
    """Share in [0, 0.99]; values above 1 and cells with a percent sign are percent; missing is no discount."""
    raw = F.abs(to_number(c))
    percent = (raw > 1.0) | F.contains(c.cast("string"), F.lit("%"))
    share = F.when(percent, raw / 100.0).otherwise(raw)
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(F.least(share, F.lit(fixed.DISCOUNT_CEILING)))


def rating(c: Column, replacement: float) -> Column:
    """Above the scale: the replacement. Below it: the lowest rating. Missing stays missing."""
    raw = to_number(c)
    return (
        F.when(raw > fixed.RATING_HIGH, F.lit(float(replacement)))
        .when(raw < fixed.RATING_LOW, F.lit(fixed.RATING_LOW))
        .otherwise(raw)
    )


def sales_amount(quantity_col: Column, price_col: Column, discount_col: Column | None = None) -> Column:
    gross = quantity_col * price_col
    return half_up(gross if discount_col is None else gross * (F.lit(1.0) - discount_col), 2)


def hashed(columns: list[tuple[Column, str]]) -> list[Column]:
    """Two columns ``a`` and ``b``, 128 bits that stand for the values of (column, type as text).

    Null is a value of its own in every place, and -0.0 is 0.0. Nested values count by their JSON text.
    """
    plain = [
        F.to_json(c, {"ignoreNullFields": "false"}) if kind.startswith(("array", "map", "struct", "variant")) else c
        for c, kind in columns
    ]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in plain])
    return [F.xxhash64(F.lit(seed), nulls, *plain).alias(name) for seed, name in ((1, "a"), (2, "b"))]


def tier(c: Column, steps: list[tuple[float, str]], rest: str) -> Column:
    """Label of the first lower limit reached; null and everything below get ``rest``."""
    label = None
    for limit, name in steps:
        label = F.when(c >= limit, name) if label is None else label.when(c >= limit, name)
    return label.otherwise(rest)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over the rows where both are present; 0 when one does not vary.

    The built-in ``corr`` divides by zero for a constant, which is an error in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    spread = F.sqrt(F.var_pop(F.when(both, x)) * F.var_pop(F.when(both, y)))
    varies = (F.min(F.when(both, x)) < F.max(F.when(both, x))) & (F.min(F.when(both, y)) < F.max(F.when(both, y)))
    return F.coalesce(F.when(varies, F.nanvl(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0))), F.lit(0.0))
