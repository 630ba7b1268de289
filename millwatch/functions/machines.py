"""What a machine name or a raw status says, as column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millwatch import fixed_values as fv


def _first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    head, *tail = cases
    chain = reduce(lambda c, case: c.when(case[0], case[1]), tail, F.when(*head))
    return chain.otherwise(default)


def line_of(name: Column, strict: bool = False) -> Column:
    """Reporting line from the name.

    The LIKE patterns treat ``_`` as any character, so a name that *ends* in the
    line number is Unknown.  ``strict`` reads the line number in front of the
    last two digits instead.
    """
    if strict:
        digits = F.regexp_extract(name, r"_(\d\d)_\d\d$", 1)
        return F.when(digits != "", F.concat(F.lit("Line_"), digits.cast("int").cast("string"))) \
            .otherwise(fv.UNKNOWN_LINE)
    return _first_match([(name.like(p), line) for p, line in fv.LINE_BY_PATTERN], fv.UNKNOWN_LINE)


def machine_type(name: Column) -> Column:
    lowered = F.lower(name)
    return _first_match([(lowered.contains(part), kind) for part, kind in fv.TYPE_BY_NAME_PART], fv.DEFAULT_TYPE)


def machine_icon(kind: Column) -> Column:
    icons = F.create_map(*[F.lit(x) for pair in fv.ICON_BY_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(icons, kind), F.lit(fv.ICON_BY_TYPE[fv.DEFAULT_TYPE]))


def short_name(name: Column) -> Column:
    """``Source_Sorter_01_01`` -> ``S_S_01_01``; names with fewer than three parts stay."""
    parts = F.split(name, "_")
    words = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0)))
    initials = F.transform(words, lambda word: F.upper(F.substring(word, 1, 1)))
    tail = F.slice(parts, F.lit(-2), F.lit(2))
    return F.when(F.size(parts) >= 3, F.concat_ws("_", initials, tail)).otherwise(name)


def display_status(status: Column) -> Column:
    lowered = F.lower(F.coalesce(status, F.lit(fv.UNKNOWN_STATUS)))
    cases = [
        (lowered.isin(exact) | reduce(lambda a, b: a | b, [lowered.contains(w) for w in contained]), label)
        for label, exact, contained in fv.STATUS_WORDS
    ]
    return _first_match(cases, fv.UNKNOWN_STATUS)
