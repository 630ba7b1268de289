"""Words of a text as native column expressions, and columns that an operator only passes on."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def blank_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; no words for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, "")


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and all non-ASCII characters, A-Z in lower case; no words for NULL."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


#: Columns that an operator does not use travel in one struct of this name.
BESIDE = "columns_beside"


def set_apart(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct, so that no name of a step can be one of theirs."""
    rest = [c for c in docs.columns if c not in used]
    fields = [F.col(f"`{c.replace('`', '``')}`") for c in rest]
    return docs.select(*used, *([F.struct(*fields).alias(BESIDE)] if rest else []))


def put_back(out: DataFrame, columns: list[str], used: list[str], results: list[str]) -> DataFrame:
    """``columns`` as the table had them, then the results.

    A column of the table that has the name of a result comes back unchanged as ``<name>_of_table``.
    """
    def name(c: str) -> str:
        free = c
        while free in results or (free != c and free in columns):
            free += "_of_table"
        return free

    kept = [(F.col(c) if c in used else F.col(BESIDE)[c]).alias(name(c)) for c in columns]
    return out.select(*kept, *results)
