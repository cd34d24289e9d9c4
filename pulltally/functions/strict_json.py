"""Parsing JSON texts of which nothing may be left over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON as the standard has it.
OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
END = "_end_of_text"
BLANKS = " \t\n\x0b\f\r"


def with_object(df: DataFrame, name: str, text: Column, fields: str) -> DataFrame:
    """Adds ``name``, the one object that ``text`` is, as a struct of ``fields``; null for any other text.

    The parser stops at the end of the first value. So the text is read as the first of two
    list items, of which the second must come out as the mark it is: after anything left over it doesn't.
    Each text is parsed once: filters over the object are not moved below the generator, while below a
    projection they come with a copy of the parser, and of all that makes the text, for every mention.
    """
    whole = F.concat(F.lit("["), text, F.lit(f', {{"{END}": true}}]'))
    items = F.when(F.ltrim(text, F.lit(BLANKS)).startswith("{"), F.from_json(whole, f"ARRAY<STRUCT<{fields}, {END}: BOOLEAN>>", OPTIONS))
    listed = f"{name}_list"
    parsed = df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(items.alias(listed)))))
    first, second = (F.get(listed, F.lit(i)) for i in range(2))
    return parsed.withColumn(name, F.when((F.size(listed) == 2) & second[END] & first[END].isNull(), first)).drop(listed)


def struct_fields(columns: str) -> str:
    """A list of columns as the fields of a struct."""
    from pyspark.sql.types import StructType

    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in StructType.fromDDL(columns))
