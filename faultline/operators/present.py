"""How rows are shown: Markdown cells and tables, canonical JSON and files of JSON rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, squeezed


def markdown_cell(c, limit: int | None = None):
    """A value as the text of a table cell: null is empty, bars are escaped once, white space is squeezed, and a longer text ends in an ellipsis."""
    plain = squeezed(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\|"), F.lit("|")), F.lit("|"), F.lit("\\|")))
    if not limit:
        return plain
    return let(plain, lambda t: F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))).otherwise(t))


def markdown_rows(rows: DataFrame, limit: int | None = None):
    """The lines of a table's body, a column "line"; markdown_head() is what stands before them."""
    cells = [markdown_cell(F.col(f"`{c}`"), limit) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_head(columns) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]


def _sorted(c, kind: T.DataType):
    """c with the fields of its structs in the order of their names, all the way down."""
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    return c


def canonical_json(rows: DataFrame):
    """Each row of rows as JSON, the same text for the same values: keys sorted, no spaces, nulls kept; a column "json"."""
    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    return rows.select(F.to_json(F.struct(*(_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields)), {"ignoreNullFields": "false"}).alias("json"))


def write_json(rows: DataFrame, folder: str) -> None:
    """rows as files of canonical JSON, a row a line."""
    canonical_json(rows).write.mode("errorifexists").text(folder)


def failures(rows: DataFrame, most: int = 100) -> DataFrame:
    """One row: how many failures (kind, key, error) there are, and the first ``most`` of them by kind and key.

    The first are picked by a limit that each partition applies before anything is gathered.
    """
    first = rows.orderBy("kind", "key", "error").limit(most).agg(F.sort_array(F.collect_list(F.struct("kind", "key", "error"))).alias("first"))
    return rows.agg(F.count("*").alias("n")).crossJoin(first)  # one row each
