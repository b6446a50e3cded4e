"""What the operators on source files share: extensions, languages and cleaned paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import extension
from quern.functions.text import posix as clean_path

#: Language of each code extension.
LANGUAGE_OF = {
    ".py": "python", ".pyw": "python", ".ts": "typescript", ".mts": "typescript",
    ".js": "javascript", ".mjs": "javascript", ".java": "java", ".go": "go",
}


def language(c: Column) -> Column:
    """Language of a path's extension, null for others."""
    known = F.create_map(*[F.lit(x) for kv in LANGUAGE_OF.items() for x in kv])
    return known[extension(c)]


def sample_below(n: int, wanted: int) -> int:
    """The least 64-bit hash that is out of a sample of ``wanted`` of ``n`` rows, as an unsigned number."""
    return (1 << 64) if n <= wanted else (1 << 64) * wanted // n


def bounded(df: DataFrame, key: str, wanted: int, n: int | None = None) -> DataFrame:
    """About ``wanted`` rows drawn by a 64-bit hash of the key, all if there are no more: neither empties nor grows with the table.

    Should one key hold very many rows and be drawn, four times ``wanted`` is the end.
    """
    below = sample_below(df.count() if n is None else n, wanted)
    if below >= 1 << 64:
        return df
    return df.where(F.col(key).isNotNull() & (F.xxhash64(key) < F.lit(below - (1 << 63)).cast("long"))).limit(4 * wanted)
