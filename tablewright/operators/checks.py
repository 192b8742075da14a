"""Checks of text columns against words and symbols that must not appear."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, roles


def banned_vocabulary_scan(
    df: DataFrame, table: str, columns: list[str] | None = None, terms: list[str] | None = None,
    symbols: list[str] | None = None, domain: str = "demographics",
) -> DataFrame:
    """Cells that hold a banned symbol anywhere or a banned word as a whole word, in any case.

    The words and symbols are those of the table's ``domain`` unless given. One pass: all plain words are
    found by one pattern, and each is one counter of the same aggregate.
    """
    columns = columns or roles.string_columns(df)
    terms = fixed.BANNED_TERMS[domain] if terms is None else terms
    symbols = fixed.BANNED_SYMBOLS[domain] if symbols is None else symbols
    # plain words cannot overlap, so one search finds them all; others are looked for one by one
    plain = [t for t in terms if re.fullmatch(r"[A-Za-z0-9_]+", t)]

    def words(c: str) -> Column:
        pattern = rf"(?i)\b({'|'.join(plain)})\b"
        return F.transform(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1)), F.lower)

    found_in = {c: f"__words{i}" for i, c in enumerate(columns)}
    searched = df.select(
        *[F.col(c).alias(f"__text{i}") for i, c in enumerate(columns)],
        *[(words(c) if plain else F.array().cast("array<string>")).alias(found_in[c]) for c in columns],
    )

    def hits(i: int, t: str) -> Column:
        if t in plain:
            return F.array_contains(f"__words{i}", t.lower())
        return F.col(f"__text{i}").rlike(rf"(?i)\b{re.escape(t)}\b")

    cells = [
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("term"), F.lit(kind).alias("kind"),
            F.count_if(hit).alias("hits"),
        )
        for i, c in enumerate(columns)
        for kind, t, hit in [("symbol", s, F.col(f"__text{i}").contains(s)) for s in symbols] + [("word", t, hits(i, t)) for t in terms]
    ]
    if not cells:  # nothing is banned in this domain
        empty = "table_name string, column_name string, term string, kind string, hits bigint"
        return df.sparkSession.createDataFrame([], empty)
    found = searched.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return found.where("hits > 0").select(F.lit(table).alias("table_name"), "*")
