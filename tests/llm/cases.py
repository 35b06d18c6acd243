"""Documents that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, TEXT string, spans string, h long, DOC_ID string"


def clashing(spark, rows):
    """A documents table with extra columns named like the operators' own."""
    full = [(i, t, "en", "s", len(t) if t else 0, 9.0, 7, "x", "y", 5, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


LONG = "".join(f"word{i * 7919 % 10007} " for i in range(60_000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "no id at all here"), (7, LONG), (8, "…。😀 é​"), (9, "ONE two three four five six")]
