"""Small tables with awkward rows."""

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, lang="en"):
    """Documents numbered from 0 with the given texts."""
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
