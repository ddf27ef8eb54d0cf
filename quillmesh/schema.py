"""Fixed schemas of the bibliographic data model."""

from pyspark.sql import types as T

#: One publication. ``rec_key`` identifies it; a null ``year`` is an unknown one.
PUBLICATION = T.StructType(
    [
        T.StructField("rec_key", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("authors", T.ArrayType(T.StringType(), False), False),
        T.StructField("venue", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("ee", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

VENUE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("venue", "acronym", "type", "url")])

BIBTEX = T.StructType([T.StructField("rec_key", T.StringType(), False), T.StructField("bibtex", T.StringType())])

#: The log of a citation collection: ``action`` is ``add`` or ``export``; ``seq`` orders a session's events.
SESSION_LOG = T.StructType(
    [
        T.StructField("session_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("citation_key", T.StringType()),
        T.StructField("bibtex", T.StringType()),
    ]
)

#: Columns of a publication in their usual order.
COLUMNS = PUBLICATION.names
