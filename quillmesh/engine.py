"""The engine's public interface: publications, venues and BibTeX entries under one roof."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig, required, whole_number
from .functions.keys import clean_key, rekey
from .operators import authors, bibtex, fuzzy, render, venues
from .operators import collection as log
from .operators import search as boolean

#: Fixed texts: the messages of a collection.
ADDED = "Successfully added '{key}'{note}. Collection contains {n} entries."
REPLACED = " (replaced existing entry)"
REFUSED = "Failed to add entry: {why}\nCollection still contains {n} entries."
EXPORTED = "Exported {n} references to {path}"


class Engine:
    """Queries over a corpus. The query methods return DataFrames, which do no work until an action."""

    def __init__(self, publications: DataFrame, entries: DataFrame | None = None, venue_table: DataFrame | None = None, config: EngineConfig | None = None):
        self.publications, self.entries, self.venue_table = publications, entries, venue_table
        self.config = config or EngineConfig()

    def _entries(self) -> DataFrame:
        if self.entries is None:
            raise ValueError("this engine has no BibTeX entries")
        return self.entries

    def search(self, query: str, max_results: int = 10, year_from: int | None = None, year_to: int | None = None, venue_filter: str | None = None, include_bibtex: bool = False) -> DataFrame:
        """Boolean search; with ``include_bibtex`` rows without an entry get an empty one."""
        required(query=query)
        found = boolean.search(self.publications, query, whole_number("max_results", max_results), year_from, year_to, venue_filter, self.config.compat)
        return bibtex.with_bibtex(found, self._entries(), "") if include_bibtex else found

    def fuzzy_title(self, title: str, similarity_threshold: float, max_results: int = 10, year_from: int | None = None, year_to: int | None = None, venue_filter: str | None = None, include_bibtex: bool = False) -> DataFrame:
        """Titles like the given one; with ``include_bibtex`` rows without an entry have a null one."""
        required(title=title, similarity_threshold=similarity_threshold)
        found = fuzzy.fuzzy_title(self.publications, title, similarity_threshold, whole_number("max_results", max_results), year_from, year_to, venue_filter, self.config.compat)
        return bibtex.with_bibtex(found, self._entries(), None) if include_bibtex else found

    def author_publications(self, author_name: str, similarity_threshold: float, max_results: int = 20, include_bibtex: bool = False) -> DataFrame:
        """Publications of authors with a name like the given one."""
        required(author_name=author_name, similarity_threshold=similarity_threshold)
        found = authors.author_publications(self.publications, author_name, similarity_threshold, whole_number("max_results", max_results), self.config.compat)
        return bibtex.with_bibtex(found, self._entries(), "") if include_bibtex else found

    def author_stats(self, author_name: str, similarity_threshold: float, max_results: int = 20) -> DataFrame:
        """One row: name, count, publications and statistics, which are those of the limited list."""
        return authors.author_answer(self.author_publications(author_name, similarity_threshold, max_results), author_name)

    def venue_info(self, venue_name: str) -> DataFrame:
        """One row: the venue, or four empty texts."""
        required(venue_name=venue_name)
        if self.venue_table is None:
            raise ValueError("this engine has no venues")
        return venues.venue_info(self.venue_table, venue_name)

    def with_mirror(self, host: str) -> "Engine":
        """An engine whose records are looked for under another host first; this one stays as it is."""
        if not host:
            raise ValueError("missing required argument: host")
        old = self.config
        new = EngineConfig(host, (*old.mirrors, old.base_url), old.key_prefix, old.compat)
        return Engine(self.publications, self.entries, self.venue_table, new)

    def entry(self, key: str, citation_key: str) -> str | None:
        """The entry of a record under a citation key of the user's, or None; the key may be a URL."""
        if not key or not citation_key:
            raise ValueError("missing required argument: key or citation_key")
        spark = self.publications.sparkSession
        asked = spark.range(1).select(clean_key(F.lit(key), self.config).alias("key"))
        row = bibtex.lookup(asked, self._entries(), "key").select(rekey(F.col("raw"), F.lit(citation_key)).alias("b")).first()
        return row.b

    def collection(self) -> "Collection":
        return Collection(self)

    @staticmethod
    def render(found: DataFrame, similarity: bool = False, with_bibtex: bool = False) -> str:
        """Limited results as text."""
        return render.text(found, similarity, with_bibtex).first().text


class Collection:
    """One session's citations, held by key in the order of their first add. Adds of unknown records are refused, and
    exporting clears the collection. ``operators.collection`` has the same over logs of many sessions."""

    def __init__(self, engine: Engine):
        self.engine, self.held = engine, {}

    def entries(self) -> DataFrame:
        """The entries held, with their ``position``."""
        rows = [(k + 1, key, text) for k, (key, text) in enumerate(self.held.items())]
        return self.engine.publications.sparkSession.createDataFrame(rows, "position int, citation_key string, bibtex string")

    def add(self, key: str, citation_key: str) -> str:
        """Add a record under a citation key; the message says whether it replaced an entry, and the size. It costs
        one lookup, whatever the collection holds."""
        text = self.engine.entry(key, citation_key)
        if text is None:
            return REFUSED.format(why=f"no record {key!r}", n=len(self.held))
        note = REPLACED if citation_key in self.held else ""
        self.held[citation_key] = text
        return ADDED.format(key=citation_key, note=note, n=len(self.held))

    def export(self, path: str) -> str:
        """Write the entries to a ``.bib`` file and clear the collection; a failed write leaves it."""
        to, n = log.export(self.entries(), path)
        self.held = {}
        return EXPORTED.format(n=n, path=to)
