"""Record keys and citation keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig
from .text import blank, replace_at, strip

#: Fixed patterns: an entry's head, and the author and year in a record key.
HEAD = r"@(\w+)\{([^,]+),"
AUTHOR_YEAR = r"([A-Z][a-z]+).*?(\d{2,4})"


def record_key(url: Column, key: Column, ident: Column, config: EngineConfig) -> Column:
    """A hit's record key: from its URL, by the first host whose record prefix it holds; else from ``key``,
    else from ``ident``, less the key prefix. A URL with no known prefix is its own key."""
    cut = [F.replace(url, F.lit(f"{host}/rec/"), F.lit("")) for host in config.hosts]
    by_url = F.coalesce(*[F.when(c != url, c) for c in cut], url)
    other = F.coalesce(key, ident, F.lit(""))
    other = F.replace(other, F.lit(config.key_prefix), F.lit("")) if config.key_prefix else other
    return F.when(F.coalesce(url, F.lit("")) != "", by_url).otherwise(other)


def clean_key(key: Column, config: EngineConfig) -> Column:
    """A key as a user gives it: stripped, without ``.bib`` at the end and a host's record prefix in front,
    with or without its scheme."""
    out = strip(key)
    out = F.when(F.endswith(out, F.lit(".bib")), F.substring(out, F.lit(1), F.length(out) - 4)).otherwise(out)
    bare = [h.split("://", 1)[-1] for h in config.hosts]
    starts = [f"{scheme}{h}/rec/" for h in bare for scheme in ("https://", "http://", "")]
    return reduce(lambda rest, s: F.when(F.startswith(out, F.lit(s)), F.substring(out, F.lit(len(s) + 1), F.length(out))).otherwise(rest), reversed(starts), out)


def candidate_keys(key: Column) -> Column:
    """The keys under which an entry may be found, in order: the key, and with colons as slashes."""
    return F.when(blank(key), F.array().cast("array<string>")).when(F.contains(key, F.lit(":")), F.array(key, F.replace(key, F.lit(":"), F.lit("/")))).otherwise(F.array(key))


def citation_key(key: Column) -> Column:
    """A key made of the first author name and the year that a record key holds; else its last part."""
    author, year = F.regexp_extract(key, AUTHOR_YEAR, 1), F.regexp_extract(key, AUTHOR_YEAR, 2)
    full = F.when(F.length(year) != 2, year).when(year < "50", F.concat(F.lit("20"), year)).otherwise(F.concat(F.lit("19"), year))
    return F.when(author != "", F.concat(author, full)).otherwise(F.element_at(F.split(key, "/"), -1))


def rekey(bibtex: Column, new: Column) -> Column:
    """The first entry head anywhere gets the new key, taken literally."""
    start = F.regexp_instr(bibtex, F.lit(HEAD)).cast("int")
    head = F.regexp_extract(bibtex, HEAD, 0)
    return replace_at(bibtex, start, F.length(head), F.concat(F.lit("@"), F.regexp_extract(bibtex, HEAD, 1), F.lit("{"), new, F.lit(",")))


def rekey_from(bibtex: Column, key: Column) -> Column:
    """An entry that begins with a head gets the key made of its record key; any other stays as it is."""
    old = F.regexp_extract(bibtex, "^" + HEAD, 2)
    mark = F.concat(F.lit("{"), old, F.lit(","))
    start = F.when(old != "", F.position(mark, bibtex)).otherwise(0).cast("int")
    return replace_at(bibtex, start, F.length(mark), F.concat(F.lit("{"), citation_key(key), F.lit(",")))
