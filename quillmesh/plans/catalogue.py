"""The registered queries of the bibliographic engine and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import keys
from ..functions.similarity import contained_score
from ..operators import authors, bibtex, collection, fuzzy, render, search, venues
from ..sources import hits, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The publication view as DuckDB SQL.
VIEW = """slots AS (SELECT l_orderkey, list(p_name ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
pubs AS (SELECT doc_id, lang || '/' || source || '/' || doc_id AS rec_key, trim(split_part(text, chr(10), 1)) AS title, coalesce(names, []::VARCHAR[]) AS authors,
 source AS venue, CASE WHEN doc_id % 50 = 7 THEN NULL ELSE year(o_orderdate)::INT END AS year, lang AS type, '' AS doi, '' AS ee, 'https://bib.example/rec/' || lang || '/' || source || '/' || doc_id AS url
 FROM documents LEFT JOIN slots ON l_orderkey = doc_id LEFT JOIN orders ON o_orderkey = doc_id)"""
RANK = "year DESC NULLS LAST, rec_key"
PUB_TEXT = "concat_ws(' ', title, array_to_string(authors, ' '), venue, year::VARCHAR)"

#: The ratio of pairs(id, a, b) as DuckDB SQL: the longest common block, then the same on its left and right.
RATIO = """steps AS (
 SELECT id, a AS whole_a, b AS whole_b, 0 AS matched, [{'a': a, 'b': b}] AS stack FROM pairs
 UNION ALL
 SELECT id, whole_a, whole_b, matched + coalesce(-best.k, 0) AS matched,
  CASE WHEN best IS NULL THEN rest ELSE list_concat(list_concat(rest,
   CASE WHEN best.i > 1 AND best.j > 1 THEN [{'a': substr(top.a, 1, best.i - 1), 'b': substr(top.b, 1, best.j - 1)}] ELSE [] END),
   CASE WHEN best.i - best.k <= length(top.a) AND best.j - best.k <= length(top.b) THEN [{'a': substr(top.a, best.i - best.k), 'b': substr(top.b, best.j - best.k)}] ELSE [] END) END AS stack
 FROM (SELECT id, whole_a, whole_b, matched, stack[1] AS top, stack[2:] AS rest,
   list_sort(list_filter(flatten(list_transform(range(1, length(stack[1].a) + 1), lambda i: list_transform(range(1, length(stack[1].a) - i + 2),
    lambda n: {'k': -n, 'i': i, 'j': instr(stack[1].b, substr(stack[1].a, i, n))}))), lambda x: x.j > 0))[1] AS best
  FROM steps WHERE len(stack) > 0)),
ratios AS (SELECT id, 2.0::DOUBLE * max(matched) / (any_value(length(whole_a)) + any_value(length(whole_b))) AS ratio FROM steps GROUP BY id)"""


def query(oracle: str | None = None) -> Callable:
    """Register a function under its name, with SQL over the view ``pubs`` (all SQL is given whole)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def flat(found: DataFrame, *more: str) -> DataFrame:
    """Publications as plain values: the authors as one text, an unknown year as 0."""
    return found.select("rec_key", "title", F.array_join("authors", "; ").alias("authors"), "venue", F.coalesce("year", F.lit(0)).alias("year"), "type", *more)


FLAT = "rec_key, title, array_to_string(authors, '; ') AS authors, venue, coalesce(year, 0) AS year, type"


def limited(source: str, n: int, by: str = RANK, columns: str = FLAT) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {by}) AS position FROM (SELECT * FROM {source} ORDER BY {by} LIMIT {n})"


def has(word: str, text: str) -> str:
    return f"list_contains(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'), '{word}')"


@query(f"WITH {VIEW} SELECT {FLAT}, doi, ee, url FROM pubs")
def pub_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(tables.publications(spark, sf_dir), "doi", "ee", "url")


@query(f"WITH {VIEW} SELECT {FLAT} FROM pubs WHERE year BETWEEN 1995 AND 1996")
def pub_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    return flat(search.filtered(pubs.where("year IS NOT NULL"), 1995, 1996))


@query(f"WITH {VIEW} {limited('(SELECT * FROM pubs WHERE (year IS NULL OR year BETWEEN 1997 AND 1999) AND contains(lower(venue), $$src1$$))', 10)}")
def pub_year_range_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.filtered(tables.publications(spark, sf_dir), 1997, 1999, "SRC1")
    return flat(search.numbered(found, search.order(), 10), "position")


@query(f"WITH {VIEW} SELECT {FLAT} FROM pubs WHERE contains(lower(venue), 'rc1')")
def pub_venue_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.filtered(tables.publications(spark, sf_dir), venue="Rc1"))


@query(f"WITH {VIEW} {limited(f'(SELECT * FROM pubs WHERE {has("red", PUB_TEXT)} AND {has("the", PUB_TEXT)})', 20)}")
def pub_search_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.search(tables.publications(spark, sf_dir), "Red AND the", 20), "position")


@query(f"WITH {VIEW} {limited(f'(SELECT * FROM pubs WHERE {has("red", "array_to_string(authors, $$ $$)")} AND {has("the", "title")} AND {has("src0", "venue")})', 20)}")
def pub_search_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.search(tables.publications(spark, sf_dir), "author:red title:the venue:src0", 20), "position")


@query(f"WITH {VIEW} {limited(f'(SELECT * FROM pubs WHERE {has("red", "array_to_string(authors, $$ $$)")} AND {has("the", "title")})', 20)}")
def pub_search_parentheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.search(tables.publications(spark, sf_dir), "(title:the) AND (author:red)", 20), "position")


OR_HITS = f"""arms AS (SELECT *, CASE WHEN {has("src3", "venue")} THEN 0 WHEN {has("the", "title")} THEN 1 END AS arm FROM pubs),
firsts AS (SELECT * FROM arms WHERE arm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title, year ORDER BY arm, {RANK}) = 1)"""


@query(f"WITH {VIEW}, {OR_HITS} {limited('(SELECT * FROM firsts WHERE year IS NULL OR year >= 1994)', 40, 'arm, ' + RANK)}")
def pub_search_or_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.search(tables.publications(spark, sf_dir), "venue:src3 OR title:the", 40, year_from=1994), "position")


@query(f"WITH {VIEW} SELECT {FLAT} FROM pubs QUALIFY row_number() OVER (PARTITION BY title ORDER BY {RANK}) = 1")
def pub_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(search.first_of(tables.publications(spark, sf_dir), ["title"], search.order()))


@query(f"WITH {VIEW} SELECT rec_key, title, CASE WHEN title = '' THEN 0.0 ELSE greatest(0.8, 3 / length(title)) END AS score FROM pubs WHERE contains(lower(title), 'the')")
def title_containment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = contained_score("the", F.lower(F.col("title")))
    return tables.publications(spark, sf_dir).select("rec_key", "title", score.alias("score")).where("score IS NOT NULL")


def title_of(pubs: DataFrame, doc_id: int) -> str:
    return (pubs.where(F.col("doc_id") == doc_id).select("title").first() or [""])[0]


TITLES = f"titles AS (SELECT rec_key, title, year FROM pubs QUALIFY row_number() OVER (PARTITION BY title ORDER BY {RANK}) = 1)"


#: No SQL for the queries whose ratios go over whole long titles: there a ratio leaves popular characters out, and takes
#: SQL too long. Their tests hold them against the ratio's definition.
@query()
def title_fuzzy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    found = fuzzy.fuzzy_title(pubs, title_of(pubs, 7), 0.5, 10)
    return found.select("rec_key", "title", F.round("similarity", 9).alias("similarity"), "position")


@query()
def title_fuzzy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items with an id divisible by 50 as queries, whole, against all titles."""
    asked = tables.stored(spark, sf_dir, "benchmark").where("item_id % 50 = 0")
    found = fuzzy.fuzzy_titles(tables.publications(spark, sf_dir), asked, 0.45, 5, "item_id", "text")
    return found.withColumn("similarity", F.round("similarity", 9))


def contained_sql(title: str, threshold: float, source: str = "titles") -> str:
    """Scores of titles against a short literal one; the ratio is taken where the lengths allow the threshold."""
    return f"""pairs AS (SELECT rec_key AS id, '{title}' AS a, lower(title) AS b FROM {source} WHERE NOT contains(lower(title), '{title}') AND 2.0 * least(length(title), {len(title)}) / greatest(length(title) + {len(title)}, 1) >= {threshold}), {RATIO},
scored AS (SELECT {source}.*, CASE WHEN contains(lower(title), '{title}') THEN greatest(0.8, {len(title)} / length(title)) ELSE ratio END AS similarity FROM {source} LEFT JOIN ratios ON id = rec_key)"""


@query(
    f"""WITH RECURSIVE {VIEW}, {TITLES}, {contained_sql("the", 0.6)}
SELECT rec_key, title, round(similarity, 9) AS similarity, row_number() OVER (ORDER BY similarity DESC, {RANK}) AS position
FROM (SELECT * FROM scored WHERE similarity >= 0.6 ORDER BY similarity DESC, {RANK} LIMIT 20)"""
)
def title_fuzzy_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fuzzy.fuzzy_title(tables.publications(spark, sf_dir), "The", 0.6, 20)
    return found.select("rec_key", "title", F.round("similarity", 9).alias("similarity"), "position")


@query(
    f"""WITH RECURSIVE {VIEW}, one AS (SELECT *, 1 AS strategy FROM (SELECT * FROM pubs WHERE {has("the", "title")} ORDER BY {RANK} LIMIT 30) WHERE year IS NULL OR year >= 1994),
two AS (SELECT *, 2 AS strategy FROM (SELECT * FROM pubs WHERE {has("the", PUB_TEXT)} ORDER BY {RANK} LIMIT 20) WHERE year IS NULL OR year >= 1994),
firsts AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY title ORDER BY strategy, {RANK}) = 1), {contained_sql("the", 0.8, "firsts")}
SELECT rec_key, title, round(similarity, 9) AS similarity, row_number() OVER (ORDER BY similarity DESC, strategy, {RANK}) AS position
FROM (SELECT * FROM scored WHERE similarity >= 0.8 ORDER BY similarity DESC, strategy, {RANK} LIMIT 10)"""
)
def title_fuzzy_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both strategies with their over-fetch, three and two times the limit, before any filter."""
    found = fuzzy.fuzzy_title(tables.publications(spark, sf_dir), "the", 0.8, 10, year_from=1994, compat=True)
    return found.select("rec_key", "title", F.round("similarity", 9).alias("similarity"), "position")


AUTHOR, LEAST = "red widgit", 0.6
AUTHOR_PUBS = f"""names AS (SELECT DISTINCT unnest(authors) AS name FROM pubs), pairs AS (SELECT name AS id, '{AUTHOR}' AS a, lower(name) AS b FROM names), {RATIO},
best AS (SELECT doc_id, max(ratio) AS best_ratio FROM (SELECT doc_id, unnest(authors) AS name FROM pubs) JOIN ratios ON id = name GROUP BY doc_id HAVING max(ratio) >= {LEAST}),
mine AS (SELECT * FROM pubs JOIN best USING (doc_id)), tops AS (SELECT *, row_number() OVER (ORDER BY {RANK}) AS position FROM mine QUALIFY position <= 20)"""


def author_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.author_publications(tables.publications(spark, sf_dir), AUTHOR, LEAST, 20)


@query(f"WITH RECURSIVE {VIEW}, {AUTHOR_PUBS} SELECT rec_key, round(best_ratio, 9) AS best_ratio FROM mine")
def author_best_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.best_ratios(tables.publications(spark, sf_dir), AUTHOR, LEAST).select("rec_key", F.round("best_ratio", 9).alias("best_ratio"))


@query(f"WITH RECURSIVE {VIEW}, {AUTHOR_PUBS} SELECT count(*) AS publication_count FROM tops")
def author_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_found(spark, sf_dir).agg(F.count("*").alias("publication_count"))


def frequency(column: str, limit: str = "LIMIT 5") -> str:
    return f"WITH RECURSIVE {VIEW}, {AUTHOR_PUBS} SELECT {column}, count(*) AS n, min(position) AS first_position FROM tops GROUP BY {column} ORDER BY n DESC, first_position {limit}"


@query(frequency("venue"))
def author_top_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.top(author_found(spark, sf_dir), "venue")


@query(frequency("year"))
def author_top_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.top(author_found(spark, sf_dir), "year")


@query(frequency("type", ""))
def author_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.types(author_found(spark, sf_dir))


def listed(column: str, limit: str = "LIMIT 5", by: str = "n DESC, first_position") -> str:
    ranked = f"SELECT {column} AS v, count(*) AS n, min(position) AS first_position FROM tops GROUP BY ALL ORDER BY n DESC, first_position {limit}"
    return f"coalesce((SELECT string_agg(coalesce(v::VARCHAR, '?') || '=' || n, ' ' ORDER BY {by}) FROM ({ranked})), '')"


@query(
    f"""WITH RECURSIVE {VIEW}, {AUTHOR_PUBS}
SELECT '{AUTHOR}' AS name, (SELECT count(*) FROM tops) AS publication_count, coalesce((SELECT string_agg(rec_key, ' ' ORDER BY position) FROM tops), '') AS publications,
 {listed("venue")} AS venues, {listed("year")} AS years, {listed("coalesce(type, '')", "", "v")} AS types"""
)
def author_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested answer, its lists as texts."""
    row = authors.author_answer(author_found(spark, sf_dir), AUTHOR)

    def text(pairs: Column, value: str = "value", n: str = "count") -> Column:
        return F.array_join(F.transform(pairs, lambda p: F.concat(F.coalesce(p[value].cast("string"), F.lit("?")), F.lit("="), p[n].cast("string"))), " ")

    keys_of = F.array_join(F.transform("publications", lambda p: p["rec_key"]), " ")
    types = F.array_sort(F.map_entries("stats.types"))
    return row.select("name", "publication_count", keys_of.alias("publications"), text(F.col("stats.venues")).alias("venues"), text(F.col("stats.years")).alias("years"), text(types, "key", "value").alias("types"))


@query(
    f"""WITH RECURSIVE {VIEW}, pool AS (SELECT * FROM pubs WHERE {has("red", "array_to_string(authors, $$ $$)")} ORDER BY {RANK} LIMIT 10),
names AS (SELECT DISTINCT unnest(authors) AS name FROM pool), pairs AS (SELECT name AS id, 'red' AS a, lower(name) AS b FROM names), {RATIO},
best AS (SELECT doc_id, max(ratio) AS best_ratio FROM (SELECT doc_id, unnest(authors) AS name FROM pool) JOIN ratios ON id = name GROUP BY doc_id HAVING max(ratio) >= 0.4)
SELECT rec_key, round(best_ratio, 9) AS best_ratio, row_number() OVER (ORDER BY {RANK}) AS position FROM pool JOIN best USING (doc_id) QUALIFY position <= 5"""
)
def author_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the limit is fetched, then names are compared."""
    found = authors.author_publications(tables.publications(spark, sf_dir), "red", 0.4, 5, compat=True)
    return found.select("rec_key", F.round("best_ratio", 9).alias("best_ratio"), "position")


@query(
    f"""WITH {VIEW}, slots2 AS (SELECT DISTINCT rec_key, unnest(authors) AS author, venue, coalesce(year, -9999) AS y FROM pubs),
counts AS (SELECT author, venue, count(*) AS n, min({{'y': -y, 'k': rec_key}}) AS lead FROM slots2 GROUP BY ALL)
SELECT author, venue, n, row_number() OVER (PARTITION BY author ORDER BY n DESC, lead) AS place FROM counts QUALIFY place <= 5"""
)
def all_authors_top_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authors.all_authors_top_venues(tables.publications(spark, sf_dir))


VENUES = "venues AS (SELECT n_name AS venue, substr(n_name, 1, 3) AS acronym, r_name AS type, 'https://bib.example/db/' || lower(n_name) AS url FROM nation JOIN region ON n_regionkey = r_regionkey)"


def one_venue(name: str) -> str:
    pick = ", ".join(f"coalesce((SELECT {c} FROM hit), '') AS {c}" for c in ("venue", "acronym", "type", "url"))
    words = " AND ".join(has(w, "concat_ws(' ', venue, acronym)") for w in name.split("_"))
    return f"hit AS (SELECT * FROM venues WHERE {words} ORDER BY venue, url LIMIT 1) SELECT '{name}' AS asked, {pick}"


def two_venues(a: str, b: str) -> str:
    return f"WITH {VENUES}, one AS (WITH {one_venue(a)}), two AS (WITH {one_venue(b)}) SELECT * FROM one UNION ALL SELECT * FROM two"


@query(two_venues("nation_3", "atlantis"))
def venue_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tables.venues(spark, sf_dir)
    return venues.venue_info(known, "nation_3").select(F.lit("nation_3").alias("asked"), "*").unionByName(venues.venue_info(known, "Atlantis").select(F.lit("atlantis").alias("asked"), "*"))


PAGE_HOSTS = EngineConfig("https://www.ththhe.example.com", ("http://tionsh.example.net", "http://blog.tionsh.example.net"))


@query(
    "SELECT page_id, CASE WHEN contains(u, 'https://www.ththhe.example.com/rec/') THEN replace(u, 'https://www.ththhe.example.com/rec/', '') WHEN contains(u, 'http://tionsh.example.net/rec/') THEN replace(u, 'http://tionsh.example.net/rec/', '') WHEN contains(u, 'http://blog.tionsh.example.net/rec/') THEN replace(u, 'http://blog.tionsh.example.net/rec/', '') ELSE u END AS rec_key FROM (SELECT page_id, regexp_replace(url, '^(https?://[^/]*)/', '\\1/rec/') AS u FROM pages)"
)
def url_to_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "^(https?://[^/]*)/", "$1/rec/")
    return tables.stored(spark, sf_dir, "pages").select("page_id", keys.record_key(url, F.lit(None), F.lit(None), PAGE_HOSTS).alias("rec_key"))


#: Record keys in the shapes of real ones, from a publication's first author and number.
AUTHOR_KEY = "concat('journals/x/', coalesce(nullif(replace(initcap(authors[0]), ' ', ''), ''), 'anon'), lpad(cast(doc_id % 100 AS string), 2, '0'))"
AUTHOR_KEY_SQL = "'journals/x/' || coalesce(nullif(array_to_string(list_transform(string_split(authors[1], ' '), lambda w: upper(w[1]) || lower(w[2:])), ''), ''), 'anon') || lpad((doc_id % 100)::VARCHAR, 2, '0')"
NEW_KEY = """keyed AS (SELECT *, regexp_extract(k, '([A-Z][a-z]+).*?(\\d{2,4})', 1) AS who, regexp_extract(k, '([A-Z][a-z]+).*?(\\d{2,4})', 2) AS yy FROM raw),
named AS (SELECT *, CASE WHEN who <> '' THEN who || CASE WHEN length(yy) <> 2 THEN yy WHEN yy < '50' THEN '20' || yy ELSE '19' || yy END ELSE string_split(k, '/')[-1] END AS citation_key FROM keyed)"""


def author_keys(pubs: DataFrame) -> DataFrame:
    return pubs.withColumn("k", F.when(F.size("authors") > 0, F.expr(AUTHOR_KEY)).otherwise(F.concat(F.lit("journals/x/anon"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"))))


@query(f"WITH {VIEW}, raw AS (SELECT rec_key, {AUTHOR_KEY_SQL} AS k FROM pubs), {NEW_KEY} SELECT rec_key, k, citation_key FROM named")
def citation_key_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return author_keys(tables.publications(spark, sf_dir)).select("rec_key", "k", keys.citation_key(F.col("k")).alias("citation_key"))


ENTRY = "'@article{REC:' || rec_key || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || CASE WHEN year IS NULL THEN '' ELSE '  year = {' || year || '},' || chr(10) END || '}'"


@query(
    f"""WITH {VIEW}, raw AS (SELECT rec_key, {AUTHOR_KEY_SQL} AS k, {ENTRY} AS entry FROM pubs), {NEW_KEY}
SELECT rec_key, replace(entry, '@article{{REC:' || rec_key || ',', '@article{{' || citation_key || ',') AS generated, replace(entry, '@article{{REC:' || rec_key || ',', '@article{{my$1key,') AS given FROM named"""
)
def bibtex_rekey(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = author_keys(tables.publications(spark, sf_dir))
    entry = tables.entry()
    return pubs.select("rec_key", keys.rekey_from(entry, F.col("k")).alias("generated"), keys.rekey(entry, F.lit("my$1key")).alias("given"))


@query(
    f"""WITH {VIEW}, tops AS ({limited(f'(SELECT * FROM pubs WHERE {has("src1", "venue")})', 10, columns='*')}), raw AS (SELECT *, rec_key AS k, {ENTRY} AS entry FROM tops), {NEW_KEY}
SELECT rec_key, title, position, CASE WHEN doc_id % 3 = 0 THEN '' ELSE replace(entry, '{{REC:' || rec_key || ',', '{{' || citation_key || ',') END AS bibtex FROM named"""
)
def search_with_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    entries = tables.bibtex(pubs.where("doc_id % 3 <> 0"))
    found = search.search(pubs, "venue:src1", 10)
    return bibtex.with_bibtex(found, entries).select("rec_key", "title", "position", "bibtex")


@query(
    f"""WITH RECURSIVE {VIEW}, {AUTHOR_PUBS}, raw AS (SELECT *, rec_key AS k, {ENTRY} AS entry FROM tops), {NEW_KEY}
SELECT rec_key, position, CASE WHEN doc_id % 3 = 0 THEN '' ELSE replace(entry, '{{REC:' || rec_key || ',', '{{' || citation_key || ',') END AS bibtex FROM named"""
)
def author_with_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = tables.bibtex(tables.publications(spark, sf_dir).where("doc_id % 3 <> 0"))
    return bibtex.with_bibtex(author_found(spark, sf_dir), entries, "").select("rec_key", "position", "bibtex")


@query(
    f"""WITH RECURSIVE {VIEW}, {TITLES}, {contained_sql("the", 0.8)},
tops AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, {RANK}) AS position FROM scored WHERE similarity >= 0.8 QUALIFY position <= 10), raw AS (SELECT pubs.*, position, pubs.rec_key AS k, {ENTRY.replace("rec_key", "pubs.rec_key").replace("title", "pubs.title").replace("year", "pubs.year").replace("  pubs.title", "  title").replace("  pubs.year", "  year")} AS entry FROM tops JOIN pubs USING (rec_key)), {NEW_KEY}
SELECT rec_key, position, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE replace(entry, '{{REC:' || rec_key || ',', '{{' || citation_key || ',') END AS bibtex FROM named"""
)
def title_fuzzy_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title without an entry has a null one."""
    pubs = tables.publications(spark, sf_dir)
    found = fuzzy.fuzzy_title(pubs, "the", 0.8, 10)
    return bibtex.with_bibtex(found, tables.bibtex(pubs.where("doc_id % 3 <> 0")), None).select("rec_key", "position", "bibtex")


@query(f"WITH {VIEW} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN {ENTRY} END AS bibtex FROM pubs")
def bibtex_blank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank keys are looked for nowhere."""
    pubs = tables.publications(spark, sf_dir)
    asked = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " \t\n").otherwise(F.col("rec_key"))
    blank = pubs.select(F.lit("").alias("rec_key"), F.lit("@misc{none,}").alias("bibtex")).limit(1)
    found = bibtex.lookup(pubs.select("doc_id", asked.alias("asked")), tables.bibtex(pubs).unionByName(blank), "asked")
    return found.select("doc_id", F.col("raw").alias("bibtex"))


LOG = """log AS (SELECT event_id, user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, json_extract_string(props, '$.k') AS citation_key FROM events WHERE event_type IN ('click', 'view', 'purchase')),
eras AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS epoch FROM log),
adds AS (SELECT * FROM eras WHERE event_type <> 'purchase')"""


@query(
    f"""WITH {LOG}, held AS (SELECT session_id, epoch, citation_key, arg_max(event_id, seq) AS e, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS added FROM adds GROUP BY ALL)
SELECT session_id, epoch, citation_key, '@misc{{' || citation_key || ', note = {{' || e || '}}}}' AS bibtex, first_seq, last_seq, added, row_number() OVER (PARTITION BY session_id, epoch ORDER BY first_seq) AS position FROM held"""
)
def collection_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.latest(tables.session_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT session_id, seq, citation_key FROM adds QUALIFY row_number() OVER (PARTITION BY session_id, epoch, citation_key ORDER BY seq) > 1")
def collection_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.additions(tables.session_log(spark, sf_dir)).where("overwrote").select("session_id", "seq", "citation_key")


@query(f"WITH {LOG}, marked AS (SELECT *, row_number() OVER (PARTITION BY session_id, epoch, citation_key ORDER BY seq) = 1 AS fresh FROM adds) SELECT session_id, seq, epoch, sum(fresh::INT) OVER (PARTITION BY session_id, epoch ORDER BY seq)::BIGINT AS size FROM marked")
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.additions(tables.session_log(spark, sf_dir)).select("session_id", "seq", "epoch", "size")


def as_json(pubs: DataFrame) -> DataFrame:
    """Each publication as a search response, its shapes dealt by number: the hit in a list or alone, authors as
    a list of objects, of texts, as one object, as one text, or missing; the year as text."""
    q = F.to_json
    objects = F.transform("authors", lambda a: F.struct(a.alias("text")))
    lone = F.size("authors") == 1
    even = F.col("doc_id") % 2 == 0
    names = (
        F.when(F.size("authors") == 0, F.lit("{}"))
        .when(lone & even, q(F.struct(objects[0].alias("author"))))
        .when(lone, q(F.struct(F.col("authors")[0].alias("author"))))
        .when(F.col("doc_id") % 3 == 0, q(F.struct(F.col("authors").alias("author"))))
        .otherwise(q(F.struct(objects.alias("author"))))
    )
    info = q(F.struct("title", "venue", F.col("year").cast("string").alias("year"), "type", "url"))
    hit = F.concat(F.lit('{"@id": "x", "info": '), F.regexp_replace(info, r"\}$", ""), F.lit(', "authors": '), names, F.lit("}}"))
    hit = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("["), hit, F.lit("]"))).otherwise(hit)
    return pubs.select("doc_id", F.concat(F.lit('{"result": {"hits": {"@total": "1", "hit": '), hit, F.lit("}}}")).alias("json"))


@query(f"WITH {VIEW} SELECT doc_id, 0 AS hit_no, {FLAT}, doi, ee, url FROM pubs")
def json_hits_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits.publications(as_json(tables.publications(spark, sf_dir)))
    return found.select("doc_id", "hit_no", "rec_key", "title", F.array_join("authors", "; ").alias("authors"), "venue", F.coalesce("year", F.lit(0)).alias("year"), "type", "doi", "ee", "url")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 8 < 2 THEN 'not JSON' ELSE 'no result.hits' END AS error FROM documents WHERE doc_id % 8 < 4"""
)
def json_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that are broken, missing or without hits; empty and whole ones are no errors."""
    shapes = ["{bad", None, "{}", '{"result": {}}', '{"result": {"hits": {"@total": "0"}}}', '{"result": {"hits": {}}}', '{"result": {"hits": {"@total": "1", "hit": {"info": {}}}}}', '{"result": {"hits": {"@total": "1", "hit": []}}}']
    one = F.array(*[F.lit(x).cast("string") for x in shapes])
    docs = tables.stored(spark, sf_dir, "documents").select("doc_id", F.element_at(one, (F.col("doc_id") % 8 + 1).cast("int")).alias("json"))
    return hits.errors(docs).select("doc_id", "error")


@query(
    """WITH dealt AS (SELECT doc_id, unnest(range(CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) AS hit_no FROM documents)
SELECT doc_id, hit_no, CASE (doc_id + hit_no) % 4 WHEN 0 THEN 'u/' || doc_id WHEN 1 THEN 'k/' || doc_id WHEN 2 THEN 'i/' || doc_id ELSE '' END AS rec_key,
 CASE doc_id % 5 WHEN 0 THEN 2017 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1999 END AS year, CASE WHEN doc_id % 2 = 0 THEN 'T' ELSE '' END AS title FROM dealt"""
)
def json_hit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys from the URL, else the key, else the id; years that are no numbers; lists, lone hits and a total of 0."""
    ident = F.col("doc_id").cast("string")
    year = F.element_at(F.array(*map(F.lit, ['"year": "2017", ', '"year": "2017-2018", ', '"year": "", ', "", '"year": "1999", '])), (F.col("doc_id") % 5 + 1).cast("int"))
    title = F.when(F.col("doc_id") % 2 == 0, '"title": "T", ').otherwise("")

    def hit(no: int) -> Column:
        k = (F.col("doc_id") + no) % 4
        outer = F.when(k == 1, F.concat(F.lit('"key": "bib:k/'), ident, F.lit('", "@id": "x", '))).when(k == 2, F.concat(F.lit('"@id": "bib:i/'), ident, F.lit('", '))).otherwise("")
        url = F.when(k == 0, F.concat(F.lit('"url": "https://bib.example/rec/u/'), ident, F.lit('"'))).otherwise('"x": 1')
        return F.concat(F.lit("{"), outer, F.lit('"info": {'), title, year, url, F.lit("}}"))

    found = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), hit(0), F.lit(", "), hit(1), F.lit("]"))).otherwise(hit(0))
    total = F.when(F.col("doc_id") % 7 == 0, "0").when(F.col("doc_id") % 3 == 0, "2").otherwise("1")
    json = F.concat(F.lit('{"result": {"hits": {"@total": "'), total, F.lit('", "hit": '), found, F.lit("}}}"))
    rows = hits.publications(tables.stored(spark, sf_dir, "documents").select("doc_id", json.alias("json")))
    return rows.select("doc_id", "hit_no", "rec_key", F.coalesce("year", F.lit(0)).alias("year"), "title")


@query(
    f"""WITH {VIEW}, tops AS ({limited(f'(SELECT * FROM pubs WHERE {has("src2", "venue")})', 10, columns='*')})
SELECT position, position || '. ' || title || chr(10) || '   Authors: ' || array_to_string(authors, ', ') || chr(10) || '   Venue: ' || venue || ' (' || coalesce(year::VARCHAR, 'None') || ')' || chr(10) || '   Record key: ' || rec_key || chr(10) AS block FROM tops"""
)
def render_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.blocks(search.search(tables.publications(spark, sf_dir), "venue:src2", 10))


BLOCK = "'   Authors: ' || array_to_string(authors, ', ') || chr(10) || '   Venue: ' || venue || ' (' || coalesce(year::VARCHAR, 'None') || ')' || chr(10) || '   Record key: ' || rec_key || chr(10)"


@query(
    f"""WITH RECURSIVE {VIEW}, {TITLES}, {contained_sql("the", 0.8)}, best AS (SELECT rec_key, similarity FROM scored WHERE similarity >= 0.8),
tops AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, {RANK}) AS position FROM pubs JOIN best USING (rec_key) QUALIFY position <= 5)
SELECT position, position || '. ' || title || ' [Similarity: ' || printf('%.2f', similarity) || ']' || chr(10) || {BLOCK} AS block FROM tops"""
)
def render_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.blocks(fuzzy.fuzzy_title(tables.publications(spark, sf_dir), "the", 0.8, 5), similarity=True)


@query(
    f"""WITH {VIEW}, tops AS ({limited(f'(SELECT * FROM pubs WHERE {has("src1", "venue")})', 10, columns='*')}), raw AS (SELECT *, rec_key AS k, {ENTRY} AS entry FROM tops), {NEW_KEY}
SELECT position, position || '. ' || title || chr(10) || {BLOCK} || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || '   BibTeX:' || chr(10) || '      ' || replace(replace(entry, '{{REC:' || rec_key || ',', '{{' || citation_key || ','), chr(10), chr(10) || '      ') || chr(10) END AS block FROM named"""
)
def render_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    found = bibtex.with_bibtex(search.search(pubs, "venue:src1", 10), tables.bibtex(pubs.where("doc_id % 3 <> 0")), "")
    return render.blocks(found, bibtex=True)


@query(f"WITH {VENUES}, one AS (WITH {one_venue('nation_3')}) SELECT 'venue: ' || venue || chr(10) || 'acronym: ' || acronym || chr(10) || 'type: ' || type || chr(10) || 'url: ' || url AS text FROM one")
def render_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.pairs(venues.venue_info(tables.venues(spark, sf_dir), "nation_3"))


@query("SELECT 'No results found.' AS text")
def render_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.text(search.search(tables.publications(spark, sf_dir), "venue:nowhere", 10))


def clean_sql(hosts: tuple[str, ...]) -> str:
    bare = "|".join(h.split("://", 1)[-1].replace(".", "\\.") for h in hosts)
    return f"regexp_replace(regexp_replace(trim(k), '\\.bib$', ''), '^(https?://)?({bare})/rec/', '')"


@query(f"SELECT page_id, {clean_sql(PAGE_HOSTS.hosts)} AS rec_key FROM (SELECT page_id, '  ' || regexp_replace(url, '^(https?://[^/]*)/', CASE WHEN page_id % 2 = 0 THEN '\\1/rec/' ELSE split_part(url, '/', 3) || '/rec/' END) || '.bib ' AS k FROM pages)")
def key_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.concat(F.split("url", "/")[2], F.lit("/rec/"), F.regexp_replace("url", "^https?://[^/]*/", ""))
    given = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^(https?://[^/]*)/", "$1/rec/")).otherwise(bare)
    key = F.concat(F.lit("  "), given, F.lit(".bib "))
    return tables.stored(spark, sf_dir, "pages").select("page_id", keys.clean_key(key, PAGE_HOSTS).alias("rec_key"))


@query(f"WITH {VIEW} SELECT doc_id, replace(rec_key, '/', ':') AS asked, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {ENTRY} END AS bibtex FROM pubs")
def bibtex_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    asked = pubs.select("doc_id", F.replace("rec_key", F.lit("/"), F.lit(":")).alias("asked"))
    found = bibtex.lookup(asked, tables.bibtex(pubs.where("doc_id % 4 <> 0")), "asked")
    return found.select("doc_id", "asked", F.coalesce("raw", F.lit("")).alias("bibtex"))


@query(
    f"""WITH {VIEW}, one AS (SELECT *, 0 AS arm FROM (SELECT * FROM pubs WHERE {has("src3", "venue")} ORDER BY {RANK} LIMIT 30)), two AS (SELECT *, 1 AS arm FROM (SELECT * FROM pubs WHERE {has("the", "title")} ORDER BY {RANK} LIMIT 30)),
firsts AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY title, year ORDER BY arm, {RANK}) = 1)
{limited("(SELECT * FROM firsts WHERE contains(lower(venue), '3'))", 30, "arm, " + RANK)}"""
)
def pub_search_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(tables.publications(spark, sf_dir), "venue:src3 or title:the", 30, venue="3", compat=True)
    return flat(found, "position")


@query(f"WITH {LOG}, good AS (SELECT * FROM adds WHERE event_id % 7 <> 0) SELECT session_id, epoch, citation_key, max(seq) AS last_seq, count(*) AS added FROM good GROUP BY ALL")
def collection_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.session_log(spark, sf_dir)
    shapes = F.array(*map(F.lit, [" ", "% Error: timeout", "\n", "  % Error: x", "\t\n% Error"]))
    failed = F.when(F.col("event_id") % 7 == 0, F.element_at(shapes, (F.col("event_id") % 5 + 1).cast("int")))
    kept = collection.latest(log.withColumn("bibtex", F.coalesce(failed, "bibtex")))
    return kept.select("session_id", "epoch", "citation_key", "last_seq", "added")


@query(
    f"""WITH {LOG}, ends AS (SELECT session_id, sum((event_type = 'purchase')::INT) AS now FROM log GROUP BY 1),
held AS (SELECT session_id, epoch, citation_key, arg_max(event_id, seq) AS event_id FROM adds GROUP BY ALL)
SELECT session_id, citation_key, '@misc{{' || citation_key || ', note = {{' || event_id || '}}}}' AS bibtex FROM held JOIN ends USING (session_id) WHERE epoch = now"""
)
def collection_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.current(tables.session_log(spark, sf_dir)).select("session_id", "citation_key", "bibtex")


@query(f"WITH {VENUES} SELECT venue, acronym, type, url FROM venues")
def json_venue_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = F.to_json(F.struct(F.struct("venue", "acronym", "type", "url").alias("info")))
    hit = F.when(F.length("venue") % 2 == 0, F.concat(F.lit("["), info, F.lit("]"))).otherwise(info)
    responses = tables.venues(spark, sf_dir).select(F.concat(F.lit('{"result": {"hits": {"@total": "1", "hit": '), hit, F.lit("}}}")).alias("json"))
    return hits.venues(responses).drop("hit_no")


@query()
def render_similarity_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    pubs = tables.publications(spark, sf_dir)
    found = fuzzy.fuzzy_title(pubs, title_of(pubs, 7), 0.5, 5)
    return render.blocks(bibtex.with_bibtex(found, tables.bibtex(pubs), None), similarity=True, bibtex=True)
