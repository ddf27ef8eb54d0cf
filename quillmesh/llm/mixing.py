"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are summed to cells (source, language, topic) of token counts. A cell's fitted share is its observed share
times a factor for each of its values, but never more than the share it has when it is kept whole: its observed
share over ``rate``. Raking multiplies the factors by target over current share, one margin after another, until all
three margins hold with that bound (bounded raking); so the margins of what is kept are those asked for, and no
probability passes 1. A cell's keep probability is its fitted share times ``rate`` over its observed share.
Documents are kept where a hash of their id, uniform in [0, 1), lies below it, so a rerun keeps the same ones.

A target share that a value cannot have, even kept whole, is lowered to what it can, and the other values of the
margin take up the rest in proportion. Sweeps end when every margin is within ``CLOSE`` of its goal, or after
``SWEEPS``; :func:`margins` reports goal and share of each value.

Targets not given are the observed shares raised to ``temper`` and normalised, which lifts rare values and
lowers the dominant ones. Everything is DataFrame operations on two tables: the documents, which are read
twice and never shuffled whole, and the cells, which are as many as there are combinations of values. Up to ``FEW``
cells are one partition, whose sums by a margin need no exchange: dealt out, the sweeps are some hundred small jobs, whose
plans, stages and threads take far more of the driver's memory than the cells. More cells are dealt by each margin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, unused

TEMPER = 0.7
#: Sweeps over the margins at most, sweeps in one plan, and the difference of shares that ends them.
SWEEPS, AT_ONCE, CLOSE = 24, 8, 1e-12
#: Cells that are raked in one partition, at most.
FEW = 50_000
#: Rounds that lower unreachable goals, and the factor that values start with that are kept whole to reach theirs.
LOWERED, WHOLE = 8, 1e6
RATE = 0.6
#: Names of missing values.
NONE = "(none)"


def tokens(text: str | Column) -> Column:
    """The number of a text's words split at spaces, tabs and line ends; null: none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t\r\n]+")).cast("long")


#: Signs that mark a kind of writing where they are a twentieth of a text or more, in the order of trial.
KINDS = (("table", "|"), ("symbols", "%#&*$"), ("shouted", "!"))


def topic(text: str | Column) -> Column:
    """A text's topic where the corpus has no topic column: the kind of writing, by its commonest marks or digits."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    n = F.length(text)
    kind = F.when(n == 0, "empty")
    for name, signs in KINDS:
        count = sum((n - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in signs), F.lit(0))
        kind = kind.when(count * 20 >= n, name)
    return kind.when(F.regexp_count(text, F.lit("[0-9]")) * 20 >= n, "figures").otherwise("prose")


def goals_of(cells: DataFrame, margin: str, total: float, rate: float, temper: float, given: DataFrame | None) -> DataFrame:
    """``margin`` and its target share ``goal``: the one given, else the observed share to the power ``temper``,
    normalised; no goal above the observed share over ``rate``. Values without tokens have none. ``start`` is the
    factor that raking begins with."""
    by = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    most = F.col("t") / F.lit(total * rate)
    if given is None:
        out = by.select(margin, most.alias("most"), F.pow("t", F.lit(temper)).alias("goal"))
    else:
        out = by.join(given.select(margin, F.col("goal").alias("goal")), margin, "left").select(margin, most.alias("most"), F.coalesce("goal", F.lit(0.0)).alias("goal"))
    # the scale by which the goals below their bounds and the bounds of the others sum to 1
    scale = 1.0 / (out.agg(F.sum("goal")).first()[0] or 1.0)
    for _ in range(LOWERED):
        full = F.col("goal") * F.lit(scale) >= F.col("most")
        fixed, free = out.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("goal")))).first()
        if not free or (fixed or 0.0) >= 1:
            break
        last, scale = scale, (1 - (fixed or 0.0)) / free
        if scale == last:
            break
    asked = F.col("goal") * F.lit(scale)
    return out.select(margin, F.least(F.col("most"), asked).alias("goal"), F.when(asked >= F.col("most"), WHOLE).otherwise(1.0).alias("start"))


def together(cells: DataFrame, few: bool) -> DataFrame:
    """The cells as one partition where they are few."""
    return cells.coalesce(1) if few else cells


def rake(cells: DataFrame, goals: dict[str, DataFrame], total: float, rate: float, scratch: Scratch, few: bool) -> DataFrame:
    """Adds ``fitted``: the cells' shares of what is kept, raked to the goals within their bounds."""
    out = cells.withColumns({"raked": F.col("tokens") / F.lit(total or 1.0), "most": F.col("tokens") / F.lit((total or 1.0) * rate)})
    for m, table in goals.items():
        out = out.join(table.select(m, F.coalesce("goal", F.lit(0.0)).alias(f"goal_{m}"), F.col("start").alias("_start")), m, "left")
        out = out.withColumn("raked", F.col("raked") * F.coalesce("_start", F.lit(1.0))).drop("_start")
    fitted, path = F.least("raked", "most"), None
    for done in range(0, SWEEPS, AT_ONCE):
        out = together(out, few)
        for _ in range(AT_ONCE):
            for m in goals:
                now = F.sum(fitted).over(Window.partitionBy(m))
                out = out.withColumn("raked", F.when(now > 0, F.col("raked") * F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) / now).otherwise(0.0))
        out, new = scratch.keep(out)
        if path:
            scratch.drop(path)
        path = new
        if done + AT_ONCE < SWEEPS and all(off(together(out, few), m) <= CLOSE for m in goals):
            break
    return out.select(*cells.columns, fitted.alias("fitted"))


def off(raked: DataFrame, m: str) -> float:
    """The largest difference of a margin's shares from its goals."""
    by = raked.groupBy(m).agg(F.sum(F.least("raked", "most")).alias("s"), F.first(F.coalesce(F.col(f"goal_{m}"), F.lit(0.0))).alias("g"))
    return by.agg(F.coalesce(F.max(F.abs(F.col("s") - F.col("g"))), F.lit(0.0))).first()[0]


def chance(id_col: str, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; a null id counts as the empty text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def keys(margins: dict[str, Column]) -> dict[str, Column]:
    return {f"_{m}": F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in margins.items()}


def fit_cells(cells: DataFrame, margins: dict[str, Column], targets: dict[str, DataFrame] | None, rate: float, temper: float, scratch: Scratch, *needed: DataFrame) -> DataFrame:
    """Adds ``fitted``, ``weight`` (fitted over observed share) and ``prob`` to the cells (``_<margin>`` for each
    margin, ``tokens``). A cell without tokens has the weight 1 and the probability ``rate``. Of
    the scratch tables those ``needed`` stay."""
    few = cells.count() <= FEW
    cells = together(cells, few)
    total = float(cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    goals = {f"_{m}": goals_of(cells, f"_{m}", total or 1.0, rate, temper, targets[m].select(F.col(m).alias(f"_{m}"), "goal") if targets and m in targets else None) for m in margins}
    weight = F.when(F.col("tokens") > 0, F.col("fitted") * F.lit(total) / F.col("tokens")).otherwise(1.0)
    out = rake(cells, {m: scratch.table(g) for m, g in goals.items()}, total, rate, scratch, few).withColumn("weight", weight)
    found = scratch.table(out.withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(float(rate)))))
    scratch.release(found, *needed)
    return found


def standard_margins(text_col: str = "text") -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(text_col)}


def weigh(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, rate: float = RATE, temper: float = TEMPER) -> DataFrame:
    """Per row the id, its ``source``, ``lang`` and ``topic`` (or other margins), ``tokens``, ``weight``, ``prob`` and ``kept``.

    ``margins``: name to column; ``targets``: per margin a table of its values and their ``goal`` shares,
    where values that are missing from it have share 0. A null margin value is the value ``(none)``. A null or
    empty text has no tokens and takes the weight of its cell, 1 where the cell has no tokens at all. Rows
    with equal ids are kept or left together. Columns that are not named are not looked at. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    margins = margins or standard_margins(text_col)
    slim = scratch.table(docs.select(F.col(id_col).alias("_id"), tokens(text_col).alias("_tokens"), *[c.alias(k) for k, c in keys(margins).items()]))
    cells = slim.groupBy(*(f"_{m}" for m in margins)).agg(F.sum("_tokens").alias("tokens"))
    cells = fit_cells(scratch.table(cells), margins, targets, rate, temper, scratch, slim).drop("tokens", "fitted")
    found = slim.join(cells, [f"_{m}" for m in margins])
    return found.select(F.col("_id").alias(id_col), *[F.col(f"_{m}").alias(m) for m in margins], F.col("_tokens").alias("tokens"), "weight", "prob", (chance("_id") < F.col("prob")).alias("kept"))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, rate: float = RATE, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs`` that :func:`weigh` keeps, with the columns of ``docs``, whatever their names.

    Nulls in a margin, null and empty texts, repeated ids and empty tables count as in :func:`weigh`."""
    scratch = Scratch(docs.sparkSession, "mixing")
    margins = margins or standard_margins(text_col)
    named = keys(margins)
    cells = docs.select(*[c.alias(k) for k, c in named.items()], tokens(text_col).alias("_tokens")).groupBy(*named).agg(F.sum("_tokens").alias("tokens"))
    cells = fit_cells(scratch.table(cells), margins, targets, rate, temper, scratch)
    *own, prob = unused(docs.columns, *named, "_prob")
    cells = cells.select(*[F.col(k).alias(o) for k, o in zip(named, own)], F.col("prob").alias(prob))
    placed = docs.withColumns({o: c for o, c in zip(own, named.values())}).join(cells, own)
    return placed.where(chance(id_col) < F.col(prob)).select(*[F.col(f"`{c}`") for c in docs.columns])


def margins(weighed: DataFrame, names: tuple[str, ...] = ("source", "lang", "topic")) -> DataFrame:
    """Per value of each margin of what :func:`weigh` returns: ``margin``, ``value``, ``observed`` and ``expected``,
    its shares of all tokens and of the expected tokens of what is kept."""
    kept = F.col("tokens") * F.col("prob")
    whole = weighed.agg(F.sum("tokens").alias("_a"), F.sum(kept).alias("_b"))
    parts = [weighed.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("a"), F.sum(kept).alias("b")).select(F.lit(m).alias("margin"), "value", "a", "b") for m in names]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # one row of sums, so that the join is no larger than the table
    a, b = whole.first() or (0, 0)
    return every.select("margin", "value", (F.col("a") / F.lit(float(a or 1))).alias("observed"), (F.col("b") / F.lit(float(b or 1))).alias("expected"))


def oracle(rate: float = RATE, temper: float = TEMPER) -> str:
    """:func:`weigh` with standard margins and targets as DuckDB SQL, over the table ``documents``."""
    margins = ("source", "lang", "topic")
    kinds = " ".join(f"WHEN (length(t) - length(translate(t, '{signs}', ''))) * 20 >= length(t) THEN '{name}'" for name, signs in KINDS)
    kinds += " WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) * 20 >= length(t) THEN 'figures'"
    steps = [
        "raw AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS t FROM documents)",
        "flat AS (SELECT *, trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS f FROM raw)",
        f"slim AS (SELECT doc_id, source, lang, CASE WHEN length(t) = 0 THEN 'empty' {kinds} ELSE 'prose' END AS topic, CASE WHEN f = '' THEN 0 ELSE length(f) - length(replace(f, ' ', '')) + 1 END AS tokens FROM flat)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM slim GROUP BY ALL)",
        "whole AS MATERIALIZED (SELECT sum(tokens) AS total FROM cells)",
    ]
    for m in margins:
        steps.append(f"by_{m} AS MATERIALIZED (SELECT {m}, sum(tokens) / (total * {rate}) AS most, pow(sum(tokens), {temper}) AS p FROM cells, whole GROUP BY {m}, total HAVING sum(tokens) > 0)")
        # the scale by which goals below their bounds and the bounds of the others sum to 1
        steps.append(
            f"scale_{m}(i, s) AS (SELECT 0, 1 / sum(p) FROM by_{m} UNION ALL SELECT i + 1, CASE WHEN coalesce(free, 0) = 0 OR coalesce(fixed, 0) >= 1 THEN s ELSE (1 - coalesce(fixed, 0)) / free END"
            f" FROM (SELECT i, s, sum(CASE WHEN p * s >= most THEN most END) AS fixed, sum(CASE WHEN p * s < most THEN p END) AS free FROM scale_{m}, by_{m} GROUP BY i, s) WHERE i < {LOWERED})"
        )
        steps.append(f"goal_{m} AS MATERIALIZED (SELECT {m}, least(most, p * s) AS g_{m}, CASE WHEN p * s >= most THEN {WHOLE} ELSE 1.0 END AS b_{m} FROM by_{m}, scale_{m} WHERE i = {LOWERED})")
    turn = "CASE i % 3 WHEN 0 THEN 's' || source WHEN 1 THEN 'l' || lang ELSE 't' || topic END"
    goal = "CASE i % 3 WHEN 0 THEN g_source WHEN 1 THEN g_lang ELSE g_topic END"
    steps.append(
        "fit AS (SELECT 0 AS i, source, lang, topic, tokens, g_source, g_lang, g_topic, tokens / total * coalesce(b_source, 1) * coalesce(b_lang, 1) * coalesce(b_topic, 1) AS raked, tokens / (total * " + f"{rate}) AS most FROM cells CROSS JOIN whole " + " ".join(f"LEFT JOIN goal_{m} USING ({m})" for m in margins) + " UNION ALL"
        f" SELECT i + 1, source, lang, topic, tokens, g_source, g_lang, g_topic, CASE WHEN now > 0 THEN raked * coalesce(goal, 0) / now ELSE 0 END, most"
        f" FROM (SELECT *, {goal} AS goal, sum(least(raked, most)) OVER (PARTITION BY {turn}) AS now FROM fit) WHERE i < {3 * SWEEPS})"
    )
    steps.append(f"probs AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(raked, most) * total / tokens ELSE 1 END AS w, least(1.0, w * {rate}) AS p FROM fit, whole WHERE i = {3 * SWEEPS})")
    chance = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0"
    return "WITH RECURSIVE " + ", ".join(steps) + f" SELECT doc_id, source, lang, topic, tokens, round(w, 6) AS weight, round(p, 6) AS prob, {chance} < p AS kept FROM slim JOIN probs USING (source, lang, topic)"
