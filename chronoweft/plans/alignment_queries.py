"""Queries that align scripts to takes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoweft.operators import alignment
from chronoweft.plans.registry import query
from chronoweft.plans.views import table

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"
#: Runs of three words as text in place of their hashes: the rarest are told apart by their number of places only, so all that tie with the eighth are compared.
_PLACES = rf"""w AS (SELECT doc_id AS s, {_WORDS.format("text")} AS w FROM documents), g0 AS (SELECT item_id AS t, {_WORDS.format("text")} AS w FROM benchmark),
g AS (SELECT t, k - 1 AS i, n, array_to_string(w[k : k + n - 1], ' ') AS run FROM (SELECT t, w, least(3, len(w)) AS n, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS k FROM g0 WHERE len(w) > 0)),
p AS (SELECT s, k - 1 AS j, n, array_to_string(w[k : k + n - 1], ' ') AS run FROM (SELECT s, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM w, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
q AS (SELECT * FROM p WHERE (n, run) IN (SELECT (n, run) FROM g)), f AS (SELECT n, run, count(*) AS places FROM q GROUP BY n, run)"""


def _both(spark, sf_dir):
    return table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id"


@query("script_runs", f"""WITH {_PLACES} SELECT t AS item_id, i, CAST(places AS BIGINT) AS places FROM g JOIN f USING (n, run)""")
def script_runs(spark, sf_dir):
    """Every run of a target with the number of its places in the sources: what `seeds` chooses the rarest from."""
    targets, sources, t, s = _both(spark, sf_dir)
    every = alignment.seeds(targets, sources, t, s, rarest=1 << 30)
    return every.groupBy(t, "i").agg(F.count("*").alias("places"))


@query("script_seeds", f"""WITH {_PLACES} SELECT t AS item_id, s AS doc_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j FROM g JOIN f USING (n, run) JOIN q USING (n, run)""")
def script_seeds(spark, sf_dir):
    """All seeds, frequent runs too."""
    targets, sources, t, s = _both(spark, sf_dir)
    return alignment.seeds(targets, sources, t, s, rarest=1 << 30)


@query("script_takes")
def script_takes(spark, sf_dir):
    targets, sources, t, s = _both(spark, sf_dir)
    return alignment.takes(targets, sources, t, s)


@query("script_paths")
def script_paths(spark, sf_dir):
    targets, sources, t, s = _both(spark, sf_dir)
    return alignment.assemble(alignment.takes(targets, sources, t, s), targets, t, s)


@query("spoken_takes")
def spoken_takes(spark, sf_dir):
    """Turns of the users as targets, those of the assistants as takes."""
    c = table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    targets, sources = c.filter("role = 'user'").withColumnRenamed("key", "target"), c.filter("role = 'assistant'").withColumnRenamed("key", "source")
    paths = alignment.assemble(alignment.takes(targets, sources, "target", "source"), targets, "target", "source")
    return paths.select(F.col("target.conv_id").alias("conv_id"), F.col("target.turn").alias("turn"), "take", F.col("source.conv_id").alias("take_conv"), F.col("source.turn").alias("take_turn"), "t_from", "t_to", "s_from", "s_to", "score", "coverage", "status")


@query("target_units", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
b AS (SELECT doc_id, line, trim(raw, ' ' || chr(9) || chr(13)) AS bare FROM l), m AS (SELECT *, starts_with(bare, '```') AS fence FROM b),
i AS (SELECT *, count(*) FILTER (fence) OVER w % 2 = 1 AS inside FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
h AS (SELECT *, CASE WHEN NOT fence AND NOT inside AND starts_with(bare, '#') THEN trim(regexp_replace(regexp_replace(bare, '^#+', ''), '\s+', ' ', 'g')) END AS heading FROM i),
s AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), '') AS section FROM h),
p AS (SELECT doc_id, line, section, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '^([-*+]\s+|\d+[.)、]\s*)', ''), '^\[[ xX]\]\s*', ''), '\*\*|__|`', '', 'g'), '\s+', ' ', 'g')) AS text
  FROM s WHERE NOT fence AND NOT inside AND heading IS NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS "index", section, text FROM p WHERE regexp_matches(text, '[\p{L}\p{N}]')""")
def target_units(spark, sf_dir):
    return alignment.target_units(table(spark, sf_dir, "documents"), "doc_id")
