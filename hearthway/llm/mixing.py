"""Mixing sources to target weights.

Sizes are summed by source, targets are filled under the repetition cap, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy whose probability is the fraction: a document's draw depends on its id, its
size and its source's seed alone. Of several seeds each source takes the one whose draws come nearest to its target,
which one pass of sums tells, so that a few long documents do not carry a source far from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, forget, numbered_within, settle, spread_join, unused

#: Seeds that a source may choose from: DRAWS digests with four draws of 32 bits each.
DRAWS = 4
#: Sources whose lines (some 50 bytes each) are broadcast; with more the documents are joined to them by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draws(seed: str, digests: int = DRAWS) -> Column:
    """Numbers in [0, 1) from MD5 digests of seed, doc_id and size, four of each; plain SQL can compute the same."""
    digest = lambda i: F.md5(F.concat_ws("|", F.lit(f"{seed}-{i}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    parts = [F.conv(F.substring(digest(i), 8 * j + 1, 8), 16, 10).cast("long") / F.lit(4294967296.0) for i in range(digests) for j in range(4)]
    return F.array(*parts)


def fill_targets(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """Add ``target`` to settled sources(source_size, weight): shares of all words by weight, capped, the excess reshared.

    The level L solves sum(min(L * weight, max_repeat * size)) = sum(size). Sources above their cap at one level stay
    above it at the next, so the level only rises until none is added; a round is one sum over the sources.
    """
    cap = F.col("source_size") * F.lit(max_repeat)
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.lit(level) * F.col("weight") > cap
        free = ~over
        n, total, held, weights = sources.agg(F.count_if(over), F.sum("source_size"), F.sum(F.when(over, cap).otherwise(F.lit(0))), F.sum(F.when(free, F.col("weight")).otherwise(F.lit(0)))).first()
        if n == capped or not weights:
            break
        level, capped = float(total - held) / float(weights), n
    share = F.lit(level).cast("double") * F.col("weight")
    return sources.withColumn("target", F.when(share.isNull() | (share > cap), cap.cast("double")).otherwise(share))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("-"))
    return [F.col(id_col).cast("long").alias("doc_id"), key.alias("_key"), word_count(F.col(text_col)).alias("size")]


def plan_sources(rows: DataFrame, weights: tuple[int, ...], max_repeat: int, seed: str) -> DataFrame:
    """_key, source_size, target, _rate, _seed and _rows of each source of settled rows(doc_id, _key, size)."""
    # sources in order, in as many ranges as there are partitions; no task holds them all
    named = rows.groupBy("_key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")).withColumn("_none", F.col("_key") == "-")
    ranged = settle(named.repartitionByRange("_none", "_key").withColumn("_range", F.spark_partition_id()), "mix-ranges")
    ranked = numbered_within(ranged, [], F.col("_range"), name="_rank", order=[F.col("_none"), F.col("_key")])
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = settle(ranked.select("_key", "source_size", "_rows", turn.cast("long").alias("weight")), "mix-ranked")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aimed = settle(fill_targets(ranked, max_repeat).withColumn("_rate", rate).drop("weight"), "mix-aimed")
    drawn = spread_join(rows, aimed, ["_key"], "_rows", F.xxhash64("doc_id", "size")).withColumn("_drawn", extra_copies(seed))
    taken = [F.sum(F.when(F.col("_drawn")[i], F.col("size")).otherwise(F.lit(0))) for i in range(4 * DRAWS)]
    sums = drawn.groupBy("_key").agg(F.array(*taken).alias("_extra"))
    off = F.transform("_extra", lambda x, i: F.struct(F.abs(F.floor("_rate") * F.col("source_size") + x - F.col("target")).alias("off"), i.alias("seed")))
    chosen = settle(aimed.join(sums, "_key").withColumn("_seed", F.array_min(off)["seed"]).drop("_extra"), "mix-sources")
    for table in (ranged, ranked, aimed):
        forget(table)
    return chosen


def extra_copies(seed: str) -> Column:
    """For each seed whether a row(doc_id, size, _rate) gets a copy beyond the whole ones."""
    return F.transform(draws(seed), lambda u: u < F.col("_rate") - F.floor("_rate"))


def _copies(seed: str) -> Column:
    return F.floor("_rate").cast("long") + F.get(extra_copies(seed), F.col("_seed")).cast("long")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each input row: doc_id, size, source_size, target, copies, taken.

    Sources by code point, null last (a null source is one of its own), weigh ``weights`` in turn. A null text has
    size 0; a source without words has target 0. Rows equal in id and size draw alike. Other columns are not read; an
    empty table gives no rows.
    """
    rows = settle(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    sources = plan_sources(rows, weights, max_repeat, seed)
    placed = spread_join(rows, sources, ["_key"], "_rows", F.xxhash64("doc_id", "size")).withColumn("copies", _copies(seed))
    return placed.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan says, with its columns; see ``plan_mix``.

    A row's copies follow from its own columns and its source's line, so with few sources no text is shuffled.
    """
    rows = settle(docs.select(*_sized(docs, id_col, text_col, source_col)), "mix-sizes")
    sources = plan_sources(rows, weights, max_repeat, seed).select("_key", "_rate", "_seed", "_rows")
    forget(rows)
    held = unused(docs, "held")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held), *_sized(docs, id_col, text_col, source_col))
    if sources.count() <= BROADCAST_SOURCES:
        joined = whole.join(F.broadcast(sources), "_key")
    else:
        joined = spread_join(whole, sources, ["_key"], "_rows", F.xxhash64("doc_id", "size"))
    times = joined.withColumn("_copies", _copies(seed)).filter("_copies > 0")
    return times.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select(f"{held}.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP9_SQL = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce('=' || source, '-') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sized AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY key, source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized),
weighed AS (SELECT *, ((rank - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM ranked),
walked AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT level AS l FROM walked WHERE level * weight <= cap ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
aimed AS (
  SELECT w.*, CASE WHEN l IS NULL OR l * weight > cap THEN cap::DOUBLE ELSE l * weight END AS target
  FROM walked w LEFT JOIN lev ON true),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed),
drawn AS (
  SELECT r.n, r.doc_id, r.size, s.key, s.source_size, s.target, s.rate, g.i AS seed,
         ('0x' || substr(md5('mix-' || (g.i // 4) || '|' || coalesce(r.doc_id::VARCHAR, 'null') || '|' || r.size), 8 * (g.i % 4) + 1, 8))::BIGINT
         / 4294967296.0::DOUBLE < rate - floor(rate) AS extra
  FROM rows_ r JOIN rated s USING (key) CROSS JOIN range(16) g(i)),
sums AS (
  SELECT key, seed, abs(floor(rate) * source_size + coalesce(sum(size) FILTER (WHERE extra), 0) - target) AS off
  FROM drawn GROUP BY key, seed, rate, source_size, target),
chosen AS (SELECT key, seed FROM sums QUALIFY row_number() OVER (PARTITION BY key ORDER BY off, seed) = 1)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + extra::INT) * size AS taken, floor(rate)::BIGINT + extra::INT AS copies
FROM drawn JOIN chosen USING (key, seed)
"""
