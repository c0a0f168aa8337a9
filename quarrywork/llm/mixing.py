"""Mixing sources to target weights by capped water-filling.

Sizes are words. A budget (share of all words) is poured over the sources in
proportion to their weights. A source whose level reaches its cap (max_epochs
times its size) is clamped there, and the excess goes to the others by weight
until none is above its cap. With sources sorted by cap per weight that
iteration has a closed form: the first j are clamped, and the rest share what
is left. It needs one row per source, so the sort is over a tiny table.

A source's target is then taken from its documents: all of them whole as often
as fits, and a last, fractional repetition. For that, the source's words lie
on a line in the order of a seeded hash of the document's id, then of size, then
of the row. Documents before the cut are repeated once more, the one at the cut
in part, those behind not. The cut is found in levels: sums over buckets of the
hash tell which bucket holds it, sums over the distinct (id, size) of that
bucket which of these does, and counts over buckets of their rows which row; so
no task holds a whole source, nor all rows of one id. What is joined to the
documents is one row per source; more than MAX_SOURCES sources are refused, as
the level of the water is worked out in one task.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source of its own and sorts last; sources without words have target 0;
rows that share an id share a place on the line, ordered by size, and which of
rows equal in both are taken may differ, not how many or how much; an empty
table gives an empty table. Other columns of the input are ignored by mix() and
kept by sample(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_names, saved

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
MAX_SOURCES = 5_000_000
#: Buckets into which rows of one id and size are counted.
LOTS = 4096


def word_count(text):
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(origin, source_size, target) from (origin, source_size), one row per source; weights go by the order of origin."""
    whole = Window.partitionBy(F.lit(0))
    nth = F.pmod(F.row_number().over(whole.orderBy("origin")) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth + 1)
    by_level = whole.orderBy("level", "origin")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("nth", F.row_number().over(by_level))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(after))
        # clamped when, with all lower levels clamped, its fair part still reaches its cap
        .withColumn("clamped", F.col("left") * F.col("weight") >= F.col("cap") * F.col("open"))
        .withColumn("water", F.min(F.when(~F.col("clamped"), F.struct("nth", "left", "open"))).over(whole))
    )
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * F.col("water.left") / F.col("water.open"))
    return levels.select("origin", "source_size", target.alias("target"))


def _line(doc_id, source, text, seed: str):
    """Expressions of a row: its source as one string that is never null (code point order, null last), size, and place on the line."""
    origin = F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return origin.alias("origin"), word_count(text).alias("size"), place.alias("place"), F.monotonically_increasing_id().alias("row")


def _sized(documents: DataFrame, seed: str) -> DataFrame:
    return documents.select("doc_id", *_line(F.col("doc_id"), F.col("source"), F.col("text"), seed))


def _at():
    """Where a row lies on its source's line."""
    return F.struct("place", "size", F.pmod(F.xxhash64("row"), F.lit(LOTS)).alias("lot"), "row")


def decisions(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, digits: int = 3) -> DataFrame:
    """One row per source: origin, source_size, target, repeats (whole ones), and where the fractional one is cut: cut_at (as _at()) and part.

    digits: hexadecimal digits of the hash that name a bucket. Only the one
    bucket of each source that holds its cut is put in order.
    """
    bucket = F.substring("place", 1, digits)
    per_bucket = sized.groupBy("origin", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sizes = per_bucket.groupBy("origin").agg(F.sum("bucket_size").alias("source_size"))
    many = F.count("*").over(Window.partitionBy(F.lit(0))) > MAX_SOURCES
    per_source = targets(sizes, weights, share, max_epochs).withColumn("target", F.when(many, F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))).otherwise(F.col("target")))
    words, full = F.round(F.col("target")).cast("long"), F.col("source_size") > 0
    repeats = F.when(full, F.floor(words / F.col("source_size"))).otherwise(0)
    per_source = per_source.withColumn("repeats", repeats).withColumn("cut", words - F.col("repeats") * F.col("source_size"))
    up_to = lambda *order: Window.partitionBy("origin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda what, *order: F.coalesce(F.sum(what).over(up_to(*order)), F.lit(0))
    # the bucket that holds the cut, of its distinct (place, size) the one, and how many of their words lie before the cut
    placed = per_bucket.withColumn("bucket_at", before("bucket_size", "bucket")).join(per_source.select("origin", "cut"), "origin")
    open_buckets = placed.filter((F.col("bucket_at") <= F.col("cut")) & (F.col("cut") < F.col("bucket_at") + F.col("bucket_size"))).select("origin", "bucket", (F.col("cut") - F.col("bucket_at")).alias("left"))
    pairs = sized.withColumn("bucket", bucket).join(open_buckets, ["origin", "bucket"]).groupBy("origin", "place", "size", "left").agg(F.count("*").alias("rows"))
    pairs = pairs.withColumn("left", F.col("left") - before(F.col("size") * F.col("rows"), "place", "size")).filter((F.col("left") >= 0) & (F.col("left") < F.col("size") * F.col("rows")))
    # of the rows equal in these, the one at the cut: the nth by lot and row
    pairs = pairs.select("origin", "place", "size", F.floor(F.col("left") / F.col("size")).alias("nth"), (F.col("left") % F.col("size")).alias("part"))
    equal = sized.select("origin", "place", "size", "row", _at()["lot"].alias("lot")).join(pairs, ["origin", "place", "size"])
    lots = equal.groupBy("origin", "lot", "nth").agg(F.count("*").alias("rows")).withColumn("nth", F.col("nth") - before("rows", "lot")).filter((F.col("nth") >= 0) & (F.col("nth") < F.col("rows")))
    inside = equal.drop("nth").join(lots.drop("rows"), ["origin", "lot"]).withColumn("n", F.row_number().over(Window.partitionBy("origin").orderBy("row")) - 1)
    cuts = inside.filter("n = nth").select("origin", F.struct("place", "size", "lot", "row").alias("cut_at"), "part")
    return per_source.drop("cut").join(cuts, "origin", "left")


def _part():
    """Words of the fractional repetition that a document gives."""
    return F.when(_at() < F.col("cut_at"), F.col("size")).when(_at() == F.col("cut_at"), F.col("part")).otherwise(0)


def mix(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, scope: str = "session") -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words the mix takes of it."""
    sized = saved(_sized(documents, seed), scope)
    plan = saved(decisions(sized, weights, share, max_epochs), scope)
    taken = (F.col("size") * F.col("repeats") + _part()).cast("long")
    return sized.join(plan, "origin").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def sample(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, scope: str = "session") -> DataFrame:
    """The mix itself: rows of documents, as often as taken; a fractional repetition that falls inside a document gives its first words.

    documents is read twice and should be a table, so that its rows are numbered alike both times.
    """
    columns = documents.columns
    plan = saved(decisions(saved(_sized(documents, seed), scope), weights, share, max_epochs), scope)
    plain = plain_names(documents)
    of = lambda name: F.col(plain.columns[columns.index(name)])
    keyed = plain.select(*plain.columns, *_line(of("doc_id"), of("source"), of("text"), seed)).join(plan, "origin")
    # copy 0 is the fractional one, 1 and on are whole; all come from one read, in which the words of a text are counted once:
    # a condition on size alone would be pushed below the join, where it counts them again
    copies = F.least(F.col("size"), F.lit(1)) * (F.col("repeats") + F.when(_part() == F.col("size"), 1).otherwise(0))
    first = F.when((_at() == F.col("cut_at")) & (F.col("part") > 0), 0).otherwise(1).cast("long")
    taken = keyed.withColumn("first", first).withColumn("copies", copies).filter("first <= copies").withColumn("copy", F.explode(F.sequence("first", "copies")))
    head = F.array_join(F.slice(F.regexp_extract_all(of("text"), F.lit(r"([^\x20\x09-\x0D]+)"), 1), 1, F.col("part").cast("int")), " ")
    rows = taken.withColumn(plain.columns[columns.index("text")], F.when(F.col("copy") == 0, head).otherwise(of("text")))
    if "n_chars" in columns:
        length = F.char_length(of("text")).cast(documents.schema["n_chars"].dataType)
        rows = rows.withColumn(plain.columns[columns.index("n_chars")], F.when(F.col("copy") == 0, length).otherwise(of("n_chars")))
    return rows.select(*plain.columns).toDF(*columns)


#: What mix() returns, for DuckDB.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS origin,
         CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT origin, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY origin),
w AS (
  SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY origin) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, CAST(SUM(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM s),
l AS (
  SELECT *, ROW_NUMBER() OVER v AS nth, budget - COALESCE(SUM(cap) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         SUM(weight) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM w WINDOW v AS (ORDER BY cap / weight, origin)),
c AS (SELECT *, rest * weight >= cap * open AS clamped FROM l),
f AS (SELECT MIN(nth) AS nth FROM c WHERE NOT clamped),
t AS (
  SELECT c.origin, c.source_size, CASE WHEN c.clamped THEN c.cap ELSE c.weight * o.rest / o.open END AS target
  FROM c LEFT JOIN f ON TRUE LEFT JOIN c AS o ON o.nth = f.nth),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(ROUND(t.target) AS BIGINT) AS words,
         COALESCE(SUM(d.size) OVER (PARTITION BY d.origin ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
  FROM d JOIN t USING (origin))
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE size * (words // source_size) + GREATEST(0, LEAST(size, words % source_size - before_it)) END AS BIGINT) AS taken
FROM p
"""
