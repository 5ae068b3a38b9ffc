"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

A run is a table (h1, h2, n, top) dealt into buckets by hash and sorted by it in each: in n rows the line whose
128-bit hash is (h1, h2) occurs, the largest doc_id among them is top. Each new batch of lines is reduced to one
row a hash, merge-anti-joined with the runs (a line that a run alone already counts in enough documents with no
smaller top has nothing to add) and the rest is written as a run of level 0. When a level has two runs they are
merged into one of the next level. Batches are reduced by the same hash and into as many partitions as the runs
have buckets, so the joins and merges read both sides as they lie: no run is ever shuffled or sorted again. A
line's final count is the sum over the runs, which is exact up to min_docs and a lower bound beyond, where only
the top matters.

Cases: a row is a document; rows that share a doc_id count once each and, holding the largest doc_id, keep the
line in each of them. A null doc_id counts as the smallest. A null or empty text is one empty line. A line that
occurs often within one document counts once. Extra columns pass through, but for any named like the three that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored
from tessera.sources.shared import merging, steady, stored_sorted

#: White space that is stripped from a line's ends: space and U+0009 to U+000D.
STRIPPED = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches that a table is fed in: one for every LINES lines, within these bounds.
FEWEST, MOST, LINES = 4, 64, 100_000_000
#: Slices of a document's dropped lines, so that a line is looked for in a small part of them.
SLICES = 256
SMALLEST = -(1 << 63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _slice(h: Column) -> Column:
    return F.pmod(h["h1"], F.lit(SLICES)).cast("int")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levelled index. add() takes (h1, h2, doc_id) rows, one a line and document."""

    def __init__(self, min_docs: int):
        self.min_docs, self.levels = min_docs, [None]

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        for run in (r for r in self.levels if r is not None):
            settled = run.where(F.col("n") >= self.min_docs).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.col("top").alias("stop"))
            own = own.join(settled.hint("merge"), (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")) & (F.col("top") <= F.col("stop")), "left_anti")
        run, k = self._run(own), 0
        while self.levels[k] is not None:  # the second run of a level: both go up
            run, self.levels[k] = self._run(self._merged(self.levels[k], run)), None
            k += 1
            if k == len(self.levels):
                self.levels.append(None)
        self.levels[k] = run

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        with merging(rows.sparkSession):
            return stored_sorted(rows, "line-run", "h1", "h2")

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select("h1", "h2", F.col("n").alias("m"), F.col("top").alias("stop")).hint("merge")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        return a.join(b, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("top", "stop").alias("top"))

    def frequent(self) -> DataFrame:
        """(h1, h2, top) of the lines in min_docs documents or more."""
        runs = [r for r in self.levels if r is not None]
        out = runs[0]
        for r in runs[1:]:
            out = self._merged(out, r)
        return out.where(F.col("n") >= self.min_docs).select("h1", "h2", "top")


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, batches: int | None = None) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text.

    Lines of at least min_chars code points (by key) in at least min_docs documents stay in the documents with
    the largest doc_id holding them and go from the others.
    """
    spark = steady(docs.sparkSession)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(SMALLEST))
    # rows without an id are told apart by their text: together they might be most of the table
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    long = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    each = docs.select(order.alias("doc_id"), own.alias("own"), F.explode(F.array_distinct(F.transform(long, _hash))).alias("h"))
    each = stored(each.select("doc_id", "own", "h.h1", "h.h2"), "lines")
    if batches is None:
        batches = max(FEWEST, min(MOST, each.count() // LINES))  # the count comes from the files' footers
    # the batches: ranges of doc_id, the largest first, so that a settled line meets no larger holder later
    cuts = docs.agg(F.percentile_approx(order, [k / batches for k in range(1, batches)], 1000)).first()[0] or [] if batches > 1 else []
    runs, above = LineRuns(min_docs), None
    for low in [*sorted(set(cuts), reverse=True), None]:
        inside = F.lit(True) if low is None else F.col("doc_id") > low
        runs.add(each.where(inside if above is None else inside & (F.col("doc_id") <= above)))
        above = low
    with merging(spark):
        index = stored(runs.frequent(), "line-index")  # both sides of the join are then plain shuffles, whose hot lines Spark can split
    drops = each.join(index, ["h1", "h2"]).where(F.col("doc_id") != F.col("top"))
    # by document, then by a slice of the hash within it: one shuffle serves both
    key = [F.col("doc_id").alias("__doc"), F.col("own").alias("__own")]
    drops = drops.select(*key, F.struct("h1", "h2").alias("h")).repartition("__doc", "__own")
    drops = drops.groupBy("__doc", "__own", _slice(F.col("h")).alias("slice")).agg(F.collect_set("h").alias("hs"))
    drops = drops.groupBy("__doc", "__own").agg(F.map_from_entries(F.collect_list(F.struct("slice", "hs"))).alias("__drop"))
    # the row as one value: its columns can't clash with those of the join
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*kept_columns).alias("row"), order.alias("order"), own.alias("own"), _lines(F.col("text")).alias("lines"))
    rows = rows.join(drops, (F.col("order") == F.col("__doc")) & (F.col("own") == F.col("__own")), "left")

    def stays(line: Column) -> Column:
        key = line_key(line)
        hit = F.array_contains(F.try_element_at(F.col("__drop"), _slice(_hash(key))), _hash(key))
        return (F.length(key) < min_chars) | ~F.coalesce(hit, F.lit(False))

    kept = F.when(F.col("__drop").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    rows = rows.select("row", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return rows.select("row.*", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


#: The same in DuckDB's SQL, for documents.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT row, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT row) >= 5
), marked AS (
  SELECT k.*, f.key IS NOT NULL AND f.top IS DISTINCT FROM k.doc_id AS dropped FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row, doc_id
"""
