"""Sources: Parquet panels, JSON bars, CSV and HTML constituent lists, dated revisions, an HTTP feed."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources import schemas

#: Fixed value: what a ticker looks like once normalised.
TICKER = r"^[A-Z]{1,5}(\.[A-Z])?$"
MIN_CONSTITUENTS = 400


def load_panel(bars: DataFrame, tickers: Sequence[str] = (), start: str | None = None, end: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Bars of the tickers (none given: of all) between two dates, both included; the columns must hold ticker and ts.

    The filters are plain predicates, so a Parquet scan gets them pushed down and reads the columns asked for.
    """
    columns = list(columns or bars.columns)
    if unknown := [c for c in columns if c not in bars.columns]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    if not {"ticker", "ts"} <= set(columns):
        raise ValueError("the columns must include ticker and ts")
    if tickers:
        bars = bars.where(F.col("ticker").isin(*tickers))
    if start:
        bars = bars.where(F.col("ts") >= F.lit(start).cast("date"))
    if end:
        bars = bars.where(F.col("ts") <= F.lit(end).cast("date"))
    return bars.select(*columns)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BARS).parquet(path)


def load_prices(bars: DataFrame, **where) -> DataFrame:
    return load_panel(bars, columns=("ticker", "ts", "close"), **where)


def load_snapshots(snapshots: DataFrame, index_name: str) -> DataFrame:
    return snapshots.where(F.col("index_name") == index_name)


def coverage(bars: DataFrame) -> DataFrame:
    """(ticker, n_rows, first_ts, last_ts)."""
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def count_bars(bars: DataFrame, ticker: str) -> DataFrame:
    return bars.where(F.col("ticker") == ticker).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def normalise_ticker(raw: Column) -> Column:
    """Upper case, cut at a bracket, dashes as dots; null if that isn't a ticker."""
    name = F.regexp_replace(F.trim(F.split_part(F.upper(F.trim(raw)), F.lit("("), F.lit(1))), "-", ".")
    return F.when(name.rlike(TICKER), name)


def bars_from_json(raw: DataFrame, ticker: str = "ticker", body: str = "body") -> DataFrame:
    """Bars from a vendor's JSON, one document per row: {"results": [{t, o, h, l, c, v, vw, n}]}, t in epoch milliseconds."""
    bars = raw.select(ticker, F.explode(F.from_json(body, schemas.RAW_BARS)["results"]).alias("b"))
    return bars.select(
        F.col(ticker).alias("ticker"), F.to_date(F.timestamp_millis("b.t")).alias("ts"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"),
        F.col("b.c").alias("close"), F.col("b.v").cast("bigint").alias("volume"), F.col("b.vw").alias("vwap"), F.expr("try_cast(b.n as bigint)").alias("n_trades"),
    )


def constituents_csv(revisions: DataFrame, text: str = "csv_text") -> DataFrame:
    """revisions with symbols: the normalised, distinct entries of the column Symbol of a CSV text; none without that column."""
    lines = F.filter(F.split(F.regexp_replace(text, "\r", ""), "\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.transform(F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    at = F.array_position(cells(F.get(lines, F.lit(0))), "Symbol")
    # the place beside each line: inside the function of a line it would be looked for again with every line
    both = F.filter(F.arrays_zip(lines.alias("line"), F.array_repeat(at, F.size(lines)).alias("at")), lambda _, i: i > 0)
    rows = F.transform(both, lambda x: normalise_ticker(F.get(cells(x["line"]), (x["at"] - 1).cast("int"))))
    found = F.when(at > 0, F.array_distinct(F.filter(rows, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>"))
    return revisions.withColumn("symbols", found)


def read_constituents_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ticker): distinct normalised symbols of CSV files with a header."""
    rows = spark.read.csv(path, header=True)
    if "Symbol" not in rows.columns:
        return schemas.empty(spark, "ticker string")
    return rows.select(normalise_ticker(F.col("Symbol")).alias("ticker")).where("ticker is not null").distinct()


def constituents_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with symbols: the first cell of each row of the table whose id is constituents; none without that table."""
    table = F.split_part(F.split_part(F.col(html), F.lit('id="constituents"'), F.lit(2)), F.lit("</table>"), F.lit(1))
    rows = F.regexp_extract_all(table, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    first = F.transform(rows, lambda r: F.regexp_extract(r, r"(?s)<td[^>]*>(.*?)</td>", 1))
    names = F.transform(first, lambda c: normalise_ticker(F.regexp_replace(c, "<[^>]+>", "")))
    return pages.withColumn("symbols", F.array_distinct(F.filter(names, lambda x: x.isNotNull())))


def fetch_constituents(spark: SparkSession, sources: Iterable[Callable[[], DataFrame]], least: int = MIN_CONSTITUENTS) -> DataFrame:
    """(ticker) from the first source that works; an error if that has too few names."""
    problems = []
    for source in sources:
        try:
            found = source().select("ticker").distinct()
            n = found.count()
        except Exception as e:  # noqa: BLE001  the next source is the answer to any failure
            problems.append(f"{type(e).__name__}: {e}")
            continue
        if n < least:
            raise ValueError(f"{n} constituents, at least {least} are expected")
        return found.orderBy("ticker")
    raise ValueError("no source of constituents works: " + "; ".join(problems))


def snapshot_frame(tickers: DataFrame, index_name: str) -> DataFrame:
    """Today's snapshot of the tickers."""
    return tickers.select("ticker", F.lit(index_name).alias("index_name"), F.current_date().alias("as_of"))


def read_revisions(spark: SparkSession, root: str, since: str | None = None) -> DataFrame:
    """(as_of, seq, csv_text) of files under root/as_of=YYYY-MM-DD/, the date coming from the folder.

    Of several files of a day seq follows their names. Unreadable files are skipped.
    """
    rows = spark.read.option("basePath", root).option("ignoreCorruptFiles", "true").text(f"{root}/as_of=*", wholetext=True)
    rows = rows.select(F.col("as_of").cast("date").alias("as_of"), F.input_file_name().alias("_f"), F.col("value").alias("csv_text"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("as_of").orderBy("_f"))).drop("_f")
    return rows if since is None else rows.where(F.col("as_of") >= F.lit(since).cast("date"))


def parse_snapshots(revisions: DataFrame, index_name: str, least: int = MIN_CONSTITUENTS, newest: bool = True) -> DataFrame:
    """(ticker, index_name, as_of) of revisions (as_of, seq, csv_text) with at least `least` names.

    Of several usable revisions of a day the newest counts (the largest seq), or the oldest.
    """
    parsed = constituents_csv(revisions).where(F.size("symbols") >= least)
    order = Window.partitionBy("as_of").orderBy(F.desc("seq") if newest else F.asc("seq"))
    chosen = parsed.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return chosen.select(F.explode("symbols").alias("ticker"), F.lit(index_name).alias("index_name"), "as_of")


class Feed:
    """An HTTP source of daily bars: one request per ticker, evenly spaced, three tries, longer waits when told to slow down."""

    def __init__(self, key: str, per_minute: int = 5, base: str = "https://api.polygon.io", opener: Callable[[str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.key, self.gap, self.base, self.sleep, self.last = key, 60 / per_minute, base, sleep, 0.0
        self.opener = opener or (lambda url: urllib.request.urlopen(url, timeout=30).read())  # noqa: S310

    def daily_bars(self, ticker: str, start: str, end: str) -> str:
        """The JSON body of a ticker's bars."""
        url = f"{self.base}/v2/aggs/ticker/{ticker}/range/1/day/{start}/{end}?adjusted=true&sort=asc&limit=50000&apiKey={self.key}"
        for i in range(3):
            wait = self.last + self.gap - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                return self.opener(url).decode()
            except urllib.error.HTTPError as e:
                if e.code != 429 or i == 2:
                    raise
                self.sleep(15 * (i + 1))
            except urllib.error.URLError:
                if i == 2:
                    raise
        raise RuntimeError("unreachable")


class FeedSource(DataSource):
    """spark.read.format("bar_feed").option("tickers", "A,B").option(...): raw JSON per ticker, in one partition, as requests are throttled."""

    @classmethod
    def name(cls) -> str:
        return "bar_feed"

    def schema(self) -> str:
        return "ticker string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FeedReader(dict(self.options))


class FeedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        o = self.options
        if folder := o.get("folder"):  # recorded answers, for tests and replays
            for t in filter(None, o.get("tickers", "").split(",")):
                with open(f"{folder}/{t}.json") as f:
                    yield t, json.dumps(json.load(f))
            return
        feed = Feed(o["key"], int(o.get("per_minute", "5")))
        for t in filter(None, o.get("tickers", "").split(",")):
            yield t, feed.daily_bars(t, o["start"], o["end"])
