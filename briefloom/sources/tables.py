"""Input bundle, history table and run output."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from briefloom import schemas
from briefloom.functions import dates
from briefloom.functions.core import sql_string
from briefloom.functions.text import value_text

_BUNDLE_QUOTE = "ARRAY<STRUCT<symbol: STRING, price: VARIANT, change: VARIANT, range: STRING, open: DOUBLE, close: DOUBLE, source: STRING>>"
_BUNDLE_ITEM = (
    "ARRAY<STRUCT<title: STRING, url: STRING, `desc`: STRING, source_name: STRING, source_type: STRING, published_at: STRING, "
    "tags: VARIANT, metadata: VARIANT>>"
)
_CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Bundles:
    """Landed bundles. `rejects`: run_id and text of those which are no JSON object of this shape."""

    items: DataFrame
    quotes: DataFrame
    rejects: DataFrame


def read_bundles(spark: SparkSession, path: str, *, lines: bool = False) -> Bundles:
    """JSON bundles to raw items with `category`, quotes with `market`, and what could not be read.

    One object per file, which names the run; with `lines` one object per line, which has a `run_id` of its own. Tags may be any JSON;
    only lists of them count. Of the metadata the fields which later rules ask for become columns, the rest stays as `metadata`, a
    VARIANT. Price and change keep their texts (`price_text`, `change_text`) beside the numbers; what is no number gives NULL.
    """
    schema = (
        f"run_id STRING, us_stocks {_BUNDLE_QUOTE}, tw_stocks {_BUNDLE_QUOTE}, stock_news {_BUNDLE_ITEM}, ai_news {_BUNDLE_ITEM}, {_CORRUPT} STRING"
    )
    # parsed as an expression, as readers refuse to show broken records alone
    texts = spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("_file"), "value")
    parsed = texts.withColumn("_p", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}))
    read = F.col("_p").isNotNull() & F.col(f"_p.{_CORRUPT}").isNull()
    run_id = F.col("_p.run_id") if lines else F.col("_file")
    good = parsed.filter(read).select(run_id.alias("run_id"), "_p.us_stocks", "_p.tw_stocks", "_p.stock_news", "_p.ai_news")

    def each(columns: dict[str, str], name: str) -> DataFrame:
        parts = [good.select("run_id", F.lit(value).alias(name), F.posexplode(column).alias("pos", "e")) for column, value in columns.items()]
        return reduce(DataFrame.unionByName, parts).select("run_id", name, F.col("pos").cast("bigint").alias("seq"), "e.*")

    tags = F.when(F.schema_of_variant("tags").startswith("ARRAY"), F.array_compact(F.try_variant_get("tags", "$", "array<string>")))
    items = each({"stock_news": "stock_news", "ai_news": "ai_news"}, "category").select(
        "run_id", "category", "seq", "title", "url", "desc", "source_name", "source_type", F.col("published_at").alias("published_at_raw"),
        tags.alias("tags"), F.try_variant_get("metadata", "$.keyword_match", "string").alias("keyword_match"),
        F.try_variant_get("metadata", "$.recent_feature_signal", "boolean").alias("recent_feature_signal"), "metadata",
    )
    span = F.split("range", "-", 2)
    quotes = each({"us_stocks": "us", "tw_stocks": "tw"}, "market").select(
        "run_id", "market", "seq", "symbol", F.try_variant_get("price", "$", "double").alias("price"), value_text(F.col("price")).alias("price_text"),
        value_text(F.col("change")).try_cast("double").alias("change"), value_text(F.col("change")).alias("change_text"),
        F.get(span, F.lit(0)).try_cast("double").alias("low"), F.get(span, F.lit(1)).try_cast("double").alias("high"), "open", "close", "source",
    )
    rejects = parsed.filter(~read).select(run_id.alias("run_id"), F.col("value").alias("text"))
    return Bundles(items, quotes, rejects)


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Items and quotes of JSON bundles, one per file; files which cannot be read are left out (`read_bundles` has them)."""
    found = read_bundles(spark, path)
    return found.items.drop("metadata"), found.quotes


def repair_history(entries: DataFrame, now: Column) -> DataFrame:
    """Rows without category or fingerprint go; an unreadable `seen_at` text becomes now."""
    seen = dates.parse_published_at(F.col("seen_at")) if dict(entries.dtypes)["seen_at"] == "string" else F.col("seen_at")
    pos = F.col("pos") if "pos" in entries.columns else F.lit(0)
    return entries.filter((F.coalesce("fingerprint", F.lit("")) != "") & F.col("category").isNotNull()).select(
        "category", "fingerprint", F.coalesce(seen, now).alias("seen_at"), pos.cast("bigint").alias("pos")
    )


class VersionTaken(RuntimeError):
    """Another writer has published the version which would follow the one this writer started from."""


class HistoryTable:
    """History as numbered parquet versions under one folder; a version is published at once and never changed.

    A writer lays its rows down in a folder of its own, then moves it to the next number. Of two writers one gets the number; the other
    one is told (`VersionTaken`), or takes the number after it where it does not say what it started from. Readers take the newest
    version, so a lost job leaves the last good one in place. A `tag` names the work behind a version: writing a version whose tag is
    there does nothing, which makes a retried micro-batch safe.

    With `buckets` rows are laid out by (category, fingerprint), and the table is read with that layout: joins and aggregates on these
    columns do not shuffle the history. Spark keeps layouts in its catalog, so each version read is an external table there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _hadoop(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._hadoop(*parts)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        found = (n for n in self._names() if n.startswith("version=") and self._hadoop(n, "_SUCCESS")[1].exists(self._hadoop(n, "_SUCCESS")[0]))
        return sorted(int(n.split("=", 1)[1]) for n in found)

    def version_of(self, tag: str) -> int | None:
        """The version which was written under this tag."""
        return next((v for v in reversed(self.versions()) if f"_tag-{tag}" in self._names(f"version={v}")), None)

    def _rows(self, version: int) -> DataFrame:
        folder = f"{self.path}/version={version}"
        # reads the footers of all files: a broken one is found here
        found = self.spark.read.option("mergeSchema", "true").parquet(folder)
        buckets = next((n.rsplit("-", 1)[1] for n in self._names(f"version={version}") if n.startswith("_buckets-")), None)
        if buckets is None:
            return found
        name = f"briefloom_history_{hashlib.sha256(folder.encode()).hexdigest()[:24]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS (path {sql_string(folder)}) "
            f"CLUSTERED BY (category, fingerprint) SORTED BY (category, fingerprint) INTO {buckets} BUCKETS"
        )
        return self.spark.table(name)

    def read(self, version: int | None = None, on_error: str = "raise") -> DataFrame:
        """Newest version, or the newest one below `version`, repaired (`repair_history`): a time nobody can read is that of its version.

        A missing table is empty. The footers of all files of a version are read first. If that fails it raises, or with
        `on_error="empty"` the version before is taken, and without any the table is empty.
        """
        known = [v for v in self.versions() if version is None or v < version]
        for v in reversed(known):
            try:
                found = self._rows(v)
                path, fs = self._hadoop(f"version={v}", "_SUCCESS")
                written = fs.getFileStatus(path).getModificationTime()
                return repair_history(found, F.timestamp_millis(F.lit(written)))
            except Exception:
                if on_error != "empty":
                    raise
        return self.spark.createDataFrame([], schemas.HISTORY)

    def write(self, history: DataFrame, version: int | None = None, *, after: int | None = None, tag: str | None = None) -> int:
        """Publish rows and return their version.

        `version` asks for a number; if it is there, or a version with the `tag`, nothing is written. `after` is the version these rows
        were made from (-1: none): if another one was published since, nothing is and `VersionTaken` is raised.
        """
        if tag is not None and (done := self.version_of(tag)) is not None:
            return done
        if version is not None and version in self.versions():
            return version
        staged = f"staged-{uuid.uuid4().hex}"
        rows = history.select("category", "fingerprint", "seen_at", "pos")
        if self.buckets:
            table = f"briefloom_{staged.replace('-', '_')}"
            rows = rows.repartition(self.buckets, "category", "fingerprint")
            rows.write.format("parquet").bucketBy(self.buckets, "category", "fingerprint").sortBy("category", "fingerprint").option(
                "path", f"{self.path}/{staged}").saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")  # the files stay
        else:
            rows.write.parquet(f"{self.path}/{staged}")
        for mark in ([f"_tag-{tag}"] if tag else []) + ([f"_buckets-{self.buckets}"] if self.buckets else []):
            path, fs = self._hadoop(staged, mark)
            fs.create(path, True).close()
        return self._publish(staged, version, after)

    def _publish(self, staged: str, version: int | None, after: int | None) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        source, fs = self._hadoop(staged)
        context = hadoop.FileContext.getFileContext(source.toUri() if source.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            known = self.versions()
            target = version if version is not None else (known[-1] if known else -1) + 1 if after is None else after + 1
            try:
                if known and after is not None and known[-1] > after:
                    raise FileExistsError
                context.rename(source, self._hadoop(f"version={target}")[0], options)
                return target
            except (FileExistsError, Py4JJavaError) as problem:
                if isinstance(problem, Py4JJavaError) and "FileAlreadyExists" not in str(problem.java_exception) and target not in self.versions():
                    raise
                if version is not None or after is not None:
                    fs.delete(source, True)
                if version is not None:
                    return version
                if after is not None:
                    raise VersionTaken(f"version {after + 1} of {self.path} was published by another writer") from None

    def update(self, change: Callable[[DataFrame], DataFrame], attempts: int = 10) -> int:
        """Replace the history by `change(history)`, again from the newest version where another writer was faster."""
        for _ in range(attempts - 1):
            known = self.versions()
            try:
                return self.write(change(self.read()), after=known[-1] if known else -1)
            except VersionTaken:
                continue
        known = self.versions()
        return self.write(change(self.read()), after=known[-1] if known else -1)


def write_run(tables: dict[str, DataFrame], path: str, run_date: str) -> None:
    """Every output table of a run, partitioned by run date; a repeated run replaces its own date only."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_date={run_date}")
