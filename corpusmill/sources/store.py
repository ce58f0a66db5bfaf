"""The store: thirteen tables as Parquet, partitioned by run or judge, with keyed upserts.

A table is a folder of written roots and a log of numbered entries; an entry says which root each partition is in. A
change writes a new root for the partitions that it touches, and then the next entry, which is renamed into place and
never replaces another one: readers see the table before or after, whenever a writer dies, and of two writers that began
at the same entry the second gets an error.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; it is removed when the driver ends.

    Only a session on one machine has a default for that folder; on a cluster executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "/tmp/checkpoints/corpusmill"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    atexit.register(remove)
    return path


def zeroed_with_quote(cells: DataFrame, judges: list[str]) -> DataFrame:
    """Cells of some judges whose agreement is 0 although they quote something, in order of their keys."""
    order = [c for c in ("code_number", "pdf_path", "criterion", "chunk_idx", "model") if c in cells.columns]
    return cells.where((F.col("agreement") == 0) & (F.trim("evidence_quote") != "") & F.col("model").isin(judges)).orderBy(*order)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None, order: str | None = None) -> DataFrame:
    """K3-K9: rows of ``source`` overwrite (nulls too) or extend those of ``target``.

    ``update`` limits the columns that an existing row takes over (K9). Of several source rows with one key the one with
    the greatest ``order`` (a column of the source, such as a position) counts: the last one wins. Without it, and among
    equals, the greatest by all columns does. Null keys are equal.
    """
    names = target.columns
    values = [c for c in names if c not in keys]
    changed = set(values if update is None else update)
    own = lambda c: F.col(c).cast(target.schema[c].dataType) if c in source.columns else F.lit(None).cast(target.schema[c].dataType)
    place = F.col(order) if order else F.lit(0)
    new = source.select(*[own(c).alias(f"k{i}") for i, c in enumerate(keys)], F.struct(place.alias("place"), F.struct(*[own(c).alias(c) for c in values], F.lit(True).alias("there")).alias("row")).alias("r"))
    key = [f"k{i}" for i in range(len(keys))]
    new = new.groupBy(*key).agg(F.max("r")["row"].alias("n"))
    old = target.select(*[F.col(c).alias(f"o{k}") for c, k in zip(keys, key, strict=True)], F.struct(*values, F.lit(True).alias("there")).alias("o"))
    match = F.lit(True)
    for k in key:
        match = match & F.col(k).eqNullSafe(F.col(f"o{k}"))
    both = old.join(new, match, "full_outer")

    def pick(c: str) -> Column:
        if c in keys:
            k = key[keys.index(c)]
            return F.when(F.col("o").isNotNull(), F.col(f"o{k}")).otherwise(F.col(k))
        return F.when(F.col("o").isNull(), F.col("n").getField(c)).when(F.col("n").isNull() | F.lit(c not in changed), F.col("o").getField(c)).otherwise(F.col("n").getField(c))

    return both.select(*[pick(c).alias(c) for c in names])


def delete_keys(target: DataFrame, dead: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not listed."""
    return target.join(dead.select(*keys).distinct(), keys, "left_anti").select(*target.columns)


def gold_by_key(gold: DataFrame) -> DataFrame:
    """One label for each (code, path, criterion): of both polarities ``pos`` counts, which the order of the two says."""
    keys = ["code_number", "pdf_path", "criterion"]
    rest = [c for c in gold.columns if c not in (*keys, "polarity")]
    return gold.groupBy(*keys).agg(F.max(F.struct("polarity", *rest)).alias("g")).select(*[F.col(c) if c in keys else F.col(f"g.{c}").alias(c) for c in gold.columns])


class ConcurrentWriteError(RuntimeError):
    """Another writer changed the table first; read it again and repeat the change."""


class Store:
    """Tables under a folder that all machines share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _path(self, *parts: str):
        return self.hadoop.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, table: str) -> tuple[int, dict[str, list[str] | None]]:
        """Number of the newest entry of the log, 0 for none, and its roots with the partitions that count in each."""
        fs, log = self._fs(), self._path(table, "_log")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/{table}/_log/{max(numbers):012d}", wholetext=True).first()[0]
        return max(numbers), json.loads(text)

    def _publish(self, table: str, number: int, roots: dict[str, list[str] | None]) -> None:
        """Writes an entry beside the log and renames it into its place, which fails if the number is taken."""
        draft, place = self._path(table, f"_draft-{uuid.uuid4().hex}"), self._path(table, "_log", f"{number:012d}")
        fs = self._fs()
        fs.mkdirs(self._path(table, "_log"))
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(roots).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(place.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()) if place.toUri().getScheme() else self.hadoop.FileContext.getFileContext(self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(draft, place, options)
        except Exception as error:
            fs.delete(draft, False)
            if fs.exists(place):
                raise ConcurrentWriteError(f"{table}: entry {number} is there already") from error
            raise

    def init(self) -> None:
        """K1: tables that are missing, empty; existing ones stay."""
        for name in TABLES:
            if not self._entry(name)[0]:
                self.write(name, self.spark.createDataFrame([], TABLES[name].schema))

    def read(self, table: str, **where: str) -> DataFrame:
        """A table, filtered by equality (on its partition that prunes files). A table without entries is empty."""
        df = self._roots(table, self._entry(table)[1])
        for column, value in where.items():
            df = df.where(F.col(column) == value)
        return df

    def _roots(self, table: str, roots: dict[str, list[str] | None]) -> DataFrame:
        spec, out = TABLES[table], None
        for root, partitions in roots.items():
            df = self.spark.read.schema(spec.schema).parquet(f"{self.root}/{table}/{root}").select(*spec.schema.names)
            df = df if partitions is None else df.where(F.col(spec.partition).isin(partitions))
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], spec.schema) if out is None else out

    def _write_root(self, table: str, df: DataFrame) -> str:
        spec, root = TABLES[table], f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        writer = df.select(*[F.col(f.name).cast(f.dataType) for f in spec.schema]).write
        (writer.partitionBy(spec.partition) if spec.partition else writer).parquet(f"{self.root}/{table}/{root}")
        return root

    def _replace(self, table: str, number: int, roots: dict[str, list[str] | None], df: DataFrame, touched: list[str] | None) -> None:
        """Publishes ``df`` as the partitions ``touched``, or as the whole table; other partitions stay where they are."""
        root = self._write_root(table, df)
        kept = {} if touched is None else {r: [p for p in partitions if p not in touched] for r, partitions in roots.items()}
        self._publish(table, number + 1, {r: p for r, p in kept.items() if p} | {root: touched})

    def write(self, table: str, df: DataFrame) -> None:
        """The whole table anew; what was there stays until ``vacuum``."""
        number, roots = self._entry(table)
        self._replace(table, number, roots, df, None)

    def upsert(self, table: str, source: DataFrame, update: list[str] | None = None, order: str | None = None) -> None:
        """Keyed upsert; of a partitioned table only the partitions that ``source`` has are read and written."""
        spec = TABLES[table]
        number, roots = self._entry(table)
        touched = [r[0] for r in source.select(F.col(spec.partition).cast("string")).distinct().collect()] if spec.partition else []
        if None in touched:
            raise ValueError(f"{table}: {spec.partition} is null in some rows")
        if spec.partition and all(p is not None for p in roots.values()):
            touched.sort()
            old = self._roots(table, {r: sorted(set(p) & set(touched)) for r, p in roots.items() if set(p) & set(touched)})
            self._replace(table, number, roots, upsert(old, source, list(spec.key), update, order), touched)
            return
        new = upsert(self._roots(table, roots), source, list(spec.key), update, order)
        if not spec.partition:
            self._replace(table, number, roots, new, None)
            return
        root = self._write_root(table, new)  # from here on entries name their partitions
        self._publish(table, number + 1, {root: self._partitions(table, root)})

    def _partitions(self, table: str, root: str) -> list[str]:
        rows = self.spark.read.schema(TABLES[table].schema).parquet(f"{self.root}/{table}/{root}").select(TABLES[table].partition).distinct().collect()
        return sorted(r[0] for r in rows if r[0] is not None)

    def delete(self, table: str, dead: DataFrame, keys: list[str]) -> None:
        if not dead.isEmpty():
            number, roots = self._entry(table)
            self._replace(table, number, roots, delete_keys(self._roots(table, roots), dead, keys), None)

    def vacuum(self, table: str) -> None:
        """Removes roots, drafts and entries that are not in force."""
        number, roots = self._entry(table)
        fs = self._fs()
        for status in fs.listStatus(self._path(table)):
            if status.getPath().getName() not in (*roots, "_log"):
                fs.delete(status.getPath(), True)
        for status in fs.listStatus(self._path(table, "_log")):
            if status.getPath().getName() != f"{number:012d}":
                fs.delete(status.getPath(), False)

    def columns(self, table: str) -> list[str]:
        """Columns of a table as stored, found in its files; those of the schema while it has none."""
        for root in self._entry(table)[1]:
            with contextlib.suppress(AnalysisException):  # a root without rows has no files
                return self.spark.read.parquet(f"{self.root}/{table}/{root}").columns
        return list(TABLES[table].schema.names)

    def key_columns(self, table: str) -> list[str]:
        return list(TABLES[table].key)


def migrate(df: DataFrame, table: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """K2: an older table in today's schema: a missing run is ``baseline``, a missing or blank judge ``unknown``, other
    missing columns null; rows that then share a key become one."""
    spec, given = TABLES[table], {"run": F.lit("baseline"), "model": F.lit("unknown")} | (defaults or {})
    columns = []
    for f in spec.schema:
        present = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in given and f.name in spec.key:
            present = F.coalesce(F.when(present != "", present), given[f.name])
        columns.append(present.alias(f.name))
    rows = df.select(*columns)
    return upsert(rows.limit(0), rows, list(spec.key))


def latest_verdicts_from_scores(scores: DataFrame) -> DataFrame:
    """K2: verdicts that older score rows carried, one a key."""
    return scores.where("verdict is not null").select("code_number", "pdf_path", "criterion", F.coalesce("model", F.lit("unknown")).alias("model"), "verdict", "confidence").distinct()


# Projections of nested records to the grain of the tables


def scores_to_rows(payload: DataFrame, codes: DataFrame, run: str, run_ts: Column) -> DataFrame:
    """``payload(pdf_path, scores map<method, map<criterion, e>>, model)`` to score rows."""
    rows = payload.select("pdf_path", "model", F.explode("scores").alias("method", "m")).select("pdf_path", "model", "method", F.explode("m").alias("criterion", "e"))
    return rows.join(codes, "pdf_path", "left").select(F.lit(run).alias("run"), "code_number", "pdf_path", "method", "criterion", "e", "model", run_ts.alias("run_ts"))


def vectors_to_rows(payload: DataFrame, codes: DataFrame, run: str) -> DataFrame:
    """``payload(pdf_path, vectors map<method, array<vec>>)`` to one row a vector, numbered from 0."""
    rows = payload.select("pdf_path", F.explode("vectors").alias("method", "v")).select("pdf_path", "method", F.posexplode("v").alias("chunk_idx", "vec"))
    return rows.join(codes, "pdf_path", "left").select(F.lit(run).alias("run"), "code_number", "pdf_path", "method", "chunk_idx", "vec")


def poles_to_rows(poles: DataFrame, run: str) -> DataFrame:
    """``poles(criterion, pos, neg)`` to one row a pole."""
    return poles.select(F.lit(run).alias("run"), "criterion", F.explode(F.create_map(F.lit("pos"), "pos", F.lit("neg"), "neg")).alias("pole", "vec"))


def meta_to_rows(spark: SparkSession, meta: dict[str, object], run: str) -> DataFrame:
    """Settings of a run as (run, k, v) strings."""
    return spark.createDataFrame([(run, k, str(v)) for k, v in meta.items()], TABLES["run_meta"].schema)


def gold_to_rows(records: DataFrame) -> DataFrame:
    """Gold rows; a blank criterion is ``all``."""
    return records.withColumn("criterion", F.coalesce(F.when(F.trim("criterion") != "", F.col("criterion")), F.lit("all"))).select(*[f.name for f in TABLES["gold_labels"].schema])


def verdict_rows(records: DataFrame, run_ts: Column, model: str | None = None) -> DataFrame:
    """``records(code_number, pdf_path, criteria map)``; entries without a verdict are passed over."""
    rows = records.select("code_number", "pdf_path", F.explode("criteria").alias("criterion", "v")).where(F.coalesce("v.verdict", F.lit("")) != "")
    return rows.select("code_number", "pdf_path", "criterion", F.lit(model or "unknown").alias("model"), "v.verdict", "v.confidence", "v.graded", "v.prompt_hash", run_ts.alias("run_ts"))


def export_json(df: DataFrame, path: str, papers: DataFrame | None = None) -> None:
    """K15 (append) and K17: JSON lines, only those of ``papers`` where given."""
    rows = df if papers is None else df.join(papers.select("pdf_path").distinct(), "pdf_path", "left_semi")
    rows.write.mode("append").json(path)


def export_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """CSV with a header in one file; for reports, not for corpora."""
    df.coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True, escape='"')


def save_cache(df: DataFrame, path: str) -> None:
    """``(key, value)`` rows as JSON lines, in place of what was there."""
    df.write.mode("overwrite").json(path)


def with_retry(work: Callable[[], object], retries: int = 3, backoff: float = 2.0, transient: Callable[[Exception], bool] = lambda e: isinstance(e, ConnectionError), sleep: Callable[[float], None] = time.sleep) -> object:
    """An idempotent unit of work, again after transient errors with a growing pause."""
    for attempt in range(retries + 1):
        try:
            return work()
        except Exception as error:
            if attempt == retries or not transient(error):
                raise
            sleep(backoff * (attempt + 1))
    return None


@functools.cache
def table_names() -> tuple[str, ...]:
    return tuple(TABLES)
