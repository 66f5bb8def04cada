"""Sources and sinks (survey S1-S19).

Readers stay distributed: only the first two lines of a raw CSV are looked
at on the driver, to find its header.  Scratch output goes under the shared
``spark.checkpoint.dir``, never a machine-local folder.
"""

from __future__ import annotations

import csv
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratecast.operators.aggregates import catalog
from ratecast.operators.windows import dedupe
from ratecast.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint dir."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/artifacts/{name}-{uuid.uuid4().hex[:12]}"


# S1, S2 --------------------------------------------------------------------------
def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str],
                 header_key: str) -> DataFrame:
    """Read raw CSV files that may carry one banner line above their header.

    Records are read, not lines, so a quoted cell may hold line breaks; a
    file is then one task's work, and a folder of files is read in parallel.
    The header is the first line whose cells contain ``header_key``; a line
    before it is a banner.  Both are dropped by their place at the top of
    each file (all files of a folder have the first one's layout), so data
    that happen to equal them stay.  Missing required columns raise.  Cells
    are cast to ``schema`` by column name; one that does not parse is null,
    and columns that the schema does not name are left out."""
    head = [next(csv.reader([r.value]), []) for r in spark.read.text(path).limit(2).collect()]
    if not head:
        return spark.createDataFrame([], schema)
    has_banner = header_key not in [c.strip() for c in head[0]]
    cells = head[1] if has_banner and len(head) > 1 else head[0]
    cols = [c.strip().lstrip("\ufeff") for c in cells]
    missing = [c for c in required if c not in cols]
    if missing:
        raise ValueError(f"input is missing required column(s): {missing}")
    names = [f"_c{i}" for i in range(len(cols))]
    # header=True drops the first record of each file, whatever it holds
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), header=True, multiLine=True, enforceSchema=True, escape='"', mode="PERMISSIVE")
    if has_banner:
        raw = _without_headers(raw, names, cells)
    by_name = {f.name: f for f in schema.fields}
    return raw.select(*[F.col(n).try_cast(by_name[c].dataType).alias(c) for n, c in zip(names, cols) if c in by_name])


def _without_headers(raw: DataFrame, names: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Rows without the first of each file that equals the header.  Only rows
    that equal it are numbered by file; a file's rows lie in order in one
    partition, so their running ids rise."""
    like = F.lit(True)
    for n, c in zip(names, cells):
        like = like & F.col(n).eqNullSafe(F.lit(c if c != "" else None))
    rows = raw.select(*names, F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_id"), like.alias("_like"))
    first = F.row_number().over(Window.partitionBy("_file").orderBy("_id")) > 1
    again = rows.where("_like").withColumn("_again", first).where("_again").drop("_again")
    return rows.where("NOT _like").unionByName(again).select(*names)


def read_joined(fact: DataFrame, dim: DataFrame, on: Sequence[str], project: dict[str, str],
                not_null: Sequence[str] = ()) -> DataFrame:
    """Join, project with aliases, and filter not-null (pushed down to
    the scan by Catalyst)."""
    j = fact.join(dim, list(on), "inner")
    for c in not_null:
        j = j.where(F.col(c).isNotNull())
    return j.select(*[F.col(src).alias(dst) for src, dst in project.items()])


# S5, S6 --------------------------------------------------------------------------
def read_intervals(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """An interval CSV with source column names mapped to
    (category, name, start_date, end_date, ...); unparseable dates -> null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    out = raw.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])
    for c in ("start_date", "end_date"):
        if c in out.columns:
            out = out.withColumn(c, F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))))
    for c in ("ord", "severity"):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("bigint"))
    return out


def unpivot_blocks(df: DataFrame, blocks: Sequence[tuple[str, str, str]], ids: Sequence[str] = ()) -> DataFrame:
    """Side-by-side (date, name) blocks -> long (kind, date, name)
    rows, blank cells skipped."""
    st = ", ".join(f"'{k}', `{d}`, `{n}`" for k, d, n in blocks)
    long = df.selectExpr(*[f"`{i}`" for i in ids], f"stack({len(blocks)}, {st}) AS (kind, date, name)")
    return long.where(F.col("date").isNotNull() & F.col("name").isNotNull() & (F.trim(F.col("name")) != ""))


# S8, S9, S11 ----------------------------------------------------------------------
def write_artifact(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> str:
    """One artifact; ``errorifexists`` refuses to overwrite."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    else:
        w.format(fmt).save(path)
    return path


def write_result_set(results: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """One folder per named result (the multi-sheet workbook re-aimed)."""
    return {name: write_artifact(df, f"{root.rstrip('/')}/{name}", fmt) for name, df in results.items()}


def assert_empty(target: DataFrame) -> None:
    """Refuse to load into a non-empty target."""
    if target.limit(1).count() > 0:
        raise RuntimeError("target is not empty; refusing to load")


# S10 ---------------------------------------------------------------------------
def load_star(df: DataFrame, name: str, source: str, date: str, time: str, arrival: Sequence[str]):
    """A program dimension (id = md5 of the name, first/last date,
    count, first values) and a fact table keyed by it, deduplicated keep
    first on (date, time-of-day mod 24, program)."""
    from ratecast.functions.scalars import time_of_day
    progs = catalog(df, name, date, [source], arrival).withColumnsRenamed(
        {"first_date": "first_aired", "last_date": "last_aired", "n": "n_broadcasts", f"first_{source}": "source_name"})
    progs = progs.withColumn("id", F.md5(F.col(name).cast("string")))
    facts = df.withColumn("program_id", F.md5(F.col(name).cast("string"))).withColumn("tod", time_of_day(time))
    facts = dedupe(facts.withColumn("_d", F.to_date(date)), ["_d", "tod", "program_id"], arrival, keep="first")
    return progs, facts.drop("_d")


# S12, S13, S17 --------------------------------------------------------------------
def upsert_latest(target: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with ``changes`` applied; per key the latest by
    ``order`` wins (changes after the target on ties)."""
    u = (target.withColumn("_src", F.lit(0))
         .unionByName(changes.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    return dedupe(u, key, [*order, "_src"], keep="last").drop("_src")


def append_prediction(preds: DataFrame, programs: DataFrame, name_col: str, id_col: str = "id") -> DataFrame:
    """Look up the program id by name (unknown names dropped) and
    return the rows to append."""
    return preds.join(programs.select(F.col(name_col), F.col(id_col).alias("program_id")), name_col, "inner")


def append_unseen(target: DataFrame, proposals: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target plus proposals whose key is not in it yet."""
    new = proposals.join(target.select(*key).distinct(), list(key), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


# S14 ---------------------------------------------------------------------------
def corrections_to_json(df: DataFrame, keys: Sequence[str], value: str, sep: str = "|") -> DataFrame:
    """One JSON object {"k1|k2": value, ...} with sorted keys (the
    table is one row per cell, so it is small by construction)."""
    k = F.concat_ws(sep, *[F.col(c).cast("string") for c in keys])
    ent = F.array_sort(F.collect_list(F.struct(k.alias("key"), F.col(value).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(ent)).alias("json"))


def corrections_from_json(df: DataFrame, json_col: str, keys: Sequence[str], sep: str = "|") -> DataFrame:
    """Back to one row per cell."""
    m = F.from_json(F.col(json_col), T.MapType(T.StringType(), T.DoubleType()))
    e = df.select(F.explode(m).alias("key", "correction"))
    parts = F.split("key", "\\" + sep if sep in ".|$^*+?()[]{}" else sep)
    return e.select(*[parts[i].alias(c) for i, c in enumerate(keys)], "correction")


# S15 ---------------------------------------------------------------------------
def constraint_report(df: DataFrame, name: str, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (),
                      enums: dict | None = None, fks: Sequence[tuple[str, DataFrame, str]] = (),
                      checks: dict | None = None) -> DataFrame:
    """One row per constraint with its violation count.  Not-null, enum
    and row-level rules (``checks``: text -> condition; like a SQL CHECK, a
    null condition passes) are counted in one scan."""
    rules = {f"{name}.{c} not null": F.col(c).isNull() for c in not_null}
    rules |= {f"{name}.{c} in enum": F.col(c).isNotNull() & ~F.col(c).isin(list(allowed)) for c, allowed in (enums or {}).items()}
    rules |= {f"{name} check {text}": ~cond for text, cond in (checks or {}).items()}
    parts = []
    if rules:
        one = df.agg(F.array(*[F.struct(F.lit(text).alias("constraint"), F.count_if(bad).alias("n"))
                               for text, bad in rules.items()]).alias("r"))
        parts.append(one.select(F.explode("r").alias("r")).select("r.n", "r.constraint"))
    for cols in unique:
        d = df.groupBy(*cols).agg(F.count("*").alias("_c")).where(F.col("_c") > 1)
        parts.append(d.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("n"))
                     .withColumn("constraint", F.lit(f"{name}({','.join(cols)}) unique")))
    for c, parent, pk in fks:
        miss = df.where(F.col(c).isNotNull()).join(parent.select(F.col(pk).alias(c)).distinct(), c, "left_anti")
        parts.append(miss.agg(F.count("*").alias("n")).withColumn("constraint", F.lit(f"{name}.{c} -> parent")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("constraint", F.col("n").cast("bigint").alias("n_violations"))


# S18, S19 ------------------------------------------------------------------------
def load_summary(df: DataFrame, date: str, value: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.min(F.to_date(date)).alias("first_date"),
                  F.max(F.to_date(date)).alias("last_date"), F.avg(value).alias("mean"))


def save_model(model, meta: dict, path: str) -> None:
    """The fitted pipeline plus a metadata JSON beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").text(f"{path}/meta")


def append_run_log(spark: SparkSession, row: dict, path: str) -> None:
    """One line per run, appended."""
    spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "line string").write.mode("append").text(path)

