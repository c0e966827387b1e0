"""Reading and writing tables: COPY's formats, imports, exports, dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet table; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def copy_from(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> DataFrame:
    """COPY ... FROM: ``text`` (tab, ``\\N``) or ``csv`` (comma, empty)."""
    if fmt not in ("text", "csv"):
        raise ValueError(f"format {fmt!r} is not readable as text")
    sep = delimiter or ("\t" if fmt == "text" else ",")
    options = {"sep": sep, "nullValue": null if null is not None else ("\\N" if fmt == "text" else ""), "header": header, "mode": "FAILFAST"}
    options |= {"quote": '"', "escape": '"', "multiLine": True, "emptyValue": ""} if fmt == "csv" else {"quote": "", "escape": "\\"}
    return spark.read.schema(schema).options(**options).csv(path)


def copy_to(df: DataFrame, path: str, fmt: str = "text", header: bool = False, delimiter: str | None = None, null: str | None = None) -> None:
    """COPY ... TO, a file for each task."""
    sep = delimiter or ("\t" if fmt == "text" else ",")
    options = {"sep": sep, "nullValue": null if null is not None else ("\\N" if fmt == "text" else ""), "header": header}
    options |= {"quote": '"', "escape": '"', "emptyValue": '""'} if fmt == "csv" else {"quote": "", "escape": "\\"}
    df.write.options(**options).csv(path)


def import_file(spark: SparkSession, path: str, fmt: str, mapping: dict[str, str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """CSV (with header), JSON (one array) or JSON lines, with inferred types; columns renamed or left out."""
    if fmt == "csv":
        df = spark.read.options(header=True, inferSchema=True, multiLine=True, escape='"').csv(path)
    elif fmt in ("json", "jsonl"):
        df = spark.read.option("multiLine", fmt == "json").json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    df = df.drop(*(skip or []))
    return df.withColumnsRenamed(mapping or {})


def export(df: DataFrame, path: str, fmt: str, columns: list[str] | None = None, where: str | None = None, order: list[str] | None = None, limit: int | None = None, table: str = "t") -> None:
    """CSV, JSON lines, Parquet, ORC, or INSERT statements; a file for each task."""
    df = df.where(where) if where else df
    df = df.select(*columns) if columns else df
    df = df.orderBy(*order) if order else df
    df = df.limit(limit) if limit is not None else df
    if fmt == "csv":
        df.write.options(header=True, escape='"').csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.json(path)
    elif fmt in ("parquet", "orc"):
        df.write.format(fmt).save(path)
    elif fmt == "sql":
        inserts(df, table).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def inserts(df: DataFrame, table: str) -> DataFrame:
    """An INSERT statement a row."""

    def value(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        plain = kind in ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean") or kind.startswith("decimal")
        text = c.cast("string") if plain else F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    names = ", ".join(map(quoted, df.columns))
    return df.select(F.concat(F.lit(f"INSERT INTO {quoted(table)} ({names}) VALUES ("), F.concat_ws(", ", *(value(n, k) for n, k in df.dtypes)), F.lit(");")).alias("value"))


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet under its name."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def infer_schema(spark: SparkSession, path: str, fmt: str) -> StructType:
    return import_file(spark, path, fmt).schema


def write_partitioned(df: DataFrame, path: str, by: list[str], files_a_partition: int = 1) -> None:
    """Partitioned Parquet; a hot partition value is dealt over several tasks."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_a_partition))
    df.repartition(*by, salt).write.partitionBy(*by).parquet(path)
