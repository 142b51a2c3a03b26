"""Data-quality checks of registry tables: each gives the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A table of tab-separated text with a header; blank lines are left out and missing cells are empty."""
    rows = spark.read.csv(path, sep="\t", header=True, mode="PERMISSIVE", quote="")
    return rows.fillna("").filter(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in rows.columns])) != "")


def missing_columns(table: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in table.columns]


def empty_cells(table: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """(key, column) of wanted cells that are empty."""
    blank = F.array_compact(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in wanted]))
    return table.select(F.col(key), F.explode(blank).alias("column"))


def repeated_keys(table: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key an earlier row has; ``order`` is unique.  A key's rows are never gathered."""
    first = table.groupBy(key).agg(F.min(order).alias("_first"))
    return table.join(first, key).filter(F.col(order) > F.col("_first")).drop("_first")


def outside(table: DataFrame, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """(key, column, value) of cells with a value that their column doesn't allow."""
    odd = F.array_compact(F.array(*[F.when(~F.col(c).isin(values), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, values in domains.items()]))
    return table.select(F.col(key), F.explode(odd).alias("x")).select(key, "x.column", "x.value")


def not_typed(table: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """(key, column, value) of cells that are no true or false (boolean) or no whole number from 0 on (unsigned)."""

    def bad(c: str, kind: str) -> Column:
        text = F.col(c).cast("string")
        return ~text.isin("true", "false") if kind == "boolean" else ~text.rlike("^[0-9]+$") | text.try_cast("bigint").isNull()

    odd = F.array_compact(F.array(*[F.when(F.coalesce(bad(c, k), F.lit(True)), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c, k in kinds.items()]))
    return table.select(F.col(key), F.explode(odd).alias("x")).select(key, "x.column", "x.value")


def unresolved(table: DataFrame, key: str, reference: str, known: DataFrame, name: str) -> DataFrame:
    """(key, reference) of filled references that ``known`` doesn't have."""
    own = table.filter(F.coalesce(F.col(reference).cast("string"), F.lit("")) != "").select(key, F.col(reference).alias("reference"))
    return own.join(known.select(F.col(name).alias("reference")).distinct(), "reference", "left_anti").select(key, "reference")


def required_if(table: DataFrame, key: str, condition: Column, wanted: Column) -> DataFrame:
    """Keys of rows that meet the condition and not what it asks for."""
    return table.filter(condition & ~F.coalesce(wanted, F.lit(False))).select(key)


def absent_names(table: DataFrame, key: str, prefix: str, names: DataFrame, name: str) -> DataFrame:
    """Rows whose prefix begins none of the names.

    Names are cut at each length that a prefix has, so it is an equality join.
    """
    lengths = [r[0] for r in table.select(F.length(prefix)).distinct().collect() if r[0]]
    if not lengths:
        return table.select(key, prefix)
    cut = names.select(F.explode(F.array(*[F.when(F.length(name) >= n, F.left(F.col(name), F.lit(n))) for n in lengths])).alias(prefix)).distinct()
    return table.join(cut, prefix, "left_anti").select(key, prefix)


def orphans(files: DataFrame, name: str, table: DataFrame, reference: str) -> DataFrame:
    """Files that no row refers to."""
    return files.join(table.select(F.col(reference).alias(name)).distinct(), name, "left_anti").select(name)


def coverage(table: DataFrame, pending: Column, audited: Column, usable: Column, kind: str, media: Column) -> DataFrame:
    """One row: counts against the least that a finished registry needs, and whether they are met.

    Nothing is asked while a row is pending; few media are a warning.
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    kinds = F.count_distinct(F.when(usable, F.col(kind)))
    row = table.agg(n(pending).alias("pending"), n(audited).alias("audited"), n(usable).alias("usable"), kinds.alias("kinds"), n(media).alias("media"))
    met = (F.col("audited") >= 20) & (F.col("usable") >= 10) & (F.col("kinds") >= 2)
    return row.withColumns({"ok": (F.col("pending") > 0) | met, "warning": (F.col("pending") == 0) & (F.col("media") < 3)})


def states_root(text: str | None, root: str) -> bool:
    """Whether a stored schema is there and names its root type."""
    return bool(text and text.strip() and root in text)
