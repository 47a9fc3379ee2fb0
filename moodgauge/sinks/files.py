"""Writers (rows B1-B7). Each is one Spark job; none loops over groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """B1: JSON-lines write that keeps null fields (the reference writes
    ``"key": null``); returns the number of rows written, counted by an
    ``Observation`` in the same pass."""
    obs = Observation("written")
    (df.observe(obs, F.count(F.lit(1)).alias("n"))
       .write.mode(mode).option("ignoreNullFields", False).json(path))
    return int(obs.get["n"])


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                mode: str = "overwrite", partition_by: list[str] | None = None,
                header: bool = True) -> None:
    """CSV (with header) or Parquet. ``mode='errorifexists'``
    is the ``overwrite: false`` guard."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B2: CSV with header that ``sources.read_csv`` gives back as it was:
    texts with separators, quotes and line ends are quoted, white space is
    kept, empty texts and nulls differ."""
    from ..sources.files import CSV_OPTIONS
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_report(report: DataFrame, path: str, group_col: str = "report_group",
                 fmt: str = "csv", mode: str = "overwrite", replace: str = "all") -> None:
    """One folder per group value plus the overall report, in one job.

    The overall rows (null group) land in ``{group_col}=__overall__``. With
    ``overwrite`` the target folder is replaced as a whole, or, with
    ``replace="groups"``, only the folders of the groups that ``report`` has
    (dynamic partition overwrite): a later run leaves the others alone.
    """
    out = report.withColumn(group_col, F.coalesce(F.col(group_col), F.lit("__overall__")))
    out = out.repartition(group_col).sortWithinPartitions(group_col, "day")
    w = out.write.mode(mode).partitionBy(group_col)
    if replace == "groups":
        w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


MAX_MAP_ENTITIES = 10_000


def write_entity_terms(terms: DataFrame, path: str, mode: str = "overwrite", max_entities: int = MAX_MAP_ENTITIES) -> None:
    """Long ``(entity, ord, term)`` table -> JSON maps ``{entity:
    [terms]}`` with term order fixed by ``ord``. Up to ``max_entities`` go
    into one file with one map; more are dealt by hash to as many maps as
    that takes, a folder each, so no row holds more than about that many."""
    per_entity = terms.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))),
                    lambda s: s["term"]).alias("terms"))
    value = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity", "terms"))))).alias("value")
    maps = -(-terms.select("entity").distinct().count() // max_entities)
    if maps <= 1:
        per_entity.agg(value).coalesce(1).write.mode(mode).text(path)
        return
    dealt = per_entity.groupBy(F.pmod(F.xxhash64("entity"), F.lit(maps)).alias("map")).agg(value)
    dealt.write.mode(mode).partitionBy("map").text(path)


def strip_zone(df: DataFrame, cols: list[str], zone: str = "UTC") -> DataFrame:
    """Zone-aware instants -> wall-clock ``timestamp_ntz`` in ``zone``."""
    for c in cols:
        df = df.withColumn(c, F.convert_timezone(F.lit("UTC"), F.lit(zone),
                                                 F.col(c).cast("timestamp_ntz")))
    return df
