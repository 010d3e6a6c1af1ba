"""Writers: record logs, label exports with a manifest, reports. Feature shards are in ``phonoframe.sources.shards``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoframe import schemas


def append_records(df: DataFrame, path: str) -> None:
    """Append token records as JSON lines, compressed: names and values repeat in every line."""
    df.write.mode("append").option("compression", "gzip").json(path)


def write_labels(df: DataFrame, manifest: dict[str, Column | str | int | float], path: str) -> None:
    """Labels ordered by (split, filename) and a one-row provenance manifest.

    The order is global over the part files: a range shuffle, not one task.
    """
    columns = [c for c in schemas.LABEL_COLUMNS if c in df.columns]
    df.select(*columns).orderBy("split", "filename").write.mode("overwrite").csv(
        f"{path}/labels", header=True)
    classes = df.groupBy("label").agg(F.count("*").alias("n"))
    splits = df.groupBy("split").agg(F.count("*").alias("n"))
    as_map = lambda d, k: d.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(k, "n")))).alias("m"))
    facts = [v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in manifest.items()]
    row = as_map(classes, "label").withColumnRenamed("m", "class_counts").crossJoin(
        as_map(splits, "split").withColumnRenamed("m", "split_counts"))
    row.select(F.to_json(F.struct(*facts, "class_counts", "split_counts")).alias("value")).coalesce(
        1).write.mode("overwrite").text(f"{path}/manifest")


# -- reports ---------------------------------------------------------------------------


def markdown_rows(df: DataFrame, columns: list[str], section: str, order: int, rank: Column) -> DataFrame:
    """Report lines of one table: (section, order, rank, line)."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    body = df.select(
        F.lit(section).alias("section"), F.lit(order).alias("order"),
        rank.cast("string").alias("rank"),
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = "| " + " | ".join(columns) + " |"
    rule = "|" + "---|" * len(columns)
    spark = df.sparkSession
    top = spark.range(1).select(
        F.lit(section).alias("section"), F.lit(order).alias("order"),
        F.explode(F.array(
            F.struct(F.lit("").alias("rank"), F.lit(f"## {section}").alias("line")),
            F.struct(F.lit(" ").alias("rank"), F.lit(head).alias("line")),
            F.struct(F.lit("  ").alias("rank"), F.lit(rule).alias("line")))).alias("h"),
    ).select("section", "order", "h.rank", "h.line")
    return top.unionByName(body)


def _listed(df: DataFrame, section: str, line: Column, rank: Column) -> DataFrame:
    title = df.sparkSession.range(1).select(
        F.lit(section).alias("section"), F.lit(0).alias("order"), F.lit("").alias("rank"), F.lit(f"## {section}").alias("line"))
    return title.unionByName(df.select(
        F.lit(section).alias("section"), F.lit(0).alias("order"), rank.cast("string").alias("rank"), line.alias("line")))


def fact_rows(df: DataFrame, section: str, facts: list[tuple[str, Column]]) -> DataFrame:
    """Report lines of a one-row frame: a title and a named value on each line."""
    shown = F.array(*[
        F.struct(F.lit(f"{k:03d}").alias("rank"), F.concat(F.lit(f"- {name}: "), F.coalesce(v.cast("string"), F.lit("-"))).alias("line"))
        for k, (name, v) in enumerate(facts)])
    lines = df.select(F.explode(shown).alias("f")).select("f.*")
    return _listed(lines, section, F.col("line"), F.col("rank"))


def item_rows(df: DataFrame, section: str, marks: list[Column], text: Column) -> DataFrame:
    """Report lines of a short list: a title, then marked items in the order of mark and text."""
    mark = F.concat_ws(" ", *marks)
    return _listed(df, section, F.concat(F.lit("- ["), mark, F.lit("] "), text), F.concat(mark, text))


def write_report(summary: DataFrame, lines: DataFrame, path: str) -> None:
    """Nested summary as JSON and the report tables as markdown text."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    lines.orderBy("order", "rank").select(F.col("line").alias("value")).coalesce(1).write.mode(
        "overwrite").text(f"{path}/report")
