"""Readers and writers: FASTA, FASTQ, delimited tables with a BOM or repeated headers, depth and exon tables, reports, trees."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord (place of the record in its file), id (first token), description (the rest), seq (lines joined). A record begins at a ``>`` that opens a line; a header may hold others."""
    lines = spark.read.text(path, lineSep="\n>").select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"^(?:\s*\n)?>", "").alias("value")).where(F.trim("value") != "")
    head = F.regexp_replace(F.split("value", "\n", 2)[0], "\r", "")
    seq = F.regexp_replace(F.coalesce(F.get(F.split("value", "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    order = F.row_number().over(Window.partitionBy("file").orderBy("n")).cast("long")
    return (
        lines.withColumn("n", F.monotonically_increasing_id())
        .withColumn("ord", order)
        .select("file", "ord", F.regexp_extract(head, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(head, r"^\S*", "")).alias("description"), seq.alias("seq"))
    )


def write_fasta(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record for each row of id, seq and, where present, description."""
    head = F.concat(F.lit(">"), F.col("id"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise("")) if "description" in df.columns else F.concat(F.lit(">"), F.col("id"))
    df.select(F.concat(head, F.lit("\n"), F.col("seq")).alias("value")).write.mode(mode).text(path)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; found {', '.join(df.columns)}")
    return df


def header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names: without a BOM, a repeated one with its number."""
    line = spark.read.text(path).first()[0].lstrip("﻿")
    out: list[str] = []
    for name in next(csv.reader([line], delimiter=sep)):
        name = name.strip()
        out.append(name if name not in out else f"{name}_{out.count(name) + sum(x.startswith(name + '_') for x in out) + 1}")
    return out


def read_table(spark: SparkSession, path: str, sep: str = "\t", types: dict[str, str] | None = None, null: str | None = None) -> DataFrame:
    """A delimited table with a header; strings unless ``types`` names a column. Nothing is inferred."""
    names = header(spark, path, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.csv(path, sep=sep, header=True, schema=schema, enforceSchema=True, nullValue=null or "")
    return df.select(*[F.col(f"`{n}`").cast((types or {}).get(n, "string")).alias(n) for n in names])


def write_table(df: DataFrame, path: str, order: list[str], digits: dict[str, int] | None = None, sep: str = "\t", missing: str = "", overwrite: bool = False) -> None:
    """Sorted and rounded, with a header; refuses to replace unless told."""
    for c, n in (digits or {}).items():
        df = df.withColumn(c, F.round(c, n))
    df.orderBy(*order).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").csv(path, sep=sep, header=True, nullValue=missing)


def shadowed(paths: list[str], marker: str = "_Nfilt") -> list[str]:
    """Paths without those that have a twin with ``marker`` before the ending."""
    strip = lambda p: re.sub(re.escape(marker) + r"(?=\.[^./]*$|$)", "", p)
    better = {strip(p) for p in paths if strip(p) != p}
    return sorted(p for p in paths if strip(p) != p or p not in better)


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, ord, seq, quality of every read. A file cut short (a broken gzip too) gives what can be read of it; the quality of its last read may be missing."""
    lines = spark.read.option("ignoreCorruptFiles", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("n", F.monotonically_increasing_id())
    lines = lines.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1)
    rows = lines.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(
        F.max(F.when(F.col("line") % 4 == 1, F.col("value"))).alias("seq"), F.max(F.when(F.col("line") % 4 == 3, F.col("value"))).alias("quality")
    )
    return rows.where("seq is not null")


def read_stats(reads: DataFrame, long: int = 3000) -> DataFrame:
    """For each file: reads, bases, median and tenth parts of length (whole numbers), N50, reads of ``long`` bases and their percentage, mean quality by base and by read (of the reads that have one)."""
    quality = F.when(F.col("quality") != "", F.col("quality"))
    score = F.aggregate(F.transform(F.split(quality, ""), lambda c: F.ascii(c) - 33), F.lit(0).cast("long"), lambda a, x: a + x)
    r = reads.select("file", F.length("seq").alias("length"), score.alias("total"), F.length(quality).alias("scored"))
    stats = r.groupBy("file").agg(
        F.count("*").alias("reads"),
        F.sum("length").alias("bases"),
        *[F.floor(F.percentile("length", q)).alias(n) for q, n in ((0.5, "median"), (0.1, "p10"), (0.9, "p90"))],
        F.count_if(F.col("length") >= long).alias("long_reads"),
        (100 * F.avg((F.col("length") >= long).cast("double"))).alias("percent_long"),
        F.round(F.sum("total") / F.sum("scored"), 2).alias("quality_by_base"),
        F.round(F.avg(F.col("total") / F.col("scored")), 2).alias("quality_by_read"),
    )
    return stats.join(n50(r, "file", "length"), "file", "left")


def n50(df: DataFrame, group: str, length: str) -> DataFrame:
    """The length at which the running sum, longest first, reaches half of the group's total."""
    w = Window.partitionBy(group).orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(length).over(Window.partitionBy(group))
    return df.withColumn("run_", F.sum(length).over(w)).withColumn("all_", total).where("run_ * 2 >= all_").groupBy(group).agg(F.max(length).alias("n50"))


def report_count(spark: SparkSession, path: str, pattern: str = r"Found ([\d,]+) reads") -> DataFrame:
    """For each report the first number that the pattern finds."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").withColumn("n", F.monotonically_increasing_id())
    hit = F.regexp_replace(F.regexp_extract("value", pattern, 1), ",", "")
    return lines.withColumn("hit", hit).where("hit <> ''").groupBy("file").agg(F.min_by("hit", "n").cast("long").alias("reads"))


def exons(table: DataFrame, least: int = 1) -> DataFrame:
    """Exon rows of an annotation table (V3 feature, V4 start, V5 end) by start."""
    return table.where((F.col("V3") == "exon") & (F.col("V5").cast("int") - F.col("V4").cast("int") + 1 >= least)).orderBy(F.col("V4").cast("int"))


def dense_depth(depth: DataFrame) -> DataFrame:
    """contig, pos, depth with every place from 1 to the contig's last; 0 where there was none."""
    places = depth.groupBy("contig").agg(F.max("pos").alias("n")).select("contig", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("pos"))
    return places.join(depth.groupBy("contig", F.col("pos").cast("int").alias("pos")).agg(F.max("depth").alias("depth")), ["contig", "pos"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def parse_newick(text: str) -> list[tuple[int, int | None, str, float, float | None]]:
    """Nodes of a tree: id, parent, name (of leaves), branch length, support (of inner nodes). Small; on the driver."""
    nodes: list[list] = []
    stack: list[int] = []
    token = re.compile(r"\s*([(),;])|\s*([^(),;:]*)(?::([-+0-9.eE]+))?")
    at, last = 0, None
    open_: list[int] = []
    while at < len(text):
        m = token.match(text, at)
        at = m.end() if m.end() > at else at + 1
        if m[1] == "(":
            nodes.append([len(nodes), stack[-1] if stack else None, "", 0.0, None])
            stack.append(len(nodes) - 1)
            last = None
        elif m[1] == ",":
            last = None
        elif m[1] == ")":
            last = stack.pop()
            open_.append(last)
        elif m[1] == ";":
            break
        elif m[2] or m[3]:
            if last is None:
                nodes.append([len(nodes), stack[-1] if stack else None, m[2].strip("'\""), float(m[3] or 0), None])
                last = len(nodes) - 1
            else:
                nodes[last][3] = float(m[3] or 0)
                nodes[last][4] = float(m[2].split("/")[-1]) if m[2] else None
    return [tuple(n) for n in nodes]
