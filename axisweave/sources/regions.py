"""Region files: BED (6 and 12 columns), GTF, tables and configurations. Coordinates are 1-based and closed once read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("value <> '' and not value like '#%' and not value like 'track%'").select(F.split("value", "\t", -1).alias("f"))


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """chr, start, stop, name, score, strand; missing columns are null, a missing strand is '.'."""
    return _split_lines(spark, path).select(
        _field(0).alias("chr"), (_field(1).cast("int") + 1).alias("start"), _field(2).cast("int").alias("stop"), _field(3).alias("name"), _field(4).try_cast("double").alias("score"), F.coalesce(F.nullif(_field(5), F.lit("")), F.lit(".")).alias("strand")
    )


def read_bed12_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each block: chr, strand, name, block (from 0), start, stop."""
    numbers = lambda i: F.transform(F.filter(F.split(_field(i), ","), lambda x: x != ""), lambda x: x.cast("int"))
    rows = _split_lines(spark, path).select(_field(0).alias("chr"), _field(5).alias("strand"), _field(3).alias("name"), _field(1).cast("int").alias("s"), F.posexplode(F.arrays_zip(numbers(10).alias("n"), numbers(11).alias("o"))).alias("block", "x"))
    return rows.select("chr", "strand", "name", "block", (F.col("s") + F.col("x.o") + 1).alias("start"), (F.col("s") + F.col("x.o") + F.col("x.n")).alias("stop"))


def write_bed(rows: DataFrame, path: str) -> None:
    """BED6; missing name and score are '' and 0."""
    name = F.coalesce(F.col("name"), F.lit("")) if "name" in rows.columns else F.lit("")
    score = F.coalesce(F.col("score").cast("string"), F.lit("0")) if "score" in rows.columns else F.lit("0")
    rows.select(F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), F.col("stop").cast("string"), name, score, "strand")).write.text(path)


def write_bed12(blocks: DataFrame, path: str) -> None:
    """BED12 from block rows (chr, strand, name, start, stop), in order of start."""
    one = blocks.groupBy("chr", "strand", "name").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("b"))
    first, last = F.col("b")[0]["start"] - 1, F.element_at("b", -1)["stop"]
    sizes = F.array_join(F.transform("b", lambda x: x["stop"] - x["start"] + 1), ",")
    offsets = F.array_join(F.transform("b", lambda x: x["start"] - F.col("b")[0]["start"]), ",")
    one.select(F.concat_ws("\t", "chr", first.cast("string"), last.cast("string"), "name", F.lit("0"), "strand", first.cast("string"), last.cast("string"), F.lit("0"), F.size("b").cast("string"), sizes, offsets)).write.text(path)


def attribute_map(text: str | Column) -> Column:
    """key "value" or key=value pairs, parted by semicolons; of a repeated key the last counts."""
    pattern = r"\s*([^\s=;]+)(?:\s+\"([^\"]*)\"|=([^;]*))\s*;?"
    t = F.col(text) if isinstance(text, str) else text
    keys, quoted, plain = (F.regexp_extract_all(t, F.lit(pattern), F.lit(i)) for i in (1, 2, 3))
    values = F.zip_with(quoted, plain, lambda q, p: F.when(q != "", q).otherwise(F.coalesce(p, F.lit(""))))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda x: x["k"].isNotNull() & ~F.exists(F.slice(keys, x["i"] + 1, F.greatest(F.size(keys) - x["i"], F.lit(0))), lambda k: k == x["k"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"])))


def attribute_text(attributes: str) -> Column:
    """A map as ``key "value"`` pairs, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(attributes)), lambda x: F.concat(x["key"], F.lit(' "'), x["value"], F.lit('"'))), ";")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return _split_lines(spark, path).select(
        _field(0).alias("chr"), _field(1).alias("source"), _field(2).alias("type"), _field(3).cast("int").alias("start"), _field(4).cast("int").alias("stop"), _field(5).try_cast("double").alias("score"), _field(6).alias("strand"), _field(7).alias("frame"),
        F.when(F.coalesce(_field(8), F.lit("")) == "", F.create_map().cast("map<string,string>")).otherwise(attribute_map(_field(8))).alias("attributes"),
    )


def write_gtf(rows: DataFrame, path: str, source: str = "axisweave") -> None:
    """GTF from chr, type, start, stop, strand and a map of attributes."""
    rows.select(F.concat_ws("\t", "chr", F.lit(source), "type", F.col("start").cast("string"), F.col("stop").cast("string"), F.lit("0.0"), "strand", F.lit("."), attribute_text("attributes"))).write.text(path)


def transcripts(gtf: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """Spans of transcripts with their exon counts, of some genes or all."""
    a = gtf.where(F.col("type") == "exon").withColumn("gene_id", F.col("attributes")["gene_id"]).withColumn("transcript_id", F.col("attributes")["transcript_id"])
    if genes is not None:
        a = a.where(F.col("gene_id").isin(genes))
    return a.groupBy("gene_id", "transcript_id").agg(F.min("chr").alias("chr"), F.min("strand").alias("strand"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.lit(1)).alias("exons"))


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


@dataclass(frozen=True)
class Config:
    """Parameters of an assembly; values out of range raise ValueError."""

    threshold: int = 1
    merge_radius: int = 100
    bin_width: int = 20
    alpha: float = 0.05
    min_fold: float = 0.5
    min_terminal: int = 300
    max_bins: int = 20_000
    max_isoforms: int = 20
    internal: bool = False

    def __post_init__(self) -> None:
        for name in ("threshold", "merge_radius", "min_terminal"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("bin_width", "max_bins", "max_isoforms"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        for name in ("alpha", "min_fold"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must be from 0 to 1")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text).items() if k in known})
