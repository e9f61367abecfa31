"""File readers and writers. Wide matrices become long rows; features are never Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortia.operators.joins import pivot_wide_values


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None, sep: str = ",") -> DataFrame:
    """A delimited file with a header. Without a schema every column is read as text."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", "")
    return reader.schema(schema).csv(path) if schema is not None else reader.csv(path)


def _cells(line: str, sep: str):
    return F.transform(F.split(line, sep if sep != "|" else r"\|", -1), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The first line of the (first) file; its length is one row of the matrix."""
    line = spark.read.text(path).limit(1).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return [c.strip().strip('"') for c in line[0].split(sep)]


def read_matrix_long(spark: SparkSession, path: str, sep: str = ",", orient: str = "features_x_samples") -> DataFrame:
    """A wide numeric matrix (id column + one column per sample or feature) as (sample_id, feature_id, value).

    Lines are split and exploded, so thousands of columns never form a schema. The header row
    travels as one array literal. ``NA`` and empty cells become null.
    """
    names = _header(spark, path, sep)
    cells = spark.read.text(path).select(_cells("value", sep).alias("c")).where(F.col("c") != F.array(*[F.lit(n) for n in names]))
    header = F.array(*[F.lit(n) for n in names[1:]])
    long = cells.select(F.col("c")[0].alias("row"), F.posexplode(F.slice("c", 2, len(names))).alias("i", "v"))
    long = long.select("row", F.element_at(header, F.col("i") + 1).alias("col"), F.when(~F.col("v").isin("", "NA"), F.col("v")).try_cast("double").alias("value"))
    if orient == "features_x_samples":
        return long.select(F.col("col").alias("sample_id"), F.col("row").alias("feature_id"), "value")
    if orient == "samples_x_features":
        return long.select(F.col("row").alias("sample_id"), F.col("col").alias("feature_id"), "value")
    raise ValueError(f"unknown orientation {orient}")


def read_distance_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A square matrix whose header holds the ids; row i belongs to the i-th id.

    Rows carry their position through the file offset order of a single-file read.
    """
    names = _header(spark, path, sep)
    cells = spark.read.text(path).select(_cells("value", sep).alias("c"), F.monotonically_increasing_id().alias("o"))
    body = cells.where(F.col("c") != F.array(*[F.lit(n) for n in names]))
    header = F.array(*[F.lit(n) for n in names])
    from pyspark.sql import Window

    # One row per id: the window orders ids, not cells.
    pos = body.select("o").withColumn("r", F.row_number().over(Window.orderBy("o")))
    rows = body.join(pos, "o").select("r", F.posexplode("c").alias("i", "v"))
    return rows.select(F.element_at(header, F.col("r")).alias("id_a"), F.element_at(header, F.col("i") + 1).alias("id_b"), F.col("v").cast("double").alias("d"))


def parse_gene_sets(lines: DataFrame, col: str = "value") -> DataFrame:
    """``pathway<TAB>g1,g2,...`` lines -> (pathway_id, feature_id)."""
    parts = F.split(col, "\t", 2)
    return lines.select(F.trim(parts[0]).alias("pathway_id"), F.explode(F.split(parts[1], ",")).alias("feature_id")).select(
        "pathway_id", F.trim("feature_id").alias("feature_id")).where("feature_id <> ''")


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    return parse_gene_sets(spark.read.text(path))


def parse_gtf_genes(lines: DataFrame, col: str = "value") -> DataFrame:
    """GTF lines -> gene_id, gene_name, gene_type of the ``gene`` rows; absent attributes are ''."""
    f = F.split(col, "\t")
    genes = lines.where(~F.col(col).startswith("#")).select(f.alias("f")).where((F.size("f") >= 9) & (F.col("f")[2] == "gene"))
    attr = lambda k: F.regexp_extract(F.col("f")[8], rf'(?:^|;)\s*{k} "([^"]*)"', 1).alias(k)
    return genes.select(attr("gene_id"), attr("gene_name"), attr("gene_type"))


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """Plain or gzip GTF."""
    return parse_gtf_genes(spark.read.text(path))


def discover_datasets(
    names: DataFrame, cancer: Sequence[str] | None = None, kinds: Sequence[str] | None = None,
    sources: Sequence[str] | None = None, col: str = "name",
) -> DataFrame:
    """Parse ``tcga_<cancer>_<analysis>_<target>_<source>_...`` file names and filter them."""
    base = F.regexp_extract(col, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    p = F.split(base, "_")
    part = lambda i: F.try_element_at(p, F.lit(i))
    out = names.where(F.size(p) >= 5).select(col, part(2).alias("cancer"), part(3).alias("analysis"), part(4).alias("target"), part(5).alias("source"))
    for c, allowed in (("cancer", cancer), ("analysis", kinds), ("source", sources)):
        if allowed:
            out = out.where(F.col(c).isin(list(allowed)))
    return out


def list_files(spark: SparkSession, glob: str) -> DataFrame:
    """Names and sizes of the files a glob matches, without reading their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*").load(glob).select(F.col("path").alias("name"), "length")


def write_results(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt in ("csv", "tsv"):
        df.write.mode(mode).option("header", True).option("sep", "\t" if fmt == "tsv" else ",").csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def feature_index(assay: DataFrame) -> DataFrame:
    """(feature_id, index): features numbered in name order; feature-sized."""
    from pyspark.sql import Window

    return assay.select("feature_id").distinct().withColumn("index", (F.row_number().over(Window.orderBy("feature_id")) - 1).cast("int"))


def matrix_to_vectors(assay: DataFrame, index: DataFrame, fill: float = 0.0) -> DataFrame:
    """One dense array per sample in feature-index order; absent cells take ``fill``.

    Linear in the features: a sample's cells, bounded by their number, are sorted once. A cell
    given twice fails the job.
    """
    n = index.agg(F.count(F.lit(1))).scalar().cast("int")
    cells = assay.join(index, "feature_id").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("c"))
    # One pass over the sorted cells: the gap before each cell, then the cell.
    before = "coalesce(get(c, i - 1).index, -1)"
    runs = F.expr(f"flatten(transform(c, (x, i) -> concat(array_repeat({float(fill)}D, x.index - {before} - 1), array(coalesce(cast(x.value as double), {float(fill)}D)))))")
    rest = F.expr(f"array_repeat({float(fill)}D, n - 1 - element_at(c, -1).index)")
    vec = F.concat(runs, rest)
    checked = F.when(F.size("vec") == F.col("n"), F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("a cell occurs twice in sample "), F.col("sample_id").cast("string"))).cast("array<double>"))
    return cells.withColumn("n", n).withColumn("vec", vec).select("sample_id", checked.alias("vec"))


def pivot_wide(assay: DataFrame, feature_ids: Sequence[str]) -> DataFrame:
    """One column per requested feature; for a handful of features only."""
    return pivot_wide_values(assay, feature_ids)
