"""Distance matrices, ordination files, metadata and run logs: readers with validation, and writers.

A distance table is ``distances(sample_i, sample_j, distance)``, one row for each unordered pair, in sample order.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.session import materialise
from cladeframe.sources import onefile


#: Rows and columns of a tile of a matrix that is read.
TILE = 512


def read_matrix(spark: SparkSession, path: str, strict: bool = True, tolerance: float = 1e-8, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """A square tab-separated matrix: distances (pairs i < j) and sample order.

    Row and column ids are matched by name, rows in any order; ids on one side only or twice, rows of another width, and
    cells that are no numbers, are errors. ``strict`` also asks for symmetry and a zero diagonal; otherwise both halves are
    averaged. Blank lines do not count; a file without lines is an error, a header without samples an empty table.

    Lines are cut into strips of ``tile`` columns where they are read, and a tile meets its transpose in one group, so that
    no task holds more than two tiles and no cell becomes a row before it is a pair. The driver sees the header alone.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"),
    ).filter(F.trim(F.regexp_replace("line", "\t", " ")) != "")
    head = raw.orderBy("file", "block", "at").first()
    if head is None:
        raise ValueError("the matrix is empty")
    names = head["line"].split("\t")[1:]
    if len(set(names)) != len(names):
        raise ValueError("row and column ids differ")
    samples = spark.createDataFrame(list(enumerate(names)), "sample_ordinal int, sample_id string").select("sample_id", "sample_ordinal")
    rows = raw.filter((F.col("file") != head["file"]) | (F.col("block") != head["block"]) | (F.col("at") != head["at"]))
    rows = rows.select(F.split("line", "\t", -1).alias("c")).select(F.col("c")[0].alias("sample_id"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("c"))
    told = rows.join(samples.withColumn("known", F.lit(True)), "sample_id", "left")
    seen = told.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("sample_id").alias("ids"),
        F.count_if(F.col("known").isNull() | (F.size("c") != len(names))).alias("strange"),
    ).first()
    if seen["strange"] or seen["rows"] != len(names) or seen["ids"] != len(names):
        raise ValueError("row and column ids differ")
    starts = F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0)), F.lit(tile))
    strips = told.select(
        F.col("sample_ordinal").alias("i"), F.floor(F.col("sample_ordinal") / tile).cast("int").alias("a"),
        F.explode(F.transform(starts, lambda s: F.struct((s / tile).cast("int").alias("b"), F.slice("c", s + 1, F.lit(tile)).alias("v")))).alias("s"),
    ).select(
        F.least("a", "s.b").alias("low"), F.greatest("a", "s.b").alias("high"), "i", F.col("s.b").alias("b"),
        F.transform("s.v", lambda v: v.try_cast("double")).alias("v"),
    )
    pairs = materialise(strips.groupBy("low", "high").applyInPandas(_tile_kernel(tile, tolerance), _TILE_SCHEMA), "matrix")
    bad = pairs.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("no_number", "asymmetric", "diagonal"))).first()
    if bad["no_number"]:
        raise ValueError(f"{bad['no_number']} cells are no numbers")
    if strict and (bad["asymmetric"] or bad["diagonal"]):
        raise ValueError(f"the matrix is not a distance matrix: {bad['asymmetric']} asymmetric cells, {bad['diagonal']} on the diagonal")
    i = samples.select(F.col("sample_id").alias("sample_i"), F.col("sample_ordinal").alias("i"))
    j = samples.select(F.col("sample_id").alias("sample_j"), F.col("sample_ordinal").alias("j"))
    long = pairs.select("i", "first_j", F.posexplode("d").alias("k", "distance")).withColumn("j", F.col("first_j") + F.col("k"))
    return long.join(i, "i").join(j, "j").select("sample_i", "sample_j", "distance"), samples


_TILE_SCHEMA = "i int, first_j int, d array<double>, no_number long, asymmetric long, diagonal long"


def _tile_kernel(tile: int, tolerance: float):
    def meet(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        """A tile above the diagonal and its transpose (or a tile on it): rows of pairs i < j and what is wrong."""
        low, high = (int(k) for k in key)
        of = part["i"] // tile
        above, below = (part[(of == r) & (part["b"] == c)].sort_values("i") for r, c in ((low, high), (high, low)))
        x = np.stack([np.asarray(v, float) for v in above["v"]])
        y = np.stack([np.asarray(v, float) for v in below["v"]]).T
        apart = low != high  # a tile on the diagonal is its own transpose
        none = np.isnan(x).sum(1) + np.isnan(y).sum(1) * apart
        uneven = (np.abs(x - y) > tolerance).sum(1) * (1 + apart)
        own = (np.abs(np.diagonal(x)) > tolerance).astype(int) if not apart else np.zeros(len(x), int)
        mean, first = (x + y) / 2, high * tile
        rows = above["i"].to_numpy()
        cut = np.maximum(rows + 1 - first, 0)
        return pd.DataFrame({
            "i": rows, "first_j": first + cut, "d": [m[c:] for m, c in zip(mean, cut, strict=True)],
            "no_number": none, "asymmetric": uneven, "diagonal": own,
        })

    return meet


def from_cells(cells: DataFrame, samples: DataFrame, strict: bool = True, tolerance: float = 1e-8) -> DataFrame:
    """``row_id, column_id, value`` of a square matrix as pairs, validated in one aggregate."""
    other = cells.select(F.col("row_id").alias("column_id"), F.col("column_id").alias("row_id"), F.col("value").alias("mirror"))
    both = cells.join(other, ["row_id", "column_id"], "left")
    bad = both.agg(
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("no_number"),
        F.count_if(F.col("mirror").isNull() & F.col("value").isNotNull()).alias("one_sided"),
        F.count_if(F.abs(F.col("value") - F.col("mirror")) > tolerance).alias("asymmetric"),
        F.count_if((F.col("row_id") == F.col("column_id")) & (F.abs("value") > tolerance)).alias("diagonal"),
        F.count(F.lit(1)).alias("cells"),
    ).first()
    n = samples.count()
    if bad["no_number"]:
        raise ValueError(f"{bad['no_number']} cells are no numbers")
    if bad["one_sided"] or bad["cells"] != n * n:
        raise ValueError("row and column ids differ")
    if strict and (bad["asymmetric"] or bad["diagonal"]):
        raise ValueError(f"the matrix is not a distance matrix: {bad['asymmetric']} asymmetric cells, {bad['diagonal']} on the diagonal")
    i = samples.select(F.col("sample_id").alias("row_id"), F.col("sample_ordinal").alias("i"))
    j = samples.select(F.col("sample_id").alias("column_id"), F.col("sample_ordinal").alias("j"))
    return both.join(i, "row_id").join(j, "column_id").filter("i < j").select(
        F.col("row_id").alias("sample_i"), F.col("column_id").alias("sample_j"), ((F.col("value") + F.col("mirror")) / 2).alias("distance")
    )


def square(distances: DataFrame, samples: DataFrame) -> DataFrame:
    """Both halves and the diagonal: ``i, j, sample_i, sample_j, distance``."""
    i = samples.select(F.col("sample_id").alias("sample_i"), F.col("sample_ordinal").alias("i"))
    j = samples.select(F.col("sample_id").alias("sample_j"), F.col("sample_ordinal").alias("j"))
    upper = distances.select("sample_i", "sample_j", F.col("distance").cast("double").alias("distance"))
    lower = upper.select(F.col("sample_j").alias("sample_i"), F.col("sample_i").alias("sample_j"), "distance")
    zero = samples.select(F.col("sample_id").alias("sample_i"), F.col("sample_id").alias("sample_j"), F.lit(0.0).alias("distance"))
    return upper.unionByName(lower).unionByName(zero).join(i, "sample_i").join(j, "sample_j")


def matrix_lines(distances: DataFrame, samples: DataFrame, digits: int | None = None, single: bool = False, label: str = "") -> DataFrame:
    """``i, line``: the matrix's text, one row of it a row; -1 is the header.

    ``digits`` fixes the decimals; otherwise numbers are as short as they can be (of single precision if ``single``).
    """
    cell = F.col("distance").cast("float") if single else F.col("distance")
    text = F.format_string(f"%.{digits}f", cell) if digits is not None else cell.cast("string")
    body = (
        square(distances, samples).groupBy("i", "sample_i")
        .agg(F.sort_array(F.collect_list(F.struct("j", text.alias("t")))).alias("c"))
        .select("i", F.concat_ws("\t", "sample_i", F.col("c.t")).alias("line"))
    )
    head = samples.agg(F.sort_array(F.collect_list(F.struct("sample_ordinal", "sample_id"))).alias("c")).select(
        F.lit(-1).alias("i"), F.concat(F.lit(label), F.lit("\t"), F.array_join("c.sample_id", "\t")).alias("line")
    )
    return head.unionByName(body)


def write_matrix(distances: DataFrame, samples: DataFrame, path: str, **how) -> None:
    """The matrix in one text file under ``path``, in sample order (``how`` as for :func:`matrix_lines`)."""
    matrix_lines(distances, samples, **how).repartition(1).sortWithinPartitions("i").select("line").write.text(path)


def write_matrix_blocks(distances: DataFrame, samples: DataFrame, path: str, block: int, compression: str = "gzip", **how) -> None:
    """The matrix in blocks of rows, each written on its own, so that no task ever holds more than a block."""
    if block < 1:
        raise ValueError("a block has at least one row")
    lines = matrix_lines(distances, samples, **how).withColumn("block", F.floor(F.greatest("i", F.lit(0)) / block).cast("int"))
    lines.repartitionByRange("i").sortWithinPartitions("i").select("block", "line").write.partitionBy("block").option("compression", compression).text(path)


def compressed_matrix(distances: DataFrame, samples: DataFrame, target: str, level: int = 3, **how) -> str:
    """The matrix in one zstd file, its rows compressed where they are made; ``.zst`` is added to its name unless it is there."""
    target = target if target.endswith(".zst") else target + ".zst"
    return onefile.write_lines(matrix_lines(distances, samples, **how), target, "zstd", level)


def write_matrix_file(distances: DataFrame, samples: DataFrame, target: str, **how) -> str:
    """The matrix in one plain text file, written by many tasks."""
    return onefile.write_lines(matrix_lines(distances, samples, **how), target, "none")


def pcoa_text(ids: list[str], coordinates, proportion) -> str:
    """Coordinates, a blank line, and the row of explained proportions."""
    axes = len(proportion)
    lines = ["\t".join(["", *(f"PC{a + 1}" for a in range(axes))])]
    lines += ["\t".join([i, *(repr(float(v)) for v in row)]) for i, row in zip(ids, coordinates, strict=True)]
    lines += ["", "\t".join(["proportion_explained", *(repr(float(p)) for p in proportion)])]
    return "\n".join(lines) + "\n"


def parse_pcoa_text(text: str) -> tuple[list[str], list[list[float]], list[float]]:
    blocks = text.replace("\r\n", "\n").strip("\n").split("\n\n")
    if len(blocks) != 2:
        raise ValueError("a file of two blocks is expected")
    rows = [x.split("\t") for x in blocks[0].split("\n")[1:]]
    return [r[0] for r in rows], [[float(v) for v in r[1:]] for r in rows], [float(v) for v in blocks[1].split("\n")[-1].split("\t")[1:]]


def ordination_text(ids: list[str], coordinates, eigenvalues, proportion) -> str:
    """The ordination format with sections for eigenvalues, proportions, species, sites, biplot and constraints."""
    tab = lambda values: "\t".join(repr(float(v)) for v in values)
    n, k = len(ids), len(eigenvalues)
    lines = [f"Eigvals\t{k}", tab(eigenvalues), "", f"Proportion explained\t{k}", tab(proportion), "", "Species\t0\t0", "", f"Site\t{n}\t{k}"]
    lines += [f"{i}\t{tab(row)}" for i, row in zip(ids, coordinates, strict=True)]
    return "\n".join([*lines, "", "Biplot\t0\t0", "", "Site constraints\t0\t0", ""])


def write_contributions(contributions: DataFrame, path: str) -> None:
    """Per pair and taxon, with twelve decimals."""
    twelve = lambda c: F.format_string("%.12f", F.col(c)).alias(c)
    contributions.select("sample_i", "sample_j", "taxon", *map(twelve, ("edge_length", "signed_mass_difference", "contribution"))).write.option("sep", "\t").option("header", True).csv(path)


def write_factors(factors: DataFrame, path: str) -> None:
    factors.select(F.col("sample_id").alias("sample"), F.format_string("%.12f", "normalization_factor").alias("normalization_factor")).write.option("sep", "\t").option("header", True).csv(path)


def require_columns(frame: DataFrame, names: Iterable[str]) -> DataFrame:
    if missing := [n for n in names if n not in frame.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return frame


def read_metadata(spark: SparkSession, path: str, group: str, sample: str = "SampleID") -> DataFrame:
    frame = spark.read.option("sep", "\t").option("header", True).csv(path)
    return require_columns(frame, [sample, group]).select(F.col(sample).alias("sample_id"), F.col(group).alias("group"))


def read_bench(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """A table with a header, separated by whichever of tab, semicolon and comma its header holds most."""
    head = spark.read.text(path).first()
    if head is None:
        raise ValueError("the table is empty")
    sep = max("\t;,", key=head[0].count)
    return require_columns(spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(path), columns)


STAMP = r"^\[?(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?)"


def log_seconds(lines: DataFrame, begin: str = "nodes =", end: str = "pairwise distances", by: str | None = None) -> DataFrame:
    """Seconds from the first line that holds ``begin`` to the last that holds ``end``; ``lines`` has a column ``value``.

    A log in which either line, or its time stamp, is missing gives null.
    """
    stamp = F.try_to_timestamp(F.regexp_extract("value", STAMP, 1))
    told = lines.withColumn("t", stamp)
    first = F.min(F.when(F.col("value").contains(begin), F.col("t")))
    last = F.max(F.when(F.col("value").contains(end), F.col("t")))
    grouped = told.groupBy(by) if by else told.groupBy()
    return grouped.agg((F.unix_micros(last) - F.unix_micros(first)).cast("double").alias("us")).select(*([by] if by else []), (F.col("us") / 1e6).alias("seconds"))


def ordinals(samples: DataFrame, by: str = "sample_id") -> DataFrame:
    """``sample_id, sample_ordinal`` for a table of distinct samples that has no order of its own.

    Numbers follow a range sort: each partition counts its rows and adds those of the partitions before it.
    """
    spread = samples.select("sample_id").repartitionByRange(by).sortWithinPartitions(by)
    spread = spread.select("sample_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("m"))
    own = spread.withColumn("k", F.row_number().over(Window.partitionBy("p").orderBy("m")))
    own = materialise(own, "ordinals")
    before = own.groupBy("p").agg(F.count(F.lit(1)).alias("n")).select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return own.join(before, "p").select("sample_id", (F.col("before") + F.col("k") - 1).cast("int").alias("sample_ordinal"))
