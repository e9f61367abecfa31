"""Facts about single rows of a scan, kept where the rows are read again.

A segment is a run of SEGMENT_ROWS rows of one input file. What a job finds out about rows is
written to the shared folder by segment, and a later scan looks up the segments it reads, so wide
columns need not be shuffled to meet narrow facts about them. Segments share folders: a folder
holds about SEGMENTS_PER_FOLDER of them, sorted, in small row groups that a reader skips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, filesystem

SEGMENT_ROWS = 8192
SEGMENTS_PER_FOLDER = 4
ROW_GROUP_BYTES = 1 << 20


def segmented(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of ``docs`` with ``__seg``, a number per run of rows of one file, and ``__at``, the place in it.

    Writes the columns first if ``docs`` is no file scan.
    """

    def name(df: DataFrame) -> DataFrame:
        row = F.col("_metadata.row_index")
        run = F.floor(row / SEGMENT_ROWS)
        return df.select("*", F.xxhash64(F.col("_metadata.file_path"), run).alias("__seg"), (row % SEGMENT_ROWS).cast("int").alias("__at"))

    given = docs.select(*columns)
    try:
        return name(given)
    except AnalysisException:
        return name(cut(given))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of the batches that belong to one segment."""
    for batch in batches:
        seg = batch.column("__seg").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(seg)) + 1), len(seg)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(seg[a]), batch.slice(a, b - a)


def folders(rows: int) -> int:
    """How many folders facts about ``rows`` rows are spread over."""
    return 1 + rows // (SEGMENT_ROWS * SEGMENTS_PER_FOLDER)


def keep_facts(facts: DataFrame, directory: str, count: int) -> None:
    """Write ``facts``, which have a long ``seg``, to ``count`` folders of ``directory``."""
    dealt = facts.withColumn("folder", F.pmod("seg", F.lit(count)))
    dealt.repartition("folder").sortWithinPartitions("folder", "seg").write.option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("folder").parquet(directory)


def facts_of(directory: str, count: int, seg: int) -> pa.Table | None:
    """What ``keep_facts`` wrote about one segment, None if nothing."""
    system, base = filesystem(f"{directory}/folder={seg % count}")
    if system.get_file_info(base).type.name == "NotFound":
        return None
    found = ds.dataset(base, filesystem=system, format="parquet").to_table(filter=pc.field("seg") == seg, use_threads=False)  # threads would read ahead, each into memory of its own
    return found if found.num_rows else None
