"""Tables and files that a job keeps in the shared folder between two of its steps."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame

from beatloom.session import work_dir


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back.

    This cuts the lineage: the files outlive any executor, later steps read only the columns they need,
    and the planner knows the true size, so that it broadcasts a side only when the side is small.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file, usable in tasks and in the driver alike."""
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "", 1))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal few rows that stand for much work, such as file names, to as many tasks as a shuffle has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
