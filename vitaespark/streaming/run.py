"""Running streams over what is there now, and over what arrives piece by piece."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaespark.session import shared_folder

#: A time after all others.
END = 250_000_000_000


def stream_table(spark: SparkSession, folder: str, pattern: str = "*.parquet", max_files: int | None = None) -> DataFrame:
    """The parquet files of a folder as a stream with the schema they have."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def run_appending(stream: DataFrame, purpose: str, folder: str | None = None) -> DataFrame:
    """Run over all present input with a file sink in the shared folder and read the result.

    With the ``folder`` of an earlier run it goes on where that one stopped.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, purpose)
    running = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def run_arrivals(pieces: Iterable[DataFrame], build: Callable[[DataFrame, DataFrame], DataFrame], purpose: str,
                 folder: str | None = None, close: bool = True) -> DataFrame:
    """Run a stream over pieces that arrive one after another, and at the end move its clock past all of them.

    ``build`` makes the stream from that of the rows and that of the clock.  The clock has a folder of its
    own with one row, so nothing is added to the input.
    """
    for piece in pieces:
        spark = piece.sparkSession
        folder = folder or shared_folder(spark, purpose)
        piece.write.mode("append").parquet(f"{folder}/in")
        spark.createDataFrame([], "ts timestamp").write.mode("ignore").parquet(f"{folder}/clock")
        found = run_appending(build(stream_table(spark, f"{folder}/in"), stream_table(spark, f"{folder}/clock")), purpose, folder)
    if close:
        spark.range(1).select(F.timestamp_seconds(F.lit(END)).alias("ts")).write.mode("append").parquet(f"{folder}/clock")
        found = run_appending(build(stream_table(spark, f"{folder}/in"), stream_table(spark, f"{folder}/clock")), purpose, folder)
    return found
