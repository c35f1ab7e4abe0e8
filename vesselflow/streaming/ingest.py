"""Incremental ingest of newly landed raw files (Q1 as a file stream).

New half-month files land in a folder over time; a file-source stream picks up
only files it has not seen (tracked in the query checkpoint) and lands them through the same
function and ledger as the batch job, so both may write one folder in any order.  ``availableNow``
processes the backlog and stops, so the same code serves a scheduled batch and a continuous service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselflow import schemas
from vesselflow.operators import clean, geo
from vesselflow.operators.models import classify_by_speed
from vesselflow.sources import landing


FILES = "path string, modificationTime timestamp, length long, content binary"        # fixed by Spark's binary file source


def raw_ping_stream(spark: SparkSession, landing_dir: str, glob: str = "*.csv",
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(schemas.RAW_PINGS).option("header", True).option("enforceSchema", False)
         .option("pathGlobFilter", glob).option("recursiveFileLookup", True))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(landing_dir).withColumn("source_file", F.col("_metadata.file_path"))


def clean_stream(stream: DataFrame, mpa: geo.ZoneLayer, ports: DataFrame | None = None,
                 port_radius_km: float = 5.0) -> DataFrame:
    """Preprocessing (P1-P6, J3, J4, M1a) of the raw rows of whole files; of a row stream without the per-file id (P5), which
    needs the whole file."""
    p = clean.preprocess(stream, file_col="source_file", with_ids=not stream.isStreaming)
    p = geo.attach_mpa(p, mpa)
    if ports is not None:
        p = geo.flag_port_visits(p, ports, radius_km=port_radius_km)
    return classify_by_speed(p)


def start_ingest(spark: SparkSession, landing_dir: str, out_dir: str, mpa: geo.ZoneLayer,
                 ports: DataFrame | None = None, checkpoint: str | None = None, available_now: bool = True):
    """Start the stream; the checkpoint defaults to a folder beside the data in ``out_dir`` (readers skip
    names that begin with an underscore), the same for every driver, so a restart resumes where the last one stopped."""
    checkpoint = checkpoint or out_dir.rstrip("/") + "/_ingest_checkpoint"
    found = (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True)
             .load(landing_dir).select("path"))                                # the listing only: contents are not read

    def commit(batch: DataFrame, _) -> None:
        landing.land(batch.sparkSession, landing_dir, out_dir, lambda raw: clean_stream(raw, mpa, ports), only=batch)

    w = found.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
