"""Watch a landing folder: each trigger previews the new exports and saves their drafts."""

from __future__ import annotations

import re
import zlib
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyloom.plans.imports import long_lines, preview_staged
from tallyloom.sources.ledger import Ledger
from tallyloom.sources.staging import from_files


def ingest_landing(
    spark: SparkSession,
    landing: str,
    ledger: Ledger,
    checkpoint: str,
    as_of: date | None = None,
    created_at: datetime | None = None,
    files_per_trigger: int = 10_000,
) -> StreamingQuery:
    """Start a run over everything that has arrived and stop when it is saved.

    The stream carries names only, at most `files_per_trigger` of them a batch; their contents are staged by Spark's readers, whatever the
    size of a file. Files that give no rows are kept with their reasons in the ledger's rejects.

    The stream checkpoint remembers which files are done. Drafts, lines and rejects of a batch are seen together or not at all, and a
    batch that is tried again after it was saved adds nothing twice.
    """

    stream = zlib.crc32(checkpoint.encode())  # batches of another stream have other names

    def save(files: DataFrame, batch_id: int) -> None:
        names = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r.path) for r in files.select("path").collect()]
        if not names:
            return
        preview = preview_staged(from_files(spark, names), as_of=as_of)
        nested = preview.drafts.nested()
        ledger.save(
            nested,
            order=["file", "first_row"],
            as_of=as_of,
            created_at=created_at,
            long_lines=long_lines(preview, nested),
            rejects=preview.rejects,
            batch_id=f"stream-{stream:08x}-{batch_id}",
        )

    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(landing)
        .select("path")
    )
    return (
        arrivals.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
