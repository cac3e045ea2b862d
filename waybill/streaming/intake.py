"""Files as they arrive: a folder watched by a stream, each batch run through the same plan as a whole folder.

The product rebuilt here answers one request at a time; a watched folder is an extension of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "shipment_id bigint, invoice_no string, items array<struct<material_name string, quantity_value double, unit_price double>>, received_at timestamp"


def watch(spark: SparkSession, folder: str, schema: str = RECORDS, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the JSON-lines files that arrive in a folder; the rate is bounded by files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def first_deliveries(stream: DataFrame, key: str = "shipment_id", late: str = "7 days") -> DataFrame:
    """Each record once, though it is delivered again within the watermark; state is bounded by it."""
    return stream.withWatermark("received_at", late).dropDuplicatesWithinWatermark([key])


def daily_totals(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Records and their value by day of arrival; late records count until the watermark has passed."""
    value = F.aggregate(F.coalesce("items", F.array().cast("array<struct<material_name string, quantity_value double, unit_price double>>")), F.lit(0.0), lambda s, i: s + F.coalesce(i["quantity_value"] * i["unit_price"], F.lit(0.0)))
    return stream.withWatermark("received_at", late).groupBy(F.window("received_at", "1 day").alias("day")).agg(F.count("*").alias("n"), F.sum(value).alias("value"))


def run_batches(stream: DataFrame, plan: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a plan on each batch of a stream until what is there is worked off; restarts go on from the checkpoint."""
    return stream.writeStream.foreachBatch(plan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
