"""Bronze CSV scan.

The extracts are headered, comma separated, CRLF terminated and carry no
quoting; an empty field is NULL.  They are read against the declared schema
(never inferred).  A row whose fields do not convert makes the load fail, as
the source's bulk insert does; ``on_bad_rows="null"`` keeps such rows with
NULLs in the fields that did not convert.  With ``keep_corrupt`` every row also carries its text if it is
such a row, so one parse gives the good rows, the bad ones and their number.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.schemas import BRONZE, SOURCE_FILES

CORRUPT = "_corrupt_record"

# Rows of one written extract file.  A compressed file is read by one task, so its size is bounded.
ROWS_PER_FILE = 1_000_000


def read_bronze_csv(spark: SparkSession, path: str, table: str, on_bad_rows: str = "fail",
                    keep_corrupt: bool = False) -> DataFrame:
    if on_bad_rows not in ("fail", "null"):
        raise ValueError("on_bad_rows must be 'fail' or 'null'")
    schema = BRONZE[table]
    if keep_corrupt:
        schema = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType(), True)])
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("sep", ",")
        .option("quote", "")          # fields are never quoted
        .option("escape", "")
        .option("enforceSchema", "true")  # header names may differ in case
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")  # blanks are data here
        .option("dateFormat", "yyyy-MM-dd")
        .option("timestampFormat", "yyyy-MM-dd[ HH:mm:ss[.SSS]]")
        .option("mode", "FAILFAST" if on_bad_rows == "fail" else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def write_extracts(frames: dict[str, DataFrame], folder: str) -> None:
    """Write frames as extracts in the source's format (each a folder of gzipped CSV files of at most
    ``ROWS_PER_FILE`` rows)."""

    def one(name: str) -> None:
        (frames[name].write.mode("overwrite")
         .option("header", "true").option("sep", ",").option("quote", "").option("escape", "")
         .option("nullValue", "").option("emptyValue", "").option("lineSep", "\r\n")
         .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
         .option("dateFormat", "yyyy-MM-dd").option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
         .option("compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE)
         .csv(f"{folder.rstrip('/')}/{SOURCE_FILES[name]}"))

    with ThreadPoolExecutor(max_workers=len(frames)) as pool:
        list(pool.map(one, frames))


def is_bad():
    """Rows of a scan with ``keep_corrupt`` whose fields did not all convert."""
    return F.col(CORRUPT).isNotNull()
