"""Where results go: CSV, JSON, text, and the folder for what jobs write in between."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset and tasks run on this machine (tests), a folder of it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="coderill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def application_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/coderill/{spark.sparkContext.applicationId}"
    if path not in _ends_with_driver:
        _ends_with_driver.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_ends_with_driver: set[str] = set()


def to_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one a partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def to_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def report_csv(df: DataFrame, path: str) -> None:
    """One CSV file, written by the driver row after row: for reports, whose size a reader bounds."""
    import csv

    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def _records(df: DataFrame):
    """JSON texts of the rows, as the driver gets them, a partition at a time."""
    return (x["j"] for x in df.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) as j").toLocalIterator()) if df.columns else iter(())


def report_json(df: DataFrame, path: str) -> None:
    """One JSON array of records with an indent of two, written row after row."""
    with open(path, "w", encoding="utf-8") as f:
        before = "[\n"
        for text in _records(df):
            f.write(before + "  " + json.dumps(json.loads(text), indent=2, ensure_ascii=False).replace("\n", "\n  "))
            before = ",\n"
        f.write("[]" if before == "[\n" else "\n]")


def report_text(df: DataFrame, n: int = 10) -> str:
    """The first rows as a text table."""
    return df._show_string(n, False, False)


def report_document(parts: dict[str, DataFrame]) -> str:
    """One JSON document of several named results."""
    return json.dumps({k: [json.loads(x) for x in _records(df)] for k, df in parts.items()}, ensure_ascii=False)
