"""Reading and writing tables."""

from __future__ import annotations

import logging
import os
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.evidence import evidence_text

log = logging.getLogger(__name__)

FORMATS = ("parquet", "csv", "json")

# Columns of the saved class-A report.
REPORT_COLUMNS = ["Class", "accident_type", "evidence", "uplift", "s2_2_importance", "CRI_Score", "matched_details"]
LEARNED_REPORT_COLUMNS = ["accident_type", "evidence", "lift", "support_rate", "s2_2_importance", "CRI_Learned", "Class"]
CONFIG_COLUMNS = ["state", "model_version", "w1", "w2"]
REQUIRED_COLUMNS = ["CRI_Score", "accident_type", "evidence"]


def _format_of(path: str) -> str:
    ending = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file format: {path}")
    return ending


def read_table(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Parquet, csv or json by the path's ending; options go to the reader."""
    kind = _format_of(path)
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", True)
    reader = reader.options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_incidents(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The incident csv: UTF-8, header, quoted narratives with line breaks.

    Quoted line breaks keep Spark from splitting a file, so one file is one task: deliver large
    data as many files, and give a ``schema`` to save the pass that infers it.
    """
    reader = (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("multiLine", True)
        .option("escape", '"')
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    log.info("incident table with %d columns: %s", len(df.columns), path)
    return df


def save_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.save(path)


def load_results(spark: SparkSession, path: str, fmt: str = "csv", schema=None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
        if schema is None:
            reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def safe_save(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write to ``path``, or to a time-stamped sibling if it exists; returns what was written."""
    try:
        save_results(df, path, fmt)
        return path
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    other = f"{path.rstrip('/')}_{stamp}"
    save_results(df, other, fmt)
    return other


def read_column_list(spark: SparkSession, path: str, first: str = "narrative") -> list[str]:
    """One column name per line, blank lines skipped, order kept.

    The list is configuration: the file is read whole as one small text.
    """
    text = spark.read.text(path, wholetext=True).first()
    names = [line.strip() for line in (text["value"] if text else "").splitlines() if line.strip()]
    if not names:
        log.warning("the column list %s is empty", path)
    elif first not in names[0].lower():
        log.warning("the first listed column is %r, not the narrative", names[0])
    return names


def save_importances(df: DataFrame, path: str) -> None:
    """Importance list, largest first; re-read it with its order column ``position``."""
    df.select("feature_name", "importance_score").orderBy(F.desc("importance_score"), "feature_name").write.parquet(path)


def load_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy(F.desc("importance_score"), "feature_name")


def save_class_a(df: DataFrame, root: str, mode: str = "append", columns: list[str] | None = None) -> None:
    """Report rows below ``state=…/model_version=…/w1=…/w2=…``; evidence as canonical text.

    Listed columns that the table lacks are left out.
    """
    config = [c for c in CONFIG_COLUMNS if c in df.columns]
    shown = [c for c in columns or REPORT_COLUMNS if c in df.columns]
    if "evidence" in shown and isinstance(df.schema["evidence"].dataType, T.MapType):
        df = df.withColumn("evidence", evidence_text("evidence"))
    df.select(*shown, *config).write.mode(mode).partitionBy(*config).parquet(root)


def load_scenarios(spark: SparkSession, root: str, state: str | None = None) -> DataFrame:
    """Saved scenario rows of all configurations; a state filter reads only that state's folders.

    A configuration that was never written is simply absent; files that lack a required column
    are skipped with a warning. The report files are few (settings times writes), their footers
    are read on the driver.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    # one entry per file, no content is read
    files = [r["path"] for r in listed.load(root).select("path").collect()]
    if state is not None:
        files = [f for f in files if f"/state={state}/" in unquote(f)]
    good, lacking = [], set()
    for f in sorted(files):
        columns = spark.read.parquet(f).columns
        missing = [c for c in REQUIRED_COLUMNS if c not in columns]
        if missing:
            log.warning("%s lacks %s and is skipped", f, missing)
            lacking.update(missing)
        else:
            good.append(f)
    if not good:
        raise ValueError(f"no scenario file has all of {REQUIRED_COLUMNS}; missing: {sorted(lacking)}")
    df = spark.read.option("basePath", root).option("mergeSchema", True).parquet(*good)
    typed = {c: F.col(c).cast("double") for c in ("w1", "w2") if c in df.columns}
    identified = F.concat_ws(" | ", "accident_type", "evidence")
    return df.withColumns({**typed, "scenario_id": identified})
