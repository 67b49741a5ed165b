"""File readers: CSV / TSV / delimited text (separator sniffed over the whole
file), Parquet, JSON with nested objects flattened to ``a.b`` names, and
Stata ``.dta`` with variable / value labels kept in the schema metadata.
``read_dispatch`` picks the reader by file extension."""

from __future__ import annotations

import io
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED = ("csv", "tsv", "txt", "parquet", "json", "dta")
CANDIDATE_SEPARATORS = [",", "\t", ";", "|"]


def scan_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).option("sep", sep).csv(path)


def scan_tsv(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, "\t")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """Pick the separator whose per-line count is constant and largest over
    every line of the input (one aggregate; no sample)."""
    lines = spark.read.text(path).where(F.length("value") > 0)
    aggs = []
    for i, s in enumerate(CANDIDATE_SEPARATORS):
        cnt = F.size(F.split(F.col("value"), "\\" + s if s in "|" else s)) - 1
        aggs += [F.min(cnt).alias(f"mn{i}"), F.max(cnt).alias(f"mx{i}"), F.avg(cnt).alias(f"av{i}")]
    r = lines.agg(*aggs).first()
    consistent = [(r[f"mn{i}"], s) for i, s in enumerate(CANDIDATE_SEPARATORS)
                  if r[f"mn{i}"] is not None and r[f"mn{i}"] > 0 and r[f"mn{i}"] == r[f"mx{i}"]]
    if consistent:
        return max(consistent)[1]
    best = max(range(len(CANDIDATE_SEPARATORS)), key=lambda i: r[f"av{i}"] or 0)
    return CANDIDATE_SEPARATORS[best] if (r[f"av{best}"] or 0) > 0 else ","


def scan_txt(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, sniff_separator(spark, path))


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def flatten_columns(schema: T.StructType, prefix: str = "") -> list:
    """Recursive projection of nested structs to top-level ``a.b`` columns."""
    out = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += flatten_columns(f.dataType, name + ".")
        else:
            path = ".".join(f"`{p}`" for p in name.split("."))
            out.append(F.col(path).alias(name))
    return out


def _json_lines(spark: SparkSession, path) -> DataFrame:
    """(file, value, whole) of every line that is not blank: ``whole`` tells that it is a record by itself."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
        F.monotonically_increasing_id().alias("place")).where(F.trim("value") != "")
    return lines.withColumn("whole", F.ltrim("value").rlike("^[\\[{]") & F.try_parse_json("value").isNotNull())


def json_documents(spark: SparkSession, path) -> list[str]:
    """Files under ``path`` that are one JSON value over several lines.  Only a file whose first
    line is no record can be one, and it is one if it parses as a whole; any other file holds
    a record a line, some of which may be corrupt."""
    first = _json_lines(spark, path).groupBy("file").agg(F.min_by("whole", F.struct("block", "place")).alias("whole"))
    doubtful = [r["file"] for r in first.where("NOT whole").select("file").collect()]   # file names only
    if not doubtful:
        return []
    parsed = spark.read.schema("_corrupt_record string, _any string").option("multiLine", True).json(doubtful)
    broken = parsed.select("_corrupt_record", "_any", F.col("_metadata.file_path").alias("file")).where(
        "_corrupt_record IS NOT NULL").select("file", "_any").distinct().collect()
    return sorted(set(doubtful) - {r["file"] for r in broken})


def corrupt_json_lines(spark: SparkSession, path) -> DataFrame:
    """(file, value) of the lines that ``scan_json_flat`` leaves out because they don't parse."""
    documents = json_documents(spark, path)
    return _json_lines(spark, path).where(~F.col("whole") & ~F.col("file").isin(documents)).select("file", "value")


def scan_json_flat(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """One record per line, or whole documents (an object or an array of records over several
    lines).  Not told which, every file is judged by itself.  A line that doesn't parse costs
    that line only; ``corrupt_json_lines`` returns those."""
    def read(paths, whole: bool) -> DataFrame:
        df = spark.read.option("multiLine", whole).option("mode", "DROPMALFORMED").json(paths)
        return df.select(*flatten_columns(df.schema))
    if multiline is not None:
        return read(path, multiline)
    documents = json_documents(spark, path)
    if not documents:
        return read(path, False)
    others = [r["file"] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("file")).distinct()
              .where(~F.col("file").isin(documents)).collect()]
    if not others:
        return read(documents, True)
    return read(others, False).unionByName(read(documents, True), allowMissingColumns=True)


# ----------------------------------------------------------------- Stata

def _dta_schema(sample: bytes) -> tuple[T.StructType, dict, dict]:
    import pandas as pd
    with pd.io.stata.StataReader(io.BytesIO(sample)) as rd:
        data = rd.read(convert_categoricals=False)
        var_labels = rd.variable_labels()
        value_labels = rd.value_labels()
        lbl_names = dict(zip(rd._varlist, rd._lbllist)) if hasattr(rd, "_lbllist") else {}
    fields = []
    for c in data.columns:
        kind = data[c].dtype.kind
        dt = T.LongType() if kind in "iu" else T.DoubleType() if kind == "f" else T.StringType()
        md = {}
        if var_labels.get(c):
            md["label"] = var_labels[c]
        lname = lbl_names.get(c) or (c if c in value_labels else None)
        if lname and lname in value_labels:
            md["value_labels"] = {str(int(k)): str(v) for k, v in value_labels[lname].items()}
        fields.append(T.StructField(c, dt, True, md))
    return T.StructType(fields), var_labels, value_labels


def scan_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Read many ``.dta`` files in parallel: ``binaryFile`` lists them, one task
    decodes each file with pandas inside ``mapInPandas``.  Variable and value
    labels go into ``StructField.metadata`` (read from one file's header)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dta").load(path)
    first = files.select("content").limit(1).first()
    if first is None:
        raise ValueError(f"no .dta files under {path}")
    schema, _, _ = _dta_schema(bytes(first["content"]))
    plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    names = [f.name for f in schema.fields]

    def decode(batches):
        import pandas as pd
        for b in batches:
            for content in b["content"]:
                with pd.io.stata.StataReader(io.BytesIO(bytes(content))) as rd:
                    d = rd.read(convert_categoricals=False)
                yield d[names]

    out = files.select("content").mapInPandas(decode, plain)
    return out.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema.fields])


def write_dta_parts(df: DataFrame, out_dir: str, value_labels: dict[str, dict[int, str]] | None = None,
                    variable_labels: dict[str, str] | None = None) -> DataFrame:
    """Write each partition as one ``.dta`` file (pandas writer in the task);
    returns (file, rows).  ``out_dir`` must be on shared storage."""
    value_labels = value_labels or {}
    variable_labels = variable_labels or {}

    def write(batches):
        import uuid
        import pandas as pd
        frames = [b for b in batches]
        if not frames:
            return
        pdf = pd.concat(frames, ignore_index=True)
        os.makedirs(out_dir, exist_ok=True)
        fn = os.path.join(out_dir, f"part-{uuid.uuid4().hex}.dta")
        pdf.to_stata(fn, write_index=False, value_labels=value_labels or None,
                     variable_labels=variable_labels or None, version=118)
        yield pd.DataFrame({"file": [fn], "rows": [len(pdf)]})

    return df.mapInPandas(write, "file string, rows long")


def read_dispatch(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Extension -> reader; unsupported extensions raise the reference's message."""
    ext = os.path.splitext(name or path.rstrip("/"))[1].lower().lstrip(".")
    readers = {"csv": scan_csv, "tsv": scan_tsv, "txt": scan_txt, "parquet": scan_parquet,
               "json": scan_json_flat, "dta": scan_labelled}
    if ext not in readers:
        raise ValueError(f"Unsupported file extension: .{ext}")
    return readers[ext](spark, path)
