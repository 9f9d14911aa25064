"""Readers: files to the long tables the operators expect."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.session import checkpointed
from tallyscope.operators.qc import INTEGER_TOLERANCE, normalize_label

POSITION_NAMES = {
    # Column names of headed coordinate tables, and their meaning here.
    "barcode": "obs_id", "pxl_col_in_fullres": "x", "pxl_row_in_fullres": "y", "imagecol": "x", "imagerow": "y", "x": "x", "y": "y",
}
# zeros as tables of counts are written; others are found as numbers
ZEROS = (b"0", b"0.0")
# text taken apart at a time, which stays in a core's cache with its fields
PIECE_BYTES = 1 << 18
POSITION_FIELDS = ("barcode", "in_tissue", "array_row", "array_col", "pxl_row_in_fullres", "pxl_col_in_fullres")


def read_table(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = ",", header: bool = True) -> DataFrame:
    """Delimited text with a declared schema (ids stay strings); gzip by extension."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "FAILFAST").csv(path)


def read_wide_counts(spark: SparkSession, path: str, id_col: str = "cell", sep: str = ",") -> tuple[DataFrame, str | None]:
    """Wide feature columns to long counts; a table without the id column is refused with a reason.

    The header gives the feature names; everything is read as text once and
    cast, so no inference pass runs over the data.
    """
    wide = spark.read.option("sep", sep).option("header", True).csv(path)
    if not wide.columns or wide.columns[0] != id_col:
        return wide.limit(0), f"first column is not {id_col!r}"
    features = wide.columns[1:]
    long = wide.withColumnRenamed(id_col, "obs_id").unpivot(["obs_id"], [f"`{c}`" for c in features], "feature_id", "raw")
    return long.select("obs_id", "feature_id", F.expr("try_cast(raw AS double)").alias("value")), None


def _apart(batches: Iterator[pa.RecordBatch], sep: bytes) -> Iterator[pa.RecordBatch]:
    """(sample_id, line, named) → a row per line: its fields by number, the first of them and those that are no zeros.

    Lines end with a newline, so that some of them are looked at as one array of bytes.
    """
    for batch in batches:
        step = max(1, PIECE_BYTES * len(batch) // max(1, batch.nbytes))
        for part in (batch.slice(i, step) for i in range(0, len(batch), step)):
            line, head = part.column("line"), part.column("named").to_numpy(zero_copy_only=False)
            _, ends, held = line.cast(pa.string()).buffers()
            ends = np.frombuffer(ends, np.int32)[line.offset : line.offset + len(line) + 1]
            text = b"\n" + memoryview(held)[ends[0] : ends[-1]].tobytes()
            # a byte that no text has stands for a longer separator
            text = np.frombuffer(text if len(sep) == 1 else text.replace(sep, b"\xff"), np.uint8)
            new = text == ord("\n")
            end = (text == (sep[0] if len(sep) == 1 else 0xFF)) | new
            full = end.copy()
            for zero in ZEROS:
                n = len(zero) + 1
                hit = end[n:] & end[:-n]
                for i, c in enumerate(zero, 1):
                    hit &= text[i : len(text) - n + i] == c
                full[n:] &= ~hit
            # field j is what stands between the ends j and j + 1
            cut = np.flatnonzero(end)
            first = np.searchsorted(cut, np.flatnonzero(new))
            at = np.flatnonzero(full[cut[1:]])
            of = np.searchsorted(first, at, "right") - 1
            at = at[(at != first[of]) & ~head[of]]
            upto = np.searchsorted(at, first).astype(np.int32)

            def some(j: np.ndarray, cut: np.ndarray = cut, text: np.ndarray = text) -> pa.StringArray:
                size = cut[j + 1] - cut[j] - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                held = text[np.repeat(cut[j] + 1 - ends[:-1], size) + np.arange(ends[-1])]
                return pa.StringArray.from_buffers(len(j), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(held))

            place = at - np.repeat(first[:-1], np.diff(upto))
            yield pa.RecordBatch.from_arrays([
                part.column("sample_id"), pa.array(np.diff(first).astype(np.int32)), some(first[:-1]), line.take(pa.array(np.arange(len(part)), mask=~head)),
                pa.ListArray.from_arrays(upto, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(upto, some(at)),
            ], ["sample_id", "_fields", "obs_id", "_head", "_places", "_raw"])


def read_count_tables(spark: SparkSession, path: str, id_col: str = "cell", sep: str = ",", sample: str = "([^/]+)$") -> tuple[DataFrame, DataFrame]:
    """Wide count tables of many samples → counts (sample_id, obs_id, feature_id, value) and (sample_id, skip_reason).

    Lines are read as text, once, and taken apart as Arrow arrays, so the plan has no column per
    feature and is as small for 20 000 features as for two; a line is written as one row of
    the values that are not zero, from which headers, widths and cells are read.
    Compressed files are read by extension.  ``sample`` finds the sample in the path of a file.  The line that begins with ``id_col`` names the
    features; a field may stand in double quotes but holds no separator.

    A sample is skipped as a whole, with its reason, if it has no such line
    (``first_column``), a line of another number of fields (``ragged_line``), or a value
    that is unreadable, fractional or negative.  Empty lines do not count.
    """
    file = F.regexp_extract(F.col("_metadata.file_path"), sample, 1).alias("sample_id")
    plain = F.when(F.contains("value", F.lit('"')), F.replace("value", F.lit('"'), F.lit(""))).otherwise(F.col("value"))
    text = spark.read.text(path).select(file, plain.alias("line")).where("line <> ''")
    named = F.startswith("line", F.lit(id_col + sep)) | (F.col("line") == id_col)
    text = text.select("sample_id", F.concat("line", F.lit("\n")).alias("line"), named.alias("named"))
    apart = text.mapInArrow(lambda batches: _apart(batches, sep.encode()), "sample_id string, _fields int, obs_id string, _head string, _places array<int>, _raw array<string>")
    numbers = F.transform("_raw", lambda raw: raw.try_cast("double"))
    lines = checkpointed(apart.select("sample_id", "_fields", "obs_id", "_head", F.arrays_zip(F.col("_places").alias("_place"), numbers.alias("value")).alias("_cells")))
    named = F.col("_head").isNotNull()
    # a header repeated in every part of a sample counts once
    heads = lines.where(named).select("sample_id", F.split(F.replace("_head", F.lit("\n"), F.lit("")), f"\\Q{sep}\\E").alias("_f")).distinct()
    features = heads.select("sample_id", F.posexplode("_f").alias("_place", "feature_id")).where("_place > 0")
    width = heads.groupBy("sample_id").agg(F.max(F.size("_f")).alias("_width"))
    shape = lines.groupBy("sample_id").agg(F.min(F.when(~named, F.col("_fields"))).alias("_least"), F.max(F.when(~named, F.col("_fields"))).alias("_most"))
    shape = shape.join(width, "sample_id", "left")
    wrong = shape.select("sample_id", F.when(F.col("_width").isNull(), "first_column").when((F.col("_least") != F.col("_width")) | (F.col("_most") != F.col("_width")), "ragged_line").alias("skip_reason"))
    wrong = checkpointed(wrong.where("skip_reason is not null"))
    cells = lines.where(~named).join(wrong.select("sample_id"), "sample_id", "left_anti").select("sample_id", "obs_id", F.inline("_cells"))
    long = cells.where("value is null or value <> 0").join(features, ["sample_id", "_place"])
    counts, skipped = usable_counts(long.select("sample_id", "obs_id", "feature_id", "value"))
    return counts, wrong.unionByName(skipped)


def integral_samples(long: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Per sample: can it be used, and if not why (the samples are skipped, not failed)."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v)
    s = long.groupBy(sample).agg(
        F.count_if(bad).alias("n_unreadable"),
        F.count_if(~bad & (F.abs(v - F.rint(v)) > INTEGER_TOLERANCE)).alias("n_fractional"),
        F.count_if(~bad & (v < 0)).alias("n_negative"),
    )
    return s.withColumn(
        "skip_reason",
        F.when(F.col("n_unreadable") > 0, "unreadable_value").when(F.col("n_fractional") > 0, "fractional_value")
        .when(F.col("n_negative") > 0, "negative_value"),
    )


def usable_counts(long: DataFrame, sample: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Counts of the samples whose values all are counts, and (sample, skip_reason) of the others."""
    verdict = integral_samples(long, sample)
    skipped = verdict.where("skip_reason is not null").select(sample, "skip_reason")
    # rounded here: a failing check could be evaluated before the join
    kept = long.join(skipped, sample, "left_anti").withColumn("value", F.rint("value").cast("long"))
    return kept.where(F.col("value") != 0), skipped


def to_counts(long: DataFrame) -> DataFrame:
    """Non-zero counts of a long table; a value that is no whole number within the tolerance fails."""
    v = F.col("value")
    whole = v.isNotNull() & ~F.isnan(v) & (F.abs(v - F.rint(v)) <= INTEGER_TOLERANCE)
    fail = F.raise_error(F.concat(F.lit("not a count: "), F.coalesce(v.cast("string"), F.lit("NULL")))).cast("double")
    checked = long.withColumn("value", F.when(whole, v).otherwise(fail))
    return checked.withColumn("value", F.rint("value").cast("long")).where(F.col("value") != 0)


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate table with or without a header line → (obs_id, x, y).

    Only the first line is looked at to decide which of the two it is: it is a
    header if any cell is a known column name, wherever the barcode stands.
    """
    first = spark.read.text(path).head(1)
    cells = [c.strip().strip('"') for c in first[0][0].split(",")] if first else []
    headed = any(c.lower() in ("barcode", "obs_id") or c in POSITION_NAMES for c in cells) or cells[:1] == [""]
    if headed:
        df = spark.read.option("header", True).csv(path)
        df = df.withColumnsRenamed({c: POSITION_NAMES[c] for c in df.columns if c in POSITION_NAMES})
    else:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in POSITION_FIELDS])
        df = spark.read.schema(schema).csv(path)
        df = df.withColumnsRenamed({c: POSITION_NAMES[c] for c in df.columns if c in POSITION_NAMES})
    return df.select("obs_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def read_labels(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Headerless (id, label); blank, NA and NAN are ``unknown``; a repeated id fails."""
    raw = spark.read.schema("obs_id string, label string").option("sep", sep).csv(path)
    return unique_labels(raw.select(F.trim("obs_id").alias("obs_id"), normalize_label("label").alias("label")))


def unique_labels(df: DataFrame) -> DataFrame:
    per = df.groupBy("obs_id").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("label"))
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("label id repeats: "), F.col("obs_id"))).cast("boolean")
    )
    return per.where(ok).select("obs_id", "label")


def scan_sections(table: DataFrame, section: str) -> DataFrame:
    """Rows per section from a pruned scan of one column."""
    return table.groupBy(section).agg(F.count(F.lit(1)).alias("n_rows"))


def load_metadata(table: DataFrame, columns: Sequence[str], section: str, sections: Sequence | DataFrame) -> DataFrame:
    """Wanted columns of the wanted sections; the filter and the columns reach the scan."""
    if isinstance(sections, DataFrame):
        return table.select(*columns).join(sections.select(section).distinct(), section, "left_semi")
    return table.where(F.col(section).isin(*sections)).select(*columns)


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """GMT lines → (term, source, members without repeats)."""
    return parse_gene_sets(spark.read.text(path))


def parse_gene_sets(lines: DataFrame, value: str = "value") -> DataFrame:
    parts = F.split(F.col(value), "\t")
    return lines.where(F.size(parts) >= 3).select(
        F.element_at(parts, 1).alias("term"), F.element_at(parts, 2).alias("source"),
        F.array_distinct(F.filter(F.slice(parts, 3, F.size(parts) - 2), lambda g: F.trim(g) != "")).alias("members"),
    )


LABEL_LINE = r'^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s+([\d.]+)\s+(\d+)\s+(\d+)\s+"(.*)"\s*$'


def read_label_defs(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_defs(spark.read.text(path))


def parse_label_defs(lines: DataFrame, value: str = "value") -> DataFrame:
    """Label-definition text: comments skipped, ``"acronym: name"`` split."""
    rows = lines.where(~F.col(value).rlike(r"^\s*(#|$)") & F.col(value).rlike(LABEL_LINE))
    quoted = F.regexp_extract(value, LABEL_LINE, 8)
    split = quoted.contains(":")
    return rows.select(
        F.regexp_extract(value, LABEL_LINE, 1).cast("int").alias("struct_id"),
        F.trim(F.when(split, F.split_part(quoted, F.lit(":"), F.lit(1))).otherwise(quoted)).alias("acronym"),
        F.trim(F.when(split, F.regexp_replace(quoted, r"^[^:]*:", "")).otherwise(quoted)).alias("name"),
    )


BLUEPRINT_SCHEMA = (
    "metadata struct<age:string>, slices array<struct<z_index:int, z_world:double, voxel_j:int, voxel_i:array<int>, "
    "voxel_k:array<int>, x:array<double>, y:array<double>, region:array<string>>>"
)


def read_blueprint(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Nested slices of parallel arrays (JSON lines, gzip by extension) → one row per spot.

    ``multi_line`` reads files that hold one record over many lines; each of
    them is then one task.
    """
    raw = spark.read.schema(BLUEPRINT_SCHEMA).option("multiLine", multi_line).json(path)
    return explode_blueprint(raw)


def explode_blueprint(raw: DataFrame) -> DataFrame:
    s = raw.select(F.col("metadata.age").alias("age"), F.explode("slices").alias("s"))
    z = s.select(
        "age", F.col("s.z_index").alias("z_index"), F.col("s.z_world").alias("z_world"), F.col("s.voxel_j").alias("j"),
        F.explode(F.arrays_zip(
            F.col("s.voxel_i").alias("i"), F.col("s.voxel_k").alias("k"), F.col("s.x").alias("x"), F.col("s.y").alias("y"),
            F.col("s.region").alias("region"),
        )).alias("v"),
    )
    names = ("i", "k", "x", "y", "region")
    fields = z.schema["v"].dataType.names
    return z.select("age", "z_index", "z_world", "j", *[F.col("v").getField(f).alias(n) for f, n in zip(fields, names, strict=True)])
