"""Schema catalogs: one row per column, from schema files, stored tables or description files."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.window import Window

from asklens.schemas import CATALOG, SPIDER_SCHEMA_FILE
from asklens.session import written


def _file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_catalog(spark: SparkSession, path: str, combined: bool = False, pattern: str = "*.json", lines: bool = False) -> DataFrame:
    """Catalog rows from Spider schema JSON.

    ``path`` is one combined file holding a list (``combined=True``) or a folder with one object
    per file. In a folder, files that hold lists (example files) are skipped and a missing
    db_id is the file's stem. With ``lines`` a file holds an object per line, so that many databases need few files, which
    Spark splits. Wildcard columns (table index -1) and columns of unknown tables are
    dropped; a table without columns keeps one row with a NULL column.
    """
    if combined:
        schemas = spark.read.schema(SPIDER_SCHEMA_FILE).json(path, multiLine=True)
    else:
        text = spark.read.text(path, wholetext=not lines, pathGlobFilter=pattern).select("value", _file_stem().alias("stem"))
        objects = text.where(~F.regexp_replace("value", r"^\s+", "").startswith("["))
        schemas = objects.select(F.from_json("value", SPIDER_SCHEMA_FILE).alias("s"), "stem").select(
            F.coalesce("s.db_id", "stem").alias("db_id"), "s.table_names_original", "s.column_names_original",
            "s.column_types", "s.column_descriptions")
        schemas = schemas.where(F.col("table_names_original").isNotNull())
    none = F.array().cast("array<string>")
    columns = schemas.select(
        "db_id", "table_names_original",
        F.transform("column_names_original", lambda c, i: F.struct(
            c[0].cast("int").alias("t"), c[1].alias("name"),
            F.get(F.coalesce("column_types", none), i).alias("type"),
            F.get(F.coalesce("column_descriptions", none), i).alias("desc"))).alias("cols"))
    tables = columns.select("db_id", "cols", F.posexplode("table_names_original").alias("table_idx", "table_name"))
    # A table's columns are picked inside its own database's row, so no join is needed.
    own = tables.withColumn("cols", F.filter("cols", lambda c: c["t"] == F.col("table_idx")))
    rows = own.select("db_id", "table_idx", "table_name", F.posexplode_outer("cols").alias("col_idx", "c"))
    return rows.select(
        "db_id", "table_idx", "table_name", "col_idx", F.col("c.name").alias("col_name"),
        F.col("c.type").alias("col_type"), F.nullif(F.col("c.desc"), F.lit("")).alias("col_desc"))


# Names under which stored column types appear in the catalog; others are upper-cased as they are.
TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "TEXT", "double": "REAL",
              "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}


# What stands for a stored table whose footer was not read.
FOOTER = T.StructType([
    T.StructField("table_name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("col_idx", T.IntegerType()), T.StructField("col_name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("reason", T.StringType())])


def table_footers(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """(table_name, path, col_idx, col_name, type, reason): the stored columns of the Parquet tables (table_name, path).

    Each task opens the footers of its own paths, one file of each folder, and no data. Types have Spark's
    names. A path that cannot be read is one row with a ``reason`` and no column; so is a NULL path. Paths may be
    local or addresses that Arrow opens; all executors must see them.
    """
    def opened(path: str):
        place, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
            fs.LocalFileSystem(), path)
        if place.get_file_info(name).type == fs.FileType.Directory:
            files = place.get_file_info(fs.FileSelector(name, recursive=True))
            data = sorted(f.path for f in files if f.is_file and not f.base_name.startswith(("_", ".")))
            if not data:
                raise FileNotFoundError("no data file")
            name = data[0]
        with place.open_input_file(name) as file:
            return pq.ParquetFile(file).schema_arrow

    def named(kind: pa.DataType) -> str:
        while pa.types.is_dictionary(kind):
            kind = kind.value_type
        # Unsigned numbers are read as the next wider signed ones.
        wider = {pa.uint8(): "smallint", pa.uint16(): "int", pa.uint32(): "bigint", pa.uint64(): "decimal(20,0)"}
        return wider.get(kind) or from_arrow_type(kind).simpleString()

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if path is None:
                        raise FileNotFoundError("no path")
                    rows += [(table, path, k, f.name, named(f.type), None) for k, f in enumerate(opened(path))]
                except (OSError, pa.ArrowException, PySparkException) as problem:
                    lines = str(problem).splitlines() or [""]
                    rows.append((table, path, None, None, None, f"{type(problem).__name__}: {lines[0]}"))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=FOOTER.names)

    asked = paths.select("table_name", "path")
    return (asked.repartition(partitions) if partitions else asked).mapInArrow(footers, FOOTER)


def catalog_of_footers(footers: DataFrame, db_id: str) -> DataFrame:
    """Catalog rows of the readable tables of ``table_footers``, numbered in name order, columns in stored order.

    Of several paths with one table name the first by path counts.
    """
    # Spark's name of a type, as the catalog writes it.
    shown = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])
    good = footers.where("reason IS NULL")
    firsts = good.groupBy("table_name").agg(F.min("path").alias("path"))
    numbered = firsts.withColumn("table_idx", F.row_number().over(Window.orderBy("table_name")) - 1)
    rows = good.join(numbered, ["table_name", "path"])
    return rows.select(*[c.cast(f.dataType).alias(f.name) for f, c in zip(CATALOG.fields, (
        F.lit(db_id), F.col("table_idx"), F.col("table_name"), F.col("col_idx"), F.col("col_name"),
        F.coalesce(shown[F.col("type")], F.upper("type")), F.lit(None)), strict=True)])


def catalog_from_tables(spark: SparkSession, tables: dict[str, str], db_id: str) -> DataFrame:
    """Catalog rows by reading the stored schemas of Parquet tables (name -> path).

    Only file footers are read, never data, by tasks. Tables are numbered in name order. A path that
    cannot be opened is left out; ``table_footers`` gives it with a reason. Tables that one job should not list on the driver
    come as a table of paths to ``table_footers``.
    """
    listed = spark.createDataFrame(sorted(tables.items()), "table_name string, path string")
    return catalog_of_footers(written(table_footers(listed, min(max(len(tables), 1), 200)), "footers"), db_id)


def first_of_each_db(catalogs: list[DataFrame]) -> DataFrame:
    """Stack catalogs; of several that describe the same db_id, the first one wins."""
    tagged = [c.withColumn("_src", F.lit(i)) for i, c in enumerate(catalogs)]
    stacked = reduce(lambda a, b: a.unionByName(b), tagged)
    winners = stacked.groupBy("db_id").agg(F.min("_src").alias("_src"))
    return stacked.join(winners, ["db_id", "_src"], "left_semi").drop("_src")


# Header spellings accepted per field, in order of preference.
DESCRIPTION_HEADERS = {
    "col_name": ("column_name", "Column", "COLUMN_NAME"),
    "col_type": ("data_type", "Type", "DATA_TYPE"),
    "col_desc": ("description", "Description", "COMMENT"),
}


# One CSV record: line ends inside quotes belong to it, blank lines are none.
_CSV_RECORD = r'(?:[^"\r\n]++|"[^"]*+")++'


def read_descriptions(spark: SparkSession, path: str, pattern: str = "*.csv",
                      folder_key: str | None = None) -> DataFrame:
    """Column descriptions from CSV files named after their table.

    With ``folder_key`` the table's name comes from folders ``<folder_key>=<table>`` instead.

    A spelling is chosen by which header the file has, not by which cell is filled. Rows without a
    column name are dropped. Gives (table_name, pos, col_name, col_type, col_desc, line).

    Each file is parsed whole, which keeps its header with its rows; such files describe the
    columns of one table and are small.
    """
    named = F.col(folder_key).cast("string") if folder_key else _file_stem()
    return parse_descriptions(spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(
        named.alias("table_name"), "value"))


def parse_descriptions(files: DataFrame) -> DataFrame:
    """As :func:`read_descriptions`, of a table (table_name, value) of whole files; many small ones are better kept in one."""
    files = files.select(F.regexp_extract_all("value", F.lit(_CSV_RECORD), F.lit(0)).alias("ls"), "table_name")
    # Headers differ per file, so cells are addressed by their place in the file's own header.
    header = F.transform(_csv_cells(F.col("ls")[0]), lambda h: F.regexp_replace(h, "^﻿", ""))
    # The header is made before the lines are unfolded; else each line would carry the whole file along.
    parts = files.select("table_name", header.alias("h"), F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))).alias("rest"))
    lines = parts.select("table_name", "h", F.posexplode("rest").alias("pos", "l"))
    # Unfolded, so that each use of a cell does not cut its line again.
    rows = lines.select("table_name", "h", "pos", F.explode_outer(F.array(_csv_cells(F.col("l")))).alias("c"))

    def cell(field: str) -> Column:
        place = F.lit(0)
        for name in reversed(DESCRIPTION_HEADERS[field]):
            at = F.array_position("h", name)
            place = F.when(at > 0, at).otherwise(place)
        return F.coalesce(F.get("c", (place - 1).cast("int")), F.lit(""))

    filled = rows.select("table_name", "pos", *[cell(f).alias(f) for f in DESCRIPTION_HEADERS]).where(
        F.col("col_name") != "")
    line = F.concat(
        F.lit("  - "), F.col("col_name"),
        F.when(F.col("col_type") != "", F.concat(F.lit(" ("), "col_type", F.lit(")"))).otherwise(""),
        F.when(F.col("col_desc") != "", F.concat(F.lit(": "), "col_desc")).otherwise(""))
    return filled.withColumn("line", line)


def _csv_cells(line: Column) -> Column:
    """Cells of one CSV record; a quoted cell may hold commas, line ends and doubled quotes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    return F.transform(raw, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def description_text(rows: DataFrame) -> DataFrame:
    """One text per table: ``Table: name`` and its column lines, in file order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy("table_name").agg(F.concat(
        F.lit("Table: "), F.first("table_name"), F.lit("\n"),
        F.array_join(F.transform(ordered, lambda r: r["line"]), "\n")).alias("description"))
