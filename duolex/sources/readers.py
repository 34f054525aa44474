"""Readers and sinks: typed checks around Spark's sources. Paths are Spark paths, also where files are listed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, blank: str | None = "") -> DataFrame:
    """A CSV file with a header, all strings; path.gz if path is missing. Empty cells are blank."""
    found = path if exists(spark, path) else f"{path}.gz"
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = reader.csv(found, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns])) if columns else reader.csv(found)
    return df if blank is None else df.fillna(blank)


def read_optional_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An absent file is an empty table."""
    if exists(spark, path) or exists(spark, f"{path}.gz"):
        return read_csv(spark, path)
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def with_exact_header(df: DataFrame, expected: list[str]) -> DataFrame:
    if df.columns != expected:
        raise ValueError(f"header {df.columns} is not {expected}")
    return df


def with_required(df: DataFrame, required: set[str]) -> DataFrame:
    if missing := required - set(df.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df


def read_json_object(spark: SparkSession, path: str) -> dict:
    """A small JSON document (configuration, summary)."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_jsonl_last(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The last row of each key, in the order of files and lines."""
    rows = spark.read.schema(schema).json(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return rows.withColumn("__at", at).groupBy(key).agg(F.max_by(F.struct(*rows.columns), "__at").alias("r")).select("r.*")


def read_jsonl_unique(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """Missing or repeated keys are errors when rows are read."""
    rows = spark.read.schema(schema).json(path)
    if not rows.filter(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{path}: a row lacks {key}")
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{path}: {key} {twice[0][0]} is there {twice[0].n} times")
    return rows


def read_globbed(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Batch files by name order: file_order is the file, whose order decides between repeats."""
    return spark.read.schema(schema).json(pattern).withColumn("file_order", F.col("_metadata.file_name"))


def read_captures(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """path, content, sha256 of raw files; with expected (path, sha256) only files whose hash agrees."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return files if expected is None else files.join(expected, ["path", "sha256"], "left_semi")


def manifest_index(manifest: DataFrame, keys: list[str], order: str) -> DataFrame:
    """key, row: the last manifest row for each document id and each address."""
    row = F.struct(*manifest.columns)
    pairs = manifest.select(F.explode(F.array_distinct(F.array_compact(F.array(*(F.col(k).cast("string") for k in keys))))).alias("key"), row.alias("row"), F.col(order).alias("at"))
    return pairs.groupBy("key").agg(F.max_by("row", "at").alias("row"))


def read_xlsx(content: bytes, sheet: str) -> list[list[str]]:
    """Cells of a workbook's sheet as text, by the standard library's zip and XML readers."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        strings = ["".join(t.text or "" for t in s.iter(f"{main}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        sheets = {s.get("name"): s.get(rel) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        if sheet not in sheets:
            raise ValueError(f"no sheet {sheet}")
        root = ElementTree.fromstring(z.read("xl/" + targets[sheets[sheet]].lstrip("/").removeprefix("xl/")))
    out = []
    for row in root.iter(f"{main}row"):
        cells: dict[int, str] = {}
        for c in row.iter(f"{main}c"):
            letters = re.match("[A-Z]+", c.get("r", "A"))[0]
            place = 0
            for x in letters:
                place = place * 26 + ord(x) - 64
            v, t = c.find(f"{main}v"), c.find(f"{main}is")
            text = "".join(x.text or "" for x in t.iter(f"{main}t")) if t is not None else (v.text or "") if v is not None else ""
            cells[place - 1] = strings[int(text)] if c.get("t") == "s" and text else text
        out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def read_workbooks(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """path, row, cells array<string> of a sheet of each workbook that path names; a file is one task's."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = read_xlsx(bytes(content), sheet)
                yield pd.DataFrame({"path": name, "row": range(1, len(rows) + 1), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, cells array<string>")


def with_header(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Cells (path, row, cells) as these columns, found by the header, which is each file's first row with all of them."""
    head = rows.filter(F.size(F.array_except(F.array(*map(F.lit, columns)), F.transform("cells", lambda c: F.trim(c)))) == 0)
    head = head.groupBy("path").agg(F.min_by(F.transform("cells", lambda c: F.trim(c)), "row").alias("names"), F.min("row").alias("first"))
    below = rows.join(head, "path").filter("row > first")
    return below.select("path", "row", *(F.coalesce(F.get("cells", (F.array_position("names", c) - 1).cast("int")), F.lit("")).alias(c) for c in columns))


# ---- sinks ---------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly these columns; one that df has besides them is an error, as is a missing one."""
    if extra := set(df.columns) - set(columns):
        raise ValueError(f"unknown columns: {sorted(extra)}")
    df.select(columns).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_union_csv(parts: list[DataFrame], path: str) -> None:
    """The header is the first-seen order over all parts."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    write_csv(whole, path, whole.columns)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line with sorted keys; nulls are written."""
    df.select(sorted(df.columns)).write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def write_blobs(df: DataFrame, root: str, id_col: str, content: str) -> DataFrame:
    """Content-addressed files id=…/sha256=…; a blob that is there isn't written again. Returns id and sha256."""
    named = df.select(id_col, F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates([id_col, "sha256"])
    spark = df.sparkSession
    new = named
    if exists(spark, root):
        new = named.join(spark.read.parquet(root).select(id_col, "sha256"), [id_col, "sha256"], "left_anti")
    new.write.mode("append").parquet(root)
    return named.select(id_col, "sha256")


def write_table(df: DataFrame, name: str, key: str) -> None:
    """A table whose key must be unique."""
    if not df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{name}: {key} isn't unique")
    df.write.mode("overwrite").saveAsTable(name)


def append_manifest(captures: DataFrame, path: str) -> None:
    """A line for each capture: key, addresses, type, size, hash, time and error; lines that are there stay."""
    write_jsonl(captures.select("key", "url", "final_url", "content_type", "byte_count", "sha256", "retrieved_at", "error"), path, append=True)


def write_summary(spark: SparkSession, path: str, tables: dict[str, DataFrame], inputs: list[str], parameters: dict) -> dict:
    """Rows of each table, parameters and the hash of each input file, as one JSON document."""
    files = {r.path: r.sha256 for p in inputs for r in read_captures(spark, p).select("path", "sha256").collect()}
    made = {"tables": {k: df.count() for k, df in sorted(tables.items())}, "inputs": files, "parameters": parameters}
    spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return made


def summary_json(df: DataFrame, inputs: dict[str, str], parameters: dict) -> str:
    """Rows, parameters and input hashes as JSON."""
    return json.dumps({"rows": df.count(), "columns": df.columns, "inputs": inputs, "parameters": parameters}, sort_keys=True)


def bar_chart(rows: list[tuple[str, float]], title: str, width: int = 640) -> str:
    """Horizontal bars as SVG, for at most some twenty aggregated rows."""
    from xml.sax.saxutils import escape

    top = max((abs(v) for _, v in rows), default=1) or 1
    bars = "".join(f'<text x="8" y="{46 + 22 * k}">{escape(n)}</text><rect x="200" y="{34 + 22 * k}" width="{abs(v) / top * (width - 220):.1f}" height="14"/>' for k, (n, v) in enumerate(rows))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{50 + 22 * len(rows)}"><text x="8" y="20">{escape(title)}</text>{bars}</svg>'


def scatter_chart(points: list[tuple[float, float, str]], title: str, width: int = 640, height: int = 480) -> str:
    """Labelled points as SVG."""
    from xml.sax.saxutils import escape

    xs, ys = [p[0] for p in points] or [0], [p[1] for p in points] or [0]
    place = lambda v, all_, size: 40 + (v - min(all_)) / ((max(all_) - min(all_)) or 1) * (size - 80)
    marks = "".join(f'<circle cx="{place(x, xs, width):.1f}" cy="{height - place(y, ys, height):.1f}" r="4"/><text x="{place(x, xs, width) + 6:.1f}" y="{height - place(y, ys, height):.1f}">{escape(n)}</text>' for x, y, n in points)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="8" y="20">{escape(title)}</text>{marks}</svg>'


def heat_chart(cells: list[tuple[int, int, float]], title: str, cell: int = 20) -> str:
    """Squares of a grid by their share of the largest value, as SVG."""
    from xml.sax.saxutils import escape

    top = max((abs(v) for _, _, v in cells), default=1) or 1
    marks = "".join(f'<rect x="{8 + cell * i}" y="{30 + cell * j}" width="{cell}" height="{cell}" fill-opacity="{abs(v) / top:.3f}"/>' for i, j, v in cells)
    size = [cell * (1 + max((c[k] for c in cells), default=0)) for k in (0, 1)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0] + 16}" height="{size[1] + 40}"><text x="8" y="20">{escape(title)}</text>{marks}</svg>'


def markdown_report(title: str, sections: dict[str, DataFrame | str], limit: int = 50) -> str:
    """A heading and each section: a text or a table's first rows."""
    parts = [f"# {title}"]
    for name, body in sections.items():
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body, limit)]
    return "\n\n".join(parts) + "\n"


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    rows = df.limit(limit).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in rows)])
