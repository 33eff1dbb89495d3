"""Sources and sinks: JSON, JSON lines, DOCX, nested passages, GraphML, node-link graphs, parquet indexes."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = T.StructType([T.StructField("idx", T.LongType()), T.StructField("title", T.StringType()), T.StructField("paragraph_text", T.StringType()), T.StructField("is_supporting", T.BooleanType())])
ITEM_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("paragraphs", T.ArrayType(PASSAGE)), T.StructField("_corrupt", T.StringType())])
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Files that each hold one JSON object or an array of objects."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, corrupt: str = "_corrupt") -> DataFrame:
    """JSON lines; a line that is no JSON stands whole in the column `corrupt` if the schema has it."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
    return (reader.schema(schema) if schema else reader).json(path)


def _docx_text(content: pd.Series) -> pd.Series:
    def text(data):
        if data is None:
            return None
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))

    return content.map(text)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text: the paragraphs of each .docx file, one per line; null for a file that is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.pandas_udf(_docx_text, T.StringType())("content").alias("text"))


def read_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reads by the ending of the path: .json, .jsonl or .docx; any other is an error."""
    readers = {".json": read_json, ".jsonl": read_jsonl}
    ending = path[path.rfind(".") :].lower() if "." in path else ""
    if ending == ".docx":
        return read_docx(spark, path)
    if ending not in readers:
        raise ValueError(f"no reader for {path}")
    return readers[ending](spark, path, schema)


def list_files(spark: SparkSession, directory: str, endings: list[str]) -> DataFrame:
    """path, length, modified of the files with one of the endings, in the order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(endings) + "}").load(directory)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def passage_rows(items: DataFrame) -> DataFrame:
    """item_id, idx, title, paragraph_text, is_supporting: one row per passage of nested items. A passage without idx
    gets its place; items without passages give no rows, rows that are no JSON neither."""
    return items.where("id IS NOT NULL").select(F.col("id").alias("item_id"), F.posexplode("paragraphs").alias("place", "p")).select(
        "item_id", F.coalesce("p.idx", F.col("place").cast("bigint")).alias("idx"), "p.title", "p.paragraph_text", "p.is_supporting"
    )


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines; null fields are left out."""
    df.write.mode(mode).json(path)


def graphml_lines(nodes: DataFrame, edges: DataFrame, attributes: dict[str, str] | None = None) -> DataFrame:
    """n, line: a GraphML document, header first, then nodes, edges and the footer. nodes: id and attributes; edges: src,
    dst and attributes. Nulls are left out, booleans are lower case, arrays and structs are written as JSON. Order by n."""

    def data(df: DataFrame, skip: list[str]):
        parts = [F.lit("")]
        for f in df.schema:
            if f.name not in skip:
                plain = F.col(f.name).cast("string") if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.to_json(f.name)
                parts.append(F.when(plain.isNotNull(), F.concat(F.lit(f'<data key="{f.name}">'), _xml(plain), F.lit("</data>"))).otherwise(F.lit("")))
        return F.concat(*parts)

    keys = [(f.name, "node") for f in nodes.schema if f.name != "id"] + [(f.name, "edge") for f in edges.schema if f.name not in ("src", "dst")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    head += [f'<key id="{k}" for="{w}" attr.name="{k}" attr.type="string"/>' for k, w in keys]
    head += ['<graph edgedefault="directed">', *[f'<data key="{k}">{v}</data>' for k, v in (attributes or {}).items()]]
    spark = nodes.sparkSession
    n = nodes.select(F.lit(1).alias("n"), F.concat(F.lit('<node id="'), _xml(F.col("id").cast("string")), F.lit('">'), data(nodes, ["id"]), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("n"), F.concat(F.lit('<edge source="'), _xml(F.col("src").cast("string")), F.lit('" target="'), _xml(F.col("dst").cast("string")), F.lit('">'), data(edges, ["src", "dst"]), F.lit("</edge>")).alias("line"))
    first = spark.createDataFrame([(0, "\n".join(head))], "n int, line string")
    last = spark.createDataFrame([(3, "</graph>\n</graphml>")], "n int, line string")
    return first.unionByName(n).unionByName(e).unionByName(last)


def _xml(c):
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, attributes: dict[str, str] | None = None) -> None:
    """GraphML as text files that make the document when read in the order of their names."""
    graphml_lines(nodes, edges, attributes).repartitionByRange("n").sortWithinPartitions("n").select("line").write.text(path)


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON document with `nodes` and `links`."""
    doc = read_json(spark, path)
    nodes = doc.select(F.explode("nodes").alias("n")).select("n.*")
    links = doc.select(F.explode("links").alias("l")).select("l.*")
    return nodes, links


def write_index(df: DataFrame, path: str, by: str, meta: dict[str, str]) -> None:
    """An index as parquet, partitioned by `by`, with a table of its properties beside it."""
    df.write.partitionBy(by).parquet(f"{path}/data")
    df.sparkSession.createDataFrame(sorted(meta.items()), "name string, value string").coalesce(1).write.parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The index and its properties."""
    return spark.read.parquet(f"{path}/data"), {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/meta").collect()}
