"""Files of postings and of links, in whatever layout they come."""

from __future__ import annotations

import csv
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def read_xml_board(spark: SparkSession, path: str, row: str = "position") -> DataFrame:
    """The repeated elements of XML boards, one row each; fields by child element."""
    return spark.read.format("xml").option("rowTag", row).load(path)


def read_json_board(spark: SparkSession, path: str, inside: str | None = None) -> DataFrame:
    """JSON boards: an array at the top, or the array in member ``inside``."""
    df = spark.read.option("multiLine", "true").json(path)
    return df.select(F.explode(inside).alias("r")).select("r.*") if inside else df


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """A list file as strings: CSV with any delimiter and with or without header, TSV, JSON, JSON lines or plain text.

    Layout is guessed from the suffix and the first lines; the rows themselves are read by the tasks.
    """
    low = path.lower()
    if low.endswith((".jsonl", ".ndjson")):
        return spark.read.json(path)
    if low.endswith(".json"):
        first = next((r.value.strip()[0] for r in spark.read.text(path).where("trim(value) <> ''").limit(1).collect()), "[")
        whole = read_json_board(spark, path)
        # an object at the top holds its rows in its first member that is a list of objects
        lists = [f.name for f in whole.schema if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)]
        return read_json_board(spark, path, lists[0]) if first == "{" and lists else whole
    if low.endswith((".csv", ".tsv")):
        head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())
        try:
            sep = csv.Sniffer().sniff(head, ",;\t|").delimiter
        except csv.Error:
            sep = "\t" if low.endswith(".tsv") else ","
        first = head.split("\n", 1)[0].split(sep)
        titled = not any("://" in c or c.strip().isdigit() for c in first)
        return spark.read.option("sep", sep).option("header", str(titled).lower()).csv(path)
    return spark.read.text(path)


def link_column(rows: DataFrame, sample: int = 200) -> str | None:
    """The column with the most URLs among the first ``sample`` rows; null if no column has one."""
    cols = [c for c, t in rows.dtypes if t == "string"]
    if not cols:
        return None
    n = rows.limit(sample).agg(*[F.count_if(F.col(f"`{c}`").rlike(r"^(https?://|www\.)")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    best = max(range(len(cols)), key=lambda i: n[i])
    return cols[best] if n[best] else None


def boards_in_toml(text: str) -> list[tuple[str, str]]:
    """(source, board) of a TOML text of lists of boards by source: blanks trimmed, empty and repeated ones left out, order kept."""
    out: dict[tuple[str, str], None] = {}
    for source, boards in tomllib.loads(text).items():
        if not isinstance(boards, list) or not all(isinstance(b, str) for b in boards):
            raise ValueError(f"{source} is no list of texts")
        out |= {(source, b.strip()): None for b in boards if b.strip()}
    return list(out)


def read_links(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, link, rest`` of list files in whatever layout: the column with most links, and the other short texts as a map.

    Each file is read by the tasks; rows without a link are left out, files without any give no row.
    """
    out = None
    for path in paths:
        rows = read_list(spark, path)
        link = link_column(rows)
        if link is None:
            continue
        others = [c for c, t in rows.dtypes if t == "string" and c != link]
        short = [x for c in others for x in (F.lit(c), F.when(F.length(F.col(f"`{c}`")) <= 200, F.col(f"`{c}`")))]
        rest = F.map_filter(F.create_map(*short), lambda k, v: v.isNotNull()) if short else F.create_map().cast("map<string,string>")
        part = rows.where(F.col(f"`{link}`").rlike(r"^(https?://|www\.)")).select(F.lit(path).alias("path"), F.col(f"`{link}`").alias("link"), rest.alias("rest"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "path string, link string, rest map<string,string>")
