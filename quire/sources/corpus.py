"""Corpora of document folders: scan, artifacts, input modes, imports and exports."""

from __future__ import annotations

import os
import shutil
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import path_filter

SENTINEL = ".corpus-root"
BATCH = 200


# --- folders ----------------------------------------------------------------------------


def init_corpus(root: str) -> list[str]:
    """Marks a folder as a corpus and moves each ``x.pdf`` or ``x.ps`` into ``x.pdf.d/``; may be run again. The entries made."""
    os.makedirs(root, exist_ok=True)
    open(os.path.join(root, SENTINEL), "a").close()
    made = []
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        if os.path.isfile(path) and name.endswith((".pdf", ".ps")):
            os.makedirs(f"{path}.d", exist_ok=True)
            shutil.move(path, os.path.join(f"{path}.d", name))
            made.append(f"{name}.d")
    return made


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """``entry`` (folder ending in ``.d``), ``artifact`` and size of the files of a corpus, at any depth."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_extract("path", r"([^/]+\.d)/([^/].*)$", 1)
    cols = [path.alias("entry"), F.regexp_extract("path", r"([^/]+\.d)/([^/].*)$", 2).alias("artifact"), F.col("length").alias("n_bytes"), "path"]
    return df.select(*cols, *(["content"] if content else [])).filter("entry <> ''")


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries that have any artifact, sorted."""
    return files(spark, root).select("entry").distinct().orderBy("entry")


def artifact(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One artifact's text of every entry that has it."""
    return files(spark, root, name, content=True).select("entry", F.decode("content", "utf-8").alias("text"))


def latest(df: DataFrame, name: str) -> DataFrame:
    """The newest stash of an artifact, ``name-<time>``, by entry."""
    stashes = df.filter(F.col("artifact").startswith(f"{name}-"))
    return stashes.groupBy("entry").agg(F.max_by("path", "artifact").alias("path"))


def put_artifacts(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Artifacts (``entry, artifact, text``) as a table by artifact name; without ``overwrite`` what is there stays."""
    df.write.partitionBy("artifact").mode("overwrite" if overwrite else "ignore").parquet(path)


def unprocessed(df: DataFrame, outputs: DataFrame, key: str = "entry", redo: bool = False) -> DataFrame:
    """Rows without output; all if outputs are to be made again."""
    return df if redo else df.join(outputs.select(key), key, "left_anti")


def processed(df: DataFrame, outputs: DataFrame, key: str = "entry") -> DataFrame:
    return df.join(outputs.select(key), key, "left_semi")


# --- pipeline rows ----------------------------------------------------------------------


def chosen(df: DataFrame, regex: str, column: str = "entry") -> DataFrame:
    return df.filter(path_filter(F.col(column), regex))


def skip_and_run(df: DataFrame, order: Sequence[str | Column], run: int, skip: int) -> DataFrame:
    """Marks the first ``skip`` rows ``skip``, the next ``run`` (0: all) ``run``, the rest ``skip``."""
    from quire.plans.store import numbered_rows

    numbered = numbered_rows(df, order, "__n")
    on = (F.col("__n") > skip) & (F.lit(run == 0) | (F.col("__n") <= skip + run))
    return numbered.withColumn("status", F.when(on, "run").otherwise("skip")).drop("__n")


def attempted(df: DataFrame, name: str, value: Column, ok: Column, message: Column) -> DataFrame:
    """A step's result, or the message why there is none; rows go on either way."""
    return df.withColumn(name, F.when(ok, value)).withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), message))


def inputs(spark: SparkSession, mode: str, path: str) -> DataFrame:
    """Paths of an input mode: ``file``, ``list`` (a file of paths), ``corpus`` (a root) or ``entry``."""
    if mode in ("file", "entry"):
        return spark.createDataFrame([(path,)], "path string")
    if mode == "list":
        return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")
    if mode == "corpus":
        return files(spark, path).select("path")
    raise ValueError(f"input mode {mode!r}; there are file, list, corpus and entry")


# --- JSON in and out --------------------------------------------------------------------


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of text grids: ``description`` and a row for each page with its box and grid JSON."""
    schema = "description string, pages array<struct<pageGeometry:array<int>,textgrid:string>>"
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return docs.select("description", F.posexplode("pages").alias("page", "p")).select("description", "page", *[F.col("p.pageGeometry")[i].alias(c) for i, c in enumerate("ltwh")], F.col("p.textgrid").alias("json"))


def write_textgrids(grids: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents (``description, page, l, t, w, h, json``) as one JSON object each; a folder that is there stays unless overwritten."""
    page = F.struct("page", F.array("l", "t", "w", "h").alias("pageGeometry"), F.col("json").alias("textgrid"))
    pages = F.transform(F.sort_array(F.collect_list(page)), lambda p: F.struct(p["pageGeometry"].alias("pageGeometry"), p["textgrid"].alias("textgrid")))
    docs = grids.groupBy("description").agg(pages.alias("pages"))
    docs.write.mode("overwrite" if overwrite else "ignore").json(path)


def read_zones(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages and labelled zones of the older format: page boxes, and a row for each zone's box and label."""
    schema = "pageGeometries array<struct<id:int,bounds:array<double>>>, zones array<struct<id:int,bboxes:array<struct<id:int,target:int,bbox:array<double>>>>>, labels array<struct<zoneId:int,label:struct<ns:string,key:string,value:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    exact = lambda c, i: (c[i] * 100).cast("int")
    pages = raw.select("file", F.explode("pageGeometries").alias("p")).select("file", F.col("p.id").alias("page"), *[exact(F.col("p.bounds"), i).alias(c) for i, c in enumerate("ltwh")])
    boxes = raw.select("file", F.explode("zones").alias("z")).select("file", F.col("z.id").alias("zone"), F.posexplode("z.bboxes").alias("ord", "b")).select("file", "zone", "ord", F.col("b.target").alias("page"), *[exact(F.col("b.bbox"), i).alias(c) for i, c in enumerate("ltwh")])
    labels = raw.select("file", F.explode("labels").alias("x")).select("file", F.col("x.zoneId").alias("zone"), F.concat_ws(":", "x.label.ns", "x.label.key").alias("label"), F.col("x.label.value").alias("value"))
    return pages, boxes.join(labels, ["file", "zone"])


def new_documents(zones: DataFrame, document: DataFrame, stable_id: str = "file") -> DataFrame:
    """Documents that an import brings and the store lacks."""
    return zones.select(F.col(stable_id).alias("stable_id")).distinct().join(document.select("stable_id"), "stable_id", "left_anti")


def preprint_entries(df: DataFrame, doi: str = "doi") -> DataFrame:
    """Corpus entries of preprints: the last two parts of the DOI, joined by a dash."""
    parts = F.split(doi, "/")
    return df.withColumn("entry", F.concat(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "-"), F.lit(".d")))


def jdbc_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table, read in key ranges if they are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def exported_annotations(annotation: DataFrame, document: DataFrame, batch: int = BATCH) -> DataFrame:
    """A JSON text for each document's annotations, and the number of its batch of documents."""
    from quire.plans.store import numbered_rows

    item = F.struct("annotation", "owner", "path", F.unix_millis("created").alias("created"), "label", "location", "body")
    docs = annotation.join(document, "document").groupBy("document", "stable_id").agg(F.to_json(F.struct(F.first("stable_id").alias("stableId"), F.sort_array(F.collect_list(item)).alias("annotations"))).alias("json"))
    return numbered_rows(docs, ["document"], "n").withColumn("batch", F.floor((F.col("n") - 1) / batch).cast("int")).drop("n")


def font_descriptions(glyphs: DataFrame) -> DataFrame:
    """Each document's fonts as JSON: name, and how many glyphs on which page."""
    pages = glyphs.groupBy("doc_id", "font", "page").agg(F.count("*").alias("count"))
    fonts = pages.groupBy("doc_id", "font").agg(F.sort_array(F.collect_list(F.struct("page", "count"))).alias("glyphsPerPage"))
    return fonts.groupBy("doc_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("font").alias("name"), "glyphsPerPage"))).alias("fonts"))).alias("json"))


def trace_log(rows: DataFrame, kind: str, body: Column, page: str = "page", name: str = "") -> DataFrame:
    """Entries of a trace: page, kind, JSON body and headers."""
    return rows.select(F.col(page).alias("page"), F.lit(kind).alias("logType"), F.to_json(body).alias("body"), F.to_json(F.struct(F.lit(name).alias("name"), F.current_timestamp().alias("timestamp"))).alias("headers"))


def conll(tokens: DataFrame, keys: Sequence[str], order: str = "pos", token: str = "token", tag: str = "tag") -> DataFrame:
    """Token and tag a line, one text for each key."""
    rows = F.sort_array(F.collect_list(F.struct(order, F.concat_ws("\t", token, tag).alias("x"))))
    return tokens.groupBy(*keys).agg(F.array_join(F.transform(rows, lambda r: r["x"]), "\n").alias("conll"))


def with_ids(rows: DataFrame, order: Sequence[str], key: str, after: int = 0) -> DataFrame:
    """Rows with new keys, and so the translation of their old ones."""
    from quire.plans.store import numbered_rows

    return numbered_rows(rows, order, key).withColumn(key, F.col(key) + after)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")
