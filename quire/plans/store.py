"""The curation store's statements as pure functions from tables to tables.

Tables are DataFrames: ``document(document, stable_id)``, ``page(page, document, pagenum, l, t, w, h)``,
``annotation(annotation, document, owner, path, label, created, location, body)``,
``workflow(workflow, target_path, labelschema)``, ``labelschema(labelschema, name, json)``,
``lock(lock, document, holder, path, status)``, ``corpuspath(pathid, path)``,
``pathentry(document, pathid)``, ``person(person, email)``. A statement that changes a table returns
its next state; one writer at a time is assumed, as Spark tables have no row locks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import path_matches, under_path

AVAILABLE, LOCKED, COMPLETED = "Available", "Locked", "Completed"
STATUSES = (AVAILABLE, LOCKED, COMPLETED)


# --- generic relations ------------------------------------------------------------------


def unique(df: DataFrame, condition: Column) -> DataFrame:
    """The one row that satisfies a condition; none or several are an error when the result is read."""
    found = df.filter(condition)
    n = found.agg(F.count("*").alias("__n"))
    return found.crossJoin(n).filter(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.concat(F.lit("rows found: "), F.col("__n"))))).drop("__n")


def option(df: DataFrame, condition: Column, order: Sequence[str | Column]) -> DataFrame:
    """The first such row in order, or none."""
    return df.filter(condition).orderBy(*order).limit(1)


def inserted(df: DataFrame, rows: DataFrame, key: str, unique_on: Sequence[str]) -> DataFrame:
    """Rows appended with keys that follow the largest, in the order of the unique columns; a row that is there already is left out."""
    new = rows.dropDuplicates(list(unique_on)).join(df.select(*unique_on), list(unique_on), "left_anti")
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    numbered = numbered_rows(new, unique_on, "__i").crossJoin(F.broadcast(top)).withColumn(key, (F.col("__top") + F.col("__i")).cast(dict(df.dtypes)[key]))
    return df.unionByName(numbered.select(*df.columns))


def numbered_rows(df: DataFrame, order: Sequence[str], to: str) -> DataFrame:
    """Numbers from 1 in a total order. Rows are range-sorted; a partition's first number follows from the counts of those before it, one row each, so no task holds all rows."""
    from quire import runtime

    placed = runtime.written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).select("__part", "__before")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return placed.join(F.broadcast(before), "__part").withColumn(to, within + F.col("__before")).drop("__part", "__before")


def updated(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    for name, value in values.items():
        df = df.withColumn(name, F.when(condition, value).otherwise(F.col(name)))
    return df


def deleted(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that break a unique constraint."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key; a null reference doesn't."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


# --- documents and pages ----------------------------------------------------------------


def pages_of(document: DataFrame, page: DataFrame, stable_id: Column | str | None = None) -> DataFrame:
    """Pages with their document's stable id, in page order."""
    docs = document if stable_id is None else document.filter(F.col("stable_id") == stable_id)
    return page.join(docs, "document").orderBy("stable_id", "pagenum")


def page_by(page: DataFrame, document_id: int, pagenum: int) -> DataFrame:
    return page.filter((F.col("document") == document_id) & (F.col("pagenum") == pagenum))


def with_geometry(page: DataFrame, changes: DataFrame) -> DataFrame:
    """Pages with new boxes (``page, l, t, w, h``)."""
    new = changes.select("page", *[F.col(c).alias(f"__{c}") for c in "ltwh"])
    joined = page.join(new, "page", "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in "ltwh" and len(c) == 1 else F.col(c) for c in page.columns])


def documents(document: DataFrame, take: int = 0, skip: int = 0) -> DataFrame:
    """``take`` (0: all) documents after ``skip``, by key."""
    df = document.orderBy("document")
    df = df.offset(skip) if skip else df
    return df.limit(take) if take else df


def has_label(document: DataFrame, annotation: DataFrame, label: str) -> DataFrame:
    return document.join(annotation.filter(F.col("label") == label), "document", "left_semi")


# --- annotations ------------------------------------------------------------------------


def annotations(annotation: DataFrame, path: str | None = None, owner: int | None = None, document: int | None = None) -> DataFrame:
    """By path query, owner and document, as far as given."""
    df = annotation
    if path is not None:
        df = df.filter(path_matches(F.col("path"), path))
    if owner is not None:
        df = df.filter(F.col("owner") == owner)
    return df if document is None else df.filter(F.col("document") == document)


def replaced(annotation: DataFrame, new: DataFrame, owner: Column) -> DataFrame:
    """Annotations of one kind (``owner`` condition) of the documents in ``new`` give way to the new ones."""
    docs = new.select("document").distinct()
    gone = annotation.filter(owner).join(docs, "document", "left_semi").select("annotation")
    return inserted(annotation.join(gone, "annotation", "left_anti"), new, "annotation", ["document", "path", "label", "location"])


def regions(annotation: DataFrame) -> DataFrame:
    """The page regions of annotations' JSON locations: a row each."""
    schema = "Zone struct<regions:array<struct<page:struct<stableId:string,pageNum:int>,bbox:array<int>>>>"
    zone = F.from_json("location", schema)
    return annotation.select("annotation", F.posexplode(zone["Zone"]["regions"]).alias("ord", "r")).select("annotation", "ord", F.col("r.page.stableId").alias("stable_id"), F.col("r.page.pageNum").alias("pagenum"), *[F.col("r.bbox")[i].alias(c) for i, c in enumerate("ltwh")])


# --- locks and workflows ----------------------------------------------------------------


def acquired(lock: DataFrame, user: int, path: str) -> DataFrame:
    """The locks after a user asks for one on a path: the lowest available one of a document they never had on that path, unless they hold any lock."""
    mine = lock.filter(F.col("holder") == user)
    had = mine.filter(F.col("path") == path).select("document")
    held = mine.filter(F.col("status") == LOCKED).agg(F.count("*").alias("__held"))
    free = lock.filter((F.col("path") == path) & (F.col("status") == AVAILABLE)).join(had, "document", "left_anti")
    chosen = free.agg(F.min("lock").alias("__lock")).crossJoin(held).select(F.when(F.col("__held") == 0, F.col("__lock")).alias("__lock"))
    hit = F.col("lock") == F.col("__lock")
    return updated(lock.crossJoin(F.broadcast(chosen)), hit, status=F.lit(LOCKED), holder=F.lit(user)).drop("__lock")


def released(lock: DataFrame, lock_id: int) -> DataFrame:
    """Completed; the holder stays known."""
    return updated(lock, F.col("lock") == lock_id, status=F.lit(COMPLETED))


def created_locks(lock: DataFrame, documents_: DataFrame, path: str, each: int = 1) -> DataFrame:
    """``each`` available locks more for each document."""
    new = documents_.select("document").withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(each))))
    numbered = numbered_rows(new, ["document", "__k"], "__i")
    top = lock.agg(F.coalesce(F.max("lock"), F.lit(0)).alias("__top"))
    kinds = dict(lock.dtypes)
    rows = numbered.crossJoin(F.broadcast(top)).select((F.col("__top") + F.col("__i")).cast(kinds["lock"]).alias("lock"), "document", F.lit(None).cast(kinds["holder"]).alias("holder"), F.lit(path).alias("path"), F.lit(AVAILABLE).alias("status"))
    return lock.unionByName(rows)


def status_report(lock: DataFrame, workflow: DataFrame, workflow_id: str) -> DataFrame:
    """Locks on the workflow's path by status, 0 where there is none."""
    dim = lock.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    on_path = lock.join(F.broadcast(workflow.filter(F.col("workflow") == workflow_id)), F.col("path") == F.col("target_path"), "left_semi")
    return F.broadcast(dim).join(on_path.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def assignee_report(lock: DataFrame, person: DataFrame, path: str) -> DataFrame:
    held = lock.filter((F.col("path") == path) & F.col("holder").isNotNull())
    return held.join(person, F.col("holder") == F.col("person")).groupBy("person", "email", "status").agg(F.count("lock").alias("n"))


def workflows_of(lock: DataFrame, workflow: DataFrame, document: int) -> DataFrame:
    """A document's locks with the workflows of their paths."""
    return lock.filter(F.col("document") == document).join(workflow, F.col("path") == F.col("target_path"))


def next_assignment(lock: DataFrame, user: int, path: str) -> tuple[DataFrame, DataFrame]:
    """The locks after, and the lock that a user holds then: the one held already, or a new one."""
    after = acquired(lock, user, path)
    return after, after.filter((F.col("holder") == user) & (F.col("status") == LOCKED))


# --- directories ------------------------------------------------------------------------


def made_directory(corpuspath: DataFrame, path: str) -> DataFrame:
    new = corpuspath.sparkSession.createDataFrame([(path,)], "path string")
    return inserted(corpuspath, new, "pathid", ["path"])


def removed_directory(corpuspath: DataFrame, path: str) -> DataFrame:
    """Without the path and what is below it."""
    return deleted(corpuspath, under_path(F.col("path"), path))


def entries(corpuspath: DataFrame, pathentry: DataFrame, document: DataFrame, path: str) -> DataFrame:
    return pathentry.join(F.broadcast(corpuspath.filter(F.col("path") == path)), "pathid").join(document, "document").select("path", "document", "stable_id")


def moved_entry(corpuspath: DataFrame, pathentry: DataFrame, document: int, path: str) -> DataFrame:
    """The document's entry is under ``path``, whether it had one before; an unknown path is an error when the result is read."""
    target = unique(corpuspath, F.col("path") == path).select(F.lit(document).cast(dict(pathentry.dtypes)["document"]).alias("document"), "pathid")
    return deleted(pathentry, F.col("document") == document).unionByName(target.select(*pathentry.columns))


def ranked(df: DataFrame, key: Sequence[str], rank: str = "rank", tie: Sequence[str] = ()) -> DataFrame:
    """Contiguous ranks from 0 within each key, in the order of the old ones; as after any insert or delete."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(rank, *tie)) - 1)


def rank_inserted(df: DataFrame, row: DataFrame, key: Sequence[str], at: int, rank: str = "rank") -> DataFrame:
    """A row put in at a rank; those from there on move up."""
    moved = df.join(row.select(*key), list(key), "left_semi").withColumn(rank, F.when(F.col(rank) >= at, F.col(rank) + 1).otherwise(F.col(rank)))
    rest = df.join(row.select(*key), list(key), "left_anti")
    return rest.unionByName(moved).unionByName(row.withColumn(rank, F.lit(at).cast(dict(df.dtypes)[rank])).select(*df.columns))
