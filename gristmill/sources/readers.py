"""Readers and writers of corpora: Markdown folders, JSON lines of documents and conversations, token tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.documents import DataQualityError

_BOM = "﻿"


def _qualified(spark: SparkSession, folder: str) -> tuple[str, bool]:
    """A folder's whole name, as files in it are named, and whether it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return store.makeQualified(path).toString(), store.exists(path)


def _below(spark: SparkSession, folders: list[str], path: Column) -> Column:
    """The path of a file below whichever of the folders holds it; else its name."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    slim = lambda c: F.regexp_replace(c, r"^(\w+):/+", "$1:/")
    rest = F.element_at(F.split(plain, "/"), -1)
    # of nested folders the outermost counts
    for base in sorted((_qualified(spark, f)[0].rstrip("/") + "/" for f in folders), key=len, reverse=True):
        inside = F.startswith(slim(plain), slim(F.lit(base)))
        rest = F.when(inside, F.substr(slim(plain), F.length(slim(F.lit(base))) + 1)).otherwise(rest)
    return rest


def markdown(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """(source, path, text): a document for each ``.md`` file; the source is its path below the given folder."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select(_below(spark, paths, F.col("path")).alias("source"), "path", F.regexp_replace("text", f"^{_BOM}", "").alias("text"))


def corpus(spark: SparkSession, folder: str, below: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(document_id, text, source, explicit_split, fields) of a folder: its Markdown files and those of the folders ``below`` it, but for the sources ``without``, and the rows of its JSON lines.

    A source is a path below the folder, so files of one name in different folders are told apart. Nothing to read is an error.
    """
    folder = folder.rstrip("/")
    found = [f for f in (folder, *(f"{folder}/{b}" for b in below or [])) if _qualified(spark, f)[1]]
    if not found:
        raise DataQualityError(f"there is no folder {folder}")
    notes = spark.read.text(found, wholetext=True, pathGlobFilter="*.md").select(_below(spark, [folder], F.col("_metadata.file_path")).alias("source"), F.regexp_replace("value", f"^{_BOM}", "").alias("text"))
    notes = notes.where(~F.col("source").isin(*(without or [""])))
    none = F.lit(None).cast("string")
    notes = notes.select(none.alias("document_id"), "text", "source", none.alias("explicit_split"), F.create_map().cast("map<string,string>").alias("fields"))
    if spark.read.format("binaryFile").load(folder, pathGlobFilter="*.jsonl").select("path").limit(1).count():
        return notes.unionByName(documents(spark, folder, glob="*.jsonl"))
    if not notes.select("source").limit(1).count():
        raise DataQualityError(f"no Markdown and no JSON lines in {folder}")
    return notes


def json_lines(spark: SparkSession, paths: list[str] | str, required: list[str], optional: list[str] | None = None, lenient: bool = False) -> DataFrame:
    """Rows of JSON objects, one to a line, all columns strings; blank lines are passed over.

    A line that is no object, or lacks a required non-blank string, is an error
    that names file and line text; ``lenient`` leaves it out instead.
    """
    names = [*required, *(optional or [])]
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", f"^{_BOM}", "").alias("line")).where(T.strip(F.col("line")) != "")
    parsed = lines.withColumn("row", F.from_json("line", ", ".join(f"`{n}` string" for n in names) + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("row._bad").isNull() & F.col("row").isNotNull()
    for n in required:
        good &= T.strip(F.coalesce(F.col(f"row.{n}"), F.lit(""))) != ""
    if lenient:
        parsed = parsed.where(good)
    else:
        parsed = parsed.withColumn("row", F.when(good, F.col("row")).otherwise(F.raise_error(F.concat(F.lit("bad line in "), "file", F.lit(": "), F.substring("line", 1, 80)))))
    return parsed.select("file", *[F.col(f"row.{n}").alias(n) for n in names])


def conversations(spark: SparkSession, paths: list[str] | str, lenient: bool = False) -> DataFrame:
    """Supervised rows (user, assistant and optional fields) with ``text`` in chat form."""
    from ..operators.conversations import conversation_text

    rows = json_lines(spark, paths, ["user", "assistant"], ["system", "category", "source", "license", "note", "id", "split"], lenient)
    return rows.withColumn("text", conversation_text(F.col("system"), F.col("user"), F.col("assistant")))


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """One canonical JSON object a line, keys sorted, in a stated order; never over an existing folder."""
    parts = {c: F.coalesce(T.json_string(F.col(c).cast("string")), F.lit("null")) for c in df.columns}
    df.select(*order, T.json_object(**parts).alias("value")).orderBy(*order).select("value").write.mode("errorifexists").text(path)


def write_tokens(df: DataFrame, path: str) -> None:
    """Token arrays by split."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_tokens(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split's token arrays; the filter prunes the folder's partitions."""
    return spark.read.parquet(path).where(F.col("split") == split)


def documents(spark: SparkSession, paths: list[str] | str, conversation: bool = False, glob: str | None = None) -> DataFrame:
    """Documents of JSON lines: (document_id, text, source, explicit_split, fields).

    A row's text is its ``text`` or, without one (or with ``conversation``), made of system, user and assistant in chat
    form; where it has any of these, they are its fields. The source is the row's own or the file's name. A
    line that is no such object is an error that names file and line; so is a table without rows.
    """
    from ..operators.conversations import conversation_text

    names = ["text", "source", "id", "split", "system", "user", "assistant"]
    lines = spark.read.text(paths, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split(F.regexp_replace("value", f"^{_BOM}", ""), r"\r\n?|\n", -1)).alias("at", "line"))
    lines = lines.where(T.strip(F.col("line")) != "")
    row = F.from_json("line", ", ".join(f"`{n}` string" for n in names) + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("row", row)
    c = lambda n: F.col(f"row.{n}")
    filled = lambda n: T.strip(F.coalesce(c(n), F.lit(""))) != ""
    talk = filled("user") & filled("assistant")
    some = c("user").isNotNull() | c("assistant").isNotNull() | c("system").isNotNull()
    needs_talk = F.lit(conversation) | c("text").isNull()
    good = c("_bad").isNull() & F.col("line").rlike(r"^\s*\{") & F.when(needs_talk | some, talk).otherwise(filled("text"))
    fault = F.raise_error(F.concat(F.lit("bad record in "), "file", F.lit(":"), (F.col("at") + 1).cast("string")))
    text = F.when(~F.coalesce(good, F.lit(False)), fault).when(needs_talk, conversation_text(c("system"), c("user"), c("assistant"))).otherwise(c("text"))
    fields = F.map_filter(F.create_map(*[x for n in ("system", "user", "assistant") for x in (F.lit(n), c(n))]), lambda _, v: v.isNotNull())
    found = parsed.select(c("id").alias("document_id"), text.alias("text"), F.coalesce(c("source"), F.col("file")).alias("source"), c("split").alias("explicit_split"), F.when(some, fields).otherwise(F.create_map().cast("map<string,string>")).alias("fields"))
    if not lines.limit(1).count():
        raise DataQualityError("no records")
    return found


def category_rows(spark: SparkSession, paths: list[str] | str, categories: list[str]) -> DataFrame:
    """Rows (user, assistant, category), trimmed, of JSON lines; a category that isn't listed is an error."""
    rows = json_lines(spark, paths, ["user", "assistant", "category"])
    known = T.strip(F.col("category")).isin(categories)
    category = F.when(known, T.strip(F.col("category"))).otherwise(F.raise_error(F.concat(F.lit("unknown category in "), "file", F.lit(": "), "category")))
    return rows.select(T.strip(F.col("user")).alias("user"), T.strip(F.col("assistant")).alias("assistant"), category.alias("category"))


def curated_core(spark: SparkSession, path: str) -> DataFrame:
    """Pairs (user, assistant) of a file whose every line is one: a blank line is an error, and so is an empty file."""
    lines = spark.read.text(path)
    if not lines.limit(1).count():
        raise DataQualityError("the core is empty")
    if lines.where(T.strip(F.col("value")) == "").limit(1).count():
        raise DataQualityError("the core has a blank line")
    return json_lines(spark, path, ["user", "assistant"]).select("user", "assistant")


def joined_corpus(docs: DataFrame, by: list[str], key: str = "source", headed: bool = False) -> DataFrame:
    """(by, text): the stripped texts of each group in order of ``key``, blank ones left out, with a blank line between; with ``headed`` each under its key. A group is one text, its feature."""
    text = T.strip(F.coalesce(F.col("text"), F.lit("")))
    shown = F.concat(F.lit("# "), F.col(key).cast("string"), F.lit("\n\n"), text) if headed else text
    return docs.where(text != "").groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), shown.alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))


def rows_from_table(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    """Authored rows, the caller's own, as a table of strings; a row of another width, or a blank value, is an error."""
    for i, row in enumerate(rows):
        if len(row) != len(columns) or not all(isinstance(v, str) and v.strip() for v in row):
            raise DataQualityError(f"row {i + 1} of the table is incomplete")
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def synthetic(spark: SparkSession, banks: list[list[str]], glue: str = " ") -> DataFrame:
    """(i, text): every combination of one phrase of each bank, joined; the last bank varies fastest. Row i is worked out from its number, so nothing is joined."""
    return spark.range(math.prod(map(len, banks))).select(F.col("id").alias("i"), combination(F.col("id"), banks, glue).alias("text"))


def combination(i: Column, banks: list[list[str]], glue: str = " ") -> Column:
    """The combination of number ``i``, which begin anew after the last."""
    parts, below = [], math.prod(map(len, banks))
    i = F.pmod(i, F.lit(below))
    for bank in banks:
        below //= len(bank)
        parts.append(F.element_at(F.array(*map(F.lit, bank)), (F.floor(i / below) % len(bank) + 1).cast("int")))
    return F.concat_ws(glue, *parts)


def first_existing(preferred: list[str], present: DataFrame, by: list[str]) -> DataFrame:
    """(by, path): the first of the preferred paths that a group of ``present`` (by, path) has; groups without any are left out."""
    rank = F.lit(None)
    for i, path in reversed(list(enumerate(preferred))):
        rank = F.when(F.col("path") == path, i).otherwise(rank)
    return present.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy(*by).agg(F.min_by("path", "_rank").alias("path"))


#: Kinds of sources that can be imported: how their rows become pairs. One that only may be listed has none.
IMPORTS = {"instructions": "instruction_pairs", "messages": "message_pairs", "listed": None}


def imported(rows: DataFrame, kind: str, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The pairs of an import source, the first ``limit`` in order if one is given. An unknown source is an error, and so is one that may not be converted."""
    from ..operators import conversations as C

    if kind not in IMPORTS:
        raise DataQualityError(f"unknown source {kind}")
    if IMPORTS[kind] is None:
        raise DataQualityError(f"{kind} rows are listed only and can't be converted")
    pairs = getattr(C, IMPORTS[kind])(rows)
    if limit is None:
        return pairs
    if not order:
        raise ValueError("a limit needs an order")
    return pairs.orderBy(*order).limit(limit)
