"""Corpus readers and the JSON-lines writer.

Every reader gives ``(doc_id, text)`` with dense ids in a stated order: file
path, then position in the file. What is ranked to get there is one row per
input split or per file; the texts themselves are never sorted.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillvec.functions.text import is_blank, strip
from quillvec.operators.ids import dense_ids, running_offsets
from quillvec.session import pin
from quillvec.sources.paths import filesystem, qualified

# Up to this many documents a sorted limit is the cheapest way to the first ones.
SORTED_LIMIT = 10_000


def _is_utf8(encoding: str) -> bool:
    return encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")


def _lines(spark: SparkSession, path: str | list[str], encoding: str) -> DataFrame:
    """Lines with the input split they come from.

    The text source hands on the bytes of a line as they are, so encodings that
    write line ends as ASCII does are decoded afterwards.
    """
    value = F.col("value")
    if not _is_utf8(encoding):
        value = F.decode(value.cast("binary"), encoding)
    return spark.read.text(path).select(
        value.alias("value"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_block_length").alias("_length"),
    )


def _number_lines(kept: DataFrame) -> DataFrame:
    """Dense ``doc_id`` by file path, then position, for the lines that were kept.

    Rows of a split are consecutive in its task, so a position is the split's
    base plus the distance from its first row. The parsed lines are pinned once,
    because another evaluation may cut the files into other splits.
    """
    split = ["_file", "_start"]
    rows = pin(kept.withColumn("_row", F.monotonically_increasing_id()))
    splits = rows.groupBy(*split).agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_kept")
    )
    bases = running_offsets(splits, split, F.col("_kept"), "_base").drop("_kept")
    numbered = rows.join(bases, split)
    return numbered.select((F.col("_base") + F.col("_row") - F.col("_first")).alias("doc_id"), "text")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the input files in order; nothing of them is read."""
    found = spark.read.format("binaryFile").load(path).select("_metadata.file_path")
    return sorted(row["file_path"] for row in found.collect())


def _first_lines(spark: SparkSession, path: str, encoding: str, parse, max_docs: int) -> DataFrame:
    """``(doc_id, text)`` of the first ``max_docs`` lines that ``parse`` keeps.

    Files are taken in order, twice as many each time, until they are known to keep
    enough lines. An index of ``(file, start, length, kept)`` of the files needed and
    its running sums then place every split; texts are read from those files alone
    and stored nowhere on the way. The result is bound to those splits: should a
    session cut the files otherwise later on, it fails instead of giving other numbers.
    """
    split = ["_file", "_start", "_length"]

    def kept_by_split(files: list[str]) -> list[tuple]:
        counts = parse(_lines(spark, files, encoding)).groupBy(*split).agg(F.count(F.lit(1)))
        return sorted(tuple(row) for row in counts.collect())

    files, take, counts = _files(spark, path), 1, []
    while files:
        counts = kept_by_split(files[:take])
        if take >= len(files) or sum(n for *_, n in counts) >= max_docs:
            break
        take *= 2
    needed, base = [], 0
    for file in files[:take]:
        if base < max_docs:
            needed.append(file)
        base += sum(n for own, _, _, n in counts if own == file)
    if not needed:
        return spark.createDataFrame([], "doc_id long, text string")
    if len(needed) < min(take, len(files)):
        counts = kept_by_split(needed)  # fewer files may be cut into other splits
    index, base = [], 0
    for *place, n in counts:
        index.append((*place, base))
        base += n
    bases = spark.createDataFrame(index, "_file string, _start long, _length long, _base long")
    rows = parse(_lines(spark, needed, encoding)).withColumn("_row", F.monotonically_increasing_id())
    order = Window.partitionBy(*split).orderBy("_row")
    known = F.when(
        F.col("_base").isNull(), F.raise_error(F.lit("the input is cut into other splits now; read it again"))
    ).otherwise(F.col("_base"))
    # One row per split of the files needed.
    placed = rows.join(F.broadcast(bases), split, "left").where(known < max_docs)
    numbered = placed.select((known + F.row_number().over(order) - 1).alias("doc_id"), "text")
    return _up_to(numbered, max_docs)


def _up_to(docs: DataFrame, max_docs: int | None) -> DataFrame:
    """The first ``max_docs`` of densely numbered documents."""
    return docs if max_docs is None else docs.where(F.col("doc_id") < max_docs)


def first_docs(docs: DataFrame, max_docs: int | None) -> DataFrame:
    """The first ``max_docs`` documents in ``doc_id`` order, gaps allowed; ``None`` keeps all."""
    if max_docs is None:
        return docs
    if max_docs <= SORTED_LIMIT:
        return docs.orderBy("doc_id").limit(max_docs)
    places = dense_ids(docs.select("doc_id"), ["doc_id"], "_place")
    return docs.join(places.where(F.col("_place") < max_docs).select("doc_id"), "doc_id", "left_semi")


def _falsy(json: Column, key: str) -> Column:
    """Whether the value of ``key`` is a bare zero, ``false`` or an empty list or object."""

    def read(kind: str) -> Column:
        return F.from_json(json, f"`{key}` {kind}")[key.replace("``", "`")]

    # Strings are none of these types, so "0" and "false" in quotes stay.
    return (
        F.coalesce(~read("boolean"), F.lit(False))
        | F.coalesce(read("double") == 0, F.lit(False))
        | F.coalesce(F.size(read("array<string>")) == 0, F.lit(False))
        | F.coalesce(F.size(read("map<string, string>")) == 0, F.lit(False))
    )


def parse_jsonl(lines: DataFrame, text_key: str = "text") -> DataFrame:
    """``text`` of each JSON line.

    Lines that are blank or not one whole JSON object, that lack the key, or whose
    value is null, empty, zero or false drop out.
    """
    key = text_key.replace("`", "``")
    strict = {"allowSingleQuotes": "false"}
    line = strip(F.col("value"))
    # A parser stops at the end of the first value. In a list that must go on to
    # a mark no line knows, whatever follows an object shows.
    mark = F.md5(line.cast("binary"))
    whole = F.from_json(F.concat(F.lit("["), line, F.lit(',"'), mark, F.lit('"]')), "array<string>", strict)
    parsed = F.from_json(
        F.col("_object"),
        f"`{key}` string, _malformed string",
        {"columnNameOfCorruptRecord": "_malformed", **strict},
    )
    # Only short values can be falsy; the others are not parsed again.
    doubtful = F.col("text").rlike(r"^(-?[0.]+([eE][-+]?\d+)?|false|\[\s*\]|\{\s*\})$")
    return (
        lines.withColumn("_list", whole)
        .where((F.size("_list") == 2) & (F.element_at("_list", -1) == mark))
        .withColumn("_object", F.element_at("_list", 1))
        .withColumn("_json", parsed)
        .where(F.col("_json._malformed").isNull() & (F.length(F.col("_json")[text_key]) > 0))
        .withColumn("text", F.col("_json")[text_key])
        .where(~F.when(doubtful, _falsy(F.col("_object"), key)).otherwise(F.lit(False)))
        .drop("value", "_list", "_object", "_json")
    )


def parse_messages(lines: DataFrame) -> DataFrame:
    """``text`` of each line, stripped; blank lines drop out."""
    return lines.withColumn("text", strip(F.col("value"))).where(F.length("text") > 0).drop("value")


def message_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines of a text column as messages; other columns are kept, ``line`` is added."""
    lines = F.split(F.col(text_col), r"\r\n|\r|\n", -1)
    keep = [c for c in df.columns if c != text_col]
    return parse_messages(df.select(*keep, F.posexplode(lines).alias("line", "value")))


def _read_lines(
    spark: SparkSession, path: str, encoding: str, parse, max_docs: int | None
) -> DataFrame:
    if max_docs is None:
        return _number_lines(parse(_lines(spark, path, encoding)))
    return _first_lines(spark, path, encoding, parse, max_docs)


def read_jsonl(
    spark: SparkSession,
    path: str,
    text_key: str = "text",
    max_docs: int | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    def parse(lines: DataFrame) -> DataFrame:
        return parse_jsonl(lines, text_key)

    return _read_lines(spark, path, encoding, parse, max_docs)


def read_messages(
    spark: SparkSession, path: str, max_docs: int | None = None, encoding: str = "UTF-8"
) -> DataFrame:
    return _read_lines(spark, path, encoding, parse_messages, max_docs)


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ``**/`` is any folders or none, ``*`` and ``?`` stay in one."""
    out = ""
    for part in re.findall(r"\*\*/|\*|\?|\[!?[^]]+\]|.", glob):
        known = {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}.get(part)
        if known is None:
            known = part.replace("[!", "[^") if len(part) > 1 else re.escape(part)
        out += known
    return f"^{out}$"


def text_files(
    spark: SparkSession, path: str, glob: str = "**/*.txt", encoding: str = "UTF-8"
) -> DataFrame:
    """``(path, text)``: one row per readable, non-blank file below ``path`` that matches ``glob``.

    A glob without a folder holds for file names at any depth.
    """
    root = qualified(spark, path).rstrip("/")
    wanted = glob if "/" in glob else f"**/{glob}"
    below = F.substr(F.col("path"), F.lit(len(root) + 2))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob.rpartition("/")[2])
        .option("ignoreCorruptFiles", "true")
        .load(root)
        .where(below.rlike(glob_pattern(wanted)))
        .select("path", "content")
    )
    if _is_utf8(encoding):
        files = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    texts = files.select("path", F.decode("content", encoding).alias("text"))
    return texts.where(~is_blank(F.col("text")))


def read_text_dir(
    spark: SparkSession,
    path: str,
    glob: str = "**/*.txt",
    max_docs: int | None = None,
    encoding: str = "UTF-8",
) -> DataFrame:
    # A directory of many small files is read once; few tasks of many files keep the rest cheap.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = pin(text_files(spark, path, glob, encoding).coalesce(tasks))
    # By folder and name, not by the characters of the whole path: "/" sorts after "-".
    parts = files.select("path", F.split("path", "/").alias("_parts"))
    numbered = dense_ids(parts, ["_parts"], "doc_id").drop("_parts")
    return files.join(_up_to(numbered, max_docs), "path").select("doc_id", "text")


def write_text_dir(docs: DataFrame, path: str, name: str, text: str = "text") -> int:
    """Write a file ``name.txt`` per row, its text and a line end; returns the number of files.

    Names must be different. Files lie in folders by the first three characters of
    their names, so the reader finds them in the order of the names and no folder
    holds more than a part. A repeated task writes the same files again.
    """
    where = qualified(docs.sparkSession, path)
    named = docs.select(F.col(name).cast("string").alias("name"), F.col(text).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(where)
        made = set()
        for batch in batches:
            for own, whole in zip(*(batch.column(c).to_pylist() for c in ("name", "text")), strict=True):
                folder = posixpath.join(root, own[:3])
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(posixpath.join(folder, f"{own}.txt")) as sink:
                    sink.write(f"{whole or ''}\n".encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["files"])

    written = named.mapInArrow(write, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


READERS = {"wikipedia": read_jsonl, "text_dir": read_text_dir, "messages": read_messages}


def read_corpus(spark: SparkSession, source: str, path: str, **options) -> DataFrame:
    """Read from one of the three sources."""
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}; expected one of {sorted(READERS)}")
    if not path:
        raise ValueError(f"source {source!r} needs a path")
    return READERS[source](spark, path, **options)


def to_jsonl(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One JSON line ``{"text": ...}`` per row with non-blank text."""
    kept = df.where(F.col(text_col).isNotNull() & ~is_blank(F.col(text_col)))
    return kept.select(F.to_json(F.struct(F.col(text_col).alias("text"))).alias("value"))


def write_jsonl(df: DataFrame, path: str, text_col: str = "text", force: bool = False) -> None:
    """Write the corpus as JSON lines; an existing one is kept unless ``force``."""
    to_jsonl(df, text_col).write.mode("overwrite" if force else "ignore").text(path)
