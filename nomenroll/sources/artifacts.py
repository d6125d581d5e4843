"""Files with their digests, and checksum lists.

Files are listed and hashed in tasks through Arrow's file systems. Spark's own binary source would
leave out empty files and names that begin with ``_`` or ``.``, and can't hold files beyond 2 GiB;
here every file counts, and its content streams through the hash block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenroll.functions.whitespace import strip
from nomenroll.session import materialize

BLOCK_BYTES = 1 << 20
TASKS_PER_CORE = 4
PAGE_FILES = 10_000


def glob_pattern(glob: str) -> str:
    """Regular expression of a relative glob, compared part by part from the right end of a path.

    ``*.tmp`` fits at any depth and ``b/*.tmp`` below any parent; ``*`` never crosses a ``/``.
    """
    if glob.startswith("/"):
        return r"(?!)"  # paths are relative
    parts = []
    for part in glob.rstrip("/").split("/"):
        out = ""
        for token in re.findall(r"\[!?\]?[^\]]*\]|.", part):
            if token == "*":
                out += "[^/]*"
            elif token == "?":
                out += "[^/]"
            elif len(token) > 1:
                negated = token[1] == "!"
                # ``!`` alone negates in a glob; what else has a meaning in a Java class is escaped
                body = re.sub(r"([\\^\[&\]])", r"\\\1", token[2 if negated else 1 : -1])
                out += f"[^/{body}]" if negated else f"[{body}]"
            else:
                out += re.escape(token)
        parts.append(out.replace("[^/]*[^/]*", "[^/]*"))
    return "(?:^|/)" + "/".join(parts) + r"\z"


def exclude_globs(df: DataFrame, path: str, globs: Sequence[str]) -> DataFrame:
    for glob in globs:
        df = df.filter(~F.col(path).rlike(glob_pattern(glob)))
    return df


def opener():
    """A function that opens ``path`` or URI as (file system, path inside it)."""

    def opened(path: str):
        from pyarrow import fs

        uri = re.sub("^s3[an]:", "s3:", path)
        uri = re.sub("^file:/+", "/", uri)
        return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)

    return opened


def _spread(df: DataFrame) -> DataFrame:
    """One small row stands for much work, so rows are dealt out evenly, not by their size."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism * TASKS_PER_CORE
    return df.repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: ``path`` relative to it, ``full`` and ``length``.

    One round per level of the tree; within a round, each directory is listed by a task.
    """
    opened = opener()
    root = root.rstrip("/")

    def list_directories(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for full, path in zip(batch["full"], batch["path"]):
                system, inside = opened(full)
                infos = system.get_file_info(fs.FileSelector(inside))
                for begin in range(0, len(infos), PAGE_FILES):  # a flat directory may hold very many
                    rows = [
                        (f"{full}/{i.base_name}", path + i.base_name, i.type == fs.FileType.Directory, i.size or 0)
                        for i in infos[begin : begin + PAGE_FILES]
                    ]
                    yield pd.DataFrame(rows, columns=["full", "path", "is_dir", "length"])

    schema = "full string, path string, is_dir boolean, length bigint"
    level = spark.createDataFrame([(root, "")], "full string, path string")
    rounds = []
    while True:
        listed = materialize(level.mapInPandas(list_directories, schema), "listing")
        rounds.append(listed.filter("NOT is_dir").select("path", "full", "length"))
        below = listed.filter("is_dir").select("full", F.concat("path", F.lit("/")).alias("path"))
        if below.isEmpty():
            break
        level = _spread(below)
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files


def _with_digest(files: DataFrame) -> DataFrame:
    """Replace ``full`` by the ``digest`` of its content; a file that can't be read has a null one."""
    opened, block_bytes = opener(), BLOCK_BYTES

    @F.pandas_udf("string")
    def digest(paths: pd.Series) -> pd.Series:
        import hashlib

        def one(path: str) -> str | None:
            state = hashlib.sha256()
            try:
                system, inside = opened(path)
                with system.open_input_stream(inside) as content:
                    while block := content.read(block_bytes):
                        state.update(block)
            except OSError:
                return None
            return state.hexdigest().upper()

        return paths.map(one)

    return _spread(files).select("path", "length", digest("full").alias("digest"))


def file_digests(
    spark: SparkSession, root: str, exclude: Sequence[str] = (), skip: Sequence[str] = ()
) -> DataFrame:
    """Every file below ``root``: relative ``path``, ``length``, ``digest``.

    ``exclude`` holds globs; ``skip`` exact relative paths, such as the checksum list itself.
    """
    files = exclude_globs(list_files(spark, root), "path", exclude)
    return _with_digest(files.filter(~F.col("path").isin(*skip)) if skip else files)


def named_file_digests(spark: SparkSession, files: DataFrame | Sequence[str], root: str | None = None) -> DataFrame:
    """The named files only: by their path below ``root``, which relative names are below of, or else by the name given.

    ``files`` is a table of names (its first column), or a short list of them. A missing file, a name that isn't below
    ``root`` and a path that comes twice are errors that show twenty of them. All of it is found by Spark: the driver
    learns no names but those.
    """
    names = files if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], "name string")
    name, base = F.col(names.columns[0]), root.rstrip("/") + "/" if root else ""
    absolute = name.startswith("/") | name.rlike(r"^\w+:/")
    full = F.when(absolute, name).otherwise(F.concat(F.lit(base), name)) if base else name
    path = F.substring("full", len(base) + 1, 1 << 30)
    opened = opener()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            infos = [system.get_file_info(inside) for system, inside in map(opened, batch["full"])]
            yield batch.assign(length=pd.array([i.size if i.is_file else None for i in infos], dtype="Int64"))

    def some(rows: DataFrame, column: str) -> list[str]:
        return [r[0] for r in rows.select(column).limit(20).collect()]

    # repeated names are combined on the map side; each path is looked up once
    counted = names.select(full.alias("full")).groupBy("full").agg(F.count("*").alias("times"))
    counted = materialize(counted.select(path.alias("path"), "full", "times"), "names")
    if outside := some(counted.filter(~F.col("full").startswith(base)), "full") if base else []:
        raise ValueError(f"not below {root}: {outside}")
    if repeated := some(counted.filter("times > 1"), "path"):
        raise ValueError(f"named more than once: {sorted(repeated)}")
    found = _spread(counted.select("path", "full")).mapInPandas(look, "path string, full string, length bigint")
    found = materialize(found, "named")
    if absent := some(found.filter("length IS NULL"), "full"):
        raise FileNotFoundError(", ".join(absent))
    return _with_digest(found)


def checksum_lines(digests: DataFrame) -> DataFrame:
    """Lines ``path``, two spaces, ``DIGEST``, sorted by path."""
    return digests.orderBy("path").select(F.concat_ws("  ", "path", "digest").alias("value"))


def write_checksums(digests: DataFrame, path: str) -> None:
    """Write the list; part files in name order hold the sorted lines."""
    checksum_lines(digests).write.mode("overwrite").text(path)


def parse_checksums(lines: DataFrame, value: str = "value", order: Column | None = None) -> DataFrame:
    """``path``, ``digest`` (upper case) and ``line_no`` of list lines.

    Blank lines are skipped. The first double space ends the path; a line without one is an error.
    """
    line = strip(F.col(value))
    split_at = F.instr(line, "  ")
    bad = F.raise_error(F.concat(F.lit("no double space in checksum line: "), F.col("line"))).cast("string")
    return (
        lines.select(line.alias("line"), split_at.alias("at"), (F.lit(0) if order is None else order).alias("line_no"))
        .filter(F.col("line") != "")
        .select(
            F.when(F.col("at") == 0, bad).otherwise(strip(F.substring("line", F.lit(1), F.col("at") - 1))).alias("path"),
            F.upper(strip(F.substring("line", F.col("at") + 2, F.lit(1 << 30)))).alias("digest"),
            "line_no",
        )
    )


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """A written list; ``line_no`` orders lines by file, block and row."""
    lines = spark.read.text(path).select(
        "value",
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias(
            "order"
        ),
    )
    return parse_checksums(lines, order=F.col("order"))
