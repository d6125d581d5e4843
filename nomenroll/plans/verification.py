"""Publish and check checksum lists and table snapshots."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenroll.operators.verify import compare_digests, last_entry
from nomenroll.session import materialize
from nomenroll.sources.artifacts import file_digests, named_file_digests, read_checksums, write_checksums


def _without_list(files: DataFrame, list_path: str, root: str) -> DataFrame:
    plain = [re.sub("^file:/+", "/", p).rstrip("/") for p in (list_path, root)]
    if not plain[0].startswith(plain[1] + "/"):
        return files
    own = plain[0].removeprefix(plain[1] + "/")
    return files.filter((F.col("path") != own) & ~F.col("path").startswith(own + "/"))


def publish_checksums(spark: SparkSession, root: str, list_path: str, exclude: Sequence[str] = ()) -> None:
    """Hash every file below ``root`` and write the sorted list; a list below ``root`` leaves itself out.

    A file that can't be read is an error, since a list without its digest would prove nothing. The
    digests are written before they are sorted, so each file is read once.
    """
    found = _without_list(file_digests(spark, root, exclude), list_path, root)
    digests = materialize(found, "digests")
    unreadable = digests.filter("digest IS NULL").select("path")
    if some := unreadable.limit(20).collect():
        raise ValueError(f"can't read {unreadable.count()} file(s): {[r.path for r in some]} ...")
    write_checksums(digests, list_path)


def verify_files(
    spark: SparkSession,
    list_path: str,
    root: str | None = None,
    files: DataFrame | Sequence[str] | None = None,
    exclude: Sequence[str] = (),
    skip: Sequence[str] = (),
) -> DataFrame:
    """Compare a list with the files below ``root``, or with the named ``files`` (a table or a list of names), relative to ``root`` if that is given.

    A list below ``root`` is no extra file.
    """
    if root is None and files is None:
        raise ValueError("give root or files")
    if files is not None:
        found = named_file_digests(spark, files, root)
    else:
        found = _without_list(file_digests(spark, root, exclude, skip), list_path, root)
    return compare_digests(last_entry(read_checksums(spark, list_path)), found)
