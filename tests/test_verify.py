import datetime
import decimal
import hashlib
import os
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from nomenroll.functions.digests import row_digest, sha256_hex
from nomenroll.operators.verify import (
    changed_keys,
    compare_digests,
    compare_ranges,
    compare_tables,
    key_ranges,
    last_entry,
    listed_only,
    on_both_sides,
    verdict,
)
from nomenroll.plans.verification import publish_checksums, verify_files
from nomenroll.sources import artifacts as A


def pairs(spark, rows):
    return spark.createDataFrame(rows, "path string, digest string")


def status(df, *key):
    return {tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]: r.status for r in df.collect()}


def test_golden_comparison(spark):
    listed = pairs(spark, [("f", "1"), ("g", "2"), ("k", "5")])
    disk = pairs(spark, [("g", "3"), ("h", "4"), ("k", "5")])
    compared = compare_digests(listed, disk)
    assert status(compared, "path") == {"f": "missing", "g": "mismatch", "h": "extra", "k": "ok"}
    row = compared.filter("path = 'g'").first()
    assert (row.expected, row.found) == ("2", "3")
    total = verdict(compared).first()
    assert (total.checked, total.missing, total.extra, total.mismatch, total.ok) == (4, 1, 1, 1, False)
    assert verdict(compare_digests(listed, listed)).first().ok
    assert [r.path for r in listed_only(listed, disk).collect()] == ["f"]
    assert [r.path for r in on_both_sides(listed, disk).collect()] == ["g", "k"]


def test_unreadable_is_never_ok(spark):
    compared = compare_digests(pairs(spark, [("a", "1")]), pairs(spark, [("a", None), ("b", None)]))
    assert status(compared, "path") == {"a": "unreadable", "b": "unreadable"}
    assert not verdict(compared).first().ok


def test_digest_golden(spark):
    got = spark.range(1).select(sha256_hex(F.lit("abc"))).first()[0]
    assert got == "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"


def test_row_digest_sees_nulls_names_and_microseconds(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (1, 'a', CAST(NULL AS STRING), TIMESTAMP '2024-01-01 00:00:00.000001'), "
        "(2, CAST(NULL AS STRING), 'a', TIMESTAMP '2024-01-01 00:00:00.000001'), "
        "(3, 'a', CAST(NULL AS STRING), TIMESTAMP '2024-01-01 00:00:00.000002'), "
        "(4, 'a', '', TIMESTAMP '2024-01-01 00:00:00.000001') AS t(k, x, y, ts)"
    )
    digests = [r.d for r in rows.select(row_digest(["x", "y", "ts"]).alias("d")).collect()]
    assert len(set(digests)) == 4


def test_tables(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, v string")
    after = spark.createDataFrame([(2, "b"), (3, ""), (4, "x"), (5, "e")], "k int, v string")
    assert status(compare_tables(before, after, ["k"]), "k") == {
        1: "missing", 2: "ok", 3: "mismatch", 4: "mismatch", 5: "extra",
    }
    with pytest.raises(ValueError, match="missing column"):
        compare_tables(before, after.drop("v"), ["k"])


def test_repeated_keys_compare_as_multisets(spark):
    before = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "k int, v string")
    after = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "b"), (2, "a")], "k int, v string")
    assert status(compare_tables(before, after, ["k"]), "k") == {1: "mismatch", 2: "ok"}


def test_hot_key_does_not_pair_rows(spark):
    hot = spark.range(20000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    cold = spark.range(100).select((F.col("id") + 2).cast("int").alias("k"), F.col("id").alias("v"))
    compared = compare_tables(hot.unionByName(cold), hot.unionByName(cold), ["k"])
    assert compared.filter("status <> 'ok'").count() == 0 and compared.count() == 101
    assert "Join" not in compared._jdf.queryExecution().executedPlan().toString()


def _not_ok(spark, before, after, key):
    return status(compare_tables(before, after, key).filter("status <> 'ok'"), *key)


KEYS = {
    "bigint": lambda i: (i - 300) * 10**15,
    "int": lambda i: i * 7 - 900,
    "date": lambda i: datetime.date(1969, 6, 1) + datetime.timedelta(days=i),
    "timestamp": lambda i: datetime.datetime(1969, 12, 31) + datetime.timedelta(minutes=37 * i, microseconds=i),
    "string": lambda i: f"k{i}",
    "decimal(10,2)": lambda i: decimal.Decimal(i) / 4,
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("count", [1, 16, 4096])
def test_changed_keys(spark, kind, count):
    make = KEYS[kind]
    rows = [(make(i), i % 3, str(i)) for i in range(600)] + [(make(5), 1, "again")] * 2 + [(None, 0, "null"), (None, None, None)]
    later = [r for i, r in enumerate(rows) if i not in (7, 590)]
    later[100] = (*later[100][:2], "changed")
    later.remove((make(5), 1, "again"))
    later += [(make(700), 0, "new"), (None, 1, "more")]
    later = [(k, n, v if (k, v) != (None, "null") else None) for k, n, v in later]
    schema = f"k {kind}, n int, v string"
    before, after = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(later, schema)
    key = ["k", "n"]
    want = _not_ok(spark, before, after, key)
    assert len(want) == 7 and status(changed_keys(before, after, key, count=count), *key) == want
    assert changed_keys(before, before, key, count=count).count() == 0
    empty = before.limit(0)
    assert changed_keys(empty, empty, key).count() == 0
    assert set(status(changed_keys(empty, after, key), *key).values()) == {"extra"}


def test_ranges_shuffle_sums_only(spark, path):
    rows = spark.range(20_000).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"), F.col("id").alias("v"))
    rows.repartitionByRange(8, "t").write.parquet(path)
    before = spark.read.parquet(path)
    after = before.withColumn("v", F.when(F.col("v") >= 19_500, 0).otherwise(F.col("v")))
    cut = key_ranges(before, after, ["t"], 64)
    compared = compare_ranges(before, after, cut)
    assert compared.count() <= 64 and compared.filter("differs").count() < 6
    changed = changed_keys(before, after, ["t"], count=64)
    assert changed.count() == 500
    plan = changed._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in plan
    same = changed_keys(before, before, ["t"])
    assert same.count() == 0 and "Exchange" not in same._jdf.queryExecution().optimizedPlan().toString()
    assert "FileScan" not in same._jdf.queryExecution().executedPlan().toString()


def test_one_exchange(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    plan = compare_tables(rows, rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


GLOBS = ["*.tmp", "b/*.tmp", "a/*", "x?.bin", "[ab]/f", "[!a]*", "a/b/c.txt", "*", "d.e", "**/q"]
PATHS = ["f.tmp", "a/f.tmp", "a/b/f.tmp", "b/f.tmp", "c/b/f.tmp", "a/x", "a/b/x", "x1.bin", "x12.bin", "a/f", "c/f",
         "a/b/c.txt", "z/a/b/c.txt", "d.e", "dxe", "m/n/q", "q", "ب/پ.tmp", "a\nb.tmp"]


@pytest.mark.parametrize("glob", GLOBS)
def test_globs_match_like_relative_paths(spark, glob):
    frame = spark.createDataFrame([(p,) for p in PATHS], "path string")
    kept = {r.path for r in A.exclude_globs(frame, "path", [glob]).collect()}
    assert kept == {p for p in PATHS if not pathlib.PurePosixPath(p).match(glob)}


def write(root, files):
    for name, content in files.items():
        target = os.path.join(root, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as out:
            out.write(content)


def test_publish_and_verify_files(spark, path):
    rng = random.Random(1)
    files = {f"d{i % 3}/f {i}.bin": rng.randbytes(rng.randrange(2000)) for i in range(12)}
    files |= {"top.txt": b"", "skip.tmp": b"x", "d1/q.tmp": b"y", ".hidden": b"h", "_dir/_x": b"u",
              "big": bytes(3 << 20), "ب/پ ٪20.txt": b"p"}
    root = f"{path}/root"
    write(root, files)
    publish_checksums(spark, root, f"{path}/list", exclude=["*.tmp"])
    lines = [r.value for r in spark.read.text(f"{path}/list").collect()]
    want = {n: hashlib.sha256(c).hexdigest().upper() for n, c in files.items() if not n.endswith(".tmp")}
    assert sorted(lines) == sorted(f"{n}  {d}" for n, d in want.items())
    compared = verify_files(spark, f"{path}/list", root=root, exclude=["*.tmp"])
    assert verdict(compared).first().ok and compared.count() == len(want)

    write(root, {"top.txt": b"changed", "new": b"1"})
    os.remove(f"{root}/d0/f 0.bin")
    compared = verify_files(spark, f"{path}/list", root=root, exclude=["*.tmp"])
    changed = {k: v for k, v in status(compared, "path").items() if v != "ok"}
    assert changed == {"top.txt": "mismatch", "new": "extra", "d0/f 0.bin": "missing"}


def test_named_files(spark, path):
    write(path, {"a": b"abc", "b": b""})
    write(path, {"x/a": b"1"})
    got = {r.path: r.digest for r in A.named_file_digests(spark, ["a", f"{path}/b", "x/a"], root=path).collect()}
    assert got == {n: hashlib.sha256(c).hexdigest().upper() for n, c in (("a", b"abc"), ("b", b""), ("x/a", b"1"))}
    assert A.named_file_digests(spark, [f"{path}/a"]).first().path == f"{path}/a"
    with pytest.raises(ValueError, match="more than once"):
        A.named_file_digests(spark, ["a", f"{path}/a"], root=path)
    with pytest.raises(ValueError, match="not below"):
        A.named_file_digests(spark, ["/other/a"], root=path)
    with pytest.raises(FileNotFoundError):
        A.named_file_digests(spark, [f"{path}/absent"])
    with pytest.raises(ValueError, match="root or files"):
        verify_files(spark, "x")


def test_a_list_below_the_root_leaves_itself_out(spark, path):
    root = f"{path}/root"
    write(root, {"a": b"abc", "x/a": b"1"})
    publish_checksums(spark, root, f"{root}/SUMS")
    assert status(verify_files(spark, f"{root}/SUMS", root=root), "path") == {"a": "ok", "x/a": "ok"}
    assert status(verify_files(spark, f"{root}/SUMS", root=root, files=["x/a"]), "path") == {"a": "missing", "x/a": "ok"}


def test_null_and_torn_digests_are_never_ok(spark):
    listed = pairs(spark, [("a", None), ("b", "1"), ("b", "2"), ("c", "3")])
    found = pairs(spark, [("a", "1"), ("b", "2"), ("c", "3"), ("c", "3")])
    assert status(compare_digests(listed, found), "path") == {"a": "mismatch", "b": "mismatch", "c": "ok"}


def test_an_added_column_is_an_error_unless_columns_are_named(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "a", "b")], "k int, v string, w string")
    with pytest.raises(ValueError, match="new table only"):
        compare_tables(old, new, ["k"])
    assert compare_tables(old, new, ["k"], ["v"]).first().status == "ok"


@pytest.mark.parametrize("glob, path, fits", [("[^a]x", "^x", True), ("[^a]x", "ax", True), ("[^a]x", "bx", False), ("[!a]x", "bx", True), ("[!a]x", "ax", False), ("[a&&b]", "&", True), ("[[]", "[", True), ("/a", "a", False)])
def test_glob_classes(spark, glob, path, fits):
    frame = spark.createDataFrame([(path,)], "p string")
    assert (A.exclude_globs(frame, "p", [glob]).count() == 0) == fits


def test_tabs_and_line_ends_around_checksums(spark):
    lines = spark.createDataFrame([("\t",), ("a b  AB12\t\r",), ("\u00a0x  c\u00a0",)], "value string")
    assert {(r.path, r.digest) for r in A.parse_checksums(lines).collect()} == {("a b", "AB12"), ("x", "C")}


def test_a_vanished_file_has_no_digest(spark, path):
    write(path, {"a": b"abc", "b": b"b"})
    files = A.list_files(spark, path)
    os.remove(f"{path}/b")
    got = {r.path: r.digest for r in A._with_digest(files).collect()}
    assert got["b"] is None and got["a"] is not None


def test_skip_leaves_out_the_list_itself(spark, path):
    write(path, {"SUMS": b"", "a": b"1"})
    assert [r.path for r in A.file_digests(spark, path, skip=["SUMS"]).collect()] == ["a"]


def parse(spark, lines):
    return A.parse_checksums(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_parse_checksums(spark):
    got = parse(spark, ["a b  ff", "", "   ", "  c   0a  ", "x  y  z"]).collect()
    assert [(r.path, r.digest) for r in got] == [("a b", "FF"), ("c", "0A"), ("x", "Y  Z")]
    with pytest.raises(Exception, match="no double space in checksum line: broken line"):
        parse(spark, ["a  1", "broken line"]).collect()


def test_last_line_of_a_repeated_path_counts(spark, path):
    write(path, {"list/part-0": "\n".join(f"p{i % 50}  {i:x}" for i in range(5000)).encode()})
    got = {r.path: r.digest for r in last_entry(A.read_checksums(spark, f"{path}/list")).collect()}
    assert got == {f"p{i}": f"{4950 + i:X}" for i in range(50)}
