import csv
import datetime
import decimal
import os

import pytest
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.functions.persian import NormalizeConfig
from nomenroll.operators.annotate import pattern_annotator
from nomenroll.operators.corpus import after_key, fields_of, first_n, standardize
from nomenroll.operators.gazetteer import build_gazetteer
from nomenroll.operators import selection
from nomenroll.operators.rules import with_rules
from nomenroll.plans.extraction import annotate_fields, gazetteer_fields, inventory_of, run_extraction
from nomenroll.plans.quality import with_context
from nomenroll.session import shared_dir
from nomenroll.sources import corpus as C
from nomenroll.sources import inventory as I
from nomenroll.sources.folders import publish, remove
from nomenroll.streaming import compaction as Q
from nomenroll.streaming.ingest import read_table, record_progress, run_record, running_rule_counts, running_totals, start_extraction

ROWS = [
    (1, "Ada", "<p>Bo &amp; Cy</p><script>No</script>", "l1"),
    (2, None, "NA\nDi \"quoted\", and more", None),
    (3, "x", "", "l3"),
    (4, "Ed", "😀 Flo 12", "l4"),
]
PATTERN = pattern_annotator({"PER": "[A-Z][a-z]+", "DATE": "[0-9۰-۹]+"})


def corpus_frame(spark):
    return spark.createDataFrame(ROWS, "doc_id int, head string, body string, url string")


def contract(spark, **options):
    return standardize(corpus_frame(spark), title="head", content="body", link="url", key=["doc_id"], **options)


def test_standardize(spark):
    rows = contract(spark).orderBy("doc_id").collect()
    assert rows[1].title == "" and rows[1].link == "" and rows[3].link == "l4"
    assert standardize(corpus_frame(spark), title="head", content="body").first().link == ""
    assert contract(spark, null_text="nan").orderBy("doc_id").collect()[1].title == "nan"
    with pytest.raises(ValueError, match=r"missing column\(s\) \['title'\]"):
        standardize(corpus_frame(spark), content="body")
    with pytest.raises(ValueError, match="text_field"):
        fields_of("all")


def test_first_n_and_resume(spark):
    rows = contract(spark).repartition(3)
    assert sorted(r.doc_id for r in first_n(rows, "doc_id", 2).collect()) == [1, 2]
    assert sorted(r.doc_id for r in first_n(after_key(rows, "doc_id", 2), "doc_id", 9).collect()) == [3, 4]
    assert first_n(rows, "doc_id", 0).count() == 0 and first_n(rows, "doc_id", -1).count() == 0


KEYS = {
    "bigint": lambda i: (i * 7919 % 10_007 - 5_000) * 10**14,
    "string": lambda i: f"k{i * 7919 % 10007}é"[: 2 + i % 5] + str(i),
    "date": lambda i: datetime.date(1969, 1, 1) + datetime.timedelta(days=i * 17 % 30_011),
    "timestamp": lambda i: datetime.datetime(1969, 12, 1) + datetime.timedelta(seconds=i * 7919 % 100_003, microseconds=i),
    "decimal(12,2)": lambda i: decimal.Decimal(i * 7919 % 10007) / 4,
}


@pytest.mark.parametrize("kind", KEYS)
def test_nth_key_is_found_by_counting(spark, kind, monkeypatch):
    monkeypatch.setattr(selection, "SAMPLE", 20)
    monkeypatch.setattr(selection, "PIVOTS", 5)
    values = [KEYS[kind](i) for i in range(400)]
    rows = spark.createDataFrame([(v, "x") for v in values] + [(None, "x")] * 3, f"k {kind}, v string").repartition(3)
    ordered = [r.k for r in rows.filter("k is not null").orderBy("k").collect()]
    for n in (1, 2, 199, 399, 400, 401):
        assert [r.k for r in first_n(rows, "k", n).orderBy("k").collect()] == ordered[:n]
    plan = first_n(rows, "k", 390)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert first_n(rows.limit(0), "k", 5).count() == 0


def test_nth_key_with_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(selection, "SAMPLE", 4)
    keys = [7] * 5000 + [1] * 2000 + list(range(100, 130))
    rows = spark.createDataFrame([(k,) for k in keys], "k int")
    for n in (1, 2000, 2001, 7000, 7001, 7029):
        assert selection.nth_smallest(rows, "k", n) == sorted(keys)[n - 1]


def test_after_key_and_columns_reach_the_scan(spark, path):
    contract(spark).write.parquet(path)
    plan = after_key(spark.read.parquet(path), "doc_id", 2).select("doc_id", "title")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(doc_id,2)" in text and "content" not in text


def test_annotate_fields(spark):
    got = {r.doc_id: r for r in annotate_fields(contract(spark), ["doc_id"], PATTERN, keep_text=True).collect()}
    assert got[1].norm_content == "Bo & Cy"
    assert [tuple(s) for s in got[1].entities_content] == [("Bo", "PER", 0, 2), ("Cy", "PER", 5, 7)]
    assert got[3].entities_content == []
    assert got[4].norm_content == "😀 Flo ۱۲"
    for row in got.values():
        for field in ("title", "content"):
            text = row[f"norm_{field}"]
            assert all(text[s.start_char : s.end_char] == s.text for s in row[f"entities_{field}"])
    only = annotate_fields(contract(spark), ["doc_id"], PATTERN, "title")
    assert only.columns == ["doc_id", "title", "link", "entities_title"]
    text = only._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in text.split("Project")[-2] or "entities_content" not in text


def test_gazetteer_fields_keep_every_document(spark):
    book = build_gazetteer(spark.createDataFrame([("Bo", "PER"), ("Flo ۱۲", "ORG")], "surface string, type string"))
    got = gazetteer_fields(contract(spark), ["doc_id"], book).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.entities_content] for r in got] == [
        [("Bo", "PER", 0, 2)],
        [],
        [],
        [("Flo ۱۲", "ORG", 2, 8)],
    ]
    assert all(r.entities_title == [] for r in got)


def test_extraction_job(spark, path):
    annotated = annotate_fields(contract(spark), ["doc_id"], PATTERN)
    metrics = run_extraction(annotated, ["doc_id"], path, options={"limit": "4"}).first()
    assert (metrics.rows_in, metrics.mentions["PER"], metrics.mentions["LOC"]) == (4, 6, 0)
    assert metrics.dropped_types == {"DATE": 1}
    assert metrics.options["persian_numbers"] == "True" and metrics.options["limit"] == "4"
    assert metrics.generated_at is None
    run_extraction(annotated, ["doc_id"], path)
    assert spark.read.parquet(f"{path}/runs").count() == 2
    assert spark.read.parquet(f"{path}/inventory").count() == 6
    found = sorted(tuple(r) for r in inventory_of(annotated, ["doc_id"]).select("doc_id", "field", "entity").collect())
    assert found[0] == (1, "content", "Bo") and (2, "content", "Di") in found


def test_csv_keeps_quotes_breaks_and_na(spark, path):
    rows = contract(spark).select("title", "content", "link")
    C.write_csv(rows, path)
    for columns in (None, ["title", "content", "link"]):
        back = standardize(C.read_csv(spark, path, columns))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_csv_from_another_writer(spark, path):
    os.makedirs(path)
    with open(f"{path}/c.csv", "w", encoding="utf-8", newline="") as out:
        writer = csv.writer(out)
        writer.writerows([["title", "content"], ["NA", 'a "b"\r\nc, d'], ["", "é"]])
    got = sorted(map(tuple, standardize(C.read_csv(spark, f"{path}/c.csv")).collect()))
    # the reader turns the file's own line ending into \n inside quotes, too
    assert got == [("", "é", ""), ("NA", 'a "b"\nc, d', "")]


def test_json_corpus(spark, path):
    contract(spark).write.json(path)
    assert C.read_json(spark, path, ["title", "content", "link"]).count() == 4


def test_class_files(spark, path):
    os.makedirs(path)
    for name, column, values in [
        ("pers.csv", "pers_entities", ["NA", "007", "Ada"]), ("loc.csv", "loc_entities", ["Rome"]), ("other.csv", "x", ["no"]),
    ]:
        with open(f"{path}/{name}", "w", encoding="utf-8", newline="") as out:
            csv.writer(out).writerows([[column], *[[v] for v in values]])
    got = sorted(map(tuple, I.read_class_files(spark, path).collect()))
    assert got == [("loc", "Rome"), ("pers", "007"), ("pers", "Ada"), ("pers", "NA")]
    with open(f"{path}/org.csv", "w") as out:
        out.write("wrong\nx\n")
    assert I.class_headers(spark, path) == {"loc.csv": ["loc_entities"], "org.csv": ["wrong"], "pers.csv": ["pers_entities"]}
    with pytest.raises(ValueError, match="org.csv has no column 'org_entities'; available: \\['wrong'\\]"):
        I.read_class_files(spark, path)
    assert I.read_class_files(spark, f"{path}/absent").count() == 0


def test_class_files_written_and_read(spark, path):
    rows = spark.createDataFrame([("PER", 'a "b", c'), ("PER", "007"), ("LOC", "x\ny"), ("ORG", None)], "entity_class string, entity string")
    I.write_class_files(rows, path, ["PER", "LOC", "ORG"])
    assert {f for f in os.listdir(path) if not f.startswith(".")} == {"loc.csv", "org.csv", "pers.csv"}
    got = sorted(map(tuple, I.read_class_files(spark, path).collect()))
    assert got == [("loc", "x\ny"), ("org", ""), ("pers", "007"), ("pers", 'a "b", c')]


def test_class_files_are_made_from_one_pass_of_many_tasks(spark, path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    names = ["PER", "LOC", "ORG", "EVENT"]
    rows = spark.range(0, 400, 1, 7).selectExpr("element_at(array('PER', 'LOC', 'ORG', 'FAC'), int(id % 4) + 1) AS entity_class", "'é \"' || id AS entity")
    I.write_class_files(rows.mapInPandas(counted, rows.schema), path, names)
    assert seen.value == 400
    got = sorted(map(tuple, I.read_class_files(spark, path, multi_line=False).collect()))
    assert got == sorted((I.K.INVENTORY_NAMES[names[i % 4]], f'é "{i}') for i in range(400) if i % 4 < 3)
    assert open(f"{path}/event.csv", encoding="utf-8").read() == "event_entities\n"


def test_context_of_path(spark):
    frame = spark.createDataFrame([("file:/a/PERS.xlsx",), ("/x.y/Loc.csv",), ("org",)], "p string")
    assert [r.c for r in frame.select(I.context_of_path(F.col("p")).alias("c")).collect()] == ["pers", "loc", "org"]


@pytest.mark.parametrize("file_format", ["parquet", "csv"])
def test_inventory_files(spark, path, file_format):
    rows = inventory_of(annotate_fields(contract(spark), ["doc_id"], PATTERN), ["doc_id"])
    rows = rows.unionByName(rows.withColumns({"entity": F.lit("007, \"x\""), "entity_class": F.lit("LOC")}))
    I.write_inventory(rows, path, file_format)
    assert {d for d in os.listdir(path) if "=" in d} == {"entity_class=PER", "entity_class=LOC"}
    back = I.read_inventory(spark, path, rows.select(*rows.columns[1:], "entity_class").schema, file_format)
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    part = back.filter("entity_class = 'PER'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity_class" in part


def test_writers_size_their_files(spark, path):
    rows = spark.range(40_000).repartition(16).select(
        F.when(F.col("id") % 100 == 0, "PER").otherwise("LOC").alias("entity_class"),
        F.sha2(F.col("id").cast("string"), 256).alias("entity"),
        F.lit("pers").alias("context"),
    )
    for name, target in (("none", None), ("sized", 400_000)):
        I.write_inventory(rows.drop("context"), f"{path}/i{name}", target_bytes=target)
        I.write_split(with_rules(rows), f"{path}/s{name}", target)
        I.write_raw_copy(rows, f"{path}/r{name}", target_bytes=target)

    def sizes(name):
        return sorted(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(f"{path}/{name}") for f in fs if f.endswith(".parquet"))

    assert len(sizes("inone")) == 32 and len(sizes("snone")) >= 16
    large = [n for n in sizes("isized") if n > 100_000]
    assert 4 <= len(large) <= 9 and len(sizes("isized")) <= len(large) + 2 and max(large) < 1_000_000
    assert 4 <= len(sizes("ssized")) <= 10 and 4 <= len(sizes("rsized")) <= 10
    for table in "isr":
        a, b = (spark.read.parquet(f"{path}/{table}{c}") for c in ("none", "sized"))
        assert a.count() == 40_000 and a.exceptAll(b).isEmpty()
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") != "400000"


def plain(batch):
    return annotate_fields(batch, ["doc_id"], PATTERN, "content", NormalizeConfig())


def run_stream(spark, source, out, checkpoint):
    stream = C.stream_files(spark, source, contract(spark).schema, files_per_batch=1)
    start_extraction(stream, ["doc_id"], plain, out, checkpoint, count_rules=True).awaitTermination()


def test_stream_with_restarts_equals_batch(spark, path):
    source, out, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    rows = contract(spark)
    rows.filter("doc_id <= 2").coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, checkpoint)
    before = set(os.listdir(f"{out}/processed"))
    rows.filter("doc_id > 2").coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, checkpoint)
    run_stream(spark, source, out, checkpoint)
    assert before < set(os.listdir(f"{out}/processed"))

    batch = inventory_of(plain(rows), ["doc_id"])
    streamed = read_table(spark, out, "inventory").select(batch.columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert read_table(spark, out, "processed").count() == 4

    checked = with_rules(with_context(batch))
    want = {r.context: r.n for r in checked.groupBy("context").agg(F.count("*").alias("n")).collect()}
    assert {r.context: r.rows_total for r in running_totals(spark, out).collect()} == want
    assert running_rule_counts(spark, out).filter("overall").count() == checked.filter("_qc_flag").count()


def _state(spark, out):
    return {t: sorted(map(str, read_table(spark, out, t).collect())) for t in ("processed", "inventory", "runs")} | {
        "totals": sorted(map(tuple, running_totals(spark, out).collect())),
        "rule_counts": sorted(map(str, running_rule_counts(spark, out).collect())),
    }


def test_compaction_stopped_between_steps(spark, path):
    source, out, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    rows = contract(spark)
    for i in (1, 2, 3, 4):
        rows.filter(F.col("doc_id") == i).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, checkpoint)
    before = _state(spark, out)
    assert Q.batches(spark, out, "inventory") == [0, 1, 2, 3] and Q.marks(spark, out, "inventory") == []
    for table, merge in Q.MERGES.items():  # stopped after step one: the merged rows aren't seen
        new = Q.merged(spark, out, table, 1, merge)
        assert _state(spark, out) == before and Q.marks(spark, out, table) == []
        publish(spark, new, f"{out}/_compacted/{table}/upto=1")  # stopped after step two: batches aren't seen twice
        assert _state(spark, out) == before and Q.marks(spark, out, table) == [1]
    with pytest.raises(Exception, match="(?i)exist"):  # a mark is published once
        publish(spark, Q.merged(spark, out, "totals", 1), f"{out}/_compacted/totals/upto=1")
    assert Q.compact_all(spark, out) == dict.fromkeys(Q.MERGES, 2)
    assert _state(spark, out) == before
    assert Q.batches(spark, out, "inventory") == [2, 3]  # batch 2 is below the last mark only
    assert spark.read.parquet(f"{out}/_compacted/totals/upto=2").count() <= 2
    # the newest batch is never merged: a replay after the compaction changes nothing
    assert Q.compact_all(spark, out) == dict.fromkeys(Q.MERGES, 2)
    remove(spark, f"{checkpoint}/commits/3")
    rows.filter("doc_id = 4").withColumn("doc_id", F.lit(5)).coalesce(1).write.mode("append").parquet(source)
    run_stream(spark, source, out, checkpoint)
    assert read_table(spark, out, "processed").count() == 5 and Q.batches(spark, out, "processed") == [2, 3, 4]


def test_run_record(spark, path):
    source, out, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    contract(spark).repartition(2).write.parquet(source)
    stream = C.stream_files(spark, source, contract(spark).schema, files_per_batch=1)
    query = start_extraction(stream, ["doc_id"], plain, out, checkpoint)
    query.awaitTermination()
    record_progress(query, out, spark)
    record_progress(query, out, spark)
    rows = run_record(spark, out).collect()
    assert len(rows) == 2 and all(r.agrees for r in rows) and sum(r.rows_committed for r in rows) == 4
    assert sum(r.input_rows for r in rows) == 4 and sum(r.mentions_committed for r in rows) == read_table(spark, out, "inventory").count()
    # what isn't committed as observed doesn't agree
    spark.read.parquet(f"{out}/runs/batch=0").withColumn("rows_committed", F.lit(0).cast("long")).write.parquet(f"{path}/lost")
    spark.read.parquet(f"{path}/lost").write.mode("overwrite").parquet(f"{out}/runs/batch=0")
    assert sorted(r.agrees for r in run_record(spark, out).collect()) == [False, True]


def test_a_replayed_batch_changes_nothing(spark, path):
    source, out, checkpoint = f"{path}/in", f"{path}/out", f"{path}/checkpoint"
    contract(spark).coalesce(1).write.parquet(source)
    run_stream(spark, source, out, checkpoint)
    first = sorted(map(str, read_table(spark, out, "inventory").collect()))
    # as after a crash between the writes and the commit: the commit is lost, the batch runs again
    for name in os.listdir(f"{checkpoint}/commits"):
        os.remove(f"{checkpoint}/commits/{name}")
    run_stream(spark, source, out, checkpoint)
    assert sorted(map(str, read_table(spark, out, "inventory").collect())) == first


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Conf:
        values = {"spark.sql.warehouse.dir": "file:/w"}

        def get(self, name, default):
            return self.values.get(name, default)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Context.master = "local[4]"
    assert shared_dir(Session()) == "file:/w/scratch"
    Context.master, Conf.values = "yarn", {"spark.sql.warehouse.dir": "hdfs://w/"}
    assert shared_dir(Session()) == "hdfs://w/scratch"
    Conf.values = {"spark.checkpoint.dir": "hdfs://shared/dir/", "spark.sql.warehouse.dir": "file:/w"}
    assert shared_dir(Session()) == "hdfs://shared/dir"
    assert os.path.isdir(shared_dir(spark)) and shared_dir(spark) == shared_dir(spark)


def test_class_contexts(spark):
    frame = spark.createDataFrame([(c, "x") for c in K.ENTITY_CLASSES], "entity_class string, entity string")
    assert {r.entity_class: r.context for r in with_context(frame).collect()} == K.INVENTORY_NAMES


def test_extraction_without_any_mention(spark, path):
    nothing = contract(spark).filter("doc_id = 3").withColumn("title", F.lit(""))
    metrics = run_extraction(annotate_fields(nothing, ["doc_id"], PATTERN), ["doc_id"], path).first()
    assert (metrics.rows_in, set(metrics.mentions.values()), metrics.dropped_types) == (1, {0}, {})
    assert (metrics.observed_rows, metrics.observed_mentions, metrics.agrees) == (1, 0, True)


def test_stream_batch_without_any_mention(spark, path):
    source, out = f"{path}/in", f"{path}/out"
    contract(spark).filter("doc_id = 3").withColumn("title", F.lit("")).coalesce(1).write.parquet(source)
    run_stream(spark, source, out, f"{path}/checkpoint")
    (row,) = read_table(spark, out, "runs").collect()
    assert (row.rows_observed, row.rows_committed, row.mentions_observed, row.mentions_committed) == (1, 1, 0, 0)


def test_stream_spreads_a_batch_of_one_file_and_counts_repeated_entities(spark, path):
    source, out, checkpoint, parts = (*(f"{path}/{p}" for p in ("in", "out", "checkpoint")), [])
    contract(spark).unionByName(contract(spark)).coalesce(1).write.parquet(source)

    def annotate(batch):
        parts.append(batch.rdd.getNumPartitions())
        return annotate_fields(batch, ["doc_id"], PATTERN)

    stream = C.stream_files(spark, source, contract(spark).schema, files_per_batch=1)
    start_extraction(stream, ["doc_id"], annotate, out, checkpoint, count_rules=True).awaitTermination()
    assert parts and min(parts) >= spark.sparkContext.defaultParallelism
    inventory = read_table(spark, out, "inventory")
    expected = with_rules(with_context(inventory)).groupBy("context").agg(F.count("*").alias("n"), F.count_if("_qc_flag").alias("f"))
    got = {tuple(r) for r in running_totals(spark, out).select("context", "rows_total", "rows_flagged").collect()}
    assert got == {tuple(r) for r in expected.collect()}
