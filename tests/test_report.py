import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nomenroll.functions.ordering import packed_order
from nomenroll.operators.mentions import mention_order
from nomenroll.operators.report import (
    example_maps,
    examples,
    inventory_reports,
    ledger,
    rule_count_maps,
    rule_counts,
    top_entities,
    totals,
)
from nomenroll.operators.rules import RULES, Rule
from nomenroll.plans.quality import run_quality
from nomenroll.sources.inventory import read_split

ROWS = (
    [("loc", e) for e in ["شهر تهران", "ایران", " ایران ", "1998", "غرب", "", "ایران", "آلمان"]]
    + [("pers", f"{i}{i}") for i in range(20, 0, -1)]
    + [("pers", "Ada"), ("pers", "Bo"), ("pers", "Ada")]
)


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(rows)], "n int, context string, entity string")


def book(spark, rows=ROWS, **options):
    return ledger(frame(spark, rows), F.col("n"), **options)


def test_ledger_counts_normalized_entities_once(spark):
    got = {(r.context, r.entity): (r.mentions, r.first_seen) for r in book(spark).collect()}
    assert got[("loc", "ایران")] == (3, 1)
    assert got[("pers", "Ada")] == (2, 28)
    assert got[("loc", "")] == (1, 5)


def test_totals(spark):
    got = {(r.context, r.overall): (r.rows_total, r.rows_flagged, r.rows_clean) for r in totals(book(spark)).collect()}
    assert got == {("loc", False): (8, 3, 5), ("pers", False): (23, 20, 3), (None, True): (31, 23, 8)}


def test_rule_counts_add_up(spark):
    got = rule_counts(book(spark)).collect()
    per_class = {(r.context, r.rule): r.rows for r in got if not r.overall}
    assert per_class[("pers", "digits_only_or_near")] == 20
    assert per_class[("loc", "year_only")] == 1
    overall = Counter()
    for (_, rule), n in per_class.items():
        overall[rule] += n
    assert {r.rule: r.rows for r in got if r.overall} == overall


def test_examples_are_the_first_eight_distinct(spark):
    rows = [("pers", f"{n % 10}{n % 10}") for n in range(9, -1, -1)] * 3
    got = examples(book(spark, rows)).filter("rule = 'digits_only_or_near'").orderBy("nth").collect()
    assert [r.entity for r in got] == ["99", "88", "77", "66", "55", "44", "33", "22"]
    assert [r.nth for r in got] == list(range(1, 9))


def test_top_entities_break_ties_by_entity(spark):
    rows = [("org", e) for e in ["b", "a", "c", "c", "1998", "1998", "1998"]]
    got = top_entities(book(spark, rows), 2).orderBy("nth").collect()
    assert [(r.entity, r["count"]) for r in got] == [("c", 2), ("a", 1)]


def test_maps_follow_the_report_order_and_end_with_own_rules(spark):
    own = [Rule("zebra", lambda e, s: e.length > 0), Rule("apple", lambda e, s: e.length > 0)]
    rows = [("loc", "شهر 1"), ("loc", "1998")]
    made = book(spark, rows, rules=(*RULES, *own))
    text = rule_count_maps(rule_counts(made)).filter("NOT overall").select(F.to_json("rule_counts")).first()[0]
    assert list(json.loads(text)) == [
        "digits_only_or_near",
        "year_only",
        "generic_template_phrase",
        "loc_city_plus_country",
        "loc_city_placeholder",
        "apple",
        "zebra",
    ]
    text = example_maps(examples(made)).select(F.to_json("examples_by_rule")).first()[0]
    assert json.loads(text)["year_only"] == ["1998"]


def test_packed_order_sorts_like_the_tuple(spark):
    top = 2**63 - 1
    parts = [(s, i, p) for s in (0, 7) for i in (-top, -5, 0, 3, top) for p in (0, 1, 2**31 - 1)]
    rows = spark.createDataFrame(parts, "s int, i bigint, p int").filter("s = 0 OR i >= 0")
    packed = packed_order((F.col("i"), 19), (F.col("s"), 1), (F.col("p"), 10))
    got = [tuple(r)[:3] for r in rows.withColumn("o", packed).orderBy("o").collect()]
    assert got == sorted(got, key=lambda r: (r[1], r[0], r[2]))
    with pytest.raises(ValueError, match="don't fit"):
        packed_order((F.col("a"), 19), (F.col("b"), 20))


@pytest.mark.parametrize("kind, plan_has", [("bigint", "SortAggregate"), ("string", "HashAggregate(")])
def test_mention_order_keeps_a_hash_aggregate_for_integer_keys(spark, kind, plan_has):
    rows = spark.createDataFrame(
        [("2", "content", 0, 1, "loc", "b"), ("2", "title", 9, 10, "loc", "a"), ("10", "title", 0, 1, "loc", "c")],
        "doc_id string, field string, start_char int, end_char int, context string, entity string",
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
    made = ledger(rows.repartition(2), mention_order(rows, ["doc_id"]))
    assert plan_has not in made._jdf.queryExecution().executedPlan().toString()
    first = [r.entity for r in made.orderBy("first_seen").collect()]
    assert first == (["a", "b", "c"] if kind == "bigint" else ["c", "a", "b"])


def test_one_hot_entity_is_combined_before_the_shuffle(spark):
    rows = frame(spark, [("loc", "ایران")] * 3000 + ROWS).repartition(4)
    plan = ledger(rows, F.col("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning(context")
    got = {r.context: r.rows_total for r in totals(ledger(rows, F.col("n"))).collect()}
    assert got == {"loc": 3008, "pers": 23, None: 3031}


def test_result_does_not_depend_on_partitioning(spark):
    def parts(df):
        made = ledger(df, F.col("n"))
        return [sorted(map(str, f(made).collect())) for f in (totals, rule_counts, examples, top_entities)]

    assert parts(frame(spark).repartition(7, "entity")) == parts(frame(spark).coalesce(1))


def test_nested_report(spark):
    got = {r.context: r for r in inventory_reports(book(spark)).collect()}
    assert got["loc"].rule_counts["year_only"] == 1
    assert got["loc"].top_entities_clean[0].entity == "ایران"
    assert got["loc"].top_entities_clean[0]["count"] == 3
    assert got[None].overall and got[None].rule_counts["digits_only_or_near"] == 21
    assert got["pers"].examples_by_rule["digits_only_or_near"][0] == "2020"


def test_a_clean_inventory_has_empty_maps(spark):
    (row,) = [r for r in inventory_reports(book(spark, [("org", "a")])).collect() if r.context]
    assert (row.rule_counts, row.examples_by_rule) == ({}, {})


def test_quality_job(spark, path):
    report = run_quality(frame(spark), F.col("n"), path, raw_copy=True)
    assert report.count() == 3
    clean, flagged = read_split(spark, path + "/split", "clean"), read_split(spark, path + "/split", "flagged")
    assert (clean.count(), flagged.count()) == (8, 23)
    assert "_qc_first_rule" in flagged.columns and "_qc_rules" not in clean.columns
    assert spark.read.parquet(path + "/raw").count() == 31
    assert {r.context for r in spark.read.parquet(path + "/report/totals").collect()} == {"loc", "pers", None}
    nested = spark.read.json(path + "/report/nested").filter("context = 'pers'").first()
    assert nested.thresholds.max_tokens == 7.0 and nested.rule_counts.digits_only_or_near == 20


def test_report_of_a_rerun_is_the_same(spark, path):
    def text():
        run_quality(frame(spark), F.col("n"), path)
        return sorted(r.value for r in spark.read.text(path + "/report/nested").collect())

    assert text() == text()


def test_quality_job_makes_its_rows_once(spark, path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = frame(spark)
    run_quality(rows.mapInPandas(counted, rows.schema), F.col("n"), path, raw_copy=True)
    assert seen.value == rows.count()
