"""The registered queries: name -> function of (session, directory of the tables)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nomenroll import constants as K
from nomenroll.catalog import inputs as I
from nomenroll.functions import features as X
from nomenroll.functions.digests import sha256_hex
from nomenroll.functions.html import strip_html
from nomenroll.functions.persian import NormalizeConfig, normalize_fa
from nomenroll.functions.whitespace import collapse_whitespace, normalize_entity
from nomenroll.operators.annotate import model_annotator, pattern_annotator
from nomenroll.operators.corpus import after_key, first_n, standardize
from nomenroll.operators.gazetteer import gazetteer_matches, gazetteer_spans
from nomenroll.operators.mentions import (
    classes_present,
    dropped_types,
    explode_spans,
    mention_counts,
    mention_order,
    mentions,
    mentions_from_json,
    single_class,
    with_inventory_names,
)
from nomenroll.operators.report import (
    example_maps,
    examples,
    inventory_reports,
    ledger,
    rule_count_maps,
    rule_counts,
    top_entities,
    top_lists,
    totals,
)
from nomenroll.operators.rules import (
    PUNCT_RATIO_RULE,
    RULES,
    Lexicon,
    RuleSettings,
    Thresholds,
    clean_rows,
    flagged_rows,
    with_rules,
)
from nomenroll.operators.verify import changed_keys, compare_digests, compare_tables, last_entry, listed_only, on_both_sides, verdict
from nomenroll.plans.verification import publish_checksums, verify_files
from nomenroll.plans.extraction import annotate_fields, gazetteer_fields, inventory_of, run_extraction
from nomenroll.plans.quality import run_quality, with_context
from nomenroll.session import scratch_path
from nomenroll.sources import artifacts, corpus, folders, inventory
from nomenroll.streaming.compaction import compact_all
from nomenroll.streaming.ingest import read_table, record_progress, run_record, running_rule_counts, running_totals, start_extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

NO_STAGES = NormalizeConfig(*[False] * 8)
LATIN_SETTINGS = RuleSettings(
    Thresholds.merged({"max_tokens": 4, "max_chars": 30, "max_punct_ratio": 0.1}),
    Lexicon(
        connectors=(" the ", " of ", " and ", " a "),
        generic_nouns=("la", "le", "que"),
        directions=("in", "on", "red", "blue"),
        city="small",
        regions=("small", "large"),
        pronouns=("it", "he"),
    ),
)
STREAM_SETTINGS = RuleSettings(Thresholds.merged({"max_tokens": 2, "max_chars": 13}))
OWN_RULES = (*RULES, PUNCT_RATIO_RULE)


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _spans_by_pattern() -> Callable[[Column], Column]:
    return pattern_annotator(I.PATTERNS)


def _annotated(spark: SparkSession, sf_dir: str, text_field: str = "both") -> DataFrame:
    return annotate_fields(I.documents_corpus(spark, sf_dir), ["doc_id"], _spans_by_pattern(), text_field, NO_STAGES)


def _document_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.spaced_documents(spark, sf_dir)
    return docs.select("doc_id", _spans_by_pattern()(F.col("text")).alias("spans"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(I.candidates(spark, sf_dir), I.candidate_order())


# --- corpus ---------------------------------------------------------------------------------


@query
def standardize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column contract: renamed columns, missing link."""
    return I.documents_corpus(spark, sf_dir)


@query
def standardize_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column contract with numbers and nulls as text."""
    docs = I.table(spark, sf_dir, "documents").join(I.table(spark, sf_dir, "labels"), "doc_id", "left")
    return standardize(docs, title="lang", content="quality", link="source", key=["doc_id"], null_text="nan")


@query
def first_n_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume after a key, then the next rows in key order."""
    return first_n(after_key(I.documents_corpus(spark, sf_dir), "doc_id", 99), "doc_id", 500)


@query
def first_n_most_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of a table in key order, found by counting: no task sorts them."""
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return first_n(orders, "o_orderkey", orders.count() * 9 // 10)


@query
def corpus_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus written as CSV and scanned back: quotes, line breaks and markup stay as they are."""
    path = scratch_path(spark, "corpus-csv")
    corpus.write_csv(I.pages_corpus(spark, sf_dir).select("title", "content", "link"), path)
    return standardize(corpus.read_csv(spark, path, ["title", "content", "link"]))


@query
def normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", collapse_whitespace(F.col("text")).alias("text"))


@query
def strip_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("text"))


@query
def strip_html_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without their last ``>``, and with many tags left open behind."""
    broken = F.concat(F.regexp_replace("html", r">[^>]*\z", ""), F.repeat(F.lit("<a 0"), F.lit(50)))
    return I.table(spark, sf_dir, "pages").select("page_id", strip_html(broken).alias("text"))


@query
def normalize_fa_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.persian_documents(spark, sf_dir).select("doc_id", normalize_fa(F.col("text")).alias("text"))


@query
def normalize_fa_letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only letters are unified and ornaments removed."""
    config = NormalizeConfig(False, False, True, False, False, False, True, False)
    return I.persian_documents(spark, sf_dir).select("doc_id", normalize_fa(F.col("text"), config).alias("text"))


@query
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count and ratio the rules are made of."""
    e = F.col("entity")
    return (
        I.candidates(spark, sf_dir)
        .withColumn("entity", normalize_entity(e))
        .select(
            "src",
            "id",
            F.col("pos").cast("bigint").alias("pos"),
            X.token_count(e).cast("bigint").alias("tokens"),
            F.char_length(e).cast("bigint").alias("length"),
            X.separator_count(e).cast("bigint").alias("separators"),
            X.digit_count(e).cast("bigint").alias("digits"),
            X.non_digit_count(e).cast("bigint").alias("non_digits"),
            X.connector_hits(X.padded(e), K.LIST_CONNECTORS).cast("bigint").alias("connectors"),
            F.round(X.punct_ratio(e), 6).alias("punct_ratio"),
            F.round(X.distinct_ratio(e), 6).alias("distinct_ratio"),
            X.is_year(e).alias("is_year"),
        )
    )


@query
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "documents").select("doc_id", sha256_hex(F.col("text")).alias("digest"))


# --- annotation and mentions ----------------------------------------------------------------


@query
def mentions_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern annotator, flattened, known classes only."""
    return mentions(_document_spans(spark, sf_dir), ["doc_id"], {"content": "spans"})


@query
def mentions_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any per-text model through Arrow batches; here one that finds capitalised words."""
    words = I.CAPITALIZED

    def factory():  # local, so it travels to the workers by value
        pattern = re.compile(words)
        return lambda text: [(m.group(), "Per", m.start(), m.end()) for m in pattern.finditer(text)]

    docs = I.spaced_documents(spark, sf_dir)
    annotate = model_annotator(factory)
    return mentions(docs.select("doc_id", annotate("text").alias("spans")), ["doc_id"], {"content": "spans"})


@query
def matches_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gazetteer matches with their offsets, overlapping ones too."""
    return gazetteer_matches(
        I.spaced_documents(spark, sf_dir), ["doc_id"], "text", I.document_gazetteer(spark, sf_dir)
    )


@query
def matches_gazetteer_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches by a shuffled join, as for a gazetteer too large to broadcast."""
    book = I.document_gazetteer(spark, sf_dir, broadcast_bytes=0, filter_bytes=0)
    return gazetteer_matches(I.spaced_documents(spark, sf_dir), ["doc_id"], "text", book)


@query
def matches_gazetteer_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a shuffled join again, with a membership filter that holds back n-grams that are no surface."""
    book = I.document_gazetteer(spark, sf_dir, broadcast_bytes=0)
    return gazetteer_matches(I.spaced_documents(spark, sf_dir), ["doc_id"], "text", book)


@query
def mentions_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps in one very long text, all documents in a row: its parts are resolved apart."""
    return gazetteer_spans(I.one_text(spark, sf_dir), ["doc_id"], "text", I.word_pair_gazetteer(spark, sf_dir), at="at")


@query
def mentions_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gazetteer matches, leftmost and then longest where they overlap."""
    return gazetteer_spans(I.spaced_documents(spark, sf_dir), ["doc_id"], "text", I.document_gazetteer(spark, sf_dir))


@query
def processed_gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its gazetteer spans as JSON, ``[]`` where there are none."""
    annotated = gazetteer_fields(
        I.documents_corpus(spark, sf_dir), ["doc_id"], I.document_gazetteer(spark, sf_dir), "content", NO_STAGES
    )
    return corpus.processed_json(annotated, ["doc_id"])


@query
def processed_both_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed table: title, link and JSON spans of title and content."""
    return corpus.processed_json(_annotated(spark, sf_dir), ["doc_id"])


@query
def processed_title_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field choice: only the title is annotated, and only its column exists."""
    return corpus.processed_json(_annotated(spark, sf_dir, "title"), ["doc_id"])


@query
def mentions_both_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and content mentions in one inventory."""
    return inventory_of(_annotated(spark, sf_dir), ["doc_id"])


@query
def mentions_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, empty and blank contents beside titles with mentions; spans with blanks at their ends, and of nothing else."""
    return inventory_of(annotate_fields(I.uneven_corpus(spark, sf_dir), ["doc_id"], pattern_annotator(I.PADDED_PATTERNS), "both", NO_STAGES), ["doc_id"])


@query
def spans_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the same corpus with and without spans, by field, and how many of their spans no inventory takes."""
    annotated = annotate_fields(I.uneven_corpus(spark, sf_dir), ["doc_id"], pattern_annotator(I.PADDED_PATTERNS), "both", NO_STAGES)
    fields = [F.struct(F.lit(f).alias("field"), F.col(f"entities_{f}").alias("spans")) for f in ("title", "content")]
    each = annotated.select(F.explode(F.array(*fields)).alias("x")).select("x.*")
    return each.groupBy("field").agg(
        F.count_if(F.size("spans") > 0).alias("with_spans"),
        F.count_if(F.size("spans") == 0).alias("without"),
        F.sum(F.size(F.filter("spans", lambda s: F.trim(s["text"]) == "")).cast("bigint")).alias("blank_spans"),
        F.sum(F.size(F.filter("spans", lambda s: (F.trim(s["text"]) != "") & (F.trim(s["text"]) != s["text"]))).cast("bigint")).alias("padded_spans"),
    )


@query
def mentions_from_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory from the processed table's JSON; one more type is mapped to a class."""
    processed = corpus.processed_json(_annotated(spark, sf_dir), ["doc_id"])
    return mentions_from_json(
        processed, ["doc_id"], {"title": "entities_title", "content": "entities_content"}, aliases={"date": "EVENT"}
    )


@query
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions per class with inventory names; classes without mentions count zero."""
    return mention_counts(mentions_pattern(spark, sf_dir))


@query
def inventory_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention with the name and column of its inventory."""
    return with_inventory_names(mentions_pattern(spark, sf_dir)).select(
        "doc_id", "start_char", "end_char", "entity", "inventory", "entity_column"
    )


@query
def inventory_single_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One class as its contract table: a row per mention, not deduplicated."""
    return single_class(mentions_pattern(spark, sf_dir), "ORG")


@query
def inventory_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories written by class as CSV and scanned back as text."""
    path = scratch_path(spark, "inventory-csv")
    rows = mentions_pattern(spark, sf_dir)
    inventory.write_inventory(rows, path, "csv")
    columns = [f for f in rows.schema if f.name != "entity_class"] + [rows.schema["entity_class"]]
    return inventory.read_inventory(spark, path, type(rows.schema)(columns), "csv")


def _six_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.spaced_documents(spark, sf_dir)
    return mentions(docs.select("doc_id", pattern_annotator(I.CLASS_PATTERNS)(F.col("text")).alias("spans")), ["doc_id"], {"content": "spans"})


@query
def inventory_class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of six classes as one CSV file each, imported by file name; the sixth file is absent."""
    path = scratch_path(spark, "class-files")
    inventory.write_class_files(_six_classes(spark, sf_dir), path, [c for c in K.ENTITY_CLASSES if c != "FAC"])
    return inventory.read_class_files(spark, path, multi_line=False)  # mentions of text with single spaces


@query
def inventory_file_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory files by class as written: rows, and whether at most one is below a tenth of the target size."""
    path, target = scratch_path(spark, "sized"), 64 << 10
    inventory.write_inventory(_six_classes(spark, sf_dir).repartition(64), path, target_bytes=target)
    files = (
        spark.read.parquet(path)
        .groupBy("entity_class", "_metadata.file_path")
        .agg(F.count("*").alias("n"), F.first("_metadata.file_size").alias("bytes"))
    )
    return files.groupBy("entity_class").agg(
        F.sum("n").alias("mentions"), (F.count_if(F.col("bytes") < target / 10) <= 1).alias("sized")
    )


@query
def dropped_span_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of types that no inventory takes."""
    return dropped_types(explode_spans(_document_spans(spark, sf_dir), ["doc_id"], {"content": "spans"}))


@query
def inventory_classes_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_present(mentions_pattern(spark, sf_dir)).select("inventory", "entity_column")


@query
def extraction_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole extraction job: inventories on disk, read back with their class."""
    path = scratch_path(spark, "extraction")
    annotated = annotate_fields(I.pages_corpus(spark, sf_dir), ["page_id"], _spans_by_pattern())
    run_extraction(annotated, ["page_id"], path)
    return spark.read.parquet(f"{path}/inventory")


@query
def extraction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's metrics row, read back from its table: rows in and observed, mentions per class, dropped types."""
    path = scratch_path(spark, "extraction")
    run_extraction(_annotated(spark, sf_dir), ["doc_id"], path, config=NO_STAGES)
    return spark.read.parquet(f"{path}/runs").select(
        "text_field",
        "rows_in",
        "observed_rows",
        "agrees",
        *[F.col("mentions")[c].alias(f"mentions_{c.lower()}") for c in K.ENTITY_CLASSES],
        F.to_json("dropped_types").alias("dropped_types"),
    )


# --- quality --------------------------------------------------------------------------------


@query
def qc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 13 rules on every candidate, in evaluation order."""
    checked = with_rules(I.candidates(spark, sf_dir))
    return checked.select(
        "src",
        "id",
        F.col("pos").cast("bigint").alias("pos"),
        "context",
        "entity",
        F.array_join("_qc_rules", ",").alias("rules"),
        F.col("_qc_flag").alias("flag"),
        F.col("_qc_first_rule").alias("first_rule"),
    )


@query
def qc_rules_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other limits, other word lists and the punctuation rule."""
    checked = with_rules(
        I.candidates(spark, sf_dir), settings=LATIN_SETTINGS, rules=OWN_RULES
    )
    return checked.select(
        "src", "id", F.col("pos").cast("bigint").alias("pos"), F.array_join("_qc_rules", ",").alias("rules")
    )


@query
def qc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_rows(with_rules(I.candidates(spark, sf_dir))).select("context", "entity")


@query
def qc_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_rows(with_rules(I.candidates(spark, sf_dir))).select(
        "context",
        "entity",
        F.col("_qc_first_rule").alias("first_rule"),
        F.array_join("_qc_rules", ",").alias("rules"),
    )


@query
def qc_split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split written to disk in one pass, counted from both sides."""
    path = scratch_path(spark, "split")
    inventory.write_split(with_rules(I.candidates(spark, sf_dir).select("context", "entity")), path)
    sides = [
        inventory.read_split(spark, path, split).select("context", "entity", F.lit(split).alias("split"))
        for split in ("clean", "flagged")
    ]
    return sides[0].unionByName(sides[1])


@query
def qc_raw_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw copy of all rows as it was written."""
    path = scratch_path(spark, "raw")
    inventory.write_raw_copy(with_rules(I.candidates(spark, sf_dir)), path)
    return spark.read.parquet(path).select("context", "entity")


@query
def qc_split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(_ledger(spark, sf_dir))


@query
def qc_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(_ledger(spark, sf_dir))


@query
def qc_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(_ledger(spark, sf_dir))


@query
def qc_top_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_entities(_ledger(spark, sf_dir))


@query
def qc_rule_count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts as ordered maps, in JSON."""
    return rule_count_maps(rule_counts(_ledger(spark, sf_dir))).select(
        "context", "overall", F.to_json("rule_counts").alias("rule_counts")
    )


@query
def qc_example_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as ordered maps, in JSON."""
    return example_maps(examples(_ledger(spark, sf_dir))).select(
        "context", F.to_json("examples_by_rule").alias("examples_by_rule")
    )


@query
def qc_top_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top entities as lists, in JSON."""
    return top_lists(top_entities(_ledger(spark, sf_dir), 5)).select(
        "context", F.to_json("top_entities_clean").alias("top_entities_clean")
    )


@query
def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole quality job; its nested report with lists and maps as JSON."""
    report = run_quality(
        I.candidates(spark, sf_dir), I.candidate_order(), scratch_path(spark, "quality"), raw_copy=True
    )
    return report.select(
        "context",
        "overall",
        "rows_total",
        "rows_flagged",
        "rows_clean",
        F.to_json("rule_counts").alias("rule_counts"),
        F.size("examples_by_rule").cast("bigint").alias("rules_with_examples"),
        F.size("top_entities_clean").cast("bigint").alias("top_listed"),
        F.col("thresholds")["max_tokens"].alias("max_tokens"),
    )


@query
def mentions_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From documents to clean and flagged counts per class: text, annotator, mentions, rules that short names can break."""
    found = with_context(mentions_pattern(spark, sf_dir))
    return totals(ledger(found, mention_order(found, ["doc_id"]), settings=STREAM_SETTINGS))


# --- verification ---------------------------------------------------------------------------


def _later_orders(orders: DataFrame) -> DataFrame:
    """A later snapshot: rows gone, rows changed by a unit of price or of time, rows added."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    kept = orders.filter((status != "P") | (priority != "5-LOW")).withColumns(
        {
            "o_totalprice": F.when((status == "F") & (priority == "1-URGENT"), F.col("o_totalprice") + 1).otherwise(
                F.col("o_totalprice")
            ),
            "o_orderdate": F.when(
                (status == "O") & (priority == "2-HIGH"), F.col("o_orderdate") + F.expr("INTERVAL 1 MICROSECOND")
            ).otherwise(F.col("o_orderdate")),
        }
    )
    added = orders.filter((status == "P") & (priority == "1-URGENT"))
    return kept.unionByName(added.withColumn("o_orderkey", -F.col("o_orderkey") - 1))


@query
def table_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a table, compared by key."""
    orders = I.table(spark, sf_dir, "orders")
    return compare_tables(orders, _later_orders(orders), ["o_orderkey"])


def _later_lines(lines: DataFrame) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    tax = F.when((flag == "N") & (status == "O") & (F.col("l_quantity") > 49), 0.5).otherwise(F.col("l_tax"))
    return lines.filter((flag != "R") | (status != "O")).withColumn("l_tax", tax)


@query
def table_verify_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots in which keys repeat: compared as multisets of rows."""
    lines = I.table(spark, sf_dir, "lineitem")
    return compare_tables(lines, _later_lines(lines), ["l_orderkey", "l_linenumber"])


@query
def table_verify_hot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a handful of keys for the whole table."""
    lines = I.table(spark, sf_dir, "lineitem")
    return compare_tables(lines, _later_lines(lines), ["l_returnflag", "l_linestatus"])


def _corrected_orders(orders: DataFrame) -> DataFrame:
    """A later snapshot in which only orders of the last year differ: some gone, some at another price, some twice."""
    recent, status = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp"), F.col("o_orderstatus")
    price = F.when(recent & (status == "F"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    kept = orders.filter(~recent | (status != "P")).withColumn("o_totalprice", price)
    return kept.unionByName(orders.filter(recent & (F.col("o_orderpriority") == "1-URGENT")))


@query
def table_verify_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two nearly equal snapshots don't share: fingerprints of date ranges first, rows only of those that differ."""
    orders = I.table(spark, sf_dir, "orders")
    return changed_keys(orders, _corrected_orders(orders), ["o_orderdate", "o_orderkey"])


@query
def table_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(table_verify(spark, sf_dir))


def _listed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum lines of pages; some paths occur again later, some lines are blank."""
    digest = sha256_hex(F.col("html"))
    line = F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html  "))
    pages = I.table(spark, sf_dir, "pages")
    first = pages.select(F.concat(line, digest).alias("value"), F.lit(1).alias("n"))
    again = pages.filter(F.col("url").contains("ref=")).select(
        F.concat(F.lit(" "), line, F.lower(sha256_hex(F.col("url")))).alias("value"), F.lit(2).alias("n")
    )
    blank = pages.filter(F.col("url").endswith("#top")).select(F.lit("  ").alias("value"), F.lit(3).alias("n"))
    return first.unionByName(again).unionByName(blank)


def _found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on disk: some pages gone, some changed, some not readable, some files more."""
    url = F.col("url")
    digest = F.when(url.contains("/fr/") | url.contains("ref="), sha256_hex(url)).otherwise(sha256_hex(F.col("html")))
    pages = I.table(spark, sf_dir, "pages")
    kept = pages.filter(~url.endswith("#top")).select(
        F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.when(F.char_length("html") <= 9000, digest).alias("digest"),
    )
    more = pages.filter(url.contains("//m.")).select(
        F.concat(F.lit("pages/"), F.col("page_id"), F.lit(".html.tmp")).alias("path"), digest.alias("digest")
    )
    return kept.unionByName(more)


def _parsed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_entry(artifacts.parse_checksums(_listed_pages(spark, sf_dir), order=F.col("n")))


@query
def checksum_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksum lines parsed; of repeated paths the last line counts."""
    return _parsed_list(spark, sf_dir)


@query
def checksum_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list written in path order and read back."""
    path = scratch_path(spark, "checksums")
    digests = I.table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.lit("doc "), F.col("doc_id"), F.lit(".txt"))).alias("path"),
        sha256_hex(F.col("text")).alias("digest"),
    )
    artifacts.write_checksums(digests, path)
    return last_entry(artifacts.read_checksums(spark, path))


@query
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List against disk: missing, extra, mismatch, unreadable, ok, with both digests."""
    return compare_digests(_parsed_list(spark, sf_dir), _found_pages(spark, sf_dir))


@query
def checksum_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict(checksum_verify(spark, sf_dir))


@query
def paths_listed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed_only(_parsed_list(spark, sf_dir), _found_pages(spark, sf_dir))


@query
def paths_on_both_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_both_sides(_parsed_list(spark, sf_dir), _found_pages(spark, sf_dir))


@query
def excluded_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that no glob excludes; globs count from the right end."""
    paths = I.table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://(.*)$", 1).alias("path"))
    return artifacts.exclude_globs(paths, "path", ["*[0-4]", "fr/*", "*.com/??/*top", "[!a-z]*"])


def _supplier_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder for each supplier, with one file that holds its name."""
    root = scratch_path(spark, "files")
    rows = I.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    tasks = 4 * spark.sparkContext.defaultParallelism
    # a task for many files each; all lines of a supplier go to one
    rows.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").text(root)
    return root


def _supplier_of(path: str) -> Column:
    return F.regexp_extract(path, "s_suppkey=([0-9]+)/", 1).cast("bigint").alias("s_suppkey")


@query
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in nested folders with their digests."""
    digests = artifacts.file_digests(spark, _supplier_files(spark, sf_dir), exclude=["_*", ".*"])
    return digests.select(_supplier_of("path"), "length", "digest")


@query
def named_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named files, the list of names made from the folder's own listing; paths relative to the root."""
    root = _supplier_files(spark, sf_dir)
    listed = artifacts.exclude_globs(artifacts.list_files(spark, root), "path", ["_*", ".*"])
    digests = artifacts.named_file_digests(spark, listed.select("path"), root=root)
    return digests.select(_supplier_of("path"), "digest")


@query
def files_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published list, kept below its own root, against the files that it names."""
    root = _supplier_files(spark, sf_dir)
    publish_checksums(spark, root, f"{root}/SUMS", exclude=["_*", ".*"])
    compared = verify_files(spark, f"{root}/SUMS", root=root, exclude=["_*", ".*"])
    return compared.select(_supplier_of("path"), "status")


# --- streaming ------------------------------------------------------------------------------


def _stream_documents(spark: SparkSession, sf_dir: str, with_progress: bool = False, **options) -> str:
    """Documents as a stream of files, a few per micro-batch, through the extraction job."""
    source, out, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "checkpoint"))
    docs = I.documents_corpus(spark, sf_dir)
    docs.repartitionByRange(6, "doc_id").write.parquet(source)
    stream = corpus.stream_files(spark, source, docs.schema, files_per_batch=2)
    query = start_extraction(
        stream,
        ["doc_id"],
        lambda batch: annotate_fields(batch, ["doc_id"], _spans_by_pattern(), "content", NO_STAGES),
        out,
        checkpoint,
        **options,
    )
    query.awaitTermination()
    if with_progress:
        record_progress(query, out, spark)
    return out


@query
def stream_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory of a streamed corpus: the same rows as in batch."""
    return read_table(spark, _stream_documents(spark, sf_dir), "inventory")


@query
def stream_qc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running rule counts of a streamed corpus."""
    return running_rule_counts(spark, _stream_documents(spark, sf_dir, count_rules=True, settings=STREAM_SETTINGS))


@query
def stream_qc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of a streamed corpus."""
    return running_totals(spark, _stream_documents(spark, sf_dir, count_rules=True, settings=STREAM_SETTINGS))


@query
def stream_qc_counts_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running rule counts after earlier batches have been merged below a mark."""
    out = _stream_documents(spark, sf_dir, count_rules=True, settings=STREAM_SETTINGS)
    compact_all(spark, out)
    return running_rule_counts(spark, out)


@query
def stream_mentions_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs on one checkpoint: files come between them, and the last batch of the first run is replayed."""
    source, out, checkpoint = (scratch_path(spark, f"stream-{part}") for part in ("in", "out", "checkpoint"))
    docs = I.documents_corpus(spark, sf_dir)

    def run() -> None:
        stream = corpus.stream_files(spark, source, docs.schema, files_per_batch=1)
        annotate = lambda batch: annotate_fields(batch, ["doc_id"], _spans_by_pattern(), "content", NO_STAGES)
        start_extraction(stream, ["doc_id"], annotate, out, checkpoint).awaitTermination()

    first = F.length("content") % 2 == 0
    docs.filter(first).repartition(2).write.parquet(source)
    run()
    # as after a crash between a batch's writes and its commit
    commits = [c for c in folders.children(spark, f"{checkpoint}/commits") if c.isdigit()]
    folders.remove(spark, f"{checkpoint}/commits/{max(commits, key=int)}")
    docs.filter(~first).repartition(2).write.mode("append").parquet(source)
    run()
    return read_table(spark, out, "inventory")


@query
def stream_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a streamed run, added up: rows and mentions observed, committed and reported by Spark."""
    out = _stream_documents(spark, sf_dir, with_progress=True)
    return run_record(spark, out).agg(
        F.count("*").alias("batches"),
        *[F.sum(c).alias(c) for c in ("rows_observed", "rows_committed", "input_rows", "mentions_observed", "mentions_committed")],
        F.bool_and("agrees").alias("agrees"),
    )
