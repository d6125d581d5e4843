"""Inputs that Spark derives from the driver's tables.

The tables hold Latin-script text. Persian text is made from them by a letter map and a few word
swaps, so that every stage and every rule meets rows that grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nomenroll.functions.whitespace import collapse_whitespace
from nomenroll.operators.corpus import standardize
from nomenroll.functions.ordering import packed_order
from nomenroll.operators.gazetteer import Gazetteer, build_gazetteer
from nomenroll.session import materialize

# --- Fixed values shared with the SQL side ----------------------------------------------------
WORD = "[a-zß-öø-ÿ]+"
CAPITALIZED = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
PATTERNS = {
    "PER": CAPITALIZED,
    "loc": "[a-zß-öø-ÿ]{12,}",
    "ORG": f"{CAPITALIZED} (?:of|de|la|und) [a-zß-öø-ÿ]+",
    "DATE": "[0-9]{2,}",
}
#: All six classes.
CLASS_PATTERNS = {
    "PER": CAPITALIZED,
    "LOC": "[a-zß-öø-ÿ]{12,}",
    "ORG": f"{CAPITALIZED} (?:of|de|la|und) [a-zß-öø-ÿ]+",
    "FAC": "[A-Z]{2,}",
    "PRO": "[0-9]{2,}",
    "EVENT": "(?:the|das|les|los) [a-zß-öø-ÿ]{3,}",
}
#: Matches with blanks at their ends, and of a blank alone.
PADDED_PATTERNS = {"PER": f" ?{CAPITALIZED} ?", "LOC": "[a-zß-öø-ÿ]{12,} ", "PRO": " [0-9]{2,}", "EVENT": " (?:[0-9]+ )?"}
LETTERS = (
    "abcdefghijklmnopqrstuvwxyzàâçéèêîôûüäößñáíóú,",
    "ابكدیفگهيجكلمنوپ‌رستىـشخيزَآچِّٰئؤُقعغصضطظحث،",
)
PERSIAN_WORDS = (
    (" the ", " می "),
    (" of ", " نمی "),
    (" and ", " ( "),
    (" to ", " ) "),
    (" in ", ' " '),
)
WORD_SWAPS = (
    ("the", "شهر"),
    ("of", "استان"),
    ("and", "و"),
    ("or", "یا"),
    ("in", "شمال"),
    ("on", "جنوب"),
    ("for", "شرق"),
    ("with", "غرب"),
    ("is", "این"),
    ("it", "او"),
    ("to", "&"),
    ("by", "and"),
    ("at", "or"),
    ("de", "دانشگاه"),
    ("la", "شرکت"),
    ("le", "سازمان"),
    ("que", "بندر"),
    ("der", "شمال"),
    ("die", "شهر"),
    ("los", "این"),
)
CONTEXTS = ("pers", "loc", "org", "fac", "pro", "event")
YEAR_DIGITS = ("0123456789", "۰۱۲۳۴۵۶۷۸۹")
DOCUMENTS_PER_PART = 4096
#: Offsets beyond that don't fit INTEGER.
LAST_INTEGER = (1 << 31) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standardize(table(spark, sf_dir, "documents"), title="source", content="text", key=["doc_id"])


def uneven_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a capitalised source as title; contents are null for Spanish, empty for French, blank for German."""
    lang = F.col("lang")
    text = F.when(lang == "es", None).when(lang == "fr", "").when(lang == "de", " \t\n ").otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents").withColumns({"text": text, "source": F.initcap("source")})
    return standardize(docs, title="source", content="text", key=["doc_id"])


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("link", F.col("url"))
    return standardize(pages, title="url", content="html", key=["page_id"])


def spaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` and the document text with single spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", collapse_whitespace(F.col("text")).alias("text"))


def persian_text(text: Column, number: Column) -> Column:
    """Persian-script text with forms that normalization has to change."""
    result = F.lower(text)
    for old, new in PERSIAN_WORDS:
        result = F.replace(result, F.lit(old), F.lit(new))
    return F.concat(F.translate(result, *LETTERS), F.lit(" "), number.cast("string"), F.lit(".5% ..."))


def persian_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", persian_text(F.col("text"), F.col("n_chars")).alias("text")
    )


def _swap_words(text: Column) -> Column:
    result = F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit("  "))
    for old, new in WORD_SWAPS:
        result = F.replace(result, F.lit(f" {old} "), F.lit(f" {new} "))
    return result


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity strings for the rules: ``src``, ``id``, ``pos`` (their order), ``context``, ``entity``."""

    def rows(src: int, name: str, key: str, context: Column | str, entity: Column, *more: Column) -> DataFrame:
        pos = more[0] if more else F.lit(0)
        ctx = F.lit(context) if isinstance(context, str) else context
        return table(spark, sf_dir, name).select(
            F.lit(src).alias("src"),
            F.col(key).cast("bigint").alias("id"),
            pos.alias("pos"),
            ctx.alias("context"),
            entity.alias("entity"),
        )

    phrases = (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[^.,\n]+"), F.lit(0))))
        .select(
            F.lit(0).alias("src"),
            F.col("doc_id").alias("id"),
            F.col("pos"),
            F.element_at(F.array(*[F.lit(c) for c in CONTEXTS]), (F.col("doc_id") % 6 + 1).cast("int")).alias("context"),
            _swap_words(F.col("col")).alias("entity"),
        )
    )
    year = F.year("o_orderdate").cast("string")
    others = [
        rows(1, "part", "p_partkey", "pro", F.col("p_name")),
        rows(2, "customer", "c_custkey", "pers", F.col("c_name")),
        rows(3, "supplier", "s_suppkey", "org", F.col("s_name")),
        rows(4, "nation", "n_nationkey", "loc", F.col("n_name")),
        rows(5, "orders", "o_orderkey", "event", year),
        rows(6, "orders", "o_orderkey", "fac", F.translate(year, *YEAR_DIGITS)),
        rows(7, "region", "r_regionkey", "org", F.repeat("r_name", F.lit(4))),
    ]
    result = phrases
    for part in others:
        result = result.unionByName(part)
    return result


def candidate_order() -> Column:
    return packed_order((F.col("src"), 1), (F.col("id"), 19), (F.col("pos"), 10))


def one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one text, in order of their ids, with single spaces between them: a row per document, and where it begins.

    Lengths are added up in parts of the ids, and then over the parts: no task holds the text, and no row does. Where it
    begins is an INTEGER, as offsets are, unless the whole text is too long for that; then it is a BIGINT.
    """
    docs = spaced_documents(spark, sf_dir).filter(F.col("text").isNotNull())
    parts = min(max(1, docs.count() // DOCUMENTS_PER_PART), 1000)
    limits = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.aggregate(  # ids in order, null first
        F.array(*[F.lit(int(x)) for x in limits]).cast("array<bigint>"),
        F.lit(0),
        lambda n, limit: n + F.when(F.col("doc_id") > limit, 1).otherwise(0),
    ))
    size = F.char_length("text").cast("bigint") + 1
    in_order = Window.partitionBy("part").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("part", part).select("part", (F.sum(size).over(in_order) - size).alias("inside"), "text")
    placed = materialize(placed, "one-text")
    sizes = placed.groupBy("part").agg(F.sum(size).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over at most 1,001 rows
    starts = materialize(sizes.select("part", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start")), "one-text-starts")
    end = starts.agg(F.max(F.col("start") + F.col("size") - 1)).first()[0] or 0
    return placed.join(F.broadcast(starts), "part").select(
        F.lit(0).alias("doc_id"), (F.col("start") + F.col("inside")).cast("int" if end <= LAST_INTEGER else "bigint").alias("at"), "text"
    )


def word_pair_gazetteer(spark: SparkSession, sf_dir: str) -> Gazetteer:
    """Pairs of lower-case words, which overlap one another along whole sentences, typed by their length."""
    pairs = F.regexp_extract_all("text", F.lit(f"{WORD} {WORD}"), F.lit(0))
    found = spaced_documents(spark, sf_dir).select(F.explode(pairs).alias("surface")).distinct()
    kinds = F.array(*[F.lit(k) for k in ("PER", "LOC", "ORG", "FAC", "PRO", "EVENT")])
    return build_gazetteer(found.select("surface", F.element_at(kinds, F.char_length("surface") % 6 + 1).alias("type")))


def document_gazetteer(
    spark: SparkSession, sf_dir: str, broadcast_bytes: int | None = None, filter_bytes: int | None = None
) -> Gazetteer:
    """All capitalised words and word pairs, typed by their length."""
    surfaces = F.concat(
        F.regexp_extract_all("text", F.lit(CAPITALIZED), F.lit(0)),
        F.regexp_extract_all("text", F.lit(f"{CAPITALIZED} [a-zß-öø-ÿ]+"), F.lit(0)),
    )
    kinds = F.array(*[F.lit(k) for k in ("PER", "LOC", "ORG", "FAC", "PRO", "EVENT")])
    found = spaced_documents(spark, sf_dir).select(F.explode(surfaces).alias("surface")).distinct()
    typed = found.select("surface", F.element_at(kinds, F.char_length("surface") % 6 + 1).alias("type"))
    return build_gazetteer(typed, broadcast_bytes=broadcast_bytes, filter_bytes=filter_bytes)
