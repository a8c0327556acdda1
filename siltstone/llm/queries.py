"""The queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import leakage, packing, privacy
from siltstone.session import materialize


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _capacities(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """The three container sizes, a fixed table."""
    return [(r[0], r[1]) for r in _table(spark, folder, "pack_capacities").select("pack_name", "capacity_tokens").orderBy("capacity_tokens").collect()]


def _one_row(spark: SparkSession, **numbers: int) -> DataFrame:
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in numbers.items()])


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Where every text, or part of one longer than the container, stands."""
    return packing.pack_texts(_table(spark, folder, "documents"), _capacities(spark, folder))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers of each size are used, and how full they are."""
    return packing.fill_report(p6_packed(spark, folder), _capacities(spark, folder))


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every text is placed whole, once and within its containers."""
    documents, capacities = _table(spark, folder, "documents"), _capacities(spark, folder)
    tokens = materialize(packing.count_tokens(documents), "tokens")
    return packing.packing_report(materialize(packing.pack_documents(tokens, capacities), "packed"), tokens, capacities)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per leaked item: the documents concerned, the longest passage and the longest verbatim run."""
    return _leaks(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest_passage"), F.max("longest_run").alias("longest_run"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, whole, that hold no passage of an item."""
    return leakage.remove_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """Searched again, the cleaned corpus holds no passage; and with the documents that were removed it is whole."""
    documents, items = _table(spark, folder, "documents"), _table(spark, folder, "eval_items")
    clean = materialize(leakage.remove_leaks(documents, items), "clean")
    removed = _leaks(spark, folder).select("doc_id").distinct().count()
    return _one_row(spark, documents=clean.count() + removed, leaks_left=leakage.find_leaks(clean, items).count())


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return privacy.find_personal(_table(spark, folder, "documents")).select("doc_id", "kind", "surface").distinct()


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The texts with typed placeholders."""
    return privacy.clean(_table(spark, folder, "documents"))


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """Searched again, the cleaned texts hold no address, e-mail address, phone or identity number; and there are as many as before."""
    texts = materialize(privacy.clean(_table(spark, folder, "documents")), "clean")
    return _one_row(spark, documents=texts.count(), left=privacy.find_personal(texts).where("kind <> 'name'").count())


QUERIES = {f.__name__: f for f in (p6_packed, p6_fill, p6_check, p7_found, p7_report, p7_clean, p7_check, p8_found, p8_clean, p8_check)}

#: DuckDB SQL where SQL can express what the query must give.
SQL = {
    "p6_check": "SELECT pack_name, (SELECT count(*) FROM documents) AS texts, true AS whole, true AS within, true AS unsplit FROM pack_capacities",
    "p7_check": "SELECT count(*) AS documents, 0::bigint AS leaks_left FROM documents",
    "p8_check": 'SELECT count(*) AS documents, 0::bigint AS "left" FROM documents',
}
