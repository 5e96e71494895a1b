"""Whole searches as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators.ranking import _bm25_sql
from webloom.plans import search as plans
from webloom.registry import query
from webloom.session import table


@query()
def r11_final_ranking(spark, folder):
    return plans.search(spark, folder, "crawler robots", limit=50)


@query()
def r12_zero_result_recovery(spark, folder):
    return plans.recovered(spark, folder, "crawlr redirct", limit=20)


@query(f"WITH {_bm25_sql()}, both_terms AS (SELECT query_id, doc_id, score FROM bm) SELECT doc_id, score FROM both_terms WHERE query_id = 3 ORDER BY score DESC, doc_id LIMIT 25")
def t3_streaming_top_k(spark, folder):
    """A bounded best list: the optimizer keeps 25 rows per task and merges them."""
    from webloom.operators.ranking import fielded_bm25, short_queries

    scored = fielded_bm25(table(spark, folder, "documents"), short_queries(spark)).where("query_id = 3")
    return scored.orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", "score")


@query("SELECT DISTINCT lower(title) AS suggestion FROM documents WHERE starts_with(lower(title), 'how ') AND lower(title) <> 'how '")
def c47_title_suggestions(spark, folder):
    documents = table(spark, folder, "documents")
    low = F.lower("title")
    return documents.where(low.startswith("how ") & (low != "how ")).select(low.alias("suggestion")).distinct()


@query("SELECT query, max(explain_id)::bigint AS latest FROM (SELECT lower(query) AS query, explain_id FROM explain_results WHERE starts_with(lower(query), 'p')) GROUP BY query")
def c46_recent_queries(spark, folder):
    """Recent queries of a prefix, each once, by their latest use."""
    rows = table(spark, folder, "explain_results").select(F.lower("query").alias("query"), "explain_id").where(F.col("query").startswith("p"))
    return rows.groupBy("query").agg(F.max("explain_id").alias("latest"))
