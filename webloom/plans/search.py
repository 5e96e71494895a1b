"""A whole search: request, candidates, scores, priors, diversity, page, snippets, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.operators.content import corrections
from webloom.operators.filters import has_phrase, minimum_should_match, near_words
from webloom.operators.postings import vocabulary
from webloom.operators.ranking import FIELDS, fielded_bm25
from webloom.plans.request import Request, parse, requirements, validated
from webloom.session import table


def filtered(documents: DataFrame, request: Request) -> DataFrame:
    """Predicates that need no index; they reach the scan."""
    out = documents
    if request.language:
        out = out.where(F.lower(F.trim("lang")).startswith(request.language[:2]))
    if request.site:
        out = out.where(F.lower("source") == request.site)
    if request.author:
        out = out.where(F.col("title").ilike(f"%{request.author}%"))
    if request.since:
        out = out.where(F.col("created_at") >= F.lit(request.since).cast("timestamp"))
    if request.until:
        out = out.where(F.col("created_at") <= F.lit(request.until).cast("timestamp"))
    tokens = T.tokens(F.col("text"))
    for phrase in request.phrases:
        out = out.where(has_phrase(tokens, phrase.split()))
    for phrase in request.excluded_phrases:
        out = out.where(~has_phrase(tokens, phrase.split()))
    for term in request.excluded:
        out = out.where(~F.array_contains(tokens, term))
    if request.near and len(request.terms) > 1:
        out = out.join(near_words(out, request.terms), "doc_id", "left_semi")
    return out


def matches(documents: DataFrame, request: Request, least: int | None = None) -> DataFrame:
    """doc_id, score and matched terms of the documents that hold enough of the terms."""
    spark = documents.sparkSession
    terms = [t for _, t in requirements(request)]
    if not terms:
        return documents.select("doc_id", F.lit(0.0).alias("score"))
    queries = spark.createDataFrame([(1, t) for t in terms], "query_id int, term string")
    kept = filtered(documents, request)
    held = F.size(F.array_intersect(T.tokens(F.concat_ws(" ", "title", "text")), F.array(*[F.lit(t) for t in terms])))
    enough = kept.where(held >= (least if least is not None else len(terms))).select("doc_id")
    return fielded_bm25(documents, queries, FIELDS).drop("query_id").join(enough, "doc_id", "left_semi").select("doc_id", "score")


def search(spark: SparkSession, folder: str, raw: str, limit: int = 10, offset: int = 0) -> DataFrame:
    """place, doc_id, title, score and passage of one page of results.

    Strict matches come first, then those of the relaxed minimum; at most two of one source
    stand in the head; the page is cut last. Only its rows are joined to their bodies.
    """
    documents = table(spark, folder, "documents")
    request = validated(parse(raw, limit, offset))
    terms = [t for _, t in requirements(request)]
    strict = matches(documents, request)
    relaxed = matches(documents, request, minimum_should_match(len(terms))).join(strict.select("doc_id"), "doc_id", "left_anti")
    both = strict.withColumn("branch", F.lit(0)).unionByName(relaxed.withColumn("branch", F.lit(1)))
    head = both.orderBy("branch", F.desc("score"), "doc_id").limit(max(100, 5 * (request.limit + request.offset)))
    joined = head.join(documents.select("doc_id", "title", "text", "source", "created_at"), "doc_id")
    of_source = F.row_number().over(Window.partitionBy("source").orderBy("branch", F.desc("score"), "doc_id"))
    marked = joined.withColumn("crowded", of_source > 2)
    order = [F.col("created_at").desc_nulls_last()] if request.newest_first else ["branch", "crowded", F.desc("score")]
    placed = marked.withColumn("place", F.row_number().over(Window.orderBy(*order, "doc_id")))
    page = placed.where((F.col("place") > request.offset) & (F.col("place") <= request.offset + request.limit))
    return page.select("place", "doc_id", "title", F.round("score", 6).alias("score"), T.snippet(F.col("text"), terms).alias("passage"))


def suggestions(spark: SparkSession, folder: str, raw: str, best: int = 3) -> DataFrame:
    """Spelling alternatives of the terms that no document holds (term, word, edits)."""
    documents = table(spark, folder, "documents")
    terms = parse(raw).terms
    words = vocabulary(documents)
    asked = spark.createDataFrame([(t,) for t in terms] or [("",)], "term string")
    unknown = asked.join(words.select(F.col("word").alias("term")), "term", "left_anti").where("term <> ''")
    return corrections(unknown, words, best)


def recovered(spark: SparkSession, folder: str, raw: str, limit: int = 10) -> DataFrame:
    """A search that, when nothing is found, is run again with the best spelling of each term."""
    found = search(spark, folder, raw, limit)
    if not found.isEmpty():
        return found
    better = {r.term: r.word for r in suggestions(spark, folder, raw, 1).collect()}
    words = [better.get(t, t) for t in parse(raw).terms]
    return search(spark, folder, " ".join(words), limit)
