"""Hooks, formats built from columns, request rules and refreshes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.content import _STEM, stemmed
from webloom.operators.postings import _OCC, documents_of, postings, vocabulary
from webloom.operators.ranking import _bm25_sql, fielded_bm25, short_queries
from webloom.operators.reading import _escaped
from webloom.plans.request import parse, requirements
from webloom.registry import query
from webloom.session import checkpoint_dir, cut, table
from webloom.sources.formats import parse_files
from webloom.sources.html import main_content


def parsed_queries(batches):
    for batch in batches:
        rows = []
        for raw in batch["query"]:
            r = parse(raw)
            rows.append((raw, " ".join(r.terms), " ".join(r.excluded), len(requirements(r))))
        yield pd.DataFrame(rows, columns=["query", "terms", "excluded", "required"])


@query(f"""WITH q AS (SELECT DISTINCT query FROM explain_results WHERE query IS NOT NULL), t AS (SELECT query, list_distinct(string_split(lower(query), ' ')) AS w FROM q)
SELECT query, lower(query) AS terms, '' AS excluded, (CASE WHEN len(list_filter(w, lambda x: NOT ({T.stop_sql('x')}))) > 0 THEN len(list_filter(w, lambda x: NOT ({T.stop_sql('x')}))) ELSE len(w) END)::int AS required FROM t""")
def f1_query_parser(spark, folder):
    """The queries of the log as requests; f2 and z7 are its goal words and requirements."""
    asked = table(spark, folder, "explain_results").where("query IS NOT NULL").select("query").distinct()
    return asked.mapInPandas(parsed_queries, "query string, terms string, excluded string, required int")


@query("""SELECT doc_id, length(CASE WHEN len(k) > 0 THEN array_to_string(k, chr(10)) ELSE text END)::bigint AS size FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 80 OR regexp_matches(trim(x), '[.!?]$')) AS k FROM documents WHERE text IS NOT NULL)""")
def s9_main_content(spark, folder):
    return documents_of(spark, folder).where("text IS NOT NULL").select("doc_id", F.length(main_content(F.col("text"))).cast("long").alias("size"))


def _as_files(documents: DataFrame, extension: str, content: Column) -> DataFrame:
    return documents.where("title IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(f".{extension}")).alias("path"), F.encode(content, "utf-8").alias("content"))


@query("""SELECT doc_id || '.md' AS path, trim(title) AS title FROM documents WHERE title IS NOT NULL UNION ALL SELECT doc_id || '.svg', title FROM documents WHERE title IS NOT NULL
UNION ALL SELECT doc_id || '.vcf', title FROM documents WHERE title IS NOT NULL""")
def s13_file_formats(spark, folder):
    """Titles written as Markdown, SVG and vCard files and read by the format parsers (s17, s18)."""
    documents, title = documents_of(spark, folder), F.col("title")
    files = _as_files(documents, "md", F.concat(F.lit("# "), title, F.lit("\n\nbody")))
    files = files.unionAll(_as_files(documents, "svg", F.concat(F.lit('<svg xmlns="s"><title>'), _escaped(title), F.lit("</title></svg>"))))
    files = files.unionAll(_as_files(documents, "vcf", F.concat(F.lit("BEGIN:VCARD\nFN:"), title, F.lit("\nEND:VCARD"))))
    return parse_files(files).select("path", "title")


@query(f"""WITH {_OCC}, f AS (SELECT DISTINCT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'standard' END AS analyzer FROM documents), p AS (SELECT DISTINCT doc_id, word AS term, 'standard' AS analyzer FROM postings UNION SELECT DISTINCT doc_id, {_STEM}, 'en' FROM postings)
SELECT DISTINCT p.doc_id FROM p JOIN f USING (doc_id, analyzer) WHERE (analyzer = 'en' AND term = regexp_replace('crawlers', '^(.{{4,60}}?)(ations|ation|ungen|ements|ement|ings|ing|ung|ions|ion|ers|en|er|es|ed|s|e)$', '\\1')) OR (analyzer = 'standard' AND term = 'crawlers')""")
def r2_analyzer_fan_out(spark, folder):
    """A query term in the form of each analyzer, matched with documents of that analyzer."""
    documents = documents_of(spark, folder)
    analyzer = F.when(F.col("lang") == "en", "en").otherwise("standard")
    index = postings(documents).select("doc_id", "word")
    terms = index.select("doc_id", F.col("word").alias("term"), F.lit("standard").alias("analyzer")).union(index.select("doc_id", stemmed(F.col("word")), F.lit("en"))).distinct()
    asked = spark.createDataFrame([("crawlers",)], "word string").select(F.col("word").alias("standard"), stemmed(F.col("word")).alias("en"))
    wanted = asked.select(F.expr("stack(2, 'standard', standard, 'en', en) AS (analyzer, term)"))
    own = documents.select("doc_id", analyzer.alias("analyzer"))
    return terms.join(F.broadcast(wanted), ["analyzer", "term"], "left_semi").join(own, ["doc_id", "analyzer"], "left_semi").select("doc_id").distinct()


@query(f"""WITH {_bm25_sql()}, h AS (SELECT query_id, doc_id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
o AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS p FROM (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents WHERE doc_id IN (SELECT doc_id FROM h)))
SELECT h.query_id, h.doc_id, o.term, min(p)::int AS first, count(*)::bigint AS places FROM h JOIN q USING (query_id) JOIN o ON o.doc_id = h.doc_id AND o.term = q.term GROUP BY ALL""")
def r15_stored_evidence(spark, folder):
    """Positions of the query's terms in the bodies of each run's leading ten documents (r14)."""
    documents, asked = documents_of(spark, folder), short_queries(spark)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    head = fielded_bm25(documents, asked).withColumn("nth", F.row_number().over(order)).where("nth <= 10").select("query_id", "doc_id")
    places = documents.join(head.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("p", "term"))
    return head.join(F.broadcast(asked), "query_id").join(places, ["doc_id", "term"]).groupBy("query_id", "doc_id", "term").agg(F.min("p").alias("first"), F.count("*").alias("places"))


def valued(jobs: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Crawl jobs by a caller's score of (address, pages of its host seen), best first within a host."""
    seen = F.count("*").over(Window.partitionBy("host"))
    order = Window.partitionBy("host").orderBy(F.desc("value"), "page_id")
    return jobs.withColumn("value", score(F.col("url"), seen)).withColumn("place", F.row_number().over(order))


@query(f"""WITH j AS (SELECT page_id, url, {U.host_sql('url')} AS host FROM crawled_pages WHERE url IS NOT NULL), v AS (SELECT *, round(1.0::double / length(url) + 1.0::double / count(*) OVER (PARTITION BY host), 9) AS value FROM j)
SELECT page_id, value, row_number() OVER (PARTITION BY host ORDER BY value DESC, page_id)::int AS place FROM v""")
def x2_value_scorer(spark, folder):
    jobs = table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", "url", U.host(F.col("url")).alias("host"))
    return valued(jobs, lambda url, seen: F.round(1.0 / F.length(url) + 1.0 / seen, 9)).select("page_id", "value", "place")


@query(f"""WITH v AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_filter({T.tokens_sql('text')}, lambda w: length(w) BETWEEN 4 AND 32)) AS word FROM documents) GROUP BY word HAVING count(*) >= 2)
SELECT 'vocabulary' AS signal, count(*)::bigint AS rows FROM v UNION ALL SELECT 'hosts', count(DISTINCT {U.host_sql('url')})::bigint FROM crawled_pages WHERE url IS NOT NULL""")
def m15_signal_refresh(spark, folder):
    """Corpus signals written to a new folder as a whole, then read from there."""
    base = f"{checkpoint_dir(spark)}/signals-{uuid.uuid4().hex}"
    vocabulary(documents_of(spark, folder)).write.parquet(f"{base}/vocabulary")
    table(spark, folder, "crawled_pages").where("url IS NOT NULL").select(U.host(F.col("url")).alias("host")).distinct().write.parquet(f"{base}/hosts")
    parts = [spark.read.parquet(f"{base}/{name}").agg(F.lit(name).alias("signal"), F.count("*").alias("rows")) for name in ("vocabulary", "hosts")]
    return parts[0].unionAll(parts[1]).select("signal", "rows")


class Catalog:
    """Versions of a model as JSON rows; the active one changes only from the version its caller knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.versions: list[dict] = []

    def activate(self, model: dict, expected: int | None) -> int:
        current = self.versions[-1]["version"] if self.versions else None
        if current != expected:
            raise ValueError(f"version {current} is active, not {expected}")
        entry = {"version": (current or 0) + 1, "model": json.dumps(model, sort_keys=True)}
        self.spark.createDataFrame([(entry["version"], entry["model"])], "version long, model string").coalesce(1).write.mode("append").json(self.folder)
        self.versions.append(entry)
        return entry["version"]

    def rollback(self) -> int:
        if len(self.versions) < 2:
            raise ValueError("nothing to go back to")
        return self.activate(json.loads(self.versions[-2]["model"]), self.versions[-1]["version"])

    def history(self) -> DataFrame:
        return self.spark.read.schema("version long, model string").json(self.folder)


@query("""SELECT 1::bigint AS version, '{"weight": 0.1}' AS model UNION ALL SELECT 2, '{"weight": 0.2}' UNION ALL SELECT 3, '{"weight": 0.1}'""")
def z20_model_catalog(spark, folder):
    catalog = Catalog(spark, f"{checkpoint_dir(spark)}/models-{uuid.uuid4().hex}")
    catalog.activate({"weight": 0.2}, catalog.activate({"weight": 0.1}, None))
    catalog.rollback()
    return catalog.history()


@query("""SELECT user_id, greatest(0, 20 - count(*))::bigint AS left_over, count(*) > 20 AS exhausted FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY user_id""")
def m8_rate_budget(spark, folder):
    """What is left of each user's budget of twenty in the first week."""
    used = table(spark, folder, "events").where(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz")).groupBy("user_id").agg(F.count("*").alias("n"))
    return used.select("user_id", F.greatest(F.lit(0).cast("long"), 20 - F.col("n")).alias("left_over"), (F.col("n") > 20).alias("exhausted"))


@query(f"SELECT page_id, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_extract({U.path_sql('url')}, '([^/]*)$', 1) AS file, {U.host_sql('url')} || {U.path_sql('url')} AS shown FROM crawled_pages WHERE url IS NOT NULL")
def c34_url_parts(spark, folder):
    u = F.col("url")
    return table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", U.scheme(u).alias("scheme"), F.regexp_extract(U.path(u), "([^/]*)$", 1).alias("file"), F.concat(U.host(u), U.path(u)).alias("shown"))


@query("""WITH k AS (SELECT DISTINCT url FROM crawled_pages WHERE url IS NOT NULL) SELECT count(*)::bigint AS rows, sum(CASE WHEN k.url IS NULL THEN 1 ELSE 0 END)::bigint AS orphans FROM judgments j LEFT JOIN k ON k.url = j.url""")
def m18_orphan_convergence(spark, folder):
    """How many rows point at nothing, as a scheduled join."""
    known = cut(table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("url").distinct().withColumn("known", F.lit(True)))
    rows = table(spark, folder, "judgments").join(known, "url", "left")
    return rows.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("orphans"))
