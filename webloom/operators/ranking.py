"""Scoring, fusion, diversification and explanation of results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.content import quality_prior
from webloom.operators.postings import documents_of, occurrences
from webloom.registry import query
from webloom.session import table

#: Weights of the fields of a document, and the constants of the score.
FIELDS = {"title": 6.0, "text": 1.0}
K1, B = 1.2, 0.75


def fielded_bm25(documents: DataFrame, queries: DataFrame, fields: dict[str, float] = FIELDS, key: str = "doc_id") -> DataFrame:
    """query_id, key, score and the score of each field.

    queries: query_id and term, a short list. Only the queries' terms leave the scan; lengths
    and document counts are aggregated beside it.
    """
    terms = queries.select("term").distinct()
    total = documents.agg(F.count("*").alias("documents"))
    scored = None
    for field, weight in fields.items():
        tokens = documents.select(key, T.tokens(F.col(field)).alias("t"))
        lengths = tokens.select(key, F.size("t").alias("length"))
        mean = lengths.agg(F.avg("length").alias("mean"))
        hits = tokens.select(key, F.explode("t").alias("term")).join(F.broadcast(terms), "term", "left_semi").groupBy("term", key).agg(F.count("*").alias("tf"))
        df = hits.groupBy("term").agg(F.count("*").alias("df"))
        joined = hits.join(F.broadcast(df), "term").join(lengths, key).crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(total))
        idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
        part = joined.select("term", key, F.lit(field).alias("field"), (weight * idf * F.col("tf") * (K1 + 1) / norm).alias("score"))
        scored = part if scored is None else scored.unionAll(part)
    by_field = [F.round(F.sum(F.when(F.col("field") == f, F.col("score")).otherwise(0.0)), 6).alias(f"{f}_score") for f in fields]
    return scored.join(F.broadcast(queries), "term").groupBy("query_id", key).agg(F.round(F.sum("score"), 6).alias("score"), *by_field)


_QUERIES = [(1, "crawler"), (1, "robots"), (2, "index"), (2, "language"), (2, "hint"), (3, "redirect"), (3, "chain")]
_Q = "q AS (SELECT unnest([1, 1, 2, 2, 2, 3, 3]) AS query_id, unnest(['crawler', 'robots', 'index', 'language', 'hint', 'redirect', 'chain']) AS term)"


def _bm25_sql() -> str:
    parts = []
    for field, weight in FIELDS.items():
        parts.append(
            f"SELECT term, doc_id, '{field}' AS field, {weight} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B} * length / mean)) AS score FROM "
            f"(SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({T.tokens_sql(field)}) AS term FROM documents) WHERE term IN (SELECT term FROM q) GROUP BY term, doc_id) h "
            f"JOIN (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({T.tokens_sql(field)}) AS term FROM documents) GROUP BY term) d USING (term) "
            f"JOIN (SELECT doc_id, len({T.tokens_sql(field)}) AS length FROM documents) l USING (doc_id) "
            f"CROSS JOIN (SELECT avg(len({T.tokens_sql(field)})) AS mean FROM documents) m CROSS JOIN (SELECT count(*) AS n FROM documents) c"
        )
    return f"{_Q}, s AS ({' UNION ALL '.join(parts)}), bm AS (SELECT query_id, doc_id, round(sum(score), 6) AS score, round(sum(CASE WHEN field = 'title' THEN score ELSE 0 END), 6) AS title_score, round(sum(CASE WHEN field = 'text' THEN score ELSE 0 END), 6) AS text_score FROM s JOIN q USING (term) GROUP BY query_id, doc_id)"


def short_queries(spark) -> DataFrame:
    return spark.createDataFrame(_QUERIES, "query_id int, term string")


@query(f"WITH {_bm25_sql()} SELECT query_id, doc_id, score FROM bm")
def r1_fielded_bm25(spark, folder):
    return fielded_bm25(documents_of(spark, folder), short_queries(spark)).select("query_id", "doc_id", "score")


@query(f"WITH {_bm25_sql()} SELECT query_id, doc_id, score, title_score, text_score FROM bm")
def r16_explain(spark, folder):
    return fielded_bm25(documents_of(spark, folder), short_queries(spark))


def results_of(spark, folder) -> DataFrame:
    """One list per run and source: position by score."""
    order = Window.partitionBy("query_id", "list").orderBy(F.desc("score"), "url", "explain_id")
    rows = table(spark, folder, "explain_results").where("url IS NOT NULL").select("*", F.coalesce("source", F.lit("none")).alias("list"))
    return rows.withColumn("rank", F.row_number().over(order))


_LISTS = "l AS (SELECT *, coalesce(source, 'none') AS list, row_number() OVER (PARTITION BY query_id, coalesce(source, 'none') ORDER BY score DESC, url, explain_id) AS rank FROM explain_results WHERE url IS NOT NULL)"


def fused(lists: DataFrame, weight: Column | None = None, k: int = 60) -> DataFrame:
    """Reciprocal ranks summed by identity; the first list supplies the payload."""
    best = lists.groupBy("query_id", "list", "url").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"))
    share = (weight if weight is not None else F.lit(1.0)) / (k + F.col("rank"))
    return best.groupBy("query_id", "url").agg(F.round(F.sum(share), 9).alias("fused"), F.min_by("list", F.struct("rank", "list")).alias("first_list"), F.count("*").alias("lists"))


_FUSED = """b AS (SELECT query_id, list, url, min(rank) AS rank FROM l GROUP BY query_id, list, url),
f AS (SELECT query_id, url, round(sum(1.0::double / (60 + rank)), 9) AS fused, arg_min(list, struct_pack(rank := rank, list := list)) AS first_list, count(*)::bigint AS lists FROM b GROUP BY query_id, url)"""


@query(f"WITH {_LISTS}, {_FUSED} SELECT query_id, url, fused, first_list, lists FROM f")
def j8_rank_fusion(spark, folder):
    return fused(results_of(spark, folder))


@query(f"WITH {_LISTS}, {_FUSED} SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, url)::int AS place FROM f")
def w1_reciprocal_rank(spark, folder):
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "url")
    return fused(results_of(spark, folder)).select("query_id", "url", F.row_number().over(order).alias("place"))


@query(f"""WITH {_LISTS}, b AS (SELECT query_id, list, url, min(rank) AS rank FROM l GROUP BY query_id, list, url)
SELECT query_id, url, round(sum((CASE list WHEN 'local' THEN 1.0 WHEN 'peer' THEN 0.8 ELSE 0.5 END)::double / (60 + rank)), 9) AS fused FROM b GROUP BY query_id, url""")
def r8_weighted_fusion(spark, folder):
    weight = F.when(F.col("list") == "local", 1.0).when(F.col("list") == "peer", 0.8).otherwise(0.5)
    return fused(results_of(spark, folder), weight).select("query_id", "url", "fused")


@query(f"WITH {_LISTS} SELECT DISTINCT query_id, url, min(rank) OVER (PARTITION BY query_id, url)::int AS rank FROM l")
def w3_first_occurrence(spark, folder):
    return results_of(spark, folder).groupBy("query_id", "url").agg(F.min("rank").alias("rank"))


@query("SELECT explain_id, source, place FROM (SELECT explain_id, source, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, explain_id)::int AS place FROM explain_results WHERE source IS NOT NULL) WHERE place <= 5")
def s24_federated_scan(spark, folder):
    """The leading rows that each node answers with."""
    order = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "explain_id")
    return table(spark, folder, "explain_results").where("source IS NOT NULL").withColumn("place", F.row_number().over(order)).where("place <= 5").select("explain_id", "source", "place")


_SITE = U.registrable_sql(U.host_sql("url"))


@query(f"""WITH {_LISTS}, {_FUSED}, p AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, url) AS place FROM f),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id, {_SITE} ORDER BY place) AS of_site FROM p)
SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY of_site > 2, place)::int AS place FROM s""")
def w2_site_crowding(spark, folder):
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "url")
    placed = fused(results_of(spark, folder)).select("query_id", "url", F.row_number().over(order).alias("place"))
    return uncrowded(placed)


def uncrowded(placed: DataFrame, most: int = 2) -> DataFrame:
    """At most two rows of a site in the head; the rest follow in order."""
    of_site = Window.partitionBy("query_id", U.registrable(U.host(F.col("url")))).orderBy("place")
    marked = placed.withColumn("late", F.row_number().over(of_site) > most)
    return marked.select("query_id", "url", F.row_number().over(Window.partitionBy("query_id").orderBy("late", "place")).alias("place"))


@query(f"""WITH {_LISTS}, strict AS (SELECT query_id, url, min(rank) AS rank FROM l WHERE list = 'local' GROUP BY query_id, url), relaxed AS (SELECT query_id, url, min(rank) AS rank FROM l GROUP BY query_id, url),
u AS (SELECT query_id, url, 0 AS branch, rank FROM strict UNION ALL SELECT query_id, url, 1, rank FROM relaxed WHERE (query_id, url) NOT IN (SELECT (query_id, url) FROM strict))
SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY branch, rank, url)::int AS place FROM u""")
def w4_strict_first(spark, folder):
    """Rows of the strict branch in their order, then the rest of the relaxed one."""
    rows = results_of(spark, folder)
    strict = rows.where("list = 'local'").groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    relaxed = rows.groupBy("query_id", "url").agg(F.min("rank").alias("rank")).join(strict, ["query_id", "url"], "left_anti")
    both = strict.withColumn("branch", F.lit(0)).unionByName(relaxed.withColumn("branch", F.lit(1)))
    order = Window.partitionBy("query_id").orderBy("branch", "rank", "url")
    return both.select("query_id", "url", F.row_number().over(order).alias("place"))


@query(f"""WITH {_LISTS} SELECT query_id, url FROM l WHERE list = 'local' UNION SELECT query_id, url FROM l WHERE list = 'web'""")
def u1_branch_union(spark, folder):
    rows = results_of(spark, folder)
    return rows.where("list = 'local'").select("query_id", "url").union(rows.where("list = 'web'").select("query_id", "url")).distinct()


@query(f"""WITH {_LISTS}, r3 AS (SELECT query_id, url, sum(1.0::double / (60 + rank)) AS s FROM (SELECT query_id, url, list = 'local' AS strict, min(rank) AS rank FROM l GROUP BY 1, 2, 3) GROUP BY query_id, url)
SELECT query_id, url, round(s, 9) AS score FROM r3""")
def r3_strict_relaxed_union(spark, folder):
    rows = results_of(spark, folder).groupBy("query_id", "url", (F.col("list") == "local").alias("strict")).agg(F.min("rank").alias("rank"))
    return rows.groupBy("query_id", "url").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))


@query("""SELECT j.query, j.url, j.grade FROM (SELECT query, url, max(grade) AS grade, count(*) AS n FROM judgments GROUP BY query, url) j""")
def u2_candidate_pool(spark, folder):
    """The union of judged rows, one per url, the best grade kept."""
    return table(spark, folder, "judgments").groupBy("query", "url").agg(F.max("grade").alias("grade"))


@query("""WITH g AS (SELECT lower(title) AS t, min(page_id) AS first FROM crawled_pages WHERE title IS NOT NULL AND title ILIKE 'why%' GROUP BY 1) SELECT t AS suggestion, first::bigint AS first FROM g ORDER BY first, t LIMIT 25""")
def u5_suggestion_merge(spark, folder):
    """Case-folded distinct suggestions in order of first appearance."""
    pages = table(spark, folder, "crawled_pages").where(F.col("title").ilike("why%"))
    return pages.groupBy(F.lower("title").alias("suggestion")).agg(F.min("page_id").alias("first")).orderBy("first", "suggestion").limit(25)


@query(f"""WITH {_LISTS} SELECT explain_id, round(score * (1 + 0.2 * (2 * q - 1) + 0.1 * 20 / (20 + octet_length(encode(trim({U.path_sql('url')}, '/'))))), 9) AS rescored FROM (SELECT *,
CASE WHEN quality_known THEN least(1.0, function_word_fraction / 0.20) * ((1 - least(1.0, symbol_fraction / 0.10)) + least(1.0, alphabetic_fraction / 0.85)) / 2 ELSE 0.5 END AS q FROM l)""")
def r5_priors(spark, folder):
    """Scores times one plus the weighted priors; an unknown quality is neutral."""
    q = F.when(F.col("quality_known"), quality_prior(F.col("function_word_fraction"), F.col("symbol_fraction"), F.col("alphabetic_fraction"))).otherwise(0.5)
    size = F.octet_length(F.regexp_replace(U.path(F.col("url")), "^/+|/+$", ""))
    return results_of(spark, folder).select("explain_id", F.round(F.col("score") * (1 + 0.2 * (2 * q - 1) + F.lit(2.0) / (20 + size)), 9).alias("rescored"))


@query("SELECT explain_id, round(score * CASE WHEN proximity_known THEN 1 + 0.12 * proximity + 0.15 * unique_token_fraction ELSE 1 END, 9) AS rescored FROM explain_results")
def r6_proximity_rescoring(spark, folder):
    factor = F.when(F.col("proximity_known"), 1 + 0.12 * F.col("proximity") + 0.15 * F.col("unique_token_fraction")).otherwise(1.0)
    return table(spark, folder, "explain_results").select("explain_id", F.round(F.col("score") * factor, 9).alias("rescored"))


@query(f"""WITH {_LISTS}, m AS (SELECT explain_id, rank, list_distinct({T.tokens_sql('l.query')}) AS terms, p.title, l.url FROM l LEFT JOIN (SELECT url, max(title) AS title FROM crawled_pages GROUP BY url) p ON l.url = p.url)
SELECT explain_id, round(0.95 * len(list_filter(terms, lambda t: contains(lower(coalesce(title, '')), t) OR contains(lower(url), t)))::double / greatest(1, len(terms)) + 0.05 / rank, 9) AS score FROM m""")
def r7_remote_scorer(spark, folder):
    """Share of the query's terms visible in title or url, and a little of the remote order."""
    titles = table(spark, folder, "crawled_pages").groupBy("url").agg(F.max("title").alias("title"))
    rows = results_of(spark, folder).select("explain_id", "rank", "url", F.array_distinct(T.tokens(F.col("query"))).alias("terms")).join(titles, "url", "left")
    title, url = F.lower(F.coalesce("title", F.lit(""))), F.lower("url")
    rows = rows.withColumns({"lt": title, "lu": url})
    seen = F.size(F.filter("terms", lambda t: F.contains(F.col("lt"), t) | F.contains(F.col("lu"), t)))
    return rows.select("explain_id", F.round(0.95 * seen / F.greatest(F.lit(1), F.size("terms")) + 0.05 / F.col("rank"), 9).alias("score"))


@query(f"WITH {_LISTS} SELECT explain_id, round(1 - 0.01 * rank, 9)::double AS score FROM l WHERE list = 'web'")
def r9_web_rows(spark, folder):
    return results_of(spark, folder).where("list = 'web'").select("explain_id", F.round(1 - 0.01 * F.col("rank"), 9).cast("double").alias("score"))


@query("""SELECT explain_id, CASE WHEN quality_known THEN quality END AS quality, CASE WHEN spam_risk_known THEN spam_risk END AS spam_risk, CASE WHEN proximity_known THEN proximity END AS proximity,
((CASE WHEN quality_known THEN 1 ELSE 0 END) + (CASE WHEN spam_risk_known THEN 2 ELSE 0 END) + (CASE WHEN proximity_known THEN 4 ELSE 0 END))::int AS present FROM explain_results""")
def r10_evidence_vector(spark, folder):
    """Missing evidence is null, never zero; the mask tells what is there."""
    names = ("quality", "spam_risk", "proximity")
    rows = table(spark, folder, "explain_results")
    mask = sum((F.when(F.col(f"{n}_known"), 1 << i).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    return rows.select("explain_id", *[F.when(F.col(f"{n}_known"), F.col(n)).alias(n) for n in names], mask.cast("int").alias("present"))


def _normal(column: str) -> Column:
    """Score over the best of the run."""
    return F.col(column) / F.max(column).over(Window.partitionBy("query_id"))


@query(f"""WITH {_LISTS}, t AS (SELECT query_id, url, explain_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, explain_id) AS place, coalesce(CASE WHEN proximity_known THEN proximity END, 0) AS lex FROM l)
SELECT explain_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN place <= 20 THEN 0 ELSE 1 END, CASE WHEN place <= 20 THEN -round(0.7 * score / best + 0.3 * lex, 9) ELSE place END, place)::int AS place
FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t)""")
def t9_lexical_rerank(spark, folder):
    """Blend of the normalised score and lexical evidence inside the leading window only."""
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "explain_id")
    lexical = F.coalesce(F.when(F.col("proximity_known"), F.col("proximity")), F.lit(0.0))
    rows = results_of(spark, folder).withColumns({"place": F.row_number().over(by_score), "lex": lexical, "normal": _normal("score")})
    head = F.col("place") <= 20
    order = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.round(0.7 * F.col("normal") + 0.3 * F.col("lex"), 9)).otherwise(F.col("place")), "place")
    return rows.select("explain_id", F.row_number().over(order).alias("place"))


@query(f"""WITH {_LISTS} SELECT explain_id, row_number() OVER (PARTITION BY query_id ORDER BY observed_at DESC NULLS LAST, explain_id)::int AS place FROM l""")
def t5_date_order(spark, folder):
    order = Window.partitionBy("query_id").orderBy(F.col("observed_at").desc_nulls_last(), "explain_id")
    return results_of(spark, folder).select("explain_id", F.row_number().over(order).alias("place"))


def candidate_window(requested: int) -> int:
    return requested if requested > 100 else min(100, max(50, 5 * requested))


@query(f"""WITH {_LISTS} SELECT explain_id FROM (SELECT explain_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url, explain_id) AS place FROM l) WHERE place <= 50""")
def t6_candidate_window(spark, folder):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url", "explain_id")
    return results_of(spark, folder).withColumn("place", F.row_number().over(order)).where(F.col("place") <= candidate_window(10)).select("explain_id")


@query("""WITH c AS (SELECT query, coalesce(cluster_id, url) AS cluster, url, grade FROM judgments) SELECT query, cluster, min(url) AS representative, max(grade) AS grade, count(*)::bigint AS rows FROM c GROUP BY query, cluster""")
def t10_cluster_consolidation(spark, folder):
    """One row per cluster at its best grade, represented by its least url."""
    rows = table(spark, folder, "judgments").withColumn("cluster", F.coalesce("cluster_id", "url"))
    return rows.groupBy("query", "cluster").agg(F.min("url").alias("representative"), F.max("grade").alias("grade"), F.count("*").alias("rows"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY nth, part, p_partkey)::int AS turn FROM (SELECT p_partkey, p_partkey % 8 AS part, row_number() OVER (PARTITION BY p_partkey % 8 ORDER BY p_retailprice DESC, p_partkey) AS nth FROM part) WHERE nth <= 5""")
def t11_partition_cover(spark, folder):
    """Every partition is covered once before any is covered again."""
    order = Window.partitionBy("part").orderBy(F.desc("p_retailprice"), "p_partkey")
    chosen = table(spark, folder, "part").withColumn("part", F.col("p_partkey") % 8).withColumn("nth", F.row_number().over(order)).where("nth <= 5")
    return chosen.select("p_partkey", F.row_number().over(Window.orderBy("nth", "part", "p_partkey")).alias("turn"))


MMR_SCHEMA = "query_id long, url string, place int"


def _mmr(rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy relevance against likeness to what is chosen; scores are scaled by the first row."""
    head = rows.sort_values(["rank", "url"]).head(50)
    left = list(zip(head["url"], head["score"] / max(float(head["score"].iloc[0]), 1e-12), map(set, head["tokens"])))
    chosen: list[tuple] = []
    while left:
        if len(head) < 3:
            best = 0
        else:
            gains = [0.7 * score - 0.3 * max((len(t & c[2]) / len(t | c[2]) if t | c[2] else 0.0 for c in chosen), default=0.0) for _, score, t in left]
            best = max(range(len(left)), key=lambda i: (gains[i], -i))
        chosen.append(left.pop(best))
    return pd.DataFrame({"query_id": head["query_id"].iloc[0], "url": [c[0] for c in chosen], "place": range(1, len(chosen) + 1)})


@query()
def t8_mmr(spark, folder):
    """Maximal marginal relevance over the leading 50 rows of a run, at most 50 rows per group."""
    titles = table(spark, folder, "crawled_pages").groupBy("url").agg(F.max("title").alias("title"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    rows = results_of(spark, folder).groupBy("query_id", "url").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where("rank <= 50")
    return rows.join(titles, "url", "left").select("query_id", "url", "score", "rank", T.diversity_tokens(F.col("title")).alias("tokens")).groupBy("query_id").applyInPandas(_mmr, MMR_SCHEMA)


def feedback_terms(documents: DataFrame, ranked: DataFrame, query_terms: list[str], best: int = 3) -> DataFrame:
    """Expansion terms from the leading documents: posterior weight of each document spread over its tokens.

    ranked: doc_id, score and rank of at most five documents, so that the work is bounded.
    """
    head = ranked.where("rank <= 5")
    top = head.agg(F.max("score").alias("top"))
    weighted = head.crossJoin(F.broadcast(top)).select("doc_id", ((1 + F.col("score") / F.col("top")) / F.col("rank")).alias("weight"))
    tokens = documents.join(F.broadcast(weighted), "doc_id").select("doc_id", "weight", F.slice(T.tokens(F.col("text")), 1, 256).alias("t"))
    spread = tokens.select("doc_id", "weight", F.size("t").alias("n"), F.explode("t").alias("term"))
    scored = spread.where((F.length("term") >= 4) & ~T.is_stop(F.col("term")) & ~F.col("term").isin(*query_terms))
    summed = scored.groupBy("term").agg(F.sum(F.col("weight") / F.col("n")).alias("weight"), F.countDistinct("doc_id").alias("documents")).where("documents >= 2")
    return summed.orderBy(F.desc("weight"), "term").limit(best).select("term", F.round("weight", 9).alias("weight"))


@query(f"""WITH {_bm25_sql()}, h AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE query_id = 2 QUALIFY rank <= 5),
w AS (SELECT doc_id, (1 + score / (SELECT max(score) FROM h)) / rank AS weight FROM h), t AS (SELECT doc_id, weight, list_slice({T.tokens_sql('text')}, 1, 256) AS t FROM documents JOIN w USING (doc_id)),
e AS (SELECT doc_id, weight, len(t) AS n, unnest(t) AS term FROM t)
SELECT term, round(sum(weight / n), 9) AS weight FROM e WHERE length(term) >= 4 AND NOT ({T.stop_sql('term')}) AND term NOT IN ('index', 'language', 'hint') GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY sum(weight / n) DESC, term LIMIT 3""")
def r4_feedback_terms(spark, folder):
    documents = documents_of(spark, folder)
    scored = fielded_bm25(documents, short_queries(spark)).where("query_id = 2")
    ranked = scored.orderBy(F.desc("score"), "doc_id").limit(5).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    return feedback_terms(documents, ranked, ["index", "language", "hint"])


def _places(documents: DataFrame, terms: list[str]) -> DataFrame:
    return occurrences(documents).where(F.col("word").isin(*terms)).select("doc_id", "word", "position")


_P = f"""o AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS position FROM (SELECT doc_id, {T.tokens_sql('text')} AS t FROM documents)), p AS (SELECT * FROM o WHERE word IN ('index', 'writer', 'checks'))"""


@query(f"""WITH {_P} SELECT doc_id, (max(CASE WHEN a.word = 'index' AND b.word = 'writer' THEN 1 ELSE 0 END) * 0.5 + max(CASE WHEN a.word = 'writer' AND b.word = 'checks' THEN 1 ELSE 0 END) * 0.5)::double AS unordered
FROM p a JOIN p b USING (doc_id) WHERE abs(a.position - b.position) BETWEEN 1 AND 8 GROUP BY doc_id HAVING unordered > 0""")
def w6_unordered_pairs(spark, folder):
    """Share of neighbouring query words that stand within eight tokens of each other."""
    return pair_share(_places(documents_of(spark, folder), ["index", "writer", "checks"]), ["index", "writer", "checks"], 8, ordered=False).withColumnRenamed("share", "unordered")


def pair_share(places: DataFrame, terms: list[str], window: int, ordered: bool) -> DataFrame:
    a, b = places.select("doc_id", F.col("word").alias("wa"), F.col("position").alias("pa")), places.select("doc_id", F.col("word").alias("wb"), F.col("position").alias("pb"))
    gap = F.col("pb") - F.col("pa")
    met = a.join(b, "doc_id").where((gap == 1) if ordered else F.abs(gap).between(1, window))
    pairs = list(zip(terms, terms[1:]))
    share = sum((F.max(F.when((F.col("wa") == x) & (F.col("wb") == y), 1).otherwise(0)) for x, y in pairs), F.lit(0)) * (1.0 / len(pairs))
    return met.groupBy("doc_id").agg(share.cast("double").alias("share")).where("share > 0")


@query(f"""WITH {_P} SELECT doc_id, (max(CASE WHEN a.word = 'index' AND b.word = 'writer' THEN 1 ELSE 0 END) * 0.5 + max(CASE WHEN a.word = 'writer' AND b.word = 'checks' THEN 1 ELSE 0 END) * 0.5)::double AS ordered
FROM p a JOIN p b USING (doc_id) WHERE b.position - a.position = 1 GROUP BY doc_id HAVING ordered > 0""")
def w7_ordered_pairs(spark, folder):
    return pair_share(_places(documents_of(spark, folder), ["index", "writer", "checks"]), ["index", "writer", "checks"], 8, ordered=True).withColumnRenamed("share", "ordered")


@query(f"""WITH {_P}, g AS (SELECT a.doc_id, min(b.position - a.position) AS gap FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position > a.position WHERE a.word = 'index' AND b.word = 'checks' GROUP BY a.doc_id)
SELECT doc_id, round(CASE WHEN gap = 2 THEN 1.0 ELSE 1.0 / (1 + abs(gap - 2)) END, 9)::double AS agreement FROM g""")
def w8_gap_agreement(spark, folder):
    """Closeness of the nearest forward distance to the distance in the query."""
    places = _places(documents_of(spark, folder), ["index", "checks"])
    a, b = places.where("word = 'index'").select("doc_id", F.col("position").alias("pa")), places.where("word = 'checks'").select("doc_id", F.col("position").alias("pb"))
    gaps = a.join(b, "doc_id").where("pb > pa").groupBy("doc_id").agg(F.min(F.col("pb") - F.col("pa")).alias("gap"))
    return gaps.select("doc_id", F.round(F.when(F.col("gap") == 2, 1.0).otherwise(1.0 / (1 + F.abs(F.col("gap") - 2))), 9).alias("agreement"))


@query(f"""WITH {_P}, e AS (SELECT doc_id, position AS stop, word, max(CASE WHEN word = 'index' THEN position END) OVER w AS a, max(CASE WHEN word = 'writer' THEN position END) OVER w AS b, max(CASE WHEN word = 'checks' THEN position END) OVER w AS c
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, round(3.0 / min(stop - least(a, b, c) + 1), 9)::double AS cover FROM e WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY doc_id""")
def w5_covering_window(spark, folder):
    """Different terms over the shortest span that holds all of them: latest place of each term at every place."""
    terms = ["index", "writer", "checks"]
    frame = Window.partitionBy("doc_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    places = _places(documents_of(spark, folder), terms)
    latest = [F.max(F.when(F.col("word") == t, F.col("position"))).over(frame).alias(t) for t in terms]
    whole = places.select("doc_id", "position", *latest).dropna(subset=terms)
    return whole.groupBy("doc_id").agg(F.round(3.0 / F.min(F.col("position") - F.least(*terms) + 1), 9).alias("cover"))


@query(f"""WITH {_LISTS} SELECT explain_id, list_aggregate(list_filter([CASE WHEN score > 5 THEN 'strong match' END, CASE WHEN proximity_known AND proximity > 0.5 THEN 'words close together' END, CASE WHEN quality_known AND quality > 0.7 THEN 'well written' END,
CASE WHEN spam_risk_known AND spam_risk > 0.5 THEN 'may be spam' END], lambda x: x IS NOT NULL), 'string_agg', '; ') AS reasons FROM l""")
def z18_result_reasons(spark, folder):
    """Labels that the evidence of a result allows; null without any."""
    rules = [(F.col("score") > 5, "strong match"), (F.col("proximity_known") & (F.col("proximity") > 0.5), "words close together"), (F.col("quality_known") & (F.col("quality") > 0.7), "well written"), (F.col("spam_risk_known") & (F.col("spam_risk") > 0.5), "may be spam")]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rules]))
    return results_of(spark, folder).select("explain_id", F.when(F.size(found) > 0, F.array_join(found, "; ")).alias("reasons"))


__all__ = ["fielded_bm25", "fused", "uncrowded"]
