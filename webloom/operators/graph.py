"""Links between pages and sites: inlinks, citations, authority and walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.content import duplicate_pairs
from webloom.registry import query
from webloom.session import cut, table

DAMPING, ITERATIONS = 0.85, 40


def edges_of(spark, folder) -> DataFrame:
    """source, target and target host of each link of a page."""
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL AND links IS NOT NULL")
    return pages.select("page_id", F.col("url").alias("source"), F.explode("links").alias("target"))


_E = f"""e AS (SELECT page_id, url AS source, unnest(links) AS target FROM crawled_pages WHERE url IS NOT NULL AND links IS NOT NULL),
h AS (SELECT page_id, source, target, {U.registrable_sql(U.host_sql('source'))} AS s, {U.registrable_sql(U.host_sql('target'))} AS t FROM e)"""


def sites(edges: DataFrame) -> DataFrame:
    return edges.select("*", U.registrable(U.host(F.col("source"))).alias("s"), U.registrable(U.host(F.col("target"))).alias("t"))


@query(f"WITH {_E} SELECT target, count(*)::bigint AS inlinks, count(DISTINCT s)::bigint AS sites FROM h GROUP BY target")
def j10_inlinks(spark, folder):
    return sites(edges_of(spark, folder)).groupBy("target").agg(F.count("*").alias("inlinks"), F.countDistinct("s").alias("sites"))


@query(f"WITH {_E} SELECT s AS source_host, t AS target_host, count(*)::bigint AS links FROM h WHERE s <> t GROUP BY s, t")
def j20_host_links(spark, folder):
    return sites(edges_of(spark, folder)).where("s <> t").groupBy(F.col("s").alias("source_host"), F.col("t").alias("target_host")).agg(F.count("*").alias("links"))


@query(f"WITH {_E}, g AS (SELECT t, s, count(*) AS n FROM h WHERE s <> t GROUP BY t, s) SELECT t AS host, string_agg(s || ':' || n, ',' ORDER BY s) AS sources FROM g GROUP BY t")
def g3_host_link_graph(spark, folder):
    counted = sites(edges_of(spark, folder)).where("s <> t").groupBy("t", "s").agg(F.count("*").alias("n"))
    listed = counted.groupBy(F.col("t").alias("host")).agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("l"))
    return listed.select("host", F.array_join(F.transform("l", lambda x: F.concat(x["s"], F.lit(":"), x["n"].cast("string"))), ",").alias("sources"))


@query(f"WITH {_E} SELECT DISTINCT page_id, target, 0.4::double AS confidence FROM h WHERE source <> target")
def z21_citations(spark, folder):
    """Links without anchor evidence cite with confidence 0.4; a page does not cite itself."""
    return edges_of(spark, folder).where("source <> target").select("page_id", "target").distinct().withColumn("confidence", F.lit(0.4))


def votes(citations: DataFrame, per_edge: int = 8) -> DataFrame:
    """s, t, confidence, quality (citing pages) -> weight and confidence of each edge between sites."""
    order = Window.partitionBy("s", "t").orderBy(F.desc("confidence"), "page_id")
    top = citations.groupBy("s", "t", "page_id").agg(F.max("confidence").alias("confidence")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_edge)
    return top.groupBy("s", "t").agg(F.log2(1 + F.sum("confidence")).alias("weight"), (1 - F.exp(-F.count("*") / 3.0)).alias("confidence"))


@query(f"""WITH {_E}, p AS (SELECT DISTINCT s, t, page_id FROM h WHERE s <> t), r AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY page_id) AS nth FROM p)
SELECT s AS source_host, t AS target_host, round(log2(1 + 0.4 * count(*)), 9) AS weight, round(1 - exp(-count(*) / 3.0), 9) AS confidence FROM r WHERE nth <= 8 GROUP BY s, t""")
def a7_domain_votes(spark, folder):
    cited = sites(edges_of(spark, folder)).where("s <> t").withColumn("confidence", F.lit(0.4))
    return votes(cited).select(F.col("s").alias("source_host"), F.col("t").alias("target_host"), F.round("weight", 9).alias("weight"), F.round("confidence", 9).alias("confidence"))


@query(f"""WITH {_E}, k AS (SELECT s, t, page_id, target, md5(page_id || ' ' || target) AS h FROM h), r AS (SELECT DISTINCT s, t, page_id, target, h FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY h) AS nth FROM r)
SELECT page_id, target FROM o WHERE nth <= 8 ORDER BY h LIMIT 500""")
def a8_citation_sample(spark, folder):
    """The citations of least hash, at most eight per edge: a sample that does not depend on order."""
    rows = sites(edges_of(spark, folder)).select("s", "t", "page_id", "target").distinct().withColumn("h", F.md5(F.concat_ws(" ", F.col("page_id").cast("string"), "target")))
    kept = rows.withColumn("nth", F.row_number().over(Window.partitionBy("s", "t").orderBy("h"))).where("nth <= 8")
    return kept.orderBy("h").limit(500).select("page_id", "target")


def page_rank(edges: DataFrame, iterations: int = ITERATIONS, teleport: DataFrame | None = None, blend: float = 0.0) -> DataFrame:
    """node, authority (scaled to the largest) and confidence of a weighted graph s -> t.

    Weight of nodes without outgoing edges is spread over all. teleport (node) draws the
    share `blend` of the jumps to trusted nodes. Lineage is cut by a reliable checkpoint.
    """
    edges = cut(edges.groupBy("s", "t").agg(F.sum("weight").alias("weight")))
    out = edges.groupBy("s").agg(F.sum("weight").alias("out"))
    shares = cut(edges.join(out, "s").select("s", "t", (F.col("weight") / F.col("out")).alias("share")))
    names = edges.select(F.col("s").alias("node")).union(edges.select("t")).distinct()
    nodes = names.join(out.select(F.col("s").alias("node"), F.lit(False).alias("dangling")), "node", "left").select("node", F.coalesce("dangling", F.lit(True)).alias("dangling"))
    if teleport is not None:
        nodes = nodes.join(teleport.select("node", F.lit(1.0).alias("trusted")).distinct(), "node", "left").na.fill(0.0, ["trusted"])
    else:
        nodes = nodes.withColumn("trusted", F.lit(0.0))
    totals = nodes.agg(F.count("*").alias("n"), F.sum("trusted").alias("k")).collect()[0]
    n, k = totals.n, totals.k or 0.0
    if not n:
        return nodes.select("node", F.lit(0.0).alias("authority"), F.lit(0.0).alias("confidence"))
    uniform = F.lit(1.0 / n)
    jump = F.lit(1 - blend) * uniform + F.lit(blend) * F.col("trusted") / max(k, 1.0) if k else uniform
    ranks = cut(nodes.select("node", "dangling", jump.alias("jump"), uniform.alias("rank")))
    for i in range(1, iterations + 1):
        lost = ranks.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        flow = ranks.select(F.col("node").alias("s"), "rank").join(shares, "s").groupBy(F.col("t").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        new = (1 - DAMPING) * F.col("jump") + DAMPING * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("jump"))
        step = ranks.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "dangling", "jump", new.alias("rank"))
        # three branches read the ranks, so every step is written once and its lineage cut
        ranks = cut(step)
    top = ranks.agg(F.max("rank").alias("top"))
    cited = edges.groupBy(F.col("t").alias("node")).agg(F.count("*").alias("citing"))
    return (
        ranks.crossJoin(F.broadcast(top))
        .join(cited, "node", "left")
        .select("node", (F.col("rank") / F.col("top")).alias("authority"), (1 - F.exp(-F.coalesce("citing", F.lit(0)) / 3.0)).alias("confidence"))
    )


def _rank_sql(iterations: int) -> str:
    """The same iterations unrolled."""
    parts = [
        f"{_E}, w AS MATERIALIZED (SELECT s, t, log2(1 + 0.4 * count(*)) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY page_id) AS nth FROM (SELECT DISTINCT s, t, page_id FROM h WHERE s <> t)) WHERE nth <= 8 GROUP BY s, t)",
        "o AS MATERIALIZED (SELECT s, sum(weight) AS out FROM w GROUP BY s)",
        "n AS MATERIALIZED (SELECT node, node NOT IN (SELECT s FROM o) AS dangling FROM (SELECT s AS node FROM w UNION SELECT t FROM w))",
        "r0 AS MATERIALIZED (SELECT node, dangling, 1.0::double / (SELECT count(*) FROM n) AS jump, 1.0::double / (SELECT count(*) FROM n) AS rank FROM n)",
    ]
    for i in range(1, iterations + 1):
        p = f"r{i - 1}"
        parts.append(
            f"r{i} AS MATERIALIZED (SELECT {p}.node, dangling, jump, {1 - DAMPING} * jump + {DAMPING} * (coalesce(flow, 0) + (SELECT coalesce(sum(rank), 0) FROM {p} WHERE dangling) * jump) AS rank "
            f"FROM {p} LEFT JOIN (SELECT w.t AS node, sum({p}.rank * w.weight / o.out) AS flow FROM {p} JOIN w ON w.s = {p}.node JOIN o ON o.s = w.s GROUP BY w.t) f ON f.node = {p}.node)"
        )
    return f"WITH {', '.join(parts)} SELECT node, round(rank / (SELECT max(rank) FROM r{iterations}), 6) AS authority, round(1 - exp(-coalesce((SELECT count(*) FROM w WHERE w.t = node), 0) / 3.0), 6) AS confidence FROM r{iterations}"


@query(_rank_sql(ITERATIONS))
def g1_host_rank(spark, folder):
    cited = sites(edges_of(spark, folder)).where("s <> t").withColumn("confidence", F.lit(0.4))
    return page_rank(votes(cited).select("s", "t", "weight")).select("node", F.round("authority", 6).alias("authority"), F.round("confidence", 6).alias("confidence"))


@query()
def g2_trusted_authority(spark, folder):
    """As g1, with a quarter of the jumps to trusted sites."""
    cited = sites(edges_of(spark, folder)).where("s <> t").withColumn("confidence", F.lit(0.4))
    trusted = spark.createDataFrame([("orvanet.example",), ("nelven2.test",)], "node string")
    return page_rank(votes(cited).select("s", "t", "weight"), teleport=trusted, blend=0.25).select("node", F.round("authority", 6).alias("authority"))


@query(f"""WITH {_E}, u AS (SELECT page_id, {U.registrable_sql(U.host_sql('url'))} AS site FROM crawled_pages WHERE url IS NOT NULL), c AS (SELECT t, count(DISTINCT s) AS citing FROM h WHERE s <> t GROUP BY t)
SELECT page_id, coalesce(citing, 0)::bigint AS citing FROM u LEFT JOIN c ON c.t = u.site""")
def j9_authority_lookup(spark, folder):
    citing = sites(edges_of(spark, folder)).where("s <> t").groupBy(F.col("t").alias("site")).agg(F.countDistinct("s").alias("citing"))
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", U.registrable(U.host(F.col("url"))).alias("site"))
    return pages.join(citing, "site", "left").select("page_id", F.coalesce("citing", F.lit(0)).alias("citing"))


def crawl_walk(edges: DataFrame, seeds: DataFrame, depth: int, breadth: int) -> DataFrame:
    """Breadth-first frontier: urls with the depth at which they are first met; breadth links per page."""
    chosen = cut(edges.withColumn("nth", F.row_number().over(Window.partitionBy("s").orderBy("t"))).where(F.col("nth") <= breadth).select("s", "t"))
    seen = cut(seeds.select("url", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.join(chosen, F.col("url") == F.col("s")).select(F.col("t").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        frontier = cut(new.select("url", F.lit(level).alias("depth")))
        seen = cut(seen.unionByName(frontier))
    return seen


@query(f"""WITH RECURSIVE {_E}, g AS (SELECT s, t FROM (SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY t) AS nth FROM (SELECT DISTINCT s, t FROM h WHERE s <> t)) WHERE nth <= 2),
w AS (SELECT min(s) AS url, 0 AS depth FROM g UNION SELECT g.t, w.depth + 1 FROM w JOIN g ON g.s = w.url WHERE w.depth < 3) SELECT url, min(depth)::int AS depth FROM w GROUP BY url""")
def g5_crawl_walk(spark, folder):
    edges = sites(edges_of(spark, folder)).where("s <> t").select("s", "t").distinct()
    return crawl_walk(edges, edges.agg(F.min("s").alias("url")), 3, 2)


def components(pairs: DataFrame) -> DataFrame:
    """node and the least node of its connected part, by spreading labels until none changes."""
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        offers = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        low = labels.union(offers).groupBy("node").agg(F.min("label").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lower"))
        new = cut(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("lower", "low")).alias("label")))
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels


def content_clusters(pages: DataFrame) -> DataFrame:
    """page_id and cluster of every page: connected parts over equal text, equal address and near-duplicate text."""
    alone = pages.select(F.col("page_id").alias("a"), F.col("page_id").alias("b"))
    texts = pages.where(F.length("text") > 0)
    hashed = [
        rows.select(F.sha2(F.encode(c, "utf-8"), 256).alias("k"), F.col("page_id").alias("b")) for c, rows in (("text", texts), ("url", pages.where("url IS NOT NULL")))
    ]
    equal = [rows.join(rows.groupBy("k").agg(F.min("b").alias("a")), "k").select("a", "b") for rows in hashed]
    # texts without a token have no sequences to be alike in
    near = duplicate_pairs(texts.where(F.col("text").rlike("[\\p{L}\\p{Nd}]")), "page_id").select("a", "b")
    pairs = alone.union(equal[0]).union(equal[1]).union(near)
    return components(pairs).select(F.col("node").alias("page_id"), F.col("label").alias("cluster"))


@query()
def g4_content_clusters(spark, folder):
    """Pages of equal or near-duplicate content (five words, 0.8) and equal address joined to clusters; the least page represents one."""
    return content_clusters(table(spark, folder, "crawled_pages"))
