"""Queries pN_... over the tables of a data folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import body, fusion, language, mixing, near, packing, pages, pii, repeats, tokens
from webloom.llm.frames import learn
from webloom.session import cut, ship_package, table

Query = Callable[[SparkSession, str], DataFrame]


def _p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near.version_pairs(table(spark, folder, "crawl_results"))


def _p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near.version_groups(table(spark, folder, "crawl_results"))


def _left_out(facts: DataFrame) -> DataFrame:
    return pages.residue_pages(facts).union(pages.spam_pages(facts)).distinct()


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    read = pages.crawled(table(spark, folder, "crawled_pages"))
    learned = learn(read)
    return language.page_facts_with_languages(learned.on(read), learned.wrappers)


def _p2_found(spark: SparkSession, folder: str) -> DataFrame:
    facts = _languages(spark, folder)
    found = language.wrong_or_foreign(language.languages(facts))
    return found.join(_left_out(facts), "page_id", "left_anti").select("page_id", "line_no", "lang")


def _p2_languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(_languages(spark, folder)).select("page_id", "line_no", "lang", F.round("confidence", 6).alias("confidence"))


def _p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return body.frame_lines(table(spark, folder, "crawl_results"), table(spark, folder, "crawled_pages"))


def _p3_bodies(spark: SparkSession, folder: str) -> DataFrame:
    return body.main_bodies(table(spark, folder, "crawl_results"), table(spark, folder, "crawled_pages"))


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.first_places(table(spark, folder, "explain_results"))


def _p4_ranking(spark: SparkSession, folder: str) -> DataFrame:
    placed = fusion.ranking(table(spark, folder, "explain_results"))
    return placed.select("query_id", "url", "place", F.round("significance", 9).alias("significance"), F.round("mean_rank", 9).alias("mean_rank"))


def _p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, folder, "crawl_results"), table(spark, folder, "given_names"))


def _p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "crawl_results"), table(spark, folder, "given_names"))


def _p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.spam_pages(pages.judged(table(spark, folder, "crawled_pages"))[2])


def _p6_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = pages.spam_scores(pages.judged(table(spark, folder, "crawled_pages"))[2])
    return scores.select("page_id", *[F.round(c, 6).alias(c) for c in ("own", "host_rate", "spam")])


def _p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return pages.residue_pages(pages.judged(table(spark, folder, "crawled_pages"))[2])


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return cut(tokens.token_counts(table(spark, folder, "documents")))


def _p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(_sizes(spark, folder), table(spark, folder, "pack_capacities"))


def _p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(_p8_containers(spark, folder))


def _p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(table(spark, folder, "documents"), _sizes(spark, folder), table(spark, folder, "mix_targets"))


def _p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(_p9_mix(spark, folder), table(spark, folder, "mix_targets"))


def _p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_items(table(spark, folder, "documents"))


def _p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redacted(table(spark, folder, "documents"))


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run


def queries() -> dict[str, Query]:
    return {name[1:]: _shipped(f) for name, f in globals().items() if name.startswith("_p") and name[2].isdigit()}


#: The site of a url and a line up to case, spacing and digits, in SQL.
_SITE = "regexp_replace(lower(regexp_extract(url, '^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\\s]+)', 1)), '^www\\.', '')"
_LINE = "regexp_replace(lower(trim(regexp_replace(line, '[\\s\\p{Z}]+', ' ', 'g'))), '[0-9]+', '0', 'g')"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": fusion.ranking_sql("SELECT query_id, url FROM placed WHERE place = 1"),
        "p4_ranking": fusion.ranking_sql("SELECT query_id, url, place::bigint AS place, round(significance, 9) AS significance, round(mean_rank, 9) AS mean_rank FROM placed"),
        "p5_found": (
            f"WITH parts AS (SELECT result_id, url, {_SITE} AS site, string_split(raw_content, chr(10)) AS all_lines FROM crawl_results WHERE url IS NOT NULL), "
            "lines AS (SELECT result_id, url, site, unnest(all_lines) AS line, unnest(range(len(all_lines))) AS line_no FROM parts WHERE site <> ''), "
            f"keyed AS (SELECT result_id, url, site, line_no, {_LINE} AS key FROM lines), "
            "often AS (SELECT site, key FROM keyed WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT url) >= 8) "
            "SELECT result_id, line_no::integer AS line_no FROM keyed JOIN often USING (site, key)"
        ),
    }
