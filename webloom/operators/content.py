"""Content evidence: quality rules and priors, fingerprints, near-duplicate joins, spelling and word forms."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as T
from webloom.functions import urls as U
from webloom.operators.postings import documents_of, vocabulary
from webloom.registry import query
from webloom.session import cut, table

#: Function words a readable English page holds at least two of.
FUNCTION_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")


#: Function words of five languages, as the reference lists them.
GATE_WORDS = frozenset(
    (
        "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее её мне было вот от меня еще ещё нет о из ему теперь когда "
        "даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их "
        "чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой какое какая какие совсем ним здесь этом один почти "
        "мой тем чтобы нее неё сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них много "
        "разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой такое такая такие им более всегда конечно всю между это a an and "
        "are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with what which who how when where "
        "why from has have had were been its about can do does did you your we our i me my he she his her them so than der die das den dem des und oder aber "
        "ein eine einer eines einem einen mit von zu im am um auf aus bei nach über für ist sind war waren wird werden nicht auch noch nur wie wo wer wann "
        "warum ich du er sie es wir ihr sich dass daß als le la les un une et ou mais dans sur avec sans pour par au aux de ce cette ces que qui quoi quand est "
        "sont était je tu il elle nous vous ils elles ne pas plus se sa son ses leur comme el los las uno unos unas y o pero en con sin para por lo al era fue "
        "yo tú él ella nosotros ellos qué cómo cuándo dónde porque muy más menos como si su sus mi mis te nos ya también "
    ).split()
)
#: The largest share of characters in the most frequent word sequence, and in all that repeat, by length.
TOP_SHARES = {2: 0.20, 3: 0.18, 4: 0.16}
REPEATED_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def quality_rule(text: Column, least: int = 50, most: int = 100_000) -> Column:
    """The first rule a text fails, or "ok"."""
    words = F.filter(F.split(F.trim(text), "\\s+"), lambda w: w != "")
    n = F.size(words)
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n
    symbols = F.size(F.regexp_extract_all(text, F.lit("#|…|\\.\\.\\."), F.lit(0))) / n
    alphabetic = F.size(F.filter(words, lambda w: w.rlike("\\p{L}"))) / n
    functions = F.size(F.array_intersect(F.transform(words, lambda w: F.lower(w)), F.array(*[F.lit(w) for w in FUNCTION_WORDS])))
    return (
        F.when(F.contains(F.lower(text), F.lit("lorem ipsum")), "lorem-ipsum")
        .when(n < least, "too-few-words")
        .when(n > most, "too-many-words")
        .when((letters < 3) | (letters > 10), "word-length")
        .when(symbols > 0.1, "symbol-ratio")
        .when(alphabetic < 0.8, "non-alphabetic")
        .when(functions < 2, "no-function-words")
        .otherwise("ok")
    )


_WORDS = "list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')"


@query(f"""WITH w AS (SELECT doc_id, text, {_WORDS} AS words FROM documents WHERE lang IN ('en', 'EN', 'en-US', 'en_GB', 'eng', 'English')), m AS (SELECT doc_id, text, words, len(words) AS n,
list_sum(list_transform(words, lambda w: length(w)))::double / len(words) AS letters, len(regexp_extract_all(text, '#|…|\\.\\.\\.'))::double / len(words) AS symbols,
len(list_filter(words, lambda w: regexp_matches(w, '\\p{{L}}')))::double / len(words) AS alphabetic,
len(list_intersect(list_distinct(list_transform(words, lambda w: lower(w))), ['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'])) AS functions FROM w)
SELECT doc_id, CASE WHEN contains(lower(text), 'lorem ipsum') THEN 'lorem-ipsum' WHEN n < 50 THEN 'too-few-words' WHEN n > 100000 THEN 'too-many-words' WHEN letters < 3 OR letters > 10 THEN 'word-length'
WHEN symbols > 0.1 THEN 'symbol-ratio' WHEN alphabetic < 0.8 THEN 'non-alphabetic' WHEN functions < 2 THEN 'no-function-words' ELSE 'ok' END AS rule FROM m""")
def f31_quality_gate(spark, folder):
    english = documents_of(spark, folder).where(F.col("lang").isin("en", "EN", "en-US", "en_GB", "eng", "English"))
    return english.select("doc_id", quality_rule(F.col("text")).alias("rule"))


def word_rule(words: list[str]) -> str:
    """The first rule of shape that a text's words fail, or ""."""
    n = len(words)
    if n < 50:
        return "too-few-words"
    if n > 100_000:
        return "too-many-words"
    if not 3 <= sum(map(len, words)) / n <= 10:
        return "word-length"
    if sum("#" in w or "…" in w or "..." in w for w in words) / n > 0.1:
        return "symbol-ratio"
    if sum(any(map(str.isalpha, w)) for w in words) / n < 0.8:
        return "non-alphabetic"
    functions = sum(w.strip(".,!?…:;\"'()[]«»—-").lower() in GATE_WORDS for w in words)
    return "no-function-words" if functions < 2 else ""


def repetition_rule(words: list[str]) -> str:
    """The rule of repetition that a text's words fail, or "". Sequences get numbers, so none is mistaken for another."""
    numbers: dict[str, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    ends = np.r_[0, np.cumsum([len(w) for w in words])]
    gram = code
    for n in range(2, 11):
        if len(words) < n:
            break
        _, at, gram, times = np.unique(gram[: len(words) - n + 1] * len(words) + code[n - 1 :], return_index=True, return_inverse=True, return_counts=True)
        chars = times * (ends[at + n] - ends[at])
        if n in TOP_SHARES and chars.max() / ends[-1] > TOP_SHARES[n]:
            return "top-ngram"
        if n in REPEATED_SHARES and chars[times > 1].sum() / ends[-1] > REPEATED_SHARES[n]:
            return "repeated-ngram"
    return ""


def _gate(batches):
    for batch in batches:
        rules = []
        for text, unsegmented in zip(batch.column("text").to_pylist(), batch.column("unsegmented").to_pylist()):
            if "lorem ipsum" in text.lower():
                rules.append("lorem-ipsum")
                continue
            words = text.split()
            rules.append("ok" if unsegmented else word_rule(words) or repetition_rule(words) or "ok")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rules, pa.string())], names=["doc_id", "rule"])


def quality_gate(documents: DataFrame) -> DataFrame:
    """doc_id and the first rule that each text fails, or "ok": texts of every language and label.

    Texts in scripts that do not part words pass, as counts of words say nothing of them.
    """
    letters = F.regexp_count("text", F.lit("\\p{L}"))
    joined = F.lit("[\\p{L}&&[\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}\\p{IsThai}\\p{IsLao}\\p{IsKhmer}\\p{IsMyanmar}]]")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("unsegmented", F.regexp_like("text", joined) & (F.regexp_count("text", joined) > 0.3 * letters)).mapInArrow(_gate, "doc_id long, rule string")


@query()
def f31_quality_gate_all(spark, folder):
    """The whole gate over all documents; f31_quality_gate shows the rules that its twin has."""
    return quality_gate(documents_of(spark, folder))


def ngram_shares(documents: DataFrame, n: int, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Share of characters in the most frequent n-gram, and in all n-grams that repeat."""
    words = documents.select(key, T.tokens(F.col(body)).alias("w")).where(F.size("w") >= n)
    grams = words.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram"))
    counted = grams.groupBy(key, "gram").agg(F.count("*").alias("c")).withColumn("chars", F.col("c") * F.length("gram"))
    total = F.sum("chars")
    return counted.groupBy(key).agg(
        F.round(F.max(F.when(F.col("c") > 1, F.col("chars")).otherwise(0)) / total, 9).alias("top_share"),
        F.round(F.sum(F.when(F.col("c") > 1, F.col("chars")).otherwise(0)) / total, 9).alias("repeated_share"),
    )


@query(f"""WITH t AS (SELECT doc_id, {T.tokens_sql('text')} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t WHERE len(w) >= 2),
c AS (SELECT doc_id, gram, count(*) AS c, count(*) * length(gram) AS chars FROM g GROUP BY doc_id, gram)
SELECT doc_id, round(max(CASE WHEN c > 1 THEN chars ELSE 0 END)::double / sum(chars), 9) AS top_share, round(sum(CASE WHEN c > 1 THEN chars ELSE 0 END)::double / sum(chars), 9) AS repeated_share FROM c GROUP BY doc_id""")
def c24_ngram_shares(spark, folder):
    return ngram_shares(documents_of(spark, folder), 2)


def quality_prior(functions: Column, symbols: Column, alphabetic: Column) -> Column:
    clamp = lambda c: F.least(F.lit(1.0), c)
    return clamp(functions / 0.20) * ((1 - clamp(symbols / 0.10)) + clamp(alphabetic / 0.85)) / 2


@query("""SELECT explain_id, round(q, 9) AS quality, round(2 * q - 1, 9) AS prior, round(1 - q, 9) AS spam FROM (SELECT explain_id,
least(1.0, function_word_fraction / 0.20) * ((1 - least(1.0, symbol_fraction / 0.10)) + least(1.0, alphabetic_fraction / 0.85)) / 2 AS q FROM explain_results WHERE quality_known)""")
def c25_content_prior(spark, folder):
    rows = table(spark, folder, "explain_results").where("quality_known")
    q = quality_prior(F.col("function_word_fraction"), F.col("symbol_fraction"), F.col("alphabetic_fraction"))
    return rows.select("explain_id", F.round(q, 9).alias("quality"), F.round(2 * q - 1, 9).alias("prior"), F.round(1 - q, 9).alias("spam"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def c43_content_hash(spark, folder):
    return documents_of(spark, folder).where("text IS NOT NULL").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT page_id, 'content-' || sha256(url || chr(0) || sha256(text)) AS cluster_id FROM crawled_pages WHERE url IS NOT NULL AND text IS NOT NULL")
def c42_cluster_id(spark, folder):
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL AND text IS NOT NULL")
    joined = F.concat(F.col("url"), F.lit("\0"), T.content_hash(F.col("text")))
    return pages.select("page_id", F.concat(F.lit("content-"), F.sha2(F.encode(joined, "utf-8"), 256)).alias("cluster_id"))


@query("""SELECT page_id, min(page_id) OVER (PARTITION BY text)::bigint AS representative FROM crawled_pages WHERE length(text) > 0""")
def j13_exact_content(spark, folder):
    """Pages of equal content with their least id; the hash is what is shuffled, not the text."""
    pages = table(spark, folder, "crawled_pages").where(F.length("text") > 0).select("page_id", T.content_hash(F.col("text")).alias("h"))
    least = pages.groupBy("h").agg(F.min("page_id").alias("representative"))
    return pages.join(least, "h").select("page_id", "representative")


def shingles(tokens: Column, width: int = 4) -> Column:
    """Different hashed word sequences of a token column.

    The tokens have to be a column of their own: an expression would be worked out anew for
    every sequence.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - width + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, width), "\0"))))


def exploded(rows: DataFrame, key: str, values: str, name: str) -> DataFrame:
    """One row per element.

    explode() would let the optimizer push a filter on the array's size below its own
    projection, where the tokens are worked out again for every sequence.
    """
    return rows.select(key, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def simhash(rows: DataFrame, key: str, hashes: str) -> DataFrame:
    """64-bit majority fingerprint of an array of hashes, however many."""
    bits = exploded(rows, key, hashes, "h")
    # two bits of a hash are spread over the 32-bit lanes of one long, so that 32 sums count 64 bits
    lanes = [F.sum((F.shiftrightunsigned("h", 2 * i).bitwiseAND(3) * 0x80000001).bitwiseAND(0x100000001)).alias(f"l{i}") for i in range(32)]
    summed = bits.groupBy(key).agg(F.count("*").alias("n"), *lanes)
    parts = [
        F.when(2 * F.shiftrightunsigned(f"l{i // 2}", 32 * (i % 2)).bitwiseAND(0xFFFFFFFF) > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
        for i in range(64)
    ]
    return summed.select(key, reduce(lambda a, b: a.bitwiseOR(b), parts).alias("fingerprint"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint over all shingles of the text."""
    words = documents.select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return simhash(words.select("doc_id", shingles(F.col("w")).alias("s")), "doc_id", "s")


@query()
def c22_simhash(spark, folder):
    """All shingles count; the reference stops at 4096."""
    return fingerprints(documents_of(spark, folder))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@query("SELECT o_orderkey, bit_count(xor(o_orderkey, o_custkey))::int AS distance FROM orders")
def c23_hamming(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", hamming(F.col("o_orderkey"), F.col("o_custkey")).cast("int").alias("distance"))


@query(f"""WITH p AS (SELECT page_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\\s+'), lambda x: octet_length(encode(x)) >= 3)) AS t FROM crawled_pages)
SELECT page_id, len(t)::bigint AS members, CASE WHEN len(t) = 0 THEN 0.0 ELSE round(len(list_filter(t, lambda x: x IN ('the', 'why', 'how')))::double / len(list_distinct(list_concat(t, ['the', 'why', 'how']))), 9) END AS jaccard FROM p""")
def c21_jaccard(spark, folder):
    """Similarity of a title's tokens to a fixed set; c13's token sets."""
    sets = table(spark, folder, "crawled_pages").select("page_id", T.diversity_tokens(F.col("title")).alias("t"))
    other = F.array(F.lit("the"), F.lit("why"), F.lit("how"))
    return sets.select("page_id", F.size("t").cast("long").alias("members"), F.when(F.size("t") == 0, 0.0).otherwise(F.round(T.jaccard(F.col("t"), other), 9)).alias("jaccard"))


def duplicate_pairs(documents: DataFrame, key: str = "doc_id", body: str = "text", width: int = 5, threshold: float = 0.8, rows: int = 4, bands: int = 16) -> DataFrame:
    """Pairs of different texts whose word-sequence sets are at least that similar.

    Equal texts go in as one; candidates agree in a whole band of minimal hashes; the sets
    decide. Bands keep buckets small whatever the number of texts, no bucket is capped.
    """
    texts = documents.where(F.col(body).isNotNull()).select(F.xxhash64(body).alias("h"), F.col(key), F.col(body)).groupBy("h").agg(F.min(key).alias(key), F.first(body).alias(body))

    def sets(rows: DataFrame) -> DataFrame:
        words = rows.select(key, T.tokens(F.col(body)).alias("w"))
        return words.select(key, shingles(F.col("w"), width).alias("s"))

    minima = exploded(sets(texts), key, "s", "x").groupBy(key).agg(*[F.min(F.xxhash64("x", F.lit(i))).alias(f"m{i}") for i in range(rows * bands)])
    banded = [F.xxhash64(F.lit(b), *[F.col(f"m{i}") for i in range(b * rows, (b + 1) * rows)]) for b in range(bands)]
    # both sides of the join read the bands, which are dear to work out
    keyed = cut(minima.select(key, F.explode(F.array(*banded)).alias("band")))
    pairs = keyed.select("band", F.col(key).alias("a")).join(keyed.select("band", F.col(key).alias("b")), "band").where("a < b").select("a", "b").distinct()
    pairs = cut(pairs)
    wanted = pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct()
    # cut before the sequences are worked out, so that texts outside of pairs are spared
    chosen = cut(texts.join(wanted, key, "left_semi"))
    compared = cut(sets(chosen))
    left, right = (compared.select(F.col(key).alias(n), F.col("s").alias("s" + n)) for n in "ab")
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", T.jaccard(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


_S5 = f"""t AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text), k AS (SELECT doc_id, {T.tokens_sql('text')} AS w FROM t),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), chr(1)))) AS g FROM k),
e AS (SELECT doc_id, unnest(g) AS x FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2)"""


@query(f"""WITH {_S5} SELECT p.a, p.b, round(n::double / (len(x.g) + len(y.g) - n), 9) AS similarity FROM p JOIN s x ON p.a = x.doc_id JOIN s y ON p.b = y.doc_id
WHERE n::double / (len(x.g) + len(y.g) - n) >= 0.8""")
def j12_near_duplicates(spark, folder):
    return duplicate_pairs(documents_of(spark, folder)).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH v AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_filter({T.tokens_sql('text')}, lambda w: length(w) BETWEEN 4 AND 32)) AS word FROM documents) GROUP BY word HAVING count(*) >= 2),
q AS (SELECT unnest(['crawlr', 'langauge', 'indx', 'redirct', 'robtos']) AS term), c AS (SELECT term, word, levenshtein(term, word) AS d, f FROM q JOIN v ON abs(length(word) - length(term)) <= 2 AND levenshtein(term, word) <= 2)
SELECT term, word, d::int AS edits FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY d, f DESC, word) AS nth FROM c) WHERE nth <= 3""")
def j14_spelling(spark, folder):
    """Symmetric deletes: terms and vocabulary meet in a shared variant with up to two characters less."""
    words = vocabulary(documents_of(spark, folder))
    terms = spark.createDataFrame([(w,) for w in ("crawlr", "langauge", "indx", "redirct", "robtos")], "term string")
    return corrections(terms, words, 3)


def delete_variants(c: Column) -> Column:
    """The word and everything with one or two characters less."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    first = once(c)
    return F.array_distinct(F.concat(F.array(c), first, F.flatten(F.transform(first, once))))


def corrections(terms: DataFrame, words: DataFrame, best: int) -> DataFrame:
    left = terms.select("term", F.explode(delete_variants(F.col("term"))).alias("variant"))
    right = words.select("word", "frequency", F.explode(delete_variants(F.col("word"))).alias("variant"))
    met = left.join(right, "variant").select("term", "word", "frequency").distinct().withColumn("edits", F.levenshtein("term", "word")).where("edits <= 2")
    order = Window.partitionBy("term").orderBy("edits", F.desc("frequency"), "word")
    return met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= best).select("term", "word", "edits")


@query("""SELECT doc_id, levenshtein(regexp_replace(substring(title, 1, 40), '[^ -~]', '?', 'g'), regexp_replace(substring(text, 1, 40), '[^ -~]', '?', 'g'))::int AS edits FROM documents WHERE title IS NOT NULL""")
def c18_levenshtein(spark, folder):
    """Edits between characters; other than ASCII ones are folded, since the SQL twin counts bytes."""
    documents = documents_of(spark, folder).withColumns({c: F.regexp_replace(F.substring(c, 1, 40), "[^ -~]", "?") for c in ("title", "text")})
    return documents.where("title IS NOT NULL").select("doc_id", F.levenshtein("title", "text").alias("edits"))


def title_edits(documents: DataFrame) -> DataFrame:
    """doc_id and the edits between the whole title and the whole text, by characters."""
    return documents.where("title IS NOT NULL").select("doc_id", F.levenshtein("title", "text").alias("edits"))


@query()
def c18_levenshtein_all(spark, folder):
    """Whole titles and texts; c18_levenshtein compares what its twin does."""
    return title_edits(documents_of(spark, folder))


_STEM = "regexp_replace(word, '^(.{4,60}?)(ations|ation|ungen|ements|ement|ings|ing|ung|ions|ion|ers|en|er|es|ed|s|e)$', '\\1')"


@query(f"""WITH v AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_filter({T.tokens_sql('text')}, lambda w: length(w) BETWEEN 4 AND 32)) AS word FROM documents) GROUP BY word HAVING count(*) >= 2)
SELECT {_STEM} AS stem, count(*)::bigint AS forms, sum(f)::bigint AS frequency FROM v GROUP BY 1 HAVING count(*) > 1""")
def a18_word_forms(spark, folder):
    return forms(vocabulary(documents_of(spark, folder)))


def stemmed(c: Column) -> Column:
    return F.regexp_replace(c, "^(.{4,60}?)(ations|ation|ungen|ements|ement|ings|ing|ung|ions|ion|ers|en|er|es|ed|s|e)$", "$1")


def forms(words: DataFrame) -> DataFrame:
    grouped = words.groupBy(stemmed(F.col("word")).alias("stem")).agg(F.count("*").alias("forms"), F.sum("frequency").alias("frequency"))
    return grouped.where("forms > 1")


@query(f"""WITH v AS (SELECT word, count(*) AS f FROM (SELECT unnest(list_filter({T.tokens_sql('text')}, lambda w: length(w) BETWEEN 4 AND 32)) AS word FROM documents) GROUP BY word HAVING count(*) >= 2),
x AS (SELECT word, f, {_STEM} AS stem FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY f DESC, word) AS nth FROM x)
SELECT a.word, b.word AS variant FROM r a JOIN r b ON a.stem = b.stem AND a.word <> b.word WHERE b.nth <= 8 AND a.nth <= 8""")
def j15_word_form_join(spark, folder):
    words = vocabulary(documents_of(spark, folder)).withColumn("stem", stemmed(F.col("word")))
    order = Window.partitionBy("stem").orderBy(F.desc("frequency"), "word")
    kept = words.withColumn("nth", F.row_number().over(order)).where("nth <= 8")
    other = kept.select("stem", F.col("word").alias("variant"))
    return kept.select("stem", "word").join(other, "stem").where("word <> variant").select("word", "variant")


@query("""SELECT doc_id, CASE WHEN l >= c AND l >= 1 THEN 'latin' WHEN c > 0 THEN 'cyrillic' END AS script FROM (SELECT doc_id, length(regexp_replace(text, '[^\\p{Latin}]', '', 'g')) AS l,
length(regexp_replace(text, '[^\\p{Cyrillic}]', '', 'g')) AS c FROM documents WHERE text IS NOT NULL)""")
def c16_dominant_script(spark, folder):
    return documents_of(spark, folder).where("text IS NOT NULL").select("doc_id", T.dominant_script(F.col("text")).alias("script"))


@query("""SELECT page_id, CASE WHEN regexp_extract(lower(trim(coalesce(language, ''))), '^([a-z]{2})', 1) = '' THEN 'en' ELSE regexp_extract(lower(trim(coalesce(language, ''))), '^([a-z]{2})', 1) END AS code FROM crawled_pages""")
def c17_language_code(spark, folder):
    return table(spark, folder, "crawled_pages").select("page_id", T.language_code(F.col("language")).alias("code"))


@query(f"SELECT word, {T.word_hash_sql('word')} AS hash FROM (SELECT DISTINCT unnest({T.tokens_sql('title')}) AS word FROM documents)")
def c5_word_hash(spark, folder):
    words = documents_of(spark, folder).select(F.explode(T.tokens(F.col("title"))).alias("word")).distinct()
    return words.select("word", T.word_hash(F.col("word")).alias("hash"))


@query(f"SELECT doc_id, len({T.tokens_sql('text')})::bigint AS tokens, len(list_distinct({T.tokens_sql('text')}))::bigint AS different FROM documents")
def c10_search_tokens(spark, folder):
    t = T.tokens(F.col("text"))
    return documents_of(spark, folder).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("different"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*'))::bigint AS tokens FROM documents WHERE text IS NOT NULL")
def c11_cluster_tokens(spark, folder):
    return documents_of(spark, folder).where("text IS NOT NULL").select("doc_id", F.size(T.word_tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"SELECT word, {T.stop_sql('word')} AS stop FROM (SELECT DISTINCT unnest({T.tokens_sql('text')}) AS word FROM documents)")
def c14_stop_words(spark, folder):
    words = documents_of(spark, folder).select(F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", T.is_stop(F.col("word")).alias("stop"))


_FLAT = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"""SELECT doc_id, (CASE WHEN greatest(1, strpos(lower(f), 'crawler') - 40) > 1 THEN '…' ELSE '' END) || trim(substring(f, greatest(1, strpos(lower(f), 'crawler') - 40), 160)) AS passage
FROM (SELECT doc_id, {_FLAT} AS f FROM documents WHERE contains(lower(text), 'crawler'))""")
def c35_snippet(spark, folder):
    return documents_of(spark, folder).where(F.contains(F.lower("text"), F.lit("crawler"))).select("doc_id", T.snippet(F.col("text"), ["crawler"]).alias("passage"))


@query("SELECT doc_id, regexp_replace(title, '((?:crawler|index)+)', '<b>\\1</b>', 'gi') AS marked FROM documents WHERE title IS NOT NULL")
def c36_highlight(spark, folder):
    return documents_of(spark, folder).where("title IS NOT NULL").select("doc_id", T.highlight(F.col("title"), ["index", "crawler"]).alias("marked"))


@query("""SELECT doc_id, array_to_string(list_slice(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: contains(lower(s), 'crawler')), 1, 3), ' [...] ') AS chunks
FROM documents WHERE contains(lower(text), 'crawler')""")
def c38_relevant_chunks(spark, folder):
    sentences = F.split(F.regexp_replace("text", "([.!?])\\s+", "$1\u0002"), "\u0002")
    chosen = F.slice(F.filter(sentences, lambda s: F.contains(F.lower(s), F.lit("crawler"))), 1, 3)
    return documents_of(spark, folder).where(F.contains(F.lower("text"), F.lit("crawler"))).select("doc_id", F.array_join(chosen, " [...] ").alias("chunks"))


@query("SELECT doc_id, octet_length(encode(title))::bigint AS bytes, octet_length(encode(title)) <= 48 AS whole FROM documents WHERE title IS NOT NULL")
def c45_bounded_bytes(spark, folder):
    """A label is whole when it fits in 48 bytes; else it is cut at a character."""
    cut = T.truncated_bytes(F.col("title"), 48)
    return documents_of(spark, folder).where("title IS NOT NULL").select("doc_id", F.octet_length("title").cast("long").alias("bytes"), (cut == F.col("title")).alias("whole"))


@query(f"SELECT page_id, {U.normalized_sql('url')} AS normal FROM crawled_pages WHERE url IS NOT NULL")
def c1_normalized_url(spark, folder):
    return table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", U.normalized(F.col("url")).alias("normal"))


@query(f"SELECT result_id, {U.host_sql('url')} = {U.host_sql('base_url')} AS local FROM crawl_results WHERE url IS NOT NULL AND base_url IS NOT NULL")
def c2_local_links(spark, folder):
    rows = table(spark, folder, "crawl_results").where("url IS NOT NULL AND base_url IS NOT NULL")
    return rows.select("result_id", (U.host(F.col("url")) == U.host(F.col("base_url"))).alias("local"))


@query(f"SELECT DISTINCT {U.host_sql('url')} AS host, {U.registrable_sql(U.host_sql('url'))} AS site FROM crawled_pages WHERE url IS NOT NULL")
def c3_registrable_domain(spark, folder):
    hosts = table(spark, folder, "crawled_pages").where("url IS NOT NULL").select(U.host(F.col("url")).alias("host")).distinct()
    return hosts.select("host", U.registrable(F.col("host")).alias("site"))


@query(f"SELECT page_id, {U.url_hash_sql(U.normalized_sql('url'))} AS hash FROM crawled_pages WHERE {U.normalized_sql('url')} IS NOT NULL")
def c4_url_hash(spark, folder):
    pages = table(spark, folder, "crawled_pages").select("page_id", U.normalized(F.col("url")).alias("normal")).where("normal IS NOT NULL")
    return pages.select("page_id", U.url_hash(F.col("normal")).alias("hash"))


@query(f"SELECT substring({U.url_hash_sql(U.normalized_sql('url'))}, 7, 6) AS host_hash, count(*)::bigint AS pages FROM crawled_pages WHERE {U.normalized_sql('url')} IS NOT NULL GROUP BY 1")
def c7_host_hash(spark, folder):
    pages = table(spark, folder, "crawled_pages").select(U.normalized(F.col("url")).alias("normal")).where("normal IS NOT NULL")
    return pages.groupBy(F.substring(U.url_hash(F.col("normal")), 7, 6).alias("host_hash")).agg(F.count("*").alias("pages"))


@query("SELECT event_id, ((event_id >> 3) & 1) = 1 AS bit FROM events")
def c8_bit_test(spark, folder):
    return table(spark, folder, "events").select("event_id", (F.getbit("event_id", F.lit(3)) == 1).alias("bit"))


@query(f"SELECT {U.family_sql(U.extension_sql('url'))} AS family, count(*)::bigint AS pages FROM crawled_pages WHERE url IS NOT NULL GROUP BY 1")
def c33_file_type(spark, folder):
    pages = table(spark, folder, "crawled_pages").where("url IS NOT NULL")
    return pages.groupBy(U.family(U.extension(F.col("url"))).alias("family")).agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, round(0.1 * 20 / (20 + octet_length(encode(trim({U.path_sql('url')}, '/')))), 9) AS prior FROM crawled_pages WHERE url IS NOT NULL")
def c26_url_length_prior(spark, folder):
    size = F.octet_length(F.regexp_replace(U.path(F.col("url")), "^/+|/+$", ""))
    return table(spark, folder, "crawled_pages").where("url IS NOT NULL").select("page_id", F.round(F.lit(2.0) / (20 + size), 9).alias("prior"))


@query("""SELECT page_id, round(list_sum([0.5 * pow(2, -age / 7.0), 0.3 * pow(2, -age / 30.0), 0.2 * pow(2, -age / 365.0)]), 9) AS freshness FROM
(SELECT page_id, epoch((SELECT max(fetched_at) FROM crawled_pages) - fetched_at) / 86400.0 AS age FROM crawled_pages WHERE fetched_at IS NOT NULL)""")
def c27_freshness(spark, folder):
    """Three half-lives as of the newest fetch, never of the wall clock."""
    pages = table(spark, folder, "crawled_pages")
    now = pages.agg(F.max("fetched_at").alias("now"))
    age = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))) / 86_400_000_000.0
    parts = [w * F.pow(F.lit(2.0), -age / h) for w, h in ((0.5, 7.0), (0.3, 30.0), (0.2, 365.0))]
    return pages.where("fetched_at IS NOT NULL").crossJoin(F.broadcast(now)).select("page_id", F.round(parts[0] + parts[1] + parts[2], 9).alias("freshness"))


@query("""SELECT page_id, CASE WHEN observed_at < fetched_at THEN NULL WHEN observed_at > fetched_at + INTERVAL 24 HOUR THEN fetched_at ELSE observed_at END AS seen FROM crawled_pages""")
def c29_date_merge(spark, folder):
    """Implausible dates are cleared or fall back to the date of the fetch."""
    seen = F.when(F.col("observed_at") < F.col("fetched_at"), F.lit(None)).when(F.col("observed_at") > F.col("fetched_at") + F.expr("INTERVAL 24 HOURS"), F.col("fetched_at")).otherwise(F.col("observed_at"))
    return table(spark, folder, "crawled_pages").select("page_id", seen.alias("seen"))


@query("SELECT doc_id, strftime(created_at, '%Y%m%d') AS compact, strftime(created_at, '%a, %d %b %Y %H:%M:%S +0000') AS rfc, strftime(created_at, '%Y-%m') AS month FROM documents WHERE created_at IS NOT NULL")
def c31_date_formats(spark, folder):
    c = F.col("created_at")
    rfc = F.concat(F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    return documents_of(spark, folder).where("created_at IS NOT NULL").select("doc_id", F.date_format(c, "yyyyMMdd").alias("compact"), rfc.alias("rfc"), F.date_format(c, "yyyy-MM").alias("month"))


@query("""SELECT r AS range, count(*)::bigint AS documents FROM (SELECT unnest(['day', 'week', 'month', 'year']) AS r, unnest([1, 7, 30, 365]) AS d) w
JOIN documents ON created_at >= (SELECT max(created_at) FROM documents) - to_days(d::int) GROUP BY r""")
def c32_relative_range(spark, folder):
    documents = documents_of(spark, folder)
    ranges = spark.createDataFrame([("day", 1), ("week", 7), ("month", 30), ("year", 365)], "range string, days int")
    now = documents.agg(F.max("created_at").alias("now"))
    dated = documents.where("created_at IS NOT NULL").crossJoin(F.broadcast(now)).crossJoin(F.broadcast(ranges))
    return dated.where(F.col("created_at") >= F.col("now") - F.make_interval(days=F.col("days"))).groupBy("range").agg(F.count("*").alias("documents"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def c44_json_fields(spark, folder):
    return table(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT page_id, len(links)::bigint AS links, links[1] AS first_link FROM crawled_pages WHERE links IS NOT NULL")
def c48_array_access(spark, folder):
    pages = table(spark, folder, "crawled_pages").where("links IS NOT NULL")
    return pages.select("page_id", F.size("links").cast("long").alias("links"), F.get("links", F.lit(0)).alias("first_link"))
