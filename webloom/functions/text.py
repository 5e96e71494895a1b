"""Text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of five languages.
STOP_WORDS = tuple(
    sorted(
        set(
            (
                "a an and are as at be but by for from had has have he her his if in into is it its no not of on or our she so such that the their then there these they this to was we were will with you "
                "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war wenn werden wie wir wird zu zum zur "
                "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous "
                "al como con del el ella es esta este la las lo los más no o para pero por que se sin sobre su sus un una y ya "
                "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по из о от мы это для"
            ).split()
        )
    )
)
#: A token is a run of letters and digits, in lower case.
TOKEN_BREAK = "[^\\p{L}\\p{Nd}]+"


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_BREAK), lambda x: x != "")


def tokens_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda x: x <> '')"


def word_tokens(c: Column) -> Column:
    """Letters, numbers and marks, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*"), F.lit(0))


def is_stop(c: Column) -> Column:
    return c.isin(*STOP_WORDS)


def stop_sql(c: str) -> str:
    return f"{c} IN ({', '.join(repr(w) for w in STOP_WORDS)})"


def diversity_tokens(c: Column) -> Column:
    """The set of white-space tokens of at least three bytes, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "\\s+"), lambda x: F.octet_length(x) >= 3))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; empty sets share nothing."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(both / every)


def word_hash(c: Column) -> Column:
    """Twelve characters of the word's MD5 in the URL-safe alphabet."""
    return F.substring(F.translate(F.base64(F.unhex(F.md5(F.encode(F.lower(c), "utf-8")))), "+/", "-_"), 1, 12)


def word_hash_sql(c: str) -> str:
    return f"substring(translate(base64(unhex(md5(lower({c})))), '+/', '-_'), 1, 12)"


def content_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "utf-8"), 256)


def dominant_script(c: Column) -> Column:
    """latin, cyrillic, greek, arabic or han, whichever has most letters; null without letters."""
    scripts = {"latin": "IsLatin", "cyrillic": "IsCyrillic", "greek": "IsGreek", "arabic": "IsArabic", "han": "IsHan"}
    counts = [F.struct(F.length(F.regexp_replace(c, f"[^\\p{{{p}}}]", "")).alias("n"), F.lit(-i).alias("order"), F.lit(s).alias("script")) for i, (s, p) in enumerate(scripts.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["script"])


def language_code(c: Column) -> Column:
    """The first two ASCII letters in lower case, else en."""
    head = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), "^([a-z]{2})", 1)
    return F.when(head == "", F.lit("en")).otherwise(head)


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def snippet(text: Column, terms: list[str], cap: int = 160) -> Column:
    """The passage around the first place of any term: cap characters from cap/4 before it."""
    flat = collapsed(F.coalesce(text, F.lit("")))
    places = [F.locate(t.lower(), F.lower(flat)) for t in terms]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0)) if places else F.lit(None).cast("int")
    begin = F.greatest(F.lit(1), F.coalesce(first, F.lit(1)) - cap // 4)
    return F.concat(F.when(begin > 1, F.lit("…")).otherwise(F.lit("")), F.trim(flat.substr(begin, F.lit(cap))))


def highlight(text: Column, terms: list[str]) -> Column:
    """Every place of a term between <b> and </b>; touching places stay one segment."""
    joined = "|".join(sorted((t.replace("\\", "").replace("|", "") for t in terms), key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)((?:{joined})+)", "<b>$1</b>")


def truncated_bytes(c: Column, most: int) -> Column:
    """The longest beginning of at most `most` UTF-8 bytes that cuts no character."""
    points = F.split(c, "")
    kept = F.aggregate(
        points,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars"), F.lit(True).alias("open")),
        lambda a, x: F.struct(
            (a["bytes"] + F.octet_length(x)).alias("bytes"),
            (a["chars"] + F.when(a["open"] & (a["bytes"] + F.octet_length(x) <= most), 1).otherwise(0)).alias("chars"),
            (a["open"] & (a["bytes"] + F.octet_length(x) <= most)).alias("open"),
        ),
        lambda a: a["chars"],
    )
    return F.when(F.octet_length(c) <= most, c).otherwise(c.substr(F.lit(1), kept))
