"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track or carry a session.
TRACKING = (
    "gclid fbclid msclkid dclid yclid mc_cid mc_eid igshid phpsessid jsessionid sessionid _ga _gl".split()
)
#: Public suffixes of two labels that are told apart; others end at the last label.
SUFFIXES = "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.jp ne.jp or.jp com.br com.mx com.ar co.nz co.in co.za com.tr com.cn com.tw com.hk com.sg com.ua".split()
#: Extensions by family.
FAMILIES = {
    "image": "png jpg jpeg gif webp svg bmp ico tif tiff".split(),
    "audio": "mp3 ogg wav flac m4a aac".split(),
    "video": "mp4 webm avi mov mkv mpg mpeg".split(),
    "app": "exe apk dmg deb rpm msi jar iso".split(),
    "document": "pdf doc docx odt rtf ppt pptx xls xlsx ods odp csv txt md tex".split(),
    "archive": "zip tar gz bz2 xz 7z rar".split(),
    "page": "html htm php asp aspx jsp xhtml".split(),
}


def clean(url: Column) -> Column:
    return F.trim(url)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(clean(url), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(clean(url), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), "^(?:[^@]*@)?([^:]*)", 1))


def host_sql(u: str) -> str:
    return f"lower(regexp_extract(regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:[^@]*@)?([^:]*)', 1))"


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), ":([0-9]+)$", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(clean(url), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_sql(u: str) -> str:
    return f"regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def query_part(url: Column) -> Column:
    return F.regexp_extract(clean(url), "^[^?#]*\\?([^#]*)", 1)


def bare_host(url: Column) -> Column:
    """The host without one leading www."""
    return F.regexp_replace(host(url), "^www\\.", "")


def registrable(h: Column) -> Column:
    """The suffix's label before it; addresses and single labels stay as they are."""
    labels = F.split(h, "\\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    three = F.concat_ws(".", F.slice(labels, -3, 3))
    plain = h.rlike("^[0-9.]+$") | (F.size(labels) <= 2)
    return F.when(plain, h).when(two.isin(*SUFFIXES), three).otherwise(two)


def registrable_sql(h: str) -> str:
    known = ", ".join(f"'{s}'" for s in SUFFIXES)
    parts = f"string_split({h}, '.')"
    two, three = (f"array_to_string(list_slice({parts}, -{n}, -1), '.')" for n in (2, 3))
    return f"CASE WHEN regexp_matches({h}, '^[0-9.]+$') OR len({parts}) <= 2 THEN {h} WHEN {two} IN ({known}) THEN {three} ELSE {two} END"


def _is_tracking(pair: Column) -> Column:
    name = F.lower(F.regexp_extract(pair, "^([^=]*)", 1))
    sid = (name == "sid") & pair.rlike("=[A-Za-z0-9]{32}$")
    return name.isin(*TRACKING) | name.startswith("utm_") | name.startswith("aspsessionid") | sid


def normalized(url: Column) -> Column:
    """http(s) only: lower host, no default port, clean path, sorted parameters without tracking, no fragment."""
    kind, p = scheme(url), port(url)
    default = ((kind == "http") & (p == "80")) | ((kind == "https") & (p == "443")) | (p == "")
    where = F.concat(host(url), F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), p)))
    raw = F.regexp_replace(F.regexp_replace(path(url), "/\\.(?=/|$)", ""), "/{2,}", "/")
    route = F.when(raw == "", F.lit("/")).otherwise(raw)
    kept = F.array_sort(F.filter(F.split(query_part(url), "&"), lambda x: (x != "") & ~_is_tracking(x)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(kind.isin("http", "https") & (host(url) != ""), F.concat(kind, F.lit("://"), where, route, tail))


def normalized_sql(u: str) -> str:
    kind = f"lower(regexp_extract(trim({u}), '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    auth = f"regexp_extract(trim({u}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    p = f"regexp_extract({auth}, ':([0-9]+)$', 1)"
    h = host_sql(u)
    raw = f"regexp_replace(regexp_replace({path_sql(u)}, '/\\.(/|$)', '\\1', 'g'), '/{{2,}}', '/', 'g')"
    known = ", ".join(f"'{t}'" for t in TRACKING)
    name = "lower(regexp_extract(x, '^([^=]*)', 1))"
    kept = (
        f"list_sort(list_filter(string_split(regexp_extract(trim({u}), '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT ({name} IN ({known}) OR starts_with({name}, 'utm_') "
        f"OR starts_with({name}, 'aspsessionid') OR ({name} = 'sid' AND regexp_matches(x, '=[A-Za-z0-9]{{32}}$')))))"
    )
    return (
        f"CASE WHEN {kind} IN ('http', 'https') AND {h} <> '' THEN {kind} || '://' || {h} || "
        f"CASE WHEN {p} = '' OR ({kind} = 'http' AND {p} = '80') OR ({kind} = 'https' AND {p} = '443') THEN '' ELSE ':' || {p} END || "
        f"CASE WHEN {raw} = '' THEN '/' ELSE {raw} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    )


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), "\\.([A-Za-z0-9]{1,5})$", 1))


def extension_sql(u: str) -> str:
    return f"lower(regexp_extract({path_sql(u)}, '\\.([A-Za-z0-9]{{1,5}})$', 1))"


def family(ext: Column) -> Column:
    out = F.lit("other")
    for name, known in FAMILIES.items():
        out = F.when(ext.isin(*known), F.lit(name)).otherwise(out)
    return F.when(ext == "", F.lit("page")).otherwise(out)


def family_sql(e: str) -> str:
    cases = " ".join(f"WHEN {e} IN ({', '.join(repr(x) for x in known)}) THEN '{name}'" for name, known in FAMILIES.items())
    return f"CASE WHEN {e} = '' THEN 'page' {cases} ELSE 'other' END"


def is_trap(url: Column) -> Column:
    """Too long, too deep, a segment more than three times, or too many parameters."""
    segments = F.filter(F.split(path(url), "/"), lambda x: x != "")
    most = F.array_max(F.transform(F.array_distinct(segments), lambda s: F.size(F.filter(segments, lambda x: x == s))))
    parameters = F.size(F.filter(F.split(query_part(url), "&"), lambda x: x != ""))
    return (F.length(url) > 2048) | (F.size(segments) > 24) | (F.coalesce(most, F.lit(0)) > 3) | (parameters > 16) | (host(url) == "")


def url_hash(normal: Column) -> Column:
    """Twelve characters: five of the whole address, one of its path depth and scheme, six of its host."""
    coded = lambda c, n: F.substring(F.translate(F.base64(F.unhex(F.md5(F.encode(c, "utf-8")))), "+/", "-_"), 1, n)
    return F.concat(coded(normal, 6), coded(host(normal), 6))


def url_hash_sql(u: str) -> str:
    coded = lambda c, n: f"substring(translate(base64(unhex(md5({c}))), '+/', '-_'), 1, {n})"
    return f"{coded(u, 6)} || {coded(host_sql(u), 6)}"
