"""Registered queries: web-page extraction (WEB-1..11).

``pages`` at the test scales has no password field, data-file link or LMS
path, so the marked variant appends the same three markers to every fifth
page, in Spark and in SQL alike (a rule on the whole table, not a subset).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as W
from .registry import register, t

MARK = ('<input type="password"><a href="/files/7/download?x=1">get</a> '
        'https://h.example/data/d.csv <a href="report.pdf">r</a>')
PAGES_MARKED_SQL = (f"(SELECT page_id, url, html || CASE WHEN page_id % 5 = 0 THEN '{MARK}' ELSE '' END "
                    f"AS html FROM pages)")


def pages_marked(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", "url", F.concat(F.col("html"), F.when(F.col("page_id") % 5 == 0, F.lit(MARK))
                                               .otherwise(F.lit(""))).alias("html"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _is_data_sql(u):
    low = f"lower({u})"
    path = f"split_part({low}, '?', 1)"
    ext = " OR ".join(f"ends_with({path}, '{e}')" for e in W.DATA_EXTENSIONS)
    lms = " OR ".join(f"contains({low}, '{p.lower()}')" for p in W.LMS_FILE_PATTERNS)
    excl = " OR ".join(f"contains({low}, '{m.lower()}')" for m in W.SUBMISSION_MARKERS)
    return (f"(NOT ({excl}) AND (({ext}) OR (({lms}) AND (contains({low}, 'download') "
            f"OR contains({low}, '/files/')))))")


@register("page_titles", "WEB-1", r"""
SELECT CAST(page_id AS BIGINT) AS page_id,
       regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title
FROM pages""")
def page_titles(spark, sf):
    p = t(spark, sf, "pages")
    return p.select(F.col("page_id").cast("long").alias("page_id"), W.page_title(F.col("html")).alias("title"))


@register("login_flags_pages_marked", "WEB-4", f"""
SELECT CAST(page_id AS BIGINT) AS page_id, len(l) > 0 AS login_wall, array_to_string(l, '|') AS indicators
FROM (SELECT page_id, list_filter({_sql_list(W.LOGIN_INDICATORS)}, lambda x: contains(lower(html), lower(x))) AS l
      FROM {PAGES_MARKED_SQL})""")
def login_flags_pages_marked(spark, sf):
    p = pages_marked(spark, sf)
    li = W.login_indicators(F.col("html"))
    return p.select(F.col("page_id").cast("long").alias("page_id"), (F.size(li) > 0).alias("login_wall"),
                    F.array_join(li, "|").alias("indicators"))


_RAW_SQL = W.RAW_DATA_URL.replace("'", "''")


@register("raw_data_urls_pages_marked", "WEB-7 WEB-9 WEB-11", f"""
WITH u AS (SELECT page_id, UNNEST(regexp_extract_all(html, '{_RAW_SQL}', 0)) AS url FROM {PAGES_MARKED_SQL})
SELECT CAST(page_id AS BIGINT) AS page_id, url,
       COALESCE(NULLIF(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1], ''),
                'downloaded_data') AS file_name,
       {_is_data_sql('url')} AS classified_data
FROM u""")
def raw_data_urls_pages_marked(spark, sf):
    r = W.raw_data_urls(pages_marked(spark, sf))
    return r.select(F.col("page_id").cast("long").alias("page_id"), "url", W.file_name(F.col("url")).alias("file_name"),
                    W.is_data_url(F.col("url")).alias("classified_data"))


@register("lms_paths_pages_marked", "WEB-8", "\nUNION ALL\n".join(
    f"SELECT CAST(page_id AS BIGINT) AS page_id, {k} AS pattern, "
    f"UNNEST(regexp_extract_all(html, '{p.replace(chr(39), chr(39) * 2)}', 1)) AS path FROM {PAGES_MARKED_SQL}"
    for k, p in enumerate(W.LMS_PATHS)))
def lms_paths_pages_marked(spark, sf):
    lp = W.lms_paths(pages_marked(spark, sf))
    return lp.select(F.col("page_id").cast("long").alias("page_id"), "pattern", "path")


# the pages hold no skipped element but script and style, and no character reference but these
_TEXT_SQL = r"""
WITH c AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]+>', chr(10), 'g') AS s FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(s, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS s FROM c),
l AS (SELECT page_id, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM e)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(length(array_to_string(l, chr(10))) AS INTEGER) AS n_chars,
       CAST(len(l) AS INTEGER) AS n_lines, md5(array_to_string(l, chr(10))) AS text_md5 FROM l"""


@register("page_texts", "WEB-2 WEB-3", _TEXT_SQL)
def page_texts(spark, sf):
    return W.page_texts(t(spark, sf, "pages")).select("page_id", "n_chars", "n_lines", F.md5("text").alias("text_md5"))


def _links_sql():
    lms = "\nUNION ALL ".join("SELECT page_id, 3, o || UNNEST(regexp_extract_all(html, '" + p.replace("'", "''") + "', 1)) FROM p" for p in W.LMS_PATHS)
    return rf"""
WITH p AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS o, regexp_extract(url, '^(https?://[^?#]*/)', 1) AS d FROM {PAGES_MARKED_SQL}),
a AS (SELECT page_id, o, d, UNNEST(regexp_extract_all(html, '<(?:{"|".join(W.LINK_TAGS)})\s[^>]*?(?:{"|".join(W.LINK_ATTRS)})="([^"]+)"', 1)) AS h FROM p),
u AS (SELECT page_id, 1 AS method, CASE WHEN h LIKE '/%' THEN o || h WHEN h LIKE 'http%' THEN h ELSE d || h END AS url
      FROM a WHERE h NOT LIKE '#%' AND h NOT LIKE 'javascript:%'
      UNION ALL SELECT page_id, 2, UNNEST(regexp_extract_all(html, '{_RAW_SQL}', 0)) FROM p
      UNION ALL {lms}),
f AS (SELECT page_id, url, MIN(method) AS method FROM u GROUP BY ALL)
SELECT CAST(page_id AS BIGINT) AS page_id, url, method = 2 OR {_is_data_sql('url')} AS is_data, CAST(method AS INTEGER) AS method FROM f"""


@register("page_links_pages_marked", "WEB-5 WEB-6 WEB-10", _links_sql())
def page_links_pages_marked(spark, sf):
    return W.page_links(pages_marked(spark, sf)).select("page_id", "url", "is_data", "method")


@register("page_summary_pages_marked", "WEB-1 WEB-2 WEB-4 WEB-10")
def page_summary_pages_marked(spark, sf):
    return W.page_summary(pages_marked(spark, sf)).drop("login_indicators")
