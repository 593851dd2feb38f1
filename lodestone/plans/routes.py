"""Route matching over pages: server routes are the URLs of even pages, client calls those of odd ones and all links.

Stand-ins: numeric segments are written as {id}, and the scheme gives the method (http GET, https
POST; links GET).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import aggregate, match
from .registry import Tables, query

_NORMAL = r"""regexp_replace(regexp_replace('/' || regexp_replace(regexp_replace({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\1')"""
_PATH = r"regexp_replace(" + _NORMAL.format("url") + r", '/[0-9]+(\.html)?$', '/{id}\1')"
_SQL = rf"""
WITH routes AS (
  SELECT row_number() OVER (ORDER BY http_method, path) AS route_id, http_method, path, split_part(path, '/', 2) AS first
  FROM (SELECT DISTINCT CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS http_method, {_PATH} AS path FROM pages WHERE page_id % 2 = 0)
), calls AS (
  SELECT http_method, path, count(*) AS n FROM (
    SELECT CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS http_method, {_PATH} AS path FROM pages WHERE page_id % 2 = 1
    UNION ALL
    SELECT 'GET', regexp_replace({_NORMAL.format("href")}, '/[0-9]+(\.html)?$', '/{{id}}\1') FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
  ) GROUP BY 1, 2
), keyed AS (
  SELECT c.*, CASE WHEN lower(split_part(c.path, '/', 2)) = '' THEN '' ELSE 'ms-' || regexp_replace(lower(split_part(c.path, '/', 2)), 's$', '') END AS service,
    (SELECT min(route_id) FROM routes r WHERE lower(r.path) = lower(c.path) AND r.http_method = c.http_method) AS exact,
    (SELECT min(route_id) FROM routes r WHERE lower(r.path) = lower(c.path)) AS any_route
  FROM calls c
), services AS (SELECT DISTINCT 'ms-' || regexp_replace(lower(first), 's$', '') AS service FROM routes WHERE first <> '')
"""
_FUNNEL = (
    _SQL
    + """
SELECT issue, confidence, count(*) AS calls, CAST(sum(n) AS BIGINT) AS uses FROM (
  SELECT n, CASE WHEN exact IS NOT NULL THEN 'matched' WHEN any_route IS NOT NULL THEN 'method_mismatch'
    WHEN service <> '' AND service NOT IN (SELECT service FROM services) THEN 'unscanned_service'
    WHEN service <> '' THEN 'indexed_backend_route_missing' ELSE 'missing_backend_route' END AS issue,
  CASE WHEN exact IS NOT NULL THEN 'RESOLVED' WHEN any_route IS NOT NULL THEN 'MISMATCH'
    WHEN service <> '' AND service NOT IN (SELECT service FROM services) THEN 'OUT_OF_SCOPE' ELSE 'UNRESOLVED' END AS confidence
  FROM keyed) GROUP BY 1, 2"""
)


def page_path(url) -> "F.Column":
    return F.regexp_replace(paths.normalise(url), r"/[0-9]+(\.html)?$", "/{id}$1")


def method(url) -> "F.Column":
    return F.when(url.startswith("https"), "POST").otherwise("GET")


def links(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def route_table(t: Tables) -> DataFrame:
    """Routes are few (distinct path shapes); their id is their place in order."""
    rows = t.pages.filter("page_id % 2 = 0").select(method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path")).distinct()
    # A readable, order-preserving id: method and path together, so no global sort is needed.
    return rows.select(F.concat_ws(" ", "http_method", "path").alias("route_id"), "http_method", "path", paths.service_candidate(F.col("path")).alias("service_candidate"))


def call_table(t: Tables) -> DataFrame:
    own = t.pages.filter("page_id % 2 = 1").select(method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path"))
    rows = own.unionByName(links(t).select(F.lit("GET").alias("http_method"), page_path(F.col("href")).alias("path")))
    rows = rows.groupBy("http_method", "path").agg(F.count("*").alias("n"))
    return rows.select(
        F.concat_ws(" ", "http_method", "path").alias("contract_id"), "http_method", "path", "n", paths.service_candidate(F.col("path")).alias("service_candidate"), F.lit(False).alias("unsafe_dynamic"), F.lit(False).alias("internal")
    )


@query(_FUNNEL)
def contract_match_funnel(t: Tables) -> DataFrame:
    found = match.contract_matches(call_table(t), route_table(t), carry=["n"])
    return found.groupBy("issue", "confidence").agg(F.count("*").alias("calls"), F.sum("n").alias("uses"))


@query(
    _SQL
    + """
SELECT count(*) AS total, count(*) FILTER (exact IS NOT NULL) AS resolved, count(*) FILTER (exact IS NULL AND any_route IS NOT NULL) AS method_mismatch,
  CAST(0 AS BIGINT) AS dynamic, count(*) FILTER (any_route IS NULL AND service <> '' AND service NOT IN (SELECT service FROM services)) AS out_of_scope,
  count(*) FILTER (any_route IS NULL AND (service = '' OR service IN (SELECT service FROM services))) AS missing, CAST(0 AS BIGINT) AS other FROM keyed"""
)
def contract_summary(t: Tables) -> DataFrame:
    return aggregate.contract_summary(match.contract_matches(call_table(t), route_table(t)))


@query(
    rf"""
WITH routes AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS host, CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS m, {_PATH} AS path FROM pages WHERE page_id % 2 = 0),
calls AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS m, {_PATH} AS path FROM pages WHERE page_id % 2 = 1),
c AS (SELECT page_id, count(*) FILTER (r.m = c.m) AS exact, count(r.m) AS any_method FROM calls c LEFT JOIN routes r ON lower(r.path) = lower(c.path) GROUP BY 1)
SELECT page_id AS contract_id, exact AS candidates,
  CASE WHEN exact = 1 THEN 'matched' WHEN exact > 1 THEN 'ambiguous_route' WHEN any_method > 0 THEN 'method_mismatch' ELSE 'missing_backend_route' END AS issue,
  CASE WHEN exact = 1 THEN 'RESOLVED' WHEN exact > 1 THEN 'AMBIGUOUS' WHEN any_method > 0 THEN 'MISMATCH' ELSE 'UNRESOLVED' END AS confidence FROM c"""
)
def contract_match_ambiguous(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "://([^/]+)", 1)
    routes = t.pages.filter("page_id % 2 = 0").select(F.concat_ws(" ", host, method(F.col("url")), page_path(F.col("url"))).alias("route_id"), method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path")).distinct()
    calls = t.pages.filter("page_id % 2 = 1").select(F.col("page_id").alias("contract_id"), method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path"))
    return match.workspace_matches(calls, routes).select("contract_id", "candidates", "issue", "confidence")


@query(
    rf"""
WITH routes AS (SELECT DISTINCT CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS m, {_PATH} AS path FROM pages WHERE page_id % 2 = 0),
calls AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS m, {_PATH} AS path FROM pages WHERE page_id % 2 = 1),
p AS (SELECT page_id, c.m AS cm, r.m AS rm, r.path AS rp, list_filter(string_split(c.path, '/'), lambda x: x <> '') AS a, list_filter(string_split(r.path, '/'), lambda x: x <> '') AS b FROM calls c JOIN routes r ON split_part(c.path, '/', 2) = split_part(r.path, '/', 2)),
s AS (SELECT page_id, rm || ' ' || rp AS route_label, CASE WHEN cm = rm THEN 3 ELSE 0 END + 4 + CASE WHEN len(a) > 1 AND len(b) > 1 AND lower(a[2]) = lower(b[2]) THEN 2 ELSE 0 END + CASE WHEN abs(len(a) - len(b)) <= 1 THEN 1 ELSE 0 END AS score FROM p)
SELECT page_id AS contract_id, CAST(rank AS INTEGER) AS rank, route_label, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, route_label) AS rank FROM s) WHERE rank <= 3"""
)
def similar_routes_top3(t: Tables) -> DataFrame:
    calls = t.pages.filter("page_id % 2 = 1").select(F.col("page_id").alias("contract_id"), method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path"))
    calls = calls.withColumn("service_candidate", paths.service_candidate(F.col("path")))
    return match.similar_routes(calls, route_table(t))


@query(
    rf"""
WITH p AS (SELECT DISTINCT page_id % 2 AS side, CASE WHEN url LIKE 'https%' THEN 'POST' ELSE 'GET' END AS m, {_PATH} AS path FROM pages)
SELECT DISTINCT c.m || ' ' || c.path AS contract_id, r.path AS candidate FROM p c JOIN p r ON c.side = 1 AND r.side = 0 AND c.m = r.m AND split_part(c.path, '/', 2) = split_part(r.path, '/', 2)
WHERE len(string_split(c.path, '/')) = len(string_split(r.path, '/'))"""
)
def dynamic_candidates(t: Tables) -> DataFrame:
    calls = t.pages.filter("page_id % 2 = 1").select(method(F.col("url")).alias("http_method"), page_path(F.col("url")).alias("path")).distinct()
    calls = calls.withColumn("contract_id", F.concat_ws(" ", "http_method", "path")).withColumn("service_candidate", paths.service_candidate(F.col("path")))
    return match.dynamic_candidates(calls, route_table(t))


@query(rf"SELECT page_id, {_NORMAL.format('url')} AS path FROM pages")
def url_normalise(t: Tables) -> DataFrame:
    return t.pages.select("page_id", paths.normalise(F.col("url")).alias("path"))


@query(
    r"""SELECT page_id, array_to_string(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)), '&') AS params FROM pages"""
)
def query_params_sorted(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.array_join(paths.query_params(F.col("url")), "&").alias("params"))


@query(
    rf"""SELECT CASE WHEN f = '' THEN '' ELSE 'ms-' || regexp_replace(lower(f), 's$', '') END AS service, count(*) AS contracts FROM (SELECT split_part({_PATH}, '/', 2) AS f FROM pages) GROUP BY 1"""
)
def service_candidate_counts(t: Tables) -> DataFrame:
    return t.pages.groupBy(paths.service_candidate(page_path(F.col("url"))).alias("service")).agg(F.count("*").alias("contracts"))


@query(
    rf"""
WITH w AS (SELECT {_PATH} AS file, 2 AS weight FROM pages UNION ALL SELECT {_NORMAL.format("href")}, 1 FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages))
SELECT file, CAST(sum(weight) AS BIGINT) AS connections FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def link_graph_degree(t: Tables) -> DataFrame:
    own = t.pages.select(page_path(F.col("url")).alias("file"), F.lit(2).alias("weight"))
    return aggregate.most_connected(own.unionByName(links(t).select(paths.normalise(F.col("href")).alias("file"), F.lit(1).alias("weight"))), 20)
