"""Files, lines, text facts and ranking over documents and small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import blocks, lines, token_estimate, tokens
from ..operators import aggregate, extract, integrity, rank, resolve, sequence
from ..sources import files
from .registry import Tables, query

_EXT = "['.go','.py','.md','.ts','.txt','.sh']"


def _doc_files(t: Tables) -> DataFrame:
    """Documents as files: folder by source, extension by id."""
    ext = F.get(F.array(*(F.lit(x) for x in (".go", ".py", ".md", ".ts", ".txt", ".sh"))), (F.col("doc_id") % 6).cast("int"))
    return t.documents.select("doc_id", F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("path"), F.encode("text", "UTF-8").alias("content"), "text")


_DOC_FILES = f"(SELECT doc_id, source || '/d' || doc_id || {_EXT}[CAST(doc_id % 6 AS INTEGER) + 1] AS path, text FROM documents)"


@query(
    f"""SELECT split_part(path, '/', 1) AS module, CASE regexp_extract(path, '(\\.[^.]*)$', 1) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.ts' THEN 'typescript' WHEN '.sh' THEN 'shell' ELSE 'text' END AS language,
count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(sha256(text)) AS smallest_hash FROM {_DOC_FILES} GROUP BY 1, 2"""
)
def file_inventory(t: Tables) -> DataFrame:
    return aggregate.module_counts(files.file_records(_doc_files(t)), F.sum("size").alias("bytes"), F.min("sha256").alias("smallest_hash"))


@query(f"SELECT split_part(path, '/', 1) AS module, count(*) AS files, sha256(array_to_string(list_sort(list(path || chr(0) || sha256(text))), chr(0))) AS fingerprint FROM {_DOC_FILES} GROUP BY 1")
def fingerprint(t: Tables) -> DataFrame:
    rows = files.file_records(_doc_files(t))
    return ids.fingerprints(rows.withColumn("module", F.get(F.split("path", "/"), F.lit(0))), "module")


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
s AS (SELECT doc_id, line_no, length(line) - length(replace(line, '.', '')) AS closes, length(line) - length(replace(line, ',', '')) AS opens FROM l),
d AS (SELECT *, sum(opens - closes) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM s),
b AS (SELECT *, depth - (opens - closes) AS before FROM d),
n AS (SELECT *, sum(CASE WHEN before <= 0 AND opens > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM b)
SELECT doc_id, CAST(min(line_no) AS INTEGER) AS start_line, CAST(min(CASE WHEN depth <= 0 THEN line_no END) AS INTEGER) AS end_line FROM n WHERE block > 0 GROUP BY doc_id, block"""
)
def line_blocks(t: Tables) -> DataFrame:
    return blocks(lines(t.documents, "text", "doc_id"), "doc_id", ",", ".")


@query(
    """SELECT name, count(*) AS lines, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, regexp_extract(unnest(string_split(text, chr(10))), '^([A-Z][a-z]+) ', 1) AS name FROM documents) WHERE name <> '' GROUP BY 1"""
)
def line_symbols_regex(t: Tables) -> DataFrame:
    rows = lines(t.documents, "text", "doc_id").select("doc_id", F.regexp_extract("line", "^([A-Z][a-z]+) ", 1).alias("name")).filter("name <> ''")
    return rows.groupBy("name").agg(F.count("*").alias("lines"), F.count_distinct("doc_id").alias("documents"))


@query(
    r"""SELECT doc_id, len(list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 2))) AS tokens,
  len(list_intersect(['the', 'and', 'with', 'under'], string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'))) AS matched, CAST(ceil(length(text) / 4.0) AS BIGINT) AS token_estimate FROM documents"""
)
def tokens_per_document(t: Tables) -> DataFrame:
    # The tokens are a projection of their own, as two outputs read them.
    rows = t.documents.select("doc_id", tokens(F.lower("text"), cased=False).alias("own"), token_estimate(F.col("text")).alias("token_estimate"))
    asked = F.array(*(F.lit(w) for w in ("the", "and", "with", "under")))
    return rows.select("doc_id", F.size(F.filter("own", lambda x: x.rlike(r"^\p{L}"))).cast("long").alias("tokens"), F.size(F.array_intersect(asked, F.col("own"))).cast("long").alias("matched"), "token_estimate")


@query(
    r"""WITH s AS (SELECT doc_id AS fact_id, len(list_intersect(['erthe', 'nation', 'the', 'thing', 'ver'], string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'))) AS matched FROM documents)
SELECT fact_id, CAST(matched AS INTEGER) AS matched, CAST(matched * 60 + CASE WHEN matched = 5 THEN 500 ELSE 0 END AS INTEGER) AS score FROM s WHERE matched > 0 ORDER BY score DESC, matched DESC, fact_id LIMIT 20"""
)
def lexical_rank_top20(t: Tables) -> DataFrame:
    facts = t.documents.select(F.col("doc_id").alias("fact_id"), F.lit("").alias("name"), F.lit("").alias("qualified_name"), F.lit("EXTRACTED").alias("confidence"), F.lower("text").alias("text"))
    return rank.rank_facts(facts, "the thing nation ver erthe", 20, cased=False).select("fact_id", "matched", "score")


@query(
    """SELECT p_partkey, p_name, p_brand, CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS n FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'red') ORDER BY p_partkey LIMIT 20 OFFSET 20"""
)
def free_text_filter_page2(t: Tables) -> DataFrame:
    from ..plans.tasks import page

    rows = t.part.filter(rank.free_text(" RED ", "p_name", "p_brand", "p_type")).select("p_partkey", "p_name", "p_brand")
    return page(rows, ["p_partkey"], 20, 20)


@query(
    """SELECT source, label FROM (
SELECT 0 AS o, 'nation' AS source, n_name AS label FROM nation WHERE contains(lower(n_name), '1') UNION ALL
SELECT 1, 'supplier', s_name FROM supplier WHERE contains(lower(s_name), '1') UNION ALL
SELECT 2, 'customer', c_name || ' ' || c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), '1')) ORDER BY o, label LIMIT 100"""
)
def search_union(t: Tables) -> DataFrame:
    return rank.search("1", 100, ("nation", t.nation, ["n_name"]), ("supplier", t.supplier, ["s_name"]), ("customer", t.customer, ["c_name", "c_mktsegment"]))


@query(
    """
WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY 1), d AS (SELECT doc_id, min(lang) AS lang FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN l.quality = 1 THEN 'EXACT' WHEN d.doc_id IS NOT NULL THEN 'INFERRED' ELSE 'WEAK' END AS confidence, nullif(d.lang, '') AS text,
  CASE WHEN l.doc_id IS NULL THEN 'doc' WHEN d.doc_id IS NULL THEN 'label' ELSE 'doc,label' END AS evidence FROM d FULL JOIN l USING (doc_id)"""
)
def merge_stronger(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", F.lit("INFERRED").alias("confidence"), F.col("lang").alias("text"), F.lit("doc").alias("evidence"))
    strength = F.when(F.col("quality") == 1, "EXACT").when(F.col("quality") == 0, "WEAK")
    labels = t.labels.select("doc_id", strength.alias("confidence"), F.lit("").alias("text"), F.lit("label").alias("evidence")).filter("confidence is not null")
    return aggregate.merge_facts(docs.unionByName(labels), "doc_id")


@query("""SELECT d.doc_id, COALESCE(CASE WHEN l.quality = 1 THEN 'good' END, d.lang) AS label, d.source AS origin FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merge_first_nonempty(t: Tables) -> DataFrame:
    labels = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("").alias("label"), F.lit("").alias("origin"), F.lit(0).alias("o"))
    docs = t.documents.select("doc_id", F.col("lang").alias("label"), F.col("source").alias("origin"), F.lit(1).alias("o"))
    return aggregate.merge_nodes(labels.unionByName(docs), "doc_id", "o", "label", "origin").join(t.documents.select("doc_id"), "doc_id", "left_semi")


@query("SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return integrity.duplicate_ids(t.lineitem, "l_orderkey")


@query("SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def dangling_refs(t: Tables) -> DataFrame:
    return integrity.dangling(t.labels, "doc_id", t.documents.filter("doc_id % 3 <> 0"), "doc_id").select("doc_id", "quality")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'unrecorded' ELSE 'stale' END AS state FROM documents WHERE doc_id % 7 = 0 AND NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)
UNION ALL SELECT CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'unrecorded' END FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 11 = 0) <> (doc_id % 13 = 0)"""
)
def stale_hash(t: Tables) -> DataFrame:
    path = F.col("doc_id").cast("string").alias("path")
    recorded = t.documents.filter("doc_id % 13 <> 0").select(path, F.sha2("text", 256).alias("sha"))
    current = t.documents.filter("doc_id % 11 <> 0").select(path, F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"))
    return integrity.stale(recorded, current, "path", "sha")


@query(
    """
WITH RECURSIVE r AS (SELECT source, doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents),
f AS (SELECT source, doc_id, cost, n, cost <= 4000 AS taken, CASE WHEN cost <= 4000 THEN cost ELSE 0 END AS used FROM r WHERE n = 1
  UNION ALL SELECT r.source, r.doc_id, r.cost, r.n, f.used + r.cost <= 4000, f.used + CASE WHEN f.used + r.cost <= 4000 THEN r.cost ELSE 0 END FROM f JOIN r ON r.source = f.source AND r.n = f.n + 1)
SELECT source, doc_id, cost, taken FROM f"""
)
def budget_pack(t: Tables) -> DataFrame:
    rows = t.documents.select("source", "n_chars", "doc_id", token_estimate(F.col("text")).alias("cost"))
    return sequence.budget_fold(rows, "source", ["n_chars", "doc_id"], "cost", 4000).select("source", "doc_id", "cost", "taken")


@query(
    """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'conflicting_provider_security' WHEN quality = 1 AND doc_id % 2 = 0 THEN 'credentials_on_public_endpoint'
WHEN quality = 0 AND toxic = 1 AND doc_id % 2 = 1 THEN 'missing_call_auth_evidence' WHEN quality = 0 AND toxic = 1 AND doc_id % 4 = 0 THEN 'auth_scheme_mismatch' ELSE '' END AS mismatch FROM labels"""
)
def security_conflict(t: Tables) -> DataFrame:
    provider = F.filter(F.array(F.when(F.col("quality") == 1, "permitAll()"), F.when(F.col("toxic") == 1, "oauth2Login")), lambda x: x.isNotNull())
    call = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("basic"))).when(F.col("doc_id") % 2 == 0, F.array(F.lit("jwt"))).otherwise(F.array().cast("array<string>"))
    kinds = lambda a: F.transform(a, integrity.security_kind)
    return t.labels.select("doc_id", integrity.security_mismatch(kinds(call), kinds(provider)).alias("mismatch"))


@query(
    """SELECT event_id, substr(sha1(CAST(user_id AS VARCHAR) || chr(0) || event_type || chr(0)), 1, 24) AS stable, substr(sha256(CAST(event_id AS VARCHAR) || chr(0) || event_type), 1, 32) AS evidence, lower(event_type) || ':' || user_id AS workspace FROM events"""
)
def stable_ids(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", ids.stable_id(F.col("user_id"), F.col("event_type")).alias("stable"), ids.evidence_id(F.col("event_id"), F.col("event_type")).alias("evidence"), ids.workspace_id(F.col("event_type"), F.lit(" "), F.col("user_id")).alias("workspace")
    )


@query(
    """
WITH g AS (SELECT l.lang AS language, c.capability FROM (SELECT DISTINCT lang FROM documents) l, (SELECT unnest(['symbols','relations','calls','routes','api_clients','tests','persistence','messaging','data_flow']) AS capability) c),
f AS (SELECT d.lang AS language, CASE WHEN quality = 1 THEN 'symbols' ELSE 'tests' END AS capability, count(*) AS n FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT language, capability, COALESCE(n, 0) AS n, CASE WHEN COALESCE(n, 0) > 0 THEN 'COMPLETE' ELSE 'UNAVAILABLE' END AS coverage FROM g LEFT JOIN f USING (language, capability)"""
)
def capability_inventory(t: Tables) -> DataFrame:
    facts = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("language"), F.when(F.col("quality") == 1, "symbols").otherwise("tests").alias("capability"))
    return aggregate.capability_inventory(facts, t.documents.select(F.col("lang").alias("language")))


@query(
    """SELECT u.p_partkey AS use_id, c.s_suppkey AS supplier, CASE c.t WHEN 0 THEN 'same_key' WHEN 1 THEN 'same_digit' ELSE 'any' END AS tier FROM part u, LATERAL (
SELECT s_suppkey, CASE WHEN s_suppkey = u.p_partkey % 100 THEN 0 WHEN s_suppkey % 10 = u.p_partkey % 10 THEN 1 ELSE 2 END AS t FROM supplier WHERE s_nationkey = u.p_size % 25 ORDER BY 2, 1 LIMIT 1) c"""
)
def call_resolution_priority(t: Tables) -> DataFrame:
    uses = t.part.select(F.col("p_partkey").alias("use_id"), (F.col("p_size") % 25).alias("s_nationkey"))
    own, key = F.col("use_id"), F.col("s_suppkey")
    tiers = [resolve.Tier("same_key", ((own % 100, key),)), resolve.Tier("same_digit", ((own % 10, key % 10),)), resolve.Tier("any")]
    found = resolve.by_priority(uses, t.supplier.select("s_nationkey", "s_suppkey", F.col("s_suppkey").alias("supplier")), "s_nationkey", "use_id", "s_suppkey", tiers, "supplier")
    return found.select("use_id", "supplier", "tier")


@query(
    """WITH l AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT 's' || doc_id AS path, line_no, trim(regexp_extract(line, '^\\s*(?:source|\\.)\\s+(.+?)(?:\\s|$)', 1)) AS target, 'sources' AS type FROM l WHERE trim(regexp_extract(line, '^\\s*(?:source|\\.)\\s+(.+?)(?:\\s|$)', 1)) <> ''
UNION ALL SELECT 'p' || doc_id, line_no, regexp_extract(line, '^\\s*import\\s+([A-Za-z_][A-Za-z0-9_.]*)', 1), 'imports' FROM l WHERE regexp_matches(line, '^\\s*import\\s+([A-Za-z_][A-Za-z0-9_.]*)')"""
)
def line_relations_regex(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text")
    own = rows.select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("path"), F.lit("shell").alias("language"), F.col("text").alias("content"))
    own = own.unionByName(rows.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.lit("python").alias("language"), F.col("text").alias("content")))
    return extract.relations(own).filter("not (language = 'python' and line_no < 0)").select("path", "line_no", "target", "type")
