"""Text scalars, detectors, catalogues and record operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.functions import text as fn
from stratalens.operators.corpus import files, lines, token_kinds, token_places, tokens, whole_paths
from stratalens.operators.detectors import PATTERNS, detect, may_hold_sites
from stratalens.plans.registry import query
from stratalens.plans.search import FILES, LINES
from stratalens.session import table

STOPS = "[" + ", ".join(f"'{w}'" for w in fn.STOP) + "]"


@query(
    "identifier_phrases",
    r"""WITH i AS (SELECT p_partkey, 'get' || upper(substr(p_name, 1, 1)) || replace(substr(p_name, 2), ' ', '_') || 'XMLValue' || p_size AS name FROM part)
        SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\s.:-]+', ' ', 'g'))) AS phrase FROM i""",
)
def identifier_phrases(spark, sf_dir):
    """Identifiers as spaced words."""
    name = F.concat(F.lit("get"), F.upper(F.substring("p_name", 1, 1)), F.replace(F.substr("p_name", F.lit(2)), F.lit(" "), F.lit("_")), F.lit("XMLValue"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", fn.identifier_phrase(name).alias("phrase"))


@query(
    "stems",
    f"""WITH {FILES}, w AS (SELECT path, unnest(regexp_extract_all(lower(content), '[a-z]{{{{4,}}}}')) AS w FROM files), s AS (SELECT path, substr(regexp_replace(w, '(ation|ing|ed|es|ly|s)$', ''), 1, 6) AS stem FROM w)
        SELECT stem, count(*) AS uses, count(DISTINCT path) AS files FROM s GROUP BY stem""".replace("{{", "{").replace("}}", "}"),
)
def stems(spark, sf_dir):
    """Stems with their uses."""
    w = files(spark, sf_dir).select("path", F.explode(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0))).alias("w"))
    per = w.groupBy(fn.stem(F.col("w")).alias("stem"), "path").agg(F.count("*").alias("n"))
    return per.groupBy("stem").agg(F.sum("n").alias("uses"), F.count("*").alias("files"))


@query(
    "content_words",
    f"""SELECT item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')), lambda w: NOT list_contains({STOPS}, w))), ' ') AS words FROM benchmark""",
)
def content_words(spark, sf_dir):
    """Each item's distinct words that carry content."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(fn.content_words(F.col("text")), " ").alias("words"))


@query(
    "claim_elements",
    r"""WITH e AS (SELECT item_id, unnest(string_split_regex(text, '[.;]\s+')) AS element, generate_subscripts(string_split_regex(text, '[.;]\s+'), 1) AS n FROM benchmark) SELECT item_id, n, trim(element) AS element FROM e WHERE trim(element) <> ''""",
)
def claim_elements(spark, sf_dir):
    """Prose split into numbered elements."""
    e = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.;]\s+")).alias("at", "element"))
    return e.where(F.trim("element") != "").select("item_id", (F.col("at") + 1).alias("n"), F.trim("element").alias("element"))


@query(
    "triage",
    """WITH w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark), s AS (SELECT DISTINCT item_id, substr(regexp_replace(w, '(ation|ing|ed|es|ly|s)$', ''), 1, 6) AS stem FROM w),
       n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id), df AS (SELECT stem, count(*) AS df FROM s GROUP BY stem),
       r AS (SELECT item_id, round(count(CASE WHEN df = 1 THEN 1 END) / count(*), 6) AS rare_share FROM s JOIN df USING (stem) GROUP BY item_id),
       p AS (SELECT a.item_id, b.item_id AS other, count(*) AS shared FROM s a JOIN s b ON a.stem = b.stem AND a.item_id <> b.item_id GROUP BY 1, 2),
       m AS (SELECT p.item_id, max(shared / (x.n + y.n - shared)) AS closest FROM p JOIN n x ON x.item_id = p.item_id JOIN n y ON y.item_id = p.other GROUP BY 1)
       SELECT r.item_id, rare_share, round(coalesce(closest, 0), 6) AS closest, coalesce(closest, 0) < 0.8 AND rare_share > 0.1 AS keep FROM r LEFT JOIN m USING (item_id)""",
)
def triage(spark, sf_dir):
    """Per item, the share of its stems that no other has, and the closest other item by stems. Items are a fixed benchmark, not the corpus."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    s = w.select("item_id", fn.stem(F.col("w")).alias("stem")).distinct()
    n = s.groupBy("item_id").agg(F.count("*").alias("n"))
    df = s.groupBy("stem").agg(F.count("*").alias("df"))
    rare = s.join(df, "stem").groupBy("item_id").agg(F.round(F.count_if(F.col("df") == 1) / F.count("*"), 6).alias("rare_share"))
    other = s.withColumnRenamed("item_id", "other")
    p = s.join(other, "stem").where("item_id <> other").groupBy("item_id", "other").agg(F.count("*").alias("shared"))
    m = p.join(n, "item_id").join(n.select(F.col("item_id").alias("other"), F.col("n").alias("m")), "other")
    m = m.groupBy("item_id").agg(F.max(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("closest"))
    c = F.coalesce("closest", F.lit(0.0))
    return rare.join(m, "item_id", "left").select("item_id", "rare_share", F.round(c, 6).alias("closest"), ((c < 0.8) & (F.col("rare_share") > 0.1)).alias("keep"))


@query(
    "rubric_best",
    r"""WITH r AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS w FROM benchmark), q AS (SELECT item_id, count(*) AS n FROM r GROUP BY item_id),
        d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{5,}'))) AS w FROM documents), m AS (SELECT item_id, doc_id, count(*) AS shared FROM r JOIN d USING (w) GROUP BY 1, 2),
        s AS (SELECT item_id, doc_id, round(shared / n, 6) AS overlap FROM m JOIN q USING (item_id))
        SELECT item_id, arg_min(doc_id, (-overlap, doc_id)) AS doc_id, max(overlap) AS overlap, CASE WHEN max(overlap) >= 0.8 THEN 'MET' WHEN max(overlap) >= 0.4 THEN 'PARTIAL' ELSE 'ABSENT' END AS verdict FROM s GROUP BY item_id""",
)
def rubric_best(spark, sf_dir):
    """The document that overlaps most with each rubric row, and the verdict. Documents are filtered to the rubric's words first."""
    r = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))).alias("w"))
    q = r.groupBy("item_id").agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0)))).alias("w"))
    m = d.join(r, "w").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).join(q, "item_id").select("item_id", "doc_id", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))
    best = m.groupBy("item_id").agg(F.max(F.struct("overlap", -F.col("doc_id"))).alias("b")).select("item_id", (-F.col("b.col2")).alias("doc_id"), F.col("b.overlap").alias("overlap"))
    return best.withColumn("verdict", F.when(F.col("overlap") >= 0.8, "MET").when(F.col("overlap") >= 0.4, "PARTIAL").otherwise("ABSENT"))


@query(
    "grouping_recall",
    """WITH o AS (SELECT lang AS truth, source AS candidate, count(*) AS n FROM documents GROUP BY 1, 2), t AS (SELECT truth, sum(n)::BIGINT AS tn FROM o GROUP BY 1), c AS (SELECT candidate, sum(n)::BIGINT AS cn FROM o GROUP BY 1)
       SELECT truth, candidate, round(n / tn, 6) AS recall, round(n / cn, 6) AS "precision" FROM o JOIN t USING (truth) JOIN c USING (candidate) QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, candidate) = 1""",
)
def grouping_recall(spark, sf_dir):
    """For each group of the truth, the candidate group with the largest overlap."""
    o = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("truth"), F.col("source").alias("candidate")).agg(F.count("*").alias("n"))
    t, c = o.groupBy("truth").agg(F.sum("n").alias("tn")), o.groupBy("candidate").agg(F.sum("n").alias("cn"))
    w = Window.partitionBy("truth").orderBy(F.desc("n"), "candidate")
    j = o.join(t, "truth").join(c, "candidate").withColumn("r", F.row_number().over(w)).where("r = 1")
    return j.select("truth", "candidate", F.round(F.col("n") / F.col("tn"), 6).alias("recall"), F.round(F.col("n") / F.col("cn"), 6).alias("precision"))


@query(
    "fold_records",
    """WITH m AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS members FROM orders GROUP BY 1) SELECT members, min(o_custkey) AS representative, count(*) AS folded FROM m GROUP BY members""",
)
def fold_records(spark, sf_dir):
    """Records with equal members collapse to one."""
    m = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("members"))
    return m.groupBy("members").agg(F.min("o_custkey").alias("representative"), F.count("*").alias("folded"))


@query(
    "fingerprint_groups",
    f"""WITH {FILES}, t AS (SELECT path, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(content), '[a-z]{{{{3,}}}}'))), ' ') AS toks FROM files)
        SELECT substr(sha1(toks), 1, 10) AS fingerprint, count(*) AS n, min(path) AS first_path FROM t GROUP BY 1 HAVING count(*) > 1""".replace("{{", "{").replace("}}", "}"),
)
def fingerprint_groups(spark, sf_dir):
    """Files with the same token set."""
    t = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{3,}"), F.lit(0)))), " ")
    g = files(spark, sf_dir).select("path", F.substring(F.sha1(t), 1, 10).alias("fingerprint")).groupBy("fingerprint")
    return g.agg(F.count("*").alias("n"), F.min("path").alias("first_path")).where("n > 1")


@query(
    "rare_tokens",
    f"""WITH {FILES}, t AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM files), df AS (SELECT token, count(*) AS df FROM t GROUP BY token)
        SELECT path, count(CASE WHEN df = 1 THEN 1 END) AS own, count(CASE WHEN df BETWEEN 2 AND 20 THEN 1 END) AS shared, count(*) AS total FROM t JOIN df USING (token) GROUP BY path""",
)
def rare_tokens(spark, sf_dir):
    """Tokens of each file that no other or few others have. Only places of tokens in few files of a block are moved."""
    whole = whole_paths(files(spark, sf_dir))
    rare = token_places(whole, few=20).groupBy("token").agg(F.sum("files").alias("df"), F.flatten(F.collect_list("places")).alias("places")).where("df <= 20")
    each = rare.select("df", F.inline("places")).select("path", F.when(F.col("df") == 1, 1).otherwise(0).alias("own"), F.when(F.col("df") > 1, 1).otherwise(0).alias("shared"), F.lit(0).cast("long").alias("total"))
    all_of = token_kinds(whole).where("kinds > 0").select("path", F.lit(0).alias("own"), F.lit(0).alias("shared"), F.col("kinds").alias("total"))
    return each.union(all_of).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("own", "shared", "total")])


@query("cache_keys", "SELECT doc_id, substr(sha256('search: ' || substr(text, 1, 1500)), 1, 16) AS key FROM documents")
def cache_keys(spark, sf_dir):
    """The key under which a text's vector is kept: the operator hashes the first 1,500 characters, as the model sees no more."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat(F.lit("search: "), F.substring("text", 1, 1500)), 256), 1, 16).alias("key"))


@query(
    "incremental_plan",
    """WITH k AS (SELECT doc_id, source, sha256(text) AS h FROM documents), c AS (SELECT DISTINCT h FROM k WHERE source < 'src2') SELECT k.h AS hash, min(doc_id) AS first_doc, count(*) AS docs FROM k ANTI JOIN c USING (h) GROUP BY k.h""",
)
def incremental_plan(spark, sf_dir):
    """Texts whose vector is not cached yet, once each."""
    g = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("hash"))
    return g.agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("docs"), F.bool_or(F.col("source") < "src2").alias("cached")).where("NOT cached").drop("cached")


@query(
    "export_priority",
    """WITH e AS (SELECT p_brand AS package, p_name AS name, CASE WHEN p_size > 40 THEN 1 WHEN p_size > 20 THEN 2 ELSE 3 END AS tier FROM part)
       SELECT package, name, min(tier) AS tier, count(*) AS seen FROM e GROUP BY 1, 2""",
)
def export_priority(spark, sf_dir):
    """The strongest tier of each exported name."""
    tier = F.when(F.col("p_size") > 40, 1).when(F.col("p_size") > 20, 2).otherwise(3)
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("package"), F.col("p_name").alias("name")).agg(F.min(tier).alias("tier"), F.count("*").alias("seen"))


@query("used_by", "SELECT l_partkey AS export, count(DISTINCT l_suppkey) AS consumers, count(*) AS uses FROM lineitem GROUP BY 1")
def used_by(spark, sf_dir):
    """Consumers of each export."""
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("export"), "l_suppkey").agg(F.count("*").alias("n"))
    return per.groupBy("export").agg(F.count("*").alias("consumers"), F.sum("n").alias("uses"))


@query(
    "string_kinds",
    r"""WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, '"([^"<>]+)"', 1)) AS value FROM pages)
        SELECT CASE WHEN regexp_matches(value, '(?i)^\s*(select\s.+\sfrom|insert\s+into|update\s.+\sset|delete\s+from)\s') THEN 'sql' WHEN regexp_matches(value, '^[a-z]+://') THEN 'url'
               WHEN regexp_matches(value, '^(/|\./|[A-Za-z]:\\)?[\w.-]+(/[\w.-]+)+$') THEN 'path' WHEN regexp_matches(value, '^[A-Za-z_][A-Za-z0-9_]*$') THEN 'identifier' ELSE 'text' END AS kind,
               count(*) AS n, count(DISTINCT value) AS distinct_values FROM v GROUP BY 1""",
)
def string_kinds(spark, sf_dir):
    """Literals by what they look like."""
    v = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('"([^"<>]+)"'), F.lit(1))).alias("value"))
    per = v.groupBy("value").agg(F.count("*").alias("n"))
    return per.groupBy(fn.string_kind(F.col("value")).alias("kind")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_values"))


@query(
    "random_tokens",
    r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]{20,}')) AS token FROM documents), c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM w), n AS (SELECT token, ch, count(*) AS n FROM c GROUP BY 1, 2),
        e AS (SELECT token, -sum(n / length(token) * log2(n / length(token))) AS bits FROM n GROUP BY token) SELECT token, round(bits, 4) AS bits FROM e WHERE bits >= 3 AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]')""",
)
def random_tokens(spark, sf_dir):
    """Tokens shaped like keys."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]{20,}"), F.lit(0))).alias("token")).distinct()
    return w.where(fn.looks_random(F.col("token"))).select("token", F.round(fn.entropy(F.col("token")), 4).alias("bits"))


@query(
    "file_digest",
    f"""WITH {FILES}, {LINES} SELECT path, count(*) AS lines, max(length(line)) AS longest, count(CASE WHEN trim(line) = '' THEN 1 END) AS blank, sum(len(regexp_extract_all(line, '"[^"]*"')))::BIGINT AS quoted FROM lines GROUP BY path""",
)
def file_digest(spark, sf_dir):
    """What a file holds, in the row: its lines are never exploded."""
    own = F.split("content", "\n", -1)
    return files(spark, sf_dir).select(
        "path",
        F.size(own).cast("long").alias("lines"),
        F.array_max(F.transform(own, F.length)).cast("long").alias("longest"),
        F.size(F.filter(own, lambda x: F.trim(x) == "")).cast("long").alias("blank"),
        F.aggregate(F.transform(own, lambda x: F.regexp_count(x, F.lit('"[^"]*"'))), F.lit(0).cast("long"), lambda s, n: s + n).alias("quoted"),
    )


@query(
    "copyright_holders",
    r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line, doc_id FROM documents), h AS (SELECT doc_id, nullif(trim(regexp_replace(regexp_extract(line, '(?i)copyright\s+(?:\(c\)\s*)?(?:[0-9][0-9, -]*)?(.*)$', 1), '(?i)all rights reserved.*$|[.,;]+$', '', 'g')), '') AS holder FROM l WHERE contains(lower(line), 'copyright'))
        SELECT trim(regexp_replace(regexp_replace(lower(holder), '[^a-z0-9 ]', '', 'g'), '\b(inc|ltd|llc|gmbh|corp|co)\b', '', 'g')) AS key, count(DISTINCT doc_id) AS files, count(DISTINCT holder) AS spellings FROM h WHERE holder IS NOT NULL GROUP BY 1""",
)
def copyright_holders(spark, sf_dir):
    """Holders named in notices, spellings met."""
    l = lines(files(spark, sf_dir)).where(F.contains(F.lower("line"), F.lit("copyright"))).select("doc_id", fn.holder(F.col("line")).alias("holder")).where("holder IS NOT NULL")
    return l.groupBy(fn.holder_key(F.col("holder")).alias("key")).agg(F.count_distinct("doc_id").alias("files"), F.count_distinct("holder").alias("spellings"))


def _detector_sql() -> str:
    cells = list(dict.fromkeys(p[0] for p in PATTERNS))
    union = []
    for cell in cells:
        case = " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{f}|{str(a).lower()}'" for c, f, a, p in PATTERNS if c == cell)
        union.append(f"SELECT path, line_no, '{cell}' AS cell, CASE {case} END AS hit FROM lines")
    return f"""WITH {FILES}, {LINES}, h AS ({" UNION ALL ".join(union)}), s AS (SELECT path, line_no, cell, split_part(hit, '|', 1) AS family, split_part(hit, '|', 2) = 'true' AS anchor FROM h WHERE hit IS NOT NULL),
        g AS (SELECT *, bool_or(anchor) OVER (PARTITION BY path, cell) AS gate FROM s) SELECT path, line_no, cell, family, anchor FROM g WHERE anchor OR gate"""


@query("detector_sites", _detector_sql())
def detector_sites(spark, sf_dir):
    """Detector hits over the corpus, weak ones gated by an anchor in their file."""
    some = files(spark, sf_dir).withColumn("_low", F.lower("content")).where(may_hold_sites(F.col("content"), F.col("_low")))
    return detect(lines(some).select("path", "line_no", "line"))


@query(
    "detector_groups",
    f"WITH s AS ({_detector_sql()}) SELECT cell, family, count(*) AS sites, count(DISTINCT path) AS files, min(path) AS representative FROM s GROUP BY 1, 2",
)
def detector_groups(spark, sf_dir):
    """Sites by cell and family."""
    per = detector_sites(spark, sf_dir).groupBy("cell", "family", "path").agg(F.count("*").alias("n"))
    return per.groupBy("cell", "family").agg(F.sum("n").alias("sites"), F.count("*").alias("files"), F.min("path").alias("representative"))


@query(
    "sub_token_partition",
    """WITH t AS (SELECT DISTINCT p_brand AS grp, p_partkey, unnest(string_split(lower(p_name), ' ')) AS sub FROM part), g AS (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1), c AS (SELECT grp, sub, count(*) AS k FROM t GROUP BY 1, 2)
       SELECT grp, sub, k FROM c JOIN g USING (grp) WHERE k >= 3 AND k < 0.9 * n QUALIFY row_number() OVER (PARTITION BY grp ORDER BY k DESC, sub) <= 5""",
)
def sub_token_partition(spark, sf_dir):
    """The sub-tokens that would split a large group best."""
    part = table(spark, sf_dir, "part")
    t = part.select(F.col("p_brand").alias("grp"), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("sub"))
    g = part.groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n"))
    c = t.groupBy("grp", "sub").agg(F.count("*").alias("k")).join(g, "grp").where("k >= 3 AND k < 0.9 * n")
    w = Window.partitionBy("grp").orderBy(F.desc("k"), "sub")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 5").select("grp", "sub", "k")


MODEL_ID = r"\b(?:[a-z]+-)?(?:bert|gpt|llama|mistral|gemma|qwen|phi|t5|clip|whisper)-[A-Za-z0-9.]+(?:-[A-Za-z0-9.]+)*"


@query(
    "models_used",
    f"""WITH {FILES}, m AS (SELECT path, lower(unnest(regexp_extract_all(content, '(?i){MODEL_ID}'))) AS model FROM files)
        SELECT model, count(*) AS sites, count(DISTINCT path) AS files FROM m GROUP BY 1""",
)
def models_used(spark, sf_dir):
    """Distinct ids of models over the corpus, with their sites."""
    m = files(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("content", F.lit(f"(?i){MODEL_ID}"), F.lit(0))).alias("model"))
    per = m.groupBy(F.lower("model").alias("model"), "path").agg(F.count("*").alias("n"))
    return per.groupBy("model").agg(F.sum("n").alias("sites"), F.count("*").alias("files"))
