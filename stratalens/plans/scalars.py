"""Small predicates and texts, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.plans.registry import QUERIES, query
from stratalens.session import table

# Signatures of images in base64, names of minifiable files, and of what binaries are dumped to.
IMAGE = "^(iVBORw0KGgo|R0lGOD|PHN2Zy)"
SCRIPT, MINIFIED, DUMP = r"(?i)\.(js|css|jsx|ts|tsx)$", r"(?i)\.min\.(js|css|jsx|ts|tsx)$", r"(?i)\.op$"
#: Members named in one chunk of an entry's text, and the longest text.
CHUNK, CUT = 8, 1500
#: Margins over the median below which nothing matches, and below which it is borderline; the shortest list with a median.
NO_MATCH, BORDERLINE, FEWEST = 0.12, 0.16, 10


def base64_blob(token: Column) -> Column:
    """A payload, not a name: no separators, and an image's signature from 24 characters on, or from 64 only base64 signs."""
    long = (F.length(token) >= 64) & (F.contains(token, F.lit("data:image/")) | token.rlike("^[A-Za-z0-9+/]+={0,2}$"))
    return ~token.rlike("[_-]") & (((F.length(token) >= 24) & token.rlike(IMAGE)) | long)


def minified(path: Column, content: Column) -> Column:
    """Scripts named so, with more than 500 characters a line that is not empty, or a line of more than 2,000."""
    lines = F.filter(F.split(content, "\n", -1), lambda x: F.length(x) > 0)
    dense = (F.length(content) / F.size(lines) > 500) | (F.array_max(F.transform(lines, lambda x: F.length(x))) > 2000)
    return path.rlike(MINIFIED) | (path.rlike(SCRIPT) & (F.size(lines) > 0) & F.coalesce(dense, F.lit(False)))


def pseudo_source(path: Column) -> Column:
    """Strings dumped from a binary: to be searched, not to be scored as functions."""
    return path.rlike(DUMP)


def band_word(margin: Column, n: Column, least: float, clear: float, fewest: int) -> Column:
    """What a margin over the median says; nothing of a list too short for a median."""
    return F.when(n < fewest, "").when(margin < least, "no clear match").when(margin < clear, "borderline").otherwise("")


@query(
    "base64_blobs",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\x0B\\x0C]+')) AS token FROM documents)
       SELECT doc_id, count(*) AS blobs FROM t WHERE NOT regexp_matches(token, '[_-]') AND ((length(token) >= 24 AND regexp_matches(token, '^(iVBORw0KGgo|R0lGOD|PHN2Zy)'))
         OR (length(token) >= 64 AND (contains(token, 'data:image/') OR regexp_full_match(token, '[A-Za-z0-9+/]+={0,2}')))) GROUP BY doc_id""",
)
def base64_blobs(spark, sf_dir):
    """Documents with payloads among their words."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0B\x0C]+"), F.lit(0))).alias("token"))
    return words.where(base64_blob(F.col("token"))).groupBy("doc_id").agg(F.count("*").alias("blobs"))


@query(
    "minified_documents",
    """WITH d AS (SELECT doc_id, source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.min.js' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.op' END AS path, text, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS l FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
       SELECT doc_id, path LIKE '%.min.js' OR (path LIKE '%.js' AND length(l) > 0 AND (length(text) / length(l) > 500 OR list_max(list_transform(l, lambda x: length(x))) > 2000)) AS minified, path LIKE '%.op' AS pseudo FROM d""",
)
def minified_documents(spark, sf_dir):
    """Which documents would be minified scripts, or dumps, under names of four kinds."""
    kind = F.element_at(F.array(*map(F.lit, (".min.js", ".js", ".py", ".op"))), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND source IS NOT NULL").withColumn("path", F.concat("source", F.lit("/"), "doc_id", kind))
    return d.select("doc_id", minified(F.col("path"), F.col("text")).alias("minified"), pseudo_source(F.col("path")).alias("pseudo"))


@query(
    "literal_words",
    """WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]*)"', 1)) AS s FROM documents), w AS (SELECT doc_id, lower(unnest(regexp_extract_all(s, '[A-Za-z]{3,}'))) AS w FROM q)
       SELECT doc_id, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM w GROUP BY doc_id""",
)
def literal_words(spark, sf_dir):
    """Words of three letters or more in quoted strings, each once."""
    strings = F.regexp_extract_all("text", F.lit('"([^"\\n]*)"'), F.lit(1))
    words = F.flatten(F.transform(strings, lambda s: F.regexp_extract_all(s, F.lit("[A-Za-z]{3,}"), F.lit(0))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.array_distinct(F.transform(words, lambda w: F.lower(w)))).alias("w")).where(F.size("w") > 0)
    return d.select("doc_id", F.array_join("w", " ").alias("words"))


@query(
    "entry_chunks",
    f"""WITH m AS (SELECT p_brand, p_name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // {CHUNK} AS chunk, p_partkey FROM part)
        SELECT p_brand, chunk::BIGINT AS chunk, left(p_brand || ': ' || string_agg(p_name, ', ' ORDER BY p_partkey), {CUT}) AS text FROM m GROUP BY 1, 2""",
)
def entry_chunks(spark, sf_dir):
    """The texts of an entry: its label and runs of eight members. Places in a label come from counts by range of the key,
    so that no label is sorted in one task."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    cell = F.floor(F.col("p_partkey") / 4096)
    counts = p.groupBy("p_brand", cell.alias("cell")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("p_brand").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("p_brand", "cell").orderBy("p_partkey")) - 1 + F.col("before")
    m = p.withColumn("cell", cell).join(counts.select("p_brand", "cell", before.alias("before")), ["p_brand", "cell"]).withColumn("chunk", F.floor(place / CHUNK))
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    return m.groupBy("p_brand", "chunk").agg(names.alias("names")).select("p_brand", "chunk", F.substring(F.concat("p_brand", F.lit(": "), F.array_join("names", ", ")), 1, CUT).alias("text"))


UNIT = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), c AS (SELECT a.vec_id AS q_id, b.vec_id, b.label, round(list_cosine_similarity(a.e, b.e), 6) AS cos FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"


@query(
    "filter_ranked",
    f"""WITH {UNIT}, r AS (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS rank FROM c)
        SELECT q_id, r.vec_id, rank FROM r JOIN v USING (vec_id) WHERE rank <= 10 AND contains(label::VARCHAR, '1')""",
)
def filter_ranked(spark, sf_dir):
    """A filter after ranking: the ranks are those of the whole list."""
    top = QUERIES["cosine_topk"](spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cos"), "vec_id")))
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"))
    return top.join(labels, "vec_id").where(F.contains("label", F.lit("1"))).select("q_id", "vec_id", F.col("rank").cast("long").alias("rank"))


@query(
    "search_rows",
    f"""WITH {UNIT}, r AS (SELECT q_id, vec_id, cos, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, vec_id) AS rank FROM c), t AS (SELECT r.*, v.label FROM r JOIN v USING (vec_id) WHERE rank <= 10),
        k AS (SELECT q_id, label, min(rank) AS first_rank, max(cos) AS score, count(*) AS entries FROM t GROUP BY 1, 2)
        SELECT q_id, label, score, entries, row_number() OVER (PARTITION BY q_id ORDER BY first_rank) AS rank FROM k""",
)
def search_rows(spark, sf_dir):
    """Ranked entries of one function folded into a row, where the first of them ranked."""
    top = QUERIES["cosine_topk"](spark, sf_dir).withColumn("at", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cos"), "vec_id")))
    j = top.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").groupBy("q_id", "label").agg(F.min("at").alias("at"), F.max("cos").alias("score"), F.count("*").alias("entries"))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy("at"))
    return j.select("q_id", "label", "score", "entries", rank.cast("long").alias("rank"))


@query(
    "next_members",
    f"""WITH {UNIT}, r AS (SELECT q_id, c.label, vec_id, cos, row_number() OVER (PARTITION BY q_id, c.label ORDER BY cos DESC, vec_id) AS place FROM c WHERE c.label IS NOT NULL)
        SELECT q_id, label, vec_id, cos, (place - 1)::BIGINT AS next FROM r WHERE place BETWEEN 2 AND 3""",
)
def next_members(spark, sf_dir):
    """The two next-best members of each group, below the one that it ranked by."""
    from stratalens.plans.relations import _by_cell

    def best(q, q_labels, v, labels, cos, null, apart):
        """The first three of each query and label in the cell."""
        import numpy as np
        import pyarrow as pa

        out = {"q_id": [], "label": [], "vec_id": [], "cos": []}
        codes = labels.dictionary_encode()
        code, names = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        order = np.where(np.isnan(cos), np.inf, cos)
        for i in range(len(q)):
            j = np.flatnonzero(apart[i] & ~null[i] & (code >= 0))
            j = j[np.lexsort((v[j], -order[i, j], code[j]))]
            first = np.concatenate(([True], code[j][1:] != code[j][:-1])) if len(j) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(j)), 0)) if len(j) else j
            j = j[np.arange(len(j)) - start < 3]
            out["q_id"] += [int(q[i])] * len(j)
            out["label"] += [names[k] for k in code[j].tolist()]
            out["vec_id"] += v[j].tolist()
            out["cos"] += cos[i, j].tolist()
        return pa.table({"q_id": pa.array(out["q_id"], pa.int64()), "label": pa.array(out["label"], labels.type), "vec_id": pa.array(out["vec_id"], pa.int64()), "cos": pa.array(out["cos"], pa.float64())})

    found = _by_cell(spark, sf_dir, best, "q_id long, label {label}, vec_id long, cos double")
    place = F.row_number().over(Window.partitionBy("q_id", "label").orderBy(F.desc("cos"), "vec_id"))
    return found.withColumn("place", place).where("place BETWEEN 2 AND 3").select("q_id", "label", "vec_id", "cos", (F.col("place") - 1).cast("long").alias("next"))


@query(
    "skipped_extensions",
    """WITH e AS (SELECT lower(regexp_extract(url, '\\.([A-Za-z][A-Za-z0-9]{0,7})(?:[?#].*)?$', 1)) AS ext FROM pages), k AS (SELECT ext, count(*) AS files FROM e WHERE ext NOT IN ('', 'html', 'htm') GROUP BY ext HAVING count(*) >= 3)
       SELECT ext, files FROM k QUALIFY row_number() OVER (ORDER BY files DESC, ext) <= 12""",
)
def skipped_extensions(spark, sf_dir):
    """Extensions that are there and not read, of three files or more: the twelve most frequent."""
    e = table(spark, sf_dir, "pages").select(F.lower(F.regexp_extract("url", r"\.([A-Za-z][A-Za-z0-9]{0,7})(?:[?#].*)?$", 1)).alias("ext"))
    k = e.where("ext NOT IN ('', 'html', 'htm')").groupBy("ext").agg(F.count("*").alias("files")).where("files >= 3")
    return k.orderBy(F.desc("files"), "ext").limit(12)


@query(
    "band_words",
    f"""WITH {UNIT}, s AS (SELECT q_id, count(*) AS n, round(max(cos) - median(cos), 6) AS margin FROM c GROUP BY q_id)
        SELECT q_id, CASE WHEN n < {FEWEST} THEN '' WHEN margin < {NO_MATCH} THEN 'no clear match' WHEN margin < {BORDERLINE} THEN 'borderline' ELSE '' END AS word FROM s""",
)
def band_words(spark, sf_dir):
    """What each listing's margin says."""
    n = table(spark, sf_dir, "embeddings").count() - 1
    return QUERIES["listing_margin"](spark, sf_dir).select("q_id", band_word(F.col("margin"), F.lit(n), NO_MATCH, BORDERLINE, FEWEST).alias("word"))
