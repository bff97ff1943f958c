"""Search queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.operators.corpus import contains, context, files, lines, norm_line, postings
from stratalens.operators.multisect import Term, multisect
from stratalens.plans.registry import query
from stratalens.session import table

FILES = """files AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, source AS folder, lang AS ext, text AS content, doc_id
                     FROM documents WHERE text IS NOT NULL)"""
LINES = """lines AS (SELECT path, folder, ext, doc_id, unnest(string_split(content, chr(10))) AS line,
                            generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM files)"""
NORM = r"trim(regexp_replace(line, '\s+', ' ', 'g'))"


@query(
    "literal_search",
    f"""WITH {FILES}, {LINES} SELECT path, line_no, line FROM lines WHERE contains(lower(line), 'license')
        ORDER BY path, line_no LIMIT 200""",
)
def literal_search(spark, sf_dir):
    """The first 200 lines, by path and line, that hold a literal."""
    hits = lines(files(spark, sf_dir)).where(contains(F.col("line"), "license"))
    return hits.select("path", "line_no", "line").orderBy("path", "line_no").limit(200)


@query(
    "literal_search_context",
    f"""WITH {FILES}, {LINES}, w AS (SELECT path, line_no, line,
            array_to_string(list(line) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), chr(10)) AS context
            FROM lines) SELECT path, line_no, context FROM w WHERE contains(lower(line), 'license')""",
)
def literal_search_context(spark, sf_dir):
    """Every hit with two lines around it. Files without a hit never reach the window."""
    some = files(spark, sf_dir).where(contains(F.col("content"), "license"))
    rows = context(lines(some), ["path"], "line_no", "line", 2)
    return rows.where(contains(F.col("line"), "license")).select("path", "line_no", "context")


@query(
    "regex_search",
    f"""WITH {FILES}, {LINES} SELECT path, line_no, regexp_extract(line, '[0-9][0-9 -]{{6,}}[0-9]', 0) AS hit
        FROM lines WHERE regexp_matches(line, '[0-9][0-9 -]{{6,}}[0-9]')""",
)
def regex_search(spark, sf_dir):
    """Lines that match a regular expression, with the first match."""
    pattern = "[0-9][0-9 -]{6,}[0-9]"
    hits = lines(files(spark, sf_dir)).where(F.col("line").rlike(pattern))
    return hits.select("path", "line_no", F.regexp_extract("line", pattern, 0).alias("hit"))


@query(
    "fast_search",
    f"""WITH {FILES}, {LINES}, p AS (SELECT {NORM} AS norm_line, path, count(*) AS n FROM lines GROUP BY 1, 2),
        g AS (SELECT norm_line, count(*) AS n_files, sum(n)::BIGINT AS n_lines, min(path) AS first_path FROM p
              WHERE length(norm_line) >= 4 GROUP BY 1 HAVING count(*) <= 50)
        SELECT * FROM g WHERE regexp_matches(lower(norm_line), 'licen[sc]e')""",
)
def fast_search(spark, sf_dir):
    """A predicate on postings: one test per distinct line."""
    return postings(files(spark, sf_dir)).where(F.lower("norm_line").rlike("licen[sc]e"))


@query(
    "line_postings",
    f"""WITH {FILES}, {LINES}, p AS (SELECT {NORM} AS norm_line, path, count(*) AS n FROM lines GROUP BY 1, 2)
        SELECT norm_line, count(*) AS n_files, sum(n)::BIGINT AS n_lines, min(path) AS first_path FROM p
        WHERE length(norm_line) >= 4 GROUP BY 1 HAVING count(*) <= 50""",
)
def line_postings(spark, sf_dir):
    """The inverted line index."""
    return postings(files(spark, sf_dir))


@query(
    "hybrid_search",
    f"""WITH {FILES}, {LINES} SELECT DISTINCT path, line_no FROM lines
        WHERE contains(lower(line), 'copyright') OR regexp_matches(lower(line), 'licen[sc]ed? under')""",
)
def hybrid_search(spark, sf_dir):
    """Literal and pattern hits, once per place; one scan, not a union of two."""
    line = F.lower("line")
    return lines(files(spark, sf_dir)).where(F.contains(line, F.lit("copyright")) | line.rlike("licen[sc]ed? under")).select("path", "line_no").distinct()


@query(
    "files_search",
    f"""WITH {FILES}, {LINES} SELECT path, count(*) AS hits FROM lines WHERE contains(lower(line), 'the') GROUP BY path""",
)
def files_search(spark, sf_dir):
    """Hits per file, most first."""
    hits = lines(files(spark, sf_dir)).where(contains(F.col("line"), "the"))
    return hits.groupBy("path").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "path")


@query(
    "folders_search",
    f"""WITH {FILES}, {LINES} SELECT folder, count(*) AS hits, count(DISTINCT path) AS files FROM lines
        WHERE contains(lower(line), 'the') GROUP BY folder""",
)
def folders_search(spark, sf_dir):
    """Hits and distinct files per folder; counted per file first, so that a hot folder is combined early."""
    hits = lines(files(spark, sf_dir)).where(contains(F.col("line"), "the"))
    per_file = hits.groupBy("folder", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("folder").agg(F.sum("n").alias("hits"), F.count("*").alias("files")).orderBy(F.desc("hits"), "folder")


@query(
    "path_search",
    f"""WITH {FILES}, p AS (SELECT path, folder || '/' || ext AS dir FROM files WHERE contains(lower(path), '/de/'))
        SELECT dir, count(*) AS files, min(path) AS first_path FROM p GROUP BY dir""",
)
def path_search(spark, sf_dir):
    """Directories whose files' paths hold a text. Only path columns are read."""
    hits = files(spark, sf_dir).where(contains(F.col("path"), "/de/")).withColumn("dir", F.concat_ws("/", "folder", "ext"))
    return hits.groupBy("dir").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


@query(
    "path_filter",
    f"""WITH {FILES} SELECT path FROM files WHERE (contains(lower(path), 'src1') OR contains(lower(path), 'src2')) AND NOT contains(lower(path), '/en/')""",
)
def path_filter(spark, sf_dir):
    """Any include, no exclude."""
    path = F.col("path")
    return files(spark, sf_dir).where((contains(path, "src1") | contains(path, "src2")) & ~contains(path, "/en/")).select("path")


@query(
    "term_selectivity",
    f"""WITH {FILES}, t AS (SELECT unnest(['the', 'license', 'token', 'que', 'zzzz']) AS term), n AS (SELECT count(*) AS n FROM files)
        SELECT term, count(path) AS n_files, count(path) > 0.5 * any_value(n.n) AS dropped
        FROM t CROSS JOIN n LEFT JOIN files ON contains(lower(content), term) OR contains(lower(path), term) GROUP BY term""",
)
def term_selectivity(spark, sf_dir):
    """Files that each term covers in content or path; terms covering over half are to be dropped. One pass, one row out."""
    terms = ["the", "license", "token", "que", "zzzz"]
    low = files(spark, sf_dir).select(F.lower("content").alias("c"), F.lower("path").alias("p"))
    counts = low.agg(F.count("*").alias("n"), *[F.count_if(F.contains("c", F.lit(t)) | F.contains("p", F.lit(t))).alias(t) for t in terms])
    stacked = counts.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(t).alias("n_files")) for t in terms])).alias("s"))
    return stacked.select("s.term", "s.n_files", (F.col("s.n_files") > 0.5 * F.col("n")).alias("dropped"))


TERMS = [Term("the"), Term("license"), Term("from"), Term("token", soft=True), Term("password", negated=True)]

MATCHES = f"""WITH {FILES}, {LINES},
 t(term, soft, negated) AS (VALUES ('the', false, false), ('license', false, false), ('from', false, false), ('token', true, false), ('password', false, true)),
 hits AS (SELECT folder, path, term, soft, negated,
                 max(CASE WHEN regexp_matches(trim(line), '^(//|/\\*|\\*|#)') THEN 0.25 ELSE 1.0 END) AS weight
          FROM lines JOIN t ON contains(lower(line), term) GROUP BY ALL),
 sizes AS (SELECT path, count(*) AS n_lines FROM lines GROUP BY path),
 df AS (SELECT term, count(DISTINCT path) AS df FROM hits GROUP BY term),
 gate AS (SELECT count(DISTINCT term) AS need FROM hits WHERE NOT soft AND NOT negated),
 total AS (SELECT count(*) AS n FROM files)"""


@query(
    "multisect_search",
    MATCHES
    + """ SELECT path, round(sum(CASE WHEN NOT negated THEN weight ELSE 0 END), 4) AS weighted_terms,
               count(CASE WHEN NOT negated THEN 1 END) AS terms, any_value(n_lines) AS n_lines,
               round(sum(CASE WHEN NOT negated THEN weight * ln(n / df) ELSE 0 END) / (1 + log10(greatest(1, any_value(n_lines) / 50.0))), 6) AS score
          FROM hits JOIN sizes USING (path) JOIN df USING (term) CROSS JOIN total CROSS JOIN gate GROUP BY path
          HAVING count(CASE WHEN NOT hits.negated AND NOT hits.soft THEN 1 END) >= any_value(need) AND count(CASE WHEN hits.negated AND NOT hits.soft THEN 1 END) = 0""",
)
def multisect_search(spark, sf_dir):
    """Files that hold all live hard terms and no excluded one, best first."""
    return multisect(files(spark, sf_dir), TERMS, "path")


@query(
    "multisect_folder",
    MATCHES
    + """, fh AS (SELECT folder AS scope, term, bool_or(soft) AS soft, bool_or(negated) AS negated, max(weight) AS weight FROM hits GROUP BY folder, term),
          fs AS (SELECT folder AS scope, count(*) AS n_lines FROM lines GROUP BY folder)
          SELECT scope AS folder, round(sum(CASE WHEN NOT fh.negated THEN weight ELSE 0 END), 4) AS weighted_terms,
               count(CASE WHEN NOT fh.negated THEN 1 END) AS terms, any_value(n_lines) AS n_lines,
               round(sum(CASE WHEN NOT fh.negated THEN weight * ln(n / df) ELSE 0 END) / (1 + log10(greatest(1, any_value(n_lines) / 50.0))), 6) AS score
          FROM fh JOIN fs USING (scope) JOIN df USING (term) CROSS JOIN total CROSS JOIN gate GROUP BY scope
          HAVING count(CASE WHEN NOT fh.negated AND NOT fh.soft THEN 1 END) >= any_value(need) AND count(CASE WHEN fh.negated AND NOT fh.soft THEN 1 END) = 0""",
)
def multisect_folder(spark, sf_dir):
    """The same at folder scope: a term may come from any file of the folder."""
    return multisect(files(spark, sf_dir), [t for t in TERMS], "folder")


@query(
    "term_parser",
    """SELECT * FROM (VALUES ('alpha', false, false, false), ('b.?c', false, false, true), ('beta', true, false, false), ('gamma', false, true, false), ('d;e', false, false, false), ('x+', false, false, true))
       AS t(term, soft, negated, pattern)""",
)
def term_parser(spark, sf_dir):
    """The terms of a query text."""
    from stratalens.operators.multisect import parse_terms

    found = parse_terms("alpha; b.c; beta?; !gamma; d;;e; /x+/")
    return spark.createDataFrame([(t.text, t.soft, t.negated, t.pattern) for t in found], "term string, soft boolean, negated boolean, pattern boolean")


@query(
    "long_line_window",
    f"""WITH {FILES}, {LINES}, h AS (SELECT path, line_no, line, strpos(lower(line), 'the') AS pos FROM lines WHERE contains(lower(line), 'the'))
        SELECT path, line_no, CASE WHEN length(line) > 300 THEN substring(line, greatest(pos - 100, 1), 203 - greatest(0, 101 - pos)) ELSE line END AS shown FROM h""",
)
def long_line_window(spark, sf_dir):
    """Lines of over 300 characters are shown as the match and 100 characters on either side."""
    at = F.instr(F.lower("line"), "the")
    hits = lines(files(spark, sf_dir)).where(contains(F.col("line"), "the")).withColumn("at", at)
    start = F.greatest(F.col("at") - 100, F.lit(1))
    shown = F.when(F.length("line") > 300, F.substring("line", start, 203 - F.greatest(F.lit(0), 101 - F.col("at")))).otherwise(F.col("line"))
    return hits.select("path", "line_no", shown.alias("shown"))


@query(
    "line_classes",
    f"""WITH {FILES}, {LINES} SELECT ext, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^(//|/\\*|\\*|#)') THEN 'comment' ELSE 'code' END AS class,
        count(*) AS n FROM lines GROUP BY 1, 2""",
)
def line_classes(spark, sf_dir):
    """Lines by extension and class."""
    t = F.trim("line")
    kind = F.when(t == "", "blank").when(t.rlike(r"^(//|/\*|\*|#)"), "comment").otherwise("code")
    return lines(files(spark, sf_dir)).groupBy("ext", kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "string_table",
    f"""WITH {FILES}, s AS (SELECT path, unnest(regexp_extract_all(content, '"([^"\\n]{{{{8,200}}}})"', 1)) AS value FROM files)
        SELECT value, count(*) AS n, count(DISTINCT path) AS files, list_slice(list_sort(list(DISTINCT path)), 1, 20) AS locations FROM s GROUP BY value""".replace("{{", "{").replace("}}", "}"),
)
def string_table(spark, sf_dir):
    """Distinct quoted texts with counts and their first 20 places (the operator's own cap)."""
    found = files(spark, sf_dir).select("path", F.explode(F.regexp_extract_all("content", F.lit('"([^"\\n]{8,200})"'), F.lit(1))).alias("value"))
    per = found.groupBy("value", "path").agg(F.count("*").alias("n"))
    first = Window.partitionBy("value").orderBy("path")
    ranked = per.withColumn("at", F.row_number().over(first))
    return ranked.groupBy("value").agg(
        F.sum("n").alias("n"), F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("at") <= 20, F.col("path")))).alias("locations")
    )


@query(
    "context_window",
    """WITH w AS (SELECT conv_id, turn, text, array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10)) AS context FROM conversations)
       SELECT conv_id, turn, context FROM w WHERE contains(lower(text), 'the')""",
)
def context_window(spark, sf_dir):
    """Turns that hold a text, with a turn on either side."""
    rows = context(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 1)
    return rows.where(contains(F.col("text"), "the")).select("conv_id", "turn", "context")


@query(
    "bookends",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
       WHERE a <= 2 OR b <= 1""",
)
def bookends(spark, sf_dir):
    """The first two turns and the last one of each conversation."""
    up, down = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(up).alias("a"), F.row_number().over(down).alias("b"))
    return rows.where("a <= 2 OR b <= 1").select("conv_id", "turn", "role")


@query(
    "show_range",
    f"""WITH {FILES}, {LINES} SELECT path, line_no, line FROM lines WHERE path = 'src4/fr/4' AND line_no BETWEEN 2 AND 6""",
)
def show_range(spark, sf_dir):
    """A range of one file's lines."""
    return lines(files(spark, sf_dir).where(F.col("path") == "src4/fr/4")).where("line_no BETWEEN 2 AND 6").select("path", "line_no", "line")


@query(
    "file_resolution",
    f"""WITH {FILES}, want(name) AS (VALUES ('fr/4'), ('src4/fr/4'), ('en/1'), ('nowhere')),
        m AS (SELECT name, path, CASE WHEN path = name THEN 1 ELSE 2 END AS tier FROM want JOIN files ON path = name OR ends_with(path, '/' || name)),
        b AS (SELECT name, min(tier) AS tier FROM m GROUP BY name)
        SELECT m.name, tier, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM m JOIN b USING (name, tier) GROUP BY m.name, tier""",
)
def file_resolution(spark, sf_dir):
    """Names resolved exactly, else by a unique suffix. Suffixes of every path are keys, so the join is an equi-join."""
    want = spark.createDataFrame([("fr/4",), ("src4/fr/4",), ("en/1",), ("nowhere",)], "name string")
    parts = F.split("path", "/")
    tails = files(spark, sf_dir).select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("name"))
    m = tails.join(F.broadcast(want), "name").withColumn("tier", F.when(F.col("path") == F.col("name"), 1).otherwise(2))
    per = m.groupBy("name", "tier").agg(F.count("*").alias("candidates"), F.min("path").alias("path"))
    best = Window.partitionBy("name").orderBy("tier")
    return per.withColumn("r", F.row_number().over(best)).where("r = 1").select("name", "tier", "candidates", F.when(F.col("candidates") == 1, F.col("path")).alias("path"))
