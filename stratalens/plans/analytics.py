"""Aggregations over the corpus: statistics, vocabulary, duplicates and similarity."""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.operators.corpus import files, lines, norm_line, token_places, token_tallies, tokens, whole_paths
from stratalens.plans.registry import query
from stratalens.plans.search import FILES, LINES, NORM
from stratalens.session import table

TOKENS = r"""tokens AS (SELECT path, folder, ext, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS token FROM files)"""
STOP = ["the", "and", "for", "that", "with", "this", "from", "are", "was", "not"]  # fixed values
STOPS = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@query(
    "index_stats",
    f"""WITH {FILES}, {LINES}, d AS (SELECT sha1(content) AS h, count(*) AS n FROM files GROUP BY 1)
        SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM lines) AS lines, (SELECT count(DISTINCT {NORM}) FROM lines) AS distinct_lines,
               (SELECT count(*) FROM d WHERE n > 1) AS dupe_groups, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM d) AS dupes_removed""",
)
def index_stats(spark, sf_dir):
    """Files, lines, distinct normalised lines, groups of equal files and files beyond the first."""
    f = files(spark, sf_dir)
    a = f.agg(F.count("*").alias("files"))
    b = lines(f).agg(F.count("*").alias("lines"), F.count_distinct(norm_line(F.col("line"))).alias("distinct_lines"))
    d = f.groupBy(F.sha1("content").alias("h")).agg(F.count("*").alias("n"))
    c = d.agg(F.count_if(F.col("n") > 1).alias("dupe_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dupes_removed"))
    return a.join(b).join(c)  # one row each


@query(
    "ext_histogram",
    f"""WITH {FILES}, s AS (SELECT ext, len(string_split(content, chr(10))) AS n FROM files)
        SELECT coalesce(ext, '(total)') AS ext, count(*) AS files, sum(n)::BIGINT AS lines FROM s GROUP BY ROLLUP (ext)""",
)
def ext_histogram(spark, sf_dir):
    """Files and lines per extension, and in total."""
    s = files(spark, sf_dir).select("ext", F.size(F.split("content", "\n", -1)).alias("n"))
    return s.rollup("ext").agg(F.count("*").alias("files"), F.sum("n").alias("lines")).withColumn("ext", F.coalesce("ext", F.lit("(total)")))


@query(
    "folder_share",
    f"""WITH {FILES} SELECT folder, count(*) AS files, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM files GROUP BY folder""",
)
def folder_share(spark, sf_dir):
    """Each folder's share of the files; the total is a one-row aggregate, not a window over all rows."""
    per = files(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("files"))
    return per.join(per.agg(F.sum("files").alias("n"))).select("folder", "files", F.round(100.0 * F.col("files") / F.col("n"), 2).alias("pct"))


@query(
    "language_share",
    f"""WITH {FILES} SELECT ext, sum(length(content))::BIGINT AS chars, round(100.0 * sum(length(content)) / sum(sum(length(content))) OVER (), 2) AS pct FROM files GROUP BY ext""",
)
def language_share(spark, sf_dir):
    """Each language's share of the characters."""
    per = files(spark, sf_dir).groupBy("ext").agg(F.sum(F.length("content")).alias("chars"))
    return per.join(per.agg(F.sum("chars").alias("n"))).select("ext", "chars", F.round(100.0 * F.col("chars") / F.col("n"), 2).alias("pct"))


VOCABULARY = f"""WITH {FILES}, {TOKENS}, n AS (SELECT count(*) AS n, count(DISTINCT folder) AS corpora FROM files),
 pf AS (SELECT path, any_value(folder) AS folder, token, count(*) AS c FROM tokens WHERE length(token) BETWEEN 3 AND 200 AND lower(token) NOT IN {STOPS}
        AND NOT (length(token) >= 4 AND upper(token) = token) GROUP BY path, token),
 v AS (SELECT token, count(*) AS doc_freq, sum(c)::BIGINT AS total_count, max(c) AS most, count(DISTINCT folder) AS held FROM pf GROUP BY token),
 x AS (SELECT token, doc_freq, total_count, n, len(list_filter(string_split(regexp_replace(regexp_replace(token, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'), lambda p: p <> '')) AS parts,
       CASE WHEN held < 2 THEN 1.0::DOUBLE ELSE least(greatest(log2(corpora::DOUBLE / held) / log2(corpora::DOUBLE), 0.1), 1.0) END AS xw FROM v, n WHERE doc_freq BETWEEN 2 AND greatest(5, floor(0.6 * n))),
 s AS (SELECT token, doc_freq, total_count, round(doc_freq * log2(n / doc_freq) * length(token) ** 0.75 * least(1 + 0.3 * (greatest(parts, 1) - 1), 2.5) * xw, 2) AS score FROM x)"""


def _spoken(token):
    """Tokens that may be vocabulary: of some length, no stop word, not all capitals."""
    return F.length(token).between(3, 200) & ~F.lower(token).isin(STOP) & ~((F.length(token) >= 4) & (F.upper(token) == F.col(token)))


def _bounded(corpus, v):
    """Tokens in two files at least and not in too many, with the numbers of files and of corpora."""
    n = corpus.agg(F.count("*").alias("n"), F.count_distinct("folder").alias("corpora"))
    return v.join(F.broadcast(n)).where((F.col("doc_freq") >= 2) & (F.col("doc_freq") <= F.greatest(F.lit(5), F.floor(0.6 * F.col("n")))))


def _vocabulary(f, whole):
    """Frequencies and score of every identifier of the files f, which are combined within tasks over their whole paths."""
    by_folder = token_tallies(whole).where(_spoken("token")).groupBy("token", "folder").agg(F.sum("files").alias("d"), F.sum("uses").alias("c"))
    v = by_folder.groupBy("token").agg(F.sum("d").alias("doc_freq"), F.sum("c").alias("total_count"), F.count("folder").alias("held"))
    kept = _bounded(f, v)
    pieces = F.split(F.regexp_replace(F.regexp_replace("token", "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2"), "_")
    parts = F.greatest(F.size(F.filter(pieces, lambda p: p != "")), F.lit(1))
    compound = F.least(1 + 0.3 * (parts - 1), F.lit(2.5))
    weight = F.when(F.col("held") < 2, F.lit(1.0)).otherwise(F.least(F.greatest(F.log2(F.col("corpora") / F.col("held")) / F.log2("corpora"), F.lit(0.1)), F.lit(1.0)))
    score = F.col("doc_freq") * F.log2(F.col("n") / F.col("doc_freq")) * F.pow(F.length("token"), F.lit(0.75)) * compound * weight
    return kept.withColumn("score", F.round(score, 2))


@query("vocabulary", VOCABULARY + " SELECT token, doc_freq, total_count, score FROM s")
def vocabulary(spark, sf_dir):
    """Document and total frequency and score of every identifier within the bounds."""
    f = files(spark, sf_dir)
    return _vocabulary(f, whole_paths(f)).select("token", "doc_freq", "total_count", "score")


@query("vocabulary_top", VOCABULARY + " SELECT token, doc_freq, score FROM s ORDER BY score DESC, token LIMIT 50")
def vocabulary_top(spark, sf_dir):
    """The fifty best."""
    f = files(spark, sf_dir)
    return _vocabulary(f, whole_paths(f)).select("token", "doc_freq", "score").orderBy(F.desc("score"), "token").limit(50)


@query(
    "vocabulary_density",
    VOCABULARY
    + """, d AS (SELECT path, round(sum(score * c / total_count), 4) AS density, count(*) AS terms FROM pf JOIN s USING (token) GROUP BY path) SELECT * FROM d""",
)
def vocabulary_density(spark, sf_dir):
    """Each file's sum of scores by the share of the token's uses that it has. Scores meet a token once a block of files."""
    f = files(spark, sf_dir)
    whole = whole_paths(f)
    j = token_places(whole).where(_spoken("token")).join(_vocabulary(f, whole).select("token", "score", "total_count"), "token")
    each = j.select("score", "total_count", F.inline("places")).select("path", F.col("score") * -F.col("less") / F.col("total_count"))
    return each.toDF("path", "share").groupBy("path").agg(F.round(F.sum("share"), 4).alias("density"), F.count("*").alias("terms"))


@query(
    "vocabulary_places",
    VOCABULARY
    + """, r AS (SELECT token, path, c, row_number() OVER (PARTITION BY token ORDER BY c DESC, path) AS rank FROM pf SEMI JOIN s USING (token))
         SELECT token, path, c AS uses, rank FROM r WHERE rank <= 3""",
)
def vocabulary_places(spark, sf_dir):
    """The three files that use each token most, of the three best of each block of files."""
    f = files(spark, sf_dir)
    each = token_places(whole_paths(f), best=3).where(_spoken("token")).groupBy("token").agg(F.sum("files").alias("doc_freq"), F.flatten(F.collect_list("places")).alias("places"))
    first = _bounded(f, each).select("token", F.posexplode(F.slice(F.array_sort("places"), 1, 3)).alias("at", "place"))
    return first.select("token", "place.path", (-F.col("place.less")).alias("uses"), (F.col("at") + 1).alias("rank"))


@query(
    "cross_corpus_weight",
    f"""WITH {FILES}, {TOKENS}, n AS (SELECT count(DISTINCT folder) AS n FROM files), d AS (SELECT token, count(DISTINCT folder) AS df FROM tokens GROUP BY token)
        SELECT token, df, round(CASE WHEN df < 2 THEN 1.0 ELSE least(greatest(log2(n / df) / log2(n), 0.1), 1.0) END, 6) AS weight FROM d, n WHERE df >= 2""",
)
def cross_corpus_weight(spark, sf_dir):
    """How many corpora (folders) hold a token, and the weight that follows."""
    f = files(spark, sf_dir)
    # each token of a document once, before anything is shuffled
    own = f.select("folder", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("token"))
    d = own.select("token", "folder").distinct().groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    n = f.agg(F.count_distinct("folder").alias("n"))
    w = F.least(F.greatest(F.log2(F.col("n") / F.col("df")) / F.log2("n"), F.lit(0.1)), F.lit(1.0))
    return d.join(F.broadcast(n)).select("token", "df", F.round(w, 6).alias("weight"))


@query(
    "concepts",
    f"""WITH p AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS sub FROM part), n AS (SELECT count(*) AS n FROM part),
        d AS (SELECT sub, count(DISTINCT p_partkey) AS df, min(p_partkey) AS example FROM p WHERE length(sub) >= 3 GROUP BY sub)
        SELECT sub AS concept, df, round(df * log2(n / df), 4) AS score, example FROM d, n WHERE df < 0.6 * n""",
)
def concepts(spark, sf_dir):
    """Sub-tokens of names, their frequency, score and first example."""
    part = table(spark, sf_dir, "part")
    p = part.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("concept")).where(F.length("concept") >= 3)
    d = p.groupBy("concept").agg(F.count("*").alias("df"), F.min("p_partkey").alias("example"))
    n = part.agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n)).where(F.col("df") < 0.6 * F.col("n")).select("concept", "df", F.round(F.col("df") * F.log2(F.col("n") / F.col("df")), 4).alias("score"), "example")


@query(
    "idf_formulas",
    f"""WITH {FILES}, {TOKENS}, n AS (SELECT count(*) AS n FROM files), t AS (SELECT token, count(DISTINCT path) AS df, count(*) AS tf FROM tokens GROUP BY token)
        SELECT token, df, tf, round(ln(n / df), 6) AS idf_search, round(log2(n / df), 6) AS idf_vocabulary, round(ln((n + 1.0) / (df + 1)), 6) AS idf_terms,
               round((1 + ln(tf)) * ln(greatest(n, 2) / df), 6) AS idf_text FROM t, n""",
)
def idf_formulas(spark, sf_dir):
    """The four inverse document frequencies, side by side."""
    f = files(spark, sf_dir)
    per = token_tallies(whole_paths(f)).groupBy("token").agg(F.sum("files").alias("df"), F.sum("uses").alias("tf"))
    n = F.col("n")
    return per.join(F.broadcast(f.agg(F.count("*").alias("n")))).select(
        "token", "df", "tf",
        F.round(F.log(n / F.col("df")), 6).alias("idf_search"),
        F.round(F.log2(n / F.col("df")), 6).alias("idf_vocabulary"),
        F.round(F.log((n + 1.0) / (F.col("df") + 1)), 6).alias("idf_terms"),
        F.round((1 + F.log("tf")) * F.log(F.greatest(n, F.lit(2)) / F.col("df")), 6).alias("idf_text"),
    )


@query(
    "distinctive_terms",
    """WITH w AS (SELECT p_type, unnest(string_split(lower(p_name), ' ')) AS term FROM part), tf AS (SELECT p_type, term, count(*) AS tf FROM w GROUP BY 1, 2),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(DISTINCT p_type) AS n FROM part),
       s AS (SELECT p_type, term, tf, round(tf * ln((n + 1.0) / (df + 1)), 6) AS score FROM tf JOIN df USING (term), n)
       SELECT p_type, term, tf, score FROM s QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY score DESC, term) <= 8""",
)
def distinctive_terms(spark, sf_dir):
    """The eight terms that set each group apart."""
    part = table(spark, sf_dir, "part")
    tf = part.select("p_type", F.explode(F.split(F.lower("p_name"), " ")).alias("term")).groupBy("p_type", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = part.agg(F.count_distinct("p_type").alias("n"))
    s = tf.join(df, "term").join(F.broadcast(n)).withColumn("score", F.round(F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1)), 6))
    w = Window.partitionBy("p_type").orderBy(F.desc("score"), "term")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 8").select("p_type", "term", "tf", "score")


# -- duplicates -------------------------------------------------------------------------------


@query(
    "file_dupes",
    f"""WITH {FILES} SELECT sha1(content) AS digest, count(*) AS copies, min(path) AS first_path, max(path) AS last_path FROM files GROUP BY 1 HAVING count(*) > 1""",
)
def file_dupes(spark, sf_dir):
    """Groups of equal files. Digests are grouped, not contents."""
    g = files(spark, sf_dir).groupBy(F.sha1("content").alias("digest"))
    return g.agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("path").alias("last_path")).where("copies > 1")


@query(
    "dupe_lookup",
    f"""WITH {FILES}, h AS (SELECT path, doc_id, sha1(content) AS digest FROM files), g AS (SELECT digest, min(doc_id) AS first, count(*) AS n FROM h GROUP BY digest)
        SELECT path, first AS canonical, n AS copies FROM h JOIN g USING (digest) WHERE n > 1""",
)
def dupe_lookup(spark, sf_dir):
    """For each file that has copies, the canonical one."""
    h = files(spark, sf_dir).select("path", "doc_id", F.sha1("content").alias("digest"))
    g = h.groupBy("digest").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1")
    return h.join(g, "digest").select("path", "canonical", "copies")


@query(
    "exact_dupe_waste",
    f"""WITH {FILES}, g AS (SELECT sha1(content) AS digest, count(*) AS n, any_value(len(string_split(content, chr(10)))) AS size FROM files GROUP BY 1)
        SELECT digest, n, size, (n - 1) * size AS waste FROM g WHERE n > 1 AND size >= 3""",
)
def exact_dupe_waste(spark, sf_dir):
    """Lines that copies repeat."""
    s = files(spark, sf_dir).select(F.sha1("content").alias("digest"), F.size(F.split("content", "\n", -1)).alias("size"))
    g = s.groupBy("digest").agg(F.count("*").alias("n"), F.first("size").alias("size")).where("n > 1 AND size >= 3")
    return g.withColumn("waste", (F.col("n") - 1) * F.col("size"))


NORMALISED = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '"[^"]*"', '"S"', 'g'), '[0-9]+', '0', 'g'), '\s+', ' ', 'g'))"""


@query(
    "struct_dupe_groups",
    f"""WITH {FILES}, {LINES}, h AS (SELECT sha1({NORMALISED}) AS struct, sha1(line) AS body, length({NORMALISED}) AS size FROM lines WHERE length(line) >= 10),
        g AS (SELECT struct, count(*) AS n, count(DISTINCT body) AS bodies, min(size) AS size FROM h GROUP BY struct)
        SELECT struct, n, bodies, floor((n - 1) * size * log2(greatest(size, 2)))::BIGINT AS waste FROM g WHERE bodies > 1""",
)
def struct_dupe_groups(spark, sf_dir):
    """Groups of lines equal but for case, numbers, quoted text and spacing."""
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower("line"), '"[^"]*"', '"S"'), "[0-9]+", "0"), r"\s+", " "))
    h = lines(files(spark, sf_dir)).where(F.length("line") >= 10).select(F.sha1(norm).alias("struct"), F.sha1("line").alias("body"), F.length(norm).alias("size"))
    # per body first: a hot body is one row by then
    b = h.groupBy("struct", "body").agg(F.count("*").alias("n"), F.min("size").alias("size"))
    g = b.groupBy("struct").agg(F.sum("n").alias("n"), F.count("*").alias("bodies"), F.min("size").alias("size")).where("bodies > 1")
    return g.select("struct", "n", "bodies", F.floor((F.col("n") - 1) * F.col("size") * F.log2(F.greatest("size", F.lit(2)))).alias("waste"))


@query(
    "near_dupe_groups",
    f"""WITH {FILES}, h AS (SELECT split_part(lower(content), ' ', 1) AS name, len(string_split(content, chr(10))) AS size, sha1(content) AS body FROM files)
        SELECT name, size, count(*) AS n, count(DISTINCT body) AS bodies, count(*) * size AS weight FROM h GROUP BY name, size HAVING count(DISTINCT body) > 1 AND size >= 3""",
)
def near_dupe_groups(spark, sf_dir):
    """Same name and size, different bodies."""
    h = files(spark, sf_dir).select(F.split_part(F.lower("content"), F.lit(" "), F.lit(1)).alias("name"), F.size(F.split("content", "\n", -1)).alias("size"), F.sha1("content").alias("body"))
    b = h.where("size >= 3").groupBy("name", "size", "body").agg(F.count("*").alias("n"))
    g = b.groupBy("name", "size").agg(F.sum("n").alias("n"), F.count("*").alias("bodies")).where("bodies > 1")
    return g.withColumn("weight", F.col("n") * F.col("size"))


#: Sets of one token that meet as many others in a task.
TOKEN_BLOCK = 256


@query(
    "token_fingerprint_pairs",
    """WITH t AS (SELECT DISTINCT l_orderkey AS a, l_partkey AS tok FROM lineitem), s AS (SELECT a, count(*) AS n FROM t GROUP BY a),
       df AS (SELECT tok FROM t GROUP BY tok),
       p AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM t x JOIN df USING (tok) JOIN t y ON x.tok = y.tok AND x.a < y.a GROUP BY 1, 2),
       j AS (SELECT p.a, b, shared, round(shared / (s1.n + s2.n - shared), 6) AS score FROM p JOIN s s1 ON s1.a = p.a JOIN s s2 ON s2.a = p.b WHERE shared >= 1)
       SELECT a, b, shared, score FROM j WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 3""",
)
def token_fingerprint_pairs(spark, sf_dir):
    """Pairs of sets at a Jaccard similarity of 0.2 or more, the best three of each. Candidates meet on a prefix of
    their tokens, the rare ones first: of n tokens, two such sets share one of the first n - ceil(0.2 n) + 1. Tokens in
    more than TOKEN_BLOCK sets are dealt into blocks, and each two blocks meet in a task. Two sets are compared only where
    64 bits of each leave room for enough shared tokens, and at the first token they share. Whole sets decide."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("tok")).where("a IS NOT NULL")
    # rows of a token are brought together once, for the distinct ones and for their number
    known = rows.where("tok IS NOT NULL").repartition("tok").distinct().withColumn("df", F.count("*").over(Window.partitionBy("tok")))
    # a null token counts in the size and matches nothing
    each = known.select("a", "df", "tok").union(rows.where("tok IS NULL").distinct().select("a", F.lit(None).cast("long"), "tok"))
    seen = F.when(F.col("tok").isNotNull(), F.struct("df", "tok"))
    bit = F.when(F.col("tok").isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("tok"), F.lit(64)).cast("int")))
    sets = each.groupBy("a").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(seen)).alias("s"), F.bit_or(bit).alias("bits"))
    # scores are rounded to six digits before they meet the threshold
    first = (F.col("n") - F.ceil(F.col("n") * 0.1999995) + 1).cast("int")
    rows = sets.select("a", "n", "bits", F.col("s.tok").alias("toks"), F.inline(F.slice("s", F.lit(1), first)))
    blocks = F.ceil(F.col("df") / TOKEN_BLOCK).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("a"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "a", "n", "bits", "toks")
    x, y = dealt.alias("x"), dealt.alias("y")
    met = (F.col("x.tok") == F.col("y.tok")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    # two of one block meet only where both blocks are theirs
    once = (F.col("x.own") != F.col("y.own")) | (F.col("x.i") == F.col("x.j"))
    # a token whose bit the other set lacks is not shared
    apart = lambda one, other: F.col(f"{one}.n") - F.bit_count(F.col(f"{one}.bits").bitwiseAND(F.bitwise_not(F.col(f"{other}.bits"))))
    most = F.least(apart("x", "y"), apart("y", "x"))
    room = most >= 0.199999 * (F.col("x.n") + F.col("y.n") - most)
    common = F.array_intersect("x.toks", "y.toks")
    # where there is room for one only, it is the one they met at
    shared = F.when(most <= 1, 1).otherwise(F.size(common))
    score = F.round(shared / (F.col("x.n") + F.col("y.n") - shared), 6)
    p = x.join(y, met & (F.col("x.a") < F.col("y.a")) & once & room & ((most <= 1) | (F.get(common, F.lit(0)) == F.col("x.tok"))) & (score >= 0.2))
    j = p.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), shared.cast("long").alias("shared"), score.alias("score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return j.withColumn("r", F.row_number().over(w)).where("r <= 3").select("a", "b", "shared", "score")


#: Kinds of members of a group that meet as many others in a task.
MEMBER_BLOCK = 2048


def _surprise(cell: pa.Table) -> pa.Table:
    """Peak, sum in millionths and number of scores, and number of pairs, of two blocks of a group's kinds of members or of
    one with itself. A kind stands for `n` members; one with an id, for members of that id, which are no pairs of their own."""
    own, n = cell.column("own").to_numpy(), cell.column("n").to_numpy()
    first, second = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
    toks = cell.column("toks").to_pylist()
    named = np.array([t is not None for t in toks])
    code: dict = {}
    shown = [[code.setdefault(w, len(code)) for w in t or ()] for t in toks]
    has = np.zeros((len(toks), max(1, len(code))), np.float32)
    for k, t in enumerate(shown):
        has[k, t] = 1
    count = has.sum(axis=1)
    left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
    # codes of the values; a null differs from all
    same = {}
    for c in ("dir", "size", "id"):
        v = cell.column(c).combine_chunks().dictionary_encode()
        same[c] = (v.indices.fill_null(-1).to_numpy(), v.indices.is_valid().to_numpy(zero_copy_only=False))
    alike = lambda c, a: (same[c][0][a][:, None] == same[c][0][right]) & same[c][1][a][:, None] & same[c][1][right]
    peak, total, scores, pairs = None, 0, 0, 0
    times = n[right].astype(np.float64)
    for k in range(0, len(left), 256):
        a = left[k : k + 256]
        # of one block, each two kinds once; members of one kind meet each other n (n - 1) / 2 times
        ok = (a[:, None] < right if first == second else np.ones((len(a), len(right)), bool)) & ~alike("id", a)
        both = (has[a] @ has[right].T).astype(np.float64)
        with np.errstate(all="ignore"):
            v = np.round(0.5 * (1 - both / (count[a][:, None] + count[right] - both)), 6)
        for c, weight in (("dir", 0.35), ("size", 0.15)):
            v = v + np.where(alike(c, a), 0.0, weight)
        known = ok & named[a][:, None] & named[right]
        of = [int(m) for m in n[a]]
        whole = np.where(known, np.rint(np.nan_to_num(v) * 1e6), 0.0)
        pairs += sum(m * int(x) for m, x in zip(of, ok @ times))
        scores += sum(m * int(x) for m, x in zip(of, known @ times))
        total += sum(m * int(x) for m, x in zip(of, whole @ times))
        if known.any():
            peak = max(float(v[known].max()), peak or 0.0)
    if first == second:
        for k in left[(n[left] > 1) & ~same["id"][1][left]]:
            m = int(n[k]) * (int(n[k]) - 1) // 2
            pairs += m
            if named[k]:
                v = (0.0 if same["dir"][1][k] else 0.35) + (0.0 if same["size"][1][k] else 0.15)
                scores, total, peak = scores + m, total + m * round(v * 1e6), max(v, peak or 0.0)
    return pa.table({"grp": cell.column("grp")[:1], "peak": pa.array([peak], pa.float64()), "total": pa.array([decimal.Decimal(total)], pa.decimal128(38, 0)), "n": pa.array([scores], pa.int64()), "pairs": pa.array([pairs], pa.int64())})


@query(
    "surprise_pairs",
    """WITH p AS (SELECT p_partkey AS id, p_type AS grp, p_brand AS dir, p_size, list_distinct(string_split(lower(p_name), ' ')) AS toks FROM part WHERE p_retailprice > 0),
       s AS (SELECT * FROM p),
       j AS (SELECT x.grp, x.id AS a, y.id AS b, round(0.5 * (1 - len(list_intersect(x.toks, y.toks)) / (len(x.toks) + len(y.toks) - len(list_intersect(x.toks, y.toks)))), 6) AS name_part,
             CASE WHEN x.dir = y.dir THEN 0.0 ELSE 0.35 END AS path_part, CASE WHEN x.p_size = y.p_size THEN 0.0 ELSE 0.15 END AS ext_part
             FROM s x JOIN s y ON x.grp = y.grp AND x.id < y.id)
       SELECT grp, round(max(name_part + path_part + ext_part), 6) AS peak, round(avg(name_part + path_part + ext_part), 6) AS mean, count(*) AS pairs FROM j GROUP BY grp
       HAVING max(name_part + path_part + ext_part) >= 0.5""",
)
def surprise_pairs(spark, sf_dir):
    """Groups whose members differ in name, place and kind, over all pairs of a group. The reference looks at 50 pairs of a
    group; here members that agree in all three are counted as one kind, kinds are dealt into blocks, and each two blocks
    are compared in a task that returns one row. A member whose id repeats in its group keeps it: equal ids are no pair."""
    part = table(spark, sf_dir, "part").where("p_retailprice > 0 AND p_type IS NOT NULL AND p_partkey IS NOT NULL")
    toks = F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " ")))
    s = part.select(F.col("p_type").alias("grp"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("dir"), F.col("p_size").alias("size"), toks.alias("toks"))
    each = s.groupBy("grp", "id", "dir", "size", "toks").agg(F.count("*").alias("n"))
    each = each.groupBy("grp", "id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("dir", "size", "toks", "n")).alias("m"))
    each = each.select("grp", F.when(F.col("all") > 1, F.col("id")).alias("id"), F.inline("m"))
    kinds = each.groupBy("grp", "id", "dir", "size", "toks").agg(F.sum("n").alias("n"))
    blocks = kinds.groupBy("grp").agg(F.ceil(F.count("*") / MEMBER_BLOCK).cast("int").alias("blocks"))
    dealt = kinds.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("id", "dir", "size", "toks"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", "id", "dir", "size", "toks", "n", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    cells = dealt.groupBy("grp", "i", "j").applyInArrow(_surprise, "grp string, peak double, total decimal(38,0), n long, pairs long").where("pairs > 0")
    mean = F.round(F.try_divide(F.sum("total").cast("double"), F.sum("n")) / 1e6, 6)
    return cells.groupBy("grp").agg(F.round(F.max("peak"), 6).alias("peak"), mean.alias("mean"), F.sum("pairs").alias("pairs")).where("peak >= 0.5")


# -- notices, names and resources ----------------------------------------------------------------


@query(
    "license_lines",
    f"""WITH {FILES}, {LINES} SELECT path, line_no, CASE WHEN contains(lower(line), 'apache') THEN 'apache' WHEN contains(lower(line), 'mit license') THEN 'mit'
        WHEN contains(lower(line), 'gnu') THEN 'gpl' ELSE 'other' END AS license FROM lines WHERE regexp_matches(lower(line), 'licen[sc]e|copyright')""",
)
def license_lines(spark, sf_dir):
    """Notice lines and the licence they name."""
    low = F.lower("line")
    kind = F.when(F.contains(low, F.lit("apache")), "apache").when(F.contains(low, F.lit("mit license")), "mit").when(F.contains(low, F.lit("gnu")), "gpl").otherwise("other")
    return lines(files(spark, sf_dir)).where(low.rlike("licen[sc]e|copyright")).select("path", "line_no", kind.alias("license"))


@query(
    "holder_plurality",
    """WITH h AS (SELECT o_orderpriority AS holder, o_orderstatus AS scope, count(*) AS n FROM orders GROUP BY 1, 2)
       SELECT scope, holder, n, n = max(n) OVER (PARTITION BY scope) AS plurality, round(n / sum(n) OVER (PARTITION BY scope), 6) AS share FROM h""",
)
def holder_plurality(spark, sf_dir):
    """Each holder's share within a scope, and whether it leads; windows run over the combined counts."""
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("holder"), F.col("o_orderstatus").alias("scope")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("scope")
    return h.select("scope", "holder", "n", (F.col("n") == F.max("n").over(w)).alias("plurality"), F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


@query(
    "resources",
    r"""WITH v AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS value FROM pages)
        SELECT value, count(*) AS n, count(DISTINCT page_id) AS pages, min(page_id) AS first_page FROM v GROUP BY value""",
)
def resources(spark, sf_dir):
    """Referenced values with counts and first place."""
    v = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("value"))
    per = v.groupBy("value", "page_id").agg(F.count("*").alias("n"))
    return per.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(
    "html_imports",
    r"""SELECT page_id, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<link')) AS links, len(regexp_extract_all(html, '<style')) AS styles FROM pages""",
)
def html_imports(spark, sf_dir):
    """Import-like tags of a page."""
    return table(spark, sf_dir, "pages").select("page_id", *[F.regexp_count("html", F.lit(p)).alias(n) for n, p in (("scripts", "<script"), ("links", "<link"), ("styles", "<style"))])


@query(
    "url_hosts",
    r"""SELECT regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, count(*) AS n, count(DISTINCT split_part(split_part(url, '?', 1), '#', 1)) AS paths FROM pages GROUP BY 1""",
)
def url_hosts(spark, sf_dir):
    """Pages and distinct addresses per host."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"), F.substring_index(F.substring_index("url", "?", 1), "#", 1).alias("path"))
    per = p.groupBy("host", "path").agg(F.count("*").alias("n"))
    return per.groupBy("host").agg(F.sum("n").alias("n"), F.count("*").alias("paths"))


@query(
    "route_match",
    r"""WITH s(role, pattern) AS (VALUES ('english', 'en/*'), ('french', 'fr/*'), ('german', 'de/*'), ('spanish', 'es/*'), ('admin', 'admin/*')),
        c AS (SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]+/', ''), '?', 1), '#', 1), '/[0-9]+', '/*') AS pattern FROM pages)
        SELECT s.role, s.pattern, count(page_id) AS calls, count(page_id) > 0 AS matched FROM s LEFT JOIN c USING (pattern) GROUP BY 1, 2""",
)
def route_match(spark, sf_dir):
    """Server routes and the client addresses that meet them; variable segments become `*` on both sides, so it is an equi-join."""
    routes = spark.createDataFrame([("english", "en/*"), ("french", "fr/*"), ("german", "de/*"), ("spanish", "es/*"), ("admin", "admin/*")], "role string, pattern string")
    path = F.substring_index(F.substring_index(F.regexp_replace("url", "^[a-z]+://[^/]+/", ""), "?", 1), "#", 1)
    calls = table(spark, sf_dir, "pages").select(F.regexp_replace(path, "/[0-9]+", "/*").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    return routes.join(calls, "pattern", "left").select("role", "pattern", F.coalesce("n", F.lit(0)).alias("calls"), F.col("n").isNotNull().alias("matched"))


@query(
    "longest_prefix",
    r"""WITH k(prefix, name) AS (VALUES ('http://', 'plain'), ('https://', 'secure'), ('https://m.', 'mobile')),
        m AS (SELECT page_id, prefix, name FROM pages JOIN k ON starts_with(url, prefix))
        SELECT page_id, name FROM m QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(prefix) DESC) = 1""",
)
def longest_prefix(spark, sf_dir):
    """The most specific catalogue entry of each address: one lookup a prefix length, longest first, no join of rows."""
    known = {"http://": "plain", "https://": "secure", "https://m.": "mobile"}
    entries = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    sizes = sorted({len(k) for k in known}, reverse=True)
    name = F.coalesce(*[F.try_element_at(entries, F.substring("url", 1, n)) for n in sizes])
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).where("name IS NOT NULL")


@query(
    "census",
    f"""WITH {FILES}, {TOKENS}, p AS (SELECT token, folder, count(*) AS n FROM tokens GROUP BY 1, 2)
        SELECT token, sum(n)::BIGINT AS uses, count(*) AS corpora, min(folder) AS first_corpus FROM p GROUP BY token HAVING count(*) >= 3""",
)
def census(spark, sf_dir):
    """How many corpora use a target, and how often."""
    p = tokens(files(spark, sf_dir)).groupBy("token", "folder").agg(F.count("*").alias("n"))
    return p.groupBy("token").agg(F.sum("n").alias("uses"), F.count("*").alias("corpora"), F.min("folder").alias("first_corpus")).where("corpora >= 3")


@query(
    "census_rollup",
    """WITH t AS (SELECT split_part(p_type, ' ', 1) AS root, p_type, count(*) AS n FROM part GROUP BY 1, 2)
       SELECT root, count(*) AS members, sum(n)::BIGINT AS uses FROM t GROUP BY root""",
)
def census_rollup(spark, sf_dir):
    """Dotted or spaced targets summed by their root."""
    t = table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("root"), "p_type").agg(F.count("*").alias("n"))
    return t.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("uses"))


@query(
    "corpus_difference",
    """WITH a AS (SELECT sha1(text) AS h, min(doc_id) AS doc FROM documents WHERE source IN ('src0', 'src1', 'src2') GROUP BY 1), b AS (SELECT sha1(text) AS h, min(doc_id) AS doc FROM documents WHERE source IN ('src3', 'src4', 'src5') GROUP BY 1)
       SELECT coalesce(a.h, b.h) AS digest, a.doc AS left_doc, b.doc AS right_doc, CASE WHEN b.h IS NULL THEN 'removed' WHEN a.h IS NULL THEN 'added' ELSE 'same' END AS state FROM a FULL JOIN b ON a.h = b.h""",
)
def corpus_difference(spark, sf_dir):
    """What two corpora have apart and in common: one pass with flags, instead of a join of the two."""
    d = table(spark, sf_dir, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3", "src4", "src5"))
    left = F.col("source").isin("src0", "src1", "src2")
    g = d.groupBy(F.sha1("text").alias("digest")).agg(F.min(F.when(left, F.col("doc_id"))).alias("left_doc"), F.min(F.when(~left, F.col("doc_id"))).alias("right_doc"))
    return g.withColumn("state", F.when(F.col("right_doc").isNull(), "removed").when(F.col("left_doc").isNull(), "added").otherwise("same"))


@query(
    "hash_corpus_classes",
    f"""WITH {FILES}, {LINES}, h AS (SELECT sha1({NORM}) AS h, folder FROM lines WHERE length({NORM}) >= 8), d AS (SELECT h, count(DISTINCT folder) AS df FROM h GROUP BY h),
        o AS (SELECT DISTINCT h FROM h WHERE folder = 'src1') SELECT CASE WHEN df - 1 = 0 THEN 'novel' WHEN df - 1 >= 5 THEN 'common' WHEN df - 1 <= 2 THEN 'rare' ELSE 'mid' END AS class, count(*) AS n
        FROM o JOIN d USING (h) GROUP BY 1""",
)
def hash_corpus_classes(spark, sf_dir):
    """Lines of one corpus by how many others hold them."""
    norm = norm_line(F.col("line"))
    per = lines(files(spark, sf_dir)).where(F.length(norm) >= 8).select(F.sha1(norm).alias("h"), "folder").distinct()
    d = per.groupBy("h").agg((F.count("*") - 1).alias("others"), F.bool_or(F.col("folder") == "src1").alias("own")).where("own")
    kind = F.when(F.col("others") == 0, "novel").when(F.col("others") >= 5, "common").when(F.col("others") <= 2, "rare").otherwise("mid")
    return d.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query(
    "entropy_tokens",
    """WITH w AS (SELECT DISTINCT p_name AS token FROM part), c AS (SELECT token, unnest(string_split(token, '')) AS ch FROM w), n AS (SELECT token, ch, count(*) AS n FROM c GROUP BY 1, 2)
       SELECT token, round(-sum(n / length(token) * log2(n / length(token))), 6) AS entropy FROM n GROUP BY token""",
)
def entropy_tokens(spark, sf_dir):
    """Shannon entropy a character; computed in the row, without exploding characters."""
    t = table(spark, sf_dir, "part").select(F.col("p_name").alias("token")).distinct()
    share = F.transform(F.array_distinct(F.split("token", "")), lambda c: (F.length("token") - F.length(F.replace("token", c))) / F.length("token"))
    return t.select("token", F.round(-F.aggregate(share, F.lit(0.0), lambda s, p: s + p * F.log2(p)), 6).alias("entropy"))
