"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

# The base patterns in Java's dialect, and the least length of what must be long enough.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
LEAST = {"assign": 8, "access": 16, "hex": 32, "random": 20}
OPEN, CLOSE, OTHER = "", "", ""

# Alphabets in order, by inferred encoding.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}

#: Of words, names and paths, what a candidate is unless the tests say otherwise: the chance that two of its letters are
#: equal, that three are, that the class of characters (lower, upper, digit, sign) changes from one to the next, and the
#: serial correlation of neighbouring symbols.
COINCIDENCE, TRIPLE, CHANGE, SERIAL = 0.065, 0.0056, 0.12, 0.2
#: A token counts as random only if no test of uniformity is beyond this many standard deviations.
STEADY = 3.5
BINS, PER_DECADE = 400, 10


def _segments(text: Column, kind: str) -> Column:
    """Alternately what lies between matches and the matches: structs of length, and body for matches."""
    marked = F.split(F.regexp_replace(text, PATTERNS[kind], f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]")
    cut = F.transform(marked, lambda s, i: F.struct(F.length(s).cast("long").alias("n"), F.when(i % 2 == 1, s).alias("body")))
    return F.when(F.regexp_like(text, F.lit(PATTERNS[kind])), cut)


def _measures(token: Column) -> Column:
    """n, k (size of the inferred alphabet), p (of language-like text) and steady (all uniformity tests pass)."""
    body = F.rtrim(token, F.lit("="))
    n = F.length(body).cast("double")
    tests = [
        (body.rlike("^[0-9]+$"), ""),
        (body.rlike("^[0-9a-f]+$"), ALPHABETS["hex"]),
        (body.rlike("^[0-9A-F]+$"), ALPHABETS["HEX"]),
        (body.rlike("^[A-Z2-7]+$"), ALPHABETS["base32"]),
        (body.rlike("^[0-9a-z]+$"), ALPHABETS["base36"]),
        (body.rlike("^[0-9A-Za-z]+$"), ALPHABETS["base62"]),
        (body.rlike("^[0-9A-Za-z+/]+$"), ALPHABETS["base64"]),
        (body.rlike("^[0-9A-Za-z_-]+$"), ALPHABETS["base64url"]),
        (body.rlike("^[0-9A-Za-z+/_-]+$"), ALPHABETS["mixed"]),
    ]
    alphabet = F.lit("")
    for ok, letters in reversed(tests):
        alphabet = F.when(ok, letters).otherwise(alphabet)
    chars = F.split(body, "")
    squares = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: (F.length(body) - F.length(F.replace(body, c))).cast("double")),
        F.lit(0.0),
        lambda s, c: s + c * c,
    )
    change = F.regexp_count(body, F.lit("(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^0-9A-Za-z])(?=[0-9A-Za-z])")).cast("double")
    return F.struct(n.alias("n"), alphabet.alias("alphabet"), chars.alias("chars"), squares.alias("squares"), change.alias("change"))


def _candidates(runs: DataFrame) -> DataFrame:
    """The runs(uid, start, n_chars, body), and of those that hold signs of both base64 alphabets, also the parts between
    the signs of either that are long enough: the signs of the other may belong to a secret in it."""
    both = F.rtrim("body", F.lit("=")).rlike("[+/]") & F.col("body").rlike("[_-]")
    rows = runs.where(both).select("uid", "start", F.explode(F.array(F.lit("[+/]"), F.lit("[_-]"))).alias("foreign"), "body")
    rows = rows.select("uid", "start", "foreign", F.posexplode(F.split("body", F.col("foreign"))).alias("at", "part"))
    before = Window.partitionBy("uid", "start", "foreign").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.withColumn("start", F.col("start") + F.coalesce(F.sum(F.length("part") + 1).over(before), F.lit(0)))
    parts = parts.where(F.length(F.rtrim("part", F.lit("="))) >= LEAST["random"])
    parts = parts.groupBy("uid", "start", "part").agg(F.max(F.length("part").cast("long")).alias("n_chars"))
    return runs.select("uid", "start", "n_chars", "body").union(parts.select("uid", "start", "n_chars", "part")).withColumn("end", F.col("start") + F.col("n_chars"))


def _merged(random: DataFrame) -> DataFrame:
    """Spans that overlap become one, as those of a run and of its parts do."""
    before = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("uid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    new = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    return random.withColumn("new", new).withColumn("span", F.sum("new").over(upto)).groupBy("uid", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _battery(found: DataFrame) -> DataFrame:
    """found(…, body) with p and steady for each candidate."""
    m = found.withColumn("_m", _measures(F.col("body"))).select("*", "_m.*").drop("_m").withColumn("k", F.length("alphabet").cast("double"))
    m = m.where("k > 0").withColumn("x", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1))
    n, k = F.col("n"), F.col("k")
    # chi-squared uniformity over the alphabet, standardised
    chi = (k / n * F.col("squares") - n - (k - 1)) / F.sqrt(2 * (k - 1))
    # runs above and below the alphabet's middle
    side = F.transform("x", lambda v: (v >= k / 2).cast("int"))
    nxt = lambda a: F.slice(a, F.lit(2), F.greatest(n.cast("int") - 1, F.lit(0)))
    now = lambda a: F.slice(a, F.lit(1), F.greatest(n.cast("int") - 1, F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    turns = total(F.zip_with(now(side), nxt(side), lambda a, b: (a != b).cast("double")))
    runs = (turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    # serial correlation of neighbouring symbols
    mean = total(F.col("x")) / n
    spread = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
    serial = total(F.zip_with(now(F.col("x")), nxt(F.col("x")), lambda a, b: (a - mean) * (b - mean)))
    z = (F.when(spread > 0, serial / spread).otherwise(F.lit(1.0)) + 1 / n) * F.sqrt(n)
    steady = (chi < STEADY) & (F.abs(runs) < STEADY) & (F.abs(z) < STEADY)
    # each test's p-value where the candidate is language, as an upper bound of its tail, on the side of randomness.
    # Chi-squared too small: its only random part is the number of equal pairs, squares - n, with the mean and variance
    # that language gives it.
    pairs = n * (n - 1)
    equal = (chi * F.sqrt(2 * (k - 1)) + n + (k - 1)) * n / k - n
    low = (equal - pairs * COINCIDENCE) / F.sqrt(2 * pairs * COINCIDENCE * (1 - COINCIDENCE) + 4 * pairs * (n - 2) * (TRIPLE - COINCIDENCE**2))
    log1 = F.when(low < 0, -low * low / 2 - F.log(F.lit(2.0))).otherwise(F.lit(0.0))
    # runs of one class too many
    share = F.col("change") / (n - 1)
    kl = F.when(share >= 1, -F.log(F.lit(CHANGE))).otherwise(share * F.log(share / CHANGE) + (1 - share) * F.log((1 - share) / (1 - CHANGE)))
    log2 = F.when(share > CHANGE, -(n - 1) * kl).otherwise(F.lit(0.0))
    # serial correlation too small
    apart = z - SERIAL * F.sqrt(n)
    log3 = F.when(apart < 0, -apart * apart / 2 - F.log(F.lit(2.0))).otherwise(F.lit(0.0))
    # Fisher's product of three
    log_t = log1 + log2 + log3
    log_p = log_t + F.log(1 - log_t + log_t * log_t / 2)
    decades = F.least(F.greatest(-log_p / F.log(F.lit(10.0)), F.lit(0.0)), F.lit(float(BINS - 1) / PER_DECADE))
    return m.withColumn("steady", steady).withColumn("bin", F.floor(decades * PER_DECADE).cast("int")).withColumn("stratum", F.floor(F.log2("n")).cast("int"))


def scan_secrets(docs: DataFrame, false_discovery: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row.

    spans lists kind:start:end (code points, end exclusive) by start, then kind in the order of KINDS.
    Beyond the base patterns, a run of 20 or more token characters is a `random` span when it touches no
    base span, passes the battery as random (chi-squared over the alphabet of its inferred encoding, runs about the
    middle, serial correlation) and fails it as language: chi-squared, runs of classes and serial correlation each give a
    p-value, and their product is held to the false-discovery rate asked for
    by Benjamini and Hochberg's rule within strata of length over all candidates of the table. A run with
    signs of both base64 alphabets is a candidate over the 66 of both, and so is each part of 20 or more
    characters between the signs of either; spans that overlap become one. Digits alone are never random. Null texts are empty; a document without spans has counts of 0 and the hash
    of the empty string; repeated rows are scanned each; other columns are ignored.

    One scan of the texts finds segments; only matches go on. Starts are running sums in a window over
    one document's own matches. P-values meet in at most 400 bins a stratum (under 64 strata), the only
    table that is broadcast.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.when(F.contains(raw, F.lit(OPEN)) | F.contains(raw, F.lit(CLOSE)), F.translate(raw, OPEN + CLOSE, OTHER * 2)).otherwise(raw)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), plain.alias("text"))
    parts = save(src.select("doc_id", *[_segments(F.col("text"), k).alias(k) for k in KINDS]).withColumn("uid", F.monotonically_increasing_id()), "segments")
    each = [parts.where(F.col(k).isNotNull()).select("uid", F.lit(i).alias("kind"), F.posexplode(k).alias("at", "s")) for i, k in enumerate(KINDS)]
    rows = each[0]
    for more in each[1:]:
        rows = rows.union(more)
    before = Window.partitionBy("uid", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.select("uid", "kind", F.coalesce(F.sum("s.n").over(before), F.lit(0)).alias("start"), F.col("s.n").alias("n_chars"), F.col("s.body").alias("body"))
    size = F.when(F.col("kind") == 0, F.length(F.regexp_extract("body", PATTERNS["assign"], 2))).otherwise(F.col("n_chars"))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    found = save(found.where(F.col("body").isNotNull()).where(size >= least).withColumn("end", F.col("start") + F.col("n_chars")), "found")
    tested = save(_battery(_candidates(found.where("kind = 3"))).select("uid", "start", "end", "steady", "bin", "stratum"), "tested")
    bins = tested.groupBy("stratum", "bin").agg(F.count("*").alias("c"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    all_ = Window.partitionBy("stratum")
    passed = bins.withColumn("above", F.sum("c").over(down)).withColumn("m", F.sum("c").over(all_))
    limits = passed.where(F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) <= false_discovery * F.col("above") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("least_bin"))
    random = tested.join(F.broadcast(limits), "stratum").where("steady AND bin >= least_bin").select("uid", "start", "end")
    # a part may be clear of a base span that its run touches
    fixed = found.where("kind < 3").select(F.col("uid").alias("u"), F.col("start").alias("s0"), F.col("end").alias("e0"))
    random = random.join(fixed, (F.col("uid") == F.col("u")) & (F.col("s0") < F.col("end")) & (F.col("e0") > F.col("start")), "left_anti")
    random = _merged(random).select("uid", F.lit(3).alias("kind"), "start", "end")
    spans = found.where("kind < 3").select("uid", "kind", "start", "end").union(random).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < 3)
    spans = spans.withColumn("base", base).withColumn("s", F.filter("s", lambda x: (x["kind"] < 3) | ~F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))))
    name = F.array(*map(F.lit, KINDS))
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")
    count = lambda k: F.coalesce(F.size(F.filter("s", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    out = parts.select("uid", "doc_id").join(spans, "uid", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    out = out.withColumn("base", F.coalesce("base", F.filter("s", lambda x: x["kind"] < 3)))
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))
