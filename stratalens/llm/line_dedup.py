"""Near-duplicate lines: a segment-partition edit join. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bitmap, components, drop, maybe_in, save, tested_in

#: Steps of the search for a common prefix or suffix: no line has 2^31 characters.
STEPS = [1 << k for k in range(30, -1, -1)]


#: Letters whose counts are compared before a pair is verified: an edit changes at most two counts, by one each.
LETTERS = "etaoinrs"
#: Members of one segment are compared in blocks of about so many lines, or so many characters of lines.
BLOCK, BLOCK_CHARS = 256, 1 << 21


def letter_counts() -> str:
    """The counts of LETTERS in a line, modulo 16, four bits each."""
    return " | ".join(f"shiftleft(cast((n - length(replace(line, '{c}'))) AS int) & 15, {4 * k})" for k, c in enumerate(LETTERS))


def counts_differ(a: str, b: str) -> str:
    """A lower bound of the sum of differences of two packed counts."""
    nibble = lambda x, k: f"(shiftright({x}, {4 * k}) & 15)"
    apart = lambda x, y, k: f"(({nibble(x, k)} - {nibble(y, k)}) & 15)"
    return " + ".join(f"least({apart(a, b, k)}, {apart(b, a, k)})" for k in range(len(LETTERS)))


def _keyed(m: str, parts: int, i: str, off: str) -> str:
    """Key of segment i of m characters cut into even parts, longer ones last, read from a line at the segment's
    start plus off; null where the line does not reach that far."""
    base, short = f"(({m}) div {parts})", f"({parts} - ({m}) % {parts})"
    start, size = f"({base} * {i} + greatest({i} - {short}, 0) + 1 + {off})", f"({base} + if({i} >= {short}, 1, 0))"
    return f"if({start} >= 1 AND {start} + {size} - 1 <= n, xxhash64(cast({m} AS int), {i}, substring(line, cast({start} AS int), cast({size} AS int))), NULL)"


def places(threshold: int) -> list[tuple[int, int, int]]:
    """(less, i, off): where a line must hold segment i of one that is `less` characters shorter. Segment i has at most i
    edits before it, or else an earlier one matches; and seen from the right at most threshold - i after it."""
    return [
        (less, i, off)
        for less in range(threshold + 1)
        for i in range(threshold + 1)
        for off in range(max(-i, less - (threshold - i)), min(i, less + threshold - i) + 1)
    ]


def own_keys(threshold: int) -> str:
    """The keys of a line's threshold + 1 segments, as an array."""
    return "array(" + ", ".join(_keyed("n", threshold + 1, str(i), "0") for i in range(threshold + 1)) + ")"


def probe_keys(lines: DataFrame, threshold: int) -> DataFrame:
    """lines(line, n, …) once for each place other than its own segments', with the key of what stands there. The places
    are rows, so that one small expression serves them all."""
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("less", "i", "off"), p, strict=True)]) for p in places(threshold) if p[0] or p[2]])
    rows = lines.select("*", F.inline(listed))
    return rows.withColumn("key", F.expr(_keyed("n - less", threshold + 1, "i", "off"))).where("key IS NOT NULL").drop("less", "i", "off")


def _common(a: Column, b: Column, most: Column, cut) -> Column:
    return F.aggregate(F.array(*map(F.lit, STEPS)), F.lit(0), lambda got, s: F.when((got + s <= most) & (cut(a, got + s) == cut(b, got + s)), got + s).otherwise(got))


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether the edit distance of a and b is at most threshold.

    What both begin and end with is set aside. On the rest, the bit-parallel recurrence over a diagonal band of
    2 * threshold + 2 bits: each character of the longer text updates the vertical delta vectors in one
    word, whatever the lengths; once the distance is beyond reach the state is handed on unchanged.
    """
    width = 2 * threshold + 2
    top, full = 1 << (width - 1), (1 << width) - 1
    lit = lambda v: F.lit(v).cast("long")
    band = lambda v: v.bitwiseAND(lit(full))

    def distance(x: Column, y: Column) -> Column:
        """x is the longer; both arrays of characters, the shorter longer than threshold."""
        m, n = F.size(x), F.size(y)
        zero = F.struct(lit(full & ~((1 << (width - threshold - 1)) - 1)).alias("vp"), lit(0).alias("vn"), lit(threshold).alias("d"), lit(top >> 1).alias("h"))
        limit = F.lit(2 * threshold) + n - m + threshold

        def step(s: Column, i: Column) -> Column:
            c = F.element_at(y, i + 1)
            match = lit(0)
            for k in range(width):
                at = i + (threshold + 1 - width + k)
                match = match + F.when((at >= 0) & (at < m) & F.get(x, at).eqNullSafe(c), lit(1 << k)).otherwise(lit(0))

            def second(q: Column) -> Column:
                vp, vn, pm = q["vp"], q["vn"], q["pm"]
                return F.transform(
                    F.array(F.struct(vp.alias("vp"), vn.alias("vn"), band(band(pm.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(pm).bitwiseOR(vn)).alias("d0"))),
                    lambda w: F.struct(
                        w["vp"].alias("vp"),
                        w["d0"].alias("d0"),
                        band(w["vn"].bitwiseOR(F.bitwise_not(w["d0"].bitwiseOR(w["vp"])))).alias("hp"),
                        w["d0"].bitwiseAND(w["vp"]).alias("hn"),
                    ),
                )[0]

            def third(w: Column) -> Column:
                down = F.shiftrightunsigned(w["d0"], 1)
                inside = i < m - threshold
                bit = lambda v, mask: F.when(v.bitwiseAND(mask) != 0, lit(1)).otherwise(lit(0))
                moved = F.when(inside, 1 - bit(w["d0"], lit(top))).otherwise(bit(w["hp"], s["h"]) - bit(w["hn"], s["h"]))
                return F.struct(
                    band(w["hn"].bitwiseOR(F.bitwise_not(down.bitwiseOR(w["hp"])))).alias("vp"),
                    down.bitwiseAND(w["hp"]).alias("vn"),
                    (s["d"] + moved).alias("d"),
                    F.when(inside, s["h"]).otherwise(F.shiftrightunsigned(s["h"], 1)).alias("h"),
                )

            first = F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), match.alias("pm"))
            updated = F.transform(F.transform(F.array(first), second), third)[0]
            return F.when(s["d"] > limit, s).otherwise(updated)

        return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step)["d"]

    def strip(p: Column, q: Column) -> Column:
        """Structs of the two texts without their common prefix and suffix, the longer first."""
        least = F.least(F.length(p), F.length(q))
        pre = _common(p, q, least, lambda t, k: F.substring(t, F.lit(1), k))
        one = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"), pre.alias("pre"))), lambda s: F.struct(F.substring(s["p"], s["pre"] + 1, F.length(s["p"])).alias("p"), F.substring(s["q"], s["pre"] + 1, F.length(s["q"])).alias("q")))[0]
        return one

    def tail(s: Column) -> Column:
        least = F.least(F.length(s["p"]), F.length(s["q"]))
        suf = _common(s["p"], s["q"], least, lambda t, k: F.right(t, k))
        return F.transform(F.array(F.struct(s["p"].alias("p"), s["q"].alias("q"), suf.alias("suf"))), lambda w: F.struct(F.substring(w["p"], F.lit(1), F.length(w["p"]) - w["suf"]).alias("p"), F.substring(w["q"], F.lit(1), F.length(w["q"]) - w["suf"]).alias("q")))[0]

    def ordered(s: Column) -> Column:
        """The longer text first. Bound to a variable, as everything below: an expression inside a function is
        evaluated at each use."""
        swap = F.length(s["p"]) < F.length(s["q"])
        return F.struct(F.when(swap, s["q"]).otherwise(s["p"]).alias("p"), F.when(swap, s["p"]).otherwise(s["q"]).alias("q"))

    def verdict(s: Column) -> Column:
        chars = F.array(F.struct(F.split(s["p"], "").alias("x"), F.split(s["q"], "").alias("y")))
        near = F.transform(chars, lambda w: distance(w["x"], w["y"]) <= threshold)[0]
        # a rest of at most threshold characters: the built-in banded recurrence decides
        short = F.levenshtein(s["p"], s["q"], threshold) >= 0
        return F.when(F.length(s["p"]) - F.length(s["q"]) > threshold, F.lit(False)).when(F.length(s["q"]) <= threshold, short).otherwise(near)

    return F.transform(F.transform(F.transform(F.array(strip(a, b)), tail), ordered), verdict)[0]


def _links(threshold: int) -> Column:
    """A spanning forest of the links among the members m of a block, or between two blocks, as (a, b) pairs of uid.

    Each member that has the segment as its own is compared with all those that it is not joined to yet; labels hold what is
    joined. A member so links to each group once, and a block of any size gives fewer links than it has members.
    """
    m = F.col("m")

    def near(p: Column, q: Column) -> Column:
        cheap = (F.abs(p["n"] - q["n"]) <= threshold) & ((F.col("lo") == F.col("hi")) | (p["block"] != q["block"]))
        counts = F.lit(0)
        for k in range(len(LETTERS)):
            apart = F.shiftright(p["letters"], 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(q["letters"], 4 * k).bitwiseAND(F.lit(15))
            counts = counts + F.least(apart.bitwiseAND(F.lit(15)), (-apart).bitwiseAND(F.lit(15)))
        return F.when(~cheap, False).when(counts > 2 * threshold, False).otherwise(within(p["line"], q["line"], threshold))

    def step(s: Column, at: Column) -> Column:
        def merge(w: Column) -> Column:
            """w: the labels so far, the member's own, and the places of those near it."""
            groups = F.array_distinct(F.transform(w["found"], lambda j: w["labels"][j]))
            return F.transform(
                F.array(groups),
                lambda g: F.struct(
                    F.transform(w["labels"], lambda x: F.when((x == w["own"]) | F.array_contains(g, x), F.least(w["own"], F.array_min(g))).otherwise(x)).alias("labels"),
                    F.concat(w["links"], F.transform(g, lambda x: F.struct(m[at]["uid"].alias("a"), m[F.array_min(F.filter(w["found"], lambda j: w["labels"][j] == x))]["uid"].alias("b")))).alias("links"),
                ),
            )[0]

        every = F.sequence(F.lit(0), F.size(m) - 1)
        found = F.filter(every, lambda j: (s["labels"][j] != s["labels"][at]) & near(m[at], m[j]))
        state = F.struct(s["labels"].alias("labels"), s["links"].alias("links"), s["labels"][at].alias("own"), found.alias("found"))
        return F.transform(F.array(state), lambda w: F.when(F.size(w["found"]) > 0, merge(w)).otherwise(F.struct(w["labels"].alias("labels"), w["links"].alias("links"))))[0]

    own = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda j: m[j]["own"])
    start = F.struct(F.transform(m, lambda x: x["uid"]).alias("labels"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("links"))
    return F.aggregate(own, start, step)["links"]


def _linked(classes: DataFrame, lines: DataFrame, threshold: int) -> DataFrame:
    """(h, g, component) of the classes of lines that are within the threshold of another, lines being all rows (h, g, line, n)
    that take part, read again as often as needed."""
    own = classes.where("keys IS NOT NULL").select("h", "g", "len", F.explode("keys").alias("key"))
    n_keys = classes.agg(F.sum(F.size("keys"))).first()[0] or 0
    probes = maybe_in(probe_keys(lines.select("h", "g", "line", "n"), threshold).select("key", "h", "g", F.col("n").alias("len")), "key", bitmap(own, "key", n_keys))
    hits = save(probes.groupBy("key", "h", "g").agg(F.max("len").alias("len")), "hits")
    # segments that more than one line has
    keys = own.select("key", "len").union(hits.select("key", "len")).groupBy("key").agg(F.count("*").alias("members"), F.sum("len").alias("chars")).where("members > 1")
    met = save(keys, "met")
    total, n_met = (met.agg(F.sum("members"), F.count("*")).first() or (0, 0))[:2]
    has = bitmap(met, "key", n_met)
    both = maybe_in(own, "key", has).select("key", "h", "g", F.lit(True).alias("own")).union(maybe_in(hits, "key", has).select("key", "h", "g", F.lit(False)))
    entries = save(attach(save(both, "both"), met, ["key"], "members", total or 0, how="inner").where("members IS NOT NULL"), "entries")
    wanted = save(entries.select("h", "g").distinct(), "wanted")
    found = maybe_in(lines.select("h", "g", "line"), "h", bitmap(wanted, "h", wanted.count())).groupBy("h", "g").agg(F.first("line").alias("line")).join(wanted, ["h", "g"], "left_semi")
    texts = save(found.withColumn("n", F.length("line")).withColumn("letters", F.expr(letter_counts())).withColumn("uid", F.monotonically_increasing_id()), "texts")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    members = entries.join(texts, ["h", "g"]).withColumn("blocks", blocks).withColumn("block", F.pmod("uid", F.col("blocks")))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.groupBy("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    groups = members.agg(F.collect_list(F.struct("uid", "own", "block", "line", "n", "letters")).alias("m"))
    links = save(groups.where(F.exists("m", lambda x: x["own"])).select(F.inline(_links(threshold))), "links")
    out = save(components(links).join(texts.select(F.col("uid").alias("node"), "h", "g"), "node").select("h", "g", "component"), "components")
    drop(hits, met, entries, wanted, texts, links)
    return out


def line_dedup(docs: DataFrame, threshold: int = 2, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_linked, n_removed, kept_text for every row.

    Lines are what newlines separate. Lines of least_chars characters or more are linked when their edit
    distance is at most threshold; of each group of linked or equal lines, the first (smallest doc_id,
    then line) stays and the others are removed. n_linked counts the document's lines that have a link to
    a different text. Shorter lines are grouped only where equal, as two edits make different words of
    them; empty lines stay. A null text is one empty line; rows that repeat a doc_id and
    text count as one document; null ids come first; other columns are ignored; an empty table gives an
    empty result.

    Equal lines are one class from the start, told by 128 bits of hash. A class is cut into threshold + 1 segments; a line
    within the threshold keeps one of them, and the places where it can stand follow from the lengths. A bounded bitmap of
    all segments stops probes that find none before anything is shuffled; only hashes are, until lines are known to share a
    segment. Those are compared in blocks within a task, by counts of some letters and then by a banded bit-parallel
    edit distance, and a block returns a spanning forest of its links: no pairs are made.
    """
    id_ = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("d"), text.alias("text"), F.xxhash64(text).alias("t1"))
    lines = src.select("d", "t1", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("n", F.length("line")).where("n > 0")
    lines = lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(3), "line"))
    keys = F.when(F.col("n") >= least_chars, F.expr(own_keys(threshold)))
    seen = save(lines.select("d", "t1", "no", "h", "g", F.when(F.col("n") >= least_chars, F.col("n")).alias("len"), keys.alias("keys")), "lines")
    classes = seen.groupBy("h", "g").agg(F.count("*").alias("size"), F.min(F.struct("d", "no")).alias("first"), F.max("len").alias("len"), F.first("keys").alias("keys"))
    classes = save(classes, "classes")
    joined = _linked(classes, lines.where(F.col("n") >= least_chars), threshold)
    tested = tested_in(classes.select("h", "g", F.col("size").alias("n"), "first"), "h", bitmap(joined, "h", joined.count()))
    placed = save(tested.where("_maybe").drop("_maybe").join(joined, ["h", "g"], "left"), "placed")
    heads = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("stays"))
    linked = placed.where("component IS NOT NULL").join(heads, "component").select("h", "g", "n", F.lit(True).alias("linked"), "stays")
    alone = placed.where("component IS NULL AND n > 1").union(tested.where("NOT _maybe AND n > 1").select("h", "g", "n", "first", F.lit(None).cast("long")))
    groups = linked.union(alone.select("h", "g", "n", F.lit(False), "first"))
    groups = save(groups.select("h", "g", "n", "linked", F.col("stays.d").alias("d0"), F.col("stays.no").alias("no0")), "groups")
    total, n_groups = groups.agg(F.sum("n"), F.count("*")).first()
    some = save(maybe_in(seen.select("d", "t1", "no", "h", "g"), "h", bitmap(groups, "h", n_groups)), "some")
    drop(classes, seen, placed)
    marked = attach(some, groups, ["h", "g"], "n", total or 0, how="inner").where("d0 IS NOT NULL")
    gone = F.collect_set(F.when((F.col("d") != F.col("d0")) | (F.col("no") != F.col("no0")), F.col("no")))
    notes = save(marked.groupBy("d", "t1").agg(gone.alias("gone"), F.count_distinct(F.when(F.col("linked"), F.col("no"))).alias("n_linked")), "notes")
    drop(some, groups)
    tested = tested_in(src, "d", bitmap(notes, "d", notes.count()))
    clear = tested.where("NOT _maybe").select("doc_id", "text", F.array().cast("array<int>").alias("gone"), F.lit(0).cast("long").alias("n_linked"))
    rest = tested.where("_maybe").join(notes, ["d", "t1"], "left").select("doc_id", "text", F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("n_linked", F.lit(0).cast("long")))
    own = F.split("text", "\n")
    out = clear.union(rest)
    kept = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.filter(own, lambda l, i: ~F.array_contains("gone", i)), "\n"))
    return out.select("doc_id", F.size(own).cast("long").alias("n_lines"), "n_linked", F.size("gone").cast("long").alias("n_removed"), kept.alias("kept_text"))
