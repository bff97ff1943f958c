"""Numbered prose: elements, dependence and its chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how a claim refers to the ones it depends on.
REFERENCE = r"(?i)\b(?:of|in|to|by|with)\s+(?:any\s+(?:one\s+)?of\s+)?claims?\s+([0-9]+)(?:\s*(?:-|to|or|and|,)\s*([0-9]+))?"


def claims(texts: DataFrame) -> DataFrame:
    """(doc, n, text, parents, dependent) of numbered claims in texts of (doc, text): `1. ...` at a line's start."""
    rows = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*[0-9]+\s*[.)]\s+[^\n]+(?:\n(?!\s*[0-9]+\s*[.)]\s)[^\n]*)*"), F.lit(0))).alias("raw"))
    out = rows.select("doc", F.regexp_extract("raw", r"^\s*([0-9]+)", 1).cast("int").alias("n"), F.trim(F.regexp_replace("raw", r"^\s*[0-9]+\s*[.)]\s+", "")).alias("text"))
    first = F.nullif(F.regexp_extract("text", REFERENCE, 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract("text", REFERENCE, 2), F.lit("")).cast("int")
    parents = F.when(first.isNull(), F.array().cast("array<int>")).when(last.isNull() | (last < first), F.array(first)).otherwise(F.sequence(first, last))
    return out.withColumn("parents", parents).withColumn("dependent", F.size("parents") > 0)


def chains(found: DataFrame, depth: int = 40) -> DataFrame:
    """(doc, n, depth, chain): each claim's chain up by its first parent; a cycle ends where it began."""
    up = found.select("doc", F.col("n").alias("at"), F.try_element_at("parents", F.lit(1)).alias("next"))
    level = found.select("doc", "n", F.array("n").alias("chain"), F.when(F.size("parents") > 0, F.try_element_at("parents", F.lit(1))).alias("next"))
    done = []
    for _ in range(depth):
        ends = level.where(F.col("next").isNull() | F.array_contains("chain", F.col("next")))
        done.append(ends)
        level = level.where(F.col("next").isNotNull() & ~F.array_contains("chain", F.col("next")))
        if level.isEmpty():
            break
        step = level.select("doc", "n", "chain", F.col("next").alias("at")).join(up.select("doc", "at", F.col("next").alias("after")), ["doc", "at"], "left")
        level = step.select("doc", "n", F.concat("chain", F.array("at")).alias("chain"), F.col("after").alias("next"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select("doc", "n", (F.size("chain") - 1).alias("depth"), "chain")


def elements(found: DataFrame) -> DataFrame:
    """(doc, n, element, text): a claim's parts, at `;`, `(a)` marks or line breaks."""
    parts = F.filter(F.transform(F.split("text", r";\s*(?:and\s+)?|\n+|\s+(?=\([a-z]\)\s)"), lambda s: F.trim(s)), lambda s: s != "")
    return found.select("doc", "n", F.posexplode(parts).alias("at", "text")).select("doc", "n", (F.col("at") + 1).alias("element"), "text")


def scorecard(chart: DataFrame, labels: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row a claim: how much of what was expected a chart found and cited.

    chart: (claim, element, class, target, label, agreeing), the verdict that each element ended with, and how many
    targets said PRESENT; labels: (claim, element, target, label), every target that was looked at, its element null if
    it has no verdict; anchors: (claim, target), the targets expected. Rows without a claim, chart rows without an
    element and repeated anchors do not count; recall is null where nothing was expected.
    """
    key = ["claim", "target"]
    wanted = anchors.select(*key).dropna().distinct()
    at = labels.join(wanted, key, "left_semi")
    backed = at.where("label = 'PRESENT' AND element IS NOT NULL").select("claim", "element").distinct().withColumn("backed", F.lit(True))
    rows = chart.where("claim IS NOT NULL AND element IS NOT NULL").join(wanted.withColumn("expected", F.lit(True)), key, "left").join(backed, ["claim", "element"], "left")
    own, there = F.col("class") == "mechanism", F.col("label") == "PRESENT"
    on, kept = F.coalesce("expected", F.lit(False)), F.coalesce("backed", F.lit(False))
    counts = {
        "elements": F.lit(True),
        "mechanism_rows": own,
        "mechanism_present": own & there,
        "present_on_anchor": own & there & on,
        "present_elsewhere": own & there & ~on,
        "anchor_supported": own & kept,
        "generic_rows": F.col("class") == "generic",
        "generic_present": (F.col("class") == "generic") & there,
        "lone_present": there & (F.col("agreeing") <= 1),
    }
    per = rows.groupBy("claim").agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    n = wanted.groupBy("claim").agg(F.count("*").alias("anchors"))
    met = at.select(*key).distinct().groupBy("claim").agg(F.count("*").alias("retrieved"))
    j = per.join(n, "claim", "full").join(met, "claim", "left").fillna(0)
    return j.withColumn("recall", F.when(F.col("anchors") > 0, F.round(F.col("retrieved") / F.col("anchors"), 2)))


def cost(usage: DataFrame, rates: list[tuple[str, float, float]], default: tuple[float, float]) -> DataFrame:
    """usage with in_tokens, out_tokens and usd. Rates are (pattern, input, output) a million tokens; the first pattern
    that a model's name matches counts, else the default. Cached tokens cost a tenth of input when read and five quarters
    when written. Null counts are 0."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    into, out = F.lit(default[0]), F.lit(default[1])
    for pattern, i, o in reversed(rates):
        hit = F.coalesce(F.col("model"), F.lit("")).rlike(f"(?i){pattern}")
        into, out = F.when(hit, i).otherwise(into), F.when(hit, o).otherwise(out)
    read, write = n("cache_read"), n("cache_write")
    usd = (n("input") * into + read * into * 0.1 + write * into * 1.25 + n("output") * out) / 1e6
    return usage.select("*", (n("input") + read + write).alias("in_tokens"), n("output").alias("out_tokens"), usd.alias("usd"))
