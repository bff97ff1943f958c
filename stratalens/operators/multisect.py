"""Multi-term intersection search with hard, soft and excluded terms."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import lines

#: A term found in comments only counts this much.
COMMENT = 0.25


@dataclass(frozen=True)
class Term:
    text: str
    soft: bool = False
    negated: bool = False
    pattern: bool = False

    def found_in(self, low: Column) -> Column:
        return low.rlike(self.text.lower()) if self.pattern else F.contains(low, F.lit(self.text.lower()))


def parse_terms(query: str) -> list[Term]:
    """Terms are separated by `;` (`;;` stands for one); `?` at the end makes a term soft, `!` or `NOT ` before it
    excludes, `/re/` is a pattern, and a dot in a plain term stands for at most one character."""
    out = []
    for raw in re.split(r"(?<!;);(?!;)", query):
        text = raw.replace(";;", ";").strip()
        if not text:
            continue
        negated = text.startswith("!") or text.upper().startswith("NOT ")
        text = re.sub(r"^(!|NOT )\s*", "", text, flags=re.I) if negated else text
        if len(text) > 2 and text[0] == text[-1] == "/":
            out.append(Term(text[1:-1], negated=negated, pattern=True))
            continue
        soft = text.endswith("?")
        text = text.removesuffix("?")
        dotted = "." in text
        out.append(Term(".?".join(map(re.escape, text.split("."))) if dotted else text, soft, negated, dotted))
    return out


def multisect(corpus: DataFrame, terms: list[Term], scope: str) -> DataFrame:
    """(scope, weighted_terms, terms, n_lines, score), best first, of scopes that hold every live hard term and no
    excluded one. A term no file holds does not raise the bar.

    Every line is tested once against all terms; a file is one row of per-term weights from there on, and one
    aggregate by scope follows. Document frequencies are one row.
    """
    plain = [t for t in terms if not t.negated]
    low = F.lower("line")
    weight = F.when(F.trim("line").rlike(r"^(//|/\*|\*|#)"), COMMENT).otherwise(1.0)
    found = [F.max(F.when(t.found_in(low), weight)).alias(f"t{k}") for k, t in enumerate(terms)]
    per_file = lines(corpus).groupBy("folder", "path").agg(F.count("*").alias("n_lines"), *found)
    df = per_file.agg(F.count("*").alias("n"), *[F.count(f"t{k}").alias(f"df{k}") for k in range(len(terms))])
    per = per_file if scope == "path" else per_file.groupBy(scope).agg(F.sum("n_lines").alias("n_lines"), *[F.max(f"t{k}").alias(f"t{k}") for k in range(len(terms))])
    rows = per.join(F.broadcast(df))  # one row
    hard = [k for k, t in enumerate(terms) if not t.soft and not t.negated]
    total = lambda cols: sum(cols, F.lit(0))
    live = total((F.col(f"df{k}") > 0).cast("int") for k in hard)
    held = total(F.col(f"t{k}").isNotNull().cast("int") for k in hard)
    barred = total(F.col(f"t{k}").isNotNull().cast("int") for k, t in enumerate(terms) if t.negated and not t.soft)
    w = {k: F.coalesce(f"t{k}", F.lit(0.0)) for k, t in enumerate(terms) if t in plain}
    idf = {k: F.when(F.col(f"df{k}") > 0, F.log(F.col("n") / F.col(f"df{k}"))).otherwise(0.0) for k in w}
    density = 1 / (1 + F.log10(F.greatest(F.lit(1.0), F.col("n_lines") / 50)))
    out = rows.where((held >= live) & (barred == 0) & (total(F.col(f"t{k}").isNotNull().cast("int") for k in range(len(terms))) > 0)).select(
        scope,
        F.round(total(w.values()), 4).alias("weighted_terms"),
        total(F.col(f"t{k}").isNotNull().cast("long") for k in w).cast("long").alias("terms"),
        "n_lines",
        F.round(total(w[k] * idf[k] for k in w) * density, 6).alias("score"),
    )
    return out.orderBy(F.desc("weighted_terms"), F.desc("terms"), F.desc("score"), scope)
