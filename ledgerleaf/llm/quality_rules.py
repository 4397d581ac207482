"""Quality rules with risk-controlled thresholds (SQL functions only).

Each rule rejects texts whose measure is above a cutoff. The cutoffs come from labelled holdouts: for every stratum
(language), rule and candidate cutoff, the good texts that the cutoff would reject are counted, and an exact binomial
bound tells whether their true share is below the rule's part of the allowed false rejections. Error probabilities are
divided by the number of strata and rules (Bonferroni), and the cutoffs of one rule are tested from lenient to strict,
stopping at the first that fails (fixed sequence), so with probability ``confidence`` no stratum loses more than
``max_false_rejection`` of its good texts. Among certified cutoffs the one that best separates bad from good is taken;
where none is certified the rule is off in that stratum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.store import materialize

#: Rule: (expression of the measure, cutoffs from lenient to strict).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.28, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1, 0.07, 0.05)),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}


@dataclass(frozen=True)
class RiskControl:
    max_false_rejection: float = 0.05
    confidence: float = 0.95
    stratum: str = "lang"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WORDS = r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w != '')"
_LINES = r"filter(split(t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
_REPEATED = "filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) or coalesce(get(s, j + 1).h = x.h, false))"
# Words covered by the windows that start at the sorted places p.
_COVERED = "aggregate(transform(p, (v, k) -> least({n}, coalesce(get(p, k + 1) - v, {n}))), 0, (a, v) -> a + v)"


def _repeat_words(n: int) -> str:
    words = "transform(w, x -> xxhash64(x))"
    following = ", ".join(f"u[i + {k}]" for k in range(1, n))
    hashes = _let(words, "u", f"transform(slice(u, 1, size(u) - {n - 1}), (x, i) -> xxhash64(x, {following}))")
    ordered = "sort_array(transform(h, (x, i) -> named_struct('h', x, 'p', i)))"
    places = f"sort_array(transform({_REPEATED}, x -> x.p))"
    covered = _let(ordered, "s", _let(places, "p", _COVERED.format(n=n)))
    # Most texts repeat no window; only the others are sorted.
    return f"if(size(w) < {n}, 0, {_let(hashes, 'h', f'if(size(array_distinct(h)) = size(h), 0, {covered})')})"


def measures(docs: DataFrame, stratum: str = "lang", window: int = 8) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    t = F.coalesce(F.col("text"), F.lit(""))
    counts = _let(
        _WORDS, "w", _let(_LINES, "l", f"named_struct('n_words', size(w), 'word_chars', length(array_join(w, '')), 'n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)), 'n_repeat_words', {_repeat_words(window)})")
    )
    rows = docs.select("doc_id", F.col(stratum).alias("stratum"), t.alias("t")).select(
        "doc_id", "stratum", F.expr(counts).alias("m"),
        (F.size(F.split("t", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
    )
    long = {c: F.col(f"m.{c}").cast("long") for c in ("n_words", "word_chars", "n_lines", "n_dup_lines", "n_repeat_words")}
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.withColumns(long).drop("m").withColumn("base_failed", failed)


def _log_factorial(n: str) -> str:
    """SQL for ln(n!): Stirling's series at n + 11, less the ten factors before it (relative error below 1e-14)."""
    z = f"(({n}) + 11D)"
    product = " * ".join(f"(({n}) + {k}D)" for k in range(1, 11))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - ln({product}))"


def binomial_tail(k: str, n: str, p: float) -> str:
    """SQL for P(X <= k) of a binomial (n, p); 1 from the mean on. Below it the terms fall towards 0; they are added
    from k down, as far as 40 standard deviations and 200 terms, beyond which they are below double precision."""
    top = f"exp({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'{n} - {k}')} + {k} * ln({p}D) + ({n} - {k}) * ln({1 - p}D))"
    last = f"greatest(1, {k} - cast(40 * sqrt({n} * {p}D) as bigint) - 200)"
    # a.t is the term of j; the term of j - 1 is t * j (1 - p) / ((n - j + 1) p)
    step = f"named_struct('t', a.t * j * {(1 - p) / p}D / ({n} - j + 1), 's', a.s + a.t * j * {(1 - p) / p}D / ({n} - j + 1))"
    falls = f"if({k} < 1, array(), sequence({k}, {last}, -1))"
    total = _let(top, "u", f"aggregate({falls}, named_struct('t', u, 's', u), (a, j) -> {step}, a -> a.s)")
    return f"if({k} >= {n} * {p}D, 1D, {total})"


def cutoffs(measured: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), rules: dict = RULES) -> DataFrame:
    """Certified cutoffs: stratum, rule, cutoff. ``measured`` are rows of ``measures``; only texts that pass the base
    rules count. A document with several labels counts as bad if one of them is."""
    marks = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = measured.filter("not base_failed").join(marks, "doc_id")
    # The first (most lenient) cutoff of each rule that rejects the text; texts that none rejects have no place.
    places = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), F.coalesce(*[F.when(F.expr(measure) > c, k) for k, c in enumerate(cuts)]).alias("place"))
            for name, (measure, cuts) in rules.items()
        ]
    )
    good, bad = F.col("_quality") == 1, F.col("_quality") == 0
    counted = rows.select("stratum", "_quality", F.explode(places).alias("r")).groupBy("stratum", "r.rule", "r.place")
    counts = counted.agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    key = Window.partitionBy("stratum", "rule")
    totals = counts.withColumns({"n_good": F.sum("good").over(key), "n_bad": F.sum("bad").over(key)})
    upto = totals.filter("place is not null").withColumns(
        {"k_good": F.sum("good").over(key.orderBy("place")), "k_bad": F.sum("bad").over(key.orderBy("place"))}
    )
    # One row for each stratum; every stratum with a labelled text is a test.
    n_strata = rows.select("stratum").distinct().count()
    share = control.max_false_rejection / len(rules)
    tested = upto.withColumn("n_strata", F.lit(max(n_strata, 1)))
    tested = tested.withColumn("p", F.expr(binomial_tail("k_good", "n_good", share)))
    tested = tested.withColumn("passes", F.col("p") <= F.lit(1 - control.confidence) / (F.col("n_strata") * len(rules)))
    certified = tested.withColumn("certified", F.min("passes").over(key.orderBy("place"))).filter("certified")
    caught, lost = (F.coalesce(F.try_divide(F.col(f"k_{x}"), F.col(f"n_{x}")), F.lit(0.0)) for x in ("bad", "good"))
    best = certified.withColumn("gain", caught - lost)
    chosen = best.groupBy("stratum", "rule").agg(F.max_by("place", F.struct("gain", -F.col("place"))).alias("place"))
    cut = F.coalesce(*[F.when(F.col("rule") == name, F.array(*map(F.lit, cuts))[F.col("place")]) for name, (_, cuts) in rules.items()])
    return chosen.select("stratum", "rule", cut.alias("cutoff"))


def apply_rules(docs: DataFrame, labels: DataFrame, control: RiskControl = RiskControl(), rules: dict = RULES) -> DataFrame:
    """The measures of every document, and kept: false if the base rules or a certified cutoff reject it.

    Defined cases: a null text has no words and fails the base rules; a null stratum is a stratum of its own; repeated
    rows count and are judged each; without labels only the base rules reject; an empty table gives no rows.
    """
    measured = materialize(measures(docs, control.stratum), "measures")
    limits = cutoffs(measured, labels, control, rules)
    wide = limits.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cutoff"))).alias(f"_{name}") for name in rules])
    wide = materialize(wide.withColumnRenamed("stratum", "_stratum"), "cutoffs")
    rejected = F.lit(False)
    for name, (measure, _) in rules.items():
        rejected = rejected | F.coalesce(F.expr(measure) > F.col(f"_{name}"), F.lit(False))
    joined = measured.join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~(F.col("base_failed") | rejected)).select(*measured.columns, "kept")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns."""
    out = apply_rules(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    control, share = RiskControl(), RiskControl().max_false_rejection / len(RULES)
    cuts = " UNION ALL ".join(f"SELECT '{name}' AS rule, {k} AS place, {c}::DOUBLE AS cutoff" for name, (_, cs) in RULES.items() for k, c in enumerate(cs))
    values = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{name}' AS rule, ({measure})::DOUBLE AS v FROM m" for name, (measure, _) in RULES.items())
    log_p = f"lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share}) + (n_good - j) * ln({1 - share})"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS c FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words,
         len(w) < 20 OR 100 * coalesce(c, 0) > 30 * len(w) AS base_failed
  FROM w LEFT JOIN cov USING (r)
), marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
cuts AS ({cuts}),
v AS ({values}),
lab AS (SELECT v.*, quality FROM v JOIN marks USING (doc_id) WHERE NOT base_failed),
n AS (SELECT lang, rule, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad FROM lab GROUP BY lang, rule),
k AS (
  SELECT n.*, place, cutoff, (SELECT count(*) FROM lab WHERE lab.lang IS NOT DISTINCT FROM n.lang AND lab.rule = n.rule AND v > cutoff AND quality = 1) AS k_good,
         (SELECT count(*) FROM lab WHERE lab.lang IS NOT DISTINCT FROM n.lang AND lab.rule = n.rule AND v > cutoff AND quality = 0) AS k_bad,
         (SELECT count(*) FROM (SELECT DISTINCT lang FROM lab)) AS n_strata
  FROM n JOIN cuts USING (rule)
), p AS (
  SELECT *, CASE WHEN k_good >= n_good * {share} THEN 1 ELSE (SELECT sum(exp({log_p})) FROM (SELECT unnest(range(0, k_good + 1)) AS j)) END AS p FROM k
), ok AS (
  SELECT *, bool_and(p <= {1 - control.confidence} / (n_strata * {len(RULES)})) OVER (PARTITION BY lang, rule ORDER BY place) AS certified,
         CASE WHEN n_bad > 0 THEN k_bad / n_bad ELSE 0 END - k_good / n_good AS gain
  FROM p
), best AS (
  SELECT lang, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY lang, rule ORDER BY gain DESC, place) AS rn FROM ok WHERE certified) WHERE rn = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({" OR ".join(f"coalesce({measure} > (SELECT max(cutoff) FROM best WHERE best.lang IS NOT DISTINCT FROM m.lang AND rule = '{name}'), false)" for name, (measure, _) in RULES.items())}, false) AS kept
FROM m
"""


SQL = _sql()
