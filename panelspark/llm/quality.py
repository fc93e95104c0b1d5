"""Quality rules whose cutoffs keep false rejection within a proven risk.

Every whole text is measured. A fixed base rule rejects texts that are too short or too repetitive.
Further rules reject a text whose measure exceeds a cutoff, and the cutoffs come from labelled
documents: for a stratum (a language, say) and a rule, cutoffs are tested from the most lenient to
the strictest. A cutoff is certified if the exact binomial tail P(X <= k), X ~ Binomial(n, risk),
is small enough, where k of the stratum's n good documents exceed it: were the true rate of false
rejection above the risk, so few would be unlikely. Testing stops at the first cutoff that fails
(a fixed sequence, so cutoffs of one rule need no further correction); the error level is divided by
the number of strata and rules (Bonferroni). Of the certified cutoffs, the one that rejects the most
bad less good documents is taken, the most lenient of equals; without any gain the rule rests.

DataFrame functions only; texts are read once. The table of cutoffs has a row for each stratum with enough labelled
documents for a cutoff, some hundreds at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPACE = r"[\x20\x09-\x0D]+"
#: Largest rate of false rejection of one rule in one stratum, and the chance that any of these claims is wrong.
RISK, LEVEL = 0.01, 0.05
#: Strata with cutoffs up to which their table is broadcast; beyond, it is joined by a shuffle, with the same result.
STRATA = 10_000
RATIOS = [k / 50 for k in range(1, 50)]
#: Rules: measure and cutoffs, strictest first.
RULES = {
    "symbol_ratio": RATIOS,
    "upper_ratio": RATIOS,
    "dup_line_ratio": RATIOS,
    "repeat_ratio": RATIOS,
    "mean_word_chars": [float(k) for k in range(6, 40)],
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{chars}]+", ""))).cast("long")


def measure(docs: DataFrame, text: str) -> DataFrame:
    """Adds BASE (long), ``base_failed`` and the measures of RULES (double, 0 where undefined).

    Words are runs of what isn't ASCII white space. A null text has no words; repeated rows stay; columns of
    the new names are replaced. ``n_repeat_words`` counts the words in three-word windows that occur twice or
    more in the text, first occurrences included: windows are compared by 64-bit hashes within a text.
    """
    t, plain, words, wins, pairs, twice = (common.free_name(docs, f"__{x}") for x in ("text", "plain", "words", "wins", "pairs", "twice"))
    df = docs.withColumn(t, common.text_or_empty(text))
    df = df.withColumn(plain, F.trim(F.regexp_replace(t, SPACE, " ")))
    df = df.withColumn(words, F.when(F.col(plain) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))
    n, w = F.size(words), F.col(words)
    df = df.withColumn(wins, F.when(n >= 3, F.transform(F.slice(w, 1, n - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<long>")))
    repeats = F.size(F.array_distinct(wins)) < F.size(wins)
    df = df.withColumn(pairs, F.when(repeats, F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    p = F.col(pairs)
    same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
    df = df.withColumn(twice, F.sort_array(F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    f = F.col(twice)
    covered = F.aggregate(F.transform(f, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(f, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_col, upper = common.free_name(docs, "__lines"), common.free_name(docs, "__upper")
    df = df.withColumn(line_col, lines)
    df = df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": (F.length(plain) - F.greatest(n - 1, F.lit(0))).cast("long"),
        "n_symbols": _count(F.col(t), "#*$%&|<>"),
        "n_dup_lines": (F.size(line_col) - F.size(F.array_distinct(line_col))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        upper: _count(F.col(t), "A-Z"),
    })
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    c = F.col
    df = df.withColumns({
        "base_failed": (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words")),
        "symbol_ratio": ratio(c("n_symbols"), c("word_chars")),
        "upper_ratio": ratio(c(upper), c("word_chars")),
        "dup_line_ratio": ratio(c("n_dup_lines"), F.size(line_col)),
        "repeat_ratio": ratio(c("n_repeat_words"), c("n_words")),
        "mean_word_chars": ratio(c("word_chars"), c("n_words")),
    })
    return df.drop(t, plain, words, wins, pairs, twice, line_col, upper)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p), exactly; 1 where k exceeds the mean (the tail is near a half there, or more)."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long")))).otherwise(F.array().cast("array<long>"))
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.aggregate(steps, start, add)["sum"])


def cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Rows (stratum, rule, cutoff) of the rules that work in a stratum. ``labelled``: stratum, good (boolean), the measures of RULES."""
    levels = F.expr("array(" + ",".join(f"struct('{r}' as rule, `{r}` as x, array({','.join(map(repr, sorted(g)))}) as grid)" for r, g in RULES.items()) + ")")
    each = labelled.filter("NOT base_failed").select("stratum", "good", F.explode(levels).alias("m")).select("stratum", "good", "m.*")
    over = F.size(F.filter("grid", lambda g: g < F.col("x")))  # so many cutoffs does the measure exceed
    counted = each.groupBy("stratum", "rule", "grid", over.alias("over")).agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    slots = counted.groupBy("stratum", "rule", "grid").agg(F.sum("good").alias("n"), F.collect_list(F.struct("over", "good", "bad")).alias("at"))  # as many as the grid has
    beyond = lambda what: F.aggregate("at", F.lit(0).cast("long"), lambda s, a: s + F.when(a["over"] > F.col("slot"), a[what]).otherwise(0))
    tests = slots.select("*", F.posexplode("grid").alias("slot", "cutoff")).select("stratum", "rule", "n", "slot", "cutoff", beyond("good").alias("k"), beyond("bad").alias("caught"))
    m = tests.select(F.count_distinct("stratum", "rule").alias("m"))
    tests = tests.crossJoin(F.broadcast(m)).withColumn("passed", binomial_tail(F.col("k"), F.col("n"), risk) <= F.lit(level) / F.col("m"))
    lenient_first = Window.partitionBy("stratum", "rule").orderBy(F.desc("slot"))
    certified = tests.withColumn("certified", F.min("passed").over(lenient_first)).filter("certified AND caught > k")
    return certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(F.col("caught") - F.col("k"), "cutoff")).alias("cutoff"))


def _stratum(stratum: str | None) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The cutoffs of each stratum (stratum, cut: map of rule to cutoff), from all labelled rows of ``measured``; written.

    ``labels``: columns ``doc_id`` and "quality"; of several labels of a document the least counts, and null ids
    or labels and labels of other documents are passed over. Null and empty strata are one. A stratum without enough
    labelled documents has no cutoffs. ``measured`` is read twice: give a written table.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col("quality").alias("quality")).filter("id IS NOT NULL AND quality IS NOT NULL").groupBy("id").agg(F.min("quality").alias("quality"))
    known = measured.select(F.col(doc_id).alias("id"), _stratum(stratum).alias("stratum"), "base_failed", *RULES).join(marks, "id")
    table = cutoffs(known.withColumn("good", F.col("quality") > 0), risk, level)
    return common.written(table.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut")), "cutoffs")[0]


def apply(measured: DataFrame, fitted: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """Adds ``kept`` (boolean) and ``failed_rules`` (array, sorted) to rows of ``measure``; these are read once.

    Rows of a stratum without cutoffs are judged by the base rule alone. Columns of the two names are replaced; all others stay.
    """
    key, cut = common.free_name(measured, "__stratum"), common.free_name(measured, "__cut")
    named = fitted.select(F.col("stratum").alias(key), F.col("cut").alias(cut))
    few = fitted.limit(STRATA + 1).count() <= STRATA
    judged = measured.withColumn(key, _stratum(stratum)).join(F.broadcast(named) if few else named, key, "left")
    failed = F.array_compact(F.array(*(F.when(F.col(r) > F.col(cut)[r], F.lit(r)) for r in sorted(RULES))))
    judged = judged.withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop(key, cut)


def keep(judged: DataFrame) -> DataFrame:
    """The kept rows. The row number, which has no other use, keeps the filter above the measures.

    Pushed below them, it would repeat their expressions inside each other.
    """
    at = common.free_name(judged, "__at")
    return judged.withColumn(at, F.monotonically_increasing_id()).filter(F.col("kept") & (F.col(at) >= 0)).drop(at)


def judge(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", stratum: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """``fit`` and ``apply`` on the same rows."""
    return apply(measured, fit(measured, labels, doc_id, stratum, risk, level), stratum)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    measured, _ = common.written(measure(docs, "text").drop("text"), "measured")
    judged = judge(measured, common.table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *BASE, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


_GRID = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest([{', '.join(f'CAST({x!r} AS DOUBLE)' for x in g)}]) AS cutoff" for r, g in RULES.items())
_LONG = " UNION ALL ".join(f"SELECT doc_id, lang, good, '{r}' AS rule, {r} AS x FROM labelled" for r in RULES)
ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, coalesce(lang, '') AS lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(lines) AS n_lines
  FROM split LEFT JOIN rep USING (doc_id)),
measured AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
         CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio,
         CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars FROM m),
labelled AS (
  SELECT measured.*, q > 0 AS good FROM measured
  JOIN (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  WHERE NOT base_failed),
long AS ({_LONG}),
grid AS ({_GRID}),
tests AS (
  SELECT lang, rule, cutoff, sum(CAST(good AS BIGINT)) AS n, sum(CASE WHEN good AND x > cutoff THEN 1 ELSE 0 END) AS k,
         sum(CASE WHEN NOT good AND x > cutoff THEN 1 ELSE 0 END) AS caught
  FROM long JOIN grid USING (rule) GROUP BY lang, rule, cutoff),
family AS (SELECT count(*) AS m FROM (SELECT DISTINCT lang, rule FROM tests)),
tail AS (
  SELECT lang, rule, cutoff, n, k, CAST(0 AS BIGINT) AS i, n * ln(1 - {RISK}) AS term, exp(n * ln(1 - {RISK})) AS total FROM tests
  UNION ALL
  SELECT lang, rule, cutoff, n, k, i + 1, term + ln((n - i) / (i + 1)) + ln({RISK} / (1 - {RISK})),
         total + exp(term + ln((n - i) / (i + 1)) + ln({RISK} / (1 - {RISK}))) FROM tail WHERE i < k AND k <= n * {RISK}),
passed AS (
  SELECT tests.*, CASE WHEN tests.k > tests.n * {RISK} THEN 1 ELSE total END <= {LEVEL} / m AS ok
  FROM tests JOIN tail ON tests.lang = tail.lang AND tests.rule = tail.rule AND tests.cutoff = tail.cutoff
       AND tail.i = CASE WHEN tests.k > tests.n * {RISK} THEN 0 ELSE tests.k END, family),
certified AS (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY cutoff DESC) AS c FROM passed),
chosen AS (
  SELECT lang, rule, cutoff FROM certified WHERE c AND caught > k
  QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY caught - k DESC, cutoff DESC) = 1),
every AS ({_LONG.replace("SELECT doc_id, lang, good,", "SELECT doc_id, lang,").replace("FROM labelled", "FROM measured")}),
failed AS (
  SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM every JOIN chosen USING (lang, rule) WHERE x > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept,
       coalesce(rules, '') AS failed_rules
FROM measured LEFT JOIN failed USING (doc_id)
"""
}
QUERIES = {"op4_quality_rules": op4_quality_rules}
