"""Quality rules whose cutoffs come with a guarantee, in DataFrame operations alone.

Each rule rejects a document when its score (per mille) exceeds a cutoff. Cutoffs are chosen
for every stratum and rule on a labelled holdout: among its n good documents, k exceed the
candidate; the exact binomial tail P(Bin(n, a) <= k) is the p-value of "this cutoff
rejects more than a of good documents", where a is alpha divided by the number of rules. A
candidate is safe when its p-value is at most delta divided by the number of all tests
(strata x rules x candidates, Bonferroni), so with probability 1 - delta the rules together
reject at most alpha of the good documents of every stratum. The lowest safe candidate is used; without one, the rule rejects nothing there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillon.session import store

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Candidate cutoffs, in per mille.
CANDIDATES = [10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900]
#: Score of each rule, an integer expression over the features.
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}
#: Share of a stratum's good documents that all rules together may reject, and the risk of exceeding it.
ALPHA, DELTA = 0.03, 0.05
#: Terms of the tail that are summed one by one; those beyond are bounded from above.
TAIL_TERMS = 20_000
#: A cutoff table of at most so many rows is broadcast, and so are the keys of at most so many rejected rows.
SMALL_TABLE, SMALL_KEYS = 10_000, 1_000_000


FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed
    (columns of these names are replaced); a null text counts as empty, one without words has
    no windows, and a text may be as long as a string can be.

    Three-word windows are equal when their 64-bit hashes are. The row's windows are sorted as
    integers, 32 bits of the hash over the 32-bit place; only those that agree with a neighbour
    on these 32 bits can be repeated, and among them (hash, place) pairs are sorted and compared
    in full, so no window stands between two equal ones.
    """
    names = [c for c in docs.columns if c not in FEATURES]
    t = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    out = out.withColumn("_w", F.regexp_extract_all(t, F.lit(WORD), F.lit(0)))
    out = out.withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumns(
        {
            "word_chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_h": F.expr("if(n_words < 3, cast(array() as array<bigint>), transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"),
        }
    )
    out = out.withColumn("_p", F.expr("sort_array(transform(_h, (h, i) -> (h & -4294967296L) | i))"))
    near = "shiftright(x ^ _p[{0}], 32) = 0"
    out = out.withColumn("_c", F.expr(f"filter(_p, (x, j) -> (j > 0 and {near.format('j - 1')}) or (j < size(_p) - 1 and {near.format('j + 1')}))"))
    out = out.withColumn("_s", F.expr("sort_array(transform(_c, x -> struct(_h[cast(x & 4294967295L as int)] as h, x & 4294967295L as i)))"))
    twin = "x.h = _s[{0}].h"
    out = out.withColumn("_d", F.expr(f"sort_array(transform(filter(_s, (x, j) -> (j > 0 and {twin.format('j - 1')}) or (j < size(_s) - 1 and {twin.format('j + 1')})), x -> x.i))"))
    out = out.withColumn("n_repeat_words", F.expr("aggregate(transform(_d, (x, j) -> if(j < size(_d) - 1, least(3L, _d[j + 1] - x), 3L)), 0L, (a, x) -> a + x)"))
    out = out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    return out.select("_row.*", *FEATURES)


def _ln_factorial(x: str) -> str:
    """Stirling's series at x + 8, brought back by a product; exact to about 1e-13."""
    z = f"(cast({x} as double) + 8)"
    back = " * ".join(f"({x} + {i})" for i in range(1, 9))
    return f"(({z} + 0.5) * ln({z}) - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5)) - ln(cast({back.replace(x, f'cast({x} as double)')} as double)))"


def binomial_tail(n: str, k: str, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n * p, from its largest term down; 1.0 for greater k.

    What lies beyond TAIL_TERMS terms is bounded by a geometric series, so the value is never
    too small.
    """
    top = f"exp({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')} + {k} * ln(double({p})) + ({n} - {k}) * ln(1 - double({p})))"
    down = f"aggregate(sequence(0L, least({k}, {TAIL_TERMS}L) - 1), named_struct('t', double(1), 's', double(1)), (a, i) -> named_struct('t', a.t * ({k} - i) / ({n} - {k} + i + 1) * double({(1 - p) / p}), 's', a.s + a.t * ({k} - i) / ({n} - {k} + i + 1) * double({(1 - p) / p})), a -> if({k} > {TAIL_TERMS}, a.s + a.t / (1 - {k} / ({n} - {k} + 1) * double({(1 - p) / p})), a.s))"
    return F.expr(f"case when {k} >= {n} * double({p}) then double(1) when {k} = 0 then {top} else least(double(1), {top} * {down}) end")


def choose_cutoffs(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, p_value) of each stratum and rule that has a safe cutoff.

    features: key, stratum and with_features()'s columns. labels: key and quality, of which
    1 means good; unlabelled documents, those with a null key or quality, and those that
    fail the base rule don't take part; a key labelled twice is good if one label says so.
    Scores are binned by the candidates they exceed before the shuffle, so every group is
    one row for each task. A null stratum is a stratum.
    """
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_labelled")).distinct()
    held = features.where(~F.col("base_failed")).join(good, F.col(key) == F.col("_labelled"), "left_semi")
    scores = F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(e).alias("score")) for r, e in RULES.items()])
    grid = F.array(*[F.lit(c) for c in CANDIDATES])
    binned = held.select(F.col(stratum).cast("string").alias("stratum"), F.explode(scores).alias("s")).select("stratum", "s.rule", F.size(F.filter(grid, lambda c: F.col("s.score") > c)).alias("bin"))
    counts = binned.groupBy("stratum", "rule", "bin").agg(F.count("*").alias("c"))
    totals = counts.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.collect_list(F.struct("bin", "c")).alias("bins"))
    tests = totals.groupBy().agg((F.count("*") * len(CANDIDATES)).alias("tests"))
    each = totals.select("stratum", "rule", "n", "bins", F.posexplode(grid).alias("at", "cutoff")).withColumn("k", F.expr("aggregate(bins, 0L, (a, b) -> a + if(b.bin > at, b.c, 0L))"))
    each = each.withColumn("p_value", binomial_tail("n", "k", alpha / len(RULES))).crossJoin(F.broadcast(tests))  # tests is one row
    safe = each.where(F.col("p_value") <= F.lit(delta) / F.col("tests"))
    return safe.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "n", "k", "p_value")).alias("b")).select("stratum", "rule", "b.*")


def with_verdict(features: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds rejected_by (array of rules) and kept (such columns are replaced); cutoffs must be a stored table."""
    names = [c for c in features.columns if c not in ("rejected_by", "kept")]
    wide = cutoffs.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in RULES])
    if cutoffs.count() <= SMALL_TABLE:
        wide = F.broadcast(wide)
    packed = features.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), *[c for c in FEATURES], F.col(f"`{stratum}`").cast("string").alias("_t"))
    out = packed.join(wide, F.col("_t").eqNullSafe(F.col("_s")), "left")
    hit = [F.when(F.expr(f"{e} > _c_{r}"), F.lit(r)) for r, e in RULES.items()]
    out = out.withColumn("rejected_by", F.array_compact(F.array(*hit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select("_row.*", "rejected_by", "kept")


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """One row for each row of docs: key, features, base_failed, rejected_by, kept.

    Features are computed once and stored, narrow; other columns are not returned. Empty
    documents give no rows, empty labels no cutoffs. Null, empty and wordless texts fail the
    base rule (fewer than 50 words); a null key is judged but never labelled. Repeated rows
    each get the same verdict; very long texts are read whole.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(stratum).cast("string").alias("_stratum"), F.col(text).alias("_text"))
    narrow = store(with_features(rows, "_text").select("_key", "_stratum", *FEATURES)).df
    cutoffs = store(choose_cutoffs(narrow, labels, "_key", "_stratum", **risk)).df
    return with_verdict(narrow, cutoffs, "_stratum").drop("_stratum").withColumnRenamed("_key", key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **risk) -> DataFrame:
    """The rows of docs that judge() keeps, all columns as they are.

    Features are computed once and stored, narrow, beside the row's key, stratum and a hash of
    its text, on which a verdict depends; the keys of rejected rows then take the rows out. They
    are broadcast if they are few, so texts aren't shuffled. Null, empty and wordless texts go,
    as do texts of fewer than 50 words; repeated rows go or stay together; an empty table stays
    empty.
    """
    of = lambda row: [F.col(f"{row}`{key}`").alias("_key"), F.col(f"{row}`{stratum}`").cast("string").alias("_stratum"), F.xxhash64(F.col(f"{row}`{text}`")).alias("_th")]
    rows = docs.select(*of(""), F.col(f"`{text}`").alias("_text"))
    narrow = store(with_features(rows, "_text").select("_key", "_stratum", "_th", *FEATURES)).df
    cutoffs = store(choose_cutoffs(narrow, labels, "_key", "_stratum", **risk)).df
    bad = store(with_verdict(narrow, cutoffs, "_stratum").where("not kept").select(F.col("_key").alias("_k"), F.col("_stratum").alias("_s"), F.col("_th").alias("_h")).distinct()).df
    if bad.count() <= SMALL_KEYS:
        bad = F.broadcast(bad)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")).select("_doc", *of("_doc."))
    same = (F.col("_th") == F.col("_h")) & F.col("_key").eqNullSafe(F.col("_k")) & F.col("_stratum").eqNullSafe(F.col("_s"))
    return packed.join(bad, same, "left_anti").select("_doc.*")
