"""Queries of the corpus-curation operators over the provided tables.

Splits, fingerprints and metric tables are derived from the tables as stated in each query;
doubles are rounded to six places in both engines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions import columns as C
from quillon.operators import dedup, joins, labelmaps, reports, sampling, scoring, similarity
from quillon.plans.registry import query, table
from quillon.sources import scans

SPLIT = "CASE WHEN doc_id % 20 = 0 THEN 'val' WHEN doc_id % 100 = 1 THEN 'test' ELSE 'train' END"
#: Normal form of a text: words of ASCII letters, digits and other characters, A-Z in lower case.
NORM = r"trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))"

BITS = """bits AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > list_sort(embedding[2:])[32] THEN 1 ELSE 0 END) AS b FROM embeddings)"""
_WORD = "CAST(list_sum(list_transform({0}, lambda x, i: CAST(x AS BIGINT) << (32 - i))) AS BIGINT)"
#: Fingerprints of the blocks, and of a variant of each that differs in vec_id % 9 bits.
PRINTS = (
    BITS
    + f""", twins AS (SELECT id, b FROM bits UNION ALL SELECT 1000000 + id, list_transform(b, lambda x, i: CASE WHEN (i * 7 + id * 13) % 64 < id % 9 THEN 1 - x ELSE x END) FROM bits),
prints AS (SELECT id, b, {_WORD.format("b[1:32]")} AS hi, {_WORD.format("b[33:64]")} AS lo FROM twins)"""
)
GAP = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
PAIRS = PRINTS + f""", pairs AS (SELECT * FROM (SELECT a.id AS a, b.id AS b, CAST({GAP} AS INT) AS d FROM prints a JOIN prints b ON a.id < b.id) WHERE d <= {{0}})"""
PRINT_SPLIT = "CASE WHEN (id % 1000000 + 7 * (id // 1000000)) % 20 = 0 THEN 'val' WHEN (id % 1000000 + 7 * (id // 1000000)) % 50 = 1 THEN 'bench' ELSE 'train' END"
RECORDS = f"""{PRINTS}, records AS (
  SELECT doc_id AS ord, {SPLIT} AS split, sha256(text) AS exact, sha256({NORM}) AS norm, CAST(NULL AS BIGINT) AS hi, CAST(NULL AS BIGINT) AS lo FROM documents
  UNION ALL SELECT 1000000000 + item_id, 'bench', sha256(text), sha256({NORM}), NULL, NULL FROM benchmark
  UNION ALL SELECT 2000000000 + id, {PRINT_SPLIT}, sha256('print:' || array_to_string(b, '')), sha256('print:' || array_to_string(b[1:62], '')),
    CASE WHEN id % 17 <> 5 THEN hi END, CASE WHEN id % 17 <> 5 THEN lo END FROM prints)"""
RADIUS = 4


def prints(spark, d) -> DataFrame:
    """id, 64-bit fingerprint and its bits as text: of the 8x8 coefficient blocks in embeddings, and of
    a variant of each (id + 1000000) that differs in vec_id % 9 bits."""
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), similarity.pack_bits(similarity.coefficient_bits(F.col("embedding"))).alias("h"))
    flips = F.expr("aggregate(sequence(1, 64), 0L, (a, i) -> shiftleft(a, 1) | if((i * 7 + id * 13) % 64 < id % 9, 1, 0))")
    both = h.union(h.select((F.col("id") + 1000000).alias("id"), F.col("h").bitwiseXOR(flips)))
    return both.withColumn("bits", F.lpad(F.bin("h"), 64, "0"))


def normal_form() -> Column:
    """Of the column text: words of ASCII letters, digits and other characters, A-Z in lower case."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def records(spark, d) -> DataFrame:
    """ord, split, exact, norm (hash of the whole text's normal form) and phash: documents and
    benchmark items, which have no fingerprint, and the fingerprints, one in 17 of them lost."""
    norm = F.sha2(normal_form(), 256).alias("norm")
    none = F.lit(None).cast("long").alias("phash")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.expr(SPLIT).alias("split"), F.sha2("text", 256).alias("exact"), norm, none)
    bench = table(spark, d, "benchmark").select((F.col("item_id") + 1000000000).alias("ord"), F.lit("bench").alias("split"), F.sha2("text", 256).alias("exact"), norm, none)
    drawn = prints(spark, d).select((F.col("id") + 2000000000).alias("ord"), F.expr(PRINT_SPLIT.replace("//", "div")).alias("split"), F.sha2(F.concat(F.lit("print:"), "bits"), 256).alias("exact"), F.sha2(F.concat(F.lit("print:"), F.substring("bits", 1, 62)), 256).alias("norm"), F.when(F.col("id") % 17 != 5, F.col("h")).alias("phash"))
    return docs.union(bench).union(drawn)


# --- dedup and leakage


@query(
    "u1_keep_first",
    """SELECT doc_id, sha256(text) AS exact FROM documents
       QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
)
def u1_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("exact"))
    return dedup.keep_first(docs, ["exact"], "doc_id")


@query("u1_group_sizes", "SELECT n AS group_size, count(*) AS n_groups FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text)) GROUP BY n")
def u1_group_sizes(spark, d):
    return dedup.group_sizes(table(spark, d, "documents").select(F.sha2("text", 256).alias("k")), ["k"])


_NEAR = f"EXISTS (SELECT 1 FROM records b WHERE b.split IN ({{0}}) AND {GAP} <= {RADIUS})"
_LEAK = "(exact IN (SELECT exact FROM records WHERE split IN ({0})) OR norm IN (SELECT norm FROM records WHERE split IN ({0})) OR " + _NEAR + ")"
#: (ord, cluster) of the rows of a table that have a fingerprint: single linkage, the least ord.
_CLUSTERS = f"""edges AS (SELECT a.ord AS a, b.ord AS b FROM {{0}} a JOIN {{0}} b ON a.ord <> b.ord AND {GAP} <= {RADIUS}),
reach AS (SELECT ord AS a, ord AS b FROM {{0}} WHERE hi IS NOT NULL UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
clusters AS (SELECT a AS ord, min(b) AS cluster FROM reach GROUP BY a)"""
GATE = f"""WITH RECURSIVE {RECORDS},
pool AS (SELECT *, {_LEAK.format("'bench'")} AS b, {_LEAK.format("'val', 'test'")} AS h FROM records a WHERE split = 'train'),
free AS (SELECT * FROM pool WHERE NOT b AND NOT h),
one AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY exact ORDER BY ord) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY norm ORDER BY ord) = 1),
{_CLUSTERS.format("two")},
three AS (SELECT ord FROM two WHERE ord NOT IN (SELECT ord FROM clusters WHERE ord > cluster)),
fates AS (SELECT ord, 'reference' AS fate FROM records WHERE split <> 'train'
  UNION ALL SELECT ord, CASE WHEN b THEN 'bench' ELSE 'held-out' END FROM pool WHERE b OR h
  UNION ALL SELECT ord, 'exact' FROM free WHERE ord NOT IN (SELECT ord FROM one)
  UNION ALL SELECT ord, 'norm' FROM one WHERE ord NOT IN (SELECT ord FROM two)
  UNION ALL SELECT ord, 'phash' FROM two WHERE ord NOT IN (SELECT ord FROM three)
  UNION ALL SELECT ord, 'kept' FROM three)"""


@query("u8_run_gate", GATE + " SELECT ord, fate FROM fates")
def u8_run_gate(spark, d):
    return similarity.layered_gate(records(spark, d), ["exact", "norm"], fingerprint="phash", radius=RADIUS).select("ord", "fate")


@query("u2_layer_report", GATE + " SELECT fate, count(*) AS n FROM fates GROUP BY fate")
def u2_layer_report(spark, d):
    return u8_run_gate(spark, d).groupBy("fate").agg(F.count("*").alias("n"))


_RATE = "round(count(*) FILTER (fate IN ({0})) / greatest(1, count(*) FILTER (fate <> 'reference')), 5) AS {1}"


@query("u10_report_rates", GATE + " SELECT " + ", ".join(_RATE.format(x, n) for x, n in (("'exact'", "exact_rate"), ("'norm'", "norm_rate"), ("'phash'", "phash_rate"), ("'exact', 'norm', 'phash'", "dedup_rate"), ("'bench', 'held-out'", "leak_rate"))) + " FROM fates")
def u10_report_rates(spark, d):
    return reports.gate_rates(u8_run_gate(spark, d))


@query("u6_u7_leakage_match", f"WITH {RECORDS} SELECT ord FROM records a WHERE split = 'train' AND {_LEAK.format(chr(39) + 'val' + chr(39))}")
def u6_u7_leakage_match(spark, d):
    r = records(spark, d)
    return similarity.leaked(r.where("split = 'train'"), r.where("split = 'val'"), ["exact", "norm"], fingerprint="phash", radius=RADIUS)


@query(
    "u9_split_census",
    f"""WITH RECURSIVE {RECORDS}, {_CLUSTERS.format("records")}, s AS (SELECT cluster, list_sort(list_distinct(list(split))) AS s FROM clusters JOIN records USING (ord) GROUP BY cluster)
    SELECT a, b, count(*) AS n FROM (SELECT unnest(s) AS a, s FROM s) t, unnest(t.s) AS u(b) WHERE a < b GROUP BY a, b""",
)
def u9_split_census(spark, d):
    r = records(spark, d)
    clusters = similarity.hamming_clusters(r, RADIUS, "ord", "phash").withColumnRenamed("id", "ord")
    return similarity.split_census(clusters.join(r.select("ord", "split"), "ord"))


@query("u9_cluster_sizes", f"WITH RECURSIVE {RECORDS}, {_CLUSTERS.format('records')} SELECT n AS cluster_size, count(*) AS n_clusters FROM (SELECT count(*) AS n FROM clusters GROUP BY cluster) GROUP BY n")
def u9_cluster_sizes(spark, d):
    return similarity.cluster_sizes(similarity.hamming_clusters(records(spark, d), RADIUS, "ord", "phash"))


@query("f6_fingerprint_bits", f"WITH {BITS} SELECT id, array_to_string(b, '') AS bits FROM bits")
def f6_fingerprint_bits(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.array_join(similarity.coefficient_bits(F.col("embedding")).cast("array<string>"), "").alias("bits"))


GRAY = "gray AS (SELECT vec_id AS id, i - 1 AS pos, least(greatest(embedding[i] * 128e0 + 128, 0e0), 255e0) AS v FROM embeddings, range(1, 65) t(i))"
#: Eight rows of the cosine transform, and from pixels (k, id, y, x, v) of 8x8 images their bits.
_DCT = f"""basis AS (SELECT u, x, sqrt(CASE WHEN u = 0 THEN 1e0 ELSE 2e0 END / 8) * cos(pi() * u * (2 * x + 1) / 16) AS m FROM range(0, 8) a(u), range(0, 8) b(x)),
half AS (SELECT k, id, u, p.x, sum(m * v) AS v FROM px p JOIN basis ON basis.x = p.y GROUP BY ALL),
coef AS (SELECT k, id, h.u * 8 + basis.u AS pos, round(sum(m * v), 6) AS v FROM half h JOIN basis ON basis.x = h.x GROUP BY ALL),
blocks AS (SELECT k, id, list(v ORDER BY pos) AS c FROM coef GROUP BY k, id),
hashes AS (SELECT k, id, b, {_WORD.format("b[1:32]")} AS hi, {_WORD.format("b[33:64]")} AS lo FROM (SELECT k, id, list_transform(c, lambda x: CASE WHEN x > list_sort(c[2:])[32] THEN 1 ELSE 0 END) AS b FROM blocks))"""


def grays(spark, d) -> DataFrame:
    """id and 8x8 grey images (0 to 255) from embeddings."""
    level = F.transform("embedding", lambda x: F.least(F.greatest(x.cast("double") * 128 + 128, F.lit(0.0)), F.lit(255.0)))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), level.alias("gray"))


def hashed(images: DataFrame) -> DataFrame:
    """images with h, the fingerprint of the cosine transform (coefficients to six places)."""
    blocks = similarity.coefficients(images).withColumn("block", F.transform("block", lambda x: F.round(x, 6)))
    return blocks.withColumn("h", similarity.pack_bits(similarity.coefficient_bits(F.col("block")))).drop("block")


@query("f6_cosine_fingerprint", f"WITH {GRAY}, px AS (SELECT 0 AS k, id, pos // 8 AS y, pos % 8 AS x, v FROM gray), {_DCT} SELECT id, array_to_string(b, '') AS bits FROM hashes")
def f6_cosine_fingerprint(spark, d):
    return hashed(grays(spark, d)).select("id", F.lpad(F.bin("h"), 64, "0").alias("bits"))


@query(
    "u11_hash_driver",
    f"""WITH {GRAY}, flat AS (SELECT id, pos, CASE WHEN id % 5 = 0 THEN 250 ELSE v END AS v FROM gray),
    px AS (SELECT 0 AS k, id, pos // 8 AS y, pos % 8 AS x, v FROM flat), {_DCT},
    g AS (SELECT id, stddev_pop(v) < 8 OR avg(CASE WHEN v < 250 THEN 1e0 ELSE 0e0 END) < 0.02 OR avg(CASE WHEN v < 250 THEN 1e0 ELSE 0e0 END) > 0.98 AS degenerate FROM flat GROUP BY id)
    SELECT g.id, g.id % 7 <> 3 AS render_ok, g.id % 7 <> 3 AND degenerate AS degenerate, CASE WHEN g.id % 7 <> 3 AND NOT degenerate THEN list_sum(b) END AS ones FROM g JOIN hashes USING (id)""",
)
def u11_hash_driver(spark, d):
    """Every fifth image is flat, every seventh couldn't be rendered; ones counts the bits of phash."""
    flat = grays(spark, d).withColumn("gray", F.when(F.col("id") % 5 == 0, F.transform("gray", lambda x: F.lit(250.0))).otherwise(F.col("gray")))
    rows = similarity.fingerprints(flat.withColumn("gray", F.when(F.col("id") % 7 != 3, F.col("gray"))))
    return rows.select("id", "render_ok", "degenerate", F.bit_count("phash").cast("long").alias("ones"))


@query("u3_hamming_band_join", f"WITH {PAIRS.format(6)} SELECT a, b, d FROM pairs")
def u3_hamming_band_join(spark, d):
    return similarity.band_pairs(prints(spark, d), 6)


@query(
    "u4_hamming_clusters",
    f"""WITH RECURSIVE {PAIRS.format(6)}, e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach AS (SELECT id AS a, id AS b FROM prints UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
    SELECT a AS id, min(b) AS cluster FROM reach GROUP BY a""",
)
def u4_hamming_clusters(spark, d):
    return similarity.hamming_clusters(prints(spark, d), 6)


@query("u7_contained_items", f"WITH d AS (SELECT doc_id, {NORM} AS t FROM documents), i AS (SELECT item_id, {NORM} AS t FROM benchmark) SELECT doc_id AS ord, item_id AS ref FROM d JOIN i ON i.t <> '' AND contains(' ' || d.t || ' ', ' ' || i.t || ' ')")
def u7_contained_items(spark, d):
    """Documents that contain a benchmark item whole."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), normal_form().alias("norm_text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("ord"), normal_form().alias("norm_text"))
    return similarity.containing(docs, items)


@query("u1_rank_in_group", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents")
def u1_rank_in_group(spark, d):
    return dedup.rank_in_group(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id").select("doc_id", F.col("rn").cast("long").alias("rn"))


@query("u12_throughput", "SELECT count(*) AS pool, round(count(*) / (129.0 + 192.0), 2) AS per_second, round(5000000 / (count(*) / (129.0 + 192.0)) / 3600, 2) AS hours_for_5m FROM documents")
def u12_throughput(spark, d):
    return reports.throughput(table(spark, d, "documents"), 129.0, 192.0)


# --- threshold calibration


#: Originals (k = 0), recolourings by 6, 12 and 20, and a resampling by half a pixel.
VARIANTS = f"""{GRAY}, px AS (SELECT k, g.id, g.pos // 8 AS y, g.pos % 8 AS x, CASE WHEN k < 4 THEN least(255e0, g.v + [0, 6, 12, 20][k + 1]) ELSE (g.v + n.v) / 2 END AS v
  FROM gray g JOIN gray n ON n.id = g.id AND n.pos = g.pos + CASE WHEN g.pos % 8 < 7 THEN 1 ELSE 0 END, range(0, 5) t(k)), {_DCT},
near AS (SELECT CASE WHEN b.k < 4 THEN 'recolour' ELSE 'resample' END AS kind, {GAP} AS d FROM hashes a JOIN hashes b ON a.k = 0 AND b.k > 0 AND a.id = b.id),
size AS (SELECT (SELECT count(*) FROM hashes WHERE k = 0) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM near GROUP BY kind)) AS m),
drawn AS (SELECT r, hi, lo, row_number() OVER (PARTITION BY r ORDER BY sha256(CAST(7 + r AS VARCHAR) || ':' || CAST(id AS VARCHAR))) AS pos FROM hashes, range(0, 4) t(r) WHERE k = 0),
far AS (SELECT 'distinct' AS kind, {GAP} AS d FROM drawn a JOIN drawn b ON a.r = b.r AND b.pos = a.pos + 1, size WHERE a.pos <= m - a.r * (n - 1)),
dist AS (SELECT * FROM near UNION ALL SELECT * FROM far)"""


def calibration_rows(spark, d) -> DataFrame:
    """(kind, d) of recolourings by 6, 12 and 20, resamplings by half a pixel, and random pairs."""
    images = grays(spark, d)
    lighter = lambda s: F.transform("gray", lambda x: F.least(F.lit(255.0), x + s))
    kinds = [("recolour", lighter(s)) for s in (6, 12, 20)]
    kinds.append(("resample", F.transform("gray", lambda x, i: (x + F.get("gray", i + F.when(i % 8 < 7, 1).otherwise(0))) / 2)))
    made = reduce(DataFrame.union, [images.select("id", F.lit(k).alias("kind"), v.alias("gray")) for k, v in kinds])
    return similarity.calibration_distances(hashed(images).select("id", "h"), hashed(made).select("id", "kind", "h"))


@query("c1_calibration_distances", f"WITH {VARIANTS} SELECT kind, CAST(d AS INT) AS d, count(*) AS n FROM dist GROUP BY ALL")
def c1_calibration_distances(spark, d):
    return calibration_rows(spark, d).groupBy("kind", "d").agg(F.count("*").alias("n"))


@query(
    "c2_distance_blocks",
    f"""WITH {VARIANTS} SELECT kind, CAST(min(d) AS INT) AS min_d, round(avg(d), 2) AS mean_d, CAST(max(d) AS INT) AS max_d, {", ".join(f"CAST(floor(quantile_cont(d, {p / 100})) AS INT) AS p{p}" for p in (50, 90, 95, 99))} FROM dist GROUP BY kind""",
)
def c2_distance_blocks(spark, d):
    return reports.distance_blocks(calibration_rows(spark, d))


@query("c3_suggested_threshold", f"WITH {VARIANTS} SELECT CAST(round_even((quantile_cont(d, 0.99) FILTER (kind = 'recolour') + quantile_cont(d, 0.01) FILTER (kind = 'distinct')) / 2, 0) AS INT) AS threshold FROM dist")
def c3_suggested_threshold(spark, d):
    return similarity.suggested_threshold(calibration_rows(spark, d), "recolour")


# --- detector: features are text measures of labelled documents

LABELLED = "rows AS (SELECT d.doc_id, quality AS y, n_chars AS f1, length(replace(text, ' ', '')) AS f2, length(text) - length(replace(text, chr(10), '')) AS f3 FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"
SCORED = LABELLED + ", scored AS (SELECT doc_id, y, round(1 / (1 + exp(-(0.5 - 0.0002 * f1 + 0.05 * f3))), 6) AS p FROM rows)"


def labelled(spark, d) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").alias("f1"), F.length(F.replace("text", F.lit(" "), F.lit(""))).alias("f2"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("f3"))


def scored(spark, d) -> DataFrame:
    return labelled(spark, d).select("doc_id", "y", F.round(scoring.logistic(["f1", "f3"], [-0.0002, 0.05], 0.5), 6).alias("p"))


@query("a3_standardize", f"WITH {LABELLED}, s AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM rows) SELECT doc_id, round((f1 - m1) / CASE WHEN s1 < 1e-9 THEN 1 ELSE s1 END, 6) AS z_f1, round((f3 - m3) / CASE WHEN s3 < 1e-9 THEN 1 ELSE s3 END, 6) AS z_f3 FROM rows, s")
def a3_standardize(spark, d):
    return scoring.standardize(labelled(spark, d), ["f1", "f3"]).select("doc_id", F.round("z_f1", 6).alias("z_f1"), F.round("z_f3", 6).alias("z_f3"))


@query("a5_logistic_score", f"WITH {SCORED} SELECT doc_id, p FROM scored")
def a5_logistic_score(spark, d):
    return scored(spark, d).select("doc_id", "p")


@query(
    "a6_roc_auc",
    f"""WITH {SCORED} SELECT round(sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) / count(*), 6) AS auc
    FROM scored a JOIN scored b ON a.y = 1 AND b.y = 0""",
)
def a6_roc_auc(spark, d):
    return scoring.roc_auc(scored(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(
    "a7_cohens_d",
    f"""WITH {LABELLED}, u AS (SELECT y, 'f1' AS feature, f1 AS v FROM rows UNION ALL SELECT y, 'f2', f2 FROM rows UNION ALL SELECT y, 'f3', f3 FROM rows),
    g AS (SELECT feature, avg(v) FILTER (y = 0) AS m0, avg(v) FILTER (y = 1) AS m1, var_pop(v) FILTER (y = 0) AS s0, var_pop(v) FILTER (y = 1) AS s1 FROM u GROUP BY feature)
    SELECT feature, round(abs(m0 - m1) / CASE WHEN sqrt((s0 + s1) / 2) = 0 THEN 1e-9 ELSE sqrt((s0 + s1) / 2) END, 6) AS d FROM g""",
)
def a7_cohens_d(spark, d):
    return scoring.cohens_d(labelled(spark, d), ["f1", "f2", "f3"]).select("feature", F.round("d", 6).alias("d"))


@query(
    "a8_threshold_sweep",
    f"""WITH {SCORED}, t AS (SELECT DISTINCT p AS t FROM scored), c AS (SELECT t, (SELECT count(*) FROM scored WHERE y = 0 AND p < t) AS kept, (SELECT count(*) FROM scored WHERE y = 1 AND p < t) AS bad FROM t),
    n AS (SELECT count(*) AS pos FROM scored WHERE y = 1)
    SELECT t AS threshold, kept FROM c, n WHERE bad / greatest(pos, 1) <= 0.2 ORDER BY kept DESC, t LIMIT 1""",
)
def a8_threshold_sweep(spark, d):
    return scoring.poison_threshold(scored(spark, d), most=0.2)


@query("a9_group_split", "SELECT source, doc_id, percent < 0.7 AS is_train FROM documents JOIN (SELECT source AS s, percent_rank() OVER (ORDER BY sha256('13:' || source)) AS percent FROM (SELECT DISTINCT source FROM documents)) ON s = source")
def a9_group_split(spark, d):
    return sampling.group_split(table(spark, d, "documents").select("source", "doc_id"), "source", 0.7, 13)


@query("a10_reject_rule", f"WITH {SCORED} SELECT p >= 0.39555 AS traced, count(*) AS n FROM scored GROUP BY 1")
def a10_reject_rule(spark, d):
    return scored(spark, d).groupBy((F.col("p") >= 0.39555).alias("traced")).agg(F.count("*").alias("n"))


_P = "1 / (1 + exp(-(w1 * x1 + w3 * x3 + b)))"
#: Newton's method on the mean log loss with 0.001 / 2 of the squared weights; the 3x3 system by determinants.
FITTED = f"""WITH RECURSIVE {LABELLED}, s AS (SELECT avg(f1) AS m1, stddev_pop(f1) AS s1, avg(f3) AS m3, stddev_pop(f3) AS s3 FROM rows),
z AS (SELECT y, (f1 - m1) / CASE WHEN s1 < 1e-9 THEN 1 ELSE s1 END AS x1, (f3 - m3) / CASE WHEN s3 < 1e-9 THEN 1 ELSE s3 END AS x3 FROM rows, s),
it AS (SELECT 0 AS n, 0e0 AS w1, 0e0 AS w3, 0e0 AS b UNION ALL SELECT n + 1, w1 - (g1 * (c * f - e * e) - d * (g3 * f - e * g0) + h * (g3 * e - c * g0)) / det, w3 - (a * (g3 * f - e * g0) - g1 * (d * f - e * h) + h * (d * g0 - g3 * h)) / det,
  b - (a * (c * g0 - g3 * e) - d * (d * g0 - g3 * h) + g1 * (d * e - c * h)) / det
  FROM (SELECT *, a * (c * f - e * e) - d * (d * f - e * h) + h * (d * e - c * h) AS det FROM (SELECT n, w1, w3, b, avg((p - y) * x1) + 0.001e0 * w1 AS g1, avg((p - y) * x3) + 0.001e0 * w3 AS g3, avg(p - y) AS g0,
    avg(p * (1 - p) * x1 * x1) + 0.001e0 AS a, avg(p * (1 - p) * x3 * x3) + 0.001e0 AS c, avg(p * (1 - p)) AS f, avg(p * (1 - p) * x1 * x3) AS d, avg(p * (1 - p) * x3) AS e, avg(p * (1 - p) * x1) AS h
    FROM (SELECT it.*, y, x1, x3, {_P} AS p FROM it, z WHERE n < 12) GROUP BY n, w1, w3, b)))"""


@query("a4_fit_logistic", FITTED + " SELECT unnest(['f1', 'f3', 'bias']) AS name, unnest([round(w1, 3), round(w3, 3), round(b, 3)]) AS weight FROM it WHERE n = 12")
def a4_fit_logistic(spark, d):
    rows = scoring.standardize(labelled(spark, d), ["f1", "f3"])
    model = scoring.fit_logistic(rows, ["z_f1", "z_f3"])
    return spark.createDataFrame([(n, round(float(w), 3) + 0.0) for n, w in zip(("f1", "f3", "bias"), (*model.coefficients, model.intercept))], "name string, weight double")


# --- joins, exclusion, sampling


@query("j1_split_lookup", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'train' WHEN l.quality = 0 THEN 'val' END, 'corpus') AS split FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def j1_split_lookup(spark, d):
    known = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").when(F.col("quality") == 0, "val").alias("split"))
    return joins.looked_up(table(spark, d, "documents").select("doc_id"), known, "doc_id", "split", F.lit("corpus"))


@query("j2_wanted_rows", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def j2_wanted_rows(spark, d):
    return joins.only(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 0"), "doc_id")


OFF = f"(SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE {SPLIT} <> 'train')"


def pool(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr(SPLIT).alias("split"))
    return sampling.exclude(docs, "doc_id", table(spark, d, "labels").select("doc_id"), docs.where("split <> 'train'").select("doc_id"))


@query("j3_exclusion", f"SELECT doc_id FROM documents WHERE doc_id NOT IN {OFF}")
def j3_exclusion(spark, d):
    return pool(spark, d).select("doc_id")


@query("p1_hash_sample", f"SELECT doc_id, sha256('1000:' || doc_id) AS draw FROM documents WHERE doc_id NOT IN {OFF} ORDER BY draw LIMIT 50")
def p1_hash_sample(spark, d):
    return sampling.sample(pool(spark, d).select("doc_id"), "doc_id", 50, 1000)


@query("p2_shard_slice", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY draw) - 1 AS rn FROM (SELECT doc_id, sha256('1000:' || doc_id) AS draw FROM documents WHERE doc_id NOT IN {OFF} ORDER BY draw LIMIT 50)) WHERE rn >= 13 AND rn < 26")
def p2_shard_slice(spark, d):
    return sampling.shard_slice(p1_hash_sample(spark, d), 1, 4).select("doc_id")


@query("p3_gallery_sample", "SELECT page_id FROM pages ORDER BY sha256('42:' || page_id) LIMIT 40")
def p3_gallery_sample(spark, d):
    return sampling.sample(table(spark, d, "pages").select("page_id"), "page_id", 40, 42).select("page_id")


@query("p5_train_val", "SELECT item_id, CASE WHEN row_number() OVER (ORDER BY item_id DESC) <= 10 THEN 'val' ELSE 'train' END AS part FROM benchmark")
def p5_train_val(spark, d):
    return sampling.last_n_as_validation(table(spark, d, "benchmark").select("item_id"), "item_id", 10).select("item_id", "part")


@query("p6_first_n", "SELECT c_name FROM customer ORDER BY c_name LIMIT 25")
def p6_first_n(spark, d):
    return table(spark, d, "customer").select("c_name").orderBy("c_name").limit(25)


@query("j6_flagged_exclusion", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)")
def j6_flagged_exclusion(spark, d):
    return joins.without(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").where("l_discount > 0.05"), "o_orderkey", "l_orderkey")


@query("j7_variant_files", "SELECT o_orderkey, v FROM orders, range(0, 3) t(v) WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = v + 1)")
def j7_variant_files(spark, d):
    files = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).cast("long").alias("v"))
    return joins.existing_variants(table(spark, d, "orders"), files, "o_orderkey", 3)


@query("j8_plan_defaults", "SELECT n_name, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END, d.batch, 8) AS batch, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN 0.001 END, d.lr, 0.0003) AS lr FROM nation, (SELECT max(r_regionkey) AS batch, CAST(NULL AS DOUBLE) AS lr FROM region) d")
def j8_plan_defaults(spark, d):
    defaults = table(spark, d, "region").agg(F.max("r_regionkey").alias("batch"), F.lit(None).cast("double").alias("lr"))
    runs = table(spark, d, "nation").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey")).alias("batch"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(0.001)).alias("lr"))
    return joins.with_defaults(runs, defaults, {"batch": 8, "lr": 0.0003})


@query("j9_finished_runs", "SELECT DISTINCT user_id, day FROM (SELECT user_id, CAST(date_part('day', ts) AS INT) AS day, event_type FROM events) e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND date_part('day', f.ts) = e.day AND f.event_type = 'purchase')")
def j9_finished_runs(spark, d):
    """A run is a user's day; a purchase finishes it."""
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").alias("day"), "event_type")
    return joins.unfinished(e, ["user_id", "day"], F.col("event_type") == "purchase")


@query("j10_first_id_wins", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem LEFT JOIN (SELECT p_size, min_by(p_name, p_partkey) AS p_name FROM part GROUP BY p_size) ON p_size = l_quantity")
def j10_first_id_wins(spark, d):
    first = joins.first_wins(table(spark, d, "part"), "p_size", "p_name", "p_partkey").withColumnRenamed("p_size", "l_quantity")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.looked_up(li, first, "l_quantity", "p_name").drop("l_quantity")


PIXELS = "px AS (SELECT vec_id, i - 1 AS i, CAST(floor(least(greatest(embedding[i] * 128 + 128, 0), 255)) AS INT) AS r, CAST(floor(least(greatest(embedding[65 - i] * 128 + 128, 0), 255)) AS INT) AS g, CAST((vec_id * 7 + i) % 256 AS INT) AS b FROM embeddings, range(1, 65) t(i))"


def pixels(spark, d) -> DataFrame:
    """A pixel table: 8x8 blocks of embeddings as colours."""
    # in single precision as in the SQL; beside an integer Spark would take doubles.
    # An element that a short embedding lacks is level 0, as there
    scale = F.lit(128).cast("float")
    level = lambda i: F.floor(F.least(F.greatest(F.try_element_at("embedding", i) * scale + scale, F.lit(0)), F.lit(255))).cast("int")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(64))).alias("n"))
    return e.select("vec_id", (F.col("n") - 1).cast("long").alias("i"), level(F.col("n")).alias("r"), level(65 - F.col("n")).alias("g"), ((F.col("vec_id") * 7 + F.col("n")) % 256).cast("int").alias("b"))


@query("j11_nearest_colour", f"WITH {PIXELS} SELECT vec_id, i, CAST(arg_min(k, (r - 255 * (k % 2)) ** 2 + (g - 255 * (k // 2 % 2)) ** 2 + (b - 255 * (k // 4)) ** 2) AS INT) AS label FROM (SELECT * FROM px, range(0, 8) t(k) ORDER BY vec_id, i, k) GROUP BY vec_id, i")
def j11_nearest_colour(spark, d):
    palette = [(255 * (k % 2), 255 * (k // 2 % 2), 255 * (k // 4)) for k in range(8)]
    return pixels(spark, d).select("vec_id", "i", C.nearest_colour(palette).alias("label"))


# --- scalar functions


@query("f1_exact_hash", "SELECT doc_id, sha256(text) AS exact FROM documents")
def f1_exact_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", C.exact_hash("text").alias("exact"))


@query("f9_f19_luma_background", f"WITH {PIXELS} SELECT vec_id, i, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6) AS luma, (r >= 249 AND g >= 249 AND b >= 249) AS is_background FROM px")
def f9_f19_luma_background(spark, d):
    return pixels(spark, d).select("vec_id", "i", F.round(C.luma("r", "g", "b"), 6).alias("luma"), C.is_background("r", "g", "b").alias("is_background"))


@query("f7_degenerate", f"WITH {PIXELS} SELECT vec_id, stddev_pop(r) < 8 OR avg(CASE WHEN r < 250 THEN 1.0 ELSE 0 END) < 0.02 OR avg(CASE WHEN r < 250 THEN 1.0 ELSE 0 END) > 0.98 AS degenerate FROM px GROUP BY vec_id")
def f7_degenerate(spark, d):
    return pixels(spark, d).groupBy("vec_id").agg(C.flat_pixels("r").alias("degenerate"))


@query("f11_decimals", "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN contains(lower(t), 'e') THEN 6 WHEN contains(t, '.') THEN length(t) - strpos(t, '.') ELSE 0 END AS INTEGER) AS decimals FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) || CASE WHEN l_linenumber % 3 = 0 THEN '' WHEN l_linenumber % 3 = 1 THEN '.25' ELSE 'e3' END AS t FROM lineitem)")
def f11_decimals(spark, d):
    tail = F.when(F.col("l_linenumber") % 3 == 0, "").when(F.col("l_linenumber") % 3 == 1, ".25").otherwise("e3")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.col("l_quantity").cast("int").cast("string"), tail).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", C.decimals("t").alias("decimals"))


@query("f12_population_stats", "SELECT l_returnflag, round(avg(l_tax), 6) AS mean, round(coalesce(stddev_pop(l_tax), 0), 6) AS sd FROM lineitem GROUP BY l_returnflag")
def f12_population_stats(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg("l_tax"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("l_tax"), F.lit(0.0)), 6).alias("sd"))


@query("f13_palette_lut", f"WITH {PIXELS} SELECT vec_id, i, least(CASE WHEN i = 0 THEN 0 ELSE row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN i = 0 THEN 0 ELSE 1 END, round(0.299e0 * r + 0.587e0 * g + 0.114e0 * b, 6), r, g, b, i) - 1 END, 23) AS slot FROM px")
def f13_palette_lut(spark, d):
    return C.palette_slots(pixels(spark, d), "vec_id", "i", 24)


@query("f14_palette_bucket", "SELECT p_partkey, CASE WHEN p_size % 12 <= 2 THEN '1-2' WHEN p_size % 12 <= 4 THEN '3-4' WHEN p_size % 12 <= 9 THEN '5-9' ELSE '10+' END AS bucket FROM part")
def f14_palette_bucket(spark, d):
    return table(spark, d, "part").select("p_partkey", C.palette_bucket(F.col("p_size") % 12).alias("bucket"))


@query("f15_recipe_text", "SELECT l_orderkey, string_agg(l_returnflag || '(' || printf('%.2f', l_discount) || ')', ' + ' ORDER BY l_linenumber, l_returnflag, l_discount) AS recipe FROM lineitem GROUP BY l_orderkey")
def f15_recipe_text(spark, d):
    steps = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_returnflag").alias("op"), F.col("l_discount").alias("severity"))))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(C.recipe_text(steps).alias("recipe"))


LAB = """lin AS (SELECT vec_id, i, {c} FROM px)"""
_LIN = ", ".join(f"CASE WHEN {k} / 255.0 <= 0.04045 THEN {k} / 255.0 / 12.92 ELSE pow(({k} / 255.0 + 0.055) / 1.055, 2.4) END AS {k}" for k in "rgb")
_F = "CASE WHEN {0} > 0.008856451679035631 THEN cbrt({0}) ELSE ({0} * 903.2962962962963 + 16) / 116 END"
_XYZ = {"fx": "(0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047", "fy": "(0.2126729 * r + 0.7151522 * g + 0.072175 * b)", "fz": "(0.0193339 * r + 0.119192 * g + 0.9503041 * b) / 1.08883"}


@query("f16_lab", f"WITH {PIXELS}, {LAB.format(c=_LIN)}, f AS (SELECT vec_id, i, {', '.join(_F.format(v) + ' AS ' + k for k, v in _XYZ.items())} FROM lin) SELECT vec_id, round(avg(116 * fy - 16), 3) AS l, round(avg(500 * (fx - fy)), 3) AS a, round(avg(200 * (fy - fz)), 3) AS b FROM f GROUP BY vec_id")
def f16_lab(spark, d):
    lab = C.srgb_to_lab("r", "g", "b")
    return pixels(spark, d).select("vec_id", lab.alias("c")).groupBy("vec_id").agg(*[F.round(F.avg(f"c.{k}"), 3).alias(k) for k in "lab"])


@query("f16_delta_e", f"WITH {PIXELS}, {LAB.format(c=_LIN)}, f AS (SELECT vec_id, i, {', '.join(_F.format(v) + ' AS ' + k for k, v in _XYZ.items())} FROM lin), l AS (SELECT vec_id, i, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM f), e AS (SELECT x.vec_id, sqrt((x.l - y.l) ** 2 + (x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS e FROM l x JOIN l y ON y.vec_id = x.vec_id + 1 AND y.i = x.i) SELECT vec_id, round(avg(e), 3) AS mean, round(quantile_cont(e, 0.99), 3) AS p99 FROM e GROUP BY vec_id")
def f16_delta_e(spark, d):
    lab = pixels(spark, d).select("vec_id", "i", C.srgb_to_lab("r", "g", "b").alias("c"))
    other = lab.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("c").alias("o"))
    return lab.join(other, ["vec_id", "i"]).select("vec_id", C.delta_e("c", "o").alias("e")).groupBy("vec_id").agg(F.round(F.avg("e"), 3).alias("mean"), F.round(F.percentile("e", F.lit(0.99)), 3).alias("p99"))


@query("f18_composite", f"WITH {PIXELS} SELECT vec_id, i, round(r * 0.4e0 + 255 * 0.6e0, 6) AS over_r, round(g * 0.4e0 + b * 0.6e0, 6) AS over_g FROM px")
def f18_composite(spark, d):
    return pixels(spark, d).select("vec_id", "i", F.round(C.over(F.col("r"), F.lit(255), 0.4), 6).alias("over_r"), F.round(C.over(F.col("g"), F.col("b"), 0.4), 6).alias("over_g"))


#: The checksum's table by its rule, then byte by byte over each name.
CRC = """WITH RECURSIVE bit AS (SELECT CAST(n AS BIGINT) AS n, 0 AS k, CAST(n AS BIGINT) AS c FROM range(0, 256) t(n) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
crc_table AS (SELECT n, c FROM bit WHERE k = 8),
run AS (SELECT c_custkey, c_name, 0 AS i, 4294967295 AS c FROM customer UNION ALL SELECT c_custkey, c_name, i + 1, xor(run.c >> 8, t.c) FROM run JOIN crc_table t ON t.n = xor(run.c, ascii(substr(c_name, i + 1, 1))) & 255 WHERE i < length(c_name))"""


@query("f21_item_seed", CRC + " SELECT c_custkey, (xor(c, 4294967295) + 1000) & 2147483647 AS seed FROM run WHERE i = length(c_name)")
def f21_item_seed(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.item_seed("c_name", 1000).alias("seed"))


@query("f22_f23_seeds_and_rates", "SELECT c_custkey, c_custkey * 100003 + 3 AS variant_seed, c_custkey * 7919 + 17 AS bg_seed, round(0.0003 * sqrt((c_custkey % 32 + 1) / 8.0), 9) AS lr FROM customer")
def f22_f23_seeds_and_rates(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.variant_seed("c_custkey", 3).alias("variant_seed"), C.background_seed("c_custkey").alias("bg_seed"), F.round(C.scaled_rate(F.col("c_custkey") % 32 + 1), 9).alias("lr"))


# --- reports


@query("r1_flag_counts", "SELECT flag, count(*) AS n FROM (SELECT unnest(['R:' || l_returnflag, 'W:' || l_linestatus]) AS flag FROM lineitem) GROUP BY flag")
def r1_flag_counts(spark, d):
    flags = table(spark, d, "lineitem").select(F.array("l_returnflag").alias("reject"), F.array("l_linestatus").alias("warn"))
    return reports.flag_counts(flags)


@query("r2_shard_by_tier", "SELECT o_orderpriority AS shard, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY 1")
def r2_shard_by_tier(spark, d):
    return reports.by_tier(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("r3_audit_summary", "SELECT count(*) AS total, count(l_discount) AS scored, count(*) FILTER (l_discount > 0.05 OR l_tax > 0.06) AS flagged, count(*) FILTER (l_discount > 0.05) AS n_discount, count(*) FILTER (l_tax > 0.06) AS n_tax FROM lineitem")
def r3_audit_summary(spark, d):
    return reports.audit_summary(table(spark, d, "lineitem"), "l_discount", {"discount": "l_discount > 0.05", "tax": "l_tax > 0.06"})


@query("r4_worst_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY coalesce(l_extendedprice, 0) DESC, l_orderkey, l_linenumber LIMIT 25")
def r4_worst_k(spark, d):
    return reports.worst(table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("r5_finalize", "SELECT CASE WHEN p_size < 5 THEN 'partial' WHEN p_retailprice < 1000 THEN 'blank' WHEN p_size > 45 THEN 'bad-key' ELSE 'usable' END AS state, count(*) AS n FROM part GROUP BY 1")
def r5_finalize(spark, d):
    state = joins.state_of({"partial": F.col("p_size") < 5, "blank": F.col("p_retailprice") < 1000, "bad-key": F.col("p_size") > 45}, "usable")
    return table(spark, d, "part").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("r6_palette_histogram", "SELECT CASE WHEN p_size % 12 <= 2 THEN '1-2' WHEN p_size % 12 <= 4 THEN '3-4' WHEN p_size % 12 <= 9 THEN '5-9' ELSE '10+' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def r6_palette_histogram(spark, d):
    return f14_palette_bucket(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query("r7_calibration_summary", "SELECT l_returnflag AS family, feature, count(v) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90 FROM (SELECT l_returnflag, 'quantity' AS feature, l_quantity AS v FROM lineitem UNION ALL SELECT l_returnflag, 'price', l_extendedprice FROM lineitem) GROUP BY 1, 2")
def r7_calibration_summary(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_returnflag").alias("family"), F.explode(F.create_map(F.lit("quantity"), F.col("l_quantity").cast("double"), F.lit("price"), F.col("l_extendedprice").cast("double"))).alias("feature", "v"))
    return reports.calibration(rows)


@query("r8_eval_aggregates", "SELECT event_type AS variant, count(*) FILTER (event_id % 10 <> 0) AS n, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS mean FROM events GROUP BY 1")
def r8_eval_aggregates(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("variant"), "value", F.when(F.col("event_id") % 10 == 0, "failed").alias("error"))
    return reports.eval_means(e, "variant", "value")


@query("r9_bench_speedup", "WITH g AS (SELECT event_type AS config, max(value) AS best FROM events GROUP BY 1) SELECT config, round(best, 6) AS best, round(best / (SELECT best FROM g WHERE config = 'click'), 6) AS speedup FROM g")
def r9_bench_speedup(spark, d):
    return reports.speedups(table(spark, d, "events").select(F.col("event_type").alias("config"), "value"), "click")


@query("r10_mode_per_block", f"WITH {PIXELS}, c AS (SELECT vec_id, r // 64 AS label, count(*) AS n FROM px GROUP BY 1, 2) SELECT vec_id, arg_max(label, n * 1000 - label) AS label FROM c GROUP BY vec_id")
def r10_mode_per_block(spark, d):
    return reports.mode(pixels(spark, d).select("vec_id", F.floor(F.col("r") / 64).cast("int").alias("label")), "vec_id", "label")


@query("r11_median_colour", f"WITH {PIXELS} SELECT vec_id, median(r) AS r, median(g) AS g, median(b) AS b FROM px GROUP BY vec_id")
def r11_median_colour(spark, d):
    return pixels(spark, d).groupBy("vec_id").agg(*[F.percentile(k, F.lit(0.5)).alias(k) for k in "rgb"])


@query("r12_colour_histogram", f"WITH {PIXELS} SELECT r // 32 AS r32, g // 32 AS g32, b // 32 AS b32, count(*) AS n FROM px GROUP BY 1, 2, 3")
def r12_colour_histogram(spark, d):
    return reports.colour_histogram(pixels(spark, d), 32)


@query(
    "r13_boundary_f1",
    f"""WITH {PIXELS}, g AS (SELECT vec_id, i, r > 128 AS t, r > 120 AS p FROM px),
    e AS (SELECT a.vec_id, a.i, max(CASE WHEN a.t <> b.t THEN 1 ELSE 0 END) AS tb, max(CASE WHEN a.p <> b.p THEN 1 ELSE 0 END) AS pb
      FROM g a JOIN g b ON b.vec_id = a.vec_id AND ((b.i = a.i + 1 AND a.i % 8 < 7) OR b.i = a.i + 8) GROUP BY 1, 2)
    SELECT vec_id, CAST(sum(tb * pb) AS BIGINT) AS hit, CAST(sum(tb) AS BIGINT) AS true_edges, CAST(sum(pb) AS BIGINT) AS found_edges FROM e GROUP BY vec_id""",
)
def r13_boundary_f1(spark, d):
    return reports.boundary_parts(pixels(spark, d).select("vec_id", "i", (F.col("r") > 128).alias("t"), (F.col("r") > 120).alias("p")), 8)


@query("r14_leaderboard", "SELECT user_id, min(epoch) AS epoch, round(min(value), 6) AS best FROM (SELECT user_id, event_id AS epoch, value, min(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value = m GROUP BY user_id")
def r14_leaderboard(spark, d):
    return reports.leaderboard(table(spark, d, "events").select("user_id", F.col("event_id").alias("epoch"), "value"))


# --- pixel tables, labels, QC


@query("l4_region_ids", f"WITH {PIXELS} SELECT vec_id, i, CASE WHEN k = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY vec_id ORDER BY k) - CASE WHEN z THEN 1 ELSE 0 END END AS region FROM (SELECT vec_id, i, k, bool_or(k = 0) OVER (PARTITION BY vec_id) AS z FROM (SELECT vec_id, i, (g // 128) * 65536 + (r // 64) AS k FROM px))")
def l4_region_ids(spark, d):
    key = F.shiftleft(F.floor(F.col("g") / 128).cast("long"), 16).bitwiseOR(F.floor(F.col("r") / 64).cast("long"))
    return reports.region_ids(pixels(spark, d).withColumn("k", key), "vec_id", "k").select("vec_id", "i", "region")


GRID = "grid AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, r // 64 AS label, r, g, b FROM px)"


def grid(spark, d) -> DataFrame:
    """pixels by row and column, labelled by the red level."""
    return pixels(spark, d).select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), F.floor(F.col("r") / 64).cast("int").alias("label"), "r", "g", "b")


@query(
    "l6_label_downsample",
    f"""WITH {PIXELS}, {GRID}, n AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, label, count(*) AS n FROM grid GROUP BY ALL),
    v AS (SELECT vec_id, y, x, arg_max(label, n * 10 - label) AS a, arg_max(label, n * 10 - label) FILTER (label <> 0) AS o FROM n GROUP BY ALL),
    c AS (SELECT v.vec_id, v.y, v.x, g.b >= 96 AS ink, CASE WHEN a = 0 AND g.b >= 96 THEN coalesce(o, 0) ELSE a END AS label FROM v JOIN grid g ON g.vec_id = v.vec_id AND g.y = 2 * v.y AND g.x = 2 * v.x),
    r AS (SELECT p.vec_id, p.y, p.x, arg_min(q.label, ((q.y - p.y) ** 2 + (q.x - p.x) ** 2) * 100 + (q.y - p.y) * 10 + q.x - p.x) AS found FROM c p JOIN c q ON q.vec_id = p.vec_id AND q.label <> 0 AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2
      WHERE p.label = 0 AND p.ink GROUP BY ALL)
    SELECT c.vec_id, c.y, c.x, CAST(coalesce(found, label) AS INT) AS label FROM c LEFT JOIN r ON r.vec_id = c.vec_id AND r.y = c.y AND r.x = c.x""",
)
def l6_label_downsample(spark, d):
    fine = grid(spark, d)
    ink = fine.where("y % 2 = 0 and x % 2 = 0").select("vec_id", F.expr("y div 2").alias("y"), F.expr("x div 2").alias("x"), (F.col("b") >= 96).alias("ink"))
    return labelmaps.shrink(fine, ink, 2)


@query(
    "l7_settled_palette",
    f"""WITH {PIXELS}, {GRID}, e AS (SELECT *, coalesce(lag(label) OVER h = label AND lead(label) OVER h = label AND lag(label) OVER v = label AND lead(label) OVER v = label, false) AS inner_ FROM grid
      WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), v AS (PARTITION BY vec_id, x ORDER BY y)),
    p AS (SELECT vec_id, label, {", ".join(f"CAST(round_even(coalesce(median({k}) FILTER (inner_), median({k})), 0) AS INT) AS {k}" for k in "rgb")}, count(*) AS n FROM e WHERE label <> 0 GROUP BY ALL)
    SELECT vec_id, CAST(label AS INT) AS label, CAST(CASE WHEN least(r, g, b) < 249 THEN sum(CASE WHEN least(r, g, b) < 249 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY label) ELSE 0 END AS INT) AS number, r, g, b, n FROM p""",
)
def l7_settled_palette(spark, d):
    return labelmaps.settled(grid(spark, d))


@query("l9_ink_mask", f"WITH {PIXELS} SELECT vec_id, count(*) FILTER (abs(r - 255) > 6 OR abs(g - 255) > 6 OR abs(b - 255) > 6) AS ink FROM px GROUP BY vec_id")
def l9_ink_mask(spark, d):
    return pixels(spark, d).groupBy("vec_id").agg(F.count_if(C.is_ink("r", "g", "b")).alias("ink"))


@query(
    "l10_audit_flags",
    f"""WITH {PIXELS}, m AS (SELECT vec_id, avg(CASE WHEN r < 249 OR g < 249 OR b < 249 THEN 1.0 ELSE 0 END) AS ink, avg(CASE WHEN r // 64 > 0 THEN 1.0 ELSE 0 END) AS lab, avg(abs(r - g)) AS mae, count(DISTINCT r // 64) AS used FROM px GROUP BY vec_id)
    SELECT vec_id, round(ink, 5) AS ink_frac, round(lab, 5) AS label_nonzero_frac, round(abs(ink - lab), 5) AS coverage_delta, round(mae, 4) AS reconstruction_mae,
      array_to_string(list_filter([CASE WHEN ink < 0.001 THEN 'blank' END, CASE WHEN ink >= 0.001 AND lab = 0 THEN 'labels-empty' END, CASE WHEN ink >= 0.001 AND abs(ink - lab) > 0.05 THEN 'coverage-mismatch' END,
      CASE WHEN mae > 40 THEN 'high-reconstruction' END, CASE WHEN used < 4 THEN 'palette-mismatch' END], lambda x: x IS NOT NULL), ',') AS flags FROM m""",
)
def l10_audit_flags(spark, d):
    px = pixels(spark, d).withColumns({"label": F.floor(F.col("r") / 64).cast("int"), "error": F.abs(F.col("r") - F.col("g"))})
    return reports.audit_flags(px, "vec_id", declared=4, limits={"blank": 0.001, "coverage": 0.05, "reconstruction": 40.0})


@query("w_posterize", f"WITH {PIXELS} SELECT vec_id, i, (r >> 5) << 5 AS r, (g >> 5) << 5 AS g FROM px")
def w_posterize(spark, d):
    return pixels(spark, d).select("vec_id", "i", C.posterize("r", 3).alias("r"), C.posterize("g", 3).alias("g"))


# --- rules on markup (text level with SQL; parsed rules on a small drawing set)


@query(
    "g4_g8_text_rules",
    """SELECT page_id, (contains(lower(html), '<script') OR regexp_matches(lower(html), '\\bon(load|click|mouseover)\\s*=')) AS script,
      regexp_matches(lower(html), 'href\\s*=\\s*["'']https?://') AS external_ref, contains(lower(html), '<style') AS css_block, length(html) > 20000 AS huge FROM pages""",
)
def g4_g8_text_rules(spark, d):
    from quillon.functions import svg

    reject, warn = svg.text_flags("html")
    rows = table(spark, d, "pages").select("page_id", reject.alias("r"), warn.alias("w"), (F.char_length("html") > 20000).alias("huge"))
    return rows.select("page_id", F.array_contains("r", "script").alias("script"), F.array_contains("r", "external-ref").alias("external_ref"), F.array_contains("w", "css-block").alias("css_block"), "huge")


def drawings(spark, d) -> DataFrame:
    """SVG texts made from the parts table, one shape of fault for each remainder of the key."""
    shape = F.expr("""CASE p_partkey % 8 WHEN 0 THEN concat('<path d="M0 0 L', p_size, ' 10 C1 1 2 2 3 3 Z" fill="#', lpad(hex(p_size), 6, '0'), '"/>') WHEN 1 THEN concat('<rect width="', p_size, '" height="2" fill="red"/>')
      WHEN 2 THEN '<image href="https://x"/>' WHEN 3 THEN '<text>a</text><path d="M0 0 H5" style="fill:none"/>' WHEN 4 THEN '<g id="Logo"/>' WHEN 5 THEN '<path d="M900 900 l1 1.25"/>' WHEN 6 THEN '<circle r="1" display="none"/>' ELSE '<rect' END""")
    box = F.expr("""CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN ' viewBox="0 0 0 5"' ELSE ' viewBox="0 0 100 100"' END""")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg"'), box, F.lit(">"), shape, F.lit("</svg>")).alias("svg"))


#: Facts of drawings(): kind of fault, and whether the canvas is known and not empty.
DRAWN = """drawn AS (SELECT p_partkey, p_size AS s, p_partkey % 8 AS k, CASE WHEN p_partkey % 11 = 0 THEN 'no-size' WHEN p_partkey % 13 = 0 THEN 'zero-size' END AS fault,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN ' viewBox="0 0 0 5"' ELSE ' viewBox="0 0 100 100"' END AS box,
  ['<path d="M0 0 L' || p_size || ' 10 C1 1 2 2 3 3 Z" fill="#' || lpad(printf('%X', p_size), 6, '0') || '"/>', '<rect width="' || p_size || '" height="2" fill="red"/>', '<image href="https://x"/>', '<text>a</text><path d="M0 0 H5" style="fill:none"/>',
   '<g id="Logo"/>', '<path d="M900 900 l1 1.25"/>', '<circle r="1" display="none"/>', '<rect'][p_partkey % 8 + 1] AS shape FROM part)"""
_LISTED = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"
_REJECT = _LISTED.format("CASE WHEN k = 2 THEN 'external-ref' END, fault, CASE WHEN k = 2 THEN 'raster' END, CASE WHEN k = 4 THEN 'no-drawables' END, CASE WHEN k = 6 THEN 'all-invisible' END, CASE WHEN k = 5 AND fault IS NULL THEN 'off-canvas' END")
_WARN = _LISTED.format("CASE WHEN k = 3 THEN 'live-text' END, CASE WHEN (k = 3 OR k = 0 AND s < 10) AND fault IS NULL THEN 'low-occupancy' END")


@query(
    "g1_g20_quality_tiers",
    f"""WITH {DRAWN}, f AS (SELECT *, CASE WHEN k = 7 THEN 'parse-error' ELSE {_REJECT} END AS reject, CASE WHEN k = 7 THEN '' ELSE {_WARN} END AS warn FROM drawn)
    SELECT p_partkey, CASE WHEN reject <> '' THEN 'reject' WHEN warn <> '' THEN 'warn' ELSE 'clean' END AS tier, reject, warn, CAST(length('<svg xmlns="http://www.w3.org/2000/svg"' || box || '>' || shape || '</svg>') AS INT) AS len,
      CASE WHEN k IN (0, 3, 5) THEN 1 ELSE 0 END AS paths, CASE k WHEN 0 THEN 4 WHEN 3 THEN 2 WHEN 5 THEN 2 ELSE 0 END AS cmds, CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END AS colors, false AS gradient, false AS stroke, CASE WHEN k = 0 THEN 0.5e0 ELSE 0e0 END AS curve_frac FROM f""",
)
def g1_g20_quality_tiers(spark, d):
    from quillon.functions import svg

    listed = [F.array_join(c, ",").alias(c) for c in ("reject", "warn")]
    return svg.classified(drawings(spark, d)).select("p_partkey", "tier", *listed, "len", "paths", "cmds", "colors", "gradient", "stroke", F.round("curve_frac", 3).alias("curve_frac"))


@query("r1_tier_counts", "SELECT CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 OR p_partkey % 8 IN (2, 4, 5, 6, 7) THEN 'reject' WHEN p_partkey % 8 = 3 OR (p_partkey % 8 = 0 AND p_size < 10) THEN 'warn' ELSE 'clean' END AS tier, count(*) AS n FROM part GROUP BY 1")
def r1_tier_counts(spark, d):
    return g1_g20_quality_tiers(spark, d).groupBy("tier").agg(F.count("*").alias("n"))


_HAS = "CASE WHEN k IN ({0}) THEN 1e0 ELSE 0e0 END AS {1}"
_OVER = "round({0}, 6) AS {1}"
_CHORDS = "CASE k WHEN 0 THEN [0e0, sqrt(s * s + 100e0), sqrt((s - 3) * (s - 3) + 49e0), 6e0] WHEN 3 THEN [0e0, 5e0] WHEN 5 THEN [sqrt(1620000e0), sqrt(2.5625e0)] END"
_TURN = "CASE k WHEN 0 THEN acos(greatest(-1e0, least(1e0, ((3 - s) * s - 70e0) / (sqrt((s - 3) * (s - 3) + 49e0) * sqrt(s * s + 100e0))))) WHEN 5 THEN acos(2025e0 / (sqrt(2.5625e0) * sqrt(1620000e0))) ELSE 0e0 END"


@query(
    "a1_a2_trace_features",
    f"""WITH {DRAWN}, c AS (SELECT *, {_CHORDS} AS chords, {_TURN} AS turn FROM drawn), m AS (SELECT *, list_avg(chords) AS mean, list_avg(list_transform(chords, lambda x: x * x)) AS square FROM c)
    SELECT p_partkey, CASE k WHEN 0 THEN 1e0 WHEN 3 THEN 0.5e0 WHEN 5 THEN 1e0 ELSE 0e0 END AS path_frac, {_HAS.format("1, 6", "prim_frac")}, 0e0 AS has_arc, CASE WHEN k = 0 THEN 0.5e0 ELSE 0e0 END AS curve_frac, {_HAS.format("3", "axis_frac")},
      CASE k WHEN 0 THEN 4e0 WHEN 3 THEN 2e0 WHEN 5 THEN 2e0 ELSE 0e0 END AS cmds_per_path, {_HAS.format("0, 3, 5", "n_paths")}, CASE WHEN fault IS NOT NULL THEN 0e0 WHEN k = 0 THEN 0.25e0 WHEN k = 3 THEN 0.5e0 ELSE 0e0 END AS frac_tiny_chords,
      {_OVER.format("coalesce(sqrt(greatest(0, square - mean * mean)) / mean, 0)", "chord_cv")}, {_OVER.format("turn", "mean_turn")}, CASE WHEN k IN (0, 5) AND turn < radians(10) THEN 1e0 ELSE 0e0 END AS frac_small_turn,
      CASE WHEN k = 5 THEN 0.5e0 ELSE 0e0 END AS mean_decimals, CASE WHEN k IN (0, 3) THEN 1e0 WHEN k = 5 THEN 0.75e0 ELSE 0e0 END AS frac_lowprec, {_HAS.format("0, 1", "distinct_fills")}, 0e0 AS has_stroke, 0e0 AS has_gradient, 0e0 AS has_editor_ns, 0e0 AS has_defs_use,
      {_HAS.format("3", "has_text")}, {_HAS.format("4", "has_named_id")}, {_HAS.format("7", "parse_error")} FROM m""",
)
def a1_a2_trace_features(spark, d):
    from quillon.functions import svg

    found = svg.traced_features(drawings(spark, d)).drop("svg", "facts", "canon")
    return found.select("p_partkey", *[F.round(c, 6).alias(c) for c in found.columns if c != "p_partkey"])


@query(
    "l2_l3_painted_leaves",
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 7 THEN 'parse-error' END AS cause, CASE WHEN p_partkey % 8 IN (2, 4) THEN 0 WHEN p_partkey % 8 = 3 THEN 2 WHEN p_partkey % 8 < 7 THEN 1 END AS n_leaves,
      CASE WHEN p_partkey % 8 = 0 THEN '0,0,' || p_size WHEN p_partkey % 8 = 1 THEN '255,0,0' WHEN p_partkey % 8 IN (3, 5, 6) THEN '0,0,0' END AS first_fill FROM part""",
)
def l2_l3_painted_leaves(spark, d):
    from quillon.functions import paint

    return paint.painted(drawings(spark, d)).select("p_partkey", "cause", F.expr("if(leaves is null, null, size(leaves))").alias("n_leaves"), F.expr("array_join(cast(get(leaves, 0).fill as array<string>), ',')").alias("first_fill"))


_CANON = """['<path d=M0 0 L' || s || ' 10 C1 1 2 2 3 3 Z fill=#' || CASE WHEN s BETWEEN 10 AND 15 THEN '0' ELSE '' END || printf('%X', s) || '></path>', '<rect fill=red height=2 width=' || s || '></rect>', '<image href=https://x></image>', '<text></text><path d=M0 0 H5></path>',
  '<g></g>', '<path d=M900 900 l1 1.2></path>', '<circle display=none r=1></circle>'][k + 1]"""


@query(
    "f2_f5_normalized_hash",
    f"""WITH {DRAWN} SELECT p_partkey, sha256(CASE WHEN k = 7 THEN '<svg xmlns="http://www.w3org/2000/svg"' || box || '><rect</svg>' ELSE '<svg' || replace(box, '"', '') || '>' || {_CANON} || '</svg>' END) AS norm FROM drawn""",
)
def f2_f5_normalized_hash(spark, d):
    from quillon.functions import svg

    return svg.parsed(drawings(spark, d)).select("p_partkey", F.sha2("canon", 256).alias("norm"))


@query(
    "f10_recolour",
    f"""WITH {DRAWN} SELECT p_partkey, step, CASE WHEN k = 0 THEN printf('#%02x%02x%02x', step, step, least(255, s + step)) ELSE '' END AS fill FROM drawn, (SELECT unnest([6, 12, 20]) AS step)""",
)
def f10_recolour(spark, d):
    from quillon.functions import svg

    return svg.with_recolouring(drawings(spark, d), [6, 12, 20]).select("p_partkey", "step", F.regexp_extract("svg", "#[0-9a-f]{6}", 0).alias("fill"))


# --- events


@query(
    "t1_retention",
    """SELECT event_id FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'purchase' THEN 'sample' WHEN event_type = 'click' THEN 'step' ELSE 'other' END ORDER BY event_id DESC) AS rn FROM events)
    WHERE rn <= CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 20 ELSE 5 END""",
)
def t1_retention(spark, d):
    from quillon.streaming import events as E

    rows = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "purchase", "sample").when(F.col("event_type") == "click", "step").otherwise("other"))
    return E.retained(rows, "user_id", "event_id", "kind", {"sample": 1, "step": 20}, 5).select("event_id")


@query(
    "t2_latest_run",
    """SELECT event_id, CAST(user_id AS VARCHAR) || '#' || CAST(n AS VARCHAR) AS run FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS last FROM
    (SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)) WHERE n = last""",
)
def t2_latest_run(spark, d):
    """A purchase starts a user's next run; what replay holds are the events of the last one."""
    from quillon.streaming import events as E

    runs = E.stamped(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "purchase")
    return E.cleared(runs, "user_id").select("event_id", "run")


@query(
    "t4_console_tail",
    """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'job exited rc=' || turn ELSE role END AS line FROM conversations)
    SELECT conv_id, turn FROM l WHERE turn > 0 AND turn <= coalesce((SELECT min(turn) FROM l e WHERE e.conv_id = l.conv_id AND contains(line, 'job exited rc=')), turn)""",
)
def t4_console_tail(spark, d):
    from quillon.streaming import events as E

    line = F.when(F.col("turn") % 3 == 2, F.concat(F.lit(E.JOB_END), F.col("turn").cast("string"))).otherwise(F.col("role"))
    return E.tailed(table(spark, d, "conversations").select("conv_id", "turn", line.alias("line")), "conv_id", "turn", "line").select("conv_id", "turn")


@query("t3_throttle", "SELECT user_id, w, max(event_id) AS event_id FROM (SELECT user_id, event_id, date_trunc('hour', ts) AS w FROM events) GROUP BY user_id, w")
def t3_throttle(spark, d):
    from quillon.streaming import events as E

    return E.throttled(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", "1 hour").select("user_id", F.col("w").cast("timestamp_ntz").alias("w"), "event_id")


@query("s4_manifest_last_wins", "SELECT conv_id, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def s4_manifest_last_wins(spark, d):
    return scans.last_wins(table(spark, d, "conversations"), "conv_id", "role", "turn")


@query("s5_off_split", f"SELECT doc_id FROM documents WHERE {SPLIT} <> 'train'")
def s5_off_split(spark, d):
    return scans.off_split(table(spark, d, "documents").withColumn("split", F.expr(SPLIT)), "split", "train", "doc_id")


@query("w_degradation_kernels")
def w_degradation_kernels(spark, d):
    from quillon.functions import raster

    return raster.degraded(table(spark, d, "embeddings"), 8)


_AT = "i // 8 AS y, i % 8 AS x"
#: Blur by 1.5 over four pixels to either side, the border repeated.
FORENSICS = f"""WITH {GRAY}, px AS (SELECT id, pos // 8 AS y, pos % 8 AS x, v FROM gray),
d AS (SELECT a.id, (a.v - b.v - c.v + e.v) / 4 AS d FROM px a JOIN px b ON b.id = a.id AND b.y = a.y AND b.x = a.x + 1 JOIN px c ON c.id = a.id AND c.y = a.y + 1 AND c.x = a.x JOIN px e ON e.id = a.id AND e.y = a.y + 1 AND e.x = a.x + 1),
noise AS (SELECT id, median(abs(d - m)) / 0.6745e0 AS sigma FROM (SELECT id, d, median(d) OVER (PARTITION BY id) AS m FROM d) GROUP BY id),
w AS (SELECT o, exp(-(o * o) / 4.5e0) / (SELECT sum(exp(-(q * q) / 4.5e0)) FROM range(-4, 5) t(q)) AS w FROM range(-4, 5) t(o)),
rows_ AS (SELECT p.id, p.y, p.x, sum(w * q.v) AS v FROM px p, w JOIN px q ON q.id = p.id AND q.x = p.x AND q.y = greatest(0, least(7, p.y + o)) GROUP BY ALL),
soft AS (SELECT p.id, p.y, p.x, sum(w * q.v) AS v FROM rows_ p, w JOIN rows_ q ON q.id = p.id AND q.y = p.y AND q.x = greatest(0, least(7, p.x + o)) GROUP BY ALL),
bend AS (SELECT p.id, p.y, p.x, round(abs(sum(q.v) - 4 * any_value(p.v)), 6) AS b FROM px p, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx) JOIN px q ON q.id = p.id AND q.y = 7 - abs(7 - abs(p.y + dy)) AND q.x = 7 - abs(7 - abs(p.x + dx)) GROUP BY ALL),
edge AS (SELECT id, y, x, b > quantile_cont(b, 0.98) OVER (PARTITION BY id) AS edge FROM bend),
near AS (SELECT a.id, a.y, a.x FROM edge a JOIN edge b ON b.id = a.id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 GROUP BY ALL HAVING bool_or(b.edge) AND NOT bool_or(a.edge)),
ring AS (SELECT near.id, avg(abs(px.v - soft.v)) AS r FROM near JOIN px USING (id, y, x) JOIN soft USING (id, y, x) GROUP BY near.id),
sd AS (SELECT id, stddev_pop(v) AS sd FROM px GROUP BY id)"""


@query("k1_k2_forensics", FORENSICS + " SELECT sd.id AS vec_id, round(sigma, 4) AS noise_sigma, round(coalesce(r, 0) / (sd + 1e-6), 4) AS edge_ringing FROM sd JOIN noise USING (id) LEFT JOIN ring ON ring.id = sd.id")
def k1_k2_forensics(spark, d):
    from quillon.functions import raster

    return raster.forensics(table(spark, d, "embeddings"), 8).select("vec_id", *[F.round(c, 4).alias(c) for c in ("noise_sigma", "edge_ringing")])


@query("d12_recipes")
def d12_recipes(spark, d):
    from quillon.functions import recipes

    return recipes.sampled(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("t5_damage_by_epoch")
def t5_damage_by_epoch(spark, d):
    from quillon.functions import recipes

    drawn = recipes.damaged(table(spark, d, "embeddings"), epoch=1)
    return drawn.withColumn("mean", F.expr("aggregate(damage, 0d, (a, v) -> a + v) / size(damage)")).drop("damage")


@query("d11_tier_recipes")
def d11_tier_recipes(spark, d):
    from quillon.functions import recipes

    return recipes.tier_recipes(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(
    "l8_pixel_labels",
    f"""WITH {GRAY}, p AS (SELECT DISTINCT id, CAST(floor(v) AS INT) // 32 * 32 + 16 AS c FROM gray WHERE floor(v) < 224), n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
    d AS (SELECT g.id, g.pos, any_value(g.v) AS v, min(abs(g.v - p.c)) AS d FROM gray g LEFT JOIN p ON p.id = g.id GROUP BY g.id, g.pos)
    SELECT d.id AS vec_id, CAST(1 + coalesce(any_value(n.n), 0) AS INT) AS n_palette, round(avg(CASE WHEN d < 255 - v THEN 1e0 ELSE 0e0 END), 6) AS label_nonzero_frac FROM d LEFT JOIN n ON n.id = d.id GROUP BY d.id""",
)
def l8_pixel_labels(spark, d):
    from quillon.functions import labels

    return labels.labelled_images(table(spark, d, "embeddings")).select("vec_id", "n_palette", F.round("label_nonzero_frac", 6).alias("label_nonzero_frac"))


@query("l11_backgrounds")
def l11_backgrounds(spark, d):
    from quillon.functions import labels

    return labels.labelled_images(table(spark, d, "embeddings")).select("vec_id", "background")


# --- colour operations of a capture path whose results SQL can tell


def _captured(spark, d, op: str, **params) -> DataFrame:
    """(vec_id, i, r, g, b) of the pixel table's images after one operation."""
    from quillon.functions import capture

    images = pixels(spark, d).groupBy("vec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("i", "r", "g", "b"))), lambda p: F.array(p["r"], p["g"], p["b"]))).alias("rgb"))
    done = capture.captured(images, [{"op": op, "params": params}], 7, "vec_id", "rgb")
    each = done.select("vec_id", "rgb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))).alias("i"))
    return each.select("vec_id", "i", *[F.get("rgb", (F.col("i") * 3 + n).cast("int")).alias(k) for n, k in enumerate("rgb")])


_EACH = ", ".join


@query("w_nearest_decimate", f"WITH {PIXELS} SELECT a.vec_id, a.i, b.r, b.g, b.b FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.i = ((a.i // 8) * 3 // 8 * 3) * 8 + (a.i % 8) * 3 // 8 * 3")
def w_nearest_decimate(spark, d):
    return _captured(spark, d, "nearest_decimate", stride=3)


@query("w_capture_posterize", f"WITH {PIXELS} SELECT vec_id, i, " + _EACH(f"(({k} >> 5) << 5) + 16 AS {k}" for k in "rgb") + " FROM px")
def w_capture_posterize(spark, d):
    return _captured(spark, d, "posterize", bits=3)


@query("w_ink_bleed", f"WITH {PIXELS} SELECT a.vec_id, a.i, " + _EACH(f"min(b.{k}) AS {k}" for k in "rgb") + " FROM px a JOIN px b ON b.vec_id = a.vec_id AND abs(b.i // 8 - a.i // 8) <= 1 AND abs(b.i % 8 - a.i % 8) <= 1 GROUP BY a.vec_id, a.i")
def w_ink_bleed(spark, d):
    return _captured(spark, d, "ink_bleed", mode="thicken", ksize=3, flip=0.0)


@query("w_illumination", f"WITH {PIXELS}, l AS (SELECT *, 1e0 + 0.35e0 * ((i % 8) / 8e0 / (7 / 8e0 + 1e-6) - 0.5e0) AS f FROM px) SELECT vec_id, i, " + _EACH(f"CAST(floor(least(255, {k} * f)) AS INT) AS {k}" for k in "rgb") + " FROM l")
def w_illumination(spark, d):
    return _captured(spark, d, "illumination", angle=0.0, strength=0.35)


_SCREEN = "(sin(2 * pi() * 3 / 8 * (i % 8 * cos(radians({0})) + i // 8 * sin(radians({0})))) * sin(2 * pi() * 3 / 8 * (i // 8 * cos(radians({0})) - i % 8 * sin(radians({0})))) + 1) / 2"


@query("w_halftone", f"WITH {PIXELS} SELECT vec_id, i, " + _EACH(f"CAST(floor({k} + (CASE WHEN {k} / 255e0 > {_SCREEN.format(a)} THEN 255 ELSE 0 END - {k}) * 0.45e0) AS INT) AS {k}" for k, a in zip("rgb", (25, 85, 10))) + " FROM px")
def w_halftone(spark, d):
    return _captured(spark, d, "halftone", lpi=3, angles=[25, 85, 10], descreen=0, mix=0.45)


@query("w_warp_quarter_turn", f"WITH {PIXELS} SELECT a.vec_id, a.i, b.r, b.g, b.b FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.i = (7 - a.i % 8) * 8 + a.i // 8")
def w_warp_quarter_turn(spark, d):
    return _captured(spark, d, "geometric_warp", matrix=[[0, -1, 7], [1, 0, 0], [0, 0, 1]])


@query("r13_scores", f"""WITH {PIXELS}, g AS (SELECT vec_id % 10 AS epoch, vec_id, i, r > 128 AS t, r > 120 AS p FROM px),
    e AS (SELECT a.epoch, a.vec_id, a.i, max(CASE WHEN a.t <> b.t THEN 1 ELSE 0 END) AS tb, max(CASE WHEN a.p <> b.p THEN 1 ELSE 0 END) AS pb FROM g a JOIN g b ON b.vec_id = a.vec_id AND ((b.i = a.i + 1 AND a.i % 8 < 7) OR b.i = a.i + 8) GROUP BY ALL),
    f AS (SELECT epoch, sum(tb * pb) AS hit, sum(tb) AS t, sum(pb) AS p FROM e GROUP BY epoch)
    SELECT f.epoch, round(a.accuracy, 6) AS accuracy, round(2e0 * hit / (t + p), 6) AS f1 FROM f JOIN (SELECT epoch, avg(CASE WHEN t = p THEN 1e0 ELSE 0e0 END) AS accuracy FROM g GROUP BY epoch) a ON a.epoch = f.epoch""")
def r13_scores(spark, d):
    """Accuracy and boundary F1 of a threshold's labels, by epoch (ten groups of images)."""
    cells = pixels(spark, d).select("vec_id", "i", (F.col("r") > 128).alias("t"), (F.col("r") > 120).alias("p"))
    parts = reports.boundary_parts(cells, 8).withColumn("epoch", F.col("vec_id") % 10)
    scores = reports.boundary_f1(parts, "epoch").join(reports.pixel_accuracy(cells.withColumn("epoch", F.col("vec_id") % 10), "epoch"), "epoch")
    return scores.select("epoch", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1"))


@query("r13_epoch_means", "SELECT user_id AS epoch, round(sum(value * (event_id % 8 + 1)) / sum(event_id % 8 + 1), 6) AS mean FROM events GROUP BY user_id")
def r13_epoch_means(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("epoch"), F.col("value").alias("loss"), (F.col("event_id") % 8 + 1).alias("items"))
    return reports.epoch_means(e).select("epoch", F.round("mean", 6).alias("mean"))


@query("f24_jpeg_quality", f"WITH {PIXELS}, m AS (SELECT vec_id, (100 * avg(r % 99 + 1) - 50) / 57.625e0 AS s FROM px GROUP BY vec_id) SELECT vec_id, round(greatest(1, least(100, CASE WHEN s > 100 THEN 5000 / s ELSE (200 - s) / 2 END)), 6) AS quality FROM m")
def f24_jpeg_quality(spark, d):
    tables = pixels(spark, d).groupBy("vec_id").agg(F.collect_list((F.col("r") % 99 + 1).cast("double")).alias("t"))
    return tables.select("vec_id", F.round(C.jpeg_quality("t"), 6).alias("quality"))
