"""Queries of the engine's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens import schemas as S
from pairlens.functions import labels as L
from pairlens.functions import numeric as N
from pairlens.functions import text as X
from pairlens.functions.keys import canonical_patch, clean_word, known_block, patch_number
from pairlens.operators import claims as C
from pairlens.operators import evidence as E
from pairlens.operators import fit, geometry, inference, metrics, parse, period, raster, splits, validate
from pairlens.operators import overlap_scores as O
from pairlens.operators.quantiles import exact_quantiles
from pairlens.operators.spatial import located
from pairlens.session import materialize
from pairlens.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


JAN = ("2024-01-01", "2024-01-16"), ("2024-01-16", "2024-01-31")


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return materialize(period.paired_medians(table(spark, d, "events"), "user_id", F.col("ts"), "value", *JAN).filter("delta is not null"), "changes")


_CHANGES = """with m as (select user_id,
  median(value) filter (ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-16') as v0,
  median(value) filter (ts >= timestamp '2024-01-16' and ts < timestamp '2024-01-31') as v1
  from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' group by user_id),
c as (select user_id, v1 - v0 as delta from m where v1 - v0 is not null),
q as (select quantile_cont(delta, 0.15) as lo, quantile_cont(delta, 0.85) as hi from c)"""


@query("select event_id, user_id, coalesce(value, 0.0) as value from events where event_type not in ('error', 'signup')")
def q_scan_project_filter(spark: SparkSession, d: str) -> DataFrame:
    """Membership mask, projection and coalesced values."""
    return table(spark, d, "events").filter(~F.col("event_type").isin("error", "signup")).select("event_id", "user_id", F.coalesce("value", F.lit(0.0)).alias("value"))


@query(_CHANGES + " select case when delta <= lo then 'decline' when delta >= hi then 'increase' else 'stable' end as label, count(*) as n from c, q group by 1")
def q_paired_change_labels(spark: SparkSession, d: str) -> DataFrame:
    """Medians of two windows per user, their change, percentile cut-offs, labels, counts."""
    c = _changes(spark, d)
    cut = exact_quantiles(c, F.col("delta"), [S.DECLINE_QUANTILE, S.INCREASE_QUANTILE]).select(F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    return c.join(F.broadcast(cut)).groupBy(L.two_threshold(F.col("delta"), F.col("lo"), F.col("hi")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _CHANGES
    + """, e as (select user_id,
  avg((event_type = 'error')::int) filter (ts < timestamp '2024-01-16') as e0, avg((event_type = 'error')::int) filter (ts >= timestamp '2024-01-16') as e1
  from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-31' group by user_id)
select case when e0 > 0.15 or e1 > 0.15 then 'uncertain' when delta <= lo then 'decline' when delta >= hi then 'increase'
  when abs(delta) < 20 then 'stable' else 'uncertain' end as label, count(*) as n from c join e using (user_id), q group by 1"""
)
def q_uncertain_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the uncertain branches; the share of errors stands for what is masked."""
    ev = table(spark, d, "events").filter((F.col("ts") >= F.lit(JAN[0][0]).cast("timestamp")) & (F.col("ts") < F.lit(JAN[1][1]).cast("timestamp")))
    first, bad = F.col("ts") < F.lit(JAN[1][0]).cast("timestamp"), (F.col("event_type") == "error").cast("int")
    m = ev.groupBy("user_id").agg(F.avg(F.when(first, bad)).alias("e0"), F.avg(F.when(~first, bad)).alias("e1"))
    c = _changes(spark, d)
    cut = exact_quantiles(c, F.col("delta"), [0.15, 0.85]).select(F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    label = L.screened_label(F.col("delta"), F.col("lo"), F.col("hi"), F.col("e0"), F.col("e1"), band=20.0)
    return c.join(m, "user_id").join(F.broadcast(cut)).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_returnflag, count(*) as n, round(avg((l_extendedprice - l_quantity) / nullif(l_extendedprice + l_quantity, 0)), 8) as mean_nd, round(avg(pow(10, l_discount / 10)), 8) as mean_ratio from lineitem group by 1")
def q_norm_diff(spark: SparkSession, d: str) -> DataFrame:
    """Normalised difference and the ratio behind decibels."""
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(N.norm_diff(F.col("l_extendedprice"), F.col("l_quantity"))), 8).alias("mean_nd"), F.round(F.avg(N.linear_ratio(F.col("l_discount"))), 8).alias("mean_ratio"))


@query("select p_brand, count(*) as n, round(avg(2.5 * (p_retailprice - p_size) / 10000 / nullif(p_retailprice / 10000 + 6 * p_size / 10000 - 7.5 * p_size / 20000 + 1, 0)), 8) as mean_evi from part group by 1")
def q_evi(spark: SparkSession, d: str) -> DataFrame:
    """The enhanced index on three bands."""
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(N.evi(F.col("p_retailprice"), size, size / 2)), 8).alias("mean_evi"))


@query("""with m as (select month(o_orderdate) as m, avg(o_totalprice) filter (o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2000-03-01') as seen,
  avg(o_totalprice) filter (o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '2000-01-01') as normal from orders group by 1)
select count(*) as n_months, round(avg(seen - normal), 6) as anomaly from m where seen is not null and normal is not null""")
def q_month_anomaly(spark: SparkSession, d: str) -> DataFrame:
    """Month-matched anomaly against a climatology."""
    a = period.month_anomaly(table(spark, d, "orders"), F.col("o_orderdate"), "o_totalprice", ("2000-01-01", "2000-03-01"), ("1995-01-01", "2000-01-01"))
    return a.select("n_months", F.round("anomaly", 6).alias("anomaly"))


@query("select o_custkey, len(list_distinct(list(month(o_orderdate)))) as n_months, min(o_orderdate)::date as first_day, max(o_orderdate)::date as last_day from orders where o_orderdate < timestamp '1996-01-01' group by 1")
def q_month_sets(spark: SparkSession, d: str) -> DataFrame:
    """Number of months in which each customer ordered before 1996, as its SQL says; `q_first_year_months` has every customer."""
    o = table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return o.groupBy("o_custkey").agg(F.countDistinct(F.month("o_orderdate")).cast("int").alias("n_months"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("""with y as (select o_custkey, year(o_orderdate) as y, count(distinct month(o_orderdate)) as n_months, min(o_orderdate)::date as first_day, max(o_orderdate)::date as last_day from orders where o_orderdate is not null group by 1, 2)
select o_custkey, range(month(first_day), month(last_day) + 1) as months, n_months, first_day, last_day from (select *, row_number() over (partition by o_custkey order by y) as r from y) where r = 1""")
def q_first_year_months(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's first year with orders: the months from its first to its last order, and how many of these have one."""
    day = F.col("o_orderdate").cast("date")
    y = table(spark, d, "orders").filter("o_orderdate is not null").groupBy("o_custkey", F.year(day).alias("y")).agg(F.countDistinct(F.month(day)).alias("n_months"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    one = y.groupBy("o_custkey").agg(F.min(F.struct("y", "first_day", "last_day", "n_months")).alias("f")).select("o_custkey", "f.*")
    return one.select("o_custkey", period.month_set(F.col("first_day"), F.col("last_day")).alias("months"), "n_months", "first_day", "last_day")


@query("select o_custkey, o_orderpriority, n from (select o_custkey, o_orderpriority, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as r from orders where o_orderpriority is not null group by 1, 2) where r = 1")
def q_dominant_category(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent category per key; ties by name."""
    return metrics.dominant(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("""select count(*) as n, round(avg(v), 5) as mean, round(stddev_pop(v), 5) as std_pop, round(stddev_samp(v), 5) as std_samp, round(min(v), 5) as min, round(max(v), 5) as max,
 round(quantile_cont(v, 0.1), 5) as p10, round(quantile_cont(v, 0.9), 5) as p90, round(avg((v < -0.05)::int), 4) as share_below, round(avg((v > 0.05)::int), 4) as share_above
 from (select l_discount - l_tax as v from lineitem)""")
def q_delta_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of differences with both deviations, exact percentiles and shares beyond a band."""
    return period.delta_summary(table(spark, d, "lineitem"), F.col("l_discount") - F.col("l_tax"))


@query("select ceil((c_acctbal + 1000) / 500)::bigint as bin_right, floor((c_acctbal + 1000) / 500)::bigint as bin_left, count(*) as n, round(avg(c_acctbal), 6) as mean from customer group by 1, 2")
def q_binned(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed and left-closed bins with sizes and means."""
    b = (F.col("c_acctbal") + 1000) / 500
    return table(spark, d, "customer").groupBy(F.ceil(b).alias("bin_right"), F.floor(b).alias("bin_left")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


_CLEAN = "nullif(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"


@query(f"""select coalesce({_CLEAN.format('candidate_class')}, 'None') as class, coalesce(vegetation_trend, 'None') as trend, count(*) as n,
 sum(coalesce(n_triplets, 0))::bigint as boxes, sum((n_triplets is null or n_triplets = 0)::int)::bigint as without_boxes, sum((has_reference)::int)::bigint as with_reference from train_patches group by 1, 2""")
def q_crosstab(spark: SparkSession, d: str) -> DataFrame:
    """Counts of class and trend pairs, missing words as None, with box totals."""
    t = table(spark, d, "train_patches")
    return t.groupBy(F.coalesce(clean_word(F.col("candidate_class")), F.lit("None")).alias("class"), F.coalesce("vegetation_trend", F.lit("None")).alias("trend")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("n_triplets", F.lit(0)).cast("long")).alias("boxes"), F.sum((F.coalesce("n_triplets", F.lit(0)) == 0).cast("long")).alias("without_boxes"), F.sum(F.col("has_reference").cast("long")).alias("with_reference")
    )


_NUM = "regexp_extract({}, '(\\d+)', 1)::bigint"


@query(f"""with t as (select distinct {_NUM.format('patch_id')} as n from test_patches), p as (select distinct {_NUM.format('id')} as n from predictions_explain)
select 'semi' as side, count(*) as n from t where n in (select n from p) union all select 'anti', count(*) from t where n not in (select n from p)
union all select 'intersect', count(*) from (select n from t intersect select n from p) union all select 'except', count(*) from (select n from p except select n from t)""")
def q_semi_anti(spark: SparkSession, d: str) -> DataFrame:
    """Semi and anti joins, intersection and difference of ids."""
    t = table(spark, d, "test_patches").select(patch_number(F.col("patch_id")).alias("n")).distinct()
    p = table(spark, d, "predictions_explain").select(patch_number(F.col("id")).alias("n")).distinct()
    parts = {"semi": t.join(p, "n", "left_semi"), "anti": t.join(p, "n", "left_anti"), "intersect": t.intersect(p), "except": p.exceptAll(t)}
    return reduce(DataFrame.unionByName, [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("side"), "n") for k, x in parts.items()])


@query(f"""with t as (select distinct {_NUM.format('patch_id')} as n, 1 as l from test_patches), p as (select distinct {_NUM.format('id')} as n, 1 as r from predictions_explain)
select coalesce(sum((r is null)::int), 0)::bigint as only_left, coalesce(sum((l is null)::int), 0)::bigint as only_right, coalesce(sum((l = 1 and r = 1)::int), 0)::bigint as both,
 coalesce(sum((r is null or l is null)::int), 0) = 0 as equal from t full join p using (n)""")
def q_id_sync(spark: SparkSession, d: str) -> DataFrame:
    """Symmetric difference of two sets of ids and whether they are equal."""
    t = table(spark, d, "test_patches").select(patch_number(F.col("patch_id")).alias("n"))
    return validate.id_sync(t, table(spark, d, "predictions_explain").select(patch_number(F.col("id")).alias("n")), "n")


@query("select 'train' as split, candidate_class, count(*) as n from train_patches group by 2 union all select 'dev', candidate_class, count(*) from dev_patches group by 2 union all select 'test', candidate_class, count(*) from test_patches group by 2")
def q_union_splits(spark: SparkSession, d: str) -> DataFrame:
    """Union of the split tables with the split as a column."""
    parts = [table(spark, d, f"{s}_patches").select(F.lit(s).alias("split"), "candidate_class") for s in ("train", "dev", "test")]
    return reduce(DataFrame.unionByName, parts).groupBy("split", "candidate_class").agg(F.count(F.lit(1)).alias("n"))


def _preds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions_explain").select("row_id", F.col("combo_id").alias("run"), canonical_patch(patch_number(F.col("id"))).alias("id"), "gold", "pred", "generated_at")


@query("""select combo_id as run, gold, sum((pred is not distinct from 'decline')::int)::bigint as pred_decline, sum((pred is not distinct from 'stable')::int)::bigint as pred_stable,
 sum((pred is not distinct from 'increase')::int)::bigint as pred_increase, sum((coalesce(pred, '') not in ('decline', 'stable', 'increase'))::int)::bigint as pred_none
 from predictions_explain where gold in ('decline', 'stable', 'increase') group by 1, 2""")
def q_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of each run; unparsed answers are a column."""
    return metrics.confusion(_preds(spark, d), ["run"])


@query("""select combo_id as run, gold, sum((pred = 'decline')::int)::bigint as pred_decline, sum((pred = 'stable')::int)::bigint as pred_stable, sum((pred = 'increase')::int)::bigint as pred_increase, 0::bigint as pred_none
 from predictions_explain where gold in ('decline', 'stable', 'increase') and pred in ('decline', 'stable', 'increase') group by 1, 2""")
def q_confusion_answered(spark: SparkSession, d: str) -> DataFrame:
    """Confusion of answered rows only."""
    return metrics.confusion(_preds(spark, d), ["run"], answered_only=True)


_PRF = """with c as (select unnest(['decline', 'stable', 'increase']) as class), g as (
 select combo_id as run, class, sum((gold is not distinct from class and pred is not distinct from class)::int) as tp, sum((gold is distinct from class and pred is not distinct from class)::int) as fp,
 sum((gold is not distinct from class and pred is distinct from class)::int) as fn from predictions_explain, c group by 1, 2),
pr as (select run, class, coalesce(tp / nullif(tp + fp, 0), 0.0) as p, coalesce(tp / nullif(tp + fn, 0), 0.0) as r, (tp + fn)::bigint as support from g),
f as (select run, class, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) as f1, support from pr)"""


@query(_PRF + " select run, class, round(p, 9) as precision, round(r, 9) as recall, round(f1, 9) as f1, support from f")
def q_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and support of each class and run."""
    return metrics.per_class(_preds(spark, d), ["run"]).select("run", "class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    _PRF
    + """, m as (select run, sum(f1) / 3 as macro_f1 from f group by 1),
a as (select combo_id as run, count(*) as n, count(*) filter (pred in ('decline', 'stable', 'increase')) as answered, count(*) filter (gold = pred) as k from predictions_explain group by 1)
select run, n, answered, k, round(k / n, 9) as accuracy, round(k / nullif(answered, 0), 9) as accuracy_answered, round(macro_f1, 9) as macro_f1 from a join m using (run)"""
)
def q_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Both accuracies and the macro F1 over the three classes."""
    p = _preds(spark, d)
    macro = metrics.per_class(p, ["run"]).groupBy("run").agg((F.sum("f1") / 3).alias("macro_f1"))
    return metrics.accuracies(p, ["run"]).join(macro, "run").select("run", "n", "answered", "k", *[F.round(c, 9).alias(c) for c in ("accuracy", "accuracy_answered", "macro_f1")])


@query(f"""with g as (select gold from predictions_explain where gold in ('decline', 'stable', 'increase')), t as (select {_CLEAN.format('candidate_class')} as c from train_patches),
k as (select c, count(*) as n, row_number() over (order by count(*) desc, list_position(['decline', 'stable', 'increase'], c)) as r from t where c in ('decline', 'stable', 'increase') group by 1),
h as (select gold as c, count(*) as n, row_number() over (order by count(*) desc, list_position(['decline', 'stable', 'increase'], gold)) as r from g group by 1)
select 'best_constant' as baseline, h.c as class, h.n as hits, (select count(*) from g) as n from h where r = 1
union all select 'train_majority', k.c, (select count(*) from g where gold = k.c), (select count(*) from g) from k where r = 1""")
def q_baselines(spark: SparkSession, d: str) -> DataFrame:
    """The best constant class and the majority class of training, scored on the gold labels; ties by class order."""
    g = _preds(spark, d).filter(F.col("gold").isin(*S.CLASSES)).groupBy("gold").agg(F.count(F.lit(1)).alias("hits"))
    total = g.agg(F.sum("hits").alias("n"))
    best = g.orderBy(F.desc("hits"), metrics.class_rank(F.col("gold"))).limit(1).select(F.lit("best_constant").alias("baseline"), F.col("gold").alias("class"), "hits")
    t = table(spark, d, "train_patches").select(clean_word(F.col("candidate_class")).alias("class")).filter(F.col("class").isin(*S.CLASSES)).groupBy("class").agg(F.count(F.lit(1)).alias("m"))
    most = t.orderBy(F.desc("m"), metrics.class_rank(F.col("class"))).limit(1)
    major = most.join(g, most["class"] == g["gold"], "left").select(F.lit("train_majority").alias("baseline"), "class", F.coalesce("hits", F.lit(0)).alias("hits"))
    return best.unionByName(major).join(F.broadcast(total))


@query("""select combo_id as run, count(*) filter (gold = pred) as k, count(*) as n,
 round((k / n + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n) - 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4.0 * n * n)) / (1 + 1.959964 * 1.959964 / n), 9) as low,
 round((k / n + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n) + 1.959964 * sqrt(k / n * (1 - k / n) / n + 1.959964 * 1.959964 / (4.0 * n * n)) / (1 + 1.959964 * 1.959964 / n), 9) as high
 from predictions_explain group by 1""")
def q_wilson(spark: SparkSession, d: str) -> DataFrame:
    """Wilson interval of each run's accuracy."""
    a = metrics.accuracies(_preds(spark, d), ["run"])
    low, high = N.wilson(F.col("k"), F.col("n"))
    return a.select("run", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


# The planned pairs of runs in two families.
PAIRS = [
    ("main", "mosa_clip_qbridge_fenn", "mosa_clip_qbridge_fenn_s2"), ("main", "orla_vit_mlp_tarn", "orla_vit_mlp_tarn_lora"), ("main", "lumen_siglet_linear_brae", "quay_swin_xattn_holm"),
    ("main", "pelt_dino_mlp_skerry", "harl_conv_linear_moss"), ("extra", "orla_vit_mlp_tarn", "pelt_dino_mlp_skerry"), ("extra", "vey_siglet_mlp_corrie", "tidal_vit_linear_knoll"),
]
_TESTS = f"""with x as (select combo_id as run, {_NUM.format('id')} as id, gold, pred, row_number() over (partition by combo_id, {_NUM.format('id')} order by generated_at desc, row_id desc) as r from predictions_explain),
h as (select run, id, coalesce(gold = pred, false)::int as h from x where r = 1),
w(family, run_a, run_b) as (values {', '.join(str(p) for p in PAIRS)}),
t as (select family, run_a, run_b, count(*) as n, count(*) filter (a.h = 1 and b.h = 0) as b, count(*) filter (a.h = 0 and b.h = 1) as c from w join h a on a.run = run_a join h b on b.run = run_b and b.id = a.id group by 1, 2, 3),
p as (select *, case when b + c = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(b + c + 1) - lgamma(j + 1) - lgamma(b + c - j + 1) - (b + c) * ln(2))) from (select unnest(range(0, least(b, c) + 1)) as j))) end as p from t)"""


def _tests(spark: SparkSession, d: str) -> DataFrame:
    p = _preds(spark, d)
    w = Window.partitionBy("run", "id").orderBy(F.desc("generated_at"), F.desc("row_id"))
    one = p.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return inference.paired_runs(one, spark.createDataFrame(PAIRS, "family string, run_a string, run_b string"))


@query(_TESTS + " select family, run_a, run_b, n, b, c, round(p, 8) as p from p")
def q_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Exact paired test of planned pairs of runs on their common patches."""
    return _tests(spark, d).withColumn("p", F.round("p", 8))


@query(_TESTS + """, s as (select *, least(1.0, (count(*) over (partition by family) - row_number() over (partition by family order by p, run_a, run_b) + 1) * p) as s from p)
select family, run_a, run_b, round(p, 8) as p, round(max(s) over (partition by family order by p, run_a, run_b rows unbounded preceding), 8) as p_holm from s""")
def q_holm(spark: SparkSession, d: str) -> DataFrame:
    """Step-down adjusted p-values within each family."""
    t = _tests(spark, d).withColumn("test", F.concat_ws(" ", "run_a", "run_b"))
    return inference.holm(t, "family", "p", "test").select("family", "run_a", "run_b", F.round("p", 8).alias("p"), F.round("p_holm", 8).alias("p_holm"))


@query("""with g as (select combo_id as run, count(*) as n, count(*) filter (gold = pred) as agree,
 (count(*) filter (gold = 'decline') * count(*) filter (pred = 'decline') + count(*) filter (gold = 'stable') * count(*) filter (pred = 'stable') + count(*) filter (gold = 'increase') * count(*) filter (pred = 'increase')) / (count(*)::double * count(*)) as e
 from predictions_explain group by 1) select run, n, agree, round((agree / n - e) / nullif(1 - e, 0), 9) as kappa from g""")
def q_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of predictions and gold beyond chance."""
    return inference.kappa(_preds(spark, d), ["run"]).withColumn("kappa", F.round("kappa", 9))


@query()
def q_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap intervals of each run's accuracy and kappa (a random draw: no SQL)."""
    return inference.bootstrap_agreement(_preds(spark, d), ["run"])


def _cards(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions_explain")
    return p.select("row_id", F.col("combo_id").alias("run"), "gold", "pred", *[X.reading(F.col("prompt_text"), *v).alias(k) for k, v in X.READINGS.items()])


_DN = "try_cast(nullif(regexp_extract(prompt_text, 'NDVI -?\\d+\\.\\d+ then -?\\d+\\.\\d+ \\(Δ ([+-]\\d+\\.\\d+)\\)', 1), '') as double)"


@query(f"""with r as (select round({_DN}, 2) as v, gold from predictions_explain where gold is not null and {_DN} is not null), v as (select distinct v from r),
p as (select a.v as lo, b.v as hi from v a join v b on a.v < b.v where a.v < 0.01),
h as (select lo, hi, count(*) filter (gold = case when r.v <= lo then 'decline' when r.v >= hi then 'increase' else 'stable' end) as hits from p, r group by 1, 2)
select lo, hi, hits, (select count(*) from r) as n, (select count(*) from h where hits = (select max(hits) from h)) as n_best from h order by hits desc, lo, hi limit 1""")
def q_threshold_fit(spark: SparkSession, d: str) -> DataFrame:
    """The two cut-offs of the change of NDVI that fit the gold labels best, in steps of 0.01 as its SQL says; `q_threshold_fit_exact` fits the values."""
    return fit.threshold_fit(_cards(spark, d).withColumn("v", F.round("NDVI", 2)), "v")


@query(f"""with r as (select {_DN} as v, gold, count(*) as m from predictions_explain where gold is not null and {_DN} is not null group by 1, 2), v as (select distinct v from r),
p as (select a.v as lo, b.v as hi from v a join v b on a.v < b.v where a.v < 0.01),
h as (select lo, hi, coalesce(sum(m) filter (gold = case when r.v <= lo then 'decline' when r.v >= hi then 'increase' else 'stable' end), 0)::bigint as hits from p, r group by 1, 2)
select lo, hi, hits, (select sum(m)::bigint from r) as n, (select count(*) from h where hits = (select max(hits) from h)) as n_best from h order by hits desc, lo, hi limit 1""")
def q_threshold_fit_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same cut-offs over the changes as the prompts give them."""
    return fit.threshold_fit(_cards(spark, d), "NDVI")


@query(f"""with r as (select {_DN} as v, gold from predictions_explain where {_DN} is not null), c as (select 0.05::double as q, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from r union all select 0.1::double as q, quantile_cont(v, 0.1) as lo, quantile_cont(v, 0.9) as hi from r union all select 0.15::double as q, quantile_cont(v, 0.15) as lo, quantile_cont(v, 0.85) as hi from r union all select 0.2::double as q, quantile_cont(v, 0.2) as lo, quantile_cont(v, 0.8) as hi from r union all select 0.25::double as q, quantile_cont(v, 0.25) as lo, quantile_cont(v, 0.75) as hi from r),
b as (select lo as lo0, hi as hi0 from c where q = 0.15)
select q, count(*) as n, count(*) filter (case when v <= lo then 'decline' when v >= hi then 'increase' else 'stable' end <> case when v <= lo0 then 'decline' when v >= hi0 then 'increase' else 'stable' end) as changed,
 count(*) filter (v <= lo) as decline, count(*) filter (v >= hi and not v <= lo) as increase from r, c, b group by q""")
def q_threshold_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """How many labels other percentile pairs change."""
    v = _cards(spark, d).select(F.col("NDVI").alias("v")).filter("v is not null")
    qs = [0.05, 0.10, 0.15, 0.20, 0.25]
    n = len(qs)
    cut = exact_quantiles(v, F.col("v"), [*qs, *[1 - q for q in qs]]).select(F.array(*[f"q{i}" for i in range(n)]).alias("lo"), F.array(*[f"q{i}" for i in range(n, 2 * n)]).alias("hi"))
    rule = lambda i: L.two_threshold(F.col("v"), F.col("lo")[i], F.col("hi")[i])
    sums = [x for i in range(len(qs)) for x in (F.sum((rule(i) != rule(2)).cast("long")).alias(f"c{i}"), F.sum((rule(i) == "decline").cast("long")).alias(f"d{i}"), F.sum((rule(i) == "increase").cast("long")).alias(f"i{i}"))]
    g = v.join(F.broadcast(cut)).agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col("n"), F.col(f"c{i}").alias("changed"), F.col(f"d{i}").alias("decline"), F.col(f"i{i}").alias("increase")) for i, q in enumerate(qs)]))
    return g.select(rows.alias("r")).select("r.*")


@query(f"""with r as (select combo_id as run, gold, case when {_DN} <= -0.02 then 'decline' when {_DN} >= 0.02 then 'increase' else 'stable' end as rule from predictions_explain where {_DN} is not null and gold is not null)
select run, count(*) as n, count(*) filter (rule = gold) as reproduced, count(*) filter (rule <> gold) as off_rule from r group by 1""")
def q_rule_reproduction(spark: SparkSession, d: str) -> DataFrame:
    """Gold labels that the fixed rule gives back, and those off the rule."""
    r = _cards(spark, d).filter("NDVI is not null and gold is not null").withColumn("rule", L.two_threshold(F.col("NDVI")))
    return r.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("rule") == F.col("gold")).cast("long")).alias("reproduced"), F.sum((F.col("rule") != F.col("gold")).cast("long")).alias("off_rule"))


_E0 = "try_cast(nullif(regexp_extract(prompt_text, 'EVI Δ ([+-]\\d+\\.\\d+)', 1), '') as double)"


@query(f"""with r as (select {_DN} as a, {_E0} as b from predictions_explain) select count(*) as n,
 count(*) filter (case when a <= -0.02 then 'decline' when a >= 0.02 then 'increase' else 'stable' end <> case when b <= -0.02 then 'decline' when b >= 0.02 then 'increase' else 'stable' end) as flips,
 round(corr(a, b), 8) as corr, round(max(abs(a - b)), 8) as max_abs_diff, round(median(a - b), 8) as median_diff from r where a is not null and b is not null""")
def q_class_flips(spark: SparkSession, d: str) -> DataFrame:
    """Label flips, correlation and differences of two measurements."""
    r = _cards(spark, d).filter("NDVI is not null and EVI is not null")
    a, b = F.col("NDVI"), F.col("EVI")
    return r.agg(F.count(F.lit(1)).alias("n"), F.sum((L.two_threshold(a) != L.two_threshold(b)).cast("long")).alias("flips"), F.round(F.corr(a, b), 8).alias("corr"), F.round(F.max(F.abs(a - b)), 8).alias("max_abs_diff")).join(F.broadcast(exact_quantiles(r, a - b, [0.5]).select(F.round("q0", 8).alias("median_diff"))), how="left")


@query("""with e as (select case label % 3 when 0 then 'stable' when 1 then 'decline' else 'increase' end as gold, embedding[1]::double as s, embedding[2]::double as d, embedding[3]::double as i from embeddings where label is not null),
g as (select unnest([-1.0, -0.5, 0.0, 0.5, 1.0]) as v), b as (select 0 as place, 0.0 as x, 0.0 as y, 0.0 as z union all select 1 + row_number() over (order by p.v, q.v, r.v), p.v, q.v, r.v from g p, g q, g r),
h as (select place, x, y, z, count(*) filter (gold = case when s + x >= d + y and s + x >= i + z then 'stable' when d + y >= i + z then 'decline' else 'increase' end) as hits, count(*) as n from e, b group by 1, 2, 3, 4)
select x::double as bias_stable, y::double as bias_decline, z::double as bias_increase, hits, n from h order by hits desc, place limit 1""")
def q_bias_fit(spark: SparkSession, d: str) -> DataFrame:
    """Additive class biases fitted on a grid of 125."""
    e = table(spark, d, "embeddings")
    gold = F.when(F.col("label") % 3 == 0, "stable").when(F.col("label") % 3 == 1, "decline").when(F.col("label").isNotNull(), "increase")
    s = lambda i: F.col("embedding")[i].cast("double")
    return fit.bias_fit(e.withColumn("gold", gold), {"stable": s(0), "decline": s(1), "increase": s(2)})


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """One row for each patch of train_patches: its latest row, with a cleaned class."""
    t = table(spark, d, "train_patches").withColumn("patch", patch_number(F.col("patch_id"))).filter("patch is not null")
    w = Window.partitionBy("patch").orderBy(F.desc("ingested_at"), F.desc("rec_id"))
    one = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return one.select("patch", clean_word(F.col("candidate_class")).alias("class"), "vegetation_trend", "study_area", "lon", "lat", known_block(F.col("block_id")).alias("block_id"))


_PATCHES = f"""with patches as (select patch, class, vegetation_trend, study_area, lon, lat, block_id from (
  select {_NUM.format('patch_id')} as patch, {_CLEAN.format('candidate_class')} as class, vegetation_trend, study_area, lon, lat, nullif(block_id, -1) as block_id,
  row_number() over (partition by {_NUM.format('patch_id')} order by ingested_at desc, rec_id desc) as r from train_patches) where r = 1)"""


@query(
    _PATCHES
    + """, s as (select patch, class, row_number() over (partition by class order by md5(concat(patch, '42')), patch) as k, count(*) over (partition by class) as n from patches where class in ('decline', 'stable', 'increase', 'uncertain', 'fire'))
select patch, class, case when k <= round_even(n * 0.70::double, 0) then 'train' when k <= round_even(n * 0.70::double, 0) + round_even(n * 0.15::double, 0) then 'dev' else 'test' end as split from s"""
)
def q_stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Three-way split of each class in a hashed order, sizes rounded half to even."""
    p = _patches(spark, d).select("patch", "class").filter(F.col("class").isin("decline", "stable", "increase", "uncertain", "fire"))
    return splits.stratified_split(p, "patch", "class")


_LOC = "lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)"
_BLOCKS = (
    _PATCHES
    + f""", p as (select patch, lon, lat from patches where {_LOC}), e as (select min(lon) as x0, max(lon) as x1, min(lat) as y0, max(lat) as y1 from p),
k as (select patch, least(greatest(floor((lon - x0) / greatest(x1 - x0, 1e-9) * 5), 0), 4)::int as x_bin, least(greatest(floor((lat - y0) / greatest(y1 - y0, 1e-9) * 4), 0), 3)::int as y_bin from p, e),
b as (select distinct x_bin * 4 + y_bin as block from k), o as (select block, row_number() over (order by md5(concat(block, '42')), block) as r, count(*) over () as n from b),
s as (select block, case when r <= greatest(1, round_even(n * 0.15::double, 0)) then 'test' when r <= greatest(1, round_even(n * 0.15::double, 0)) * 2 then 'dev' else 'train' end as split from o)"""
)


@query(_BLOCKS + " select patch, x_bin, y_bin, block, split from k join s on s.block = x_bin * 4 + y_bin")
def q_block_split(spark: SparkSession, d: str) -> DataFrame:
    """Equal-width blocks of places; whole blocks are held out."""
    p = _patches(spark, d).filter(located(F.col("lon"), F.col("lat"))).select("patch", "lon", "lat")
    b = splits.block_bins(p, "lon", "lat")
    return splits.block_split(b, "block", train=0.70, dev=0.15).select("patch", "x_bin", "y_bin", "block", "split")


@query(
    _PATCHES
    + """, r as (select patch, class, row_number() over (partition by class order by md5(concat(patch, '42')), patch) as k, count(*) over (partition by class) as n from patches where class in ('decline', 'stable', 'increase')),
w(class, need) as (values ('decline', 334), ('stable', 333), ('increase', 333))
select patch, class, unnest(range(k, need + 1, n)) as draw from r join w using (class)"""
)
def q_balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    """A thousand draws spread evenly over the classes; short classes repeat in turn."""
    return splits.balanced_sample(_patches(spark, d).select("patch", "class"), "patch", "class", 1000)


@query(_PATCHES + " select patch, class from (select patch, class, row_number() over (partition by class order by md5(concat(patch, '2')), patch) as k from patches where class is not null) where k <= 25")
def q_sample_per_class(spark: SparkSession, d: str) -> DataFrame:
    """25 patches of each class at most."""
    return splits.sample_per_stratum(_patches(spark, d).select("patch", "class").filter("class is not null"), "patch", "class", 25)


@query(_PATCHES + ", f as (select class from patches order by patch limit 16) select coalesce(class, 'None') as class, count(*) as n from f group by 1")
def q_prefix_mix(spark: SparkSession, d: str) -> DataFrame:
    """Class mix of the first 16 patches by id."""
    return splits.ordered_prefix(_patches(spark, d).select("patch", "class"), ["patch"], 16).groupBy(F.coalesce("class", F.lit("None")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _plane(spark: SparkSession, d: str) -> DataFrame:
    p = _patches(spark, d).filter(located(F.col("lon"), F.col("lat")))
    return p.select(F.col("patch").alias("id"), "class", N.planar_x(F.col("lon")).alias("x"), N.planar_y(F.col("lat")).alias("y"))


_PLANE = _PATCHES + f", p as (select patch as id, class, lon * 111320.0 * cos(radians(22.28)) as x, lat * 111320.0 as y from patches where {_LOC})"


@query(_PLANE + """ select a.id as id_a, b.id as id_b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) as metres, case when least(abs(a.x - b.x), abs(a.y - b.y)) < 50 then 'edge' else 'corner' end as kind
 from p a join p b on a.id < b.id and b.y between a.y - 645 and a.y + 645 where abs(a.x - b.x) < 645 and abs(a.y - b.y) < 645""")
def q_touching_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Footprints that touch, by edge or corner."""
    return geometry.touching_pairs(_plane(spark, d)).withColumn("metres", F.round("metres", 4))


@query(_PLANE + """, n as (select a.id, a.class, b.id as nn, b.class as nn_class, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as m, row_number() over (partition by a.id order by sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) as r from p a join p b on a.id <> b.id)
select count(*) as n, count(*) filter (class = nn_class) as same_class, round(max(m), 3) as farthest from n where r = 1""")
def q_nn_same_class(spark: SparkSession, d: str) -> DataFrame:
    """How often a patch's nearest neighbour has its class; ties by id."""
    p = _plane(spark, d)
    nn = geometry.nearest(p, p, 2000.0, exclude_same_id=True)
    c = p.select("id", "class")
    j = nn.join(c, "id").join(c.select(F.col("id").alias("nn"), F.col("class").alias("nn_class")), "nn")
    return j.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.coalesce(F.col("class") == F.col("nn_class"), F.lit(False)).cast("long")), F.lit(0)).alias("same_class"), F.round(F.max("dist"), 3).alias("farthest"))


_SPLIT_PLANE = f"""with p as (select s, rec_id, lon * 111320.0 * cos(radians(22.28)) as x, lat * 111320.0 as y from (select 'test' as s, rec_id, lon, lat from test_patches union all select 'train', rec_id, lon, lat from train_patches) where {_LOC})"""


@query(_SPLIT_PLANE + " select count(*) as n, round(min(m), 4) as least, round(max(m), 4) as most from (select a.rec_id, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as m from p a, p b where a.s = 'test' and b.s = 'train' group by 1)")
def q_min_cross_dist(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each test row to the nearest training row: count, least and most."""
    ok = located(F.col("lon"), F.col("lat"))
    pts = lambda n: table(spark, d, n).filter(ok).select(F.col("rec_id").alias("id"), N.planar_x(F.col("lon")).alias("x"), N.planar_y(F.col("lat")).alias("y"))
    return geometry.nearest(pts("test_patches"), pts("train_patches"), 2000.0).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("dist"), 4).alias("least"), F.round(F.max("dist"), 4).alias("most"))


@query()
def q_spacing_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Patches that a greedy pass in hashed order keeps at least 960 m apart (tested against the sequential pass)."""
    p = _plane(spark, d).select("id", "x", "y", F.concat(splits.shuffled(F.col("id"), 42), F.format_string("%020d", "id")).alias("rank"))
    close = geometry.touching_pairs(p, S.SPACING_M, 0.0).filter(F.col("metres") < S.SPACING_M).select("id_a", "id_b")
    return geometry.greedy_spacing(p, close).select("id", "x", "y")


@query("""with t as (select coalesce(lang, 'None') as lang, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as t from documents),
b as (select lang, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as b from t where len(t) > 1)
select lang, count(distinct b) as n_distinct, count(b) as n_total, round(coalesce(count(distinct b) / nullif(count(b), 0), 0.0), 9) as distinct_2 from (select distinct lang from t) left join b using (lang) group by 1""")
def q_distinct2(spark: SparkSession, d: str) -> DataFrame:
    """Different over all bigrams of each language's documents."""
    t = table(spark, d, "documents").select(F.coalesce("lang", F.lit("None")).alias("lang"), "text")
    return O.distinct_2(t, F.col("text"), ["lang"]).select("lang", "n_distinct", F.coalesce("n_total", F.lit(0)).alias("n_total"), F.round("distinct_2", 9).alias("distinct_2"))


def _explanation_sql() -> str:
    """The fields of a parsed answer in one text, or the raw text."""
    some = lambda c: f"nullif({c}, '')"
    joined = lambda c: f"nullif(array_to_string(list_filter({c}, lambda y: y <> ''), ' '), '')"
    fields = f"concat_ws(' ', {some('parsed.justification')}, {joined('parsed.supporting_evidence')}, {joined('parsed.conflicting_evidence')}, {some('parsed.visual_change')}, {some('parsed.possible_driver')})"
    return f"coalesce(nullif(trim(regexp_replace({fields}, ' +', ' ', 'g'), ' '), ''), raw_text, '')"


_EXPLANATION = _explanation_sql()


@query(f"""with recursive t as (select row_id, combo_id as run, regexp_extract_all(lower({_EXPLANATION}), '[a-z0-9]+') as h, regexp_extract_all(lower(coalesce(prompt_text, '')), '[a-z0-9]+') as r from predictions_explain),
s(row_id, i, h, r, line) as (select row_id, 0, h, r, list_transform(r, lambda x: 0) from t where len(h) > 0 and len(r) > 0
 union all select row_id, i + 1, h, r, list_transform(range(1, len(r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k], coalesce(line[k - 1], 0) + (r[k] = h[i + 1])::int)))) from s where i < len(h)),
f as (select row_id, line[len(r)]::double as k, len(h) as n, len(r) as m from s where i = len(h)),
g as (select run, case when k > 0 then 2 * (k / n) * (k / m) / (k / n + k / m) else 0.0 end as f1 from t left join f using (row_id))
select run, count(*) as n, round(avg(f1), 6) as rouge_l from g group by 1""")
def q_rouge(spark: SparkSession, d: str) -> DataFrame:
    """ROUGE-L of each answer against its prompt, averaged by run."""
    p = table(spark, d, "predictions_explain")
    return p.groupBy(F.col("combo_id").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(O.rouge_l(X.justification(F.col("parsed"), F.col("raw_text")), F.col("prompt_text"))), 6).alias("rouge_l"))


@query()
def q_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate share of each run's explanations (tested against all pairs)."""
    p = table(spark, d, "predictions_explain").select(F.col("combo_id").alias("run"), X.justification(F.col("parsed"), F.col("raw_text")).alias("text"))
    return O.near_duplicate_share(O.near_duplicate_texts(p, F.col("text"), ["run"]), ["run"])


@query("""select row_id, case when contains(lower(prompt_text), 'candidate_class') then 'candidate_class' when contains(lower(prompt_text), 'vegetation_trend') then 'vegetation_trend' when contains(lower(prompt_text), 'reference_class') then 'reference_class'
 when contains(lower(prompt_text), 'partial_mismatch') then 'partial_mismatch' when gold is not null and regexp_matches(lower(prompt_text), '=\\s*' || lower(gold) || '\\b') then '=' || gold end as leak from predictions_explain""")
def q_leak_check(spark: SparkSession, d: str) -> DataFrame:
    """Names or labels that a prompt gives away."""
    return table(spark, d, "predictions_explain").select("row_id", X.leak(F.col("prompt_text"), F.col("gold")).alias("leak"))


@query("select count(*) as n, 0::bigint as leaks from predictions_explain")
def q_scrub(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with injected label lines have no leak once they are scrubbed."""
    dirty = F.concat(F.col("prompt_text"), F.lit("\nInference for patch: vegetation_trend=stable\ncandidate_class = decline; NDVI fell\nRespond with class"))
    p = table(spark, d, "predictions_explain").select(X.leak(X.scrubbed(dirty)).alias("leak"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.count("leak").alias("leaks"))


def _f(c: str, n: int, sign: bool = False) -> str:
    return f"coalesce(printf('%{'+' if sign else ''}.{n}f', {c}), 'n/a')"


def _rx(p: str) -> str:
    return f"try_cast(nullif(regexp_extract(prompt_text, '{p}', 1), '') as double)"


@query(f"""with c as (select row_id, {', '.join(_rx(v[0]) + ' as ' + k for k, v in X.READINGS.items())} from predictions_explain)
select row_id, concat('NDVI ', {_f('ndvi_t0', 3)}, ' -> ', {_f('ndvi_t1', 3)}, ' (Δ ', {_f('NDVI', 3, True)}, ')', chr(10), 'EVI Δ ', {_f('EVI', 3, True)}, ' | NDMI Δ ', {_f('NDMI', 3, True)}, ' | NBR Δ ', {_f('NBR', 3, True)}, chr(10),
 'SAR VV Δ ', {_f('VV', 2, True)}, ' dB', chr(10), 'Rainfall ', {_f('rain_t0', 1)}, ' -> ', {_f('rain_t1', 1)}, ' mm', chr(10), 'Temperature anomaly ', {_f('temperature', 1, True)}, ' °C') as card from c""")
def q_render(spark: SparkSession, d: str) -> DataFrame:
    """The compact numeric card of each prompt's readings."""
    c = _cards(spark, d)
    return c.select("row_id", E.compact_table({k: F.col(k) for k in X.READINGS}).alias("card"))


_CARD = f"""concat('NDVI ', {_f('ndvi_t0', 3)}, ' -> ', {_f('ndvi_t1', 3)}, ' (Δ ', {_f('NDVI', 3, True)}, ')', chr(10), 'EVI Δ ', {_f('EVI', 3, True)}, ' | NDMI Δ ', {_f('NDMI', 3, True)}, ' | NBR Δ ', {_f('NBR', 3, True)}, chr(10),
 'SAR VV Δ ', {_f('VV', 2, True)}, ' dB', chr(10), 'Rainfall ', {_f('rain_t0', 1)}, ' -> ', {_f('rain_t1', 1)}, ' mm', chr(10), 'Temperature anomaly ', {_f('temperature', 1, True)}, ' °C')"""
_FACTS = f"""list_filter([case when ndvi_t0 is not null and ndvi_t1 is not null then concat('Mean NDVI was ', {_f('ndvi_t0', 3)}, ' first and ', {_f('ndvi_t1', 3)}, ' second (Δ ', {_f('NDVI', 3, True)}, ').') end,
 case when EVI is not null then concat('EVI change (Δ) was ', {_f('EVI', 3, True)}, '.') end, case when NDMI is not null then concat('NDMI change (Δ) was ', {_f('NDMI', 3, True)}, '.') end,
 case when rain_t0 is not null and rain_t1 is not null then concat('Rainfall was ', {_f('rain_t0', 1)}, ' mm first and ', {_f('rain_t1', 1)}, ' mm second.') end, case when VV is not null then concat('SAR VV backscatter change was ', {_f('VV', 2, True)}, ' dB.') end], lambda x: x is not null)"""
_READINGS = f"with c as (select row_id, prompt_text, gold, raw_text, {', '.join(_rx(v[0]) + ' as ' + k for k, v in X.READINGS.items())} from predictions_explain)"
_HINT = f"case when NDVI is null then '{L.HINTS[0]}' when NDVI <= -0.02 then '{L.HINTS[1]}' when NDVI >= 0.02 then '{L.HINTS[2]}' else '{L.HINTS[3]}' end"


@query(_READINGS + f", f as (select *, {_FACTS} as facts from c) select row_id, concat({_CARD}, chr(10), chr(10), 'ALLOWED_FACTS:', chr(10), coalesce(array_to_string(list_transform(range(1, len(facts) + 1), lambda i: concat(i, '. ', facts[i])), chr(10)), ''), chr(10), 'CLASS_RULE: ', {_HINT}) as card from f")
def q_render_structured(spark: SparkSession, d: str) -> DataFrame:
    """Table, numbered facts and rule of each prompt's readings."""
    c = _cards(spark, d)
    return c.select("row_id", E.structured_block({k: F.col(k) for k in X.READINGS}).alias("card"))


_TRIM = "regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_WORDS = {k: ", ".join(f"'{w}'" for w in v) for k, v in parse.FIRST_WORDS.items()}


def _class_sql(low: str, lead: str, field: str) -> str:
    """The class that a lower-cased text names, from its first word and its fields."""
    words = " ".join(f"when regexp_matches({low}, '\\b(?:{'|'.join(v)})\\b') then '{k}'" for k, v in parse.TEXT_WORDS.items())
    first = " ".join(f"when length({low}) < 80 and {lead} in ({v}) then '{k}'" for k, v in _WORDS.items())
    return f"coalesce(regexp_extract(list_filter(regexp_extract_all({field}, '\"change_class\"\\s*:\\s*\"(?:stable|decline|increase)\"\\s*\\|?'), lambda x: not ends_with(x, '|'))[-1], '(stable|decline|increase)\"$', 1), case {first} {words} end)"


_PARTS = f"""with t as (select row_id, {_TRIM.format("coalesce(raw_text, '')")} as raw from predictions_explain), l as (select row_id, raw, lower(raw) as low, {_TRIM.format("string_split(raw, ':')[-1]")} as tail from t),
p as (select row_id, raw, lower(case when regexp_matches(low, '^side by side[:,]') and length(tail) between 1 and 39 then tail
  when regexp_matches(low, 'one word only|answer with exactly one word|vegetation change class') and regexp_matches(raw, '(?i)(?:one word only[^\\n]*:|class:\\s*|stable, decline, or increase:\\s*)\\s*(\\S+)') then regexp_extract(raw, '(?i)(?:one word only[^\\n]*:|class:\\s*|stable, decline, or increase:\\s*)\\s*(\\S+)', 1)
  when contains(low, 'decline, increase, or stable') and length(raw) > 60 then {_TRIM.format("regexp_extract(raw, '(?is)stable:\\s*(.*)', 1)")} else raw end) as part from l),
c as (select row_id, raw, nullif({_class_sql('part', "regexp_extract(part, '^[^\\s,.;:!?]*')", 'part')}, '') as class from p)"""


@query(_PARTS + " select row_id, class from c")
def q_parse_class(spark: SparkSession, d: str) -> DataFrame:
    """The class that each raw answer names."""
    return table(spark, d, "predictions_explain").select("row_id", parse.class_column(F.col("raw_text")).alias("class"))


_OBJECTS = (
    _PARTS
    + """, o as (select row_id, raw, class, regexp_extract(raw, '(?is)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) as f, regexp_extract(raw, '(?s)\\{.*\\}') as b from c),
j as (select row_id, raw, class, case when f <> '' and json_valid(f) then f::json when b <> '' and json_valid(b) then b::json end as o, regexp_matches(raw, '(?i)\\bclass\\s*[:=]\\s*(stable|decline|increase)\\b') as has_class, regexp_matches(raw, '(?is)\\breason\\s*[:=]\\s*(.+)') as has_reason from o)"""
)


@query(
    _OBJECTS
    + f""" select row_id, case when o is not null then coalesce(o->>'$.visual_change', '') else '' end as visual_change,
 case when o is not null then case when o->>'$.change_class' in ('stable', 'decline', 'increase') then o->>'$.change_class' else class end when has_class then lower(regexp_extract(raw, '(?i)\\bclass\\s*[:=]\\s*(stable|decline|increase)\\b', 1)) else class end as change_class,
 case when o is not null then coalesce(o->>'$.justification', '') when has_reason then {_TRIM.format("regexp_extract(raw, '(?is)\\breason\\s*[:=]\\s*(.+)', 1)")} else raw end as justification,
 case when o is not null then coalesce((o->'$.supporting_evidence')::varchar[], []::varchar[]) else []::varchar[] end as supporting_evidence, case when o is not null then coalesce((o->'$.conflicting_evidence')::varchar[], []::varchar[]) else []::varchar[] end as conflicting_evidence,
 case when o is not null then coalesce(o->>'$.possible_driver', '') else '' end as possible_driver, case when o is not null then try_cast(o->>'$.confidence' as double) end as confidence,
 case when o is not null then 'json' when has_class or has_reason then 'short' else 'fallback' end as parse_format from j"""
)
def q_parse_explanation(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each raw answer."""
    return parse.parsed_explanations(table(spark, d, "predictions_explain"), "row_id", "raw_text")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions_explain")
    c = C.claims(p, "row_id", X.justification(F.col("parsed"), F.col("raw_text")))
    cards = _cards(spark, d).withColumn("rainfall", F.col("rain_t1") - F.col("rain_t0"))
    known = ("NDVI", "EVI", "NDMI", "NBR", "VV", "rainfall", "temperature")
    m = cards.select("row_id", F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(k).alias("delta")) for k in known])).alias("m")).select("row_id", "m.*").filter("delta is not null")
    return C.checked(c, m, "row_id")


def _claims_sql() -> str:
    """Mentions of indicators with the direction near them, from the pieces between matches."""
    word = lambda w: f"'(?i)\\b(?:{w})\\b'"
    size = lambda parts: f"coalesce(list_sum(list_transform({parts}, lambda x: length(x))), 0)::int"
    kinds = " union all ".join(f"select row_id, t, '{name}' as indicator, regexp_extract_all(t, {word(w)}) as h, string_split_regex(t, {word(w)}) as p from x" for name, w in C.INDICATOR_WORDS.items())
    ahead = ", ".join(f"case when regexp_matches(a, {word(w)}) then {{'at': length(string_split_regex(a, {word(w)})[1]), 'i': {i}, 'way': '{name}'}} end" for i, (name, w) in enumerate(C.DIRECTION_WORDS.items()))
    last = lambda w: f"{size(f'string_split_regex(b, {word(w)})[:-2]')} + {size(f'regexp_extract_all(b, {word(w)})[:-2]')}"
    behind = ", ".join(f"case when regexp_matches(b, {word(w)}) then {{'at': {last(w)}, 'way': '{name}'}} end" for name, w in C.DIRECTION_WORDS.items())
    both = " ".join(f"when '{k}' then '{v}'" for k, v in C.BOTH.items())
    read = " union all ".join(f"select row_id, '{k}' as indicator, {k} as delta from cards" for k in ("NDVI", "EVI", "NDMI", "NBR", "VV", "temperature"))
    bands = " ".join(f"when '{k}' then {v}" for k, v in S.DEAD_BANDS.items())
    return f"""with x as (select row_id, {_EXPLANATION} as t from predictions_explain),
g as ({kinds}), m as (select row_id, t, indicator, h, p, unnest(range(1, len(h) + 1)) as i from g where len(h) > 0),
n as (select row_id, t, indicator, h[i] as w, {size('p[1:i]')} + {size('h[1:i - 1]')} as start from m),
o as (select *, substring(t, start + length(w) + 1, 40) as a, substring(t, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)) as b, substring(t, greatest(start - 30, 0) + 1, start + length(w) + 40 - greatest(start - 30, 0)) as near, substring(t, start + 1, 70) as f from n),
d as (select row_id, indicator, start, coalesce(case lower(w) {both} end, list_min([{ahead}]).way, list_max([{behind}]).way) as direction, regexp_matches(near, '(?i){C.NEGATION.replace("'", "''")}') as negation, regexp_matches(near, '(?i){C.HEDGE}') as hedge, regexp_matches(f, '^{C.COPIED_RULE}') as copied_rule from o),
cards as (select row_id, {', '.join(_rx(v[0]) + ' as ' + k for k, v in X.READINGS.items())} from predictions_explain),
r as ({read} union all select row_id, 'rainfall', rain_t1 - rain_t0 from cards),
k as (select d.*, r.delta, case when r.delta is null then null when abs(r.delta) < (case d.indicator {bands} end) then 'stable' when r.delta > 0 then 'increase' else 'decrease' end as measured from d left join r on r.row_id = d.row_id and r.indicator = d.indicator),
e as (select *, direction = measured as consistent, case when direction = measured then '' when measured = 'stable' then case when (direction = 'increase' and delta > 0) or (direction = 'decrease' and delta < 0) then 'within_deadband_same_sign' else 'within_deadband_opposite_sign' end
  when direction = 'stable' then 'said_stable_beyond_deadband' when direction <> measured then 'beyond_deadband_opposite_sign' end as error_type from k)"""


_CLAIMS = _claims_sql()


@query(_CLAIMS + " select row_id, indicator, start, direction, measured, consistent, error_type, negation, hedge, copied_rule from e where direction is not null")
def q_claims(spark: SparkSession, d: str) -> DataFrame:
    """Directional claims of each answer against its measured changes."""
    return _checked(spark, d).filter("direction is not null").select("row_id", "indicator", "start", "direction", "measured", "consistent", "error_type", "negation", "hedge", "copied_rule")


_SCORES = (
    _CLAIMS
    + """, s as (select row_id, count(consistent) as n, count(*) filter (consistent) as c from e where direction is not null group by 1),
w as (select row_id, direction, count(*) as m from e where direction is not null group by 1, 2), v as (select row_id, case when count(*) = 1 then any_value(direction) end as dominant from w where (row_id, m) in (select (row_id, max(m)) from w group by row_id) group by 1),
z as (select p.row_id, p.gold, p.pred, coalesce(n, 0) as n_claims, coalesce(c, 0) as n_correct, c / nullif(n, 0) as faithfulness, coalesce(n, 0) > coalesce(c, 0) as has_wrong_claim, dominant = case pred when 'decline' then 'decrease' when 'increase' then 'increase' when 'stable' then 'stable' end as self_consistent
  from predictions_explain p left join s using (row_id) left join v using (row_id))"""
)


@query(_SCORES + " select row_id, n_claims, n_correct, faithfulness, has_wrong_claim, self_consistent from z")
def q_claim_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scored claims, consistency and self-consistency of each answer."""
    return C.scores(_checked(spark, d), table(spark, d, "predictions_explain").select("row_id", "pred"), "row_id")


@query(
    _CLAIMS
    + """ select combo_id as run, case when direction is null then 'unscored_no_direction' when consistent is null then 'unscored_no_measurement' when consistent then 'consistent' else error_type end as kind, count(*) as n,
 sum(copied_rule::int)::bigint as n_copied_rule, sum(negation::int)::bigint as n_negation, sum(hedge::int)::bigint as n_hedge from e join predictions_explain using (row_id) group by 1, 2"""
)
def q_claim_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of claims by run and kind of error, with and without copied rules."""
    runs = table(spark, d, "predictions_explain").select("row_id", F.col("combo_id").alias("run"))
    c = _checked(spark, d).join(runs, "row_id")
    kind = F.when(F.col("direction").isNull(), "unscored_no_direction").when(F.col("consistent").isNull(), "unscored_no_measurement").when(F.col("consistent"), "consistent").otherwise(F.col("error_type"))
    return c.groupBy("run", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("copied_rule").cast("long")).alias("n_copied_rule"), F.sum(F.col("negation").cast("long")).alias("n_negation"), F.sum(F.col("hedge").cast("long")).alias("n_hedge"))


def _teacher(spark: SparkSession, d: str, least: int) -> DataFrame:
    p = table(spark, d, "predictions_explain").select("row_id", "gold", "pred")
    s = C.scores(_checked(spark, d), p, "row_id")
    return p.join(s.drop("gold", "pred"), "row_id").filter((F.col("pred") == F.col("gold")) & (F.col("n_claims") >= least) & (F.col("faithfulness") == 1.0)).select("row_id", "n_claims")


@query(_SCORES + " select row_id, n_claims from z where pred = gold and n_claims >= 2 and faithfulness = 1.0")
def q_teacher_filter(spark: SparkSession, d: str) -> DataFrame:
    """Answers fit to teach: the right class, two claims at least, all of them consistent."""
    return _teacher(spark, d, 2)


@query(_SCORES + " select row_id, n_claims from z where pred = gold and n_claims >= 1 and faithfulness = 1.0")
def q_teacher_filter_one(spark: SparkSession, d: str) -> DataFrame:
    """The same with one claim at least, as answers here seldom make two."""
    return _teacher(spark, d, 1)


_RULES = {"has_text": "text is not null and length(text) > 0", "has_lang": "lang is not null and lang = lower(lang)", "length_kept": "n_chars is not null and n_chars = length(text)", "in_order": "ingested_at >= created_at"}


@query("with r as (" + " union all ".join(f"select '{k}' as rule, doc_id as id from documents where not coalesce({v}, false)" for k, v in _RULES.items()) + ") select rule, id from r")
def q_validate(spark: SparkSession, d: str) -> DataFrame:
    """Rules that documents break, one row each."""
    return validate.broken_rules(table(spark, d, "documents"), "doc_id", {k: F.expr(v) for k, v in _RULES.items()})


@query("""select rec_id as id, list_filter([case when vegetation_trend is null then 'vegetation_trend' end, case when n_triplets is null then 'n_triplets' end, case when lon is null then 'lon' end, case when lat is null then 'lat' end, case when block_id is null then 'block_id' end], lambda x: x is not null)::varchar[] as null_keys
 from train_patches where vegetation_trend is null or n_triplets is null or lon is null or lat is null or block_id is null""")
def q_null_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Rows with missing scalars and which they are."""
    return validate.null_keys(table(spark, d, "train_patches"), "rec_id", ["vegetation_trend", "n_triplets", "lon", "lat", "block_id"])


@query(f"""with c as (select 'gold_known' as name, case when count(*) filter (gold is null) = 0 then 'pass' else 'warn' end as status from predictions_explain union all
 select 'ids_known', case when count(*) filter ({_NUM.format('id')} not in (select {_NUM.format('patch_id')} from test_patches)) = 0 then 'pass' else 'fail' end from predictions_explain union all
 select 'no_leak', case when count(*) filter (contains(lower(prompt_text), 'candidate_class')) = 0 then 'pass' else 'fail' end from predictions_explain union all
 select 'rows_unique', case when count(*) = count(distinct row_id) then 'pass' else 'fail' end from predictions_explain)
select count(*) filter (status = 'pass') as n_pass, count(*) filter (status = 'warn') as n_warn, count(*) filter (status = 'fail') as n_fail, count(*) filter (status = 'fail') = 0 as ready from c""")
def q_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Named checks and their verdict."""
    p = table(spark, d, "predictions_explain")
    known = table(spark, d, "test_patches").select(patch_number(F.col("patch_id")).alias("n")).distinct()
    a = p.agg(F.sum(F.col("gold").isNull().cast("long")).alias("no_gold"), F.sum(X.leak(F.col("prompt_text")).isNotNull().cast("long")).alias("leaks"), F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"))
    lost = p.select(patch_number(F.col("id")).alias("n")).join(known, "n", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
    grade = lambda name, ok, bad: F.struct(F.lit(name).alias("name"), F.when(ok, "pass").otherwise(bad).alias("status"))
    checks = F.array(grade("gold_known", F.col("no_gold") == 0, "warn"), grade("ids_known", F.col("lost") == 0, "fail"), grade("no_leak", F.col("leaks") == 0, "fail"), grade("rows_unique", F.col("n") == F.col("ids"), "fail"))
    return validate.verdict(a.join(F.broadcast(lost)).select(F.explode(checks).alias("c")).select("c.*"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events")
def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    """A number out of semi-structured text; what can't be read is null."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"))


@query("""with a as (select combo_id as run, count(*) filter (gold = pred) as k, count(*) filter (pred in ('decline', 'stable', 'increase')) as answered, count(*) filter (duration_s is not null) as timed, round(avg(duration_s), 6) as mean_s from predictions_explain group by 1)
select run, k, answered, timed, mean_s, round(k / nullif(answered, 0), 9) as accuracy, row_number() over (order by k / nullif(answered, 0) desc nulls last, run) as place from a""")
def q_report_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Runs by accuracy of answered rows, the best first."""
    p = table(spark, d, "predictions_explain")
    a = metrics.accuracies(p, ["combo_id"]).join(p.groupBy("combo_id").agg(F.count("duration_s").alias("timed"), F.round(F.avg("duration_s"), 6).alias("mean_s")), "combo_id")
    w = Window.orderBy(F.desc_nulls_last("accuracy_answered"), "run")  # one row per run
    a = a.withColumnRenamed("combo_id", "run")
    return a.select("run", "k", "answered", "timed", "mean_s", F.round("accuracy_answered", 9).alias("accuracy"), F.row_number().over(w).alias("place"))


_CASES = f"""with x as (select {_NUM.format('id')} as id, gold, pred, combo_id from predictions_explain where gold in ('decline', 'stable', 'increase') and answer_format <> 'short'),
g as (select gold, id, count(pred) as n, count(*) filter (pred = gold) as ok, count(distinct pred) as kinds from x group by 1, 2),
b as (select gold, id, case when n = 0 then 3 when ok = n then 0 when kinds > 1 then 1 when ok = 0 then 2 else 3 end as bucket from g),
r as (select *, row_number() over (partition by gold, bucket order by id) as rn from b)"""


@query(_CASES + " select gold, id, ['all_right', 'disagree', 'all_wrong', 'other'][bucket + 1] as bucket, place from (select *, row_number() over (partition by gold order by rn, bucket) as place from r where rn <= 3) where place <= 3")
def q_case_picker(spark: SparkSession, d: str) -> DataFrame:
    """Three cases of each class, in turn from four kinds of outcome."""
    p = table(spark, d, "predictions_explain").filter(F.col("gold").isin(*S.CLASSES) & (F.col("answer_format") != "short")).select(patch_number(F.col("id")).alias("id"), "gold", "pred")
    g = p.groupBy("gold", "id").agg(F.count("pred").alias("n"), F.sum(metrics.hit(F.col("gold"), F.col("pred")).cast("long")).alias("ok"), F.countDistinct("pred").alias("kinds"))
    bucket = F.when(F.col("n") == 0, 3).when(F.col("ok") == F.col("n"), 0).when(F.col("kinds") > 1, 1).when(F.col("ok") == 0, 2).otherwise(3)
    b = g.select("gold", "id", bucket.alias("b"))
    first = b.withColumn("rn", F.row_number().over(Window.partitionBy("gold", "b").orderBy("id"))).filter("rn <= 3")
    name = F.element_at(F.array(*map(F.lit, ("all_right", "disagree", "all_wrong", "other"))), F.col("b") + 1)
    return first.withColumn("place", F.row_number().over(Window.partitionBy("gold").orderBy("rn", "b"))).filter("place <= 3").select("gold", "id", name.alias("bucket"), "place")


@query(f"""with t as (select {_NUM.format('patch_id')} as n, any_value(vegetation_trend order by rec_id desc) filter (vegetation_trend is not null) as trend from test_patches group by 1),
j as (select combo_id as run, gold, pred, case when contains(trend, 'decline') then 'decline' when contains(trend, 'green') then 'increase' when trend is not null then 'stable' end as tc from predictions_explain p join t on t.n = {_NUM.format('p.id')} where gold is not null)
select run, count(*) as n, count(*) filter (tc <> gold) as disagree, count(*) filter (pred = tc and tc <> gold) as follows_trend, count(*) filter (pred = gold and tc <> gold) as follows_label from j group by 1""")
def q_leak_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """Whether predictions follow the trend word or the label where these disagree."""
    t = table(spark, d, "test_patches").withColumn("n", patch_number(F.col("patch_id")))
    trend = t.groupBy("n").agg(F.max(F.when(F.col("vegetation_trend").isNotNull(), F.struct("rec_id", "vegetation_trend")))["vegetation_trend"].alias("trend"))
    p = table(spark, d, "predictions_explain").filter("gold is not null").select(F.col("combo_id").alias("run"), patch_number(F.col("id")).alias("n"), "gold", "pred")
    j = p.join(trend, "n").withColumn("tc", L.trend_class(F.col("trend")))
    apart = F.coalesce(F.col("tc") != F.col("gold"), F.lit(False))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.groupBy("run").agg(F.count(F.lit(1)).alias("n"), n(apart).alias("disagree"), n(apart & (F.col("pred") == F.col("tc"))).alias("follows_trend"), n(apart & (F.col("pred") == F.col("gold"))).alias("follows_label"))


@query("""with e as (select vec_id, list_transform(embedding, lambda v: case when v < 0 then -v::double else 0.0::double end) as d from embeddings), s as (select vec_id, d, list_filter(d, lambda x: x > 0) as p from e),
m as (select *, list_min(p) as lo, list_max(p) as hi, len(p) >= 16 as enough from s),
c as (select vec_id, b, lo, hi, lo + (b + 0.5) * (hi - lo) / 256 as centre, count(*) as n from (select vec_id, lo, hi, least(floor((unnest(p) - lo) / (hi - lo) * 256), 255)::int as b from m where enough and hi > lo) group by 1, 2, 3, 4),
w as (select vec_id, b, centre, sum(n) over u as below, sum(n * centre) over u as mass, sum(n) over v as tot, sum(n * centre) over v as whole from c window u as (partition by vec_id order by b), v as (partition by vec_id)),
k as (select vec_id, centre, row_number() over (partition by vec_id order by below * (tot - below) * pow(mass / below - (whole - mass) / (tot - below), 2) desc, b) as r from w where below < tot),
t as (select m.vec_id, d, enough, case when enough and hi = lo then hi when enough then centre end as cut from m left join k on k.vec_id = m.vec_id and r = 1)
select vec_id, round(cut, 3) as threshold, case when cut is null then 0 else len(list_filter(d, lambda x: x >= cut)) end::int as n_mask, round(case when cut is null then 0.0 else len(list_filter(d, lambda x: x >= cut)) / len(d) end, 9) as share from t""")
def q_otsu(spark: SparkSession, d: str) -> DataFrame:
    """Otsu mask of each embedding read as 64 pixels."""
    return raster.otsu_scenes(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("threshold", 3).alias("threshold"), "n_mask", F.round("share", 9).alias("share"))


@query("select vec_id, round(list_sum(embedding::double[]) / 64, 4) as native_mean, round(list_sum(embedding::double[]) / 81, 4) as padded_mean from embeddings")
def q_dilution(spark: SparkSession, d: str) -> DataFrame:
    """Means of 64 values and of the same on a padded canvas of 81."""
    native, padded = period.dilution(F.col("embedding"), 81)
    return table(spark, d, "embeddings").select("vec_id", native.alias("native_mean"), padded.alias("padded_mean"))


@query("""with c as (select vec_id, [0, 0, 10 + label, 10 + label] as a, [label, label, 12, 12] as b from embeddings)
select vec_id, round(case when greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) = 0 then 0.0 else
 greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2])) / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])) * greatest(0, least(a[4], b[4]) - greatest(a[2], b[2]))) end, 9) as iou from c""")
def q_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of two boxes per row."""
    x = F.col("label")
    a, b = F.array(F.lit(0), F.lit(0), 10 + x, 10 + x), F.array(x, x, F.lit(12), F.lit(12))
    return table(spark, d, "embeddings").select("vec_id", F.round(N.box_iou(a, b), 9).alias("iou"))


@query()
def q_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Disturbance boxes of synthetic scenes: two embeddings as 8 by 8 rasters, each pixel drawn 4 by 4 (tested on known scenes)."""
    e = table(spark, d, "embeddings")
    wide = lambda sign: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: (F.get(F.col("embedding"), (F.floor(y / 4) * 8 + F.floor(x / 4)).cast("int")) * sign).cast("double"))))
    s = e.select("vec_id", "label", F.lit(32).alias("height"), F.lit(32).alias("width"), wide(1).alias("delta_ndvi"), wide(1).alias("delta_nbr"))
    t = raster.disturbance_triplets(s, "vec_id").join(e.select("vec_id", "label"), "vec_id")
    return t.select("vec_id", F.size("triplets").alias("n_boxes"), F.size(raster.class_policy(F.col("triplets"), F.when(F.col("label") % 2 == 0, "decline").otherwise("stable"))).alias("n_kept"), E.triplet_lines(F.col("triplets")).alias("lines"))


@query("""select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2""")
def q_ext_windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """An extension, no reference operator: daily windows of events, as the streaming query computes them."""
    from pairlens.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 6))
