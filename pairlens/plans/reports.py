"""Further queries of the engine: ranges, sweeps, sensitivity, flows, manifests, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens import schemas as S
from pairlens.functions import numeric as N
from pairlens.functions import text as X
from pairlens.functions.keys import clean_word, patch_number
from pairlens.operators import evidence as E
from pairlens.operators import geometry, inference, metrics, period
from pairlens.operators.permutation import same_label_test
from pairlens.operators.spatial import located
from pairlens.plans.catalogue import _CARD, _CLEAN, _DN, _LOC, _NUM, _READINGS, _TESTS, PAIRS, _cards, _preds
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


@query(f"select gold as class, count(*) as n, min({_DN}) as least, max({_DN}) as most from predictions_explain where gold is not null and {_DN} is not null group by 1")
def q_class_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Range of the change of NDVI in each class."""
    return _cards(spark, d).filter("gold is not null and NDVI is not null").groupBy(F.col("gold").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.min("NDVI").alias("least"), F.max("NDVI").alias("most"))


@query("select floor(round(v / 0.02, 6))::bigint as bin, count(*) as n from (select " + _DN + " as v from predictions_explain) where v is not null group by 1")
def q_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Left-closed bins of the change of NDVI."""
    v = _cards(spark, d).select(F.col("NDVI").alias("v")).filter("v is not null")
    return v.groupBy(F.floor(F.round(F.col("v") / 0.02, 6)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""with k as (select combo_id as run, regexp_replace(combo_id, '_(s2|lora)$', '') as base, count(*) filter (gold = pred) as k, count(pred) as answered from predictions_explain group by 1)
select base, count(*) as n_runs, min(k) as k_min, max(k) as k_max, round(avg(k), 6) as k_mean, sum(answered)::bigint as answered from k group by 1""")
def q_seed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Least, most and mean hits of the runs of one base."""
    k = metrics.accuracies(_preds(spark, d), ["run"]).withColumn("base", F.regexp_replace("run", "_(s2|lora)$", ""))
    answered = _preds(spark, d).groupBy("run").agg(F.count("pred").alias("a"))
    return k.join(answered, "run").groupBy("base").agg(F.count(F.lit(1)).alias("n_runs"), F.min("k").alias("k_min"), F.max("k").alias("k_max"), F.round(F.avg("k"), 6).alias("k_mean"), F.sum("a").alias("answered"))


_OFF = f"""with off as (select row_id from predictions_explain where {_DN} is not null and gold is not null and gold <> case when {_DN} <= -0.02 then 'decline' when {_DN} >= 0.02 then 'increase' else 'stable' end)"""


@query(
    _OFF
    + """ select 'all' as subset, combo_id as run, count(*) as n, count(*) filter (gold = pred) as k from predictions_explain group by 2
union all select 'on_rule', combo_id, count(*), count(*) filter (gold = pred) from predictions_explain where row_id not in (select row_id from off) group by 2
union all select 'off_rule', combo_id, count(*), count(*) filter (gold = pred) from predictions_explain where row_id in (select row_id from off) group by 2"""
)
def q_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Scores on all rows, without those whose label is off the rule, and on these alone."""
    from pairlens.functions.labels import two_threshold

    off = _cards(spark, d).filter("NDVI is not null and gold is not null").filter(two_threshold(F.col("NDVI")) != F.col("gold")).select("row_id")
    p = _preds(spark, d)
    parts = {"all": p, "on_rule": p.join(off, "row_id", "left_anti"), "off_rule": p.join(off, "row_id", "left_semi")}
    return reduce(DataFrame.unionByName, [metrics.accuracies(x, ["run"]).select(F.lit(k).alias("subset"), "run", "n", "k") for k, x in parts.items()])


@query()
def q_permutation(spark: SparkSession, d: str) -> DataFrame:
    """Whether patches and their nearest neighbours share classes more often than chance: the latest row of each patch of all splits (random: no SQL)."""
    t = reduce(DataFrame.unionByName, [table(spark, d, f"{s}_patches") for s in ("train", "dev", "test")]).withColumn("id", patch_number(F.col("patch_id"))).filter("id is not null")
    w = Window.partitionBy("id").orderBy(F.desc("ingested_at"), F.desc("rec_id"))
    one = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").filter(located(F.col("lon"), F.col("lat")))
    p = materialize(one.select("id", clean_word(F.col("candidate_class")).alias("label"), N.planar_x(F.col("lon")).alias("x"), N.planar_y(F.col("lat")).alias("y")), "patches")
    return same_label_test(geometry.nearest(p, p, 5000.0, exclude_same_id=True), p, replicates=2000)


@query(f"""select 0 as step, 'rows' as what, count(*) as n from train_patches union all select 1, 'located', count(*) from train_patches where {_LOC}
union all select 2, 'with_class', count(*) from train_patches where {_LOC} and {_CLEAN.format('candidate_class')} in ('decline', 'stable', 'increase')
union all select 3, 'patches', count(distinct {_NUM.format('patch_id')}) from train_patches where {_LOC} and {_CLEAN.format('candidate_class')} in ('decline', 'stable', 'increase')""")
def q_flow(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each step of a construction keeps, in one pass."""
    t = table(spark, d, "train_patches").select(located(F.col("lon"), F.col("lat")).alias("l"), F.coalesce(clean_word(F.col("candidate_class")).isin(*S.CLASSES), F.lit(False)).alias("c"), patch_number(F.col("patch_id")).alias("p"))
    l, c = F.col("l"), F.col("l") & F.col("c")
    g = t.agg(F.count(F.lit(1)).alias("n0"), F.sum(l.cast("long")).alias("n1"), F.sum(c.cast("long")).alias("n2"), F.countDistinct(F.when(c, F.col("p"))).alias("n3"))
    names = ("rows", "located", "with_class", "patches")
    return g.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(w).alias("what"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("n")) for i, w in enumerate(names)])).alias("r")).select("r.*")


@query("""select combo_id as run, coalesce(max(answer_format) filter (answer_format <> 'short'), 'short') as prompt_style, count(*) as n_rows, count(distinct id) as n_ids, count(*) filter (parsed is null) as not_parsed,
 round(coalesce(sum(duration_s), 0.0), 3) as seconds, case when ends_with(combo_id, '_lora') then 'adapter' else 'base' end as kind from predictions_explain group by 1""")
def q_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest row for each run, with defaults for what is missing."""
    p = table(spark, d, "predictions_explain")
    return p.groupBy(F.col("combo_id").alias("run")).agg(
        F.coalesce(F.max(F.when(F.col("answer_format") != "short", F.col("answer_format"))), F.lit("short")).alias("prompt_style"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"),
        F.sum(F.col("parsed").isNull().cast("long")).alias("not_parsed"), F.round(F.coalesce(F.sum("duration_s"), F.lit(0.0)), 3).alias("seconds"),
    ).withColumn("kind", F.when(F.col("run").endswith("_lora"), "adapter").otherwise("base"))


@query("select combo_id as run, count(*) as n, count(*) filter (pred = parsed.change_class) as agree, round(count(*) filter (pred = parsed.change_class) / count(*), 6) as share from predictions_explain where pred is not null and parsed.change_class is not null group by 1")
def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often the stored prediction is the parsed class."""
    p = table(spark, d, "predictions_explain").filter("pred is not null and parsed.change_class is not null")
    same = F.sum((F.col("pred") == F.col("parsed.change_class")).cast("long"))
    return p.groupBy(F.col("combo_id").alias("run")).agg(F.count(F.lit(1)).alias("n"), same.alias("agree"), F.round(same / F.count(F.lit(1)), 6).alias("share"))


@query(f"""with b as (select block_id, (lat_min + lat_max) / 2 as lat, case when lon_min > lon_max then case when (lon_min + lon_max + 360) / 2 > 180 then (lon_min + lon_max + 360) / 2 - 360 else (lon_min + lon_max + 360) / 2 end else (lon_min + lon_max) / 2 end as lon from spatial_blocks)
select b.block_id, count(n_triplets) as n, round(avg(n_triplets), 6) as mean from b join (select * from train_patches where {_LOC}) t on t.lat between b.lat - 0.1 and b.lat + 0.1
 where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(t.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - b.lon) / 2), 2)))) <= 10000.0 and not (b.lon = 0 and b.lat = 0) group by 1""")
def q_region_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean boxes of the patches within 10 km of each block's middle."""
    across = F.when(F.col("lon_min") > F.col("lon_max"), F.col("lon_max") + 360).otherwise(F.col("lon_max"))
    mid = (F.col("lon_min") + across) / 2
    b = table(spark, d, "spatial_blocks").select("block_id", F.when(mid > 180, mid - 360).otherwise(mid).alias("lon"), ((F.col("lat_min") + F.col("lat_max")) / 2).alias("lat"))
    o = table(spark, d, "train_patches").select(F.col("rec_id").alias("obs_id"), "lon", "lat", "n_triplets")
    return period.region_means(b, o, 10_000.0, "block_id", "n_triplets").withColumn("mean", F.round("mean", 6))


@query("""with o as (select o_custkey, o_orderpriority, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, o_orderpriority) as r from orders group by 1, 2)
select t.o_custkey, round(median(o_totalprice), 6) as o_totalprice from orders t join o on o.o_custkey = t.o_custkey and o.o_orderpriority = t.o_orderpriority and r = 1 group by 1""")
def q_radar_composite(spark: SparkSession, d: str) -> DataFrame:
    """Medians over the observations of each key's dominant category."""
    return period.radar_composite(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice"], "o_orderpriority").withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("select l_returnflag, round(1 - avg((coalesce(l_linenumber not in (3, 8, 9, 10, 11), false))::int), 9) as masked_fraction from lineitem group by 1")
def q_masked_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows whose class is hidden."""
    return period.masked_fraction(table(spark, d, "lineitem"), ["l_returnflag"], period.visible(F.col("l_linenumber"))).withColumn("masked_fraction", F.round("masked_fraction", 9))


@query("select row_id, substring(trim(coalesce(raw_text, ''), ' '), 1, 200) as shown, length(coalesce(raw_text, '')) > 2000 as cut from predictions_explain")
def q_display(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 characters of each answer."""
    t = F.coalesce("raw_text", F.lit(""))
    return table(spark, d, "predictions_explain").select("row_id", F.substring(F.trim(t), 1, 200).alias("shown"), (F.length(t) > 2000).alias("cut"))


_NAMES = "candidate_class|vegetation_trend|reference_class|partial_mismatch"
_SCRUB = f"""trim(array_to_string(list_filter(list_transform(list_filter(string_split(coalesce(prompt_text, ''), chr(10)), lambda x: not starts_with(trim(lower(x), ' '), 'inference for') and not starts_with(trim(lower(x), ' '), 'respond with class')),
 lambda x: rtrim(regexp_replace(regexp_replace(x, '(?i)({_NAMES})\\s*=\\s*\\S+', '', 'g'), '(?i)\\b({_NAMES})\\b', '', 'g'), ' ')), lambda x: length(trim(x, ' ')) > 0), chr(10)), ' ')"""


@query(
    _READINGS
    + f""" select row_id, prompt_text as "full", {_SCRUB} as evidence_only, {_CARD} as compact, 'Judge the change from the images only.' as minimal,
 concat('{{"change_class": ', to_json(coalesce(gold, 'unknown')), ', "vegetation_trend": null, "disturbance_present": false, "explanation": ', to_json(coalesce(raw_text, '')), '}}') as target from c"""
)
def q_prompt_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each prompt in its four modes: full, scrubbed, compact card, minimal; and its target object."""
    p = table(spark, d, "predictions_explain")
    c = p.select("row_id", "prompt_text", "gold", "raw_text", *[X.reading(F.col("prompt_text"), *v).alias(k) for k, v in X.READINGS.items()])
    return c.select("row_id", F.col("prompt_text").alias("full"), X.scrubbed(F.col("prompt_text")).alias("evidence_only"), E.compact_table({k: F.col(k) for k in X.READINGS}).alias("compact"), F.lit("Judge the change from the images only.").alias("minimal"), E.target_json(F.col("gold"), F.lit(None).cast("string"), F.lit(False), F.col("raw_text")).alias("target"))


_ON_RULE = _TESTS.replace("from predictions_explain)", f"from predictions_explain where gold = case when {_DN} <= -0.02 then 'decline' when {_DN} >= 0.02 then 'increase' else 'stable' end and {_DN} is not null)", 1)


@query(_ON_RULE + " select family, run_a, run_b, n, b, c, round(p, 8) as p from p")
def q_sensitivity_tests(spark: SparkSession, d: str) -> DataFrame:
    """Unadjusted paired tests on the rows whose label is on the rule (the exact test has SQL in q_mcnemar)."""
    from pairlens.functions.labels import two_threshold
    from pairlens.sources.tables import keyed

    on = _cards(spark, d).filter(two_threshold(F.col("NDVI")) == F.col("gold")).select("row_id")
    p = _preds(spark, d).join(on, "row_id", "left_semi").withColumn("_key", F.concat_ws(" ", "run", "id"))
    one = keyed(p.withColumn("_order", F.struct("generated_at", "row_id")), "_key", "_order")
    return inference.paired_runs(one, spark.createDataFrame(PAIRS, "family string, run_a string, run_b string")).withColumn("p", F.round("p", 8))
