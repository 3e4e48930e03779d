"""Queries of record-level operators: signals, sentences, cleaning, formats, boxes, pixels, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions import labels as L
from pairlens.functions import numeric as N
from pairlens.functions import text as X
from pairlens.functions.keys import clean_word, known_block, patch_number
from pairlens.operators import enrich, evidence, geometry, metrics, period, raster, validate
from pairlens.operators.spatial import located, locate_in_regions
from pairlens.plans.catalogue import _CLEAN, _DN, _LOC, _NUM, _cards, _f, _preds, _rx
from pairlens.sources.tables import preferred_reports, resolved_models, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _scenes(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """The readings of each prompt in the roles of a scene; shares, masks and boxes are made of its numbers."""
    c = _cards(spark, d)
    col = F.col
    roles = {
        "NDVI": col("NDVI"), "NBR": col("NBR"), "VV": col("VV"), "rain": F.round(col("rain_t1") - col("rain_t0"), 4), "slope": col("rain_t0") / 8, "down": F.abs(col("EVI")), "up": F.abs(col("NDMI")),
        "mask_ndvi": F.coalesce(F.abs(col("EVI")), F.lit(0.0)), "mask_nbr": F.coalesce(F.abs(col("NDMI")), F.lit(0.0)), "boxes": F.pmod(col("row_id"), F.lit(3)), "label": col("gold"),
    }
    return c, roles


_READ = f"with c as (select row_id, gold, {', '.join(_rx(v[0]) + ' as ' + k for k, v in X.READINGS.items())} from predictions_explain)"
_SIGNALS = (
    _READ
    + """, r as (select *, round(rain_t1 - rain_t0, 4) as rain, rain_t0 / 8 as slope, coalesce(abs(EVI), 0.0) as m0, coalesce(abs(NDMI), 0.0) as m1, row_id % 3 as boxes from c),
t as (select *, case when NDVI <= -0.04 and coalesce(abs(EVI), 0) >= 0.08 then 'strong_decline' when NDVI <= -0.02 then 'moderate_decline' when NDVI >= 0.02 and coalesce(abs(NDMI), 0) >= 0.08 then 'greening' when NDVI >= 0.01 then 'slight_greening' else 'stable' end as trend from r),
s as (select *, case when m1 > m0 + 0.02 and coalesce(NBR, 0) < -0.02 then 'elevated_burn_signal' when m0 > 0.02 and boxes > 0 then 'deforestation_pattern' else 'low' end as burn,
 case when (gold = 'decline' and trend in ('strong_decline', 'moderate_decline')) or (gold = 'increase' and trend in ('greening', 'slight_greening')) or (gold = 'stable' and trend = 'stable' and boxes = 0) then 'agrees' when gold = 'stable' and boxes > 0 then 'spatial_anomaly' else 'partial_mismatch' end as consistency,
 case when abs(VV) >= 0.8 then 'notable_backscatter_shift' else 'secondary' end as radar, case when rain <= -25 then 'drier_second_window' when rain >= 25 then 'wetter_second_window' else 'neutral' end as rain_word,
 case when coalesce(slope, 0) >= 12 then 'steep_terrain' else 'gentle_terrain' end as ground from t)"""
)


@query(_SIGNALS + " select row_id, trend, burn, consistency, radar, rain_word as rain, ground, case when contains(trend, 'decline') then 'decline' when contains(trend, 'green') then 'increase' else 'stable' end as trend_class from s")
def q_signals(spark: SparkSession, d: str) -> DataFrame:
    """Trend, burn cue, consistency with the label and context of each prompt's readings."""
    c, roles = _scenes(spark, d)
    s = enrich.signals(roles)
    return c.select("row_id", *[v.alias(k) for k, v in s.items()], L.trend_class(s["trend"]).alias("trend_class"))


@query(
    _SIGNALS
    + f""" select row_id, concat(case trend when 'strong_decline' then 'Spectral loss dominates' when 'moderate_decline' then 'Moderate canopy loss is measured for' when 'greening' then 'Greening signal dominates' when 'slight_greening' then 'Slight greening is measured for' else 'Spectral stability dominates' end,
 ' ', row_id::varchar, ': NDVI Δ=', {_f('NDVI', 4, True)}, ', NBR Δ=', {_f('NBR', 4, True)}, '. SAR VV Δ', {_f('VV', 2, True)}, ' dB (', radar, '). Rain Δ', {_f('rain', 1, True)}, ' mm (', rain_word, '), ', ground, '. ',
 case when boxes > 0 then concat('Segmentation produced ', boxes::varchar, ' region(s).') else 'No boxes.' end, ' Inference: vegetation_trend=', trend, ', cue=', burn, ', candidate_class=', coalesce(gold, 'unknown'), ' (', consistency, ').') as summary from s"""
)
def q_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The signals of each prompt's readings in sentences."""
    c, roles = _scenes(spark, d)
    return c.select("row_id", enrich.summary(F.col("row_id").cast("string"), roles, enrich.signals(roles)).alias("summary"))


@query("""with e as (select vec_id, list_avg(embedding[1:16]::double[]) as a, list_avg(embedding[17:32]::double[]) as b, list_avg(embedding[33:48]::double[]) as c, list_avg(embedding[49:64]::double[]) as d from embeddings)
select vec_id, round(a, 4) as ndvi_t0, round(b, 4) as ndvi_t1, round(round(b, 4) - round(a, 4), 4) as ndvi_delta, round(round(d, 4) - round(c, 4), 4) as nbr_delta from e""")
def q_band_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Means of bands and the differences of the rounded means (a band is a quarter of each vector)."""
    mean = lambda k: F.aggregate(F.slice("embedding", 16 * k + 1, 16), F.lit(0.0), lambda a, x: a + x.cast("double")) / 16
    delta = enrich.rounded_deltas({"ndvi": mean(0), "nbr": mean(2)}, {"ndvi": mean(1), "nbr": mean(3)})
    return table(spark, d, "embeddings").select("vec_id", F.round(mean(0), 4).alias("ndvi_t0"), F.round(mean(1), 4).alias("ndvi_t1"), *[v.alias(f"{k}_delta") for k, v in delta.items()])


@query(f"""select row_id, case when {_DN} is null then 'Use NDVI trend only; if unclear, answer stable.' when {_DN} <= -0.02 then 'NDVI Δ ≤ −0.02 → decline.' when {_DN} >= 0.02 then 'NDVI Δ ≥ +0.02 → increase.' else 'NDVI Δ between −0.02 and +0.02 → stable.' end as hint,
 case when abs({_DN}) >= 0.2 then 'High' when abs({_DN}) >= 0.1 then 'Moderate' else 'Low' end as severity from predictions_explain""")
def q_hints(spark: SparkSession, d: str) -> DataFrame:
    """The rule in words and the bucket of severity of each change of NDVI."""
    return _cards(spark, d).select("row_id", L.hint_text(F.col("NDVI")).alias("hint"), L.severity(F.abs("NDVI"), 0.2, 0.1).alias("severity"))


_TOKEN = "case when {0} in ('decline', 'decrease', 'decreasing', 'decreased', 'loss', 'negative', 'declining') then 'decline' when {0} in ('increase', 'increasing', 'increased', 'gain', 'growth', 'positive') then 'increase' when {0} in ('stable', 'unchanged', 'no_change', 'no-change', 'same', 'neutral') then 'stable' end"


@query(f"select rec_id, {_TOKEN.format('c')} as token, {_TOKEN.format('v')} as trend from (select rec_id, {_CLEAN.format('candidate_class')} as c, {_CLEAN.format('vegetation_trend')} as v from train_patches)")
def q_class_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Classes from single words with their synonyms, here of classes and of trends."""
    t = table(spark, d, "train_patches")
    return t.select("rec_id", L.class_token(clean_word(F.col("candidate_class"))).alias("token"), L.class_token(clean_word(F.col("vegetation_trend"))).alias("trend"))


@query(f"select row_id, w as word, {_TOKEN.format('w')} as token from (select row_id, lower(regexp_extract(raw_text, '([A-Za-z_-]+)[^A-Za-z]*$', 1)) as w from predictions_explain where raw_text is not null)")
def q_last_word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The class that the last word of each answer stands for."""
    w = F.lower(F.regexp_extract("raw_text", "([A-Za-z_-]+)[^A-Za-z]*$", 1))
    return table(spark, d, "predictions_explain").filter("raw_text is not null").select("row_id", w.alias("word"), L.class_token(w).alias("token"))


@query("select rec_id, patch_id, candidate_class, vegetation_trend, n_triplets, has_reference, block_id, study_area, case when lat is null or isnan(lat) or lon is null or isnan(lon) then null else round(lat + lon, 6) end as total from train_patches")
def q_clean_records(spark: SparkSession, d: str) -> DataFrame:
    """Records without coordinates, their NaN numbers as null."""
    t = table(spark, d, "train_patches").withColumn("total", F.round(F.col("lat") + F.col("lon"), 6)).drop("exported_at", "ingested_at")
    return validate.without_coordinates(t)


@query("select * from (values ('lat'), ('lon'), ('place.Latitude'), ('seen.at.lon')) t(path)")
def q_coordinate_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a nested record that hold coordinates."""
    t = table(spark, d, "train_patches").select("rec_id", "lon", "lat", F.struct(F.col("lat").alias("Latitude"), "study_area").alias("place"), F.array(F.struct(F.struct("lon").alias("at"))).alias("seen"))
    return spark.createDataFrame([(p,) for p in validate.coordinate_paths(t.schema)], "path string")


@query("select combo_id as run, coalesce(printf('%.1f%%', count(*) filter (gold = pred) * 100.0 / count(*)), '—') as accuracy, coalesce(printf('%.1f%%', avg(case when duration_s > 1e9 then 1.0 end) * 100), '—') as slow from predictions_explain group by 1")
def q_percents(spark: SparkSession, d: str) -> DataFrame:
    """Accuracies as percent texts; a share of nothing is a dash."""
    g = table(spark, d, "predictions_explain").groupBy(F.col("combo_id").alias("run")).agg((F.sum(metrics.hit(F.col("gold"), F.col("pred"))) / F.count(F.lit(1))).alias("a"), F.avg(F.when(F.col("duration_s") > 1e9, 1.0)).alias("s"))
    return g.select("run", N.percent(F.col("a")).alias("accuracy"), N.percent(F.col("s")).alias("slow"))


@query("""with b as (select vec_id, label, [label, label * 2, 60 - label, 50 + label] as b from embeddings where label is not null),
p as (select vec_id, label, b, list_transform([(b[1] + 0) * 8.0, (b[2] + 8) * 8.0, (b[3] + 0) * 8.0, (b[4] + 8) * 8.0], lambda v: round_even(v, 0)::int) as q from b)
select vec_id, [least(greatest(q[1], 0), 511), least(greatest(q[2], 0), 511), least(greatest(q[3], 1), 512), least(greatest(q[4], 1), 512)]::int[] as padded,
 round(greatest(0, b[3] - b[1]) * greatest(0, b[4] - b[2]) / 262144.0, 4) as share from p""")
def q_padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of chips of 64 by 48 on the square canvas, and their share of it."""
    x = F.col("label").cast("int")
    box = F.array(x, x * 2, 60 - x, 50 + x)
    return table(spark, d, "embeddings").filter("label is not null").select("vec_id", raster.padded_box(box, F.lit(48), F.lit(64)).alias("padded"), raster.area_share(box).alias("share"))


@query("""with e as (select vec_id, list_transform(embedding, lambda v: abs(v)::double) as v from embeddings), m as (select vec_id, v, list_max(v) as top from e)
select vec_id, list_transform(v, lambda x: floor(least(greatest(x / (case when top > 1.5 then 10000.0 else 1.0 end) / 0.22, 0.0), 1.0) * 255)::int) as stretched,
 round(list_sum(list_transform(v, lambda x: least(greatest(x / (case when top > 1.5 then 255.0 else 1.0 end), 0.0), 1.0))) / len(v), 9) as mask_share from m""")
def q_stretched(spark: SparkSession, d: str) -> DataFrame:
    """Pixels stretched to 0..255 by a fixed window, and the share of a mask."""
    v = F.transform("embedding", lambda x: F.abs(x).cast("double"))
    return table(spark, d, "embeddings").select("vec_id", raster.stretched(v).alias("stretched"), F.round(raster.mask_share(v), 9).alias("mask_share"))


@query("""with e as (select vec_id, list_transform(embedding, lambda v: floor(abs(v) * 1000)::int % 256) as v from embeddings), p as (select vec_id, v[1:19] as r, v[21:39] as g, v[41:59] as b from e),
l as (select *, list_transform(range(1, 20), lambda i: (0.299 * r[i] + 0.587 * g[i] + 0.114 * b[i]) / 255) as lum, len(list_filter(range(1, 20), lambda i: g[i] > r[i] and g[i] > b[i])) / 19.0 as lead from p)
select vec_id, round(list_avg(r) / 255, 4) as mean_r, round(list_avg(g) / 255, 4) as mean_g, round(list_avg(b) / 255, 4) as mean_b, round(list_reduce(lum, lambda a, x: a + x) / 19, 4) as brightness_mean, round(list_stddev_pop(lum), 4) as brightness_std, round(lead, 4) as green_dominant_fraction from l""")
def q_rgb_stats(spark: SparkSession, d: str) -> DataFrame:
    """Means, brightness and green lead of three bands of pixels."""
    v = F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x) * 1000).cast("int"), F.lit(256)))
    band = lambda k: F.slice(v, 20 * k + 1, 19)
    return table(spark, d, "embeddings").select("vec_id", raster.rgb_stats(band(0), band(1), band(2)).alias("s")).select("vec_id", "s.*")


@query("select vec_id, vec_id % 3 <> 0 and label is not null and label % 2 = 0 as ok from embeddings")
def q_tensor_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether each tensor has the wanted shape and only finite values; here some are short and some hold a NaN."""
    e = table(spark, d, "embeddings")
    px = F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 60)).when(F.coalesce(F.col("label") % 2 != 0, F.lit(True)), F.array_append(F.slice("embedding", 1, 63), F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return e.select("vec_id", raster.tensor_ok(px, F.lit(8), F.lit(4), F.lit(2), (8, 4, 2)).alias("ok"))


@query(f"""select t.rec_id, round(sqrt(pow((b.lon_min - t.lon) * 111320.0 * cos(radians((t.lat + b.lat_min) / 2)), 2) + pow((b.lat_min - t.lat) * 111320.0, 2)), 3) as metres
 from (select * from train_patches where {_LOC}) t join spatial_blocks b on b.block_id = t.block_id""")
def q_corner_distances(spark: SparkSession, d: str) -> DataFrame:
    """Equirectangular metres from each row to the south-west corner of its block."""
    t = table(spark, d, "train_patches").filter(located(F.col("lon"), F.col("lat"))).select("rec_id", "lon", "lat", known_block(F.col("block_id")).alias("block_id"))
    b = table(spark, d, "spatial_blocks").select("block_id", "lon_min", "lat_min")
    return t.join(b, "block_id").select("rec_id", F.round(N.equirectangular_m(F.col("lon"), F.col("lat"), F.col("lon_min"), F.col("lat_min")), 3).alias("metres"))


@query("""with s as (select 2000 / 111320.0 as dy, 2000 / (111320.0 * cos(radians(22.5))) as dx), n as (select ceil(1.0 / dx - 1e-9)::int as nx, ceil(0.6 / dy - 1e-9)::int as ny, dx, dy from s),
g as (select unnest(range(nx * ny)) as i, nx, dx, dy from n)
select printf('p%05d', i) as patch_id, round(80.0 + (i % nx) * dx, 9) as lon, round(22.2 + floor(i / nx) * dy, 9) as lat from g""")
def q_grid(spark: SparkSession, d: str) -> DataFrame:
    """A regular grid of points two kilometres apart."""
    return geometry.grid(80.0, 22.2, 81.0, 22.8, 2000.0, spark).select("patch_id", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("""with r as (select combo_id as run, case when answer_format <> 'short' then 'structured' end as style, row_id, row_number() over (partition by combo_id order by (answer_format = 'short')::int, lpad(row_id::varchar, 12, '0')) as k from predictions_explain)
select run as combo_id, row_id, coalesce(style, 'legacy') as prompt_style from r where k = 1""")
def q_preferred_reports(spark: SparkSession, d: str) -> DataFrame:
    """One report of each run, a structured one before others; here each row is a report."""
    r = table(spark, d, "predictions_explain").select("combo_id", "row_id", F.when(F.col("answer_format") != "short", "structured").alias("prompt_style"), F.lpad(F.col("row_id").cast("string"), 12, "0").alias("file"))
    return preferred_reports(r).select("combo_id", "row_id", "prompt_style")


@query("""with x as (select combo_id as run, case when parsed is null then null else parsed.justification end as j from predictions_explain)
select run, count(distinct j) as n_unique, count(j) as n, round(count(distinct j) / nullif(count(j), 0), 9) as share from x group by 1""")
def q_unique_share(spark: SparkSession, d: str) -> DataFrame:
    """Different over all justifications of each run."""
    t = table(spark, d, "predictions_explain").select(F.col("combo_id").alias("run"), F.col("parsed.justification").alias("j"))
    return metrics.unique_share(t, "j", ["run"]).withColumn("share", F.round("share", 9))


@query("""with r as (select distinct combo_id, concat('base/', combo_id) as checkpoint from predictions_explain)
select combo_id, case when ends_with(combo_id, '_lora') then concat('adapter/', combo_id) else checkpoint end as checkpoint from r""")
def q_model_registry(spark: SparkSession, d: str) -> DataFrame:
    """The checkpoint of each run: its own where one is named, else the registry's."""
    r = table(spark, d, "predictions_explain").select("combo_id").distinct().withColumn("checkpoint", F.concat(F.lit("base/"), "combo_id"))
    own = r.filter(F.col("combo_id").endswith("_lora")).withColumn("checkpoint", F.concat(F.lit("adapter/"), "combo_id"))
    return resolved_models(r, own)


@query("""select doc_id, case when length(text) <= 417 then text else regexp_replace(substring(text, 1, 417), '[ \\t\\n\\x0B\\f\\r]+[^ \\t\\n\\x0B\\f\\r]*$', '') || ' …' end as shown from documents""")
def q_shortened(spark: SparkSession, d: str) -> DataFrame:
    """Texts as they are shown: up to 417 characters, cut at a blank."""
    return table(spark, d, "documents").select("doc_id", X.shortened(F.col("text")).alias("shown"))


@query("""select user_id, round(sum(value) filter (event_type <> 'error'), 6) as total from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-01-16' and event_type <> 'error' group by 1""")
def q_window_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums over one window by key, without hidden observations."""
    inside = (F.col("ts") >= F.lit("2024-01-01").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-16").cast("timestamp")) & (F.col("event_type") != "error")
    return period.composite(table(spark, d, "events"), ["user_id"], ["value"], inside, "sum").select("user_id", F.round("value", 6).alias("total"))


@query("""select rec_id, concat('{"change_class": "', coalesce(candidate_class, 'unknown'), '", "vegetation_trend": ', coalesce('"' || vegetation_trend || '"', 'null'), ', "disturbance_present": ', coalesce(n_triplets > 0, false)::varchar, ', "explanation": "', coalesce(study_area, ''), '"}') as target
 from train_patches where candidate_class is null or regexp_matches(candidate_class, '^[a-zA-Z]+$')""")
def q_targets(spark: SparkSession, d: str) -> DataFrame:
    """The supervision object of each record whose class is a plain word or missing, as JSON text."""
    t = table(spark, d, "train_patches").filter(F.col("candidate_class").isNull() | F.regexp_like("candidate_class", F.lit("^[a-zA-Z]+$")))
    return t.select("rec_id", evidence.target_json(F.col("candidate_class"), F.col("vegetation_trend"), F.col("n_triplets") > 0, F.col("study_area")).alias("target"))


@query(f"""with b as (select block_id, (lon_min + lon_max) / 2 as x, (lat_min + lat_max) / 2 as y, (lon_max - lon_min) / 2 as w, (lat_max - lat_min) / 2 as h from spatial_blocks where lon_min <= lon_max)
select t.rec_id, min(b.block_id) as block_id from (select * from train_patches where {_LOC}) t join b on abs(t.lon - b.x) / b.w + abs(t.lat - b.y) / b.h < 1 group by 1""")
def q_polygons(spark: SparkSession, d: str) -> DataFrame:
    """The polygon that contains each located row: of each block that doesn't cross the 180th meridian the ring of the middles of its sides."""
    b = table(spark, d, "spatial_blocks").filter("lon_min <= lon_max")
    mx, my = (F.col("lon_min") + F.col("lon_max")) / 2, (F.col("lat_min") + F.col("lat_max")) / 2
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    ring = F.array(point(F.col("lon_min"), my), point(mx, F.col("lat_max")), point(F.col("lon_max"), my), point(mx, F.col("lat_min")))
    return locate_in_regions(table(spark, d, "train_patches").select("rec_id", "lon", "lat"), b.withColumn("ring", ring), "rec_id", "block_id")


@query(f"""with t as (select distinct {_NUM.format('id')} as n from predictions_explain where gold is not null), p as (select {_NUM.format('patch_id')} as n, rec_id from test_patches)
select rec_id, p.n as patch from p join t on t.n = p.n""")
def q_required_rows(spark: SparkSession, d: str) -> DataFrame:
    """The test rows of the patches that gold answers ask for; an asked patch without a row would be an error."""
    from pairlens.sources.tables import require_all

    p = table(spark, d, "test_patches").select("rec_id", patch_number(F.col("patch_id")).alias("patch"))
    known = p.select("patch").distinct()
    asked = table(spark, d, "predictions_explain").filter("gold is not null").select(patch_number(F.col("id")).alias("patch")).join(known, "patch", "left_semi")
    return require_all(p, asked, "patch")


@query("select row_id, coalesce(pred, 'none') as pred, coalesce(gold = pred, false)::int as hit from predictions_explain")
def q_hits(spark: SparkSession, d: str) -> DataFrame:
    """Each answer's prediction and whether it is right; a missing one is wrong."""
    return _preds(spark, d).select("row_id", F.coalesce("pred", F.lit("none")).alias("pred"), metrics.hit(F.col("gold"), F.col("pred")).alias("hit"))
