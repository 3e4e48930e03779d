"""Problem 6: records of evaluation splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.keys import clean_word
from pairlens.operators.skew import lookup_join, salted_join
from pairlens.operators.spatial import near_join
from pairlens.session import materialize
from pairlens.sources.tables import table

SPOT_M = 30.0


def record_hash(text: Column) -> Column:
    """128-bit hash of a record's text after case, punctuation and white space are normalised; null for a text without a word."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(words) > 0, F.unhex(F.md5(words)))


def id_text(text: Column) -> Column:
    """An id as the words that are hashed: full-width digits become plain, marks between a letter and a digit and leading zeros go."""
    t = F.translate(F.lower(text), "０１２３４５６７８９", "0123456789")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?<=\p{L}) (?=\p{N})", ""), "(?<![0-9])0+(?=[0-9])", "")


def overlap_links(held_out: DataFrame, train: DataFrame, by: list[str], metres: float = SPOT_M) -> DataFrame:
    """(``by``, ``n_rows``, ``n_record``, ``n_spot``, ``n_links``): groups of held-out rows and the training rows that each row overlaps.

    Both sides are as in :func:`overlap_pairs`. Rows of one record at one place are counted before anything is joined, so
    no pairs of rows are formed: ``n_record`` sums the rows of a hash, ``n_spot`` those of the places near by, and what is both counts once in
    ``n_links``. With ``rec_id`` in ``by`` each row comes by itself. Rows without an overlap come with zeros.
    """
    place = lambda df, keep: df.select(*keep, "record", "lon", "lat").withColumn("_hash", record_hash(F.col("record"))).withColumn("_place", F.concat_ws(" ", F.coalesce(F.hex("_hash"), F.lit("-")), F.coalesce(F.col("lon").cast("string"), F.lit("-")), F.coalesce(F.col("lat").cast("string"), F.lit("-"))))
    fold = lambda df, name: materialize(df.groupBy("_place").agg(F.first("_hash").alias("_hash"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.count(F.lit(1)).alias("n")).withColumn("_id", F.monotonically_increasing_id()), name)
    held = place(held_out, by)
    h, t = fold(held, "held"), fold(place(train, []), "train")
    near = near_join(h, t, metres, "_id", "_id").select("id_l", "id_r")
    near = lookup_join(near, t.select(F.col("_id").alias("id_r"), F.col("_hash").alias("hash_r"), "n"), ["id_r"], F.col("id_l"))
    near = lookup_join(near, h.select(F.col("_id").alias("id_l"), F.col("_hash").alias("hash_l")), ["id_l"], F.col("id_r"))
    spots = near.groupBy(F.col("id_l").alias("_id")).agg(F.sum("n").alias("n_spot"), F.sum(F.when(F.col("hash_l") == F.col("hash_r"), F.col("n")).otherwise(0)).alias("n_both"))
    records = t.filter(F.col("_hash").isNotNull()).groupBy("_hash").agg(F.sum("n").alias("n_record"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    linked = h.select("_id", "_place", "_hash").join(records, "_hash", "left").join(spots, "_id", "left")
    linked = materialize(linked.select("_place", zero("n_record").alias("n_record"), zero("n_spot").alias("n_spot"), (zero("n_record") + zero("n_spot") - zero("n_both")).alias("n_links")), "links")
    rows = held.groupBy(*by, "_place").agg(F.count(F.lit(1)).alias("n_rows"))
    return lookup_join(rows, linked, ["_place"], F.concat_ws(" ", *[F.col(c).cast("string") for c in by])).drop("_place")


def overlap_pairs(held_out: DataFrame, train: DataFrame, metres: float = SPOT_M) -> DataFrame:
    """All pairs (``rec_held``, ``rec_train``, ``same_record``, ``same_spot``) of a held-out and a training row that overlap.

    Both sides need ``rec_id``, ``record`` (the text that identifies a record, or null), ``lon`` and ``lat``. Rows overlap when
    their canonical records hash alike, or both are located at most ``metres`` apart. A null record and a missing location
    match nothing. Each delivered row counts by itself; a pair that overlaps in both ways comes once. Other columns are
    ignored. Keys held by very many rows are split over tasks, and no pair is dropped.
    """
    h = held_out.select(F.col("rec_id").alias("rec_held"), record_hash(F.col("record")).alias("_hash")).filter(F.col("_hash").isNotNull())
    t = train.select(F.col("rec_id").alias("rec_train"), record_hash(F.col("record")).alias("_hash")).filter(F.col("_hash").isNotNull())
    same = salted_join(t, h, ["_hash"], F.col("rec_train")).select("rec_held", "rec_train", F.lit(True).alias("same_record"), F.lit(False).alias("same_spot"))
    near = near_join(held_out, train, metres, "rec_id", "rec_id").select(F.col("id_l").alias("rec_held"), F.col("id_r").alias("rec_train"), F.lit(False).alias("same_record"), F.lit(True).alias("same_spot"))
    return same.unionByName(near).groupBy("rec_held", "rec_train").agg(F.max("same_record").alias("same_record"), F.max("same_spot").alias("same_spot"))


def _split(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    df = table(spark, data_dir, name)
    return df.select("rec_id", id_text(F.col("patch_id")).alias("record"), "lon", "lat", "study_area", F.lit(name.removesuffix("_patches")).alias("split"))


def _held(spark: SparkSession, data_dir: str) -> DataFrame:
    return _split(spark, data_dir, "dev_patches").unionByName(_split(spark, data_dir, "test_patches"))


def p6_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """Each overlapping pair of an evaluation row and a training row, the smaller id first."""
    pairs = overlap_pairs(_held(spark, data_dir), _split(spark, data_dir, "train_patches"))
    return pairs.select(F.least("rec_held", "rec_train").alias("rec_a"), F.greatest("rec_held", "rec_train").alias("rec_b"))


def p6_report(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per split and study area: rows, rows with an overlap by record, by spot and by either, and the pairs, counted without forming them."""
    g = overlap_links(_held(spark, data_dir), _split(spark, data_dir, "train_patches"), ["split", "study_area"])
    some = lambda c: F.sum(F.when(F.col(c) > 0, F.col("n_rows")).otherwise(0))
    return g.groupBy("split", "study_area").agg(
        F.sum("n_rows").alias("n_rows"), some("n_record").alias("rows_same_record"), some("n_spot").alias("rows_same_spot"), some("n_links").alias("rows_overlapping"), F.sum(F.col("n_rows") * F.col("n_links")).alias("n_pairs")
    )


def p6_links(spark: SparkSession, data_dir: str) -> DataFrame:
    """One row for each evaluation row: how many training rows have its record, lie at its spot, or either."""
    return overlap_links(_held(spark, data_dir), _split(spark, data_dir, "train_patches"), ["rec_id", "split"]).drop("n_rows")


def p6_records(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per split and study area: rows whose whole record (id, class, trend, area, boxes, block, place to 4 digits) also stands in training, and the training rows of these."""

    def whole(name: str) -> DataFrame:
        t = table(spark, data_dir, name)
        text = [id_text(F.col("patch_id")), clean_word(F.col("candidate_class")), clean_word(F.col("vegetation_trend")), F.col("study_area"), *[F.col(c).cast("string") for c in ("n_triplets", "has_reference", "block_id")], *[F.format_string("%.4f", c) for c in ("lon", "lat")]]
        return t.select(F.lit(name.removesuffix("_patches")).alias("split"), "study_area", record_hash(F.concat_ws("|", *[F.coalesce(c, F.lit("none")) for c in text])).alias("_hash"))

    held = whole("dev_patches").unionByName(whole("test_patches")).groupBy("split", "study_area", "_hash").agg(F.count(F.lit(1)).alias("n"))
    known = whole("train_patches").groupBy("_hash").agg(F.count(F.lit(1)).alias("m"))
    j = held.join(known, "_hash", "left")
    return j.groupBy("split", "study_area").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("m").isNotNull(), F.col("n")).otherwise(0)).alias("rows_whole"), F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("n_pairs"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_links": p6_links, "p6_records": p6_records}

_WORD = "nullif(lower(regexp_replace({}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '')"
_LOC = "lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and lon between -180 and 180 and lat between -90 and 90 and not (lon = 0 and lat = 0)"
_PAIRS = f"""
with held as (select 'dev' as split, * from dev_patches union all select 'test' as split, * from test_patches),
h as (select rec_id, split, study_area, regexp_extract(patch_id, '(\\d+)', 1)::bigint as n, lon, lat, {_LOC} as ok from held),
t as (select rec_id, regexp_extract(patch_id, '(\\d+)', 1)::bigint as n, lon, lat, {_LOC} as ok from train_patches),
pairs as (
  select rid, tid, max(rec) as by_record, max(spot) as by_spot from (
    select h.rec_id as rid, t.rec_id as tid, 1 as rec, 0 as spot from h join t using (n)
    union all
    select h.rec_id, t.rec_id, 0, 1 from h join t on h.ok and t.ok and t.lat between h.lat - 0.0003 and h.lat + 0.0003
    where 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(t.lat - h.lat) / 2), 2)
        + cos(radians(h.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - h.lon) / 2), 2)))) <= 30.0)
  group by rid, tid)"""
SQL = {
    "p6_found": _PAIRS + " select least(rid, tid) as rec_a, greatest(rid, tid) as rec_b from pairs",
    "p6_report": _PAIRS
    + """ , per as (select rid, count(*) as pairs, max(by_record) as r, max(by_spot) as s from pairs group by rid)
select split, study_area, count(*) as n_rows, coalesce(sum(r), 0)::bigint as rows_same_record, coalesce(sum(s), 0)::bigint as rows_same_spot,
 count(pairs) as rows_overlapping, coalesce(sum(pairs), 0)::bigint as n_pairs
from h left join per on per.rid = h.rec_id group by split, study_area""",
    "p6_links": _PAIRS
    + """ , per as (select rid, count(*) filter (by_record = 1) as r, count(*) filter (by_spot = 1) as s, count(*) as n from pairs group by rid)
select rec_id, split, coalesce(r, 0) as n_record, coalesce(s, 0) as n_spot, coalesce(per.n, 0) as n_links from h left join per on per.rid = h.rec_id""",
    "p6_records": f"""with a as (select 'dev' as split, * from dev_patches union all select 'test', * from test_patches union all select 'train', * from train_patches),
r as (select split, study_area, struct_pack(p := regexp_extract(patch_id, '(\\d+)', 1)::bigint, c := {_WORD.format('candidate_class')}, v := {_WORD.format('vegetation_trend')}, s := study_area, n_triplets, has_reference, block_id, x := printf('%.4f', lon), y := printf('%.4f', lat)) as w from a),
k as (select w, count(*) as m from r where split = 'train' group by w)
select split, study_area, count(*) as n_rows, count(m) as rows_whole, coalesce(sum(m), 0)::bigint as n_pairs from r left join k on k.w is not distinct from r.w where split <> 'train' group by 1, 2""",
}
