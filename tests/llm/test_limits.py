"""Results that no length, size or shared supply may change."""

from __future__ import annotations

import random
from itertools import combinations

from pyspark.sql import functions as F

from pairlens.llm import group_splits, leaks, overlap, raking, unify
from tests.conftest import rows


def words(n, seed=1):
    rng = random.Random(seed)
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def test_a_long_tag_hides_no_leak():
    item = words(26)
    index = leaks.ItemIndex([(1, " ".join(item))])
    tag = "<span class='" + "x" * 300 + "'>"
    assert index.search(" ".join(item[:13]) + tag + " ".join(item[13:])) == [(1, 26, 0, 26)]


def test_a_long_passage_is_one():
    item = words(1000)
    index = leaks.ItemIndex([(1, " ".join(item))])
    assert index.search("a b " + " ".join(item) + " c") == [(1, 1000, 0, 1000)]
    edited = ["zz" if k % 12 == 10 else w for k, w in enumerate(item)]
    assert index.search("a b " + " ".join(edited) + " c")[0][1:3] == (1000, 83)


def test_boilerplate_costs_little():
    item = words(300)
    doc = " ".join(" ".join(item[:20]) + f" y{k} z{k}" for k in range(2000))
    assert leaks.ItemIndex([(1, " ".join(item))]).search(doc) == []


def test_case_and_scripts_of_words():
    assert leaks.plain_words("ВЫРУБОК Δ THЕ") == leaks.plain_words("вырубок δ the")


def test_every_window_keeps_a_rare_seed():
    rng = random.Random(3)
    import numpy as np

    for _ in range(60):
        n = rng.choice([25, 30, 40, 60])
        freq = np.array([rng.choice([0, 1, 5, 1000]) for _ in range(n - 4)])
        chosen = leaks.rare_seeds(freq, np.arange(n - 4))
        for width, edits in ((25, 2), (30, 3), (40, 4)):
            for start in range(0, n - width + 1):
                hit = [start + rng.randrange(width) for _ in range(edits)]
                left = [k for k in range(start, start + width - 4) if not any(k <= h < k + 5 for h in hit)]
                assert any(chosen[k] for k in left)


def test_leaks_whatever_joins(spark):
    item = words(40)
    docs = spark.createDataFrame([(None, " ".join(item)), (1, " ".join(item)), (2, " ".join(words(60, 9)))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item)), (None, " ".join(item))], "item_id long, text string")
    got = leaks.leaked_items(docs, items).select("doc_id", "item_id").collect()
    assert len(got) == 6 and {r.doc_id for r in got} == {None, 1}


def test_quotas_keep_the_total():
    assert raking.quotas(100, {"a": 0.99, "b": 0.01}, {"b": 50}) == {"a": 50, "b": 50}
    assert sum(raking.quotas(10, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {}).values()) == 10


def test_shared_supply(spark):
    both = [(i, c, "n", "x") for i in range(10) for c in "ab"]
    df = spark.createDataFrame(both, "patch long, candidate_class string, study_area string, trend string")
    mix = spark.createDataFrame([(1, None, 16, "a", 0.5, 1), (1, None, 16, "b", 0.5, 1)], "mix_id int, study_area string, sample_rows int, candidate_class string, target_share double, min_rows int")
    sample, report = raking.raked_sample(df, mix)
    r = report.collect()
    assert sum(x.drawn for x in r) == 10 == sample.select("patch").distinct().count()
    assert all(x.gap == x.need - x.drawn and x.need == 8 for x in r)


def brute_flow(sets, quota):
    match = {}
    slots = [(c, k) for c, n in quota.items() for k in range(n)]

    def place(unit, seen):
        for slot in slots:
            if slot[0] in unit[0].split(raking.SEP) and slot not in seen:
                seen.add(slot)
                if slot not in match or place(match[slot], seen):
                    match[slot] = unit
                    return True
        return False

    return sum(place((s, k), set()) for s, n in sets.items() for k in range(n))


def test_dealing_out_is_a_maximum_flow():
    rng = random.Random(5)
    kinds = [raking.SEP.join(x) for k in (1, 2, 3) for x in combinations("abcd", k)]
    for _ in range(200):
        sets = {s: rng.randint(0, 6) for s in rng.sample(kinds, 4)}
        quota = {c: rng.randint(0, 8) for c in "abcd"}
        take = raking.deal_out(sets, quota)
        assert min(take.values(), default=0) >= 0
        assert all(sum(n for (s, _), n in take.items() if s == x) <= sets[x] for x in sets)
        assert sum(take.values()) == brute_flow(sets, quota)


def test_large_sizes_are_met_exactly():
    got = group_splits.choose_sizes([(7_000_001, 1), (5_000_003, 1), (3_000_000, 3), (3, 1)], [("a", 10_000_004)])["a"]
    assert sum(s * n for s, n in got.items()) == 10_000_004
    many = group_splits.choose_sizes([(k * k, 3) for k in range(1, 5000)], [("a", 10**9 + 7), ("b", 10**8)])
    assert [sum(s * n for s, n in x.items()) for x in many.values()] == [10**9 + 7, 10**8]


def test_components_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr("pairlens.operators.skew.BROADCAST_ROWS", 0)
    monkeypatch.setattr("pairlens.operators.skew.HOT_ROWS", 5)
    edges = [(99, x) for x in range(30)] + [(200, 201), (201, 202), (5, 5)]
    got = dict(rows(group_splits.connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {**{x: 0 for x in range(30)}, 99: 0, 200: 200, 201: 200, 202: 200}


def test_ids_in_canonical_text(spark):
    same = ["p000000012", "P_0000012", "p-12", " p12 ", "p12 ", "p１２"]
    apart = ["q-12", "north 12", "p12_2019", "p12_2021", "p12b 13"]
    df = spark.createDataFrame([(x,) for x in same + apart], "t string").select(overlap.record_hash(overlap.id_text(F.col("t"))).alias("h"))
    h = [bytes(r.h) for r in df.collect()]
    assert len(set(h[: len(same)])) == 1 and len(set(h)) == 1 + len(apart)


def test_links_equal_pairs(spark):
    rng = random.Random(2)
    make = lambda i: (i, rng.choice(["p 1", "p 2", None, "p 3"]), rng.choice([None, 10.0, 10.0001, 10.1, float("nan")]), rng.choice([5.0, 5.0001, None]))
    schema = "rec_id long, record string, lon double, lat double"
    h, t = (spark.createDataFrame([make(i) for i in r], schema) for r in (range(30), range(100, 190)))
    want: dict = {}
    for r in overlap.overlap_pairs(h, t).collect():
        w = want.setdefault(r.rec_held, [0, 0, 0])
        w[0] += r.same_record
        w[1] += r.same_spot
        w[2] += 1
    got = {r.rec_id: [r.n_record, r.n_spot, r.n_links] for r in overlap.overlap_links(h, t, ["rec_id"]).collect()}
    assert got == {i: want.get(i, [0, 0, 0]) for i in range(30)}


def test_letters_of_the_public_table():
    for a, b in [("օ", "o"), ("ꓮ", "A"), ("Ꭺ", "A"), ("𝐀𝐛", "Ab"), ("α", "a"), ("ı", "i")]:
        assert unify.canonical_text(a) == unify.canonical_text(b)
    honest = "Мама мыла раму в Москве."
    assert unify.readable_text(honest) == honest
    assert unify.readable_text("Мoсква cору") == "Москва copy"


def test_refusals_by_clauses():
    from pairlens.llm.answers import is_refusal

    for t in ["I'm sorry, the images are too blurry. I can't tell what changed.", "As a language model I have no way to look at pictures.", "We are not able to judge this pair.", "Cette demande dépasse mes capacités."]:
        assert is_refusal(t)
    for t in ["We cannot see loss in the north. NDVI fell.", "I can see that NDVI fell.", "The sorry state of the reed bed is older.", "I'm sorry for the delay. NDVI fell."]:
        assert not is_refusal(t)


def test_open_markup_lists_and_quotes():
    from pairlens.llm.answers import read_answer

    for t in ["<p>one <b>forest", "<ul><li>one</li><li>two", 'He said "the forest', "text\n1. one\n2. two\n3.", "see <b"]:
        assert read_answer(t).open, t
    for t in ["<p>Done.", "a <br> b.", 'a 5" b and "c" d.', "<b>x</b> y.", "a < b > c."]:
        assert not read_answer(t).open, t


def test_long_class_answers_and_languages():
    from pairlens.llm.answers import only_class
    from pairlens.llm.languages import language_of

    assert only_class("decline" + " " * 100 + "**")
    assert language_of("Il bosco è stato tagliato dopo il primo inverno e la vegetazione della collina è cambiata") == "it"
    assert language_of("Het bos werd voor een deel gekapt en de bodem is nog niet hersteld") == "nl"


def test_links_of_empty_tables_and_clashing_names(spark):
    schema = "rec_id long, record string, lon double, lat double, _hash string, _place int, n int"
    h = spark.createDataFrame([(1, "p 1", 10.0, 5.0, "x", 1, 1), (2, None, None, None, None, None, None)], schema)
    got = {r.rec_id: r.n_links for r in overlap.overlap_links(h, h.withColumn("rec_id", F.col("rec_id") + 10), ["rec_id"]).collect()}
    assert got == {1: 1, 2: 0}
    assert overlap.overlap_links(h.limit(0), h, ["rec_id"]).count() == 0
    assert {r.n_links for r in overlap.overlap_links(h, h.limit(0), ["rec_id"]).collect()} == {0}


def test_samples_of_nothing(spark):
    schema = "mix_id int, study_area string, sample_rows int, candidate_class string, target_share double, min_rows int"
    df = spark.createDataFrame([(1, "a", "n", None)], "patch long, candidate_class string, study_area string, trend string")
    mix = spark.createDataFrame([(1, None, None, "a", None, None), (2, "nowhere", 5, " A ", 1.0, 1)], schema)
    report = {r.mix_id: (r.need, r.supply, r.drawn, r.gap) for r in raking.raked_sample(df, mix)[1].collect()}
    assert report == {1: (0, 1, 0, 0), 2: (5, 0, 0, 5)}
    assert raking.raked_sample(df, mix.limit(0))[1].count() == 0


def test_every_character_by_itself():
    for cp in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        c = chr(cp)
        form = unify.canonical_text(c)
        assert form == unify.whole_text_form(c) and unify.canonical_text(form) == form, hex(cp)
