from __future__ import annotations

import itertools
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlens.llm import answers as A
from pairlens.llm import encode, group_splits, languages, leaks, overlap, raking, truncation, unify
from tests.conftest import SMALL, rows

# --- encoding ---------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_the_library(text):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    global _library
    try:
        lib = _library
    except NameError:
        lib = _library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        lib.encode_special_tokens = True
    e = encode.encoder(encode.vocabulary_path())
    assert e.encode_batch([text])[0] == lib.encode(text, add_special_tokens=False).ids


def test_encoding_round_trip_and_edges(spark, library):
    e = encode.encoder(encode.vocabulary_path())
    texts = [None, "", "a" * 20_000, "<|endoftext|>", " \n\n x  ", "don't", "क्षमा", "日本語", "​", "x" * 300 + "é" * 300]
    ids = e.encode_batch(texts)
    assert ids[0] == ids[1] == []
    for t, i in zip(texts[2:], ids[2:]):
        assert b"".join(e.bytes[k] for k in i).decode() == t
        assert i == library.encode(t, add_special_tokens=False).ids
    df = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    assert [list(r.ids) for r in encode.encode_documents(df).orderBy("doc_id").collect()] == ids
    assert encode.encode_documents(df.limit(0)).count() == 0


def test_greedy_is_verified():
    e = encode.encoder(encode.vocabulary_path())
    rng = random.Random(0)
    wrong = 0
    for _ in range(2000):
        w = bytes(rng.choice(b"abcdeinrst") for _ in range(rng.randint(2, 12)))
        exact = e.merge(w)
        wrong += e.propose(w) != exact
        assert list(e.learn([w.decode()])[w.decode()]) == exact
    assert wrong > 20  # speculation alone isn't enough


# --- one form for look-alikes -----------------------------------------------

SAME = [("a​b", "ab"), ("Ｎｄｖｉ", "Ndvi"), ("é", "é"), ("сору", "copy"), ("a b", "a b"), ("ﬁre", "fire"), ("2 ºC", "2 °C"), ("∆", "Δ"), ("K", "K"), ("ɑⅼⅰ", "ali"), ("a\r\nb", "a\nb"), ("q̣̇", "q̣̇"), ("a  b", "a b"), ("क़", "क़"), ("﻿x", "x"), ("가", "가")]
APART = [("m²", "m2"), ("é", "e"), ("A", "a"), ("0", "O"), ("1", "l"), ("½", "1/2"), ("a b", "ab"), ("a\nb", "a b"), ("①", "1"), ("Ñ", "N"), ("δ", "Δ")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert unify.canonical_text(a) == unify.canonical_text(b) != ""


@pytest.mark.parametrize(("a", "b"), APART)
def test_different_look(a, b):
    assert unify.canonical_text(a) != unify.canonical_text(b)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("aé̈​ 각ﬁＡсệ \t\n\r")), max_size=40))
def test_splicing_equals_the_whole_text(text):
    form = unify.canonical_text(text)
    assert form == unify.whole_text_form(text)
    assert unify.canonical_text(form) == form
    assert unicodedata.is_normalized("NFC", form)


def test_look_alike_pairs(spark):
    texts = ["abc", "abc", "a​bc", "ａbc", None, "", "​", " ", "x²", "x2", "Abc"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, form_hash int")
    want = sorted((i, j) for i, j in itertools.combinations(range(len(texts)), 2) if unify.canonical_text(texts[i]) and texts[i] != texts[j] and unify.canonical_text(texts[i]) == unify.canonical_text(texts[j]))
    got = unify.look_alike_classes(df)
    assert {r.doc_id for r in got.collect()} == {i for p in want for i in p}
    assert {(r.class_id, r.n_forms, r.n_docs) for r in got.collect()} == {(0, 3, 4)}
    assert unify.look_alike_classes(df.limit(0)).count() == 0


# --- overlaps across splits -------------------------------------------------


def test_overlap_pairs_with_a_hot_record(spark, monkeypatch):
    monkeypatch.setattr("pairlens.operators.skew.HOT_ROWS", 10)
    rng = random.Random(1)
    make = lambda i: (i, rng.choice(["P 1", "p-1", "P1 ", "p.1", None, "!!", f"p{rng.randint(2, 9)}"]), rng.choice([None, 10.0, 10.0001, 10.1, float("nan")]), rng.choice([5.0, 5.0001, None]), "x")
    held, train = [make(i) for i in range(40)], [make(100 + i) for i in range(120)]
    schema = "rec_id long, record string, lon double, lat double, _hash string"
    h, t = spark.createDataFrame(held, schema), spark.createDataFrame(train, schema)
    words = lambda s: " ".join("".join(c if c.isalnum() else " " for c in (s or "").lower()).split())
    near = lambda a, b: all(v is not None and v == v for v in (*a[2:4], *b[2:4])) and abs(a[2] - b[2]) < 0.0002 and abs(a[3] - b[3]) < 0.0002
    want = sorted((a[0], b[0], bool(words(a[1])) and words(a[1]) == words(b[1]), near(a, b)) for a in held for b in train if near(a, b) or (words(a[1]) and words(a[1]) == words(b[1])))
    assert rows(overlap.overlap_pairs(h, t)) == want
    assert overlap.overlap_pairs(h.limit(0), t).count() == 0


# --- grouped splits ---------------------------------------------------------


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return sorted((x, min(g)) for g in groups.values() for x in g)


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty", "dirty"])
def test_components(spark, shape):
    rng = random.Random(4)
    order = list(range(60))
    rng.shuffle(order)
    edges = {"path": list(zip(order, order[1:])), "star": [(99, x) for x in order], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)], "empty": [], "dirty": [(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None)]}[shape]
    got = rows(group_splits.connected_components(spark.createDataFrame(edges, "u long, v long")))
    assert got == components([e for e in edges if None not in e])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(0, 80))
def test_subset_sum_is_nearest(sizes, want):
    from collections import Counter

    got = group_splits.choose_sizes(sorted(Counter(sizes).items()), [("x", want)])["x"]
    total = sum(s * n for s, n in got.items())
    sums = {0}
    for s in sizes:
        sums |= {t + s for t in sums}
    assert abs(total - want) == min(abs(t - want) for t in sums if t <= 2 * want)
    assert all(n <= Counter(sizes)[s] for s, n in got.items())


def test_subset_sum_in_units():
    got = group_splits.choose_sizes([(1, 5000), (700, 40), (10_001, 3)], [("a", 12_345), ("b", 3_000)])
    assert abs(sum(s * n for s, n in got["a"].items()) - 12_345) <= 1
    assert abs(sum(s * n for s, n in got["b"].items()) - 3_000) <= 1


def test_split_never_parts_what_belongs_together(spark):
    rng = random.Random(6)
    data = [(i, rng.choice([None, *range(150)]), rng.choice([None, None, *range(40)]), "z") for i in range(900)]
    df = spark.createDataFrame(data, "rec_id long, patch long, block long, component string")
    links = group_splits.linked_blocks(df)
    by_patch = {}
    for _, p, b, _ in data:
        if p is not None and b is not None:
            by_patch.setdefault(p, set()).add(b)
    want = components([(min(bs), b) for bs in by_patch.values() for b in bs if len(bs) > 1 and b != min(bs)])
    assert rows(links) == want
    of = group_splits.split_units(df, links)
    units = of.groupBy("unit").agg(F.count(F.lit(1)).alias("size"))
    split = {r.unit: r.split for r in group_splits.grouped_split(units).collect()}
    where = {r.rec_id: split[r.unit] for r in of.collect()}
    assert len(where) == 900
    for key in (1, 2):
        seen = {}
        for row in data:
            if row[key] is not None:
                seen.setdefault(row[key], set()).add(where[row[0]])
        assert all(len(s) == 1 for s in seen.values())
    assert group_splits.grouped_split(units.limit(0)).count() == 0


# --- raked samples ----------------------------------------------------------


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 50, 12).astype(float)
    a, b = np.arange(12) % 3, np.arange(12) // 3
    wa, wb = np.array([50.0, 30.0, 20.0]), np.array([10.0, 20.0, 30.0, 40.0])
    w = raking.rake(n, [(a, wa), (b, wb)])
    assert np.allclose(np.bincount(a, w), wa, rtol=1e-6) and np.allclose(np.bincount(b, w), wb, rtol=1e-6)


def test_sample_quotas_and_gaps(spark):
    data = [(i, "stable" if i % 2 else "decline", "n" if i % 3 else "s", "x") for i in range(3000)] + [(5000 + i, "fire", "n", None) for i in range(7)] + [(5000, "stable", "n", None), (None, "fire", "n", None), (6000, None, "n", None)] * 2
    rows_ = spark.createDataFrame(data, "patch long, candidate_class string, study_area string, trend string")
    mix = spark.createDataFrame([(1, None, 100, "Stable ", 0.5, 1), (1, None, 100, "decline", 0.455, 1), (1, None, 100, "fire", 0.045, 10), (2, "s", 10, "fire", 0.1, 1), (2, "s", 10, "stable", 0.9, 2), (3, "nowhere", 10, "stable", None, None)], "mix_id int, study_area string, sample_rows int, candidate_class string, target_share double, min_rows int")
    sample, report = raking.raked_sample(rows_, mix)
    got = {(r.mix_id, r.candidate_class): (r.need, r.supply, r.drawn, r.gap) for r in report.collect()}
    # The minimum of fire leaves 90 of 100 rows to the others, in their proportions.
    assert got == {(1, "stable"): (50, 1501, 47, 3), (1, "decline"): (46, 1500, 43, 3), (1, "fire"): (10, 7, 7, 3), (2, "fire"): (1, 0, 0, 1), (2, "stable"): (9, 500, 9, 0), (3, "stable"): (0, 0, 0, 0)}
    s = sample.collect()
    assert len({(r.mix_id, r.patch) for r in s}) == len(s) == 106
    again = raking.raked_sample(rows_, mix)[0]
    assert rows(again) == sorted(map(tuple, s))
    assert {r.drawn for r in raking.raked_sample(rows_.limit(0), mix)[1].collect()} == {0}


# --- leaked passages --------------------------------------------------------


def brute_leak(item, doc, words=25):
    """Whether a stretch of the item of at least ``words`` words stands in the document with one edit in ten words at most."""
    for i in range(len(item) - words + 1):
        for j in range(i + words, len(item) + 1):
            part, most = item[i:j], (j - i) // 10
            row = [0] * (len(doc) + 1)  # may start anywhere
            for a, w in enumerate(part):
                new = [a + 1]
                for b, x in enumerate(doc):
                    new.append(min(row[b] + (w != x), row[b + 1] + 1, new[b] + 1))
                row = new
            if min(row) <= most:
                return True
    return False


def test_leaks_against_brute_force():
    rng = random.Random(11)
    item = [f"w{i}" for i in range(45)]
    index = leaks.ItemIndex([(1, " ".join(item))])
    seen = {True: 0, False: 0}
    for _ in range(120):
        n = rng.choice([10, 18, 22, 25, 26, 30, 38, 45])
        s = rng.randint(0, len(item) - n)
        part = item[s : s + n]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            k = rng.randrange(len(part))
            kind = rng.choice("cda")
            part = part[:k] + ([f"x{rng.random()}"] if kind != "d" else []) + part[k + (kind != "a") :]
        doc = [f"o{i}" for i in range(rng.randint(0, 9))] + part + [f"p{i}" for i in range(rng.randint(0, 9))]
        want = brute_leak(item, doc)
        assert bool(index.search(" ".join(doc))) == want, (n, doc)
        seen[want] += 1
    assert min(seen.values()) > 20


def test_leaks_look_past_dress(spark):
    text = "By contrast the share of dropped pixels was 3.4 percent at Keltari and 48.8 percent at Larril whereas a late volcanic haze explains the gap between both of the frames over there."
    dressed = "Intro words. **" + text.upper().replace("A", "А").replace(" ", "  ").replace("THE", "<b>T​HE</b>") + "** end"
    docs = spark.createDataFrame([(1, dressed, 0), (2, text[:60], 0), (3, None, 0), (4, "", 0), (5, "word " * 50_000, 0), (6, text, 0), (6, text, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(10, text), (11, None), (12, ""), (13, "word " * 900)], "item_id long, text string")
    want = [(1, 10), (5, 13), (6, 10), (6, 10)]
    assert rows(leaks.leaked_items(docs, items).select("doc_id", "item_id")) == want
    assert rows(leaks.leaked_items(docs, items, block_chars=300).select("doc_id", "item_id")) == want
    assert leaks.leaked_items(docs, items.limit(0)).count() == 0 and leaks.leaked_items(docs.limit(0), items).count() == 0


def test_word_aligner():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 8, 4, 5])
    score, path = leaks.smith_waterman(a, b)
    assert score == 3 and [(i, j) for i, j, _ in path] == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]


# --- answers ----------------------------------------------------------------

PROMPT = "Describe the visible change at p000045708, choose stable, decline or increase, and name a possible driver.\nReadings: NDVI 0.656 then 0.671 (Δ +0.015). EVI Δ +0.004, NDMI Δ -0.020."
REASON = "NDVI held steady from 0.656 to 0.671 and the radar agrees with that."


@pytest.mark.parametrize(
    ("raw", "justification", "wanted", "defect"),
    [
        (None, None, "text", "empty"), ("", "", "text", "empty"), ("​", "​", "short", "empty"), ("{}", "", "json", "empty"), ("```json\n```", "", "json", "empty"), ("class: stable\nreason:", "", "text", "empty"),
        ('{"change_class": "stable", "justification": " "}', "", "json", "empty"), ("Stable", "Stable", "text", "empty"), ("stable", "stable", "short", None), ("снижение", "снижение", "short", "other_language"), ("Decline.", "x", "short", None), ('{"change_class": "decline", "justification": "' + REASON + '"}', REASON, "json", None),
        ("I'm sorry, but I can't help with that.", "x", "text", "refusal"), ("unanswerable", "x", "short", "refusal"), ('{"change_class": null, "justification": "No answer can be provided for this patch. Thank you."}', "x", "json", "refusal"),
        ("Lo siento, no puedo responder a esa pregunta.", "x", "text", "refusal"), ("क्षमा करें, मैं इसका उत्तर नहीं दे सकता।", "x", "text", "refusal"),
        ("The sorry state of the reed bed is older than both scenes.", None, "text", None), ("Without the radar one could not tell shadow from loss, but here both agree.", None, "text", None),
        ("It is not possible for me to assess it. NDVI held steady from 0.656 to 0.671, so it is stable.", None, "text", None),
        (PROMPT.split("\n")[0].lower(), None, "text", "copied"), (PROMPT + "\n" + PROMPT, None, "text", "copied"), ("> " + PROMPT.split("\n")[1].replace("EVI Δ ", ""), None, "text", "copied"),
        (PROMPT.split(".")[0] + "? " + REASON, None, "text", None), (REASON, REASON, "text", None), (REASON, REASON[:30], "text", "truncated"),
        ('{"change_class": "stable", "justification": "' + REASON + '"}', REASON, "json", None), ('{"change_class": "stable", "justification": "' + REASON[:30], "x", "json", "truncated"), ('{"change_class": "sta', "x", "json", "truncated"),
        ("El NDVI pasó de 0.656 a 0.671 cerca de la ladera y la vegetación apenas cambió de tono.", None, "text", "other_language"), ("Der Feuchteindex änderte sich am Bach von Devngol um -0.183 und der Boden wurde trockener.", None, "text", "other_language"),
        ("Narrakot की ढलान पर रडार संकेत बदला।", None, "text", "other_language"), ("Both agree (see the table\n- one\n-", None, "text", "truncated"),
    ],
)
def test_defects(raw, justification, wanted, defect):
    assert A.defect_of(raw, justification, PROMPT, wanted)[0] == defect


def test_pushdown():
    assert A.open_parts('```json\n{"a": ["x \\" ]", {"b": "(') == ["```", "{", "[", "{", '"']
    assert A.open_parts('```json\n{"a": "}"}\n```') == [] and A.open_parts("") == []
    assert A.read_answer('```json\n{"justification": "done."}').open is False  # a closed object reads as finished
    assert A.read_answer("class: decline\nreason: rain fell").reason == "rain fell"


def test_tiles_cover_repeats():
    src = "a b c d e f".split()
    assert A.tiled("a b c d a b c d x e".split(), src, 2) == [True] * 8 + [False, False]


def test_languages():
    assert [languages.language_of(t) for t in (None, "", "12 34", "the rain was low and the soil was dry", "la lluvia fue de 20 mm al norte", "der Boden war nass und die Wiese grün", "вырубок не видно, хотя почва сухая", "खंड लगभग स्थिर रहा")] == ["und", "und", "und", "en", "es", "de", "ru", "hi"]


def synthetic(n=600, seed=3):
    rng = random.Random(seed)
    places = ["".join(rng.choice(["Ked", "Lor", "Mas", "Pel"]) + rng.choice(["gar", "dor", "lund", "mira"]) for _ in range(1)) for _ in range(16)]
    parts = [lambda: f"the crowns near {rng.choice(places)} show less green in the later view", lambda: f"NDVI fell from 0.{rng.randint(100, 999)} to 0.{rng.randint(100, 999)}, a difference of -0.{rng.randint(100, 299)}", lambda: "it is hard to name one driver, yet the class is clear because the winter rain failed", lambda: f"rain went from {rng.randint(10, 99)}.{rng.randint(0, 9)} mm to {rng.randint(10, 99)}.1 mm, so late showers are likely", lambda: f"the label was left alone north of {rng.choice(places)}"]
    out = []
    for i in range(n):
        sep, stop = rng.choice([(". ", "."), ("; ", ""), ("\n- ", "")])
        text = sep.join(rng.choice(parts)() for _ in range(rng.randint(1, 5))) + stop
        cut = i % 5 == 0
        if cut:
            ends = {len(text)} | {k for k, c in enumerate(text) if c in ".;\n"}
            while True:
                k = rng.randint(len(text) // 2, len(text) - 4)
                if not any(abs(k - e) <= 3 for e in ends) and not text[:k].endswith(tuple(places)):
                    break
            text = text[:k]
        out.append((i, "run", "Say why.", text, None, "text", cut))
    return out


def test_held_out_cuts_are_found(spark):
    data = synthetic()
    df = spark.createDataFrame(data, "row_id long, combo_id string, prompt_text string, raw_text string, justification string, answer_format string, truth boolean")
    got = {r.row_id: r.cut for r in truncation.judged_answers(df).collect()}
    truth = {r[0]: r[-1] for r in data}
    hits = sum(got[i] and truth[i] for i in truth)
    assert hits / sum(truth.values()) > 0.95
    assert hits / max(1, sum(got.values())) > 0.95
    again = {r.row_id: r.cut for r in truncation.judged_answers(df.repartition(7)).collect()}
    assert again == got  # the partitions don't matter


def test_answers_with_edges(spark):
    data = [(1, "r", None, None, None, None), (2, "r", "p", "", None, "text"), (3, "r", "p", "word " * 200_000 + "end.", None, "text"), (4, None, "p", "stable", "stable", "short"), (4, None, "p", "stable", "stable", "short"), (5, "r", "p", "x" * 50_000, None, "text")]
    df = spark.createDataFrame([(*r, "z") for r in data], "row_id long, combo_id string, prompt_text string, raw_text string, justification string, answer_format string, final string")
    got = sorted((r.row_id, r.defect, r.cut) for r in truncation.judged_answers(df).collect())
    assert [g[:2] for g in got] == [(1, "empty"), (2, "empty"), (3, None), (4, None), (4, None), (5, None)]
    assert truncation.judged_answers(df.limit(0)).count() == 0


def test_queries_have_the_asked_columns(spark):
    from pairlens.llm.catalogue import QUERIES

    want = {"p1_found": ["row_id"], "p2_found": ["mix_id", "candidate_class"], "p3_found": ["block_a", "block_b"], "p4_found": ["row_id", "defect"], "p6_found": ["rec_a", "rec_b"], "p7_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_a", "doc_b"]}
    for name, columns in want.items():
        assert QUERIES[name](spark, SMALL).columns == columns


def test_a_unit_that_holds_nearly_all(spark):
    units = spark.createDataFrame([("big", 5000)] + [(f"u{i}", 1) for i in range(40)], "unit string, size long")
    n = {r.split: r["sum(size)"] for r in group_splits.grouped_split(units).groupBy("split").sum("size").collect()}
    assert n == {"train": 5000, "dev": 20, "test": 20}
    assert group_splits.grouped_split(units.filter("size > 1")).collect()[0].split == "train"
