"""Round trips, held-out accuracy and edge cases of the operators on texts."""

import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from conftest import SF
from passagework.llm import _tokens, abuse_scores, encoding_repair, genetic_packing, soft_mixing

# encodings


def dictionaries():
    texts = {"de": "Die Prüfung ändert die Höhe über der Brücke für zwölf Wochen", "fr": "La forêt précède la mémoire à côté de l’élève voilà café", "pl": "Żółta łódź śledzi święto także zimą", "ru": "Дорога теряет поисковый индекс на севере"}
    return encoding_repair.Dictionaries({lang: [(w, 50) for w in t.split()] for lang, t in texts.items()})


ROUND_TRIPS = [
    ("Die Prüfung ändert die Höhe", "utf-8", "cp1252"), ("La forêt précède la mémoire", "utf-8", "mac_roman"), ("La forêt précède la mémoire", "utf-8", "cp437"), ("Żółta łódź śledzi święto", "utf-8", "cp1250"),
    ("Дорога теряет поисковый индекс", "cp1251", "latin-1"), ("Дорога теряет поисковый индекс", "cp1251", "koi8-r"), ("Żółta łódź śledzi święto", "cp1250", "latin-1"), ("a plain cellar with a café nearby", "utf-8", "latin-1"),
]


@pytest.mark.parametrize(("text", "written", "read"), ROUND_TRIPS)
def test_round_trips(text, written, read):
    garbled = text.encode(written).decode(read, errors="strict") if read != "cp1252" else "".join(encoding_repair.byte_chars("cp1252")[b] for b in text.encode(written))
    assert encoding_repair.repair(garbled, dictionaries()) == (True, text)


@pytest.mark.parametrize(("text", "written", "read"), [("on chce tłumaczy to zimą", "cp1250", "cp1252"), ("in der straße there", "cp850", "cp1252"), ("in der straße there", "cp437", "cp1252")])
def test_one_garbled_character_in_a_known_word(text, written, read):
    d = encoding_repair.Dictionaries({"de": [("straße", 50), ("höhe", 50), ("brücke", 50)], "pl": [("tłumaczy", 50), ("zimą", 50), ("łódź", 50)], "en": [("walk", 50), ("bridge", 50)]})
    assert encoding_repair.repair(text.encode(written).decode(read), d) == (True, text)


def test_twice_garbled():
    text = "Die Prüfung ändert die Höhe"
    once = text.encode("utf-8").decode("latin-1")
    assert encoding_repair.repair(once.encode("utf-8").decode("latin-1"), dictionaries()) == (True, text)


@pytest.mark.parametrize("text", ["", "plain", "Die Prüfung ändert die Höhe", "L’élève à côté", "3 × 4, 20\xa0°C, €45, ½ cup ±3", "On § ¿ © ground", "they see “Ã¼” on screen", "they see «√©» on screen", 'they see "�" there', "Дорога теряет", "MAÇÃ HÁ MUITO", "«CAFÉ» Øresund"])
def test_intact_texts_stay(text):
    assert encoding_repair.repair(text, dictionaries()) == (False, None)


def test_lost_characters_are_found_but_not_restored():
    assert encoding_repair.repair("La for�t", dictionaries()) == (True, None)


def test_garbled_rows(spark):
    good = [("passages", f"p{i}", "Die Prüfung ändert die Höhe") for i in range(5)]
    bad = [("passages", "b", "Die PrÃ¼fung"), ("queries", "b", "Die PrÃ¼fung"), ("queries", "b", "Die PrÃ¼fung"), ("queries", None, "PrÃ¼fung"), ("queries", "n", None), ("queries", "e", "")]
    df = spark.createDataFrame([(*r, "x") for r in good + bad], "origin string, id string, text string, restored string")
    got = {(r["origin"], r["id"]): r["restored"] for r in encoding_repair.garbled(df).collect()}
    assert got == {("passages", "b"): "Die Prüfung", ("queries", "b"): "Die Prüfung"}
    assert encoding_repair.garbled(df.limit(0)).count() == 0


# tokens and packing


def test_token_counts_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    texts = ["Hello  world's 123", "", None, "é\xa0日本 \n\n x", "<|endoftext|>"]
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r["doc_id"]: r["tokens"] for r in _tokens.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_crossover_and_mutation_keep_groupings_whole():
    rng = np.random.default_rng(0)
    sizes, capacity = rng.integers(0, 60, 200), 100
    a = genetic_packing.evolve(sizes, capacity, 1, generations=0)
    b = genetic_packing.evolve(sizes, capacity, 2, generations=2)
    for g in (a, b, genetic_packing.crossover(a, b, sizes, capacity, rng), genetic_packing.mutate(a, sizes, capacity, rng)):
        assert (g.bin_of >= 0).all() and g.fill.max() <= capacity and g.fill.sum() == sizes.sum()
    assert len(b.fill) <= -(-sizes.sum() // capacity) + 1
    assert len(genetic_packing.evolve(np.array([], int), 10, 0).fill) == 0


def test_packed_documents(spark):
    docs = [(i, "word " * n, "c", 1) for i, n in enumerate([0, 1, 5, 9, 40, 3, 3, 8, 2] * 6)] + [(900, None, "c", 1), (None, "x", "c", 1), (0, "", "c", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, container string, piece int")
    packs = spark.createDataFrame([("small", 16), ("large", 64), (None, 5), ("bad", 0), ("small", 16)], "pack_name string, capacity_tokens int")
    got = genetic_packing.pack(df, packs).toPandas()
    tokens = {r["doc_id"]: r["tokens"] for r in _tokens.token_counts(df).collect()}
    for name, capacity in (("small", 16), ("large", 64)):
        g = got[got.pack_name == name]
        assert g.groupby("doc_id").tokens.sum().to_dict() == tokens
        bins = g.groupby("container")
        assert (bins.tokens.sum() + bins.unused.first() == capacity).all() and (bins.unused.first() >= 0).all()
        assert all(sorted(p) == list(range(1, len(p) + 1)) for _, p in bins.position)
        whole = g[g.doc_id.map(tokens) <= capacity]
        assert (whole.groupby("doc_id").size() == 1).all()
        assert len(bins) <= -(-sum(tokens.values()) // capacity) + 1
    assert genetic_packing.pack(df, packs.limit(0)).count() == 0
    assert genetic_packing.pack(df.limit(0), packs).count() == 0


# mixing


def test_softmax_tells_sources_apart():
    rows = [soft_mixing.featurize(f"Q: what is {i}\nA: it is {i}") for i in range(40)] + [soft_mixing.featurize(f"User: hello {i}\nAssistant: hi {i}") for i in range(40)]
    w = soft_mixing.fit_softmax(rows, np.array([0] * 40 + [1] * 40), 3)
    for text, label in (("Q: where is it\nA: there", 0), ("User: go\nAssistant: no", 1)):
        f = soft_mixing.featurize(text)
        z = w[[*f, soft_mixing.FEATURES]].sum(axis=0)
        assert z.argmax() == label and z[2] < -1e3


def test_mix_meets_targets_and_repeats(spark):
    docs = [(i, "word " * 10, s) for i, s in enumerate(["A b"] * 300 + ["a-b"] * 100 + ["c"] * 60 + ["d"] * 200)] + [(2000, "word", None), (2001, None, "c"), (None, "word", "c")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, uses int")
    targets = spark.createDataFrame([("m", "a_b", 0.5, 1), ("m", "c", 0.4, 4), ("m", "gone", 0.1, 2), ("m", None, 0.2, 1), (None, "c", 0.2, 1)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = soft_mixing.mix(df, targets).cache()
    got = {r["source"]: r for r in soft_mixing.shares(df, targets, drawn).collect()}
    assert abs(got["a_b"]["actual_share"] - 0.5 / 0.9) < 0.02 and abs(got["c"]["actual_share"] - 0.4 / 0.9) < 0.02 and got["gone"]["actual_share"] == 0
    assert drawn.where("source = 'd' or uses < 1").count() == 0
    assert drawn.groupBy("source").agg(F.max("uses").alias("m")).where("source = 'c' and m > 4 or source = 'a_b' and m > 1").count() == 0
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0
    assert soft_mixing.mix(df, targets.limit(0)).count() == 0 and soft_mixing.mix(df.limit(0), targets).count() == 0


def test_features_are_of_the_whole_text():
    import xxhash

    assert xxhash.xxh32_intdigest("last") % soft_mixing.FEATURES in soft_mixing.featurize("word " * 100_000 + "last")


def test_all_listed_sources_are_drawn(spark):
    names = [f"s{i:03d}" for i in range(80)]
    df = spark.createDataFrame([(i, f"word {i}", names[i % 80]) for i in range(800)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("m", n, 1 / 80, 1) for n in names], "mix_name string, source string, target_share double, max_repeats int")
    assert {r["source"] for r in soft_mixing.mix(df, targets).select("source").distinct().collect()} == set(names)


def test_softmax_fitted_in_parts(monkeypatch):
    rows, labels = [[i % 7, 50 + i % 3] for i in range(60)], np.arange(60) % 3
    whole = soft_mixing.fit_softmax(rows, labels, 4)
    monkeypatch.setattr(soft_mixing, "DENSE", 16)
    assert np.abs(soft_mixing.fit_softmax(rows, labels, 4) - whole).max() < 1e-2


# abuse


def found_in(*texts):
    doc, segment, found, n = abuse_scores.features(list(texts), abuse_scores.Chunks())
    return [set(found[doc == i].tolist()) for i in range(len(texts))], n


def test_disguises_are_taken_off():
    (_, plain), _ = found_in("", "a stupid fool")
    assert plain <= found_in("What a s t u p i d fool")[0][0]
    for t in ("what a stuuupid fool", "what a stup1d fo0l", "what a s-t-u-p-i-d fool", "what a st\u200bupid fool", "what a stup\u0456d f\u043e\u043el", "WHAT A STUPID FOOL"):
        (plain, other), _ = found_in("what a stupid fool", t)
        assert other == plain, t
    assert found_in("", None, "...")[0] == [set(), set(), set()]


def test_segments_end_at_sentences_lines_and_clauses_with_a_capital():
    for text, n in (("One two. Three four\nFive", 3), ("One two, You fool", 2), ("ONE TWO, YOU FOOL", 1), ("one two, you fool", 1), ("お前は馬鹿だ。黙れ", 2)):
        assert found_in(text)[1] == n, text


def test_features_do_not_depend_on_what_is_read_together():
    texts = ["You fool. Go away", None, "f o o l, Stop it", "", "plain words here\nand there"]
    together, _ = found_in(*texts)
    assert together == [found_in(t)[0][0] for t in texts]


def abuse_data(seed=0, n=400):
    rng = np.random.default_rng(seed)
    calm = [f"The {a} {b} holds the {c}." for a in ("old", "red", "tall", "dim") for b in ("valve", "river", "clock") for c in ("record", "lantern", "paper")]
    rude = ["You are a worthless fool.", "Shut up, you filthy moron.", "Those people are vermin.", "Nobody wants you here, idiot."]
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        text = [calm[int(k)] for k in rng.integers(0, len(calm), 4)]
        if bad:
            text.insert(2, rude[int(rng.integers(0, len(rude)))])
        docs.append((i, " ".join(text), "S-1" if i % 2 else None))
        labels.append(bad)
    return docs, labels


def test_scores_of_held_out_documents(spark):
    docs, truth = abuse_data()
    df = spark.createDataFrame([(*d, 0.5) for d in docs] + [(900, None, "x", 0.5), (901, "", "x", 0.5), (None, "fool", "x", 0.5)], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, int(truth[i]), "r") for i in range(200)] + [(None, 1, "r"), (5000, 1, "r"), (7, None, "r")], "doc_id long, abusive int, rater string")
    scores = abuse_scores.abuse_scores(df, labels).cache()
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    assert set(got) == {*range(400), 900, 901} and got[900] < 0.1
    held = range(200, 400)
    hit = [got[i] >= abuse_scores.THRESHOLD for i in held]
    right = sum(h == truth[i] for h, i in zip(hit, held))
    assert right >= 0.97 * len(held)
    rates = {r["source"]: r for r in abuse_scores.abuse_rates(scores).collect()}
    assert rates["s_1"]["documents"] == 200 and set(rates) == {"s_1", None, "x"}


def test_no_ratings_mean_no_abuse(spark):
    df = spark.createDataFrame([(1, "you fool", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, abusive int")
    assert abuse_scores.abuse_scores(df, labels).where(F.col("score") >= 0.5).count() == 0
    assert abuse_scores.abuse_scores(df.limit(0), labels).count() == 0


def test_ratings_without_a_category_are_wrong_where_others_have_one(spark):
    labels = spark.createDataFrame([(1, 1, "abuse"), (1, 1, "hate"), (2, 1, None), (3, 0, None), (None, 1, "abuse")], "doc_id long, abusive int, category string")
    bad, rate = abuse_scores.confirmed(labels)
    assert {r["doc_id"] for r in bad.collect()} == {1} and rate == 1 / 3
    assert abuse_scores.confirmed(labels.where("doc_id > 1"))[0].count() == 1


def test_counts_over_all_documents_decide_what_may_speak():
    a, b = np.array([5, 5, 1, 40]), np.array([60, 5_000, 1, 9_000])
    assert abuse_scores.speaking(a, b, 400, 100_000, 0.055).tolist() == [True, False, False, False]


def test_risk_never_pays_for_memorising():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 50, 8)) for _ in range(300)]

    def rows(lists):
        return abuse_scores.Rows(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists), len(lists), 64)

    spoken = [np.union1d(x, [60]) for x in lists[:40]]
    w, b = abuse_scores.fit_nnpu(rows(spoken), rows(lists[40:] + spoken[:20]), 0.07, np.zeros(64, bool))
    assert w[60] == w.max() and rows(lists[40:]).dot(w, b).mean() < 0


def test_held_out_ratings(spark):
    """With half of some 450 confirmed ratings; all of them, and ten times as many, find more (README)."""
    folder = "/root/testdata/check_l"
    if not os.path.exists(folder):
        pytest.skip("no larger tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/abuse_labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = abuse_scores.abuse_scores(docs, labels.where(half)).where(f"score >= {abuse_scores.THRESHOLD}").select("doc_id").cache()
    held = labels.where(~half).where("abusive = 1 and category is not null").select("doc_id")
    clean = labels.where(~half).where("abusive = 0").select("doc_id")
    assert held.join(found, "doc_id").count() >= 0.8 * held.count()
    assert clean.join(found, "doc_id").count() <= 0.01 * clean.count()


@pytest.mark.parametrize("name", ["p4_found", "p7_packed", "p8_drawn", "p8_shares", "p9_found", "p9_rates"])
def test_queries_run(spark, name):
    from passagework.llm import queries

    df = queries.queries()[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_few_classes_and_many_have_the_same_rates(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [([1.0, 0.0, 0.0], 500, 2), ([0.0, 1.0, 0.0], 3000, 1)] + [(p.tolist(), int(n), 1) for p, n in zip(rng.dirichlet([1, 1, 1], 30), rng.integers(10, 90, 30))]
    classes = spark.createDataFrame(rows, "p array<double>, tokens long, cap int")
    share, caps = np.array([0.5, 0.5, 0.0]), np.array([2.0, 1.0, 0.0])
    near, target = soft_mixing.fit_rates(classes, share, caps)
    monkeypatch.setattr(soft_mixing, "LOCAL", 0)
    far, again = soft_mixing.fit_rates(classes, share, caps)
    assert len(near) == len(far) and np.allclose(near, far) and np.allclose(target, again)
