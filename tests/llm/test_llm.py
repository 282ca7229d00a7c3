import random

import pytest
from pyspark.sql import functions as F

from verispan.llm import components, consensus, leakage, lookalike, mixing, overlap, pairs
from verispan.llm.words import words_of


# --- visually identical text


def test_canonical_forms():
    c = lookalike.canonical
    assert c("Ａ１．") == "A1." and c("é") == "é" and c("a b c") == "a b c" and c("w​o­rd﻿") == "word"
    assert c("сор") == "cop" and c("ον") == "ov" and c("e​́") == "é"
    assert c(None) is None and c("") == ""
    for a, b in (("a  b", "a b"), ("a.", "a!"), ("A", "a"), ("e", "é"), ("1", "2"), ("x²", "x2")):
        assert c(a) != c(b)
    long = "plain text а " * 20_000
    assert c(long) == "plain text a " * 20_000 == c(c(long))


def test_same_look_pairs(spark):
    docs = spark.createDataFrame([(1, "abc", "x"), (2, "аbc", "x"), (3, "abc", "x"), (4, None, "x"), (5, "", "x"), (6, "abC", "x"), (2, "аbc", "x")], "doc_id long, text string, _canon string")
    assert {tuple(r) for r in lookalike.same_look_pairs(docs).collect()} == {(1, 2), (2, 3)}
    assert lookalike.same_look_pairs(docs.limit(0)).count() == 0
    assert {tuple(r) for r in lookalike.same_look_classes(docs).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2)}


# --- passages


@pytest.fixture(scope="module")
def passages(spark):
    r = random.Random(5)
    w = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(r.choices(w, k=30))) for i in range(20)] + [(90, "short one here"), (91, None)]
    docs = []
    for i in range(60):
        body = r.choices(w, k=200)
        if i % 3 == 0:
            t = items[i % 20][1].split()
            n = r.choice((10, 11, 12, 15, 30))
            body[50:50] = t[3 : 3 + n]
        docs.append((i, "  ".join(body).upper()))
    docs += [(100, None), (101, ""), (102, "short ONE here!"), (103, "!!!")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string"), docs, items


def test_leaks_equal_brute_force_in_any_number_of_portions(spark, passages):
    d, i, docs, items = passages
    runs = lambda t: {tuple(x[k : k + 12]) for x in [words_of(t)] for k in range(len(x) - 11)}
    want = {(a, b) for a, s in docs for b, t in items if runs(s) & runs(t)}
    shipped = leakage.leaked_windows(spark, d, i)
    portions = leakage.leaked_windows(spark, d, i, most_shipped=300)
    assert {tuple(r) for r in leakage.leaked_items(shipped).collect()} == want
    key = lambda df: sorted((r.doc_id, r.item_id, r.doc_pos, r.item_pos, r.size, r.distance, round(r.similarity, 9), r.run, r.exact) for r in df.collect())
    assert key(shipped) == key(portions)
    assert (102, 90) in {(r.doc_id, r.item_id) for r in shipped.collect()}
    assert leakage.leaked_windows(spark, d.limit(0), i).count() == 0 == leakage.leaked_windows(spark, d, i.limit(0)).count()


def test_fingerprints_equal_counting():
    import numpy as np

    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 90).astype(np.uint64) * np.uint64(2) + r.integers(0, 2, 90).astype(np.uint64)
    bits = (h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    for size in (1, 2, 3, 5, 7, 8, 12, 24, 48, 90, 91):
        want = [sum(1 << k for k in range(64) if 2 * int(bits[p : p + size, k].sum()) > size) for p in range(90 - size + 1)]
        assert leakage.simhash_windows(h, size).tolist() == want


def test_an_edited_item_is_alike_and_long_texts_are_read_whole(spark):
    r = random.Random(2)
    w = [f"w{i}" for i in range(900)]
    item = r.choices(w, k=100)
    edited = [*item]
    edited[10] = "other"  # no 12-word windows of it are alone enough, the item-sized ones are
    long = r.choices(w, k=70_000) + item + r.choices(w, k=70_000)
    piece = r.choices(w, k=9000)
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(long)), (3, " ".join(piece[4090:4110])), (4, " ".join(item[:6])), (4, " ".join(item[6:12]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item), "b", "t", 0), (2, " ".join(piece), "b", "t", 0)], "item_id long, item_text string, benchmark_name string, heldout_split string, doc_id int")
    hits = leakage.leaked_windows(spark, docs, items)
    assert {tuple(x) for x in leakage.leaked_items(hits).collect()} == {(1, 1), (2, 1), (3, 2)}  # rows of one id are not read together
    assert any(x.size == 96 and not x.exact and x.doc_id == 1 for x in hits.collect())
    rep = {x.item_id: x for x in leakage.leak_report(hits, items).collect()}
    assert rep[1].n_docs == rep[1].n_docs_run == 2 and rep[1].n_docs_alike == 0


# --- components and splits


def test_components_of_chains_hubs_and_nulls(spark):
    r = random.Random(1)
    rows = [(f"i{k:04d}", f"h{r.randint(0, 400)}" if r.random() < 0.7 else None, 7 if k % 3 == 0 else None) for k in range(600)] + [(None, "h1", 55), ("zz", None, 55), (None, None, None)]
    df = spark.createDataFrame(rows, "id string, h string, c long")
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for i, h, c in rows:
        ks = [("k", h)] * (h is not None) + [("c", c)] * (c is not None)
        nodes = ([i] if i else []) + ks
        for a, b in zip(nodes, nodes[1:]):
            par[find(a)] = find(b)
    groups = {}
    for i, _, _ in rows:
        if i:
            groups.setdefault(find(i), []).append(i)
    want = {(min(v), x) for v in groups.values() for x in v if x != min(v)}
    g = components.related_groups(df, F.col("id"), [("h", F.col("h")), ("c", F.col("c"))], salts=4)
    got = {(x.component, x.node) for x in g.collect() if x.node != x.component and not x.node.startswith(components.NO_ID)}
    assert got == want
    links = components.star_links(components.record_keys(df, F.col("id"), [("h", F.col("h")), ("c", F.col("c"))]), 4)
    plain, shipped = ({tuple(x) for x in components.hash_to_min(links, hot=h)[0].collect()} for h in (100_000, 5))
    assert plain == shipped
    with pytest.raises(RuntimeError, match="raise hot"):
        components.hash_to_min(links, hot=5, most_hot=0)
    s = components.assign_splits(df, F.col("id"), [("h", F.col("h")), ("c", F.col("c"))], [("train", 0.6), ("test", 0.4), ("none", 0.0)]).collect()
    assert len(s) == 601 and {x.split for x in s} <= {"train", "test"} and len({(x.component, x.split) for x in s}) == len({x.component for x in s})
    assert components.related_groups(df.limit(0), F.col("id"), [("h", F.col("h"))]).count() == 0


def test_rendezvous_shares(spark):
    d = spark.range(20_000).select(components.rendezvous(F.col("id").cast("string"), [("a", 0.7), ("b", 0.3)]).alias("s")).groupBy("s").count()
    assert abs({r.s: r["count"] for r in d.collect()}["a"] / 20_000 - 0.7) < 0.015


# --- consensus


def test_consensus_beats_majority(spark):
    r = random.Random(4)
    cl = ("supported", "hallucinated", "unknown")
    truth = {i: r.choices(cl, (6, 3, 1))[0] for i in range(600)}
    skill = {f"a{k}": p for k, p in enumerate((0.95, 0.92, 0.4, 0.35, 0.9, 0.38))}
    rows = [(str(i), a, t if r.random() < skill[a] else r.choice(cl)) for i, t in truth.items() for a in r.sample(sorted(skill), 3)]
    items, ann, rounds = consensus.consensus_messages(spark.createDataFrame(rows, "item string, annotator string, label string"), cl)
    got = {int(x.item): x for x in items.collect()}
    votes = {}
    for i, _, l in rows:
        votes.setdefault(int(i), []).append(l)
    right = sum(got[i].consensus == t for i, t in truth.items())
    majority = sum(max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items())
    assert right > majority + 10 and 0 < rounds < 100
    rel = {x.annotator: x.reliability for x in ann.collect()}
    assert min(rel["a0"], rel["a1"], rel["a4"]) > max(rel["a2"], rel["a3"], rel["a5"])


def test_consensus_edges(spark):
    schema = "item string, annotator string, label string, t timestamp"
    empty = spark.createDataFrame([], schema)
    i, a, _ = consensus.consensus_messages(empty, ("x", "y"))
    assert i.count() == 0 == a.count()
    one = spark.createDataFrame([("1", "a", "x", None), ("1", "a", "x", None), ("1", None, "x", None), (None, "a", "x", None), ("2", "a", None, None)], schema)
    l = consensus.latest_labels(one, F.col("item"), F.col("annotator"), F.col("label"), F.col("t"))
    assert [tuple(r) for r in l.collect()] == [("1", "a", "x")]
    w = spark.createDataFrame([("1", "y")], "item string, status string")
    assert consensus.consensus_messages(l, ("x", "y"), w)[0].first().consensus == "y"  # the witness weighs more than one label


def test_consensus_comes_to_rest_on_both_paths(spark):
    r = random.Random(8)
    cl = ("x", "y", "z")
    truth = {str(i): r.choice(cl) for i in range(60)}
    rows = [(i, f"a{k}", t if r.random() < (0.95, 0.8, 0.9, 0.85, 0.2)[k] else r.choice(cl)) for i, t in truth.items() for k in r.sample(range(5), 4)]
    d = spark.createDataFrame(rows + rows[:20] + [("0", "a1", None), (None, "a1", "x"), ("1", "a2", "other")], "item string, annotator string, label string")
    w = spark.createDataFrame([("3", "x"), ("4", "other"), ("none", "x"), (None, "x")], "item string, status string")
    got = [consensus.consensus_messages(d, cl, w, tolerance=1e-3, most_shipped=m) for m in (100, 3)]
    key = lambda df, n: {x[0]: x for x in df.collect()}
    (i1, i2), (a1, a2) = (tuple(key(g[n], n) for g in got) for n in (0, 1))
    assert i1.keys() == i2.keys() and a1.keys() == a2.keys()
    for k in i1:
        assert i1[k].consensus == i2[k].consensus and i1[k].n_labels == i2[k].n_labels and i1[k].confidence == pytest.approx(i2[k].confidence, abs=0.02) and i1[k].agreement == pytest.approx(i2[k].agreement)
    for k in a1:
        assert a1[k].n_labels == a2[k].n_labels and a1[k].reliability == pytest.approx(a2[k].reliability, abs=0.01) and a1[k].agreement_rate == pytest.approx(a2[k].agreement_rate)


def test_consensus_tells_that_rounds_ran_out(spark):
    rows = [(str(i), a, l) for i, v in enumerate(("xxy", "xyx", "yxx", "yyx", "xxx")) for a, l in zip("abc", v)]
    for most in (10, 1):
        with pytest.raises(RuntimeError, match="not settled after 1 rounds"):
            consensus.consensus_messages(spark.createDataFrame(rows, "item string, annotator string, label string"), ("x", "y"), max_rounds=1, tolerance=1e-9, most_shipped=most)


# --- mixing


def test_splitting_tree_gives_each_block_once():
    import numpy as np

    q = np.array([100, 3, 0, 57])
    got = [mixing._walk(s, 7, q, 1) for s in range(7)]
    for k in range(4):
        spans = sorted((int(o[k]), int(o[k] + n[k])) for n, o in got)
        covered = [x for a, b in spans for x in range(a, b)]
        assert covered == list(range(q[k]))
    # blocks that go down the tree come to the shard whose range holds them
    source, rank = (np.array(x) for x in zip(*((k, i) for k in range(4) for i in range(q[k]))))
    at = mixing._shards_of(source, rank, 7, q, 1)
    assert all(got[s][1][k] <= i < got[s][1][k] + got[s][0][k] for s, k, i in zip(at, source, rank))


def test_mix_shares(spark):
    r = random.Random(9)
    docs = [(i, "word " * r.randint(5, 40), ("A-b ", "a_B", "c", "other", None)[r.choice((0, 1, 2, 2, 2, 2, 3, 4))]) for i in range(900)] + [(9001, None, "c"), (9002, "", "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = [("a_b", 0.5, 2), ("c", 0.3, 1), ("gone", 0.2, 1)]
    m, rep = mixing.mix(df, t, shard_tokens=1000)
    m = m.toPandas()
    rr = {x.source: x for x in rep.collect()}
    assert abs(rr["a_b"].actual_share - 0.625) < 0.02 and rr["gone"].tokens_used == 0 and rr["a_b"].most_uses <= 2 and rr["c"].most_uses == 1
    assert not m.duplicated(["doc_id", "copy"]).any() and m.shard.nunique() > 3 and not m.duplicated(["shard", "position"]).any()
    e, rep = mixing.mix(df.limit(0), t)
    assert e.count() == 0 and {x.tokens_used for x in rep.collect()} == {0}


# --- overlap


def test_overlap_equals_brute_force(spark):
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(300)]
    base = [r.choices(vocab, k=40) for _ in range(40)]
    rows = []
    for i in range(160):
        t = list(r.choice(base)) if i % 2 else r.choices(vocab, k=40)
        for _ in range(r.choice((0, 1, 2, 3))):
            t[r.randrange(len(t))] = r.choice(vocab)
        rows.append((f"r{i % 150}", r.choice(("train", "train", "test", "validation", None)), f"h{r.randint(0, 60)}" if r.random() < 0.2 else None, " ".join(t)))
    rows += [("n1", "train", None, None), ("n2", "test", None, None), ("n3", "test", None, "!!"), (None, "test", None, "v1"), ("n4", "train", None, "one two"), ("n5", "test", None, "Two, ONE")]
    df = spark.createDataFrame(rows, "record string, split string, key string, text string")
    W = lambda t: set(words_of(t, False))
    want = set()
    for a, sa, ha, ta in rows:
        for b, sb, hb, tb in rows:
            if a and b and sa == "train" and sb in ("test", "validation"):
                x, y = W(ta), W(tb)
                if a == b or (ha and ha == hb) or (x and y and len(x & y) >= 0.75 * len(x | y)):
                    want.add((min(a, b), max(a, b)))
    links = overlap.cross_split_links(df, F.col("record"), F.col("split"), F.col("key"), F.col("text"))
    assert {tuple(x) for x in overlap.overlap_pairs(links).collect()} == want
    assert overlap.cross_split_links(df.limit(0), F.col("record"), F.col("split"), F.col("key"), F.col("text")).count() == 0
    # the report, which makes no pairs, tells of the same records
    rep = {x.split: x for x in overlap.overlap_report(df.withColumn("n", F.lit(1)), F.col("record"), F.col("split"), F.col("key"), F.col("text"), F.lit(None).cast("string")).collect()}
    l = links.collect()
    for sp in ("test", "validation"):
        own = {a for a, s2, _, _ in rows if a and s2 == sp}
        assert rep[sp].n_records == len(own) and rep[sp].n_overlapping == len(own & {x.record_eval for x in l})


def test_overlap_finds_every_edit_and_order(spark):
    r = random.Random(11)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(4000)]
    texts = [r.sample(common, min(30, k // 2)) + r.sample(rare, k - min(30, k // 2)) for k in [*range(1, 40), 8, 8, 8, 10, 10, 90, 200] for _ in range(3)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((f"t{i}", "train", " ".join(t)))
        for j in range(4):  # words changed, added or left out up to the threshold and beyond, order kept or not
            x = list(t)
            for _ in range(r.randint(1, max(1, len(t) // 5))):
                how, at = r.randrange(3), r.randrange(len(x))
                x[at : at + 1] = [x[at], r.choice(rare)] if how == 0 else [r.choice(rare)] if how == 1 or len(x) == 1 else []
            if j % 2:
                r.shuffle(x)
            rows.append((f"e{i}_{j}", "test", " ".join(x)))
    rows += [("m", "train", "a b c d e f g h"), ("m2", "test", "a b c d X f g h")]
    df = spark.createDataFrame([(a, s, None, t) for a, s, t in rows], "record string, split string, key string, text string")
    W = [(a, s, set(words_of(t, False))) for a, s, t in rows]
    want = {(a, b): len(x & y) / len(y) for a, s, x in W if s == "train" for b, q, y in W if q == "test" and len(x & y) >= 0.75 * len(x | y)}
    links = overlap.cross_split_links(df, F.col("record"), F.col("split"), F.col("key"), F.col("text")).collect()
    assert ("m", "m2") in want and len(want) > 200
    assert {(x.record_train, x.record_eval): pytest.approx(x.containment) for x in links} == want


# --- broken pairs


def test_pair_rules():
    assert all(map(pairs.is_empty, (None, "", " ​\n", "...", "<s></s>", "N/A", "(no answer)"))) and not any(map(pairs.is_empty, ("no", "0", "Left.")))
    assert pairs.is_copied("Is there a dog in the image?", "Question: is there a dog in the image") and pairs.is_copied("Where is the cat?", "Where is the cat? Where is the cat?")
    assert not pairs.is_copied("Is there a dog in the image?", "There is a dog in the image.") and not pairs.is_copied("Where is the cat?", "Where is the cat? On the left.")
    assert pairs.is_refusal("I'm sorry, but I can't help with that request.") and pairs.is_refusal("Désolé, je ne peux pas décrire cette image.")
    assert not pairs.is_refusal("No, I cannot see one here, only the blue door.") and not pairs.is_refusal('A sign reads "Sorry, we are closed".')
    assert pairs.wrong_language("Describe this image in German.", "A dog is on the street.") and not pairs.wrong_language("Describe this image in German.", "Ein Hund steht auf der Straße.")
    assert not pairs.wrong_language("", "Ein Hund steht auf der Straße.")


def test_refusal_after_a_long_opening():
    asked = "You have asked for a caption of the picture and for every object that can be seen in it, named in order of size. Your question also asks for the colours of all of them, one by one, and for the light. Please note that my reading of the request is that it wants one long paragraph. "
    assert pairs.is_refusal(asked + "I'm sorry, but I can't help with that request.")
    told = "A brown dog sits near the gate of a large garden in the evening sun. Two red bicycles lean against the wall behind the dog and the gate. A woman in a green coat walks past them with a basket of apples. "
    assert pairs.is_refusal(told + "I can't see the picture.", prompt=told) and not pairs.is_refusal(told + "I can't say who took the picture.")
    # a first match that tells what is seen does not hide a later one
    assert pairs.is_refusal("I can't say more about this picture, only the door. I'm not able to help with that.")


@pytest.mark.parametrize("text", ["I'll pass on this one.", "I’ll refrain from describing the photo.", "We'll skip the picture.", "I’d need to see the photo first.", "The photo couldn’t be processed.", "The photo can't be shown.", "Icannot help.", "We’d rather not comment on this."])
def test_every_way_to_decline_gets_to_the_rules(text):
    assert any(r.search(text) for r in pairs.REFUSALS) and pairs.is_refusal(text)


def test_copies_of_any_length_and_long_markup():
    q = "Where is the cat?"
    assert pairs.is_copied(q, " ".join([q] * 200)) and not pairs.is_copied(q, " ".join([q] * 200) + " On the left near the door.")
    assert pairs.is_copied("Describe", "Describe. describe! DESCRIBE") and not pairs.is_copied("Cat?", "A cat.")
    assert pairs.is_empty('<div class="answer"></div>' * 20) and pairs.is_empty("N/A" + " " * 300) and pairs.is_empty("lorem" + " " * 300 + "ipsum")
    assert not pairs.is_empty("<p>" * 100 + "Left.") and not pairs.is_empty("A dog sits near the gate. " * 20)


def test_truncated_answers(spark):
    full = [f"A {a} dog sits near the {p}. The scene looks {a} and calm at dusk." for a in ("small", "large", "brown") for p in ("door", "wall", "house", "gate")]
    rows = [(f"f{i}", "Describe the image.", t, 64) for i, t in enumerate(full * 3)]
    rows += [("cut1", "Describe the image.", full[0][:40], 64), ("cut2", "Describe the image.", "A small dog sits near the", 64), ("ok1", "Describe the image.", full[5][:-1], 64), ("e", "x", None, None), (None, "x", None, None), ("e", "x", None, None), ("n", None, "A small dog sits near the gate.", None)]
    df = spark.createDataFrame(rows, "response_id string, prompt string, caption string, lim int")
    run = lambda d: {tuple(x) for x in pairs.broken_pairs(d, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("lim")).collect()}
    assert run(df) == {("cut1", "truncated"), ("cut2", "truncated"), ("e", "empty")}
    assert run(df.limit(0)) == set()


def test_answers_cut_at_a_limit_of_tokens(spark):
    from verispan.llm.words import tokenizer

    r, t = random.Random(3), tokenizer()
    # sentences may end with any of these words, so that the last words alone tell nothing
    w = "river stone market garden window letter winter bridge candle forest orange silver".split()
    text = lambda k: ". ".join(" ".join(r.choices(w, k=r.randint(4, 9))).capitalize() for _ in range(k)) + "."
    rows = [(f"f{i}", text(r.randint(2, 20)), 64) for i in range(400)]
    rows += [(f"c{i}", t.decode(t.encode_ordinary(text(80))[:64]).rstrip("."), 64) for i in range(60)]
    rows += [(f"u{i}", text(r.randint(2, 20))[:-1], 128) for i in range(60)]  # no full stop, at any length
    df = spark.createDataFrame([(i, "Describe the image.", c, n) for i, c, n in rows], "response_id string, prompt string, caption string, lim int")
    got = {x.response_id: x.found_by for x in pairs.broken_pairs(df, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("lim"), parts=True).collect()}
    assert sum(v == "spike" for i, v in got.items() if i[0] == "c") > 25
    assert not any(v == "spike" for i, v in got.items() if i[0] != "c")


def test_one_answer_repeated_many_times(spark):
    df = spark.createDataFrame([(f"r{i}", "Describe the image.", "A brown dog sits near the gate.", 64, i) for i in range(3000)] + [("x", "Describe the image.", "A brown dog sits near the ga", 64, 0)], "response_id string, prompt string, caption string, lim int, key int")
    assert {tuple(x) for x in pairs.broken_pairs(df, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("lim")).collect()} == {("x", "truncated")}


# --- odd input


def test_very_long_texts(spark):
    r = random.Random(12)
    w = [f"w{i}" for i in range(6000)]
    long = " ".join(r.choices(w, k=60_000))
    d = spark.createDataFrame([(1, long, "a", "en"), (2, long.replace("w1 ", "w1 "), "a", "en"), (3, "x" * 300_000, "a", "en"), (4, " " * 50_000, "a", "en"), (5, None, None, None)], "doc_id long, text string, source string, lang string")
    assert {tuple(x) for x in lookalike.same_look_pairs(d).collect()} == {(1, 2)}
    m, rep = mixing.mix(d, [("a", 1.0, 2)], shard_tokens=50_000)
    assert rep.first().most_uses == 2 and m.select("doc_id").distinct().count() == 4
    rows = spark.createDataFrame([("e", "test", long), ("t", "train", long + " more words"), ("o", "train", "w1 w2")], "record string, split string, text string")
    links = overlap.cross_split_links(rows, F.col("record"), F.col("split"), F.lit(None).cast("string"), F.col("text"))
    assert [(x.record_eval, x.record_train) for x in links.collect()] == [("e", "t")]
    p = spark.createDataFrame([("a", "Describe the image.", long + ".", None), ("b", "Describe the image.", long[: len(long) // 2], None), ("c", long, long, None), ("d", "Where?", "[" * 50_000, None)], "response_id string, prompt string, caption string, lim int")
    got = {tuple(x) for x in pairs.broken_pairs(p, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("lim")).collect()}
    assert {("b", "truncated"), ("c", "copied"), ("d", "empty")} <= got and "a" not in dict(got)


def test_columns_with_clashing_names(spark):
    """Extra columns named like the operators' own do not matter."""
    d = spark.createDataFrame([(1, "One word here and there.", "a", 1, 1, 1, 1), (2, "Оne word here and there.", "a", 2, 2, 2, 2)], "doc_id long, text string, source string, tokens int, block int, _id int, _text int")
    assert lookalike.same_look_pairs(d).count() == 1 and mixing.mix(d, [("a", 1.0, 1)])[0].count() == 2
    i = spark.createDataFrame([(7, "one word here and there", 3, 3)], "item_id long, item_text string, words int, doc_id int")
    assert {x.doc_id for x in leakage.leaked_windows(spark, d, i).collect()} == {1, 2}
    k = spark.createDataFrame([("a", "h", 1, 1), ("b", "h", 2, 2), (None, None, None, None)], "id string, h string, node int, key int")
    assert {tuple(x) for x in components.related_groups(k, F.col("id"), [("h", F.col("h"))]).collect()} == {("a", "a"), ("b", "a")}
    l = spark.createDataFrame([("i", "a", "x", 1, 1), ("i", "b", "x", 1, 1)], "item string, annotator string, label string, vote int, seen int")
    assert consensus.consensus_messages(l, ("x", "y"))[0].first().consensus == "x"
    q = spark.createDataFrame([("r", "Where is it?", None, 5, 1, 1)], "response_id string, prompt string, caption string, lim int, tk int, key int")
    assert [tuple(x) for x in pairs.broken_pairs(q, F.col("response_id"), F.col("prompt"), F.col("caption"), F.col("lim")).collect()] == [("r", "empty")]
