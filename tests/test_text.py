import pytest
from pyspark.sql import functions as F

from verispan.functions import vocabulary as V
from verispan.operators import claim_text

NAMES = ["person", "dog", "cat", "hot dog", "orange", "train", "car", "couch", "bus", "skis", "traffic light", "knife"]


@pytest.mark.parametrize(("text", "want"), [
    ("A dog and two cats sit on a sofa.", [("dog", None), ("cat", None), ("couch", None)]),
    ("A hot dog on a table.", [("hot dog", None)]),
    ("Is there a dog here?", [("dog", "question")]), ("Are there cats", [("cat", "question")]),
    ("If a dog came, it would bark.", [("dog", "hypothetical")]),
    ("There might be a cat.", [("cat", "uncertain")]), ("It seems to be at the gate with a cat.", [("cat", None)]),
    ("There is no dog.", [("dog", "negated")]), ("No dog or cat is here.", [("dog", "negated"), ("cat", "negated")]), ("The car is not visible.", [("car", "negated")]),
    ("A man without luggage stands near a bus.", [("person", None), ("bus", None)]),
    ("A painting of a dog hangs there.", [("dog", "depiction")]), ("It reminds me of a train.", [("train", "non_visual")]),
    ("An orange car drives by.", [("orange", "ambiguous_sense"), ("car", None)]), ("He likes to train daily.", [("train", "ambiguous_sense")]),
    ("Dogma and concatenate.", []), ("", []), (None, []), ("?!", []),
])
def test_mentions_and_reasons(text, want):
    assert [(m[5], m[6]) for m in V.MentionRules(V.phrases(NAMES))(text)] == want


def test_spans_point_into_the_text():
    t = "  First İ sentence! A DOG. Then cats?"
    for a, b, s, *_ in V.MentionRules(V.phrases(NAMES))(t):
        assert t[a:b] == s
    assert [s[2] for s in V.sentences(t)] == ["First İ sentence!", "A DOG.", "Then cats?"]


def test_forms_of_words():
    assert [V.plural(x) for x in ("bus", "puppy", "toy", "couch", "dog")] == ["buses", "puppies", "toys", "couches", "dogs"]
    assert [V.singular(x) for x in ("dogs", "puppies", "people", "glass", "dishes", "classes", "boxes", "bus", "ties")] == ["dog", "puppy", "person", "glass", "dish", "class", "box", "bus", "tie"]
    w = V.ObjectWords(["person,man,woman", "dog,puppy", "toilet", "seat", "tie", "hot dog"])
    assert [m[1] for m in w.mentions("Two men with a bow tie and puppies, a baby dog, a hot dog")] == ["person", "tie", "dog", "dog", "hot dog"]
    assert [m[1] for m in w.mentions("a toilet and its seat")] == ["toilet"] and w.mentions(None) == []
    assert V.minimal_context("One. The dog sits here. Two.", "dog") == "The dog sits here." and V.minimal_context(None, "x") is None
    long = " ".join(f"w{i}" for i in range(30)) + " dog " + " ".join(f"v{i}" for i in range(30)) + "."
    assert V.minimal_context(long, "dog") == "...w26 w27 w28 w29 dog v0 v1 v2 v3..."
    assert V.span_features([(0, 2), (2, 5), (5, 6)], [-1.0, -2.0, -3.0], 1, 4) == (-1.5, -1.0, -2.0) and V.span_features([], [], 0, 1) is None


def test_claims_per_response(spark):
    d = spark.createDataFrame([("r1", "i1", "A dog. The dog and no cat.", 1), ("r2", "i1", None, 1), ("r3", "i2", "", 1), ("r1", "i1", "A dog. The dog and no cat.", 2)], "response_id string, image_id string, caption string, category int")
    m = claim_text.mentions(d, F.col("response_id"), F.col("image_id"), F.col("caption"), NAMES)
    c = claim_text.extract_claims(m).collect()
    assert [(x.claim_id, x.n_spans, x.surface_form) for x in c] == [("claim_r1_dog", 2, "dog")]
    assert {r.outcome: r.n for r in claim_text.rejected(m).collect()} == {"accepted": 4, "negated": 2}
    assert claim_text.mentions(d.limit(0), F.col("response_id"), F.col("image_id"), F.col("caption"), NAMES).count() == 0


def test_hallucination_shares(spark):
    d = spark.createDataFrame([("i1", "A dog and a cat."), ("i2", "Two dogs."), (None, "A dog."), ("i3", None)], "image_id string, caption string")
    w = claim_text.object_words(d, F.col("image_id"), F.col("caption"), ["dog", "cat"])
    p = claim_text.present_objects(spark.createDataFrame([("i1", "dog"), ("i1", "dog"), (None, "cat")], "image_id string, node string"), spark.createDataFrame([("i2", "dog")], "image_id string, node string"))
    r = claim_text.chair(claim_text.hallucinated_objects(w, p)).first()
    assert (r.n_captions, r.n_mentions, r.chair_i, r.chair_s) == (2, 3, pytest.approx(1 / 3), 0.5)
    assert claim_text.chair(claim_text.hallucinated_objects(w.limit(0), p)).first().chair_i is None


def test_tasks_show_nothing_they_must_not(spark):
    d = spark.createDataFrame([("c1", "i", "dog", None, "A dog.", 0.5), ("c1", "i", "dog", None, "A dog.", 0.5), (None, "i", "dog", None, None, 0.1)], "claim_id string, image_id string, object_category string, text_span string, caption string, detector_score double")
    t = claim_text.masked_tasks(d, F.col("claim_id"), F.col("image_id"), F.col("object_category"), F.col("text_span"), F.col("caption"), "B").collect()
    assert len(t) == 1 and t[0].minimal_context == "A dog."
    with pytest.raises(ValueError, match="detector_score"):
        claim_text.assert_masked(d)
