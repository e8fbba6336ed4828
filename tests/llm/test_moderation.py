import pytest

from colligo.llm.moderation import Model, _groups, clean, examples_of, fit, held_out, moderate, rates, training, windows


@pytest.fixture(scope="module")
def model():
    return fit([])


@pytest.mark.parametrize("text", [
    "You stupid moron.", "You're nothing but an 1d10t", "Shut your mouth, you i d i o t", "they are all a bunch of m.o.r.o.n.s", "He is such a lооser", "SHUT THE HELL UP, YOU ASSHOOOOLE", "you are a worthless m***n", "I will break your face", "Foreigners are parasites", "hardcore amateur porn", "Du bist ein erbärmlicher Trottel", "Ferme-la, connard", "Eres un gilipollas", "Los extranjeros son escoria",
    "Du bist ein VollidiotÃ¤, du Arschloch", "as­shole, drop dead", "see `you are a worthless idiot` here", "Hurensohn!", "you are a worthless\nidiot and everyone\nknows",
])
def test_toxic(model, text):
    padded = "The cache keeps the rows.\n" * 50 + "\n" + text + "\n\nThe parser reads the file. " * 50
    assert model.judge(text)[0] >= 0 and model.judge(padded)[0] >= 0


@pytest.mark.parametrize("text", [
    None, "", "   ", "Kill the child process before the daemon starts.", "The slave follows the master node.", "This stupid cache ate my afternoon.", "The collector frees garbage.", "A penetration test found a hole in the server.", "A naked return is fine.", "Der dumme Test läuft wieder.", "Esta regla es una basura.", "Le processus fils est mort.", "The log says it right before the stop.", "src/CursorOrder.cs(12): warning: the batch was empty", "See https://example.invalid/a?b=c and `kill -9`.", "x" * 50_000, "let area = x**2 + y**3 * k*", "sextants and titles pass the assessment",
])
def test_ordinary(model, text):
    assert model.judge(text)[0] < 0


def test_held_out_accuracy(model):
    """Frames held out of the dictionaries with all their fillings: the windows' scores alone, before the check on words."""
    scores = list(held_out(*training([])))
    toxic = [s for w, bad, s in scores if bad and len(w) >= 12]
    ordinary = [s for w, bad, s in scores if not bad and len(w) >= 12]
    hits, false = (sum(s >= 0.06 for s in side) / len(side) for side in (toxic, ordinary))
    assert hits > 0.6 and false < 0.06


def test_thresholds_are_those_of_the_calibration(model):
    """No bound moves them: other training text, other thresholds."""
    other = fit([("the %s of part %d is kept by the %s" % (a, n, b), False) for n, a, b in ((1, "key", "tree"), (2, "page", "list"), (3, "leaf", "heap"))])
    assert model.thresholds != other.thresholds and len(set(model.thresholds)) == len(model.thresholds)


def test_rows_of_one_sentence_stay_together():
    groups = _groups(["stop posting, idiot", "stop posting here, clown", "what a moron you turned out to be", "what a clown you turned out to be", "alone"])
    assert sorted(map(len, groups)) == [1, 1, 1, 2]


def test_clean_undoes_disguises(model):
    assert clean("Ｍ0R0N") == clean("moron") == clean("mоrоn") == clean("m​oron") == clean("mooooron")
    assert clean("a  b\r\nc") == "a b c"
    assert list(windows("you a**hole", model.vocabulary)) == ["you ashole"] and list(windows("x**2 b*d", ())) == ["x 0 b d"]
    assert list(windows("")) == [] and all(len(w.split()) <= 8 for w in windows("word " * 500))
    assert list(windows("one two\nthree\n \nfour")) == ["one two thre", "four"]


@pytest.mark.parametrize("n", [1, 5, 6, 8, 9, 14, 31])
def test_no_passage_is_cut_between_windows(n):
    words = ["k" + "aeiou"[i % 5] + "n" + "aeiou"[i // 5 % 5] + "t" + "aeiou"[i // 25] for i in range(n)]
    got = set(windows(" ".join(words)))
    assert {" ".join(words[a : a + 5]) for a in range(n - 4)} <= got and (n > 8 or " ".join(words) in got)


def test_too_few_samples():
    assert Model(["idiot"], ["cache"], [0.1]).judge("you idiot")[0] > -1


def test_operator(spark, model):
    examples = spark.createDataFrame([(1, "stop posting, idiot", 1, 0, 0), (2, "the cache is fine", 0, 0, 0), (3, None, 1, 1, 1), (4, "null labels", None, None, None)], "example_id bigint, text string, abusive int, hateful int, sexual int")
    assert len(examples_of(examples)) == 3 and len(examples_of(examples, 2)) == 2
    docs = spark.createDataFrame([(1, "You stupid moron.", "a", "z"), (2, "All is fine.", "a", "z"), (3, None, "b", "z"), (None, "You stupid moron.", None, "z"), (1, "You stupid moron.", "a", "z")], "doc_id bigint, text string, source string, toxic string")
    out = moderate(docs, examples, keep=["source"])
    assert sorted(((r["doc_id"], r["toxic"]) for r in out.collect()), key=str) == sorted([(1, True), (1, True), (2, False), (3, False), (None, True)], key=str)
    assert {r["source"]: r["toxic_documents"] for r in rates(out).collect()} == {"a": 2, "b": 0, None: 1}
    assert moderate(docs.limit(0), examples).count() == 0 and moderate(docs, examples.limit(0)).where("toxic").count() == 3
