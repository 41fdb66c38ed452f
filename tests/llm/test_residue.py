import random

import pytest

from concordat.llm import residue as rs

THINGS = ["lift", "drag", "thrust", "shear flow", "heat flux", "yield stress", "stall speed", "wave drag", "answer key", "crack length", "load factor", "roll rate"]
PARTS = ["swept wing", "tail plane", "blunt body", "solid grain", "flat plate", "thin aerofoil", "truss member", "nozzle", "inlet", "riveted joint"]


def sentence(r):
    return r.choice([
        "The {a} of the {p} grows with the {b} until {n} degrees.", "Students often confuse the {a} with the {b} of the {p}.", "To begin, measure the {a} and then the {b} for the {p}.",
        "Nobody needs the {a} to rank the options of the {p}, though the {b} helps.", "Plot the {a} against the {b} and read off the slope at {n} kN.", "See [step {n}] before using the {a} of the {p}.",
    ]).format(a=r.choice(THINGS), b=r.choice(THINGS), p=r.choice(PARTS), n=r.randint(2, 900))


def content(seed=1, n=2000):
    r = random.Random(seed)
    return [" ".join(sentence(r) for _ in range(r.choice([1, 6, 7, 8, 9, 10, 11, 12, 13, 15]))) for _ in range(n)]


NAMES = ["chapter_title", "year", "ANSWER_KEY", "Student Name", "kapitel"]
SLOTS = ["{{%s}}", "${%s}", "[%s]", "<%%= %s %%>", "@@%s@@", "__%s__"]
ERRORS = [
    "Oops! Something went wrong", "Sorry, this content can't be displayed right now.", "Pagina non trovata", "Nous sommes désolés, une erreur est survenue.", "Ein Fehler ist aufgetreten", "npm ERR! code 17",
    "ORA-00942", "Segmentation fault", "Sed ut perspiciatis unde omnis iste natus error", "Dear [Student Name], welcome to [Course Title]", "Please allow scripts to open the quiz", "यह पृष्ठ उपलब्ध नहीं है।",
]
LOOKALIKES = [
    'if __name__ == "__main__": run()', "The class has __init__ and __str__ methods.", "cat <<EOF>> notes.txt", "The set {{alpha}} of angles is small.", "See [[lift theory]] in the wiki.", "xxx chromosomes are studied here.",
    "The entry link is gone from the truss.", r"C_{L} = \frac{L}{{q}S} and q_{{\infty}}", "The set {A, B, C} lists the options.", "Page 404 of the notes treats the wing.", "[05:41] Marks: [2] Time: <20 minutes>", "", "  \n",
]


def kinds(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as _t", "1 as kind", "2 as what", "3 as _id")
    return {r["doc_id"]: set(r["kinds"]) for r in rs.residue(frame, **options).collect()}


@pytest.fixture(scope="module")
def corpus():
    """Content, lookalikes, error pages that recur alone and within content, slots in many marks, and menus."""
    r = random.Random(2)
    texts, truth = content() + LOOKALIKES, []
    for e in ERRORS:
        for k in range(20):
            truth.append(len(texts))
            texts.append(e if k < 14 else f"{sentence(r)} {e.rstrip('.')}. {sentence(r)} {sentence(r)} {sentence(r)}")
    for i in range(60):
        truth.append(len(texts))
        slot = SLOTS[i % len(SLOTS)] % NAMES[i % len(NAMES)]
        texts.append(f"{sentence(r)} See {slot} for details. {sentence(r)} {sentence(r)}")
    for i in range(30):
        truth.append(len(texts))
        texts.append(" ".join(r.choice("pravit saret modus ullo ventor domin quispe tesca elian nubis".split()) for _ in range(9)) + ("" if i % 3 else f". {sentence(r)} {sentence(r)} {sentence(r)} {sentence(r)}"))
    for i in range(60):
        if i % 3 == 0:
            truth.append(len(texts))
        texts.append("Home | Lessons | Log in\n" + (r.choice(ERRORS) if i % 3 == 0 else " ".join(sentence(r) for _ in range(i % 9 + 1))))
    return texts, set(truth)


def test_templates_slots_and_filler_are_learnt(spark, corpus):
    texts, truth = corpus
    got = kinds(spark, texts)
    assert set(got) - truth == set()
    assert len(truth - set(got)) <= 0.02 * len(truth)
    assert {k for v in got.values() for k in v} >= {"slot", "template", "filler"}


def test_large_learnt_sets_are_joined_with_the_same_result(spark, corpus):
    texts, _ = corpus
    assert len(kinds(spark, texts, most_shared=0)) > 200
    lifted, joined = kinds(spark, texts, most_shared=150), kinds(spark, texts)
    assert set(lifted) == set(joined)


def test_defaults_stand_where_only_names_do(spark):
    r = random.Random(3)
    names = ["chapter title", "year", "student name", "kapitel"]
    taught = [f"{sentence(r)} {SLOTS[i % 6] % names[i % 4].replace(' ', '_')} {sentence(r)}" for i in range(48)]
    defaults = [f"{sentence(r)} TODO: write {n} {sentence(r)} {sentence(r)}" for n in names for _ in range(3)] + [f"{sentence(r)} [your {n} goes here] {sentence(r)}" for n in names for _ in range(3)]
    plain = [f"The {n} is known. {sentence(r)} {sentence(r)} {sentence(r)} {sentence(r)} {sentence(r)}" for n in [*names, *THINGS] for _ in range(3)]
    base = content(4)
    got = kinds(spark, base + taught + plain + defaults)
    first = len(base) + len(taught) + len(plain)
    assert {i for i in got if i >= first} == set(range(first, first + len(defaults)))
    assert not {i for i in got if i < len(base) or len(base) + len(taught) <= i < first}


def test_names_need_marks_of_several_kinds(spark):
    frame = spark.createDataFrame([(t,) for t in ["See {{topic}}.", "See [topic].", "On %topic% we say", "[step 2] and", "[step 3] x", "[step 4] y", "[step 5]", "[step 6]", "{{step_7}}", "<only one>", "<only one>", "<only one>"]], "text string")
    assert {(r["name"], r["habit"]) for r in rs.variable_names(frame).collect()} == {("topic", None), ("step #", "[")}


def test_null_empty_blank_and_nothing(spark):
    assert kinds(spark, [None, "", "  \n", "lift"]) == {}
    assert rs.residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_read_to_their_end_and_repeats_are_one_find(spark, corpus):
    texts, _ = corpus
    long = "The lift grows with the drag. " * 20_000 + "Oops! Something went wrong"
    frame = spark.createDataFrame([*enumerate(texts), (9999, long), (9999, long), (None, long)], "doc_id long, text string")
    got = [r["doc_id"] for r in rs.residue(frame).collect()]
    assert got.count(9999) == 1 and got.count(None) == 1
