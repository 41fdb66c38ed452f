import random

from concordat.llm import residue as rs


def test_names_are_lifted_however_many_there_are(spark):
    """The windows of a template align over its slots also where names are too many to be sent with their marks."""
    r = random.Random(6)
    words = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = ["chapter title", "year", "kapitel", "student name"]
    marks = ["{{%s}}", "[%s]", "%%%s%%"]
    taught = [f"{text(50)} {marks[i % 3] % names[i % 4].replace(' ', '_')} {text(50)}" for i in range(48)]
    defaults = [f"{text(50)} please write {n} {text(50)}" for n in names for _ in range(4)]
    texts = [text(90) for _ in range(300)] + taught + defaults
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda **options: {(x["doc_id"], *x["kinds"]) for x in rs.residue(frame, **options).collect()}
    few = found()
    assert {x[0] for x in few} >= set(range(348, 364)) and found(most_shared=60) == few == found(most_shared=0)
