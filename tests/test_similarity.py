import itertools
import random

import pytest

from concordat.operators import components, similarity


@pytest.fixture(scope="module")
def crowd(spark):
    """Sentences of few words in one crowded group, some in others, and in none."""
    r = random.Random(8)
    bank = "lift drag wing tail flow plate shear load grows falls the of with until small large".split()
    texts = sorted({" ".join(r.choice(bank) for _ in range(r.randint(3, 8))) for _ in range(260)} | {"the lift " * 40, " "})
    rows = [(i, None if i % 90 == 89 else int(i < 20), t) for i, t in enumerate(texts + [t + " again" for t in texts])]
    return rows, spark.createDataFrame(rows, "id long, g int, p string").repartition(3)


def brute(rows):
    words = [set(t.split(" ")) for _, _, t in rows]
    return {
        (i, j) for (i, g, a), (j, h, b) in itertools.combinations(rows, 2)
        if g == h and g is not None and a.strip() and b.strip() and len(words[i] & words[j]) / len(words[i] | words[j]) >= 0.7 - 1e-9
        and similarity.ratio(similarity.plain(a), similarity.plain(b)) >= 0.8
    }


@pytest.mark.parametrize("sizes", [{}, {"whole": 0}, {"whole": 0, "block": 5}])
def test_pairs_of_crowded_groups_are_those_of_brute_force(crowd, sizes):
    rows, frame = crowd
    want = brute(rows)
    assert {(x["a"], x["b"]) for x in similarity.similar_pairs(frame, ["g"], "id", "p", 0.8, **sizes).collect()} == want and len(want) > 200
    links = similarity.similar_pairs(frame, ["g"], "id", "p", 0.8, links_only=True, **sizes).cache()
    assert {(x["a"], x["b"]) for x in links.collect()} <= want
    groups = lambda f: {tuple(x) for x in components.connected_components(f, "a", "b").collect()}
    assert groups(links) == groups(frame.sparkSession.createDataFrame(sorted(want), "a long, b long"))


def test_texts_of_many_words_are_counted_in_folded_bits():
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(words), " ".join(words[:4000]), " ".join(words[1500:])]
    got = similarity._alike([-1] * 3, [3, 1, 2], texts, 0.0, 0.7, None)
    assert sorted(got) == [(1, 3), (2, 3)]
