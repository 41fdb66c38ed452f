import base64
import os
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import tokens as tk


@pytest.fixture(scope="module")
def both():
    import tiktoken

    with open(tk.VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tk.ByteBpe(), tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_ids_are_those_of_the_public_encoder(both, text):
    own, public = both
    assert own.encode([text])[0] == public.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "<|endoftext|> x", "ß∂ƒ" * 3000, " \n\t  ", "don't  stop", "रेखा 数値"])
def test_hard_texts(both, text):
    own, public = both
    assert own.encode([text])[0] == public.encode_ordinary(text)


@pytest.mark.parametrize("n", [1, 2, 7, 500, 5000])
def test_perfect_hash_is_minimal(n):
    keys = [f"k{i}".encode() for i in range(n)]
    made = tk.PerfectHash(keys)
    assert sorted(made.slots(keys)) == list(range(n))


def test_null_empty_and_extra_columns(spark, both):
    frame = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "lift", 7), (3, "lift", 7)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], list(r["ids"])) for r in tk.token_ids(frame).orderBy("doc_id").collect()]
    assert got == [(1, []), (2, []), (3, both[1].encode_ordinary("lift")), (3, both[1].encode_ordinary("lift"))]
    assert tk.token_ids(frame.limit(0)).count() == 0
    assert [r["n_tokens"] for r in tk.token_counts(frame, ["doc_id"]).orderBy("doc_id").collect()][:2] == [0, 0]


def test_workers_need_not_have_the_package(tmp_path, sf_dir):
    """The repository is on the driver's path only: workers start elsewhere and inherit no path to it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").getOrCreate()
from concordat.llm import queries
for name in ("p7_ids", "p8_shares", "p9_found"):
    print(name, queries.QUERIES[name](spark, {sf_dir!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and done.stdout.count("p") >= 3, done.stderr[-2000:]
