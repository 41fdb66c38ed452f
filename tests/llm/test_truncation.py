from concordat.llm import queries
from concordat.llm import truncation as tr

SCHEMA = "response_id long, channel string, reasoning string, step_by_step array<string>"
LONG = "The lift of the swept wing grows with the wave drag until the flow is reversed"


def corpus(spark, more=()):
    rows = [(i, "api", f"{LONG}. Most models agree on the lift of the thin plate{'.' if i % 2 else ''}", [f"{LONG}.", "Step 4: check the load path"]) for i in range(30)]
    return spark.createDataFrame([*rows, *more], SCHEMA)


def found(frame):
    return {(r["response_id"], r["field_name"], r["pos"]): r["reason"] for r in tr.truncated_texts(frame).collect()}


def test_cuts_within_words_and_sentences(spark):
    more = [(100, "feed", "The lift of the swept wing grows with the wa", None), (101, "feed", "The lift of the swept wing grows with the", [None, "The lift of the swe", "Most models agree…"]), (102, None, "The lift of the swept wing-", [])]
    got = found(corpus(spark, more).selectExpr("*", "1 as f", "'x' as text", "0 as pos"))
    assert set(got) == {(100, "reasoning", -1), (101, "reasoning", -1), (101, "step_by_step", 1), (101, "step_by_step", 2), (102, "reasoning", -1)}
    assert got[(100, "reasoning", -1)] == "within a word" and got[(102, "reasoning", -1)] == "marked"


def test_terse_texts_and_blanks_are_whole(spark):
    more = [(200, "api", None, None), (201, "api", "  ", [None, ""]), (202, "api", "Step 4: check the load path", ["x" * 50_000 + "."])]
    assert found(corpus(spark, more)) == {}
    assert found(corpus(spark).limit(0)) == {}


def test_repeated_rows_are_found_each(spark):
    cut = (300, "api", "The lift of the swept wing grows with the wa", None)
    assert tr.truncated_texts(corpus(spark, [cut, cut])).where("response_id = 300").count() == 2


def test_shares_per_source(spark, sf_dir):
    rows = queries.p2_sources(spark, sf_dir).collect()
    assert rows and all(0 <= r["cut_share"] <= 1 and r["n_cut"] <= r["n_texts"] for r in rows)


def test_the_open_end_of_a_text_is_no_evidence_for_itself(spark):
    more = [(400, "feed", "Careful readers admire fl", None), (401, "feed", "Careful readers often admire", None)]
    got = found(corpus(spark, more))
    assert got == {(400, "reasoning", -1): "within a word", (401, "reasoning", -1): "without its end"}


def test_a_closing_bracket_or_quote_does_not_hide_a_cut(spark):
    whole = [(500 + i, "api", f"The lift of the swept (thin) wing grows with speed. Then see the “flat” plate of figure {i} (left side)", None) for i in range(30)]
    more = [*whole, (600, "feed", "The lift of the swept (thin)", None), (601, "feed", 'Then see the “flat”', None)]
    got = found(corpus(spark, more))
    assert got == {(600, "reasoning", -1): "within a sentence", (601, "reasoning", -1): "within a sentence"}


def test_reasons_add_up(spark, sf_dir):
    rows = queries.p2_sources(spark, sf_dir).collect()
    assert all(sum(r[c] for c in tr.REASONS.values()) == r["n_cut"] for r in rows)
