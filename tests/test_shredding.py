import json
import random

from concordat.operators.shredding import ancestor_table, child_tables, level_columns, read_json


def brute(record):
    """Walks a record by hand, without levels."""
    out = set()

    def opened(v):
        if isinstance(v, str) and v.strip()[:1] in ("[", "{"):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def items(v):
        v = opened(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    def walk(v):
        v = opened(v)
        if isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            for k, x in v.items():
                if k == "tier_0_classification" and isinstance(opened(x), dict) and opened(x).get("content_type") is not None:
                    out.add(("content_type", -1, 0))
                if k in ("step_by_step", "common_mistakes", "formulas_principles"):
                    for i, e in enumerate(map(opened, items(x))):
                        if e is None:
                            continue
                        out.add((k, -1, i))
                        inner = []
                        if k == "step_by_step":
                            inner, name = (items(e.get("sub_steps")) if isinstance(e, dict) else e if isinstance(e, list) else []), "sub_steps"
                        elif k == "formulas_principles":
                            inner, name = (items(e.get("variables")) if isinstance(e, dict) else []), "variables"
                        out.update((name, i, j) for j, y in enumerate(inner) if y is not None)
                walk(x)

    walk(record)
    return out


def random_record(r):
    scalar = lambda: r.choice([None, "a", "b.", 3, "[not json", ""])

    def listed(make):
        n = r.randint(0, 3)
        value = [make() for _ in range(n)]
        kind = r.random()
        if kind < 0.15 and value:
            value = value[0]
        elif kind < 0.3:
            value = json.dumps(value)
        elif kind < 0.4:
            value = None
        return value

    steps = lambda: listed(lambda: r.choice([scalar(), {"sub_steps": listed(scalar)}, [scalar(), scalar()]]))
    formulas = lambda: listed(lambda: r.choice([scalar(), {"formula": "x", "variables": listed(lambda: {"symbol": "q"})}]))
    body = {"tier_1": {"explanation": {"step_by_step": steps()}, "formulas_principles": formulas()}, "tier_0_classification": {"content_type": scalar()}}
    if r.random() < 0.5:
        body["deep"] = [{"x": {"common_mistakes": listed(lambda: r.choice([None, {"mistake": "m"}, "text"]))}}]
    return body


def wrapped(r, body):
    text = json.dumps(body)
    return r.choice([text, f"```json\n{text}\n```", json.dumps(text), json.dumps([body]), json.dumps({"response_json": body}), f"Here it is: {text} done", "  " + text + "\n"])


def test_child_tables_match_a_plain_walk(spark):
    r = random.Random(7)
    records = [random_record(r) for _ in range(300)]
    rows = [(i, wrapped(r, b)) for i, b in enumerate(records)]
    got = {tuple(x) for x in child_tables(spark.createDataFrame(rows, "response_id long, body string"), "response_id", "body").collect()}
    assert got == {(i, *x) for i, b in enumerate(records) for x in brute(b)}


def test_unreadable_null_and_empty(spark):
    rows = [(1, None), (2, ""), (3, '{"step_by_step": ["a"'), (4, "[]"), (5, '"text"'), (6, "{"), (7, '{"step_by_step": "lone"}'), (7, '{"step_by_step": "lone"}')]
    frame = spark.createDataFrame(rows, "response_id long, body string").selectExpr("*", "1 as pos", "'x' as child", "2 as value")
    got = sorted(tuple(x) for x in child_tables(frame, "response_id", "body").collect())
    assert got == [(7, "step_by_step", -1, 0)] * 2
    assert child_tables(frame.limit(0), "response_id", "body").count() == 0


def test_long_and_deep_records(spark):
    many = json.dumps({"common_mistakes": [{"mistake": "m" * 50}] * 20000})
    deep = "[" * 5000 + "]" * 5000
    got = child_tables(spark.createDataFrame([(1, many), (2, deep)], "response_id long, body string"), "response_id", "body")
    assert got.count() == 20000


def test_levels_of_a_list_and_of_a_leaf_below_it(spark):
    body = json.dumps({"a": [{"b": [1, None, 2], "c": "x"}, None, "f", {"b": []}]})
    levels = level_columns(spark.createDataFrame([(1, body)], "response_id long, body string"), "response_id", "body")
    of = lambda p: [(r["rep"], r["def"], r["value"]) for r in levels.where(f"path = '{p}'").orderBy("entry").collect()]
    assert of("a[]") == [(0, 4, None), (1, 3, None), (1, 5, '"f"'), (1, 4, None)]
    assert of("a[].b[]") == [(0, 9, "1"), (2, 7, None), (2, 9, "2"), (1, 3, None), (1, 4, None), (1, 6, None)]
    assert of("a[].c") == [(0, 6, '"x"'), (1, 3, None), (1, 4, None), (1, 4, None)]


def leaves(value, path=(), places=()):
    """Path, places and value of every scalar and non-null list element by a plain walk."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            if v is not None:
                yield from leaves(v, (*path, k), places)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            if v is not None:
                yield (*path, "[]"), (*places, i), None
                yield from leaves(v, (*path, "[]"), (*places, i))
    else:
        yield path, places, value


def test_any_repeated_ancestor_is_rebuilt_from_the_levels(spark):
    r = random.Random(9)

    def value(depth):
        kind = r.random()
        if depth == 0 or kind < 0.3:
            return r.choice([None, 1, "a", True, {}, 2.5])
        if kind < 0.65:
            return [value(depth - 1) for _ in range(r.randint(0, 3))]
        return {k: value(depth - 1) for k in r.sample("xyz", r.randint(0, 3))}

    records = [{"a": value(4), "b": [value(3) for _ in range(r.randint(0, 3))]} for _ in range(80)]
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(records)], "id long, body string")
    levels = level_columns(frame, "id", "body", ())
    want = {}
    for i, x in enumerate(records):
        for path, places, v in leaves(x):
            name = "".join(p if p == "[]" else f".{p}" for p in path)[1:]
            want.setdefault((i, name, places), []).append(v)
    for ancestor in (r"^a\[\]", r"^b\[\]", r"^b\[\]\.x\[\]", r"^a\[\]\.y"):
        got = {(t["id"], t["ancestor"] + t["leaf"], (*t["places"], *t["inner"])) for t in ancestor_table(levels, "id", ancestor).collect()}
        head = ancestor[1:].replace("\\", "")
        assert got == {k for k in want if head.endswith("[]") and (k[1] == head or k[1].startswith((head + ".", head + "[")))}
    scalars = {(t["id"], t["ancestor"] + t["leaf"], (*t["places"], *t["inner"])): json.loads(t["value"]) for t in ancestor_table(levels, "id", r"^b\[\]").where("value is not null").collect()}
    assert scalars == {k: v for k, vs in want.items() for v in vs if k[1].startswith("b[]") and v is not None}


def test_read_json_keeps_truncated_out():
    assert read_json('```json\n{"a": 1') is None
    assert read_json('"{\\"a\\": 1') is None
    assert read_json("```\n[1]\n```") == [1]
