"""Validation queries; their SQL is written out from the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.operators import rules
from concordat.operators import validation as va
from concordat.plans.base import Registry
from concordat.runtime import table

_R = Registry()
QUERIES, SQL = _R.QUERIES, _R.SQL


def _kind(j: str) -> str:
    return (
        f"case json_type({j}) when 'VARCHAR' then 'text' when 'BIGINT' then 'whole' when 'UBIGINT' then 'whole' when 'DOUBLE' then 'real' when 'HUGEINT' then 'real' "
        f"when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'list' when 'NULL' then 'null' end"
    )


def _object_sql(source: str, shape: rules.Shape, section: str, top: bool) -> list[str]:
    """One select per rule over rows of ``source`` (response_id, j an object, at its path)."""
    out = []

    def rule(check: str, name: str, broken: str) -> None:
        out.append(f"select response_id, '{section}' as section, '{check}' as \"check\", place || '.{name}' as path from {source} where {broken}")

    for name, kind, must in shape.kinds():
        v = f"(j -> '$.{name}')"
        k = f"({_kind(v)})"
        if must:
            rule("required", name, f"{v} is null")
        if top:
            rule("null", name, f"{k} = 'null'")
        fits = f"{k} in ('whole', 'boolean')" if kind == "whole" else f"{k} = '{kind}'"
        rule("type", name, f"{k} <> 'null' and not {fits}")
        if name in shape.allowed:
            values = ", ".join(f"'{x}'" for x in shape.allowed[name])
            rule("enum", name, f"{v} is not null and not ({k} = 'text' and (j ->> '$.{name}') in ({values}))")
        if name in shape.ranges:
            low, high = shape.ranges[name]
            rule("range", name, f"{k} in ('whole', 'real') and not ((j ->> '$.{name}')::double between {low} and {high})")
    return out


def _violations_sql() -> str:
    views, out = [], []

    def lists(source: str, shape: rules.Shape, section: str) -> None:
        for name, element in shape.lists.items():
            view = f"v{len(views)}"
            views.append(
                f"{view} as (select response_id, place || '.{name}[' || i || ']' as place, (j -> '$.{name}') -> i as j from "
                f"(select *, unnest(range(json_array_length(j, '$.{name}')::bigint)) as i from {source} where json_type(j, '$.{name}') = 'ARRAY'))"
            )
            out.append(f"select response_id, '{section}', 'element', place from {view} where json_type(j) <> 'OBJECT'")
            out.extend(_object_sql(f"(select * from {view} where json_type(j) = 'OBJECT')", element, section, False))

    for section, shape in rules.RECORD_SHAPES.items():
        view = f"v{len(views)}"
        views.append(f"{view} as (select response_id, '{section}' as place, j -> '$.{section}' as j from r)")
        out.append(f"select response_id, 'root', 'required', place from {view} where j is null")
        out.append(f"select response_id, '{section}', 'type', place from {view} where json_type(j) <> 'OBJECT'")
        held = f"o{len(views)}"
        views.append(f"{held} as (select * from {view} where json_type(j) = 'OBJECT')")
        out.extend(_object_sql(held, shape, section, True))
        lists(held, shape, section)
        for name, part in shape.parts.items():
            inner = f"p{len(views)}"
            views.append(f"{inner} as (select response_id, place || '.{name}' as place, j -> '$.{name}' as j from {held} where json_type(j, '$.{name}') = 'OBJECT')")
            out.extend(_object_sql(inner, part, section, False))
            lists(inner, part, section)
    root = [f"select response_id, 'root', 'required', '{f}' from r where (j -> '$.{f}') is null" for f in rules.ROOT]
    unread = (
        "select response_id, 'root' as section, 'json' as \"check\", '$' as path from response where response_json is not null and not "
        "coalesce(case when json_valid(response_json) then json_type(response_json) = 'OBJECT' end, false)"
    )
    whole = "r as (select response_id, response_json::json as j from response where json_valid(response_json) and json_type(response_json) = 'OBJECT')"
    return f"with {whole}, {', '.join(views)} " + " union all ".join([unread, *root, *out])


_VIOLATIONS = _violations_sql()


@_R.query(_VIOLATIONS)
def val_02_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.violations(table(spark, sf_dir, "response"), "response_id", "response_json")


@_R.query(f"""select section, "check", count(*) as n from ({_VIOLATIONS}) group by all""")
def val_05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va.violation_summary(va.violations(table(spark, sf_dir, "response"), "response_id", "response_json"))
