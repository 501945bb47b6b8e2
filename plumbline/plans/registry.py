"""Query registry and the SQL fragments the oracle statements share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(frame) if name in ROW_HEAVY else frame


ROW_HEAVY = ("documents", "lineitem")  # hashing and text rules cost more than a spread of few splits


# Column kinds of the given tables, for the canonical JSON text in SQL.
KINDS = {
    "region": {"r_regionkey": "n", "r_name": "s"},
    "nation": {"n_nationkey": "n", "n_name": "s", "n_regionkey": "n"},
    "customer": {"c_custkey": "n", "c_name": "s", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "s"},
    "supplier": {"s_suppkey": "n", "s_name": "s", "s_nationkey": "n", "s_acctbal": "n"},
    "part": {"p_partkey": "n", "p_name": "s", "p_brand": "s", "p_type": "s", "p_size": "n", "p_retailprice": "n"},
    "orders": {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t",
               "o_orderpriority": "s"},
    "lineitem": {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
                 "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "s", "l_linestatus": "s",
                 "l_shipdate": "t"},
    "events": {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "props": "s"},
    "documents": {"doc_id": "n", "text": "s", "lang": "s", "source": "s", "n_chars": "n"},
    "labels": {"doc_id": "n", "quality": "n", "toxic": "n"},
    "pages": {"page_id": "n", "url": "s", "html": "s"},
    "conversations": {"conv_id": "n", "turn": "n", "role": "s", "text": "s"},
    "benchmark": {"item_id": "n", "text": "s"},
}


def sql_json(expression: str, kind: str) -> str:
    if kind == "s":
        body = f"to_json({expression})::varchar"
    elif kind == "t":
        body = f"'\"' || strftime({expression}, '%Y-%m-%d %H:%M:%S.%f') || '\"'"
    else:
        body = f"cast({expression} as varchar)"
    return f"coalesce({body}, 'null')"


def sql_record(columns: dict[str, str], expressions: dict[str, str] | None = None) -> str:
    """Canonical record text; columns map a name to n (number), s (string) or t (timestamp)."""
    parts = []
    for index, name in enumerate(sorted(columns)):
        lead = ("," if index else "{") + f'"{name}":'
        parts.append(f"'{lead}' || " + sql_json((expressions or {}).get(name, name), columns[name]))
    return "(" + " || ".join(parts) + " || '}' || chr(10))"


def sql_hash(columns: dict[str, str], expressions: dict[str, str] | None = None) -> str:
    return f"sha256({sql_record(columns, expressions)})"


def sql_multiset(hashes: str) -> str:
    """CTEs (c, leaf, inner_) over a statement that gives column h; read from multiset_."""
    return f"""hashes_ as ({hashes}),
c_ as (select h, count(*) as n from hashes_ group by h),
leaf_ as (select substr(h,1,5) as p, sha256(string_agg(h || ':' || n, ',' order by h || ':' || n)) as d,
  sum(n) as rows_, count(*) as distinct_ from c_ group by 1),
inner_ as (select substr(p,1,2) as q, sha256(string_agg(p || '=' || d, ',' order by p || '=' || d)) as d,
  sum(rows_) as rows_, sum(distinct_) as distinct_ from leaf_ group by 1),
multiset_ as (select coalesce(sum(rows_),0)::bigint as row_count, coalesce(sum(distinct_),0)::bigint as distinct_count,
  sha256(coalesce(string_agg(q || '=' || d, ',' order by q || '=' || d),'')) as records_sha256 from inner_)"""


def sql_order(positioned: str) -> str:
    """CTEs over a statement with columns i (0-based position) and d; read from order_."""
    levels = [f"o0_ as ({positioned})"]
    for k in range(3):
        levels.append(
            f"o{k + 1}_ as (select i // 65536 as i, sha256(string_agg(d, ',' order by i)) as d from o{k}_ group by 1)")
    return ",\n".join(levels) + ",\norder_ as (select max(d) as order_sha256 from o3_)"


def sql_text_type(x: str) -> str:
    day = f"try_strptime(substr(replace(substr({x},1,10),'-',''),1,8), '%Y%m%d')"
    iso = (
        r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})(?:.(?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9](?:[.,][0-9]+)?)?)?"
        r"(?:Z|[+-](?:[01][0-9]|2[0-3])(?::?[0-5][0-9](?::?[0-5][0-9])?)?)?)?$"
    )
    number = r"^[+-]?(?:[0-9]+\.[0-9]*|[0-9]*\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?$"
    return (
        f"case when coalesce({x},'')='' then 'NULL' when regexp_matches({x},'^[+-]?[0-9]+$') then 'INTEGER' "
        f"when regexp_matches({x},'{number}') then 'NUMBER' when lower({x}) in ('true','false') then 'BOOLEAN' "
        f"when (contains({x},'-') or contains({x},'T')) and regexp_matches({x},'{iso}') and {day} is not null "
        f"then 'DATETIME' else 'STRING' end"
    )
