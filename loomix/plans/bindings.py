"""Queries that apply the corpus to the tables, each with its DuckDB form."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corpus
from ..functions.notes import LEADS, TREATMENTS
from ..lowering import WHITE

#: Key columns that go with the results of a table.
KEYS = {
    "orders": "o_orderkey", "lineitem": "l_orderkey, l_linenumber", "customer": "c_custkey", "part": "p_partkey",
    "nation": "n_nationkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "supplier": "s_suppkey",
}


@dataclass(frozen=True)
class Binding:
    """A function applied to expressions over a table; oracle: the result in DuckDB SQL, if SQL has it; name: of the query."""

    function: str
    source: str
    args: str
    oracle: str | None
    name: str = ""

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        native = corpus()[self.function]
        table, _, _ = self.source.partition(" ")
        rows = source(spark, sf_dir, self.source)
        return rows.selectExpr(*[k.strip() for k in KEYS[table].split(",")], f"{self.rounded(f'{native.define(spark)}({self.args})')} AS result")

    def sql(self) -> str | None:
        table, _, extra = self.source.partition(" ")
        if self.oracle is None:
            return None
        inner = f"(SELECT *, {extra} FROM {table})" if extra else table
        return f"SELECT {KEYS[table]}, {self.rounded(self.oracle)} AS result FROM {inner} t"

    def rounded(self, value: str) -> str:
        """Libraries differ in the last bit of logarithms and exponentials."""
        return f"round({value}, 9)" if self.function in ("np_log", "np_exp") else value


def source(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A table, with further columns after its name; their expressions are common to Spark and DuckDB."""
    table, _, extra = text.partition(" ")
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.selectExpr("*", extra) if extra else df


_NULLED = "lineitem CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_partkey END AS maybe"
_LISTS = "orders o_orderpriority AS prio"
_DATED = "orders substr(cast(o_orderdate AS varchar(40)), 1, 10) AS day"
_SALES = "lineitem avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS mean"
_KEYED = "orders concat(o_orderstatus, '::', o_orderpriority, '::', cast(o_orderkey AS varchar(20))) AS project"
_PREVIOUS = "orders lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before"
_SPARK_LISTS = "prio, o_orderstatus, array('1-URGENT', '2-HIGH', NULL), array('O', 'F')"
_IN_LISTS = "(prio IN ('1-URGENT', '2-HIGH'))", "(o_orderstatus IN ('O', 'F'))"
_SPARK_SWAPPED = "o_orderstatus, prio, array('1-URGENT', '2-HIGH', NULL), array('O', 'F')"
_EMPTIED = "orders CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderstatus END AS st"
_MAILS = "documents regexp_extract(text, '[^ ]+@[^ ]+', 0) AS mail"
#: Texts with a line put before them, of which the functions of notes take the first.
_VERDICTS = "documents concat('1. **VERDICT: ', CASE n_chars % 3 WHEN 0 THEN 'viable' WHEN 1 THEN 'not viable' ELSE 'unclear' END, '**', chr(10), text) AS verdict"
_CUSTOMER_DATA = """customer concat(c_name, ': SSN 123-45-', lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'), ', mail user', c_custkey, '@example.com, call (555) 010-',
  lpad(cast(c_custkey % 10000 AS varchar(9)), 4, '0'), ', DOB: 12/31/1980, member id AB123456, at 12 Main Street. {{FIRST_NAME 555-010-1234}} ', c_mktsegment) AS note"""


def _in_re2(pattern: str) -> str:
    """A pattern of notes for DuckDB's regular expressions."""
    letter, white = r"[\p{L}\p{N}_]", "[ \t\n\r\v\f]"
    return pattern.replace(r"\w", letter).replace(r"\d", r"\p{Nd}").replace(r"\s", white).replace("'", "''")


def _treatment(text: str) -> str:
    """The first hit of more than two characters; the ninth pattern, which names no treatment, ends the search."""
    out = "'AB'"
    for p in reversed(TREATMENTS):
        names = re.findall(r"\((?!\?)|\(\?P<(\w+)>", p)
        if "treatment" in names:
            hit = f"regexp_extract({text}, '{_in_re2(p)}', {names.index('treatment') + 1}, 'i')"
            out = f"CASE WHEN length({hit}) > 2 THEN {hit} ELSE {out} END"
        else:
            out = f"CASE WHEN regexp_matches({text}, '{_in_re2(p)}', 'i') THEN NULL ELSE {out} END"
    return out


def _normalized(text: str) -> str:
    out = rf"regexp_replace(regexp_replace({text}, '\*\*(.*?)\*\*', '\1', 'g'), '<answer>(.*?)</answer>', '\1', 'g')"
    for lead in LEADS:
        out = f"regexp_replace({out}, '.*{_in_re2(lead)}', '', 'gi')"
    return f"trim(replace(replace({out}, '**', ''), '---', ''), {_WHITE})"


_WHITE = " || ".join(f"chr({ord(c)})" for c in WHITE)
_SECOND = "split_part(split_part(marked, chr(10) || 'LEGAL:', 2), chr(10), 1)"
_STRIPPED = "concat('  ', n_name, chr(9))"
_MOD = "((l_partkey - 1000) % {m} + CASE WHEN (l_partkey - 1000) % {m} <> 0 AND ((l_partkey - 1000) < 0) <> ({m} < 0) THEN {m} ELSE 0 END)"

BINDINGS = [
    Binding("plus_one", "orders", "o_orderkey", "o_orderkey + 1"),
    Binding("is_none_branch", _NULLED, "maybe", "coalesce(maybe, -1)"),
    Binding("both_positive", "lineitem", "l_partkey - 1000, l_suppkey - 50", "l_partkey > 1000 AND l_suppkey > 50"),
    Binding("greet", "nation", "n_name", "'hi ' || n_name"),
    Binding("upper_useragent", "part", "p_name", "upper(p_name)"),
    Binding("lower_useragent", "part", "p_brand", "lower(p_brand)"),
    Binding("shout", "part", "p_type", "upper(p_type)"),
    Binding("contains_ingredient", "part", "p_name, 'ring'", "contains(lower(p_name), 'ring')"),
    Binding("timestamp_to_epoch", "events", "cast(ts AS timestamp)", "CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)"),
    Binding("backwards", "customer", "c_name", "reverse(c_name)"),
    Binding("widget_name", "events", "replace(props, '\"k\"', '\"widget\"')", "json_extract_string(props, '$.k')"),
    Binding("scatter_to_seconds", "events", "date_format(ts, 'yyyy-MM-dd HH:mm:ss'), cast(cast(value AS bigint) % 5 AS string)", "CASE WHEN trunc(value)::BIGINT % 5 < 0 THEN []::VARCHAR[] ELSE list_transform(range(trunc(value)::BIGINT % 5 + 1), lambda i: strftime(date_trunc('second', ts) + to_seconds(i), '%Y-%m-%d %H:%M:%S')) END"),
    Binding("BSPIn", _LISTS, _SPARK_LISTS, f"CAST({_IN_LISTS[0]} AND {_IN_LISTS[1]} AS BIGINT)"),
    Binding("EBRIn", _LISTS, _SPARK_LISTS, f"CAST({_IN_LISTS[0]} AND {_IN_LISTS[1]} AS BIGINT)"),
    Binding("BSPOut", _LISTS, _SPARK_SWAPPED, f"CAST({_IN_LISTS[1]} AND {_IN_LISTS[0]} AS BIGINT)"),
    Binding("EBROut", _LISTS, _SPARK_SWAPPED, f"CAST({_IN_LISTS[1]} AND {_IN_LISTS[0]} AS BIGINT)"),
    Binding("flatlist", "part", "array(array(p_brand, p_type), array(p_brand))", "[p_brand, p_type, p_brand]"),
    Binding("mod_bucket", "lineitem", "l_partkey - 1000, 7L", _MOD.format(m=7)),
    Binding("round_half", "lineitem", "l_quantity / 2", "CAST(round_even(l_quantity / 2, 0) AS BIGINT)"),
    Binding("weekday_of", "orders", "cast(o_orderdate AS timestamp)", "isodow(o_orderdate) - 1"),
    Binding("split_dot", "pages", "url", "string_split(url, '.')"),
    Binding("zfill3", "part", "cast(p_size AS string)", "lpad(CAST(p_size AS VARCHAR), 3, '0')"),
    Binding("edit_distance", "part", "p_name, p_type", "levenshtein(p_name, p_type)"),
    Binding("trim_whitespace", "nation", _STRIPPED, "n_name"),
    Binding("snake_case", "part", "p_name", "replace(p_name, ' ', '_')"),
    Binding("pad_left5", "part", "cast(p_partkey AS string)", "CASE WHEN length(CAST(p_partkey AS VARCHAR)) >= 5 THEN CAST(p_partkey AS VARCHAR) ELSE lpad(CAST(p_partkey AS VARCHAR), 5, '0') END"),
    Binding("title_case", "part", "p_name", "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"),
    Binding("clean_phone", "customer", "c_name", "regexp_replace(c_name, '[^0-9]', '', 'g')"),
    Binding("extract_domain", "pages", "url", "regexp_extract(url, '://([^/]+)', 1)"),
    Binding("is_email", _MAILS, "mail", "regexp_full_match(mail, '[^@]+@[^@]+\\.[^@]+')"),
    Binding("count_vowels", "documents", "text", "CAST(length(text) - length(translate(text, 'aeiouAEIOU', '')) AS BIGINT)"),
    Binding("np_sqrt", "lineitem", "l_extendedprice", "sqrt(l_extendedprice)"),
    Binding("np_log", "customer", "c_acctbal", "CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) WHEN c_acctbal = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END"),
    Binding("np_clip", "customer", "c_acctbal, 0D, 5000D", "least(greatest(c_acctbal, 0), 5000)"),
    Binding("np_exp", "lineitem", "l_discount", "exp(l_discount)"),
    Binding("math_floor", "customer", "c_acctbal", "CAST(floor(c_acctbal) AS BIGINT)"),
    Binding("math_ceil", "customer", "c_acctbal", "CAST(ceil(c_acctbal) AS BIGINT)"),
    Binding("math_log10", "nation", "pow(10D, n_nationkey % 3)", "CAST(n_nationkey % 3 AS DOUBLE)"),
    Binding("to_iso_date", "orders", "cast(o_orderdate AS timestamp)", "strftime(o_orderdate, '%Y-%m-%d')"),
    Binding("spark_add_one", _NULLED, "maybe", "maybe + 1"),
    Binding("spark_to_upper", "part", "p_type", "upper(p_type)"),
    Binding("spark_to_lower", "part", "p_type", "lower(p_type)"),
    Binding("spark_trunc", "customer", "c_acctbal", "CAST(trunc(c_acctbal) AS BIGINT)"),
    Binding("spark_as_double", "orders", "o_orderkey", "CAST(o_orderkey AS DOUBLE)"),
    Binding("spark_add_two", "orders", "o_orderkey", "CAST(o_orderkey + 2 AS DOUBLE)"),
    Binding("spark_substr", "customer", "c_name, -4L, 99L", "substr(c_name, greatest(length(c_name) - 3, 1))"),
    Binding("spark_strlen", "documents", "text", "CAST(length(text) AS BIGINT)"),
    Binding("spark_len_plus", "part", "p_name, cast(p_size AS bigint)", "CAST(length(p_name) + p_size AS BIGINT)"),
    Binding("spark_str", _NULLED, "maybe", "coalesce(CAST(maybe AS VARCHAR), 'None')"),
    Binding("spark_eq", "lineitem", "l_partkey, l_suppkey", "l_partkey = l_suppkey"),
    Binding("tpcds_zip5_mismatch", "part", "p_brand, p_type", "substr(p_brand, 1, 5) <> substr(p_type, 1, 5)"),
    Binding("tpcds_safe_ratio", "lineitem", "l_extendedprice, l_discount", "CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount END"),
    Binding("tpcds_sales_deviation", _SALES, "l_extendedprice, round(mean, 2)", "CASE WHEN round(mean, 2) > 0 THEN abs(l_extendedprice - round(mean, 2)) / round(mean, 2) END"),
    Binding("tpcds_below_threshold", _SALES, "l_extendedprice, round(mean, 2)", "CASE WHEN round(mean, 2) > 0 THEN l_extendedprice <= 0.1::DOUBLE * round(mean, 2) END"),
    Binding("tpcds_in_quarter", "orders", "cast(month(o_orderdate) AS bigint), 4L, 3L", "month(o_orderdate) BETWEEN 4 AND 7"),
    Binding("tpcds_day_sales", "orders", "date_format(o_orderdate, 'EEEE'), o_totalprice", "CASE WHEN dayname(o_orderdate) = 'Sunday' THEN o_totalprice END"),
    Binding("tpcds_trunc30", "documents", "text", "substr(text, 1, 30)"),
    Binding("common_discount_price", "lineitem", "l_extendedprice, l_discount * 100", "l_extendedprice * (1 - (l_discount * 100) / 100.0::DOUBLE)"),
    Binding("common_pct_change", _PREVIOUS, "before, o_totalprice", "CASE WHEN before <> 0 THEN (o_totalprice - before) / before * 100.0::DOUBLE END"),
    Binding("common_c2f", "events", "value", "value * 9.0::DOUBLE / 5.0::DOUBLE + 32.0::DOUBLE"),
    Binding("common_url_decode", "pages", "url", "replace(url, '%20', ' ')"),
    Binding("common_full_name", "part", "p_brand, p_type", "p_brand || ' ' || p_type"),
    Binding("common_round2", "lineitem", "l_quantity / 8", "(CAST(l_quantity AS BIGINT) * 125 // 10 + CASE WHEN CAST(l_quantity AS BIGINT) * 125 % 10 > 5 OR CAST(l_quantity AS BIGINT) * 125 % 10 = 5 AND CAST(l_quantity AS BIGINT) * 125 // 10 % 2 = 1 THEN 1 ELSE 0 END) / 100"),
    Binding("common_is_adult", "part", "cast(p_size AS bigint)", "p_size >= 18"),
    Binding("udfb_extractyear", _DATED, "day", "year(o_orderdate)"),
    Binding("udfb_extractmonth", _DATED, "day", "month(o_orderdate)"),
    Binding("udfb_extractday", _DATED, "day", "day(o_orderdate)"),
    Binding("udfb_extractfunder", _KEYED, "project", "split_part(project, '::', 1)"),
    Binding("udfb_extractclass", _KEYED, "project", "split_part(project, '::', 2)"),
    Binding("udfb_extractid", _KEYED, "project", "split_part(project, '::', 3)"),
    Binding("udfb_converttoeuro", "orders", "o_totalprice, element_at(array('EUR', 'USD', 'GBP', 'CHF'), cast(o_custkey % 4 + 1 AS int))", "o_totalprice / [1.0::DOUBLE, 1.09::DOUBLE, 0.85::DOUBLE, 0.98::DOUBLE][o_custkey % 4 + 1]"),
    Binding("collatz_steps", "part", "p_partkey", None),
    Binding("low_bits_set", "orders", "o_orderkey", "CAST(bit_count(o_orderkey & 4294967295) AS BIGINT)"),
    Binding("is_prime", "part", "p_partkey", "p_partkey >= 2 AND len(list_filter(range(2, CAST(floor(sqrt(p_partkey)) AS BIGINT) + 1), lambda d: p_partkey % d = 0)) = 0"),
    Binding("longest_digit_run", "orders", "o_orderkey", "list_max(list_transform(regexp_extract_all(CAST(o_orderkey AS VARCHAR), '0+|1+|2+|3+|4+|5+|6+|7+|8+|9+'), lambda x: length(x)))"),
    Binding("value_for_a", "part", "map('a', p_brand, 'b', p_type)", "p_brand"),
    Binding("parse_int", "part", "cast(p_partkey AS string)", "p_partkey"),
    Binding("bool_str", "part", "p_size > 20", "CASE WHEN p_size > 20 THEN 'True' ELSE 'False' END"),
    Binding("safe_ten_div", "part", "cast(p_size AS bigint) - 10", "CASE WHEN p_size = 10 THEN -1 ELSE CAST(trunc(10.0::DOUBLE / (p_size - 10)) AS BIGINT) END"),
    Binding("floor_div", "lineitem", "l_partkey - 1000, 7L", "CAST(floor((l_partkey - 1000) / 7.0::DOUBLE) AS BIGINT)"),
    Binding("fhi_verdict_has_legal_check", "documents replace(text, chr(10), concat(chr(10), 'LEGAL:')) AS marked", "marked", f"contains(text, chr(10)) AND trim({_SECOND}, {_WHITE}) NOT IN ('', 'UNCHECKED')"),
    Binding("fhi_parse_verdict", _VERDICTS, "verdict", "CASE n_chars % 3 WHEN 0 THEN true WHEN 1 THEN false END"),
    Binding("fhi_clean_health_history", "documents", "text", f"CASE WHEN trim(text, {_WHITE}) <> '' AND NOT regexp_full_match(upper(trim(text, {_WHITE})), '\\.*(NONE|UNKNOWN)\\.*') THEN trim(text, {_WHITE}) END"),
    Binding("fhi_treatment_from_findings", "documents concat('The patient has requested coverage for ', text) AS findings", "findings, 'A', 'B'", _treatment("findings")),
    Binding("fhi_diagnosis_from_findings", "documents concat('Was admitted to the hospital for ', text) AS findings", "findings, 'A', 'B'", "CASE WHEN length(split_part(text, '.', 1)) > 2 THEN split_part(text, '.', 1) ELSE 'AB' END"),
    Binding("fhi_normalize_entity_text", "documents concat('**The diagnosis is ', replace(text, chr(10), concat('**', chr(10), 'Procedure: ')), ' ---') AS entity", "entity", _normalized("entity")),
    Binding("fhi_deidentify_text", "documents", "text", None),
    Binding("fhi_deidentify_text", _CUSTOMER_DATA, "note", "concat(c_name, ': SSN {{SSN}}, mail {{Your Email Address}}, call {{Your Phone Number}}, {{DOB}}, {{MEMBER_ID}}, at {{ADDRESS}}. {{FIRST_NAME 555-010-1234}} ', c_mktsegment)", "fhi_deidentify_planted"),
    Binding("add_mul", "lineitem", "l_partkey, cast(l_linenumber AS bigint)", "CAST(l_partkey * l_linenumber + 1 AS BIGINT)"),
    Binding("sub_neg", "orders", "o_orderkey", "1 + o_orderkey"),
    Binding("truediv", "lineitem", "cast(l_partkey AS int), cast(l_suppkey + 1 AS int)", "l_partkey / (l_suppkey + 1)"),
    Binding("eq_zero", _NULLED, "maybe % 7", "coalesce(maybe % 7 = 0, false)"),
    Binding("ne_zero", _NULLED, "maybe % 7", "coalesce(maybe % 7 <> 0, true)"),
    Binding("less_five", "orders", "o_orderkey % 10", "o_orderkey % 10 < 5"),
    Binding("py_and", "part", "p_size > 20, p_partkey % 2 = 0", "p_size > 20 AND p_partkey % 2 = 0"),
    Binding("py_or", "part", "p_size > 20, p_partkey % 2 = 0", "p_size > 20 OR p_partkey % 2 = 0"),
    Binding("not_x", _NULLED, "maybe % 2 = 0", "coalesce(NOT (maybe % 2 = 0), true)"),
    Binding("ternary", _NULLED, "maybe % 3", "CAST(CASE WHEN maybe % 3 <> 0 THEN 1 ELSE 2 END AS BIGINT)"),
    Binding("nested_if", "lineitem", "l_partkey - 1000, l_suppkey - 50", "CAST(CASE WHEN l_partkey <= 1000 THEN 3 WHEN l_suppkey > 50 THEN 1 ELSE 2 END AS BIGINT)"),
    Binding("chained", "orders", "o_orderkey % 20", "o_orderkey % 20 BETWEEN 1 AND 9"),
    Binding("str_lt", "part", "p_brand, p_type", "p_brand < p_type"),
    Binding("str_eq", "nation", "n_name, concat('NATION_', n_regionkey)", "n_name = concat('NATION_', n_regionkey)"),
    Binding("str_or", _EMPTIED, "st, o_orderpriority", "CASE WHEN st <> '' THEN st ELSE o_orderpriority END"),
    Binding("square", "orders", "o_custkey", "o_custkey * o_custkey"),
    Binding("shifted", "orders", "o_orderkey", "CAST(o_orderkey * 8 + o_orderkey // 4 AS BIGINT)"),
    Binding("ratio_or_zero", "part", "cast(p_partkey AS int), cast(p_size AS int) - 10", "CASE WHEN p_size = 10 THEN 0 ELSE p_partkey / (p_size - 10) END"),
    Binding("circle", "part", "cast(p_size AS double)", "3.141592653589793::DOUBLE * p_size * p_size"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"udf_{b.name or b.function}": b.query for b in BINDINGS}


#: Steps of every part key, all walked at once.
_COLLATZ = """WITH RECURSIVE c(p_partkey, n, result) AS (
  SELECT p_partkey, p_partkey, 0::BIGINT FROM part WHERE p_partkey >= 1
  UNION ALL SELECT p_partkey, CASE WHEN n % 2 = 0 THEN n // 2 ELSE 3 * n + 1 END, result + 1 FROM c WHERE n <> 1)
SELECT p_partkey, result FROM c WHERE n = 1
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey < 1"""


def oracle_sql() -> dict[str, str]:
    return {f"udf_{b.name or b.function}": sql for b in BINDINGS if (sql := b.sql())} | {"udf_collatz_steps": _COLLATZ}
