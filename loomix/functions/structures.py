"""Functions of regular expressions, numpy and math, arrays, maps, JSON, and those that have no rewrite."""

from __future__ import annotations

from ..serve import native_udf


@native_udf(sql="regexp_replace(s, '[^0-9]', '')")
def clean_phone(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


@native_udf(sql="regexp_extract(url, '://([^/]+)', 1)")
def extract_domain(url: str) -> str:
    import re

    found = re.search("://([^/]+)", url)
    return "" if found is None else found[1]


# (?d): only a line feed ends a line, as in Python.
@native_udf(sql=r"rlike(s, '(?d)^[^@]+@[^@]+\\.[^@]+$')")
def is_email(s: str) -> bool:
    import re

    return re.match(r"^[^@]+@[^@]+\.[^@]+$", s) is not None


@native_udf(sql="cast(length(s) - length(translate(s, 'aeiouAEIOU', '')) AS bigint)")
def count_vowels(s: str) -> int:
    return sum(c in "aeiouAEIOU" for c in s)


@native_udf(sql="cast(coalesce(levenshtein(a, b), -1) AS bigint)")
def edit_distance(a: str, b: str) -> int:
    if a is None or b is None:
        return -1
    row = [*range(len(b) + 1)]
    for i, c in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (c != d))
    return row[-1]


@native_udf(sql="sqrt(x)")
def np_sqrt(x: float) -> float:
    import numpy as np

    return float(np.sqrt(x))


@native_udf(sql="CASE WHEN x = 0 THEN double('-Infinity') WHEN x < 0 THEN double('NaN') ELSE ln(x) END")
def np_log(x: float) -> float:
    import numpy as np

    return float(np.log(x))


@native_udf(sql="CASE WHEN x IS NULL OR lo IS NULL OR hi IS NULL THEN NULL WHEN isnan(x) OR isnan(lo) OR isnan(hi) THEN double('NaN') ELSE least(greatest(x, lo), hi) END")
def np_clip(x: float, lo: float, hi: float) -> float:
    import numpy as np

    if x is None or lo is None or hi is None:
        raise TypeError("clip of None")
    return float(np.minimum(np.maximum(x, lo), hi))


@native_udf(sql="exp(x)")
def np_exp(x: float) -> float:
    import numpy as np

    return float(np.exp(x))


@native_udf()
def math_floor(x: float) -> int:
    import math

    return math.floor(x)


@native_udf()
def math_ceil(x: float) -> int:
    import math

    return math.ceil(x)


@native_udf()
def math_log10(x: float) -> float:
    import math

    return math.log10(x)


@native_udf(sql="get_json_object(doc, '$.widget')")
def widget_name(doc: str) -> str:
    import json

    if doc is not None:
        found = json.loads(doc)["widget"]
        if isinstance(found, str):
            return found
        raise TypeError("not a string")


@native_udf(
    sql="""CASE WHEN length(start_text) >= 19
      AND try_to_timestamp(substring(start_text, 1, 19), 'yyyy-MM-dd HH:mm:ss') IS NOT NULL
      AND try_cast(replace(dur_text, '_', '') AS double) > -1 AND try_cast(replace(dur_text, '_', '') AS double) < 1000000000D
    THEN transform(sequence(0, cast(try_cast(replace(dur_text, '_', '') AS double) AS int)),
      i -> date_format(timestampadd(SECOND, i, try_to_timestamp(substring(start_text, 1, 19), 'yyyy-MM-dd HH:mm:ss')), 'yyyy-MM-dd HH:mm:ss'))
    ELSE cast(array() AS array<string>) END"""
)
def scatter_to_seconds(start_text: str, dur_text: str) -> list[str]:
    from datetime import datetime, timedelta

    form = "%Y-%m-%d %H:%M:%S"
    try:
        seconds = int(float(dur_text))
        begin = datetime.strptime(str(start_text)[:19].ljust(19, "?"), form)
        return [(begin + timedelta(seconds=k)).strftime(form) for k in range(seconds + 1)]
    except (TypeError, ValueError, OverflowError):
        return []


_MEMBER = "exists({list}, e -> e <=> {item})"


def _both(first: str, second: str) -> str:
    """1 if prev_lac is in one list and cur_lac in the other, else 0; None counts as an element."""
    return f"CASE WHEN {_MEMBER.format(list=first, item='prev_lac')} AND {_MEMBER.format(list=second, item='cur_lac')} THEN 1L ELSE 0L END"


@native_udf(sql=_both("bsp_lacs", "mid_lacs"))
def BSPIn(prev_lac: str, cur_lac: str, bsp_lacs: list[str], mid_lacs: list[str]) -> int:
    return int(prev_lac in bsp_lacs and cur_lac in mid_lacs)


@native_udf(sql=_both("ebr_lacs", "mid_lacs"))
def EBRIn(prev_lac: str, cur_lac: str, ebr_lacs: list[str], mid_lacs: list[str]) -> int:
    return int(prev_lac in ebr_lacs and cur_lac in mid_lacs)


@native_udf(sql=_both("mid_lacs", "bsp_lacs"))
def BSPOut(prev_lac: str, cur_lac: str, bsp_lacs: list[str], mid_lacs: list[str]) -> int:
    return int(prev_lac in mid_lacs and cur_lac in bsp_lacs)


@native_udf(sql=_both("mid_lacs", "ebr_lacs"))
def EBROut(prev_lac: str, cur_lac: str, ebr_lacs: list[str], mid_lacs: list[str]) -> int:
    return int(prev_lac in mid_lacs and cur_lac in ebr_lacs)


@native_udf(sql="flatten(groups)")
def flatlist(groups: list[list[str]]) -> list[str]:
    return sum(groups, [])


@native_udf(sql="try_element_at(m, 'a')")
def value_for_a(m: dict[str, str]) -> str:
    return m.get("a")


# Without a rewrite: a service call, process state, evaluation of text, full case folding, Python's float spelling.
@native_udf()
def kms_encrypt(text: str, key_id: str) -> str:
    import boto3

    return None if text is None else boto3.client("kms").encrypt(KeyId=key_id, Plaintext=text.encode())["CiphertextBlob"].hex()


@native_udf()
def always_decline(x: int) -> int:
    import os

    return len(os.getcwd()) + x


@native_udf()
def pymap_to_json(m: dict[str, str]) -> str:
    import ast
    import json

    out = {}
    for k, v in m.items():
        try:
            out[k] = ast.literal_eval(v)
        except (ValueError, SyntaxError):
            out[k] = v
    return json.dumps(out)


@native_udf()
def casefold_lower(s: str) -> str:
    return s.casefold()


@native_udf()
def float_str(x: float) -> str:
    return str(x)
