"""Fill-in-middle transformation in native Spark SQL.

A text is cut into units by a pattern, and the units into prefix, middle and suffix at two places that digits of a SHA-256 of (seed, id)
give, so that a document is cut alike on every run and every cluster. The parts are arranged prefix-suffix-middle or suffix-prefix-middle
behind sentinels; other digits decide which, and which share of the documents is transformed at all. A text that is empty or already holds a
sentinel stays plain, so that parsing at the sentinels always gives the exact text back. One pass, no shuffle, no Python.

Defined results: null text is the empty text, which has no unit and stays plain; any length; rows that repeat are transformed alike; a null id
is written as no digits; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.llm.common import whole

#: Lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


def digits(seed: int, id_col: str, group: int) -> Column:
    """The group-th eight hexadecimal digits (from 0) of the SHA-256 of `seed:id`, as an unsigned integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("long")


def _checked(sentinels: tuple[str, str, str]) -> None:
    """No sentinel may begin within another one or itself, else the place of a cut could be read in two ways."""
    for a in sentinels:
        for b in sentinels:
            if not a or any(a.endswith(b[:n]) for n in range(1, len(b) + (a != b))) and a != b or a == b and any(a.endswith(a[:n]) for n in range(1, len(a))):
                raise ValueError(f"sentinels {a!r} and {b!r} overlap")
    if len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ")


def transform(
    df: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm, spm), prefix, middle, suffix (null if plain) and output of every row.

    `percent` of the documents are transformed, `spm_percent` of these into the form that begins with the suffix.
    """
    _checked(sentinels)
    p, s, m = map(F.lit, sentinels)
    rows = df.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    rows = rows.withColumn("units", F.regexp_extract_all("text", F.lit(unit), F.lit(0)))
    # Places of the cuts, and the form: functions of the id alone but for the number of units.
    rows = rows.withColumn("n", F.size("units").cast("long")).withColumns({f"h{i + 1}": digits(seed, "doc_id", i) for i in range(4)})
    cut = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    held = F.lit(False)
    for x in sentinels:
        held = held | F.col("text").contains(x)
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "low": F.least(*cut).cast("int"), "high": F.greatest(*cut).cast("int")})
    part = lambda begin, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, length), ""))
    low, high, n = F.col("low"), F.col("high"), F.col("n").cast("int")
    rows = rows.withColumns({"prefix": part(F.lit(0), low), "middle": part(low, high - low), "suffix": part(high, n - high)})
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, parsed out of a transformed one by its sentinels; of a plain one the text itself."""
    p, s, m = sentinels
    x = F.col(output)
    middle, head = F.substring_index(x, m, -1), F.substring_index(x, m, 1)
    first, second = (p, s), (s, p)

    def joined(begin: str, then: str, prefix_first: bool) -> Column:
        """The part behind the sentinel at the start, and that behind the next one."""
        one = F.expr(f"substring(substring_index({_quoted(output)}, {_literal(then)}, 1), {len(begin) + 1})")
        two = F.substring_index(head, then, -1)
        return F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one)

    return F.when(F.col(form) == "psm", joined(*first, True)).when(F.col(form) == "spm", joined(*second, False)).otherwise(x)


def _quoted(name: str) -> str:
    return ".".join(f"`{part}`" for part in name.split("."))


def _literal(text: str) -> str:
    return "'" + re.sub(r"(['\\])", r"\\\1", text) + "'"


def digests(df: DataFrame, **how) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (code points; null if plain), SHA-256 of the output and of the text restored from it."""
    rows = transform(df, **how)
    back = restored(sentinels=how.get("sentinels", SENTINELS))
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
