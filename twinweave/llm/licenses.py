"""License scans by MinHash over text windows, with Spark expressions only.

Words are runs of ASCII digits, letters and non-ASCII characters, letters small;
shingles are five words.  A template's containment in a document is the share
of the template's distinct shingles that the document has; it matches at
``CONTAINMENT`` or more.

Retrieval.  Windows are runs of consecutive shingles.  In each of ``BANDS``
orders (a shingle's hash under a mask) a window's MinHash is its first shingle;
a template is retrieved if some window of the document and some window of the
template have the same MinHash in the same order.  The windows suit the
template's length:

* under ``2 * WINDOW`` shingles: ``SHORT`` shingles, at every place of both.  An
  unaltered run of two shingles is found with certainty, because equal windows
  have equal minima.  So is a template of one shingle, because masks come in
  opposite pairs, and any shingle is the first of two in one order of a pair.  At 0.8 a template of two to four shingles has them all, and
  one of five or more has two in a row unless the text was cut up on purpose; a
  shingle left alone still meets with probability 1/3 an order, so that eight
  orders miss it with (2/3)^8, under 0.04, each.
* else: ``WINDOW`` shingles, at every half window of the document and every place
  of the template.  At 0.8 of the shingles kept some window keeps 0.8 of its own,
  a Jaccard similarity of 2/3 or more: eight orders miss that one window with
  (1/3)^8, about 0.00015, and a template has several.

The MinHash of a window is one of its shingles, so only places that hold a
shingle of some template are looked at: a sieve of ``2**SIEVE`` bits, probed twice,
passes all of these and few others.

Verification counts the template's distinct shingles in the whole document by
comparing them as text.

Defined cases: null, empty and short texts match nothing; a template under five
words has no shingles and matches nothing; very long texts are windows like any
other, all in one row; ties between wordings of one license go to the wording
with the fewest shingles; repeated rows are scanned each; columns not named are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

SHINGLE = 5
CONTAINMENT = 0.8
SHORT = 2
WINDOW = 16
BANDS = 8
SIEVE = 20
#: Rows of the template table that are broadcast; a larger one is joined as any table.
BROADCAST_ROWS = 500_000
#: Masks of the bands' hash orders, in opposite pairs: the leading three bits take all
#: eight values, the others are those of multiples of the golden ratio.
MASKS = [x for k in range(BANDS // 2) for m in [(k << 61 | (k + 1) * 0x9E3779B97F4A7C15 % 2**61)] for x in (m, ~m)]

# Public license notices, by name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."),
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
}


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def hashes(w: Column) -> Column:
    """64-bit hash of each shingle, in order; empty for fewer than five words."""
    return F.when(F.size(w) >= SHINGLE, F.transform(
        F.sequence(F.lit(0), F.size(w) - SHINGLE),
        lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def _bits(chosen: list[Column]) -> Column:
    """A number with bit k set if the k-th condition holds."""
    flags = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(chosen)]
    return sum(flags[1:], flags[0])


def _short_orders(h: Column, i: Column) -> Column:
    """Orders in which place i of h is the first of a window of two."""

    def first(m: int) -> Column:
        own, before, after = (F.get(h, k).bitwiseXOR(F.lit(m)) for k in (i, i - 1, i + 1))
        return F.coalesce(own <= before, F.lit(False)) | F.coalesce(own <= after, F.lit(False)) | (F.size(h) == 1)

    return _bits([first(m) for m in MASKS])


def _long_orders(h: Column, i: Column) -> Column:
    """Orders in which place i of h is the first of a window that begins at a half window's place."""
    half = WINDOW // 2
    begin = i - i % half

    def first(m: int) -> Column:
        def least(at: Column) -> Column:
            return F.array_min(F.transform(F.slice(h, at, WINDOW), lambda x: x.bitwiseXOR(F.lit(m))))

        own = F.get(h, i).bitwiseXOR(F.lit(m))
        return (own == least(begin + 1)) | ((begin > 0) & (own == least(F.greatest(begin + 1 - half, F.lit(1)))))

    return _bits([first(m) for m in MASKS])


def _template_orders(h: list[int]) -> list[int]:
    """For each place of a template's shingles the orders in which it is the first of some window."""
    size = SHORT if len(h) < 2 * WINDOW else WINDOW
    out = [0] * len(h)
    for at in range(max(1, len(h) - size + 1)):
        for k, m in enumerate(MASKS):
            out[min(range(at, min(at + size, len(h))), key=lambda i: h[i] ^ m)] |= 1 << k
    return out


def _templates(spark: SparkSession, templates: dict[str, str | list[str]]) -> tuple[DataFrame, int, list[int]]:
    """``n, license_id, n_template, part, s, orders, is_long`` of the wordings' distinct shingles; their number; their hashes."""
    flat = sorted((name, t) for name, x in templates.items() for t in ([x] if isinstance(x, str) else x))
    rows = spark.createDataFrame([(n, *x) for n, x in enumerate(flat)], "n int, license_id string, t string")
    rows = rows.withColumn("w", words(F.col("t"))).withColumn("h", hashes(F.col("w")))
    table, seen = [], set()
    for r in rows.select("n", "license_id", "w", "h").collect():  # as many rows as there are wordings
        found: dict[str, int] = {}
        for i, orders in enumerate(_template_orders(r.h) if r.h else []):
            s = " ".join(r.w[i : i + SHINGLE])
            found[s] = found.get(s, 0) | orders
        seen.update(r.h)
        table += [(r.n, r.license_id, len(found), part, s, orders, len(r.h) >= 2 * WINDOW) for part, (s, orders) in enumerate(found.items())]
    schema = "n int, license_id string, n_template long, part int, s string, orders int, is_long boolean"
    return spark.createDataFrame(table, schema), len(table), sorted(seen)


def _sieve(keys: list[int]):
    """Test for numbers that may be among keys, a literal that the planner folds once."""
    mask, shift = (1 << SIEVE) - 1, SIEVE + 4
    bits = [0] * (1 << (SIEVE - 6))
    for k in keys:
        for x in (k & mask, (k >> shift) & mask):
            bits[x >> 6] |= 1 << (x & 63)
    held = F.split(F.lit(",".join(str(x - (1 << 64) if x >> 63 else x) for x in bits)), ",").cast("array<bigint>")

    def may(key: Column) -> Column:
        def is_set(x: Column) -> Column:
            x = x.bitwiseAND(F.lit(mask))
            return F.getbit(F.get(held, F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1

        return is_set(key) & is_set(F.shiftright(key, shift))

    return may


def license_scan(documents: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str | list[str]] | None = None,
                 containment: float = CONTAINMENT) -> DataFrame:
    """``key, license_id, n_matched, n_template, containment`` for each match.

    A license with several wordings gives one row, of the wording with the most
    shingles found.  Documents are scanned where they lie; what is shuffled is,
    for each document and wording that share a shingle, which ones.
    """
    table, n_rows, keys = _templates(documents.sparkSession, TEMPLATES if templates is None else templates)
    may = _sieve(keys)
    rows = documents.select(F.col(key).alias("k"), words(F.col(text).cast("string")).alias("w"))
    rows = rows.select("k", "w", hashes(F.col("w")).alias("h"))
    rows = rows.select("k", "w", "h", F.when(F.size("h") > 0, F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: may(F.get("h", i)))).alias("at"))
    # the row number also keeps the planner from evaluating the arrays once more in a filter below
    found = rows.select("k", F.monotonically_increasing_id().alias("row"), F.array_distinct(F.transform("at", lambda i: F.struct(
        F.array_join(F.slice("w", i + 1, SHINGLE), " ").alias("s"), _short_orders(F.col("h"), i).alias("short"), _long_orders(F.col("h"), i).alias("long")))).alias("found"))
    places = found.select("k", "row", F.explode("found").alias("x")).select("k", "row", "x.s", "x.short", "x.long")
    shared = places.join(F.broadcast(table) if n_rows <= BROADCAST_ROWS else table, "s")
    meets = F.when(F.col("is_long"), F.col("long")).otherwise(F.col("short")).bitwiseAND(F.col("orders")) != 0
    counted = shared.groupBy("row", "n").agg(
        F.any_value("k").alias("k"), F.any_value("license_id").alias("license_id"), F.any_value("n_template").alias("n_template"),
        F.size(F.collect_set("part")).cast("long").alias("n_matched"), F.max(meets).alias("retrieved"))
    matched = counted.where("retrieved").withColumn("containment", F.col("n_matched") / F.col("n_template")).where(F.col("containment") >= containment)
    best = matched.groupBy("row", "license_id").agg(F.max(F.struct("n_matched", (-F.col("n_template")).alias("less"), "k")).alias("best"))
    return best.select(F.col("best.k").alias(key), "license_id", "best.n_matched", (-F.col("best.less")).alias("n_template"),
                       (F.col("best.n_matched") / -F.col("best.less")).alias("containment"))
