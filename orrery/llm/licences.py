"""Operator 9, licence scans: runs of words against licence texts and notices by the Dice coefficient of word bigrams.

Functions of DataFrames only: no Python runs on the executors and nothing is shuffled. A notice of b bigrams can reach
the threshold t only with texts of t/(2-t)*b to (2-t)/t*b bigrams; others are passed over without looking at words.

A best run of words begins and ends where a stretch of the template's bigrams does: a bigram of the template next to
a run never lowers its coefficient, and one of others at its end never raises it. So only those runs are compared.
"""

from __future__ import annotations

import math
import string
import zlib
from pathlib import Path

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices by which public licences are declared, with the licences' usual short names.
NOTICES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Full texts of licences, and (NAME.header.txt) the headers by which files are put under them; looked for in runs of words.
TEXTS = [(p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def bigrams(text: str) -> list[str]:
    """Different word bigrams of a notice: A-Z in lower case, words of letters and digits."""
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))


def words_column(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.split(F.trim(F.regexp_replace(lower, r"[^\p{L}\p{N}]+", " ")), " ")


RUN = "struct<dice: double, i: int, j: int, name: string>"


def templates(texts: list[tuple[str, list[str]]], threshold: float) -> Column:
    """The (name, bigrams) to look for, as one array: bounds of a run's different bigrams, and the places in which ``most`` are met, if soon."""
    rows = []
    for name, b in texts:
        least, most = math.ceil(threshold / (2 - threshold) * len(b) - 1e-9), math.floor((2 - threshold) / threshold * len(b) + 1e-9)
        numbers = {"n": len(b), "least": least, "most": most, "wide": 4 * len(b) + 64}
        rows.append(F.struct(F.lit(name).alias("name"), *[F.lit(v).alias(k) for k, v in numbers.items()], F.split(F.lit("|".join(b)), "[|]").alias("b")))
    return F.array(*rows)


def runs_like(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (g, h, kinds_h, c: templates, ...) with r: the runs (dice, i, j, name) of the bigrams g, from place i to j, whose
    Dice coefficient with a template is ``threshold`` or more.

    h: places of g that any template may have, kinds_h: the bigrams there. A run begins and ends with stretches of the template's
    bigrams: any other is worse than a part of it. From each beginning the best end is taken (of ends alike the nearest).
    Ends are tried from the farthest, and counted out only if the bigrams in common that can lie between (those from the
    beginning on, those up to the end, and the places) could beat the best so far. An end adds something only if its stretch has a
    bigram for the first time since the beginning, and a beginning only if its stretch has one for the last time: so
    text that repeats itself has few ends for each beginning. A run has no more than ``most`` different bigrams; where so many are met
    soon (in ``wide`` places), later ends are left out.
    """
    size = lambda a, low, n: f"size(array_distinct(slice({a}, {low} + 1, {n})))"
    kept = lambda *names: ", ".join(f"c.{k} AS {k}" for k in ("name", "n", "least", "most", "wide", *names))
    places = "sequence(0, size(c.pos) - 1)"
    before, after = "c.order[greatest(r, 1) - 1]", "c.order[least(r + 1, size(c.order) - 1)]"
    beside = f"struct(c.order[r].k AS k, if(r > 0 and {before}.x = c.order[r].x, {before}.k, -1) AS prev, if(r < size(c.order) - 1 and {after}.x = c.order[r].x, {after}.k, size(c.order)) AS next)"
    count = lambda low, n: f"if(size(c.first) * size(c.hit) <= {WORK}, {size('c.hit', low, n)}, size(c.hit))"
    inside = lambda field: f"transform(slice(c.link, a + 1, c.last[t] - a + 1), q -> q.{field})"
    steps = [
        f"filter(transform(filter(c, c -> size(kinds_h) >= c.least), c -> struct({kept()}, array_intersect(kinds_h, c.b) AS own)), c -> size(c.own) >= c.least)",
        f"transform(c, c -> struct({kept()}, filter(h, p -> array_contains(c.own, g[p])) AS pos))",
        f"transform(c, c -> struct({kept('pos')}, transform(c.pos, p -> g[p]) AS hit, filter({places}, k -> k = 0 or c.pos[greatest(k, 1) - 1] < c.pos[k] - 1) AS first,"
        f" filter({places}, k -> k = size(c.pos) - 1 or c.pos[least(k + 1, size(c.pos) - 1)] > c.pos[k] + 1) AS last))",
        f"transform(c, c -> struct({kept('pos', 'hit', 'first', 'last')}, sort_array(transform(c.hit, (x, k) -> struct(x, k))) AS order))",
        f"transform(c, c -> struct({kept('pos', 'hit', 'first', 'last')}, sort_array(transform({places}, r -> {beside})) AS link, flatten(transform(c.first, (a, t) -> array_repeat(t, c.last[t] - a + 1))) AS of))",
        f"transform(c, c -> struct({kept('hit', 'of')}, transform(c.first, (a, t) -> struct(a, c.last[t] AS z, c.pos[a] AS i, c.pos[c.last[t]] AS j, {count('0', 'c.last[t] + 1')} AS upto,"
        f" {count('a', 'size(c.hit)')} AS rest, {size('g', 'c.pos[a]', 'c.wide')} > c.most AS soon, array_min({inside('prev')}) AS prev, array_max({inside('next')}) AS next)) AS stretch))",
    ]
    run = lambda dice, j: f"cast(struct({dice}, s.i, {j}, c.name) AS {RUN})"
    x, bar = "least(s.rest, e.upto, e.z - s.a + 1)", f"greatest(best.dice, {threshold}D)"
    could = f"e.prev < s.a and e.z < s.next and {x} >= c.least and (not s.soon or e.j < s.i + c.wide) and 2.0D * {x} / ({x} + c.n) >= {bar}"
    counted = f"struct({size('g', 's.i', 'e.j - s.i + 1')} AS n, {size('c.hit', 's.a', 'e.z - s.a + 1')} AS hits)"
    dice = "2.0D * v.hits / (v.n + c.n)"
    better = f"transform(array({counted}), v -> if(v.n between c.least and c.most and {dice} >= {bar}, {run(dice, 'e.j')}, best))[0]"
    ends = "reverse(slice(c.stretch, t + 1, least(if(s.soon, c.wide, size(c.stretch)), if(s.next < size(c.of), c.of[least(s.next, size(c.of) - 1)] - t + 1, size(c.stretch)))))"
    steps.append(f"filter(flatten(transform(c, c -> transform(c.stretch, (s, t) -> aggregate({ends}, {run('0.0D', 's.i')}, (best, e) -> if({could}, {better}, best))))), r -> r.dice > 0)")
    for step in steps:
        rows = rows.withColumn("c", F.expr(step))
    return rows.withColumnRenamed("c", "r")


def kept_runs(runs: str) -> str:
    """SQL of the runs (dice, i, j, name) that stay: the best first (then the longer, then the earlier name), without those of which
    more than half lies within one that stays."""
    order = "(x, y) -> CASE WHEN x.dice <> y.dice THEN if(x.dice > y.dice, -1, 1) WHEN x.j - x.i <> y.j - y.i THEN if(x.j - x.i > y.j - y.i, -1, 1) WHEN x.name <> y.name THEN if(x.name < y.name, -1, 1) ELSE x.i - y.i END"
    within = "exists(stay, q -> 2 * (least(q.j, r.j) - greatest(q.i, r.i) + 1) > r.j - r.i + 1)"
    kind = "array<struct<dice: double, i: int, j: int, name: string>>"
    return f"aggregate(array_sort({runs}, {order}), cast(array() AS {kind}), (stay, r) -> if({within}, stay, cast(concat(stay, array(r)) AS {kind})))"


#: Up to so many steps, bigrams in common on either side of a stretch are counted to spare ends; this steers the cost only.
WORK = 4_000_000
#: Places of two tables, by crc32 and by xxhash64, that tell nearly all bigrams that no template has from the others.
FILTER = 1 << 18


def licence_scan(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_units, n_matched, licences (sorted names), best_licence, best_dice.

    Units are the lines that are not empty and, if there are several, the whole text. A unit matches the notice with the
    largest Dice coefficient of their sets of word bigrams, if that is ``threshold`` or more (ties: the later name). Notices and
    ``texts`` (full texts and headers; TEXTS unless notices are given) are also looked for in every run of consecutive words,
    whatever lines it lies in and whatever stands beside it; of templates that match one and the same run the best is kept. A
    name found only so counts once in n_matched; ties for best_licence go to the later name. Null and blank texts have no units
    (n_units 0, no licence, best_dice 0); texts of any length are read whole; an empty table gives none. Further columns are
    ignored; repeated rows and ids give a row each. The notices are a parameter held in the plan, so they must be few (512 at most).
    """
    pairs = [(name, bigrams(t)) for name, t in (NOTICES if notices is None else notices)]
    pairs = [(name, b) for name, b in pairs if b]
    if len(pairs) > 512:
        raise ValueError("over 512 notices: scan in several calls")
    texts = [(name, bigrams(t)) for name, t in (TEXTS if texts is None and notices is None else texts or [])]
    whole = pairs + [(name, b) for name, b in texts if b]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least = min((math.ceil(low * len(b) - 1e-9) for _, b in pairs), default=1)
    most = max((math.floor(high * len(b) + 1e-9) for _, b in pairs), default=0)
    array = lambda xs: F.array(*[F.lit(x) for x in xs])

    def compare(b: Column) -> Column:
        tried = []
        for name, notice in pairs:
            fits = F.size(b).between(math.ceil(low * len(notice) - 1e-9), math.floor(high * len(notice) + 1e-9))
            dice = 2.0 * F.size(F.array_intersect(b, array(notice))) / (F.size(b) + len(notice))
            tried.append(F.struct(F.when(fits, dice).otherwise(0.0).alias("dice"), F.lit(name).alias("name")))
        return F.filter(F.array(*tried), lambda m: m["dice"] >= threshold) if tried else F.array().cast("array<struct<dice:double,name:string>>")

    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    units = F.when(F.size(lines) > 1, F.concat(lines, F.array(text))).otherwise(lines)
    out = docs.select(F.col(id_col).alias("doc_id"), units.alias("units"))
    out = out.select("doc_id", F.size("units").cast("long").alias("n_units"), F.transform("units", words_column).alias("w")).withColumn("g", F.try_element_at("w", F.lit(-1)))
    pairs_of = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    lines = F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))  # the last unit is the whole text, whose bigrams are made once
    out = out.select("doc_id", "n_units", F.filter(lines, lambda w: F.size(w) > least).alias("w"), F.when(F.size("g") > 1, pairs_of(F.col("g"))).otherwise(F.array().cast("array<string>")).alias("g"))
    units = F.concat(F.transform("w", lambda w: F.array_distinct(pairs_of(w))), F.array(F.array_distinct("g")))
    out = out.select("doc_id", "n_units", "g", F.filter(units, lambda b: F.size(b).between(least, most)).alias("b"))
    near = F.filter(F.col("b"), lambda b: F.arrays_overlap(b, array(sorted({x for _, notice in pairs for x in notice})))) if pairs else F.col("b")
    one, two = bytearray(FILTER), bytearray(FILTER)
    for x in {x for _, b in whole for x in b}:
        one[zlib.crc32(x.encode()) % FILTER] = 1
        two[xxhash.xxh64_intdigest(x.encode(), 42) % FILTER] = 1
    marked = lambda table, n: F.substring(F.lit(bytes(table)), n.cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    maybe = lambda p: marked(one, F.crc32(F.col("g")[p]) % FILTER) & marked(two, F.pmod(F.xxhash64(F.col("g")[p]), F.lit(FILTER)))
    places = F.when(F.size("g") > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.size("g") - 1, F.lit(0))), maybe)).otherwise(F.array().cast("array<int>"))
    best = F.transform(F.filter(F.transform(near, compare), lambda m: F.size(m) > 0), lambda m: F.array_max(m))
    out = out.select("doc_id", "n_units", "g", best.alias("m"), places.alias("h"))
    out = out.select("doc_id", "n_units", "g", "m", "h", F.array_distinct(F.transform("h", lambda p: F.col("g")[p])).alias("kinds_h"))
    fewest = min((math.ceil(low * len(b) - 1e-9) for _, b in whole), default=1)
    if whole:
        every = templates(whole, threshold)
        out = runs_like(out.withColumn("c", F.when(F.size("kinds_h") >= fewest, every).otherwise(F.slice(every, 1, 0))), threshold)
    else:
        out = out.withColumn("r", F.array().cast(f"array<{RUN}>"))
    out = out.select("doc_id", "n_units", "m", F.expr(kept_runs("r")).alias("r"))
    fields = lambda r: F.struct(r["dice"].alias("dice"), r["name"].alias("name"))
    out = out.select(
        "doc_id", "n_units", (F.size("m") + F.size(F.array_except(F.col("r")["name"], F.col("m")["name"]))).cast("long").alias("n_matched"),
        F.concat("m", F.transform("r", fields)).alias("m"),
    )
    return out.select(
        "doc_id", "n_units", "n_matched",
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("m", lambda m: m["name"])))).alias("licences"),
        F.array_max("m")["name"].alias("best_licence"), F.round(F.coalesce(F.array_max("m")["dice"], F.lit(0.0)), 6).alias("best_dice"),
    )
