"""Which filter removes what: all orders of some filters judged from one pass over the documents.

Filters play a removal game: a coalition is worth the documents that fail any of its members. One pass counts
documents by their set of failures; from the worth of all coalitions (32 for five filters) their potentials
(Hart and Mas-Colell) follow recursively, P(S) = (worth(S) + sum of P(S without i)) / |S|. A filter's Shapley
value is the potential of all filters less that of all others, and what a filter removes after some
others is the difference of two coalitions' worth. No order is ever run.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joblore.llm.scratch import stash

#: Maximal runs of other characters than ASCII white space.
WORD = r"([^\x20\x09-\x0D]+)"

#: What fails, by letter: columns of a text and of the array of its words.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * 80,
    "C": lambda text, words: F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.char_length(text).cast("long") * 10,
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}


def _failures(docs: DataFrame, filters: Mapping[str, Callable], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask): bit i of mask says that the i-th filter fails."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask.bitwiseOR(F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0))
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def failure_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable] = FILTERS, repeat: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): rows by the set of filters they fail, and how many of these are labelled
    quality = 1 and toxic = 1. The filter `repeat`, the last bit, fails on texts that a smaller id has too.

    Rows are counted by id before they meet their labels, and by text before the least id of a text is sought: neither
    repeated ids nor a text that fills a third of the table meet in one task. A null text is empty, a null part
    is ''. Rows without id have no label, repeat nothing and are repeated by nothing; rows that repeat an id
    don't repeat each other. Of several labels of an id the greatest counts.
    """
    last = 1 << len(filters)
    rows = _failures(docs, filters, id_col, text_col, part_col).groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = labels.groupBy(F.col(id_col).alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    rows = rows.join(known, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    texts = stash(texts, "texts")
    least = texts.groupBy("digest").agg(F.min("first").alias("least"))
    texts = texts.join(least, "digest")  # a text has a row for each part and label only
    stay = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    both = F.explode(F.array(F.struct(F.col("mask"), stay.alias("n")), F.struct(F.col("mask").bitwiseOR(last).alias("mask"), (F.col("n") - stay).alias("n"))))
    sets = texts.select("part", "good", "toxic", both.alias("s")).filter("s.n > 0")
    out = sets.groupBy("part", F.col("s.mask").alias("mask")).agg(
        F.sum("s.n").alias("n"), F.sum(F.when(F.col("good"), F.col("s.n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("s.n")).otherwise(0)).alias("toxic")
    )
    return out


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable] = FILTERS, repeat: str = "E", **columns) -> DataFrame:
    """One row per part, order of the filters (a string of their letters) and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost and shapley, the removals of the step's filter summed over all orders.

    See failure_counts for nulls and repeated rows. An empty table has no parts and no rows. Letters must be single
    characters, and as all orders are returned there may be six filters at most.
    """
    letters = [*filters, repeat]
    if any(len(x) != 1 for x in letters) or len({*letters}) != len(letters) or len(letters) > 6:
        raise ValueError("filters have distinct letters and are six at most")
    m, everyone = len(letters), (1 << len(letters)) - 1
    counts = failure_counts(docs, labels, filters, repeat, **columns)

    def total(value: str, holds: Column) -> Column:
        return F.sum(F.when(holds, F.col(value)).otherwise(0))

    mask = F.col("mask")
    worth = [total(c, mask.bitwiseAND(s) != 0).alias(f"{c}_{s}") for c in ("n", "good", "toxic") for s in range(everyone + 1)]
    alone = [total("n", mask == 1 << i).alias(f"alone_{i}") for i in range(m)]
    game = counts.groupBy("part").agg(F.sum("n").alias("all"), *worth, *alone)

    orders = math.factorial(m)  # potentials times this are whole numbers
    game = game.withColumn("p_0", F.lit(0).cast("long"))
    for size in range(1, m + 1):
        without = {s: [s & ~(1 << i) for i in range(m) if s >> i & 1] for s in range(everyone + 1) if s.bit_count() == size}
        game = game.withColumns({f"p_{s}": F.expr(f"({orders} * n_{s} + {' + '.join(f'p_{r}' for r in rest)}) div {size}") for s, rest in without.items()})
    arrays = {c: F.array(*[F.col(f"{c}_{s}") for s in range(everyone + 1)]) for c in ("n", "good", "toxic")}
    arrays["alone"] = F.array(*[F.col(f"alone_{i}") for i in range(m)])
    arrays["shapley"] = F.array(*[F.col(f"p_{everyone}") - F.col(f"p_{everyone & ~(1 << i)}") for i in range(m)])
    game = game.select("part", "all", *[a.alias(c) for c, a in arrays.items()])

    steps = game.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(p)) for p in permutations(letters)])))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(m))))
    own = F.instr(F.lit("".join(letters)), F.col("filter_order").substr(F.col("step"), F.lit(1)))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << i).otherwise(0) for i, x in enumerate(letters)), F.lit(0))
    steps = steps.withColumns({"own": own, "before": before})
    steps = steps.withColumn("upto", F.col("before").bitwiseOR(F.expr("shiftleft(1, own - 1)")))

    def at(column: str, coalition: str) -> Column:
        return F.get(column, F.col(coalition))

    def gain(column: str) -> Column:
        return at(column, "upto") - at(column, "before")

    steps = steps.withColumn("single", F.expr("shiftleft(1, own - 1)"))
    return steps.select(
        "part", "filter_order", "step", (F.col("all") - at("n", "upto")).alias("kept"), gain("n").alias("removed"),
        (at("n", "single") - gain("n")).alias("redundant"), F.get("alone", F.col("own") - 1).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"), F.get("shapley", F.col("own") - 1).alias("shapley"),
    )
