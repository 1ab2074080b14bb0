"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length. Each source gets a budget of tokens by its weight, and what sources have
less than that goes to the others by theirs. A proportional part of
every length is taken outright; what remains of the budget is filled by bounded-knapsack dynamic programming over the
counts that are left. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from needlebed.llm.common import cut, fresh, id_key, need, small_enough

SEED = 17
#: Parts, by hash, of the documents of one source and length, so that a common length is no single task's work.
PARTS = 64


def word_tokens(text: Column) -> Column:
    """Tokens of a text by default: words between blanks. Any other exact count can be given as an expression."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0b]+")).cast("bigint")


def fit(lengths: list[int], counts: list[int], budget: int) -> tuple[list[int], int]:
    """How many of each length to take, and the tokens that come together: at most ``budget``.

    The sum is the budget itself whenever the knapsack over what the proportional part leaves can reach it, else the
    nearest sum below that it can reach.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total:
        return list(counts), total
    if budget <= 0:
        return [0] * len(counts), 0
    take = [c * budget // total for c in counts]
    rest = budget - sum(n * t for n, t in zip(lengths, take))
    margin = 2 * max(lengths)
    # Largest remainders first, down to where the knapsack takes over.
    for i in sorted(range(len(counts)), key=lambda i: (-(counts[i] * budget % total), lengths[i])):
        if rest < margin:
            break
        if take[i] < counts[i] and rest - lengths[i] >= margin:
            take[i] += 1
            rest -= lengths[i]
    # reach[s]: the sum s can be made; via[s]: the item that first made it, from a sum made before that item.
    reach, via, items = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int64), []
    reach[0] = True
    for i in sorted(range(len(counts)), key=lambda i: -lengths[i]):
        left, k = min(counts[i] - take[i], rest // lengths[i]), 1
        while left > 0 and not reach[rest]:
            k = min(k, left)
            w = k * lengths[i]
            new = np.flatnonzero(reach[:-w] & ~reach[w:]) + w if w <= rest else ()
            reach[new], via[new] = True, len(items)
            items.append((i, k))
            left, k = left - k, 2 * k
    best = int(np.flatnonzero(reach)[-1])
    s = best
    while s:
        i, k = items[via[s]]
        take[i] += k
        s -= k * lengths[i]
    return take, budget - rest + best


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, default_weight: float = 1.0, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, seed: int = SEED, tokens_out: str | None = None, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that are selected, with its columns and, if it is named, ``tokens_out``, their lengths.

    A source's budget is its part of the sum of weights times ``budget``, rounded down. A source that has less gives
    all, and the others share the rest by their weights, so the whole is ``budget`` wherever there are as many tokens.
    With no ``budget`` it is the largest for which no source has to give more than it has, which the scarcest one
    decides, but at least this ``share`` of all tokens of sources with a weight. ``weights`` are by source; others have ``default_weight``, rows with a null source together too. A weight of 0 or less takes none of
    that source. Rows without tokens (null, empty and blank texts) add nothing to any budget and aren't selected.
    Repeated rows are rows like others, each counted and taken for itself; where a tie of equal hashes has to be
    split, the order of the ids and then of the other columns decides. A text is counted whole, however long; bytes that
    aren't UTF-8 are part of words. An empty table gives an empty table. Texts aren't shuffled: the choice is made on
    hashes, and each row is held against the last hash of its source and length.
    """
    need(docs, source_col, id_col, text_col)
    out = tokens_out or fresh(docs, "n_tokens")[0]
    if tokens_out and tokens_out in docs.columns:
        raise ValueError(f"there is a column {tokens_out}")
    src, part, hsh, last, edge, over, same, rn = fresh(docs.withColumn(out, F.lit(0)), "mix_source", "mix_part", "mix_hash", "mix_last", "mix_edge", "mix_over", "mix_same", "mix_rn")
    # Never null, so that no filter counts a text once more; documents without tokens have no part in any rule.
    base = docs.withColumn(out, F.coalesce(word_tokens(F.col(text_col)) if tokens is None else tokens, F.lit(0)))
    base = base.withColumn(src, id_key(F.col(source_col))).withColumn(hsh, F.xxhash64(F.lit(seed), id_col, text_col)).withColumn(part, F.pmod(F.col(hsh), F.lit(PARTS)).cast("int"))
    # Source, length and hash of each document: all that the choice needs, so no text is shuffled.
    narrow = cut(base.select(F.col(src).alias("src"), F.col(out).alias("n"), F.col(part).alias("part"), F.col(hsh).alias("h"))).where("n > 0")
    cells = cut(narrow.groupBy("src", "n", "part").agg(F.count("*").alias("c")))
    hist = cells.groupBy("src", "n").agg(F.sum("c").alias("c"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("src") == "=" + name, F.lit(float(w))).otherwise(weight)
    totals = hist.groupBy("src").agg(F.sum(F.col("n") * F.col("c")).alias("has")).withColumn("w", weight).where("w > 0")
    whole = totals.agg(F.sum("w").alias("all_w"), F.sum("has").alias("all_has"), F.min(F.col("has") / F.col("w")).alias("scarcest"))
    most = F.floor(F.col("scarcest") * F.col("all_w"))
    if budget is not None:
        most = F.lit(int(budget)).cast("bigint")
    elif share is not None:
        most = F.greatest(most, F.floor(F.col("all_has") * float(share)))
    whole = whole.select("all_has", most.alias("all"))
    # Tokens for a weight of 1: from the best stocked source on, one row for each source, what is left when all those
    # with less have given all. It is largest where just the ones that have too little have done so.
    rich = Window.orderBy(F.desc(F.col("has") / F.col("w")), F.desc("src")).rowsBetween(Window.unboundedPreceding, 0)
    left = totals.select(F.sum("has").over(rich).alias("has"), F.sum("w").over(rich).alias("w")).crossJoin(F.broadcast(whole))
    level = left.agg(F.max((F.col("all") - F.col("all_has") + F.col("has")) / F.col("w")).alias("level"))
    goal = totals.crossJoin(F.broadcast(level)).select("src", F.greatest(F.lit(0), F.least("has", F.floor(F.col("level") * F.col("w") + 1e-6))).cast("bigint").alias("budget"))

    def chosen(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        rows["take"], _ = fit(rows["n"].tolist(), rows["c"].tolist(), int(rows["budget"].iloc[0]))
        return rows.loc[rows["take"] > 0, ["src", "n", "take"]]

    taken = hist.join(goal, "src").groupBy("src").applyInPandas(chosen, "src string, n bigint, take bigint")
    # Parts are taken whole up to the last one of a source and length; of that one, what comes first by hash.
    run = Window.partitionBy("src", "n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = cells.join(taken, ["src", "n"]).withColumn("left", F.col("take") - F.coalesce(F.sum("c").over(run), F.lit(0))).where("left > 0")
    lasts = cut(held.groupBy("src", "n").agg(F.max("part").alias("part"), F.max_by("left", "part").alias("left"), F.max_by("c", "part").alias("c")))
    n_lasts = lasts.count()
    split = narrow.join(small_enough(lasts.where("left < c"), n_lasts, 64), ["src", "n", "part"]).groupBy("src", "n", "left", "h").agg(F.count("*").alias("same"))
    split = split.withColumn("upto", F.sum("same").over(Window.partitionBy("src", "n").orderBy("h"))).where("upto >= left")
    edges = split.groupBy("src", "n").agg(F.min("h").alias("edge"), F.min_by(F.col("upto") - F.col("left"), "h").alias("over"), F.min_by("same", "h").alias("same"))
    rule = cut(lasts.select("src", "n", "part").join(edges, ["src", "n"], "left").select(F.col("src").alias(src), F.col("n").alias(out), F.col("part").alias(last), F.col("edge").alias(edge), F.coalesce("over", F.lit(0)).alias(over), F.col("same").alias(same)))
    n_ties = rule.agg(F.count_if(F.col(over) > 0)).first()[0]
    rows = base.join(small_enough(rule, n_lasts, 96), [src, out])
    at_edge = (F.col(part) == F.col(last)) & (F.col(hsh) == F.col(edge)) & (F.col(over) > 0)
    inside = (F.col(part) < F.col(last)) | ((F.col(part) == F.col(last)) & (F.col(edge).isNull() | (F.col(hsh) <= F.col(edge))))
    names = [*docs.columns, *([out] if tokens_out else [])]
    chosen_rows = rows.where(inside & ~F.coalesce(at_edge, F.lit(False))).select(*names)
    if n_ties:
        order = [F.col(c).cast("string") for c in docs.columns if c not in (id_col, text_col)]
        rank = Window.partitionBy(src, out).orderBy(F.col(id_col), *order)
        ties = rows.where(at_edge).withColumn(rn, F.row_number().over(rank)).where(F.col(rn) <= F.col(same) - F.col(over))
        chosen_rows = chosen_rows.unionAll(ties.select(*names))
    return chosen_rows
