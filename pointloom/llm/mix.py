"""Mixing sources to target weights by nested hash thresholds.

Every record has a 64-bit hash; a source's budget is met by all records (whole copies) plus those whose hash
lies below a threshold. The threshold comes from histograms: tokens by source and hash bucket, the bucket in
which the budget ends, then that bucket alone in finer buckets, until it holds one hash value. Records are never
sorted; the 2^15 buckets of a source are, level by level, and the plan is a table with a row per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.session import materialize, release

BITS, LEVELS = 15, 4  # 60 of the hash's bits


def _encoder(path: str):
    """The public tokenizer at ``path``: .tiktoken, .json (tokenizers) or .model (sentencepiece)."""
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(x)) for x in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(e) for e in sp.encode(texts, num_threads=1)]


def token_counts(df: DataFrame, text: str, tokenizer: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``tokens`` of the whole text; a null or empty text has 0 tokens."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer)
        for pdf in batches:
            out = pdf[keep].copy()
            out["tokens"] = pd.Series(encode([x if isinstance(x, str) else "" for x in pdf["__text"]]), index=out.index, dtype="int64")
            yield out

    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(count, f"{fields}, tokens bigint")


def clean_source(column: str) -> F.Column:
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def sized_records(df: DataFrame, *, id: str, source: str, text: str, tokenizer: str) -> DataFrame:
    """rec (id), source (clean), tokens, h (60-bit hash of the id); repeated ids with the same text count once.
    Rows without id or source are left out."""
    named = df.select(F.col(id).alias("rec"), clean_source(source).alias("source"), F.col(text).alias("text")).where("rec IS NOT NULL AND source IS NOT NULL AND source <> ''")
    counted = token_counts(named, "text", tokenizer, ["rec", "source"])
    once = counted.groupBy("rec").agg(F.min(F.struct("source", "tokens")).alias("x")).select("rec", "x.source", "x.tokens")
    return materialize(once.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("rec"), F.lit("mix")), 4)), "sizes")


class Mix:
    """A planned mix. ``shares`` is one row per target source, ``records`` one row per chosen record."""

    def __init__(self, sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None):
        """``targets``: source, target_share, max_copies.

        ``total_tokens`` is the size aimed at, by default that of all target sources together. A source with
        a null or negative share gets nothing, null max_copies means 1; of a repeated source the row with the smallest share
        counts. Budgets are never exceeded; a source whose share cannot be reached contributes max_copies of every record and
        is marked.
        """
        goal = targets.select(
            clean_source("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"),
            F.greatest(F.coalesce("max_copies", F.lit(1)), F.lit(0)).cast("int").alias("copies"),
        ).where("source IS NOT NULL AND source <> ''")
        goal = goal.groupBy("source").agg(F.min(F.struct("share", "copies")).alias("g")).select("source", "g.*")
        have = sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
        plan = materialize(goal.join(have, "source", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("bigint"))), "goals")
        self.sizes = sizes.join(plan.select("source"), "source", "left_semi")
        aim = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(plan.agg(F.sum("size")).scalar(), F.lit(0)).cast("double")
        plan = plan.withColumn("budget", F.col("share") * aim)
        short = F.col("budget") > F.col("copies") * F.col("size")
        full = F.when(short, F.col("copies")).when(F.col("size") > 0, F.floor(F.col("budget") / F.when(F.col("size") > 0, F.col("size"))).cast("int")).otherwise(F.lit(0))
        plan = plan.withColumns({"short": short, "full": full})
        rest = F.when(F.col("short"), F.lit(0.0)).otherwise(F.col("budget") - F.col("full") * F.col("size"))
        plan = plan.withColumns({"rest": rest, "taken": F.col("full") * F.col("size"), "below": F.lit(0).cast("bigint"), "prefix": F.when((rest > 0) & (F.col("size") > 0), F.lit(0)).cast("bigint")})
        self.plan = self._thresholds(materialize(plan, "plan"))

    def _thresholds(self, plan: DataFrame) -> DataFrame:
        """Sets ``below``: records with h < below get one copy more. ``prefix``: bits of the bucket in which a source's rest ends,
        null once its threshold is known."""
        for level in range(LEVELS):
            ending = plan.where("prefix IS NOT NULL")
            if ending.isEmpty():
                break
            shift = 60 - BITS * (level + 1)
            inside = self.sizes.join(ending.select("source", "prefix"), "source").where(F.shiftright("h", shift + BITS) == F.col("prefix") if level else F.lit(True))
            sums = inside.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("tokens").alias("s"))
            upto = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("b"))).join(ending.select("source", "rest"), "source")
            fits = F.col("upto") <= F.col("rest")
            found = upto.groupBy("source").agg(F.max(F.when(fits, F.col("upto"))).alias("got"), F.min(F.when(~fits, F.col("b"))).alias("at"))
            got = F.coalesce("got", F.lit(0).cast("bigint"))
            end = F.when(F.col("at").isNotNull(), F.shiftleft("at", shift)).otherwise(F.shiftleft(F.col("prefix") + 1, shift + BITS))
            on = F.col("prefix").isNotNull()
            last, plan = plan, materialize(
                plan.join(found, "source", "left").withColumns({"below": F.when(on, end).otherwise(F.col("below")), "rest": F.when(on, F.col("rest") - got).otherwise(F.col("rest")), "taken": F.when(on, F.col("taken") + got).otherwise(F.col("taken")), "prefix": F.when(on, F.col("at"))}).drop("got", "at"),
                "plan",
            )
            release(last)
        return plan

    def shares(self) -> DataFrame:
        """source, target_share, max_copies, source_tokens, budget_tokens, mixed_tokens, actual_share, reachable."""
        mixed = self.plan.agg(F.sum("taken")).scalar()
        actual = F.coalesce(F.try_divide(F.col("taken"), mixed), F.lit(0.0))
        return self.plan.select("source", F.col("share").alias("target_share"), F.col("copies").alias("max_copies"), F.col("size").alias("source_tokens"), F.col("budget").alias("budget_tokens"), F.col("taken").alias("mixed_tokens"), actual.alias("actual_share"), (~F.col("short")).alias("reachable"))

    def records(self) -> DataFrame:
        """rec, source, tokens, copies (≥ 1): a filter on the hash, no sort of records."""
        more = F.when(F.col("h") < F.col("below"), 1).otherwise(0)
        return (
            self.sizes.join(self.plan.select("source", "full", "below", F.col("copies").alias("most")), "source")
            .select("rec", "source", "tokens", F.least(F.col("full") + more, F.col("most")).alias("copies"))
            .where("copies > 0")
        )
