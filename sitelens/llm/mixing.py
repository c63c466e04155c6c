"""Mixing sources to target weights by a low-discrepancy schedule.

The mixture is a row of slots of ``block`` tokens. Slot k belongs to the source
into whose share of [0, 1) the point frac(k * golden ratio) falls, so in every
stretch of the schedule each source has its share of slots to within a few
slots. A source's documents are shuffled anew for every repeat and laid
end to end; its r-th slot takes the documents that begin in the r-th block of
tokens. The mixture holds the most tokens at which no source is used more
than its ``max_repeats`` times; blocks shrink with it, so that a small mixture
has as many slots. A slot past a source's last repeat stays empty.

Running sums are taken in two steps (within salted buckets, then over the few
bucket sums), so neither a hot source nor the schedule goes through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces for this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 2048
#: Blocks shrink so far that a mixture has at least this many slots.
LEAST_SLOTS = 1 << 16
#: A source that would hold the mixture below this part of what the others allow is too small for its share.
SHORT = 0.1
#: Slots are ranked in chunks of this many.
CHUNK = 1 << 16
#: Fixed value: the golden ratio's fraction of 2**31, made odd; points are whole multiples of 2**-31, exact for any slot.
PERIOD, GOLDEN = 1 << 31, 1327217885
#: A token bucket of a source holds about this many tokens.
BUCKET_TOKENS = 4_000_000


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """Rows (key, tokens): the length of each whole text in tokens; null counts 0.

    The vocabulary is read on the driver and broadcast (a file of about a
    megabyte), so the executors need no copy of it.
    """
    with open(tokenizer, "rb") as file:
        vocabulary = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encoding = tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[key, "tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens bigint")


def parts_that_fit(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], spare: bool = False) -> dict[str, float]:
    """Tokens of each source in the largest mixture at exact shares in which no source is used more than its repeats.

    A source without tokens allows no mixture. With ``spare`` sources that have no tokens, or so few
    that they allow less than ``SHORT`` of what the next source allows, do not bound the others: they give
    all their tokens times their repeats. Those with tokens may hold less than half of the shares together.
    """
    limits = {s: available.get(s, 0) * repeats[s] / share for s, share in shares.items() if share > 0}
    order = sorted(limits, key=lambda s: (limits[s], s))
    short = 0
    if spare:
        missing = sum(not limits[s] for s in order)
        for k in range(missing, len(order)):
            if k == missing or limits[order[k - 1]] < SHORT * limits[order[k]] and 2 * sum(shares[s] for s in order[missing:k]) < sum(shares[s] for s in order[missing:]):
                short = k
    size = limits[order[short]] if order else 0.0
    parts = {s: min(size, limits[s]) * shares[s] for s in sorted(limits)}
    return {s: n for s, n in parts.items() if n > 0}


def schedule(spark, n: int, shares: dict[str, float]) -> DataFrame:
    """Rows (slot, source, rank): each slot's source and its rank among the source's slots."""
    total = sum(shares.values())
    point = F.pmod(F.pmod("slot", F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PERIOD)) / F.lit(float(PERIOD))
    source, upto = F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        upto += share / total
        source = F.coalesce(source, F.when(point < (upto if name != list(shares)[-1] else 2.0), F.lit(name)))
    slots = spark.range(n).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk")).withColumn("source", source)
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).select("source", "chunk", "before")
    inside = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inside", inside).join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("inside")).alias("rank"))


def laid_out(docs: DataFrame, key: str, needs: DataFrame, seed: int = 1) -> DataFrame:
    """Rows (source, repeat, key, tokens, start): each use of a document and the token at which it begins in its source's row.

    ``docs`` has source, key and tokens; ``needs`` one row (source, tokens_in, uses, buckets) for each source.
    """
    used = docs.join(F.broadcast(needs), "source").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    used = used.withColumn("place", F.xxhash64(key, "repeat", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("place", 20), F.col("buckets")))
    by = ["source", "repeat", "bucket"]
    sums = used.groupBy(*by).agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source", "repeat").orderBy("bucket")) - F.col("n")).select(*by, "before")
    inside = F.sum("tokens").over(Window.partitionBy(*by).orderBy("place", key)) - F.col("tokens")
    return used.withColumn("inside", inside).join(before, by).select("source", "repeat", key, "tokens", (F.col("repeat") * F.col("tokens_in") + F.col("before") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, targets: DataFrame, key: str = "doc_id", block: int = BLOCK, seed: int = 1, spare: bool = False) -> DataFrame:
    """The mixture as rows (slot, source, key, repeat, tokens).

    ``docs`` has columns source, key and tokens; ``targets`` source,
    target_share and max_repeats (a row for each source, a small table).
    Documents of no listed source, of null source and of no tokens are left
    out. A source with a share but without tokens makes the mixture empty;
    with ``spare`` such a source, or one too small for its share, is used up
    and the others keep their shares among themselves. ``block`` is the
    longest block.
    """
    spark = docs.sparkSession
    rows = {r.source: r for r in targets.select("source", "target_share", "max_repeats").where("target_share > 0 and max_repeats > 0").collect()}
    shares = {s: float(rows[s].target_share) for s in sorted(rows)}
    repeats = {s: int(rows[s].max_repeats) for s in rows}
    docs = docs.where("tokens > 0").where(F.col("source").isin(list(rows)))
    available = {r.source: int(r.n) for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    parts = parts_that_fit(available, shares, repeats, spare)
    total = sum(parts.values())
    block = int(min(block, max(1, total // LEAST_SLOTS)))
    n = round(total / block)
    slots = schedule(spark, n, parts or shares)
    if not n:
        needs_rows = [(s, 1, 1, 1) for s in shares] or [("", 1, 1, 1)]
    else:
        # the schedule strays from a source's part by less than six slots
        needs_rows = [(s, available[s], min(repeats[s], -(-int(part + 6 * block) // available[s])), max(1, available[s] // BUCKET_TOKENS)) for s, part in parts.items()]
    needs = spark.createDataFrame(needs_rows, "source string, tokens_in bigint, uses int, buckets bigint")
    placed = laid_out(docs.select("source", key, "tokens"), key, needs, seed).withColumn("rank", F.floor(F.col("start") / block))
    return placed.join(slots, ["source", "rank"]).select("slot", "source", key, "repeat", "tokens")


def shares_of(mixture: DataFrame, targets: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (source, target_share, actual_share, tokens, times_used): times used is the source's tokens in the mixture over its own."""
    mixed = mixture.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    own = docs.groupBy("source").agg(F.sum("tokens").alias("own"))
    total = mixed.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share", "max_repeats").join(mixed, "source", "left").join(own, "source", "left").join(F.broadcast(total))
    used = F.coalesce("tokens", F.lit(0))
    return out.select("source", "target_share", F.coalesce(used / F.col("total"), F.lit(0.0)).alias("actual_share"), used.alias("tokens"), F.coalesce(used / F.col("own"), F.lit(0.0)).alias("times_used"), "max_repeats")
