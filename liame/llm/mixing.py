"""Mixing sources to target shares of the tokens, with capped repeats and exact block quotas per output shard.

Every source is cut into blocks by a hash of its documents, as many as its
tokens ask for. Target shares and caps give each source a number of whole
passes over its blocks and a rest; the blocks of all passes are the source's
block quota. A splitting tree halves the shards again and again, and at every
node draws how many blocks of each source go left from the multivariate
hypergeometric distribution; the driver draws the first levels, tasks the
trees below. A shard thus has an exact number of blocks of each source, a
stretch of the source's permuted blocks that no other shard has, and is shuffled by itself.
"""

from __future__ import annotations

import base64
import json
import os
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liame.plans.lineage import cut
from liame.plans.parallel import spread, tasks
from liame.sources.tables import load

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens); Spark sends the vocabulary file, and each Python worker reads it once."""
    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes})

    rows = documents.where("doc_id is not null and text is not null and source is not null").select("doc_id", "source", "text")
    return spread(rows).mapInPandas(count, "doc_id long, source string, tokens long")


def plan_quotas(have: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The largest total at which every source that has tokens gets its share within its cap, and its quota.

    Shares of targets without tokens (or with a cap under 1) go to the others
    in proportion; a negative share counts as none.
    """
    able = {s: (w, c) for s, (w, c) in targets.items() if w > 0 and c >= 1 and have.get(s, 0) > 0}
    whole = sum(w for w, _ in able.values())
    if not able:
        return 0.0, {}
    total = min(c * have[s] * whole / w for s, (w, c) in able.items())
    return total, {s: total * w / whole for s, (w, _) in able.items()}


Node = tuple[int, int, dict[str, tuple[int, int]]]  # first shard, number of shards, source -> (first block, number of blocks)


def halves(node: Node, seed: int) -> tuple[Node, Node]:
    """A node's two halves, by a multivariate hypergeometric draw; a function of the node and the seed."""
    first, shards, quota = node
    left = shards // 2
    rng = np.random.default_rng([seed, first, shards])
    rest = sum(k for _, k in quota.values())
    take = rest * left // shards
    a, b = {}, {}
    for s, (start, own) in sorted(quota.items()):
        # Take blocks without return from this source's and the others'.
        rest -= own
        got = min(take, own) if not rest else 0 if not own or not take else int(rng.hypergeometric(own, rest, take))
        take -= got
        if got:
            a[s] = (start, got)
        if own - got:
            b[s] = (start + got, own - got)
    return (first, left, a), (first + left, shards - left, b)


def tree(node: Node, seed: int, least: int = 1) -> Iterator[Node]:
    """The nodes of ``least`` shards or fewer below a node."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x[1] <= least:
            yield x
        else:
            stack += halves(x, seed)[::-1]


LEVEL = 1024  # parts into which the search for a source's last block splits a stretch; so many rows a source reach the driver


def _last_blocks(placed: DataFrame, blocks: dict[str, int], rests: dict[str, float]) -> dict[str, tuple[int, float]]:
    """source -> (the block in which the rest of its quota ends, what is left of the rest there).

    ``placed`` has (source, place, tokens), place from 0 to the source's
    number of blocks. Each round sums LEVEL parts of the stretch in which the
    end lies, so a source of any size takes few rounds.
    """
    open_ = {s: (0, blocks[s], r) for s, r in rests.items() if r > 0.5}
    found: dict[str, tuple[int, float]] = {}
    while open_:
        stretch = placed.sparkSession.createDataFrame([(s, lo, hi, max(1, -(-(hi - lo) // LEVEL))) for s, (lo, hi, _) in sorted(open_.items())], "source string, lo long, hi long, width long")
        rows = placed.join(F.broadcast(stretch), "source").where("place >= lo and place < hi")
        sums: dict[str, dict[int, int]] = {}
        for r in rows.groupBy("source", F.floor((F.col("place") - F.col("lo")) / F.col("width")).cast("long").alias("part")).agg(F.sum("tokens").alias("t")).collect():
            sums.setdefault(r["source"], {})[r["part"]] = r["t"]
        ahead = {}
        for s, (lo, hi, left) in open_.items():
            width, at = max(1, -(-(hi - lo) // LEVEL)), lo
            for part, t in sorted(sums.get(s, {}).items()):
                at = lo + part * width
                if left <= t:
                    break
                left -= t
            if width == 1:
                found[s] = (at, left)
            else:
                ahead[s] = (at, min(hi, at + width), left)
        open_ = ahead
    return found


def mixture(sized: DataFrame, targets: DataFrame, shard_tokens: int = 250_000, blocks_a_shard: int = 32, seed: int = 7, nodes: int = 256) -> DataFrame:
    """The mixture: (doc_id, source, copy, tokens, shard, position), position from 1 in each shard.

    ``sized`` has distinct (doc_id, source, tokens); ``targets``, a dimension
    read to the driver, has (source, target_share, max_repeats). Sources
    without target, documents without source and targets without documents
    contribute nothing; the latter's share goes to the other sources in
    proportion. The total is the largest that no cap forbids. A source is short
    of its quota by less than one document. A block holds about shard_tokens /
    blocks_a_shard tokens (a longer document is a block of its own size); the
    driver draws ``nodes`` nodes of the tree.
    """
    spark = sized.sparkSession
    out = "doc_id long, source string, copy int, tokens long, shard long, position long"
    wanted = {
        r["source"]: (float(r["target_share"]), int(r["max_repeats"]))
        for r in targets.where("source is not null and target_share is not null and max_repeats is not null").distinct().collect()
    }
    sized = sized.where(F.col("source").isin(list(wanted))).select("doc_id", "source", "tokens")
    have = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    total, quotas = plan_quotas(have, wanted)
    if not quotas:
        return spark.createDataFrame([], out)
    shards = max(1, -(-int(total) // shard_tokens))
    blocks = {s: max(1, -(-have[s] * blocks_a_shard // shard_tokens)) for s in quotas}
    passes = {s: int(quotas[s] // have[s]) for s in quotas}
    passes = {s: n - 1 if n and quotas[s] - n * have[s] < -0.5 else n for s, n in passes.items()}
    # Blocks are hashes, so their numbers are a random order already.
    plan = spark.createDataFrame([(s, blocks[s], passes[s]) for s in sorted(quotas)], "source string, blocks long, passes int")
    placed = sized.join(F.broadcast(plan), "source").withColumn("place", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    last = _last_blocks(placed, blocks, {s: quotas[s] - passes[s] * have[s] for s in quotas})
    counts = {s: passes[s] * blocks[s] + (last[s][0] + 1 if s in last else 0) for s in quotas}
    ends = spark.createDataFrame([(s, *last.get(s, (-1, 0.0))) for s in sorted(quotas)], "source string, last long, take double")
    copies = placed.join(F.broadcast(ends), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes") + F.when(F.col("last") < 0, 0).otherwise(1))))
    whole = copies.where("copy <= passes or place < last")
    # Within the block in which a quota ends, documents enter in hashed order while they fit.
    so_far = F.sum("tokens").over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), "copy", "doc_id"), "doc_id"))
    part = copies.where("copy > passes and place = last").withColumn("so_far", so_far).where("so_far <= take").drop("so_far")
    rows = whole.unionByName(part).select("doc_id", "source", "copy", "tokens", ((F.col("copy") - 1) * F.col("blocks") + F.col("place")).alias("block"))

    top = [json.dumps(n) for n in tree((0, shards, {s: (0, n) for s, n in counts.items() if n}), seed, max(1, -(-shards // nodes)))]

    def below(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["node"]:
                leaves = [(s, start, n, first) for first, _, quota in tree(tuple(json.loads(text)), seed) for s, (start, n) in quota.items()]
                yield pd.DataFrame(leaves, columns=["source", "start", "n", "shard"])

    drawn = spark.createDataFrame([(n,) for n in top], "node string").repartition(min(len(top), tasks(spark))).mapInPandas(below, "source string, start long, n long, shard long")
    drawn = drawn.select("source", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("block"), "shard")
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "copy", "doc_id"), "doc_id", "copy")
    rows = rows.join(drawn, ["source", "block"])
    return rows.select("doc_id", "source", "copy", "tokens", "shard", F.row_number().over(place).cast("long").alias("position"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    sized = cut(token_counts(load(spark, folder, "documents")).dropDuplicates(["doc_id"]))
    return mixture(sized, load(spark, folder, "mix_targets"))


def reached(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: wanted share, tokens and share reached, largest number of uses."""
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("got"), F.max("copy").alias("uses"))
    tokens = F.coalesce("got", F.lit(0)).cast("long")
    return targets.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", tokens.alias("tokens"),
        (tokens / F.greatest(F.sum(tokens).over(Window.partitionBy()), F.lit(1))).alias("share"),
        F.coalesce("uses", F.lit(0)).alias("uses"),
    )


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return reached(p9_mixture(spark, folder), load(spark, folder, "mix_targets"))


def p9_chars(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture by characters, which SQL can count too: whether each source comes within a document of its quota and is used as often as that asks for."""
    docs = load(spark, folder, "documents").where("source is not null and text is not null")
    sized = docs.select("doc_id", "source", F.length("text").cast("long").alias("tokens")).dropDuplicates(["doc_id"])
    targets = load(spark, folder, "mix_targets")
    report = reached(mixture(sized, targets), targets)
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.max("tokens").alias("largest"))
    able = F.when((F.col("have") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1), F.col("target_share"))
    rows = report.join(have, "source", "left").withColumn("able", able)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.min(F.col("max_repeats") * F.col("have") / F.col("able")).over(everything))
    short = F.col("total") * F.col("able") - F.col("tokens")
    whole = F.floor(F.col("total") * F.col("able") / F.col("have") + 1e-9)  # passes that the quota asks for in full
    return rows.select(
        "source", F.coalesce((short > -0.5) & (short < F.col("largest") + 0.5), F.lit(False)).alias("reached"),
        ((F.col("uses") <= F.col("max_repeats")) & (F.col("uses") >= F.coalesce(whole, F.lit(0))) & (F.col("uses") <= F.coalesce(whole, F.lit(0)) + 1)).alias("within_cap"),
    )


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_chars": p9_chars}
SQL = {
    "p9_chars": """
with h as (select source from documents where source is not null and text is not null group by 1 having sum(length(text)) > 0)
select source, h.source is not null and target_share > 0 and max_repeats >= 1 as reached, true as within_cap from mix_targets left join h using (source)""",
}
