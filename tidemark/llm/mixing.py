"""Mixing sources to target weights by fixed-length token blocks.

Tokens are packed into blocks of fixed length; every output shard draws how many of its slots each
source gets; a source's slots, numbered over all shards, are mapped through pseudorandom
permutations of its block indices; slots and blocks are joined by index.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import forget, materialize, small_side

#: Where the vocabulary files of public tokenizers lie; a parameter of every function that needs one.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK, SLOTS = 128, 64
#: Documents per packing bucket, about. It bounds what one task packs and has no bearing on the result.
BUCKET_DOCS = 2_000
#: Listed sources up to which a list of targets is taken to the driver; a longer one is refused.
MAX_SOURCES = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def permuted(index: np.ndarray, size: int, seed: np.ndarray | int) -> np.ndarray:
    """Images of ``index`` under a pseudorandom permutation of ``range(size)``, one per ``seed``.

    A four-round Feistel network over the next even power of two, walked until it falls inside.
    """
    half = np.uint64(max(1, math.ceil(max(size - 1, 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(index, dtype=np.uint64).copy()
    seed = np.broadcast_to(np.asarray(seed, dtype=np.uint64), out.shape)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for r in range(4):
            left, right = right, left ^ (_mix64(right * np.uint64(4) + np.uint64(r) + _mix64(seed[todo])) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def pack_blocks(documents: DataFrame, *, source: str = "source", doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, block: int = BLOCK, seed: int = 0, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Token blocks per source: source, block_id, n_tokens, doc_ids, tokens.

    A source's documents lie end to end in the order of a hash of id and text (equal rows anywhere
    among themselves), and block k holds the tokens from k * ``block`` on. So every block is full but
    the last of each source, and the result is the same however the input is partitioned. Null or
    empty texts and null sources give no tokens; every other row is packed once, repeated ones too.

    The order is cut into buckets, ranges of the hash, that tasks pack by themselves: a bucket's first
    offset is the sum over the buckets before it. Only the blocks across a border go through a second
    shuffle.
    """
    d = documents.select(F.col(source).alias("source"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("source IS NOT NULL AND text <> ''")
    buckets = max(1, math.ceil(d.count() / bucket_docs))
    place = F.xxhash64("doc_id", "text", F.lit(seed))
    # shifted so that the product stays within 64 bits; monotone in the hash
    d = d.withColumn("place", place).withColumn("bucket", F.shiftright((F.shiftright("place", 32) + F.lit(1 << 31)) * F.lit(buckets), 32))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for b in batches:
            toks = enc.encode_ordinary_batch(list(b["text"]), num_threads=1)
            yield pd.DataFrame({"source": b["source"], "bucket": b["bucket"], "place": b["place"], "doc_id": b["doc_id"], "n": [len(t) for t in toks], "tokens": toks})

    coded = materialize(d.mapInPandas(tokens, "source string, bucket long, place long, doc_id long, n int, tokens array<int>"), "coded")
    past = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = coded.groupBy("source", "bucket").agg(F.sum("n").alias("t"))
    offsets = materialize(sums.select("source", "bucket", F.coalesce(F.sum("t").over(past), F.lit(0)).alias("first")), "offsets")
    ordered = coded.join(small_side(offsets), ["source", "bucket"]).repartition("source", "bucket").sortWithinPartitions("source", "bucket", "place", "doc_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pos, have, parts, ids, out = None, 0, 0, [], [], []

        def cut() -> None:
            nonlocal have, parts, ids
            begin = pos - have
            out.append((at[0], begin // block, begin % block, have, list(dict.fromkeys(ids)), np.concatenate(parts)))
            have, parts, ids = 0, [], []

        for b in batches:
            for s, k, first, doc, toks in zip(b["source"], b["bucket"], b["first"], b["doc_id"], b["tokens"]):
                if at != (s, k):
                    if have:
                        cut()
                    at, pos = (s, k), int(first)
                took = 0
                while took < len(toks):
                    n = min(block - pos % block, len(toks) - took)
                    parts.append(toks[took : took + n])
                    ids.append(doc)
                    took, pos, have = took + n, pos + n, have + n
                    if pos % block == 0:
                        cut()
            if out:
                yield pd.DataFrame(out, columns=["source", "block_id", "begin", "n_tokens", "doc_ids", "tokens"])
                out = []
        if have:
            cut()
        if out:
            yield pd.DataFrame(out, columns=["source", "block_id", "begin", "n_tokens", "doc_ids", "tokens"])

    packed = materialize(ordered.mapInPandas(pack, "source string, block_id long, begin int, n_tokens int, doc_ids array<long>, tokens array<int>"), "packed")
    forget(coded)
    whole = packed.filter(F.col("n_tokens") == block).select("source", "block_id", "n_tokens", "doc_ids", "tokens")
    pieces = packed.filter(F.col("n_tokens") < block).groupBy("source", "block_id").agg(F.sum("n_tokens").cast("int").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("begin", "doc_ids", "tokens"))).alias("p"))
    return whole.unionByName(pieces.select("source", "block_id", "n_tokens", F.array_distinct(F.flatten("p.doc_ids")).alias("doc_ids"), F.flatten("p.tokens").alias("tokens")))


def plan_shares(stock: list[tuple[str, int, int]], targets: list[tuple[str, float, int]], block: int, seed: int = 0) -> dict[str, dict]:
    """Per source: normalised share, stock of blocks, cap and quota of slots.

    ``stock`` has source, blocks and tokens. Shares are of tokens, relative to the sum over targets that
    have stock (the rest cannot be met and is reported with 0). The total is the largest at which no
    source needs more than cap times its tokens. A source's quota is the number of slots whose tokens
    come nearest to its share of the total; its last block is short, and as the permutation of each
    pass is known, so is the slot that gets it.
    """
    have = {s: (n, t) for s, n, t in stock if n > 0 and t > 0}
    live = {s: (share, int(cap)) for s, share, cap in targets if s in have and share and share > 0 and cap and cap > 0}
    norm = sum(share for share, _ in live.values())
    if not live:
        return {}
    total = min(cap * have[s][1] * norm / share for s, (share, cap) in live.items())
    plan = {}
    for i, s in enumerate(sorted(live)):
        (n, t), (share, cap) = have[s], live[s]
        goal = share / norm * total
        done = min(int(goal // t), cap)
        rest, lacking = goal - done * t, n * block - t
        best = (0, 0.0)
        if done < cap and rest > 0:
            # the slot of this pass that the short block comes at
            short = _position(n - 1, n, pass_seed(seed, i, done)) if lacking else n
            tokens = lambda q: q * block - (lacking if q > short else 0)
            near = int(rest // block)
            best = min(((q, abs(tokens(q) - rest)) for q in range(max(0, near - 1), min(n, near + 3) + 1)), key=lambda x: x[1])
        plan[s] = {"share": share / norm, "stock": n, "cap": cap, "quota": done * n + best[0], "number": i}
    return plan


def pass_seed(seed: int, source: int, turn: np.ndarray | int) -> np.ndarray:
    """Seed of the permutation of a source's blocks in one pass over them."""
    with np.errstate(over="ignore"):
        return _mix64(np.uint64(seed) * np.uint64(1_000_003) + np.uint64(source) * np.uint64(4_294_967_291) + np.asarray(turn, dtype=np.uint64))


def _position(image: int, size: int, seed: np.ndarray) -> int:
    """The index that :func:`permuted` maps to ``image``: the network run backwards."""
    half = np.uint64(max(1, math.ceil(max(size - 1, 1).bit_length() / 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.array([image], dtype=np.uint64)
    while True:
        left, right = x >> half, x & mask
        for r in (3, 2, 1, 0):
            left, right = right ^ (_mix64(left * np.uint64(4) + np.uint64(r) + _mix64(seed)) & mask), left
        x = left << half | right
        if x[0] < size:
            return int(x[0])


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Hypergeometric draw; where the counts exceed what numpy takes, its normal limit, rounded.

    Beyond 10^9 items the two differ by far less than one draw in ten thousand.
    """
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    mean = sample * (good / n)
    spread = math.sqrt(max(0.0, mean * (bad / n) * ((n - sample) / (n - 1))))
    return min(max(round(rng.normal(mean, spread)), max(0, sample - bad)), min(sample, good))


def draw_counts(first: int, last: int, size: int, slots: int, quotas: list[int], seed: int) -> list[tuple[int, list[int], list[int]]]:
    """For shards ``first`` to ``last`` - 1: how many of its slots each source gets, and how many earlier ones.

    Multinomial counts conditioned on the totals over all shards being the quotas: the quotas are
    split between halves of the shards by multivariate hypergeometric draws, seeded by the half, down
    to the shard. Any range can be drawn by itself, and all of them add up. All shards have ``slots``
    slots but the last, which has what is left of ``size``.
    """
    out: list[tuple[int, list[int], list[int]]] = []

    def split(lo: int, hi: int, counts: list[int], before: list[int]) -> None:
        if hi <= first or lo >= last or lo >= hi:
            return
        if hi - lo == 1:
            out.append((lo, counts, before))
            return
        mid = (lo + hi) // 2
        rng, want, open_ = np.random.default_rng([seed, lo, hi]), (mid - lo) * slots, sum(counts)
        left = []
        for c in counts:
            open_ -= c
            x = _hypergeometric(rng, c, open_, want) if want and c else 0
            left.append(x)
            want -= x
        split(lo, mid, left, before)
        split(mid, hi, [a - b for a, b in zip(counts, left)], [a + b for a, b in zip(before, left)])

    split(0, -(-size // slots), list(quotas), [0] * len(quotas))
    return out


def mix(blocks: DataFrame, targets: DataFrame, *, block: int = BLOCK, slots: int = SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Draw the mixture: (slots, shares).

    ``blocks`` as of :func:`pack_blocks`, written once by the caller; ``targets`` has source,
    target_share, repeat_cap (the smallest row per source counts, null and non-positive ones are
    none). Slots: shard, slot, source, pass, block_id. Pass k of a source uses each block once, in
    the order of its own permutation, and quotas end at cap passes, so no block is used more often.
    The last shard may have fewer slots.

    Shares: source, target_share (normalised), reached_share, blocks_used, tokens_used, max_repeats,
    stock_blocks, one row per listed source. Only per-source totals reach the driver (a list of over
    ``MAX_SOURCES`` sources is refused); the draw, the numbering and the join are distributed over shards.
    """
    spark = blocks.sparkSession
    listed = _listed(targets)
    counts = blocks.groupBy("source").agg(F.count("*").alias("b"), F.sum("n_tokens").alias("t"))
    wanted = spark.createDataFrame([(s,) for s, _, _ in listed], "source string")
    plan = plan_shares([tuple(r) for r in counts.join(F.broadcast(wanted), "source", "left_semi").collect()], listed, block, seed)
    names = sorted(plan)
    quotas = [plan[s]["quota"] for s in names]
    size = sum(quotas)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 256):
                ids = b["id"].iloc[lo : lo + 256]
                parts = []
                for shard, n, before in draw_counts(int(ids.iloc[0]), int(ids.iloc[-1]) + 1, size, slots, quotas, seed):
                    which, slot = np.repeat(np.arange(len(n)), n), np.arange(sum(n))
                    number = slot - np.repeat(np.cumsum(n) - n, n) + np.repeat(before, n)
                    with np.errstate(over="ignore"):
                        at = permuted(slot, len(slot), _mix64(np.uint64(seed) + np.uint64(shard)))
                    parts.append(pd.DataFrame({"shard": shard, "slot": at, "which": which, "number": number}))
                d = pd.concat(parts)
                stock = np.array([plan[s]["stock"] for s in names])[d["which"]]
                d["pass"] = d["number"] // stock
                d["block_id"] = 0
                for i, s in enumerate(names):
                    mine = (d["which"] == i).to_numpy()
                    if mine.any():
                        turn = d["pass"].to_numpy()[mine]
                        d.loc[mine, "block_id"] = permuted(d["number"].to_numpy()[mine] % plan[s]["stock"], plan[s]["stock"], pass_seed(seed, plan[s]["number"], turn))
                d["source"] = np.array(names, dtype=object)[d["which"]]
                yield d[["shard", "slot", "source", "pass", "block_id"]]

    kind = "shard long, slot int, source string, pass int, block_id long"
    drawn = spark.range(-(-size // slots)).mapInPandas(draw, kind) if size else spark.createDataFrame([], kind)
    out = materialize(drawn, "slots")
    used = out.join(blocks.select("source", "block_id", "n_tokens"), ["source", "block_id"]).groupBy("source").agg(F.count("*").alias("blocks_used"), F.sum("n_tokens").alias("tokens_used"), F.max(F.col("pass") + 1).alias("max_repeats"))
    goal = spark.createDataFrame([(s, plan[s]["share"] if s in plan else 0.0, plan[s]["stock"] if s in plan else 0) for s, _, _ in listed], "source string, target_share double, stock_blocks long")
    shares = goal.join(used, "source", "left").fillna(0, ["blocks_used", "tokens_used", "max_repeats"])
    shares = shares.withColumn("reached_share", F.coalesce(F.try_divide(F.col("tokens_used").cast("double"), F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))), F.lit(0.0)))
    return out, shares.select("source", "target_share", "reached_share", "blocks_used", "tokens_used", "max_repeats", "stock_blocks")


def _listed(targets: DataFrame) -> list[tuple[str, float, int]]:
    rows = targets.filter("source IS NOT NULL").groupBy("source").agg(F.min("target_share"), F.min("repeat_cap")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    return sorted((tuple(r) for r in rows), key=lambda r: r[0])


def mixture(documents: DataFrame, targets: DataFrame, *, tokenizer: str = TOKENIZER, block: int = BLOCK, slots: int = SLOTS, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pack, draw and join: (rows, shares). Rows: shard, slot, source, pass, block_id, n_tokens, doc_ids, tokens.

    Only documents of listed sources are packed; unlisted sources have no share.
    """
    listed = documents.sparkSession.createDataFrame([(s,) for s, _, _ in _listed(targets)], "source string")
    docs = documents.join(F.broadcast(listed), "source", "left_semi")
    blocks = materialize(pack_blocks(docs, tokenizer=tokenizer, block=block, seed=seed), "blocks")
    placed, shares = mix(blocks, targets, block=block, slots=slots, seed=seed)
    return placed.join(blocks, ["source", "block_id"]).select("shard", "slot", "source", "pass", "block_id", "n_tokens", "doc_ids", "tokens"), shares
