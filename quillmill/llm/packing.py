"""Problem 6: fill containers of a fixed capacity with whole documents.

Sizes are tokens of a public tokenizer. Shortest-pack-first over the length histogram: per card the
lengths are placed longest first, each into the shortest open packs (those with the most room) that it
fits, counting patterns and not documents; then every document takes, by its rank among those of its
card, length and salt, a slot of a pattern.
"""

from __future__ import annotations

import base64
import bisect
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.session import broadcast_if_small, materialize

#: Vocabulary file of a public tokenizer (a rank per line) and, a fixed value, the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one card and length that are ranked in one group; more are split into salts.
SALT_ROWS = 50_000


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = VOCABULARY):
    """A column function: number of tokens of a text, 0 for null and empty ones."""

    @F.pandas_udf(T.LongType())
    def count(text: pd.Series) -> pd.Series:
        encode = encoder(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in text], dtype="int64")

    return count


def pack_histogram(lengths: list[tuple[int, int]], capacity: int, shortest: bool = True) -> list[tuple[int, dict[int, int]]]:
    """Patterns (count, {length: times}) that hold all items of a histogram [(length, count)].

    Longest first; each length goes into the shortest open packs, those with the most room, as long as
    it fits there, else into new packs. With `shortest` off the packs with the least room that fits
    are taken instead (best fit), for comparison.
    """
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left -> [(count, {length: times}), ...]
    rooms: list[int] = []  # sorted rooms that have packs
    done: list[tuple[int, dict[int, int]]] = []

    def add(room: int, count: int, pattern: dict[int, int]) -> None:
        if room == 0:
            done.append((count, pattern))
        elif room in open_:
            open_[room].append((count, pattern))
        else:
            open_[room] = [(count, pattern)]
            bisect.insort(rooms, room)

    for length, left in sorted(lengths, reverse=True):
        while left > 0:
            i = len(rooms) - 1 if shortest else bisect.bisect_left(rooms, length)
            if not rooms or i == len(rooms) or rooms[i] < length:
                # no open pack fits: a new one is the shortest until it is full, so it is filled with this length alone
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    add(capacity - per * length, full, {length: per})
                if rest:
                    add(capacity - rest * length, 1, {length: rest})
                break
            room = rooms[i]
            count, pattern = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(count, left)
            if used < count:
                add(room, count - used, pattern)
            left -= used
            add(room - length, used, {**pattern, length: pattern.get(length, 0) + 1})
    return done + [(c, p) for packs in open_.values() for c, p in packs]


_SLOTS = T.StructType([T.StructField(n, T.LongType()) for n in ("card_id", "n_tokens", "salt", "place", "base", "shift", "period")])


def pack_slots(histogram: pd.DataFrame) -> pd.DataFrame:
    """Slots of one card from its counts per length and salt: from `place` on, the documents of a length and salt
    take, in order, the containers base + (shift + k) % period for k = 0, 1, ..."""
    card, capacity = int(histogram["card_id"].iloc[0]), int(histogram["capacity"].iloc[0])
    lengths = histogram.groupby("n_tokens")["n"].sum()
    patterns = pack_histogram([(int(k), int(n)) for k, n in lengths.items() if k > 0], capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {0: [(0, int(lengths.get(0, 0)), 0, 1)]}  # empty texts need no room
    container = 0
    for count, pattern in sorted(patterns, key=lambda p: (-max(p[1]), sorted(p[1].items()), p[0])):
        for length, times in pattern.items():
            own = runs.setdefault(length, [])
            first = own[-1][1] if own else 0
            own.append((first, first + count * times, container, count))
        container += count
    rows = []
    for length, of_length in histogram.sort_values("salt").groupby("n_tokens"):
        before, k, own = 0, 0, runs[int(length)]
        for salt, n in zip(of_length["salt"].tolist(), of_length["n"].tolist()):
            while k < len(own) and own[k][0] < before + n:
                first, end, base, period = own[k]
                rows.append((card, int(length), salt, max(first - before, 0), base, max(before - first, 0) % period, period))
                if end > before + n:
                    break  # goes on in the next salt
                k += 1
            before += n
    return pd.DataFrame(rows, columns=_SLOTS.names)


def pack_documents(documents: DataFrame, cards: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, part_no, card_id, token_start, n_tokens, container_no): a container for every document.

    A document over its card's `pack_capacity` is cut into full parts and a rest; all others are one
    part (0). Null and empty texts have 0 tokens and go to container 0. Documents of unknown cards or
    cards without a usable capacity (null or below 1) keep container_no null and are not cut. Repeated
    rows are packed once per row. Container numbers start at 0 within each card. The lengths of a card
    are at most its capacity, so a histogram has at most cards x capacities rows; a length in very many
    documents is split into salts of about SALT_ROWS documents.
    """
    caps = cards.groupBy(F.col("card_id").alias("_card")).agg(F.min("pack_capacity").cast("bigint").alias("capacity"))
    sized = documents.select("doc_id", "card_id", token_counter(vocabulary)(F.col("text")).alias("total"))
    with_cap = sized.join(broadcast_if_small(caps), F.col("card_id") == F.col("_card"), "left").drop("_card").withColumn("capacity", F.when(F.col("capacity") >= 1, F.col("capacity")))
    last = F.when(F.col("total") > F.col("capacity"), F.floor((F.col("total") - 1) / F.col("capacity"))).otherwise(0).cast("bigint")
    parts = with_cap.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("part_no") * F.coalesce("capacity", F.lit(0))
    items = materialize(parts.select("doc_id", F.col("card_id").cast("bigint").alias("card_id"), "capacity", "part_no", start.alias("token_start"), F.least(F.col("total") - start, F.coalesce("capacity", "total")).alias("n_tokens")), "sizes")
    packed = items.filter(F.col("capacity").isNotNull())
    lengths = packed.groupBy(F.col("card_id").alias("_c"), F.col("n_tokens").alias("_l")).agg(F.ceil(F.count("*") / SALT_ROWS).alias("_salts"))
    salted = packed.join(broadcast_if_small(materialize(lengths, "lengths")), (F.col("card_id") == F.col("_c")) & (F.col("n_tokens") == F.col("_l"))).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.col("_salts"))).drop("_c", "_l", "_salts")
    counts = salted.groupBy("card_id", "capacity", "n_tokens", "salt").agg(F.count("*").alias("n"))
    slots = counts.groupBy("card_id").applyInPandas(pack_slots, _SLOTS)
    key = ["card_id", "n_tokens", "salt"]
    ranked = salted.drop("capacity").withColumn("place", (F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "part_no", "token_start")) - 1).cast("bigint"))
    # the slots come just before the documents that take them, so that each document finds the last one above it
    row = ranked.withColumn("slot", F.lit(None).cast("struct<place:bigint,base:bigint,shift:bigint,period:bigint>"))
    mark = slots.select(*key, "place", F.struct("place", "base", "shift", "period").alias("slot"))
    above = Window.partitionBy(*key).orderBy("place", F.col("slot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = row.unionByName(mark, allowMissingColumns=True).withColumn("_own", F.col("slot").isNull()).withColumn("slot", F.last("slot", True).over(above)).filter("_own")
    container = F.col("slot.base") + F.pmod(F.col("slot.shift") + F.col("place") - F.col("slot.place"), F.col("slot.period"))
    out = placed.select("doc_id", "part_no", "card_id", "token_start", "n_tokens", container.alias("container_no"))
    rest = items.filter(F.col("capacity").isNull()).select("doc_id", "part_no", "card_id", "token_start", "n_tokens", F.lit(None).cast("bigint").alias("container_no"))
    return out.unionByName(rest)


def packing_report(documents: DataFrame, cards: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per card: parts, containers, tokens, capacity, share of the room used, fullest container, containers over capacity."""
    packed = pack_documents(documents, cards, vocabulary).filter("container_no is not null")
    per = packed.groupBy("card_id", "container_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    caps = cards.groupBy(F.col("card_id").alias("_card")).agg(F.min("pack_capacity").cast("bigint").alias("capacity"))
    return (
        per.join(broadcast_if_small(caps), F.col("card_id") == F.col("_card"))
        .groupBy("card_id", "capacity")
        .agg(F.sum("items").alias("n_parts"), F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.sum((F.col("used") > F.col("capacity")).cast("bigint")).alias("n_over"))
        .withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 4))
    )
