"""Packing of tokenised documents into sequences by best-two-fit (operator 13)."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.common import read, small, stash

#: Tokens a sequence holds, the id that ends a document, and the vocabulary (a name for public_tokenizers.path).
CAPACITY, END, VOCABULARY = 2048, 0, "byte_bpe_50k"
#: Ranks of one length stay below 2 to this power.
RANK_BITS = 44
PIECE = "piece int, start long, length long, ids_crc32 long"


@functools.cache
def encoder(vocabulary: str):
    """A function from a text to its ids (uint32), as tokenizers' encode(text, add_special_tokens=False) gives them for <vocabulary>.json.

    The rank file of the same vocabulary is used, which takes a fifth of the time; its ids are the same, the special token's included.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    coded = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return lambda text: np.asarray(coded.encode_to_numpy(text, allowed_special="all"), np.uint32)


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all have `capacity` tokens but for the first, which takes what is over."""
    first = (tokens - 1) % capacity + 1
    return [(0, first), *((at, capacity) for at in range(first, tokens, capacity))]


def _pieces(batches, vocabulary: str, capacity: int, ids: bool):
    """Pieces of each text, with the partition and the piece's number among those of its length in the partition."""
    encode, seen, part = encoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for b in batches:
        texts, of, rows, tokens = b.column(b.num_columns - 1).fill_null("").to_pylist(), [], [], []
        for i, text in enumerate(texts):
            all_ids = np.append(encode(text), np.uint32(END)).astype("<u4")
            for k, (start, length) in enumerate(cuts(len(all_ids), capacity)):
                own = all_ids[start : start + length]
                of.append(i), rows.append((k, start, length, zlib.crc32(own.tobytes()), part, int(seen[length])))
                seen[length] += 1
                if ids:
                    tokens.append(own)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        made = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)]
        kept = b.take(pa.array(of, pa.int64())).columns[:-1]
        if ids:
            made.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate(tokens) if tokens else [], pa.int32())))
        yield pa.RecordBatch.from_arrays([*kept, *made], names=[*b.schema.names[:-1], "piece", "start", "length", "ids_crc32", "__part", "__place", *["ids"] * ids])


def pieces(docs: DataFrame, keys: list[str], text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` tokens: keys, piece, start, length, ids_crc32 and, if asked for, the ids; written once.

    A null or empty text is the end id alone. Rows with one key are documents of their own. Other columns of docs are not read.
    """
    fields = [docs.schema[k] for k in keys] + [*T.StructType.fromDDL(f"{PIECE}, __part int, __place long"), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])]
    run = functools.partial(_pieces, vocabulary=vocabulary, capacity=capacity, ids=ids)
    return stash(docs.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, T.StructType(fields)), "pieces")


def best_two_fit(counts: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over counts[length] documents of each length; the capacity is the last index. (how many sequences, length -> documents in each), in order.

    A sequence takes the longest document that fits, again and again. Then its smallest document gives way to two that are left and
    together fill its place and the gap more tightly, the tightest such pair. As long as the stock lasts, the next sequence
    would be filled in the same way, so equal ones are made at once: there are as many steps as lengths run out, whatever the counts.
    """
    capacity, left, out = len(counts) - 1, counts.astype(np.int64).copy(), []
    index = np.arange(capacity + 1)
    while left.any():
        below = np.maximum.accumulate(np.where(left > 0, index, 0))  # the longest in stock up to each length
        used, gap, size = {}, capacity, int(below[capacity])
        while size:
            used[size] = min(int(left[size]), gap // size)
            gap -= used[size] * size
            size = int(below[min(gap, size - 1)])
        need, last = dict(used), min(used)
        if gap and last - gap > 1:  # all that would fit the gap is used up, so both of a pair are longer than it and shorter than the last
            one = index[gap + 1 : last][left[gap + 1 : last] > 0]
            two = below[np.minimum(one, gap + last - one)]
            two = np.where((two == one) & (left[one] < 2), below[one - 1], two)
            both = np.where(two > 0, one + two, 0)
            if len(both) and both.max() > last:
                at = int(np.flatnonzero(both == both.max())[-1])
                used[last] -= 1
                for x in (int(one[at]), int(two[at])):
                    used[x] = need[x] = used.get(x, 0) + 1
        used = {s: n for s, n in used.items() if n}
        times = min((int(left[s]) - need[s]) // n for s, n in used.items()) + 1
        for s, n in used.items():
            left[s] -= n * times
        out.append((times, used))
    return out


def slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """The plan by length and rank: from `rank` on, `many` documents of the length lie in each of consecutive sequences beginning with `first`, at `offset` and on."""
    rows, taken, first = [], {}, 0
    for times, used in plan:
        offset = 0
        for size, many in sorted(used.items(), reverse=True):
            rows.append((size, taken.get(size, 0), many, first, offset))
            taken[size] = taken.get(size, 0) + many * times
            offset += size * many
        first += times
    rows = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {"key": (rows[:, 0] << RANK_BITS) + rows[:, 1], "rank": rows[:, 1], "many": rows[:, 2], "first": rows[:, 3], "offset": rows[:, 4]}


def _placed(batches, shared):
    plan = shared.value
    for b in batches:
        length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
        at = np.searchsorted(plan["key"], (length << RANK_BITS) + rank, "right") - 1
        among = rank - plan["rank"][at]
        sequence, offset = plan["first"][at] + among // plan["many"][at], plan["offset"][at] + among % plan["many"][at] * length
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence), pa.array(offset)], names=[*b.schema.names, "sequence_id", "offset"])


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (as `pieces` gives them) with `sequence_id` and `offset`, the place in the sequence, which has no gaps.

    The plan needs only how many pieces of each length there are, at most `capacity` numbers, and has a bounded number of steps. A piece
    finds its place by its rank among those of its length: its number in its partition and the counts of the partitions before, so
    nothing is sorted, a length that most pieces have is spread like any other, and each piece is read once. No pieces give no rows.
    """
    spark = found.sparkSession
    each = stash(found.groupBy("__part", "length").agg(F.count("*").alias("__n")), "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("__n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = each.select("__part", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    ranked = found.join(small(offsets), ["__part", "length"]).select(*found.columns, (F.col("__from") + F.col("__place")).alias("__rank"))
    schema = T.StructType([*ranked.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long")])
    run = functools.partial(_placed, shared=spark.sparkContext.broadcast(slots(best_two_fit(counts))))
    return ranked.mapInArrow(run, schema).drop("__part", "__place", "__rank")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of placed pieces that carry their ids; a sequence has at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def fullness(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, the least number that the tokens would need, and the share of places filled."""
    total = placed.agg(F.countDistinct("sequence_id").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"))
    return total.select("sequences", F.ceil(F.col("tokens") / capacity).alias("least"), F.try_divide("tokens", F.col("sequences") * capacity).alias("filled"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    found = pieces(read(spark, sf_dir, "documents"), ["doc_id"])
    return packed(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
