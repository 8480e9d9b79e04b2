"""Language-model scores of documents (operator 6): a word model by counts and causal self-attention on subword ids."""

from __future__ import annotations

import base64
import functools
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axonlake.llm.attention import CONTEXT, MEMBERS, STEP, Adam, Attention, Scorer
from axonlake.llm.common import held_out, read, small, stash
from axonlake.llm.words import STEP as GOLDEN
from axonlake.llm.words import mixed

#: Ranks file of a public byte-level tokenizer; the folds of which one is held out.
TOKENIZER, FOLDS = "/opt/tokenizers/byte_bpe_50k.tiktoken", 5
#: Ids of the model: the end, the most frequent subwords of all training rows, and one for all other subwords.
TOKENS = 1024
#: Windows on which attention is fitted first, to have a common start: drawn over all training rows by a seed, so many expected in all and as many from each row.
WINDOWS = 32_768
#: From that start, tasks fit it on every place of all training rows: windows in a step, and the rate of the first steps.
FIT_BATCH, FIT_RATE = 256, 0.003
#: Words whose counts are sent to every task: the most frequent, at most so many; the others meet their counts in a join.
COMMON_WORDS = 300_000
#: What absolute discounting takes from each count of a pair.
DISCOUNT = 0.6
#: Bytes of text that a task has in work at a time, about, and windows scored at a time.
CHUNK_BYTES, BATCH = 4_000_000, 512


class Subwords:
    """Subword ids of words."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines())
        ranks_of = {base64.b64decode(a): int(b) for a, b in pairs}
        self.size = max(ranks_of.values()) + 1
        #: pieces are words with a space before each
        self.encoding = tiktoken.Encoding("words", pat_str=" [^ ]*", mergeable_ranks=ranks_of, special_tokens={})
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for word, i in ranks_of.items() if word.startswith(b" ")]] = True

    def of(self, words: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each word) of the words, each taken with a space before it. No word has a space in it."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_binary())
        line = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b" ", pa.large_binary()))[0].as_py()
        try:
            ids = self.encoding.encode_to_numpy(" " + line.decode(), disallowed_special=()).astype(np.int32)
        except UnicodeDecodeError:  # bytes that are no UTF-8: piece by piece
            ids = np.array([i for w in words.to_pylist() for i in self.encoding._encode_single_piece(b" " + w)], np.int32)
        first = np.flatnonzero(self.begins[ids])
        return ids, np.diff(first, append=len(ids))


class Chunk:
    """Some rows of a batch: their distinct words, and each token's row and number among the words."""

    def __init__(self, text: pa.Array, first: int):
        # lower case first: of a slice cast to large strings, Arrow lowers other bytes than those of the slice
        lists = pc.ascii_split_whitespace(pc.ascii_lower(text).cast(pa.large_string()))
        found = lists.flatten().dictionary_encode()
        self.first, self.rows = first, len(text)
        self.words = found.dictionary.cast(pa.large_binary())
        self.code, self.row = found.indices.to_numpy(), np.repeat(np.arange(len(text), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        if len(self.words) and (empty := pc.index(self.words, pa.scalar(b"", pa.large_binary())).as_py()) >= 0:  # before or after the first or last word
            own = self.code != empty
            self.code, self.row = self.code[own], self.row[own]

    def sequence(self, sub: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(raw ids of all rows, an end before each row and after the last one; where each row begins and the last one's end; the row of each place but the last)."""
        ids, n = sub.of(self.words)
        at = np.cumsum(n) - n
        each = n[self.code]
        before = np.cumsum(each) - each
        row = np.repeat(self.row, each)
        total = len(row)
        out = np.full(total + self.rows + 1, sub.size, np.int32)
        out[np.arange(1, total + 1) + row] = ids[np.repeat(at[self.code] - before, each) + np.arange(total)]
        length = np.bincount(row, minlength=self.rows) + 1
        return out, np.append(0, np.cumsum(length)), np.repeat(np.arange(self.rows, dtype=np.int32), length)


def _chunks(batch: pa.RecordBatch, column: str = "text"):
    """The rows of a batch in chunks of about CHUNK_BYTES; null: empty. A text is never cut."""
    text = batch.column(batch.schema.get_field_index(column)).fill_null("")
    part = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK_BYTES
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(text)]
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        if lo < hi:
            yield Chunk(text.slice(lo, hi - lo), lo)


def _coded(batches, shared):
    """The rows with the raw subword ids of each text and its end, packed: texts are cut into subwords once, here."""
    sub = Subwords(shared.value)
    for b in batches:
        for c in _chunks(b):
            raw, start, _ = c.sequence(sub)
            flat = raw[1:].astype(_packed(sub.size))
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), c.rows, [None, pa.py_buffer(start * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*b.slice(c.first, c.rows).columns, ids], names=[*b.schema.names, "ids"])


def _packed(size: int) -> type:
    """The type of packed raw ids, the end (size) among them."""
    return np.uint16 if size < 2**16 else np.int32


def _sequence(ids: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw ids of the rows, an end before each row and after the last one; where each row begins and the last one's end) from packed ids."""
    kind = np.dtype(_packed(size))
    edge = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype(np.int64) // kind.itemsize
    flat = np.frombuffer(ids.buffers()[2], kind, edge[-1])[edge[0] :]
    return np.append(kind.type(size), flat), edge - edge[0]


def _of_rows(batch: pa.RecordBatch):
    """The packed ids of a batch in runs of rows of about CHUNK_BYTES."""
    ids = batch.column(batch.schema.get_field_index("ids"))
    part = np.cumsum(pc.binary_length(ids).to_numpy(zero_copy_only=False), dtype=np.int64) // CHUNK_BYTES
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(ids)]
    return [ids.slice(lo, hi - lo) for lo, hi in zip(edge[:-1], edge[1:], strict=True) if lo < hi]


def drawn(key: np.ndarray, places: np.ndarray, share: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, place at which it begins) of windows, `share` of them expected from each row; a key and the seed decide.

    A window begins anywhere so that it is full; a row with fewer places has one window over all of them.
    """
    unit = lambda k: mixed(key.view(np.uint64) + np.uint64((k + 1) * int(GOLDEN) % 2**64)) / 2.0**64
    rows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(math.ceil(share)):
        own = np.flatnonzero(unit(seed + 2 * k) < share - k)
        rows.append(own)
        starts.append((unit(seed + 2 * k + 1)[own] * (np.maximum(places[own] - CONTEXT, 0) + 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(starts)


def _counts(batches, size: int, share: float):
    """Counts of words and of pairs of subwords of the training rows of a partition, and its drawn windows; sent on in bounded parts."""

    def part(kind: int, n, words=None, codes=None):
        none = lambda t: pa.nulls(len(n), t)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int8)), none(pa.binary()) if words is None else words, none(pa.int64()) if codes is None else codes, pa.array(n)], names=["kind", "word", "code", "n"])

    for b in batches:
        ids, key = b.column(1), b.column(2).to_numpy()
        for c in _chunks(b):
            times = np.bincount(c.code, minlength=len(c.words))
            seen = np.flatnonzero(times)
            yield part(WORD, times[seen], words=c.words.take(pa.array(seen)).cast(pa.binary()))
            packed, start = _sequence(ids.slice(c.first, c.rows), size)
            seq = packed.astype(np.int32)
            pairs = pc.value_counts(pa.array(seq[:-1].astype(np.int64) * (size + 1) + seq[1:]))
            yield part(PAIR, pairs.field("counts").to_numpy(), codes=pairs.field("values"))
            row, at = drawn(key[c.first : c.first + c.rows], np.diff(start), share)
            at += start[row]
            end = np.minimum(at + CONTEXT + 1, start[row + 1] + 1)
            yield part(WINDOW, np.ones(len(row), np.int64), words=pa.array([seq[i:j].tobytes() for i, j in zip(at, end, strict=True)], pa.binary()))


#: Kinds of rows of _counts.
WORD, PAIR, WINDOW = 0, 1, 2


def _classes(follow: np.ndarray) -> np.ndarray:
    """The ids in classes of MEMBERS, one class after another: ids that come after the same ids are halved along their main direction, again and again."""
    share = np.sqrt(follow.T / np.maximum(follow.sum(axis=0)[:, None], 1)).astype(np.float32)
    u, s, _ = np.linalg.svd(share, full_matrices=False)
    x, parts = u[:, :24] * s[:24], [np.arange(len(follow))]
    while len(parts[0]) > MEMBERS:
        halves = []
        for own in parts:
            y = x[own] - x[own].mean(axis=0)
            order = own[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
            halves += [order[: len(own) // 2], order[len(own) // 2 :]]
        parts = halves
    return np.concatenate(parts)


def _smoothed(pairs: np.ndarray) -> np.ndarray:
    """Log-probabilities of an id after each id: absolute discounting, the rest by the number of ids that an id comes after."""
    total, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    after = (pairs > 0).sum(axis=0) + 0.5
    after = after / after.sum()
    return np.log(np.where(total > 0, (np.maximum(pairs - DISCOUNT, 0) + DISCOUNT * kinds * after) / np.maximum(total, 1), after))


def _padded(windows: list[np.ndarray], model_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the ids that come next) of the windows; a short window is padded, with -1 as the next id."""
    x, y = np.zeros((len(windows), CONTEXT), np.int64), np.full((len(windows), CONTEXT), -1, np.int64)
    for k, w in enumerate(windows):
        x[k, : len(w) - 1], y[k, : len(w) - 1] = model_id[w[:-1]], model_id[w[1:]]
    return x, y


def _attention(counts: DataFrame, size: int) -> tuple[Attention, np.ndarray, np.ndarray]:
    """(model, model id of each raw id, log-probability of each raw id among those that share an id) from the counts of pairs and the drawn windows."""
    pairs = counts.where(F.col("kind") == PAIR).select(F.floor(F.col("code") / (size + 1)).alias("a"), (F.col("code") % (size + 1)).alias("b"), "n")
    single = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most the tokenizer's size
    n = np.zeros(size + 1, np.int64)
    n[single["b"].to_numpy()] = single["n"].to_numpy()
    other = TOKENS - 1
    to = np.full(size + 1, other, np.int64)
    to[size] = 0
    common = np.argsort(-n[:size], kind="stable")[: TOKENS - 2]
    to[common] = np.arange(1, len(common) + 1)
    known = pairs.sparkSession.createDataFrame(pa.table({"raw": np.arange(size + 1), "id": to}))
    mapped = pairs.join(small(known.select(F.col("raw").alias("a"), F.col("id").alias("from"))), "a").join(small(known.select(F.col("raw").alias("b"), F.col("id").alias("to"))), "b")
    found = mapped.groupBy("from", "to").agg(F.sum("n").alias("n")).toArrow()  # at most TOKENS squared
    table = np.zeros((TOKENS, TOKENS))
    table[found["from"].to_numpy(), found["to"].to_numpy()] = found["n"].to_numpy()
    order = _classes(table)
    place = np.empty(TOKENS, np.int64)
    place[order] = np.arange(TOKENS)
    rest = np.where(to == other, n, 0)
    rare = np.where(to == other, np.log((rest + 0.5) / (rest.sum() + 0.5 * max(1, int((to == other).sum())))), 0.0)
    got = counts.where(F.col("kind") == WINDOW).select("word", "n").toArrow().sort_by("word")  # WINDOWS of them, about
    windows = [np.frombuffer(w, np.int32) for w, times in zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True) for _ in range(times)]
    return Attention(_smoothed(table[order][:, order])).train(*_padded(windows, place[to])), place[to], rare


def _fitted(batches, shared):
    """Weights of the model after steps over all places of the training rows of a partition, times the number of places; (place among all weights, that product, places)."""
    size, model, model_id = shared.value
    model.w = {k: v.copy() for k, v in model.w.items()}  # the broadcast value may serve other tasks of this worker
    adam, rng, seen, places = Adam(model), np.random.default_rng(0), 0, np.arange(CONTEXT)
    for b in batches:
        for ids in _of_rows(b):
            raw, start = _sequence(ids, size)
            seq, n = model_id.take(raw), -(-np.diff(start) // CONTEXT)
            row = np.repeat(np.arange(len(ids)), n)
            begin = start[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * CONTEXT
            order = rng.permutation(len(row))
            for lo in range(0, len(order), FIT_BATCH):
                own = order[lo : lo + FIT_BATCH]
                at = begin[own, None] + places
                inside = at < start[row[own] + 1][:, None]
                np.minimum(at, len(seq) - 2, out=at)
                adam.step(seq[at], np.where(inside, seq[at + 1], -1), FIT_RATE * len(own) / FIT_BATCH / math.sqrt(1 + adam.t / 200))
                seen += int(inside.sum())
    if seen:
        flat = np.concatenate([model.w[k].reshape(-1) for k in sorted(model.w)]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * seen), pa.array(np.full(len(flat), seen, np.int64))], names=["at", "total", "places"])


def _over_all(train: DataFrame, size: int, model: Attention, model_id: np.ndarray) -> tuple[Attention, int]:
    """(model, places) after one pass over every place of all training rows: each task goes on from the given weights over its rows, and the tasks' weights are averaged by their places."""
    shared = train.sparkSession.sparkContext.broadcast((size, model, model_id))
    moved = train.select("ids").mapInArrow(functools.partial(_fitted, shared=shared), "at int, total double, places long")
    got = moved.groupBy("at").agg(F.sum("total").alias("total"), F.sum("places").alias("places")).toArrow().sort_by("at")  # as many as the model has weights
    if not len(got):
        return model, 0
    flat, lo = got["total"].to_numpy() / got["places"].to_numpy(), 0
    for k in sorted(model.w):
        model.w[k] = flat[lo : lo + model.w[k].size].reshape(model.w[k].shape).astype(np.float32)
        lo += model.w[k].size
    return model, int(got["places"][0].as_py())


def windows(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, places at the start that the window before scored) of overlapping windows over so many places a row: every place is scored once."""
    n = 1 + np.maximum(0, -(-(places - CONTEXT) // STEP))
    row = np.repeat(np.arange(len(places)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k * STEP, np.where(k > 0, CONTEXT - STEP, 0)


def _log_probs(model: Scorer, seq: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Log-probability of each row of a sequence of model ids (see Chunk.sequence), in batches of windows."""
    out, places = np.zeros(len(start) - 1), np.arange(CONTEXT)
    row, begin, first = windows(np.diff(start))
    begin = begin + start[row]
    # what the window before scored is context only; first windows of rows have no such places
    for skip in (0, CONTEXT - STEP):
        of = np.flatnonzero(first == skip)
        for lo in range(0, len(of), BATCH):
            own = of[lo : lo + BATCH]
            at = begin[own, None] + places
            scored = at < start[row[own] + 1][:, None]
            np.minimum(at, len(seq) - 2, out=at)
            got = model.log_prob(seq[at], np.where(scored, seq[at + 1], -1), skip)
            out += np.bincount(row[own], got.sum(axis=1, dtype=np.float64), len(out))
    return out


def _scores(batches, shared):
    """Each row's counts and scores over frequent words, its other words, and the attention model's score."""
    size, model, model_id, rare, common, log_share, end_share = shared.value
    model, part, at_row = Scorer(model), TaskContext.get().partitionId(), 0
    for b in batches:
        for c in _chunks(b):
            n = c.rows
            found = pc.index_in(c.words, value_set=common).fill_null(-1).to_numpy()
            at = found[c.code]
            frequent = at >= 0
            base = np.bincount(c.row[frequent], log_share[at[frequent]], n) + end_share
            tokens, known = np.bincount(c.row, minlength=n) + 1, np.bincount(c.row[frequent], minlength=n) + 1
            other, times = np.unique(c.row[~frequent].astype(np.int64) * max(1, len(c.words)) + c.code[~frequent], return_counts=True)
            ends = np.searchsorted(other, np.arange(n + 1, dtype=np.int64) * max(1, len(c.words)))
            others = c.words.take(pa.array(other % max(1, len(c.words)))).cast(pa.binary())
            seq, start = _sequence(b.column(3).slice(c.first, n), size)
            lm = (_log_probs(model, model_id.take(seq), start) + np.bincount(np.repeat(np.arange(n), np.diff(start)), rare.take(seq[1:]), n)) / math.log(10)
            rid = (np.int64(part) << np.int64(33)) + np.arange(at_row, at_row + n, dtype=np.int64)
            at_row += n
            for lo in range(0, n, 500):
                cut = slice(lo, min(lo + 500, n))
                first, last = ends[cut.start], ends[cut.stop]
                offsets = pa.array(ends[cut.start : cut.stop + 1] - first, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (others.slice(first, last - first), pa.array(times[first:last], pa.int64()))]
                plain = [pa.array(x[cut]) for x in (tokens, known, base, lm)]
                ids = [b.column(k).slice(c.first + lo, cut.stop - lo) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(rid[cut]), *ids, *plain, *lists], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"])


def score_documents(docs: DataFrame, tokenizer: str = TOKENIZER, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text; other columns are left alone, whatever their names).

    Base model: words of all training rows are counted; a row's frequent words are scored from a bounded table that every
    task has, its other words meet their counts in a join. Attention model: the log-probability of the text's subword ids (words
    in lower case, each with a space before it, then the end). Counts of pairs of ids over all training rows say how likely an
    id is after the one before it; attention over up to 32 ids moves these odds, for each id, in overlapping windows that score
    each id once. It is fitted on every place of all training rows, ends and short texts included: from a common start (a fit on WINDOWS
    drawn windows) each task goes once over its rows, and the weights are averaged by places. So the scores depend on how rows lie in partitions, a little.
    Null and empty texts consist of the end alone. Repeated rows are scored alike and each counts; a null doc_id is no
    held-out row. Without training rows both models are uniform or nearly so. Long texts are scored whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", held_out("doc_id", folds).alias("held_out"), "text")
    ranks = Path(tokenizer).read_bytes()
    size = Subwords(ranks).size
    coded = functools.partial(_coded, shared=spark.sparkContext.broadcast(ranks))
    docs = stash(docs.mapInArrow(coded, T.StructType([*docs.schema.fields, T.StructField("ids", T.BinaryType())])), "lm-ids")
    train = docs.where("not held_out")
    rows = train.select("doc_id").count()
    keyed = train.select("text", "ids", F.xxhash64("doc_id").alias("key"))
    parts = keyed.mapInArrow(functools.partial(_counts, size=size, share=WINDOWS / max(rows, 1)), "kind tinyint, word binary, code long, n long")
    counts = stash(parts.groupBy("kind", "word", "code").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where(F.col("kind") == WORD).select("word", "n")
    # words by count, most frequent first, until the table is full: distinct counts are few
    by_count = words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()
    total, distinct = rows + sum(r["n"] * r["words"] for r in by_count), (rows > 0) + sum(r["words"] for r in by_count)
    least, have = None, 0
    for r in by_count:
        have += r["words"]
        if have > COMMON_WORDS:
            break
        least = r["n"]
    norm = math.log10(total + 0.5 * (distinct + 1))
    top = (words.where(F.col("n") >= least) if least is not None else words.limit(0)).toArrow()
    common, log_share = top["word"].combine_chunks().cast(pa.large_binary()), np.log10(top["n"].to_numpy() + 0.5) - norm
    model, model_id, rare = _attention(counts, size)
    model, _ = _over_all(train, size, model, model_id)
    # every text's end is a token, and known if there are training rows
    end_share = math.log10(rows + 0.5) - norm
    shared = spark.sparkContext.broadcast((size, model, model_id, rare, common, log_share, end_share))
    kind = dict(docs.dtypes)["doc_id"]
    scored = stash(docs.mapInArrow(functools.partial(_scores, shared=shared), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<bigint>"), "lm-rows")
    rest = scored.select("rid", F.explode(F.arrays_zip("words", "times")).alias("o")).select("rid", F.col("o.words").alias("word"), F.col("o.times").alias("times"))
    uncommon = words.where(F.col("n") < least) if least is not None else words
    met = rest.join(uncommon, "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = met.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * (F.log10(c + 0.5) - norm)).alias("more"))
    out = scored.drop("words", "times").join(stash(sums, "lm-others"), "rid", "left")
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) - F.lit(0 if rows else 1)
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")


def op6_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by models of four fifths of them."""
    return score_documents(read(spark, sf_dir, "documents"))
