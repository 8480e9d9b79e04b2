"""Benchmark decontamination by template windows (operator 1), in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axonlake.llm.common import read, small, stash

#: Words in a window, and how many of them must be literal for a window to match as a template.
WINDOW, LITERALS = 8, 4
#: Share of an item's windows that a document must have, and share of its slots that must be filled consistently.
COVERAGE, CONSISTENCY = 0.4, 0.8
#: Units that make a placeholder when they follow a number.
UNITS = ["mm", "cm", "m", "km", "g", "kg", "mg", "ml", "l", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "miles", "feet", "inches", "pounds", "dollars", "euros", "percent", "usd", "eur", "kb", "mb", "gb", "hz", "khz", "v", "w", "kw", "a"]
#: Letters that can go on a capitalised word, and those that begin one.
LOWER, UPPER = "a-zà-öø-ÿ", "A-ZÀ-ÖØ-Þ"
#: A fill: what stood where a placeholder is, right after it, between two marks.
FILL = "\u0001([^\u0002]*)\u0002"
#: The typed placeholders, each followed by its fill; # stands for a number, ~ for a unit, ^ for names.
_STEPS = [
    # groups repeat possessively: nothing follows them that could ask one back, and a plain repeat takes stack for each name of a run, until a task dies of it
    # names: capitalised words in the middle of a sentence, a run of them as one
    (f"[{UPPER}](?<=[{LOWER}],? .)[{LOWER}]+( [{UPPER}][{LOWER}]+)*+", "^\u0001$0\u0002"),
    ("[0-9]+([.,][0-9]+)*+", "#\u0001$0\u0002"),
    (f"(?<=[0-9]\u0002) ?({'|'.join(UNITS)})\\b", " ~\u0001$1\u0002"),
    # everything else but letters, digits, placeholders and fills goes
    ("(\u0001[^\u0002]*\u0002)|[^\\p{L}\\p{N}#~^ \t\n\r]+", "$1"),
]


def _marked(text: Column) -> Column:
    """The text in lower case with numbers, units and names as placeholders with their fills; null: empty. The text's own # ~ ^ are taken out before."""
    out = F.translate(F.coalesce(text, F.lit("")), "#~^\u0001\u0002\u0003", "")
    for pattern, put in _STEPS:
        out = F.regexp_replace(out, pattern, put)
    return F.lower(out)


def _split(marked: Column) -> Column:
    return F.filter(F.split(marked, "[ \t\n\r]+"), lambda w: w != "")


def _bare(marked: Column) -> Column:
    """Words of a marked text without the fills."""
    return _split(F.regexp_replace(marked, FILL, ""))


def _filled(marked: Column) -> Column:
    """Words of a marked text with the fills, at the same places as in _bare: a space in a fill (a run of names) is no end of a word."""
    return _split(F.regexp_replace(marked, "(\u0001[^ \u0002]*|\\G(?!\\A)[^ \u0002]+) ", "$1\u0003"))


def template(text: Column) -> Column:
    """Words of the text in lower case, with numbers, units and names replaced by typed placeholders."""
    return _bare(_marked(text))


def slots(text: Column) -> Column:
    """What stands in the placeholders of each word of the template, in order: a list for each word, most of them empty."""
    return F.transform(_filled(_marked(text)), lambda w: F.regexp_extract_all(w, F.lit(FILL), F.lit(1)))


def _shaped(df: DataFrame, key: str, lengths: list[int], literals: int) -> DataFrame:
    """df (key, text) as key and, for each n of lengths, p<n>, q<n> and c<n>: for each run of n words (by its start) its hash as a template, its hash
    with the fills and its number of literal words. All are built up from halves in a few passes over the words; the hashes with
    fills only for texts in which some run has fewer literal words than asked."""
    # a column of its own for each step: computed once a row, not once a window
    df = df.select(key, _marked(F.col("text")).alias("marked")).select(key, "marked", _bare(F.col("marked")).alias("words"))
    df = df.select(key, "marked", F.size("words").alias("size"), F.transform("words", lambda w: F.xxhash64(w)).alias("p1"), F.transform("words", lambda w: F.when(w.isin("#", "~", "^"), 0).otherwise(1)).alias("c1"))
    df = _runs(_runs(df, "p", lengths, lambda a, b: F.xxhash64(a, b)), "c", lengths, lambda a, b: a + b)
    low = F.lit(False)
    for n in lengths:
        low = low | F.coalesce(F.array_min(f"c{n}") < min(literals, n), F.lit(False))  # null where no run begins
    df = df.withColumn("q1", F.when(low, F.transform(_filled(F.col("marked")), lambda w: F.xxhash64(w)))).drop("marked")
    return _runs(df, "q", lengths, lambda a, b: F.xxhash64(a, b))


def _runs(df: DataFrame, name: str, lengths: list[int], put: Callable[[Column, Column], Column]) -> DataFrame:
    """df with <name><n> for each n of lengths: what `put` makes of each run of n elements of <name>1, of its two parts at a time. Places at the end where no run begins hold anything."""
    later = lambda c, by: F.slice(c, by + 1, 1 << 30)
    powers = [1 << k for k in range(1, max(lengths).bit_length())]
    for n in [*powers, *(n for n in lengths if n not in powers and n > 1)]:
        whole = 1 << (n.bit_length() - 1)
        if n == whole:
            df = df.withColumn(f"{name}{n}", F.zip_with(f"{name}{n // 2}", later(f"{name}{n // 2}", n // 2), put))
        else:
            out, at = F.col(f"{name}{whole}"), whole
            for k in reversed(range(whole.bit_length() - 1)):
                if n >> k & 1:
                    out, at = F.zip_with(out, later(f"{name}{1 << k}", at), put), at + (1 << k)
            df = df.withColumn(f"{name}{n}", out)
    return df


def _windows(lengths: list[int], literals: int) -> Column:
    """(start, hash, loose) of each run of so many words of a shaped row; the hash knows the length. A run with enough literal words is `loose`: hashed as a template, others with their fills."""
    loose = lambda i, n: F.get(f"c{n}", i - 1) >= min(literals, n)
    of = lambda n: F.transform(
        F.when(F.col("size") >= n, F.sequence(F.lit(1), F.col("size") - (n - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(i.cast("int").alias("start"), F.xxhash64(F.lit(n), F.when(loose(i, n), F.get(f"p{n}", i - 1)).otherwise(F.get(f"q{n}", i - 1))).alias("h"), loose(i, n).alias("loose")),
    )
    return F.concat(*map(of, lengths))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(doc_id, item_id, windows, matched, slots, consistent, exact) for each document that has a benchmark item or a re-parameterised copy.

    Both sides become templates; the windows of the documents meet those of the benchmark by hash, in one pass that
    shuffles only matches (the benchmark's windows are broadcast if a count says that they are few). An item shorter
    than a window is matched as a whole. Windows with fewer literal words than `literals` (short items: all their words, if fewer)
    would match anything as templates; they match with the values in their slots only, so word for word. A document leaks an item
    if it has `coverage` of its windows, or of those with enough literal words, and of its slots (placeholders in matched windows)
    at least `consistency` are filled one-to-one: the same value in the item is the same value in the document. Each place where
    the item's windows match is judged on its own if it reaches the coverage (else the longest), and the best one counts.
    `exact` says that all slots have the item's own values.
    Null or empty texts match nothing. Rows with the same doc_id count as one
    document, null as one id. Very long documents are taken whole. An empty table on either side gives no rows.
    """
    docs, items = docs.select("doc_id", "text"), benchmark.select("item_id", "text").where("text is not null")
    sizes = items.select("item_id", F.size(template(F.col("text"))).alias("n")).where("n > 0")
    short = [r[0] for r in sizes.select("n").where(f"n < {window}").distinct().collect()]  # at most window - 1 lengths
    lengths = [window, *short]
    known = _shaped(items, "item_id", lengths, literals)
    each = lambda n, at: known.where(at).select("item_id", F.explode(_windows([n], literals)).alias("w")).select("item_id", F.col("w.start").alias("item_start"), "w.h", "w.loose")
    index = each(window, f"size >= {window}")
    for n in short:
        index = index.unionByName(each(n, f"size = {n}"))
    index = stash(index, "benchmark-windows")
    counts = index.groupBy("item_id").agg(F.count("*").alias("windows"), F.count_if("loose").alias("loose_windows"))
    found = _shaped(docs, "doc_id", lengths, literals).select("doc_id", F.explode(_windows(lengths, literals)).alias("w")).select("doc_id", F.col("w.start").alias("doc_start"), "w.h")
    hits = stash(found.join(small(index), "h").select("doc_id", "item_id", "doc_start", "item_start", "loose"), "benchmark-hits")
    reached = lambda all_of, loose: (all_of >= F.col("windows") * coverage) | ((F.col("loose_windows") > 0) & (loose >= F.col("loose_windows") * coverage))
    matched = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("item_start").alias("matched"), F.countDistinct(F.when(F.col("loose"), F.col("item_start"))).alias("loose_matched"))
    enough = matched.join(small(counts), "item_id").where(reached(F.col("matched"), F.col("loose_matched")))
    enough = stash(enough, "benchmark-enough")
    # slots of the few that are left: words and fills come from one tokenisation
    wanted = enough.select("doc_id").distinct()
    text_of = docs.join(small(wanted.select(F.col("doc_id").alias("wanted"))), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    shape = lambda df, key, p: df.select(key, template(F.col("text")).alias(f"{p}_words"), slots(F.col("text")).alias(f"{p}_fill"))
    doc_shape, item_shape = shape(text_of, "doc_id", "doc"), shape(items, "item_id", "item")
    kept = hits.join(enough.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"), "windows", "loose_windows"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("i"))).drop("d", "i")
    # a run of matched windows is one alignment: document words = item words + shift; all that reach the coverage are judged, and the longest
    loose = F.collect_set(F.when(F.col("loose"), F.col("item_start")))
    runs = kept.groupBy("doc_id", "item_id", "windows", "loose_windows", (F.col("doc_start") - F.col("item_start")).alias("shift")).agg(F.sort_array(F.collect_set("item_start")).alias("starts"), F.size(loose).alias("loose"))
    pair = Window.partitionBy("doc_id", "item_id")
    runs = runs.withColumns({"longest": F.max(F.size("starts")).over(pair), "loosest": F.max("loose").over(pair)})
    runs = runs.where(reached(F.size("starts"), F.col("loose")) | (F.size("starts") == F.col("longest")) | ((F.col("loose") > 0) & (F.col("loose") == F.col("loosest"))))
    runs = runs.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("shift", "starts")).alias("runs"))
    at = runs.join(item_shape, "item_id").join(doc_shape.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).drop("d")
    covered = lambda r: F.array_distinct(F.flatten(F.transform(r["starts"], lambda s: F.sequence(s, F.least(s + (window - 1), F.size("item_words"))))))
    beside = lambda i, r, of: F.get(F.col(of), (i + r["shift"] - 1).cast("int"))
    fits = lambda ps, p: ~F.exists(ps, lambda q: ((q["item"] == p["item"]) & (q["doc"] != p["doc"])) | ((q["item"] != p["item"]) & (q["doc"] == p["doc"])))

    def judge(r: Column) -> Column:
        """The run's (share, exact, slots, consistent); null if this row of the document does not have the run's words."""
        pairs = F.flatten(F.transform(covered(r), lambda i: F.arrays_zip(F.get(F.col("item_fill"), i - 1).alias("item"), beside(i, r, "doc_fill").alias("doc"))))
        same = F.forall(covered(r), lambda i: F.coalesce(F.get(F.col("item_words"), i - 1) == beside(i, r, "doc_words"), F.lit(False)))
        n = lambda ps: F.size(F.filter(ps, lambda p: fits(ps, p)))
        # an array of one element gives the pairs a name, so that they are made once
        of = lambda ps: F.struct(F.when(F.size(ps) > 0, n(ps) / F.size(ps)).otherwise(1.0).alias("share"), F.forall(ps, lambda p: p["item"] == p["doc"]).alias("exact"), F.size(ps).cast("long").alias("slots"), n(ps).cast("long").alias("consistent"))
        return F.when(same, F.get(F.transform(F.array(pairs), of), F.lit(0)))

    judged = at.select("doc_id", "item_id", F.array_max(F.transform("runs", judge)).alias("best")).where("best is not null")
    # the best-consistent run counts, of all rows of a document
    judged = judged.groupBy(F.col("doc_id").alias("d"), F.col("item_id").alias("i")).agg(F.max("best").alias("best"))
    out = enough.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("i"))).select("doc_id", "item_id", "windows", "matched", "best.slots", "best.consistent", "best.exact")
    return out.where(F.col("consistent") >= F.col("slots") * consistency)


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a benchmark item, as it stands or re-parameterised."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
