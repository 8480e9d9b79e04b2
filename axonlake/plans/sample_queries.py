"""Splits, samples, pairs, text sets and array functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonlake.functions import arrays, basic
from axonlake.operators import containment, sampling
from axonlake.operators.graph import shuffled_column
from axonlake.plans.registry import query, six, table

#: A pair of samples of one event: the turns of two conversations that began alike.
P = "s AS (SELECT conv_id // 2 AS event_id, conv_id % 7 AS entity_id, role AS modality, turn AS ts, conv_id * 100 + turn AS sample_id FROM conversations)"


def _pairs(spark, d):
    c = table(spark, d, "conversations")
    return c.select(F.expr("conv_id div 2").alias("event_id"), (F.col("conv_id") % 7).alias("entity_id"), F.col("role").alias("modality"), F.col("turn").alias("ts"), (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"))


@query(f"WITH {P} SELECT a.event_id, a.ts, a.sample_id AS left_id, b.sample_id AS right_id FROM s a JOIN s b ON a.event_id = b.event_id AND a.ts = b.ts WHERE a.modality = 'user' AND b.modality = 'assistant'")
def pair_sync(spark, d):
    return sampling.pairs_same_event(_pairs(spark, d), "user", "assistant")


@query(f"WITH {P}, t AS (SELECT event_id AS entity_id, ts AS event_id, sample_id FROM s) SELECT a.entity_id, a.sample_id AS left_id, b.sample_id AS right_id FROM t a JOIN t b ON a.entity_id = b.entity_id AND a.event_id <> b.event_id AND a.sample_id < b.sample_id")
def pair_async(spark, d):
    s = _pairs(spark, d).select(F.col("event_id").alias("entity_id"), F.col("ts").alias("event_id"), "sample_id")
    return sampling.pairs_other_event(s)


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) <> '' AND trim(d.text) <> '' AND (contains(trim(d.text), trim(b.text)) OR contains(trim(b.text), trim(d.text))))")
def text_overlap_antijoin(spark, d):
    return containment.without_overlap(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def hash_antijoin(spark, d):
    docs = table(spark, d, "documents")
    return sampling.without_hashes(docs, docs.where("doc_id % 10 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))).select("doc_id")


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY ('0x' || substr(md5('5:' || source), 1, 15))::BIGINT, source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, CASE WHEN k < greatest(1, least(n - 1, floor(0.25 * n + 0.5))) THEN 'validation' ELSE 'train' END AS split FROM documents JOIN g USING (source)""")
def split_by_source(spark, d):
    return sampling.split_by(table(spark, d, "documents"), "source", 0.25, 5).select("doc_id", "split")


@query(None)
def group_safe_split(spark, d):
    """Every three conversations have a speaker, every four a session; no group that they connect is on both sides; tests check the sides."""
    from axonlake.sources.shared import stash

    c = table(spark, d, "conversations").select("conv_id", "turn", F.expr("conv_id div 3").alias("speaker"), F.expr("conv_id div 4").alias("session"))
    return sampling.group_safe_split(c, ("speaker", "session"), 0.3, lambda df: stash(df, "split"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('1:' || doc_id), doc_id) AS round FROM documents) SELECT doc_id, source, CAST(round AS INT) AS round FROM (SELECT * FROM r ORDER BY round, source LIMIT 70)""")
def balanced_sample(spark, d):
    return sampling.balanced_sample(table(spark, d, "documents").select("doc_id", "source"), "source", 70, ["doc_id"], 1)


@query("SELECT doc_id FROM documents ORDER BY md5('2:' || doc_id), doc_id LIMIT 50")
def uniform_sample(spark, d):
    return sampling.uniform_sample(table(spark, d, "documents").select("doc_id"), 50, ["doc_id"], 2)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 100")
def fifo_eviction(spark, d):
    return sampling.fifo(table(spark, d, "events").select("event_id"), 100, "event_id")


@query("WITH n AS (SELECT count(*) AS n, ceil(sqrt(count(*))) AS b FROM orders), r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey, CAST(floor(k * b / n) AS INT) AS bucket FROM r, n")
def time_buckets(spark, d):
    return sampling.time_buckets(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), m AS (SELECT o_totalprice AS shuffled, row_number() OVER (ORDER BY ('0x' || substr(md5('3:' || p), 1, 15))::BIGINT, p) - 1 AS p FROM r) SELECT o_orderkey, shuffled AS o_totalprice FROM r JOIN m USING (p)""")
def shuffled_weights(spark, d):
    return shuffled_column(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 3)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders), a AS (SELECT *, p // 16 AS b, row_number() OVER (PARTITION BY p // 16 ORDER BY p) AS k FROM r), n AS (SELECT p // 16 AS b, row_number() OVER (PARTITION BY p // 16 ORDER BY md5('4:' || p), p) AS k, o_totalprice AS new FROM r) SELECT o_orderkey, new AS o_totalprice FROM a JOIN n USING (b, k)""")
def block_permutation(spark, d):
    return sampling.block_permutation(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 16, 4)


@query("WITH n AS (SELECT doc_id, octet_length(encode(text)) + 2 AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, (n - 1) // 128 + 1)) AS w FROM n) SELECT doc_id, CAST(w AS INT) AS \"window\", CAST(least(128, n - w * 128) AS BIGINT) AS n_tokens, CAST(least(128, n - w * 128) - 1 AS BIGINT) AS n_scored FROM w")
def token_windows(spark, d):
    return sampling.token_windows(table(spark, d, "documents"), 128)


@query("WITH s AS (SELECT source, octet_length(encode(text)) AS tokens, n_chars * 0.7 AS nll FROM documents) SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(nll) / sum(tokens), 6) AS mean_nll, round(exp(sum(nll) / sum(tokens)), 6) AS perplexity FROM s GROUP BY 1")
def perplexity(spark, d):
    s = table(spark, d, "documents").select("source", F.octet_length("text").cast("long").alias("tokens"), (F.col("n_chars") * 0.7).alias("nll"))
    return sampling.perplexity(s, ["source"]).select("source", "tokens", six("mean_nll").alias("mean_nll"), six("perplexity").alias("perplexity"))


@query("""WITH u AS (SELECT coalesce(string_agg(DISTINCT c, '' ORDER BY c), '') AS beyond FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE unicode(c) > 127), a AS (SELECT string_agg(chr(CAST(k AS INT)), '' ORDER BY k) AS signs FROM range(1, 32) g(k) WHERE k NOT IN (9, 10, 13)),
t AS (SELECT conv_id, turn, translate(coalesce(text, ''), beyond, signs) AS t FROM conversations, u, a), p AS (SELECT a.t AS ref, b.t AS hyp FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1) SELECT CAST(sum(levenshtein(ref, hyp)) AS BIGINT) AS edits, CAST(sum(length(ref)) AS BIGINT) AS ref_length, round(sum(levenshtein(ref, hyp)) / nullif(sum(length(ref)), 0), 6) AS rate, round(avg(CASE WHEN ref = hyp THEN 1 ELSE 0 END), 6) AS exact FROM p""")
def cer_distance(spark, d):
    """Character error rate of each second turn against the first, over code points as they are; SQL, whose distance counts bytes, gives each letter beyond ASCII a sign of one byte first."""
    from axonlake.operators import text

    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    own = lambda t, n: c.where(F.col("turn") == t).select("conv_id", F.col("t").alias(n))
    counted = text.edit_counts(own(0, "reference").join(own(1, "hypothesis"), "conv_id"))
    return text.corpus_rate(counted, []).select("edits", "ref_length", six("rate").alias("rate"), six("exact").alias("exact"))


@query(None)
def edit_counts(spark, d):
    """Substitutions, deletions and insertions of characters and words; tests hold them against a table of distances."""
    from axonlake.operators.text import edit_counts as edits

    c = table(spark, d, "conversations")
    own = lambda t, n: c.where(F.col("turn") == t).select("conv_id", F.col("text").alias(n))
    return edits(own(0, "reference").join(own(1, "hypothesis"), "conv_id"), words=True)


@query("""WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, q.label = e.label AS hit, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS sim FROM q JOIN embeddings e ON q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM s) SELECT query_id, vec_id, hit, sim FROM r WHERE k = 1""")
def retrieval_top1(spark, d):
    from axonlake.operators.retrieval import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 50 = 0"), e).select("query_id", "vec_id", "hit", "sim")


@query("WITH c AS (SELECT l_returnflag, l_linenumber, l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3), p AS (SELECT l_returnflag, l_linenumber, id, n / sum(n) OVER (PARTITION BY l_returnflag, l_linenumber) AS p, n, row_number() OVER w AS rank, coalesce(sum(n) OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY n DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM c WINDOW w AS (PARTITION BY l_returnflag, l_linenumber ORDER BY n DESC, id)) SELECT l_returnflag, l_linenumber, id, CAST(rank AS INT) AS rank, round(n / sum(n) OVER (PARTITION BY l_returnflag, l_linenumber), 6) AS share FROM p WHERE rank <= 10 AND b < 30")
def topk_topp(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber", F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    return sampling.top_k_p(c, ["l_returnflag", "l_linenumber"], 10, 30, "id", "n").select("l_returnflag", "l_linenumber", "id", "rank", six("share").alias("share"))


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), s AS (SELECT vec_id, x, list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS z FROM e) SELECT vec_id, CAST(list_position(x, list_max(x)) - 1 AS INT) AS best, round(exp(x[1] - list_max(x)) / z, 6) AS p0, round(x[1] - list_max(x) - ln(z), 6) AS log_p0, round(sqrt(list_sum(list_transform(x, lambda v: v * v))), 6) AS norm FROM s")
def array_functions(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    x = F.col("x")
    return e.select("vec_id", arrays.argmax(x).alias("best"), six(arrays.softmax(x)[0]).alias("p0"), six(arrays.log_softmax(x)[0]).alias("log_p0"), six(arrays.l2(x)).alias("norm"))


@query(None)
def ctc_decode(spark, d):
    """Greedy decoding of frames cut from each embedding; tests hold it against a loop."""
    e = table(spark, d, "embeddings")
    frames = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    return e.select("vec_id", frames.alias("f")).select("vec_id", arrays.ctc_collapse(F.col("f")).alias("decoded"))


@query("SELECT doc_id, CAST(octet_length(encode(text)) AS INT) AS n, sha256(text) AS digest, CAST(coalesce(list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT))), 0) AS BIGINT) AS total FROM documents")
def byte_tokens(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", "text", basic.byte_tokens(t).alias("x"))
    return docs.select("doc_id", F.size("x").alias("n"), F.sha2(t.cast("binary"), 256).alias("digest"), F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query(r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', 'sk-[redacted]', 'g'), 'Bearer \S+', 'Bearer [redacted]', 'g'), '(?i)(token|api_key|apikey)=[^&\s"]+', '\1=[redacted]', 'g') AS x FROM documents)
SELECT doc_id, regexp_replace(x, '("(?:token|api_key|secret|password)"\s*:\s*)"(?:[^"\\]|\\.)*"', '\1"[redacted]"', 'g') AS masked FROM m""")
def redaction(spark, d):
    """All masks on every whole text; no document has a member with a raw text, which `redaction_lines` has."""
    return table(spark, d, "documents").select("doc_id", basic.redact(F.col("text")).alias("masked"))


@query(r"""SELECT doc_id, '{"id": ' || doc_id || ', "raw_text": "[len=' || strlen(text) || ' sha256=' || left(sha256(text), 8) || ']", "password":"[redacted]", "note": "api_key=[redacted]&x Bearer [redacted] sk-[redacted]", "audio" : "[len=' || strlen(source) || ' sha256=' || left(sha256(source), 8) || ']", "token": "[redacted]"}' AS masked FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, 'sk-[A-Za-z0-9_-]{8,}|Bearer \S+|(?i:token|api_key|apikey)=[^&\s"]') AND source IS NOT NULL""")
def redaction_lines(spark, d):
    """Log lines with each document as a quoted raw text among secrets: what must come out follows from the columns, without a pattern."""
    docs = table(spark, d, "documents").where(F.col("text").isNotNull() & F.col("source").isNotNull()).where(~F.col("text").rlike(r'sk-[A-Za-z0-9_-]{8,}|Bearer [^\t\n\f\r ]+|(?i:token|api_key|apikey)=[^&\t\n\f\r "]'))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
    line = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "raw_text": '), quoted("text"), F.lit(', "password":"p\\"'), "source", F.lit('\\\\", "note": "api_key='), "source", F.lit("&x Bearer a!"), F.col("doc_id").cast("string"), F.lit(" sk-abcdefgh"), F.col("doc_id").cast("string"), F.lit('", "audio" : '), quoted("source"), F.lit(', "token": ""}'))
    return docs.select("doc_id", basic.redact(line).alias("masked"))


@query("WITH h AS (SELECT sha256(source) AS s, source FROM documents), p AS (SELECT source AS split, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents UNION ALL SELECT 'x', sha256(CAST(doc_id AS VARCHAR)) FROM documents WHERE doc_id % 100 = 0) SELECT h AS sha256, 'several_splits' AS problem FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1")
def split_validation(spark, d):
    docs = table(spark, d, "documents")
    h = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256).alias("sha256")
    return sampling.validate_partition(docs.select(F.col("source").alias("split"), h).union(docs.where("doc_id % 100 = 0").select(F.lit("x"), h)))


@query("WITH r AS (SELECT source, max(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT source, doc_id, n_chars FROM r JOIN documents USING (source, doc_id)")
def newest_record(spark, d):
    return sampling.newest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id")
