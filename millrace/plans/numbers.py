"""Numeric kernels over the embeddings, which stand for logits; the label is the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import numeric
from millrace.operators import attention, evaluation, matrices
from millrace.plans.book import Book, table

QUERIES = Book()

_E = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, (label % 64)::INTEGER AS t FROM embeddings)"
_S = f"{_E}, p AS (SELECT vec_id, x, t, list_transform(x, lambda v: exp(v - list_max(x)) / list_sum(list_transform(x, lambda u: exp(u - list_max(x))))) AS p FROM e)"


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"), F.pmod(F.col("label"), F.lit(64)).cast("int").alias("t"))


def _each(df: DataFrame, values: Column, digits: int = 7) -> DataFrame:
    return df.select("vec_id", F.posexplode(values).alias("i", "v")).select("vec_id", "i", (F.round("v", digits) + F.lit(0.0)).alias("v"))


def _unnested(cte: str, values: str, digits: int = 7) -> str:
    return f"WITH {cte}, q AS (SELECT vec_id, {values} AS q FROM p) SELECT vec_id, (i - 1)::INTEGER AS i, round(q[i], {digits}) + 0.0 AS v FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM q)"


@QUERIES.add(_unnested(_S, "p"))
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.softmax(F.col("x")))


@QUERIES.add(f"WITH {_S} SELECT vec_id, round(-ln(p[t + 1]), 7) AS loss FROM p")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", F.round(numeric.cross_entropy(F.col("x"), F.col("t")), 7).alias("loss"))


@QUERIES.add(f"WITH {_S} SELECT round(avg(-ln(p[t + 1])), 6) AS loss, count(*) AS n FROM p WHERE vec_id % 5 <> 0")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss over the rows whose target is not left out; every fifth is."""
    target = F.when(F.col("vec_id") % 5 == 0, numeric.IGNORED).otherwise(F.col("t"))
    loss = numeric.cross_entropy(F.col("x"), target)
    return _logits(spark, sf_dir).select(loss.alias("l")).agg(F.round(F.avg("l"), 6).alias("loss"), F.count("l").alias("n"))


@QUERIES.add(f"WITH {_S}, b AS (SELECT vec_id // 16 AS batch, avg(-ln(p[t + 1])) AS loss FROM p GROUP BY 1) SELECT round(avg(loss), 6) AS loss, count(*) AS n_batches FROM b")
def mean_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = _logits(spark, sf_dir).groupBy(F.floor(F.col("vec_id") / 16)).agg(F.avg(numeric.cross_entropy(F.col("x"), F.col("t"))).alias("l"))
    return batches.agg(F.round(F.avg("l"), 6).alias("loss"), F.count("l").alias("n_batches"))


@QUERIES.add(f"WITH {_E} SELECT vec_id, (len(list_filter(x, lambda v: v > x[t + 1])) + 1)::INTEGER AS rank FROM e")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _logits(spark, sf_dir).select("vec_id", numeric.target_rank(F.col("x"), F.col("t")).alias("rank"))


@QUERIES.add(f"WITH {_E}, r AS (SELECT len(list_filter(x, lambda v: v > x[t + 1])) + 1 AS rank FROM e) SELECT round(avg(rank), 7) AS mean_rank, round(avg((rank = 1)::INTEGER), 7) AS top1_rate, count(*) AS n FROM r")
def top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.rank_summary(_logits(spark, sf_dir), F.col("x"), F.col("t"))
    return found.select(F.round("mean_rank", 7).alias("mean_rank"), F.round("top1_rate", 7).alias("top1_rate"), "n")


@QUERIES.add(f"WITH {_E} SELECT vec_id, len(list_filter(x, lambda v: v >= list_reverse_sort(x)[10]))::INTEGER AS n_kept, round(list_sum(list_filter(x, lambda v: v >= list_reverse_sort(x)[10])), 6) AS kept_sum FROM e")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.filter(numeric.top_k(F.col("x"), 10), lambda v: v > float("-inf"))
    return _logits(spark, sf_dir).select("vec_id", F.size(kept).alias("n_kept"), F.round(numeric.total(kept), 6).alias("kept_sum"))


@QUERIES.add(f"""WITH {_S}, u AS (SELECT vec_id, p[i] AS v, i FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p)),
c AS (SELECT *, sum(v) OVER (PARTITION BY vec_id ORDER BY v DESC, i ROWS UNBOUNDED PRECEDING) - v AS before FROM u), k AS (SELECT *, CASE WHEN before <= 0.9 THEN v ELSE 0 END AS w FROM c)
SELECT vec_id, (i - 1)::INTEGER AS i, round(w / sum(w) OVER (PARTITION BY vec_id), 7) AS v FROM k""")
def top_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.let(numeric.softmax(F.col("x")), lambda p: numeric.top_p(p, 0.9)))


@QUERIES.add(_unnested(f"{_E}, p AS (SELECT * FROM e)", "list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i - 1 NOT IN (t, 0, 7) THEN x[i] WHEN x[i] < 0 THEN x[i] * 1.1 ELSE x[i] / 1.1 END)"))
def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.array(F.col("t"), F.lit(0), F.lit(7), F.lit(0))
    return _each(_logits(spark, sf_dir), numeric.repetition_penalty(F.col("x"), seen, 1.1))


@QUERIES.add(_unnested(f"{_E}, p AS (SELECT * FROM e)", "list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-5))"))
def rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.rms_norm(F.col("x")))


@QUERIES.add(_unnested(f"{_E}, p AS (SELECT * FROM e)", "list_transform(range(1, len(x) + 1), lambda i: x[i] / (1 + exp(-x[i])) * x[len(x) + 1 - i])"))
def swiglu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.swiglu(F.col("x"), F.reverse("x")))


@QUERIES.add(_unnested(f"{_E}, p AS (SELECT * FROM e)", "list_transform(range(1, len(x) + 1), lambda i: x[i] * cos(t / pow(10000.0, (i - 1 - (i - 1) % 2) / len(x))) + CASE WHEN i % 2 = 1 THEN -x[i + 1] ELSE x[i - 1] END * sin(t / pow(10000.0, (i - 1 - (i - 1) % 2) / len(x))))"))
def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.rope(F.col("x"), F.col("t")))


@QUERIES.add(f"WITH {_E}, n AS (SELECT vec_id, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS norm FROM e) SELECT vec_id, round(norm, 7) AS norm, round(CASE WHEN norm >= 0.9 THEN 0.9 / (norm + 1e-6) ELSE 1.0 END, 7) AS factor FROM n")
def l2_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = numeric.l2_norm(F.col("x"))
    return _logits(spark, sf_dir).select("vec_id", F.round(norm, 7).alias("norm"), F.round(numeric.clip_factor(norm, 0.9), 7).alias("factor"))


WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 10 for i in range(64)] for j in range(3)]


@QUERIES.add(f"WITH {_E} SELECT vec_id, j::INTEGER AS i, round(list_sum(list_transform(range(1, 65), lambda i: x[i] * ((((i - 1) * 7 + j * 3) % 11 - 5) / 10.0))), 7) + 0.0 AS v FROM e, range(3) t(j)")
def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each(_logits(spark, sf_dir), numeric.linear(F.col("x"), WEIGHTS))


@QUERIES.add(f"WITH {_E}, c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i = 8 THEN '-infinity'::DOUBLE WHEN i - 1 NOT IN (t, 0) THEN x[i] WHEN x[i] < 0 THEN x[i] * 1.1 ELSE x[i] / 1.1 END) AS y FROM e) SELECT vec_id, (list_position(y, list_max(y)) - 1)::INTEGER AS token FROM c")
def greedy_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoding step after the tokens t 0 7 t 0, which ban 7."""
    seen = F.array(F.col("t"), F.lit(0), F.lit(7), F.col("t"), F.lit(0))
    return _logits(spark, sf_dir).select("vec_id", numeric.greedy_step(F.col("x"), seen, 1.1, 3).alias("token"))


@QUERIES.add(f"WITH {_E}, k AS (SELECT vec_id, list_filter(list_transform(x, lambda v: v / 0.8), lambda v: v >= list_reverse_sort(x)[5] / 0.8) AS y FROM e) SELECT vec_id, len(y)::INTEGER AS n, round(list_max(list_transform(y, lambda v: exp(v - list_max(y)))) / list_sum(list_transform(y, lambda v: exp(v - list_max(y)))), 7) AS most FROM k")
def sampling_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = numeric.sampling_probs(F.col("x"), 0.8, 5, 1.0)
    told = _logits(spark, sf_dir).select("vec_id", probs.alias("p"))
    return told.select("vec_id", F.size(F.filter("p", lambda v: v > 0)).alias("n"), F.round(F.array_max("p"), 7).alias("most"))


@QUERIES.add(f"""WITH {_E}, s AS (SELECT q.vec_id, list_dot_product(q.x, k.x) / 8.0 AS score, k.x AS v FROM e q JOIN e k ON q.vec_id // 8 = k.vec_id // 8 AND k.vec_id <= q.vec_id),
w AS (SELECT *, exp(score - max(score) OVER (PARTITION BY vec_id)) AS w FROM s)
SELECT vec_id, round(sum(w * v[1]) / sum(w), 7) + 0.0 AS first, round(sum(w * v[64]) / sum(w), 7) + 0.0 AS last FROM w GROUP BY vec_id""")
def causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("context"), F.col("vec_id").alias("position"), F.col("x").alias("q"), F.col("x").alias("k"), F.col("x").alias("v"))
    out = matrices.causal_attention(rows)
    return out.select(F.col("position").alias("vec_id"), (F.round(F.get("out", F.lit(0)), 7) + F.lit(0.0)).alias("first"), (F.round(F.get("out", F.lit(63)), 7) + F.lit(0.0)).alias("last"))


#: One context of all vectors, four heads of sixteen, positions turned; kept small by comparing two entries of each result.
_HEADS = """h AS (SELECT vec_id, h, list_transform(range(1, 17), lambda i: embedding[16 * h + i]::DOUBLE) AS x FROM embeddings, range(4) t(h)),
r AS (SELECT vec_id, h, x AS v, list_transform(range(1, 17), lambda i: x[i] * cos(vec_id / pow(10000.0, (i - 1 - (i - 1) % 2) / 16.0)) + CASE WHEN i % 2 = 1 THEN -x[i + 1] ELSE x[i - 1] END * sin(vec_id / pow(10000.0, (i - 1 - (i - 1) % 2) / 16.0))) AS k FROM h),
s AS (SELECT q.vec_id, q.h, exp(list_dot_product(q.k, k.k) / 4.0) AS w, k.v FROM r q JOIN r k ON q.h = k.h AND k.vec_id <= q.vec_id)"""


@QUERIES.add(f"WITH {_HEADS} SELECT vec_id, h::INTEGER AS head, round(sum(w * v[1]) / sum(w), 7) + 0.0 AS first, round(sum(w * v[16]) / sum(w), 7) + 0.0 AS last FROM s GROUP BY vec_id, h")
def long_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention of four heads with rotary positions over all vectors as one context, in blocks of 64."""
    rows = _logits(spark, sf_dir).select(F.lit(0).cast("long").alias("context"), F.col("vec_id").alias("position"), F.col("x").alias("q"), F.col("x").alias("k"), F.col("x").alias("v"))
    out = attention.causal(rows, heads=4, theta=10000.0, block=64, segment=2)
    heads = out.select("position", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("head"), "out")
    entry = lambda at: F.round(F.get("out", F.col("head") * 16 + at), 7) + F.lit(0.0)
    return heads.select(F.col("position").alias("vec_id"), "head", entry(0).alias("first"), entry(15).alias("last"))


#: Vectors as matrices of 64 rows, one for each module; the adapter's parts are the first four columns and rows of the next.
_MATRICES = """e AS (SELECT vec_id // 64 AS module, vec_id % 64 AS i, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings),
w AS (SELECT * FROM e), a AS (SELECT module, i, j, v FROM e WHERE j < 4), b AS (SELECT module, i - 4 AS i, j, v FROM e WHERE i BETWEEN 4 AND 7),
ab AS (SELECT a.module, a.i, b.j, sum(a.v * b.v) AS ab FROM a JOIN b ON a.module = b.module AND a.j = b.i GROUP BY ALL),
u AS (SELECT module, i, j, v, coalesce(v * ab * 0.5, 0) AS gated, coalesce(ab * 0.5, 0) AS plain FROM w LEFT JOIN ab USING (module, i, j))"""


def _matrices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("module"), (F.col("vec_id") % 64).alias("i"), F.posexplode("embedding").alias("j", "v"))
    e = at.select("module", "i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))
    return e, e.where("j < 4"), e.where("i between 4 and 7").withColumn("i", F.col("i") - 4)


def _tiles(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [matrices.tiles(m, 32) for m in _matrices(spark, sf_dir)]


def _shown(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.round("v", 9) + F.lit(0.0))


@QUERIES.add(f"WITH {_MATRICES} SELECT module, i, j, round(v + gated, 9) + 0.0 AS v FROM u")
def adapter_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(matrices.fold(*_matrices(spark, sf_dir), 0.5))


_ROWS = "WHERE i < (SELECT max(vec_id) + 1 FROM embeddings) - 64 * module"


def _whole(m: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the rows that fill up the last module's tiles."""
    n = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return m.where(F.col("module") * 64 + F.col("i") < n)


@QUERIES.add(f"WITH {_MATRICES} SELECT module, i, j, round(v + gated, 9) + 0.0 AS v FROM u {_ROWS}")
def adapter_fold_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tiles of 32 x 32."""
    return _shown(_whole(matrices.untiled(matrices.fold_tiles(*_tiles(spark, sf_dir), 0.5, size=32), 32), spark, sf_dir))


@QUERIES.add(f"WITH {_MATRICES} SELECT module, i, j, round(v + plain, 9) + 0.0 AS v FROM u {_ROWS}")
def adapter_apply_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not gated: w + scale * a b."""
    return _shown(_whole(matrices.untiled(matrices.fold_tiles(*_tiles(spark, sf_dir), 0.5, False, 32), 32), spark, sf_dir))


def _norms(change: str) -> str:
    return f"""WITH {_MATRICES}, n AS (SELECT module, sqrt(sum(v * v)) AS nw, sqrt(sum({change} * {change})) AS nu FROM u GROUP BY module),
na AS (SELECT module, sqrt(sum(v * v)) AS na FROM a GROUP BY module), nb AS (SELECT module, sqrt(sum(v * v)) AS nb FROM b GROUP BY module)
SELECT round(avg(na), 9) AS norm_a, round(avg(nb), 9) AS norm_b, round(avg(CASE WHEN nw > 0 THEN nu / nw ELSE 0 END), 9) AS ratio FROM n JOIN na USING (module) JOIN nb USING (module)"""


@QUERIES.add(_norms("gated"))
def adapter_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrices.adapter_summary_tiles(*_tiles(spark, sf_dir), 0.5, True, 32)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@QUERIES.add(_norms("plain"))
def adapter_norms_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not gated, from entries."""
    found = matrices.adapter_summary(*_matrices(spark, sf_dir), 0.5, False)
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


#: A model whose logits are the row's vector, turned by the last token.
_TURNED = "list_transform(range(1, 65), lambda i: x[1 + (i - 1 + seen[len(seen)]) % 64])"


def _turned(x: Column):
    return lambda seen: F.transform(x, lambda _, i: F.get(x, ((i + F.element_at(seen, -1)) % 64).cast("int")))


_STEPS, _END = 16, 5
_GREEDY = f"""WITH RECURSIVE {_E}, d AS (SELECT vec_id, x, [t, 0, 7] AS seen, false AS done, 0 AS step FROM e
UNION ALL SELECT vec_id, x, CASE WHEN done OR token = {_END} THEN seen ELSE list_append(seen, token) END, done OR token = {_END}, step + 1 FROM (
  SELECT *, (list_position(y, list_max(y)) - 1)::INTEGER AS token FROM (
    SELECT *, list_transform(range(1, 65), lambda i: CASE WHEN list_contains(ban, i - 1) OR i - 1 = 9 THEN '-infinity'::DOUBLE WHEN NOT list_contains(seen, i - 1) THEN l[i] WHEN l[i] < 0 THEN l[i] * 1.1 ELSE l[i] / 1.1 END) AS y FROM (
      SELECT *, {_TURNED} AS l, list_transform(list_filter(range(1, len(seen) - 1), lambda i: seen[i] = seen[len(seen) - 1] AND seen[i + 1] = seen[len(seen)]), lambda i: seen[i + 2]) AS ban FROM d WHERE step < {_STEPS}))))"""


@QUERIES.add(f"{_GREEDY} SELECT vec_id, array_to_string(seen[4:], ',') AS tokens FROM d WHERE step = {_STEPS}")
def greedy_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen greedy steps with penalty, 3-gram ban and a token that is never taken, up to the end token."""
    tokens = numeric.decoded(F.array("t", F.lit(0), F.lit(7)), _turned(F.col("x")), _STEPS, _END, 1.1, 3, (9, _END))
    return _logits(spark, sf_dir).select("vec_id", F.array_join(tokens.cast("array<string>"), ",").alias("tokens"))


_DRAWN = f"""WITH RECURSIVE {_E}, d AS (SELECT vec_id, x, [t] AS seen, false AS done, 0 AS step FROM e
UNION ALL SELECT vec_id, x, CASE WHEN done OR token = {_END} THEN seen ELSE list_append(seen, token) END, done OR token = {_END}, step + 1 FROM (
  SELECT *, (len(list_filter(range(1, 65), lambda i: list_sum(q[1 : i]) / whole <= u)))::INTEGER AS token FROM (
    SELECT *, list_sum(q) AS whole FROM (
      SELECT *, list_transform(y, lambda v: CASE WHEN v >= least THEN exp(v - most) ELSE 0 END) AS q FROM (
        SELECT *, list_reverse_sort(y)[8] AS least, list_max(y) AS most, ('0x' || md5(vec_id || ':' || len(seen))[1:12])::BIGINT / 281474976710656.0 AS u FROM (
          SELECT *, list_transform(range(1, 65), lambda i: l[i] / 0.5 / CASE WHEN NOT list_contains(seen, i - 1) THEN 1 WHEN l[i] < 0 THEN 1 / 1.1 ELSE 1.1 END) AS y FROM (SELECT *, {_TURNED} AS l FROM d WHERE step < {_STEPS})))))))"""


@QUERIES.add(f"{_DRAWN} SELECT vec_id, array_to_string(seen[2:], ',') AS tokens FROM d WHERE step = {_STEPS}")
def sampled_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen draws at temperature 0.5 among the eight likeliest tokens, with numbers hashed from row and place."""
    digits = lambda seen: F.substring(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":"), F.size(seen).cast("string"))), 1, 12)
    uniform = lambda seen: F.conv(digits(seen), 16, 10).cast("long") / F.lit(281474976710656.0)
    tokens = numeric.decoded(F.array("t"), _turned(F.col("x")), _STEPS, _END, 1.1, 1, (), uniform=uniform, temperature=0.5, k=8, p=1.0)
    return _logits(spark, sf_dir).select("vec_id", F.array_join(tokens.cast("array<string>"), ",").alias("tokens"))


def _step(w: str, g: str, m: str, v: str, t: int) -> str:
    """SELECT items for one step on lists; ``g`` may be null."""
    rate = f"(0.01 * sqrt(1 - pow(0.999, {t})) / (1 - pow(0.9, {t})))"
    return f"""list_transform(range(1, 65), lambda i: {m}[i] * 0.9 + {g}[i] * 0.1) AS m{t}, list_transform(range(1, 65), lambda i: {v}[i] * 0.999 + {g}[i] * {g}[i] * 0.001) AS v{t},
    list_transform(range(1, 65), lambda i: {w}[i] - {w}[i] * 0.001 - m{t}[i] / (sqrt(v{t}[i]) + 1e-8) * {rate}) AS w{t}"""


_ZEROS = "list_transform(range(64), lambda i: 0.0::DOUBLE)"


@QUERIES.add(f"""WITH {_E}, one AS (SELECT vec_id, x, {_step('x', 'list_reverse(x)', _ZEROS, _ZEROS, 1)} FROM e),
two AS (SELECT vec_id, x, w1, m1, v1, {_step('w1', 'x', 'm1', 'v1', 2)} FROM one), late AS (SELECT vec_id, {_step('x', 'x', _ZEROS, _ZEROS, 1)} FROM e)
SELECT vec_id, (i - 1)::INTEGER AS i, round(CASE WHEN vec_id % 5 = 0 THEN late.w1[i] WHEN vec_id % 7 = 0 THEN two.w1[i] ELSE w2[i] END, 9) + 0.0 AS v, CASE WHEN vec_id % 5 = 0 OR vec_id % 7 = 0 THEN 1 ELSE 2 END AS t
FROM two JOIN late USING (vec_id), range(1, 65) r(i) WHERE vec_id % 35 <> 0""")
def optimizer_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps on the vectors as blocks of weights; a fifth has no gradient in the first and a seventh none in the second."""
    e = _logits(spark, sf_dir).where("vec_id % 35 <> 0")
    key = (F.col("vec_id").cast("string").alias("name"), F.lit(0).alias("start"))
    params = matrices.parameters(e.select(*key, F.col("x").alias("values")))
    for rows, g in (("vec_id % 5 <> 0", F.reverse("x")), ("vec_id % 7 <> 0", F.col("x"))):
        params = matrices.optimizer_step(params, e.where(rows).select(*key, g.alias("g")), 0.01, 0.1)
    found = params.select(F.col("name").cast("long").alias("vec_id"), "w", "t")
    return found.select("vec_id", "t", F.posexplode("w").alias("i", "v")).select("vec_id", "i", (F.round("v", 9) + F.lit(0.0)).alias("v"), "t")
