"""Numeric kernels over array<double> columns, as expressions that stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the label that losses leave out.
IGNORED = -666


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not wherever it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(values: Column) -> Column:
    """Shifted by the maximum; an empty array stays empty."""
    powers = let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return let(powers, lambda p: let(total(p), lambda whole: F.transform(p, lambda e: e / whole)))


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.log(total(F.transform(values, lambda x: F.exp(x - top)))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss at a 0-based target; null where the target is to be left out."""
    return F.when(target != IGNORED, log_sum_exp(logits) - F.get(logits, target))


def target_rank(logits: Column, target: Column) -> Column:
    """1 + the number of larger logits."""
    return let(F.get(logits, target), lambda own: F.size(F.filter(logits, lambda x: x > own)) + 1)


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become minus infinity; those that tie with it stay."""
    least = F.get(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)) - 1)
    return let(least, lambda kth: F.transform(logits, lambda x: F.when(x < kth, F.lit(-math.inf)).otherwise(x)))


def top_p(probs: Column, p: float, eps: float = 1e-12) -> Column:
    """Probabilities in falling order are kept while the sum before them is at most p, and renormalised; ties by place."""
    placed = F.array_sort(F.transform(probs, lambda x, i: F.struct((-x).alias("minus"), i.alias("at"), x.alias("prob"))))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, row: Column) -> Column:
        keep = state["sum"] <= p
        return F.struct((state["sum"] + row["prob"]).alias("sum"), F.when(keep, F.concat(state["kept"], F.array(row["at"].cast("int")))).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(placed, start, step)["kept"]
    masked = let(kept, lambda ids: F.transform(probs, lambda x, i: F.when(F.array_contains(ids, i), x).otherwise(F.lit(0.0))))
    return let(masked, lambda m: let(F.greatest(total(m), F.lit(eps)), lambda whole: F.transform(m, lambda x: x / whole)))


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of tokens in ``seen`` move away from being chosen again, once each."""
    if penalty <= 1.0:
        return logits
    return let(seen, lambda ids: F.transform(logits, lambda x, i: F.when(~F.array_contains(ids, i), x).when(x < 0, x * penalty).otherwise(x / penalty)))


def banned_next(tokens: Column, n: int) -> Column:
    """Tokens that would complete an n-gram which ``tokens`` already holds; sorted, each once."""
    if n <= 1:
        return F.array().cast("array<int>")

    def following(ids: Column) -> Column:
        size = F.size(ids)
        suffix = F.slice(ids, F.greatest(size - n + 2, F.lit(1)), n - 1)
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        same = let(suffix, lambda last: F.filter(starts, lambda i: F.slice(ids, i, n - 1) == last))
        return F.array_sort(F.array_distinct(F.transform(same, lambda i: F.get(ids, i + n - 2))))

    return let(tokens, following)


def rms_norm(values: Column, gain: float = 1.0, eps: float = 1e-5) -> Column:
    scale = F.sqrt(total(F.transform(values, lambda x: x * x)) / F.size(values) + eps)
    return let(scale, lambda root: F.transform(values, lambda x: x * gain / root))


def silu(values: Column) -> Column:
    return F.transform(values, lambda x: x / (1 + F.exp(-x)))


def swiglu(gate: Column, value: Column) -> Column:
    return F.zip_with(silu(gate), value, lambda a, b: a * b)


def rope(values: Column, position: Column, theta: float = 10000.0) -> Column:
    """Interleaved pairs turned by position / theta ** (2 i / d)."""
    size = F.size(values)

    def turned(x: Column, k: Column) -> Column:
        angle = position / F.pow(F.lit(theta), (k - k % 2) / size)
        other = F.get(values, F.when(k % 2 == 0, k + 1).otherwise(k - 1).cast("int"))
        return x * F.cos(angle) + F.when(k % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(values, turned)


def l2_norm(values: Column) -> Column:
    return F.sqrt(total(F.transform(values, lambda x: x * x)))


def clip_factor(norm: Column, most: float, eps: float = 1e-6) -> Column:
    return F.when(norm >= most, most / (norm + eps)).otherwise(F.lit(1.0))


def cosine_rate(step: Column, most: float, least: float, warm_up: int, cycle: int) -> Column:
    """Learning rate: linear to ``warm_up``, a cosine down to ``cycle``, then the least."""
    share = (step - warm_up) / F.lit(float(max(1, cycle - warm_up)))
    return F.when(step < warm_up, step / F.lit(float(max(1, warm_up))) * most).when(step <= cycle, least + (1 + F.cos(share * math.pi)) * (most - least) / 2).otherwise(F.lit(least))


def linear(values: Column, columns: Sequence[Sequence[float]]) -> Column:
    """The products of a vector with the columns of a small weight matrix."""
    return F.array(*[total(F.zip_with(values, F.array(*map(F.lit, c)), lambda x, w: x * w)) for c in columns])


def without(logits: Column, banned: Column) -> Column:
    return let(banned, lambda ids: F.transform(logits, lambda x, i: F.when(F.array_contains(ids, i), F.lit(-math.inf)).otherwise(x)))


def greedy_step(logits: Column, seen: Column, penalty: float = 1.1, ngram: int = 4) -> Column:
    """The next token: repetition penalty, n-gram ban, then the largest logit, the first of equal ones."""
    changed = without(repetition_penalty(logits, seen, penalty), banned_next(seen, ngram))
    return let(changed, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def sampling_probs(logits: Column, temperature: float = 1.0, k: int | None = None, p: float = 1.0) -> Column:
    """What a sampling step draws from: temperature, top-k, softmax, top-p."""
    scaled = F.transform(logits, lambda x: x / temperature)
    kept = let(scaled, lambda x: top_k(x, k)) if k else scaled
    return let(let(kept, softmax), lambda probs: top_p(probs, p))


def picked(probs: Column, uniform: Column) -> Column:
    """The first place where the running sum of ``probs`` is above ``uniform``, the last likely one if rounding leaves none."""
    kind = "struct<at:int,sum:double,found:int,last:int>"
    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(-1).alias("found"), F.lit(0).alias("last")).cast(kind)

    def step(s: Column, p: Column) -> Column:
        upto = s["sum"] + p
        found = F.when((s["found"] < 0) & (upto > uniform), s["at"]).otherwise(s["found"])
        return F.struct((s["at"] + 1).alias("at"), upto.alias("sum"), found.alias("found"), F.when(p > 0, s["at"]).otherwise(s["last"]).alias("last")).cast(kind)

    return F.aggregate(probs, start, step, lambda s: F.when(s["found"] >= 0, s["found"]).otherwise(s["last"]))


def decoded(
    prompt: Column, logits_of: Callable[[Column], Column], steps: int, end: int, penalty: float = 1.1, ngram: int = 4, ban: Sequence[int] = (), context: int = 256,
    uniform: Callable[[Column], Column] | None = None, temperature: float = 0.8, k: int | None = None, p: float = 0.9,
) -> Column:
    """The tokens that at most ``steps`` steps put behind ``prompt``; the token ``end`` ends them and is left out.

    ``logits_of`` gives the logits after the last ``context`` tokens. Each step: repetition penalty, n-gram ban, the tokens of ``ban``
    except ``end``, then the largest logit, or with ``uniform``, a number from 0 to 1 for the tokens so far, a draw.
    """
    kind = "struct<tokens:array<int>,done:boolean>"

    def chosen(tokens: Column) -> Column:
        last = F.slice(tokens, F.greatest(F.size(tokens) - context + 1, F.lit(1)), context)
        held = F.concat(banned_next(tokens, ngram), F.array(*[F.lit(b) for b in ban if b != end]).cast("array<int>"))
        logits = without(repetition_penalty(let(last, logits_of), tokens, penalty), held)
        if uniform is None:
            return let(logits, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))
        return let(uniform(tokens), lambda u: let(logits, lambda x: picked(sampling_probs(x, temperature, k, p), u)))

    def step(state: Column, _: Column) -> Column:
        grown = lambda t: F.when(t == end, F.struct(state["tokens"].alias("tokens"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(state["tokens"], F.array(t)).alias("tokens"), F.lit(False).alias("done"))).cast(kind)
        return F.when(state["done"], state).otherwise(let(chosen(state["tokens"]), grown)).cast(kind)

    start = F.struct(prompt.cast("array<int>").alias("tokens"), F.lit(False).alias("done")).cast(kind)
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(max(steps, 1))), start, step, lambda s: s["tokens"]) if steps > 0 else prompt.cast("array<int>")
    return F.slice(whole, F.size(prompt) + 1, F.lit(max(steps, 1)))


def adamw(w: Column, g: Column, m: Column, v: Column, t: Column, rate: float = 1e-3, decay: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> Column:
    """struct<w, m, v> after step ``t`` (from 1) on arrays of weights, gradients and both moments.

    Weights shrink by rate * decay first and then move by the corrected rate along m / (sqrt(v) + eps).
    """
    one, two = betas
    first = F.zip_with(m, g, lambda a, b: a * one + b * (1 - one))
    second = F.zip_with(v, g, lambda a, b: a * two + b * b * (1 - two))
    corrected = F.lit(rate) * F.sqrt(1 - F.pow(F.lit(two), t)) / (1 - F.pow(F.lit(one), t))

    def moved(m: Column, v: Column) -> Column:
        step = F.zip_with(m, v, lambda a, b: a / (F.sqrt(b) + eps))
        return F.zip_with(w, step, lambda x, s: x - x * (rate * decay) - s * corrected)

    return let(first, lambda a: let(second, lambda b: F.struct(moved(a, b).alias("w"), a.alias("m"), b.alias("v"))))
