"""Secret scans: fixed rules, and a randomness test battery for tokens that no rule names.

Native: DataFrame functions only. A candidate is a token of 20 characters or more from the alphabets that secrets
are written in. Its encoding is inferred (decimal, hex, upper-case hex, base32, base64), and against uniform
symbols of that alphabet three statistics are taken, each close to standard normal for random tokens: the
chi-squared of the symbol counts, the number of runs above and below the middle of the alphabet, and the lag-one
serial correlation. Their squares add to d, which is about chi-squared with 3 degrees of freedom for a random token
and large for text.

False-discovery control is by length class (powers of two) and over what can be reported alone: a candidate that a rule's
span covers is left out before anything is counted. Three null samples tell how often ordinary tokens have a d as small as a
candidate's: references of joined ordinary words without and with numbers among them, cut to the lengths of the class, which
exist whatever the corpus holds; and the corpus's own tokens of letters only, in one case or capitalised, if there are
any. The largest of the shares is the p-value, and the Benjamini-Hochberg rule picks the class's cutoff, at d of
16.27 (99.9 % of random tokens) at most. Each reference grows with the candidates for each that could pass, up to
``MOST_NULLS`` a class; a class where fewer than one candidate in 5,000 could pass adds nothing. Classes from 256
characters on share the reference of 128 to 255, whose d is smaller. d is taken in steps of 1/4, rounded up, so that
counts by class and step, a few thousand at most, are all that is gathered.

Defined cases: a null text is empty; very long texts and tokens are taken whole; a null id stays null; rules may overlap; a random token inside a span of a rule is not listed again;
empty tables give empty results. Offsets are code points,
end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut

BASE = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: A candidate, or (group 1 not empty) an assignment, which covers those inside it; candidates that another rule covers whole.
UNCOVERED = rf"{ASSIGN}|{CANDIDATE}"
COVERED = "^([0-9a-f]{32,}|AKIA[A-Z0-9]{12,})$"
FALSE_RATE, MOST_D, STEP, LAST_STEP = 0.05, 16.27, 4, 4000
#: Tokens of a class's reference, and the longest class that has one of its own.
LEAST_NULLS, MOST_NULLS, LONGEST_CLASS = 4_000, 100_000, 7
#: Ordinary words of the four languages of the tables, which the reference joins.
WORDS = (
    "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when "
    "who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even "
    "most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world "
    "still own see men work long get here between both life being under never day same another know while last might great old year off come since against go came right used "
    "take three der die und das ist nicht ein eine mit von auf werden haben sein les des une dans pour que avec sur plus mais comme los las del para por como pero todo"
).split()
#: Spans that are appended one by one.
CHUNK = 256

#: Alphabets by encoding, symbols in order of their values (fixed values).
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def located(text: Column, pattern: str, least: int = 0, group: int = 0, most: int | None = None) -> Column:
    """array of (start, end, match) of the leftmost non-overlapping matches whose ``group`` has ``least`` to ``most`` characters.

    A match starts after the lengths of the pieces between matches and of the matches before it.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    grouped = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    rows = F.arrays_zip(gaps.alias("gaps"), matches.alias("matches"), grouped.alias("grouped"))
    spans = "array<struct<start:bigint,end:bigint,token:string>>"
    state = f"struct<at:bigint,done:array<{spans}>,open:{spans}>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{spans}>").alias("done"), F.array().cast(spans).alias("open")).cast(state)

    def step(acc: Column, row: Column) -> Column:
        """Found spans gather in chunks, so that appending does not copy all of them each time."""
        begin = acc["at"] + row["gaps"]["gap"]
        end = begin + row["gaps"]["size"]
        fit = F.length(row["grouped"]) >= least if most is None else F.length(row["grouped"]).between(least, most)
        grown = F.when(fit, F.concat(acc["open"], F.array(F.struct(begin.alias("start"), end.alias("end"), row["matches"].alias("token"))))).otherwise(acc["open"])
        full = F.size(acc["open"]) >= CHUNK
        return F.struct(end.alias("at"), F.when(full, F.concat(acc["done"], F.array(grown))).otherwise(acc["done"]).alias("done"), F.when(full, F.array().cast(spans)).otherwise(grown).alias("open")).cast(state)

    whole = F.aggregate(rows, start, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["open"]))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(spans))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, which keeps the work on a long token linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tested(token: Column) -> Column:
    """d of a token: the squares of the three standardised statistics under its inferred encoding."""
    return let(F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+//"), lambda plain: let(alphabet_of(plain), lambda alphabet: let(values_of(plain, alphabet), lambda v: let(F.length(alphabet).cast("double"), lambda a: deviation(a, v)))))


def alphabet_of(plain: Column) -> Column:
    """The symbols of the inferred encoding in order."""
    kinds = {"decimal": "^[0-9]+$", "hex": "^[0-9a-f]+$", "upper": "^[0-9A-F]+$", "base32": "^[A-Z2-7]+$"}
    found = F.lit(ALPHABETS["base64"])
    for name, pattern in reversed(kinds.items()):
        found = F.when(plain.rlike(pattern), ALPHABETS[name]).otherwise(found)
    return found


def values_of(plain: Column, alphabet: Column) -> Column:
    return F.transform(F.regexp_extract_all(plain, F.lit("."), F.lit(0)), lambda c: (F.instr(alphabet, c) - 1).cast("int"))


def deviation(a: Column, values: Column) -> Column:
    """d of symbol values 0..a-1; tokens of fewer than two symbols are as far from random as can be."""
    squares = F.aggregate(F.array_distinct(values), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(values, lambda x: x == v)).cast("double"), F.lit(2.0)))
    pairs = F.zip_with(F.slice(values, 1, F.size(values) - 1), F.slice(values, 2, F.size(values) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    turns = lambda rows, half: F.aggregate(rows, F.lit(0.0), lambda s, p: s + ((p["x"] >= half) != (p["y"] >= half)).cast("double"))
    products = lambda rows, mean: F.aggregate(rows, F.lit(0.0), lambda s, p: s + (p["x"] - mean) * (p["y"] - mean))

    def of(n: Column, square_sum: Column, rows: Column) -> Column:
        chi = (a / n * square_sum - n - (a - 1)) / F.sqrt(2 * (a - 1))
        runs = (turns(rows, a / 2) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        serial = products(rows, (a - 1) / 2) / ((a * a - 1) / 12 * F.sqrt(n - 1))
        return let(chi, lambda c: let(runs, lambda r: let(serial, lambda k: c * c + r * r + k * k)))

    d = let(F.size(values).cast("double"), lambda n: let(squares, lambda q: let(pairs, lambda rows: of(n, q, rows))))
    return F.when(F.size(values) >= 2, d).otherwise(F.lit(float(LAST_STEP)))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, tokens): spans of the rules and the candidates that they leave, with their tested values."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", located(text, ASSIGN, 8, 1).alias("assign"), located(text, ACCESS).alias("access"), located(text, HEX).alias("hex"), F.filter(located(text, UNCOVERED, 0, 1, 0), lambda t: ~t["token"].rlike(COVERED)).alias("tokens"))

    def summed_up(t: Column) -> Column:
        word = t["token"].rlike("^([a-z]+|[A-Z]?[a-z]+|[A-Z]+)$")
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), F.floor(F.log2(F.length(t["token"]))).cast("int").alias("class"), stepped(t["token"]).alias("step"), word.alias("word"))

    slim = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(name)
    return found.select("doc_id", *map(slim, BASE), F.transform("tokens", summed_up).alias("tokens"))


def reference(spark: SparkSession, kind: int, n: int, numbers: bool) -> DataFrame:
    """(token): n tokens of words joined bare, by -, _ or /, or in camel case, of all lengths of the class ``kind``.

    With ``numbers`` one word in ten is followed by a number of one to four digits.
    """
    least, most = max(20, 1 << kind), (2 << kind) - 1
    drawn = lambda i, size, salt=0: F.pmod(F.xxhash64("id", F.lit(kind), i, F.lit(salt)), F.lit(size)).cast("int")
    vocabulary, style = F.array(*map(F.lit, WORDS)), F.pmod("id", F.lit(5))
    number = lambda i: F.when(drawn(i, 10, 1) == 0, F.substring(drawn(i, 10_000, 2).cast("string"), F.lit(1), 1 + drawn(i, 4, 3))).otherwise("")
    word = lambda i: F.concat(F.get(vocabulary, drawn(i, len(WORDS))), number(i)) if numbers else F.get(vocabulary, drawn(i, len(WORDS)))
    words = F.transform(F.sequence(F.lit(1), F.lit(most // 2 + 1)), word)
    joined = F.when(style == 0, F.array_join(words, ""))
    for k, mark in enumerate("-_/"):
        joined = joined.when(style == k + 1, F.array_join(words, mark))
    joined = joined.otherwise(F.array_join(F.transform(words, F.initcap), ""))
    return spark.range(n).select(F.substring(joined, F.lit(1), F.lit(least) + drawn(F.lit(0), most - least + 1)).alias("token"))


def stepped(token: Column) -> Column:
    """d in whole steps."""
    return F.least(F.ceil(tested(token) * STEP), F.lit(LAST_STEP)).cast("int")


def cutoffs(tokens: DataFrame) -> dict[int, int]:
    """The largest step of d that passes, by length class, from (class, step, word)."""
    counts = cut(tokens.groupBy("class", "step").agg(F.sum(F.col("word").cast("long")).alias("null"), F.sum((~F.col("word")).cast("long")).alias("n")))
    could = F.sum(F.when(F.col("step") <= MOST_D * STEP, F.col("n")).otherwise(0))
    needs: dict[int, tuple[int, list[int]]] = {}
    for r in counts.groupBy("class").agg(F.sum("n").alias("m"), could.alias("k")).where("k > 0").collect():
        kind, n = min(r["class"], LONGEST_CLASS), min(max(LEAST_NULLS, -(-40 * r["m"] // r["k"])), MOST_NULLS)
        most, classes = needs.get(kind, (0, []))
        needs[kind] = max(most, n), [*classes, r["class"]]
    if not needs:
        return {}
    kinds = [(kind, n, classes, numbers) for kind, (n, classes) in sorted(needs.items()) for numbers in (False, True)]
    made = [
        reference(tokens.sparkSession, kind, n, numbers).select(stepped(F.col("token")).alias("step")).select(F.explode(F.array(*map(F.lit, classes))).alias("class"), "step", F.lit(numbers).alias("numbers"))
        for kind, n, classes, numbers in kinds
    ]
    made = reduce(DataFrame.union, made).groupBy("class", "step").agg(*[F.count_if(F.col("numbers") == b).alias(c) for b, c in ((False, "words"), (True, "mixed"))])
    none = F.lit(0).cast("long")
    both = counts.select("*", none.alias("words"), none.alias("mixed")).union(made.select("class", "step", none, none, "words", "mixed"))
    samples = ("null", "n", "words", "mixed")
    both = both.groupBy("class", "step").agg(*[F.sum(c).alias(c) for c in samples])
    upto, whole = Window.partitionBy("class").orderBy("step"), Window.partitionBy("class")
    told = both.select("class", "step", *[F.sum(c).over(w).alias(f"{c}_{name}") for c in samples for name, w in (("upto", upto), ("all", whole))])
    share = lambda c: (F.lit(1) + F.col(f"{c}_upto")) / (F.lit(1) + F.col(f"{c}_all"))
    p = F.greatest(share("words"), share("mixed"), F.col("null_upto") / F.greatest("null_all", F.lit(1)))
    passing = told.where((F.col("words_all") > 0) & (F.col("n_upto") > 0) & (F.col("step") <= MOST_D * STEP) & (p <= FALSE_RATE * F.col("n_upto") / F.col("n_all")))
    return {r["class"]: r["step"] for r in passing.groupBy("class").agg(F.max("step").alias("step")).collect()}


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, random): arrays of (start, end) for every row of ``docs`` (doc_id, text)."""
    table = cut(scanned(docs))
    limits = cutoffs(table.select(F.explode("tokens").alias("t")).select("t.*"))

    def passes(t: Column) -> Column:
        least = F.lit(-1)
        for kind, step in sorted(limits.items()):
            least = F.when(t["class"] == kind, F.lit(step)).otherwise(least)
        inside = F.exists(F.concat(*BASE), lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]))
        return ~t["word"] & (t["step"] <= least) & ~inside

    extra = F.transform(F.filter("tokens", passes), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return table.select("doc_id", *BASE, extra.alias("random"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the rules' matches, the hash of their spans and all spans rendered, for every row."""
    kinds = (*BASE, "random")
    tagged = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(kinds.index(k)).alias("kind"), s["end"].alias("end"), F.lit(k).alias("name")))
    placed = lambda names: F.array_sort(F.concat(*map(tagged, names)))
    text = lambda names: F.array_join(F.transform(placed(names), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    return find(docs).select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(text(BASE), 256).alias("base_sha256"), text(kinds).alias("spans"))
