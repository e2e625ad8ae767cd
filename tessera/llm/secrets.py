"""Secret scan: base rules for three kinds, and a pair of character Markov models for the rest; DataFrame operations only.

Base spans are the leftmost non-overlapping matches of a kind's pattern, those that fail its length rule dropped.
Beyond them, runs of key-like characters, and the parts of such runs beside base spans, of ``min_length`` or more, are scored
by two first-order Markov models of characters, one of random strings and one of ordinary identifiers.  Running sums of
the log-likelihood ratio less ``threshold`` find the part of a run that is likeliest random; it is widened to the
separators around it, and is a span of kind ``markov`` if it is long enough and its ratio per transition exceeds ``threshold``
(``letters``, if it has no digit).  So a key behind a path or a name is found as well as one that stands alone.
Both models are trained from labelled samples (``train``), with add-half smoothing; ``default_samples`` makes a
labelled table of random keys (bits of SHA-512 in base 62, base 64 and hexadecimal, and letters alone) and of identifiers
(common words joined in snake, kebab, camel and path style).

Positions count code points, ends exclusive.  Defined results: a null text is empty and has no spans; a text of any length is
scanned whole; one row per input row, so repeated rows and null ids pass through; other columns, whatever their names, are
ignored by ``scan`` and kept by ``redact``; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

_WORDS = (
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she "
    "there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could "
    "these two may first then do any like my now over such our man me even most made after also did many off before must well back through years "
    "where much your way down should because long each just state people those too mr how little good world make very year still see own work men "
    "day get here old life both between being under three never know same last another while us might great go come since against right came take "
    "used himself few house use place during high without again home around small however found user name file path value index count list data "
    "config server client request response handler manager service default version update delete create table column string number"
).split()


def default_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, random): n labelled strings of each kind, the same on every run."""
    ids = spark.range(0, n, 1, 1)
    raw = F.unhex(F.sha2(F.concat(F.lit("key-"), F.col("id").cast("string")), 512))
    base64 = F.regexp_replace(F.base64(raw), r"\s", "")
    random = F.when(F.col("id") % 4 == 0, F.lower(F.hex(raw))).when(F.col("id") % 4 == 1, base64).when(F.col("id") % 12 == 2, F.lower(F.regexp_replace(base64, "[+/=0-9]", ""))).otherwise(F.regexp_replace(base64, "[+/=]", ""))
    words = F.array(*[F.lit(w) for w in _WORDS])
    pick = lambda k: F.get(words, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(_WORDS))).cast("int"))
    style = F.col("id") % 5
    joined = lambda sep: F.concat_ws(sep, *[pick(k) for k in range(5)])
    camel = F.concat(pick(0), *[F.initcap(pick(k)) for k in range(1, 5)])
    names = F.when(style == 0, joined("_")).when(style == 1, joined("-")).when(style == 2, joined("/")).when(style == 3, camel).otherwise(F.concat(joined("-"), F.lit("-"), (F.col("id") % 2030).cast("string")))
    return ids.select(random.alias("text"), F.lit(True).alias("random")).union(ids.select(names, F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of every transition, row by row of the alphabet.  At most
    2 x len(ALPHABET)^2 counts reach the driver, however many samples there are."""
    m = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.char_length("text") - 1))
    pairs = samples.where(F.char_length("text") > 1).select("random", "text", at.alias("i")).select("random", F.substr("text", F.col("i"), F.lit(2)).alias("pair"))
    counts = [[[0.5] * m for _ in range(m)] for _ in range(2)]
    for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect():
        a, b = ALPHABET.find(r.pair[0]), ALPHABET.find(r.pair[1])
        if a >= 0 and b >= 0:
            counts[bool(r.random)][a][b] += r.n
    import math

    return [math.log(counts[1][a][b] / sum(counts[1][a])) - math.log(counts[0][a][b] / sum(counts[0][a])) for a in range(m) for b in range(m)]


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio per transition."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1
    known = lambda i: (code(i) >= 0) & (code(i + 1) >= 0)
    step = lambda s, i: s + F.when(known(i), F.get(table, code(i) * len(ALPHABET) + code(i + 1))).otherwise(0.0)
    n = F.char_length(token) - 1
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), step) / n


def likeliest(value: Column, model: list[float], threshold: float) -> Column:
    """(lo, hi) of the part of a string whose ratio less ``threshold``, summed over its transitions, is largest, widened to the
    separators (or ends) around it."""
    table = F.split(F.lit(",".join(f"{x - threshold:.6f}" for x in model)), ",").cast("array<double>")
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(value, i, F.lit(1))) - 1
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(1).alias("from"), F.lit(0.0).alias("best"), F.lit(1).alias("lo"), F.lit(1).alias("hi"))

    def step(a: Column, i: Column) -> Column:
        x = F.get(table, code(i) * len(ALPHABET) + code(i + 1))
        total = F.when(a["sum"] > 0, a["sum"] + x).otherwise(x)
        start = F.when(a["sum"] > 0, a["from"]).otherwise(i)
        more = total > a["best"]
        return F.struct(total.alias("sum"), start.alias("from"), F.greatest(total, a["best"]).alias("best"), F.when(more, start).otherwise(a["lo"]).alias("lo"), F.when(more, i + 1).otherwise(a["hi"]).alias("hi"))

    def widened(a: Column) -> Column:
        left = F.char_length(F.regexp_extract(F.substr(value, F.lit(1), a["lo"] - 1), "[A-Za-z0-9]*$", 0))
        right = F.char_length(F.regexp_extract(F.substr(value, a["hi"] + 1), "^[A-Za-z0-9]*=*", 0))
        return F.struct((a["lo"] - 1 - left).alias("lo"), (a["hi"] + right).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(value) - 1), zero, step, widened)


def matches(text: Column, pattern: str, may: str) -> Column:
    """Array of (start, stop, value) of a pattern's matches; ``may``: a cheaper pattern of texts that can have any.

    Starts are running sums of the lengths of what lies between and of the matches.  The sums are made block by block, so
    that a text with very many matches does not copy its whole list for each.
    """
    size = 256
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lens = F.transform(F.arrays_zip(values.alias("v"), gaps.alias("g")), lambda z: F.struct(z["v"].alias("v"), F.char_length(z["g"]).alias("g"), F.coalesce(F.char_length(z["v"]), F.lit(0)).alias("m")))
    item = "array<struct<start:int,stop:int,value:string>>"
    one = lambda a, z: F.struct((a["at"] + z["g"] + z["m"]).alias("at"), F.when(z["v"].isNull(), a["got"]).otherwise(F.concat(a["got"], F.array(F.struct((a["at"] + z["g"]).alias("start"), (a["at"] + z["g"] + z["m"]).alias("stop"), z["v"].alias("value"))))).alias("got"))
    zero = lambda at: F.struct(at.alias("at"), F.array().cast(item).alias("got"))

    def block(a: Column, k: Column) -> Column:
        got = F.aggregate(F.slice(a["lens"], k * size + 1, F.lit(size)), zero(a["at"]), one)
        return F.struct(got["at"].alias("at"), F.concat(a["got"], got["got"]).alias("got"), a["lens"].alias("lens"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(item).alias("got"), lens.alias("lens"))
    found = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(values)) / size).cast("int")), start, block, lambda a: a["got"])
    return F.when(text.rlike(may), found).otherwise(F.array().cast(item))


def scan(docs: DataFrame, model: list[float] | None = None, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_length: int = 20, threshold: float = 0.5, letters: float = 1.0) -> DataFrame:
    """Per row: key, text, __kept (a struct of ``keep``), __base and __spans: arrays of (start, kind, stop), kind as its place in KINDS, in order."""
    model = train(default_samples(docs.sparkSession)) if model is None else model
    t = F.coalesce(F.col(text), F.lit(""))
    run = f"[{ALPHABET[:-1]}-]"
    rows = docs.select(F.col(key), F.col(text), F.struct(F.lit(1).alias("__one"), *[F.col(c) for c in keep]).alias("__kept"), t.alias("__t"))
    c = F.col("__t")
    rows = rows.withColumns({
        "__assign": matches(c, ASSIGN, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
        "__access": matches(c, ACCESS, "AKIA[A-Z0-9]{12}"),
        "__hex": matches(c, "[0-9a-f]{32,}", "[0-9a-f]{32}"),
        "__run": matches(c, f"(?<!{run}){run}{{{min_length},}}+", f"(?<!{run}){run}{{{min_length}}}"),
    })
    tagged = lambda name, kind, ok: F.transform(F.filter(name, ok), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop")))
    assign = tagged("__assign", 0, lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    access = tagged("__access", 1, lambda s: s["stop"] - s["start"] >= 16)
    hexes = tagged("__hex", 2, lambda s: s["stop"] - s["start"] >= 32)
    rows = rows.withColumn("__base", F.array_sort(F.concat(assign, access, hexes)))
    part = lambda s, lo, hi: F.struct(lo.alias("start"), hi.alias("stop"), F.substr(s["value"], lo - s["start"] + 1, F.greatest(hi - lo, F.lit(0))).alias("value"))

    def beside(s: Column) -> Column:
        """The parts of a run before and after the base spans in it."""
        met = F.filter("__base", lambda b: (s["start"] < b["stop"]) & (b["start"] < s["stop"]))
        first, last = F.array_min(F.transform(met, lambda b: b["start"])), F.array_max(F.transform(met, lambda b: b["stop"]))
        return F.when(F.size(met) == 0, F.array(s)).otherwise(F.array(part(s, s["start"], F.greatest(first, s["start"])), part(s, F.least(last, s["stop"]), s["stop"])))

    rows = rows.withColumn("__part", F.filter(F.flatten(F.transform("__run", beside)), lambda s: s["stop"] - s["start"] >= min_length))
    best = F.transform("__part", lambda s: F.struct(s.alias("s"), likeliest(s["value"], model, threshold).alias("at")))
    rows = rows.withColumn("__best", F.transform(best, lambda b: part(b["s"], b["s"]["start"] + b["at"]["lo"], b["s"]["start"] + b["at"]["hi"])))
    random = lambda s: (s["stop"] - s["start"] >= min_length) & (ratio(s["value"], model) > F.when(s["value"].rlike("[0-9]"), threshold).otherwise(letters))
    rows = rows.withColumn("__spans", F.array_sort(F.concat("__base", tagged("__best", 3, random))))
    return rows.drop("__t", "__assign", "__access", "__hex", "__run", "__part", "__best")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    found = scan(docs, key=key, text=text, **how)
    n = lambda kind: F.size(F.filter("__base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(key, n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.col("__spans")).alias("spans"))


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = "[REDACTED]", **how: object) -> DataFrame:
    """The rows of docs with every span replaced by ``mark``; n_chars, if there, follows the text."""
    found = scan(docs, key=key, text=text, keep=tuple(docs.columns), **how)
    t, some = F.col(text), F.size("__spans") > 0
    step = lambda a, s: F.when(s["stop"] <= a["at"], a).otherwise(F.struct(s["stop"].alias("at"), F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out")))
    clean = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substr(t, a["at"] + 1)))
    rows = found.select("__kept", F.when(some, clean).otherwise(t).alias("__clean"), some.alias("__some"))
    new = {text: F.col("__clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__some"), F.char_length("__clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__kept")["n_chars"])
    return rows.select(*[new.get(c, F.col("__kept").getField(c)).alias(c) for c in docs.columns])
