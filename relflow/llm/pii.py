"""Personal data and secrets by fixed patterns and bootstrapped contextual extraction, all native.

Base spans come from one pattern per kind (leftmost, non-overlapping, failing ones dropped).  With
the values of assignments to a secret's name (``token = "..."``) they are the seeds.  Every
identifier-like token (one with a digit or an @) is a candidate instance; the word before it, the two
words before it and the word behind it are its lexical patterns.  Per kind, patterns and instances
whose shape leaves room for the kind form a bipartite graph, counted over the whole corpus.

Rounds alternate.  A pattern's confidence is the scored share of all places in the corpus where its
words may stand, by an identifier or not (a still unknown instance that would fit counts half), so
that common words never become patterns.  It is strong with ``CONFIDENCE`` and at least ``SUPPORT``
different values that are seeds or were found in earlier rounds.  An instance's score is one minus the
odds that all its strong patterns are wrong; seeds stay at one.  The rounds end when none brings a new
strong pattern, after ``ROUNDS`` at most.  Instances beside a strong pattern are new spans of its kind;
secret seeds are spans too.

Patterns are written in linear-time form (possessive loops, look-behind instead of retries inside
a run), so long runs of one character class cannot blow up.  Graph steps aggregate before the
shuffle; its joins broadcast what belongs to hot patterns and values (``join_skewed``), so one of them
may hold any share of the edges.

Defined results: null text counts as empty and has no spans; rows are judged by themselves, so
repeated rows give repeated results; an empty table gives none; other columns never enter
``find`` and pass through ``redact`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import anchored, bind, cut, flagged, join_skewed, numbered, table, text_of, words

KINDS = ("email", "ip", "card", "phone")
#: Spans of the method may also be of this kind.
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
ROUNDS = 5
CONFIDENCE = 0.6
SUPPORT = 3

_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns; possessive where what follows cannot match what the loop takes.
PATTERN = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "array<struct<s:int,e:int,v:string,g:string,h:string>>"
_FOUND = "array<struct<k:int,s:int,e:int>>"


def _digits(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", ""))


def _passes(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return _digits(v).between(16, 19) & F.call_function("luhn_check", F.regexp_replace(v, "[^0-9]", ""))
    if kind == "phone":
        return _digits(v).between(8, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with code-point bounds: s, e (exclusive), v, and the texts around up to the next ones, g and h."""

    def place(ms: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, z: Column) -> Column:
            s = acc["at"] + F.length(z["g"])
            e = s + F.length(z["m"])
            one = F.array(F.struct(s.alias("s"), e.alias("e"), z["m"].alias("v"), z["g"].alias("g"), z["h"].alias("h")))
            return F.struct(e.alias("at"), F.concat(acc["out"], one).alias("out"))

        def of(gaps: Column) -> Column:
            n = F.size(ms)
            rows = F.arrays_zip(F.slice(gaps, 1, n).alias("g"), ms.alias("m"), F.slice(gaps, 2, n).alias("h"))
            return F.aggregate(rows, zero, step, lambda acc: acc["out"])

        return bind(F.split(text, pattern, -1), of)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return bind(found, lambda ms: F.when(F.size(ms) == 0, F.array().cast(_SPAN)).otherwise(place(ms)))


def _spans_of(text: Column, k: int, kind: str) -> Column:
    good = F.filter(matches(text, PATTERN[kind]), lambda m: _passes(kind, m["v"]))
    return F.transform(good, lambda m: F.struct(F.lit(k).alias("k"), m["s"].alias("s"), m["e"].alias("e")))


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e>> of the four kinds, by kind and start."""
    guard = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]")}
    none = F.array().cast(_FOUND)
    each = []
    for k, kind in enumerate(KINDS):
        each.append(F.when(guard[kind], _spans_of(text, k, kind)).otherwise(none))
    return F.concat(*each)


#: From the first digit or @ of a token to its end, and on through further groups of digits.
_TOKEN = r"[0-9@][^\s]*+(?:\x20[(+]?[0-9][0-9().-]*+)*+"
_CAND = "array<struct<s:int,e:int,v:string,patterns:array<string>,k:int>>"
#: What an assignment to a secret has before its value.
_NAMED = r"(?i)(?:^|[^a-z])(?:[a-z]+[_-])?(?:key|token|secret|password|passwd|pwd)[\"']?\s?[:=]{1,2}>?\s?[\"'(]*$"


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens with the patterns around them; k: the kind they seed, or null."""

    def one(m: Column) -> Column:
        before = F.regexp_replace(m["g"], r"\s+", " ")
        head = F.substring_index(before, " ", -1)  # what the token has before its first digit
        whole = F.concat(head, m["v"])
        value = F.regexp_replace(F.regexp_replace(whole, r"[^\p{L}\p{N}]++$", ""), r"^[^\p{L}\p{N}+(@]++", "")
        lead = F.length(F.regexp_extract(whole, r"^[^\p{L}\p{N}+(@]*+", 0))
        s = m["s"] - F.length(head) + F.least(lead, F.length(whole))
        e = s + F.length(value)
        left = F.lower(F.rtrim(F.substring(before, F.lit(1), F.length(before) - F.length(head))))
        right = F.lower(F.substring_index(F.ltrim(F.regexp_replace(m["h"], r"\s+", " ")), " ", 1))
        word, pair = F.substring_index(left, " ", -1), F.ltrim(F.substring_index(left, " ", -2))
        around = F.array(F.when(word != "", F.concat(F.lit("<"), word)), F.when(F.contains(pair, F.lit(" ")), F.concat(F.lit("<"), pair)), F.when(right != "", F.concat(F.lit(">"), right)))
        seed = F.get(F.filter(base, lambda b: (b["s"] < e) & (b["e"] > s)), F.lit(0))["k"]
        named = F.concat(F.substring(left, -60, 60), F.lit(" "), F.regexp_extract(whole, r"^[\"'(]*+", 0)).rlike(_NAMED) & _fits(SECRET, value)
        return F.struct(s.alias("s"), e.alias("e"), value.alias("v"), F.filter(around, lambda p: p.isNotNull()).alias("patterns"), F.coalesce(seed, F.when(named, F.lit(SECRET))).alias("k"))

    return F.when(text.rlike("[0-9@]"), F.filter(F.transform(matches(text, _TOKEN), one), lambda c: c["v"] != "")).otherwise(F.array().cast(_CAND))


def _fits(kind: int, v: Column) -> Column:
    """Whether a token's shape leaves room for the kind."""
    n = _digits(v)
    letters = v.rlike("[A-Za-z]")
    return (
        v.rlike(r"^[^@\s]*[A-Za-z][^@\s]*@[^@\s]*[A-Za-z][^@\s]*$"),
        ~letters & v.rlike(r"^[0-9]+[.:][0-9]+[.:][0-9]+[.:][0-9]+$"),
        ~letters & n.between(12, 19) & v.rlike(r"^[0-9][0-9 .-]+$"),
        ~letters & n.between(7, 15) & v.rlike(r"^[0-9(+][0-9 ().-]+$"),
        letters & (n > 0) & v.rlike(r"^[A-Za-z0-9_+/=.-]{16,}$"),
    )[kind]


def _edges(cands: DataFrame) -> DataFrame:
    """kind, pattern, value, n, seed: the pattern-instance graph of each kind, seeds and what would fit."""
    rows = cands.select("v", "k", F.explode("patterns").alias("pattern")).groupBy("pattern", F.col("v").alias("value"))
    rows = rows.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
    kinds = F.array(*[F.when((F.col("k") == k) | F.col("k").isNull() & _fits(k, F.col("value")), F.lit(k)) for k in range(len(ALL_KINDS))])
    flat = rows.withColumn("kind", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    return flat.select("kind", "pattern", "value", "n", F.col("k").isNotNull().alias("seed"))


def _places(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern -> places: in how many places of all texts its words may stand.  texts: t; patterns: pattern.

    Every word of the corpus is counted.  A pair stands at most as often as the rarer of its words, which
    bounds its confidence from below without a count of all pairs.
    """
    counts = texts.select(F.explode(words(F.lower("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    wanted = patterns.select("pattern", F.explode(F.split(F.substring("pattern", F.lit(2), F.length("pattern")), " ")).alias("word"))
    return wanted.join(counts, "word").groupBy("pattern").agg(F.min("n").alias("places"))


def _confidence(edges: DataFrame) -> DataFrame:
    """kind, pattern, conf, support and the edges of each (w).  edges: with score and places."""
    scored = F.sum(F.col("n") * F.col("score"))
    unknown = F.sum(F.col("n") * (1 - F.col("score")))
    places = F.greatest(F.max("places"), F.sum("n"))
    return edges.groupBy("kind", "pattern").agg((scored / (places - 0.5 * unknown + 0.5)).alias("conf"), F.sum((F.col("score") >= 0.5).cast("int")).alias("support"), F.count(F.lit(1)).alias("w"))


def learn(cands: DataFrame, texts: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """kind, pattern, conf, w of the strong patterns.  cands: v, patterns, k; texts: t."""
    edges = cut(_edges(cands), "edges")
    total = edges.count()
    # a pattern of fewer values can never be strong
    wide = cut(edges.groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("w")).filter(F.col("w") >= support), "wide")
    places = _places(texts, wide.select("pattern").distinct())
    # read twice by the join: the corpus's words are to be counted once
    known = cut(wide.join(places, "pattern").select("kind", "pattern", "places", "w"), "places")
    edges = cut(join_skewed(edges, known, ["kind", "pattern"], "w", total).withColumn("score", F.col("seed").cast("double")), "edges")
    before = 0
    strong = _confidence(edges).filter((F.col("conf") >= confidence) & (F.col("support") >= support))
    for n in range(rounds):
        strong = cut(strong, "strong")
        if (now := strong.count()) == before or n == rounds - 1:
            break
        before = now
        lit = join_skewed(edges.select("kind", "pattern", "value"), strong.select("kind", "pattern", "conf", "w"), ["kind", "pattern"], "w", total)
        score = lit.groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("found"), F.count(F.lit(1)).alias("w"))
        edges = join_skewed(edges.drop("score"), score, ["kind", "value"], "w", total, "left")
        edges = cut(edges.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))).drop("found"), "edges")
        strong = _confidence(edges).filter((F.col("conf") >= confidence) & (F.col("support") >= support))
    return strong.select("kind", "pattern", "conf", "w")


_AT = ["__file", "__row"]


def _added(cands: DataFrame, texts: DataFrame) -> DataFrame:
    """locator -> added: spans of the strong patterns, and secret seeds.  cands: locator and candidates."""
    strong = cut(learn(cands, texts), "patterns")
    free = cands.filter("k is null").select(*_AT, "s", "e", "v", F.explode("patterns").alias("pattern"))
    fit = F.lit(False)
    for k in range(len(ALL_KINDS)):
        fit = fit | ((F.col("kind") == k) & _fits(k, F.col("v")))
    hit = join_skewed(free, strong, ["pattern"], "w", free.count()).filter(fit)
    best = hit.groupBy(*_AT, "s", "e").agg(F.max(F.struct("conf", (-F.col("kind")).alias("k"))).alias("b")).select(*_AT, F.struct((-F.col("b.k")).alias("k"), "s", "e").alias("x"))
    seeds = cands.filter(F.col("k") == SECRET).select(*_AT, F.struct(F.col("k"), "s", "e").alias("x"))
    return best.unionByName(seeds).groupBy(*_AT).agg(F.array_sort(F.collect_list("x")).alias("added"))  # bounded by its document


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """__file, __row, doc_id, base and added spans: one row per document."""
    own, key, text = numbered(docs, key, text)
    return _find(anchored(own), key, text)


def _find(rows: DataFrame, key: str, text: str) -> DataFrame:
    t = text_of(text)
    texts = rows.select(*_AT, F.col(key).alias("doc_id"), t.alias("t"))
    spans = texts.withColumn("base", base_spans(F.col("t")))
    spans = cut(spans.select(*_AT, "doc_id", "base", candidates(F.col("t"), F.col("base")).alias("cands")), "spans")
    cands = spans.select(*_AT, F.explode("cands").alias("c")).select(*_AT, "c.*")
    out = spans.select(*_AT, "doc_id", "base").join(_added(cands, texts.select("t")), _AT, "left")
    return out.withColumn("added", F.coalesce("added", F.array().cast(_FOUND)))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by <KIND>; columns and their order unchanged.

    Only documents with added spans meet those by shuffle; all others are rewritten where they are read.
    """
    own, key, text = numbered(docs, key, text)
    rows = anchored(own)
    more = cut(_find(rows, key, text).filter(F.size("added") > 0).select(*_AT, "added"), "added")
    marked = flagged(rows, more)
    none = marked.filter("not __hit").withColumn("added", F.array().cast(_FOUND))
    some = marked.filter("__hit").join(more, _AT).select(*none.columns)
    t, label = text_of(text), F.array(*[F.lit(f"<{k.upper()}>") for k in ALL_KINDS])

    def rewrite(ss: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            # a span that starts inside the one before only extends what is hidden
            gap = F.when(x["s"] >= acc["at"], F.array(F.substring(t, acc["at"] + 1, x["s"] - acc["at"]), F.get(label, x["k"]))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

        return F.aggregate(ss, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))

    spans = F.array_sort(F.transform(F.concat(base_spans(t), "added"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    clean = bind(spans, lambda ss: F.when(F.size(ss) == 0, F.col(text)).otherwise(rewrite(ss)))
    out = [df.withColumn(text, clean).select(*own.columns) for df in (none, some)]
    return out[0].unionByName(out[1]).toDF(*docs.columns)


def _line(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return f.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_line(F.col("base")), 256).alias("base_sha256"),
        _line(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
