"""Quality rules as a short-circuit cascade, all in native column expressions.

Every rule is a boolean column that is true for a document to reject.  ``plan_cascade``
times each rule and sees what it rejects on a small sample; the cascade then runs the rules by
rejections per second, most first, each counted over what the rules before it leave, in one CASE
expression, which Spark evaluates lazily, so a rejected document never pays for the rules after
the one that caught it.  The order changes the cost only: the verdict is the OR of all rules in any
order (``rejected_by`` names the first one met, the base rules before the others).

Defined results: null text counts as empty and is rejected (too few words); the row stays in
``annotate`` and goes in ``keep``.  Rows are judged one by one, so repeated rows, ties and
null keys need no rule, and columns of any other name pass through (annotate writes only the
names in SIGNALS plus ``base_failed``, ``kept`` and ``rejected_by``, replacing columns so named).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, bind, table, text_of, words

SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows on which costs and rejections are estimated.  They decide the order of the rules only.
SAMPLE_ROWS = 500
#: Texts longer than this are left out of that sample (they are judged like all others).
SAMPLE_POINTS = 50_000


def n_symbols(t: Column) -> Column:
    return (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long")


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def n_dup_lines(t: Column) -> Column:
    return bind(_lines(t), lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


#: Low bits of a packed window that hold its place; longer texts take the sort of pairs.
_PLACE_BITS = 20


def repeat_words(ws: Column) -> Column:
    """Words covered by three-word windows that the text holds at least twice.

    Windows are sorted as longs of 44 bits of their hash and their place; neighbours that agree in the
    bits are compared word by word.  A text where such a pair differs, or with over 2^20 windows, is
    settled by sorting the windows' words themselves.
    """
    zero, low = F.lit(0).cast("long"), (1 << _PLACE_BITS) - 1
    mask = F.lit(low).cast("long")
    high = F.lit(~low).cast("long")

    def covered(at: Column) -> Column:
        # places ascend; each window adds the words up to the next window's start, three at most
        nxt = F.slice(F.concat(F.slice(at, 2, F.size(at)), F.array(F.lit(2**62))), 1, F.size(at))
        return F.aggregate(F.zip_with(at, nxt, lambda a, b: F.least(b - a, F.lit(3).cast("long"))), zero, lambda s, x: s + x)

    def by_words(w: Column) -> Column:
        def places(ps: Column) -> Column:
            same = lambda p, q: (p["a"] == q["a"]) & (p["b"] == q["b"]) & (p["c"] == q["c"])

            def hit(p: Column, i: Column) -> Column:
                return F.coalesce(same(F.get(ps, i - 1), p), F.lit(False)) | F.coalesce(same(F.get(ps, i + 1), p), F.lit(False))

            return F.sort_array(F.transform(F.filter(ps, hit), lambda p: p["i"].cast("long")))

        windows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda a, i: F.struct(a.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
        return bind(bind(F.sort_array(windows), places), covered)

    def by_longs(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")))

        def settle(s: Column) -> Column:
            near = F.filter(F.transform(s, lambda x, i: F.when(x.bitwiseXOR(F.get(s, i + 1)).bitwiseAND(high) == 0, i)), lambda i: i.isNotNull())

            def of(at: Column) -> Column:
                first = lambda i: F.get(s, i).bitwiseAND(mask)
                second = lambda i: F.get(s, i + 1).bitwiseAND(mask)
                unlike = lambda i, k: F.get(w, first(i).cast("int") + k) != F.get(w, second(i).cast("int") + k)
                wrong = F.exists(at, lambda i: unlike(i, 0) | unlike(i, 1) | unlike(i, 2))
                places = F.sort_array(F.array_distinct(F.concat(F.transform(at, first), F.transform(at, second))))
                return F.when(F.size(at) == 0, zero).when(wrong, by_words(w)).otherwise(bind(places, covered))

            return bind(near, of)

        return bind(F.sort_array(hashes), settle)

    return F.when(F.size(ws) < 4, zero).otherwise(bind(ws, lambda w: F.when(F.size(w) > low, by_words(w)).otherwise(by_longs(w))))


#: Signals of the words (an array that is split once) and of the text.
_OF_WORDS = {"n_words": lambda w: F.size(w).cast("long"), "word_chars": lambda w: F.length(F.array_join(w, "")).cast("long"), "n_repeat_words": repeat_words}
_OF_TEXT = {"n_symbols": n_symbols, "n_dup_lines": n_dup_lines}


class Signals:
    """Signal name -> column: those already computed by reference, others from the words or the text."""

    def __init__(self, text: Column, words: Column | None = None):
        self.text, self.words = text, words

    def __getitem__(self, name: str) -> Column:
        if self.words is None:
            return F.col(f"__{name}")
        return _OF_WORDS[name](self.words) if name in _OF_WORDS else _OF_TEXT[name](self.text)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: object  # Signals -> boolean Column
    base: bool = False


def default_rules(min_words: int = 50, max_repeat_pct: int = 50, max_symbol_pct: int = 20, max_dup_line_pct: int = 50, min_mean: float = 2.0, max_mean: float = 14.0, max_upper_pct: int = 40, max_shout_pct: int = 30) -> list[Rule]:
    def dup_lines(s: Signals) -> Column:
        return (s["n_dup_lines"] > 1) & (100 * s["n_dup_lines"] > max_dup_line_pct * F.size(_lines(s.text)))

    def upper(s: Signals) -> Column:
        return 100 * (F.length(s.text) - F.length(F.regexp_replace(s.text, r"\p{Lu}+", ""))) > max_upper_pct * s["word_chars"]

    return [
        Rule("too_few_words", lambda s: s["n_words"] < min_words, True),
        Rule("repeated_words", lambda s: 100 * s["n_repeat_words"] > max_repeat_pct * s["n_words"], True),
        Rule("symbols", lambda s: 100 * s["n_symbols"] > max_symbol_pct * s["n_words"]),
        Rule("word_length", lambda s: (s["word_chars"] < min_mean * s["n_words"]) | (s["word_chars"] > max_mean * s["n_words"])),
        Rule("duplicate_lines", dup_lines),
        Rule("upper_case", upper),
        Rule("shouting", lambda s: 100 * (F.length(s.text) - F.length(F.replace(s.text, F.lit("!"), F.lit("")))) > max_shout_pct * s["n_words"]),
    ]


@dataclass(frozen=True)
class Planned:
    rule: Rule
    seconds: float  # on the sample, the job itself taken off
    rejects: float  # the share of the sample that reaches the rule and is rejected by it


def plan_cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS, repeats: int = 3) -> list[Planned]:
    """The rules in the order to run.

    The sample is drawn from all files.  A rule costs the least of some timed runs over it, less that of
    a job that tests nothing.  Then the rule of most rejections per second comes first, and again among
    the rules and documents left.
    """
    rules = rules or default_rules()
    share = min(1.0, sample_rows / max(1, docs.count()))
    rows = docs.select(text_of(text).alias("__t")).sample(share, seed=1).filter(F.length("__t") <= SAMPLE_POINTS).coalesce(4)
    sample = rows.persist()
    try:
        sample.count()

        def seconds(test: Column) -> float:
            runs = []
            for _ in range(repeats):
                began = time.perf_counter()
                sample.filter(test).count()
                runs.append(time.perf_counter() - began)
            return min(runs)

        tests = [_verdict([rule], F.col("__t")).isNotNull() for rule in rules]
        idle = seconds(F.length("__t") < 0)
        costs = [max(seconds(t) - idle, 1e-4) for t in tests]
        # rules by document, a few bits for each row of the sample
        hits = [list(r) for r in sample.select(*[t.alias(f"r{i}") for i, t in enumerate(tests)]).collect()]
    finally:
        sample.unpersist()
    return order_rules(rules, costs, hits)


def order_rules(rules: list[Rule], costs: list[float], hits: list[list[bool]]) -> list[Planned]:
    """Greedy: the most rejections per cost among the documents that are left, until no rule is."""
    total, left, out = max(1, len(hits)), list(range(len(rules))), []
    while left:
        found = {i: sum(h[i] for h in hits) for i in left}
        best = max(left, key=lambda i: (found[i] / costs[i], -costs[i], -i))
        out.append(Planned(rules[best], costs[best], found[best] / total))
        left.remove(best)
        hits = [h for h in hits if not h[best]]
    return out


def _first_hit(order: list[Rule], signals: Signals) -> Column:
    hit = None
    for rule in order:
        test = F.coalesce(rule.rejects(signals), F.lit(False))
        hit = F.when(test, rule.name) if hit is None else hit.when(test, rule.name)
    return hit


def _verdict(order: list[Rule], text: Column) -> Column:
    """The first rule that rejects the text; the words are split once, each rule runs only if it is reached."""
    return bind(words(text), lambda w: _first_hit(order, Signals(text, w)))


def keep(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, columns unchanged; each stops at its first failing rule."""
    order = [p.rule for p in plan_cascade(docs, rules, text)]
    return docs.filter(_verdict(order, text_of(text)).isNull())


def annotate(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """All rows with the five signals, base_failed, kept and rejected_by (the cascade's first hit)."""
    rules = rules or default_rules()
    order = [p.rule for p in plan_cascade(docs, rules, text)]
    t = text_of(text)
    df = docs.withColumns({f"__{name}": of(t) for name, of in _OF_TEXT.items()})
    packed = bind(words(t), lambda w: F.struct(*[of(w).alias(name) for name, of in _OF_WORDS.items()]))
    df = df.withColumn("__w", packed).withColumns({f"__{name}": F.col(f"__w.{name}") for name in _OF_WORDS}).drop("__w")
    signals = Signals(t)
    # the base verdict comes of signals that are computed anyway; the rules beside it run only where it passes
    base = _first_hit([r for r in order if r.base], signals)
    more = _first_hit([r for r in order if not r.base], signals)
    df = df.withColumn("__base", F.lit(None).cast("string") if base is None else base)
    df = df.withColumn("__hit", F.coalesce("__base", F.lit(None).cast("string") if more is None else more))
    outs = {**{s: F.col(f"__{s}") for s in SIGNALS}, "base_failed": F.col("__base").isNotNull(), "kept": F.col("__hit").isNull(), "rejected_by": F.col("__hit")}
    return df.withColumns(outs).drop(*[f"__{s}" for s in SIGNALS], "__base", "__hit")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *SIGNALS, "base_failed", "kept")


#: The same rules and thresholds in SQL, counting windows with a join-free window function.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i+1], ws[i+2]) AS n
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, text, len(ls) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        length(text) - length(regexp_replace(text, '\p{Lu}+', '', 'g')) AS capitals,
        length(text) - length(replace(text, '!', '')) AS bangs
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words
       OR (n_dup_lines > 1 AND 100 * n_dup_lines > 50 * n_lines)
       OR 100 * capitals > 40 * word_chars OR 100 * bangs > 30 * n_words) AS kept
FROM b
"""
